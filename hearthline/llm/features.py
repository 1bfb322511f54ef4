"""Hashed count features of whole texts, as numpy vectors."""

from __future__ import annotations

from itertools import starmap
from operator import eq

import numpy as np

#: Sizes of the blocks of a quality vector: byte pairs, shapes of four bytes, word repetition.
PAIRS, SHAPES, REPEATS = 1024, 6**4, 8
QUALITY_SIZE = PAIRS + SHAPES + REPEATS
#: Size of a language vector: hashed byte pairs and triples of the letters.
LETTERS = 4096

#: Bytes of a text handled at a time; counts add up, so the whole text is used.
PIECE = 1 << 20


def _shape_table() -> np.ndarray:
    """Class of each byte: lower case, upper case, digit, white space, above ASCII, other."""
    kind = np.full(256, 5, np.int64)
    kind[ord("a") : ord("z") + 1] = 0
    kind[ord("A") : ord("Z") + 1] = 1
    kind[ord("0") : ord("9") + 1] = 2
    kind[[9, 10, 11, 12, 13, 32]] = 3
    kind[128:] = 4
    return kind


def _letter_table() -> np.ndarray:
    """Letters and bytes above ASCII stay; anything else is a space."""
    kept = np.full(256, 32, np.uint32)
    kept[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
    kept[128:] = np.arange(128, 256)
    return kept


SHAPE_OF, LETTER_OF = _shape_table(), _letter_table()


def _pieces(data: np.ndarray, overlap: int):
    for start in range(0, max(len(data) - overlap, 0), PIECE):
        yield data[start : start + PIECE + overlap]


def quality_counts(text: str) -> np.ndarray:
    """Counts of byte pairs, byte shapes and repeated words of a whole text."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    pairs, shapes = np.zeros(PAIRS), np.zeros(SHAPES)
    for part in _pieces(data, 1):
        b = part.astype(np.uint32)
        pairs += np.bincount((b[:-1] * 31 + b[1:] * 7 + (b[:-1] >> 3)) % PAIRS, minlength=PAIRS)
    for part in _pieces(data, 3):
        k = SHAPE_OF[part]
        shapes += np.bincount(
            ((k[:-3] * 6 + k[1:-2]) * 6 + k[2:-1]) * 6 + k[3:], minlength=SHAPES
        )
    words = text.split()
    repeats = np.zeros(REPEATS)
    if words:
        repeats[0] = sum(starmap(eq, zip(words, words[1:])))
        repeats[1] = len(words) - 1 - repeats[0]
        fresh = len(set(words)) / len(words)
        # Shares of words seen for the first time, in classes; weighed like the words.
        repeats[2 + min(int(fresh * 6), 5)] = len(words)
    return np.concatenate([pairs, shapes, repeats])


def quality_blocks(counts: np.ndarray) -> np.ndarray:
    """Damped counts, every block scaled to length one (rows are texts)."""
    damped = np.sqrt(counts)
    ends = np.cumsum([0, PAIRS, SHAPES, REPEATS])
    parts = []
    for start, end in zip(ends, ends[1:]):
        block = damped[:, start:end]
        length = np.sqrt((block * block).sum(axis=1, keepdims=True))
        parts.append(np.divide(block, length, out=np.zeros_like(block), where=length > 0))
    return np.concatenate(parts, axis=1)


def letter_counts(text: str) -> np.ndarray:
    """Counts of hashed byte pairs and triples of the lower-cased letters of a whole text."""
    counts = np.zeros(LETTERS)
    data = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    for part in _pieces(data, 2):
        b = LETTER_OF[part]
        first, second, third = b[:-2], b[1:-1], b[2:]
        inner = second != 32
        triples = (first * 961 + second * 31 + third * 7) % (LETTERS // 2)
        pairs = (first * 57 + second) % (LETTERS // 2) + LETTERS // 2
        counts += np.bincount(triples[inner], minlength=LETTERS)
        counts += np.bincount(pairs[inner], minlength=LETTERS)
    return counts


def letter_vectors(counts: np.ndarray) -> np.ndarray:
    damped = np.sqrt(counts)
    length = np.sqrt((damped * damped).sum(axis=1, keepdims=True))
    return np.divide(damped, length, out=np.zeros_like(damped), where=length > 0)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))
