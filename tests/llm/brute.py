"""Literal versions of operators, for small inputs."""

import hashlib
import zlib
from collections import Counter


def periodic_words(doc_id, text):
    words = (text or "").encode().split()
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def runs(words):
    """All (start, length, period), lag by lag; a stretch counts with its smallest period."""
    n, best = len(words), {}
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            start, length = i - q, j - i + q
            if length >= max(6, 4 * q):
                best.setdefault((start, length), q)
            i = j
    return sorted((s, length, q) for (s, length), q in best.items())


def op11(doc_id, text):
    words = periodic_words(doc_id, text)
    found = runs(words)
    gone = set()
    for s, length, q in found:
        gone.update(range(s + q, s + length))
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    top = None
    for r in found:
        if top is None or r[1] * top[2] > top[1] * r[2]:
            top = r
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    digest = (hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc_id, len(found), *best, *digest)


def op12(rows, minimum=5):
    import re

    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            if doc_id is not None:
                h = zlib.crc32(f"{doc_id}:{run}".encode())
                if h % 199 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= minimum}
    holes = {}
    for w in words:
        for i in range(len(w)):
            holes.setdefault((w[:i], w[i + 1 :]), set()).add(w)
    near = {w: set() for w in words}
    for w in words:
        for i in range(len(w)):
            near[w] |= holes[w[:i], w[i + 1 :]] - {w}
            shorter = w[:i] + w[i + 1 :]
            if shorter in words:
                near[w].add(shorter)
                near[shorter].add(w)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out)


def op13(rows, size=200):
    data = [(doc_id, (text or "").encode()) for doc_id, text in rows]
    seen = Counter(b[i : i + size] for _, b in data for i in range(len(b) - size + 1))
    out = []
    for doc_id, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                gone[i : i + size] = b"\x01" * size
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((doc_id, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out
