"""Substring de-duplication, Jaccard join, packing and the pipeline."""

import os
import random
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hearthline.llm import jaccard, packing, substrings
from hearthline.llm.queries import tokenizer_path

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def prose(rng, n, words=12):
    return " ".join(
        " ".join(rng.choice(WORDS) for _ in range(words)).capitalize() + "." for _ in range(n)
    )


WORDS = ["".join(p) for p in __import__("itertools").product("bdfgklmnprst", "aeiou", "bdgklmnrst")]


def test_repeated_passages_go_but_the_first(spark):
    rng = random.Random(1)
    passage, other = prose(rng, 5), prose(rng, 6)
    own = [prose(rng, 8) for _ in range(8)]
    glued = "and here it is " + passage + " then lower case goes on"
    unmarked = " ".join(rng.choice(WORDS) for _ in range(300))
    rows = [
        (4, own[0] + " " + passage + " " + own[1]), (2, own[2] + "\n" + passage), (9, glued), (5, own[3]), (6, other),
        (7, other), (7, other), (None, own[4] + " " + passage), (10, ""), (11, None), (12, unmarked), (13, unmarked),
        (14, "One. Two. Three."), (15, "One. Two. Three."), (16, passage + " " + own[5] + " " + passage),
    ]
    found = substrings.deduplicate(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    by = {r["doc_id"]: r for r in found}
    assert by[2]["text"] == rows[1][1] and by[2]["n_removed"] == 0
    assert by[4]["text"] == own[0] + " " + own[1]
    assert by[5]["text"] == own[3] and by[6]["text"] == other
    assert [r["text"] for r in found if r["doc_id"] == 7] == ["", ""]
    assert by[None]["text"] == own[4]
    # Only the sentence that the passage begins within may stay.
    assert by[9]["text"].startswith("and here it is") and by[9]["text"].endswith("then lower case goes on")
    assert len(by[9]["text"].split()) <= 9 + 12
    assert (by[10]["text"], by[11]["text"]) == ("", None) and by[12]["text"] == unmarked
    assert len(by[13]["text"].split()) < 40
    assert by[14]["text"] == by[15]["text"] == "One. Two. Three."
    assert by[16]["text"] == own[5]
    assert substrings.deduplicate(frame(spark, [])).collect() == []


def test_passages_spliced_at_any_word_go(spark):
    """51 words without marks, between and within sentences, with and without spaces."""
    rng = random.Random(8)
    own = lambda n: [rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) for _ in range(n)]
    signs = "".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(60))
    rows, expected, parts = [], {}, {}
    for k in range(40):
        passage = own(51)
        if k % 2:
            passage = [w.strip(",.") for w in passage]
        for c in range(3):
            before, behind = own(rng.randrange(5, 60)), own(rng.randrange(5, 60))
            before.append(f"b{k}x{c}")
            behind[0] = f"e{k}x{c}"
            rows.append((10 * k + c, " ".join(before + passage + behind)))
            expected[10 * k + c], parts[10 * k + c] = c == 0, (before, passage, behind)
    for c in range(2):
        edge = "甲乙丙丁"[2 * c : 2 * c + 2]
        rows.append((900 + c, edge[0] + signs + edge[1]))
        expected[900 + c], parts[900 + c] = c == 0, ([edge[0]], list(signs), [edge[1]])
    found = {r["doc_id"]: r["text"] for r in substrings.deduplicate(frame(spark, rows)).collect()}
    lost = []
    for doc, (before, passage, behind) in parts.items():
        kept = substrings.words(found[doc])[0]
        assert kept[: len(before)] == before and kept[len(kept) - len(behind) :] == behind
        left = kept[len(before) : len(kept) - len(behind)]
        if expected[doc]:
            assert left == passage
            continue
        # Only words of the sentences that the passage begins and ends within stay.
        head = next(i for i in range(len(left) + 1) if i == len(left) or left[i] != passage[i])
        assert left[head:] == passage[len(passage) - len(left) + head :]
        lost.append(len(left))
    assert max(lost) < 30 and np.mean(lost) < 9


def spans_of(text):
    """(words, sentences as (first, end)) by the rule, word by word."""
    import xxhash

    words, ends = [], set()
    for line in text.split("\n"):
        words += line.split()
        ends.add(len(words))
    marks = [xxhash.xxh3_64_intdigest(w.lower()) // 2 * 2 + (w[-1] in substrings.MARKS) for w in words]
    for i, m in enumerate(marks):
        others = [marks[j] for j in (i - 2, i - 1, i + 1, i + 2) if 0 <= j < len(marks)]
        if m % 2 or (len(others) == 4 and m < min(others)):
            ends.add(i + 1)
    ends = sorted(ends - {0})
    return words, list(zip([0, *ends[:-1]], ends))


def test_sentence_spans_equal_a_comparison_of_all_runs(spark):
    """Every run of whole sentences, as words, in the order of the documents."""
    rng = random.Random(9)
    rows, stock = [], [[rng.choice(WORDS) + rng.choice(["", "", "", "", ".", ",", "\n"]) for _ in range(40)] for _ in range(12)]
    for doc in range(90):
        body = []
        for _ in range(rng.randrange(6)):
            part = rng.choice(stock)
            low = rng.randrange(len(part))
            body += part[low : low + rng.randrange(60)] if rng.random() < 0.7 else [rng.choice(WORDS) for _ in range(rng.randrange(30))]
        rows.append((doc, " ".join(body).upper() if doc % 7 == 0 else " ".join(body)))
    seen, expected = set(), []
    for doc, text in rows:
        words, sentences = spans_of(text)
        gone = [False] * len(words)
        for k, (first, _) in enumerate(sentences):
            end = next((e for _, e in sentences[k:] if e - first >= substrings.SPAN_WORDS), None)
            if end is not None:
                span = tuple(w.lower() for w in words[first:end])
                if span in seen:
                    gone[first:end] = [True] * (end - first)
                seen.add(span)
        kept = [w for w, g in zip(words, gone) if not g]
        expected.append((doc, kept, len(sentences), sum(gone[e - 1] for _, e in sentences)))
    found = substrings.deduplicate(frame(spark, rows)).collect()
    assert sorted((r["doc_id"], r["text"].split(), r["n_sentences"], r["n_removed"]) for r in found) == expected
    assert sum(n for *_, n in expected) > 200


def linked(rows, k, percent):
    """Components by comparing all pairs; per distinct (id, text)."""

    def tokens(text):
        words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
        if not words:
            return frozenset()
        n = min(k, len(words))
        return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))

    sets = [tokens(t) for _, t in rows]
    use = [i for i in range(len(rows)) if sets[i] and rows[i][0] is not None]
    root = {i: i for i in range(len(rows))}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for x, a in enumerate(use):
        for b in use[:x]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for i in use:
        least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return [
        (doc, len(sets[i]), None if doc is None else least.get(find(i), doc)) for i, (doc, _) in enumerate(rows)
    ]


def corpus(seed, groups, copies):
    """Groups of near copies with ever more words changed, shared passages, odd rows."""
    rng = random.Random(seed)
    shared = prose(rng, 4)
    rows = []
    for _ in range(groups):
        words = prose(rng, rng.choice([2, 6, 20])).split() + (shared.split() if rng.random() < 0.6 else [])
        for c in range(rng.choice([1, copies])):
            changed = list(words)
            for _ in range(rng.randrange(0, 2 + len(words) // 25)):
                changed[rng.randrange(len(words))] = rng.choice(WORDS)
            rows.append(" ".join(changed) if c % 3 else " ".join(changed).upper())
    rng.shuffle(rows)
    numbered = [(i * 7 % 1009, t) for i, t in enumerate(rows)]
    return numbered + [(5000, ""), (5001, None), (5002, "one"), (5003, "ONE"), (5004, "a b c"), (5005, "a b c d"),
                       (None, rows[0]), (5006, rows[0]), (5006, rows[0]), (5006, rows[-1]), (5007, "w " * 30_000)]


@pytest.mark.parametrize(("rare", "k", "percent", "hubs", "block"), [(64, 4, 85, 1, 1024), (2, 5, 80, 1, 3), (2, 4, 85, 0, 4)])
def test_join_equals_all_pairs(spark, rare, k, percent, hubs, block, monkeypatch):
    """Also without any first rounds, when all links come from pairs within blocks."""
    if not hubs:
        monkeypatch.setattr(jaccard, "NEAREST_ROUNDS", 0)
    monkeypatch.setattr(jaccard, "RARE", rare)
    monkeypatch.setattr(jaccard, "HUB_ROUNDS", hubs)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "PER_CLASS", 8)
    rows = corpus(rare, 40, 9)
    found = jaccard.join(frame(spark, rows), k, percent).collect()
    key = lambda r: tuple(-1 if v is None else v for v in r)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found), key=key)
    assert got == sorted(linked(rows, k, percent), key=key)


def test_join_with_small_bounds_of_memory(spark, monkeypatch):
    """What a task remembers is dropped again and again; no link is lost."""
    for name, value in (("HELD", 2), ("COMPARED", 2), ("HUB_ROUNDS", 0), ("BLOCK", 5)):
        monkeypatch.setattr(jaccard, name, value)
    rows = corpus(4, 8, 6)
    key = lambda r: tuple(-1 if v is None else v for v in r)
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join(frame(spark, rows)).collect()]
    assert sorted(got, key=key) == sorted(linked(rows, 4, 85), key=key)


def test_representatives(spark):
    rng = random.Random(3)
    a, b = prose(rng, 20), prose(rng, 20)
    rows = [(3, a), (1, a + " end."), (2, b), (2, b), (9, ""), (None, a), (4, None)]
    docs = frame(spark, rows)
    kept = jaccard.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == sorted(
        [(1, a + " end."), (2, b), (9, ""), (0, a), (4, "")]
    )
    assert jaccard.join(docs.limit(0)).collect() == []


def test_shingles_of_many_texts_at_once(monkeypatch):
    """Words of all texts are hashed together; a set depends on its own text only."""
    monkeypatch.setattr(jaccard.xxhash, "xxh3_64_intdigest", calls := Counted(jaccard.xxhash.xxh3_64_intdigest))
    rng = random.Random(14)
    signs = ["a", "B", "b ", " ", "\t", "\x0b", "\x1c", "\x00", "\x85", "\xa0", "é", "É", "Z" * 9, "x" * 70, "X" * 70, "一 "]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(600)]
    texts += [None, "", " ", "a " * 3, "y" * 300]

    def runs(text):
        words = (text or "").encode().lower().split()
        return frozenset(tuple(words[i : i + 4]) for i in range(max(len(words) - 3, min(len(words), 1))))

    known = {}
    for together, at_once in ((1 << 19, 1 << 16), (50, 1 << 16), (1, 3)):
        monkeypatch.setattr(jaccard, "TOGETHER", together)
        monkeypatch.setattr(jaccard, "AT_ONCE", at_once)
        found = list(jaccard.shingles(pa.array(["left out", *texts])[1:], 4))
        assert len(found) == len(texts)
        for text, tokens in zip(texts, found):
            assert (tokens[1:] > tokens[:-1]).all()
            assert len(tokens) == len(runs(text))
            assert known.setdefault(runs(text), tokens.tolist()) == tokens.tolist()
    assert len({tuple(v) for v in known.values()}) == len(known) > 400
    # Short words are never hashed one by one.
    assert calls.sizes and min(calls.sizes) > jaccard.SHORT
    assert list(jaccard.shingles(pa.array([], pa.string()), 4)) == []


class Counted:
    """A hash function that notes the lengths of what it is given."""

    def __init__(self, function):
        self.function, self.sizes = function, []

    def __call__(self, data):
        self.sizes.append(len(data))
        return self.function(data)


def test_sketches_leave_no_link_out():
    rng = np.random.default_rng(8)
    for n in (1, 5, 40, 300, 3000):
        sets = [np.sort(rng.integers(0, 1 << 63, n).astype(np.uint64))]
        for share in (0.0, 0.02, 0.05, 0.09, 0.2, 0.6):
            fresh = rng.random(n) < share
            sets.append(np.where(fresh, rng.integers(0, 1 << 63, n).astype(np.uint64), sets[0])[: n - rng.integers(0, n // 9 + 1)])
        marks = np.frombuffer(b"".join(map(jaccard.sketch, sets)), np.uint64).reshape(len(sets), -1)
        may, _ = jaccard._may_link(np.array([len(s) for s in sets]), marks, slice(0, len(sets)), 85)
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                both = len(np.intersect1d(x, y))
                linked = 100 * both >= 85 * (len(x) + len(y) - both)
                assert may[i, j] or not linked
                assert linked or n != 300 or both > 0.8 * n or not may[i, j]


def test_signatures_lose_no_pair():
    """Prefix filters on random sets: linked pairs always share an entry."""
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 7, 20, 64, 150, 400):
        for _ in range(30):
            base = np.unique(rng.integers(0, 1 << 63, n + 60, dtype=np.int64).astype(np.uint64))
            x = np.sort(base[rng.permutation(len(base))[:n]])
            drop = rng.integers(0, max(1, n // 12) + 1)
            y = np.unique(np.concatenate([x[drop:], base[rng.permutation(len(base))[: rng.integers(0, drop + 1)]]]))
            both = len(np.intersect1d(x, y))
            if not both or 100 * both < 85 * (len(x) + len(y) - both):
                continue
            rx, ry = (s[: jaccard.reduced_size(len(s), 85)] for s in (x, y))
            shared = np.intersect1d(rx, ry)
            counts = {int(t): int(c) for t, c in zip(shared, rng.choice([2, 5, 300], len(shared)))}
            entries = [
                jaccard.signatures(len(s), shared, np.array([counts[int(t)] for t in shared], np.uint32), 85) for s in (x, y)
            ]
            assert len(np.intersect1d(*entries))


def test_packing_round_trip(spark, monkeypatch):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    rng = random.Random(2)
    texts = [prose(rng, rng.choice([1, 5, 40, 900])) for _ in range(60)]
    texts += ["", None, "Ünï  <|endoftext|> it's x y 12,3\x1fz É", "一二三 😀", "a" * 5000, prose(rng, 9000)]
    rows = [*enumerate(texts), (0, texts[0]), (None, "no id")]
    monkeypatch.setattr(packing, "SEGMENT", 2 * packing.WINDOW)
    found = packing.pack(frame(spark, rows), path, with_ids=True).collect()
    tokenizer = Tokenizer.from_file(path)
    expected = sorted(
        [(-1 if i is None else i, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t in rows]
    )
    got, seen = [], {}
    for r in found:
        assert len(r["ids"]) == 4 * r["length"] > 0 and zlib.crc32(r["ids"]) == r["ids_crc32"]
        seen.setdefault((-1 if r["doc_id"] is None else r["doc_id"], r["doc_tokens"]), []).append((r["start"], bytes(r["ids"])))
    for (doc, total), parts in seen.items():
        copies = sum(1 for e in expected if e[0] == doc)
        joined = b"".join(p for _, p in sorted(parts)) if copies == 1 else None
        if copies == 1:
            assert len(joined) == 4 * total
            got.append((doc, joined))
        else:
            # Rows that repeat an id: every id as often as there are rows.
            assert sum(len(p) for _, p in parts) == copies * 4 * total
            got += [e for e in expected if e[0] == doc]
    assert sorted(got) == expected
    sequences = {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    sizes = []
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        sizes.append(at)
    assert all(s == packing.WINDOW or s & (s - 1) == 0 for s in sizes) and max(sizes) <= packing.WINDOW
    assert packing.pack(frame(spark, []), path).collect() == []


def test_ids_equal_those_of_whole_texts():
    from tokenizers import Tokenizer

    path = tokenizer_path()
    tokenizer, rng = Tokenizer.from_file(path), random.Random(6)
    encode = packing.Encoder(path)
    assert encode.by_parts
    signs = [chr(c) for c in range(9, 14)] + [chr(c) for c in range(32, 256)] + ["'s", "'LL", "İ", "e\u0301", "一", "\u2028", "\u00a0", "<|", "\x1f", "ǅ"]
    texts = ["".join(rng.choice(signs[: rng.choice([230, len(signs)])]) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += [prose(rng, 30), "", " ", "ÀÉ'S 12²½ª", "<|endoftext|> x"]
    for text in texts:
        ids = encode(text)
        assert ids.tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2], repr(text)


def test_parts_are_looked_up_together(monkeypatch):
    """Ids are those of the tokenizer however texts meet; a part is learned once, also where it finds no place."""
    from tokenizers import Tokenizer

    path = tokenizer_path()
    tokenizer, rng = Tokenizer.from_file(path), random.Random(16)
    few = ["'", "s", "T", "r", "e", "ve", "l", "'s", "'RE", "''", "1", "23", ".", ",'", " ", "\n", "d", "m", "é", "²", "word", "longer" * 4]
    texts = ["".join(rng.choice(few) for _ in range(rng.randrange(12))) for _ in range(3000)]
    texts += ["'", "ll", "'l", "l", "", "一 word", "<| word", "it's we'll 'really ''s"]
    want = [[*tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    for places, together in ((1 << 21, 1 << 19), (4, 100), (64, 1)):
        packing._forget()
        monkeypatch.setattr(packing, "PLACES", places)
        monkeypatch.setattr(packing, "TOGETHER", together)
        encode = packing.Encoder(path)
        assert [ids.tolist() for ids in encode.all(texts)] == want
        assert 0 < len(encode.known) <= places
        learned = []
        monkeypatch.setattr(encode.known, "learned", lambda part, f=encode.known.learned: learned.append(part) or f(part))
        assert [ids.tolist() for ids in encode.all(texts)] == want
        if places == 1 << 21:
            assert learned and min(map(len, learned)) > packing.PART_LENGTH
            assert len(learned) < sum("longer" in t for t in texts)
    packing._forget()


def test_words_are_freed_once_the_table_of_ids_is_written():
    """Workers live on, so what one stage remembers would take memory in all later ones."""

    class Here:
        """Runs the function of a stage in this process."""

        def select(self, *columns):
            return self

        groupBy = agg = select

        def mapInArrow(self, run, kinds):
            ids = np.arange(3, dtype="<u2").tobytes()
            self.batches = list(run(iter([pa.RecordBatch.from_arrays([pa.array([ids])], names=["ids"])])))
            return self

        def collect(self):
            return self.batches[0].to_pylist()

    encode = packing.Encoder(tokenizer_path())
    ids = encode("words that stay").tolist()
    assert len(encode.known) and "hearthline_worker" in sys.modules
    assert packing._frequencies(Here())[:4].tolist() == [1, 1, 1, 0]
    assert "hearthline_worker" not in sys.modules
    again = packing.Encoder(tokenizer_path())
    assert again.known is not encode.known and again("words that stay").tolist() == ids


def test_packing_runs_agree_over_several_partitions(spark, monkeypatch):
    rng = random.Random(12)
    monkeypatch.setattr(packing, "SHARD", 4 * packing.WINDOW)
    hot = " ".join(rng.choice(WORDS) for _ in range(30))
    rows = [(i, (hot if i % 3 == 0 else "") + prose(rng, rng.randrange(1, 30))) for i in range(1500)]
    docs = frame(spark, rows)
    runs = [sorted(tuple(r) for r in packing.pack(d, tokenizer_path()).collect()) for d in (docs.repartition(3), docs.repartition(7))]
    assert runs[0] == runs[1]
    assert len({r[5] >> 40 for r in runs[0]}) >= 3


def test_spans_are_stored_once_and_counted_from_there(spark):
    """Every text is cut and hashed in one pass; counts and places come from its table."""
    rng = random.Random(21)
    shared = prose(rng, 6)
    rows = [(i, prose(rng, 4) + " " + (shared if i % 3 == 0 else "") + prose(rng, 3)) for i in range(60)]
    rows += [(70, None), (71, ""), (72, "short text"), (None, shared), (5, rows[5][1])]
    table = substrings._spans(frame(spark, rows)).cache()
    own = substrings.Spans()
    want = {}
    for doc, text in rows:
        value, at = own.of(text or "")
        if len(value):
            want.setdefault((doc is None, doc or 0), []).append((at.tolist(), value.view(np.int64).tolist()))
    found = {}
    for r in table.collect():
        found.setdefault((r["none"], r["doc"]), []).append((r["ats"], r["spans"]))
    assert found == want
    times = {}
    for lists in want.values():
        for _, spans in lists:
            for span in spans:
                times[span] = times.get(span, 0) + 1
    again = {span for span, n in times.items() if n > 1}
    assert again and {r["hash"] for r in substrings._again(table).collect()} == again
    bits = substrings.bloom.build(substrings._again(table)).get(0)
    placed = [(r["none"], r["doc"], r["at"], r["span"]) for r in substrings._places(table, bits).collect()]
    every = [(*key, a, s) for key, lists in want.items() for at, spans in lists for a, s in zip(at, spans)]
    assert sorted(p for p in placed if p[3] in again) == sorted(e for e in every if e[3] in again)
    assert len(placed) < len(every)
    assert substrings._places(table, None).collect() == []


def test_neighbours_share_windows():
    """Pieces about the same rare tokens are packed together."""
    rng = np.random.default_rng(0)
    pieces = []
    for i in range(64):
        topic = 1000 + 50 * (i % 4)
        pieces.append((i, 0, 1000, np.concatenate([rng.integers(0, 40, 500), rng.integers(topic, topic + 50, 500)]).astype("<u2")))
    seen = np.zeros(packing.VOCABULARY + 2, np.int64)
    for _, _, _, ids in pieces:
        seen[np.unique(ids)] += 1
    seen[packing.VOCABULARY], seen[packing.VOCABULARY + 1] = 64, 64_000
    shard = packing.Shard(pieces, packing.Weights(seen))
    mixed = [len({p % 4 for p, _, _ in window}) for window in shard.sequences()]
    assert np.mean([m == 1 for m in mixed]) > 0.7


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")
def test_pipeline_stages(spark):
    import corpus_pipeline
    from hearthline.llm.common import stored, table

    docs = table(spark, FOLDER, "documents")
    columns, counts = docs.columns, [docs.count()]
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    for turn, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stored(stage(spark, docs, FOLDER), f"test{turn}")
        counts.append(docs.count())
        if turn < 4:
            assert docs.columns == columns, name
        if turn == 0:
            good = before.join(labels.filter("quality = 1"), "doc_id")
            assert docs.join(good.select("doc_id"), "doc_id").count() >= 0.99 * good.count()
        if turn == 1:
            rows = [(r["doc_id"], r["text"]) for r in before.select("doc_id", "text").collect()]
            expected = sorted(d for d, n, c in linked(rows, 5, 80) if d == c)
            assert sorted(r["doc_id"] for r in docs.select("doc_id").collect()) == expected
        if turn == 2:
            assert docs.filter(F.col("text").rlike(r"AKIA[A-Z0-9]{16}")).join(before, ["doc_id", "text"]).count() == 0
    assert counts[0] > counts[1] > counts[2] == counts[3] and counts[5] > 0
    assert docs.agg(F.sum("length")).first()[0] > 0
