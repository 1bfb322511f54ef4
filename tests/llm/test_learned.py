"""Quality and language: accuracy on rows that were not learned from, and edge rows."""

import os
import subprocess
import sys
import tracemalloc
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthline.llm import language, quality
from hearthline.llm.features import letter_counts, letter_vectors, quality_blocks, quality_counts
from hearthline.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"
here = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


@here
def test_quality_on_held_out_rows(spark):
    found = QUERIES["op8_quality"](spark, FOLDER)
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = found.filter("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 50
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["predicted"] == 1 for r in rows if r["quality"] == 1)


def test_quality_edges(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1, None), (None, 1)], "doc_id long, quality int")
    rows = [(i, "calm words in a row of prose. " * 9 if i % 2 else "BUY!!! $$$ " * 30) for i in range(40)]
    rows += [(100, None), (101, ""), (None, "calm words"), (3, rows[3][1]), (102, "prose " * 100_000)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double")
    found = quality.classify(docs, labels, F.lit(True)).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
    assert {round(r["score"]) for r in found if r["doc_id"] is not None and r["doc_id"] % 2 and r["doc_id"] < 40} == {1}
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns
    none = quality.classify(docs, labels.limit(0), F.lit(True))
    assert {r["score"] for r in none.collect()} == {0.5}
    assert quality.classify(docs.limit(0), labels, F.lit(True)).collect() == []


@here
def test_language_on_held_out_rows(spark):
    found = QUERIES["op10_language"](spark, FOLDER)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    rows = found.filter("held_out").join(docs, "doc_id").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.97 * len(rows) > 100


def test_language_edges(spark):
    texts = {"en": "the weather and the thing that they will have ", "de": "das wetter und die sache die nicht schön ist ",
             "fr": "le temps est beau et les choses que nous avons ", "es": "el tiempo es bueno y las cosas que tenemos ", "xx": "qq zz qz zq "}
    rows = [(i, text * (1 + i % 3), code) for code, text in texts.items() for i in range(12)]
    odd = [(900, None, "en"), (901, "", None), (902, "12 34 !!", "de"), (903, "the thing " * 50_000, None), (None, "the thing", "en")]
    docs = spark.createDataFrame([(*r, "e") for r in rows + odd], "doc_id long, text string, lang string, lang_pred string")
    found = language.identify(docs, language.train(docs, F.lit(True))).collect()
    assert len(found) == len(rows) + len(odd)
    by = {r["doc_id"]: r for r in found}
    assert [by[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and by[903]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 and r["lang_pred"] in (*texts, "und") for r in found)
    assert language.train(docs.limit(0), F.lit(True)) is None
    assert {r["lang_pred"] for r in language.identify(docs, None).collect()} == {"und"}


def test_quality_votes_against_all_cosines(spark):
    """Scores as loops over all labelled vectors give them."""
    random = np.random.default_rng(4)
    good, bad = "calm river stone garden letter morning".split(), "WIN $$$ !!! 000 CLICK buy".split()
    text = lambda words: " ".join(random.choice(words, 40))
    rows = [(i, text(good if i % 3 else bad)) for i in range(120)] + [(500, None), (501, text(good + bad))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)], "doc_id long, quality int")
    model = quality.train(docs, labels, F.col("doc_id") % 5 != 0)
    learned = [i for i in range(60) if i % 5]
    assert sorted(model.labels.tolist()) == sorted(int(i % 3 > 0) for i in learned)
    share = sum(i % 3 > 0 for i in learned) / len(learned)
    counts = {i: quality_counts(t or "") for i, t in rows}
    vector = lambda c: (quality_blocks(c[None]) * model.rarity @ model.basis)[0]
    known = [(vector(counts[i]), int(i % 3 > 0)) for i in learned]
    of = {label: sum(k == label for _, k in known) for label in (0, 1)}
    found = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    for i, c in counts.items():
        v, cosines = vector(c), []
        for w, label in known:
            size = np.sqrt(v @ v) * np.sqrt(w @ w)
            cosines.append((float(v @ w / size) if size else 0.0, label))
        near = sorted(cosines, reverse=True)[: quality.NEIGHBOURS]
        votes = [(max(s, 0.0) ** quality.SHARPNESS * (share if k else 1 - share) / of[k], k) for s, k in near]
        total = sum(v for v, _ in votes)
        assert found[i] == pytest.approx(sum(v for v, k in votes if k) / total if total else share, abs=1e-9)


def test_language_votes_recomputed(spark):
    """Examples, family and language as loops over pairs of classes give them."""
    random = np.random.default_rng(5)
    stems = {"en": "the thing weather", "de": "die sache wetter", "sv": "den saken vädret", "fr": "les choses temps", "qq": "zyx wvu"}
    rows = []
    for code, words in stems.items():
        rows += [(len(rows) + i, " ".join(random.choice(words.split(), 9)), code) for i in range(40)]
    rows += [(0, "the copy of an id", "en"), (None, "the", "en"), (900, "", "en"), (901, "les", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    chosen = language.examples(docs, F.lit(True)).collect()
    texts = {(r["lang"], r["doc_id"]): r["text"] for r in chosen}
    assert len(texts) == len(chosen) == 200 and texts["en", 0] == min(rows[0][1], "the copy of an id")
    model = language.train(docs, F.lit(True))

    def vote(machines, x):
        support = {a: {} for a in machines.names}
        for (a, b), w in zip(combinations(machines.names, 2), machines.weights):
            p = 1 / (1 + np.exp(-4 * (float(x @ w[:-1]) + w[-1])))
            support[a][b], support[b][a] = p, 1 - p
        mean = {a: sum(s.values()) / max(len(s), 1) if s else 1.0 for a, s in support.items()}
        wins = {a: sum(p >= 0.5 if a < b else p > 0.5 for b, p in s.items()) for a, s in support.items()}
        best = max(machines.names, key=lambda a: wins[a] + mean[a] / 2)
        return best, mean[best]

    found = {(r["doc_id"], i): r for i, r in enumerate(language.identify(docs.filter("doc_id > 0"), model).collect())}
    for (doc, _), r in found.items():
        text = next(t for i, t, _ in rows if i == doc)
        if not text:
            assert r["lang_pred"] == "und"
            continue
        x = letter_vectors(letter_counts(text)[None])[0]
        family, sure = vote(model.family, x)
        code, certain = vote(model.within[family], x)
        assert r["lang_pred"] == code and r["score"] == pytest.approx(sure * certain, abs=1e-9)


def test_examples_are_the_smallest_hashes_of_every_language(spark, monkeypatch):
    monkeypatch.setattr(language, "MAX_EXAMPLES", 40)
    rows = [(i, f"text {i}", "en" if i % 50 else "de") for i in range(3000)] + [(1, "text 1", "en")] * 2000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("at", F.xxhash64("doc_id"))
    known = {r["doc_id"]: (r["at"], r["lang"]) for r in docs.collect()}
    got = language.examples(docs, F.lit(True)).collect()
    for code in ("en", "de"):
        expected = sorted((at, i) for i, (at, lang) in known.items() if lang == code)[:20]
        assert sorted(r["doc_id"] for r in got if r["lang"] == code) == sorted(i for _, i in expected)
    with pytest.raises(ValueError, match="languages"):
        language.examples(docs, F.lit(True), max_languages=1)


WITHOUT_LIBRARY = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from hearthline.llm import language, packing, quality
from hearthline.llm.queries import tokenizer_path
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()

def workers(parts):
    import importlib.util
    for part in parts:
        assert importlib.util.find_spec("hearthline") is None
        yield part

rows = [(i, "the calm weather " * 9 if i % 2 else "die SACHE !!! " * 9, "en" if i % 2 else "de") for i in range(30)]
docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
assert docs.mapInArrow(workers, docs.schema).count() == 30
assert quality.classify(docs, labels, F.lit(True)).count() == 30
found = language.identify(docs, language.train(docs, F.lit(True))).collect()
assert all(r["lang_pred"] == ("en" if r["doc_id"] % 2 else "de") for r in found)
assert packing.pack(docs, tokenizer_path()).count() >= 30
"""


def test_executors_need_not_have_the_library(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = tmp_path / "run.py"
    script.write_text(WITHOUT_LIBRARY.format(root=root))
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, timeout=240)
    assert done.returncode == 0, done.stderr.decode()[-2000:]


def test_examples_are_unpacked_a_few_at_a_time():
    """The driver holds one matrix of the examples, not a row of copies; the model is that of all at once."""
    random = np.random.default_rng(1)
    counts = random.poisson(0.2, (2000, quality.QUALITY_SIZE)).astype(np.float32)
    found = [{"label": i % 2, "doc_id": i // 2 // 2, "counts": quality._packed(c)} for i, c in enumerate(counts)]
    order = sorted(range(2000), key=lambda i: (found[i]["label"], found[i]["doc_id"], counts[i].tobytes()))
    want = quality_blocks(counts[order].astype(float))
    size = want.nbytes
    del want
    tracemalloc.start()
    blocks, labels = quality._examples(found)
    model = quality.fit(blocks, labels, {0: 0.5, 1: 0.5})
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * size
    want = quality_blocks(counts[order].astype(float))
    assert labels.tolist() == [i % 2 for i in order]
    assert np.array_equal(blocks, want * model.rarity)
    assert np.allclose(model.vectors, quality.project(counts[order].astype(float), model.rarity, model.basis))
