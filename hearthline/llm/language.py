"""Language identification: the family first, then one against one within it.

Linear support vector machines on hashed letter pairs and triples. One set of
one-versus-one machines tells families apart, another the languages of each
family; the votes of the machines decide, margins break ties.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline.llm.common import prepare, remainder, texts
from hearthline.llm.features import has_letter, letter_counts, letter_vectors

#: Documents that are learned from, in all; shared evenly between the languages.
MAX_EXAMPLES = 2048
#: Languages that can be learned; each further one is as many more machines.
MAX_LANGUAGES = 128
#: Passes over the examples of one machine and its regularisation.
EPOCHS, REGULAR = 12, 1e-4
UNDEFINED = "und"

# Families of languages by their codes; any other code is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "bg", "mk", "sr", "hr", "bs", "sl", "cs", "sk", "pl"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "ky"),
    "indo-aryan": ("hi", "ur", "bn", "mr", "ne", "pa", "gu"),
    "semitic": ("ar", "he", "mt"),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}


def _machine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (bias last) of a linear support vector machine; y is +1 or -1.

    Dual coordinate descent for the squared hinge loss, examples weighted so
    that both sides count alike.
    """
    x = np.hstack([x, np.ones((len(x), 1))])
    side = np.where(y > 0, (y > 0).sum(), (y < 0).sum())
    slack = REGULAR * len(y) * side / (len(y) / 2)
    norms = (x * x).sum(axis=1) + slack
    w, a = np.zeros(x.shape[1]), np.zeros(len(y))
    order = np.random.default_rng(11)
    for _ in range(EPOCHS):
        for i in order.permutation(len(y)):
            step = a[i] - (y[i] * (w @ x[i]) - 1 + slack[i] * a[i]) / norms[i]
            step = max(step, 0.0)
            w += (step - a[i]) * y[i] * x[i]
            a[i] = step
    return w


@dataclass
class OneVersusOne:
    """Votes of the machines of all pairs of classes; ``weights`` has a row per pair of ``names``."""

    names: list[str]
    weights: np.ndarray

    @property
    def pairs(self) -> list[tuple[int, int]]:
        return list(combinations(range(len(self.names)), 2))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the winning class and its confidence (0 to 1) per row."""
        n = len(x)
        if len(self.names) < 2:
            return np.zeros(n, int), np.ones(n)
        sure = 1 / (1 + np.exp(-4 * (x @ self.weights[:, :-1].T + self.weights[:, -1])))
        votes, support = np.zeros((n, len(self.names))), np.zeros((n, len(self.names)))
        for k, (i, j) in enumerate(self.pairs):
            votes[:, i] += sure[:, k] >= 0.5
            votes[:, j] += sure[:, k] < 0.5
            support[:, i] += sure[:, k]
            support[:, j] += 1 - sure[:, k]
        support /= len(self.names) - 1
        best = (votes + support / 2).argmax(axis=1)
        return best, support[np.arange(n), best]


def one_versus_one(x: np.ndarray, classes: list[str]) -> OneVersusOne:
    """The machines of all pairs of the classes of the rows of ``x``."""
    names, label = sorted(set(classes)), np.array(classes)
    rows = []
    for one, other in combinations(names, 2):
        own = (label == one) | (label == other)
        rows.append(_machine(x[own], np.where(label[own] == one, 1.0, -1.0)))
    return OneVersusOne(names, np.array(rows).reshape(len(rows), x.shape[1] + 1))


@dataclass
class Model:
    """The machines between families, and those within each family."""

    family: OneVersusOne
    within: dict[str, OneVersusOne]

    def plain(self) -> tuple:
        """Lists and arrays only: a broadcast object would need its class on the executors' path."""
        return vars(self.family), {name: vars(inner) for name, inner in self.within.items()}

    @classmethod
    def restored(cls, family: dict, within: dict[str, dict]) -> Model:
        return cls(OneVersusOne(**family), {k: OneVersusOne(**v) for k, v in within.items()})

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        family, sure = self.family.predict(x)
        names, scores = [""] * len(x), np.zeros(len(x))
        for k, name in enumerate(self.family.names):
            rows = np.flatnonzero(family == k)
            if len(rows):
                inner = self.within[name]
                best, certain = inner.predict(x[rows])
                for row, b in zip(rows, best):
                    names[row] = inner.names[b]
                scores[rows] = sure[rows] * certain
        return names, scores


def fit(x: np.ndarray, langs: list[str]) -> Model:
    families = [FAMILY_OF.get(code, code) for code in langs]
    family = one_versus_one(x, families)
    within = {}
    for name in family.names:
        own = np.array([f == name for f in families])
        within[name] = one_versus_one(x[own], [c for c, f in zip(langs, own) if f])
    return Model(family, within)


def examples(docs: DataFrame, may_learn: Column, max_languages: int = MAX_LANGUAGES) -> DataFrame:
    """(lang, doc_id, text) that are learned from: ``MAX_EXAMPLES`` shared evenly, 16 a language at least.

    Of each language the ids with the smallest hashes are taken. Rows of one id
    and language are one example, the one with the smallest text. Rows without
    an id, a language or a text are none. More than ``max_languages`` languages
    are an error: none of them is left out.
    """
    usable = docs.select("doc_id", "lang", "text").filter(
        may_learn & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (F.length("text") > 0)
    )
    known = (
        usable.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).limit(max_languages + 1).collect()
    )
    if len(known) > max_languages:
        raise ValueError(f"more than {max_languages} languages: clean the column or raise max_languages")
    each = max(MAX_EXAMPLES // max(len(known), 1), 16)
    # Where a language has very many ids, only the range of hashes that holds the
    # smallest ones reaches the ordering: four times what is needed.
    shares = docs.sparkSession.createDataFrame(
        [(r["lang"], 4.0 * each / r["n"] if r["n"] > 4 * each else 1.0) for r in known], "lang string, share double"
    )
    place = (F.xxhash64("doc_id").cast("double") + 2.0**63) / 2.0**64
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = (
        usable.select("lang", "doc_id")
        .join(F.broadcast(shares), "lang")
        .filter(place <= F.col("share"))
        .select("lang", "doc_id")
        .distinct()
        .withColumn("turn", F.row_number().over(order))
        .filter(F.col("turn") <= each)
        .select("lang", "doc_id")
    )
    return usable.join(F.broadcast(ids), ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))


def train(docs: DataFrame, may_learn: Column) -> Model | None:
    """Fit on the bounded :func:`examples`; None without any."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = [letter_counts(t).astype(np.float32).tobytes() for t in texts(part.column(2))]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(rows, pa.binary())],
                names=["lang", "doc_id", "counts"],
            )

    counted = examples(docs, may_learn).mapInArrow(count, "lang string, doc_id long, counts binary")
    found = sorted(counted.collect(), key=lambda r: (r["lang"], r["doc_id"]))
    if not found:
        return None
    x = letter_vectors(np.stack([np.frombuffer(r["counts"], np.float32) for r in found]).astype(float))
    return fit(x, [r["lang"] for r in found])


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every row; ``und`` and 0.0 for texts without a letter.

    Without a model everything is ``und``. The whole text counts, however long.
    """
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model.plain() if model else None)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model.restored(*shared.value) if shared.value else None
        for part in parts:
            langs = [UNDEFINED] * part.num_rows
            scores = np.zeros(part.num_rows)
            rows, counts = [], []
            for i, text in enumerate(texts(part.column(1))):
                if known is not None and has_letter(text):
                    rows.append(i)
                    counts.append(letter_counts(text))
            if rows:
                names, sure = known.predict(letter_vectors(np.stack(counts)))
                scores[rows] = sure
                for row, name in zip(rows, names):
                    langs[row] = name
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, lang_pred string, score double"
    )


def not_held_out() -> Column:
    """Rows that may be learned from."""
    return remainder(F.col("doc_id"), 3) != 1


def predicted(docs: DataFrame) -> DataFrame:
    return identify(docs, train(docs, not_held_out()))
