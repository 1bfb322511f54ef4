"""Quality by nearest-neighbour voting in a latent semantic space.

A bounded sample of the labelled documents fixes the space: a truncated singular
value decomposition of their weighted counts. Their vectors (at most
``max_labelled`` times ``DIMENSIONS`` numbers, whatever the corpus) go to all
tasks; every document is projected, compared with all of them in blocks of exact
cosine products, and scored by the votes of its nearest neighbours, weighted by
similarity.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import prepare, remainder, texts, unit_rows
from hearthline.llm.features import QUALITY_SIZE, quality_blocks, quality_counts

#: Labelled documents that are learned from, per label; a documented bound.
MAX_PER_LABEL = 1024
DIMENSIONS = 48
NEIGHBOURS = 15
#: Votes weigh as this power of the similarity.
SHARPNESS = 8
ACCEPT = 0.7
#: Examples whose counts the driver unpacks at a time.
UNPACKED = 128


def _label_rows(labels: DataFrame) -> DataFrame:
    """One label per document; where labels disagree the lower one counts."""
    return (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
        .groupBy("doc_id")
        .agg(F.min("quality").cast("int").alias("label"))
    )


def _counted(docs: DataFrame) -> DataFrame:
    """(doc_id, label, counts) of a bounded set of documents; counts are packed, being mostly zeros."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = [_packed(quality_counts(t)) for t in texts(part.column(2))]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(rows, pa.binary())],
                names=["doc_id", "label", "counts"],
            )

    return docs.select("doc_id", "label", "text").mapInArrow(
        count, "doc_id long, label int, counts binary"
    )


def _packed(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.astype(np.float32).tobytes(), 1)


def _examples(found: list) -> tuple[np.ndarray, np.ndarray]:
    """(blocks, labels) of the examples, ordered by label, id and counts; they are unpacked a few at a time."""
    ordered = []
    for _, same in groupby(sorted(found, key=lambda r: (r["label"], r["doc_id"])), lambda r: (r["label"], r["doc_id"])):
        rows = list(same)
        ordered += rows if len(rows) == 1 else sorted(rows, key=lambda r: zlib.decompress(r["counts"]))
    blocks = np.empty((len(ordered), QUALITY_SIZE))
    for at in range(0, len(ordered), UNPACKED):
        some = [np.frombuffer(zlib.decompress(r["counts"]), np.float32) for r in ordered[at : at + UNPACKED]]
        blocks[at : at + UNPACKED] = quality_blocks(np.stack(some).astype(float))
    return blocks, np.array([r["label"] for r in ordered])


@dataclass
class Model:
    """The latent space, the labelled vectors in it with the weight of their votes, and the base rate."""

    rarity: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weight: np.ndarray
    base: float

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Weighted share of the votes for label 1; the base rate where nothing is similar."""
        vectors = project(counts, self.rarity, self.basis)
        near = vectors @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        similarity = np.clip(np.take_along_axis(near, best, axis=1), 0, 1)
        votes = similarity**SHARPNESS * self.weight[best]
        total = votes.sum(axis=1)
        ones = (votes * self.labels[best]).sum(axis=1)
        return np.where(total > 0, ones / np.where(total > 0, total, 1), self.base)


def project(counts: np.ndarray, rarity: np.ndarray, basis: np.ndarray) -> np.ndarray:
    return unit_rows((quality_blocks(counts) * rarity) @ basis)


def fit(blocks: np.ndarray, labels: np.ndarray, shares: dict[int, float]) -> Model:
    """The model of labelled blocks; ``shares`` are those of the labels among all labelled documents.

    ``blocks`` is weighed in place: the driver holds one matrix of the examples, not several.
    """
    seen = (blocks > 0).sum(axis=0)
    rarity = np.log((1 + len(blocks)) / (1 + seen)) + 1
    blocks *= rarity
    weighed = blocks
    # Subspace iteration; the start is fixed so that reruns agree.
    width = min(DIMENSIONS, *weighed.shape)
    basis = np.random.default_rng(7).standard_normal((weighed.shape[1], width))
    for _ in range(6):
        basis, _ = np.linalg.qr(weighed.T @ (weighed @ basis))
    weight = {k: shares[k] / max((labels == k).sum(), 1) for k in shares}
    return Model(
        rarity,
        basis,
        unit_rows(weighed @ basis),
        labels,
        np.array([weight[k] for k in labels]),
        shares.get(1, 0.0),
    )


def train(docs: DataFrame, labels: DataFrame, may_learn: Column) -> Model | None:
    """Fit on at most ``MAX_PER_LABEL`` labelled documents of each label; None without any.

    ``may_learn`` is a condition on ``doc_id``. The documents with the smallest
    hashes of their ids are taken, so reruns agree.
    """
    rows = _label_rows(labels).filter(may_learn)
    totals = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not totals:
        return None
    order = F.xxhash64("doc_id")
    chosen = None
    for label in sorted(totals):
        part = rows.filter(F.col("label") == label).orderBy(order, "doc_id").limit(MAX_PER_LABEL)
        chosen = part if chosen is None else chosen.unionByName(part)
    # A repeated document id may bring several texts; each is an example.
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    found = _counted(picked.orderBy(order, "doc_id", "text").limit(2 * MAX_PER_LABEL)).collect()
    if not found:
        return None
    total = sum(totals.values())
    return fit(*_examples(found), {k: n / total for k, n in totals.items()})


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``score`` added; 0.5 throughout without a model.

    Null and empty texts have no similar neighbours and get the base rate of
    label 1. All rows and columns stay; only ``text`` is looked at.
    """
    spark = prepare(docs.sparkSession)
    if model is None:
        return docs.withColumn("score", F.lit(0.5))
    # Plain arrays: a broadcast object would need its class on the executors' path.
    shared = spark.sparkContext.broadcast(vars(model))
    schema = docs.select("*", F.lit(0.5).alias("score")).schema

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(**shared.value)
        for part in parts:
            if part.num_rows:
                counts = np.stack([quality_counts(t) for t in texts(part.column("text"))])
                scores = known.score(counts)
            else:
                scores = np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(scores, pa.float64())], names=[*part.schema.names, "score"]
            )

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, may_learn: Column) -> DataFrame:
    """(doc_id, score) of every document."""
    model = train(docs, labels, may_learn)
    return score(docs.select("doc_id", "text"), model).drop("text")


def not_held_out() -> Column:
    """Rows that may be learned from."""
    return remainder(F.col("doc_id"), 4) != 2


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score reaches ``ACCEPT``, columns unchanged."""
    model = train(docs, labels, not_held_out())
    kept = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return score(kept, model).filter(F.col("score") >= ACCEPT).select("row.*")
