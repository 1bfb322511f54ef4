"""The registered queries of this package and their SQL."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.llm import (
    jaccard,
    language,
    mixing,
    neardup,
    packing,
    periodic,
    pii,
    quality,
    substrings,
    suffixes,
    topk,
    variants,
    warc,
)
from hearthline.llm.common import remainder, table


#: Key of the registered query; a real run passes its own secret.
PII_KEY = "public-demonstration-key"


def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.replace(table(spark, folder, "documents"), PII_KEY)
    return found.select("doc_id", "text", "pii_hits")


def op2_neardup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "embeddings"))


def op3_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_substrings(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.deduplicate(table(spark, folder, "documents"))


def op5_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.join(table(spark, folder, "documents")).drop("text_hash")


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.taken(table(spark, folder, "documents"))


def tokenizer_path() -> str:
    """The vocabulary file of the registered query, among the installed public ones."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), tokenizer_path())


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return quality.classify(docs, labels, quality.not_held_out()).select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= quality.ACCEPT).cast("int").alias("predicted"),
    )


def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archived(table(spark, folder, "pages"))


def op10_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.predicted(table(spark, folder, "documents")).select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"),
        "lang_pred",
        "score",
    )


def with_period(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of one document in ten with a periodic end, by the crc32 of its id."""
    if doc_id is None or not words:
        return words
    digest = zlib.crc32(b"%d" % doc_id)
    if digest % 10:
        return words
    g, n = digest // 10, len(words)
    start = g % n
    period = 1 + (n - start) // (3 + g % 8)
    root = words[start : start + period]
    return words[:start] + (root * ((n - start) // period + 1))[: n - start]


def op11_periodic(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic.collapse(table(spark, folder, "documents"), with_period)

    def greater(best: Column, run: Column) -> Column:
        return F.when(run["length"] * best["period"] > best["length"] * run["period"], run).otherwise(best)

    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    # Runs come by start, then period, so the first of equal ones stays.
    best = F.aggregate("runs", F.get("runs", F.lit(0)), greater)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.call_function("div", 1000 * best["length"], best["period"]).alias("exponent_milli"),
        F.sha2(F.concat_ws("", line), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_variants(spark: SparkSession, folder: str) -> DataFrame:
    return variants.group(table(spark, folder, "documents"), variants.DAMAGED)


def op13_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    found = suffixes.deduplicate(table(spark, folder, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["length"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_neardup": op2_neardup,
    "op3_topk": op3_topk,
    "op4_substrings": op4_substrings,
    "op5_jaccard": op5_jaccard,
    "op6_mixing": op6_mixing,
    "op7_packing": op7_packing,
    "op8_quality": op8_quality,
    "op9_warc": op9_warc,
    "op10_language": op10_language,
    "op11_periodic": op11_periodic,
    "op12_variants": op12_variants,
    "op13_suffixes": op13_suffixes,
}

SQL: dict[str, str] = {
    "op3_topk": """
WITH u AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.x, d.x) AS BIGINT) AS score
  FROM u q JOIN u d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op5_jaccard": """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s
  FROM w
), t AS (
  SELECT doc_id, unnest(s) AS t FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM t a JOIN t b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b
  WHERE 100 * n >= 85 * (len(x.s) + len(y.s) - n)
), r AS (
  SELECT doc_id AS node, doc_id AS root FROM s
  UNION
  SELECT b, root FROM r JOIN e ON a = node WHERE root < b
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(root) AS component_id
FROM s JOIN r ON node = s.doc_id GROUP BY s.doc_id, len(s.s)
""",
    "op9_warc": """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d
  FROM pages
), f AS (
  SELECT d AS fd, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f ON d = fd
""",
}
