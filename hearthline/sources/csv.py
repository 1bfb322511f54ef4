"""Tolerant CSV loading of the registry's source files."""

from __future__ import annotations

import re
from csv import reader
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from hearthline.functions.textrepair import redecode, repair_frame
from hearthline.operators.dedup import keep_one, keep_one_keep_null
from hearthline.schema import (
    BENEFICIARY_TYPES,
    GENDER_SYNONYMS,
    HOUSEHOLD_TEXT,
    HOUSEHOLD_TYPES,
    MAX_SCORE,
    MISSING_WORDS,
    PROGRAMME_TYPES,
    SCORE_TYPES,
    struct_of,
)
from hearthline.functions.columns import lookup

LINE, REJECTED = "_line", "_rejected"
# The field beyond the last makes every regular line one field short, so that the
# reader hands out the raw line as well.
_OVERFLOW, _RAW = "_overflow", "_raw"


def file_position() -> Column:
    """Place of a row in its source files: path, block, row within the block."""
    return F.struct(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def decode_bytes(text: Column) -> Column:
    """A value read byte by byte: as UTF-8 where it is that, else as windows-1252."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, text).otherwise(redecode(text))


def present(text: Column) -> Column:
    """The value, or null where it is one of the words for a missing one."""
    return F.when(~F.trim(text).isin(*MISSING_WORDS), text)


def _transition(line: Column, sep: str, inside: bool) -> Column:
    """What a line does to the quoting it begins with: (open, separators).

    A quote opens a field only where the field begins; within, a doubled one
    stands for itself and a single one closes; elsewhere it is a character. The
    automaton walks over the pieces between quotes, not over characters.
    """
    at_start, plain, quoted, closing = 0, 1, 2, 3
    first = F.struct(F.lit(quoted if inside else at_start).alias("state"), F.lit(0).alias("seps"), F.lit(True).alias("first"))

    def walk(acc: Column, piece: Column) -> Column:
        state = acc["state"]
        # The quote before this piece; there is none before the first one.
        after = (
            F.when(acc["first"], state)
            .when(state == at_start, F.lit(quoted))
            .when(state == quoted, F.lit(closing))
            .when(state == closing, F.lit(quoted))
            .otherwise(state)
        )
        found = F.when(after == quoted, F.lit(0)).otherwise(
            F.length(piece) - F.length(F.replace(piece, F.lit(sep), F.lit("")))
        ) / F.lit(len(sep))
        ended = F.when((after == quoted) | (piece == ""), after).when(piece.endswith(sep), F.lit(at_start)).otherwise(F.lit(plain))
        return F.struct(
            ended.alias("state"), (acc["seps"] + found.cast("int")).alias("seps"), F.lit(False).alias("first")
        )

    return F.aggregate(
        F.split(line, '"'), first, walk, lambda acc: F.struct((acc["state"] == quoted).alias("open"), acc["seps"].alias("seps"))
    )


def left_open(line: Column, sep: str, inside: bool = False) -> Column:
    """Whether a quoted field is open behind the line; lines without a quote change nothing."""
    return F.when(F.contains(line, F.lit('"')), _transition(line, sep, inside)["open"]).otherwise(F.lit(inside))


def _header_names(raw: bytes, sep: str) -> tuple[str, ...]:
    """Column names of a header line; repeated and empty names are numbered."""
    raw = raw.removeprefix(b"\xef\xbb\xbf").rstrip(b"\r\n")
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        text = raw.decode("cp1252", errors="replace")
    names: list[str] = []
    for i, name in enumerate(next(reader([text], delimiter=sep), [])):
        name = name.strip() or f"Unnamed: {i}"
        again, n = name, 0
        while again in names:
            n += 1
            again = f"{name}.{n}"
        names.append(again)
    return tuple(names)


def discover(
    spark: SparkSession, path: str | list[str], sep: str = ",", multi_line: bool = False
) -> dict[tuple[tuple[str, ...], bool], list[str]]:
    """Files by their header and by whether any of their lines leaves a quote open.

    One job for any number of files: the first line that is not blank, of the
    block that begins its file, is its header. A header whose own quotes hold a
    line break is read by the CSV reader (with ``multi_line``; an error otherwise).
    """
    lines = spark.read.text(path)
    line = F.col("value")
    first = (F.col("_metadata.file_block_start") == 0) & (F.trim(line) != "")
    per_file = (
        lines.select(
            F.col("_metadata.file_path").alias("path"),
            F.when(first, F.struct(F.monotonically_increasing_id().alias("row"), line.cast("binary").alias("line"))).alias("head"),
            left_open(line, sep).alias("open"),
        )
        .groupBy("path")
        .agg(F.min_by("head.line", "head.row").alias("head"), F.bool_or("open").alias("open"))
    )
    found: dict[tuple[tuple[str, ...], bool], list[str]] = {}
    for row in sorted(per_file.collect(), key=lambda r: r["path"]):
        if row["head"] is None:
            continue
        head = bytes(row["head"])
        if head.count(b'"') % 2:
            if not multi_line:
                raise ValueError(f"The header line leaves a quote open: {row['path']}")
            options = {"header": True, "sep": sep, "escape": '"', "multiLine": True}
            names = tuple(n.strip() for n in spark.read.options(**options).csv(_literal_path(row["path"])).columns)
        else:
            names = _header_names(head, sep)
        found.setdefault((names, row["open"]), []).append(row["path"])
    return found


def _literal_path(path: str) -> str:
    """A path as reported by Spark, safe from being read as a pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(path))


def _quoted_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _lines(
    spark: SparkSession, files: list[str], header: tuple[str, ...], options: dict[str, object]
) -> DataFrame:
    """Rows of files with one header, every column as text, plus overflow and position."""
    schema = ", ".join(f"{_quoted_name(c)} string" for c in [*header, _OVERFLOW, _RAW])
    rows = spark.read.options(**options).csv([_literal_path(f) for f in files], schema=schema)
    return rows.select("*", file_position().alias(LINE))


def _started_inside(rows: DataFrame, sep: str) -> DataFrame:
    """``rows`` with ``_inside``: whether a quoted field was open before the line.

    A line maps each of the two states to one: it leaves them, swaps them, or ends
    in the same state from either. Such maps compose, so running sums of swaps since
    the last fixed state give the state within a block of a file, one row per block
    carries it on, and no file is read in one task. A quote that is never closed
    opens nothing: the lines behind it are read as they are.
    """
    # Spark refuses plans that read nothing but the raw line, so a field stands by.
    line = F.coalesce(_RAW, _quoted_name(rows.columns[0]))
    fresh, inside = left_open(line, sep), left_open(line, sep, True)
    block = [F.col(f"{LINE}.path"), F.col(f"{LINE}.block")]
    ordered = Window.partitionBy(*block).orderBy(F.col(f"{LINE}.row"))
    flagged = rows.withColumns({"_fresh": F.coalesce(fresh, F.lit(False)), "_held": F.coalesce(inside, F.lit(True))})
    swaps = F.sum(F.when(F.col("_fresh") & ~F.col("_held"), 1).otherwise(0)).over(ordered)
    summed = flagged.withColumn("_swaps", swaps)
    fixed = F.when(F.col("_fresh") == F.col("_held"), F.struct(F.col("_fresh").cast("int").alias("state"), F.col("_swaps").alias("swaps")))
    known = summed.withColumn("_fixed", F.last(fixed, ignorenulls=True).over(ordered))

    def state(before: Column) -> Column:
        """State behind the line, given that before its block."""
        return (F.coalesce(F.col("_fixed.state"), before) + F.col("_swaps") - F.coalesce(F.col("_fixed.swaps"), F.lit(0))) % 2

    last = known.groupBy(F.col(f"{LINE}.path").alias("_path"), F.col(f"{LINE}.block").alias("_block")).agg(
        F.max_by(F.struct("_fixed", "_swaps"), f"{LINE}.row").alias("_last")
    )
    files = Window.partitionBy("_path").orderBy("_block")
    blocks = last.select("_path", "_block", "_last.*").withColumn("_total", F.sum("_swaps").over(files))
    # Swaps since the last block that ends in a fixed state, and that state.
    ends = F.when(
        F.col("_fixed").isNotNull(),
        F.struct(((F.col("_fixed.state") + F.col("_swaps") - F.col("_fixed.swaps")) % 2).alias("state"), F.col("_total").alias("total")),
    )
    carried = blocks.withColumn("_carried", F.last(ends, ignorenulls=True).over(files)).withColumn(
        "_end", (F.coalesce(F.col("_carried.state"), F.lit(0)) + F.col("_total") - F.coalesce(F.col("_carried.total"), F.lit(0))) % 2
    )
    starts = carried.select("_path", "_block", F.lag("_end", 1, 0).over(files).alias("_start"))
    joined = known.join(starts, (block[0] == F.col("_path")) & (block[1] == F.col("_block")))
    stated = joined.withColumn("_after", state(F.col("_start")))
    # Behind the last line that ends closed, a file's open quote is never closed.
    place = F.struct(f"{LINE}.block", f"{LINE}.row")
    closed = (
        stated.groupBy(F.col(f"{LINE}.path").alias("_file"))
        .agg(F.max(F.when(F.col("_after") == 0, place)).alias("_closed"))
        .select("_file", "_closed")
    )
    before = F.coalesce(F.lag("_after").over(ordered), F.col("_start")) == 1
    marked = stated.withColumn("_inside", before).join(closed, F.col(f"{LINE}.path") == F.col("_file"))
    return marked.select(*rows.columns, (F.col("_inside") & F.coalesce(place <= F.col("_closed"), F.lit(False))).alias("_inside"))


def parse(
    spark: SparkSession,
    path: str | list[str],
    columns: list[str] | None = None,
    encoding: str | None = None,
    sep: str = ",",
    multi_line: bool = False,
) -> DataFrame:
    """All records of CSV files with header lines: columns as text, position, and ``REJECTED``.

    ``REJECTED`` is the raw text of a record that cannot be read and null for the
    others: one with too many fields, or (without ``multi_line``) a line that
    leaves a quoted field open or begins within one. With ``multi_line`` records
    keep their line breaks, and one whose quote is never closed is rejected with
    the lines that it took in. Only files of which some line leaves a quote open
    are looked through for this.
    """
    options = {
        "header": True, "encoding": encoding or "ISO-8859-1", "sep": sep, "escape": '"', "enforceSchema": True,
        "mode": "PERMISSIVE", "multiLine": multi_line, "columnNameOfCorruptRecord": _RAW, "columnPruning": False,
    }
    tables = []
    for (header, some_open), files in discover(spark, path, sep, multi_line).items():
        rows = _lines(spark, files, header, options)
        broken = F.col(_OVERFLOW).isNotNull()
        if some_open and not multi_line:
            rows = _started_inside(rows, sep)
            broken = broken | F.col("_inside")
        if some_open:
            broken = broken | F.coalesce(left_open(F.col(_RAW), sep), F.lit(False))
        decoded = {c: F.col(_quoted_name(c)) for c in header if columns is None or c in columns}
        line = F.coalesce(_RAW, F.concat_ws(sep, *[F.col(_quoted_name(c)) for c in (*header, _OVERFLOW)]))
        if encoding is None:
            decoded = {c: decode_bytes(v) for c, v in decoded.items()}
            line = decode_bytes(line)
        tables.append(
            rows.select(*[present(v).alias(c) for c, v in decoded.items()], LINE, F.when(broken, line).alias(REJECTED))
        )
    if not tables:
        raise ValueError(f"No header line found: {path}")
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), tables)


def kept_records(parsed: DataFrame) -> DataFrame:
    """The records of a parsed table that could be read."""
    return parsed.where(F.col(REJECTED).isNull()).drop(REJECTED)


def rejected_records(parsed: DataFrame) -> DataFrame:
    """(path, line) of those that could not."""
    return parsed.where(F.col(REJECTED).isNotNull()).select(F.col(LINE)["path"].alias("path"), F.col(REJECTED).alias("line"))


def read_text_table(
    spark: SparkSession,
    path: str | list[str],
    columns: list[str] | None = None,
    encoding: str | None = None,
    sep: str = ",",
    multi_line: bool = False,
) -> DataFrame:
    """CSV with header lines, every column as text, plus the row's file position.

    Each file is read by its own header; columns that only some files have are
    null for the others. Doubled quotes stand for one. Without ``encoding`` each
    value is decoded by itself, as UTF-8 or else windows-1252. Words for missing
    values become null. Short lines are padded with nulls; records that cannot be
    read are left out here and returned by :func:`rejected_lines`. Quoted line
    breaks need ``multi_line``; such files cannot be split, so it is off by default.
    """
    return kept_records(parse(spark, path, columns, encoding, sep, multi_line))


def rejected_lines(
    spark: SparkSession, path: str | list[str], sep: str = ",", multi_line: bool = False
) -> DataFrame:
    """(path, line) of the lines that :func:`read_text_table` leaves out."""
    return rejected_records(parse(spark, path, [], None, sep, multi_line))


def raw_row_count(spark: SparkSession, path: str) -> DataFrame:
    """Physical lines without one header line per file, as a one-row frame."""
    lines = spark.read.text(path).groupBy(F.col("_metadata.file_path")).agg(
        F.count("*").alias("n")
    )
    return lines.agg(F.coalesce(F.sum(F.greatest(F.col("n") - 1, F.lit(0))), F.lit(0)).alias("n"))


def coerce(value: Column, kind: str) -> Column:
    """Text to a typed value; what cannot be converted becomes null."""
    text = F.trim(value)
    if kind == "string":
        return value
    if kind == "double":
        return F.nanvl(text.try_cast("double"), F.lit(None).cast("double"))
    if kind == "long":
        number = text.try_cast("double")
        whole = F.when(number == F.floor(number), number.try_cast("bigint"))
        return F.coalesce(text.try_cast("bigint"), whole)
    if kind == "boolean":
        return text.try_cast("boolean")
    return parse_date(text)


def parse_date(text: Column) -> Column:
    """ISO dates and times, a stated zone applied (UTC); else month/day/year, else day/month/year.

    Slashes, dots and dashes separate; a time may follow.
    """
    zoned = text.rlike(r"[0-9]:[0-9]{2}.*(?:Z|[+-][0-9]{2}:?[0-9]{2})$")
    iso = F.when(zoned, text.try_cast("timestamp").cast("timestamp_ntz")).otherwise(
        text.try_cast("timestamp_ntz")
    )
    even = F.regexp_replace(text, r"^([0-9]{1,2})[-./]([0-9]{1,2})[-./]", "$1/$2/")
    other = [
        F.try_to_timestamp(even, F.lit(f"{order}/yyyy{time}")).cast("timestamp_ntz")
        for order in ("M/d", "d/M")
        for time in ("", " H:mm", " H:mm:ss")
    ]
    slashed = F.when(text.rlike(r"^[0-9]{1,2}[-./][0-9]{1,2}[-./][0-9]{4}"), F.coalesce(*other))
    return F.coalesce(iso, slashed)


def coerce_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Convert the columns that are present; others are left as they are."""
    return df.withColumns(
        {c: coerce(F.col(f"`{c}`"), t) for c, t in types.items() if c in df.columns}
    )


def load_csv(
    spark: SparkSession,
    path: str | list[str],
    types: dict[str, str],
    columns: list[str] | None = None,
    encoding: str | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """Read, repair and convert one source; a missing column of ``columns`` is null."""
    return typed(read_text_table(spark, path, columns, encoding, multi_line=multi_line), types)


def typed(table: DataFrame, types: dict[str, str]) -> DataFrame:
    """Repair and convert a text table; only columns that stay text are looked through for damage."""
    texts = [c for c in table.columns if types.get(c, "string") == "string" and c != LINE]
    return coerce_types(repair_frame(table, among=texts), types)


def capitalised(text: Column) -> Column:
    """Trimmed text, first letter upper case and the rest lower case."""
    t = F.trim(text)
    return F.concat(F.upper(F.left(t, F.lit(1))), F.lower(F.substr(t, F.lit(2))))


def clean_households(df: DataFrame, order: Column) -> DataFrame:
    """Normalise area and gender, keep the first row per household id."""
    out = repair_frame(df, columns=[c for c in HOUSEHOLD_TEXT if c in df.columns])
    if "milieu" in out.columns:
        out = out.withColumn("milieu", capitalised(F.col("milieu")))
    if "genre_cm" in out.columns:
        out = out.withColumn("genre_cm", lookup(capitalised(F.col("genre_cm")), GENDER_SYNONYMS))
    return keep_one(out, ["menage_ano"], [order.asc()]) if "menage_ano" in out.columns else out


def load_households(
    spark: SparkSession, path: str | list[str], multi_line: bool = False
) -> DataFrame:
    """Household file: typed, repaired, normalised, first row per id."""
    return households_of(read_text_table(spark, path, multi_line=multi_line))


def households_of(table: DataFrame) -> DataFrame:
    """Households of a text table."""
    return clean_households(typed(table, HOUSEHOLD_TYPES), F.col(LINE)).drop(LINE)


def empty_households(spark: SparkSession) -> DataFrame:
    """Typed household frame without rows, for runs that have no household file."""
    return spark.createDataFrame([], struct_of(HOUSEHOLD_TYPES))


def final_score(df: DataFrame) -> DataFrame:
    """Trim the type and derive the final score and the correction flag."""
    fixed, computed = F.col("score_corrige"), F.col("score_calcule")
    return df.withColumns(
        {
            "type_demande": F.trim("type_demande"),
            "score_final": F.coalesce(fixed, computed),
            "was_corrected": fixed.isNotNull() & ~fixed.eqNullSafe(computed),
        }
    )


def score_postprocess(df: DataFrame, max_score: float | None = MAX_SCORE) -> DataFrame:
    """Final score, correction flag, and removal of outliers and missing scores."""
    out = final_score(df)
    return out if max_score is None else out.where(F.col("score_final") <= max_score)


def dedup_scores(df: DataFrame, order: Column) -> DataFrame:
    """First row per score id; without an id column, per five-column event."""
    if "score_id_ano" in df.columns:
        return keep_one_keep_null(df, "score_id_ano", [order.asc()])
    subset = ["menage_ano", "date_calcul", "type_demande", "score_corrige", "score_calcule"]
    return keep_one(df, [c for c in subset if c in df.columns], [order.asc()])


def load_raw_scores(
    spark: SparkSession, path: str | list[str], multi_line: bool = False
) -> DataFrame:
    """Score file as read, typed, with the final score; nothing removed."""
    return raw_scores_of(read_text_table(spark, path, list(SCORE_TYPES), multi_line=multi_line))


def raw_scores_of(table: DataFrame) -> DataFrame:
    """Scores of a text table, typed, with the final score."""
    return final_score(typed(table, SCORE_TYPES))


def scores_of(table: DataFrame, max_score: float | None = MAX_SCORE) -> DataFrame:
    """Clean scores of the text table of one source."""
    rows = score_postprocess(typed(table, SCORE_TYPES), max_score)
    return dedup_scores(rows, F.col(LINE)).drop(LINE)


def load_scores(
    spark: SparkSession,
    path: str | list[str],
    max_score: float | None = MAX_SCORE,
    multi_line: bool = False,
) -> DataFrame:
    """Score file: outliers are removed before duplicates, as a removed row must not win."""
    return scores_of(read_text_table(spark, path, list(SCORE_TYPES), multi_line=multi_line), max_score)


def keep_latest_scores(df: DataFrame) -> DataFrame:
    """Latest version per score id; a missing date counts as latest."""
    order = [F.col("date_calcul").desc_nulls_first(), F.col("score_final").desc()]
    rest = sorted(set(df.columns) - {"date_calcul", "score_final", "score_id_ano"})
    return keep_one_keep_null(df, "score_id_ano", [*order, *[F.col(c).asc() for c in rest]])


def merge_score_files(
    spark: SparkSession,
    paths: list[str],
    output: str,
    max_score: float | None = MAX_SCORE,
    multi_line: bool = False,
) -> DataFrame:
    """Union several score files, keep the latest version per id, write and read back."""
    parts = [load_scores(spark, p, max_score, multi_line) for p in paths]
    merged = keep_latest_scores(reduce(DataFrame.unionByName, parts))
    target = f"{output}/scores_merged.parquet"
    merged.write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def load_programme(
    spark: SparkSession, path: str | list[str], name: str, multi_line: bool = False
) -> DataFrame:
    """Membership list of one programme."""
    return programme_of(read_text_table(spark, path, multi_line=multi_line), name)


def programme_of(table: DataFrame, name: str) -> DataFrame:
    """Membership list of a text table."""
    rows = typed(table, {"menage_ano": "long"})
    return rows.select("menage_ano", F.lit(name.upper()).alias("programme"))


def union_programmes(parts: list[DataFrame]) -> DataFrame:
    """All membership lists together, each household once per programme."""
    return reduce(DataFrame.unionByName, parts).distinct()


def load_all_programmes(
    spark: SparkSession, paths: dict[str, str], multi_line: bool = False
) -> DataFrame:
    """Membership lists of several programmes; an empty typed frame without any."""
    if not paths:
        return spark.createDataFrame([], struct_of(PROGRAMME_TYPES))
    return union_programmes([load_programme(spark, p, n, multi_line) for n, p in paths.items()])


def load_programme_table(
    spark: SparkSession, path: str | list[str], multi_line: bool = False
) -> DataFrame:
    """Consolidated membership file with its own programme column."""
    return programme_table_of(read_text_table(spark, path, multi_line=multi_line))


def programme_table_of(table: DataFrame) -> DataFrame:
    """Memberships of a text table that names the programme."""
    rows = typed(table, PROGRAMME_TYPES)
    named = rows.select("menage_ano", F.upper(F.trim("programme")).alias("programme"))
    return named.where(F.col("programme").isNotNull()).distinct()


def load_beneficiaries(
    spark: SparkSession, path: str | list[str], multi_line: bool = False
) -> DataFrame:
    """Beneficiary status file, partner in upper case."""
    return beneficiaries_of(read_text_table(spark, path, multi_line=multi_line))


def beneficiaries_of(table: DataFrame) -> DataFrame:
    """Beneficiary records of a text table."""
    rows = typed(table, BENEFICIARY_TYPES).drop(LINE)
    if "partner_id" not in rows.columns:
        return rows
    return rows.withColumn("partner_id", F.upper("partner_id"))
