"""Repair of text that was decoded with the wrong character set."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

# --- fixed values: known damaged spellings and their correct form -----------
REPLACEMENTS = {
    "Rabat-SalÃ©-KÃ©nitra": "Rabat-Salé-Kénitra",
    "Tanger-TÃ©touan-Al HoceÃ¯ma": "Tanger-Tétouan-Al Hoceïma",
    "FÃ¨s-MeknÃ¨s": "Fès-Meknès",
    "BÃ©ni Mellal-KhÃ©nifra": "Béni Mellal-Khénifra",
    "DrÃ¢a-Tafilalet": "Drâa-Tafilalet",
    "LaÃ¢youne-Sakia El Hamra": "Laâyoune-Sakia El Hamra",
    "GuelmimOued Noun": "Guelmim-Oued Noun",
    "Rabat-Sal\x82-K\x82nitra": "Rabat-Salé-Kénitra",
    "F\x82s-Mekn\x8as": "Fès-Meknès",
    "Mari\x82(e)": "Marié(e)",
    "MariÃ©(e)": "Marié(e)",
    "CÃ©libataire": "Célibataire",
    "DivorÃ©(e)": "Divorcé(e)",
    "SÃ©parÃ©(e)": "Séparé(e)",
    "FÃ©minin": "Féminin",
    "Feminin": "Féminin",
    "DÃ©cÃ©dÃ©(e)": "Décédé(e)",
}
SUSPICIOUS = ("Ã", "â€", "Â", "\x80", "\x82", "\x83", "\x9c")
# --- end of fixed values ----------------------------------------------------

# Control characters U+0080..U+009F and what windows-1252 assigns to their bytes.
_C1 = [(chr(b), bytes([b]).decode("cp1252", errors="ignore")) for b in range(0x80, 0xA0)]
_C1_FROM = "".join(c for c, w in _C1 if w)
_C1_TO = "".join(w for _, w in _C1 if w)
_C1_UNASSIGNED = "[" + "".join(c for c, w in _C1 if not w) + "]"
_C1_ANY = "[\x80-\x9f]"


def looks_damaged(text: Column) -> Column:
    """Whether a value contains one of the suspicious marks, none of which is ASCII."""
    return ~_is_ascii(text) & text.rlike("|".join(map(_literal, SUSPICIOUS)))


def _is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def _replace_all(text: Column, mapping: dict[str, str]) -> Column:
    """All replacements in turn, tried only on text that contains any of the spellings."""
    if not mapping:
        return text
    chain = reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), mapping.items(), text)
    return F.when(text.rlike("|".join(map(_literal, mapping))), chain).otherwise(text)


def _literal(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def redecode(text: Column) -> Column:
    """Undo one wrong single-byte decoding.

    Text that fits in one byte per character is re-read as UTF-8, else as
    windows-1252; anything that fits neither is left alone.
    """
    single_byte = text.rlike("^[\\x00-\\xff]*$")
    as_utf8 = F.try_validate_utf8(F.encode(text, "ISO-8859-1").cast("string"))
    as_cp1252 = F.when(
        ~text.rlike(_C1_UNASSIGNED), F.translate(text, _C1_FROM, _C1_TO)
    )
    return F.when(single_byte, F.coalesce(as_utf8, as_cp1252, text)).otherwise(text)


def repair_text(text: Column, extra: dict[str, str] | None = None) -> Column:
    """Repair one text column; nulls stay null.

    Spellings written with control characters are replaced before re-decoding,
    because re-decoding would turn them into other characters. Plain ASCII text
    cannot be damaged and only meets the ASCII spellings of the map.
    """
    mapping = {**REPLACEMENTS, **(extra or {})}
    control = {bad: good for bad, good in mapping.items() if re.search(_C1_ANY, bad)}
    ascii_only = {bad: good for bad, good in mapping.items() if bad.isascii()}
    prepared = F.when(text.rlike(_C1_ANY), _replace_all(text, control)).otherwise(text)
    decoded = _bound(prepared, lambda p: _bound(redecode(p), lambda d: _replace_all(d, mapping)))
    return F.when(_is_ascii(text), _replace_all(text, ascii_only)).otherwise(decoded)


def text_columns(df: DataFrame) -> list[str]:
    """Names of the string columns."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def repair_frame(
    df: DataFrame,
    columns: list[str] | None = None,
    extra: dict[str, str] | None = None,
    among: list[str] | None = None,
) -> DataFrame:
    """Repair text columns of a frame, or those of ``among``.

    With ``columns`` given, those are repaired. Otherwise a column is repaired
    when any of its values looks damaged; the check is one aggregate over all
    text columns, evaluated as a scalar subquery inside the same plan.
    """
    texts = [c for c in text_columns(df) if among is None or c in among]
    if columns is not None:
        chosen = set(columns) & set(texts)
        return df.select(
            *[
                repair_text(F.col(f"`{c}`"), extra).alias(c) if c in chosen else F.col(f"`{c}`")
                for c in df.columns
            ]
        )
    if not texts:
        return df
    damaged = df.agg(
        F.struct(
            *[
                F.coalesce(F.bool_or(looks_damaged(F.col(f"`{c}`"))), F.lit(False)).alias(c)
                for c in texts
            ]
        ).alias("damaged")
    ).scalar()
    return df.select(
        *[
            F.when(damaged[c], repair_text(F.col(f"`{c}`"), extra))
            .otherwise(F.col(f"`{c}`"))
            .alias(c)
            if c in texts
            else F.col(f"`{c}`")
            for c in df.columns
        ]
    )
