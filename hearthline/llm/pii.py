"""Personal data: detection and keyed, type-consistent surrogates.

Three steps of DataFrame functions only:

1. Every text is searched with one pattern; each hit is reduced to a type and a
   normal form (``+1 (499) 555-6503`` and ``+1 499 555 6503`` are one number).
2. The distinct entities of the corpus get surrogates, drawn from a keyed hash
   of type, normal form and attempt. A draw that equals another entity's
   surrogate or any entity that occurs in the corpus is drawn again, until all
   are different. The mapping depends only on key and corpus, so the same
   entity reads the same everywhere (coreference) and different ones differ.
3. Texts with hits are put together again, each surrogate rendered in the hit's
   own format: punctuation, spacing, letter case and length of numbers, valid
   check digits for card and account numbers, valid octets for addresses, names of
   the same gender and script. A given name has one gender, told by the titles of
   all its mentions; given and family names never share a surrogate.

National phone numbers are those of three, three and four digits with marks between
them. Digits that look like a card number but are not 16 are one only if their
check digit is right.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import prepare, scalar, stored

# What is searched for, in the order in which alternatives are tried.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
ACCESS_KEY = r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"
SECRET = (
    r"(?<=[=:\"' ])(?<=[=:] ?[\"']?)(?<=(?i:token|password|passwd|secret|api_key|apikey) ?[=:] ?[\"']?)"
    r"[A-Za-z0-9_\-]{12,128}(?![A-Za-z0-9_\-])"
)
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
CARD = r"(?<![0-9])[3-6][0-9]{3}(?:[ -]?[0-9]{4}){3}(?![0-9])|(?<![0-9])[0-9]{16}(?![0-9])"
# Card numbers of other lengths; the check digit decides.
LONG_CARD = r"(?<![0-9])3[47][0-9]{2}[ -][0-9]{6}[ -][0-9]{5}(?![0-9])|(?<![0-9])[3-6][0-9]{12,18}(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = r"(?<![0-9])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9])"
NATIONAL = r"(?<![0-9-])(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[0-9]{3}[.-][0-9]{4}(?![0-9-])"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = rf"(?<![0-9.]){OCTET}(?:\.{OCTET}){{3}}(?![0-9]|\.[0-9])"
# Titles in the languages known here, those of men, those of women, and others.
MALE = ("Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Don", "господин", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Doña", "госпожа", "Κυρία")
NEUTRAL = ("Dr", "Prof")
_NAME_WORD = r"\p{Lu}[\p{L}'’-]{1,40}"
_TITLE = "|".join((*MALE, *FEMALE, *NEUTRAL))
NAME = (
    rf"(?=\p{{Lu}})(?<=[\p{{L}}.] )(?<=(?<![\p{{L}}])(?:{_TITLE})\.? )"
    rf"{_NAME_WORD}(?: {_NAME_WORD})?(?![\p{{L}}])"
)
# No hit begins within a word, so most positions are passed over at once.
PATTERN = "(?<![A-Za-z0-9])(?:" + "|".join(
    f"(?:{p})" for p in (EMAIL, ACCESS_KEY, SECRET, IBAN, CARD, LONG_CARD, SSN, PHONE, NATIONAL, IPV4, NAME)
) + ")"
# Given names and syllables of family names by script.
GIVEN = {
    "latin": {
        "m": ("adrian", "bruno", "carlo", "daniel", "edgar", "felix", "gustav", "hugo", "ivan", "jonas",
              "karl", "lukas", "martin", "nicolas", "oscar", "paul"),
        "f": ("alma", "bianca", "clara", "diana", "emma", "flora", "greta", "helena", "irene", "julia",
              "karla", "laura", "maria", "nora", "olivia", "paula"),
    },
    "cyrillic": {
        "m": ("антон", "борис", "виктор", "глеб", "денис", "егор", "иван", "максим"),
        "f": ("анна", "вера", "галина", "дарья", "елена", "ирина", "мария", "ольга"),
    },
    "greek": {
        "m": ("ανδρέας", "γιώργος", "δημήτρης", "ιωάννης", "κώστας", "νίκος", "πέτρος", "σταύρος"),
        "f": ("άννα", "δήμητρα", "ελένη", "ιωάννα", "κατερίνα", "μαρία", "σοφία", "χριστίνα"),
    },
}
SYLLABLES = {
    "latin": ("bar", "cor", "del", "fen", "gal", "hol", "kir", "lam", "mor", "nel", "pas", "ros", "sel",
              "tur", "vin", "wes"),
    "cyrillic": ("бар", "вол", "гор", "дем", "зим", "кар", "лен", "мор", "нов", "пол", "рем", "сав",
                 "тар", "фед", "хол", "чер"),
    "greek": ("βασ", "γερ", "δελ", "ζαχ", "θεο", "καρ", "λεν", "μαρ", "νικ", "παν", "ροδ", "σαμ", "ταρ",
              "φωτ", "χαρ", "ψαλ"),
}
LOWER, UPPER, DIGITS, HEX = (
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "0123456789",
    "0123456789abcdef",
)

#: Kind of a hit that stays as it is.
NONE = "none"
#: After so many clashing draws a surrogate may grow longer, so that draws cannot run out.
GROW_AFTER = 6


def _is(hit: Column, pattern: str) -> Column:
    return hit.rlike(rf"^(?:{pattern})$")


def _kind(hit: Column, lead: Column) -> Column:
    """Type of a hit, ``NONE`` for digits that only look like a card; ``lead`` is the text in front of it."""
    bare = lambda p: p.replace("(?<![A-Za-z0-9._%+-])", "")
    return (
        F.when(_is(hit, bare(EMAIL)), "email")
        .when(_is(hit, r"(?:AKIA|ASIA)[A-Z0-9]{16}"), "access_key")
        .when(lead.rlike(r"(?i)(?:token|password|passwd|secret|api_key|apikey) ?[=:] ?[\"']?$"), "secret")
        .when(_is(hit, r"[A-Z]{2}[0-9]{2}[A-Z0-9 ]+"), "iban")
        .when(_is(hit, r"[0-9]{3}-[0-9]{2}-[0-9]{4}"), "ssn")
        .when(hit.startswith("+") | _is(hit, NATIONAL), "phone")
        .when(_is(hit, rf"{OCTET}(?:\.{OCTET}){{3}}"), "ipv4")
        .when(_is(hit, CARD), "card")
        .when(_is(hit, r"[0-9 -]+"), F.when(_right_card(F.regexp_replace(hit, "[^0-9]", "")), "card").otherwise(NONE))
        .otherwise("name")
    )


def _normal(kind: Column, hit: Column) -> Column:
    digits = F.regexp_replace(hit, r"[^0-9]", "")
    return (
        F.when(kind.isin("phone", "card", "ssn"), digits)
        .when(kind == "iban", F.regexp_replace(hit, " ", ""))
        .when(kind.isin("email", "family", "given"), F.lower(hit))
        .otherwise(hit)
    )


def _byte(stream: Column, i: Column) -> Column:
    """The i-th byte of a hexadecimal stream, from its start again after its end."""
    at = F.pmod(i * 2, F.length(stream)) + 1
    return F.conv(F.substr(stream, at.cast("int"), F.lit(2)), 16, 10).cast("int")


def _pick(alphabet: str, n: Column) -> Column:
    return F.substr(F.lit(alphabet), (n % len(alphabet) + 1).cast("int"), F.lit(1))


def _redrawn(text: Column, stream: Column, hexadecimal: Column | None = None) -> Column:
    """Every letter and digit replaced by one of its class; the rest kept."""

    def one(c: Column, i: Column) -> Column:
        n = _byte(stream, i)
        plain = (
            F.when(c.rlike("[0-9]"), _pick(DIGITS, n))
            .when(c.rlike("[a-z]"), _pick(LOWER, n))
            .when(c.rlike("[A-Z]"), _pick(UPPER, n))
            .otherwise(c)
        )
        if hexadecimal is None:
            return plain
        return F.when(hexadecimal & c.rlike("[0-9a-f]"), _pick(HEX, n)).otherwise(plain)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of digits whose last one counts twice (the check digit is absent)."""
    size = F.length(digits)

    def value(c: Column, i: Column) -> Column:
        n = c.cast("int")
        twice = F.when(n >= 5, n * 2 - 9).otherwise(n * 2)
        return F.when((size - i) % 2 == 1, twice).otherwise(n)

    return F.aggregate(F.transform(F.split(digits, ""), value), F.lit(0), lambda a, x: a + x)


def _right_card(number: Column) -> Column:
    """Whether the last digit is the check digit of those before it."""
    body, last = F.substr(number, F.lit(1), F.length(number) - 1), F.substr(number, F.length(number), F.lit(1))
    return F.pmod(-_luhn_sum(body), F.lit(10)).cast("string") == last


def _iban(number: Column, stream: Column) -> Column:
    """Same country and length, with the check digits of the new number."""
    country = F.substr(number, F.lit(1), F.lit(2))
    body = _redrawn(F.substr(number, F.lit(5)), stream)

    def step(acc: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(c.rlike("[0-9]"), acc * 10 + c.try_cast("int")).otherwise(acc * 100 + letter) % 97

    rest = F.aggregate(F.split(F.concat(body, country, F.lit("00")), ""), F.lit(0), step)
    return F.concat(country, F.lpad((98 - rest).cast("string"), 2, "0"), body)


def _card(number: Column, stream: Column) -> Column:
    """Same first digit and length; the check digit is right where it was right before."""
    body = F.substr(number, F.lit(1), F.length(number) - 1)
    drawn = F.concat(F.substr(number, F.lit(1), F.lit(1)), _redrawn(F.substr(body, F.lit(2)), stream))
    check = F.when(_right_card(number), F.pmod(-_luhn_sum(drawn), F.lit(10)).cast("string")).otherwise(
        _pick(DIGITS, _byte(stream, F.lit(30)))
    )
    return F.concat(drawn, check)


def _phone(number: Column, stream: Column) -> Column:
    """The first digit (country) stays, the next one is not 0."""
    rest = _redrawn(F.substr(number, F.lit(3)), stream)
    second = _pick("23456789", _byte(stream, F.lit(31)))
    return F.concat(F.substr(number, F.lit(1), F.lit(1)), second, rest)


def _ipv4(address: Column, attempt: Column, stream: Column) -> Column:
    """Another public-looking address; octets keep their number of digits until draws keep clashing."""

    def octet(c: Column, i: Column) -> Column:
        n = _byte(stream, i * 3)
        return (
            F.when(attempt >= GROW_AFTER, 1 + n % 223).when(F.length(c) == 1, 1 + n % 9).when(F.length(c) == 2, 11 + n % 89).otherwise(100 + n % 124)
        ).cast("string")

    return F.array_join(F.transform(F.split(address, r"\."), octet), ".")


def _email(address: Column, stream: Column) -> Column:
    """Letters and digits redrawn in place; the top-level domain stays."""
    top = F.regexp_extract(address, r"(\.[^.]*)$", 1)
    return F.concat(_redrawn(F.substr(address, F.lit(1), F.length(address) - F.length(top)), stream), top)


def _script(name: Column) -> Column:
    return (
        F.when(name.rlike(r"\p{IsCyrillic}"), "cyrillic").when(name.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    )


def _by_script(name: Column, choose: Callable[[str], Column]) -> Column:
    script = _script(name)
    return (
        F.when(script == "cyrillic", choose("cyrillic")).when(script == "greek", choose("greek")).otherwise(choose("latin"))
    )


def _words(options: tuple[str, ...], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (n % len(options) + 1).cast("int"))


def _family(name: Column, stream: Column) -> Column:
    return _by_script(
        name, lambda s: F.concat(*[_words(SYLLABLES[s], _byte(stream, F.lit(i))) for i in range(4)])
    )


def _given(gender: Column, name: Column, stream: Column) -> Column:
    """A given name of the gender plus a syllable, so that there are enough of them."""

    def choose(s: str) -> Column:
        n, tail = _byte(stream, F.lit(1)), _words(SYLLABLES[s], _byte(stream, F.lit(2)))
        both = (*GIVEN[s]["m"], *GIVEN[s]["f"])
        first = (
            F.when(gender == "m", _words(GIVEN[s]["m"], n))
            .when(gender == "f", _words(GIVEN[s]["f"], n))
            .otherwise(_words(both, n))
        )
        return F.concat(first, F.lit("-"), tail, _words(SYLLABLES[s], _byte(stream, F.lit(3))))

    return _by_script(name, choose)


def _draw(key: str) -> Column:
    """The surrogate of (kind, normal, gender, attempt), itself in normal form."""
    kind, normal, attempt = F.col("kind"), F.col("normal"), F.col("attempt")
    seed = F.concat_ws("\u0001", F.lit(key), kind, normal, attempt.cast("string"))
    digest = F.concat(F.sha2(seed.cast("binary"), 512), F.sha2(F.concat(seed, F.lit("+")).cast("binary"), 512))
    return F.transform(F.array(digest), lambda s: _drawn(kind, normal, attempt, s)).getItem(0)


def _drawn(kind: Column, normal: Column, attempt: Column, stream: Column) -> Column:
    drawn = (
        F.when(kind == "email", _email(normal, stream))
        .when(kind == "access_key", F.concat(F.substr(normal, F.lit(1), F.lit(4)), _redrawn(F.substr(normal, F.lit(5)), stream)))
        .when(kind == "secret", _redrawn(normal, stream, normal.rlike("^[0-9a-f]+$")))
        .when(kind == "iban", _iban(normal, stream))
        .when(kind == "card", _card(normal, stream))
        .when(kind == "ssn", _redrawn(normal, stream))
        .when(kind == "phone", _phone(normal, stream))
        .when(kind == "ipv4", _ipv4(normal, attempt, stream))
        .when(kind == "family", _family(normal, stream))
        .otherwise(_given(F.col("gender"), normal, stream))
    )
    # Formats of free length may grow when draws keep clashing.
    return (
        F.when((attempt >= GROW_AFTER) & (kind == "email"), F.concat(F.lit("x"), attempt.cast("string"), drawn))
        .when((attempt >= GROW_AFTER) & kind.isin("family", "given"), F.concat(drawn, F.lit("-"), _family(normal, F.reverse(stream))))
        .otherwise(drawn)
    )


def _space(kind: Column) -> Column:
    """What surrogates must differ within: names of all kinds are one."""
    return F.when(kind.isin("family", "given"), "name").otherwise(kind)


def surrogates(entities: DataFrame, key: str, rounds: int = 40) -> DataFrame:
    """Rows of (kind, normal, surrogate) for distinct (kind, normal): no two alike, none an entity.

    Given and family names are compared with each other too. ``entities`` may have
    a ``gender`` (m, f or null). Raises if some entities still clash after
    ``rounds`` draws, which needs a type of fixed length whose values are all in use.
    """
    if "gender" not in entities.columns:
        entities = entities.withColumn("gender", F.lit(None).cast("string"))
    waiting, taken = entities.select("kind", "normal", "gender", F.lit(0).alias("attempt")), None
    real = entities.select(_space(F.col("kind")).alias("space"), F.col("normal").alias("surrogate")).distinct().withColumn("real", F.lit(1))
    for attempt in range(rounds):
        drawn = waiting.withColumns({"surrogate": _draw(key), "space": _space(F.col("kind"))})
        firsts = drawn.groupBy("space", "surrogate").agg(F.min(F.struct("kind", "normal")).alias("first"))
        checked = drawn.join(real, ["space", "surrogate"], "left").join(firsts, ["space", "surrogate"])
        free = F.col("real").isNull() & (F.col("first.kind") == F.col("kind")) & (F.col("first.normal") == F.col("normal"))
        if taken is not None:
            used = taken.select(_space(F.col("kind")).alias("space"), "surrogate").withColumn("used", F.lit(1))
            checked = checked.join(used, ["space", "surrogate"], "left")
            free = free & F.col("used").isNull()
        checked = stored(
            checked.select("kind", "normal", "gender", "surrogate", free.alias("free")), f"pii-draw{attempt}"
        )
        good = checked.filter("free").select("kind", "normal", "surrogate")
        taken = good if taken is None else taken.unionByName(good)
        clashing = checked.filter("not free")
        if not scalar(clashing.agg(F.count(F.lit(1)))):
            return taken
        waiting = clashing.select("kind", "normal", "gender", F.lit(attempt + 1).alias("attempt"))
    raise ValueError("surrogates still clash; some type of entity has no free values left")


def _found() -> tuple[Column, Column]:
    """Whether a text has hits, and the identity of the text."""
    has = F.coalesce(F.col("text").rlike(PATTERN), F.lit(False))
    return has, F.md5(F.col("text").cast("binary"))


def mentions(docs: DataFrame) -> DataFrame:
    """Hits of all distinct texts: (text_id, pos, part, kind, normal, hit, gender).

    ``pos`` counts the hits of a text from 0. A full name is two parts, given
    and family name, so that ``Mrs Anna Berg`` and ``Mrs Berg`` share the
    latter; any other hit is one part.
    """
    has, text_id = _found()
    hits = (
        docs.filter(has)
        .select(text_id.alias("text_id"), "text")
        .select(
            "text_id",
            F.regexp_extract_all("text", F.lit(PATTERN), 0).alias("hits"),
            # The 40 characters in front of every hit tell secrets and titles.
            F.transform(F.split("text", PATTERN, -1), lambda p: F.right(p, F.lit(40))).alias("leads"),
        )
        .dropDuplicates(["text_id"])
    )
    spots = hits.select(
        "text_id", F.posexplode(F.arrays_zip("hits", "leads")).alias("pos", "spot")
    ).select(
        "text_id",
        "pos",
        F.col("spot.hits").alias("hit"),
        F.coalesce("spot.leads", F.lit("")).alias("lead"),
    ).filter(F.col("hit").isNotNull())
    spots = spots.withColumn("kind", _kind(F.col("hit"), F.col("lead")))
    title = F.regexp_extract("lead", rf"({_TITLE})\.? $", 1)
    gender = F.when(title.isin(*MALE), "m").when(title.isin(*FEMALE), "f")
    split = F.split("hit", " ", 2)
    named = F.when(
        F.size(split) == 2,
        F.array(
            F.struct(F.lit("given").alias("kind"), split[0].alias("hit")),
            F.struct(F.lit("family").alias("kind"), split[1].alias("hit")),
        ),
    ).otherwise(F.array(F.struct(F.lit("family").alias("kind"), F.col("hit").alias("hit"))))
    parts = F.when(F.col("kind") == "name", named).otherwise(
        F.array(F.struct(F.col("kind").alias("kind"), F.col("hit").alias("hit")))
    )
    return spots.select("text_id", "pos", gender.alias("gender"), F.posexplode(parts).alias("part", "it")).select(
        "text_id",
        "pos",
        "part",
        F.col("it.kind").alias("kind"),
        _normal(F.col("it.kind"), F.col("it.hit")).alias("normal"),
        F.col("it.hit").alias("hit"),
        F.when(F.col("it.kind") == "given", F.col("gender")).alias("gender"),
    )


def _render(kind: Column, hit: Column, surrogate: Column) -> Column:
    """The surrogate in the format of the hit."""
    upper = (F.upper(hit) == hit) & (F.lower(hit) != hit)
    numbered = F.aggregate(
        F.split(hit, ""),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("next")),
        lambda s, c: F.when(
            c.rlike("[0-9A-Za-z]"),
            F.struct(
                F.concat(s["out"], F.substr(surrogate, s["next"], F.lit(1))).alias("out"),
                (s["next"] + 1).alias("next"),
            ),
        ).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["next"].alias("next"))),
    )["out"]
    return (
        F.when(kind.isin("phone", "card", "ssn", "iban"), numbered)
        .when((kind == "email") & upper, F.upper(surrogate))
        .when(kind.isin("family", "given"), F.when(upper, F.upper(surrogate)).otherwise(F.initcap(F.regexp_replace(surrogate, "-", " "))))
        .otherwise(surrogate)
    )


def replace(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with all hits in ``text`` replaced, and ``pii_hits`` (long) added.

    All rows and columns stay; an ``n_chars`` column is brought up to date. Null
    and empty texts have no hits. Equal texts are treated once, rows of them all
    replaced. A column ``pii_hits`` that is there already is replaced; any other
    stays, whatever its name. The key decides the surrogates; keep it secret where
    the mapping must not be found out.
    """
    prepare(docs.sparkSession)
    spots = stored(mentions(docs), "pii-mentions")
    # One gender for a name, unless its titles disagree.
    gender = F.when(F.min("gender") == F.max("gender"), F.min("gender"))
    entities = stored(
        spots.filter(F.col("kind") != NONE).groupBy("kind", "normal").agg(gender.alias("gender")), "pii-entities"
    )
    drawn = surrogates(entities, key)
    rendered = spots.join(drawn, ["kind", "normal"], "left").select(
        "text_id", "pos", "part", (F.col("kind") != NONE).alias("real"),
        F.when(F.col("kind") == NONE, F.col("hit")).otherwise(_render(F.col("kind"), F.col("hit"), F.col("surrogate"))).alias("new"),
    )
    # Per text: the parts in order, name parts joined again.
    per_text = rendered.groupBy("text_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "part", "new"))).alias("parts"),
        F.count_if(F.col("real") & (F.col("part") == 0)).alias("count"),
    )
    # Names that no column of the documents has.
    own, new, count = (_unused(docs, name) for name in ("pii_text", "pii_new", "pii_count"))
    per_text = per_text.select(
        F.col("text_id").alias(own),
        F.col("count").alias(count),
        F.transform(
            "parts", lambda p: F.concat(F.when(p["part"] > 0, " ").otherwise("\u0000"), p["new"])
        ).alias("news"),
    ).select(
        own,
        count,
        # The first part of each hit is marked with a NUL, which no rendered part contains.
        F.slice(F.split(F.array_join("news", ""), "\u0000"), F.lit(2), F.size("news")).alias(new),
    )
    has, text_id = _found()
    clean = docs.filter(~has).withColumn("pii_hits", F.lit(0).cast("long"))
    joined = docs.filter(has).join(per_text, text_id == F.col(own))
    rest = F.split("text", PATTERN, -1)
    text = F.array_join(
        F.transform(rest, lambda p, i: F.concat(p, F.coalesce(F.get(F.col(new), i), F.lit("")))), ""
    )
    columns = {"text": text}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.length(text).cast(dict(docs.dtypes)["n_chars"])
    changed = joined.withColumns(columns | {"pii_hits": F.col(count).cast("long")})
    return clean.unionByName(changed.drop(own, new, count))


def _unused(docs: DataFrame, name: str) -> str:
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name
