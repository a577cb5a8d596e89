"""Personal data spans by DataFrame functions alone: patterns propose, checksums confirm, context words adjust.

Each kind's pattern is run over the whole text; leftmost non-overlapping
matches become (start, end) in code points.  A validator confirms a match
(octet range, Luhn, digit count, mod 97).  A span's score is its kind's
starting score, plus a gain for a passed checksum, plus a gain when one of the
kind's context words stands within CONTEXT_CHARS before it.  Spans that reach
THRESHOLD are kept.  The four base kinds start at the threshold, so context
can only add to them; the further kinds need a checksum or a context word.

The patterns use possessive loops and start anchors so that Java's matcher
neither recurses nor rescans on long runs: time is linear in the text.

Null text counts as empty and gives no spans.  Rows are handled one by one:
repeats stay, other columns are left alone, an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.5
CONTEXT_CHARS = 40
CONTEXT_GAIN = 0.3
CHECKSUM_GAIN = 0.3
#: Spans are accumulated in pieces of this many, so that texts full of matches don't cost their square.
PIECE = 256


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    needs: str
    start: float
    context: str
    checksum: bool = False


# What each kind looks like and the words that make it likelier.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.6, r"(?i)e-?mail|contact|correo|courriel|write to"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", ".", 0.5, r"(?i)\bip\b|address|host|server|login"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "", 0.5, r"(?i)card|visa|mastercard|tarjeta|carte|karte|credit", True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.5, r"(?i)phone|tel|call|mobile|fax|handy"),
    Kind("iban", r"[A-Z][A-Z][0-9][0-9](?:\x20?[A-Z0-9])++", "", 0.3, r"(?i)iban|account|konto|cuenta|compte|bank", True),
    Kind("local_phone", r"\(?[0-9][0-9][0-9]\)?[\x20.-][0-9][0-9][0-9][\x20.-][0-9][0-9][0-9][0-9]", "", 0.3, r"(?i)phone|tel|call|mobile|fax|handy"),
    Kind("national_id", r"[0-9][0-9][0-9]-[0-9][0-9]-[0-9][0-9][0-9][0-9]", "-", 0.3, r"(?i)ssn|social security|national id|ausweis|dni"),
)
BASE = ("email", "ip", "card", "phone")
WORDISH = r"[A-Za-z0-9]"


def _small(part: Column) -> Column:
    """A number of at most 255, however many zeros lead it."""
    bare = F.ltrim(part, F.lit("0"))
    return (F.length(bare) <= 3) & (F.lpad(bare, 3, "0") <= "255")


def mod_97(account: Column) -> Column:
    """The remainder of an account number's digits (letters as 10 to 35) after its first four characters move to the end."""
    moved = F.concat(F.substr(account, F.lit(5)), F.substring(account, 1, 4))
    return F.aggregate(
        F.split(moved, ""),
        F.lit(0),
        lambda r, c: F.when(c == "", r)
        .when(c.between("0", "9"), F.pmod(r * 10 + F.ascii(c) - 48, F.lit(97)))
        .otherwise(F.pmod(r * 100 + F.ascii(c) - 55, F.lit(97))),
    )


def _valid(kind: str, m: Column, text: Column, start: Column, end: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    alone = ~F.coalesce(F.substr(text, F.greatest(start, F.lit(1)), F.when(start > 0, F.lit(1)).otherwise(F.lit(0))).rlike(WORDISH), F.lit(False)) & ~F.substr(text, end + 1, F.lit(1)).rlike(WORDISH)
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(m, r"\."), _small)
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), F.call_function("luhn_check", digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == "iban":
        packed = F.replace(m, F.lit(" "), F.lit(""))
        return F.when(F.length(packed).between(15, 34), (mod_97(packed) == 1) & alone).otherwise(F.lit(False))
    return alone


_PIECE = "cast(array() as array<struct<s:int,e:int,m:string>>)"
_PIECES = "cast(array() as array<array<struct<s:int,e:int,m:string>>>)"


def _located(matches: Column, gaps: Column) -> Column:
    """array<struct<s, e, m>> from the matches and the text between them (one more than there are matches)."""

    def add(a: Column, x: Column) -> Column:
        start = a["at"] + F.length(x["g"])
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.array_append(a["found"], F.struct(start.alias("s"), end.alias("e"), x["m"].alias("m"))).alias("found"))

    def piece(state: Column, k: Column) -> Column:
        own = F.zip_with(F.slice(matches, k * PIECE + 1, PIECE), F.slice(gaps, k * PIECE + 1, PIECE), lambda m, g: F.struct(m.alias("m"), g.alias("g")))
        return F.aggregate(
            F.filter(own, lambda x: x["m"].isNotNull()),
            F.struct(state["at"].alias("at"), F.expr(_PIECE).alias("found")),
            add,
            # what earlier pieces found joins at a piece's end alone
            lambda a: F.struct(a["at"].alias("at"), F.array_append(state["all"], a["found"]).alias("all")),
        )

    pieces = F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / PIECE).cast("int"))
    return F.flatten(F.aggregate(pieces, F.struct(F.lit(0).alias("at"), F.expr(_PIECES).alias("all")), piece, lambda s: s["all"]))


def _kept_spans(k: Kind, matches: Column, gaps: Column, body: Column, nothing: Column) -> Column:
    """The kind's confirmed spans that reach the threshold, as array<struct<kind, start, end, score>>."""

    def scored(x: Column) -> Column:
        before = F.substr(body, F.greatest(x["s"] - CONTEXT_CHARS, F.lit(0)) + 1, F.least(x["s"], F.lit(CONTEXT_CHARS)))
        score = F.lit(k.start + CHECKSUM_GAIN * k.checksum) + F.when(before.rlike(k.context), F.lit(CONTEXT_GAIN)).otherwise(F.lit(0.0))
        return F.struct(F.lit(k.name).alias("kind"), x["s"].alias("start"), x["e"].alias("end"), F.least(score, F.lit(1.0)).alias("score"))

    confirmed = F.filter(_located(matches, gaps), lambda x: _valid(k.name, x["m"], body, x["s"], x["e"]))
    return F.when(F.size(matches) > 0, F.filter(F.transform(confirmed, scored), lambda x: x["score"] >= THRESHOLD)).otherwise(nothing)


def find_pii(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """Add `out`: array<struct<kind, start, end, score>>, by kind as listed in KINDS, then by start.

    Spans of one kind never overlap, those of several kinds may, and both stay.  Texts are looked through whole, however
    long, in time that is linear in text and matches.  A column named `out` is replaced, others stay; an empty table
    gives an empty table.
    """
    names = set(docs.columns)
    own = lambda x: next(c for c in (f"_{x}{'_' * i}" for i in range(99)) if c not in names)
    body = own("body")
    df = docs.withColumn(body, F.coalesce(F.col(text), F.lit("")))
    matched = {k.name: own(f"m_{k.name}") for k in KINDS}
    between = {k.name: own(f"g_{k.name}") for k in KINDS}
    empty = F.expr("cast(array() as array<string>)")

    def matches(k: Kind) -> Column:
        every = F.regexp_extract_all(body, F.lit(k.pattern), F.lit(0))
        return F.when(F.contains(body, F.lit(k.needs)), every).otherwise(empty) if k.needs else every

    df = df.withColumns({matched[k.name]: matches(k) for k in KINDS})
    df = df.withColumns({between[k.name]: F.when(F.size(matched[k.name]) > 0, F.split(body, k.pattern, -1)) for k in KINDS})
    nothing = F.expr("cast(array() as array<struct<kind:string,start:int,`end`:int,score:double>>)")
    parts = [_kept_spans(k, F.col(matched[k.name]), F.col(between[k.name]), F.col(body), nothing) for k in KINDS]
    return df.withColumn(out, F.concat(*parts)).drop(body, *matched.values(), *between.values())


def pii_report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, and all spans, one row per input row."""
    found = find_pii(docs.select("doc_id", "text"))
    written = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(F.array_join(F.transform(base, written), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("pii", written), ",").alias("spans"),
    )
