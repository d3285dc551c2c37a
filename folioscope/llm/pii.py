"""Personal data: patterns propose, checksums confirm, context words adjust the score.

Everything is a SQL expression. A pattern's matches and the text between them
(`regexp_extract_all` and `split` with the same pattern) give the places by
adding up lengths, in code points. The patterns are written so that a text is
scanned once: each can only begin where a match can begin.

Null texts count as empty. Overlapping spans of different kinds all stay.
Repeated rows are scanned each, other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import fresh, let, named, valid_text


@dataclass(frozen=True)
class Kind:
    """What a kind of data looks like; ``score`` is the belief without context, ``guard`` a character that every match has."""

    name: str
    pattern: str
    guard: str
    score: float
    context: str
    base: bool = True


# Patterns, and words that make a kind more likely.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, "e-?mail|mail|contact|write"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", ".", 0.6, "ip|address|host|server|login"),
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}(?![\x20-]?[0-9])", "", 0.8, "card|visa|credit|payment|pay"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.6, "phone|tel|call|mobile|fax"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])", "", 0.9, "iban|account|bank|konto", base=False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", 0.3, "ssn|social|security", base=False),
)
BASE = tuple(k.name for k in KINDS if k.base)
#: Score from which a span of a kind outside the base is reported.
LEAST_SCORE = 0.5
#: What context words add: within so many code points before or after, up to the next match of the kind.
CONTEXT_BONUS, BEFORE, AFTER = 0.3, 40, 20
#: Matches whose lengths are added up at once.
BLOCK = 64

SPAN = "struct<start:int,rank:int,end:int,kind:string,score:double>"


MATCHES = "array<struct<start:int,end:int,value:string,before:string,after:string>>"


def _placed(text: Column, pattern: str) -> Column:
    """Matches as array<struct<start,end,value,before,after>>, leftmost and non-overlapping, with the ends of the gaps around them.

    Lengths are added up within blocks and then over blocks, so that no array grows match by match.
    """
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(MATCHES).alias("out"))

    def step(acc: Column, match: Column) -> Column:
        begin = acc["at"] + match["gap"]
        end = begin + F.length(match["value"])
        one = F.struct(begin.cast("int").alias("start"), end.cast("int").alias("end"), match["value"].alias("value"), match["before"].alias("before"), match["after"].alias("after"))
        return F.struct(end.cast("int").alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def matches(both: Column) -> Column:
        gaps = both["gaps"]
        return F.transform(
            both["found"],
            lambda value, i: F.struct(
                F.length(F.get(gaps, i)).alias("gap"),
                value.alias("value"),
                F.right(F.get(gaps, i), F.lit(BEFORE)).alias("before"),
                F.left(F.get(gaps, i + 1), F.lit(AFTER)).alias("after"),
            ),
        )

    def blocks(all_: Column) -> Column:
        starts = F.when(F.size(all_) > 0, F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda k: F.aggregate(F.slice(all_, k * BLOCK + 1, BLOCK), empty, step))

    def moved(own: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        ends = F.aggregate(own, first, lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        shift = lambda v, s: F.struct((v["start"] + s).alias("start"), (v["end"] + s).alias("end"), v["value"].alias("value"), v["before"].alias("before"), v["after"].alias("after"))
        return F.flatten(F.zip_with(own, ends, lambda x, s: F.transform(x["out"], lambda v: shift(v, s))))

    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    return let(let(let(both, matches), blocks), moved)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    chars = F.reverse(F.split(digits, ""))
    total = F.aggregate(
        F.transform(F.filter(chars, lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2))),
        F.lit(0),
        lambda a, b: a + b,
    )
    return total % 10 == 0


def mod97(code: Column) -> Column:
    """Remainder by 97 of an account code: first four characters moved to the end, letters as 10 to 35."""
    chars = F.filter(F.split(F.concat(F.substring(code, 5, 64), F.substring(code, 1, 4)), ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def _confirmed(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.expr("0") <= F.substring(p, 1, 3).cast("int")) & (F.substring(p, 1, 3).cast("int") <= 255))
    if kind == "card":
        return F.length(digits).between(14, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "iban":
        return F.length(F.replace(value, F.lit(" "), F.lit(""))).between(15, 34) & (mod97(F.replace(value, F.lit(" "), F.lit(""))) == 1)
    return F.lit(True)


def _spans(text: Column, rank: int, kind: Kind) -> Column:
    may = text.contains(kind.guard) if kind.guard else text.rlike("[0-9]{2}" if kind.name == "iban" else "[0-9]")

    def told(s: Column) -> Column:
        around = F.lower(F.concat_ws(" ", s["before"], s["after"]))
        score = F.least(F.lit(kind.score) + F.when(around.rlike(rf"\b(?:{kind.context})"), F.lit(CONTEXT_BONUS)).otherwise(F.lit(0.0)), F.lit(1.0))
        return F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind.name).alias("kind"), score.alias("score"))

    good = F.transform(F.filter(_placed(text, kind.pattern), lambda s: _confirmed(kind.name, s["value"])), told)
    if not kind.base:
        good = F.filter(good, lambda s: s["score"] >= LEAST_SCORE)
    return F.when(may, good.cast(f"array<{SPAN}>")).otherwise(F.array().cast(f"array<{SPAN}>"))


def find_pii(df: DataFrame, text_col: str = "text", spans_col: str = "pii") -> DataFrame:
    """``df`` with ``spans_col``: array of (start, rank, end, kind, score), by start and then kind."""
    spans_col, work, *parts = fresh(df, spans_col, "pii_text", *(f"pii_{k.name}" for k in KINDS))
    out = df.select(*map(named, df.columns), valid_text(named(text_col)).alias(work))
    out = out.select("*", *(_spans(named(work), rank, kind).alias(part) for rank, (kind, part) in enumerate(zip(KINDS, parts))))
    return out.select(*map(named, df.columns), F.array_sort(F.concat(*map(named, parts))).alias(spans_col))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
