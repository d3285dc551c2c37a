"""Text expressions: normal form, tokens, trigrams, overlap, chunks, plain text of HTML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK_SIZE, CHUNK_STEP = 900, 720


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def tokens(text: Column) -> Column:
    """Runs of two or more letters and digits of the normal form."""
    return F.regexp_extract_all(normalised(text), F.lit(r"[\p{L}\p{N}]{2,}"), F.lit(0))


def trigrams(text: Column) -> Column:
    """Distinct character trigrams without white space."""
    bare = F.regexp_replace(F.lower(text), r"\s+", "")
    # Each character looks ahead at three, itself the first.
    return F.array_distinct(F.regexp_extract_all(bare, F.lit("(?s)(?=(...))."), F.lit(1)))


def overlap(a: Column, b: Column) -> Column:
    """Shared elements over the size of the larger set; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b)))


def chunks(text: Column) -> Column:
    """Overlapping chunks of the text with its white space collapsed: none for blank text."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))

    def cut(s: Column) -> Column:
        last = F.greatest(F.ceil(F.greatest(F.length(s) - CHUNK_SIZE, F.lit(0)) / CHUNK_STEP), F.lit(0)).cast("int")
        return F.when(F.length(s) > 0, F.transform(F.sequence(F.lit(0), last), lambda k: F.trim(F.substring(s, k * CHUNK_STEP + 1, F.lit(CHUNK_SIZE))))).otherwise(F.array().cast("array<string>"))

    return F.get(F.transform(F.array(flat), cut), F.lit(0))


def html_text(html: Column) -> Column:
    """Readable text: comments, scripts and tags go, six entities are decoded, white space collapses."""
    # Patterns and what they become, in order.
    steps = [
        (r"(?s)<!--.*?-->", " "),
        (r"(?is)<(script|style|noscript|svg|template)\b[^>]*>.*?</\1\s*>", " "),
        (r"<[^>]+>", " "),
        (r"(?i)&(?:nbsp|#160);", " "),
        (r"(?i)&amp;", "&"),
        (r"(?i)&lt;", "<"),
        (r"(?i)&gt;", ">"),
        (r"(?i)&quot;", '"'),
        (r"(?i)&#39;|&apos;", "'"),
        (r"\s+", " "),
    ]
    for pattern, by in steps:
        html = F.regexp_replace(html, pattern, by)
    return F.trim(html)


def snippet(text: Column, terms: Column, before: int = 120, most: int = 360) -> Column:
    """What is shown of a text around the first place of any term: from ``before`` characters before it, ``most`` in all, cut at blanks and marked where cut."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))

    def begun(s: Column) -> Column:
        places = F.filter(F.transform(terms, lambda t: F.instr(F.lower(s), t) - 1), lambda p: p >= 0)
        return F.struct(s.alias("s"), F.coalesce(F.array_min(places), F.lit(0)).alias("center"))

    def started(x: Column) -> Column:
        raw = F.greatest(x["center"] - before, F.lit(0))
        blank = F.instr(F.substring(x["s"], raw + 1, F.length(x["s"])), " ")
        inside = (raw > 0) & (blank > 0) & (raw + blank - 1 < x["center"])
        return F.struct(x["s"].alias("s"), F.when(inside, raw + blank).otherwise(raw).alias("start"))

    def ended(x: Column) -> Column:
        end = F.least(F.length(x["s"]), x["start"] + most)
        back = F.instr(F.reverse(F.substring(x["s"], F.lit(1), end + 1)), " ")
        last = F.when((end < F.length(x["s"])) & (back > 0), end + 1 - back).otherwise(end)
        return F.struct(x["s"].alias("s"), x["start"].alias("start"), F.when(last > x["start"], last).otherwise(end).alias("end"))

    def shown(x: Column) -> Column:
        cut = F.substring(x["s"], x["start"] + 1, x["end"] - x["start"])
        return F.concat(F.when(x["start"] > 0, "…").otherwise(""), cut, F.when(x["end"] < F.length(x["s"]), " …").otherwise(""))

    steps = F.array(flat)
    for step in (begun, started, ended, shown):
        steps = F.transform(steps, step)
    return F.get(steps, F.lit(0))


def anchor_segments(text: Column, least: int = 12) -> Column:
    """Runs up to a sentence mark or line break that have ``least`` characters or more."""
    found = F.regexp_extract_all(text, F.lit(r"[^.!?\n]+(?:[.!?]+|$|(?=\n))"), F.lit(0))
    return F.filter(F.transform(found, lambda s: F.trim(s)), lambda s: F.length(s) >= least)


def source_plain(text: Column) -> Column:
    """Markdown and LaTeX of a page's blocks as the words that a reader sees."""
    # Patterns and what they become, in order.
    steps = [(r"(?m)^\s*(?:#{1,6}|[-*+•])\s+", ""), (r"\$+", " "), (r"\\[a-zA-Z]+", " "), (r"[{}^_]", " "), (r"\s+", " ")]
    for pattern, by in steps:
        text = F.regexp_replace(text, pattern, by)
    return F.trim(text)


def layer_clean(text: Column) -> Column:
    """Text of a page's layer in one line: marks of joined hyphens go, ligatures are spelled, a hyphen at a line's end stays and joins."""
    # Ligatures and their letters.
    for ligature, letters in (("\ufb00", "ff"), ("\ufb01", "fi"), ("\ufb02", "fl"), ("\ufb03", "ffi"), ("\ufb04", "ffl"), ("\ufb05", "st"), ("\ufb06", "st")):
        text = F.replace(text, F.lit(ligature), F.lit(letters))
    text = F.regexp_replace(F.replace(text, F.lit("\x02"), F.lit("")), r"-[ \t]*\r?\n[ \t]*", "-")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def readable(text: Column, most: float = 0.02) -> Column:
    """Whether there is text, of which at most a share is controls, of private use, or replaced characters."""
    bad = F.length(text) - F.length(F.regexp_replace(text, r"[\p{Cc}\p{Co}\x{FFFD}]", ""))
    return F.coalesce((F.length(text) > 0) & (bad <= F.length(text) * most), F.lit(False))


def expanded_numbers(marker: Column, most: int = 100) -> Column:
    """The numbers of a citation marker such as ``3, 5-7``, each once: ranges are spelled out, but reversed ones and those that reach further than ``most`` go, as does what is no number."""

    def one(part: Column) -> Column:
        ends = F.transform(F.split(part, r"\s*-\s*"), lambda x: x.try_cast("int"))
        low, high = F.get(ends, F.lit(0)), F.get(ends, F.lit(1))
        whole = part.rlike(r"^[0-9]+\s*-\s*[0-9]+$") & (high >= low) & (high - low <= most)
        spelled = F.transform(F.sequence(low, F.greatest(low, high)), lambda n: n.cast("string"))
        return F.when(whole, spelled).when(part.rlike("^[0-9]+$"), F.array(part)).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.flatten(F.transform(F.split(marker, "[,;]"), lambda p: one(F.trim(p)))))


def number_cell(cell: Column) -> tuple[Column, Column]:
    """Value and unit of a table cell, markup aside: thousands commas, exponents, and a percent sign or K, M or B in either case as a label that does not scale."""
    pattern = r"^([+-]?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)\s*([%KMBkmb]?)$"
    bare = F.regexp_replace(F.trim(cell), "[*_`]", "")
    digits, unit = F.regexp_extract(bare, pattern, 1), F.regexp_extract(bare, pattern, 2)
    value = F.when(digits != "", F.regexp_replace(digits, ",", "").try_cast("double"))
    finite = F.abs(value) < F.lit(float("inf"))
    return F.when(finite, value), F.when(finite, F.upper(unit))
