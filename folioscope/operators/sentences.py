"""Sentences of a text, and the sentence that a word was met in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words whose full stop ends no sentence, and an author's initial.
ABBREVIATED = r"(?i)\b(?:figs?|eqs?|tabs?|refs?|nos?|vol|vs|cf|approx|suppl|al|e\.g|i\.e)\.$"
INITIAL = r"(?:^|\s)\p{Lu}\.$"
# Characters of a sentence that is shown whole, and those around the word of a longer one.
MOST_SENTENCE, AROUND = 360, 160

#: Where a segment ends: at a line's end, behind marks and closing brackets before white space; behind a full stop only if no lower-case letter comes next.
_END = r"(?:[!?…]+[\"'”’)\]]*\s+|[。！？]\s*|\.[\"'”’)\]]*\s+(?![^\p{L}\n.!?]*\p{Ll})|\n+)"
_CUT = "\x01"


def segments(text: Column) -> Column:
    """The text cut behind every end of a sentence; together they are the text."""
    marked = F.regexp_replace(F.translate(text, _CUT, ""), _END, f"$0{_CUT}")
    return F.filter(F.split(marked, _CUT), lambda s: s != "")


def _open(sentence: Column) -> Column:
    return sentence.rlike(ABBREVIATED) | sentence.rlike(INITIAL)


def sentences(text: Column) -> Column:
    """Sentences, not cut behind abbreviations and initials."""
    parts = F.filter(F.transform(segments(text), lambda s: F.trim(F.regexp_replace(s, r"^\s+|\s+$", ""))), lambda s: s != "")

    def join(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat_ws(" ", last, s)))
        return F.when(F.size(done) == 0, F.array(s)).when(_open(last), joined).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(parts, F.array().cast("array<string>"), join)


def with_markers(sentences: Column) -> Column:
    """Sentences to which the numbers of a list (``1.``, ``2)``) before them are joined."""

    def join(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat_ws(" ", last, s)))
        return F.when(F.size(done) == 0, F.array(s)).when(last.rlike(r"^[0-9]+[.)]$"), joined).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(sentences, F.array().cast("array<string>"), join)


def sentence_breaks(text: Column) -> Column:
    """Offsets behind each full stop, colon, question or exclamation mark that ends a sentence, whatever case follows."""
    parts = F.split(text, r"(?<=[.:!?])(?=\s|$)")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends"))

    def step(s: Column, p: Column) -> Column:
        at = (s["at"] + F.length(p)).cast("int")
        ends = p.rlike(r"[.:!?]$") & ~_open(p)
        return F.struct(at.alias("at"), F.when(ends, F.concat(s["ends"], F.array(at))).otherwise(s["ends"]).alias("ends"))

    return F.aggregate(parts, start, step, lambda s: s["ends"])


def example_sentence(text: Column, start: Column, end: Column) -> Column:
    """(text, start, end): the sentence that the word from ``start`` to ``end`` (offsets in code points) stands in, and where it stands there; null if nowhere.

    White space is collapsed and words that a line's end broke are joined; a long sentence is
    cut at blanks around the word and marked where it was cut.
    """
    opened, closed = "\x02", "\x03"
    zero = F.struct(F.lit(0).alias("at"), F.lit(None).cast("string").alias("found"))

    def step(s: Column, p: Column) -> Column:
        after = (s["at"] + F.length(p)).cast("int")
        inside = (start >= s["at"]) & (start < after)
        low, high = start - s["at"], F.least(end, after) - s["at"]
        marked = F.concat(F.substring(p, F.lit(1), low), F.lit(opened), F.substring(p, low + 1, high - low), F.lit(closed), F.substring(p, high + 1, F.length(p)))
        return F.struct(after.alias("at"), F.coalesce(s["found"], F.when(inside, marked)).alias("found"))

    one = F.aggregate(segments(F.translate(text, opened + closed, "")), zero, step, lambda s: s["found"])
    # A hyphen between lower-case letters and white space goes; the word's marks may stand in between.
    joined = F.regexp_replace(one, rf"(?<=\p{{Ll}})({closed}?)-({closed}?)\s+({opened}?)(?=\p{{Ll}})", "$1$2$3")
    tidy = F.trim(F.regexp_replace(F.regexp_replace(joined, r"\s+", " "), rf" ([{closed}]) ", "$1 "))

    def placed(own: Column) -> Column:
        low = F.instr(own, opened) - 1
        high = F.instr(own, closed) - 2
        return F.struct(F.translate(own, opened + closed, "").alias("text"), low.alias("start"), high.alias("end"))

    def cut(s: Column) -> Column:
        head = F.substring(s["text"], F.lit(1), F.greatest(s["start"] - AROUND + 1, F.lit(0)))
        begin = F.when(F.instr(F.reverse(head), " ") > 0, F.length(head) - F.instr(F.reverse(head), " ") + 1).otherwise(0)
        behind = F.substring(s["text"], s["end"] + AROUND + 1, F.length(s["text"]))
        stop = F.when(F.instr(behind, " ") > 0, s["end"] + AROUND + F.instr(behind, " ") - 1).otherwise(F.length(s["text"]))
        front, back = F.when(begin > 0, "…").otherwise(""), F.when(stop < F.length(s["text"]), "…").otherwise("")
        whole = F.concat(front, F.substring(s["text"], begin + 1, stop - begin), back)
        near = F.struct(whole.alias("text"), (s["start"] - begin + F.length(front)).cast("int").alias("start"), (s["end"] - begin + F.length(front)).cast("int").alias("end"))
        return F.when(F.length(s["text"]) <= MOST_SENTENCE, F.struct(s["text"].alias("text"), s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"))).otherwise(near)

    # Filtered in place, as a condition on the sentence would compute it once more for each mention.
    return F.get(F.filter(F.transform(F.transform(F.array(tidy), placed), cut), lambda s: s["text"] != ""), F.lit(0))
