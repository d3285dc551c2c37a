"""Entries of reference lists in the text of papers.

Lists are cut out of the text, lists are cut into entries, and an entry's fields are
expressions over its pieces; each step is linear in the text (patterns are possessive or
bounded, author lists are found in one fold over the sentences of an entry).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How lists begin, how numbered ones go on, and what follows a list.
HEADING = r"\bR\s+E\s*F\s*E\s*R\s*E\s*N\s*C\s*E\s*S\b|\b(?:References|REFERENCES|Bibliography|BIBLIOGRAPHY)\b"
NUMBERED_START = r"^\s*(?:\[\d{1,3}\]|\d{1,3}\.)\s"
APPENDIX = r"\b[A-Z]\s+[A-Z]\s+[A-Z]{3,}\b"
BACK_MATTER = r"(?i)(?:^|[.)]\s+)(?:a\s?cknowledge?ments?|a\s?uthor\s+contributions|c\s?ompeting\s+interests|a\s?dditional\s+information|e\s?xtended\s+data\s+fig|p\s?ublisher[’']s\s+note|d\s?ata\s+availability|c\s?ode\s+availability)\b"
# The marks of entries, of figures and of the next entry inside one, and of years.
BRACKET, NUMBER = r"(?:^|\s)\[(\d{1,3})\](?=\s)", r"(?:^|\s)(\d{1,3})\.(?=\s)"
VISUAL = r"(?i)\s+(?:Figure|Fig\.?|Table|Tab\.?)\s+\d+\s*[:.]"
NEXT_ENTRY = r"\s+(?=[A-Z][^.!?]{2,180}\.\s+(?:19|20)\d{2}[a-z]?\.)"
YEAR = r"(?:^|[,.(]\s*|\s)((?:19|20)\d{2})[a-z]?(?=[.,;)\s]|$)"
AT_END = r"(?:,\s*|\.\s*)(20\d{2}[a-z]?)\.(?:\s+Accessed:\s*[^.]+\.)?(?=\s+[A-Z]|\s*$)"
_WORD = r"[A-Za-zÀ-ÖØ-öø-ÿ'-]++"
AUTHOR_YEAR = rf"([A-Z]{_WORD}(?:[\s,]++(?:and\s++)?+{_WORD}){{1,20}}+)\.\s+(20\d{{2}}[a-z]?)\.\s+([^.!?]{{8,240}})\."
# Characters of an entry, and the least of an entry and of a title.
MOST_ENTRY, LEAST_ENTRY, LEAST_TITLE = 900, 24, 8

FIELDS = ("key", "title", "authors", "year", "venue", "raw")


def _bare(value: Column) -> Column:
    """Blanks collapsed, marks at both ends gone."""
    return F.trim(F.regexp_replace(F.regexp_replace(value, r"\s+", " "), r"^[.,)\s]+|[.,(\s]+$", ""))


def _before(value: Column, pattern: str) -> Column:
    """What stands before the first match; all of it without one."""
    return F.split(value, pattern, 2)[0]


def _upto(value: Column, size: Column | int) -> Column:
    return F.substring(value, F.lit(1), size if isinstance(size, Column) else F.lit(size))


def _from(value: Column, at: Column) -> Column:
    """Behind so many characters."""
    return F.substring(value, at + 1, F.length(value))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


class _Entries:
    """An array of structs to which fields are added in steps, each computed once (columns would be merged into one another)."""

    def __init__(self, column: Column, *names: str):
        self.column, self.names = column, list(names)

    def with_fields(self, **fields) -> _Entries:
        kept = [n for n in self.names if n not in fields]
        out = F.transform(self.column, lambda s: F.struct(*(s[n].alias(n) for n in kept), *(f(s).alias(n) for n, f in fields.items())))
        return _Entries(out, *kept, *fields)

    def where(self, test) -> _Entries:
        return _Entries(F.filter(self.column, test), *self.names)

    def told(self, number: int, last_first: bool = False) -> Column:
        """Entries of a pass with their turns; of one key the last turn counts, or the first."""
        turn = lambda k: (-k if last_first else k).alias("turn")
        return F.transform(self.column, lambda s, k: F.struct(F.lit(number).alias("pass"), turn(k), *(s[c].alias(c) for c in FIELDS)))


def _zipped(**arrays: Column) -> _Entries:
    zipped = F.arrays_zip(*(a.alias(n) for n, a in arrays.items()))
    return _Entries(zipped, *arrays).with_fields(**{n: lambda s, n=n: s[n] for n in arrays})


def reference_lists(text: Column) -> Column:
    """The lists of a text, one under the other: each headed one that begins with a number, else what follows the last heading."""
    heads = F.regexp_extract_all(text, F.lit(f"({HEADING})"), F.lit(1))
    numbered = lambda piece: F.substring(piece, 1, 40).rlike(NUMBERED_START)

    def join(lists: Column, x: Column) -> Column:
        """A piece opens a list, or goes on with the one before."""
        longer = F.concat(F.slice(lists, 1, F.size(lists) - 1), F.array(F.concat(F.element_at(lists, -1), x["head"], x["piece"])))
        return F.when(numbered(x["piece"]), F.concat(lists, F.array(x["piece"]))).when(F.size(lists) > 0, longer).otherwise(lists)

    def lists_of(pieces: Column) -> Column:
        parts = F.arrays_zip(heads.alias("head"), F.slice(pieces, 2, F.size(pieces)).alias("piece"))
        named = F.transform(parts, lambda x: F.struct(x["head"].alias("head"), x["piece"].alias("piece")))
        opened = F.aggregate(named, F.array().cast("array<string>"), join)
        return F.when(F.size(pieces) < 2, F.array().cast("array<string>")).when(F.exists(named, lambda x: numbered(x["piece"])), opened).otherwise(F.array(F.element_at(pieces, -1)))

    ended = F.transform(_let(F.split(text, HEADING), lists_of), lambda s: F.trim(_before(_before(s, APPENDIX), BACK_MATTER)))
    return F.array_join(F.filter(ended, lambda s: s != ""), "\n")


def author_end(entry: Column) -> Column:
    """How many characters of an entry, its blanks collapsed, its author list takes; null if none can be told.

    A list ends at a full stop before a letter or bracket: behind initials only in a list
    of "Surname, I." that does not go on, else behind "et al.", behind a name that "and"
    leads to, or within the first three words.
    """
    zero = F.struct(F.lit(0).alias("size"), F.lit("").alias("tail"), F.lit(0).alias("words"), F.lit(False).alias("led"), F.lit(None).cast("int").alias("end"))

    def told(pieces: Column) -> Column:
        last = F.size(pieces)
        parts = F.transform(pieces, lambda p, k: F.struct(p.alias("piece"), F.when(k + 2 < last, F.concat(F.get(pieces, k + 1), F.lit(". "))).otherwise(F.get(pieces, k + 1)).alias("rest")))

        def step(s: Column, x: Column) -> Column:
            size = s["size"] + F.length(x["piece"]) + F.when(s["size"] > 0, 2).otherwise(1)
            tail = F.right(F.concat(s["tail"], F.when(s["tail"] != "", " ").otherwise(""), x["piece"], F.lit(".")), F.lit(300))
            words = s["words"] + F.size(F.split(x["piece"], r"\s+"))
            led = x["piece"].rlike(r"(?i)\band\s+[^.]+$") | (s["led"] & x["piece"].rlike(r"^[A-Z][^.]+$"))
            listed = tail.rlike(r"(?:^|[\s,&])[\p{L}'’-]+,\s*(?:\p{Lu}\.[\s-]*)*\p{Lu}\.$") & ~x["rest"].rlike(r"^(?:\p{Lu}\.(?:[\s,-]|$)|&\s|and\s|et\s+al\b)")
            ends = F.when(x["piece"].rlike(r"(?:^|\W)\p{Lu}$"), listed).otherwise(tail.rlike(r"(?i)\bet al\.$") | led | (words <= 3))
            end = F.coalesce(s["end"], F.when(ends, size))
            return F.struct(size.cast("int").alias("size"), tail.alias("tail"), words.cast("int").alias("words"), led.alias("led"), end.cast("int").alias("end"))

        return F.aggregate(F.slice(parts, 1, F.greatest(last - 1, F.lit(0))), zero, step, lambda s: s["end"])

    return _let(F.split(entry, r"\.\s+(?=[\p{L}(])"), told)


def _titled(rest: Column, following: str) -> tuple[Column, Column]:
    """The title that a remainder begins with, and what follows its full stop (empty if it is all)."""
    size = F.length(_before(rest, rf"\.\s+(?={following})"))
    cut = (size >= LEAST_TITLE) & (size < F.length(rest))
    return F.when(cut, _upto(rest, size)).otherwise(rest), F.when(cut, _from(rest, size + 1)).otherwise("")


def _shortened(body: Column) -> Column:
    """An entry's text up to a figure or to another entry; the longest allowed, at a sentence's end where there is one."""
    visual = F.length(_before(body, VISUAL))
    following = F.length(_before(F.substring(body, 12, 1 << 30), NEXT_ENTRY)) + 11
    cut = _upto(body, F.least(F.when(visual > 80, visual), following, F.length(body)))

    def short(own: Column) -> Column:
        back = F.reverse(_upto(own, MOST_ENTRY + 2))
        sentence = MOST_ENTRY + 2 - F.instr(back, " .") - 1
        ends = (F.instr(back, " .") > 0) & (sentence > 40)
        return F.when(F.length(own) <= MOST_ENTRY, own).when(ends, _upto(own, sentence + 1)).otherwise(_upto(own, MOST_ENTRY))

    return _let(cut, short)


def _numbered() -> Column:
    """Entries behind ``[1]`` or, where no bracket is, ``1.``"""
    flat = F.col("flat")
    by = lambda pattern: _zipped(key=F.regexp_extract_all(flat, F.lit(pattern), F.lit(1)), body=F.slice(F.split(flat, pattern), 2, 1 << 30))
    pairs = F.when(flat.rlike(r"\[\d{1,3}\]\s+"), by(BRACKET).column).otherwise(by(NUMBER).column)
    entries = _Entries(pairs, "key", "body").with_fields(body=lambda s: _shortened(F.ltrim(s["body"])))
    entries = entries.with_fields(raw=lambda s: _bare(F.concat(F.lit("["), s["key"], F.lit("] "), s["body"]))).where(lambda s: F.length(s["raw"]) >= LEAST_ENTRY)
    # The first year that a page number follows, else the last one; what stands before and behind it.
    paged = rf"(?is)^(.*?){YEAR}((?:[.,)\s]*\d{{1,3}}\s+[A-Za-z]).*)$"
    entries = entries.with_fields(form=lambda s: F.when(s["body"].rlike(paged), paged).otherwise(rf"(?is)^(.*){YEAR}(.*)$"))
    part = lambda s, k: F.call_function("regexp_extract", s["body"], s["form"], F.lit(k))
    entries = entries.with_fields(before=lambda s: F.regexp_replace(part(s, 1), r"(?:[,.(]\s*|\s)$", ""), year=lambda s: part(s, 2), behind=lambda s: part(s, 3))
    entries = entries.with_fields(after=lambda s: _bare(s["behind"]))
    closes = lambda a: (F.length(a) < 8) | a.rlike(r"^\d{1,3}\s+[A-Za-z]") | a.rlike(r"(?i)^[);\s]*(?:https?:|www\.|doi)")
    entries = entries.with_fields(closing=lambda s: (s["year"] != "") & closes(s["after"]))
    entries = entries.with_fields(names=lambda s: F.when(s["closing"], F.regexp_replace(s["before"], r"\([^()]*$", "")).otherwise(s["body"]))
    entries = entries.with_fields(cut=lambda s: F.when(s["closing"], author_end(s["names"])))
    opening = lambda s: (s["year"] != "") & ~s["closing"]
    entries = entries.with_fields(
        authors=lambda s: _bare(F.when(s["cut"].isNotNull(), _upto(s["names"], s["cut"])).when(opening(s), s["before"]).otherwise(F.substring_index(s["names"], ".", 1)))
    )
    entries = entries.where(lambda s: F.length(s["authors"]) >= 2)
    entries = entries.with_fields(
        rest=lambda s: _bare(F.when(s["cut"].isNotNull(), _from(s["names"], s["cut"])).when(opening(s), s["behind"]).otherwise(_from(s["names"], F.length(s["authors"]))))
    )
    entries = entries.with_fields(inside=lambda s: F.regexp_extract(s["rest"], r"^in\s+(.+)$", 1))
    place = lambda x: _bare(F.regexp_replace(F.regexp_replace(x, r"(?i)\s*\(eds?\.?.*$", ""), r"\s+(?:vol\.\s*\d+\s+)?\d+[–-]\d+$", ""))
    entries = entries.with_fields(place=lambda s: place(s["inside"]), titled=lambda s: F.struct(*_titled(s["rest"], "[A-Za-z0-9]")))
    entries = entries.with_fields(
        title=lambda s: F.when(s["inside"] != "", s["place"]).otherwise(F.regexp_replace(_bare(s["titled"]["col1"]), r"(?i)^\((?:eds?|editors?)\.?\)\s*", "")),
        venue=lambda s: F.when(s["inside"] != "", s["place"]).otherwise(_bare(s["titled"]["col2"])), year=lambda s: F.when(s["year"] != "", s["year"]).cast("int"),
    )
    return entries.where(lambda s: F.length(s["title"]) >= LEAST_TITLE).told(2)


def _surname(authors: Column, stops: str) -> Column:
    return F.element_at(F.split(F.trim(_before(authors, stops)), r"\s+"), -1)


def _author_year() -> Column:
    """Entries of the form "Names. 2020. Title."; of one key the first counts, and any other kind before it."""
    groups = {c: F.regexp_extract_all("lists", F.lit(AUTHOR_YEAR), F.lit(k)) for k, c in enumerate(("raw", "authors", "when", "title"))}
    entries = _zipped(**groups).with_fields(**{c: lambda s, c=c: F.trim(s[c]) for c in groups})
    entries = entries.with_fields(surname=lambda s: _surname(s["authors"], r"(?i),|\band\b"), year=lambda s: _upto(s["when"], 4).cast("int"), venue=lambda s: F.lit(""))
    entries = entries.with_fields(key=lambda s: F.lower(F.concat(s["surname"], F.lit("-"), s["when"])))
    return entries.where(lambda s: (s["surname"] != "") & (s["title"] != "")).told(1, last_first=True)


def _year_last() -> Column:
    """Entries that end with their year; of one key the last counts, before any other kind."""
    flat = F.col("flat")
    entries = _zipped(raw=F.split(flat, AT_END), when=F.regexp_extract_all(flat, F.lit(f"({AT_END})"), F.lit(2)), end=F.regexp_extract_all(flat, F.lit(f"({AT_END})"), F.lit(1)))
    entries = entries.where(lambda s: s["when"].isNotNull())  # what follows the last year is no entry
    entries = entries.with_fields(raw=lambda s: F.trim(F.regexp_replace(F.ltrim(F.concat(s["raw"], s["end"])), r"^(?:Preprint\s+)?\d{1,3}\s+", "")))
    entries = entries.where(lambda s: F.length(s["raw"]) >= LEAST_ENTRY).with_fields(cut=lambda s: author_end(s["raw"])).where(lambda s: s["cut"].isNotNull())
    entries = entries.with_fields(authors=lambda s: F.regexp_replace(F.trim(_upto(s["raw"], s["cut"])), r"\.$", ""), rest=lambda s: F.trim(_from(s["raw"], s["cut"])))
    entries = entries.with_fields(
        title=lambda s: F.trim(F.regexp_replace(_titled(s["rest"], "[A-Za-z]")[0], r",\s*20\d{2}[a-z]?\.$", "")),
        surname=lambda s: F.regexp_replace(_surname(s["authors"], r"(?i),|\band\b|\bet al\b"), r"[^\p{L}\p{N}'-]", ""), year=lambda s: _upto(s["when"], 4).cast("int"),
    )
    entries = entries.with_fields(
        key=lambda s: F.lower(F.concat(s["surname"], F.lit("-"), s["when"])), venue=lambda s: F.trim(F.regexp_replace(_from(s["rest"], F.length(s["title"])), r"^[.\s]+|,?\s*20\d{2}[a-z]?\.$", ""))
    )
    return entries.where(lambda s: (s["surname"] != "") & (F.length(s["title"]) >= LEAST_TITLE)).told(3)


def references(papers: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, key, title, authors, year, venue, raw): the entries of each paper's reference lists, one of each key.

    Numbered entries have their number as key, others the first author's surname and the
    year. Papers without text or list have no rows; papers have an id each.
    """
    # Generated, not filtered: a filter would look for the lists once more. All kinds of entries are told in one pass over the lists.
    some = F.filter(F.array(reference_lists(F.col(text))), lambda t: t != "")
    cut = papers.select(F.col(id_).alias("id"), F.explode(some).alias("lists"))
    lists = cut.withColumn("flat", F.trim(F.regexp_replace("lists", r"\s+", " ")))
    every = lists.select("id", F.inline(F.concat(*(F.coalesce(kind, F.array()) for kind in (_numbered(), _author_year(), _year_last())))))
    best = Window.partitionBy("id", "key").orderBy(F.desc("pass"), F.desc("turn"))
    one = every.withColumn("n", F.row_number().over(best)).where("n = 1")
    return one.select(F.col("id").alias(id_), *FIELDS)
