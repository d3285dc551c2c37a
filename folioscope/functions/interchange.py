"""Formats that records come in and go out as: front matter, canvas, feeds, provider JSON, BibTeX."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FRONT = "title string, tags array<string>, created string"
PAPER = "title string, authors array<struct<name:string>>, year int, doi string"
# Keys of settings that an export leaves out, and paths that it hides.
SENSITIVE_KEY = r"(?i)api[_-]?key|secret|password|auth|credential|private[_-]?key"
LOCAL_PATH, HIDDEN = r"/(Users|home|private|var|tmp)/[^\s\"'`]+", "[redacted-path]"


def front_matter(title: Column, tags: Column, created: Column, body: Column) -> Column:
    """A Markdown note whose front matter is one JSON object."""
    head = F.to_json(F.struct(title.alias("title"), tags.alias("tags"), created.alias("created")))
    return F.concat(F.lit("---\n"), head, F.lit("\n---\n"), body)


def parsed_front_matter(note: Column) -> tuple[Column, Column, Column]:
    """Front matter, body, and what is wrong: ``missing`` without a block, ``malformed`` if it is no object."""
    pattern = r"(?s)\A---\n(.*?)\n---\n(.*)\z"
    head, body = F.regexp_extract(note, pattern, 1), F.regexp_extract(note, pattern, 2)
    has = note.rlike(pattern)
    fault = F.when(note.isNull(), F.lit(None).cast("string")).when(~has, "missing").when(F.try_parse_json(head).isNull() | ~head.startswith("{"), "malformed")
    return F.when(fault.isNull(), F.from_json(head, FRONT)), F.when(has, body).otherwise(note), fault


def redacted(text: Column) -> Column:
    """The text without local paths."""
    return F.regexp_replace(text, LOCAL_PATH, HIDDEN)


def sanitised(settings: Column) -> Column:
    """A map of settings without keys that must not travel, and without local paths in the others."""
    return F.transform_values(F.map_filter(settings, lambda k, v: ~k.rlike(SENSITIVE_KEY)), lambda k, v: redacted(v))


def bibtex_escaped(value: Column) -> Column:
    return F.regexp_replace(value, r"([\\{}])", r"\\$1")


def bibtex(key: Column, title: Column, authors: Column, year: Column, venue: Column, doi: Column, arxiv: Column, tags: Column) -> Column:
    """An entry of up to eight fields; unknown and empty ones are left out."""
    held = lambda value: value.isNotNull() & (value != "")
    field = lambda name, value: F.when(held(value), F.concat(F.lit(f"  {name} = {{"), value, F.lit("}")))
    joined = lambda values, by: F.array_join(F.transform(values, bibtex_escaped), by)
    fields = [
        F.concat(F.lit("  title = {"), bibtex_escaped(F.coalesce(title, F.lit(""))), F.lit("}")), field("author", joined(authors, " and ")), field("year", year.cast("string")), field("journal", bibtex_escaped(venue)),
        field("doi", bibtex_escaped(doi)), field("eprint", bibtex_escaped(arxiv)), F.when(held(arxiv), "  archivePrefix = {arXiv}"), field("keywords", joined(tags, ", ")),
    ]
    return F.concat(F.lit("@article{"), key, F.lit(",\n"), F.array_join(F.array_compact(F.array(*fields)), ",\n"), F.lit("\n}"))


# A bullet of a keyword answer.
KEYWORD_LINE = r"^\s*(?:[-*+]|\d+[.)])\s+\*\*([^*]+?)\s*(?:[:：]\s*\*\*|\*\*\s*[:：—–-])\s*(.+?)\s*$"


def keyword_entry(line: Column) -> Column:
    """struct(term, definition) of a line ``- **term**: definition`` (the colon inside or outside, or a dash); null for any other."""
    part = lambda k: F.trim(F.regexp_extract(line, KEYWORD_LINE, k))
    return F.when((part(1) != "") & (part(2) != ""), F.struct(part(1).alias("term"), part(2).alias("definition")))


def atom_entry(id_: Column, title: Column, author: Column, published: Column) -> Column:
    escape = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    return tag("entry", F.concat(tag("id", id_), tag("title", escape(title)), tag("author", tag("name", escape(author))), tag("published", published)))


def parsed_atom_entry(entry: Column) -> Column:
    """struct(id, title, author, year) of a feed's entry, which is parsed once."""
    # A character that no XML document can hold, and the paths of the fields.
    apart, paths = "\ufffe", ("/entry/id", "/entry/title", "/entry/author/name", "/entry/published")
    told = F.split(F.xpath_string(entry, F.lit("concat({})".format(f", '{apart}', ".join(paths)))), apart)

    def fields(x: Column) -> Column:
        id_, title, author, published = (F.get(x, F.lit(k)) for k in range(len(paths)))
        return F.struct(id_.alias("id"), title.alias("title"), author.alias("author"), F.substring(published, 1, 4).try_cast("int").alias("year"))

    return F.get(F.transform(F.array(told), fields), F.lit(0))


def uniform_paper(raw: Column) -> Column:
    """struct(title, authors, year, doi) of any of three providers' records; null without a title."""
    first = F.from_json(raw, PAPER + ", externalIds struct<DOI:string>")
    second = F.from_json(raw, "title array<string>, author array<struct<given:string,family:string>>, DOI string, issued struct<`date-parts`:array<array<int>>>")
    third = F.from_json(raw, "display_name string, publication_year int, doi string, authorships array<struct<author:struct<display_name:string>>>")
    crossref = F.get_json_object(raw, "$.DOI").isNotNull()
    openalex = F.get_json_object(raw, "$.display_name").isNotNull()
    named = F.transform(second["author"], lambda a: F.concat_ws(" ", a["given"], a["family"]))
    shown = F.transform(third["authorships"], lambda a: a["author"]["display_name"])
    plain = F.transform(first["authors"], lambda a: a["name"])
    title = F.when(crossref, F.get(second["title"], F.lit(0))).when(openalex, third["display_name"]).otherwise(first["title"])
    authors = F.when(crossref, named).when(openalex, shown).otherwise(plain)
    year = F.when(crossref, F.get(F.get(second["issued"]["date-parts"], F.lit(0)), F.lit(0))).when(openalex, third["publication_year"]).otherwise(first["year"])
    doi = F.when(crossref, second["DOI"]).when(openalex, F.regexp_replace(third["doi"], "^https://doi.org/", "")).otherwise(first["externalIds"]["DOI"])
    return F.when(title.isNotNull() & (F.trim(title) != ""), F.struct(title.alias("title"), authors.alias("authors"), year.alias("year"), F.lower(doi).alias("doi")))
