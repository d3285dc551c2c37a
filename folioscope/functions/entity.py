"""Normal forms of identifiers, titles and names, and scores between records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that say nothing in a title, and in a typed query.
TITLE_STOP_WORDS = ["a", "an", "and", "for", "in", "of", "on", "the", "to", "via", "with"]
QUERY_STOP_WORDS = ["and", "for", "the", "with", "논문", "연구", "관련", "찾아줘"]
# How DOIs that arXiv gives begin, and letters of a title that tells papers apart.
ARXIV_DOI, LEAST_TITLE = "10.48550/arxiv.", 12
# Weights and bounds of citation identity.
DICE_LEAST, TITLE_WEIGHT, TITLE_WEIGHT_ALONE, AUTHOR_BONUS, YEAR_BONUS, ACCEPT = 0.72, 0.75, 0.9, 0.15, 0.10, 0.78


def letters_only(text: Column) -> Column:
    """Lower case, everything but letters and digits as single blanks."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def title_key(text: Column) -> Column:
    """Letters and digits alone, in lower case."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def title_words(text: Column) -> Column:
    """Distinct words of a title that have two letters or more and are no stop words."""
    words = F.array_distinct(F.split(letters_only(text), " "))
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(TITLE_STOP_WORDS))


def dice(a: Column, b: Column) -> Column:
    """Twice the shared elements over all elements; 0 without any."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(0.0)).otherwise(2 * F.size(F.array_intersect(a, b)) / total)


def query_terms(text: Column) -> Column:
    """Distinct terms of a typed query in their order: three letters or more, two in Hangul alone, no stop words."""
    words = F.array_distinct(F.split(letters_only(text), " "))
    return F.filter(words, lambda w: ((F.length(w) >= 3) | w.rlike("^[가-힣]{2,}$")) & ~w.isin(QUERY_STOP_WORDS))


def doi(value: Column) -> Column:
    """A DOI without its resolver or prefix, in lower case; null if it is none."""
    bare = F.regexp_replace(F.lower(F.trim(value)), r"^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", "")
    bare = F.regexp_replace(bare, r"[.,;)]+$", "")
    return F.when(bare.rlike(r"^10\.[0-9]{4,9}/\S+$"), bare)


def arxiv_id(value: Column) -> Column:
    """An arXiv number from an id, a DOI or an address, without its version; null if there is none."""
    found = F.regexp_extract(F.lower(F.trim(value)), r"(?:^|arxiv[:./]|/abs/|/pdf/)([0-9]{4}\.[0-9]{4,5})(?:v[0-9]+)?(?:\.pdf)?$", 1)
    return F.when(found != "", found)


def candidate_doi(value: Column) -> Column:
    """The DOI of a candidate, without resolver or prefix and in lower case: whatever begins with ``10.``; else null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(value), r"(?i)^https?://(?:dx\.)?doi\.org/", ""), "(?i)^doi:", "")
    return F.when(F.startswith(bare, F.lit("10.")), F.lower(bare))


def candidate_arxiv(value: Column) -> Column:
    """The first arXiv number in a text, new (2401.00001) or old (hep-th/9901001), in lower case; else null."""
    found = F.regexp_extract(value, r"(?i)(?:arxiv\.org/(?:abs|pdf)/|arxiv:)?([0-9]{4}\.[0-9]{4,5}|[a-z-]+(?:\.[a-z-]+)?/[0-9]{7})", 1)
    return F.when(found != "", F.lower(found))


def arxiv_of_doi(doi: Column) -> Column:
    """The arXiv number of a DOI that arXiv gave; else null."""
    return F.when(F.startswith(doi, F.lit(ARXIV_DOI)), candidate_arxiv(F.substring(doi, len(ARXIV_DOI) + 1, 1 << 30)))


def flipped_name(name: Column) -> Column:
    """``Family, Given`` as ``Given Family``; other names trimmed."""
    parts = F.transform(F.split(name, ","), lambda part: F.trim(part))
    whole = (F.size(parts) == 2) & (F.get(parts, F.lit(0)) != "") & (F.get(parts, F.lit(1)) != "")
    return F.when(whole, F.concat_ws(" ", F.get(parts, F.lit(1)), F.get(parts, F.lit(0)))).otherwise(F.trim(name))


def citation_score(same_doi: Column, titles: Column, same_author: Column, same_year: Column) -> Column:
    """Identity of two records: 1 by DOI, else weighted by their titles; null below the bound."""
    known = same_author.isNotNull() | same_year.isNotNull()
    weighted = titles * F.when(known, TITLE_WEIGHT).otherwise(TITLE_WEIGHT_ALONE)
    weighted += F.when(same_author, AUTHOR_BONUS).otherwise(0.0) + F.when(same_year, YEAR_BONUS).otherwise(0.0)
    score = F.when(same_doi, F.lit(1.0)).when(titles >= DICE_LEAST, F.round(weighted, 9))
    return F.when(score >= ACCEPT, score)


def token_estimate(text: Column) -> Column:
    """Half the code points, at least one."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.coalesce(text, F.lit(""))) / 2)).cast("int")


def later(a: Column, b: Column) -> Column:
    """The later of two times, of which one may be unknown."""
    return F.greatest(a, b)


def longer(a: Column, b: Column) -> Column:
    """The longer of two texts; the first on a tie, the known one where one is unknown."""
    return F.when(b.isNull() | (F.length(a) >= F.length(b)), a).otherwise(b)


def url_key(url: Column) -> Column:
    """An address without fragment, tracking parameters, a leading www, a closing slash and its scheme, host in lower case."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    bare = F.regexp_replace(bare, r"([?&])(?:utm_[a-z]+|ref|fbclid|gclid)=[^&]*", "$1")
    bare = F.regexp_replace(bare, r"[?&]+$", "")
    bare = F.regexp_replace(bare, r"^[A-Za-z]+://(?:www\.)?", "")
    bare = F.regexp_replace(bare, r"/+$", "")
    host = F.substring_index(bare, "/", 1)
    return F.concat(F.lower(host), F.substring(bare, F.length(host) + 1, F.length(bare)))
