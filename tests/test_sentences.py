"""Sentences and the sentence of a word, by example and against plain loops."""

import re

from pyspark.sql import functions as F

from folioscope.operators import sentences as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_abbreviations_and_initials_stay_inside(spark):
    text = "Fig. 2 | Model performance. S.L.H., M. Hüser and X.L. designed it, as in Smith et al. 2019. The panel ends at a."
    assert one(spark, S.sentences(F.lit(text))) == ["Fig. 2 | Model performance.", "S.L.H., M. Hüser and X.L. designed it, as in Smith et al. 2019.", "The panel ends at a."]
    assert one(spark, S.sentences(F.lit("One! Two?  \"Three.\" and on.\nFour\n\nFive e.g. six. 七。八！")) ) == ["One!", "Two?", '"Three." and on.', "Four", "Five e.g. six.", "七。", "八！"]
    assert one(spark, S.sentences(F.lit(""))) == [] and one(spark, S.sentences(F.lit("  \n "))) == [] and one(spark, S.sentences(F.lit(None).cast("string"))) is None


def test_numbers_of_a_list_stay_with_their_sentence(spark):
    assert one(spark, S.with_markers(S.sentences(F.lit("1. A skill-spanning scenario suite. It covers patient cases. 2) Next. 3.")))) == ["1. A skill-spanning scenario suite.", "It covers patient cases.", "2) Next.", "3."]


def test_breaks(spark):
    caption = "Fig. 2 | Model performance. a, Receiver curves. b, Precision."
    assert [caption[:k] for k in one(spark, S.sentence_breaks(F.lit(caption)))] == ["Fig. 2 | Model performance.", "Fig. 2 | Model performance. a, Receiver curves.", caption]
    text = "A 1.5 b: c! d? M. e.g. x. End"
    plain = [m.end() for m in re.finditer(r"[.:!?](?=\s|$)", text) if not re.search(r"(?i)\b(?:e\.g|al)\.$", text[: m.end()]) and not re.search(r"(?:^|\s)[A-Z]\.$", text[: m.end()])]
    assert one(spark, S.sentence_breaks(F.lit(text))) == plain


def marked(spark, text, word):
    at = text.index(word)
    r = one(spark, S.example_sentence(F.lit(text), F.lit(at), F.lit(at + len(word))))
    assert len(r.text) < 400
    return f"{r.text[: r.start]}[{r.text[r.start : r.end]}]{r.text[r.end :]}"


def test_sentence_of_a_word(spark):
    assert marked(spark, "Results\nLactate rose before the event. This indicates that perfusion was failing early. Later values were normal.", "indicates") == "This [indicates] that perfusion was failing early."
    assert marked(spark, "Monitoring was intermit- tent in the first hours of the stay.", "first") == "Monitoring was intermittent in the [first] hours of the stay."
    assert marked(spark, "Monitoring  was\tintermit-  tent at first", "intermit-  tent") == "Monitoring was [intermittent] at first"
    assert marked(spark, "Sepsis was rare. Shock was common in this cohort.", "cohort") == "Shock was common in this [cohort]."
    assert marked(spark, "😀 one two. 😀 Three", "Three") == "😀 [Three]"
    assert one(spark, S.example_sentence(F.lit("Nothing here."), F.lit(99), F.lit(100))) is None and one(spark, S.example_sentence(F.lit(None).cast("string"), F.lit(0), F.lit(1))) is None


def test_long_sentence_is_cut_around_the_word(spark):
    filler = " ".join(f"term{k}" for k in range(60))
    text = f"{filler} pivotal {filler} end."
    got = marked(spark, text, "pivotal")
    assert got.startswith("…") and got.endswith("…") and "[pivotal]" in got
    at = text.index("pivotal")
    low, high = text.rfind(" ", 0, at - 160 + 1) + 1, text.find(" ", at + 7 + 160)
    assert got == f"…{text[low:at]}[pivotal]{text[at + 7 : high]}…"
