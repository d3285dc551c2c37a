"""Quotes found again in texts that changed: by their letters, by their surroundings, by where they were printed."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.operators.beside import told_beside

#: What a compact form leaves out: white space and soft hyphens.
_BLANK = re.compile("[\t-\r \xa0  -     　﻿\xad]+")
# Characters of the surroundings that are compared.
NEAR = 128
# How far from its saved place a quote may be printed, how exactly saved lines fit, and letters of a quote that tells places apart.
FARTHEST, SETTLED, LEAST_LETTERS = 160.0, 1.5, 4

LOCATION = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
RELOCATION = T.StructType([T.StructField("status", T.StringType()), T.StructField("reason", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
BOX = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x", "y", "width", "height")])


class Mapped:
    """A normal form of a text that knows where each of its characters comes from: ``forms`` gives what a character becomes."""

    def __init__(self, text: str, forms):
        table = {c: forms(c) for c in set(text)}
        self.text = text.translate(str.maketrans(table))
        sizes = np.array([len(table[c]) for c in text], np.int64)
        self.offsets = np.repeat(np.arange(len(text)), sizes)

    def back(self, at: int, size: int) -> tuple[int, int]:
        """The part of the source (end exclusive) that some characters of the form come from."""
        return int(self.offsets[at]), int(self.offsets[at + size - 1]) + 1


def compact(character: str) -> str:
    return _BLANK.sub("", unicodedata.normalize("NFKC", character))


def letters(character: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKC", character).lower() if c.isalnum())


class _Page:
    """A text, and its forms once they are asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.form = None

    def located(self, quote: str | None) -> dict | None:
        if quote is None:
            return None
        at = self.text.find(quote)
        if at >= 0:
            return {"start": at, "end": at + len(quote)}
        wanted = "".join(map(compact, quote))
        if not wanted:
            return None
        self.form = self.form or Mapped(self.text, compact)
        at = self.form.text.find(wanted)
        return None if at < 0 else dict(zip(("start", "end"), self.form.back(at, len(wanted))))


def located(quotes: DataFrame, pages: DataFrame, key: str, quote: str, text: str) -> DataFrame:
    """``quotes`` with ``location`` (start, end in code points): where the quote stands in the text of its page, the first place; null if nowhere.

    Letter for letter, else with white space and soft hyphens left out and compatible
    characters, such as ligatures, spelled out on both sides; the place is mapped back.
    """
    held = pages.select(key, F.col(text).alias("text"))
    return told_beside(quotes, held, key, [quote], lambda h: _Page(h["text"]), lambda page, row: page.located(row[quote]), "location", LOCATION)


def _resolved(at: int, end: int) -> dict:
    return {"status": "resolved", "reason": None, "start": at, "end": end}


def _repair(reason: str) -> dict:
    return {"status": "needs_repair", "reason": reason, "start": None, "end": None}


def _relocated(note: dict, row: dict, marker: str, apart: bool = False) -> dict:
    text = note["text"] or ""
    low, high = 0, len(text)
    if row["block"] is not None:
        own = marker.format(row["block"])
        if text.count(own) != 1:
            return _repair("ambiguous" if own in text else "block_missing")
        low = text.index(own) + len(own)
        following = text.find(marker.split("{")[0], low)
        high = following if following >= 0 else high
    quote, was = row["quote"] or "", row["start"]
    same = note["revision"] is not None and note["revision"] == row["revision"]
    if same and was is not None and low <= was and was + len(quote) <= high and text[was : row["end"]] == quote:
        return _resolved(was, row["end"])
    found, reach, at = None, 0, text.find(quote, low) if quote else -1
    while 0 <= at and at + len(quote) <= high:
        end = at + len(quote)
        before, behind = row["prefix"] or "", row["suffix"] or ""
        if text[max(0, at - NEAR) : at].endswith(before) and text[end : end + NEAR].startswith(behind):
            if found is None:
                found, reach = at, end + len(behind)
            elif not apart or at - len(before) >= reach:
                return _repair("ambiguous")
        at = text.find(quote, at + 1)
    return _repair("missing") if found is None else _resolved(found, found + len(quote))


def relocated(fragments: DataFrame, notes: DataFrame, key: str, marker: str = "<!-- block:{} -->", apart: bool = False) -> DataFrame:
    """``fragments`` (block, revision, quote, prefix, suffix, start, end, ...) with ``place`` in their note (key, text, revision).

    A fragment belongs to the block behind its marker, if it names one, else to the whole
    note. In an unchanged note its old place stands; else the quote must stand in the block
    with its surroundings exactly once: ``resolved``, or ``needs_repair`` with the reason
    ``missing``, ``ambiguous`` or ``block_missing``. Offsets are in code points. With
    ``apart`` only places that share no character with the first, surroundings included,
    make a fragment ambiguous.
    """
    held = notes.select(key, "text", "revision")
    uses = ["block", "revision", "quote", "prefix", "suffix", "start", "end"]
    return told_beside(fragments, held, key, uses, lambda h: h, lambda note, row: _relocated(note, row, marker, apart), "place", RELOCATION)


class _Lines:
    """The lines of a page, and the letters that are printed on them."""

    def __init__(self, lines: list[dict] | None):
        self.lines = sorted(lines or [], key=lambda line: line["line"])
        self.form = Mapped("".join(line["text"] or "" for line in self.lines), letters)
        self.ends = np.cumsum([len(line["text"] or "") for line in self.lines])

    def boxes(self, start: int, end: int) -> list[dict]:
        """The parts of lines on which the characters from start to end stand."""
        out = []
        for k in range(int(np.searchsorted(self.ends, start, "right")), len(self.lines)):
            line, begins = self.lines[k], int(self.ends[k]) - len(self.lines[k]["text"] or "")
            if begins >= end:
                break
            size = int(self.ends[k]) - begins
            left, right = max(start, begins) - begins, min(end, int(self.ends[k])) - begins
            if size and right > left:
                out.append({"x": line["x"] + line["width"] * left / size, "y": line["y"], "width": line["width"] * (right - left) / size, "height": line["height"]})
        return out

    def nearest(self, quote: str | None, saved: list[dict] | None) -> list[dict] | None:
        wanted = "".join(map(letters, quote or ""))
        if len(wanted) < LEAST_LETTERS or not saved:
            return None
        middle = _middle(saved)
        best, at = None, self.form.text.find(wanted)
        while at >= 0:
            boxes = self.boxes(*self.form.back(at, len(wanted)))
            x, y = _middle(boxes)
            away = float(np.hypot(x - middle[0], y - middle[1]))
            if best is None or away < best[0]:
                best = away, boxes
            at = self.form.text.find(wanted, at + len(wanted))
        if best is None or best[0] > FARTHEST or _same(saved, best[1]):
            return None
        return best[1]


def _middle(boxes: list[dict]) -> tuple[float, float]:
    ends = lambda low, size: (min(b[low] for b in boxes) + max(b[low] + b[size] for b in boxes)) / 2
    return ends("x", "width"), ends("y", "height")


def _same(a: list[dict], b: list[dict]) -> bool:
    return len(a) == len(b) and all(abs(x[c] - y[c]) <= SETTLED for x, y in zip(a, b) for c in ("x", "y", "width", "height"))


def reprinted(anchors: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """``anchors`` (quote, saved boxes, ...) with ``boxes``: the lines of the page (key, line, text, x, y, width, height) on which the quote is printed nearest to its saved place.

    Letters and digits are compared. Null where the quote is printed nowhere within
    ``FARTHEST``, has too few letters, or where the saved boxes are right already. The lines
    of one page are gathered; a page is what one task reads.
    """
    pages = lines.groupBy(key).agg(F.collect_list(F.struct("line", "text", "x", "y", "width", "height")).alias("lines"))
    return told_beside(anchors, pages, key, ["quote", "saved"], lambda h: _Lines(h["lines"]), lambda page, row: page.nearest(row["quote"], row["saved"]), "boxes", T.ArrayType(BOX))
