"""Lines, boxes, numbers of equations, alignment and reuse against plain loops."""

import random

from folioscope.operators import pages


def boxes(rng, n, span=600, size=120):
    return [(rng.randrange(4), k, float(rng.randrange(span)), float(rng.randrange(span)), float(rng.randrange(size)), float(rng.randrange(size))) for k in range(n)]


BOX = "page long, {} long, x double, y double, width double, height double"


def test_source_lines(spark):
    rng = random.Random(1)
    items = [(p, k, x, float(rng.randrange(8) * 14 + rng.randrange(4)), w / 2, 12.0) for p, k, x, _, w, _ in boxes(rng, 200)]
    want, lines = {}, {}
    for p in range(4):
        n, last = -1, None
        for r in sorted((r for r in items if r[0] == p), key=lambda r: (r[3], r[2], r[1])):
            same = last is not None and abs(last[3] - r[3]) <= max(last[5], r[5]) * 0.75 and max(0, r[2] - last[2] - last[4]) <= 600 * 0.25
            n += not same
            want[p, r[1]] = n
            lines.setdefault((p, n), []).append(r)
            last = r
    df = spark.createDataFrame(items, BOX.format("item"))
    rows, told = pages.source_lines(df, ["page"], "item", 600.0)
    assert {(r.page, r.item): r.line for r in rows.collect()} == want
    assert {(r.page, r.line): (r["items"], r.x, r.y, r.x + r.width, r.y + r.height) for r in told.collect()} == {
        k: (len(own), min(r[2] for r in own), min(r[3] for r in own), max(r[2] + r[4] for r in own), max(r[3] + r[5] for r in own)) for k, own in lines.items()
    }
    assert pages.source_lines(df.limit(0), ["page"], "item", 600.0)[1].count() == 0


def test_inside(spark):
    rng = random.Random(2)
    small, large = boxes(rng, 150, size=30), boxes(rng, 40, size=300) + [(0, 99, 100.0, 100.0, 0.0, 0.0)]
    small += [(0, 900, 100.0, 100.0, 0.0, 0.0), (0, 901, -30.0, -30.0, 10.0, 10.0)]
    large += [(0, 98, -100.0, -100.0, 120.0, 120.0)]
    want = sorted((p, c, b) for p, c, x, y, w, h in large for q, b, i, j, k, m in small if p == q and x <= i + k / 2 <= x + w and y <= j + m / 2 <= y + h)
    got = pages.inside(spark.createDataFrame(small, BOX.format("box")), spark.createDataFrame(large, BOX.format("container")), "page")
    assert sorted(tuple(r) for r in got.collect()) == want and (0, 99, 900) in want and (0, 98, 901) in want


def test_equation_numbers(spark):
    rng = random.Random(3)
    equations = boxes(rng, 60)
    others = [(p, rng.choice(["(1)", " (22) ", "(x)", "(3) and", None]), x, y, h) for p, _, x, y, _, h in boxes(rng, 300, size=30)]
    want = {}
    for p, e, x, y, w, h in equations:
        near = [(nx, t.strip()) for q, t, nx, ny, nh in others if q == p and t in ("(1)", " (22) ") and nx >= x + w and nx - x - w <= 150 and abs(ny + nh / 2 - y - h / 2) <= h]
        if near:
            want[p, e] = min(near)[1]
    got = pages.equation_numbers(spark.createDataFrame(equations, BOX.format("equation")), spark.createDataFrame(others, "page long, content string, x double, y double, height double"), "page", 600.0)
    assert {(r.page, r.equation): r.number for r in got.collect()} == want and len(want) > 10


def test_alignment(spark):
    items = ["Patient currently not in circulatory failure: if MAP is above 65 mmHg.", "Patient currently in circulatory failure: MAP is at most 65 mmHg.", "A third paragraph, that goes on with several words; it has a long middle part and it ends with this."]
    said = [
        (1, 0, "b", items[1]), (1, 1, "b", items[0]), (1, 2, "b", "Short."), (1, 3, "c", "Nothing of this is to be found anywhere."), (1, 4, "d", "XX third paragraph, that goes on with several words; it has a long middle part"), (1, 5, "d", None),
        (2, 0, "x", "No paragraphs here at all."), (3, 0, "y", items[2]),
    ]
    paragraphs = [(1, k * 10, t) for k, t in enumerate(items)] + [(3, 5, None), (3, 6, items[2]), (4, 0, "alone")]
    got = pages.aligned_sentences(spark.createDataFrame(said, "page long, turn long, block string, text string"), spark.createDataFrame(paragraphs, "page long, place long, text string"), "page")
    assert {(r.page, r.turn): r.paragraph for r in got.collect()} == {(1, 0): 10, (1, 1): 0, (1, 2): 0, (1, 3): None, (1, 4): 20, (1, 5): 20, (2, 0): None, (3, 0): 6}


def test_reuse(spark):
    units = [(1, "a", "Same  text"), (1, "b", "Moved [here](http://x)"), (1, "c", "New"), (2, "a", "x"), (2, "b", "y"), (3, "a", "x"), (4, "a", "q")]
    cached = [(1, 0, "a", "Same text", "A"), (1, 1, "a", "Same text", "A2"), (1, 2, "z", "Moved here", "B"), (1, 3, "c", "Old", "C"), (2, 0, "a", "x", "X"), (2, 1, "b", "y", "Y"), (3, 0, "a", "x", " Translation "), (5, 0, "a", "x", "X")]
    told, complete = pages.reused_translations(spark.createDataFrame(units, "page long, unit string, source string"), spark.createDataFrame(cached, "page long, turn long, unit string, source string, translation string"), "page")
    assert sorted(tuple(r) for r in told.collect()) == [(1, "a", "A"), (1, "b", "B"), (2, "a", "X"), (2, "b", "Y")]
    assert {r.page: r.complete for r in complete.collect()} == {1: False, 2: True, 3: False, 4: False}
