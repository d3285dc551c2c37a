"""Confident matches against a plain loop."""

import math
import random

from folioscope.operators import retrieval


def test_confident_matches_multiply_blocks(spark, monkeypatch):
    """Copies, vectors of another length, with nulls and without end; pairs are not rows of a join."""
    rng = random.Random(4)
    rows = [(k, [rng.choice((-1.0, 0.25, 0.5, 1.0)) for _ in range(4)]) for k in range(1200)] + [(100 * k, [1.0, 0.5, 0.5, 1.0]) for k in range(12, 24)]
    odd = [(3001, [1.0, 0.5]), (3100, [1.0, 0.5]), (3200, None), (3301, [1.0, None, 0.5, 1.0]), (3400, [0.0] * 4), (None, [1.0] * 4), (7, [1.0] * 4)]

    def told(rows):
        norm = lambda v: math.sqrt(sum(x * x for x in v))
        out = {}
        for q, a in rows:
            for k, b in rows:
                if q is None or k is None or q % 100 or q == k:
                    continue
                known = a and b and len(a) == len(b) and None not in a + b
                out.setdefault(q, []).append((-round(sum(x * y for x, y in zip(a, b)) / max(norm(a) * norm(b), 1e-12), 6) if known else math.inf, k))
        return {q: (min(s)[1], None if min(s)[0] == math.inf else -min(s)[0]) for q, s in out.items()}

    monkeypatch.setattr(retrieval, "ASK_BLOCK", 5)
    monkeypatch.setattr(retrieval, "LEAST_BLOCK", 200)
    for some in (rows, rows + odd):
        out = retrieval.confident_matches(spark.createDataFrame(some, "vec_id long, embedding array<float>"))
        assert {r.query_id: (r.vec_id, r.score) for r in out.collect()} == told(some)
        if some is rows:
            assert "zip_with" not in out._jdf.queryExecution().optimizedPlan().toString()
