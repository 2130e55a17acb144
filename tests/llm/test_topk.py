import math
import random
from fractions import Fraction

import pytest

from trailweave.llm.topk import top_k

SCHEMA = "vec_id long, embedding array<double>, score string, rank int"


def brute(rows, k=20, every=20, scale=64):
    good = [(i, [math.floor(scale * Fraction(x)) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q % every == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in good if i != q and len(a) == len(b))[:k]
            out += [(q, n, i, max(-(1 << 63), min((1 << 63) - 1, -s))) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("group,levels", [(7, 256), (50, 4), (4096, 1), (4096, 16)])
def test_equals_brute_force(spark, group, levels):
    rng = random.Random(group)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(9)], "x", 1) for i in range(230)]
    rows += [(300 + i, rows[40][1], "tie", 0) for i in range(60)]
    rows += [(401, None, "", 0), (402, [1.0] * 8 + [None], "", 0), (403, [float("nan")] * 9, "", 0), (404, [float("inf")] * 9, "", 0), (400, [0.5, 0.5], "", 0), (405, [1.0, -1.0], "", 0), (None, [0.1] * 9, "", 0), (420, [], "", 0), (421, [], "", 0), (440, [900.0] * 9, "", 0)]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in top_k(spark.createDataFrame(rows, SCHEMA).repartition(3), group=group, levels=levels).collect())
    assert got == brute(rows)


def test_empty_few_and_huge(spark):
    assert top_k(spark.createDataFrame([], SCHEMA)).collect() == []
    assert [tuple(r) for r in top_k(spark.createDataFrame([(0, [1.0], "", 0), (1, [2.0], "", 0)], SCHEMA)).collect()] == [(0, 1, 1, 64 * 128)]
    rows = [(i, [2e6 * (i + 1), -2e6], "", 0) for i in range(5)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in top_k(spark.createDataFrame(rows, SCHEMA)).collect()) == brute(rows)


@pytest.mark.parametrize("most", [0.99e17, 1e17, 1e19, 1e200, 1.7e308])
def test_finite_components_of_any_size_take_part(spark, most):
    rng = random.Random(3)
    rows = [(i, [most * rng.choice([1, -1, 0.5]), rng.gauss(0, 1)], "", 0) for i in range(45)] + [(50 + i, [rng.gauss(0, 1), 0.25], "", 0) for i in range(30)]
    rows += [(90, [most, 2.0], "", 0), (91, [float("-inf"), 1.0], "", 0)]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in top_k(spark.createDataFrame(rows, SCHEMA).repartition(2), group=16).collect())
    assert got == brute(rows)


def test_many_copies_of_one_vector(spark):
    rng = random.Random(6)
    rows = [(i, [1.0, 2.0, 3.0], "", 0) for i in range(300)] + [(400 + i, [rng.gauss(0, 2) for _ in range(3)], "", 0) for i in range(100)] + [(20, [1.0, 2.0, 3.0], "", 0)] * 30 + [(7, [1.0, 2.0, 3.0], "", 0)] * 30
    rng.shuffle(rows)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in top_k(spark.createDataFrame(rows, SCHEMA).repartition(2), group=200).collect())
    assert got == brute(rows)
