"""Queries that must do the whole of their operator's job."""

from trailweave.plans import domain
from trailweave.plans.domain import contained_support, prefixspan
from trailweave.plans.tracks import contiguous_support, knn_radius, sequence_rows

DIR = "/root/testdata/sf0.001"


def held(sequence, pattern):
    at = iter(sequence)
    return all(r in at for r in pattern)


def test_contained_support_takes_every_run(spark):
    seqs = [tuple(r.regions) for r in sequence_rows(spark, DIR).collect()]
    runs = {s[i : i + n] for s in seqs for i in range(len(s)) for n in range(2, min(10, len(s) - i) + 1)}
    want = {"-".join(map(str, p)): sum(held(s, p) for s in seqs) for p in runs}
    got = {r.pattern: r.support for r in contained_support(spark, DIR).collect()}
    assert len(runs) > 50 and got == want


def test_neighbours_across_rows_of_points(spark):
    """Points lie in rows 30 m apart, so neighbours in other rows are beyond 15 m."""
    far = [r.distance_m for r in knn_radius(spark, DIR).collect()]
    assert 30 < max(far) <= 60


def test_long_patterns(spark, monkeypatch):
    seqs = [r.regions for r in sequence_rows(spark, DIR).collect()]
    want = {"-".join(map(str, s[i : i + n])) for s in seqs for i in range(len(s)) for n in range(2, min(10, len(s) - i) + 1)}
    assert max(map(len, seqs)) > 4 and {r.pattern for r in contiguous_support(spark, DIR).collect()} == want
    rows = spark.createDataFrame([([1, 2, 3, 4, 5, 6],)] * 10, "regions array<int>")
    monkeypatch.setattr(domain, "sequence_rows", lambda spark, sf: rows)
    assert "1-2-3-4-5-6" in {r.pattern for r in prefixspan(spark, DIR).collect()}
