import numpy as np
import pytest
from pyspark.sql import functions as F

from trailweave.llm.quality import NAMES, fit, held_out, op5_quality, score_quality, statistics

SCHEMA = "doc_id long, text string, score string, lang string"


def test_flat_arrays_equal_a_walk_by_hand():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, len(NAMES))).astype(np.float32)
    y = ((x[:, 3] > 0.2) ^ (x[:, 7] > -0.1)).astype(float)
    model = fit(x, y, trees=15)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.97
    for row in x[:20]:
        total = model.base
        for at in model.roots:
            while model.left[at] != at:
                at = model.left[at] if row[model.feature[at]] <= model.threshold[at] else model.right[at]
            total += model.value[at]
        assert model.score(row[None])[0] == pytest.approx(1 / (1 + np.exp(-total)))


def test_statistics_of_odd_texts():
    for text in (None, "", " ", "\n\n", "!", "一", "a" * 100_000, "\x00"):
        assert np.isfinite(statistics(text)).all()


def test_held_out_accuracy(spark):
    dir_ = "/root/testdata/sf0.01"
    got = op5_quality(spark, dir_).join(spark.read.parquet(f"{dir_}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(got) > 50
    assert np.mean([r.predicted == r.quality for r in got]) > 0.95


def test_nulls_no_labels_and_clashing_names(spark):
    rows = [(1, None, "s", "en"), (None, "", "t", None), (3, "word " * 50, None, "fr"), (3, "word " * 50, None, "fr")]
    docs = spark.createDataFrame(rows, SCHEMA)
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    got = score_quality(docs, none).collect()
    assert [r.score for r in got] == [0.5] * 4 and {r.predicted for r in got} == {1}
    assert score_quality(spark.createDataFrame([], SCHEMA), none).collect() == []
    import zlib

    ids = spark.range(50).select(held_out(F.col("id")).alias("h"), "id").collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in ids)


def test_query_equals_plain_recomputation(spark):
    """Scores of every row of the test documents from statistics, labels and trees walked one row at a time."""
    import zlib

    dir_ = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{dir_}/documents.parquet").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{dir_}/labels.parquet").collect() if r.doc_id is not None and r.quality in (0, 1)}
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1
    order = {r.i: r.h for r in spark.createDataFrame([(i,) for i in labels], "i long").select("i", F.xxhash64("i").alias("h")).collect()}
    known = sorted(((order[i], i, t) for i, t in docs if i in labels and not out(i)), key=lambda k: k[:2])
    model = fit(np.stack([statistics(t) for _, _, t in known]), np.array([labels[i] for _, i, _ in known], float))
    want = {}
    for i, t in docs:
        x, total = statistics(t), model.base
        for at in model.roots:
            while model.left[at] != at:
                at = model.left[at] if x[model.feature[at]] <= model.threshold[at] else model.right[at]
            total += model.value[at]
        want[i] = 1 / (1 + np.exp(-total))
    got = op5_quality(spark, dir_).collect()
    assert len(got) == len(docs) and all(r.held_out == out(r.doc_id) and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.score == pytest.approx(want[r.doc_id], abs=1e-9) for r in got)
