import random

from pyspark.sql import functions as F

from lakesearch.operators import metrics
from lakesearch.operators.positions import dense_positions, running_offset


def reference_percentile(values, p):
    ordered = sorted(values)
    return ordered[min(int(len(ordered) * p), len(ordered) - 1)] if ordered else 0.0


def test_summary_with_a_hot_group(spark):
    rng = random.Random(1)
    rows = [("hot", rng.choice([1.0, 2.5, 7.0])) for _ in range(2000)]
    rows += [("hot", rng.random()) for _ in range(500)] + [("one", 4.0)]
    rows += [("four", float(v)) for v in (1, 2, 3, 4)] + [(None, 9.0), (None, 3.0)]
    samples = spark.createDataFrame(rows, "g string, v double")
    wanted = {"p29": 0.29, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = {r.g: r for r in metrics.latency_summary(samples, ["g"], "v", wanted).collect()}
    for group in ("hot", "one", "four", None):
        values = [v for g, v in rows if g == group]
        row = got[group]
        assert (row.samples, row.min, row.max) == (len(values), min(values), max(values))
        assert abs(row["mean"] - sum(values) / len(values)) < 1e-9
        for name, p in wanted.items():
            assert row[name] == reference_percentile(values, p), (group, name)
    assert got["four"].p50 == 3.0


def test_empty_summary_reads_zero(spark):
    none = spark.createDataFrame([], "v double")
    row = metrics.summary_or_zero(metrics.latency_summary(none, [], "v")).first()
    assert row.samples == 0 and row["mean"] == row.p50 == row.p99 == row.max == 0.0


def test_cyclic_workload(spark):
    queries = metrics.workload_queries(spark, 30, repo_id=4).orderBy("query_id").collect()
    assert [r.text for r in queries] == (metrics.WORKLOAD_QUERIES * 2)[:30]
    assert {(r.repo_id, r.k) for r in queries} == {(4, 10)}


def test_dense_positions_of_a_hot_group(spark):
    rows = [(1, i) for i in range(3000)] + [(g, i) for g in range(2, 30) for i in range(20)]
    random.Random(2).shuffle(rows)
    frame = spark.createDataFrame(rows, "g int, v int").repartition(7)
    placed = dense_positions(frame, ["g"], [F.col("v")], name="pos")
    assert placed.where("pos <> v").count() == 0 and placed.count() == len(rows)
    everywhere = dense_positions(frame, [], [-F.col("v"), F.col("g")], name="pos").collect()
    ordered = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert [(r.g, r.v) for r in sorted(everywhere, key=lambda r: r.pos)] == ordered


def test_running_offset_sums_earlier_rows(spark):
    rows = [(g, i, i % 5) for g in (1, 2) for i in range(500)]
    frame = spark.createDataFrame(rows, "g int, i int, w bigint")
    out = running_offset(frame, ["g"], [F.col("i")], F.col("w"), "before", "all").collect()
    for r in out:
        assert r.before == sum(i % 5 for i in range(r.i)) and r["all"] == 1000
