"""Plans: what reaches the scan, and what must not be in them."""

import pytest
from pyspark.sql import functions as F

from alertloom.operators import read, stats, timeline
from alertloom.plans import fixtures as fx, load
from alertloom.sources import dims, sinks

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("alerts") / "t")
    sinks.write_alerts(fx.alerts(spark, SF), path)
    return spark.read.parquet(path)


def test_period_prunes_folders_and_columns(table):
    plan = _plan(stats.counts(table, "7d", fx.AS_OF))
    assert "PartitionFilters: [isnotnull(event_date" in plan
    assert "PushedFilters: [IsNotNull(timestamp), GreaterThanOrEqual(timestamp" in plan
    assert "ReadSchema: struct<timestamp:timestamp_ntz,classification:string>" in plan


def test_page_is_a_top_k(table):
    plan = _plan(read.alerts_page(table, fx.AS_OF, "CRITICAL", None, "30d"))
    assert "TakeOrderedAndProject" in plan and "EqualTo(classification,CRITICAL)" in plan


def test_pruned_counts_equal_unpruned(spark, table):
    raw = fx.alerts(spark, SF)
    for period in ("today", "yesterday", "7d", "all"):
        assert stats.counts(table, period, fx.AS_OF).collect() == stats.counts(raw, period, fx.AS_OF).collect()


def test_interface_file_keeps_line_order(spark, tmp_path):
    path = tmp_path / "map.txt"
    path.write_text("".join(f"H | Te{i % 7} | v{i} | BE{i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = {r.interface: r.description for r in dims.load_interface_dim(spark, str(path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {f"Te{k}": f"v{max(i for i in range(5000) if i % 7 == k)}" for k in range(7)}


def test_windows_are_cut_into_chunks(spark):
    df = spark.range(10).select((F.col("id") % 3).alias("k"), F.col("id").alias("us"), F.col("id").alias("seq"))
    plan = _plan(timeline.count_recent(df, ["k"], 5, "n"))
    assert "Exchange hashpartitioning(k#" in plan and "chunk" in plan
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan


def test_every_query_has_a_check():
    reg = load()
    assert set(reg.CHECKS) == set(reg.QUERIES)
    wanted = ([f"s{i}" for i in range(1, 10)] + [f"p{i}" for i in range(1, 26)] + [f"d{i}" for i in range(1, 6)]
              + [f"c{i}" for i in range(1, 12)] + [f"r{i}" for i in range(1, 10)] + [f"n{i}" for i in range(1, 13)]
              + [f"a{i}" for i in range(1, 23)] + [f"q{i}" for i in range(1, 5)])
    assert not [w for w in wanted if not any(n.split("_")[0] == w for n in reg.QUERIES)]
