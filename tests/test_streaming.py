"""Streams give what the batch operators give."""

import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from alertloom.functions import times
from alertloom.operators import dedup, parse, stats
from alertloom.plans import fixtures as fx, registry
from alertloom.session import materialize
from alertloom.sources import sinks, table
from alertloom.streaming import dedup as sdedup, ingest, live

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data missing")


@pytest.fixture(scope="module")
def rocks(spark):
    for k, v in sdedup.STATE_STORE.items():
        spark.conf.set(k, v)
    return spark


def _run(df, tmp, mode="append"):
    out, ck = str(tmp / "out"), str(tmp / "ck")
    q = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", ck).trigger(
        availableNow=True).start(out)
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(out)


def _files(df, path, parts, order):
    """Write ``df`` as ``parts`` files in event order."""
    rows = df.orderBy(order).collect()
    step = -(-len(rows) // parts)
    for i in range(parts):
        one = df.sparkSession.createDataFrame(rows[i * step:(i + 1) * step], df.schema).coalesce(1)
        one.write.mode("append").parquet(path)


def _stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(path)


@pytest.fixture(scope="module")
def enriched(rocks):
    return materialize(registry.enriched(rocks, SF), "test")


def test_dedup_stream_equals_batch(rocks, enriched, tmp_path):
    _files(enriched, str(tmp_path / "in"), 3, ["us", "seq"])
    got = _run(sdedup.should_notify_stream(_stream(rocks, str(tmp_path / "in"), enriched.schema)), tmp_path)
    want = {r.seq: (r.should_send, r.reason) for r in dedup.should_notify(enriched).collect()}
    assert {r.seq: (r.should_send, r.reason) for r in got.collect()} == want
    assert len({v[1] for v in want.values()}) >= 3


def test_dedup_stream_starts_from_saved_flap_state(rocks, enriched, tmp_path):
    rows = enriched.where("bundle_parent = ''")
    cut = rows.agg(F.expr("percentile_approx(us, 0.5)")).first()[0]
    state = dedup.flap_state(rows.where(F.col("us") < cut))
    late = rows.where(F.col("us") >= cut)
    _files(late, str(tmp_path / "in"), 2, ["us", "seq"])
    got = _run(sdedup.should_notify_stream(
        _stream(rocks, str(tmp_path / "in"), late.schema), flap_state=state), tmp_path)
    flapping = {r.seq for r in got.where("reason = 'flapping'").collect()}
    whole = dedup.bgp_flap(dedup._narrow(rows)).where("flap = 'flapping'").where(F.col("us") >= cut)
    assert flapping == {r.seq for r in whole.collect()}


def test_ingest_delivers_once(spark, tmp_path):
    body = '{"data":{"result":[{"values":[["1000000","a"],["2000000","b"],["2000000",""]]}]}}'
    again = '{"streams":[{"stream":{},"values":[["2000000","b"],["3000000","c"]]}]}'
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text(body + "\n")
    (tmp_path / "in" / "2.json").write_text(again + "\nnot json\n")
    ingest.run_ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"))
    (tmp_path / "in" / "3.json").write_text(again + "\n")
    ingest.run_ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"))
    rows = table.read(spark, str(tmp_path / "out")).select("ts_ns", "line").collect()
    assert sorted(map(tuple, rows)) == [(1000000, "a"), (2000000, "b"), (3000000, "c")]


def test_late_entries_go_to_their_own_table(spark, tmp_path):
    m = 60 * 10 ** 9
    batches = [[(20 * m, "a"), (1 * m, "b")], [(21 * m, "c"), (10 * m, "at the mark"), (20 * m, "a"), (1 * m, "b")],
               [(5 * m, "late"), (1 * m, "b"), (11 * m + 1000, "d"), (-90_000 * m, "long ago")], [(5 * m, "late"), (11 * m, "mark"), (11 * m + 1000, "d")]]
    (tmp_path / "in").mkdir()
    late, out, ck = (str(tmp_path / x) for x in ("late", "out", "ck"))
    for i, rows in enumerate(batches):
        values = ",".join(f'["{ns}","{line}"]' for ns, line in rows)
        (tmp_path / "in" / f"{i}.json").write_text('{"data":{"result":[{"values":[%s]}]}}\n' % values)
        ingest.run_ingest(spark, str(tmp_path / "in"), out, ck, "10 minutes", late)
    got = lambda path: sorted((r.ts_ns // m, r.line) for r in table.read(spark, path).collect())
    assert got(out) == [(1, "b"), (11, "d"), (20, "a"), (21, "c")]
    assert got(late) == [(-90_000, "long ago"), (5, "late"), (10, "at the mark"), (11, "mark")]


def test_a_batch_that_runs_again_decides_the_same(spark, tmp_path):
    out, late = str(tmp_path / "out"), str(tmp_path / "late")
    write = ingest._batch_writer(out, late, 600 * 10 ** 6, "s")
    rows = lambda *us: spark.createDataFrame([(u * 1000, str(u)) for u in us], "ts_ns bigint, line string").withColumn(
        "ts", F.timestamp_micros(F.expr("ts_ns div 1000")))
    write(rows(10 ** 10), 0)
    write(rows(10 ** 7, 10 ** 10 + 1), 1)
    # The late table committed batch 2, then the writer died.
    table.append(spark, rows(10 ** 6), late, "ts", "s", 2, {"newest": 10 ** 10 + 1})
    for _ in range(2):
        write(rows(10 ** 6, 10 ** 10 + 2), 2)
        write(rows(10 ** 7, 10 ** 10 + 1), 1)
    assert sorted(int(r.line) for r in table.read(spark, out).collect()) == [10 ** 10, 10 ** 10 + 1, 10 ** 10 + 2]
    assert sorted(int(r.line) for r in table.read(spark, late).collect()) == [10 ** 6, 10 ** 7]


def test_lines_to_alert_table(spark, tmp_path):
    lines = fx.lines(spark, SF).select(F.col("event_id").alias("seq"), "raw")
    schema = lines.schema
    _files(lines, str(tmp_path / "in"), 2, ["seq"])
    dims = [fx.dim(spark, n) for n in ("device", "iface", "as_dim")]
    rows = live.enrich_stream(_stream(spark, str(tmp_path / "in"), schema), fx.AS_OF_LINES, *dims)
    live.write_alert_stream(rows, str(tmp_path / "alerts"), str(tmp_path / "ck")).awaitTermination()
    stored = live.alert_table(spark, str(tmp_path / "alerts"))
    stored_rows = stored.count()
    assert stored_rows == parse.parse(lines, fx.AS_OF_LINES).count()
    assert glob.glob(str(tmp_path / "alerts" / "event_date=2026-05-20" / "commit=*"))
    # Retention of a day, a day after the middle of what a stream wrote.
    middle = stored.agg(F.expr("timestampadd(SECOND, cast(timestampdiff(SECOND, min(timestamp), max(timestamp)) / 2 as int), min(timestamp))")).first()[0]
    sinks.prune_alert_table(spark, str(tmp_path / "alerts"), 1, middle + dt.timedelta(days=1), offset_hours=0)
    left = live.alert_table(spark, str(tmp_path / "alerts"))
    cut = F.lit(middle).cast("timestamp_ntz")
    assert 0 < left.count() == parse.parse(lines, fx.AS_OF_LINES).where(F.col("timestamp") >= cut).count() < stored_rows


def test_hourly_stream_equals_batch(spark, tmp_path):
    rows = materialize(fx.alerts(spark, SF).withColumn("us", times.to_us(F.col("timestamp"))), "test")
    _files(rows, str(tmp_path / "in"), 2, ["us"])
    got = _run(live.hourly_stream(_stream(spark, str(tmp_path / "in"), rows.schema), "0 seconds"), tmp_path)
    want = stats.hourly_stats(rows, fx.AS_OF, days=60)
    last = rows.agg(F.max(F.date_trunc("hour", "timestamp"))).first()[0]
    a = {tuple(r) for r in got.select(*want.columns).collect()}
    b = {tuple(r) for r in want.collect() if r.hour < last.replace(tzinfo=None)}
    assert a == b and len(a) > 100


def test_escalation_stream_fires_by_event_time(rocks, tmp_path):
    m = 60 * 1_000_000
    rows = [(1, 0, "d", "M", "n1", "", "track"), (2, 5 * m, "d", "M", "n1", "", "recover"),
            (3, 6 * m, "d", "M", "n2", "", "track"), (4, 10 * m, "d", "M", "n2", "", "track"),
            (5, 40 * m, "d", "M", "n3", "", "track"), (6, 90 * m, "x", "M", "", "", "recover")]
    df = rocks.createDataFrame(rows, "seq bigint, us bigint, device_name string, mnemonic string, "
                                     "bgp_neighbor string, interface_name string, what string")
    _files(df, str(tmp_path / "in"), 3, ["us"])
    got = _run(live.escalation_stream(_stream(rocks, str(tmp_path / "in"), df.schema), watermark="0 seconds"), tmp_path)
    assert sorted(r.seq for r in got.collect()) == [4, 5]


def test_inner_ts_of_a_row_uses_its_ingest_time(spark):
    df = spark.createDataFrame([("Dec 31 23:59:59", "2026-01-03 00:00:00"), ("Jan 1 00:00:01", "2025-12-31 23:59:00")], "t string, a string")
    got = [str(r[0]) for r in df.select(times.parse_inner_ts(F.col("t"), F.col("a"))).collect()]
    assert got == ["2025-12-31 23:59:59", "2026-01-01 00:00:01"]
