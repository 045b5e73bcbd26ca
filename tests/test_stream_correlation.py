"""Correlation on a stream gives, event by event, what the batch gives, however it is cut and restarted."""

import random

import pytest
from pyspark.sql import functions as F

from alertloom.operators import correlate
from alertloom.session import materialize
from alertloom.streaming import correlate as scorrelate, dedup as sdedup

from test_folds import EV, LINKS, _df, _stream

EVENT = ["is_root_cause", "is_symptom", "is_independent", "is_flapping", "flap_count", "suppress_notification", "inc_kind", "inc_key",
         "inc", "bh_inc", "mass_inc", "is_bh_root", "opens_mass", "opens_link", "is_recovery"]
FAR = 3 * 10 ** 15


@pytest.fixture(scope="module")
def rocks(spark):
    for k, v in sdedup.STATE_STORE.items():
        spark.conf.set(k, v)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", old)


def _last(seq):
    """A line far in the future, which takes the watermark past all others."""
    return dict(seq=seq, us=FAR, source_ip="Z", device_name="z", message="", rule_id="X", mnemonic="M", event_type="Other",
                classification="INFO", interface_name="", bundle_parent="", bgp_neighbor="", member_bundle=None, event_bundle=None,
                event_remote=None, is_recovery=False)


def _replay(spark, runs, topo, path, watermark):
    """One start from the checkpoint for each run, one micro-batch for each of its parts."""
    for run in runs:
        for rows in run:
            _df(spark, rows).coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(EV).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
        out = scorrelate.correlate_stream(stream, topo, watermark)
        q = out.writeStream.format("parquet").option("checkpointLocation", f"{path}/ck").trigger(availableNow=True).start(f"{path}/out")
        q.awaitTermination()
    return spark.read.parquet(f"{path}/out")


def test_stream_equals_batch_after_restart(rocks, tmp_path):
    spark = rocks
    topo = spark.createDataFrame([(a, b, r) for (a, b), r in LINKS.items()], "ip string, bundle string, remote_ip string")
    rows, rnd = _stream(7, 600, 6), random.Random(7)
    # Rows change places within the watermark, across micro-batches and the restart too.
    order = sorted(rows, key=lambda r: r["us"] + rnd.randrange(0, 100_000_000))
    runs = [[order[:250]], [order[250:420], order[420:], [_last(10 ** 6)]]]
    got = _replay(spark, runs, topo, str(tmp_path), "2 minutes").cache()
    batch = materialize(correlate.correlate(_df(spark, rows), topo), "t")
    want = {r["seq"]: tuple(r[c] for c in EVENT) for r in batch.collect()}
    events = got.where(f"what = 'event' AND us < {FAR}").collect()
    assert sorted(r["seq"] for r in events) == sorted(r["seq"] for r in rows)
    differing = {r["seq"]: (tuple(r[c] for c in EVENT), want[r["seq"]]) for r in events if tuple(r[c] for c in EVENT) != want[r["seq"]]}
    assert not differing, dict(list(differing.items())[:3])
    assert {r["inc_kind"] for r in events} == {"link", "mass", None}

    recoveries = _df(spark, rows).where("is_recovery").select("seq", "us", "source_ip")
    opens = correlate.expire_incidents(correlate.resolve_on_recovery(correlate.incident_openings(batch), recoveries), F.lit(FAR))
    fates = {(r["kind"], r["key"], r["us"], r["seq"]): (r["fate"], r["resolved_us"], r["resolved_by"]) for r in opens.collect()}
    ended = got.where("what <> 'event'").collect()
    assert len(ended) == len(fates)
    assert {(r["inc_kind"], r["inc_key"], r["inc"]["us"], r["inc"]["seq"]): (r["what"], r["resolved_us"], r["resolved_by"]) for r in ended} == fates
    assert {f[0] for f in fates.values()} == {"resolved", "expired"}
