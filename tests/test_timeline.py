"""The chunked operators against plain loops, with chunks far smaller than real ones."""

import random

import pytest
from pyspark.sql import functions as F

from alertloom.operators import timeline


def _rows(rng, n, span, keys):
    return [(rng.choice(keys), rng.randrange(span), i, rng.random() < 0.03) for i in range(n)]


def _throttle_loop(rows, window):
    kept, anchor = set(), {}
    for k, us, seq, reset in sorted(rows, key=lambda r: (r[1], r[2])):
        if reset or k not in anchor or us - anchor[k] > window:
            anchor[k] = us
            kept.add(seq)
    return kept


@pytest.mark.parametrize("seed,n,span,window,width,with_reset", [
    (1, 400, 2000, 30, 50, False),
    (2, 600, 900, 37, 20, False),  # chunk shorter than the window
    (3, 600, 3000, 25, 100, True),
    (4, 800, 400, 10, 25, False),  # dense: chains never agree
    (5, 300, 20000, 100, 1000, True),
    (6, 500, 700, 64, 7, True),
])
def test_throttle(spark, seed, n, span, window, width, with_reset):
    rng = random.Random(seed)
    rows = _rows(rng, n, span, ["a", "b", "hot", "hot", "hot", "hot"])
    if not with_reset:
        rows = [(k, us, s, False) for k, us, s, _ in rows]
    df = spark.createDataFrame(rows, "k string, us bigint, seq bigint, r boolean")
    got = timeline.throttle(df, ["k"], window, F.col("r"), width=width)
    assert got.count() == n
    assert {r.seq for r in got.where("kept").collect()} == _throttle_loop(rows, window)


@pytest.mark.parametrize("size", [1, 2, 5])
def test_throttle_steps_do_not_depend_on_batches(size):
    """Chunks, seeds and entries cut by batches anywhere; the steps of a chunk from every starting state."""
    import pyarrow as pa

    window, width = 20, 60
    for seed in range(25):
        rng = random.Random(seed)
        steps = []
        for key in "ab":
            for c in sorted(rng.sample(range(6), 3)):
                times = sorted(c * width + rng.randrange(width) for _ in range(rng.randint(1, 12)))
                anchor = rng.choice([None, c * width - rng.randint(1, 30)])
                steps.append((key, c, times, [rng.random() < 0.1 for _ in times], anchor))
        rows = [(k, c, t, r, False) for k, c, ts, rs, _ in steps for t, r in zip(ts, rs)]
        seeds = [(k, c, a, False, True) for k, c, _, _, a in steps if a is not None]
        both = sorted(rows + seeds, key=lambda r: (r[0], r[1], r[2]))
        table = pa.table({n: list(x) for n, x in zip(("_k", "_chunk", "us", "_reset", "_seed"), zip(*both))})
        got = [x.column("kept").to_pylist() for x in timeline._keeper(window, "us", width)(table.to_batches(size))]
        want = []
        for _, _, times, resets, anchor in steps:
            for t, reset in zip(times, resets):
                kept = reset or anchor is None or t - anchor > window
                anchor = t if kept else anchor
                want.append(kept)
        assert sum(got, []) == want
        schema = pa.schema([("_k", pa.string()), ("_chunk", pa.int64()), ("l", pa.bool_()), ("n", pa.int64()), ("b", pa.int64()), ("e", pa.int64())])
        plain = sorted(rows, key=lambda r: (r[0], r[1], r[2]))
        table = pa.table({n: list(x) for n, x in zip(("_k", "_chunk", "us", "_reset"), zip(*plain))})
        table = table.append_column("_linked_in", pa.array([True] * len(plain))).append_column("_next_chunk", pa.array([9] * len(plain)))
        out = [r for x in timeline._summariser(window, width, "us", schema)(table.to_batches(size)) for r in x.to_pylist()]
        for k, c, times, resets, _ in steps:
            mine = sorted((r["b"], r["e"]) for r in out if (r["_k"], r["_chunk"]) == (k, c))
            for anchor in [None, *range(c * width - 40, c * width)]:
                last = anchor
                for t, reset in zip(times, resets):
                    last = t if reset or last is None or t - last > window else last
                step = next((e for b, e in mine if anchor is None or b > anchor + window), anchor)
                assert step == last, (seed, k, c, anchor)


def test_throttle_periodic_chains_never_merge(spark):
    rows = [("k", us, us, False) for us in range(0, 3000, 10)]
    df = spark.createDataFrame(rows, "k string, us bigint, seq bigint, r boolean")
    got = timeline.throttle(df, ["k"], 30, width=70)
    assert {r.seq for r in got.where("kept").collect()} == set(range(0, 3000, 40))


def test_throttle_when_a_join_turns_into_a_broadcast_at_run_time(spark):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB",
            "spark.sql.execution.arrow.maxRecordsPerBatch": "100"}
    old = {k: spark.conf.get(k, None) for k in conf}
    rows = [("hot", us * 10 + us % 7, us, False) for us in range(20_000)]
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = spark.createDataFrame(rows, "k string, us bigint, seq bigint, r boolean").repartition(8)
        got = timeline.throttle(df, ["k"], 3000, width=12_345)
        assert {r.seq for r in got.where("kept").collect()} == _throttle_loop(rows, 3000)
        # All three task functions sit on an exchange that no join can make redundant.
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("RepartitionByExpression [xxhash64(") == 3
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("seed,width", [(1, 50), (2, 11), (3, 1000)])
def test_count_recent(spark, seed, width):
    rng = random.Random(seed)
    rows = _rows(rng, 400, 1500, ["a", "b", "b"])
    rows = [(k, us, s, rng.random() < 0.6) for k, us, s, _ in rows]
    df = spark.createDataFrame(rows, "k string, us bigint, seq bigint, c boolean")
    got = {r.seq: r.n for r in timeline.count_recent(df, ["k"], 40, "n", F.col("c"), width=width).collect()}
    for k, us, seq, _ in rows:
        want = sum(1 for k2, u2, s2, c2 in rows if c2 and k2 == k and us - 40 <= u2 and (u2, s2) <= (us, seq))
        assert got[seq] == want


@pytest.mark.parametrize("inclusive,reverse", [(True, False), (False, False), (False, True)])
def test_running_max(spark, inclusive, reverse):
    rng = random.Random(9)
    rows = _rows(rng, 300, 2000, ["a", "b", "b"])
    rows = [(k, us, s, rng.random() < 0.05) for k, us, s, _ in rows]
    df = spark.createDataFrame(rows, "k string, us bigint, seq bigint, c boolean").withColumn(
        "chunk", timeline.chunk("us", 60))
    val = F.when(F.col("c"), F.struct("us", "seq"))
    out = timeline.running_max(df, ["k"], {"p": val}, ["us", "seq"], inclusive, reverse=reverse)
    for r in out.collect():
        me = (r.us, r.seq)
        others = [(us, s) for k, us, s, c in rows if c and k == r.k]
        if reverse:
            want = min((o for o in others if o > me), default=None)
        else:
            want = max((o for o in others if o < me or (inclusive and o == me)), default=None)
        assert (tuple(r.p) if r.p else None) == want


def test_chunk_is_floor(spark):
    df = spark.createDataFrame([(-1,), (-60,), (-61,), (0,), (59,), (60,)], "us bigint")
    assert [r.c for r in df.select(timeline.chunk("us", 60).alias("c")).collect()] == [-1, -1, -2, 0, 0, 1]
