"""Dedup and correlation against row-by-row loops on random streams."""

import random

import pytest
from pyspark.sql import functions as F

from alertloom.operators import correlate, dedup

import loops

S = 1_000_000
EV = ("seq bigint, us bigint, source_ip string, device_name string, mnemonic string, message string, "
      "rule_id string, event_type string, classification string, interface_name string, "
      "bundle_parent string, bgp_neighbor string, member_bundle string, event_bundle string, "
      "event_remote string, is_recovery boolean")
LINKS = {("A", "b1"): "B", ("A", "b2"): "B", ("B", "b1"): "A", ("B", "b2"): "A",
         ("A", "b3"): "C", ("C", "b3"): "A", ("C", "b4"): "B", ("B", "b4"): "C"}


def _stream(seed, n, step):
    rng, t, rows = random.Random(seed), 10 ** 15, []
    for seq in range(n):
        t += rng.choice([0, rng.randrange(1, step), rng.randrange(1, step)]) * S
        if rng.random() < 0.004:
            t += 25 * 3600 * S
        ip = rng.choice("AABC")
        kind = rng.random()
        e = dict(seq=seq, us=t, source_ip=ip, device_name="r" + ip, message="", rule_id="X", mnemonic="M",
                 event_type="Other", classification="INFO", interface_name="", bundle_parent="",
                 bgp_neighbor="", member_bundle=None, event_bundle=None, event_remote=None,
                 is_recovery=False)
        mine = sorted(b for d, b in LINKS if d == ip)
        if kind < 0.35:
            b = rng.choice(mine)
            up = rng.random() < 0.3
            e.update(mnemonic="UPDOWN", event_type="Interface Up" if up else "Interface Down",
                     classification=rng.choice(["CRITICAL", "CRITICAL", "INFO"]), interface_name="i" + b,
                     bundle_parent=rng.choice([b, b, b, ""]), member_bundle=b, event_bundle=b,
                     event_remote=LINKS[ip, b], is_recovery=up and rng.random() < 0.5)
        elif kind < 0.75:
            nb = rng.choice(["n1", "n2", "n3"])
            d = rng.choice(["Down", "Down", "Up", "Odd"])
            b = rng.choice([None, None, rng.choice(mine)])
            e.update(mnemonic="ADJCHANGE", bgp_neighbor=nb, message=f"neighbor {nb} {d}",
                     rule_id={"Down": "BGP_DOWN", "Up": "BGP_UP"}.get(d, "X"),
                     event_type={"Down": "BGP Peer Down", "Up": "BGP Peer Up"}.get(d, "Odd"),
                     classification="CRITICAL", event_bundle=b, event_remote=LINKS.get((ip, b)),
                     is_recovery=d == "Up" and rng.random() < 0.4)
        elif kind < 0.85:
            e.update(mnemonic="MAXPFX", rule_id="BGP_MAXPFX", event_type="BGP Max Prefix Reached",
                     classification=rng.choice(["CRITICAL", "NOISE"]))
        elif kind < 0.9:
            e.update(mnemonic="ACTIVE", is_recovery=True, event_type="Active", classification="CRITICAL")
        rows.append(e)
    return rows


def _df(spark, rows):
    names = [c.split()[0] for c in EV.split(", ")]
    return spark.createDataFrame([tuple(r[c] for c in names) for r in rows], EV)


def _topology(spark):
    rows = [(ip, b, i, r, ["i" + b]) for i, ((ip, b), r) in enumerate(LINKS.items())]
    return spark.createDataFrame(rows, "ip string, bundle string, ordinal int, remote_ip string, members array<string>")


@pytest.mark.parametrize("seed,n,step", [(1, 700, 15), (2, 700, 60), (3, 500, 200), (4, 900, 3)])
def test_dedup(spark, seed, n, step):
    rows = _stream(seed, n, step)
    got = {r.seq: r.reason for r in dedup.should_notify(_df(spark, rows)).collect()}
    assert got == loops.dedup(rows)


@pytest.mark.parametrize("seed,n,step,width", [
    (1, 700, 15, 3600), (2, 700, 60, 600), (3, 500, 200, 3600), (4, 900, 3, 120), (5, 800, 30, 86400)])
def test_correlate(spark, seed, n, step, width):
    rows = _stream(seed, n, step)
    want, closed = loops.correlate(rows, LINKS)
    df = _df(spark, rows)
    corr = correlate.correlate(df, _topology(spark), width * S)
    got = {}
    for r in corr.collect():
        label = ("root" if r.is_root_cause else "symptom" if r.is_symptom
                 else "independent" if r.is_independent else "flapping")
        key = None
        if r.inc is not None:
            k = tuple(r.inc_key.split(":")) if r.inc_kind == "link" else r.inc_key
            key = (r.inc_kind, k, r.inc.seq)
        got[r.seq] = {"label": label, "inc": key, "flap_count": r.flap_count}
    assert got == want
    opens = correlate.incident_openings(corr)
    done = correlate.resolve_on_recovery(
        opens, df.where("is_recovery").select("seq", "us", "source_ip"), width * S)
    res = {}
    for r in done.collect():
        if r.resolved_us is not None:
            k = tuple(r.key.split(":")) if r.kind == "link" else r.key
            res[(r.kind, k, r.seq)] = (r.resolved_us, r.resolved_by)
    assert res == closed


def test_incident_ids_continue_after_stored(spark):
    day = 86_400 * S
    rows = [("link", "A:b", "A", day * 20_000 + i * 3600 * S, i, 0, 0, 1, True, 0) for i in range(30)]
    opens = spark.createDataFrame(
        rows, "kind string, key string, device_ip string, us bigint, seq bigint, last_us bigint, "
              "last_seq bigint, touches bigint, has_root boolean, open_order int")
    stored = spark.createDataFrame([("INC-20241003-007",), ("",), (None,), ("INC-20241003-002",)], "incident_id string")
    got = {r.seq: r.incident_id for r in correlate.incident_ids(opens, stored).collect()}
    assert got[0] == "INC-20241003-008" and got[5] == "INC-20241003-013"
    assert got[6] == "INC-20241004-001" and got[29] == "INC-20241004-024"


def test_flap_state_round_trip(spark):
    rows = [r for r in _stream(8, 400, 20) if not r["bundle_parent"]]
    cut = 200
    old, new = rows[:cut], rows[cut:]
    state = dedup.flap_state(_df(spark, old))
    stored = dedup.export_flap_state(state).unionByName(
        spark.createDataFrame([("bad", "[[1],[\"down\",\"junk\"],3]")], "bgp_key string, history string"))
    got = {r.seq: r.flap for r in dedup.resume(_df(spark, new), stored).collect() if r.flap}
    whole = dedup.bgp_flap(dedup._narrow(_df(spark, rows))).where(F.col("flap").isNotNull()).collect()
    first = min(e["seq"] for e in new)
    assert got == {r.seq: r.flap for r in whole if r.seq >= first}


def test_rejects_bad_window(spark):
    with pytest.raises(ValueError):
        dedup.should_notify(_df(spark, []), window_s=0)
