"""Row functions against Python's own regex engine and hand-made cases."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from alertloom.functions import fixed, text, times
from alertloom.operators import classify, enrich, notify, parse, read, stats
from alertloom.sources import dims, sinks, syslog

HEAD = "May 22 21:12:21 10.0.0.1 99: "
GOOD = HEAD + "HOST-1 RP/0/RP0/CPU0:May 22 21:12:21.651 +06: bgp[1]: %ROUTING-BGP-5-ADJCHANGE : neighbor 1.2.3.4 Down"
LINES = [
    GOOD, GOOD + "\n", GOOD + "\nmore", "x" + GOOD, GOOD.replace("May 22 21:12:21.651", "Foo 22 21:12:21"),
    GOOD.replace("%ROUTING", "%routing"), GOOD.replace("-5-", "-X-"), GOOD.replace("bgp[1]", "bgp"),
    GOOD.replace("10.0.0.1", "10.0.XYZ.1"), GOOD.replace(" HOST-1", ""), GOOD.replace("RP/0/RP0/CPU0", "0/RP0/ADMIN0"),
    GOOD.replace("May 22 21:12:21.651 +06", "May 22 05:27:59 "), GOOD.replace("10.0.0.1", "10.0.0.1 "),
    GOOD.replace("99:", "99:\x1c"), GOOD + " café", GOOD + "\x1fabc", GOOD.replace("Down", "Down\x1f\x1e"),
    "\x1eHDR\x1fa\x1fb", "", "   ", "\t\t", "42", "%", "-" * 500, "\x00" * 100, "\x7f" * 50, "\x1c", "​",
    GOOD.replace(" : neighbor", " :  neighbor"), GOOD + "\r", GOOD.replace(": bgp[1]: ", ": bgp[1]: x: y[2]: "),
    GOOD.replace("CPU0:May", "CPU0:a:b May"), GOOD + "x" * (8192 - len(GOOD)), GOOD + "x" * (8193 - len(GOOD)),
]
PY_HEADER = re.compile(parse.HEADER.replace(r"\n?\z", r"$"))


def test_header_matches_python(spark):
    df = spark.createDataFrame(list(enumerate(LINES)), "i int, raw string")
    got = {r.i: r for r in parse.parse_lines(df, "2026-05-31 00:00:00").collect()}
    for i, line in enumerate(LINES):
        m = PY_HEADER.match(line) if line.strip() and len(line) <= 8192 else None
        r = got[i]
        if m is None:
            assert r.reject_reason in ("empty", "too_long", "no_match"), line
        elif "Foo" in line:
            assert r.reject_reason == "bad_timestamp"
        else:
            assert r.reject_reason is None, repr(line)
            assert (r.source_ip, r.hostname, r.mnemonic, r.message) == (
                m.group(1), m.group(2) or "", m.group(8), m.group(9)), repr(line)


@pytest.mark.parametrize("as_of", ["2026-01-15 00:00:00", "2025-11-02 00:00:00", "2024-02-10 00:00:00", "2026-12-31 23:00:00"])
def test_inner_timestamp(spark, as_of):
    rng = random.Random(as_of)
    now = dt.datetime.fromisoformat(as_of)
    rows = []
    for i in range(300):
        mon = rng.choice(fixed.MONTHS + ["Foo"])
        rows.append((i, f"{rng.choice(['', 'x '])}{mon} {rng.randrange(0, 33)} {rng.randrange(0, 26):02d}:{rng.randrange(0, 62):02d}:"
                        f"{rng.randrange(0, 62):02d}{rng.choice(['', '.5', '.123456', '.1234567 BDT', ' +06'])}"))

    def want(s):
        m = re.search(r"(\w+)\s+(\d+)\s+(\d{2}):(\d{2}):(\d{2})(?:\.(\d+))?", s.removeprefix("x "))
        if m.group(1) not in fixed.MONTHS:
            return None
        month = fixed.MONTHS.index(m.group(1)) + 1
        try:
            ts = dt.datetime(now.year, month, *(int(m.group(k)) for k in (2, 3, 4, 5)),
                             int((m.group(6) or "0")[:6].ljust(6, "0")))
            if month > now.month + 1:
                return ts.replace(year=now.year - 1)
            return ts.replace(year=now.year + 1) if now.month >= 11 and month <= 2 else ts
        except ValueError:
            return None

    df = spark.createDataFrame(rows, "i int, s string").select("i", times.parse_inner_ts(F.col("s"), as_of).alias("t"))
    assert {r.i: r.t for r in df.collect()} == {i: want(s) for i, s in rows}


def test_classification_equals_plain_search(spark):
    rng = random.Random(5)
    tags = sorted({re.match(r"[%\w-]*", r.pattern).group(0) for r in fixed.RULES})
    words = ["Down", "Downs", "Up", "Clear", "Set", "Remote Fault", "Local Fault", "no longer Active", "now Active",
             "changed state to Down", "changed state to Up", "HW_EVENT_OK", "event_manager_user", "Signal failure",
             "Detected Fault", "é", "100%", "\x1c", "Döwn", "Downé", "\n"]
    rows = [(i, " ".join(rng.choice(tags + words) for _ in range(rng.randrange(1, 6)))) for i in range(1500)]
    got = {r.i: r.rule_id for r in classify.classify(spark.createDataFrame(rows, "i int, raw string")).collect()}
    compiled = [(re.compile(r.pattern), r.id) for r in fixed.RULES]
    for i, raw in rows:
        assert got[i] == next((rid for p, rid in compiled if p.search(raw)), "UNKNOWN"), repr(raw)


def test_literal_prefix_is_implied_by_a_match():
    assert classify.literal_prefix("abc?d") == "ab"
    assert classify.literal_prefix("abc|d") == ""
    assert classify.literal_prefix("%A-1-B.*(?:x|y)") == "%A-1-B"


@pytest.mark.parametrize("message,want", [
    ("Interface TenGigE0/0/0/0, Detected", "TenGigE0/0/0/0"), ("TenGigE0/0/1/7 is no longer Active", "TenGigE0/0/1/7"),
    ("GigE0/1 is Active as", "GigE0/1"), ("failed, ifname: HundredGigE0_3_2_2, unit:0", "HundredGigE0_3_2_2"),
    ("has been detected on Bundle-Ether191", "Bundle-Ether191"), ("Set|envmon|0x1|GigE0/0/0/4", "GigE0/0/0/4"),
    ("ifname: ,,.", ""), ("nothing here", ""), ("Line protocol on Interface Bundle-Ether5;", "Bundle-Ether5"),
])
def test_interface(spark, message, want):
    df = spark.createDataFrame([(message,)], "m string")
    assert df.select(text.extract_interface(F.col("m"))).first()[0] == want


def test_scalars(spark):
    df = spark.createDataFrame([("HundredGigE0_3_2_2", "a" * 51 + " b", "x\x07y" + "z" * 20)], "i string, d string, s string")
    r = df.select(text.normalise_interface(F.col("i")), text.derive_client(F.col("d")), text.sanitise(F.col("s"), 10),
                  text.shorten_interface(F.lit("TwentyFiveGigE0/1 TenGigE0"))).first()
    assert tuple(r) == ("HundredGigE0/3/2/2", "a" * 51, "xy" + "z" * 7 + "…", "25GE0/1 TGE0")


def test_period_bounds():
    now = "2024-03-01 10:00:00"
    assert times.period_bounds("yesterday", now) == (dt.datetime(2024, 2, 29), dt.datetime(2024, 3, 1))
    assert times.period_bounds("all", now) == (None, None)
    with pytest.raises(ValueError):
        times.period_bounds("week", now)


def test_micros_round_trip_in_any_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([("2024-03-10 02:30:00.123456",), ("1969-12-31 23:59:59",)], "s string")
        ts = F.col("s").cast("timestamp_ntz")
        rows = df.select(ts.alias("t"), times.to_us(ts).alias("u"), times.from_us(times.to_us(ts)).alias("b")).collect()
        assert all(r.t == r.b for r in rows) and rows[1].u == -1_000_000
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_page_arguments(spark):
    df = spark.createDataFrame([], "alert_id int, timestamp timestamp_ntz, classification string, device_name string")
    for bad in ({"severity": "LOUD"}, {"limit": 0}, {"limit": 5001}, {"offset": -1}, {"period": "week"}):
        with pytest.raises(ValueError):
            read.alerts_page(df, "2024-01-01", **bad)
    with pytest.raises(ValueError):
        read.alerts_by(df, "message", "x")


def test_health_score(spark):
    def score(**kw):
        return spark.range(1).select(stats.health_score(**{k: F.lit(v) for k, v in kw.items()})).first()[0]

    assert score(critical=0, warning=0) == 100
    assert score(critical=1, warning=3) == 84
    assert score(critical=9, warning=99, bgp_down=99, flapping=99, degraded=99, pni_healthy=False) == 0


def test_interface_lines(spark):
    body = ["# c", "", "H | Te0/1 l2transport | first | -", "H|Te0/1|second|BE1", " H | Te0/2 | only desc ", "H | two"]
    df = spark.createDataFrame(list(enumerate(body)), "line_no int, value string")
    got = {tuple(r) for r in dims.parse_interface_lines(df).collect()}
    assert got == {("H", "Te0/1", "second", "BE1"), ("H", "Te0/2", "only desc", None)}


def test_export_envelopes(spark):
    bodies = ['{"streams":[{"stream":{},"values":[["5","a"],["6",""]]},{"values":[["4","b"]]}]}',
              '{"data":{"result":[{"values":[["9","c"]]},{"values":[]}]}}', "junk", "{}", '{"streams":[]}']
    df = spark.createDataFrame([(b,) for b in bodies], "value string")
    assert sorted(map(tuple, syslog.explode_loki_export(df).collect())) == [(4, "b"), (5, "a"), (9, "c")]


def test_date_replacement_and_retention(spark, tmp_path):
    path = str(tmp_path / "alerts")
    df = spark.createDataFrame([(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=7 * i)) for i in range(40)],
                               "alert_id int, timestamp timestamp_ntz")
    sinks.write_alerts(df, path)
    touched = spark.read.parquet(path).where("event_date = '2024-01-03'").drop("event_date").withColumn("alert_id", F.lit(-1))
    n = touched.count()
    sinks.replace_dates(spark, touched, path)
    back = spark.read.parquet(path)
    assert back.count() == 40 and back.where("alert_id = -1").count() == n > 0
    sinks.prune_alert_table(spark, path, 5, "2024-01-10 12:00:00", offset_hours=0)
    left = spark.read.parquet(path)
    assert left.agg(F.min("timestamp")).first()[0] >= dt.datetime(2024, 1, 5, 12)
    assert left.count() == sum(1 for i in range(40) if dt.datetime(2024, 1, 1) + dt.timedelta(hours=7 * i) >= dt.datetime(2024, 1, 5, 12))


def test_maintenance_overlaps(spark):
    t = dt.datetime(2024, 1, 1)
    win = spark.createDataFrame([("a", t, t + dt.timedelta(hours=2)), ("a", t + dt.timedelta(hours=1), t + dt.timedelta(hours=5)),
                                 ("a", t + dt.timedelta(hours=8), t + dt.timedelta(hours=9)), ("b", t, t)],
                                "device_name string, start_time timestamp_ntz, end_time timestamp_ntz")
    ev = [("a", 0, True), ("a", 300, True), ("a", 301, False), ("a", 480, True), ("a", 540, True), ("a", 541, False),
          ("b", 0, True), ("b", 1, False), ("c", 0, False)]
    df = spark.createDataFrame([(d, t + dt.timedelta(minutes=m), w) for d, m, w in ev],
                               "device_name string, timestamp timestamp_ntz, want boolean")
    assert notify.under_maintenance(df, win).where("in_maintenance <> want").count() == 0


def test_escalation_marks_its_group(spark):
    m = 60 * 1_000_000
    rows = [(1, 0, "n1"), (2, 5 * m, "n2"), (3, 16 * m, "n3"), (4, 40 * m, "n1"), (5, 41 * m, "n1")]
    cols = "seq bigint, us bigint, bgp_neighbor string"
    df = spark.createDataFrame(rows, cols).withColumns({
        "device_name": F.lit("d"), "mnemonic": F.lit("M"), "interface_name": F.lit("")})
    got = {r.seq: (r.ended_by, r.escalated_us) for r in notify.escalations(df, df.limit(0), 100 * m).collect()}
    # 1 is sent at 15 min and marks 2; 3 was tracked later; 4 restarts as 5, which is sent.
    assert got == {1: ("track", 15 * m), 2: (None, None), 3: (None, 31 * m), 4: ("track", None), 5: (None, 56 * m)}


def test_login_and_maxpfx(spark):
    rows = [("SSH_LOGIN", "INFO_SUCCESS", "Successfully authenticated user 'operator7' from '192.0.2.9' on 'vty0'(cipher 'aes', mac 'x')"),
            ("BGP_MAXPFX", "MAXPFX", "No. of IPv4 Unicast prefixes received from 198.51.100.6 has reached 782, max 1000")]
    df = spark.createDataFrame(rows, "rule_id string, mnemonic string, message string")
    a = enrich.extract_login(df).first()
    assert (a.username, a.login_ip, a.vty, a.cipher, a.action) == ("operator7", "192.0.2.9", "vty0", "aes", "login")
    b = enrich.extract_maxpfx(df).first()
    assert (b.peer, b.prefix_count, b.max_prefixes) == ("198.51.100.6", 782, 1000)
