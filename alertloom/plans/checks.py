"""Building blocks of the checking SQL: the same inputs, stated for the checking database."""

from __future__ import annotations

from ..functions import fixed
from ..operators.parse import HEADER
from . import fixtures as fx


def q(text: str) -> str:
    return text.replace("'", "''")


def ts(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S.%f')"


HEADER_FIELDS = ["source_ip", "hostname", "rp_location", "inner_ts", "facility", "subfacility", "sev",
                 "mnemonic", "message"]
INNER = r"(\w+)\s+(\d+)\s+(\d{2}):(\d{2}):(\d{2})(?:\.(\d+))?"
MONTH_CASE = "CASE i.mon " + " ".join(
    f"WHEN '{m}' THEN '{n:02d}'" for n, m in enumerate(fixed.MONTHS, 1)) + " END"


def parsed_sql(src: str) -> str:
    names = ", ".join(f"'{f}'" for f in HEADER_FIELDS)
    return f"""
SELECT event_id, raw, x.source_ip, x.hostname, x.rp_location, x.facility, x.subfacility,
  CAST(x.sev AS INTEGER) AS severity_level, x.mnemonic, x.message, ts AS timestamp, epoch_us(ts) AS us
FROM (SELECT *, try_cast(concat('2026-', {MONTH_CASE}, '-', lpad(i.d, 2, '0'), ' ', i.h, ':', i.mi, ':', i.s, '.',
        rpad(left(i.f, 6), 6, '0')) AS TIMESTAMP) AS ts
  FROM (SELECT *, regexp_extract(x.inner_ts, '{INNER}', ['mon', 'd', 'h', 'mi', 's', 'f']) AS i
    FROM (SELECT event_id, raw, regexp_extract(raw, '{q(HEADER)}', [{names}]) AS x
      FROM {src} WHERE length(raw) <= 8192) a WHERE x.source_ip <> '') b WHERE {MONTH_CASE} IS NOT NULL) c
WHERE ts IS NOT NULL"""


def rule_case(field: str, raw: str = "raw") -> str:
    def lit(v):
        return str(v).upper() if isinstance(v, bool) else f"'{q(v)}'"

    whens = " ".join(
        f"WHEN regexp_matches({raw}, '{q(r.pattern)}') THEN {lit(getattr(r, field))}" for r in fixed.RULES)
    return f"CASE {whens} ELSE {lit(getattr(fixed.UNKNOWN_RULE, field))} END"


def interface_sql(msg: str) -> str:
    hits = ", ".join(f"nullif(regexp_extract({msg}, '{q(p)}', 1), '')" for _, p in fixed.INTERFACE_PATTERNS)
    return f"coalesce(rtrim(coalesce({hits}), ',.;:'), '')"


def recovery_sql(mn="mnemonic", msg="message", rule: str | None = None) -> str:
    ins = lambda xs: ", ".join(f"'{x}'" for x in xs)
    out = (f"(({mn} IN ({ins(fixed.RECOVERY_ALWAYS)}) AND NOT contains({msg}, 'no longer')) OR "
           f"({mn} IN ({ins(fixed.RECOVERY_CLEAR)}) AND regexp_matches({msg}, '\\bClear\\b')) OR "
           f"({mn} IN ({ins(fixed.RECOVERY_UP)}) AND regexp_matches({msg}, '\\bUp\\b')))")
    return f"({rule} IN ({ins(fixed.RECOVERY_RULES)}) OR {out})" if rule else out


MSG_IFACE = f"nullif(regexp_extract(message, '{fixed.MSG_INTERFACE_PATTERN}', 1), '')"
MSG_NBR = f"nullif(regexp_extract(message, '{fixed.MSG_NEIGHBOR_PATTERN}', 1), '')"
BGP_DISC = (f"coalesce(nullif(bgp_neighbor, ''), {MSG_NBR}, "
            "CASE WHEN coalesce(as_number, 0) <> 0 THEN CAST(as_number AS VARCHAR) END, '')")
GROUP_KEY = (f"CASE WHEN mnemonic = 'ADJCHANGE' THEN concat(device_name, ':ADJCHANGE:', {BGP_DISC}) "
             f"ELSE concat(device_name, ':', mnemonic, ':', coalesce(nullif(interface_name, ''), {MSG_IFACE}, '')) END")
STATE_KEY = (f"CASE WHEN mnemonic = 'ADJCHANGE' THEN concat(device_name, ':BGP:', {BGP_DISC}) "
             f"WHEN coalesce(nullif(interface_name, ''), {MSG_IFACE}) IS NOT NULL "
             f"THEN concat(device_name, ':', coalesce(nullif(interface_name, ''), {MSG_IFACE})) "
             "ELSE concat(device_name, ':', mnemonic, ':', bgp_neighbor) END")


def short_sql(col: str) -> str:
    for long, short in fixed.INTERFACE_SHORT:
        col = f"replace({col}, '{long}', '{short}')"
    return col


def title_sql(dev="device_name") -> str:
    s = short_sql("interface_name")
    tail = lambda sep: f"CASE WHEN interface_name <> '' THEN concat('{sep}', {s}) ELSE '' END"
    state = ("CASE WHEN contains(message, 'Flap') OR contains(message, 'Interface flap') THEN ' Flap' "
             "WHEN regexp_matches(message, '\\bDown\\b') THEN ' DOWN' "
             "WHEN regexp_matches(message, '\\bUp\\b') THEN ' UP' ELSE '' END")
    bundle = ("CASE WHEN regexp_matches(message, 'Bundle-Ether\\d+') "
              "THEN concat(', BE', regexp_extract(message, 'Bundle-Ether(\\d+)', 1)) ELSE '' END")
    fault = ("CASE WHEN contains(message, 'Local Fault') AND contains(message, 'Remote Fault') THEN 'Local+Remote Fault' "
             "WHEN contains(message, 'Local Fault') THEN 'Local Fault' "
             "WHEN contains(message, 'Remote Fault') THEN 'Remote Fault' ELSE 'Fault' END")
    return f"""CASE
 WHEN mnemonic = 'ACTIVE' THEN concat(CASE WHEN contains(message, 'no longer') THEN 'Bundle DOWN' ELSE 'Bundle ACTIVE' END,
   ' — ', {dev}, {tail(', ')}, {bundle})
 WHEN mnemonic = 'ADJCHANGE' THEN concat('ADJCHANGE — ', {dev}, {state}, CASE WHEN as_name <> '' THEN concat(' - ', as_name) ELSE '' END)
 WHEN mnemonic IN ('RFI', 'RX_FAULT') THEN concat('RXFault-', {dev}, {tail(' - ')}, ' - ', {fault})
 WHEN mnemonic IN ('UPDOWN', 'LINEPROTO') THEN concat(mnemonic, ' — ', {dev}, CASE WHEN contains(message, 'Down') THEN ' Down'
   WHEN contains(message, 'Up') THEN ' Up' ELSE '' END, {tail(' - ')})
 ELSE concat(mnemonic, ' — ', {dev}, {tail(', ')}) END"""


NORM = r"regexp_replace(regexp_replace(interface_name, '([a-zA-Z0-9])_(\d)', '\1/\2', 'g'), '([a-zA-Z0-9])_(\d)', '\1/\2', 'g')"

# name -> (needs, sql)
CTES: dict[str, tuple[list[str], str]] = {
    "lines": ([], fx.LINES),
    "damaged": (["lines"], fx.DAMAGED),
    "parsed": (["lines"], parsed_sql("lines")),
    "alerts": ([], fx.ALERTS),
    "incidents": ([], fx.INCIDENTS),
    "acks": ([], fx.ACKS),
    "alert_acks": ([], fx.ALERT_ACKS),
    "maintenance": ([], fx.MAINTENANCE),
    "notes": ([], fx.HANDOFFS),
    "inner_times": ([], fx.INNER_TIMES),
    **{name: ([], sql) for name, sql in fx.DIMS.items()},
    "classified": (["parsed"], f"""SELECT *, {rule_case('id')} AS rule_id, {rule_case('classification')} AS classification,
      {rule_case('event_type')} AS event_type FROM parsed"""),
    "fields": (["classified"], f"""SELECT *, {interface_sql('message')} AS interface_name,
      coalesce(regexp_extract(message, '{q(fixed.NEIGHBOR_PATTERN)}', 1), '') AS bgp_neighbor,
      try_cast(nullif(regexp_extract(raw, '{q(fixed.AS_PATTERN)}', 1), '') AS BIGINT) AS as_number,
      coalesce(regexp_extract(raw, '{q(fixed.VRF_PATTERN)}', 1), '') AS vrf FROM classified"""),
    "enriched": (["fields", "device", "iface", "as_dim"], f"""
      SELECT f.*, i.description IS NOT NULL AS known_if, coalesce(i.description, '') AS interface_description,
        coalesce(i.bundle, '') AS bundle_parent,
        CASE WHEN i.description IS NULL THEN '' WHEN length(i.description) <= 50 THEN i.description
          ELSE regexp_extract(i.description, '^[^\\s/]*') END AS client_name, coalesce(a.name, '') AS as_name
      FROM (SELECT p.*, coalesce(d.name, concat('UNKNOWN-', source_ip)) AS device_name,
              coalesce(d.location, '') AS device_location, coalesce(d.hostname, '') AS device_hostname
            FROM fields p LEFT JOIN device d ON d.ip = p.source_ip) f
      LEFT JOIN iface i ON i.hostname = CASE WHEN device_hostname <> '' THEN device_hostname ELSE device_name END
        AND interface_name <> '' AND i.interface = {NORM}
      LEFT JOIN as_dim a ON a.asn = f.as_number"""),
    "ev": (["enriched", "topo", "bgp_bundle"], f"""
      SELECT e.event_id AS seq, e.*, m.bundle AS member_bundle, coalesce(m.bundle, b.bundle) AS event_bundle,
        l.remote_ip AS event_remote, {recovery_sql(rule='rule_id')} AS is_recovery
      FROM enriched e LEFT JOIN topo m ON m.ip = e.source_ip AND m.member = e.interface_name
      LEFT JOIN bgp_bundle b ON b.ip = e.source_ip AND b.neighbor = e.bgp_neighbor
      LEFT JOIN topo l ON l.ip = e.source_ip AND l.bundle = coalesce(m.bundle, b.bundle)"""),
}


def check(body: str, *needs: str, recursive: bool = False, **extra: str) -> str:
    """``WITH`` the needed building blocks (and ``extra`` ones, in order) ``body``."""
    done: dict[str, str] = {}

    def add(name: str):
        if name not in done:
            deps, sql = CTES[name]
            for d in deps:
                add(d)
            done[name] = sql

    for n in needs:
        add(n)
    done.update(extra)
    parts = ", ".join(f"{n} AS ({sql})" for n, sql in done.items())
    return f"WITH {'RECURSIVE ' if recursive else ''}{parts} {body}" if done else body
