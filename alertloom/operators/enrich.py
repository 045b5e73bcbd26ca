"""P5-P20: enrichment from messages and dimension tables.

Dimension joins carry no broadcast hint: Catalyst and AQE broadcast a side when its measured size
is under the threshold and shuffle it otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed, text
from ..functions.times import ntz
from .once import compute_once


def extract_fields(df: DataFrame) -> DataFrame:
    """Interface, BGP neighbor, AS number and VRF."""
    return compute_once(df, {
        "interface_name": text.extract_interface(F.col("message")),
        "bgp_neighbor": text.extract_neighbor(F.col("message")),
        "as_number": text.extract_as_number(F.col("raw")),
        "vrf": text.extract_vrf(F.col("raw")),
    })


def join_device(df: DataFrame, device: DataFrame) -> DataFrame:
    """device(ip, name, hostname, location) by source ip, else ``UNKNOWN-{ip}``."""
    dim = device.select(
        F.col("ip").alias("source_ip"), F.col("name").alias("_name"),
        F.col("hostname").alias("_host"), F.col("location").alias("_loc"),
    )
    return (
        df.join(dim, "source_ip", "left")
        .withColumns({
            "device_name": F.coalesce("_name", F.concat(F.lit("UNKNOWN-"), "source_ip")),
            "device_location": F.coalesce("_loc", F.lit("")),
            "device_hostname": F.coalesce("_host", F.lit("")),
        })
        .drop("_name", "_host", "_loc")
    )


def join_interface(df: DataFrame, iface: DataFrame) -> DataFrame:
    """interface(hostname, interface, description, bundle) by host and normalised name."""
    host = F.when(F.col("device_hostname") != "", F.col("device_hostname")).otherwise(F.col("device_name"))
    dim = iface.select(
        F.col("hostname").alias("_h"), F.col("interface").alias("_i"),
        F.col("description").alias("_desc"), F.col("bundle").alias("_bundle"),
    )
    key = F.when(F.col("interface_name") != "", text.normalise_interface(F.col("interface_name")))
    keyed = df.withColumns({"_h": host, "_i": key})
    return (
        keyed.join(dim, ["_h", "_i"], "left")
        .withColumns({
            "interface_description": F.coalesce("_desc", F.lit("")),
            "bundle_parent": F.coalesce("_bundle", F.lit("")),
            "client_name": F.coalesce(text.derive_client(F.col("_desc")), F.lit("")),
        })
        .drop("_h", "_i", "_desc", "_bundle")
    )


def join_as(df: DataFrame, as_dim: DataFrame) -> DataFrame:
    """P10 as the pipeline uses it: name from the static AS table, else ''."""
    dim = as_dim.select(F.col("asn").alias("as_number"), F.col("name").alias("_as"))
    return (
        df.join(dim, "as_number", "left")
        .withColumn("as_name", F.coalesce("_as", F.lit("")))
        .drop("_as")
    )


def resolve_as(df: DataFrame, as_dim: DataFrame, as_cache: DataFrame, as_of, ttl_hours: int = 24,
               asn: str = "asn") -> DataFrame:
    """P10: static table, then a cache row at most ``ttl_hours`` old, then ''; asn <= 0 gives ''."""
    fresh = as_cache.where(F.col("cached_at") >= ntz(as_of) - F.expr(f"INTERVAL '{ttl_hours}' HOUR"))
    static = as_dim.select(F.col("asn").alias(asn), F.col("name").alias("_static"))
    cached = fresh.select(F.col("asn").alias(asn), F.col("name").alias("_cached"))
    name = F.when(F.col(asn) > 0, F.coalesce("_static", "_cached"))
    return (
        df.join(static, asn, "left").join(cached, asn, "left")
        .withColumn("as_name", F.coalesce(name, F.lit("")))
        .drop("_static", "_cached")
    )


def upsert_as_cache(cache: DataFrame, new: DataFrame, as_of) -> DataFrame:
    """Insert or replace by asn; ``new`` rows get ``cached_at = as_of``.

    Several new rows of one asn need an order: the greatest ``(name, as_type, source)`` stays.
    """
    cols = ["asn", "name", "as_type", "source", "cached_at"]
    stamped = new.select(*cols[:4], ntz(as_of).alias("cached_at"), F.lit(1).alias("_new"))
    both = cache.select(*cols, F.lit(0).alias("_new")).unionByName(stamped)
    rank = F.struct("_new", "cached_at", "name", "as_type", "source")
    best = both.groupBy("asn").agg(F.max(rank).alias("r"))
    return best.select("asn", "r.name", "r.as_type", "r.source", "r.cached_at")


def enrich(parsed: DataFrame, device: DataFrame, iface: DataFrame, as_dim: DataFrame) -> DataFrame:
    """P5-P10 over classified rows."""
    return join_as(join_interface(join_device(extract_fields(parsed), device), iface), as_dim)


def render_summary(df: DataFrame) -> DataFrame:
    """The rule's summary template filled from the row."""
    message = F.col("message")
    fields = {
        "device": F.col("device_name"), "neighbor": F.col("bgp_neighbor"),
        "as_number": F.col("as_number"), "interface": F.col("interface_name"),
        "bundle": text.first_group(message, r"(Bundle-Ether\d+)", "Bundle-Ether"),
        "prefix_count": maxpfx_count(message), "max_prefixes": maxpfx_limit(message),
        "address": text.first_group(message, r"address\s+(\S+)", "address"),
        "user": login_user(message), "source_ip": login_source(message), "raw": F.col("raw"),
    }
    return df.withColumn("summary", text.render_template(F.col("summary_template"), fields))


def login_user(message: Column) -> Column:
    return text.first_group(message, r"(?i)\buser\s+'([^']*)'")


def login_source(message: Column) -> Column:
    return text.first_group(message, r"\bfrom\s+'([^']*)'", "from")


def extract_login(df: DataFrame) -> DataFrame:
    """One row per SSH login or logout."""
    m = F.col("message")
    action = F.when(F.col("rule_id") == "SSH_LOGIN", "login").otherwise("logout")
    return df.where(F.col("rule_id").isin("SSH_LOGIN", "SSH_LOGOUT")).withColumns({
        "username": F.coalesce(login_user(m), F.lit("")),
        "login_ip": F.coalesce(login_source(m), F.lit("")),
        "vty": F.coalesce(text.first_group(m, r"\bon\s+'([^']*)'"), F.lit("")),
        "cipher": F.coalesce(text.first_group(m, r"\(cipher\s+'([^']*)'", "(cipher"), F.lit("")),
        "action": action,
    })


def maxpfx_count(message: Column) -> Column:
    return text.first_group(message, r"\bhas reached\s+(\d+)", "has reached").try_cast("bigint")


def maxpfx_limit(message: Column) -> Column:
    return text.first_group(message, r"\bmax\s+(\d+)", "max").try_cast("bigint")


def extract_maxpfx(df: DataFrame) -> DataFrame:
    """Peer, prefix count and limit of max-prefix messages."""
    m = F.col("message")
    return df.where(F.col("mnemonic") == "MAXPFX").withColumns({
        "peer": F.coalesce(text.first_group(m, r"\bfrom\s+(\S+)", "from"), F.lit("")),
        "prefix_count": maxpfx_count(m),
        "max_prefixes": maxpfx_limit(m),
    })


def bgp_direction(df_rule: Column, mnemonic: Column, message: Column) -> Column:
    """``down`` / ``up`` / NULL of a BGP event, by rule or by words in an ADJCHANGE message."""
    low = F.lower(message)
    adj = mnemonic == "ADJCHANGE"
    return F.when(
        df_rule.isin("BGP_DOWN", "BGP_MAXPFX") | (adj & low.contains("down")), "down"
    ).when((df_rule == "BGP_UP") | (adj & low.contains(" up")), "up")


def bgp_state_history(df: DataFrame) -> DataFrame:
    """Per ADJCHANGE event its peer state; FLAPPING where the flap rule (D2) says so.

    ``df`` is enriched rows joined with the dedup decision column ``reason``.
    """
    state = F.when(F.col("reason") == "flapping", "FLAPPING").otherwise(
        F.initcap(bgp_direction(F.col("rule_id"), F.col("mnemonic"), F.col("message")))
    )
    return (
        df.where((F.col("mnemonic") == "ADJCHANGE") & (F.col("bgp_neighbor") != ""))
        .withColumns({"neighbor": F.col("bgp_neighbor"), "state": state,
                      "as_number": F.coalesce("as_number", F.lit(0))})
        .where("state IS NOT NULL")
    )


def member_bundles(topology: DataFrame) -> DataFrame:
    """(ip, interface) -> first declared bundle of topology(ip, bundle, ordinal, remote_ip, members)."""
    return (
        topology.select("ip", "bundle", "ordinal", F.explode("members").alias("interface"))
        .groupBy("ip", "interface")
        .agg(F.min_by("bundle", F.struct("ordinal", "bundle")).alias("bundle"))
    )


def join_member(df: DataFrame, topology: DataFrame) -> DataFrame:
    """Adds ``member_bundle``: the backhaul bundle the row's interface belongs to, or NULL."""
    dim = member_bundles(topology).select(
        F.col("ip").alias("source_ip"), F.col("interface").alias("interface_name"),
        F.col("bundle").alias("member_bundle"),
    )
    return df.join(dim, ["source_ip", "interface_name"], "left")


def hardware_noise(df: DataFrame, topology: DataFrame, enabled: bool = True) -> DataFrame:
    """Hardware defects on backhaul members become NOISE in the live view."""
    if not enabled:
        return df
    noisy = F.col("mnemonic").isin(fixed.HARDWARE_MNEMONICS) & F.col("member_bundle").isNotNull()
    return (
        join_member(df, topology)
        .withColumn("classification", F.when(noisy, "NOISE").otherwise(F.col("classification")))
        .drop("member_bundle")
    )


def event_bundle(df: DataFrame, topology: DataFrame, bgp_bundle: DataFrame) -> DataFrame:
    """``member_bundle``, the bundle an event rides (``event_bundle``) and its far end."""
    peers = bgp_bundle.select(
        F.col("ip").alias("source_ip"), F.col("neighbor").alias("bgp_neighbor"),
        F.col("bundle").alias("_peer_bundle"),
    )
    links = topology.select(
        F.col("ip").alias("source_ip"), F.col("bundle").alias("event_bundle"),
        F.col("remote_ip").alias("event_remote"),
    )
    return (
        join_member(df, topology)
        .join(peers, ["source_ip", "bgp_neighbor"], "left")
        .withColumn("event_bundle", F.coalesce("member_bundle", "_peer_bundle"))
        .drop("_peer_bundle")
        .join(links, ["source_ip", "event_bundle"], "left")
    )


def with_recovery(df: DataFrame) -> DataFrame:
    """P16 as a column."""
    return df.withColumn(
        "is_recovery", text.is_recovery(F.col("mnemonic"), F.col("message"), F.col("rule_id"))
    )


def with_title(df: DataFrame, device: str = "device_name") -> DataFrame:
    """P19 as a column."""
    return df.withColumn("title", text.incident_title(
        F.col("mnemonic"), F.col(device), F.col("message"), F.col("interface_name"), F.col("as_name")
    ))


def with_group_key(df: DataFrame) -> DataFrame:
    """P20 as a column."""
    return df.withColumn("group_key", text.incident_group_key(
        F.col("device_name"), F.col("mnemonic"), F.col("interface_name"), F.col("bgp_neighbor"),
        F.coalesce("as_number", F.lit(0)), F.col("message"),
    ))
