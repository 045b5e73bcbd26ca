"""Ordered rule classification."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed
from ..functions.text import plain_ascii, rx
from ..functions.times import as_datetime, within
from .once import compute_once
from .parse import parse


def literal_prefix(pattern: str) -> str:
    """Leading literal text of a pattern: a cheap substring every match must contain."""
    head = re.match(r"[\w%/ -]*", pattern).group(0)
    rest = pattern[len(head):]
    if "|" in re.sub(r"\([^()]*\)", "", rest):
        return ""
    return head[:-1] if rest[:1] in ("?", "*", "{") else head


def _quoted(value: str) -> str:
    """A raw SQL string literal."""
    quote = '"' if "'" in value else "'"
    return f"r{quote}{value}{quote}"


def _matches(raw: str, pattern: str) -> str:
    """SQL test whether the pattern occurs in ``raw``, after a cheap test for its literal head.

    ``_tail`` is the text after the only ``%`` of the line (NULL when there are more or none), so a
    head that begins with ``%`` is a prefix test.
    """
    head = literal_prefix(pattern)
    present = f"contains({raw}, {_quoted(head)})"
    if head.startswith("%"):
        present = f"coalesce(startswith(_tail, {_quoted(head[1:])}), {present})"
    if head == pattern:
        return present
    found = (f"if(_ascii, {raw} RLIKE {_quoted(rx(pattern, ascii_only=True))}, "
             f"{raw} RLIKE {_quoted(rx(pattern))})")
    return f"if({present}, {found}, false)"


def _rule_struct(rule) -> str:
    return (f"named_struct('rule_id', {_quoted(rule.id)}, 'classification', {_quoted(rule.classification)}, "
            f"'event_type', {_quoted(rule.event_type)}, 'notify', {str(rule.notify).lower()}, "
            f"'summary_template', {_quoted(rule.summary_template)})")


def classify(df: DataFrame, rules=fixed.RULES, default=fixed.UNKNOWN_RULE, raw: str = "raw") -> DataFrame:
    """Columns of the first rule whose pattern occurs in ``raw``; rules are rows, order decides.

    The patterns run once to find the rule's ordinal; its columns are one array lookup.
    """
    text = F.col(raw)
    after = F.substring_index(text, "%", -1)
    only = F.length(text) - F.length(after) == F.instr(text, "%")
    hints = compute_once(df, {"_tail": F.when(only & text.contains("%"), after), "_ascii": plain_ascii(text)})
    cases = " ".join(f"WHEN {_matches(raw, r.pattern)} THEN {i}" for i, r in enumerate(rules))
    table = ", ".join(_rule_struct(r) for r in [*rules, default])
    rule = F.expr(f"get(array({table}), CASE {cases} ELSE {len(rules)} END)")
    added = ("rule_id", "classification", "event_type", "notify", "summary_template")
    kept = [c for c in df.columns if c not in added]
    return compute_once(hints, {"_rule": rule}).select(*kept, "_rule.*")


def reclassify(alerts: DataFrame, as_of, rules=fixed.RULES, days: int = 7, limit: int | None = None,
               hardware_noise: bool = True) -> DataFrame:
    """Recent alerts whose stored classification differs from what the rules say now.

    ``limit`` keeps the newest rows, as the original start-up job does; by default all are checked.
    """
    recent = within(alerts, as_datetime(as_of) - dt.timedelta(days=days))
    if limit is not None:
        recent = recent.orderBy(F.desc("timestamp"), F.desc("alert_id")).limit(limit)
    kept = recent.where(F.coalesce(F.col("raw"), F.lit("")) != "")
    if hardware_noise:
        kept = kept.where(
            ~(F.col("mnemonic").isin(fixed.HARDWARE_MNEMONICS) & (F.col("classification") == "NOISE"))
        )
    lines = kept.select("alert_id", F.col("classification").alias("old_classification"), "raw")
    return (
        classify(parse(lines, as_of), rules)
        .where("classification <> old_classification")
        .select("alert_id", "old_classification", "classification")
    )


def apply_reclassification(alerts: DataFrame, changes: DataFrame) -> DataFrame:
    """P24 write-back: the whole table with the changed classifications."""
    new = changes.select("alert_id", F.col("classification").alias("_new"))
    return (
        alerts.join(new, "alert_id", "left")
        .withColumn("classification", F.coalesce("_new", "classification"))
        .drop("_new")
    )


def classification_changes(alerts: DataFrame, changes: DataFrame) -> DataFrame:
    """P24 write-back as change rows: the dates of what :func:`reclassify` found."""
    rows = alerts.select(F.to_date("timestamp").alias("event_date"), "alert_id")
    return rows.join(changes.select("alert_id", "classification"), "alert_id")
