"""Interface dimension from pipe-separated text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

DASHES = ["", "—", "-", "–"]


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def parse_interface_lines(lines: DataFrame, text: str = "value", order: str = "line_no") -> DataFrame:
    """Lines -> hostname, interface, description, bundle; the last line of a key wins."""
    clean = lines.withColumn("_t", _strip(F.col(text))).where((F.col("_t") != "") & ~F.col("_t").startswith("#"))
    parts = clean.withColumn("_p", F.transform(F.split("_t", r"\|"), _strip)).where(F.size("_p") >= 3)
    bundle = F.coalesce(F.get("_p", F.lit(3)), F.lit(""))
    rows = parts.select(
        F.get("_p", F.lit(0)).alias("hostname"),
        F.regexp_replace(F.get("_p", F.lit(1)), r"(?U)\s+l2transport$", "").alias("interface"),
        F.struct(F.get("_p", F.lit(2)).alias("description"), F.when(~bundle.isin(DASHES), bundle).alias("bundle")).alias("v"),
        F.col(order).alias("_o"),
    )
    last = rows.groupBy("hostname", "interface").agg(F.max_by("v", "_o").alias("v"))
    return last.select("hostname", "interface", "v.description", "v.bundle")


def load_interface_dim(spark: SparkSession, path: str) -> DataFrame:
    """S8 from text files. Lines are ordered by file, split offset and place within the split."""
    order = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    return parse_interface_lines(spark.read.text(path).select("value", order.alias("line_no")))
