"""The registered queries: each operator over its whole tables."""

from __future__ import annotations

from . import bpe, classes, decontaminate, language, packing, quality, secrets, sharding, simhash, spelling, suffixes, trie, windows
from .tables import read


def _documents(operator):
    return lambda spark, sf_dir: operator(read(spark, sf_dir, "documents"))


def _with(operator, name):
    return lambda spark, sf_dir: operator(read(spark, sf_dir, "documents"), read(spark, sf_dir, name))


QUERIES = {
    "op1_suffix_merge_dedup": _documents(suffixes.op1_suffix_merge_dedup),
    "op2_hash_tree_sharding": _documents(sharding.op2_hash_tree_sharding),
    "op3_bitmask_language_id": _documents(language.op3_bitmask_language_id),
    "op4_multipart_secrets": _documents(secrets.op4_multipart_secrets),
    "op5_rabin_karp_windows": _documents(windows.op5_rabin_karp_windows),
    "op6_risk_controlled_quality": _with(quality.op6_risk_controlled_quality, "labels"),
    "op7_positional_index_decontamination": _with(decontaminate.op7_positional_index_decontamination, "benchmark"),
    "op8_deletion_variant_simhash": _documents(simhash.op8_deletion_variant_simhash),
    "op9_hof_byte_bpe": _documents(bpe.op9_hof_byte_bpe),
    "op10_brown_class_bigrams": _documents(classes.op10_brown_class_bigrams),
    "op11_histogram_packing": _documents(packing.op11_histogram_packing),
    "op12_fm_spelling": _documents(spelling.op12_fm_spelling),
    "op13_bitmap_trie": lambda spark, sf_dir: trie.op13_bitmap_trie(read(spark, sf_dir, "conversations")),
}
CHECKS: dict[str, str] = {"op13_bitmap_trie": trie.ORACLE}
