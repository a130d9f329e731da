"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, importance, langid, licenses, media, mixing, phrases, prefix_trie, quality_rules, sharding, simhash, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_langid": langid.op1,
    "op2_sharding": sharding.op2,
    "op3_simhash": simhash.op3,
    "op4_bpe": bpe.op4,
    "op5_media": media.op5,
    "op6_toxicity": toxicity.op6,
    "op7_warc": warc.op7,
    "op8_mixing": mixing.op8,
    "op9_quality_rules": quality_rules.op9,
    "op10_importance_resampling": importance.op10,
    "op11_prefix_trie": prefix_trie.op11,
    "op12_licenses": licenses.op12,
    "op13_phrases": phrases.op13,
}

ORACLE_SQL: dict[str, str] = {
    "op7_warc": warc.ORACLE_SQL,
    "op9_quality_rules": quality_rules.ORACLE_SQL,
    "op11_prefix_trie": prefix_trie.ORACLE_SQL,
    "op12_licenses": licenses.ORACLE_SQL,
    "op13_phrases": phrases.ORACLE_SQL,
}
