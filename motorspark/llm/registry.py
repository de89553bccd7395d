"""The queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from motorspark.llm import bpe, conversations, langid, licenses, line_dedup, media, packing, privacy, resampling, sharding, simhash, topk, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": licenses.op1_license_scan,
        "op2_media_columns": media.op2_media_columns,
        "op3_bpe": bpe.op3_bpe,
        "op4_topk": topk.op4_topk,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_packing": packing.op6_packing,
        "op7_line_dedup": line_dedup.op7_line_dedup,
        "op8_sharding": sharding.op8_sharding,
        "op9_langid": langid.op9_langid,
        "op10_simhash": simhash.op10_simhash,
        "op11_pii": privacy.op11_pii,
        "op12_importance_resampling": resampling.op12_importance_resampling,
        "op13_conversation_repair": conversations.op13_conversation_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_topk": topk.ORACLE, "op7_line_dedup": line_dedup.ORACLE, "op12_importance_resampling": resampling.ORACLE}
