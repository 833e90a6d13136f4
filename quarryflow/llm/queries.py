"""The operators of this subpackage as queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontam, digest, packing, pii, quality, repeats, simhash, toxicity, warc
from .common import table as t


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": lambda s, d: pii.op1_pii(t(s, d, "documents")),
        "op2_toxicity": lambda s, d: toxicity.op2_toxicity(t(s, d, "documents"), t(s, d, "labels")),
        "op3_simhash": lambda s, d: simhash.op3_simhash(t(s, d, "documents")),
        "op4_repeats": lambda s, d: repeats.op4_repeats(t(s, d, "documents")),
        "op5_packing": lambda s, d: packing.op5_packing(t(s, d, "documents")),
        "op6_quality": lambda s, d: quality.op6_quality(t(s, d, "documents"), t(s, d, "labels")),
        "op7_warc": lambda s, d: warc.op7_warc(t(s, d, "pages")),
        "op8_digest": lambda s, d: digest.op8_digest(t(s, d, "documents")),
        "op9_chat": lambda s, d: chat.op9_chat(t(s, d, "conversations")),
        "op10_decontam": lambda s, d: decontam.op10_decontam(t(s, d, "documents"), t(s, d, "benchmark")),
        "near_phrases": lambda s, d: decontam.near_phrases(t(s, d, "documents"), t(s, d, "benchmark")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_repeats": repeats.ORACLE, "op7_warc": warc.ORACLE, "op9_chat": chat.ORACLE, "op10_decontam": decontam.ORACLE}
