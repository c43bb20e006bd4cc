"""The registered queries of this folder and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from laneflow.llm import (
    bpe,
    bytespans,
    chat,
    containment,
    lines,
    pii,
    quality,
    resampling,
    simhash,
    templates,
    toxicity,
    whitening,
    wordspans,
)

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_template": templates.op1_template,
    "op2_suffixes": bytespans.op2_suffixes,
    "op3_chat": chat.op3_chat,
    "op4_line_frequency": lines.op4_line_frequency,
    "op5_containment": containment.op5_containment,
    "op6_bilstm": pii.op6_bilstm,
    "op7_doubling": wordspans.op7_doubling,
    "op8_simhash": simhash.op8_simhash,
    "op9_weak_supervision": toxicity.op9_weak_supervision,
    "op10_bpe": bpe.op10_bpe,
    "op11_resampling": resampling.op11_resampling,
    "op12_whitening": whitening.op12_whitening,
    "op13_boosted_quality": quality.op13_boosted_quality,
}

SQL: dict[str, str] = {
    "op3_chat": chat.SQL,
    "op4_line_frequency": lines.SQL,
    "op5_containment": containment.SQL,
    "op7_doubling": wordspans.SQL,
    "op11_resampling": resampling.SQL,
}
