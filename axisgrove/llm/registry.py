"""The queries of this subpackage's operators and, where SQL can express one, the SQL of its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op1_decontaminate, op2_pii, op3_html, op4_mix, op5_rules, op6_quality, op7_license, op8_minhash, op9_lm, op10_language


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": op1_decontaminate.op1_decontaminate,
        "op2_pii": op2_pii.op2_pii,
        "op3_html": op3_html.op3_html,
        "op4_mix": op4_mix.op4_mix,
        "op5_quality_rules": op5_rules.op5_quality_rules,
        "op6_quality": op6_quality.op6_quality,
        "op7_license_scan": op7_license.op7_license_scan,
        "op8_minhash": op8_minhash.op8_minhash,
        "op9_lm": op9_lm.op9_lm,
        "op10_language": op10_language.op10_language,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontaminate": op1_decontaminate.OP1_SQL,
        "op5_quality_rules": op5_rules.OP5_SQL,
        "op7_license_scan": op7_license.OP7_SQL,
        "op8_minhash": op8_minhash.OP8_SQL,
    }
