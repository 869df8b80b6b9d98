"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, exact_dedup, filter_audit, langid, licenses, maxent, mixing, quality, simhash, spelling, suffixes, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_licenses": licenses.op1_licenses,
        "op2_decontaminate": decontaminate.op2_decontaminate,
        "op3_suffix_dedup": suffixes.op3_suffix_dedup,
        "op4_warc": warc.op4_warc,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_exact_dedup": exact_dedup.op6_exact_dedup,
        "op7_quality": quality.op7_quality,
        "op8_langid": langid.op8_langid,
        "op9_simhash": simhash.op9_simhash,
        "op10_mixing": mixing.op10_mixing,
        "op11_lm_score": maxent.op11_lm_score,
        "op12_spelling": spelling.op12_spelling,
        "op13_filter_audit": filter_audit.op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_licenses": licenses.OP1_SQL, "op2_decontaminate": decontaminate.OP2_SQL, "op4_warc": warc.OP4_SQL, "op6_exact_dedup": exact_dedup.OP6_SQL, "op10_mixing": mixing.OP10_SQL, "op12_spelling": spelling.OP12_SQL, "op13_filter_audit": filter_audit.OP13_SQL}
