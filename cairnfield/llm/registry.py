"""The corpus queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cairnfield.llm import host_rules, phrases, pipeline
from cairnfield.llm.decontaminate import op8_decontaminate
from cairnfield.llm.host_rules import op10_host_rules
from cairnfield.llm.license import op4_license
from cairnfield.llm.mixing import op6_mixing
from cairnfield.llm.phrases import op13_phrases
from cairnfield.llm.pieces import op11_pieces
from cairnfield.llm.pii import op1_pii
from cairnfield.llm.quality import op7_quality
from cairnfield.llm.secret_scan import op5_secrets
from cairnfield.llm.simhash import op2_simhash
from cairnfield.llm.toxicity import op9_toxicity
from cairnfield.llm.whitening import op12_whitening
from cairnfield.llm.wrapper import op3_html


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    numbered = (op1_pii, op2_simhash, op3_html, op4_license, op5_secrets, op6_mixing, op7_quality, op8_decontaminate, op9_toxicity, op10_host_rules, op11_pieces, op12_whitening, op13_phrases)
    return {f.__name__: f for f in numbered} | {"pipeline": pipeline.run}


def oracle_sql() -> dict[str, str]:
    known = {"op10_host_rules": host_rules.ORACLE_SQL, "op13_phrases": phrases.ORACLE_SQL, "pipeline": pipeline.ORACLE_SQL}
    return {name: sql for name, sql in known.items() if sql is not None}
