"""The operators' queries, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from statuta.llm.columns import JOIN_SQL, OWN
from statuta.llm.fingerprints import op2_winnowing
from statuta.llm.langid import op6_language_id
from statuta.llm.mixing import op3_source_mixing
from statuta.llm.ngram_join import op7_ngram_jaccard_join
from statuta.llm.packing import op1_best_fit_packing
from statuta.llm.pii import op10_bootstrapped_pii
from statuta.llm.quality import op9_quality_rules
from statuta.llm.sharding import op8_compaction
from statuta.llm.toxicity import op5_toxicity
from statuta.llm.url_filter import OP4_SQL, op4_url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_best_fit_packing, op2_winnowing, op3_source_mixing, op4_url_filter, op5_toxicity, op6_language_id, op7_ngram_jaccard_join, op8_compaction, op9_quality_rules, op10_bootstrapped_pii]
    return {f.__name__: f for f in own} | {name: f for name, (f, _) in OWN.items()}


def oracle_sql() -> dict[str, str]:
    return {"op4_url_filter": OP4_SQL, "op7_ngram_jaccard_join": JOIN_SQL} | {name: sql for name, (_, sql) in OWN.items()}
