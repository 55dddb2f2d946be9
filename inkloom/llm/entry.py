"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bm25_decontam import op2_bm25_decontam
from .chat_format import op3_chat_format, op3_sql
from .dominance import OP12_SQL, op12_dominance
from .fst_tokens import op1_token_counts
from .jaccard_join import OP9_SQL, op9_jaccard_join
from .license_scan import op5_license_scan, op5_sql
from .multiprobe_lsh import op8_multiprobe_lsh
from .quality_gam import op10_quality_gam
from .sharding import op7_sharding, op7_sql
from .span_crf import op11_pii_spans
from .source_mix import OP4_SQL, op4_source_mix
from .turn_repair import op13_sql, op13_turn_repair
from .url_filter import OP6_SQL, op6_url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_token_counts, op2_bm25_decontam, op3_chat_format, op4_source_mix, op5_license_scan, op6_url_filter, op7_sharding, op8_multiprobe_lsh, op9_jaccard_join, op10_quality_gam, op11_pii_spans, op12_dominance, op13_turn_repair)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    """Where SQL can express a query and is fast enough on whole tables; the others are tested against brute force."""
    return {"op3_chat_format": op3_sql(), "op4_source_mix": OP4_SQL, "op5_license_scan": op5_sql(), "op6_url_filter": OP6_SQL, "op7_sharding": op7_sql(), "op9_jaccard_join": OP9_SQL, "op12_dominance": OP12_SQL, "op13_turn_repair": op13_sql()}
