"""The registered queries of the text operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tableforge.llm.align import alignment_query
from tableforge.llm.language import language_query
from tableforge.llm.lines import LINE_SQL, line_digest
from tableforge.llm.lm import LM_SQL, lm_query
from tableforge.llm.mixing import MIX_SQL, mix_digest
from tableforge.llm.near import NEAR_SQL, near_query
from tableforge.llm.phrases import PHRASE_SQL, decontamination_query
from tableforge.llm.pieces import pieces_query
from tableforge.llm.quality import quality_query
from tableforge.llm.repair import REPAIR_SQL, repair_query
from tableforge.llm.search import TOP_SQL, top_k
from tableforge.llm.secrets import secrets_digest
from tableforge.llm.suffixes import repeats_digest
from tableforge.llm.texts import read

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_language_id": lambda spark, d: language_query(read(spark, d, "documents")),
    "op2_mix_sources": lambda spark, d: mix_digest(read(spark, d, "documents")),
    "op3_lm_scores": lambda spark, d: lm_query(read(spark, d, "documents")),
    "op4_pieces": lambda spark, d: pieces_query(read(spark, d, "documents")),
    "op5_line_dedup": lambda spark, d: line_digest(read(spark, d, "documents")),
    "op6_near_dedup": lambda spark, d: near_query(read(spark, d, "documents")),
    "op7_top_k": lambda spark, d: top_k(read(spark, d, "embeddings")),
    "op8_quality_rules": lambda spark, d: quality_query(
        read(spark, d, "documents"), read(spark, d, "labels")
    ),
    "op9_secret_scan": lambda spark, d: secrets_digest(read(spark, d, "documents")),
    "op10_repeat_removal": lambda spark, d: repeats_digest(read(spark, d, "documents")),
    "op11_token_alignment": lambda spark, d: alignment_query(read(spark, d, "documents")),
    "op12_decontamination": lambda spark, d: decontamination_query(
        read(spark, d, "documents"), read(spark, d, "benchmark")
    ),
    "op13_conversation_repair": lambda spark, d: repair_query(read(spark, d, "conversations")),
}
ORACLE_SQL: dict[str, str] = {
    "op2_mix_sources": MIX_SQL,
    "op3_lm_scores": LM_SQL,
    "op5_line_dedup": LINE_SQL,
    "op6_near_dedup": NEAR_SQL,
    "op7_top_k": TOP_SQL,
    "op12_decontamination": PHRASE_SQL,
    "op13_conversation_repair": REPAIR_SQL,
}
