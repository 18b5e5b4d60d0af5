"""The queries of this subpackage and, where SQL can state them, the same in DuckDB's SQL."""

from __future__ import annotations

from tidegraph.llm import mixing, near_dedup, neighbours
from tidegraph.llm.fingerprints import op8_fingerprints
from tidegraph.llm.language_id import op5_language_id
from tidegraph.llm.mixing import op9_mix_sources
from tidegraph.llm.near_dedup import op6_near_dedup
from tidegraph.llm.neighbours import op7_nearest
from tidegraph.llm.packing import op2_pack
from tidegraph.llm.quality import op3_quality
from tidegraph.llm.sharding import op4_shards
from tidegraph.llm.token_counts import op1_token_counts
from tidegraph.llm.tree_weighting import op10_lm_scores


def queries() -> dict:
    found = (op1_token_counts, op2_pack, op3_quality, op4_shards, op5_language_id, op6_near_dedup, op7_nearest, op8_fingerprints, op9_mix_sources, op10_lm_scores)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op6_near_dedup": near_dedup.ORACLE, "op7_nearest": neighbours.ORACLE, "op9_mix_sources": mixing.ORACLE}
