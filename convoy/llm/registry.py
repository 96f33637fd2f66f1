"""The queries of this folder by name, and their DuckDB SQL where there is any."""

from __future__ import annotations

from convoy.llm import contamination, jaccard_join, language_id, merkle, mixing, packing, periodic_runs, sharding, substring_dedup, token_counts, token_files, url_filter, vector_dedup
from convoy.llm.shared import usual_batches


def with_usual_batches(query):
    """A query of the rest of the library, run with the settings that the session had before a query of this folder."""

    def run(spark, folder):
        usual_batches(spark)
        return query(spark, folder)

    return run


def queries() -> dict:
    return {
        "op1_character_ratio": url_filter.op1_character_ratio,
        "op2_recompression": substring_dedup.op2_recompression,
        "op3_token_groups": jaccard_join.op3_token_groups,
        "op4_hierarchical_budgets": mixing.op4_hierarchical_budgets,
        "op5_hash_tree": sharding.op5_hash_tree,
        "op6_prefix_counts": token_counts.op6_prefix_counts,
        "op7_token_files": token_files.op7_token_files,
        "op8_containment": contamination.op8_containment,
        "op9_hamming_tables": vector_dedup.op9_hamming_tables,
        "op10_byte_network": language_id.op10_byte_network,
        "op11_merkle_manifest": merkle.op11_merkle_manifest,
        "op12_periodic_runs": periodic_runs.op12_periodic_runs,
        "op13_cost_packing": packing.op13_cost_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_character_ratio": url_filter.ORACLE_SQL,
        "op2_recompression": substring_dedup.ORACLE_SQL,
        "op3_token_groups": jaccard_join.ORACLE_SQL,
        "op4_hierarchical_budgets": mixing.ORACLE_SQL,
        "op8_containment": contamination.ORACLE_SQL,
        "op9_hamming_tables": vector_dedup.ORACLE_SQL,
        "op11_merkle_manifest": merkle.ORACLE_SQL,
    }
