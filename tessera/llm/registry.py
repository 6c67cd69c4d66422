"""The subpackage's queries and SQL, by name."""

from __future__ import annotations

from tessera.llm import decontamination, language_id, line_dedup, lm_scoring, packing, quality, run_index, secrets, simhash, sql, token_counts


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            packing.op1_packing,
            simhash.op2_simhash_near_dedup,
            token_counts.op3_token_counts,
            decontamination.op4_decontamination,
            language_id.op5_language_id,
            lm_scoring.op6_lm_scoring,
            quality.op7_quality_rules,
            line_dedup.op8_substring_dedup,
            run_index.op9_suffix_array_dedup,
            secrets.op10_secret_scans,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_quality_rules": sql.QUALITY, "op8_substring_dedup": sql.LINES, "op10_secret_scans": sql.SECRETS}
