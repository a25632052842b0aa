"""The queries of this subpackage and their SQL, for the repository's entry file."""

from __future__ import annotations

import corpus_pipeline
from waymark.llm import codes, decontaminate, exact, huffman, manifest, mixing, near, pii, quality, rules, tokens, toxicity, warc


def queries() -> dict:
    return {
        "op1_decontamination": decontaminate.op1_decontamination,
        "op2_mixing": mixing.op2_mixing,
        "op3_warc": warc.op3_warc,
        "op4_near_duplicates": near.op4_near_duplicates,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_quality": quality.op6_quality,
        "op7_quality_rules": rules.op7_quality_rules,
        "op8_token_counts": tokens.op8_token_counts,
        "op9_personal_data": pii.op9_personal_data,
        "op10_token_ids": huffman.op10_token_ids,
        "op11_vector_codes": codes.op11_vector_codes,
        "op12_merkle_manifest": manifest.op12_merkle_manifest,
        "op13_exact_dedup": exact.op13_exact_dedup,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": decontaminate.OP1_SQL, "op2_mixing": mixing.OP2_SQL, "op3_warc": warc.OP3_SQL, "op11_vector_codes": codes.OP11_SQL, "op12_merkle_manifest": manifest.OP12_SQL, "op13_exact_dedup": exact.OP13_SQL}
