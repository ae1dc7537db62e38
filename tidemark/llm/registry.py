"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from tidemark.llm import bpe, counts, decontam, langid, maxent, media, packing, pii, quality, simhash

QUERIES = {
    "op4_lm": maxent.op4_lm,
    "op1_pii": pii.op1_pii,
    "op5_quality": quality.op5_quality,
    "op6_media": media.op6_media,
    "op7_packing": packing.op7_packing,
    "op9_token_counts": counts.op9_token_counts,
    "op10_language": langid.op10_language,
    "op2_decontaminate": decontam.op2_decontaminate,
    "op3_simhash": simhash.op3_simhash,
    "op8_bpe": bpe.op8_bpe,
}

ORACLE_SQL: dict[str, str] = {
    "op2_decontaminate": decontam.OP2_SQL,
}
