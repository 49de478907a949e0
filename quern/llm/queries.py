"""Queries of this subpackage for the driver contract, and their SQL where SQL can say it."""

from __future__ import annotations

from quern.llm import bpe, decontaminate, licences, pii, puquality, rules, secrets, simhash, tokencount, tokenfile

QUERIES = {
    "op1_licences": licences.op1_licences,
    "op2_pii": pii.op2_pii,
    "op3_secrets": secrets.op3_secrets,
    "op4_byte_bpe": bpe.op4_byte_bpe,
    "op5_quality_rules": rules.op5_quality_rules,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_pu_quality": puquality.op7_pu_quality,
    "op8_token_files": tokenfile.op8_token_files,
    "op9_token_counts": tokencount.op9_token_counts,
    "op10_simhash": simhash.op10_simhash,
}
ORACLE_SQL: dict[str, str] = {}
