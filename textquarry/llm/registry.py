"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from textquarry.llm import bpe, decontaminate, html_text, near_dup, passages, pii, quality, secrets, suffix_dedup, token_files

QUERIES = {"op1_suffix_dedup": suffix_dedup.op1_suffix_dedup, "op2_pii": pii.op2_pii, "op3_bpe": bpe.op3_bpe, "op4_passages": passages.op4_passages, "op5_secret_scan": secrets.op5_secret_scan, "op6_near_duplicates": near_dup.op6_near_duplicates, "op7_decontamination": decontaminate.op7_decontamination, "op8_quality_rules": quality.op8_quality_rules, "op10_html_text": html_text.op10_html_text, "op9_token_files": token_files.op9_token_files}
SQL: dict[str, str] = {"op1_suffix_dedup": suffix_dedup.SQL, "op7_decontamination": decontaminate.SQL, "op6_near_duplicates": near_dup.SQL}
