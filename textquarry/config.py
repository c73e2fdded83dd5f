"""Constants of the analysis, in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    """Fixed values of the behaviour; change one only together with stored scores."""

    similarity: float = 0.35
    medium: float = 35.0
    high: float = 65.0
    quote_words: int = 20
    single_quote_words: int = 40
    score_model: int = 3
    cohort_minimum: int = 3
    template_divisor: int = 3
    template_sample: int = 60
    latin_floor: float = 0.5
    prose_words: int = 8
    little_prose: int = 40
    matches: int = 10
    table_rows: int = 300
    section_bytes: int = 40
    document_bytes: int = 40
    compare_bytes: int = 100
    text_chars: int = 65_000
    evidence_bytes: int = 180
    per_check: int = 12
    words_per_minute: int = 60
    provenance_words: int = 200
    field_chars: int = 256
    layer_chars: int = 120
    letter_ratio: float = 0.45
    replacement_ratio: float = 0.01
    pending_batch: int = 15
    grace_seconds: int = 300
    backfill_grace_seconds: int = 3600
    scan_batch: int = 20
    head_room: int = 5
    retention_days: int = 90


DEFAULT = Thresholds()
