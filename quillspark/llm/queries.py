"""The registered queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, fill_middle, line_dedup, manifest, near_dedup, quality, substring_dedup
from .byte_bpe import op5_byte_bpe
from .classifier import op8_importance
from .decontaminate import op6_decontamination
from .fill_middle import op13_fill_middle
from .html_text import op2_html_text
from .line_dedup import op11_line_dedup
from .manifest import op12_manifest
from .near_dedup import op10_near_duplicates
from .quality import op1_quality_rules
from .secrets import op9_secrets
from .sharding import op3_shards
from .substring_dedup import op7_substring_dedup
from .token_counts import op4_token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality_rules, op2_html_text, op3_shards, op4_token_counts, op5_byte_bpe, op6_decontamination, op7_substring_dedup, op8_importance, op9_secrets, op10_near_duplicates, op11_line_dedup, op12_manifest, op13_fill_middle)
}

SQL: dict[str, str] = {"op1_quality_rules": quality.SQL, "op6_decontamination": decontaminate.SQL, "op10_near_duplicates": near_dedup.SQL, "op7_substring_dedup": substring_dedup.SQL, "op11_line_dedup": line_dedup.SQL, "op12_manifest": manifest.SQL, "op13_fill_middle": fill_middle.SQL}
