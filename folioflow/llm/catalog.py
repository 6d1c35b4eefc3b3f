"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import kdtree, lexical, line_dedup, mixing, near_dup
from .alignment import op13_token_alignment
from .kdtree import op10_kdtree_topk
from .lexical import op11_lexical_search
from .line_dedup import op12_line_dedup
from .mixing import op6_source_mixing
from .near_dup import op7_near_duplicates
from .pii import op4_personal_data
from .prefix_hash import op8_prefix_fingerprints
from .quality import op2_quality_classifier
from .secrets import op1_secret_scan
from .spm import op5_sentencepiece
from .suffix_dedup import op3_suffix_dedup
from .tokens import op9_token_counts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secret_scan, op2_quality_classifier, op3_suffix_dedup, op4_personal_data, op5_sentencepiece, op6_source_mixing, op7_near_duplicates, op8_prefix_fingerprints, op9_token_counts, op10_kdtree_topk, op11_lexical_search, op12_line_dedup, op13_token_alignment)}


def oracles() -> dict[str, str]:
    return {"op6_source_mixing": mixing.ORACLE, "op7_near_duplicates": near_dup.ORACLE, "op10_kdtree_topk": kdtree.ORACLE, "op11_lexical_search": lexical.ORACLE, "op12_line_dedup": line_dedup.ORACLE}
