"""The registered queries of the package, one for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    conversations, decontaminate, fill_middle, language, licences, line_rules, mixing, packing, passages, pii, simhash, url_filter,
    weak_labels,
)
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_weak_label_quality": lambda s, d: weak_labels.digest(table(s, d, "documents")),
        "op2_url_bloom_filter": lambda s, d: url_filter.digest(table(s, d, "pages")),
        "op3_benchmark_windows": lambda s, d: decontaminate.digest(table(s, d, "documents"), table(s, d, "benchmark")),
        "op4_vector_packing": lambda s, d: packing.digest(table(s, d, "documents")),
        "op5_simhash_gray_index": lambda s, d: simhash.digest(table(s, d, "documents")),
        "op6_source_mixing": lambda s, d: mixing.digest(table(s, d, "documents")),
        "op7_language_fusion": lambda s, d: language.digest(table(s, d, "documents"), table(s, d, "pages")),
        "op8_personal_data": lambda s, d: pii.digest(table(s, d, "documents")),
        "op9_line_rules": lambda s, d: line_rules.digest(table(s, d, "documents")),
        "op10_license_sentences": lambda s, d: licences.digest(table(s, d, "documents")),
        "op11_auction_repair": lambda s, d: conversations.digest(table(s, d, "conversations")),
        "op12_fill_middle": lambda s, d: fill_middle.digest(table(s, d, "documents")),
        "op13_difference_cover": lambda s, d: passages.digest(table(s, d, "documents")),
    }
