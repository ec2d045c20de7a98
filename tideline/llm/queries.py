"""All queries of the subpackage, registered by importing their modules."""

from __future__ import annotations

from tideline.llm import (  # noqa: F401
    chat,
    exact_dedup,
    knn_join,
    lexical_search,
    line_dedup,
    mixing,
    ngram_join,
    packing,
    pages,
    quality,
    quality_rules,
    spelling,
    suffix_dedup,
)
from tideline.llm.registry import ORACLES, QUERIES  # noqa: F401
