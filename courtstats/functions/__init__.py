"""Column-level helpers (pure expressions, whole-stage-codegen friendly)."""

from courtstats.functions.arith import safe_div
from courtstats.functions.predicates import any_col, none_col, text_any, text_none
from courtstats.functions.text import (
    ascii_fold,
    clock_seconds,
    nth_word,
    parse_number,
    season_end_year,
    season_slug,
    title_case,
    words_range,
)

__all__ = [
    "safe_div", "any_col", "none_col", "text_any", "text_none", "ascii_fold",
    "clock_seconds", "nth_word", "parse_number", "season_end_year", "season_slug",
    "title_case", "words_range",
]
