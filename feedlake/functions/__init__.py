"""Column -> Column helpers."""
from feedlake.functions.dates import name_date, norm_date  # noqa: F401
from feedlake.functions.text import (  # noqa: F401
    WHITESPACE, after_abs, first, first_match, join_names, json_get, left_n, lstrip_chars,
    non_empty, one_line, or_default, split_lines, strip, strip_bullet, strip_tags,
)
from feedlake.functions.numbers import round_binary_half_even  # noqa: F401
