"""Column-level building blocks (pure expressions, evaluated on executors)."""

from .columns import (as_double, clean_value, is_missing, numeric_columns, qcol,
                      safe_corr)
from .dates import DATETIME_FORMATS, FREQS, as_timestamp, parse_datetime, period_label
from .masks import mask_email, mask_financial, mask_id
from .text import (py_strip, redact_secrets, sanitize_markdown, split_lines, strip_scripts,
                   token_budget, token_estimate)

__all__ = [
    "as_double", "clean_value", "is_missing", "numeric_columns", "qcol", "safe_corr", "DATETIME_FORMATS", "FREQS",
    "as_timestamp", "parse_datetime", "period_label", "mask_email", "mask_financial",
    "mask_id", "py_strip", "redact_secrets", "sanitize_markdown", "split_lines",
    "strip_scripts", "token_budget", "token_estimate",
]
