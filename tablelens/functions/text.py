"""Text expressions (JVM regex, no Python per row).

Java regex differs from Python's ``re`` in a few places; the patterns below
use ``(?U)`` where Python's Unicode classes (``\\w``, ``\\s``) matter.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# These patterns must equal the reference's so that the same
# secrets are found. Applied in this order.
#   1. key names:     api key, x-api-key, "authorization: bearer"  -> keep name
#   2. database URLs: postgres, mysql, sqlite, mongodb "://" + rest -> replaced
#   3. secret words:  token, secret, password, then a value of >= 8 chars
# ---------------------------------------------------------------------------
API_KEY_RE = r"(?iU)(api[_\-]?key|x-api-key|authorization[:\s]+bearer\s+)(\S+)"
DATABASE_URL_RE = r"(?iU)(postgres|mysql|sqlite|mongodb)://\S+"
SECRET_WORD_RE = r"(?iU)(token|secret|password)[:\s]*(\S{8,})"
REDACTED = "[REDACTED]"
DATABASE_URL_REDACTED = "[DATABASE_URL_REDACTED]"

# Script blocks and inline event handlers.
SCRIPT_BLOCK_RE = r"(?is)<script[^>]*>.*?</script>"
EVENT_HANDLER_RE = r"(?iU)on\w+\s*="

# Line breaks recognised when text is split into lines (Python's splitlines set).
LINE_BREAK_RE = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029]"


def redact_secrets(c: Column) -> Column:
    """Redact API keys / bearer tokens, database URLs and values that follow
    ``token``, ``secret`` or ``password``."""
    out = F.regexp_replace(c, API_KEY_RE, "$1" + REDACTED)
    out = F.regexp_replace(out, DATABASE_URL_RE, DATABASE_URL_REDACTED)
    return F.regexp_replace(out, SECRET_WORD_RE, "$1" + REDACTED)


def strip_scripts(c: Column) -> Column:
    """Remove ``<script ...>...</script>`` blocks, any case, across lines."""
    return F.regexp_replace(c, SCRIPT_BLOCK_RE, "")


def sanitize_markdown(c: Column) -> Column:
    """Remove script blocks and ``on<word>=`` handler prefixes."""
    return F.regexp_replace(strip_scripts(c), EVENT_HANDLER_RE, "")


def token_estimate(c: Column) -> Column:
    """One token per four characters, rounded down."""
    return F.floor(F.length(c) / 4).cast("bigint")


def token_budget(c: Column, max_tokens: int = 2000) -> Column:
    """Cut text to ``4 * max_tokens`` characters; if the last newline of the
    cut lies past 80 % of it, cut there instead. Text within budget is kept."""
    max_chars = 4 * int(max_tokens)
    cut = F.substring(c, 1, max_chars)
    # 0-based position of the last '\n' in the cut, -1 when there is none
    last_nl = F.length(cut) - F.instr(F.reverse(cut), "\n")
    has_nl = F.instr(cut, "\n") > 0
    threshold = int(max_chars * 0.8)
    shorter = F.when(has_nl & (last_nl > F.lit(threshold)),
                     F.substring(cut, F.lit(1), last_nl)).otherwise(cut)
    return F.when(c.isNull(), c).when(token_estimate(c) <= max_tokens, c).otherwise(shorter)


def split_lines(c: Column) -> Column:
    """Array of lines, splitting on every line break Python recognises."""
    return F.split(c, LINE_BREAK_RE)


# Characters Python's str.strip() removes (str.isspace() is true for them).
PY_WHITESPACE = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())


def py_strip(c: Column) -> Column:
    """Strip leading and trailing whitespace exactly like ``str.strip()``
    (a character-set trim; no regex backtracking on long lines)."""
    return F.trim(c, F.lit(PY_WHITESPACE))
