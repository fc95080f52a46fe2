"""Text-column jobs (T1-T6) over whole text tables.

All are JVM expressions applied row by row (no shuffle). Section bullets split
each text into lines with array functions and ``posexplode``, so a text is
handled inside one row whatever its size and no window or grouping is needed.
HTML is cut into tokens by one pattern; a fold over them keeps allowed tags and
the stack of open ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import qcol
from ..functions.text import (py_strip, redact_secrets, sanitize_markdown, split_lines,
                              strip_scripts, token_budget, token_estimate)

# ---------------------------------------------------------------------------
# HTML allow-list. Tags kept (others are removed, their text
# kept); attributes kept on any tag; script blocks are removed with content.
# ---------------------------------------------------------------------------
ALLOWED_TAGS = frozenset({
    "p", "br", "strong", "em", "u", "h1", "h2", "h3", "h4", "h5", "h6",
    "ul", "ol", "li", "blockquote", "code", "pre", "table", "tr", "td", "th",
    "div", "span",
})
ALLOWED_ATTRS = ("class", "id")
VOID_TAGS = frozenset({"br"})

# Fixed value: bullet markers of a section line, and what is stripped from it.
BULLET_RE = r"^([-*]|[0-9]+\.)"
BULLET_PREFIX_RE = r"^[ \-*0-9.]+"
DEFAULT_HEADER = "(?i)recommendation"


def with_column(df: DataFrame, column: str, expr, out: str | None = None) -> DataFrame:
    """Replace (or add as ``out``) one column, keeping the others."""
    name = out or column
    return df.withColumn(name, expr)


def redact_column(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    return with_column(df, column, redact_secrets(qcol(column)), out)


def sanitize_markdown_column(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    return with_column(df, column, sanitize_markdown(qcol(column)), out)


def strip_scripts_column(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    return with_column(df, column, strip_scripts(qcol(column)), out)


def token_estimate_column(df: DataFrame, column: str, out: str = "tokens") -> DataFrame:
    return df.withColumn(out, token_estimate(qcol(column)))


def token_budget_column(df: DataFrame, column: str, max_tokens: int = 2000,
                        out: str | None = None) -> DataFrame:
    return with_column(df, column, token_budget(qcol(column), max_tokens), out)


def section_bullets(df: DataFrame, column: str, keys: list[str] | None = None,
                    header: str = DEFAULT_HEADER) -> DataFrame:
    """Bullet lines after a section header, one output row per bullet.

    For each text: lines are stripped, empty lines ignored; the first line
    matching ``header`` opens the section; afterwards every line starting
    with ``-``, ``*`` or ``<digits>.`` is kept without its leading marker
    characters. Lines matching ``header`` are never kept. Output:
    ``(*keys, line_no, bullet)`` with ``line_no`` 0-based in the text.
    """
    keys = list(keys or [])
    kc = [qcol(k) for k in keys]
    # materialise the line array once per text, then its header position,
    # then explode (so no expression is re-evaluated per generated line)
    staged = df.select(*kc, F.transform(split_lines(qcol(column)), lambda x: py_strip(x))
                       .alias("_lines"))
    first = F.array_position(F.transform("_lines", lambda x: x.rlike(header)), True)
    staged = staged.select(*kc, "_lines", first.alias("_hdr")).where(F.col("_hdr") > 0)
    base = staged.select(*kc, "_hdr", F.posexplode("_lines").alias("line_no", "_line"))
    keep = ((F.col("_hdr") > 0) & (F.col("line_no") + 1 > F.col("_hdr"))
            & (F.col("_line") != "") & ~F.col("_line").rlike(header)
            & F.col("_line").rlike(BULLET_RE))
    return base.where(keep).select(
        *keys, F.col("line_no").cast("int").alias("line_no"),
        F.regexp_replace("_line", BULLET_PREFIX_RE, "").alias("bullet"))


# one token of HTML: a comment, a declaration, a tag (quotes may hold any character), a stray
# bracket, or text. Possessive, so that a long tag needs no stack.
HTML_TOKEN_RE = (r"(?s)<!--.*?-->|<[!?][^>]*>|"
                 r"</?[A-Za-z](?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+>|<|[^<]+")
PIECE = 512  # tokens that are joined together
ATTRIBUTE_RE = r"""[^\s"'<>/=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'=<>`]+))?"""
BARE_AMP_RE = r"&(?!(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);)"


def _escaped(c):
    """Text with brackets and every ``&`` escaped that begins no complete reference."""
    c = F.regexp_replace(c, BARE_AMP_RE, "&amp;")
    return F.replace(F.replace(c, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _kept_attributes(tag):
    inside = F.regexp_replace(tag, r"^</?[A-Za-z][A-Za-z0-9]*|/?>$", "")
    name = lambda a: F.lower(F.regexp_extract(a, r"^[^\s=]+", 0))
    value = lambda a: F.regexp_replace(
        F.regexp_replace(a, r"(?s)^[^\s=]+\s*=?\s*", ""), r"""(?s)^(["'])(.*)\1$""", "$2")
    kept = F.filter(F.regexp_extract_all(inside, F.lit(ATTRIBUTE_RE), F.lit(0)),
                    lambda a: name(a).isin(*ALLOWED_ATTRS))
    return F.array_join(F.transform(kept, lambda a: F.concat(
        F.lit(" "), name(a), F.lit('="'), F.replace(_escaped(value(a)), F.lit('"'), F.lit("&quot;")), F.lit('"'))), "")


def _closings(stack):
    """End tags for a stack of names written ``/em/p``, the innermost first."""
    return F.regexp_replace(stack, r"/([a-z0-9]+)", "</$1>")


def allow_html(c):
    """Only allowed tags, with allowed attributes; the text of others stays, comments go.

    Every start tag gets its end tag: one without a start is dropped, one that closes an
    outer tag closes those inside it first, and what is open at the end is closed.
    No further repair of nesting is made (a ``p`` in a ``p``, rows outside tables). Time grows with
    the tags, and with how deep they are nested.
    """
    parts = F.transform(F.regexp_extract_all(c, F.lit(HTML_TOKEN_RE), F.lit(0)), lambda t: F.struct(
        t.alias("token"), F.lower(F.regexp_extract(t, r"^</?([A-Za-z][A-Za-z0-9]*)", 1)).alias("name")))
    parts = F.transform(parts, lambda p: F.struct(
        p["name"].alias("name"),
        F.when(p["name"] == "", F.lit("text")).when(~p["name"].isin(*sorted(ALLOWED_TAGS)), F.lit("none"))
        .when(p["token"].startswith("</"), F.lit("end"))
        .when(p["name"].isin(*VOID_TAGS) | p["token"].endswith("/>"), F.lit("text")).otherwise(F.lit("start")).alias("kind"),
        F.when(p["name"] == "", F.when(p["token"].rlike("^<[!?]"), F.lit("")).otherwise(_escaped(p["token"])))
        .otherwise(F.concat(F.lit("<"), p["name"], _kept_attributes(p["token"]), F.lit(">"), F.when(
            p["token"].endswith("/>") & ~p["name"].isin(*VOID_TAGS), F.concat(F.lit("</"), p["name"], F.lit(">")))
            .otherwise(F.lit("")))).alias("html")))

    def step(state, p):
        out, stack = state["out"], state["stack"]
        at = F.instr(F.concat(stack, F.lit("/")), F.concat(F.lit("/"), p["name"], F.lit("/")))
        ends = F.concat(_closings(F.substr(stack, F.lit(1), at - 1)), F.lit("</"), p["name"], F.lit(">"))
        after = F.substr(stack, at + F.length(p["name"]) + 1)
        closes = (p["kind"] == "end") & (at > 0) & ~p["name"].isin(*VOID_TAGS)
        return F.struct(
            F.when(p["kind"].isin("text", "start"), F.concat(out, p["html"]))
            .when(closes, F.concat(out, ends)).otherwise(out).alias("out"),
            F.when(p["kind"] == "start", F.concat(F.lit("/"), p["name"], stack))
            .when(closes, after).otherwise(stack).alias("stack"))

    def piece(state, tokens):
        """A run of tokens: its text is joined by itself, so that no text is copied once a tag."""
        start = F.struct(F.lit("").alias("out"), state["stack"].alias("stack"))
        folded = F.aggregate(tokens, start, step)
        return _once(folded, lambda f: F.struct(
            F.concat(state["outs"], F.array(f["out"])).alias("outs"), f["stack"].alias("stack")))

    def whole(tokens):
        runs = F.transform(F.sequence(F.lit(0), F.floor(F.size(tokens) / PIECE).cast("int")),
                           lambda i: F.slice(tokens, i * PIECE + 1, F.lit(PIECE)))
        empty = F.struct(F.array().cast("array<string>").alias("outs"), F.lit("").alias("stack"))
        return F.aggregate(runs, empty, piece, lambda s: F.concat(F.array_join(s["outs"], ""), _closings(s["stack"])))

    return _once(parts, whole)


def _once(value, use):
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def sanitize_html(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """Remove script blocks, then allow-list tags and attributes; NULL stays NULL.

    All JVM expressions on one row; other columns pass through unchanged.
    """
    return with_column(df, column, allow_html(strip_scripts(qcol(column))), out)
