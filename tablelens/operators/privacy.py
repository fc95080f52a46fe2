"""Sensitive-column detection and masking (M1-M7).

Detection by name looks only at the schema (driver-side metadata). Content
detection is an aggregate over the data; ``mask_table`` folds it into the
same lazy plan (a one-row share per column joined by broadcast), so masking
a table runs no action of its own and masks every row on the executors.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import qcol
from ..functions.masks import mask_email, mask_financial, mask_id

# ---------------------------------------------------------------------------
# Column-name patterns per sensitive type, tried in this order
# (email, id, financial, phone); the first match wins. Case-insensitive, on
# word boundaries where "_" counts as a word character.
#   email:     email, e_mail, mail, e-mail / e_mail
#   id:        cnic, nic, national_id, ssn, passport, id_no, id_number, nid, tax_id
#   financial: salary, income, wage, payment, balance, account_no, credit,
#              debit, bank_acc, revenue, earnings
#   phone:     phone, mobile, cell, contact_no, tel, telephone
# ---------------------------------------------------------------------------
NAME_PATTERNS: dict[str, str] = {
    "email": r"\b(email|e_mail|mail|e[-_]mail)\b",
    "id": r"\b(cnic|nic|national_id|ssn|passport|id_no|id_number|nid|tax_id)\b",
    "financial": r"\b(salary|income|wage|payment|balance|account_no|credit|debit|bank_acc|"
                 r"revenue|earnings)\b",
    "phone": r"\b(phone|mobile|cell|contact_no|tel|telephone)\b",
}
# Fixed value: what an e-mail value looks like (whole value).
EMAIL_VALUE_RE = r"^[\w.+\-]+@[\w\-]+\.[\w.]+$"
EMAIL_SHARE = 0.5
MASK_META = "tablelens.masked"

_COMPILED = {k: re.compile(v, re.IGNORECASE) for k, v in NAME_PATTERNS.items()}


def sensitive_type_by_name(name: str, split_underscore: bool = False) -> str | None:
    """Sensitive type from a column name, or None.

    With ``split_underscore`` the name is also tried with ``_`` read as a
    separator, so ``customer_email`` is found as well.
    """
    names = [name]
    if split_underscore:
        names.append(name.replace("_", " "))
    for typ, pat in _COMPILED.items():
        if any(pat.search(n) for n in names):
            return typ
    return None


def detect_sensitive(df: DataFrame, split_underscore: bool = False) -> DataFrame:
    """``(column_name, sensitive_type, values_to_mask)`` for columns whose
    *name* marks them; ``values_to_mask`` counts their non-null values (one
    aggregation over the table)."""
    hits = [(c, t) for c in df.columns
            if (t := sensitive_type_by_name(c, split_underscore)) is not None]
    if not hits:
        return df.sparkSession.createDataFrame(
            [], "column_name string, sensitive_type string, values_to_mask bigint")
    agg = df.agg(*[F.count(qcol(c)).alias(f"_n{i}") for i, (c, _) in enumerate(hits)])
    return agg.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("sensitive_type"),
                 F.col(f"_n{i}").cast("bigint").alias("values_to_mask"))
        for i, (c, t) in enumerate(hits)])))


def email_share_exprs(df: DataFrame, columns: list[str]):
    """Share of non-null values that look like e-mail addresses, per column."""
    pat = "(?U)" + EMAIL_VALUE_RE
    return [F.avg(F.when(qcol(c).isNotNull(), qcol(c).rlike(pat).cast("double")))
            .alias(f"_e{i}") for i, c in enumerate(columns)]


def detect_email_content(df: DataFrame) -> DataFrame:
    """``(column_name, email_share, is_email)`` for every text column: more
    than half of its non-null values are e-mail addresses. Whole column
    (not a sample), one aggregation for all columns."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not cols:
        return df.sparkSession.createDataFrame(
            [], "column_name string, email_share double, is_email boolean")
    agg = df.agg(*email_share_exprs(df, cols))
    return agg.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"_e{i}").alias("email_share"),
                 F.coalesce(F.col(f"_e{i}") > EMAIL_SHARE, F.lit(False)).alias("is_email"))
        for i, c in enumerate(cols)])))


def _masked(df: DataFrame, name: str) -> bool:
    return MASK_META in (df.schema[name].metadata or {})


def mask_column(df: DataFrame, name: str, typ: str):
    """Masking expression for one column by sensitive type (NULL kept)."""
    c = qcol(name)
    if typ == "email":
        return mask_email(c)
    if typ in ("id", "phone"):
        return mask_id(c)
    if typ == "financial":
        return mask_financial(c, df.schema[name].dataType)
    return c


def sensitive_types(df: DataFrame, split_underscore: bool = False,
                    detect_content: bool = True) -> dict[str, str]:
    """Sensitive type of each column to mask: by name, else (text) by content.

    Content is decided by one aggregation over the whole columns, whose single
    row comes to the driver. Columns that carry the mask mark are left out.
    """
    fields = [f for f in df.schema.fields if not _masked(df, f.name)]
    types = {f.name: t for f in fields if (t := sensitive_type_by_name(f.name, split_underscore)) is not None}
    open_ = [f.name for f in fields if f.name not in types and isinstance(f.dataType, T.StringType)]
    if detect_content and open_:
        shares = df.agg(*email_share_exprs(df, open_)).first()
        types |= {c: "email" for c, share in zip(open_, shares, strict=True) if (share or 0) > EMAIL_SHARE}
    return types


def mask_columns(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """A plain projection that masks the named columns by type and marks them."""
    return df.select(*[
        mask_column(df, c, types[c]).alias(c, metadata={MASK_META: types[c]}) if c in types else qcol(c)
        for c in df.columns])


def mask_table(df: DataFrame, split_underscore: bool = False,
               detect_content: bool = True) -> DataFrame:
    """Mask every sensitive column; other columns are left untouched.

    Types come from names first, then (text columns only) from content. A
    masked column carries a metadata mark and is never masked twice, so the
    operator is idempotent even for the financial mask.
    """
    by_name = {c: sensitive_type_by_name(c, split_underscore) for c in df.columns}
    todo = [c for c in df.columns if not _masked(df, c)]
    text_cands = [f.name for f in df.schema.fields
                  if f.name in todo and by_name[f.name] is None
                  and isinstance(f.dataType, T.StringType)]
    base = df
    if detect_content and text_cands:
        shares = df.agg(*email_share_exprs(df, text_cands))
        base = df.crossJoin(F.broadcast(shares))  # one row by construction
    out = []
    for f in df.schema.fields:
        name = f.name
        typ = by_name[name]
        if name not in todo:
            out.append(qcol(name))
        elif typ is not None:
            out.append(mask_column(df, name, typ).alias(name, metadata={MASK_META: typ}))
        elif detect_content and name in text_cands:
            i = text_cands.index(name)
            hit = F.coalesce(F.col(f"_e{i}") > EMAIL_SHARE, F.lit(False))
            out.append(F.when(hit, mask_email(qcol(name))).otherwise(qcol(name))
                       .alias(name, metadata={MASK_META: "email?"}))
        else:
            out.append(qcol(name))
    return base.select(*out)
