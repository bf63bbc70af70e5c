"""Text column expressions shared by the operators.

Regular expressions here are written so that Java (Spark) and RE2 (DuckDB) agree:
no look-around, no back-references, ``\\p{L}\\p{N}`` instead of ``\\w``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_PATTERN = r"[\p{L}\p{N}]+"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use) -> Column:
    """``use(value)`` with the value taken once a row, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def norm_key(c) -> Column:
    """Lower, punctuation to space, collapse blanks, trim."""
    x = F.regexp_replace(F.lower(col(c)), r"[^\p{L}\p{N}_\s]", " ")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def doc_key(type_col, name_col, content_col) -> Column:
    """``type::name`` when both are non-empty, else ``content::`` + 16 hex of sha256."""
    t, n, c = col(type_col), col(name_col), col(content_col)
    both = (F.coalesce(t, F.lit("")) != "") & (F.coalesce(n, F.lit("")) != "")
    return F.when(both, F.concat_ws("::", t, n)).otherwise(
        F.concat(F.lit("content::"), F.substring(F.sha2(F.coalesce(c, F.lit("")), 256), 1, 16)))


def token_estimate(content) -> Column:
    """G1: max(1, len // 4)."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(col(content), F.lit(""))) / 4).cast("int"))


def html_unescape_basic(c) -> Column:
    """The five named entities and the numeric apostrophe/quote forms, ``&amp;`` last."""
    x = col(c)
    for a, b in (("&quot;", '"'), ("&#039;", "'"), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x
