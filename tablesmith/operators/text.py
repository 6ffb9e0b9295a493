"""Text cleaning over DataFrame columns.  All row-wise, so all stream-safe."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tf
from ..functions.types import ROW_ID, qcol, settles, text_columns

STRING_OPS = {
    "trim": tf.strip_whitespace,
    "lower": F.lower,
    "upper": F.upper,
    "title": tf.title_case,
}


def _text_targets(df: DataFrame, cols) -> list[str]:
    return text_columns(df, cols) if cols else text_columns(df)


@settles
def string_op(df: DataFrame, op: str, cols=None) -> DataFrame:
    """trim / lower / upper / title over text columns (default: all). Unknown op raises (D5)."""
    if op not in STRING_OPS:
        raise ValueError(f"unknown string operation {op!r}")
    fn = STRING_OPS[op]
    targets = _text_targets(df, cols)
    return df.withColumns({c: fn(qcol(c)) for c in targets}) if targets else df


@settles
def trim(df, cols=None):
    return string_op(df, "trim", cols)


@settles
def lower(df, cols=None):
    return string_op(df, "lower", cols)


@settles
def upper(df, cols=None):
    return string_op(df, "upper", cols)


@settles
def title_case(df, cols=None):
    return string_op(df, "title", cols)


@settles
def find_replace(df: DataFrame, find: str, replace: str = "", cols=None,
                 match_case: bool = False, use_regex: bool = False) -> DataFrame:
    """Literal (default, case-insensitive) or Python-style regex replace.
    NULL stays NULL (D11); a literal replacement is taken literally (D12)."""
    if not find:
        raise ValueError(f"find_replace: find={find!r} matches nothing")
    fn = tf.replace_regex if use_regex else tf.replace_literal
    targets = _text_targets(df, cols)
    return df.withColumns({c: fn(qcol(c), find, replace, match_case) for c in targets}) if targets else df


@settles
def validate_emails(df: DataFrame, cols, action: str = "clear") -> DataFrame:
    """``clear``: invalid non-missing cells -> NULL; ``remove_row``: drop rows
    with any invalid target.  ``cols`` is required (D6)."""
    if not cols:
        raise ValueError("validate_emails needs explicit columns")
    cols = [cols] if isinstance(cols, str) else list(cols)
    if action == "clear":
        return df.withColumns({c: F.when(tf.email_valid(qcol(c)), qcol(c)) for c in cols})
    if action in ("remove_row", "drop"):
        ok = [qcol(c).isNull() | tf.email_valid(qcol(c)) for c in cols]
        return df.where(functools.reduce(operator.and_, ok))
    raise ValueError(f"unknown email action {action!r}")


@settles
def count_invalid_emails(df: DataFrame, cols) -> DataFrame:
    """One row: invalid non-missing cells over ``cols``."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    total = functools.reduce(operator.add, [
        F.count_if(qcol(c).isNotNull() & ~tf.email_valid(qcol(c))) for c in cols])
    return df.agg(total.cast("bigint").alias("invalid_cells"))


@settles
def format_phones(df: DataFrame, cols) -> DataFrame:
    cols = [cols] if isinstance(cols, str) else list(cols)
    return df.withColumns({c: tf.format_phone(qcol(c)) for c in cols})


@settles
def strip_markdown(df: DataFrame, cols) -> DataFrame:
    cols = [cols] if isinstance(cols, str) else list(cols)
    return df.withColumns({c: tf.strip_markdown(qcol(c)) for c in cols})


@settles
def split_segments(df: DataFrame, col: str, keys=None) -> DataFrame:
    """One row per clean segment: ``keys..., segment_no, segment``."""
    keys = [keys] if isinstance(keys, str) else list(keys or ([ROW_ID] if ROW_ID in df.columns else []))
    return df.select(*[qcol(k) for k in keys],
                             F.posexplode(tf.split_segments(qcol(col))).alias("segment_no", "segment"))
