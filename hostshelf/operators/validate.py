"""Constraint check before a write (SNK-14): NOT NULL everywhere, bounded text."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import MAX_TEXT, SESSION_KEYS, Kind, kind_of


def _columns(kind: str | Kind) -> list[str]:
    return SESSION_KEYS.names if kind == "session_keys" else kind_of(kind).columns


def violation(kind: str | Kind, columns: list[str] | None = None) -> Column:
    """True for a row that breaks a constraint of the table (of the given `columns` of it)."""
    cols = columns or _columns(kind)
    checks = [F.col(c).isNull() for c in cols]
    checks += [F.length(F.col(c)) > F.lit(n) for c, n in MAX_TEXT.items() if c in cols]
    return functools.reduce(operator.or_, checks)


def _checked(df: DataFrame, kind: str | Kind, drawn: tuple[str, ...]) -> Column:
    """The table's check; columns but the ones the store draws must be there."""
    cols = _columns(kind)
    missing = [c for c in cols if c not in df.columns and c not in drawn]
    if missing:
        raise ValueError(f"columns missing for {kind_name(kind)}: {', '.join(missing)}")
    return violation(kind, [c for c in cols if c in df.columns])


def kind_name(kind: str | Kind) -> str:
    return kind if isinstance(kind, str) else kind.name


#: What the store supplies, so rows may still lack it when they are split.
DRAWN = ("id", "group_id", "insertion_datetime")


def split_valid(df: DataFrame, kind: str | Kind) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) by one predicate; both keep the input columns. All figure columns must be there."""
    bad = rejects(df, kind)
    return df.where(~bad), df.where(bad)


def rejects(df: DataFrame, kind: str | Kind) -> Column:
    """True for the rows of `df` that the table does not take, never null."""
    return F.coalesce(_checked(df, kind, DRAWN), F.lit(False))


def require_valid(df: DataFrame, kind: str | Kind) -> DataFrame:
    """Strict mode: the write fails on the first bad row (checked on executors)."""
    bad = _checked(df, kind, ())
    # A filter, not a dropped column: a pruned column would never be evaluated.
    return df.where(F.when(bad, F.raise_error(F.lit(f"constraint violated in {kind_name(kind)} row")))
                    .otherwise(F.lit(True)))
