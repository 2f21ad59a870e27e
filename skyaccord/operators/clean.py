"""Rows and columns as every other operator expects them: null for missing, checked coordinates, known names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in float columns becomes null, which aggregates skip."""
    floats = [c for c, kind in df.dtypes if kind in ("double", "float")]
    return df.withColumns({c: F.nanvl(F.col(f"`{c}`"), F.lit(None).cast("double")) for c in floats})


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def valid_coords(df: DataFrame, ra: str = "ra", dec: str = "dec") -> DataFrame:
    """Rows with finite coordinates."""
    return df.filter(finite(F.col(f"`{ra}`")) & finite(F.col(f"`{dec}`")))


def count_skipped(df: DataFrame, ra: str = "ra", dec: str = "dec") -> DataFrame:
    """(n_valid, n_skipped)."""
    good = finite(F.col(f"`{ra}`")) & finite(F.col(f"`{dec}`"))
    return df.agg(F.count_if(good).alias("n_valid"), F.count_if(~good).alias("n_skipped"))


def col_or_null(df: DataFrame, name: str, kind: str = "double") -> Column:
    """A column, or null of its type where the table has none of that name."""
    return F.col(f"`{name}`").cast(kind) if name in df.columns else F.lit(None).cast(kind)


def suffix_columns(df: DataFrame, suffix: int | str) -> DataFrame:
    return df.select([F.col(f"`{c}`").alias(f"{c}_{suffix}") for c in df.columns])


def finite_positive(df: DataFrame, *names: str) -> DataFrame:
    for n in names:
        df = df.filter(finite(F.col(f"`{n}`")) & (F.col(f"`{n}`") > 0))
    return df


def first_present(df: DataFrame, names: tuple[str, ...] = ("corrected_data", "data", "model_data")) -> str:
    """The preferred data column that the table has."""
    for n in names:
        if n in df.columns:
            return n
    raise ValueError(f"none of {', '.join(names)} in the table")


def by_affix(df: DataFrame, column: str, prefix: str = "", suffix: str = "") -> DataFrame:
    return df.filter(F.col(column).startswith(prefix) & F.col(column).endswith(suffix))
