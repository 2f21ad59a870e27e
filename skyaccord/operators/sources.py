"""Filtering and ranking source lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyaccord.functions.flux import ellipse_area
from skyaccord.functions.sky import ang_sep_arcsec


def good_sources(df: DataFrame, snr: float = 10.0, flux: float = 1e-6, peak: str = "peak_flux", rms: str = "isl_rms", at_source: str | None = None) -> DataFrame:
    """df with `good`: peak over noise above snr, and the map value at the source (or its noise) above flux."""
    value = F.coalesce(F.col(at_source), F.col(rms)) if at_source else F.col(rms)
    return df.withColumn("good", F.coalesce((F.try_divide(F.col(peak), F.col(rms)) > snr) & (value > flux), F.lit(False)))


def replace_bad_errors(df: DataFrame, error: str = "e_total_flux", fallback: str = "e_fit") -> DataFrame:
    """A negative or missing flux error takes the fit formula's value."""
    return df.withColumn(error, F.when((F.col(error) >= 0) & ~F.isnan(error), F.col(error)).otherwise(F.col(fallback)))


def normalise_sentinels(df: DataFrame, columns: list[str]) -> DataFrame:
    """-3600, which a missing error becomes by conversion to arcsec, means -1."""
    return df.withColumns({c: F.when(F.col(c) == -3600, F.lit(-1.0)).otherwise(F.col(c)) for c in columns})


def to_millijansky(df: DataFrame, columns: list[str], correction: float = 1.0) -> DataFrame:
    """Fluxes and their errors from Jy to mJy, times a flux correction."""
    return df.withColumns({c: F.col(c) * (1000 * correction) for c in columns})


def secondary_sources(df: DataFrame, frac: float = 0.01, catalog: str = "catalog", peak: str = "peak_flux") -> DataFrame:
    """Sources over frac of their catalogue's peak: separation from the peak source (arcmin), percent of it, ellipse area.

    The brightest source of each catalogue is found by an aggregate of one row each, not by sorting catalogues.
    """
    tops = df.groupBy(catalog).agg(F.max_by(F.struct("ra", "dec", peak), F.struct(F.col(peak), -F.col("source_id"))).alias("__top")).withColumnRenamed(catalog, "__c")
    both = df.join(tops, F.col(catalog).eqNullSafe(F.col("__c"))).filter(F.col(peak) > frac * F.col("__top")[peak])
    sep = ang_sep_arcsec(F.col("__top.ra"), F.col("__top.dec"), F.col("ra"), F.col("dec")) / 60
    out = both.withColumns({"sep_arcmin": sep, "percent": 100 * F.col(peak) / F.col("__top")[peak]})
    if "maj" in df.columns and "min" in df.columns:
        out = out.withColumn("area", ellipse_area(F.col("maj"), F.col("min")))
    return out.drop("__top", "__c")


def brightest(df: DataFrame, n: int = 2, catalog: str = "catalog", peak: str = "peak_flux", id_col: str = "source_id") -> DataFrame:
    """The n brightest sources of each catalogue with their rank; RA at or below 0 is wrapped by a turn."""
    w = Window.partitionBy(catalog).orderBy(F.desc_nulls_last(peak), id_col)
    ranked = df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    return ranked.withColumn("ra", F.when(F.col("ra") <= 0, F.col("ra") + 360).otherwise(F.col("ra")))


def ratio_to_max(df: DataFrame, catalog: str = "catalog", peak: str = "peak_flux") -> DataFrame:
    """peak_ratio: peak over the largest of its catalogue, by a summed aggregate joined back."""
    top = df.groupBy(F.col(catalog).alias("__c")).agg(F.max(peak).alias("__m"))
    return df.join(top, F.col(catalog).eqNullSafe(F.col("__c"))).withColumn("peak_ratio", F.try_divide(F.col(peak), F.col("__m"))).drop("__c", "__m")


def known_calibrators(fields: DataFrame, calibrators: DataFrame) -> DataFrame:
    """(name, calibrator): field names among calibrator names or aliases (name, alias, ord); of several the last listed counts."""
    listed = calibrators.select(F.col("name").alias("calibrator"), "ord", F.explode(F.array("name", "alias")).alias("__n")).filter("__n IS NOT NULL")
    return fields.join(listed, F.lower("name") == F.lower("__n")).groupBy("name").agg(F.max_by("calibrator", "ord").alias("calibrator"))


def last_wins(df: DataFrame, key: str = "path", value: str = "freq_hz", order: str = "ord") -> DataFrame:
    """(key, value, ord): the last value of each key at the place where the key first stood."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(value), F.min(order).alias(order))


def zip_full(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Both tables side by side on a key, columns suffixed 1 and 2, null where one side has none."""
    left = a.select(key, *[F.col(c).alias(f"{c}_1") for c in a.columns if c != key])
    right = b.select(key, *[F.col(c).alias(f"{c}_2") for c in b.columns if c != key])
    return left.join(right, key, "full_outer")


def region_lines(df: DataFrame) -> DataFrame:
    """(good, value): an ellipse of the region format for each source, green if good and red if not."""
    colour = F.when(F.col("good"), "green").otherwise("red")
    line = F.format_string('fk5;ellipse(%.7f,%.7f,%.3f",%.3f",%.2f) # color=%s', "ra", "dec", "maj", "min", "pa", colour)
    return df.select("good", line.alias("value"))


def source_list(df: DataFrame) -> DataFrame:
    """(n, ra, dec, total_flux, peak_flux) of good sources by RA, with fixed decimals; numbered over the whole list.

    The numbers come from per-RA-zone counts, so that no task sees all sources.
    """
    good = df.filter("good").withColumn("__zone", F.floor(F.col("ra") * 10).cast("long"))
    before = Window.orderBy("__zone").rowsBetween(Window.unboundedPreceding, -1)  # at most 3600 zones
    zones = good.groupBy("__zone").agg(F.count("*").alias("__n")).withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = Window.partitionBy("__zone").orderBy("ra", "source_id")
    n = F.row_number().over(inside)
    ranked = good.withColumn("__r", n).join(F.broadcast(zones), "__zone")
    return ranked.select((F.col("__r") + F.col("__base")).alias("n"), F.round("ra", 6).alias("ra"), F.round("dec", 6).alias("dec"), F.round("total_flux", 6).alias("total_flux"), F.round("peak_flux", 6).alias("peak_flux"))

