"""Visibility quality: amplitudes, noise and flagging by scan, antenna, baseline and channel."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyaccord.lineage import once
from skyaccord.operators.clean import first_present
from skyaccord.operators.stats import attach, exact_quantiles, quantile_table

PARALLEL, CROSSED = ("XX", "YY", "LL", "RR"), ("XY", "YX", "LR", "RL")
#: Correlation codes and their labels (fixed values).
CORRELATIONS = {5: "RR", 6: "RL", 7: "LR", 8: "LL", 9: "XX", 10: "XY", 11: "YX", 12: "YY"}


def baseline_class(ant1: Column, ant2: Column) -> Column:
    return F.when(ant1 == ant2, "auto").otherwise("cross")


def pol_class(pol: Column) -> Column:
    return F.when(pol.isin(*PARALLEL), "parallel").when(pol.isin(*CROSSED), "crossed")


def pol_label(code: Column) -> Column:
    """The label of a correlation code; an unknown code as text."""
    table = F.create_map(*[F.lit(v) for pair in CORRELATIONS.items() for v in pair])
    return F.coalesce(F.try_element_at(table, code.cast("int")), code.cast("string"))


def select_field(main: DataFrame, field: DataFrame, wanted: str | None) -> DataFrame:
    """Rows of a field: by exact name, else by its number, else (None) all; a name or number that no field has is an error. The field table has a row for each field."""
    if wanted is None:
        return main
    named = field.filter(F.col("name") == wanted).select("field_id")
    if not named.limit(1).count():
        if not wanted.lstrip("-").isdigit():
            raise ValueError(f"there is no field {wanted}")
        named = field.filter(F.col("field_id") == int(wanted)).select("field_id")
        if not named.limit(1).count():
            raise ValueError(f"field {wanted} is out of range")
    return main.join(named.distinct(), "field_id", "left_semi")


def channel_slice(values: Column, low: Column, high: Column) -> Column:
    """Channels [low, high), clamped; a range turned round means all."""
    n = F.size(values)
    lo, hi = F.greatest(F.lit(0), F.least(low, n)), F.greatest(F.lit(0), F.least(high, n))
    return F.when(hi > lo, F.slice(values, lo + 1, hi - lo)).otherwise(values)


def attach_spw(main: DataFrame, data_description: DataFrame) -> DataFrame:
    return main.join(data_description.select("data_desc_id", "spw"), "data_desc_id", "left")


def attach_pol(main: DataFrame, polarization: DataFrame) -> DataFrame:
    return main.join(polarization.select("pol_idx", pol_label(F.col("corr_type")).alias("pol")), "pol_idx", "left")


def load_visibilities(main: DataFrame, data_description: DataFrame, polarization: DataFrame) -> DataFrame:
    """Main rows with amplitudes of the preferred data column (arrays of struct(re, im)), window and polarisation."""
    data = first_present(main)
    amp = F.transform(F.col(data), lambda c: F.hypot(c["re"], c["im"]))
    return attach_pol(attach_spw(main.withColumn("amp", amp), data_description), polarization)


def smoothing_window(n: int, window: int = 51, order: int = 3) -> int | None:
    """The largest odd window of at most `window` channels (an even one counts as the next odd) among n; None where a polynomial of this order does not fit in."""
    least = max(5, order + 2)
    if window < least or n < least:
        return None
    widest = min(window | 1, n if n % 2 else n - 1)
    return next((w for w in (widest, least | 1) if least <= w <= n), None)


def smoothing_weights(window: int, order: int) -> np.ndarray:
    """Row i: the weights of a window's channels in the value at place i of the polynomial fitted to them."""
    t = np.arange(window) - window // 2
    design = np.vander(t, min(order, window - 2) + 1, increasing=True).astype(float)
    return design @ np.linalg.pinv(design)


def smooth(block: np.ndarray, window: int, order: int) -> np.ndarray:
    """Local polynomial trends of spectra (a row each): centred windows inside, the first and last window's polynomial at the edges.

    Work and memory are linear in the channels.
    """
    weights, n, half = smoothing_weights(window, order), block.shape[1], window // 2
    trend = np.zeros_like(block)
    inside = trend[:, half : n - half]
    for k in range(window):
        inside += weights[half, k] * block[:, k : k + n - window + 1]
    trend[:, :half] = block[:, :window] @ weights[:half].T
    trend[:, n - half :] = block[:, n - window :] @ weights[half + 1 :].T
    return trend


def residual_of(block: np.ndarray, window: int, order: int) -> np.ndarray:
    """Spectra less their trend; less the median of the present channels where one is missing (NaN) or they are too few for a window."""
    w, out = smoothing_window(block.shape[1], window, order), np.full_like(block, np.nan)
    missing = np.isnan(block)
    fit = ~missing.any(axis=1) if w else np.zeros(len(block), bool)
    if fit.any():
        out[fit] = block[fit] - smooth(block[fit], w, order)
    rest = ~fit & ~missing.all(axis=1)
    if rest.any():
        out[rest] = block[rest] - np.nanmedian(block[rest], axis=1, keepdims=True)
    return out


def _by_length(spectra: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) of the known spectra of each length; null channels are NaN."""
    length = pc.list_value_length(spectra).fill_null(-1).to_numpy(zero_copy_only=False)
    start = spectra.offsets.to_numpy()[:-1]
    values = spectra.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    for n in np.unique(length[length >= 0]):
        at = np.flatnonzero(length == n)
        yield at, values[start[at][:, None] + np.arange(n)]


def detrend(df: DataFrame, amp: str = "amp", window: int = 51, order: int = 3, out: str = "residual") -> DataFrame:
    """df with an array column: amplitudes less their smooth trend.

    Spectra with missing channels (null or NaN) and spectra too short for a window lose the median of their present
    channels instead; missing channels stay null. Null spectra have a null residual.
    """

    @F.arrow_udf("array<double>")
    def run(spectra: pa.Array) -> pa.Array:
        result: list = [None] * len(spectra)
        for at, block in _by_length(spectra):
            rest = residual_of(block, window, order) if block.shape[1] else block
            for i, r in zip(at, rest):
                result[i] = pa.array(r, from_pandas=True)
        return pa.array([r if r is None else r.tolist() for r in result], pa.list_(pa.float64()))

    return df.withColumn(out, run(F.col(f"`{amp}`").cast("array<double>")))


def row_amp_stats(df: DataFrame, amp: str = "amp", flag: str | None = "flag", window: int = 51, order: int = 3, exclude_flagged: bool = False) -> DataFrame:
    """df with mean, rms (of the detrended spectrum, about its mean) and, with flags, flag_frac for each row, in one pass over the arrays.

    Missing channels (null or NaN) are skipped. Flagged samples count like others unless exclude_flagged leaves
    them out of mean and rms; the trend is that of all channels. Without a present channel mean and rms are null.
    """

    @F.arrow_udf("struct<mean: double, rms: double>")
    def run(spectra: pa.Array, flags: pa.Array) -> pa.Array:
        mean, rms = np.full(len(spectra), np.nan), np.full(len(spectra), np.nan)
        for at, block in _by_length(spectra):
            rest = residual_of(block, window, order) if block.shape[1] else block
            keep = ~np.isnan(rest)
            if exclude_flagged and flag:
                keep &= ~np.stack([_fitted(flags[int(i)].as_py(), block.shape[1]) for i in at])
            n = keep.sum(axis=1)
            some = n > 0
            at, block, rest, keep, n = at[some], np.where(keep, block, 0)[some], np.where(keep, rest, 0)[some], keep[some], n[some]
            mean[at] = block.sum(axis=1) / n
            middle = rest.sum(axis=1) / n
            rms[at] = np.sqrt((np.where(keep, rest - middle[:, None], 0) ** 2).sum(axis=1) / n)
        return pa.StructArray.from_arrays([pa.array(mean, from_pandas=True), pa.array(rms, from_pandas=True)], ["mean", "rms"])

    flags = F.col(f"`{flag}`") if flag else F.lit(None)
    both = run(F.col(f"`{amp}`").cast("array<double>"), flags.cast("array<boolean>"))
    out = df.withColumn("__stats", both).withColumns({"mean": F.col("__stats.mean"), "rms": F.col("__stats.rms")}).drop("__stats")
    if flag:
        share = F.size(F.filter(flag, lambda f: f)) / F.size(flag)
        out = out.withColumn("flag_frac", F.when(F.size(flag) > 0, share))
    return out


def _fitted(flags: list[bool | None] | None, n: int) -> np.ndarray:
    """Flags of n channels; a missing flag is none."""
    got = np.zeros(n, bool)
    known = [bool(f) for f in (flags or [])[:n]]
    got[: len(known)] = known
    return got


def _medians(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, mean, rms, flag_frac): medians of the first two, the mean of the third where the rows have it, from the same passes."""
    more = [F.avg("flag_frac").alias("flag_frac")] if "flag_frac" in rows.columns else []
    return quantile_table(rows, {"mean": {"mean": 0.5}, "rms": {"rms": 0.5}}, keys, more).select(*keys, "mean", "rms", *(["flag_frac"] if more else []))


def by_scan(rows: DataFrame) -> DataFrame:
    return _medians(rows, ["scan", "pol"])


def by_antenna(rows: DataFrame) -> DataFrame:
    """Each baseline counts for both of its antennas (an autocorrelation twice)."""
    narrow = once(rows.select("ant1", "ant2", "pol", "mean", "rms", "flag_frac"))
    return _medians(narrow.select(F.explode(F.array("ant1", "ant2")).alias("ant"), "pol", "mean", "rms", "flag_frac"), ["ant", "pol"])


def by_baseline(rows: DataFrame) -> DataFrame:
    base = F.concat_ws("-", F.col("ant1").cast("string"), F.col("ant2").cast("string"))
    return _medians(rows.select(base.alias("base"), "pol", "mean", "rms"), ["base", "pol"])


def explode_flags(df: DataFrame, low: int = 0) -> DataFrame:
    """A row for each channel of flag arrays; channel numbers are absolute."""
    rest = [c for c in df.columns if c != "flag"]
    return df.select(*rest, F.posexplode("flag").alias("chan", "flag")).withColumn("chan", F.col("chan") + low)


def flags_by_channel(flags: DataFrame) -> DataFrame:
    """(class, spw, chan, pol, total, flagged, flag_frac) of rows (ant1, ant2, spw, chan, pol, flag)."""
    grouped = flags.groupBy(baseline_class(F.col("ant1"), F.col("ant2")).alias("class"), "spw", "chan", "pol")
    sums = grouped.agg(F.count("flag").alias("total"), F.count_if("flag").alias("flagged")).filter("total > 0")
    return sums.withColumn("flag_frac", F.col("flagged") / F.col("total"))


def flags_by_channel_avg(channels: DataFrame) -> DataFrame:
    """Unweighted mean over the windows."""
    return channels.groupBy("class", "chan", "pol").agg(F.avg("flag_frac").alias("flag_frac"))


def overall_flagging(rows: DataFrame) -> DataFrame:
    return rows.agg(F.avg("flag_frac").alias("flag_frac"), F.count("*").alias("n_rows"))


def compare_scan_medians(test: DataFrame, ref: DataFrame) -> DataFrame:
    """(scan, pol, mean_test, mean_ref, rms_test, rms_ref), also scans that only one side has."""

    def side(df: DataFrame, name: str) -> DataFrame:
        return _medians(df.select("scan", "pol", "mean", "rms"), ["scan", "pol"]).withColumnsRenamed({"mean": f"mean_{name}", "rms": f"rms_{name}"})

    return side(test, "test").join(side(ref, "ref"), ["scan", "pol"], "full_outer")


def scans_for_field(main: DataFrame, field: DataFrame, wanted: str | None) -> DataFrame:
    """(scan), each once, in order."""
    return select_field(main, field, wanted).select("scan").distinct().orderBy("scan")


def selection_count(main: DataFrame, scans: DataFrame) -> DataFrame:
    """(scan, n) for the requested scans, 0 where the selection has no row."""
    return scans.join(main.groupBy("scan").agg(F.count("*").alias("n")), "scan", "left").select("scan", F.coalesce("n", F.lit(0)).alias("n"))


def band_overlap(spw: DataFrame, bands: DataFrame) -> DataFrame:
    """(band, spw, lo_hz, hi_hz, selector) where a band and a window share more than a point. Both tables describe the set-up: a few rows."""
    both = spw.join(F.broadcast(bands.withColumnsRenamed({"lo_hz": "__lo", "hi_hz": "__hi"})), (F.col("fmin") < F.col("__hi")) & (F.col("fmax") > F.col("__lo")))
    lo, hi = F.greatest("fmin", "__lo"), F.least("fmax", "__hi")
    text = F.concat(F.col("spw").cast("string"), F.lit(":"), F.format_string("%.6f", lo / 1e6), F.lit("~"), F.format_string("%.6f", hi / 1e6), F.lit("MHz"))
    return both.select("band", "spw", lo.alias("lo_hz"), hi.alias("hi_hz"), text.alias("selector"))


def spw_bounds(spw: DataFrame) -> DataFrame:
    """(spw, fmin, fmax) from the channel frequencies."""
    return spw.select("spw", F.array_min("chan_freq").alias("fmin"), F.array_max("chan_freq").alias("fmax"))


def decide_bands(spw: DataFrame, bands: DataFrame) -> DataFrame:
    """(band, lo_hz, hi_hz): the requested bands if every one overlaps some window, else the lowest and highest quarter of the span."""
    span = spw.agg(F.min("fmin").alias("f0"), F.max("fmax").alias("f1"))
    met = band_overlap(spw, bands).agg(F.count_distinct("band").alias("met"))
    asked = bands.agg(F.count("*").alias("asked"), F.min_by("band", "lo_hz").alias("low"), F.max_by("band", "lo_hz").alias("high"))
    facts = span.withColumn("k", F.lit(0)).join(met.withColumn("k", F.lit(0)), "k").join(asked.withColumn("k", F.lit(0)), "k")
    rows = bands.withColumn("k", F.lit(0)).join(F.broadcast(facts), "k")
    quarter = (F.col("f1") - F.col("f0")) / 4
    ok = F.col("met") == F.col("asked")
    lo = F.when(ok, F.col("lo_hz")).when(F.col("band") == F.col("low"), F.col("f0")).otherwise(F.col("f1") - quarter)
    hi = F.when(ok, F.col("hi_hz")).when(F.col("band") == F.col("low"), F.col("f0") + quarter).otherwise(F.col("f1"))
    return rows.select("band", lo.alias("lo_hz"), hi.alias("hi_hz"))


def refant_from_spectra(spectra: DataFrame, spw: DataFrame, amp: str = "amp") -> DataFrame:
    """choose_refant over the middle channels (20 to 80 percent of each window) of spectra (ant1, ant2, spw, amp): mean amplitude and noise of each row come from those."""
    limits = calibration_channels(spw).withColumnsRenamed({"first": "__first", "last": "__last"})
    cut = spectra.join(limits, "spw").withColumn(amp, channel_slice(F.col(amp), F.col("__first"), F.col("__last"))).drop("__first", "__last")
    return choose_refant(row_amp_stats(cut, amp))


def choose_refant(rows: DataFrame) -> DataFrame:
    """(ant, mean, rms): of the antennas whose median amplitude is above the median of antennas, the one with the least noise (ties: the least antenna)."""
    each = rows.select(F.explode(F.array("ant1", "ant2")).alias("ant"), "mean", "rms")
    typical = exact_quantiles(each, "mean", {"mean": 0.5}, ["ant"]).join(each.groupBy("ant").agg(F.avg("rms").alias("rms")), "ant")
    middle = typical.agg(F.median("mean").alias("m"))  # one row for each antenna comes in
    return attach(typical, middle, ()).filter(F.col("mean") > F.col("m")).select("ant", "mean", "rms").orderBy("rms", "ant").limit(1)


def calibration_channels(spw: DataFrame) -> DataFrame:
    """(spw, first, last): the middle channels, from 20 to 80 percent of each window's number of channels."""
    n = F.size("chan_freq")
    return spw.select("spw", F.floor(0.2 * n).cast("int").alias("first"), F.floor(0.8 * n).cast("int").alias("last"))
