"""Queries over visibility rows, channels and spectra."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyaccord.operators import vis
from skyaccord.plans.common import rounded9 as rounded
from skyaccord.plans.common import sql9 as sql
from skyaccord.plans.fixtures import view


def _rows(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "vis_rows")


def vis_by_scan(spark, sf_dir):
    return rounded(vis.by_scan(_rows(spark, sf_dir)))


def vis_by_antenna(spark, sf_dir):
    return rounded(vis.by_antenna(_rows(spark, sf_dir)))


def vis_by_baseline(spark, sf_dir):
    return rounded(vis.by_baseline(_rows(spark, sf_dir)))


def flags_by_channel(spark, sf_dir):
    return rounded(vis.flags_by_channel(view(spark, sf_dir, "vis_chan")))


def flags_channel_avg(spark, sf_dir):
    return rounded(vis.flags_by_channel_avg(vis.flags_by_channel(view(spark, sf_dir, "vis_chan"))))


def overall_flagging(spark, sf_dir):
    return rounded(vis.overall_flagging(_rows(spark, sf_dir)))


def scan_compare(spark, sf_dir):
    rows = _rows(spark, sf_dir).filter("pol IN ('XX', 'XY', 'YX', 'YY')")
    return rounded(vis.compare_scan_medians(rows.filter("spw = 1").withColumn("pol", F.substring("pol", 1, 1)), rows.filter("spw = 0").withColumn("pol", F.substring("pol", 1, 1))))


def _fields(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Nations as fields of the customers' orders; the order's weekday number as its scan."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    field = read("nation").select(F.col("n_nationkey").cast("int").alias("field_id"), F.col("n_name").alias("name"))
    customers = read("customer").select("c_custkey", F.col("c_nationkey").cast("int").alias("field_id"))
    main = read("orders").select("o_custkey", F.pmod("o_orderkey", F.lit(31)).alias("scan")).join(customers, F.col("o_custkey") == F.col("c_custkey")).select("field_id", "scan")
    return main, field


def field_scans(spark, sf_dir):
    main, field = _fields(spark, sf_dir)
    first = field.agg(F.min("name")).first()[0]
    return vis.scans_for_field(main, field, first)


def selection_counts(spark, sf_dir):
    main, field = _fields(spark, sf_dir)
    scans = main.select("scan").distinct().unionByName(spark.range(31, 34).select(F.col("id").alias("scan")))
    return vis.selection_count(vis.select_field(main, field, "3"), scans)


def _windows(spark, sf_dir) -> DataFrame:
    """Spectral windows from the frequencies of the spectra's points."""
    points = view(spark, sf_dir, "sed_points")
    return points.groupBy(F.floor((F.col("freq_hz") - 9e8) / 2.5e8).cast("int").alias("spw")).agg(F.min("freq_hz").alias("fmin"), F.max("freq_hz").alias("fmax"))


def band_overlap(spark, sf_dir):
    return rounded(vis.band_overlap(_windows(spark, sf_dir), view(spark, sf_dir, "band_dim")).drop("selector"), 3)


def bands(spark, sf_dir):
    asked = view(spark, sf_dir, "band_dim").withColumn("hi_hz", F.when(F.col("band") == "lowband", 8e8).otherwise(F.col("hi_hz"))).withColumn("lo_hz", F.when(F.col("band") == "lowband", 7e8).otherwise(F.col("lo_hz")))
    return rounded(vis.decide_bands(_windows(spark, sf_dir), asked), 3)


def _spectra(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "spectra").withColumn("amp", F.col("amp").cast("array<double>"))


def spectrum_rms(spark, sf_dir):
    rows = vis.row_amp_stats(_spectra(spark, sf_dir), flag=None)
    return rounded(rows.select("row_id", "mean", "rms"), 5)


def detrend(spark, sf_dir):
    rows = vis.detrend(_spectra(spark, sf_dir))
    return rounded(rows.select("row_id", F.posexplode("residual").alias("chan", "residual")), 5)


def refant(spark, sf_dir):
    return rounded(vis.choose_refant(_rows(spark, sf_dir)))


def baseline_classes(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return rows.groupBy(vis.baseline_class(F.col("ant1"), F.col("ant2")).alias("class"), vis.pol_class(F.col("pol")).alias("pol_class")).agg(F.count("*").alias("n"))


def _main_table(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Embeddings as complex spectra with flags and missing channels, and their two dimension tables."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    missing = (F.col("vec_id") % 5 == 0).cast("int") * (F.col("vec_id") % 40 + 12)  # a channel of every fifth row
    sample = lambda x, i: F.when((missing == 0) | (i != missing), F.struct(x.cast("double").alias("re"), (x.cast("double") * 0.75).alias("im")))
    main = rows.select(F.col("vec_id").alias("row_id"), (F.col("vec_id") % 3).cast("int").alias("data_desc_id"), (F.col("vec_id") % 4).cast("int").alias("pol_idx"), F.transform("embedding", sample).alias("data"), F.transform("embedding", lambda x: x > 0.1).alias("flag"))
    windows = main.select("data_desc_id").distinct().select("data_desc_id", (F.col("data_desc_id") * 10).alias("spw"))
    pols = main.select("pol_idx").distinct().select("pol_idx", F.element_at(F.array(F.lit(5), F.lit(10), F.lit(12), F.lit(99)), F.col("pol_idx") + 1).alias("corr_type"))
    return main, windows, pols


def visibilities(spark, sf_dir):
    """Main table to row statistics: amplitudes of the data column, window and polarisation joined, channels 8 to 55, flags."""
    main, windows, pols = _main_table(spark, sf_dir)
    rows = vis.load_visibilities(main, windows, pols)
    low, high = F.lit(8), F.lit(56)
    sliced = rows.select("row_id", "spw", "pol", vis.channel_slice(F.col("amp"), low, high).alias("amp"), vis.channel_slice(F.col("flag"), low, high).alias("flag"))
    return rounded(vis.row_amp_stats(sliced).drop("amp", "flag"), 5)


def unflagged(spark, sf_dir):
    """Statistics of the samples without a flag."""
    main, windows, pols = _main_table(spark, sf_dir)
    rows = vis.row_amp_stats(vis.load_visibilities(main, windows, pols), exclude_flagged=True)
    return rounded(rows.select("row_id", "mean", "rms", "flag_frac"), 5)


def _matrix(n: int, window: int, order: int):
    """The smoother as a matrix: its columns are the trends of single channels."""
    return vis.smooth(np.eye(n), window, order).T


def _smoothing_sql(n: int = 64) -> str:
    """The smoothing weights of n channels as a table."""
    w, order = vis.smoothing_window(n), 3
    matrix = _matrix(n, w, order)
    # Inside rows repeat; only the weights of the first, the centred and the last window are written out.
    rows = ", ".join(f"({i}, {j}, {float(v)!r}::DOUBLE)" for i, r in enumerate(matrix) for j, v in enumerate(r) if v)
    return f"(VALUES {rows}) AS s(i, j, v)"


_RESIDUAL = f"e AS (SELECT row_id, generate_subscripts(amp, 1) - 1 AS chan, CAST(unnest(amp) AS DOUBLE) AS a FROM spectra), t AS (SELECT row_id, i AS chan, sum(a*v) AS trend FROM e JOIN {_smoothing_sql()} ON e.chan = s.j GROUP BY 1, 2), r AS (SELECT row_id, chan, a, a - trend AS residual FROM e JOIN t USING (row_id, chan))"
_MED = "R(median(mean)) AS mean, R(median(rms)) AS rms"
_SIDE = "SELECT scan, pol[1] AS pol, median(mean) AS mean, median(rms) AS rms FROM vis_rows WHERE spw = {} GROUP BY 1, 2"
_FLAGS = "SELECT CASE WHEN ant1 = ant2 THEN 'auto' ELSE 'cross' END AS class, spw, chan, pol, count(flag) AS total, CAST(sum(CASE WHEN flag THEN 1 ELSE 0 END) AS BIGINT) AS flagged FROM vis_chan GROUP BY 1, 2, 3, 4"
_WIN = "w AS (SELECT CAST(floor((freq_hz - 9e8)/2.5e8) AS INTEGER) AS spw, min(freq_hz) AS fmin, max(freq_hz) AS fmax FROM sed_points GROUP BY 1)"

_MAIN = """SELECT row_id, data_desc_id, pol_idx, chan, CASE WHEN row_id % 5 <> 0 OR row_id % 40 + 12 <> chan THEN abs(x)*1.25 END AS a, x > 0.1::FLOAT AS flag FROM (
  SELECT vec_id AS row_id, vec_id % 3 AS data_desc_id, vec_id % 4 AS pol_idx, generate_subscripts(embedding, 1) - 1 AS chan, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) AS t"""


def _rows_sql(n: int, low: int, keep: str, more: str) -> str:
    """Row statistics over n channels from `low` on; keep: which samples count."""
    return f"""WITH e AS MATERIALIZED (SELECT * FROM ({_MAIN}) AS m WHERE chan BETWEEN {low} AND {low + n - 1}), t AS (SELECT row_id, i + {low} AS chan, sum(a*v) AS trend FROM e JOIN {_smoothing_sql(n)} ON e.chan = s.j + {low} GROUP BY 1, 2),
  c AS (SELECT row_id, median(a) AS middle, count(a) < {n} AS holed FROM e GROUP BY 1), r AS (SELECT e.*, a - CASE WHEN holed THEN middle ELSE trend END AS residual FROM e JOIN c USING (row_id) JOIN t USING (row_id, chan))
  SELECT row_id, {more}round(avg(a) FILTER ({keep}), 5) + 0.0 AS mean, round(stddev_pop(residual) FILTER ({keep}), 5) + 0.0 AS rms, round(avg(CASE WHEN flag THEN 1.0 ELSE 0.0 END), 5) + 0.0 AS flag_frac FROM r GROUP BY row_id, data_desc_id, pol_idx"""


QUERIES = {
    "visibilities": (visibilities, _rows_sql(48, 8, "TRUE", "CAST(data_desc_id*10 AS INTEGER) AS spw, CASE pol_idx WHEN 0 THEN 'RR' WHEN 1 THEN 'XY' WHEN 2 THEN 'YY' ELSE '99' END AS pol, ")),
    "unflagged": (unflagged, _rows_sql(64, 0, "NOT flag", "")),
    "vis_by_scan": (vis_by_scan, sql(f"SELECT scan, pol, {_MED}, R(avg(flag_frac)) AS flag_frac FROM vis_rows GROUP BY 1, 2", "vis_rows")),
    "vis_by_antenna": (vis_by_antenna, sql(f"SELECT ant, pol, {_MED}, R(avg(flag_frac)) AS flag_frac FROM (SELECT ant1 AS ant, * FROM vis_rows UNION ALL SELECT ant2 AS ant, * FROM vis_rows) AS v GROUP BY 1, 2", "vis_rows")),
    "vis_by_baseline": (vis_by_baseline, sql(f"SELECT CAST(ant1 AS VARCHAR) || '-' || CAST(ant2 AS VARCHAR) AS base, pol, {_MED} FROM vis_rows GROUP BY 1, 2", "vis_rows")),
    "flags_by_channel": (flags_by_channel, sql(f"SELECT *, R(flagged/total) AS flag_frac FROM ({_FLAGS}) AS f", "vis_chan")),
    "flags_channel_avg": (flags_channel_avg, sql(f"SELECT class, chan, pol, R(avg(flagged/total)) AS flag_frac FROM ({_FLAGS}) AS f GROUP BY 1, 2, 3", "vis_chan")),
    "overall_flagging": (overall_flagging, sql("SELECT R(avg(flag_frac)) AS flag_frac, count(*) AS n_rows FROM vis_rows", "vis_rows")),
    "scan_compare": (scan_compare, sql(f"SELECT scan, pol, R(t.mean) AS mean_test, R(r.mean) AS mean_ref, R(t.rms) AS rms_test, R(r.rms) AS rms_ref FROM ({_SIDE.format(1)}) AS t FULL JOIN ({_SIDE.format(0)}) AS r USING (scan, pol)", "vis_rows")),
    "field_scans": (field_scans, "SELECT DISTINCT o_orderkey % 31 AS scan FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_name = (SELECT min(n_name) FROM nation)"),
    "selection_counts": (selection_counts, "WITH m AS (SELECT o_orderkey % 31 AS scan, c_nationkey AS f FROM orders JOIN customer ON o_custkey = c_custkey), s AS (SELECT DISTINCT scan FROM m UNION ALL SELECT * FROM range(31, 34)) SELECT s.scan, count(m.f) AS n FROM s LEFT JOIN m ON m.scan = s.scan AND m.f = 3 GROUP BY 1"),
    "band_overlap": (band_overlap, sql(f"WITH {_WIN} SELECT band, spw, greatest(fmin, lo_hz) AS lo_hz, least(fmax, hi_hz) AS hi_hz FROM w JOIN band_dim ON fmin < hi_hz AND fmax > lo_hz", "sed_points", "band_dim")),
    "bands": (bands, sql(f"WITH {_WIN}, x AS (SELECT min(fmin) AS f0, max(fmax) AS f1 FROM w) SELECT * FROM (SELECT 'lowband' AS band, f0 AS lo_hz, f0 + (f1 - f0)/4 AS hi_hz FROM x UNION ALL SELECT 'highband', f1 - (f1 - f0)/4, f1 FROM x) AS b", "sed_points")),
    "spectrum_rms": (spectrum_rms, sql(f"WITH {_RESIDUAL} SELECT row_id, round(avg(a), 5) + 0.0 AS mean, round(stddev_pop(residual), 5) + 0.0 AS rms FROM r GROUP BY row_id", "spectra")),
    "detrend": (detrend, sql(f"WITH {_RESIDUAL} SELECT row_id, CAST(chan AS INTEGER) AS chan, round(residual, 5) + 0.0 AS residual FROM r", "spectra")),
    "refant": (refant, sql("WITH e AS (SELECT ant, median(mean) AS mean, avg(rms) AS rms FROM (SELECT ant1 AS ant, mean, rms FROM vis_rows UNION ALL SELECT ant2, mean, rms FROM vis_rows) AS v GROUP BY 1) SELECT ant, R(mean) AS mean, R(rms) AS rms FROM e WHERE mean > (SELECT median(mean) FROM e) ORDER BY e.rms, ant LIMIT 1", "vis_rows")),
    "baseline_classes": (baseline_classes, sql("SELECT CASE WHEN ant1 = ant2 THEN 'auto' ELSE 'cross' END AS class, CASE WHEN pol IN ('XX', 'YY', 'LL', 'RR') THEN 'parallel' ELSE 'crossed' END AS pol_class, count(*) AS n FROM vis_rows GROUP BY 1, 2", "vis_rows")),
}
