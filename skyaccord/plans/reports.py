"""Whole reports as named tables, each one lazy plan over its input."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyaccord.functions import flux, sky
from skyaccord.lineage import stored
from skyaccord.operators import fit, sources, stats, vis
from skyaccord.plans.common import harmonic_sql, huber_sql, matched, matched_sql, rounded, rounded9, sql, sql9
from skyaccord.plans.fixtures import view
from skyaccord.sources.sinks import metrics_table

#: Observation ids and their correlator modes (fixed values).
OBSERVATION_MODES = {
    "1590555655": "c544M32kWB8s",
    "1590547878": "c544M4kWB8s",
    "1590381727": "c856M4k_n107M8s",
    "1590377455": "c856M32kWB8s",
    "1590129959": "c856M4kWB8s",
    "1585989326": "c8561kWB-April",
    "1586305859": "c8564kWB-April",
    "1586070058": "c5444kWB-April",
    "1586162571": "c5441kWB-April",
}


def attach_mode(df: DataFrame, observation: str = "observation", modes: dict[str, str] | None = None) -> DataFrame:
    """df with the mode of the observation id that its observation name holds; null for an unknown one."""
    found = F.coalesce(*[F.when(F.contains(F.col(observation), F.lit(k)), F.lit(v)) for k, v in (modes or OBSERVATION_MODES).items()])
    return df.withColumn("mode", found)


def beam_join(matches: DataFrame, images: DataFrame, reference: str) -> DataFrame:
    """Matches with the reference image's beam (arcsec) and reference pixel; an image without them is an error.

    images has a row for each image of the comparison; one of them is joined.
    """
    one = images.filter(F.col("image_id") == reference).withColumn("__k", F.lit(0))
    known = F.col("bmaj_deg").isNotNull() & F.col("bmin_deg").isNotNull() & F.col("crpix1").isNotNull() & F.col("crpix2").isNotNull()
    checked = F.when(known, F.col("bmaj_deg") * 3600).otherwise(F.raise_error(F.lit("the reference image lacks its beam or reference pixel")).cast("double"))
    one = one.select("__k", checked.alias("bmaj"), (F.col("bmin_deg") * 3600).alias("bmin"), F.col("crpix1").alias("x0"), F.col("crpix2").alias("y0"))
    return matches.withColumn("__k", F.lit(0)).join(F.broadcast(one), "__k").drop("__k")


def astrometry_offsets(matches: DataFrame, images: DataFrame, reference: str) -> DataFrame:
    """Offsets of matched pairs in arcsec and beams, their direction, and both sides' angles around the reference image's pixel."""
    m = beam_join(matches, images, reference)
    east, north = sky.spherical_offsets(F.col("ra_1"), F.col("dec_1"), F.col("ra_2"), F.col("dec_2"))
    m = m.withColumns({"d_ra": east, "d_dec": north})
    beams = {f"{c}_{b}": F.col(c) / F.col(b) for c in ("d_ra", "d_dec") for b in ("bmaj", "bmin")}
    angles = {f"phi_{k}": sky.pixel_angle(F.col(f"xposn_{k}"), F.col(f"yposn_{k}"), F.col("x0"), F.col("y0")) for k in (1, 2)}
    theta = sky.offset_angle(F.col("d_ra"), F.col("d_dec"))
    return m.withColumns(beams | angles | {"theta": theta, "theta_bmaj": theta / F.col("bmaj"), "rho_bmaj": sky.rho(F.col("d_ra"), F.col("d_dec"), F.col("bmaj"))})


def astrometry_report(matches: DataFrame, images: DataFrame, reference: str, only: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Tables: offsets, statistics, rho, direction, harmonics (four labelled fits in one plan), ellipse; or only some of them. The offsets are stored once."""
    o = stored(astrometry_offsets(matches, images, reference))
    pairs = [F.struct(F.lit(f"{y} vs {phi}").alias("label"), F.col(phi).alias("phi"), F.col(y).alias("y")) for y in ("d_ra_bmaj", "d_dec_bmaj") for phi in ("phi_1", "phi_2")]
    tables = {
        "offsets": lambda: o,
        "statistics": lambda: stats.offset_stats(o, ["d_ra", "d_dec", "d_ra_bmaj", "d_dec_bmaj", "d_ra_bmin", "d_dec_bmin", "rho_bmaj"]),
        "rho": lambda: stats.exact_quantiles(o, "rho_bmaj", {"median": 0.5, "p84": 0.84}, ready=True),
        "direction": lambda: stats.circular_stats(o, "theta"),
        "harmonics": lambda: fit.harmonic_fit(o.select(F.explode(F.array(*pairs)).alias("x")).select("x.*"), "phi", "y", ["label"]),
        "ellipse": lambda: stats.enclosing_ellipse(o, "d_ra", "d_dec"),
    }
    return _built(tables, only)


def astrometry_overlays(main: DataFrame, scans: DataFrame, x: str = "d_ra", y: str = "d_dec") -> DataFrame:
    """(series, ellipse) of the main match and of each scan's match (column scan_id)."""
    series = main.select(F.lit("main").alias("series"), x, y).unionByName(scans.select(F.col("scan_id").cast("string").alias("series"), x, y))
    return stats.enclosing_ellipse(series, x, y, ["series"])


def _built(tables: dict[str, Callable[[], DataFrame]], only: Sequence[str] | None) -> dict[str, DataFrame]:
    """The tables that are asked for, or all; the others are not computed, and iterative fits are."""
    return {name: build() for name, build in tables.items() if only is None or name in only}


def flux_report(fluxes: DataFrame, scans: DataFrame | None = None, keys: Sequence[str] = ("band", "flux_type"), only: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Tables of flux comparisons (keys, ref, test, e_ref, e_test): summary, gain, line, histogram, and scans (by scan_id); or only some of them. The comparisons are stored once."""
    keys = list(keys)
    both = stored(fluxes).withColumns({"frac": flux.frac_diff(F.col("test"), F.col("ref")), "ratio": flux.ratio(F.col("test"), F.col("ref"))})
    tables = {
        "summary": lambda: stats.frac_summary(both, "frac", "ratio", keys),
        "gain": lambda: fit.gain_through_origin(both, "ref", "test", "e_ref", "e_test", keys),
        "line": lambda: fit.flux_fit(both, "ref", "test", "e_test", keys),
        "histogram": lambda: stats.histogram(both, "frac", keys),
    }
    if scans is not None:
        frac = flux.frac_diff(F.col("test"), F.col("ref"))
        tables["scans"] = lambda: scans.withColumn("frac", frac).groupBy("scan_id").agg(F.count("frac").alias("n"), F.avg("frac").alias("mean"), F.stddev_pop("frac").alias("std"))
    return _built(tables, only)


def vis_report(rows: DataFrame, flags: DataFrame | None = None, reference: DataFrame | None = None, only: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Tables of per-row statistics: by scan, antenna and baseline, overall; channels from long flags; comparison with a reference's rows; or only some of them. Series are sorted."""
    tables = {
        "scan": lambda: vis.by_scan(rows).orderBy("pol", "scan"),
        "antenna": lambda: vis.by_antenna(rows).orderBy("pol", "ant"),
        "baseline": lambda: vis.by_baseline(rows).orderBy("pol", "base"),
        "overall": lambda: metrics_table(vis.overall_flagging(rows), "vis"),
    }
    if flags is not None:
        tables["channel"] = lambda: vis.flags_by_channel(flags).orderBy("class", "spw", "pol", "chan")
        tables["channel_mean"] = lambda: vis.flags_by_channel_avg(vis.flags_by_channel(flags)).orderBy("class", "pol", "chan")
    if reference is not None:
        tables["comparison"] = lambda: vis.compare_scan_medians(rows, reference).orderBy("pol", "scan")
    return _built(tables, only)


def calibrator_catalog(catalogues: DataFrame, catalog: str = "catalog") -> DataFrame:
    """One row for each calibrator catalogue: its brightest source."""
    keep = [c for c in ("source_id", "ra", "dec", "e_ra", "e_dec", "peak_flux", "e_peak_flux", "total_flux", "e_total_flux") if c in catalogues.columns]
    return sources.brightest(catalogues, 1, catalog).select(catalog, *keep)


def source_filter_report(catalogue: DataFrame, b_min: float, snr: float = 10.0, flux_floor: float = 1e-6) -> DataFrame:
    """The catalogue with good flags and repaired flux errors (columns maj, min, pa, isl_rms of the source fit)."""
    errors = flux.source_errors(F.col("maj"), F.col("min"), F.col("pa"), F.lit(b_min), F.col("total_flux"), F.col("peak_flux"), F.col("isl_rms"))
    fitted = sources.replace_bad_errors(catalogue.withColumn("e_fit", errors["e_flux"]), "e_total_flux", "e_fit").drop("e_fit")
    return sources.good_sources(fitted, snr, flux_floor)


def figure_points(rows: DataFrame, x: str, y: str, inlier: str, line: DataFrame) -> DataFrame:
    """(series, x, y) of a comparison figure: inliers, outliers, the diagonal and the fitted line (a row slope, intercept) up to the axis limit."""
    points = rows.select(F.when(F.col(inlier), "inlier").otherwise("outlier").alias("series"), F.col(x).alias("x"), F.col(y).alias("y"))
    limit = stats.axis_limits(rows, x, y).withColumn("__k", F.lit(0)).join(line.select("slope", "intercept").withColumn("__k", F.lit(0)), "__k")  # one row each
    ends = F.array(*[F.struct(F.lit(s).alias("series"), v.alias("x"), w.alias("y")) for s, v, w in (("y = x", F.lit(0.0), F.lit(0.0)), ("y = x", F.col("limit"), F.col("limit")), ("fit", F.lit(0.0), F.col("intercept")), ("fit", F.col("limit"), F.col("slope") * F.col("limit") + F.col("intercept")))])
    return points.unionByName(limit.select(F.explode(ends).alias("e")).select("e.*"))


def _beams(spark, sf_dir):
    o = astrometry_offsets(matched(spark, sf_dir), view(spark, sf_dir, "image_dim"), "ref")
    return rounded(o.agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in ("d_ra_bmin", "d_dec_bmaj", "phi_1", "phi_2", "theta_bmaj")]), 4)


def _harmonics(spark, sf_dir):
    return rounded(astrometry_report(matched(spark, sf_dir), view(spark, sf_dir, "image_dim"), "ref", ["harmonics"])["harmonics"], 4)


def _fluxes(spark, sf_dir) -> DataFrame:
    """Both flux types of every match as one table of comparisons, errors scaled to each."""
    m = matched(spark, sf_dir)
    kinds = [F.struct(F.lit(k).alias("flux_type"), F.col(f"{k}_1").alias("ref"), F.col(f"{k}_2").alias("test"), F.col("e_peak_flux_1").alias("e_ref"), F.col("e_peak_flux_2").alias("e_test")) for k in ("peak_flux", "total_flux")]
    return m.select(F.lit("wide").alias("band"), "source_id_1", F.explode(F.array(*kinds)).alias("x")).select("band", "source_id_1", "x.*")


def _flux_table(name):
    def query(spark, sf_dir):
        rows = _fluxes(spark, sf_dir)
        report = flux_report(rows.drop("source_id_1"), rows.withColumn("scan_id", F.pmod("source_id_1", F.lit(5))), only=[name])
        return rounded(report[name], 5)

    return query


def _vis_table(name):
    def query(spark, sf_dir):
        rows = view(spark, sf_dir, "vis_rows")
        return rounded9(vis_report(rows.filter("spw = 1"), view(spark, sf_dir, "vis_chan"), rows.filter("spw = 0"), [name])[name])

    return query


def _astrometry_table(name):
    def query(spark, sf_dir):
        return rounded(astrometry_report(matched(spark, sf_dir), view(spark, sf_dir, "image_dim"), "ref", [name])[name], 4)

    return query


def _overall(spark, sf_dir):
    return rounded9(vis_report(view(spark, sf_dir, "vis_rows"), only=["overall"])["overall"])


def _calibrators(spark, sf_dir):
    cat = view(spark, sf_dir, "cat_ref").filter("ra IS NOT NULL").withColumn("catalog", F.pmod("source_id", F.lit(50)))
    return rounded(calibrator_catalog(cat).select("catalog", "source_id", "ra", "peak_flux"))


def _filtered(spark, sf_dir):
    cat = view(spark, sf_dir, "cat_test").withColumns({"maj": F.lit(9.0), "min": F.lit(7.5), "pa": F.lit(45.0), "isl_rms": F.col("e_peak_flux"), "e_total_flux": F.when(F.col("source_id") % 2 == 0, F.lit(-1.0)).otherwise(F.lit(0.25))})
    return rounded(source_filter_report(cat, 7.68, 150.0).groupBy("good").agg(F.count("*").alias("n"), F.sum("e_total_flux").alias("e_total_flux")), 3)


def _figure(spark, sf_dir):
    m = stats.mad_inlier(matched(spark, sf_dir), "peak_flux_2", z=1.0)
    points = figure_points(m, "peak_flux_1", "peak_flux_2", "inlier", fit.weighted_linreg(m, "peak_flux_1", "peak_flux_2"))
    return rounded(points.groupBy("series").agg(F.count("*").alias("n"), F.max("x").alias("x"), F.max("y").alias("y")), 4)


_OFF = """WITH o AS (SELECT *, degrees(atan2(cos(radians(dec_2))*sin(radians(ra_2-ra_1)), cos(radians(dec_1))*cos(radians(dec_2))*cos(radians(ra_2-ra_1))+sin(radians(dec_1))*sin(radians(dec_2))))*3600 AS d_ra,
  degrees(asin(sin(radians(dec_2))*cos(radians(dec_1)) - cos(radians(dec_2))*sin(radians(dec_1))*cos(radians(ra_2-ra_1))))*3600 AS d_dec FROM m)"""

_LONG = "WITH l AS (" + " UNION ALL ".join(f"SELECT '{k}' AS flux_type, source_id_1, {k}_1 AS x, {k}_2 AS y, e_peak_flux_1 AS ex, e_peak_flux_2 AS ey FROM m" for k in ("peak_flux", "total_flux")) + ")"
_NEW_GAIN = "sum(x*y/(ey*ey + pow(g*ex, 2)))/sum(x*x/(ey*ey + pow(g*ex, 2)))"


def _r5(e: str, n: str) -> str:
    return f"round({e}, 5) + 0.0 AS {n}"


def _gain_sql() -> str:
    text = ", g0 AS (SELECT flux_type, count(*) AS n, sum(x*y)/sum(x*x) AS g, FALSE AS done FROM l GROUP BY 1)"
    for k in range(3):
        text += f", n{k} AS (SELECT flux_type, {_NEW_GAIN} AS new FROM l JOIN g{k} USING (flux_type) GROUP BY 1), g{k + 1} AS (SELECT flux_type, n, CASE WHEN done THEN g ELSE new END AS g, done OR abs(new - g) <= 1e-5*abs(g) AS done FROM g{k} JOIN n{k} USING (flux_type))"
    return f"{text} SELECT 'wide' AS band, flux_type, n, {_r5('g', 'gain')}, TRUE AS weighted FROM g3"


_LINE_SQL = f""", p AS (SELECT source_id_1 AS id, flux_type AS part, x, y, pow(greatest(ey, 1e-8), -2.0) AS base FROM l), mid AS (SELECT part, count(*) AS n, median(x) AS mx, median(y) AS my FROM p GROUP BY 1),
  sc AS (SELECT part, 1.4826*median(abs(x - mx)) AS sx, 1.4826*median(abs(y - my)) AS sy FROM p JOIN mid USING (part) GROUP BY 1),
  q AS (SELECT p.* FROM p JOIN mid USING (part) JOIN sc USING (part) WHERE abs(x - mx)/sx <= 4 AND abs(y - my)/sy <= 4){huber_sql('q', 'part', 'g')}{huber_sql('g_in', 'part', 'h')}
  SELECT 'wide' AS band, part AS flux_type, mid.n, h_fit.n AS n_inlier, mid.n - h_fit.n AS n_outlier, {', '.join(_r5(c, c) for c in ('slope', 'intercept', 'slope_err', 'intercept_err'))} FROM h_fit JOIN mid USING (part)"""
_Q = _OFF + ", q AS (SELECT *, d_ra/(0.002483482*3600) AS d_ra_bmaj, d_dec/(0.002483482*3600) AS d_dec_bmaj, d_ra/(0.002133589*3600) AS d_ra_bmin, d_dec/(0.002133589*3600) AS d_dec_bmin, sqrt(d_ra*d_ra + d_dec*d_dec)/(0.002483482*3600) AS rho_bmaj, degrees(atan2(d_dec, d_ra)) AS theta FROM o)"
_STATISTICS = ", ".join(f"round({e}, 4) + 0.0 AS {n}" for n, e in (("mean", "avg(v)"), ("std", "stddev_pop(v)"), ("median", "median(v)"), ("p16", "quantile_cont(v, 0.16)"), ("p84", "quantile_cont(v, 0.84)")))
_AROUND = ", ".join(f"round({e}, 4) + 0.0 AS {n}" for n, e in (("x0", "avg(d_ra)"), ("y0", "avg(d_dec)"), ("rx", "greatest(max(d_ra)-avg(d_ra), avg(d_ra)-min(d_ra))"), ("ry", "greatest(max(d_dec)-avg(d_dec), avg(d_dec)-min(d_dec))"), ("sx", "stddev_pop(d_ra)"), ("sy", "stddev_pop(d_dec)")))
_RAYLEIGH = "exp(-z)*(1 + (2*z - z*z)/(4*n) - (24*z - 132*z*z + 76*pow(z,3) - 9*pow(z,4))/(288.0*n*n))"
_MEDIANS = "R(median(mean)) AS mean, R(median(rms)) AS rms"
_CHANNELS = "SELECT CASE WHEN ant1 = ant2 THEN 'auto' ELSE 'cross' END AS class, spw, chan, pol, count(flag) AS total, CAST(sum(CASE WHEN flag THEN 1 ELSE 0 END) AS BIGINT) AS flagged FROM vis_chan GROUP BY 1, 2, 3, 4"
_SIDES = "SELECT scan, pol, median(mean) AS mean, median(rms) AS rms FROM vis_rows WHERE spw = {} GROUP BY 1, 2"

QUERIES = {
    "flux_report_gain": (_flux_table("gain"), matched_sql(_LONG + _gain_sql())),
    "flux_report_line": (_flux_table("line"), matched_sql(_LONG + _LINE_SQL)),
    "flux_report_histogram": (_flux_table("histogram"), matched_sql(_LONG + " SELECT 'wide' AS band, flux_type, CAST(least(floor(((y - x)/x + 1)/(2.0/59)), 58) AS BIGINT) AS bin, count(*) AS n FROM l WHERE (y - x)/x BETWEEN -1 AND 1 GROUP BY 2, 3")),
    "flux_report_scans": (_flux_table("scans"), matched_sql(_LONG + f" SELECT source_id_1 % 5 AS scan_id, count(*) AS n, {_r5('avg((y - x)/x)', 'mean')}, {_r5('stddev_pop((y - x)/x)', 'std')} FROM l GROUP BY 1")),
    "vis_report_scan": (_vis_table("scan"), sql9(f"SELECT scan, pol, {_MEDIANS}, R(avg(flag_frac)) AS flag_frac FROM vis_rows WHERE spw = 1 GROUP BY 1, 2", "vis_rows")),
    "vis_report_antenna": (_vis_table("antenna"), sql9(f"SELECT ant, pol, {_MEDIANS}, R(avg(flag_frac)) AS flag_frac FROM (SELECT ant1 AS ant, * FROM vis_rows UNION ALL SELECT ant2 AS ant, * FROM vis_rows) AS v WHERE spw = 1 GROUP BY 1, 2", "vis_rows")),
    "vis_report_baseline": (_vis_table("baseline"), sql9(f"SELECT CAST(ant1 AS VARCHAR) || '-' || CAST(ant2 AS VARCHAR) AS base, pol, {_MEDIANS} FROM vis_rows WHERE spw = 1 GROUP BY 1, 2", "vis_rows")),
    "vis_report_channel": (_vis_table("channel"), sql9(f"SELECT *, R(flagged/total) AS flag_frac FROM ({_CHANNELS}) AS f", "vis_chan")),
    "vis_report_channel_mean": (_vis_table("channel_mean"), sql9(f"SELECT class, chan, pol, R(avg(flagged/total)) AS flag_frac FROM ({_CHANNELS}) AS f GROUP BY 1, 2, 3", "vis_chan")),
    "vis_report_comparison": (_vis_table("comparison"), sql9(f"SELECT scan, pol, R(t.mean) AS mean_test, R(r.mean) AS mean_ref, R(t.rms) AS rms_test, R(r.rms) AS rms_ref FROM ({_SIDES.format(1)}) AS t FULL JOIN ({_SIDES.format(0)}) AS r USING (scan, pol)", "vis_rows")),
    "astrometry_statistics": (_astrometry_table("statistics"), matched_sql(_Q + ", l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS quantity, {c} AS v FROM q" for c in ("d_ra", "d_dec", "d_ra_bmaj", "d_dec_bmaj", "d_ra_bmin", "d_dec_bmin", "rho_bmaj")) + f") SELECT quantity, count(v) AS n, {_STATISTICS} FROM l GROUP BY 1")),
    "astrometry_rho": (_astrometry_table("rho"), matched_sql(_Q + " SELECT round(median(rho_bmaj), 4) + 0.0 AS median, round(quantile_cont(rho_bmaj, 0.84), 4) + 0.0 AS p84 FROM q")),
    "astrometry_direction": (_astrometry_table("direction"), matched_sql(_Q + f""", g AS (SELECT count(theta) AS n, sum(cos(radians(theta))) AS c, sum(sin(radians(theta))) AS s FROM q), z AS (SELECT *, (c*c + s*s)/n AS z FROM g), p AS (SELECT *, greatest(0.0, least(1.0, {_RAYLEIGH})) AS p FROM z)
      SELECT n, round(sqrt(c*c + s*s)/n, 4) + 0.0 AS r, round((degrees(atan2(s, c)) + 360) % 360, 4) + 0.0 AS mean_deg, round(p, 4) + 0.0 AS p, CASE WHEN p <= 0.01 THEN 'directional' WHEN p <= 0.05 THEN 'weak' ELSE 'uniform' END AS verdict FROM p""")),
    "astrometry_ellipse": (_astrometry_table("ellipse"), matched_sql(_Q + f" SELECT {_AROUND} FROM q")),
    "beam_offsets": (_beams, matched_sql(_OFF + " SELECT count(*) AS n, " + ", ".join(f"round({e}, 4) + 0.0 AS {n}" for n, e in (
        ("d_ra_bmin", "avg(d_ra/(0.002133589*3600))"), ("d_dec_bmaj", "avg(d_dec/(0.002483482*3600))"), ("phi_1", "avg(degrees(atan2(yposn_1-2048, xposn_1-2048)))"),
        ("phi_2", "avg(degrees(atan2(yposn_2-2048, xposn_2-2048)))"), ("theta_bmaj", "avg(degrees(atan2(d_dec, d_ra))/(0.002483482*3600))"))) + " FROM o")),
    "astrometry_harmonics": (_harmonics, matched_sql(_OFF + ", pts AS (" + " UNION ALL ".join(
        f"SELECT '{y} vs phi_{k}' AS label, degrees(atan2(yposn_{k}-2048, xposn_{k}-2048)) AS phi, {e} AS y FROM o"
        for y, e in (("d_ra_bmaj", "d_ra/(0.002483482*3600)"), ("d_dec_bmaj", "d_dec/(0.002483482*3600)")) for k in (1, 2)) + ")" + harmonic_sql("pts", "label", 4))),
    "vis_report": (_overall, sql9("SELECT 'vis' AS label, 'flag_frac' AS metric, R(avg(flag_frac)) AS value FROM vis_rows UNION ALL SELECT 'vis', 'n_rows', CAST(count(*) AS DOUBLE) FROM vis_rows", "vis_rows")),
    "calibrator_catalog": (_calibrators, sql("SELECT catalog, source_id, R(CASE WHEN ra <= 0 THEN ra + 360 ELSE ra END) AS ra, R(peak_flux) AS peak_flux FROM (SELECT *, source_id % 50 AS catalog, row_number() OVER (PARTITION BY source_id % 50 ORDER BY peak_flux DESC, source_id) AS k FROM cat_ref WHERE ra IS NOT NULL) AS t WHERE k = 1", "cat_ref")),
    "source_filter_report": (_filtered, sql("""WITH r AS (SELECT *, sqrt(pi()/(8*ln(2.0))*9.0*7.5/(7.68*7.68/4)*peak_flux*peak_flux/(e_peak_flux*e_peak_flux)) AS rho FROM cat_test)
      SELECT peak_flux/e_peak_flux > 150 AND e_peak_flux > 1e-6 AS good, count(*) AS n, round(sum(CASE WHEN source_id % 2 = 0 THEN sqrt(2.0)*total_flux/rho ELSE 0.25 END), 3) + 0.0 AS e_total_flux FROM r GROUP BY 1""", "cat_test")),
    "figure_points": (_figure, matched_sql("""WITH md AS (SELECT median(peak_flux_2) AS md, stddev_pop(peak_flux_2) AS sd FROM m), sc AS (SELECT 1.4826*median(abs(peak_flux_2 - md)) AS sc FROM m, md),
      p AS (SELECT CASE WHEN abs(peak_flux_2 - md)/sc <= 1 THEN 'inlier' ELSE 'outlier' END AS series, peak_flux_1 AS x, peak_flux_2 AS y FROM m, md, sc),
      l AS (SELECT 1.05*greatest(max(abs(peak_flux_1)), max(abs(peak_flux_2))) AS lim, regr_slope(peak_flux_2, peak_flux_1) AS s, regr_intercept(peak_flux_2, peak_flux_1) AS i FROM m),
      a AS (SELECT * FROM p UNION ALL SELECT 'y = x', 0, 0 FROM l UNION ALL SELECT 'y = x', lim, lim FROM l UNION ALL SELECT 'fit', 0, i FROM l UNION ALL SELECT 'fit', lim, s*lim + i FROM l)
      SELECT series, count(*) AS n, round(max(x), 4) + 0.0 AS x, round(max(y), 4) + 0.0 AS y FROM a GROUP BY 1""")),
}
