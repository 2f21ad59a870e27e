"""Queries over matched catalogues: matches, offsets, fluxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyaccord.functions import flux, sky
from skyaccord.operators import fit, match, sources, stats
from skyaccord.plans.common import harmonic_sql, huber_sql, matched, matched_sql, rounded, sql
from skyaccord.plans.fixtures import view

BMAJ, BMIN, X0, Y0 = 0.002483482 * 3600, 0.002133589 * 3600, 2048.0, 2048.0


def _cat(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return view(spark, sf_dir, name)


def match_one_to_one(spark, sf_dir):
    return rounded(matched(spark, sf_dir).select("source_id_1", "source_id_2", "sep_arcsec"))


def match_one_to_many(spark, sf_dir):
    return rounded(matched(spark, sf_dir, "one_to_many").select("source_id_1", "source_id_2", "sep_arcsec"))


def match_summary(spark, sf_dir):
    return match.match_summary(_cat(spark, sf_dir, "cat_ref"), _cat(spark, sf_dir, "cat_test"), matched(spark, sf_dir))


def unmatched_ref(spark, sf_dir):
    return match.unmatched(_cat(spark, sf_dir, "cat_ref"), matched(spark, sf_dir), 1).select("source_id")


def unmatched_test(spark, sf_dir):
    return match.unmatched(_cat(spark, sf_dir, "cat_test"), matched(spark, sf_dir), 2).select("source_id")


def match_jobs(spark, sf_dir):
    """Two match jobs (odd and even flux classes) in one plan."""
    def jobs(name):
        cat = _cat(spark, sf_dir, name)
        return cat.withColumn("job_id", F.concat(F.lit("job"), F.pmod("source_id", F.lit(2)).cast("string")))

    m = match.sky_match(jobs("cat_ref"), jobs("cat_test"), 1.0, keys=["job_id"])
    return m.groupBy(F.col("job_id_1").alias("job_id")).agg(F.count("*").alias("n"))


def nearest_any(spark, sf_dir):
    at = ["source_id", "ra", "dec"]
    got = match.nearest(_cat(spark, sf_dir, "cat_ref").select(*at), _cat(spark, sf_dir, "cat_test").select(*at))
    return got.select(F.col("source_id_1"), F.round("sep_arcsec", 3).alias("sep_arcsec"))


def _fluxes(spark, sf_dir, kind="peak_flux") -> DataFrame:
    ref, test = F.col(f"{kind}_1"), F.col(f"{kind}_2")
    return matched(spark, sf_dir).withColumns({"frac": flux.frac_diff(test, ref), "ratio": flux.ratio(test, ref)})


def frac_summary(spark, sf_dir):
    return rounded(stats.frac_summary(_fluxes(spark, sf_dir), "frac", "ratio"))


def nmad(spark, sf_dir):
    return rounded(stats.mad(_fluxes(spark, sf_dir), "ratio"))


def flux_report(spark, sf_dir):
    """Both flux types of every match in one grouped plan."""
    m = matched(spark, sf_dir)
    long = m.select(F.explode(F.array(*[F.struct(F.lit(k).alias("flux_type"), F.col(f"{k}_1").alias("ref"), F.col(f"{k}_2").alias("test")) for k in ("peak_flux", "total_flux")])).alias("x")).select("x.*")
    long = long.withColumns({"frac": flux.frac_diff(F.col("test"), F.col("ref")), "ratio": flux.ratio(F.col("test"), F.col("ref"))})
    return rounded(stats.frac_summary(long, "frac", "ratio", ["flux_type"]))


def _offsets(spark, sf_dir) -> DataFrame:
    m = matched(spark, sf_dir)
    east, north = sky.spherical_offsets(F.col("ra_1"), F.col("dec_1"), F.col("ra_2"), F.col("dec_2"))
    m = m.withColumns({"d_ra": east, "d_dec": north})
    return m.withColumns({
        "phi": sky.pixel_angle(F.col("xposn_1"), F.col("yposn_1"), F.lit(X0), F.lit(Y0)), "theta": sky.offset_angle(F.col("d_ra"), F.col("d_dec")),
        "d_ra_bmaj": F.col("d_ra") / BMAJ, "d_dec_bmaj": F.col("d_dec") / BMAJ, "d_ra_bmin": F.col("d_ra") / BMIN, "d_dec_bmin": F.col("d_dec") / BMIN,
        "rho_bmaj": sky.rho(F.col("d_ra"), F.col("d_dec"), F.lit(BMAJ)),
    })


_OFFSETS = f"""WITH o AS (SELECT *, degrees(atan2(cos(radians(dec_2))*sin(radians(ra_2-ra_1)), cos(radians(dec_1))*cos(radians(dec_2))*cos(radians(ra_2-ra_1))+sin(radians(dec_1))*sin(radians(dec_2))))*3600 AS d_ra,
  degrees(asin(sin(radians(dec_2))*cos(radians(dec_1)) - cos(radians(dec_2))*sin(radians(dec_1))*cos(radians(ra_2-ra_1))))*3600 AS d_dec FROM m),
q AS (SELECT *, degrees(atan2(yposn_1-{Y0}, xposn_1-{X0})) AS phi, degrees(atan2(d_dec, d_ra)) AS theta, d_ra/{BMAJ} AS d_ra_bmaj, d_dec/{BMAJ} AS d_dec_bmaj, d_ra/{BMIN} AS d_ra_bmin, d_dec/{BMIN} AS d_dec_bmin,
  sqrt(d_ra*d_ra+d_dec*d_dec)/{BMAJ} AS rho_bmaj FROM o)"""
_QUANTITIES = ("d_ra", "d_dec", "d_ra_bmaj", "d_dec_bmaj", "d_ra_bmin", "d_dec_bmin", "rho_bmaj")


def offsets(spark, sf_dir):
    return rounded(_offsets(spark, sf_dir).select("source_id_1", "d_ra", "d_dec", "phi", "rho_bmaj"), 5)


def offset_stats(spark, sf_dir):
    return rounded(stats.offset_stats(_offsets(spark, sf_dir), _QUANTITIES), 5)


def rho_summary(spark, sf_dir):
    return rounded(stats.exact_quantiles(_offsets(spark, sf_dir), "rho_bmaj", {"median": 0.5, "p84": 0.84}), 5)


def circular(spark, sf_dir):
    return rounded(stats.circular_stats(_offsets(spark, sf_dir).withColumn("part", F.pmod("source_id_1", F.lit(4))), "theta", ["part"]), 5)


def harmonic(spark, sf_dir):
    return rounded(fit.harmonic_fit(_offsets(spark, sf_dir).withColumn("part", F.pmod("source_id_1", F.lit(4))), "phi", "d_ra", ["part"]), 5)


def ellipse(spark, sf_dir):
    return rounded(stats.enclosing_ellipse(_offsets(spark, sf_dir), "d_ra", "d_dec"), 5)


def astrometry_overlays(spark, sf_dir):
    """The main match and its parts as labelled series with an enclosing ellipse each."""
    m = _offsets(spark, sf_dir).select("source_id_1", "d_ra", "d_dec")
    part = F.concat(F.lit("scan"), F.pmod("source_id_1", F.lit(3)).cast("string"))
    series = m.withColumn("series", F.explode(F.array(F.lit("main"), part)))
    return rounded(stats.enclosing_ellipse(series, "d_ra", "d_dec", ["series"]), 5)


def gain_origin(spark, sf_dir):
    m = matched(spark, sf_dir)
    return rounded(fit.gain_through_origin(m, "peak_flux_1", "peak_flux_2", "e_peak_flux_1", "e_peak_flux_2"))


def linreg_weighted(spark, sf_dir):
    m = matched(spark, sf_dir).withColumns({"w": 1 / (F.col("e_peak_flux_2") * F.col("e_peak_flux_2")), "part": F.pmod("source_id_1", F.lit(3))})
    return rounded(fit.weighted_linreg(m, "peak_flux_1", "peak_flux_2", "w", ["part"]), 5)


def mad_inliers(spark, sf_dir):
    m = stats.mad_inlier(_fluxes(spark, sf_dir), "ratio", z=2.0)
    return m.groupBy("inlier").agg(F.count("*").alias("n"))


def huber_fit(spark, sf_dir):
    fits, _ = fit.huber_fit(matched(spark, sf_dir).withColumn("part", F.pmod("source_id_1", F.lit(2))), "peak_flux_1", "peak_flux_2", "e_peak_flux_2", ["part"])
    return rounded(fits, 5)


def flux_fit(spark, sf_dir):
    return rounded(fit.flux_fit(matched(spark, sf_dir), "peak_flux_1", "peak_flux_2"), 5)


def scan_fracdiff(spark, sf_dir):
    m = _fluxes(spark, sf_dir).withColumn("scan_id", F.pmod("source_id_1", F.lit(5)))
    return rounded(m.groupBy("scan_id").agg(F.count("frac").alias("n"), F.avg("frac").alias("mean"), F.stddev_pop("frac").alias("std")))


def fracdiff_hist(spark, sf_dir):
    m = _fluxes(spark, sf_dir).withColumn("series", F.pmod("source_id_1", F.lit(2)))
    return stats.histogram(m, "frac", ["series"])


def pair_offsets(spark, sf_dir):
    d_ra, d_dec = sky.offsets_flat(F.col("ra_1"), F.col("dec_1"), F.col("ra_2"), F.col("dec_2"))
    m = matched(spark, sf_dir, "one_to_many").withColumns({"d_ra": d_ra, "d_dec": d_dec, "pair": F.pmod("source_id_1", F.lit(3))})
    return rounded(stats.avg_std_rms(m, ["d_ra", "d_dec", "sep_arcsec"], ["pair"]), 5)


def survey_offset_stats(spark, sf_dir):
    m = match.survey_offsets(matched(spark, sf_dir), BMAJ).withColumn("mode", F.pmod("source_id_1", F.lit(3)))
    return rounded(m.groupBy("mode").agg(*[f for c in ("d_ra", "d_dec", "d_ra_beam", "d_dec_beam") for f in (F.avg(c).alias(f"mean_{c}"), F.stddev_pop(c).alias(f"std_{c}"))]), 5)


def rotation_check(spark, sf_dir):
    """Both sides of every match in long form: pixel angle, distance from the centre, offset angle under the pair's mean declination."""
    m = matched(spark, sf_dir).withColumn("pair", F.pmod("source_id_1", F.lit(2)))
    means = m.groupBy("pair").agg(F.avg("dec_1").alias("mean_dec"))
    m = stats.attach(m, means, ["pair"])
    angle = sky.offset_angle_scaled(F.col("ra_1"), F.col("dec_1"), F.col("ra_2"), F.col("dec_2"), F.col("mean_dec"))
    sides = F.array(*[F.struct(F.lit(k).alias("cat_no"), F.col(f"xposn_{k}").alias("x"), F.col(f"yposn_{k}").alias("y")) for k in (1, 2)])
    long = m.select("pair", "source_id_1", angle.alias("theta"), F.explode(sides).alias("s")).select("pair", "source_id_1", "theta", "s.*")
    long = long.withColumns({"phi": sky.pixel_angle(F.col("x"), F.col("y"), F.lit(X0), F.lit(Y0), wrap=True), "radius": sky.radial_distance(F.col("x"), F.col("y"), 4096)})
    return rounded(long.groupBy("pair", "cat_no").agg(F.count("*").alias("n"), F.avg("phi").alias("phi"), F.avg("radius").alias("radius"), F.avg(F.abs("theta")).alias("theta")), 4)


def brightest2(spark, sf_dir):
    cat = _cat(spark, sf_dir, "cat_ref").withColumn("catalog", F.pmod("source_id", F.lit(50)))
    return rounded(sources.brightest(cat.filter("ra IS NOT NULL")).select("catalog", "rank", "source_id", "peak_flux"))


def secondary(spark, sf_dir):
    cat = _cat(spark, sf_dir, "cat_ref").filter("ra IS NOT NULL").withColumn("catalog", F.pmod("source_id", F.lit(50)))
    return rounded(sources.secondary_sources(cat, 0.9).select("catalog", "source_id", "sep_arcmin", "percent"), 4)


def peak_ratio(spark, sf_dir):
    cat = _cat(spark, sf_dir, "cat_ref").withColumn("catalog", F.pmod("source_id", F.lit(50)))
    return rounded(sources.ratio_to_max(cat).select("source_id", "peak_ratio"))


def good_sources(spark, sf_dir):
    cat = sources.good_sources(_cat(spark, sf_dir, "cat_ref"), 150.0, 1e-6, "peak_flux", "e_peak_flux")
    return rounded(cat.groupBy("good").agg(F.count("*").alias("n"), F.sum("peak_flux").alias("peak")), 3)


def region_lines(spark, sf_dir):
    cat = sources.good_sources(_cat(spark, sf_dir, "cat_test"), 150.0, 1e-6, "peak_flux", "e_peak_flux")
    return sources.region_lines(cat.withColumns({"maj": F.lit(BMAJ), "min": F.lit(BMIN), "pa": F.lit(0.0)}))


def source_list(spark, sf_dir):
    cat = _cat(spark, sf_dir, "cat_test").withColumn("good", F.col("peak_flux") > 3)
    return sources.source_list(cat).select("n", "ra", "dec", "peak_flux")


def axis_limits(spark, sf_dir):
    return rounded(stats.axis_limits(_offsets(spark, sf_dir), "d_ra", "d_dec"), 5)


def source_errors(spark, sf_dir):
    cat = _cat(spark, sf_dir, "cat_test")
    e = flux.source_errors(F.lit(9.0), F.lit(7.5), F.pmod("source_id", F.lit(180)).cast("double"), F.lit(BMIN), F.col("total_flux"), F.col("peak_flux"), F.col("e_peak_flux"))
    return rounded(cat.select("source_id", e.alias("e")).select("source_id", "e.e_flux", "e.e_peak", (F.col("e.e_ra") * 3600).alias("e_ra"), (F.col("e.e_dec") * 3600).alias("e_dec")))


def deconvolved(spark, sf_dir):
    cat = _cat(spark, sf_dir, "cat_test")
    size = flux.deconvolve_beam(9.0 + F.pmod("source_id", F.lit(7)), 7.0 + F.pmod("source_id", F.lit(3)), F.pmod("source_id", F.lit(180)).cast("double"), F.lit(BMAJ), F.lit(BMIN), F.lit(30.0))
    return rounded(cat.select("source_id", size.alias("s")).select("source_id", "s.maj", "s.min", "s.n_clipped"), 5)


def sexagesimal(spark, sf_dir):
    return _cat(spark, sf_dir, "cat_test").select("source_id", sky.sexagesimal(F.col("ra"), F.col("dec")).alias("position"))


_GAIN = "sum(x*y/(ey*ey + pow(g{k}.g*ex, 2)))/sum(x*x/(ey*ey + pow(g{k}.g*ex, 2)))"


def _gain_sql() -> str:
    text = "WITH p AS (SELECT peak_flux_1 AS x, peak_flux_2 AS y, e_peak_flux_1 AS ex, e_peak_flux_2 AS ey FROM m), g0 AS (SELECT sum(x*y)/sum(x*x) AS g, FALSE AS done FROM p)"
    for k in range(3):
        text += f", n{k} AS (SELECT {_GAIN.format(k=k)} AS g FROM p, g{k}), g{k + 1} AS (SELECT CASE WHEN g{k}.done THEN g{k}.g ELSE n{k}.g END AS g, g{k}.done OR abs(n{k}.g - g{k}.g) <= 1e-5*abs(g{k}.g) AS done FROM g{k}, n{k})"
    return text + " SELECT (SELECT count(*) FROM p) AS n, R(g) AS gain, TRUE AS weighted FROM g3"


def _r5(x: str) -> str:
    return f"(round({x}, 5) + 0.0)"


_STAT5 = "count(v) AS n, " + ", ".join(f"{_r5(e)} AS {n}" for n, e in (("mean", "avg(v)"), ("std", "stddev_pop(v)"), ("median", "median(v)"), ("p16", "quantile_cont(v, 0.16)"), ("p84", "quantile_cont(v, 0.84)")))
_FRAC = "count(frac) AS n_frac, R(avg(frac)) AS mean_frac, R(stddev_pop(frac)) AS std_frac, R(median(frac)) AS median_frac, R(quantile_cont(frac, 0.16)) AS p16_frac, R(quantile_cont(frac, 0.84)) AS p84_frac"
_F = "WITH f AS (SELECT *, (peak_flux_2 - peak_flux_1)/peak_flux_1 AS frac, peak_flux_2/peak_flux_1 AS ratio FROM m)"
_ELLIPSE = ", ".join(f"{_r5(e)} AS {n}" for n, e in (("x0", "avg(d_ra)"), ("y0", "avg(d_dec)"), ("rx", "greatest(max(d_ra)-avg(d_ra), avg(d_ra)-min(d_ra))"), ("ry", "greatest(max(d_dec)-avg(d_dec), avg(d_dec)-min(d_dec))"), ("sx", "stddev_pop(d_ra)"), ("sy", "stddev_pop(d_dec)")))
_Z = "((c*c+s*s)/n)"
_LINE = ", ".join(f"{_r5(c)} AS {c}" for c in ("slope", "intercept", "slope_err", "intercept_err"))
_UNIT = "cos(radians(dec))*cos(radians(ra)) AS x, cos(radians(dec))*sin(radians(ra)) AS y, sin(radians(dec)) AS z"

QUERIES = {
    "match_one_to_one": (match_one_to_one, matched_sql("SELECT source_id_1, source_id_2, R(sep) AS sep_arcsec FROM m")),
    "match_one_to_many": (match_one_to_many, matched_sql("SELECT source_id_1, source_id_2, R(sep) AS sep_arcsec FROM pairs")),
    "match_summary": (match_summary, matched_sql("""WITH c AS (SELECT count(*) AS n_matches FROM m), a AS (SELECT count(*) AS n_1 FROM cat_ref WHERE ra IS NOT NULL), b AS (SELECT count(*) AS n_2 FROM cat_test WHERE ra IS NOT NULL)
      SELECT n_matches, n_1, n_2, n_1 - n_matches AS unmatched_1, n_2 - n_matches AS unmatched_2 FROM c, a, b""")),
    "unmatched_ref": (unmatched_ref, matched_sql("SELECT source_id FROM cat_ref WHERE ra IS NOT NULL AND source_id NOT IN (SELECT source_id_1 FROM m)")),
    "unmatched_test": (unmatched_test, matched_sql("SELECT source_id FROM cat_test WHERE ra IS NOT NULL AND source_id NOT IN (SELECT source_id_2 FROM m)")),
    "match_jobs": (match_jobs, matched_sql("""WITH p2 AS (SELECT * FROM pairs WHERE source_id_1 % 2 = source_id_2 % 2), n2 AS (SELECT * FROM (SELECT source_id_1, source_id_2, sep, row_number() OVER (PARTITION BY source_id_1 ORDER BY sep, source_id_2) AS j FROM p2) AS t WHERE j = 1),
      m2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id_2 ORDER BY sep, source_id_1) AS j2 FROM n2) AS t WHERE j2 = 1) SELECT 'job' || CAST(source_id_1 % 2 AS VARCHAR) AS job_id, count(*) AS n FROM m2 GROUP BY 1""")),
    "nearest_any": (nearest_any, sql(f"""WITH a AS (SELECT source_id, {_UNIT} FROM cat_ref WHERE ra IS NOT NULL), b AS (SELECT {_UNIT} FROM cat_test WHERE ra IS NOT NULL)
      SELECT a.source_id AS source_id_1, round(degrees(2*asin(least(1.0, sqrt(min((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)))/2)))*3600, 3) AS sep_arcsec FROM a, b GROUP BY 1""", "cat_ref", "cat_test")),
    "frac_summary": (frac_summary, matched_sql(_F + f", md AS (SELECT median(ratio) AS md FROM f) SELECT {_FRAC}, count(ratio) AS n_ratio, R(median(ratio)) AS median_ratio, R(1.4826*median(abs(ratio - md))) AS nmad_ratio FROM f, md")),
    "nmad": (nmad, matched_sql(_F + ", md AS (SELECT median(ratio) AS md FROM f) SELECT count(ratio) AS n, R(median(ratio)) AS median, R(1.4826*median(abs(ratio - md))) AS nmad FROM f, md")),
    "flux_report": (flux_report, matched_sql(f"""WITH l AS (SELECT 'peak_flux' AS flux_type, peak_flux_1 AS r, peak_flux_2 AS t FROM m UNION ALL SELECT 'total_flux', total_flux_1, total_flux_2 FROM m),
      f AS (SELECT flux_type, (t - r)/r AS frac, t/r AS ratio FROM l), md AS (SELECT flux_type, median(ratio) AS md FROM f GROUP BY 1)
      SELECT flux_type, {_FRAC}, count(ratio) AS n_ratio, R(median(ratio)) AS median_ratio, R(1.4826*median(abs(ratio - md))) AS nmad_ratio FROM f JOIN md USING (flux_type) GROUP BY flux_type""")),
    "offsets": (offsets, matched_sql(_OFFSETS + f" SELECT source_id_1, {_r5('d_ra')} AS d_ra, {_r5('d_dec')} AS d_dec, {_r5('phi')} AS phi, {_r5('rho_bmaj')} AS rho_bmaj FROM q")),
    "offset_stats": (offset_stats, matched_sql(_OFFSETS + ", l AS (" + " UNION ALL ".join(f"SELECT '{q}' AS quantity, {q} AS v FROM q" for q in _QUANTITIES) + f") SELECT quantity, {_STAT5} FROM l GROUP BY quantity")),
    "rho_summary": (rho_summary, matched_sql(_OFFSETS + f" SELECT {_r5('median(rho_bmaj)')} AS median, {_r5('quantile_cont(rho_bmaj, 0.84)')} AS p84 FROM q")),
    "circular": (circular, matched_sql(_OFFSETS + f""", g AS (SELECT source_id_1 % 4 AS part, count(theta) AS n, sum(cos(radians(theta))) AS c, sum(sin(radians(theta))) AS s FROM q GROUP BY 1),
      t AS (SELECT part, n, sqrt(c*c+s*s)/n AS r, (degrees(atan2(s, c)) + 360) % 360 AS mean_deg, greatest(0.0, least(1.0, exp(-{_Z})*(1 + (2*{_Z} - {_Z}*{_Z})/(4*n) - (24*{_Z} - 132*{_Z}*{_Z} + 76*pow({_Z},3) - 9*pow({_Z},4))/(288.0*n*n)))) AS p FROM g)
      SELECT part, n, {_r5('r')} AS r, {_r5('mean_deg')} AS mean_deg, {_r5('p')} AS p, CASE WHEN p <= 0.01 THEN 'directional' WHEN p <= 0.05 THEN 'weak' ELSE 'uniform' END AS verdict FROM t""")),
    "harmonic": (harmonic, matched_sql(_OFFSETS + ", pts AS (SELECT source_id_1 % 4 AS part, phi, d_ra AS y FROM q)" + harmonic_sql("pts", "part", 5))),
    "ellipse": (ellipse, matched_sql(_OFFSETS + f" SELECT {_ELLIPSE} FROM q")),
    "astrometry_overlays": (astrometry_overlays, matched_sql(_OFFSETS + f", s AS (SELECT 'main' AS series, d_ra, d_dec FROM q UNION ALL SELECT 'scan' || CAST(source_id_1 % 3 AS VARCHAR), d_ra, d_dec FROM q) SELECT series, {_ELLIPSE} FROM s GROUP BY series")),
    "gain_origin": (gain_origin, matched_sql(_gain_sql())),
    "linreg_weighted": (linreg_weighted, matched_sql(f"""WITH p AS (SELECT source_id_1 % 3 AS part, peak_flux_1 AS x, peak_flux_2 AS y, 1/(e_peak_flux_2*e_peak_flux_2) AS w FROM m),
      s AS (SELECT part, count(*) AS n, sum(w) AS s, sum(w*x) AS sx, sum(w*y) AS sy, sum(w*x*x) AS sxx, sum(w*x*y) AS sxy FROM p GROUP BY part),
      l AS (SELECT *, s*sxx - sx*sx AS det, (s*sxy - sx*sy)/(s*sxx - sx*sx) AS slope FROM s), i AS (SELECT *, (sy - slope*sx)/s AS intercept FROM l),
      v AS (SELECT i.part, sum(w*pow(y - intercept - slope*x, 2))/greatest(max(n) - 2, 1) AS var FROM p JOIN i USING (part) GROUP BY i.part)
      SELECT part, n, {_r5('slope')} AS slope, {_r5('intercept')} AS intercept, {_r5('sqrt(var*s/det)')} AS slope_err, {_r5('sqrt(var*sxx/det)')} AS intercept_err FROM i JOIN v USING (part)""")),
    "mad_inliers": (mad_inliers, matched_sql(_F + ", md AS (SELECT median(ratio) AS md FROM f), sc AS (SELECT 1.4826*median(abs(ratio - md)) AS sc FROM f, md) SELECT abs(ratio - md)/sc <= 2.0 AS inlier, count(*) AS n FROM f, md, sc GROUP BY 1")),
    "huber_fit": (huber_fit, matched_sql("WITH p AS (SELECT source_id_1 AS id, source_id_1 % 2 AS part, peak_flux_1 AS x, peak_flux_2 AS y, pow(greatest(e_peak_flux_2, 1e-8), -2.0) AS base FROM m)"
      + huber_sql("p", "part", "h") + f" SELECT part, n, {_LINE} FROM h_fit")),
    "flux_fit": (flux_fit, matched_sql(f"""WITH p AS (SELECT source_id_1 AS id, 0 AS part, peak_flux_1 AS x, peak_flux_2 AS y, 1.0::DOUBLE AS base FROM m), mid AS (SELECT median(x) AS mx, median(y) AS my FROM p),
      sc AS (SELECT 1.4826*median(abs(x - mx)) AS sx, 1.4826*median(abs(y - my)) AS sy FROM p, mid), q AS (SELECT p.* FROM p, mid, sc WHERE abs(x - mx)/sx <= 4 AND abs(y - my)/sy <= 4)"""
      + huber_sql("q", "part", "g") + huber_sql("g_in", "part", "h") + f" SELECT (SELECT count(*) FROM p) AS n, n AS n_inlier, (SELECT count(*) FROM p) - n AS n_outlier, {_LINE} FROM h_fit")),
    "scan_fracdiff": (scan_fracdiff, matched_sql(_F + " SELECT source_id_1 % 5 AS scan_id, count(frac) AS n, R(avg(frac)) AS mean, R(stddev_pop(frac)) AS std FROM f GROUP BY 1")),
    "fracdiff_hist": (fracdiff_hist, matched_sql(_F + " SELECT source_id_1 % 2 AS series, CAST(least(floor((frac + 1)/(2.0/59)), 58) AS BIGINT) AS bin, count(*) AS n FROM f WHERE frac BETWEEN -1 AND 1 GROUP BY 1, 2")),
    "pair_offsets": (pair_offsets, matched_sql("WITH d AS (SELECT source_id_1 % 3 AS pair, (ra_2-ra_1)*cos(radians(dec_1))*3600 AS d_ra, (dec_2-dec_1)*3600 AS d_dec, sep AS sep_arcsec FROM pairs) SELECT pair, " + ", ".join(f"{_r5(e.format(c))} AS {n}_{c}" for c in ("d_ra", "d_dec", "sep_arcsec") for n, e in (("avg", "avg({})"), ("std", "stddev_pop({})"), ("rms", "sqrt(avg({0}*{0}))"))) + " FROM d GROUP BY pair")),
    "survey_offset_stats": (survey_offset_stats, matched_sql(f"WITH d0 AS (SELECT source_id_1 % 3 AS mode, (ra_2-ra_1)*cos(radians(dec_1))*3600 AS d_ra, (dec_2-dec_1)*3600 AS d_dec FROM m), d AS (SELECT *, d_ra/{BMAJ} AS d_ra_beam, d_dec/{BMAJ} AS d_dec_beam FROM d0) SELECT mode, " + ", ".join(f"{_r5(f'{f}({c})')} AS {n}_{c}" for c in ("d_ra", "d_dec", "d_ra_beam", "d_dec_beam") for n, f in (("mean", "avg"), ("std", "stddev_pop"))) + " FROM d GROUP BY mode")),
    "rotation_check": (rotation_check, matched_sql(f"""WITH w AS (SELECT *, source_id_1 % 2 AS pair, avg(dec_1) OVER (PARTITION BY source_id_1 % 2) AS md FROM m),
      l AS (SELECT pair, 1 AS cat_no, xposn_1 AS x, yposn_1 AS y, degrees(atan2(dec_1-dec_2, (ra_1-ra_2)*cos(radians(md)))) AS theta FROM w UNION ALL SELECT pair, 2, xposn_2, yposn_2, degrees(atan2(dec_1-dec_2, (ra_1-ra_2)*cos(radians(md)))) FROM w),
      a AS (SELECT *, degrees(atan2(y-{Y0}, x-{X0})) AS phi0 FROM l)
      SELECT pair, cat_no, count(*) AS n, round(avg(CASE WHEN phi0 < -90 THEN phi0 + 360 ELSE phi0 END), 4) + 0.0 AS phi, round(avg(sqrt(pow(x-2048,2)+pow(y-2048,2))), 4) + 0.0 AS radius, round(avg(abs(theta)), 4) + 0.0 AS theta FROM a GROUP BY 1, 2""")),
    "brightest2": (brightest2, sql("SELECT catalog, rank, source_id, R(peak_flux) AS peak_flux FROM (SELECT source_id % 50 AS catalog, source_id, peak_flux, CAST(row_number() OVER (PARTITION BY source_id % 50 ORDER BY peak_flux DESC, source_id) AS INTEGER) AS rank FROM cat_ref WHERE ra IS NOT NULL) AS t WHERE rank <= 2", "cat_ref")),
    "secondary": (secondary, sql("""WITH c AS (SELECT *, source_id % 50 AS catalog FROM cat_ref WHERE ra IS NOT NULL), t AS (SELECT catalog, first(ra ORDER BY peak_flux DESC, source_id) AS ra0, first(dec ORDER BY peak_flux DESC, source_id) AS dec0, max(peak_flux) AS p0 FROM c GROUP BY 1)
      SELECT catalog, source_id, round(degrees(atan2(sqrt(pow(cos(radians(dec))*sin(radians(ra-ra0)),2)+pow(cos(radians(dec0))*sin(radians(dec))-sin(radians(dec0))*cos(radians(dec))*cos(radians(ra-ra0)),2)), sin(radians(dec0))*sin(radians(dec))+cos(radians(dec0))*cos(radians(dec))*cos(radians(ra-ra0))))*60, 4) + 0.0 AS sep_arcmin,
      round(100*peak_flux/p0, 4) + 0.0 AS percent FROM c JOIN t USING (catalog) WHERE peak_flux > 0.9*p0""", "cat_ref")),
    "peak_ratio": (peak_ratio, sql("SELECT source_id, R(peak_flux/max(peak_flux) OVER (PARTITION BY source_id % 50)) AS peak_ratio FROM cat_ref", "cat_ref")),
    "good_sources": (good_sources, sql("SELECT peak_flux/e_peak_flux > 150 AND e_peak_flux > 1e-6 AS good, count(*) AS n, round(sum(peak_flux), 3) + 0.0 AS peak FROM cat_ref GROUP BY 1", "cat_ref")),
    "region_lines": (region_lines, sql(f"""SELECT good, printf('fk5;ellipse(%.7f,%.7f,%.3f",%.3f",%.2f) # color=%s', ra, dec, {BMAJ}::DOUBLE, {BMIN}::DOUBLE, 0.0::DOUBLE, CASE WHEN good THEN 'green' ELSE 'red' END) AS value FROM (SELECT *, peak_flux/e_peak_flux > 150 AND e_peak_flux > 1e-6 AS good FROM cat_test) AS t""", "cat_test")),
    "source_list": (source_list, sql("SELECT row_number() OVER (ORDER BY floor(ra*10), ra, source_id) AS n, round(ra, 6) AS ra, round(dec, 6) AS dec, round(peak_flux, 6) AS peak_flux FROM cat_test WHERE peak_flux > 3", "cat_test")),
    "axis_limits": (axis_limits, matched_sql(_OFFSETS + f" SELECT {_r5('1.05*greatest(max(abs(d_ra)), max(abs(d_dec)))')} AS \"limit\" FROM q")),
    "source_errors": (source_errors, sql(f"""WITH r AS (SELECT *, radians(CAST(source_id % 180 AS DOUBLE)) AS pa, sqrt(pi()/(8*ln(2.0))*9.0*7.5/({BMIN}*{BMIN}/4)*peak_flux*peak_flux/(e_peak_flux*e_peak_flux)) AS rho FROM cat_test)
      SELECT source_id, R(sqrt(2.0)*total_flux/rho) AS e_flux, R(sqrt(2.0)*peak_flux/rho) AS e_peak, R(sqrt(9.0/rho/(4*ln(2.0))*pow(sin(pa),2) + 7.5/rho/(4*ln(2.0))*pow(cos(pa),2))) AS e_ra, R(sqrt(9.0/rho/(4*ln(2.0))*pow(cos(pa),2) + 7.5/rho/(4*ln(2.0))*pow(sin(pa),2))) AS e_dec FROM r""", "cat_test")),
    "deconvolved": (deconvolved, sql(f"""WITH c AS (SELECT source_id, 9.0::DOUBLE + source_id % 7 AS p, 7.0::DOUBLE + source_id % 3 AS q, radians(2*((source_id % 180) - 30.0::DOUBLE)) AS tw, {BMAJ}::DOUBLE AS bp, {BMIN}::DOUBLE AS bq FROM cat_test),
      v AS (SELECT *, p*p - q*q AS src, bp*bp - bq*bq AS beam, (p*p + q*q - bp*bp - bq*bq)/2 AS mean FROM c),
      h AS (SELECT *, sqrt(src*src + beam*beam - 2*src*beam*cos(tw))/2 AS half FROM v)
      SELECT source_id, {_r5('sqrt(greatest(mean + half, 0))')} AS maj, {_r5('sqrt(greatest(mean - half, 0))')} AS min, CAST(mean + half < 0 AS INTEGER) + CAST(mean - half < 0 AS INTEGER) AS n_clipped FROM h""", "cat_test")),
    "sexagesimal": (sexagesimal, sql("""WITH c AS (SELECT source_id, dec, round(((ra % 360) + 360) % 360 / 15 * 36000000)::BIGINT % 864000000 AS t, round(abs(dec) * 36000000)::BIGINT AS d FROM cat_test)
      SELECT source_id, printf('%02d:%02d:%07.4f, ', t // 36000000, t % 36000000 // 600000, (t % 600000)/10000.0::DOUBLE) || CASE WHEN dec < 0 THEN '-' ELSE '' END || printf('%02d:%02d:%07.4f', d // 36000000, d % 36000000 // 600000, (d % 600000)/10000.0::DOUBLE) AS position FROM c""", "cat_test")),
}
