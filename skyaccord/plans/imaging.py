"""Queries over image pixels and source spectra."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyaccord.functions import flux, headers
from skyaccord.operators import fit, image, sources, stats
from skyaccord.plans.common import rounded9 as rounded
from skyaccord.plans.common import sql9 as sql
from skyaccord.plans.fixtures import view


def _pixels(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "pixels")


def _sed(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "sed_points")


def image_qa(spark, sf_dir):
    return rounded(image.image_qa(_pixels(spark, sf_dir)))


def plane_stats(spark, sf_dir):
    return rounded(image.plane_stats(_pixels(spark, sf_dir)))


def peak_and_rms(spark, sf_dir):
    return rounded(image.peak_and_rms(_pixels(spark, sf_dir)))


def mode_stats(spark, sf_dir):
    per_plane = image.plane_stats(_pixels(spark, sf_dir), 1).withColumn("mode", F.pmod("image_id", F.lit(3)))
    return rounded(image.mode_stats(per_plane))


def _robust(rule):
    def query(spark, sf_dir):
        return rounded(image.robust_image_stats(_pixels(spark, sf_dir), rule), 9)

    return query


def selected_planes(spark, sf_dir):
    pixels = _pixels(spark, sf_dir)
    # The first and the last plane of each image, named by its own plane numbers.
    roles = pixels.agg(F.min("plane").alias("low")).select(F.explode(F.array(F.struct(F.lit("low").alias("role"), F.col("low").alias("plane")), F.struct(F.lit("high").alias("role"), F.lit(-1).alias("plane")))).alias("x")).select("x.*")
    return rounded(image.select_planes(pixels, roles).groupBy("image_id", "role").agg(F.count("*").alias("n"), F.sum("value").alias("total")))


def sed_slope(spark, sf_dir):
    return rounded(fit.sed_summary(_sed(spark, sf_dir)), 9)


def curved_sed(spark, sf_dir):
    return rounded(fit.curved_power_law(_sed(spark, sf_dir)), 4)


def lin_pol(spark, sf_dir):
    p, angle = flux.lin_pol(F.col("q_peak"), F.col("u_peak"))
    rows = _sed(spark, sf_dir).withColumns({"p": p, "pa": angle})
    return rounded(rows.groupBy("source_id").agg(F.count("*").alias("n"), F.avg("p").alias("p"), F.max("p").alias("p_max")), 9)


def pol_summary(spark, sf_dir):
    p, angle = flux.lin_pol(F.round("q_peak", 6) + 0.0, F.round("u_peak", 6) + 0.0)
    rows = _sed(spark, sf_dir).withColumns({"p": p, "pa": angle})
    return rounded(rows.groupBy("freq_hz").agg(F.avg("p").alias("mean_p"), F.stddev_pop("p").alias("std_p"), F.avg("pa").alias("mean_pa")), 4)


def pb_corrected(spark, sf_dir):
    gain = flux.primary_beam_gain(F.pmod("source_id", F.lit(10)) * 0.02, F.col("freq_hz"))
    rows = _sed(spark, sf_dir).withColumn("corrected", F.try_divide(F.col("i_peak"), gain))
    return rounded(rows.groupBy("source_id").agg(F.avg("corrected").alias("corrected")), 11)


def sed_compare(spark, sf_dir):
    """Two halves of each source's points side by side by frequency, missing ones null."""
    rows = _sed(spark, sf_dir).groupBy("source_id", "freq_hz").agg(F.avg("i_peak").alias("i_peak"))
    half = F.pmod((F.col("freq_hz") / 1e8).cast("long") + F.col("source_id"), F.lit(3))
    keyed = rows.withColumns({"half": half, "key": F.concat_ws("@", F.col("source_id").cast("string"), F.col("freq_hz").cast("long").cast("string"))})
    both = sources.zip_full(keyed.filter("half < 2").select("key", "i_peak"), keyed.filter("half > 0").select("key", "i_peak"), "key")
    return rounded(both, 11)


def last_wins(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("ord")).agg(F.max("l_extendedprice").alias("freq_hz"))
    return rounded(sources.last_wins(lines), 3)


def auto_bins(spark, sf_dir):
    return _pixels(spark, sf_dir).groupBy("image_id").agg(stats.auto_bins(F.count("value")).cast("long").alias("bins"))


def header_frequencies(spark, sf_dir):
    """Frequencies that headers and names made of the parts table tell."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey")
    key = F.col("p_partkey")
    header = F.when(key % 3 == 0, F.create_map(F.lit("RESTFRQ"), (key * 1000).cast("string"))).when(key % 3 == 1, F.create_map(F.lit("CTYPE1"), F.lit("FREQ-LSR"), F.lit("CRVAL1"), (key * 10).cast("string"))).otherwise(F.create_map(F.lit("BUNIT"), F.lit("Jy/beam")))
    path = F.concat(F.lit("/data/img_"), (900 + key % 800).cast("string"), F.lit("MHz_"), key.cast("string"), F.lit(".fits"))
    null = F.lit(None).cast("double")
    return rounded(parts.select("p_partkey", headers.resolve_frequency(null, null, null, header, path).alias("freq_hz"), headers.stem(path).alias("stem")), 3)


def noise_model(spark, sf_dir):
    """Expected noise and time to ten sigma for every point of the spectra."""
    rows = _sed(spark, sf_dir).groupBy("source_id").agg(F.max("i_peak").alias("flux"), F.count("*").alias("n"))
    rms = flux.thermal_rms(F.lit(64.0), F.col("n") * 600.0)
    return rounded(rows.select("source_id", (rms * 1e6).alias("rms_ujy"), (flux.seconds_to_snr(F.col("flux"), F.lit(64.0)) * 1e6).alias("microseconds")), 4)


_STD = "count(*) AS n_total, count(value) AS n_finite, R(min(value)) AS min, R(max(value)) AS max, R(avg(value)) AS mean, R(stddev_pop(value)) AS std, R(median(value)) AS median, R(quantile_cont(value, 0.05)) AS p5, R(quantile_cont(value, 0.95)) AS p95, R(quantile_cont(value, 0.99)) AS p99"
_CLASSIC = "count(value) AS n, round(avg(value), 9) + 0.0 AS mean, round(stddev_samp(value), 9) + 0.0 AS sigma, round(median(value), 9) + 0.0 AS median"
def _chauvenet_sql(rounds: int = 3) -> str:
    """Each round in its own table: limits from the rows left, then the rows within them."""
    text = "WITH r0 AS (SELECT image_id, value FROM pixels WHERE value IS NOT NULL)"
    for k in range(rounds):
        text += f", l{k} AS (SELECT image_id, avg(value) AS m, stddev_samp(value) AS s, sqrt(-2*ln(1/(4.0*count(*)))) AS t FROM r{k} GROUP BY 1)"
        text += f", r{k + 1} AS (SELECT r.image_id, value FROM r{k} AS r JOIN l{k} USING (image_id) WHERE coalesce(abs(value - m) <= s*(t - (2.515517 + 0.802853*t + 0.010328*t*t)/(1 + 1.432788*t + 0.189269*t*t + 0.001308*t*t*t)), TRUE))"
    return sql(f"{text} SELECT image_id, {_CLASSIC} FROM r{rounds} GROUP BY 1", "pixels")


def _solve(m: str, r: str) -> list[str]:
    """Cramer's rule for a symmetric 3 x 3 system with columns {m}00 to {m}22 and {r}0 to {r}2."""
    a, b, c, d, e, f = (f"{m}{k}" for k in ("00", "01", "02", "11", "12", "22"))
    x, y, z = (f"{r}{k}" for k in range(3))
    det = f"({a}*({d}*{f} - {e}*{e}) - {b}*({b}*{f} - {c}*{e}) + {c}*({b}*{e} - {c}*{d}))"
    tops = (f"{x}*({d}*{f} - {e}*{e}) - {b}*({y}*{f} - {e}*{z}) + {c}*({y}*{e} - {d}*{z})", f"{a}*({y}*{f} - {z}*{e}) - {x}*({b}*{f} - {c}*{e}) + {c}*({b}*{z} - {y}*{c})", f"{a}*({d}*{z} - {e}*{y}) - {b}*({b}*{z} - {y}*{c}) + {x}*({b}*{e} - {c}*{d})")
    return [f"({t})/CASE WHEN abs({det}) > 1e-300 THEN {det} END" for t in tops]


def _curved_sql(steps: int = 6) -> str:
    """A parabola in the logarithms, then Gauss-Newton steps, each in its own table."""
    def sums(basis: tuple[str, str, str], right: str) -> str:
        return ", ".join([f"sum(({basis[i]})*({basis[j]})) AS m{i}{j}" for i in range(3) for j in range(i, 3)] + [f"sum(({b})*({right})) AS r{i}" for i, b in enumerate(basis)])

    x, y, z = _solve("m", "r")
    text = f"""WITH g AS (SELECT source_id, freq_hz AS nu, i_peak AS s FROM sed_points WHERE freq_hz > 0 AND i_peak > 0), k AS (SELECT source_id, min(nu) AS nu0, count(*) AS n FROM g GROUP BY 1),
  p AS MATERIALIZED (SELECT source_id, s, ln(nu/nu0) AS l FROM g JOIN k USING (source_id) WHERE n >= 3), s0 AS (SELECT source_id, {sums(('1.0', 'l', 'l*l'), 'ln(s)')} FROM p GROUP BY 1),
  f0 AS MATERIALIZED (SELECT source_id, exp({x}) AS a, {y} AS b, {z} AS c, CAST(NULL AS DOUBLE) AS moved FROM s0)"""
    for i in range(steps):
        text += f""", q{i} AS (SELECT source_id, l, s, a, a*exp(l*(b + c*l)) AS y FROM p JOIN f{i} USING (source_id)), s{i + 1} AS (SELECT source_id, {sums(('y/a', 'y*l', 'y*l*l'), 's - y')} FROM q{i} GROUP BY 1),
  f{i + 1} AS MATERIALIZED (SELECT source_id, a + dx AS a, b + dy AS b, c + dz AS c, abs(dx/a) AS moved FROM f{i} JOIN (SELECT source_id, {x} AS dx, {y} AS dy, {z} AS dz FROM s{i + 1}) AS d USING (source_id))"""
    rounds = ", ".join(f"round(CASE WHEN moved < 0.01 THEN {v} END, 4) + 0.0 AS {v}" for v in "abc")
    return sql(f"{text} SELECT source_id, n, {rounds} FROM k LEFT JOIN f{steps} USING (source_id)", "sed_points")


_PB = "1.18896*radians((source_id % 10)*0.02)/(0.0167261*1.5e9/freq_hz)"

QUERIES = {
    "image_qa": (image_qa, sql(f"""WITH a AS (SELECT image_id, {_STD} FROM pixels GROUP BY 1), md AS (SELECT image_id, median(value) AS m, max(value) AS mx FROM pixels GROUP BY 1),
      d AS (SELECT image_id, median(abs(value - m)) AS mad, max(mx) AS mx FROM pixels JOIN md USING (image_id) GROUP BY 1)
      SELECT a.*, R(mad) AS mad, R(1.4826*mad) AS robust_rms, n_total - n_finite AS n_blank, R((n_total - n_finite)/n_total) AS blank_frac, R(mx/(1.4826*mad)) AS dynamic_range FROM a JOIN d USING (image_id)""", "pixels")),
    "plane_stats": (plane_stats, sql("SELECT image_id, plane, count(value) AS n, R(max(value)) AS max, R(min(value)) AS min, R(avg(value)) AS mean, R(sqrt(avg(value*value))) AS rms, R(stddev_samp(value)) AS sigma FROM pixels WHERE plane >= 2 GROUP BY 1, 2", "pixels")),
    "peak_and_rms": (peak_and_rms, sql("SELECT image_id, R(max(value)) AS peak, R(sqrt(avg(value*value))) AS rms FROM pixels GROUP BY 1", "pixels")),
    "mode_stats": (mode_stats, sql("WITH p AS (SELECT image_id % 3 AS mode, max(value) AS max, min(value) AS min, avg(value) AS mean, sqrt(avg(value*value)) AS rms FROM pixels GROUP BY image_id, plane) SELECT mode, " + ", ".join(f"R({f}({c})) AS {n}_{c}" for c in ("rms", "mean", "max", "min") for n, f in (("avg", "avg"), ("std", "stddev_pop"))) + " FROM p GROUP BY mode", "pixels")),
    "robust_classic": (_robust("classic"), sql(f"SELECT image_id, {_CLASSIC} FROM pixels WHERE value IS NOT NULL GROUP BY 1", "pixels")),
    "robust_fences": (_robust("hinges-fences"), sql(f"WITH q AS (SELECT image_id, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM pixels GROUP BY 1) SELECT image_id, {_CLASSIC} FROM pixels JOIN q USING (image_id) WHERE value BETWEEN a - 1.5*(b - a) AND b + 1.5*(b - a) GROUP BY 1", "pixels")),
    "robust_chauvenet": (_robust("chauvenet"), _chauvenet_sql()),
    "robust_fit_half": (_robust("fit-half"), sql(f"SELECT image_id, {_CLASSIC} FROM (SELECT image_id, value FROM pixels WHERE value <= 0 UNION ALL SELECT image_id, -value FROM pixels WHERE value <= 0) AS p GROUP BY 1", "pixels")),
    "robust_biweight": (_robust("biweight"), sql("""WITH c AS (SELECT image_id, median(value) AS m FROM pixels GROUP BY 1), o AS (SELECT image_id, value - m AS d, m FROM pixels JOIN c USING (image_id) WHERE value IS NOT NULL), s AS (SELECT image_id, median(abs(d)) AS s FROM o GROUP BY 1),
      u AS (SELECT image_id, d, m, d/(6*s) AS u FROM o JOIN s USING (image_id)), w AS (SELECT *, CASE WHEN abs(u) < 1 THEN pow(1 - u*u, 2) ELSE 0 END AS w FROM u)
      SELECT image_id, CAST(sum(CASE WHEN abs(u) < 1 THEN 1 ELSE 0 END) AS BIGINT) AS n, round(any_value(m) + sum(w*d)/sum(w), 9) + 0.0 AS mean,
      round(sqrt(count(*)*sum(CASE WHEN abs(u) < 1 THEN d*d*pow(1 - u*u, 4) END))/abs(sum(CASE WHEN abs(u) < 1 THEN (1 - u*u)*(1 - 5*u*u) END)), 9) + 0.0 AS sigma, round(any_value(m), 9) + 0.0 AS median FROM w GROUP BY 1""", "pixels")),
    "selected_planes": (selected_planes, sql("WITH l AS (SELECT image_id, max(plane) AS hi FROM pixels GROUP BY 1), r AS (SELECT image_id, 'low' AS role, (SELECT min(plane) FROM pixels) AS plane FROM l UNION ALL SELECT image_id, 'high', hi FROM l) SELECT image_id, role, count(*) AS n, R(sum(value)) AS total FROM pixels JOIN r USING (image_id, plane) GROUP BY 1, 2", "pixels")),
    "sed_slope": (sed_slope, sql("SELECT source_id, count(*) AS n, " + ", ".join(f"round({e}, 9) + 0.0 AS {n}" for n, e in (("median_i", "median(i_peak)"), ("std_i", "stddev_pop(i_peak)"), ("alpha", "regr_slope(log10(i_peak), log10(freq_hz))"), ("median_v", "median(v_peak)"), ("std_v", "stddev_pop(v_peak)"))) + " FROM sed_points WHERE i_peak > 0 GROUP BY 1", "sed_points")),
    "curved_sed": (curved_sed, _curved_sql()),
    "lin_pol": (lin_pol, sql("SELECT source_id, count(*) AS n, round(avg(sqrt(q_peak*q_peak+u_peak*u_peak)), 9) + 0.0 AS p, round(max(sqrt(q_peak*q_peak+u_peak*u_peak)), 9) + 0.0 AS p_max FROM sed_points GROUP BY 1", "sed_points")),
    "pol_summary": (pol_summary, sql("WITH s AS (SELECT freq_hz, round(q_peak, 6) + 0.0 AS q, round(u_peak, 6) + 0.0 AS u FROM sed_points) SELECT freq_hz, round(avg(sqrt(q*q+u*u)), 4) + 0.0 AS mean_p, round(stddev_pop(sqrt(q*q+u*u)), 4) + 0.0 AS std_p, round(avg(degrees(atan2(u, q))/2), 4) + 0.0 AS mean_pa FROM s GROUP BY 1", "sed_points")),
    "pb_corrected": (pb_corrected, sql(f"SELECT source_id, round(avg(i_peak/pow(cos(pi()*{_PB})/(1 - 4*{_PB}*{_PB}), 2)), 11) + 0.0 AS corrected FROM sed_points GROUP BY 1", "sed_points")),
    "sed_compare": (sed_compare, sql("""WITH r AS (SELECT source_id, freq_hz, avg(i_peak) AS i, (CAST(freq_hz/1e8 AS BIGINT) + source_id) % 3 AS h FROM sed_points GROUP BY 1, 2), k AS (SELECT CAST(source_id AS VARCHAR) || '@' || CAST(CAST(freq_hz AS BIGINT) AS VARCHAR) AS key, i, h FROM r)
      SELECT key, round(a.i, 11) + 0.0 AS i_peak_1, round(b.i, 11) + 0.0 AS i_peak_2 FROM (SELECT * FROM k WHERE h < 2) AS a FULL JOIN (SELECT * FROM k WHERE h > 0) AS b USING (key)""", "sed_points")),
    "last_wins": (last_wins, "WITH l AS (SELECT l_orderkey AS path, l_linenumber AS ord, max(l_extendedprice) AS f FROM lineitem GROUP BY 1, 2) SELECT path, round(arg_max(f, ord), 3) + 0.0 AS freq_hz, min(ord) AS ord FROM l GROUP BY 1"),
    "auto_bins": (auto_bins, sql("SELECT image_id, CAST(2*floor(sqrt(count(value))) AS BIGINT) AS bins FROM pixels GROUP BY 1", "pixels")),
    "header_frequencies": (header_frequencies, "SELECT p_partkey, round(CAST(CASE WHEN p_partkey % 3 = 0 THEN p_partkey*1000 WHEN p_partkey % 3 = 1 THEN p_partkey*10 ELSE (900 + p_partkey % 800)*1000000 END AS DOUBLE), 3) + 0.0 AS freq_hz, 'img_' || CAST(900 + p_partkey % 800 AS VARCHAR) || 'MHz_' || CAST(p_partkey AS VARCHAR) AS stem FROM part"),
    "noise_model": (noise_model, sql("WITH s AS (SELECT source_id, max(i_peak) AS f, count(*) AS n FROM sed_points GROUP BY 1) SELECT source_id, round(1e6*443.5/sqrt(2*64*63*856e6*n*600.0), 4) + 0.0 AS rms_ujy, round(1e6*pow(10*443.5/f, 2)/(64*63*856e6), 4) + 0.0 AS microseconds FROM s", "sed_points")),
}
