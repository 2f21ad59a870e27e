"""Queries over column functions and small list operators that no report holds on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyaccord.functions import flux, headers, sky
from skyaccord.operators import clean, fit, image, match, sources, vis
from skyaccord.plans.common import matched, matched_sql, rounded, sql
from skyaccord.plans.fixtures import view


def _read(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def coordinate_units(spark, sf_dir):
    """Right ascensions read as every unit, and a column that the table lacks."""
    cat = view(spark, sf_dir, "cat_ref")
    units = {f"from_{u or 'none'}": sky.to_degrees(F.col("ra"), u) for u in (None, "deg", "arcmin", "arcsec", "rad", "hourangle")}
    lacking = {"absent": clean.col_or_null(cat, "e_ra"), "present": clean.col_or_null(cat, "xposn")}
    return rounded(cat.select("source_id", *[c.alias(n) for n, c in (units | lacking).items()]))


def positive_points(spark, sf_dir):
    """Points whose two polarised fluxes are finite and positive."""
    points = clean.finite_positive(view(spark, sf_dir, "sed_points"), "v_peak", "q_peak")
    return rounded(points.groupBy("source_id").agg(F.count("*").alias("n"), F.sum("v_peak").alias("v"), F.sum("q_peak").alias("q")))


def pair_geometry(spark, sf_dir):
    """Offsets with the mean declination's cosine, raw offset angles, and flat distance differences, of every match."""
    m = matched(spark, sf_dir)
    east, north = sky.offsets_mid(F.col("ra_1"), F.col("dec_1"), F.col("ra_2"), F.col("dec_2"))
    raw = sky.offset_angle_raw(F.col("ra_1"), F.col("dec_1"), F.col("ra_2"), F.col("dec_2"))
    diff = sky.flat_sep_diff(F.col("ra_1"), F.col("dec_1"), F.col("ra_2"), F.col("dec_2"), F.col("ra_2") + 0.001, F.col("dec_2"))
    return rounded(m.select("source_id_1", east.alias("east"), north.alias("north"), raw.alias("raw_angle"), diff.alias("sep_diff")), 5)


def polarisation_fractions(spark, sf_dir):
    """Fractional polarisation with its error, and amplitude and phase of (q, u), of every point."""
    points = view(spark, sf_dir, "sed_points").filter("abs(q_peak) + abs(u_peak) > 1e-9 AND i_peak > 0")
    p, error = flux.frac_pol(F.col("q_peak"), F.col("u_peak"), F.col("i_peak"), F.lit(0.001), F.lit(0.002))
    amp, _ = flux.amp_phase(F.col("q_peak"), F.col("u_peak"))
    _, phase = flux.amp_phase(F.round("q_peak", 6), F.round("u_peak", 6))
    rows = points.select("source_id", "freq_hz", p.alias("p"), error.alias("e_p"), amp.alias("amp"), F.abs(phase).alias("phase"))
    return rounded(rows.groupBy("source_id").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in ("p", "e_p", "amp", "phase")]))


def model_values(spark, sf_dir):
    """Spectral models, a straight line, relative bandwidth and position noise at every point."""
    f, s = F.col("freq_hz") / 1e9, F.col("i_peak")
    width, span = flux.frac_bandwidth(F.col("freq_hz"), F.col("freq_hz") * 1.25, F.col("freq_hz") * 1.125)
    columns = {
        "power": flux.power_law(f, s, F.lit(-0.7)), "curved": flux.curved_power_law(f, F.lit(0.9), s, F.lit(-0.6), F.lit(0.1)), "log_line": flux.log_line(F.col("freq_hz"), F.lit(-0.5), F.lit(2.0)),
        "line": flux.line(f, F.lit(2.5), s), "calibrator": flux.flux_model(F.col("freq_hz")), "width": width, "span_mhz": span, "position_rms": flux.position_rms(F.lit(7.68), F.lit(8.94), s, F.lit(0.01)),
        "area": flux.ellipse_area(s, f), "noise": flux.scaled_rms(s, F.lit(64.0), F.lit(600.0)) * 1e6,
    }
    points = view(spark, sf_dir, "sed_points").filter("i_peak > 0").select("source_id", *[c.alias(n) for n, c in columns.items()])
    return rounded(points.groupBy("source_id").agg(*[F.avg(c).alias(c) for c in columns]))


def beam_patterns(spark, sf_dir):
    """Gaussian beam and the even polynomial over its largest value, at the sources' pixels."""
    cat = view(spark, sf_dir, "cat_test").withColumns({"x": F.col("xposn") - 2048, "y": F.col("yposn") - 2048})
    beam = flux.gaussian_pb(F.col("x"), F.col("y"), 1.2, 3600.0)
    rows = image.even_poly_pattern(cat.withColumn("radius", F.hypot("x", "y")), "radius", 0.25)
    return rounded(rows.select("source_id", beam.alias("beam"), "pattern"))


def deconvolved_angle(spark, sf_dir):
    """Position angles of deconvolved sizes."""
    cat = view(spark, sf_dir, "cat_test")
    size = flux.deconvolve_beam(9.0 + F.pmod("source_id", F.lit(7)), 7.0 + F.pmod("source_id", F.lit(2)), F.pmod("source_id", F.lit(180)).cast("double"), F.lit(8.5), F.lit(6.5), F.lit(30.0))
    return rounded(cat.select("source_id", size["pa"].alias("pa")), 5)


def parsed_frequencies(spark, sf_dir):
    """Frequencies from texts in every unit and form; what is none is null."""
    k = F.col("p_partkey")
    text = F.element_at(F.array(
        k.cast("string"), F.concat(k.cast("string"), F.lit(" MHz")), F.concat(k.cast("string"), F.lit("e3kHz")), F.concat(F.lit("+"), k.cast("string"), F.lit(".5 hz")), F.concat(F.lit("-"), k.cast("string"), F.lit("GHz")),
        F.concat(F.lit("."), k.cast("string")), F.concat(k.cast("string"), F.lit(" pc")), F.lit(""),
    ), (k % 8 + 1).cast("int"))
    return rounded(_read(spark, sf_dir, "part").select("p_partkey", headers.parse_frequency(text).alias("freq_hz")), 3)


def name_frequencies(spark, sf_dir):
    """Frequencies from file names in every form."""
    k, n = F.col("p_partkey"), (F.col("p_partkey") % 900 + 50).cast("string")
    path = F.element_at(F.array(
        F.concat(F.lit("/d_1400_/a_"), n, F.lit("~2000MHz.fits")), F.concat(F.lit("img-"), n, F.lit("-1284MHz.fits")), F.concat(F.lit("b_"), n, F.lit(".5mhz_x.fits")), F.concat(F.lit("c_"), n, F.lit("_x.fits")),
        F.concat(F.lit("c_"), n, F.lit(".fits")), F.concat(n, F.lit("_e.fits")), F.concat(F.lit("f-"), n, F.lit(".25-g.fits")),
    ), (k % 7 + 1).cast("int"))
    return rounded(_read(spark, sf_dir, "part").select("p_partkey", headers.freq_from_name(path).alias("mhz")))


def header_cards(spark, sf_dir):
    """Pixel scales, beams and tags of headers made of the parts table."""
    k = F.col("p_partkey")
    cards = F.element_at(F.array(
        F.create_map(F.lit("CDELT2"), (-k / 1e5).cast("string"), F.lit("CDELT1"), F.lit("9")), F.create_map(F.lit("CDELT1"), (k / 1e5).cast("string")),
        F.create_map(F.lit("CD2_1"), (3 * k / 1e5).cast("string"), F.lit("CD2_2"), (4 * k / 1e5).cast("string")), F.create_map(F.lit("BMAJ"), (k / 1e6).cast("string"), F.lit("BMIN"), F.lit("0.001"), F.lit("BPA"), F.lit("x")),
    ), (k % 4 + 1).cast("int"))
    beam = headers.beam_arcsec(cards)
    scan = F.when(k % 3 > 0, k % 3)
    return rounded(_read(spark, sf_dir, "part").select("p_partkey", headers.pixel_scale(cards).alias("scale"), beam["bmaj"].alias("bmaj"), beam["bmin"].alias("bmin"), beam["bpa"].alias("bpa"), headers.image_tag(F.lit("/x/run.ms"), F.lit("low"), scan).alias("tag")), 4)


def named_positions(spark, sf_dir):
    """Coordinates told by source names in both forms."""
    k = F.col("c_custkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("J"), F.format_string("%02d%02d", k % 24, k % 60), F.lit("-"), F.format_string("%02d%02d", k % 90, k % 60))).when(
        k % 3 == 1, F.concat(F.lit("x_J"), F.format_string("%02d%02d%02d", k % 24, k % 60, k % 60), F.lit("+"), F.format_string("%02d%02d%02d", k % 90, k % 60, k % 60))).otherwise(F.lit("PKS"))
    ra, dec = sky.coords_from_name(name)
    return rounded(_read(spark, sf_dir, "customer").select("c_custkey", ra.alias("ra"), dec.alias("dec")))


def _places(df: DataFrame, key: str, name: str) -> DataFrame:
    """Positions spread over the sky by a key."""
    k = F.col(key)
    return df.select(F.concat(F.lit(name), k.cast("string")).alias("name"), (k * 37 % 3600 / F.lit(10.0)).alias("ra"), (k * 53 % 1400 / F.lit(10.0) - 70).alias("dec"))


def calibrators_near(spark, sf_dir):
    """Calibrators within 16 degrees of every target, by theta join on cells of the places that hold any; names that are equal are left out."""
    targets = _places(_read(spark, sf_dir, "customer"), "c_custkey", "s")
    calibrators = _places(_read(spark, sf_dir, "supplier"), "s_suppkey", "s")
    return rounded(match.calibrator_summary(targets, calibrators), 5)


def known_calibrators(spark, sf_dir):
    """Nations known as aliases of listed customers; the last one listed counts."""
    nations = _read(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), "n_nationkey")
    listed = _read(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    calibrators = listed.select(F.concat(F.lit("cal"), F.col("c_custkey").cast("string")).alias("name"), F.lower("name").alias("alias"), F.col("c_custkey").alias("ord"))
    return sources.known_calibrators(nations.select("name"), calibrators)


def files_by_affix(spark, sf_dir):
    """Names with a prefix and a suffix."""
    names = _read(spark, sf_dir, "part").select(F.concat(F.lit("img"), F.col("p_partkey").cast("string"), F.lit(".fits")).alias("path"))
    return clean.by_affix(names, "path", "img1", "7.fits")


def spw_limits(spark, sf_dir):
    """Frequency bounds of windows from their channel lists, and their middle channels."""
    spw = view(spark, sf_dir, "sed_points").groupBy(F.col("source_id").alias("spw")).agg(F.collect_list("freq_hz").alias("chan_freq"))
    return rounded(vis.spw_bounds(spw).join(vis.calibration_channels(spw), "spw"))


def predicted_flux(spark, sf_dir):
    """A straight line through the points of each source, at 1.42 GHz."""
    points = view(spark, sf_dir, "sed_points").withColumn("ghz", F.col("freq_hz") / 1e9)
    several = points.groupBy("source_id").agg(F.count_distinct("ghz").alias("n")).filter("n > 1")
    return rounded(fit.linear_predict(points.join(several, "source_id", "left_semi"), "ghz", "i_peak", 1.42, ["source_id"]), 5)


def millijansky(spark, sf_dir):
    """Fluxes in mJy with sentinel errors restored."""
    cat = view(spark, sf_dir, "cat_test").withColumn("e_ra", F.when(F.col("source_id") % 5 == 0, F.lit(-3600.0)).otherwise(F.col("e_peak_flux")))
    rows = sources.to_millijansky(sources.normalise_sentinels(cat, ["e_ra"]), ["peak_flux", "total_flux"], 1.1)
    return rounded(rows.groupBy(F.pmod("source_id", F.lit(50)).alias("part")).agg(*[F.avg(c).alias(c) for c in ("peak_flux", "total_flux", "e_ra")]), 4)


def peak_frequencies(spark, sf_dir):
    """Peak and noise of every image with its header's frequency, pixel scale and beam; band planes with theirs."""
    pixels = view(spark, sf_dir, "pixels")
    images = pixels.select("image_id").distinct().withColumn("header", F.create_map(*[x for k, v in (
        ("RESTFRQ", F.col("image_id") * 1e6), ("CDELT2", F.lit(0.001)), ("BMAJ", F.lit(0.002)), ("BMIN", F.lit(0.0015)), ("BPA", F.lit(12.5)),
        *((f"{card}{b:04d}", F.col("image_id") * 1e3 + b + shift) for b in (1, 2, 3) for card, shift in (("FREL", 0.0), ("FREQ", 0.25), ("FREH", 0.5))),
    ) for x in (F.lit(k), v.cast("string"))]))
    peaks = image.with_geometry(image.peak_and_rms(pixels, images), images)
    planes = image.with_frequencies(image.plane_stats(pixels), images).groupBy("image_id").agg(F.count("*").alias("n_planes"), F.count("freq_hz").alias("n_known"), F.avg("freq_hz").alias("mean_band"), F.avg(F.col("freq_high") - F.col("freq_low")).alias("width"))
    return rounded(peaks.join(planes, "image_id"))


def _r(e: str, n: str, digits: int = 6) -> str:
    return f"round(CAST(({e}) AS DOUBLE), {digits}) + 0.0 AS {n}"


_SEP = "degrees(atan2(sqrt(pow(cos(radians(c.dec))*sin(radians(c.ra-t.ra)),2)+pow(cos(radians(t.dec))*sin(radians(c.dec))-sin(radians(t.dec))*cos(radians(c.dec))*cos(radians(c.ra-t.ra)),2)), sin(radians(t.dec))*sin(radians(c.dec))+cos(radians(t.dec))*cos(radians(c.dec))*cos(radians(c.ra-t.ra))))"
_PLACE = "SELECT 's' || CAST({k} AS VARCHAR) AS name, {k}*37 % 3600/10.0::DOUBLE AS ra, {k}*53 % 1400/10.0::DOUBLE - 70 AS dec FROM {t}"
_TURN = "radians(2*((source_id % 180) - 30.0::DOUBLE))"

QUERIES = {
    "coordinate_units": (coordinate_units, sql("SELECT source_id, " + ", ".join(_r(f"ra*{f}", n) for n, f in (("from_none", "1"), ("from_deg", "1"), ("from_arcmin", "(1/60.0::DOUBLE)"), ("from_arcsec", "(1/3600.0::DOUBLE)"), ("from_rad", "(180/pi())"), ("from_hourangle", "15"))) + ", CAST(NULL AS DOUBLE) AS absent, R(xposn) AS present FROM cat_ref", "cat_ref")),
    "positive_points": (positive_points, sql("SELECT source_id, count(*) AS n, R(sum(v_peak)) AS v, R(sum(q_peak)) AS q FROM sed_points WHERE v_peak > 0 AND q_peak > 0 GROUP BY 1", "sed_points")),
    "pair_geometry": (pair_geometry, matched_sql("SELECT source_id_1, " + ", ".join(_r(e, n, 5) for n, e in (
        ("east", "(ra_2-ra_1)*cos(radians((dec_1+dec_2)/2))*3600"), ("north", "(dec_2-dec_1)*3600"), ("raw_angle", "degrees(atan2(dec_1-dec_2, ra_1-ra_2))"),
        ("sep_diff", "sqrt(pow(ra_1-ra_2,2)+pow(dec_1-dec_2,2)) - sqrt(pow(ra_1-(ra_2+0.001::DOUBLE),2)+pow(dec_1-dec_2,2))"))) + " FROM m")),
    "polarisation_fractions": (polarisation_fractions, sql("""WITH s AS (SELECT *, sqrt(q_peak*q_peak+u_peak*u_peak) AS a, round(q_peak, 6) AS q, round(u_peak, 6) AS u FROM sed_points WHERE abs(q_peak) + abs(u_peak) > 1e-9 AND i_peak > 0)
      SELECT source_id, count(*) AS n, R(avg(a/i_peak)) AS p, R(avg(sqrt(pow(q_peak*0.001,2)+pow(u_peak*0.002,2))/a/i_peak)) AS e_p, R(avg(a)) AS amp, R(avg(abs(degrees(atan2(u, q))))) AS phase FROM s GROUP BY 1""", "sed_points")),
    "model_values": (model_values, sql("WITH s AS (SELECT source_id, freq_hz AS f, freq_hz/1e9 AS g, i_peak AS s FROM sed_points WHERE i_peak > 0) SELECT source_id, " + ", ".join(_r(f"avg({e})", n) for n, e in (
        ("power", "s*pow(g, -0.7)"), ("curved", "s*pow(g/0.9, -0.6 + 0.1*ln(g/0.9))"), ("log_line", "2.0 - 0.5*log10(f)"), ("line", "2.5*g + s"), ("calibrator", "17.066*pow(f/1284e6, -1.179)"), ("width", "0.25/1.125"), ("span_mhz", "f*0.25/1e6"),
        ("position_rms", "sqrt(7.68*7.68 + 8.94*8.94)/(2*s/0.01)"), ("area", "pi()*s*g"), ("noise", "1e6*s/sqrt(64*63*600.0)"))) + " FROM s GROUP BY 1", "sed_points")),
    "beam_patterns": (beam_patterns, sql("""WITH c AS (SELECT source_id, xposn - 2048 AS x, yposn - 2048 AS y FROM cat_test)
      SELECT source_id, R(exp(-2.7726*1.2*1.2*(x*x+y*y)/(3600.0*3600.0))) AS beam, R((0.25 + 0.25*(x*x+y*y))/max(0.25 + 0.25*(x*x+y*y)) OVER ()) AS pattern FROM c""", "cat_test")),
    "deconvolved_angle": (deconvolved_angle, sql(f"""WITH c AS (SELECT source_id, pow(9.0::DOUBLE + source_id % 7, 2) - pow(7.0::DOUBLE + source_id % 2, 2) AS long, 8.5*8.5 - 6.5*6.5::DOUBLE AS beam FROM cat_test),
      t AS (SELECT source_id, degrees(atan2(long*sin({_TURN}), long*cos({_TURN}) - beam))/2 AS tilt FROM c), p AS (SELECT source_id, 30 + CASE WHEN tilt < -45 THEN tilt + 180 ELSE tilt END AS pa FROM t)
      SELECT source_id, {_r('CASE WHEN pa > 180 THEN pa - 180 WHEN pa < -180 THEN pa + 180 ELSE pa END', 'pa', 5)} FROM p""", "cat_test")),
    "parsed_frequencies": (parsed_frequencies, f"SELECT p_partkey, {_r('CASE p_partkey % 8 WHEN 0 THEN p_partkey*1e6 WHEN 1 THEN p_partkey*1e6 WHEN 2 THEN p_partkey*1e6 WHEN 3 THEN p_partkey + 0.5 WHEN 4 THEN -p_partkey*1e9 END', 'freq_hz', 3)} FROM part"),
    "name_frequencies": (name_frequencies, f"""WITH p AS (SELECT p_partkey, p_partkey % 900 + 50 AS n FROM part)
      SELECT p_partkey, {_r('CASE p_partkey % 7 WHEN 0 THEN (n + 2000)/2.0 WHEN 1 THEN 1284 WHEN 2 THEN n + 0.5 WHEN 3 THEN CASE WHEN n >= 100 THEN n END WHEN 6 THEN CASE WHEN n >= 100 THEN n END END', 'mhz')} FROM p"""),
    "header_cards": (header_cards, f"""SELECT p_partkey, {_r('CASE p_partkey % 4 WHEN 0 THEN p_partkey*0.036 WHEN 1 THEN p_partkey*0.036 WHEN 2 THEN p_partkey*0.18 END', 'scale', 4)}, {_r('CASE WHEN p_partkey % 4 = 3 THEN p_partkey*0.0036 END', 'bmaj', 4)}, {_r('CASE WHEN p_partkey % 4 = 3 THEN 3.6 END', 'bmin', 4)},
      CAST(NULL AS DOUBLE) AS bpa, 'run_low' || CASE WHEN p_partkey % 3 > 0 THEN '_scan' || CAST(p_partkey % 3 AS VARCHAR) ELSE '' END AS tag FROM part"""),
    "named_positions": (named_positions, f"""WITH c AS (SELECT c_custkey AS k, c_custkey % 24 AS h, c_custkey % 90 AS d, c_custkey % 60 AS m FROM customer)
      SELECT k AS c_custkey, {_r('CASE k % 3 WHEN 0 THEN 15*(h + m/60.0::DOUBLE) WHEN 1 THEN 15*(h + m/60.0::DOUBLE + m/3600.0::DOUBLE) END', 'ra')}, {_r('CASE k % 3 WHEN 0 THEN -(d + m/60.0::DOUBLE) WHEN 1 THEN d + m/60.0::DOUBLE + m/3600.0::DOUBLE END', 'dec')} FROM c"""),
    "calibrators_near": (calibrators_near, f"""WITH t AS ({_PLACE.format(k='c_custkey', t='customer')}), c AS ({_PLACE.format(k='s_suppkey', t='supplier')}), p AS (SELECT t.name AS target, {_SEP} AS sep FROM t, c WHERE t.name <> c.name)
      SELECT target, count(*) AS n, {_r('min(sep)', 'closest', 5)}, {_r('max(sep)', 'farthest', 5)} FROM p WHERE sep <= 16 GROUP BY 1"""),
    "known_calibrators": (known_calibrators, "SELECT n_name AS name, 'cal' || CAST(max(c_custkey) AS VARCHAR) AS calibrator FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1"),
    "files_by_affix": (files_by_affix, "SELECT 'img' || CAST(p_partkey AS VARCHAR) || '.fits' AS path FROM part WHERE CAST(p_partkey AS VARCHAR) LIKE '1%7'"),
    "spw_limits": (spw_limits, sql("SELECT source_id AS spw, R(min(freq_hz)) AS fmin, R(max(freq_hz)) AS fmax, CAST(floor(0.2*count(*)) AS INTEGER) AS first, CAST(floor(0.8*count(*)) AS INTEGER) AS last FROM sed_points GROUP BY 1", "sed_points")),
    "predicted_flux": (predicted_flux, sql(f"SELECT source_id, {_r('regr_slope(i_peak, freq_hz/1e9)*1.42 + regr_intercept(i_peak, freq_hz/1e9)', 'predicted', 5)} FROM sed_points GROUP BY 1 HAVING count(DISTINCT freq_hz) > 1", "sed_points")),
    "millijansky": (millijansky, sql(f"SELECT source_id % 50 AS part, {_r('avg(peak_flux*1100)', 'peak_flux', 4)}, {_r('avg(total_flux*1100)', 'total_flux', 4)}, {_r('avg(CASE WHEN source_id % 5 = 0 THEN -1 ELSE e_peak_flux END)', 'e_ra', 4)} FROM cat_test GROUP BY 1", "cat_test")),
    "peak_frequencies": (peak_frequencies, sql("""WITH i AS (SELECT image_id, max(value) AS peak, sqrt(avg(value*value)) AS rms FROM pixels GROUP BY 1), p AS (SELECT DISTINCT image_id, plane FROM pixels WHERE plane >= 2),
      b AS (SELECT image_id, count(*) AS n_planes, count(CASE WHEN plane <= 4 THEN 1 END) AS n_known, avg(CASE WHEN plane <= 4 THEN image_id*1000 + plane - 0.75 END) AS mean_band, avg(CASE WHEN plane <= 4 THEN 0.5 END) AS width FROM p GROUP BY 1)
      SELECT image_id, R(peak) AS peak, R(rms) AS rms, R(image_id*1e6) AS freq_hz, R(3.6) AS pixel_scale, R(7.2) AS bmaj, R(5.4) AS bmin, R(12.5) AS bpa, n_planes, n_known, R(mean_band) AS mean_band, R(width) AS width FROM i JOIN b USING (image_id)""", "pixels")),
}
