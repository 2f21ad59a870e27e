"""Queries over positions in images, tables written and read back, and small functions of headers and ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyaccord.functions import flux, headers
from skyaccord.lineage import scratch
from skyaccord.operators import image, sources
from skyaccord.plans.common import matched, matched_sql, rounded, sql
from skyaccord.plans.fixtures import view
from skyaccord.plans.reports import OBSERVATION_MODES, attach_mode
from skyaccord.sources import fits, sinks

#: Two images of 128 x 128 pixels around one place.
RA0, DEC0, STEP, CENTRE = 31.24, -44.0, 0.02, 65


def _header() -> Column:
    cards = {"CTYPE1": "RA---TAN", "CRVAL1": RA0, "CRVAL2": DEC0, "CRPIX1": CENTRE, "CRPIX2": CENTRE, "CDELT1": -STEP, "CDELT2": STEP}
    return F.create_map(*[F.lit(str(x)) for pair in cards.items() for x in pair])


def _grid(spark, sf_dir) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    place = [(F.col("l_linenumber") % 2).cast("long").alias("image_id"), (F.col("l_partkey") % 128).cast("long").alias("x"), (F.col("l_orderkey") % 128).cast("long").alias("y")]
    # Summed as decimals and divided once: means that end in one half of the last digit do not hang on the order of summation.
    total = F.sum(F.col("l_extendedprice").cast("decimal(30,6)")).cast("double")
    return lines.groupBy(*place).agg((total / (F.count("l_extendedprice") * 100000)).alias("value")).withColumn("plane", F.lit(0))


def _located(spark, sf_dir) -> DataFrame:
    images = spark.range(2).select(F.col("id").alias("image_id"), _header().alias("header"))
    cat = view(spark, sf_dir, "cat_ref").filter("ra IS NOT NULL").select("source_id", "ra", "dec", "peak_flux", (F.col("source_id") % 2).cast("long").alias("image_id"))
    # The SQL projects every source by the plain formula, wherever it lies.
    return image.locate_sources(cat, images, far=True)


def source_boxes(spark, sf_dir):
    """Pixels in a box of 288 arcsec around every source that an image holds, from its position and the image's header."""
    boxes = image.source_boxes(_located(spark, sf_dir), _grid(spark, sf_dir), 288.0)
    total = F.sum(F.round("value", 12).cast("decimal(38,12)"))  # as in _grid
    return boxes.groupBy("image_id", "source_id").agg(F.count("*").alias("n"), (F.round(F.round(total, 10), 5).cast("double") + 0.0).alias("total"))


def map_value_sources(spark, sf_dir):
    """Good sources by the map value at their position."""
    valued = image.map_values(_located(spark, sf_dir), _grid(spark, sf_dir)).withColumn("isl_rms", F.lit(0.1))
    good = sources.good_sources(valued, snr=10.0, flux=0.3, at_source="map_value")
    return good.select("source_id", F.round("xposn", 5).alias("xposn"), F.round("yposn", 5).alias("yposn"), F.round("map_value", 9).alias("map_value"), "good")


def written_matches(spark, sf_dir):
    """The matches written as binary tables with their metadata, and read back in ranges of rows."""
    m = matched(spark, sf_dir).select("source_id_1", "source_id_2", "sep_arcsec", "peak_flux_1", "peak_flux_2")
    header = spark.createDataFrame([("INPUT", f"{sf_dir}/orders.parquet")], "key string, value string")
    path = scratch(spark)
    sinks.write_match(m, sinks.match_metadata(header, header, 1.0, "one_to_one"), path, "fits")
    wanted = {"source_id_1": "long", "source_id_2": "long", "sep_arcsec": "double", "peak_flux_1": "double", "peak_flux_2": "double"}
    back = fits.ingest_tables(spark, f"{path}/matches", wanted, range_bytes=4_000_000)
    # An error row has no ids and would not be in the SQL's result.
    return rounded(back.withColumn("sep_arcsec", F.round("sep_arcsec", 6)).select(*wanted, F.col("header")["XMATCH_MODE"].alias("mode"), "error"), 9)


def injected_frequencies(spark, sf_dir):
    """Headers with a frequency keep it, others get spectral cards."""
    key = F.col("p_partkey")
    header = F.when(key % 2 == 0, F.create_map(F.lit("FREQ"), (key * 100).cast("string"))).otherwise(F.create_map(F.lit("BUNIT"), F.lit("Jy/beam")))
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", headers.inject_frequency(header, (key * 7).cast("double")).alias("h"))
    return rounded(parts.select("p_partkey", headers.header_frequency(F.col("h")).alias("freq_hz"), F.try_element_at("h", F.lit("CTYPE3")).alias("axis"), F.size("h").alias("cards")))


def guarded_ratios(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rounded(lines.groupBy("l_linenumber").agg(F.sum(flux.safe_div(F.col("l_quantity"), F.col("l_discount") * 100)).alias("total")), 3)


def observation_modes(spark, sf_dir):
    """Correlator modes of observations named after orders."""
    names = list(OBSERVATION_MODES)
    which = F.element_at(F.array(*[F.lit(n) for n in names], F.lit("0")), (F.col("o_orderkey") % (len(names) + 1) + 1).cast("int"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("obs_"), which, F.lit("_sdp_l0")).alias("observation"))
    return attach_mode(orders).groupBy("mode").agg(F.count("*").alias("n"))


_PLANE = f"""s AS (SELECT source_id, peak_flux, source_id % 2 AS image_id, radians(dec) AS d, radians({DEC0}) AS d0, radians(ra - {RA0}) AS da FROM cat_ref WHERE ra IS NOT NULL
), t AS (SELECT source_id, peak_flux, image_id, cos(d)*sin(da) AS e, sin(d)*cos(d0) - cos(d)*sin(d0)*cos(da) AS n, sin(d)*sin(d0) + cos(d)*cos(d0)*cos(da) AS w FROM s
), placed AS (SELECT source_id, peak_flux, image_id, degrees(e/w)/-{STEP} + {CENTRE - 1} AS xposn, degrees(n/w)/{STEP} + {CENTRE - 1} AS yposn FROM t
), px AS (SELECT l_linenumber % 2 AS image_id, l_partkey % 128 AS x, l_orderkey % 128 AS y, avg(l_extendedprice)/100000 AS value FROM lineitem GROUP BY 1, 2, 3)"""
_MODES = " ".join(f"WHEN {k} THEN '{m}'" for k, m in enumerate(OBSERVATION_MODES.values()))

QUERIES = {
    "source_boxes": (source_boxes, sql(f"WITH {_PLANE} SELECT CAST(image_id AS BIGINT) AS image_id, source_id, count(*) AS n, round(sum(value), 5) + 0.0 AS total FROM placed JOIN px USING (image_id) WHERE abs(x - round(xposn)) <= 2 AND abs(y - round(yposn)) <= 2 GROUP BY 1, 2", "cat_ref")),
    "map_value_sources": (map_value_sources, sql(f"""WITH {_PLANE} SELECT source_id, round(xposn, 5) + 0.0 AS xposn, round(yposn, 5) + 0.0 AS yposn, round(value, 9) + 0.0 AS map_value, peak_flux/0.1 > 10 AND coalesce(value, 0.1) > 0.3 AS good
      FROM placed LEFT JOIN px ON px.image_id = placed.image_id AND x = round(xposn) AND y = round(yposn)""", "cat_ref")),
    "written_matches": (written_matches, matched_sql("SELECT source_id_1, source_id_2, round(sep, 6) + 0.0 AS sep_arcsec, round(peak_flux_1, 9) + 0.0 AS peak_flux_1, round(peak_flux_2, 9) + 0.0 AS peak_flux_2, 'one_to_one' AS mode, CAST(NULL AS VARCHAR) AS error FROM m")),
    "injected_frequencies": (injected_frequencies, "SELECT p_partkey, CAST(CASE WHEN p_partkey % 2 = 0 THEN p_partkey*100 ELSE p_partkey*7 END AS DOUBLE) AS freq_hz, CASE WHEN p_partkey % 2 = 1 THEN 'FREQ' END AS axis, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 7 END AS cards FROM part"),
    "guarded_ratios": (guarded_ratios, "SELECT l_linenumber, round(sum(CASE WHEN l_discount = 0 THEN 0 ELSE l_quantity/(l_discount*100) END), 3) + 0.0 AS total FROM lineitem GROUP BY 1"),
    "observation_modes": (observation_modes, f"SELECT CASE o_orderkey % {len(OBSERVATION_MODES) + 1} {_MODES} END AS mode, count(*) AS n FROM orders GROUP BY 1"),
}
