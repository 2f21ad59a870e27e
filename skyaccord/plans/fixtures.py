"""Survey-shaped views over the driver's tables. The same SQL runs in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_D = "CAST({} AS DOUBLE)".format
_POL = "CASE l_orderkey % 4 WHEN 0 THEN 'XX' WHEN 1 THEN 'XY' WHEN 2 THEN 'YX' ELSE 'YY' END"
_RA = f"{_D('30.0')} + (o_orderkey % 125)*{_D('0.02')}"
_DEC = f"{_D('-45.0')} + CAST(FLOOR(o_orderkey/{_D('125.0')}) AS INT)*{_D('0.02')}"
_X = f"{_D('2048.0')} + ((o_orderkey*7) % 2001 - 1000)"
_Y = f"{_D('2048.0')} + ((o_orderkey*11) % 2001 - 1000)"
_FLUX = f"o_totalprice/{_D('100000.0')}"

FIXTURES = {
    "cat_ref": f"""
SELECT o_orderkey AS source_id, CASE WHEN o_orderkey % 997 = 5 THEN NULL ELSE {_RA} END AS ra, {_DEC} AS dec,
  {_FLUX} AS peak_flux, {_D('0.005')} + o_totalprice/{_D('5000000.0')} AS e_peak_flux,
  {_FLUX}*({_D('1.0')} + (o_orderkey % 5)*{_D('0.1')}) AS total_flux, {_X} + {_D('0.25')} AS xposn, {_Y} + {_D('0.5')} AS yposn
FROM orders
UNION ALL
SELECT o_orderkey + 2000000, {_RA} + {_D('0.00012')}, {_DEC} + {_D('0.00006')}, o_totalprice/{_D('300000.0')}, {_D('0.01')},
  o_totalprice/{_D('250000.0')}, {_X} + {_D('0.75')}, {_Y} + {_D('0.75')}
FROM orders WHERE o_orderkey % 13 = 0""",
    "cat_test": f"""
SELECT o_orderkey AS source_id, {_RA} + ((o_orderkey*37) % 101 - 50)*{_D('0.000008')} AS ra, {_DEC} + ((o_orderkey*53) % 97 - 48)*{_D('0.000006')} AS dec,
  {_FLUX}*({_D('1.0')} + ((o_orderkey*17) % 41 - 20)*{_D('0.002')}) AS peak_flux, {_D('0.005')} + o_totalprice/{_D('4000000.0')} AS e_peak_flux,
  {_FLUX}*({_D('1.0')} + (o_orderkey % 5)*{_D('0.1')})*({_D('1.0')} + ((o_orderkey*19) % 43 - 21)*{_D('0.003')}) AS total_flux, {_X} + {_D('0.5')} AS xposn, {_Y} + {_D('0.125')} AS yposn
FROM orders WHERE o_orderkey % 7 <> 3
UNION ALL
SELECT o_orderkey + 1000000, {_RA} + {_D('0.0002')}, {_DEC} - {_D('0.00005')}, o_totalprice/{_D('200000.0')}, {_D('0.02')},
  o_totalprice/{_D('150000.0')}, {_X} + {_D('0.875')}, {_Y} + {_D('0.375')}
FROM orders WHERE o_orderkey % 11 = 0""",
    "vis_rows": f"""
SELECT CAST(l_suppkey % 16 AS INT) AS ant1, CAST(l_partkey % 16 AS INT) AS ant2, l_linenumber AS scan, CAST(l_orderkey % 2 AS INT) AS spw, {_POL} AS pol,
  l_extendedprice/{_D('10000.0')} AS mean, l_quantity/{_D('10.0')} AS rms, l_discount AS flag_frac
FROM lineitem""",
    "vis_chan": f"""
SELECT CAST(l_suppkey % 16 AS INT) AS ant1, CAST(l_partkey % 16 AS INT) AS ant2, CAST(l_orderkey % 2 AS INT) AS spw, CAST(l_partkey % 32 AS INT) AS chan, {_POL} AS pol, l_quantity > 40 AS flag
FROM lineitem""",
    "spectra": "SELECT vec_id AS row_id, label AS scan, embedding AS amp FROM embeddings",
    "sed_points": f"""
SELECT l_partkey AS source_id, {_D('900000000.0')} + l_linenumber*{_D('100000000.0')} AS freq_hz, l_extendedprice/{_D('100000.0')} AS i_peak, l_tax - {_D('0.04')} AS v_peak,
  l_discount - {_D('0.05')} AS q_peak, l_tax - {_D('0.03')} AS u_peak
FROM lineitem""",
    "pixels": f"""
SELECT l_suppkey AS image_id, l_linenumber AS plane, CASE WHEN l_discount = 0 THEN NULL ELSE l_extendedprice/{_D('100000.0')} - {_D('0.3')} END AS value
FROM lineitem""",
    "spw_dim": f"SELECT * FROM (VALUES (0, {_D('856000000.0')}, {_D('1100000000.0')}), (1, {_D('1100000000.0')}, {_D('1500000000.0')}), (2, {_D('1500000000.0')}, {_D('1712000000.0')})) AS t(spw, fmin, fmax)",
    "band_dim": f"SELECT * FROM (VALUES ('lowband', {_D('898000000.0')}, {_D('1000000000.0')}), ('highband', {_D('1460000000.0')}, {_D('1700000000.0')})) AS t(band, lo_hz, hi_hz)",
    "image_dim": f"SELECT * FROM (VALUES ('ref', {_D('0.002483482')}, {_D('0.002133589')}, {_D('2048.0')}, {_D('2048.0')}), ('test', {_D('0.0025')}, {_D('0.0022')}, {_D('2047.5')}, {_D('2048.5')})) AS t(image_id, bmaj_deg, bmin_deg, crpix1, crpix2)",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture as a lazy plan over the Parquet tables."""
    sql = FIXTURES[name]
    for table in ("orders", "lineitem", "embeddings"):
        if f"FROM {table}" in sql:
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(f"skyaccord_{table}")
            sql = sql.replace(f"FROM {table}", f"FROM skyaccord_{table}")
    return spark.sql(sql)


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL with fixtures as common tables before its own."""
    ctes = ", ".join(f"{n} AS ({FIXTURES[n]})" for n in names)
    return f"WITH {ctes}{', ' + sql.lstrip()[5:] if sql.lstrip().upper().startswith('WITH ') else ' ' + sql}"
