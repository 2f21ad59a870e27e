"""Readers, writers, header and text functions."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyaccord.functions import flux, headers, sky
from skyaccord.operators import image, sources
from skyaccord.sources import fits, sinks, tables


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("text,hz", [("1420", 1.42e9), ("1.4 GHz", 1.4e9), ("900e3kHz", 9e8), ("5 Hz", 5.0), ("x", None), ("3 parsec", None), ("", None), ("+1420", 1.42e9), ("-5", -5e6), (".5", None), ("7.", None)])
def test_parse_frequency(spark, text, hz):
    assert one(spark, headers.parse_frequency(F.lit(text))) == (pytest.approx(hz) if hz else None)


@pytest.mark.parametrize("name,mhz", [("/a/x_900~1000MHz.fits", 950.0), ("b_1284MHz.fits", 1284.0), ("c_1420_x.fits", 1420.0), ("d_42_x.fits", None), ("e_7000_.fits", None), ("img-900-1284MHz.fits", 1284.0), ("c_1420.fits", None), ("1420_x.fits", None), ("f-1420.5_x.fits", 1420.0), ("g_7000_1420_.fits", None)])
def test_frequency_from_name(spark, name, mhz):
    assert one(spark, headers.freq_from_name(F.lit(name))) == mhz


def header(**cards):
    return F.create_map(*[F.lit(x) for kv in cards.items() for x in kv])


def test_headers(spark):
    assert one(spark, headers.header_frequency(header(RESTFRQ="oops", FREQ="1e9"))) == 1e9
    assert one(spark, headers.header_frequency(header(CTYPE1="FREQ-LSR", CRVAL1="5e8"))) == 5e8
    assert one(spark, headers.header_frequency(header(CTYPE1="RA", CRVAL1="5e8"))) is None
    assert one(spark, headers.pixel_scale(header(CDELT2="-0.001"))) == pytest.approx(3.6)
    assert one(spark, headers.pixel_scale(header(CD2_1="0.003", CD2_2="0.004"))) == pytest.approx(18.0)
    got = one(spark, headers.inject_frequency(header(BUNIT="Jy"), F.lit(1e9)))
    assert got["CTYPE3"] == "FREQ" and got["BUNIT"] == "Jy" and float(got["RESTFRQ"]) == 1e9
    assert one(spark, headers.inject_frequency(header(RESTFRQ="7"), F.lit(1e9))) == {"RESTFRQ": "7"}
    assert one(spark, headers.image_tag(F.lit("/x/a.ms"), F.lit("low"), F.lit(3))) == "a_low_scan3"
    cube = one(spark, image.band_header(header(CTYPE3="SPECLNMF", CLEANBMJ="0.1"), F.lit("low")))
    assert cube["CTYPE3"] == "FREQ" and cube["BMAJ"] == "0.1" and cube["BAND"] == "low"


def test_sky_functions(spark):
    assert one(spark, sky.sexagesimal(F.lit(10.0), F.lit(-20.5))) == "00:40:00.0000, -20:30:00.0000"
    assert one(spark, sky.sexagesimal(F.lit(359.9999999999), F.lit(0.0))).startswith("00:00:00.0000")
    ra, dec = sky.coords_from_name(F.lit("J0408-6545"))
    assert one(spark, ra) == pytest.approx(62.0) and one(spark, dec) == pytest.approx(-65.75)
    ra, dec = sky.coords_from_name(F.lit("x_J123456+012345_y"))
    assert one(spark, ra) == pytest.approx(188.733333, abs=1e-5) and one(spark, dec) == pytest.approx(1.395833, abs=1e-5)
    east, north = sky.spherical_offsets(F.lit(10.0), F.lit(60.0), F.lit(10.001), F.lit(60.001))
    assert one(spark, east) == pytest.approx(1.8, abs=1e-3) and one(spark, north) == pytest.approx(3.6, abs=1e-3)
    assert one(spark, sky.pixel_angle(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0), wrap=True)) == 225.0


def test_flux_functions(spark):
    assert one(spark, flux.frac_diff(F.lit(2.0), F.lit(0.0))) is None and one(spark, flux.safe_div(F.lit(2.0), F.lit(0.0))) == 0
    assert one(spark, flux.primary_beam_gain(F.lit(0.0), F.lit(1e9))) == 1.0
    assert one(spark, flux.flux_model(F.lit(1284e6))) == pytest.approx(17.066)
    size = one(spark, flux.deconvolve_beam(*[F.lit(float(x)) for x in (5, 4, 30, 3, 3, 0)]))
    assert (size.maj, size.min, size.n_clipped) == (pytest.approx(4.0), pytest.approx(7**0.5), 0)
    point = one(spark, flux.deconvolve_beam(*[F.lit(float(x)) for x in (3, 3, 0, 3, 3, 0)]))
    assert (point.maj, point.pa) == (0.0, 0.0)


def card(text):
    return f"{text:<80}".encode()


def unit(cards, data=b""):
    head = b"".join(map(card, [*cards, "END"]))
    return head + b" " * (-len(head) % 2880) + data + b"\0" * (-len(data) % 2880)


def test_fits_tables_and_images(spark, tmp_path):
    rows = b"".join(struct.pack(">qd4s", k, k / 2, f"s{k}".encode()) for k in range(5))
    table = unit(["SIMPLE  = T", "BITPIX  = 8", "NAXIS   = 0"]) + unit(["XTENSION= 'BINTABLE'", "BITPIX  = 8", "NAXIS   = 2", "NAXIS1  = 20", "NAXIS2  = 5", "PCOUNT  = 0", "GCOUNT  = 1", "TFIELDS = 3", "TTYPE1  = 'Source_id'", "TFORM1  = 'K'", "TTYPE2  = 'RA'", "TFORM2  = 'D'", "TTYPE3  = 'name'", "TFORM3  = '4A'"], rows)
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.fits").write_bytes(table)
    (tmp_path / "t" / "broken.fits").write_bytes(b"junk" * 2000)
    got = fits.ingest_tables(spark, f"{tmp_path}/t/*.fits", {"source_id": "long", "ra": "double", "name": "string", "absent": "double"}).collect()
    broken = [r for r in got if r.error is not None]
    got = [r for r in got if r.error is None]
    assert [(r.source_id, r.ra, r.name, r.absent) for r in got] == [(k, k / 2, f"s{k}", None) for k in range(5)]
    assert got[0].header["TFIELDS"] == "3"
    assert [(r.path.rsplit("/", 1)[1], r.header, r.source_id) for r in broken] == [("broken.fits", None, None)]
    image = np.arange(6, dtype=">f4").reshape(1, 2, 3)
    image[0, 1, 2] = np.nan
    (tmp_path / "i").mkdir()
    (tmp_path / "i" / "b.fits").write_bytes(unit(["SIMPLE  = T", "BITPIX  = -32", "NAXIS   = 3", "NAXIS1  = 3", "NAXIS2  = 2", "NAXIS3  = 1", "BMAJ    = 0.002 / beam", "OBJECT  = 'it''s'"], image.tobytes()))
    images, pixels = fits.read_image_pixels(spark, f"{tmp_path}/i/*.fits")
    assert images.first().header["OBJECT"] == "it's" and images.first().header["BMAJ"] == "0.002"
    assert {(r.plane, r.x, r.y): r.value for r in pixels.collect()} == {(0, x, y): None if (x, y) == (2, 1) else float(3 * y + x) for x in range(3) for y in range(2)}


def test_plane_numbers_of_the_reader_fit_the_statistics(spark, tmp_path):
    """A cube of a mean image, a spectral index and two bands: statistics begin at the first band, with its frequency."""
    cube = np.stack([np.full((2, 2), v) for v in (50, -0.7, 1, 2)]).astype(">f4")
    cards = ["SIMPLE  = T", "BITPIX  = -32", "NAXIS   = 3", "NAXIS1  = 2", "NAXIS2  = 2", "NAXIS3  = 4", *[f"{k}{b:04d}= {1e9 + b * 1e8 + s}" for b in (1, 2) for k, s in (("FREL", 0), ("FREQ", 5e6), ("FREH", 1e7))]]
    (tmp_path / "cube.fits").write_bytes(unit(cards, cube.tobytes()))
    images, pixels = fits.read_image_pixels(spark, f"{tmp_path}/*.fits")
    got = image.with_frequencies(image.plane_stats(pixels.withColumnRenamed("path", "image_id")), images.withColumnRenamed("path", "image_id")).orderBy("plane").collect()
    assert [(r.plane, r.max, r.freq_hz) for r in got] == [(2, 1.0, 1.105e9), (3, 2.0, 1.205e9)]


def test_written_tables_are_sorted(spark, tmp_path):
    matches = spark.createDataFrame([(k, float((k * 7) % 10)) for k in range(10)], "source_id_1 int, sep_arcsec double").repartition(4)
    sinks.write_match(matches, spark.createDataFrame([("a", "b")], "key string, value string"), f"{tmp_path}/m")
    files = sorted((tmp_path / "m" / "matches").glob("part-*.parquet"))
    assert [r.sep_arcsec for f in files for r in spark.read.parquet(str(f)).collect()] == [float(k) for k in range(10)]
    series = spark.createDataFrame([(s, p, 1.0) for s in (3, 1, 2) for p in ("YY", "XX")], "scan int, pol string, mean double").repartition(3)
    sinks.write_csv({"scan": series}, f"{tmp_path}/csv")
    rows = [line for f in sorted((tmp_path / "csv" / "scan").glob("part-*.csv")) for line in f.read_text().splitlines() if not line.startswith("scan")]
    assert rows == [f"{s},{p},1.0" for p in ("XX", "YY") for s in (1, 2, 3)]
    (tmp_path / "stats").mkdir()
    (tmp_path / "stats" / "run_a.csv").write_text("#mode,freqs\nc4k,1e9,1e9,5,1,2,3,4\n")
    (tmp_path / "stats" / "other.csv").write_text("c4k,1e9,1e9,5,1,2,3,4\n")
    assert [(r.mode, r.fd_sgm, r.file) for r in tables.read_channel_stats(spark, f"{tmp_path}/stats/*.csv", "run_").collect()] == [("c4k", 4.0, "run_a.csv")]
    sources_in = spark.createDataFrame([(1, 10.0, -1.0, 2.0, 1.0, True)], "source_id long, ra double, dec double, total_flux double, peak_flux double, good boolean")
    sinks.write_source_list(sources_in, f"{tmp_path}/list")
    assert spark.read.csv(f"{tmp_path}/list", header=True).first().ra == "10.0"


def test_offsets_take_the_short_way_round(spark):
    east, _ = sky.offsets_flat(F.lit(359.9999), F.lit(0.0), F.lit(0.0001), F.lit(0.0))
    assert one(spark, east) == pytest.approx(0.72)
    east, _ = sky.offsets_mid(F.lit(0.0001), F.lit(0.0), F.lit(359.9999), F.lit(0.0))
    assert one(spark, east) == pytest.approx(-0.72)


def test_text_readers(spark, tmp_path):
    line = " ".join(str(k) for k in range(1, 44))
    (tmp_path / "c.txt").write_text(f"# head\n{line}\n\n")
    r = tables.read_ascii_catalog(spark, f"{tmp_path}/c.txt").first()
    assert (r.source_id, r.ra, r.e_ra, r.pa, r.isl_rms) == (1, 3.0, 4.0 * 3600, 109.0, 43.0)
    (tmp_path / "t.tbl").write_text("\\char INIMAGE = 'x.fits'\n\\FREQ0 = 1.4e9\n|  ra   | dec |name |\n|double|d|c|\n 10.5    -20   abc\n")
    rows, notes = tables.read_ipac(spark, f"{tmp_path}/t.tbl")
    assert {r.key: r.value for r in notes.collect()} == {"INIMAGE": "x.fits", "FREQ0": "1.4e9"}
    assert rows.first().row == {"ra": "10.5", "dec": "-20", "name": "abc"}
    lines = spark.createDataFrame([(1, "a.fits 1.4GHz"), (2, "b.fits, 900 MHz # c"), (3, "# only"), (4, "c.fits"), (5, "d.fits x")], "ord int, value string")
    good, bad = tables.parse_filelist(lines)
    assert [(r.path, r.freq_hz) for r in good.orderBy("ord").collect()] == [("a.fits", 1.4e9), ("b.fits", 9e8)] and {r.ord for r in bad.collect()} == {4, 5}


def test_catalogues_scans_and_manifests(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.0, float("nan"))], "source_id long, RA double, DEC double")
    df.write.parquet(f"{tmp_path}/cat")
    got = tables.read_catalog(spark, f"{tmp_path}/cat")
    assert got.columns == ["source_id", "ra", "dec"] and got.first().dec is None
    with pytest.raises(ValueError):
        tables.read_catalog(spark, f"{tmp_path}/cat", dec="nope")
    df.coalesce(1).write.parquet(f"{tmp_path}/scans")
    (tmp_path / "scans" / "bad.parquet").write_bytes(b"nothing")
    rows, files = tables.scan_glob(spark, f"{tmp_path}/scans/*.parquet", "source_id long, RA double")
    assert rows.count() == 1 and sorted(r.n for r in files.collect()) == [0, 1]
    assert [r.n for r in tables.scan_glob(spark, f"{tmp_path}/scans/*.parquet", "source_id long", "skip")[1].collect()] == [1]
    for n in ("m/a.fits", "m/deep/b.FITS", "m/c.txt"):
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text("x")
    listed = tables.expand_manifest(spark, [f"{tmp_path}/m", f"{tmp_path}/m/deep"])
    assert {r.path.rsplit("/", 1)[1]: r.ord for r in listed.collect()} == {"a.fits": 0, "b.FITS": 0}
    jobs = tables.union_jobs([("j1", df), ("j2", df.drop("DEC"))])
    assert sorted(r.job_id for r in jobs.collect()) == ["j1", "j2"]


def test_unreadable_scans_are_listed_with_their_reason(spark, tmp_path):
    spark.range(5000).selectExpr("id AS source_id", "id * 1.5D AS ra").coalesce(1).write.option("parquet.block.size", 4096).parquet(f"{tmp_path}/w")
    whole = next((tmp_path / "w").glob("*.parquet")).read_bytes()
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "good.parquet").write_bytes(whole)
    (tmp_path / "s" / "cut.parquet").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "s" / "text.parquet").write_bytes(b"nothing")
    (tmp_path / "s" / "flipped.parquet").write_bytes(whole[:60] + bytes(200) + whole[260:])
    rows, files = tables.scan_glob(spark, f"{tmp_path}/s/*.parquet", "source_id long, ra double")
    got = {r.scan_id: (r.n, r.error) for r in files.collect()}
    assert got["good.parquet"] == (5000, None) and rows.filter("scan_id = 'good.parquet'").count() == 5000
    assert all(got[n][1] and "missing" not in got[n][1] for n in ("cut.parquet", "text.parquet", "flipped.parquet")) and len(got) == 4
    named = [f"{tmp_path}/s/good.parquet", f"{tmp_path}/s/absent.parquet", f"{tmp_path}/s/text.parquet"]
    rows, files = tables.scan_glob(spark, named, "source_id long, ra double")
    got = {r.scan_id: (r.n, r.error) for r in files.collect()}
    assert got["absent.parquet"] == (0, "missing") and got["good.parquet"] == (5000, None) and got["text.parquet"][0] == 0 and rows.count() == 5000
    assert tables.scan_glob(spark, named[1:2], "source_id long")[1].count() == 1
    assert [r.scan_id for r in tables.scan_glob(spark, named, "source_id long", "skip")[1].collect()] == ["good.parquet"]


def test_a_failing_job_leaves_the_others(spark, tmp_path):
    cat = spark.createDataFrame([(1, 10.0, 5.0), (2, 20.0, 5.0)], "source_id long, ra double, dec double")
    cat.write.parquet(f"{tmp_path}/a")
    cat.drop("dec").write.parquet(f"{tmp_path}/no_dec")
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "x.parquet").write_bytes(b"junk")
    jobs = {"good": (f"{tmp_path}/a", f"{tmp_path}/a"), "absent": (f"{tmp_path}/a", f"{tmp_path}/nowhere"), "column": (f"{tmp_path}/no_dec", f"{tmp_path}/a"), "junk": (f"{tmp_path}/broken", f"{tmp_path}/a"), "again": (f"{tmp_path}/a", f"{tmp_path}/a")}
    got = {r.job: r for r in tables.match_catalogues(spark, jobs, f"{tmp_path}/out").collect()}
    assert {n: (r.ok, r.rows) for n, r in got.items()} == {"good": (True, 2), "again": (True, 2), "absent": (False, None), "column": (False, None), "junk": (False, None)}
    assert "dec" in got["column"].error and all(r.error for r in got.values() if not r.ok) and spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None
    assert spark.read.parquet(f"{tmp_path}/out/again").count() == 2


def test_positions_to_pixels(spark):
    cards = dict(CRVAL1="150.0", CRVAL2="-40.0", CRPIX1="33", CRPIX2="17", CDELT1="-0.01", CDELT2="0.01", CTYPE1="RA---TAN")
    at = lambda ra, dec, **more: one(spark, headers.sky_to_pixel(header(**{**cards, **more}), F.lit(ra), F.lit(dec)))
    assert tuple(at(150.0, -40.0)) == (32.0, 16.0)
    east, north = at(149.9, -39.9), sky.tangent_plane(F.lit(149.9), F.lit(-39.9), F.lit(150.0), F.lit(-40.0))
    xi, eta = one(spark, north[0]), one(spark, north[1])
    assert (east.x, east.y) == (pytest.approx(32 + xi / -0.01), pytest.approx(16 + eta / 0.01)) and east.x > 32 and east.y > 16
    back = sky.plane_to_sky(F.lit(xi), F.lit(eta), F.lit(150.0), F.lit(-40.0))
    assert (one(spark, back[0]), one(spark, back[1])) == (pytest.approx(149.9), pytest.approx(-39.9))
    turned = at(149.9, -39.9, CD1_1="0.0", CD1_2="0.01", CD2_1="0.01", CD2_2="0.0")
    assert (turned.x, turned.y) == (pytest.approx(32 + eta / 0.01), pytest.approx(16 + xi / 0.01))
    assert at(330.0, 40.0).x is None and abs(at(140.0, -40.0, CTYPE1="RA---SIN").x) < abs(at(140.0, -40.0).x)
    scales = lambda **c: tuple(one(spark, headers.pixel_scales(header(**c))))
    assert scales(CDELT1="-0.001", CDELT2="0.002") == (pytest.approx(3.6), pytest.approx(7.2))
    assert scales(CD1_1="0.003", CD1_2="0.004", CD2_1="0.0", CD2_2="0.001") == (pytest.approx(18.0), pytest.approx(3.6))
    assert scales(CDELT1="-4e-7", CDELT2="4e-7") == (pytest.approx(4e-7 * 206264.806247), pytest.approx(4e-7 * 206264.806247))
    assert scales(CDELT1="2", CDELT2="3", CUNIT1="arcsec") == (pytest.approx(2.0), pytest.approx(3.0)) and scales(BUNIT="Jy") == (None, None)


def test_boxes_and_map_values_from_positions(spark):
    cards = dict(CRVAL1="10.0", CRVAL2="0.0", CRPIX1="11", CRPIX2="11", CDELT1="-0.002", CDELT2="0.002")
    images = spark.range(2).select(F.concat(F.lit("i"), "id").alias("image_id"), header(**cards).alias("header"))
    pixels = spark.createDataFrame([(i, 0, x, y, None if (x, y) == (13, 10) else float(100 * x + y)) for i in ("i0", "i1") for x in range(21) for y in range(21)], "image_id string, plane int, x long, y long, value double")
    src = spark.createDataFrame([(1, "i0", 10.0, 0.0), (2, "i1", 9.9959, 0.00001), (3, "i0", 9.994, 0.0), (4, "i0", 50.0, 0.0)], "source_id int, image_id string, ra double, dec double")
    located = image.locate_sources(src, images)
    assert {r.source_id: r.map_value for r in image.map_values(located, pixels).collect()} == {1: 1010.0, 2: 1210.0, 3: None, 4: None}
    boxes = image.source_boxes(located, pixels, 30.0).groupBy("image_id", "source_id").agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("y").alias("y1")).collect()
    assert {tuple(r) for r in boxes} == {("i0", 1, 25, 8, 12), ("i1", 2, 25, 10, 12), ("i0", 3, 25, 11, 12)}
    assert image.locate_sources(src.drop("image_id"), images).count() == 8
    good = sources.good_sources(image.map_values(located, pixels).withColumns({"peak_flux": F.lit(20.0), "isl_rms": F.lit(0.5)}), flux=1e3, at_source="map_value")
    assert {r.source_id: r.good for r in good.collect()} == {1: True, 2: True, 3: False, 4: False}


def test_positions_beyond_any_pixel(spark):
    """A source a quarter turn from the image's centre projects beyond the range of integers, one on the far half is mirrored where that is asked for."""
    cards = dict(CRVAL1="31.24", CRVAL2="-44.0", CRPIX1="65", CRPIX2="65", CDELT1="-0.02", CDELT2="0.02")
    images = spark.range(1).select(F.lit("i").alias("image_id"), header(**cards).alias("header"))
    pixels = spark.createDataFrame([("i", 0, x, y, float(x)) for x in range(60, 70) for y in range(60, 70)], "image_id string, plane int, x long, y long, value double")
    src = spark.createDataFrame([(1, 31.24, -44.0), (2, 31.24, 46.0), (3, 211.24, 44.0), (4, 211.24, 44.02)], "source_id int, ra double, dec double")
    for far, held in ((False, {1: 64.0, 2: None, 3: None, 4: None}), (True, {1: 64.0, 2: None, 3: 64.0, 4: 64.0})):
        located = image.locate_sources(src, images, far)
        assert {r.source_id: r.map_value for r in image.map_values(located, pixels).collect()} == held
        boxes = image.source_boxes(located, pixels, 144.0).groupBy("source_id").count()
        assert {tuple(r) for r in boxes.collect()} == {(k, 9) for k, v in held.items() if v}


def test_sinks(spark, tmp_path):
    src = spark.createDataFrame([(1, 10.0, -1.0, 5.0, 4.0, 30.0, 2.0, 1.0, True), (2, 5.0, -2.0, 5.0, 4.0, 30.0, 3.0, 1.5, True), (3, 1.0, 0.0, 1.0, 1.0, 0.0, 1.0, 1.0, False)], "source_id long, ra double, dec double, maj double, min double, pa double, total_flux double, peak_flux double, good boolean")
    sinks.write_regions(src, f"{tmp_path}/reg")
    assert any("color=red" in r.value for r in spark.read.text(f"{tmp_path}/reg/good=false").collect())
    assert [(r.n, r.ra) for r in sources.source_list(src).orderBy("n").collect()] == [(1, 5.0), (2, 10.0)]
    kv = spark.createDataFrame([("PATH", "/" + "d" * 80 + "/f.fits"), ("LONG", "z" * 90)], "key string, value string")
    meta = {r.key: r.value for r in sinks.match_metadata(kv, kv, 1.0, "one_to_one").collect()}
    assert meta["T1_PATH"] == "f.fits" and len(meta["T2_LONG"]) == 68 and meta["XMATCH_MODE"] == "one_to_one"
    assert {r.metric: r.value for r in sinks.metrics_table(src.agg(F.count("*").alias("n")), "x").collect()} == {"n": 3.0}


def test_source_lists(spark):
    fields = spark.createDataFrame([("PKS1",), ("Alias2",), ("other",)], "name string")
    cals = spark.createDataFrame([("pks1", None, 1), ("X", "alias2", 2), ("Y", "ALIAS2", 3)], "name string, alias string, ord int")
    assert {r.name: r.calibrator for r in sources.known_calibrators(fields, cals).collect()} == {"PKS1": "pks1", "Alias2": "Y"}
    a = spark.createDataFrame([(1, 2.0), (2, 3.0)], "k int, v double")
    b = spark.createDataFrame([(2, 5.0), (3, 6.0)], "k int, v double")
    assert {tuple(r) for r in sources.zip_full(a, b, "k").collect()} == {(1, 2.0, None), (2, 3.0, 5.0), (3, None, 6.0)}
    bad = spark.createDataFrame([(-1.0, 9.0), (None, 8.0), (2.0, 7.0)], "e_total_flux double, e_fit double")
    assert [r.e_total_flux for r in sources.replace_bad_errors(bad).collect()] == [9.0, 8.0, 2.0]
