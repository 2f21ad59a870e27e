"""The FITS source against arrays packed by hand: ranges, types, blanks, gzip, broken files, written tables."""

import gzip
import struct

import numpy as np
import pytest

from skyaccord.sources import fits, sinks, tables
from tests.test_sources_functions import unit


def image_cards(bitpix, *axes, **more):
    return ["SIMPLE  = T", f"BITPIX  = {bitpix}", f"NAXIS   = {len(axes)}", *[f"NAXIS{i + 1}  = {n}" for i, n in enumerate(axes)], *[f"{k:<8}= {v}" for k, v in more.items()]]


def table_cards(width, rows, columns, heap=0, **more):
    cards = ["XTENSION= 'BINTABLE'", "BITPIX  = 8", "NAXIS   = 2", f"NAXIS1  = {width}", f"NAXIS2  = {rows}", f"PCOUNT  = {heap}", "GCOUNT  = 1", f"TFIELDS = {len(columns)}"]
    for i, (name, form) in enumerate(columns, 1):
        cards += [f"{f'TTYPE{i}':<8}= '{name}'", f"{f'TFORM{i}':<8}= '{form}'"]
    return cards + [f"{k:<8}= {v}" for k, v in more.items()]


EMPTY_UNIT = unit(["SIMPLE  = T", "BITPIX  = 8", "NAXIS   = 0"])


def pixels_of(df):
    return {(r.plane, r.y, r.x): r.value for r in df.collect() if r.error is None}


def test_a_cube_is_read_in_ranges_and_equals_the_array(spark, tmp_path):
    cube = np.random.default_rng(1).normal(size=(5, 40, 31)).astype(">f4")
    cube[2, 3, 4] = np.nan
    (tmp_path / "c.fits").write_bytes(unit(image_cards(-32, 31, 40, 5), cube.tobytes()))
    for size in (997, 5000, 1 << 20):
        _, pixels = fits.read_image_pixels(spark, f"{tmp_path}/*.fits", range_bytes=size)
        assert pixels.rdd.getNumPartitions() == -(-(tmp_path / "c.fits").stat().st_size // size)
        got = pixels_of(pixels)
        assert len(got) == cube.size
        assert all((v is None) == bool(np.isnan(cube[k])) and (v is None or v == float(cube[k])) for k, v in got.items())


def test_only_wanted_planes_and_columns_are_read(spark, tmp_path, monkeypatch):
    cube = np.arange(20 * 64 * 64, dtype=">i4").reshape(20, 64, 64)
    (tmp_path / "c.fits").write_bytes(unit(image_cards(32, 64, 64, 20), cube.tobytes()))
    _, pixels = fits.read_image_pixels(spark, str(tmp_path), planes=[3, 17, 40], range_bytes=30_000)
    got = pixels_of(pixels)
    assert {k[0] for k in got} == {3, 17} and all(v == cube[k] for k, v in got.items()) and len(got) == 2 * 64 * 64
    read = []
    plain = fits.Bytes.read
    monkeypatch.setattr(fits.Bytes, "read", lambda self, at, n: read.append(n) or plain(self, at, n))
    from pyspark.sql.types import StructType

    reader = fits.FitsImageReader({"path": str(tmp_path), "planes": "[3]"}, StructType.fromDDL("value double"))
    out = [b for part in reader.partitions() for b in reader.read(part)]
    assert sum(b.num_rows for b in out) == 64 * 64 and out[0].schema.names == ["value"] and sum(read) < 64 * 64 * 4 + 4 * fits.BLOCK


def test_blanked_and_scaled_whole_numbers(spark, tmp_path):
    raw = np.array([[-32768, 0, 5], [7, -1, -32768]], ">i2")
    (tmp_path / "b.fits").write_bytes(unit(image_cards(16, 3, 2, BLANK=-32768, BSCALE=0.5, BZERO=10), raw.tobytes()))
    _, pixels = fits.read_image_pixels(spark, f"{tmp_path}/b.fits")
    assert pixels_of(pixels) == {(0, 0, 0): None, (0, 0, 1): 10.0, (0, 0, 2): 12.5, (0, 1, 0): 13.5, (0, 1, 1): 9.5, (0, 1, 2): None}


def test_gzip_is_known_by_its_bytes(spark, tmp_path):
    cube = np.arange(3 * 50 * 40, dtype=">f8").reshape(3, 50, 40)
    whole = unit(image_cards(-64, 40, 50, 3), cube.tobytes())
    (tmp_path / "a.fits.gz").write_bytes(gzip.compress(whole[:7000]) + gzip.compress(whole[7000:]))  # two members
    (tmp_path / "b.fits").write_bytes(gzip.compress(whole))  # no suffix tells
    images, pixels = fits.read_image_pixels(spark, str(tmp_path), planes=[0, 2])
    rows = pixels.collect()
    assert len(rows) == 2 * 2 * 50 * 40 and all(r.error is None and r.value == cube[r.plane, r.y, r.x] for r in rows)
    assert sorted(r.path.rsplit("/", 1)[1] for r in images.collect() if r.header["NAXIS3"] == "3") == ["a.fits.gz", "b.fits"]


def test_bad_images_are_rows_with_their_error(spark, tmp_path):
    good = np.ones((2, 2), ">f4")
    (tmp_path / "good.fits").write_bytes(unit(image_cards(-32, 2, 2), good.tobytes()))
    (tmp_path / "kind.fits").write_bytes(unit(image_cards(24, 2, 2), b"\0" * 12))
    (tmp_path / "text.fits").write_bytes(b"not an image " * 400)
    (tmp_path / "none.fits").write_bytes(EMPTY_UNIT)
    (tmp_path / "empty.fits").write_bytes(b"")
    cube = np.arange(4 * 30 * 30, dtype=">f4").reshape(4, 30, 30)
    (tmp_path / "short.fits").write_bytes(unit(image_cards(-32, 30, 30, 4), cube.tobytes())[: 2880 + 30 * 30 * 4 * 2 + 50])
    (tmp_path / "bad.fits.gz").write_bytes(gzip.compress(unit(image_cards(-32, 30, 30, 4), cube.tobytes()))[:300])
    for size in (2000, 1 << 20):
        images, pixels = fits.read_image_pixels(spark, str(tmp_path), range_bytes=size)
        rows = pixels.collect()
        errors = {r.path.rsplit("/", 1)[1]: r.error for r in rows if r.error}
        assert set(errors) == {"kind.fits", "text.fits", "none.fits", "empty.fits", "short.fits", "bad.fits.gz"}, errors
        assert "24" in errors["kind.fits"] and "row 60" in errors["short.fits"]
        short = {(r.plane, r.y, r.x): r.value for r in rows if r.path.endswith("short.fits") and not r.error}
        assert len(short) == 60 * 30 and all(v == cube[k] for k, v in short.items())
        assert sum(r.path.endswith("good.fits") for r in rows) == 4
        assert sum(r.error is not None for r in rows) == 6
        assert {r.path.rsplit("/", 1)[1] for r in images.collect() if r.error is None and r.header} >= {"good.fits", "short.fits"}


def test_every_type_of_column(spark, tmp_path):
    heap = struct.pack(">3d", 1.5, 2.5, float("nan")) + struct.pack(">2h", 7, 8) + b"abc"
    rows = b""
    for k in range(3):
        rows += struct.pack(">c", b"TF\0"[k : k + 1]) + bytes([0b10100000]) + struct.pack(">BhiqfdffIddiiiiqq", 200 + k, k, k - 1, 1 << 40, 0.5 * k, 0.25, 1.0, -k, k, 2.0, 3.0, 3 if k == 1 else 0, 0, 2, 24, 3, 28)
    width = len(rows) // 3
    columns = [("flag", "L"), ("bits", "3X"), ("byte", "B"), ("short", "I"), ("int", "J"), ("long", "K"), ("float", "E"), ("double", "D"), ("complex", "C"), ("unsigned", "J"), ("wide", "M"), ("list", "PD(3)"), ("shorts", "PI(2)"), ("text", "QA(3)")]
    cards = table_cards(width, 3, columns, len(heap), TSCAL4=0.1, TZERO4=5, TNULL5=0, TZERO10=2147483648, TNULL3=201)
    (tmp_path / "t.fits").write_bytes(EMPTY_UNIT + unit(cards, rows + heap))
    (tmp_path / "t.fits.gz").write_bytes(gzip.compress(EMPTY_UNIT + unit(cards, rows + heap)))
    wanted = {"FLAG": "boolean", "bits": "array<boolean>", "byte": "int", "short": "double", "int": "int", "long": "long", "float": "double", "double": "double", "complex": "array<double>", "unsigned": "long", "wide": "array<double>", "list": "array<double>", "shorts": "array<long>", "text": "string", "absent": "string"}
    got = fits.ingest_tables(spark, str(tmp_path), wanted, range_bytes=2900).collect()
    assert [r.error for r in got] == [None] * 6
    for name in ("t.fits", "t.fits.gz"):
        mine = sorted((r for r in got if r.path.endswith("/" + name)), key=lambda r: r.double and r.float)
        assert [r.FLAG for r in mine] == [True, False, None] and all(r.bits == [True, False, True] for r in mine)
        assert [r.byte for r in mine] == [200, None, 202] and [r.short for r in mine] == pytest.approx([5.0, 5.1, 5.2])
        assert [r.int for r in mine] == [-1, None, 1] and {r.long for r in mine} == {1 << 40} and [r.float for r in mine] == [0, 0.5, 1.0]
        assert [r.complex for r in mine] == [[1.0, 0.0], [1.0, -1.0], [1.0, -2.0]] and [r.unsigned for r in mine] == [2147483648 + k for k in range(3)]
        assert all(r.wide == [2.0, 3.0] and r.shorts == [7, 8] and r.text == "abc" and r.absent is None for r in mine)
        assert [r.list for r in mine] == [[], [1.5, 2.5, None], []]


def test_table_ranges_hold_each_row_once(spark, tmp_path):
    n = 5000
    data = np.zeros(n, [("a", ">i8"), ("v", ">f4", (3,)), ("s", "S5")])
    data["a"], data["v"], data["s"] = np.arange(n), np.arange(3 * n).reshape(n, 3), [f"r{k % 1000}" for k in range(n)]
    columns = [("A", "K"), ("V", "3E"), ("S", "5A")]
    (tmp_path / "t.fits").write_bytes(EMPTY_UNIT + unit(table_cards(data.dtype.itemsize, n, columns), data.tobytes()))
    (tmp_path / "u.fits").write_bytes((EMPTY_UNIT + unit(table_cards(data.dtype.itemsize, n, columns), data.tobytes()))[:50_000])
    df = fits.ingest_tables(spark, f"{tmp_path}/*.fits", {"a": "long", "v": "array<double>", "s": "string"}, range_bytes=7001)
    rows = df.collect()
    whole = sorted((r for r in rows if r.path.endswith("t.fits")), key=lambda r: r.a)
    assert [(r.a, r.v, r.s) for r in whole] == [(k, [3.0 * k, 3.0 * k + 1, 3.0 * k + 2], f"r{k % 1000}") for k in range(n)]
    cut = [r for r in rows if r.path.endswith("u.fits")]
    assert sum(r.error is not None for r in cut) == 1 and sorted(r.a for r in cut if r.error is None) == list(range(len(cut) - 1))


def test_headers_of_all_units(spark, tmp_path):
    cards = ["SIMPLE  = T", "BITPIX  = 8", "NAXIS   = 0", "HIERARCH T1_OBSERVER = 'Ann O''Hara'", "LONG    = 'begin &'", "CONTINUE  'and end' / note", "HISTORY one", "HISTORY two"]
    (tmp_path / "h.fits").write_bytes(unit(cards) + unit(["XTENSION= 'IMAGE'", "BITPIX  = 8", "NAXIS   = 1", "NAXIS1  = 2"], b"ab"))
    (tmp_path / "x.fits").write_bytes(b"SIMPLE  =" + b" " * 500)
    rows = fits.read_headers(spark, str(tmp_path)).collect()
    first, second = sorted((r for r in rows if r.error is None), key=lambda r: r.unit)
    assert (first.kind, second.kind) == ("other", "image") and first.header["T1_OBSERVER"] == "Ann O'Hara" and first.header["LONG"] == "begin and end" and first.header["HISTORY"] == "one\ntwo"
    assert [r.path.rsplit("/", 1)[1] for r in rows if r.error] == ["x.fits"]


def test_written_tables_come_back_with_all_their_values(spark, tmp_path, monkeypatch):
    rows = [(k, k / 3 if k % 4 else None, None if k % 5 == 0 else k, f"s{k}" if k % 3 else None, k % 2 == 0, float(k)) for k in range(500)]
    df = spark.createDataFrame(rows, "id long, v double, n int, s string, b boolean, f float").repartition(3)
    values = {"RADIUS": "1.0", "T1_INPUT_CATALOGUE": "/data/" + "deep/" * 20 + "a.fits", "T2_NOTE": "it's \"long\" | " + "z " * 90, "T1_BLANKS": "x" * 66 + " " * 40 + "y"}
    out = f"{tmp_path}/out"
    fits.write_table(df, out, values)
    got = fits.ingest_tables(spark, out, {"id": "long", "v": "double", "n": "int", "s": "string", "b": "boolean", "f": "double"}, range_bytes=4000).collect()
    assert sorted((r.id, r.v, r.n, r.s or None, r.b, r.f) for r in got) == [(*r[:5], r[5]) for r in rows]
    header = got[0].header
    assert header["RADIUS"] == "1.0" and header["T1_INPUT_CATALOGUE"] == "a.fits" and len(header["T2_NOTE"]) < 68
    assert {k: fits.full_values(header)[k] for k in values} == values
    assert not list((tmp_path / "out").glob("*.writing"))
    fits.write_table(df.limit(10), out, mode="overwrite")
    assert fits.ingest_tables(spark, out, {"id": "long"}).count() == 10
    with pytest.raises(Exception, match="no form"):
        fits.write_table(spark.createDataFrame([([1],)], "a array<int>"), f"{tmp_path}/bad")
    assert not list((tmp_path / "bad").glob("*.fits"))


def test_files_by_folder_glob_and_scheme(tmp_path):
    for n in ("a.fits", "deep/b.FITS", "deep/c.txt", "deep/er/d.fit.gz"):
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text("x")
    names = lambda p: [f.rsplit("/", 1)[1] for f, _ in fits.find_files(p)]
    assert names(str(tmp_path)) == ["a.fits", "b.FITS", "d.fit.gz"] and names(f"{tmp_path}/*.fits") == ["a.fits"]
    assert names(f"{tmp_path}/*/*.txt") == ["c.txt"] and names(f"file:{tmp_path}/a.fits") == ["a.fits"] and names(f"{tmp_path}/no*.fits") == []
    with pytest.raises(FileNotFoundError):
        fits.find_files(f"{tmp_path}/absent.fits")
    parts = fits.plan_ranges([("a", 10), ("b", 10), ("c", 95), ("d.gz", 300), ("e", 5)], 30)
    assert [p.parts for p in parts][:5] == [[("c", 0, 30, False)], [("c", 30, 60, False)], [("c", 60, 90, False)], [("c", 90, 95, True)], [("a", 0, 10, True), ("b", 0, 10, True)]]
    assert sorted(x for p in parts for x, *_ in p.parts) == ["a", "b", "c", "c", "c", "c", "d.gz", "e"]


def test_matches_as_binary_tables_with_their_metadata(spark, tmp_path):
    matches = spark.createDataFrame([(k, k + 100, float((k * 7) % 10)) for k in range(10)], "source_id_1 long, source_id_2 long, sep_arcsec double").repartition(4)
    long = "no slash but " * 12
    header = spark.createDataFrame([("INPUT", "/" + "d" * 80 + "/f.fits"), ("NOTE", long), ("EMPTY", None)], "key string, value string")
    meta = sinks.match_metadata(header, header, 2.0, "one_to_one")
    cut = {(r.key, r.value) for r in meta.collect()}
    assert ("T1_INPUT", "f.fits") in cut and ("T2_NOTE", long[:68]) in cut and ("HISTORY", f"T2_NOTE = {long}") in cut
    whole = {r.key: r.value for r in sinks.full_metadata(meta).collect()}
    assert whole["T1_NOTE"] == long and whole["T2_INPUT"] == "/" + "d" * 80 + "/f.fits" and whole["T1_EMPTY"] is None
    sinks.write_match(matches, meta, f"{tmp_path}/m", "fits")
    got = fits.ingest_tables(spark, f"{tmp_path}/m/matches", {"source_id_1": "long", "sep_arcsec": "double"}).collect()
    assert {(r.source_id_1, r.sep_arcsec) for r in got} == {(k, float((k * 7) % 10)) for k in range(10)}
    assert got[0].header["T1_INPUT"] == "f.fits" and fits.full_values(got[0].header)["T2_NOTE"] == long and got[0].header["XMATCH_MAX_ERROR_ARCSEC"] == "2.0"


def test_fixed_width_tables_are_read_back(spark, tmp_path):
    rows = [(k, -k / 7, f"name {k}" if k % 3 else None, k % 2) for k in range(1, 60)]
    df = spark.createDataFrame(rows, "n long, ra double, a_long_column_name string, k int").repartitionByRange(3, "n").sortWithinPartitions("n")
    sinks.write_fixed_width(df, f"{tmp_path}/t", {"INIMAGE": "x.fits", "FREQ0": "1.4e9"})
    got, notes = tables.read_ipac(spark, f"{tmp_path}/t")
    assert {(r.key, r.value) for r in notes.collect()} == {("INIMAGE", "x.fits"), ("FREQ0", "1.4e9")}
    found = [r.row for r in got.collect() if r.row["n"] != "long"]
    assert sorted((int(r["n"]), float(r["ra"]), None if r["a_long_column_name"] == "null" else r["a_long_column_name"], int(r["k"])) for r in found) == [(n, round(v, 6), s, k) for n, v, s, k in rows]
    lines = (next((tmp_path / "t" / "part=0").glob("*.txt"))).read_text().splitlines()
    assert lines[0].startswith("\\INIMAGE") and lines[2].startswith("|n ") and len({len(x) for x in lines[2:]}) == 1
    good = spark.createDataFrame([(1, 10.0, -1.0, 2.0, 1.0, True), (2, 3.0, 4.0, 5.0, 6.0, True), (3, 1.0, 1.0, 1.0, 1.0, False)], "source_id long, ra double, dec double, total_flux double, peak_flux double, good boolean")
    sinks.write_source_list(good, f"{tmp_path}/list", "ipac", {"INIMAGE": "y"})
    listed = [r.row for r in tables.read_ipac(spark, f"{tmp_path}/list")[0].collect() if r.row["n"] not in ("long", "int")]
    assert [(r["n"], r["ra"]) for r in sorted(listed, key=lambda r: r["n"])] == [("1", "3.000000"), ("2", "10.000000")]
