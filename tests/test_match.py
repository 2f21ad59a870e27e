"""Matching: golden catalogues, brute force, and properties."""

import math
import random

import pytest

from skyaccord.operators import match, nearest
from skyaccord.operators.clean import count_skipped

LEFT = [(1, 10.0, -20.0), (2, 10.00025, -20.0002), (3, 150.0, 45.0), (4, 220.0, 10.0)]
RIGHT = [(10, 10.0001, -20.00005), (20, 150.0003, 45.0001), (30, 310.0, -5.0)]
SCHEMA = "source_id long, ra double, dec double"


def sep(a, b):
    u, v = [(math.cos(math.radians(d)) * math.cos(math.radians(r)), math.cos(math.radians(d)) * math.sin(math.radians(r)), math.sin(math.radians(d))) for _, r, d in (a, b)]
    return math.degrees(2 * math.asin(min(1, math.dist(u, v) / 2))) * 3600


def ids(df):
    return {(r.source_id_1, r.source_id_2) for r in df.collect()}


@pytest.fixture(scope="module")
def golden(spark):
    return spark.createDataFrame(LEFT, SCHEMA), spark.createDataFrame(RIGHT, SCHEMA)


def test_golden_catalogues(golden):
    left, right = golden
    one = match.sky_match(left, right, 1.0)
    got = {r.source_id_1: r.sep_arcsec for r in one.collect()}
    assert ids(one) == {(1, 10), (3, 20)}
    assert got[1] == pytest.approx(0.383197, abs=1e-6) and got[3] == pytest.approx(0.844274, abs=1e-6)
    assert ids(match.sky_match(left, right, 2.0, "one_to_many")) == {(1, 10), (2, 10), (3, 20)}
    assert {r.source_id for r in match.unmatched(left, one, 1).collect()} == {2, 4}
    assert {r.source_id for r in match.unmatched(right, one, 2).collect()} == {30}
    assert tuple(match.match_summary(left, right, one).first()) == (2, 4, 3, 2, 1)


@pytest.mark.parametrize("radius", [1.0, 40.0, 3600.0, 40 * 3600.0, 170 * 3600.0])
def test_pairs_equal_brute_force_anywhere_on_the_sphere(spark, radius):
    rng = random.Random(1)
    base = [(0.0, 90.0), (0.0, -90.0), (359.9999, 0.0), (0.0001, 0.0), (180.0, 89.9999), (120.0, -45.0)]
    points = [(k, (base[k % 6][0] + rng.gauss(0, radius / 3600)) % 360, max(-90.0, min(90.0, base[k % 6][1] + rng.gauss(0, radius / 3600)))) for k in range(120)]
    left, right = points[:60], points[60:]
    got = ids(match.pairs_within(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), radius))
    want = {(a[0], b[0]) for a in left for b in right if sep(a, b) <= radius}
    edge = {(a[0], b[0]) for a in left for b in right if abs(sep(a, b) - radius) < 1e-6 * radius}
    assert got - edge == want - edge and want


def test_one_to_one_is_an_injection_and_greedy(spark):
    rng = random.Random(2)
    make = lambda n: [(k, 30 + rng.random() * 0.003, -30 + rng.random() * 0.003) for k in range(n)]
    left, right = make(60), make(50)
    got = ids(match.sky_match(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), 2.0))
    near = sorted((min((sep(a, b), b[0]) for b in right), a[0]) for a in left)
    used, want = set(), set()
    for (s, b), a in near:
        if s <= 2.0 and b not in used:
            used.add(b)
            want.add((a, b))
    assert got == want and len({b for _, b in got}) == len(got)


def test_nearest_at_any_distance(spark):
    rng = random.Random(3)
    left = [(k, rng.random() * 360, rng.uniform(-90, 90)) for k in range(40)] + [(99, 10.0, 10.0)]
    right = [(k, rng.random() * 20, rng.uniform(-10, 10)) for k in range(10)] + [(50, 10.0, 10.00001)]
    got = ids(match.nearest(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)))
    assert got == {(a[0], min(right, key=lambda b: sep(a, b))[0]) for a in left}


def test_nearest_between_disjoint_areas(spark, monkeypatch):
    """Most sources lie far from the other catalogue; cells must keep the nearest, and few others."""
    rng = random.Random(4)
    left = [(k, rng.random() * 360, math.degrees(math.asin(rng.uniform(-1, 1)))) for k in range(150)] + [(200, 0.0, 90.0), (201, 123.0, -90.0), (202, 359.9999, 0.0)]
    right = [(k, rng.uniform(100, 103), rng.uniform(40, 43)) for k in range(150)] + [(k, rng.uniform(-1, 1) % 360, rng.uniform(-1, 1)) for k in range(300, 340)] + [(400, 10.0, 89.0)]
    a, b = spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)
    want = {p[0]: min(sep(p, q) for q in right) for p in left}
    got = {r.source_id_1: r.sep_arcsec for r in match.nearest(a, b).collect()}
    assert got == pytest.approx(want, rel=1e-9)
    monkeypatch.setattr(match, "ENOUGH", 20)
    monkeypatch.setattr(match, "ENOUGH_IN_ALL", 0)
    assert {r.source_id_1: r.sep_arcsec for r in match.nearest(a, b).collect()} == pytest.approx(want, rel=1e-9)
    candidates = match._pairs_by_cells(a, b, "ra", "dec").count()
    assert len(left) <= candidates < 0.1 * len(left) * len(right)


def test_nearest_of_crowds_forms_few_pairs(spark, monkeypatch):
    """A crowd within one arcsecond, one at a pole, many at one position, repeated ids and sources far from all: nearest ones right, and not all pairs of a crowd."""
    rng = random.Random(8)
    crowd = lambda n, at: [(at + k, 10 + rng.random() * 3e-4, 10 + rng.random() * 3e-4) for k in range(n)]
    pole = lambda n, at: [(at + k, rng.random() * 360, 90 - rng.random() * 1e-3) for k in range(n)]
    left = crowd(200, 0) + pole(60, 300) + [(k, rng.random() * 360, rng.uniform(-90, 90)) for k in range(400, 440)] + [(0, 200.0, -40.0), (500, 40.0, 1.0)]
    right = crowd(200, 0) + pole(60, 300) + [(k, 40.0, 1.0) for k in range(699, 599, -1)] + [(k, rng.uniform(0, 90), rng.uniform(-20, 80)) for k in range(700, 760)]
    a, b = spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)
    want = {}
    for p in left:
        want[p[0]] = min(want.get(p[0], math.inf), min(sep(p, q) for q in right))
    for limits in ({}, {"CELL": 30, "SAMPLED": 4, "BLOCK": 25}, {"CELL": 30, "SAMPLED": 4, "MANY": 3}):
        for name, value in limits.items():
            monkeypatch.setattr(nearest, name, value)
        rows = match.nearest(a, b).collect()
        assert {r.source_id_1: r.sep_arcsec for r in rows} == pytest.approx(want, rel=1e-7, abs=1e-9) and len(rows) == len(want)
        assert next(r for r in rows if r.source_id_1 == 500).source_id_2 == 600
        pairs, rest = nearest.nearest_pairs(a, b, "source_id", "ra", "dec")
        assert pairs.count() <= 4 * len(left) and bool(rest.count()) == ("MANY" in limits)
        monkeypatch.undo()


def test_bad_coordinates_match_nothing(spark):
    df = spark.createDataFrame([(1, None, 0.0), (2, float("nan"), 0.0), (3, 1.0, float("inf")), (4, 1.0, 1.0)], SCHEMA)
    assert ids(match.sky_match(df, df, 1.0)) == {(4, 4)}
    assert tuple(count_skipped(df).first()) == (1, 3)
    empty = spark.createDataFrame([], SCHEMA)
    assert match.sky_match(df, empty, 1.0).count() == 0 and match.nearest(df, empty).count() == 0


def test_jobs_do_not_mix(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0, "a"), (2, 1.0, 1.0, "b")], SCHEMA + ", job_id string")
    assert ids(match.sky_match(df, df, 1.0, keys=["job_id"])) == {(1, 1), (2, 2)}


@pytest.mark.parametrize("radius,spread,crowded,block", [(1.0, 4.0, 30, 1000), (1.0, 1.0, 10, 7), (5.0, 200.0, 20, 10), (30 * 3600.0, 90 * 3600.0, 15, 6)])
def test_crowded_cells_give_the_same_pairs(spark, radius, spread, crowded, block):
    """A crowd at RA 0, one at a pole and single sources, with two jobs; cells split, and the finest dealt to blocks."""
    rng = random.Random(7)

    def points(n):
        out = []
        for k in range(n):
            ra, dec = (0.0, 10.0) if k % 3 else (50.0, 89.999)
            if k % 10 == 0:
                ra, dec = rng.random() * 360, rng.uniform(-80, 80)
            out.append((k, (ra + rng.uniform(-1, 1) * spread / 3600) % 360, max(-90.0, min(90.0, dec + rng.uniform(-1, 1) * spread / 3600)), "ab"[k % 2]))
        return out + [(n + k, 0.0, 10.0, "a") for k in range(20)]

    left, right = points(150), points(200)
    make = lambda rows: spark.createDataFrame(rows, SCHEMA + ", job string").repartition(3)
    got = match.pairs_within(make(left), make(right), radius, ["job"], crowded=crowded, block=block).collect()
    found = {(r.source_id_1, r.source_id_2) for r in got}
    assert len(found) == len(got)
    want = {(a[0], b[0]) for a in left for b in right if a[3] == b[3] and sep(a[:3], b[:3]) <= radius}
    edge = {(a[0], b[0]) for a in left for b in right if abs(sep(a[:3], b[:3]) - radius) < 1e-6 * radius}
    assert found - edge == want - edge and len(want) > 20


def test_no_key_of_the_join_gets_a_crowd(spark):
    """10^5 sources of a field inside one plain cell, and 3,000 at one point: bounded keys, and the pairs of brute force."""
    from pyspark.sql import functions as F

    field = spark.range(100_000).select(F.col("id").alias("source_id"), (F.lit(40.0) + F.rand(1) * 0.002).alias("ra"), (F.lit(-30.0) + F.rand(2) * 0.002).alias("dec"))
    point = spark.range(3000).select((F.col("id") + 200_000).alias("source_id"), F.lit(40.001).alias("ra"), F.lit(-30.001).alias("dec"))
    right = field.unionByName(point)
    left = right.filter("source_id % 40 = 0")
    crowded, block = 2_000, 500
    a, b, meet = match.meeting(left, right, 1.0, [], "ra", "dec", crowded, block)
    plain = match.meeting(left, right, 1.0, [], "ra", "dec", 10**9, block)[1]
    biggest = lambda df, k, names: df.groupBy(*[f"{c}_{k}" for c in names]).count().agg(F.max("count")).first()[0]
    assert biggest(plain, 2, ["__x", "__y", "__z"]) > 20_000
    assert biggest(b, 2, meet) <= crowded and biggest(a, 1, meet) <= crowded
    got = match.pairs_within(left, right, 1.0, crowded=crowded, block=block)
    import numpy as np

    rows = np.array([tuple(r) for r in right.select("source_id", "ra", "dec").collect()])
    x = np.stack([np.cos(np.radians(rows[:, 2])) * np.cos(np.radians(rows[:, 1])), np.cos(np.radians(rows[:, 2])) * np.sin(np.radians(rows[:, 1])), np.sin(np.radians(rows[:, 2]))], axis=1)
    limit = (2 * math.sin(math.radians(1 / 3600) / 2)) ** 2
    mine = x[rows[:, 0] % 40 == 0]
    want = sum(int((((m - x) ** 2).sum(axis=1) <= limit).sum()) for m in mine)
    assert abs(got.count() - want) <= 1e-5 * want


def test_calibrators_outside_the_limit_are_listed(spark):
    s = "name string, source_id long, ra double, dec double"
    targets = spark.createDataFrame([("t", 1, 10.0, 0.0), ("c1", 2, 12.0, 0.0), ("far", 3, 100.0, 0.0), ("c3", 4, 250.0, 0.0)], s)
    cals = spark.createDataFrame([("c1", 1, 12.0, 0.0), ("c2", 2, 200.0, 0.0), ("c3", 3, 250.0, 0.0)], s)
    got = {(r.target, r.calibrator, round(r.sep_deg, 6), r.inside) for r in match.calibrators_within(targets, cals, outside=True).collect()}
    assert got == {("t", "c1", 2.0, True), ("c1", "c3", 122.0, False), ("far", "c1", 88.0, False), ("c3", "c2", 50.0, False), ("t", "c3", 120.0, False)}


def test_calibrators(spark):
    s = "name string, source_id long, ra double, dec double"
    targets = spark.createDataFrame([("t", 1, 10.0, 0.0), ("c1", 2, 12.0, 0.0)], s)
    cals = spark.createDataFrame([("c1", 1, 12.0, 0.0), ("c2", 2, 200.0, 0.0)], s)
    got = match.calibrators_within(targets, cals).collect()
    assert [(r.target, r.calibrator) for r in got] == [("t", "c1")] and got[0].sep_deg == pytest.approx(2.0)


def test_calibrator_summary_equals_the_pairs_without_making_them(spark, monkeypatch):
    from pyspark.sql import functions as F

    k = F.col("id")
    place = lambda n, names: spark.range(n).select(F.concat(F.lit("s"), (k % names).cast("string")).alias("name"), (k % 6 * 4.0).alias("ra"), (k % 5 * 3.0).alias("dec"))
    targets, cals = place(300, 70), place(45, 35).unionByName(spark.createDataFrame([("s3", 90.0, 50.0), (None, 0.0, 0.0), ("s1", None, 1.0)], "name string, ra double, dec double"))
    pairs = match.calibrators_within(targets, cals, 5.0)
    want = {r[0]: tuple(r[1:]) for r in pairs.groupBy("target").agg(F.count("*"), F.min("sep_deg"), F.max("sep_deg")).collect()}
    sizes = []
    monkeypatch.setattr(match, "pairs_within", lambda a, b, r, run=match.pairs_within: sizes.append((a.count(), b.count())) or run(a, b, r))
    got = {r.target: (r.n, r.closest, r.farthest) for r in match.calibrator_summary(targets, cals, 5.0).collect()}
    assert got.keys() == want.keys() and all(got[t] == pytest.approx(want[t], abs=1e-9) for t in want)
    assert sizes[0][0] < 110 and sizes[0][1] <= 31
