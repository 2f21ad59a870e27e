"""Spherical matching of source catalogues.

Unit vectors are put in cells of a 3-D grid (no special case at the poles or at RA 0). One side has one cell
for each source; the other is repeated for the few cells that its search sphere touches. An equi-join on the
cells gives the candidates, each pair once, and the exact separation decides. Where counted sources crowd a cell it
is split into nested cells, and what still crowds the finest is dealt out as pairs of blocks, so no task has a whole field.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyaccord.functions.sky import ang_sep_arcsec, offsets_flat, unit_vector
from skyaccord.lineage import stored
from skyaccord.operators.clean import suffix_columns, valid_coords
from skyaccord.operators.nearest import nearest_pairs

HALF_TURN_ARCSEC = 180 * 3600.0


#: Right sources of a cell beyond which it is split, and sources of a block of a finest cell.
CROWDED, BLOCK = 20_000, 5_000
#: Halvings of the finest cell's edge: coarse cells only to find crowds cheaply, cells of the plain join, and the cells within them.
_FIND, _PLAIN = (9, 6), 3
#: Rows of a table of crowded cells up to which it is broadcast.
FEW_CELLS = 200_000

_AXES = "xyz"


def _few(cells: DataFrame) -> DataFrame:
    return F.broadcast(cells) if cells.count() <= FEW_CELLS else cells


def _on(keys: Sequence[str], side: int, shift: int = 0, to: str = "h") -> list[Column]:
    """Rows of a side in the cells (__hx, __hy, __hz) of a table, and agreeing in the keys."""
    return [F.shiftright(f"__{a}{side}", shift) == F.col(f"__{to}{a}") for a in _AXES] + [F.col(f"`{k}_{side}`") == F.col(f"__h_{k}") for k in keys]


def crowded_cells(right: DataFrame, keys: Sequence[str], limit: int) -> dict[int, DataFrame]:
    """{halvings: (__hx, __hy, __hz, __h_key..., __n)}: the cells of the plain grid and of the grids within it that hold over `limit` rows.

    Coarse cells are counted first, where partial sums meet few keys; a finer grid is counted only inside crowded cells, so
    without a crowd this is one small aggregate.
    """
    found: dict[int, DataFrame] = {}
    rows = right
    for shift in (*_FIND, *range(_PLAIN, -1, -1)):
        cells = [F.shiftright(f"__{a}2", shift).alias(f"__h{a}") for a in _AXES] + [F.col(f"`{k}_2`").alias(f"__h_{k}") for k in keys]
        heavy = stored(rows.groupBy(*cells).agg(F.count("*").alias("__n")).filter(F.col("__n") > limit))
        if not heavy.limit(1).count():
            break
        if shift <= _PLAIN:
            found[shift] = heavy
        rows = right.join(_few(heavy), _on(keys, 2, shift), "left_semi")
    return found


def _touched(shift: int, inside: bool) -> Column:
    """Cells (x, y, z, level) of a grid that a left row's range of finest cells touches, all or only those in its present cell."""

    def along(a: str) -> Column:
        low, high = F.shiftright(f"__low{a}", shift), F.shiftright(f"__high{a}", shift)
        if inside:
            low, high = F.greatest(low, 2 * F.col(f"__at.{a}")), F.least(high, 2 * F.col(f"__at.{a}") + 1)
        return F.sequence(low, high)

    return F.flatten(F.transform(along("x"), lambda x: F.flatten(F.transform(along("y"), lambda y: F.transform(along("z"), lambda z: F.struct(x.alias("x"), y.alias("y"), z.alias("z"), F.lit(shift).alias("level")))))))


def _down(df: DataFrame, heavy: DataFrame, on: list[Column], below: Column) -> DataFrame:
    """Rows whose present cell is crowded go on to the cells below."""
    return df.join(heavy.withColumn("__heavy", F.lit(True)), on, "left").withColumn("__next", F.when(F.col("__heavy"), below).otherwise(F.array("__at"))).drop(*heavy.columns, "__heavy", "__at").withColumn("__at", F.explode("__next")).drop("__next")


def _nested(a: DataFrame, b: DataFrame, heavy: dict[int, DataFrame], keys: Sequence[str], block: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with __at, the cell in which they meet: the coarsest that is not crowded, or a pair of blocks of a crowded finest one."""
    for shift in sorted((k for k in heavy if k), reverse=True):
        cells = _few(heavy[shift])
        for side in (1, 2):
            df = a if side == 1 else b
            on = [F.col(f"__at.{x}") == F.col(f"__h{x}") for x in _AXES] + [F.col("__at.level") == shift] + [F.col(f"`{k}_{side}`") == F.col(f"__h_{k}") for k in keys]
            own = F.array(F.struct(*[F.shiftright(f"__{x}2", shift - 1).alias(x) for x in _AXES], F.lit(shift - 1).alias("level")))
            df = _down(df, cells, on, _touched(shift - 1, True) if side == 1 else own)
            a, b = (df, b) if side == 1 else (a, df)
    if 0 not in heavy:
        return (df.withColumns({"__block1": F.lit(0), "__block2": F.lit(0)}) for df in (a, b))
    # Each side of a crowded finest cell is dealt to blocks; a row meets every block of the other side.
    sides = [df.withColumn("__salt", F.monotonically_increasing_id()) for df in (a, b)]
    at = [F.col(f"__at.{x}") == F.col(f"__h{x}") for x in _AXES] + [F.col("__at.level") == 0]
    full = heavy[0]
    left = a.filter("__at.level = 0").groupBy(*[F.col(f"__at.{x}").alias(f"__h{x}") for x in _AXES], *[F.col(f"`{k}_1`").alias(f"__h_{k}") for k in keys]).agg(F.count("*").alias("__m"))
    full = _few(stored(full.join(left, [f"__h{x}" for x in _AXES] + [f"__h_{k}" for k in keys])))
    out = []
    for side, df in ((1, sides[0]), (2, sides[1])):
        blocks = {k: F.ceil(F.col(n) / block).cast("int") for k, n in ((1, "__m"), (2, "__n"))}
        df = df.join(full, at + [F.col(f"`{k}_{side}`") == F.col(f"__h_{k}") for k in keys], "left")
        own = F.coalesce(F.pmod(F.xxhash64("__salt"), blocks[side]).cast("int"), F.lit(0))
        other = F.explode(F.sequence(F.lit(0), F.coalesce(blocks[3 - side], F.lit(1)) - 1))
        out.append(df.withColumn(f"__block{side}", own).withColumn(f"__block{3 - side}", other).drop(*full.columns, "__salt"))
    return out[0], out[1]


def pairs_within(left: DataFrame, right: DataFrame, radius_arcsec: float, keys: Sequence[str] = (), ra: str = "ra", dec: str = "dec", crowded: int = CROWDED, block: int = BLOCK) -> DataFrame:
    """Every pair within the radius: columns of left with _1, of right with _2, and sep_arcsec.

    keys: columns that must also agree (such as a job id), so that many matches run as one plan.
    Rows without finite coordinates match nothing. Cells of more than `crowded` right sources are split down to an eighth of
    their edge; finest cells that still hold more are met in blocks of `block` sources of either side.
    """
    a, b, meet = meeting(left, right, radius_arcsec, keys, ra, dec, crowded, block)
    sep = ang_sep_arcsec(F.col(f"{ra}_1"), F.col(f"{dec}_1"), F.col(f"{ra}_2"), F.col(f"{dec}_2"))
    on = [F.col(f"{c}_1") == F.col(f"{c}_2") for c in meet] + [F.col(f"`{k}_1`") == F.col(f"`{k}_2`") for k in keys]
    return a.join(b, on).drop(*[f"{c}_{k}" for c in meet for k in (1, 2)]).withColumn("sep_arcsec", sep).filter(F.col("sep_arcsec") <= radius_arcsec)


def meeting(left: DataFrame, right: DataFrame, radius_arcsec: float, keys: Sequence[str], ra: str, dec: str, crowded: int, block: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides of the join, and the names (with _1 and _2) of what they meet by besides the keys."""
    chord = 2 * math.sin(math.radians(min(radius_arcsec, HALF_TURN_ARCSEC) / 3600) / 2) * (1 + 1e-6) + 1e-15
    edge = max(chord, min(8 * chord, 1e-3)) / (1 << _PLAIN)  # small radii: wider cells, so that a source touches about two
    a, b = suffix_columns(valid_coords(left, ra, dec), 1), suffix_columns(valid_coords(right, ra, dec), 2)
    place = lambda v: F.floor((v + 2) / edge)
    for x, v in zip(_AXES, unit_vector(F.col(f"{ra}_1"), F.col(f"{dec}_1"))):
        a = a.withColumns({f"__low{x}": place(v - chord), f"__high{x}": place(v + chord)})
    b = b.withColumns({f"__{x}2": place(v) for x, v in zip(_AXES, unit_vector(F.col(f"{ra}_2"), F.col(f"{dec}_2")))})
    heavy = crowded_cells(b, keys, crowded)
    a = a.withColumn("__at", F.explode(_touched(_PLAIN, False)))
    b = b.withColumn("__at", F.struct(*[F.shiftright(f"__{x}2", _PLAIN).alias(x) for x in _AXES], F.lit(_PLAIN).alias("level")))
    meet = ["__x", "__y", "__z"]
    if heavy:
        a, b = _nested(a, b, heavy, keys, block)
        meet = [*meet, "__level", "__block1", "__block2"]
    cells = [c for c in meet if not c.startswith("__block")]
    a, b = (df.withColumns({f"{c}_{k}": F.col(f"__at.{c[2:]}") for c in cells}).withColumnsRenamed({f"__block{n}": f"__block{n}_{k}" for n in (1, 2)}) for k, df in ((1, a), (2, b)))
    inner = ["__at", *[f"__{r}{x}" for r in ("low", "high") for x in _AXES], *[f"__{x}2" for x in _AXES]]
    return a.drop(*inner), b.drop(*inner), meet


def sky_match(left: DataFrame, right: DataFrame, radius_arcsec: float = 1.0, mode: str = "one_to_one", id_col: str = "source_id", keys: Sequence[str] = (), ra: str = "ra", dec: str = "dec") -> DataFrame:
    """Matched pairs, ties by id.

    one_to_many: every pair within the radius. one_to_one: the nearest right source of each left source, then
    of those that chose the same right source the nearest; a left source that loses is not matched elsewhere.
    """
    pairs = pairs_within(left, right, radius_arcsec, keys, ra, dec)
    if mode == "one_to_many":
        return pairs
    if mode != "one_to_one":
        raise ValueError(f"unknown mode {mode}")
    for own, other in (("1", "2"), ("2", "1")):
        w = Window.partitionBy(*[f"{k}_{own}" for k in keys], f"{id_col}_{own}").orderBy("sep_arcsec", f"{id_col}_{other}")
        pairs = pairs.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank")
    return pairs


def unmatched(df: DataFrame, matches: DataFrame, side: int, id_col: str = "source_id", ra: str = "ra", dec: str = "dec") -> DataFrame:
    """Rows with coordinates that no match holds."""
    return valid_coords(df, ra, dec).join(matches.select(F.col(f"{id_col}_{side}").alias(id_col)), id_col, "left_anti")


def match_summary(left: DataFrame, right: DataFrame, matches: DataFrame, id_col: str = "source_id") -> DataFrame:
    """One row: n_matches, and for each side the valid total and how many are unmatched."""
    m = matches.agg(F.count("*").alias("n_matches"), F.count_distinct(f"{id_col}_1").alias("__m1"), F.count_distinct(f"{id_col}_2").alias("__m2"))
    total = lambda df, n: valid_coords(df).agg(F.count("*").alias(f"n_{n}"))
    one = m.withColumn("__k", F.lit(0))
    for df, n in ((left, 1), (right, 2)):
        one = one.join(total(df, n).withColumn("__k", F.lit(0)), "__k")  # one row each
    return one.select("n_matches", "n_1", "n_2", (F.col("n_1") - F.col("__m1")).alias("unmatched_1"), (F.col("n_2") - F.col("__m2")).alias("unmatched_2"))


def _first_of(pairs: DataFrame, id_col: str) -> DataFrame:
    """The closest pair of each left source, ties by the right id."""
    w = Window.partitionBy(f"{id_col}_1").orderBy("sep_arcsec", f"{id_col}_2")
    return pairs.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank")


def nearest(left: DataFrame, right: DataFrame, start_arcsec: float | None = None, id_col: str = "source_id", ra: str = "ra", dec: str = "dec") -> DataFrame:
    """The closest right source of each left source at any distance, ties by id.

    Each source meets the right sources of the few cells that can hold its nearest (see nearest.py), or with start_arcsec all
    within that radius. The sources left, those far from any right one, are served through a grid: pairs of occupied cells are
    narrowed level by level to those that can hold the nearest, to finer cells as long as many sources would meet.
    """
    todo, other = valid_coords(left, ra, dec), valid_coords(right, ra, dec)
    if start_arcsec is not None or not other.limit(1).count():
        pairs = stored(_first_of(pairs_within(todo, other, min(start_arcsec or 1.0, HALF_TURN_ARCSEC), ra=ra, dec=dec), id_col))
        rest = stored(todo.join(pairs.select(F.col(f"{id_col}_1").alias(id_col)), id_col, "left_anti").select(*todo.columns))
    else:
        pairs, rest = nearest_pairs(todo, other, id_col, ra, dec)
        pairs = pairs.withColumn("sep_arcsec", ang_sep_arcsec(F.col(f"{ra}_1"), F.col(f"{dec}_1"), F.col(f"{ra}_2"), F.col(f"{dec}_2")))
    if rest.limit(1).count():
        pairs = pairs.unionByName(_pairs_by_cells(rest, other, ra, dec))
    return _first_of(pairs, id_col)


#: Finest cells a unit of the nested grids, and the halvings of each level from the one below.
_FINEST, _LEVELS = 1 << 18, (15, 12, 9, 6, 3, 0)
#: Candidates for each left source, and in all, with which no finer cells are asked for.
ENOUGH, ENOUGH_IN_ALL = 64, 1_000_000


def _pairs_by_cells(left: DataFrame, right: DataFrame, ra: str, dec: str) -> DataFrame:
    """Pairs of each left source with all right sources in cells that can hold its nearest; sep_arcsec as in pairs_within.

    Of two cells the least and the largest distance of their points are known. A right cell stays with a left one if its
    least distance is no more than the smallest of the largest distances. The coarsest level has at most 17^3 cells a side.
    """

    def placed(df: DataFrame, side: int) -> DataFrame:
        cells = unit_vector(F.col(f"{ra}_{side}"), F.col(f"{dec}_{side}"))
        return suffix_columns(df, side).withColumns({f"__{x}{side}": F.floor((v + 2) * _FINEST).cast("int") for x, v in zip(_AXES, cells)})

    a, b = placed(left, 1), placed(right, 2)
    narrow = [stored(df.select(*[f"__{x}{k}" for x in _AXES])) for k, df in ((1, a), (2, b))]
    sources = narrow[0].count()
    counts = [df.select(*[F.lit(0).alias(f"__{x}{k}") for x in _AXES], F.lit(1).alias("__any")).limit(1) for k, df in zip((1, 2), narrow)]
    pairs = counts[0].join(counts[1], "__any").drop("__any")  # one row: the cell that holds all
    above = 0
    for shift in _LEVELS:
        now = pairs.withColumnsRenamed({f"__{x}{k}": f"__p{x}{k}" for x in _AXES for k in (1, 2)})
        for k, df in zip((1, 2), narrow):
            cells = df.groupBy(*[F.shiftright(f"__{x}{k}", shift).alias(f"__{x}{k}") for x in _AXES]).agg(F.count("*").alias(f"__n{k}"))
            up = (lambda x: F.lit(0)) if not above else (lambda x: F.shiftright(x, above - shift))
            now = now.join(cells, [up(f"__{x}{k}") == F.col(f"__p{x}{k}") for x in _AXES])
        apart = [F.abs(F.col(f"__{x}1") - F.col(f"__{x}2")).cast("double") for x in _AXES]
        least = sum((F.pow(F.greatest(d - 1, F.lit(0.0)), F.lit(2)) for d in apart[1:]), F.pow(F.greatest(apart[0] - 1, F.lit(0.0)), F.lit(2)))
        most = sum((F.pow(d + 1, F.lit(2)) for d in apart[1:]), F.pow(apart[0] + 1, F.lit(2)))
        now = now.select(*[f"__{x}{k}" for k in (1, 2) for x in _AXES], "__n1", "__n2", least.alias("__least"), most.alias("__most"))
        now = now.withColumn("__best", F.min("__most").over(Window.partitionBy(*[f"__{x}1" for x in _AXES]))).filter("__least <= __best * (1 + 1e-9)")
        pairs = stored(now.select(*[f"__{x}{k}" for k in (1, 2) for x in _AXES], "__n1", "__n2"))
        size = pairs.agg(F.sum(F.col("__n1") * F.col("__n2"))).first()[0]
        pairs, above = pairs.drop("__n1", "__n2"), shift
        if not size or size <= max(ENOUGH_IN_ALL, ENOUGH * sources):
            break
    sep = ang_sep_arcsec(F.col(f"{ra}_1"), F.col(f"{dec}_1"), F.col(f"{ra}_2"), F.col(f"{dec}_2"))
    cut = lambda df, k: df.withColumns({f"__{x}{k}": F.shiftright(f"__{x}{k}", above) for x in _AXES})
    met = cut(a, 1).join(pairs, [f"__{x}1" for x in _AXES]).join(cut(b, 2), [f"__{x}2" for x in _AXES])
    return met.drop(*[f"__{x}{k}" for k in (1, 2) for x in _AXES]).withColumn("sep_arcsec", sep)


def calibrators_within(targets: DataFrame, calibrators: DataFrame, limit_deg: float = 16.0, name: str = "name", outside: bool = False) -> DataFrame:
    """(target, calibrator, sep_deg) within the limit, a target's own name left out.

    outside: also what the limit leaves out, with a column `inside`: a target without a calibrator inside has one row, with the nearest one of
    another name and its separation; a calibrator that serves no target has one row with the target nearest to it.
    """
    named = lambda df: df.select(F.col(f"{name}_1").alias("target"), F.col(f"{name}_2").alias("calibrator"), (F.col("sep_arcsec") / 3600).alias("sep_deg"))
    inside = named(_other_names(targets, calibrators, limit_deg * 3600, name))
    if not outside:
        return inside
    inside = stored(inside.withColumn("inside", F.lit(True)))
    out = inside
    for role, df, other in (("target", targets, calibrators), ("calibrator", calibrators, targets)):
        todo, radius = stored(df.join(inside.select(F.col(role).alias(name)), name, "left_anti").select(*df.columns)), limit_deg * 3600
        while radius < HALF_TURN_ARCSEC and todo.limit(1).count():
            radius = min(4 * radius, HALF_TURN_ARCSEC)
            found = stored(_first_of(_other_names(todo, other, radius, name), name))
            pair = named(found)
            pair = pair if role == "target" else pair.select(F.col("calibrator").alias("target"), F.col("target").alias("calibrator"), "sep_deg")
            out = out.unionByName(pair.withColumn("inside", F.lit(False)))
            todo = stored(todo.join(found.select(F.col(f"{name}_1").alias(name)), name, "left_anti").select(*df.columns))
    return out.distinct()


def calibrator_summary(targets: DataFrame, calibrators: DataFrame, limit_deg: float = 16.0, name: str = "name") -> DataFrame:
    """(target, n, closest, farthest): how many calibrators lie within the limit of each target, and the least and largest separation in degrees; a target's own name is left out, targets without any have no row.

    The figures of calibrators_within without its pairs: rows that share a position are one place with a count, and places meet places. Targets of
    one name are one. A calibrator of the target's own name is taken off the count of its place; a place that holds no other name is left out
    of the extremes, too, so targets of one place with the same such places are one group.
    """
    at = ["ra", "dec"]
    cals = valid_coords(calibrators, *at).select(name, *at).dropna(subset=[name])
    sites = stored(cals.groupBy(*at).agg(F.count("*").alias("n")))
    rows = stored(valid_coords(targets, *at).dropna(subset=[name]).select(F.monotonically_increasing_id().alias("id"), name, *at))
    same = rows.select("id", name, F.col("ra").alias("ra_1"), F.col("dec").alias("dec_1")).join(cals.groupBy(name, *at).agg(F.count("*").alias("m")), name).join(sites, at)
    apart = ang_sep_arcsec(F.col("ra_1"), F.col("dec_1"), F.col("ra"), F.col("dec"))
    own = same.filter(apart <= limit_deg * 3600).groupBy("id").agg(
        F.sum(F.when(F.col("m") < F.col("n"), F.col("m")).otherwise(0)).alias("off"), F.sort_array(F.collect_list(F.when(F.col("m") == F.col("n"), F.struct("ra", "dec")))).alias("without"))
    rows = stored(rows.join(own, "id", "left").withColumns({"off": F.coalesce("off", F.lit(0)), "without": F.coalesce("without", F.array().cast("array<struct<ra: double, dec: double>>"))}))
    places = stored(rows.groupBy(*at, "without").agg(F.count("*").alias("targets")).withColumn("place", F.monotonically_increasing_id()))
    met = pairs_within(places.select("place", *at, "without"), sites.select(*at, "n"), limit_deg * 3600)
    met = met.filter(~F.array_contains("without_1", F.struct(F.col("ra_2").alias("ra"), F.col("dec_2").alias("dec"))))
    sep = F.col("sep_arcsec") / 3600
    found = met.groupBy(F.col("place_1").alias("place")).agg(F.sum("n_2").alias("all"), F.min(sep).alias("closest"), F.max(sep).alias("farthest"))
    served = rows.join(places, [*at, "without"]).join(found, "place")
    return served.groupBy(F.col(name).alias("target")).agg(F.sum(F.col("all") - F.col("off")).alias("n"), F.min("closest").alias("closest"), F.max("farthest").alias("farthest"))


def _other_names(left: DataFrame, right: DataFrame, radius_arcsec: float, name: str) -> DataFrame:
    return pairs_within(left, right, radius_arcsec).filter(F.col(f"{name}_1") != F.col(f"{name}_2"))


def survey_offsets(pairs: DataFrame, b_maj_arcsec: float) -> DataFrame:
    """Offsets of matched pairs in arcsec and beams with the cosine of the first declination."""
    d_ra, d_dec = offsets_flat(F.col("ra_1"), F.col("dec_1"), F.col("ra_2"), F.col("dec_2"))
    return pairs.withColumns({"d_ra": d_ra, "d_dec": d_dec, "d_ra_beam": d_ra / b_maj_arcsec, "d_dec_beam": d_dec / b_maj_arcsec})
