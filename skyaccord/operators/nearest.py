"""The nearest right source of each left source by trees of boxes over unit vectors.

Space is cut by a tree over a bounded sample of the right sources; what the sample is decides only how even the cells are. The nearest
sampled source bounds how far a left source has to look, so it goes to the few cells whose right sources may be nearer, and a
task finds the nearest of a cell in a tree of its own. Work and memory follow the number of sources, however they crowd.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyaccord.functions.sky import unit_vector
from skyaccord.lineage import stored
from skyaccord.operators.clean import suffix_columns

#: Right sources of a cell, cells at most, and sampled sources for each; sources of either side that one group holds of a fuller cell.
CELL, MOST_CELLS, SAMPLED, BLOCK = 20_000, 4096, 64, 200_000
#: Cells beyond which a left source is not repeated: it lies far from the right ones and is left to another search.
MANY = 16
#: Points of a leaf (up to twice as many), and queries taken at a time.
LEAF, AT_ONCE = 8, 20_000


def _vectors(table: pa.Table | pa.RecordBatch, ra: str, dec: str) -> np.ndarray:
    a, d = (np.radians(np.asarray(table.column(c).cast(pa.float64()))) for c in (ra, dec))
    return np.stack([np.cos(d) * np.cos(a), np.cos(d) * np.sin(a), np.sin(d)], axis=1)


def _reach(apart: np.ndarray) -> np.ndarray:
    """Squares of distances with room for the rounding of unit vectors: what lies within may be as near."""
    return (apart * (1 + 1e-9) + 2e-15) ** 2


def _boxes(low: np.ndarray, high: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Boxes of all levels from the root down, from those of the leaves."""
    levels = [(low, high)]
    while len(low) > 1:
        low, high = np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2])
        levels.append((low, high))
    return levels[::-1]


def _gaps(box: tuple[np.ndarray, np.ndarray], node: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Squares of the distances from points to boxes."""
    gap = np.maximum(np.maximum(box[0][node] - at, at - box[1][node]), 0)
    return np.einsum("ij,ij->i", gap, gap)


def reached(boxes: list[tuple[np.ndarray, np.ndarray]], at: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(point, leaf) of the leaves within reach of each point, in order of points."""
    who, node = np.arange(len(at)), np.zeros(len(at), np.int64)
    for box in boxes[1:]:
        who, node = np.repeat(who, 2), np.repeat(2 * node, 2)
        node[1::2] += 1
        keep = _gaps(box, node, at[who]) <= reach[who]
        who, node = who[keep], node[keep]
    return who, node


class Tree:
    """Points halved at the middle of their longest side, level by level, down to leaves of a few."""

    def __init__(self, points: np.ndarray, depth: int | None = None):
        n = len(points)
        depth = max(0, int(np.log2(n / LEAF))) if depth is None else depth
        order, cuts, self.planes = np.arange(n), np.array([0, n]), []
        for _ in range(depth):
            node, now = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts)), points[order]
            axis = (np.maximum.reduceat(now, cuts[:-1]) - np.minimum.reduceat(now, cuts[:-1])).argmax(axis=1)
            order = order[np.lexsort((now[np.arange(n), axis[node]], node))]
            middle = (cuts[:-1] + cuts[1:]) // 2
            self.planes.append((axis, points[order[middle], axis]))
            cuts = np.sort(np.concatenate((cuts, middle)))
        self.order, self.cuts, self.points = order, cuts, points[order]
        self.boxes = _boxes(np.minimum.reduceat(self.points, cuts[:-1]), np.maximum.reduceat(self.points, cuts[:-1]))

    def cell(self, at: np.ndarray) -> np.ndarray:
        """The leaf whose part of space holds each point."""
        node = np.zeros(len(at), np.int64)
        for axis, value in self.planes:
            node = 2 * node + (at[np.arange(len(at)), axis[node]] >= value[node])
        return node

    def _apart(self, at: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """Squares of the distances from each point to all points of a leaf, a row each; infinite beyond the leaf's end."""
        place = self.cuts[leaf][:, None] + np.arange(np.diff(self.cuts).max())
        gap = self.points[np.minimum(place, len(self.points) - 1)] - at[:, None, :]
        return np.where(place < self.cuts[leaf + 1][:, None], np.einsum("ijk,ijk->ij", gap, gap), np.inf)

    def bound(self, at: np.ndarray) -> np.ndarray:
        """The distance to some point near each one, the nearest or not much farther."""
        node = np.zeros(len(at), np.int64)
        for box in self.boxes[1:]:
            node = 2 * node + (_gaps(box, 2 * node + 1, at) < _gaps(box, 2 * node, at))
        return np.sqrt(self._apart(at, node).min(axis=1))

    def nearest(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, point): the nearest point of each query, and others that are as near but for rounding."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for start in range(0, len(at), AT_ONCE):
            some = at[start : start + AT_ONCE]
            who, leaf = reached(self.boxes, some, _reach(self.bound(some)))
            apart = self._apart(some[who], leaf)
            best = np.minimum.reduceat(apart.min(axis=1), np.flatnonzero(np.diff(who, prepend=-1)))
            row, place = np.nonzero(apart <= _reach(np.sqrt(best))[who][:, None])
            found.append((who[row] + start, self.order[self.cuts[leaf[row]] + place]))
        return tuple(np.concatenate(x) for x in zip(*found))


def nearest_pairs(left: DataFrame, right: DataFrame, id_col: str, ra: str, dec: str) -> tuple[DataFrame, DataFrame]:
    """(pairs, rest): for each left source the nearest right ones of the cells that it reaches (columns with _1 and _2), and the left
    sources that reach more than MANY cells. Coordinates are finite, and right has rows."""
    spark, n = right.sparkSession, right.count()
    cells = 1 << int(np.ceil(np.log2(min(max(n / CELL, 1), MOST_CELLS))))
    sample = right.select(ra, dec).sample(min(1.0, cells * SAMPLED / n), 7).toArrow() if cells > 1 else right.select(ra, dec).limit(SAMPLED).toArrow()
    points = _vectors(sample, ra, dec)
    cells = min(cells, 1 << max(0, int(np.log2(max(len(points), 1)))))
    space, sampled = Tree(points, int(np.log2(cells))), Tree(points)

    def own_cell(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(space.cell(_vectors(batch, ra, dec)), pa.int64())], names=[*batch.schema.names, "__cell"])

    placed = stored(right.mapInArrow(own_cell, T.StructType([*right.schema.fields, T.StructField("__cell", T.LongType())])))
    sides = unit_vector(F.col(f"`{ra}`").cast("double"), F.col(f"`{dec}`").cast("double"))
    known = placed.groupBy("__cell").agg(F.count("*").alias("n"), *[f(v).alias(f"{f.__name__}{k}") for f in (F.min, F.max) for k, v in enumerate(sides)]).collect()
    low, high, blocks = np.full((cells, 3), np.inf), np.full((cells, 3), -np.inf), np.ones(cells, np.int64)
    for row in known:
        low[row["__cell"]], high[row["__cell"]], blocks[row["__cell"]] = row[2:5], row[5:8], -(-row["n"] // BLOCK)
    boxes, first = _boxes(low, high), np.concatenate(([0], np.cumsum(blocks)))

    def reached_cells(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, AT_ONCE) for b in batches for at in range(0, b.num_rows, AT_ONCE)):
            at = _vectors(batch, ra, dec)
            who, cell = reached(boxes, at, _reach(sampled.bound(at)))
            far = np.bincount(who, minlength=len(at)) > MANY
            who, cell = who[~far[who]], cell[~far[who]]
            times = blocks[cell]
            unit = np.repeat(first[cell], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            who, unit = np.concatenate((np.repeat(who, times), np.flatnonzero(far))), np.concatenate((unit, np.full(far.sum(), -1)))
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(who)).columns, pa.array(unit, pa.int64())], names=[*batch.schema.names, "__unit"])

    dealt = stored(left.mapInArrow(reached_cells, T.StructType([*left.schema.fields, T.StructField("__unit", T.LongType())])))
    rest, dealt = dealt.filter("__unit < 0").drop("__unit"), dealt.filter("__unit >= 0")
    salt = F.xxhash64(*[F.col(f"`{c}`") for c in (id_col, ra, dec)])
    of_cell = spark.createDataFrame([(k, int(first[k]), int(blocks[k])) for k in range(cells)], "__cell long, __first long, __blocks long")
    placed = placed.join(F.broadcast(of_cell), "__cell").withColumn("__unit", F.col("__first") + F.pmod(salt, F.col("__blocks"))).drop("__cell", "__first", "__blocks")
    # Left sources of a full group are dealt to parts, each with the group's right sources; at most one row for each group.
    parts = F.broadcast(stored(dealt.groupBy("__unit").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("long").alias("__parts"))))
    dealt = dealt.join(parts, "__unit").withColumn("__part", F.pmod(salt, F.col("__parts"))).drop("__parts")
    placed = placed.join(parts, "__unit").withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__parts") - 1))).drop("__parts")
    schema = T.StructType([*suffix_columns(left, 1).schema.fields, *suffix_columns(right, 2).schema.fields])
    mine, theirs = left.columns, right.columns

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        a, b = a.select(mine), b.select(theirs)
        # Of right sources at one position only the one with the least id can serve.
        b = b.take(pc.sort_indices(b, sort_keys=[(ra, "ascending"), (dec, "ascending"), (id_col, "ascending")], null_placement="at_start"))
        where = np.stack([np.asarray(b.column(c).cast(pa.float64())) for c in (ra, dec)], axis=1)
        b = b.filter(pa.array(np.concatenate((np.ones(min(len(where), 1), bool), (where[1:] != where[:-1]).any(axis=1)))))
        query, point = Tree(_vectors(b, ra, dec)).nearest(_vectors(a, ra, dec)) if len(a) and len(b) else (np.zeros(0, np.int64),) * 2
        return pa.Table.from_arrays([*a.take(pa.array(query)).columns, *b.take(pa.array(point)).columns], names=schema.names)

    keys = ["__unit", "__part"]
    return dealt.groupBy(*keys).cogroup(placed.groupBy(*keys)).applyInArrow(meet, schema), rest
