"""Grouped statistics. Nulls are skipped; standard deviations are of the population; percentiles interpolate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyaccord.lineage import once, stored

MAD_SCALE = 1.4826
#: A sketch's ranks are wrong by at most one in this many; a first bracket reaches so many such errors to either side.
ACCURACY, MARGIN = 10_000, 3


def attach(df: DataFrame, per_group: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Group values on every row of their group; without keys there is one row of values, which is broadcast."""
    if not keys:
        return df.withColumn("__one", F.lit(0)).join(F.broadcast(per_group.withColumn("__one", F.lit(0))), "__one", how).drop("__one")
    renamed = per_group.select([F.col(c).alias(f"__k_{c}") if c in keys else F.col(c) for c in per_group.columns])
    on = [F.col(f"`{k}`").eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    return df.join(renamed, on, how).drop(*[f"__k_{k}" for k in keys])


def attach_left(df: DataFrame, per_group: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Like attach, and rows of groups without values keep nulls."""
    return attach(df, per_group, keys, "left")


def exact_quantiles(df: DataFrame, value: str, ps: Mapping[str, float], keys: Sequence[str] = (), ready: bool = False) -> DataFrame:
    """(keys, a column for each name in ps): interpolated quantiles of one column, exact for groups of any size. See quantile_table."""
    return quantile_table(df, {value: ps}, keys, ready=ready)


def quantile_table(df: DataFrame, wanted: Mapping[str, Mapping[str, float]], keys: Sequence[str] = (), more: Sequence[Column] = (), ready: bool = False) -> DataFrame:
    """(keys, a column for each aggregate in more, a column for each name in wanted[column]): interpolated quantiles of several columns.

    Exact for groups of any size, and no task holds a large one. Groups of up to IN_ONE_TASK rows, which are counted first, are
    one aggregate. In larger groups the ranks are found in rounds: a mergeable sketch brackets every wanted rank, a pass counts
    what lies below, on and between the ends, and tells which rank has its value by that, which bracket missed its
    rank and is widened, and which must be narrowed by a sketch of its inside; at last at most FEW_INSIDE values a rank are
    ordered. A sketch's error only costs rounds. Groups without a value have null quantiles. df is stored
    unless it is cheap to read again; `ready` says that it is.
    """
    keys = list(keys)
    rows = df if ready else once(df)
    size = F.greatest(*[F.count(F.col(c)) for c in wanted], F.lit(0)) if len(wanted) > 1 else F.count(F.col(next(iter(wanted))))
    large = stored(rows.groupBy(*keys).agg(size.alias("__size")).filter(F.col("__size") > IN_ONE_TASK).select(*keys, F.lit(True).alias("__large")))
    plain = [F.expr(f"percentile(CAST(`{c}` AS DOUBLE), {float(p)!r}D)").alias(n) for c, ps in wanted.items() for n, p in ps.items()]
    if not large.limit(1).count():
        return rows.groupBy(*keys).agg(*more, *plain)
    if keys:
        marked = attach(rows, large, keys, "left")
        small = marked.filter("__large IS NULL").groupBy(*keys).agg(*more, *plain)
        rows = marked.filter("__large").drop("__large")
    found = _by_rounds(rows, [(n, c, p) for c, ps in wanted.items() for n, p in ps.items()], keys)
    if more:
        found = attach(rows.groupBy(*keys).agg(*more), found, keys)
    return small.unionByName(found) if keys else found


#: Rows of a group up to which one task holds its values; values between the ends of a bracket that are ordered at once; points of a narrowing sketch.
IN_ONE_TASK, FEW_INSIDE, POINTS = 30_000, 50_000, 256


def _by_rounds(rows: DataFrame, targets: list[tuple[str, str, float]], keys: list[str]) -> DataFrame:
    """(keys, names): every target (name, column, p) holds an open bracket (low, high) inside one that is known to hold its rank (least, most), and the two values it is to interpolate once they are known.

    Every round takes values out of the known bracket, so the rounds end however bad a sketch is.
    """
    values = {c: F.col(f"`{c}`").cast("double") for _, c, _ in targets}
    grids = {c: [min(max(p + side * MARGIN / ACCURACY, 0.0), 1.0) for _, d, p in targets if d == c for side in (-1, 1)] for c in values}
    sketch = rows.groupBy(*keys).agg(*[F.count(v).alias(f"__n_{c}") for c, v in values.items()], *[F.percentile_approx(v, grids[c], ACCURACY).alias(f"__g_{c}") for c, v in values.items()])
    at = dict.fromkeys(values, 0)
    state = []
    for _, c, p in targets:
        place = F.lit(p) * (F.col(f"__n_{c}") - 1)
        null = F.lit(None).cast("double")
        state.append(F.struct(F.floor(place).alias("r"), (place - F.floor(place)).alias("f"), F.col(f"__g_{c}")[at[c]].alias("low"), F.col(f"__g_{c}")[at[c] + 1].alias("high"), null.alias("a"), null.alias("b"), F.lit(0).cast("long").alias("base"), F.lit(0).cast("long").alias("inside"), (F.col(f"__n_{c}") == 0).alias("done"), F.lit(True).alias("fresh"), F.lit(float("-inf")).alias("least"), F.lit(float("inf")).alias("most")))
        at[c] += 2
    groups = stored(sketch.select(*keys, F.array(*state).alias("__s")))
    span = range(len(targets))
    while True:
        known = attach(rows, groups, keys)
        inner, counts = [], []
        for k, (_, c, _) in enumerate(targets):
            v, t = values[c], F.col("__s")[k]
            inside = ~t["done"] & (v > t["low"]) & (v < t["high"])
            inner.append((v, inside))
            on = [F.count_if(v < t["low"]).alias("under"), F.count_if(v == t["low"]).alias("on_low"), F.count_if((v == t["high"]) & (t["high"] > t["low"])).alias("on_high"), F.count_if(inside).alias("inside"), F.min(F.when(inside, v)).alias("least"), F.min(F.when(v > t["high"], v)).alias("over")]
            counts.append(F.struct(*on).alias(f"__c{k}"))
        both = attach(groups, known.groupBy(*keys).agg(*counts), keys)
        judged = [_judged(F.col("__s")[k], F.col(f"__c{k}")).alias(f"__t{k}") for k in span]
        groups = stored(both.select(*keys, F.array(*[j for j in judged]).alias("__s")))
        todo = groups.agg(*[F.count_if(~F.col("__s")[k]["done"] & (F.col("__s")[k]["fresh"] | (F.col("__s")[k]["inside"] > FEW_INSIDE))) for k in span]).first()
        if not any(todo):
            break
        # Brackets that missed, or that hold too much, get the sketch of what they hold now.
        known = attach(rows, groups, keys)
        parts = []
        for k, (_, c, _) in enumerate(targets):
            v, t = values[c], F.col("__s")[k]
            wide = ~t["done"] & (t["fresh"] | (t["inside"] > FEW_INSIDE)) & (v > t["low"]) & (v < t["high"])
            parts += [F.percentile_approx(F.when(wide, v), [i / POINTS for i in range(POINTS + 1)], ACCURACY).alias(f"__g{k}"), F.count_if(wide).alias(f"__m{k}"), F.count_if(~t["done"] & (v <= t["low"])).alias(f"__u{k}")]
        both = attach(groups, known.groupBy(*keys).agg(*parts), keys)
        groups = stored(both.select(*keys, F.array(*[_narrowed(F.col("__s")[k], F.col(f"__g{k}"), F.col(f"__m{k}"), F.col(f"__u{k}")) for k in span]).alias("__s")))
    known = attach(rows, groups, keys)
    lists, out = [], []
    for k, (n, c, _) in enumerate(targets):
        v, t = values[c], F.col("__s")[k]
        lists.append(F.sort_array(F.collect_list(F.when(~t["done"] & (v > t["low"]) & (v < t["high"]), v))).alias(f"__l{k}"))
        place = (t["r"] - t["base"] + 1).cast("int")
        a = F.coalesce(t["a"], F.try_element_at(f"__l{k}", place))
        b = F.coalesce(t["b"], F.try_element_at(f"__l{k}", place + 1), t["high"])
        out.append(F.when(t["f"] == 0, a).otherwise(a * (1 - t["f"]) + b * t["f"]).alias(n))
    needed = F.exists("__s", lambda t: ~t["done"])
    listed = known.filter(needed).groupBy(*keys).agg(*lists)
    if keys:
        return attach(groups, listed, keys, "left").select(*keys, *out)
    return attach(groups, listed, keys).select(*out)


def _judged(t: Column, c: Column) -> Column:
    """A target after its bracket was counted: done where an end has the value, its inside where the rank lies there, fresh and wider where it lies beyond."""
    first = c["under"] + c["on_low"]  # rank of the first value inside
    last = first + c["inside"]  # rank of the first value on high
    end = last + c["on_high"]
    r = t["r"]
    low, high = r < c["under"], r >= end
    on_low, on_high = ~low & (r < first), (r >= last) & (r < end)
    # The value at the next rank: on the same end, the least inside, on high or over it.
    nth = lambda at: F.when(at < first, t["low"]).when((at == first) & (c["inside"] > 0), c["least"]).when((at >= last) & (at < end), t["high"]).when(at == end, c["over"])
    done = on_low | on_high
    new_low, new_high = F.when(low, t["least"]).when(high, t["high"]).otherwise(t["low"]), F.when(low, t["low"]).when(high, t["most"]).otherwise(t["high"])
    return F.when(t["done"], t).otherwise(F.struct(
        r.alias("r"), t["f"].alias("f"), new_low.alias("low"), new_high.alias("high"), F.when(done, F.when(on_low, t["low"]).otherwise(t["high"])).alias("a"), F.when(done, nth(r + 1)).alias("b"),
        first.alias("base"), c["inside"].alias("inside"), done.alias("done"), (low | high).alias("fresh"), new_low.alias("least"), new_high.alias("most"),
    ))


def _narrowed(t: Column, grid: Column, n: Column, upto: Column) -> Column:
    """A target with the bracket that a sketch of the n values inside gives it; upto: values up to its low end."""
    go = ~t["done"] & (t["fresh"] | (t["inside"] > FEW_INSIDE)) & (n > 0)
    share = (t["r"] - upto) / n
    at = lambda e: F.greatest(F.least(e, F.lit(POINTS)), F.lit(0)).cast("int")
    low, high = F.try_element_at(grid, at(F.floor(share * POINTS) - 1) + 1), F.try_element_at(grid, at(F.ceil(share * POINTS) + 1) + 1)
    fields = [F.when(go, low).otherwise(t["low"]).alias("low"), F.when(go, high).otherwise(t["high"]).alias("high")]
    return F.struct(t["r"].alias("r"), t["f"].alias("f"), *fields, *[t[k].alias(k) for k in ("a", "b", "base", "inside", "done")], F.lit(True).alias("fresh"), t["least"].alias("least"), t["most"].alias("most"))


def mad(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, n, median, nmad): nmad is 1.4826 times the median absolute deviation. Groups without a value have none of these."""
    keys = list(keys)
    known = once(df.select(*keys, F.col(value).cast("double").alias("v")).filter("v IS NOT NULL"))
    middle = stored(quantile_table(known, {"v": {"median": 0.5}}, keys, [F.count("v").alias("n")], ready=True)).filter("n > 0")
    return attach(middle.select(*keys, "n", "median"), _nmad(known, middle, "v", "median", "nmad", keys), keys)


def _nmad(rows: DataFrame, middle: DataFrame, value: str, median: str, out: str, keys: list[str]) -> DataFrame:
    """(keys, out): 1.4826 times the median distance of a column from its group's median. rows are cheap to read again."""
    off = attach(rows, middle.select(*keys, F.col(median).alias("__middle")), keys).select(*keys, F.abs(F.col(value) - F.col("__middle")).alias("__off"))
    return exact_quantiles(off, "__off", {out: 0.5}, keys, ready=True).withColumn(out, MAD_SCALE * F.col(out))


def mad_inlier(df: DataFrame, value: str, keys: Sequence[str] = (), z: float = 4.0, out: str = "inlier") -> DataFrame:
    """A boolean column: within z robust sigma of the median.

    Sigma is the nmad, the standard deviation where that is at most 1e-9, and all pass where both are. Null values fail.
    df is stored once unless it is cheap to read.
    """
    keys, rows = list(keys), once(df)
    scale = mad(rows, value, keys).select(*keys, F.col("median").alias("__m"), F.col("nmad").alias("__s"))
    spread = rows.groupBy(*keys).agg(F.stddev_pop(value).alias("__sd"))
    limits = stored(attach_left(spread, scale, keys))
    sigma = F.when(F.col("__s") > 1e-9, F.col("__s")).otherwise(F.col("__sd"))
    ok = F.when(sigma > 1e-9, F.abs(F.col(value) - F.col("__m")) / sigma <= z).otherwise(F.col(value).isNotNull())
    return attach(rows, limits, keys).withColumn(out, F.coalesce(ok, F.lit(False))).drop("__m", "__s", "__sd")


def frac_summary(df: DataFrame, frac: str, ratio: str, keys: Sequence[str] = ()) -> DataFrame:
    """Counts, mean, standard deviation, median and 16/84 percentiles of frac; count, median and nmad of ratio. All but the last come from one set of passes; df's columns are stored once unless they are cheap to read."""
    keys = list(keys)
    rows = once(df.select(*keys, F.col(frac).cast("double").alias("frac"), F.col(ratio).cast("double").alias("ratio")))
    more = [F.count("frac").alias("n_frac"), F.avg("frac").alias("mean_frac"), F.stddev_pop("frac").alias("std_frac"), F.count("ratio").alias("n_ratio")]
    main = stored(quantile_table(rows, {"frac": {"median_frac": 0.5, "p16_frac": 0.16, "p84_frac": 0.84}, "ratio": {"median_ratio": 0.5}}, keys, more, ready=True))
    return attach_left(main, _nmad(rows, main, "ratio", "median_ratio", "nmad_ratio", keys), keys)


def offset_stats(df: DataFrame, quantities: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, quantity, n, mean, std, median, p16, p84), a row for each of the columns, all from one set of passes over the columns side by side."""
    keys = list(keys)
    rows = once(df.select(*keys, *[F.col(q).cast("double").alias(q) for q in quantities]))
    more = [f for q in quantities for f in (F.count(q).alias(f"n_{q}"), F.avg(q).alias(f"mean_{q}"), F.stddev_pop(q).alias(f"std_{q}"))]
    wide = quantile_table(rows, {q: {f"median_{q}": 0.5, f"p16_{q}": 0.16, f"p84_{q}": 0.84} for q in quantities}, keys, more, ready=True)
    each = [F.struct(F.lit(q).alias("quantity"), *[F.col(f"{s}_{q}").alias(s) for s in ("n", "mean", "std", "median", "p16", "p84")]) for q in quantities]
    return wide.select(*keys, F.explode(F.array(*each)).alias("x")).select(*keys, "x.*")


def circular_stats(df: DataFrame, theta: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, n, r, mean_deg, p, verdict): resultant length, mean direction and Rayleigh probability; null under five angles."""
    sums = df.groupBy(*keys).agg(F.count(theta).alias("n"), F.sum(F.cos(F.radians(theta))).alias("c"), F.sum(F.sin(F.radians(theta))).alias("s"))
    n, enough = F.col("n").cast("double"), F.col("n") >= 5
    length = F.hypot("c", "s")
    z = length * length / n
    series = 1 + (2 * z - z * z) / (4 * n) - (24 * z - 132 * z * z + 76 * F.pow(z, 3) - 9 * F.pow(z, 4)) / (288 * n * n)
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.exp(-z) * series))
    out = sums.select(*keys, "n", F.when(enough, length / n).alias("r"), F.when(enough, F.pmod(F.degrees(F.atan2("s", "c")), F.lit(360.0))).alias("mean_deg"), F.when(enough, p).alias("p"))
    verdict = F.when(F.col("p") <= 0.01, "directional").when(F.col("p") <= 0.05, "weak").when(F.col("p").isNotNull(), "uniform")
    return out.withColumn("verdict", verdict)


def enclosing_ellipse(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Axis-aligned ellipse around pairs without null: centre, half axes and standard deviations."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    half = lambda c: F.greatest(F.max(c) - F.avg(c), F.avg(c) - F.min(c))
    return both.groupBy(*keys).agg(F.avg(x).alias("x0"), F.avg(y).alias("y0"), half(x).alias("rx"), half(y).alias("ry"), F.stddev_pop(x).alias("sx"), F.stddev_pop(y).alias("sy"))


def histogram(df: DataFrame, value: str, keys: Sequence[str] = (), low: float = -1.0, high: float = 1.0, bins: int = 59) -> DataFrame:
    """(keys, bin, n): equal bins, the last closed on the right; values outside are dropped, as the operator means."""
    v = F.col(value)
    slot = F.least(F.floor((v - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("long")
    return df.filter(v.between(low, high)).groupBy(*keys, slot.alias("bin")).agg(F.count("*").alias("n"))


def auto_bins(n: Column) -> Column:
    """2 int(sqrt(n)) bins."""
    return 2 * F.floor(F.sqrt(n))


def avg_std_rms(df: DataFrame, values: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """avg_, std_ and rms_ of each column."""
    cols = [f for v in values for f in (F.avg(v).alias(f"avg_{v}"), F.stddev_pop(v).alias(f"std_{v}"), F.sqrt(F.avg(F.col(v) * F.col(v))).alias(f"rms_{v}"))]
    return df.groupBy(*keys).agg(*cols)


def axis_limits(df: DataFrame, x: str, y: str) -> DataFrame:
    """(limit): 1.05 times the largest absolute value of either column; 1 without any."""
    biggest = F.greatest(F.max(F.abs(F.col(x))), F.max(F.abs(F.col(y))))
    return df.agg(F.coalesce(F.when(biggest > 0, 1.05 * biggest), F.lit(1.0)).alias("limit"))

