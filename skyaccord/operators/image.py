"""Statistics of image pixels in long form (image_id, plane, value); null marks a blanked pixel."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyaccord.functions.flux import even_poly
from skyaccord.functions.headers import beam_arcsec, header_frequency, pixel_scale, pixel_scales, sky_to_pixel
from skyaccord.lineage import once, stored
from skyaccord.operators.stats import MAD_SCALE, attach, attach_left, exact_quantiles, quantile_table


def image_qa(pixels: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Counts, extremes, mean, median, deviation, robust noise, percentiles and dynamic range for each image.

    Percentiles are exact for images of any size. Pixels are stored once unless they are cheap to read. Without noise the dynamic range is infinite.
    """
    keys, rows = list(keys), once(pixels.select(*keys, F.col("value").cast("double").alias("value")))
    v = F.col("value")
    more = [F.count("*").alias("n_total"), F.count(v).alias("n_finite"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std")]
    main = stored(quantile_table(rows, {"value": {"median": 0.5, "p5": 0.05, "p95": 0.95, "p99": 0.99}}, keys, more, ready=True))
    off = attach(rows.filter(v.isNotNull()), main.select(*keys, F.col("median").alias("__m")), keys).select(*keys, F.abs(v - F.col("__m")).alias("d"))
    out = attach_left(main, exact_quantiles(off, "d", {"mad": 0.5}, keys, ready=True), keys).withColumn("robust_rms", MAD_SCALE * F.col("mad"))
    dynamic = F.when(F.col("robust_rms") > 0, F.col("max") / F.col("robust_rms")).when(F.col("robust_rms") == 0, F.lit(float("inf")))
    return out.withColumns({"n_blank": F.col("n_total") - F.col("n_finite"), "blank_frac": (F.col("n_total") - F.col("n_finite")) / F.col("n_total"), "dynamic_range": dynamic})


def plane_stats(pixels: DataFrame, first: int = 2) -> DataFrame:
    """(image_id, plane, n, max, min, mean, rms, sigma) for planes from `first` on; sigma is of the sample.

    Planes count from 0, as read_image_pixels numbers them: 0 is the mean image and 1 the spectral index, so bands begin at 2.
    """
    v = F.col("value")
    return pixels.filter(F.col("plane") >= first).groupBy("image_id", "plane").agg(F.count(v).alias("n"), F.max(v).alias("max"), F.min(v).alias("min"), F.avg(v).alias("mean"), F.sqrt(F.avg(v * v)).alias("rms"), F.stddev_samp(v).alias("sigma"))


def plane_frequencies(images: DataFrame) -> DataFrame:
    """(image_id, plane, freq_low, freq_hz, freq_high) of a cube's band planes from its header cards FREL, FREQ and FREH with the band's number; band n is plane n + 1."""
    cards = images.select("image_id", F.explode("header").alias("card", "text")).filter(F.col("card").rlike(r"^FRE[LQH]\d{4}$"))
    plane, kind = (F.substring("card", 5, 4).cast("int") + 1).alias("plane"), F.substring("card", 4, 1)
    value = F.col("text").try_cast("double")
    return cards.groupBy("image_id", plane).agg(*[F.max(F.when(kind == k, value)).alias(n) for k, n in (("L", "freq_low"), ("Q", "freq_hz"), ("H", "freq_high"))])


def with_frequencies(stats: DataFrame, images: DataFrame) -> DataFrame:
    """Plane statistics with the frequencies that the headers tell; null where they tell none."""
    return stats.join(plane_frequencies(images), ["image_id", "plane"], "left")


def peak_and_rms(pixels: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """(image_id, peak, rms), and freq_hz from the images' headers (image_id, header) where they are given."""
    out = pixels.groupBy("image_id").agg(F.max("value").alias("peak"), F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"))
    if images is None:
        return out
    return out.join(images.select("image_id", header_frequency(F.col("header")).alias("freq_hz")), "image_id", "left")


def with_geometry(qa: DataFrame, images: DataFrame) -> DataFrame:
    """Image statistics with pixel_scale (arcsec) and the beam (bmaj, bmin in arcsec, bpa) of the images' headers (image_id, header)."""
    beam = beam_arcsec(F.col("header"))
    return qa.join(images.select("image_id", pixel_scale(F.col("header")).alias("pixel_scale"), *[beam[k].alias(k) for k in ("bmaj", "bmin", "bpa")]), "image_id", "left")


def even_poly_pattern(df: DataFrame, radius: str, c: float, out: str = "pattern", keys: Sequence[str] = ()) -> DataFrame:
    """df with the even polynomial of a radius, divided by its maximum over each group."""
    value = df.withColumn(out, even_poly(F.col(radius), c))
    return attach(value, value.groupBy(*keys).agg(F.max(out).alias("__top")), list(keys)).withColumn(out, F.try_divide(out, "__top")).drop("__top")


def _moments(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sigma"))


def _classic(df: DataFrame, keys: list[str]) -> DataFrame:
    """df must be cheap to read again: a stored table, filtered."""
    return attach(_moments(df, keys), exact_quantiles(df, "value", {"median": 0.5}, keys, ready=True), keys)


def robust_image_stats(pixels: DataFrame, rule: str, keys: Sequence[str] = ("image_id",), fence: float = 1.5, rounds: int = 3) -> DataFrame:
    """(keys, n, mean, sigma, median) under a clipping rule.

    classic: all pixels. hinges-fences: within `fence` quartile distances of the quartiles. chauvenet: `rounds`
    clips at the deviation that less than half a pixel is expected to exceed. fit-half: pixels up to 0 and their
    mirror images. biweight: Tukey's weights around the median (the median stays that of all pixels).
    """
    keys, v = list(keys), F.col("value")
    rows = stored(pixels.filter(v.isNotNull()).select(*keys, v.cast("double").alias("value")))
    if rule == "classic":
        return _classic(rows, keys)
    if rule == "hinges-fences":
        quartiles = stored(exact_quantiles(rows, "value", {"__a": 0.25, "__b": 0.75}, keys, ready=True))
        reach = fence * (F.col("__b") - F.col("__a"))
        return _classic(attach(rows, quartiles, keys).filter(v.between(F.col("__a") - reach, F.col("__b") + reach)), keys)
    if rule == "chauvenet":
        # Every round is one stored row of limits for each group; the pixels themselves are filtered by the limits so far.
        base, limits = rows, None
        for _ in range(rounds):
            now = _moments(rows, keys).select(*keys, F.col("mean").alias("__m"), F.col("sigma").alias("__s"), F.col("n").alias("__n"))
            # The two-sided normal deviate of probability 1 / (2 n), by a rational approximation of its tail.
            t = F.sqrt(-2 * F.log(1 / (4 * F.col("__n"))))
            z = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t)
            now = now.select(*keys, F.array(F.struct(F.col("__m").alias("m"), (z * F.col("__s")).alias("reach"))).alias("__now"))
            every = now if limits is None else attach(limits, now, keys)
            limits = stored(every.select(*keys, (F.col("__now") if limits is None else F.concat("__limits", "__now")).alias("__limits")))
            rows = attach(base, limits, keys).filter(F.forall("__limits", lambda x: F.coalesce(F.abs(v - x["m"]) <= x["reach"], F.lit(True)))).drop("__limits")
        return _classic(rows, keys)
    if rule == "fit-half":
        low = rows.filter(v <= 0)
        return _classic(low.unionByName(low.withColumn("value", -v)), keys)
    if rule == "biweight":
        centre = stored(exact_quantiles(rows, "value", {"__m": 0.5}, keys, ready=True))
        off = attach(rows, centre, keys).withColumn("__d", v - F.col("__m"))
        scale = stored(exact_quantiles(off.select(*keys, F.abs("__d").alias("__e")), "__e", {"__s": 0.5}, keys, ready=True))
        u = F.col("__d") / (6 * F.col("__s"))
        near = attach(off, scale, keys).withColumn("__u", u).withColumn("__w", F.when(F.abs("__u") < 1, F.pow(1 - F.col("__u") * F.col("__u"), 2)).otherwise(0.0))
        d, w, q = F.col("__d"), F.col("__w"), 1 - F.col("__u") * F.col("__u")
        inside = F.abs("__u") < 1
        top = F.sum(F.when(inside, d * d * F.pow(q, 4)))
        low = F.sum(F.when(inside, q * (1 - 5 * F.col("__u") * F.col("__u"))))
        return near.groupBy(*keys).agg(F.count_if(inside).alias("n"), (F.first("__m") + F.try_divide(F.sum(w * d), F.sum(w))).alias("mean"), F.try_divide(F.sqrt(F.count("*") * top), F.abs(low)).alias("sigma"), F.first("__m").alias("median"))
    raise ValueError(f"unknown rule {rule}")


def mode_stats(stats: DataFrame, mode: str = "mode", values: Sequence[str] = ("rms", "mean", "max", "min")) -> DataFrame:
    """Mean and deviation over channels of each statistic, for each mode."""
    return stats.groupBy(mode).agg(*[f for v in values for f in (F.avg(v).alias(f"avg_{v}"), F.stddev_pop(v).alias(f"std_{v}"))])


def plane_roles(spark: SparkSession, roles: Mapping[str, int]) -> DataFrame:
    """(role, plane) from a mapping."""
    return spark.createDataFrame(list(roles.items()), "role string, plane int")


def select_planes(pixels: DataFrame, roles: DataFrame) -> DataFrame:
    """Pixels of the planes that a role table (role, plane) names; a negative plane counts from the last of its image."""
    last = pixels.groupBy("image_id").agg((F.max("plane") + 1).alias("__n"))
    wanted = roles.select("role", F.col("plane").alias("__p")).withColumn("__k", F.lit(0)).join(last.withColumn("__k", F.lit(0)), "__k").drop("__k")
    wanted = wanted.select(F.col("image_id").alias("__i"), "role", F.when(F.col("__p") < 0, F.col("__n") + F.col("__p")).otherwise(F.col("__p")).alias("__p"))
    return pixels.join(wanted, (F.col("image_id") == F.col("__i")) & (F.col("plane") == F.col("__p"))).drop("__i", "__p")


def band_header(header: Column, band: Column) -> Column:
    """The header of a plane cut from a cube: frequency axis renamed, beam cards filled from the cleaning beam, band noted."""
    axis = F.transform_values(header, lambda k, v: F.when(k.startswith("CTYPE") & v.startswith("SPECLNMF"), F.lit("FREQ")).otherwise(v))
    beam = F.map_filter(F.create_map(F.lit("BMAJ"), F.try_element_at(header, F.lit("CLEANBMJ")), F.lit("BMIN"), F.try_element_at(header, F.lit("CLEANBMN")), F.lit("BPA"), F.try_element_at(header, F.lit("CLEANBPA")), F.lit("BAND"), band), lambda k, v: v.isNotNull() & ~F.map_contains_key(header, k))
    return F.map_concat(axis, beam)


def locate_sources(sources: DataFrame, images: DataFrame, far: bool = False) -> DataFrame:
    """sources with xposn, yposn (from 0) and pixel_arcsec of each image (image_id, header): from ra, dec and the image's header; on sources' own image where they name one, else on every image.

    Sources on the far half of the sphere have no position; far: the one that the plain formula gives.
    """
    where = images.select(F.col("image_id").alias("__image"), F.col("header").alias("__header"))
    if "image_id" in sources.columns:
        joined = sources.join(where, F.col("image_id") == F.col("__image")).drop("__image")
    else:
        joined = sources.withColumn("__all", F.lit(0)).join(where.withColumn("__all", F.lit(0)), "__all").drop("__all").withColumnRenamed("__image", "image_id")
    at, scales = sky_to_pixel(F.col("__header"), F.col("ra"), F.col("dec"), far), pixel_scales(F.col("__header"))
    return joined.withColumns({"xposn": at["x"], "yposn": at["y"], "pixel_arcsec": F.coalesce(scales["y"], scales["x"])}).drop("__header")


def _pixel(position: str) -> Column:
    """The nearest pixel's number; null for a position that no image reaches: near the edge of the half sphere they pass any integer."""
    return F.when(F.abs(position) < 1e15, F.round(position)).cast("long")


def map_values(located: DataFrame, pixels: DataFrame, plane: int = 0, out: str = "map_value") -> DataFrame:
    """Located sources with the value of their nearest pixel in a plane; null outside the image and on blanked pixels. One equi-join on image and pixel."""
    values = pixels.filter(F.col("plane") == plane).select(F.col("image_id").alias("__i"), F.col("x").alias("__x"), F.col("y").alias("__y"), F.col("value").alias(out))
    on = (F.col("image_id") == F.col("__i")) & (_pixel("xposn") == F.col("__x")) & (_pixel("yposn") == F.col("__y"))
    return located.join(values, on, "left").drop("__i", "__x", "__y")


def source_boxes(located: DataFrame, pixels: DataFrame, box_arcsec: float = 30.0, tile: int = 64) -> DataFrame:
    """(image_id, source_id, plane, x, y, value) of a square box of so many arcsec around each located source, in its own image."""
    half = F.floor(F.lit(box_arcsec) / 2 / F.col("pixel_arcsec")).cast("int")
    return source_box_pixels(located.withColumn("__half", half), pixels, F.col("__half"), tile)


def source_box_pixels(sources: DataFrame, pixels: DataFrame, half: int | Column = 15, tile: int = 64) -> DataFrame:
    """(source_id, plane, x, y, value) of the square box around each source's pixel, through a join on tiles; with image_id where both sides have it.

    A source is repeated for the few tiles that its box touches; pixels stay as they are.
    """
    own = ["image_id"] if "image_id" in sources.columns and "image_id" in pixels.columns else []
    half = F.lit(half) if isinstance(half, int) else half
    s = sources.select(*[F.col(c).alias("__image") for c in own], "source_id", _pixel("xposn").alias("__sx"), _pixel("yposn").alias("__sy"), half.alias("__h"))
    tiles = lambda c: F.sequence(F.floor((F.col(c) - F.col("__h")) / tile), F.floor((F.col(c) + F.col("__h")) / tile))
    s = s.withColumn("__tx", F.explode(tiles("__sx"))).withColumn("__ty", F.explode(tiles("__sy")))
    p = pixels.withColumns({"__px": F.floor(F.col("x") / tile), "__py": F.floor(F.col("y") / tile)})
    on = (F.col("__px") == F.col("__tx")) & (F.col("__py") == F.col("__ty")) & (F.abs(F.col("x") - F.col("__sx")) <= F.col("__h")) & (F.abs(F.col("y") - F.col("__sy")) <= F.col("__h"))
    for _ in own:
        on = on & (F.col("image_id") == F.col("__image"))
    return p.join(s, on).select(*own, "source_id", "plane", "x", "y", "value")
