"""Writers of match tables, metrics, regions and lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyaccord.lineage import stored
from skyaccord.operators.sources import region_lines, source_list
from skyaccord.operators.stats import attach
from skyaccord.sources import fits

#: Longest text value of a header card (a fixed value of the format).
CARD_TEXT = 68


def header_value(value: Column) -> Column:
    """A text that fits a header card: a long path by its last part, another long text cut."""
    last = F.element_at(F.split(value, "/"), -1)
    return F.when(F.length(value) <= CARD_TEXT, value).when(F.length(last) <= CARD_TEXT, last).otherwise(F.substring(value, 1, CARD_TEXT))


def match_metadata(left: DataFrame, right: DataFrame, radius_arcsec: float, mode: str) -> DataFrame:
    """(key, value) of a match run: both sides' (key, value) headers with prefixes T1_ and T2_, and the parameters.

    A value that a card cannot hold is cut, and stands whole in a row of its own under the key HISTORY, as `key = value`.
    """
    spark = left.sparkSession
    own = spark.createDataFrame([("XMATCH_MAX_ERROR_ARCSEC", str(radius_arcsec)), ("XMATCH_MODE", mode)], "key string, value string")
    return own.unionByName(_prefixed(left, 1)).unionByName(_prefixed(right, 2))


def _prefixed(header: DataFrame, side: int) -> DataFrame:
    key, value = F.concat(F.lit(f"T{side}_"), "key"), F.col("value")
    card = F.struct(key.alias("key"), header_value(value).alias("value"))
    whole = F.struct(F.lit("HISTORY").alias("key"), F.concat(key, F.lit(" = "), value).alias("value"))
    return header.select(F.explode(F.when(F.length(value) > CARD_TEXT, F.array(card, whole)).otherwise(F.array(card))).alias("x")).select("x.*")


def full_metadata(metadata: DataFrame) -> DataFrame:
    """(key, value) with the values that were cut, from the history rows."""
    whole = metadata.filter("key = 'HISTORY'").select(F.substring_index("value", " = ", 1).alias("key"), F.expr("substring(value, instr(value, ' = ') + 3)").alias("__whole"))
    return metadata.filter("key <> 'HISTORY'").join(whole, "key", "left").select("key", F.coalesce("__whole", "value").alias("value"))


def write_match(matches: DataFrame, metadata: DataFrame, path: str, form: str = "parquet") -> None:
    """The matches from the closest pair on (ties by the left id), and the metadata.

    form: parquet, or fits for binary tables that carry the metadata in their headers (a few cards, collected).
    """
    ordered = matches.orderBy("sep_arcsec", *[c for c in ("source_id_1",) if c in matches.columns])
    if form == "fits":
        fits.write_table(ordered, f"{path}/matches", {r["key"]: r["value"] or "" for r in full_metadata(metadata).collect()}, "overwrite")
    else:
        ordered.write.mode("overwrite").parquet(f"{path}/matches")
    metadata.write.mode("overwrite").parquet(f"{path}/metadata")


def fixed_width(df: DataFrame, notes: dict[str, str] | None = None, decimals: int = 6) -> DataFrame:
    """(part, ord, value): df's rows as lines of pipe-headed fixed-width tables, one for each partition of df, each in the order of ord.

    An aggregate of one row finds each column's width; names, types and notes (`\\key = value`) stand above. Numbers are right-aligned with
    so many decimals, nulls are the word null; a text must not hold a line end.
    """
    kinds = {"double": "double", "float": "double", "int": "int", "bigint": "long", "smallint": "int", "tinyint": "int"}
    types = {c: kinds.get(t, "char") for c, t in df.dtypes}
    texts = {c: F.coalesce(F.format_string(f"%.{decimals}f", F.col(f"`{c}`").cast("double")) if t == "double" else F.col(f"`{c}`").cast("string"), F.lit("null")) for c, t in types.items()}
    widths = df.agg(*[F.coalesce(F.max(F.length(texts[c])), F.lit(0)).alias(f"__w{k}") for k, c in enumerate(df.columns)])
    wide = [F.greatest(F.col(f"__w{k}"), F.lit(len(c)), F.lit(len(types[c]))) + 1 for k, c in enumerate(df.columns)]
    line = lambda cells, bar: F.concat(*[x for w, cell in zip(wide, cells) for x in (F.lit(bar), cell(w))], F.lit(bar))
    padded = lambda text: lambda w: F.rpad(F.lit(text), w, " ")
    data = [lambda w, k=k, c=c: (F.rpad if types[c] == "char" else F.lpad)(F.col(f"__t{k}"), w, " ") for k, c in enumerate(df.columns)]
    place = F.monotonically_increasing_id()
    rows = df.select(F.shiftright(place, 33).alias("part"), place.alias("ord"), *[texts[c].alias(f"__t{k}") for k, c in enumerate(df.columns)])
    body = attach(rows, widths, ()).select("part", "ord", line(data, " ").alias("value"))
    above = [*[F.lit(f"\\{key} = '{text}'") for key, text in (notes or {}).items()], line([padded(c) for c in df.columns], "|"), line([padded(types[c]) for c in df.columns], "|")]
    lines = F.array(*[F.struct(F.lit(k - len(above)).cast("long").alias("ord"), v.alias("value")) for k, v in enumerate(above)])
    heads = attach(rows.select("part").distinct(), widths, ()).select("part", F.explode(lines).alias("x")).select("part", "x.*")
    return heads.unionByName(body)


def write_fixed_width(df: DataFrame, path: str, notes: dict[str, str] | None = None, decimals: int = 6) -> None:
    """A folder for each partition of df, in order, with a file whose head names the columns; all have the same widths. read_ipac reads them back."""
    fixed_width(stored(df), notes, decimals).repartition("part").sortWithinPartitions("part", "ord").select("part", "value").write.mode("overwrite").partitionBy("part").text(path)


#: Columns by which written series are sorted, as far as a product has them.
SERIES_ORDER = ("pol", "class", "spw", "scan", "ant", "base", "chan")


def write_csv(products: dict[str, DataFrame], path: str) -> None:
    """One CSV folder for each named product; visibility series are sorted by polarisation, then by scan, antenna, baseline or channel."""
    for name, df in products.items():
        order = [c for c in SERIES_ORDER if c in df.columns]
        (df.orderBy(*order) if order else df).write.mode("overwrite").csv(f"{path}/{name}", header=True)


def write_regions(df: DataFrame, path: str) -> None:
    region_lines(df).write.mode("overwrite").partitionBy("good").text(path)


def write_source_list(df: DataFrame, path: str, form: str = "csv", notes: dict[str, str] | None = None) -> None:
    """The numbered list of good sources as CSV, or (form ipac) as a fixed-width table with notes such as the image and its frequency."""
    if form == "ipac":
        write_fixed_width(source_list(df).orderBy("n"), path, notes)
    else:
        source_list(df).write.mode("overwrite").csv(path, header=True)


def metrics_table(row: DataFrame, label: str) -> DataFrame:
    """(label, metric, value) from the numeric columns of an aggregate."""
    numbers = [c for c, k in row.dtypes if k in ("double", "float", "int", "bigint")]
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in numbers])
    return row.select(F.lit(label).alias("label"), F.explode(pairs).alias("x")).select("label", "x.*")
