"""Readers of catalogues, statistics and lists."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyaccord.functions.headers import parse_frequency
from skyaccord.lineage import stored
from skyaccord.operators.clean import nan_to_null
from skyaccord.operators.match import sky_match
from skyaccord.sources import fits

#: Columns of the ASCII catalogue by position, counted from 1 (fixed values).
ASCII_COLUMNS = {1: "source_id", 3: "ra", 4: "e_ra", 5: "dec", 6: "e_dec", 7: "total_flux", 8: "e_total_flux", 9: "peak_flux", 10: "e_peak_flux", 15: "maj", 16: "e_maj", 17: "min", 18: "e_min", 19: "pa", 20: "e_pa", 43: "isl_rms"}
_DEGREES_TO_ARCSEC = ("e_ra", "e_dec", "maj", "e_maj", "min", "e_min")


def read_catalog(spark: SparkSession, path: str, ra: str = "ra", dec: str = "dec") -> DataFrame:
    """A Parquet or CSV catalogue; its coordinate columns must exist, under any case. NaN becomes null."""
    df = spark.read.csv(path, header=True, inferSchema=True) if path.rstrip("/").endswith(".csv") else spark.read.parquet(path)
    by_lower = {c.lower(): c for c in df.columns}
    missing = [c for c in (ra, dec) if c.lower() not in by_lower]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}; it has {', '.join(df.columns)}")
    return nan_to_null(df.withColumnsRenamed({by_lower[c.lower()]: c for c in (ra, dec)}))


def read_ascii_catalog(spark: SparkSession, path: str) -> DataFrame:
    """White-space columns by position; sizes and position errors from degrees to arcsec, position angles turned by 90."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).filter(~F.trim("value").startswith("#") & (F.trim("value") != "")).select(parts.alias("p"))

    def field(k: int, name: str) -> Column:
        v = F.try_element_at("p", F.lit(k)).try_cast("long" if name == "source_id" else "double")
        v = v * 3600 if name in _DEGREES_TO_ARCSEC else v + 90 if name == "pa" else v
        return v.alias(name)

    return lines.select([field(k, n) for k, n in ASCII_COLUMNS.items()])


def read_channel_stats(spark: SparkSession, glob: str, prefix: str = "", suffix: str = ".csv") -> DataFrame:
    """Channel statistics of many files with their file name."""
    columns = "mode string, freqs double, freq0 double, fd_max double, fd_min double, fd_avg double, fd_rms double, fd_sgm double"
    df = spark.read.csv(glob, schema=columns, comment="#").withColumn("file", F.col("_metadata.file_name"))
    return df.filter(F.col("file").startswith(prefix) & F.col("file").endswith(suffix))


def read_ipac(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, metadata) of pipe-headed fixed-width tables: rows as map<string,string> by file, and key = value comments.

    The first line that starts with a bar names the columns and fixes their borders for its file.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), "value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    heads = lines.filter(F.col("value").startswith("|")).groupBy("file").agg(F.min_by("value", F.struct("block", "at")).alias("head"))
    names = F.filter(F.transform(F.split("head", r"\|"), lambda c: F.trim(c)), lambda c: c != "")
    widths = F.transform(F.filter(F.split("head", r"\|"), lambda c: c != ""), lambda c: F.length(c) + 1)
    starts = F.transform(F.sequence(F.lit(1), F.size(widths)), lambda i: 2 + F.aggregate(F.slice(widths, 1, i - 1), F.lit(0), lambda a, w: a + w))
    data = lines.filter(~F.col("value").startswith("|") & ~F.col("value").startswith("\\") & (F.trim("value") != "")).join(F.broadcast(heads), "file")  # a row for each file
    cells = F.zip_with(starts, widths, lambda s, w: F.trim(F.col("value").substr(s, w - 1)))
    rows = data.select("file", F.map_from_arrays(names, cells).alias("row"))
    pattern = r"^\\(?:[A-Za-z]+\s+)?([A-Za-z0-9_]+)\s*=\s*(.*?)\s*$"
    notes = lines.filter(F.col("value").startswith("\\")).select("file", F.regexp_extract("value", pattern, 1).alias("key"), F.regexp_replace(F.regexp_extract("value", pattern, 2), "^'|'$", "").alias("value")).filter("key <> ''")
    return rows, notes


def list_files(spark: SparkSession, glob: str, suffix: str = "") -> DataFrame:
    """(path, length) of files without reading them."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(glob).select("path", "length")


def expand_manifest(spark: SparkSession, patterns: list[str], suffixes: tuple[str, ...] = (".fits", ".fit", ".fits.gz")) -> DataFrame:
    """(path, ord): files of folders and globs, in order of the patterns, each once."""
    found = None
    for k, p in enumerate(patterns):
        files = list_files(spark, p).withColumn("ord", F.lit(k))
        found = files if found is None else found.unionByName(files)
    if found is None:
        return spark.createDataFrame([], "path string, ord int")
    kept = found.filter(F.lower("path").rlike("|".join(s.replace(".", r"\.") + "$" for s in suffixes)))
    return kept.groupBy("path").agg(F.min("ord").alias("ord"))


def parse_filelist(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, rejects) of text lines (ord, value): `<path> <frequency>`, with commas allowed and # for comments."""
    text = F.trim(F.regexp_replace(F.regexp_replace("value", "#.*$", ""), ",", " "))
    parts = F.split(text, r"\s+")
    rows = lines.withColumn("p", parts).filter(text != "").select("ord", "value", F.try_element_at("p", F.lit(1)).alias("path"), parse_frequency(F.concat_ws("", F.slice("p", 2, 8))).alias("freq_hz"))
    return rows.filter("freq_hz IS NOT NULL").select("ord", "path", "freq_hz"), rows.filter("freq_hz IS NULL").select("ord", "value")


def check_tables(files: DataFrame) -> DataFrame:
    """(path, n, error) of Parquet files (path): inside tasks each footer and then each page is read, a batch at a time; n counts the rows that could be read.

    The error tells a missing file from one that is no Parquet file, and from one that breaks off. Files are reached
    as the FITS source reaches them.
    """

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path in frame["path"]:
                n, problem = 0, None
                try:
                    system, place = fits._system(path)
                    with system.open_input_file(place) as raw:
                        for batch in pq.ParquetFile(raw).iter_batches(8192):
                            n += batch.num_rows
                except FileNotFoundError:
                    problem = "missing"
                except (OSError, ValueError, pa.ArrowException) as e:
                    problem = f"{type(e).__name__}: {e}"
                yield pd.DataFrame({"path": [path], "n": [n], "error": [problem]})

    return files.select("path").mapInPandas(run, "path string, n long, error string")


def scan_glob(spark: SparkSession, glob: str | list[str], schema: str, on_error: str = "row") -> tuple[DataFrame, DataFrame]:
    """(rows, files) of one Parquet table for each scan: rows carry scan_id, files tell how many rows were read and, for a broken or missing file, the reason.

    Rows come from files that can be read; on_error='row' lists the others with their error and the n of rows that rows has of
    them, 'skip' leaves them out. A list may name files that do not exist.
    """
    if isinstance(glob, str):
        names = list_files(spark, glob).select("path")
    else:
        names = spark.createDataFrame([(p,) for p in glob], "path string")
    state = stored(check_tables(names.repartition(max(1, min(names.count(), 10_000))))).withColumn("scan_id", F.element_at(F.split("path", "/"), -1))
    reader = spark.read.schema(schema).option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    there = [glob] if isinstance(glob, str) else [r["path"] for r in state.filter("error IS NULL OR error <> 'missing'").select("path").collect()]  # named files only
    rows = (reader.parquet(*there) if there else spark.createDataFrame([], schema)).withColumn("scan_id", F.col("_metadata.file_name") if there else F.lit(None).cast("string"))
    read = rows.groupBy("scan_id").agg(F.count("*").alias("n"))
    files = state.select("scan_id", "error").join(read, "scan_id", "left").select("scan_id", F.coalesce("n", F.lit(0)).alias("n"), "error")
    return rows, files if on_error == "row" else files.filter("error IS NULL")


def run_jobs(spark: SparkSession, jobs: Mapping[str, Callable[[], int | None]], at_once: int = 4) -> DataFrame:
    """(job, ok, rows, error, seconds): functions that each run and write a job of their own, several at a time, each in a scheduler pool of its name.

    A job that fails leaves the others alone: its row has the error. What a function returns is reported as its rows.
    """

    def one(name: str) -> tuple:
        began = time.monotonic()
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
        try:
            rows, error = jobs[name](), None
        except Exception as e:  # noqa: BLE001 (a job may fail in any way)
            rows, error = None, f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)
        return name, error is None, rows, error, time.monotonic() - began

    with ThreadPoolExecutor(max(1, min(at_once, len(jobs)))) as pool:
        done = list(pool.map(one, jobs))
    return spark.createDataFrame(done, "job string, ok boolean, rows long, error string, seconds double")


def match_catalogues(spark: SparkSession, jobs: Mapping[str, tuple[str, str]], out: str, radius_arcsec: float = 1.0, mode: str = "one_to_one", at_once: int = 4) -> DataFrame:
    """Match jobs {name: (left path, right path)} with the results under out/name, and run_jobs' table of how each went."""

    def job(name: str, left: str, right: str) -> Callable[[], int]:
        def run() -> int:
            found = sky_match(read_catalog(spark, left), read_catalog(spark, right), radius_arcsec, mode)
            found.write.mode("overwrite").parquet(f"{out}/{name}")
            return spark.read.parquet(f"{out}/{name}").count()

        return run

    return run_jobs(spark, {name: job(name, *paths) for name, paths in jobs.items()}, at_once)


def union_jobs(catalogues: list[tuple[str, DataFrame]]) -> DataFrame:
    """Catalogues of many match jobs in one table with a job_id; columns that a catalogue lacks are null."""
    out = None
    for job, df in catalogues:
        df = df.withColumn("job_id", F.lit(job))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out
