"""FITS tables and images as a Spark data source that cuts files into byte ranges.

A scan is planned from the names and sizes of files alone. A task reads the headers of its file, finds the rows that begin in its
range, and reads only those, so a cube or table may be larger than any task's memory. Columns that a schema does
not ask for are not decoded, planes that nobody wants are not read. Files are reached through Arrow's file systems (a path
with a scheme names its own), by ranges; gzip files, which cannot be cut, are decompressed as a stream by one task.
"""

from __future__ import annotations

import fnmatch
import json
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

BLOCK, CARD = 2880, 80
#: Binary-table letters and image codes as numpy types (fixed values of the format); C and M are pairs, P and Q places in the heap.
TABLE_TYPES = {"L": "S1", "X": "u1", "B": "u1", "I": ">i2", "J": ">i4", "K": ">i8", "E": ">f4", "D": ">f8", "A": "S", "C": ">f4", "M": ">f8", "P": ">i4", "Q": ">i8"}
IMAGE_TYPES = {8: "u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
#: Longest text value of a header card, and longest line of history (fixed values of the format).
CARD_TEXT, HISTORY_TEXT = 68, 72
#: Bytes of a range or of a group of small files; and of the rows that are decoded at a time.
RANGE_BYTES, READ_BYTES = 64_000_000, 4_000_000
#: Rows of a written file.
FILE_ROWS = 200_000
PIXELS = "path string, plane int, x long, y long, value double, error string"
HEADERS = "path string, unit int, kind string, header map<string,string>, error string"
SUFFIXES = (".fits", ".fit", ".fits.gz", ".fit.gz")


# ---- the format


def parse_card(card: str) -> tuple[str, str] | None:
    """Keyword and value as text, also of HIERARCH cards; None for comments and blank cards."""
    if card.startswith("HIERARCH ") and "=" in card:
        key, value = card[9:].split("=", 1)
        key, value = key.strip(), value.strip()
    elif card[8:10] == "= ":
        key, value = card[:8].strip(), card[10:].strip()
    else:
        return None
    if value.startswith("'"):
        m = re.match(r"'((?:[^']|'')*)'", value)
        return key, (m[1].replace("''", "'").rstrip() if m else value[1:])
    return key, value.split("/")[0].strip()


def parse_header(cards: Iterable[str]) -> dict[str, str]:
    """Values by keyword, the first of a keyword counts; values go on in CONTINUE cards, lines of HISTORY are joined by line ends."""
    header: dict[str, str] = {}
    history, last = [], None
    for card in cards:
        if card.startswith("HISTORY"):
            history.append(card[8:].rstrip())
        elif card.startswith("CONTINUE") and last and header[last].endswith("&"):
            m = re.search(r"'((?:[^']|'')*)'", card)
            header[last] = header[last][:-1] + (m[1].replace("''", "'").rstrip() if m else "")
        elif got := parse_card(card):
            last = got[0] if got[0] not in header else None
            header.setdefault(*got)
    if history:
        header.setdefault("HISTORY", "\n".join(history))
    return header


class Bytes:
    """Random access to a file by ranges."""

    def __init__(self, path: str):
        system, place = _system(path)
        self.file = system.open_input_file(place)
        self.size = self.file.size()

    def read(self, at: int, n: int) -> bytes:
        return self.file.read_at(n, at) if at < self.size else b""

    def close(self) -> None:
        self.file.close()


class GzipBytes:
    """The decompressed bytes of a gzip file in rising order; what has been passed is gone."""

    def __init__(self, path: str):
        system, place = _system(path)
        self.file = system.open_input_file(place)
        self.inflate, self.held, self.at = zlib.decompressobj(31), bytearray(), 0

    def _more(self) -> bool:
        raw = self.inflate.unconsumed_tail or self.file.read(1 << 18)
        if not raw:
            return False
        self.held += self.inflate.decompress(raw, 1 << 22)
        while self.inflate.eof and self.inflate.unused_data:  # another member follows
            rest, self.inflate = self.inflate.unused_data, zlib.decompressobj(31)
            self.held += self.inflate.decompress(rest)
        return True

    def read(self, at: int, n: int) -> bytes:
        if at < self.at:
            raise ValueError("a gzip file is read forwards only")
        while self.at + len(self.held) < at + n:
            passed = min(at - self.at, len(self.held))
            del self.held[:passed]
            self.at += passed
            if not self._more():
                break
        passed = min(at - self.at, len(self.held))
        del self.held[:passed]
        self.at += passed
        return bytes(self.held[:n]) if self.at == at else b""

    def close(self) -> None:
        self.file.close()


def open_bytes(path: str) -> Bytes | GzipBytes:
    """By its first bytes, not its name, a file is gzip or not."""
    plain = Bytes(path)
    if plain.read(0, 2) != b"\x1f\x8b":
        return plain
    plain.close()
    return GzipBytes(path)


@dataclass
class Unit:
    header: dict[str, str]
    start: int  # of its data
    size: int

    @property
    def is_table(self) -> bool:
        return self.header.get("XTENSION", "").startswith("BINTABLE")

    @property
    def is_image(self) -> bool:
        return self.size > 0 and (self.header.get("XTENSION", "IMAGE").startswith("IMAGE"))


def units(file: Bytes | GzipBytes) -> Iterator[Unit]:
    """The units of a file; only headers are read. A file that does not begin with a header, or ends within one, is an error."""
    at = 0
    while block := file.read(at, BLOCK):
        cards: list[str] = []
        ended = False
        while not ended:
            if len(block) < BLOCK:
                if cards or not at:
                    raise ValueError("the file ends within a header")
                return
            if not at and not cards and not block.startswith(b"SIMPLE  ="):
                raise ValueError("no FITS header")
            for k in range(0, BLOCK, CARD):
                card = block[k : k + CARD].decode("ascii", "replace")
                if card.startswith("END") and not card[3:].strip():
                    ended = True
                    break
                cards.append(card)
            at += BLOCK
            if not ended:
                block = file.read(at, BLOCK)
        header = parse_header(cards)
        axes = [int(header.get(f"NAXIS{i + 1}", 0)) for i in range(int(header.get("NAXIS", 0)))]
        size = abs(int(header.get("BITPIX", 8))) // 8 * int(header.get("GCOUNT", 1)) * (int(header.get("PCOUNT", 0)) + int(np.prod(axes, dtype=object))) if axes else 0
        yield Unit(header, at, size)
        at += -(-size // BLOCK) * BLOCK


def _floats(raw: np.ndarray, scale: float, zero: float) -> np.ndarray:
    return raw.astype(float) if scale == 1 and zero == 0 else raw.astype(float) * scale + zero


class Column:
    """A field of a binary table."""

    def __init__(self, header: dict[str, str], i: int):
        count, letter, rest = re.match(r"\s*(\d*)([LXBIJKADECMPQ])(.*)", header[f"TFORM{i}"]).groups()
        self.name, self.letter, self.n = header.get(f"TTYPE{i}", f"col{i}").strip(), letter, int(count or 1)
        self.scale, self.zero = float(header.get(f"TSCAL{i}", 1)), float(header.get(f"TZERO{i}", 0))
        self.null = int(header[f"TNULL{i}"]) if f"TNULL{i}" in header else None
        self.inner = rest.strip()[:1] if letter in "PQ" else None
        kind = TABLE_TYPES[letter]
        many = {"X": -(-self.n // 8), "C": 2 * self.n, "M": 2 * self.n, "P": 2 * self.n, "Q": 2 * self.n}.get(letter, self.n)
        self.field = f"S{self.n}" if letter == "A" and self.n else (kind, (many,)) if letter != "A" and many != 1 else kind if self.n else "V0"

    def numbers(self, raw: np.ndarray, letter: str) -> pa.Array:
        """Flat values of a number type: whole numbers stay whole if they are not scaled, or only by the offset that makes them unsigned."""
        if letter in "EDCM":
            v = _floats(raw, self.scale, self.zero)
            return pa.array(v, mask=np.isnan(v))
        missing = raw == self.null if self.null is not None else None
        if self.scale == 1 and self.zero == int(self.zero) and abs(self.zero) < 1 << 62:
            return pa.array(raw.astype(np.int64) + int(self.zero), mask=missing)
        if self.scale == 1 and letter == "K" and self.zero == 2.0**63:
            return pa.array(raw.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63), mask=missing)
        return pa.array(_floats(raw, self.scale, self.zero), mask=missing)

    def decode(self, raw: np.ndarray, heap) -> pa.Array:
        rows, letter = len(raw), self.letter
        if not self.n:
            return pa.nulls(rows)
        if letter == "A":
            return pa.array([x.split(b"\0")[0].decode("ascii", "replace").rstrip() for x in raw.tolist()])
        if letter == "L":
            return self._lists(pa.array([{b"T": True, b"F": False}.get(x) for x in raw.ravel().tolist()]), rows, self.n)
        if letter == "X":
            bits = np.unpackbits(raw.reshape(rows, -1), axis=1)[:, : self.n]
            return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * self.n), pa.array(bits.ravel().astype(bool)))
        if letter in "PQ":
            return self._variable(raw.reshape(rows, -1, 2)[:, 0], heap)
        width = 2 * self.n if letter in "CM" else self.n
        return self._lists(self.numbers(raw.ravel(), letter), rows, width)

    @staticmethod
    def _lists(flat: pa.Array, rows: int, width: int) -> pa.Array:
        return flat if width == 1 else pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), flat)

    def _variable(self, places: np.ndarray, heap) -> pa.Array:
        letter = self.inner
        if letter not in "BIJKEDCMA":
            raise ValueError(f"no lists of type {letter}")
        dtype, per = np.dtype(TABLE_TYPES[letter] if letter != "A" else "u1"), 2 if letter in "CM" else 1
        parts = [heap(int(at), int(n) * per * dtype.itemsize) for n, at in places.tolist()]
        if letter == "A":
            return pa.array([p.split(b"\0")[0].decode("ascii", "replace").rstrip() for p in parts])
        flat = np.frombuffer(b"".join(parts), dtype)
        ends = np.concatenate(([0], np.cumsum([len(p) // dtype.itemsize for p in parts]))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), self.numbers(flat, letter))


# ---- files


def _system(path: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]+:", path):
        if path.startswith("file:"):
            return fs.LocalFileSystem(), re.sub("^file:/*", "/", path)
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def find_files(pattern: str) -> list[tuple[str, int]]:
    """(path, size) of the files of a folder (FITS suffixes only, and below it) or of a glob, in order of their paths, with the pattern's scheme."""
    system, place = _system(pattern)
    scheme = pattern[: len(pattern) - len(place)] if pattern.endswith(place) else ""
    parts = place.rstrip("/").split("/")
    wild = next((k for k, p in enumerate(parts) if any(c in p for c in "*?[")), None)
    if wild is None:
        info = system.get_file_info(place)
        if info.type == fs.FileType.File:
            return [(scheme + info.path, info.size)]
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(pattern)
        found = system.get_file_info(fs.FileSelector(place, recursive=True))
        return sorted((scheme + f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.lower().endswith(SUFFIXES))
    base = "/".join(parts[:wild]) or "/"
    found = system.get_file_info(fs.FileSelector(base, recursive=len(parts) - wild > 1, allow_not_found=True))

    def fits(path: str) -> bool:
        own = path.rstrip("/").split("/")
        return len(own) == len(parts) and all(fnmatch.fnmatchcase(a, b) for a, b in zip(own[wild:], parts[wild:]))

    return sorted((scheme + f.path, f.size) for f in found if f.type == fs.FileType.File and fits(f.path))


class Ranges(InputPartition):
    """Parts of files: (path, first byte, byte after the last, whether the file ends there)."""

    def __init__(self, parts: list[tuple[str, int, int, bool]]):
        self.parts = parts


def plan_ranges(files: list[tuple[str, int]], size: int) -> list[Ranges]:
    """Large files in ranges of `size` bytes, small ones together. A gzip file is one range, known by its name."""
    out, group, held = [], [], 0
    for path, n in files:
        if n > size and not path.lower().endswith(".gz"):
            cuts = [*range(0, n, size), n]
            out += [Ranges([(path, a, b, b == n)]) for a, b in zip(cuts, cuts[1:])]
            continue
        if group and held + n > size:
            out.append(Ranges(group))
            group, held = [], 0
        group.append((path, 0, n, True))
        held += n
    return out + ([Ranges(group)] if group else [])


def _rows_of(unit: Unit, width: int, rows: int, part: tuple[str, int, int, bool], streamed: bool) -> tuple[int, int]:
    """The rows of a unit that begin in a part of its file."""
    _, start, end, last = part
    if streamed:
        return 0, rows
    first = min(max(0, -(-(start - unit.start) // width)), rows)
    return first, rows if last else min(max(0, -(-(end - unit.start) // width)), rows)


class FitsReader(DataSourceReader):
    """One row for every pixel, table row or unit; and one with its error for a file that cannot be read, after what could be."""

    def __init__(self, options: dict[str, str], schema: StructType):
        self.options, self.schema = dict(options), schema
        self.planes = [int(p) for p in json.loads(options["planes"])] if "planes" in options else None

    def partitions(self) -> list[InputPartition]:
        patterns = json.loads(self.options["paths"]) if "paths" in self.options else [self.options["path"]]
        files = dict(chain.from_iterable(map(find_files, patterns)))
        return plan_ranges(list(files.items()), int(self.options.get("rangebytes", RANGE_BYTES))) or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(self.schema)
        for part in partition.parts:
            file = None
            try:
                file = open_bytes(part[0])
                for n, columns in self.rows(file, part, schema):
                    yield self._batch(schema, n, part[0], columns)
            except (ArithmeticError, LookupError, OSError, ValueError, TypeError, AttributeError, zlib.error, pa.ArrowException) as e:
                if "error" in schema.names:
                    yield self._batch(schema, 1, part[0], {"error": pa.array([f"{type(e).__name__}: {e}"])})
            finally:
                if file:
                    file.close()

    @staticmethod
    def _batch(schema: pa.Schema, n: int, path: str, columns: dict[str, pa.Array]) -> pa.RecordBatch:
        out = []
        for f in schema:
            if f.name == "path":
                out.append(pa.array([path], f.type).take(pa.array(np.zeros(n, np.int64))))
            else:
                got = columns.get(f.name)
                out.append(pa.nulls(n, f.type) if got is None else got if got.type == f.type else got.cast(f.type))
        return pa.RecordBatch.from_arrays(out, schema=schema)

    def rows(self, file, part, schema: pa.Schema) -> Iterator[tuple[int, dict[str, pa.Array]]]:
        raise NotImplementedError

    @staticmethod
    def chunks(file, unit: Unit, width: int, first: int, end: int) -> Iterator[tuple[int, bytes]]:
        """(row, bytes) of whole rows, a few megabytes at a time; a file that ends early is an error after its last whole row."""
        step = max(1, READ_BYTES // max(1, width))
        for r in range(first, end, step):
            n = min(step, end - r)
            data = file.read(unit.start + r * width, n * width)
            whole = len(data) // width if width else n
            if whole:
                yield r, data[: whole * width]
            if whole < n:
                raise ValueError(f"the file ends after row {r + whole} of its data")


class FitsImageReader(FitsReader):
    def rows(self, file, part, schema):
        try:
            unit = next((u for u in units(file) if u.is_image), None)
        except ValueError:
            if part[1]:
                return  # the task of the file's first range tells
            raise
        if not unit:
            if not part[1]:
                raise ValueError("no image")
            return
        h = unit.header
        kind = np.dtype(IMAGE_TYPES.get(int(h["BITPIX"]), "V1"))
        if kind.kind == "V":
            if not part[1]:
                raise ValueError(f"no pixels of type {h['BITPIX']}")
            return
        nx, ny = int(h["NAXIS1"]), int(h.get("NAXIS2", 1))
        total = unit.size // (nx * kind.itemsize)
        first, end = _rows_of(unit, nx * kind.itemsize, total, part, isinstance(file, GzipBytes))
        scale, zero = float(h.get("BSCALE", 1)), float(h.get("BZERO", 0))
        blank = int(h["BLANK"]) if "BLANK" in h and kind.kind != "f" else None
        stretches = [(first, end)]
        if self.planes is not None:
            stretches = [(max(first, p * ny), min(end, (p + 1) * ny)) for p in sorted(set(self.planes))]
        for a, b in stretches:
            for r, data in self.chunks(file, unit, nx * kind.itemsize, a, b):
                raw = np.frombuffer(data, kind)
                row = np.arange(r, r + len(raw) // nx)
                columns = {}
                if "value" in schema.names:
                    v = _floats(raw, scale, zero)
                    columns["value"] = pa.array(v, mask=np.isnan(v) if blank is None else raw == blank)
                if "plane" in schema.names:
                    columns["plane"] = pa.array(np.repeat(row // ny, nx).astype(np.int32))
                if "x" in schema.names:
                    columns["x"] = pa.array(np.tile(np.arange(nx), len(row)))
                if "y" in schema.names:
                    columns["y"] = pa.array(np.repeat(row % ny, nx))
                yield len(raw), columns


class FitsTableReader(FitsReader):
    def rows(self, file, part, schema):
        try:
            unit = next((u for u in units(file) if u.is_table), None)
        except ValueError:
            if part[1]:
                return
            raise
        if not unit:
            if not part[1]:
                raise ValueError("no binary table")
            return
        h = unit.header
        width, rows = int(h["NAXIS1"]), int(h["NAXIS2"])
        columns = [Column(h, i) for i in range(1, int(h["TFIELDS"]) + 1)]
        dtype = np.dtype([(f"f{k}", *(c.field if isinstance(c.field, tuple) else (c.field,))) for k, c in enumerate(columns)])
        if dtype.itemsize != width:
            raise ValueError(f"rows of {width} bytes have fields of {dtype.itemsize}")
        wanted: dict[str, tuple[int, Column]] = {}
        for k, c in enumerate(columns):
            wanted.setdefault(c.name.lower(), (k, c))
        asked = [(f.name, *wanted[f.name.lower()]) for f in schema if f.name not in ("path", "header", "error") and f.name.lower() in wanted]
        streamed, heap_at = isinstance(file, GzipBytes), unit.start + int(h.get("THEAP", width * rows))
        lists = any(c.letter in "PQ" for _, _, c in asked)
        held = file.read(unit.start, unit.size) if streamed and lists else None  # its lists lie behind its rows

        def heap(at: int, n: int) -> bytes:
            got = held[heap_at - unit.start + at :][:n] if held is not None else file.read(heap_at + at, n)
            if len(got) < n:
                raise ValueError("the file ends within its lists")
            return got

        first, end = _rows_of(unit, width, rows, part, streamed)
        cards = pa.array([list(h.items())], pa.map_(pa.string(), pa.string())) if "header" in schema.names else None
        source = Held(held, unit.start) if held is not None else file
        for _, data in self.chunks(source, unit, width, first, end):
            got = np.frombuffer(data, dtype)
            out = {name: c.decode(got[f"f{k}"], heap) for name, k, c in asked}
            if cards is not None:
                out["header"] = cards.take(pa.array(np.zeros(len(got), np.int64)))
            yield len(got), out


class Held:
    """Bytes in memory that begin at a place of their file."""

    def __init__(self, data: bytes, start: int):
        self.data, self.start = data, start

    def read(self, at: int, n: int) -> bytes:
        return self.data[at - self.start :][:n]


class FitsHeaderReader(FitsReader):
    def rows(self, file, part, schema):
        if part[1]:
            return  # headers are read with the first range
        for k, u in enumerate(units(file)):
            kind = "table" if u.is_table else "image" if u.is_image else "other"
            yield 1, {"unit": pa.array([k]), "kind": pa.array([kind]), "header": pa.array([list(u.header.items())], pa.map_(pa.string(), pa.string()))}


# ---- writing tables


def card(key: str, value: str | float) -> bytes:
    """A header card; long keywords in HIERARCH form. A text must fit."""
    number = isinstance(value, int | float)
    text = str(value) if number else f"'{value.replace(chr(39), 2 * chr(39)):<8}'"
    line = f"{key:<8}= {text:>20}" if len(key) <= 8 and number else f"{key:<8}= {text}" if len(key) <= 8 else f"HIERARCH {key} = {text}"
    return f"{line:<80}".encode("ascii", "replace")[:CARD]


def header_cards(values: dict[str, str]) -> Iterator[bytes]:
    """Cards of texts: a long path by its last part, another long text cut; lines of history keep what does not fit whole."""
    for key, value in values.items():
        room = min(CARD_TEXT, CARD - 12 - (9 + len(key) - 8 if len(key) > 8 else 0)) - value.count("'")
        short = value if len(value) <= room else value.rsplit("/", 1)[-1]
        yield card(key, short[: max(0, room)])
        if short[: max(0, room)] != value:
            yield from history_cards(key, value)


def history_cards(key: str, value: str) -> Iterator[bytes]:
    text = f"{key} = {json.dumps(value)}"
    for at in range(0, len(text), HISTORY_TEXT - 1):
        # A line that goes on ends in a bar, which keeps blanks before it.
        more = "|" if at + HISTORY_TEXT - 1 < len(text) else ""
        yield f"{'HISTORY ' + text[at : at + HISTORY_TEXT - 1] + more:<80}".encode()


def full_values(header: dict[str, str]) -> dict[str, str]:
    """The header with the values that were cut, from its history."""
    out, text = dict(header), ""
    for line in header.get("HISTORY", "").split("\n"):
        text += line[:-1] if line.endswith("|") and len(line) == HISTORY_TEXT else line
        if line.endswith("|") and len(line) == HISTORY_TEXT:
            continue
        if m := re.match(r'(\S+) = (".*")$', text):
            out[m[1]] = json.loads(m[2])
        text = ""
    return out


def table_bytes(rows: pa.Table, values: dict[str, str]) -> bytes:
    """A file with one binary table: null numbers as NaN or as the least whole number (TNULL), null texts as empty ones."""
    cards = [card("XTENSION", "BINTABLE"), card("BITPIX", 8), card("NAXIS", 2)]
    fields, forms = [], []
    for name, column in zip(rows.column_names, rows.columns):
        column, t = column.combine_chunks(), column.type
        if pa.types.is_floating(t):
            form, data = ("E", ">f4") if t == pa.float32() else ("D", ">f8"), column.fill_null(float("nan")).to_numpy(zero_copy_only=False)
            null = None
        elif pa.types.is_integer(t):
            form = {8: ("I", ">i2"), 16: ("I", ">i2"), 32: ("J", ">i4"), 64: ("K", ">i8")}[t.bit_width]
            null = int(np.iinfo(form[1][1:]).min)
            data = column.cast(pa.int64()).fill_null(null).to_numpy(zero_copy_only=False)
        elif pa.types.is_boolean(t):
            form, null = ("L", "S1"), None
            data = np.array([b"\0" if v is None else b"T" if v else b"F" for v in column.to_pylist()], "S1")
        elif pa.types.is_string(t) or pa.types.is_large_string(t):
            texts = [(v or "").encode("ascii", "replace") for v in column.to_pylist()]
            width = max([1, *map(len, texts)])
            form, null, data = (f"{width}A", f"S{width}"), None, np.array(texts, f"S{width}")
        else:
            raise ValueError(f"column {name} of type {t} has no form in a binary table")
        fields.append((form, data))
        forms.append((name, form[0], null))
    packed = np.zeros(rows.num_rows, [(f"f{k}", form[1]) for k, (form, _) in enumerate(fields)])
    for k, (_, data) in enumerate(fields):
        packed[f"f{k}"] = data
    cards += [card("NAXIS1", packed.dtype.itemsize), card("NAXIS2", rows.num_rows), card("PCOUNT", 0), card("GCOUNT", 1), card("TFIELDS", len(fields))]
    for i, (name, form, null) in enumerate(forms, 1):
        cards += [card(f"TTYPE{i}", name), card(f"TFORM{i}", form), *([card(f"TNULL{i}", null)] if null is not None else [])]
    cards += header_cards(values)
    first = [f"{'SIMPLE  =                    T':<80}".encode(), card("BITPIX", 8), card("NAXIS", 0), f"{'EXTEND  =                    T':<80}".encode()]
    heads = b"".join(_blocks(b"".join([*c, f"{'END':<80}".encode()]), b" ") for c in (first, cards))
    return heads + _blocks(packed.tobytes(), b"\0")


def _blocks(data: bytes, fill: bytes) -> bytes:
    return data + fill * (-len(data) % BLOCK)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class FitsTableWriter(DataSourceArrowWriter):
    """Files of at most FILE_ROWS rows under names of their own; those of a job that fails, or that is not finished, are removed."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.values = json.loads(options.get("header", "{}"))
        if overwrite:
            system, place = _system(self.path)
            if system.get_file_info(place).type == fs.FileType.Directory:
                system.delete_dir_contents(place)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        import uuid

        system, place = _system(self.path)
        system.create_dir(place, recursive=True)
        done: list[str] = []

        def put(batches: list[pa.RecordBatch]) -> None:
            name = f"{place}/part-{uuid.uuid4().hex}.fits"
            with system.open_output_stream(name + ".writing") as out:
                out.write(table_bytes(pa.Table.from_batches(batches), self.values))
            done.append(name)

        held, n = [], 0
        for batch in iterator:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, FILE_ROWS - n)
                held.append(part)
                n, at = n + part.num_rows, at + part.num_rows
                if n == FILE_ROWS:
                    put(held)
                    held, n = [], 0
        if held:
            put(held)
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        system, _ = _system(self.path)
        for m in messages:
            for name in m.files if m else ():
                system.move(name + ".writing", name)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = _system(self.path)
        for m in messages:
            for name in m.files if m else ():
                if system.get_file_info(name + ".writing").type == fs.FileType.File:
                    system.delete_file(name + ".writing")


# ---- the sources


class _Fits(DataSource):
    kind: type = FitsReader

    def reader(self, schema: StructType) -> DataSourceReader:
        return self.kind(self.options, schema)


class FitsImages(_Fits):
    """Pixels of the first image with data of each file."""

    kind = FitsImageReader

    @classmethod
    def name(cls) -> str:
        return "skyaccord_fits_image"

    def schema(self) -> str:
        return PIXELS


class FitsTables(_Fits):
    """Rows of the first binary table of each file; the schema names the columns that are wanted. Tables can be written, too."""

    kind = FitsTableReader

    @classmethod
    def name(cls) -> str:
        return "skyaccord_fits_table"

    def schema(self) -> str:
        raise ValueError("name the wanted columns by a schema")

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return FitsTableWriter(self.options, overwrite)


class FitsHeaders(_Fits):
    """Headers of all units of each file."""

    kind = FitsHeaderReader

    @classmethod
    def name(cls) -> str:
        return "skyaccord_fits_header"

    def schema(self) -> str:
        return HEADERS


def register(spark: SparkSession) -> None:
    for source in (FitsImages, FitsTables, FitsHeaders):
        spark.dataSource.register(source)


def _load(spark: SparkSession, source: type, paths: str | list[str], schema: str | None, range_bytes: int, **options: str) -> DataFrame:
    register(spark)
    reader = spark.read.format(source.name()).option("paths", json.dumps([paths] if isinstance(paths, str) else paths)).option("rangeBytes", range_bytes)
    for k, v in options.items():
        reader = reader.option(k, v)
    return (reader.schema(schema) if schema else reader).load()


def read_headers(spark: SparkSession, paths: str | list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, unit, kind, header, error) of every unit; kind is image, table or other. Only header blocks are read."""
    return _load(spark, FitsHeaders, paths, None, range_bytes)


def ingest_tables(spark: SparkSession, paths: str | list[str], columns: dict[str, str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, header, error, columns...) of the first binary table of each file, in ranges of rows; a column that a file lacks is null.

    columns: names (any case) and Spark types. Values are scaled (TSCAL, TZERO); TNULL and NaN are null. Vectors are
    arrays, complex numbers pairs (one after the other in vectors), bits arrays of booleans, lists in the heap arrays. A
    file that cannot be decoded, or holds no table, gives one row with its error after the rows that could be read; other
    rows have a null error. Of a gzip file with lists the whole table is held by its task.
    """
    fields = ", ".join(f"`{n}` {t}" for n, t in columns.items())
    return _load(spark, FitsTables, paths, f"path string, header map<string,string>, error string, {fields}", range_bytes)


def read_image_pixels(spark: SparkSession, paths: str | list[str], planes: list[int] | None = None, range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(images, pixels): (path, header, error), and (path, plane, x, y, value, error) of the first image with data of each file.

    Planes, x and y count from 0; axes beyond the second are counted on as planes. Only the planes asked for are read. Blanked
    pixels (BLANK in images of whole numbers, NaN in others) are null; others are scaled by BSCALE and BZERO. A file that
    cannot be decoded, or that ends early, has one row with its error in `pixels`, after the pixels that could be read.
    """
    heads = read_headers(spark, paths, range_bytes)
    first = heads.filter("kind = 'image' OR error IS NOT NULL").groupBy("path").agg(F.min_by(F.struct("header", "error"), F.coalesce("unit", F.lit(1 << 30))).alias("first"))
    options = {} if planes is None else {"planes": json.dumps(planes)}
    return first.select("path", "first.header", "first.error"), _load(spark, FitsImages, paths, None, range_bytes, **options)


def write_table(df: DataFrame, path: str, values: dict[str, str] | None = None, mode: str = "append") -> None:
    """df as binary tables under a folder, one or more files for each partition; `values` go to every file's header, whole in its history where a card cannot hold them."""
    register(df.sparkSession)
    df.write.format(FitsTables.name()).option("header", json.dumps(values or {})).mode(mode).save(path)
