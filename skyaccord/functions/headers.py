"""Column expressions on image headers (map<string,string>), frequencies in text, and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyaccord.functions.sky import tangent_plane

#: Header cards that may hold a frequency, in order of precedence (fixed values).
FREQUENCY_CARDS = ("RESTFRQ", "RESTFRQ1", "FREQ", "CFREQ", "CRVAL3")


def card(header: Column, name: str) -> Column:
    """A header value as a number; null if it is missing or no number."""
    return F.try_element_at(header, F.lit(name)).try_cast("double")


#: A frequency in text: a signed number, then a unit or none (fixed form and units).
FREQUENCY_FORM = r"^\s*([+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)\s*([A-Za-z]*)\s*$"
UNITS_HZ = {"hz": 1.0, "khz": 1e3, "mhz": 1e6, "ghz": 1e9}
#: Frequencies in file names, in order of precedence (fixed forms): a range and a single value in MHz, and three or four digits between marks.
NAME_RANGE = r"(?i)(\d+(?:\.\d+)?)\s*~\s*(\d+(?:\.\d+)?)\s*MHz"
NAME_SINGLE = r"(?i)(\d+(?:\.\d+)?)\s*MHz"
NAME_TOKEN = r"[_-](\d{3,4})(?:\.\d+)?[_-]"


def parse_frequency(text: Column, unit: str = "mhz") -> Column:
    """A number with an optional unit (Hz, kHz, MHz, GHz, any case) in Hz; null if the text is no frequency."""
    number, named = (F.regexp_extract(text, FREQUENCY_FORM, k) for k in (1, 2))
    factors = F.create_map(*[F.lit(x) for kv in UNITS_HZ.items() for x in kv])
    return number.try_cast("double") * F.try_element_at(factors, F.when(named == "", F.lit(unit)).otherwise(F.lower(named)))


def freq_from_name(path: Column) -> Column:
    """MHz from a file name: the mean of a range, else a value in MHz, else the first number between marks, which must be 100 to 6000."""
    name = F.element_at(F.split(path, "/"), -1)

    def number(form: str, k: int = 1) -> Column:
        return F.regexp_extract(name, form, k).try_cast("double")

    token = number(NAME_TOKEN)
    return F.coalesce((number(NAME_RANGE) + number(NAME_RANGE, 2)) / 2, number(NAME_SINGLE), F.when(token.between(100, 6000), token))


def header_frequency(header: Column) -> Column:
    """The first frequency card that is a number, else CRVAL1 where CTYPE1 is a frequency axis."""
    axis = F.when(F.upper(F.try_element_at(header, F.lit("CTYPE1"))).startswith("FREQ"), card(header, "CRVAL1"))
    return F.coalesce(*[card(header, c) for c in FREQUENCY_CARDS], axis)


def resolve_frequency(listed: Column, given_hz: Column, given_mhz: Column, header: Column, path: Column) -> Column:
    """Hz from the file list, else the arguments, else the header, else the name; null if none tells."""
    return F.coalesce(listed, given_hz, given_mhz * 1e6, header_frequency(header), freq_from_name(path) * 1e6)


def inject_frequency(header: Column, hz: Column) -> Column:
    """The header with minimal spectral cards where it has none."""
    text = hz.cast("string")
    cards = F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in ("CTYPE3", F.lit("FREQ"), "CRVAL3", text, "CRPIX3", F.lit("1"), "CDELT3", F.lit("1"), "CUNIT3", F.lit("Hz"), "RESTFRQ", text)])
    missing = F.map_filter(cards, lambda k, _: ~F.map_contains_key(header, k))
    return F.when(header_frequency(header).isNotNull() | hz.isNull(), header).otherwise(F.map_concat(header, missing))


#: Degrees in a unit of a header's axes, by the word that names it (fixed values).
AXIS_UNITS = {"deg": 1.0, "rad": 180 / 3.141592653589793, "arcmin": 1 / 60, "arcsec": 1 / 3600}


def pixel_scales(header: Column) -> Column:
    """Arcsec for each pixel along both axes (x, y), from CDELT or the CD matrix.

    The unit is the one that CUNIT names. Without one it is degrees, unless both steps are so small (under 1e-6) that only
    radians make sense of them.
    """
    cd = {k: F.hypot(F.coalesce(card(header, f"CD{k}_1"), F.lit(0.0)), F.coalesce(card(header, f"CD{k}_2"), F.lit(0.0))) for k in (1, 2)}
    x, y = (F.coalesce(F.abs(card(header, f"CDELT{k}")), F.when(cd[k] > 0, cd[k])) for k in (1, 2))
    named = F.create_map(*[F.lit(v) for pair in AXIS_UNITS.items() for v in pair])
    unit = F.try_element_at(named, F.rtrim(F.lower(F.try_element_at(header, F.lit("CUNIT1")))))
    guessed = F.when((F.coalesce(x, y) < 1e-6) & (F.coalesce(y, x) < 1e-6), F.lit(AXIS_UNITS["rad"])).otherwise(F.lit(1.0))
    factor = F.coalesce(unit, guessed) * 3600
    return F.struct((x * factor).alias("x"), (y * factor).alias("y"))


def pixel_scale(header: Column) -> Column:
    """Arcsec for each pixel: along y, else along x."""
    both = pixel_scales(header)
    return F.coalesce(both["y"], both["x"])


def sky_to_pixel(header: Column, ra: Column, dec: Column, far: bool = False) -> Column:
    """(x, y) of a position in degrees in an image, counted from 0 at the middle of its first pixel; gnomonic (TAN), or orthographic (SIN) where CTYPE1 says so.

    Steps come from CDELT, or from the CD matrix. Null where the header lacks a reference value or pixel, and on the far half of the sphere unless `far` asks for its mirrored place.
    """
    xi, eta = tangent_plane(ra, dec, card(header, "CRVAL1"), card(header, "CRVAL2"), F.coalesce(F.upper(F.try_element_at(header, F.lit("CTYPE1"))).endswith("SIN"), F.lit(False)), far)
    a, d = F.coalesce(card(header, "CD1_1"), card(header, "CDELT1")), F.coalesce(card(header, "CD2_2"), card(header, "CDELT2"))
    b, c = (F.coalesce(card(header, k), F.lit(0.0)) for k in ("CD1_2", "CD2_1"))
    det = F.when(F.abs(a * d - b * c) > 0, a * d - b * c)
    return F.struct(((d * xi - b * eta) / det + card(header, "CRPIX1") - 1).alias("x"), ((a * eta - c * xi) / det + card(header, "CRPIX2") - 1).alias("y"))


def beam_arcsec(header: Column) -> Column:
    return F.struct((card(header, "BMAJ") * 3600).alias("bmaj"), (card(header, "BMIN") * 3600).alias("bmin"), card(header, "BPA").alias("bpa"))


def stem(path: Column) -> Column:
    """File name without directories and its last suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def image_tag(ms: Column, band: Column, scan: Column) -> Column:
    return F.concat_ws("_", stem(ms), band, F.when(scan.isNotNull(), F.concat(F.lit("scan"), scan.cast("string"))))
