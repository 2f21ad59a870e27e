"""Column expressions on the sphere and in the image plane. Angles are degrees unless a name says otherwise."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ARCSEC = 3600.0


def unit_vector(ra: Column, dec: Column) -> tuple[Column, Column, Column]:
    a, d = F.radians(ra), F.radians(dec)
    return F.cos(d) * F.cos(a), F.cos(d) * F.sin(a), F.sin(d)


def ang_sep_arcsec(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Great-circle separation in the form that stays exact far below one arcsecond."""
    d1, d2, da = F.radians(dec1), F.radians(dec2), F.radians(ra2 - ra1)
    east = F.cos(d2) * F.sin(da)
    north = F.cos(d1) * F.sin(d2) - F.sin(d1) * F.cos(d2) * F.cos(da)
    along = F.sin(d1) * F.sin(d2) + F.cos(d1) * F.cos(d2) * F.cos(da)
    return F.degrees(F.atan2(F.sqrt(east * east + north * north), along)) * ARCSEC


def spherical_offsets(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> tuple[Column, Column]:
    """(east, north) arcsec of point 2 in the frame in which point 1 is the origin."""
    d1, d2, da = F.radians(dec1), F.radians(dec2), F.radians(ra2 - ra1)
    x = F.cos(d1) * F.cos(d2) * F.cos(da) + F.sin(d1) * F.sin(d2)
    y = F.cos(d2) * F.sin(da)
    z = F.sin(d2) * F.cos(d1) - F.cos(d2) * F.sin(d1) * F.cos(da)
    return F.degrees(F.atan2(y, x)) * ARCSEC, F.degrees(F.asin(z)) * ARCSEC


def ra_difference(ra1: Column, ra2: Column) -> Column:
    """ra2 - ra1 by the short way round: a pair on both sides of RA 0 is no turn apart."""
    d = ra2 - ra1
    return F.when(d > 180, d - 360).when(d < -180, d + 360).otherwise(d)


def offsets_mid(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> tuple[Column, Column]:
    """Arcsec offsets with the cosine of the mean declination."""
    return ra_difference(ra1, ra2) * F.cos(F.radians((dec1 + dec2) / 2)) * ARCSEC, (dec2 - dec1) * ARCSEC


def offsets_flat(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> tuple[Column, Column]:
    """Arcsec offsets with the cosine of the first declination."""
    return ra_difference(ra1, ra2) * F.cos(F.radians(dec1)) * ARCSEC, (dec2 - dec1) * ARCSEC


def flat_sep_diff(ra1: Column, dec1: Column, ra2: Column, dec2: Column, ra3: Column, dec3: Column) -> Column:
    """Flat distance from 1 to 2 less that from 1 to 3, in degrees."""
    return F.hypot(ra1 - ra2, dec1 - dec2) - F.hypot(ra1 - ra3, dec1 - dec3)


def pixel_angle(x: Column, y: Column, x0: Column, y0: Column, wrap: bool = False) -> Column:
    """Position angle around the reference pixel; wrap moves angles under -90 up by a turn."""
    angle = F.degrees(F.atan2(y - y0, x - x0))
    return F.when(angle < -90, angle + 360).otherwise(angle) if wrap else angle


def offset_angle(d_ra: Column, d_dec: Column) -> Column:
    """Direction of an offset, counted from the first axis."""
    return F.degrees(F.atan2(d_dec, d_ra))


def offset_angle_raw(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    return F.degrees(F.atan2(dec1 - dec2, ra1 - ra2))


def offset_angle_scaled(ra1: Column, dec1: Column, ra2: Column, dec2: Column, mean_dec: Column) -> Column:
    return F.degrees(F.atan2(dec1 - dec2, (ra1 - ra2) * F.cos(F.radians(mean_dec))))


def rho(d_ra: Column, d_dec: Column, b_maj: Column) -> Column:
    """Length of an offset in beams."""
    return F.sqrt(d_ra * d_ra + d_dec * d_dec) / b_maj


def radial_distance(x: Column, y: Column, size: float) -> Column:
    return F.hypot(x - size / 2, y - size / 2)


def to_degrees(value: Column, unit: str | None) -> Column:
    """A coordinate column in degrees; no unit means degrees already."""
    factors = {None: 1.0, "deg": 1.0, "arcmin": 1 / 60, "arcsec": 1 / 3600, "rad": 180 / math.pi, "hourangle": 15.0}
    return value * F.lit(factors[unit])


def sexagesimal(ra: Column, dec: Column) -> Column:
    """HH:MM:SS.ssss, +-DD:MM:SS.ssss; rounding carries into minutes and degrees."""
    t = F.round(F.pmod(ra, F.lit(360.0)) / 15 * 36_000_000).cast("long")
    d = F.round(F.abs(dec) * 36_000_000).cast("long")

    def parts(v: Column) -> list[Column]:
        return [F.expr("1") * F.floor(v / 36_000_000), F.floor(F.pmod(v, F.lit(36_000_000)) / 600_000), F.pmod(v, F.lit(600_000)) / 10_000]

    sign = F.when(dec < 0, "-").otherwise("")
    return F.concat(F.format_string("%02d:%02d:%07.4f, ", *parts(F.pmod(t, F.lit(24 * 36_000_000)))), sign, F.format_string("%02d:%02d:%07.4f", *parts(d)))


def coords_from_name(name: Column) -> tuple[Column, Column]:
    """(ra, dec) from JHHMMSS+-DDMMSS or JHHMM+-DDMM anywhere in a name; null if there is neither."""
    long, short = r"J(\d{2})(\d{2})(\d{2}(?:\.\d+)?)([+-])(\d{2})(\d{2})(\d{2}(?:\.\d+)?)", r"J(\d{2})(\d{2})([+-])(\d{2})(\d{2})"

    def number(pattern: str, k: int) -> Column:
        text = F.regexp_extract(name, pattern, k)
        return F.when(text != "", text).cast("double")

    def sign(pattern: str, k: int) -> Column:
        return F.when(F.regexp_extract(name, pattern, k) == "-", -1.0).otherwise(1.0)

    ra = F.coalesce(15 * (number(long, 1) + number(long, 2) / 60 + number(long, 3) / 3600), 15 * (number(short, 1) + number(short, 2) / 60))
    dec = F.coalesce(sign(long, 4) * (number(long, 5) + number(long, 6) / 60 + number(long, 7) / 3600), sign(short, 3) * (number(short, 4) + number(short, 5) / 60))
    return ra, dec


def tangent_plane(ra: Column, dec: Column, ra0: Column, dec0: Column, orthographic: Column | None = None, far: bool = False) -> tuple[Column, Column]:
    """(xi, eta) in degrees on the plane that touches the sphere at (ra0, dec0): gnomonic, or orthographic where asked. Null on the far half of the sphere; far: the plain formula there, too, which mirrors it through the sphere's centre."""
    d, d0, da = F.radians(dec), F.radians(dec0), F.radians(ra - ra0)
    east, north = F.cos(d) * F.sin(da), F.sin(d) * F.cos(d0) - F.cos(d) * F.sin(d0) * F.cos(da)
    along = F.sin(d) * F.sin(d0) + F.cos(d) * F.cos(d0) * F.cos(da)
    by = F.when((along != 0) if far else (along > 0), along if orthographic is None else F.when(orthographic, F.lit(1.0)).otherwise(along))
    return F.degrees(east / by), F.degrees(north / by)


def plane_to_sky(xi: Column, eta: Column, ra0: Column, dec0: Column) -> tuple[Column, Column]:
    """(ra, dec) of a point of the gnomonic plane, the inverse of tangent_plane."""
    x, y, d0 = F.radians(xi), F.radians(eta), F.radians(dec0)
    down = F.cos(d0) - y * F.sin(d0)
    return F.pmod(ra0 + F.degrees(F.atan2(x, down)), F.lit(360.0)), F.degrees(F.atan2(F.sin(d0) + y * F.cos(d0), F.hypot(x, down)))
