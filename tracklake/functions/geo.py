"""Distances and box tests as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0
KM_PER_DEGREE = 111.32
KM_PER_NAUTICAL_MILE = 1.852


def _col(c: Column | str | float) -> Column:
    if isinstance(c, Column):
        return c
    return F.col(c) if isinstance(c, str) else F.lit(float(c))


def haversine_km(lat1, lon1, lat2, lon2, floor: float | None = None) -> Column:
    """Great-circle distance in km; ``floor`` bounds 1-a from below if given."""
    lat1, lon1, lat2, lon2 = map(_col, (lat1, lon1, lat2, lon2))
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    rest = F.lit(1.0) - a
    if floor is not None:
        rest = F.greatest(rest, F.lit(floor))
    return F.lit(2.0 * EARTH_RADIUS_KM) * F.atan2(F.sqrt(a), F.sqrt(rest))


def allowed_km(sog1, sog2, hours, margin: float = 1.2, scale: float = 0.3) -> Column:
    """How far a vessel can plausibly move in ``hours`` at its reported speeds."""
    hours = _col(hours)
    fastest = F.greatest(_col(sog1), _col(sog2))
    reach = fastest * F.lit(KM_PER_NAUTICAL_MILE) * hours * F.lit(margin) * (F.lit(1.0) + F.lit(scale) * hours)
    return F.greatest(reach, F.lit(0.05))


def in_box(t="t", lat="lat", lon="lon", box: str = "") -> Column:
    """Inclusive test on time, latitude and longitude; ``box`` prefixes the box columns."""
    return (
        _col(t).between(F.col(box + "t_start"), F.col(box + "t_end"))
        & _col(lat).between(F.col(box + "lat_min"), F.col(box + "lat_max"))
        & _col(lon).between(F.col(box + "lon_min"), F.col(box + "lon_max"))
    )


def crosses_box(start: tuple[str, str, str], end: tuple[str, str, str]) -> Column:
    """Does the straight segment between two (t, lat, lon) points cut the box boundary?

    Slab test: the parameter range in which the segment is inside each axis is
    intersected over the axes.  A segment with both ends inside does not cross.
    """
    bounds = (("t_start", "t_end"), ("lat_min", "lat_max"), ("lon_min", "lon_max"))
    enter, leave, possible = F.lit(0.0), F.lit(1.0), F.lit(True)
    for a, b, (lo, hi) in zip(start, end, bounds):
        delta = _col(b) - _col(a)
        flat = F.abs(delta) <= 1e-12
        step = F.when(flat, F.lit(None)).otherwise(delta)
        u1, u2 = (F.col(lo) - _col(a)) / step, (F.col(hi) - _col(a)) / step
        # greatest/least skip NULL, so a flat axis leaves the range as it is
        enter = F.greatest(enter, F.least(u1, u2))
        leave = F.least(leave, F.greatest(u1, u2))
        possible = possible & (~flat | _col(a).between(F.col(lo), F.col(hi)))
    inside = in_box(*start) & in_box(*end)
    return possible & (leave >= enter) & ~inside


def heading_change(h1, h2) -> Column:
    """Smallest angle between two headings, in degrees."""
    d = F.abs(_col(h2) - _col(h1))
    return F.least(d, F.lit(360.0) - d)


def degree_distance(lat1, lon1, lat2, lon2) -> Column:
    dy, dx = _col(lat2) - _col(lat1), _col(lon2) - _col(lon1)
    return F.sqrt(dy * dy + dx * dx)


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))
