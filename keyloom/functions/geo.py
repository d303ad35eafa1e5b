"""Geo scores as column expressions: 26 bits a coordinate, longitude in the even bits, all inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Projection limits, earth radius in metres, unit factors, base-32 alphabet.
LON, LAT = (-180.0, 180.0), (-85.05112878, 85.05112878)
RADIUS_M = 6372797.560856
UNITS = {"m": 1.0, "km": 1000.0, "ft": 0.3048, "mi": 1609.34}
ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"
BITS = 26
_SPREAD = [(16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)]


def _cell(x: Column, low: float, high: float) -> Column:
    """Cell number along one axis; the upper limit belongs to the last cell."""
    n = 1 << BITS
    return F.least(F.greatest(F.floor((x - low) / (high - low) * n), F.lit(0)), F.lit(n - 1)).cast("bigint")


def _spread(c: Column) -> Column:
    for shift, mask in _SPREAD:
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
    return c


def _squeeze(c: Column) -> Column:
    c = c.bitwiseAND(F.lit(_SPREAD[-1][1]))
    for (shift, _), mask in zip(reversed(_SPREAD), [m for _, m in reversed(_SPREAD[:-1])] + [0xFFFFFFFF]):
        c = c.bitwiseOR(F.shiftright(c, shift)).bitwiseAND(F.lit(mask))
    return c


def encode_score(lon: Column, lat: Column) -> Column:
    """52-bit interleaved score."""
    return F.shiftleft(_spread(_cell(lon, *LON)), 1).bitwiseOR(_spread(_cell(lat, *LAT)))


def decode_lon(score: Column) -> Column:
    """Western edge of the score's cell."""
    return LON[0] + _squeeze(F.shiftright(score, 1)) / F.lit(float(1 << BITS)) * (LON[1] - LON[0])


def decode_lat(score: Column) -> Column:
    return LAT[0] + _squeeze(score) / F.lit(float(1 << BITS)) * (LAT[1] - LAT[0])


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * RADIUS_M * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def geohash(lon: Column, lat: Column, chars: int = 10) -> Column:
    """Base-32 text over the full latitude range; five bits a character, longitude first."""
    n = 5 * chars // 2
    side = lambda x, low, high: F.greatest(F.ceil((x - low) / (high - low) * (1 << n)) - 1, F.lit(0)).cast("bigint")  # noqa: E731  a midpoint belongs to the lower half
    bits = F.shiftleft(_spread(side(lon, -180.0, 180.0)), 1).bitwiseOR(_spread(side(lat, -90.0, 90.0)))
    return F.concat(*(F.substring(F.lit(ALPHABET), (F.shiftright(bits, 5 * (chars - 1 - i)).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for i in range(chars)))
