"""Column builders for coordinates, blocks and hash partitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on a sphere of EARTH_KM."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def block_id(lat: Column, lon: Column, scale: int = 1) -> Column:
    """Signed, zero-padded cell of 1/scale degree, such as +045:-003."""
    width = 4 if scale == 1 else 5
    form = f"%+0{width}d:%+0{width}d"
    return F.format_string(form, F.floor(lat * scale), F.floor(lon * scale))


def xor_partition(lat: Column, lon: Column, scale: float, seed: int, buckets: int) -> Column:
    """Cell hash: multiples of two primes, exclusive or, remainder."""
    a, b = F.floor(lat * scale).cast("long"), F.floor(lon * scale).cast("long")
    return F.pmod((a * 73856093).bitwiseXOR(b * 19349663).bitwiseXOR(F.lit(seed)), F.lit(buckets))


def sha_bucket(text: Column, buckets: int) -> Column:
    """Remainder of the first eight digest bytes, read little-endian."""
    head = F.substring(F.sha2(text, 256), 1, 16)
    turned = F.concat(*[F.substring(head, i, 2) for i in range(15, 0, -2)])
    return (F.conv(turned, 16, 10).cast("decimal(20,0)") % buckets).cast("int")


def cell(value: Column, scale: float, low: float, high: float) -> Column:
    """Cell number of a coordinate, kept within the cells of [low, high)."""
    return F.least(F.greatest(F.floor(value * scale), F.lit(int(low * scale))), F.lit(int(high * scale) - 1))
