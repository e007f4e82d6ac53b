"""Column builders for paths, lists of ids and digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def raster_path(root: Column, key: Column) -> Column:
    """root/<last two digits>/<two before>/<id>.tiff."""
    two = lambda n: F.lpad((n % 100).cast("string"), 2, "0")
    return F.concat_ws("/", root, two(key), two(F.floor(key / 100)), F.concat(key.cast("string"), F.lit(".tiff")))


def encode_list(ids: Column) -> Column:
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), " ")


def decode_list(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, " "), lambda x: x != ""), lambda x: x.cast("long"))


def little_endian(value: Column) -> Column:
    """Sixteen hex digits of a long, lowest byte first."""
    big = F.lpad(F.hex(value), 16, "0")
    return F.concat(*[F.substring(big, i, 2) for i in range(15, 0, -2)])


def id_digest(ids: Column) -> Column:
    """SHA-256 of the little-endian bytes of an array of longs."""
    return F.sha2(F.unhex(F.array_join(F.transform(ids, little_endian), "")), 256)


def redact(text: Column, names: tuple[str, ...] = ("key", "token", "password", "secret")) -> Column:
    """Values that are assigned to any of the names are hidden, up to a space or the next assignment of a query string."""
    return F.regexp_replace(text, rf"(?i)\b({'|'.join(names)})\s*[=:]\s*[^&\s]+", "$1=***")


def climbs(path: Column) -> Column:
    """True for paths with a step up."""
    return path.rlike(r"(^|/)\.\.(/|$)")
