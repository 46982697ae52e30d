"""Keyed uniforms, normals and stable identifiers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def uniform(key: Column) -> Column:
    """Value in [0, 1) fixed by ``key``: the first 52 bits of its md5."""
    bits = F.conv(F.substring(F.md5(key.cast("string")), 1, 13), 16, 10).cast("bigint")
    return bits / F.lit(4503599627370496.0)


def keyed_uniform(key: Column, salt: str) -> Column:
    return uniform(F.concat(key.cast("string"), F.lit(salt)))


def uniform_int(low: int, high: int, key: Column) -> Column:
    """Integer in [low, high], both ends included."""
    return (F.floor(uniform(key) * F.lit(float(high - low + 1))) + F.lit(low)).cast("bigint")


def keyed_normal(key: Column, salt: str) -> Column:
    """Standard normal fixed by ``key`` (Box-Muller on two keyed uniforms)."""
    first = F.lit(1.0) - keyed_uniform(key, salt + "#1")
    second = keyed_uniform(key, salt + "#2")
    return F.sqrt(F.lit(-2.0) * F.log(first)) * F.cos(F.lit(2.0) * F.pi() * second)


def name_uuid(namespace: str, name: Column) -> Column:
    """RFC 4122 version 5 identifier of ``name`` inside the namespace UUID."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8)))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(F.lower(variant), F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )
