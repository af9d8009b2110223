"""Hash-derived identifiers and reproducible per-row randomness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def _text(value) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("string")


def sha1_head(value) -> Column:
    """First four SHA-1 bytes as a big-endian unsigned number."""
    return F.conv(F.substring(F.sha1(_text(value)), 1, 8), 16, 10).cast("long")


def sha1_head_swapped(value) -> Column:
    """First four SHA-1 bytes as a little-endian unsigned number."""
    h = F.sha1(_text(value))
    swapped = F.concat(*[F.substring(h, start, 2) for start in (7, 5, 3, 1)])
    return F.conv(swapped, 16, 10).cast("long")


def vocabulary_id(value, size: int) -> Column:
    """Stable id in ``1..size-1``; 0 is kept for padding and for vocabularies of one entry."""
    if size <= 1:
        return F.lit(0).cast("long")
    return F.lit(1) + sha1_head_swapped(value) % F.lit(size - 1)


def hash_fraction(value) -> Column:
    """Hash position in the closed unit interval, used by the group splits."""
    return sha1_head(value) / F.lit(TWO_32 - 1)


def uniform(*parts, salt: str) -> Column:
    """Uniform number in ``[0, 1)`` fixed by the key parts and the salt."""
    return sha1_head(F.concat_ws("|", *[_text(p) for p in parts], F.lit(salt))) / F.lit(TWO_32)


def gaussian(*parts, salt: str) -> Column:
    """Standard normal draw by Box-Muller from two hash uniforms."""
    radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - uniform(*parts, salt=salt + "/r")))
    return radius * F.cos(F.lit(6.283185307179586) * uniform(*parts, salt=salt + "/a"))


def digest_bytes(value, dim: int) -> Column:
    """SHA-256 bytes, repeated up to ``dim`` and mapped linearly onto ``[-1, 1]``."""
    h = F.sha2(_text(value), 256)
    return F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda i: F.conv(F.substr(h, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double") / F.lit(127.5) - F.lit(1.0),
    )
