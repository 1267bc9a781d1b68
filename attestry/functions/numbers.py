"""Arithmetic, intervals, buckets and digests as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.96


def wilson(k: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """Wilson interval of k of n in percent, unrounded; 0, 0 for none."""
    p = k / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return tuple(F.when(n == 0, 0.0).otherwise(100 * x) for x in (F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)))


def normal_half_width(p: Column, n: Column) -> Column:
    return Z * F.sqrt(p * (1 - p) / n)


def bucket_of(x: Column, buckets: list[tuple], other: str | None = "unknown") -> Column:
    """First inclusive range that holds x; null or a gap gives `other`."""
    out = F.lit(other)
    for label, low, high in reversed(buckets):
        inside = F.lit(True) if low is None and high is None else ((x >= low) if low is not None else F.lit(True)) & ((x <= high) if high is not None else F.lit(True))
        out = F.when(x.isNotNull() & inside, label).otherwise(out)
    return out


def edge_bin(x: Column, edges: list[float]) -> Column:
    """Index of the left-closed bin; the last bin is closed."""
    out = F.lit(None).cast("int")
    for i in range(len(edges) - 2, -1, -1):
        right = (x <= edges[i + 1]) if i == len(edges) - 2 else (x < edges[i + 1])
        out = F.when((x >= edges[i]) & right, i).otherwise(out)
    return out


def log_funding(x: Column) -> Column:
    return F.log10(F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0)) + 1)


def entropy_bits(p: Column) -> Column:
    q = 1 - p
    return F.when((p <= 0) | (p >= 1), 0.0).otherwise(-(p * F.log2(p) + q * F.log2(q)))


def hashed_unit(key: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of a key's md5."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("double") / 4294967296.0


def list_cost(tokens_in: Column, tokens_out: Column, price: tuple[float, float, float], cached: Column | None = None) -> Column:
    """Dollars by list price; cached tokens, never more than the input, at theirs."""
    kept = F.least(cached, tokens_in) if cached is not None else F.lit(0)
    return ((tokens_in - kept) * price[0] + kept * price[1] + tokens_out * price[2]) / 1e6


def estimated_tokens(text: Column) -> Column:
    return F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / 3) + 32


def canonical_digest(names: list[str], columns: list[Column]) -> Column:
    """SHA-256 of [[name, value], ...] as compact JSON."""
    pairs = F.array(*[F.array(F.lit(n), F.coalesce(c.cast("string"), F.lit(""))) for n, c in zip(names, columns, strict=True)])
    return F.sha2(F.to_json(pairs), 256)


def confidence_text(c: Column) -> Column:
    """A confidence as text, blank for null; fails outside 0 to 1."""
    bad = F.raise_error(F.concat(F.lit("confidence "), c.cast("string")))
    return F.when(c.isNull(), "").when(F.isnan(c) | ~c.between(0.0, 1.0), bad).otherwise(c.cast("string"))


def short_identity(*parts: Column, size: int = 12) -> Column:
    return F.substring(F.sha1(F.concat_ws("\u001f", *parts).cast("binary")), 1, size)
