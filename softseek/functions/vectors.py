"""Column functions on vectors and on membership arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, added from left to right."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors of any length; null where one of them is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def l2_normalize(a: Column) -> Column:
    """Unit vector in double precision; a zero vector stays as it is."""
    # The length is repeated as an array: inside a lambda it would be computed once per element.
    lengths = F.array_repeat(norm(a), F.size(a))
    return F.zip_with(a, lengths, lambda x, n: F.coalesce(F.try_divide(x.cast("double"), n), x.cast("double")))


def top_clusters(memberships: Column, n: int = 2) -> Column:
    """Cluster ids by weight, largest first; equal weights put the higher id first."""
    weighted = F.transform(memberships, lambda u, i: F.struct(u.alias("u"), i.alias("cluster")))
    return F.slice(F.sort_array(weighted, asc=False), 1, n)["cluster"]


def dominant_cluster(memberships: Column) -> Column:
    """The first cluster that holds the largest weight."""
    return (F.array_position(memberships, F.array_max(memberships)) - 1).cast("int")


def max_membership(memberships: Column) -> Column:
    return F.array_max(memberships)


def membership_entropy(memberships: Column) -> Column:
    return -F.aggregate(memberships, F.lit(0.0), lambda acc, u: acc + u * F.ln(u + F.lit(1e-10)))


def is_boundary(memberships: Column, share: float = 0.7) -> Column:
    """True where the memberships are spread: entropy above ``share`` of its maximum, ln k."""
    return membership_entropy(memberships) > F.lit(share) * F.ln(F.size(memberships).cast("double"))


def round_half_even4(x: Column) -> Column:
    """Four decimals, rounding the exact binary value (``round`` rounds its decimal print)."""
    return F.call_function("format_number", x, F.lit("0.0000")).cast("double")
