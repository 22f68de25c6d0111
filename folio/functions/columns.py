"""Column expressions of the library's own predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_column(*parts: Column) -> Column:
    """Non-empty parts joined by slashes, as ``join_key`` does."""
    return F.concat_ws("/", *[F.when(p != "", p) for p in parts])


def comment_date(comment: Column) -> Column:
    """The day that a revision's comment starts with: up to a ``T``, in full, as yyyymmdd, a month or a year; else null."""
    text = F.split_part(comment, F.lit("T"), F.lit(1))
    compact = F.try_to_date(F.when(F.rlike(text, F.lit(r"^\d{8}$")), text), "yyyyMMdd")
    return F.coalesce(F.when(F.rlike(text, F.lit(r"^\d{4}(-\d{2}(-\d{2})?)?$")), text.try_cast("date")), compact)


def date_between(comment: Column, start: str | None = None, end: str | None = None) -> Column:
    """Whether the comment's day is in [start, end); without bounds, any day of the years 1900 to 3999. False for what is no day."""
    day = comment_date(comment)
    lo, hi = comment_date(F.lit(start or "1900")), comment_date(F.lit(end or "4000"))
    return F.coalesce((day >= lo) & (day < hi), F.lit(False))


def drawn_place(seed: Column, n: int) -> Column:
    """The place among ``n`` that a seed draws, each as likely as the others, as ``draw`` has it; null for a null seed."""
    return F.conv(F.substring(F.md5(seed.cast("string")), 1, 15), 16, 10).cast("long") % F.lit(n)


def message_content(body: Column) -> Column:
    """The JSON body as a variant; null for malformed text and for JSON's null, which no handler gets."""
    parsed = F.try_parse_json(body)
    return F.when(~F.is_variant_null(parsed), parsed)


def logistic(coefficients: dict[str, float], intercept: float = 0.0) -> Column:
    """The probability of the positive class of a linear model."""
    total = F.lit(float(intercept))
    for name, weight in coefficients.items():
        total = total + F.col(name) * F.lit(float(weight))
    return 1 / (1 + F.exp(-total))


def nearest(vector: Column, centroids: list[list[float]]) -> Column:
    """The position of the centroid with the least squared distance; of equal ones the first."""

    def distance(centre: list[float]) -> Column:
        pairs = F.zip_with(vector, F.array(*[F.lit(float(x)) for x in centre]), lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))
        return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)

    options = F.array(*[F.struct(distance(c).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(centroids)])
    return F.array_min(options).getField("k")


def tree(node: dict | float) -> Column:
    """A small decision tree as nested CASE: {'column', 'below', 'yes', 'no'} or a leaf's value; null goes to 'no'."""
    if not isinstance(node, dict):
        return F.lit(float(node))
    return F.when(F.col(node["column"]) < F.lit(node["below"]), tree(node["yes"])).otherwise(tree(node["no"]))
