"""Column functions on vectors (arrays of numbers), and aggregates of vectors.

Sums run in array order in double precision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(as_double(v), lambda x: x * x)))


def let(value: Column, fn) -> Column:
    """fn of a value that is computed once for a row: inside a lambda, an outer expression is evaluated for each element."""
    return F.transform(F.array(value), fn)[0]


def l2_normalize(v: Column, mode: str = "clamp") -> Column:
    """clamp: x / max(norm, 1e-12); add: x / (norm + 1e-12)."""
    n = F.greatest(norm(v), F.lit(1e-12)) if mode == "clamp" else norm(v) + F.lit(1e-12)
    return let(n, lambda n: F.transform(as_double(v), lambda x: x / n))


def cosine(a: Column, b: Column, guard: bool = True) -> Column:
    """Cosine; with the guard a zero vector has 0, without it the result is null."""
    value = dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))
    return F.coalesce(value, F.lit(0.0)) if guard else value


def layer_norm(v: Column, eps: float = 1e-5) -> Column:
    """(x - mean) / sqrt(population variance + eps)."""
    centred = let(total(as_double(v)) / F.size(v), lambda mean: F.transform(as_double(v), lambda x: x - mean))
    spread = lambda c: F.sqrt(total(F.transform(c, lambda x: x * x)) / F.size(c) + F.lit(eps))
    return let(centred, lambda c: let(spread(c), lambda s: F.transform(c, lambda x: x / s)))


def rms_norm(v: Column, weight: Column | None = None, eps: float = 1e-6) -> Column:
    """x / sqrt(mean of squares + eps), times a weight for each component if there is one."""
    scale = F.lit(1.0) / F.sqrt(total(F.transform(as_double(v), lambda x: x * x)) / F.size(v) + F.lit(eps))
    scaled = let(scale, lambda s: F.transform(as_double(v), lambda x: x * s))
    return scaled if weight is None else F.zip_with(scaled, as_double(weight), lambda x, w: x * w)


def fuse_mean(text: Column, image: Column) -> Column:
    return F.zip_with(as_double(text), as_double(image), lambda a, b: (a + b) / F.lit(2.0))


def fuse_weighted(text: Column, image: Column, text_weight: float = 0.6, image_weight: float = 0.4) -> Column:
    return F.zip_with(as_double(text), as_double(image), lambda a, b: a * F.lit(text_weight) + b * F.lit(image_weight))


def fuse_missing(text: Column, image: Column, policy: str = "text", blank: Column | None = None) -> Column:
    """Mean fusion where an image may be null. text: the text alone; zero: fused with a zero vector; blank: fused with
    the vector of a blank image."""
    if policy == "text":
        return F.when(image.isNull(), as_double(text)).otherwise(fuse_mean(text, image))
    if policy == "zero":
        return fuse_mean(text, F.coalesce(as_double(image), F.transform(as_double(text), lambda x: F.lit(0.0))))
    if policy == "blank" and blank is not None:
        return fuse_mean(text, F.coalesce(as_double(image), as_double(blank)))
    raise ValueError(f"unknown policy {policy}, or no blank vector")


def pool_mask(mask: Column, length: Column) -> Column:
    """The first `length` entries become 0."""
    return F.transform(mask, lambda x, i: F.when(i < length, F.lit(0)).otherwise(x))


def rotate_half(v: Column) -> Column:
    half = (F.size(v) / 2).cast("int")
    return F.concat(F.transform(F.slice(v, half + 1, half), lambda x: -x), F.slice(v, F.lit(1), half))


def position_ids(mask: Column) -> Column:
    """Running sum of a mask less 1; 1 where the mask is 0."""
    running = F.transform(mask, lambda x, i: F.aggregate(F.slice(mask, F.lit(1), i + 1), F.lit(0), lambda a, y: a + y.cast("int")))
    return F.zip_with(running, mask, lambda r, m: F.when(m == 0, F.lit(1)).otherwise(r - 1))


def mean_pool(df: DataFrame, keys: list[str], vector: str, mask: str | None = None, floor: float = 1e-9) -> DataFrame:
    """(keys, vector): for each key the mean of its rows' vectors, of those whose mask isn't 0 if there is one.

    Components are summed before the exchange; a key's vectors are never gathered.
    """
    weight = F.col(mask).cast("double") if mask else F.lit(1.0)
    rows = df.select(*keys, F.posexplode(as_double(F.col(vector))).alias("_i", "_x"), weight.alias("_w"))
    sums = rows.groupBy(*keys, "_i").agg((F.sum(F.col("_x") * F.col("_w")) / F.greatest(F.sum("_w"), F.lit(floor))).alias("_m"))
    gathered = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", "_m"))).alias("_v"))  # one entry a component
    return gathered.select(*keys, F.transform("_v", lambda s: s["_m"]).alias(vector))


def last_pool(df: DataFrame, keys: list[str], vector: str, position: str, mask: str | None = None) -> DataFrame:
    """The vector at the last position; with a mask, the last that isn't masked, so padding on either side is skipped."""
    rows = df.where(F.col(mask) != 0) if mask else df
    return rows.groupBy(*keys).agg(F.max_by(vector, position).alias(vector))


def first_pool(df: DataFrame, keys: list[str], vector: str, position: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min_by(vector, position).alias(vector))


def cumulative_offsets(df: DataFrame, keys: list[str], order: str, length: str) -> DataFrame:
    """df with `offset`: the sum of the lengths before a row, 0 for the first."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("offset", F.coalesce(F.sum(length).over(before), F.lit(0)).cast("long"))
