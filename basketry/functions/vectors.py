"""Vector expressions on ARRAY<FLOAT|DOUBLE> columns, summed in DOUBLE."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` one time and use it in `body`; inside a lambda it would be computed again per element."""
    return F.transform(F.array(value), body)[0]


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is missing, empty or all zero."""
    return once(norm(a) * norm(b), lambda scale: F.when(scale > 0, F.try_divide(dot(a, b), scale)).otherwise(F.lit(0.0)))


def unit(v: Column) -> Column:
    """Unit length; a zero vector stays zero."""

    def scaled(length: Column) -> Column:
        return F.transform(as_double(v), lambda x: F.when(length > 0, x / length).otherwise(F.lit(0.0)))

    return once(norm(v), scaled)


def scaled_sum(a: Column, wa: Column, b: Column, wb: Column) -> Column:
    return F.zip_with(as_double(a), as_double(b), lambda x, y: x * wa + y * wb)


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)


def mean_vector(v: Column) -> Column:
    """Mean of a vector column as an aggregate; combines map-side."""
    return vector_to_array(Summarizer.mean(array_to_vector(as_double(v))))


def pooled(rows: DataFrame, vectors: DataFrame, by: list[str], seen: bool = False) -> DataFrame:
    """(by..., m, n): the mean vector of the rows' articles per key and their number; with `seen` also `out`, the articles, as
    often as they have a vector. Rows move to their key with the vector as it is stored; a
    join by article scatters keys, so that partial means, several times as wide, would move for nearly every row."""
    moved = rows.select(*by, "article_id").join(vectors, "article_id").repartition(by[0])
    articles = [F.collect_list(F.col("article_id").cast("bigint")).alias("out")] if seen else []
    return moved.groupBy(*by).agg(mean_vector(F.col("vector")).alias("m"), F.count(F.lit(1)).alias("n"), *articles)


def as_text(v: Column, places: int = 6) -> Column:
    """Rounded components joined by commas, for comparing results."""
    return F.concat_ws(",", F.transform(as_double(v), lambda x: F.format_string(f"%.{places}f", x)))
