"""Hash embeddings, normalisation and cosine as column expressions."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSION = 256


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def l2_normalize(vector: Column) -> Column:
    """array<float> of length 1: squares in single precision, their sum in double, in order; a zero vector stays."""

    def scaled(v: Column) -> Column:
        total = F.aggregate(v, F.lit(0.0), lambda s, x: s + (x * x).cast("float").cast("double"))
        inverse = _let(total, lambda t: F.when(t == 0, F.lit(1).cast("float")).otherwise((F.lit(1.0) / F.sqrt(t)).cast("float")))
        return _let(inverse, lambda k: F.transform(v, lambda x: (x * k).cast("float")))

    return _let(vector, scaled)


def hash_embedding(text: Column, dimension: int = DIMENSION) -> Column:
    """A deterministic unit vector from the SHA-256 of text; only equal texts are alike."""
    dimension = dimension if dimension > 0 else DIMENSION

    def cycled(digest: Column) -> Column:
        def at(i: Column) -> Column:
            byte = F.conv(F.substring(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("float")
            return (((byte / F.lit(255.0).cast("float")).cast("float") * F.lit(2).cast("float")).cast("float") - F.lit(1).cast("float")).cast("float")

        return F.transform(F.sequence(F.lit(0), F.lit(min(dimension, 32) - 1)), at)

    cycle = _let(F.sha2(text, 256), cycled)  # one digest a text
    whole = F.slice(F.flatten(F.array_repeat(cycle, -(-dimension // 32))), 1, dimension)
    return l2_normalize(whole)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(vector: Column, query: Column, square: float | None = None) -> Column:
    """In double precision and in order of index; 0 if the lengths differ or either is all zeros. square, if known, is that of the query."""
    b = _dot(query, query) if square is None else F.lit(square)
    alike = (F.size(vector) == F.size(query)) & (F.size(vector) > 0)
    ratio = _let(_dot(vector, vector), lambda a: F.when((a > 0) & (b > 0), _dot(vector, query) / (F.sqrt(a) * F.sqrt(b))).otherwise(0.0))
    return F.when(alike, ratio).otherwise(0.0)
