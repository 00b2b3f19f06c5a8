"""Vector arithmetic as Column expressions: vectors are ARRAY<DOUBLE> (or FLOAT) columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Pair = Callable[[Column, Column], Column]


def dbl(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def total(values: Column) -> Column:
    """Sum of an array of doubles."""
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def zipped(a: Column, b: Column, f: Pair) -> Column:
    return F.zip_with(dbl(a), dbl(b), f)


def inner_product(a: Column, b: Column) -> Column:
    return total(zipped(a, b, lambda x, y: x * y))


def sq_l2(a: Column, b: Column) -> Column:
    return total(zipped(a, b, lambda x, y: (x - y) * (x - y)))


def norm(a: Column) -> Column:
    return F.sqrt(inner_product(a, a))


def scaled(a: Column, s: Column) -> Column:
    return F.transform(dbl(a), lambda x: x * s)


def normalised(a: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    n = norm(a)
    return F.transform(dbl(a), lambda x: F.when(n > 0, x / n).otherwise(0.0))


def plus(a: Column, b: Column, factor: float = 1.0) -> Column:
    """a + factor * b."""
    return zipped(a, b, lambda x, y: x + y * F.lit(factor))


def subspace(a: Column, m: int, width: int) -> Column:
    """Contiguous slice m of a given width."""
    return F.slice(dbl(a), m * width + 1, width)


def remapped(a: Column, dims: list[int]) -> Column:
    """Selects dimensions; -1 gives 0."""
    return F.array(*[F.lit(0.0) if d < 0 else dbl(a)[d] for d in dims])


def padded(a: Column, size: int) -> Column:
    """Zeros at the end up to `size` dimensions."""
    return F.concat(dbl(a), F.array_repeat(F.lit(0.0), F.greatest(F.lit(size) - F.size(a), F.lit(0))))


def linear(a: Column, rows: list[list[float]], bias: list[float] | None = None) -> Column:
    """A x + b for a small constant matrix."""
    bias = bias or [0.0] * len(rows)
    return F.array(*[inner_product(a, F.array(*map(F.lit, r))) + F.lit(b) for r, b in zip(rows, bias)])


def sign_bits(a: Column) -> Column:
    """One bit a dimension, 1 where the value is not negative."""
    return F.transform(a, lambda x: (x >= 0).cast("int"))


def packed(bits: Column, dims: int) -> Column:
    """Bits packed in 32-bit words held as longs, low bit first."""
    words = []
    for w in range(-(-dims // 32)):
        part = F.slice(bits, 32 * w + 1, min(32, dims - 32 * w))
        words.append(F.aggregate(F.transform(part, lambda b, i: b.cast("long") * F.pow(F.lit(2), i).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x))
    return F.array(*words)


def hamming(a: Column, b: Column) -> Column:
    """Bits that differ between two packed arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def unpacked(words: Column, dims: int) -> Column:
    """The bits of a packed array, low bit first."""
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.pmod(F.floor(F.get(words, F.floor(i / 32).cast("int")) / F.pow(F.lit(2.0), F.pmod(i, F.lit(32)))), F.lit(2)).cast("int"))


def differing(a: Column, b: Column) -> Column:
    """How many elements of two code arrays differ: Hamming distance by whole codes."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)


def smallest(a: Column, k: int) -> Column:
    """The k smallest values of a row, in order."""
    return F.slice(F.sort_array(a), 1, k)


def largest(a: Column, k: int) -> Column:
    return F.slice(F.sort_array(a, asc=False), 1, k)
