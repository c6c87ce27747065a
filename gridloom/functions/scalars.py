"""Scalar and array functions as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII punctuation, which text normalisation strips.
PUNCTUATION = r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""
#: Coefficients of the example polynomial, from the constant on.
EXAMPLE_POLYNOMIAL = (0.2, 0.01, 0.025, 0.1)


#: What Unicode text splitting takes for white space. The escapes mean the same in Java and RE2.
WHITE_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def normalize_text(s: Column) -> Column:
    """Lower case, punctuation off, articles off, white space squeezed.

    Letters of any script end a word as they do in Unicode, whatever the JVM
    takes for a word boundary.
    """
    out = F.translate(F.lower(s), PUNCTUATION, "")
    out = F.regexp_replace(out, r"(?<![\p{L}\p{N}_])(a|an|the)(?![\p{L}\p{N}_])", " ")
    return squeeze(out)


def squeeze(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, WHITE_SPACE + "+", " "))


def span(s: Column, start: Column, end: Column) -> Column:
    """Characters start to end - 1, from 0; to the end of the string if ``end`` is beyond it."""
    return F.substring(s, start + 1, F.greatest(F.lit(0), F.least(end, F.char_length(s)) - start))


def replaced(s: Column, labels: dict[str, str]) -> Column:
    for old, new in labels.items():
        s = F.replace(s, F.lit(old), F.lit(new))
    return s


def dimensions(s: Column) -> dict[str, Column]:
    """nx[:ny[:nz]] by leading digits; missing ones repeat the one before. Not positive gives null."""
    parts = F.split(s, ":")
    digits = [F.try_to_number(F.regexp_extract(F.get(parts, F.lit(k)), r"^\d+", 0), F.lit("999999999")).cast("long") for k in range(3)]
    nx = digits[0]
    ny = F.when(F.size(parts) > 1, digits[1]).otherwise(nx)
    nz = F.when(F.size(parts) > 2, digits[2]).otherwise(ny)
    good = (nx > 0) & (ny > 0) & (nz > 0)
    return {k: F.when(good, v) for k, v in (("nx", nx), ("ny", ny), ("nz", nz))}


def newton(x: Column, steps: int = 5) -> Column:
    """Newton steps towards a root of exp(cos x) - 2."""

    def step(v: Column) -> Column:
        e = F.exp(F.cos(v))
        return v - (e - 2) / (-F.sin(v) * e)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), x.cast("double"), lambda v, _: step(v))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def step(x: Column) -> Column:
    return (x > 0).cast("int")


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def softmax(array: Column) -> Column:
    shifted = F.transform(array, lambda x: F.exp(x - F.array_max(array)))
    total = F.aggregate(shifted, F.lit(0.0), lambda a, b: a + b)
    return F.transform(shifted, lambda x: x / total)


def polyval(x: Column, coefficients: Sequence[float] = EXAMPLE_POLYNOMIAL) -> Column:
    out = F.lit(0.0)
    for c in reversed(coefficients):
        out = out * x + c
    return out


def basis(x: Column, degree: int) -> Column:
    return F.array(*[x**p for p in range(degree + 1)])


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, b: a + b)


def test_functions(x: Column) -> dict[str, Column]:
    """Six functions of a vector: cosine of the sum, product, corner peak, Gaussian, kink, jump."""
    total, squares = _sum(x), _sum(F.transform(x, lambda v: v * v))
    return {
        "cosine": F.cos(total),
        "product": F.aggregate(x, F.lit(1.0), lambda a, b: a * b),
        "corner": (1 + total) ** -2,
        "gaussian": F.exp(-squares),
        "kink": F.exp(-_sum(F.transform(x, F.abs))),
        "jump": F.when(F.exists(x, lambda v: v > 0.5), 0.0).otherwise(F.exp(total)),
    }


def scaled(x: Column, top: float = 255.0) -> Column:
    """Values from 0 to ``top`` as shares of it."""
    return x / F.lit(float(top))


def scaled_array(array: Column, top: float = 255.0) -> Column:
    return F.transform(array, lambda x: scaled(x.cast("double"), top))


def cosine_bump(x: Column, y: Column) -> Column:
    return F.cos(math.pi * x / 2) * F.cos(math.pi * y / 2)


def tree_value(x: Column, tree: tuple | float) -> Column:
    """A nested (split, left, right) as one conditional: x < split goes left."""
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    split, left, right = tree
    return F.when(x < split, tree_value(x, left)).otherwise(tree_value(x, right))


def portfolio_cost(a: Column, risk_free: float, mean: Column, var: Column, aversion: float) -> Column:
    return -(1 - a) * risk_free - a * mean + aversion * a * a * var


def portfolio_optimum(risk_free: float, mean: Column, var: Column, aversion: float) -> Column:
    return F.try_divide(mean - risk_free, 2 * aversion * var)


def padded(array: Column, size: int) -> Column:
    """``array`` with zeros up to ``size``; null if it is longer."""
    n = F.size(array)
    return F.when(n <= size, F.concat(array, F.array_repeat(F.lit(0), (F.lit(size) - n).cast("int"))))


def mask(array: Column, size: int) -> Column:
    ones = F.array_repeat(F.lit(1), F.size(array))
    return padded(ones, size)


def masked(array: Column, keep: Column) -> Column:
    """Elements whose mask is 1."""
    both = F.arrays_zip(array.alias("x"), keep.alias("m"))
    return F.transform(F.filter(both, lambda z: z["m"] == 1), lambda z: z["x"])


def kronecker(a: Column, b: Column) -> Column:
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: x * y)))


def row_difference(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def row_dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def adds_over(a: Column, b: Column) -> Column:
    return F.try_add(a, b).isNull()


def multiplies_over(a: Column, b: Column) -> Column:
    return F.try_multiply(a, b).isNull()


def quotient(a: Column, b: Column) -> Column:
    """a / b as floating point has it: a zero divisor gives an infinite value or NaN, by both signs; null for nulls alone."""
    # pow(b, -1) is infinite with the sign of a zero b.
    a, b = a.cast("double"), b.cast("double")
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(F.try_divide(a, b))


def logarithm(x: Column) -> Column:
    """The natural logarithm, -inf at zero and NaN below, where Spark's is null."""
    return F.when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan"))).otherwise(F.log(x))


def rounded(x: Column, digits: int) -> Column:
    """x times a power of ten to the next whole number, halves away from zero, and back: SQL's round of a double.

    Spark's own rounds the shortest decimal of x, so 8.0046875, which times 10^6 lies below the half, goes up.
    """
    m = F.lit(float(10**digits))
    t = x * m
    whole = F.rint(t)
    # The difference to a whole number is exact, and so is half a step from a half.
    whole = F.when(F.abs(t - whole) == 0.5, t + F.signum(t) * 0.5).otherwise(whole) / m
    return F.when(F.abs(whole) < float("inf"), whole).otherwise(x)


def no_long(x: Column) -> Column:
    """Whether an exact decimal, as of products and sums of longs, is null or beyond the longs."""
    return x.try_cast("long").isNull()


def uniform(key: Column, salt: str = "") -> Column:
    """A number in [0, 1) from a digest of the key: the same in any engine."""
    digits = F.substring(F.md5(F.concat(key.cast("string"), F.lit(salt)).cast("binary")), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / 4294967296.0


def lag_parts(d: Column) -> Column:
    """Year and month as 'Y-M', without padding."""
    return F.concat_ws("-", F.year(d), F.month(d))


def spline_basis(x: Column, knots: Sequence[float], degree: int = 3) -> Column:
    """B-splines of the degree over the knots, as an array; 0 outside, right-open intervals."""
    basis = [F.when((x >= a) & (x < b), 1.0).otherwise(0.0) for a, b in zip(knots, knots[1:], strict=False)]
    for d in range(1, degree + 1):
        made = []
        for k in range(len(basis) - 1):
            left, right = knots[k + d] - knots[k], knots[k + d + 1] - knots[k + 1]
            a = (x - knots[k]) / left * basis[k] if left else F.lit(0.0)
            b = (knots[k + d + 1] - x) / right * basis[k + 1] if right else F.lit(0.0)
            made.append(a + b)
        basis = made
    return F.array(*basis)
