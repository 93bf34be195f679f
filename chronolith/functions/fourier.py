"""The discrete Fourier transform of an array column, as array functions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _wave(n: int, sine: bool) -> Column:
    """A turn in n steps, as a text that Spark folds to one constant: plans are compared and copied node by node."""
    text = ",".join(repr((math.sin if sine else math.cos)(2 * math.pi * t / n)) for t in range(n))
    return F.split(F.lit(text), ",").cast("array<double>")


def _step(parts: Column, n: int, size: int, radix: int, wanted: Column) -> Column:
    """Joins ``radix`` transforms of ``size`` values each. ``parts`` holds the transforms of the values ``n / size`` apart,
    one after the other; ``wanted`` are the places of the result to compute."""
    long = size * radix
    apart = n // long

    def joined(parts: Column, cosine: Column, sine: Column, i: Column) -> Column:
        q, k = F.floor(i / long).cast("int"), F.pmod(i, F.lit(long))
        real, imaginary = F.lit(0.0), F.lit(0.0)
        for j in range(radix):
            part = F.get(parts, (q + apart * j) * size + F.pmod(k, F.lit(size)))
            turn = F.pmod(k * (j * apart), F.lit(n))
            c, s = F.get(cosine, turn), F.get(sine, turn)
            real, imaginary = real + part["re"] * c + part["im"] * s, imaginary + part["im"] * c - part["re"] * s
        return F.struct(real.alias("re"), imaginary.alias("im"))

    # The one-element array binds the parts to a name, so that they are computed once.
    made = F.transform(F.array(parts), lambda p: F.transform(wanted, lambda i: joined(p, _wave(n, False), _wave(n, True), i)))
    return F.get(made, F.lit(0))


def powers(values: Column, n: int, frequencies: int, radices: Sequence[int]) -> Column:
    """The power at frequencies 1 to ``frequencies`` of an array of ``n`` real values, the product of ``radices``: a mixed
    radix transform, a step a radix."""
    if math.prod(radices) != n:
        raise ValueError(f"{list(radices)} don't make {n}")
    parts, size = F.transform(values, lambda v: F.struct(v.cast("double").alias("re"), F.lit(0.0).alias("im"))), 1
    for k, radix in enumerate(radices):
        wanted = F.sequence(F.lit(1), F.lit(frequencies)) if k == len(radices) - 1 else F.sequence(F.lit(0), F.lit(n - 1))
        parts, size = _step(parts, n, size, radix, wanted), size * radix
    return F.transform(parts, lambda x: x["re"] * x["re"] + x["im"] * x["im"])
