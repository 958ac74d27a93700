"""Linear recurrences over ordered rows as window sums: s[i] = M s[i-1] + b[i], with a fixed stable matrix M.

In the basis of its eigenvectors M is one number a mode, and c[i] = z c[i-1] + d[i] is z^i times the sum of z^-k d[k]: a
composition of affine maps that a running sum gives. Sums run within blocks of rows, as short as z^-k must not overflow
and as long as a block before last no longer counts (|z|^(2 * block) is below TINY); what a block hands on to the next is
its last state. So a segment of any length takes a few window passes, in the JVM, and no row is visited by Python."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TINY = 1e-30
MOST_GROWTH = 1e250
LONGEST = 1 << 14


@dataclass(frozen=True)
class Modes:
    """Eigenvalues with no negative imaginary part, their vectors (a conjugate pair counts twice its real part) and the inverse's rows."""

    values: list[complex]
    vectors: np.ndarray
    inverse: np.ndarray
    block: int


def modes(matrix: np.ndarray) -> Modes:
    values, vectors = np.linalg.eig(np.asarray(matrix, float))  # of a real matrix: conjugate pairs are exact
    size = np.abs(values)
    if not 0 < size.min() <= size.max() < 1:
        raise ValueError("a recurrence must be stable and invertible")
    block = min(math.ceil(math.log(TINY) / (2 * math.log(size.max()))) + 1, int(math.log(MOST_GROWTH) / -math.log(size.min())), LONGEST)
    if size.max() ** (2 * block) > 1e-14:
        raise ValueError("a recurrence fades too slowly, or its modes fade too differently")
    values, inverse = np.asarray(values, complex), np.linalg.inv(vectors)
    keep = [i for i, z in enumerate(values) if z.imag >= 0]
    share = np.array([2.0 if values[i].imag > 0 else 1.0 for i in keep])
    return Modes([complex(values[i]) for i in keep], vectors[:, keep] * share, inverse[keep], block)


def _plus(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def scanned(df: DataFrame, matrix: np.ndarray, inputs: dict[str, list[Column]], keys: list[str], at: str) -> DataFrame:
    """df with the states of each named recurrence as <name>_0, <name>_1, ...; at numbers a key's rows from 0 in the order of the scan.

    inputs: of each name what is added at a row, one column for each part of the state; the state before row 0 is 0."""
    m = modes(matrix)
    k = F.pmod(F.col(at), F.lit(m.block))
    out = df.withColumns({"__k": k, "__block": F.floor(F.col(at) / m.block), "__end": k == m.block - 1})
    turn = lambda z, n: (F.exp(n * math.log(abs(z))), F.cos(n * math.atan2(z.imag, z.real)), F.sin(n * math.atan2(z.imag, z.real)))
    # z^k and z^-k by row
    out = out.withColumns({f"__{part}{i}": c for i, z in enumerate(m.values) for part, c in zip(("r", "c", "s"), turn(z, F.col("__k")))})
    pairs = [(name, i) for name in inputs for i in range(len(m.values))]
    inside = W.partitionBy(*keys, "__block").orderBy(at).rowsBetween(W.unboundedPreceding, 0)
    scaled = {}
    for name, i in pairs:
        re = _plus([b * float(v.real) for b, v in zip(inputs[name], m.inverse[i])])
        im = _plus([b * float(v.imag) for b, v in zip(inputs[name], m.inverse[i])])
        r, c, s = (F.col(f"__{p}{i}") for p in "rcs")
        scaled |= {f"__u_{name}{i}": (re * c + im * s) / r, f"__v_{name}{i}": (im * c - re * s) / r}
    out = out.withColumns(scaled)
    out = out.withColumns({c: F.sum(c).over(inside) for c in scaled})
    # the state that a block gives by itself
    own = {}
    for name, i in pairs:
        r, c, s = (F.col(f"__{p}{i}") for p in "rcs")
        u, v = F.col(f"__u_{name}{i}"), F.col(f"__v_{name}{i}")
        own |= {f"__u_{name}{i}": r * (u * c - v * s), f"__v_{name}{i}": r * (u * s + v * c)}
    out = out.withColumns(own)
    earlier = W.partitionBy(*keys).orderBy(at).rowsBetween(W.unboundedPreceding, -1)
    ends = lambda make: F.last(F.when(F.col("__end"), F.struct(*make)), ignorenulls=True).over(earlier)
    out = out.withColumn("__before", ends([F.col(c) for c in own]))
    handed = []
    for name, i in pairs:
        z = m.values[i] ** m.block
        u, v = (F.coalesce(F.col(f"__before.__{p}_{name}{i}"), F.lit(0.0)) for p in "uv")
        handed += [
            (F.col(f"__u_{name}{i}") + u * z.real - v * z.imag).alias(f"__u_{name}{i}"),
            (F.col(f"__v_{name}{i}") + u * z.imag + v * z.real).alias(f"__v_{name}{i}"),
        ]
    out = out.withColumn("__handed", F.struct(*handed)).withColumn("__handed", F.last(F.when(F.col("__end"), F.col("__handed")), ignorenulls=True).over(earlier))
    states = {}
    for name, i in pairs:
        z = m.values[i]
        r, c, s = turn(z, F.col("__k") + 1)
        u, v = (F.coalesce(F.col(f"__handed.__{p}_{name}{i}"), F.lit(0.0)) for p in "uv")
        states[name, i] = F.col(f"__u_{name}{i}") + r * (u * c - v * s), F.col(f"__v_{name}{i}") + r * (u * s + v * c)
    final = {}
    for name in inputs:
        for j in range(len(m.vectors)):
            parts = [states[name, i][0] * float(m.vectors[j, i].real) - states[name, i][1] * float(m.vectors[j, i].imag) for i in range(len(m.values))]
            final[f"{name}_{j}"] = _plus(parts)
    helpers = [*own, "__k", "__block", "__end", "__before", "__handed", *[f"__{p}{i}" for i in range(len(m.values)) for p in "rcs"]]
    return out.withColumns(final).drop(*helpers)
