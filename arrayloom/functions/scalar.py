"""Column expressions used by several operators."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

#: R's mad() multiplies by this; the noise estimate then divides by 0.6745 as well.
MAD_SCALE, MAD_NORMAL = 1.4826, 0.6745


def noise_sigma(mad: Column, literal: bool = True) -> Column:
    """Noise from an unscaled median absolute deviation; literal keeps both factors."""
    return mad * F.lit(MAD_SCALE / MAD_NORMAL if literal else 1 / MAD_NORMAL)


def soft(w: Column, threshold: Column | float) -> Column:
    return F.signum(w) * F.greatest(F.abs(w) - threshold, F.lit(0.0)) + 0.0


def hard(w: Column, threshold: Column | float) -> Column:
    """Keeps what is above the threshold."""
    return F.when(F.abs(w) > threshold, w).otherwise(0.0)


def below_to_zero(w: Column, value: float) -> Column:
    """Keeps what is at or above the value."""
    return F.when(F.abs(w) < value, 0.0).otherwise(w)


def universal_threshold(sigma: Column, n: Column) -> Column:
    return sigma * F.sqrt(2 * F.log(n.cast("double")))


def bayes_threshold(sigma: Column, mean_square: Column) -> Column:
    return sigma * sigma / (F.sqrt(F.greatest(mean_square - sigma * sigma, F.lit(0.0))) + 1e-12)


def snr_db(variance: Column, scale: Column) -> Column:
    """Signal to quantisation noise, in decibels."""
    return 10 * F.log10(variance / (scale * scale / 12))


def morton(x: Column, y: Column, z: Column, bits: int) -> Column:
    """Z-order code: bit k of x, y and z goes to bits 3k, 3k+1 and 3k+2."""
    out = F.lit(0).cast("long")
    for k in range(bits):
        for axis, c in enumerate((x, y, z)):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(c.cast("long"), k).bitwiseAND(F.lit(1).cast("long")), 3 * k + axis))
    return out


def morton_bits(dims) -> int:
    return max(1, math.ceil(math.log2(max(max(dims), 2))))


def dct_value(t: Column, k: Column, n_time: int) -> Column:
    """Orthonormal DCT-II: row t (from 0) of column k (from 0)."""
    scale = F.when(k == 0, F.lit(math.sqrt(1 / n_time))).otherwise(F.lit(math.sqrt(2 / n_time)))
    return scale * F.cos(F.lit(math.pi) * (t + 0.5) * k / n_time)


def normal_tail(z: float) -> float:
    return 2 * NormalDist().cdf(-abs(z))


def normal_upper(p: float) -> float:
    return NormalDist().inv_cdf(1 - p)


def kernel(r: Column, kind: str) -> Column:
    """Radial kernel of r = distance / sigma."""
    if kind == "gaussian":
        return F.exp(-(r * r) / 2)
    return F.when(r >= 1, 0.0).otherwise(F.pow(1 - r, 8) * (32 * r * r * r + 25 * r * r + 8 * r + 1))
