"""Polarimetric matrices and decompositions as expressions over complex channels.

A channel is a pair of columns ``<name>_re, <name>_im``; products stay real expressions,
so a whole decomposition is one generated stage.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Complex:
    """A complex column expression."""

    re: Column
    im: Column

    def __add__(self, other: Complex) -> Complex:
        return Complex(self.re + other.re, self.im + other.im)

    def __sub__(self, other: Complex) -> Complex:
        return Complex(self.re - other.re, self.im - other.im)

    def __mul__(self, other) -> Complex:
        if isinstance(other, Complex):
            return Complex(self.re * other.re - self.im * other.im, self.re * other.im + self.im * other.re)
        return Complex(self.re * other, self.im * other)

    def conj(self) -> Complex:
        return Complex(self.re, -self.im)

    def power(self) -> Column:
        return self.re * self.re + self.im * self.im

    def magnitude(self) -> Column:
        return F.sqrt(self.power())


def channel(name: str) -> Complex:
    return Complex(F.col(f"{name}_re"), F.col(f"{name}_im"))


def outer(k: list[Complex], prefix: str) -> list[Column]:
    """Upper triangle of k times its conjugate transpose: ``<prefix>11, <prefix>12_re, ...``."""
    out = []
    for i, a in enumerate(k, 1):
        for j, b in enumerate(k[i - 1 :], i):
            if i == j:
                out.append(a.power().alias(f"{prefix}{i}{i}"))
            else:
                p = a * b.conj()
                out += [p.re.alias(f"{prefix}{i}{j}_re"), p.im.alias(f"{prefix}{i}{j}_im")]
    return out


def pauli() -> dict[str, Complex]:
    hh, hv, vh, vv = map(channel, ("hh", "hv", "vh", "vv"))
    s = 1 / math.sqrt(2)
    return {"surface": (hh + vv) * s, "double_bounce": (hh - vv) * s, "volume": (hv + vh) * s}


def lexicographic() -> list[Complex]:
    hh, hv, vh, vv = map(channel, ("hh", "hv", "vh", "vv"))
    return [hh, (hv + vh) * (1 / math.sqrt(2)), vv]


def covariance(keys: list[str]) -> list[Column]:
    return [*map(F.col, keys), *outer(lexicographic(), "c")]


def coherency(keys: list[str]) -> list[Column]:
    return [*map(F.col, keys), *outer(list(pauli().values()), "t")]


def averaged(matrix: DataFrame, keys: list[str]) -> DataFrame:
    """Matrices averaged over the rows of each key, as a boxcar over blocks does."""
    names = [c for c in matrix.columns if c not in keys]
    return matrix.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in names])


def kennaugh(keys: list[str]) -> list[Column]:
    """Upper triangle ``k11, k12, ...`` of the real 4 x 4 power matrix of a target."""
    hh, hv, vh, vv = map(channel, ("hh", "hv", "vh", "vv"))
    cross = hv - vh
    w = [hh + vv, hh - vv, hv + vh, Complex(cross.im, -cross.re)]
    return [*map(F.col, keys), *[((w[i] * w[j].conj()).re / 4).alias(f"k{i + 1}{j + 1}") for i in range(4) for j in range(i, 4)]]


PAULI_NAMES = ("surface", "double_bounce", "volume")


def pauli_of_coherency() -> dict[str, Column]:
    """Pauli magnitudes from the diagonal of a coherency matrix; phase is lost."""
    return {n: F.sqrt(F.greatest(F.col(f"t{k}{k}"), F.lit(0.0))) for k, n in enumerate(PAULI_NAMES, 1)}


def pauli_of_covariance() -> dict[str, Column]:
    """Pauli magnitudes from a covariance matrix."""
    half, cross = (F.col("c11") + F.col("c33")) / 2, F.col("c13_re")
    return {n: F.sqrt(F.greatest(x, F.lit(0.0))) for n, x in zip(PAULI_NAMES, (half + cross, half - cross, F.col("c22")), strict=True)}


def stokes(x: str, y: str) -> dict[str, Column]:
    a, b = channel(x), channel(y)
    c = a * b.conj()
    return {"s0": a.power() + b.power(), "s1": a.power() - b.power(), "s2": c.re * 2, "s3": c.im * -2}


def degree_of_polarization(s0, s1, s2, s3) -> Column:
    s0, s1, s2, s3 = (F.col(c) if isinstance(c, str) else c for c in (s0, s1, s2, s3))
    return F.when(s0 > 0, F.least(F.sqrt(s1 * s1 + s2 * s2 + s3 * s3) / s0, F.lit(1.0))).otherwise(0.0)


def determinant(p: str = "t") -> Column:
    """Determinant of a Hermitian 3 x 3 matrix in the columns of :func:`outer`."""
    d1, d2, d3 = (F.col(f"{p}{i}{i}") for i in (1, 2, 3))
    a, b, c = (Complex(F.col(f"{p}{ij}_re"), F.col(f"{p}{ij}_im")) for ij in ("12", "13", "23"))
    cross = a * c * b.conj()
    return d1 * d2 * d3 + cross.re * 2 - d1 * c.power() - d2 * b.power() - d3 * a.power()


def trace(p: str = "t") -> Column:
    return F.col(f"{p}11") + F.col(f"{p}22") + F.col(f"{p}33")


def barakat() -> Column:
    """Degree of polarisation of a 3 x 3 coherency matrix."""
    t = trace()
    return F.least(F.sqrt(F.greatest(1 - determinant() * 27 / (t * t * t), F.lit(0.0))), F.lit(1.0))


def _ieee_log(x: Column) -> Column:
    """Logarithm where Spark's own gives null: at zero and below."""
    return F.when(x > 0, F.log(x)).when(x == 0, F.lit(-math.inf)).when(x < 0, F.lit(math.nan))


def shannon_entropy(eps: float | None = 1e-8) -> dict[str, Column]:
    """Intensity and polarimetric parts and their sum; an undefined part counts as nothing.

    Without ``eps`` nothing is held back: a singular matrix gives minus infinity, a
    determinant below zero nan, and the sum takes either over.
    """
    i = trace() if eps is None else F.greatest(trace(), F.lit(eps))
    rest = determinant() * 27 / (i * i * i + (1e-8 if eps is None else eps))
    intensity = _ieee_log(i * (math.e * math.pi / 3)) * 3
    if eps is None:
        polar = total = _ieee_log(rest)
    else:
        polar = F.when(rest > eps, F.log(F.abs(rest)))
        total = F.coalesce(polar, F.lit(0.0))
    return {"h_intensity": intensity, "h_polarimetric": polar, "h_total": intensity + total}


def _held(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def model_free(helix: bool = False) -> dict[str, Column]:
    """Surface, double-bounce and volume powers without a scattering model.

    The scattering angle, held to a quarter turn, parts the polarised power; ``helix``
    first takes out a helix share by the helicity angle. Null where there is no power.
    """
    span, m = trace(), barakat()
    t11, t22, t33 = (F.col(f"t{i}{i}") for i in (1, 2, 3))
    theta = _held(F.atan2(t22 + t33 - t11, t11 - t22 + t33), -math.pi / 4, math.pi / 4)
    tau = _held(F.atan2(F.col("t23_im") * 2, t22 - t33) / 2, -math.pi / 4, math.pi / 4)
    twisted = m * span * (1 - F.cos(tau * 2)) / 2 if helix else F.lit(0.0)
    rest = m * span - twisted
    part = rest * (F.sin(theta * 2) + 1) / 2
    powers = {
        "surface": F.when(theta > 0, rest - part).otherwise(part),
        "double_bounce": F.when(theta > 0, part).otherwise(rest - part),
        "volume": span * (1 - m),
    } | ({"helix": twisted} if helix else {})
    out = {k: F.when(span > 0, F.greatest(v, F.lit(0.0))) for k, v in powers.items()}
    return out | {"theta": F.degrees(theta)} | ({"tau": F.degrees(tau)} if helix else {})


def freeman(matrices: DataFrame, keys: list[str], eps: float = 1e-10) -> DataFrame:
    """Three-component powers of covariance matrices ``c11 .. c33``.

    Volume is taken from the cross channel; where nothing of a co-polar channel is left
    all power is volume. Powers are held to the largest span, one broadcast row.
    """
    c11, c22, c33 = (F.col(f"c{i}{i}") for i in (1, 2, 3))
    volume = c22 * 1.5
    rows = matrices.withColumns(
        {"_a": c11 - volume, "_b": c33 - volume, "_re": F.col("c13_re") - volume / 3, "_im": F.col("c13_im"), "_v": volume, "span": c11 + c22 + c33}
    )
    a, b, v = F.col("_a"), F.col("_b"), F.col("_v")
    cross2 = F.col("_re") ** 2 + F.col("_im") ** 2
    scale = F.when((cross2 > a * b) & (cross2 > eps), F.sqrt(F.greatest(a * b, F.lit(0.0)) / cross2)).otherwise(1.0)
    rows = rows.withColumn("_k", scale).withColumns({"_re": F.col("_re") * F.col("_k"), "_im": F.col("_im") * F.col("_k")})
    re, im = F.col("_re"), F.col("_im")
    only = (a <= eps) | (b <= eps)
    odd = re >= 0
    # The weaker mechanism first, then the stronger one and its ratio.
    weak = (a * b - re * re - im * im) / F.greatest(a + b + F.abs(re) * 2, F.lit(eps))
    strong = b - weak
    ratio = F.sqrt((weak + F.abs(re)) ** 2 + im * im) / F.greatest(strong, F.lit(eps))
    high, low = strong * (ratio * ratio + 1), weak * 2
    surface = F.when(only, 0.0).when(odd, high).otherwise(low)
    double = F.when(only, 0.0).when(odd, low).otherwise(high)
    whole = F.when(only, (c11 + c22 + c33 + v * 2) * 3 / 8).otherwise(v) * (8 / 3)
    top = F.broadcast(matrices.agg(F.max(c11 + c22 + c33).alias("_top")))
    held = {k: F.least(F.greatest(x, F.lit(0.0)), F.col("_top")) for k, x in {"surface": surface, "double_bounce": double, "volume": whole}.items()}
    out = rows.join(top).select(*keys, *[x.alias(k) for k, x in held.items()], "span")
    some = (F.col("surface") != 0) | (F.col("double_bounce") != 0) | (F.col("volume") != 0)
    return out.select(*keys, *[F.when(some, F.col(k)).alias(k) for k in held], "span")


def yamaguchi(matrices: DataFrame, keys: list[str], model: str = "y4r", eps: float = 1e-6) -> DataFrame:
    """Surface, double-bounce, volume and helix powers of coherency matrices ``t11 .. t33``.

    ``y4o`` is the original model, ``y4r`` first turns each matrix to its least cross
    power, ``y4s`` also tells volumes of double bounces. Where the volume would be
    negative three components without a helix serve. Powers are held to the largest
    span, one broadcast row.
    """
    if model not in ("y4o", "y4r", "y4s"):
        raise ValueError(f"model must be y4o, y4r or y4s, not {model!r}")
    t = {c: F.col(c) for c in ("t11", "t12_re", "t12_im", "t13_re", "t13_im", "t22", "t23_re", "t23_im", "t33")}
    gap = t["t22"] - t["t33"]
    angle = F.when(F.abs(gap) < eps, 0.0).otherwise(F.atan(t["t23_re"] * 2 / gap) / 2) if model != "y4o" else F.lit(0.0)
    rows = matrices.withColumn("_g", angle).withColumns({"_c": F.cos("_g"), "_s": F.sin("_g")})
    c, s = F.col("_c"), F.col("_s")
    shared = t["t23_re"] * c * s * 2
    rows = rows.withColumns(
        {
            "_a": t["t11"],
            "_b": t["t22"] * c * c + t["t33"] * s * s + shared,
            "_d": t["t22"] * s * s + t["t33"] * c * c - shared,
            "_pr": t["t12_re"] * c + t["t13_re"] * s,
            "_pi": t["t12_im"] * c + t["t13_im"] * s,
            "_qr": t["t13_re"] * c - t["t12_re"] * s,
            "_qi": t["t13_im"] * c - t["t12_im"] * s,
            "_pc": F.abs(t["t23_im"]) * 2,
            "span": t["t11"] + t["t22"] + t["t33"],
        }
    )
    a, b, d, pr, pi, pc, span = (F.col(n) for n in ("_a", "_b", "_d", "_pr", "_pi", "_pc", "span"))
    decibels = lambda x, y: F.when(y < eps, 0.0).otherwise(F.log10(F.greatest(x / y, F.lit(eps))) * 10)
    bounced = a - b + d * 7 / 8 + pc / 16 <= 0 if model == "y4s" else F.lit(False)
    rows = rows.withColumns(
        {
            "_x": bounced,
            "_r": decibels(a + b - pr * 2, a + b + pr * 2),
            "_hh": (a + b) / 2 + pr,
            "_vv": (a + b) / 2 - pr,
        }
    ).withColumn("_f", decibels(F.col("_vv"), F.col("_hh")))
    near = lambda r: (r > -2) & (r <= 2)
    two = F.col("_x")
    volume = (d * 2 - pc) * F.when(two, 15 / 16).when(near(F.col("_r")), 2.0).otherwise(15 / 8)

    # Three components: what a volume of the orientation that the ratio shows takes away.
    f = F.col("_f")
    by_ratio = lambda low, even, high: F.when(f <= -2, low).when(f > 2, high).otherwise(even)
    rows = rows.withColumn("_pv", volume).withColumn("_fv", d * by_ratio(15 / 8, 2.0, 15 / 8))
    fv = F.col("_fv")
    rows = rows.withColumns(
        {
            "_h": F.col("_hh") - fv * by_ratio(8 / 15, 3 / 8, 3 / 15),
            "_v": F.col("_vv") - fv * by_ratio(3 / 15, 3 / 8, 8 / 15),
            "_re": (a - b) / 2 - fv * by_ratio(2 / 15, 1 / 8, 2 / 15),
        }
    )
    h, v = F.col("_h"), F.col("_v")
    power = F.col("_re") * F.col("_re") + pi * pi
    rows = rows.withColumn("_k", F.when(power > h * v, F.sqrt(F.greatest(h * v, F.lit(0.0)) / F.greatest(power, F.lit(eps)))).otherwise(1.0))
    rows = rows.withColumns({"_re": F.col("_re") * F.col("_k"), "_im": -pi * F.col("_k")})
    re, im = F.col("_re"), F.col("_im")
    # Where nothing is left to divide by, the volume has all power.
    rows = rows.withColumn("_w", F.try_divide(h * v - re * re - im * im, h + v + F.abs(re) * 2))
    weak, strong = F.col("_w"), F.col("_v") - F.col("_w")
    high = F.when(F.abs(strong) > eps, strong * (1 + ((weak + F.abs(re)) ** 2 + im * im) / (strong * strong))).otherwise(strong)
    only, odd = (h <= eps) | (v <= eps), re >= 0
    three = {
        "surface": F.when(only, F.col("_hh") + d / 2 + F.col("_vv")).when(odd, high).otherwise(weak * 2),
        "double_bounce": F.when(only, 0.0).when(odd, weak * 2).otherwise(high),
        "volume": F.when(only, 0.0).otherwise(fv),
        "helix": F.lit(0.0),
    }

    # Four components: the cross term goes to the stronger of surface and double bounce.
    pv = F.col("_pv")
    shift = F.when(two | near(F.col("_r")), 0.0).when(F.col("_r") <= -2, -pv / 6).otherwise(pv / 6)
    rows = rows.withColumns(
        {
            "_cross": (pr + F.col("_qr") + shift) ** 2 + (pi + F.col("_qi")) ** 2,
            "_S": a - F.when(two, 0.0).otherwise(pv / 2),
            "_full": ~two & (pv + pc > span),
            "_led": ~two & (a * 2 + pc - span > 0),
        }
    ).withColumn("_D", span - pv - pc - F.col("_S"))
    led = F.col("_led")
    base = F.when(led, F.col("_S")).otherwise(F.col("_D"))
    rows = rows.withColumn("_q", F.col("_cross") / F.when(F.abs(base) > eps, base).otherwise(eps) * F.when(led, 1.0).otherwise(-1.0))
    rows = rows.withColumns({"_S": F.col("_S") + F.col("_q"), "_D": F.col("_D") - F.col("_q")})
    ps, pd, full = F.col("_S"), F.col("_D"), F.col("_full")
    rest = span - pv - pc
    none = full | ((ps < 0) & (pd < 0))
    four = {
        "surface": F.when(none | (ps < 0), 0.0).when(pd < 0, rest).otherwise(ps),
        "double_bounce": F.when(none | (pd < 0), 0.0).when(ps < 0, rest).otherwise(pd),
        "volume": F.when(none, span - pc).otherwise(pv),
        "helix": pc,
    }
    top = F.broadcast(matrices.agg(F.max(t["t11"] + t["t22"] + t["t33"]).alias("_top")))
    held = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.col("_top"))
    return rows.join(top).select(*keys, *[held(F.when(pv < 0, three[k]).otherwise(four[k])).alias(k) for k in four], "span")


def coherency_of_covariance(keys: list[str]) -> list[Column]:
    """Coherency matrices ``t11 .. t33`` of covariance matrices ``c11 .. c33``."""
    c11, c22, c33 = (F.col(f"c{i}{i}") for i in (1, 2, 3))
    x, y, z = (Complex(F.col(f"c{ij}_re"), F.col(f"c{ij}_im")) for ij in ("12", "13", "23"))
    s = 1 / math.sqrt(2)
    zc = z.conj()
    t12 = Complex((c11 - c33) / 2, -y.im)
    t13, t23 = (x + zc) * s, (x - zc) * s
    out = {"t11": (c11 + c33) / 2 + y.re, "t12_re": t12.re, "t12_im": t12.im, "t13_re": t13.re, "t13_im": t13.im}
    out |= {"t22": (c11 + c33) / 2 - y.re, "t23_re": t23.re, "t23_im": t23.im, "t33": c22}
    return [*map(F.col, keys), *[e.alias(k) for k, e in out.items()]]


TOUZI = [f"{n}{k}" for n in ("alpha", "phi", "tau", "psi") for k in (1, 2, 3)] + [f"{n}_mean" for n in ("alpha", "phi", "tau", "psi")]


def touzi(matrices: DataFrame, keys: list[str], eps: float = 1e-8) -> DataFrame:
    """Scattering type, its phase, helicity and orientation, in degrees, of each eigenvector
    of coherency matrices, strongest first, and their means weighted by the eigenvalues."""
    kinds = dict(matrices.dtypes)
    names = ["t11", "t12_re", "t12_im", "t13_re", "t13_im", "t22", "t23_re", "t23_im", "t33"]
    schema = ", ".join([f"{k} {kinds[k]}" for k in keys] + [f"{c} double" for c in TOUZI])
    phase = lambda im, re: np.arctan2(im, re + eps)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            m = np.zeros((len(pdf), 3, 3), complex)
            for n in names:
                i, j = int(n[1]) - 1, int(n[2]) - 1
                m[:, i, j] += pdf[n].to_numpy(float) * (1j if n.endswith("im") else 1)
                m[:, j, i] = m[:, i, j].conj()
            values, vectors = np.linalg.eigh(m)
            values, vectors = np.maximum(values[:, ::-1], 0), vectors[:, :, ::-1]
            x, y, z = (vectors * np.exp(-1j * phase(vectors[:, :1].imag, vectors[:, :1].real))).transpose(1, 0, 2)
            turn = phase(z.real, y.real)
            y, z = y * np.cos(turn) + z * np.sin(turn), z * np.cos(turn) - y * np.sin(turn)
            twist = phase(-z.imag, x.real)
            alpha = np.arccos(np.clip((x * np.cos(twist) + 1j * z * np.sin(twist)).real, -1, 1))
            sign = np.where(np.abs(turn) > np.pi / 2, -1, 1)
            parts = [alpha, phase(y.imag, y.real) * sign, twist / 2 * sign, turn / 2]
            total = values.sum(axis=1, keepdims=True)
            share = np.clip(values / np.where(total > 0, total, 1), 0, 1)
            table = np.hstack([*parts, np.stack([(p * share).sum(axis=1) for p in parts], 1)])
            yield pd.concat([pdf[keys].reset_index(drop=True), pd.DataFrame(np.degrees(table), columns=TOUZI)], axis=1)

    return matrices.select(*keys, *names).mapInPandas(run, schema)


def neumann(eps: float = 2.220446049250313e-16) -> dict[str, Column]:
    """Orientation, particle anisotropy's size and phase, and orientation randomness."""
    t11, t22, t33 = (F.col(f"t{i}{i}") for i in (1, 2, 3))
    raw = (F.atan2(F.col("t23_re") * -2, t33 - t22) + math.pi) / 4
    phi = F.when(raw > math.pi / 4, raw - math.pi / 2).otherwise(raw)
    c2, s2, s4 = F.cos(phi * 2), F.sin(phi * 2), F.sin(phi * 4)
    re, im = F.col("t12_re") * c2 - F.col("t13_re") * s2, F.col("t12_im") * c2 - F.col("t13_im") * s2
    # Both turned powers lose the same cross term; the sum is not the trace's share.
    turned = t22 + t33 - F.col("t23_re") * s4 * 2
    size = F.sqrt(F.greatest(turned / (t11 + eps), F.lit(0.0)))
    tau = 1 - F.sqrt(re * re + im * im) / (t11 + eps) / (size + eps)
    return {"psi": F.degrees(phi), "delta_mod": size, "delta_pha": F.degrees(F.atan2(im, re + eps)), "tau": _held(tau, 0.0, 1.0)}


def praks(eps: float = 1e-12) -> dict[str, Column]:
    """Parameters of the span-normalised covariance matrix by its Frobenius norm."""
    span = F.greatest(trace("c"), F.lit(eps))
    names = ("12", "13", "23")
    off = sum((F.col(f"c{n}_re") ** 2 + F.col(f"c{n}_im") ** 2 for n in names), F.lit(0.0))
    norm = (sum((F.col(f"c{i}{i}") ** 2 for i in (1, 2, 3)), F.lit(0.0)) + off * 2) / (span * span)
    purity = F.sqrt(F.greatest(norm - 0.25, F.lit(0.0))) * 2
    d = [F.col(f"c{i}{i}") / span + 0.16 for i in (1, 2, 3)]
    a, b, c = (Complex(F.col(f"c{n}_re") / span, F.col(f"c{n}_im") / span) for n in names)
    det = d[0] * d[1] * d[2] + (a * c * b.conj()).re * 2 - d[0] * c.power() - d[1] * b.power() - d[2] * a.power()
    return {
        "frobenius_norm": norm,
        "predominance": F.sqrt(norm),
        "diversity": (1 - norm) * 1.5,
        "purity": purity,
        "depolarization": 1 - purity / math.sqrt(3),
        "alpha": F.degrees(F.acos(_held(F.col("c11") / span, -1.0, 1.0))),
        "entropy": F.log(F.abs(det) + eps) * (0.78 / math.log(3)) + 2.52,
    }


def dual_entropy_alpha(c11: Column, c22: Column, re: Column, im: Column) -> dict[str, Column]:
    """Entropy (base 2), mean alpha in degrees, anisotropy and span of a 2 x 2 matrix."""
    cross = re * re + im * im
    t = c11 + c22
    disc = F.sqrt(F.greatest(t * t - (c11 * c22 - cross) * 4, F.lit(0.0)))
    l1, l2 = F.greatest((t + disc) / 2, F.lit(0.0)), F.greatest((t - disc) / 2, F.lit(0.0))
    span = l1 + l2
    p1, p2 = l1 / F.when(span > 0, span).otherwise(1.0), l2 / F.when(span > 0, span).otherwise(1.0)
    part = lambda p: F.when(p > 0, -p * F.log2(p)).otherwise(0.0)

    def alpha(lam: Column) -> Column:
        size = F.sqrt(cross + (lam - c11) * (lam - c11))
        return F.when(size > 0, F.acos(F.least(F.sqrt(cross) / size, F.lit(1.0)))).otherwise(0.0)

    return {
        "entropy": F.least(part(p1) + part(p2), F.lit(1.0)),
        "alpha": F.degrees(p1 * alpha(l1) + p2 * alpha(l2)),
        "anisotropy": F.when(span > 0, F.least(disc / span, F.lit(1.0))).otherwise(0.0),
        "span": span,
    }


def mode(polarizations: Column) -> Column:
    """Quad, dual, compact or single, from an array of polarisation names."""
    have = lambda *n: F.size(F.array_intersect(polarizations, F.array(*map(F.lit, n)))) == len(n)
    n = F.size(F.array_distinct(polarizations))
    compact = F.exists(polarizations, lambda p: F.upper(p).rlike("^[LR]"))
    return F.when(compact, "compact").when(have("HH", "HV", "VV") | have("HH", "VH", "VV"), "quad").when(n == 2, "dual").when(n == 1, "single").otherwise("unknown")
