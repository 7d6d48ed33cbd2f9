"""Scalar geometry as Spark columns: eigenvalues, projections, part relations, names."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The label colours (red, green, blue), the last one for labels out of range.
COLORS = [(1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 0), (1, 0, 1), (0, 1, 1), (0.5, 0, 0), (0, 0.5, 0), (0, 0, 0.5), (0.5, 0.5, 0), (0.5, 0.5, 0.5)]
MAX_LABEL = 10
#: Stands for a curvature outside [0, 1].
BAD_CURVATURE = 100.0


SIX = ("xx", "xy", "xz", "yy", "yz", "zz")


def with_eigen(df: DataFrame, sets: dict[str, list], vectors: tuple[str, ...] = ()) -> DataFrame:
    """Adds, for each symmetric 3 x 3 matrix, its descending eigenvalues {name}_1, _2, _3.

    ``sets``: name -> the six entries xx, xy, xz, yy, yz, zz.  For names in ``vectors`` also
    {name}_e1 and {name}_e3, unit eigenvectors (arrays) of the largest and smallest value.
    Closed form, a column a step: nested as one expression it would grow beyond bounds.
    """
    before = df.columns
    col = F.col
    steps: list[dict] = [{} for _ in range(8)]
    for n, six in sets.items():
        m = {k: col(f"__{n}{k}") for k in (*SIX, "q", "p", "det", "phi")}
        a, b, c = (m[k] - m["q"] for k in ("xx", "yy", "zz"))
        steps[0] |= {f"__{n}{k}": v for k, v in zip(SIX, six, strict=True)}
        steps[1][f"__{n}q"] = (m["xx"] + m["yy"] + m["zz"]) / 3
        steps[2][f"__{n}p"] = F.sqrt((a * a + b * b + c * c + 2 * (m["xy"] * m["xy"] + m["xz"] * m["xz"] + m["yz"] * m["yz"])) / 6)
        steps[2][f"__{n}det"] = a * (b * c - m["yz"] * m["yz"]) - m["xy"] * (m["xy"] * c - m["yz"] * m["xz"]) + m["xz"] * (m["xy"] * m["yz"] - b * m["xz"])
        r = F.coalesce(m["det"] / 2 / F.nullif(m["p"] * m["p"] * m["p"], F.lit(0.0)), F.lit(0.0))
        steps[3][f"__{n}phi"] = F.acos(F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0))) / 3
        steps[4] |= {f"{n}_1": m["q"] + 2 * m["p"] * F.cos(m["phi"]), f"{n}_3": m["q"] + 2 * m["p"] * F.cos(m["phi"] + 2 * math.pi / 3)}
        steps[5][f"{n}_2"] = 3 * m["q"] - col(f"{n}_1") - col(f"{n}_3")
        for e in (1, 3) if n in vectors else ():
            value = col(f"{n}_{e}")
            rows = [(m["xx"] - value, m["xy"], m["xz"]), (m["xy"], m["yy"] - value, m["yz"]), (m["xz"], m["yz"], m["zz"] - value)]
            # The longest cross product of two rows of A - value I ...
            steps[6][f"__{n}c{e}"] = F.array(*[F.array(*cross(rows[i], rows[j])) for i, j in ((0, 1), (0, 2), (1, 2))])
            size2 = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
            best = F.array_max(F.transform(f"__{n}c{e}", lambda v: F.struct(size2(v).alias("n"), v.alias("v"))))
            steps[7][f"__{n}b{e}"] = best
    for step in steps:
        if step:
            df = df.withColumns(step)
    # ... as a unit vector whose component of largest size is positive; an undefined one is null.
    last = {}
    for n in vectors:
        for e in (1, 3):
            best = col(f"__{n}b{e}")
            sign = F.signum(F.array_max(F.transform(best["v"], lambda x: F.struct(F.abs(x).alias("a"), x.alias("x"))))["x"])
            last[f"{n}_e{e}"] = _scaled(best, sign)
    df = df.withColumns(last) if last else df
    values = [f"{n}_{i}" for n in sets for i in (1, 2, 3)]
    return df.select(*before, *values, *last)


def _scaled(best: Column, sign: Column) -> Column:
    return F.when(best["n"] > 0, F.transform(best["v"], lambda x: x * sign / F.sqrt(F.greatest(best["n"], F.lit(1e-300)))))


def cross(a, b):
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def dot(a, b) -> Column:
    return reduce(lambda s, t: s + t, [x * y for x, y in zip(a, b, strict=True)])


def quotients(name: str) -> list[Column]:
    """Second and third eigenvalue over the first; null if that is 0."""
    top = F.nullif(F.col(f"{name}_1"), F.lit(0.0))
    return [F.col(f"{name}_2") / top, F.col(f"{name}_3") / top]


def curvature(name: str) -> Column:
    """Smallest eigenvalue's share; what is not in [0, 1] becomes ``BAD_CURVATURE``."""
    share = F.col(f"{name}_3") / F.nullif(F.col(f"{name}_1") + F.col(f"{name}_2") + F.col(f"{name}_3"), F.lit(0.0))
    return F.when(share.between(0, 1), share).otherwise(BAD_CURVATURE)


def label_color(label, boxes: bool = False) -> Column:
    """Array of red, green, blue; labels out of range get the last colour (boxes: the first)."""
    table = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in COLORS])
    label = F.col(label) if isinstance(label, str) else label
    return F.when(label.between(0, MAX_LABEL), F.get(table, label)).otherwise(table[0 if boxes else MAX_LABEL])


def model_name(path) -> Column:
    """Base name up to its first dot; either kind of slash separates."""
    return F.substring_index(F.regexp_extract(path, r"([^/\\]*)$", 1), ".", 1)


def model_name_with_class(path) -> Column:
    """Grandparent folder, underscore, base name up to its first dot."""
    parts = F.split(path, r"[/\\]")
    return F.concat_ws("_", F.try_element_at(parts, F.lit(-3)), model_name(path))


def seg_path(path) -> Column:
    """Ground-truth file of a mesh: parent folder ``gt``, extension ``seg``."""
    return F.regexp_replace(path, r"[^/\\]+([/\\])([^/\\]*)...$", "gt$1$2seg")


def n_choose_k(n, k) -> Column:
    return F.factorial(n) / (F.factorial(k) * F.factorial(n - k))


def millis_of_day(moment) -> Column:
    """Milliseconds since midnight in the session's time zone."""
    return F.unix_millis(moment) - F.unix_millis(F.date_trunc("day", moment))


def nearly_equal(a, b, eps: float = 1e-8) -> Column:
    return F.abs(a - b) < eps


def transform(point, matrix, w: float = 1.0) -> list[Column]:
    """A 4 x 4 row-major matrix times (x, y, z, w): w 1 for points, 0 for normals."""
    return [dot(point, [F.lit(float(v)) for v in matrix[4 * i : 4 * i + 3]]) + float(matrix[4 * i + 3]) * w for i in range(3)]


def height_vector(rot, trans, scale) -> Column:
    """Gravity (0, -1, 0) in a box's frame: -R[1][i] s[i] for each axis, then -t[1]; rot is row-major."""
    return F.array(*[-F.get(rot, F.lit(3 + i)) * F.get(scale, F.lit(i)) for i in range(3)], -F.get(trans, F.lit(1)))


def relation(rot1, trans1, scale1, h1, rot2, trans2, scale2, h2) -> Column:
    """32 numbers: box 1 seen from box 2 (3 x 4, column-major), height 1, box 2 from box 1, height 2."""
    g = lambda a, i: F.get(a, F.lit(i))

    def seen(ra, ta, sa, rb, tb):
        r = [[sum_of(g(rb, 3 * k + i) * g(ra, 3 * k + j) for k in range(3)) for j in range(3)] for i in range(3)]
        t = [sum_of(g(rb, 3 * k + i) * (g(ta, k) - g(tb, k)) for k in range(3)) for i in range(3)]
        return [r[i][j] * g(sa, j) for j in range(3) for i in range(3)] + t

    return F.array(*seen(rot1, trans1, scale1, rot2, trans2), *[g(h1, i) for i in range(4)], *seen(rot2, trans2, scale2, rot1, trans1), *[g(h2, i) for i in range(4)])


def sum_of(terms) -> Column:
    return reduce(lambda a, b: a + b, terms)


def in_box(point, center, axes, lengths, faithful: bool = False) -> Column:
    """Whether a point is in an oriented box; ``faithful`` takes full instead of half lengths."""
    offset = [p - c for p, c in zip(point, center, strict=True)]
    inside = [F.abs(dot(offset, axis)) <= length / (1 if faithful else 2) for axis, length in zip(axes, lengths, strict=True)]
    return inside[0] & inside[1] & inside[2]
