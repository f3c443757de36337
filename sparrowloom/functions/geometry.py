"""Rotations, image geometry and index permutations as column expressions.

A rotation's six numbers are the first two columns of its matrix, row by row
(layout "interleaved") or one column after the other ("stacked").
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, f) -> Column:
    """f(value) with value computed once, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _unit(v: Column, eps: float = 0.0) -> Column:
    return bound(v, lambda u: F.transform(u, lambda x: x / (F.sqrt(u[0] * u[0] + u[1] * u[1] + u[2] * u[2]) + eps)))


def quaternion_matrix(x: Column, y: Column, z: Column, w: Column) -> Column:
    """The rotation of a quaternion of any length, as nine numbers row by row."""

    def rows(q: Column) -> Column:
        x, y, z, w, n = q[0], q[1], q[2], q[3], q[4]
        return F.array(
            1 - 2 * (y * y + z * z) / n, 2 * (x * y - z * w) / n, 2 * (x * z + y * w) / n,
            2 * (x * y + z * w) / n, 1 - 2 * (x * x + z * z) / n, 2 * (y * z - x * w) / n,
            2 * (x * z - y * w) / n, 2 * (y * z + x * w) / n, 1 - 2 * (x * x + y * y) / n,
        )

    return bound(F.array(x, y, z, w, x * x + y * y + z * z + w * w), rows)


def euler_matrix(a: Column, b: Column, c: Column) -> Column:
    """Rotations by a about x, b about y, c about z, about fixed axes in that order; nine numbers row by row."""

    def rows(v: Column) -> Column:
        ca, sa, cb, sb, cc, sc = (v[i] for i in range(6))
        return F.array(
            cc * cb, cc * sb * sa - sc * ca, cc * sb * ca + sc * sa,
            sc * cb, sc * sb * sa + cc * ca, sc * sb * ca - cc * sa,
            -sb, cb * sa, cb * ca,
        )

    return bound(F.array(F.cos(a), F.sin(a), F.cos(b), F.sin(b), F.cos(c), F.sin(c)), rows)


def six_numbers(m: Column, layout: str = "interleaved") -> Column:
    order = [(r, c) for r in range(3) for c in range(2)] if layout == "interleaved" else [(r, c) for c in range(2) for r in range(3)]
    return bound(m, lambda x: F.array(*[x[3 * r + c] for r, c in order]))


def matrix_of_six(six: Column, layout: str = "interleaved") -> Column:
    """The rotation by Gram-Schmidt of the two columns, as nine numbers row by row."""
    at = (lambda s, c: F.array(s[c], s[2 + c], s[4 + c])) if layout == "interleaved" else (lambda s, c: F.slice(s, 3 * c + 1, 3))
    eps = 0.0 if layout == "interleaved" else 1e-6
    dot = lambda p, q: p[0] * q[0] + p[1] * q[1] + p[2] * q[2]
    rest = lambda p, q: bound(dot(p, q), lambda along: F.zip_with(q, p, lambda y, x: y - along * x))

    def rows(p: Column, q: Column) -> Column:
        cross = [p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]]
        return F.array(*[x for r in range(3) for x in (p[r], q[r], cross[r])])

    return bound(six, lambda s: bound(_unit(at(s, 0), eps), lambda p: bound(_unit(rest(p, at(s, 1)), eps), lambda q: rows(p, q))))


def euler_of_matrix(m: Column) -> Column:
    """Angles about x, y, z, away from the poles of the second."""
    return bound(m, lambda x: F.array(F.atan2(x[7], x[8]), F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -x[6]))), F.atan2(x[3], x[0])))


def quaternion_of_matrix(m: Column) -> Column:
    """(x, y, z, w) with w >= 0, by the largest of the four squared parts."""

    def parts(x: Column, root: Column, i: int) -> Column:
        if i == 3:
            q = [(x[7] - x[5]) / root, (x[2] - x[6]) / root, (x[3] - x[1]) / root, root]
        else:
            j, k = (i + 1) % 3, (i + 2) % 3
            q = [root] * 4
            q[j], q[k] = (x[3 * j + i] + x[3 * i + j]) / root, (x[3 * k + i] + x[3 * i + k]) / root
            q[3] = (x[3 * k + j] - x[3 * j + k]) / root
        return F.array(*[v / 2 for v in q])

    def chosen(x: Column, s: Column) -> Column:
        top = F.array_max(s)
        own = lambda root: F.when(s[3] == top, parts(x, root, 3)).when(s[0] == top, parts(x, root, 0)).when(s[1] == top, parts(x, root, 1)).otherwise(parts(x, root, 2))
        return bound(bound(F.sqrt(top), own), lambda q: F.when(q[3] < 0, F.transform(q, lambda v: -v)).otherwise(q))

    def squares(x: Column) -> Column:
        trace = x[0] + x[4] + x[8]
        return F.array(*[1 + 2 * x[4 * i] - trace for i in range(3)], 1 + trace)

    return bound(m, lambda x: bound(squares(x), lambda s: chosen(x, s)))


def axis_angle(m: Column) -> Column:
    """The rotation's axis times its angle; near no rotation half the matrix's antisymmetric part."""

    def scaled(x: Column, angle: Column) -> Column:
        scale = F.when(F.sin(angle) < 1e-6, F.lit(0.5)).otherwise(angle / (2 * F.sin(angle)))
        return F.array(scale * (x[7] - x[5]), scale * (x[2] - x[6]), scale * (x[3] - x[1]))

    turn = lambda x: F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (x[0] + x[4] + x[8] - 1) / 2)))
    return bound(m, lambda x: bound(turn(x), lambda angle: scaled(x, angle)))


def pose_vector(position: Column, six: Column, grip: Column) -> Column:
    return F.concat(position, six, F.array(grip))


def closed_grip(grip: Column) -> Column:
    return F.when(grip > 0.5, 1.0).otherwise(-1.0)


def two_arms(vector: Column) -> Column:
    """One arm's ten numbers and an all-zero second arm."""
    return F.concat(vector, F.array_repeat(F.lit(0.0), 10))


def fit_and_pad(width: Column, height: Column, to_width: int, to_height: int) -> Column:
    """The size of an image scaled to fit, and its offset when centred."""
    scale = F.least(F.lit(float(to_width)) / width, F.lit(float(to_height)) / height)
    w, h = F.least(F.lit(to_width), F.ceil(width * scale)).cast("int"), F.least(F.lit(to_height), F.ceil(height * scale)).cast("int")
    return F.struct(w.alias("width"), h.alias("height"), F.floor((to_width - w) / 2).cast("int").alias("left"), F.floor((to_height - h) / 2).cast("int").alias("top"))


def patch_index(i: Column, height: int, width: int, patch: int) -> Column:
    """The (patch, place in it) of pixel i of a row-major image."""
    y, x = F.floor(i / width).cast("int"), (i % width).cast("int")
    across = width // patch
    return F.struct((F.floor(y / patch) * across + F.floor(x / patch)).cast("int").alias("patch"), ((y % patch) * patch + x % patch).cast("int").alias("place"))


def flipped(i: Column, height: int, width: int) -> Column:
    """Where pixel i of a row-major image goes when both axes are flipped."""
    return (height * width - 1 - i).cast("int")


def denormalized(x: Column) -> Column:
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x + 1) / 2)) * 255).cast("int")


def tinted(pixel: Column, mask: Column) -> Column:
    return F.least(F.lit(255), F.floor(pixel + mask * 0.7)).cast("int")


def run_lengths_to_cells(runs: Column, height: Column) -> Column:
    """Column-major run lengths, off first, as an array of (x, y) of the cells that are on."""
    ends = F.transform(runs, lambda n, i: F.aggregate(F.slice(runs, F.lit(1), i + 1), F.lit(0).cast("bigint"), lambda a, v: a + v))
    spans = F.filter(F.transform(F.arrays_zip(runs.alias("n"), ends.alias("e")), lambda s, i: F.struct(i.alias("i"), (s["e"] - s["n"]).alias("a"), s["e"].alias("b"))), lambda s: (s["i"] % 2 == 1) & (s["b"] > s["a"]))
    cells = F.flatten(F.transform(spans, lambda s: F.sequence(s["a"], s["b"] - 1)))
    return F.transform(cells, lambda c: F.struct(F.floor(c / height).cast("int").alias("x"), (c % height).cast("int").alias("y")))


def stacked_pose(position: Column, matrix: Column, grip: Column) -> Column:
    """Ten numbers of a pose: position, the matrix's first two columns one after the other, grip."""
    return pose_vector(position, six_numbers(matrix, "stacked"), grip)


def with_axis_angle(action: Column) -> Column:
    """Seven numbers from an action of ten: position, the rotation's axis times its angle, grip."""
    return F.concat(F.slice(action, 1, 3), axis_angle(matrix_of_six(F.slice(action, 4, 6), "stacked")), F.slice(action, -1, 1))


def checked_action(action: Column, least: int = 10) -> Column:
    """An action of at least so many numbers; a shorter one fails."""
    return F.when(F.size(action) >= least, action).otherwise(F.raise_error(F.concat(F.lit("action of too few numbers: "), F.size(action).cast("string"))))


def resize_and_crop(width: Column, height: Column, to_width: int, to_height: int, u: Column) -> Column:
    """The size of an image scaled to cover a frame, its ratio kept, and the offset of a crop drawn by u in [0, 1)."""
    wide = width / height >= to_width / to_height
    w = F.when(wide, F.bround(to_height * (width / height))).otherwise(F.lit(to_width)).cast("int")
    h = F.when(wide, F.lit(to_height)).otherwise(F.bround(to_width * (height / width))).cast("int")
    draw = lambda room: F.floor(u * (room + 1)).cast("int")
    return F.struct(w.alias("width"), h.alias("height"), F.when(wide, draw(w - to_width)).otherwise(F.lit(0)).alias("left"), F.when(wide, F.lit(0)).otherwise(draw(h - to_height)).alias("top"))


def square_crop(width: Column, height: Column, size: int, from_top: bool = False) -> Column:
    """The size of an image whose short side becomes size, and the offset of its middle (or topmost) square."""
    short = F.least(width, height)
    w, h = F.floor(width * size / short).cast("int"), F.floor(height * size / short).cast("int")
    middle = lambda room: F.bround(room / 2).cast("int")
    return F.struct(w.alias("width"), h.alias("height"), middle(w - size).alias("left"), (F.lit(0) if from_top else middle(h - size)).alias("top"))


def standardized(x: Column, mean: float = 0.5, deviation: float = 0.5) -> Column:
    return (x - mean) / deviation


def grid_offset(i: Column, columns: int, width: int, height: int) -> Column:
    """Where image i of a grid lies, row by row."""
    return F.struct((i % columns * width).cast("int").alias("x"), (F.floor(i / columns) * height).cast("int").alias("y"))
