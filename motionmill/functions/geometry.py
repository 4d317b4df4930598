"""Face geometry from landmark arrays: 49 x, then 49 y, points counted from 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

POINTS = 49

#: The point that takes the place of point 0, 1, .. 48 in the mirror.
MIRROR = [
    9, 8, 7, 6, 5, 4, 3, 2, 1, 0,
    10, 11, 12, 13, 18, 17, 16, 15, 14, 28,
    27, 26, 25, 30, 29, 22, 21, 20, 19, 24,
    23, 37, 36, 35, 34, 33, 32, 31, 42, 41,
    40, 39, 38, 45, 44, 43, 48, 47, 46,
]


class Point:
    """A point of columns."""

    def __init__(self, x: Column, y: Column):
        self.x, self.y = x, y

    def __sub__(self, other: Point) -> Point:
        return Point(self.x - other.x, self.y - other.y)

    def times(self, k: Column | float) -> Point:
        return Point(self.x * k, self.y * k)

    def dot(self, other: Point) -> Column:
        return self.x * other.x + self.y * other.y

    def norm(self) -> Column:
        return F.sqrt(self.dot(self))


def point(landmarks: Column, i: int) -> Point:
    return Point(F.get(landmarks, F.lit(i)), F.get(landmarks, F.lit(i + POINTS)))


def centre(landmarks: Column, ids: range) -> Point:
    n = len(ids)
    add = lambda cs: sum(cs[1:], cs[0]) / n
    return Point(add([F.get(landmarks, F.lit(i)) for i in ids]), add([F.get(landmarks, F.lit(i + POINTS)) for i in ids]))


def _over(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.when(b != 0, b)


def point_distance(l: Column, i: int, j: int) -> Column:
    return (point(l, i) - point(l, j)).norm()


def projected_distance(l: Column, p1: int, p2: int, p3: int, p4: int) -> Column:
    """Of p1 - p2 on the unit vector p3 - p4."""
    base = point(l, p3) - point(l, p4)
    return _over(base.dot(point(l, p1) - point(l, p2)), base.norm())


def signed_angle(l: Column, p1: int, p2: int, p3: int, p4: int) -> Column:
    """Sine of the angle from p1p2 to p3p4, 0 where either is a point, at most 1 in size."""
    a, b = point(l, p2) - point(l, p1), point(l, p4) - point(l, p3)
    cross = _over(b.x * a.y - b.y * a.x, a.norm() * b.norm())
    return F.greatest(F.least(F.coalesce(cross, F.lit(0.0)), F.lit(1.0)), F.lit(-1.0))


def face_depth(l: Column) -> Column:
    """Square root of the parallelogram of eyes and nose."""
    down, across = point(l, 28) - point(l, 16), point(l, 19) - point(l, 16)
    return F.sqrt(F.abs(down.x * -across.y - -down.y * across.x))


def _mean(l: Column, begin: int) -> Column:
    return F.aggregate(F.slice(l, begin + 1, POINTS), F.lit(0.0), lambda a, b: a + b) / POINTS


def normalize_landmarks(df: DataFrame, landmarks: str = "landmarks") -> DataFrame:
    """Adds depth, x, y and ``normalized``: landmarks centred on their mean and divided by the depth."""
    l = F.col(landmarks)
    known = df.withColumns({"depth": face_depth(l), "x": _mean(l, 0), "y": _mean(l, POINTS)})
    scaled = F.transform(l, lambda v, i: _over(v - F.when(i < POINTS, F.col("x")).otherwise(F.col("y")), F.col("depth")))
    return known.withColumn("normalized", scaled)


def mirror_landmarks(l: Column) -> Column:
    """The face seen in a mirror: x negated, left and right points exchanged."""
    return F.array(*[-F.get(l, F.lit(i)) for i in MIRROR], *[F.get(l, F.lit(i + POINTS)) for i in MIRROR])


def _yaw(l: Column, compat: bool) -> Column:
    nose = point(l, 10)
    axis = centre(l, range(31, 49)) - nose
    off = []
    projections = []
    for eye in (19, 28):
        v = point(l, eye) - nose
        projections.append(axis.times(_over(v.dot(axis), axis.dot(axis))))
        off.append(v)
    second = projections[0 if compat else 1]
    y1, y2 = (off[0] - projections[0]).norm(), (off[1] - second).norm()
    return _over(y1 - y2, y1 + y2)


def _pitch(l: Column) -> Column:
    down, mid, up = centre(l, range(14, 19)), point(l, 13), point(l, 10)
    x1, x2 = (mid - down).times(2.0).norm(), (up - mid).norm()
    return _over(x1 - x2, x1 + x2)


def median_normalize(value: Column, series: list[str], log: bool = True) -> Column:
    """Ratio to the median of the series; with ``log`` its base-2 logarithm, at least -2. Undefined values are 0."""
    ratio = _over(value, F.median(value).over(W.partitionBy(*series)))
    if not log:
        return F.coalesce(ratio, F.lit(0.0))
    return F.greatest(F.coalesce(F.log2(F.when(ratio > 0, ratio)), F.when(ratio.isNull() | (ratio < 0), F.lit(0.0)).otherwise(F.lit(-2.0))), F.lit(-2.0))


def face_channels(df: DataFrame, series: list[str], landmarks: str = "landmarks", compat: bool = False) -> DataFrame:
    """13 channels per row. ``compat`` keeps one projection for both eyes in yaw."""
    # the point numbers are fixed values
    l = F.col(landmarks)
    d = lambda i, j: point_distance(l, i, j)
    n = lambda c, log=True: median_normalize(c, series, log)
    raw = normalize_landmarks(df, landmarks)
    return raw.select(
        *df.drop(landmarks).columns,
        _yaw(l, compat).alias("yaw"),
        _over(point(l, 28).y - point(l, 19).y, point(l, 19).x - point(l, 28).x).alias("roll"),
        _pitch(l).alias("pitch"), "x", "y", "depth",
        n(d(4, 22) + d(5, 25)).alias("eyebrow_raise"),
        n(projected_distance(l, 4, 5, 19, 28)).alias("eyebrow_push"),
        n(d(21, 23) + d(26, 30), False).alias("eye_opening"),
        n(d(31, 37)).alias("mouth_width"), d(44, 47).alias("mouth_opening"),
        n(d(34, 44) + d(47, 40)).alias("lips_protrusion"),
        signed_angle(l, 35, 37, 31, 33).alias("smile"),
    )


def asymmetry_channels(df: DataFrame, series: list[str], landmarks: str = "landmarks") -> DataFrame:
    """Four left-minus-right channels per row."""
    # the point numbers are fixed values
    l = F.col(landmarks)
    d = lambda i, j: point_distance(l, i, j)
    n = lambda c, log=True: median_normalize(c, series, log)
    return df.select(
        *df.drop(landmarks).columns,
        n(d(4, 22) - d(5, 25)).alias("inner_eyebrow"),
        n(d(0, 19) - d(9, 28)).alias("outer_eyebrow"),
        n(d(21, 23) - d(26, 30), False).alias("eyes"),
        (signed_angle(l, 31, 33, 19, 28) - signed_angle(l, 37, 35, 28, 19)).alias("smile"),
    )
