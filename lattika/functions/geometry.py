"""Boxes, points and grids as column expressions. All lengths are doubles; a null component gives null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tolerance and least margin of a grid cell, share of a box kept free, bounds of a grid.
GRID_EPSILON, GRID_MARGIN, GRID_SHARE, GRID_MOST = 1e-9, 0.025, 0.1, 12


# Least overlap and greatest distance of centres of two boxes that still match.
OVERLAP, NEAR = 0.2, 0.06


def _known(*values: Column) -> Column:
    """No component is null; `greatest` and `least` would pass over one."""
    return reduce(Column.__and__, [v.isNotNull() for v in values])


def closed_contains(left: Column, top: Column, width: Column, height: Column, x: Column, y: Column) -> Column:
    """A point in a rectangle whose four edges belong to it."""
    return (x >= left) & (x <= left + width) & (y >= top) & (y <= top + height)


def half_open_contains(left: Column, top: Column, right: Column, bottom: Column, x: Column, y: Column) -> Column:
    """A point in a rectangle without its right and bottom edges."""
    return (x >= left) & (x < right) & (y >= top) & (y < bottom)


def valid_half_open(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    return (left < right) & (top < bottom)


def rect_within(inner: tuple[Column, ...], outer: tuple[Column, ...]) -> Column:
    """(left, top, right, bottom) of one inside another, edges included."""
    return (inner[0] >= outer[0]) & (inner[1] >= outer[1]) & (inner[2] <= outer[2]) & (inner[3] <= outer[3])


def boxes_intersect(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """(x, y, width, height) boxes that share area."""
    return (a[0] < b[0] + b[2]) & (b[0] < a[0] + a[2]) & (a[1] < b[1] + b[3]) & (b[1] < a[1] + a[3])


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of (x, y, width, height) boxes; 0 where the union is empty."""
    wide = F.greatest(F.lit(0.0), F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0]))
    high = F.greatest(F.lit(0.0), F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1]))
    union = a[2] * a[3] + b[2] * b[3] - wide * high
    return F.when(_known(*a, *b), F.when(union > 0, F.try_divide(wide * high, union)).otherwise(F.lit(0.0)))


def center_distance(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    return F.hypot(a[0] + a[2] / 2 - b[0] - b[2] / 2, a[1] + a[3] / 2 - b[1] - b[3] / 2)


def match_score(a: tuple[Column, ...], b: tuple[Column, ...], overlap: float = OVERLAP, near: float = NEAR) -> Column:
    """How well two boxes match: 1 + IoU from `overlap` on, else 0.5 - distance up to `near`, else null."""
    shared, apart = iou(a, b), center_distance(a, b)
    return F.when(shared >= overlap, shared + 1).when(apart <= near, F.lit(0.5) - apart)


def clamp_unit_box(x: Column, y: Column, width: Column, height: Column) -> Column:
    """A box cut to the unit square, at least 0.001 wide and high, rounded to six digits."""
    left, top = (F.greatest(F.lit(0.0), F.least(F.lit(0.999), v)) for v in (x, y))
    wide = F.greatest(F.lit(0.001), F.least(1 - left, width))
    high = F.greatest(F.lit(0.001), F.least(1 - top, height))
    return F.when(_known(x, y, width, height), F.struct(*[F.round(v, 6).alias(n) for v, n in zip((left, top, wide, high), ("x", "y", "width", "height"))]))


def clamp_box(x: Column, y: Column, width: Column, height: Column) -> Column:
    """The coarser clamp of an editor: sides of 0.01 at least, moved back inside, not rounded."""
    wide, high = (F.greatest(F.lit(0.01), F.least(F.lit(1.0), v)) for v in (width, height))
    left = F.greatest(F.lit(0.0), F.least(1 - wide, x))
    top = F.greatest(F.lit(0.0), F.least(1 - high, y))
    return F.when(_known(x, y, width, height), F.struct(left.alias("x"), top.alias("y"), wide.alias("width"), high.alias("height")))


def union_box(x: Column, y: Column, width: Column, height: Column) -> Column:
    """Aggregate: the least box that holds all."""
    left, top = F.min(x), F.min(y)
    return F.struct(left.alias("x"), top.alias("y"), (F.max(x + width) - left).alias("width"), (F.max(y + height) - top).alias("height"))


def grid_count(value: Column) -> Column:
    """A number of cells, rounded half up and kept between 1 and 12; what is not a number counts as 1."""
    number = F.when(value.isNull() | F.isnan(value), F.lit(1.0)).otherwise(value)
    return F.greatest(F.lit(1), F.least(F.lit(GRID_MOST), F.floor(number + 0.5))).cast("int")


def grid_axis(start: Column, size: Column, most: Column) -> Column:
    """(count, index) on one axis: the most cells of which one holds [start, start + size] with a margin, or at least holds it, or one cell."""
    counts = F.transform(F.sequence(F.lit(0), most - 1), lambda i: most - i)

    def cell(n: Column) -> Column:
        return F.floor(start * n).cast("int")

    def last(n: Column) -> Column:
        return (F.ceil((start + size) * n - GRID_EPSILON) - 1).cast("int")

    def holds(n: Column) -> Column:
        return (cell(n) == last(n)) & (cell(n) >= 0) & (cell(n) < n)

    def roomy(n: Column) -> Column:
        margin = F.greatest(F.lit(GRID_MARGIN), size * n * GRID_SHARE)
        inside = start * n - cell(n)
        return holds(n) & (inside >= margin - GRID_EPSILON) & (1 - (inside + size * n) >= margin - GRID_EPSILON)

    best = F.coalesce(F.get(F.filter(counts, roomy), F.lit(0)), F.get(F.filter(counts, holds), F.lit(0)))
    return F.struct(F.coalesce(best, F.lit(1)).cast("int").alias("count"), F.coalesce(cell(best), F.lit(0)).alias("index"))


def grid_for_box(x: Column, y: Column, width: Column, height: Column, most_columns: Column, most_rows: Column) -> Column:
    """columns, rows and region (from 1, row by row) of the finest grid with one cell around a box."""
    across = grid_axis(x, width, grid_count(most_columns.cast("double")))
    down = grid_axis(y, height, grid_count(most_rows.cast("double")))
    region = down["index"] * across["count"] + across["index"] + 1
    return F.struct(across["count"].alias("columns"), down["count"].alias("rows"), region.cast("int").alias("region"))


def parse_bounds(text: Column) -> Column:
    """left, top, right, bottom of `[l,t][r,b]`; null where the text differs or the area is empty."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"(-?\d+)"), F.lit(1)), lambda v: v.cast("int"))
    parts = [F.get(numbers, F.lit(i)).alias(n) for i, n in enumerate(("left", "top", "right", "bottom"))]
    whole = text.rlike(r"^\[-?\d+,-?\d+\]\[-?\d+,-?\d+\]$")
    return F.when(whole & (F.get(numbers, F.lit(2)) > F.get(numbers, F.lit(0))) & (F.get(numbers, F.lit(3)) > F.get(numbers, F.lit(1))), F.struct(*parts))


def normalized_bounds(bounds: Column, width: Column, height: Column) -> Column:
    """Bounds cut to a viewport, as a unit box; null where nothing is left, and for null bounds."""
    left, top = F.greatest(F.lit(0), bounds["left"]), F.greatest(F.lit(0), bounds["top"])
    right, bottom = F.least(width, bounds["right"]), F.least(height, bounds["bottom"])
    box = F.struct((left / width).alias("x"), (top / height).alias("y"), ((right - left) / width).alias("width"), ((bottom - top) / height).alias("height"))
    return F.when(bounds.isNotNull() & (right > left) & (bottom > top), box)  # greatest and least pass over nulls


def project_point(matrix: Column, x: Column, y: Column) -> Column:
    """A point under a 3 x 3 projective matrix given as nine numbers, row by row; null where it lies at infinity."""
    m = [F.get(matrix, F.lit(i)) for i in range(9)]
    w = m[6] * x + m[7] * y + m[8]
    at = F.struct(F.try_divide(m[0] * x + m[1] * y + m[2], w).alias("x"), F.try_divide(m[3] * x + m[4] * y + m[5], w).alias("y"))
    return F.when(F.abs(w) > 1e-12, at)


def determinant(matrix: Column) -> Column:
    a, b, c, d, e, f, g, h, i = (F.get(matrix, F.lit(k)) for k in range(9))
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def inverse(matrix: Column) -> Column:
    """The inverse of a 3 x 3 matrix; null where the determinant is below 1e-12 in size."""
    a, b, c, d, e, f, g, h, i = (F.get(matrix, F.lit(k)) for k in range(9))
    det = determinant(matrix)
    cofactors = (e * i - f * h, c * h - b * i, b * f - c * e, f * g - d * i, a * i - c * g, c * d - a * f, d * h - e * g, b * g - a * h, a * e - b * d)
    return F.when(F.abs(det) >= 1e-12, F.array(*[F.try_divide(v, det) for v in cofactors]))


def normalized_rect(rect: Column) -> Column:
    """left, top, width, height of a map of numbers whose place may be named left, top or x, y; null where one is missing."""
    get = lambda *names: F.coalesce(*[F.try_element_at(rect, F.lit(n)) for n in names]).cast("double")
    parts = {"left": get("left", "x"), "top": get("top", "y"), "width": get("width"), "height": get("height")}
    return F.when(reduce(Column.__and__, [v.isNotNull() for v in parts.values()]), F.struct(*[v.alias(k) for k, v in parts.items()]))


def project_rect(matrix: Column, x: Column, y: Column, width: Column, height: Column) -> Column:
    """The least box around the four corners of a box under a projective matrix; null where one lies at infinity."""
    corners = [project_point(matrix, a, b) for a, b in ((x, y), (x + width, y), (x, y + height), (x + width, y + height))]
    xs, ys = ([c[n] for c in corners] for n in ("x", "y"))
    left, top = F.least(*xs), F.least(*ys)
    box = F.struct(left.alias("x"), top.alias("y"), (F.greatest(*xs) - left).alias("width"), (F.greatest(*ys) - top).alias("height"))
    return F.when(reduce(Column.__and__, [c.isNotNull() for c in corners]), box)


def locator_error(locator: Column, frame: Column) -> Column:
    """Why a locator (frame, left, top, width, height, x, y) does not hold in its frame (frame, width, height, ratio); null where it does."""
    inside = closed_contains(*[locator[c] for c in ("left", "top", "width", "height", "x", "y")])
    within = rect_within((locator["left"], locator["top"], locator["left"] + locator["width"], locator["top"] + locator["height"]), (F.lit(0), F.lit(0), frame["width"], frame["height"]))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return (
        F.when(no(locator["frame"] == frame["frame"]), "frame_differs").when(no(frame["ratio"] > 0), "ratio_invalid")
        .when(no((locator["width"] > 0) & (locator["height"] > 0)), "size_invalid").when(no(within), "outside_viewport").when(no(inside), "centre_outside")
    )
