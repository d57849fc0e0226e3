"""Box geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CORNERS = ("x1", "y1", "x2", "y2")


def _corner(box: str | Column, name: str) -> Column:
    """``box`` is a column prefix ("p_"), or a struct column."""
    return F.col(f"{box}{name}") if isinstance(box, str) else box[name]


def side_x(box: str | Column = "") -> Column:
    return F.greatest(F.lit(0), _corner(box, "x2") - _corner(box, "x1"))


def side_y(box: str | Column = "") -> Column:
    return F.greatest(F.lit(0), _corner(box, "y2") - _corner(box, "y1"))


def area(box: str | Column = "") -> Column:
    return side_x(box) * side_y(box)


def intersection(a: str | Column, b: str | Column) -> Column:
    width = F.least(_corner(a, "x2"), _corner(b, "x2")) - F.greatest(_corner(a, "x1"), _corner(b, "x1"))
    height = F.least(_corner(a, "y2"), _corner(b, "y2")) - F.greatest(_corner(a, "y1"), _corner(b, "y1"))
    return F.greatest(F.lit(0), width) * F.greatest(F.lit(0), height)


def iou(a: str | Column, b: str | Column) -> Column:
    """intersection over union, 0 without overlap."""
    inter = intersection(a, b)
    return F.when(inter > 0, inter / (area(a) + area(b) - inter)).otherwise(F.lit(0.0))


def iou_floor(a: str | Column, b: str | Column) -> Column:
    """as F01, with the union held at 1 or more."""
    inter = intersection(a, b)
    union = F.greatest(F.lit(1.0), (area(a) + area(b) - inter).cast("double"))
    return F.when(inter > 0, inter / union).otherwise(F.lit(0.0))


def clamp_box(width: Column, height: Column, prefix: str = "") -> dict[str, Column]:
    """corners limited to the image (drop rows failing ``has_area`` afterwards)."""
    limits = {"x1": width, "y1": height, "x2": width, "y2": height}
    return {f"{prefix}{c}": F.least(F.greatest(F.col(f"{prefix}{c}"), F.lit(0)), limits[c]) for c in CORNERS}


def has_area(prefix: str = "") -> Column:
    return (F.col(f"{prefix}x2") > F.col(f"{prefix}x1")) & (F.col(f"{prefix}y2") > F.col(f"{prefix}y1"))


def scale_boxes(factor: float, prefix: str = "") -> dict[str, Column]:
    """scaled corners, truncated towards zero."""
    return {f"{prefix}{c}": (F.col(f"{prefix}{c}") * F.lit(float(factor))).cast("bigint") for c in CORNERS}


def box_metrics(prefix: str = "") -> dict[str, Column]:
    """sides, area, aspect (infinite for a zero height), centre, shortest and longest side."""
    width, height = side_x(prefix).cast("double"), side_y(prefix).cast("double")
    return {
        "width": width,
        "height": height,
        "area": width * height,
        "aspect_ratio": F.when(height > 0, F.try_divide(width, height)).otherwise(F.lit(float("inf"))),
        "center_x": F.col(f"{prefix}x1") + width / 2,
        "center_y": F.col(f"{prefix}y1") + height / 2,
        "min_side": F.least(width, height),
        "max_side": F.greatest(width, height),
    }


def edge_touching(margin: int | Column, width: int = 3840, height: int = 2160, prefix: str = "") -> Column:
    """any side within ``margin`` of the image border."""
    margin = margin if isinstance(margin, Column) else F.lit(margin)
    return (
        (F.col(f"{prefix}x1") <= margin)
        | (F.col(f"{prefix}y1") <= margin)
        | (F.col(f"{prefix}x2") >= F.lit(width) - margin)
        | (F.col(f"{prefix}y2") >= F.lit(height) - margin)
    )


def postfilter_drop(margin, min_side, max_score, width: int = 3840, height: int = 2160, prefix: str = "") -> Column:
    """edge-touching, big and low scored."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    shortest = F.least(side_x(prefix), side_y(prefix))
    return (
        edge_touching(margin, width, height, prefix)
        & (shortest >= lit(min_side))
        & (F.col(f"{prefix}score") <= lit(max_score))
    )


def polygon_bbox(points: Column, width: Column, height: Column) -> Column:
    """clipped bounding box of ``array<struct<x,y>>``, truncated to whole pixels."""
    xs = F.transform(points, lambda p: p["x"])
    ys = F.transform(points, lambda p: p["y"])
    return F.struct(
        F.greatest(F.lit(0), F.array_min(xs).cast("bigint")).alias("x1"),
        F.greatest(F.lit(0), F.array_min(ys).cast("bigint")).alias("y1"),
        F.least(width, F.array_max(xs).cast("bigint")).alias("x2"),
        F.least(height, F.array_max(ys).cast("bigint")).alias("y2"),
    )


def scale_label(area_fraction: Column, height_fraction: Column) -> Column:
    """four ordered scale classes."""
    # fixed values: (label, height share below, area share below)
    steps = (("very_small_or_distant", 0.065, 0.003), ("small", 0.13, 0.0085), ("medium", 0.25, 0.022))
    label = F
    for name, height_below, area_below in steps:
        label = label.when((height_fraction < height_below) | (area_fraction < area_below), F.lit(name))
    return label.otherwise(F.lit("large"))


def tile_offsets(length: Column, tile: int, overlap: int) -> Column:
    """tile starts along one axis, the last tile flush with the far edge."""
    last = F.greatest(length - F.lit(tile), F.lit(0))
    return F.array_distinct(
        F.concat(F.sequence(F.lit(0).cast("bigint"), last, F.lit(tile - overlap).cast("bigint")), F.array(last))
    )


def center_inside(inner: str, outer: str) -> Column:
    cx = (F.col(f"{inner}x1") + F.col(f"{inner}x2")) / 2
    cy = (F.col(f"{inner}y1") + F.col(f"{inner}y2")) / 2
    return cx.between(F.col(f"{outer}x1"), F.col(f"{outer}x2")) & cy.between(F.col(f"{outer}y1"), F.col(f"{outer}y2"))


def corner_or_center_inside(inner: str, outer: str) -> Column:
    """Any corner, or the centre, of ``inner`` lies in ``outer`` (borders count)."""
    in_x = lambda c: F.col(f"{inner}{c}").between(F.col(f"{outer}x1"), F.col(f"{outer}x2"))
    in_y = lambda c: F.col(f"{inner}{c}").between(F.col(f"{outer}y1"), F.col(f"{outer}y2"))
    return ((in_x("x1") | in_x("x2")) & (in_y("y1") | in_y("y2"))) | center_inside(inner, outer)
