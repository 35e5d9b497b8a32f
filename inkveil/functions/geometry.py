"""Boxes and quadrilaterals as Column expressions; everything stays inside Spark's codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COORDS = ("x1", "y1", "x2", "y2")


def rect(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Axis-aligned polygon array<array<int>>, clockwise from top left."""
    point = lambda x, y: F.array(x.cast("int"), y.cast("int"))
    return F.array(point(x1, y1), point(x2, y1), point(x2, y2), point(x1, y2))


def box_columns(polygon: Column) -> list[Column]:
    """x1, y1, x2, y2 of a polygon's axis-aligned box."""
    axis = lambda k: F.transform(polygon, lambda p: p[k])
    return [F.array_min(axis(0)).alias("x1"), F.array_min(axis(1)).alias("y1"), F.array_max(axis(0)).alias("x2"), F.array_max(axis(1)).alias("y2")]


def well_formed(bbox: Column) -> Column:
    """At least four points with two coordinates each."""
    return F.coalesce((F.size(bbox) >= 4) & F.forall(bbox, lambda p: F.size(p) >= 2), F.lit(False))


def value_position(text: Column, value: Column) -> Column:
    """0-based place of a value in a text; else its place with blanks ignored on both sides; else -1."""
    plain = F.instr(text, value) - 1
    squeezed = F.instr(F.replace(text, F.lit(" "), F.lit("")), F.replace(value, F.lit(" "), F.lit(""))) - 1
    solid = F.filter(F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0))), lambda i: F.substr(text, i + 1, F.lit(1)) != " ")
    return F.when(plain >= 0, plain).when((squeezed >= 0) & (F.length(text) > 0), F.coalesce(F.get(solid, squeezed), F.lit(-1))).otherwise(F.lit(-1))


def value_polygon(bbox: Column, text: Column, value: Column, padding: int = 2, prefix_miss: Column | int = 0) -> Column:
    """The part of a line's quadrilateral that a value covers, by its character positions.

    Corners move outward from the part's centre by max(padding, 15 % of the line's
    height). A value that isn't found, or is the whole line, takes the whole line;
    prefix_miss characters widen it to the left. A box without four proper points counts
    as its axis-aligned box. Coordinates are cut off, not rounded.
    """
    x1, y1, x2, y2 = box_columns(bbox)
    quad = F.when(well_formed(bbox), F.transform(F.slice(bbox, 1, 4), lambda p: F.transform(p, lambda c: c.cast("double")))).otherwise(F.transform(rect(x1, y1, x2, y2), lambda p: F.transform(p, lambda c: c.cast("double"))))
    pad = F.greatest(F.lit(padding), (F.greatest(y2 - y1, F.lit(1)).cast("double") * F.lit(0.15).cast("double")).cast("int")).cast("double")
    position = value_position(text, value)
    total = F.greatest(F.length(text), F.lit(1)).cast("double")
    miss = prefix_miss if isinstance(prefix_miss, Column) else F.lit(prefix_miss)

    def part(v: Column) -> Column:
        q, start, end = v["quad"], v["start"], v["end"]
        along = lambda a, b, r: F.array(q[a][0] + (q[b][0] - q[a][0]) * r, q[a][1] + (q[b][1] - q[a][1]) * r)
        return F.struct(F.array(along(0, 1, start), along(0, 1, end), along(3, 2, end), along(3, 2, start)).alias("part"), v["pad"].alias("pad"))

    def centred(v: Column) -> Column:
        p = v["part"]
        mean = lambda k: (p[0][k] + p[1][k] + p[2][k] + p[3][k]) / 4
        return F.struct(p.alias("part"), v["pad"].alias("pad"), mean(0).alias("x"), mean(1).alias("y"))

    def grown(v: Column) -> Column:
        away = lambda point: F.struct(point.alias("at"), (point[0] - v["x"]).alias("dx"), (point[1] - v["y"]).alias("dy"))
        norm = lambda m: F.struct(m["at"].alias("at"), m["dx"].alias("dx"), m["dy"].alias("dy"), F.sqrt(m["dx"] * m["dx"] + m["dy"] * m["dy"]).alias("norm"))

        def move(m: Column) -> Column:
            safe = F.when(m["norm"] > 0, m["norm"]).otherwise(F.lit(1.0))
            return F.array((m["at"][0] + m["dx"] / safe * v["pad"]).cast("int"), (m["at"][1] + m["dy"] / safe * v["pad"]).cast("int"))

        return F.transform(F.transform(F.transform(v["part"], away), norm), move)

    whole = lambda p: (p < 0) | ((p == 0) & (F.length(value) >= total))
    start = lambda p: F.when(whole(p), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), p / total - miss * (F.lit(1.0) / total)))
    end = lambda p: F.when(whole(p), F.lit(1.0)).otherwise((p + F.length(value)) / total)
    # one-element arrays bind what is used more than once
    bound = F.transform(F.array(position), lambda p: F.struct(quad.alias("quad"), start(p).alias("start"), end(p).alias("end"), pad.alias("pad")))
    return F.transform(F.transform(F.transform(bound, part), centred), grown)[0]


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two structs with x1, y1, x2, y2; 0 unless they overlap properly."""
    long = lambda c: c.cast("long")
    w = F.least(long(a["x2"]), long(b["x2"])) - F.greatest(long(a["x1"]), long(b["x1"]))
    h = F.least(long(a["y2"]), long(b["y2"])) - F.greatest(long(a["y1"]), long(b["y1"]))
    area = lambda r: (long(r["x2"]) - long(r["x1"])) * (long(r["y2"]) - long(r["y1"]))
    union = area(a) + area(b) - w * h
    return F.when((w > 0) & (h > 0) & (union > 0), (w * h).cast("double") / union.cast("double")).otherwise(F.lit(0.0))
