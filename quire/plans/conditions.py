"""Geometry of shapes: where those of anchored drawings and of groups stand on the page."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def group_transform(shapes: DataFrame) -> DataFrame:
    """(doc_id, shape_id, x, y, scale_x, scale_y) of shapes on the page, through all groups they are in.

    shapes: doc_id, shape_id, parent_id (null at the top), x, y, and for groups child_x, child_y, scale_x, scale_y: a
    child stands at its group's place plus its own offset in the group's coordinates, scaled by all groups above it.
    """
    def place(table: pa.Table) -> pa.Table:
        rows = {r["shape_id"]: r for r in table.to_pylist()}
        done: dict[str, tuple[float, float, float, float]] = {}

        def of(ident: str, above: tuple[str, ...] = ()) -> tuple[float, float, float, float] | None:
            if ident not in done:
                r = rows[ident]
                own = (r["scale_x"] if r["scale_x"] is not None else 1.0, r["scale_y"] if r["scale_y"] is not None else 1.0)
                if r["parent_id"] is None:
                    done[ident] = (r["x"], r["y"], *own)
                elif r["parent_id"] in rows and ident not in above:
                    up = of(r["parent_id"], (*above, ident))
                    if up is None:
                        return None
                    g = rows[r["parent_id"]]
                    done[ident] = (up[0] + (r["x"] - (g["child_x"] or 0)) * up[2], up[1] + (r["y"] - (g["child_y"] or 0)) * up[3], up[2] * own[0], up[3] * own[1])
                else:
                    return None  # a group that is missing, or within itself
            return done[ident]

        placed = [(rows[i]["doc_id"], i, *x) for i in rows if (x := of(i)) is not None]
        kinds = (pa.int64(), pa.string(), *[pa.float64()] * 4)
        return pa.table([pa.array([r[k] for r in placed], t) for k, t in enumerate(kinds)], ["doc_id", "shape_id", "x", "y", "scale_x", "scale_y"])

    numbers = [F.col(c).cast("double").alias(c) for c in ("x", "y", "child_x", "child_y", "scale_x", "scale_y")]
    slim = shapes.select("doc_id", F.col("shape_id").cast("string").alias("shape_id"), F.col("parent_id").cast("string").alias("parent_id"), *numbers)
    return slim.groupBy("doc_id").applyInArrow(place, "doc_id long, shape_id string, x double, y double, scale_x double, scale_y double")


# Points of margins where a section declares none.
MARGIN = 72.0


def page_places(shapes: DataFrame, page_setups: DataFrame) -> DataFrame:
    """(doc_id, part_name, block_path, ord, shape, x, y, width, height, fill, text): shapes on the page, in points.

    shapes is the table ``placed_shapes``. An anchor's offset is from the page, or from the first section's margins; in a
    header or footer what is from a paragraph or margin is from their distance. Down the groups around a shape scales
    multiply, and each inner group is moved by its place in the scale of the groups around the one that holds it.
    """
    first = page_setups.filter("section = 0").select("doc_id", *[F.coalesce(f"margin_{m}", F.lit(MARGIN)).alias(m) for m in ("left", "top")], F.nullif("margin_header", F.lit(0.0)).alias("head"), F.nullif("margin_footer", F.lit(0.0)).alias("foot"), "page_height")
    at = shapes.join(first, "doc_id", "left").withColumns({m: F.coalesce(m, F.lit(MARGIN)) for m in ("left", "top")})
    base = F.when(F.col("role") == "header", F.coalesce("head", F.col("top") / 2)).when(F.col("role") == "footer", F.col("page_height") - F.coalesce("foot", F.col("top") / 2)).otherwise(F.col("top"))
    origin_x = F.col("anchor_x") + F.when(F.col("horizontal_from").isin("margin", "column", "leftMargin", "character"), F.col("left")).otherwise(0.0)
    origin_y = F.col("anchor_y") + F.when(F.col("vertical_from").isin("margin", "paragraph", "line", "topMargin"), base).otherwise(0.0)

    def axis(origin: Column, off: str, ratio: str) -> Column:
        """(at, scale): where the innermost group begins, and the scale inside it."""
        start = F.struct(origin.alias("at"), F.lit(1.0).alias("outer"), F.lit(1.0).alias("scale"))
        return F.aggregate(F.sequence(F.lit(0), F.col("depth") - 1), start, lambda s, i: F.struct(
            # the outermost group stands where the anchor does
            F.when(i == 0, s["at"]).otherwise(s["at"] + F.get(off, i) * s["outer"]).alias("at"), s["scale"].alias("outer"), (s["scale"] * F.get(ratio, i)).alias("scale")))

    def placed(origin: Column, off: str, ratio: str, child: str, own: str, size: str) -> tuple[Column, Column]:
        a = axis(origin, off, ratio)
        inside = F.col("depth") > 0
        return F.when(inside, a["at"] + (F.col(own) - F.col(child)) * a["scale"]).otherwise(origin), F.when(inside, F.col(size) * a["scale"]).otherwise(F.col(size))

    x, width = placed(origin_x, "off_x", "ratio_x", "child_x", "x", "width")
    y, height = placed(origin_y, "off_y", "ratio_y", "child_y", "y", "height")
    return at.select("doc_id", "part_name", "block_path", "ord", "shape", x.alias("x"), y.alias("y"), width.alias("width"), height.alias("height"), "fill", "text")
