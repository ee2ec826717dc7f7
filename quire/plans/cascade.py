"""Formats through all their layers: document defaults, table style and its regions, paragraph and character style, own.

What the styles of a document say is gathered once per document: a map from each style to its chain folded from the
base on. Runs, paragraphs and cells are then joined with that one row by doc_id and read the layers that they need, so
there is no join for each layer. A fold takes an array of layers from the lowest on; a step says how a layer changes
what is below it, as some declarations edit rather than replace: tab stops are added, moved and cleared, blank shading
is passed over, an empty list of tab stops removes all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import properties as P

Step = Callable[[Column, Column], Column]
#: Stores rows of documents under a name between two steps of a plan.
Keep = Callable[[DataFrame, str], DataFrame]
#: Font columns that are inherited, toggles apart.
TOGGLES = P.RUN_FLAGS
FONT = ("name", "size", "underline", "color", "shown_color", "superscript", "subscript", "highlight", "effect", "emphasis", "kerning", "locale", "shading")
#: Paragraph columns of which the nearest declaration counts; shading and tab_stops have rules of their own.
PARAGRAPH = tuple(c for c in P.PARAGRAPH if c not in ("shading", "tab_stops"))
# Sizes where nothing is declared, with and without document defaults, and the built-in size of Normal.
SIZE, SIZE_WITHOUT_DEFAULTS, NORMAL_SIZE = 10.0, 11.0, 12.0
REGIONS = ("band1Vert", "band2Vert", "band1Horz", "band2Horz", "firstCol", "lastCol", "firstRow", "lastRow", "nwCell", "neCell", "swCell", "seCell")


def _passed(df: DataFrame, _: str) -> DataFrame:
    return df


# ------------------------------------------------------------------------------------------------ steps and folds
def nearest(columns: tuple[str, ...]) -> Step:
    """A step in which every declared column replaces what is below."""
    return lambda below, layer: F.when(layer.isNull(), below).otherwise(F.struct(*[F.coalesce(layer[c], below[c]).alias(c) for c in columns]))


def tabs_over(below: Column, layer: Column) -> Column:
    """Tab stops with a layer's edits: each stop takes the place of one within 0.01 points, clearing ones too, and stays
    in the list as a clearing one for what may be below; an empty list replaces all, a null one changes nothing."""
    def put(held: Column, t: Column) -> Column:
        return F.concat(F.filter(held, lambda u: F.abs(u["position"] - t["position"]) > 0.01), F.array(t))

    ordered = F.concat(F.filter(layer, lambda t: t["clears"]), F.filter(layer, lambda t: ~t["clears"]))
    edited = F.aggregate(ordered, F.coalesce(below, F.filter(layer, lambda t: F.lit(False))), put)
    return F.when(layer.isNull(), below).when(F.size(layer) == 0, layer).otherwise(edited)


def standing_tabs(stops: Column) -> Column:
    """The stops that are left of edited ones, by position."""
    return F.sort_array(F.transform(F.filter(stops, lambda t: ~t["clears"]), lambda t: F.struct(t["position"].alias("position"), t["alignment"].alias("alignment"), t["leader"].alias("leader"))))


def paragraph_step(below: Column, layer: Column) -> Column:
    """Declared columns replace; shading without colours and undeclared borders do not; tab stops are edited."""
    blank = layer["shading"].isNull() | (F.coalesce(layer["shading"]["background"], F.lit("")).isin("", "auto") & layer["shading"]["foreground"].isNull())
    # an empty list resets what is below for good: it is kept in front as a mark of its own
    reset = F.coalesce(below["tabs_reset"], F.lit(False)) | F.coalesce(F.size(layer["tab_stops"]) == 0, F.lit(False))
    return F.when(layer.isNull(), below).otherwise(F.struct(
        *[F.coalesce(layer[c], below[c]).alias(c) for c in (*PARAGRAPH, "borders")], F.when(blank, below["shading"]).otherwise(layer["shading"]).alias("shading"),
        F.when(F.coalesce(layer["tabs_reset"], F.lit(False)), layer["tab_stops"]).otherwise(tabs_over(below["tab_stops"], layer["tab_stops"])).alias("tab_stops"),
        (reset | F.coalesce(layer["tabs_reset"], F.lit(False))).alias("tabs_reset")))


def fold(layers: Column, kind: str, step: Step) -> Column:
    """The layers, lowest first, as one; null ones change nothing, and without any it is null.

    The first layer is taken through the step as well, over a layer that declares nothing.
    """
    empty = F.from_json(F.lit("{}"), kind)
    return F.aggregate(layers, F.when(F.lit(False), empty).otherwise(F.lit(None)), lambda a, x: F.when(x.isNull(), a).otherwise(step(F.coalesce(a, empty), x)))


# ------------------------------------------------------------------------------------------------ layers of styles
def _regional(properties: DataFrame, prefix: str) -> DataFrame:
    """Properties of table styles' regions that stand in one of their elements, as if they were the region's own."""
    inner = F.transform_keys(F.map_filter("props", lambda k, _: k.startswith(f"{prefix}/")), lambda k, _: F.substring(k, F.lit(len(prefix) + 2), F.length(k)))
    return properties.filter("owner = 'style_region'").withColumn("props", inner)


EVERY = (*FONT, *TOGGLES)


def font_layers(properties: DataFrame, theme: DataFrame, owner: str, columns: tuple[str, ...] = EVERY) -> DataFrame:
    """(doc_id, part_name, path, ord, ident, v): the font declarations of one kind of owner; an empty highlight is none."""
    source = _regional(properties, "rPr") if owner == "style_region" else properties
    f = P.fonts(source, theme, owner)
    picked = [F.when(F.col("highlight") != S.NO_COLOR, F.col("highlight")).alias("highlight") if c == "highlight" else F.col(c) for c in columns]
    return f.select(*P.KEYS, F.struct(*picked).alias("v"))


def paragraph_layers(properties: DataFrame, owner: str) -> DataFrame:
    """(doc_id, part_name, path, ord, ident, v): the paragraph declarations of one kind of owner, borders as one."""
    source = _regional(properties, "pPr") if owner == "style_region" else properties
    f = P.paragraph_formats(source, owner).withColumn("_has", F.lit(True))
    sides = [c for c in f.columns if c.startswith("border_")]
    whole = F.when(F.coalesce(*[F.col(c) for c in sides]).isNotNull(), F.struct(*[F.col(c).alias(c.removeprefix("border_")) for c in sides])).alias("borders")
    return f.select(*P.KEYS, F.struct(*[F.col(c) for c in PARAGRAPH], whole, "shading", "tab_stops", F.lit(False).alias("tabs_reset")).alias("v"))


def kind_of(layers: DataFrame) -> str:
    return layers.schema["v"].dataType.simpleString()


def _mapped(rows: DataFrame, key: str, value: str, order: Column, name: str) -> DataFrame:
    """(doc_id, name): a map for each document; of a key that comes again the value that ``order`` puts last."""
    last = rows.filter(F.col(key).isNotNull()).groupBy("doc_id", F.col(key).alias("_k")).agg(F.max_by(value, order).alias("_v"))
    return last.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("_k", "_v"))).alias(name))


def style_maps(styles: DataFrame, layers: DataFrame, step: Step) -> DataFrame:
    """(doc_id, chains, own, folded): per document each style's chain, its own layer, and its chain folded from the base on."""
    chains = _mapped(styles, "style_id", "chain", F.col("ord"), "chains")
    own = _mapped(layers, "ident", "v", F.coalesce("ord", F.lit(0)), "own")
    both = chains.join(own, "doc_id", "left")
    folded = F.transform_values("chains", lambda _, c: fold(F.transform(F.reverse(c), lambda s: F.try_element_at("own", s)), kind_of(layers), step))
    # a row a document: a hint on the tables below does not reach past their join
    return both.withColumn("folded", folded).hint("merge")


def _defaults(styles: DataFrame) -> DataFrame:
    """(doc_id, normal, table_default): the default paragraph and table style of each document that has styles."""
    last = lambda kind: F.max_by("style_id", F.when(F.col("is_default") & (F.col("kind") == kind), F.col("ord")))
    return styles.groupBy("doc_id").agg(last("paragraph").alias("normal"), last("table").alias("table_default"))


def _document_layer(layers: DataFrame) -> DataFrame:
    """(doc_id, base): the one layer of a document's defaults."""
    return layers.groupBy("doc_id").agg(F.first("v").alias("base"))


# ------------------------------------------------------------------------------------------------ what text shows
TEXT_TOGGLES = ("caps", "smallCaps", "vanish")


def text_context(styles: DataFrame) -> DataFrame:
    """(doc_id, normal, base, folded): per document what its styles say of capitals and hiding; read from ``styles`` alone."""
    v = F.struct(*TEXT_TOGGLES)
    layers = styles.select("doc_id", F.col("style_id").alias("ident"), "ord", v.alias("v"))
    maps = style_maps(styles.filter("style_id is not null"), layers.filter("ident is not null"), nearest(TEXT_TOGGLES)).select("doc_id", "folded")
    base = styles.filter("kind = 'defaults'").groupBy("doc_id").agg(F.first(v).alias("base"))
    return _defaults(styles).join(maps, "doc_id", "left").join(base, "doc_id", "left").hint("merge")


def _toggle(name: str, own: Column, table: Column, base: Column, paragraph: Column, character: Column) -> Column:
    below = F.coalesce(table[name], base[name], F.lit(False))
    return F.coalesce(own, S.combine_toggle(below, paragraph[name], character[name]))


def paint_hidden(hidden: Column, own: Column, table: Column, base: Column, paragraph: Column, character: Column, implicit: Column) -> Column:
    """Whether a run is left out of what is shown. It differs from the property where both styles declare it: there it is
    the parity of all three; and a paragraph that names no style has no parity, its run's style decides."""
    below = F.coalesce(table["vanish"], base["vanish"], F.lit(False))
    p, c = paragraph["vanish"], character["vanish"]
    odd = (below.cast("int") + p.cast("int") + c.cast("int")) % 2 == 1
    shown = F.when(implicit, F.coalesce(c, p, below)).when(p.isNotNull() & c.isNotNull(), odd).otherwise(S.combine_toggle(below, p, c))
    # the reader keeps a painted value only where it differs, and that one is not overridden by the run itself
    inherited = S.combine_toggle(below, p, c)
    return F.when(shown != inherited, shown).otherwise(hidden)


def shown_text(runs: DataFrame, context: DataFrame) -> DataFrame:
    """runs (of ``visible``) with resolved ``vanish``, ``caps`` and ``smallCaps``, ``left_out``, and ``text`` in capitals
    where either kind of capitals holds."""
    find = lambda key: F.try_element_at("folded", key)
    # the styles are looked up once, as columns: each is used in many places, and the plan's code grows too large to be compiled
    at = runs.join(context, "doc_id", "left").withColumns({"_table": find(F.col("table_style")), "_paragraph": find(F.coalesce("paragraph_style", "normal")), "_character": find(F.col("char_style"))}).drop("folded")
    implicit = F.col("paragraph_style").isNull()
    table, paragraph, character = F.col("_table"), F.col("_paragraph"), F.col("_character")
    made = {t: _toggle(t, F.col(t), table, F.col("base"), paragraph, character) for t in TEXT_TOGGLES}
    at = at.withColumns({f"_{t}": c for t, c in made.items()} | {"left_out": paint_hidden(made["vanish"], F.col("vanish"), table, F.col("base"), paragraph, character, implicit)})
    return at.select(*[c for c in runs.columns if c not in ("text", *TEXT_TOGGLES)], S.apply_caps(F.col("text"), F.col("_caps") | F.col("_smallCaps")).alias("text"), *[F.col(f"_{t}").alias(t) for t in TEXT_TOGGLES], "left_out")


# ------------------------------------------------------------------------------------------------ fonts of runs
def font_context(properties: DataFrame, theme: DataFrame, styles: DataFrame, columns: tuple[str, ...] = EVERY) -> DataFrame:
    """Per document: normal, table_default, base, has_base, folded (fonts of styles), own (their own layers), plain (which styles are Normal)."""
    maps = style_maps(styles.filter("style_id is not null"), font_layers(properties, theme, "style_run", columns), nearest(columns)).select("doc_id", "folded", "own", "chains")
    base = _document_layer(font_layers(properties, theme, "default_run", columns))
    has = styles.filter("kind = 'defaults'").select("doc_id", F.lit(True).alias("has_base")).distinct()
    plain = P.style_records(styles).filter("is_normal").groupBy("doc_id").agg(F.collect_set("style_id").alias("plain"))
    out = _defaults(styles)
    for part in (maps, base, has, plain):
        out = out.join(part, "doc_id", "left")
    return out.hint("merge")


def table_size_override(properties: DataFrame) -> DataFrame:
    """(doc_id, override, mode): whether the settings let table styles override Normal's size (null if they do not say:
    the first such setting counts, and only 0 says no), and the compatibility mode."""
    names = F.filter(F.map_keys("props"), lambda k: k.rlike(r"^compat/compatSetting(#\d+)?@name$"))
    place = lambda k: F.coalesce(F.regexp_extract(k, r"#(\d+)@", 1).try_cast("int"), F.lit(0))
    at = lambda k, a: F.try_element_at("props", F.regexp_replace(k, "@name$", f"@{a}"))
    rows = F.sort_array(F.transform(names, lambda k: F.struct(place(k).alias("n"), F.try_element_at("props", k).alias("name"), at(k, "uri").alias("uri"), F.coalesce(at(k, "val"), F.lit("")).alias("val"))))
    first = lambda name: F.get(F.filter(rows, lambda s: (s["name"] == name) & (s["uri"] == "http://schemas.microsoft.com/office/word")), F.lit(0))["val"]
    s = properties.filter("owner = 'settings'")
    return s.select("doc_id", (first("overrideTableStyleFontSizeAndJustification") != "0").alias("override"), first("compatibilityMode").try_cast("int").alias("mode"))


def run_fonts(inlines: DataFrame, properties: DataFrame, theme: DataFrame, styles: DataFrame, cell_sizes: DataFrame | None = None, columns: tuple[str, ...] = EVERY, keep: Keep = _passed) -> DataFrame:
    """Every run with its font properties, all or those in ``columns``: own, then its character style, paragraph style, table style, defaults.

    Toggles that both the paragraph's and the run's style declare are their difference. ``left_out`` is whether it is
    hidden from view, ``vanish`` what the property says. ``size`` follows the rule of tables: what a cell's regions say
    (cell_sizes: doc_id, table_path, row, cell, cell_size, paint_size) stands under the paragraph's style, but where
    that style is the built-in Normal at 12 points and the settings do not say otherwise, the table's own size counts;
    ``paint_size`` is the size that is shown.
    """
    wanted = tuple(dict.fromkeys((*columns, "vanish")))
    own = font_layers(properties, theme, "run", wanted).select("doc_id", "part_name", F.col("path").alias("block_path"), "ord", F.col("v").alias("direct"))
    keys = ["doc_id", "part_name", "block_path", "ord"]
    at = inlines.filter("kind = 'Run'").select(*keys, "text", "rid", "anchor", "char_style", "paragraph_style", "table_style").join(own, keys, "left")
    if cell_sizes is not None:
        n = F.size("block_path")
        at = at.withColumn("table_path", F.when(n >= 4, F.slice("block_path", F.lit(1), F.greatest(n - 3, F.lit(1))))).withColumn("row", F.when(n >= 4, F.try_element_at("block_path", n - 2))).withColumn("cell", F.when(n >= 4, F.try_element_at("block_path", n - 1)))
        at = at.join(cell_sizes.hint("merge"), ["doc_id", "table_path", "row", "cell"], "left")
    else:
        at = at.withColumn("cell_size", F.lit(None).cast("double")).withColumn("paint_cell_size", F.lit(None).cast("double"))
    at = at.join(keep(font_context(properties, theme, styles, wanted), "fonts"), "doc_id", "left")
    find = lambda key: F.try_element_at("folded", key)
    implicit, named = F.col("paragraph_style").isNull(), F.coalesce("paragraph_style", "normal")
    at = at.withColumns({"_t": find(F.col("table_style")), "_p": find(named), "_c": find(F.col("char_style")), "_named": named})
    t, p, c, base, direct = (F.col(x) for x in ("_t", "_p", "_c", "base", "direct"))
    out = {x: F.coalesce(direct[x], c[x], p[x], t[x], base[x]) for x in wanted if x in FONT and x != "size"}
    out |= {x: _toggle(x, direct[x], t, base, p, c) for x in wanted if x in TOGGLES}
    out["left_out"] = paint_hidden(out["vanish"], direct["vanish"], t, base, p, c, implicit)
    if "size" in wanted:
        at = at.join(table_size_override(properties), "doc_id", "left")
        out |= _sizes(direct, c, p, t, base)
    return at.select(*keys, "text", "rid", "anchor", *[v.alias(k) for k, v in out.items()])


def _sizes(direct: Column, c: Column, p: Column, t: Column, base: Column) -> dict[str, Column]:
    """size and paint_size, over the columns of run_fonts."""
    default = F.coalesce(base["size"], F.when(F.col("has_base"), SIZE).otherwise(SIZE_WITHOUT_DEFAULTS))
    table_styled = F.try_element_at("chains", F.col("table_style")).isNotNull()
    whole = F.coalesce(t["size"], default)
    under = F.coalesce("cell_size", t["size"], default)
    built_in = F.coalesce(F.array_contains("plain", F.col("_named")), F.lit(False)) & (F.try_element_at("own", F.col("_named"))["size"] == NORMAL_SIZE)
    sentinel = F.coalesce(table_styled & ~F.coalesce("override", F.lit(False)) & built_in, F.lit(False))
    of_table = F.when(whole == SIZE, NORMAL_SIZE).otherwise(whole)
    size = F.coalesce(direct["size"], c["size"], F.when(sentinel, of_table).otherwise(F.coalesce(p["size"], under)))
    # what is shown passes over a Normal of 12 points anywhere in the chain
    paints = F.coalesce("override", F.col("mode").isin(11, 15), F.lit(False))
    steps = F.transform(F.coalesce(F.try_element_at("chains", F.col("_named")), F.array().cast("array<string>")), lambda s: F.struct(F.array_contains("plain", s).alias("n"), F.try_element_at("own", s)["size"].alias("s")))
    kept = F.filter(steps, lambda s: s["s"].isNotNull() & ~(table_styled & ~paints & F.coalesce(s["n"], F.lit(False)) & (s["s"] == NORMAL_SIZE)))
    painted = F.coalesce(direct["size"], c["size"], F.get(kept, F.lit(0))["s"], "paint_cell_size", t["size"], default)
    return {"size": size, "paint_size": F.when(painted == 0, 0.5).otherwise(painted)}


# ------------------------------------------------------------------------------------------------ paragraphs
def paragraph_formats(blocks: DataFrame, properties: DataFrame, styles: DataFrame) -> DataFrame:
    """Every paragraph of the main story with what the defaults, its table's style, its style and itself declare.

    Tab stops are merged layer by layer, blank shading is passed over, borders are taken whole.
    """
    layers = paragraph_layers(properties, "style_paragraph")
    kind = kind_of(layers)
    maps = style_maps(styles.filter("style_id is not null"), layers, paragraph_step).select("doc_id", "folded")
    direct = paragraph_layers(properties, "paragraph").select("doc_id", "part_name", "path", F.col("v").alias("direct"))
    base = _document_layer(paragraph_layers(properties, "default_paragraph"))
    at = blocks.filter("node_type = 'Paragraph'").select("doc_id", "part_name", "path", "style_id", "table_style").join(direct, ["doc_id", "part_name", "path"], "left")
    for part in (_defaults(styles), maps, base):
        at = at.join(part, "doc_id", "left")
    at = at.withColumn("style_id", F.coalesce("style_id", "normal"))
    find = lambda key: F.try_element_at("folded", key)
    at = at.withColumn("v", fold(F.array("base", find(F.col("table_style")), find(F.col("style_id")), "direct"), kind, paragraph_step))
    return at.select("doc_id", "part_name", "path", "style_id", *[F.col(f"v.{c}").alias(c) for c in (*PARAGRAPH, "shading", "borders")], F.coalesce(standing_tabs(F.col("v.tab_stops")), F.array().cast("array<struct<position: double, alignment: int, leader: int>>")).alias("tab_stops"))


# ------------------------------------------------------------------------------------------------ regions of tables
def table_frames(blocks: DataFrame, properties: DataFrame, styles: DataFrame) -> DataFrame:
    """Tables of the main story with their style (named, else the default one), look, band sizes and the regions that the
    style's chain declares. A look is the table's own, else the nearest of the chain, else none."""
    look = S.table_look(P._get("tblLook@val"), {a: P._get(f"tblLook@{a}") for a in ("firstRow", "lastRow", "firstColumn", "lastColumn", "noHBand", "noVBand")})
    own_look = F.when(P._get("tblLook").isNotNull(), look)
    size = lambda key: F.when(P._get(key).isNotNull(), F.coalesce(P._get(key).try_cast("int"), F.lit(1)))
    declared = properties.filter("owner = 'style_table'").select("doc_id", "ident", "ord", own_look.alias("look"), size("tblStyleRowBandSize").alias("rows"), size("tblStyleColBandSize").alias("columns"))
    split = F.split(F.col("ident"), ":", 2)
    regions = properties.filter("owner = 'style_region'").groupBy("doc_id", split[0].alias("ident")).agg(F.collect_set(split[1]).alias("regions"))
    both = declared.join(regions, ["doc_id", "ident"], "full").select("doc_id", "ident", "ord", F.struct("look", "rows", "columns", "regions").alias("v"))

    def step(below: Column, layer: Column) -> Column:
        kinds = F.array_distinct(F.concat(F.coalesce(below["regions"], F.array().cast("array<string>")), F.coalesce(layer["regions"], F.array().cast("array<string>"))))
        return F.struct(*[F.coalesce(layer[c], below[c]).alias(c) for c in ("look", "rows", "columns")], kinds.alias("regions"))

    maps = style_maps(styles.filter("style_id is not null"), both, step).select("doc_id", "folded")
    own = properties.filter("owner = 'table'").select("doc_id", "part_name", "path", own_look.alias("own_look"))
    at = blocks.filter("node_type = 'Table'").select("doc_id", "part_name", "path", "table_style").join(own, ["doc_id", "part_name", "path"], "left")
    at = at.join(_defaults(styles), "doc_id", "left").join(maps, "doc_id", "left").withColumn("style_id", F.coalesce("table_style", "table_default"))
    v = F.try_element_at("folded", F.col("style_id"))
    none = F.struct(*[F.lit(False).alias(n) for n in ("first_row", "last_row", "first_column", "last_column", "row_bands", "column_bands")])
    return at.select("doc_id", F.col("path").alias("table_path"), "style_id", F.coalesce("own_look", v["look"], none).alias("look"), v["rows"].alias("row_band"), v["columns"].alias("column_band"), F.coalesce(v["regions"], F.array().cast("array<string>")).alias("declared")).hint("merge")


def cell_regions(cells: DataFrame, frames: DataFrame, counting: str = "cells") -> DataFrame:
    """cells with style_id and regions: the regions of the table's style that each is in, in the order they are applied.

    counting ``cells`` numbers the cells of a row as they stand; ``size`` does too, by the rule of the size property:
    columns at the edge keep their band, and a header shifts the bands only if the style declares it; ``grid`` numbers
    the columns of the grid, spans included, and is what is painted: bands whose size is not declared are left out, and
    column bands win over row bands where theirs is.
    """
    if counting not in ("cells", "size", "grid"):
        raise ValueError(counting)
    whole, line = Window.partitionBy("doc_id", "table_path"), Window.partitionBy("doc_id", "table_path", "row")
    at = cells.select("doc_id", "table_path", "row", "cell", "grid_span").withColumn("_rows", F.max("row").over(whole) + 1)
    if counting == "grid":
        at = at.withColumn("_column", F.coalesce(F.sum("grid_span").over(line.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")).withColumn("_span", F.col("grid_span"))
        at = at.withColumn("_columns", F.max(F.col("_column") + F.col("_span")).over(whole))
    else:
        at = at.withColumn("_column", F.col("cell")).withColumn("_span", F.lit(1)).withColumn("_columns", F.max("cell").over(line) + 1)
    at = at.join(frames, ["doc_id", "table_path"], "left")
    on = lambda name: F.coalesce(F.col(f"look.{name}"), F.lit(False))
    first_row, last_row = on("first_row") & (F.col("row") == 0), on("last_row") & (F.col("row") == F.col("_rows") - 1)
    first_column, last_column = on("first_column") & (F.col("_column") == 0), on("last_column") & (F.col("_column") + F.col("_span") == F.col("_columns"))

    def band(place: Column, header: Column, size: Column, region: str) -> Column:
        size = F.coalesce(size, F.lit(1))
        if counting == "size":
            header = header & F.array_contains("declared", region)
        shifted = place - header.cast("int")
        group = F.floor((shifted + 1) / size) - 1 if counting != "grid" else F.floor(shifted / size)
        return F.pmod(group, F.lit(2)) == 1

    second_column = band(F.col("_column"), on("first_column"), F.col("column_band"), "firstCol")
    second_row = band(F.col("row"), on("first_row"), F.col("row_band"), "firstRow")
    in_columns, in_rows = on("column_bands"), on("row_bands") & ~last_row
    if counting != "size":
        in_columns, in_rows = in_columns & ~(first_column | last_column), in_rows & ~first_row
    vertical = F.when(in_columns, F.when(second_column, "band2Vert").otherwise("band1Vert"))
    horizontal = F.when(in_rows, F.when(second_row, "band2Horz").otherwise("band1Horz"))
    bands = F.array(vertical, horizontal)
    if counting == "grid":
        shown = F.array(F.when(F.col("column_band").isNotNull(), vertical), F.when(F.col("row_band").isNotNull(), horizontal))
        bands = F.when(F.col("column_band").isNotNull(), F.reverse(shown)).otherwise(shown)
    edges = [("firstCol", first_column), ("lastCol", last_column), ("firstRow", first_row), ("lastRow", last_row)]
    corners = [("nwCell", first_row & first_column), ("neCell", first_row & last_column), ("swCell", last_row & first_column), ("seCell", last_row & last_column)]
    regions = F.array_compact(F.concat(bands, F.array(*[F.when(c, n) for n, c in (*edges, *corners)])))
    return at.select("doc_id", "table_path", "row", "cell", "style_id", regions.alias("regions"))


def region_formats(regions: DataFrame, layers: DataFrame, region_layers: DataFrame, styles: DataFrame, step: Step, painted: bool = False, keep: Keep = _passed) -> DataFrame:
    """regions (of ``cell_regions``) with v: the table style's layers folded for each cell.

    From the base of the chain on, each style's whole-table layer comes first and then its regions in their order; what
    is painted takes all whole-table layers first, then each region through the chain. Of a region that a style declares
    twice the first counts. Cells are few kinds: the fold runs once for each style and list of regions of a document.
    """
    maps = keep(style_maps(styles.filter("style_id is not null"), layers, step).select("doc_id", "chains", "own"), "chains")
    first = keep(_mapped(region_layers, "ident", "v", -F.coalesce("ord", F.lit(0)), "regional"), "regional")
    kinds = regions.filter("style_id is not null").select("doc_id", "style_id", "regions").distinct().join(maps, "doc_id").join(first, "doc_id", "left")
    chain = F.reverse(F.try_element_at("chains", F.col("style_id")))
    whole = lambda s: F.try_element_at("own", s)
    at = lambda s, k: F.try_element_at("regional", F.concat(s, F.lit(":"), k))
    if painted:
        stack = F.concat(F.transform(chain, whole), F.flatten(F.transform("regions", lambda k: F.transform(chain, lambda s: at(s, k)))))
    else:
        stack = F.flatten(F.transform(chain, lambda s: F.concat(F.array(whole(s)), F.transform("regions", lambda k: at(s, k)))))
    folded = kinds.select("doc_id", "style_id", "regions", fold(stack, kind_of(layers), step).alias("v"))
    return regions.join(folded.hint("merge"), ["doc_id", "style_id", "regions"], "left")


CELL = ("doc_id", "table_path", "row", "cell")


def cell_fonts(cells: DataFrame, blocks: DataFrame, properties: DataFrame, theme: DataFrame, styles: DataFrame, counting: str = "cells", columns: tuple[str, ...] = EVERY, keep: Keep = _passed) -> DataFrame:
    """Cells with the font that their table's style gives them; ``counting`` as in cell_regions, ``grid`` is what is painted."""
    regions = keep(cell_regions(cells, keep(table_frames(blocks, properties, styles), "frames"), counting), "regions")
    out = region_formats(regions, font_layers(properties, theme, "style_run", columns), font_layers(properties, theme, "style_region", columns), styles, nearest(columns), counting == "grid", keep)
    return out.select(*CELL, "style_id", "regions", *[F.col(f"v.{c}").alias(c) for c in columns])


def cell_paragraph_formats(cells: DataFrame, blocks: DataFrame, properties: DataFrame, styles: DataFrame, counting: str = "cells") -> DataFrame:
    """Cells with the paragraph format that their table's style gives them."""
    regions = cell_regions(cells, table_frames(blocks, properties, styles), counting)
    out = region_formats(regions, paragraph_layers(properties, "style_paragraph"), paragraph_layers(properties, "style_region"), styles, paragraph_step, counting == "grid")
    return out.select(*CELL, "style_id", "regions", *[F.col(f"v.{c}").alias(c) for c in (*PARAGRAPH, "shading", "borders")], standing_tabs(F.col("v.tab_stops")).alias("tab_stops"))


def cell_sizes(cells: DataFrame, blocks: DataFrame, properties: DataFrame, theme: DataFrame, styles: DataFrame, keep: Keep = _passed) -> DataFrame:
    """(doc_id, table_path, row, cell, cell_size, paint_cell_size): the size by the property's rule, and as it is painted."""
    frames = keep(table_frames(blocks, properties, styles), "frames")
    own, regional = (font_layers(properties, theme, owner, ("size",)) for owner in ("style_run", "style_region"))
    both = cell_regions(cells, frames, "size").withColumnRenamed("regions", "as_property").join(cell_regions(cells, frames, "grid").select(*CELL, F.col("regions").alias("painted")).hint("merge"), [*CELL])
    both = keep(both, "regions")
    # the two lists of a cell are carried as one, so that one pass folds both
    kinds = both.select("doc_id", "style_id", "as_property", "painted").distinct()
    sized = region_formats(kinds.withColumn("regions", F.col("as_property")), own, regional, styles, nearest(("size",)), keep=keep).select("doc_id", "style_id", "as_property", "painted", F.col("v.size").alias("cell_size"))
    sized = keep(sized, "sizes")
    sized = region_formats(sized.withColumn("regions", F.col("painted")), own, regional, styles, nearest(("size",)), True, keep).select("doc_id", "style_id", "as_property", "painted", "cell_size", F.col("v.size").alias("paint_cell_size"))
    return both.join(sized.hint("merge"), ["doc_id", "style_id", "as_property", "painted"], "left").select(*CELL, "cell_size", "paint_cell_size")
