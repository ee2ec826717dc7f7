"""What declarations say: paragraph, font, section, table, row and cell formats as columns over the property sets.

Every function takes the ``properties`` table and projects one kind of owner; a property that is not declared is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

KEYS = ("doc_id", "part_name", "path", "ord", "ident")

# The codes of tokens.
ALIGNMENT = {"left": 0, "start": 0, "center": 1, "right": 2, "end": 2, "both": 3, "distribute": 4}
LINE_RULE = {"atLeast": 0, "exact": 1, "exactly": 1, "auto": 2}
BASELINE = {"auto": 0, "top": 1, "center": 2, "baseline": 3, "bottom": 4}
UNDERLINE = {"none": 0, "single": 1, "words": 2, "double": 3, "dotted": 4, "thick": 6, "dash": 7, "dotDash": 9, "dotDotDash": 10, "wavy": 11}
EFFECT = {"none": 0, "lights": 1, "blinkBackground": 2, "sparkle": 3, "antsBlack": 4, "antsRed": 5, "shimmer": 6}
EMPHASIS = {"none": 0, "dot": 1, "comma": 2, "circle": 3, "underDot": 4}
DROP_CAP = {"none": 0, "drop": 1, "margin": 2}
SECTION_START = {"continuous": 0, "newColumn": 1, "newPage": 2, "nextPage": 2, "evenPage": 3, "oddPage": 4}
TAB_ALIGNMENT = {"left": 0, "center": 1, "right": 2, "decimal": 3, "bar": 4, "list": 5, "num": 5, "clear": 6}
TAB_LEADER = {"none": 0, "dot": 1, "hyphen": 2, "underscore": 3, "heavy": 4, "middleDot": 5}
VERTICAL = {"top": 0, "center": 1, "bottom": 2}
DIRECTION = {"btLr": 1, "tbRl": 2, "lrTbV": 3, "tbRlV": 4, "tbLrV": 5}
LINE_STYLE = {
    "none": 0, "nil": 0, "single": 1, "thick": 2, "double": 3, "hairline": 5, "dotted": 6, "dashed": 7, "dotDash": 8, "dotDotDash": 9, "triple": 10,
    "thinThickSmallGap": 11, "thickThinSmallGap": 12, "thinThickThinSmallGap": 13, "thinThickMediumGap": 14, "thickThinMediumGap": 15, "thinThickThinMediumGap": 16,
    "thinThickLargeGap": 17, "thickThinLargeGap": 18, "thinThickThinLargeGap": 19, "wave": 20, "doubleWave": 21, "dashSmallGap": 22, "dashDotStroked": 23,
    "threeDEmboss": 24, "threeDEngrave": 25, "outset": 26, "inset": 27}
HIGHLIGHT = {
    "yellow": "FFFF00", "green": "00FF00", "cyan": "00FFFF", "magenta": "FF00FF", "blue": "0000FF", "red": "FF0000", "darkBlue": "000080", "darkCyan": "008080",
    "darkGreen": "008000", "darkMagenta": "800080", "darkRed": "800000", "darkYellow": "808000", "darkGray": "808080", "lightGray": "C0C0C0", "black": "000000", "white": "FFFFFF"}
FRAME = {
    "hRule": {"atLeast": 0, "exact": 1, "auto": 2}, "xAlign": {"left": 1, "center": 2, "right": 3, "inside": 4, "outside": 5},
    "yAlign": {"inline": -1, "top": 1, "center": 2, "bottom": 3, "inside": 4, "outside": 5}, "hAnchor": {"margin": 0, "page": 1, "text": 3},
    "vAnchor": {"margin": 0, "page": 1, "text": 2}, "wrap": {"notBeside": 1, "around": 2, "auto": 2, "none": 3, "tight": 4, "through": 5}}
PARAGRAPH_FLAGS = ("keepNext", "keepLines", "widowControl", "suppressAutoHyphens", "suppressLineNumbers", "snapToGrid", "autoSpaceDE", "autoSpaceDN", "adjustRightInd", "pageBreakBefore", "contextualSpacing")
RUN_FLAGS = ("b", "bCs", "i", "iCs", "strike", "caps", "smallCaps", "vanish", "emboss", "imprint", "outline", "shadow", "noProof")
BORDERS = {"bottom": "bottom", "left": "left", "start": "left", "right": "right", "end": "right", "top": "top", "insideH": "horizontal", "between": "horizontal", "insideV": "vertical", "tl2br": "down", "tr2bl": "up"}
# Paper sizes in twips that a section has unless it says otherwise, and built-in note options.
LETTER = (12240, 15840)
NOTE_STYLE, NOTE_PLACE = {"footnote": "decimal", "endnote": "lowerRoman"}, {"footnote": "pageBottom", "endnote": "docEnd"}


def _get(key: str) -> Column:
    return F.try_element_at("props", F.lit(key))


def _first(*keys: str) -> Column:
    return F.coalesce(*map(_get, keys))


def _points(key: str) -> Column:
    return S.twips_to_points(_get(key))


def _own(properties: DataFrame, owner: str) -> DataFrame:
    return properties.filter(F.col("owner") == owner)


def _border_at(props: Column, key: Column) -> Column:
    at = lambda more: F.try_element_at(props, F.concat(key, F.lit(more)))
    value = F.coalesce(F.nullif(at(""), F.lit("")), F.lit("none"))
    return F.struct(
        S.codes(value, LINE_STYLE).alias("line_style"), (at("@sz").try_cast("int") / 8.0).alias("width"), S.color_name(F.coalesce(at("@color"), F.lit(""))).alias("color"),
        at("@space").try_cast("double").alias("distance"), F.coalesce(~at("@shadow").isin("", "0", "false"), F.lit(False)).alias("shadow"), (~value.isin("none", "nil")).alias("visible"))


def border(prefix: str) -> Column:
    """(line_style, width, color, distance, shadow, visible) of one side; null if it is not declared."""
    return F.when(_get(prefix).isNotNull(), _border_at(F.col("props"), F.lit(prefix)))


def borders(prefix: str) -> list[Column]:
    sides: dict[str, list[Column]] = {}
    for tag, side in BORDERS.items():
        sides.setdefault(side, []).append(border(f"{prefix}/{tag}"))
    return [F.coalesce(*found).alias(f"border_{side}") for side, found in sides.items()]


def shading() -> Column:
    """(background, foreground) of shading as the file has them; an automatic foreground is none."""
    fore = _get("shd@color")
    return F.when(_get("shd").isNotNull(), F.struct(F.nullif(_get("shd@fill"), F.lit("")).alias("background"), F.when(~fore.isin("", "auto"), fore).alias("foreground")))


def _each(key: str) -> Column:
    """Numbers of the elements of a key that repeats: 0, 1, ..."""
    names = F.filter(F.map_keys("props"), lambda k: k.rlike(rf"^{key}(#\d+)?$"))
    return F.sort_array(F.transform(names, lambda k: F.coalesce(F.regexp_extract(k, r"#(\d+)$", 1).try_cast("int"), F.lit(0))))


def _nth(key: str, n: Column, attribute: str) -> Column:
    return F.try_element_at("props", F.concat(F.lit(key), F.when(n > 0, F.concat(F.lit("#"), n)).otherwise(F.lit("")), F.lit(attribute)))


def tab_stops() -> Column:
    """Declared tab stops in order: position in points, alignment, leader, and whether it clears one; null if no list of
    them is declared, empty if the list is."""
    def one(n: Column) -> Column:
        val = F.coalesce(_nth("tabs/tab", n, "@val"), F.lit("left"))
        return F.struct(
            (F.coalesce(_nth("tabs/tab", n, "@pos").try_cast("int"), F.lit(0)) / 20.0).alias("position"), S.codes(val, TAB_ALIGNMENT).alias("alignment"),
            F.coalesce(S.codes(_nth("tabs/tab", n, "@leader"), TAB_LEADER), F.lit(0)).alias("leader"), (val == "clear").alias("clears"))

    return F.when(_get("tabs").isNotNull(), F.transform(_each("tabs/tab"), one))


def _indents() -> list[Column]:
    hanging, first = _points("ind@hanging"), _points("ind@firstLine")
    return [
        F.coalesce(_points("ind@left"), _points("ind@start")).alias("left_indent"), F.coalesce(_points("ind@right"), _points("ind@end")).alias("right_indent"), F.coalesce(-hanging, first).alias("first_line_indent"),
        (_first("ind@leftChars", "ind@startChars").try_cast("int") / 100.0).alias("left_characters"), (_first("ind@rightChars", "ind@endChars").try_cast("int") / 100.0).alias("right_characters"),
        F.coalesce(-_get("ind@hangingChars").try_cast("int") / 100.0, _get("ind@firstLineChars").try_cast("int") / 100.0).alias("first_line_characters")]


def _frame() -> Column:
    """The frame of a paragraph; null if it has none."""
    twips = lambda a: (_get(f"framePr@{a}").try_cast("int") / 20.0)
    places = [twips(a).alias(n) for a, n in (("w", "width"), ("h", "height"), ("x", "x"), ("y", "y"), ("hSpace", "horizontal_space"), ("vSpace", "vertical_space"))]
    kinds = [S.codes(_get(f"framePr@{a}"), t, None).alias(n) for (a, t), n in zip(FRAME.items(), ("height_rule", "horizontal_alignment", "vertical_alignment", "horizontal_from", "vertical_from", "wrap"), strict=True)]
    lock = F.coalesce(~_get("framePr@anchorLock").isin("0", "false"), F.lit(False)).alias("locked")
    return F.when(_get("framePr").isNotNull(), F.struct(*places, *kinds, lock))


PARAGRAPH = ("alignment", "left_indent", "right_indent", "first_line_indent", "left_characters", "right_characters", "first_line_characters", "space_before", "space_after", "line_spacing", "line_rule", "before_auto", "after_auto", *PARAGRAPH_FLAGS, "baseline", "outline_level", "shading", "tab_stops", "frame", "lines_to_drop", "drop_cap")


def paragraph_formats(properties: DataFrame, owner: str = "paragraph") -> DataFrame:
    """Paragraph declarations, direct ones unless another owner (style_paragraph, default_paragraph) is named."""
    on = lambda a: F.when(_get(f"spacing@{a}").isin("1", "true", "on"), True)
    return _own(properties, owner).select(
        *KEYS, S.codes(F.when(_get("jc").isNotNull(), F.coalesce(_get("jc@val"), F.lit("left"))), ALIGNMENT).alias("alignment"), *_indents(),
        _points("spacing@before").alias("space_before"), _points("spacing@after").alias("space_after"), _points("spacing@line").alias("line_spacing"),
        S.codes(F.nullif(_get("spacing@lineRule"), F.lit("")), LINE_RULE).alias("line_rule"), on("beforeAutospacing").alias("before_auto"), on("afterAutospacing").alias("after_auto"),
        *[S.flag(_get(t)).alias(t) for t in PARAGRAPH_FLAGS], S.codes(_get("textAlignment"), BASELINE).alias("baseline"),
        F.when(_get("outlineLvl").isNotNull(), F.coalesce(_get("outlineLvl").try_cast("int"), F.lit(9))).alias("outline_level"), shading().alias("shading"), *borders("pBdr"), tab_stops().alias("tab_stops"),
        _frame().alias("frame"), _get("framePr@lines").try_cast("int").alias("lines_to_drop"), S.codes(_get("framePr@dropCap"), DROP_CAP).alias("drop_cap"))


FONT = ("name", "size", *RUN_FLAGS, "underline", "color", "superscript", "subscript", "highlight", "effect", "emphasis", "kerning", "style_id", "locale")


def fonts(properties: DataFrame, theme: DataFrame, owner: str = "run") -> DataFrame:
    """Font declarations of runs, or of marks and styles; names and colours of the theme are looked up in its slots.

    color is what the file says, shown_color what the theme makes of it; with a tint and a shade it stays what the file says.
    """
    slots = theme.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat("kind", F.lit(":"), "slot"), "value"))).alias("theme"))
    at = _own(properties, owner).join(slots, "doc_id", "left")
    slot = lambda kind, key: F.try_element_at("theme", F.concat(F.lit(kind), key))
    full = lambda c: F.nullif(c, F.lit(""))
    name = F.coalesce(full(_get("rFonts@ascii")), full(_get("rFonts@hAnsi")), full(_get("rFonts@cs")), slot("font:", _get("rFonts@asciiTheme")), slot("font:", _get("rFonts@hAnsiTheme")))
    raw, tint, shade = _get("color@val"), _get("color@themeTint"), _get("color@themeShade")
    themed = slot("color:", _get("color@themeColor"))
    shown = F.when(themed.isNotNull() & ~(tint.isNotNull() & shade.isNotNull()), S.theme_color(themed, tint, shade)).otherwise(raw)
    light = F.try_element_at(F.create_map(*[F.lit(x) for k, v in HIGHLIGHT.items() for x in (k, v)]), _get("highlight"))
    position = _get("vertAlign")
    size = S.universal_measure(_get("sz"), "hp", float("nan"))
    kern = S.universal_measure(_get("kern"), "hp", float("nan"))
    return at.select(
        *KEYS, name.alias("name"), F.when(_get("sz").isNotNull() & ~F.isnan(size), F.floor(size) / 2.0).alias("size"), *[S.flag(_get(t)).alias(t) for t in RUN_FLAGS],
        F.when(_get("u@val").isNotNull(), S.codes(_get("u@val"), UNDERLINE, 1)).alias("underline"), F.when(_get("color").isNotNull(), S.color_name(F.coalesce(raw, F.lit("")))).alias("color"),
        F.when(_get("color").isNotNull(), S.color_name(F.coalesce(shown, F.lit("")))).alias("shown_color"), F.when(position.isNotNull(), position == "superscript").alias("superscript"),
        F.when(position.isNotNull(), position == "subscript").alias("subscript"), F.when(_get("highlight").isNotNull(), S.color_name(F.coalesce(light, F.lit("")))).alias("highlight"),
        S.codes(_get("effect"), EFFECT).alias("effect"), S.codes(_get("em"), EMPHASIS).alias("emphasis"), F.when(F.nullif(_get("kern"), F.lit("")).isNotNull() & ~F.isnan(kern), kern / 2).alias("kerning"),
        _get("rStyle").alias("style_id"), F.lower(full(_get("lang@val"))).alias("locale"), shading().alias("shading"))


def next_tab(stops: Column, position: Column) -> Column:
    """The first tab stop behind a position."""
    return F.try_element_at(F.filter(stops, lambda t: t["position"] > position), F.lit(1))


def previous_tab(stops: Column, position: Column) -> Column:
    """The last tab stop before a position."""
    return F.try_element_at(F.filter(stops, lambda t: t["position"] < position), F.lit(-1))


def page_setups(properties: DataFrame) -> DataFrame:
    """Sections: paper, margins in points (a bad one is 0), start, first page, numbering and columns."""
    width, height = (F.coalesce(_get(f"pgSz@{a}").try_cast("int"), F.lit(v)) / 20.0 for a, v in zip("wh", LETTER, strict=True))
    margins = [S.lenient_points(_get(f"pgMar@{a}")).alias(f"margin_{a}") for a in ("top", "bottom", "left", "right", "header", "footer", "gutter")]
    columns = F.transform(_each("cols/col"), lambda n: F.struct((_nth("cols/col", n, "@w").try_cast("int") / 20.0).alias("width"), (_nth("cols/col", n, "@space").try_cast("int") / 20.0).alias("space")))
    return _own(properties, "section").select(
        "doc_id", F.col("ord").alias("section"), width.alias("page_width"), height.alias("page_height"), S.paper_size(width, height).alias("paper"),
        F.when(_get("pgSz@orient") == "landscape", 2).otherwise(1).alias("orientation"), *margins, F.coalesce(S.codes(_get("type"), SECTION_START, 2), F.lit(2)).alias("start"),
        _get("titlePg").isNotNull().alias("different_first_page"), _get("pgNumType@start").try_cast("int").alias("first_number"),
        F.coalesce(_get("cols@num").try_cast("int"), F.lit(1)).alias("columns"), (_get("cols@space").try_cast("int") / 20.0).alias("column_space"),
        F.coalesce(~_get("cols@equalWidth").isin("0", "false"), F.lit(True)).alias("even_columns"), F.coalesce(_get("cols@sep").isin("1", "true"), F.lit(False)).alias("line_between"), columns.alias("column_list"))


def preferred_width(prefix: str) -> Column:
    """(type: 0 by content, 1 per cent, 2 points; value) of a width; null if it is not declared."""
    kind, value = _get(f"{prefix}@type"), F.coalesce(_get(f"{prefix}@w").try_cast("double"), F.lit(0.0))
    return F.when(_get(prefix).isNotNull(), F.struct(F.when(kind == "pct", 1).when(kind == "dxa", 2).otherwise(0).alias("type"), F.when(kind == "pct", value / 50).when(kind == "dxa", value / 20).otherwise(0.0).alias("value")))


def _padding(prefix: str) -> list[Column]:
    out = []
    for side, tags in (("left", ("left", "start")), ("right", ("right", "end")), ("top", ("top",)), ("bottom", ("bottom",))):
        found = [F.when(F.coalesce(_get(f"{prefix}/{t}@type"), F.lit("dxa")) == "dxa", _points(f"{prefix}/{t}@w")) for t in tags]
        out.append(F.coalesce(*found).alias(f"padding_{side}"))
    return out


def table_formats(properties: DataFrame, owner: str = "table") -> DataFrame:
    """Tables: style, look, alignment, width, indent, direction, floating, padding, borders, title and description."""
    look = S.table_look(_get("tblLook@val"), {a: _get(f"tblLook@{a}") for a in ("firstRow", "lastRow", "firstColumn", "lastColumn", "noHBand", "noVBand")})
    indent = F.when(F.coalesce(_get("tblInd@type"), F.lit("dxa")) == "dxa", _get("tblInd@w").try_cast("int") / 20.0)
    grid = F.transform(F.sort_array(F.transform(F.filter(F.map_keys("props"), lambda k: k.rlike(r"^grid#\d+$")), lambda k: F.regexp_extract(k, r"(\d+)$", 1).cast("int"))), lambda n: F.coalesce(F.try_element_at("props", F.concat(F.lit("grid#"), n)).try_cast("double") / 20, F.lit(0.0)))
    return _own(properties, owner).select(
        *KEYS, _get("tblStyle").alias("style_id"), F.when(_get("tblLook").isNotNull(), look).alias("look"), S.codes(_get("jc"), ALIGNMENT).alias("alignment"), preferred_width("tblW").alias("width"),
        indent.alias("left_indent"), S.flag(_get("bidiVisual")).alias("bidi"), F.exists(F.map_keys("props"), lambda k: k.startswith("tblpPr@")).alias("floating"), *_padding("tblCellMar"), *borders("tblBorders"),
        _get("tblCaption").alias("title"), _get("tblDescription").alias("description"), grid.alias("grid"))


def row_formats(properties: DataFrame, owner: str = "row") -> DataFrame:
    """Rows: height and its rule, whether they may break and are headings."""
    height = S.row_height(F.coalesce(_get("trHeight@val"), F.lit("")), _get("trHeight@hRule"))
    split = F.coalesce(_get("cantSplit"), F.lit("1"))
    bad = F.raise_error(F.lit("a row's switch is neither on nor off")).cast("boolean")
    allowed = F.when(_get("cantSplit").isNull(), F.lit(None).cast("boolean")).when(split.isin("", "1", "true", "on"), False).when(split.isin("0", "false", "off"), True).otherwise(bad)
    return _own(properties, owner).select(*KEYS, F.when(_get("trHeight").isNotNull(), height["height"]).alias("height"), F.when(_get("trHeight").isNotNull(), height["rule"]).alias("height_rule"), allowed.alias("may_break"), _get("tblHeader").isNotNull().alias("heading"), _get("cnfStyle@val").alias("conditions"))


def cell_formats(properties: DataFrame, owner: str = "cell") -> DataFrame:
    """Cells: width, vertical alignment, direction, wrapping, padding, shading and borders."""
    return _own(properties, owner).select(
        *KEYS, preferred_width("tcW").alias("width"), F.when(_get("vAlign").isNotNull(), F.coalesce(S.codes(_get("vAlign"), VERTICAL), F.lit(0))).alias("vertical_alignment"),
        S.codes(_get("textDirection"), DIRECTION).alias("direction"), F.coalesce(_get("noWrap").isin("0", "false") | _get("noWrap").isNull(), F.lit(True)).alias("wraps"), *_padding("tcMar"), shading().alias("shading"), *borders("tcBorders"))


def column_widths(tables: DataFrame, cells: DataFrame, cell_formats_: DataFrame, usable: Column | float) -> DataFrame:
    """(doc_id, path, column, width) in points of the columns of the grid, of a table as wide as ``usable`` at most (a
    column of tables, or points) and as its own preferred width, per cent or points.

    Each column is as wide as the widest of its cells' even shares; columns without a width share what is left, or their
    even part of the whole if that is more; without any width all are even; what is too wide together is scaled down.
    """
    merged = Window.partitionBy("doc_id", "table_path", "row").orderBy("cell")
    start = F.coalesce(F.sum("grid_span").over(merged.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    group = F.sum(F.when(F.col("horizontal_merge") != 2, 1).otherwise(0)).over(merged.rowsBetween(Window.unboundedPreceding, 0))
    own = cell_formats_.select("doc_id", F.col("path").alias("table_path"), F.floor(F.col("ord") / 1024).cast("int").alias("row"), (F.col("ord") % 1024).cast("int").alias("cell"), F.when(F.col("width.type") == 2, F.col("width.value")).alias("w"))
    at = cells.withColumn("column", start).withColumn("_g", group).join(own, ["doc_id", "table_path", "row", "cell"], "left")
    at = at.groupBy("doc_id", "table_path", "row", "_g").agg(F.min("column").alias("column"), F.sum("grid_span").cast("int").alias("span"), F.min_by("w", "cell").alias("w"))
    n = at.groupBy("doc_id", "table_path").agg(F.max(F.col("column") + F.col("span")).cast("int").alias("n"))
    each = n.select("doc_id", "table_path", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("column"))
    shares = at.filter("w > 0").select("doc_id", "table_path", F.explode(F.sequence(F.col("column"), F.col("column") + F.col("span") - 1)).alias("column"), (F.col("w") / F.col("span")).alias("w"))
    widest = shares.groupBy("doc_id", "table_path", "column").agg(F.max("w").alias("w"))
    room = tables.select("doc_id", F.col("path").alias("table_path"), F.when((F.col("width.type") == 1) & (F.col("width.value") > 0), usable * F.least(F.col("width.value"), F.lit(100.0)) / 100)
                         .when((F.col("width.type") == 2) & (F.col("width.value") > 0), F.least(F.lit(usable) if isinstance(usable, (int, float)) else usable, F.col("width.value"))).otherwise(usable).alias("room"))
    full = each.join(widest.hint("merge"), ["doc_id", "table_path", "column"], "left").join(room.hint("merge"), ["doc_id", "table_path"], "left").withColumn("room", F.coalesce("room", F.lit(usable) if isinstance(usable, (int, float)) else F.lit(None)))
    whole = Window.partitionBy("doc_id", "table_path")
    full = full.withColumn("_total", F.coalesce(F.sum("w").over(whole), F.lit(0.0))).withColumn("_open", F.sum(F.when(F.col("w").isNull(), 1).otherwise(0)).over(whole))
    fill = F.greatest(F.col("room") - F.col("_total"), F.col("room") / F.col("n") * F.col("_open")) / F.col("_open")
    full = full.withColumn("w", F.when(F.col("_total") == 0, F.col("room") / F.col("n")).otherwise(F.coalesce("w", F.when(F.col("_open") > 0, fill)))).withColumn("_total", F.sum("w").over(whole))
    return full.select("doc_id", F.col("table_path").alias("path"), "column", F.when(F.col("_total") > F.col("room"), F.col("w") * F.col("room") / F.col("_total")).otherwise(F.col("w")).alias("width"))


SIDES = ("top", "bottom", "left", "right")


def _shows(props: Column, key: Column | str) -> Column:
    """Whether a side that props declare under key is one that shows: a line, or a width."""
    at = lambda more: F.try_element_at(props, F.concat(F.lit(key) if isinstance(key, str) else key, F.lit(more)))
    line = S.codes(F.coalesce(F.nullif(at(""), F.lit("")), F.lit("none")), LINE_STYLE) != 0
    return F.coalesce(at("").isNotNull() & (line | (F.coalesce(at("@sz").try_cast("int"), F.lit(0)) > 0)), F.lit(False))


def _declared_side(props: Column, prefix: str, side: str) -> Column:
    """The key under which props declare a side, by any of its names; null if they do not."""
    names = [t for t, s in BORDERS.items() if s == side]
    return F.coalesce(*[F.when(F.try_element_at(props, F.lit(f"{prefix}/{t}")).isNotNull(), F.lit(f"{prefix}/{t}")) for t in names])


def cell_borders(cells: DataFrame, properties: DataFrame, styles: DataFrame) -> DataFrame:
    """(doc_id, table_path, row, cell, top, bottom, left, right): the border that each side of a cell shows, null for none.

    The cell's own side counts if it shows; else the table's border at that place, which at the rim is the outer one and
    inside the inner one; only a table without borders of its own takes the first style of its chain that has any. A
    table from right to left has its left and right changed over.
    """
    props = F.col("props")
    has = F.map_contains_key("props", "tblBorders")
    only = lambda prefix: F.map_filter("props", lambda k, _: k.startswith(prefix))
    chain = styles.filter("style_id is not null").select("doc_id", "style_id", F.posexplode("chain").alias("_depth", "_layer"))
    any_ = F.exists(F.map_keys(props), lambda k: k.rlike("^tblBorders/[A-Za-z0-9]+$") & _shows(props, k))
    bordered = _own(properties, "style_table").filter(any_).select("doc_id", F.col("ident").alias("_layer"), only("tblBorders").alias("b"))
    inherited = chain.join(bordered, ["doc_id", "_layer"]).groupBy("doc_id", "style_id").agg(F.min_by("b", "_depth").alias("of_style"))
    own = _own(properties, "table").select("doc_id", F.col("path").alias("table_path"), _get("tblStyle").alias("style_id"), S.flag(_get("bidiVisual"), False).alias("bidi"), F.when(has, only("tblBorders")).alias("of_table"))
    own = own.join(inherited, ["doc_id", "style_id"], "left").select("doc_id", "table_path", "bidi", F.coalesce("of_table", "of_style").alias("layer"))
    line, whole = Window.partitionBy("doc_id", "table_path", "row"), Window.partitionBy("doc_id", "table_path")
    at = cells.withColumn("_from", F.coalesce(F.sum("grid_span").over(line.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = at.withColumn("_to", F.col("_from") + F.col("grid_span")).withColumn("_columns", F.max("_to").over(whole)).withColumn("_last", F.max("row").over(whole))
    mine = _own(properties, "cell").select("doc_id", F.col("path").alias("table_path"), F.floor(F.col("ord") / 1024).cast("int").alias("row"), (F.col("ord") % 1024).cast("int").alias("cell"), only("tcBorders").alias("own"))
    at = at.join(mine, ["doc_id", "table_path", "row", "cell"], "left").join(own.hint("merge"), ["doc_id", "table_path"], "left")
    turned = F.coalesce("bidi", F.lit(False))
    rim = {"top": F.col("row") == 0, "bottom": F.col("row") == F.col("_last"), "left": F.col("_from") == 0, "right": F.col("_to") == F.col("_columns")}
    sources = []
    for s in SIDES:
        inner = "horizontal" if s in ("top", "bottom") else "vertical"
        outer_key, inner_key = (_declared_side(F.col("layer"), "tblBorders", x) for x in (s, inner))
        place = F.when(turned, {"left": "right", "right": "left"}.get(s, s)).otherwise(s)
        sources.append(F.struct(place.alias("side"), _declared_side(F.col("own"), "tcBorders", s).alias("own_key"), F.when(rim[s], outer_key).otherwise(inner_key).alias("key")))
    # which map a side is read from is settled first, so that a border is decoded in one place
    chosen = F.transform(F.array(*sources), lambda x: F.struct(x["side"].alias("side"), F.when(_shows(F.col("own"), x["own_key"]), F.struct(F.col("own").alias("props"), x["own_key"].alias("key"))).when(_shows(F.col("layer"), x["key"]), F.struct(F.col("layer").alias("props"), x["key"].alias("key"))).alias("from")))
    decoded = F.transform(chosen, lambda x: F.struct(x["side"].alias("side"), F.when(x["from"].isNotNull(), _border_at(x["from"]["props"], x["from"]["key"])).alias("border")))
    at = at.select("doc_id", "table_path", "row", "cell", decoded.alias("sides"))
    def of(side: str) -> Column:
        return F.get(F.filter("sides", lambda x: x["side"] == side), F.lit(0))["border"].alias(side)

    return at.select("doc_id", "table_path", "row", "cell", *map(of, SIDES))


def compatibility(properties: DataFrame) -> DataFrame:
    """(doc_id, name, enabled): compatibility switches of the settings, and the mode as a number under its own name."""
    s = _own(properties, "settings").select("doc_id", F.explode(F.map_filter("props", lambda k, _: k.rlike(r"^compat/[^/@#]+$"))).alias("name", "value"))
    return s.filter("name <> 'compat/compatSetting'").select("doc_id", F.regexp_replace("name", "^compat/", "").alias("name"), S.flag(F.col("value")).alias("enabled"))


def document_settings(properties: DataFrame) -> DataFrame:
    """(doc_id, default_tab, even_and_odd, mirror): settings of the whole document; tabs are 36 points apart unless it says so."""
    tab = _get("defaultTabStop")
    return _own(properties, "settings").select("doc_id", F.when(tab.isNull(), 36.0).otherwise(S.row_height(tab, F.lit(None))["height"]).alias("default_tab"), S.flag(_get("evenAndOddHeaders"), False).alias("even_and_odd"), S.flag(_get("mirrorMargins"), False).alias("mirror"))


def note_options(properties: DataFrame) -> DataFrame:
    """(doc_id, section, kind, number_format, position, start, restart): of each section its own option, else the document's, else the built-in one."""
    def options(prefix: str) -> list[Column]:
        return [_get(f"{prefix}/{t}").alias(t) for t in ("numFmt", "pos", "numStart", "numRestart")]

    out = None
    for kind in ("footnote", "endnote"):
        own = _own(properties, "section").select("doc_id", F.col("ord").alias("section"), *options(f"{kind}Pr"))
        whole = _own(properties, "settings").select("doc_id", *[c.alias(f"d_{n}") for c, n in zip(options(f"{kind}Pr"), ("numFmt", "pos", "numStart", "numRestart"), strict=True)])
        at = own.join(whole, "doc_id", "left")
        pick = lambda c, last: F.coalesce(c, f"d_{c}", F.lit(last))
        one = at.select("doc_id", "section", F.lit(kind).alias("kind"), pick("numFmt", NOTE_STYLE[kind]).alias("number_format"), pick("pos", NOTE_PLACE[kind]).alias("position"), S.note_id(pick("numStart", "1")).alias("start"), pick("numRestart", "continuous").alias("restart"))
        out = one if out is None else out.unionByName(one)
    return out


def registered_fonts(font_table: DataFrame) -> DataFrame:
    """One row for each font name, whatever its case: of every field the last that is given."""
    given = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("ord"))).alias(c)
    return font_table.filter("name is not null").groupBy("doc_id", F.lower("name").alias("key")).agg(F.max_by("name", "ord").alias("name"), *[given(c) for c in ("alternative", "charset", "family", "pitch")], F.max("embedded").alias("embedded"))


def style_records(styles: DataFrame) -> DataFrame:
    """Named styles with their canonical names, priority, flags and the style of the next paragraph."""
    builtin = (F.col("kind") == "paragraph") & ~F.col("custom") & ((F.lower("name") == "normal") | (F.lower("style_id") == "normal"))
    return styles.filter("style_id is not null").select("doc_id", "style_id", S.canonical_style_name(F.col("name")).alias("name"), "kind", "base_id", "next_id", "priority", "quick", "hidden", "custom", "is_default", builtin.alias("is_normal"))


def style_by_name(styles: DataFrame, names: DataFrame) -> DataFrame:
    """names (doc_id, name) with the style_id: the first of exactly that name, else of that name whatever its case and blanks."""
    near = lambda c: F.lower(F.replace(c, F.lit(" "), F.lit("")))
    own = styles.filter("style_id is not null").withColumn("shown", S.canonical_style_name(F.col("name")))
    exact = own.groupBy("doc_id", F.col("shown").alias("name")).agg(F.min_by("style_id", "ord").alias("_exact"))
    loose = own.groupBy("doc_id", near(F.col("shown")).alias("_near")).agg(F.min_by("style_id", "ord").alias("_loose"))
    full = names.join(exact, ["doc_id", "name"], "left").withColumn("_near", near(F.col("name"))).join(loose, ["doc_id", "_near"], "left")
    return full.select("doc_id", "name", F.coalesce("_exact", "_loose").alias("style_id"))
