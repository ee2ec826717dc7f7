"""Scalar functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: a column that an expression names often would be computed as often."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def combine_toggle(default: Column, paragraph: Column, character: Column) -> Column:
    """Both styles declared: default or (paragraph xor character); else the one declared; else the default."""
    base = F.coalesce(default, F.lit(False))
    return F.when(paragraph.isNotNull() & character.isNotNull(), base | (paragraph != character)).otherwise(F.coalesce(character, paragraph, base))


def roman(n: Column) -> Column:
    """Upper-case roman numeral; empty for zero and below."""
    # The numerals.
    numerals = [(1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]
    parts, left = [], F.greatest(n, F.lit(0))
    for value, sign in numerals:
        parts.append(F.repeat(F.lit(sign), F.floor(left / value).cast("int")))
        left = left % value
    return F.concat(*parts)


def letters(n: Column, digits: int = 7) -> Column:
    """Bijective base 26 in lower case: 1 a, 26 z, 27 aa; empty for zero and below."""
    out, left = F.lit(""), F.greatest(n, F.lit(0)).cast("long")
    for _ in range(digits):
        digit = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), ((left - 1) % 26 + 1).cast("int"), F.lit(1))
        out = F.concat(F.when(left > 0, digit).otherwise(F.lit("")), out)
        left = F.when(left > 0, F.floor((left - 1) / 26)).otherwise(F.lit(0)).cast("long")
    return out


def format_number(n: Column, style: Column) -> Column:
    """A counter in a list number style: 1 and 2 roman, 3 and 4 letters, anything else decimal."""
    return F.when(style == 1, roman(n)).when(style == 2, F.lower(roman(n))).when(style == 3, F.upper(letters(n))).when(style == 4, letters(n)).otherwise(n.cast("string"))


def heading_level(outline: Column, style_name: Column) -> Column:
    """Level from 1 by an outline level under 9, else by a style named heading N; null if neither."""
    named = F.regexp_extract(F.lower(style_name), r"^heading ([1-9])$", 1)
    return F.when(outline.between(0, 8), outline + 1).otherwise(F.when(named != "", named.cast("int")))


# Built-in names that differ by more than their case, and words that stay small.
RENAMED = {
    "Normal Table": "Table Normal", "annotation reference": "Comment Reference", "annotation text": "Comment Text", "annotation subject": "Comment Subject",
    "Outline List 1": "1 / a / i", "Outline List 2": "1 / 1.1 / 1.1.1", "Outline List 3": "Article / Section", "macro": "Macro Text"}
SMALL = ("of", "and", "or", "the", "a", "an", "in", "on", "for", "to")


def canonical_style_name(name: Column) -> Column:
    """Lower-case built-in names with words capitalised, TOC and TOA whole; other names stay."""
    words = F.filter(F.split(name, r"\s+"), lambda w: w != "")
    shown = F.transform(words, lambda w, k: F.when((k == 0) & w.isin("toc", "toa"), F.upper(w)).when((k > 0) & w.isin(*SMALL) & ~words[0].isin("toc", "toa"), w).otherwise(F.initcap(w)))
    known = F.try_element_at(F.create_map(*[F.lit(x) for k, v in RENAMED.items() for x in (k, v)]), name)
    return F.when(known.isNotNull(), known).when((name != F.lower(name)) | (F.size(words) == 0), name).otherwise(F.array_join(shown, " "))


def note_id(value: Column) -> Column:
    """A number's text, decimals and exponents too, cut to a whole number, held to 64 bits and wrapped to 32; zero for anything else."""
    clean = F.btrim(value, F.lit(" \t\r\n"))
    # of what a cast to double takes, only what is made of digits, signs, a point and an exponent counts
    number = (F.translate(clean, "0123456789+-.eE", "") == "") & (F.translate(clean, "+-.eE", "") != "")
    real = clean.try_cast("double")
    # doubles beyond 2 ** 63 are cast to the largest or smallest whole number
    whole = F.when(real >= 9.223372036854775807e18, F.lit((1 << 63) - 1)).when(real <= -9.223372036854775808e18, F.lit(-(1 << 63))).otherwise(real.try_cast("bigint"))
    n = F.when(number & real.isNotNull() & ~F.isnan(real) & (F.abs(real) <= 1.7976931348623157e308), whole).otherwise(F.lit(0)).cast("decimal(38,0)")
    return (F.pmod(n + 2147483648, F.lit(4294967296).cast("decimal(38,0)")) - 2147483648).cast("bigint")


def twips_to_points(value: Column) -> Column:
    """Whole twips as points; an error that does not show the value for anything else."""
    return F.when(value.rlike(r"^[+-]?[0-9]+$"), value.try_cast("bigint") / 20.0).when(value.isNotNull(), F.raise_error(F.lit("a measure is not a whole number")).cast("double"))


def half_point_size(points: Column) -> Column:
    """The nearest half point, ties up."""
    return F.floor(points * 2 + 0.5) / 2


def paper_size(width: Column, height: Column) -> Column:
    """Letter, Legal or A4 in either orientation within two points (three for A4); Custom otherwise."""
    short, long_ = F.least(width, height), F.greatest(width, height)
    near = lambda c, v, t: F.abs(c - v) <= t
    # Sizes in points.
    return (
        F.when(near(short, 612, 2) & near(long_, 792, 2), "Letter").when(near(short, 612, 2) & near(long_, 1008, 2), "Legal")
        .when(near(short, 595, 3) & near(long_, 842, 3), "A4").otherwise("Custom"))


def safe_text(text: Column) -> Column:
    """Private-use bullets of symbol fonts as ordinary ones."""
    return F.translate(text, "\uf0b7\uf0a7", "•▪")


def apply_caps(text: Column, caps: Column) -> Column:
    return F.when(caps, F.upper(text)).otherwise(text)


def image_type(content: Column) -> Column:
    """png, jpeg, gif, bmp or emf by the first bytes; null for anything else."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head.startswith("89504E470D0A1A0A"), "png").when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("47494638"), "gif").when(head.startswith("424D"), "bmp").when(head.startswith("01000000"), "emf")


def png_size(content: Column) -> Column:
    """Width and height that a PNG header holds."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int")
    return F.when(image_type(content) == "png", F.struct(number(17).alias("width"), number(21).alias("height")))


# ---------------------------------------------------------------- measures, flags and colours of declarations
def flag(value: Column, default: bool | None = None) -> Column:
    """A switch: the default if absent, on if it has no value, off for false, 0 and off."""
    return F.when(value.isNull(), F.lit(default)).otherwise(~F.lower(value).isin("false", "0", "off"))


def lenient_points(value: Column) -> Column:
    """Twips as points; zero for what is no whole number, null if absent."""
    return F.when(value.isNull(), F.lit(None).cast("double")).otherwise(F.coalesce(F.btrim(value).try_cast("bigint") / 20.0, F.lit(0.0)))


# Units in points.
UNITS = {
    "pt": 1.0, "hp": 0.5, "halfpt": 0.5, "twip": 0.05, "twips": 0.05, "dxa": 0.05, "in": 72.0, "inch": 72.0, "cm": 28.346456692913385, "mm": 2.834645669291338,
    "pi": 12.0, "pc": 12.0, "emu": 1 / 12700}


def universal_measure(value: Column, unit: str, default: float = 0.0) -> Column:
    """A number with or without a unit, in ``unit``; one without, or with an unknown unit, is in it already."""
    number = F.regexp_extract(value, r"(?s)^(.*[0-9])", 1).try_cast("double")
    suffix = F.lower(F.trim(F.regexp_extract(value, r"(?s)^.*[0-9](.*)$", 1)))
    factor = F.try_element_at(F.create_map(*[F.lit(x) for k, v in UNITS.items() for x in (k, v / UNITS[unit])]), suffix)
    return F.when(value.isNull() | ~value.rlike("[0-9]"), F.lit(default)).otherwise(F.coalesce(number * F.coalesce(factor, F.lit(1.0)), F.lit(default)))


def row_height(value: Column, rule: Column) -> Column:
    """(points, rule: 0 at least, 1 exactly, 2 by content) of a row: twips or a measure, wrapped to 32 bits; zero is by content."""
    n = universal_measure(value, "twip")
    n = F.when(value.rlike(r"[a-z]+$"), F.bround(n)).otherwise(F.when(n >= 0, F.floor(n)).otherwise(F.ceil(n))).cast("bigint")
    twips = F.pmod(n + 2147483648, F.lit(4294967296)) - 2147483648
    return F.struct((twips / 20.0).alias("height"), F.when(twips == 0, 2).when(rule == "exact", 1).otherwise(0).alias("rule"))


def tab_interval(points: Column) -> Column:
    """A default tab stop in whole twips, held to 31 bits; an endless one is the smallest number, a negative one an error."""
    twips = F.when(F.isnan(points) | (F.abs(points) == float("inf")), F.lit(-2147483648)).otherwise(F.bround(F.least(points, F.lit(2147483647 / 20)) * 20))
    return F.when((points < 0) & (points > float("-inf")), F.raise_error(F.lit("a tab stop is not negative")).cast("double")).otherwise(twips / 20.0)


NO_COLOR = "Color [Empty]"


def color_name(value: Column) -> Column:
    """Six hexadecimal digits as ``Color [A=255, R=, G=, B=]``; anything else is empty."""
    digits = F.regexp_replace(value, "^#+", "")
    channel = lambda k: F.conv(F.substring(digits, k, 2), 16, 10)
    text = F.concat(F.lit("Color [A=255, R="), channel(1), F.lit(", G="), channel(3), F.lit(", B="), channel(5), F.lit("]"))
    return F.when(digits.rlike("^[0-9A-Fa-f]{6}$"), text).otherwise(NO_COLOR)


def color_channels(text: Column) -> Column:
    """(r, g, b) of a colour's name, or of six hexadecimal digits; null if it has none."""
    named, digits = r"R=(\d+),\s*G=(\d+),\s*B=(\d+)", r"^\s*#?([0-9A-Fa-f]{6})\s*$"
    by_name = F.struct(*[F.regexp_extract(text, named, k).cast("int").alias(c) for k, c in enumerate("rgb", 1)])
    part = lambda k: F.conv(F.substring(F.regexp_extract(text, digits, 1), k, 2), 16, 10).cast("int")
    return F.when(text.contains("Empty"), None).when(text.rlike(named), by_name).when(text.rlike(digits), F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b")))


def theme_color(value: Column, tint: Column, shade: Column) -> Column:
    """Six digits after a tint, else a shade (two hexadecimal digits): the lightness moves, hue and saturation stay."""
    def to_hls(c: Column) -> Column:
        r, g, b = c["r"], c["g"], c["b"]
        light, spread = (c["high"] + c["low"]) / 2, c["high"] - c["low"]
        sat = spread / F.when(light <= 0.5, c["high"] + c["low"]).otherwise(2.0 - c["high"] - c["low"])
        at = lambda x: (c["high"] - x) / spread
        hue = F.when(r == c["high"], at(b) - at(g)).when(g == c["high"], 2.0 + at(r) - at(b)).otherwise(4.0 + at(g) - at(r)) / 6.0
        # a grey has neither hue nor saturation
        hls = F.struct((hue - F.floor(hue)).alias("h"), light.alias("l"), sat.alias("s"))
        return F.when(spread == 0, F.struct(F.lit(0.0).alias("h"), light.alias("l"), F.lit(0.0).alias("s"))).otherwise(hls)

    def moved(c: Column) -> Column:
        by = F.conv(F.coalesce(F.nullif(tint, F.lit("")), shade), 16, 10).cast("double") / 255.0
        light = F.when(F.coalesce(tint, F.lit("")) != "", c["l"] + (1 - c["l"]) * (1 - by)).otherwise(c["l"] * by)
        return F.struct(c["h"].alias("h"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), light)).alias("l"), c["s"].alias("s"))

    def ramps(c: Column) -> Column:
        m2 = F.when(c["l"] <= 0.5, c["l"] * (1.0 + c["s"])).otherwise(c["l"] + c["s"] - c["l"] * c["s"])
        return F.struct((2.0 * c["l"] - m2).alias("m1"), m2.alias("m2"), c["h"].alias("h"))

    def to_digits(c: Column) -> Column:
        def one(shift: float) -> Column:
            ramp = lambda h: (
                F.when(h < 1 / 6, c["m1"] + (c["m2"] - c["m1"]) * h * 6.0).when(h < 0.5, c["m2"])
                .when(h < 2 / 3, c["m1"] + (c["m2"] - c["m1"]) * (2 / 3 - h) * 6.0).otherwise(c["m1"]))
            level = let(F.pmod(c["h"] + shift, F.lit(1.0)), ramp)
            return F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.floor(level * 255))).cast("int")), 2, "0")

        return F.concat(one(1 / 3), one(0.0), one(-1 / 3))

    part = lambda k: F.conv(F.substring(value, k, 2), 16, 10).cast("double") / 255.0
    extremes = lambda c: F.struct(c["r"].alias("r"), c["g"].alias("g"), c["b"].alias("b"), F.greatest(c["r"], c["g"], c["b"]).alias("high"), F.least(c["r"], c["g"], c["b"]).alias("low"))
    rgb = F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b"))
    none = (F.coalesce(tint, F.lit("")) == "") & (F.coalesce(shade, F.lit("")) == "")
    bad = ~F.coalesce(F.nullif(tint, F.lit("")), shade).rlike("^[0-9A-Fa-f]+$") | ~value.rlike("^[0-9A-Fa-f]{6}")
    return F.when(none | bad, value).otherwise(let(let(let(let(let(rgb, extremes), to_hls), moved), ramps), to_digits))


def codes(value: Column, table: dict[str, int], default: int | None = 0) -> Column:
    """The code of a token; the default for unknown ones, null if absent."""
    known = F.try_element_at(F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v)]), value)
    return F.when(value.isNull(), F.lit(None).cast("int")).otherwise(F.coalesce(known, F.lit(default).cast("int")))


def table_look(bits: Column, switches: dict[str, Column]) -> Column:
    """Switches of a table's look: the bits of a hexadecimal mask unless an attribute says so; bands are given as noHBand and noVBand."""
    mask = F.coalesce(F.conv(bits, 16, 10).cast("int"), F.lit(0))
    # Bits of the mask, and whether they turn the switch off.
    known = {"first_row": (0x20, "firstRow", False), "last_row": (0x40, "lastRow", False), "first_column": (0x80, "firstColumn", False), "last_column": (0x100, "lastColumn", False), "row_bands": (0x200, "noHBand", True), "column_bands": (0x400, "noVBand", True)}
    out = []
    for name, (bit, attribute, inverted) in known.items():
        own = switches[attribute]
        on = F.when(own.isNull(), mask.bitwiseAND(F.lit(bit)) != 0).otherwise(own.isin("1", "on", "true"))
        out.append((~on if inverted else on).alias(name))
    return F.struct(*out)


def hexadecimal_id(value: Column) -> Column:
    """An id of up to eight hexadecimal digits behind any zeros; null if it is none."""
    digits = F.regexp_replace(F.btrim(value, F.lit(" \t\r\n")), "^0+(?=.)", "")
    return F.when(digits.rlike("^[0-9A-Fa-f]{1,8}$"), F.conv(digits, 16, 10).cast("bigint"))


def paragraph_id(value: Column) -> Column:
    """A paragraph's id: between 1 and 0x7FFFFFFF."""
    n = hexadecimal_id(value)
    return F.when((n > 0) & (n < 0x80000000), n)


def line_height(size: Column, spacing: Column, rule: Column) -> Column:
    """Points from line to line: 1.4 times the size; rule 1 sets them, 0 is a least, 2 takes 12 points as one line."""
    natural, points = size * 1.4, F.coalesce(spacing, F.lit(0.0))
    return F.when(points <= 0, natural).when(rule == 1, points).when(rule == 0, F.greatest(natural, points)).when(rule == 2, natural * points / 12.0).otherwise(natural)


def is_contents_style(name: Column) -> Column:
    """Whether a style's name is one of a table of contents."""
    low = F.lower(F.coalesce(name, F.lit("")))
    return low.startswith("toc") | low.contains("toc ") | low.contains("table of contents")


def jpeg_size(content: Column) -> Column:
    """Width and height of the first frame header of a JPEG, found by its marker."""
    hexed = F.hex(content)
    # a frame marker, its length and precision, then height and width
    at = r"^(?:FFD8)(?:FF(?!C[0-35-79-BD-F])[0-9A-F]{2}[0-9A-F]{4}(?:[0-9A-F]{2})*?)*?FFC[0-35-79-BD-F][0-9A-F]{6}([0-9A-F]{4})([0-9A-F]{4})"
    number = lambda k: F.conv(F.regexp_extract(hexed, at, k), 16, 10).cast("int")
    return F.when(image_type(content) == "jpeg", F.struct(number(2).alias("width"), number(1).alias("height")))
