"""What relates nodes to one another, as joins, windows and folds over the node tables."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

TOGGLES = ("b", "i", "caps", "vanish")


def style_layers(styles: DataFrame) -> DataFrame:
    """(doc_id, style_id, depth, layer_id): each style and the styles it is based on, nearest first.

    A cycle ends where it would repeat; a missing base ends the chain. The chains come with the styles.
    """
    return styles.filter(F.col("style_id").isNotNull()).select("doc_id", "style_id", F.posexplode("chain").alias("depth", "layer_id"))


def style_fonts(styles: DataFrame) -> DataFrame:
    """Per style what its chain declares: of every property the nearest declaration."""
    layers = style_layers(styles).join(styles.select("doc_id", F.col("style_id").alias("layer_id"), "name", "outline", "num_id", "num_level", *TOGGLES, "size"), ["doc_id", "layer_id"])
    nearest = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("depth"))).alias(c)
    return layers.groupBy("doc_id", "style_id").agg(F.max("depth").alias("depth"), F.min_by("name", "depth").alias("name"), F.min_by("num_level", F.when(F.col("num_id").isNotNull(), F.col("depth"))).alias("num_level"), *[nearest(c) for c in ("outline", "num_id", *TOGGLES, "size")])


def default_styles(styles: DataFrame) -> DataFrame:
    """(doc_id, kind, style_id): the last style of each kind that is flagged as its default."""
    return styles.filter("is_default").groupBy("doc_id", "kind").agg(F.max_by("style_id", "ord").alias("style_id"))


def sections(blocks: DataFrame) -> DataFrame:
    """Top-level blocks with the number of their section: one more than the sections that ended before."""
    w = Window.partitionBy("doc_id").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.filter(F.size("path") == 1).withColumn("section", F.coalesce(F.sum(F.col("ends_section").cast("int")).over(w), F.lit(0)).cast("int"))


def header_assignment(references: DataFrame, relationships: DataFrame) -> DataFrame:
    """(doc_id, section, kind, variant, part, inherited): the story each section shows, kept from earlier ones."""
    every = references.filter("kind = 'section'").select("doc_id", "section")
    explicit = references.filter("kind <> 'section'")
    kinds = explicit.select("doc_id", "kind", "variant").distinct()
    grid = every.join(kinds, "doc_id").join(explicit, ["doc_id", "section", "kind", "variant"], "left")
    w = Window.partitionBy("doc_id", "kind", "variant").orderBy("section")
    held = grid.withColumn("use", F.last("rid", ignorenulls=True).over(w)).filter(F.col("use").isNotNull())
    rel = relationships.filter("owner_role = 'main'").select("doc_id", F.col("rid").alias("use"), F.col("target").alias("part"))
    return held.join(rel, ["doc_id", "use"], "left").select("doc_id", "section", "kind", "variant", "part", F.col("rid").isNull().alias("inherited"))


def visible(inlines: DataFrame) -> DataFrame:
    """Runs outside field instructions. Each field has its own state, code or result; stray marks are ignored."""
    token = F.struct("ord", "kind", "text", "rid", "anchor", "char_style", "caps", "smallCaps", "vanish")
    lists = inlines.groupBy("doc_id", "part_name", "block_path").agg(F.sort_array(F.collect_list(token)).alias("tokens"), F.first("paragraph_style").alias("paragraph_style"), F.first("table_style").alias("table_style"))
    kept = lists.schema["tokens"].dataType.simpleString()

    def step(state: Column, t: Column) -> Column:
        stack, out = state["stack"], state["out"]
        top = F.size(stack)
        new = (
            F.when(t["kind"] == "FieldStart", F.concat(stack, F.array(F.lit(True))))
            .when((t["kind"] == "FieldSeparator") & (top > 0), F.concat(F.slice(stack, 1, F.greatest(top - 1, F.lit(0))), F.array(F.lit(False))))
            .when((t["kind"] == "FieldEnd") & (top > 0), F.slice(stack, 1, F.greatest(top - 1, F.lit(0))))
            .otherwise(stack))
        show = (t["kind"] == "Run") & ~F.array_contains(stack, True)
        return F.struct(new.alias("stack"), F.when(show, F.concat(out, F.array(t))).otherwise(out).alias("out"))

    start = F.struct(F.array().cast("array<boolean>").alias("stack"), F.array().cast(kept).alias("out"))
    # paragraphs without fields keep their runs without the fold
    plain = F.filter("tokens", lambda t: t["kind"] == "Run")
    runs = F.when(F.exists("tokens", lambda t: t["kind"] == "FieldStart"), F.aggregate("tokens", start, step, lambda s: s["out"])).otherwise(plain)
    keys = ("doc_id", "part_name", "block_path", "paragraph_style", "table_style")
    return lists.select(*keys, F.explode_outer(runs).alias("t")).filter(F.col("t").isNotNull()).select(*keys, "t.*")


#: What stands for the number of a page in text.
PAGE = "\0PAGE\0"


def page_marks(inlines: DataFrame) -> DataFrame:
    """(doc_id, part_name, block_path, place, kind, text): runs and field marks in order, with the number of a page as a run
    PAGE behind the separator of its field, in place of what the field showed last.

    A field is one of page numbers if its instruction, as far as the last text before the separator that begins so, is
    PAGE; a field that begins inside another, or any end, ends that state.
    """
    token = F.struct("ord", "kind", F.coalesce("text", F.lit("")).alias("text"))
    lists = inlines.filter(F.col("kind").isin("Run", "FieldStart", "FieldSeparator", "FieldEnd")).groupBy("doc_id", "part_name", "block_path").agg(F.sort_array(F.collect_list(token)).alias("tokens"))
    kept = "array<struct<kind: string, text: string>>"

    def step(s: Column, t: Column) -> Column:
        kind, show = t["kind"], F.struct(t["kind"].alias("kind"), t["text"].alias("text"))
        begins, parts_, ends = kind == "FieldStart", kind == "FieldSeparator", kind == "FieldEnd"
        coded = (kind == "Run") & (s["depth"] > 0) & s["code"]
        names = coded & t["text"].rlike(r"^\s*PAGE(?![A-Za-z0-9_])")
        mark = parts_ & s["pending"]
        out = F.when((kind == "Run") & s["shown"], s["out"]).when(mark, F.concat(s["out"], F.array(show), F.array(F.struct(F.lit("Run").alias("kind"), F.lit(PAGE).alias("text"))))).otherwise(F.concat(s["out"], F.array(show)))
        return F.struct(
            F.when(begins, s["depth"] + 1).when(ends, F.greatest(s["depth"] - 1, F.lit(0))).otherwise(s["depth"]).alias("depth"), F.when(begins, True).when(parts_ | ends, False).otherwise(s["code"]).alias("code"),
            F.when(begins | parts_ | ends, False).otherwise(s["pending"] | names).alias("pending"), F.when(mark, True).when(ends, False).otherwise(s["shown"]).alias("shown"), out.alias("out"))

    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("code"), F.lit(False).alias("pending"), F.lit(False).alias("shown"), F.array().cast(kept).alias("out"))
    plain = F.transform("tokens", lambda t: F.struct(t["kind"].alias("kind"), t["text"].alias("text")))
    done = F.when(F.exists("tokens", lambda t: t["kind"] == "FieldStart"), F.aggregate("tokens", start, step, lambda s: s["out"])).otherwise(plain)
    return lists.select("doc_id", "part_name", "block_path", F.posexplode(done).alias("place", "t")).select("doc_id", "part_name", "block_path", "place", "t.kind", "t.text")


def headings(blocks: DataFrame, styles: DataFrame) -> DataFrame:
    """Paragraphs with heading_level, by their own outline level, else by their style's chain or name; others out."""
    fonts = style_fonts(styles).select("doc_id", "style_id", F.col("outline").alias("style_outline"), F.col("name").alias("style_name"))
    out = blocks.filter("node_type = 'Paragraph'").join(fonts, ["doc_id", "style_id"], "left")
    return out.withColumn("heading_level", S.heading_level(F.coalesce("outline", "style_outline"), F.col("style_name"))).filter(F.col("heading_level").isNotNull())


def outline(headings_: DataFrame) -> DataFrame:
    """Headings with depth from 1 when missing levels are closed up: one below the nearest earlier smaller level.

    A level is open if it came after all smaller levels; so the last place of each of the nine levels is all there is to
    know of the headings before.
    """
    w = Window.partitionBy("doc_id").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    at = headings_.filter(F.size("path") == 1).withColumn("_at", F.element_at("path", 1))
    at = at.select("*", *[F.max(F.when(F.col("heading_level") == k, F.col("_at"))).over(w).alias(f"_l{k}") for k in range(1, 10)])
    depth, latest = F.lit(1), F.lit(-1)
    for k in range(1, 10):
        last = F.col(f"_l{k}")
        depth = depth + F.when((F.col("heading_level") > k) & (last > latest), 1).otherwise(0)
        latest = F.greatest(latest, F.coalesce(last, F.lit(-1)))
    return at.withColumn("depth", depth).drop("_at", *[f"_l{k}" for k in range(1, 10)])


def list_references(blocks: DataFrame, styles: DataFrame) -> DataFrame:
    """Paragraphs with a list: their own reference, else the nearest in their style's chain; one to list 0 or below is none."""
    fonts = style_fonts(styles).select("doc_id", "style_id", "num_id", "num_level")
    normal = default_styles(styles).filter("kind = 'paragraph'").select("doc_id", F.col("style_id").alias("_normal"))
    at = blocks.filter("node_type = 'Paragraph'").join(normal, "doc_id", "left").withColumn("style_id", F.coalesce("style_id", "_normal")).join(fonts, ["doc_id", "style_id"], "left")
    level = F.when(F.col("list_id").isNotNull(), F.col("level")).otherwise(F.col("num_level"))
    return at.select("doc_id", "path", F.coalesce("list_id", "num_id").alias("list_id"), F.coalesce(level, F.lit(0)).alias("level")).filter("list_id > 0")


BULLETS = (23, 255)
# The numerals.
NUMERALS = [(1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]


def numbered(n: int, style: int) -> str:
    """A counter in a list number style, as scalars.format_number does."""
    if style in (1, 2):
        out, left = "", max(n, 0)
        for value, sign in NUMERALS:
            out, left = out + sign * (left // value), left % value
        return out if style == 1 else out.lower()
    if style in (3, 4):
        out = ""
        while n > 0:
            n, digit = divmod(n - 1, 26)
            out = chr(97 + digit) + out
        return out.upper() if style == 3 else out
    return str(n)


_PLACE = re.compile("%([0-9])")


def _label_fold(table: pa.Table) -> pa.Table:
    """The labels of one document's items, in their order, and the levels that each shows though they have not counted."""
    counters: dict[int, dict[int, int]] = {}
    labels, uncounted = [], []
    rows = table.to_pylist()
    rows.sort(key=lambda r: r["path"])
    for r in rows:
        level, styles = r["level"], r["styles"]
        if r["number_style"] in BULLETS:
            labels.append(r["number_format"])
            uncounted.append([])
            continue
        own = counters.setdefault(r["list_id"], {})
        for deeper in [k for k in own if k > level]:
            del own[deeper]
        own[level] = own[level] + 1 if level in own else max(r["start_at"], 1)

        def shown(m: re.Match[str], own: dict[int, int] = own, r: dict = r, styles: list[int] = styles) -> str:
            k = int(m[1]) - 1
            return numbered(own.get(k, 0), styles[k] if 0 <= k < len(styles) else r["number_style"])

        text = r["number_format"] or "%1."
        labels.append(_PLACE.sub(shown, text))
        uncounted.append(sorted({int(k) - 1 for k in _PLACE.findall(text)} - set(own)))
    columns = {c: [r[c] for r in rows] for c in ("doc_id", "path", "list_id", "level")}
    kinds = (pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.int32())
    return pa.table([*(pa.array(v, k) for v, k in zip(columns.values(), kinds, strict=True)), pa.array(labels, pa.string()), pa.array(uncounted, pa.list_(pa.int32()))], [*columns, "label", "uncounted"])


def list_labels(items: DataFrame, levels: DataFrame) -> DataFrame:
    """Items (doc_id, path, list_id, level) with their label. A counter starts at its level's start, 1 at least, and
    again after any item of a shallower level; bullets show their text and move no counter; a level beyond the last is
    the last. A level without a format shows its first counter and a point. A counter is written in the style of its own
    level; one that has not counted is 0, which letters and roman numerals do not show, and ``uncounted`` has its level. A
    document's items are folded in one pass.
    """
    last = levels.groupBy("doc_id", "list_id").agg(F.max("level").alias("_last"), F.transform(F.sort_array(F.collect_list(F.struct("level", "number_style"))), lambda x: x["number_style"]).alias("styles"))
    at = items.join(last, ["doc_id", "list_id"]).withColumn("level", F.least("level", "_last")).join(levels, ["doc_id", "list_id", "level"])
    at = at.select("doc_id", "path", "list_id", "level", "number_style", "number_format", "start_at", "styles")
    return at.groupBy("doc_id").applyInArrow(_label_fold, "doc_id long, path array<int>, list_id int, level int, label string, uncounted array<int>")


def links(visible_: DataFrame, relationships: DataFrame) -> DataFrame:
    """Runs of hyperlinks with their url: the relationship's target, and the anchor behind a #."""
    rel = relationships.filter("rel_type = 'hyperlink'").select("doc_id", F.col("owner_part").alias("part_name"), "rid", "target")
    out = visible_.filter("rid is not null or anchor is not null").join(rel, ["doc_id", "part_name", "rid"], "left")
    url = F.concat(F.coalesce("target", F.lit("")), F.when(F.col("anchor").isNotNull(), F.concat(F.lit("#"), F.col("anchor"))).otherwise(F.lit("")))
    return out.select("doc_id", "part_name", "block_path", "ord", "text", url.alias("url"))


def grid(cells: DataFrame) -> DataFrame:
    """Cells that stand in the grid with their column and width: horizontally continued ones join the one before."""
    w = Window.partitionBy("doc_id", "table_path", "row").orderBy("cell")
    at = cells.withColumn("column", F.coalesce(F.sum("grid_span").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    at = at.withColumn("_first", F.sum(F.when(F.col("horizontal_merge") != 2, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return at.groupBy("doc_id", "table_path", "row", "_first").agg(F.min("cell").alias("cell"), F.min("column").alias("column"), F.sum("grid_span").cast("int").alias("width"), F.count(F.lit(1)).cast("int").alias("merged")).drop("_first")


def bookmarks(inlines: DataFrame) -> DataFrame:
    """(doc_id, name, start_path, end_path): ends are matched by id with the latest start before them; _GoBack is left out."""
    spot = F.struct("block_path", "ord")
    start = inlines.filter("kind = 'BookmarkStart'").select("doc_id", "ident", F.col("text").alias("name"), spot.alias("s"))
    end = inlines.filter("kind = 'BookmarkEnd'").select("doc_id", "ident", spot.alias("e"))
    both = end.join(start, ["doc_id", "ident"]).filter("s < e").groupBy("doc_id", "ident", "e").agg(F.max(F.struct("s", "name")).alias("m"))
    return both.filter(~F.col("m.name").startswith("_GoBack")).select("doc_id", "m.name", F.col("m.s.block_path").alias("start_path"), F.col("e.block_path").alias("end_path"))


def comment_tree(stories: DataFrame, threads: DataFrame) -> DataFrame:
    """Comments with the comment they answer (one level) and whether they are done: anything but a literal 0."""
    c = stories.filter("kind = 'comment'").select("doc_id", F.col("identifier").alias("comment_id"), "author", "text", "para_id")
    parent = c.select("doc_id", F.col("para_id").alias("parent_para_id"), F.col("comment_id").alias("parent_id"))
    return c.join(threads, ["doc_id", "para_id"], "left").join(parent, ["doc_id", "parent_para_id"], "left").select("doc_id", "comment_id", "author", "text", "parent_id", F.coalesce(F.col("done_raw") != "0", F.lit(False)).alias("done"))


def anchor_faults(inlines: DataFrame, stories: DataFrame) -> DataFrame:
    """(doc_id, kind, identifier, fault): references without a story, and stories without a reference."""
    kind = F.when(F.col("kind") == "CommentMarker", "comment").otherwise(F.regexp_replace("text", "Reference", ""))
    refs = inlines.filter(F.col("kind").isin("NoteReference", "CommentMarker")).select("doc_id", kind.alias("kind"), F.col("ident").alias("identifier"))
    own = stories.select("doc_id", "kind", "identifier")
    keys = ["doc_id", "kind", "identifier"]
    a = refs.distinct().join(own, keys, "left_anti").withColumn("fault", F.lit("missing_story"))
    return a.unionByName(own.distinct().join(refs, keys, "left_anti").withColumn("fault", F.lit("unreferenced_story")))


def part_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, part_name, change): added, modified, removed or unchanged, by the parts' SHA-256."""
    b = before.select("doc_id", "part_name", F.col("sha256").alias("old"))
    a = after.select("doc_id", "part_name", F.col("sha256").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "unchanged").otherwise("modified")
    return b.join(a, ["doc_id", "part_name"], "full").select("doc_id", "part_name", change.alias("change"))


def reachable_parts(relationships: DataFrame, start: str | None = None) -> DataFrame:
    """(doc_id, part_name): parts reached from a part, the main one unless named, over internal relationships, itself
    included. A package's relationships are walked together."""
    def walk(table: pa.Table) -> pa.Table:
        doc = table.column("doc_id")[0].as_py()
        edges: dict[str, list[str]] = {}
        first = {start} if start else set()
        for owner, target, role in zip(*(table.column(c).to_pylist() for c in ("owner_part", "target", "owner_role")), strict=True):
            edges.setdefault(owner, []).append(target)
            if not start and role == "main":
                first.add(owner)
        found, todo = set(first), list(first)
        while todo:
            for t in edges.get(todo.pop(), ()):
                if t not in found:
                    found.add(t)
                    todo.append(t)
        return pa.table({"doc_id": pa.array([doc] * len(found), pa.int64()), "part_name": pa.array(sorted(found), pa.string())})

    rel = relationships.filter("not external and target is not null").select("doc_id", "owner_part", "target", "owner_role")
    return rel.groupBy("doc_id").applyInArrow(walk, "doc_id long, part_name string")


def pure_page_breaks(visible_: DataFrame, images: DataFrame) -> DataFrame:
    """(doc_id, part_name, block_path) of paragraphs with form feeds and otherwise only blanks, and without pictures."""
    shown = visible_.filter(~F.coalesce("vanish", F.lit(False))).groupBy("doc_id", "part_name", "block_path")
    texts = shown.agg(F.max(F.col("text").contains("\f")).alias("feed"), F.max(F.trim(F.translate("text", "\f\n\r\t\x0b", "")) != "").alias("ink")).filter("feed and not ink")
    return texts.select("doc_id", "part_name", "block_path").join(images.select("doc_id", "part_name", "block_path"), ["doc_id", "part_name", "block_path"], "left_anti")
