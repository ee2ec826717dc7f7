"""Notes and comments as tables: what is wrong with their marks, which relationships count, dates and modern metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


# ------------------------------------------------------------------------------------------------ marks
def annotation_id(raw: Column) -> Column:
    """The number of an annotation: decimal digits with or without a sign, blanks around; null for anything else."""
    lexical = F.btrim(raw, F.lit(" \t\n\r\x0b\x0c"))
    return F.when((F.translate(F.regexp_replace(lexical, "^[+-]", ""), "0123456789", "") == "") & (F.regexp_replace(lexical, "^[+-]", "") != ""), lexical.try_cast("decimal(38,0)"))


def _identifier(kind: Column, ident: Column) -> Column:
    note = kind.isin("footnoteReference", "endnoteReference")
    return F.when(note, S.note_id(F.coalesce(ident, F.lit(""))).cast("string")).when(kind.isin("start", "end", "reference"), annotation_id(ident).cast("string"))


def unreached_marks(marks: DataFrame) -> DataFrame:
    """(doc_id, kind, identifier, missing): marks that a package holds more often than reading comes to: the difference of
    two multisets, by number for those that have one."""
    keyed = marks.withColumn("identifier", _identifier(F.col("kind"), F.col("ident")))
    n = keyed.groupBy("doc_id", "kind", "identifier").agg(F.count(F.lit(1)).alias("held"), F.count_if("reached").alias("read"))
    return n.filter("held > read").select("doc_id", "kind", "identifier", (F.col("held") - F.col("read")).alias("missing"))


def comment_faults(marks: DataFrame, stories: DataFrame, threads: DataFrame) -> DataFrame:
    """(doc_id, identifier, fault) of comments. Of stories: duplicate_story, anchor_inside, invalid_identifier. Of marks in
    the body: annotation_outside, missing_story, duplicate_anchor, incomplete_range, reversed_range. Of replies:
    nested_reply, missing_ancestor."""
    number = annotation_id(F.col("identifier")).cast("string")
    own = stories.filter("kind = 'comment'").select("doc_id", number.alias("n"), "identifier", F.upper("para_id").alias("para_id"))
    out = [
        own.filter("n is null").select("doc_id", "identifier", F.lit("invalid_identifier").alias("fault")),
        own.filter("n is not null").groupBy("doc_id", "n").count().filter("count > 1").select("doc_id", F.col("n").alias("identifier"), F.lit("duplicate_story").alias("fault"))]
    m = marks.filter("reached").withColumn("n", _identifier(F.col("kind"), F.col("ident")))
    inside = m.filter("story_kind = 'comment' and kind in ('start', 'end', 'reference')")
    out.append(inside.select("doc_id", annotation_id(F.col("story_id")).cast("string").alias("identifier"), F.lit("anchor_inside").alias("fault")).distinct())
    body = m.filter("story_kind is null")
    out.append(body.filter("kind = 'annotation'").select("doc_id", F.lit(None).cast("string").alias("identifier"), F.lit("annotation_outside").alias("fault")).distinct())
    anchors = body.filter("kind in ('start', 'end', 'reference')")
    known = own.filter("n is not null").select("doc_id", "n").distinct()
    out.append(anchors.join(known, ["doc_id", "n"], "left_anti").select("doc_id", F.coalesce("n", "ident").alias("identifier"), F.lit("missing_story").alias("fault")).distinct())
    # of each comment: how often each kind of mark stands, and where first; parts are read in the package's order
    first = lambda k: F.min(F.when(F.col("kind") == k, F.struct("part_name", "place"))).alias(k)
    times = lambda k: F.count_if(F.col("kind") == k).alias(f"n_{k}")
    kinds = ("start", "end", "reference")
    each = anchors.join(known, ["doc_id", "n"], "left_semi").groupBy("doc_id", "n").agg(*map(first, kinds), *map(times, kinds))
    checks = {
        "duplicate_anchor": F.greatest(*[F.col(f"n_{k}") for k in kinds]) > 1,
        "incomplete_range": (F.col("n_reference") == 0) | ((F.col("n_start") > 0) != (F.col("n_end") > 0)),
        "reversed_range": F.coalesce(F.col("start") > F.col("end"), F.lit(False))}
    found = F.array_compact(F.array(*[F.when(c, name) for name, c in checks.items()]))
    out.append(each.select("doc_id", F.col("n").alias("identifier"), F.explode(found).alias("fault")))
    # replies go one level deep
    records = threads.select("doc_id", F.upper("para_id").alias("para_id"), F.upper("parent_para_id").alias("parent_para_id"))
    replies = records.filter("parent_para_id is not null")
    place = own.filter("n is not null and para_id is not null")
    up = replies.join(place.select("doc_id", "para_id", "n"), ["doc_id", "para_id"])
    parents = place.select("doc_id", F.col("para_id").alias("parent_para_id"), F.col("n").alias("parent"))
    out.append(up.join(parents, ["doc_id", "parent_para_id"], "left_anti").select("doc_id", F.col("n").alias("identifier"), F.lit("missing_ancestor").alias("fault")))
    deeper = replies.select("doc_id", F.col("para_id").alias("parent_para_id"))
    nested = up.join(deeper, ["doc_id", "parent_para_id"], "left_semi").unionByName(up.filter("para_id = parent_para_id")).distinct()
    out.append(nested.select("doc_id", F.col("n").alias("identifier"), F.lit("nested_reply").alias("fault")))
    all_ = out[0]
    for f in out[1:]:
        all_ = all_.unionByName(f)
    return all_


def crossed_ranges(marks: DataFrame) -> DataFrame:
    """(doc_id, identifier, other): comments whose ranges overlap without one holding the other, the earlier one first.

    Ranges of a part are ordered by their start; one crosses those that start inside it and end behind it.
    """
    m = marks.filter("reached and story_kind is null and kind in ('start', 'end')").withColumn("n", _identifier(F.col("kind"), F.col("ident")))
    r = m.groupBy("doc_id", "part_name", "n").agg(F.min(F.when(F.col("kind") == "start", F.col("place"))).alias("a"), F.max(F.when(F.col("kind") == "end", F.col("place"))).alias("b")).filter("a < b")
    x, y = (r.select("doc_id", "part_name", F.col("n").alias(f"n{k}"), F.col("a").alias(f"a{k}"), F.col("b").alias(f"b{k}")) for k in (1, 2))
    bins = lambda df, k, low, high: df.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(low) / 64), F.floor(F.col(high) / 64))))
    # the second's start lies in the first: it stands in one bin, the first in those that it covers
    both = bins(x, 1, "a1", "b1").join(y.withColumn("_bin", F.floor(F.col("a2") / 64)), ["doc_id", "part_name", "_bin"])
    return both.filter("a1 < a2 and a2 < b1 and b1 < b2").select("doc_id", F.col("n1").alias("identifier"), F.col("n2").alias("other"))


# ------------------------------------------------------------------------------------------------ relationships
def selected_relationships(relationships: DataFrame) -> DataFrame:
    """relationships with one row an id, the last of it, and ``rank``: the order by the code units of ids in UTF-16."""
    last = relationships.filter("rid is not null and rid <> ''").groupBy("doc_id", "owner_part", "rid").agg(F.max_by(F.struct("rel_type", "type_uri", "target", "external", "owner_role", "ord"), "ord").alias("r"))
    w = Window.partitionBy("doc_id", "owner_part").orderBy(F.encode("rid", "UTF-16BE"))
    return last.select("doc_id", "owner_part", "rid", "r.*", F.row_number().over(w).alias("rank"))


# ------------------------------------------------------------------------------------------------ dates
def _offset(zone: Column) -> Column:
    """Minutes of an offset: Z is none, else a sign and hours, with two digits of minutes behind a third digit or a colon;
    null for anything else, for 60 minutes and for more than 14 hours."""
    number = F.substring(zone, 2, 10)
    digits = F.replace(number, F.lit(":"), F.lit(""))
    parted = number.contains(":")
    tail = F.when(parted, F.length(F.substring_index(number, ":", -1))).otherwise(F.when(F.length(number) > 2, 2).otherwise(0))
    hours = F.substring(digits, F.lit(1), F.length(digits) - tail).try_cast("int")
    minutes = F.when(tail == 0, 0).otherwise(F.substring(digits, F.length(digits) - tail + 1, tail).try_cast("int"))
    shape = F.translate(number, "123456789", "000000000")
    fits = F.substring(zone, 1, 1).isin("+", "-") & shape.isin("0", "00", "000", "0000", "0:0", "0:00", "00:0", "00:00")
    total = hours * 60 + minutes
    return F.when(F.lower(zone) == "z", 0).when(fits & (minutes < 60) & (total <= 14 * 60), F.when(zone.startswith("-"), -total).otherwise(total))


def parsed_date(raw: Column) -> Column:
    """(wall, tick, zone): the clock reading of a comment's date as a timestamp without zone, its seventh decimal, and the
    offset in minutes; null for what is no date. A day alone is its start; the eighth decimal rounds."""
    def fields(t: Column) -> Column:
        shape, rest = F.translate(t, "123456789", "000000000"), F.substring(t, F.lit(20), F.length(t))
        day_only = shape == "0000-00-00"
        timed = shape.startswith("0000-00-00") & F.lower(F.substring(t, 11, 1)).isin("t", " ") & (F.substring(shape, 12, 8) == "00:00:00")
        digits = F.when(rest.startswith("."), F.regexp_extract(rest, "^[.]([0-9]+)", 1)).otherwise("")
        zone = F.when(digits != "", F.substring(rest, F.length(digits) + 2, F.length(rest))).otherwise(rest)
        good = day_only | (timed & ((zone == "") | _offset(zone).isNotNull()))
        ticks = F.coalesce(F.rpad(F.substring(digits, 1, 7), 7, "0").try_cast("int"), F.lit(0)) + F.when(F.substring(digits, 8, 1) >= "5", 1).otherwise(0)
        clock = F.concat(F.substring(t, 1, 10), F.lit(" "), F.when(day_only, "00:00:00").otherwise(F.substring(t, 12, 8))).try_cast("timestamp_ntz")
        wall = clock + F.make_dt_interval(secs=(F.floor(ticks / 10) / F.lit(1000000)).cast("decimal(18,6)"))
        return F.when(good & clock.isNotNull(), F.struct(wall.alias("wall"), (ticks % 10).alias("tick"), F.when(~day_only & (zone != ""), _offset(zone)).alias("zone")))

    return S.let(F.btrim(raw, F.lit(" \t\n\r\x0b\x0c")), fields)


def from_zone(wall: Column, zone: str) -> Column:
    """A clock reading of a zone in UTC; one that the clock shows twice is of standard time."""
    first = F.convert_timezone(F.lit(zone), F.lit("UTC"), wall)
    later = first + F.make_dt_interval(hours=F.lit(1))
    return F.when(F.convert_timezone(F.lit("UTC"), F.lit(zone), later) == wall, later).otherwise(first)


def utc_date(raw: Column) -> Column:
    """A modern record's date as a timestamp without zone that means UTC: its reading less its offset; none is UTC already."""
    return S.let(parsed_date(raw), lambda d: d["wall"] - F.make_dt_interval(mins=F.coalesce(d["zone"], F.lit(0))))


def _records(records: DataFrame, relationships: DataFrame) -> DataFrame:
    """The records of the parts that count: of each kind the part of the first relationship of its type, if its root fits."""
    # Types of the relationships.
    types = {
        "http://schemas.microsoft.com/office/2016/09/relationships/commentsIds": "commentsIds",
        "http://schemas.microsoft.com/office/2018/08/relationships/commentsExtensible": "commentsExtensible"}
    kind = F.try_element_at(F.create_map(*[F.lit(x) for k, v in types.items() for x in (k, v)]), F.col("type_uri"))
    links = selected_relationships(relationships.filter("owner_role = 'main'")).withColumn("kind", kind).filter("kind is not null and target is not null and target <> ''")
    parts = links.groupBy("doc_id", "kind").agg(F.min_by("target", "rank").alias("part_name"))
    return records.join(parts, ["doc_id", "kind", "part_name"], "left_semi")


def comment_dates(paragraphs: DataFrame, records: DataFrame, relationships: DataFrame, zone: str) -> DataFrame:
    """(doc_id, comment_id, date_utc, modern): when each comment was made, in UTC.

    A comment's paragraphs lead to an id record (of those with an id that one of its paragraphs has, the one that is last
    after later ones took the place of earlier ones of the same paragraph), that one's durable id to the last record of
    it, which holds the date. Without one, the comment's own date counts: its reading is of ``zone``, whatever offset it
    names. Null for neither.
    """
    held = _records(records, relationships)
    ids = held.filter("kind = 'commentsIds'").select("doc_id", S.paragraph_id(F.col("para_id")).alias("pid"), _durable(F.col("durable_id")).alias("did"), "ord").filter("pid is not null")
    ids = ids.groupBy("doc_id", "pid").agg(F.max(F.struct("ord", "did")).alias("r"))
    ext = held.filter("kind = 'commentsExtensible'").select("doc_id", _durable(F.col("durable_id")).alias("did"), "ord", "date_utc").groupBy("doc_id", "did").agg(F.max_by("date_utc", "ord").alias("raw"))
    own = paragraphs.select("doc_id", F.col("identifier").alias("comment_id"), S.paragraph_id(F.col("para_id")).alias("pid"), "date")
    link = own.join(ids, ["doc_id", "pid"], "left").groupBy("doc_id", "comment_id").agg(F.max("r").alias("r"), F.first("date").alias("date"))
    full = link.withColumn("did", F.col("r.did")).join(ext, ["doc_id", "did"], "left").withColumn("modern", utc_date(F.col("raw")))
    wall = parsed_date(F.col("date"))["wall"]
    local = from_zone(wall, zone)
    return full.select("doc_id", "comment_id", F.coalesce("modern", local).alias("date_utc"), F.col("modern").isNotNull().alias("modern"))


def _durable(raw: Column) -> Column:
    """A durable id: 0 if there is none, 0x80000000 for one that is no number."""
    return F.when(raw.isNull(), F.lit(0)).otherwise(F.coalesce(S.hexadecimal_id(raw), F.lit(0x80000000))).cast("bigint")
