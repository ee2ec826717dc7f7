"""The tree of a part's elements by intervals: children, ancestors and descendants by joins and windows, no paths, no UDFs.

An element numbered ``first`` holds exactly those numbered first + 1 to last. Pairs of an ancestor and a descendant are
a range join on these numbers, cut into bins so that it is an equi-join whose work follows the size of the answer;
counts need no join at all: they are differences of running totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = ("doc_id", "part_name")
#: Elements in a bin of the range join.
BIN = 256


def nodes(elements: DataFrame) -> DataFrame:
    """The elements that are nodes: no declarations, nor what is inside them."""
    return elements.filter("not property")


def of_kind(kind: str | None) -> Column:
    """Whether a node is of a kind; any is, for None."""
    return F.lit(True) if kind is None else F.col("kind") == kind


def children(elements: DataFrame, kind: str | None = None) -> DataFrame:
    """Pairs (node, child) of nodes and their direct children of a kind, numbered in order from 0 by place_in_kind."""
    c = nodes(elements).filter(of_kind(kind)).filter("parent is not null")
    place = F.row_number().over(Window.partitionBy(*PART, "parent").orderBy("first")) - 1
    return c.select(*PART, F.col("parent").alias("node"), F.col("first").alias("child"), "kind", "tag", place.cast("int").alias("place_in_kind"))


def descendants(elements: DataFrame, above: DataFrame, kind: str | None = None) -> DataFrame:
    """Pairs (node, descendant) of the nodes in ``above`` (doc_id, part_name, first, last) and all of a kind below them.

    A node stands in each bin that its interval touches, a descendant in one, so pairs meet once.
    """
    a = above.select(*PART, F.col("first").alias("node"), F.col("last").alias("_last"), F.explode(F.sequence(F.floor(F.col("first") / BIN), F.floor(F.col("last") / BIN))).alias("_bin"))
    d = nodes(elements).filter(of_kind(kind)).select(*PART, F.col("first").alias("descendant"), "depth", "kind", "tag", "text", F.floor(F.col("first") / BIN).alias("_bin"))
    return a.join(d, [*PART, "_bin"]).filter((F.col("descendant") > F.col("node")) & (F.col("descendant") <= F.col("_last"))).drop("_bin", "_last")


def ancestors(elements: DataFrame, below: DataFrame, kind: str | None = None) -> DataFrame:
    """Pairs (node, ancestor) of the nodes in ``below`` and all of a kind above them, ``up`` counting from 1 for the nearest."""
    a = nodes(elements).filter(of_kind(kind))
    pairs = descendants(elements, a).join(below.select(*PART, F.col("first").alias("descendant")), [*PART, "descendant"], "left_semi")
    up = F.row_number().over(Window.partitionBy(*PART, "descendant").orderBy(F.col("node").desc()))
    return pairs.select(*PART, F.col("descendant").alias("node"), F.col("node").alias("ancestor"), up.cast("int").alias("up"))


def subtree_counts(elements: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Every node with how many nodes of each kind are below it: totals up to its last less totals up to itself."""
    w = Window.partitionBy(*PART).orderBy("first")
    totals = [F.sum(F.when((F.col("kind") == k) & ~F.col("property"), 1).otherwise(0)).over(w).alias(f"_n{i}") for i, k in enumerate(kinds)]
    at = elements.select(*PART, "first", "last", "kind", "property", *totals)
    end = at.select(*PART, F.col("first").alias("last"), *[F.col(f"_n{i}").alias(f"_e{i}") for i in range(len(kinds))])
    full = at.filter("not property").join(end, [*PART, "last"])
    return full.select(*PART, F.col("first").alias("node"), "kind", *[(F.col(f"_e{i}") - F.col(f"_n{i}")).alias(k) for i, k in enumerate(kinds)])


def texts(elements: DataFrame, above: DataFrame) -> DataFrame:
    """(doc_id, part_name, node, text): the text elements below each node, joined in order; empty where there are none."""
    t = descendants(elements, above).filter("tag = 't'").groupBy(*PART, "node").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("descendant", "text"))), lambda x: x["text"]), "").alias("text"))
    return above.select(*PART, F.col("first").alias("node")).join(t, [*PART, "node"], "left").select(*PART, "node", F.coalesce("text", F.lit("")).alias("text"))
