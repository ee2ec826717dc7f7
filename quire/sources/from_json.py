"""Documents as JSON made into packages again: what the structured export says, read with a schema that knows every field."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .builder import DEFAULT_STYLES, packed

RUN = "struct<text: string, link: string, bold: boolean, italic: boolean, size: double>"
PARAGRAPH = f"type: string, text: string, style: string, heading_level: int, list: struct<is_list_item: boolean, list_level_number: int, list_id: int>, runs: array<{RUN}>"
CELL = f"struct<grid_span: int, horizontal_merge: int, vertical_merge: int, text: string, blocks: array<struct<{PARAGRAPH}>>>"
BLOCK = f"struct<{PARAGRAPH}, rows: array<struct<cells: array<{CELL}>>>>"
SCHEMA = f"schema_version int, blocks array<{BLOCK}>"
#: Keys that a block, a run or a cell may have; any other is a fault, as dropping it would lose what the caller gave.
KNOWN = {
    "block": ("type", "location", "text", "style", "heading_level", "list", "runs", "note_references", "images", "rows", "path"), "run": ("text", "link", "bold", "italic", "size"),
    "cell": ("grid_span", "horizontal_merge", "vertical_merge", "text", "blocks")}


def faults(documents: DataFrame, json_col: str = "json") -> DataFrame:
    """(doc_id, fault) of documents that are not imported: invalid_json, unknown_version, unknown_block, unknown_field:NAME."""
    parsed = documents.select("doc_id", F.from_json(json_col, SCHEMA).alias("d"), F.col(json_col).alias("_json"))
    loose = F.from_json("_json", "blocks array<map<string, string>>")["blocks"]
    names = F.array_distinct(F.flatten(F.transform(loose, F.map_keys)))
    runs = F.array_distinct(F.flatten(F.transform(F.filter(F.transform(loose, lambda b: F.from_json(b["runs"], "array<map<string, string>>")), lambda r: r.isNotNull()), lambda r: F.flatten(F.transform(r, F.map_keys)))))
    unknown = F.concat(F.filter(names, lambda k: ~k.isin(*KNOWN["block"])), F.filter(runs, lambda k: ~k.isin(*KNOWN["run"])))
    kinds = F.exists("d.blocks", lambda b: b["type"].isNull() | ~b["type"].isin("paragraph", "table"))
    found = F.concat(
        F.when(F.col("d").isNull() | F.col("d.blocks").isNull(), F.array(F.lit("invalid_json"))).otherwise(F.concat(
            F.when(F.coalesce(F.col("d.schema_version") != 1, F.lit(True)), F.array(F.lit("unknown_version"))).otherwise(F.array().cast("array<string>")),
            F.when(kinds, F.array(F.lit("unknown_block"))).otherwise(F.array().cast("array<string>")),
            F.transform(F.coalesce(unknown, F.array().cast("array<string>")), lambda k: F.concat(F.lit("unknown_field:"), k)))))
    return parsed.select("doc_id", F.explode(found).alias("fault"))


def _paragraph(b: dict[str, Any]) -> dict[str, Any]:
    """A block of the builder; a flag that is false or a size that is null is not declared."""
    item = b["list"] or {}
    runs = [{"t": r["text"], "link": r["link"], "b": r["bold"] or None, "i": r["italic"] or None, "size": r["size"]} for r in b["runs"] or ()]
    out: dict[str, Any] = {"style": b["style"], "runs": runs or [{"t": b["text"] or ""}]}
    if b["heading_level"] is not None and not (b["style"] or "").startswith("Heading"):
        out["outline"] = b["heading_level"] - 1
    if item.get("is_list_item"):
        out |= {"num": item["list_id"], "level": item["list_level_number"] or 0}
    return out


def _cell(c: dict[str, Any]) -> dict[str, Any]:
    # The codes of merges.
    merge = {1: "restart", 2: "continue"}
    blocks = [_paragraph(b) for b in c["blocks"] or ()] or [{"runs": [{"t": x}]} for x in (c["text"] or "").split("\n")]
    return {"blocks": blocks, "span": c["grid_span"] or 1, "hmerge": merge.get(c["horizontal_merge"]), "vmerge": merge.get(c["vertical_merge"])}


def describe(document: dict[str, Any]) -> dict[str, Any]:
    """A document of the export as the builder takes it; every list that is named is one of decimal numbers."""
    blocks = [_paragraph(b) if b["type"] == "paragraph" else {"table": [[_cell(c) for c in row["cells"] or ()] for row in b["rows"] or ()]} for b in document["blocks"]]
    lists = max([b.get("num") or 0 for b in blocks], default=0)
    named = {b.get("style") for b in blocks} - {None} - {s["id"] for s in DEFAULT_STYLES}
    return {
        "blocks": blocks, "lists": [[{"fmt": "decimal", "text": f"%{k + 1}."} for k in range(9)]] * lists, "defaults": {"size": 10},
        "styles": [*DEFAULT_STYLES, *({"id": s, "name": s, "base": "Normal"} for s in sorted(named))]}


def import_documents(documents: DataFrame, json_col: str = "json") -> DataFrame:
    """(doc_id, content): a package for each document of the export; those with faults are left out.

    Exporting it again gives the same blocks, but for what needs other parts: notes, pictures.
    """
    bad = faults(documents, json_col).select("doc_id").distinct()
    good = documents.join(bad, "doc_id", "left_anti").select(F.col("doc_id").cast("long").alias("doc_id"), F.from_json(json_col, SCHEMA).alias("d"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                rows = batch.slice(k, 64).to_pylist()
                yield pa.record_batch([pa.array([r["doc_id"] for r in rows], pa.int64()), pa.array([packed(describe(r["d"])) for r in rows], pa.binary())], ["doc_id", "content"])

    return good.mapInArrow(run, "doc_id long, content binary")
