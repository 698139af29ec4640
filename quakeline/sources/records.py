"""Readers of node and edge files: YAML lists, several sources, bad records as problems instead of failures."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeline.functions.scalars import RELATIONS, edge_id
from quakeline.operators.documents import RULINGS

EVIDENCE = "array<struct<url:string,note:string,accessed:date,verified:boolean,span:struct<section:string,start:int,end:int>>>"
_RAW = "file string, n int, kind string, record string, message string"
_NODE = "struct<id:string,type:string,label:string,aliases:array<string>,group:string,ticker:string,country:string,ids:map<string,string>,kind:string,query:string>"
_EDGE = f"struct<src:string,rel:string,dst:string,weight:double,weight_source:string,polarity:int,confidence:double,valid_from:date,valid_to:date,evidence:{EVIDENCE}>"
# The fields of each record; any other is an error.
NODE_FIELDS = frozenset("id type label aliases group ticker country ids kind query".split())
EDGE_FIELDS = frozenset("src rel dst weight weight_source polarity confidence valid_from valid_to evidence".split())


def _parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import json

    import yaml

    for frame in frames:
        rows = []
        for path, content in zip(frame.path, frame.content, strict=True):
            try:
                records = yaml.safe_load(bytes(content).decode("utf-8")) or []
                if not isinstance(records, list):
                    raise ValueError("the file is no list")  # noqa: TRY301, TRY004
            except (yaml.YAMLError, ValueError) as e:
                rows.append((path, 0, "problem", None, str(e).splitlines()[0]))
                continue
            for n, r in enumerate(records):
                if not isinstance(r, dict):
                    rows.append((path, n, "problem", None, "the record is no mapping"))
                    continue
                kind, fields = ("edge", EDGE_FIELDS) if "rel" in r else ("node", NODE_FIELDS)
                needed = ("src", "rel", "dst", "weight", "valid_from") if kind == "edge" else ("id", "type", "label")
                bad = [f"unknown field {x}" for x in r if x not in fields] + [f"no {x}" for x in needed if r.get(x) is None]
                if kind == "edge" and not bad and (r["rel"] not in RELATIONS or isinstance(r["weight"], bool) or not isinstance(r["weight"], int | float)):
                    bad.append("rel or weight is not of its type")
                rows.append((path, n, "problem" if bad else kind, json.dumps(r, default=str, ensure_ascii=False), "; ".join(bad) or None))
        yield pd.DataFrame(rows, columns=["file", "n", "kind", "record", "message"])


def read_sources(spark: SparkSession, folders: dict[str, str], pattern: str = "*.y*ml") -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, edges, problems of all YAML files below each folder; every record has its source and file.

    Files are read by Spark, so a folder may be in any store. pattern "*" reads what `write_records` wrote.
    """
    parts = []
    for order, (source, folder) in enumerate(folders.items()):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
        parts.append(files.select("path", "content").mapInPandas(_parse, _RAW).withColumns({"source": F.lit(source), "source_order": F.lit(order)}))
    raw = reduce(DataFrame.unionByName, parts)
    nodes = raw.filter("kind = 'node'").select("source", "source_order", "file", "n", F.from_json("record", _NODE).alias("r")).select("r.*", "source", "source_order", "file", "n")
    edges = raw.filter("kind = 'edge'").select("source", "source_order", "file", "n", F.from_json("record", _EDGE).alias("r")).select("r.*", "source", "source_order", "file", "n")
    edges = edges.withColumns({"polarity": F.coalesce("polarity", F.lit(1)), "confidence": F.coalesce("confidence", F.lit(1.0)), "weight_source": F.coalesce("weight_source", F.lit("manual")), "evidence": F.coalesce("evidence", F.array().cast(EVIDENCE))})
    edges = edges.withColumns({"edge_id": edge_id(), "trusted": F.lit(False), "row_id": F.concat_ws("#", "file", F.lpad(F.col("n").cast("string"), 6, "0"))})
    problems = raw.filter("kind = 'problem'").select(F.lit("error").alias("severity"), F.lit("E0").alias("rule"), "file", F.coalesce("record", "file").alias("record"), "message")
    return nodes, edges, problems


#: What a YAML reader refuses or folds in a quoted text, and JSON leaves as it is.
_UNSAFE = [*range(0x7F, 0xA0), 0x2028, 0x2029, 0xFEFF, 0xFFFE, 0xFFFF]


def write_records(records: DataFrame, path: str) -> None:
    """Rows as YAML lists of flow mappings, one line each, without null fields; the files of a folder hold all of them.

    JSON is YAML but for a few characters, which are escaped; so nothing passes through Python, and `read_sources`
    reads the folder back.
    """
    line = F.to_json(F.struct(*(F.col(f"`{c}`") for c in records.columns)))
    unsafe = "[" + "".join(f"\\x{{{c:x}}}" for c in _UNSAFE) + "]"
    escaped = reduce(lambda x, c: F.replace(x, F.lit(chr(c)), F.lit(f"\\u{c:04x}")), _UNSAFE, line)
    records.select(F.concat(F.lit("- "), F.when(line.rlike(unsafe), escaped).otherwise(line)).alias("value")).write.mode("error").text(path)


_RULING = "edge string, url string, note_hash string, ruling string, date date, by string, reason string, line struct<at:timestamp,n:bigint>"


def append_rulings(rulings: DataFrame, path: str) -> None:
    """Rulings (edge, url, note_hash, ruling, date, by, reason) behind those of the ledger at path; nothing there changes.

    line tells the order: the time of the append, then that of the rows. An unknown ruling fails the append as a whole.
    """
    known = F.when(F.col("ruling").isin(*RULINGS), F.col("ruling")).otherwise(F.raise_error(F.concat(F.lit("unknown ruling "), F.coalesce("ruling", F.lit("null")))))
    line = F.struct(F.current_timestamp().alias("at"), F.monotonically_increasing_id().alias("n")).alias("line")
    rulings.select("edge", "url", "note_hash", known.alias("ruling"), "date", "by", "reason", line).write.mode("append").parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """All rulings of a ledger; `latest_rulings` gives those that hold."""
    return spark.read.schema(_RULING).parquet(path)


def first_by_id(nodes: DataFrame) -> DataFrame:
    """The node of the first source that has it."""
    from quakeline.operators.bitemporal import latest

    return latest(nodes, ["id"], F.asc("source_order"), F.asc("file"), F.asc("n"))
