"""Results as folders: tables as Parquet or CSV, and a JSON file of facts beside them.

Spark commits a table as a whole.  Facts are written last, so a bundle with facts is a whole one.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillspark.operators.ranking import numbered


def write_facts(spark: SparkSession, path: str, facts: Mapping) -> None:
    """A small JSON file through the file system that Spark writes to; a half-written one is never seen."""
    conf = spark._jsc.hadoopConfiguration()
    final, draft = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.part"))
    fs = final.getFileSystem(conf)
    out = fs.create(draft, True)
    try:
        out.write(bytearray(json.dumps(facts, ensure_ascii=False, default=str, indent=1).encode()))
    finally:
        out.close()
    fs.delete(final, False)
    if not fs.rename(draft, final):
        raise OSError(f"cannot rename {path}.part")


def read_facts(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def write_bundle(path: str, tables: Mapping[str, DataFrame], facts: Mapping | None = None, kind: str = "parquet") -> None:
    """``<path>/<name>`` for each table, over what was there, and ``<path>/facts.json``."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        w.parquet(f"{path}/{name}") if kind == "parquet" else w.option("header", True).option("encoding", "UTF-8").csv(f"{path}/{name}")
    write_facts(spark, f"{path}/facts.json", {"tables": {n: df.columns for n, df in tables.items()}, **(facts or {})})


def write_accepted(path: str, outcome, rules, lineage: Mapping | None = None) -> None:
    """An accepted table with its stages, its dictionary of fields and where it comes from."""
    if not outcome.accepted:
        raise ValueError("the table was not accepted")
    fields = [{"name": f.name, "kind": f.dataType.simpleString(), "required": not f.nullable, **f.metadata} for f in rules if f.name in outcome.rows.columns]
    stages = [{"stage": s.name, "ok": s.ok, "errors": s.errors, "facts": s.facts} for s in outcome.stages]
    write_bundle(path, {"rows": outcome.rows}, {"grade": outcome.grade, "stages": stages, "fields": fields, "lineage": dict(lineage or {})})


def graph_tables(triples: DataFrame) -> dict[str, DataFrame]:
    """relations (each once, with its smallest evidence), entities (E0001 on by name, with the largest of their types) and occurrences.

    ``triples``: source, source_type, relation, target, target_type, evidence, chunk_id.
    """
    key = ["source", "relation", "target"]
    relations = triples.groupBy(*key).agg(F.min(F.struct("evidence", "source_type", "target_type")).alias("b")).select(*key, "b.source_type", "b.target_type", "b.evidence")
    ends = triples.select(F.inline(F.array(F.struct(F.col("source").alias("name"), F.col("source_type").alias("type")), F.struct(F.col("target").alias("name"), F.col("target_type").alias("type")))))
    names = ends.groupBy("name").agg(F.max("type").alias("type"))
    entities = numbered(names, [F.col("name")], "n").select(F.format_string("E%04d", "n").alias("entity_id"), "name", "type")
    return {"relations": relations, "entities": entities, "occurrences": triples.select(*key, "chunk_id").where("chunk_id is not null").distinct()}


def predictions(frames: Mapping[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """All models' predictions in one table: the columns that a model lacks are null."""
    out = None
    for model, df in frames.items():
        part = df.withColumn("model", F.lit(model))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.select("model", *keys, *(c for c in out.columns if c not in ("model", *keys)))
