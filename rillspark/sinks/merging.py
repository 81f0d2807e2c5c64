"""A table that streams merge into: one row a key, whole batches or nothing, and a batch that comes again changes nothing.

Rows lie in folders by bucket of their key.  A batch writes the buckets that it touches into a folder of its own and
then a small file, its commit, which says for every bucket the folder that holds it.  The commit appears by one rename,
so readers see the table before a batch or after it.  A run that ends between the two leaves a folder that no
commit names; the same batch then writes it anew.  Batches come in rising numbers, as a stream gives them; one
that is not above the last commit is skipped.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rillspark.operators.ranking import numbered, top_of_each
from rillspark.sinks.bundles import read_facts, write_facts

BUCKETS = 32
UPDATE, KEEP = "update", "keep"


def _commits(spark: SparkSession, path: str) -> list[int]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/commits")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def _state(spark: SparkSession, path: str, batch: int | None = None) -> dict | None:
    """The commit of a batch, or the last one."""
    known = _commits(spark, path)
    if not known or batch is not None and batch not in known:
        return None
    return read_facts(spark, f"{path}/commits/{known[-1] if batch is None else batch}.json")


def _rows(spark: SparkSession, path: str, state: dict, buckets: Sequence[int] | None = None) -> DataFrame | None:
    """Rows of a state, or of some of its buckets: null if it has none of them."""
    places = [f"{path}/rows/batch={b}/bucket={k}" for k, b in state["buckets"].items() if buckets is None or int(k) in buckets]
    return spark.read.schema(state["schema"]).parquet(*places) if places else None


def read(spark: SparkSession, path: str, batch: int | None = None) -> DataFrame:
    """The table after its last batch, or after an earlier one."""
    state = _state(spark, path, batch)
    if state is None:
        raise FileNotFoundError(f"no commit in {path}")
    rows = _rows(spark, path, state)
    return spark.createDataFrame([], state["schema"]) if rows is None else rows


def merge(batch: DataFrame, batch_id: int, path: str, keys: Sequence[str], order: Sequence[Column], how: str = UPDATE, buckets: int = BUCKETS) -> bool:
    """Merges a batch; whether it was new.

    Of the rows of a key in the batch the first by ``order`` counts.  ``update`` puts it over the row that the table has, unless
    that one comes before it by ``order``; ``keep`` leaves a row that the table has.  Null keys are keys.  A batch
    must have the columns of the table; it is merged even if it is empty.
    """
    if how not in (UPDATE, KEEP):
        raise ValueError(how)
    spark = batch.sparkSession
    known = _commits(spark, path)
    if known and batch_id <= known[-1]:
        return False
    state = _state(spark, path) or {"schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema), "buckets": {}, "count": buckets, "keys": list(keys)}
    if state["keys"] != list(keys) or state["count"] != buckets:
        raise ValueError("the table has other keys or buckets")
    columns = batch.columns
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    few = top_of_each(batch, list(keys), list(order), 1).drop("rank").withColumn("bucket", bucket)
    touched = sorted(r["bucket"] for r in few.select("bucket").distinct().collect())  # ``buckets`` numbers at most
    old = _rows(spark, path, state, touched)
    both = few.withColumn("__new", F.lit(1))
    if old is not None:
        both = both.unionByName(old.select(*columns).withColumn("bucket", bucket).withColumn("__new", F.lit(0)))
        first = [F.col("__new"), *order] if how == KEEP else [*order, F.desc("__new")]
        both = top_of_each(both, list(keys), first, 1).drop("rank")
    # a bucket is as many files as tasks have rows of it; the folder of an unfinished try is overwritten
    both.select(*columns, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows/batch={batch_id}")
    state["buckets"] |= {str(k): batch_id for k in touched}
    state["batch"] = batch_id
    write_facts(spark, f"{path}/commits/{batch_id}.json", state)
    return True


def merged_stream(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], order: Sequence[Column], how: str = UPDATE, buckets: int = BUCKETS, before: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Merges all that a stream has, batch by batch, and stops."""

    def each(df: DataFrame, batch_id: int) -> None:
        merge(before(df) if before else df, batch_id, path, keys, order, how, buckets)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def vacuumed(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Removes what the last ``keep`` commits do not need; the batches whose folders went."""
    known = _commits(spark, path)
    staying = {int(b) for c in known[-keep:] for b in read_facts(spark, f"{path}/commits/{c}.json")["buckets"].values()}
    gone = [b for b in known if b not in staying and b not in known[-keep:]]
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for c in known[:-keep]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/commits/{c}.json"), False)
    for b in gone:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/rows/batch={b}"), True)
    return gone


def registered(files: DataFrame, batch_id: int, path: str, version: str = "version") -> bool:
    """Registers derived files (dataset, name, parent, content) by the hash of their content: the same content of a dataset once.

    A new content gets the next version of its dataset, in the order of names; numbers are made from the table as it was before the
    batch, so a batch that comes again gives the same ones.
    """
    spark = files.sparkSession
    hashed = files.select("dataset", "name", "parent", F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("size"))
    state = _state(spark, path)
    once = top_of_each(hashed, ["dataset", "sha256"], [F.col("name"), F.col("parent")], 1).drop("rank")
    known = read(spark, path) if state else None
    if known is not None:
        once = once.join(known.select("dataset", "sha256"), (once["dataset"].eqNullSafe(known["dataset"])) & (once["sha256"] == known["sha256"]), "left_anti")
    # all files in one order, so that no task needs the whole of a dataset; a dataset's numbers start at its first file
    placed = numbered(once, [F.col("dataset"), F.col("name"), F.col("sha256")], "__n")
    start = placed.groupBy(F.col("dataset").alias("__d")).agg(F.min("__n").alias("__first"))
    counted = placed.join(start, placed["dataset"].eqNullSafe(start["__d"])).withColumn(version, F.col("__n") - F.col("__first") + 1).drop("__n", "__d", "__first")
    if known is not None:
        last = known.groupBy(F.col("dataset").alias("__d")).agg(F.max(version).alias("__last"))
        counted = counted.join(last, counted["dataset"].eqNullSafe(last["__d"]), "left").withColumn(version, F.col(version) + F.coalesce("__last", F.lit(0))).drop("__d", "__last")
    return merge(counted, batch_id, path, ["dataset", "sha256"], [F.col("name")], KEEP)
