"""An inverted index that stays: lists of documents by term and block, with the highest weight of each list.

The index is a Parquet table in folders by bucket of the term, sorted by term inside, one row for a term and a block of
documents.  A search reads the buckets of its terms alone, and of those first only the heads (the highest weights): what a
block can reach at most for a question is the sum of its heads.  The blocks that can reach most are read whole; the
score of their ``k``-th document then rules out all blocks that cannot reach it, and only the others are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillspark.operators.ranking import top_of_each
from rillspark.session import removed, tables_so_far, written

DOCS_OF_BLOCK, BUCKETS = 4096, 64
#: Blocks of each question that are read to find a bar for the others.
FIRST_BLOCKS = 8
#: Up to so many terms are looked up by value, so that the reader can skip row groups.
LISTED_TERMS = 1000
DIGITS = 9
#: So many blocks of a bucket go to one file.
BLOCKS_OF_FILE = 512
#: Up to about so many questions meet the lists of a block in one group.
QUESTIONS_OF_GROUP = 1024


def _stored(lists: DataFrame, blocks: int, buckets: int) -> DataFrame:
    """Lists (term, block, docs, weights) written in folders by bucket of the term, sorted by term inside."""
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
    # a bucket of a common term is spread over groups of blocks
    spread = lists.repartition(bucket, F.pmod("block", F.lit(-(-blocks // BLOCKS_OF_FILE))))
    rows = spread.select(bucket.alias("bucket"), "term", "block", F.size("docs").alias("n"), F.array_max("weights").alias("top"), "docs", "weights")
    return written(rows.sortWithinPartitions("bucket", "term", "block"), "index", by=["bucket"], drop_shuffles=True)


def built(weights: DataFrame, doc: str, docs_of_block: int = DOCS_OF_BLOCK, buckets: int = BUCKETS) -> DataFrame:
    """bucket, term, block, n, top, docs, weights of postings (``doc``, term, weight), written.

    A block is a hash of the document, of about ``docs_of_block`` documents; so a row has a bounded size and a
    term that every document holds is as many rows as there are blocks.  Equal postings count once, at their highest weight.
    """
    # the postings are made once: their documents are counted on what was written
    known = written(weights.where(F.col(doc).isNotNull() & F.col("term").isNotNull()).select("term", F.col(doc).alias("doc"), "weight"), "weights", drop_shuffles=True)
    blocks = max(1, -(-known.select("doc").distinct().count() // docs_of_block))
    # equal postings meet in their list, so they need no shuffle of their own: the last of a document has its highest weight
    both = F.array_sort(F.collect_list(F.struct("doc", "weight")))
    lists = known.groupBy("term", F.pmod(F.xxhash64("doc"), F.lit(blocks)).alias("block")).agg(both.alias("all"))
    lists = lists.select("term", "block", F.filter("all", lambda x, i: (i == F.size("all") - 1) | (F.get("all", i + 1)["doc"] != x["doc"])).alias("list"))
    of = lambda c: F.transform("list", lambda x: x[c])
    return _stored(lists.select("term", "block", of("doc").alias("docs"), of("weight").alias("weights")), blocks, buckets)


def _lists(parents: np.ndarray) -> np.ndarray:
    """Offsets of lists whose values have these parents, in their order."""
    return np.append(np.flatnonzero(np.diff(parents, prepend=-1)), len(parents))


def _counted(rows: pa.Table) -> pa.Table:
    """term, block, n, docs, tfs of the documents (block, doc, terms) of a block; rows of one document count as one."""
    terms = rows["terms"].combine_chunks()
    docs, words = rows["doc"].combine_chunks().dictionary_encode(), terms.flatten().dictionary_encode()
    n = len(docs.dictionary)
    at = docs.indices.to_numpy(zero_copy_only=False)[pc.list_parent_indices(terms).to_numpy(zero_copy_only=False)]
    pairs, tf = np.unique(words.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n + at, return_counts=True)
    offsets = _lists(pairs // n)
    starts = offsets[:-1]
    ends = pa.array(offsets, pa.int32())
    return pa.table(
        {
            "term": words.dictionary.take(pa.array(pairs[starts] // n)),
            "block": pa.array(np.full(len(starts), rows["block"][0].as_py()), pa.int64()),
            "n": pa.array(np.diff(offsets), pa.int32()),
            "docs": pa.ListArray.from_arrays(ends, docs.dictionary.take(pa.array(pairs % n))),
            "tfs": pa.ListArray.from_arrays(ends, pa.array(tf, pa.int32())),
        }
    )


def _weighed(rows: pa.Table) -> pa.Table:
    """term, block, docs, weights of the lists (term, block, docs, tfs, idf) of a block: its documents have unit length."""
    lists, tfs = rows["docs"].combine_chunks(), rows["tfs"].combine_chunks()
    docs, parents = lists.flatten().dictionary_encode(), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    at = docs.indices.to_numpy(zero_copy_only=False)
    w = (1 + np.log(tfs.flatten().to_numpy(zero_copy_only=False))) * rows["idf"].to_numpy()[parents]
    w = w / np.sqrt(np.bincount(at, w * w))[at]
    return pa.table({"term": rows["term"], "block": rows["block"], "docs": lists, "weights": pa.ListArray.from_arrays(pa.array(_lists(parents), pa.int32()), pa.array(w))})


def of_texts(docs: DataFrame, doc: str, terms: Column, docs_of_block: int = DOCS_OF_BLOCK, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """An index as of :func:`built` of the weights of ``texts.tf_idf``, and (term, df) of all terms; both written.

    Texts go to the task of their block, once; there its terms are counted and its lists made, so no posting is a row of
    a shuffle.  A block's lists go to the frequencies of their terms and come back to the block, where lengths are known.
    """
    mark = tables_so_far()
    kind = docs.schema[doc].dataType.simpleString()
    ids = docs.where(F.col(doc).isNotNull())
    blocks = max(1, -(-ids.select(doc).distinct().count() // docs_of_block))
    block = F.pmod(F.xxhash64(doc), F.lit(blocks)).alias("block")
    texts = ids.select("*", block).repartition(blocks, "block").select("block", F.col(doc).alias("doc"), terms.alias("terms"))
    lists = written(texts.groupBy("block").applyInArrow(_counted, f"term string, block long, n int, docs array<{kind}>, tfs array<int>"), "lists", drop_shuffles=True)
    # rows without an id are one document of no list
    nameless = docs.where(F.col(doc).isNull()).select(F.explode(terms).alias("term")).distinct().withColumn("n", F.lit(1))
    frequencies = written(lists.select("term", "n").unionByName(nameless).groupBy("term").agg(F.sum("n").alias("df")), "frequencies", drop_shuffles=True)
    idf = F.log((1 + F.lit(docs.count())) / (1 + F.col("df"))) + 1
    known = lists.join(frequencies, "term").select("term", "block", "docs", "tfs", idf.alias("idf")).repartition(blocks, "block")
    weighed = known.groupBy("block").applyInArrow(_weighed, f"term string, block long, docs array<{kind}>, weights array<double>")
    index = _stored(weighed, blocks, buckets)
    removed(docs.sparkSession, mark, keep=[index, frequencies])
    return index, frequencies


def opened(spark: SparkSession, path: str) -> DataFrame:
    """An index that was kept at ``path``."""
    return spark.read.parquet(path)


def _of_terms(index: DataFrame, asked: DataFrame, buckets: int) -> DataFrame:
    """The rows of the index with a term of the questions; other buckets are not read."""
    # written, so that Spark knows its size and need not shuffle the index where it is small
    terms = written(asked.select("term").distinct(), "terms")
    few = terms.limit(LISTED_TERMS + 1).collect()  # a bounded number
    if len(few) <= LISTED_TERMS:
        listed = [r["term"] for r in few]
        places = [r[0] for r in terms.select(F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")).distinct().collect()]  # one row a bucket
        return index.where(F.col("bucket").isin(places) & F.col("term").isin(listed))
    return index.join(terms, "term", "left_semi")


def _best_of_block(k: int):
    def best(lists: pa.Table, asked: pa.Table) -> pa.Table:
        """query, doc, score of the ``k`` best documents of lists (term, docs, weights) of one block, for each query of ``asked`` (query, term, w)."""
        asked = asked.sort_by([("query", "ascending"), ("term", "ascending")])
        place = pc.index_in(asked["term"], value_set=lists["term"].combine_chunks())
        held = pc.is_valid(place)
        asked, place = asked.filter(held), place.filter(held).to_numpy()
        docs = lists["docs"].combine_chunks()
        ids = docs.flatten().dictionary_encode()
        at, weight, n = ids.indices.to_numpy(zero_copy_only=False), lists["weights"].combine_chunks().flatten().to_numpy(zero_copy_only=False), len(ids.dictionary)
        offsets = np.append(0, np.cumsum(docs.value_lengths().to_numpy(zero_copy_only=False)))
        by_doc = np.empty(n, np.int64)
        by_doc[pc.sort_indices(ids.dictionary).to_numpy()] = np.arange(n)
        queries = asked["query"].combine_chunks().dictionary_encode()
        bounds = _lists(queries.indices.to_numpy(zero_copy_only=False))
        w = asked["w"].to_numpy()
        of, found, scores = [], [], []
        for q, (i, j) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            spans = [slice(offsets[p], offsets[p + 1]) for p in place[i:j]]
            hits = np.concatenate([at[x] for x in spans])
            total = np.bincount(hits, np.concatenate([v * weight[x] for v, x in zip(w[i:j], spans, strict=True)]), n)
            total = np.floor(total * 10.0**DIGITS + 0.5) / 10.0**DIGITS
            some = np.flatnonzero(np.bincount(hits, minlength=n))
            some = some[np.lexsort((by_doc[some], -total[some]))[:k]]
            of.append(np.full(len(some), q)), found.append(some), scores.append(total[some])
        ints = lambda x: pa.array(np.concatenate([np.empty(0, np.int64), *x]).astype(np.int64))
        return pa.table({"query": queries.dictionary.take(ints(of)), "doc": ids.dictionary.take(ints(found)), "score": pa.array(np.concatenate([np.empty(0), *scores]))})

    return best


def searched(index: DataFrame, questions: DataFrame, query: str, k: int, buckets: int = BUCKETS, first: int = FIRST_BLOCKS) -> tuple[DataFrame, DataFrame]:
    """(query, doc, score, rank) of the best ``k`` documents of each question, and what was read.

    ``questions``: query, term, weight (positive).  A score is the sum of products of weights over shared terms,
    rounded to ``DIGITS`` digits; of equal scores the smaller document comes first.  Questions that share no term with any
    document have no rows.  The second table has for each question: blocks and postings of its terms, and how many were read.
    """
    asked = questions.where(F.col("weight") > 0).groupBy(F.col(query).alias("query"), "term").agg(F.max("weight").alias("w"))
    asked = written(asked, "asked")
    rows = _of_terms(index, asked, buckets)
    heads = written(rows.select("term", "block", "top", "n").join(asked, "term"), "heads")
    reach = written(heads.groupBy("query", "block").agg(F.sum(F.col("w") * F.col("top")).alias("reach"), F.sum("n").alias("postings")), "reach")
    groups = max(1, -(-asked.select("query").distinct().count() // QUESTIONS_OF_GROUP))
    kinds = f"query {asked.schema['query'].dataType.simpleString()}, doc {index.schema['docs'].dataType.elementType.simpleString()}, score double"

    def scores(chosen: DataFrame) -> DataFrame:
        # the questions that read a list, told by its head alone; a block's lists and questions meet, so only its best documents leave it
        told = heads.join(chosen.select("query", "block"), ["query", "block"], "left_semi").select("block", F.pmod(F.xxhash64("query"), F.lit(groups)).alias("group"), "query", "term", "w")
        lists = rows.select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group"), "term", "docs", "weights")
        best = lists.groupBy("block", "group").cogroup(told.groupBy("block", "group")).applyInArrow(_best_of_block(k), kinds)
        return top_of_each(best, ["query"], [F.desc("score"), F.col("doc")], k)

    order = [F.desc("reach"), F.col("block")]
    chosen = top_of_each(reach, ["query"], order, first)
    head = written(scores(chosen), "scores")
    bar = head.where(F.col("rank") == k).select("query", F.col("score").alias("bar"))
    # rounding may lift a score by half a last digit, and sums differ in their last bits
    able = F.col("bar").isNull() | (F.col("reach") >= F.col("bar") - 2 * 10.0**-DIGITS)
    others = written(reach.join(chosen.select("query", "block"), ["query", "block"], "left_anti").join(bar, "query", "left").where(able), "others")
    best = top_of_each(head.drop("rank").unionByName(scores(others).drop("rank")), ["query"], [F.desc("score"), F.col("doc")], k)
    counted = lambda d, name: d.groupBy("query").agg(F.count("*").alias(f"blocks_{name}"), F.sum("postings").alias(f"postings_{name}"))
    read = counted(chosen.select("query", "block", "postings").unionByName(others.select("query", "block", "postings")), "read")
    facts = counted(reach, "there").join(read, "query").select(F.col("query").alias(query), "blocks_there", "blocks_read", "postings_there", "postings_read")
    return best.select(F.col("query").alias(query), "doc", "score", "rank"), facts
