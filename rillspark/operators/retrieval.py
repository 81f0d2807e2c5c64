"""Ranking of what a search found: fusion, relations of paths, evidence, routing, quality."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillspark.operators.ranking import top_of_each


def fused(found: DataFrame, scaled: Mapping[str, float], plain: Mapping[str, float], shortness: float, prior: Column | None = None) -> DataFrame:
    """``found`` with ``fused``: weighted scores over their highest values, plain ones as they are, and one over the edges of ``path``; times a prior."""
    top = found.agg(*(F.greatest(F.max(c), F.lit(1e-12)).alias(f"__{c}") for c in scaled))  # one row
    score = sum((F.lit(w) * F.col(c) / F.col(f"__{c}") for c, w in scaled.items()), F.lit(0.0)) + sum((F.lit(w) * F.col(c) for c, w in plain.items()), F.lit(0.0)) + shortness / (F.size("path") - 1)
    return found.crossJoin(F.broadcast(top)).withColumn("fused", score * (F.lit(1.0) if prior is None else prior)).drop(*(f"__{c}" for c in scaled))


def relations_of(paths: DataFrame, path: str, name: str, score: str, most: int) -> DataFrame:
    """u, v of the edges of paths, each once with its best path, in the order of the paths; ``most`` of them."""
    steps = paths.select(name, score, F.posexplode(F.arrays_zip(F.slice(path, F.lit(1), F.size(path) - 1).alias("x"), F.slice(path, F.lit(2), F.size(path) - 1).alias("y"))).alias("i", "e"))
    ends = steps.select(F.least("e.x", "e.y").alias("u"), F.greatest("e.x", "e.y").alias("v"), score, name, "i")
    return top_of_each(ends, ["u", "v"], [F.desc(score), F.col(name), F.col("i")], 1).orderBy(F.desc(score), name, "i").limit(most)


def with_chunks(occurrences: DataFrame, relation: list[str], chunk: str, ordinal: str, most: int = 2) -> DataFrame:
    """Each relation with the first ``most`` distinct chunks that it occurs in, as a text."""
    once = occurrences.groupBy(*relation, chunk).agg(F.min(ordinal).alias(ordinal))
    few = top_of_each(once, relation, [F.col(ordinal), F.col(chunk)], most)
    return few.groupBy(*relation).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", chunk))), lambda x: x[chunk].cast("string")), "|").alias("chunks"))


def backfilled(first: DataFrame, rest: DataFrame, key: str, order: list[Column], most: int) -> DataFrame:
    """``first`` (few rows) in its order, then ``rest`` source by source (column origin) in turns, each key once; ``most`` rows in all."""
    a = first.withColumn("origin", F.lit("path")).withColumn("rank", F.row_number().over(Window.orderBy(*order))).withColumn("tier", F.lit(0))  # few rows
    b = top_of_each(rest, ["origin"], order, most).withColumn("tier", F.lit(1))
    both = a.unionByName(b)
    seq = [F.col("tier"), F.col("rank"), F.col("origin")]
    return both.withColumn("__c", F.row_number().over(Window.partitionBy(key).orderBy(*seq))).where("__c = 1").orderBy(*seq, key).limit(most).drop("__c")


def route(n_seeds: Column, broad: Column) -> Column:
    """local, global, hybrid or none, by what a question names and whether it asks broadly."""
    return F.when((n_seeds == 0) & ~broad, "none").when(broad & (n_seeds == 0), "global").when(broad, "hybrid").otherwise("local")


def community_digests(near: DataFrame, labels: DataFrame, most: int, chars: int) -> DataFrame:
    """rank, label, size and summary (names by degree, cut to ``chars``) of the largest communities.

    Only ``chars`` names of a community can be in its summary, so no more are brought together.
    """
    degree = near.groupBy("node").agg(F.count("*").alias("k"))
    sizes = labels.groupBy("label").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "label").limit(most)  # few rows
    named = labels.join(F.broadcast(sizes), "label").join(degree, "node")
    few = top_of_each(named.select("label", "size", "node", "k"), ["label"], [F.desc("k"), F.col("node")], chars)
    names = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "node"))), lambda x: x["node"].cast("string")), ", ")
    out = few.groupBy("label", "size").agg(F.substring(names, 1, chars).alias("summary"))
    return out.select(F.row_number().over(Window.orderBy(F.desc("size"), "label")).cast("long").alias("rank"), "label", "size", "summary")


def containing(items: DataFrame, item: str, docs: DataFrame, doc: str, text: str) -> DataFrame:
    """item, doc of all documents that hold an item's whole text, without case.

    An item meets only documents with the rarest of its inner words.
    """
    i = items.where(F.length(text) > 0).select(item, F.lower(text).alias("__item"))
    # words between two others: in a document that holds the item they are whole words too
    inner = F.slice(F.split("__item", "[^a-z]+"), F.lit(2), F.greatest(F.size(F.split("__item", "[^a-z]+")) - 2, F.lit(0)))
    asked = i.select(item, "__item", F.explode_outer(F.filter(F.array_distinct(inner), lambda w: w != "")).alias("w"))
    d = docs.select(doc, F.explode(F.array_distinct(F.split(F.lower(text), "[^a-z]+"))).alias("w"))
    frequency = d.join(asked.select("w").distinct(), "w", "left_semi").groupBy("w").agg(F.count("*").alias("df"))
    rare = top_of_each(asked.where("w is not null").join(frequency, "w", "left").withColumn("df", F.coalesce("df", F.lit(0))), [item], [F.col("df"), F.col("w")], 1)
    texts = docs.select(doc, F.lower(text).alias("__doc"))
    pairs = d.join(rare.select(item, "__item", "w"), "w").join(texts, doc).select(item, "__item", doc, "__doc")
    # an item of one or two words has no inner word and meets all documents
    short = texts.join(asked.where("w is null").select(item, "__item"), F.contains("__doc", "__item")).select(item, "__item", doc, "__doc")
    return pairs.unionByName(short).where(F.contains("__doc", "__item")).select(item, doc).distinct()


def quality(ranked: DataFrame, gold: DataFrame, query: str, answer: str, k: int) -> DataFrame:
    """One row: questions with a right answer, mean share of their right answers among the first ``k``, mean reciprocal rank."""
    hit = gold.join(ranked.where(F.col("rank") <= k), [query, answer], "left")
    each = hit.groupBy(query).agg(F.avg(F.col("rank").isNotNull().cast("double")).alias("recall"), F.coalesce(1 / F.min("rank"), F.lit(0.0)).alias("rr"))
    return each.agg(F.count("*").alias("questions"), F.avg("recall").alias("recall"), F.avg("rr").alias("mrr"))


def in_order(tokens: Column, wanted: Column) -> Column:
    """Whether all wanted tokens stand among the tokens in their order, with others between them or not."""
    place = F.aggregate(wanted, F.lit(0), lambda p, w: F.when(p < 0, F.lit(-1)).otherwise(_after(tokens, p, w)))
    return place > 0


def _after(tokens: Column, p: Column, w: Column) -> Column:
    at = F.array_position(F.slice(tokens, p + 1, F.greatest(F.size(tokens) - p, F.lit(0))), w).cast("int")
    return F.when(at > 0, p + at).otherwise(-1)


def triggered(questions: DataFrame, keys: list[str], text: str, vocabulary: DataFrame) -> DataFrame:
    """keys and term of the terms (term, surface) whose surface's tokens all stand in a question, in order.

    A question meets only terms whose first token it has.
    """
    split = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    v = vocabulary.select("term", split(F.col("surface")).alias("wanted")).where(F.size("wanted") > 0).withColumn("__first", F.col("wanted")[0])
    q = questions.select(*keys, split(F.col(text)).alias("tokens")).withColumn("__first", F.explode(F.array_distinct("tokens")))
    return q.join(v, "__first").where(in_order(F.col("tokens"), F.col("wanted"))).select(*keys, "term").distinct()


def capped_with_overflow(found: DataFrame, anchor: str, order: list[Column], each: int, most: int) -> DataFrame:
    """The first ``most`` rows with at most ``each`` of an anchor; where that leaves none at all, the first ``most`` without the cap.

    ``rank`` numbers them; both kinds are limited rows, whatever ``found`` holds.
    """
    few = top_of_each(found, [anchor], order, each).drop("rank").orderBy(*order).limit(most).withColumn("capped", F.lit(0))
    rest = found.orderBy(*order).limit(most).withColumn("capped", F.lit(1))
    both = few.unionByName(rest)
    kind = both.agg(F.min("capped").alias("kind"))  # one row
    return both.join(F.broadcast(kind), F.col("capped") == F.col("kind")).withColumn("rank", F.row_number().over(Window.orderBy(*order))).drop("capped", "kind")


def link_recall(gold: DataFrame, linked: DataFrame, query: str, name: str) -> DataFrame:
    """query, link_recall: the share of a question's right names that were linked, without regard to case; questions without names have none."""
    fold = lambda d: d.where(F.col(name).isNotNull()).select(query, F.lower(name).alias("__n")).distinct()
    hit = fold(gold).join(fold(linked).withColumn("__hit", F.lit(1)), [query, "__n"], "left")
    return hit.groupBy(query).agg((F.count("__hit") / F.count("*")).alias("link_recall"))


def chain_hit(chains: DataFrame, edges: DataFrame, query: str, chain: str, u: str, v: str) -> DataFrame:
    """query, chain_hit: the share of a question's chains (arrays of nodes) whose neighbours are all joined by an edge found for it, in either direction.

    A chain of one node has no neighbours and is no hit.
    """
    numbered = chains.select(query, F.monotonically_increasing_id().alias("__c"), F.col(chain).alias("__chain"))
    pairs = numbered.select(query, "__c", F.explode_outer(F.when(F.size("__chain") > 1, F.arrays_zip(F.slice("__chain", F.lit(1), F.size("__chain") - 1).alias("a"), F.slice("__chain", F.lit(2), F.size("__chain") - 1).alias("b")))).alias("p"))
    found = edges.select(query, F.least(u, v).alias("__u"), F.greatest(u, v).alias("__v"), F.lit(1).alias("__hit")).distinct()
    met = pairs.withColumns({"__u": F.least("p.a", "p.b"), "__v": F.greatest("p.a", "p.b")}).join(found, [query, "__u", "__v"], "left")
    whole = met.groupBy(query, "__c").agg((F.count("__hit") == F.count("*")).alias("hit"))
    return whole.groupBy(query).agg(F.avg(F.col("hit").cast("double")).alias("chain_hit"))
