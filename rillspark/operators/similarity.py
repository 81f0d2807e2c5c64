"""Similar texts without all pairs: a join on the rarest tokens of each bag, with exact checks in columns.

A bag is a text's tokens with their multiplicities; the second "aa" of a text is a token of its own.  Two bags of
sizes m and n with a similarity of at least t must share so many tokens that, with all tokens in one order, the
first few of each (its prefix) share one.  Rare tokens come first in that order, so a token that many
bags hold is in few prefixes.  Pairs that meet, and whose sizes and places allow t, are checked on their whole bags;
those of short bags at once, where they meet, so that no table of candidates is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillspark.operators.ranking import numbered

#: Tokens of a bag that travels with its prefix, and rows of a token that meet the other side's in one part.
SHORT, MET_ROWS = 64, 1000
#: Guards the rounding of products like 0.8 * 5, which may lie just above a whole number.
HAIR = 1e-9


def padded_grams(c: Column, size: int = 2) -> Column:
    """All runs of ``size`` characters of a text with blanks on both sides, repeated ones too."""
    low = F.concat(F.lit(" " * (size - 1)), c, F.lit(" " * (size - 1)))
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - size + 1, F.lit(1))), lambda i: F.substr(low, i, F.lit(size)))


def characters(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def least_share(measure: str, least: float) -> float:
    """The share of its own tokens that a bag must find in another one, whatever the other's size."""
    if not 0 < least <= 1:
        raise ValueError("the least similarity lies above 0 and at 1 or below")
    return {"jaccard": least, "dice": least / (2 - least)}[measure]


def bags(rows: DataFrame, key: str, tokens: Column) -> DataFrame:
    """key, token, k: each token with its number among its equals, from 1."""
    counted = rows.select(F.col(key).alias("key"), F.explode(tokens).alias("token")).groupBy("key", "token").agg(F.count("*").alias("n"))
    return counted.select("key", "token", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("k"))


def _ranked(bag: DataFrame, numbers: DataFrame) -> DataFrame:
    """key, size, sorted: each bag's tokens by number, the rarest first, with the rows that hold them on either side."""
    rare = bag.join(numbers, ["token", "k"])
    return rare.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("n", "lefts", "rights"))).alias("sorted")).withColumn("size", F.size("sorted"))


def joined(left: DataFrame, right: DataFrame | None, key: str, tokens: Column, least: float, measure: str = "dice", other: str | None = None, other_tokens: Column | None = None) -> DataFrame:
    """left, right, similarity: all pairs with a similarity of ``least`` or more.

    ``measure`` is ``dice`` (twice the shared tokens by all tokens) or ``jaccard`` (shared by distinct ones, counted as
    bags).  Without ``right`` the table meets itself and a pair stands once, the smaller key on the left.  Keys are distinct.
    Null keys and rows without tokens pair with nothing.
    """
    one = bags(left.where(F.col(key).isNotNull()), key, tokens)
    two = one if right is None else bags(right.where(F.col(other or key).isNotNull()), other or key, tokens if other_tokens is None else other_tokens)
    sides = one.select("token", "k", F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(two.select("token", "k", F.lit(0).alias("l"), F.lit(1).alias("r")))
    frequency = sides.groupBy("token", "k").agg(F.sum("l").alias("lefts"), F.sum("r").alias("rights"))
    # tokens become numbers, so that a bag is a short sorted array that column functions compare fast
    numbers = numbered(frequency, [F.col("lefts") + F.col("rights"), F.col("token"), F.col("k")], "n")
    share = least_share(measure, least)
    a, b = _ranked(one, numbers), _ranked(two, numbers)
    n = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), left.sparkSession.sparkContext.defaultParallelism)

    def prefixes(d: DataFrame, name: str, *more: Column) -> DataFrame:
        """A row for each token of a bag's prefix that the other side has too, with its place in the bag, from 0."""
        most = F.greatest(F.col("size") - F.ceil(F.col("size") * share - HAIR).cast("int") + 1, F.lit(1))
        out = d.select(F.col("key").alias(name), F.col("size").alias(f"{name}_size"), *more, F.posexplode(F.slice("sorted", F.lit(1), most)).alias(f"{name}_at", "t")).where("t.lefts > 0 and t.rights > 0")
        return out.withColumns({"n": F.col("t.n"), "lefts": F.col("t.lefts"), "rights": F.col("t.rights")}).drop("t")

    def dealt(d: DataFrame, name: str, mine: str, theirs: str) -> DataFrame:
        """A token's rows in parts: those of its larger side are dealt out, those of the other side stand in each part."""
        parts = F.ceil(F.greatest("lefts", "rights") / MET_ROWS)
        larger = (F.col(mine) > F.col(theirs)) | ((F.col(mine) == F.col(theirs)) & F.lit(mine == "lefts"))
        part = F.when(larger, F.array(F.pmod(F.xxhash64(name), parts))).otherwise(F.sequence(F.lit(0).cast("long"), parts - 1))
        # few bytes may be many pairs, so these are not brought together by size
        return d.withColumn("part", F.explode(part)).drop("lefts", "rights").repartition(n, "n", "part")

    fits = (F.col("right_size") >= F.col("left_size") * share - HAIR) & (F.col("left_size") >= F.col("right_size") * share - HAIR)
    once = F.col("left") < F.col("right") if right is None else F.lit(True)
    both = F.col("left_size") + F.col("right_size")

    def value(shared: Column) -> Column:
        return 2 * shared / both if measure == "dice" else shared / (both - shared)

    # short bags travel with their prefixes: a pair is checked where it meets, at the first token that it shares
    bag = F.transform("sorted", lambda x: x["n"])
    x, y = (prefixes(d.where(F.col("size") <= SHORT), name, bag.alias(f"{name}_bag")) for d, name in ((a, "left"), (b, "right")))
    rest = F.least(F.col("left_size") - F.col("left_at"), F.col("right_size") - F.col("right_at"))
    enough = rest >= least * both / (2 if measure == "dice" else 1 + least) - HAIR
    first = ~F.arrays_overlap(F.slice("left_bag", F.lit(1), F.col("left_at")), F.slice("right_bag", F.lit(1), F.col("right_at")))
    shared = F.size(F.array_intersect("left_bag", "right_bag"))
    met = dealt(x, "left", "lefts", "rights").join(dealt(y, "right", "rights", "lefts"), ["n", "part"]).where(fits & once & enough)
    short = met.where((value(shared) >= least - HAIR) & first).select("left", "right", value(shared).alias("similarity"))
    # of longer ones, and of what may meet them, pairs of keys meet first
    u, v = (prefixes(d.where(F.col("size") >= SHORT * share - HAIR), name).drop("lefts", "rights") for d, name in ((a, "left"), (b, "right")))
    pairs = u.join(v, "n").where(fits & once & ((F.col("left_size") > SHORT) | (F.col("right_size") > SHORT))).select("left", "right", "left_size", "right_size").distinct()
    whole = pairs.join(a.select(F.col("key").alias("left"), bag.alias("left_bag")), "left").join(b.select(F.col("key").alias("right"), bag.alias("right_bag")), "right")
    return short.unionByName(whole.select("left", "right", value(shared).alias("similarity")).where(F.col("similarity") >= least - HAIR))


def bound_of_blocks(ratio: float) -> float:
    """The dice similarity of characters that a ratio of matching blocks needs: blocks match characters one to one."""
    return math.nextafter(ratio, 0)
