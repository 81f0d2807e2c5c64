"""Quality rules as a short-circuit cascade, in DataFrame functions alone.

A document is judged by two base rules, which always hold, and by the rules of :data:`RULES`.
These are one ``CASE``: the first that rejects ends it, so what stands behind is not computed.
Their order is found on a bounded sample: ``SAMPLE_ROWS`` rows of at most ``SAMPLE_CHARS`` characters.  A rule's cost is
what it takes on the sample repeated ``REPEATS`` times, over what an empty job takes, the least of three
runs, in powers of four; its selectivity is the share of rows that it rejects.  Again and
again the rule with the most rejections of rows still left, per cost, goes next; ties go to
the order of :data:`RULES`.  The order changes the cost and never the verdict, so the result is the
same at every size.

Words are ``[^\\x20\\x09-\\x0D]+``.  Null and empty texts have no words and fail the base.
Each row is judged by itself: ties and copies have no part in it.  Other columns travel in a
struct, so names like ``kept`` or ``n_words`` clash with nothing.  No documents give no rows.
"""

from __future__ import annotations

import math
import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillspark.session import removed, tables_so_far, written

SAMPLE_ROWS, SAMPLE_CHARS, REPEATS = 500, 20_000, 8
WINDOW = 8
BLANKS = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"

#: Each rule rejects where it is true; over n_words >= 1.  __text is the text, __hashes has a hash of each word.
RULES: dict[str, str] = {
    "many_symbols": "10 * n_symbols > n_words",
    "word_length": "word_chars < 2 * n_words or word_chars > 14 * n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "shouting": "10 * length(regexp_replace(__text, '[^A-Z]+', '')) > 3 * word_chars",
    "few_letters": "10 * length(regexp_replace(__text, '[^\\\\p{L}]+', '')) < 6 * word_chars",
    "stuttering": "10 * size(filter(__hashes, (h, i) -> i > 0 and h = __hashes[greatest(i - 1, 0)])) > 3 * n_words",
    "few_kinds": "n_words >= 50 and 10 * size(array_distinct(__hashes)) < n_words",
}


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also where lambdas refer to it."""
    return F.transform(F.array(value), body)[0]


def covered(windows: Column) -> Column:
    """Words in windows whose hash stands twice or more among those of consecutive windows."""

    def of_sorted(s: Column) -> Column:
        twin = lambda x, i, d: F.coalesce(F.get(s, i + d)["h"] == x["h"], F.lit(False))
        places = F.sort_array(F.transform(F.filter(s, lambda x, i: twin(x, i, -1) | twin(x, i, 1)), lambda x: x["i"]))
        return let(places, lambda p: F.aggregate(F.transform(p, lambda q, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - q, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x))

    return let(F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), of_sorted)


def _paired(hashes: Column, apart: int) -> Column:
    """Hashes of twice as long runs: of each run and the one that starts ``apart`` words later."""
    return F.zip_with(hashes, F.slice(hashes, F.lit(apart + 1), F.greatest(F.size(hashes), F.lit(1))), lambda a, b: F.xxhash64(a, b))


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """__row (the other columns), n_words, the base counts, n_lines, base_failed, and __text and __hashes for the rules.

    What is computed passes through ``inline``, so that no later filter is pushed under it
    and computes it once more.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col), F.lit(0))
    one = docs.select(row.alias("__row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text"))
    one = one.withColumn("__words", F.array_remove(F.split("__text", BLANKS), ""))
    lines = F.filter(F.split("__text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    two = one.withColumns({"__hashes": F.transform("__words", lambda w: F.xxhash64(w)), "__lines": lines})
    fours = let(_paired(F.col("__hashes"), 1), lambda h: _paired(h, 2))
    three = two.withColumn("__fours", F.slice(fours, F.lit(1), F.greatest(F.size("__hashes") - 3, F.lit(0))))
    # a repeated window of eight words starts with a repeated run of four
    eights = F.slice(_paired(F.col("__fours"), 4), F.lit(1), F.greatest(F.size("__hashes") - WINDOW + 1, F.lit(0)))
    repeated = F.when(F.size(F.array_distinct("__fours")) < F.size("__fours"), covered(eights)).otherwise(0)
    n = F.size("__hashes").cast("long")
    counts = F.struct(
        F.col("__text"),
        F.col("__hashes"),
        n.alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        (F.length("__text") - F.length(F.regexp_replace("__text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        repeated.cast("long").alias("n_repeat_words"),
    )
    out = three.select("__row", F.inline(F.array(counts)))
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def cascade_order(docs: DataFrame, text_col: str = "text", rules: dict[str, str] = RULES, rows: int = SAMPLE_ROWS) -> list[str]:
    """Names of the rules by rejections per cost among rows that the rules before let pass."""
    # take() reads as few partitions as it needs; a limit inside a written plan would scan and shuffle all
    short = docs.select(F.col(f"`{text_col}`").alias("text")).where(F.length("text") <= SAMPLE_CHARS)
    some = docs.sparkSession.createDataFrame(short.take(rows), "text string")
    mark = tables_so_far()
    sample = written(features(some).where("not base_failed"), "sample")
    verdicts = sample.select(*(F.expr(r).alias(name) for name, r in rules.items())).collect()  # at most ``rows`` rows
    many = sample.repartition(1).withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))

    def seconds(column: Column) -> float:
        took = []
        for _ in range(3):
            began = time.perf_counter()
            many.agg(F.count_if(column)).collect()
            took.append(time.perf_counter() - began)
        return min(took)

    empty = seconds(F.col("again") > 0)
    # launch times scatter by a few hundredths of a second, so smaller costs count as equal
    cost = {name: 4.0 ** round(math.log(max(seconds(F.expr(r)) - empty, 0.05), 4)) for name, r in rules.items()}
    removed(docs.sparkSession, mark)
    order, left, rest = [], verdicts, list(rules)
    while rest:
        best = max(rest, key=lambda name: (sum(bool(v[name]) for v in left) / cost[name], -rest.index(name)))
        if not any(v[best] for v in left):
            return order + sorted(rest, key=lambda name: cost[name])
        order.append(best)
        rest.remove(best)
        left = [v for v in left if not v[best]]
    return order


def _judged(docs: DataFrame, text_col: str, rules: dict[str, str]) -> DataFrame:
    order = cascade_order(docs, text_col, rules)
    cases = " ".join(f"when {rules[name]} then false" for name in order)
    return features(docs, text_col).withColumn("kept", F.expr(f"case when base_failed then false {cases} else true end"))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: dict[str, str] = RULES) -> DataFrame:
    """``id_col``, n_words, the base counts, base_failed and kept of every row."""
    out = _judged(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), text_col, rules)
    return out.select(F.col(f"__row.`{id_col}`").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def passing(docs: DataFrame, text_col: str = "text", rules: dict[str, str] = RULES) -> DataFrame:
    """The rows that are kept, with their own columns."""
    out = _judged(docs, text_col, rules).where("kept")
    return out.select(*((F.col("__text") if c == text_col else F.col(f"__row.`{c}`")).alias(c) for c in docs.columns))
