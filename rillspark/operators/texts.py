"""Text operators: lines, running heads, reading order, sections, chunks with spans, TF-IDF of words and characters, linking."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillspark.operators.ranking import top_of_each


def clean_line(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "\\s+", " "))


def repeat_key(c: Column) -> Column:
    """Lower-cased, digits as #: equal for lines that differ in page numbers only."""
    return F.regexp_replace(F.lower(clean_line(c)), "[0-9]+", "#")


def repeated_lines(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """Lines that stand in at least ``least`` documents."""
    lines = docs.select(id_col, F.explode(F.array_distinct(F.transform(F.split(text_col, "\n"), repeat_key))).alias("line")).where("line != ''")
    return lines.groupBy("line").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= least)


def fixed_chunks(docs: DataFrame, id_col: str, text_col: str, size: int, overlap: int) -> DataFrame:
    """Spans of ``size`` characters, each ``overlap`` into the one before."""
    n = F.length(text_col)
    starts = F.sequence(F.lit(0), F.greatest(n - 1 - overlap, F.lit(0)), F.lit(size - overlap))
    out = docs.where(n > 0).select(id_col, text_col, F.posexplode(starts).alias("ordinal", "char_start"))
    end = F.least(F.col("char_start") + size, F.length(text_col))
    return out.select(id_col, "ordinal", "char_start", end.alias("char_end"), F.substring(text_col, F.col("char_start") + 1, end - F.col("char_start")).alias("chunk"))


def char_set(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), ""), lambda x: x != ""))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def tf_idf(docs: DataFrame, id_col: str, terms: Column) -> DataFrame:
    """id, term, weight: sublinear term frequency, smooth inverse document frequency, unit length."""
    tf = docs.select(id_col, F.explode(terms).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    n = docs.agg(F.count("*").alias("n_docs"))
    w = tf.join(df, "term").crossJoin(F.broadcast(n)).withColumn("w", (1 + F.log("tf")) * (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1))
    # a document's terms meet once, for its length; they are not made again for a join
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))
    return w.where(F.col(id_col).isNotNull()).select(id_col, "term", (F.col("w") / length).alias("weight"))


# -- pages of blocks ----------------------------------------------------------------------


def running_heads(blocks: DataFrame, doc: str, page: str, text: Column, top: Column, bottom: Column, height: Column, share: float = 0.45) -> DataFrame:
    """doc, place (top or bottom), line: what stands at the edge of ``max(2, int(share * pages))`` pages or more of a document.

    Edges are the uppermost 15 and the lowest 12 hundredths of a page; lines differ only in digits.
    """
    pages = blocks.groupBy(doc).agg(F.countDistinct(page).alias("__pages"))
    edges = F.array_compact(F.array(F.when(top <= height * 0.15, F.lit("top")), F.when(bottom >= height * (1 - 0.12), F.lit("bottom"))))
    lines = blocks.select(doc, page, F.explode(edges).alias("place"), repeat_key(text).alias("line"), clean_line(text).alias("raw")).where("line != '' and not raw rlike '^[0-9]+$'")
    seen = lines.groupBy(doc, "place", "line").agg(F.count("*").alias("n"))
    return seen.join(pages, doc).where(F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("__pages") * share))).select(doc, "place", "line", "n")


def without_heads(blocks: DataFrame, heads: DataFrame, doc: str, text: Column) -> DataFrame:
    """The blocks whose line is no running head of their document."""
    keyed = blocks.withColumn("line", repeat_key(text))
    return keyed.join(heads.select(doc, "line").distinct(), [doc, "line"], "left_anti").drop("line")


def reading_order(blocks: DataFrame, page: list[str], x0: str, x1: str, y0: str, width: float, tie: str) -> DataFrame:
    """``blocks`` with column (0 or 1) and ordinal: two columns where three blocks or more are on either side and most are narrow."""
    # one order serves all windows, so a task sorts its rows once: a column's ordinals are running counts in it
    w = Window.partitionBy(*page).orderBy(F.round(y0, 1), x0, tie)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = F.coalesce((F.col(x0) + F.col(x1)) / 2 < width / 2 * 0.98, F.lit(False))
    right = F.coalesce((F.col(x0) + F.col(x1)) / 2 >= width / 2 * 0.98, F.lit(False))
    narrow = ((F.col(x1) - F.col(x0)) < width * 0.7).cast("int")
    counted = blocks.select("*", F.count_if(left).over(whole).alias("__left"), F.count_if(right).over(whole).alias("__right"), (F.sum(narrow).over(whole) / F.count("*").over(whole) > 0.6).alias("__narrow"), F.count_if(right).over(so_far).alias("__before"), F.row_number().over(w).alias("__row"), F.count("*").over(whole).alias("__rows"))
    two = (F.col("__left") >= 3) & (F.col("__right") >= 3) & F.col("__narrow")
    placed = counted.withColumn("column", F.when(two & right, 1).otherwise(0))
    # rows of the first column stand in order without those of the second, which come after all of the first
    ordinal = F.when(~two | two.isNull(), F.col("__row")).when(right, F.col("__rows") - F.col("__right") + F.col("__before")).otherwise(F.col("__row") - F.col("__before"))
    return placed.withColumn("ordinal", ordinal.cast("int")).drop("__left", "__right", "__narrow", "__before", "__row", "__rows")


def titles(blocks: DataFrame, doc: str, text: str, font: str, y0: str, shortest: int = 5, longest: int = 200) -> DataFrame:
    """doc, title: the first block of the largest letters that has the length of a title and a letter in it."""
    good = blocks.where(F.length(F.trim(text)).between(shortest, longest) & F.col(text).rlike(r"\p{L}"))
    best = good.groupBy(doc).agg(F.min(F.struct((-F.col(font)).alias("f"), y0, text)).alias("b"))
    return best.select(doc, clean_line(F.col(f"b.{text}")).alias("title"))


def joined_lines(c: Column) -> Column:
    """Body lines as paragraphs: words that a hyphen cuts become one, and a line that does not end a sentence goes on."""
    whole = F.regexp_replace(c, "([a-z])-\n([a-z])", "$1$2")
    return F.regexp_replace(whole, "([^.!?:\n])\n([^\n])", "$1 $2")


def sections(docs: DataFrame, doc: str, text: str, headings: dict[str, str]) -> DataFrame:
    """doc, section, first_line, n_lines, n_chars: lines belong to the last heading before them, ``front`` before the first.

    A document's lines go to one task each document, as they do in its text.
    """
    lines = docs.select(doc, F.posexplode(F.split(text, "\n")).alias("i", "line"))
    name = F.lit(None).cast("string")
    for label, pattern in reversed(list(headings.items())):
        name = F.when(F.col("line").rlike(pattern), F.lit(label)).otherwise(name)
    # a section is told by the line that its heading stands in
    at = F.when(name.isNotNull(), F.struct("i", name.alias("section")))
    inside = F.last(at, True).over(Window.partitionBy(doc).orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    marked = lines.withColumn("s", inside)
    out = marked.groupBy(doc, F.coalesce("s.section", F.lit("front")).alias("section"), F.coalesce("s.i", F.lit(-1)).alias("at"))
    return out.agg(F.min("i").alias("first_line"), F.count("*").alias("n_lines"), F.sum(F.length("line")).cast("long").alias("n_chars")).drop("at")


def paragraph_chunks(docs: DataFrame, id_col: str, text_col: str, most: int = 1200, overlap: int = 0) -> DataFrame:
    """id, ordinal, char_start, char_end and text: paragraphs (lines that are not blank) packed greedily up to ``most`` characters.

    A longer paragraph is cut into windows that overlap.  A chunk is exactly the text between its ends.
    Packing is a fold over a text, so it is a small helper inside a task.
    """
    stride = max(1, most - max(0, min(overlap, most - 1)))
    kind = docs.schema[id_col].dataType.simpleString()

    def spans(text: str) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for m in _PARAGRAPH.finditer(text):
            a, b = m.span()
            pieces = [(a, b)] if b - a <= most else [(p, min(p + most, b)) for p in range(a, max(b - most, a) + stride, stride) if p == a or p - stride + most < b]
            for x, y in pieces:
                if out and y - out[-1][0] <= most:
                    out[-1] = (out[-1][0], y)
                else:
                    out.append((x, y))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # windows overlap, so a task holds the chunks of some megabytes of text at a time, not of a whole batch
        for b in _by_size(batches, CHUNKED_BYTES):
            rows, found = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                for k, (x, y) in enumerate(spans(t or "")):
                    rows.append(i)
                    found.append((k, x, y, t[x:y]))
            cols = list(zip(*found, strict=True)) if found else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], names=[id_col, "ordinal", "char_start", "char_end", "chunk"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ordinal long, char_start long, char_end long, chunk string")


#: Bytes of text whose chunks are made together.
CHUNKED_BYTES = 4_000_000


def _by_size(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose second column, of texts, ends within the next ``most`` bytes; no text is cut."""
    for b in batches:
        n = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // most
        ends = [*(np.flatnonzero(np.diff(n)) + 1).tolist(), b.num_rows]
        for start, end in zip([0, *ends], ends):  # noqa: B905
            yield b.slice(start, end - start)


_PARAGRAPH = re.compile(r"\S[^\n]*")


# -- search and linking -------------------------------------------------------------------


def char_grams(c: Column, most: int = 3) -> Column:
    """All runs of one to ``most`` characters of each word with a blank on both sides; those of blanks alone are left out."""
    words = F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    of = lambda w, k: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - k + 1, F.lit(1))), lambda i: F.substr(w, i, F.lit(k)))
    each = F.flatten(F.transform(padded, lambda w: F.flatten(F.array(*(of(w, k) for k in range(1, most + 1))))))
    return F.filter(each, lambda g: F.trim(g) != "")


def lexical_search(queries: DataFrame, query: str, docs: DataFrame, doc: str, text: str, k: int) -> DataFrame:
    """query, doc, score of the best ``k`` documents by the product of unit vectors of character n-grams, both weighted by the documents' frequencies.

    Meant for passages of some hundred characters: a row stands for a gram that two of them share.
    """
    d = tf_idf(docs, doc, char_grams(F.col(text)))
    n = docs.agg(F.count("*").alias("n_docs"))  # one row
    df = docs.select(doc, F.explode(F.array_distinct(char_grams(F.col(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    tf = queries.select(query, F.explode(char_grams(F.col(text))).alias("term")).groupBy(query, "term").agg(F.count("*").alias("tf"))
    w = tf.join(df, "term").crossJoin(F.broadcast(n)).withColumn("w", (1 + F.log("tf")) * (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1))
    length = w.groupBy(query).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    unit = w.join(length, query).select(query, "term", (F.col("w") / F.col("length")).alias("q"))
    scores = d.join(unit, "term").groupBy(query, doc).agg(F.round(F.sum(F.col("weight") * F.col("q")), 9).alias("score"))
    return top_of_each(scores, [query], [F.desc("score"), F.col(doc)], k)


def linked(questions: DataFrame, question: str, text: str, surfaces: DataFrame) -> DataFrame:
    """question, node, score, how: nodes whose surfaces stand in a question, the best surface of each node.

    ``surfaces`` has node, surface and kind (name or alias).  A question's words and runs of two and three words are
    looked up as they are (1.0, an alias 0.8); words of five letters or more also by the character
    sets of surfaces with the same first three letters (0.6 times a Jaccard similarity of 0.7 or more).
    """
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")
    runs = lambda k: F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), lambda i: F.array_join(F.slice(words, i, F.lit(k)), " "))).otherwise(F.array().cast("array<string>"))
    asked = questions.select(question, F.explode(F.array_distinct(F.concat(*(F.coalesce(runs(k), F.array().cast("array<string>")) for k in (1, 2, 3))))).alias("run"))
    s = surfaces.select("node", "kind", F.trim(F.regexp_replace(F.lower("surface"), "[^a-z0-9]+", " ")).alias("flat")).distinct()
    exact = asked.join(s, F.col("run") == F.col("flat")).select(question, "node", F.when(F.col("kind") == "name", 1.0).otherwise(0.8).alias("score"), F.when(F.col("kind") == "name", "exact").otherwise("alias").alias("how"))
    key = lambda c: F.substring(c, 1, 3)
    long = asked.where((F.length("run") >= 5) & ~F.contains("run", F.lit(" "))).withColumn("key", key("run"))
    near = long.join(s.where(F.length("flat") >= 5).withColumn("key", key("flat")), "key").where("run != flat").withColumn("j", jaccard(char_set(F.col("run")), char_set(F.col("flat")))).where("j >= 0.7")
    fuzzy = near.select(question, "node", F.round(F.col("j") * 0.6, 9).alias("score"), F.lit("jaccard").alias("how"))
    best = exact.unionByName(fuzzy).groupBy(question, "node").agg(F.max(F.struct("score", "how")).alias("b"))
    return best.select(question, "node", "b.score", "b.how")


def similar_names(names: DataFrame, name: str, least: float) -> DataFrame:
    """a, b, ratio of distinct names with the same first three letters (after folding) whose matching blocks make up ``least`` or more.

    The ratio is that of the longest matching blocks, which no column function gives: an Arrow batch at a time.
    """
    from difflib import SequenceMatcher

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b, strict=True)])

    d = names.select(F.col(name).alias("n")).where("n is not null").distinct().withColumn("key", F.substring(F.lower("n"), 1, 3))
    pairs = d.alias("x").join(d.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.n") < F.col("y.n"))).select(F.col("x.n").alias("a"), F.col("y.n").alias("b"))
    return pairs.withColumn("ratio", ratio("a", "b")).where(F.col("ratio") >= least)
