"""Which entities a text is about: surfaces in eight ways, found by automata in shards, the best surface of each entity.

Surfaces are texts that stand for an entity, each with the strength of its kind.  They are dealt out in shards by their
first three characters; a text goes to the shards that its own runs of up to three characters lead to, and
one automaton (Aho and Corasick) finds all surfaces of a shard in one reading of the text.  Where one shard holds them all,
it goes to the texts instead, which stay where they are read.  Neither the surfaces beyond a shard nor the
texts are ever in one place: tasks hold a shard and a chunk of texts of bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import TYPE_CHECKING

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillspark.functions import words
from rillspark.operators import similarity
from rillspark.operators.ranking import top_of_each
from rillspark.session import written

if TYPE_CHECKING:
    import ahocorasick

#: The strength of each kind of link, and limits of the weaker kinds.
STRENGTHS = {"exact": 1.0, "synonym": 0.90, "bilingual": 0.85, "contained": 0.80, "contained_short": 0.65, "related": 0.55, "evidence_alias": 0.50, "jaccard": 0.40}
FUZZY_BASE, FUZZY_SPAN, LATIN_RATIO, OTHER_RATIO, LEAST_JACCARD, SHORTEST_JACCARD = 0.60, 0.20, 0.82, 0.70, 0.60, 3
EVIDENCE_LATIN_SHARE, EVIDENCE_TOKENS, EVIDENCE_SHORTEST = 0.6, 6, 4
FEW_LINKS = 3
CLOSEST = 3

#: Surfaces of an automaton, their characters, and characters of the texts that are sent to it in one task.
SHARD_SURFACES, SHARD_CHARS, CHUNK_CHARS = 50_000, 2_000_000, 32_000_000
HAN = r"[\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}]"
_EDGE = re.compile("[a-z0-9]")


# -- surfaces -----------------------------------------------------------------------------


def surfaces(entities: DataFrame, synonyms: DataFrame | None = None, related: DataFrame | None = None, translations: DataFrame | None = None, evidence: DataFrame | None = None) -> DataFrame:
    """surface, node, score, via: every surface of every entity, at its strongest.

    ``entities``: node, name.  ``synonyms`` and ``related``: group, member; an entity with a variant in a group gets all
    of its members.  ``translations``: term, form.  ``evidence``: node, text; the first ``EVIDENCE_TOKENS`` Latin tokens of a text
    that is mostly Latin letters become weak aliases.  Surfaces of one character are kept in Han script only, as weak ones.
    """
    named = entities.where(F.col("name").isNotNull() & ~words.is_junk(F.col("name"))).select("node", "name")
    whole = words.folded(F.col("name"))
    own = named.select("node", whole.alias("whole"), F.explode(F.transform(words.variants(F.col("name")), lambda v: words.folded(v))).alias("surface")).where("surface != ''").distinct()
    kinds = [own.select("surface", "node", F.when(F.col("surface") == F.col("whole"), "exact").otherwise("contained").alias("via"))]
    for groups, via in ((synonyms, "synonym"), (related, "related")):
        if groups is not None:
            g = groups.select("group", words.folded(F.col("member")).alias("surface")).distinct()
            mine = own.select("node", "surface").join(g, "surface").select("node", "group").distinct()
            kinds.append(mine.join(g, "group").select("surface", "node", F.lit(via).alias("via")))
    if translations is not None:
        t = translations.select(words.folded(F.col("term")).alias("surface"), words.folded(F.col("form")).alias("form")).distinct()
        kinds.append(own.join(t, "surface").select(F.col("form").alias("surface"), "node", F.lit("bilingual").alias("via")))
    if evidence is not None:
        letters = F.length(F.regexp_replace("text", "[^A-Za-z]", ""))
        first = F.slice(F.array_distinct(words.latin_tokens(F.col("text"))), 1, EVIDENCE_TOKENS)
        told = evidence.where(letters >= EVIDENCE_LATIN_SHARE * F.greatest(F.length("text"), F.lit(1))).join(named.select("node").distinct(), "node")
        kinds.append(told.select(F.explode(first).alias("surface"), "node").where(F.length("surface") >= EVIDENCE_SHORTEST).select("surface", "node", F.lit("evidence_alias").alias("via")))
    every = kinds[0]
    for k in kinds[1:]:
        every = every.unionByName(k)
    strength = F.element_at(F.create_map(*(F.lit(x) for kv in STRENGTHS.items() for x in kv)), F.col("via"))
    short = F.length("surface") < 2
    scored = every.where(~short | F.col("surface").rlike(HAN)).withColumn("score", F.when(short, F.least(strength, F.lit(STRENGTHS["contained_short"]))).otherwise(strength)).withColumn("via", F.when(short, "contained_short").otherwise(F.col("via")))
    return scored.groupBy("surface", "node").agg(F.max(F.struct("score", "via")).alias("b")).select("surface", "node", "b.score", "b.via")


# -- automata -----------------------------------------------------------------------------


def _shard(c: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(F.substring(c, 1, 3)), F.lit(n)).cast("int")


def _shards_of_text(n: int, forms: Sequence[str]) -> Column:
    """The shards of all surfaces that may start somewhere in the forms (columns) of the text that are searched."""
    if n == 1:
        return F.array(F.lit(0))

    def runs(c: str, size: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.substr(F.col(c), i, F.lit(size)))

    return F.array_distinct(F.transform(F.concat(*(runs(c, size) for c in forms for size in (1, 2, 3))), lambda r: _shard(r, n)))


def _machine(surfaces: Sequence[str], han: Sequence[bool]) -> ahocorasick.Automaton:
    import ahocorasick

    machine = ahocorasick.Automaton()
    for s, h in zip(surfaces, han, strict=True):
        machine.add_word(s, (s, h))
    if len(machine):
        machine.make_automaton()
    return machine


def _found(found_in: pa.Table, text_type: pa.DataType, machine: ahocorasick.Automaton) -> pa.Table:
    ids, hits = [], []
    if len(machine):
        for k, (spaced, tight) in enumerate(zip(found_in.column("spaced"), found_in.column("tight"), strict=True)):
            spaced, here = spaced.as_py(), set()
            for end, (s, han) in machine.iter(spaced):
                start = end - len(s) + 1
                if not han and not (start and _EDGE.match(spaced[start - 1])) and not (end + 1 < len(spaced) and _EDGE.match(spaced[end + 1])):
                    here.add(s)
            # scripts without blanks are looked for in the text without blanks
            here.update(s for _, (s, han) in machine.iter(tight.as_py()) if han)
            ids += [k] * len(here)
            hits += sorted(here)
    return pa.table({"text_id": found_in.column("text_id").combine_chunks().take(pa.array(ids, pa.int64())).cast(text_type), "surface": pa.array(hits, pa.string())})


def occurrences(texts: DataFrame, key: str, text: str, listed: DataFrame, shard_surfaces: int = SHARD_SURFACES, chunk_chars: int = CHUNK_CHARS, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """key, surface: the surfaces (column ``surface``, folded) that stand in each text, once each.

    A surface of Latin letters stands between characters that are neither a-z nor digits; one with a Han character anywhere.
    Surfaces of one shard go to where the texts are; texts move only if there are more.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    every = listed.select("surface").where(F.length("surface") > 0).distinct().withColumn("han", F.col("surface").rlike(HAN))
    size = every.agg(F.count("*").alias("n"), F.sum(F.length("surface")).alias("chars"), F.max("han").alias("han")).first()
    n = max(1, -(-size["n"] // shard_surfaces), -(-(size["chars"] or 0) // shard_chars))
    forms = ["spaced", "tight"] if size["han"] else ["spaced"]
    tight = words.folded(F.col(text)) if size["han"] else F.lit("")
    told = texts.where(F.col(text).isNotNull()).select(F.col(key).alias("text_id"), words.folded(F.col(text), keep_spaces=True).alias("spaced"), tight.alias("tight"))
    kind = told.schema["text_id"].dataType
    arrow, schema = to_arrow_type(kind), f"text_id {kind.simpleString()}, surface string"
    if n == 1:
        few = every.toArrow()  # a shard at most
        shared = texts.sparkSession.sparkContext.broadcast((few.column("surface").to_pylist(), few.column("han").to_pylist()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine = _machine(*shared.value)
            for batch in batches:
                yield from _found(pa.Table.from_batches([batch]), arrow, machine).to_batches()

        return told.mapInArrow(run, schema).select(F.col("text_id").alias(key), "surface")
    chars = texts.agg(F.sum(F.length(text))).first()[0] or 0
    chunks = max(1, -(-chars // chunk_chars), min(texts.sparkSession.sparkContext.defaultParallelism, -(-chars // 100_000)))
    keyed = every.withColumn("shard", _shard(F.col("surface"), n))
    # a shard of a very common start is split further; every text that leads to it meets all of its parts
    many = {r["shard"]: -(-r["count"] // (2 * shard_surfaces)) for r in keyed.groupBy("shard").count().where(F.col("count") > 2 * shard_surfaces).collect()}  # one row a shard at most
    parts = F.lit(1)
    if many:
        parts = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in many.items() for x in kv)), F.col("shard")), F.lit(1))
    mine = keyed.withColumn("part", F.pmod(F.xxhash64("surface", F.lit(1)), parts).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(int(chunks) - 1))))
    sent = told.withColumn("shard", F.explode(_shards_of_text(n, forms))).withColumn("part", F.explode(F.sequence(F.lit(0), parts.cast("int") - 1))).withColumn("chunk", F.pmod(F.xxhash64("spaced"), F.lit(int(chunks))).cast("int"))
    place = ["shard", "part", "chunk"]
    hits = sent.groupBy(*place).cogroup(mine.groupBy(*place)).applyInArrow(lambda left, right: _found(left, arrow, _machine(right.column("surface").to_pylist(), right.column("han").to_pylist())), schema)
    return hits.select(F.col("text_id").alias(key), "surface")


# -- weaker links -------------------------------------------------------------------------


def _ratio(a: Column, b: Column) -> Column:
    """Twice the characters of the longest matching blocks by all characters; an Arrow batch of pairs at a time."""
    from difflib import SequenceMatcher

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y, strict=True)], dtype="float64")

    return ratio(a, b)


def close_names(tokens: DataFrame, names: DataFrame) -> DataFrame:
    """token, name, ratio: the ``CLOSEST`` names of each token by matching blocks, at ``LATIN_RATIO`` or more.

    Blocks match characters one to one, so a pair has at least that dice similarity of its characters: the
    similarity join finds all candidates.
    """
    met = similarity.joined(tokens, names, "token", similarity.characters(F.col("token")), similarity.bound_of_blocks(LATIN_RATIO), "dice", "name", similarity.characters(F.col("name")))
    near = met.select(F.col("left").alias("token"), F.col("right").alias("name")).withColumn("there", _ratio(F.col("name"), F.col("token"))).where(F.col("there") >= LATIN_RATIO)
    best = top_of_each(near, ["token"], [F.desc("there"), F.desc("name")], CLOSEST)
    return best.select("token", "name", _ratio(F.col("token"), F.col("name")).alias("ratio"))


def _spread(ratio: Column, cutoff: float) -> Column:
    return FUZZY_BASE + FUZZY_SPAN * (ratio - cutoff) / (1 - cutoff)


def fuzzy_links(texts: DataFrame, key: str, text: str, entities: DataFrame) -> DataFrame:
    """key, node, score, via, surface: Latin tokens near Latin names, and names in Han script near the whole text."""
    named = entities.where(F.col("name").isNotNull() & ~words.is_junk(F.col("name"))).select("node", "name", words.folded(F.col("name")).alias("whole"))
    asked = texts.select(F.col(key).alias("text_id"), F.col(text).alias("text"), words.folded(F.col(text)).alias("tight"))
    tokens = asked.select("text_id", F.explode(F.array_distinct(words.latin_tokens(F.col("text")))).alias("token")).where(F.length("token") >= EVIDENCE_SHORTEST)
    latin = named.where(words.is_latin(F.col("name")) & F.col("whole").rlike("[a-z]"))
    near = close_names(tokens.select("token").distinct(), latin.select("whole").distinct().withColumnRenamed("whole", "name"))
    one = tokens.join(near, "token").join(latin.select("node", F.col("whole").alias("name")), "name").select("text_id", "node", _spread(F.col("ratio"), LATIN_RATIO).alias("score"), F.lit("fuzzy").alias("via"), F.col("token").alias("surface"))
    han = lambda c: F.filter(F.split(c, ""), lambda x: x.rlike(HAN))
    wide = named.where((F.length("whole") >= SHORTEST_JACCARD) & F.col("whole").rlike(HAN))
    told = asked.where(F.col("tight").rlike(HAN))
    # a name's characters against the Han characters of the text
    sets = similarity.joined(told, wide.select("whole").distinct(), "text_id", F.array_distinct(han(F.col("tight"))), LEAST_JACCARD, "jaccard", "whole", F.array_distinct(similarity.characters(F.col("whole"))))
    two = sets.select(F.col("left").alias("text_id"), F.col("right").alias("whole"), F.lit(STRENGTHS["jaccard"]).alias("score"), F.lit("jaccard").alias("via"))
    blocks = similarity.joined(told, wide.select("whole").distinct(), "text_id", similarity.characters(F.col("tight")), similarity.bound_of_blocks(OTHER_RATIO), "dice", "whole", similarity.characters(F.col("whole")))
    share_one = blocks.select(F.col("left").alias("text_id"), F.col("right").alias("whole")).join(told.select("text_id", "tight"), "text_id").where(F.size(F.array_intersect(han(F.col("tight")), han(F.col("whole")))) > 0)
    by_ratio = share_one.withColumn("ratio", _ratio(F.col("whole"), F.col("tight"))).where(F.col("ratio") >= OTHER_RATIO)
    # a name that already holds by its set of characters is not looked at again
    three = by_ratio.join(two.select("text_id", "whole"), ["text_id", "whole"], "left_anti").select("text_id", "whole", _spread(F.col("ratio"), OTHER_RATIO).alias("score"), F.lit("fuzzy").alias("via"))
    names = two.unionByName(three).join(wide.select("node", "whole"), "whole").select("text_id", "node", "score", "via", F.col("whole").alias("surface"))
    return one.unionByName(names).select(F.col("text_id").alias(key), "node", "score", "via", "surface")


def linked(texts: DataFrame, key: str, text: str, entities: DataFrame, table: DataFrame, most: int, least: float = 0.0) -> DataFrame:
    """key, source, node, name, score, via, surface, rank: the best link of each text and entity, the first ``most`` of each source.

    ``entities``: node, name, source, degree; ``table``: what :func:`surfaces` gives.  Texts with fewer than ``FEW_LINKS`` entities
    are also linked by near names.  Of equal scores the way of linking and then the surface that come last in the
    alphabet stand; links are ranked by score, then degree, then name.  Null texts have no links.
    """
    # read by the automata and by each kind of near names
    asked = written(texts.where(F.col(text).isNotNull()).select(key, text), "asked")
    direct = written(occurrences(asked, key, text, table).join(table, "surface").groupBy(key, "node").agg(F.max(F.struct("score", "via", "surface")).alias("b")), "links")
    enough = direct.groupBy(key).count().where(F.col("count") >= FEW_LINKS).select(key)
    more = fuzzy_links(asked.join(enough, key, "left_anti"), key, text, entities).groupBy(key, "node").agg(F.max(F.struct("score", "via", "surface")).alias("b"))
    best = direct.unionByName(more).groupBy(key, "node").agg(F.max("b").alias("b"))
    rows = best.join(entities.select("node", "name", "source", "degree"), "node").select(key, "source", "node", "name", "b.score", "b.via", "b.surface", "degree").where(F.col("score") >= least)
    return top_of_each(rows, [key, "source"], [F.desc("score"), F.desc("degree"), F.col("name"), F.col("node")], most)
