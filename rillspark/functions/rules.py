"""Rules as columns: scenarios, routing, indicators of an action, keywords of a question, scores of relations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits of the scenarios.
RAIN_3D, CHLOROPHYLL, TURBIDITY_7D = 36.0, 8.0, 3.0

# Indicators of an action.
BASELINE_TURBIDITY, COST_OF_FLOW, COST_OF_AERATION, COST_OF_CHEMICAL, MANUAL_COST = 5.0, 0.02, 0.5, 0.1, 35000.0
EFFECTS = {"flow": 0.18, "aeration": 0.09, "chemical": 0.09}
MOST_REDUCTION, STABILITY_LOSS = 0.4, 0.04

# Terms of the field, and terms that a term brings with it.
DOMAIN_TERMS = (
    "透明度", "清澈度", "水体透明度", "浊度", "悬浮物", "悬浮颗粒物", "悬浮物浓度", "总悬浮物", "总悬浮物浓度", "TSS", "SSC",
    "监测", "测量", "测定", "检测", "观测", "采样", "方法", "仪器", "传感器", "浊度计", "光学后向散射", "光学后向散射传感器",
    "OBS", "OBS-3A", "膜过滤法", "实验室分析", "透明度盘", "塞氏盘", "风速", "水深", "水动力", "波浪", "总氮", "总磷", "有机质",
)
ALIASES = {
    "透明度": ("透明度", "水体透明度", "清澈度", "浊度", "悬浮物", "悬浮物浓度", "总悬浮物浓度", "TSS", "SSC", "光学后向散射", "OBS", "OBS-3A", "浊度计", "透明度盘", "塞氏盘"),
    "清澈度": ("清澈度", "透明度", "水体透明度", "浊度", "悬浮物", "悬浮物浓度", "TSS", "SSC"),
    "浊度": ("浊度", "浊度计", "光学后向散射", "OBS", "OBS-3A", "悬浮物", "悬浮物浓度", "TSS", "SSC"),
    "悬浮物": ("悬浮物", "悬浮颗粒物", "悬浮物浓度", "总悬浮物", "总悬浮物浓度", "TSS", "SSC", "膜过滤法"),
    "监测": ("监测", "测量", "测定", "检测", "观测", "采样", "方法", "仪器", "传感器", "浊度计", "光学后向散射传感器", "OBS", "OBS-3A", "膜过滤法", "实验室分析", "透明度盘", "塞氏盘"),
    "方法": ("方法", "监测", "测量", "测定", "检测", "采样", "仪器", "传感器", "浊度计", "OBS", "OBS-3A", "膜过滤法", "实验室分析", "透明度盘", "塞氏盘"),
}

# Points of a relation, words of a question about methods and of evidence that answers it.
END_POINTS, RELATION_POINTS, KEYWORD_POINTS, METHOD_POINTS, VAGUE_POINTS = 10, 8, (6, 5, 2), 8, 3
METHOD_QUESTION = ("方法", "监测", "测量", "测定", "检测", "仪器", "传感器")
METHOD_EVIDENCE = ("监测", "测量", "测定", "检测", "采样", "传感器", "浊度计", "OBS", "OBS-3A", "膜过滤法", "实验室分析", "透明度盘", "塞氏盘", "optical backscatter", "turbidity meter", "measured", "sensor", "filtration")
VAGUE_RELATION = "相关"


def scenario(rain_3d: Column, chlorophyll: Column, turbidity_7d: Column) -> Column:
    """The first that holds: much rain, much chlorophyll, lasting turbidity, else release from within; what is unknown does not hold."""
    more = lambda c, limit: F.coalesce(c > limit, F.lit(False))
    return F.when(more(rain_3d, RAIN_3D), "s1_external_input").when(more(chlorophyll, CHLOROPHYLL), "s3_algae_bloom").when(more(turbidity_7d, TURBIDITY_7D), "s4_chronic_combo").otherwise("s2_internal_release")


def routed(rules: Sequence[tuple[str, Mapping[str, object]]], default: str = "unknown") -> Column:
    """The name of the first rule whose columns all have its values; a rule without columns always holds."""
    out = F.lit(default)
    for name, wanted in reversed(rules):
        holds = F.lit(True)
        for c, v in wanted.items():
            holds = holds & F.col(c).eqNullSafe(F.lit(v))
        out = F.when(holds, F.lit(name)).otherwise(out)
    return out


def _finite(c: Column, default: float) -> Column:
    v = c.cast("double")
    return F.when(F.abs(v) < float("inf"), v).otherwise(F.lit(default))


def indicators(turbidity: Column, release: Column, aeration: Column, chemical: Column, effects: Mapping[str, float] = EFFECTS, manual_cost: float = MANUAL_COST) -> Column:
    """What an action brings and costs, as a struct; what is null, NaN or infinite counts as 0 (turbidity as the usual one)."""
    t, r, a, c = _finite(turbidity, BASELINE_TURBIDITY), _finite(release, 0.0), _finite(aeration, 0.0), _finite(chemical, 0.0)
    share = lambda v, whole: F.least(v / whole, F.lit(1.0))
    ratio = F.least(effects["flow"] * share(r, 10.0) + effects["aeration"] * share(a, 50.0) + effects["chemical"] * share(c, 100.0), F.lit(MOST_REDUCTION))
    cost = r * 86400 * COST_OF_FLOW + a * 24 * COST_OF_AERATION + c * COST_OF_CHEMICAL
    clipped = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    size = F.abs(r) / 15.0 + F.abs(a) / 100.0 + F.abs(c) / 500.0
    return F.struct(
        (t * ratio).alias("turbidity_reduction"),
        ratio.alias("turbidity_reduction_ratio"),
        cost.alias("energy_cost"),
        clipped(1.0 - cost / manual_cost).alias("cost_saving_ratio"),
        clipped(1.0 - STABILITY_LOSS * size).alias("stability"),
        F.when(size > 0.1, 1.0).otherwise(0.5).alias("response_time_hours"),
        size.alias("action_magnitude"),
    )


def keywords(question: Column) -> Column:
    """Terms of the field in a question (in any case), what these bring with them, and its Latin words of two characters or more; sorted."""
    q = F.trim(question)
    terms = F.filter(F.array(*map(F.lit, DOMAIN_TERMS)), lambda t: F.contains(F.lower(q), F.lower(t)))
    brought = [F.when(F.contains(q, F.lit(k)), F.array(*map(F.lit, v))).otherwise(F.array().cast("array<string>")) for k, v in ALIASES.items()]
    latin = F.filter(F.regexp_extract_all(q, F.lit(r"[A-Za-z0-9\-]+"), F.lit(0)), lambda w: F.length(w) >= 2)
    return F.array_sort(F.array_distinct(F.concat(terms, *brought, latin)))


def relation_score(source: Column, target: Column, relation: Column, evidence: Column, question: Column, wanted: Column) -> Column:
    """Points of a relation for a question and its keywords; missing parts are empty."""
    s, t, r, e = (F.coalesce(c, F.lit("")) for c in (source, target, relation, evidence))
    named = lambda c, n: F.when((c != "") & F.contains(question, c), n).otherwise(0)
    one, two, three = KEYWORD_POINTS
    each = lambda k: F.when(k == "", 0).when(F.contains(s, k) | F.contains(t, k), one).when(F.contains(r, k), two).when(F.contains(e, k), three).otherwise(0)
    points = F.aggregate(F.coalesce(wanted, F.array().cast("array<string>")), F.lit(0), lambda a, k: a + each(k))
    has = lambda c, ws: F.exists(F.array(*map(F.lit, ws)), lambda w: F.contains(c, w))
    whole = F.lower(F.concat_ws(" ", s, t, r, e))
    method = F.when(has(question, METHOD_QUESTION), F.when(has(whole, [w.lower() for w in METHOD_EVIDENCE]), METHOD_POINTS).otherwise(0) - F.when(r == VAGUE_RELATION, VAGUE_POINTS).otherwise(0)).otherwise(0)
    return named(s, END_POINTS) + named(t, END_POINTS) + named(r, RELATION_POINTS) + points + method
