"""Claims of several sources to one value, its source and what disagrees."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import jaccard, missing_to_null, normalize_default, parse_date

CLAIMS = "artifact_id string, field string, source string, ord int, value string"
KEYS = ("artifact_id", "field")
#: A source that the model answered for counts as the paper.
PAPER = "paper"


def ordered_claims(claims: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Claims with a value; '' means none."""
    named = F.when(F.col("source").startswith("llm"), F.lit(PAPER)).otherwise(F.col("source"))
    return claims.select(*keys, named.alias("source"), "ord", missing_to_null(F.col("value")).alias("value")).where("value is not null")


def prioritise(claims: DataFrame, priority: DataFrame, keys: tuple[str, ...] = KEYS, unlisted: int = 1000) -> DataFrame:
    """Re-rank claims by priority (field, source, ord): listed sources first, others after in their own order.

    The priority table holds a few sources for each field and is broadcast by its size.
    """
    p = priority.select("field", "source", F.col("ord").alias("listed"))
    joined = claims.join(p, ["field", "source"], "left")
    return joined.withColumn("ord", F.coalesce("listed", F.lit(unlisted) + F.col("ord"))).select(*claims.columns)


def _gathered(claims: DataFrame, norm: Column, keys: tuple[str, ...]) -> DataFrame:
    """One row for each artifact and field; its claims are as many as sources are asked."""
    one = F.struct("ord", "source", "value", "norm")
    return claims.withColumn("norm", norm).groupBy(*keys).agg(F.sort_array(F.collect_list(one)).alias("c"))


def _listed(losers: Column) -> Column:
    return F.when(F.size(losers) > 0, F.array_join(F.transform(losers, lambda x: F.concat(x["source"], F.lit(": "), x["value"])), ", "))


def resolve(claims: DataFrame, normaliser: Callable[[Column], Column] = normalize_default, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """claims (artifact_id, field, source, ord, value) -> (artifact_id, field, value, source, conflict).

    The first claim wins; of three claims of which two agree under the normaliser, the first of the two. conflict
    lists the claims that lost, in order, unless all agree. Groups without a value give no row.
    """
    g = _gathered(ordered_claims(claims, keys), normaliser(F.col("value")), keys)
    c, first = F.col("c"), F.col("c")[0]
    distinct = F.size(F.array_distinct(F.transform(c, lambda x: x["norm"])))
    two_of_three = (F.size(c) == 3) & (distinct == 2)
    agreed = F.when(F.size(F.filter(c, lambda x: x["norm"] == first["norm"])) == 2, first["norm"]).otherwise(F.get(c, F.lit(1))["norm"])
    winner = F.when(two_of_three, F.filter(c, lambda x: x["norm"] == agreed)[0]).otherwise(first)
    losers = F.when(two_of_three, F.filter(c, lambda x: x["norm"] != agreed)).when(distinct > 1, F.slice(c, 2, 1 << 30)).otherwise(F.slice(c, 1, 0))
    return g.select(*keys, winner.alias("w"), _listed(losers).alias("conflict")).select(*keys, "w.value", "w.source", "conflict")


def resolve_fuzzy(claims: DataFrame, threshold: float = 0.5, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """As ``resolve``, but claims join the first group whose first value is similar enough; the largest group wins, the first of equals."""
    g = _gathered(ordered_claims(claims, keys), F.lit(None).cast("string"), keys)
    item = g.schema["c"].dataType.elementType.simpleString()
    none = F.array().cast(f"array<array<{item}>>")

    def step(groups: Column, x: Column) -> Column:
        fits = F.transform(groups, lambda group: jaccard(group[0]["value"], x["value"]) >= threshold)
        at = F.array_position(fits, F.lit(True))
        return F.when(at == 0, F.array_append(groups, F.array(x))).otherwise(F.transform(groups, lambda group, i: F.when(i + 1 == at, F.array_append(group, x)).otherwise(group)))

    groups = F.aggregate("c", none, step)
    most = F.array_max(F.transform("groups", lambda group: F.size(group)))
    at = F.array_position(F.transform("groups", lambda group: F.size(group) == F.col("most")), F.lit(True))
    out = g.select(*keys, groups.alias("groups")).withColumn("most", most).withColumn("at", at)
    ranked = F.flatten(F.transform(F.array_sort(F.transform("groups", lambda group, i: F.struct((-F.size(group)).alias("n"), i.alias("i"), group.alias("g")))), lambda s: s["g"]))
    best = F.element_at("groups", F.col("at").cast("int"))
    return out.select(*keys, best[0]["value"].alias("value"), best[0]["source"].alias("source"), _listed(F.slice(ranked, F.size(best) + 1, F.lit(1 << 30))).alias("conflict"))


def first_by_priority(claims: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    best = F.min_by(F.struct("value", "source"), "ord")
    return ordered_claims(claims, keys).groupBy(*keys).agg(best.alias("w")).select(*keys, "w.value", "w.source")


def resolve_dates(claims: DataFrame, mode: str = "latest", window_days: int = 7, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """claims of dates -> (keys, value, source, conflict_value, conflict_source, delta_days).

    The latest or earliest date in its own spelling, the first source of equals; unparsed claims are left out. The
    conflict is the date of another source that is most days away, if more than the window; whole days are
    floored, so that earlier and later gaps of part days differ.
    """
    if mode not in ("latest", "earliest"):
        raise ValueError(mode)
    parsed = ordered_claims(claims, keys).withColumn("ts", F.unix_micros(parse_date(F.col("value")))).where("ts is not null")
    sign = -1 if mode == "latest" else 1
    g = parsed.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct((F.col("ts") * sign).alias("rank"), "ord", "source", "value", "ts"))).alias("c"))
    best = F.col("c")[0]
    others = F.filter("c", lambda x: x["source"] != best["source"])
    day = 86_400_000_000
    gaps = F.transform(others, lambda x: F.struct((-F.abs(F.floor((best["ts"] - x["ts"]) / F.lit(day)))).alias("gap"), x["ord"].alias("ord"), x["source"].alias("source"), x["value"].alias("value")))
    far = F.get(F.array_sort(F.filter(gaps, lambda x: -x["gap"] > window_days)), F.lit(0))
    return g.select(*keys, best.alias("w"), far.alias("f")).select(*keys, "w.value", "w.source", F.col("f.value").alias("conflict_value"), F.col("f.source").alias("conflict_source"), (-F.col("f.gap")).cast("int").alias("delta_days"))


def resolve_fields(claims: DataFrame, rules: Mapping[str, tuple], priority: DataFrame | None = None) -> DataFrame:
    """Resolve each field by its rule: ('value', normaliser) or ('date', mode, window_days). One shuffle for each kind of rule."""
    ranked = prioritise(claims, priority) if priority is not None else claims
    out = None
    for rule in dict.fromkeys(rules.values()):
        own = ranked.where(F.col("field").isin([f for f, r in rules.items() if r == rule]))
        if rule[0] == "value":
            done = resolve(own, rule[1])
        else:
            d = resolve_dates(own, *rule[1:])
            text = F.when(F.col("conflict_source").isNotNull(), F.concat("conflict_source", F.lit(": "), "conflict_value"))
            done = d.select(*KEYS, "value", "source", text.alias("conflict"))
        out = done if out is None else out.unionByName(done)
    return out
