"""One surviving record per group of duplicates, chosen field by field.

Two rules:

* :func:`best_values` keeps of each named field the highest value that is not null; of
  equal values the one with the smallest row id supplies it. One aggregation with
  partial sums on the map side; a group of any size costs one row per task.
* :func:`true_values` is the latent two-sided quality model for fields that may have
  several true values. A source that saw an entity claims some of the values offered
  for it and stays silent about the others. Sensitivity (how often a true value is
  claimed) and specificity (how often a false one is not) of every source and the truth
  of every value are inferred together by expectation-maximisation.

The model never iterates over facts: facts with the same pattern of claims and silences
share one posterior, so each step runs over distinct patterns with counts.

:func:`model_values` puts several fields of one table through the model at once: a field
is part of the entity, its values compared as text.

Defined results: rows whose key has a null belong to no group; NaN counts as null; a
group of one row or with only nulls in a field gives no row for it; repeated claims of
one source count once; empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphtrail.context import cut_lineage

#: Sources whose quality is kept in the driver; the pattern table joins beyond it.
MAX_SOURCES = 10_000


def _present(df: DataFrame, name: str) -> Column:
    c = F.col(f"`{name}`")
    return c.isNotNull() & ~F.isnan(c) if dict(df.dtypes)[name] in ("double", "float") else c.isNotNull()


def best_values(df: DataFrame, key: list[str], row_id: str, fields: list[str]) -> DataFrame:
    """Rows (key, field_name, row id, value) of the supplier of each surviving value."""
    best = [F.max(F.when(_present(df, f), F.struct(F.col(f"`{f}`").alias("value"), (-F.col(row_id)).alias("turn")))).alias(f"best_{f}") for f in fields]
    keyed = df.select(*key, row_id, *fields).where(reduce(Column.__and__, [F.col(k).isNotNull() for k in key]))
    groups = keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"), *best).where("rows > 1")
    pick = F.array(*[F.struct(F.lit(f).alias("field_name"), (-F.col(f"best_{f}.turn")).alias(row_id), F.col(f"best_{f}.value").cast("double").alias("value")) for f in fields])
    return groups.select(*key, F.explode(pick).alias("p")).select(*key, "p.*").where(F.col(row_id).isNotNull())


def claim_patterns(df: DataFrame, key: list[str], source: str, value: str) -> DataFrame:
    """One row per fact (key, value) with ``pattern``: who saw the entity and who claims it.

    A pattern is the sorted list of (source, claimed) as text. The number of sources of
    an entity bounds its length; rows of one source and value are counted once first.
    """
    rows = df.where(reduce(Column.__and__, [F.col(c).isNotNull() for c in [*key, source, value]]))
    claims = rows.select(*key, F.col(source).cast("string").alias("src"), F.col(value).alias("value")).distinct()
    seen = claims.groupBy(*key).agg(F.array_sort(F.collect_set("src")).alias("seen"))
    facts = claims.groupBy(*key, "value").agg(F.array_sort(F.collect_set("src")).alias("claim"))
    mark = F.transform("seen", lambda s: F.struct(s.alias("src"), F.array_contains("claim", s).alias("claimed")))
    return facts.join(seen, key).select(*key, "value", F.size("claim").alias("support"), mark.alias("votes")).withColumn("pattern", F.to_json("votes"))


def source_quality(patterns: DataFrame, rounds: int = 20, prior: tuple[float, float] = (10.0, 2.0)) -> tuple[DataFrame, DataFrame]:
    """(posterior per pattern, quality per source), after ``rounds`` steps of EM.

    ``patterns``: pattern, votes, facts. ``prior``: pseudo-counts of right and wrong
    behaviour of a source, for both sides. Starting posterior: the share of claims.
    """
    spark = patterns.sparkSession
    votes = patterns.select("pattern", "facts", F.explode("votes").alias("v")).select("pattern", "facts", F.col("v.src").alias("src"), F.col("v.claimed").alias("claimed"))
    votes = cut_lineage(votes)
    post = votes.groupBy("pattern").agg(F.avg(F.col("claimed").cast("double")).alias("truth"), F.first("facts").alias("facts"))
    if votes.select("src").distinct().limit(MAX_SOURCES + 1).count() > MAX_SOURCES:
        return _wide(votes, post, rounds, prior)
    post = cut_lineage(post)
    right, wrong = prior
    quality: dict[str, tuple[float, float]] = {}
    share = 0.5
    for _ in range(rounds):
        # M: expected confusion counts of every source; a few rows reach the driver.
        w = F.col("truth") * F.col("facts")
        u = (1 - F.col("truth")) * F.col("facts")
        said = F.col("claimed").cast("double")
        counts = votes.drop("facts").join(post, "pattern").groupBy("src").agg(F.sum(w * said), F.sum(w), F.sum(u * (1 - said)), F.sum(u)).collect()
        fresh = {r[0]: ((r[1] + right) / (r[2] + right + wrong), (r[3] + right) / (r[4] + right + wrong)) for r in counts}
        total = post.agg(F.sum(w), F.sum("facts")).first()
        share = min(max(total[0] / total[1], 0.01), 0.99) if total[1] else 0.5
        moved = max((abs(a - b) for s in fresh for a, b in zip(fresh[s], quality.get(s, (9, 9)))), default=0)
        quality = fresh
        # E: log odds are sums over the sources that saw the entity.
        rows = [(s, math.log(a / (1 - b)), math.log((1 - a) / b)) for s, (a, b) in quality.items()]
        table = spark.createDataFrame(rows or [("", 0.0, 0.0)], "src string, yes double, no double")
        odds = votes.join(F.broadcast(table), "src").groupBy("pattern").agg((F.sum(F.when(F.col("claimed"), F.col("yes")).otherwise(F.col("no"))) + math.log(share / (1 - share))).alias("odds"), F.first("facts").alias("facts"))
        post = cut_lineage(odds.select("pattern", (1 / (1 + F.exp(-F.col("odds")))).alias("truth"), "facts"))
        if moved < 1e-6:
            break
    return post, spark.createDataFrame([(s, *q) for s, q in quality.items()], "src string, sensitivity double, specificity double")


def _wide(votes: DataFrame, post: DataFrame, rounds: int, prior: tuple[float, float]) -> tuple[DataFrame, DataFrame]:
    """The same steps with source quality kept as a table, for very many sources."""
    right, wrong = prior
    said, w, u = F.col("claimed").cast("double"), F.col("truth") * F.col("facts"), (1 - F.col("truth")) * F.col("facts")
    quality, post = None, cut_lineage(post)
    for _ in range(rounds):
        last = quality
        total = post.agg(F.sum(w), F.sum("facts")).first()
        share = min(max(total[0] / total[1], 0.01), 0.99) if total[1] else 0.5
        counts = votes.drop("facts").join(post, "pattern").groupBy("src").agg(F.sum(w * said).alias("tp"), F.sum(w).alias("p"), F.sum(u * (1 - said)).alias("tn"), F.sum(u).alias("n"))
        quality = cut_lineage(counts.select("src", ((F.col("tp") + right) / (F.col("p") + right + wrong)).alias("sensitivity"), ((F.col("tn") + right) / (F.col("n") + right + wrong)).alias("specificity")))
        yes, no = F.log(F.col("sensitivity") / (1 - F.col("specificity"))), F.log((1 - F.col("sensitivity")) / F.col("specificity"))
        odds = votes.join(quality, "src").groupBy("pattern").agg((F.sum(F.when(F.col("claimed"), yes).otherwise(no)) + math.log(share / (1 - share))).alias("odds"), F.first("facts").alias("facts"))
        post = cut_lineage(odds.select("pattern", (1 / (1 + F.exp(-F.col("odds")))).alias("truth"), "facts"))
        if last is not None:
            was = last.select("src", *[F.col(c).alias(f"last_{c}") for c in ("sensitivity", "specificity")])
            step = F.greatest(*[F.abs(F.col(c) - F.col(f"last_{c}")) for c in ("sensitivity", "specificity")])
            if (quality.join(was, "src").agg(F.max(step)).first()[0] or 0) < 1e-6:
                break
    return post, quality


def true_values(df: DataFrame, key: list[str], source: str, value: str, threshold: float = 0.5, rounds: int = 20) -> DataFrame:
    """Every value of a multi-valued field judged true: (key, value, support, truth).

    An entity none of whose values reaches ``threshold`` keeps its likeliest one, the
    smallest of equals, so that no entity is lost.
    """
    facts = cut_lineage(claim_patterns(df, key, source, value))
    patterns = facts.groupBy("pattern").agg(F.first("votes").alias("votes"), F.count(F.lit(1)).cast("double").alias("facts"))
    post, _ = source_quality(patterns, rounds)
    scored = facts.drop("votes").join(post.select("pattern", "truth"), "pattern").drop("pattern")
    top = scored.groupBy(*key).agg(F.max(F.struct("truth", "support")).alias("top"))
    first = scored.join(top, key).where(F.struct("truth", "support") == F.col("top")).groupBy(*key).agg(F.min("value").alias("lead"))
    kept = scored.join(first, key).where((F.col("truth") >= threshold) | (F.col("value") == F.col("lead")))
    return kept.select(*key, "value", "support", F.round("truth", 6).alias("truth"))


def model_values(df: DataFrame, key: list[str], row_id: str, fields: list[str], source: Column, threshold: float = 0.5, rounds: int = 20) -> DataFrame:
    """Values of each field judged true for every group of rows, with their suppliers.

    Rows (key, field_name, value, support, truth, row id): of the rows that have the
    value the smallest id. A field of one value in a group is judged like any other.
    Sources have their own quality for each field.
    """
    each = [F.struct(F.lit(f).alias("field_name"), F.when(_present(df, f), F.col(f"`{f}`").cast("string")).alias("value")) for f in fields]
    rows = df.select(*key, row_id, source.cast("string").alias("_src"), F.explode(F.array(*each)).alias("_e")).select(*key, row_id, "_e.field_name", "_e.value", F.concat_ws(" ", "_e.field_name", "_src").alias("src")).where(F.col("value").isNotNull() & F.col("src").isNotNull())
    rows = cut_lineage(rows)
    entity = [*key, "field_name"]
    many = rows.groupBy(*entity).agg(F.countDistinct(row_id).alias("n")).where("n > 1").select(*entity)
    kept = true_values(rows.join(many, entity, "left_semi"), entity, "src", "value", threshold, rounds)
    supplier = rows.groupBy(*entity, "value").agg(F.min(row_id).alias(row_id))
    return kept.join(supplier, [*entity, "value"])
