"""Scores in long layout: checks, requirements and weights as tables, so that each row may be judged by criteria of its own.

analyze() compiles one set of criteria into a projection. Here any number of sets (tools, versions, experiments) are rows of
small tables that grow with the criteria and not with the documents; what a document measured is joined with the checks of
its set and kind, requirements are settled level by level by relational division (as many requirements met as there are),
and axes and overall scores are sums. The measurements are shuffled once, by document; every step after that is by document, too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgauge.operators.scoring import clamp
from sparkgauge.plans.criteria import checks_for, resolution_order

_CHECKS = (
    "criteria string, kind string, check_id string, axis string, axis_place int, weight double, place int, level int, mode string, severity string, fix string, type string, fail double, per_hit double, "
    "floor double, bands array<struct<up_to:double,score:double>>, targets array<struct<check_id:string,level:int>>"
)
_WEIGHTS = "criteria string, axis string, axis_weight double, cap int"


def criteria_tables(spark: SparkSession, criteria: dict[str, dict], presets: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(checks, weights) of named sets of criteria, each under its own preset or the one that ``presets`` names. A check
    that can never be settled (a cycle, or a requirement that doesn't apply) has level -1; ``targets`` are the checks that require one."""
    checks, weights = [], []
    for name, c in criteria.items():
        axes = {a["id"]: i for i, a in enumerate(c["axes"])}
        preset = c["presets"][(presets or {}).get(name, c["defaultPreset"])]["weights"]
        weights += [(name, axis, float(preset.get(axis, 0)), int(c["security"]["blockerCapsOverallAt"])) for axis in axes]
        for kind in sorted({k["id"] for k in c["fileKinds"]} | {c["defaultFileKind"]}):
            order, never = resolution_order(checks_for(c, kind))
            level: dict[str, int] = {}
            for check in order:
                level[check["id"]] = -1 if check["id"] in never else 1 + max((level[r] for r in check.get("requires", [])), default=-1)
            for place, check in enumerate(order):
                own, s = check["id"], check["scoring"]
                targets = [(c["id"], level[c["id"]]) for c in order if own in c.get("requires", []) and c["id"] not in never]
                bands = [(float("inf") if b["upTo"] is None else float(b["upTo"]), float(b["score"])) for b in s.get("bands", [])]
                checks.append((
                    name, kind, own, check["axis"], axes[check["axis"]], float(check["weight"]), place, level[own], check["mode"], check.get("severity"), check["fix"], s["type"], float(s.get("failScore") or 0),
                    float(s.get("perHit") or 0), float(s.get("floor") or 0), bands, targets,
                ))
    return spark.createDataFrame(checks, _CHECKS), spark.createDataFrame(weights, _WEIGHTS)


def _score() -> Column:
    """What a value is worth, by the columns of its check."""
    value = F.coalesce("value_num", F.col("value_bool").cast("double"))
    band = F.get(F.filter("bands", lambda b: value <= b["up_to"]), F.lit(0))["score"]
    lowered = F.greatest(F.col("floor"), F.lit(100.0) - F.col("per_hit") * value)
    found = F.when(F.col("type") == "binary", F.when(F.coalesce("value_bool", F.lit(False)), 100.0).otherwise(F.col("fail")))
    found = found.when(F.col("type") == "bands", band).when(F.col("type") == "penalty", lowered)
    return F.when(F.col("mode") == "ai", clamp(F.col("finding"))).otherwise(F.when(value.isNotNull(), found))


def long_scores(docs: DataFrame, measured: DataFrame, tables: tuple[DataFrame, DataFrame], findings: DataFrame | None = None) -> DataFrame:
    """(id, criteria, kind, check_id, axis, place, weight, severity, applicable, score): a row per document and check.

    ``docs``: (id, criteria, kind), one row an id; a set or kind that isn't in the tables has no checks. ``measured``: (id, check_id, value_num, value_bool), at most one row each;
    ``findings``: (id, check_id, score), of several the largest counts (settle others before). Null ids are left out."""
    checks, _ = tables
    depth = max((r["level"] for r in checks.select("level").distinct().collect()), default=0)  # of the criteria
    own = docs.select("id", "criteria", "kind").filter("id is not null")
    asked = own.join(F.broadcast(checks.select("criteria", "kind", "check_id")), ["criteria", "kind"]).select("id", "check_id", "criteria", "kind")
    void = F.lit(None)
    rows = asked.select("id", "check_id", "criteria", "kind", void.cast("double").alias("value_num"), void.cast("boolean").alias("value_bool"), void.cast("double").alias("finding"))
    empty = [void.cast("string").alias("criteria"), void.cast("string").alias("kind")]
    rows = rows.unionByName(measured.select("id", "check_id", *empty, "value_num", "value_bool", void.cast("double").alias("finding")))
    if findings is not None:
        rows = rows.unionByName(findings.select("id", "check_id", *empty, void.cast("double").alias("value_num"), void.cast("boolean").alias("value_bool"), F.col("score").cast("double").alias("finding")))
    # One exchange, by document; groups and unions below keep to it.
    met = rows.repartition("id").groupBy("id", "check_id").agg(*[F.max(c).alias(c) for c in ("criteria", "kind", "value_num", "value_bool", "finding")]).filter("criteria is not null")
    scored = met.join(F.broadcast(checks), ["criteria", "kind", "check_id"])
    facts = ["criteria", "kind", "axis", "axis_place", "place", "level", "weight", "severity", "fix", "targets", "score"]
    scored = scored.withColumn("score", F.when(F.col("level") >= 0, _score())).select("id", "check_id", *facts)
    for level in range(1, depth + 1):
        # A check hands itself on, and to each that requires it on this level whether it passed.
        passed = F.coalesce(F.col("score") == 100, F.lit(False))
        own = F.struct(F.col("check_id").alias("to"), F.lit(None).cast("boolean").alias("passed"))
        due = F.transform(F.filter("targets", lambda t: t["level"] == level), lambda t: F.struct(t["check_id"].alias("to"), passed.alias("passed")))
        told = scored.withColumn("e", F.explode(F.concat(F.array(own), due)))
        kept = [F.max(F.when(F.col("e.passed").isNull(), F.col(c))).alias(c) for c in facts]
        scored = told.groupBy("id", F.col("e.to").alias("check_id")).agg(*kept, F.min("e.passed").alias("passed"))
        scored = scored.withColumn("score", F.when(F.coalesce("passed", F.lit(True)), F.col("score"))).drop("passed")
    return scored.select("id", "criteria", "kind", "check_id", "axis", "axis_place", "place", "weight", "severity", F.col("score").isNotNull().alias("applicable"), "score", "fix")


def _mean(weight: str, score: str) -> Column:
    """Half-up mean of those that have a score; 0 without weight."""
    total = F.sum(F.when(F.col(score).isNotNull(), F.col(weight)))
    return F.floor(F.coalesce(F.try_divide(F.sum(F.col(weight) * F.col(score)), total), F.lit(0.0)) + 0.5).cast("int")


def long_axes(scores: DataFrame) -> DataFrame:
    """(id, criteria, kind, axis, score, check_count, total_checks) of long_scores()."""
    return scores.groupBy("id", "criteria", "kind", "axis").agg(
        _mean("weight", "score").alias("score"), F.count("score").cast("int").alias("check_count"), F.count(F.lit(1)).cast("int").alias("total_checks"), F.max(F.coalesce((F.col("severity") == "blocker") & (F.col("score") < 100), F.lit(False))).alias("blocked")
    )


def long_overall(axes: DataFrame, tables: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(id, criteria, kind, overall_score, capped_from) of long_axes()."""
    met = axes.join(F.broadcast(tables[1]), ["criteria", "axis"]).withColumn("counted", F.when(F.col("check_count") > 0, F.col("score").cast("double")))
    whole = met.groupBy("id", "criteria", "kind").agg(_mean("axis_weight", "counted").alias("whole"), F.max("blocked").alias("blocked"), F.max("cap").alias("cap"))
    capped = F.col("blocked") & (F.col("whole") > F.col("cap"))
    return whole.select("id", "criteria", "kind", F.when(capped, F.col("cap")).otherwise(F.col("whole")).alias("overall_score"), F.when(capped, F.col("whole")).alias("capped_from"))
