"""From outcomes to a report: scores, requirements, axes, cap, grade, fixes. Column expressions, one document a row.

Everything that the criteria decide (order, requirements, weights, bands) is decided while the plan is built.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkgauge.functions import text as T
from sparkgauge.plans.criteria import checks_for, resolution_order

CHECK = "check_id string, axis string, label string, severity string, source string, applicable boolean, score double, evidence " + T.EVIDENCE
_CHECK_TYPE = "struct<" + CHECK.replace(" string", ":string").replace(" boolean", ":boolean").replace(" double", ":double").replace("evidence array", "evidence:array") + ">"


def rounded(x: Column) -> Column:
    """Half up."""
    return F.floor(x + 0.5).cast("int")


def clamp(x: Column) -> Column:
    """Into 0 .. 100; null stays null."""
    return F.when(x.isNotNull(), F.least(F.lit(100.0), F.greatest(F.lit(0.0), x)))


def mechanical_score(scoring: dict, num: Column, boolean: Column) -> Column:
    """The score of a value; null for one that is missing, or for a scoring that isn't mechanical."""
    value = F.coalesce(num, boolean.cast("double"))
    kind = scoring["type"]
    if kind == "binary":
        fail = float(scoring.get("failScore") or 0)
        return F.when(value.isNotNull(), F.when(F.coalesce(boolean, F.lit(False)), 100.0).otherwise(fail))
    if kind == "bands":
        score = F.lit(None).cast("double")
        for band in reversed(scoring["bands"]):
            fits = F.lit(True) if band["upTo"] is None else value <= float(band["upTo"])
            score = F.when(fits, float(band["score"])).otherwise(score)
        return F.when(value.isNotNull(), score)
    if kind == "penalty":
        lowered = F.greatest(F.lit(float(scoring.get("floor") or 0)), F.lit(100.0) - float(scoring["perHit"]) * value)
        return F.when(value.isNotNull(), lowered)
    return F.lit(None).cast("double")


def ladder(criteria: dict, score: Column, field: str) -> Column:
    """label or color of the first grade, from the top, that the score reaches."""
    found = F.lit("unrated" if field == "label" else "red")
    for grade in sorted(criteria["grades"], key=lambda g: g["min"]):
        found = F.when(score >= grade["min"], grade[field]).otherwise(found)
    return found


def weighted_mean(pairs: list[tuple[float, Column, Column]]) -> Column:
    """Half-up mean of (weight, score, counts) over those that count; 0 without weight."""
    zero = F.lit(0.0)
    total = reduce(lambda a, b: a + b, [F.when(counts, float(w)).otherwise(0.0) for w, _, counts in pairs], zero)
    summed = reduce(lambda a, b: a + b, [F.when(counts, float(w) * s).otherwise(0.0) for w, s, counts in pairs], zero)
    return rounded(F.coalesce(F.try_divide(summed, total), zero))


class KindScorer:
    """The expressions for one kind of file, as columns to be added step by step so that none is repeated.

    ``outcome(check)`` gives (num, bool, evidence) of a mechanical check or None if it has none, ``finding(check)`` (score,
    evidence) of a model's finding, both as columns; a null num and bool, or score, is not applicable.
    """

    def __init__(self, criteria: dict, kind: str, prefix: str):
        self.criteria, self.kind, self.prefix = criteria, kind, prefix
        self.checks, self.never = resolution_order(checks_for(criteria, kind))

    def _name(self, check_id: str) -> str:
        return self.prefix + check_id.replace(".", "_").replace("-", "_")

    def score_steps(self, outcome, finding) -> list[dict[str, Column]]:
        """One column per check, its score, in steps that only need those before: a level of requirements each."""
        level: dict[str, int] = {}
        for c in self.checks:
            level[c["id"]] = 0 if c["id"] in self.never else 1 + max([level[r] for r in c.get("requires", [])], default=-1)
        steps = []
        for step in range(max(level.values(), default=0) + 1):
            new = {}
            for c in (c for c in self.checks if level[c["id"]] == step):
                if c["mode"] == "ai":
                    score = clamp(finding(c)["score"])
                else:
                    got = outcome(c)
                    score = F.lit(None).cast("double") if got is None else mechanical_score(c["scoring"], got["num"], got["bool"])
                met = F.lit(c["id"] not in self.never)
                for required in c.get("requires", []) if c["id"] not in self.never else []:
                    met = met & (F.coalesce(F.col(self._name(required)), F.lit(-1.0)) == 100.0)
                new[self._name(c["id"])] = F.when(met, score)
            steps.append(new)
        return steps

    def score(self, check: dict) -> Column:
        return F.col(self._name(check["id"]))

    def axis_scores(self) -> Column:
        axes = []
        for axis in self.criteria["axes"]:
            own = [c for c in self.checks if c["axis"] == axis["id"]]
            mean = weighted_mean([(c["weight"], self.score(c), self.score(c).isNotNull()) for c in own])
            count = reduce(lambda a, b: a + b, [self.score(c).isNotNull().cast("int") for c in own], F.lit(0))
            axes.append(
                F.struct(
                    F.lit(axis["id"]).alias("axis"), F.lit(axis["label"]).alias("label"), mean.alias("score"), count.alias("check_count"),
                    F.lit(len(own)).alias("total_checks"), ladder(self.criteria, mean, "color").alias("color"),
                )
            )
        return F.array(*axes)

    def overall(self, axis_scores: str, preset: str) -> Column:
        weights = self.criteria["presets"].get(preset, {"weights": {}})["weights"]
        pairs = []
        for i, axis in enumerate(self.criteria["axes"]):
            own = F.get(F.col(axis_scores), F.lit(i))
            pairs.append((weights.get(axis["id"], 0), own.getField("score").cast("double"), own.getField("check_count") > 0))
        return weighted_mean(pairs)

    def check_scores(self, outcome, finding, evidence: bool = True) -> Column:
        """array of checks in the order of resolution."""
        out = []
        for c in self.checks:
            got = finding(c) if c["mode"] == "ai" else outcome(c)
            there = self.score(c).isNotNull()
            told = F.lit(None).cast(T.EVIDENCE)
            if evidence and got is not None:
                told = F.when(there, got["evidence"])
            out.append(
                F.struct(
                    F.lit(c["id"]).alias("check_id"), F.lit(c["axis"]).alias("axis"), F.lit(c["label"]).alias("label"),
                    F.lit(c.get("severity")).cast("string").alias("severity"), F.lit(c["mode"]).alias("source"), there.alias("applicable"),
                    self.score(c).alias("score"), told.alias("evidence"),
                )
            )
        return F.array(*out) if out else F.array().cast(f"array<{_CHECK_TYPE}>")

    def blockers(self, check_scores: str) -> Column:
        found = F.filter(F.col(check_scores), lambda c: (c["severity"] == "blocker") & c["applicable"] & (c["score"] < 100))
        return F.transform(found, lambda c: F.struct(c["check_id"].alias("check_id"), c["label"].alias("label"), c["evidence"].alias("evidence")))

    def has_blocker(self) -> Column:
        own = [self.score(c) < 100 for c in self.checks if c.get("severity") == "blocker"]
        return reduce(lambda a, b: a | b, [F.coalesce(x, F.lit(False)) for x in own], F.lit(False))

    def fixes(self, check_scores: str) -> Column:
        """What scored under 100, by weight times what is missing, equals in the order of resolution."""
        facts = F.array(*[F.struct(F.lit(float(c["weight"])).alias("weight"), F.lit(c["fix"]).alias("fix")) for c in self.checks])
        items = F.transform(
            F.col(check_scores),
            lambda c, i: F.struct(
                (-(F.get(facts, i)["weight"] * (F.lit(100.0) - c["score"]))).alias("less"), i.alias("place"), c["check_id"].alias("check_id"),
                c["axis"].alias("axis"), F.coalesce(c["severity"], F.lit("info")).alias("severity"), F.get(facts, i)["fix"].alias("text"),
                c["evidence"].alias("evidence"),
            ),
        )
        # nothing else is compared, as places differ
        ranked = F.array_sort(F.filter(items, lambda x: x["less"].isNotNull() & (F.get(F.col(check_scores), x["place"])["score"] < 100)))
        return F.transform(
            ranked,
            lambda x: F.struct(
                x["check_id"].alias("check_id"), x["axis"].alias("axis"), x["severity"].alias("severity"), (-x["less"]).alias("impact"),
                x["text"].alias("text"), x["evidence"].alias("evidence"),
            ),
        )
