"""analyze(): a report for each document of a DataFrame, in one narrow projection.

Rows are independent, so the plan has no shuffle (but for the join with findings, if there are any); the only Python is the
parser of YAML headers.
"""

from __future__ import annotations

import json
from itertools import zip_longest

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgauge.functions import text as T
from sparkgauge.operators.measures import MEASURES, Outcome, P, UnknownSet, phrases_sought, prepare
from sparkgauge.operators.scoring import KindScorer, ladder
from sparkgauge.plans.criteria import checks_for, kind_patterns, load_criteria, pending_ai_checks, validate_preset

FINDING = f"struct<check_id:string,score:double,rationale:string,evidence:{T.EVIDENCE}>"
FAILURES = "array<struct<check_id:string,message:string>>"
USAGE = "struct<input_tokens:bigint,output_tokens:bigint>"
REPORT = [
    "path", "tool", "criteria_version", "file_kind", "preset", "measurements", "ai_findings", "check_scores", "axis_scores", "overall_score",
    "capped_from", "grade", "blockers", "fixes", "failures", "ai_error", "usage",
]
#: Sets of expressions that are remembered.
REMEMBERED = 8
_MADE: dict[tuple, tuple[list[dict[str, Column]], dict[str, Column]]] = {}


def file_kind(path: Column, criteria: dict) -> Column:
    """The first kind whose glob fits the path (backslashes are slashes), else the default."""
    unified = F.replace(path, F.lit("\\"), F.lit("/"))
    found = F.lit(criteria["defaultFileKind"])
    for kind, regex in reversed(kind_patterns(criteria)):
        found = F.when(unified.rlike(regex), kind).otherwise(found)
    return found


def _stored_place(df: DataFrame) -> Column | None:
    """Where a row is stored, by file and row, if ``df`` comes from a scan of Parquet files; it is the same in every scan."""
    try:
        place = df.metadataColumn("_metadata")
        place = F.struct(place["file_path"].alias("file"), place["row_index"].alias("row"))
        df.select(place)
    except AnalysisException:
        return None
    return place


def gather_findings(findings: DataFrame, path: str = "path") -> DataFrame:
    """(path, ai_findings): the findings of each path as an array. A finding that comes later stands later, and of several
    for one check the last counts: by the column ``ord``; without one by the place where it is stored in Parquet files; of
    other tables, whose rows have no order, by score, rationale and evidence. None of it depends on how rows are dealt to tasks."""
    if "ord" not in findings.columns:
        place = _stored_place(findings)
        if place is None:
            place = F.struct("score", *[F.col(c).cast("string") for c in ("rationale",) if c in findings.columns], *[F.to_json(c).alias("told") for c in ("evidence",) if c in findings.columns])
        findings = findings.withColumn("ord", place)
    order = F.col("ord")
    one = F.struct(
        order.alias("ord"), "check_id", F.col("score").cast("double").alias("score"),
        (F.col("rationale") if "rationale" in findings.columns else F.lit(None)).cast("string").alias("rationale"),
        (F.col("evidence") if "evidence" in findings.columns else F.lit(None)).cast(T.EVIDENCE).alias("evidence"),
    )
    rows = findings.groupBy(F.col(path).alias("path")).agg(F.array_sort(F.collect_list(one)).alias("all"))
    return rows.select("path", F.transform("all", lambda f: F.struct(*[f[c].alias(c) for c in ("check_id", "score", "rationale", "evidence")])).alias("ai_findings"))


def analyze(
    docs: DataFrame, criteria: dict | None = None, preset: str | None = None, file_kind_id: str | None = None, findings: DataFrame | None = None,
    path: str = "path", content: str = "content", evidence: bool = True, keep: tuple[str, ...] = (),
) -> DataFrame:
    """One report per row of ``docs``: the columns of REPORT, and those in ``keep``.

    ``findings`` (path, check_id, score, ...) are a model's, made elsewhere; ``docs`` may instead have columns ai_findings,
    ai_error and usage, as run_ai_checks() adds them. With ``evidence=False`` no evidence is worked out. A null content is an
    empty text, a null path has the default kind.
    """
    criteria = criteria or load_criteria()
    if preset is not None:
        validate_preset(criteria, preset)
    preset = preset or criteria["defaultPreset"]
    kinds = [file_kind_id] if file_kind_id else [k["id"] for k in criteria["fileKinds"]]
    if not file_kind_id and criteria["defaultFileKind"] not in kinds:
        kinds.append(criteria["defaultFileKind"])
    given = {c: docs[c] for c in ("ai_findings", "ai_error", "usage") if c in docs.columns}
    kept = {f"keep_{i}": F.col(c) for i, c in enumerate(keep)}
    df = docs.select(
        F.col(path).alias("path"), F.col(content).alias("content"), *[c.alias(f"given_{n}") for n, c in given.items()], *[c.alias(n) for n, c in kept.items()]
    )
    if findings is not None:
        made = gather_findings(findings)
        df = df.join(made.withColumnRenamed("ai_findings", "given_ai_findings"), "path", "left")
    df = prepare(df, "content", _phrases(criteria, kinds)).drop("content")
    chosen = F.lit(file_kind_id) if file_kind_id else F.coalesce(file_kind(F.col("path"), criteria), F.lit(criteria["defaultFileKind"]))
    df = df.withColumn("file_kind", chosen)
    none = F.array().cast(f"array<{FINDING}>")
    df = df.withColumn("ai_findings", F.coalesce(F.col("given_ai_findings").cast(f"array<{FINDING}>"), none) if "given_ai_findings" in df.columns else none)

    steps, told = _expressions(docs.sparkSession.sparkContext.applicationId, criteria, preset, kinds, evidence)
    for step in steps:
        df = df.withColumns(step)
    told = told | {
        "ai_error": (F.col("given_ai_error") if "ai_error" in given else F.lit(None)).cast("string"),
        "usage": (F.col("given_usage") if "usage" in given else F.lit(None)).cast(USAGE),
    }
    return df.select(*[told.get(c, F.col(c)).alias(c) for c in REPORT], *[F.col(n).alias(c) for n, c in zip(kept, keep, strict=True)])


def _phrases(criteria: dict, kinds: list[str]) -> list[str]:
    return phrases_sought(criteria, [c for kind in kinds for c in checks_for(criteria, kind)])


def _expressions(application: str, criteria: dict, preset: str, kinds: list[str], evidence: bool) -> tuple[list[dict[str, Column]], dict[str, Column]]:
    """The columns to add to prepared documents, step by step, and those of the report by name.

    They name columns only, so they fit any DataFrame; making them takes Python far longer than Spark takes to plan them, so
    the last few sets are remembered."""
    key = (application, json.dumps(criteria, sort_keys=True), preset, tuple(kinds), evidence)
    if key not in _MADE:
        made = _make_expressions(criteria, preset, kinds, evidence)
        while len(_MADE) >= REMEMBERED:
            del _MADE[next(iter(_MADE))]
        _MADE[key] = made
    return _MADE[key]


def _make_expressions(criteria: dict, preset: str, kinds: list[str], evidence: bool) -> tuple[list[dict[str, Column]], dict[str, Column]]:
    # Each distinct measure once, whatever kinds and checks use it; one that can't be built fails for its checks alone.
    outcomes: dict[str, str] = {}
    found: dict[str, Outcome] = {}
    failed: dict[str, str] = {}
    columns: dict[str, Column] = {}
    shared: dict[str, Column] = {}
    secrets = [p for name in criteria["security"].get("redactWith", []) for p in criteria["sets"]["patterns"].get(name, [])]

    def key(check: dict) -> str:
        return json.dumps(check.get("measure"), sort_keys=True)

    for kind in kinds:
        for check in checks_for(criteria, kind):
            if check["mode"] != "mechanical" or not check.get("measure") or key(check) in outcomes or key(check) in failed:
                continue
            measure = check["measure"]
            if measure["type"] not in MEASURES:
                failed[key(check)] = f'nothing here measures "{measure["type"]}"'
                continue
            try:
                made = MEASURES[measure["type"]](measure.get("params") or {}, criteria)
                outcomes[key(check)] = name = f"m{len(outcomes)}"
                found[name] = made
            except UnknownSet as e:
                failed[key(check)] = str(e)
    phrases = _phrases(criteria, kinds)
    for name, made in found.items():
        if made.among is not None and phrases:
            made = made.among(F.col(P.hits), phrases)
        if evidence and made.shared is not None:
            shared[f"{name}_shared"] = made.shared()
            made = made.over(F.col(f"{name}_shared"))
        # Columns of their own: a struct's fields would be worked out anew wherever they are named.
        columns |= {f"{name}_{part}": made[part] for part in ("num", "bool", "evidence") if evidence or part != "evidence"}
    steps = [shared, columns]
    if evidence:
        # Redacted once, before kinds and checks take it, and by one expression for all of it.
        told = [c for c in columns if c.endswith("_evidence")]
        if told and secrets:
            steps.append({"evidence_of_all": F.transform(F.array(*told), lambda e: T.redact_evidence(e, secrets))})
        redacted = {c: F.get(F.col("evidence_of_all"), F.lit(i)) for i, c in enumerate(told)} if secrets else {}
        steps.append(redacted | {"ai_findings": _redacted(F.col("ai_findings"), secrets)})

    def outcome(check: dict) -> dict[str, Column] | None:
        parts = ("num", "bool", "evidence") if evidence else ("num", "bool")
        return {part: F.col(f"{outcomes[key(check)]}_{part}") for part in parts} if key(check) in outcomes else None

    def finding(check: dict) -> Column:
        return F.try_element_at(F.filter("ai_findings", lambda f: f["check_id"] == check["id"]), F.lit(-1))

    scorers = {kind: KindScorer(criteria, kind, f"k{i}_") for i, kind in enumerate(kinds)}
    for level in zip_longest(*[s.score_steps(outcome, finding) for s in scorers.values()], fillvalue={}):
        steps.append({name: column for own in level for name, column in own.items()})
    parts, axes, checks = {}, {}, {}
    for i, (kind, scorer) in enumerate(scorers.items()):
        axes[f"a{i}"], checks[f"c{i}"] = scorer.axis_scores(), scorer.check_scores(outcome, finding, evidence)
        parts[kind] = {
            "axis_scores": F.col(f"a{i}"), "check_scores": F.col(f"c{i}"), "overall": scorer.overall(f"a{i}", preset), "blocked": scorer.has_blocker(),
            "blockers": scorer.blockers(f"c{i}"), "fixes": scorer.fixes(f"c{i}"), "measurements": _measurements(criteria, kind, outcome, failed, key, evidence),
            "failures": _failures(criteria, kind, failed, key),
        }
    steps.append(axes | checks)

    def by_kind(name: str) -> Column:
        found = parts[kinds[-1]][name]
        for kind in reversed(kinds[:-1]):
            found = F.when(F.col("file_kind") == kind, parts[kind][name]).otherwise(found)
        return found

    steps.append({f"r_{n}": by_kind(n) for n in ("axis_scores", "check_scores", "overall", "blocked", "blockers", "fixes", "measurements", "failures")})
    cap = criteria["security"]["blockerCapsOverallAt"]
    capped = F.col("r_blocked") & (F.col("r_overall") > cap)
    score = F.when(capped, F.lit(cap).cast("int")).otherwise(F.col("r_overall"))
    told = {n: F.col(f"r_{n}") for n in ("measurements", "check_scores", "axis_scores", "blockers", "fixes", "failures")} | {
        "tool": F.lit(criteria["tool"]), "criteria_version": F.lit(criteria["criteriaVersion"]), "preset": F.lit(preset),
        "ai_findings": F.col("ai_findings") if evidence else _redacted(F.col("ai_findings"), secrets), "overall_score": score, "capped_from": F.when(capped, F.col("r_overall")),
        "grade": F.struct(ladder(criteria, score, "label").alias("label"), ladder(criteria, score, "color").alias("color")),
    }
    return [step for step in steps if step], told


def _redacted(entries: Column, patterns: list[dict]) -> Column:
    """An array of structs with their ``evidence`` redacted."""
    return F.transform(entries, lambda x: x.withField("evidence", T.redact_evidence(x["evidence"], patterns)))


def _measurements(criteria, kind, outcome, failed, key, evidence) -> Column:
    rows = []
    for c in checks_for(criteria, kind):
        if c["mode"] != "mechanical" or not c.get("measure") or key(c) in failed and failed[key(c)].startswith("nothing here measures"):
            continue
        got = outcome(c)
        none = F.lit(None).cast(T.EVIDENCE)
        rows.append(
            F.struct(
                F.lit(c["id"]).alias("check_id"), (F.lit(None) if got is None else got["num"]).cast("double").alias("value_num"),
                (F.lit(None) if got is None else got["bool"]).cast("boolean").alias("value_bool"), F.lit(got is not None).alias("applicable"),
                (none if got is None or not evidence else got["evidence"]).alias("evidence"),
            )
        )
    shape = f"array<struct<check_id:string,value_num:double,value_bool:boolean,applicable:boolean,evidence:{T.EVIDENCE}>>"
    return (F.array(*rows) if rows else F.array()).cast(shape)


def _failures(criteria, kind, failed, key) -> Column:
    rows = [
        F.struct(F.lit(c["id"]).alias("check_id"), F.lit(failed[key(c)]).alias("message"))
        for c in checks_for(criteria, kind)
        if c["mode"] == "mechanical" and c.get("measure") and key(c) in failed
    ]
    return (F.array(*rows) if rows else F.array()).cast(FAILURES)


__all__ = ["REPORT", "analyze", "file_kind", "gather_findings", "pending_ai_checks"]
