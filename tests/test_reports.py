"""Whole reports of three documents, under three presets, without and with findings."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sparkgauge.plans.analyze import analyze

DATA = Path(__file__).parent / "data"
DOCS = {
    "example.instructions.md": "good.instructions.md",
    ".github/copilot-instructions.md": "repo-wide.copilot-instructions.md",
    "blocker.instructions.md": "blocker.instructions.md",
}
FINDINGS = {
    "clarity.concrete-instructions": 70.0,
    "clarity.contradictions": 90.0,
    "completeness.project-context": 60.0,
    "completeness.scope-statement": 80.0,
    "completeness.output-constraint-sensible": 75.0,
}
# Worked out by hand: overall by preset (balanced, cost, security), what it was capped from, and the axes in their order.
EXPECTED = {
    ("example.instructions.md", False): ((77, 79, 84), (None,) * 3, (100, 100, 16, 70, 100)),
    ("example.instructions.md", True): ((80, 80, 86), (None,) * 3, (90, 100, 42, 70, 100)),
    (".github/copilot-instructions.md", False): ((86, 90, 90), (None,) * 3, (100, 100, 40, 92, 100)),
    (".github/copilot-instructions.md", True): ((88, 90, 91), (None,) * 3, (90, 100, 58, 92, 100)),
    ("blocker.instructions.md", False): ((40, 40, 40), (90, 92, 78), (100, 100, 100, 98, 50)),
    ("blocker.instructions.md", True): ((40, 40, 40), (84, 88, 74), (90, 100, 83, 98, 50)),
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(path, (DATA / name).read_text(encoding="utf-8")) for path, name in DOCS.items()]
    return spark.createDataFrame(rows, "path string, content string")


@pytest.fixture(scope="module")
def reports(spark, docs):
    findings = spark.createDataFrame([(p, c, s) for p in DOCS for c, s in FINDINGS.items()], "path string, check_id string, score double")
    found = {}
    for i, preset in enumerate(("balanced", "cost", "security")):
        for with_ai in (False, True):
            for r in analyze(docs, preset=preset, findings=findings if with_ai else None).collect():
                found[r["path"], with_ai, i] = r
    return found


@pytest.mark.parametrize(("path", "with_ai"), EXPECTED)
def test_scores(reports, path, with_ai):
    overall, capped, axes = EXPECTED[path, with_ai]
    for i in range(3):
        r = reports[path, with_ai, i]
        assert (r["overall_score"], r["capped_from"]) == (overall[i], capped[i])
        assert tuple(a["score"] for a in r["axis_scores"]) == axes


def test_kinds_grades_and_fixes(reports):
    good = reports["example.instructions.md", False, 0]
    assert good["file_kind"] == "scoped"
    assert (good["grade"]["label"], good["grade"]["color"]) == ("solid", "green")
    assert [f["check_id"] for f in good["fixes"]] == ["completeness.examples", "cost.output-constraint", "completeness.dos-and-donts"]
    assert [f["impact"] for f in good["fixes"]] == [300, 300, 120]
    wide = reports[".github/copilot-instructions.md", False, 0]
    assert wide["file_kind"] == "repo-wide" and len(wide["check_scores"]) == 20 and len(good["check_scores"]) == 24
    assert [c["check_id"] for c in good["check_scores"]][-2:] == ["cost.output-constraint", "completeness.output-constraint-sensible"]
    bad = reports["blocker.instructions.md", True, 0]
    assert [f["check_id"] for f in bad["fixes"]] == [
        "security.secrets", "security.internal-hosts", "completeness.project-context", "clarity.concrete-instructions",
        "completeness.output-constraint-sensible", "completeness.scope-statement", "clarity.contradictions", "cost.no-inline-bulk",
    ]


def test_blocker_evidence_is_redacted(reports):
    blockers = reports["blocker.instructions.md", False, 0]["blockers"]
    assert [(b["check_id"], [tuple(e) for e in b["evidence"]]) for b in blockers] == [
        ("security.secrets", [(17, "key, use AKIA************ until the new one is there.", "cloud access key")]),
        ("security.internal-hosts", [(21, "served by feed*******.lan and by nothing else. Ask the owner", "host name of a private domain")]),
    ]


def test_without_evidence_scores_are_the_same(docs, reports):
    for r in analyze(docs, evidence=False).collect():
        assert r["overall_score"] == reports[r["path"], False, 0]["overall_score"]
        assert all(c["evidence"] is None for c in r["check_scores"])


def test_null_and_empty_content(spark):
    rows = analyze(spark.createDataFrame([("a.md", None), (None, ""), ("b\\.github\\copilot-instructions.md", "x")], "path string, content string"))
    found = {r["path"]: r for r in rows.select("path", "file_kind", "overall_score").collect()}
    assert found["a.md"]["overall_score"] == found[None]["overall_score"]
    assert found["b\\.github\\copilot-instructions.md"]["file_kind"] == "repo-wide"


def test_extra_columns_stay(docs):
    found = analyze(docs.withColumn("raw", F.lit(7)).withColumn("body", F.lit("x")), keep=("raw",))
    assert {r["raw"] for r in found.select("raw").collect()} == {7}


def test_long_layout_judges_each_row_by_its_own_criteria(docs, spark):
    import copy

    from sparkgauge.plans.criteria import load_criteria
    from sparkgauge.plans.long import criteria_tables, long_axes, long_overall, long_scores

    mild = load_criteria()
    strict = copy.deepcopy(mild)
    for c in strict["checks"]:
        c["weight"] += len(c["id"]) % 3
        if c["id"] == "completeness.examples":
            c["requires"] = ["clarity.filler-words", "structure.headings"]
        if c["id"] == "cost.redundancy":
            c["requires"] = ["completeness.examples"]
        if c["id"] == "completeness.dos-and-donts":
            c["requires"] = ["completeness.dos-and-donts"]
    strict["security"] = strict["security"] | {"blockerCapsOverallAt": 30}
    sets, presets = {"mild": mild, "strict": strict}, {"mild": "balanced", "strict": "cost"}
    findings = spark.createDataFrame([(p, c, s + i) for i, p in enumerate(DOCS) for c, s in FINDINGS.items()], "path string, check_id string, score double")
    wide = {name: analyze(docs, c, presets[name], findings=findings, evidence=False).persist() for name, c in sets.items()}
    tables = criteria_tables(spark, sets, presets)
    rows, measured, found = [], [], []
    for name, df in wide.items():
        tagged = df.withColumn("id", F.concat(F.lit(f"{name}:"), "path"))
        rows.append(tagged.select("id", F.lit(name).alias("criteria"), F.col("file_kind").alias("kind")))
        measured.append(tagged.select("id", F.explode_outer("measurements").alias("m")).select("id", "m.check_id", "m.value_num", "m.value_bool"))
        found.append(findings.select(F.concat(F.lit(f"{name}:"), "path").alias("id"), "check_id", "score"))
    odd = spark.createDataFrame([("x", "nothing", "scoped"), (None, "mild", "scoped"), ("bare", "mild", "scoped")], "id string, criteria string, kind string")
    scores = long_scores(rows[0].union(rows[1]).union(odd), measured[0].union(measured[1]), tables, found[0].union(found[1])).persist()
    axes = long_axes(scores)
    told = {(r["id"], r["check_id"]): (r["axis"], r["applicable"], r["score"]) for r in scores.collect()}
    by_axis = {(r["id"], r["axis"]): (r["score"], r["check_count"], r["total_checks"]) for r in axes.collect()}
    overall = {r["id"]: (r["overall_score"], r["capped_from"]) for r in long_overall(axes, tables).collect()}
    bare = {k for k in told if k[0] == "bare"}
    assert bare and not any(told[k][1] for k in bare) and overall.pop("bare") == (0, None) and "x" not in overall
    for name, df in wide.items():
        for r in df.collect():
            own = f"{name}:{r['path']}"
            assert overall.pop(own) == (r["overall_score"], r["capped_from"])
            assert {a["axis"]: (a["score"], a["check_count"], a["total_checks"]) for a in r["axis_scores"]} == {k[1]: v for k, v in by_axis.items() if k[0] == own}
            assert {c["check_id"]: (c["axis"], c["applicable"], c["score"]) for c in r["check_scores"]} == {k[1]: v for k, v in told.items() if k[0] == own}
    assert not overall
    assert long_scores(odd.filter("false"), measured[0].filter("false"), tables).count() == 0
    given = [rows[0].union(rows[1]), measured[0].union(measured[1])]
    for i, df in enumerate(given):
        given[i] = spark.createDataFrame(df.collect(), df.schema)
    plan = long_overall(long_axes(long_scores(*given, tables)), tables)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") + plan.count("Exchange REPARTITION") <= 2 and "SortMergeJoin" not in plan
