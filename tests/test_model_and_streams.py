"""Asking a model once, the order of findings, and reports of a stream over a restart."""

import os
import sys
import time
from collections import Counter

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from sparkgauge.operators import findings as L
from sparkgauge.plans.analyze import analyze, gather_findings
from sparkgauge.plans.criteria import pending_ai_checks
from sparkgauge.plans.default_criteria import COPILOT
from sparkgauge.streaming import analyze_stream, read_document_stream

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the model's class travels with the job


class Model:
    """Scores by the length of the request, notes each request in a file of its own, and dies at a text until it has died ``deaths`` times."""

    def __init__(self, notes, dies_at=None, deaths=0, fails_at=None):
        self.notes, self.dies_at, self.deaths, self.fails_at = str(notes), dies_at, deaths, fails_at

    def complete(self, system, user, schema, max_tokens):
        text = user.rsplit("```text\n", 1)[1].rsplit("\n```", 1)[0]
        died = [n for n in os.listdir(self.notes) if n.startswith("died")]
        if text == self.dies_at and len(died) < self.deaths:
            time.sleep(4)  # what others are asked about meanwhile is finished
            open(f"{self.notes}/died-{len(died)}", "w").close()
            os._exit(1)
        with open(f"{self.notes}/{time.time_ns()}-{os.getpid()}", "w") as f:
            f.write(text)
        if text == self.fails_at:
            raise RuntimeError("no answer")
        checks = pending_ai_checks(COPILOT, "scoped")
        return L.Answer({"findings": [{"checkId": c["id"], "score": len(text) % 100, "rationale": text} for c in checks]}, 7, 3)


def asked(notes):
    return Counter((notes / n).read_text() for n in os.listdir(notes) if not n.startswith("died"))


@pytest.fixture()
def docs(spark):
    texts = [f"text {i} " + "x" * i for i in range(20)] + ["text 3 xxx", "text 3 xxx", "", None]
    return spark.createDataFrame([(f"{i}.instructions.md", t, i) for i, t in enumerate(texts)], "path string, content string, key int"), texts


def test_no_text_is_asked_about_twice(spark, docs, tmp_path):
    docs, texts = docs
    notes, ledger = tmp_path / "notes", str(tmp_path / "ledger")
    notes.mkdir()
    deadly = Model(notes, dies_at=texts[11], deaths=1)
    with pytest.raises(Exception):  # noqa: B017 - a local master gives a task one attempt
        L.ask_once(docs, deadly, COPILOT, ledger, rows_per_task=1).collect()
    before = asked(notes)
    assert texts[11] not in before and len(before) > 5
    found = L.ask_once(docs, deadly, COPILOT, ledger, rows_per_task=1)
    assert found.columns == ["path", "content", "key", "ai_findings", "ai_error", "usage"]
    rows = found.collect()
    wanted = {t or "" for t in texts}
    # only what the task that died had been through may be asked about again, and a task has one text, or a few by chance
    twice = {t: n for t, n in asked(notes).items() if n > 1}
    assert set(asked(notes)) == wanted and len(twice) <= 3 and all(n == 2 for n in twice.values()) and before.keys() - twice.keys()
    kept = sum(asked(notes).values())
    for r in rows:
        assert r["ai_error"] is None and r["usage"] == (7, 3) and {f["score"] for f in r["ai_findings"]} == {len(r["content"] or "") % 100}
    assert len(rows) == len(texts)
    L.ask_once(docs, deadly, COPILOT, ledger).collect()
    assert sum(asked(notes).values()) == kept
    changed = COPILOT | {"checks": [c | ({"question": "?"} if c["mode"] == "ai" else {}) for c in COPILOT["checks"]]}
    L.ask_once(docs.limit(2), deadly, changed, ledger, batch_rows=1).collect()
    assert sum(asked(notes).values()) == kept + 2
    scores = analyze(found, COPILOT).select("overall_score").collect()
    assert len(scores) == len(texts)


def test_errors_are_asked_about_again(spark, docs, tmp_path):
    docs, texts = docs
    notes, ledger = tmp_path / "notes", str(tmp_path / "ledger")
    notes.mkdir()
    few = docs.filter("key < 3")
    bad = L.ask_once(few, Model(notes, fails_at=texts[1]), COPILOT, ledger).collect()
    assert [r["ai_error"] for r in sorted(bad, key=lambda r: r["key"])] == [None, "the provider failed: no answer", None]
    good = L.ask_once(few, Model(notes), COPILOT, ledger).collect()
    assert [r["ai_error"] for r in good] == [None] * 3 and asked(notes) == {texts[0]: 1, texts[1]: 2, texts[2]: 1}
    none = L.ask_once(docs, None, COPILOT, str(tmp_path / "other")).collect()
    assert {r["ai_error"] for r in none} == {"there is no answer in the ledger"}
    assert L.ask_once(docs.filter("false"), Model(notes), COPILOT, ledger).count() == 0


def test_the_last_finding_counts_however_rows_are_dealt(spark, tmp_path):
    rows = [(f"p{i % 7}", "clarity.contradictions", float(i % 100), f"r{i}") for i in range(3000)]
    for part in range(3):
        spark.createDataFrame(rows[part * 1000 : part * 1000 + 1000], "path string, check_id string, score double, rationale string").coalesce(1).write.mode("append").parquet(str(tmp_path / "findings"))
        time.sleep(0.01)
    stored = spark.read.parquet(str(tmp_path / "findings"))
    place = stored.select("path", "rationale", "_metadata.file_path", "_metadata.row_index").collect()
    wanted = {p: [r["rationale"] for r in sorted((r for r in place if r["path"] == p), key=lambda r: (r["file_path"], r["row_index"]))] for p in {r["path"] for r in place}}
    for dealt in (stored, stored.repartition(5), stored.repartition(3, "score").filter("score >= 0"), stored.select("score", "path", "check_id", "rationale")):
        got = {r["path"]: [f["rationale"] for f in r["ai_findings"]] for r in gather_findings(dealt).collect()}
        assert got == wanted
    loose = spark.createDataFrame(rows[:700], "path string, check_id string, score double, rationale string")
    one, other = ({r["path"]: r["ai_findings"] for r in gather_findings(df).collect()} for df in (loose, loose.repartition(6)))
    assert one == other and one["p0"][-1]["score"] == max(r[2] for r in rows[:700] if r[0] == "p0")


def test_a_stream_of_documents_goes_on_after_a_restart(spark, tmp_path):
    folder, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    folder.mkdir()

    def run():
        docs = read_document_stream(spark, str(folder), files_per_trigger=2)
        reports = analyze_stream(docs, preset="security", evidence=False).select("path", "overall_score", "file_kind")
        query = reports.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(120)
        return query.lastProgress

    for i in range(3):
        (folder / f"a{i}.instructions.md").write_text(f"# Title {i}\n\nplease write AKIAIOSFODNN7EXAMPL{i}\n")
    run()
    assert spark.read.parquet(out).count() == 3
    (folder / "b.instructions.md").write_text("# Later\n")
    run()
    run()  # nothing new
    found = spark.read.parquet(out).collect()
    whole = analyze(spark.read.text(str(folder), wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")), preset="security", evidence=False)
    assert sorted(map(tuple, found)) == sorted(map(tuple, whole.select("path", "overall_score", "file_kind").collect())) and len(found) == 4
