"""Records of runs and scores, prompts of pairs and outlines, older tables, settings, progress of jobs."""

from __future__ import annotations

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from quillspark.operators import evaluation as ev
from quillspark.operators import generation, service, snapshots
from quillspark.sources import json_files as j
from quillspark.streaming import jobs

PAGES = "title string, section string, status string, content string, model string, prompt_tokens long, completion_tokens long"


def pages_of(spark, rows):
    return spark.createDataFrame(rows, PAGES)


def test_run_record(spark, tmp_path):
    pages = pages_of(spark, [("a", "S", "completed", "x", "claude-sonnet-4-6", 1000, 2000), ("b", None, "failed", None, "claude-sonnet-4-6", 500, None), ("c", None, "pending", None, None, None, None)])
    start = dt.datetime(2024, 1, 1)
    keys = {"label": F.lit("base"), "repo": F.lit("o/r"), "sha": F.lit("0f"), "model": F.lit("claude-sonnet-4-6"), "contextMode": F.lit("agentic")}
    run = ev.run_record(pages, keys, F.lit(start), F.lit(start + dt.timedelta(minutes=3)))
    r = run.first().asDict(True)
    assert r["pageStats"] == {"total": 3, "completed": 1, "failed": 1} and r["durationMs"] == 180_000 and r["label"] == "base"
    assert r["totals"] == {"promptTokens": 1500, "completionTokens": 2000, "costUsd": pytest.approx((1500 * 3 + 2000 * 15) / 1e6)}
    j.write_json(run, str(tmp_path / "run"))
    assert j.read_json(spark, str(tmp_path / "run"), j.RUN).first().asDict(True) == r
    empty = ev.run_record(pages.limit(0), keys, F.lit(start), F.lit(start)).first()
    assert empty.pageStats.total == empty.totals.promptTokens == empty.totals.costUsd == 0


def test_score_record(spark):
    pages = pages_of(spark, [("a", "S", "completed", "`src/a.ts` and `fake.ts`", None, None, None), ("b", None, "failed", None, None, None, None)])
    files, core = spark.createDataFrame([("src/a.ts",)], "path string"), spark.createDataFrame([(0, "src/a.ts"), (1, "none.ts")], "place int, pattern string")
    qa = ev.scores(spark.createDataFrame([(1, "correct"), (2, "partial"), (3, "incorrect")], "id long, verdict string"), F.col("id") == 3)
    r = ev.score_record("base", pages, files, core, qa).first()
    assert (r.label, r.citation.validity, r.coverage.covered, r.coverage.missing, r.size.completed_pages, r.qa.score, r.qa.depth) == ("base", 0.5, ["src/a.ts"], ["none.ts"], 1, 0.5, 0.0)
    assert ev.score_record("x", pages, files, core).first().qa is None


def test_pair_prompts(spark):
    pairs = spark.createDataFrame([("t", "one", None), ("u", "x" * 40_001, "y" * 40_000)], "topic string, first string, second string")
    got = {r.id: r.prompt for r in ev.pair_prompts(pairs).collect()}
    assert set(got) == {"t/1", "t/2", "u/1", "u/2"}
    assert "## Page A\n\none\n\n## Page B\n\n\n\n" in got["t/1"] and "## Page A\n\n\n\n## Page B\n\none\n" in got["t/2"]
    cut = "x" * 40_000 + "\n\n[page truncated]\n"
    assert got["u/1"].count(cut) == got["u/2"].count(cut) == 1 and "y" * 40_000 + "\n\nAnswer" in got["u/1"]


def test_outline_prompts(spark):
    files = spark.createDataFrame([(1, "src/b.ts", 0), (1, "src/a.py", 1), (1, "README.md", 2), (1, "src/c.ts", 3), (2, "x.txt", 0)], "repo_id long, path string, pos long")
    repos = spark.createDataFrame([(1, "o/r", "Read me"), (2, "o/s", None), (3, "o/t", "")], "repo_id long, name string, readme string")
    got = {r.repo_id: r.prompt for r in generation.outline_prompts(files, repos).collect()}
    assert "```\nsrc/\n  a.py\n  b.ts\n  c.ts\nREADME.md\n```" in got[1] and "### Languages\ntypescript, python, markdown\n" in got[1] and "Read me" in got[1] and "### Files (4)" in got[1]
    assert "### Languages\n\n" in got[2] and "README" not in got[2] and "### Files (0)\n```\n\n```" in got[3] and "README" not in got[3]
    for n, words in ((5, "1-2 pages, no more"), (6, "1-3 sections"), (20, "1-3 sections"), (21, "2-5 sections"), (50, "2-5 sections"), (51, "3-7 sections")):
        many = spark.range(n).select(F.lit(1).cast("long").alias("repo_id"), F.concat(F.col("id").cast("string"), F.lit(".ts")).alias("path"), F.col("id").alias("pos"))
        assert words in generation.outline_prompts(many, repos.where("repo_id = 1")).first().prompt


def test_older_tables(spark, tmp_path):
    at = lambda d: dt.datetime(2024, 1, d)
    wikis = spark.createDataFrame([(3, 1, at(2), None), (1, 1, at(1), "failed"), (2, 1, at(2), None), (9, 2, at(5), None)], "id int, repo_id long, created_at timestamp, status string")
    got = snapshots.migrated("wikis", wikis)
    assert got.columns == [f.name for f in snapshots._schema(snapshots.SCHEMAS["wikis"])]
    assert {r.id: (r.version, r.source_type, r.status) for r in got.collect()} == {1: (1, "github", "failed"), 2: (2, "github", None), 3: (3, "github", None), 9: (1, "github", None)}
    docs = snapshots.migrated("documents", spark.createDataFrame([(1, 1, "a.ts", "text of the file", "h")], "id long, repo_id long, file_path string, content string, content_hash string"))
    assert "content" not in docs.columns and docs.first().content_hash == "h"
    store = snapshots.Store(spark, str(tmp_path))  # a store whose snapshot was written in the older form
    wikis.write.parquet(f"{tmp_path}/wikis/v1")
    os.makedirs(tmp_path / "manifests")
    (tmp_path / "manifests" / "1").write_text(json.dumps({"wikis": {"at": "v1", "before": None, "id": 9}}))
    assert sorted((r.id, r.version) for r in store.read("wikis").collect()) == [(1, 1), (2, 2), (3, 3), (9, 1)]
    store.change("wikis", lambda w: snapshots.insert_version(w, spark.createDataFrame([(10, 1)], "id long, repo_id long")))
    assert store.read("wikis").where("id = 10").first().version == 4


def test_settings_view(spark, tmp_path):
    s = snapshots.Store(spark, str(tmp_path))
    service.put_settings(s, {"parallelPageLimit": 4, "showRepoOwner": "false"})
    view = service.settings_view(s)
    assert view["current"] == {"generationModel": "claude-sonnet-4-6", "parallelPageLimit": 4, "showRepoOwner": False}
    assert view["defaults"] == {"generationModel": "claude-sonnet-4-6", "parallelPageLimit": 2, "showRepoOwner": True}
    assert {"id": "claude-opus-4-6", "input": 5.0, "output": 25.0} in view["generationModels"]


def test_links_out_of_the_root_are_not_deleted(tmp_path):
    root, other = tmp_path / "clones", tmp_path / "other"
    for d in (root / "in", other):
        d.mkdir(parents=True)
    (root / "out").symlink_to(other)
    safe = lambda p: snapshots.safe_to_delete(str(p), str(root))
    assert safe(root / "in") and not safe(root / "out") and not safe(root) and not safe(root / ".." / "other") and not snapshots.safe_to_delete(None, str(root))


def test_job_reports_progress(spark, tmp_path):
    s = snapshots.Store(spark, str(tmp_path))
    one = spark.createDataFrame([(1, "sync", "pending", dt.datetime(2024, 1, 1))], "id long, type string, status string, created_at timestamp")
    seen = []

    def handle(job):
        job["report"](40, "half")
        r = s.read("jobs").first()
        seen.append((r.status, r.progress, r.progress_message))
        return {"prompt": 3}

    w = jobs.Worker(s, handle)
    s.change("jobs", lambda x: x.unionByName(one, allowMissingColumns=True))
    assert w.step() and seen == [("processing", 40, "half")]
    done = s.read("jobs").first()
    assert (done.status, done.progress, done.total_prompt_tokens) == ("completed", 100, 3)
    s.change("jobs", lambda x: snapshots.report(x, 1, 5, "late"))
    assert s.read("jobs").first().progress == 100


def test_one_writer_alone_makes_a_manifest(spark, tmp_path):
    """Eight writers of the same number at once: one succeeds, and readers never see half of its manifest."""
    from concurrent.futures import ThreadPoolExecutor
    from threading import Barrier

    together = Barrier(8)

    def one(number: int) -> int:
        own = snapshots.Store(spark, str(tmp_path))
        together.wait()
        try:
            own.commit({}, number)
        except snapshots.Conflict:
            return 0
        return 1

    with ThreadPoolExecutor(8) as pool:
        for number in range(60):
            assert sum(pool.map(one, [number] * 8)) == 1
    assert snapshots.Store(spark, str(tmp_path))._manifest() == (60, {})


def test_no_change_of_two_writers_is_lost(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    s = snapshots.Store(spark, str(tmp_path))
    s.upsert("settings", spark.createDataFrame([("n", "0")], "key string, value string"))

    def one(i: int) -> None:
        own = snapshots.Store(spark, str(tmp_path))
        if i % 2:
            own.upsert("settings", spark.createDataFrame([(f"k{i}", str(i))], "key string, value string"))
        else:
            own.change("settings", lambda x: x.withColumn("value", F.when(F.col("key") == "n", (F.col("value").cast("int") + 1).cast("string")).otherwise(F.col("value"))))

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(one, range(8)))
    rows = {r.key: r.value for r in s.read("settings").collect()}
    assert rows == {"n": "4", "k1": "1", "k3": "3", "k5": "5", "k7": "7"}
    assert len({r.id for r in s.read("settings").collect()}) == 5
    with pytest.raises(snapshots.Conflict):
        s.commit({"settings": s.read("settings")}, 1)
