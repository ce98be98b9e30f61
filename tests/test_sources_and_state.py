"""The tree scan, the snapshot store, job streams and generation flows."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from quillspark.operators import evaluation as ev
from quillspark.operators import generation, snapshots
from quillspark.operators import outline as ol
from quillspark.sources.json_files import OUTLINE, events, write_page_files
from quillspark.sources.repo_files import IgnoreRules, scan
from quillspark.streaming import jobs


def test_scan(spark, tmp_path):
    def put(path, data=b"x = 1\n"):
        f = tmp_path / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(data)

    put("pkg/__init__.py")
    put(".github/ci.yml")
    put("src/a.ts", b"caf\xe9")
    put("node_modules/m/i.js")
    put("src/deep/er/z.go")
    put("lib/vendor/v.js")
    put("nul.py", b"a\0b")
    put("empty.py", b"")
    put("big.py", b"x\n" * 600_000)
    put("gen.py", b"# DO NOT EDIT\n")
    put("min.js", b"x" * 600)
    put("logo.PNG")
    put("secret/k.py")
    put("keep.log.py")
    put(".gitignore", b"secret/\n*.tmp.py\n!keep.tmp.py\n/only.py\n")
    put("a.tmp.py")
    put("keep.tmp.py")
    put("only.py")
    put("src/only.py")
    rows = scan(spark, str(tmp_path)).collect()
    assert [r.file_path for r in rows] == ["pkg/__init__.py", "src/a.ts", "src/deep/er/z.go", "src/only.py", ".github/ci.yml", ".gitignore", "keep.log.py", "keep.tmp.py"]
    a = rows[1]
    assert a.language == "typescript" and a.content == "caf�" and a.content_hash == hashlib.sha256(a.content.encode()).hexdigest()


def test_ignore_rules():
    r = IgnoreRules("# c\n*.log\n!keep.log\n/top\ndocs/**/x.md\nb?d\nfolder/\n[ab].txt\n")
    hits = {p: r.ignores(p, False) for p in ("a.log", "d/a.log", "keep.log", "top", "d/top", "docs/x.md", "docs/a/b/x.md", "bad", "folder", "folder/x", "a.txt", "c.txt")}
    assert [p for p, hit in hits.items() if hit] == ["a.log", "d/a.log", "top", "docs/x.md", "docs/a/b/x.md", "bad", "folder/x", "a.txt"]


def test_tree(spark):
    files = spark.createDataFrame([("src/index.ts",), ("src/lib/utils.ts",), ("README.md",)], "path string")
    assert [r.line for r in ol.tree_lines(files).orderBy("place").collect()] == ["src/", "  lib/", "    utils.ts", "  index.ts", "README.md"]
    assert ol.tree_lines(files.limit(0)).count() == 0


def test_store(spark, tmp_path):
    s = snapshots.Store(spark, str(tmp_path))
    s.upsert("repos", spark.createDataFrame([("o", "a", "o/a"), ("o", "b", "o/b")], "owner string, name string, full_name string"))
    s.upsert("repos", spark.createDataFrame([("o", "a", "o/a", "sha")], "owner string, name string, full_name string, last_commit_sha string"))
    repos = {r.full_name: r for r in s.read("repos").collect()}
    assert repos["o/a"].id == 1 and repos["o/a"].last_commit_sha == "sha" and repos["o/b"].default_branch == "main" and len(repos) == 2
    s.change("wikis", lambda w: snapshots.insert_version(w, spark.createDataFrame([(1, 1, "t"), (3, 2, "u")], "id long, repo_id long, title string")))
    s.change("wikis", lambda w: snapshots.insert_version(w, spark.createDataFrame([(2, 1, "t2")], "id long, repo_id long, title string")))
    assert {(r.id, r.version, r.status) for r in s.read("wikis").collect()} == {(1, 1, "generating"), (2, 2, "generating"), (3, 1, "generating")}
    page = "wiki_id long, page_id string, title string, content string, status string"
    s.upsert("wiki_pages", spark.createDataFrame([(1, "p", "T", "c", "completed"), (3, "q", "Q", None, None)], page))
    s.upsert("wiki_pages", spark.createDataFrame([(1, "p", "T2", None, None)], page))
    p = s.read("wiki_pages").where("page_id = 'p'").first()
    assert (p.title, p.content, p.status) == ("T2", "c", "pending")
    s.write("jobs", spark.createDataFrame([(1, 1, 1), (2, 2, 3)], "id long, repo_id long, wiki_id long").select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in s.read("jobs").schema if f.name not in ("id", "repo_id", "wiki_id")]))
    s.upsert("documents", spark.createDataFrame([(2, "x", "h")], "repo_id long, file_path string, content_hash string"))
    s.delete_wiki(1)
    assert s.read("jobs").where("wiki_id IS NULL").count() == 1 and s.read("wiki_pages").count() == 1 and s.read("repos").count() == 2
    s.delete_wiki(3)
    assert s.read("repos").count() == 1 and s.read("documents").count() == 0 and s.read("jobs").count() == 1


def test_worker(spark, tmp_path):
    s = snapshots.Store(spark, str(tmp_path))
    rows = spark.createDataFrame([(1, "processing", 1), (2, "pending", 3), (3, "pending", 2)], "id long, status string, t long").select("id", "status", F.timestamp_seconds("t").alias("created_at"))
    s.write("jobs", s.read("jobs").unionByName(rows.where("id = 1"), allowMissingColumns=True))
    seen = []

    def handle(job):
        seen.append(job["id"])
        if job["id"] == 2:
            raise ValueError("bad")
        return {"prompt": 5, "completion": 7, "cost": 0.5}

    w = jobs.Worker(s, handle)
    s.change("jobs", lambda j: j.unionByName(rows.where("id > 1"), allowMissingColumns=True))
    assert w.run(3, 0) == 2 and seen == [3, 2]
    got = {r.id: (r.status, r.error_message, r.total_cost) for r in s.read("jobs").collect()}
    assert got == {1: ("cancelled", None, None), 2: ("failed", "bad", None), 3: ("completed", None, 0.5)}


def test_progress_stream_equals_batch(spark, tmp_path):
    polls = [(1, 1, "processing", 5, "a"), (1, 2, "processing", 5, "a"), (1, 3, "processing", 9, "a"), (1, 4, "completed", 9, "b"), (1, 5, "completed", 9, "b"), (2, 1, "pending", 0, None), (2, 2, "failed", 0, "x"), (2, 3, "processing", 1, "y")]
    schema = "job_id long, seq long, status string, progress long, message string"
    df = spark.createDataFrame(polls, schema)
    batch = {(r.job_id, r.seq, r.progress) for r in jobs.progress_reports(df).collect()}
    df.where("seq <= 2").coalesce(1).write.parquet(str(tmp_path / "in"))
    df.where("seq > 2").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.stream_progress_reports(jobs.file_stream(spark, str(tmp_path / "in"), schema))
    q = stream.writeStream.format("memory").queryName("reports").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.job_id, r.seq, r.progress) for r in spark.table("reports").collect()} == batch == {(1, 1, 5), (1, 3, 9), (1, 4, 100), (2, 1, 0), (2, 2, 0)}


def test_folded_calls(spark):
    lines = [
        ("a", 1, '{"type":"assistant","message":{"content":[{"type":"text","text":"one"}]}}'),
        ("a", 2, "broken"),
        ("a", 3, '{"type":"result","result":"two","total_cost_usd":0.5,"duration_api_ms":7,"is_error":false,"usage":{"input_tokens":1,"cache_read_input_tokens":2,"output_tokens":3}}'),
        ("b", 1, '{"type":"item.completed","item":{"type":"agent_message","text":"hi"}}'),
        ("b", 2, '{"type":"turn.completed","usage":{"input_tokens":4,"output_tokens":5,"cached_input_tokens":1}}'),
        ("c", 1, '{"type":"turn.failed","error":{"message":"no"}}'),
    ]
    rows = {r.request: r for r in jobs.folded_calls(events(spark.createDataFrame(lines, "request string, seq long, value string"))).collect()}
    assert (rows["a"].text, rows["a"].input_tokens, rows["a"].cost_usd, rows["a"].duration_ms) == ("two", 3, 0.5, 7)
    assert (rows["b"].text, rows["b"].input_tokens, rows["b"].cached_tokens, rows["b"].is_error) == ("hi", 4, 1, False)
    assert rows["c"].is_error and rows["c"].error == "no"


def test_generation(spark, tmp_path):
    generation.register("claude-sonnet-4-6", lambda prompt, options: f"{len(prompt)} characters asked for this page.")
    pages = spark.createDataFrame([("p", "abc"), ("q", "abcd")], "page_id string, prompt string")
    made = {r.page_id: r for r in generation.generate_pages(pages, None, str(tmp_path / "made")).collect()}
    assert made["q"].status == "completed" and made["q"].content.endswith("4 characters asked for this page.")
    raw = spark.createDataFrame([("p", 1, "T", "# T\n\n## Code first\n\n[u](/x/a.ts)")], "page_id string, repo_id long, title string, content string")
    files, repos = spark.createDataFrame([(1, "a.ts")], "repo_id long, path string"), spark.createDataFrame([(1, "https://github.com/o/r", None)], "repo_id long, url string, default_branch string")
    assert generation.cleaned(raw, files, repos).first().content == "[u](https://github.com/o/r/blob/main/a.ts)"
    stored = spark.createDataFrame([("p", "old", ["a.ts"]), ("q", "old", ["b.ts"]), ("r", "old", None)], "page_id string, content string, file_paths array<string>")
    changed = spark.createDataFrame([("a.ts",)], "file_path string")
    assert [r.page_id for r in generation.to_sync(stored, changed, "1", "2").collect()] == ["p"]
    assert generation.to_sync(stored, changed, "1", "1").count() == 0
    updates = spark.createDataFrame([("p", "NO_CHANGES_NEEDED", "completed"), ("q", "new", "completed"), ("r", "new", "failed")], "page_id string, content string, status string")
    assert {r.page_id: r.content for r in generation.synced(stored, updates).collect()} == {"p": "old", "q": "new", "r": "old"}


def test_evaluation(spark, tmp_path):
    pages = spark.createDataFrame([("a", "S", "completed", "`src/a.ts` and `fake.ts`"), ("b", None, "failed", None), ("c", "S", "completed", "x y")], "title string, section string, status string, content string")
    files = spark.createDataFrame([("src/a.ts",), ("lib/b.ts",)], "path string")
    c = ev.citations(pages, files).first()
    assert (c.candidate_count, c.valid_count, c.validity, c.invalid_count, c.first_invalid) == (2, 1, 0.5, 1, "fake.ts")
    assert [r.path for r in ev.invalid_citations(pages, files).collect()] == ["fake.ts"]
    assert ev.citations(pages.limit(0), files).first().validity is None
    s = ev.sizes(pages).first()
    assert (s.sections, s.pages, s.completed_pages, s.failed_pages, s.total_words, s.avg_words_per_page) == (1, 3, 2, 1, 5, 3)
    w = spark.range(1).select(ev.winner(F.lit("A"), F.lit("B"), "x", "y").alias("a"), ev.winner(F.lit("A"), F.lit("A"), "x", "y").alias("b"), ev.winner(F.lit(None).cast("string"), F.lit("A"), "x", "y").alias("c")).first()
    assert tuple(w) == ("x", "tie", "tie")
    prompts = spark.createDataFrame([(i, "broken" if i == 2 else f"q{i}") for i in range(5)], "id long, prompt string")
    answers = ev.judged(prompts, lambda p: {"q": "A"}[p[0]] + p[1:], str(tmp_path / "answers"))
    assert {r.id: r.answer for r in answers.collect()} == {0: "A0", 1: "A1", 2: None, 3: "A3", 4: "A4"}
    assert ev.padded(pages, ["title", "status"])[1] == "a      completed"


def test_outline_normalised(spark):
    sections = [("overview", "Overview", [("p", "P", "d", ["README.md", "README.md", "gone.ts", "docs/a.md"], ["flow"])]), ("s", "S", [("q", "Q", "d", [f"f{i}.ts" for i in range(30)], None)])]
    text = __import__("json").dumps({"title": "T", "sections": [{"id": a, "title": b, "pages": [dict(zip(("id", "title", "description", "filePaths", "diagrams"), p, strict=True)) for p in ps]} for a, b, ps in sections]})
    outlines = spark.createDataFrame([(1, text)], "k int, t string").select("k", F.from_json("t", OUTLINE).alias("outline"))
    paths = ["README.md", "docs/a.md", "src/index.ts", "package.json", *[f"f{i}.ts" for i in range(30)]]
    files = spark.createDataFrame([(1, p, i) for i, p in enumerate(paths)], "k int, path string, pos long")
    got = {r.id: r for r in ol.normalised(ol.flat_pages(outlines, "k"), files, "k").collect()}
    assert got["p"].file_paths == ["README.md", "docs/a.md", "package.json", "src/index.ts"] and got["p"].diagrams == ["flow"]
    assert len(got["q"].file_paths) == 25 and got["q"].diagrams is None
    assert outlines.select(ol.problem(F.col("outline")).alias("r")).first().r is None


def test_page_files(spark, tmp_path):
    p = spark.createDataFrame([("p", "T", "S", "c", 0, "completed"), ("q", "U", None, None, 11, "failed")], "page_id string, title string, section string, content string, sort_order int, status string")
    write_page_files(p, str(tmp_path / "pages"))
    assert (tmp_path / "pages" / "01-p.md").read_text() == "# T\n\n> Section: S \u00b7 Status: completed\n\nc"
    assert (tmp_path / "pages" / "12-q.md").read_text() == "# U\n\n> Section: (none) \u00b7 Status: failed\n\n_(no content)_"


def test_store_of_several_tables(spark, tmp_path):
    """One manifest for a change of several tables; ids that were given are never given again; one of two writers fails."""
    s = snapshots.Store(spark, str(tmp_path))
    row = lambda name: spark.createDataFrame([("o", name, f"o/{name}")], "owner string, name string, full_name string")
    s.upsert("repos", row("a"))
    s.upsert("repos", row("b"))
    s.change("repos", lambda r: r.where("id < 2"))
    s.upsert("repos", row("c"))
    assert {(r.name, r.id) for r in s.read("repos").collect()} == {("a", 1), ("c", 3)}
    number = s._manifest()[0]
    (tmp_path / "manifests" / str(number + 1)).write_text("{}")
    other = s._manifest
    s._manifest = lambda: (number, other()[1])
    with pytest.raises(Exception, match="exists"):
        s.write("repos", s.spark.createDataFrame([], s.read("settings").schema).select(F.lit(1).alias("id"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in snapshots._schema(snapshots.SCHEMAS["repos"]) if f.name != "id"]))


def test_many_new_ids(spark, monkeypatch):
    monkeypatch.setattr(snapshots, "ONE_TASK", 10)
    new = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"))
    rows = snapshots.with_ids(new, spark.range(5), ["k"], after=9).collect()
    assert sorted((r.k, r.id) for r in rows) == [(i, i + 10) for i in range(1000)]


def test_clone_goes_with_the_last_version(spark, tmp_path):
    assert snapshots.safe_to_delete("/d/repos/a", "/d/repos") and not any(snapshots.safe_to_delete(p, "/d/repos") for p in ("/d/repos", "/d/repos/../x", "/d/reposx/a", "", None))
    for i, (kind, below) in enumerate((("github", True), ("github", False), ("local", True))):
        root = tmp_path / str(i)
        clone = root / ("repos" if below else "other") / "o" / "a"
        clone.mkdir(parents=True)
        s = snapshots.Store(spark, str(root / "store"))
        s.upsert("repos", spark.createDataFrame([("o/a", str(clone))], "full_name string, clone_path string"))
        s.change("wikis", lambda w, k=kind: snapshots.insert_version(w, spark.createDataFrame([(1, 1, k)], "id long, repo_id long, source_type string")))
        s.delete_wiki(1, str(root / "repos"))
        assert clone.exists() == (i > 0) and s.read("repos").count() == 0


def test_claim_of_a_job_that_is_gone(spark, tmp_path):
    j = spark.createDataFrame([(1, "pending", 1), (2, "cancelled", 2), (3, "pending", 3)], "id long, status string, t long").select("id", "status", F.timestamp_seconds("t").alias("created_at"), F.lit(None).cast("timestamp").alias("started_at"))
    state = lambda df: {r.id: r.status for r in df.collect()}
    assert snapshots.oldest_pending(j) == 1 and state(snapshots.claim(j, F.current_timestamp())) == {1: "processing", 2: "cancelled", 3: "pending"}
    assert state(snapshots.claim(j, F.current_timestamp(), 2)) == {1: "pending", 2: "cancelled", 3: "pending"}
    s = snapshots.Store(spark, str(tmp_path))
    w = jobs.Worker(s, lambda job: (s.change("jobs", lambda x: snapshots.cancel(x, job["id"], F.current_timestamp())), {"prompt": int(job["cancelled"]())})[1])
    s.change("jobs", lambda x: x.unionByName(j.where("id = 3"), allowMissingColumns=True))
    assert w.step() and not w.step() and [r.status for r in s.read("jobs").collect()] == ["cancelled"]


def test_sync(spark, tmp_path):
    s = snapshots.Store(spark, str(tmp_path))
    s.upsert("repos", spark.createDataFrame([("o/a", "one")], "full_name string, last_commit_sha string"))
    s.change("wikis", lambda w: snapshots.insert_version(w, spark.createDataFrame([(1, 1, "t")], "id long, repo_id long, title string")))
    s.upsert("documents", spark.createDataFrame([(1, "a.ts", "h0"), (1, "b.ts", "h0"), (1, "c.ts", "h0")], "repo_id long, file_path string, content_hash string"))
    s.upsert("wiki_pages", spark.createDataFrame([(1, "p", "P", "old", '["a.ts"]', "completed"), (1, "q", "Q", "old", '["c.ts"]', "completed")], "wiki_id long, page_id string, title string, content string, file_paths string, status string"))
    at, changed = ["one"], []
    scan = lambda folder: spark.createDataFrame([("a.ts", "h1"), ("c.ts", "h9")], "file_path string, content_hash string")
    update = lambda pages: pages.select("page_id", F.lit("new").alias("content"), F.lit("completed").alias("status"))
    run = lambda f=update: generation.sync(s, 1, lambda: ("/x", at[0]), lambda folder, since: spark.createDataFrame([(x,) for x in changed], "file_path string"), scan, f)
    sha = lambda: s.read("repos").first().last_commit_sha
    assert run() == "up to date"
    at[0] = "two"
    assert run() == "no files changed" and sha() == "two"
    at[0] = "three"
    changed += ["a.ts", "b.ts"]
    with pytest.raises(ZeroDivisionError):
        run(lambda pages: 1 / 0)
    assert sha() == "two"
    assert run() == "1 pages updated" and sha() == "three"
    assert {(r.file_path, r.content_hash) for r in s.read("documents").collect()} == {("a.ts", "h1"), ("c.ts", "h0")}
    assert {(r.page_id, r.content) for r in s.read("wiki_pages").collect()} == {("p", "new"), ("q", "old")}


def test_git(spark, tmp_path):
    from quillspark.sources import git_repos as g

    env = ["-c", "user.name=n", "-c", "user.email=e@example.org"]
    source = tmp_path / "source"
    source.mkdir()
    assert g.local_repo(str(source)) == (str(source), None)
    with pytest.raises(ValueError):
        g.local_repo(str(tmp_path / "none"))
    g.git(["init", "-b", "trunk"], str(source))
    (source / "a.txt").write_text("one\n")
    g.git(["add", "."], str(source))
    g.git([*env, "commit", "-m", "first"], str(source))
    first = g.local_repo(str(source))[1]
    path, sha = g.clone("o", "r", str(tmp_path / "clones"), str(source))
    assert sha == first and g.default_branch(path) == "trunk" and g.default_branch(str(source)) == "main"
    (source / "\u00e9 name.txt").write_text("x\n")
    g.git(["add", "."], str(source))
    g.git([*env, "commit", "-m", "second"], str(source))
    again, sha = g.clone("o", "r", str(tmp_path / "clones"), str(source))
    assert again == path and sha != first
    files, diff, n, log = g.changes(spark, path, first)
    assert [r.file_path for r in files.collect()] == ["\u00e9 name.txt"] and n == 1 and "second" in log and "+x" in diff
    pinned = g.snapshot(str(source), first, str(tmp_path), "pin")
    assert g.local_repo(pinned)[1] == first and g.snapshot(str(source), first, str(tmp_path), "pin") == pinned
    for bad in (lambda: g.clone("o/..", "r", str(tmp_path)), lambda: g.changes(spark, path, "HEAD"), lambda: g.snapshot("x", "y", "z", "w")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(RuntimeError) as e:
        g.git(["clone", "/no/such/secret"], token="secret")
    assert "secret" not in str(e.value)


def test_json_files(spark, tmp_path):
    from quillspark.sources import json_files as j

    df = spark.createDataFrame([("p", "T", None, "completed", "c")], j.PAGES)
    j.write_json(df, str(tmp_path / "pages"))
    assert j.read_json(spark, str(tmp_path / "pages"), j.PAGES).collect() == df.collect()
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"type":"result","result":"x"}\nbroken\n\n{"type":"item.completed"}')
    kinds = lambda d: sorted(r[0] for r in d.select("e.type").collect())
    assert kinds(j.read_events(spark, str(tmp_path / "in"))) == ["item.completed", "result"]
    q = j.stream_events(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("json_events").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    with open(tmp_path / "in" / "a.jsonl", "a") as f:  # the last line ends only now
        f.write("\n")
    seen = kinds(spark.table("json_events"))
    q.processAllAvailable()
    q.stop()
    assert seen == ["result"] and kinds(spark.table("json_events")) == ["item.completed", "result"]
