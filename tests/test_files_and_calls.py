"""Growing event files, files written by tasks, calls from executors."""

from __future__ import annotations

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from quillspark.sources import event_files, text_files
from quillspark.sources import json_files as j
from quillspark.streaming import calls, sinks


@pytest.mark.parametrize("piece", [64 << 20, 23])
def test_growing_files_give_each_line_once(spark, tmp_path, piece):
    """Files appended between batches, cut within lines and within characters."""
    folder, rnd = tmp_path / "in", random.Random(2)
    folder.mkdir()
    lines = {f"{n}.jsonl": [json.dumps({"type": "result", "result": f"é\U0001f600 {n} {i} " + "x" * rnd.randint(0, 60)}, ensure_ascii=False) for i in range(40)] + ["", "broken\r"] for n in "ab"}
    raw = {n: "".join(x + "\n" for x in ls).encode() for n, ls in lines.items()}
    table = sinks.BatchTable(spark, str(tmp_path / "out"), event_files.SCHEMA)
    stream = lambda: sinks.written_once(event_files.growing_lines(spark, str(folder), piece_bytes=piece), table, str(tmp_path / "cp"))
    q, sent = stream(), dict.fromkeys(raw, 0)
    try:
        for step in range(6):
            for name, data in raw.items():
                to = len(data) if step == 5 else min(len(data), sent[name] + rnd.randint(0, len(data) // 4))
                with open(folder / name, "ab") as f:
                    f.write(data[sent[name] : to])
                sent[name] = to
            q.processAllAvailable()
            if step == 2:
                q.stop()
                q = stream()
            got = {(os.path.basename(r.path), r.start): r.value for r in table.read().collect()}
            for name, data in raw.items():
                whole = data[: data.rfind(b"\n", 0, sent[name]) + 1]
                assert [v for (n, _), v in sorted(got.items()) if n == name] == [x.removesuffix("\r") for x in whole.decode().split("\n")[:-1]], (step, name)
    finally:
        q.stop()
    assert table.read().count() == sum(map(len, lines.values()))
    events = j.events(table.read().select(F.col("path").alias("request"), F.col("start").alias("seq"), "value"))
    assert events.where("e.type = 'result'").count() == 80


def test_a_file_that_shrank_is_an_error(tmp_path):
    (tmp_path / "a.jsonl").write_bytes(b"one\ntwo\nthr")
    reader = event_files._Reader({"path": str(tmp_path)})
    end = reader.latestOffset()
    assert list(end.values()) == [8] and event_files.offsets_of(json.dumps(end)) == end
    (tmp_path / "a.jsonl").write_bytes(b"one\n")
    with pytest.raises(ValueError):
        reader.partitions(end, reader.latestOffset())
    assert event_files._Reader({"path": str(tmp_path / "none")}).latestOffset() == {}


def test_files_are_written_together(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"p{i}", f"T{i}", None if i % 2 else "S", "completed", None if i == 3 else f"text é {i}") for i in range(40)], "sort_order int, page_id string, title string, section string, status string, content string")
    files = j.page_files(pages).repartition(5)
    folder = tmp_path / "run"
    j.write_page_files(files_of := pages.repartition(5), str(folder))
    want = {r.name: r.text for r in files.collect()}
    read = lambda: {p.name: p.read_bytes().decode() for p in folder.iterdir()}
    assert read() == want and len(want) == files_of.count()
    bad = files.withColumn("text", F.when(F.col("name").startswith("17"), F.raise_error(F.lit("no"))).otherwise(F.lit("new")))
    for broken in (bad, files.unionByName(files.limit(1)), files.withColumn("name", F.concat(F.lit("../"), "name"))):
        with pytest.raises(Exception):  # noqa: B017, PT011
            text_files.write_text_files(broken, str(folder))
        assert read() == want
    text_files.write_text_files(files.limit(1).withColumn("text", F.lit("new")), str(folder))
    assert sum(t == "new" for t in read().values()) == 1 and len(read()) == 40


@pytest.fixture
def model():
    def call(item):
        if item["id"] == 13:
            raise RuntimeError("no such page")
        if item["id"] == 14:
            time.sleep(30)
        return {"text": f"page {item['id']}", "cost": 0.25 if item["id"] != 15 else 2.5}

    return call


def test_one_failing_item_stays_one_items(spark, tmp_path, model):
    items = spark.range(1000).select("id", F.lit("prompt").alias("prompt"))
    got = {r.id: r for r in calls.called(items, model, str(tmp_path / "out"), at_once=9, seconds=2).collect()}
    assert len(got) == 1000
    assert {i for i, r in got.items() if r.status != "completed"} == {13, 14, 15}
    assert got[13].error == "no such page" and "no answer" in got[14].error and "over 2" in got[15].error and got[12].text == "page 12"


def test_spend_limit_half_way(spark, tmp_path, model):
    items = spark.range(1000).where("id < 13 OR id > 15").select("id")
    got = calls.called(items, model, str(tmp_path / "out"), at_once=4, spend=100.0).collect()
    done = [r for r in got if r.status == "completed"]
    assert len(got) == 997 and {r.status for r in got} == {"completed", "skipped"}
    assert 100.0 <= sum(r.cost for r in got) <= 100.0 + 4 * 0.25 and all(r.text == f"page {r.id}" for r in done)


def test_calls_are_tried_again(spark, tmp_path):
    seen = str(tmp_path / "seen")

    def flaky(item):
        with open(seen, "a") as f:
            f.write("x")
        if os.path.getsize(seen) < 3:
            raise RuntimeError("overloaded")
        return {"text": "ok", "cost": 0.5}

    run = lambda retry: calls.called(spark.range(1), flaky, str(tmp_path / "out"), 1, wait=lambda n: 0.0, retry=retry).first()
    assert run(lambda m: False).error == "overloaded"
    assert (r := run(lambda m: m == "overloaded")).text == "ok" and r.cost == 0.5
    assert calls.called(spark.range(0), flaky, str(tmp_path / "none")).collect() == []
