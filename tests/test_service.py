"""The service's requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import service
from quillspark.operators.snapshots import Store, finish, insert_version


def test_requests(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    assert service.request_generation(s, None)[0] == service.request_generation(s, "no")[0] == 400
    assert service.request_generation(s, "o/r") == (200, {"job_id": 1})
    s.upsert("repos", spark.createDataFrame([("o", "r", "o/r")], "owner string, name string, full_name string"))
    assert service.request_update(s, "o", "r")[0] == 404 and service.view(s, "o", "r")[0] == 404
    wiki = spark.createDataFrame([(1, 1, "T", "completed")], "id long, repo_id long, title string, status string").withColumn("created_at", F.current_timestamp())
    s.change("wikis", lambda w: insert_version(w, wiki))
    assert service.request_generation(s, "https://github.com/o/r.git") == (200, {"wiki_id": 1, "exists": True})
    assert service.request_resume(s, 1)[0] == 400 and service.request_resume(s, 9)[0] == 404
    s.upsert("wiki_pages", spark.createDataFrame([(1, "p", "P")], "wiki_id long, page_id string, title string"))
    assert service.request_resume(s, 1) == (200, {"job_id": 2, "pages": 1})
    assert service.request_update(s, "o", "r") == (200, {"job_id": 2, "existing": True})
    assert [r.id for r in service.active_jobs(s).collect()] == [1, 2]
    assert service.cancel_job(s, "x")[0] == 400 and service.cancel_job(s, 7)[0] == 404 and service.cancel_job(s, 1)[0] == 200 and service.cancel_job(s, 1)[0] == 409
    s.change("jobs", lambda j: finish(j, 2, F.current_timestamp(), None, 1000, 2000, 0.1))
    row = service.wikis(s).collect()
    assert len(row) == 1 and (row[0].page_count, row[0].total_tokens, row[0].total_cost) == (1, 3000, 0.1)
    code, shown = service.view(s, "o", "r")
    assert code == 200 and shown["pages"].count() == 1 and shown["stats"]["total_cost"] == 0.1 and shown["active_job"] is None
    assert service.view(s, "o", "r", 1)[0] == 302 and service.view(s, "o", "r", 5)[0] == 404
    service.put_settings(s, {"parallelPageLimit": 11, "generationModel": "none", "showRepoOwner": False, "other": 1})
    assert service.settings(s) == {"generationModel": "claude-sonnet-4-6", "parallelPageLimit": 2, "showRepoOwner": False}
    service.put_settings(s, {"parallelPageLimit": "9"})
    assert service.settings(s)["parallelPageLimit"] == 5
    assert service.delete_wiki(s, 1)[0] == 200 and service.delete_wiki(s, 1)[0] == 404 and s.read("repos").count() == 0


def test_page_view(spark, tmp_path):
    import json

    s = Store(spark, str(tmp_path))
    s.upsert("repos", spark.createDataFrame([("o", "r", "o/r")], "owner string, name string, full_name string"))
    outline = {"title": "T", "sections": [{"id": "s", "title": "S", "pages": [{"id": "intro", "title": "First Steps"}, {"id": "gone", "title": "Gone"}]}]}
    s.change("wikis", lambda w: insert_version(w, spark.createDataFrame([(1, 1, json.dumps(outline))], "id long, repo_id long, structure string")))
    s.upsert("wiki_pages", spark.createDataFrame([(1, "intro", "First Steps", "text")], "wiki_id long, page_id string, title string, content string"))
    code, shown = service.page_view(s, "o", "r", "1.1-first-steps")
    assert code == 200 and shown["page"]["content"] == "text"
    assert service.page_view(s, "o", "r", "intro") == (302, {"location": "/o/r/1.1-first-steps"})
    assert service.page_view(s, "o", "r", "1.2-gone")[0] == service.page_view(s, "o", "r", "none")[0] == service.page_view(s, "o", "x", "intro")[0] == 404
    assert service.home(s)["wikis"].count() == 1 and service.home(s)["show_owner"] is True
