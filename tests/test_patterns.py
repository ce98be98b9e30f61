"""Many patterns in one pass, against a search for each pattern alone."""

from __future__ import annotations

import random
import subprocess
import sys
import time

import pytest
from conftest import REPO
from pyspark.sql import functions as F

from quillspark.operators import evaluation as ev
from quillspark.operators import patterns as pt


def drawn(seed: int):
    rnd = random.Random(seed)
    word = lambda a, b: "".join(rnd.choice("abAé.*(İ\U0001f600 ") for _ in range(rnd.randint(a, b)))
    texts = [(i, word(0, 5), rnd.choice([None, "", word(1, 200)]), "own") for i in range(60)]
    return texts, [(rnd.randint(0, 9), word(1, 4)) for _ in range(40)] + [(3, "aa"), (3, "aa"), (4, "aaa"), (5, ""), (6, None), (None, "a")]


def fold(t):
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in t)


def alone(texts, patterns, ignore_case):
    """Searches, one a pattern: `count` goes from left to right without overlaps."""
    out = {}
    put = fold if ignore_case else lambda t: t
    for key, title, content, _ in texts:
        for i, p in patterns:
            if p and i is not None:
                n = (put(title or "").count(put(p)), put(content or "").count(put(p)))
                old = out.get((key, i), (0, 0))
                out[key, i] = (old[0] + n[0], old[1] + n[1])
    return {k: v for k, v in out.items() if any(v)}


@pytest.mark.parametrize("ignore_case", [False, True])
@pytest.mark.parametrize("chars", [10**6, 17])
def test_counts_equal_searches(spark, ignore_case, chars):
    texts, patterns = drawn(3)
    df = spark.createDataFrame(texts, "k long, title string, content string, id string").repartition(3)
    pf = spark.createDataFrame(patterns, "id long, pattern string")
    got = pt.pattern_counts(df, ["k"], ["title", "content"], pf, ignore_case, chars)
    assert {(r.k, r.id): (r.n_title, r.n_content) for r in got.collect()} == alone(texts, patterns, ignore_case)
    assert pt.pattern_counts(df, ["k"], ["content"], pf.limit(0)).collect() == [] and pt.pattern_counts(df.limit(0), ["k"], ["content"], pf).collect() == []


def test_time_does_not_grow_with_patterns():
    rnd = random.Random(1)
    text = " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(60_000))
    words = list(dict.fromkeys(text.split()))

    def seconds(n: int) -> float:
        machine = pt.automaton(list(enumerate(words[:n])), False)
        best = 1e9
        for _ in range(3):
            began = time.perf_counter()
            pt.counts(machine, text)
            best = min(best, time.perf_counter() - began)
        return best

    assert seconds(20_000) < 12 * seconds(200)  # a search for each would take a hundred times as long


def test_best_pages(spark):
    pages = [(10, 0, "Install", "how to INSTALL it now"), (11, 1, "API", "install " * 3 + "words " * 5), (12, 2, "The a.b", "a.b A.B axb c"), (13, 3, "Empty", None)]
    df = spark.createDataFrame(pages, "page_id long, pos long, title string, content string")
    topics = {"setup": ["install", "install"], "dots": ["a.b"], "none": ["zzz", "(x)"], "tie": ["w"]}
    got = {r.topic: (r.page_id, r.score) for r in ev.best_pages(df, spark.createDataFrame([(t, k) for t, ks in topics.items() for k in ks], "topic string, keyword string")).collect()}
    assert got == {"setup": (10, pytest.approx(2 * (5 + 1) * 1000 / 5)), "dots": (12, pytest.approx((2 + 5) * 1000 / 4)), "none": (10, 0.0), "tie": (11, pytest.approx(5 * 1000 / 9))}


def test_coverage(spark):
    pages = spark.createDataFrame([("`src/a.ts`",), (None,), ("x b.ts",)], "content string")
    names = lambda *x: spark.createDataFrame(list(enumerate(x)), "place int, pattern string")
    r = ev.coverage(pages, names("zz", "src/a.ts", "A.ts", "b.ts")).first()
    assert (r.covered, r.missing, r.coverage) == (["src/a.ts", "b.ts"], ["zz", "A.ts"], 0.5)
    r = ev.coverage(pages, names()).first()
    assert (r.covered, r.missing, r.coverage) == ([], [], 1.0)
    assert ev.coverage(pages.limit(0), names("a")).first().coverage == 0.0 and pages.where(F.col("content").isNull()).count() == 1


def test_few_patterns_are_covered_as_many_are(spark):
    texts, patterns = drawn(5)
    df = spark.createDataFrame(texts, "k long, title string, content string, id string")
    pf = spark.createDataFrame(patterns + [(70, "no such pattern"), (71, None), (72, "")], "id long, pattern string")
    rows = lambda few: sorted(((r.id, r.pattern, r.hit) for r in pt.covered(df, "content", pf, few).collect()), key=str)
    assert rows(0) == rows(1000) and {r[2] for r in rows(0)} == {True, False}


def test_a_worker_holds_little():
    """The largest automaton, by what a smaller one takes, in a process of its own."""
    code = """
import random, resource
from quillspark.operators import patterns as pt
rnd = random.Random(1)
words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(5, 12))) for _ in range(200_000)]
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
machine = pt.automaton(enumerate(words), False)
took = (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) * 1024
print(took / sum(map(len, words)) * pt.MAX_CHARS / 1e6)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=REPO)
    assert float(done.stdout.split()[-1]) < 500, done.stdout
