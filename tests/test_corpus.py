"""The corpus of a documentation, cut at limits around every page's end."""

from __future__ import annotations

import random

import pytest

from quillspark.operators import evaluation as ev

RULE, NOTE = "\n\n---\n\n", "\n\n[wiki content truncated for evaluation]"


def joined(pages, limit):
    """What joining all completed pages first and cutting then gives."""
    text = RULE.join(f"# {t}" + (f"\n_Section: {s}_" if s else "") + f"\n\n{c}" for _, t, s, status, c in sorted(pages, key=lambda p: p[0]) if c and status == "completed")
    return (text[:limit] + NOTE, True) if len(text) > limit else (text, False)


def test_cut_at_limits_around_every_end(spark):
    rnd = random.Random(3)
    wikis = {k: [(i, f"t{i}", rnd.choice([None, "", "s"]), rnd.choice(["completed"] * 5 + ["failed"]), rnd.choice([None, "", "x", "text é " * rnd.randint(1, 6)])) for i in range(rnd.randint(1, 9))] for k in range(6)}
    rows = [(k, *p) for k, pages in wikis.items() for p in pages]
    df = spark.createDataFrame(rows, "wiki long, pos int, title string, section string, status string, content string").cache()
    ends = set()
    for pages in wikis.values():
        at = 0
        for n in range(1, len(pages) + 1):
            at = len(joined(pages[:n], 10**9)[0])
            ends |= {at + d for d in (-8, -7, -1, 0, 1, 6, 7, 8)}
    for limit in sorted(x for x in ends if x > 0)[::7] + [1, 2]:
        got = {r.wiki: (r.corpus, r.truncated) for r in ev.corpus(df, ["wiki"], "pos", limit).collect()}
        want = {k: joined(p, limit) for k, p in wikis.items() if any(x[3] == "completed" and x[4] for x in p)}
        assert got == want, limit


@pytest.mark.parametrize("over", range(-8, 9))
def test_next_page_begins_at_the_limit(spark, over):
    pages = [(0, "a", None, "completed", "x" * 50), (1, "b", None, "completed", "y" * 20)]
    df = spark.createDataFrame([(1, *p) for p in pages], "wiki long, pos int, title string, section string, status string, content string")
    limit = len("# a\n\n" + "x" * 50) + over
    [r] = ev.corpus(df, ["wiki"], "pos", limit).collect()
    assert (r.corpus, r.truncated) == joined(pages, limit)
