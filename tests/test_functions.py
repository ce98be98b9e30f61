"""Examples of the text, path and value functions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillspark.functions import markdown as md
from quillspark.functions import paths, prompts, text, values


def one(spark, value, column):
    """The value of a column expression over one row with column x."""
    return spark.createDataFrame([(value,)], "x string").select(column.alias("r")).first().r


@pytest.mark.parametrize(
    ("address", "owner", "name"),
    [
        ("https://github.com/o/r", "o", "r"),
        ("https://github.com/o/r.git", "o", "r"),
        (" github.com/o/r/ ", "o", "r"),
        ("o/r", "o", "r"),
        ("o/r; rm -rf", None, None),
        ("nothing", None, None),
        ("", None, None),
        ("a/b/c", None, None),
    ],
)
def test_repo_address(spark, address, owner, name):
    r = one(spark, address, paths.repo_address(F.col("x")))
    assert (r and r.owner, r and r.name) == (owner, name)


@pytest.mark.parametrize(("sha", "ok"), [("a" * 40, True), ("A1" * 20, True), ("a" * 39, False), ("a" * 40 + "\n", False), ("g" * 40, False), ("", False)])
def test_sha(spark, sha, ok):
    assert one(spark, sha, paths.valid_sha(F.col("x"))) is ok


@pytest.mark.parametrize(("path", "ext", "lang"), [("a/b.TS", ".ts", "typescript"), ("a/.env", "", None), ("x.min.js", ".js", "javascript"), ("Makefile", "", None), ("a.b/c", "", None), ("a/b.py", ".py", "python")])
def test_extension(spark, path, ext, lang):
    assert one(spark, path, paths.extension(F.col("x"))) == ext
    assert one(spark, path, paths.language(F.col("x"))) == lang


def test_cited_paths(spark):
    content = "See `src/a.ts:10-20`, [b](./lib/b.py#L3), [s](https://x.org/c.ts), [h](#top), `not a path`, `.env`, `dist/x.js`, [g](https://github.com/o/r/blob/main/src/d.go#L1), `src/a.ts`"
    assert one(spark, content, paths.cited_paths(F.col("x"))) == ["lib/b.py", "src/a.ts", "src/d.go"]


def test_generated_and_minified(spark):
    assert one(spark, "// code GENERATED by x", text.is_generated(F.col("x")))
    assert not one(spark, " " * 1000 + "DO NOT EDIT", text.is_generated(F.col("x")))
    assert one(spark, "x" * 501, text.is_minified(F.col("x")))
    assert not one(spark, "x" * 500, text.is_minified(F.col("x")))
    assert not one(spark, "", text.is_minified(F.col("x")))


def test_embedded_json(spark):
    assert one(spark, 'Hi\n```json\n{"a": {"b": 1}}\n```', text.embedded_json(F.col("x"))) == '{"a": {"b": 1}}'
    assert one(spark, "  none ", text.embedded_json(F.col("x"))) == "none"


@pytest.mark.parametrize(
    ("content", "title", "want"),
    [("# My  Page\n\nText", "my page", "Text"), ("# Other\n\nText", "my page", "# Other\n\nText"), ("## My page\nText", "My page", "## My page\nText"), ("\n # T \n\n\nx", "t", "x"), ("", "t", "")],
)
def test_without_title(spark, content, title, want):
    assert one(spark, content, text.without_title(F.col("x"), F.lit(title))) == want


def test_diagram_functions(spark):
    code = 'graph TD\n%% note\n  A[ "My Node" ]\n'
    assert md.signature(code) == one(spark, code, text.diagram_signature(F.col("x"))) == "graph td a[my node]"
    assert md.valid_diagram("  Sequencediagram\nx") and one(spark, "  Sequencediagram\nx", text.is_diagram(F.col("x")))
    assert not md.valid_diagram("hello")
    assert one(spark, 'A->>>>B: x\nd{ "y" }\nn[a: b]', text.tidy_diagram(F.col("x"))) == 'A->>B: x\nd{"y"}\nn["a: b"]'


def test_fences():
    quoted = "````md\n```mermaid\npie\n```\n````\n"
    assert md.diagram_fences(quoted) == []
    content = "a\n```mermaid\ngraph TD\n```\nb"
    assert md.diagram_fences(content) == [(2, 25, "graph TD")]
    assert md.chunks(content) == [("text", "a\n"), ("mermaid", "graph TD"), ("text", "\nb")]
    assert md.diagram_fences("```mermaid\ngraph") == [] and md.diagram_fences("```mermaid\n\n```") == []
    assert md.diagram_fences("    ```mermaid\npie\n    ```") == []
    assert [x[2] for x in md.diagram_fences("~~~mermaid\npie\n```\n~~~~")] == ["pie\n```"]


def test_limit_diagrams():
    block = lambda s: f"```mermaid\n{s}\n```\n"
    content = block("pie a") + "x\n" + block("pie  A") + block("graph b") + block("gantt c")
    kept, codes = md.limit_diagrams(content)
    assert kept == block("pie a") + "x\n" + block("graph b") and codes == ["pie a", "graph b"]
    assert md.limit_diagrams(kept) == (kept, codes)
    assert md.limit_diagrams("no diagram") == ("no diagram", [])


def test_policy_headings():
    content = "## Code-First!\n\ntext\n### `name`\n```\n## Source of Truth\n```\n## Trust hierarchy\nx"
    assert md.without_policy_headings(content) == "text\n### name\n```\n## Source of Truth\n```\nx"


@pytest.mark.parametrize(("title", "want"), [("Épée & Co's", "epee-and-cos"), ("  A--b ", "a-b"), ("日本", "page"), ("", "page"), ("ﬁne", "fine")])
def test_slug(title, want):
    assert md.slug(title) == want


def test_cost(spark):
    cost = lambda m, p, c, k: spark.range(1).select(values.cost(F.lit(m), F.lit(p), F.lit(c), F.lit(k)).alias("r")).first().r
    assert cost("claude-sonnet-4-6", 1000, 1000, 0) == pytest.approx(0.018)
    assert cost("claude-opus-4-6", 1000, 1000, 0) == pytest.approx(0.03)
    assert cost("gpt-5.5", 1_000_000, 0, 1_000_000) == cost("gpt-5.5", 1_000_000, 0, 2_000_000) == pytest.approx(0.175)
    assert cost("unknown", 1000, 1000, 0) == 0


@pytest.mark.parametrize(("raw", "want"), [("", 1), ("many", 2), ("0", 1), ("3", 3), ("9", 5), (None, 2)])
def test_parallel_limit(spark, raw, want):
    assert one(spark, raw, values.parallel_limit(F.col("x"))) == want


@pytest.mark.parametrize(("t", "ms"), [("2026-01-01 00:00:00", 1767225600000), ("2026-01-01T00:00:00Z", 1767225600000), ("2026-01-01T02:00:00+02:00", 1767225600000), (" ", None), ("never", None)])
def test_app_time(spark, t, ms):
    assert one(spark, t, values.app_time(F.col("x"))) == ms


@pytest.mark.parametrize(("ago", "want"), [(-5, "just now"), (59, "just now"), (60, "1m ago"), (3599, "59m ago"), (7200, "2h ago"), (172800, "2d ago")])
def test_relative_time(spark, ago, want):
    assert spark.range(1).select(values.relative_time(F.lit(0).cast("long"), F.lit(ago * 1000).cast("long")).alias("r")).first().r == want


def test_durations(spark):
    row = spark.range(1).select(values.duration_floor(F.lit(90_000)).alias("a"), values.duration_rounded(F.lit(90_000)).alias("b"), values.duration_short(F.lit(950)).alias("c"), values.duration_short(F.lit(1500)).alias("d"), values.duration_floor(F.lit(None).cast("int")).alias("e")).first()
    assert tuple(row) == ("1m 30s", "2m 30s", "950ms", "1.5s", "")


def test_prompts(spark):
    no = F.array().cast("array<string>")
    p = prompts.page_prompt(F.lit("o/r"), F.lit("S"), F.lit("T"), F.lit("d"), no, F.array(F.lit("flow")), F.lit("o"), True)
    made = spark.range(1).select(p.alias("p"), prompts.update_prompt(*[F.lit("x")] * 3, F.repeat(F.lit("d"), 60_000), F.lit("t"), F.lit("c"), no, F.lit("o"), True).alias("u"), prompts.with_system(F.lit("q"), F.lit("s")).alias("s")).first()
    assert "(none: find" in made.p and "flow" in made.p and "last message" in made.p
    assert "d" * 50_000 in made.u and "d" * 50_001 not in made.u and prompts.NO_CHANGES in made.u
    assert made.s == "System instructions:\ns\n\nUser request:\nq"


FENCED = [
    "", "plain", "a\n```mermaid\ngraph TD\n```\nb", "```mermaid\nx\n```", "````md\n```mermaid\npie\n```\n````\nend", "~~~ Mermaid wide\nA\n~~~", "```mermaid\nopen", "```mermaid\n\n```\nz",
    "    ```mermaid\nx\n```\n", "```js\n~~~\n```\n```mermaid\nq\n````\ntail", "```mermaid\nx\n``` no\n```\n", "\u00e9\u00e9\n```mermaid\ny\n```\n\u00e9", "```mermaid\n1\n```\n```mermaid\n2\n```",
]


def test_fenced_blocks(spark):
    found = [[c for _, _, c in md.diagram_fences(x)] for x in FENCED]
    assert found == [[], [], ["graph TD"], ["x"], [], ["A"], [], [], [], ["q"], ["x\n``` no"], ["y"], ["1", "2"]]
    for x in FENCED:
        assert all(x[s:e].lstrip(" ")[:3] in ("```", "~~~") and x[s - 1 : s] in ("", "\n") and x[e : e + 1] in ("", "\n") for s, e, _ in md.diagram_fences(x))
        texts = [v for k, v in md.chunks(x) if k == "text"]
        assert "".join(texts) == "".join(x[a:b] for a, b in zip([0, *(e for _, e, _ in md.diagram_fences(x))], [*(s for s, _, _ in md.diagram_fences(x)), len(x)], strict=True)) and "" not in texts
    df = spark.createDataFrame([(i, x) for i, x in enumerate(FENCED)], "i int, x string").select("i", md.chunks_column(F.col("x")).alias("c"))
    assert {r.i: [tuple(y) for y in r.c] for r in df.collect()} == {i: md.chunks(x) for i, x in enumerate(FENCED)}


def test_toc(spark):
    from quillspark.operators.outline import toc

    text = "# Top\n## A <b>x</b>\n```\n## no\n```\n### A x ##\n~~~~\n```\n## no\n~~~~\n## Top\n#### A x\n##not\n    ## code\n## `a-x`\n```\n## open"
    got = [(r.pos, r.level, r.id, r.plain) for r in toc(spark.createDataFrame([(1, text), (2, None)], "k int, content string"), "k").orderBy("pos").collect()]
    assert got == [(1, 2, "a-x", "a b x b"), (5, 3, "a-x-1", "a x"), (10, 2, "top-1", "top"), (14, 2, "a-x-3", "a x")]


def test_values_of_the_service(spark):
    schema = {"type": "object", "properties": {"type": {"type": "string"}, "a": {"type": "array", "items": {"type": "object", "properties": {}}}}, "$defs": {"x": {"type": "object", "additionalProperties": True}}, "required": ["a"]}
    strict = values.strict_schema(schema)
    assert strict["additionalProperties"] is False and strict["properties"]["a"]["items"]["additionalProperties"] is False and strict["$defs"]["x"]["additionalProperties"] is True
    assert strict["properties"]["type"] == {"type": "string"} and "additionalProperties" not in strict["properties"] and "additionalProperties" not in schema
    one = spark.range(1).select(values.app_date(F.lit("2024-03-05 23:59:59")), values.app_date(F.lit("2024-03-05T23:00:00-05:00")), values.app_date(F.lit("x")), values.source_badge(F.lit("local"))["cls"], values.source_badge(F.lit(None).cast("string"))["label"], values.short_model(F.lit("a-opus-4-6")), values.input_tokens(F.lit(1), F.lit(None).cast("int"), F.lit(3))).first()
    assert tuple(one) == ("3/5/2024", "3/6/2024", "", "local", "GitHub", "opus-4.6", 4)
