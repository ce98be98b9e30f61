"""Line deduplication, manifests and fill-in-the-middle against brute force, with nulls, ties, copies and broken ids."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import fill_middle as fim
from quillspark.llm import line_dedup as ld
from quillspark.llm import manifest as mf

RND = random.Random(5)
BLANKS = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, own string, n long, form string, pos long"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def rows(texts, ids=None):
    return [(i if ids is None else ids[i], t, None if i % 7 == 0 else "en", None if i % 5 == 0 else f"s{i % 3}", i * 3 if i % 4 else None, "clash", "own", 7, "f", -1) for i, t in enumerate(texts)]


# ---- lines ----

LONG = [f"the {i} line that many documents hold, é in it and longer than forty" for i in range(12)]


def line_texts(n: int) -> list[str | None]:
    out: list[str | None] = [None, "", "\n", "\n\n \r\n", "x" * 39, "x" * 40, "é" * 40 + "\n" + "é" * 39, "\x1c" * 40, ("y" * 45 + "\n") * 6]
    for i in range(n):
        lines = [RND.choice(["", "short", RND.choice(LONG), "  " + RND.choice(LONG).upper() + "\t\r", "own " * 12 + str(i), "É" * 45, " " + LONG[0]]) for _ in range(RND.randint(0, 12))]
        out.append("\n".join(lines))
    return out


def key_of(line: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def deduplicated(docs, least=40, most=5):
    """(n_lines, n_dropped, text) of each (doc_id, text)."""
    count, last = defaultdict(int), {}
    for i, t in docs:
        for k in {key_of(x) for x in (t or "").split("\n")}:
            if len(k) >= least:
                count[k] += 1
                last[k] = max(last.get(k, -1), -1 if i is None else i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        stay = [x for x in lines if count[key_of(x)] < most or last[key_of(x)] == (-1 if i is None else i)]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


@pytest.mark.parametrize("keys", [2_000_000, 0])
@pytest.mark.parametrize("bits", [None, 1 << 16])
def test_lines_equal_brute_force(spark, keys, bits):
    texts = line_texts(150)
    ids = [None if i % 11 == 3 else i // 2 if i % 13 == 5 else i for i in range(len(texts))]
    docs = spark.createDataFrame(rows(texts, ids) + rows(texts, ids)[20:23], SCHEMA).repartition(5)
    got = ld.drop_lines(docs, broadcast_keys=keys, bits=bits)
    own = [c for c in docs.columns if c != "text"]
    assert set(own) <= set(got.columns)
    found = got.collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in found), key=str) == deduplicated([(r.doc_id, r.text) for r in docs.collect()])
    assert {(r.digest, r.own, r.n, r.form, r.pos) for r in found} == {("clash", "own", 7, "f", -1)} and sum(r.n_dropped for r in found) > 50


def test_no_document_no_line(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ld.drop_lines(empty).collect() == [] and fim.fill_middle(empty).collect() == [] and mf.manifest(mf.document_leaves(empty)).collect() == []


def test_filters_miss_no_repeated_key():
    """Whatever the tasks, a hash of two documents has its bits in the merged filter; few others do."""
    draw = np.random.default_rng(1)
    once, twice = draw.integers(0, 1 << 63, 20_000, dtype=np.uint64), draw.integers(0, 1 << 63, 500, dtype=np.uint64)
    bits, first, again = 1 << 18, None, None
    for part in range(4):
        b = ld.Bloom(bits)
        mine = np.concatenate((once[part::4], twice if part in (1, 3) else twice[:0]))
        for own, chunk in enumerate(np.array_split(mine, 7)):
            b.add(chunk, np.full(len(chunk), own))
        blocks = {i: (ld.unpacked(x), ld.unpacked(y)) for i, x, y in b.blocks()}
        o = np.concatenate([blocks.get(i, (np.zeros(8192, np.uint8),) * 2)[0] for i in range(bits // ld.BLOCK)])
        a = np.concatenate([blocks.get(i, (np.zeros(8192, np.uint8),) * 2)[1] for i in range(bits // ld.BLOCK)])
        assert (o == b.once).all() and (a == b.again).all()
        first, again = (o, a) if first is None else (first | o, again | a | (first & o))
    assert ld.Bloom.has(again, twice, bits).all() and ld.Bloom.has(again, once, bits).mean() < 0.02
    same = ld.Bloom(bits)
    same.add(np.array([5, 5, 5], np.uint64), np.array([1, 1, 1]))  # one document only
    assert not same.again.any()


def test_long_lines_and_texts(spark):
    big = "word " * 300_000
    texts = [big, "a\n" + big.upper(), big + "\n" + "z" * 50, big, big, "z" * 50] + [f"{i}\n" * 20_000 + "z" * 50 for i in range(4)]
    docs = spark.createDataFrame(rows(texts), SCHEMA)
    got = sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in ld.drop_lines(docs).collect())
    assert got == sorted(deduplicated(list(enumerate(texts))))


# ---- manifest ----


def runs_of_three(nodes: list[str]) -> list[list[str]]:
    levels = [nodes]
    while len(levels[-1]) > 1:
        x = levels[-1]
        levels.append([sha("".join(x[i : i + 3])) for i in range(0, len(x), 3)])
    return levels


def siblings(levels: list[list[str]], at: int) -> list[tuple[str, str]]:
    out = []
    for x in levels[:-1]:
        lead = at // 3 * 3
        out.append(("".join(x[lead:at]), "".join(x[at + 1 : lead + 3])))
        at //= 3
    return out


@pytest.mark.parametrize("height", [1, 2, 6])
def test_manifest_equals_brute_force(spark, height):
    texts = [None if i % 17 == 3 else f"line {i}\nother é {i % 5}\n" if i % 3 else "one" for i in range(230)]
    ids = [None if i == 40 else 50 if i in (51, 52) else i for i in range(len(texts))]
    data = rows(texts, ids)
    data += [data[100], (7, None, None, "lone", None, *data[0][5:]), (8, "", None, "", 0, *data[0][5:])]
    docs = spark.createDataFrame(data, SCHEMA).repartition(7)
    got = mf.manifest(mf.document_leaves(docs), height)
    got = got.withColumn("back", mf.folded(F.col("leaf"), F.col("proof"))).withColumn("digest", mf.proof_digest(F.col("proof"))).collect()

    by_source = defaultdict(list)
    for r in data:
        by_source[r[3]].append((-1 if r[0] is None else r[0], mf.leaf_of((r[0], r[3], r[2], r[4], r[1]))))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: runs_of_three([x[1] for x in sorted(by_source[s])]) for s in order}
    top = runs_of_three([trees[s][-1][0] for s in order])
    want = []
    for k, s in enumerate(order):
        for i, (doc, leaf) in enumerate(sorted(by_source[s])):
            proof = siblings(trees[s], i) + siblings(top, k)
            want.append((doc, s, leaf, trees[s][-1][0], top[-1][0], proof, sha("".join(a + b for a, b in proof))))
    assert sorted(map(str, want)) == sorted(str((-1 if r.doc_id is None else r.doc_id, r.source, r.leaf, r.subroot, r.root, [(p.left, p.right) for p in r.proof], r.digest)) for r in got)
    assert all(r.back == r.root for r in got)


def test_one_row_is_its_own_root(spark):
    docs = spark.createDataFrame([(3, "a", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    [r] = mf.manifest(mf.document_leaves(docs)).collect()
    assert r.leaf == r.subroot == r.root == sha("1:31:s2:en1:11:a") and r.proof == []


def test_tampered_rows_do_not_verify(spark):
    docs = spark.read.parquet(f"{__import__('conftest').DATA}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in mf.op12_manifest(spark, __import__("conftest").DATA).collect()}
    assert len(got) == len(docs) and len({r.root for r in got.values()}) == 1
    changed = {d.doc_id for d in docs if d.text and "\n" in d.text and zlib.crc32(str(d.doc_id).encode()) % 2 == 0}
    assert changed and changed == {i for i, r in got.items() if not r.verified}
    assert all((r.folded_root == r.root) == r.verified for r in got.values())


# ---- fill in the middle ----


def cut_of(doc_id, text, seed=1, rate=90, first=20):
    t = text or ""
    h = sha(f"{seed}:" + ("" if doc_id is None else str(doc_id)))
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(t)
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, t
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, m, z = t[:i], t[i:j], t[j:]
    return (n, "spm", i, j - i, f"<S>{z}<P>{a}<M>{m}") if h4 % 100 < first else (n, "psm", i, j - i, f"<P>{a}<S>{z}<M>{m}")


@pytest.mark.parametrize("size", [1 << 26, 0])
def test_cuts_equal_brute_force(spark, size):
    texts = [None, "", "a", "\U0001f44d" * 70, "é€x" * 50, "with <S> mark", "<", "a<S", "P>x<"]
    texts += ["".join(RND.choice("ab é€\U0001f600<>PSM\n\x00") for _ in range(RND.randint(1, 400))) for _ in range(120)] + ["same é text \U0001f600 " * 30] * 60 + ["z" * 300_000 + "é"] * 3
    ids = [None if i % 19 == 4 else 60 if i in (61, 62) else i for i in range(len(texts))]
    docs = spark.createDataFrame(rows(texts, ids) + rows(texts, ids)[130:134], SCHEMA).repartition(6)
    out = fim.fill_middle(docs, broadcast_bytes=size)
    assert [c for c in docs.columns if c != "text"] == out.columns[: len(docs.columns) - 1]
    new = out.columns[len(docs.columns) - 1 :]
    got = out.withColumn("back", fim.restored(F.col(new[4]), F.col(new[1]))).collect()
    made = sorted(str((r.doc_id, *(r[c] for c in new), r.back)) for r in got)
    assert made == sorted(str((r.doc_id, *(x := cut_of(r.doc_id, r.text))[:5], r.text or "")) for r in docs.collect())
    assert {r[new[1]] for r in got} == {"plain", "psm", "spm"}


def test_index_holds_each_shared_text_once(spark):
    texts = ["twice"] * 2 + ["once", None, None, ""] + ["many é"] * 40
    docs = spark.createDataFrame(rows(texts), SCHEMA).repartition(4)
    lists = [fim.EliasFano.from_bytes(bytes(r.ends)) for r in fim.shared_boundaries(docs).collect()]
    assert sorted((x.n, x.u) for x in lists) == [(5, 5), (6, 7)]


def test_lists_select_every_boundary():
    for _ in range(200):
        text = "".join(RND.choice("aé€\U0001f600") for _ in range(RND.randint(1, 90)))
        ends = fim.boundaries(text.encode())
        want = [len(text[: i + 1].encode()) for i in range(len(text))]
        again = fim.EliasFano.from_bytes(fim.EliasFano.of(ends).to_bytes())
        assert ends.tolist() == want == [again.select(i) for i in range(len(text))]
    ascii_ = fim.EliasFano.of(fim.boundaries(b"x" * 80_000)).to_bytes()
    assert len(ascii_) < 80_000 / 8 * 2.1
