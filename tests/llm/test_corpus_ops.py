"""Quality rules, decontamination, substring and near-duplicate removal, resampling and the pipeline, against SQL and brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from conftest import DATA, same_rows
from pyspark.sql import functions as F

from quillspark.llm import classifier, common, decontaminate, near_dedup, quality, queries, substring_dedup

RND = random.Random(11)
VOCAB = [f"w{i}" for i in range(400)]


def prose(n: int) -> str:
    return " ".join(RND.choice(VOCAB) for _ in range(n))


BASE = prose(120)
#: Texts with everything that may go wrong: nulls, blanks, ties, copies, near copies, shared passages, long texts.
TEXTS = [None, "", " \t\n ", "one", "one two", BASE, BASE, BASE.replace(" ", "\n", 3), BASE + " tail", "head " + BASE, prose(60) + " " + BASE[:300], prose(30_00), BASE[:300] + " " + prose(40), prose(60), "a b c d e f g h " * 30, "", "one", "# $ % " * 40, "é " * 50]
ROWS = [(None if i == 4 else i, t, "en" if i % 2 else None, None if i == 5 else "s", 0, "clash", i) for i, t in enumerate(TEXTS)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, h long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([*ROWS, ROWS[5], ROWS[10]], SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(name, spark, duck):
    same_rows(queries.QUERIES[name](spark, DATA), duck, queries.SQL[name])


def words(t):
    return [w.decode() for w in (t or "").encode().split()]


def measures(t):
    w, t = words(t), t or ""
    at = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {j for i in range(len(w) - 7) if at[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover)


def test_quality_counts(docs):
    rows = quality.quality_verdicts(docs).collect()
    want = sorted((-1 if d.doc_id is None else d.doc_id, *measures(d.text)) for d in docs.collect())
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == want
    for r in rows:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept)
    kept = quality.quality_filter(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in rows)
    assert quality.quality_verdicts(docs.limit(0)).count() == 0 == quality.quality_filter(docs.limit(0)).count()


def test_quality_join_by_shuffle(docs, monkeypatch):
    want = sorted(map(tuple, quality.quality_verdicts(docs).fillna(-1, ["doc_id"]).collect()))
    monkeypatch.setattr(quality, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, quality.quality_verdicts(docs).fillna(-1, ["doc_id"]).collect())) == want


def test_quality_adapts(spark):
    texts = [(i, prose(50) + (" # % & $" * 12 if i % 50 == 0 else ""), "en", "s") for i in range(400)]
    rows = quality.quality_verdicts(spark.createDataFrame(texts, "doc_id long, text string, lang string, source string")).collect()
    assert {r.doc_id for r in rows if not r.kept} == {i for i in range(400) if i % 50 == 0}


def test_sketch_bucket(spark):
    v = [0, 1, 63, 64, 65, 100, 1000, 123456]
    got = [r.b for r in spark.createDataFrame([(x,) for x in v], "v long").select(quality.bucket(F.col("v")).alias("b")).collect()]
    assert got == [x if x < 64 else x >> (x.bit_length() - 6) << (x.bit_length() - 6) for x in v]


def shingles(t, k=5):
    w = words(t)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def test_contained(spark, docs, monkeypatch):
    base = words(BASE)
    items = [(0, " ".join(base[10:40])), (1, " ".join(base[10:40][:26] + ["x"] * 4)), (2, " ".join(base[10:30] + ["x"] * 20)), (3, "one two"), (4, "one"), (5, ""), (6, None), (None, BASE), (7, "zz"), (0, " ".join(base[10:40]))]
    table = spark.createDataFrame([(i, t, "c") for i, t in items], "item_id long, text string, doc_id string")
    want, bad = set(), set()
    for d in docs.collect():
        for i, t in items:
            w = words(t)
            own = shingles(t)
            have = {tuple(words(d.text)[j : j + min(5, len(w))]) for j in range(len(words(d.text)))} if w else set()
            if own and i is not None and len(own & have) >= 0.8 * len(own):
                bad.add(d.text)
                if d.doc_id is not None:
                    want.add((d.doc_id, i, len(own), len(own & have)))
    assert {tuple(r) for r in decontaminate.contained(docs, table).collect()} == want and want
    clean = decontaminate.clean_documents(docs, table)
    assert clean.columns == docs.columns and sorted(str(d.text) for d in clean.collect()) == sorted(str(d.text) for d in docs.collect() if d.text not in bad)
    assert decontaminate.contained(docs, table.limit(0)).count() == decontaminate.contained(docs.limit(0), table).count() == 0
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(decontaminate, "SLICE_ROWS", 12)
    assert {tuple(r) for r in decontaminate.contained(docs, table).collect()} == want


def removed(df):
    """Brute force: (doc_id, words, removed words, hash of the kept ones) of every row. Places: by id, nulls last; rows
    without an id of their own by a hash."""
    rows = df.select("doc_id", "text", F.xxhash64("doc_id", "text").bitwiseOR(F.lit(-(1 << 63))).alias("h")).collect()
    n = Counter(r.doc_id for r in rows)
    last = (1 << 63) - 1
    key = lambda r: (last, r.h) if r.doc_id is None else (r.doc_id, r.h if n[r.doc_id] > 1 else 0)
    first = {}
    for r in rows:
        w = words(r.text)
        for i in range(len(w) - 19):
            k = tuple(w[i : i + 20])
            first[k] = min(first.get(k, (key(r), i)), (key(r), i))
    out = []
    for r in rows:
        w, g = words(r.text), set()
        for i in range(len(w) - 19):
            if first[tuple(w[i : i + 20])] < (key(r), i):
                g.update(range(i, i + 20))
        out.append((last if r.doc_id is None else r.doc_id, len(w), len(g), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in g).encode()).hexdigest()))
    return sorted(out)


def deduplicated(df, batches):
    return sorted(map(tuple, substring_dedup.dedup_words(df, batches).withColumn("kept", F.sha2("kept", 256)).fillna((1 << 63) - 1, ["doc_id"]).collect()))


@pytest.mark.parametrize("batches", [1, 3])
def test_substring_dedup(docs, batches):
    assert deduplicated(docs, batches) == removed(docs)
    assert substring_dedup.dedup_words(docs.limit(0), batches).count() == 0


@pytest.mark.parametrize("batches", [1, 6])
def test_substring_dedup_of_rows_without_ids(spark, monkeypatch, batches):
    """Half of the ids null, others shared; all repeated windows hot."""
    monkeypatch.setattr(substring_dedup, "HOT", 0 if batches == 1 else 1)
    passages = [prose(60) for _ in range(5)]
    texts = [RND.choice(passages) + " " + prose(RND.randrange(30)) for _ in range(40)] + passages + [prose(60), "word " * 25_000]
    rows = [(None if i % 2 else i % 9, t) for i, t in enumerate([*texts, *texts[:3]])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert deduplicated(df, batches) == removed(df)
    alone = spark.createDataFrame([(1, passages[0]), (None, passages[0]), (None, prose(60))], "doc_id long, text string")
    assert [(r.doc_id, r.n_removed) for r in substring_dedup.dedup_words(alone, batches).collect() if r.n_removed] == [(None, 60)]


def test_substring_dedup_of_random_repeats(spark, monkeypatch):
    """Few different words, so that windows overlap and repeat within documents; joins by shuffle."""
    monkeypatch.setattr(substring_dedup, "BROADCAST_ROWS", 0)
    passages = [" ".join(RND.choice("ab") for _ in range(30)) for _ in range(6)]
    texts = [" ".join(RND.choice(passages) if RND.random() < 0.6 else prose(7) for _ in range(8)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert deduplicated(df, 3) == removed(df)


def weights(t, k=5):
    w = words(t)
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else Counter({tuple(w): 1}) if w else Counter()


def classes(rows):
    """Brute force: the place of the first row of each row's class."""
    sets = [weights(r.text) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (not sets[i] and not sets[j]) or (sets[i] and sets[j] and sum((sets[i] & sets[j]).values()) >= 0.8 * sum((sets[i] | sets[j]).values())):
                parent[root(i)] = root(j)
    first = {}
    for i in range(len(rows)):
        first.setdefault(root(i), i)
    return [first[root(i)] for i in range(len(rows))]


def named(rows):
    """(doc_id, class_id) of all rows: the least doc_id of the class."""
    own, least = classes(rows), {}
    for r, c in zip(rows, own, strict=True):
        least[c] = min([x for x in (least.get(c), r.doc_id) if x is not None], default=None)
    return Counter((r.doc_id, least[c]) for r, c in zip(rows, own, strict=True))


def test_near_duplicates(docs):
    """Null ids, an id that two texts share, repeated rows."""
    rows = docs.collect()
    assert Counter(map(tuple, near_dedup.near_duplicates(docs).collect())) == named(rows)
    one = near_dedup.one_of_each(docs)
    kept = one.collect()
    own = classes(rows)
    assert one.columns == docs.columns and len(kept) == len(set(own))
    at = [own[next(i for i, x in enumerate(rows) if (x.doc_id, x.text) == (r.doc_id, r.text))] for r in kept]
    assert sorted(at) == sorted(set(own))
    least = [min((rows[i].doc_id for i in range(len(rows)) if own[i] == c and rows[i].doc_id is not None), default=None) for c in at]
    assert [r.doc_id for r in kept] == least
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0 == near_dedup.one_of_each(docs.limit(0)).count()


def test_near_duplicates_of_a_crowd(spark, monkeypatch):
    """A bucket of more nodes than have all pairs, chains of edits, hubs in parts, and hot buckets joined by broadcast."""
    monkeypatch.setattr(near_dedup, "PAIRS", 8)
    monkeypatch.setattr(near_dedup, "PART", 16)
    monkeypatch.setattr(near_dedup, "HOT", 50)
    base = words(BASE)
    texts = []
    for _ in range(120):
        w = list(base)
        w[RND.randrange(len(w))] = "edit" + str(RND.random())
        texts.append(" ".join(w))
    chain = [prose(200)]
    for i in range(12):
        w = words(chain[-1])
        w[i * 12 % len(w)] = f"c{i}"
        chain.append(" ".join(w))
    copies = [prose(50)] * 90
    repeats = [" ".join([prose(12)] * n) for n in (30, 33, 60)]
    df = spark.createDataFrame(list(enumerate([*texts, *chain, *[prose(80) for _ in range(40)], *copies, *repeats])), "doc_id long, text string")
    want = named(df.collect())
    assert Counter(map(tuple, near_dedup.near_duplicates(df).collect())) == want
    monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", 0)
    assert Counter(map(tuple, near_dedup.near_duplicates(df).collect())) == want


def test_links_into_a_crowd(spark):
    """400 texts that differ in one word, and 60 that are linked to one of them each."""
    rnd = random.Random(2)
    base = [f"w{rnd.randrange(5000)}" for _ in range(200)]
    texts = []
    for i in range(400):
        w = list(base)
        w[rnd.randrange(200)] = f"e{i}"
        texts.append(w)
    for i in range(60):
        w = list(texts[rnd.randrange(400)])
        for j in range(4):
            w[20 + 45 * j + rnd.randrange(8)] = f"x{i}_{j}"
        texts.append(w)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    assert Counter(map(tuple, near_dedup.near_duplicates(df).collect())) == named(df.collect())


def test_near_duplicates_that_no_leader_shows(spark, monkeypatch):
    """Crowded buckets of one leader each, with links between nodes that are far from all leaders."""
    monkeypatch.setattr(near_dedup, "PAIRS", 2)
    monkeypatch.setattr(near_dedup, "LEADERS", 1)
    rnd = random.Random(1)
    base = [rnd.choice(VOCAB) + "b" for _ in range(200)]
    texts = []
    for i in range(240):
        w = list(base)
        for j in rnd.sample(range(200), rnd.choice((1, 4, 5, 6, 7, 8))):
            w[j] = f"e{i}_{j}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert Counter(map(tuple, near_dedup.near_duplicates(df).collect())) == named(df.collect())


def test_a_crowd_joins_by_few_pairs(spark, monkeypatch):
    """Two crowds around texts, of all sizes that the similarity allows, left to the exact join alone: the pairs that it
    verifies grow with the nodes, not with their square."""
    monkeypatch.setattr(near_dedup, "PAIRS", 2)
    monkeypatch.setattr(near_dedup, "first_candidates", lambda shared: shared.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0))
    monkeypatch.setattr(near_dedup, "all_candidates", lambda shared, known, threshold: near_dedup.first_candidates(shared))
    asked, verified = [], near_dedup.verified
    monkeypatch.setattr(near_dedup, "verified", lambda pairs, *more: asked.append(pairs.count()) or verified(pairs, *more))
    rnd = random.Random(3)
    bases = [[f"b{j}w{rnd.randrange(5000)}" for _ in range(300)] for j in range(2)]
    texts = []
    for i in range(240):
        w = list(bases[i % 2])
        if i % 3:
            w += [f"o{i}_{j}" for j in range(rnd.randrange(90))]
        else:
            w[rnd.randrange(300)] = f"e{i}"
        texts.append(w)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    assert Counter(map(tuple, near_dedup.near_duplicates(df).collect())) == named(df.collect())
    assert sum(asked) < 10 * len(texts)


def test_shared_ids_and_null_ids_by_shuffle(spark, monkeypatch):
    """Half of the ids null, others shared by different texts; joins by shuffle."""
    monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "BROADCAST_IDS", 0)
    texts = [prose(40) for _ in range(8)]
    rows = [(None if i % 2 else i % 7, RND.choice(texts) + (f" t{i % 3}" if i % 5 == 0 else ""), f"x{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id int, text string, id string")
    assert Counter(map(tuple, near_dedup.near_duplicates(df).collect())) == named(df.collect())
    one = near_dedup.one_of_each(df)
    assert one.columns == df.columns and one.count() == len(set(classes(df.collect())))


def test_dart_signatures_estimate_similarity():
    n, k = 300, 2000
    rnd = np.random.default_rng(5)
    cells = rnd.integers(1, 1 << 62, 400).astype(np.uint64)
    row = np.concatenate((np.zeros(n, int), np.ones(n, int)))
    cell = np.concatenate((np.sort(cells[:n]), np.sort(cells[100:])))
    a, b = near_dedup.dart_signatures(row, cell, np.ones(2 * n, int), 3, k)[:2]
    assert abs((a == b).mean() - 200 / 400) < 0.05
    # any weights: the sum of the lesser ones by that of the greater
    x, y = rnd.integers(1, 40, n), rnd.integers(1, 40, n)
    same = np.concatenate((cells[:n], cells[:n]))
    a, b = near_dedup.dart_signatures(row, same, np.concatenate((x, y)), 2, k)
    assert abs((a == b).mean() - np.minimum(x, y).sum() / np.maximum(x, y).sum()) < 0.05
    tiny = near_dedup.dart_signatures(np.array([0]), cells[:1], np.array([1]), 1, 63)
    assert (tiny != 0).all()


def test_units_of_weight():
    data = np.frombuffer(b"a b c d e  " * 4, np.uint8)
    row, cell, weight = near_dedup.elements(np.array([0, 11 * 3, 11 * 4]), data, 5)
    assert weight.sum() == 11 + 1 and (weight[row == 1] == 1).all() and weight[row == 0].max() == 3
    r, c = near_dedup.unit_cells(row, cell, weight)
    assert len(r) == 12 == len(set(zip(r.tolist(), c.tolist(), strict=True))) and len(np.intersect1d(c[r == 0], c[r == 1])) == 1


def test_importance(spark):
    good, bad = [f"good{i}" for i in range(50)], [f"bad{i}" for i in range(50)]
    text = lambda i: " ".join(RND.choice(bad if i % 4 == 0 else good) for _ in range(40))
    rows = [(i, text(i), "x") for i in range(400)]
    docs = spark.createDataFrame([*rows, (None, None, "x"), (400, "", "x"), (5, rows[5][1], "x")], "doc_id long, text string, key string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 200)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    out = classifier.select(docs, labels).collect()
    held = [r for r in out if r.doc_id is not None and 200 <= r.doc_id < 400]
    assert sum(r.kept == (r.doc_id % 4 > 0) for r in held) >= 0.95 * len(held)
    assert len(out) == 403 and all(r.log_weight == 0 for r in out if r.doc_id in (None, 400))
    assert len({r.key for r in out if r.doc_id == 5}) == 1
    none = classifier.select(docs, labels.limit(0)).collect()
    assert all(r.log_weight == 0 and r.kept for r in none) and classifier.select(docs.limit(0), labels).count() == 0


def test_importance_by_brute_force(spark):
    """Weights from counts of every document's words and pairs of words, keys, and the documents of the largest keys."""
    rows = [(i, prose(RND.randrange(60)) + (" good stuff" if i % 3 else " bad luck")) for i in range(300)] + [(300, None), (301, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 3, i % 7 == 0, "x") for i in range(120)], "doc_id long, quality int, toxic boolean, text string").withColumn("toxic", F.col("toxic").cast("int"))
    good = {i for i in range(120) if i % 3 == 1 and i % 7}

    def own(text):
        w = text.encode().split() if text else []
        data = np.frombuffer(b" ".join(w), np.uint8)
        return Counter(classifier.grams(np.array([0, len(data)]), data, classifier.BUCKETS)[1].tolist())

    grams = {i: own(t) for i, t in rows}
    assert sum(grams[0].values()) == 2 * len(words(rows[0][1])) - 1
    raw, target = Counter(), Counter()
    for i, c in grams.items():
        raw.update(c)
        if i in good:
            target.update(c)
    n_raw, n_target = sum(raw.values()), sum(target.values())
    ratio = {b: np.log((target[b] + classifier.PRIOR) / (raw[b] * n_target / n_raw + classifier.PRIOR)) for b in raw}
    weight = {i: sum(ratio[b] * n for b, n in c.items()) for i, c in grams.items()}
    noise = dict(zip(grams, classifier.gumbel(np.array(list(grams)), classifier.SEED).tolist(), strict=True))
    out = {r.doc_id: r for r in classifier.select(docs, labels).collect()}
    for i in grams:
        assert abs(out[i].log_weight - weight[i]) < 1e-6 and abs(out[i].key - weight[i] - noise[i]) < 1e-6
    k = round(len(rows) * len(good) / 120)
    assert {i for i, r in out.items() if r.kept} == set(sorted(grams, key=lambda i: -out[i].key)[:k])
    u = np.exp(-np.exp(-classifier.gumbel(np.arange(20_000), 1)))
    assert abs(u.mean() - 0.5) < 0.01 and abs((u < 0.1).mean() - 0.1) < 0.01


@pytest.mark.parametrize("k", [1, 7, 500, 999])
def test_kth_largest(spark, k):
    values = [RND.gauss(0, 100) for _ in range(1000)]
    df = spark.createDataFrame([(v,) for v in values], "key double")
    bound = classifier.kth_largest(df, k, 4)
    assert sum(v >= bound for v in values) == k


def test_held_out_accuracy(spark):
    d, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    train = labels.join(labels.select("doc_id").distinct().withColumn("r", F.xxhash64("doc_id") % 2), "doc_id").where("r = 0").drop("r")
    rows = classifier.select(d, train).join(labels.join(train, "doc_id", "left_anti"), "doc_id").collect()
    weights = {q: [r.log_weight for r in rows if r.quality == q] for q in (0, 1)}
    assert np.mean([a > b for a in weights[1] for b in weights[0]]) > 0.8


def test_pipeline(spark, tmp_path):
    """Each stage against brute force on what the one before kept."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, {}
    for i, (name, stage) in enumerate(p.STAGES):
        path = str(tmp_path / str(i))
        stage(spark, docs, DATA).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        kept[name] = docs.collect()
        if name == "quality_rules":
            verdicts = {r.doc_id for r in quality.quality_verdicts(before).collect() if r.kept}
            assert {r.doc_id for r in kept[name]} == verdicts
        elif name == "near_duplicates":
            rows = sorted(before.collect())
            assert {r.doc_id for r in kept[name]} == {rows[c].doc_id for c in classes(rows)}
        elif name == "decontamination":
            items = [shingles(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
            assert {r.doc_id for r in kept[name]} == {r.doc_id for r in before.collect() if not any(len(s & shingles(r.text)) >= 0.8 * len(s) for s in items)}
        if i < len(p.STAGES) - 1:
            assert docs.columns == columns
        if name == "secret_scans":
            secrets = __import__("quillspark.llm.secrets", fromlist=["x"])
            cut, null = {}, secrets.null_of(secrets.counts_of(r.text for r in before.collect()))
            for r in before.collect():
                spans, out, at = secrets.spans(r.text, null), "", 0
                gone = sorted({c for s, _, e in spans for c in range(s, e)})
                for c in gone:
                    out += r.text[at:c] + ("" if c - 1 in gone and not any(c == s and not any(x < c < y for x, _, y in spans) for s, _, _ in spans) else "[SECRET]")
                    at = c + 1
                cut[r.doc_id] = out + r.text[at:]
            assert {r.doc_id: (r.text, r.n_chars) for r in kept[name]} == {i: (x, len(x)) for i, x in cut.items()}
    texts = {r.doc_id: r.text for r in kept["secret_scans"]}
    c = __import__("quillspark.llm.byte_bpe", fromlist=["x"])
    P = __import__("public_tokenizers")
    codec = c.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert {r.doc_id: codec.decode(bytes(r.ids)).decode() for r in kept["tokenization"]} == texts
    assert sorted(r.doc_id for r in p.run(spark, DATA).select("doc_id").collect()) == sorted(texts)


ODD_ROWS = [
    (None, None, None, None, None),
    (None, prose(50), "en", "s", 1),
    (None, prose(60) + " token=abcdefgh1", "en", None, 2),
    (7, prose(55), "en", "s", 3),
    (7, prose(45), None, "s", 3),
    (8, "", "en", "s", 0),
    (9, "x", "en", "s", 1),
    (10, prose(30_000), "en", "s", 9),
]


def test_stages_handle_odd_rows(spark, tmp_path):
    """Nulls, shared ids, repeated rows, clashing columns, an empty table."""
    import corpus_pipeline as p

    rows = [(*r, "a", "b", i) for i, r in enumerate(ODD_ROWS)]
    rows += [(*rows[3][:5], "other", "b", 99), (None, *rows[1][1:]), (11, BASE, "en", "s", 1, "a", "b", 50)]
    spark.createDataFrame([(1, BASE)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _key string, id string, n long")
    good = {r[1] for r in rows if r[1] and len(words(r[1])) >= 20}
    at = [(p.quality_rules, good, 8), (p.near_duplicates, {*(r[1] or "" for r in rows)}, 8), (p.decontamination, {r[1] for r in rows} - {BASE}, 10), (p.secret_scans, None, 11)]
    for stage, texts, n in at:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        got = out.collect()
        assert len(got) == n, (stage.__name__, len(got))
        assert texts is None or {r.text or ("" if "" in texts else None) for r in got} - {None} == texts - {None}
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert p.tokenization(spark, docs, str(tmp_path)).count() == len(rows) and p.tokenization(spark, docs.limit(0), str(tmp_path)).count() == 0
