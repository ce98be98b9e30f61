"""A Merkle manifest of a dataset: a tree of digests for each source, and one over the sources.

A leaf is the digest of a row's fields. The leaves of a source, in the order of doc_id, are joined three at a time until one
node is left, the source's subroot; subroots, in the order of the sources, likewise give the root. A row's proof has for each
level the digests of the others of its run of three, left and right of its own, so that the root can be computed from the
row alone.

Positions come from one range partitioning by source and doc_id: rows are numbered where they lie, and the numbers of rows
before them, counted for each source and partition, are added. A source is cut into aligned blocks of 3**HEIGHT leaves, so
no task holds a source. A postorder recursion over a block returns the digest of its subtree, and appends the siblings to
the leaves that it contains while it unwinds. The blocks' roots are the leaves of another traversal of the same kind, up to
the subroots and over the sources; then each block is traversed with the proof of its own root at hand, which completes the
proofs of its leaves. Rows of the scan are digests and ids only: texts stay where they are.

Nulls are fields of their own. Null doc_ids come first; rows of equal doc_id are ordered by their leaves, and rows that are
equal altogether are leaves of their own with equal digests. The root of an empty table is null, as it has no rows. Other
columns don't count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import prepare, small_enough, stored, table

#: Nodes that are joined into one; levels of a block; fields of a leaf.
ARITY, HEIGHT = 3, 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Counts of rows that are broadcast at most.
BROADCAST_ROWS = 500_000

_PROOF = "array<struct<left:string,right:string>>"
_SIDES = pa.struct([("left", pa.string()), ("right", pa.string())])


def joined(*digests: str) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def leaf(fields: Sequence[Column]) -> Column:
    """Digest of a row: each field as its length in bytes and its value, or a dash."""
    texts = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in texts]), 256)


def leaf_of(row: Sequence[object]) -> str:
    """leaf() of Python values."""
    return joined(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def positions(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """The rows with pos, from 0 in the order within their group, and n, the size of the group."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = rows.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order).withColumn("_at", F.monotonically_increasing_id())
    laid = stored(at, "manifest-order").withColumn("_part", F.shiftrightunsigned("_at", 33))
    own = laid.groupBy(group, "_part").agg(F.min("_at").alias("_from"), F.count("*").alias("_n"))
    whole = Window.partitionBy(group)  # a row for each partition that has some of the group, so no more than those
    known = own.select(group, "_part", "_from", (F.sum("_n").over(whole.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(whole).alias("n"))
    known = stored(known, "manifest-counts")
    both = laid.join(F.broadcast(known) if small_enough(known, BROADCAST_ROWS) else known, [group, "_part"])
    return both.select(*rows.columns, (F.col("_at") - F.col("_from") + F.col("_before")).alias("pos"), "n")


def block(height: int = HEIGHT) -> Column:
    return F.floor(F.col("pos") / ARITY**height).cast("long")


def height_of(n: int, most: int) -> int:
    """Levels over n leaves until one is left, `most` at most."""
    h = 0
    while n > 1 and h < most:
        n, h = -(-n // ARITY), h + 1
    return h


def traverse(digests: Sequence[str], height: int, proofs: list[list[tuple[str, str]]] | None = None, start: int = 0) -> str:
    """The digest of the subtree of `height` levels that begins at a leaf; its leaves get the siblings left and right of the
    nodes above them, level by level."""
    if height == 0:
        return digests[start]
    width = ARITY ** (height - 1)
    starts = range(start, min(len(digests), start + ARITY * width), width)
    found = [traverse(digests, height - 1, proofs, s) for s in starts]
    if proofs is not None:
        for i, s in enumerate(starts):
            sides = "".join(found[:i]), "".join(found[i + 1 :])
            for k in range(s, min(len(digests), s + width)):
                proofs[k].append(sides)
    return joined(*found)


def _ordered(t: pa.Table) -> pa.Table:
    return t.sort_by("pos").combine_chunks()


def block_roots(nodes: DataFrame, height: int = HEIGHT) -> DataFrame:
    """grp, pos, n, digest: the roots of the blocks of nodes (grp, pos, n, digest), and how many the group has."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = _ordered(t)
        n = t.column("n")[0].as_py()
        root = traverse(t.column("digest").to_pylist(), height_of(n, height))
        return pa.table({"grp": [key[0].as_py()], "pos": [key[1].as_py()], "n": [-(-n // ARITY**height)], "digest": [root]}, schema=_NODE)

    return nodes.select("grp", "pos", "n", "digest").groupBy("grp", block(height).alias("block")).applyInArrow(run, "grp string, pos long, n long, digest string")


_NODE = pa.schema([("grp", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("digest", pa.string())])


def with_proofs(nodes: DataFrame, above: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The nodes with subroot, root and proof, from those of their blocks' roots (grp, pos, subroot, root, proof)."""
    kind = nodes.schema
    kinds = [pa.schema([(f.name, _arrow(f.dataType.simpleString()))]).field(0) for f in kind]

    def run(key: tuple[pa.Scalar, ...], t: pa.Table, up: pa.Table) -> pa.Table:
        t = _ordered(t)
        proofs: list[list[tuple[str, str]]] = [[] for _ in range(t.num_rows)]
        digests = t.column("digest").to_pylist()
        traverse(digests, height_of(t.column("n")[0].as_py(), height), proofs)
        top = [(x["left"], x["right"]) for x in up.column("proof")[0].as_py()]
        flat = [sides for p in proofs for sides in (*p, *top)]
        sides = pa.StructArray.from_arrays([pa.array([x[i] for x in flat], pa.string()) for i in (0, 1)], ["left", "right"])
        offsets = [0]
        for p in proofs:
            offsets.append(offsets[-1] + len(p) + len(top))
        same = lambda c: pa.array([up.column(c)[0].as_py()] * t.num_rows, pa.string())
        cols = [t.column(f.name).cast(f.type) for f in kinds] + [same("subroot"), same("root"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), sides)]
        return pa.table(cols, schema=pa.schema([*kinds, ("subroot", pa.string()), ("root", pa.string()), ("proof", pa.list_(_SIDES))]))

    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kind), "subroot string", "root string", f"proof {_PROOF}"])
    own = nodes.groupBy("grp", block(height).alias("block"))
    return own.cogroup(above.groupBy("grp", F.col("pos").alias("block"))).applyInArrow(run, out)


def _arrow(kind: str) -> pa.DataType:
    return {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[kind]


def _levels(nodes: DataFrame, height: int) -> list[DataFrame]:
    """The nodes, their blocks' roots, those of the roots, up to one for each group."""
    out = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while True:
        out.append(stored(block_roots(out[-1], height), "manifest-roots"))
        most = -(-most // ARITY**height)
        if most <= 1:
            return out


def manifest(leaves: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Leaves (doc_id, source, leaf and other columns of text or whole numbers) with subroot, root and proof, the levels of
    siblings from the leaf's to the root's."""
    prepare(leaves.sparkSession)
    grp = F.coalesce(F.concat(F.lit("1"), F.col("source")), F.lit("0"))  # null first
    rows = leaves.withColumn("grp", grp).withColumnRenamed("leaf", "digest")
    own = _levels(positions(rows, "grp", ["doc_id", "digest"]), height)
    sources = own[-1].select(F.lit("").alias("grp"), F.col("grp").alias("_source"), "digest")
    tree = _levels(positions(sources, "grp", ["_source"]), height)
    above = tree[-1].select("grp", "pos", F.lit("").alias("subroot"), F.col("digest").alias("root"), F.expr(f"cast(array() as {_PROOF})").alias("proof"))
    for level in reversed(tree[1:-1]):
        above = with_proofs(level, above, height)
    above = with_proofs(tree[0], above, height).select(F.col("_source").alias("grp"), F.lit(0).cast("long").alias("pos"), F.col("digest").alias("subroot"), "root", "proof")
    for level in reversed(own[1:-1]):
        above = with_proofs(level, above, height)
    return with_proofs(own[0], above, height).withColumnRenamed("digest", "leaf").select(*leaves.columns, "subroot", "root", "proof")


def folded(leaf_: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(proof, leaf_, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """Digest of all siblings in their order."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def document_leaves(docs: DataFrame, changed: Callable[[Column], Column] | None = None) -> DataFrame:
    """doc_id, source, leaf and now: the leaf of a row, and that of the row whose text was changed."""
    own = leaf([F.col(c) for c in FIELDS])
    now = own if changed is None else leaf([changed(F.col(c)) if c == "text" else F.col(c) for c in FIELDS])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), own.alias("leaf"), now.alias("now"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    tampered = lambda text: F.when(hit, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)
    out = manifest(document_leaves(table(spark, sf_dir, "documents"), tampered))
    again = out.withColumn("folded_root", folded(F.col("now"), F.col("proof")))
    return again.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql() -> str:
    """The tree level by level. The parity of the check sum of a short text is computed bit by bit."""
    enc = " || ".join(f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in FIELDS)
    now = enc.replace("text::VARCHAR", "(CASE WHEN odd_crc THEN text ELSE replace(text, chr(10), '') END)::VARCHAR")
    crc = "list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)"

    def tree(name: str, base: str) -> str:
        return f"""{name} AS (SELECT grp, 0 AS lvl, pos, n, h FROM {base} UNION ALL SELECT grp, lvl + 1, pos // {ARITY}, (n + {ARITY - 1}) // {ARITY}, sha256(string_agg(h, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY grp, lvl, pos // {ARITY}, n),
{name}_side AS (SELECT a.grp, a.lvl, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS lft, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS rgt
    FROM {name} a JOIN {name} b ON a.grp = b.grp AND a.lvl = b.lvl AND a.pos // {ARITY} = b.pos // {ARITY} WHERE a.n > 1 GROUP BY ALL)"""

    def fold(name: str, base: str, sides: str) -> str:
        return f"""{name} AS (SELECT doc, grp, 0 AS lvl, pos, h, p FROM {base} UNION ALL SELECT f.doc, f.grp, f.lvl + 1, f.pos // {ARITY}, sha256(s.lft || f.h || s.rgt), f.p || s.lft || s.rgt FROM {name} f JOIN {sides} s ON f.grp = s.grp AND f.lvl = s.lvl AND f.pos = s.pos)"""

    return f"""WITH RECURSIVE d AS (SELECT *, ({crc}) % 2 = 0 AS odd_crc FROM documents),
leaf AS (SELECT doc_id AS doc, coalesce('1' || source, '0') AS grp, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n, sha256({enc}) AS h, sha256({now}) AS fake FROM d),
{tree("up", "leaf")},
subs AS (SELECT '' AS grp, grp AS src, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n, h FROM up WHERE n = 1),
{tree("top", "subs")},
f1_base AS (SELECT doc, grp, pos, fake AS h, '' AS p FROM leaf),
{fold("f1", "f1_base", "up_side")},
f1_end AS (SELECT doc, grp, max_by(h, lvl) AS h, max_by(p, lvl) AS p FROM f1 GROUP BY doc, grp),
f2_base AS (SELECT f.doc, s.grp, s.pos, f.h, f.p FROM f1_end f JOIN subs s ON f.grp = s.src),
{fold("f2", "f2_base", "top_side")},
f2_end AS (SELECT doc, max_by(h, lvl) AS h, max_by(p, lvl) AS p FROM f2 GROUP BY doc)
SELECT doc AS doc_id, leaf.h AS leaf, subs.h AS subroot, top.h AS root, sha256(f2_end.p) AS proof_sha256, f2_end.h AS folded_root, f2_end.h = top.h AS verified
FROM leaf JOIN subs ON leaf.grp = subs.src JOIN top ON top.n = 1 JOIN f2_end USING (doc)"""


SQL = _sql()
