"""Merkle manifest of a dataset, with its nodes in external memory and a proof for every row.

Each row is a leaf: SHA-256 over its fields, each as byte count, colon and value.  Leaves of a group ascend by key; two
consecutive nodes become their parent (a last single one becomes a parent alone) until one is left, the
group's *subroot*.  Subroots in order of their groups become the *root* in the same way.

A node's *coordinate* is its group, its level and its place in the level.  The node store is Parquet,
partitioned by level:

1. Leaves are sorted into runs (ranges of group and key), numbered in each run as they stream by, and given
   their place by prefix sums over the runs' counts.  Only keys and hashes are moved, never texts.
2. Runs of ``2 ** stride`` consecutive places of a group lie together; a task streams its runs and writes the
   nodes of ``stride`` levels.  The highest of these levels is read for the next ones.  A run's own nodes
   are all that a task holds.
3. Proofs go down the same way.  A node's siblings in its run come from the run; the siblings above are the
   run's own path, which was extracted a step earlier.  Path and nodes are merged in order of their
   coordinates, so a path is read once for all nodes of its run.

Each step is a shuffle of keys and hashes by (group, run), and there is one for each ``stride`` levels; a group
of a third of all rows is many runs.

Nulls: a null field counts as ``-``; a null key sorts first; rows of a null group are a group, which comes
first.  Repeated keys are in order of their leaves' hashes; equal rows have leaves of their own.  An empty table has
no root and no rows.  Only the columns named are read, so others can't clash; a missing one raises.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corymb.llm.shared import fits, materialise, need, shared_dir, small_batches

#: Levels that one run covers unless stated: 1024 nodes of 32 bytes.
STRIDE = 10
#: Runs and groups up to which their offsets are broadcast, some 40 bytes each.
BROADCAST_OFFSETS = 250_000


def field(c: Column) -> Column:
    """A field's part of a leaf: ``-`` if null, else the UTF-8 byte count, a colon and the value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*fields: Column) -> Column:
    """SHA-256 of a row's fields, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*map(field, fields)).cast("binary"), 256))


def parent(nodes: list[bytes]) -> bytes:
    """The hash of consecutive nodes, which are hashed as their lower-case hexadecimal digits."""
    return hashlib.sha256("".join(n.hex() for n in nodes).encode()).digest()


def tower(nodes: list[bytes], levels: int) -> list[list[bytes]]:
    """A run's nodes at each of so many levels, itself first."""
    out = [nodes]
    for _ in range(levels):
        now = out[-1]
        out.append([parent(now[i : i + 2]) for i in range(0, len(now), 2)])
    return out


def fold(node: bytes, path: list[tuple[bool, bytes]]) -> bytes:
    """The root that a node and its siblings give; a sibling is (stands left, hash), or has no hash if there is none."""
    for left, sibling in path:
        node = parent([node] if not sibling else [sibling, node] if left else [node, sibling])
    return node


def packed(path: list[tuple[bool, bytes]]) -> bytes:
    """A path as bytes: for each level how many nodes stand left and right, and the sibling."""
    return b"".join((b"L" if left else b"R") + s if s else b"-" for left, s in path)


def unpacked(raw: bytes) -> list[tuple[bool, bytes]]:
    path, i = [], 0
    while i < len(raw):
        if raw[i : i + 1] == b"-":
            path.append((False, b""))
            i += 1
        else:
            path.append((raw[i : i + 1] == b"L", raw[i + 1 : i + 33]))
            i += 33
    return path


def levels_of(count: Column) -> Column:
    """Levels above ``count`` consecutive leaves until one node is left."""
    return F.when(count > 1, F.length(F.bin(count - 1))).otherwise(0).cast("int")


def placed(leaves: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """``leaves`` (group, hash, ...) with ``pos``, the gapless place in the group in the given order, and ``count``, the group's size.

    Sorted into runs by range; only the runs' counts, a row for each run and group, are summed up.
    """
    spark = leaves.sparkSession
    keys = ("group", *order)
    ranged = leaves.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    at = leaves.columns.index("group")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, now, next_ = TaskContext.get().partitionId(), None, 0
        for b in batches:
            places = []
            for g in b.column(at).to_pylist():
                if now is None or g != now[0]:
                    now, next_ = (g,), 0
                places.append(next_)
                next_ += 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([run] * len(b), pa.int32()), pa.array(places, pa.int64())], names=[*b.schema.names, "run", "seq"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in leaves.schema)
    runs = materialise(ranged.mapInArrow(number, f"{kinds}, run int, seq long"), "runs")
    counts = runs.groupBy("group", "run").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("group")
    before = whole.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialise(counts.select(F.col("group").alias("of"), F.col("run").alias("at"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.sum("n").over(whole).alias("count")), "offsets")
    near = F.broadcast(offsets) if fits(offsets, BROADCAST_OFFSETS) else offsets
    out = runs.join(near, (F.col("run") == F.col("at")) & F.col("group").eqNullSafe(F.col("of")))
    return out.select(*leaves.columns, (F.col("seq") + F.col("offset")).alias("pos"), "count")


def _runs(df: DataFrame, stride: int, *also: str) -> DataFrame:
    """``df`` (group, count, pos, ...) dealt by run and sorted by coordinate."""
    run = F.shiftright("pos", stride).alias("block")
    return df.select("*", run).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "group", "block").sortWithinPartitions("group", "block", *also, "pos")


def _streamed(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[list[dict]]:
    """The rows of each run, from rows in order of (group, block)."""
    now, rows = None, []
    for b in batches:
        for r in b.select(columns).to_pylist():
            if now != (r["group"], r["block"]):
                if rows:
                    yield rows
                now, rows = (r["group"], r["block"]), []
            rows.append(r)
    if rows:
        yield rows


class Store:
    """The nodes of a forest, a tree for each group: Parquet below ``folder``, partitioned by level."""

    def __init__(self, leaves: DataFrame, folder: str, stride: int = STRIDE):
        """``leaves``: (group, pos, count, hash) with gapless places.  Writes all nodes, ``stride`` levels a step."""
        self.spark, self.stride = leaves.sparkSession, stride
        self.kind = leaves.schema["group"].dataType.simpleString()
        at, base, self.steps = leaves.select("group", "pos", "count", "hash"), 0, []
        while True:
            path = f"{folder}/step={base}"
            self._write(at, base, path)
            self.steps.append((base, path))
            top = self.level(base + stride)
            if not top.limit(1).count():
                break
            at, base = top, base + stride

    def level(self, level: int) -> DataFrame:
        """(group, pos, count, hash) of the nodes of one level; ``count`` is the group's number of leaves."""
        base, path = max((s for s in self.steps if s[0] < level or s[0] == level == 0), default=self.steps[0])
        return self.spark.read.schema(f"`group` {self.kind}, pos long, count long, hash binary, level int").parquet(path).where(F.col("level") == level).drop("level")

    def _write(self, nodes: DataFrame, base: int, path: str) -> None:
        stride = self.stride

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in _streamed(batches, ("group", "block", "pos", "count", "hash")):
                group, count, block = rows[0]["group"], rows[0]["count"], rows[0]["block"]
                height = max(0, (count - 1).bit_length() - base)
                floors = tower([r["hash"] for r in rows], min(stride, height))
                for k, hashes in enumerate(floors):
                    if k or not base:
                        first = block << stride >> k
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([group] * len(hashes), kind), pa.array(range(first, first + len(hashes)), pa.int64()), pa.array([count] * len(hashes), pa.int64()), pa.array(hashes, pa.binary()), pa.array([base + k] * len(hashes), pa.int32())], names=["group", "pos", "count", "hash", "level"]
                        )

        kind = pa.string() if self.kind == "string" else pa.int64()
        out = _runs(nodes, stride).mapInArrow(run, f"`group` {self.kind}, pos long, count long, hash binary, level int")
        out.write.partitionBy("level").parquet(path)

    def subroots(self) -> DataFrame:
        """(group, count, hash) of each group's last node."""
        height = levels_of(F.col("count"))
        parts = [self.spark.read.schema(f"`group` {self.kind}, pos long, count long, hash binary, level int").parquet(p).where(F.col("level") == height) for _, p in self.steps]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.select("group", "count", "hash")

    def paths(self, above: DataFrame) -> DataFrame:
        """(group, pos, path) of each run of leaves: ``path`` is packed, from the run's own top to the root.

        ``above`` is (group, path) from each group's subroot to the root.  The paths of the highest step's
        runs are those; each step hands them to the runs below.
        """
        top = self.steps[-1][0]
        now = above.select("group", F.lit(0).cast("long").alias("pos"), "path")
        for base in range(top, 0, -self.stride):
            now = materialise(self.extract(self.level(base), now, base), "paths")
        return now

    def extract(self, nodes: DataFrame, paths: DataFrame, base: int) -> DataFrame:
        """(group, pos, path) of each of ``nodes`` (of level ``base``), given its run's ``paths``: a merge-scan by coordinate."""
        kind, stride = pa.string() if self.kind == "string" else pa.int64(), self.stride

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in _streamed(batches, ("group", "block", "pos", "count", "hash", "path")):
                head, below = rows[0]["path"], rows[1:]
                own = [packed(p) + head for p in siblings(below, base, stride)]
                if not below:  # the group's tree ends further down, and its path waits for it
                    own, below = [head], rows
                yield pa.RecordBatch.from_arrays([pa.array([r["group"] for r in below], kind), pa.array([r["pos"] for r in below], pa.int64()), pa.array(own, pa.binary())], names=["group", "pos", "path"])

        return self.merged(nodes, paths).mapInArrow(run, f"`group` {self.kind}, pos long, path binary")

    def merged(self, nodes: DataFrame, paths: DataFrame, *also: str) -> DataFrame:
        """Nodes and the paths of their runs in order of coordinates; a run's path comes before its nodes."""
        void = [F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in ("count", "hash", *also)]
        heads = paths.select("group", F.shiftleft("pos", self.stride).alias("pos"), "path", F.lit(0).alias("turn"), *void)
        rows = nodes.select("group", "pos", F.lit(None).cast("binary").alias("path"), F.lit(1).alias("turn"), "count", "hash", *also)
        return _runs(heads.unionByName(rows), self.stride, "turn")


def siblings(rows: list[dict], base: int, stride: int) -> list[list[tuple[bool, bytes]]]:
    """The siblings of each of a run's nodes at the levels that the run covers."""
    height = min(stride, max(0, (rows[0]["count"] - 1).bit_length() - base)) if rows else 0
    floors = tower([r["hash"] for r in rows], max(0, height - 1))
    out = []
    for i in range(len(rows)):
        path = []
        for floor in floors[:height]:
            other = i ^ 1
            path.append((bool(i & 1), floor[other] if other < len(floor) else b""))
            i >>= 1
        out.append(path)
    return out


def _folder(df: DataFrame, name: str) -> str:
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/corymb/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


class Manifest:
    """Trees of all groups and the tree over their subroots, for leaves (group, hash, ``order``..., ...)."""

    def __init__(self, leaves: DataFrame, order: tuple[str, ...], folder: str | None = None, stride: int = STRIDE):
        small_batches(leaves.sparkSession)
        folder = folder or _folder(leaves, "merkle")
        self.leaves = placed(leaves, order)
        self.trees = Store(self.leaves, f"{folder}/groups", stride)
        self.tops = materialise(placed(self.trees.subroots().select(F.lit(0).cast("long").alias("group"), F.col("group").alias("name"), F.col("hash")), ("name",)), "subroots")
        self.crown = Store(self.tops, f"{folder}/root", stride)

    def root(self) -> DataFrame:
        """(group, root): one row, or none for an empty dataset."""
        return self.crown.subroots().select("group", F.col("hash").alias("root"))

    def proofs(self, *also: str) -> DataFrame:
        """(hash, ``also``..., subroot, root, path) of each leaf."""
        crown = self.crown.extract(self.crown.level(0), self.crown.paths(self.root().select("group", F.lit(b"").alias("path"))), 0)
        # a row a group: the way from its subroot to the root, then both of these; the root is one row
        tops = self.tops.join(crown, ["group", "pos"]).join(F.broadcast(self.root()), "group")
        above = materialise(tops.select(F.col("name").alias("group"), F.concat("path", "hash", "root").alias("path")), "above")
        names, stride = ("hash", *also), self.trees.stride

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in _streamed(batches, ("group", "block", "pos", "count", "path", *names)):
                head, rows = rows[0]["path"], rows[1:]
                rest, ends = head[:-64], head[-64:]
                own = [packed(p) + rest for p in siblings(rows, 0, stride)]
                yield pa.RecordBatch.from_arrays([*(pa.array([r[c] for r in rows], t) for c, t in zip(names, kinds, strict=True)), pa.array([ends[:32]] * len(rows), pa.binary()), pa.array([ends[32:]] * len(rows), pa.binary()), pa.array(own, pa.binary())], names=[*names, "subroot", "root", "path"])

        fields = [self.leaves.schema[c] for c in names]
        kinds = [pa.binary() if f.dataType.simpleString() == "binary" else pa.int64() for f in fields]
        dealt = self.trees.merged(self.leaves, self.trees.paths(above), *also)
        return dealt.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", subroot binary, root binary, path binary")


DIGEST = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def proof_digest(docs: DataFrame, stride: int = STRIDE) -> DataFrame:
    """The contract's rows for a documents table: each row's proof, checked after some rows were tampered with."""
    docs = need(docs, doc_id="long", source="string", lang="string", n_chars="long", text="string")
    row = lambda n: leaf_hash(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))
    touched = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    more = row(F.col("n_chars").cast("decimal(20,0)") + 1)
    leaves = materialise(docs.select(F.col("lang").alias("group"), "doc_id", row(F.col("n_chars")).alias("hash"), F.when(touched, more).alias("changed")), "leaves")
    proved = Manifest(leaves, ("doc_id", "hash"), stride=stride).proofs("doc_id", "changed")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, leaf, changed, subroot, root, raw in zip(*(b.column(c).to_pylist() for c in ("doc_id", "hash", "changed", "subroot", "root", "path")), strict=True):
                path = unpacked(raw)
                found = fold(changed or leaf, path)
                out.append((doc_id, leaf.hex(), subroot.hex(), root.hex(), hashlib.sha256("".join(s.hex() for _, s in path).encode()).hexdigest(), found.hex(), found == root))
            cols = zip(*out, strict=True) if out else [()] * 7
            kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in DIGEST.split(", ")])

    return proved.mapInArrow(check, DIGEST)


_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_UP = "SELECT lv + 1, g, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM {0} WHERE n > 1 GROUP BY lv, g, pos // 2, n"
#: Nodes by recursion; DuckDB has no CRC function, so a list fold computes it.
PROOF_SQL = f"""
WITH RECURSIVE tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i::BIGINT] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS x(i))),
d AS (SELECT row_number() OVER () AS id, doc_id, lang, n_chars, {_FIELD.format('doc_id')} || {_FIELD.format('source')} || {_FIELD.format('lang')} AS pre, {_FIELD.format('text')} AS post,
  coalesce(xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda p: ascii(p)::BIGINT), lambda c, b: xor(c >> 8, tab.t[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 0, false) AS touched FROM documents, tab),
b AS (SELECT id, doc_id, coalesce('=' || lang, '') AS g, sha256(pre || {_FIELD.format('n_chars')} || post) AS leaf, sha256(pre || {_FIELD.format('(n_chars + touched::INTEGER)')} || post) AS changed FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM b),
t AS (SELECT 0 AS lv, g, pos, n, leaf AS h FROM p UNION ALL {_UP.format('t')}),
s AS (SELECT g AS name, 0 AS g, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n, h FROM t WHERE n = 1),
u AS (SELECT 0 AS lv, g, pos, n, h FROM s UNION ALL {_UP.format('u')}),
w AS (SELECT p.id, e.lv AS k, (p.pos >> e.lv) & 1 AS side, t.h FROM p JOIN (SELECT DISTINCT g, lv FROM t WHERE n > 1) e ON e.g = p.g LEFT JOIN t ON t.g = p.g AND t.lv = e.lv AND t.pos = xor(p.pos >> e.lv, 1)
  UNION ALL SELECT p.id, 1000 + e.lv, (s.pos >> e.lv) & 1, u.h FROM p JOIN s ON s.name = p.g JOIN (SELECT DISTINCT lv FROM u WHERE n > 1) e ON true LEFT JOIN u ON u.lv = e.lv AND u.pos = xor(s.pos >> e.lv, 1)),
o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k) AS i FROM w),
f AS (SELECT id, 0::BIGINT AS i, changed AS h FROM p UNION ALL SELECT f.id, o.i, CASE WHEN o.h IS NULL THEN sha256(f.h) WHEN side = 1 THEN sha256(o.h || f.h) ELSE sha256(f.h || o.h) END FROM f JOIN o ON o.id = f.id AND o.i = f.i + 1),
r AS (SELECT id, sha256(coalesce(string_agg(h, '' ORDER BY k), '')) AS proof_sha256 FROM w GROUP BY id),
z AS (SELECT id, arg_max(h, i) AS folded_root FROM f GROUP BY id)
SELECT doc_id, leaf, s.h AS subroot, u.h AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = u.h AS verified FROM p JOIN s ON s.name = p.g JOIN u ON u.n = 1 JOIN z USING (id) LEFT JOIN r USING (id)"""
