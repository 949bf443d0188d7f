"""Prefix trie of conversations: families build small tries, whose combined nodes are merged into one."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherlode.llm.text import alone, only, settle

#: Ids of one family, turns of its base that a conversation may start with, and nodes that a task holds.
FAMILY, HEAD, HELD = 20, 3, 1 << 18
_ROOT = bytes(16)
_NODE = "base long, k1 long, k2 long, p1 long, p2 long, depth long, words long, n long, low long, ends array<long>"


def base_of(conv_id: Column) -> Column:
    return conv_id - conv_id % FAMILY


def _narrow(conversations: DataFrame) -> DataFrame:
    """(base, other, conv_id, turn, key, words, keep): a turn is told by 16 bytes of a digest, so no text is shuffled."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    key = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)
    conv = F.col("conv_id").cast("long")
    keep = (F.crc32(conv.cast("string").cast("binary")) % (HEAD + 1)).cast("int")
    return conversations.where("conv_id IS NOT NULL").select(base_of(conv).alias("base"), (conv % FAMILY != 0).alias("other"), conv.alias("conv_id"), F.col("turn"), key.alias("key"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"), keep.alias("keep"))


class _Family:
    """The trie of the family that is being read, or a part of it: of each node its parent, depth, words, members, smallest member, and those that end there."""

    def __init__(self) -> None:
        self.nodes: dict[bytes, list] = {}
        self.head: list[tuple[bytes, int]] = []
        self.base: int | None = None

    def begin(self, conv: int, keep: int) -> None:
        self.conv, self.keep, self.seen, self.depth, self.parent, self.at, self.started = conv, keep, 0, 0, _ROOT, _ROOT, conv == self.base
        self.enter(0)

    def enter(self, words: int) -> None:
        if node := self.nodes.get(self.at):
            node[3] += 1
            node[4] = min(node[4], self.conv)
        else:
            self.nodes[self.at] = [self.parent, self.depth, words, 1, self.conv, []]

    def step(self, key: bytes, words: int) -> None:
        self.parent, self.at, self.depth = self.at, hashlib.sha256(self.at + key).digest()[:16], self.depth + 1
        self.enter(words)

    def start(self) -> None:
        """The turns of the base that come before the conversation's own."""
        if not self.started:
            self.started = True
            for key, words in self.head[: self.keep]:
                self.step(key, words)

    def turn(self, key: bytes, words: int) -> None:
        self.seen += 1
        if self.conv == self.base:
            if self.seen <= HEAD:
                self.head.append((key, words))
            self.step(key, words)
        elif self.seen > self.keep:
            self.start()
            self.step(key, words)

    def end(self) -> None:
        self.start()
        node = self.nodes.get(self.at)
        if node is None:  # the rest of the trie has been written already
            node = self.nodes[self.at] = [self.parent, self.depth, 0, 0, self.conv, []]
        node[5].append(self.conv)

    def written(self) -> pa.RecordBatch:
        pairs = lambda keys: np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2).T.copy()
        parents, *rest = zip(*self.nodes.values(), strict=True)
        arrays = [pa.array(np.full(len(parents), self.base)), *map(pa.array, (*pairs(self.nodes), *pairs(parents))), *(pa.array(x, pa.int64()) for x in rest[:4]), pa.array(rest[4], pa.list_(pa.int64()))]
        self.nodes = {}
        return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in _NODE.split(", ")])


def _family_tries(batches: Iterator[pa.RecordBatch], held: int) -> Iterator[pa.RecordBatch]:
    """Turns sorted by family, its base first, then by conversation -> the nodes of each family's trie. A trie of over held nodes is written in parts."""
    only("trie")
    trie, conv = _Family(), None
    for rows in batches:
        for base, c, key, words, keep in zip(*(rows.column(i).to_pylist() for i in range(5)), strict=True):
            if c != conv:
                if conv is not None:
                    trie.end()
                if base != trie.base:
                    if trie.nodes:
                        yield trie.written()
                    trie.base, trie.head = base, []
                trie.begin(c, keep)
                conv = c
            trie.turn(key, words)
            if len(trie.nodes) >= held:
                yield trie.written()
    if conv is not None:
        trie.end()
        yield trie.written()


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes sorted by family and from the deepest up -> sums over each node's subtree within its family. Holds a level, of FAMILY * 2 nodes at most."""
    only("trie")
    family, former, below = None, None, {}
    for rows in batches:
        out: list[tuple] = []
        for base, k1, k2, p1, p2, depth, leaf, saved in zip(*(rows.column(i).to_pylist() for i in range(8)), strict=True):
            if base != family:
                if family is not None:
                    out.append((0, 0, *below.pop((0, 0))))
                family, below, former = base, {}, None
            if (k1, k2) == former:  # from another part of the family's trie
                continue
            former = (k1, k2)
            deeper = below.pop(former, (0, 0))
            sums = (leaf + deeper[0], saved + deeper[1])
            over = below.get((p1, p2), (0, 0))
            below[p1, p2] = (over[0] + sums[0], over[1] + sums[1])
            out.append((k1, k2, *sums))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["k1", "k2", "n_leaves", "saved_tokens"])
    if family is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (0, 0, *below[0, 0])], ["k1", "k2", "n_leaves", "saved_tokens"])


def _end_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of conversations by node and family, in order -> a digest for each node. Holds the ids of one family and node."""
    only("trie")
    node, family, ids, sha, first = None, None, [], hashlib.sha256(), True
    made: list[tuple] = []

    def add() -> None:
        nonlocal first
        for i in sorted(ids):
            sha.update(b"%d" % i if first else b",%d" % i)
            first = False

    for rows in batches:
        for k1, k2, base, some in zip(*(rows.column(i).to_pylist() for i in range(4)), strict=True):
            if ((k1, k2), base) != (node, family) and ids:
                add()
                ids = []
            if (k1, k2) != node:
                if node:
                    made.append((*node, sha.hexdigest()))
                node, sha, first = (k1, k2), hashlib.sha256(), True
            family = base
            ids = ids + some
        if made:
            yield _ended(made)
            made = []
    if node:
        add()
        yield _ended([(*node, sha.hexdigest())])


def _ended(made: list[tuple]) -> pa.RecordBatch:
    k1, k2, sha = zip(*made, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sha, pa.string())], ["k1", "k2", "ends_sha256"])


def prefix_trie(conversations: DataFrame, held: int = HELD) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations (conv_id, turn, role, text).

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256. Turns go by turn, null first, then by the
    digest of role and text; repeated rows are turns like others. Null roles and texts
    are empty, rows without a conv_id belong to no conversation, extra columns are
    left out, an empty table has no nodes.

    A family (a base and its conversations) is read in one task as a sorted stream, its
    base first; the task holds held nodes at most. What meets across families is a node
    of each family, not of each conversation, summed up before the shuffle. Sums over
    subtrees are taken within families too, each node counting in the family of its
    smallest member alone, so depth needs no rounds.
    """
    turns = _narrow(conversations).repartition("base").sortWithinPartitions("base", "other", "conv_id", F.asc_nulls_first("turn"), "key")
    nodes = settle(turns.select("base", "conv_id", "key", "words", "keep").mapInArrow(lambda batches: _family_tries(batches, held), _NODE))
    merged = nodes.groupBy("k1", "k2").agg(*(F.max(c).alias(c) for c in ("p1", "p2", "depth", "words")), F.sum("n").alias("n_convs"), F.min("low").alias("conv_id"))
    merged = settle(merged)
    children = merged.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    trie = settle(merged.join(children, ["k1", "k2"], "left").na.fill(0, ["n_children"]))
    top = trie.where("depth = 0").first()
    if top is None:
        return _named(trie.withColumns({"parent_conv_id": F.lit(None).cast("long"), "n_leaves": F.lit(0).cast("long"), "saved_tokens": F.lit(0).cast("long"), "ends_sha256": F.lit("")}))

    owned = nodes.where("depth > 0").select("base", "k1", "k2").join(trie.where("depth > 0"), ["k1", "k2"])
    mine = base_of(F.col("conv_id")) == F.col("base")
    worth = owned.select("base", "k1", "k2", "p1", "p2", "depth", F.when(mine & (F.col("n_children") == 0), 1).otherwise(0).cast("long").alias("leaf"), F.when(mine, (F.col("n_convs") - 1) * F.col("words")).otherwise(0).alias("saved"))
    sums = worth.repartition("base").sortWithinPartitions("base", F.desc("depth"), "k1", "k2").mapInArrow(_subtrees, "k1 long, k2 long, n_leaves long, saved_tokens long")
    sums = sums.groupBy("k1", "k2").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    ends = nodes.where("size(ends) > 0").select("k1", "k2", "base", "ends").repartition("k1", "k2").sortWithinPartitions("k1", "k2", "base").mapInArrow(_end_digests, "k1 long, k2 long, ends_sha256 string")

    # Every first turn has the same parent, whose id is known: only deeper nodes look theirs up.
    parents = trie.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    deep = trie.where("depth > 1").join(parents, ["p1", "p2"])
    high = trie.where("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, top["conv_id"]).cast("long"))
    full = deep.unionByName(high).join(sums, ["k1", "k2"], "left").join(ends, ["k1", "k2"], "left")
    n_leaves = F.coalesce("n_leaves", F.lit(0)) + F.when((F.col("depth") == 0) & (F.col("n_children") == 0), 1).otherwise(0)
    return _named(full.withColumns({"n_leaves": n_leaves, "saved_tokens": F.coalesce("saved_tokens", F.lit(0)), "ends_sha256": F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest()))}))


def _named(trie: DataFrame) -> DataFrame:
    return trie.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each rebuilt on the first turns of its family's base."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return alone(spark, lambda: prefix_trie(rows))


#: CRC-32 of a string's bytes, bit by bit; conversations are decimals, so their characters are their bytes.
_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(%s, ''), lambda c: [ord(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))), 4294967295)"
ORACLE = f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS place,
    {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS said FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id, conv_id - conv_id % {FAMILY} AS base, {_CRC % "CAST(conv_id AS VARCHAR)"} % {HEAD + 1} AS h FROM t),
b AS (SELECT c.conv_id, 0 AS part, t.place, t.said FROM c JOIN t ON t.conv_id = c.base AND t.place <= c.h
  UNION ALL SELECT c.conv_id, 1, t.place, t.said FROM c JOIN t ON t.conv_id = c.conv_id AND t.place > c.h),
r AS (SELECT c.conv_id, coalesce(list(b.said ORDER BY part, place) FILTER (b.said IS NOT NULL), []) AS path FROM c LEFT JOIN b USING (conv_id) GROUP BY 1),
n AS (SELECT conv_id, path[1:d] AS path, d AS depth, d = len(path) AS ends FROM (SELECT conv_id, path, unnest(range(len(path) + 1)) AS d FROM r)),
g AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
    CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(path[-1].text, '[^\x20\x09-\x0D]+')) END AS words FROM n GROUP BY path, depth),
k AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM g WHERE depth > 0 GROUP BY 1),
f AS (SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN k USING (path)),
s AS (SELECT path[1:d] AS path, sum((n_convs - 1) * words) AS saved, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS leaves FROM (SELECT *, unnest(range(depth + 1)) AS d FROM f) GROUP BY 1)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN s USING (path) LEFT JOIN f p ON p.path = f.path[1:f.depth - 1] AND p.depth = f.depth - 1"""
