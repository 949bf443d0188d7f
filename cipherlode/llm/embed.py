"""Embedding near-dedup: tiles in PCA order, leading dimensions first, given up when no cosine can reach the threshold."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherlode.llm.graph import components, lowest
from cipherlode.llm.text import settle

THRESHOLD = 0.93
#: Vectors in a tile; dimensions that the first pass adds, doubled every time; leading axes by which tiles are cut.
TILE, FIRST, AXES = 768, 8, 8
#: Numbers (of 8 bytes) in a block of vectors, about: a task holds two blocks.
BLOCK = 1 << 22
#: Pairs are followed singly once so small a part of a tile's is left.
FEW = 1 / 16
#: Above the rounding of a product of turned unit vectors; pairs this near the threshold are decided from the vectors as given.
SLACK = 1e-9


def _by_length(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, vectors) for each length, every vector scaled by a power of two, which rounds nothing, to numbers whose squares fit."""
    size = np.array(column.value_lengths())
    values, ends = np.asarray(column.flatten(), np.float64), np.cumsum(size)
    for d in np.unique(size).tolist():
        x = values[np.concatenate([np.arange(e - d, e) for e in ends[size == d]])].reshape(-1, d)
        yield np.flatnonzero(size == d), np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def _turn(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Unit vectors along the principal axes."""
    x = x @ axes
    return x / np.linalg.norm(x, axis=1)[:, None]


def _gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of outer products of unit vectors, by dimension: d * d numbers a partition."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for _, x in _by_length(batch.column(0)):
            x = x / np.linalg.norm(x, axis=1)[:, None]
            sums[x.shape[1]] = sums.get(x.shape[1], 0) + x.T @ x
    for d, s in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([d] * d * d, pa.int32()), pa.array(range(d * d), pa.int32()), pa.array(s.ravel())], ["d", "i", "v"])


def near_duplicates(df: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """(key, n_links, component_id, kept) for every row: links to other rows of the same label by cosine >= threshold.

    A vector that is null, empty, zero or holds null or non-finite components, or
    whose label or key is null, links with nothing (a null key: component null, not kept); vectors
    of different length neither. Equal vectors of a label form one class with a
    count before anything is compared, so copies are never expanded. Rows with the
    same key are different vectors. An empty table gives no rows; other columns are left out.

    The cosine is dot(x, y) / (norm(x) * norm(y)) of the vectors as given, in doubles: a pair
    whose product along the principal axes is within rounding of the threshold is decided by it.

    Unit vectors with that cosine lie within sqrt(2 - 2 threshold) along each
    principal axis: cells of that width over the two leading axes meet only their
    neighbours. Cells are cut into blocks by their counted size; a table of pairs of
    block numbers says which blocks meet, a vector goes to a task for each pair of its
    block, and a task holds two blocks. It cuts them into tiles along the leading axes, passes over
    tiles whose boxes lie too far apart, and compares the others. Pairs of blocks give
    link counts and a forest, not pairs of vectors. Copies of one vector meet their class in a
    join, whose crowded partitions the adaptive planner splits.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(label).alias("label"), F.col(embedding).cast("array<double>").alias("v"))
    rows = rows.withColumn("uid", F.monotonically_increasing_id())
    fine = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists("v", lambda x: x != 0)
    good = F.coalesce(F.col("key").isNotNull() & F.col("label").isNotNull() & fine, F.lit(False))
    valid = rows.where(good)
    classes = settle(valid.groupBy("label", "v").agg(F.min("uid").alias("cid"), F.count("*").alias("n"), F.min("key").alias("low")))
    cells: dict[int, np.ndarray] = {}
    for r in classes.select("v").mapInArrow(_gram, "d int, i int, v double").groupBy("d", "i").agg(F.sum("v").alias("v")).collect():
        cells.setdefault(r["d"], np.zeros((r["d"], r["d"]))).flat[r["i"]] = r["v"]
    axes = {d: np.linalg.eigh(g)[1][:, ::-1].copy() for d, g in cells.items()}
    width = math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, cells = np.array(batch.column(3).value_lengths(), np.int32), np.zeros((2, len(batch)), np.int32)
            for at, x in _by_length(batch.column(3)):
                lead = np.floor(_turn(x, axes[x.shape[1]])[:, :2] / width)
                cells[: lead.shape[1], at] = lead.T
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(size), pa.array(cells[0]), pa.array(cells[1])], ["label", "cid", "n", "v", "d", "c1", "c2"])

    kind = dict(classes.dtypes)["label"]
    placed = settle(classes.select("label", "cid", "n", "v").mapInArrow(place, f"label {kind}, cid long, n long, v array<double>, d int, c1 int, c2 int"))
    cell = ["label", "d", "c1", "c2"]
    counted = settle(placed.groupBy(*cell).agg(F.count("*").alias("many")).select(*cell, F.ceil(F.col("many") * F.col("d") / BLOCK).alias("blocks")))
    steps = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))))
    from_here = counted.withColumn("s", F.explode(steps)).select("label", "d", F.col("c1").alias("from1"), F.col("c2").alias("from2"), F.col("blocks").alias("from_blocks"), (F.col("c1") + F.col("s.a")).alias("c1"), (F.col("c2") + F.col("s.b")).alias("c2"))
    meeting = from_here.join(counted, cell).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("from_blocks") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    own = (F.col("from1") == F.col("c1")) & (F.col("from2") == F.col("c2"))
    pairs = settle(meeting.where(~own | (F.col("i") <= F.col("j"))).select(F.monotonically_increasing_id().alias("pair"), "label", "d", "from1", "from2", "i", "c1", "c2", "j", (own & (F.col("i") == F.col("j"))).alias("same")))
    first = pairs.select("pair", F.lit(0).alias("side"), "label", "d", F.col("from1").alias("c1"), F.col("from2").alias("c2"), F.col("i").alias("block"))
    second = pairs.where(~F.col("same")).select("pair", F.lit(1).alias("side"), "label", "d", "c1", "c2", F.col("j").alias("block"))
    vectors = placed.join(counted, cell).select(*cell, F.pmod(F.xxhash64("cid"), "blocks").alias("block"), "cid", "n", "v")
    sent = first.union(second).join(vectors, [*cell, "block"]).select("pair", "side", "cid", "n", "v")

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side, cid, n = (np.asarray(table.column(c)) for c in ("side", "cid", "n"))
        _, given = next(_by_length(table.column("v").chunk(0)))  # all are of one length
        turned = _turn(given, axes[given.shape[1]])
        parts = [_tiles(turned, np.flatnonzero(side == k)) for k in (0, 1)]
        same = not parts[1]
        boxes = [[(turned[t, :AXES].min(axis=0), turned[t, :AXES].max(axis=0)) for t in p] for p in parts]
        links, low = np.zeros(len(cid), np.int64), np.arange(len(cid))
        for k, rows in enumerate(parts[0]):
            for m, cols in enumerate(parts[0][k:] if same else parts[1], k if same else 0):
                (a_low, a_high), (b_low, b_high) = boxes[0][k], boxes[0 if same else 1][m]
                gap = np.maximum(0, np.maximum(a_low - b_high, b_low - a_high))
                if gap @ gap > 2 - 2 * threshold + SLACK:
                    continue
                i, j, total = _links(turned[rows], turned[cols], threshold)
                i, j = rows[i], cols[j]
                sure = np.abs(total - threshold) > SLACK
                sure[~sure] = [_cosine(given[x], given[y]) >= threshold for x, y in zip(i[~sure], j[~sure], strict=True)]
                if same and k == m:
                    sure &= i < j
                i, j = i[sure], j[sure]
                np.add.at(links, i, n[j])
                np.add.at(links, j, n[i])
                low = lowest(np.concatenate((i, np.arange(len(low)))), np.concatenate((j, low)), len(low)) if len(i) else low
        some, moved = np.flatnonzero(links), np.flatnonzero(low != np.arange(len(low)))
        a, b = np.concatenate((cid[some], cid[moved])), np.concatenate((np.full(len(some), -1), cid[low[moved]]))
        return pa.table([pa.array(a), pa.array(np.concatenate((links[some], np.zeros(len(moved), np.int64)))), pa.array(b)], names=["a", "links", "b"])

    found = settle(sent.groupBy("pair").applyInArrow(compare, "a long, links long, b long"))
    counts = found.where("b < 0").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    parts = components(found.where("b >= 0").select("a", "b")).select(F.col("node").alias("cid"), "component")
    of = classes.join(counts, "cid", "left").join(parts, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    lows = of.groupBy("component").agg(F.min("low").alias("component_id"))
    done = of.join(lows, "component").select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    linked = valid.select("key", "label", "v").join(done, ["label", "v"]).select("key", "n_links", "component_id")
    alone = rows.where(~good).select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("key") == F.col("component_id"), F.lit(False))).withColumnRenamed("key", key)


def _cosine(x: np.ndarray, y: np.ndarray) -> float:
    return np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y))


def _tiles(x: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """rows in parts of TILE at most, halved along one leading axis after another."""
    todo, done = [(rows, 0)] if len(rows) else [], []
    while todo:
        rows, axis = todo.pop()
        if len(rows) <= TILE:
            done.append(rows)
            continue
        half = len(rows) // 2
        rows = rows[np.argpartition(x[rows, axis], half)]
        todo += [(part, (axis + 1) % min(AXES, x.shape[1])) for part in (rows[:half], rows[half:])]
    return done


def _links(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, product) of pairs whose product is within SLACK of the threshold or above.

    Each pass adds leading dimensions and bounds the rest by the suffixes' norms. What
    can't reach the threshold goes: rows and columns while a matrix is dense, then single pairs.
    """
    d, done, step = a.shape[1], 0, FIRST
    rest = [np.sqrt(np.maximum(0, np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1])) for x in (a, b)]
    rest = [np.concatenate((r, np.zeros((len(r), 1))), axis=1) for r in rest]
    i, j, total, single = np.arange(len(a)), np.arange(len(b)), np.zeros((len(a), len(b))), False
    while done < d and total.size:
        to = min(d, done + step)
        if single:
            total = total + np.einsum("pk,pk->p", a[i, done:to], b[j, done:to])
            able = total + rest[0][i, to] * rest[1][j, to] >= threshold - SLACK
            i, j, total = i[able], j[able], total[able]
        else:
            total = total + a[i, done:to] @ b[j, done:to].T
            able = total + rest[0][i, to][:, None] * rest[1][j, to] >= threshold - SLACK
            single = to == d or np.count_nonzero(able) <= FEW * able.size
            if single:
                x, y = np.nonzero(able)
                i, j, total = i[x], j[y], total[x, y]
            else:
                rows, cols = able.any(axis=1), able.any(axis=0)
                i, j, total = i[rows], j[cols], total[rows][:, cols]
        done, step = to, step * 2
    return i, j, total


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
