"""Benchmark decontamination: rare n-gram seeds find passages, Smith-Waterman alignment scores them."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from cipherlode.llm.text import WORDS_BYTES, Words, alone, chunks, mix, settle, with_uid, words

#: Scores of a word; an alignment counts from this share of the item's own score.
MATCH, MISMATCH, GAP, THRESHOLD = 2, -1, -1, 0.5
#: Bits of the filter of seeds that goes to every task: 16 a seed between these powers of two. It only spares rows; beyond it more pass.
FILTER_BITS = (20, 27)
#: Bytes of passages' places that are broadcast; more are joined by an exchange of the texts.
BROADCAST_BYTES = 32 << 20
#: Cells of one group of alignment matrices.
CELLS = 1 << 20
#: Distinct seeds that a counting task holds.
HELD = 1 << 20


def seeds(found: Words, single: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places): each word with the next and with the one after that, of the same text; or each word alone. Ordered by place."""
    at = np.arange(len(found.hashes))
    if single:
        return mix(found.hashes), at
    last = np.repeat(found.first[1:], np.diff(found.first))
    hashes = np.empty((len(at), 2), np.uint64)
    inside = np.empty((len(at), 2), bool)
    for k in (0, 1):
        other = np.minimum(at + k + 1, max(0, len(at) - 1))
        hashes[:, k], inside[:, k] = mix(found.hashes * np.uint64(3) + mix(found.hashes[other])), at + k + 1 < last
    return hashes[inside], np.repeat(at, inside.sum(axis=1))


def bounds(size: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(needed, dropped, slack, single) of items with so many words.

    An alignment of m matches that loses x on other columns reaches the least
    score T if 2 m - x >= T. Of its m - 1 steps from a match to the next, at most
    x / 2 lose 2 or more. So at least ceil(T / 2) - 1 steps lose 1 at most: they
    go on by one or two words both in the item and in the text, and a seed that
    starts at the step's first word is in both. Where that number is 0 (single), items are
    looked up by single words, one of which must be found. Of the words that start seeds
    the `dropped` most common may go unasked, since `needed` of those that must be found are among
    the rest. `slack` is the most that x can be, thus the most by which the found seeds' diagonals differ.
    """
    least = np.maximum(1, np.ceil(MATCH * size * threshold - 1e-9).astype(np.int64))
    bound = (least + 1) // 2 - 1
    needed = np.maximum(1, -(-bound // 4))
    return needed, np.maximum(0, bound - needed), np.maximum(0, MATCH * size - least), bound == 0


def _of(hashes: np.ndarray) -> Words:
    return Words(hashes, hashes, hashes, hashes, np.array([0, len(hashes)]))


def _prepare(threshold: float):
    """Benchmark items as hashes of their words; those without words go."""

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in chunks(batch.column(1), WORDS_BYTES):
                found = words(texts)
                size = np.diff(found.first)
                needed, dropped, slack, single = bounds(size, threshold)
                some = np.flatnonzero(size)
                packed = [found.hashes[found.first[k] : found.first[k + 1]].tobytes() for k in some]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first + some)), pa.array(packed, pa.binary()), *(pa.array(x[some].astype(np.int32)) for x in (size, needed, dropped, slack)), pa.array(single[some])], ["iid", "words", "n", "needed", "dropped", "slack", "single"])

    return prepare


def _seed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for iid, packed, single in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            hashes, at = seeds(_of(np.frombuffer(packed, np.uint64)), single)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.astype(np.int64)), pa.array(np.full(len(at), iid)), pa.array(at.astype(np.int32))], ["hash", "iid", "at"])


class Filter(NamedTuple):
    """Bits that are set for known seeds; a few others may pass."""

    shift: int
    words: np.ndarray

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        bit = hashes >> np.uint64(self.shift)
        return np.flatnonzero((self.words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1))


def _filter(known: DataFrame) -> Filter:
    """From a stored table of seeds; 2**FILTER_BITS[1] bits at most come to the driver."""
    bits = min(max(math.ceil(math.log2(16 * known.count() + 1)), FILTER_BITS[0]), FILTER_BITS[1])
    bit = known.select(F.expr(f"shiftrightunsigned(hash, {64 - bits})").alias("b"))
    packed = bit.groupBy(F.expr("shiftright(b, 6)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(b & 63 as int)))").alias("m")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[np.asarray(packed.column("w"))] = np.asarray(packed.column("m")).astype(np.uint64)
    return Filter(64 - bits, out)


def _asked(found: Words, single: bool) -> tuple[np.ndarray, np.ndarray]:
    """A text's seeds, with single words where an item needs them."""
    hashes, at = seeds(found)
    if single:
        more = seeds(found, single=True)
        hashes, at = np.concatenate((hashes, more[0])), np.concatenate((at, more[1]))
    return hashes, at


def _count(known: Filter, single: bool):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], []

        def flush() -> pa.RecordBatch:
            hashes, at = np.unique(np.concatenate([*held, np.zeros(0, np.uint64)]), return_inverse=True)
            total = np.bincount(at, np.concatenate([*n, np.zeros(0)]), len(hashes)).astype(np.int64)
            held.clear()
            n.clear()
            return pa.RecordBatch.from_arrays([pa.array(hashes.astype(np.int64)), pa.array(total)], ["hash", "n"])

        for batch in batches:
            for _, texts in chunks(batch.column(0), WORDS_BYTES):
                hashes, _ = _asked(words(texts), single)
                distinct, times = np.unique(hashes[known.passes(hashes)], return_counts=True)
                held.append(distinct)
                n.append(times)
                if sum(map(len, held)) > HELD:
                    yield flush()
        yield flush()

    return count


def _find(known: Filter, single: bool):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids = np.asarray(batch.column(0))
            for first, texts in chunks(batch.column(1), WORDS_BYTES):
                found = words(texts)
                hashes, at = _asked(found, single)
                some = known.passes(hashes)
                hashes, at = hashes[some], at[some]
                doc = np.searchsorted(found.first, at, side="right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(uids[first + doc]), pa.array(hashes.astype(np.int64)), pa.array((at - found.first[doc]).astype(np.int32))], ["uid", "hash", "place"])

    return find


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of texts where enough of an item's seeds lie on diagonals within its slack. Seeds come by text, item and diagonal."""

    def passages(uid: np.ndarray, iid: np.ndarray, start: np.ndarray, at: np.ndarray, n: np.ndarray, needed: np.ndarray, slack: np.ndarray) -> pa.RecordBatch:
        first = lambda c: np.ones(min(1, len(c)), bool)
        apart = lambda *cols: np.concatenate((first(cols[0]), np.logical_or.reduce([np.diff(c) != 0 for c in cols])))
        once = np.flatnonzero(apart(uid, iid, start, at))
        uid, iid, start, n, needed, slack = (c[once] for c in (uid, iid, start, n, needed, slack))
        last = np.arange(len(uid)) + needed - 1  # so many of them within the slack of diagonals
        end = np.minimum(last, max(0, len(uid) - 1))
        opens = np.flatnonzero((last < len(uid)) & (uid[end] == uid) & (iid[end] == iid) & (start[end] - start <= slack))
        edge = np.bincount(opens, minlength=len(uid) + 1) - np.bincount(last[opens] + 1, minlength=len(uid) + 1)
        kept = np.flatnonzero(np.cumsum(edge)[:-1] > 0)
        uid, iid, start, n, slack = (c[kept] for c in (uid, iid, start, n, slack))
        lead = np.flatnonzero(apart(uid, iid) | np.concatenate((first(uid), np.diff(start) > slack[1:])))
        high = np.maximum.reduceat(start, lead) if len(lead) else start
        return pa.RecordBatch.from_arrays([pa.array(uid[lead]), pa.array(iid[lead]), pa.array((start[lead] - slack[lead]).astype(np.int32)), pa.array((high + n[lead] + slack[lead]).astype(np.int32))], ["uid", "iid", "low", "high"])

    held: list[np.ndarray] | None = None
    for batch in batches:
        now = [np.asarray(c).astype(np.int64) for c in batch.columns]
        now = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
        new = np.flatnonzero((np.diff(now[0]) != 0) | (np.diff(now[1]) != 0))
        cut = new[-1] + 1 if len(new) else 0
        yield passages(*(c[:cut] for c in now))
        held = [c[cut:] for c in now]
    if held:
        yield passages(*held)


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the words of each stretch."""
    for batch in batches:
        asked = batch.column(2).to_pylist()
        for first, texts in chunks(batch.column(1), WORDS_BYTES):
            found, out = words(texts), []
            for k in range(len(texts)):
                own = found.hashes[found.first[k] : found.first[k + 1]]
                out += [(first + k, w["iid"], max(0, w["low"]), own[max(0, w["low"]) : max(0, w["high"])].tobytes()) for w in asked[first + k]]
            row, *rest = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(c, k) for c, k in zip(rest, (pa.int64(), pa.int32(), pa.binary()), strict=True))], ["key", "iid", "low", "passage"])


def align(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment of each (item, passage): score, and where it ends in both. Pairs are of like size and go row by row together."""
    rows, cols = max(len(a) for a, _ in pairs), max(len(b) for _, b in pairs)
    a, b = np.zeros((len(pairs), rows), np.uint64), np.ones((len(pairs), cols), np.uint64)
    here, there = np.zeros(a.shape, bool), np.zeros(b.shape, bool)
    for k, (x, y) in enumerate(pairs):
        a[k, : len(x)], b[k, : len(y)] = x, y
        here[k, : len(x)], there[k, : len(y)] = True, True
    last = np.zeros((len(pairs), cols + 1), np.int32)
    best, ends = np.zeros(len(pairs), np.int32), np.zeros((2, len(pairs)), np.int64)
    slope = np.arange(cols + 1, dtype=np.int32) * -GAP
    for i in range(rows):
        score = np.where((a[:, i, None] == b) & here[:, i, None] & there, MATCH, MISMATCH).astype(np.int32)
        now = np.zeros_like(last)
        now[:, 1:] = np.maximum(0, np.maximum(last[:, :-1] + score, last[:, 1:] + GAP))
        now = np.maximum.accumulate(now + slope, axis=1) - slope  # a run of gaps along the passage
        top = now.argmax(axis=1)
        value = np.take_along_axis(now, top[:, None], 1)[:, 0]
        better = value > best
        best[better], ends[0, better], ends[1, better] = value[better], i + 1, top[better]
        last = now
    return best, ends[0], ends[1]


def aligned(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """(score, start, end) in the passage for each pair; the start is the end of the reversed alignment."""
    out = np.zeros((len(pairs), 3), np.int64)
    order = sorted(range(len(pairs)), key=lambda k: len(pairs[k][1]))
    k = 0
    while k < len(order):
        n = max(1, CELLS // max(1, len(pairs[order[min(len(order) - 1, k + 4095)]][1])))
        part = order[k : k + min(n, 4096)]
        score, in_item, in_text = align([pairs[p] for p in part])
        back = [(pairs[p][0][: in_item[q]][::-1], pairs[p][1][: in_text[q]][::-1]) for q, p in enumerate(part)]
        start = in_text - np.array(align(back)[2]) if max(score) > 0 else in_text
        out[part] = np.stack((score, start, in_text), axis=1)
        k += len(part)
    return out


def _score(threshold: float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) for a, b in zip(batch.column(4).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            found = aligned(pairs)
            share = found[:, 0] / (MATCH * np.array([len(a) for a, _ in pairs]))
            good = np.flatnonzero(share >= threshold)
            same = [int(np.isin(pairs[g][0], pairs[g][1][found[g, 1] : found[g, 2]]).sum()) for g in good]
            low = np.asarray(batch.column(2))[good]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good)), batch.column(1).take(pa.array(good)), pa.array(share[good]), pa.array(same, pa.int32()), *(pa.array((low + found[good, k]).astype(np.int32)) for k in (1, 2))], ["key", "iid", "score", "n_matched", "start_word", "end_word"])

    return score


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(key, item_key, score, n_matched, start_word, end_word): the best alignment of an item in each document that reaches the threshold.

    The score is the alignment's share of the item's full score; words are
    lower-cased A-Z runs without blanks; the span is in words of the document.
    A pair shows once; repeated rows, and rows or items with the same key, give the best one. Null or empty
    texts and items match nothing; null keys stay, and keys may have any type. Long texts are searched whole.
    An empty table gives no rows; other columns are left out.

    Seeds of the items are a table. A first pass counts them in the corpus, a second one
    finds the rarer ones in it, as many as surely meet every alignment that reaches the threshold
    (see bounds); both only send on what passes a filter of bounded size. Found seeds are joined to
    items by hash, stretches with enough of them to their texts, and those to the items' words, and aligned.
    """
    return alone(docs.sparkSession, lambda: _contaminated(docs, benchmark, key, text, item_key, item_text, threshold))


def _contaminated(docs: DataFrame, benchmark: DataFrame, key: str, text: str, item_key: str, item_text: str, threshold: float) -> DataFrame:
    kind, item_kind = dict(docs.dtypes)[key], dict(benchmark.dtypes)[item_key]
    rows, items = with_uid(docs, key, text), with_uid(benchmark, item_key, item_text)
    known = settle(items.select("uid", "text").mapInArrow(_prepare(threshold), "iid long, words binary, n int, needed int, dropped int, slack int, single boolean"))
    all_seeds = settle(known.select("iid", "words", "single").mapInArrow(_seed_rows, "hash long, iid long, at int"))
    single = bool(known.agg(F.bool_or("single")).first()[0])
    counts = settle(rows.select("text").mapInArrow(_count(_filter(all_seeds), single), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).join(all_seeds.select("hash").distinct(), "hash", "left_semi"))
    # a word that starts seeds goes with the sum of their counts; an item's words are few
    totals = all_seeds.join(counts, "hash").groupBy("iid", "at").agg(F.sum("n").alias("total"))
    order = W.Window.partitionBy("iid").orderBy(F.desc("total"), F.desc("at"))
    asked = totals.withColumn("r", F.row_number().over(order)).join(known.select("iid", "n", "needed", "dropped", "slack"), "iid").where(F.col("r") > F.col("dropped"))
    chosen = settle(all_seeds.join(asked, ["iid", "at"]).select("hash", "iid", "at", "n", "needed", "slack"))
    hits = rows.select("uid", "text").mapInArrow(_find(_filter(chosen), single), "uid long, hash long, place int").join(chosen, "hash")
    lines = hits.select("uid", "iid", (F.col("place") - F.col("at")).alias("start"), "at", "n", "needed", "slack").repartition("uid", "iid").sortWithinPartitions("uid", "iid", "start", "at")
    windows = settle(lines.mapInArrow(_windows, "uid long, iid long, low int, high int"))
    asked_of = windows.groupBy("uid").agg(F.collect_list(F.struct("iid", "low", "high")).alias("w"))
    few = F.broadcast(asked_of) if windows.count() * 64 <= BROADCAST_BYTES else asked_of
    # stored, since a task with two Python steps has two Python workers, which stay with the executor
    passages = settle(rows.join(few, "uid").select("key", "text", "w").mapInArrow(_passages, f"key {kind}, iid long, low int, passage binary"))
    scored = passages.join(known.select("iid", "words"), "iid").select("key", "iid", "low", "passage", "words").mapInArrow(_score(threshold), f"key {kind}, iid long, score double, n_matched int, start_word int, end_word int")
    named = scored.join(items.select(F.col("uid").alias("iid"), F.col("key").alias("item")), "iid")
    best = named.groupBy("key", "item").agg(F.max(F.struct("score", "n_matched", (-F.col("start_word")).alias("s"), (-F.col("end_word")).alias("e"))).alias("b"))
    return best.select(F.col("key").alias(key), F.col("item").cast(item_kind).alias(item_key), "b.score", "b.n_matched", (-F.col("b.s")).alias("start_word"), (-F.col("b.e")).alias("end_word"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
