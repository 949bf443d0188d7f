"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from cipherlode.llm.text import Words, chunks, mix, words

#: The labelled sample: so many rows of each label, those whose key hashes lowest, with texts up to TRAIN_BYTES.
TRAIN_ROWS, TRAIN_BYTES = {1: 1500, 0: 3000}, 12_000
#: Words in a window, and from one window's start to the next: windows overlap.
WINDOW, STRIDE = 32, 24
#: Sizes: hidden state of a direction, word and character inputs, the vocabulary, the table of character trigrams.
HIDDEN, WORD, CHAR, VOCABULARY, TRIGRAMS = 8, 6, 6, 4096, 1 << 12
#: Training texts that a word of the vocabulary is in, at least; standard deviations off chance from which a word's label counts.
SEEN, CHANCE = 3, 2.0
BATCH, STEPS, RATE, DECAY = 128, 240, 0.01, 0.02
#: Share of words without their own vector and characters in a step, so that few texts aren't learned by heart; first steps that take the window with the most telling word.
DROPPED, GUIDED = 0.5, 60
#: Training takes as many texts of either label; logits are lowered by this, since toxic ones are fewer.
CAUTION = np.float32(0.5)
#: Windows that go through the network together.
GROUP = 1 << 14


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Inputs:
    """Distinct words of some texts, what each is made of, and the texts' windows."""

    def __init__(self, texts: list[bytes]):
        found: Words = words(texts, trim=3)
        self.hash, at, self.of = np.unique(found.hashes, return_index=True, return_inverse=True)
        start, size = found.start[at], (found.end - found.start)[at]
        offset = np.cumsum(size) - size
        place = np.arange(size.sum()) - np.repeat(offset, size)
        spot = place + np.repeat(start, size)
        code = found.data[spot].astype(np.uint64)  # three bytes around each, a blank at the word's edges
        left = np.where(place > 0, found.data[spot - 1], 32).astype(np.uint64)
        right = np.where(place < np.repeat(size, size) - 1, found.data[np.minimum(spot + 1, len(found.data) - 1)], 32).astype(np.uint64)
        self.char = (mix(left << np.uint64(16) | code << np.uint64(8) | right) >> np.uint64(52)).astype(np.int64)
        self.offset, self.size = offset, size
        self.data, self.begin, self.finish = found.data, found.start, found.end
        self.text_of = np.repeat(np.arange(len(texts)), np.diff(found.first))
        count = np.diff(found.first)
        windows = np.where(count > 0, 1 + np.maximum(0, -(-(count - WINDOW) // STRIDE)), 0)
        self.doc = np.repeat(np.arange(len(texts)), windows)
        nth = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        self.start = found.first[self.doc] + np.minimum(nth * STRIDE, np.maximum(0, count[self.doc] - WINDOW))
        self.length = np.minimum(count[self.doc], WINDOW)

    def window(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word numbers, real): WINDOW rows, a column for each window."""
        step = np.arange(WINDOW)[:, None]
        real = step < self.length[which]
        return np.where(real, self.of[np.where(real, self.start[which] + step, 0)], 0), real


class Network:
    """Parameters, and what goes forward and back through them. Arrays have a column for each window.

    A word's inputs are a trained vector (one for all words outside the vocabulary), how far
    it is from chance in the training texts of either label, and the mean
    vector of its character trigrams.
    """

    def __init__(self, weights: dict[str, np.ndarray] | None = None):
        r = np.random.default_rng(5)
        near = lambda *s: (r.normal(size=s) / np.sqrt(s[-1])).astype(np.float32)
        self.w = weights or {
            "word": near(VOCABULARY + 1, WORD) / 2, "char": near(TRIGRAMS, CHAR), "in": near(6 * HIDDEN, WORD + 1 + CHAR), "bias": np.zeros((6 * HIDDEN, 1), np.float32),
            "f": near(3 * HIDDEN, HIDDEN), "b": near(3 * HIDDEN, HIDDEN), "look": near(2 * HIDDEN), "out": near(2 * HIDDEN), "base": np.full(1, -1, np.float32),
            "known": np.zeros(0, np.uint64), "chance": np.zeros(0, np.float32),
        }

    def look_up(self, texts: list[bytes], labels: np.ndarray) -> None:
        """The vocabulary of the training texts, and each word's distance from chance."""
        x = Inputs(texts)
        pairs = np.unique(np.stack((x.of, x.text_of)), axis=1)
        n, bad = np.bincount(pairs[0], minlength=len(x.hash)), np.bincount(pairs[0], labels[pairs[1]], len(x.hash))
        keep = np.sort(np.argsort(-n, kind="stable")[:VOCABULARY])
        keep = keep[n[keep] >= SEEN]
        expected = n[keep] * labels.mean()
        z = (bad[keep] - expected) / np.sqrt(expected + 1)
        self.w["known"], self.w["chance"] = x.hash[keep], (np.sign(z) * np.log1p(np.maximum(0, np.abs(z) - CHANCE))).astype(np.float32)

    def number(self, x: Inputs) -> np.ndarray:
        """Vocabulary numbers of distinct words, from 1; 0 for others."""
        known = self.w["known"]
        if not len(known):
            return np.zeros(len(x.hash), np.int64)
        at = np.minimum(np.searchsorted(known, x.hash), len(known) - 1)
        return np.where(known[at] == x.hash, at + 1, 0)

    def embed(self, x: Inputs, kept: np.ndarray | None = None) -> np.ndarray:
        """Word inputs: a row for each distinct word; with kept, only those have a vector and characters."""
        if not len(x.hash):
            return np.zeros((1, WORD + 1 + CHAR), np.float32)
        chars = np.add.reduceat(self.w["char"][x.char], x.offset) / x.size[:, None]
        number = self.number(x)
        chance = np.concatenate((np.zeros(1, np.float32), self.w["chance"]))[number]
        own = self.w["word"][number]
        if kept is not None:
            own, chars = own * kept[:, None], chars * kept[:, None]
        return np.concatenate((own, chance[:, None], chars), axis=1).astype(np.float32)

    def chances(self, x: Inputs) -> np.ndarray:
        """The most telling word of every window."""
        of = np.concatenate((np.zeros(1, np.float32), self.w["chance"]))[self.number(x)]
        at, real = x.window(np.arange(len(x.doc)))
        return np.where(real, of[at], -np.inf).max(axis=0)

    def project(self, inputs: np.ndarray) -> np.ndarray:
        return self.w["in"] @ inputs.T + self.w["bias"]

    def run(self, table: np.ndarray, at: np.ndarray, real: np.ndarray, keep: bool = False) -> tuple:
        """Logit of each window; with keep, also what the way back needs."""
        n, h = at.shape[1], HIDDEN
        states, saved = np.empty((WINDOW, 2 * h, n), np.float32), {}
        for way, rows, steps in (("f", slice(0, 3 * h), range(WINDOW)), ("b", slice(3 * h, 6 * h), range(WINDOW - 1, -1, -1))):
            s, u, part = np.zeros((h, n), np.float32), self.w[way], np.ascontiguousarray(table[rows])
            for t in steps:
                x, g = part.take(at[t], axis=1), u @ s
                zr = 1 / (1 + np.exp(-(x[: 2 * h] + g[: 2 * h])))
                z, r = zr[:h], zr[h:]
                c = np.tanh(x[2 * h :] + r * g[2 * h :])
                new = c + z * (s - c)
                if not real[t].all():
                    new = np.where(real[t], new, s)
                if keep:
                    saved[way, t] = s, g, z, r, c
                states[t, slice(0, h) if way == "f" else slice(h, 2 * h)] = s = new
        score = np.where(real, np.einsum("thn,h->tn", states, self.w["look"]), np.float32(-1e9))
        weight = np.exp(score - score.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,thn->hn", weight, states)
        logit = self.w["out"] @ pooled + self.w["base"]
        return (logit, states, saved, weight, pooled) if keep else (logit,)

    def gradients(self, x: Inputs, which: np.ndarray, label: np.ndarray, kept: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy of these windows, with the vectors of kept words only."""
        inputs = self.embed(x, kept)
        at, real = x.window(which)
        logit, states, saved, weight, pooled = self.run(self.project(inputs), at, real, keep=True)
        h = HIDDEN
        d_logit = ((_sigmoid(logit) - label) / len(label)).astype(np.float32)
        g = {"out": pooled @ d_logit, "base": np.array([d_logit.sum()])}
        d_pooled = self.w["out"][:, None] * d_logit
        d_weight = np.einsum("hn,thn->tn", d_pooled, states)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["look"] = np.einsum("tn,thn->h", d_score, states)
        d_states = weight[:, None] * d_pooled + d_score[:, None] * self.w["look"][:, None]
        d_in, d_inputs = np.zeros_like(self.w["in"]), np.zeros_like(inputs)
        g["bias"] = np.zeros_like(self.w["bias"])
        for way, rows, mine, steps in (("f", slice(0, 3 * h), slice(0, h), range(WINDOW - 1, -1, -1)), ("b", slice(3 * h, 6 * h), slice(h, 2 * h), range(WINDOW))):
            u, d_u, d = self.w[way], np.zeros_like(self.w[way]), np.zeros((h, len(label)), np.float32)
            for t in steps:
                d = d + d_states[t, mine]
                s, gates, z, r, c = saved[way, t]
                live = real[t]
                pre_c = np.where(live, d * (1 - z) * (1 - c * c), 0)
                pre_z = np.where(live, d * (s - c) * z * (1 - z), 0)
                pre_r = pre_c * gates[2 * h :] * r * (1 - r)
                d_x = np.concatenate((pre_z, pre_r, pre_c))
                d_g = np.concatenate((pre_z, pre_r, pre_c * r))
                d_u += d_g @ s.T
                d = np.where(live, d * z, d) + u.T @ d_g
                d_in[rows] += d_x @ inputs[at[t]]
                g["bias"][rows] += d_x.sum(axis=1, keepdims=True)
                np.add.at(d_inputs, at[t], (self.w["in"][rows].T @ d_x).T)
            g[way] = d_u
        g["in"] = d_in
        d_inputs *= np.concatenate((np.repeat(kept[:, None], WORD, 1), np.ones((len(kept), 1)), np.repeat(kept[:, None], CHAR, 1)), axis=1)
        g["word"], g["char"] = np.zeros_like(self.w["word"]), np.zeros_like(self.w["char"])
        np.add.at(g["word"], self.number(x), d_inputs[:, :WORD])
        np.add.at(g["char"], x.char, np.repeat(d_inputs[:, WORD + 1 :] / x.size[:, None], x.size, axis=0))
        return g

    def logits(self, x: Inputs) -> np.ndarray:
        """Of every window, in groups."""
        table = self.project(self.embed(x))
        groups = [np.arange(k, min(k + GROUP, len(x.doc))) for k in range(0, len(x.doc), GROUP)]
        return np.concatenate([self.run(table, *x.window(g))[0] for g in groups] or [np.zeros(0, np.float32)])


def train(texts: list[bytes], labels: list[int]) -> Network:
    """A text is as toxic as its worst window: each step looks for the batch's worst windows and learns from those (Adam)."""
    net, r = Network(), np.random.default_rng(11)
    y = np.array(labels)
    some = np.array([bool(t.strip()) for t in texts], bool)
    sides = [np.flatnonzero((y == k) & some) for k in (0, 1)]
    if not all(map(len, sides)):
        return net
    net.look_up(texts, y)
    trained = [k for k in net.w if k not in ("known", "chance")]
    first, second = ({k: np.zeros_like(net.w[k]) for k in trained} for _ in range(2))
    for step in range(1, STEPS + 1):
        picked = np.concatenate([r.choice(s, BATCH // 2) for s in sides])
        x = Inputs([texts[i] for i in picked])
        order = np.lexsort((-(net.chances(x) if step <= GUIDED else net.logits(x)), x.doc))
        worst = order[np.concatenate(([True], np.diff(x.doc[order]) != 0))]
        spans = [(x.begin[s], x.finish[s + n - 1]) for s, n in zip(x.start[worst], x.length[worst], strict=True)]
        x = Inputs([x.data[a:z].tobytes() for a, z in spans])
        grads = net.gradients(x, np.arange(len(worst)), y[picked], (r.random(len(x.hash)) >= DROPPED).astype(np.float32))
        rate = RATE * min(1, 2 * (1 - step / (STEPS + 1)))
        for k in trained:
            first[k] = 0.9 * first[k] + 0.1 * grads[k]
            second[k] = 0.99 * second[k] + 0.01 * grads[k] ** 2
            move = (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
            net.w[k] = (net.w[k] - rate * (move + DECAY * net.w[k] * (k not in ("base", "bias")))).astype(np.float32)
    net.w["base"] -= CAUTION
    return net


def fit(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Network:
    """Trained on the bounded sample of labelled rows described above; of documents that share a key, the first text. Without rows of both labels, untrained."""
    spark = docs.sparkSession
    known = labels.where(learn & F.col(label).isin(*TRAIN_ROWS) & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).distinct()
    ranked = known.withColumn("r", F.row_number().over(W.Window.partitionBy("label").orderBy(F.xxhash64("key"), "key")))
    chosen = ranked.where(F.col("r") <= F.when(F.col("label") == 1, TRAIN_ROWS[1]).otherwise(TRAIN_ROWS[0])).select("key", "label").collect()
    few = spark.createDataFrame([tuple(r) for r in chosen], f"key {dict(known.dtypes)['key']}, label int")  # TRAIN_ROWS at most
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.octet_length("text") <= TRAIN_BYTES).join(F.broadcast(few), "key")
    found = sorted(map(tuple, rows.groupBy("key", "label").agg(F.min("text").alias("text")).select("key", "text", "label").collect()))
    return train([t.encode("utf-8") for _, t, _ in found], [y for _, _, y in found])


def score(docs: DataFrame, net: Network, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, predicted) for every row: the probability of its worst window, and whether that is 0.5 or more.

    A null or empty text, or one of blanks, has no window and scores 0. A window of a
    shorter text is that text. Texts of any length are scored whole, window by
    window. Repeated rows and null keys give a row each, an empty table none; other
    columns are left out. A projection of the scan; the network has a fixed size.
    """
    weights, kind = net.w, dict(docs.dtypes)[key]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(weights)
        for batch in batches:
            for first, texts in chunks(batch.column(1)):
                x = Inputs(texts)
                top = np.full(len(texts), -np.inf)
                np.maximum.at(top, x.doc, net.logits(x))
                p = np.where(np.isfinite(top), _sigmoid(np.where(np.isfinite(top), top, 0)), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["key", "score", "predicted"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(judge, f"key {kind}, score double, predicted int").withColumnRenamed("key", key)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    net = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out)
    return score(docs, net).withColumn("held_out", F.coalesce(held_out, F.lit(False)))
