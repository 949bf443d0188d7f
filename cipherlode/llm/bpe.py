"""Byte-level BPE: segment trees over byte positions hold the leftmost minimum pair rank."""

from __future__ import annotations

import base64
import functools
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherlode.llm.text import chunks, only

#: Pieces that a worker remembers before the older half goes; it only saves time. A task's end drops all.
REMEMBERED = 240_000
#: No pair. Above every rank.
NONE = np.int32(2**31 - 1)
#: Elements of one group of trees that are worked on together.
GROUP = 1 << 19
#: Bytes of text that are taken apart at a time.
CHUNK = 1 << 21


def joined(items: pa.LargeBinaryArray, ends: np.ndarray, cut: int) -> list[memoryview]:
    """The bytes of each run of items, less the last cut ones."""
    _, offsets, data = items.buffers()
    if data is None:
        return [memoryview(b"")] * (len(ends) - 1)
    at = np.frombuffer(offsets, np.int64)[ends].tolist()
    return [memoryview(data)[a : max(a, z - cut)] for a, z in zip(at, at[1:], strict=False)]


class Vocabulary:
    """Ranks of a .tiktoken file, the pairs that merge, and the bytes of each id."""

    def __init__(self, file: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, file.splitlines()))}
        bytes_of = {i: t for t, i in self.ranks.items()}
        self.tokens = pa.array([bytes_of.get(i, b"") for i in range(max(bytes_of) + 1)], pa.large_binary())
        self.digits = pa.array([f"{i}," for i in range(len(self.tokens))], pa.large_binary())
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        keys, merged = array("q"), array("i")
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    merged.append(rank)
        order = np.argsort(np.array(keys))
        self.keys, self.merged = np.array(keys)[order], np.array(merged, np.int32)[order]
        self.known: dict[str, bytes] = {}  # a piece's ids, four bytes each
        self.former: dict[str, bytes] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, NONE where the two don't merge."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], NONE)

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of pieces of like length: one tree a piece, all trees take a step together.

        A leaf holds the rank of the pair that starts at its position. The root is
        the lowest rank; going down to the left child where it equals the root finds
        the leftmost. A merge then updates three leaves: the merged symbol's, its
        former neighbour's and its predecessor's.
        """
        m, longest = len(pieces), max(map(len, pieces))
        width = 1 << max(1, (longest - 1).bit_length())
        sizes = np.array([len(p) for p in pieces])
        flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(m, width)
        sym = np.concatenate((self.single[flat], np.zeros((m, 1), np.int32)), axis=1)
        after = np.tile(np.arange(1, width + 2, dtype=np.int32), (m, 1))
        before = after - 2
        live = np.arange(width) < sizes[:, None]
        tree = np.full((m, 2 * width), NONE, np.int32)
        leaf = tree[:, width:]
        for k in range(longest - 1):
            leaf[:, k] = np.where(k + 1 < sizes, self.rank(sym[:, k], sym[:, k + 1]), NONE)
        for k in range(width - 1, 0, -1):
            tree[:, k] = np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1])
        rows = np.flatnonzero(tree[:, 1] != NONE)
        while len(rows):
            lowest = tree[rows, 1]
            at = np.ones(len(rows), np.int64)
            while at[0] < width:
                at = 2 * at + (tree[rows, 2 * at] != lowest)
            i = at - width
            j = after[rows, i]
            nxt, prev = after[rows, j], before[rows, i]
            sym[rows, i], after[rows, i], live[rows, j] = lowest, nxt, False
            has_next, has_prev = nxt < sizes[rows], prev >= 0
            before[rows[has_next], nxt[has_next]] = i[has_next]
            leaf[rows, j] = NONE
            leaf[rows, i] = np.where(has_next, self.rank(lowest, sym[rows, np.where(has_next, nxt, 0)]), NONE)
            left = np.where(has_prev, prev, i)
            leaf[rows[has_prev], prev[has_prev]] = self.rank(sym[rows, left], lowest)[has_prev]
            spots = np.stack((i, j, left)) + width
            while spots[0, 0] > 1:
                spots >>= 1
                tree[rows, spots] = np.minimum(tree[rows, 2 * spots], tree[rows, 2 * spots + 1])
            rows = rows[tree[rows, 1] != NONE]
        ids = np.split(sym[:, :width][live], np.cumsum(live.sum(axis=1))[:-1])
        return [x.tolist() for x in ids]

    def encode(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, list[memoryview], list[memoryview]]:
        """Of texts, given as pieces: how many ids each has, all ids, and for each text its ids as decimals with commas and the bytes that they decode to."""
        self.recall(set().union(*texts))
        known = self.known
        packed = [b"".join([known[p] for p in pieces]) for pieces in texts]
        sizes = np.array([len(x) // 4 for x in packed], np.int64)
        ids, ends = np.frombuffer(b"".join(packed), np.int32), np.concatenate(([0], np.cumsum(sizes)))
        return sizes, ids, *(joined(table.take(pa.array(ids)), ends, cut) for table, cut in ((self.digits, 1), (self.tokens, 0)))

    def recall(self, pieces: set[str]) -> None:
        """Have all these pieces among the known; what was not asked for since the last turn but one is forgotten."""
        if len(self.known) + len(pieces) > REMEMBERED:
            self.former, self.known = self.known, {}
        missing = pieces - self.known.keys()
        again = missing & self.former.keys()
        self.known.update((p, self.former[p]) for p in again)
        self.learn(missing - again)

    def forget(self) -> None:
        self.known, self.former = {}, {}

    def learn(self, pieces: set[str]) -> None:
        """Remember the ids of these pieces."""
        done: dict[str, list[int]] = {}
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces:
            raw = p.encode("utf-8", "surrogatepass")
            if raw in self.ranks:
                done[p] = [self.ranks[raw]]
            else:
                by_width.setdefault((len(raw) - 1).bit_length(), []).append((p, raw))
        for bits, group in by_width.items():
            step = max(1, GROUP >> (bits + 1))
            for k in range(0, len(group), step):
                part = group[k : k + step]
                done.update(zip([p for p, _ in part], self.merge([raw for _, raw in part]), strict=True))
        self.known.update((p, array("i", ids).tobytes()) for p, ids in done.items())


@functools.lru_cache(1)
def _vocabulary(file: bytes) -> Vocabulary:
    return Vocabulary(file)


def tokens(df: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256), and with_ids also ids (array<int>) and decoded (the text again).

    vocabulary: path of a .tiktoken file, read once on the driver (its size is the
    vocabulary's, whatever the corpus). Each match of pattern is encoded alone; a
    match that is a token itself is that token. A null or empty text has no tokens,
    repeated rows and null keys give a row each, an empty table none; other columns
    are left out. A text of any length is one row's work; no shuffle.
    """
    with open(vocabulary, "rb") as f:
        file = f.read()
    extra = ", ids array<int>, decoded string" if with_ids else ""
    kind = dict(df.dtypes)[key]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("bpe", _vocabulary.cache_clear)
        voc, split = _vocabulary(file), regex.compile(pattern)
        for batch in batches:
            for first, texts in chunks(batch.column(1), CHUNK):
                found = [split.findall(t.decode("utf-8", "replace")) for t in texts]
                sizes, ids, digits, back = voc.encode(found)
                sha = [pa.array([hashlib.sha256(x).hexdigest() for x in column], pa.string()) for column in (digits, back)]
                columns = [batch.column(0).slice(first, len(texts)), pa.array(sizes), *sha]
                if with_ids:
                    columns += [pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(ids)), pa.array([str(x, "utf-8", "replace") for x in back], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["key", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: 4 + 2 * with_ids])
        voc.forget()

    out = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(encode, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}")
    return out.withColumnRenamed("key", key)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)
