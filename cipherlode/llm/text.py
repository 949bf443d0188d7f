"""Small helpers that the operators share: row ids, shared tables, and words of a batch as numpy arrays."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherlode.store import alone, new_path, settle, shared_dir  # noqa: F401

#: Bytes of text that one numpy step works on, so that a task's memory does not follow its input.
CHUNK_BYTES = 1 << 21
#: The same where a step makes several numbers of each byte.
WORDS_BYTES = 1 << 19
_MULT = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(7).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MARK = np.zeros(256, bool)
_MARK[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def lean_workers(spark: SparkSession) -> None:
    """Python workers that give large arrays back to the system as soon as they are freed; a worker lives through many tasks."""
    spark.sparkContext.environment.update({"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_MMAP_THRESHOLD_": "1048576", "MALLOC_TRIM_THRESHOLD_": "16777216", "MALLOC_ARENA_MAX": "2"})


_owner: list[tuple[str, Callable[[], None]]] = []


def only(owner: str, clear: Callable[[], None] | None = None) -> None:
    """One operator's caches at a time: a worker that goes on to another operator drops what the last one kept."""
    if _owner and _owner[0][0] != owner:
        _owner.pop()[1]()
        gc.collect()
    if clear and not _owner:
        _owner.append((owner, clear))


def stored_by(df: DataFrame, key: str, buckets: int) -> tuple[DataFrame, str]:
    """df in the shared folder as a table bucketed by key, so that joins with it don't shuffle it; also its name, to be dropped when done."""
    spark, name = df.sparkSession, f"kept_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).option("path", new_path(spark, "kept")).saveAsTable(name)
    return spark.table(name), name


def with_uid(df: DataFrame, key: str, text: str) -> DataFrame:
    """(uid, key, text) in the shared folder: row numbers are given once, since another scan, on other cores, may split the table elsewhere.

    Extra columns are left out, so their names cannot clash.
    """
    return settle(df.select(F.col(key).alias("key"), F.col(text).alias("text")).select(F.monotonically_increasing_id().alias("uid"), "key", "text"), "zstd")


def mix(h: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the multiplier and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((int(_MULT), pow(int(_MULT), -1, 2**64))):
            table = np.full(max(n, 1 << 16), base, np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0][:n], _powers[1][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash of bytes, or of words by their own hashes: entry i covers data[:i]."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_BYTE[data] if data.dtype == np.uint8 else data) * powers(len(data))[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end] from prefix_hash(data)."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix))[1][start] + (end - start).astype(np.uint64))


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts as bytes) of slices of a column; a null text is empty. A text over the limit has a slice of its own. One slice at a time is copied out of the column."""
    raw = column.cast(pa.large_binary())
    texts = lambda a, z: [t or b"" for t in raw.slice(a, z - a).to_pylist()]
    first, size = 0, 0
    for i, n in enumerate(pc.binary_length(raw).fill_null(0).to_pylist()):
        if i > first and size + n > limit:
            yield first, texts(first, i)
            first, size = i, 0
        size += n
    if first < len(raw):
        yield first, texts(first, len(raw))


class Words(NamedTuple):
    """Words of some texts; those of text i are hashes[first[i]:first[i + 1]]."""

    data: np.ndarray  # all texts, A-Z lower-cased if asked, each ended by a line feed
    start: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    first: np.ndarray


def words(texts: list[bytes], trim: int = 0, lower: bool = True) -> Words:
    """Runs of bytes other than blanks (0x20, 0x09-0x0D), less up to trim marks of ASCII punctuation at each end."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    data = _LOWER[data] if lower else data
    blank = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank))))
    start, end = edge[::2], edge[1::2]
    bounds = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    first = np.searchsorted(start, bounds)
    for _ in range(trim):
        start = start + (_MARK[data[start]] & (end - start > 1))
        end = end - (_MARK[data[end - 1]] & (end - start > 1))
    return Words(data, start, end, span_hash(prefix_hash(data), start, end), first)


def word_starts(text: bytes) -> list[int]:
    """Where words() has its words begin, then the text's length."""
    word = ~_SPACE[np.frombuffer(text, np.uint8)]
    word[1:] &= ~word[:-1]
    return [*np.flatnonzero(word).tolist(), len(text)]


def shingles(found: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): of every run of width words; a text with fewer words has one shingle, all of them, and one without words none."""
    n = len(found.hashes)
    count = np.diff(found.first)
    total = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    first = np.concatenate(([0], np.cumsum(total)))
    at = np.arange(first[-1]) - np.repeat(first[:-1], total) + np.repeat(found.first[:-1], total)
    size = np.repeat(np.minimum(count, width), total)
    out = size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for j in range(width):
        here = j < size
        out[here] = mix(out[here] + found.hashes[np.minimum(at + j, n - 1)[here]] * np.uint64(2 * j + 3))
    return out, first
