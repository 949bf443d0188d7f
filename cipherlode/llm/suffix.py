"""Suffix-array dedup: repeated strings of bytes, or of words, by column-wise construction of collection suffix arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherlode.llm.text import alone, chunks, mix, only, powers, prefix_hash, settle, span_hash, with_uid, word_starts, words

#: Bytes of a string that counts when it occurs twice; bytes of the anchor that each such string holds.
LENGTH, ANCHOR = 400, 100
#: Words of a passage that counts when it occurs twice: over 50. Its anchors are a quarter as long.
PASSAGE = 51
#: Places of an anchor in a string that go into one collection: what such strings have in common is one symbol there.
BLOCK = 25
#: Strings of a collection, about; a group of more than BIG is cut again, so that its strings share a longer symbol.
COLLECTION, BIG = 2000, 4096
#: Places of the pieces of such groups; at one place a string is one symbol.
FINER = (5, 1)
#: Strings that are worked on together when anchors are chosen, so that a core's cache holds them; a place takes 20 bits.
SEGMENT = 1 << 14
#: Bytes of text that are hashed at once, so that a core's cache holds them.
HASHED = 1 << 17
#: Rows of texts that go back to Spark at once.
ROWS = 1000
#: Texts to symbols: those of all texts, and how many each has.
Symbols = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]


def _bytes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of all texts, how many each has), a symbol being a byte."""
    return np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts], np.int64)


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The same, a symbol being the hash of a word as written."""
    found = words(texts, lower=False)
    return found.hashes, np.diff(found.first)


def collection_repeats(strings: list[np.ndarray], length: int) -> list[np.ndarray]:
    """For each string (unsigned symbols), which of its suffixes share their first length symbols with another suffix."""
    size = np.array([len(s) for s in strings], np.int64)
    return np.split(repeated(np.concatenate(strings), size, length), np.cumsum(size)[:-1]) if strings else []


def repeated(flat: np.ndarray, size: np.ndarray, length: int) -> np.ndarray:
    """The same for strings of these sizes, one after another in flat.

    The collection's suffixes are sorted column by column: a round puts one more symbol
    in front of every string. With the Burrows-Wheeler transform so far (the symbol before each
    sorted suffix), a stable sort by that symbol is the next order. Each round is a sequential
    pass from one set of arrays to the next; a string's end, 0 here, is unlike any other's. Common
    prefixes are counted once all suffixes stand in order, between neighbours, up to length.
    """
    symbol = np.arange(len(flat)) + np.repeat(np.arange(len(size)), size) + 1
    data = np.zeros(len(flat) + len(size) + 1, np.uint16 if int(flat.max(initial=0)) < (1 << 16) - 1 else np.uint32)
    data[symbol] = flat.astype(data.dtype) + data.dtype.type(1)
    ends = (np.cumsum(size) + np.arange(len(size)) + 1).astype(np.int32)
    suffixes = ends
    for _ in range(int(size.max(initial=0))):
        before = data[suffixes - 1]
        at = np.flatnonzero(before)
        suffixes = np.concatenate((ends, suffixes[at[np.argsort(before[at], kind="stable")]] - np.int32(1)))
    suffixes = suffixes[len(ends) :]
    same = np.arange(max(len(suffixes) - 1, 0))
    left, right = suffixes[:-1], suffixes[1:]
    for _ in range(length):
        here = data[left]
        go = np.flatnonzero((here == data[right]) & (here != 0))
        same, left, right = same[go], left[go] + np.int32(1), right[go] + np.int32(1)
    flags = np.zeros(len(data), bool)
    flags[suffixes[same]] = flags[suffixes[same + 1]] = True
    return flags[symbol]


def anchors(prefix: np.ndarray, size: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first, last) for texts of these sizes, one after another: strings that start at first..last, all of one text, have their lowest-hashed gram, the leftmost of equals, at place."""
    w, n = length - anchor + 1, int(size.sum()) - length + 1
    starts = np.maximum(size - length + 1, 0)
    within = np.repeat(np.tile([True, False], len(size)), np.stack((starts, size - starts), 1).ravel())
    out = []
    for a in range(0, n, SEGMENT):
        z = min(a + SEGMENT, n)
        grams = z + w - 1
        hashes = mix((prefix[a + anchor : grams + anchor] - prefix[a:grams]) * powers(len(prefix))[1][a:grams] + np.uint64(anchor))
        key = (hashes >> np.uint64(20)) << np.uint64(20) | np.arange(len(hashes), dtype=np.uint64)
        padded = np.full(-(-len(key) // w) * w, np.uint64(2**64 - 1))
        padded[: len(key)] = key
        blocks = padded.reshape(-1, w)
        upto, after = np.minimum.accumulate(blocks, axis=1).ravel(), np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        best = (np.minimum(after[: z - a], upto[w - 1 : w - 1 + z - a]) & np.uint64(0xFFFFF)).astype(np.int64)
        best[~within[a:z]] = -1
        lead = np.flatnonzero(np.diff(best, prepend=-1))
        last = np.append(lead[1:], z - a) - 1
        mine = best[lead] >= 0
        lead, last = lead[mine], last[mine]
        out.append((hashes[best[lead]], a + best[lead], a + lead, a + last))
    h, place, first, last = (np.concatenate(c) for c in zip(*out, strict=True))
    lead = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (first[1:] != last[:-1] + 1)))
    return h[lead], place[lead], first[lead], last[np.append(lead[1:], len(last)) - 1]


def _find(length: int, anchor: int, symbols: Symbols):
    """(h, f, uid, place, first, last) of every anchor; f is the hash of all symbols of its strings."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("suffix")
        for batch in batches:
            uids = np.asarray(batch.column(0))
            for first_row, texts in chunks(batch.column(1), HASHED):
                data, size = symbols(texts)
                rows = np.flatnonzero(size >= length)
                if not len(rows):
                    continue
                data, size = data[np.repeat(size >= length, size)], size[rows]
                prefix = prefix_hash(data)
                h, place, first, last = anchors(prefix, size, length, anchor)
                f = mix(span_hash(prefix, first, last + length) + (place - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                end = np.cumsum(size)
                k = np.searchsorted(end, first, "right")
                base = (end - size)[k]
                yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(f.astype(np.int64)), pa.array(uids[first_row + rows[k]]), *(pa.array((x - base).astype(np.int32)) for x in (place, first, last))], ["h", "f", "uid", "place", "first", "last"])

    return find


def _cut(length: int, symbols: Symbols):
    """Pieces of anchors' strings: for each block of places, the common part's hash as key and the symbols to its left and right."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids, wanted, ends = np.asarray(batch.column(0)), batch.column(2).flatten(), np.cumsum(np.append(0, np.asarray(batch.column(2).value_lengths())))
            h, place, first, last = (np.asarray(wanted.field(k)).astype(np.int64) for k in range(4))
            for first_row, texts in chunks(batch.column(1), HASHED):
                data, size = symbols(texts)
                prefix, raw, width = prefix_hash(data), data.tobytes(), data.itemsize
                row = np.repeat(np.arange(len(texts)), np.diff(ends[first_row : first_row + len(texts) + 1]))
                mine = slice(ends[first_row], ends[first_row + len(texts)])
                lowest = (place[mine] - last[mine]) // BLOCK * BLOCK
                n = (place[mine] - first[mine] - lowest) // BLOCK + 1
                at = np.repeat(np.arange(len(n)), n)
                low = lowest[at] + BLOCK * (np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n))
                base = (np.cumsum(size) - size)[row[at]]
                h_at, place_at, first_at, last_at = h[mine][at], place[mine][at] + base, first[mine][at] + base, last[mine][at] + base
                a, z, start = place_at - low, place_at - low - BLOCK + 1 + length, np.maximum(first_at, place_at - low - BLOCK + 1)
                core = mix(span_hash(prefix, a, z) + h_at.astype(np.uint64) * (2 * low + 1).astype(np.uint64)).astype(np.int64)
                left = [raw[x:y] for x, y in zip((start * width).tolist(), (a * width).tolist(), strict=True)]
                right = [raw[x:y] for x, y in zip((z * width).tolist(), ((np.minimum(a, last_at) + length) * width).tolist(), strict=True)]
                for k in range(0, len(at), 20_000):
                    part = slice(k, k + 20_000)
                    yield pa.RecordBatch.from_arrays([pa.array(core[part]), pa.array(uids[first_row + row[at[part]]]), pa.array((start - base)[part].astype(np.int32)), pa.array(left[part], pa.binary()), pa.array(right[part], pa.binary())], ["core", "uid", "start", "l", "r"])

    return cut


def finer(pieces: DataFrame, block: int, places: int, width: int) -> DataFrame:
    """Pieces of block places cut again into pieces of fewer places: what the strings of one share joins its symbol. A symbol has width bytes."""
    left = F.col("a") * places
    right = F.lit(block - places) - left
    n = (F.octet_length("l") / width).cast("int")
    part = lambda c, a, z: F.substring(c, a * width + 1, F.greatest(z - a, F.lit(0)) * width)
    low = F.greatest(n - left - (places - 1), F.lit(0))
    core = F.xxhash64("core", "a", part(F.col("l"), n - left, n), part(F.col("r"), F.lit(0), right))
    cut = pieces.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(block // places - 1)))).where((n >= left) & (F.octet_length("r") >= right * width))
    return cut.select(core.alias("core"), "uid", (F.col("start") + low).cast("int").alias("start"), part(F.col("l"), low, n - left).alias("l"), part(F.col("r"), right, right + places - 1).alias("r"))


def repeats(pieces: DataFrame, length: int, kind: type[np.unsignedinteger], block: int = BLOCK, then: tuple[int, ...] = FINER) -> DataFrame:
    """(uid, a, z): spans of strings that two pieces hold, for stored pieces of block places."""
    if block == 1:
        twice = pieces.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core")
        return pieces.join(twice, "core").select("uid", F.col("start").alias("a"), (F.col("start") + length).cast("int").alias("z"))
    big = settle(pieces.groupBy("core").agg(F.count("*").alias("n")).where(F.col("n") > BIG).select("core"))
    found = pieces.join(big, "core", "left_anti").repartition("core").sortWithinPartitions("core").mapInArrow(_collect(length, block, kind), "uid long, a int, z int")
    if big.isEmpty():
        return found
    return found.union(repeats(settle(finer(pieces.join(big, "core", "left_semi"), block, then[0], np.dtype(kind).itemsize)), length, kind, then[0], then[1:]))


def _collect(length: int, block: int, kind: type[np.unsignedinteger]):
    """Pieces come by core: whole groups go into collections, and repeated strings come out as spans."""

    def side(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(symbols of a column of strings, how many each has)."""
        return np.frombuffer(b"".join(column.to_pylist()), kind), np.asarray(pc.binary_length(column)).astype(np.int64) // np.dtype(kind).itemsize

    def spans(pieces: pa.Table) -> pa.RecordBatch:
        core, uid, start = (np.asarray(pieces.column(k)) for k in range(3))
        (left, n_left), (right, n_right) = (side(pieces.column(k).combine_chunks()) for k in (3, 4))
        most = 256
        if kind != np.uint8:
            known, code = np.unique(np.concatenate((left, right)), return_inverse=True)
            left, right, most = code[: len(left)], code[len(left) :], len(known)
        size = n_left + 1 + n_right
        first = np.cumsum(size) - size
        flat = np.empty(int(size.sum()), np.uint32)
        flat[first + n_left] = most + np.cumsum(np.diff(core, prepend=core[:1]) != 0)
        flat[np.arange(len(left)) + np.repeat(first - (np.cumsum(n_left) - n_left), n_left)] = left
        flat[np.arange(len(right)) + np.repeat(first + n_left + 1 - (np.cumsum(n_right) - n_right), n_right)] = right
        at = np.flatnonzero(repeated(flat, size, block))
        owner = np.searchsorted(first, at, "right") - 1
        ahead = at - first[owner] <= n_left[owner]
        at, owner = at[ahead], owner[ahead]
        lead = np.flatnonzero((np.diff(at, prepend=-2) > 1) | (np.diff(owner, prepend=-1) != 0))
        last = np.append(lead[1:], len(at))[: len(lead)] - 1
        a, z = (start[owner[x]] + at[x] - first[owner[x]] for x in (lead, last))
        return pa.RecordBatch.from_arrays([pa.array(uid[owner[lead]], pa.int64()), pa.array(a.astype(np.int32)), pa.array((z + length).astype(np.int32))], ["uid", "a", "z"])

    def groups(pieces: pa.Table) -> np.ndarray:
        """Where the pieces of another core begin."""
        core = np.asarray(pieces.column(0))
        return np.append(0, np.flatnonzero(core[1:] != core[:-1]) + 1)

    def several(pieces: pa.Table) -> pa.Table:
        """Pieces of groups of at least two."""
        size = np.diff(np.append(groups(pieces), len(pieces)))
        return pieces.filter(pa.array(np.repeat(size > 1, size)))

    def collections(pieces: pa.Table) -> Iterator[pa.RecordBatch]:
        begin = groups(pieces)
        cut = begin[np.flatnonzero(np.diff(begin // COLLECTION, prepend=-1))]
        for a, z in zip(cut, [*cut[1:], len(pieces)], strict=True):
            yield spans(pieces.slice(a, z - a))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, open_group = [], 0, None
        for batch in (b for b in batches if b.num_rows):
            pieces = pa.Table.from_batches([batch])
            pieces = pa.concat_tables([open_group, pieces]) if open_group else pieces
            last = int(groups(pieces)[-1])
            open_group, whole = pieces.slice(last), pieces.slice(0, last)
            if last and len(whole := several(whole)):
                held.append(whole)
                n += len(whole)
            if n >= COLLECTION:
                yield from collections(pa.concat_tables(held))
                held, n = [], 0
        if open_group and len(open_group) > 1:
            held.append(open_group)
        if held:
            yield from collections(pa.concat_tables(held))

    return collect


def _lists(column: pa.ListArray) -> Iterator[list[tuple[int, int]]]:
    """The (a, z) of each row; none for null."""
    a, z = (k.to_pylist() for k in column.flatten().flatten())
    ends = np.cumsum(np.asarray(pc.list_value_length(column).fill_null(0))).tolist()
    return (list(zip(a[x:y], z[x:y], strict=True)) for x, y in zip([0, *ends], ends, strict=False))


def _without(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, runs removed); spans may overlap and come in any order."""
    if not spans:
        return raw, 0, 0
    kept, at, removed, n = [], 0, 0, 0
    for a, z in sorted(spans):
        if n == 0 or a > at:
            kept.append(raw[at:a])
            n += 1
            at = a
        if z > at:
            removed += z - at
            at = z
    kept.append(raw[at:])
    return b"".join(kept), removed, n


def _rest(with_text: bool, apart: bool):
    """Digests of what stays of each text, without spans of bytes, and of words if there are such; apart: the latter are cut from a second kept text alone. With a word goes the blank after it."""

    texts = with_text + (with_text and apart)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(k, ROWS) for whole in batches for k in range(0, whole.num_rows, ROWS)):
            out = []
            passages = _lists(batch.column(3)) if batch.num_columns > 3 else repeat([])
            for text, spans, passage in zip(batch.column(1).cast(pa.large_binary()).to_pylist(), _lists(batch.column(2)), passages):
                raw = text or b""
                every = spans
                if passage:
                    edge = word_starts(raw)
                    every = spans + [(edge[a], edge[z]) for a, z in passage]
                rest, removed, n = _without(raw, spans if apart else every)
                left = _without(raw, every)[0] if apart and passage else rest
                out.append((len(raw), removed, n, hashlib.sha256(rest).hexdigest(), *[x.decode("utf-8", "ignore") for x in (rest, left)[:texts]]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [()] * (4 + texts), kinds, strict=False))], ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "kept_apart"][: 5 + texts])

    return cut


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, anchor: int = ANCHOR, with_text: bool = True, passage: int = 0, apart: bool = False) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256[, kept]) for every row: texts without the bytes of any length-byte string that starts anywhere else too.

    With passage, the same goes for passages of so many words (BLOCK at least; runs other than blanks, as
    written), however long, whatever blanks are between them. Both are judged on the input. apart: the
    columns are of strings of bytes alone, and one more, kept_apart, is the text without both.
    Strings are bytes of the UTF-8 text as given; matches don't cross documents but may
    lie in the same one and overlap. Null texts are empty, short ones stay. A row
    that is there twice is two documents, so both lose what they share. Null
    keys are rows as others. kept drops what is left of a cut character. An empty
    table gives no rows; other columns are left out.

    1. Every string has one anchor, its lowest-hashed gram; equal strings have equal
       anchors. Consecutive strings share one, so that a text has few. Anchors
       whose strings all are equal are counted and done: copies are never sorted.
    2. The other repeated anchors' strings are cut into pieces by the anchor's place; the part that all
       strings of a piece share is a symbol (its hash). Pieces with equal
       symbols are collections, sorted column by column; common prefixes of
       the suffix array show the repeated strings. A symbol that very many pieces
       have is one of fewer places for them, so that no collection is large.

    Strings, anchors and symbols are equal where their 64-bit hashes are.
    """
    kind = dict(docs.dtypes)[key]
    rows = with_uid(docs, key, text)
    spans = alone(docs.sparkSession, lambda: _spans(rows.select("uid", "text"), length, anchor, _bytes, np.uint8))
    if passage:
        more = alone(docs.sparkSession, lambda: _spans(rows.select("uid", "text"), passage, max(1, passage // 4), _words, np.uint64))
        spans = spans.join(more.withColumnRenamed("spans", "passages"), "uid", "full")
    out = rows.join(spans, "uid", "left").select("key", "text", "spans", *["passages"] * bool(passage)).mapInArrow(_rest(with_text, apart), f"key {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * with_text + ", kept_apart string" * (with_text and apart))
    return out.withColumnRenamed("key", key)


def _spans(texts: DataFrame, length: int, anchor: int, symbols: Symbols, kind: type[np.unsignedinteger]) -> DataFrame:
    """(uid, spans) of texts that share strings of length symbols."""
    found = settle(texts.mapInArrow(_find(length, anchor, symbols), "h long, f long, uid long, place int, first int, last int"))
    # one occurrence of each: equal strings lie alike around their anchor
    same = found.groupBy("h", "f").agg(F.count("*").alias("c"), F.min("uid").alias("uid"), F.min_by("place", "uid").alias("place"), F.min(F.col("place") - F.col("first")).alias("before"), F.max(F.col("last") - F.col("place")).alias("after"))
    kinds = found.groupBy("h").agg(F.count("*").alias("n"), (F.min("f") < F.max("f")).alias("several")).where("n > 1").select("h", "several")
    many = settle(same.join(kinds, "h"))
    whole = found.join(many.where("c > 1").select("h", "f"), ["h", "f"]).select("uid", F.col("first").alias("a"), (F.col("last") + length).alias("z"))

    wanted = many.where("several").select("uid", F.struct("h", "place", (F.col("place") - F.col("before")).alias("first"), (F.col("place") + F.col("after")).alias("last")).alias("w")).groupBy("uid").agg(F.collect_list("w").alias("w"))
    pieces = settle(texts.join(wanted, "uid").select("uid", "text", "w").mapInArrow(_cut(length, symbols), "core long, uid long, start int, l binary, r binary"))
    return whole.union(repeats(pieces, length, kind)).groupBy("uid").agg(F.collect_list(F.struct("a", "z")).alias("spans"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, then what is left of each text and its characters, and the same without passages of over 50 words too."""
    out = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), passage=PASSAGE, apart=True).withColumnsRenamed({"kept": "text", "kept_apart": "passage_free_text"})
    return out.withColumns({"n_chars": F.length("text").cast("long"), "passage_free_chars": F.length("passage_free_text").cast("long")})
