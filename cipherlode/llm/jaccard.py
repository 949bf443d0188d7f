"""N-gram Jaccard join in the metric space of shingle sets: pivots, regions, triangle-inequality windows, recursion."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from cipherlode.llm.graph import components
from cipherlode.llm.text import WORDS_BYTES, alone, chunks, mix, only, settle, shingles, stored_by, with_uid, words

#: Words of a shingle; percent of the union that linked sets share.
WIDTH, PERCENT = 5, 75
#: Elements beyond a set's shortest sure prefix that are looked up, so that as many more must be shared: percent of a
#: small set, up to a number, and percent of any set.
EXTRA_SMALL, EXTRA_MOST, EXTRA = 35, 90, 10
#: Bytes of text for one bucket of shingle hashes; hashes that a task holds before it sends them.
BUCKET_BYTES, HELD = 16 << 20, 1 << 20
#: Bytes of looked-up elements for one bucket when sets meet.
LOOK_BYTES = 8 << 20
#: The place of a shingle that several documents of one batch hold.
SEVERAL = 0xFFFF
#: Documents in one part of a region; new pivots of a region in a round, and elements that they hold, about.
PART, PIVOTS, PIVOT_ELEMENTS = 4096, 4096, 1 << 22
SLACK = 1e-9


def sure(n: Column | np.ndarray | int, percent: int) -> Column | np.ndarray | int:
    """The least number of a set's n elements that a linked set holds."""
    ceil = F.ceil if isinstance(n, Column) else np.ceil
    return ceil(n * percent / 100)


def extra(n: int) -> int:
    return max(n * EXTRA // 100, min(n * EXTRA_SMALL // 100, EXTRA_MOST))


def prefix_size(n: int, percent: int) -> int:
    """Elements, lowest hashes first, that are looked up."""
    return min(n, n - int(np.ceil(n * percent / 100)) + 1 + extra(n))


def shared_at_least(n: np.ndarray, percent: int) -> np.ndarray:
    """How many looked-up elements a set shares with any that it links to, at least, less one: extra() of the smallest such set."""
    low = sure(n, percent).astype(np.int64)
    return np.maximum(low * EXTRA // 100, np.minimum(low * EXTRA_SMALL // 100, EXTRA_MOST))


def pack(hashes: np.ndarray) -> bytes:
    """Sorted hashes by their upper 48 bits, six bytes each."""
    return (hashes >> np.uint64(16)).astype(np.uint32).tobytes() + (hashes >> np.uint64(48)).astype(np.uint16).tobytes()


def unpack(blob: bytes) -> np.ndarray:
    n = len(blob) // 6
    return np.frombuffer(blob, np.uint16, n, 4 * n).astype(np.uint64) << np.uint64(32) | np.frombuffer(blob, np.uint32, n)


def _steps(sorted_codes: np.ndarray) -> bytes:
    """Ascending numbers as differences, four bytes each where they fit, after a byte that says which."""
    steps = np.diff(sorted_codes, prepend=np.uint64(0))
    wide = len(steps) > 0 and int(steps.max()) >= 1 << 32
    return (b"\1" if wide else b"\0") + steps.astype(np.uint64 if wide else np.uint32).tobytes()


def _unstep(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(blob, np.uint64 if blob[:1] == b"\1" else np.uint32, offset=1).astype(np.uint64), dtype=np.uint64)


def _inspect(n_buckets: int, width: int, percent: int):
    """Sends each document's size and fingerprint, and its looked-up hashes by bucket; a hash that several documents of a batch hold goes once."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("jaccard")
        for batch in batches:
            uids, start, sizes, prints, held = np.asarray(batch.column(0)), 0, [], [], []
            done = 0
            for first, texts in chunks(batch.column(2), WORDS_BYTES):
                hashes, at = shingles(words(texts), width)
                for a, z in zip(at, at[1:], strict=False):
                    own = np.unique(hashes[a:z])
                    mixed = mix(own)
                    sizes.append(len(own))
                    prints.append((int(mixed.sum().astype(np.int64)), int(np.bitwise_xor.reduce(mix(mixed)).astype(np.int64)) if len(own) else 0))
                    held.append(own[: prefix_size(len(own), percent)])
                done = first + len(texts)
                if done - start >= SEVERAL // 2 or sum(map(len, held)) > HELD:
                    yield from flush(batch, uids, start, done, sizes, prints, held)
                    start, sizes, prints, held = done, [], [], []
            if done > start:
                yield from flush(batch, uids, start, done, sizes, prints, held)

    def flush(batch: pa.RecordBatch, uids: np.ndarray, start: int, done: int, sizes: list, prints: list, held: list) -> Iterator[pa.RecordBatch]:
        n = done - start
        rank = np.argsort(np.argsort(uids[start:done]))  # _total has the batch by uid, while a task that reads several files need not
        place = np.repeat(rank, [len(h) for h in held])
        hashes = np.concatenate(held) >> np.uint64(16)
        order = np.argsort(hashes, kind="stable")
        hashes, place = hashes[order], place[order]
        lead = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1]))) if len(hashes) else np.zeros(0, np.int64)
        run = np.diff(np.append(lead, len(hashes)))
        several = np.repeat(run > 1, run)
        local = np.bincount(place[several], minlength=n)[rank]
        code, who = hashes[lead], np.where(run > 1, SEVERAL, place[lead]).astype(np.uint16)
        bucket = (code % np.uint64(n_buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[by], np.arange(n_buckets + 1))
        some = np.flatnonzero(np.diff(cuts))
        parts = [by[cuts[b] : cuts[b + 1]] for b in some]
        m, mine, none = len(some), uids[start:done], [None] * len(some)
        columns = [
            pa.concat_arrays([pa.array(mine % n_buckets), pa.array(some, pa.int64())]), pa.array(np.full(n + m, mine[0])), pa.concat_arrays([pa.array(mine), pa.nulls(m, pa.int64())]),
            pa.concat_arrays([batch.column(1).slice(start, n), pa.nulls(m, batch.column(1).type)]),
            pa.array([*sizes, *none], pa.int32()), pa.array([*(p[0] for p in prints), *none], pa.int64()), pa.array([*(p[1] for p in prints), *none], pa.int64()), pa.array([*local.tolist(), *none], pa.int64()),
            pa.array([*[None] * n, *(_steps(code[p]) for p in parts)], pa.binary()), pa.array([*[None] * n, *(who[p].tobytes() for p in parts)], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["bucket", "base", "uid", "key", "n", "f1", "f2", "shared", "codes", "who"])

    return send


def _shared(table: pa.Table) -> pa.Table:
    """Of one bucket: the documents' own rows, and for each batch that sent hashes here one row with how many of each document's another one has."""
    sent = table.filter(pc.is_valid(table.column("codes")))
    own = table.filter(pc.is_null(table.column("codes"))).drop_columns(["bucket", "codes"])
    if not len(sent):
        return own
    codes, who = [_unstep(b) for b in sent.column("codes").to_pylist()], [np.frombuffer(b, np.uint16) for b in sent.column("who").to_pylist()]
    cuts = np.cumsum([0, *map(len, codes)])
    code, place = np.concatenate(codes), np.concatenate(who).astype(np.int64)
    order = np.argsort(code, kind="stable")
    code = code[order]
    lead = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
    run = np.diff(np.append(lead, len(code)))
    hit = np.zeros(len(code), bool)
    hit[order] = np.repeat((run > 1) | np.maximum.reduceat(place[order] == SEVERAL, lead), run)
    hit &= place != SEVERAL  # those are counted where they were sent
    answers = []
    for a, z in zip(cuts, cuts[1:], strict=False):
        docs, n = np.unique(place[a:z][hit[a:z]], return_counts=True)
        answers.append(docs.astype(np.uint16).tobytes() + n.astype(np.uint32).tobytes())
    none = {c: pa.nulls(len(sent), own.schema.field(c).type) for c in ("uid", "key", "n", "f1", "f2", "shared")}
    return pa.concat_tables([own, pa.table({"base": sent.column("base"), **none, "who": pa.array(answers, pa.binary())}).select(own.schema.names).cast(own.schema)])


def _total(table: pa.Table) -> pa.Table:
    """Of one batch: its documents with the hashes that they share, over all buckets."""
    own = table.filter(pc.is_valid(table.column("uid"))).sort_by("uid")
    shared = own.column("shared").to_numpy().copy()
    for blob in table.filter(pc.is_null(table.column("uid"))).column("who").to_pylist():
        n = len(blob) // 6
        shared[np.frombuffer(blob, np.uint16, n)] += np.frombuffer(blob, np.uint32, n, 2 * n)
    return own.select(["uid", "key", "n", "f1", "f2"]).append_column("shared", pa.array(shared))


def _bands(n: np.ndarray, percent: int) -> np.ndarray:
    """Linked sets are in the same band or in neighbouring ones."""
    return np.floor(np.log(n) / math.log(100 / percent * 1.001)).astype(np.int64)


def _look_up(n_buckets: int, percent: int):
    """Sends each set's looked-up elements by bucket, with a table of the sets that have some there."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, SEVERAL // 2):
                yield part(batch.slice(k, SEVERAL // 2))

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        uids, ns, weights = (np.asarray(batch.column(c)).astype(np.int64) for c in (0, 1, 2))
        held = [unpack(b.as_py())[: prefix_size(n, percent)] for b, n in zip(batch.column(3), ns.tolist(), strict=True)]
        code, place = np.concatenate(held), np.repeat(np.arange(len(held)), [len(h) for h in held])
        bucket = (code % np.uint64(n_buckets)).astype(np.int64)
        order = np.lexsort((code, bucket))
        cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
        rows = []
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            at = order[cuts[b] : cuts[b + 1]]
            here, local = np.unique(place[at], return_inverse=True)
            rows.append((b, int(uids[0]), _steps(code[at]), local.astype(np.uint16).tobytes(), here.astype(np.uint16).tobytes(), uids[here].tobytes(), ns[here].tobytes(), weights[here].tobytes()))
        kinds = (pa.int64(), pa.int64(), *[pa.binary()] * 6)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["bucket", "base", "codes", "local", "here", "uids", "ns", "weights"])

    return send


def _point(percent: int):
    """Of one bucket: each element points to the most shared set of a band that has it, a pivot. Each batch gets (set, band, pivot, elements) of its own sets."""

    def point(table: pa.Table) -> pa.Table:
        get = lambda c, kind: [np.frombuffer(b, kind) for b in table.column(c).to_pylist()]
        codes, local, here, uids, ns, weights = [_unstep(b) for b in table.column("codes").to_pylist()], get("local", np.uint16), get("here", np.uint16), get("uids", np.int64), get("ns", np.int64), get("weights", np.int64)
        offset = np.cumsum([0, *(len(u) for u in uids)])
        uid, n, weight = np.concatenate(uids), np.concatenate(ns), np.concatenate(weights)
        rank = np.empty(len(uid), np.int64)
        by_rank = np.lexsort((uid, weight))
        rank[by_rank] = np.arange(len(uid))
        doc, code = np.concatenate([o + x for o, x in zip(offset, local, strict=False)]).astype(np.int64), np.concatenate(codes)
        band = _bands(n, percent)[doc]
        key = np.concatenate([code << np.uint64(8) | (band + t & 0xFF).astype(np.uint64) for t in (0, 1)])
        who = np.concatenate((doc * 2, doc * 2 + 1))
        order = np.lexsort((rank[who >> 1], key))
        key, who = key[order], who[order]
        end = np.flatnonzero(np.append(key[1:] != key[:-1], True))
        run = np.diff(np.concatenate(([-1], end)))
        keep = np.repeat(run > 1, run)
        both, count = np.unique(who[keep] * len(uid) + rank[np.repeat(who[end] >> 1, run)[keep]], return_counts=True)
        pair = np.stack(np.divmod(both, len(uid)))
        cuts = np.searchsorted(pair[0], 2 * offset)
        rows = []
        for k, base in enumerate(table.column("base").to_pylist()):
            part = slice(cuts[k], cuts[k + 1])
            mine = (pair[0, part] >> 1) - offset[k]
            rows.append((base, *(x.tobytes() for x in (uids[k][mine], ns[k][mine], (pair[0, part] & 1).astype(np.uint8), uid[by_rank[pair[1, part]]], count[part].astype(np.uint32)))))
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), *[pa.binary()] * 5), strict=True)], ["base", "uids", "ns", "bands", "pivots", "counts"])

    return point


def _choose(percent: int):
    """Of one batch: the pivots of each set and band, but for minor ones that even together can't be all that a link shares."""

    def choose(table: pa.Table) -> pa.Table:
        uid, n, band, pivot, count = (np.concatenate([np.frombuffer(b, kind) for b in table.column(c).to_pylist()]) for c, kind in (("uids", np.int64), ("ns", np.int64), ("bands", np.uint8), ("pivots", np.int64), ("counts", np.uint32)))
        order = np.lexsort((pivot, band, uid))
        uid, n, band, pivot, count = uid[order], n[order], band[order], pivot[order], count[order].astype(np.int64)
        if len(uid):
            lead = np.flatnonzero(np.concatenate(([True], (np.diff(uid) != 0) | (np.diff(band) != 0) | (np.diff(pivot) != 0))))
            uid, n, band, pivot, count = uid[lead], n[lead], band[lead], pivot[lead], np.add.reduceat(count, lead)
            order = np.lexsort((pivot, count, band, uid))
            uid, n, band, pivot, count = uid[order], n[order], band[order], pivot[order], count[order]
            total = np.cumsum(count)
            first = np.concatenate(([True], (np.diff(uid) != 0) | (np.diff(band) != 0)))
            start = np.flatnonzero(first)
            so_far = total - np.repeat((total - count)[start], np.diff(np.append(start, len(uid))))
            keep = so_far > shared_at_least(n, percent) // 2
            uid, pivot = np.unique(np.stack((uid[keep], pivot[keep])), axis=1)
        return pa.table({"pivot": pa.array(pivot, pa.int64()), "uid": pa.array(uid, pa.int64())})

    return choose


def _region_distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by region, its pivot first: the size of each set's intersection with its pivot's. One pivot is held, however large the region."""
    region, pivot = None, np.zeros(0, np.uint64)
    for batch in batches:
        out: list[tuple[int, int, int, int, int]] = []
        for p, first, uid, n, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = unpack(blob)
            if first == 0:
                region, pivot = p, own
            elif p == region:
                at = np.minimum(np.searchsorted(pivot, own), len(pivot) - 1)
                out.append((p, uid, len(pivot), n, int((pivot[at] == own).sum())))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 5, ["pivot", "uid", "n_pivot", "n", "both"])


def _with_pivots(members: DataFrame, pivots: DataFrame, sets: DataFrame, extra: list[str]) -> DataFrame:
    """Members and pivots of regions with their elements, dealt by (region, part), pivots first. Regions over PART sets are cut, each part with a copy of the pivots.

    One join with sets, which is stored by uid and stays where it is.
    """
    columns = ["region", "part", "first", "uid", *extra]
    sized = members.groupBy("region").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    rows = members.join(sized, "region").withColumn("part", part).withColumn("first", F.lit(1)).select(*columns).union(pivots.join(sized, "region").withColumn("part", each).withColumn("first", F.lit(0)).select(*columns))
    return rows.join(sets, "uid").repartition("region", "part").sortWithinPartitions("region", "part", "first")


def _distances(regions: DataFrame, sets: DataFrame) -> DataFrame:
    """(pivot, uid, n_pivot, n, both) for (region, uid), the region being its pivot."""
    pivots = regions.select("region").distinct().withColumn("uid", F.col("region"))
    dealt = _with_pivots(regions, pivots, sets, [])
    return settle(dealt.select("region", "first", "uid", "n", "elements").mapInArrow(_region_distances, "pivot long, uid long, n_pivot long, n long, both long"))


class _Pivots:
    """New pivots of a region, with their elements as one sorted list, so that a member meets all of them in one look-up."""

    def __init__(self, rows: list[tuple], sets: list[np.ndarray]):
        self.uid, self.n, self.both, self.d, self.c = (np.array(x) for x in zip(*rows, strict=True))
        elements, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(elements, kind="stable")
        self.elements, self.owner = elements[order], owner[order]

    def shared(self, own: np.ndarray) -> np.ndarray:
        """How many elements each pivot shares with a set."""
        low, high = (np.searchsorted(self.elements, own, side) for side in ("left", "right"))
        n = high - low
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        return np.bincount(self.owner[at], minlength=len(self.n))


    def join(self, found: np.ndarray, c: int) -> np.ndarray:
        """One of the found pivots for each component, as places in found; with component c, all these are one from here on. So a group of any size gives a link or so for each member."""
        parts, first = np.unique(self.c[found], return_index=True)
        if len(parts):
            self.c[np.isin(self.c, np.append(parts, c))] = min(int(parts[0]), c)
        return first


def _new_links(percent: int):
    """Rows come by region, its new pivots first: links between them and the members in the window of distances that the old pivot leaves. The pivots are held (PIVOT_ELEMENTS, about), members stream by."""
    window = 1 - percent / 100 + SLACK

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region, held, sets, pivots = None, [], [], None
        for batch in batches:
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for r, first, uid, n, both, d, c, blob in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if r != region:
                    region, held, sets, pivots = r, [], [], None
                if first == 0:
                    held.append((uid, n, both, d, c))
                    sets.append(unpack(blob))
                    continue
                pivots = pivots or _Pivots(held, sets)
                most = np.minimum(pivots.both, both) + np.minimum(pivots.n - pivots.both, n - both)  # what two sets can share: in the old pivot, and outside it
                near = (np.abs(pivots.d - d) <= window) & (most * (100 + percent) >= (pivots.n + n) * percent) & (pivots.c != c)
                if near.any():
                    shared = pivots.shared(unpack(blob))
                    found = np.flatnonzero(near & (shared * 100 >= (pivots.n + n - shared) * percent))
                    a.append(pivots.uid[found[pivots.join(found, c)]])
                    b.append(np.full(len(a[-1]), uid))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return find


def _recur(at: DataFrame, chosen: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of regions (region, uid, n, both, d, c) with some of their members, chosen, as new pivots."""
    members = at.join(chosen.select("region").distinct(), "region", "left_semi")
    dealt = _with_pivots(members, chosen, sets.drop("n"), ["n", "both", "d", "c"])
    return settle(dealt.select("region", "first", "uid", "n", "both", "d", "c", "elements").mapInArrow(_new_links(percent), "a long, b long"))


def _sets(width: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in chunks(batch.column(2), WORDS_BYTES):
                hashes, at = shingles(words(texts), width)
                own = [np.unique(hashes[a:z]) for a, z in zip(at, at[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([*(c.slice(first, len(texts)) for c in batch.columns[:2]), pa.array([len(o) for o in own], pa.int64()), pa.array([pack(o) for o in own], pa.binary())], ["uid", "weight", "n", "elements"])

    return make


def clusters(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id) for every row; component_id is the smallest key reachable by links.

    Sets of distinct width-word shingles (A-Z lower-cased) link when they share
    percent or more of their union: every such pair counts, none is missed or
    guessed (up to equal 64-bit hashes of shingles). A shorter text is one shingle, one
    without words has none and links with nothing, as a null text. Repeated rows are
    rows of their own, linked with each other; a null key counts for no component
    and has none when alone. An empty table gives no rows; other columns are
    left out.

    1. Each set looks up its lowest hashes. Any linked set shares a known number of
       them, so that a set with fewer shared hashes is done: it has no link.
    2. Equal sets are one from here on. Linked sets are of like size, so sets meet
       in two bands of sizes. There each shared hash points to the most shared
       set that holds it, a pivot. A set belongs to the pivots that most of its
       hashes point to, and is copied to further ones until what is left is too
       little for any link to be only there: regions with copied borders.
    3. Distances to the pivot give links. Where a region is not one component yet,
       documents outside the pivot's component become pivots of new regions: of those within
       the triangle inequality's window of distances to the old pivot. This recurs
       until every region is one component or all of its outsiders were pivots.
    """
    return alone(docs.sparkSession, lambda: _clusters(docs, key, text, width, percent))


def _clusters(docs: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    spark, kind = docs.sparkSession, dict(docs.dtypes)[key]
    rows = with_uid(docs, key, text)
    size = docs.agg(F.sum(F.octet_length(text) + 1)).first()[0] or 0
    n_buckets = max(1, -(-size // BUCKET_BYTES))
    sent = rows.mapInArrow(_inspect(n_buckets, width, percent), f"bucket long, base long, uid long, key {kind}, n int, f1 long, f2 long, shared long, codes binary, who binary")
    counted = sent.groupBy("bucket").applyInArrow(_shared, f"base long, uid long, key {kind}, n int, f1 long, f2 long, shared long, who binary")
    info = settle(counted.groupBy("base").applyInArrow(_total, f"uid long, key {kind}, n int, f1 long, f2 long, shared long"))

    low = F.ceil(F.col("n") * percent / 100)
    least = F.greatest(F.floor(low * EXTRA / 100), F.least(F.floor(low * EXTRA_SMALL / 100), F.lit(EXTRA_MOST)))
    able = info.where((F.col("n") > 0) & (F.col("shared") > least))
    classes = settle(able.groupBy("n", "f1", "f2").agg(F.min("uid").alias("uid"), F.max("shared").alias("weight"), F.min("key").alias("low")))
    # both sides dealt by uid as the stored sets are, so that each task writes one bucket
    chosen = classes.select("uid", "weight").repartition(n_buckets, "uid").join(rows.select("uid", "text").repartition(n_buckets, "uid"), "uid")
    whole, stored = stored_by(chosen.select("uid", "weight", "text").mapInArrow(_sets(width), "uid long, weight long, n long, elements binary"), "uid", n_buckets)
    sets = whole.select("uid", "n", "elements")

    total = classes.agg(F.sum("n")).first()[0] or 0
    n_look = max(1, -(-3 * total // LOOK_BYTES))
    pointed = whole.select("uid", "n", "weight", "elements").mapInArrow(_look_up(n_look, percent), "bucket long, base long, codes binary, local binary, here binary, uids binary, ns binary, weights binary")
    pointed = pointed.groupBy("bucket").applyInArrow(_point(percent), "base long, uids binary, ns binary, bands binary, pivots binary, counts binary")
    kept = settle(pointed.groupBy("base").applyInArrow(_choose(percent), "pivot long, uid long"))
    several = kept.groupBy("pivot").agg(F.count("*").alias("m")).where("m > 1").select("pivot")
    member = settle(kept.join(several, "pivot").select(F.col("pivot").alias("region"), "uid"))

    linked = F.col("both") * 100 >= (F.col("n_pivot") + F.col("n") - F.col("both")) * percent
    found = _distances(member, sets)
    near = found.withColumn("d", 1 - F.col("both") / (F.col("n_pivot") + F.col("n") - F.col("both"))).select(F.col("pivot").alias("region"), "uid", "d", "n", "both", (F.col("uid") == F.col("pivot")).alias("used"))
    near = settle(near)
    links = found.where(linked).select(F.col("pivot").alias("a"), F.col("uid").alias("b"))
    while True:
        parts = components(links)
        at = near.join(parts, near["uid"] == parts["node"], "left").select("region", "uid", "d", "n", "both", "used", F.coalesce("component", "uid").alias("c"))
        home = parts.select(F.col("node").alias("region"), F.col("component").alias("home"))
        at = at.join(home, "region", "left").withColumn("home", F.coalesce("home", "region"))
        outside = at.where((F.col("c") != F.col("home")) & ~F.col("used"))
        order = W.Window.partitionBy("region").orderBy(F.xxhash64("uid"), "uid")
        ranked = outside.withColumn("r", F.row_number().over(order)).where(F.col("r") <= PIVOTS)
        before = F.coalesce(F.sum("n").over(order.rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
        chosen = settle(ranked.withColumn("before", before).where(F.col("before") < PIVOT_ELEMENTS).select("region", "uid", "n", "both", "d", "c"))
        if chosen.isEmpty():
            break
        links = parts.select(F.col("node").alias("a"), F.col("component").alias("b")).union(_recur(at, chosen, sets, percent))
        was = chosen.select("region", "uid", F.lit(True).alias("now"))
        near = settle(near.join(was, ["region", "uid"], "left").select("region", "uid", "d", "n", "both", (F.col("used") | F.coalesce("now", F.lit(False))).alias("used")))

    spark.sql(f"DROP TABLE {stored}")
    of = classes.join(parts, classes["uid"] == parts["node"], "left").select("n", "f1", "f2", "low", F.coalesce("component", "uid").alias("c"))
    lows = of.groupBy("c").agg(F.min("low").alias("component_id"))
    mapped = of.join(lows, "c").select("n", "f1", "f2", "component_id")
    out = info.join(mapped, ["n", "f1", "f2"], "left").select("key", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "key")).otherwise(F.col("key")).alias("component_id"))
    return out.withColumnRenamed("key", key)


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(spark.read.parquet(f"{sf_dir}/documents.parquet"))
