import hashlib
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest

from cipherlode.llm import suffix


def brute(texts, length):
    """Every window in a dictionary."""
    raws = [(t or "").encode() for t in texts]
    places = {}
    for k, raw in enumerate(raws):
        for i in range(len(raw) - length + 1):
            places.setdefault(hashlib.md5(raw[i : i + length]).digest(), []).append((k, i))
    cover = [np.zeros(len(r) + 1, np.int64) for r in raws]
    for found in places.values():
        if len(found) > 1:
            for k, i in found:
                cover[k][i] += 1
                if i + length < len(cover[k]):
                    cover[k][i + length] -= 1
    out = []
    for raw, c in zip(raws, cover, strict=True):
        gone = np.cumsum(c)[: len(raw)] > 0
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out.append((len(raw), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, rows, length, anchor, tmp):
    spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, uid int, h string").coalesce(3).write.mode("overwrite").parquet(tmp)
    df = spark.read.parquet(tmp)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = sorted((tuple(r) for r in suffix.dedup(df, length=length, anchor=anchor, with_text=False).collect()), key=repr)
    expected = sorted(((r[0], *b) for r, b in zip(rows, brute([t for _, t in rows], length), strict=True)), key=repr)
    assert got == expected
    return sum(b[2] for b in expected)


def test_collection_repeats():
    r = random.Random(4)
    strings = [np.array([r.randint(1, 3) for _ in range(r.randint(0, 30))], np.uint16) for _ in range(60)]
    windows = {}
    for s in strings:
        for i in range(len(s) - 4):
            windows[s[i : i + 5].tobytes()] = windows.get(s[i : i + 5].tobytes(), 0) + 1
    for s, twice in zip(strings, suffix.collection_repeats(strings, 5), strict=True):
        assert twice.tolist() == [i + 5 <= len(s) and windows[s[i : i + 5].tobytes()] > 1 for i in range(len(s))]


def test_no_collection():
    """A task may have no two pieces that share a symbol."""
    assert suffix.collection_repeats([], 5) == []


def pieces(n, kind, seed=5):
    """Sorted pieces, a third of which are alone, and which are copies with an edit of one another else; 25 places around the core."""
    r, rows = np.random.default_rng(seed), []
    while len(rows) < n:
        line, core = r.integers(97, 123, 48).astype(kind), int(r.integers(-(2**63), 2**63 - 1))
        for _ in range(r.integers(1, 7)):
            text = line.copy()
            text[r.integers(0, 48)] = r.integers(97, 123)
            a, z = r.integers(0, 25), r.integers(24, 49)
            rows.append((core, len(rows) // 3, int(r.integers(0, 1000)), text[a:24].tobytes(), text[24:z].tobytes()))
    rows.sort(key=lambda x: x[0])
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["core", "uid", "start", "l", "r"])


def starts(rows, kind):
    """(uid, start) of every string of 25 places that a piece of the same core has too, by a dictionary."""
    places, width = {}, np.dtype(kind).itemsize
    for core, uid, start, left, right in zip(*(c.to_pylist() for c in rows.columns), strict=True):
        n = len(left) // width
        for i in range(n + 1):
            if i + 25 <= n + 1 + len(right) // width:
                places.setdefault((core, left[i * width :], right[: (i + 24 - n) * width]), []).append((uid, start + i))
    return sorted(x for found in places.values() if len(found) > 1 for x in found)


@pytest.mark.parametrize("kind", [np.uint8, np.uint64])
@pytest.mark.parametrize("batch", [1, 7, 500])
def test_groups_in_any_batches(monkeypatch, kind, batch):
    """Groups that go over batches' ends, tasks with one group and with none of two pieces, and collections of a few strings."""
    monkeypatch.setattr(suffix, "COLLECTION", 40)
    rows = pieces(700, kind)
    for part in (rows, rows.slice(0, 1), rows.slice(0, 0), pieces(1, kind)):
        out = list(suffix._collect(30, 25, kind)(iter(part.to_batches(batch))))
        assert sorted((u, i) for b in out for u, a, z in zip(*(c.to_pylist() for c in b.columns), strict=True) for i in range(a, z - 29)) == starts(part, kind)


@pytest.mark.parametrize("kind", [np.uint8, np.uint64])
def test_collections_take_little_time(kind):
    """Columns of many strings at once: at most a few times the CPU time of a dictionary of all their strings."""
    rows = pieces(12_000, kind)
    cpu = []
    for work in (lambda: starts(rows, kind), lambda: list(suffix._collect(30, 25, kind)(iter(rows.to_batches(10_000))))):
        took = []
        for _ in range(3):
            began = time.process_time()
            work()
            took.append(time.process_time() - began)
        cpu.append(min(took))
    assert cpu[1] < 4 * cpu[0]


def test_anchors_do_not_depend_on_segments_or_neighbours(monkeypatch):
    r = random.Random(3)
    texts = ["".join(r.choice("abc") for _ in range(r.choice((0, 10, 59, 60, 61, 300, 900)))) for _ in range(40)]
    find = lambda rows: [x for b in suffix._find(60, 20, suffix._bytes)(iter([pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows]), pa.array([t for _, t in rows])], ["uid", "text"])])) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    whole = find(list(enumerate(texts)))
    assert [x for k, t in enumerate(texts) for x in find([(k, t)])] == whole and len(whole) > 100
    monkeypatch.setattr(suffix, "SEGMENT", 70)
    assert find(list(enumerate(texts))) == whole


def test_no_rows_are_sorted_to_be_counted(spark, sf_dir, monkeypatch):
    """Anchors are counted by hash: what is kept of equal ones are numbers, which Spark can aggregate in place."""
    plans = []
    settle = suffix.settle
    monkeypatch.setattr(suffix, "settle", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or settle(df))
    suffix.op2_suffix_dedup(spark, sf_dir).count()
    assert len(plans) >= 6 and "HashAggregate" in "".join(plans) and "SortAggregate" not in "".join(plans)


def test_table(spark, sf_dir, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert check(spark, rows, suffix.LENGTH, suffix.ANCHOR, f"file://{tmp_path}/d") > 100


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    out = suffix.op2_suffix_dedup(spark, sf_dir).collect()
    assert {r.doc_id for r in out} == set(texts)
    for r in out:
        assert r.n_chars == len(r.text) and (r.text == texts[r.doc_id]) == (r.n_removed == 0)


@pytest.mark.parametrize(("big", "then"), [(4096, (5, 1)), (3, (5, 1)), (3, (1,))])
def test_planted(spark, tmp_path, monkeypatch, big, then):
    monkeypatch.setattr(suffix, "BIG", big)
    monkeypatch.setattr(suffix.repeats, "__defaults__", (suffix.BLOCK, then))
    monkeypatch.setattr(suffix, "COLLECTION", 40)
    monkeypatch.setattr(suffix, "SEGMENT", 700)
    r = random.Random(big)
    word = lambda n: "".join(r.choice("abcdefgh é") for _ in range(n))
    shared = [word(n) for n in (59, 60, 61, 80, 130, 200, 400)]
    rows = [(i, "".join(r.choice(shared) if r.random() < 0.4 else word(r.randint(1, 70)) for _ in range(r.randint(1, 9)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "ab" * 900), (203, "x" * 3000), (204, rows[0][1]), (204, rows[0][1]), (None, rows[1][1])]
    edited = list(shared[6] * 2)
    for i in range(30):
        edited[r.randrange(len(edited))] = r.choice("xyz")
        rows.append((300 + i, "".join(edited)))
    assert check(spark, rows, 60, 20, f"file://{tmp_path}/d") > 50


def test_empty_and_kept_text(spark, empty, tmp_path):
    assert suffix.dedup(empty).count() == 0
    spark.createDataFrame([(1, "é" * 100 + "q" * 50), (2, "x" + "é" * 100)], "doc_id long, text string").write.parquet(f"file://{tmp_path}/k")
    got = {r.doc_id: r for r in suffix.dedup(spark.read.parquet(f"file://{tmp_path}/k"), length=60, anchor=20).collect()}
    assert got[1].kept == "q" * 50 and got[2].kept == "x" and got[1].n_removed == 200


def brute_passages(texts, n, length):
    """What is left without strings of length bytes and passages of n words that start anywhere else too; a word takes the blanks after it along."""
    raws, words = [(t or "").encode() for t in texts], [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    gone = [np.zeros(len(r), bool) for r in raws]
    places = {}
    for k, raw in enumerate(raws):
        start = [m.start() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)] + [len(raw)]
        for i in range(len(words[k]) - n + 1):
            places.setdefault(tuple(words[k][i : i + n]), []).append((k, start[i], start[i + n]))
        for i in range(len(raw) - length + 1):
            places.setdefault(raw[i : i + length], []).append((k, i, i + length))
    for found in places.values():
        for k, a, z in found if len(found) > 1 else []:
            gone[k][a:z] = True
    return [np.frombuffer(r, np.uint8)[~g].tobytes().decode("utf-8", "ignore") for r, g in zip(raws, gone, strict=True)]


@pytest.mark.parametrize(("big", "then"), [(4096, (5, 1)), (3, (5, 1)), (3, (1,))])
def test_passages_of_words(spark, tmp_path, monkeypatch, big, then):
    """Passages of over 50 words that are shorter than 400 bytes, longer ones, and strings of 400 bytes that are a few words."""
    monkeypatch.setattr(suffix, "BIG", big)
    monkeypatch.setattr(suffix.repeats, "__defaults__", (suffix.BLOCK, then))
    monkeypatch.setattr(suffix, "COLLECTION", 40)
    monkeypatch.setattr(suffix, "SEGMENT", 700)
    r = random.Random(big)
    say = lambda n: r.choice((" ", "\n", "  ")).join(r.choice(("a", "to", "élan", "The", "the", "of")) for _ in range(n))
    shared = [say(n) for n in (49, 50, 51, 52, 60, 90, 200)] + ["é" * 260, "it " * 70]
    rows = [(i, " ".join(r.choice(shared) if r.random() < 0.4 else say(r.randint(1, 70)) for _ in range(r.randint(1, 6)))) for i in range(80)]
    edited = shared[6].split()
    for i in range(20):
        edited[r.randrange(len(edited))] = r.choice(("x", "y", "THE"))
        rows.append((100 + i, "\t".join(edited)))
    rows += [(200, None), (201, ""), (202, " \n"), (203, shared[2] + " \n"), (204, f" {shared[2]}"), (205, say(51)), (206, "é" * 150 + say(40)), (207, rows[0][1])]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(3).write.parquet(f"file://{tmp_path}/p")
    got = {x.doc_id: x.kept for x in suffix.dedup(spark.read.parquet(f"file://{tmp_path}/p"), passage=suffix.PASSAGE).collect()}
    expected = {i: t for (i, _), t in zip(rows, brute_passages([t for _, t in rows], 51, 400), strict=True)}
    assert got == expected and 50 < sum(t != (texts or "") for (_, texts), t in zip(rows, expected.values(), strict=True)) < len(rows)


def test_query_beside_passages(spark, tmp_path):
    """A passage of over 50 words, of under 400 bytes or with other blanks, goes from the last columns; those of the contract stay with strings of bytes."""
    r = random.Random(9)
    say = lambda n, blank=" ": blank.join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(n))
    short, long, bytes_only = say(55), say(90), "é" * 260
    rows = [(1, f"{say(30)} {short} {say(30)}"), (2, f"{say(9)} {short}"), (3, f"{long} {say(20)}"), (4, f"{say(20)}\n{long.replace(' ', '  ')}"), (5, f"{say(60)} {bytes_only}"), (6, f"{bytes_only} {say(60)}"), (7, say(200)), (8, None), (9, f"{say(8)} {say(50)}")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(2).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in suffix.op2_suffix_dedup(spark, f"file://{tmp_path}").collect()}
    texts = [t for _, t in rows]
    for (i, _), contract, left in zip(rows, brute(texts, 400), brute_passages(texts, 51, 400), strict=True):
        x = got[i]
        assert (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) == contract and hashlib.sha256(x.text.encode()).hexdigest() == contract[3]
        assert x.n_chars == len(x.text) and x.passage_free_text == left and x.passage_free_chars == len(left)
    assert [got[i].n_removed > 0 for i in range(1, 10)] == [False] * 4 + [True] * 2 + [False] * 3
    assert [got[i].passage_free_chars < got[i].n_chars for i in range(1, 10)] == [True] * 4 + [False] * 5
