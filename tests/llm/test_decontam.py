import random
import re

import numpy as np
import pyarrow as pa

from cipherlode.llm import decontam


def plain_score(a, b):
    """Smith-Waterman over words, cell by cell."""
    last, best = [0] * (len(b) + 1), 0
    for x in a:
        now = [0]
        for j, y in enumerate(b, 1):
            now.append(max(0, last[j - 1] + (decontam.MATCH if x == y else decontam.MISMATCH), last[j] + decontam.GAP, now[-1] + decontam.GAP))
        best, last = max(best, *now), now
    return best


def test_alignment_against_cells():
    r = random.Random(3)
    pairs = [([r.randrange(6) for _ in range(r.randint(1, 12))], [r.randrange(6) for _ in range(r.randint(1, 30))]) for _ in range(40)]
    got = decontam.aligned([(np.array(a, np.uint64), np.array(b, np.uint64)) for a, b in pairs])
    for (a, b), (score, start, end) in zip(pairs, got.tolist(), strict=True):
        assert score == plain_score(a, b)
        assert plain_score(a, b[start:end]) == score


def test_planted_passages(spark, tmp_path):
    r = random.Random(5)
    word = lambda: f"w{r.randrange(400)}"
    items = [(i, " ".join(word() for _ in range(30))) for i in range(12)]
    docs, planted = [], set()
    for d in range(60):
        body = [word() for _ in range(120)]
        if d % 3 == 0:
            text = items[d % 12][1].upper().split()
            for _ in range(4):  # edited copies
                text[r.randrange(len(text))] = word()
            body[50:50] = text
            planted.add((d, d % 12))
        docs.append((d, " ".join(body)))
    docs += [(100, None), (101, ""), (None, items[3][1]), (102, items[3][1]), (102, items[3][1]), (103, ("z " * 20_000) + items[4][1])]
    planted |= {(None, 3), (102, 3), (103, 4)}
    df = spark.createDataFrame([(*x, "s", 1) for x in docs], "doc_id long, text string, key string, item int")
    bench = spark.createDataFrame([*items, (50, None), (51, " ")], "item_id long, text string")
    rows = decontam.contaminated(df, bench).collect()
    assert {(x.doc_id, x.item_id) for x in rows} == planted and len(rows) == len(planted)
    expected = {}
    for d, text in docs:
        for i, item in items:
            a, b = (re.findall(r"\S+", (t or "").lower()) for t in (item, text))
            if (d, i) in planted and len(b) < 500:
                expected[d, i] = plain_score(a, b) / (decontam.MATCH * len(a))
    assert all(abs(x.score - expected[x.doc_id, x.item_id]) < 1e-9 for x in rows if (x.doc_id, x.item_id) in expected)
    assert decontam.contaminated(df.where("false"), bench).count() == 0
    assert decontam.contaminated(df, bench.where("false")).count() == 0


def test_every_copy_that_reaches_the_threshold(spark):
    """Replaced, left-out and inserted words and partial copies, each against plain alignment of every pair."""
    r = random.Random(11)
    new = lambda: f"n{r.randrange(10**6)}"
    items = [[f"w{r.randrange(900)}" for _ in range(n)] for n in (1, 2, 3, 5, 8, 13, 20, 20, 31)] + [["z"] * 6]
    copies = []
    for item in items:
        n = len(item)
        for every in (3, 4, 5):
            copies += [[new() if k % every == every - 1 else w for k, w in enumerate(item)], [w for k, w in enumerate(item) if k % every], [x for k, w in enumerate(item) for x in ([w, new()] if k % every == 0 else [w])]]
        copies += [item[: -(-n * share // 20)] for share in (10, 11, 12)] + [item[-(-n * 9 // 20) :], [x for w in item for x in (w, new())]]
        for share in (0.2, 0.25, 0.33):
            copies += [[new() if r.random() < share else w for w in item] for _ in range(4)]
    docs = [[new() for _ in range(40)] + copy + [f"w{r.randrange(900)}" for _ in range(40)] for copy in copies]
    expected = {}
    for d, text in enumerate(docs):
        for i, item in enumerate(items):
            share = plain_score(item, text) / (decontam.MATCH * len(item))
            if share >= decontam.THRESHOLD:
                expected[d, i] = share
    rows = decontam.contaminated(spark.createDataFrame([(d, " ".join(x)) for d, x in enumerate(docs)], "doc_id long, text string"), spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id): x.score for x in rows} == expected
    assert all(any(d // (len(copies) // len(items)) == i and (d, i) in expected for d in range(len(docs))) for i in range(len(items)))


def test_keys_of_any_type(spark):
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([("a", f"x y {text} z"), (None, text), ("b", "nothing of it")], "doc_id string, text string")
    bench = spark.createDataFrame([(None, text), ("t", "other words than those"), ("u", "\t\n")], "item_id string, text string")
    assert {(r.doc_id, r.item_id, r.score) for r in decontam.contaminated(docs, bench).collect()} == {("a", None, 1.0), (None, None, 1.0)}


def test_a_whole_table_against_every_alignment(spark, sf_dir):
    """Recall is 1: every pair of the smallest tables that plain alignment finds is found."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    split = lambda t: [hash(w) & (2**63 - 1) for w in re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())]
    texts, asked = {d: split(t) for d, t in docs}, {i: split(t) for i, t in items}
    expected = set()
    for i, item in asked.items():
        known = set(item)
        for d, text in texts.items():
            if 2 * sum(w in known for w in text) >= len(item) * decontam.MATCH * decontam.THRESHOLD:
                (score,) = decontam.align([(np.array(item, np.uint64), np.array(text, np.uint64))])[0].tolist()
                if score >= decontam.MATCH * len(item) * decontam.THRESHOLD:
                    expected.add((d, i))
    assert {(r.doc_id, r.item_id) for r in decontam.op9_decontamination(spark, sf_dir).collect()} == expected and expected


def test_seeds_without_a_stretch():
    """Too few seeds for an alignment, over batches that end inside a group."""
    columns = ["uid", "iid", "start", "at", "n", "needed", "slack"]
    rows = [[1, 1, k, 0, 9, 2, 3] for k in (0, 9)] + [[2, 1, 5, 1, 9, 2, 3], [2, 1, 6, 4, 9, 2, 3]]
    batches = [pa.RecordBatch.from_pylist([dict(zip(columns, r, strict=True)) for r in part], pa.schema([(c, pa.int64()) for c in columns])) for part in (rows[:1], rows[1:3], rows[3:])]
    assert [tuple(r.values()) for b in decontam._windows(iter(batches)) for r in b.to_pylist()] == [(2, 1, 2, 18)]
    assert sum(b.num_rows for b in decontam._windows(iter(batches[:2]))) == 0
