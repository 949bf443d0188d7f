import random
import re
from collections import defaultdict

import pytest

from cipherlode.llm import jaccard

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    by = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by[x].append(i)
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, s in enumerate(sets):
        for j in {j for x in s for j in by[x] if j > i}:
            both = len(s & sets[j])
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                top[find(j)] = find(i)
    low = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            low[find(i)] = min(k, low.get(find(i), k))
    return sorted(((k, len(s), low.get(find(i))) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def check(spark, rows, tmp):
    spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, uid int, n string").coalesce(3).write.mode("overwrite").parquet(tmp)
    df = spark.read.parquet(tmp)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = sorted((tuple(r) for r in jaccard.clusters(df).collect()), key=repr)
    expected = brute(rows)
    assert got == expected
    return len({c for _, _, c in expected})


def test_table(spark, sf_dir, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text").collect()]
    assert check(spark, rows, f"file://{tmp_path}/d") < len(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_of_edits(spark, tmp_path, monkeypatch, seed):
    """Documents a few edits apart: many lie near the threshold, and regions hold more than one component."""
    monkeypatch.setattr(jaccard, "PIVOTS", 2)
    monkeypatch.setattr(jaccard, "PART", 5)
    monkeypatch.setattr(jaccard, "HELD", 500)
    r = random.Random(seed)
    rows = []
    for g in range(12):
        base = [f"w{r.randrange(60)}" for _ in range(r.choice((3, 8, 40, 90)))]
        for _ in range(14):
            text = list(r.choice(rows[-5:])[1].split() if rows and r.random() < 0.5 else base)
            for _ in range(r.randrange(5)):
                text[r.randrange(len(text))] = f"z{r.randrange(40)}"
            rows.append((len(rows), " ".join(text[: r.randint(len(text) * 3 // 4, len(text))]) + r.choice(("", " ", " Tail", "\n"))))
    passage = " ".join(f"p{i}" for i in range(30))
    rows += [(500 + i, f"{passage} " + " ".join(f"u{i}x{j}" for j in range(60))) for i in range(20)]
    rows += [(None, rows[0][1]), (None, "only here"), (900, None), (901, ""), (902, " \t"), (903, "A b"), (904, "a B "), (3, rows[3][1]), (3, rows[3][1]), (905, None)]
    check(spark, rows, f"file://{tmp_path}/d")


def test_row_numbers_in_any_order(spark):
    """Stored parts of unlike sizes are read largest first, several by one task, so that row numbers don't ascend in a batch."""
    r = random.Random(5)
    rows = []
    for _ in range(300):
        base = [f"w{r.randrange(300)}" for _ in range(r.choice((3, 8, 40, 90, 300, 1500)))]
        for _ in range(r.choice((1, 1, 2, 3, 5))):
            text = list(base)
            for _ in range(r.randrange(4)):
                text[r.randrange(len(text))] = f"z{r.randrange(40)}"
            rows.append((len(rows), " ".join(text)))
    r.shuffle(rows)
    got = jaccard.clusters(spark.createDataFrame(rows, "doc_id long, text string").repartition(40)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_empty(empty):
    assert jaccard.clusters(empty).count() == 0
