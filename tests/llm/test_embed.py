import numpy as np

from cipherlode.llm import embed


def brute(rows, t=0.93):
    unit = []
    for k, v, label in rows:
        ok = k is not None and label is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)
        unit.append(np.ldexp(np.array(v, float), -np.frexp(np.abs(v).max())[1]) if ok and np.any(v) else None)
    n = len(rows)
    link = [[j for j in range(n) if i != j and unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and np.dot(unit[i], unit[j]) / (np.linalg.norm(unit[i]) * np.linalg.norm(unit[j])) >= t] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        c = min((rows[j][0] for j in seen), default=None) if rows[i][0] is not None else None
        out.append((rows[i][0], len(link[i]), c, c is not None and c == rows[i][0]))
    return sorted(out, key=repr)


def check(spark, rows, tmp, kind="float"):
    spark.createDataFrame([(*r, 1, 2, "x") for r in rows], f"vec_id long, embedding array<{kind}>, label int, uid int, cid int, key string").write.mode("overwrite").parquet(tmp)
    df = spark.read.parquet(tmp)
    rows = [tuple(r)[:3] for r in df.collect()]
    got = sorted(map(tuple, embed.near_duplicates(df).collect()), key=repr)
    assert got == brute(rows)


def test_against_brute_force(spark, sf_dir, tmp_path):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    check(spark, rows, f"file://{tmp_path}/e")


def test_odd_vectors(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(embed, "TILE", 7)
    monkeypatch.setattr(embed, "BLOCK", 100)
    r = np.random.default_rng(3)
    base = r.normal(size=(6, 8))
    rows = [(i, (base[i % 6] + r.normal(size=8) * 0.25 * (i % 3)).tolist(), i % 2) for i in range(90)]
    rows += [(100, None, 0), (101, [0.0] * 8, 0), (102, [float("nan")] + [1.0] * 7, 0), (103, [None] + [1.0] * 7, 0), (104, [float("inf")] * 8, 0), (105, rows[0][1], None), (106, [1.0, 0.0], 0), (107, [2.0, 0.0], 0), (None, rows[0][1], 0), (0, rows[0][1], 0), (0, rows[0][1], 0), (108, [], 0), (109, [3.0], 1), (110, [-3.0], 1)]
    rows += [(111, [1e-38, 2e-38], 1), (112, [1e-30, 2e-30], 1), (113, [1e38, 2e38], 1)]
    check(spark, rows, f"file://{tmp_path}/e")


def test_tiny_and_huge_doubles(spark):
    rows = [(1, [1e-200, 2e-200], 0), (2, [1e200, 2e200], 0), (3, [2e-308, 1e-320], 0), (4, [1e308, 1e-308], 0)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3)}


def test_pairs_at_the_threshold(spark, tmp_path):
    r = np.random.default_rng(5)
    rows = []
    for k in range(1500):  # in doubles these lie at 0.93 or a rounding beside it, some above and some below
        x, y = np.linalg.qr(r.normal(size=(12, 2)))[0].T
        rows += [(2 * k, x.tolist(), k % 3), (2 * k + 1, (0.93 * x + np.sqrt(1 - 0.93**2) * y).tolist(), k % 3)]
    near = [np.dot(a[1], b[1]) / (np.linalg.norm(a[1]) * np.linalg.norm(b[1])) for a, b in zip(rows[::2], rows[1::2], strict=True)]
    assert 200 < sum(c >= 0.93 for c in near) < 1400
    check(spark, rows, f"file://{tmp_path}/e", "double")


def test_links_drop_single_pairs():
    r = np.random.default_rng(6)
    for spread in (0.1, 0.3, 1.0):
        base = r.normal(size=(5, 40)) * np.linspace(3, 0.1, 40)
        a, b = (base[np.arange(n) % 5] + r.normal(size=(n, 40)) * spread for n in (90, 70))
        a, b = (x / np.linalg.norm(x, axis=1)[:, None] for x in (a, b))
        i, j, total = embed._links(a, b, 0.93)
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*np.nonzero(a @ b.T >= 0.93 - embed.SLACK), strict=True))
        assert np.allclose(total, (a @ b.T)[i, j], atol=1e-12)


def test_empty(spark, tmp_path):
    check(spark, [], f"file://{tmp_path}/e")
