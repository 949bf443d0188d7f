"""The tree source: parts that list their own folders give the rows of one walk, and filters keep files shut."""

import builtins
import random

import pytest
from pyspark.sql import functions as F

from cipherlode.functions import paths as P
from cipherlode.sources import tree


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    r, top = random.Random(5), tmp_path_factory.mktemp("tree")
    for i in range(300):
        folder = top.joinpath(*(r.choice(["a", "b", "c d", "é", "node_modules", "skip"]) for _ in range(r.randint(0, 5))))
        folder.mkdir(parents=True, exist_ok=True)
        (folder / r.choice(["x.js", "y.ts", f"f{i}.mjs", "package.json", "yarn.lock", "nginx.conf", "readme.md"])).write_bytes(r.choice([b"let a = 1", b"\0", b"x" * 500, b""]))
    (top / "crowd").mkdir()
    for i in range(50):
        (top / "crowd" / f"{i}.js").write_text(f"{i}")
    (top / "a" / "link.js").symlink_to(top / "crowd" / "1.js")
    (top / "crowd" / "below").mkdir()
    (top / "crowd" / "below" / "z.js").write_text("z")
    return str(top)


def rows(reader):
    return sorted((row for part in reader.partitions() for row in reader.read(part)), key=lambda r: r[0])


@pytest.mark.parametrize(("listed", "crowded", "size"), [(0, 99, 1000), (1, 99, 1 << 20), (3, 7, 100), (9999, 10, 300)])
def test_every_way_to_split_gives_the_same_rows(root, listed, crowded, size):
    whole = rows(tree.TreeReader(root, ["skip/"], 1 << 30, 9999, 1 << 30))
    assert len(whole) > 100 and not any("skip/" in r[0] or "node_modules" in r[0] for r in whole)
    reader = tree.TreeReader(root, ["skip/"], size, listed, crowded)
    assert rows(reader) == whole
    assert listed == 9999 or sum(len(p.files) for p in reader.partitions()) < len(whole)


@pytest.mark.parametrize("kinds", [["lockfile"], ["js", "tls"], [None], []])
@pytest.mark.parametrize("listed", [0, 9999])
def test_other_kinds_stay_shut(root, monkeypatch, kinds, listed):
    whole = rows(tree.TreeReader(root, [], 1 << 20))
    reader, opened = tree.TreeReader(root, [], 1 << 20, listed, 10, kinds), []
    plain = builtins.open
    monkeypatch.setattr(builtins, "open", lambda name, *a: opened.append(name) or plain(name, *a))
    expected = [r for r in whole if r[1] in kinds]
    assert rows(reader) == expected
    assert len(opened) == sum(r[1] is not None for r in expected)


def test_through_spark(spark, root):
    files = tree.read_tree(spark, root, ["skip/"])
    whole = {tuple(r) for r in files.collect()}
    assert whole == set(rows(tree.TreeReader(root, ["skip/"], 1 << 20)))
    found = files.where("kind = 'js' AND reason IS NULL AND text IS NOT NULL AND size > 1")
    assert {tuple(r) for r in found.collect()} == {r for r in whole if r[1] == "js" and r[4] is None and r[2] > 1}
    locks, both = files.where("kind = 'lockfile'"), files.where("kind = 'lockfile'").select("path").union(files.where("kind = 'manifest'").select("path"))
    assert {tuple(r) for r in both.collect()} == {r[:1] for r in whole if r[1] in ("lockfile", "manifest")}
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("source_tree")
    assert (scans(files), scans(locks), scans(both), scans(files.where("kind IS NULL"))) == (5, 1, 2, 1)


def test_files_over_the_limit_are_skipped(spark, tmp_path):
    for name, size in (("at.js", P.LARGEST), ("over.js", P.LARGEST + 1)):
        (tmp_path / name).write_text("/" * size)
    read = {r.path: (r.reason, r.n) for r in tree.read_tree(spark, str(tmp_path)).select("path", "reason", F.length("text").alias("n")).collect()}
    assert read == {"at.js": (None, P.LARGEST), "over.js": ("larger than 16 MB", None)}
    rows = spark.createDataFrame([("at.js", P.LARGEST), ("over.js", P.LARGEST + 1)], "path string, n int").select("path", F.repeat(F.lit("/"), F.col("n")).alias("text"))
    assert {r.path: r.reason for r in tree.read_table(rows).select("path", "reason").collect()} == {"at.js": None, "over.js": "larger than 16 MB"}
