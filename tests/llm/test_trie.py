"""The trie against plain Python, over odd conversations and random ones."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from cipherlode.llm import trie

KIND = "conv_id long, turn long, role string, text string, depth int, base string"


def plain(rows):
    """Nodes as tuples of turns; every figure from its definition."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, said in own.items():
        h, base = zlib.crc32(str(c).encode()) % 4, int(c - (abs(c) % 20) * (1 if c >= 0 else -1))
        built[c] = tuple(own.get(base, [])[:h] + said[h:])
    members = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    saved, leaves = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
            leaves[p[:d]] += not kids[p]
    ends = lambda p: ",".join(map(str, sorted(c for c in members[p] if built[c] == p)))
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends(p).encode()).hexdigest()) for p, m in members.items())


def same(spark, rows, **kw):
    got = trie.prefix_trie(spark.createDataFrame([(*r, 0, "x") for r in rows], KIND), **kw).collect()
    assert sorted(map(tuple, got)) == plain(rows)


def random_rows(seed):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-45, 90), 70):
        rows += [(c, t, r.choice(["user", "assistant"]), r.choice(["a b", "a b c", "x"])) for t in range(r.choice([1, 1, 2, 3, 4, 6]))]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_random(spark, seed):
    same(spark, random_rows(seed))


@pytest.mark.parametrize("held", [1, 7])
def test_parts_of_a_trie(spark, held):
    """A family whose trie is written in parts counts every node once."""
    same(spark, random_rows(9), held=held)


def test_odd(spark):
    hot = [(41, i, "user", f"turn {i % 3}") for i in range(500)] + [(42, i, "user", f"turn {i % 3}") for i in range(400)]
    odd = [(1, None, None, None), (1, 5, "user", " "), (1, 5, "user", " "), (None, 1, "user", "lost"), (0, 1, "", ""), (0, 1, "u:", "x"), (-7, 3, "user", "é 😀"), (-40, 1, "a", "b"), (-39, 1, "a", "b"), (2**40, 1, "user", "w " * 40000), (19, 2, "1:u", "")]
    same(spark, odd + hot)
    same(spark, [(20, 1, "user", "only one")])
    assert trie.prefix_trie(spark.createDataFrame([], KIND)).count() == 0
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b", 0, "")], KIND)).count() == 0
