"""Words, near pairs and forms against plain Python that compares all words."""

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cipherlode.llm import spelling


def plain_words(rows, misspell=97):
    total = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if misspell and h % misspell == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def edits(word, letters):
    out = {word[:i] + word[i + 1 :] for i in range(len(word))} | {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters} | {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters}
    return out - {word}


def plain_forms(words):
    letters = {c for w in words for c in w}
    near = {w: edits(w, letters) & words.keys() for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    rows = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] is not None else None))
    return sorted(rows)


def test_query_against_plain(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, spelling.op13_spelling_variants(spark, sf_dir).select("word", "form", "root", "n", "n_near", "form_n").collect()))
    assert got == plain_forms(plain_words(rows))
    assert sum(r[1] is not None for r in got) > 5


@pytest.mark.parametrize(("entry", "most"), [(4096, 4), (2, 4), (9, 3), (1, 2), (0, 1)])
def test_crowded_entries(spark, entry, most):
    """Words that share most of their letters: entries are split, and no pair is lost."""
    r = random.Random(entry)
    words = {"".join(r.choice("abé") for _ in range(r.randint(5, 8))): r.randint(3, 60) for _ in range(400)}
    words |= {"prefix" * 4 + "".join(r.choice("xyz") for _ in range(3)): r.randint(3, 60) for _ in range(40)}
    words |= {"aaaaa": 40, "aaaaaa": 20, "aaaaaaa": 10, "aaaaaaaa": 3, "ñandú中文": 9, "ñandú中": 3, "x" * 3000: 5, "x" * 2999: 50}
    vocabulary = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    got = sorted(map(tuple, spelling.forms(vocabulary, spelling.near(vocabulary, entry, most)).collect()))
    assert got == plain_forms(words)


def test_chains_of_forms(spark):
    words = {"a" * 5 + "bcdefghij"[:k]: 3 * 2**k for k in range(9)}
    vocabulary = spark.createDataFrame(list(words.items()), "word string, n long")
    got = sorted(map(tuple, spelling.forms(vocabulary, spelling.near(vocabulary)).collect()))
    assert got == plain_forms(words) and {r[2] for r in got} == {"aaaaabcdefghi"}


def test_odd_texts(odd, empty):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert {r.word: r.n for r in spelling.count_words(odd, misspell=2).collect()} == plain_words(rows, 2)
    for words in (spelling.count_words(empty), spelling.count_words(odd.where("doc_id = 1"))):
        assert spelling.forms(words, spelling.near(words)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("abÀé "), max_size=30), max_size=4), st.integers(1, 20))
def test_pieces_of_a_text(texts, piece):
    """A text that is read in pieces has the runs of the whole."""
    text = "".join(texts).encode()
    whole, spelling.PIECE = spelling.PIECE, piece
    try:
        assert [r for some in spelling._runs(text) for r in some] == re.findall(rb"(?:[a-z]|\xc3[\x80-\xbf])+", text.lower())
    finally:
        spelling.PIECE = whole


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abc"), min_size=1, max_size=7), st.text(st.sampled_from("abc"), min_size=1, max_size=7))
def test_one_edit(a, b):
    a, b = sorted((a, b), key=len)
    assert spelling.one_edit(a, b) == (b in edits(a, "abc"))
