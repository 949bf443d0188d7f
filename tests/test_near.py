"""Words near a use: the band join against a plain walk up the lines, and the memory that a crowded line takes."""

import random
import re
import tracemalloc

import pytest

from cipherlode import dims
from cipherlode.functions.source import Source, words_of
from cipherlode.operators import lexical


def plain(text, line):
    """The nearest word of each kind: a line's code, its comments, then the line above it."""
    t, code, comments = Source("x.js", text).tokens, {}, {}
    low = max(1, line - lexical.NEAR)
    for i, letter in enumerate(t.letters):
        if letter in "iDIXFCRO":
            code.setdefault(t.line(t.start[i]), []).extend(words_of(t.word(i)))
    for a, z in t.comments:
        first, last = t.line(a), t.line(z - 1)
        if last >= low and first <= line:
            comments.setdefault(min(line, max(low, first)), []).extend(words_of(t.text[a:z]))
    near = [w for k in range(line, low - 1, -1) for w in (*code.get(k, ()), *comments.get(k, ()))]
    return tuple(next((w for w in near if re.search(p, w)), None) for p in dims.DECIDING.values())


def made(seed):
    r = random.Random(seed)
    some = lambda: r.choice(["seal", "authToken", "tlsSession", "x", "sessions", "verifyJwt", "storage", "plain", "handshake", "backupKey"])
    lines = []
    for _ in range(r.randint(5, 60)):
        lines.append(r.choice(["", "", f"{some()}();", f"a = {some()} + '{some()}'; // {some()} {some()}", f"/* {some()} */ {some()} /* {some()} */", f"/* {some()}\n\n {some()}\n" + "\n" * r.randint(0, 25) + "*/", "crypto.subtle.generateKey({ name: 'ECDH' })", "crypto.subtle.sign(k); crypto.subtle.sign(j) // " + some()]))
    return "\n".join(lines)


def test_against_plain(spark):
    texts = {f"{i}.js": made(i) + "\ncrypto.subtle.digest(a)" for i in range(60)} | {"none.js": "let a = 1", "last.js": "/* seal */" + "\n" * 8 + "crypto.subtle.sign(k)", "past.js": "/* seal */" + "\n" * 9 + "crypto.subtle.sign(k)"}
    fact = lexical.facts(spark.createDataFrame(list(texts.items()), "path string, text string")).cache()
    uses = fact.where("kind = 'call'").select("path", "line", "ord")
    got = {(r.path, r.line): (r.seal, r.session, r.sign) for r in lexical.near_words(uses, lexical.words(fact)).collect()}
    expected = {(r.path, r.line): plain(texts[r.path], r.line) for r in uses.collect()}
    assert {k: v for k, v in expected.items() if v != (None,) * 3} == got
    assert len(expected) > 100 and lexical.near_words(uses.where("false"), lexical.words(fact)).count() == 0


def test_a_crowded_line_takes_little_memory():
    """20,000 calls on one line, and words of each kind beside them."""
    text = "import { createHash } from 'crypto'; " + "seal.sign(createHash('md5') /* session store */); " * 10_000
    tracemalloc.start()
    kinds = {}
    for row in lexical._read("a.js", text):
        kinds[row["kind"]] = kinds.get(row["kind"], 0) + 1
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert kinds["call"] == 20_000 and kinds["word"] == 4
    assert peak < 50e6


def test_a_file_that_fails_is_told(monkeypatch):
    """Whatever a file does to the reader, its facts so far stay and a row says so."""
    calls = Source.calls
    monkeypatch.setattr(Source, "calls", lambda self: (x for i, x in enumerate(calls(self)) if i < 1 or 1 / 0))
    rows = list(lexical._read_or_say("a.js", "import { createHash } from 'crypto'; createHash('md5'); createHash('sha1')"))
    assert [r["kind"] for r in rows] == ["import", "call", "unread"] and rows[-1]["name"] == "could not be read to its end (ZeroDivisionError)"


@pytest.mark.parametrize("text", ["", "\0", "'", "`${", "/*", "})]`", "createHash(" * 3000, "export const a = '\\ud800'", "crypto(" + "[{" * 2000, "const {a = crypto.subtle", "import {", "export const crypto = - ", "a ? : b ? ?:: crypto.subtle.digest(?:)"])
def test_broken_text_is_read(text):
    assert "unread" not in {r["kind"] for r in lexical._read_or_say("a.js", "import 'crypto';" + text)}
