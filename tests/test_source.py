"""Reading of JavaScript and TypeScript text: tokens, values, scopes, imports, calls."""

import pytest

from cipherlode.functions.lexer import Tokens, number
from cipherlode.functions.source import Source, words_of


def shape(text):
    t = Tokens(text)
    return t.letters, [t.word(i) for i in range(len(t.letters))]


@pytest.mark.parametrize("quote", ["'", '"', "`"])
def test_long_literals_end_at_their_quote(quote):
    literal = quote + r"\xaa-" * 50_000 + quote
    assert shape(f"a({literal});b()")[0] == ("i(s);i()" if quote != "`" else "i(t);i()")


def test_comments_strings_templates_and_expressions_hold_no_code():
    assert shape("// a.b('R')\n/* h('m')\n */ x(); /* open\n y()")[1] == ["x", "(", ")", ";"]
    assert shape("log('call it(key) \\' now')")[0] == "i(s)"
    assert shape("f(`it's ${name}'s`); g(`${ {a: `${b}`}.a } ${c}`)")[0] == "i(`ie);i(`{i:`ie}.imie)"
    assert shape("a = 'open\nb('x')")[0] == "i=si(s)"
    assert shape("r = /'[^/]*\\/\\/x/g; q = /\"/; return /a'b/.c; f(/'/); a / b / c; (a) / 2; d[0] / 3")[0] == "i=r;i=r;Rr.i;i(r);ioioi;(i)on;i[n]on"
    assert shape("x?.y?.z; a?.5:b; @dec class A { #k = 1 }")[0] == "i.i.i;iqn:i;@iii{i=n}"
    assert shape("﻿#!/usr/bin/env node\nrun()")[1] == ["run", "(", ")"]


def test_places_and_depth():
    t = Tokens("a\r\n  b\rc\n\n   d '😀' e `x\ny` f")
    assert [t.place(i) for i in range(len(t.letters))] == [(1, 1), (2, 3), (3, 1), (5, 4), (5, 6), (5, 11), (5, 13), (6, 4)]
    t = Tokens("a; function f() { const b = { c: 2 }; } x")
    opener = t.letters.index("{")
    assert t.block(t.letters.index("i")) == -1 and t.block(opener + 1) == opener and t.outer[t.block(opener + 5)] == opener


def test_deep_nesting_is_no_limit():
    deep = "(" * 500 + "'sha1'" + ")" * 500
    assert value(deep).text == "sha1"
    assert shape("`${" * 60 + "x" + "}`" * 60)[0] == "`" * 60 + "i" + "e" * 60


def test_numbers_and_words():
    assert [number(x) for x in ("310_000", "0xff", "1e3", "10n", ".5", "0b11")] == [310000, 255, 1000, 10, 0.5, 3]
    assert words_of("sealHTTPBox_v2 aB ABc") == ["seal", "http", "box", "v", "a", "b", "a", "bc"]


def value(code, before=""):
    s = Source("a.js", f"{before}; use({code})")
    (*_, (_, opener, _, _, _)) = (c for c in s.calls() if c[2] == ["use"])
    return s.value(*s.tokens.split(opener + 1, s.tokens.partner[opener])[0])


@pytest.mark.parametrize(("code", "expected"), [("'a\\x2db\\n'", "a-b\n"), ("`x`", "x"), ("'a' as const", "a"), ("z ? 'a' : 'a'", "a"), ("z ? 'a' : 'b'", None), ("-5", -5), ("1e5", 100000)])
def test_values(code, expected):
    v = value(code)
    assert (v.text if v.text is not None else v.number) == expected


def test_fields():
    v = "{ name: 'A', 'b c': 1, hash: { name: 'H' }, short, [k]: 1, ...rest, m() {}, d: other.x }"
    s = Source("a.js", f"const short = 7; use({v})")
    (opener,) = (c[1] for c in s.calls() if c[2] == ["use"])
    got = dict(s.fields(s.value(opener + 1, s.tokens.partner[opener])))
    assert {k: x.text or x.number or x.kind for k, x in got.items()} == {"name": "A", "b c": 1, "hash": "object", "short": "name", "d": "other"}
    assert got["d"].code == "other.x" and dict(s.fields(got["hash"]))["name"].text == "H"


def test_imports():
    code = "import a, { b as c, type T, default as d } from 'node:m'; import * as n from 'n'; import 's'; import type { U } from 't'; export { x } from 'r'; export * from 'q';\n" \
        "const e = require('e').f, { g, h: i = 1 } = await import('k'); require('inline').x(); var P=(e=>typeof require<'u'?require:e)(0); var Q=P('p'); y.require('no'); require(z)"  # fmt: skip
    sites, bound = Source("a.js", code).imports
    assert [m for _, m in sites] == ["m", "n", "s", "r", "q", "e", "k", "inline", "p"]
    assert bound == {"a": ("m", ()), "c": ("m", ("b",)), "d": ("m", ()), "T": ("m", ("T",)), "n": ("n", ()), "e": ("e", ("f",)), "g": ("k", ("g",)), "i": ("k", ("h",)), "Q": ("p", ())}


def test_calls_and_definitions():
    s = Source("a.js", "a.b?.c(1); require('m').d(2); (x.crypto || y).subtle.e(3); z[0].f(4); g?.(5); function h() {} class A { sign(k) { } get(k): T { } } q ? i(6) : { }; async function* j() {} new K(7); if (l(8)) {}")
    got = [(".".join(chain), root, group is not None) for _, _, chain, root, group in s.calls()]
    assert got == [("a.b.c", None, False), ("require", None, False), ("d", "m", False), ("subtle.e", None, True), ("[].f", None, False), ("g", None, False), ("i", None, False), ("K", None, False), ("l", None, False)]


def test_subtle_names():
    s = Source("a.js", "const { subtle, x: y } = globalThis.crypto; let s = window.crypto.subtle; t = (a || b.webcrypto).subtle; function f(u = crypto.subtle) {} const v = theme.subtle; w.z = crypto.subtle")
    assert s.subtle == {"subtle", "s", "t", "u"}


def test_awkward_text():
    from cipherlode.functions.lexer import unescape

    assert unescape(r"\ud83d\ude00 \ud800 \udc00\ud800") == "😀 \ufffd \ufffd\ufffd"
    assert number("1e999") == float("inf") and number("9" * 5000 + "n") == float("inf") and number("0x" + "f" * 5000 + "n") > 2**64
    assert value("z ? 'md5' : " * 1500 + "'md5'").text == "md5" and value("z ? 'md5' : " * 1500 + "'sha1'").kind == "other"
    assert value("p ? q ? 'x' : 'x' : r ? 'x' : 'x'").text == "x" and value("p ? q ? 'x' : 'y' : 'x'").text is None
    assert value("z ? { name: 'A', n: 1 } : { name: 'A' }").kind == "object" and value("(z ? " * 3000 + "'a'" + " : 'a')" * 3000).text is None
    assert [b.code for b in value("z ? a : y ? b : 'c'").branches] == ["a", "b", ""] and value("z ? a : [1]").kind == "other"


def test_evidence():
    s = Source("a.js", "// line one\nconst a = keepSafe;\n/* two\nlines */ b('string');\n" + "\n" * 9 + "c()")
    assert s.evidence(4) == "lines */ b('string');"
