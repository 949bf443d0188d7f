"""What names mean: values through constants, against what each case says, and the sweep against a walk outwards."""

import random

import pytest
from pyspark.sql import functions as F

from cipherlode.operators import detect, lexical, scopes
from cipherlode.store import settle

#: An argument, what comes before the call, and the text or number that it has.
VALUES = [
    ("x", "const x = 'a'", "a"), ("x", "let x = 'a'", None), ("x", "const x = y, y = x", None), ("x", "const x = x", None), ("x", "function f() { const x = 'a' }", None), ("x", "const x = 'a'; { const x = 'b' }", "a"), ("x", "const x: Map<string, number> = 'a'", "a"),
    ("x", "const x\n = 'a'\nfoo()", "a"), ("x", "use(x); const x = 'late'", "late"), ("x", "const x = -7", -7), ("x", "const x = z ? 'a' : 'a'", "a"), ("z ? x : 'a'", "const x = 'a'", "a"), ("z ? x : y", "const x = 'a', y = 'a'", "a"), ("z ? x : y", "const x = 'a', y = 'b'", None),
    ("z ? x : y", "const x = 'a'", None), ("x", "const y = 'a', x = z ? y : 'a'", "a"), ("x", "const y = 'b', x = z ? y : 'a'", None), ("z ? x : 5", "const x = 5", 5), ("z ? x : '5'", "const x = 5", None), ("x", "const x = null", None), ("a", "const a = z ? { name: a } : { name: a }", None),
    *(("c0", "const " + ", ".join(f"c{i} = c{i + 1}" for i in range(n)) + f", c{n} = 'end'", "end" if n <= 8 else None) for n in (1, 7, 8, 9, 12)), ("x", "var x = 'v'", None), ("x", "const x = 'a'; const x = 'b'", "a"), ("p", "const { p } = q", None),
]
#: A function's body below a constant x = 'a'.
INNER = [("const x = 'b'; use(x)", "b"), ("let x = 'b'; use(x)", None), ("use(x); const x = 'b'", "a"), ("if (y) { const x = 'b' } use(x)", "a"), ("if (y) { const x = 'b'; use(x) } const x = 'c'", "b"), ("if (y) { let x; { use(x) } }", None), ("`${use(x)}`; const x = 'b'", "a"), ("const x = 'b'; `${use(x)}`", "b")]


def resolved(spark, texts):
    return detect.resolved(settle(lexical.facts(spark.createDataFrame(list(texts.items()), "path string, text string"))))[0]


def test_values_through_constants(spark):
    texts = {f"v{i}": f"import {{ createHash as use }} from 'crypto'; {before}; use({code})" for i, (code, before, _) in enumerate(VALUES)}
    texts |= {f"i{i}": f"import {{ createHash as use }} from 'crypto'; const x = 'a'; function f() {{ {inner} }}" for i, (inner, _) in enumerate(INNER)}
    expected = {f"v{i}": e for i, (_, _, e) in enumerate(VALUES)} | {f"i{i}": e for i, (_, e) in enumerate(INNER)}
    rows = resolved(spark, texts).orderBy("path", "ord").collect()
    got = {r.path: r.args[0].text if r.args[0].text is not None else r.args[0].number for r in rows}
    assert {k: (texts[k], got[k], e) for k, e in expected.items() if got[k] != e} == {}


def test_undecided_choices_are_expressions(spark):
    texts = {"a": "import { createHash } from 'crypto'; createHash(z ? y : 'a'); crypto.subtle.digest({ name: z ? y : 'A' }, d)", "b": "import { createHash } from 'crypto'; let y; createHash(z ? y : 'a')"}
    rows = resolved(spark, texts).orderBy("path", "ord").collect()
    assert [(r.args[0].kind, r.args[0].code) for r in rows] == [("other", "z?y:'a'"), ("object", ""), ("other", "z?y:'a'")] and rows[1].args[0].fields["name"].kind == "other"


def test_fields_through_constants(spark):
    text = "const n = 'AES-GCM', len = 256, h = { name: H }, H = 'SHA-1', alg = { name: n, length: len, hash: h, iv, deep: { name: H } }; crypto.subtle.encrypt(alg, k, d); crypto.subtle.encrypt(z ? { name: n, iv } : { name: 'AES-GCM' }, k); crypto.subtle.encrypt({ name: z ? n : n }, k)"
    a, b, c = (r.args[0] for r in resolved(spark, {"a.js": text}).orderBy("ord").collect())
    assert {k: v.text or v.number or v.kind for k, v in a.fields.items()} == {"name": "AES-GCM", "length": 256, "hash": "object", "iv": "name", "deep": "object", "deep.name": "SHA-1"}
    assert (b.kind, b.fields["name"].text) == ("object", "AES-GCM") and c.kind == "object"


def test_repeated_and_clashing_files(spark):
    """Files that share a path, text and all or in part, end no scan."""
    texts = [("a.js", "import { createHash as use } from 'crypto'; const x = 'md5'; use(x); use(x, x)")] * 3 + [("a.js", "import { createHash as use } from 'crypto'; const y = 'md4'; use(y); use(y, z)"), ("b.js", ""), ("c.js", None)]
    calls, constants = detect.resolved(settle(lexical.facts(spark.createDataFrame(texts, "path string, text string"))))
    assert calls.count() == 8 and {r.name for r in constants.collect()} == {"x", "y"}


def plain(uses, declared):
    """The declaration of each use: of those around it the one that starts last."""
    out = []
    for name, place in uses:
        around = [d for d in declared if d[0] == name and d[1] < place < d[2]]
        out.append((name, place, max(around, key=lambda d: d[1])[3] if around else None))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_sweep_against_plain(spark, seed):
    r = random.Random(seed)
    declared, uses = [], []

    def block(low, high, depth):
        """Random nested scopes between two places; each name once in a block."""
        cuts = sorted(r.sample(range(low + 1, high), min(6, max(0, (high - low) // 8))))
        for name in r.sample("abc", r.randint(0, 3)):
            at = r.choice(range(low + 1, high)) if high - low > 2 else None
            if at and not any(d[1] == at or d[2] == at for d in declared):
                inside = [k for k in range(0, len(cuts) - 1, 2) if cuts[k] <= at <= cuts[k + 1]]
                if not inside:
                    declared.append((name, at, high, at))
        for a, z in zip(cuts[::2], cuts[1::2], strict=False):
            if depth and z - a > 3:
                block(a, z, depth - 1)

    block(0, 4000, 4)
    declared += [("a", -1, 5000, -1)] * (seed == 1)
    taken = {p for d in declared for p in d[1:3]}
    uses = [(r.choice("abcd"), p) for p in r.sample(range(1, 4000), 800) if p not in taken]
    d = spark.createDataFrame([("f", n, low, high, o, True) for n, low, high, o in declared], "path string, name string, low int, high int, ord int, alias boolean").withColumn("value", F.struct(F.lit("x").alias("kind")))
    got = scopes.bind(spark.createDataFrame([("f", n, p) for n, p in uses], "path string, name string, place int"), d).select("name", "place", "ord").collect()
    assert sorted(map(tuple, got), key=lambda x: x[:2]) == plain(uses, declared)
    assert sum(x[2] is not None for x in got) > 0


def test_a_name_declared_everywhere(spark):
    """A name that 5,000 functions declare and use: each use means its own."""
    text = "import { createHash } from 'crypto'; " + "".join(f"function f{i}(){{const e='md{i}';createHash(e)}}" for i in range(5000))
    found = resolved(spark, {"a.js": text})
    assert found.where(F.col("args")[0]["text"].startswith("md")).select(F.col("args")[0]["text"]).distinct().count() == 5000
