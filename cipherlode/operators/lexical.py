"""Lexical facts of source files: one pass over each text, without an exchange; what joins files comes after."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from cipherlode.dims import DECIDING, PACKAGES, SUBTLE
from cipherlode.store import large

#: A file without any of these has no use of cryptography; only its constants may matter to others.
MENTIONS = re.compile("|".join(["crypto", "subtle", "getrandomvalues", "randomuuid", "https?", "tls", "pbkdf2", *sorted({re.escape(p.rsplit("/", 1)[-1]) for p in PACKAGES})]), re.I)
#: Modules whose calls a detector asks for, besides catalogued packages.
MODULES = ("crypto", "tls", "https", "http2")
#: Longest name of a JSON Web Algorithm, about; other strings are no facts.
LITERAL = 24
#: Lines above a use whose words are near it, and lines that a join by place takes together.
NEAR, LINES = 8, 16
#: Bytes of facts that a task holds before it sends them, about, and of texts and their facts that it keeps for copies to come.
HELD, KEPT = 4 << 20, 48 << 20

_SCALAR = [("kind", pa.string()), ("code", pa.string()), ("text", pa.string()), ("number", pa.int64()), ("place", pa.int32())]
_VALUE = [*_SCALAR, ("fields", pa.map_(pa.string(), pa.struct(_SCALAR))), ("branches", pa.list_(pa.struct(_SCALAR)))]
_ARGUMENT = [*_VALUE, ("given", pa.string()), ("line", pa.int32()), ("col", pa.int32()), ("evidence", pa.string())]
_SCHEMA = pa.schema([
    ("path", pa.string()), ("kind", pa.string()), ("ord", pa.int32()), ("line", pa.int32()), ("col", pa.int32()), ("low", pa.int32()), ("high", pa.int32()), ("asks", pa.int32()), ("name", pa.string()), ("module", pa.string()), ("members", pa.list_(pa.string())),
    ("chain", pa.list_(pa.string())), ("crypto_root", pa.bool_()), ("alias", pa.bool_()), ("padded", pa.bool_()), ("args", pa.list_(pa.struct(_ARGUMENT))), ("value", pa.struct(_VALUE)), ("evidence", pa.string()),
])
FACT = from_arrow_schema(_SCHEMA)
#: What facts say of a value that is known: alone, and with an object's fields.
SCALAR = ["kind", "code", "text", "number"]


def package(module: str) -> str:
    """The package of a specifier, without its subpath."""
    return "/".join(module.split("/")[: 2 if module.startswith("@") else 1])


def _plain(v, known: set[str]) -> dict:
    """A value as a fact; the places of names that nothing in the file declares or imports are not asked for."""
    whole = int(v.number) if v.number is not None and abs(v.number) < 2**63 and v.number == int(v.number) else None
    return {"kind": v.kind, "code": v.code, "text": v.text, "number": whole, "place": v.place if v.code in known else None}


def _read(path: str, text: str) -> Iterator[dict]:
    """Facts of one file, by kind.

    call (asks: how many names its arguments have, a column of its own, so that a reader of those passes over parts of a table without any); import; ask (a constant of another file); declared (a name that a value may
    mean, with the tokens between which it holds, whether it is a constant, and its
    value; those of the top level have a place); string (in an import's reach); word (near a
    call or string: one that decides a priority).
    """
    from cipherlode.functions.source import Declared, Source, Value

    asked = bool(MENTIONS.search(text))
    if not asked and not ("export" in text and "const" in text):
        return
    source = Source(path, text)
    t, used_lines, names, asks = source.tokens, set(), set(), []
    known = {d.name for d in source.scoped}

    def at(i: int, use: bool = False) -> dict:
        line, col = t.place(i)
        if use:
            used_lines.add(line)
        return {"path": path, "ord": i, "line": line, "col": col, "evidence": source.evidence(line)}

    def told(v: Value) -> dict:
        """A value with its fields and branches; the names in it are asked for. A choice that can't be decided is an expression like others."""
        fields = []
        if v.kind == "choice" and not any(b.place is not None and b.code in known for b in v.branches):
            v = v._replace(kind="other", branches=())
        for name, x in source.fields(v):
            fields.append((name, x))
            fields += [(f"{name}.{k}", y) for k, y in source.fields(x)]
        found = [x for x in (v, *v.branches, *(x for _, x in fields)) if x.place is not None and x.code in known]
        asks.extend(x.place for x in found)
        names.update(x.code for x in found)
        fields = [(k, x._replace(kind="other") if x.kind == "choice" else x) for k, x in fields]
        return _plain(v, known) | {"fields": [(k, _plain(x, known)) for k, x in fields], "branches": [_plain(x, known) for x in v.branches]}

    def declared(d: Declared) -> dict:
        low, high = source.scope(d)
        fact = {"path": path, "ord": d.index, "kind": "declared", "name": d.name, "low": low, "high": high, "alias": d.kind == "const" and d.value is not None}
        return fact | (at(d.index) if low == -1 else {}) | {"value": told(source.value(*d.value)) if fact["alias"] else None}

    def asked_for(wanted: Callable[[Declared], bool]) -> Iterator[dict]:
        """The declarations wanted, and those of the names in their values, and so on."""
        left = list(source.scoped)
        while left:
            now, left = [d for d in left if d.name in names or wanted(d)], [d for d in left if not (d.name in names or wanted(d))]
            if not now:
                break
            yield from map(declared, now)

    exported = lambda d: d.block == -1 and d.kind == "const" and ("export" in text or "pbkdf2" in d.name.lower())
    if not asked:
        yield from (d for d in asked_for(exported) if d["value"] is None or d["value"]["kind"] in ("string", "number", "name", "choice"))
        return
    sites, bound = source.imports
    known |= {name for name, (module, members) in bound.items() if module.startswith(".") and len(members) == 1}
    for i, module in sites:
        yield at(i) | {"kind": "import", "module": module}
    for name, (module, members) in bound.items():
        if module.startswith(".") and len(members) == 1:
            yield {"path": path, "kind": "ask", "ord": 0, "name": name, "module": module, "members": list(members)}
    for i, opener, chain, root, group in source.calls():
        module, members = (root, chain) if root else (None, None)
        if not root and not group and chain[0] in bound:
            module, path_ = bound[chain[0]]
            members = [*path_, *chain[1:]]
        subtle = chain[-1] in SUBTLE
        if not (subtle or chain[-1] in ("getRandomValues", "randomUUID") or (module and (module in MODULES or package(module) in PACKAGES))):
            continue
        args, before = [], len(asks)
        for s, e in t.split(opener + 1, t.partner.get(opener, opener + 1)):
            if e > s:
                v = source.value(s, e)
                own = at(s, use=True) if subtle else {"line": None, "col": None, "evidence": None}
                args.append(told(v) | {"given": t.code(s, e) if v.kind in ("name", "choice", "other") or (v.kind != "object" and e - s == 1) else "", **{k: own[k] for k in ("line", "col", "evidence")}})
        yield at(i, use=True) | {
            "kind": "call", "asks": len(asks) - before, "chain": chain, "module": module, "members": members, "args": args, "alias": not root and not group and len(chain) == 2 and chain[0] in source.subtle,
            "crypto_root": bool(group and source.mentions(*group)), "padded": any(t.word(k) == "RSA_PKCS1_PADDING" for k in range(opener, t.partner.get(opener, opener)) if source.letters[k] == "i"),
        }
    used = sorted({package(m) for _, m in sites} & PACKAGES.keys())
    if used:
        openers = [-1] * len(source.letters)
        for a, z in t.partner.items():
            if a < z and source.letters[a] == "[":
                openers[a + 1 : z] = [a] * (z - a - 1)
        for i, letter in enumerate(source.letters):
            if letter in "st" and len(text_ := source.literal(i)) <= LITERAL:
                field = i if source.letters[i - 1 : i] == ":" else openers[i]
                named = field > 1 and source.letters[field - 1] == ":" and t.word(field - 2) in (("alg", "algorithm") if field == i else ("algorithms",))
                yield at(i, use=True) | {"kind": "string", "name": text_, "alias": named, "chain": used}
    yield from asked_for(exported)
    around = {k for line in used_lines for k in range(line - NEAR, line + 1)}
    for first, last, place, comment, kind, word in source.words(around, {k: re.compile(pattern) for k, pattern in DECIDING.items()}):
        yield {"path": path, "kind": "word", "ord": place, "low": first, "high": last, "name": word, "module": kind, "alias": comment}


def _read_or_say(path: str, text: str) -> Iterator[dict]:
    """Facts of one file; if it can't be read to its end, those so far and a row of kind unread that says why. No file ends a scan."""
    try:
        yield from _read(path, text)
    except Exception as error:  # noqa: BLE001  whatever it is, the other files are read
        yield {"path": path, "kind": "unread", "ord": 0, "name": f"could not be read to its end ({type(error).__name__})"}


def _weight(row: dict) -> int:
    """Bytes of a fact, about."""
    values = [*(row.get("args") or ()), *filter(None, (row.get("value"),))]
    return 400 + sum(200 + len(v.get("given") or "") + sum(len(x[c] or "") for x in (v, *(f for _, f in v["fields"]), *v["branches"]) for c in ("code", "text")) for v in values)


class _Copies:
    """Facts of files, in batches. A text is read once as long as its facts are kept: copies of a file say the same at another path."""

    def __init__(self) -> None:
        self._forget()
        self.paths, self.ranges, self.held = [], [], 0

    def _forget(self) -> None:
        self.known, self.size = {}, 0
        self.table, self.fresh = pa.RecordBatch.from_pylist([], _SCHEMA), []

    def add(self, path: str, text: str) -> Iterator[pa.RecordBatch]:
        found = self.known.get(text)
        if found is None:
            rows, weight, facts_ = [], 0, _read_or_say(path, text)
            for row in facts_:
                rows.append(row)
                weight += _weight(row)
                if weight > HELD:
                    break
            if weight > HELD:  # sent as it is read, and not kept
                yield from self.flush()
                while rows:
                    yield pa.RecordBatch.from_pylist(rows, _SCHEMA)
                    rows, weight = [], 0
                    for row in facts_:
                        rows.append(row)
                        weight += _weight(row)
                        if weight > HELD:
                            break
                return
            found = self.known[text] = (self.table.num_rows + len(self.fresh), len(rows), weight)
            self.fresh += rows
            self.size += len(text) + 200
        self.paths.append(path)
        self.ranges.append(found[:2])
        self.held += found[2] + 50
        if self.held > HELD or self.size > KEPT:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        """What is held, sent; what is kept goes when it is too much."""
        if self.fresh:
            self.table = pa.concat_batches([self.table, pa.RecordBatch.from_pylist(self.fresh, _SCHEMA)])
            self.fresh = []
        if self.ranges:
            first, n = np.array(self.ranges, dtype=np.int64).T
            ends = np.cumsum(n)
            at = np.arange(ends[-1]) + np.repeat(first - ends + n, n)
            whose = pa.array(self.paths, pa.string()).take(pa.array(np.repeat(np.arange(len(n)), n)))
            yield self.table.take(pa.array(at)).set_column(0, _SCHEMA.field("path"), whose)
        self.paths, self.ranges, self.held = [], [], 0
        if self.size + self.table.nbytes > KEPT:
            self._forget()


def facts(files: DataFrame) -> DataFrame:
    """FACT rows of files (path, text): a narrow map of the scan, whatever a file's size or nesting.

    A call has its chain of names, the module and members that it reaches through this file's imports,
    and its arguments as values; crypto_root: a bracketed root that mentions crypto; alias: on a
    name that is set to a SubtleCrypto object. Comments, regular expressions and the text of strings never give a call.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        copies = _Copies()
        for batch in batches:
            for path, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from copies.add(path, text)
        yield from copies.flush()

    rows, cores = files.select("path", "text").where("text IS NOT NULL"), files.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < cores:  # a small table in few parts: reading takes longer than dealing it out
        rows = rows.repartition(cores)
    return rows.mapInArrow(read, FACT)


def import_sites(fact: DataFrame) -> DataFrame:
    """(path, module, line, col, ord, evidence): imports, re-exports and loads."""
    return fact.where("kind = 'import'").select("path", "module", "line", "col", "ord", "evidence")


def calls(fact: DataFrame) -> DataFrame:
    """Calls; asks: how many names their arguments have."""
    return fact.where("kind = 'call'").select("asks", "path", "ord", "line", "col", "chain", "module", "members", "crypto_root", "alias", "padded", "args", "evidence")


def words(fact: DataFrame) -> DataFrame:
    """(path, first, last, place, comment, kind, word): the first word of each kind in a line of code, or in a comment, which may go over several lines."""
    return fact.where("kind = 'word'").select("path", F.col("low").alias("first"), F.col("high").alias("last"), F.col("ord").alias("place"), F.col("alias").alias("comment"), F.col("module").alias("kind"), F.col("name").alias("word"))


def unread(fact: DataFrame) -> DataFrame:
    """(path, reason) of files that could not be read to their end."""
    return fact.where("kind = 'unread'").select("path", F.col("name").alias("reason"))


def near_words(lines: DataFrame, words: DataFrame) -> DataFrame:
    """(path, line, seal, session, sign): for each of lines (path, line) the nearest word of each kind, null where there is none.

    Near: on the line, then on each of the NEAR above it, upwards; of a line, code comes before
    comments; a comment stands at its first line that is near. A band join by
    blocks of LINES lines: a word is in the blocks of its comment's lines, a use asks
    one or two. A line has one word of each kind and so has a comment, so a block's
    rows don't grow with what is on a line. Repeated lines are one; lines without words near them give no row.
    """
    block = lambda c: F.floor(c / LINES)
    top = F.col("line") - NEAR
    uses = lines.select("path", "line").distinct().select("path", "line", F.explode(F.array_distinct(F.array(block(top), block(F.col("line"))))).alias("block"))
    told = words.select("*", F.explode(F.sequence(block(F.col("first")), block(F.col("last")))).alias("block"))
    both = uses.join(large(told), ["path", "block"]).where((F.col("last") >= top) & (F.col("first") <= F.col("line")))
    stands = F.least("line", F.greatest("first", top))
    rank = F.struct(F.col("line") - stands, "comment", "place", "word")
    least = {k: F.min(F.when(F.col("kind") == k, rank)).alias(k) for k in DECIDING}
    return both.groupBy("path", "line").agg(*least.values()).select("path", "line", *(F.col(k)["word"].alias(k) for k in DECIDING))


def imported(fact: DataFrame, constant: DataFrame) -> DataFrame:
    """(path, names): what a file imports, by relative path, that is a constant (scopes.constants) of the other file's top level: one step."""
    exported = constant.select(F.col("path").alias("from_path"), F.col("name").alias("from_name"), F.struct(F.col("value.kind").alias("kind"), F.col("value.text").alias("text"), F.col("value.number").alias("number")).alias("value"))
    asked = fact.where("kind = 'ask'").select("path", "name", F.element_at("members", 1).alias("from_name"), F.posexplode(candidates(F.col("path"), F.col("module"))).alias("rank", "from_path"))
    found = asked.join(large(exported.dropDuplicates(["from_path", "from_name"])), ["from_path", "from_name"]).groupBy("path", "name").agg(F.min_by("value", "rank").alias("value"))
    return found.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("names"))


def with_imported(calls: DataFrame, names: DataFrame) -> DataFrame:
    """calls whose arguments and fields that are names are what their file imports under them."""
    joined = calls.join(large(names), "path", "left")
    known = lambda v: F.try_element_at("names", F.when(v["kind"] == "name", v["code"]))

    def filled(v: Column) -> Column:
        k = known(v)
        return v.withField("kind", F.coalesce(k["kind"], v["kind"])).withField("text", F.coalesce(k["text"], v["text"])).withField("number", F.coalesce(k["number"], v["number"]))

    arg = lambda a: filled(a).withField("fields", F.transform_values(a["fields"], lambda _, v: filled(v)))
    return joined.withColumn("args", F.when(F.col("names").isNull(), F.col("args")).otherwise(F.transform("args", arg))).drop("names")


#: Endings that a relative import may leave out, in order. Fixed values.
ENDINGS = ["", ".js", ".mjs", ".cjs", ".ts", ".mts", ".cts", ".tsx", ".jsx", "/index.js", "/index.ts", "/index.mjs"]


def candidates(path: Column, specifier: Column) -> Column:
    """Files that a relative import may mean, the first that exists wins; .js may stand for .ts, .tsx or .mts."""
    parts = F.filter(F.split(F.concat_ws("/", F.regexp_replace(path, r"/?[^/]*$", ""), specifier), "/"), lambda p: (p != "") & (p != "."))
    joined = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))), "/")
    swapped = F.when(joined.rlike(r"\.js$"), F.transform(F.array(*map(F.lit, (".ts", ".tsx", ".mts"))), lambda e: F.concat(F.regexp_replace(joined, r"\.js$", ""), e))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.transform(F.array(*map(F.lit, ENDINGS)), lambda e: F.concat(joined, e)), swapped)
