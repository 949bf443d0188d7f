"""What large tables need of a plan: that it stays small, and that nothing in it grows with the rows."""

import time

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from cipherlode.functions.lexer import Tokens
from cipherlode.operators import detect, lexical, scopes
from cipherlode.store import settle


def test_a_use_is_described_once(spark):
    """Detectors leave out what has no spec; the optimizer doesn't copy a spec's expression into that filter, which made a plan that took over 750 MB."""
    call = lexical.calls(settle(lexical.facts(spark.createDataFrame([("a.js", "import c from 'crypto'; c.createHash('md5'); c.unknown()")], "path string, text string"))))
    found = detect.node_crypto(call.drop("asks")).where(F.col("spec")["family"] == "Hash").select("operation", F.col("spec")["hash"].alias("hash"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("createDecipheriv") == 1 and len(plan) < 100_000
    assert [tuple(r) for r in found.collect()] == [("createHash", "MD5")]


def test_a_text_is_read_once(monkeypatch):
    """Files of one text, however many, take one reading in a task, and each has the facts that it has alone; what is kept is bounded."""
    texts = [f"import {{ createHash }} from 'crypto';\nconst a{i} = 'md5'; // seal\ncreateHash(a{i});\n" for i in range(30)] + ["", "let a"]
    files = [(f"src/f{i}.js", texts[i * i % len(texts)]) for i in range(3000)]
    alone = [row for path, text in files for row in lexical._read_or_say(path, text)]
    one, n = lexical._read_or_say, []
    monkeypatch.setattr(lexical, "_read_or_say", lambda path, text: n.append(path) or one(path, text))

    def told():
        copies = lexical._Copies()
        batches = [b for path, text in files for b in copies.add(path, text)] + list(copies.flush())
        return pa.Table.from_batches(batches).combine_chunks(), max(b.nbytes for b in batches), copies

    expected = pa.Table.from_pylist(alone, lexical._SCHEMA)
    found, most, _ = told()
    assert found.equals(expected) and most < lexical.HELD
    assert len(n) == len({text for _, text in files}) < 40
    monkeypatch.setattr(lexical, "KEPT", 20_000)
    found, _, copies = told()
    assert found.equals(expected) and copies.size + copies.table.nbytes < 30_000


def test_a_large_file_is_sent_as_it_is_read():
    """A text with more facts than a task holds is not kept."""
    text = "import { createHash } from 'crypto'; " + "createHash('md5');\n" * 20_000
    copies = lexical._Copies()
    batches = [b for path in ("a.js", "b.js") for b in copies.add(path, text)] + list(copies.flush())
    assert len(batches) > 4 and not copies.known and max(b.nbytes for b in batches) < lexical.HELD
    assert [sum(b.filter(pc.equal(b["path"], p)).num_rows for b in batches) for p in ("a.js", "b.js")] == [20_001, 20_001]


def test_brackets_in_brackets_take_time_in_proportion():
    """Blocks are found without a walk over the brackets that are open."""
    began = time.process_time()
    Tokens("(" * 40_000 + ")" * 40_000)
    assert time.process_time() - began < 3


USES = "import c from 'crypto';\nconst a = 'md5', b = a;\n// seal\nc.createHash(b);\nc.createHash(b);\nc.createECDH('prime256v1');\n"


def test_no_table_that_grows_is_broadcast(spark):
    """Small as the tables are here, words and findings are merged: a broadcast of them goes through the driver's memory at any size that Spark's estimate lets pass."""
    fact = settle(lexical.facts(spark.createDataFrame([("a.js", USES)], "path string, text string")))
    call, _ = detect.resolved(fact)
    out = detect.findings(settle(detect.node_crypto(call).select(*detect.FOUND)), lexical.words(fact))
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.line, r.algorithm, r.priority_word) for r in out.collect()) == [(4, "MD5", None), (5, "MD5", None), (6, "ECDH P-256", "seal")]
    wanted = scopes.resolve(fact, lexical.calls(fact)).named
    assert "BroadcastHashJoin" not in wanted._jdf.queryExecution().executedPlan().toString() and wanted.count() == 2


def test_calls_with_names_are_found_by_the_tables_parts(spark):
    """How many names a call asks for is a column of its own: a part of a table where none asks says so by its greatest value, and isn't read for them. Repeats are not looked for ahead of the exchange, which is one."""
    folder = settle(lexical.facts(spark.createDataFrame([("a.js", USES.replace("(b)", "('md5')"))], "path string, text string")))
    most = [m for f in folder.inputFiles() if (g := pq.ParquetFile(f.removeprefix("file:"))).metadata.num_row_groups for i in range(g.metadata.num_columns) if (m := g.metadata.row_group(0).column(i)).path_in_schema == "asks" and m.statistics.has_min_max]
    assert [m.statistics.max for m in most] == [0] and "GreaterThan(asks,0)" in lexical.calls(folder).where("asks > 0")._jdf.queryExecution().executedPlan().toString()
    found = detect.node_crypto(lexical.calls(folder).drop("asks")).select(*detect.FOUND)
    out = detect.findings(settle(found.union(found)), lexical.words(folder))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" not in plan and plan.count("Exchange hashpartitioning(file") == 1
    assert out.count() == 3
