"""What bounds the memory of an executor's Python workers and of the batches that they exchange with Spark."""

import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import DataFrame

import corpus_pipeline as pipeline
from cipherlode.llm import suffix, text

#: Nodes of a plan below which other tasks begin.
DEALT = ("Aggregate", "Deduplicate", "Distinct", "FlatMapGroupsInArrow", "Repartition", "RepartitionByExpression", "Window")


def python_steps(node) -> tuple[int, int]:
    """(Python steps of the tasks that make this node's rows, the most of any tasks of the plan)."""
    below = [python_steps(node.children().apply(i)) for i in range(node.children().size())]
    here = (node.nodeName() in ("MapInArrow", "FlatMapGroupsInArrow")) + (0 if node.nodeName() in DEALT else max([n for n, _ in below], default=0))
    return here, max([here, *(most for _, most in below)])


@pytest.fixture
def written(spark, monkeypatch):
    """The tables that are written, in order."""
    kind, found = type(spark.range(0)), []
    write = kind.write.fget
    monkeypatch.setattr(kind, "write", property(lambda self: found.append(self) or write(self)))
    return found


def test_tasks_of_the_pipeline_have_one_python_step(spark, written, tmp_path):
    """A second one takes a second Python worker for each core, which then stays with the executor."""
    r = random.Random(5)
    say = lambda n: " ".join(f"{r.choice('the cat sat on a mat while dogs ran'.split())}{r.randrange(30)}" for _ in range(n))
    item, passage = say(30), say(80)
    rows = [(i, f"{say(60)} {passage if i in (1, 2) else item if i == 3 else ''} {say(40)}", "en") for i in range(12)]
    rows.append((20, rows[5][1] + " tail", "en"))
    path = f"file://{tmp_path}"
    spark.createDataFrame([(i, t, lang, "web", len(t)) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    docs: DataFrame = spark.read.parquet(f"{path}/documents.parquet")
    written.clear()
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, path).write.parquet(f"{path}/{k}")
        docs = spark.read.parquet(f"{path}/{k}")
        steps = [python_steps(df._jdf.queryExecution().optimizedPlan())[1] for df in written]
        assert max(steps) == 1, (name, steps)
        written.clear()


def test_chunks_copy_one_slice_at_a_time():
    """Slices are the same whatever the column's type, nulls are empty, and a large batch is not copied whole."""
    assert list(text.chunks(pa.array(["ab", None, "c" * 9, "", "ü"]), 5)) == [(0, [b"ab", b""]), (2, [b"c" * 9]), (3, [b"", "ü".encode()])]
    assert list(text.chunks(pa.array([b"abc", b"d"], pa.large_binary()).slice(1), 5)) == [(0, [b"d"])] and not list(text.chunks(pa.array([], pa.string())))
    column = pa.array(["x" * 100_000] * 200)
    tracemalloc.start()
    try:
        assert sum(len(texts) for _, texts in text.chunks(column, 1 << 19)) == 200
        assert tracemalloc.get_traced_memory()[1] < 3_000_000
    finally:
        tracemalloc.stop()


def test_texts_that_are_left_come_in_small_batches():
    """Every row once and in order, however many a batch from Spark has."""
    n = 2 * suffix.ROWS + 7
    spans = pa.array([[{"a": 1, "z": 3}] if i % 2 else None for i in range(n)], pa.list_(pa.struct([("a", pa.int32()), ("z", pa.int32())])))
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([f"{i:05d}" for i in range(n)]), spans], ["key", "text", "spans"])
    out = list(suffix._rest(True, False)(iter([batch])))
    assert max(b.num_rows for b in out) <= suffix.ROWS
    got = pa.Table.from_batches(out)
    assert got.column("key").to_pylist() == list(range(n))
    assert got.column("kept").to_pylist() == [f"{i:05d}"[0] + f"{i:05d}"[3:] if i % 2 else f"{i:05d}" for i in range(n)]
