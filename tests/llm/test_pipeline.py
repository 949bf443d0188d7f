"""The pipeline's stages, each against what plain Python makes of the same documents."""

import hashlib
import random

import pytest

import corpus_pipeline as pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents in two languages with a near copy, a repeated passage, a benchmark passage, junk and nulls."""
    r = random.Random(9)
    english, german = ("the cat sat on mat and dog ran over hill with old red hat".split(), "der hund lief über die alte brücke und sah einen großen fisch im fluss".split())
    say = lambda words, n: " ".join(r.choice(words) + (str(r.randrange(40)) if r.random() < 0.4 else "") for _ in range(n))
    passage, item = say(english, 120), say(english, 30)
    rows = [(i, say(english if i % 2 else german, 80), "en" if i % 2 else "de") for i in range(30)]
    rows.append((100, rows[1][1] + " tail", "en"))
    rows += [(101, f"{say(english, 60)} {passage} {say(english, 60)}", "en"), (102, f"{say(english, 90)} {passage} {say(english, 30)}", "en")]
    rows += [(None, f"{say(english, 40)} {item} {say(english, 40)}", "en"), (103, f"{say(english, 50)} {item} {say(english, 50)}", "en"), (104, "12 34 !!", "en"), (105, None, "en"), (106, "", None)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, t, lang, "web", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"file://{path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"file://{path}/benchmark.parquet")
    return f"file://{path}", {i: t for i, t, _ in rows}, passage


def test_stages(spark, folder):
    sf_dir, texts, passage = folder
    docs, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        assert k == len(pipeline.STAGES) - 1 or out.columns == pipeline.COLUMNS
        out.write.parquet(f"{sf_dir}/stage-{k}")
        docs = spark.read.parquet(f"{sf_dir}/stage-{k}")
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
        assert docs.count() == len(kept[name])
    language, one, cut, clean, encoded = kept.values()
    assert set(texts) - set(language) == {104, 105, 106}
    assert all(language[i]["lang"] == ("en" if i % 2 else "de") for i in range(30))
    assert set(language) - set(one) == {100}
    assert set(cut) == set(one)
    for i in (101, 102):
        assert passage not in cut[i]["text"] and len(cut[i]["text"]) <= len(texts[i]) - len(passage)
    assert all(cut[i]["text"] == texts[i] for i in cut if i not in (101, 102))
    assert set(cut) - set(clean) == {103, None}
    assert set(encoded) == set(clean)
    assert all(r["decoded_sha256"] == hashlib.sha256(clean[i]["text"].encode()).hexdigest() and r["n_tokens"] == len(r["ids"]) for i, r in encoded.items())


def test_passages_of_over_50_words(spark, tmp_path):
    """They are cut where they repeat, though shorter than the 400 bytes of op2's contract; what is a word shorter stays."""
    r = random.Random(3)
    say = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6))) for _ in range(n))
    passages = {n: say(n) for n in (50, 51, 55, 59)}
    rows = [(2 * i + k, f"{say(80)} {p} {say(90)}") for i, p in enumerate(passages.values()) for k in (0, 1)] + [(100 + i, say(150)) for i in range(20)]
    assert all(len(p) < 400 for p in passages.values())
    spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/d")
    cut = {x.doc_id: x for x in pipeline.repeats(spark, spark.read.parquet(f"file://{tmp_path}/d"), "").collect()}
    for i, t in rows:
        p = [*passages.values()][i // 2] if 2 <= i < 100 else ""
        assert cut[i].text == (t.replace(f"{p} ", "") if p else t) and cut[i].n_chars == len(cut[i].text)
