import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from cipherlode.llm import langid


def substrings(text):
    return {text[i:j] for i in range(len(text)) for j in range(i, len(text) + 1)}


def test_automaton_reads_exactly_the_substrings():
    text = [1, 2, 1, 1, 2, 3, 1, 2, 1]
    step = langid.suffix_automaton(text)
    words = {()}
    todo = [((), 0)]
    while todo:
        w, s = todo.pop()
        for c, to in step[s].items():
            words.add((*w, c))
            todo.append(((*w, c), to))
    assert words == {tuple(text[i:j]) for i in range(len(text)) for j in range(i, len(text) + 1)}


def test_phrases_against_plain_parse():
    samples = (("a", "the cat sat on the mat and the rat"), ("b", "el gato come la rata en la casa"))
    parser = langid.Parser(samples)
    texts = ["the gato sat", "zzz", "", "la casa the mat 99 el", "x" * 2500, "the rat sat on the casa " * 200, "the cat sat on the mat and the rat" * 150, "el" * 3000, "a" * 1024, "mat" * 400, "the cat " * 700, "catmat" * 999 + "the rat sat" * 300 + "z" * 2000]
    got = parser.phrases(texts)
    for k, text in enumerate(texts):
        plain = "".join(map(chr, langid._plain(text)))
        for j, (_, sample) in enumerate(samples):
            reference, n = substrings("".join(map(chr, langid._plain(sample)))), 0
            n, phrase = int(len(plain) > 0), ""
            for c in plain:
                if phrase + c in reference:
                    phrase += c
                else:
                    n, phrase = n + 1, c if c in reference else ""
            assert abs(got[k, j] - n * parser.bits[j] / max(1, len(plain))) < 1e-9


def test_blocks_that_never_meet_pass_their_state_on(monkeypatch):
    monkeypatch.setattr(langid, "BLOCK", 3)
    test_phrases_against_plain_parse()


def test_periodic_text_costs_no_more_than_twice_as_much():
    import time

    r = np.random.default_rng(1)
    words = ["".join(r.choice(list("etaoinshrd"), r.integers(2, 9))) for _ in range(3000)]
    sample = lambda n: " ".join(r.choice(words, n))
    parser = langid.Parser((("a", sample(3000)), ("b", "aaa " * 20 + sample(3000)), ("c", "a" * 700 + sample(1000))))
    took = []
    for text in (sample(170_000), "a" * 1_000_000, "ta" * 500_000, "sed " * 250_000):
        began = time.process_time()
        parser.phrases([text])
        took.append(time.process_time() - began)
    assert max(took[1:]) < 2 * took[0] + 1


def test_many_languages_with_large_alphabets_stay_small():
    r = np.random.default_rng(2)
    samples = tuple((str(k), "".join(map(chr, r.integers(0x4E00, 0x4E00 + 3000, 3000) + 3000 * (k % 5)))) for k in range(20))
    tracemalloc.start()
    parser = langid.Parser(samples)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 200e6
    assert [parser.langs[k] for k in np.argmin(parser.phrases([t for _, t in samples]), axis=1)] == [k for k, _ in samples]


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    out = langid.op6_language_id(spark, sf_dir.replace("0.001", "0.01")).join(docs.select("doc_id", "lang"), "doc_id")
    right, n = out.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 100 and right > 0.97
    assert out.where("score < 0 OR score > 1").count() == 0


def test_odd_texts(odd, empty):
    learned = (("en", "one two three four five same text here words"), ("es", "uno dos tres ñandú"))
    got = {(r.doc_id, r.lang_pred) for r in langid.predict(odd, learned).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (4, "en"), (7, "es")} <= got
    assert langid.predict(odd, learned, keep=("score", "key")).count() == 9
    assert {r.lang_pred for r in langid.predict(odd, ()).collect()} == {"und"}
    assert langid.predict(empty, learned).count() == 0
    assert langid.samples(empty.withColumn("lang", F.lit("en")), "lang", "doc_id", "text", F.lit(True)) == ()
