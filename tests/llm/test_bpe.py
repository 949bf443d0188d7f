import base64
import hashlib
import random

import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

from cipherlode.llm import bpe

FILE = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(FILE, "rb"))}
PLAIN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def same(df):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    texts = df.select("doc_id", "text").collect()
    got = bpe.tokens(df, FILE, P.PATTERN).collect()
    expected = []
    for i, t in texts:
        ids = PLAIN.encode_ordinary(t or "")
        expected.append((i, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode()), ids, t or ""))
    key = lambda r: repr(tuple(r))
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)
    return len(got)


def test_odd_texts(odd, empty):
    assert same(odd) == 9
    assert same(empty) == 0


def test_table(spark, sf_dir):
    assert same(spark.read.parquet(f"{sf_dir}/documents.parquet")) >= 200


def test_random_bytes_and_long_pieces(spark):
    r = random.Random(1)
    texts = ["a" * 3000, "ab" * 2000, "中文" * 700, "!?" * 900, "\x1c\x1d\x85   x", "  \n\n  x  "]
    texts += ["".join(r.choice("ab é中😀'stve12 \n\t.,") for _ in range(r.randint(1, 80))) for _ in range(400)]
    same(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_decode_is_inverse_of_encode(spark, odd):
    back = bpe.tokens(odd, FILE, P.PATTERN).where("decoded IS NOT NULL")
    assert back.where(F.size("ids") != F.col("n_tokens")).count() == 0
