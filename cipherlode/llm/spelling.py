"""Spelling variant grouping: words one edit apart, by an inverted index of positional q-grams with a count filter."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from heapq import merge
from itertools import combinations, groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherlode.llm.text import alone, mix, only, settle

#: Letters of a gram, and codes of letters: the pads, a to z, and À to ÿ; other characters share these codes.
Q, CODES = 3, 92
#: Shortest word, least occurrences, and how many times a word its form occurs.
LEAST_LENGTH, LEAST_COUNT, TIMES = 5, 3, 2
#: The query misspells one in so many of a document's different runs.
MISSPELL = 97
#: Words that meet at one entry of the index; at more the entry is split by one more gram, up to MOST_GRAMS of them. Rows of the index that a task reads together.
ENTRY, MOST_GRAMS, ROWS = 4096, 4, 1 << 15
#: Of a task's counts, words at once; of a text, bytes and runs at once.
HELD, PIECE, RUNS = 1 << 18, 1 << 22, 1 << 20
_RUN, _CUT = re.compile(rb"(?:[A-Za-z]|\xC3[\x80-\xBF])+"), re.compile(rb"[\x00-@\[-`{-\x7F]")


def _runs(text: bytes) -> Iterator[list[bytes]]:
    """Lower-cased runs of letters, some at a time."""
    start = 0
    while start < len(text):
        end = len(text)
        if start + PIECE < end and (cut := _CUT.search(text, start + PIECE)):
            end = cut.start()
        found = (m.group() for m in _RUN.finditer(text, start, end)) if end - start > PIECE else iter(_RUN.findall(text[start:end].lower()))
        while some := list(islice(found, RUNS)):
            yield some if end - start <= PIECE else [r.lower() for r in some]
        start = end


def _planted(key: str, counts: Counter[bytes], misspell: int) -> Iterator[tuple[bytes, int]]:
    """What a document's runs count as: where the checksum of its key and the run divides by misspell, the run without one character."""
    before = zlib.crc32(f"{key}:".encode())
    for run, n in counts.items():
        if misspell and not (h := zlib.crc32(run, before)) % misspell:
            letters = run.decode()
            at = h % len(letters)
            run = (letters[:at] + letters[at + 1 :]).encode()
        yield run, n


def count_words(docs: DataFrame, key: str = "doc_id", text: str = "text", misspell: int = 0) -> DataFrame:
    """(word, n): runs of letters A-Z, a-z and À-ÿ of whole texts, A-Z lower-cased, that have LEAST_LENGTH characters and LEAST_COUNT occurrences.

    misspell: plants variants; the run r of document d loses the character at h % length
    where it divides h, the CRC-32 of "d:r". A null text has no words, a null key is the
    empty string, repeated rows count again, extra columns are left out. Tasks sum up before the shuffle.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("spelling")
        total: defaultdict[bytes, int] = defaultdict(int)

        def flush() -> pa.RecordBatch:
            kept = [(w, n) for w, n in total.items() if len(w) >= LEAST_LENGTH and len(w) - w.count(b"\xc3") >= LEAST_LENGTH]
            total.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.binary()).cast(pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

        for rows in batches:
            for name, body in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                counts: Counter[bytes] = Counter()
                for some in _runs(body or b""):
                    counts.update(some)
                for word, n in _planted(name or "", counts, misspell):
                    total[word] += n
                if len(total) >= HELD:
                    yield flush()
        yield flush()

    found = docs.select(F.col(key).cast("string").alias("key"), F.col(text).cast("binary").alias("text")).mapInArrow(counted, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _codes(words: list[str]) -> np.ndarray:
    """Of words of one length, the codes of their letters between Q - 1 pads at either end."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1).astype(np.int64)
    latin = (points >= 0xC0) & (points <= 0xFF)
    codes = np.where(latin, points - 0xC0 + 27, np.where((points >= 97) & (points <= 122), points - 96, points % (CODES - 2) + 1))
    return np.pad(codes, ((0, 0), (Q - 1, Q - 1)), constant_values=((0, 0), (0, CODES - 1)))


def grams(words: list[str]) -> np.ndarray:
    """The q-grams of words of one length; a column is a position."""
    codes = _codes(words)
    width = codes.shape[1] - Q + 1
    return sum(codes[:, i : i + width] * CODES ** (Q - 1 - i) for i in range(Q))


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    lengths = np.array([len(w) for w in words], np.int64)
    order = np.argsort(lengths, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
        if len(part):
            yield int(lengths[part[0]]), part


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    only("spelling")
    total = np.zeros(CODES**Q, np.int64)
    for rows in batches:
        words = rows.column(0).to_pylist()
        for _, part in _by_length(words):
            total += np.bincount(grams([words[i] for i in part]).ravel(), minlength=CODES**Q)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["gram", "n"])


def _ranks(vocabulary: DataFrame) -> np.ndarray:
    """Grams from the rarest up: a place for each of the CODES ** Q that there can be, whatever the corpus."""
    counts = np.zeros(CODES**Q, np.int64)
    for row in vocabulary.select("word").mapInArrow(_gram_counts, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[row["gram"]] = row["n"]
    ranks = np.empty(CODES**Q, np.int32)
    ranks[np.argsort(counts, kind="stable")] = np.arange(CODES**Q, dtype=np.int32)
    return ranks


def entries(words: list[str], ranks: np.ndarray, together: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(indices of words, their index entries, whether as the shorter of two) for every set of `together` grams that they are filed under.

    Two words one edit apart share all but Q of their grams, at equal positions if they
    are of one length; else those from the edit on stand one place later in the longer
    word. So of each word's rarest grams, as many as one edit can spoil and `together`
    more, they share `together`. A word is filed under its own length, and as the
    shorter one under the next length, for each place where the edit may be.
    """
    for length, part in _by_length(words):
        found = grams([words[i] for i in part])
        order = np.argsort(ranks[found], axis=1, kind="stable")
        for shorter in (False, True):
            rarest = np.sort(order[:, : Q + together - shorter], axis=1)
            for chosen in combinations(range(rarest.shape[1]), together):
                at = rarest[:, chosen]
                gram = np.take_along_axis(found, at, axis=1)
                for moved in range(together + 1) if shorter else [0]:
                    h = np.full(len(part), length + shorter, np.uint64)
                    for k in range(together):
                        place = at[:, k] + (k >= together - moved)
                        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + (gram[:, k] * 65536 + place).astype(np.uint64))
                    yield part, h.view(np.int64), shorter


def _filed(ranks: object, together: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("spelling")
        for rows in batches:
            for part in (rows.slice(i, 2048) for i in range(0, len(rows), 2048)):
                words = part.column(0).to_pylist()
                made = list(entries(words, ranks.value, together))
                if made:
                    at = pa.array(np.concatenate([x for x, _, _ in made]))
                    shorter = np.repeat([s for _, _, s in made], [len(x) for x, _, _ in made])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([h for _, h, _ in made])), pa.array(shorter), part.column(0).take(at), part.column(1).take(at)], ["entry", "shorter", "word", "n"])

    return file


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced character tells b from a, which is not the longer one."""
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a != b and (a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :])


def _short_lists(tokens: np.ndarray, lists: np.ndarray, sizes: np.ndarray, merged: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, size) of the posting lists of each row's `merged` rarest tokens. tokens: by row, token and place where it may stand."""
    at = np.minimum(np.searchsorted(lists, tokens), len(lists) - 1)
    size = np.where(lists[at] == tokens, sizes[at], 0)
    first = (np.cumsum(sizes) - sizes)[at]
    rarest = np.argpartition(size.sum(axis=2), merged - 1, axis=1)[:, :merged, None]
    return (np.take_along_axis(x, rarest, axis=1).reshape(len(tokens), -1) for x in (first, size))


def near_pairs(entry: np.ndarray, words: list[str], shorter: np.ndarray) -> Iterator[tuple[int, int]]:
    """Of words that meet at entries of one length, the pairs, by index, that are one edit apart; the first is not the longer one.

    Postings are ascending numbers of the longer words by entry, gram and position. A word
    near another shares all but Q of its grams with it, or all but Q - 1 as the shorter
    one, whose grams may stand one place later there. So of each word's lists the
    shortest Q + 1, or Q, are merged through a heap; what comes up in them is held
    against the count of all shared grams, and what is left is verified.
    """
    owners, shorts = np.flatnonzero(~shorter), np.flatnonzero(shorter)
    if not len(owners) or len(words) < 2:
        return
    own = grams([words[i] for i in owners])
    width = own.shape[1]
    token = lambda of, found, place: (np.unique(entry, return_inverse=True)[1][of][:, None] * (width + 1) + place) * CODES**Q + found
    own_tokens = token(owners, own, np.arange(width))
    lists, sizes = np.unique(own_tokens, return_counts=True)
    posted = np.argsort(own_tokens, axis=None, kind="stable") // width

    def merged(tokens: np.ndarray, few: int, after: bool) -> tuple[np.ndarray, np.ndarray]:
        """Rows and the numbers that come up in their `few` shortest lists; each list's hits are in order of both, so one heap merges them for all rows."""
        hits = []
        for first, size in zip(*(x.T for x in _short_lists(tokens, lists, sizes, few)), strict=True):
            row = np.repeat(np.arange(len(size)), size)
            number = posted[np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)]
            kept = number > row if after else slice(None)
            hits.append((row[kept] * len(owners) + number[kept]).tolist())
        pairs = np.fromiter((pair for pair, _ in groupby(merge(*hits))), np.int64)
        return pairs // len(owners), pairs % len(owners)

    a, b = merged(own_tokens[:, :, None], Q + 1, True)
    same = (own[a] == own[b]).sum(axis=1) >= width - Q
    yield from ((x, y) for x, y in zip(owners[a[same]].tolist(), owners[b[same]].tolist(), strict=True) if one_edit(words[x], words[y]))
    if len(shorts):
        less = grams([words[i] for i in shorts])
        places = np.arange(width - 1)
        a, b = merged(np.stack((token(shorts, less, places), token(shorts, less, places + 1)), axis=2), Q, False)
        same = ((less[a] == own[b][:, :-1]) | (less[a] == own[b][:, 1:])).sum(axis=1) >= width - Q
        yield from ((x, y) for x, y in zip(shorts[a[same]].tolist(), owners[b[same]].tolist(), strict=True) if one_edit(words[x], words[y]))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words sorted by entry -> pairs one edit apart, either way round. Holds some whole entries' words."""
    only("spelling")
    kept: list[pa.RecordBatch] = []

    def found(rows: pa.Table) -> pa.RecordBatch:
        entry, shorter, words, n = rows.column(0).to_numpy(), rows.column(1).to_numpy(), rows.column(2).to_pylist(), rows.column(3).to_numpy()
        length = np.array([len(w) for w in words], np.int64) + shorter
        _, at, size = np.unique(entry, return_inverse=True, return_counts=True)
        busy = size[at] > 1
        a, b = [], []
        for size in np.unique(length[busy]).tolist():
            at = np.flatnonzero(busy & (length == size))
            for x, y in near_pairs(entry[at], [words[i] for i in at], shorter[at]):
                a.append(at[x])
                b.append(at[y])
        left, right = np.array(a + b, np.int64), np.array(b + a, np.int64)
        column = rows.column(2).combine_chunks()
        return pa.RecordBatch.from_arrays([column.take(pa.array(left)), column.take(pa.array(right)), pa.array(n[right])], ["word", "near", "near_n"])

    for rows in batches:
        kept.append(rows)
        if sum(map(len, kept)) >= ROWS:
            table = pa.Table.from_batches(kept)
            entry = table.column(0).to_numpy()
            whole = int(np.searchsorted(entry, entry[-1]))
            if whole:
                yield found(table.slice(0, whole))
                kept = table.slice(whole).to_batches()
    if kept:
        yield found(pa.Table.from_batches(kept))


def near(vocabulary: DataFrame, entry: int = ENTRY, most_grams: int = MOST_GRAMS) -> DataFrame:
    """(word, near, near_n): pairs of different words one edit apart, each once from either side, of vocabulary (word, n).

    Words of under LEAST_LENGTH characters are left out. Entries where over `entry` words
    meet are set aside, and their words filed anew under one more gram, so a
    very common ending splits by what else the words share; at most_grams all
    entries are read. A broadcast table has a number for each possible gram, not each word.
    """
    spark = vocabulary.sparkSession
    words = vocabulary.where(F.length("word") >= LEAST_LENGTH).select("word", "n")
    ranks = spark.sparkContext.broadcast(_ranks(words))
    found: list[DataFrame] = []
    for together in range(1, most_grams + 1):
        filed = words.mapInArrow(_filed(ranks, together), "entry long, shorter boolean, word string, n long")
        if together < most_grams:
            filed = settle(filed)
            hot = settle(filed.groupBy("entry").agg(F.count("*").alias("size")).where(F.col("size") > entry).select("entry"))
            if hot.isEmpty():
                hot = None
        else:
            hot = None
        kept = filed if hot is None else filed.join(hot, "entry", "left_anti")
        found.append(kept.repartition("entry").sortWithinPartitions("entry").select("entry", "shorter", "word", "n").mapInArrow(_pairs, "word string, near string, near_n long"))
        if hot is None:
            break
        words = settle(filed.join(hot, "entry", "left_semi").select("word", "n").distinct())
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.union(more)
    return pairs.repartition("word").distinct()


def forms(vocabulary: DataFrame, pairs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of vocabulary (word, n) and its pairs (word, near, near_n).

    form: the near word that occurs most, of equals the first in the order of code
    points, if it occurs TIMES times as often as the word; root: the last word on the
    way from form to form. Roots are found by doubling, so a chain takes as many rounds as its length has digits.
    """
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    rows = vocabulary.join(best, "word", "left").withColumn("most", -F.col("best.less"))
    chosen = F.col("most") >= TIMES * F.col("n")
    rows = settle(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(chosen, F.col("best.near")).alias("form"), F.when(chosen, F.col("most")).alias("form_n")))
    links = settle(rows.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links, former = settle(links.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))), links
        if links.where("moved").isEmpty():
            break
        links = links.select("word", "root")
    return rows.join(former, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, some misspelt by rule, each with the form that it is a variant of."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")

    def build() -> DataFrame:
        vocabulary = settle(count_words(docs, misspell=MISSPELL))
        return forms(vocabulary, near(vocabulary))

    return alone(spark, build)


ORACLE = rf"""
WITH RECURSIVE
table_step(i, v, k) AS (SELECT i, i, 0 FROM range(256) t(i) UNION ALL SELECT i, xor(v >> 1, 3988292384 * (v & 1)), k + 1 FROM table_step WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY i) AS crc FROM table_step WHERE k = 8),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
counted AS (SELECT doc, run, count(*) AS n FROM runs GROUP BY 1, 2),
bytes AS (SELECT *, hex(encode(doc || ':' || run)) AS x FROM counted),
hashed AS (SELECT run, n, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(len(x) // 2), lambda k: CAST('0x' || x[2 * k + 1:2 * k + 2] AS BIGINT))), lambda a, b: xor(a >> 8, crc[1 + (xor(a, b) & 255)])), 4294967295) AS h FROM bytes, crc_table),
words AS (SELECT CASE WHEN h % {MISSPELL} = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n FROM hashed GROUP BY 1 HAVING sum(n) >= {LEAST_COUNT} AND length(word) >= {LEAST_LENGTH}),
shorter AS (SELECT word, n, i, word[1:i] || word[i + 2:] AS rest FROM (SELECT *, unnest(range(length(word))) AS i FROM words)),
near AS (SELECT a.word, b.word AS near, b.n AS near_n FROM shorter a JOIN shorter b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM shorter a JOIN words b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM shorter a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS most FROM near GROUP BY 1),
named AS (SELECT word, min(near) AS near FROM near JOIN best USING (word) WHERE near_n = most GROUP BY 1),
formed AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= {TIMES} * w.n THEN near END AS form, CASE WHEN most >= {TIMES} * w.n THEN most END AS form_n FROM words w LEFT JOIN best USING (word) LEFT JOIN named USING (word)),
way(word, root) AS (SELECT word, word FROM formed UNION ALL SELECT way.word, form FROM way JOIN formed ON formed.word = root WHERE form IS NOT NULL)
SELECT f.word, f.form, way.root, f.n, f.n_near, f.form_n FROM formed f JOIN way ON way.word = f.word JOIN formed last ON last.word = way.root AND last.form IS NULL"""
