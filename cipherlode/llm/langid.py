"""Language ID by cross-parsing: the language whose reference text parses a text into the fewest phrases."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from cipherlode.llm.text import chunks, only

#: Characters of reference text for a language, and documents that they may come from: the bound of the labelled sample.
SAMPLE_CHARS, SAMPLE_DOCS = 24_000, 24
#: A text is parsed in blocks of so many characters, side by side; what that changes at a block's start is put right after.
BLOCK = 1024
#: Rounds in which all blocks are put right together, and steps that a walk after them knows by heart.
ROUNDS, REMEMBERED = 2, 1 << 18
UNKNOWN = "und"


@functools.lru_cache(1)
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point, its lower case, 32 (a blank) for what isn't a letter; and whether it is a letter."""
    letter = np.array([chr(c).isalpha() for c in range(0x110000)])
    lower = np.full(0x110000, 32, np.uint32)
    lower[letter] = [ord(low) if len(low := chr(c).lower()) == 1 else c for c in np.flatnonzero(letter).tolist()]
    return lower, letter


def _plain(text: str) -> np.ndarray:
    """Lower-case letters, anything between them one blank."""
    codes = _characters()[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    return codes[~((codes == 32) & (np.concatenate(([0], codes[:-1])) == 32))]


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that reads every substring of text; state 0 starts."""
    step, link, size = [{}], [-1], [0]
    last = 0
    for c in text:
        new = len(step)
        step.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if size[p] + 1 == size[q]:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


class Parser:
    """The transitions of all languages' automata in one hash table, so that a step for all blocks and languages is a few look-ups.

    Its size follows the automata, not their alphabets.
    """

    def __init__(self, samples: tuple[tuple[str, str], ...]):
        self.langs = [lang for lang, _ in samples]
        plain = [_plain(t)[:SAMPLE_CHARS] for _, t in samples]
        letters = np.unique(np.concatenate([*plain, [32]])).astype(np.int64)
        self.symbol = np.zeros(0x110000, np.int32)
        self.symbol[letters] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        keys, targets, start = [], [], 0
        self.start, self.first = np.zeros(len(plain), np.int32), np.zeros((len(plain), self.width), np.int32)
        for k, text in enumerate(plain):
            step = suffix_automaton(self.symbol[text].tolist())
            keys.append(np.array([(start + s) * self.width + c for s, out in enumerate(step) for c in out], np.int64))
            targets.append(np.array([start + to for out in step for to in out.values()], np.int32))
            self.start[k] = start
            self.first[k] = start  # a phrase ends; the next starts with this character
            self.first[k, list(step[0])] = start + np.array(list(step[0].values()), np.int64)
            start += len(step)
        self._store(np.concatenate(keys), np.concatenate(targets))
        #: bits to name a place in the reference text
        self.bits = np.log2([max(2, len(t)) for t in plain])

    def _store(self, keys: np.ndarray, targets: np.ndarray) -> None:
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.targets = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = np.flatnonzero(self.keys[slot] < 0)
            self.keys[slot[free]] = keys[todo[free]]  # of several for one slot, one stays
            self.targets[slot[free]] = targets[todo[free]]
            out = self.keys[slot] != keys[todo]
            todo, slot = todo[out], (slot[out] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def step(self, state: np.ndarray, lang: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next state of each parse, and whether a phrase ended before this symbol."""
        key = state.astype(np.int64) * self.width + symbol
        slot = self._slot(key)
        there = self.keys[slot]
        look = np.flatnonzero((there != key) & (there >= 0))
        while len(look):
            slot[look] = (slot[look] + 1) & self.mask
            there[look] = self.keys[slot[look]]
            look = look[(there[look] != key[look]) & (there[look] >= 0)]
        ended = there != key
        return np.where(ended, self.first[lang, symbol], self.targets[slot]), ended

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases of each text for each language, times the bits to name one, by character.

        Blocks are parsed side by side, each as if a phrase started with it. Then every block is
        parsed again from the state in which the one before it ended, until both parses end a phrase
        at the same character: from there on they are the same. A block where that never
        happens passes its new last state on to the next one, which after ROUNDS such rounds
        one walk does. So the result is that of whole texts.
        """
        plain = [_plain(t) for t in texts]
        owner = np.repeat(np.arange(len(plain)), [-(-len(p) // BLOCK) for p in plain])
        out = np.zeros((len(texts), len(self.langs)))
        if not len(owner):
            return out
        lead = np.flatnonzero(np.diff(owner, prepend=-1))
        nth = np.arange(len(owner)) - np.repeat(lead, np.diff(np.append(lead, len(owner))))
        size = np.minimum(BLOCK, np.array([len(p) for p in plain])[owner] - nth * BLOCK)
        codes = np.zeros((int(size.max()), len(owner)), np.int32)
        for b, (k, i) in enumerate(zip(owner.tolist(), nth.tolist(), strict=True)):
            codes[: size[b], b] = self.symbol[plain[k][i * BLOCK : (i + 1) * BLOCK]]
        lang, block = np.repeat(np.arange(len(self.langs)), len(owner)), np.tile(np.argsort(-size, kind="stable"), len(self.langs))
        n, n_langs = len(owner), len(self.langs)
        last = np.zeros((n_langs, n), np.int32)
        ended = np.zeros((len(codes), n_langs, n), bool)
        order = block[:n]
        state = np.repeat(self.start[:, None], n, axis=1)
        alive = np.searchsorted(-size[order], -np.arange(len(codes)), side="left")
        for k in range(len(codes)):
            m = alive[k]
            symbol = np.broadcast_to(codes[k, order[:m]], (n_langs, m)).ravel()
            to, end = self.step(state[:, :m].ravel(), np.repeat(np.arange(n_langs), m), symbol)
            state[:, :m], ended[k, :, order[:m]] = to.reshape(n_langs, m), end.reshape(n_langs, m).T
        last[:, order] = state
        total = ended.sum(axis=0, dtype=np.int64)
        lang, block = (x.ravel() for x in np.meshgrid(np.arange(n_langs), np.flatnonzero(nth > 0), indexing="ij"))
        for _ in range(ROUNDS):
            if not len(block):
                break
            now, changed = last[lang, block - 1], []
            for k in range(len(codes)):
                full = size[block] == k
                if full.any():  # never met: the state at the end is another
                    new = full & (last[lang, block] != now)
                    last[lang[new], block[new]] = now[new]
                    changed.append((lang[new], block[new] + 1))
                    lang, block, now = lang[~full], block[~full], now[~full]
                if not len(block):
                    break
                now, end = self.step(now, lang, codes[k, block])
                was = ended[k, lang, block]
                np.add.at(total, (lang, block), end.astype(np.int64) - was)
                ended[k, lang, block] = end
                apart = ~(end & was)
                lang, block, now = lang[apart], block[apart], now[apart]
            if len(block):
                new = last[lang, block] != now
                last[lang[new], block[new]] = now[new]
                changed.append((lang[new], block[new] + 1))
            lang, block = (np.concatenate([c[i] for c in changed]) if changed else np.zeros(0, np.int64) for i in (0, 1))
            within = block < n
            lang, block = lang[within], block[within]
            within = nth[block] > 0
            lang, block = lang[within], block[within]
        self._settle(set(zip(lang.tolist(), block.tolist(), strict=True)), codes, size, nth, last, ended, total)
        np.add.at(out, owner, total.T)
        out[owner[lead]] += 1  # the first phrase
        return out * self.bits / np.maximum(1, [len(p) for p in plain])[:, None]


    def _settle(self, open_: set[tuple[int, int]], codes: np.ndarray, size: np.ndarray, nth: np.ndarray, last: np.ndarray, ended: np.ndarray, total: np.ndarray) -> None:
        """Parse what blocks are still open (language, block), and those after them that change, once each from left to right.

        Such texts repeat themselves, since their phrases end at other places than those of
        the parse before, time after time: a block that was read from a state before has its outcome by heart.
        """
        reached: dict[int, int] = {}
        outcomes: dict[tuple[int, int, bytes], tuple[int, int]] = {}
        steps: dict[tuple[int, int], tuple[int, bool]] = {}
        for lang, block in sorted(open_):
            if block <= reached.get(lang, -1):
                continue
            while True:
                state, content = int(last[lang, block - 1]), codes[: size[block], block]
                known = (lang, state, content.tobytes())
                if known not in outcomes:
                    outcomes[known] = self._walk(lang, state, content.tolist(), ended[:, lang, block], int(last[lang, block]), steps)
                new, total[lang, block] = outcomes[known]
                same, last[lang, block] = new == last[lang, block], new
                reached[lang] = block
                block += 1
                if block == len(size) or nth[block] == 0 or (same and (lang, block) not in open_):
                    break

    def _walk(self, lang: int, state: int, symbols: list[int], before: np.ndarray, end: int, steps: dict[tuple[int, int], tuple[int, bool]]) -> tuple[int, int]:
        """(last state, phrases ended) of one block; where a phrase ends as in the parse before, the rest is that parse's."""
        was, count = before.tolist(), 0
        for k, symbol in enumerate(symbols):
            key = state * self.width + symbol
            if (found := steps.get((lang, key))) is None:
                slot, mask = ((key * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> int(self.shift), self.mask
                while (there := int(self.keys[slot])) not in (key, -1):
                    slot = (slot + 1) & mask
                found = steps[lang, key] = (int(self.targets[slot]), False) if there == key else (int(self.first[lang, symbol]), True)
                if len(steps) > REMEMBERED:
                    steps.clear()
            state, over = found
            count += over
            if over and was[k]:
                return end, count + sum(was[k + 1 : len(symbols)])
        return state, count


@functools.lru_cache(1)
def _parser(samples: tuple[tuple[str, str], ...]) -> Parser:
    return Parser(samples)


def samples(df: DataFrame, lang: str, key: str, text: str, learn: Column) -> tuple[tuple[str, str], ...]:
    """Reference text of each language: SAMPLE_CHARS at most, of the SAMPLE_DOCS labelled rows whose key hashes lowest."""
    rows = df.where(learn & F.col(lang).isNotNull() & (F.length(F.coalesce(F.col(text), F.lit(""))) > 0))
    rows = rows.select(F.col(lang).alias("lang"), F.xxhash64(key).alias("h"), F.substring(text, 1, SAMPLE_CHARS).alias("t"))
    first = rows.withColumn("r", F.row_number().over(W.Window.partitionBy("lang").orderBy("h", "t"))).where(F.col("r") <= SAMPLE_DOCS)
    found: dict[str, str] = {}
    for row in first.orderBy("lang", "r").collect():
        found[row["lang"]] = f"{found.get(row['lang'], '')} {row['t']}"
    return tuple(found.items())


def predict(df: DataFrame, learned: tuple[tuple[str, str], ...], key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, keep..., lang_pred, score) for every row; the languages are those of learned.

    lang_pred is und with a score of 0 where the text is null, empty or without a
    letter, or nothing was learned; ties go to the first language by name. The score is the runner-up's
    share of the two best costs. Whole texts of any length are parsed; repeated rows
    and null keys give a row each; an empty table none. Columns not named are left
    out. A projection of the scan; no shuffle.
    """
    kinds = {c: df.schema[c].dataType.simpleString() for c in (key, *keep)}

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("langid", _parser.cache_clear)
        letter = _characters()[1]
        parser = _parser(learned) if learned else None
        for batch in batches:
            for first, raw in chunks(batch.column(batch.num_columns - 1)):
                texts = [t.decode("utf-8", "replace") for t in raw]
                has = [bool(letter[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)].any()) for t in texts]
                langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
                if parser:
                    cost = parser.phrases(texts)
                    ranked = np.sort(cost, axis=1)
                    best = np.argmin(cost, axis=1)
                    langs = [parser.langs[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)]
                    second = ranked[:, min(1, ranked.shape[1] - 1)]
                    scores = np.where(has, second / np.maximum(second + ranked[:, 0], 1e-300), 0.0)
                kept = [c.slice(first, len(texts)) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names[:-1], "lang_pred", "score"])

    columns = [F.col(c).alias(f"c{i}") for i, c in enumerate((key, *keep))]
    out = df.select(*columns, F.col(text).alias("t")).mapInArrow(classify, ", ".join(f"c{i} {t}" for i, t in enumerate(kinds.values())) + ", lang_pred string, score double")
    return out.toDF(key, *keep, "lang_pred", "score")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    learned = samples(docs, "lang", "doc_id", "text", ~held_out)
    return predict(docs, learned).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
