"""LM scoring: a gated recurrent language model with a class-factored softmax, in numpy, over corpus-wide word counts."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherlode.llm.text import chunks, mix, settle, with_uid, words

#: Words that the network tells apart, the first two being any other word and the end; words in a class.
VOCABULARY, CLASS = 2048, 64
OTHER, END = 0, 1
HIDDEN, INPUT = 16, 16
#: The sample that the network starts from: documents whose key hashes lowest, up to so many characters.
TRAIN_DOCS, TRAIN_CHARS = 2000, 12_000
#: Then it learns from every training row: each in one of so many rounds, after which the tasks' weights are averaged.
ROUNDS = 4
#: Lanes of a task, tokens that it gathers for them, its first rate, and pieces in which weights are averaged.
TASK_LANES, TASK_TOKENS, TASK_RATE, PIECES = 256, 1 << 19, 0.003, 16
#: Lanes and window of truncated backpropagation, and steps of training.
LANES, WINDOW, STEPS, RATE = 64, 32, 500, 0.01
#: States whose probabilities are worked out at once; inputs gathered at once. These and PLAIN leave results as they are, but for rounding.
COLUMNS, GATHERED = 512, 2048
#: Logarithms that are surely within it are raised as they are, larger ones less their greatest.
PLAIN = 60
#: Steps of a scoring window; the state goes on from one window to the next.
SCORED = 256
#: Documents of one batch, and bytes of text for one bucket of word hashes.
BATCH_ROWS, BUCKET_BYTES = 4096, 16 << 20
#: Bytes of text that are hashed at once, so that a core's cache holds them.
HASHED = 1 << 17
END_HASH = mix(np.array([0xE0D], np.uint64))[0]

RESULT = "key {}, learned boolean, n_tokens long, n_known long, base_score double, score double"


class Counts(NamedTuple):
    """Of the training tokens: all, distinct, and the hashes and counts of the most frequent words."""

    tokens: int
    distinct: int
    top: np.ndarray
    top_counts: np.ndarray


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): each text's words and one end."""
    parts, sizes = [], [np.zeros(1, np.int64)]
    for _, some in chunks(pa.array(texts, pa.large_binary()), HASHED):
        found = words(some)
        first = found.first + np.arange(len(some) + 1)
        hashes = np.full(first[-1], END_HASH, np.uint64)
        own = np.ones(len(hashes), bool)
        own[first[1:] - 1] = False
        hashes[own] = found.hashes
        parts.append(hashes)
        sizes.append(np.diff(first))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.cumsum(np.concatenate(sizes))


def _texts(column: pa.ChunkedArray) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]


class Adam:
    """Running moments of the gradients of some weights, which each step changes in place."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w, self.n = weights, 0
        self.first, self.second = ({k: np.zeros_like(v) for k, v in weights.items()} for _ in range(2))

    def step(self, grad: dict[str, np.ndarray], rate: float) -> None:
        self.n += 1
        for k, g in grad.items():
            self.first[k] = 0.9 * self.first[k] + 0.1 * g
            self.second[k] = 0.99 * self.second[k] + 0.01 * g * g
            self.w[k] = (self.w[k] - rate * (self.first[k] / (1 - 0.9**self.n)) / (np.sqrt(self.second[k] / (1 - 0.99**self.n)) + 1e-8)).astype(np.float32)


def _rows(states: np.ndarray) -> np.ndarray:
    """(steps, HIDDEN, lanes) as a row for each step and lane, ended by a one for the bias."""
    out = np.ones((len(states), states.shape[2], HIDDEN + 1), np.float32)
    out[:, :, :HIDDEN] = states.transpose(0, 2, 1)
    return out.reshape(-1, HIDDEN + 1)


class Network:
    """A recurrent unit over word inputs; classes of words, then words of a class."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None):
        r = np.random.default_rng(17)
        near = lambda *s: (r.normal(size=s) / np.sqrt(s[-1])).astype(np.float32)
        self.w = weights or {
            "word": near(VOCABULARY, INPUT), "in": near(3 * HIDDEN, INPUT), "bias": np.zeros((3 * HIDDEN, 1), np.float32), "state": near(3 * HIDDEN, HIDDEN),
            "class": near(VOCABULARY // CLASS, HIDDEN), "class_bias": np.zeros(VOCABULARY // CLASS, np.float32), "out": near(VOCABULARY, HIDDEN), "out_bias": np.zeros(VOCABULARY, np.float32),
        }

    def run(self, ids: np.ndarray, fresh: np.ndarray, state: np.ndarray, keep: bool = False) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
        """States after each step of (steps, lanes) inputs, the last one, and what the way back needs."""
        h, (steps, lanes) = HIDDEN, ids.shape
        turned = np.repeat(np.float32([-1, 1]), (2 * h, h))[:, None]  # the two gates' inputs are negated once, in the weights
        table = np.ascontiguousarray((turned * (self.w["in"] @ self.w["word"].T + self.w["bias"])).T)
        weights, g = turned * self.w["state"], np.empty((3 * h, lanes), np.float32)
        g_gates, g_c = g[: 2 * h], g[2 * h :]
        n = steps if keep else 1
        before, gates, given, cs = (np.empty((n, k, lanes), np.float32) for k in (h, 2 * h, h, h))
        states, some, alive = np.empty((steps, h, lanes), np.float32), fresh.any(axis=1).tolist(), (~fresh).astype(np.float32)
        block = max(1, GATHERED // lanes)
        for first in range(0, steps, block):
            given_x = np.ascontiguousarray(table.take(ids[first : first + block], axis=0).transpose(0, 2, 1))
            for t, x_gates, x_c, out in zip(range(first, steps), given_x[:, : 2 * h], given_x[:, 2 * h :], states[first:], strict=False):
                k = t if keep else 0
                zr, c = gates[k], cs[k]
                if keep or some[t]:
                    state = np.multiply(state, alive[t], out=before[k])
                np.matmul(weights, state, out=g)
                np.add(x_gates, g_gates, out=zr)
                np.exp(zr, out=zr)
                np.add(zr, 1, out=zr)
                np.reciprocal(zr, out=zr)
                np.multiply(zr[h:], g_c, out=c)
                np.add(c, x_c, out=c)
                np.tanh(c, out=c)
                np.subtract(state, c, out=out)
                np.multiply(out, zr[:h], out=out)
                state = np.add(out, c, out=out)
                if keep:
                    given[k] = g_c
        return states, state.copy(), {"state": before, "gates": gates, "given": given, "c": cs} if keep else {}

    def log_prob(self, rows: np.ndarray, target: np.ndarray, grad: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log-probability of each target after its state (a row, ended by a one); with grad, adds gradients of the negative mean and returns the states'."""
        scale, group = np.float32(1 / max(1, len(target))), (target // CLASS).astype(np.uint8)
        order = np.argsort(group, kind="stable")
        x, target, group = rows.take(order, axis=0), target[order], group[order]
        cuts = np.searchsorted(group, np.arange(VOCABULARY // CLASS + 1)).tolist()
        log_p, back = np.zeros(len(target)), np.zeros((len(target), HIDDEN), np.float32) if grad is not None else None
        weights, safe = {}, {}
        for kind, n in (("class", VOCABULARY // CLASS), ("out", CLASS)):
            w, bias = self.w[kind], self.w[f"{kind}_bias"]
            weights[kind] = np.ascontiguousarray(np.column_stack((w, bias)).reshape(-1, n, HIDDEN + 1).transpose(0, 2, 1))
            safe[kind] = float((np.abs(bias) + np.abs(w).sum(axis=1)).max()) < PLAIN  # a state's entries lie between -1 and 1

        def choose(kind: str, k: int, a: int, z: int, chosen: np.ndarray) -> None:
            """Adds the log-probability of one of the rows of the k-th part of some weights, at the states a to z."""
            own, n = x[a:z], weights[kind].shape[2]
            p = own @ weights[kind][k]
            if not safe[kind]:
                p -= p.max(axis=1, keepdims=True)
            flat, at = p.ravel(), np.arange(0, p.size, n) + chosen
            picked = flat.take(at)
            np.exp(p, out=p)
            total = p @ np.ones(n, np.float32)
            log_p[a:z] += picked - np.log(total)
            if grad is not None:
                part = slice(k * n, (k + 1) * n)
                p *= (scale / total)[:, None]
                flat[at] -= scale
                slope = p.T @ own
                grad[kind][part] += slope[:, :HIDDEN]
                grad[f"{kind}_bias"][part] += slope[:, HIDDEN]
                back[a:z] += p @ self.w[kind][part]

        for a in range(0, len(target), COLUMNS):
            choose("class", 0, a, min(a + COLUMNS, len(target)), group[a : a + COLUMNS])
        for c in range(VOCABULARY // CLASS):
            for a in range(cuts[c], cuts[c + 1], COLUMNS):
                z = min(a + COLUMNS, cuts[c + 1])
                choose("out", c, a, z, target[a:z] - c * CLASS)
        out = np.empty_like(log_p)
        out[order] = log_p
        if back is not None:
            given = np.empty_like(back)
            given[order] = back
            back = given
        return out, back

    def gradients(self, ids: np.ndarray, fresh: np.ndarray, target: np.ndarray, state: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
        """Backpropagation that stops at the window's start; also the state to carry on, and the loss."""
        h, (steps, lanes), g = HIDDEN, ids.shape, {k: np.zeros_like(v) for k, v in self.w.items()}
        states, last, saved = self.run(ids, fresh, state, keep=True)
        logp, back = self.log_prob(_rows(states), target.ravel(), g)
        back = np.ascontiguousarray(back.reshape(steps, lanes, h).transpose(0, 2, 1))
        z, r, c = saved["gates"][:, :h], saved["gates"][:, h:], saved["c"]
        # slopes of a step, by blocks of rows: c, z, r, and c through r
        ahead, after, d_all = (np.empty((steps, n, h, lanes), np.float32) for n in (2, 2, 4))
        ahead[:, 0], ahead[:, 1] = (1 - z) * (1 - c * c), (saved["state"] - c) * z * (1 - z)
        after[:, 0], after[:, 1] = saved["given"] * r * (1 - r), r
        flat = d_all.reshape(steps, 4 * h, lanes)
        d_in, d_state = flat[:, : 3 * h], flat[:, h:]
        back_w, some, alive = np.ascontiguousarray(self.w["state"].T), fresh.any(axis=1).tolist(), (~fresh).astype(np.float32)
        d, through = np.zeros_like(state), np.empty_like(state)
        for t in range(steps - 1, -1, -1):
            d += back[t]
            own = d_all[t]
            np.multiply(ahead[t], d, out=own[:2])
            np.multiply(after[t], own[0], out=own[2:])
            d *= z[t]
            d += np.matmul(back_w, d_state[t], out=through)
            if some[t]:
                d *= alive[t]
        g["state"] += np.matmul(d_state, saved["state"].transpose(0, 2, 1)).sum(axis=0)
        turned = np.r_[h : 3 * h, :h]  # rows c, z, r as z, r, c
        g["bias"] += d_in.sum(axis=(0, 2))[turned, None]
        g["in"] += np.matmul(d_in, self.w["word"].take(ids, axis=0)).sum(axis=0)[turned]
        by_place = np.matmul(d_in.transpose(0, 2, 1), self.w["in"][np.r_[2 * h : 3 * h, : 2 * h]]).reshape(-1, INPUT)
        words = ids.ravel().astype(np.int16)
        order = np.argsort(words, kind="stable")
        words = words[order]
        lead = np.flatnonzero(np.diff(words, prepend=-1))
        g["word"][words[lead]] = np.add.reduceat(by_place[order], lead, axis=0)
        return g, last, -float(logp.mean())

    def train(self, streams: list[np.ndarray], frequency: np.ndarray) -> None:
        """Adam over windows of lanes; a lane is a run of documents, whose states start afresh. Biases start from the corpus's counts."""
        counts = frequency + 0.1
        groups = counts.reshape(-1, CLASS).sum(axis=1)
        self.w["class_bias"] = np.log(groups / groups.sum()).astype(np.float32)
        self.w["out_bias"] = np.log(counts / counts.sum()).astype(np.float32)
        tokens = np.concatenate(streams) if streams else np.zeros(0, np.int64)
        if not len(tokens):
            return
        tokens = np.resize(tokens, max(len(tokens), LANES * (WINDOW + 1)))
        length = len(tokens) // LANES
        target = tokens[: length * LANES].reshape(LANES, length).T
        given = np.concatenate((np.full((1, LANES), END), target[:-1]))
        state, at = np.zeros((HIDDEN, LANES), np.float32), 0
        adam = Adam(self.w)
        for step in range(1, STEPS + 1):
            if at + WINDOW > length:
                at, state = 0, np.zeros_like(state)
            part = slice(at, at + WINDOW)
            grad, state, _ = self.gradients(given[part], given[part] == END, target[part], state)
            at += WINDOW
            adam.step(grad, RATE * min(1, 2 * (1 - step / (STEPS + 1))))

    def learn(self, streams: Iterator[np.ndarray], rate: float) -> int:
        """One pass of Adam over every token of a run of streams, some at a time; how many there were. Documents go on from window to window of a lane."""
        adam, held, size, seen = Adam(self.w), [], 0, 0

        def pass_over(tokens: np.ndarray) -> None:
            lanes = min(TASK_LANES, -(-len(tokens) // (WINDOW * 32)))
            length = -(-len(tokens) // lanes)
            target = np.resize(tokens, lanes * length).reshape(lanes, length).T  # what the last lane lacks comes from the start
            given = np.concatenate((np.full((1, lanes), END), target[:-1]))
            state = np.zeros((HIDDEN, lanes), np.float32)
            for k in range(0, length, WINDOW):
                part = slice(k, k + WINDOW)
                grad, state, _ = self.gradients(given[part], given[part] == END, target[part], state)
                adam.step(grad, rate)

        for tokens in streams:
            for k in range(0, len(tokens), TASK_TOKENS):
                held.append(tokens[k : k + TASK_TOKENS])
                size, seen = size + len(held[-1]), seen + len(held[-1])
                if size >= TASK_TOKENS:
                    pass_over(np.concatenate(held))
                    held, size = [], 0
        if size:
            pass_over(np.concatenate(held))
        return seen

    def score(self, target: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Natural log-probability of every token of documents target[first[i]:first[i + 1]], each read from start to end.

        Documents queue up in lanes of about the longest one's length; the
        lanes step together and keep their state from window to window.
        """
        size = np.diff(first)
        n_lanes = int(min(1024, max(1, -(-len(target) // max(int(size.max(initial=1)), 4096)))))
        lanes: list[list[int]] = [[] for _ in range(n_lanes)]
        heap = [(0, k) for k in range(n_lanes)]
        for i in np.argsort(-size, kind="stable").tolist():
            total, k = heapq.heappop(heap)
            lanes[k].append(i)
            heapq.heappush(heap, (total + int(size[i]), k))
        places = [np.concatenate([np.arange(first[i], first[i + 1]) for i in lane]) if lane else np.zeros(0, np.int64) for lane in lanes]
        given = np.concatenate(([END], target[:-1]))
        given[first[:-1]] = END
        new = np.zeros(len(target), bool)
        new[first[:-1]] = True
        out, state = np.zeros(len(target)), np.zeros((HIDDEN, n_lanes), np.float32)
        for k in range(0, max(map(len, places)), SCORED):
            now = [p[k : k + SCORED] for p in places]
            steps = max(map(len, now))
            at = np.full((steps, n_lanes), -1)
            for lane, p in enumerate(now):
                at[: len(p), lane] = p
            real = at >= 0
            states, state, _ = self.run(np.where(real, given[at], END), real & new[at], state)
            out[at[real]] = self.log_prob(_rows(states)[real.ravel()], target[at[real]])[0]
        return out


def _batch(uid: str = "uid") -> Column:
    """Rows of one partition of the numbering, BATCH_ROWS at a time."""
    return (F.shiftright(uid, 33) * (1 << 22) + F.floor(F.col(uid).bitwiseAND(2**33 - 1) / BATCH_ROWS)).cast("long")


def _count(rows: DataFrame, n_buckets: int) -> DataFrame:
    """Corpus counts, in one exchange of each batch's distinct hashes.

    A bucket of hashes adds up all batches' counts and answers each batch with the
    totals in the order of that batch's hashes. A word, however
    frequent, is one entry a batch. Rows: batch >= 0: an answer; -1: tokens and
    distinct words of a bucket; -2: its most frequent words.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, seen, n = None, [], []

        def flush() -> Iterator[pa.RecordBatch]:
            if current is not None:
                hashes, at = np.unique(np.concatenate(seen), return_inverse=True)
                count = np.bincount(at, np.concatenate(n), len(hashes)).astype(np.int64)
                bucket = (hashes % np.uint64(n_buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
                some = np.flatnonzero(np.diff(cuts))
                parts = [order[cuts[b] : cuts[b + 1]] for b in some]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([current] * len(some), pa.int64()), pa.array([hashes[p].tobytes() for p in parts], pa.binary()), pa.array([count[p].astype(np.uint32).tobytes() for p in parts], pa.binary())], ["bucket", "batch", "hashes", "n"])

        for rows in batches:
            ids = np.asarray(rows.column(0))
            texts, learned = _texts(rows.column(2)), np.asarray(rows.column(1).cast(pa.int8()))
            cuts = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1 if len(ids) else 0)).tolist()
            for a, z in zip(cuts, [*cuts[1:], len(ids)], strict=True):
                if ids[a] != current:
                    yield from flush()
                    current, seen, n = int(ids[a]), [], []
                for k in range(a, z, 256):
                    hashes, first = _tokens(texts[k : min(z, k + 256)])
                    distinct, at = np.unique(hashes, return_inverse=True)
                    seen.append(distinct)
                    n.append(np.bincount(at, np.repeat(learned[k : min(z, k + 256)], np.diff(first)), len(distinct)))
        yield from flush()

    def add(table: pa.Table) -> pa.Table:
        bucket, batch = table.column("bucket")[0].as_py(), table.column("batch").to_pylist()
        sent = [np.frombuffer(b, np.uint64) for b in table.column("hashes").to_pylist()]
        hashes, at = np.unique(np.concatenate(sent), return_inverse=True)
        n = np.bincount(at, np.concatenate([np.frombuffer(b, np.uint32) for b in table.column("n").to_pylist()]), len(hashes)).astype(np.int64)
        of: dict[int, list[np.ndarray]] = {}
        for b, s in zip(batch, sent, strict=True):
            of.setdefault(b, []).append(s)  # a batch that two tasks read comes in two parts
        answers = [n[np.searchsorted(hashes, np.unique(np.concatenate(s)) if len(s) > 1 else s[0])] for s in of.values()]
        words_only = np.where(hashes == END_HASH, 0, n)
        top = np.argsort(-words_only, kind="stable")[:VOCABULARY]
        top = top[words_only[top] > 0]
        rows = [(b, bucket, a.astype(np.uint32 if a.max() < 2**32 else np.uint64).tobytes(), len(a), 0) for b, a in zip(of, answers, strict=True)]
        rows.append((-1, bucket, b"", int(n.sum()), int((n > 0).sum())))
        rows += [(-2, bucket, b"", int(hashes[t].astype(np.int64)), int(n[t])) for t in top]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()), strict=True)], ["batch", "bucket", "n", "a", "b"])

    sent = rows.select(_batch().alias("batch"), "learned", "text").mapInArrow(send, "bucket long, batch long, hashes binary, n binary")
    return settle(sent.groupBy("bucket").applyInArrow(add, "batch long, bucket long, n binary, a long, b long"))


def _learn_all(rows: DataFrame, weights: dict[str, np.ndarray], counts: Counts) -> dict[str, np.ndarray]:
    """Weights after every learned row, long or short, was passed over once.

    A round takes the rows whose keys hash to it; each task goes on from the last
    round's weights over its own rows, and the tasks' weights are averaged by their
    tokens. A task sends its weights once a round, whatever its rows.
    """
    shapes = {k: v.shape for k, v in weights.items()}

    def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
        cuts = np.cumsum([int(np.prod(s)) for s in shapes.values()])[:-1]
        return {k: x.reshape(s).astype(np.float32) for (k, s), x in zip(shapes.items(), np.split(flat, cuts), strict=True)}

    def add(table: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(table.column("task")))
        n, blobs = np.asarray(table.column("n"))[order], table.column("weights").to_pylist()
        total = sum(np.frombuffer(blobs[k], np.float32).astype(np.float64) * w for k, w in zip(order, n, strict=True))
        return pa.table({"piece": table.column("piece")[:1], "weights": pa.array([total.tobytes()], pa.binary()), "n": pa.array([int(n.sum())])})

    flat = np.concatenate([v.ravel() for v in weights.values()])
    for r in range(ROUNDS):
        start, rate = flat, TASK_RATE * (1 - r / ROUNDS)

        def learn(batches: Iterator[pa.RecordBatch], start: np.ndarray = start, rate: float = rate) -> Iterator[pa.RecordBatch]:
            task: list[int] = []

            def streams() -> Iterator[np.ndarray]:
                for batch in batches:
                    if len(batch) and not task:
                        task.append(batch.column(0)[0].as_py())
                    for _, texts in chunks(batch.column(1)):
                        yield _ids(_tokens(texts)[0], counts)

            net = Network(unpack(start))
            n = net.learn(streams(), rate)
            if n:
                parts = np.array_split(np.concatenate([net.w[k].ravel() for k in shapes]), PIECES)
                yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array(task * PIECES, pa.int64()), pa.array([n] * PIECES, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], ["piece", "task", "n", "weights"])

        mine = rows.where(F.col("learned") & (F.pmod(F.xxhash64("key"), F.lit(ROUNDS)) == r)).select("uid", "text")
        sums = mine.mapInArrow(learn, "piece int, task long, n long, weights binary").groupBy("piece").applyInArrow(add, "piece int, weights binary, n long").orderBy("piece").collect()  # PIECES rows
        if sums:
            flat = np.concatenate([np.frombuffer(x["weights"], np.float64) / x["n"] for x in sums]).astype(np.float32)
    return unpack(flat)


def score(docs: DataFrame, learn: Callable[[Column], Column], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, learned, n_tokens, n_known, train_tokens, base_score, score) for every row; learn says of the key which rows to learn from (null: no).

    Tokens are lower-cased A-Z words and one end a text; a null or empty text is the
    end alone. base_score adds log10((c + 1) / (N + V + 1)) with counts over every
    learned row. score is the network's log10-probability of the whole text, its state carried
    from the first word to the last: the class, then the word of the class, for the
    VOCABULARY most frequent words, learned from every learned row; for others the network's probability of any
    other word times (c + 1) / (N' + V' + 1), the counts of those others. Repeated
    rows and null keys give a row each, an empty table none; other columns are left
    out.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)[key]
    rows = with_uid(docs, key, text).withColumn("learned", F.coalesce(learn(F.col("key")), F.lit(False)))
    size = docs.agg(F.sum(F.octet_length(text) + 1)).first()[0] or 0
    n_buckets = max(1, -(-size // BUCKET_BYTES))
    table = _count(rows, n_buckets)
    tokens, distinct = (x or 0 for x in table.where("batch = -1").agg(F.sum("a"), F.sum("b")).first())
    top = table.where("batch = -2").orderBy(F.desc("b"), "a").limit(VOCABULARY - 2).select("a", "b").collect()
    counts = Counts(tokens, distinct, np.array([r[0] for r in top], np.int64).astype(np.uint64), np.array([r[1] for r in top], np.int64))
    few = rows.where("learned AND text IS NOT NULL").select(F.xxhash64("key", "text").alias("h"), "key", "uid").orderBy("h", "key", "uid").limit(TRAIN_DOCS)  # numbers first, then their texts
    chosen = rows.join(F.broadcast(few.select("uid", "h")), "uid").select("h", "key", F.left("text", F.lit(TRAIN_CHARS)).alias("text")).orderBy("h", "key", "text").select("text").collect()
    ends = rows.where("learned").count()
    frequency = np.zeros(VOCABULARY)
    frequency[[OTHER, END]] = max(0, tokens - ends - counts.top_counts.sum()), ends
    frequency[2 : 2 + len(counts.top)] = counts.top_counts
    net = Network()
    net.train([_ids(_tokens([r["text"].encode("utf-8")])[0], counts) for r in chosen], frequency)
    weights = _learn_all(rows, net.w, counts)
    answers = table.where("batch >= 0").select("batch", "bucket", "n", "a")

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        hashes, first = _tokens(_texts(left.column("text")))
        distinct, at = np.unique(hashes, return_inverse=True)
        bucket = (distinct % np.uint64(n_buckets)).astype(np.int64)
        c, order = np.zeros(len(distinct)), np.argsort(bucket, kind="stable")
        answered = sorted(zip(right.column("bucket").to_pylist(), right.column("n").to_pylist(), right.column("a").to_pylist(), strict=True))
        c[order] = np.concatenate([np.frombuffer(blob, np.uint32 if len(blob) == 4 * n else np.uint64).astype(np.float64) for _, blob, n in answered])
        base = np.log10((c + 1) / (counts.tokens + counts.distinct + 1))
        ids = _ids(distinct, counts)
        ends = distinct == END_HASH
        listed_n, listed = counts.top_counts.sum() + c[ends].sum(), len(counts.top) + (c[ends] > 0).sum()
        spelled = np.where(ids == OTHER, np.log10((c + 1) / (max(0, counts.tokens - listed_n) + max(0, counts.distinct - listed) + 1)), 0)
        logp = Network(weights).score(ids[at], first) / np.log(10) + spelled[at]
        total = lambda v: np.add.reduceat(v, first[:-1])
        return pa.Table.from_arrays([left.column("key").combine_chunks(), left.column("learned").combine_chunks(), pa.array(np.diff(first)), pa.array(total((c > 0)[at].astype(np.int64))), pa.array(total(base[at])), pa.array(total(logp))], ["key", "learned", "n_tokens", "n_known", "base_score", "score"])

    given = rows.select(_batch().alias("batch"), "key", "learned", "text")
    out = given.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(judge, RESULT.format(kind))
    return out.select(F.col("key").alias(key), "learned", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def _ids(hashes: np.ndarray, counts: Counts) -> np.ndarray:
    """Vocabulary numbers: END, the frequent words by rank, or OTHER."""
    order = np.argsort(counts.top)
    if len(order):
        at = np.minimum(np.searchsorted(counts.top[order], hashes), len(order) - 1)
        found = np.where(counts.top[order][at] == hashes, order[at] + 2, OTHER)
    else:
        found = np.full(len(hashes), OTHER)
    return np.where(hashes == END_HASH, END, found)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = score(docs, lambda k: F.crc32(k.cast("string")) % 7 != 2)
    return out.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
