"""Document log-likelihood by a gated recurrent language model with a class-factored softmax.

Word counts come from all training documents. The frequent words form classes with a softmax each; all other
words form classes by their last two bytes, inside which a word's probability is its corpus count
(plus one) over the class's. A small gated recurrent network, trained by truncated
backpropagation on all training texts in parallel tasks whose weights are averaged, predicts class and
frequent word. State is carried across the windows of a document, so whole texts are scored.
"""

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tagmill.operators.common import materialize

from . import words

HEAD, PER_CLASS = 1024, 32
ENDINGS = 48
HIDDEN = 24
# Steps of a window, most lanes beside one another.
WINDOW, LANES = 16, 512
# States whose outputs are computed together in scoring.
SCORE_STATES = 16_384
# Tokens scored together: enough to fill the lanes, few enough for a task's memory.
SCORE_TOKENS = 1_500_000
# Words whose counts every task holds: at most this many.
TOP = 65_536
# Tokens of a training task and of a chunk in its memory; tasks grow with the corpus. Weights averaged at once.
TASK_TOKENS, CHUNK_TOKENS, FAN, ROUNDS = 2_000_000, 500_000, 16, 2
# Least updates a chunk is cut into, by taking fewer lanes: a small corpus has as many as a chunk of a large one.
UPDATES = 60
# Longer texts are trained in pieces of so many symbols, so that they do not leave the other lanes empty. Scoring takes them whole.
PIECE = 512
RATE = 0.05


def held_out(doc_id) -> Column:
    """crc32 of the id as text leaves 2 when divided by 7."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 7 == 2


def _endings(b: words.Block) -> np.ndarray:
    """The last two bytes of each word as a number."""
    last = b.data[b.ends - 1].astype(np.int64)
    before = np.where(b.ends - b.starts > 1, b.data[np.maximum(b.ends - 2, 0)], 0)
    return last << 8 | before


def word_counts(rows: DataFrame) -> DataFrame:
    """``w`` (hash of a lower-cased word), ``ending`` and ``c`` over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in words.blocks(batch.column(0), lower=True):
                h, at, c = np.unique(b.hashes(), return_index=True, return_counts=True)
                end = _endings(b)[at] if len(h) else at
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(end, pa.int32()), pa.array(c, pa.int64())], ["w", "ending", "c"])

    each = rows.select("text").mapInArrow(run, "w long, ending int, c long")
    return each.groupBy("w").agg(F.max("ending").alias("ending"), F.sum("c").alias("c"))


class Vocabulary:
    """What every task knows of the corpus: sizes bounded by ``TOP`` and the number of endings.

    Symbols: 0 is the end, 1 to HEAD - 1 frequent words, from HEAD on the classes of endings.
    """

    def __init__(self, counts: DataFrame, n_docs: int) -> None:
        total = counts.agg(F.count("*"), F.sum("c")).first()
        self.n, self.v = int(total[1] or 0) + n_docs, int(total[0]) + (1 if n_docs else 0)
        level = F.floor(F.log2("c") * 16)
        levels = sorted(((r[0], r[1]) for r in counts.groupBy(level.alias("l")).count().collect()), reverse=True)
        taken, lowest = 0, None
        for at, k in levels:
            if taken + k > TOP:
                break
            taken, lowest = taken + k, at
        top = counts.where(level >= (lowest if lowest is not None else 1 << 20)).collect()
        top.sort(key=lambda r: (-r["c"], r["w"]))
        self.lowest = lowest
        w = np.array([r["w"] for r in top], np.int64)
        c = np.array([r["c"] for r in top], np.int64)
        order = np.argsort(w)
        self.words, self.counts, self.rank = w[order], c[order], order
        self.end_count = n_docs
        head = top[: HEAD - 1]
        self.head_counts = np.concatenate(([n_docs], [r["c"] for r in head], np.zeros(HEAD - 1 - len(head)))).astype(float)
        # masses of endings over the words that are not in the head
        by_ending = {r["ending"]: [r["n"], r["k"]] for r in counts.groupBy("ending").agg(F.sum("c").alias("n"), F.count("*").alias("k")).collect()}
        for r in head:
            own = by_ending[r["ending"]]
            own[0], own[1] = own[0] - r["c"], own[1] - 1
        largest = sorted(by_ending, key=lambda e: (-by_ending[e][0], e))[: ENDINGS - 1]
        self.ending_class = np.full(1 << 16, ENDINGS - 1, np.int64)
        self.ending_class[largest] = np.arange(len(largest))
        self.tail_n, self.tail_v = np.zeros(ENDINGS), np.zeros(ENDINGS)
        for e, (n, k) in by_ending.items():
            self.tail_n[self.ending_class[e]] += n
            self.tail_v[self.ending_class[e]] += k

    def tables(self) -> dict:
        """The tables as plain arrays, to be broadcast."""
        return {k: v for k, v in vars(self).items() if k != "lowest"}


def look_up(v: dict, h: np.ndarray, endings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and count of each word; count -1 where it is not among the top words."""
    h = h.view(np.int64)
    if len(v["words"]):
        at = np.minimum(np.searchsorted(v["words"], h), len(v["words"]) - 1)
        hit = v["words"][at] == h
        rank, count = np.where(hit, v["rank"][at], TOP), np.where(hit, v["counts"][at], -1)
    else:
        rank, count = np.full(len(h), TOP), np.full(len(h), -1)
    return np.where(rank < HEAD - 1, rank + 1, HEAD + v["ending_class"][endings]), count


# ------------------------------------------------------------------ the network

CLASSES = HEAD // PER_CLASS + ENDINGS
SYMBOLS = HEAD + ENDINGS
# The last column of "c" and "w" is the bias. Values of a lane are a column, so that steps run along contiguous lanes.
_SHAPES = {"x": (3 * HIDDEN, SYMBOLS), "u": (3 * HIDDEN, HIDDEN), "c": (CLASSES, HIDDEN + 1), "w": (HEAD // PER_CLASS, PER_CLASS, HIDDEN + 1)}


def class_of(symbol: np.ndarray) -> np.ndarray:
    return np.where(symbol < HEAD, symbol // PER_CLASS, symbol - HEAD + HEAD // PER_CLASS)


def initial(vocabulary: Vocabulary, seed: int = 7) -> dict[str, np.ndarray]:
    """Small random weights; output biases are the corpus's own log frequencies."""
    rng = np.random.default_rng(seed)
    p = {k: rng.normal(0, 0.1, s).astype(np.float32) for k, s in _SHAPES.items()}
    head = vocabulary.head_counts + 1
    mass = np.concatenate((head.reshape(-1, PER_CLASS).sum(1), vocabulary.tail_n + 1))
    p["c"][:, -1] = np.log(mass / mass.sum())
    p["w"][:, :, -1] = np.log(head.reshape(-1, PER_CLASS) / head.reshape(-1, PER_CLASS).sum(1, keepdims=True))
    return p


def _sigmoid(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):  # far below zero it is zero
        return 1 / (1 + np.exp(-x))


def _step(p: dict, h: np.ndarray, symbol: np.ndarray):
    """The states (a column each) after the symbols, and what the gradient needs: gates, candidate and its state part."""
    a, q = p["x"].take(symbol, axis=1), p["u"] @ h
    zr = _sigmoid(a[: 2 * HIDDEN] + q[: 2 * HIDDEN])
    z, r = zr[:HIDDEN], zr[HIDDEN:]
    n = np.tanh(a[2 * HIDDEN :] + r * q[2 * HIDDEN :])
    return n + z * (h - n), z, r, n, q[2 * HIDDEN :]


def _softmax(weights: np.ndarray, h: np.ndarray, at: np.ndarray, gradient: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Logarithm of each column's softmax at one place and, if asked, its gradient; columns far from zero are shifted first."""
    x = weights[:, :-1] @ h
    x += weights[:, -1:]
    if max(x.max(initial=0), -x.min(initial=0)) > 60:
        x -= x.max(0)
    columns = np.arange(len(at))
    picked = x[at, columns]
    np.exp(x, out=x)
    total = x.sum(0)
    if gradient:
        x /= total
        x[at, columns] -= 1
    return picked - np.log(total), x if gradient else None


def _outputs(p: dict, h: np.ndarray, target: np.ndarray, grad: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log probability of class and, for frequent words, of the word in it, after states ``h``. With
    ``grad``, its output parts are added to and the gradient for h is returned."""
    k = class_of(target).astype(np.uint8)
    order = np.argsort(k, kind="stable")  # by class, those of frequent words first
    k, target, h = k[order], target[order], h.take(order, axis=1)
    logs, d = _softmax(p["c"], h, k, grad is not None)
    dh = None
    if grad is not None:
        grad["c"][:, :-1] += d @ h.T
        grad["c"][:, -1] += d.sum(1)
        dh = p["c"][:, :-1].T @ d
    edges = np.searchsorted(k, np.arange(HEAD // PER_CLASS + 1))
    inside = target % PER_CLASS
    for i in range(HEAD // PER_CLASS):
        at = slice(edges[i], edges[i + 1])
        if edges[i] == edges[i + 1]:
            continue
        own, d = _softmax(p["w"][i], h[:, at], inside[at], grad is not None)
        logs[at] += own
        if grad is not None:
            grad["w"][i, :, :-1] += d @ h[:, at].T
            grad["w"][i, :, -1] += d.sum(1)
            dh[:, at] += p["w"][i, :, :-1].T @ d
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return logs[back].astype(np.float64), None if dh is None else dh.take(back, axis=1)


def lanes(sequences: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """Sequences laid end to end in up to ``n`` lanes, the longest first to the shortest lane.
    Returns inputs and targets (steps x lanes, lanes by falling length; -1 is no target), where sequences
    begin, and (sequence, lane, first step) of each."""
    load = [(0, i) for i in range(max(1, min(n, len(sequences))))]
    placed: list[list[int]] = [[] for _ in load]
    for s in sorted(range(len(sequences)), key=lambda s: (-len(sequences[s]), s)):
        size, lane = heapq.heappop(load)
        placed[lane].append(s)
        heapq.heappush(load, (size + len(sequences[s]), lane))
    placed.sort(key=lambda own: -sum(len(sequences[s]) for s in own))
    steps = max((sum(len(sequences[s]) for s in own) for own in placed), default=0)
    target = np.full((steps, len(placed)), -1, np.int32)
    source = np.zeros((steps, len(placed)), np.int32)
    begin = np.zeros((steps, len(placed)), bool)
    where = []
    for lane, own in enumerate(placed):
        at = 0
        for s in own:
            x = sequences[s]
            target[at : at + len(x), lane] = x
            source[at + 1 : at + len(x), lane] = x[:-1]
            begin[at, lane] = True
            where.append((s, lane, at))
            at += len(x)
    return source, target, begin, where


def _started(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The states with those of lanes where a sequence begins set to zero."""
    return h * ~begin if begin.any() else h


def score_sequences(p: dict, sequences: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of the symbols of each sequence."""
    source, target, begin, where = lanes(sequences, LANES)
    logs = np.zeros(target.shape)
    h = np.zeros((HIDDEN, target.shape[1]), np.float32)
    hi = 0
    while hi < len(target):
        lo, live = hi, int((target[hi] >= 0).sum())  # lanes end in order
        hi = min(lo + max(WINDOW, SCORE_STATES // live), len(target))
        states = np.zeros((HIDDEN, hi - lo, live), np.float32)
        h = h[:, :live]
        for t in range(lo, hi):
            h = _step(p, _started(h, begin[t, :live]), source[t, :live])[0]
            states[:, t - lo] = h
        real = target[lo:hi, :live] >= 0
        states = states.reshape(HIDDEN, -1) if real.all() else states[:, real]
        logs[lo:hi, :live][real] = _outputs(p, states, target[lo:hi, :live][real])[0]
    total = np.concatenate((np.zeros((1, logs.shape[1])), np.cumsum(logs, 0)))
    out = np.zeros(len(sequences))
    for s, lane, at in where:
        out[s] = total[at + len(sequences[s]), lane] - total[at, lane]
    return out


def gradient(p: dict, h: np.ndarray, source: np.ndarray, target: np.ndarray, begin: np.ndarray) -> tuple[dict, np.ndarray, float]:
    """Of one window (steps x lanes) from states ``h``: the gradient of the negative log likelihood, the states after it and the log likelihood."""
    steps, live = source.shape
    kept, grad = [], {k: np.zeros_like(v) for k, v in p.items()}
    before, states, resets = (np.empty((HIDDEN, steps, live), np.float32) for _ in range(3))
    for t in range(steps):
        before[:, t] = h = _started(h, begin[t])
        new = _step(p, h, source[t])
        kept.append(new)
        states[:, t] = h = new[0]
        resets[:, t] = new[2]
    real = target >= 0
    if real.all():
        logs, out = _outputs(p, states.reshape(HIDDEN, -1), target.ravel(), grad)
        out = out.reshape(states.shape)
    else:
        logs, dh = _outputs(p, states[:, real], target[real], grad)
        out = np.zeros_like(states)
        out[:, real] = dh
    inputs = np.empty((3 * HIDDEN, steps, live), np.float32)
    recurrent = p["u"].T.copy()
    back = np.zeros_like(h)
    for t in range(steps - 1, -1, -1):
        _, z, r, n, qn = kept[t]
        d = out[:, t] + back
        rest = 1 - z
        dn = d * rest * (1 - n * n)
        inputs[:HIDDEN, t] = d * (before[:, t] - n) * z * rest
        inputs[HIDDEN : 2 * HIDDEN, t] = dn * qn * r * (1 - r)
        inputs[2 * HIDDEN :, t] = dn
        dq = np.concatenate((inputs[: 2 * HIDDEN, t], dn * r))
        back = _started(d * z + recurrent @ dq, begin[t])
    inputs = inputs.reshape(3 * HIDDEN, -1)
    at = source.ravel()
    for own, total in zip(inputs, grad["x"]):
        total[:] = np.bincount(at, own, SYMBOLS)
    inputs[2 * HIDDEN :] *= resets.reshape(HIDDEN, -1)
    grad["u"] += inputs @ before.reshape(HIDDEN, -1).T
    return grad, h, float(logs.sum())


class Trainer:
    """Weights and the moments of their gradients, carried from chunk to chunk of a task."""

    def __init__(self, p: dict, rate: float = RATE) -> None:
        self.p = {k: v.copy() for k, v in p.items()}
        self.first, self.second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
        self.rate, self.done = rate, 0

    def update(self, grad: dict, count: int) -> None:
        """One step by the mean gradient over ``count`` targets, of length 1 at most."""
        self.done += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values())) / count
        scale = min(1.0, 1.0 / (norm + 1e-9)) / count
        step = self.rate / (1 + self.done / 100)
        for k, g in grad.items():
            g *= scale
            self.first[k] += 0.1 * (g - self.first[k])
            g *= g
            self.second[k] += 0.01 * (g - self.second[k])
            self.p[k] -= step / (1 - 0.9**self.done) * self.first[k] / (np.sqrt(self.second[k] / (1 - 0.99**self.done)) + 1e-6)

    def train(self, sequences: list[np.ndarray]) -> "Trainer":
        """Truncated backpropagation, once over a chunk: windows of ``WINDOW`` steps over up to ``LANES``
        lanes, the state carried from one window to the next."""
        tokens = sum(map(len, sequences))
        if not tokens:
            return self
        pieces = [s[at : at + PIECE] for s in sequences for at in range(0, len(s), PIECE)]
        source, target, begin, _ = lanes(pieces, min(LANES, max(1, tokens // (WINDOW * UPDATES))))
        h = np.zeros((HIDDEN, target.shape[1]), np.float32)
        for lo in range(0, len(target), WINDOW):
            live = int((target[lo] >= 0).sum())
            at = (slice(lo, lo + WINDOW), slice(0, live))
            grad, h, _ = gradient(self.p, h[:, :live], source[at], target[at], begin[at])
            self.update(grad, int((target[at] >= 0).sum()))
        return self


def _symbols(vocabulary: dict, column) -> Iterator[tuple]:
    """Block, symbols and counts of its words."""
    for b in words.blocks(column, lower=True):
        h = b.hashes()
        symbols, counts = look_up(vocabulary, h, _endings(b) if len(h) else np.zeros(0, np.int64))
        yield b, h, symbols, counts


def _sequences(b: words.Block, symbols: np.ndarray) -> list[np.ndarray]:
    return [np.append(symbols[i:j], 0).astype(np.int32) for i, j in zip(b.first[:-1], b.first[1:])]


_WEIGHTS = "g int, n long, " + ", ".join(f"{k} binary" for k in _SHAPES)


def _row(g: int, n: int, p: dict) -> pa.RecordBatch:
    columns = [pa.array([g], pa.int32()), pa.array([n], pa.int64()), *[pa.array([p[k].astype(np.float32).tobytes()], pa.binary()) for k in _SHAPES]]
    return pa.RecordBatch.from_arrays(columns, ["g", "n", *_SHAPES])


def _mean(batches) -> tuple[int, dict | None]:
    """Tokens and the mean of weights, by tokens."""
    total, p = 0, None
    for b in batches:
        for r in b.to_pylist():
            own = {k: np.frombuffer(r[k], np.float32).reshape(s) for k, s in _SHAPES.items()}
            total += r["n"]
            p = own if p is None else {k: v + (own[k] - v) * (r["n"] / total) for k, v in p.items()}
    return total, p


def trained(rows: DataFrame, known, p: dict, number: int, tasks: int) -> DataFrame:
    """One row of weights per task (``g``, tokens ``n``, the weights) after training ``p`` on all of
    ``rows``, dealt by id so that copies of a text spread, chunk after chunk."""
    shared = rows.sparkSession.sparkContext.broadcast(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, total, held, size, g = Trainer(shared.value, RATE / (1 + number)), 0, [], 0, 0
        for batch in batches:
            g = batch.column(1)[0].as_py() if batch.num_rows else g
            for b, _, symbols, _ in _symbols(known.value, batch.column(0)):
                held += _sequences(b, symbols)
                size += len(symbols) + len(b.counts())
                if size >= CHUNK_TOKENS:
                    model.train(held)
                    total, held, size = total + size, [], 0
        model.train(held)
        total += size
        if total:
            yield _row(g, total, model.p)

    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.col("k").cast("string")), F.lit(2))
    dealt = rows.select("text", F.pmod(key, F.lit(1 << 30)).cast("int").alias("g"))
    return dealt.repartition(tasks, "g").mapInArrow(run, _WEIGHTS)


def averaged(found: DataFrame, n: int) -> dict | None:
    """The mean of at most ``n`` rows of weights: groups of about ``FAN`` by executors, the last ``FAN`` here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, total, p = 0, 0, None
        for b in batches:
            if not b.num_rows:
                continue
            g = b.column(0)[0].as_py()
            n, own = _mean([b])
            total += n
            p = own if p is None else {k: v + (own[k] - v) * (n / total) for k, v in p.items()}
        if p is not None:
            yield _row(g, total, p)

    found = materialize(found)
    while n > FAN:
        n = -(-n // FAN)
        found = materialize(found.repartition(n, F.xxhash64("g", F.lit(n))).mapInArrow(run, _WEIGHTS))
    rows = found.toArrow()
    return _mean(rows.to_batches())[1]


def shares(rows: DataFrame, rounds: int = ROUNDS) -> list[DataFrame]:
    """The training texts of each round; together they are all of them, each once."""
    part = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.col("k").cast("string")), F.lit(1)), F.lit(rounds))
    return [rows.where(part == i) for i in range(rounds)]


def fit(rows: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Weights from all training texts, each read once, whatever their number: dealt to tasks of about ``TASK_TOKENS``
    tokens, whose weights are averaged after each of ``rounds``."""
    p = initial(vocabulary)
    if not vocabulary.n:
        return p
    known = rows.sparkSession.sparkContext.broadcast(vocabulary.tables())
    tasks = -(-vocabulary.n // (rounds * TASK_TOKENS))
    for number, own in enumerate(shares(rows, rounds)):
        p = averaged(trained(own, known, p, number, tasks), tasks) or p
    return p


def score_documents(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score`` (log10 probability of the whole text, its end included).

    Null and empty texts are their end alone. Repeated rows are documents of their own, in the counts
    too. Without training documents every count is 0. An empty table gives an empty one; other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), held_out("doc_id").alias("held_out")).withColumn("k", F.xxhash64("doc_id", "text"))
    training = rows.where("not held_out")
    counts = materialize(word_counts(training))
    vocabulary = Vocabulary(counts, training.count())
    p = fit(training, vocabulary)
    spark = docs.sparkSession
    known, model = spark.sparkContext.broadcast(vocabulary.tables()), spark.sparkContext.broadcast(p)

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(1).to_numpy(zero_copy_only=False)
            for b, h, _, count in _symbols(known.value, batch.column(0)):
                at = np.flatnonzero(count < 0)
                owner = np.repeat(np.arange(b.lo, b.hi), b.counts())[at]
                order = np.lexsort((h[at], owner))
                w, o = h[at][order], owner[order]
                edge = np.flatnonzero(np.concatenate((np.ones(min(len(w), 1), bool), (w[1:] != w[:-1]) | (o[1:] != o[:-1]))))
                tf = np.diff(np.concatenate((edge, [len(w)])))
                yield pa.RecordBatch.from_arrays([pa.array(w[edge].view(np.int64)), pa.array(key[o[edge]], pa.int64()), pa.array(tf, pa.int32())], ["w", "k", "tf"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = known.value
        tail = np.concatenate((np.zeros(HEAD), np.log10(v["tail_n"] + v["tail_v"] + 1)))
        for batch in batches:
            held: list[tuple] = []  # blocks scored together, so that the lanes are full
            size = 0
            for b, _, symbols, count in _symbols(v, batch.column(0)):
                n = b.counts()
                logs = np.log10(np.maximum(count, 0) + 1.0)
                def per(x):  # noqa: E306
                    total = np.concatenate(([0.0], np.cumsum(x)))
                    return total[b.first[1:]] - total[b.first[:-1]]
                top = per(logs) + np.log10(v["end_count"] + 1.0)
                hits = per(count > 0).astype(np.int64) + (v["end_count"] > 0)
                inside = per(np.where(symbols < HEAD, 0.0, logs) - tail[symbols])
                held.append((b.lo, b.hi, _sequences(b, symbols), n + 1, hits, top, inside))
                size += len(symbols)
                if size >= SCORE_TOKENS:
                    yield scored_rows(batch, held)
                    held, size = [], 0
            if held:
                yield scored_rows(batch, held)

    def scored_rows(batch: pa.RecordBatch, held: list[tuple]) -> pa.RecordBatch:
        lo, hi = held[0][0], held[-1][1]
        lm = score_sequences(model.value, [s for x in held for s in x[2]]) / np.log(10)
        n, hits, top, inside = (np.concatenate([x[i] for x in held]) for i in (3, 4, 5, 6))
        own = [batch.column(i).slice(lo, hi - lo) for i in (1, 2, 3)]
        values = [pa.array(n, pa.int64()), pa.array(hits, pa.int64()), pa.array(top), pa.array(lm + inside)]
        return pa.RecordBatch.from_arrays([*own, *values], ["k", "doc_id", "held_out", "n_tokens", "hits", "top", "lm"])

    scored = materialize(rows.select("text", "k", "doc_id", "held_out").mapInArrow(score, "k long, doc_id long, held_out boolean, n_tokens long, hits long, top double, lm double"))
    seldom = rows.select("text", "k").mapInArrow(rare, "w long, k long, tf int")
    c = F.coalesce("c", F.lit(0))
    rest = seldom.join(counts.select("w", "c"), "w", "left").groupBy("k").agg(
        F.sum(F.col("tf") * F.log10(c + 1.0)).alias("rest"), F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("met")
    )
    copies = scored.groupBy("k").count()  # repeated rows share a key
    rest = copies.join(rest, "k", "left").select("k", F.coalesce(F.col("rest") / F.col("count"), F.lit(0.0)).alias("rest"), F.coalesce((F.col("met") / F.col("count")).cast("long"), F.lit(0)).alias("met"))
    joined = scored.join(rest, "k")
    base = F.col("top") + F.col("rest") - F.col("n_tokens") * F.lit(float(np.log10(vocabulary.n + vocabulary.v + 1)))
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("hits") + F.col("met")).alias("n_known"), F.lit(vocabulary.n).cast("long").alias("train_tokens"),
        base.alias("base_score"), (F.col("lm") + F.col("rest")).alias("score"),
    )
