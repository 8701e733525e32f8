"""Document log-likelihood under a gated recurrent language model.

Tokens are words (ASCII lower case) and one end for each text. Counts of all training tokens give the base model and the output classes.
Head words (the `head` most frequent; a bound) are broadcast with their counts; longer ones than 64 bytes never belong to the head. The model is a gated recurrent unit in numpy with a class-factored
softmax: P(token) = P(class | state) * P(token | class). The `modelled` most frequent words form classes whose word softmax depends on the state; the other head words
form classes by frequency and everything else forms the tail class, with smoothed counts within the class. So every text, also of unseen words, has a probability, and
the whole sums to one over the known words and one lump for unseen ones, as in the base model.

Learning: truncated backpropagation through windows of `steps` tokens with AdaGrad; first on the driver over about warm_docs documents drawn by
hash from all training rows, a start for all tasks; then every training document is learned from once, in parallel, and the tasks' parameters are averaged,
weighted by tokens. Small inputs use fewer tasks, so that each sees about trainer_tokens tokens or more. Class biases come from the counts of all
training documents. Documents lie end to end in the lanes of a batch, and the state is zero where one begins. Scoring carries the state across windows,
so a document's score is its complete log-likelihood.

Counts of words outside the head are joined by a sort-merge join: only a document's tail words are shuffled, as (row, word).

Defined cases: null or empty text is its end token alone; without training rows every token is unseen (N = V = 0; base log10(0.5 / 0.5) = 0) and score equals base_score; repeated rows are
scored alike; a null doc_id is in fold 0 and trains; other columns are ignored.
"""

from __future__ import annotations

import ctypes
import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import fold_of, stored, text_or_empty

END = b""  # no word is empty
LOG10 = math.log(10.0)
FIRST_SQUARE = 1e-5
#: So many tasks' models are averaged at a time.
FAN_IN = 64
#: Rarer words belong to the tail class, from which the model learns how often a word is rare or new.
MIN_HEAD_COUNT = 3


def tokens_of(text: str) -> list[bytes]:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    words.append(END)
    return words


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts, lower case, without ends, and each text's first place among them (one more than there are texts)."""
    # Lower case comes before the cast: on what a cast makes of a slice, ascii_lower returns other bytes.
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts).cast(pa.large_string())))
    words, offsets = lists.flatten(), np.asarray(lists.offsets, np.int64)
    offsets = offsets - offsets[0]
    real = np.asarray(pc.greater(pc.binary_length(words), 0))  # a text without words gives one empty word
    if not real.all():
        words, offsets = words.filter(pa.array(real)), np.r_[0, np.cumsum(real)][offsets]
    return words.cast(pa.large_binary()), offsets


def slices(batches, texts: int = 8192, size: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """Batches cut to so many rows and about so many bytes of their last column; a longer text is alone."""
    for batch in batches:
        ends = np.cumsum(np.asarray(pc.binary_length(batch.column(batch.num_columns - 1)), np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            end = max(at + 1, min(at + texts, int(np.searchsorted(ends, before + size))))
            yield batch.slice(at, end - at)
            at = end


_COUNTED = pa.schema([("word", pa.binary()), ("c", pa.int64())])


def _counted(words: list[pa.Array], ends: int) -> pa.RecordBatch:
    found = pc.value_counts(pa.chunked_array(words, pa.large_binary())).flatten()
    return pa.RecordBatch.from_arrays([pa.concat_arrays([found[0].cast(pa.binary()), pa.array([END], pa.binary())]), pa.concat_arrays([found[1], pa.array([ends], pa.int64())])], schema=_COUNTED)


def _count(batches, flush: int = 4_000_000):
    held, size, ends = [], 0, 0
    for batch in slices(batches):
        words, _ = words_of(batch.column(0))
        held.append(words)
        size, ends = size + len(words), ends + batch.num_rows
        if size > flush:
            yield _counted(held, ends)
            held, size, ends = [], 0, 0
    if ends:
        yield _counted(held, ends)


class Vocabulary:
    """Head words with counts, their classes, and totals. Ids: modelled words first, then other head words, last the tail."""

    def __init__(self, words: list[bytes], counts: list[int], total: int, distinct: int, modelled: int, static_classes: int):
        word_classes = max(1, math.isqrt(max(0, min(modelled, len(words)) - 1)) + 1)  # as many classes as words in each
        self.total, self.distinct = total, distinct
        self.words = words
        self.counts = np.array(counts, np.int64)
        self.modelled = m = min(modelled, len(words))
        self.tail = len(words)
        self.end = words.index(END) if END in words else self.tail
        self.listed = None
        self.tail_tokens, self.tail_words = total - int(self.counts.sum()), distinct - len(words)
        self.class_of = np.zeros(len(words) + 1, np.int64)
        self.width = max(1, -(-m // word_classes))
        self.n_word_classes = -(-m // self.width) if m else 0
        self.class_of[:m] = np.arange(m) // self.width
        rest = len(words) - m
        per = max(1, -(-rest // static_classes))
        self.class_of[m : len(words)] = self.n_word_classes + np.arange(rest) // per
        self.class_of[self.tail] = self.n_word_classes + (-(-rest // per) if rest else 0)
        self.n_classes = int(self.class_of[self.tail]) + 1
        mass = np.bincount(self.class_of, np.r_[self.counts + 0.5, self.tail_tokens + 0.5 * (self.tail_words + 1)], self.n_classes)
        self.class_log = np.log(mass / mass.sum())
        self.within = np.log((self.counts + 0.5) / mass[self.class_of[:-1]]) if len(words) else np.zeros(0)
        self.base = np.log10((self.counts + 0.5) / self.norm) if len(words) else np.zeros(0)
        # What the network reads: a modelled word, or the class of any other.
        self.n_inputs = m + self.n_classes
        self.input_of = np.where(np.arange(len(words) + 1) < m, np.arange(len(words) + 1), m + self.class_of)
        self.start = int(self.input_of[self.end])

    @property
    def norm(self) -> float:
        return self.total + 0.5 * (self.distinct + 1)

    @property
    def tail_norm(self) -> float:
        return self.tail_tokens + 0.5 * (self.tail_words + 1)

    def documents(self, texts: pa.Array) -> tuple[list[np.ndarray], pa.Array, np.ndarray]:
        """Ids of each text with its end, the words that are not in the head, and each text's first place among those."""
        words, offsets = words_of(texts)
        if self.listed is None:
            self.listed = pa.array(self.words, pa.large_binary())
        found = pc.index_in(words, value_set=self.listed)
        ids = np.asarray(pc.fill_null(found, self.tail), np.int64)
        tail = np.flatnonzero(ids == self.tail)
        ids = np.insert(ids, offsets[1:], self.end)
        ends = offsets[1:] + np.arange(1, len(offsets))
        return np.split(ids, ends[:-1]), words.take(pa.array(tail)), np.searchsorted(tail, offsets)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"listed": None}


def fresh(vocabulary: Vocabulary, hidden: int, seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    m, h, c = vocabulary.modelled, hidden, vocabulary.n_classes

    def small(*shape: int, scale: float = 0.1) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    return {
        "x": small(vocabulary.n_inputs, 3 * h, scale=0.3), "hzr": small(h, 2 * h), "hn": small(h, h), "b": np.r_[np.full(h, 1.0), np.zeros(2 * h)].astype(np.float32),
        "c": small(h, c), "cb": vocabulary.class_log.astype(np.float32), "w": small(m, h), "wb": vocabulary.within[:m].astype(np.float32),
    }


def run_window(p: dict, inputs: np.ndarray, begins: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, tuple]:
    """The state before the window and after each step (steps + 1, lanes, hidden), and what backpropagation needs. inputs and begins: (steps, lanes).

    A step reads the word before the one that it predicts. Where a document begins, the state before its first step is zero.
    """
    steps, lanes = inputs.shape
    h = state.shape[1]
    gates = p["x"][inputs] + p["b"]
    states, befores = np.empty((steps + 1, lanes, h), state.dtype), np.empty((steps, lanes, h), state.dtype)
    zrs, ns = np.empty((steps, lanes, 2 * h), gates.dtype), np.empty((steps, lanes, h), gates.dtype)
    fresh_at = begins.any(axis=1)
    states[0] = state
    for t in range(steps):
        if fresh_at[t]:
            state = np.where(begins[t][:, None], 0, state)
        befores[t] = state
        g, zr, n = gates[t], zrs[t], ns[t]
        np.matmul(state, p["hzr"], out=zr)
        zr += g[:, : 2 * h]
        zr *= 0.5
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        z, r = zr[:, :h], zr[:, h:]
        np.matmul(state * r, p["hn"], out=n)
        n += g[:, 2 * h :]
        np.tanh(n, out=n)
        state = states[t + 1] = n + z * (state - n)
    return states, (befores, zrs, ns)


def _exp(logits: np.ndarray, small: bool) -> np.ndarray:
    """exp in place, for softmax; logits that may be large are lowered by their rows' maxima, in place too."""
    if not small:
        logits -= logits.max(axis=1, keepdims=True)
    return np.exp(logits)


def _bounded(weights: np.ndarray, bias: np.ndarray, axis: int) -> bool:
    """Whether logits stay far from overflow for any state in [-1, 1]."""
    return bool((np.abs(weights).sum(axis=axis) + np.abs(bias)).max(initial=0.0) < 60)


def log_probs(p: dict, v: Vocabulary, states: np.ndarray, ids: np.ndarray, grads: dict | None = None, block: int = 1024) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log-probability of each id given its state (tail tokens: of the tail class); with grads, also the gradient on the states.

    Blocks of tokens keep the class softmax in the processor's cache.
    """
    classes = v.class_of[ids]
    out = np.empty(len(ids))
    back = None if grads is None else np.empty_like(states)
    small = _bounded(p["c"], p["cb"], 0)
    for at in range(0, len(ids), block):
        own, mine = states[at : at + block], classes[at : at + block]
        logits = own @ p["c"]
        logits += p["cb"]
        e = _exp(logits, small)
        s = e @ np.ones(e.shape[1], e.dtype)
        rows = np.arange(len(own))
        out[at : at + block] = logits[rows, mine] - np.log(s)
        if grads is not None:
            e /= s[:, None]
            e[rows, mine] -= 1
            grads["c"] += own.T @ e
            grads["cb"] += np.ones(len(e), e.dtype) @ e
            np.matmul(e, p["c"].T, out=back[at : at + block])
    modelled = ids < v.modelled
    static = ~modelled & (ids != v.tail)
    out[static] += v.within[ids[static]]
    order = np.flatnonzero(modelled)
    order = order[np.argsort(ids[order], kind="stable")]  # words of one class are neighbours
    if len(order):
        small = _bounded(p["w"], p["wb"], 1)
        own, sorted_states = classes[order], states[order]
        local = ids[order] - own * v.width
        picked, norms = np.empty(len(order), states.dtype), np.empty(len(order), states.dtype)
        returned = None if grads is None else np.empty_like(sorted_states)
        edges = np.r_[0, np.flatnonzero(own[1:] != own[:-1]) + 1, len(order)]
        every, ones = np.arange(int(np.diff(edges).max())), np.ones(max(v.width, len(order)), states.dtype)
        edges = edges.tolist()
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            first = int(own[a]) * v.width
            last = min(first + v.width, v.modelled)
            w, part, at, rows = p["w"][first:last], sorted_states[a:b], local[a:b], every[: b - a]
            logits = part @ w.T
            logits += p["wb"][first:last]
            e = _exp(logits, small)
            picked[a:b] = logits[rows, at]
            s = norms[a:b]
            np.matmul(e, ones[: last - first], out=s)
            if grads is not None:
                e /= s[:, None]
                e[rows, at] -= 1
                grads["w"][first:last] += e.T @ part
                grads["wb"][first:last] += ones[: b - a] @ e
                np.matmul(e, w, out=returned[a:b])
        out[order] += picked - np.log(norms)
        if grads is not None:
            back[order] += returned
    return out, back


@dataclass(frozen=True)
class Streams:
    """Whole documents laid end to end in lanes, fullest lane first: arrays (steps, lanes), -1 beyond a lane's end."""

    ids: np.ndarray
    number: np.ndarray
    begins: np.ndarray
    loads: np.ndarray

    def windows(self, steps: int) -> Iterator[tuple[slice, int]]:
        """(steps, live lanes) of each window."""
        for at in range(0, len(self.ids), steps):
            yield slice(at, min(at + steps, len(self.ids))), int(np.searchsorted(-self.loads, -at))


def streams_of(documents: list[np.ndarray], lanes: int) -> Streams:
    """Longest documents first, each to the lane with the fewest tokens."""
    order = sorted(range(len(documents)), key=lambda k: -len(documents[k]))
    held = [(0, k) for k in range(max(1, min(lanes, len(documents))))]
    queues: list[list[int]] = [[] for _ in held]
    for k in order:
        load, lane = held[0]
        queues[lane].append(k)
        heapq.heapreplace(held, (load + len(documents[k]), lane))
    held.sort(reverse=True)
    loads = np.array([load for load, _ in held])
    shape = (int(loads[0]), len(held))
    ids, number, begins = np.full(shape, -1, np.int32), np.full(shape, -1, np.int32), np.zeros(shape, bool)
    for column, (_, lane) in enumerate(held):
        at = 0
        for k in queues[lane]:
            end = at + len(documents[k])
            ids[at:end, column], number[at:end, column], begins[at, column] = documents[k], k, True
            at = end
    return Streams(ids, number, begins, loads)


def score_documents(p: dict, v: Vocabulary, documents: list[np.ndarray], lanes: int = 256, steps: int = 32) -> np.ndarray:
    """Natural log-likelihood of each document (ids), tail tokens counted by their class only."""
    if not documents:
        return np.zeros(0)
    streams = streams_of(documents, lanes)
    state = np.zeros((len(streams.loads), p["hn"].shape[0]), np.float32)
    previous = np.full(len(state), v.start)  # every text starts as after an end token
    total = np.zeros(len(documents))
    for window, live in streams.windows(steps):
        ids, begins = streams.ids[window, :live], streams.begins[window, :live]
        inputs = np.concatenate([previous[None, :live], v.input_of[ids[:-1]]])
        states, _ = run_window(p, np.where(begins, v.start, inputs), begins, state[:live])
        real = ids >= 0
        got, _ = log_probs(p, v, states[1:][real], ids[real])
        total += np.bincount(streams.number[window, :live][real], got, len(documents))
        state, previous = states[-1], v.input_of[ids[-1]]
    return total


def gradients(p: dict, v: Vocabulary, inputs: np.ndarray, begins: np.ndarray, ids: np.ndarray, state: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray]:
    """Gradients of a window's negative log-likelihood, those on the inputs' rows (steps, lanes, 3 hidden), and the last state."""
    states, kept = run_window(p, inputs, begins, state)
    steps, live, h = len(inputs), state.shape[0], state.shape[1]
    real = ids >= 0
    grads = {k: np.zeros_like(x) for k, x in p.items() if k != "x"}
    _, back = log_probs(p, v, states[1:][real], ids[real], grads)
    above = np.zeros((steps, live, h), states.dtype)
    above[real] = back
    carried = np.zeros((live, h), states.dtype)
    into = np.empty((steps, live, 3 * h), states.dtype)
    hn, hzr = np.ascontiguousarray(p["hn"].T), np.ascontiguousarray(p["hzr"].T)
    befores, zrs, ns = kept
    zs, rs = zrs[:, :, :h], zrs[:, :, h:]
    slopes, moves, gains = zrs * (1 - zrs), befores - ns, (1 - zs) * (1 - ns * ns)
    fresh_at = begins.any(axis=1)
    for t in range(steps - 1, -1, -1):
        g = into[t]
        carried += above[t]
        dn = carried * gains[t]
        drn = dn @ hn
        np.multiply(carried, moves[t], out=g[:, :h])
        np.multiply(drn, befores[t], out=g[:, h : 2 * h])
        g[:, : 2 * h] *= slopes[t]
        g[:, 2 * h :] = dn
        carried *= zs[t]
        drn *= rs[t]
        carried += drn
        carried += g[:, : 2 * h] @ hzr
        if fresh_at[t]:
            carried = np.where(begins[t][:, None], 0, carried)
    read, flat = befores.reshape(-1, h), into.reshape(-1, 3 * h)
    grads["hn"] += (befores * rs).reshape(-1, h).T @ flat[:, 2 * h :]
    grads["hzr"] += read.T @ flat[:, : 2 * h]
    grads["b"] += flat.sum(axis=0)
    return grads, into, states[-1]


def fresh_sums(p: dict) -> dict[str, np.ndarray]:
    """AdaGrad's squares before the first step; their start keeps first steps small."""
    return {k: np.full_like(x, FIRST_SQUARE) for k, x in p.items()}


def train_documents(p: dict, sums: dict, v: Vocabulary, documents: list[np.ndarray], lanes: int = 256, steps: int = 32, rate: float = 0.2) -> int:
    """One pass of truncated backpropagation with AdaGrad over all tokens, in place; how many tokens that were. sums: accumulated squares."""
    if not documents:
        return 0
    h = p["hn"].shape[0]
    streams, seen = streams_of(documents, lanes), 0
    state = np.zeros((len(streams.loads), h), np.float32)
    previous = np.full(len(state), v.start)
    for window, live in streams.windows(steps):
        ids, begins = streams.ids[window, :live], streams.begins[window, :live]
        inputs = np.where(begins, v.start, np.concatenate([previous[None, :live], v.input_of[ids[:-1]]]))
        grads, into, last = gradients(p, v, inputs, begins, ids, state[:live])
        n = int((ids >= 0).sum())
        seen += n
        scale = min(1.0, 5.0 / (1e-6 + math.sqrt(sum(float((g * g).sum()) for g in grads.values()) / max(1, n))))
        norm = np.float32(scale / len(streams.loads))  # windows of few live lanes count less
        for k, g in grads.items():
            g *= norm
            sums[k] += g * g
            p[k] -= rate * g / (np.sqrt(sums[k]) + 1e-6)
        order = np.argsort(inputs, axis=None, kind="stable")
        ordered = inputs.reshape(-1)[order]
        first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        rows = ordered[first]
        g = np.add.reduceat(into.reshape(-1, 3 * h)[order], first, axis=0) * norm
        sums["x"][rows] += g * g
        p["x"][rows] -= rate * g / (np.sqrt(sums["x"][rows]) + 1e-6)
        state, previous = last, v.input_of[ids[-1]]
    return seen


def packed(p: dict) -> np.ndarray:
    return np.concatenate([p[k].reshape(-1) for k in sorted(p)]).astype("<f4")


def unpacked(flat: np.ndarray, like: dict) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        size = like[k].size
        out[k] = flat[at : at + size].reshape(like[k].shape).astype(np.float32)
        at += size
    return out


def one_thread() -> None:
    """Keeps numpy's products of small matrices in the task's own thread: further threads of its library double the processor time and save none. Where the library is another one, nothing changes."""
    for path in (Path(np.__file__).parents[1] / "numpy.libs").glob("*openblas*"):
        library = ctypes.CDLL(str(path))
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                break


_PARTS = "slice int, many int, tokens long, parameters binary"
_PART_SCHEMA = pa.schema([("slice", pa.int32()), ("many", pa.int32()), ("tokens", pa.int64()), ("parameters", pa.binary())])


def _train(batches, shared, n_slices: int):
    """One model of all texts of a task, in slices; `many` groups tasks."""
    from pyspark import TaskContext

    one_thread()
    v, start, squares = shared.value
    p, sums = ({k: x.copy() for k, x in y.items()} for y in (start, squares))
    seen = 0
    for batch in slices(batches):
        seen += train_documents(p, sums, v, v.documents(batch.column(0))[0])
    if seen:
        parts = [x.tobytes() for x in np.array_split(packed(p), n_slices)]
        yield pa.RecordBatch.from_pydict({"slice": list(range(n_slices)), "many": [TaskContext.get().partitionId() // FAN_IN] * n_slices, "tokens": [seen] * n_slices, "parameters": parts}, schema=_PART_SCHEMA)


def _average(key, frame):
    """Mean of the parameters of one slice, weighted by tokens."""
    import pandas as pd

    total = 0.0
    for n, data in zip(frame["tokens"], frame["parameters"], strict=True):
        total = total + float(n) * np.frombuffer(data, "<f4").astype(float)
    tokens = int(frame["tokens"].sum())
    return pd.DataFrame({"slice": [key[0]], "many": [key[1] // FAN_IN], "tokens": [tokens], "parameters": [(total / tokens).astype("<f4").tobytes()]})


def vocabulary_of(counts: DataFrame, head: int, modelled: int, static_classes: int) -> Vocabulary:
    """counts: word, c."""
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    # Counts fall into at most 16 steps a doubling; the steps that fit into the head are taken whole.
    step = F.floor(F.log2(F.col("c")) * 16).cast("int")
    short = (F.octet_length("word") <= 64) & (F.col("c") >= MIN_HEAD_COUNT)
    sizes = sorted(((r["step"], r["count"]) for r in counts.where(short).groupBy(step.alias("step")).count().collect()), reverse=True)
    least, held = 1 << 30, 0
    for at, n in sizes:
        if held + n > head:
            break
        least, held = at, held + n
    taken = counts.where((short & (step >= least)) | (F.col("word") == F.lit(END))).toPandas()  # at most head + 1 words of 64 bytes
    pairs = sorted(zip(taken["c"].tolist(), map(bytes, taken["word"]), strict=True), key=lambda x: (-x[0], x[1]))
    return Vocabulary([w for _, w in pairs], [c for c, _ in pairs], int(total["n"]), int(total["v"]), modelled, static_classes)


_SCORED = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_head", pa.int64()), ("base", pa.float64()), ("log_p", pa.float64()), ("tail", pa.list_(pa.binary()))])
SCORED_DDL = "uid long, doc_id long, held_out boolean, n_tokens long, n_head long, base double, log_p double, tail array<binary>"


def _score(batches, shared):
    from pyspark import TaskContext

    one_thread()
    v, p = shared.value
    base = np.r_[v.base, 0.0]
    uid = TaskContext.get().partitionId() << 40
    for batch in slices(batches):
        documents, tail, places = v.documents(batch.column(2))
        n = batch.num_rows
        sizes = np.array([len(d) for d in documents])
        bases = np.add.reduceat(base[np.concatenate(documents)], np.r_[0, np.cumsum(sizes)[:-1]])  # a text has a token at least
        heads = sizes - np.diff(places) - (0 if v.end < v.tail else 1)
        tails = pa.ListArray.from_arrays(pa.array(places, pa.int32()), tail.cast(pa.binary()))
        columns = [pa.array(np.arange(uid, uid + n)), batch.column(0), batch.column(1), pa.array(sizes), pa.array(heads), pa.array(bases), pa.array(score_documents(p, v, documents)), tails]
        yield pa.RecordBatch.from_arrays(columns, schema=_SCORED)
        uid += n


def learned(training: DataFrame, v: Vocabulary, start: dict, sums: dict, trainer_tokens: int, n_slices: int = 16) -> tuple[dict, int]:
    """(parameters, tokens seen) after one pass over all training texts: the mean of the tasks' models, weighted by tokens."""
    shared = training.sparkSession.sparkContext.broadcast((v, start, sums))
    trainers = max(1, v.total // trainer_tokens)  # fewer tasks where a task's share of the texts would be too small to learn from
    models = training.select("text").coalesce(trainers).mapInArrow(partial(_train, shared=shared, n_slices=n_slices), _PARTS)
    means, groups = models, trainers
    while groups > 1 or means is models:  # a tree of means, FAN_IN models in each
        groups = -(-groups // FAN_IN)
        means = means.groupBy("slice", "many").applyInPandas(_average, _PARTS)
    means = means.collect()  # one model in n_slices rows
    if not means:
        return start, 0
    means.sort(key=lambda r: r["slice"])
    return unpacked(np.concatenate([np.frombuffer(r["parameters"], "<f4") for r in means]), start), means[0]["tokens"]


def score(docs: DataFrame, head: int = 200_000, modelled: int = 4096, hidden: int = 16, static_classes: int = 16, warm_docs: int = 400, trainer_tokens: int = 2_000_000) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, learned_tokens (seen by backpropagation)."""
    context = docs.sparkSession.sparkContext
    fold = fold_of(5)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold == 1).alias("held_out"), text_or_empty().alias("text"))
    training = rows.where("not held_out")
    counts = stored(training.select("text").mapInArrow(_count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "lm-counts")
    v = vocabulary_of(counts, head, modelled, static_classes)
    p, seen = fresh(v, hidden), 0
    sums = fresh_sums(p)
    if v.total:
        n_docs = int(v.counts[v.end])  # each training text has one end
        drawn = F.pmod(F.xxhash64("doc_id", "text", F.lit("warm")), F.lit(n_docs)) < warm_docs
        warm = [r["text"] for r in training.where(drawn).select("text").limit(2 * warm_docs).toLocalIterator()]  # more only where rows repeat
        train_documents(p, sums, v, v.documents(pa.array(warm, pa.string()))[0], lanes=32)
        p, seen = learned(training, v, p, sums, trainer_tokens)
    scored = stored(rows.mapInArrow(partial(_score, shared=context.broadcast((v, p))), SCORED_DDL), "lm-scored")
    known = scored.select("uid", F.explode("tail").alias("word")).join(counts, "word", "left")
    c = F.coalesce(F.col("c"), F.lit(0))
    per_row = known.groupBy("uid").agg(F.sum(F.log10(c + 0.5)).alias("tail_log"), F.count_if(c > 0).alias("tail_known"), F.count("*").alias("n_tail"))
    joined = scored.drop("tail").join(per_row, "uid", "left").fillna({"tail_log": 0.0, "tail_known": 0, "n_tail": 0})
    # Without training rows the end is in the tail, too, unseen.
    ends = F.lit(0 if v.end < v.tail else 1)
    n_tail = F.col("n_tail") + ends
    tail_log = F.col("tail_log") + ends * F.lit(math.log10(0.5))
    base = F.col("base") + tail_log - n_tail * F.lit(math.log10(v.norm))
    modelled_score = F.col("log_p") / F.lit(LOG10) + tail_log - n_tail * F.lit(math.log10(v.tail_norm))
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_head") + F.col("tail_known")).alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"),
        base.alias("base_score"), (modelled_score if v.total else base).alias("score"), F.lit(seen).cast("long").alias("learned_tokens"),
    )
