"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of a bounded sample of labelled rows: at most about rows_per_lang documents of each
language (a documented parameter), drawn by a hash of doc_id, so the model's cost is the same at every size. The log-probability matrix
has n_buckets x languages floats, a bound that doesn't grow with the documents, and is broadcast. Every document
is scored over its whole text in numpy, in chunks, so a very long text needs no more memory than a chunk.

Defined cases: text that is null or has no letter gives `und` and 0; with no labelled row everything is `und`; ties between languages
go to the first in sorted order; repeated rows are scored alike; a null doc_id is learned from and scored as fold 0;
other columns of the input are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import fold_of, free_name

ORDERS = (1, 2, 3)
N_BUCKETS = 1 << 16
CHUNK = 1 << 19
UNDETERMINED = "und"
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point: whether it is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def code_points(text: str) -> np.ndarray:
    """Lower-cased code points; every other run than letters is one 0, also before and after."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(letters()[points], points, 0).astype(np.uint32)
    if not len(points):
        return np.zeros(1, np.uint32)
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 0) | (points[:-1] != 0)
    return np.concatenate([np.zeros(int(points[0] != 0), np.uint32), points[keep], np.zeros(int(points[-1] != 0), np.uint32)])


def grams(points: np.ndarray, n_buckets: int) -> list[tuple[int, np.ndarray]]:
    """(order, bucket of the n-gram that starts at each position but the last order - 1)."""
    out, state = [], None
    for order in ORDERS:
        part = points[order - 1 :] if order > 1 else points
        with np.errstate(over="ignore"):
            state = (part + np.uint32(order)) * np.uint32(2654435761) if state is None else (state[: len(part)] ^ (state[: len(part)] >> np.uint32(15))) * np.uint32(2246822519) + part * np.uint32(3266489917) + np.uint32(order)
            mixed = (state ^ (state >> np.uint32(13))) * np.uint32(1274126177)
        out.append((order, (mixed >> np.uint32(8)) & np.uint32(n_buckets - 1)))
    return out


def chunks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(code points, number of the text of each, whether n-grams may start there) for up to about CHUNK code points.

    A longer text comes in parts that overlap by the longest n-gram but one; an n-gram is counted in the part in which it starts.
    """
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size, overlap = 0, ORDERS[-1] - 1

    def joined():
        return tuple(np.concatenate(x) for x in zip(*held, strict=True))

    for n, text in enumerate(texts):
        points = code_points(text or "")
        for at in range(0, max(1, len(points)), CHUNK):
            part = points[at : at + CHUNK + overlap]
            held.append((part, np.full(len(part), n, np.int32), np.arange(len(part)) < CHUNK))
            size += len(part)
            if size >= CHUNK:
                yield joined()
                held, size = [], 0
    if held:
        yield joined()


def per_text(texts: list[str | None], n_buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, text number) of all n-grams within texts, each once."""
    for points, owner, starts in chunks(texts):
        for order, bucket in grams(points, n_buckets):
            inside = starts[: len(bucket)] & (owner[: len(bucket)] == owner[order - 1 :] if order > 1 else points != 0)
            yield bucket[inside], owner[: len(bucket)][inside]


def _count(batches, n_buckets: int):
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        names = sorted(set(langs))
        code = np.array([names.index(x) for x in langs])
        for name in names:
            counts.setdefault(name, np.zeros(n_buckets, np.int64))
        for bucket, owner in per_text(texts, n_buckets):
            of = code[owner]
            for k, name in enumerate(names):
                counts[name] += np.bincount(bucket[of == k], minlength=n_buckets)
    for name, found in counts.items():
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_pydict({"lang": [name] * len(at), "bucket": at.astype(np.int32), "n": found[at]}, schema=pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())]))


class Model:
    def __init__(self, langs: list[str], log_prob: np.ndarray, log_prior: np.ndarray):
        self.langs, self.log_prob, self.log_prior = langs, log_prob, log_prior

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.langs:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        n_buckets = len(self.log_prob)
        total = np.zeros((len(texts), len(self.langs)))
        seen = np.zeros(len(texts), np.int64)
        for bucket, owner in per_text(texts, n_buckets):
            if len(owner):
                starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                total[owner[starts]] += np.add.reduceat(self.log_prob[bucket], starts, axis=0)
                seen[owner[starts]] += np.diff(np.r_[starts, len(owner)])
        total += self.log_prior
        best = np.argmax(total, axis=1)
        share = np.exp(total - total.max(axis=1, keepdims=True))
        share = share.max(axis=1) / share.sum(axis=1)
        return [self.langs[b] if s else UNDETERMINED for b, s in zip(best, seen, strict=True)], [float(x) if s else 0.0 for x, s in zip(share, seen, strict=True)]


def train(labelled: DataFrame, rows_per_lang: int = 4000, n_buckets: int = N_BUCKETS, smoothing: float = 0.1) -> Model:
    """Fit on (lang, text); doc_id, where present, only picks the sample."""
    rows = labelled.where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row for each language
    if not sizes:
        return Model([], np.zeros((n_buckets, 0), np.float32), np.zeros(0))
    draw = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, rows_per_lang / n))) for k, n in sorted(sizes.items())])
    counted = rows.where(draw < share).select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(partial(_count, n_buckets=n_buckets), "lang string, bucket int, n long")
    found = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # at most languages x buckets
    langs = sorted(found["lang"].unique())
    counts = np.zeros((n_buckets, len(langs)))
    for k, lang in enumerate(langs):
        mine = found[found["lang"] == lang]
        counts[mine["bucket"].to_numpy(), k] = mine["n"].to_numpy()
    used = max(1, int((counts.sum(axis=1) > 0).sum()))
    log_prob = np.log((counts + smoothing) / (counts.sum(axis=0) + smoothing * (used + 1)))
    prior = np.array([sizes[x] for x in langs], float)
    return Model(langs, log_prob.astype(np.float32), np.log(prior / prior.sum()))


def _predict(batches, model):
    for batch in batches:
        ids, folds, texts = (batch.column(k).to_pylist() for k in range(3))
        for at in range(0, len(ids), 512):
            lang, score = model.value.predict(texts[at : at + 512])
            yield pa.RecordBatch.from_pydict({"doc_id": ids[at : at + 512], "held_out": folds[at : at + 512], "lang_pred": lang, "score": score}, schema=pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())]))


def identify(docs: DataFrame, rows_per_lang: int = 4000, n_buckets: int = N_BUCKETS) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (posterior probability of lang_pred)."""
    fold = fold_of(3)
    model = docs.sparkSession.sparkContext.broadcast(train(docs.where(fold != 1).select("doc_id", "lang", "text"), rows_per_lang, n_buckets))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold == 1).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(_predict, model=model), "doc_id long, held_out boolean, lang_pred string, score double")


def _clear(batches, model, min_score: float):
    for batch in batches:
        texts, keep = batch.column(0), []
        for at in range(0, batch.num_rows, 512):
            lang, score = model.value.predict(texts.slice(at, 512).to_pylist())
            keep += [x != UNDETERMINED and s >= min_score for x, s in zip(lang, score, strict=True)]
        yield pa.RecordBatch.from_arrays(batch.columns[1:], names=batch.schema.names[1:]).filter(pa.array(keep, pa.bool_()))


def keep(docs: DataFrame, min_score: float = 0.5, rows_per_lang: int = 4000, n_buckets: int = N_BUCKETS) -> DataFrame:
    """The rows whose language is clear (not `und`, and a posterior of at least min_score), with their columns; rows are judged one by one, without a join."""
    labelled = docs.where(fold_of(3) != 1).select("doc_id", "lang", "text")
    model = docs.sparkSession.sparkContext.broadcast(train(labelled, rows_per_lang, n_buckets))
    whole = docs.select(F.col("text").cast("string").alias(free_name(docs, "_text")), "*")
    return whole.mapInArrow(partial(_clear, model=model, min_score=min_score), docs.schema)
