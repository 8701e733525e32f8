"""Toxicity: a counterfactually regularised linear classifier of whole texts.

A text is described by its distinct lower-case words: for each feature, a whole word (up to MAX_WORD code points) or a prefix of 3 to 8 letters, the value is
log(1 + how many of the text's distinct words have it). Selected are the features that tell the labels of the training sample apart best (chi-squared; top
n_features, a bound). The score is the logistic function of a weighted sum.

Counterfactual regularisation: every sentence of a training text that names a group (IDENTITY, a parameter) is rewritten with each other term of the same category,
the first of which is a neutral stand-in, and the squared change of the sentence's logit is penalised along with the usual loss. So a group's name cannot
raise the score of a text by itself, although toxic training texts name it more often; where no training text names a group, the penalty is zero.

Learning: labelled rows are drawn by hash, rows_per_label of each label (a documented bound, applied to label rows before any text is read and again to the
texts found). Spark turns texts and swapped sentences into sparse rows; only the selected features of at most twice rows_per_label texts, and distinct swaps with their
counts, reach the driver, where proximal gradient steps fit the weights (L1 keeps most at exactly zero, so that long clean texts don't gather noise).
Scoring is one pass over all texts with the model broadcast; its size is bounded by n_features.

Defined cases: a null text is an empty one; an empty text scores by the bias alone; with no labelled row, or only one label, every score is the smoothed share of
label 1 (one half without rows); label rows with a null doc_id or a null toxic are ignored, and a doc_id that carries both labels counts as toxic; a repeated doc_id gives each of its texts the label, and of rows that
repeat doc_id and text one is learned from; repeated rows are scored alike; a null doc_id has no label and is in fold 0, held out; other columns are ignored, also label columns in documents.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import fold_of, stored, text_or_empty

MAX_WORD = 32
PREFIXES = range(3, 9)
#: Group names by category, each led by a neutral stand-in. Terms are single lower-case words.
IDENTITY: tuple[tuple[str, ...], ...] = (
    ("person", "woman", "man", "girl", "boy", "transgender", "nonbinary"),
    ("people", "women", "men", "girls", "boys", "gays", "lesbians"),
    ("human", "gay", "lesbian", "bisexual", "straight", "queer", "heterosexual", "homosexual"),
    ("believer", "muslim", "christian", "jew", "hindu", "buddhist", "atheist", "catholic", "sikh"),
    ("believers", "muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "sikhs"),
    ("religious", "islamic", "jewish", "protestant"),
    ("citizen", "immigrant", "refugee", "foreigner", "african", "american", "asian", "european", "latino", "mexican", "arab", "black", "white"),
    ("citizens", "immigrants", "refugees", "foreigners", "africans", "americans", "asians", "europeans", "latinos", "mexicans", "arabs", "blacks", "whites"),
    ("adult", "old", "young", "elderly", "disabled", "deaf", "blind"),
    ("personne", "femme", "homme", "musulman", "chrétien", "juif", "immigré", "réfugié", "handicapé"),
    ("mensch", "frau", "mann", "muslimin", "christ", "jude", "einwanderer", "flüchtling", "behinderter"),
    ("persona", "mujer", "hombre", "musulmán", "cristiano", "judío", "inmigrante", "refugiado", "discapacitado"),
)

_SENTENCE = re.compile(r"[.!?\n]+")
_NOT_WORD = r"[^\p{L}\p{N}]+"


def split(texts: pa.Array) -> pa.Array:
    """Lower-case runs of letters and digits of each text; a text without any gives one empty word."""
    return pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts), _NOT_WORD, " ")))


def words_of(sentences: Sequence[str]) -> list[list[str]]:
    return [[w for w in words if w] for words in split(pa.array(sentences, pa.string())).to_pylist()]


def features_of(word: str) -> list[str]:
    """The word itself, marked with a blank before it, and its prefixes."""
    own = [" " + word] if len(word) <= MAX_WORD else []
    return own + [word[:k] for k in PREFIXES if k <= len(word)]


def described(words: Iterable[str]) -> dict[str, float]:
    """feature: log(1 + distinct words with it)."""
    counts = Counter(f for word in set(words) for f in features_of(word))
    return {f: math.log1p(n) for f, n in counts.items()}


def swaps_of(words: Sequence[str], identity: Sequence[Sequence[str]]) -> Iterator[tuple[list[str], list[str]]]:
    """(sentence, rewritten sentence) for every group name in it and every other term of its category."""
    for terms in identity:
        for mine in set(words).intersection(terms):
            for other in terms:
                if other != mine:
                    yield list(words), [other if w == mine else w for w in words]


@dataclass(frozen=True)
class Model:
    """Feature numbers, weights and bias; what scoring needs."""

    known: dict[str, int]
    weights: np.ndarray
    bias: float

    def logits(self, texts: pa.Array) -> np.ndarray:
        owner, number, count = counted(texts, lambda word: [self.known[f] for f in features_of(word) if f in self.known])
        return self.bias + np.bincount(owner, self.weights[number] * np.log1p(count), len(texts))


def counted(texts: pa.Array, numbers: Callable[[str], list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature number, distinct words of the text with it), in this order; `numbers` is asked once for each distinct word of the batch."""
    lists = split(texts)
    words = pc.dictionary_encode(lists.flatten())
    sizes = np.diff(np.asarray(lists.offsets, np.int64))
    entries = [numbers(w) if w else [] for w in words.dictionary.to_pylist()]
    width, code = np.array([len(e) for e in entries], np.int64), np.asarray(words.indices, np.int64)
    flat = np.array([k for e in entries for k in e], np.int64)
    if not len(flat):
        return (np.zeros(0, np.int64),) * 3
    hit = width[code] > 0
    owner, word = np.divmod(np.unique(np.repeat(np.arange(len(texts)), sizes)[hit] * len(width) + code[hit]), len(width))  # distinct words of each text
    n = width[word]
    slot = np.repeat(np.cumsum(width)[word] - np.cumsum(n), n) + np.arange(int(n.sum()))
    most = int(flat.max()) + 1
    key, count = np.unique(np.repeat(owner, n) * most + flat[slot], return_counts=True)
    return key // most, key % most, count


def slices(batch: pa.RecordBatch, column: int, texts: int = 2048, size: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """A batch cut to so many rows and about so many bytes of text; a longer text is alone."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        end = max(at + 1, min(at + texts, int(np.searchsorted(ends, before + size))))
        yield batch.slice(at, end - at)
        at = end


_SAMPLE = "toxic int, text_hash long, doc_id long, f array<string>, x array<double>, swaps array<string>, n array<int>"
_SAMPLE_SCHEMA = pa.schema([("toxic", pa.int32()), ("text_hash", pa.int64()), ("doc_id", pa.int64()), ("f", pa.list_(pa.string())), ("x", pa.list_(pa.float64())), ("swaps", pa.list_(pa.string())), ("n", pa.list_(pa.int32()))])


def swapped(sentences: list[list[str]], identity: Sequence[Sequence[str]]) -> Counter:
    """Differences between sentences and their rewritten forms, as JSON, equal ones counted."""
    names = {w for terms in identity for w in terms}
    found: Counter = Counter()
    for words in sentences:
        if not names.isdisjoint(words):
            for before, after in swaps_of(words, identity):
                a, b = described(before), described(after)
                delta = sorted((f, a.get(f, 0.0) - b.get(f, 0.0)) for f in {*a, *b} if a.get(f, 0.0) != b.get(f, 0.0))
                found[json.dumps(delta)] += 1
    return found


def _sampled(batches, identity):
    """Features of whole texts, and what swaps change in their sentences."""
    groups = {w for terms in identity for w in terms}
    for whole in batches:
        for batch in slices(whole, 3):
            names: dict[str, int] = {}
            owner, number, count = counted(batch.column(3), lambda word: [names.setdefault(f, len(names)) for f in features_of(word)])  # noqa: B023
            naming = np.unique(owner[np.isin(number, [names[" " + g] for g in groups if " " + g in names])])
            swaps = [Counter() for _ in range(batch.num_rows)]
            for k in naming.tolist():
                swaps[k] = swapped(words_of(_SENTENCE.split(batch.column(3)[k].as_py())), identity)
            places = pa.array(np.searchsorted(owner, np.arange(batch.num_rows + 1)), pa.int32())
            features = [pa.ListArray.from_arrays(places, pa.array(list(names), pa.string()).take(pa.array(number))), pa.ListArray.from_arrays(places, pa.array(np.log1p(count), pa.float64()))]
            made = [pa.array([list(x) for x in swaps], pa.list_(pa.string())), pa.array([list(x.values()) for x in swaps], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *features, *made], schema=_SAMPLE_SCHEMA)


def label_rows(labels: DataFrame, rows_per_label: int) -> DataFrame:
    """(doc_id, toxic) of at most about rows_per_label ids of each label outside fold 0, drawn by a hash of the id."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").where(fold_of(5) != 0)
    one = rows.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    return _drawn(one, F.xxhash64("doc_id", F.lit("toxicity")), rows_per_label)


def _drawn(rows: DataFrame, hashed, rows_per_label: int) -> DataFrame:
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}  # two labels
    share = F.coalesce(*[F.when(F.col("toxic") == k, F.lit(min(1.0, rows_per_label / n))) for k, n in sorted(sizes.items())], F.lit(0.0))
    return rows.where(F.pmod(hashed, F.lit(1 << 30)) / float(1 << 30) < share)


def samples(docs: DataFrame, labels: DataFrame, rows_per_label: int, identity: Sequence[Sequence[str]] = IDENTITY) -> DataFrame:
    """Sparse rows of the training texts. The drawn ids are bounded, so documents are scanned past them and not shuffled."""
    ids = label_rows(labels, rows_per_label)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    found = texts.join(F.broadcast(ids), "doc_id").withColumn("text_hash", F.xxhash64("text"))  # ids: at most about twice rows_per_label
    once = found.select("toxic", "text_hash", "doc_id", "text").dropDuplicates(["doc_id", "text_hash"])
    rows = stored(once.mapInArrow(partial(_sampled, identity=identity), _SAMPLE), "toxicity-sample")
    return _drawn(rows, F.xxhash64("doc_id", "text_hash"), 2 * rows_per_label)  # bounds texts that share an id


def selected(rows: DataFrame, n_features: int, least: int) -> list[str]:
    """The n_features features, seen in `least` texts or more, with the largest chi-squared statistic of presence against label."""
    totals = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return []
    seen = rows.select("toxic", F.explode("f").alias("f")).groupBy("f").agg(F.sum("toxic").alias("a"), F.count("*").alias("n")).where(F.col("n") >= least)
    a, n = F.col("a").cast("double"), F.col("n").cast("double")
    miss = a * F.lit(float(n0)) - (n - a) * F.lit(float(n1))
    chi = miss * miss / (n * (F.lit(float(n0 + n1)) - n + F.lit(0.5)))
    return [r["f"] for r in seen.select("f", chi.alias("chi")).orderBy(F.desc("chi"), "f").limit(n_features).collect()]


def _compact(batches, known):
    """Label, feature numbers and values of a row's selected features, as bytes."""
    names = pa.array(list(known), pa.string())
    for whole in batches:
        for k in range(whole.num_rows):
            at = pc.index_in(whole.column(1)[k].values, value_set=names)
            real = np.asarray(pc.is_valid(at))
            numbers, values = np.asarray(pc.drop_null(at)).astype("<i4"), np.asarray(whole.column(2)[k].values)[real].astype("<f4")
            yield pa.RecordBatch.from_pydict({"toxic": pa.array([whole.column(0)[k].as_py()], pa.int32()), "numbers": [numbers.tobytes()], "x": [values.tobytes()]})


def fit(rows: DataFrame, n_features: int = 2048, least: int = 5, counterfactual: float = 10.0, l1: float = 3e-4, l2: float = 1e-5, steps: int = 600) -> Model:
    """Weights by accelerated proximal gradient steps on mean log loss + counterfactual penalty + L1 and L2."""
    names = selected(rows, n_features, least)
    known = {f: k for k, f in enumerate(names)}
    share = rows.agg(F.sum("toxic").alias("a"), F.count("*").alias("n")).first()
    prior = ((share["a"] or 0) + 0.5) / (share["n"] + 1.0)
    if not names:
        return Model({}, np.zeros(0), float(np.log(prior / (1 - prior))))
    found = rows.select("toxic", "f", "x").mapInArrow(partial(_compact, known=known), "toxic int, numbers binary, x binary").collect()  # at most about 4 x rows_per_label rows of at most n_features
    y = np.array([r["toxic"] for r in found], float)
    c, x = (np.concatenate([np.frombuffer(r[k], kind) for r in found]) for k, kind in (("numbers", "<i4"), ("x", "<f4")))
    r = np.repeat(np.arange(len(found), dtype=np.int32), [len(r["x"]) // 4 for r in found])
    del found
    made = rows.select(F.explode(F.arrays_zip("swaps", "n")).alias("s")).groupBy("s.swaps").agg(F.sum("s.n").alias("n")).collect()
    deltas = [(m["n"], [(known[f], v) for f, v in json.loads(m["swaps"]) if f in known]) for m in made]
    pr = np.array([i for i, (_, d) in enumerate(deltas) for _ in d], np.int64)
    pc_, px = np.array([k for _, d in deltas for k, _ in d], np.int64), np.array([v for _, d in deltas for _, v in d], float)
    pn = np.array([n for n, _ in deltas], float) * (counterfactual / max(1.0, float(len(y))))
    return Model(known, *descend(y, (r, c, x), (pr, pc_, px, pn), len(names), l1, l2, steps))


def descend(y: np.ndarray, text: tuple, swap: tuple, m: int, l1: float, l2: float, steps: int) -> tuple[np.ndarray, float]:
    """(weights, bias). text: (row, feature, value); swap: (pair, feature, difference, weight of each pair)."""
    (r, c, x), (pr, pc_, px, pn) = text, swap
    n = len(y)
    # Each coordinate has its own step, from a bound on the curvature: a row's sum of values times the column's.
    reach = np.bincount(r, np.abs(x), n) + 1.0
    curve = np.bincount(c, np.abs(x) * reach[r], m) / (4 * n) + l2
    if len(pn):
        curve += 2 * np.bincount(pc_, np.abs(px) * (pn * np.bincount(pr, np.abs(px), len(pn)))[pr], m)
    bias_curve = float(reach.mean()) / 4
    w, b = np.zeros(m), float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    ahead_w, ahead_b, t = w, b, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(r, x * ahead_w[c], n) + ahead_b, -30, 30)))
        g = np.bincount(c, x * (p - y)[r], m) / n + l2 * ahead_w
        if len(pn):
            g += 2 * np.bincount(pc_, px * (pn * np.bincount(pr, px * ahead_w[pc_], len(pn)))[pr], m)
        new = ahead_w - g / curve
        new = np.sign(new) * np.maximum(np.abs(new) - l1 / curve, 0)
        new_b = ahead_b - float((p - y).mean()) / bias_curve
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead_w, ahead_b = new + (t - 1) / after * (new - w), new_b + (t - 1) / after * (new_b - b)
        w, b, t = new, new_b, after
    return w, b


_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def _score(batches, model):
    for whole in batches:
        for batch in slices(whole, 2):
            score = 1 / (1 + np.exp(-np.clip(model.value.logits(batch.column(2)), -700, 700)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], schema=_SCORED)


def score(docs: DataFrame, labels: DataFrame, rows_per_label: int = 4000, identity: Sequence[Sequence[str]] = IDENTITY, **fitting) -> DataFrame:
    """One row per document: doc_id, held_out, score (probability of label 1), predicted."""
    fitted = fit(samples(docs, labels, rows_per_label, identity), **fitting)
    used = {f: k for f, k in fitted.known.items() if fitted.weights[k]}
    model = docs.sparkSession.sparkContext.broadcast(Model({f: i for i, f in enumerate(used)}, fitted.weights[list(used.values())], fitted.bias))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold_of(5) == 0).alias("held_out"), text_or_empty().alias("text"))
    return rows.mapInArrow(partial(_score, model=model), "doc_id long, held_out boolean, score double, predicted int")
