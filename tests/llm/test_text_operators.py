"""Packing, language ID, quality rules, exact and near deduplication against brute force on small tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from tidemark.llm import exact_dedup, langid, near_dedup, packing, quality
from tidemark.llm.shared import stored

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
AWKWARD = [
    (1, "One two three four five six.", "en", "a", 1),
    (2, None, "en", None, None),
    (3, "", None, "a", 0),
    (4, " \t\n\x0b\f\r ", "en", "a", 7),
    (5, "One two  three four\nfive six.", "en", "b", 1),
    (6, "x" * 30000, "en", "b", 1),
    (7, "wörd " * 9000, "de", "b", 1),
    (7, "wörd " * 9000, "de", "b", 1),
    (8, "1234 $$$ %%%", "en", "c", 1),
    (None, "no id here", "en", "c", 1),
    (9, "don't stop O'Neill's <|endoftext|> café ＡＢＣ wide\x1cgap ΣΑΣ", "en", "c", 1),
    (10, "alpha beta gamma delta\nalpha beta gamma delta\nalpha beta gamma delta " * 8, "en", "c", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    # Extra columns whose names clash with those that operators make.
    return spark.createDataFrame([(*r, 1, True, "k") for r in AWKWARD], SCHEMA + ", slot int, kept boolean, key string").repartition(3)


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def tokens_of(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    if not hasattr(tokens_of, "t"):
        tokens_of.t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [*tokens_of.t.encode(text or "", add_special_tokens=False).ids, 2]


def check_packing(rows, docs):
    want = collections.defaultdict(collections.Counter)
    for doc_id, text in docs:
        want[doc_id][tuple(tokens_of(text))] += 1
    by_sequence, by_doc = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append(r)
        by_doc[r.doc_id].append(r)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    for doc_id, texts in want.items():
        if sum(texts.values()) > 1:  # repeated rows: the pieces of all
            assert sum(r.length for r in by_doc[doc_id]) == sum(len(t) * n for t, n in texts.items())
            continue
        ids, at = np.array(next(iter(texts)), "<u4"), 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    return padding


def test_packing_covers_every_token_once(docs, corpus):
    for df in (docs, corpus):
        rows = packing.pack(df).collect()
        assert check_packing(rows, [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]) == 0
    assert packing.pack(corpus.limit(0)).count() == 0


def test_packing_tries_a_tokenizer_before_it_takes_shortcuts():
    texts = ["The  cats don't\nsit, on 12 mats.", "straße ÉCLAIR...", "", "a|b $$$ 日本"]
    word, byte = packing.tokenizer_for("word_bpe_49k.json"), packing.tokenizer_for("byte_bpe_50k.json")
    assert word.by_word and word.by_merges and not byte.by_word  # the second keeps white space
    for tokenizer in (word, byte):
        assert tokenizer.encode(texts) == [tokenizer.ids(t) for t in texts]


def test_open_windows_close_one_at_a_time():
    rng = random.Random(4)
    packer, given = packing.SumOfSquares(window=64, max_open=5), 0
    for n in range(400):
        size = rng.randint(1, 150)
        given += size
        packer.add(n, b"\0\0\0\0" * size)
        held = [len(p[2]) // 4 for level in packer.levels for b in level for p in b]
        assert packer.n_open == packer.counts.sum() == sum(map(len, packer.levels)) <= 5
        assert all(sum(len(p[2]) for p in b) == 4 * k for k, level in enumerate(packer.levels) for b in level)
        assert sum(held) + sum(len(p[2]) // 4 for w in packer.full for p in w) == given
        assert all(sum(len(p[2]) for p in w) == 4 * 64 for w in packer.full)  # placement and closing leave full windows only


def test_level_choice_minimises_the_sum_of_squares():
    rng = random.Random(1)
    packer = packing.SumOfSquares(window=32, max_open=50)
    for n in range(600):
        size = rng.randint(1, 31)
        counts = packer.counts.astype(int).tolist()

        def after(h):
            c = list(counts)
            if h:
                c[h] -= 1
            if h + size < 32:
                c[h + size] += 1
            return sum(x * x for x in c)

        allowed = [h for h in range(33 - size) if h == 0 or counts[h]]
        assert after(packer.level_for(size)) == min(map(after, allowed))
        packer.add(n, b"\0\0\0\0" * size)
    packer.settle()
    sizes = [sum(len(p[2]) // 4 for p in w) for w in packer.take()]
    assert all(s == 32 or s & (s - 1) == 0 for s in sizes)


def test_language_id(docs, corpus):
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert got[2].lang_pred == got[3].lang_pred == got[4].lang_pred == got[8].lang_pred == "und"
    assert got[2].score == 0 and got[1].held_out == (zlib.crc32(b"1") % 3 == 1)
    assert len(langid.identify(docs).collect()) == len(AWKWARD)
    assert langid.identify(corpus.limit(0)).count() == 0
    lang = {r.doc_id: r.lang for r in corpus.collect()}
    rows = [r for r in langid.identify(corpus).collect() if r.held_out and lang[r.doc_id]]
    assert sum(r.lang_pred == lang[r.doc_id] for r in rows) >= 0.95 * len(rows)


def test_language_id_of_long_text_equals_parts(monkeypatch):
    texts = ["der die das und nicht ein " * 400, "kurz", "", None, "x"]

    def counted():
        counts = np.zeros((len(texts), 1 << 10), int)
        for bucket, owner in langid.per_text(texts, 1 << 10):
            np.add.at(counts, (owner, bucket), 1)
        return counts

    whole = counted()
    for size in (7, 1000):
        monkeypatch.setattr(langid, "CHUNK", size)
        assert (counted() == whole).all()


def test_language_id_equals_naive_bayes_by_hand(spark, corpus):
    """Posteriors from plain counters over n-grams, with the buckets that the operator gives them."""
    buckets, held = 1 << 12, {r.doc_id: r for r in langid.identify(corpus, n_buckets=1 << 12).collect()}

    def counts_of(text):
        found = collections.Counter()
        for bucket, _ in langid.per_text([text], buckets):
            found.update(bucket.tolist())
        return found

    rows = corpus.collect()
    seen, size = collections.defaultdict(collections.Counter), collections.Counter()
    for r in rows:
        if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            seen[r.lang].update(counts_of(r.text))
            size[r.lang] += 1
    used = len(set().union(*seen.values()))
    for r in rows[:60]:
        own = counts_of(r.text)
        logs = {lang: math.log(size[lang] / size.total()) + sum(n * math.log((c[k] + 0.1) / (c.total() + 0.1 * (used + 1))) for k, n in own.items()) for lang, c in seen.items()}
        best = max(sorted(logs), key=logs.get)
        if own:
            top = max(logs.values())
            assert held[r.doc_id].lang_pred == best
            assert math.isclose(held[r.doc_id].score, 1 / sum(math.exp(x - top) for x in logs.values()), rel_tol=1e-2)


def test_language_keep_takes_rows_one_by_one(docs):
    kept = langid.keep(docs)
    assert kept.schema == docs.schema
    clear = {r.doc_id for r in langid.identify(docs).collect() if r.lang_pred != "und" and r.score >= 0.5}
    assert {r.doc_id for r in kept.collect()} == clear and langid.keep(docs.limit(0)).count() == 0


def test_n_grams_stay_within_texts():
    grams = collections.Counter()
    for bucket, owner in langid.per_text(["ab", "cd"], 1 << 16):
        grams.update(zip(owner.tolist(), bucket.tolist(), strict=True))
    assert {k for k, _ in grams} == {0, 1} and grams.total() == 2 * (2 + 3 + 2)  # " ab ": letters, pairs, triples


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def quality_row(text):
    w = words_of(text)
    windows = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {i + d for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_quality_counts(docs, corpus):
    for df in (docs, corpus):
        texts = collections.defaultdict(list)
        for r in df.collect():
            texts[r.doc_id].append(quality_row(r.text))
        got = collections.defaultdict(list)
        for r in quality.assess(df).collect():
            got[r.doc_id].append((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words))
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
            assert not (r.base_failed and r.kept)
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in texts.items()}
    assert quality.assess(corpus.limit(0)).count() == 0
    assert quality.keep(docs).columns == docs.columns


def test_quality_keep_judges_rows_that_share_an_id(spark):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(1, good, "h"), (1, "too short", "h"), (None, good, None), (None, "short", None), (2, None, "h")]
    kept = quality.keep(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[0], rows[2]], key=str)


def test_host_prior_and_verdicts(spark):
    clean = " ".join(f"word{i}" for i in range(60))
    junk = " ".join(f"word{i}{'#' if i % 5 == 0 else ''}" for i in range(60))  # 0.2 symbols a word: between the limits
    rows = [(i, clean, "good") for i in range(40)] + [(100 + i, junk, "bad") for i in range(40)] + [(200, junk, "good"), (201, clean, "bad")]
    got = {r.doc_id: r for r in quality.assess(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[100].kept is False and got[201].kept and got[200].kept and got[0].kept
    assert got[100].host_symbols_rate > 0.5 > got[0].host_symbols_rate
    assert quality.beta_prior(0, 0, 0) == (1.0, 1.0)


def exact_rows(rows):
    groups = collections.defaultdict(list)
    for doc_id, text in rows:
        groups["".join(words_of(text))].append((doc_id, len(text or "")))
    out = []
    for norm, members in groups.items():
        best = min(members, key=lambda m: (-m[1], m[0] is None, m[0]))[0]
        out += [(i, best, len(members), i == best, hashlib.sha256(norm.encode()).hexdigest()) for i, _ in members]
    return sorted(out, key=str)


@pytest.mark.parametrize("hash_bits", [64, 3])
def test_exact_dedup(docs, corpus, hash_bits):
    for df in (docs, corpus):
        got = exact_dedup.dedup(df, max_depth=6, capacity=10, hash_bits=hash_bits).collect()
        assert sorted(map(tuple, got), key=str) == exact_rows([(r.doc_id, r.text) for r in df.collect()])
    assert exact_dedup.dedup(corpus.limit(0)).count() == 0


@pytest.mark.parametrize("hash_bits", [64, 3])
def test_exact_keep(docs, spark, hash_bits):
    kept = exact_dedup.keep(docs, max_depth=6, capacity=10, hash_bits=hash_bits)
    assert kept.columns == docs.columns
    want = {r[1] for r in exact_rows([(r[0], r[1]) for r in AWKWARD])}
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(want, key=str)  # also one of the two equal rows 7
    rows = [(1, "a b", "x"), (1, "ab", "y"), (1, "a b", "z"), (1, "other", "x"), (None, "n n", "x"), (None, "n n", "x"), (4, "", "x"), (3, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _own_sha string").repartition(3)
    got = exact_dedup.keep(df, hash_bits=hash_bits)
    assert got.columns == df.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == [(0, "n n"), (1, "a b"), (1, "other"), (3, "")]


def test_directory_splits_only_overfull_buckets():
    owner = exact_dedup.directory({0: 9, 1: 9, 2: 1, 7: 3}, max_depth=3, capacity=10)
    assert owner == [0, 1, 2, 2, 4, 4, 4, 4]
    assert exact_dedup.directory({}, 3, 10) == [0] * 8


def bag(text):
    w = (text or "").encode().lower().split()
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()


def brute_classes(rows, threshold=0.8):
    by_id = {i: bag(t) for i, t in rows}
    root = {i: i for i in by_id}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(by_id, key=lambda i: (i is None, i))
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            shared, either = (by_id[a] & by_id[b]).total(), (by_id[a] | by_id[b]).total()
            if shared >= threshold * either:
                x, y = sorted((find(a), find(b)), key=lambda i: (i is None, i))
                root[y] = x
    return {i: find(i) for i in ids}


def test_near_dedup_equals_brute_force(spark, docs, corpus):
    rng = random.Random(5)
    rows = [(r.doc_id, r.text) for r in corpus.collect()]
    for n in range(40):  # one base with many near copies, and chains of edits
        words = (rows[3][1]).split()
        words[rng.randrange(len(words))] = f"edit{n}"
        rows.append((10_000 + n, " ".join(words)))
    for df, pairs in ((spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows), (docs, [(r[0], r[1]) for r in AWKWARD])):
        got = {r.doc_id: r.class_id for r in near_dedup.classes(df).collect()}
        assert got == brute_classes(pairs)
    assert near_dedup.classes(corpus.limit(0)).count() == 0
    kept = near_dedup.keep(docs)
    assert kept.columns == docs.columns


def test_near_dedup_of_a_family_whose_base_is_absent(spark):
    rng = random.Random(11)
    base, rows = [f"w{rng.randrange(5000)}" for _ in range(300)], []
    for n in range(300):
        words = list(base)
        for k in rng.sample(range(300), rng.randrange(2, 8)):
            words[k] = f"edit{rng.randrange(10**6)}"
        rows.append((n, " ".join(words)))
    got = {r.doc_id: r.class_id for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == brute_classes(rows)


def test_near_dedup_of_pairs_in_a_crowd_of_long_common_boilerplate(spark):
    common = [f"c{k}" for k in range(261)]  # any two texts: 257 of 343 shingles; the two of a pair: 269 of 331
    rows = [(n, " ".join(common + [f"p{n // 2}x{k}" for k in range(12)] + [f"o{n}x{k}" for k in range(31)])) for n in range(200)]
    got = {r.doc_id: r.class_id for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {n: n - n % 2 for n in range(200)}


def test_texts_that_share_boilerplate_only_are_not_compared(spark, monkeypatch):
    """Thousands of texts of similarity 0.74 share buckets; only those that may have a link reach the comparison of blocks, each with few jobs."""
    common = [f"c{k}" for k in range(120)]
    rows = [(n, " ".join(common + [f"o{n}x{k}" for k in range(20)])) for n in range(6000)]
    rows += [(10_000 + n, rows[n * 50][1].replace(f"o{n * 50}x7", "edit")) for n in range(40)]
    held: dict[str, list] = {}
    monkeypatch.setattr(near_dedup, "stored", lambda df, name: held.setdefault(name, []).append(stored(df, name)) or held[name][-1])
    got = {r.doc_id: r.class_id for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {i: (i - 10_000) * 50 if i >= 10_000 else i for i, _ in rows}
    (placed,), (split,), (jobs,) = held["placed"], held["split"], held["jobs"]
    assert placed.select("doc").distinct().count() > 5000
    assert split.select("doc").distinct().count() <= 80 and jobs.count() <= 80 * near_dedup.BANDS * 4


@pytest.mark.parametrize("threshold", [0.8, 0.5])
def test_prefix_filter_loses_no_link(spark, threshold):
    rng = random.Random(8)
    bags = []
    for family in range(12):
        base = [rng.randrange(-(10**12), 10**12) if rng.random() < 0.8 else rng.randrange(30) for _ in range(rng.choice([1, 2, 5, 30, 90]))]
        for _ in range(15):
            cut = rng.choice([0.0, 0.05, 0.12, 0.3])
            bags.append(sorted({x for x in base if rng.random() >= cut} | {rng.randrange(10**12) for _ in range(rng.randrange(1 + int(len(base) * cut)))}))
    bags.append([])
    table = spark.createDataFrame([(str(n).encode(), b) for n, b in enumerate(bags)], "doc binary, bag array<long>")
    roots = [n % 7 for n in range(len(bags))]
    texts = spark.createDataFrame([(str(n).encode(), str(r).encode()) for n, r in enumerate(roots)], "doc binary, root binary")
    live = {int(bytes(r.doc)) for r in near_dedup.with_partners(texts, table, threshold).collect()}
    real = set()
    for x in range(len(bags)):
        for y in range(x):
            shared = len(set(bags[x]) & set(bags[y]))
            if roots[x] != roots[y] and shared and shared >= threshold * (len(bags[x]) + len(bags[y]) - shared) - 1e-9:
                real |= {x, y}
    assert len(real) > 60 and real <= live and len(live) < len(bags)


def test_bag_minhash_is_unbiased():
    rng = np.random.default_rng(3)
    errors = []
    for trial in range(60):
        sh = rng.integers(0, 1 << 62, 40).astype(np.uint64)
        wa, wb = rng.integers(1, 9, 40), rng.integers(1, 9, 40)
        wa[:10], wb[10:14] = 0, 0
        real = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
        sides = [near_dedup.bag_minhash(sh[w > 0], np.zeros((w > 0).sum(), int), w[w > 0], 1, 256)[0] for w in (wa, wb)]
        errors.append((sides[0] == sides[1]).mean() - real)
    assert abs(np.mean(errors)) < 0.012 and np.std(errors) < 0.05


def test_words_of_long_texts_do_not_depend_on_chunks(monkeypatch):
    text = "alpha beta gamma " * 3000
    whole = next(near_dedup.batches_of_words([text]))[1]
    monkeypatch.setattr(near_dedup, "CHUNK", 997)
    parts = list(near_dedup.batches_of_words(["short one", text, "", "tail"]))
    assert sum(len(s) for _, _, s in parts) == 4
    assert (next(w for first, w, s in parts if first == 1) == whole).all()


@pytest.mark.parametrize("shape", ["ascending", "descending", "zigzag", "shuffled", "star"])
def test_components_take_logarithmic_rounds(spark, monkeypatch, shape):
    n = 2000 if shape == "ascending" else 300
    order = list(range(n))
    if shape == "descending":
        order.reverse()
    elif shape == "zigzag":
        order = [x for pair in zip(range(n // 2), range(n - 1, n // 2 - 1, -1), strict=True) for x in pair]
    elif shape == "shuffled":
        random.Random(2).shuffle(order)
    links = [(0, i) for i in range(1, n)] if shape == "star" else [(order[i], order[i + 1]) for i in range(n - 1)]
    rounds = []
    monkeypatch.setattr(near_dedup, "stored", lambda df, name: rounds.append(name) or stored(df, name))
    got = dict(map(tuple, near_dedup.components(spark.createDataFrame([*links, (n + 1, n)], "a long, b long")).collect()))
    assert {got[i] for i in range(n)} == {0} and got[n] == got[n + 1] == n
    assert rounds.count("stars") <= 2 + math.log2(n)


def test_near_dedup_of_rows_without_or_with_repeated_ids(spark):
    base, other = " ".join(f"w{i}" for i in range(80)), " ".join(f"v{i}" for i in range(80))
    near = base.replace("w70", "edit")
    rows = [(1, base, "p"), (1, other, "q"), (2, near, "r"), (None, base + " ", "s"), (None, "only one", "t"), (None, "only one", "u"), (None, None, "v"), (3, "", "w"), (1, base, "p")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _key string").repartition(4)
    got = collections.Counter((r.doc_id, r.class_id) for r in near_dedup.classes(df).collect())
    assert got == {(1, 1): 3, (2, 1): 1, (None, 1): 1, (None, None): 2, (None, 3): 1, (3, 3): 1}
    kept = near_dedup.keep(df)
    assert kept.columns == ["doc_id", "text", "_key"]
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(1, base), (1, other), (3, ""), (0, "only one")])


def test_large_buckets_lose_no_link(spark):
    """Recall on buckets far over small_bucket: every 50th text against all, by brute force over the pairs that share a bucket."""
    rng = random.Random(21)
    rows = []
    for family in range(6):
        base = [f"f{family}w{rng.randrange(4000)}" for _ in range(200)]
        for n in range(100):
            words = list(base)
            for k in rng.sample(range(200), rng.randrange(0, 7)):
                words[k] = f"e{rng.randrange(10**6)}"
            rows.append((family * 1000 + n, " ".join(words)))
    got = {r.doc_id: r.class_id for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    real = found = 0
    sets = {i: bag(t) for i, t in rows}
    for i in [i for i, _ in rows if i % 50 == 0]:
        for j in sets:
            shared = (sets[i] & sets[j]).total()
            if i != j and shared >= 0.8 * (sets[i].total() + sets[j].total() - shared):
                real, found = real + 1, found + (got[i] == got[j])
    assert real > 100 and found >= 0.999 * real
