"""Host-level quality rules, with DataFrame and SQL functions only.

Every document gets its counts over the whole text; three rules (base, symbols, repeated lines) mark failures.
Failures are summed for each host, each host's rate is shrunk by a beta prior fitted to all hosts by moments, and a host whose
shrunk rate passes max_host_rate is bad for that rule. Host verdicts are joined back: a document of a bad host is held to
the strict limit of the rule, one of any other host to the lenient limit. Documents that fail the base rule go whatever their host.

Counts are written once to the shared folder, so texts are read once; the host table has one row for each host and the
join back is a sort-merge join that adaptive execution can split on a hot host.

Defined cases: null text has no words and fails the base rule; a null host is a host of its own; repeated rows count each time;
a null doc_id is carried as null; an empty table gives no rows; other columns are ignored by `assess` and kept by `keep`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import free_name, row_key, stored, text_hash, text_or_empty

MIN_WORDS = 50
#: Strict and lenient limits: symbols for each word, share of lines that repeat an earlier one.
SYMBOLS = (0.1, 0.3)
LINES = (0.3, 0.6)
MAX_HOST_RATE = 0.5
#: Bounds of the prior's weight, in documents.
PRIOR_WEIGHT = (2.0, 1000.0)

_BLANK = r"' \t\n\u000b\u000c\r'"
_SPACES = r"'[\\x20\\x09-\\x0D]+'"


def _let(name: str, value: str, body: str) -> str:
    """SQL that evaluates value once and body with it under that name."""
    return f"transform(array({value}), {name} -> {body})[0]"


def repeat_words(words: str) -> str:
    """SQL: how many words lie in 3-word windows that occur twice or more.

    Windows are sorted by a hash with the position in its low bits; neighbours with equal hashes are then
    compared word by word, so the count is exact, in n log n time and memory in proportion to the text.
    """
    same_hash = "coalesce(shiftrightunsigned(x ^ get(s, i + {d}), nb) = 0, false)"
    same_words = "coalesce(x.a = get(v, i + {d}).a and x.b = get(v, i + {d}).b and x.c = get(v, i + {d}).c, false)"
    covered = "aggregate(transform(q, (p, i) -> least(3, coalesce(get(q, i + 1) - p, 3))), 0L, (acc, x) -> acc + x)"
    exact = _let("q", f"sort_array(transform(filter(v, (x, i) -> {same_words.format(d=-1)} or {same_words.format(d=1)}), x -> x.p))", covered)
    checked = _let("v", "sort_array(transform(c, p -> named_struct('a', w[p], 'b', w[p + 1], 'c', w[p + 2], 'p', p)))", exact)
    candidates = f"transform(filter(s, (x, i) -> {same_hash.format(d=-1)} or {same_hash.format(d=1)}), x -> int(x & (shiftleft(1L, nb) - 1)))"
    found = _let("c", candidates, f"if(size(c) = 0, 0L, {checked})")
    hashed = "sort_array(transform(slice(w, 1, size(w) - 2), (x, i) -> shiftleft(shiftrightunsigned(xxhash64(x, w[i + 1], w[i + 2]), nb), nb) | i))"
    return _let("w", words, f"if(size(w) < 4, 0L, {_let('nb', 'length(bin(size(w)))', _let('s', hashed, found))})")


def measured(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host, a hash of the text and the counts of each document."""
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), text_or_empty().alias("t"), text_hash().alias("text_hash"))
    words = f"if(btrim(t, {_BLANK}) = '', cast(array() as array<string>), split(btrim(t, {_BLANK}), {_SPACES}))"
    lines = _let("l", f"filter(split(t, '\\n'), x -> btrim(x, {_BLANK}) != '')", "named_struct('n', cast(size(l) as long), 'd', cast(size(l) - size(array_distinct(l)) as long))")
    both = _let("w0", words, f"named_struct('n', cast(size(w0) as long), 'r', {repeat_words('w0')})")
    return t.select(
        "doc_id",
        "host",
        "text_hash",
        F.expr(both).alias("w"),
        F.expr(lines).alias("l"),
        F.expr(f"cast(char_length(regexp_replace(t, {_SPACES}, '')) as long)").alias("word_chars"),
        F.expr("cast(char_length(t) - char_length(regexp_replace(t, '[#*$%&|<>]+', '')) as long)").alias("n_symbols"),
    ).select("doc_id", "host", "text_hash", F.col("w.n").alias("n_words"), "word_chars", "n_symbols", F.col("l.d").alias("n_dup_lines"), F.col("w.r").alias("n_repeat_words"), F.col("l.n").alias("n_lines"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _over(part: str, whole: str, limit: float) -> Column:
    return F.col(part) > limit * F.col(whole)


RULES = {
    "base": lambda level: base_failed(),
    "symbols": lambda level: _over("n_symbols", "n_words", SYMBOLS[level]),
    "lines": lambda level: _over("n_dup_lines", "n_lines", LINES[level]),
}


def host_rates(counts: DataFrame) -> DataFrame:
    """One row per host: host, n_docs and for each rule the failures and the shrunk rate."""
    failed = [F.sum(rule(0).cast("long")).alias(f"{name}_failures") for name, rule in RULES.items()]
    hosts = stored(counts.groupBy("host").agg(F.count("*").alias("n_docs"), *failed), "hosts")
    n = F.col("n_docs").cast("double")
    sums = [F.sum(n).alias("n")]
    for name in RULES:
        f = F.col(f"{name}_failures").cast("double")
        sums += [F.sum(f).alias(f"{name}_f"), F.sum(f * f / n).alias(f"{name}_ff")]
    total = hosts.agg(*sums).first()  # one row
    out = hosts
    for name in RULES:
        a, b = beta_prior(total["n"] or 0.0, total[f"{name}_f"] or 0.0, total[f"{name}_ff"] or 0.0)
        out = out.withColumn(f"{name}_rate", (F.col(f"{name}_failures") + F.lit(a)) / (n + F.lit(a + b)))
    return out


def beta_prior(n: float, f: float, ff: float) -> tuple[float, float]:
    """(a, b) by moments from sums over hosts of documents, failures and failures squared over documents."""
    low, high = PRIOR_WEIGHT
    if not n:
        return low / 2, low / 2
    mean = f / n
    spread = ff / n - mean * mean
    weight = high if spread <= 0 or mean in (0.0, 1.0) else min(high, max(low, mean * (1 - mean) / spread - 1))
    return mean * weight, (1 - mean) * weight


def assess(docs: DataFrame, host: str = "source", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per document: its counts, base_failed, kept and the host's shrunk rates."""
    return _judged(docs, host, max_host_rate).drop("text_hash")


def _judged(docs: DataFrame, host: str, max_host_rate: float) -> DataFrame:
    counts = stored(measured(docs, host), "quality-counts")
    rates = host_rates(counts).select(F.col("host").alias("_host"), "n_docs", *[f"{name}_rate" for name in RULES])
    rows = counts.join(rates, counts["host"].eqNullSafe(rates["_host"]), "left")
    fails = [F.when(F.col(f"{name}_rate") > max_host_rate, rule(0)).otherwise(rule(1)) for name, rule in RULES.items()]
    rejected = fails[0] | fails[1] | fails[2]
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"),
        (~rejected).alias("kept"), "host", F.col("n_docs").alias("host_docs"), *[F.round(f"{name}_rate", 9).alias(f"host_{name}_rate") for name in RULES], "text_hash",
    )


def keep(docs: DataFrame, host: str = "source", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The documents that pass, with their columns. A verdict holds for the rows with its doc_id, host and text."""

    def key(host_column: str, text: Column) -> Column:
        return row_key("doc_id", F.concat_ws(":", text, F.xxhash64(F.col(host_column).cast("string"))))

    kept = _judged(docs, host, max_host_rate).where("kept").select(key("host", F.col("text_hash")).alias("_kept"))
    name = free_name(docs, "_key")
    keyed = docs.withColumn(name, key(host, text_hash()))
    return keyed.join(kept, keyed[name] == kept["_kept"], "left_semi").drop(name)


SQL = r"""
with t as (select doc_id, source as host, coalesce(text, '') as t from documents),
w as (select doc_id, host, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from t),
tri as (select doc_id, i, list_extract(w, i) as a, list_extract(w, i + 1) as b, list_extract(w, i + 2) as c from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from w where len(w) >= 4)),
rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, a, b, c) as n from tri) where n >= 2),
cov as (select doc_id, count(distinct p) as n from (select doc_id, i + unnest([0, 1, 2]) as p from rep) group by doc_id),
c as (select w.doc_id, host, len(w)::bigint as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(cov.n, 0)::bigint as n_repeat_words, len(l)::bigint as n_lines
  from w left join cov on w.doc_id = cov.doc_id),
d as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from c),
h as (select host, count(*)::bigint as n_docs, sum(base_failed::int)::double as f0, sum((n_symbols > 0.1::double * n_words)::int)::double as f1, sum((n_dup_lines > 0.3::double * n_lines)::int)::double as f2 from d group by host),
p as (select sum(n_docs)::double as n, sum(f0) as f0, sum(f0 * f0 / n_docs) as s0, sum(f1) as f1, sum(f1 * f1 / n_docs) as s1, sum(f2) as f2, sum(f2 * f2 / n_docs) as s2 from h),
m as (select unnest([0, 1, 2]) as k, unnest([f0, f1, f2]) / n as mean, unnest([s0, s1, s2]) / n - power(unnest([f0, f1, f2]) / n, 2) as spread from p),
q as (select k, mean, case when spread <= 0 or mean in (0, 1) then 1000.0 else least(1000.0, greatest(2.0, mean * (1 - mean) / spread - 1)) end as weight from m),
r as (select host, n_docs, (f0 + (select mean * weight from q where k = 0)) / (n_docs + (select weight from q where k = 0)) as r0,
  (f1 + (select mean * weight from q where k = 1)) / (n_docs + (select weight from q where k = 1)) as r1,
  (f2 + (select mean * weight from q where k = 2)) / (n_docs + (select weight from q where k = 2)) as r2 from h)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or n_symbols > case when r1 > 0.5 then 0.1::double else 0.3::double end * n_words or n_dup_lines > case when r2 > 0.5 then 0.3::double else 0.6::double end * n_lines) as kept,
  d.host, n_docs as host_docs, round(r0, 9) as host_base_rate, round(r1, 9) as host_symbols_rate, round(r2, 9) as host_lines_rate
from d left join r on d.host is not distinct from r.host
"""
