"""Quality rules with host verdicts, with DataFrame functions only.

Each document is measured once. Rule failures are summed for each host (a host with a third of all rows is summed
before its counts are shuffled) and get a beta prior that is fitted to the hosts' rates by moments, sampling noise taken
off. A host's failure rate for a rule then has a beta posterior, judged by its mean and deviation:

* bad: the rate lies above ``LIMIT`` and above ``FACTOR`` times the corpus's own rate or the hosts' mean, whichever is lower, with 95 per
  cent certainty; all its documents go. As every rejected host has at most 5 per cent of posterior doubt, at most 5 per cent of the
  rejections are expected to be false,
* trusted: it lies below ``TRUST`` with the same certainty,
* else neither.

Verdicts are joined back. A document goes if it fails a base rule, if its host is bad for any rule, or if it fails a watched rule
itself and its host is not trusted for that rule: the same text is a fault on one host and a fluke on another. ``op10_host_rules``
watches the rules ``WATCHED``. Where hosts do not differ, the prior is narrow and none of them is bad.

Defined cases: a null text counts as empty (it fails the length rule); a null host is a host of its own; repeated rows
stay repeated; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnfield.llm.common import SPACE, materialize, small

MIN_WORDS = 50
#: Per cent of the words that may lie in repeated 3-word windows.
MAX_REPEAT = 50
#: A host is bad when its rate for one rule is surely above LIMIT and FACTOR times the lower of corpus rate and hosts' mean, trusted when surely below TRUST.
LIMIT, FACTOR, TRUST = 0.3, 2.0, 0.02
#: Deviations of a one-sided 95 per cent bound.
SURE = 1.645
#: Document rules that count towards a host's rates, beside the base rules.
MAX_SYMBOLS, MAX_DUP_LINES = 0.1, 0.3
RULES = ("short", "repeats", "symbols", "dup_lines")
#: Rules that reject the failing document itself, unless its host is trusted.
WATCHED = ("symbols",)


def _once(value: Column, f) -> Column:
    """f(value) with value computed once: a lambda over an array of one element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more in the text.

    Windows become 64-bit hashes. Where all differ, nothing repeats. Else windows are sorted with their positions, equal
    neighbours are kept, and the union of the covered positions is added up: n log n for a text of n words.
    """

    def starts(placed: Column) -> Column:
        before = lambda x, i: F.coalesce(F.when(i > 0, F.get(placed, i - 1)["h"] == x["h"]), F.lit(False))
        after = lambda x, i: F.coalesce(F.get(placed, i + 1)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(placed, lambda x, i: before(x, i) | after(x, i)), lambda x: x["at"]))

    def union(at: Column) -> Column:
        # Each window adds three words, less those that the one before it covers too.
        step = lambda acc, p: F.struct(p.alias("last"), (acc["sum"] + F.least(F.lit(3), p - acc["last"])).alias("sum"))
        return F.aggregate(at, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("sum")), step, lambda acc: acc["sum"])

    windows = F.transform(F.sequence(F.lit(1), F.size(words) - 2), lambda i: F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)))
    repeated = lambda h: _once(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at")))), lambda p: union(starts(p)))
    some = _once(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(repeated(h)))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(some)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) for each row of ``docs``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))
    words = F.regexp_extract_all(text, F.lit(f"[^{SPACE}]+"), F.lit(0))
    counted = _once(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).cast("long").alias("n_repeat_words")))
    out = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(host_col).alias("host"),
        F.length(F.regexp_replace(text, f"[{SPACE}]+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        _once(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _once(lines, lambda x: F.size(x)).cast("long").alias("n_lines"),
        counted.alias("c"),
    )
    return out.select("doc_id", "host", "c.n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "c.n_repeat_words")


def failures() -> dict[str, Column]:
    return {
        "short": F.col("n_words") < MIN_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"),
        "symbols": F.col("n_symbols") > MAX_SYMBOLS * F.col("word_chars"),
        "dup_lines": F.col("n_dup_lines") > MAX_DUP_LINES * F.col("n_lines"),
    }


def host_verdicts(measured: DataFrame) -> DataFrame:
    """(host, n, <rule>_rate, <rule>_trusted, host_failed): posterior mean rates by the empirical beta prior of each rule.

    The prior's mean m is the hosts' mean rate. Its strength is s = m(1-m)/v - 1, v being the hosts' variance less the mean sampling
    variance m(1-m)/n, kept between 1 and 10,000; where hosts do not differ the strength is the upper bound. The posterior
    has mean (k + s m) / (n + s) and variance mean (1 - mean) / (n + s + 1).
    """
    fails = failures()
    sums = measured.groupBy("host").agg(F.count("*").alias("n"), *[F.sum(fails[r].cast("long")).alias(r) for r in RULES])
    sums = materialize(sums, "hosts")
    rate = lambda r: F.col(r) / F.col("n")
    whole = lambda r: (F.sum(r) / F.sum("n")).alias(f"{r}_c")
    prior = sums.agg(F.avg(1 / F.col("n")).alias("i"), *[x for r in RULES for x in (F.avg(rate(r)).alias(f"{r}_m"), F.var_pop(rate(r)).alias(f"{r}_v"), whole(r))]).first()
    rates, trusted, bad = [], [], []
    for r in RULES:
        m = prior[f"{r}_m"] or 0.0
        v = (prior[f"{r}_v"] or 0.0) - m * (1 - m) * (prior["i"] or 0.0)
        strength = min(10_000.0, max(1.0, m * (1 - m) / v - 1)) if v > 1e-12 else 10_000.0
        mean = (F.col(r) + F.lit(strength * m)) / (F.col("n") + F.lit(strength))
        off = F.lit(SURE) * F.sqrt(mean * (1 - mean) / (F.col("n") + F.lit(strength) + 1))
        rates.append(mean.alias(f"{r}_rate"))
        trusted.append((mean + off < TRUST).alias(f"{r}_trusted"))
        bad.append(mean - off > max(LIMIT, FACTOR * min(m, prior[f"{r}_c"] or 0.0)))
    return sums.select("host", "n", *rates, *trusted, reduce(lambda a, b: a | b, bad).alias("host_failed"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", watched: Sequence[str] = ()) -> DataFrame:
    """The measures with base_failed, host_failed, doc_failed and kept for each row of ``docs``; rules of ``watched`` reject the document, too."""
    measured = materialize(measures(docs, id_col, text_col, host_col), "measures")
    trusted = [f"{r}_trusted" for r in watched]
    verdicts = small(host_verdicts(measured).select(F.col("host").alias("_host"), "host_failed", *trusted))
    fails = failures()
    base_failed = fails["short"] | fails["repeats"]
    doc_failed = reduce(lambda a, b: a | b, [fails[r] & ~F.col(f"{r}_trusted") for r in watched], F.lit(False))
    joined = measured.join(verdicts, F.col("host").eqNullSafe(F.col("_host")), "left").withColumns({"base_failed": base_failed, "doc_failed": doc_failed})
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed") & ~F.col("doc_failed")).drop("_host", *trusted)


def op10_host_rules(spark, sf_dir: str) -> DataFrame:
    found = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), watched=WATCHED)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_failed", "doc_failed")


def _oracle() -> str:
    space = SPACE
    rules = {
        "short": f"n_words < {MIN_WORDS}",
        "repeats": f"100 * n_repeat_words > {MAX_REPEAT} * n_words",
        "symbols": f"n_symbols > {MAX_SYMBOLS}::double * word_chars",
        "dup_lines": f"n_dup_lines > {MAX_DUP_LINES}::double * n_lines",
    }
    sums = ", ".join(f"count(*) filter (where {v})::double as k_{r}" for r, v in rules.items())
    prior = "avg(1 / n) as i, " + ", ".join(f"avg(k_{r} / n) as m_{r}, var_pop(k_{r} / n) as v_{r}, sum(k_{r}) / sum(n) as c_{r}" for r in rules)
    less = ", ".join(f"v_{r} - m_{r} * (1 - m_{r}) * i as b_{r}" for r in rules)
    strength = ", ".join(f"case when b_{r} > 1e-12 then least(10000.0::double, greatest(1.0::double, m_{r} * (1 - m_{r}) / b_{r} - 1)) else 10000.0::double end as s_{r}" for r in rules)
    mean = ", ".join(f"(k_{r} + s_{r} * m_{r}) / (n + s_{r}) as p_{r}" for r in rules)
    off = ", ".join(f"{SURE}::double * sqrt(p_{r} * (1 - p_{r}) / (n + s_{r} + 1)) as o_{r}" for r in rules)
    failed = " or ".join(f"p_{r} - o_{r} > greatest({LIMIT}::double, {FACTOR}::double * least(m_{r}, c_{r}))" for r in rules)
    trusted = ", ".join(f"p_{r} + o_{r} < {TRUST}::double as t_{r}" for r in WATCHED)
    doc = " or ".join(f"({rules[r]}) and not t_{r}" for r in WATCHED)
    return f"""with d as (select row_number() over () as rid, doc_id, source, coalesce(text, '') as text from documents),
w as (select rid, doc_id, source, regexp_extract_all(text, '[^{space}]+') as words, length(regexp_replace(text, '[{space}]+', '', 'g')) as word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) as n_symbols,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{space}]')) as lines from d),
t as (select rid, i, words[i] || chr(31) || words[i + 1] || chr(31) || words[i + 2] as g from (select rid, words, unnest(range(1, len(words) - 1)) as i from w)),
twice as (select rid, g from t group by rid, g having count(*) > 1),
covered as (select rid, count(distinct pos) as n_repeat_words from (select t.rid, unnest([t.i, t.i + 1, t.i + 2]) as pos from t join twice on t.rid = twice.rid and t.g = twice.g) group by rid),
m as (select doc_id, source, len(words)::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, len(lines)::bigint as n_lines,
  coalesce(n_repeat_words, 0)::bigint as n_repeat_words from w left join covered on w.rid = covered.rid),
h as (select source, count(*)::double as n, {sums} from m group by source),
p as (select *, {strength} from (select *, {less} from (select {prior} from h))),
q as (select *, {off} from (select *, {mean} from h cross join p)),
v as (select source as host, {failed} as host_failed, {trusted} from q),
j as (select m.*, {rules['short']} or {rules['repeats']} as base_failed, host_failed, {doc} as doc_failed from m join v on m.source is not distinct from v.host)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not host_failed and not doc_failed as kept, host_failed, doc_failed from j"""


#: DuckDB's form of op10_host_rules.
ORACLE_SQL = _oracle()
