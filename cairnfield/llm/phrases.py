"""Phrases by contiguous pattern growth: occurrences are projected onto their first word, and each prefix is grown to the right.

Words are counted first. Words of fewer than ``MIN_COUNT`` occurrences cannot be part of a phrase and end the growth.
Then every occurrence of a frequent word becomes a pointer to what follows it, at most ``MAX_WORDS - 1`` words of the same
piece, and pointers are projected by prefix: equal ones of a partition are counted together and travel once, in sorted arrays.
One task takes each prefix: it sums its pointers by the next word, and depth-first, while a longer prefix stays
frequent, by the word after it (``grow``). A prefix of over ``POINTERS`` occurrences is split into as many tasks as it
has that many, by what follows the word; whatever falls below the threshold in its part is then summed over the parts.

The ``DICTIONARY`` most frequent words stand for themselves as numbers while pointers travel; the driver hands this bounded
list to the tasks. Frequent words beyond it lie in phrases that are rarer still: those phrases are counted as text, by one
aggregation. Scores, the cut of each phrase and the removal of contained phrases are joins and aggregations.

Defined cases: null texts are empty; a null lang is ``und``; repeated rows count repeatedly; ties of the ranking
are broken by the phrase in byte order; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnfield.llm.common import lean_batches, materialize, shuffle_partitions, small, table

MIN_COUNT = 10
MAX_WORDS = 3
#: A candidate goes if a longer one that holds it has this share of its occurrences, in hundredths.
CONTAINED = 50
TOP = 2_000
SCALE = 1_000_000
#: Most words that travel as numbers, of BITS bits each; a pointer and its prefix fit a long.
DICTIONARY, BITS = 1_000_000, 20
#: Occurrences of a prefix in one task.
POINTERS = 2_000_000
#: Words that a task counts, or points from, before it hands on.
FLUSH = 2_000_000
#: Parts in which the best phrases of a language are ranked first.
RANKERS = 64

_BREAK = b"."
#: Bytes of a text: capitals to small letters, ends of pieces to one mark, tabs to spaces.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")


def tokens(text: bytes | None) -> list[bytes]:
    """The words of a text; ``_BREAK`` stands between pieces."""
    return text.translate(_PLAIN).replace(b"\n", b" . ").split() if text else []


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        for lang, text in zip(batch.column(0).to_pylist(), texts, strict=True):
            yield lang, tokens(text.as_py())


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, f) of the texts since the last flush."""
    counts: dict[str, Counter] = defaultdict(Counter)

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, known in counts.items():
            known.pop(_BREAK, None)
            words = pa.array(list(known), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(known), pa.string()), words, pa.array(list(known.values()), pa.int64())], names=["lang", "word", "f"])
        counts.clear()

    seen = 0
    for lang, words in _texts(batches):
        counts[lang].update(words)
        seen += len(words)
        if seen > FLUSH:
            yield from flush()
            seen = 0
    yield from flush()


def numbered(words: DataFrame, min_count: int = MIN_COUNT, most: int = DICTIONARY) -> tuple[list, bool]:
    """The frequent words (lang, word, f), at most ``most`` of the most frequent, and whether these are all.

    The threshold comes from a histogram of counts in steps of a sixteenth of a power of two, so it needs no sort.
    """
    step = F.floor(F.log2("f") * 16)
    frequent = words.where(F.col("f") >= min_count)
    left, least, every = most, None, True
    for r in sorted(frequent.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        left -= r["count"]
        if left < 0:
            every = False
            break
        least = r["step"]
    if least is None:
        return [], every
    chosen = frequent.where(step >= least).select("lang", "word", "f").toArrow()
    return sorted(zip(*(chosen.column(c).to_pylist() for c in ("lang", "word", "f")), strict=True)), every


def grow(prefix: tuple, after: list[np.ndarray], counts: np.ndarray, least: list[int], keep) -> None:
    """Calls ``keep`` with every pattern that continues ``prefix`` and its count, if it has ``least`` occurrences (one bound for each length).

    ``after`` holds, for each pointer, its next words, one array for each distance; pointers are sorted and 0 is the end of a piece.
    """
    nexts = after[0]
    starts = np.flatnonzero(np.concatenate(([True], nexts[1:] != nexts[:-1])))
    totals = np.add.reduceat(counts, starts)
    ends = np.append(starts[1:], len(nexts))
    for i in np.flatnonzero((totals >= least[0]) & (nexts[starts] > 0)):
        lo, hi = starts[i], ends[i]
        longer = (*prefix, int(nexts[lo]))
        keep(longer, int(totals[i]))
        if len(after) > 1:
            grow(longer, [a[lo:hi] for a in after[1:]], counts[lo:hi], least[1:], keep)


def _pointers(ids: dict[str, dict[bytes, int]], parts: np.ndarray):
    """Texts to rows (prefix, part, near, far, times): the next word, the one after it and the number of each pointer."""
    mask = (1 << BITS) - 1

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, held = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            all_ids = np.concatenate(runs)
            a, b, c = all_ids[:-2], all_ids[1:-1], all_ids[2:]
            on = (a > 0) & (b > 0)
            keys, counts = np.unique(a[on] << 2 * BITS | b[on] << BITS | c[on], return_counts=True)
            prefix, after = keys >> 2 * BITS, keys & (1 << 2 * BITS) - 1
            part = np.where(parts[prefix] > 1, (after * 0x9E3779B1 >> 7) % parts[prefix], 0)
            order = np.lexsort((after, part, prefix))
            prefix, part, after, counts = prefix[order], part[order], after[order], counts[order]
            starts = np.flatnonzero(np.concatenate(([True], (prefix[1:] != prefix[:-1]) | (part[1:] != part[:-1])))) if len(keys) else np.zeros(0, int)
            rows, near, far, times = len(starts), (after >> BITS).astype(np.uint32), (after & mask).astype(np.uint32), counts.astype(np.uint32)
            offsets = pa.array(np.append(starts, len(keys)) * 4, pa.int32()).buffers()[1]
            cells = [pa.Array.from_buffers(pa.binary(), rows, [None, offsets, pa.py_buffer(x.tobytes())]) for x in (near, far, times)]
            yield pa.RecordBatch.from_arrays([pa.array(prefix[starts].astype(np.int32)), pa.array(part[starts].astype(np.int32)), *cells], names=["prefix", "part", "near", "far", "times"])

        for lang, words in _texts(batches):
            known = ids.get(lang)
            if known and words:
                runs.append(np.array([0, *map(known.get, words, [0] * len(words)), 0, 0], np.int64))
                held += len(words)
            if held > FLUSH:
                yield from flush()
                runs, held = [], 0
        if held:
            yield from flush()

    return project


def _other_windows(ids: dict[str, dict[bytes, int]]):
    """Texts to (lang, phrase, m, f) for phrases of 2 to MAX_WORDS words of which one is not numbered, counted by flush."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            cells = [pa.array([k[0] for k in counts], pa.string()), pa.array([b" ".join(k[1]) for k in counts], pa.binary()).cast(pa.string()), pa.array([len(k[1]) for k in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(cells, names=["lang", "phrase", "m", "a"])
            counts.clear()

        for lang, words in _texts(batches):
            known = ids.get(lang, {})
            strange = [w != _BREAK and w not in known for w in words]
            for m in range(2, MAX_WORDS + 1):
                for i in range(len(words) - m + 1):
                    if any(strange[i : i + m]) and _BREAK not in (phrase := tuple(words[i : i + m])):
                        counts[lang, phrase] += 1
            if len(counts) > FLUSH // 10:
                yield from flush()
        yield from flush()

    return windows


def _grown(langs: list[tuple[int, str]], names: list[str], parts: np.ndarray, least: int):
    """Pointers in order of prefix to (lang, phrase, m, a). Several parts of a prefix hold a shorter pattern, but only one a
    pattern of full length: the shorter ones leave without a bound there, to be summed."""
    first = [i for i, _ in langs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, held = [], None, []

        def finish() -> None:
            prefix = at[0]
            near, far, times = (np.frombuffer(b"".join(h[i] for h in held), np.uint32).astype(np.int64) for i in range(3))
            order = np.argsort(near << BITS | far, kind="stable")
            grow((prefix,), [near[order], far[order]], times[order], [least if parts[prefix] <= 1 else 1, least], lambda p, a: out.append((p, a)))

        def batch_of() -> pa.RecordBatch:
            cells = [pa.array([langs[bisect_right(first, p[0]) - 1][1] for p, _ in out], pa.string()), pa.array([" ".join([names[i] for i in p]) for p, _ in out], pa.string()), pa.array([len(p) for p, _ in out], pa.int32()), pa.array([a for _, a in out], pa.int64())]
            out.clear()
            return pa.RecordBatch.from_arrays(cells, names=["lang", "phrase", "m", "a"])

        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(5)]
            for prefix, part, *arrays in zip(*cols, strict=True):
                if (prefix, part) != at:
                    if held:
                        finish()
                    at, held = (prefix, part), []
                    if len(out) > FLUSH // 20:
                        yield batch_of()
                held.append(arrays)
        if held:
            finish()
        yield batch_of()

    return run


def counted(docs: DataFrame, min_count: int = MIN_COUNT, dictionary: int = DICTIONARY, pointers: int = POINTERS, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two tables: words (lang, word, f), all of them, and phrases (lang, phrase, m, a) of 2 to MAX_WORDS words and ``min_count`` occurrences."""
    spark = docs.sparkSession
    only = lean_batches(docs).select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    words = materialize(only.mapInArrow(_count_words, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f")), "words")
    chosen, every = numbered(words, min_count, dictionary)
    ids: dict[str, dict[bytes, int]] = defaultdict(dict)
    langs: list[tuple[int, str]] = []
    for i, (lang, word, _) in enumerate(chosen, 1):
        if lang not in ids:
            langs.append((i, lang))
        ids[lang][word.encode()] = i
    parts = np.array([0, *(-(-f // pointers) for *_, f in chosen)], np.int64)
    numbers = spark.sparkContext.broadcast((dict(ids), parts))
    names = spark.sparkContext.broadcast((langs, ["", *(word for _, word, _ in chosen)], parts))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _pointers(*numbers.value)(batches)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _grown(*names.value, min_count)(batches)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _other_windows(numbers.value[0])(batches)

    kind = "lang string, phrase string, m int, a long"
    pointing = only.mapInArrow(project, "prefix int, part int, near binary, far binary, times binary")
    found = pointing.repartition(shuffle_partitions(spark), "prefix", "part").sortWithinPartitions("prefix", "part").mapInArrow(expand, kind)
    if not every:
        found = found.unionByName(only.mapInArrow(others, kind))
    if not every or (parts > 1).any():
        found = found.groupBy("lang", "phrase", "m").agg(F.sum("a").alias("a")).where(F.col("a") >= min_count)
    return words, materialize(found, "phrases")


def _cut_scores(words: DataFrame, phrases: DataFrame, min_count: int) -> DataFrame:
    """(lang, phrase, m, a, l, r, score): the lowest-scoring cut of each candidate, the smallest among equals."""
    spaced = lambda lo, n: F.array_join(F.slice("w", lo, n), " ")
    cut = phrases.withColumn("w", F.split("phrase", " ", -1)).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
    sides = cut.select("lang", "phrase", "m", "a", "k", spaced(F.lit(1), F.col("k")).alias("left"), spaced(F.col("k") + 1, F.col("m") - F.col("k")).alias("right"))
    # No part of a phrase is rarer than the phrase.
    counts = words.where(F.col("f") >= min_count).select("lang", F.col("word").alias("part"), "f").unionByName(phrases.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f")))
    for side, name in (("left", "l"), ("right", "r")):
        sides = sides.join(counts.select("lang", F.col("part").alias(side), F.col("f").alias(name)), ["lang", side])
    square, both = "cast(a as decimal(15,0)) * cast(a as decimal(15,0))", "cast(l as decimal(19,0)) * cast(r as decimal(19,0))"
    score = F.expr(f"cast({SCALE} as decimal(7,0)) * ({square}) div ({both})")
    scored = sides.withColumn("score", score)
    least = F.min_by(F.struct("l", "r", "score"), F.struct("score", "k"))
    return scored.groupBy("lang", "phrase", "m", "a").agg(least.alias("c")).select("lang", "phrase", "m", "a", "c.l", "c.r", "c.score")


def collocations(docs: DataFrame, top: int = TOP, min_count: int = MIN_COUNT, dictionary: int = DICTIONARY, pointers: int = POINTERS, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` candidates of each language."""
    words, phrases = counted(docs, min_count, dictionary, pointers, lang_col, text_col)
    inner = phrases.where(F.col("m") > 2).withColumn("w", F.split("phrase", " ", -1))
    held = inner.select("lang", F.explode(F.transform(F.sequence(F.lit(1), F.col("m") - 1), lambda i: F.array_join(F.slice("w", i, 2), " "))).alias("phrase"), F.col("a").alias("longer"))
    most = held.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = _cut_scores(words, phrases, min_count).join(most, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < CONTAINED * F.col("a")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = left.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(RANKERS)))
    first = some.withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(small(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE_SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         regexp_extract_all(unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') AS w
  FROM documents),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
f AS (
  SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase, count(*) AS a
  FROM places, (VALUES (1), (2), (3)) v(m) WHERE i + m - 1 <= len(w) GROUP BY 1, 2, 3),
candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND a >= 10),
cuts AS (
  SELECT c.lang, c.phrase, c.m, c.a, c.k, x.a AS l, y.a AS r, (1000000::HUGEINT * c.a * c.a) // (x.a::HUGEINT * y.a) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : c.k], ' ') AND x.m = c.k
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1 :], ' ') AND y.m = c.m - c.k),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, phrase, max(a) AS b
  FROM (SELECT lang, a, array_to_string(w[1:2], ' ') AS phrase FROM candidates WHERE m = 3 UNION ALL SELECT lang, a, array_to_string(w[2:3], ' ') FROM candidates WHERE m = 3)
  GROUP BY 1, 2),
left_over AS (SELECT b.* FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase WHERE g.b IS NULL OR 100 * g.b < 50 * b.a),
totals AS (SELECT lang, sum(a) AS n FROM f WHERE m = 1 GROUP BY lang)
SELECT o.lang, row_number() OVER (PARTITION BY o.lang ORDER BY o.score DESC, o.a DESC, o.phrase) AS rank, o.phrase, o.a, o.l, o.r, t.n::BIGINT AS n, o.score::BIGINT AS score
FROM left_over o JOIN totals t ON t.lang = o.lang
QUALIFY rank <= 2000
"""
