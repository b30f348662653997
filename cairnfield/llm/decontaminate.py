"""Benchmark decontamination by SimHash of item-sized windows, with DataFrame functions only.

* Windows. A window at similarity t or more shares one of the item's rarest shingles whose weight is over 1 - t of the
  item's (prefix filter), since less than that can be missing. So every window of the item's length that holds such a
  shingle, at each of its places in the document, is fingerprinted; phrases common to many items cost little.
* Candidates. Fingerprints are cut into ``BLOCKS`` blocks of 8 bits. Items are filed under each of their rarest shingles with every value
  of each block within ``FLIPS`` bits, so a window finds all items within ``RADIUS`` = 23 bits that have its length and its shingle,
  and meets no others; by the prefix filter no similar item is among those. Two texts at similarity 0.8 differ in 9.7 bits
  on average and in over 23 with a probability of about 1 in 100,000. A window that many documents hold is looked up once.
* Verification. Exact weighted-shingle similarity decides; weights are how often a shingle occurs. Only ids, starts and
  fingerprints take part in the look-up; shingle arrays are fetched for pairs that passed it.

Texts are scanned twice, once for shingles and once for the documents that have any of them. Defined cases: null texts count as
empty; items without words match nothing; items shorter than a shingle are one shingle; a document shorter than the item
is one window; repeated rows and items and null ids each get their own result; empty tables give no matches; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnfield.llm.common import large, materialize, small

SHINGLE = 5
SIMILARITY = 0.8
#: Blocks of 8 bits; with FLIPS in every block a pair within RADIUS agrees in one of them at least.
BLOCKS, FLIPS = 8, 2
RADIUS = BLOCKS * (FLIPS + 1) - 1
#: The values within FLIPS bits of zero.
NEAR = [v for v in range(256) if v.bit_count() <= FLIPS]
#: Four counters of 16 bits in a long hold this many shingles.
LANE = 30_000
#: Words of the lower-cased text: runs of anything but ASCII punctuation, space and controls, so that punctuation hides no passage.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    """Hashes of the words; shingles are hashes of runs of them."""
    return F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))


def _shingles(words: Column, k: int) -> Column:
    """Hash of the k words from each position on; empty if there are fewer."""
    at = F.sequence(F.lit(0), F.size(words) - k)
    return F.when(F.size(words) >= k, F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))).otherwise(F.array().cast("array<bigint>"))


def simhash(shingles: Column) -> Column:
    """Signed 64-bit SimHash; a bit is set if it is set in over half of the shingles, repeats included.

    Bits k, k + 16, k + 32 and k + 48 are counted in one long; longer arrays than those counters hold are counted bit by bit.
    """
    spread = 0x0001000100010001
    sums = F.aggregate(
        F.when(F.size(shingles) <= LANE, shingles).otherwise(F.array().cast("array<bigint>")),
        F.struct(*[F.lit(0).cast("long").alias(f"s{k}") for k in range(16)]),
        lambda acc, h: F.struct(*[(acc[f"s{k}"] + F.shiftrightunsigned(h, k).bitwiseAND(F.lit(spread).cast("long"))).alias(f"s{k}") for k in range(16)]),
    )

    def single(b: int) -> Column:
        return F.aggregate(shingles, F.lit(0), lambda acc, h: acc + F.shiftrightunsigned(h, b).bitwiseAND(F.lit(1)).cast("int"))

    def word(of) -> Column:
        out = F.lit(0).cast("long")
        for b in range(64):
            out = out.bitwiseOR(F.when(2 * of(b) > F.size(shingles), F.lit(-(1 << 63) if b == 63 else 1 << b).cast("long")).otherwise(F.lit(0).cast("long")))
        return out

    lanes = F.get(F.transform(F.array(sums), lambda t: word(lambda b: F.shiftrightunsigned(t[f"s{b % 16}"], 16 * (b // 16)).bitwiseAND(F.lit(0xFFFF)))), F.lit(0))
    return F.when(F.size(shingles) <= LANE, lanes).otherwise(word(single))


def _marked(shingles: Column) -> Column:
    """Repeats told apart: the set of (shingle, how many before it), so set sizes count weights."""
    repeats = F.transform(shingles, lambda h, i: F.xxhash64(h, F.size(F.filter(F.slice(shingles, F.lit(1), i + 1), lambda x: x == h))))
    return F.when(F.size(F.array_distinct(shingles)) == F.size(shingles), F.transform(shingles, lambda h: F.xxhash64(h, F.lit(1)))).otherwise(repeats)


def prepare(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, same, len, k, shingles, marked, fp) of every item with words; k is the length of its shingles, ``same`` hashes them."""
    words = benchmark.select(F.col(item_col).alias("item"), _words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    sized = words.select("item", F.size("w").alias("len"), F.least(F.size("w"), F.lit(SHINGLE)).alias("k"), "w")
    shingles = sized.select("item", "len", "k", F.when(F.size("w") >= SHINGLE, _shingles(F.col("w"), SHINGLE)).otherwise(F.array(_whole(F.col("w")))).alias("shingles"))
    return shingles.select("item", F.xxhash64("len", "shingles").alias("same"), "len", "k", "shingles", _marked(F.col("shingles")).alias("marked"), simhash(F.col("shingles")).alias("fp"))


def _whole(words: Column) -> Column:
    """One shingle of all words, for fewer than SHINGLE of them: the same hash that _shingles gives for that length."""
    out = None
    for k in range(1, SHINGLE):
        h = F.xxhash64(*[F.get(words, F.lit(j)) for j in range(k)])
        out = F.when(F.size(words) == k, h) if out is None else out.when(F.size(words) == k, h)
    return out


def anchors(items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(k, h, len, same): each item's rarest shingles, over 1 - similarity of its weight."""
    one = items.dropDuplicates(["same"]).select("same", "len", "k", F.size("shingles").alias("total"), F.explode("shingles").alias("h"))
    weights = one.groupBy("same", "len", "k", "total", "h").agg(F.count("*").alias("weight"))
    df = weights.groupBy(F.col("h").alias("h2")).agg(F.count("*").alias("df"))
    known = weights.join(large(df), F.col("h") == F.col("h2")).select("same", "len", "k", "total", F.struct("df", "h", "weight").alias("s"))
    ordered = known.groupBy("same", "len", "k", "total").agg(F.sort_array(F.collect_list("s")).alias("s"))
    # Shingles in order of rarity until more than (1 - similarity) of the weight is taken.
    running = F.transform("s", lambda x, i: F.struct(x["h"].alias("h"), F.aggregate(F.slice("s", F.lit(1), i), F.lit(0).cast("long"), lambda acc, y: acc + y["weight"]).alias("before")))
    taken = ordered.select("same", "len", "k", "total", F.explode(running).alias("x")).where(F.col("x.before") <= (1 - similarity) * F.col("total") + 1e-9)
    return taken.select("k", F.col("x.h").alias("h"), "len", "same")


def windows(docs: DataFrame, marks: DataFrame, sizes: list[int]) -> DataFrame:
    """(row, h, first, last, len): windows of ``len`` words to fingerprint, by their rare shingle h and first and last start. ``sizes``: shingle lengths."""
    with_words = docs.select("row", _words(F.col("text")).alias("w"))
    # One pass for all shingle lengths: their arrays follow each other, so a place tells length and position.
    placed = with_words.select("row", F.size("w").alias("n"), F.posexplode(F.concat(*[_shingles(F.col("w"), k) for k in sizes])).alias("at", "h"))
    k, pos, behind = F.lit(sizes[-1]), F.col("at"), F.lit(0)
    for size in sizes[:-1]:
        behind = behind + F.greatest(F.lit(0), F.col("n") - size + 1)
        pos = F.when(F.col("at") >= behind, F.col("at") - behind).otherwise(pos)
    behind = F.lit(0)
    for i, size in enumerate(sizes[:-1]):
        behind = behind + F.greatest(F.lit(0), F.col("n") - size + 1)
        k = F.when(F.col("at") < behind, F.lit(size)) if i == 0 else k.when(F.col("at") < behind, F.lit(size))
    k = k.otherwise(F.lit(sizes[-1])) if len(sizes) > 1 else k
    mine = small(marks.select(F.col("h").alias("h2"), F.col("k").alias("k2"), "len").distinct())
    found = placed.join(mine, (F.col("h") == F.col("h2")) & (k == F.col("k2")))
    first = F.greatest(F.lit(0), pos + F.col("k2") - F.col("len"))
    last = F.least(pos, F.greatest(F.lit(0), F.col("n") - F.col("len")))
    return found.select("row", "h", first.alias("first"), last.alias("last"), "len").distinct()


def _cut(held: DataFrame, at: Column, *more: Column) -> DataFrame:
    """(row, start, len, ..., shingles) for each struct of ``at`` of the documents (row, w, sh, at)."""
    one = held.select("row", "w", "sh", F.explode(at).alias("x"))
    words = F.least(F.col("x.len"), F.size("w"))
    runs = F.slice("sh", F.col("x.start") + 1, F.greatest(F.lit(0), words - SHINGLE + 1))
    few = F.array(_whole(F.slice("w", F.col("x.start") + 1, words)))
    return one.select("row", "x.*", *more, F.when(words >= SHINGLE, runs).otherwise(few).alias("shingles"))


def index(items: DataFrame, marks: DataFrame) -> DataFrame:
    """(h, len, block, value, same, fp): the items under each of their rarest shingles and all values within FLIPS bits of each of their blocks."""
    filed = marks.select("h", "len", "same").distinct().join(items.select("same", "fp").distinct(), "same")
    one = filed.select("h", "len", "same", "fp", F.posexplode(_blocks(F.col("fp"))).alias("block", "own"))
    return one.select("h", "len", "block", F.explode(F.transform(F.array(*map(F.lit, NEAR)), lambda m: m.bitwiseXOR(F.col("own")))).alias("value"), "same", "fp")


def candidates(windows: DataFrame, filed: DataFrame) -> DataFrame:
    """(h, len, fp, same, fp2): each window (h, len, fp) with the items that are filed under its shingle, its length and one of its blocks."""
    probes = windows.select("h", "len", "fp", F.posexplode(_blocks(F.col("fp"))).alias("block", "value"))
    return probes.join(small(filed.withColumnRenamed("fp", "fp2")), ["h", "len", "block", "value"]).select("h", "len", "fp", "same", "fp2")


def _blocks(fp: Column) -> Column:
    return F.array(*[F.shiftrightunsigned(fp, 8 * b).bitwiseAND(F.lit(255)).cast("int") for b in range(BLOCKS)])


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, t, item, start, len, distance, similarity): verified windows; ``start`` in words, ``t`` hashes the text."""
    only = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    # The text's hash tells repeated ids apart; equal rows have equal windows.
    rows = only.select(F.struct("doc_id", F.xxhash64("text").alias("t")).alias("row"), "text")
    items = materialize(prepare(benchmark, item_col), "items")
    sizes = sorted(r["k"] for r in items.select("k").distinct().collect())
    marks = materialize(anchors(items, similarity), "anchors")
    # Without items there are no sizes; any size then gives the empty result.
    where = materialize(windows(rows, marks, sizes or [SHINGLE]), "windows")
    wanted = small(where.groupBy(F.col("row").alias("_row")).agg(F.collect_set(F.struct("first", "last", "len")).alias("at")), 20_000)
    texts = rows.join(wanted, F.col("row").eqNullSafe(F.col("_row"))).select("row", _words(F.col("text")).alias("w"), "at").dropDuplicates(["row"])
    held = materialize(texts.select("row", "w", _shingles(F.col("w"), SHINGLE).alias("sh"), "at"), "held")
    starts = F.array_distinct(F.flatten(F.transform("at", lambda x: F.transform(F.sequence(x["first"], x["last"]), lambda i: F.struct(i.alias("start"), x["len"].alias("len"))))))
    prints = materialize(_cut(held, starts).select("row", "start", "len", simhash(F.col("shingles")).alias("fp")), "prints")
    brought = where.select("row", "h", "len", F.explode(F.sequence("first", "last")).alias("start"))
    # A window's row unfolds to all its starts: hundreds of times the bytes that Spark sees, so it is never left to Spark to broadcast them.
    probes = materialize(prints.join(large(brought), ["row", "start", "len"]), "probes")
    met = candidates(probes.select("h", "len", "fp").distinct(), index(items, marks))
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))).alias("distance")
    found = small(materialize(met.select("h", "len", "fp", "same", distance).where(F.col("distance") <= RADIUS).distinct(), "found"))
    near = materialize(probes.join(found, ["h", "len", "fp"]).select("row", "start", "len", "same", "distance").distinct(), "near")
    mine = small(near.groupBy(F.col("row").alias("_row")).agg(F.collect_list(F.struct("start", "len", "same", "distance")).alias("near")), 20_000)
    cut = _cut(held.join(mine, F.col("row").eqNullSafe(F.col("_row"))), F.col("near"))
    right = small(items.select("item", F.col("same").alias("same2"), F.col("marked").alias("marked2")))
    pairs = cut.select("row", "start", "len", "same", "distance", _marked(F.col("shingles")).alias("marked")).join(right, F.col("same") == F.col("same2"))
    shared = F.size(F.array_intersect("marked", "marked2"))
    whole = pairs.withColumn("similarity", shared / (F.size("marked") + F.size("marked2") - shared)).where(F.col("similarity") >= similarity - 1e-12)
    return whole.select("row.doc_id", F.col("row.t").alias("t"), "item", "start", "len", "distance", "similarity").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """One row for each row of ``docs``: (doc_id, contaminated, n_items, item_ids, best_similarity, first_word)."""
    found = matches(docs, benchmark, id_col, text_col, item_col)
    verdict = materialize(found.groupBy("doc_id", "t").agg(F.sort_array(F.collect_set("item")).alias("item_ids"), F.max("similarity").alias("best_similarity"), F.min("start").alias("first_word")), "leaks")
    leaks = small(verdict.select(F.col("doc_id").alias("_id"), "t", "item_ids", "best_similarity", "first_word"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("h"))
    joined = rows.join(leaks, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("t")), "left")
    ids = F.coalesce("item_ids", F.array().cast(leaks.schema["item_ids"].dataType))
    return joined.select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), "best_similarity", "first_word")


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a benchmark item."""
    found = small(materialize(matches(docs, benchmark, id_col, text_col).select("doc_id", "t").distinct(), "leaks"))
    return docs.join(found, docs[id_col].eqNullSafe(found["doc_id"]) & (F.xxhash64(docs[text_col]) == found["t"]), "left_anti")
