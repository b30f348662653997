"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within radius 3 have a fingerprint between them that is one bit from the one and at most two from
the other. So every distinct fingerprint emits its variants, variants are shuffled, and fingerprints that meet on a
variant are verified. Half the radius is one and a half bits; which side rounds up is settled by parity, as
fingerprints at distance 1 or 3 differ in the parity of their set bits:

* all fingerprints emit themselves and their 64 one-bit variants (finds distances 1 and 2),
* fingerprints of odd parity also emit two-bit variants whose two bits lie in the same half of the word: of any
  three differing bits two lie in one half, so distance 3 is found too, with 992 variants instead of 2016.

On one variant, fingerprints that reached it by at most one bit lie within 2 of each other, and those that reached
it by two bits lie within 3 of all of the former. So a star around one of the former holds every link that the
variant can show up to connectivity, and a hot variant costs as many links as it has fingerprints, not their square.
Pairs that meet elsewhere are linked there. Variants travel as packed numpy blocks, one for each bucket and batch;
the number of buckets follows the number of fingerprints, so a bucket stays within memory at any size.

``similar_groups`` joins texts by the similarity of their five-word shingles: texts that meet on one of many short independent
SimHashes are verified exactly, and what that leaves unlinked is found by an exact join of the texts that share enough shingles.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnfield.llm.common import large, lean_batches, materialize, shuffle_partitions, skewed_join, small
from cairnfield.llm.components import components

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Variants in one bucket, about; 10 bytes each.
BUCKET_VARIANTS = 1_500_000
#: Fingerprints whose variants are made at once: at least, and at most where there are many buckets to fill.
BATCH, MOST_BATCH = 2_000, 16_000

#: The similarity join: word shingles, least Jaccard similarity of their sets, and TABLES independent SimHashes of SEGMENT bits.
JOIN_SHINGLE, SIMILARITY = 5, 0.8
TABLES, SEGMENT = 18, 32
#: Within a segment a text is compared with so many next ones in hash order; links that this leaves out are found exactly afterwards.
NEIGHBOURS = 3
#: One hash in SHARE is looked at first; over a fifth of a text's hashes must be nobody else's to rule it out.
SHARE = 3
#: Texts in a block of a family: at least, and at most where it would take over MOST_BLOCKS; bytes of a block's sets; columns of its matrix at once.
BLOCK, MOST_BLOCK, MOST_BLOCKS, BLOCK_BYTES, COLUMNS = 128, 1_024, 20, 4_000_000, 4_096

_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

_ONE = np.array([1 << i for i in range(64)], np.uint64)
_TWO = np.array([(1 << i) | (1 << j) for half in (0, 32) for i in range(half, half + 32) for j in range(i + 1, half + 32)], np.uint64)
_MASKS = np.concatenate([np.zeros(1, np.uint64), _ONE, _TWO])
_EVEN = 65  # masks of up to one bit


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the word shingles, repeats included; 0 without words."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)
    words = _WORDS.findall(data)
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], ">u8")
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate([[0], ends[: -shingle]]).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)], ">u8")
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        total += np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long, one row for each row of ``docs``."""
    only = lean_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return only.mapInArrow(_fingerprints, "doc_id long, fp long")


def _mix(v: np.ndarray) -> np.ndarray:
    v = (v ^ (v >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return v ^ (v >> np.uint64(29))


def _popcount(v: np.ndarray) -> np.ndarray:
    return np.bitwise_count(v)


def _emit(buckets: int):
    """Batches of fingerprints to rows (bucket, variants, masks): packed variants and the number of each one's mask.

    With many buckets more fingerprints are packed at once, so that a row holds many variants of its bucket.
    """
    step = min(MOST_BATCH, max(BATCH, buckets * 32 // 561))

    def blocks(fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        odd = (_popcount(fps) & 1).astype(bool)
        for part, masks in ((fps[~odd], _MASKS[:_EVEN]), (fps[odd], _MASKS)):
            if len(part):
                yield (part[:, None] ^ masks[None, :]).ravel(), np.tile(np.arange(len(masks), dtype=np.uint16), len(part))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_fps = np.array(batch.column(0).to_numpy(zero_copy_only=False), np.int64).view(np.uint64)
            for at in range(0, len(all_fps), step):
                made = list(blocks(all_fps[at : at + step]))
                variants, masks = (np.concatenate(x) for x in zip(*made, strict=True))
                to = (_mix(variants) % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(to, kind="stable")
                variants, masks, to = variants[order], masks[order], to[order]
                present, first = np.unique(to, return_index=True)
                last = np.append(first[1:], len(to))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(present), pa.array([variants[a:b].tobytes() for a, b in zip(first, last, strict=True)], pa.binary()), pa.array([masks[a:b].tobytes() for a, b in zip(first, last, strict=True)], pa.binary())],
                    names=["bucket", "variants", "masks"],
                )

    return run


def _meet(rows: pa.Table) -> pa.Table:
    """Verified links between fingerprints that share a variant: a star for each variant, each link once."""
    variants = np.frombuffer(b"".join(x.as_buffer() for x in rows.column("variants")), np.uint64)
    masks = np.frombuffer(b"".join(x.as_buffer() for x in rows.column("masks")), np.uint16)
    order = np.argsort(variants, kind="stable")
    variants, masks = variants[order], masks[order]
    first = np.flatnonzero(np.append(True, variants[1:] != variants[:-1])) if len(variants) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(variants)))
    shared = np.repeat(size > 1, size)
    variants, masks = variants[shared], masks[shared]
    size = size[size > 1]
    if not len(size):
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    first = np.cumsum(size) - size
    fps = variants ^ _MASKS[masks]
    near = masks < _EVEN
    # The centre: the smallest fingerprint that reached the variant by one bit at most; without one, no link here.
    centre = np.minimum.reduceat(np.where(near, fps, np.uint64(0xFFFFFFFFFFFFFFFF)), first)
    has = np.logical_or.reduceat(near, first)
    centres, use = np.repeat(centre, size), np.repeat(has, size)
    a, b = centres[use], fps[use]
    ok = (a != b) & (_popcount(a ^ b) <= RADIUS)
    pairs = np.unique(np.stack([a[ok], b[ok]], 1), axis=0).view(np.int64) if ok.any() else np.zeros((0, 2), np.int64)
    return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links within the radius between the distinct fingerprints of column fp, enough to connect all that connect."""
    n = fps.count()
    spark = fps.sparkSession
    buckets = max(shuffle_partitions(spark), -(-n * 561 // BUCKET_VARIANTS))
    # Few fingerprints fit in one file split, but their variants do not: deal them out first.
    spread = fps.select("fp").repartition(max(6, -(-n // 20_000)))
    blocks = spread.mapInArrow(_emit(buckets), "bucket int, variants binary, masks binary")
    # As many tasks as buckets: a task's share stays the same at any size.
    return blocks.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_meet, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): the fingerprint and the smallest doc_id reachable over links of 3 bits or fewer.

    Exact copies share a fingerprint and are one node of the link graph, so thousands of copies cost no links.
    Null texts count as empty; texts without words have fingerprint zero and link like any other. Repeated rows stay
    repeated. Rows with a null id keep a row; they join a component only through their fingerprint, and a
    component of such rows alone has a null component_id. An empty table gives an empty result.
    """
    prints = materialize(fingerprint_table(docs, id_col, text_col), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")), "nodes")
    pairs = materialize(links(nodes), "pairs")
    size = pairs.count()
    by = nodes.where("node is not null").select("fp", "node")

    def named(ends: DataFrame, key: str, name: str) -> DataFrame:
        """``ends`` with the node of one end; the centre of a large star is a hot key."""
        degree = ends.groupBy(key).agg(F.count("*").alias("n"))
        return skewed_join(ends, by.select(F.col("fp").alias(key), F.col("node").alias(name)).join(degree, key), key, size).drop("n")

    ends = named(named(pairs, "a", "m"), "b", "n2").withColumnRenamed("n2", "n")
    reached = components(ends, "m", "n")
    placed = nodes.join(reached, "node", "left").select("fp", "n", F.coalesce("component", "node").alias("component_id"))
    # Copies of one text share a fingerprint, which may be a third of all rows.
    rows = nodes.agg(F.sum("n")).first()[0] or 0
    return skewed_join(prints, materialize(placed, "placed"), "fp", rows).select("doc_id", "fp", "component_id")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_hashes(text: str | None, shingle: int = JOIN_SHINGLE) -> tuple[int, np.ndarray]:
    """A hash of the sequence of lower-cased words, and the sorted set of XXH64 of its shingles; without words an empty set."""
    words = _WORDS.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    whole = digest(joined, SEED)
    if len(words) <= shingle:
        return whole, np.array([whole] if words else [], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-shingle]]).tolist()
    return whole, np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)], np.uint64))


def _spread(v: np.ndarray, number: int) -> np.ndarray:
    """Another 64-bit hash of each hash, one for each number."""
    v = v ^ np.uint64((0x9E3779B97F4A7C15 * (number + 1)) & 0xFFFFFFFFFFFFFFFF)
    v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(31))


def signature(hashes: np.ndarray, tables: int = TABLES) -> np.ndarray:
    """``tables`` SimHashes of SEGMENT bits of a set of hashes; a bit is set if it is set in over half of them."""
    wide = -(-tables * SEGMENT // 64)
    total = np.zeros(64 * wide, np.int64)
    for at in range(0, len(hashes), 16_384):
        part = np.stack([_spread(hashes[at : at + 16_384], k) for k in range(wide)], 1)
        total += np.unpackbits(part.view(np.uint8), axis=1).sum(0, dtype=np.int64)
    bits = np.packbits((2 * total > len(hashes)).reshape(-1, SEGMENT)[:tables], axis=1).astype(np.uint64)
    return sum(bits[:, i] << np.uint64(8 * i) for i in range(SEGMENT // 8))


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [shingle_hashes(t.as_py()) for t in batch.column(2)]
        keys = np.array([k for k, _ in found], np.uint64).view(np.int64)
        some = [h[h % np.uint64(SHARE) == 0].view(np.int64) for _, h in found]
        sizes, picked = (pa.array([len(h) for h in x], pa.int64()) for x in ([h for _, h in found], some))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys), sizes, picked, pa.array(some, pa.list_(pa.int64()))], names=["doc_id", "t", "key", "size", "picked", "some"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) to (key, hashes)."""
    for batch in batches:
        hashes = [shingle_hashes(t.as_py())[1].view(np.int64) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes, pa.list_(pa.int64()))], names=["key", "hashes"])


def _alone(sets: DataFrame) -> DataFrame:
    """(key, alone): how many hashes of a text's set (column hashes) no other text holds; texts without such hashes are left out.

    A hash of one text has one key: so hashes are aggregated, however many texts hold them, and neither joined nor collected.
    """
    holders = sets.select("key", F.explode("hashes").alias("hash")).groupBy("hash").agg(F.min("key").alias("key"), F.max("key").alias("last"))
    return holders.where("key = last").groupBy("key").agg(F.count("*").alias("alone"))


def _held(sets: DataFrame) -> DataFrame:
    """(key, held): for each text its hashes that other texts hold, too, each with the number of its texts: at most a row for each hash of a text on the way."""
    pairs = sets.select("key", F.explode("hashes").alias("hash"))
    shared = materialize(pairs.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    total = sets.agg(F.sum(F.size("hashes"))).first()[0] or 0
    return skewed_join(pairs, shared, "hash", total).groupBy("key").agg(F.collect_list(F.struct("hash", "n")).alias("held"))


def _live(least: float):
    """(key, size, hashes, texts) to (key, size, set, sig, prefix) of the texts that may have a similar one.

    ``set`` holds the hashes that other texts hold, too: overlaps need no others. In order of the number of their texts, the hashes of two
    similar texts meet in their prefixes, which are all but ``least`` of a text and one more; the first of these are held by nobody else.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, sets, sigs, prefixes = [], [], [], []
            for size, *held in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                hashes, texts = (x.values.to_numpy() for x in held)
                prefix = len(hashes) - int(np.ceil(least * size - 1e-9)) + 1
                keep.append(prefix > 0)
                if prefix > 0:
                    hashes = hashes.view(np.uint64)
                    hashes = hashes[np.lexsort((hashes, texts))]
                    sets.append(np.sort(hashes).tobytes())
                    sigs.append(signature(hashes).view(np.int64))
                    prefixes.append(hashes[:prefix].view(np.int64))
            out = batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(sets, pa.binary()), pa.array(sigs, longs), pa.array(prefixes, longs)], names=["key", "size", "set", "sig", "prefix"])

    return run


def _emit_segments(buckets: int):
    """(key, sig) to rows (bucket, variants, keys): packed segments of every table and the keys of their texts."""
    table = np.arange(TABLES, dtype=np.uint64)[None, :] << np.uint64(SEGMENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.array(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
            segments = np.array(batch.column(1).flatten().to_numpy(zero_copy_only=False), np.int64).view(np.uint64).reshape(-1, TABLES)
            variants = (segments | table).ravel()
            to = (_mix(variants) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(to, kind="stable")
            variants, to, named = variants[order], to[order], keys[order // TABLES]
            present, first = np.unique(to, return_index=True)
            last = np.append(first[1:], len(to))[: len(first)]
            yield pa.RecordBatch.from_arrays([pa.array(present), *(pa.array([x[i:j].tobytes() for i, j in zip(first, last, strict=True)], pa.binary()) for x in (variants, named))], names=["bucket", "variants", "keys"])

    return run


def _neighbours(rows: pa.Table) -> pa.Table:
    """Pairs of texts that share a segment: each with the next ones by a hash of text and segment."""
    variants, keys = (np.frombuffer(b"".join(x.as_buffer() for x in rows.column(n)), kind) for n, kind in (("variants", np.uint64), ("keys", np.int64)))
    order = np.lexsort((_mix(keys.view(np.uint64) ^ variants), variants))
    variants, keys = variants[order], keys[order]
    found = [np.zeros((0, 2), np.int64)]
    for step in range(1, NEIGHBOURS + 1):
        same = variants[step:] == variants[:-step]
        a, b = keys[:-step][same], keys[step:][same]
        found.append(np.stack([np.minimum(a, b), np.maximum(a, b)], 1))
    pairs = np.unique(np.concatenate(found), axis=0)
    return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})


def _verify(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y, n in zip(batch.column(2), batch.column(3), batch.column(4).to_pylist(), strict=True):
                both = len(np.intersect1d(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), assume_unique=True))
                keep.append(both >= least * (n - both) - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _quick_links(live: DataFrame, similarity: float) -> DataFrame:
    """(a, b): similar pairs among texts that share a segment of their SimHashes, a few for each text: what connects most near copies."""
    n = live.count()
    buckets = max(shuffle_partitions(live.sparkSession), -(-n * TABLES // BUCKET_VARIANTS))
    blocks = live.select("key", "sig").mapInArrow(_emit_segments(buckets), "bucket int, variants binary, keys binary")
    met = blocks.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_neighbours, "a long, b long").distinct()
    one = live.select("key", "set", "size")
    both = met.join(large(one.toDF("a", "x", "m")), "a").join(large(one.toDF("b", "y", "n")), "b").select("a", "b", "x", "y", F.col("m") + F.col("n"))
    return materialize(both.mapInArrow(_verify(similarity), "a long, b long"), "similar")


def _families(live: DataFrame) -> DataFrame:
    """(node, component): texts that shared hashes in prefixes connect; similar texts are in one family."""
    held = materialize(live.select("key", F.explode("prefix").alias("hash")), "prefixes")
    first = held.groupBy("hash").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1")
    return components(skewed_join(held, first, "hash", held.count()).where("first != key").select("first", "key").distinct(), "first", "key")


def _block_links(least: float):
    """Links between the groups of each family of a block: a forest of what similar texts connect."""

    def forest(groups: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
        own = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        many = count > 1
        own, column = own[many[column]], (np.cumsum(many) - 1)[column[many[column]]]
        order = np.argsort(column, kind="stable")
        own, column = own[order], column[order]
        both = np.zeros((len(sets), len(sets)))
        for at in range(0, int(many.sum()), COLUMNS):
            i, j = np.searchsorted(column, [at, at + COLUMNS])
            part = np.zeros((len(sets), COLUMNS), np.float32)
            part[own[i:j], column[i:j] - at] = 1
            both += part @ part.T
        near = both >= least * (sizes[:, None] + sizes[None, :] - both) - 1e-9
        near |= groups[:, None] == groups[None, :]
        label, now = np.arange(len(sets)), None
        while now is None or (now != label).any():
            label = label if now is None else now
            now = np.where(near, label[None, :], len(sets)).min(1)
            now = now[now]
        pairs = np.stack([groups, groups[label]], 1)
        return np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)

    def run(rows: pa.Table) -> pa.Table:
        family, groups, sizes = (rows.column(n).to_numpy() for n in ("family", "group", "size"))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("set")]
        order = np.argsort(family, kind="stable")
        ends = np.flatnonzero(np.append(family[order][1:] != family[order][:-1], True)) + 1
        found = [np.zeros((0, 2), np.int64)]
        for mine in np.split(order, ends[:-1]):
            if (groups[mine] != groups[mine[0]]).any():
                found.append(forest(groups[mine], sizes[mine], [sets[i] for i in mine]))
        pairs = np.concatenate(found)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    return run


def _remaining_links(live: DataFrame, groups: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links between ``groups`` (node, component) that connect all that similar texts of ``live`` connect.

    Texts of one family are compared all with all, in blocks: a task gets two blocks of one family or many small families, and
    returns a forest over their groups, so a family costs as many rows as it has texts times blocks, not pairs. A family of one group is settled.
    """
    named = live.select("key", "size", "set").join(large(groups.withColumnRenamed("node", "key")), "key", "left").withColumn("group", F.coalesce("component", "key")).drop("component")
    placed = named.join(large(materialize(_families(live), "families").toDF("key", "family")), "key")
    members = materialize(placed, "members")
    sums = members.groupBy("family").agg(F.count("*").alias("n"), F.sum(F.length("set")).alias("bytes"), F.min("group").alias("one"), F.max("group").alias("other"))
    texts = F.greatest(F.lit(BLOCK), F.least(F.lit(MOST_BLOCK), F.col("n") / MOST_BLOCKS))
    blocks = F.ceil(F.greatest(F.col("n") / texts, F.col("bytes") / BLOCK_BYTES)).alias("blocks")
    sizes = materialize(sums.where("one != other").select("family", "n", "bytes", blocks), "sizes")
    total = sizes.where("blocks = 1").agg(F.sum("bytes")).first()[0] or 0
    bins = max(shuffle_partitions(live.sparkSession), -(-int(total) // BLOCK_BYTES))
    rows = skewed_join(members, sizes.select("family", "n", "blocks"), "family", members.count())
    rows = rows.withColumn("block", F.pmod(F.xxhash64("key"), "blocks")).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    whole = F.col("blocks") == 1
    into = F.when(whole, F.pmod(F.xxhash64("family"), F.lit(bins))).otherwise(F.col("family"))
    pair = rows.select(into.alias("bin"), whole.alias("whole"), F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "family", "group", "size", "set")
    return materialize(pair.groupBy("bin", "whole", "i", "j").applyInArrow(_block_links(similarity), "a long, b long"), "remaining")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, t, key, group): groups of texts that links of Jaccard ``similarity`` or more connect, over five-word shingles; exact.

    ``t`` is xxhash64 of the text and ``key`` a hash of its lower-cased words: texts with equal words are one node. A text of whose
    shingles fewer than ``similarity`` occur in other texts has no similar one: a share of all shingles shows that for most texts, all shingles for
    the rest. Of what is left, texts that share a segment of their SimHashes are compared with the next ones in hash order, so large groups
    of near copies are found by pairs in proportion to their texts. All links between these groups are then found within families, by blocks.
    Texts without words are one group. Null texts count as empty. Rows stay repeated.
    """
    only = lean_batches(docs).select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))
    kind = only.schema["doc_id"].dataType.simpleString()
    prints = materialize(only.mapInArrow(_prints, f"doc_id {kind}, t long, key long, size long, picked long, some array<long>"), "prints")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t")).alias("one")
    nodes = materialize(prints.groupBy("key").agg(one, F.max("size").alias("size"), F.max("picked").alias("picked"), F.count("*").alias("n")), "nodes")
    alone = _alone(prints.select("key", F.col("some").alias("hashes")))
    maybe = nodes.join(large(alone), "key", "left").where(F.col("size") - F.coalesce("alone", F.lit(0)) >= similarity * F.col("size") - 1e-6).where("size > 0")
    wanted = materialize(maybe.select("key", "size", F.col("one.doc_id").alias("_id"), F.col("one.t").alias("_t")), "wanted")
    near = small(wanted.drop("size"))
    texts = only.join(near, (only.t == near["_t"]) & only.doc_id.eqNullSafe(near["_id"])).select("key", "text")
    sets = materialize(texts.mapInArrow(_sets, "key long, hashes array<long>"), "sets")
    if sets.count() > wanted.count():  # rows that repeat both id and text
        sets = materialize(sets.dropDuplicates(["key"]), "sets")
    held = _held(sets).join(large(wanted), "key").select("key", "size", F.col("held.hash").alias("hashes"), F.col("held.n").alias("texts"))
    live = materialize(held.mapInArrow(_live(similarity), "key long, size long, set binary, sig array<long>, prefix array<long>"), "live")
    linked = _quick_links(live, similarity)
    more = _remaining_links(live, materialize(components(linked, "a", "b"), "components"), similarity)
    final = materialize(components(linked.union(more), "a", "b"), "components").withColumnRenamed("node", "key")
    named = nodes.join(large(final), "key", "left").select("key", "n", F.coalesce("component", "key").alias("group"))
    return skewed_join(prints.select("doc_id", "t", "key"), named, "key", prints.count()).select("doc_id", "t", "key", "group")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of similar texts (five-word shingles, 0.8): the one with the smallest id.

    Rows without an id stay only where no row of their group has one; of several texts under the smallest id one stays, and
    of rows that repeat both id and text one stays. A row that is nobody's duplicate always stays.
    """
    found = materialize(similar_groups(docs, id_col, text_col), "groups")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t")
    first = found.groupBy("group").agg(F.min(row).alias("first"), F.count("*").alias("n")).where("n > 1")
    # Rows of groups of one stay without a join: only what goes, and first rows that are repeated, are looked up.
    members = skewed_join(found, first, "group", found.count())
    told = materialize(members.groupBy("doc_id", "t").agg(F.min((row == F.col("first")).cast("int")).alias("stays"), F.count("*").alias("n")), "members")
    gone = told.where("stays = 0 or n > 1").select(F.col("doc_id").alias("_id"), F.col("t").alias("_t"), "stays")
    at = lambda other: docs[id_col].eqNullSafe(other["_id"]) & (F.xxhash64(docs[text_col]) == other["_t"])
    gone = small(gone)
    kept = docs.join(gone, at(gone), "left_anti")
    again = told.where("stays = 1 and n > 1").select(F.col("doc_id").alias("_id"), F.col("t").alias("_t"))
    if again.isEmpty():
        return kept
    again = small(again)
    return kept.unionByName(docs.join(again, at(again), "left_semi").dropDuplicates([id_col, text_col]))
