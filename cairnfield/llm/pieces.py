"""SentencePiece encoding over a table of distinct chunks.

The pieces of a byte-pair model never cross the start of a marked word (white space becomes a marker that only leads
pieces), so a text is the concatenation of chunks that are segmented independently. ``Splitter`` derives the places where no piece
can cross from the vocabulary: before markers, before characters that no piece joins to an earlier letter, and around
characters that are in no longer piece. Each distinct chunk of the corpus is counted, then segmented once, by the library.

Frequent chunks travel to every task as one bounded table: those with most occurrences, at most ``FREQUENT`` short ones and the fewer than
``FREQUENT`` that make up more than that share of all counted. A chunk counts where a task meets it ``LOCAL`` times or more, so rare
ones are not shuffled for it. The other chunks leave their texts as rows (text, chunk); none is a hot key. Sorted by chunk, each
distinct one is segmented once, and its ids return to its texts, which are packed on the way and are cut once more: every position
takes its ids from the two tables. The library decodes the row of ids. Texts meet their ids under a hash of id and text, so that copies of
one text spread; if two rows share a hash, both get the ids of both, which changes nothing, as ids depend on the chunk alone.

A model with another normalisation, without byte fallback or whose pieces may cross markers has no such places: each text is
segmented by itself, where it is.

Defined cases: null texts are empty and give the end id only; repeated rows stay repeated; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnfield.llm.common import lean_batches, materialize, shuffle_partitions, table

#: Most chunks of up to SHORT characters that every task holds.
FREQUENT, SHORT = 600_000, 48
#: Short words that a worker keeps with their ids, or as known, beside the frequent chunks.
WORDS = 300_000
#: Distinct words that a task counts before it hands them on, and the occurrences among them from which they count.
FLUSH, LOCAL = 1_000_000, 2
_MARK = "\u2581"


class Splitter:
    """A model and the expression that cuts texts where none of its pieces can cross. Built from the model file's bytes."""

    def __init__(self, proto: bytes):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=proto)
        self.guard, self.pattern = "", None
        if self._plain(proto):
            self._places()
        #: Bytes of an id that travels.
        self.kind = "<u2" if self.model.get_piece_size() <= 1 << 16 else "<i4"
        self.skip = len(self.model.encode(self.guard)) if self.guard else 0
        m = self.model
        #: What each piece stands for within a text; none for bytes, which make a character together, and for other ids.
        self.pieces = [None if m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i) else m.id_to_piece(i).replace(_MARK, " ") for i in range(m.get_piece_size())]

    @staticmethod
    def _plain(proto: bytes) -> bool:
        """White space only becomes a marker, one more marker leads the text, and unknown characters become bytes."""
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto.FromString(proto)
        norm, how = spec.normalizer_spec, spec.trainer_spec
        same = not norm.precompiled_charsmap and norm.escape_whitespaces and norm.add_dummy_prefix and not norm.remove_extra_whitespaces
        return same and how.model_type == how.BPE and how.byte_fallback and not how.treat_whitespace_as_suffix

    def _places(self) -> None:
        m = self.model
        pieces = [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))]
        pairs = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        if any(b == _MARK != a for a, b in pairs):
            return
        ascii_chars = {chr(i) for i in range(128)} - {" "}
        alone = ascii_chars - {c for pair in pairs for c in pair}
        if not alone:
            return
        # Marks that no piece joins to a letter before them.
        letter = re.compile(r"[^\W\d_]")
        others = {c for c in ascii_chars - alone if not letter.match(c)}
        marks = others - {b for a, b in pairs if letter.match(a)}
        group = lambda chars: f"[{''.join(re.escape(c) for c in sorted(chars))}]"
        beyond = rf"(?!{letter.pattern})[^\x00-\x7F{_MARK}]"
        any_other, joined = (f"(?:{group(chars)}|{beyond})" if chars else f"(?:{beyond})" for chars in (others, others - marks))
        self.guard = min(alone)
        # The first branch is the usual word, for speed; the others would cut it alike.
        usual = rf" {letter.pattern}++(?=[\x00-\x7F])" + (f"(?!{group(others - marks)})" if others - marks else "")
        self.pattern = re.compile(rf"{usual}|{group(alone)}|[ {_MARK}]*+(?=[^ {_MARK}{group(alone)[1:]}){any_other}*+(?:{letter.pattern}++(?:{joined}{any_other}*+)?+)*+|[ {_MARK}]++")

    def chunks(self, text: str) -> list[str]:
        """The chunks of a text, in order; their ids in a row are those of the text."""
        if not text:
            return []
        # The model puts a marker before every text.
        return self.pattern.findall(f" {text}") if self.pattern else [text]

    def words(self, text: str) -> list[str]:
        """Parts of a text, each cut into chunks by itself (``of``): words between single blanks, or the whole of a text with other white space."""
        if not text:
            return []
        plain = self.pattern is not None and "  " not in text and text[0] != " " and _MARK not in text
        return text.split(" ") if plain else [text]

    def of(self, word: str) -> list[str]:
        """The chunks of a part of a text."""
        return self.chunks(word) if word else [" "]

    def text_of(self, ids: list[list[int]]) -> list[str]:
        """What the ids of each chunk stand for within a text."""
        guard, out = self.model.encode(self.guard), []
        for x in ids:
            parts = [self.pieces[i] for i in x]
            out.append(self.model.decode(guard + x)[len(self.guard) :] if None in parts else "".join(parts))
        return out

    def segment(self, chunks: list[str]) -> list[list[int]]:
        """The ids of each chunk; behind the guard, which joins nothing, a chunk is segmented as within a text."""
        return [ids[self.skip :] for ids in self.model.encode([self.guard + c for c in chunks], num_threads=1)]


def _splitter(model: dict) -> Splitter:
    """One for each model and Python worker: a worker keeps the value of a broadcast for all its tasks, though not the globals of a function."""
    if "splitter" not in model:
        model["splitter"] = Splitter(model["proto"])
    return model["splitter"]


def _count(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, words = _splitter(model.value), Counter()

        def flush() -> pa.RecordBatch:
            counts: dict[str, int] = defaultdict(int)
            for word, n in words.items():
                for c in splitter.of(word):
                    counts[c] += n
            words.clear()
            often = [(c, n) for c, n in counts.items() if n >= LOCAL]
            cells = [pa.array([c for c, _ in often], pa.string()), pa.array([n for _, n in often], pa.int64())]
            return pa.RecordBatch.from_arrays(cells, names=["chunk", "n"])

        for batch in batches if splitter.pattern else ():
            for text in batch.column(0):
                words.update(splitter.words(text.as_py() or ""))
            if len(words) > FLUSH:
                yield flush()
        yield flush()

    return run


def _segment(model):
    """Rows (h, chunk) in order of chunk to (h, body), the chunk's ids. A chunk is segmented once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, last, body = _splitter(model.value), None, b""
        segment, kind = splitter.segment, splitter.kind
        for batch in batches:
            chunks = batch.column(1).to_pylist()
            new = [c for c, before in zip(chunks, [last, *chunks[:-1]], strict=True) if c != before]
            made = iter(segment(new))
            out = []
            for c in chunks:
                if c != last:
                    last, body = c, np.array(next(made), kind).tobytes()
                out.append(body)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["h", "body"])

    return run


def _frequent(chunks: DataFrame, most: int):
    """The condition that picks the chunks that travel: bounded in number and, for long ones, by their share of all text."""
    step = F.floor(F.log2("n") * 16)
    short = F.length("chunk") <= SHORT
    total, left, least = chunks.agg(F.sum("n")).first()[0] or 0, most, None
    for r in sorted(chunks.where(short).groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        left -= r["count"]
        if left < 0:
            break
        least = r["step"]
    hot = F.col("n") > max(1, total // most)
    return hot if least is None else (short & (step >= least)) | hot


def _missing(model, known):
    """(h, text) to (h, chunk) for each distinct chunk of a text that does not travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, have, done = _splitter(model.value), known.value.get("ids", {}), known.value.get("done", set())
        for batch in batches:
            rows, chunks = [], []
            for i, text in enumerate(batch.column(1)):
                new: set[str] = set()
                for word in set(splitter.words(text.as_py() or "")) - done if splitter.pattern else ():
                    if missing := [c for c in splitter.of(word) if c not in have]:
                        new.update(missing)
                    elif len(done) < WORDS and len(word) <= SHORT:
                        done.add(word)
                rows += [i] * len(new)
                chunks += new
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), pa.array(chunks, pa.string())], names=["h", "chunk"])

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, h, text) to (doc_id, h, body) with the text compressed."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        packed = [pack(t.as_py() or b"") for t in batch.column(2).cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["doc_id", "h", "body"])


def _assemble(model, known, end: bool):
    """Rows (doc_id, h, whole, body) in order of h, segmented chunks before the texts (``whole``) that need them, to (doc_id, ids, decoded)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        splitter, have, kept, unpack = _splitter(model.value), known.value.get("ids", {}), known.value.get("words", {}), zstandard.ZstdDecompressor().decompress
        last = np.array([splitter.model.eos_id()] if end else [], "<i4").tobytes()
        of, more = None, {}

        def ids_of(word: str) -> bytes:
            if splitter.pattern is None:
                return np.array(splitter.segment([word])[0], "<i4").tobytes()
            chunks = splitter.of(word)
            made = b"".join([have[c] if c in have else more[c.replace(_MARK, " ")] for c in chunks])
            # A word with a rare chunk is rare.
            if len(kept) < WORDS and len(word) <= SHORT and all(c in have for c in chunks):
                kept[word] = made
            return made

        for batch in batches:
            parts, sizes, decoded, at = [], [0], [], []
            hs, wholes, bodies = (batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in (1, 2, 3))
            loose = [b for b, whole in zip(bodies, wholes, strict=True) if not whole]
            flat = np.frombuffer(b"".join(loose), splitter.kind).astype("<i4")
            ends = np.cumsum([len(b) // np.dtype(splitter.kind).itemsize for b in loose], dtype=np.int64).tolist()
            raw, numbers, spans = flat.tobytes(), flat.tolist(), list(zip([0, *ends[:-1]], ends)) if ends else []
            # Ids decode to their chunk, with blanks for markers.
            found = iter(zip(splitter.text_of([numbers[a:b] for a, b in spans]), [raw[4 * a : 4 * b] for a, b in spans], strict=True))
            for i, (h, whole, body) in enumerate(zip(hs, wholes, bodies, strict=True)):
                if h != of:
                    of, more = h, {}
                if not whole:
                    chunk, x = next(found)
                    more[chunk] = x
                    continue
                row = b"".join([kept.get(w) or ids_of(w) for w in splitter.words(unpack(body).decode())])
                decoded.append(splitter.model.decode(np.frombuffer(row, "<i4").tolist()))
                parts += (row, last)
                sizes.append(sizes[-1] + (len(row) + len(last)) // 4)
                at.append(i)
            flat = pa.Array.from_buffers(pa.int32(), sizes[-1], [None, pa.py_buffer(b"".join(parts))])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), flat), pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    return run


def encode(docs: DataFrame, model_file: str, end: bool = True, most: int = FREQUENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) for each row of ``docs``: the ids of the model, with its end id if ``end``, and the text they decode to.

    ``model_file`` is read by the driver and travels with the tasks; ``most`` bounds the table of frequent chunks.
    """
    spark = docs.sparkSession
    with open(model_file, "rb") as f:
        own = {"proto": f.read()}
    model = spark.sparkContext.broadcast(own)
    rows = lean_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    counts = materialize(rows.select("text").mapInArrow(_count(model), "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n")), "chunks")
    held = counts.where(_frequent(counts, most)).select("chunk").toArrow().column(0).to_pylist()
    ids = _splitter(own).segment(held)
    known = spark.sparkContext.broadcast({"ids": {c: np.array(x, np.int32).tobytes() for c, x in zip(held, ids, strict=True)}, "words": {}, "done": set()})
    kind = rows.schema["doc_id"].dataType.simpleString()
    keyed = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("h"), "text")
    rare = keyed.select("h", "text").mapInArrow(_missing(model, known), "h long, chunk string")
    parts = shuffle_partitions(spark)
    coded = rare.repartition(parts, "chunk").sortWithinPartitions("chunk").mapInArrow(_segment(model), "h long, body binary")
    texts = keyed.mapInArrow(_pack, f"doc_id {kind}, h long, body binary")
    both = texts.select("doc_id", "h", F.lit(True).alias("whole"), "body").unionByName(coded.select(F.lit(None).cast(kind).alias("doc_id"), "h", F.lit(False).alias("whole"), "body"))
    return both.repartition(parts, "h").sortWithinPartitions("h", "whole").mapInArrow(_assemble(model, known, end), f"doc_id {kind}, ids array<int>, decoded string")


def op11_pieces(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    text = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(text, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
