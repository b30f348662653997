"""Toxicity by multiple-instance learning: a document is toxic if one of its sentences is.

Only documents carry labels. Each sentence gets a probability from a logistic model over its words, sentences are
combined by noisy-or, 1 - prod(1 - p), and the weights are fitted so that the combination explains the document
labels. The fitted sentence scores then locate the offending sentences.

Words are chosen from the labelled documents: those that occur in toxic documents far more often than in clean ones
(G-squared at least ``MIN_G2``, ``VOCABULARY`` words at most). A sentence without any of them has probability 0, so
length alone makes no document toxic. Labels are learned from at most ``SAMPLE`` labelled rows, chosen by the hash of
their id, never from held-out ones; reduced to chosen words, equal rows of the sample are counted together, and this
bounded table is what the driver fits. Language, source and id are no inputs.

Defined cases: null texts count as empty and score 0; a document labelled twice takes the mean of its labels (toxic from
0.5 on), null labels are ignored; without labelled rows all scores are 0; repeated rows stay repeated; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnfield.llm.common import held_out, lean_batches, materialize
from cairnfield.llm.quality import training_rows

SAMPLE = 40_000
VOCABULARY = 2_000
MIN_G2 = 11.0
#: predicted is 1 from this score on.
THRESHOLD = 0.7
#: Sentences from this probability on are reported.
OFFENDING = 0.5
STEPS = 300
L2 = 0.02

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, toxic, clean): in how many documents of this partition each word occurs. The empty word counts documents."""
    counts = (Counter(), Counter())
    for batch in batches:
        for text, y in zip(batch.column(0), batch.column(1), strict=True):
            counts[y.as_py() < 0.5].update({*_WORD.findall((text.as_py() or "").lower()), ""})
    words = sorted(counts[0] | counts[1])
    yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([counts[0][w] for w in words], pa.int64()), pa.array([counts[1][w] for w in words], pa.int64())], names=["word", "toxic", "clean"])


def vocabulary(sample: DataFrame) -> list[str]:
    """Words that speak for toxicity, from (text, y), by falling G-squared and then by word."""
    counts = materialize(sample.mapInArrow(_count_words, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "words")
    total = counts.where("word = ''").first()
    if total is None or not total["toxic"] or not total["clean"]:
        return []
    nt, nc = float(total["toxic"]), float(total["clean"])
    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")
    share = (a + b) / (nt + nc)
    term = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(0.0)
    g2 = 2 * (term(a, nt * share) + term(b, nc * share) + term(nt - a, nt * (1 - share)) + term(nc - b, nc * (1 - share)))
    good = counts.where((F.col("word") != "") & (a / nt > 3 * b / nc) & (a >= 3)).select("word", g2.alias("g2")).where(F.col("g2") >= MIN_G2)
    return [r["word"] for r in good.orderBy(F.desc("g2"), "word").limit(VOCABULARY).collect()]


def _reduce(words: dict[str, int]):
    """(text, y) to (y, bag): the chosen words of each sentence that has any, as numbers; sentences by ';', words by ','."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = []
            for text in batch.column(0):
                sentences = []
                for s in _SENTENCE.findall((text.as_py() or "").lower()):
                    if hit := sorted({words[w] for w in _WORD.findall(s) if w in words}):
                        sentences.append(",".join(map(str, hit)))
                bags.append(";".join(sorted(sentences)))
            yield pa.RecordBatch.from_arrays([pa.array([int(y.as_py() >= 0.5) for y in batch.column(1)], pa.int32()), pa.array(bags, pa.string())], names=["y", "bag"])

    return run


def fit(rows: list[tuple[int, str, int]], size: int) -> tuple[float, np.ndarray]:
    """Bias and word weights of the sentence model, by maximum likelihood of the noisy-or over (y, bag, count)."""
    rows = [r for r in rows if r[1]]  # documents without chosen words score 0 whatever the weights
    bias, w = -2.0, np.ones(size)
    if not rows:
        return bias, w
    y = np.array([r[0] for r in rows], float)
    n = np.array([r[2] for r in rows], float)
    doc, word, sent = [], [], []
    for i, r in enumerate(rows):
        for s in r[1].split(";"):
            doc.append(i)
            for k in s.split(","):
                sent.append(len(doc) - 1)
                word.append(int(k))
    doc, word, sent = np.array(doc), np.array(word), np.array(sent)
    m, v, g = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, STEPS + 1):
        z = np.clip(bias + np.bincount(sent, w[word], len(doc)), -20, 20)
        p = 1 / (1 + np.exp(-z))
        keep = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), len(rows))  # log of the clean probability
        clean = np.exp(keep)
        # d log-likelihood / d z: a clean document pays p for each sentence; a toxic one shares its gain among them.
        gain = np.where(y > 0, clean / np.maximum(1e-9, 1 - clean), -1.0) * n
        dz = gain[doc] * p
        g[0] = dz.sum()
        g[1:] = np.bincount(word, dz[sent], size) - L2 * w
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        bias += step[0]
        w = w + step[1:]
    return float(bias), w


def train(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str) -> tuple[dict[str, float], float]:
    """Word weights and bias."""
    known = F.broadcast(training_rows(labels, label_col, size=SAMPLE))
    texts = lean_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sample = materialize(texts.join(known, "doc_id").select("text", "y"), "training")
    words = vocabulary(sample)
    index = {w: i for i, w in enumerate(words)}
    rows = sample.mapInArrow(_reduce(index), "y int, bag string").groupBy("y", "bag").count().orderBy("y", "bag").collect() if words else []
    bias, w = fit([(r["y"], r["bag"], r["count"]) for r in rows], len(words))
    return {x: float(w[i]) for x, i in index.items()}, bias


def sentences(text: str, weights: dict[str, float], bias: float) -> tuple[int, float, list[tuple[int, int, float]]]:
    """Number of sentences, noisy-or score, and (start, end, p) of those with a chosen word."""
    found, count, clean = [], 0, 1.0
    for m in _SENTENCE.finditer(text):
        count += 1
        hit = {w for w in _WORD.findall(m[0].lower()) if w in weights}
        if hit:
            p = 1 / (1 + float(np.exp(-np.clip(bias + sum(weights[w] for w in sorted(hit)), -20, 20))))
            clean *= 1 - p
            found.append((m.start(), m.end(), p))
    return count, 1 - clean, found


def score(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, n_sentences, offending) for each row of ``docs``.

    ``offending`` is an array of struct(start, end, p) over code points of the sentences that score OFFENDING or more.
    """
    weights, bias = train(docs, labels, label_col, id_col, text_col)
    item = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [sentences(t.as_py() or "", weights, bias) for t in batch.column(1)]
            bad = [[{"start": a, "end": b, "p": p} for a, b, p in r[2] if p >= OFFENDING] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[1] for r in rows], pa.float64()), pa.array([int(r[1] >= THRESHOLD) for r in rows], pa.int32()), pa.array([r[0] for r in rows], pa.int64()), pa.array(bad, pa.list_(item))],
                names=["doc_id", "score", "predicted", "n_sentences", "offending"],
            )

    only = lean_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = only.schema["doc_id"].dataType.simpleString()
    scored = only.mapInArrow(apply, f"doc_id {kind}, score double, predicted int, n_sentences long, offending array<struct<start:int,end:int,p:double>>")
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted", "n_sentences", "offending")


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    found = score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    said = F.array_join(F.transform("offending", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", "held_out", "score", "predicted", "n_sentences", said.alias("offending"))
