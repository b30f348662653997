"""Chunk table, whitening and phrases against the library, plain numpy and brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from fractions import Fraction
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairnfield.llm import phrases, pieces, registry, whitening

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def splitter():
    with open(MODEL, "rb") as f:
        return pieces.Splitter(f.read())


ODD = ["", " ", "  ", "\n", " \n ", "a", "▁", "▁▁a ▁", "word " * 3_000, "x" * 20_000, "é中　文\xa0", "a.b,c) \"d\". e", "\x00\x01", "😀😀 ok", "<s> </s> <0x0A>", "12 345,6", "\r\n\t x"]


def test_chunks_are_segmented_as_in_their_text(splitter):
    rng = random.Random(3)
    bits = ["a", "the", "ing", ".", ",", "  ", "\n", "▁", '"', "(", ")", "é", "中", "　", "😀", "<s>", "_", "://", "12", "\x00", "é", "»", "D", "ß", "²"]
    for text in [*ODD, *("".join(rng.choices(bits, k=rng.randrange(14))) for _ in range(5_000))]:
        chunks = splitter.chunks(text)
        assert "".join(chunks) == (f" {text}" if text else "")
        assert [i for ids in splitter.segment(chunks) for i in ids] == splitter.model.encode(text)


def test_a_model_without_places_to_cut_keeps_texts_whole(splitter, monkeypatch):
    monkeypatch.setattr(pieces.Splitter, "_plain", staticmethod(lambda proto: False))
    with open(MODEL, "rb") as f:
        whole = pieces.Splitter(f.read())
    assert whole.chunks("a b") == ["a b"] and whole.chunks("") == [] and whole.segment(["a b"]) == [whole.model.encode("a b")]
    monkeypatch.setattr(pieces, "_splitter", lambda proto: whole)
    shared = SimpleNamespace(value={})
    given = pa.record_batch({"h": [1, 2], "text": ["a  b", ""]})
    assert [b.num_rows for b in pieces._missing(shared, shared)(iter([given]))] == [0] and next(pieces._count(shared)(iter([given]))).num_rows == 0
    packed = next(pieces._pack(iter([pa.record_batch({"doc_id": [7, 8], "h": [1, 2], "text": ["a  b", ""]})])))
    rows = pa.RecordBatch.from_arrays([packed.column(0), packed.column(1), pa.array([True, True]), packed.column(2)], names=["doc_id", "h", "whole", "body"])
    out = next(pieces._assemble(shared, shared, True)(iter([rows]))).to_pylist()
    assert [(r["doc_id"], r["ids"], r["decoded"]) for r in out] == [(7, whole.model.encode("a  b", add_eos=True), "a  b"), (8, [2], "")]


def test_a_worker_builds_its_splitter_once_and_keeps_words_of_known_chunks(splitter, monkeypatch):
    with open(MODEL, "rb") as f:
        model = SimpleNamespace(value={"proto": f.read()})
    known = SimpleNamespace(value={"ids": {" ab": np.array(splitter.segment([" ab"])[0], "<i4").tobytes()}, "words": {}, "done": set()})
    built, plain = [], pieces.Splitter
    monkeypatch.setattr(pieces, "Splitter", lambda proto: built.append(1) or plain(proto))
    for _ in range(2):  # tasks
        given = pa.record_batch({"h": pa.array([1], pa.int64()), "text": ["ab zq9 ab"]})
        loose = next(pieces._missing(model, known)(iter([given])))
        coded = next(pieces._segment(model)(iter([loose])))
        packed = next(pieces._pack(iter([pa.record_batch({"doc_id": [7], "h": [1], "text": ["ab zq9 ab"]})])))
        n = coded.num_rows
        rows = pa.record_batch({"doc_id": [None] * n + [7], "h": [1] * (n + 1), "whole": [False] * n + [True], "body": coded.column(1).to_pylist() + packed.column(2).to_pylist()})
        out = next(pieces._assemble(model, known, True)(iter([rows]))).to_pylist()
        assert out == [{"doc_id": 7, "ids": splitter.model.encode("ab zq9 ab", add_eos=True), "decoded": "ab zq9 ab"}]
    assert len(built) == 1
    assert set(known.value["words"]) == {"ab"} == known.value["done"]


def test_the_text_of_ids_is_the_library_s(splitter):
    m, rng = splitter.model, random.Random(6)
    ids = [[], *([i] for i in range(m.get_piece_size())), *([rng.randrange(400) for _ in range(5)] for _ in range(5_000))]
    guard = m.encode(splitter.guard)
    assert splitter.text_of(ids) == [t[len(splitter.guard) :] for t in m.decode([guard + x for x in ids])]


@pytest.mark.parametrize("most", [pieces.FREQUENT, 3])
def test_encoding_equals_the_library(spark, splitter, most):
    rng = random.Random(4)
    words = [f"w{i}{'abc'[i % 3]}" for i in range(60)]
    texts = [None, *ODD, *(" ".join(rng.choices(words, k=20)) for _ in range(40))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, "again"), (5, "again"), (None, "w1a nobody"), (None, None), (5, "other text w9")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"h": F.lit("x"), "chunk": F.lit(1), "pos": F.lit(0), "ids": F.lit(None)})
    got = sorted(((r["doc_id"], r["ids"], r["decoded"]) for r in pieces.encode(df, MODEL, most=most).collect()), key=str)
    m = splitter.model
    assert got == sorted(((i, ids := m.encode(t or "", add_eos=True), m.decode(ids)) for i, t in rows), key=str)
    assert pieces.encode(df.limit(0), MODEL, most=most).count() == 0


def test_op11_on_the_small_table(spark, sf_dir, splitter):
    m, want = splitter.model, []
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = m.encode(r["text"] or "", add_eos=True)
        want.append((r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(m.decode(ids).encode()).hexdigest()))
    got = [tuple(r) for r in registry.queries()["op11_pieces"](spark, sf_dir).collect()]
    assert sorted(got) == sorted(want)


def test_symmetric_qr_against_lapack():
    rng = np.random.default_rng(5)
    for size in (1, 2, 3, 17, 64):
        a = rng.normal(size=(size, size))
        for s in (a + a.T, a @ a.T, np.eye(size), np.zeros((size, size)), np.diag(np.arange(size) % 3.0)):
            values, vectors = whitening.symmetric_eigen(s)
            scale = max(1.0, np.abs(s).max())
            assert np.allclose(values, np.sort(np.linalg.eigvalsh(s))[::-1], atol=1e-12 * scale * size)
            assert np.abs(vectors @ np.diag(values) @ vectors.T - s).max() < 1e-12 * scale * size
            assert np.abs(vectors.T @ vectors - np.eye(size)).max() < 1e-13 * size


def test_merged_streams_equal_one_stream():
    x = np.random.default_rng(6).normal(size=(50, 4)) * 5 + 3
    whole = whitening.Moments(4)
    parts = [whitening.Moments(4) for _ in range(4)]
    for i, row in enumerate(x):
        whole.add(row)
        parts[i % 3].add(row)
    merged = whitening.Moments(4)
    for p in parts:  # one of them is empty
        merged.merge(p)
    for state in (whole, merged):
        assert state.n == 50 and np.allclose(state.mean, x.mean(0), atol=1e-13) and np.allclose(state.covariance(), np.cov(x.T, bias=True), atol=1e-12)


def plain_whitening(rows):
    kept = [(i, np.floor(np.array(v, float) * 64).astype(np.int64) + 1_000_000) for i, v in rows]
    fit = np.unique(np.stack([x for _, x in kept]), axis=0)
    s, n = fit.sum(0), len(fit)
    c = fit - 1_000_000 - (s - 1_000_000 * n) / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return [(i, n, int(((n * x - s) ** 2).sum()), ((x - 1_000_000) - (s - 1_000_000 * n) / n) @ vectors / np.sqrt(values)) for i, x in kept], values / values.sum()


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(7)
    good = [(i, (rng.normal(size=5) * [9, 7, 5, 3, 1] + 2).tolist()) for i in range(60)] + [(3, [1.0, 2.0, 3.0, 4.0, 5.0])] * 20
    bad = [(100, None), (101, []), (102, [1.0, None, 1.0, 1.0, 1.0]), (103, [float("nan"), 0.0, 0.0, 0.0, 0.0]), (104, [float("inf")] * 5), (105, [1e300] * 5), (106, [1.0, 2.0])]
    df = spark.createDataFrame([*good, *bad], "vec_id long, embedding array<double>").withColumns({"x": F.lit("x"), "n": F.lit("y"), "part": F.lit(0)})
    got = sorted(whitening.whiten(df.repartition(7)).collect(), key=lambda r: (r["vec_id"], r["deviation"], r["whitened"][0]))
    want, explained = plain_whitening(good)
    assert len(got) == len(want)
    a, b = (np.array([w for *_, w in sorted(((r["vec_id"], r["deviation"], list(r["whitened"])) for r in rows), key=lambda t: t[:2])]) for rows in (got, [{"vec_id": i, "deviation": d, "whitened": w} for i, _, d, w in want]))
    assert np.abs(a * np.sign((a * b).sum(0)) - b).max() < 1e-9
    assert sorted((r["vec_id"], r["n"], r["deviation"]) for r in got) == sorted((i, n, d) for i, n, d, _ in want)
    assert np.allclose(got[0]["explained"], explained, rtol=1e-10) and got[0]["identity_error"] < 1e-10


def test_whitening_of_flat_and_empty_tables(spark):
    flat = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.25])] * 3, "vec_id long, embedding array<float>")).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in flat] == [(1, 0, [None, None], [None, None], None)] * 3
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 1.0]) for i in range(4)], "vec_id long, embedding array<float>")).collect()
    assert all(r["whitened"][1] is None and r["whitened"][0] is not None for r in line) and line[0]["identity_error"] < 1e-12
    assert whitening.whiten(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert whitening._deviation(np.array([[2**40, 0], [0, 1]]), 2**30, [0, 0]) == [None, 2**60]


def test_op12_has_a_row_for_each_vector_and_component(spark, sf_dir):
    rows = registry.queries()["op12_whitening"](spark, sf_dir)
    one = rows.agg(F.count("*"), F.countDistinct("vec_id"), F.min("component"), F.max("component"), F.max("identity_error"), F.countDistinct("identity_error")).first()
    assert one[0] == 16 * one[1] and one[1] == spark.read.parquet(f"{sf_dir}/embeddings.parquet").count() and (one[2], one[3], one[5]) == (1, 16, 1) and one[4] < 1e-10


def plain_phrases(rows, least=10, top=2_000):
    f = Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            f.update((lang or "und", tuple(words[i : i + m])) for m in (1, 2, 3) for i in range(len(words) - m + 1))
    good = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = []
    for lang in {k[0] for k in f}:
        n = sum(a for (x, p), a in f.items() if x == lang and len(p) == 1)
        mine = {p: a for (x, p), a in good.items() if x == lang}
        found = []
        for p, a in mine.items():
            if any(len(q) > len(p) and p in (q[:2], q[1:]) and 100 * b >= 50 * a for q, b in mine.items()):
                continue
            score, _, left, right = min((Fraction(1_000_000 * a * a, f[lang, p[:k]] * f[lang, p[k:]]).__floor__(), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("dictionary", "pointers"), [(phrases.DICTIONARY, phrases.POINTERS), (phrases.DICTIONARY, 40), (6, 40), (0, 40)])
def test_phrases_against_brute_force(spark, dictionary, pointers):
    rng = random.Random(8)
    words = ["The", "cat", "sat", "é", "É", "mat", "on", "x_y", "\xa0", "日本"]
    rows = [(rng.choice(["en", "de", None]), "".join(rng.choices(words, [9, 3, 3, 2, 2, 1, 5, 1, 1, 1])[0] + rng.choice([" ", " ", " ", "\t ", ", ", "\n", ".\x0b"]) for _ in range(40))) for _ in range(60)]
    rows += [("en", None), ("en", ""), (None, " . "), ("fr", "once only")] + [("en", "the same line again")] * 30 + [("es", "la la la la la la la la la la la la la")]
    df = spark.createDataFrame(rows, "lang string, text string").withColumns({"phrase": F.lit("x"), "word": F.lit("y"), "f": F.lit(0), "rank": F.lit(0)})
    got = phrases.collocations(df.repartition(5), dictionary=dictionary, pointers=pointers)
    assert sorted(tuple(r) for r in got.collect()) == plain_phrases(rows)
    few = phrases.collocations(df, top=3, min_count=2, dictionary=dictionary, pointers=pointers)
    assert sorted(tuple(r) for r in few.collect()) == plain_phrases(rows, 2, 3)


def test_phrases_of_an_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], DOCS)).count() == 0
