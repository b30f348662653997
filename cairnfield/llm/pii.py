"""Personal data by weak supervision: labelers vote, EM estimates their reliabilities, a classifier decides.

One pass over the texts finds the rule matches, weaker candidates and look-alikes (versions, order numbers, ISBN, digits
that fail a check) of four kinds (email, ip, card, phone). Regex, gazetteer, context, structure and shape labelers vote on
each candidate. Vote patterns are counted on Spark; the table of patterns is bounded (``len(KINDS) * 3**5 * 2**8`` rows at
most, however many documents there are), so expectation-maximisation and the logistic span classifiers, one for each
kind, run on it in the driver. Counts of a kind are always scaled to ``EVIDENCE``, and the votes on a fixed set of seed sentences
(both personal data and look-alikes, without labels) are added, so that both classes occur whatever the corpus holds. A classifier
sees the votes and features of the span, learns from the EM posteriors, and accepts or rejects each candidate. Rule matches
always stay.

Defined cases: a null text counts as empty; an empty table gives an empty result; each input row gives one output
row, so repeated rows and null ids are kept; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnfield.llm.common import lean_batches, materialize

KINDS = ("email", "ip", "card", "phone")
RANK = {k: i for i, k in enumerate(KINDS)}

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A dotted quad can only start where a run of digits starts, so the look-behind loses no match and keeps the scan linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Candidates that the rules do not accept by themselves.
_WEAK = (
    ("email", re.compile(r"\b[A-Za-z0-9][A-Za-z0-9._%+-]{0,63} ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]{1,63}(?: ?[\[(] ?dot ?[\])] ?[A-Za-z0-9-]{1,63}|\.[A-Za-z0-9-]{1,63}){1,4}", re.I)),
    ("email", re.compile(r"(?<![\w.%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{2,63}(?![\w.@-])")),
    ("ip", re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])")),
    ("card", re.compile(r"(?<![0-9.])[0-9]{4}(?:[.][0-9]{4}){3}(?![0-9.])")),
    ("phone", re.compile(r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-])")),
    ("phone", re.compile(r"(?<![0-9+])00[1-9][0-9]{0,2}[ .-]?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9.-])")),
    # Mostly look-alikes, for the labelers and the classifier to tell apart.
    ("ip", re.compile(r"(?<![0-9.])[0-9]{1,4}(?:\.[0-9]{1,4}){2,5}(?![0-9.])")),
    ("card", re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9+.])\+?[0-9(][0-9 ().-]{6,18}[0-9](?![0-9])")),
)
_WORTH = re.compile(r"[0-9@\[(]")

# Cue words and small gazetteers of the labelers.
_CUES = {
    "email": ("mail", "contact", "write to", "reach"),
    "ip": ("ip", "host", "server", "address", "login from"),
    "card": ("card", "visa", "credit", "payment", "mastercard"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "dial"),
}
_COUNTER_CUES = ("version", "isbn", "order", "invoice", "serial", "section", "figure", "item", "release", "chapter", "total", "number", "date")
_TLDS = frozenset("com org net edu gov io info biz co de fr es uk us eu int mil ch at it nl ca au jp".split())
_CALLING = tuple("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 61 62 63 64 65 66 81 82 84 86 90 91".split())

_CONTEXT = 40
MODEL_ROUNDS = 50
#: A candidate that no rule matches is accepted from this probability on.
ACCEPT = 0.8
#: Votes of each kind count for so many candidates in all, so that the seeds and the ridge mean the same at every size.
EVIDENCE = 1_000.0
#: Pseudo votes of each labeler and class.
PSEUDO = 50.0
LABELERS = 5


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def _octets_fit(quad: str) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in quad.split("."))


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, anchored at each @ so that long runs cost linear time."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        before = text[last:at]
        start = last + len(before.rstrip(_LOCAL))
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, m.end()))
            last = m.end()
            at = text.find("@", last)
        else:
            last = at + 1
            at = text.find("@", at + 1)
    return found


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the fixed rules, in order of start, then kind."""
    spans = []
    if "@" in text:
        spans += [(a, b, "email") for a, b in _emails(text)]
    spans += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if _octets_fit(m[0])]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            spans.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                spans.append((m.start(), m.end(), "phone"))
    return sorted(spans, key=lambda s: (s[0], RANK[s[2]]))


def _votes(kind: str, span: str, before: str, is_base: bool) -> str:
    """A letter for each labeler (regex, gazetteer, context, structure, shape): y, n, or - where it abstains."""
    digits = re.sub(r"[^0-9]", "", span)
    low = before.lower()
    regex = "y" if is_base else "n"
    if kind == "email":
        tail = re.split(r"[.\s\])]+", span.lower().rstrip(")] "))[-1]
        gazetteer = "y" if tail in _TLDS else "n"
        structure = "y" if re.search(r"[A-Za-z]", span.split("@")[0]) and not span.startswith((".", "-")) else "n"
        shape = "y" if re.search(r"[.\])][A-Za-z ]+$", span) and len(span) >= 6 else "n"
    elif kind == "ip":
        first = span.split(".")[0].split(":")[0]
        gazetteer = "-" if ":" in span else ("y" if 1 <= int(first[-3:] or 0) <= 223 else "n")
        structure = "y" if ":" in span or (span.count(".") == 3 and _octets_fit(span) and not re.search(r"(?:^|\.)0[0-9]", span)) else "n"
        shape = "y" if ":" in span or span.count(".") == 3 else "n"
    elif kind == "card":
        gazetteer = "y" if digits[:1] in "3456" and digits else "n"
        structure = "y" if 14 <= len(digits) <= 19 and luhn(digits) else "n"
        shape = "y" if re.fullmatch(r"[0-9]{4}(?:([ .-]?)[0-9]{4})(?:\1[0-9]{4})\1[0-9]{2,4}|[0-9]{4}[ -]?[0-9]{6}[ -]?[0-9]{4,5}", span) else "n"
    else:
        number = digits[2:] if digits.startswith("00") else digits
        gazetteer = "y" if number.startswith(_CALLING) or len(digits) == 10 else "n"
        structure = "y" if 10 <= len(number) <= 15 else "n"
        groups = re.findall(r"[0-9]+", span)
        shape = "y" if 2 <= len(groups) <= 6 and all(1 <= len(g) <= 5 for g in groups) and len(groups[-1]) >= 2 and not re.match(r"(?:19|20)[0-9]{2}(?![0-9])", span) else "n"
    context = "y" if any(c in low for c in _CUES[kind]) else "n" if any(c in low for c in _COUNTER_CUES) else "-"
    return regex + gazetteer + context + structure + shape


def _features(text: str, start: int, end: int) -> str:
    span = text[start:end]
    bits = (
        start == 0 or not text[start - 1].isalnum(),
        end == len(text) or not text[end].isalnum(),
        " " in span,
        any(c.isalpha() for c in span),
        end - start >= 16,
        sum(c.isdigit() for c in span) >= 10,
        span[0] in "+(",
        len({c for c in span if c.isdigit()}) <= 3,
    )
    return "".join("1" if b else "0" for b in bits)


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str, str, bool]]:
    """(start, end, kind, pattern, is_base): base spans, and weaker ones that overlap none of them."""
    out = [(a, b, k, f"{k}/{_votes(k, text[a:b], text[max(0, a - _CONTEXT):a], True)}/{_features(text, a, b)}", True) for a, b, k in base]
    taken = [(a, b) for a, b, _ in base]
    weak = sorted((m.start(), i, m.end(), k) for i, (k, p) in enumerate(_WEAK) for m in p.finditer(text))
    at, reach = 0, -1
    for a, _, b, k in weak:
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if a < reach or (at < len(taken) and taken[at][0] < b):
            continue
        reach = b
        out.append((a, b, k, f"{k}/{_votes(k, text[a:b], text[max(0, a - _CONTEXT):a], False)}/{_features(text, a, b)}", False))
    return out


_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("pattern", pa.string()), ("base", pa.bool_())])
_SPAN_SQL = "array<struct<start:int,end:int,kind:string,pattern:string,base:boolean>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for text in batch.column(1):
            text = text.as_py() or ""
            rows = candidates(text, base_spans(text)) if _WORTH.search(text) else []
            found.append([{"start": a, "end": b, "kind": k, "pattern": p, "base": y} for a, b, k, p, y in rows])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(_SPAN))], names=["doc_id", "found"])


def candidate_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, found): one row for each row of ``docs``, with its candidate spans and their vote patterns."""
    only = lean_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = only.schema["doc_id"].dataType.simpleString()
    return only.mapInArrow(_scan, f"doc_id {kind}, found {_SPAN_SQL}")


def expectation_maximisation(counts: dict[str, float], rounds: int = MODEL_ROUNDS) -> dict[str, float]:
    """Dawid-Skene with two classes for each kind; P(span is personal data) for each pattern."""
    posterior: dict[str, float] = {}
    for kind in KINDS:
        rows = [(p, p.split("/")[1], n) for p, n in counts.items() if p.startswith(kind + "/")]
        if not rows:
            continue
        n = np.array([r[2] for r in rows], float)
        votes = np.array([[{"y": 1, "n": 0, "-": -1}[c] for c in r[1]] for r in rows])
        said = votes >= 0
        # Starts from the share of yes votes; the strict rule counts double.
        q = np.clip(((votes == 1).sum(1) + (votes[:, 0] == 1)) / np.maximum(1, said.sum(1) + 1), 0.05, 0.95)
        for _ in range(rounds):
            prior = (n @ q + 1) / (n.sum() + 2)
            logit = np.full(len(rows), math.log(prior / (1 - prior)))
            for j in range(votes.shape[1]):
                w1, w0 = n * q * said[:, j], n * (1 - q) * said[:, j]
                # Labelers are taken to be right four times in five: pseudo votes, which also tell the two classes apart.
                hit = (w1 @ (votes[:, j] == 1) + 0.8 * PSEUDO) / (w1.sum() + PSEUDO)
                slip = (w0 @ (votes[:, j] == 1) + 0.2 * PSEUDO) / (w0.sum() + PSEUDO)
                yes, no = math.log(hit / slip), math.log((1 - hit) / (1 - slip))
                logit += np.where(votes[:, j] == 1, yes, np.where(votes[:, j] == 0, no, 0.0))
            q = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        posterior |= {r[0]: float(x) for r, x in zip(rows, q, strict=True)}
    return posterior


def seeds() -> list[str]:
    """Sentences with personal data and with look-alikes, made by rule; they carry no labels."""
    out = []
    for i in range(40):
        four = lambda k: f"{(i * 7919 + k * 104729) % 10_000:04d}"  # noqa: E731, B023
        card = next(c for d in range(10) if luhn((c := f"4{four(1)}{four(2)}{four(3)}{i % 100:02d}{d}")))
        bad = card[:-1] + str((int(card[-1]) + 3) % 10)
        out += [
            f"please contact first{i}.last@site{i}.com soon",
            f"write to user{i} [at] mail{i} [dot] org today",
            f"login from host 10.{i}.{i + 3}.{i + 11} last night",
            f"paid by visa card {card[:4]} {card[4:8]} {card[8:12]} {card[12:]} then",
            f"call my mobile ({200 + i}) 555-{four(4)} now",
            f"phone +{1 + i % 9} {200 + i} 555 {four(5)} please",
            f"see version {i}.{i + 1}.{300 + i}.{i * 9} of it",
            f"in section {1 + i % 9}.{i}.{1 + i % 4} of the manual",
            f"order {four(6)}{four(7)}{four(8)}{i} was sent",
            f"serial {bad} on the box",
            f"isbn 978-{i % 10}-{four(9)}-{four(10)}-{i % 10} in print",
            f"on date 2024-{1 + i % 12:02d}-{1 + i % 28:02d} 1{i % 10}.30 it began",
            f"item a{i}@b is a place holder",
            f"invoice number {four(11)}.{four(12)} for the total",
        ]
    return out


def _seed_counts() -> Counter[str]:
    return Counter(pattern for text in seeds() for _, _, _, pattern, _ in candidates(text, base_spans(text)))


def _design(patterns: list[str]) -> np.ndarray:
    rows = []
    for p in patterns:
        _, votes, bits = p.split("/")
        rows.append([1.0, *(float(c == y) for c in votes for y in "yn"), *(float(b) for b in bits)])
    return np.array(rows)


def span_classifier(counts: dict[str, float], posterior: dict[str, float], ridge: float = 1.0) -> dict[str, float]:
    """Logistic regression on votes and span features for each kind, fitted to the EM posteriors as soft labels."""
    out: dict[str, float] = {}
    for kind in KINDS:
        patterns = sorted(p for p in counts if p.startswith(kind + "/"))
        if not patterns:
            continue
        x, y = _design(patterns), np.array([posterior[p] for p in patterns])
        n = np.array([counts[p] for p in patterns], float)
        w = np.zeros(x.shape[1])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = x.T @ (x * (n * p * (1 - p))[:, None]) + ridge * np.eye(len(w))
            w += np.linalg.solve(h, x.T @ (n * (y - p)) - ridge * w)
        out |= dict(zip(patterns, (1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))).tolist(), strict=True))
    return out


def evidence(counts: dict[str, int]) -> dict[str, float]:
    """Counts of each kind scaled to EVIDENCE, and the seeds' counts."""
    total: Counter[str] = Counter()
    for p, n in counts.items():
        total[p.split("/")[0]] += n
    out = {p: float(n) for p, n in _seed_counts().items()}
    for p, n in counts.items():
        out[p] = out.get(p, 0.0) + EVIDENCE * n / total[p.split("/")[0]]
    return out


def train(found: DataFrame) -> dict[str, float]:
    """P(personal data) for each pattern that occurs. What is collected is the bounded table of patterns."""
    counts = {r["pattern"]: r["n"] for r in found.select(F.explode("found.pattern").alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n")).collect()}
    weighed = evidence(counts)
    return span_classifier(weighed, expectation_maximisation(weighed))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): array of struct(start, end, kind, base, p) of accepted spans, by start, then kind."""
    found = materialize(candidate_table(docs, id_col, text_col), "pii")
    model = train(found)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("base", pa.bool_()), ("p", pa.float64())])
        for batch in batches:
            rows = []
            for spans in batch.column(1).to_pylist():
                kept = [{"start": s["start"], "end": s["end"], "kind": s["kind"], "base": s["base"], "p": model[s["pattern"]]} for s in spans or [] if s["base"] or model[s["pattern"]] >= ACCEPT]
                rows.append(sorted(kept, key=lambda s: (s["start"], RANK[s["kind"]])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(item))], names=["doc_id", "spans"])

    kind = found.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(decide, f"doc_id {kind}, spans array<struct<start:int,end:int,kind:string,base:boolean,p:double>>")


def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols: dict[str, list] = {f"n_{k}": [] for k in KINDS} | {"base_sha256": [], "spans": []}
        for spans in batch.column(1).to_pylist():
            base = [s for s in spans if s["base"]]
            for k in KINDS:
                cols[f"n_{k}"].append(sum(s["kind"] == k for s in base))
            said = [",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in x) for x in (base, spans)]
            cols["base_sha256"].append(hashlib.sha256(said[0].encode()).hexdigest())
            cols["spans"].append(said[1])
        arrays = [pa.array(v, pa.int64() if k.startswith("n_") else pa.string()) for k, v in cols.items()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", *cols])


def op1_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return find(docs).mapInArrow(digest, f"doc_id long, {counts}, base_sha256 string, spans string")


def mask(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with each span replaced by its kind in square brackets; overlapping spans share one replacement."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", n_chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every accepted span masked. The text is scanned once to train and once more to mask."""
    model = train(materialize(candidate_table(docs.select(F.lit(None).cast("long").alias("doc_id"), text_col), "doc_id", text_col).where(F.size("found") > 0), "pii"))
    at = docs.columns.index(text_col)

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes = [], []
            for text in batch.column(at).to_pylist():
                if text and _WORTH.search(text):
                    rows = candidates(text, base_spans(text))
                    kept = sorted((a, b, k) for a, b, k, p, is_base in rows if is_base or model.get(p, 0.0) >= ACCEPT)
                    text = mask(text, kept) if kept else text
                texts.append(text)
                sizes.append(None if text is None else len(text))
            cols = dict(zip(batch.schema.names, batch.columns, strict=True))
            cols[text_col] = pa.array(texts, batch.schema.field(at).type)
            if n_chars_col in cols:
                cols[n_chars_col] = pa.array(sizes, pa.int64()).cast(batch.schema.field(n_chars_col).type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return lean_batches(docs).mapInArrow(cover, docs.schema)
