"""Secrets by rules and by character Markov models, with DataFrame functions only.

Base rules find assignments, access keys and long hex runs. Beside them every token of 12 or more characters that holds a digit and
a letter is scored by two first-order Markov models over characters, one of random strings and one of ordinary
identifiers; the log-likelihood ratio tells whether it looks random. Tokens inside base spans are judged too: a base span
stays whatever the models say, and a ``random`` span on it is further evidence.

Both models are trained from labelled samples: values that the base rules found and keys derived from hashes are random
strings; plain words of the texts, and names composed of neighbouring words as programmers do (parts joined by signs,
with numbers and versions) are identifiers. Half of the samples train the models, the other half sets the threshold: the
least ratio at which at most ``FALSE_SHARE`` of the identifiers pass.

Positions come from cutting: ``split`` gives the pieces between matches, so the lengths of pieces and matches add up to
code-point offsets. Characters are mapped to 38 classes before counting, so a model has at most 1,444 entries.

Defined cases: a null text counts as empty; an empty table gives an empty result; repeated rows stay repeated; other
columns are ignored; without labelled samples of one kind the models add nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnfield.llm.common import materialize

KINDS = ("assign", "access", "hex")
# The base rules. Possessive forms where the next character cannot match the class anyway.
ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]++"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
#: Tokens that the Markov models judge: 12 characters or more, a digit and a letter among them.
TOKEN = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{12,}+"
#: Share of held-out identifiers that may pass the threshold, and the least log-likelihood ratio (nats) whatever they say.
FALSE_SHARE, MIN_RATIO = 0.001, 6.0
#: Labelled samples of each class, at most; chosen by hash, so alike at every size. Identifiers come from DOCS documents at most.
SAMPLE, DOCS = 20_000, 500
#: Matches in one step of a running sum.
CHUNK = 256

_ALPHABET = "abcdefghijklmnopqrstuvwxyz"


def _once(value: Column, f) -> Column:
    """f(value) with value computed once: a lambda over an array of one element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _running(values: Column) -> Column:
    """Running sums of an array, in chunks, so that an array of n costs n * CHUNK copies and not n * n."""
    none = F.array().cast("array<int>")
    total = lambda part: F.aggregate(part, F.lit(0), lambda acc, x: acc + x)
    chunks = lambda v: F.when(F.size(v) > 0, F.sequence(F.lit(0), F.floor((F.size(v) - 1) / CHUNK).cast("int"))).otherwise(none)
    part = lambda v, c: F.slice(v, c * CHUNK + 1, F.lit(CHUNK))

    def walk(v: Column, before: Column, c: Column) -> Column:
        step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x)).alias("out"))
        return F.aggregate(part(v, c), F.struct(before.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    def whole(v: Column) -> Column:
        sums = F.transform(chunks(v), lambda c: total(part(v, c)))
        return _once(sums, lambda t: F.flatten(F.transform(chunks(v), lambda c: walk(v, total(F.slice(t, F.lit(1), c)), c))))

    return _once(values, whole)


def located(text: Column, pattern: str) -> Column:
    """array<struct(start, end, value)> of the leftmost non-overlapping matches, in code points."""
    # There is one piece more than matches (-1 keeps empty ones at the end); the last piece has no match to pair with.
    pieces, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    paired = F.filter(F.zip_with(pieces, matches, lambda p, m: F.struct(F.length(p).alias("gap"), m.alias("value"))), lambda x: x["value"].isNotNull())
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def placed(p: Column) -> Column:
        ends = _running(F.transform(p, lambda x: x["gap"] + F.length(x["value"])))
        return F.zip_with(p, ends, lambda x, e: F.struct((e - F.length(x["value"])).alias("start"), e.alias("end"), x["value"].alias("value")))

    return F.when(text.rlike(pattern), _once(paired, placed)).otherwise(none)


def _value(assign: Column) -> Column:
    """Group 2 of an assignment: what follows the sign, spaces and quote."""
    return F.regexp_replace(assign, r"""^[A-Za-z_]+["']?\x20*[:=]\x20*["']?""", "")


def _tagged(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, tokens): base spans of all kinds, and the tokens that the models judge."""
    text = F.coalesce(F.col("text"), F.lit(""))
    only = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    assign = F.filter(located(text, ASSIGN), lambda s: F.length(_value(s["value"])) >= 6)
    return only.select(
        "doc_id",
        F.concat(_tagged(assign, "assign"), _tagged(located(text, ACCESS), "access"), _tagged(located(text, HEX), "hex")).alias("base"),
        located(text, TOKEN).alias("tokens"),
    )


def _classes(value: Column) -> Column:
    """The characters as classes: letters by themselves in lower case or as A for capitals, digits by value, signs."""
    return F.translate(F.regexp_replace(value, "[A-Z]", "A"), "/_=-", "++++")


def pairs(samples: DataFrame) -> DataFrame:
    """(label, a, b): adjacent characters of each sample's value."""
    chars = F.col("c")
    shaped = samples.select("label", _classes(F.col("value")).alias("c")).where(F.length("c") >= 2)
    return shaped.select("label", F.explode(F.transform(F.sequence(F.lit(1), F.length(chars) - 1), lambda i: F.substr(chars, i, F.lit(2)))).alias("pair"))


def log_ratios(samples: DataFrame) -> dict[str, float]:
    """log P(b|a, random) - log P(b|a, identifier) for each pair of character classes that occurs.

    ``samples`` has (value, label), label 1 for random strings and 0 for identifiers. What is collected is the table of
    pairs: at most 40 x 40 rows for each label. Pairs of other characters are left out.
    """
    rows = pairs(samples).where(F.col("pair").rlike("^[a-z0-9A+]{2}$")).groupBy("label", "pair").count().collect()
    counts = {(r["label"], r["pair"]): r["count"] for r in rows}
    if len({label for label, _ in counts}) < 2:
        return {}
    symbols = _ALPHABET + "0123456789A+"
    total = {(label, a): sum(counts.get((label, a + b), 0) for b in symbols) for label in (0, 1) for a in symbols}
    p = lambda label, a, b: math.log((counts.get((label, a + b), 0) + 0.5) / (total[label, a] + 0.5 * len(symbols)))
    return {a + b: p(1, a, b) - p(0, a, b) for a in symbols for b in symbols}


def ratio(value: Column, model: dict[str, float]) -> Column:
    """Log-likelihood ratio of the token's adjacent pairs."""
    table = F.create_map(*[F.lit(x) for item in sorted(model.items()) for x in item])
    return _once(_classes(value), lambda c: F.aggregate(F.sequence(F.lit(1), F.length(c) - 1), F.lit(0.0), lambda acc, i: acc + F.coalesce(F.element_at(table, F.substr(c, i, F.lit(2))), F.lit(0.0))))


def labelled_samples(found: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int = SAMPLE) -> DataFrame:
    """(value, label): at most ``size`` random strings (label 1) and ``size`` identifiers from DOCS documents (label 0)."""
    values = found.select(F.explode("base").alias("s")).select(F.when(F.col("s.kind") == "assign", _value(F.col("s.value"))).otherwise(F.col("s.value")).alias("value"))
    seen = values.where(F.col("value").rlike(f"^{TOKEN}$")).distinct().orderBy(F.xxhash64("value"), "value").limit(size // 2)
    key = F.sha2(F.concat(F.lit("key "), F.col("id").cast("string")), 256)
    form = F.when(F.col("id") % 3 == 0, F.regexp_replace(F.base64(F.unhex(key)), "=", "")).when(F.col("id") % 3 == 1, key).otherwise(F.regexp_replace(F.base64(F.unhex(key)), "[+/=]", ""))
    made = docs.sparkSession.range(size // 2).select(F.substr(form, F.lit(1), (12 + F.col("id") % 29).cast("int")).alias("value"))
    random = seen.unionByName(made).withColumn("label", F.lit(1))
    # Ids are chosen before their texts are read, so no task gathers texts that are not used.
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    ids = rows.select("id").distinct().orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(DOCS)
    texts = rows.join(F.broadcast(ids), "id", "left_semi")
    words = texts.select(F.regexp_extract_all("text", F.lit(r"\b[A-Za-z][a-z]{2,}\b"), F.lit(0)).alias("w"))
    near = F.transform(F.col("w"), lambda x, i: F.struct(F.lower(x).alias("a"), F.lower(F.coalesce(F.get("w", i + 1), x)).alias("b"), F.lower(F.coalesce(F.get("w", i + 2), x)).alias("c"), F.pmod(F.xxhash64(x, i), F.lit(1000)).alias("n")))
    one = words.select(F.explode(near).alias("x")).select("x.*")
    number = F.col("n").cast("string")
    names = (
        F.when(F.col("n") % 7 == 0, F.concat_ws("-", "a", "b", F.lpad(F.substr(number, F.lit(1), F.lit(2)), 2, "0")))
        .when(F.col("n") % 7 == 1, F.concat_ws("_", "a", "b", F.concat(F.lit("v"), F.substr(number, F.lit(1), F.lit(1)))))
        .when(F.col("n") % 7 == 2, F.concat("a", F.initcap("b"), F.initcap("c"), F.substr(number, F.lit(1), F.lit(1))))
        .when(F.col("n") % 7 == 3, F.concat_ws("/", "a", "b", F.concat(F.col("c"), number)))
        .when(F.col("n") % 7 == 4, F.upper(F.concat_ws("_", "a", "b", number)))
        .when(F.col("n") % 7 == 5, F.concat_ws("-", "a", F.lit("2024"), F.lpad(F.substr(number, F.lit(1), F.lit(2)), 2, "0"), "b"))
        .otherwise(F.concat_ws("-", "a", "b", "c"))
    )
    plain = one.select(F.explode(F.array(names, F.col("a"))).alias("value")).where((F.length("value") >= 6) & ~F.col("value").rlike(HEX))
    return random.unionByName(plain.distinct().orderBy(F.xxhash64("value"), "value").limit(size).withColumn("label", F.lit(0)))


def train(samples: DataFrame, false_share: float = FALSE_SHARE) -> tuple[dict[str, float], float, float]:
    """Log ratios from one half of ``samples`` (value, label), and threshold and recall from the tokens of the other.

    What is collected beside the pairs is a histogram of the held-out ratios in steps of half a nat.
    """
    halves = materialize(samples.withColumn("held", F.pmod(F.xxhash64("value", F.lit(3)), F.lit(2)) == 1), "samples")
    model = log_ratios(halves.where("not held"))
    if not model:
        return {}, math.inf, 0.0
    judged = halves.where(F.col("held") & (F.length("value") >= 12)).select("label", F.floor(ratio(F.col("value"), model) * 2).alias("bin"))
    counts = [(r["bin"] / 2, r["label"], r["count"]) for r in judged.groupBy("label", "bin").count().collect()]
    names = sum(n for _, label, n in counts if not label)
    steps = sorted({b for b, _, _ in counts} | {MIN_RATIO})
    fits = [b for b in steps if b >= MIN_RATIO and sum(n for x, label, n in counts if not label and x >= b) <= false_share * names]
    limit = fits[0] if fits else steps[-1] + 0.5
    keys = sum(n for _, label, n in counts if label)
    return model, limit, sum(n for b, label, n in counts if label and b >= limit) / max(1, keys)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: DataFrame | None = None) -> DataFrame:
    """(doc_id, base, spans): base spans, and all spans with those that the models add (kind ``random``)."""
    found = materialize(scan(docs, id_col, text_col), "secrets")
    model, limit, _ = train(labelled_samples(found, docs, id_col, text_col) if samples is None else samples)
    if not model:
        return found.select("doc_id", "base", F.col("base").alias("spans"))
    return found.select("doc_id", "base", F.concat("base", _tagged(F.filter("tokens", lambda t: ratio(t["value"], model) >= limit), "random")).alias("spans"))


def _said(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    rank = lambda s: F.when(s["kind"] == "assign", 0).when(s["kind"] == "access", 1).when(s["kind"] == "hex", 2).otherwise(3)
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_secrets(spark, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_said(F.col("base")).cast("binary"), 256).alias("base_sha256"), _said(F.col("spans")).alias("spans"))
