"""Personal data, licenses, secrets, host rules and decontamination against brute force, with the odd cases."""

from __future__ import annotations

import hashlib
import random
import re
import string

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairnfield.llm import decontaminate, host_rules, license, pii, secret_scan
from cairnfield.llm.pii import luhn

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", f"s{i % 2}", None) for i, t in enumerate(texts)], DOCS)


ODD = [None, "", " \n\t", "a", "word " * 30_000]


def naive_base(text):
    """The rules as written, with the plain patterns."""
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15),
    }
    spans = [(m.start(), m.end(), k) for k, (p, ok) in rules.items() for m in re.finditer(p, text) if ok(m)]
    return sorted(spans, key=lambda s: (s[0], pii.RANK[s[2]]))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1@.+-_ 0(259é", max_size=60))
def test_base_spans_match_the_rules_as_written(text):
    assert pii.base_spans(text) == naive_base(text)


def test_base_spans_of_adversarial_runs_are_linear():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "1." * 100_000, "+1(" * 100_000, "@" * 200_000):
        pii.base_spans(text)


def test_pii_query_rows_and_odd_cases(spark):
    texts = [*ODD, "mail me: joe.x@mail.example.com or +1 (555) 555-0100", "joe.x@mail.example.com", "ip 10.0.0.300 no, 10.0.0.30 yes", "card 4111 1111 1111 1111", "call (555) 555-0100 now", "call (555) 555-0100 now"]
    df = docs(spark, texts).withColumn("spans", F.lit(1)).withColumn("found", F.lit(2))
    found = {r["doc_id"]: r for r in pii.find(df.union(df.limit(1))).collect()}
    assert len(found) == len(texts)
    for i, t in enumerate(texts):
        base = [(s["start"], s["end"], s["kind"]) for s in found[i]["spans"] if s["base"]]
        assert base == naive_base(t or "")
    out = pii.redact(df).orderBy("doc_id").collect()
    assert out[0]["text"] is None and out[1]["text"] == ""
    assert out[5]["text"] == "mail me: [EMAIL] or [PHONE]" and out[5]["n_chars"] == len(out[5]["text"])
    assert pii.redact(df).columns == df.columns
    assert pii.find(docs(spark, [])).count() == 0


def test_pii_digest(spark, sf_dir):
    rows = pii.op1_pii(spark, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        said = ",".join(f"{k}:{a}:{b}" for a, b, k in naive_base(texts[r["doc_id"]] or ""))
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()


def test_em_separates_good_labelers_from_bad():
    counts = {"email/yyyy/11000": 80, "email/nnnn/00000": 90, "email/nyyn/11000": 3, "email/yynn/11000": 2}
    q = pii.expectation_maximisation(counts)
    assert q["email/yyyy/11000"] > 0.9 > 0.1 > q["email/nnnn/00000"]
    p = pii.span_classifier(counts, q)
    assert p["email/yyyy/11000"] > 0.5 > p["email/nnnn/00000"]


def test_candidates_are_accepted_and_refused(spark):
    yes = ["call my mobile (415) 555-0199 now", "write to joe.doe [at] mail [dot] com please", "phone 0044 20 7946 0018 today", "card 4111.1111.1111.1111 for payment"]
    no = ["see version 12.4.300.7 of it", "order 4111111111111112 was sent", "isbn 978-3-1614-8410-0 in print", "section 3.2.1 of it", "on date 2024-05-17 12.30 it began", "item a1@b is here", "12345678901234567 items", "about 1234567890 of them"]
    rows = {r["doc_id"]: r for r in pii.find(docs(spark, yes + no)).collect()}
    added = [bool([s for s in rows[i]["spans"] if not s["base"]]) for i in range(len(yes + no))]
    assert added[: len(yes)] == [True] * len(yes)
    assert added[len(yes) :] == [False] * len(no)


def naive_license(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    places = [(i, label) for phrase, label in license.PHRASES.items() for i in range(len(words)) if tuple(words[i : i + len(phrase)]) == phrase]
    return len(words), len(places), min((p[0] for p in places), default=None), max((p[0] for p in places), default=None), ",".join(sorted({p[1] for p in places}))


def test_license_rows_match_brute_force(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    for r in license.op4_license(spark, sf_dir).collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == naive_license(texts[r["doc_id"]] or "")
        assert 0 <= r["score"] <= 1


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Licensed under the Apache License, Version 2.0.", ["apache-2.0"]),
        ("licensed under the terms of the apache license 2.0", ["apache-2.0"]),
        ("licensed under the apache licence version 2.0", []),
        ("licensed under an apache license version 2.0", []),
        ("Released under the MIT License.", ["mit"]),
        ("Copyright (c) 2020 Some Body. All rights reserved.", ["copyright", "reserved"]),
        ("Licensed under CC BY-SA 3.0", ["cc-by", "cc-by-sa"]),
        ("cc, by the way", ["cc-by"]),
        ("general all public license rights", []),
    ],
)
def test_templates_accept_only_exact_mandatory_wording(text, labels):
    assert license.scan(text)[5] == labels


def naive_runs(words):
    """For each start and label the longest run of a template's regular expression over space-ended words."""
    text, starts = "", []
    for w in words:
        starts.append(len(text))
        text += w + " "
    ends = {at: i for i, at in enumerate([*starts, len(text)])}
    found = {}
    for label, templates in license.TEMPLATES.items():
        for t in templates:
            pattern = "".join("(?:" if m == "beginOptional" else ")?" if m == "endOptional" else r"(?:[^ ]+ ){%s,%s}" % tuple(m.split(";")[2:]) if m else re.escape(w) + " " for m, w in license._MARK.findall(t))
            for i, at in enumerate(starts):
                for end in (x for x in reversed([*starts[i + 1 :], len(text)]) if x > at):
                    if re.compile(pattern).fullmatch(text, at, end):
                        found[i, label] = max(found.get((i, label), 0), ends[end])
                        break
    return sorted((i, end, label) for (i, label), end in found.items())


def test_templates_match_a_naive_matcher():
    rng = random.Random(12)
    for label, templates in license.TEMPLATES.items():
        for t in templates:
            words, skip = ["before"], 0
            for mark, word in license._MARK.findall(t):
                if mark == "beginOptional":
                    skip += 1 if skip or rng.random() < 0.4 else 0
                elif mark == "endOptional":
                    skip -= skip > 0
                elif mark and not skip:
                    words += [f"fill{k}" for k in range(rng.randint(*map(int, mark.split(";")[2:])))]
                elif word and not skip:
                    words.append(word)
            words.append("after")
            assert sorted(license.AUTOMATON.accept(words)) == naive_runs(words)
            text = " ".join(words).title()
            assert label in license.scan(text)[5]
            # Any change of a mandatory word takes the run away that held it.
            at = next(i for i in range(len(words) - 2, 0, -1) if words[i] in license.mandatory(t))
            words[at] = "changed"
            assert sorted(license.AUTOMATON.accept(words)) == naive_runs(words)


def test_license_odd_cases(spark):
    df = docs(spark, ODD).withColumn("labels", F.lit("x"))
    rows = license.notices(df).orderBy("doc_id").collect()
    assert [r["n_words"] for r in rows] == [0, 0, 0, 1, 30_000]
    assert all(r["score"] == 0 and r["labels"] == [] for r in rows)
    assert license.notices(docs(spark, [])).count() == 0


def naive_secrets(text):
    rules = {
        "assign": (r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 6),
        "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    }
    spans = [(m.start(), m.end(), k) for k, (p, ok) in rules.items() for m in re.finditer(p, text) if ok(m)]
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], list(rules).index(s[2]))))


def test_secrets_match_the_rules_as_written(spark):
    rng = random.Random(3)
    bits = ["password", "PassWd", "token", "api_key", "apikey", "secret", " ", "=", ":", "'", '"', "abcdef", "0123456789abcdef", "AKIA", "ABCDEFGH1234", "é", "日本", "\n", "x.y", "secret:token:abcdefg", "token=ab secret=abcdefg"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(400)] + ODD
    found = secret_scan.scan(docs(spark, texts).withColumn("base", F.lit(1))).select("doc_id", secret_scan._said(F.col("base")).alias("said")).collect()
    assert len(found) == len(texts)
    for r in found:
        assert r["said"] == naive_secrets(texts[r["doc_id"]] or ""), texts[r["doc_id"]]


def test_markov_models_tell_random_strings_from_identifiers(spark):
    rng = random.Random(5)
    rand = lambda n: "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n))
    words = ["connection", "handler", "document", "parameter", "iteration", "threshold", "validate", "response", "partition", "container"]
    ident = lambda: "_".join(rng.choice(words) for _ in range(3))
    samples = spark.createDataFrame([(rand(30), 1) for _ in range(300)] + [(ident(), 0) for _ in range(300)], "value string, label int")
    texts = [f"see {rand(32)}1 here" for _ in range(20)] + [f"see {ident()}_v2 here" for _ in range(20)]
    rows = secret_scan.find(docs(spark, texts), samples=samples).orderBy("doc_id").collect()
    hit = [any(s["kind"] == "random" for s in r["spans"]) for r in rows]
    assert sum(hit[:20]) >= 19 and sum(hit[20:]) == 0
    assert secret_scan.find(docs(spark, [])).count() == 0


def test_positions_of_many_matches(spark):
    text = "".join(f"é{'ab' * (i % 40)}0123456789abcdef01234567 " for i in range(900))
    got = spark.createDataFrame([(text,)], "t string").select(secret_scan.located(F.col("t"), secret_scan.HEX).alias("x")).first()["x"]
    assert [(s["start"], s["end"]) for s in got] == [m.span() for m in re.finditer("[0-9a-f]{24,}", text)]


def test_secret_query_judges_tokens_on_whole_tables(spark, sf_dir, tmp_path):
    rng = random.Random(6)
    words = ["connection", "handler", "document", "parameter", "iteration", "threshold", "validate", "response", "partition", "container", "about", "which"]
    prose = lambda: " ".join(rng.choice(words) for _ in range(60))
    key = lambda: "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(30)) + "7a"
    plain = ["https-server-08-eu-west-1-prod", "getUserName2Handler", "release-2024-08-notes", "MAX_BUFFER_SIZE_1024", "invoice-2024-000123"]
    texts = [f"{prose()} {key()} end" for _ in range(30)] + [f"{prose()} {p} end" for p in plain] + [f"{prose()} token = {key()}", None, ""]
    corpus = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id") + 1_000, "text", "lang", "source", "n_chars")
    docs(spark, texts).union(corpus).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in secret_scan.op5_secrets(spark, str(tmp_path)).collect()}
    assert len(rows) == len(texts) + corpus.count()
    assert sum("random" in rows[i]["spans"] for i in range(30)) >= 29
    assert not any(rows[30 + i]["spans"] for i in range(len(plain)))
    both = rows[30 + len(plain)]
    assert both["n_assign"] == 1 and "assign" in both["spans"] and "random" in both["spans"]


def naive_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


def test_host_measures_match_brute_force(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a", "b", "c", " ", " ", "\n", "|", "é", "\t", "x y z ", "\x0b", "\x85", "#"]) for _ in range(rng.randint(0, 80))) for _ in range(300)] + ODD
    rows = host_rules.judge(docs(spark, texts).withColumn("host", F.lit(9))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        want = naive_measures(texts[r["doc_id"]] or "")
        assert got == want, texts[r["doc_id"]]
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["kept"] and r["base_failed"])


def test_bad_hosts_are_rejected_and_small_ones_shrunk(spark):
    good, bad = "w%d x%d y%d z%d " * 20, "# " * 60 + "a%d b%d c%d d%d " * 15
    fill = lambda t, k: t % tuple(range(k, k + t.count("%d")))
    rows = [(i, fill(bad, i), "en", "spam", 0) for i in range(60)] + [(1000 + i, fill(good, i), "en", f"g{i % 6}", 0) for i in range(300)] + [(5000, fill(bad, 7), "en", "tiny", 0), (5001, fill(good, 1), "en", None, 0)]
    rows += [(9000 + i, fill(good, i), "en", "vast", 0) for i in range(600)] + [(8000, fill(bad, 3), "en", "vast", 0)]
    out = {r["doc_id"]: r for r in host_rules.judge(spark.createDataFrame(rows, DOCS)).collect()}
    assert not any(out[i]["kept"] for i in range(60)) and all(out[1000 + i]["kept"] for i in range(300)) and out[5001]["kept"]
    # What a document does beyond the base rules counts for its host only.
    assert out[8000]["kept"] and out[5000]["kept"] and not out[5000]["host_failed"]
    assert host_rules.judge(docs(spark, [])).count() == 0


def naive_leaks(texts, items):
    """Every window as long as an item, by exact weighted-shingle similarity."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())

    def bag(w, k):
        c = {}
        for i in range(len(w) - k + 1):
            c[tuple(w[i : i + k])] = c.get(tuple(w[i : i + k]), 0) + 1
        return c

    out = {}
    for d, t in enumerate(texts):
        w = split(t)
        for i, u in enumerate(items):
            x = split(u)
            if not x:
                continue
            k = min(5, len(x))
            b = bag(x, k)
            for s in range(max(1, len(w) - len(x) + 1)):
                a = bag(w[s : s + len(x)], k)
                both = sum(min(a.get(g, 0), b[g]) for g in b)
                whole = sum(a.values()) + sum(b.values()) - both
                if whole and both / whole >= 0.8:
                    out.setdefault(d, set()).add(i)
    return {d: sorted(v) for d, v in out.items()}


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(9)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]) + str(rng.randint(0, 40))
    text = lambda n: [word() for _ in range(n)]
    items = [" ".join(text(n)) for n in (14, 20, 36, 36, 50)] + ["same " * 20, "one two three", "", None]
    texts = []
    for it in items[:5]:
        w = it.split()
        texts.append(" ".join(text(30) + w + text(30)))
        texts.append(", ".join(text(3) + [x.upper() for x in w]))
        edited = list(w)
        edited[1] = "changed"
        texts.append(" ".join(text(10) + edited + text(9)))
        texts.append(" ".join(text(10) + w[: len(w) // 2] + text(10)))
        texts.append(" ".join(w[1:] + text(4)))
    texts += ["same " * 50, "x one two three y", "one two", " ".join(text(3000)), *ODD]
    df = docs(spark, texts).withColumn("row", F.lit(1)).withColumn("item_ids", F.lit(2))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = decontaminate.contaminated(df, bench).collect()
    assert len(rows) == len(texts)
    got = {r["doc_id"]: list(r["item_ids"]) for r in rows if r["contaminated"]}
    want = naive_leaks(texts, items)
    assert got == want
    assert all(i in got[5 * i] for i in range(5)) and all(i in got[5 * i + 1] for i in range(5))
    left = decontaminate.drop_contaminated(df, bench)
    assert left.columns == df.columns and left.count() == len(texts) - len(got)
    assert decontaminate.contaminated(df, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contaminated(docs(spark, []), bench).count() == 0


def test_simhash_of_short_and_long_arrays_is_the_majority_of_bits(spark, monkeypatch):
    rng = random.Random(2)
    rows = [[rng.getrandbits(64) - (1 << 63) for _ in range(n)] for n in (1, 2, 7, 40, 300)] + [[5, 5, 6], [-1], []]
    want = [sum(1 << b for b in range(64) if 2 * sum((h >> b) & 1 for h in r) > len(r)) for r in rows]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, h array<bigint>")
    for lane in (30_000, 20):
        monkeypatch.setattr(decontaminate, "LANE", lane)
        got = [r["fp"] % (1 << 64) for r in df.select("i", decontaminate.simhash(F.col("h")).alias("fp")).orderBy("i").collect()]
        assert got == want


def test_decontamination_finds_every_edited_window(spark):
    rng = random.Random(21)
    word = lambda: f"w{rng.randint(0, 5000)}"
    items = [[word() for _ in range(n)] for n in (41, 41, 50, 60, 100)]
    texts = []
    for _ in range(60):
        for w in items:
            x = list(w)
            for _ in range(rng.randint(1, 2)):
                at = rng.randrange(len(x))
                x[at : at + rng.randint(0, 2)] = [word() for _ in range(rng.randint(0, 2))]
            texts.append([word() for _ in range(9)] + x + [word() for _ in range(9)])
    # A passage whose halves changed places, and one with a long insertion.
    texts += [w[len(w) // 2 :] + w[: len(w) // 2] for w in items] + [items[4][:5] + ["x"] * 6 + items[4][5:]]
    texts, items = [" ".join(t) for t in texts], [" ".join(w) for w in items]
    rows = decontaminate.contaminated(docs(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    want = naive_leaks(texts, items)
    assert len(want) > 100
    assert {r["doc_id"]: list(r["item_ids"]) for r in rows if r["contaminated"]} == want
