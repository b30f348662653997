"""Near-duplicates, components, page extraction, classifiers, mixing and the pipeline against brute force."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from cairnfield.llm import mixing, quality, simhash, toxicity, wrapper
from cairnfield.llm.common import materialize
from cairnfield.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n\t", "a", "word " * 30_000]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{i % 2}", None) for i, t in enumerate(texts)], DOCS)


def naive_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def naive_components(fps):
    parent = list(range(len(fps)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return [top(i) for i in range(len(fps))]


def test_fingerprints_match_the_definition():
    rng = random.Random(1)
    texts = ["".join(rng.choice(["a", "B", "é", " ", "\t", "\x0b", "日", "x y"]) for _ in range(rng.randint(0, 60))) for _ in range(200)] + ODD
    for t in texts:
        assert simhash.fingerprint(t) == naive_fingerprint(t)


def test_links_lose_no_pair_within_the_radius(spark):
    rng = random.Random(4)
    fps = []
    for _ in range(60):
        seed = rng.getrandbits(64)
        for flips in (0, 1, 2, 3, 3, 3, 4, 5):
            fp = seed
            for b in rng.sample(range(64), flips):
                fp ^= 1 << b
            fps.append(fp)
    # A chain and a dense cluster around one fingerprint.
    fps += [0xFFFF << i for i in range(0, 8)] + [1 << i for i in range(64)]
    fps = list(dict.fromkeys(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    number = {s: i for i, s in enumerate(signed)}
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    pairs = [(number[r["a"]], number[r["b"]]) for r in simhash.links(df).collect()]
    assert all(bin(fps[a] ^ fps[b]).count("1") <= 3 for a, b in pairs)
    parent = list(range(len(fps)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        x, y = sorted((top(a), top(b)))
        parent[y] = x
    assert [top(i) for i in range(len(fps))] == naive_components(fps)


def test_components_of_long_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 30)]
    df = spark.createDataFrame([*chain, *star, (5, 5), (None, 3), (40, 39)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(df, "a", "b").collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}
    assert components(df.limit(0), "a", "b").count() == 0


def test_components_of_a_shuffled_chain_take_few_rounds(spark, monkeypatch):
    from cairnfield.llm import components as module

    ids = random.Random(3).sample(range(400), 400)
    steps = []
    monkeypatch.setattr(module, "_state", lambda links, old=module._state: steps.append(1) or old(links))
    monkeypatch.setattr(module, "HOT_NODES", 3)  # the way of hot nodes, too
    df = spark.createDataFrame(list(zip(ids, ids[1:])) + [(1_000, i) for i in range(1_001, 3_100)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(df, "a", "b").collect()}
    assert got == dict.fromkeys(range(400), 0) | dict.fromkeys(range(1_000, 3_100), 1_000)
    assert len(steps) <= 12


def test_near_duplicates_match_brute_force(spark, sf_dir):
    rows = simhash.op2_simhash(spark, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    ids = sorted(texts)
    fps = [naive_fingerprint(texts[i]) for i in ids]
    want = dict(zip(ids, (ids[c] for c in naive_components(fps)), strict=True))
    assert {r["doc_id"]: r["component_id"] for r in rows} == want
    assert {r["doc_id"]: r["fingerprint"] for r in rows} == {i: f"{f:016x}" for i, f in zip(ids, fps, strict=True)}


def test_near_duplicate_odd_cases(spark):
    df = docs(spark, [*ODD, "same text here now", "Same text here now"]).withColumn("fp", F.lit(1)).withColumn("node", F.lit(2))
    rows = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()}
    assert (rows[0], rows[1], rows[2]) == (0, 0, 0) and rows[6] == 5
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 3, 4, 5]
    with_null = df.select("doc_id", "text").union(spark.createDataFrame([(None, "same text here now"), (7, "a"), (7, "a")], "doc_id long, text string"))
    again = simhash.near_duplicates(with_null).collect()
    assert len(again) == 10 and [r["component_id"] for r in again if r["doc_id"] is None] == [5]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def jaccard(a, b):
    def sets(t):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}

    x, y = sets(a), sets(b)
    return len(x & y) / len(x | y)


def test_similar_groups_match_brute_force(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(25):
        words = [f"w{rng.randrange(3_000)}" for _ in range(rng.choice((6, 60, 200)))]
        for edits in (0, 0, 1, 2, 4, 7, 12):
            copy = list(words)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(9_999)}"
            texts.append(" ".join(copy))
    links = {(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8}
    rows = simhash.similar_groups(docs(spark, texts)).collect()
    group = {r["doc_id"]: r["group"] for r in rows}
    assert sum(group[i] == group[j] for i, j in links) >= 0.9 * len(links)
    parent = list(range(len(texts)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in links:
        parent[max(top(i), top(j))] = min(top(i), top(j))
    # Nothing is joined that no chain of links joins.
    assert all(top(i) == top(j) for i in group for j in group if group[i] == group[j])


def test_similar_groups_of_a_large_family_are_exact(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    texts = ["", "alone", *(" ".join(f"x{rng.randrange(10**6)}" for _ in range(80)) for _ in range(40))]
    for _ in range(300):
        copy = list(base)
        for _ in range(rng.choice((2, 4, 5, 6))):
            copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
        texts += [" ".join(copy)] * rng.choice((1, 1, 2))
    rng.shuffle(texts)
    df = docs(spark, texts).repartition(7)
    sets = [frozenset(zip(*(t.split()[i:] for i in range(5)), strict=False)) or t for t in texts]
    top = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            same = len(sets[i] & sets[j]) if len(sets[i]) > 20 < len(sets[j]) else len(sets[i]) * (texts[i] == texts[j])
            if top[i] != top[j] and (texts[i] == texts[j] or same * 1.8 >= 0.8 * (len(sets[i]) + len(sets[j]))):
                old, new = top[i], top[j]
                top = [new if x == old else x for x in top]

    def partition(group):
        by = {}
        for i, g in group.items():
            by.setdefault(g, set()).add(i)
        return sorted(map(sorted, by.values()))

    want = partition(dict(enumerate(top)))
    assert 100 < max(map(len, want)) < 440 and len(want) > 60
    made = {}

    def counted(df, name, old=simhash.materialize):
        out = old(df, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(simhash, "materialize", counted)
    assert partition({r["doc_id"]: r["group"] for r in simhash.similar_groups(df).collect()}) == want
    # Pairs between texts that are not similar cost no rows.
    assert sum(made.get(x, 0) for x in ("candidates", "similar", "remaining")) < 15 * len(texts)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    monkeypatch.setattr(simhash, "MOST_BLOCK", 32)
    assert partition({r["doc_id"]: r["group"] for r in simhash.similar_groups(df).collect()}) == want


def test_shared_shingles_are_counted_once_for_each_text(spark):
    sets = [(1, [10, 11, 12]), (2, [10, 11, 13]), (3, [10, -14]), (4, [-15]), (5, []), (4, [-15])]
    df = spark.createDataFrame(sets, "key long, hashes array<long>").repartition(3)
    assert {r["key"]: r["alone"] for r in simhash._alone(df).collect()} == {1: 1, 2: 1, 3: 1, 4: 1}
    held = simhash._held(df.where("key < 4 or key = 5")).collect()
    assert {r["key"]: sorted(map(tuple, r["held"])) for r in held} == {1: [(10, 3), (11, 2)], 2: [(10, 3), (11, 2)], 3: [(10, 3)]}


def test_rows_made_do_not_grow_with_the_partitions(spark):
    words = [f"w{i}" for i in range(80)]
    texts = [" ".join(words[:40] + [f"x{i}"] + words[40:]) for i in range(60)]
    df = docs(spark, texts).repartition(2).localCheckpoint()
    store = spark._jsparkSession.sharedState().statusStore()

    def made(partitions: str) -> dict[str, int]:
        """The rows that each grouped Arrow function made."""
        known = store.executionsCount()
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        assert len({r["group"] for r in simhash.similar_groups(df).collect()}) == 1
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        rows, runs = {}, store.executionsList()
        for i in range(known, runs.size()):
            run = runs.apply(i).executionId()
            nodes = store.planGraph(run).allNodes()
            arrow = [n for n in map(nodes.apply, range(nodes.size())) if "FlatMapGroupsInArrow" in n.name()]
            ours = {n.metrics().apply(k).accumulatorId(): re.search(r"_\w+\(|run\(", n.desc())[0] for n in arrow for k in range(n.metrics().size()) if n.metrics().apply(k).name() == "number of output rows"}
            values = store.executionMetrics(run).iterator()
            while ours and values.hasNext():
                value = values.next()
                if value._1() in ours:
                    rows[ours[value._1()]] = int(value._2().replace(",", ""))
        return rows

    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        few, many = made("4"), made("48")
        assert few and all(many[name] <= 3 * few[name] for name in many), (few, many)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_one_row_of_each_group_stays(spark):
    a, b = "one text of six words here", "another text that is like none"
    rows = [(1, a), (1, a), (2, a), (2, b), (None, a), (None, "alone without any id at all"), (None, "alone without any id at all"), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_id", F.lit(1)).withColumn("t", F.lit(2))
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.fillna("", ["text"]).collect()) == sorted([(1, a), (2, b), (0, "alone without any id at all"), (3, "")])
    assert simhash.keep_first(df.limit(0)).count() == 0


def page(title, paragraphs, extra=""):
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a='</p>';</script></head><body><nav><ul><li><a>m</a></ul></nav><div class='ad'>buy</div><article><h1>{title}</h1>{body}{extra}</article><footer>&copy; f</footer></body></html>"


def neutral(title, paragraphs, extra):
    """A page without telling names, and a block below its content."""
    return f"<body><div><h2>{title}</h2>{''.join(f'<p>{p}</p>' for p in paragraphs)}</div><div>{extra}</div></body>"


def test_pages_lose_boilerplate_and_keep_their_text(spark):
    rows = [(1, "http://a.x/1", page("T &amp; t", ["one  two<br>three", "four &lt;5"]) + "<!-- end -->"), (2, "http://a.x/2", None), (3, None, "plain <b>text</b>"), (4, "u", ""), (4, "u", "")]
    got = [(r["page_id"], r["text"]) for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("h"))).orderBy("page_id").collect()]
    assert got == [(1, "T & t\n\none two three\n\nfour <5"), (2, ""), (3, "plain text"), (4, ""), (4, "")]
    assert wrapper.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


STORY = "<p>Story words go here and there are many of them in a row.</p>"
SAID = "Story words go here and there are many of them in a row."


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (f'<body><div class="post hentry tag-news"><h1>T</h1>{STORY}</div></body>', ["T", SAID]),
        (f'<div id="page" class="site has-sidebar"><article>{STORY}</article></div>', [SAID]),
        (f'<div class="layout no-sidebar">{STORY}</div>', [SAID]),
        (f'<div class="legal text">{STORY}{STORY}</div>', [SAID, SAID]),
        (f'<article><h1>T</h1>{STORY}<section class="discussion"><h2>D</h2>{STORY}</section></article>', ["T", SAID, "D", SAID]),
        (f'<form id="aspnetForm"><input><h1>T</h1>{STORY}<label>x</label></form>', ["T", SAID]),
        (f'<div>{STORY * 6}</div><article class="card"><p>Teaser</p></article>', [SAID] * 6),
        ("<article><p>We have <math><mi>x</mi><mo>=</mo><mn>3</mn></math> and <label>this</label> <object>o</object> too</p></article>", ["We have x=3 and this o too"]),
        ("<article><p title=O'Reilly>one</p><p>two</p><p class='x'>three</p></article>", ["one", "two", "three"]),
        (f'<article><h1>T</h1>{STORY}<div class="comments">{STORY * 5}</div><div class="comment-list">{STORY}</div></article>', ["T", SAID]),
        (f"<div>{STORY}</div><ul><li><a>a</a></li><li><a>b</a></li><li><a>c</a></li></ul>", [SAID]),
        (f'<div><h1>T</h1>{STORY}</div><div class="sidebar">{STORY * 9}</div><form>{STORY}</form>', ["T", SAID]),
        (f'<div class="widget">{STORY * 4}<div class="content-card">{STORY * 3}</div></div>', [SAID] * 7),
        (f'<div class="widget">{STORY * 9}<div class="sidebar"><p>few words</p></div></div>', [SAID] * 9),
        (f"<div>{STORY}<ul><li><a>a</a></li><li><a>b</a></li><li><a>c</a></li></ul>{STORY}</div>", [SAID, "a", "b", "c", SAID]),
        (f"<header><h1>T</h1><p>since 1900</p></header><div>{STORY}</div>", ["T", SAID]),
        (f"<header><nav><h1>N</h1></nav></header><div>{STORY}</div>", [SAID]),
        (f'<div class="site-header">x</div><div class="cookie-notice">c</div>{STORY}<div id="footer">f</div>', [SAID]),
    ],
)
def test_page_rules(html, want):
    assert [n[2] for n in wrapper.parse(html) if n[3]] == want


def test_neutral_chrome_goes_by_alignment_alone(spark):
    """Blocks with plain names that pages of a host repeat at the same place go; the same words inside a text stay."""
    top, low = "<div><p>Your daily paper since long ago</p></div>", "<div><p>Write to us at any time of day</p></div>"
    rows = []
    for i in range(2):
        body = "".join(f"<p>page {i} says {k} things</p>" for k in range(3 + i))
        rows.append((i, f"http://two.x/{i}", f"<body>{top}<div><h2>head {i}</h2>{body}</div>{low}</body>"))
    for i in range(9):
        body = "".join(f"<p>part {i} has {k}</p>" for k in range(2 + i % 3)) + ("<p>Your daily paper since long ago</p>" if i == 4 else "")
        rows.append((10 + i, f"http://nine.x/{i}", f"<body>{top}<div><h2>top {i}</h2>{body}</div>{low}</body>"))
    got = {r["page_id"]: r["text"].split("\n\n") for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(2):
        assert got[i] == [f"head {i}", *[f"page {i} says {k} things" for k in range(3 + i)]]
    for i in range(9):
        assert got[10 + i] == [f"top {i}", *[f"part {i} has {k}" for k in range(2 + i % 3)], *(["Your daily paper since long ago"] if i == 4 else [])]


def test_pathological_pages_take_linear_time():
    assert wrapper.parse("<b>x" * 40_000 + "<p>y" * 40_000)
    assert wrapper.parse("<div>" * 20_000 + "z" + "</div>" * 20_000)[-1][2] == "z"
    assert wrapper.parse("<div class=ad>w " * 20_000 + "z" + "</div>" * 20_000)[-1][3]
    labels, depths = ["r", *["p", "q"] * 4_000], [0, *[1, 2] * 4_000]
    assert len(wrapper.simple_tree_matching(labels, depths, labels, depths)) == len(labels)


def test_constant_blocks_become_template_but_copies_do_not(spark):
    box = "<p>Read more on our channel</p>"
    rows = [(i, f"http://h.x/{i}", neutral(f"title {i}", [f"text {i} first", f"text {i} second"], box)) for i in range(12)]
    rows += [(100 + i, f"http://copy.x/{i}", page("same", ["every page", "is a copy"])) for i in range(12)]
    got = {r["page_id"]: r["text"] for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"title {i}\n\ntext {i} first\n\ntext {i} second" for i in range(12))
    assert all(got[100 + i] == "same\n\nevery page\n\nis a copy" for i in range(12))


@pytest.mark.parametrize("box", ["article", "div", "main"])
def test_constant_blocks_of_the_content_stay(spark, box):
    """Versions of one article, sub-headings and standing lines: what pages repeat inside their content is content."""
    top = "<div><p>Your daily paper since long ago</p></div>" if box == "div" else ""
    put = lambda blocks: f"<body>{top}<{box}>{''.join(f'<{tag}>{text}</{tag}>' for tag, text in blocks)}</{box}></body>"
    shared = [("h1", "The title of both"), *(("p", f"paragraph {k} that both versions share word for word") for k in range(4))]
    versions = [[*shared[:3], *(("p", f"version {v} says {k} in its own way") for k in range(6)), *shared[3:]] for v in range(2)]
    recipes = [[("h1", f"dish {i}"), ("h2", "Ingredients"), ("p", f"take {i} eggs and {i} spoons"), ("h2", "Method"), ("p", f"stir {i} times, wait {i} minutes and serve it to {i} guests of the house")] for i in range(6)]
    columns = [[("p", f"column {i} on this and that"), ("p", f"more of column {i}"), ("p", "The author writes here every week")] for i in range(12)]
    rows, want = [], {}
    for host, group in (("versions", versions), ("recipes", recipes), ("columns", columns)):
        for i, blocks in enumerate(group):
            want[len(rows)] = "\n\n".join(text for _, text in blocks)
            rows.append((len(rows), f"http://{host}.x/{i}", put(blocks)))
    got = {r["page_id"]: r["text"] for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_template_is_found_though_the_first_pages_lack_it(spark):
    box = "<p>Read more on our channel</p>"
    rows = [(10 + i, f"http://h.x/{i}", neutral(f"title {i}", [f"text {i} first", f"text {i} second"], box)) for i in range(12)]
    rows += [(1, "http://h.x/null", None), (2, "http://h.x/error", "<html><body><h2>Not found</h2></body></html>")]
    # A second layout of the host has a block of its own.
    rows += [(50 + i, f"http://h.x/q{i}", f"<body><section><dl><dd>question {i}</dd><dd>Ask our experts</dd></dl></section></body>") for i in range(6)]
    got = {r["page_id"]: r["text"] for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[10 + i] == f"title {i}\n\ntext {i} first\n\ntext {i} second" for i in range(12))
    assert all(got[50 + i] == f"question {i}" for i in range(6))
    assert got[1] == "" and got[2] == "Not found"


def test_simple_tree_matching_finds_the_largest_matching():
    rng = random.Random(6)

    def tree(depth):
        return (rng.choice("ab"), [tree(depth - 1) for _ in range(rng.randint(0, 3))] if depth else [])

    def size(a, b):
        if a[0] != b[0]:
            return 0
        w = [[0] * (len(b[1]) + 1) for _ in range(len(a[1]) + 1)]
        for i, x in enumerate(a[1], 1):
            for j, y in enumerate(b[1], 1):
                w[i][j] = max(w[i - 1][j], w[i][j - 1], w[i - 1][j - 1] + size(x, y))
        return 1 + w[-1][-1]

    def flat(t, d=0):
        return [(t[0], d)] + [x for k in t[1] for x in flat(k, d + 1)]

    for _ in range(60):
        a, b = ("r", [tree(2) for _ in range(3)]), ("r", [tree(2) for _ in range(3)])
        fa, fb = flat(a), flat(b)
        m = wrapper.simple_tree_matching([x[0] for x in fa], [x[1] for x in fa], [x[0] for x in fb], [x[1] for x in fb])
        assert len(m) == size(a, b) and len(set(m.values())) == len(m)


def test_long_child_lists_are_aligned_in_the_middle():
    a, b = ["h1", *["p"] * 70, "div.x", *["p"] * 5, "ul"], ["h1", "figure", *["p"] * 70, "div.x", *["p"] * 5, "h2", "ul"]
    for times in (1, 30):  # 30: beyond TREE_CELLS
        la, lb = ["r", *a * times], ["r", *b * times]
        m = wrapper.simple_tree_matching(la, [0, *[1] * (len(la) - 1)], lb, [0, *[1] * (len(lb) - 1)])
        assert len(m) == len(la) and all(la[x] == lb[y] for x, y in m.items())


def test_common_sequence_is_longest(monkeypatch):
    rng = random.Random(8)
    for bits in (8_000_000, 20):
        monkeypatch.setattr(wrapper, "ROW_BITS", bits)
        for _ in range(300):
            a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 14))] for _ in range(2))
            w = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for i, x in enumerate(a, 1):
                for j, y in enumerate(b, 1):
                    w[i][j] = max(w[i - 1][j], w[i][j - 1], w[i - 1][j - 1] + (x == y))
            got = wrapper.common_sequence(a, b)
            assert len(got) == w[-1][-1] and all(a[i] == b[j] for i, j in got)
            assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:], strict=False))


def test_deep_trees_keep_their_depths():
    chain = lambda n: (["r", *["div"] * n, "p", "ul"], [0, *range(1, n + 1), n + 1, n + 1])
    for n in (100, 1_500, 4_000):
        labels, depths = chain(n)
        assert len(wrapper.simple_tree_matching(labels, depths, labels, depths)) == n + 3
    html = "<div>" * 70 + "<section>a</section>" + "</div>" * 10 + "<section>b</section>"
    page_of = lambda x: next(wrapper._parse_pages(iter([pa.record_batch({"i": [1], "u": ["u"], "h": [x]})])))
    assert max(page_of(html).column("depths")[0].as_py()) == 71


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = quality.op7_quality(spark, sf).toPandas()
    assert (rows["held_out"] == rows["doc_id"].map(held)).all() and rows["score"].between(0, 1).all()
    known = rows.merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    known = known[known["held_out"]]
    assert (known["predicted"] == known["quality"]).mean() > 0.95


def test_isotonic_fit_is_the_least_squares_monotone_one():
    rng = np.random.default_rng(0)
    s, y = np.sort(rng.random(40)), rng.random(40)
    knots, values = quality.isotonic(s, y, np.ones(40))
    assert (np.diff(values) > 0).all()
    # Min-max formula of isotonic regression.
    want = [max(min(y[i : j + 1].mean() for j in range(k, 40)) for i in range(k + 1)) for k in range(40)]
    assert sorted(set(np.round(want, 9))) == sorted(set(np.round(values, 9)))


def test_quality_odd_cases(spark):
    df = docs(spark, [*ODD, "a b c " * 40]).withColumn("x", F.lit(0)).withColumn("y", F.lit(0))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(6) for _ in range(2)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    assert quality.score(df, labels).count() == 6
    assert {r["score"] for r in quality.score(df, labels.limit(0)).collect()} == {0.5}
    assert quality.keep_good(df, labels.limit(0)).count() == 6
    assert quality.score(df.limit(0), labels).count() == 0
    assert toxicity.score(df, labels).count() == 6
    assert {r["score"] for r in toxicity.score(df, labels.limit(0)).collect()} == {0.0}
    assert toxicity.score(df.limit(0), labels).count() == 0


def test_toxicity_locates_the_offending_sentence(spark):
    rng = random.Random(8)
    plain = lambda: " ".join(rng.choice("river stone field light morning paper garden window".split()) for _ in range(8))
    texts, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        s = [plain() for _ in range(rng.randint(3, 9))]
        if bad:
            s.insert(rng.randint(0, len(s)), f"you {rng.choice(['vilegrub', 'mudbrain'])} {plain()}")
        texts.append(". ".join(s) + ".")
        labels.append((i, 1, int(bad)))
    rows = {r["doc_id"]: r for r in toxicity.score(docs(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    wrong = [i for i, _, y in labels if rows[i]["predicted"] != y]
    assert not wrong
    for i, _, y in labels:
        found = [texts[i][s["start"] : s["end"]] for s in rows[i]["offending"]]
        assert all("vilegrub" in s or "mudbrain" in s for s in found) and len(found) == y


def test_raking_meets_targets_and_budget(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(20, 200), rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b", "c"]), 0) for i in range(2000)]
    df = spark.createDataFrame(rows, DOCS)
    targets = {"source": {"a": 1, "b": 1, "c": 1}, "lang": {"en": 2, "de": 1, None: 1}}
    out = mixing.weigh(df, targets, budget=0.1).toPandas()
    assert len(out) == 2000
    share = lambda c: (out["tokens"] * out["probability"]).groupby(out[c].fillna("none")).sum() / (out["tokens"] * out["probability"]).sum()
    assert share("source").to_dict() == pytest.approx({"a": 1 / 3, "b": 1 / 3, "c": 1 / 3}, abs=1e-6)
    assert share("lang").to_dict() == pytest.approx({"en": 0.5, "de": 0.25, "none": 0.25}, abs=1e-6)
    assert (out["tokens"] * out["probability"]).sum() == pytest.approx(0.1 * out["tokens"].sum())
    assert out.loc[out["kept"], "tokens"].sum() == pytest.approx(0.1 * out["tokens"].sum(), rel=0.1)
    big = mixing.weigh(df, targets, budget=0.1, driver_cells=0).toPandas()
    both = out.merge(big, on="doc_id")
    assert np.allclose(both["probability_x"], both["probability_y"], atol=1e-6)


def test_mixing_query_matches_a_plain_version(spark, sf_dir):
    """op6_mixing on a whole table: cells, raking and probabilities against a loop over dictionaries."""
    out = mixing.op6_mixing(spark, sf_dir).toPandas()
    texts = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert sorted(out["doc_id"]) == sorted(texts)
    assert all(n == len(re.findall(r"[^\x20\x09-\x0D]+", texts[d]["text"] or "")) for d, n in zip(out["doc_id"], out["tokens"], strict=True))
    cells = {k: float(v) for k, v in out.groupby(["source", "lang", "topic"])["tokens"].sum().items()}
    total = sum(cells.values())
    w = {k: v / total for k, v in cells.items()}
    for _ in range(400):
        for d, goal in enumerate((lambda v, s: 1.0, lambda v, s: mixing.TARGETS["lang"].get(v, 0.0), lambda v, s: s**0.5)):
            raw, now = {}, {}
            for k in cells:
                raw[k[d]] = raw.get(k[d], 0) + cells[k] / total
                now[k[d]] = now.get(k[d], 0) + w[k]
            want = {v: goal(v, s) * (s > 0) for v, s in raw.items()}
            w = {k: x * want[k[d]] / sum(want.values()) / now[k[d]] if now[k[d]] else 0.0 for k, x in w.items()}
    p, free, left = {k: 1.0 for k in cells}, {k for k in cells if cells[k] and w[k]}, 0.5 * total
    while free:
        scale = left / sum(w[k] * total for k in free)
        over = {k for k in free if scale * w[k] * total / cells[k] >= 1}
        if not over:
            p |= {k: scale * w[k] * total / cells[k] for k in free}
            break
        left -= sum(cells[k] for k in over)
        free -= over
    want = [p[k] for k in zip(out["source"], out["lang"], out["topic"], strict=True)]
    assert np.allclose(out["probability"], want, atol=1e-6)
    assert out["residual"].iloc[0] < 1e-3 and out["topic"].nunique() > 2


def test_mixing_odd_cases(spark):
    df = docs(spark, ODD).withColumn("tokens", F.lit(5)).withColumn("topic", F.lit("t")).withColumn("probability", F.lit(0.5)).withColumn("_source", F.lit("q"))
    assert mixing.weigh(df).count() == 5
    kept = mixing.sample(df, budget=1.0)
    assert kept.count() == 5 and set(kept.columns) == {*df.columns, "mix_topic", "mix_tokens", "mix_weight"}
    assert kept.select("topic", "tokens").distinct().collect() == [("t", 5)]
    assert mixing.weigh(df.limit(0)).count() == 0 and mixing.sample(df.limit(0)).count() == 0
    assert mixing.probabilities(np.array([10.0, 10.0, 0.0]), np.array([0.9, 0.1, 0.0]), 0.5).tolist() == pytest.approx([0.9, 0.1, 1.0])


def test_pipeline_stages_keep_columns_and_take_effect(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, sizes = df.columns, [df.count()]
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, sf_dir)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert df.columns == columns
        df = materialize(df, "test")
        sizes.append(df.count())
        if name == "near-duplicates":
            assert df.select("text").distinct().count() == df.count()
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] == sizes[4] > sizes[5] > 0
    again = corpus_pipeline.run(spark, sf_dir)
    assert again.count() == sizes[5]
