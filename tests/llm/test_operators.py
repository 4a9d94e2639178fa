"""The ten operators against brute force on small fixtures with nulls, ties, repeats and empty tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hexagrove.llm import decontaminate, html_wrapper, jaccard_join, line_dedup, packing, quality_rules, rule_ensemble, secret_scan, sharding, token_counts
from hexagrove.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, shard string, spans int"
WORDS = "the river runs past seven old mills and a small stone bridge where people meet to trade salt wool grain and stories of the sea".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def texts() -> list[str | None]:
    rng = random.Random(7)
    shared = "This very line is shared by many documents of the small corpus."
    out: list[str | None] = [None, "", " ", "one two", "One  TWO", "one two three four five", "é ü  ▁ x\x00y 中文 text", "a\n\n b \t\r\n"]
    base = [sentence(rng, 120) for _ in range(6)]
    out += base + base[:2]
    for b in base[:3]:
        for _ in range(4):
            w = b.split()
            w[rng.randrange(len(w))] = "changed"
            out.append(" ".join(w))
    out += [sentence(rng, 60) + "\n " + shared.upper() + " \n" + sentence(rng, 5) for _ in range(7)]
    out += ["word " * 9000, 'password = "hunter2hunter22"\napi_key: AKIA' + "ABCD1234EFGH5678" + "\nDB_SECRET = \"q8Zr51TxPw0LmN\"\nx = DB_SECRET\nid deadbeefdeadbeef01"]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "mine", 5) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows + [(None, "text without id", None, None, None)], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def known(df):
    return {r["doc_id"]: r for r in df.collect() if r["doc_id"] is not None}


def test_line_dedup(docs):
    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))

    holders = defaultdict(set)
    for i, t in enumerate(texts()):
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(i)
    got = known(line_dedup.dedup_lines(docs))
    dropped = 0
    for i, t in enumerate(texts()):
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(holders[key(x)]) >= 5 and i != max(holders[key(x)]))]
        assert (got[i]["n_lines"], got[i]["n_dropped"], got[i]["text"] or "") == (len(lines), len(lines) - len(kept), "\n".join(kept))
        dropped += len(lines) - len(kept)
    assert dropped == 6


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(1)
    h1, h2 = (rng.integers(0, 2**64, 5000, dtype=np.uint64) for _ in range(2))
    assert sorted(line_dedup.index(line_dedup.build(h1, h2), h1, h2)) == list(range(5000))


def test_sharding_law_and_slots(docs):
    rows = sharding.shard(docs, 4).collect()
    assert len(rows) == len(texts()) + 1 and "lang" in rows[0].asDict()
    for s in range(4):
        own = [r["slot"] for r in rows if r["shard"] == s]
        assert sorted(own) == list(range(len(own)))
    for r in rows:
        assert r["grown_shard"] in (r["shard"], 4)
        if r["doc_id"] is not None:
            t = (texts()[r["doc_id"]] or "").encode()
            assert (r["size"], r["text_crc32"]) == (len(t) + 8, zlib.crc32(t))


def test_token_counts_equal_the_library(docs):
    import sentencepiece

    model = vocabulary("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=model)
    got = known(token_counts.count_tokens(docs, model))
    for i, t in enumerate(texts()):
        n = len(lib.encode(t or ""))
        assert (got[i]["n_tokens"], got[i]["over_limit"]) == (n, n > 4096)


def test_packing_round_trip(docs):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    rows = packing.pack(docs, path, capacity=256).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for i, t in enumerate(texts()):
        ids, at = lib.encode(t or "", add_special_tokens=False).ids + [0], 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256


def test_cutting_stock_uses_every_piece_once():
    rng = random.Random(2)
    demand = Counter(rng.randint(1, 99) for _ in range(3000))
    plan = packing.cutting_stock(dict(demand), 100)
    used = Counter()
    for pattern, times in plan.items():
        assert sum(n * k for n, k in pattern) <= 100
        used.update({n: k * times for n, k in pattern})
    assert +used == demand
    assert sum(plan.values()) <= 1.02 * -(-sum(n * k for n, k in demand.items()) // 100) + 2


def test_html_main_text(spark):
    def page(i):
        return f"<html><head><title>t{i}</title><script>x()</script></head><body><header>Site</header><nav><a>Menu</a></nav><main><h1>Title {i}</h1><p>First &amp; best <b>text</b>\n {i}</p><p>Second {i * 7}</p></main><div class='sidebar'>Links</div><div class='comments'><p>nice {i}</p></div><footer>Footer</footer></body></html>"

    rows = [(i, "https://h.example/a", page(i), "keep") for i in range(8)] + [(8, None, None, "keep"), (9, "https://other.example/", "<p>lone", "keep")]
    got = {r["page_id"]: r for r in html_wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert [got[i]["text"] for i in range(8)] == [f"Title {i}\nFirst & best text {i}\nSecond {i * 7}" for i in range(8)]
    assert got[8]["text"] == "" and got[9]["text"] == "lone"


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_jaccard_components(docs):
    sets = [shingles(t) for t in texts()]
    parent = list(range(len(sets)))

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    got = known(jaccard_join.components_of(docs))
    assert [(got[i]["n_shingles"], got[i]["component_id"]) for i in range(len(sets))] == [(len(s), root(i)) for i, s in enumerate(sets)]
    assert sorted(known(jaccard_join.keep_one(docs))) == [i for i in range(len(sets)) if root(i) == i]


def test_jaccard_of_clusters_beyond_one_block(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    monkeypatch.setattr(jaccard_join, "PIVOTS", 2)
    rng = random.Random(11)
    made = []
    for family in range(2):
        base = [f"w{rng.randrange(400)}" for _ in range(130)]
        for _ in range(45):
            words = list(base)
            for k in rng.sample(range(130), rng.choice([0, 1, 2, 2, 3, 5, 8])):
                words[k] = f"v{rng.randrange(10**6)}"
            made.append(" ".join(words[rng.choice([0, 0, 10, 20]) :]))
    # Half of one family in front of the other: far from both, in their cluster.
    made += [" ".join(made[i].split()[:70] + made[-i - 1].split()[:70]) for i in range(12)]
    sets = [shingles(t) for t in made]
    component = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if component[i] != component[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                old, new = max(component[i], component[j]), min(component[i], component[j])
                component = [new if c == old else c for c in component]
    assert len(set(component)) > 10
    kinds = set()
    multiplied = jaccard_join.multiplied

    def watched(texts):
        kinds.update(r[0] for r in texts.selectExpr("explode(tasks) AS t").select("t.kind").distinct().collect())
        return multiplied(texts)

    monkeypatch.setattr(jaccard_join, "multiplied", watched)
    got = known(jaccard_join.components_of(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")))
    assert [got[i]["component_id"] for i in range(len(sets))] == component
    assert {1, 2, 3} <= kinds


def test_quality_counts_and_verdict(docs):
    got = known(quality_rules.score_quality(docs))
    for i, t in enumerate(texts()):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        tri = Counter(zip(w, w[1:], w[2:]))
        marked = {k + j for k, g in enumerate(zip(w, w[1:], w[2:])) if tri[g] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        r = {k.removeprefix("__q_"): v for k, v in got[i].asDict().items()}
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(marked))
        assert tuple(r[k] for k in quality_rules.COUNTS[:2]) + (r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 50 or 100 * len(marked) > 50 * len(w))
        assert not (r["base_failed"] and r["kept"])
    assert set(quality_rules.filter_quality(docs).columns) == set(docs.columns)


def test_leaks_are_found_and_clean_texts_left(spark):
    rng = random.Random(5)
    item = " ".join(f"w{rng.randrange(900)}" for _ in range(60))
    near = item.split()
    near[3] = "other"
    rows = [(0, sentence(rng, 80)), (1, sentence(rng, 30) + " " + item.upper() + " " + sentence(rng, 30)), (2, sentence(rng, 10) + " " + " ".join(near)), (3, None), (4, item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, None), (9, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["start"]) for r in decontaminate.find_leaks(docs, bench).collect()}
    assert got == {(1, 7, 30), (2, 7, 10), (4, 7, 0)}
    assert {r["doc_id"] for r in decontaminate.drop_leaks(docs, bench).collect()} == {0, 3}


def test_secret_spans(docs):
    got = known(secret_scan.scan_secrets(docs))
    for i, t in enumerate(texts()):
        t = t or ""
        spans = [("assign", m.start(), m.end()) for m in re.finditer(r"""(?a)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I) if len(m[2]) >= 12]
        spans += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 18]
        spans += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if m.end() - m.start() >= 16]
        order = sorted(spans, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in order).encode()).hexdigest()
    last = got[len(texts()) - 1]
    assert (last["n_assign"], last["n_access"], last["n_hex"]) == (3, 1, 1) and "lexed" in last["spans"]


def test_rule_ensemble_learns(spark):
    rng = random.Random(9)
    rows = [(i, sentence(rng, 100) if i % 2 else "|".join("BUY NOW!!!" for _ in range(30))) for i in range(120)]
    docs = spark.createDataFrame(rows + [(500, None)], "doc_id long, text string")
    model = rule_ensemble.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, quality int"), trees=5)
    got = {r["doc_id"]: r for r in rule_ensemble.score(docs, model).collect()}
    assert all(got[i]["predicted"] == i % 2 for i in range(80, 120)) and 0 <= got[500]["score"] <= 1
    none = rule_ensemble.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r["score"] for r in rule_ensemble.score(docs, none).collect()} == {0.5}


def test_empty_tables(spark, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert line_dedup.dedup_lines(empty).count() == 0
    assert sharding.shard(empty, 3).count() == 0
    assert token_counts.count_tokens(empty, vocabulary("piece_bpe_32k.model")).count() == 0
    assert packing.pack(empty, vocabulary("byte_bpe_50k.json")).count() == 0
    assert html_wrapper.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert jaccard_join.components_of(empty).count() == 0
    assert quality_rules.filter_quality(empty).count() == 0
    assert decontaminate.find_leaks(empty, bench).count() == 0
    assert secret_scan.scan_secrets(empty).count() == 0


def test_html_names_are_only_evidence(spark):
    def page(name, i):
        return f"<html><body><div class='{name}'><h1>Title {i}</h1><p>Body text number {i * 7} of the long article, which goes on and on {i}</p><div class='sidebar'><p>Links {i}</p></div></div></body></html>"

    names = ["overflow-hidden", "content has-sidebar", "entry-content no-sidebar", "post-related", "content widget"]
    rows = [(10 * k + i, f"https://h{k}.example/a", page(name, i)) for k, name in enumerate(names) for i in range(6)]
    rows += [(100 + i, "https://form.example/", f"<body><form id='form'><article class='banner'><p>Words {i} {i * 3} of the article</p></article></form></body>") for i in range(6)]
    got = {r["page_id"]: r["text"] for r in html_wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(len(names)):
        assert [got[10 * k + i] for i in range(6)] == [f"Title {i}\nBody text number {i * 7} of the long article, which goes on and on {i}" for i in range(6)]
    assert [got[100 + i] for i in range(6)] == [f"Words {i} {i * 3} of the article" for i in range(6)]


def test_html_keeps_all_that_varies_and_learns_each_layout(spark):
    body = "A long and different body of the text with many words, number {0} and {1}, so that it holds most of the page {0}"
    boiler = "This unmarked boilerplate says the same on each page of the host and is far longer than the short articles it stands beside."

    def page(host, i):
        if host == "lede":
            return f"<body><h1>Head {i}</h1><div class='body' id='post-{i}'><p>{body.format(i, 7 * i)}</p></div><div class='by'>By {i}</div></body>"
        if host == "short":
            return f"<body><div class='a'>{boiler}</div><div class='b'><p>Short {i}</p></div></body>"
        return f"<body><div class='a'>{boiler}</div><div class='b'><p>One {i}</p></div></body>" if i < 5 else f"<body><div class='c'><p>Two {i}</p></div><section>{boiler[::-1]}</section></body>"

    hosts = ["lede", "short", "two"]
    rows = [(100 * k + i, f"https://{h}.example/", page(h, i)) for k, h in enumerate(hosts) for i in range(10)]
    # Copies of one article, with a date of their own, never make it template.
    rows += [(300 + i, "https://copies.example/", f"<body><div><p>{body.format(1, 1)}</p><p>Date {i}</p></div></body>") for i in range(40)]
    rows += [(350 + i, "https://copies.example/", f"<body><div><p>{body.format(i, i + 60)}</p><p>Date {i + 70}</p></div></body>") for i in range(3)]
    got = {r["page_id"]: r["text"] for r in html_wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(10)] == [f"Head {i}\n{body.format(i, 7 * i)}\nBy {i}" for i in range(10)]
    assert [got[100 + i] for i in range(10)] == [f"Short {i}" for i in range(10)]
    assert [got[200 + i] for i in range(10)] == [f"{'One' if i < 5 else 'Two'} {i}" for i in range(10)]
    assert [got[300 + i] for i in range(40)] == [f"{body.format(1, 1)}\nDate {i}" for i in range(40)]


def test_leaks_of_short_items_and_far_fingerprints(spark):
    rng = random.Random(12)
    items, rows = [(1, "zeta eta theta"), (2, "omega"), (3, "zeta  ETA theta iota")], [(1, sentence(rng, 40) + " Zeta eta\ntheta iota " + sentence(rng, 9)), (2, "omega"), (3, "zeta eta iota theta"), (4, sentence(rng, 9) + " omega")]
    want = {(1, 1, 40), (1, 3, 40), (2, 2, 0), (4, 2, 9)}
    # Near copies at the least similarity, four of forty words changed at the ends; those with unlike fingerprints.
    pairs = []
    for k in range(10, 1010):
        w = [f"w{rng.randrange(900)}" for _ in range(40)]
        pairs.append((k, w, ["x1", "x2", *w[2:38], "x3", "x4"]))
    far = spark.createDataFrame(pairs, "k long, old array<string>, new array<string>")
    far = far.where(F.bit_count(decontaminate.simhash("old").bitwiseXOR(decontaminate.simhash("new"))) > 15).collect()
    assert far
    for k, w, v in far:
        a, b = (set(zip(*(x[i:] for i in range(5)))) for x in (w, v))
        assert 100 * len(a & b) >= 80 * len(a | b)
        items.append((k, " ".join(w)))
        rows.append((k, " ".join(v)))
        want.add((k, k, 0))
    got = {(r["doc_id"], r["item_id"], r["start"]) for r in decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want


def test_tree_match_equals_the_plain_recursion():
    rng = random.Random(5)

    def tree(depth: int) -> str:
        return "".join(f"<{t}>{tree(depth - 1) if depth else 'x'}</{t}>" for t in rng.choices(["div", "section", "p"], k=rng.randrange(4)))

    def plain(a, b) -> int:
        if a.tag != b.tag:
            return 0
        table = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
        for i, x in enumerate(a.children):
            for j, y in enumerate(b.children):
                table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + plain(x, y))
        return 1 + table[-1][-1]

    for _ in range(200):
        a, b = (html_wrapper.parse("<body>" + tree(3)) for _ in range(2))
        assert html_wrapper.tree_match(a, b, {}) == plain(a, b) == len(html_wrapper.aligned(a, b))


def test_html_deep_and_long_pages(spark):
    pages = [(k, "http://deep.example/x", f"<html><body><div>Same menu of all pages</div>{'<div>' * depth}<p>Own text number {k} of the page.</p>") for k, depth in enumerate([3, 3, 3, 5000])]
    pages += [(10 + k, "http://long.example/x", "<article>" + "".join(f"<p>line {k} {i}</p>" for i in range(n)) + "</article>") for k, n in enumerate([3, 4, 20_000])]
    got = {r.page_id: r.text for r in html_wrapper.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(f"Own text number {k} of the page." in got[k] for k in range(4))
    assert got[12].split("\n") == [f"line 2 {i}" for i in range(20_000)]
