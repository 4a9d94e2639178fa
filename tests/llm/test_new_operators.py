"""Substring dedup, whitening and ranked search against brute force, with nulls, ties, repeats and empty tables."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hexagrove.llm import jaccard_join, lexical_search, rolling, secret_scan, substring_dedup, whitening

WORDS = "the river runs past seven old mills and a small stone bridge where people meet to trade salt wool grain and stories of the sea".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(9)) for _ in range(n))


def corpus():
    rng = random.Random(3)
    passage, copy = sentence(rng, 33), sentence(rng, 90)
    out = [None, "", " \t\n", "one", sentence(rng, 19), sentence(rng, 20)]
    out += [copy] * 3 + [sentence(rng, 7) + "\n" + passage + "\t" + sentence(rng, 11) for _ in range(6)]
    for at in (10, 25, 60):
        words = copy.split()
        words[at] = "changed"
        out.append("\n".join(words))
    out += [passage + " é " + passage, "word " * 300, "word " * 25, "x" * 5000 + " " + passage, " ".join([sentence(rng, 40)] * 50)]
    return out


def without_repeats(rows):
    """By the definition: rows of (doc, text) to (words, removed, kept)."""
    earliest = {}
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - 19):
            k = tuple(w[i : i + 20])
            earliest[k] = min(earliest.get(k, (d, i)), (d, i))
    out = []
    for d, w in split:
        gone = {j for i in range(len(w) - 19) if earliest[tuple(w[i : i + 20])] < (d, i) for j in range(i, i + 20)}
        out.append((d, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def test_substrings_equal_the_definition(spark):
    rows = list(enumerate(corpus()))
    df = spark.createDataFrame([(*r, "own", 5) for r in rows], "doc_id long, text string, N_Words string, found int").repartition(4)
    out = substring_dedup.dedup_windows(df)
    assert out.columns == ["doc_id", "text", "found", "n_words", "n_removed"]
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in out.collect()) == without_repeats(rows)


@pytest.mark.parametrize("seed", range(3))
def test_substrings_with_few_words(spark, seed):
    """A small vocabulary: many chance repeats, borders everywhere, and matches of a document with itself."""
    rng = random.Random(seed)
    texts = []
    for _ in range(60):
        parts = [" ".join(rng.choice("ab") for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(1, 4))]
        texts.append(" ".join(parts if rng.random() < 0.5 or not texts else [*parts, rng.choice(texts)]))
    rows = [(3 * i, t) for i, t in enumerate(texts)]
    out = substring_dedup.dedup_windows(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in out.collect()) == without_repeats(rows)


def test_substrings_of_repeated_rows_and_rows_without_id(spark):
    rng = random.Random(8)
    a, b = sentence(rng, 30), sentence(rng, 25)
    rows = [(1, a), (1, a), (2, a), (1, b + " tail"), (None, a), (None, None)]
    out = substring_dedup.dedup_windows(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in out)
    assert got == [(0, 0, 0), (0, 30, 0), (1, 26, 0), (1, 30, 0), (1, 30, 0), (2, 30, 30)]


def test_word_hashes_over_chunks(monkeypatch):
    rng = random.Random(1)
    texts = [" ".join("w" * rng.randrange(1, 9) + str(rng.randrange(50)) for _ in range(rng.randrange(60))) + "\n" * rng.randrange(3) for _ in range(200)] + ["y" * 500, ""]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    whole = rolling.word_hashes(data, offsets)
    monkeypatch.setattr(rolling, "CHUNK", 64)
    parts = rolling.word_hashes(data, offsets)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()
    words = [w for t in texts for w in t.split()]
    assert list(np.diff(whole[1])) == [len(t.split()) for t in texts]
    assert len(set(whole[0].tolist())) == len(set(words)) and len({(w, h) for w, h in zip(words, whole[0].tolist())}) == len(set(words))


def random_vectors(n, d, seed):
    rng = np.random.default_rng(seed)
    return (rng.standard_normal((n, d)) @ rng.standard_normal((d, d))).astype(np.float32)


def test_whitening_equals_numpy(spark):
    x = random_vectors(300, 12, 1)
    rows = [(i, v.tolist(), "own") for i, v in enumerate(x)]
    rows += [(900, None, ""), (901, [None] + [1.0] * 11, ""), (902, [float("nan")] * 12, ""), (903, [float("inf")] * 12, ""), (904, [1.0] * 5, ""), (905, [], ""), (906, [1e30] * 12, ""), (None, x[0].tolist(), ""), (7, x[7].tolist(), "")]
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>, component string").repartition(4))
    got = out.collect()
    whole = np.floor(1024 * np.concatenate((x, x[:1], x[7:8])).astype(float)) + 100_000
    n, s = len(whole), whole.sum(axis=0)
    values, vectors = np.linalg.eigh(np.cov(whole.T, bias=True))
    values, vectors = values[::-1][:8], vectors[:, ::-1][:, :8]
    want = (whole - s / n) @ vectors / np.sqrt(values)
    assert len(got) == 8 * n and {r["n"] for r in got} == {n}
    table = {(r["vec_id"], r["component"]): r for r in got}
    for c in range(8):
        sign = np.sign(table[0, c + 1]["whitened"] * want[0, c])
        for i in range(300):
            assert table[i, c + 1]["whitened"] == pytest.approx(sign * want[i, c], abs=1e-9)
        assert table[0, c + 1]["explained"] == pytest.approx(values[c] / np.cov(whole.T, bias=True).trace(), rel=1e-9)
    assert all(table[i, 1]["deviation"] == int(((n * whole[i] - s).astype(object) ** 2).sum()) for i in range(300))
    assert max(r["identity_error"] for r in got) < 1e-10
    assert sum(r["vec_id"] is None for r in got) == 8 and sum(r["vec_id"] == 7 for r in got) == 16


def test_whitening_without_variance(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(5)], schema)).collect()
    assert len(line) == 5 and line[0]["explained"] == pytest.approx(1.0)
    # Far entries: products beyond 2**53, deviations beyond 64 bits, and a second component that is flat beside the first.
    far = whitening.whiten(spark.createDataFrame([(i, [1e10 * (i % 3), float(i)]) for i in range(9)], schema)).collect()
    assert len(far) == 9 and all((r["deviation"] is None) == (r["vec_id"] % 3 != 1) for r in far) and far[0]["identity_error"] < 1e-4


@pytest.mark.parametrize("values", [[5, 5, 5, 3, 3, 2, 1, 1, 1, 0.5, 0.5], [1, 1 - 1e-9, 1 - 2e-9, 0.5, 0.4, 0.1, 0], [1] * 10, [3, 2, 0, 0, 0], [4]])
def test_spectrum_slices(values):
    q, _ = np.linalg.qr(np.random.default_rng(2).standard_normal((len(values),) * 2))
    v = q @ np.diag(values) @ q.T
    v = (v + v.T) / 2
    found, vectors = whitening.leading(v, 8)
    want = sorted((x for x in values if x), reverse=True)[:8]
    assert found == pytest.approx(want, abs=1e-12)
    assert np.abs(vectors.T @ vectors - np.eye(len(want))).max() < 1e-12 and np.abs(v @ vectors - vectors * found).max() < 1e-12
    assert whitening.above(v, -1.0) == len(values) and whitening.above(v, 10.0) == 0


def ranked_plainly(docs, items, k=10):
    def terms(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    counted = [(d, Counter(terms(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n_docs, length = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    wanted = {}
    for i, t in items:
        if i is not None:
            wanted.setdefault(i, set()).update(terms(t))
    out = []
    for i, own in wanted.items():
        scores = []
        for d, c in counted:
            m = 10 + 90 * c.total() * n_docs // length
            s = sum(int(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in own if t in c)
            if s > 0 and d is not None:
                scores.append((-s, d))
        out += [(i, r, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def search_tables():
    rng = random.Random(5)
    docs = [None, "", "...", "Déjà-vu 中文 Río", "déjà vu", *[sentence(rng, rng.choice((3, 8, 8, 8, 40))) for _ in range(120)], "sea " * 4000, "Sea7 river1"]
    docs = [*enumerate(docs), (5, docs[5]), (None, "sea7 river1 mills2")]
    items = [(1, sentence(rng, 12)), (2, "SEA sea, sea7!"), (3, None), (4, "absent"), (5, "déjà VU 中文"), (6, ""), (7, docs[20][1]), (7, "river1"), (None, "sea7")]
    return docs, items


@pytest.mark.parametrize("block", [4 << 20, 60])
def test_search_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(lexical_search, "BLOCK_BYTES", block)
    monkeypatch.setattr(lexical_search, "PIECE", 20)
    monkeypatch.setattr(lexical_search, "TASK", 100)
    docs, items = search_tables()
    df = spark.createDataFrame([(d, t, "own") for d, t in docs], "doc_id long, text string, score string").repartition(4)
    out = lexical_search.search(df, spark.createDataFrame(items, "item_id long, text string"))
    assert out.columns == ["item_id", "rank", "doc_id", "score"] and dict(out.dtypes)["rank"] == "int"
    assert sorted(map(tuple, out.collect())) == ranked_plainly(docs, items)


def test_search_of_empty_tables(spark):
    docs, items = search_tables()
    no_docs, no_items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame(docs, "doc_id long, text string")
    assert lexical_search.search(no_docs, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    out = lexical_search.search(some, no_items)
    assert out.count() == 0 and out.columns == ["item_id", "rank", "doc_id", "score"]
    assert substring_dedup.dedup_windows(no_docs).count() == 0


def test_jaccard_of_a_task_without_words(spark):
    one, two = (spark.createDataFrame(rows, "doc_id long, text string").coalesce(1) for rows in ([(1, None), (4, " ")], [(2, "a b c d e f"), (3, "A b c d e f"), (3, "a b c d e f")]))
    for docs, want in ((one, [(1, 0, 1), (4, 0, 4)]), (one.union(two), [(1, 0, 1), (2, 2, 2), (3, 2, 2), (3, 2, 2), (4, 0, 4)])):
        assert sorted(map(tuple, jaccard_join.components_of(docs).collect())) == want


def front_rows(spark, fronts):
    """Rows of 100 columns with these fronts, none of them frequent."""
    rows = [(rep, 100, front, 0, 0, front[-1]) for rep, front in enumerate(fronts)]
    return spark.createDataFrame(rows, "rep long, n long, front array<long>, n_wide int, last_rank long, last long")


def test_jaccard_candidates_share_enough_of_their_fronts(spark):
    # Two sets of 100 that link share 89 columns, at most 79 of them behind the fronts: 10 at least within.
    fronts = [list(range(1000 * k, 1000 * k + 21)) for k in range(4)]
    fronts[1][:9] = fronts[0][:9]
    fronts[3][:10] = fronts[2][:10]
    edges = jaccard_join.candidate_edges(front_rows(spark, fronts), 84)
    assert [tuple(e) for e in edges.collect()] == [(2, 3)]


def test_jaccard_candidates_of_a_shared_column_stay_connected(spark):
    # All rows share their last column; the first two also one that alone would not make them a pair.
    fronts = [[*range(1000 * k, 1000 * k + 20), 10**6] for k in range(jaccard_join.HEAVY + 6)]
    fronts[0][15] = fronts[1][15] = 10**5
    edges = jaccard_join.candidate_edges(front_rows(spark, fronts), 21 * len(fronts))
    assert sorted(map(tuple, edges.collect())) == [(0, k) for k in range(1, len(fronts))]


@pytest.mark.parametrize("text", ["ab:" * 200_000, "f=ab=" * 100_000 + "(", "key=" + "a1:" * 100_000])
def test_secrets_of_long_runs(text):
    import time

    began = time.time()
    secret_scan.scan(text)
    assert time.time() - began < 10


NASTY = ["SIZE", "__offset", "__place", "__tie", "N_Tokens", "HOST", "wrapper", "__layout", "Score", "__r_words", "__q_words", "__found", "aside0", "TEXT", "slot "]


def with_nasty(df):
    """``df`` with columns named like those that operators make or work with, in other cases too."""
    return df.select("*", *(F.lit(i).alias(n) for i, n in enumerate(NASTY)))


def operators():
    from hexagrove.llm import html_wrapper, quality_rules, rule_ensemble, sharding, token_counts
    from hexagrove.llm.queries import vocabulary

    model = rule_ensemble.RuleEnsemble
    return {
        "shard": (lambda df: sharding.shard(df, 4), {"SIZE"}),
        "count_tokens": (lambda df: token_counts.count_tokens(df, vocabulary("piece_bpe_32k.model")), {"N_Tokens"}),
        "scan_secrets": (secret_scan.scan_secrets, set()),
        "score_quality": (quality_rules.score_quality, {"__q_words"}),
        "dedup_windows": (substring_dedup.dedup_windows, set()),
        "extract": (lambda df: html_wrapper.extract(df.withColumnRenamed("doc_id", "page_id").withColumn("url", F.lit("http://a.example/x")).withColumn("html", F.concat(F.lit("<p>"), F.col("plain"), F.lit("</p>")))), set()),
        "score": (lambda df: rule_ensemble.score(df, fitted(df, model)), {"Score"}),
    }


def fitted(df, model):
    from hexagrove.llm import rule_ensemble

    docs = df.select("doc_id", F.col("plain").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    return rule_ensemble.fit(docs, labels, trees=2, depth=2)


@pytest.mark.parametrize("name", ["shard", "count_tokens", "scan_secrets", "score_quality", "dedup_windows", "extract", "score"])
def test_columns_with_clashing_names_pass(spark, name):
    rows = [(i, t, t or "") for i, t in enumerate(["a b", None, "c " * 30, "d\ne", "key = q8Zr51TxPw0LmN", "f", "g", "h"])]
    df = with_nasty(spark.createDataFrame(rows, "doc_id long, text string, plain string"))
    run, replaced = operators()[name]
    if name == "extract":
        df, replaced = df.drop("text"), replaced | {"TEXT"}
    out = run(df)
    own = {c.lower() for c in out.columns} - {n.lower() for n in NASTY}
    got = out.toDF(*(f"{c}|{i}" for i, c in enumerate(out.columns))).collect()
    assert len(got) == 8 and own
    for i, n in enumerate(NASTY):
        values = [{r[k] for r in got} for k, c in enumerate(out.columns) if c == n]
        if n not in replaced:
            assert values == [{i}], (n, out.columns)
