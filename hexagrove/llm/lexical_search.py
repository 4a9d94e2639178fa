"""Ranked lexical search over a length-stratified index.

A document's normaliser m grows with its length in whole steps, so that documents fall into strata of equal m. An index
row is a piece of a stratum: its documents, and for each term its documents by falling number of occurrences (tf). Within
a stratum the impact of a term depends on tf alone: it is computed once for each (term, tf). The largest impacts of an
item's terms add up to a bound of the stratum for that item; strata are visited by falling bounds until the bound
is below the k-th best score. A first round visits the best stratum of each task, which gives each item a score that k
documents reach; the second round visits what can reach it. Both rounds compare whole strata, so the result is exact.

Items are searched in blocks whose terms have at most ``BLOCK_BYTES``; a block's terms, weights and items are what tasks
get by broadcast, and all that the driver holds besides two totals. Documents send only the places and counts
of these terms, never texts. Strata are dealt by ranges of (m, id), so that a stratum of any size is split.

Cases: a null or empty text has no term and is no document of the statistics. Rows with one id are documents
each, ranked side by side. A row without id counts in the statistics and is never returned. Rows of items with one id
are one item with the terms of all; a row without id, or without terms that any document holds, gives no rows. An empty table
gives an empty result. Other columns of either table are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hexagrove.llm.common import Tables, ascii_lower, text_or_empty

#: Bytes of the terms of a block of items; an item with more is a block of its own.
BLOCK_BYTES = 4 << 20
#: Postings of a piece of a stratum, postings of a task.
PIECE, TASK = 400_000, 2_000_000
#: Terms of one item up to which sums of impacts stay below 2**53.
EXACT = 100_000

#: Bytes of ASCII that end a term, as white space; A-Z in lower case; the rest unchanged.
TABLE = bytes((b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32) for b in range(256))
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

COUNTS = "doc long, n long, terms array<int>, tfs array<int>"
INDEX = "m long, docs array<long>, terms array<int>, tfs array<int>, ends array<int>, places array<int>"
FOUND = "item int, doc long, score long"


def count_terms(terms) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: i for i, t in enumerate(terms.value)}
        size = len(place)
        for batch in batches:
            n, keys = [], []
            for row, text in enumerate(batch.column("text")):
                words = (text.as_py() or "").encode().translate(TABLE).split()
                n.append(len(words))
                own = np.fromiter((x for x in map(place.get, words) if x is not None), np.int64)
                keys.append(own + row * size)
            key, tf = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, np.int64),) * 2
            ends = np.searchsorted(key, np.arange(len(n) + 1) * size).astype(np.int32)
            lists = (pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (key % max(1, size), tf))
            out = pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(n, pa.int64()), *lists], names=["doc", "n", "terms", "tfs"])
            yield out.filter(pc.greater(out.column("n"), 0))

    return run


def stratum(m: int, docs: list, terms: list, tfs: list) -> tuple:
    """One index row: runs of (term, tf), tf falling, with the places of their documents."""
    place = np.repeat(np.arange(len(docs)), [len(t) for t in terms])
    term, tf = np.concatenate(terms), np.concatenate(tfs)
    order = np.lexsort((place, -tf, term))
    term, tf, place = term[order], tf[order], place[order]
    last = np.flatnonzero(np.r_[(np.diff(term) != 0) | (np.diff(tf) != 0), True]) if len(term) else np.zeros(0, int)
    return m, docs, term[last], tf[last], last + 1, place


def build_strata(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index rows of documents that come sorted by m."""
    types = [pa.int64(), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 4]

    def row(*held) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(stratum(*held), types)], names=["m", "docs", "terms", "tfs", "ends", "places"])

    at, docs, terms, tfs, postings = None, [], [], [], 0
    for batch in batches:
        flat = [batch.column(c).flatten().to_numpy() for c in ("terms", "tfs")]
        ends = np.cumsum(np.array(pc.list_value_length(batch.column("terms")), np.int64))
        starts = np.concatenate(([0], ends[:-1]))
        for m, doc, a, b in zip(batch.column("m").to_pylist(), batch.column("doc").to_pylist(), starts, ends):
            if docs and (m != at or postings + b - a > PIECE):
                yield row(at, docs, terms, tfs)
                docs, terms, tfs, postings = [], [], [], 0
            at, postings = m, postings + b - a
            docs.append(doc)
            terms.append(flat[0][a:b])
            tfs.append(flat[1][a:b])
    if docs:
        yield row(at, docs, terms, tfs)


class Stratum:
    """A piece of a stratum with the impacts of its postings."""

    def __init__(self, row: dict, weights: np.ndarray):
        self.docs, self.places = (np.asarray(row[c]) for c in ("docs", "places"))
        runs, tfs, ends = (np.asarray(row[c]).astype(np.int64) for c in ("terms", "tfs", "ends"))
        impacts = weights[runs] * (1_000_000_000 * tfs // (1000 * tfs + 8 * row["m"]))
        self.impacts = np.repeat(impacts, np.diff(ends, prepend=0))
        head = np.flatnonzero(np.diff(runs, prepend=-1))
        self.terms, self.most = runs[head], impacts[head]
        self.starts = np.concatenate(([0], ends))[head]
        self.ends = np.concatenate((self.starts[1:], ends[-1:]))

    def scores(self, terms: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.terms, terms)
        hit = at[at < len(self.terms)]
        hit = hit[self.terms[hit] == terms[: len(hit)]]
        spans = list(zip(self.starts[hit].tolist(), self.ends[hit].tolist()))
        if not spans:
            return np.zeros(len(self.docs), np.int64)
        places = np.concatenate([self.places[a:b] for a, b in spans])
        impacts = np.concatenate([self.impacts[a:b] for a, b in spans])
        if len(spans) <= EXACT:
            return np.bincount(places, weights=impacts, minlength=len(self.docs)).astype(np.int64)
        out = np.zeros(len(self.docs), np.int64)
        np.add.at(out, places, impacts)
        return out


def visit(shared, k: int, floors: list[int] | None):
    """The best documents of each item in a task's strata. Without floors, only one stratum for each item and batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, edges, weights = shared.value
        n_items = len(edges) - 1
        floor = np.ones(n_items, np.int64) if floors is None else np.maximum(1, np.array(floors, np.int64))
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            names = batch.schema.names
            strata = [Stratum({c: batch.column(c)[i].as_py() if c == "m" else batch.column(c)[i].values.to_numpy() for c in names}, weights) for i in range(batch.num_rows)]
            bounds = np.zeros((len(strata), n_items), np.int64)
            most = np.zeros(len(weights) + 1, np.int64)
            for s, x in enumerate(strata):
                most[x.terms] = x.most
                # A place behind the last term keeps an item without terms in bounds.
                bounds[s] = np.where(np.diff(edges) > 0, np.add.reduceat(most[np.append(flat, len(weights))], edges[:-1]), 0)
                most[x.terms] = 0
            for i in range(n_items):
                order = np.argsort(-bounds[:, i], kind="stable")
                for s in order[:1] if floors is None else order:
                    if bounds[s, i] < floor[i]:
                        break
                    x = strata[s]
                    score = x.scores(flat[edges[i] : edges[i + 1]])
                    at = np.flatnonzero(score >= floor[i])
                    docs, scores = best.get(i, (np.zeros(0, np.int64),) * 2)
                    docs, scores = np.concatenate((docs, x.docs[at])), np.concatenate((scores, score[at]))
                    top = np.lexsort((docs, -scores))[:k]
                    best[i] = docs[top], scores[top]
                    if len(top) == k:
                        floor[i] = max(floor[i], scores[top[-1]])
        for i, (docs, scores) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(docs), i), pa.int32()), pa.array(docs, pa.int64()), pa.array(scores, pa.int64())], names=["item", "doc", "score"])

    return run


def ranked(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("item").orderBy(F.desc("score"), "doc")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def build_index(tables: Tables, name: str, docs: DataFrame, terms) -> tuple[DataFrame, int, int, dict[int, int]]:
    """The index of (doc, text) over the broadcast ``terms``; N, L, and the number of documents of each term."""
    counts = tables.write(f"counts{name}", docs.mapInArrow(count_terms(terms), COUNTS))
    n_docs, length, postings = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    holding = dict(counts.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
    wide = F.expr(f"10 + (cast(90 as decimal(3,0)) * cast(n as decimal(15,0)) * cast({n_docs} as decimal(18,0))) div {max(1, length)}")
    placed = counts.where(F.col("doc").isNotNull() & (F.size("terms") > 0)).select(wide.cast("long").alias("m"), "doc", "terms", "tfs")
    dealt = placed.repartitionByRange(max(1, -(-postings // TASK)), "m", "doc").sortWithinPartitions("m", "doc")
    return tables.write(f"index{name}", dealt.mapInArrow(build_strata, INDEX)), n_docs, length, holding


def search(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The ``k`` best documents of each item as rows (item, rank, key, score)."""
    spark = docs.sparkSession
    tables = Tables(spark)
    docs = docs.select(F.col(f"`{key}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text"))
    found_terms = F.filter(F.split(ascii_lower(text_or_empty(f"`{item_text}`")), BETWEEN, -1), lambda t: t != "")
    own = items.where(F.col(f"`{item}`").isNotNull()).select(F.col(f"`{item}`").alias("id"), F.explode(found_terms).alias("term")).distinct()
    own = tables.write("items", own.groupBy("id").agg(F.collect_list("term").alias("terms")))
    size = F.aggregate("terms", F.lit(0).cast("long"), lambda a, t: a + F.octet_length(t))
    n_blocks = max(1, -(-(own.agg(F.sum(size)).first()[0] or 0) // BLOCK_BYTES))
    parts = []
    for block in range(n_blocks):
        rows = own.where(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == block).collect()
        if not rows:
            continue
        vocabulary = sorted({t for r in rows for t in r["terms"]})
        place = {t: i for i, t in enumerate(vocabulary)}
        index, n_docs, length, holding = build_index(tables, str(block), docs, spark.sparkContext.broadcast([t.encode() for t in vocabulary]))
        held = np.array([holding.get(i, 0) for i in range(len(vocabulary))], np.float64)
        weights = np.floor(1000 * np.log((2.0 * n_docs + 2) / (2 * held + 1))).astype(np.int64)
        flat = [np.sort([place[t] for t in r["terms"]]) for r in rows]
        edges = np.concatenate(([0], np.cumsum([len(f) for f in flat])))
        shared = spark.sparkContext.broadcast((np.concatenate(flat).astype(np.int64), edges, weights))
        # Each item's floor is a score that k documents reach.
        first = ranked(index.mapInArrow(visit(shared, k, None), FOUND), k).where(F.col("rank") == k)
        floors = dict(first.select("item", "score").collect())
        tables.drop(f"counts{block}")
        found = index.mapInArrow(visit(shared, k, [floors.get(i, 1) for i in range(len(rows))]), FOUND)
        ids = spark.createDataFrame([(i, r["id"]) for i, r in enumerate(rows)], f"item int, id {own.schema['id'].dataType.simpleString()}")
        parts.append(tables.write(f"found{block}", ranked(found, k)).join(ids, "item"))
        tables.drop(f"index{block}")
    if not parts:
        parts = [spark.createDataFrame([], f"{FOUND}, rank int").join(own.select("id"), F.lit(False))]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.select(F.col("id").alias(item), F.col("rank").cast("int").alias("rank"), F.col("doc").alias(key), "score")
