"""Benchmark decontamination with SimHash windows.

A window of a document is as many words as an item has (the whole document if that is shorter). It is laid at
every start at which it could reach the similarity: at ``percent`` of weighted shingle similarity, window and
item share at least ``percent * (sum of both numbers of shingles) / (100 + percent)`` shingles, so the window
must cover that many places whose shingle the item has. This bound loses no window. Windows and
items get a 64-bit SimHash over their words. The 64 bits fall into ``radius + 1`` blocks: two fingerprints
within the radius agree in a block, so joining windows and the items they were laid for on block number
and value finds all of them. Candidates within the radius are verified by exact weighted similarity of
the shingle multisets (each shingle weighs as often as it occurs): overlap over union of at least
``percent``. With ``radius=None`` every window is verified, without the fingerprints.

All steps are DataFrame expressions, no Python on the data. The benchmark's shingles are broadcast when a
count shows them few, else both sides are shuffled. Text is read twice: for shared shingles in
all documents, then for windows in those documents that have any.

Cases: null texts and items without words never match; an item with fewer words than a shingle has is one
shingle, and texts get windows of its length with one shingle each, so it is found wherever it stands whole
(one more reading of the texts for each such length); a document shorter than an item is one window; rows without ``doc_id`` or ``item_id`` are not reported; repeated rows give one
result row; ties of the best window go to the first one; empty tables give an empty result; other columns
are not read, and ``drop_leaks`` passes them through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexagrove.llm.common import ascii_lower, settle, small_side, spare_name, text_or_empty, words_of


#: Every pair of 100,000 simulated near copies at the least similarity lay within it (README).
RADIUS = 22


def shingles_of(words: str, size: int) -> Column:
    """Hashes of the shingles of an array column of words, in place order."""
    whole = f"array(xxhash64(concat_ws(' ', {words})))"
    # Element by element: a slice inside the lambda would copy the whole array for each shingle.
    parts = ", ".join(f"{words}[i + {k}]" for k in range(size))
    every = f"transform(sequence(0, size({words}) - {size}), i -> xxhash64({parts}))"
    return F.expr(f"CASE WHEN size({words}) = 0 THEN cast(array() AS array<bigint>) WHEN size({words}) < {size} THEN {whole} ELSE {every} END")


def simhash(words: str) -> Column:
    """64-bit SimHash of an array column of words; a word counts as often as it occurs."""
    # The lambda over one array binds the hashes: each word is hashed once, not once a bit.
    bits = "transform(sequence(0, 63), b -> aggregate(hashes, 0, (n, h) -> n + 2 * int(shiftrightunsigned(h, b) & 1) - 1))"
    packed = f"aggregate(transform({bits}, (n, b) -> if(n > 0, shiftleft(1L, b), 0L)), 0L, (x, y) -> x | y)"
    return F.expr(f"transform(array(transform({words}, w -> xxhash64(w))), hashes -> {packed})[0]")


def bag_of(shingles: str) -> Column:
    """A multiset of hashes as a set: the second and later copies of a hash are hashed with their number."""
    numbered = "transform(s, (h, i) -> if(i + 1 = array_position(s, h), h, xxhash64(h, i + 1 - array_position(s, h))))"
    return F.expr(f"CASE WHEN size(array_distinct({shingles})) = size({shingles}) THEN {shingles} ELSE transform(array(array_sort({shingles})), s -> {numbered})[0] END")


def blocks(fingerprint: str, radius: int) -> Column:
    """(number, value) of the ``radius + 1`` blocks of a fingerprint."""
    cuts = [64 * k // (radius + 1) for k in range(radius + 2)]
    return F.array(*(F.struct(F.lit(k).alias("no"), F.expr(f"shiftrightunsigned({fingerprint}, {a}) & {(1 << (b - a)) - 1}L").alias("value")) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))))


def laid() -> Column:
    """The starts at which a window covers enough of the places ``hits`` (sorted) of the item's shingles."""
    covered = "transform(sequence(0, size(hits) - need), k -> if(hits[k + need - 1] - hits[k] < in_window, sequence(greatest(0, hits[k + need - 1] - in_window + 1), least(hits[k], n_doc - w)), array()))"
    return F.expr(f"CASE WHEN size(hits) >= need THEN array_distinct(flatten({covered})) ELSE cast(array() AS array<int>) END")


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item_key: str = "item_id", text: str = "text", item_text: str = "text", size: int = 5, percent: int = 80, radius: int | None = RADIUS, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Rows doc_id, item_id, start (in words), n_words, hamming, similarity: the best window of each pair."""
    texts = docs.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").cast("long").alias("doc_id"), text_or_empty(f"`{text}`").alias("text"))
    words = words_of(ascii_lower(F.col("text"))).alias("words")
    read = texts.select("doc_id", words)
    items = benchmark.where(F.col(f"`{item_key}`").isNotNull()).select(F.col(f"`{item_key}`").cast("long").alias("item_id"), words_of(ascii_lower(text_or_empty(f"`{item_text}`"))).alias("words"))
    items = items.where("size(words) > 0").dropDuplicates().withColumn("shingles", shingles_of("words", size))
    items = settle(items.select("item_id", F.size("words").alias("n_words"), "shingles", simhash("words").alias("item_print"), bag_of("shingles").alias("bag")))
    places = settle(items.select(F.explode("shingles").alias("h"), "item_id", "n_words", F.size("shingles").alias("in_item")).distinct())
    n_places = places.count()
    at = read.select("doc_id", F.size("words").alias("n_doc"), F.posexplode(shingles_of("words", size)).alias("at", "h"))
    for n in sorted(r["n_words"] for r in items.where(F.col("n_words") < size).select("n_words").distinct().collect()):
        short = F.expr(f"transform(sequence(0, size(words) - {n}), i -> xxhash64(concat_ws(' ', slice(words, i + 1, {n}))))")
        at = at.unionByName(read.where(F.size("words") >= n).select("doc_id", F.size("words").alias("n_doc"), F.posexplode(short).alias("at", "h")))
    pairs = at.join(small_side(places, n_places, broadcast_rows), "h").groupBy("doc_id", "n_doc", "item_id", "n_words", "in_item").agg(F.array_sort(F.collect_set("at")).alias("hits"))
    pairs = pairs.withColumn("w", F.least("n_words", "n_doc")).withColumn("in_window", F.greatest(F.lit(1), F.col("w") - (size - 1)))
    pairs = pairs.withColumn("need", F.ceil(percent * (F.col("in_item") + F.col("in_window")) / (100 + percent)).cast("int"))
    pairs = settle(pairs.select("doc_id", "item_id", "n_words", "w", laid().alias("starts")).where("size(starts) > 0"))
    n_starts = pairs.agg(F.coalesce(F.sum(F.size("starts") + 4), F.lit(0))).first()[0]
    wanted = F.flatten(F.collect_list(F.expr("transform(starts, s -> struct(item_id, n_words, w, s AS start))")))
    windows = texts.join(small_side(pairs.groupBy("doc_id").agg(wanted.alias("wanted")), n_starts, broadcast_rows), "doc_id").select("doc_id", words, "wanted")
    windows = windows.select("doc_id", "words", F.explode("wanted").alias("p")).select("doc_id", "p.item_id", "p.n_words", "p.start", F.expr("slice(words, p.start + 1, p.w)").alias("words")).where("size(words) > 0")
    windows = windows.withColumn("print", simhash("words")).withColumn("shingles", shingles_of("words", size)).drop("words")
    on = ["item_id", "n_words"]
    right = items.select(*on, "item_print", "bag")
    if radius is not None:
        windows, right, on = windows.withColumn("b", F.explode(blocks("print", radius))), right.withColumn("b", F.explode(blocks("item_print", radius))), [*on, "b"]
    near = windows.join(small_side(right, n_places * (64 if radius is None else radius + 1), 16 * broadcast_rows), on).withColumn("hamming", F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))))
    if radius is not None:
        # A pair that agrees in several blocks is verified once, in the first of them.
        agrees = F.expr("print ^ item_print")
        first = F.least(*(F.when((agrees.bitwiseAND(F.lit(mask))) == 0, F.lit(k)) for k, mask in enumerate(_masks(radius))))
        near = near.where((F.col("hamming") <= radius) & (F.col("b.no") == first))
    near = near.withColumn("mine", bag_of("shingles"))
    near = near.withColumn("both", F.size(F.array_intersect("mine", "bag"))).withColumn("union", F.size("mine") + F.size("bag") - F.col("both"))
    hits = near.where(100 * F.col("both") >= percent * F.col("union"))
    best = hits.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("both") / F.col("union")).alias("similarity"), (-F.col("start")).alias("back"), "n_words", "hamming")).alias("m"))
    return best.select("doc_id", "item_id", (-F.col("m.back")).cast("long").alias("start"), F.col("m.n_words").cast("long").alias("n_words"), F.col("m.hamming").cast("long").alias("hamming"), "m.similarity")


def _masks(radius: int) -> list[int]:
    """The bit mask of each block as a signed 64-bit number."""
    cuts = [64 * k // (radius + 1) for k in range(radius + 2)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def drop_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", broadcast_rows: int = 1_000_000, **options) -> DataFrame:
    """``docs`` without the documents in which an item was found."""
    gone = spare_name("gone", docs.columns)
    leaks = settle(find_leaks(docs, benchmark, key, broadcast_rows=broadcast_rows, **options).select(F.col("doc_id").alias(gone)).distinct())
    return docs.join(small_side(leaks, leaks.count(), broadcast_rows), F.col(f"`{key}`").cast("long") == F.col(gone), "left_anti")
