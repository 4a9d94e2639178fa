"""N-gram Jaccard join as a blocked sparse matrix product.

The matrix has a row for each distinct set of word shingles and a column for each shingle. Rows that
could reach the threshold are gathered first, by bounds that follow from the sizes alone: ordered by one
global order of columns, rarer first, two sets of similarity t or more share a column among the first
``n - ceil(t n) + 1`` of each, their sizes differ by the factor t at most, and the shared columns
seen so far plus all that can follow must reach the overlap that the sizes ask for, so must all those shared by
the fronts plus what follows the front that ends first. Rows that survive
for each other form clusters; a cluster's rows are multiplied in blocks: each task holds the
incidence of two blocks, accumulates overlap counts over slices of columns and keeps the pairs that
reach the threshold, as a spanning set of links. Exact: no row, column or partner is capped.

A cluster of one block is one product. In a larger one each block is first multiplied with itself and
with a few pivot rows of the cluster; a row that links with a pivot lies in that pivot's ball. One minus the
similarity is a metric, so a row can link with one of the ball only if its distance to the pivot is at most
twice the bound: only such rows visit the ball, and only if not yet connected with it. Rows in no ball meet each other in
blocks. A group of near copies thus costs its size, not its square.

Entries of the rows' fronts are dealt to buckets of columns, packed by bytes, and a task finds the pairs of a bucket.
Columns that many rows have near their front (groups of near copies, shared passages) are never joined pair
by pair: their rows enter a cluster through one row and meet in blocks only. Equal sets are one row.
The order of columns comes from exact counts over all shingles of all documents; those of frequent
columns (a number with a fixed bound) are sent to all tasks, the others come first, by their hash.

Cases: null and empty texts and texts without words have the empty set and link with nothing; with
fewer words than a shingle has, the whole sequence is the one shingle; a null id gets a null
component and no links; rows with one id count as linked; an empty table gives an empty result; other
columns are not read. Shingles are 64-bit hashes, equal sets are told by 128 bits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexagrove.llm.common import Tables, small_side, spare_name, text_or_empty
from hexagrove.llm.components import connected

SIZE = 5
PERCENT = 80
#: So many columns at most are sent to all tasks with their counts.
FREQUENT = 2_000_000
#: A column with more rows than this near their fronts is not joined pair by pair.
HEAVY = 24
#: A column that more documents than this hold anywhere never meets in one task.
WIDE = 10_000
#: Bounds of what counts as frequent; the first that leaves at most ``FREQUENT`` columns holds.
LEAST = [HEAVY << k for k in range(40)]
#: Rows, and shingles of these rows, in a block of the product; cells of an incidence slice.
BLOCK, BLOCK_SHINGLES, CELLS = 512, 1_000_000, 8_000_000
#: Rows of a large cluster that all its other rows are compared with first.
PIVOTS = 24
TASKS = "array<struct<kind: bigint, x: bigint, y: bigint, z: bigint, side: int>>"
#: Bytes of text, and hashes of a text, that are turned into Python objects or summed up at once.
PIECE, STEP = 500_000, 1_000_000
WHITE = re.compile(rb"[\x20\x09-\x0D]")


def mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def pieces(text: bytes, most: int = PIECE) -> Iterator[bytes]:
    """A text cut at white space into parts of about ``most`` bytes; a longer word stays whole."""
    at = 0
    while len(text) - at > most and (cut := WHITE.search(text, at + most)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def word_hashes(texts: list[bytes], most: int = PIECE) -> tuple[np.ndarray, list[int]]:
    """The hashes of all words, A-Z lower-cased, and each text's number of words. So few words at a
    time are Python objects that a text of any length needs eight bytes for a word."""
    hashes, counts, held, size = [np.empty(0, np.uint64)], [], [], 0

    def flush() -> None:
        flat = np.empty(len(held), dtype=object)
        flat[:] = held
        if held:
            hashes.append(pd.util.hash_array(flat, categorize=False))
        held.clear()

    for text in texts:
        n = 0
        for piece in pieces(text, most):
            words = piece.lower().split()
            held += words
            n, size = n + len(words), size + len(piece)
            if size >= most:
                flush()
                size = 0
        counts.append(n)
    flush()
    return np.concatenate(hashes), counts


def shingle_sets(texts: list[str] | list[bytes], size: int = SIZE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; A-Z lower-cased, words split at ASCII white space."""
    hashes, counts = word_hashes([t.encode("utf-8", "replace") if isinstance(t, str) else t for t in texts])
    powers = [np.uint64((2 * k + 1) * 0x9E3779B97F4A7C15 % 2**64 | 1) for k in range(size)]
    rolled = np.empty(max(0, len(hashes) - size + 1), np.uint64)
    for low in range(0, len(rolled), STEP):
        n = min(STEP, len(rolled) - low)
        rolled[low : low + n] = mixed(sum((mixed(hashes[low + k : low + k + n] * powers[k]) for k in range(size)), np.zeros(n, np.uint64)))
    out, at = [], 0
    for n in counts:
        if n >= size:
            out.append(np.unique(rolled[at : at + n - size + 1]))
        elif n:
            short = mixed(hashes[at : at + n] * np.array(powers[:n], np.uint64)).sum(dtype=np.uint64)
            out.append(mixed(np.array([short ^ np.uint64(n)])))
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out


def sets_of(batches: Iterator[pa.RecordBatch], most: int = 2 * PIECE) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of the batches with about ``most`` bytes of text, a longer text alone, and their sets."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary())
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
            yield batch.slice(at, stop - at), shingle_sets(texts.slice(at, stop - at).to_pylist())
            at = stop


def _packed(hashes: list[np.ndarray], bits: int) -> Iterator[pa.RecordBatch]:
    """Counted 48-bit column numbers by bucket, sorted, as byte planes: most of them compress to nothing."""
    if not hashes:
        return
    found, n = np.unique(np.concatenate(hashes) >> np.uint64(16), return_counts=True)
    if not len(found):
        return  # no text with a word
    cuts = np.searchsorted(found, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(48 - bits))
    rows = []
    for k in np.flatnonzero(np.diff(cuts)):
        part = found[cuts[k] : cuts[k + 1]]
        rows.append((int(k), part.view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes(), np.minimum(n[cuts[k] : cuts[k + 1]], 2**31 - 1).astype(np.int32).tobytes()))
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))], names=["bucket", "planes", "counts"])


def _unpacked(planes: bytes) -> np.ndarray:
    bytes6 = np.frombuffer(planes, np.uint8).reshape(6, -1).T
    return np.ascontiguousarray(np.pad(bytes6, ((0, 0), (0, 2)))).view(np.uint64).ravel()


def _counter(bits: int, held: int = 2_000_000):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n = [], 0
        for _, found in sets_of(batches):
            kept += found
            n += sum(map(len, found))
            if n >= held:
                yield from _packed(kept, bits)
                kept, n = [], 0
        yield from _packed(kept, bits)

    return count


def _frequent(rows: pd.DataFrame) -> pd.DataFrame:
    """The bucket's columns that more than ``HEAVY`` documents have, and how many are above each of ``LEAST``."""
    number = np.concatenate([_unpacked(p) for p in rows["planes"]])
    n = np.concatenate([np.frombuffer(c, np.int32) for c in rows["counts"]]).astype(np.int64)
    order = np.argsort(number, kind="stable")
    number, n = number[order], n[order]
    first = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
    number, n = number[first], np.add.reduceat(n, first)
    often = n > HEAVY
    return pd.DataFrame([([int((n > t).sum()) for t in LEAST], number[often].tobytes(), n[often].tobytes())], columns=["above", "number", "n"])


def column_counts(docs: DataFrame, tables: Tables, most: int = FREQUENT, bucket_bytes: int = 20_000_000) -> tuple[np.ndarray, np.ndarray]:
    """The frequent columns' numbers, sorted, and in how many documents each is.

    All shingles of all documents are counted exactly. A column is frequent above the first of
    ``LEAST`` that at most ``most`` columns are above: the arrays have a fixed bound, checked by count.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(5, int(size // bucket_bytes).bit_length())
    parts = docs.select("text").mapInArrow(_counter(bits), "bucket long, planes binary, counts binary")
    frequent = tables.write("frequent", parts.groupBy("bucket").applyInPandas(_frequent, "above array<long>, number binary, n binary"))
    above = frequent.agg(*(F.sum(F.col("above")[k]) for k in range(len(LEAST)))).first()
    least = next((t for t, k in zip(LEAST, above) if (k or 0) <= most), 2**62)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            number, n = (np.frombuffer(b"".join(batch[c]), np.int64) for c in ("number", "n"))
            yield pd.DataFrame([(number[n > least].tobytes(), n[n > least].tobytes())], columns=["number", "n"])

    rows = frequent.select("number", "n").mapInPandas(cut, "number binary, n binary").collect()
    tables.drop("frequent")
    number, n = (np.frombuffer(b"".join(row[k] for row in rows), t) for k, t in ((0, np.uint64), (1, np.int64)))
    order = np.argsort(number)
    return number[order], n[order]


def ranks_of(columns: np.ndarray, number: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How many documents have each column, 0 for those that are not frequent."""
    if not len(number):
        return np.zeros(len(columns), np.int64)
    wanted = columns >> np.uint64(16)
    at = np.minimum(np.searchsorted(number, wanted), len(number) - 1)
    return np.where(number[at] == wanted, n[at], 0)


def fronts(docs: DataFrame, counts: tuple[np.ndarray, np.ndarray], percent: int = PERCENT) -> DataFrame:
    """Per document: the set's size, its 128-bit digest, its first columns in the global order, and the place of the last of these there."""

    def front(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, sets in sets_of(batches):
            n = np.array([len(s) for s in sets], np.int64)
            d1 = np.array([mixed(s ^ np.uint64(0xA5A5)).sum(dtype=np.uint64) for s in sets], np.uint64)
            d2 = np.array([mixed(s * np.uint64(0xD1342543DE82EF95)).sum(dtype=np.uint64) for s in sets], np.uint64)
            first = np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)
            ordered, wide, last = [], np.zeros(len(sets), np.int32), np.zeros((2, len(sets)), np.int64)
            for k, s in enumerate(sets):
                rank = ranks_of(s, *counts)
                order = np.lexsort((s, rank))[: first[k]]
                ordered.append(s[order])
                wide[k] = (rank[order] > WIDE).sum()
                if len(order):
                    last[:, k] = rank[order[-1]], (s[order[-1]] ^ np.uint64(1 << 63)).view(np.int64)
            offsets = np.concatenate([[0], np.cumsum(first)]).astype(np.int32)
            front = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.uint64), *ordered]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index("doc_id")), *(pa.array(c.view(np.int64)) for c in (n, d1, d2)), front, pa.array(wide), *map(pa.array, last)], names=["doc_id", "n", "d1", "d2", "front", "n_wide", "last_rank", "last"])

    return docs.mapInArrow(front, "doc_id long, n long, d1 long, d2 long, front array<long>, n_wide int, last_rank long, last long")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many columns each two rows of a block share: incidence times its transpose, slice by slice."""
    n = np.array([len(s) for s in sets])
    columns, at = np.unique(np.concatenate(sets), return_inverse=True)
    rows = np.repeat(np.arange(len(sets)), n)
    shared = np.bincount(at, minlength=len(columns)) > 1
    new = np.cumsum(shared) - 1
    keep = shared[at]
    rows, at, width = rows[keep], new[at[keep]], int(shared.sum())
    overlap = np.zeros((len(sets), len(sets)), np.float32)
    step = max(1, CELLS // len(sets))
    order = np.argsort(at, kind="stable")
    rows, at = rows[order], at[order]
    for start in range(0, width, step):
        lo, hi = np.searchsorted(at, [start, start + step])
        incidence = np.zeros((len(sets), min(step, width - start)), np.float32)
        incidence[rows[lo:hi], at[lo:hi] - start] = 1
        overlap += incidence @ incidence.T
    np.fill_diagonal(overlap, n)
    return overlap


def reaching(overlap: np.ndarray, percent: int) -> np.ndarray:
    """Which two rows of a product have a similarity of ``percent`` or more."""
    n = overlap.diagonal().astype(np.int64)
    both = overlap.astype(np.int64)
    return 100 * both >= percent * (n[:, None] + n[None, :] - both)


def spanning(ids: np.ndarray, link: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect the same rows as all of ``link``."""
    label = np.arange(len(ids))
    while True:
        # The smallest label among a row's links, then among those labels' own.
        new_label = np.where(link, label[None, :], len(ids)).min(axis=1)
        new_label = new_label[new_label]
        if (new_label == label).all():
            break
        label = new_label
    return [(int(ids[k]), int(ids[i])) for i, k in enumerate(label) if i != k]


#: What a row (a, b) of a product says: a and b are connected, a lies in the ball of b, a may link into the ball of b.
EDGE, HOME, VISIT = 0, 1, 2


def _products(group: pd.DataFrame, percent: int = PERCENT) -> pd.DataFrame:
    """Spanning links of a task's clusters; where pivots (``side`` 1) take part, also the places of the others."""
    found: list[tuple[int, int, int]] = []
    for _, cluster in group.groupby("cluster", sort=False):
        if len(cluster) < 2 and cluster["kind"].iat[0] != 1:
            continue
        ids = cluster["rep"].to_numpy(np.int64)
        overlap = overlaps([np.frombuffer(b, np.uint64) for b in cluster["shingles"]])
        link = reaching(overlap, percent)
        found += [(a, b, EDGE) for a, b in spanning(ids, link)]
        pivots = np.flatnonzero(cluster["side"].to_numpy() == 1)
        if cluster["kind"].iat[0] != 1 or not len(pivots):
            continue
        near = reaching(overlap, max(0, 2 * percent - 100))
        for i, k in enumerate(ids):
            balls = pivots[link[i, pivots]]
            home = i if cluster["side"].iat[i] == 1 else balls[np.argmin(ids[balls])] if len(balls) else None
            if home is not None:
                found.append((int(k), int(ids[home]), HOME))
            found += [(int(k), int(ids[p]), VISIT) for p in pivots[near[i, pivots]] if p != home]
    return pd.DataFrame(found, columns=["a", "b", "code"]).astype({"a": "int64", "b": "int64", "code": "int32"})


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, sets in sets_of(batches):
        names = ["rep", "cluster", "tasks"]
        yield pa.RecordBatch.from_arrays([*(rows.column(rows.schema.get_field_index(c)) for c in names), pa.array([s.tobytes() for s in sets], pa.binary())], names=[*names, "shingles"])


def multiplied(texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The products of all tasks: ``texts`` (rep, cluster, tasks, text), a text's set made once and sent to each of its tasks."""
    sets = texts.mapInArrow(_whole_sets, f"rep long, cluster long, tasks {TASKS}, shingles binary")
    sent = sets.withColumn("t", F.explode("tasks")).select("t.*", "cluster", "rep", "shingles")
    return sent.groupBy("kind", "x", "y", "z").applyInPandas(lambda group: _products(group, percent), "a long, b long, code int")


def planes(values: np.ndarray) -> bytes:
    """Fixed-width numbers byte by byte: where they are sorted or small, most of it compresses to nothing."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()


def from_planes(parts: pd.Series, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.concatenate([np.ascontiguousarray(np.frombuffer(p, np.uint8).reshape(width, -1).T).view(kind).ravel() for p in parts])


#: What a pair has to reach that a column of many rows joins: such a pair stays whatever else it shares.
HUB = 2**30
ENTRIES = ("columns", np.uint64), ("reps", np.int64), ("n", np.int32), ("pos", np.int32)


def _entries(bits: int, held: int = 400_000):
    """Rows (rep, n, front) to their entries, packed by bucket of columns."""

    def packed(rows: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        columns, *others = (np.concatenate(c) for c in zip(*rows))
        order = np.argsort(columns, kind="stable")
        columns, others = columns[order], [c[order] for c in others]
        cuts = np.append(np.searchsorted(columns >> np.uint64(64 - bits), np.arange(1 << bits, dtype=np.uint64)), len(columns))
        out = [(int(k), *(planes(c[cuts[k] : cuts[k + 1]]) for c in (columns, *others))) for k in np.flatnonzero(np.diff(cuts))]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), *[pa.binary()] * 4))], names=["bucket", *(name for name, _ in ENTRIES)])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0
        for batch in batches:
            fronts = batch.column(batch.schema.get_field_index("front"))
            lengths = pc.list_value_length(fronts).to_numpy(zero_copy_only=False).astype(np.int64)
            columns = fronts.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            rep, n = (np.repeat(batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False), lengths) for c in ("rep", "n"))
            pos = np.arange(len(columns)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            if len(columns):
                kept.append((columns, rep.astype(np.int64), n.astype(np.int32), pos.astype(np.int32)))
                size += len(columns)
            if size >= held:
                yield packed(kept)
                kept, size = [], 0
        if kept:
            yield packed(kept)

    return pack


def _meetings(bucket: pd.DataFrame, percent: int = PERCENT) -> pd.DataFrame:
    """Pairs of rows that share columns of a bucket: in how many, and in how many they would have to at least."""
    columns, rep, n, pos = (from_planes(bucket[name], kind) for name, kind in ENTRIES)
    order = np.lexsort((rep, columns))
    columns, rep, n, pos = columns[order], rep[order], n[order].astype(np.int64), pos[order].astype(np.int64)
    first = np.flatnonzero(np.r_[True, columns[1:] != columns[:-1]])
    df = np.diff(np.r_[first, len(columns)])
    hub, shared_by = np.repeat(rep[first], df), np.repeat(df, df)
    heavy = (shared_by > HEAVY) & (hub != rep)
    found = [(hub[heavy], rep[heavy], np.full(int(heavy.sum()), HUB))]
    light = shared_by <= HEAVY
    for d in range(1, HEAVY):
        i = np.flatnonzero(light[:-d] & (columns[d:] == columns[:-d]))
        if not len(i):
            break
        i = i[100 * np.minimum(n[i], n[i + d]) >= percent * np.maximum(n[i], n[i + d])]
        need = -(-percent * (n[i] + n[i + d]) // (100 + percent))
        rest = np.minimum(n[i] - 1 - pos[i], n[i + d] - 1 - pos[i + d])
        can = 1 + np.minimum(pos[i], pos[i + d]) + rest >= need
        i = i[can]
        found.append((rep[i], rep[i + d], (need - rest)[can]))
    a, b, least = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((b, a))
    a, b, least = a[order], b[order], least[order]
    start = np.flatnonzero(np.r_[len(a) > 0, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.empty(0, np.int64)
    seen = np.diff(np.r_[start, len(a)]) if len(a) else start
    return pd.DataFrame({"a": a[start], "b": b[start], "seen": seen.astype(np.int32), "least": (np.maximum.reduceat(least, start) if len(a) else least).astype(np.int32)})


def reached(pairs: DataFrame, rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of ``pairs`` (a, b, seen, least) whose fronts share enough columns, as (a, b).

    Up to where the front that ends first in the global order ends, every shared column is in both fronts and has
    been seen, unless a column of many rows joins the pair anyhow; what follows is at most the rest of that front's row.
    """
    ends = rows.groupBy("rep").agg(F.count(F.lit(1)).alias("sets"), F.max("n").alias("n"), F.max(F.col("n") - F.size("front")).alias("rest"), F.max(F.struct("last_rank", "last")).alias("end"))
    for side in ("a", "b"):
        pairs = pairs.join(ends.select(F.col("rep").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("sets", "n", "rest", "end"))), side)
    rest = F.when(F.col("end_a") < F.col("end_b"), F.col("rest_a")).when(F.col("end_a") > F.col("end_b"), F.col("rest_b")).otherwise(F.least("rest_a", "rest_b"))
    enough = (100 + percent) * (F.col("seen") + rest) >= percent * (F.col("n_a") + F.col("n_b"))
    # Sets that share an id are not told apart here.
    return pairs.where((F.col("least") == HUB) | (F.col("sets_a") > 1) | (F.col("sets_b") > 1) | enough).select("a", "b")


def candidate_edges(rows: DataFrame, n_columns: int, percent: int = PERCENT, entries: int = 400_000, broadcast_rows: int = 500_000) -> DataFrame:
    """``rows`` (rep, n, front, n_wide, last_rank, last) to edges (a, b) whose components hold every pair that can link.

    A pair is kept if the columns seen so far reach what its sizes ask for, less all that can follow the
    last of them, and if all that were seen do, less all that can follow the front that ends first. Columns of more
    than ``WIDE`` documents (the last ``n_wide`` of a front) never meet in one task: their rows are joined with the smallest of them.
    """
    bits = max(1, int(n_columns // entries).bit_length())
    narrow = rows.select("rep", "n", F.slice("front", F.lit(1), F.size("front") - F.col("n_wide")).alias("front"))
    packed = narrow.mapInArrow(_entries(bits), "bucket long, columns binary, reps binary, n binary, pos binary")
    met = packed.groupBy("bucket").applyInPandas(lambda bucket: _meetings(bucket, percent), "a long, b long, seen int, least int")
    kept = met.groupBy("a", "b").agg(F.sum("seen").alias("seen"), F.max("least").alias("least")).where(f"seen >= least OR least = {HUB}")
    kept = reached(kept, rows, percent)
    wide = rows.where("n_wide > 0").select("rep", F.explode(F.slice("front", F.size("front") - F.col("n_wide") + 1, F.col("n_wide"))).alias("column"))
    hubs = wide.groupBy("column").agg(F.min("rep").alias("a"))
    heavy = wide.join(small_side(hubs, hubs.count(), broadcast_rows), "column").where("a < rep").select("a", F.col("rep").alias("b"))
    return kept.union(heavy)


def blocks(rows: str, shingles: str):
    return F.greatest(F.lit(1), F.ceil(F.col(rows) / BLOCK), F.ceil(F.col(shingles) / BLOCK_SHINGLES)).cast("long")


def task(kind: int, x: str, y: str, z: str, side: str) -> str:
    return f"named_struct('kind', {kind}L, 'x', {x}, 'y', {y}, 'z', {z}, 'side', {side})"


def first_tasks(members: DataFrame) -> DataFrame:
    """``members`` (rep, n, cluster) with their tasks: a small cluster is one product (several in a task); in a large one
    each block meets itself and all pivots, about ``PIVOTS`` rows picked by hash, fewer where rows are long."""
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles")).withColumn("blocks", blocks("rows", "shingles"))
    groups = max(1, -(-(members.agg(F.sum("n")).first()[0] or 0) // BLOCK_SHINGLES))
    pivots = F.greatest(F.lit(1), F.least(F.lit(PIVOTS), F.floor(F.lit(BLOCK_SHINGLES / 4) / (F.col("shingles") / F.col("rows")))))
    placed = members.join(sizes, "cluster").withColumn("is_pivot", (F.col("blocks") > 1) & (F.pmod(F.xxhash64("rep", F.lit(1)), "rows") < pivots))
    own = "pmod(xxhash64(rep), blocks)"
    tasks = f"""CASE WHEN blocks = 1 THEN array({task(0, f"pmod(xxhash64(cluster), {groups}L)", "0L", "0L", "0")})
        WHEN is_pivot THEN transform(sequence(0L, blocks - 1), k -> {task(1, "cluster", "k", "0L", "1")})
        ELSE array({task(1, "cluster", own, "0L", "0")}) END"""
    return placed.select("rep", "n", "cluster", (F.col("blocks") > 1).alias("is_large"), F.expr(tasks).alias("tasks"))


def second_tasks(large: DataFrame, homes: DataFrame, visits: DataFrame) -> DataFrame:
    """The products that the pivots leave: the rows of a ball with each of its visitors, block by block, and
    the rows in no ball with each other, those of a size class with their own and the neighbouring classes'.

    ``large`` (rep, n, cluster, cls), ``homes`` (rep, pivot), ``visits`` (rep, pivot).
    """
    inside = large.join(homes, "rep").join(visits.select("pivot").distinct(), "pivot")
    outside = visits.join(large, "rep")

    def numbered(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("pivot").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles")).select("pivot", blocks("rows", "shingles").alias(name))

    counts = numbered(inside, "insides").join(numbered(outside, "outsides"), "pivot")
    balls = inside.join(counts, "pivot").select("rep", "cluster", F.expr(f"transform(sequence(0L, outsides - 1), k -> {task(2, 'pivot', 'pmod(xxhash64(rep), insides)', 'k', '0')})").alias("tasks"))
    guests = outside.join(counts, "pivot").select("rep", "cluster", F.expr(f"transform(sequence(0L, insides - 1), k -> {task(2, 'pivot', 'k', 'pmod(xxhash64(rep), outsides)', '0')})").alias("tasks"))

    free = large.join(homes, "rep", "left_anti")
    # Those of a cluster that fit in one block need no classes.
    whole = free.groupBy("cluster").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles")).where("rows > 1").select("cluster", (blocks("rows", "shingles") == 1).alias("is_one"))
    free = free.join(whole, "cluster").withColumn("cls", F.when(F.col("is_one"), F.lit(0)).otherwise(F.col("cls")).cast("long"))
    per_class = free.groupBy("cluster", "cls").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles")).select("cluster", "cls", blocks("rows", "shingles").alias("blocks"))
    following = per_class.select("cluster", (F.col("cls") - 1).alias("cls"), F.col("blocks").alias("next_blocks"))
    previous = per_class.select("cluster", (F.col("cls") + 1).alias("cls"), F.col("blocks").alias("previous_blocks"))
    free = free.join(per_class, ["cluster", "cls"]).join(following, ["cluster", "cls"], "left").join(previous, ["cluster", "cls"], "left").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks"))
    # The kind tells a class's own products and those with the next class apart; the task holds one cluster.
    tasks = f"""concat(transform(sequence(0L, blocks - 1), k -> {task(3, "xxhash64(cluster, cls)", "least(k, block)", "greatest(k, block)", "0")}),
        CASE WHEN next_blocks > 0 THEN transform(sequence(0L, next_blocks - 1), k -> {task(4, "xxhash64(cluster, cls)", "block", "k", "0")}) ELSE array() END,
        CASE WHEN previous_blocks > 0 THEN transform(sequence(0L, previous_blocks - 1), k -> {task(4, "xxhash64(cluster, cls - 1)", "k", "block", "0")}) ELSE array() END)"""
    every = balls.union(guests).union(free.select("rep", "cluster", F.expr(tasks).alias("tasks")))
    return every.select("rep", "cluster", F.explode("tasks").alias("t")).groupBy("rep", "cluster").agg(F.collect_list("t").alias("tasks"))


def components_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles and component_id, the smallest id that its links reach."""
    tables = Tables(docs.sparkSession)
    read = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), text_or_empty(f"`{text}`").alias("text"))
    every = tables.write("every", fronts(read, column_counts(read, tables)))
    heads = tables.write("heads", every.select("doc_id", "n", "d1", "d2"))
    reps = tables.write("reps", heads.where("n > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep")))
    rows = every.where("n > 0").select(F.col("doc_id").alias("rep"), "n", "d1", "d2", "front", "n_wide", "last_rank", "last").join(reps, ["rep", "n", "d1", "d2"])
    n_columns = every.agg(F.coalesce(F.sum(F.size("front")), F.lit(0))).first()[0]
    candidates = tables.write("candidates", candidate_edges(rows.dropDuplicates(["rep", "n", "d1", "d2"]).select("rep", "n", "front", "n_wide", "last_rank", "last"), n_columns))
    tables.drop("every")
    clusters = tables.write("clusters", connected(candidates))
    tables.drop("candidates")
    # Size classes: sets that link are in the same or in neighbouring ones.
    cls = F.floor(F.log("n") / F.log(F.lit(100 / PERCENT)) + 1e-9).cast("long")
    members = tables.write("members", reps.select(F.col("rep").alias("node"), "n").join(clusters, "node").select(F.col("node").alias("rep"), "n", F.col("component").alias("cluster")))
    tables.drop("clusters")
    texts = read.withColumnRenamed("doc_id", "rep")

    def with_texts(placed: DataFrame) -> DataFrame:
        # A row holds its tasks, which no number of rows bounds: count these.
        held = placed.agg(F.coalesce(F.sum(F.size("tasks") + 4), F.lit(0))).first()[0]
        return texts.join(small_side(placed, held, 1_000_000), "rep")

    placed = tables.write("placed", first_tasks(members))
    first = tables.write("first", multiplied(with_texts(placed.select("rep", "cluster", "tasks"))))
    large = placed.where("is_large").select("rep", "n", "cluster", cls.alias("cls"))
    links = first.where(F.col("code") != VISIT).select("a", "b")
    homes = first.where(F.col("code") == HOME).select(F.col("a").alias("rep"), F.col("b").alias("pivot")).distinct()
    visits = first.where(F.col("code") == VISIT).select(F.col("a").alias("rep"), F.col("b").alias("pivot")).distinct()
    # Visitors that are connected with the ball have nothing to look for in it.
    near = tables.write("near", connected(links.join(large.select(F.col("rep").alias("a")), "a", "left_semi")))
    left = visits.join(near.select(F.col("node").alias("rep"), F.col("component").alias("c1")), "rep", "left").join(near.select(F.col("node").alias("pivot"), F.col("component").alias("c2")), "pivot", "left")
    visits = left.where("coalesce(c1, rep) <> coalesce(c2, pivot)").select("rep", "pivot")
    rest = tables.write("rest", second_tasks(large, homes, tables.write("visits", visits)))
    second = multiplied(with_texts(rest))
    found = tables.write("found", connected(links.union(second.select("a", "b"))))
    tables.drop("members", "placed", "first", "near", "visits", "rest")
    named = reps.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("d1", "d2", "n", F.coalesce("component", "rep").alias("component"))
    out = heads.join(named, ["d1", "d2", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", broadcast_rows: int = 1_000_000) -> DataFrame:
    """``docs`` with one document of each group of linked ones, that with the smallest id. Rows
    without an id stay."""
    gone = spare_name("gone", docs.columns)
    marks = Tables(docs.sparkSession).write("marks", components_of(docs, key, text).where("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct())
    return docs.join(small_side(marks, marks.count(), broadcast_rows), F.col(f"`{key}`").cast("long") == F.col(gone), "left_anti")
