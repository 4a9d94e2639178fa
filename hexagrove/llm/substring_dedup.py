"""Removal of word windows that occur earlier in the corpus, found at difference-cover anchors.

The residues 0, 1, 3 and 9 cover all differences modulo 13: for any two places there is a shift below 13
that brings both to a residue of the cover. Only the 8 words at places of the cover are hashed as anchors, 4 of
13 places. Two equal windows of 20 words share such an anchor at the same shift, since 12 + 8 = 20.

1. Each document's anchors go to buckets of their hash, each with a hash of its context, the 32 words that
   all windows through the anchor lie in.
2. A bucket compares anchors of equal hash. One whose context occurs earlier extends as far as any window through
   it can: all those windows are repeats, and only that fact is sent back. The first anchor of each context is
   a border if another context follows the same anchor: there a match ends somewhere inside.
3. Windows through borders are hashed whole (128 bits) and compared; the earliest of each stays.
4. Documents drop the words under repeated windows.

Places are earlier by smaller document id, then by start. Nothing gathers a group: a task first compares what it
holds itself and sends on only the first anchor or window of each kind, so that a passage found in any number of
documents reaches a bucket at most once from each slice of ``SLICE`` bytes of text.

Cases: words are the maximal runs outside the six ASCII white characters; a null or empty text has none. A document
under 20 words has no window and keeps all words. A row without id takes no part and keeps all its words.
Rows with one id: equal texts have their windows at the same places, of which none is earlier, so both keep what either
would; of different texts, those windows go that start earlier in another row (16 bits of a checksum tell the
rows of one id apart). Kept words are joined by one space. An empty table gives an empty result. Other columns
pass; those named ``n_words`` or ``n_removed`` in any case are replaced. Two windows count as equal by 128 bits, two
anchors with their contexts by 112 bits or more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hexagrove.llm import rolling
from hexagrove.llm.common import Tables, sets_aside, spare_name, text_or_empty

WINDOW, PERIOD, COVER = 20, 13, (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
#: Bytes of text that a task hashes and compares at a time.
SLICE = 8 << 20
#: Bytes of text for each bucket of anchors, and the least number of buckets.
BUCKET_BYTES, LEAST_BUCKETS = 2 << 20, 64

PLACES = "bucket int, n int, block binary"
MARKS = "doc long, print int, at int, kind int"
#: Kinds of marks: all windows through the anchor at ``at``; windows through it to be compared; the window at ``at``.
THROUGH, BORDER, FROM = 1, 2, 3


def slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch by rows, each with about ``SLICE`` bytes of text or one longer text; bytes and offsets."""
    text = batch.column("text").cast(pa.large_string())
    size = np.array(pc.binary_length(text).fill_null(0), np.int64)
    stop = np.cumsum(size)
    at = 0
    while at < len(size):
        end = max(at + 1, int(np.searchsorted(stop, (stop[at - 1] if at else 0) + SLICE, "right")))
        part = text.slice(at, end - at)
        part = pa.concat_arrays([part.fill_null("")]) if part.null_count else part
        offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(part.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        yield batch.slice(at, end - at), data, offsets - offsets[0]
        at = end


def starts_of(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From the number of words before each row: for each word its row and its place there."""
    n = np.diff(first)
    row = np.repeat(np.arange(len(n), dtype=np.int64), n)
    return row, np.arange(first[-1], dtype=np.int64) - first[row]


def compare(keys: tuple[np.ndarray, ...], doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by keys, document and place; which of these differ in the first key from the one before; and which
    occur at an earlier place with all keys equal."""
    order = np.lexsort((at, doc, *keys[::-1]))
    new = np.ones(len(order), bool)
    first_new = new.copy()
    if len(order):
        first_new[1:] = keys[0][order][1:] != keys[0][order][:-1]
        new[1:] = first_new[1:]
        for k in keys[1:]:
            new[1:] |= k[order][1:] != k[order][:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    later = (doc[order] != doc[order][head]) | (at[order] != at[order][head])
    return order, first_new, later


def packed(key: np.ndarray, rest: np.ndarray, doc: np.ndarray, print_: np.ndarray, at: np.ndarray, n_buckets: int) -> pa.RecordBatch:
    """Blocks of places by bucket of ``key``: 32 bits of the key, the whole ``rest``, document, print and place."""
    bucket = (key >> np.uint64(32)) % np.uint64(n_buckets)
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.r_[True, np.diff(bucket[order]) > 0, True]) if len(order) else np.zeros(1, int)
    squeeze, rows = zstandard.ZstdCompressor(level=1), []
    for a, b in zip(edges, edges[1:]):
        o = order[a:b]
        small = np.diff(doc[o], prepend=0).tobytes() + at[o].astype(np.int32).tobytes() + print_[o].astype(np.uint16).tobytes()
        rows.append((int(bucket[o[0]]), b - a, key[o].astype(np.uint32).tobytes() + rest[o].tobytes() + squeeze.compress(small)))
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary())], names=["bucket", "n", "block"])


def unpacked(n: list[int], blocks: list[bytes]) -> tuple[np.ndarray, ...]:
    parts: list[tuple] = []
    loosen = zstandard.ZstdDecompressor()
    for k, block in zip(n, blocks):
        small = loosen.decompress(block[12 * k :])
        parts.append((np.frombuffer(block, np.uint32, k), np.frombuffer(block, np.uint64, k, 4 * k), np.cumsum(np.frombuffer(small, np.int64, k)), np.frombuffer(small, np.int32, k, 8 * k), np.frombuffer(small, np.uint16, k, 12 * k)))
    key, rest, doc, at, print_ = (np.concatenate(x) for x in zip(*parts))
    return key, rest, doc, at, print_


def marks(doc, print_, at, kind) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(print_.astype(np.int32), pa.int32()), pa.array(at.astype(np.int32), pa.int32()), pa.array(np.full(len(doc), kind, np.int32) if np.isscalar(kind) else kind, pa.int32())], names=["doc", "print", "at", "kind"])


#: The bucket of blocks whose marks a task has made itself; they pass through unchanged.
def _own(bucket: int, n_buckets: int) -> int:
    return -1 - bucket % n_buckets


def passed_on(key, rest, doc, print_, at, n_buckets: int, salt: int) -> Iterator[pa.RecordBatch]:
    """Blocks of the first places of each kind in a slice, and the later ones as marks in a block of their own."""
    order, _, later = compare((key, rest), doc, at)
    o = order[~later]
    o.sort()
    yield packed(key[o], rest[o], doc[o], print_[o], at[o], n_buckets)
    o = order[later]
    if len(o):
        o.sort()
        zero = np.zeros(len(o), np.uint64)
        done = packed(zero, zero, doc[o], print_[o], at[o], 1)
        yield done.set_column(0, "bucket", pa.array([_own(salt, n_buckets)], pa.int32()))


def anchors(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch):
                words, first = rolling.word_hashes(data, offsets)
                row, pos = starts_of(first)
                n = np.diff(first)[row]
                at = np.flatnonzero(np.isin(pos % PERIOD, COVER) & (pos + ANCHOR <= n) & (n >= WINDOW))
                if not len(at):
                    continue
                sums, r = rolling.window_sums(words), row[at]
                low, high = np.maximum(at - (PERIOD - 1), first[r]), np.minimum(at + WINDOW, first[r + 1])
                key = rolling.window_hashes(sums, at, at + ANCHOR)
                context = rolling.mixed(rolling.window_hashes(sums, low, high) + (at - low).astype(np.uint64))
                doc, print_ = (part.column(c).to_numpy(zero_copy_only=False)[r] for c in ("doc", "print"))
                yield from passed_on(key, context, doc, print_, pos[at], n_buckets, int(doc[0]))

    return run


def compare_anchors(group: pa.Table) -> pa.Table:
    key, context, doc, at, print_ = unpacked(group["n"].to_pylist(), group["block"].to_pylist())
    if group["bucket"][0].as_py() < 0:
        return pa.Table.from_batches([marks(doc, print_, at, THROUGH)])
    order, new, later = compare((key, context), doc, at)
    # The first of each context is at a border if its anchor has more than one context.
    group_of = np.cumsum(new) - 1
    same = np.ones(len(order), bool)
    same[1:] = new[1:] | (context[order][1:] == context[order][:-1])
    border = ~later & (np.bincount(group_of, weights=~same)[group_of] > 0)
    chosen = later | border
    o = order[chosen]
    return pa.Table.from_batches([marks(doc[o], print_[o], at[o], np.where(later[chosen], THROUGH, BORDER).astype(np.int32))])


def compare_windows(group: pa.Table) -> pa.Table:
    key, rest, doc, at, print_ = unpacked(group["n"].to_pylist(), group["block"].to_pylist())
    if group["bucket"][0].as_py() < 0:
        return pa.Table.from_batches([marks(doc, print_, at, FROM)])
    order, _, later = compare((key, rest), doc, at)
    o = order[later]
    return pa.Table.from_batches([marks(doc[o], print_[o], at[o], FROM)])


def covered(found: pa.Array, first: np.ndarray, row_of: np.ndarray, n_words: int, wanted: tuple[int, ...]) -> np.ndarray:
    """Which starts of windows the marks of the rows name: those through anchors, or from their places."""
    flat = found.flatten()
    kind, at = flat.field("kind").to_numpy(zero_copy_only=False), flat.field("at").to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = np.array(pc.list_value_length(found).fill_null(0), np.int64)
    row = np.repeat(np.arange(len(found)), lengths)
    use = np.isin(kind, wanted)
    row, at, kind = row[use], at[use], kind[use]
    base, n = first[row], first[row + 1] - first[row]
    low = np.where(kind == FROM, at, np.maximum(0, at - (PERIOD - 1)))
    high = np.minimum(at, n - WINDOW)
    ok = high >= low
    change = np.zeros(n_words + 1, np.int64)
    np.add.at(change, (base + low)[ok], 1)
    np.add.at(change, (base + high)[ok] + 1, -1)
    return np.cumsum(change[:-1]) > 0


def border_windows(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch):
                words, first = rolling.word_hashes(data, offsets)
                row, pos = starts_of(first)
                found = part.column("found")
                at = np.flatnonzero(covered(found, first, row, len(words), (BORDER,)) & ~covered(found, first, row, len(words), (THROUGH,)))
                if not len(at):
                    continue
                key = rolling.window_hashes(rolling.window_sums(words), at, at + WINDOW)
                rest = rolling.window_hashes(rolling.window_sums(rolling.word_hashes(data, offsets, 1)[0], 1), at, at + WINDOW, 1)
                doc, print_ = (part.column(c).to_numpy(zero_copy_only=False)[row[at]] for c in ("doc", "print"))
                yield from passed_on(key, rest, doc, print_, pos[at], n_buckets, int(doc[0]))

    return run


def kept_words(place: int, found_at: int, names: list[str]):
    """Rows with the words that stay in column ``place``; ``names`` are the result's columns, the last two the counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(found_at)
            texts, totals, removed = [], [], []
            # Marks of one row at a time: they are bounded by its text.
            for text, own in zip(batch.column(place), found):
                words = (text.as_py() or "").encode().split()
                gone = 0
                if own.is_valid and len(own) and len(words) >= WINDOW:
                    listed = pa.concat_arrays([pa.array([own.as_py()], found.type)])
                    starts = covered(listed, np.array([0, len(words)]), np.zeros(1), len(words), (THROUGH, FROM)).astype(np.int64)
                    total = np.concatenate(([0], np.cumsum(starts)))
                    at = np.arange(len(words))
                    drop = total[at + 1] > total[np.maximum(0, at - WINDOW + 1)]
                    gone = int(drop.sum())
                    words = [words[i] for i in np.flatnonzero(~drop)]
                texts.append(b" ".join(words))
                totals.append(gone + len(words))
                removed.append(gone)
            columns = [c for i, c in enumerate(batch.columns) if i != found_at]
            columns[place - (found_at < place)] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(totals, pa.int64()), pa.array(removed, pa.int64())], names=names)

    return run


@sets_aside
def dedup_windows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the words under windows of 20 that start earlier elsewhere, and ``n_words`` and ``n_removed``."""
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_words", "n_removed") or c in (key, text)))
    doc, print_, found = (spare_name(n, docs.columns) for n in ("own_doc", "own_print", "own_found"))
    docs = docs.withColumns({doc: F.col(f"`{key}`").cast("long"), print_: F.pmod(F.crc32(text_or_empty(f"`{text}`").cast("binary")), F.lit(1 << 16)).cast("int")})
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    n_buckets = max(LEAST_BUCKETS, -(-size // BUCKET_BYTES))
    tables = Tables(docs.sparkSession)
    texts = docs.where(F.col(doc).isNotNull() & F.col(f"`{text}`").isNotNull())
    plain = texts.select(F.col(doc).alias("doc"), F.col(print_).alias("print"), F.col(f"`{text}`").alias("text"))
    places = plain.mapInArrow(anchors(n_buckets), PLACES)
    first = tables.write("marks", places.groupBy("bucket").applyInArrow(compare_anchors, MARKS))

    def gathered(df: DataFrame) -> DataFrame:
        return df.groupBy("doc", "print").agg(F.collect_list(F.struct("at", "kind")).alias("found"))

    at_borders = first.where(F.col("kind") == BORDER).select("doc", "print").distinct()
    wanted = gathered(first.join(at_borders, ["doc", "print"], "left_semi"))
    windows = plain.join(wanted, ["doc", "print"]).mapInArrow(border_windows(n_buckets), PLACES)
    repeats = windows.groupBy("bucket").applyInArrow(compare_windows, MARKS)
    gone = gathered(first.where(F.col("kind") == THROUGH).union(repeats)).select(F.col("doc").alias(doc + "_"), F.col("print").alias(print_ + "_"), F.col("found").alias(found))
    joined = docs.join(gone, (F.col(doc) == F.col(doc + "_")) & (F.col(print_) == F.col(print_ + "_")), "left").drop(doc, print_, doc + "_", print_ + "_")
    kept = [f for f in docs.schema.fields if f.name not in (doc, print_)]
    schema = T.StructType([*(T.StructField(text, T.StringType()) if f.name == text else f for f in kept), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    return joined.mapInArrow(kept_words([f.name for f in kept].index(text), len(kept), [f.name for f in schema.fields]), schema)
