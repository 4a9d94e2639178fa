"""Packing documents into fixed-size token sequences by cutting-stock column generation.

A document's ids are cut into full pieces and one remainder. Full pieces are sequences of their own.
The remainders' length histogram (at most ``capacity - 1`` bins, whatever the corpus) is a cutting
stock problem: a linear program over patterns of lengths, whose columns are priced by a knapsack
dynamic program until the bound is within ``gap``. Rounded-down patterns are laid out as they are;
the few remainders left over are packed best fit first. Each pattern's lengths then stand for ranges
of ranks, and the remainders of each length, ranked, are assigned by a lookup. Only the histogram
reaches the driver and only the pattern table goes back; ranks are counted within salted groups, so
that a length shared by a third of all documents is no single task.

Cases: a null or empty text is the end id alone; very long documents become many full pieces; equal
rows get pieces each; an empty table gives an empty result; other columns are not read. If a
vocabulary's special string stands in a text, the library's default reading holds.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hexagrove.llm.common import settle, text_or_empty

#: Distinct space-led parts of texts whose ids a task remembers; when full, it starts anew.
MEMO = 400_000
#: The pre-token pattern of byte-level BPE, as published with the vocabulary (a fixed value).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class ByteBpeEncoder(dict):
    """Ids of whole texts as ``tokenizers`` gives them, as little-endian unsigned 32-bit bytes.

    Byte-level BPE never joins across the start of a single space that text follows, so a text
    is cut there; this dictionary remembers the ids of each distinct part, with its space. Where the
    vocabulary's ids are also its merge ranks (checked on loading), a part is merged by those ranks.
    Texts with other white space after a space, a space at the end or a special string, and
    vocabularies of another kind, go to the library whole.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        model = json.loads(Path(path).read_text())
        # Printable stand-ins of the 256 bytes in byte-level vocabularies: printable Latin-1 as it is, the rest from U+0100 on.
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        other = [b for b in range(256) if b not in plain]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}
        special = {t.content for t in self.lib.get_added_tokens_decoder().values()}
        vocabulary = {t: i for t, i in model["model"]["vocab"].items() if t not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        self.ranked = all(vocabulary.get("".join(m)) == 256 + k for k, m in enumerate(merges)) and len(vocabulary) == 256 + len(merges)
        if self.ranked:
            ranks = {bytes(byte[c] for c in t): i for t, i in vocabulary.items()}
            self.parts = tiktoken.Encoding("parts", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})
        self.whole = re.compile("|".join([r" (?:\s|\Z)", *map(re.escape, sorted(special))]))

    def __missing__(self, part: str) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        found = self[part] = np.array(self.parts.encode_ordinary(" " + part), dtype="<u4").tobytes()
        return found

    def encode(self, text: str) -> bytes:
        if not self.ranked or self.whole.search(text):
            return np.array(self.lib.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        first, *rest = text.split(" ")
        return np.array(self.parts.encode_ordinary(first), dtype="<u4").tobytes() + b"".join(map(self.__getitem__, rest))


@functools.lru_cache(1)
def encoder(path: str) -> ByteBpeEncoder:
    """One encoder for each Python worker, kept between its tasks."""
    return ByteBpeEncoder(path)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: where it starts in its document, its length, its ids' CRC, and with
    ``with_ids`` the ids themselves (little-endian unsigned 32-bit) as ``ids``. No shuffle."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer).encode
        for batch in batches:
            rows = []
            for doc, ids in zip(batch["doc_id"].tolist(), map(encode, batch["text"].tolist())):
                ids += end
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    part = ids[4 * start : 4 * (start + capacity)]
                    rows.append((doc, start, len(part) // 4, zlib.crc32(part), n, *([part] if with_ids else [])))
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    read = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    return read.mapInPandas(pieces, PIECES + ", ids binary" * with_ids)


def knapsack(value: np.ndarray, capacity: int) -> tuple[float, Counter]:
    """The best multiset of lengths within ``capacity``; ``value[l]`` is the worth of length ``l``."""
    best, take = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=int)
    for room in range(1, capacity + 1):
        worth = value[1 : room + 1] + best[room - 1 :: -1]
        k = int(worth.argmax())
        best[room], take[room] = (worth[k], k + 1) if worth[k] > best[room - 1] + 1e-12 else (best[room - 1], 0)
    pattern: Counter = Counter()
    room = capacity
    while room > 0:
        if take[room]:
            pattern[int(take[room])] += 1
        room -= int(take[room]) or 1
    return float(best[capacity]), pattern


def best_fit(left: Counter, capacity: int) -> Counter:
    """Whole sequences for a small remaining histogram: longest first, then the longest that fits."""
    left, found = +left, Counter()
    while left:
        room, pattern = capacity, Counter()
        for length in sorted(left, reverse=True):
            n = min(left[length], room // length)
            if n:
                pattern[length] += n
                room -= n * length
        times = min(left[length] // n for length, n in pattern.items())
        found[tuple(sorted(pattern.items()))] += times
        left = +Counter({length: n - times * pattern[length] for length, n in left.items()})
    return found


def times_vector(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """A matrix times a sparse vector, without the thread pool of a linear algebra library."""
    there = np.flatnonzero(vector)
    return (matrix[:, there] * vector[there]).sum(axis=1)


def column_of(pattern: Counter, at: dict[int, int]) -> np.ndarray:
    column = np.zeros(len(at))
    for n, times in pattern.items():
        column[at[n]] = times
    return column


def pivot(inverse: np.ndarray, column: np.ndarray, out: int) -> None:
    """Bring ``column`` into the basis in place of number ``out``; ``inverse`` changes in place."""
    step = times_vector(inverse, column)
    row = inverse[out] / step[out]
    inverse -= step[:, None] * row
    inverse[out] = row


def first_basis(lengths: list[int], demand: np.ndarray, capacity: int) -> list[tuple[int, Counter, float]]:
    """A feasible start: the longest length left, filled up by the knapsack, until a length runs out.

    Returns (length that ran out, pattern, times). No later pattern holds that length, so the patterns
    form a triangular basis.
    """
    left, found = dict(zip(lengths, demand)), []
    nothing = 1e-9 * max(1.0, float(demand.max()))
    worth = np.full(capacity + 1, -1.0)
    # Fewer, longer pieces first: each costs a little.
    worth[lengths] = np.array(lengths) - 0.01
    while left:
        longest = max(left)
        pattern = knapsack(worth[: capacity - longest + 1], capacity - longest)[1] if longest < capacity else Counter()
        pattern[longest] += 1
        times = min(left[n] / k for n, k in pattern.items())
        for n, k in pattern.items():
            left[n] -= k * times
        ended = sorted((left[n], n) for n in pattern if left[n] <= nothing)
        for rank, (_, n) in enumerate(ended):
            # One that ran out together with another gets a pattern of its own that is used no times.
            found.append((n, Counter({n: capacity // n}), 0.0) if rank else (n, pattern, times))
            del left[n]
            worth[n] = -1.0
    return found


def cutting_stock(histogram: dict[int, int], capacity: int, gap: float = 2e-3, most_rounds: int = 1000) -> Counter:
    """Patterns, as tuples of (length, times), and how many sequences each makes.

    Column generation by the revised simplex method: the duals price a knapsack, the best pattern
    enters. Stops when Farley's bound shows the plan within ``gap`` of the optimum.
    """
    lengths = sorted(n for n in histogram if histogram[n])
    if not lengths:
        return Counter()
    demand = np.array([float(histogram[n]) for n in lengths])
    at = {n: i for i, n in enumerate(lengths)}
    patterns, x, inverse = [Counter()] * len(lengths), np.zeros(len(lengths)), np.eye(len(lengths))
    for ended, pattern, times in reversed(first_basis(lengths, demand, capacity)):
        patterns[at[ended]], x[at[ended]] = pattern, times
        pivot(inverse, column_of(pattern, at), at[ended])
    value = np.full(capacity + 1, -1.0)
    bound = 0.0
    for _ in range(most_rounds):
        duals = inverse.sum(axis=0)
        value[lengths] = duals
        worth, pattern = knapsack(value, capacity)
        bound = max(bound, x.sum() / worth)
        if worth <= 1 + 1e-9 or x.sum() - bound <= gap * x.sum():
            break
        column = column_of(pattern, at)
        step = times_vector(inverse, column)
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1.0), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        patterns[out] = pattern
        x = x - ratio[out] * step
        x[out] = ratio[out]
        pivot(inverse, column, out)
        x = np.maximum(x, 0.0)
    plan, left = Counter(), Counter({n: int(histogram[n]) for n in lengths})
    for k in np.argsort(-x):
        times = min([int(x[k] + 1e-9), *(left[n] // c for n, c in patterns[k].items())])
        if times > 0:
            plan[tuple(sorted(patterns[k].items()))] += times
            left.subtract({n: c * times for n, c in patterns[k].items()})
    return plan + best_fit(left, capacity)


def pattern_table(plan: Counter) -> list[tuple[int, int, int, int, int, int, int]]:
    """Rows (length, first rank, end rank, times, first sequence, offset, filled) of the plan."""
    rows, used, sequence = [], Counter(), 0
    for pattern, copies in sorted(plan.items(), reverse=True):
        offset, filled = 0, sum(n * times for n, times in pattern)
        for length, times in sorted(pattern, reverse=True):
            rows.append((length, used[length], used[length] + times * copies, times, sequence, offset, filled))
            used[length] += times * copies
            offset += times * length
        sequence += copies
    return rows


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, group_rows: int = 200_000, **options) -> DataFrame:
    """``token_pieces`` with ``sequence_id``, ``offset`` and ``padded_length`` (the capacity, or the
    filled length where that is a power of two)."""
    pieces = settle(token_pieces(docs, tokenizer, capacity, **options))
    spark = pieces.sparkSession
    histogram = {row["length"]: row["count"] for row in pieces.groupBy("length").count().collect()}
    full = histogram.pop(capacity, 0)
    plan = cutting_stock(histogram, capacity) + (Counter({((capacity, 1),): full}) if full else Counter())
    salts = max(1, -(-(sum(histogram.values()) + full) // group_rows))
    # Ranks within each length: inside a salted group, plus the rows of the length's groups before it.
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)))
    groups = salted.groupBy("length", "salt").count()
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(within) - 1).join(groups, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    schema = "length long, first long, stop long, times long, sequence long, at long, filled long"
    # At most capacity rows, each with the ranges of one length: bounded by the plan, never by the corpus.
    ranges = spark.createDataFrame(pattern_table(plan), schema).groupBy("length").agg(F.collect_list(F.struct("first", "stop", "times", "sequence", "at", "filled")).alias("ranges"))
    found = ranked.join(F.broadcast(ranges), "length").withColumn("r", F.expr("filter(ranges, r -> rank >= r.first AND rank < r.stop)[0]"))
    index = F.col("rank") - F.col("r.first")
    padded = F.when(F.expr("r.filled & (r.filled - 1) = 0"), F.col("r.filled")).otherwise(capacity)
    keep = [c for c in pieces.columns]
    return found.select(
        *keep,
        (F.col("r.sequence") + F.floor(index / F.col("r.times"))).cast("long").alias("sequence_id"),
        (F.col("r.at") + F.pmod(index, F.col("r.times")) * F.col("length")).cast("long").alias("offset"),
        padded.cast("long").alias("padded_length"),
    )
