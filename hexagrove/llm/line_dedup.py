"""Line dedup with a sharded minimal perfect hash.

Keys of lines that enough documents hold are hashed to 128 bits and dealt to shards. Each shard turns
its keys into a minimal perfect hash (levels of bit arrays: a key that is alone at its place in a
level stays there, the others go on to the next) that indexes three compact arrays: a 64-bit
fingerprint, the number of documents, and the document that keeps the line. Documents send their line
hashes, never the lines, to the shards and probe the arrays; what comes back are the places of the lines
that a document has to drop.

Hot lines: counts are pre-aggregated before the shuffle, and a shard that gets many probes is
copied to as many salted groups as its probes need, so that groups hold about ``probe_rows``.

Cases: a null or empty text is one empty line; a row without ``doc_id`` holds no lines and keeps all
its own; rows with one ``doc_id`` are one document for counting, and each gets its row; an empty table
gives an empty result; other columns pass through ``dedup_lines``, those named ``n_lines`` or ``n_dropped``
are replaced. Lines are counted by 128 bits; a line is dropped wrongly if its second 64 bits equal those of the
one key at its place in the arrays, a chance of 2**-64 for each line.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexagrove.llm.common import WHITE, ascii_lower, settle, small_side, spare_name, text_or_empty

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def places(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    """Where a level puts the keys: both hashes mixed anew for each level."""
    z = h1 * np.uint64(2 * level + 1) + (h2 ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(2 * level + 3)
    z = (z ^ (z >> np.uint64(30))) * M1
    z = (z ^ (z >> np.uint64(27))) * M2
    return ((z ^ (z >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


def build(h1: np.ndarray, h2: np.ndarray, spread: float = 1.6) -> list[np.ndarray]:
    """The bit arrays of a minimal perfect hash over distinct pairs."""
    levels, level = [], 0
    while len(h1):
        size = max(8, int(spread * len(h1)))
        at = places(h1, h2, level, size)
        alone = np.bincount(at, minlength=size)[at] == 1
        bits = np.zeros(size, dtype=bool)
        bits[at[alone]] = True
        levels.append(bits)
        h1, h2, level = h1[~alone], h2[~alone], level + 1
    return levels


def index(levels: list[np.ndarray], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """The array index of each pair; -1 where no level holds a bit for it."""
    out, left, base = np.full(len(h1), -1, dtype=np.int64), np.arange(len(h1)), 0
    for level, bits in enumerate(levels):
        rank = np.cumsum(bits) - 1
        at = places(h1[left], h2[left], level, len(bits))
        hit = bits[at]
        out[left[hit]] = base + rank[at[hit]]
        base += int(bits.sum())
        left = left[~hit]
    return out


SHARD = "shard long, sizes array<long>, bits binary, fingerprints binary, counts binary, keepers binary"


def _build_shard(keys: pd.DataFrame) -> pd.DataFrame:
    h1, h2 = keys["h1"].to_numpy(np.int64).view(np.uint64), keys["h2"].to_numpy(np.int64).view(np.uint64)
    levels = build(h1, h2)
    order = np.argsort(index(levels, h1, h2))
    row = {"shard": keys["shard"].iloc[0], "sizes": [len(b) for b in levels], "bits": b"".join(np.packbits(b).tobytes() for b in levels)}
    row |= {"fingerprints": h2[order].tobytes(), "counts": keys["n_docs"].to_numpy(np.int64)[order].astype(np.int32).tobytes(), "keepers": keys["keeper"].to_numpy(np.int64)[order].tobytes()}
    return pd.DataFrame([row])


def _probe(arrays: pd.DataFrame, probes: pd.DataFrame) -> pd.DataFrame:
    if arrays.empty or probes.empty:
        return pd.DataFrame({"doc_id": [], "print": [], "at": []}).astype("int64")
    shard, levels, start = arrays.iloc[0], [], 0
    for size in shard["sizes"]:
        stop = start + -(-size // 8)
        levels.append(np.unpackbits(np.frombuffer(shard["bits"][start:stop], np.uint8), count=size).astype(bool))
        start = stop
    fingerprints, keepers = np.frombuffer(shard["fingerprints"], np.uint64), np.frombuffer(shard["keepers"], np.int64)
    h1, h2 = (probes[c].to_numpy(np.int64).view(np.uint64) for c in ("h1", "h2"))
    at = index(levels, h1, h2)
    drop = (at >= 0) & (fingerprints[at] == h2) & (keepers[at] != probes["doc_id"].to_numpy(np.int64))
    return probes.loc[drop, ["doc_id", "print", "at"]]


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5, shard_keys: int = 500_000, probe_rows: int = 400_000) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, and ``n_lines`` and ``n_dropped``."""
    whole = text_or_empty(f"`{text}`")
    lines = F.split(whole, "\n", -1)
    keyed = docs.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.xxhash64(whole).alias("print"), F.posexplode(F.transform(lines, line_key)).alias("at", "k"))
    probes = settle(keyed.where(F.char_length("k") >= min_chars).select("doc_id", "print", "at", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(7), "k").alias("h2")))
    # Rows that share a doc_id are one document: count it once.
    shared = probes.groupBy("h1", "h2").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("keeper")).where(F.col("n_docs") >= min_docs)
    shared = settle(shared)
    n_shards = max(1, -(-shared.count() // shard_keys))
    sharded = shared.withColumn("shard", F.pmod("h1", F.lit(n_shards)))
    arrays = sharded.groupBy("shard").applyInPandas(_build_shard, SHARD)
    probes = probes.withColumn("shard", F.pmod("h1", F.lit(n_shards)))
    load = probes.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / probe_rows).alias("groups"))
    load = settle(load)
    arrays = arrays.join(load, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)))
    probes = probes.join(small_side(load, n_shards, 100_000), "shard").withColumn("salt", F.pmod(F.xxhash64("doc_id", "at"), F.col("groups")))
    found = arrays.groupBy("shard", "salt").cogroup(probes.select("shard", "salt", "doc_id", "print", "at", "h1", "h2").groupBy("shard", "salt")).applyInPandas(_probe, "doc_id long, print long, at int")
    # The places of one document's lines, so each list is bounded by its text.
    own, print_, drops = (spare_name(n, docs.columns) for n in ("own_id", "own_print", "drops"))
    gone = found.groupBy(F.col("doc_id").alias(own), F.col("print").alias(print_)).agg(F.collect_set("at").alias(drops))
    joined = docs.join(gone, (F.col(f"`{key}`").cast("long") == F.col(own)) & (F.xxhash64(whole) == F.col(print_)), "left").drop(own, print_)
    n_lines = F.size(lines).cast("long")
    # A set difference of places and one look-up for each that stays: linear in the number of lines.
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(drops))
    rest = F.transform(F.array(F.struct(lines.alias("l"), stay.alias("s"))), lambda x: F.array_join(F.transform(x["s"], lambda i: F.get(x["l"], i)), "\n"))[0]
    new_text = F.when(F.col(drops).isNull(), F.col(f"`{text}`")).otherwise(rest)
    keep = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    return joined.select(*((new_text.alias(c) if c == text else F.col(f"`{c}`")) for c in keep), n_lines.alias("n_lines"), F.coalesce(F.size(drops), F.lit(0)).cast("long").alias("n_dropped"))
