"""Sharding by a two-pass external shuffle.

Pass one scatters whole records into buckets with seeded hashes: a record's shard by its key and the
number of shards alone, its bucket inside the shard by a second hash over key and content. The number
of buckets follows from the measured bytes, so that a bucket fits in memory. Pass two shuffles each
bucket by Fisher-Yates with a generator seeded by the bucket, and gives each record its slot: the
bucket's offset in the shard plus the place in the bucket.

Shards follow the law ``key``. Each shard ``s`` has a hash of the key with ``s``; the largest wins
(rendezvous hashing). One more shard can only win a record for itself, so growing moves records only
into the new shard. Copies of a text have their own keys and spread over all shards and buckets.

Cases: null texts have no bytes and CRC 0; null keys hash as a value of their own; fully equal rows
share a bucket and are told apart by nothing, so their order does not matter; an empty table gives an
empty result; other columns travel along, columns named like the added ones are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hexagrove.llm.common import sets_aside, text_or_empty


def shard_of(key: Column, n_shards: int, seed: int) -> Column:
    """Rendezvous hashing: the shard whose hash with the key is the largest, the lower one of equals."""
    weights = [F.struct(F.xxhash64(F.lit(seed), F.lit(s), key).alias("h"), F.lit(-s).alias("s")) for s in range(n_shards)]
    return (-F.greatest(*weights)["s"]).cast("int") if n_shards > 1 else F.lit(0)


def _fisher_yates(seed: int):
    def shuffle(group: pa.Table) -> pa.Table:
        shard, bucket = group["shard"][0].as_py(), group["bucket"][0].as_py()
        # A fixed order first: the result then does not depend on the order in which rows arrive.
        group = group.take(pa.compute.sort_indices(group, sort_keys=[("__place", "ascending"), ("__tie", "ascending")]))
        order = np.arange(group.num_rows)
        np.random.default_rng([seed, shard, bucket]).shuffle(order)  # Fisher-Yates in place
        group = group.take(pa.array(order))
        return group.set_column(group.schema.get_field_index("slot"), "slot", pa.array(np.arange(len(order), dtype="int64")))

    return shuffle


@sets_aside
def shard(docs: DataFrame, n_shards: int, key: str = "doc_id", text: str = "text", seed: int = 17, bucket_bytes: int = 32 << 20) -> DataFrame:
    """``docs`` with ``size``, ``text_crc32``, ``shard``, ``bucket``, ``slot`` and ``grown_shard``.

    ``slot`` runs from 0 without gaps inside each shard; a shard is its rows in slot order.
    """
    added = ("size", "text_crc32", "shard", "bucket", "slot", "grown_shard", "__place", "__tie")
    kept = [c for c in docs.columns if c not in added]
    body = text_or_empty(text)
    rows = docs.select(*(F.col(f"`{c}`") for c in kept), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    measured = docs.select(F.sum(F.octet_length(body) + 8).alias("bytes")).first()["bytes"] or 0
    n_buckets = max(1, -(-int(measured) // (bucket_bytes * n_shards)))
    rows = rows.select(
        "*",
        shard_of(F.col(f"`{key}`"), n_shards, seed).alias("shard"),
        shard_of(F.col(f"`{key}`"), n_shards + 1, seed).alias("grown_shard"),
        F.xxhash64(F.lit(seed + 1), F.col(f"`{key}`"), F.col("text_crc32"), F.col("size")).alias("__place"),
        F.xxhash64(F.lit(seed + 2), F.col(f"`{key}`"), body).alias("__tie"),
    ).withColumn("bucket", F.pmod("__place", F.lit(n_buckets)).cast("int"))
    rows = rows.withColumn("slot", F.lit(0).cast("long"))
    placed = rows.groupBy("shard", "bucket").applyInArrow(_fisher_yates(seed), rows.schema)
    # One row for each bucket; its offset is the rows of the shard's buckets before it.
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__offset"))
    out = placed.join(offsets, ["shard", "bucket"])
    return out.select(*kept, "size", "text_crc32", "shard", "bucket", (F.col("slot") + F.col("__offset")).cast("long").alias("slot"), "grown_shard")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard; files hold whole buckets in slot order."""
    parts = max(1, sharded.select("shard", "bucket").distinct().count())
    sharded.repartition(parts, "shard", "bucket").sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)


__all__ = ["shard", "shard_of", "write_shards"]
