"""Global shuffle of records into shards of equal counts.

An external shuffle in two passes. The first counts how many records the seeded hash scatters into each bucket, where the number
of buckets follows from the bytes of the input, so that a bucket fits in a task's memory; prefix sums over the counts place the
buckets one behind the other. The second pass scatters the records, orders each bucket by content, so that a task that runs again
meets the same order, and shuffles it by Fisher-Yates with the bucket's own seed. A record's place in that order decides its
shard: shard s holds the places from ceil(s N / S) on, so counts differ by one at most and each shard is a run of buckets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The law that shards obey: counts at most one apart.
LAW = "rows"


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A uniform permutation of range(n); numpy's is the shuffle of Fisher and Yates."""
    return np.random.default_rng(seed).permutation(n)


def _spread(scattered: DataFrame, own: list[str], seed: int, hot_rows: int) -> DataFrame:
    """The same rows; those of a mark with more than hot_rows rows get marks of their own. Rows equal in all columns are exchanged
    for a count, which partial aggregates do, and the count for numbered copies, so a task that runs again marks them alike."""
    hot = scattered.groupBy("__mark").agg(F.count("*").alias("__n")).filter(F.col("__n") > hot_rows).select("__mark")
    if hot.isEmpty():
        return scattered
    of = scattered.join(hot, "__mark", "left_semi").groupBy(*own, "size").agg(F.count("*").alias("__n"))
    copies = of.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))))
    marked = copies.withColumn("__mark", F.xxhash64(F.lit(seed), *own, "__copy"))
    return scattered.join(hot, "__mark", "left_anti").select(*own, "size", "__mark").unionAll(marked.select(*own, "size", "__mark"))


def shard(docs: DataFrame, shards: int = 24, seed: int = 20, bucket_bytes: int = 64 << 20, hot_rows: int = 100_000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every record with all its columns, its size (UTF-8 bytes of the text, null: none, plus 8), shard, slot (from 0 in the shard).

    Records with one key but other texts, and copies of a text under other keys, scatter freely. Rows equal in both share a bucket,
    unless they are more than hot_rows: then they are grouped by all columns, which must be of types that can be grouped, and
    scatter too. Null keys and texts are hashed like other values. Columns of docs that are named size, shard or slot are replaced.
    An empty input has no rows. A bucket, and so a very long text, is in the memory of a task as a whole.
    """
    own = [c for c in docs.columns if c not in ("size", "shard", "slot")]
    sized = docs.select(*own, (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"))
    total = sized.agg(F.sum("size")).first()[0] or 0
    buckets = max(1, math.ceil(total / bucket_bytes))
    mark = F.xxhash64(F.lit(seed), F.col(key), F.col(text))
    scattered = _spread(sized.withColumn("__mark", mark), own, seed, hot_rows).withColumn("__bucket", F.pmod("__mark", F.lit(buckets)).cast("int"))

    counts = scattered.groupBy("__bucket").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    places = counts.select("__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"), F.sum("__n").over(whole).alias("__all"))
    placed = scattered.join(places, "__bucket")  # deals records out by bucket, as the shuffle of each bucket needs it anyway

    names = [*own, "size"]

    def run(bucket: pa.Table) -> pa.Table:
        n, number = bucket.num_rows, bucket.column("__bucket")[0].as_py()
        order = pc.sort_indices(bucket, sort_keys=[("__mark", "ascending"), (key, "ascending")])
        bucket = bucket.take(order.take(pa.array(fisher_yates(n, seed * 1_000_003 + number))))
        first, all_rows = bucket.column("__first")[0].as_py(), bucket.column("__all")[0].as_py()
        place = first + np.arange(n)
        of = place * shards // all_rows
        starts = -(-np.arange(shards) * all_rows // shards)
        return bucket.select(names).append_column("shard", pa.array(of.astype(np.int32))).append_column("slot", pa.array(place - starts[of]))

    schema = placed.select(*names).schema.add("shard", "integer").add("slot", "long")
    return placed.groupBy("__bucket").applyInArrow(run, schema)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, its records by slot within each file."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
