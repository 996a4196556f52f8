"""Shuffled shards by a two-pass external shuffle.

Pass one scatters the rows by a seeded hash into buckets that fit a task's memory. Pass two draws each
bucket's order by Fisher-Yates (numpy's permutation, seeded by bucket) and writes it. A row's place in the
shuffled whole is its bucket's offset plus its place in the bucket; dealing places to shards in turn gives
the law ``rows``: shard sizes differ by one at most and slots have no gaps.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlode.llm.shared import shared_path, unused

#: Bytes of text that a bucket holds on average.
BUCKET_BYTES = 8 << 20
#: Buckets beyond which they grow instead; bounds the counts that reach the driver and the offsets sent back
#: (12 bytes each). At 100 TB a bucket holds 250 MB.
MAX_BUCKETS = 400_000


def shuffled_shards(
    docs: DataFrame, shards: int = 16, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, path: str | None = None
) -> DataFrame:
    """Writes the rows of ``docs`` shuffled into ``shards`` shards and returns the written table.

    The table has the columns of ``docs`` and ``shard``, ``slot`` (replacing columns of those names), one
    folder a shard. The bucket of a row is a seeded hash of its id and text, so the result depends on rows
    and seed, not on how the input is split; rows equal in both are interchangeable. Null ids and texts hash
    like values. Only bucket counts reach the driver: their number is the input's size over ``bucket_bytes``, MAX_BUCKETS at most.
    An empty table writes an empty table.
    """
    spark = docs.sparkSession
    cols = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    bucket_, key_, place_, start_ = unused(docs, "bucket", "key", "place", "start")
    size = F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)) + 1
    total = docs.agg(F.sum(size.cast("long")).alias("b")).first().b or 0
    n = min(max(1, -(-total // bucket_bytes)), MAX_BUCKETS)
    # two seeds for the hash: bucket and order within it must not depend on each other
    key = lambda s: F.xxhash64(F.lit(seed + s), F.col(id_col), F.col(text_col))
    named = docs.select(*cols, F.pmod(key(0), F.lit(n)).cast("int").alias(bucket_), key(1).alias(key_))
    sizes = {r[bucket_]: r["count"] for r in named.groupBy(bucket_).count().collect()}
    starts = [0, *accumulate(sizes.get(b, 0) for b in range(n))]
    offset = spark.createDataFrame([(b, starts[b]) for b in range(n)], f"{bucket_} int, {start_} long")
    dealt = named.repartition(n, bucket_).sortWithinPartitions(bucket_, key_, id_col)
    schema = docs.select(*cols).schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    def fisher_yates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def drawn(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(parts)
            b = t[bucket_][0].as_py()
            order = np.random.default_rng([seed, b]).permutation(len(t))  # order[i]: the row at place i
            place = np.arange(len(t), dtype=np.int64)
            t = t.drop_columns([key_])
            for i in range(0, len(t), 500):
                part = t.take(order[i : i + 500]).append_column(place_, pa.array(place[i : i + 500]))
                yield from part.combine_chunks().to_batches()

        held: list[pa.RecordBatch] = []
        for batch in batches:
            at = 0
            ids = batch.column(batch.schema.get_field_index(bucket_)).to_numpy(zero_copy_only=False)
            for cut in [*(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]:
                if cut == at:
                    continue
                if held and held[0].column(held[0].schema.get_field_index(bucket_))[0].as_py() != ids[at]:
                    yield from drawn(held)
                    held = []
                held.append(batch.slice(at, cut - at))
                at = cut
        if held:
            yield from drawn(held)

    placed = dealt.mapInArrow(fisher_yates, f"{fields}, {bucket_} int, {place_} long")
    at = F.col(start_) + F.col(place_)
    placed = placed.join(F.broadcast(offset), bucket_)
    out = placed.select(*cols, (at % shards).cast("int").alias("shard"), F.expr(f"({start_} + {place_}) div {shards}").alias("slot"))
    path = path or shared_path(spark, "shards")
    out.write.option("compression", "zstd").partitionBy("shard").parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def op7_shards(docs: DataFrame) -> DataFrame:
    """The contract's columns, read from the written shards of whole ``documents``; law: rows."""
    d = shuffled_shards(docs)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return d.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
