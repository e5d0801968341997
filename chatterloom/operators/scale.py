"""Building blocks that keep operators balanced when one key holds much of the data."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from chatterloom.session import ensure_checkpoint_dir

# Rows a lookup may have to be folded into expressions; larger ones are joined instead.
INLINE_ROWS = 5_000
# Rows a lookup may have to be sent to every executor with a broadcast hint.
BROADCAST_ROWS = 500_000
# Most comments (or tokens) nested into one output row.
NEST_ROWS = 10_000
# Right rows of one key from which a left join is cut into parts.
SPLIT_ROWS = 1_000_000
# Hash buckets in which keys are counted before any key is.
KEY_BUCKETS = 1 << 16
# Characters of a block of rows that meets its part of a large lookup.
BLOCK_CHARS = 4_000_000
# Rows that are compressed together before they move.
PACKED_ROWS = 1_000_000
# Characters of all rows for each bucket of a large lookup.
BUCKET_CHARS = 16_000_000
# Characters of a part of texts whose pieces are grouped or sorted.
PART_CHARS = 8_000_000


# With this setting a query removes its shuffle files when it ends, else they stay until the driver collects its garbage.
SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Queries that are planned inside remove their shuffle files when they end."""
    before = spark.conf.get(SHUFFLES_END, None)
    spark.conf.set(SHUFFLES_END, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_END)
        else:
            spark.conf.set(SHUFFLES_END, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows outlive lost executors and the plan starts afresh. What was shuffled for it is removed."""
    ensure_checkpoint_dir(df.sparkSession)
    with shuffles_end(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def discard(cut: DataFrame) -> None:
    """Removes the files of a table that ``cut_lineage`` has written; nothing may read it any more."""
    spark = cut.sparkSession
    file = cut._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        path = spark._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_rows(df: DataFrame, limit: int = INLINE_ROWS) -> list[Row] | None:
    """All rows of a lookup if it has at most ``limit`` of them, else ``None``."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def small_table(df: DataFrame, limit: int = BROADCAST_ROWS) -> pd.DataFrame | None:
    """A lookup as a local table if it has at most ``limit`` rows, else ``None``."""
    table = df.limit(limit + 1).toPandas()
    return table if len(table) <= limit else None


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint behind a bounded row count; otherwise leave the join to AQE."""
    with shuffles_end(df.sparkSession):
        small = df.limit(limit + 1).count() <= limit
    return F.broadcast(df) if small else df


def kept_table(df: DataFrame) -> DataFrame:
    """The rows as a compressed table beside the checkpoints, read from there as often as needed."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    path = f"{base.rstrip('/')}/rows-{uuid.uuid4().hex}"
    with shuffles_end(spark):
        df.select("*").write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def nullable(kind: T.DataType) -> T.DataType:
    """The type with nulls allowed at every depth."""
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(nullable(kind.elementType))
    if isinstance(kind, T.MapType):
        return T.MapType(nullable(kind.keyType), nullable(kind.valueType))
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, nullable(f.dataType)) for f in kind.fields])
    return kind


def tight(content: bytes | pa.Buffer) -> bytes:
    """Compressed, behind its length."""
    return len(content).to_bytes(8, "little") + pa.compress(content, "zstd", asbytes=True)


def loose(content: bytes) -> bytes:
    size = int.from_bytes(content[:8], "little")
    return pa.decompress(content[8:], size, "zstd", asbytes=True) if size else b""


def _closed(table: pa.Table) -> bytes:
    """A table as compressed bytes."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def _opened(content: bytes) -> pa.Table:
    return pa.ipc.open_stream(content).read_all()


def word_hashes(words: pa.Array) -> np.ndarray:
    """One number per word, the same in every task."""
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False)


PACKED = "block long, bucket int, content binary"


def _packed_block(block: int, rows: pa.Table, form: pa.Schema, buckets: int) -> Iterator[pa.RecordBatch]:
    """The rows of a block in one row, then the distinct words that it looks up, one row per bucket."""
    row = lambda bucket, content: pa.RecordBatch.from_arrays([pa.array([block]), pa.array([bucket], pa.int32()), pa.array([content], pa.binary())], ["block", "bucket", "content"])
    yield row(None, _closed(rows.drop_columns(["_size", "_words"]).cast(form)))
    lists = pa.concat_arrays([c.cast(pa.list_(pa.large_string())).flatten() for c in rows.column("_words").chunks])
    words = lists.unique().drop_null()
    words = words.take(pc.array_sort_indices(words))
    bucket = word_hashes(words) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order].astype(np.int64)
    ends = np.flatnonzero(np.diff(bucket, append=-1))
    for first, last in zip([0, *(ends[:-1] + 1)], ends):
        yield row(int(bucket[first]), _closed(pa.table({"word": words.take(pa.array(order[first : last + 1]))})))


def _found_entries(sent: pa.Table, entries: pa.Table) -> pa.Table:
    """For the words of every block its entries, ``block, found``."""
    words = [_opened(c.as_py()).column("word").combine_chunks() for c in sent.column("content")]
    known = entries.column("word").cast(pa.large_string())
    at = pc.index_in(pa.chunked_array(words, pa.large_string()), value_set=known).combine_chunks()
    ends = np.cumsum([0, *map(len, words)])
    entries = entries.drop_columns(["_bucket"])
    found = [_closed(entries.take(at.slice(a, b - a).drop_null())) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
    return pa.table({"_of": sent.column("block"), "found": pa.array(found, pa.binary())})


def with_entries(
    rows: DataFrame,
    size: Column,
    words: Column,
    entries: DataFrame,
    work: Callable[[pa.Table, pa.Table], pa.Table],
    schema: T.StructType,
    block_chars: int = BLOCK_CHARS,
    derived: dict[str, Column] | None = None,
    bucket_chars: int = BUCKET_CHARS,
) -> DataFrame:
    """``work(rows, entries)`` over blocks of neighbouring rows, each beside the lookup entries that occur in it.

    ``size`` tells the characters of a row, ``words`` lists the keys it looks up in ``entries`` (one row per ``word``). A lookup of any size
    is met by the distinct words of a block, not by every occurrence. Everything moves compressed: the rows of a block in one row, its words
    in one row per bucket of about ``bucket_chars`` characters of all rows, and the entries found there in one row again. ``derived``
    columns are made for ``words`` only and don't move.
    """
    kept, form = rows.columns, to_arrow_schema(nullable(rows.schema))
    sized = rows.withColumns({"_size": F.coalesce(size.cast("bigint"), F.lit(0)), **(derived or {})})
    total = sized.agg(F.sum("_size")).first()[0] or 0
    buckets = max(rows.sparkSession.sparkContext.defaultParallelism, -(-total // bucket_chars))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made, waiting, chars = TaskContext.get().partitionId() << 33, 0, [], 0
        for batch in batches:
            ends = np.concatenate([[0], np.cumsum(batch.column("_size").to_numpy())])
            start = 0
            while start < len(batch):
                stop = max(start + 1, int(np.searchsorted(ends, ends[start] + block_chars - chars, "right")) - 1)
                waiting.append(batch.slice(start, stop - start))
                chars += int(ends[stop] - ends[start])
                start = stop
                if chars >= block_chars or start < len(batch):
                    yield from _packed_block(first + made, pa.Table.from_batches(waiting), form, buckets)
                    made, waiting, chars = made + 1, [], 0
        if waiting:
            yield from _packed_block(first + made, pa.Table.from_batches(waiting), form, buckets)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            bucket = word_hashes(x.column("word").cast(pa.large_string())) % np.uint64(buckets)
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array(bucket.astype(np.int32))], [*x.schema.names, "_bucket"])

    def meet(block: pa.Table, found: pa.Table) -> pa.Table:
        parts = [_opened(c.as_py()) for c in found.column("found")] or [nothing]
        own = [_opened(c.as_py()) for c in block.column("content")]
        return work(pa.concat_tables(own), pa.concat_tables(parts))

    packed = cut_lineage(sized.select(*kept, "_size", words.alias("_words")).mapInArrow(pack, PACKED))
    lookup = T.StructType([*nullable(entries.schema).fields, T.StructField("_bucket", T.IntegerType())])
    nothing = to_arrow_schema(nullable(entries.schema)).empty_table()
    sent = packed.where("bucket IS NOT NULL").groupBy("bucket")
    found = sent.cogroup(entries.where("word IS NOT NULL").mapInArrow(dealt, lookup).groupBy("_bucket")).applyInArrow(_found_entries, "_of long, found binary")
    found = cut_lineage(found.where("found IS NOT NULL"))
    return packed.where("bucket IS NULL").groupBy("block").cogroup(found.groupBy("_of")).applyInArrow(meet, schema)


def with_whole_keys(rows: DataFrame, keys: Sequence[str], work: Callable[[pa.Table], pa.Table], schema: T.StructType, block_rows: int = PACKED_ROWS) -> DataFrame:
    """``work`` over tables that hold all rows of each of their keys, null ones included.

    Rows move compressed, column by column, one row for each block of ``block_rows`` rows and bucket of keys; there are twice as many buckets as shuffle
    partitions, and a task holds one bucket at a time.
    """
    buckets = 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    form = to_arrow_schema(nullable(rows.schema))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0

        def told() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(waiting)
            bucket = table.column("_bucket").to_numpy()
            order = np.argsort(bucket, kind="stable")
            ends = np.flatnonzero(np.diff(bucket[order], append=-1))
            table = table.drop_columns(["_bucket"]).cast(form).take(pa.array(order))
            for first, last in zip([0, *(ends[:-1] + 1).tolist()], ends.tolist()):
                content = _closed(table.slice(first, last + 1 - first))
                yield pa.RecordBatch.from_arrays([pa.array([bucket[order[last]]], pa.int32()), pa.array([content], pa.binary())], ["bucket", "content"])

        for batch in batches:
            waiting.append(batch)
            n += len(batch)
            if n >= block_rows:
                yield from told()
                waiting, n = [], 0
        if n:
            yield from told()

    def whole(packed: pa.Table) -> pa.Table:
        return work(pa.concat_tables([_opened(c.as_py()) for c in packed.column("content")]).combine_chunks())

    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    packed = rows.withColumn("_bucket", bucket).mapInArrow(pack, "bucket int, content binary")
    return packed.groupBy("bucket").applyInArrow(whole, schema)


def spread_few_files(df: DataFrame, key: str) -> DataFrame:
    """Use all cores for a table of fewer files than cores; larger tables are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if len(df.inputFiles()) < cores else df


def in_order(df: DataFrame, key: str, text: str, chars: int = PART_CHARS) -> DataFrame:
    """Whole rows dealt out in ranges of ``key``, each of about ``chars`` characters of ``text``.

    What is cut out of the texts later and grouped or sorted by ``key`` is where it belongs then: texts move once, their
    pieces don't, and no task holds more pieces than those of its part.
    """
    size = df.agg(F.sum(F.length(text).cast("bigint"))).first()[0] or 0
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartitionByRange(max(cores, -(-size // chars)), key)


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal names in which null meets null; the columns of ``left``, then the other ones of ``right``."""
    names = {k: f"_right_{i}" for i, k in enumerate(keys)}
    right = right.withColumnsRenamed(names)
    condition = F.lit(True)
    for key, name in names.items():
        condition = condition & left[key].eqNullSafe(right[name])
    return left.join(right, condition, how).drop(*names.values())


def last_per_key(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Keep the row with the highest ``order`` per key; ``max_by`` combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c != order]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row"))
    return picked.select(*keys, "_row.*")


def global_rank(
    df: DataFrame,
    order_by: Sequence[Column],
    partition_by: Sequence[str] = (),
    name: str = "rank",
    start: int = 1,
) -> DataFrame:
    """Dense position of every row in a total order, overall or per group.

    A range sort spreads even one huge group over all tasks. The sorted slices are
    checkpointed, so their numbering survives lost executors; then one number per slice (and
    the first position per group) turns local row numbers into ranks.
    """
    groups = list(partition_by)
    row_in_slice = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = df.orderBy(*groups, *order_by).select(
        "*", F.spark_partition_id().alias("_slice"), row_in_slice.alias("_row")
    )
    placed = cut_lineage(placed)
    sizes = placed.groupBy("_slice").agg((F.max("_row") + 1).alias("_size"))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    # One row per sort task: bounded by the number of shuffle partitions.
    starts = sizes.select("_slice", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    ranked = placed.join(F.broadcast(starts), "_slice").withColumn("_at", F.col("_start") + F.col("_row"))
    if groups:
        first = ranked.groupBy(*groups).agg(F.min("_at").alias("_first"))
        ranked = join_null_safe(ranked, first, groups).withColumn("_at", F.col("_at") - F.col("_first"))
    return ranked.withColumn(name, F.col("_at") + F.lit(start)).drop(
        "_slice", "_row", "_start", "_at", "_first"
    )


def hot_keys(df: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """Keys with more than ``size`` rows and in how many parts of about that size (``parts``) they go."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > size)
    return counted.select(*keys, F.ceil(F.col("_n") / size).alias("parts"))


def _may_be_hot(df: DataFrame, keys: Sequence[str], size: int) -> DataFrame | None:
    """The rows in hash buckets of more than ``size`` rows, which hold every hot key; ``None`` if there is no such bucket.

    One pass over the keys; a task sends at most one count for each bucket.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(KEY_BUCKETS))
    full = df.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > size).select("_bucket").collect()
    if not full:
        return None
    if len(full) == KEY_BUCKETS:
        return df
    return df.join(F.broadcast(df.sparkSession.createDataFrame(full, "_bucket bigint")), bucket == F.col("_bucket"), "left_semi")


def split_left_join(left: DataFrame, right: DataFrame, keys: Sequence[str], size: int = SPLIT_ROWS) -> DataFrame:
    """Left outer join whose right side may hold very hot keys.

    AQE cannot split the right side of a left outer join. Keys of more than ``size`` right rows are cut into parts by a
    hash of all columns; their left rows meet each part, and of those copies only the ones with a partner stay. All
    other keys are joined as they are, and without hot keys this is the plain join. Null keys meet nothing.
    """
    keys = list(keys)
    suspects = _may_be_hot(right.select(*keys), keys, size)
    hot = None if suspects is None else cut_lineage(hot_keys(suspects, keys, size))
    if hot is None or hot.isEmpty():
        return left.join(right, keys, "left")
    hot = broadcast_if_small(hot)
    part = F.coalesce(F.pmod(F.xxhash64(*right.columns), F.col("parts")), F.lit(0))
    cut = right.join(hot, keys, "left").withColumn("_part", part).withColumn("_there", F.lit(True)).drop("parts")
    copies = F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("parts", F.lit(1)) - 1))
    spread = left.join(hot, keys, "left").withColumn("_part", copies)
    joined = spread.join(cut, [*keys, "_part"], "left").where(F.col("parts").isNull() | F.col("_there"))
    return joined.drop("parts", "_part", "_there")


def lagged(
    df: DataFrame,
    group: Sequence[str],
    pos: str,
    value: str,
    default: object,
    name: str,
    block: int = 1_000_000,
) -> DataFrame:
    """Previous value in ``pos`` order (dense, from 0) inside each group.

    The window runs per block of ``block`` positions; the last row of a block is also sent to the
    next block as a carrier, so a group of any length is spread over many tasks.
    """
    group = list(group)
    at = F.col(pos)
    own = F.floor(at / block)
    blocks = F.when(
        at % block == block - 1,
        F.array(F.struct(own.alias("b"), F.lit(False).alias("c")), F.struct((own + 1).alias("b"), F.lit(True).alias("c"))),
    ).otherwise(F.array(F.struct(own.alias("b"), F.lit(False).alias("c"))))
    spread = df.select("*", F.explode(blocks).alias("_blk")).select("*", F.col("_blk.b").alias("_b"), F.col("_blk.c").alias("_c"))
    w = Window.partitionBy(*group, "_b").orderBy(pos)
    return (
        spread.withColumn(name, F.lag(value, 1, default).over(w))
        .where(~F.col("_c"))
        .drop("_blk", "_b", "_c")
    )


def running_sum(
    df: DataFrame, group: Sequence[str], pos: str, value: Column, name: str, block: int = 1_000_000
) -> DataFrame:
    """Sum of ``value`` over all earlier rows of the group (own row excluded), block by block."""
    group = list(group)
    blocked = df.withColumn("_v", value).withColumn("_b", F.floor(F.col(pos) / block))
    totals = blocked.groupBy(*group, "_b").agg(F.sum("_v").alias("_t"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*group, "_b", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_carry"))
    inside = Window.partitionBy(*group, "_b").orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    return (
        blocked.withColumn("_in", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
        .transform(lambda df: join_null_safe(df, carry, [*group, "_b"]))
        .withColumn(name, F.col("_in") + F.col("_carry"))
        .drop("_v", "_b", "_in", "_carry")
    )
