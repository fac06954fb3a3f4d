"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Only a local session may leave it unset."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="strandloom-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def apart(df: DataFrame, *names: str) -> tuple[str, ...]:
    """The names, longer where df has columns of them, whatever the case of its letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return tuple(out)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it back. The files go when the JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str, total: int, rows: int = 20_000, bucket: Column | None = None) -> DataFrame:
    """Number the rows of each key from 0 without gaps, as column `name`.

    A key's rows are dealt by a hash of `order`, or by `bucket`, to buckets of about `rows`; ranks are taken in
    a bucket and moved by the sizes of the buckets before it, so that no task holds a whole hot key. Ranks
    follow `order` throughout if `bucket` rises with it. `total` is the number of rows. df must give the same
    rows when it is read again.
    """
    n = max(1, -(-total // rows))
    dealt = df.withColumn("_rank_b", (F.pmod(F.xxhash64(*order), F.lit(n)) if bucket is None else bucket).cast("int"))
    local = dealt.withColumn(name, F.row_number().over(Window.partitionBy(*keys, "_rank_b").orderBy(*order)) - 1)
    before = Window.partitionBy(*keys).orderBy("_rank_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(*keys, "_rank_b").agg(F.count("*").alias("_rank_n"))
    starts = sizes.select(*(F.col(k).alias(f"_rank_k{i}") for i, k in enumerate(keys)), F.col("_rank_b").alias("_rank_s"), F.coalesce(F.sum("_rank_n").over(before), F.lit(0)).alias("_rank_o"))
    on = [F.col(k).eqNullSafe(F.col(f"_rank_k{i}")) for i, k in enumerate(keys)] + [F.col("_rank_b") == F.col("_rank_s")]
    return local.join(starts, on).withColumn(name, (F.col(name) + F.col("_rank_o")).cast("long")).select(*df.columns, name)


def sliced(batch: pa.RecordBatch, rows: int = 2000, size: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most `rows` rows and about `size` bytes of texts; a longer text is a slice of its own."""
    total = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            total += pa.compute.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    ends, lo = np.cumsum(total), 0
    while lo < batch.num_rows:
        before = ends[lo - 1] if lo else 0
        hi = min(lo + rows, max(lo + 1, int(np.searchsorted(ends, before + size, side="right"))))
        yield batch.slice(lo, hi - lo)
        lo = hi


def per_batch(df: DataFrame, f: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """mapInArrow with a function from a batch, bounded in rows and bytes, to the columns of the result."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                columns = f(part)
                yield pa.RecordBatch.from_arrays([pa.array(columns[c.name], c.type) for c in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 50_000) -> Iterator[pa.Table]:
    """From a partition sorted by keys: tables of about `rows` rows that hold each key whole."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(held)
        last = np.ones(n, bool)
        for k in keys:
            column = table.column(k).to_numpy()
            last &= column == column[-1]
        cut = n - int(last[::-1].argmin()) if not last.all() else 0
        if cut:
            yield table.slice(0, cut)
        held, n = table.slice(cut).combine_chunks().to_batches(), n - cut
    if n:
        yield pa.Table.from_batches(held)


def one_of_each(documents: DataFrame, heads: DataFrame) -> DataFrame:
    """The rows of documents named by heads(doc_id, h), h the xxhash64 of the text, each once, and those without doc_id.

    Only rows that are there more than once are shuffled with their texts.
    """
    d, h, n = apart(documents, "_d", "_h", "_n")
    text = F.xxhash64(documents["text"])
    times = documents.where("doc_id IS NOT NULL").groupBy(documents["doc_id"].cast("long").alias(d), text.alias(h)).agg(F.count("*").alias(n))
    named = heads.select(F.col("doc_id").alias("_of"), F.col("h").alias("_text"))
    keep = stored(times.join(named, (F.col(d) == F.col("_of")) & (F.col(h) == F.col("_text"))).select(d, h, n), "heads")
    on = (documents["doc_id"].cast("long") == F.col(d)) & (text == F.col(h))
    once = documents.join(keep.where(F.col(n) == 1), on, "left").where(F.col(d).isNotNull() | documents["doc_id"].isNull()).drop(d, h, n)
    many = keep.where(F.col(n) > 1)
    if many.isEmpty():
        return once
    return once.union(documents.join(many, on).dropDuplicates([d, h]).select(*(documents[c] for c in documents.columns)))


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id's text falls into the fold that is kept from training (null ids: no)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def labelled_rows(documents: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, rows: int) -> DataFrame:
    """(doc, text, y) of at most `rows` labelled documents outside the held-out fold, chosen by a hash of doc_id.

    The chosen ids have a fixed bound and are broadcast. Null texts count as empty.
    """
    picked = (
        labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("_id"), folds, fold))
        .groupBy("_id")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(rows)
    )
    texts = documents.select(F.col("doc_id").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(picked), F.col("doc") == F.col("_id")).select("doc", "text", "y")


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, rows: int, longest: int = 65_536) -> list[tuple[str, int]]:
    """The texts and labels of labelled_rows(), on the driver, in an order of their own. Texts of over `longest` bytes
    are not learnt from, so that rows * longest bounds what the driver holds."""
    got = labelled_rows(documents, labels, label, folds, fold, rows).where(F.octet_length("text") <= longest).collect()
    return [(r["text"], r["y"]) for r in sorted(got, key=lambda r: (r["doc"], r["text"]))]
