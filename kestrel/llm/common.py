"""Shared helpers of the training-data operators: scratch tables, hashing, tokens."""

from __future__ import annotations

import atexit
import contextlib
import functools
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more rows than this share of a table, or than KEY_ROWS, is joined apart.
HOT_SHARE, KEY_ROWS = 10_000, 10_000
#: Characters that separate words (space and x09-x0D); bytes.split() splits on the same.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


#: Bytes of a batch that goes to a Python worker, the same for all operators.
BATCH_BYTES = 4 << 20


def bounded(spark: SparkSession) -> None:
    """Sees to it that batches for workers have BATCH_BYTES at most, unless the session's own bound is lower."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub("[^0-9]", "", spark.conf.get(name)) or 0) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most `rows` rows and, but for single rows, about `most` bytes: what a worker turns into Python objects at once.

    What Spark sends at once is bounded by bytes (`bounded`).
    """
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * most // max(1, batch.get_total_buffer_size())))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or on a local master an own one where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="kestrel-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        base = "file://" + own
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


@functools.cache
def _folder(base: str, application: str) -> str:
    """The scratch folder of an application, deleted as the driver ends: results that are read lazily need their tables until then."""
    path = f"{base}/kestrel/{application}"
    session = SparkSession.getActiveSession()
    if session is not None:
        where = session._jvm.org.apache.hadoop.fs.Path(path)
        system = where.getFileSystem(session._jsc.hadoopConfiguration())
        atexit.register(_delete, system, where)
    return path


def _delete(system, where) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone by then
        system.delete(where, True)


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{_folder(shared_dir(spark), spark.sparkContext.applicationId)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Cut the lineage: the rows as a Parquet table in the shared folder, and its path."""
    spark, path = df.sparkSession, new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def tokenizer(name: str) -> str:
    """Where a file of the public tokenizers lies; a path with a folder is taken as it is."""
    if os.path.dirname(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def fold(key: Column, of: int) -> Column:
    """crc32 of the id as text, modulo `of`; null for a null id."""
    return F.crc32(key.cast("string").cast("binary")) % of


def held_out(key: Column, of: int, remainder: int) -> Column:
    """True where the fold is `remainder`; rows without an id are not held out."""
    return F.coalesce(fold(key, of) == remainder, F.lit(False))


def learns(key: Column, of: int, remainder: int) -> Column:
    """Rows a model may learn from; rows without an id are never among them."""
    return F.coalesce(fold(key, of) != remainder, F.lit(False))


def chance(key: Column, salt: int = 0) -> Column:
    """A fixed number in [0, 1) for each id, for bounded samples that do not depend on order."""
    return F.pmod(F.xxhash64(key.cast("string"), F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)


def arrow(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def masked(docs: DataFrame, *needed: str) -> DataFrame:
    """The columns under the names c0, c1, ..., and `needed` ones again under their own, so that added names cannot clash."""
    bounded(docs.sparkSession)
    return docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)], *needed)


def unmasked(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])


def join_counted(rows: DataFrame, found: DataFrame, key: str, how: str = "left") -> DataFrame:
    """rows joined with `found`, which has each key once with the number `n` of its rows; `n` is left out.

    Keys of more than KEY_ROWS rows and more than 1 / HOT_SHARE of all rows number HOT_SHARE at
    most. These few are broadcast, so that their rows stay where they are; the others are shuffled.
    """
    total = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    limit = max(KEY_ROWS, total // HOT_SHARE)
    hot = found.filter(F.col("n") > limit).drop("n")
    cool = found.filter(F.col("n") <= limit).drop("n")
    if hot.isEmpty():
        return rows.join(cool, key, how)
    keys = F.broadcast(hot.select(key))
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(keys, key, "left_anti").join(cool, key, how))
