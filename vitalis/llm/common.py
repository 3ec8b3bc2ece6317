"""Helpers the operators share: table reading, Arrow column mapping, scratch tables.

Conventions of every operator in this subpackage
* An output column replaces an input column of the same name (names compare without case,
  as Spark resolves them); all other input columns pass through untouched.
* A null text counts as empty; an empty table gives an empty result with the full schema.
* Repeated rows are separate rows: each gets its own result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalis.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df`` without the columns that ``names`` would clash with."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def add_columns(df: DataFrame, fields: list[T.StructField], fn: Callable[[pa.RecordBatch], list[pa.Array]], by: str | None = None,
                leave: tuple[str, ...] = ()) -> DataFrame:
    """Append ``fields`` computed by ``fn`` from each Arrow batch; other columns pass as they are.

    ``by`` names a text column: batches are then cut so that each part holds a few MB of it.  Columns in ``leave``
    are read by ``fn`` but do not come back.
    """
    base = without(df, [f.name for f in fields])
    kept = [i for i, c in enumerate(base.columns) if c not in leave]
    names = [base.columns[i] for i in kept] + [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, by) if by else [whole]:
                yield pa.RecordBatch.from_arrays([b.column(i) for i in kept] + fn(b), names=names)

    return base.mapInArrow(run, T.StructType([base.schema.fields[i] for i in kept] + fields))


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    """The text column of a batch; null counts as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def slices(batch: pa.RecordBatch, name: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``most`` bytes of ``name`` (a longer row stays whole)."""
    col = batch.column(batch.schema.get_field_index(name))
    import pyarrow.compute as pc
    sizes = pc.fill_null(pc.binary_length(col), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def crc_mod(col: str, mod: int) -> Column:
    """crc32 of a column's text modulo ``mod``; a null counts as 0."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(mod), F.lit(0).cast("long"))


class Scratch:
    """Tables written to the shared checkpoint folder.

    ``keep`` writes a DataFrame there as Parquet and reads it back: lineage ends at files every
    executor can read, so a lost executor costs no upstream work.  Its Arrow batches are as small as ``BATCH``
    says, so that whole texts on their way to Python and back take little memory outside the heap.  ``drop``
    removes the folder, or one table that nothing reads any more.
    """

    BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}"
        self.n = 0
        self.paths: dict[int, tuple[str, DataFrame]] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        before = {k: self.spark.conf.get(k) for k in self.BATCH}
        try:
            for k, v in self.BATCH.items():
                self.spark.conf.set(k, v)
            df.write.parquet(path)
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, table: DataFrame | None = None) -> None:
        where = self.root if table is None else self.paths.pop(id(table))[0]
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
