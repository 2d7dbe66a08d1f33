"""Parquet tables keyed by url (or another key), replaced one hash bucket at a time.

A table is an ordinary partitioned parquet folder, so every reader prunes columns, row groups and
buckets. A change rewrites only the buckets of the touched keys with Spark's dynamic partition
overwrite, which writes beside the old files and swaps at commit and may therefore read the table it
writes to. Every rewritten bucket also gets one placeholder row with a null key, because dynamic
overwrite leaves a partition alone that receives no rows; readers filter it out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET = "key_bucket"
#: An empty file whose name ends in the table's number of buckets; readers ignore names that begin with an underscore.
MARKER = "_buckets-"


def folder_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "url", buckets: int = 16, sort_by: tuple[str, ...] = ()) -> None:
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets
        self.schema = T._parse_datatype_string(schema)
        self.sort_by = sort_by

    def _check_buckets(self, write: bool = False) -> None:
        """The number of buckets is kept beside the data: with another number, keys would be looked for in other buckets."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []
        kept = [int(name.removeprefix(MARKER)) for name in names if name.startswith(MARKER)]
        if any(n != self.buckets for n in kept):
            raise ValueError(f"{self.path} has {kept[0]} buckets, not {self.buckets}: rewrite it under another path to change that")
        if write and not kept:
            marker = self.spark._jvm.org.apache.hadoop.fs.Path(path, f"{MARKER}{self.buckets}")
            files.create(marker).close()

    @property
    def columns(self) -> list[str]:
        return self.schema.fieldNames()

    def bucket_of(self, key: str | Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def exists(self) -> bool:
        return folder_exists(self.spark, self.path)

    def read(self, with_bucket: bool = False) -> DataFrame:
        """All rows. With `with_bucket` the bucket stays visible, for joins that prune partitions."""
        kept = [*self.columns, BUCKET] if with_bucket else self.columns
        schema = T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])
        if not self.exists():
            return self.spark.createDataFrame([], schema).select(*kept)
        self._check_buckets()
        return self.spark.read.schema(schema).parquet(self.path).where(F.col(self.key).isNotNull()).select(*kept)

    def read_key(self, value: str, with_bucket: bool = False) -> DataFrame:
        """Rows of one key; only its bucket is listed and read."""
        rows = self.read(with_bucket=True)
        # The bucket of a literal folds to a constant, so it becomes a partition filter.
        rows = rows.where((F.col(BUCKET) == self.bucket_of(F.lit(value))) & (F.col(self.key) == value))
        return rows if with_bucket else rows.select(*self.columns)

    def replace(self, touched: DataFrame, rows: DataFrame | None = None) -> list[int]:
        """Drop all rows of the `touched` keys, then add `rows` (of touched keys only). Returns the
        rewritten buckets.

        `touched` should be materialised: it is read twice. The list of bucket numbers that comes to
        the driver has at most `buckets` entries.
        """
        keys = touched.select(self.key).where(F.col(self.key).isNotNull()).distinct()
        numbers = [r[0] for r in keys.select(self.bucket_of(self.key).alias("b")).distinct().collect()]
        if not numbers:
            return numbers
        rest = self.read(with_bucket=True).where(F.col(BUCKET).isin(numbers))
        rest = rest.join(keys, self.key, "left_anti").select(*self.columns)
        whole = rest if rows is None else rest.unionByName(rows.select(*self.columns))
        self.write_buckets(whole.withColumn(BUCKET, self.bucket_of(self.key)), numbers)
        return numbers

    def rewrite(self, rows: DataFrame) -> None:
        """Replace the whole table."""
        named = rows.select(*self.columns).withColumn(BUCKET, self.bucket_of(self.key))
        self.write_buckets(named, list(range(self.buckets)))

    def clear(self) -> None:
        if self.exists():
            self.rewrite(self.spark.createDataFrame([], self.schema))

    def write_buckets(self, named: DataFrame, numbers: list[int]) -> None:
        """Swap the content of these buckets for `named`, rows that carry their bucket."""
        self._check_buckets(write=True)
        blank = self.spark.createDataFrame([(n,) for n in numbers], f"{BUCKET} int")
        whole = named.unionByName(blank, allowMissingColumns=True)
        # Rebalancing by bucket: adaptive execution splits a bucket that one large key dominates and
        # merges small ones, so neither one huge task nor many tiny files result.
        whole = whole.hint("rebalance", BUCKET).sortWithinPartitions(BUCKET, *self.sort_by)
        (
            whole.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(BUCKET)
            .parquet(self.path)
        )
