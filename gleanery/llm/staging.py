"""Tables between steps, written once to the folder all executors share.

A staged table cuts the lineage: a lost executor costs no step before it, and every reader of it sees the same rows. Staged
tables stay readable as long as the returned DataFrames may be used; `clear_staged` removes those of this process.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.session import ensure_checkpoint_dir

#: White space is space and \x09-\x0D; everything else belongs to words.
WORD = r"[^\x20\x09-\x0D]+"

_staged: list[str] = []


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/staged/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _staged.append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_staged(spark: SparkSession) -> None:
    """Delete the staged tables of this process; what was derived from them can't be read after."""
    while _staged:
        path = spark._jvm.org.apache.hadoop.fs.Path(_staged.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(taken: list[str], base: str) -> str:
    """A column name that is not taken yet, whatever the case."""
    lowered = {name.lower() for name in taken}
    while base.lower() in lowered:
        base += "_"
    return base


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash60(*parts: Column | str) -> Column:
    """60 bits of the MD5 of the parts, as a long; null parts count as such. The same value in any SQL engine."""
    texts = [F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *texts)), 1, 15), 16, 10).cast("long")


#: Keys with more than 1/HOT_KEYS of all rows are joined by broadcast: there are fewer than HOT_KEYS of them.
HOT_KEYS = 10_000


def join_counted(rows: DataFrame, keyed: DataFrame, key: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined to `keyed`, which has one row per key and in `count` how many rows the key has at most; `count` is dropped.

    total: at least the number of all rows. The hot keys, fewer than HOT_KEYS by this definition, go to every task; the others
    have few rows each and are shuffled. `rows` is read twice then, so it should be a narrow staged table.
    """
    least = max(total // HOT_KEYS, 100)
    hot = keyed.where(F.col(count) > least)
    values = [r[0] for r in hot.select(key).collect()]
    if not values:
        return rows.join(keyed.drop(count), key, how)
    is_hot = F.col(key).isin(values)
    cold = rows.where(~is_hot if how == "inner" else F.coalesce(~is_hot, F.lit(True))).join(keyed.drop(count), key, how)
    return rows.where(is_hot).join(F.broadcast(hot.drop(count)), key).unionByName(cold)
