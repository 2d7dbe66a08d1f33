"""Digests used as keys: chunk ids, query keys, content hashes and the content fingerprint."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.functions.tokens import WHITESPACE

#: Hex digits: 65,536 groups.
FINGERPRINT_PREFIX = 4


def content_hash(text: Column) -> Column:
    """128-bit hex digest of a text, computed on the JVM."""
    return F.md5(text.cast("binary"))


@F.arrow_udf(T.StringType())
def xxh128(text: pa.Array) -> pa.Array:
    """128-bit xxHash hex digest, for byte parity with hashes stored by other tools."""
    import xxhash

    return pa.array(
        [None if t is None else xxhash.xxh128_hexdigest(t.encode("utf-8")) for t in text.to_pylist()],
        pa.string(),
    )


def chunk_id(url: Column, section: Column, index: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("::", url, section, index.cast("string")), 256), 1, 16)


def query_key(question: Column, top_k: Column, url_filter: Column) -> Column:
    normal = F.btrim(F.lower(question), F.lit(WHITESPACE))
    raw = F.concat_ws("||", normal, top_k.cast("string"), F.coalesce(url_filter, F.lit("")))
    return F.substring(F.sha2(raw, 256), 1, 20)


def content_fingerprint(hashes: DataFrame, column: str = "content_hash") -> DataFrame:
    """One row `fingerprint` that changes when the set of content hashes changes.

    The digest of the digests of prefix groups: distinct hashes are grouped by the first FINGERPRINT_PREFIX digits of their
    SHA-256, each group is sorted and digested by itself, and the groups, at most 16**FINGERPRINT_PREFIX, are sorted and digested
    again. No task sorts more than its groups, and the rule is the same at every size.
    """
    distinct = hashes.select(F.col(column).alias("h")).where("h IS NOT NULL").distinct()

    def digest_of(texts: Column) -> Column:
        return F.sha2(F.array_join(F.array_sort(F.collect_list(texts)), "|"), 256)

    groups = distinct.groupBy(F.substring(F.sha2("h", 256), 1, FINGERPRINT_PREFIX).alias("prefix"))
    inner = groups.agg(digest_of(F.col("h")).alias("digest"))
    return inner.agg(F.substring(digest_of(F.concat("prefix", "digest")), 1, 16).alias("fingerprint"))
