"""Pages and buckets of the store file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvspace.operators.paging import page

PAGE_SORTS = {"page_id": "page_id", "total_bytes": "total_bytes", "utilization": "utilization"}
_KNOWN = ("meta", "freelist", "free", "branch", "leaf")


def space_summary(pages: DataFrame, page_size: int, file_size: int | None = None) -> DataFrame:
    """One row: pages by type, free and used bytes, fragmentation.

    Meta, freelist, free and unknown pages count with the pages they run over into; branch
    and leaf pages count once, and what they run over into counts apart. Without a stated
    file size, it is that of all pages.
    """
    span = F.when((F.col("page_type") != "free") & (F.col("overflow") > 0), F.col("overflow") + 1).otherwise(1)
    kind = F.when(F.col("page_type").isin(*_KNOWN), F.col("page_type")).otherwise("unknown")
    spans = lambda k: F.coalesce(F.sum(F.when(kind == k, span)), F.lit(0)).cast("bigint")
    own = lambda k: F.count_if(kind == k)
    rows = pages.agg(
        F.coalesce(F.sum(span), F.lit(0)).cast("bigint").alias("page_count"),
        spans("meta").alias("meta_pages"), own("branch").alias("branch_pages"), own("leaf").alias("leaf_pages"), spans("freelist").alias("freelist_pages"),
        F.coalesce(F.sum(F.when(kind.isin("branch", "leaf"), F.col("overflow"))), F.lit(0)).cast("bigint").alias("overflow_pages"),
        spans("free").alias("free_pages"), spans("unknown").alias("unknown_pages"),
        F.coalesce(F.sum("free_bytes"), F.lit(0)).cast("bigint").alias("_free"),
    )
    size = F.lit(file_size).cast("bigint") if file_size is not None else F.col("page_count") * page_size
    free = F.least(F.col("_free"), size)
    return rows.select(
        size.alias("physical_file_size"), F.lit(page_size).cast("bigint").alias("page_size"), "page_count",
        (size - free).alias("in_use_page_bytes"), free.alias("free_page_bytes"), F.when(size > 0, free / size).otherwise(0.0).alias("fragmentation_ratio"),
        "meta_pages", "branch_pages", "leaf_pages", "freelist_pages", "overflow_pages", "free_pages", "unknown_pages",
    )


def bucket_rollup(buckets: DataFrame) -> DataFrame:
    """Sizes of every bucket together with the buckets below it."""
    parts = F.split("bucket_path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    sums = ("key_count", "branch_bytes", "leaf_bytes", "overflow_bytes", "total_bytes", "used_bytes")
    spread = buckets.select(F.posexplode(up).alias("at", "bucket"), *sums)
    return spread.groupBy(F.col("bucket").alias("bucket_path"), (F.col("at") + 1).cast("bigint").alias("depth")).agg(F.count("*").alias("buckets"), *[F.sum(c).cast("bigint").alias(c) for c in sums])


def query_pages(pages: DataFrame, page_type: str | None = None, sort: str = "page_id", descending: bool = False, number: int = 1, size: int = 100) -> DataFrame:
    return page(pages if page_type is None else pages.filter(F.col("page_type") == page_type), PAGE_SORTS, sort, descending, ("page_id",), number, size)


def top_buckets(buckets: DataFrame, n: int) -> DataFrame:
    return buckets.orderBy(F.desc("total_bytes"), "bucket_path").limit(n)
