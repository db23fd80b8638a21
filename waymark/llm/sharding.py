"""Extendible hashing of documents into shards under a byte limit, in DataFrame operations only.

A document's key hash gives 60 bits. Buckets are prefixes of these bits; a bucket over the limit,
and only such a bucket, splits on its next bit. The directory is laid over cells, prefixes of one
length for all, of which there are about ``2 ** SLACK_BITS`` for each shard. Buckets that one cell
cannot settle are taken up again on further bits with their own documents only. What the last bit
cannot part (rows of equal keys) goes to an overflow chain of the bucket, cut by running byte count.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.plans.storage import save

HASH_BITS = 60
SLACK_BITS = 6


def key_hash(key: Column) -> Column:
    """The first 60 bits of the MD5 of the key's text (null: empty), as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def _prefix(depth: int | Column) -> Column:
    return F.call_function("shiftright", F.col("h"), (F.lit(HASH_BITS) - depth).cast("int"))


def _settle(rows: DataFrame, top: int, depth: int, limit: int) -> DataFrame:
    """Cells at ``depth`` of these rows with the least local depth >= ``top`` whose bucket fits, or null."""
    cells = rows.groupBy(_prefix(F.lit(depth)).alias("cell")).agg(F.sum("n_bytes").alias("bytes"))
    levels = cells.select("cell", "bytes", F.explode(F.sequence(F.lit(top), F.lit(depth))).alias("level"))
    levels = levels.withColumn("bucket", F.call_function("shiftright", F.col("cell"), (F.lit(depth) - F.col("level")).cast("int")))
    fits = levels.groupBy("level", "bucket").agg(F.sum("bytes").alias("total")).where(F.col("total") <= limit)
    best = levels.join(fits, ["level", "bucket"], "left_semi").groupBy("cell").agg(F.min("level").alias("local_depth"))
    return cells.select("cell").join(best, "cell", "left")


def _overflow(rows: DataFrame, limit: int) -> DataFrame:
    """Chain of a full bucket: rows over half the limit stand alone, the rest fill half-limit steps.

    Positions come from sums per (bucket, task), so a bucket may be of any size.
    """
    rows = save(rows.withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id(), "half": F.greatest(F.lit(1), F.lit(limit // 2))}), "overflow")
    big = F.col("n_bytes") > F.col("half")
    of = rows.groupBy("h", "part").agg(F.sum(F.when(big, 0).otherwise(F.col("n_bytes"))).alias("b"), F.sum(big.cast("bigint")).alias("k"))
    before = Window.partitionBy("h").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    of = of.select("h", "part", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"), F.coalesce(F.sum("k").over(before), F.lit(0)).alias("k0"))
    upto = Window.partitionBy("h", "part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(of, ["h", "part"])
    small = F.col("b0") + F.coalesce(F.sum(F.when(big, 0).otherwise(F.col("n_bytes"))).over(upto), F.lit(0))
    alone = F.col("k0") + F.coalesce(F.sum(big.cast("bigint")).over(upto), F.lit(0))
    chain = F.when(big, -1 - alone).otherwise(F.call_function("div", small, F.col("half")))
    return rows.select("doc_id", "h", "n_bytes", F.lit(HASH_BITS).alias("local_depth"), chain.alias("chain"))


def assign_shards(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_bytes, local_depth, prefix, chain, shard, oversized``.

    ``n_bytes`` counts UTF-8 bytes (null text: 0). ``shard`` names the bucket by its bits (``*`` for
    the whole space), with ``+k`` or ``-k`` for a link of an overflow chain. No shard exceeds
    ``limit`` but one that holds a single document longer than it, which is marked ``oversized``.
    Null ids hash as the empty text; repeated rows stay together until the chain parts them; an
    empty table gives an empty result; other columns are ignored whatever their names.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("bigint")
    rows = save(docs.select(F.col(id_col).alias("doc_id"), key_hash(F.col(id_col)).alias("h"), size.alias("n_bytes")), "shard-keys")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    top, depth, done = 0, min(HASH_BITS, SLACK_BITS + max(0, ceil(log2(max(1, total / limit))))), []
    while True:
        cells = save(_settle(rows, top, depth, limit), "shard-cells")
        placed = rows.withColumn("cell", _prefix(F.lit(depth))).join(cells.where("local_depth is not null"), "cell")
        done.append(placed.select("doc_id", "h", "n_bytes", "local_depth", F.lit(0).cast("bigint").alias("chain")))
        full = cells.where("local_depth is null")
        if full.isEmpty():
            break
        rows = save(rows.withColumn("cell", _prefix(F.lit(depth))).join(full.select("cell"), "cell", "left_semi").select("doc_id", "h", "n_bytes"), "shard-rest")
        if depth == HASH_BITS:
            done.append(_overflow(rows, limit))
            break
        top, depth = depth + 1, min(HASH_BITS, depth + 2 * SLACK_BITS)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    prefix = _prefix(F.col("local_depth"))
    bits = F.when(F.col("local_depth") == 0, F.lit("*")).otherwise(F.expr("lpad(bin(shiftright(h, 60 - local_depth)), local_depth, '0')"))
    link = F.when(F.col("chain") > 0, F.concat(F.lit("+"), F.col("chain"))).when(F.col("chain") < 0, F.col("chain").cast("string")).otherwise(F.lit(""))
    return out.select("doc_id", "n_bytes", F.col("local_depth").cast("int").alias("local_depth"), prefix.alias("prefix"), "chain", F.concat(bits, link).alias("shard"), (F.col("n_bytes") > limit).alias("oversized"))


def write_shards(docs: DataFrame, limit: int, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the documents as one folder per shard. Ids must be unique and not null here."""
    of = assign_shards(docs, limit, id_col, text_col).select(F.col("doc_id").alias(id_col), "shard")
    docs.join(of, id_col).repartition("shard").write.partitionBy("shard").parquet(path)


def oracle(limit: int, table: str = "documents") -> str:
    """The same in DuckDB, for tables whose keys part within 60 bits."""
    return f"""
    WITH k AS (SELECT doc_id, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h,
                      coalesce(strlen(text), 0)::BIGINT AS n_bytes FROM {table}),
    d AS (SELECT unnest(generate_series(0, 60))::INT AS level),
    b AS (SELECT level, h >> (60 - level) AS bucket, sum(n_bytes) AS total FROM k, d GROUP BY ALL HAVING sum(n_bytes) <= {limit}),
    m AS (SELECT k.h, min(b.level) AS local_depth FROM (SELECT DISTINCT h FROM k) k, d, b
          WHERE b.level = d.level AND b.bucket = k.h >> (60 - d.level) GROUP BY k.h)
    SELECT doc_id, n_bytes, local_depth::INT AS local_depth, (h >> (60 - local_depth))::BIGINT AS prefix, 0::BIGINT AS chain,
           CASE WHEN local_depth = 0 THEN '*' ELSE right(lpad(bin(h), 60, '0')[:local_depth], local_depth) END AS shard,
           n_bytes > {limit} AS oversized
    FROM k JOIN m USING (h)"""
