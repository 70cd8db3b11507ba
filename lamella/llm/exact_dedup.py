"""Exact deduplication by an extendible-hash index kept in shared files.

1. Postings: one pass writes (id, hash, digest, code points) of every row to the shared folder, without text.
2. Directory: the different hashes, counted by their leading ``DIRECTORY_BITS`` bits, drive the splits. It starts as one bucket; a
   bucket with more hashes than its capacity splits on its next bit, and the directory doubles when the bucket's local depth passes the
   global depth. At full depth a bucket grows instead. The directory, a row per slot of at most 2**16 with its bucket and owner, is
   a table in the shared folder.
3. Owner tasks: each owns a range of neighbouring buckets of about the same bytes, and every text is sent, through the directory, to
   the task that owns its bucket. There whole texts are compared byte by byte, so different texts with one hash chain as separate
   entries. The owner writes its buckets' entries (bucket, hash, digest, size, survivor) in order into a folder of its own. Hashes of more than a
   1024th of all rows, at most 1024 by counting, are aggregated before they travel.
4. Lookup: postings go through the directory to the owner of their bucket and find their entry there by hash and digest. Entries of many
   rows are broadcast, at most 1024 of them by counting, so no owner gets a hot group's rows.

Everything is DataFrame functions; no Python runs on the executors.

Defined results: a null text is an empty text; empty texts are equal to each other. Very long texts are compared whole. A null id loses
every tie and its survivor is null when no row of the group has an id. ``exact_groups`` calls rows that repeat an id with one text
kept or dropped together; ``drop_copies`` keeps one row of each group, whatever ids are null or repeated. No rows: no rows. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._join import HOT_SHARE, keep_rows, keyed, left_join_by_weight
from ._scratch import Scratch

DIRECTORY_BITS = 16
OWNER_BYTES = 64 << 20  # about as much text as one owner task gets, where there are more than shuffle partitions' worth
WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """The text without the characters 0x20 and 0x09-0x0D; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, "")


def build_directory(counts: dict[int, int], bits: int, capacity: int) -> tuple[int, list[int], list[tuple[int, int, int]]]:
    """Split one bucket until each fits ``capacity`` or is at full depth: (global depth, directory, buckets).

    ``counts`` maps ``bits`` leading bits of the hash to entries. A bucket is (local depth, its prefix, entries).
    The directory has 2**depth entries, each the number of a bucket; it doubles when a bucket at global depth splits.
    """
    total = [0] * (2**bits + 1)
    for i in range(2**bits):
        total[i + 1] = total[i] + counts.get(i, 0)

    def rows(depth: int, prefix: int) -> int:
        return total[(prefix + 1) << (bits - depth)] - total[prefix << (bits - depth)]

    depth, done, todo = 0, [], [(0, 0)]
    while todo:
        d, p = todo.pop()
        n = rows(d, p)
        if n > capacity and d < bits:
            depth = max(depth, d + 1)
            todo += [(d + 1, 2 * p + 1), (d + 1, 2 * p)]
        else:
            done.append((d, p, n))
    directory = []
    for k, (d, _, _) in enumerate(done):
        directory += [k] * 2 ** (depth - d)
    return depth, directory, done


def _prefix(h: Column, bits: int) -> Column:
    return F.shiftrightunsigned(h, 64 - bits) if bits else F.lit(0).cast("long")


def share_out(sizes: list[int], owners: int) -> list[int]:
    """The owner of every bucket: contiguous ranges of about equal sums, numbered from 0."""
    total, before, out = max(sum(sizes), 1), 0, []
    for n in sizes:
        out.append(min(owners - 1, (2 * before + n) * owners // (2 * total)))
        before += n
    return out


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 512, hash_bits: int = 64, row_col: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame, int, int]:
    """(postings, directory, entries, owners, rows): a row per row of ``docs``, per slot of the directory, per different text.

    ``hash_bits`` below 64 makes collisions on purpose, for tests. ``capacity`` is how many different hashes a bucket may hold
    before it splits. ``row_col`` is carried into the postings.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    carry = [F.col(row_col).alias("row")] if row_col else []
    rows = docs.select(*carry, F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    key = F.xxhash64("norm")
    if hash_bits < 64:
        key = F.shiftleft(F.shiftrightunsigned(key, 64 - hash_bits), 64 - hash_bits)
    rows = rows.select(*(["row"] if row_col else []), "doc_id", F.length(F.coalesce("t", F.lit(""))).alias("points"), normalised(F.col("t")).alias("norm")).withColumn("h", key)
    postings = scratch.write(rows.withColumn("bytes", F.octet_length("norm").cast("long")).withColumn("text_sha256", F.sha2(F.col("norm").cast("binary"), 256)).drop("norm"), "postings")
    total = postings.count()
    hashes = scratch.write(postings.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("bytes").alias("bytes")), "hashes")
    histogram = hashes.groupBy(_prefix(F.col("h"), DIRECTORY_BITS).cast("int").alias("p")).agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).collect()  # at most 2**16 rows
    depth, slots, buckets = build_directory({r["p"]: r["n"] for r in histogram}, DIRECTORY_BITS, capacity)
    sizes, deep = [0] * len(buckets), DIRECTORY_BITS - depth
    for r in histogram:
        sizes[slots[r["p"] >> deep]] += r["bytes"] + 100
    owners = max(1, min(len(buckets), max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(sizes) // OWNER_BYTES)))
    owner = share_out(sizes, owners)
    text = ",".join(f"{k}:{owner[k]}" for k in slots)
    directory = spark.range(1).select(F.posexplode(F.split(F.lit(text), ",")).alias("slot", "x")).select("slot", F.split_part("x", F.lit(":"), F.lit(1)).cast("int").alias("bucket"), F.split_part("x", F.lit(":"), F.lit(2)).cast("int").alias("owner"))
    directory = scratch.write(directory.coalesce(1), "directory")

    hot = F.broadcast(hashes.where(F.col("n") > max(1, total // HOT_SHARE)).select("h"))
    # A survivor's rank as one number: code points first, then the smallest id; 0 in the low part is a null id.
    rank = F.col("points").cast("decimal(38,0)") * F.expr("cast('100000000000000000000' as decimal(21,0))") + F.coalesce(
        F.expr("cast('9223372036854775808' as decimal(20,0))") - F.col("doc_id").cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)")
    )
    low = F.col("best") % F.expr("cast('100000000000000000000' as decimal(21,0))")
    ranked = rows.select("h", "norm", F.lit(1).cast("long").alias("n"), rank.cast("decimal(38,0)").alias("rank"))
    often = ranked.join(hot, "h").groupBy("h", "norm").agg(F.sum("n").alias("n"), F.max("rank").alias("rank"))
    sent = through(ranked.join(hot, "h", "left_anti").unionByName(often), directory, depth).repartitionById(owners, F.col("owner"))
    entries = (
        sent.groupBy("owner", "bucket", "h", "norm")
        .agg(F.sum("n").alias("group_size"), F.max("rank").alias("best"))
        .select(
            "owner",
            "bucket",
            "h",
            F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
            "group_size",
            F.when(low != 0, (F.expr("cast('9223372036854775808' as decimal(20,0))") - low).cast("long")).alias("keep_id"),
        )
    )
    entries.sortWithinPartitions("owner", "bucket", "h").write.mode("overwrite").partitionBy("owner").parquet(scratch.path("entries"))
    entries = spark.read.schema("bucket int, h long, text_sha256 string, group_size long, keep_id long, owner int").parquet(scratch.path("entries"))
    return through(postings, directory, depth), directory, entries, owners, total


def through(rows: DataFrame, directory: DataFrame, depth: int) -> DataFrame:
    """``rows`` with the bucket of their hash and its owner; the directory has at most 2**16 rows."""
    slot = _prefix(F.col("h"), depth).cast("int")
    return rows.withColumn("slot", slot).join(F.broadcast(directory), "slot").drop("slot")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 512, hash_bits: int = 64, row_col: str | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row; of equal texts the longest original stays, then the smallest id.

    With ``row_col`` its column comes first.
    """
    postings, _, entries, owners, total = index(docs, id_col, text_col, capacity, hash_bits, row_col)
    keys = ["owner", "bucket", "h", "text_sha256"]
    many = entries.where("group_size > 1").select(*keys, "group_size", "keep_id", F.lit(True).alias("many"))
    if many.groupBy("h", "text_sha256").count().where("count > 1").limit(1).count():
        raise RuntimeError("two different texts share a 64-bit hash and a SHA-256 digest")
    out = left_join_by_weight(postings, many, keys, "group_size", total, lambda side: side.repartitionById(owners, F.col("owner")))
    keep = F.when(F.col("many"), F.col("keep_id")).otherwise(F.col("doc_id"))
    return out.select(
        *([F.col("row").alias(row_col)] if row_col else []),
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row, with all its columns, of each group of equal texts; of rows that repeat the survivor's id, any one."""
    rows, row = keyed(docs, "exact-rows")
    found = exact_groups(rows, id_col, text_col, row_col=row).where("group_size > 1")
    stays = found.where("kept").groupBy("text_sha256").agg(F.min(row).alias("stays"))
    gone = found.join(stays, "text_sha256").where(F.col(row) != F.col("stays")).select(row)
    return keep_rows(rows, gone, row).drop(row)
