"""Exact deduplication as a stream with keyed state.

Each document leaves a line in a digest log: its id, the SHA-256 of its normalised text and a
content locator, the file and the row where the text lies. A streaming query reads the log and
keeps, for every digest ever seen, the row that stays, its locator and the number of copies, in
state on disk (RocksDB) that never expires. New parts of the log go on from the state that
earlier runs have committed, and a lost executor costs only the batch that it worked on.

A digest that comes back is a hit. The full bytes of hits are compared: their texts are read
again and their least and greatest text by digest must be the same. Texts that share a digest
and differ are parted by their bytes. Only hits are shuffled with their texts; a fixed-size
bitmap of the hits' digests, sent to every task, lets the others pass by. When it fills up at
large inputs, more texts go through to the comparison and results stay the same.

All of it is DataFrame and SQL functions; no Python runs in tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import load, materialize, shared_dir

#: State on disk; its files take the space that they fill, and no rows are counted for metrics.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of digest log that one batch takes in.
BATCH_BYTES = 256 * 10**9
#: A group with more than this share of all rows is joined by broadcast; there are at most as many of them.
HEAVY = 1000
#: Bits of the bitmap of hits: 2**26 bits are 8 MB, whatever the input.
SIEVE_BITS = 26
LOG = "doc_id long, sha binary, digest binary, file long, row long"


def normalized(text: Column) -> Column:
    """A-Z in lower case, all else as it is; null as the empty text. ASCII alone takes the quick way."""
    plain = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(plain) == F.char_length(plain), F.lower(plain)).otherwise(F.translate(plain, UPPER, LOWER))


def located(docs: DataFrame, where: str) -> DataFrame:
    """(doc_id, text, path, row) of every row. Rows that come from Parquet files stay where they are;
    others are written first, so that there is a place to name."""
    what = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text")]

    def of(df: DataFrame) -> DataFrame:
        at = df.metadataColumn("_metadata")
        return df.select(*what, at["file_path"].alias("path"), at["row_index"].alias("row"))

    try:
        return of(docs)
    except AnalysisException:
        return of(materialize(docs.select(*what), where, "content"))


def with_digest(rows: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """Adds norm, sha, digest and file (the path's hash) to located rows."""
    x = rows.select("doc_id", normalized(F.col("text")).alias("norm"), F.xxhash64("path").alias("file"), "row")
    x = x.withColumn("sha", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)))
    return x.withColumn("digest", digest(F.col("sha")))


def record(rows: DataFrame, where: str, digest: Callable[[Column], Column]) -> None:
    """Appends located rows to the digest log, and their files to the list of files."""
    with_digest(rows, digest).select("doc_id", "sha", "digest", "file", "row").write.mode("append").parquet(f"{where}/log")


def absorb(spark: SparkSession, where: str, batch_bytes: int = BATCH_BYTES) -> int:
    """Takes what is new in the digest log into the state; returns the number of batches it took.

    State: digest -> the greatest (doc_id, file, row) and the number of rows. A null id is less
    than any other; rows of one id and text are told apart by where they lie."""
    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        log = spark.readStream.schema(LOG).option("maxBytesPerTrigger", batch_bytes).parquet(f"{where}/log")
        state = log.groupBy("digest").agg(F.max(F.struct("doc_id", "file", "row")).alias("best"), F.count(F.lit(1)).alias("n"))
        run = state.writeStream.outputMode("update").option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).format("noop").start()
        run.awaitTermination()
        return len([p for p in run.recentProgress if p["numInputRows"]])
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def state(spark: SparkSession, where: str) -> DataFrame:
    """(digest, best, n) as the stream has committed them last."""
    rows = spark.read.format("statestore").load(f"{where}/checkpoint")
    return rows.select("key.digest", F.col("value.max").alias("best"), F.col("value.count").alias("n"))


def _bit(digest: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(1 << bits).cast("long"))


def sieve(hits: DataFrame, bits: int) -> DataFrame:
    """(bucket, bitmap) with a bit for each digest: at most 2**bits / 32,768 + 1 rows of 4 KB."""
    x = hits.select(_bit(F.col("digest"), bits).alias("b"))
    return x.groupBy(F.bitmap_bucket_number("b").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bitmap"))


def sifted(rows: DataFrame, bitmaps: DataFrame, bits: int) -> DataFrame:
    """Rows whose digest may be one of the hits; rows of all hits are among them."""
    x = rows.withColumn("__b", _bit(F.col("digest"), bits)).withColumns({"bucket": F.bitmap_bucket_number("__b"), "__at": F.bitmap_bit_position("__b")})
    byte = F.conv(F.hex(F.substring(F.col("bitmap"), (F.shiftright("__at", 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    return x.join(F.broadcast(bitmaps), "bucket").where(F.getbit(byte, F.col("__at") % 8) == 1).select(*rows.columns)


def collided(candidates: DataFrame) -> DataFrame:
    """Digests that more than one text has. Least and greatest text are combined before the shuffle,
    so a digest of very many copies sends one pair for each task."""
    return candidates.groupBy("digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high")).where("low <> high").select("digest")


def _rows(df: DataFrame) -> DataFrame:
    best = F.col("best")
    stays = F.col("doc_id").eqNullSafe(best["doc_id"]) & (F.col("file") == best["file"]) & (F.col("row") == best["row"])
    return df.select("doc_id", best["doc_id"].alias("keep_id"), F.col("n").alias("group_size"), stays.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), best["file"].alias("keep_file"), best["row"].alias("keep_row"))


def deduplicate(docs: DataFrame, where: str | None = None, digest: Callable[[Column], Column] = lambda sha: sha, batch_bytes: int = BATCH_BYTES, sieve_bits: int = SIEVE_BITS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, keep_file, keep_row), one row for each row of
    ``docs``. Of rows whose texts are equal after lower-casing A-Z, the one with the greatest
    doc_id stays; ``keep_file`` (hash of the path) and ``keep_row`` tell where its text lies.

    Null texts are empty texts and equal to these. A null id is less than any other, so it stays
    only among its like; ``keep_id`` is null then. Of rows with the same text and id one stays,
    the last by place. Very long texts are hashed and compared whole. An empty table gives no
    rows. Other columns, also those named like results, are not read.

    ``where``: a shared folder for log, state and content; by default a new one. ``digest``
    shortens the SHA-256, for tests of what happens when digests collide."""
    spark = docs.sparkSession
    where = where or shared_dir(spark)
    rows = located(docs, where)
    record(rows, where, digest)
    log = spark.read.schema(LOG).parquet(f"{where}/log")
    total = log.count()
    if not total:
        return _rows(log.withColumns({"best": F.struct("doc_id", "file", "row"), "n": F.lit(0).cast("long")}))
    absorb(spark, where, batch_bytes)
    groups = materialize(state(spark, where), where, "groups")
    bitmaps = materialize(sieve(groups.where("n > 1"), sieve_bits), where, "sieve")
    candidates = sifted(with_digest(rows, digest), bitmaps, sieve_bits)
    differ = materialize(collided(candidates), where, "collided")
    if differ.limit(1).count():
        clear, parted = log.join(differ, "digest", "left_anti"), _parted(candidates.join(differ, "digest", "left_semi"), where)
        groups = groups.join(differ, "digest", "left_anti")
    else:
        clear, parted = log, None
    heavy = F.broadcast(groups.where(F.col("n") * HEAVY > total))  # fewer than HEAVY rows
    light = groups.where(F.col("n") * HEAVY <= total).hint("merge")
    out = _rows(clear.join(heavy, "digest")).unionByName(_rows(clear.join(heavy, "digest", "left_anti").join(light, "digest")))
    return out.unionByName(parted) if parted is not None else out


def _parted(members: DataFrame, where: str) -> DataFrame:
    """Rows of collided digests, grouped by digest and bytes."""
    groups = members.groupBy("digest", "norm").agg(F.max(F.struct("doc_id", "file", "row")).alias("best"), F.count(F.lit(1)).alias("n"))
    return materialize(_rows(members.join(groups, ["digest", "norm"])), where, "parted")


def kept_texts(docs: DataFrame, groups: DataFrame, where: str) -> DataFrame:
    """(doc_id, text) of the rows that stay, fetched by their locators; ``groups`` as ``deduplicate``
    returns them for the same ``docs`` and folder."""
    kept = groups.where("kept").select(F.col("keep_file").alias("file"), F.col("keep_row").alias("row"))
    return located(docs, where).withColumn("file", F.xxhash64("path")).join(kept, ["file", "row"], "left_semi").select("doc_id", "text")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(load(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
     g AS (SELECT t, max(doc_id) AS keep_id, CAST(count(*) AS BIGINT) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""
