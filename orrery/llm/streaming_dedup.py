"""Exact deduplication by a stream: keyed state on disk (RocksDB), never expired, holds for each text digest the
stable identifier to keep, a content locator and the copies seen; hits are then checked byte for byte."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import cut, shared_dir, table

#: Disk-backed state; without fallocate, as that takes megabytes for each of many small stores.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
COPIES_AT_ONCE = 64  # copies compared with one sent-out text of the keeper
PLACES = 32_768  # rows of a file in one bitmap of 4 kB, the size that Spark's bitmaps have
SENT_PLACES = 8_192  # bitmaps sent to every executor, at most; more are joined like any table

FIELDS = ["text_sha256", "has_id", "doc_id", "locator"]
KEEP = "keep struct<has_id: boolean, doc_id: bigint, locator: string>"


def locator() -> Column:
    """Where a text lies: a file and a row in it."""
    return F.concat_ws("#", "_metadata.file_path", "_metadata.row_index")


def as_files(docs: DataFrame) -> DataFrame:
    """docs if it is a scan of files, whose rows have locators; else what is written of it."""
    try:
        docs.select(locator())
        return docs
    except AnalysisException:
        return cut(docs, "dedup-docs")


def _named(docs: DataFrame) -> list[Column]:
    """FIELDS of docs(doc_id, text); null ids are told by has_id, null text counts as empty."""
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    return [digest.alias(FIELDS[0]), F.col("doc_id").isNotNull().alias(FIELDS[1]), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias(FIELDS[2]), locator().alias(FIELDS[3])]


class StreamingDedup:
    """State over all documents that ever arrived in the folder `source` (or through add()); each update() takes in the new files.

    The state lives in the stream's checkpoint (a shared folder) and in RocksDB on the executors' disks, so a
    restarted stream or a replaced executor goes on from it.
    """

    def __init__(self, spark: SparkSession, source: str | None = None, home: str | None = None, files_at_once: int = 10_000):
        self.spark, self.files_at_once = spark, files_at_once
        self.home = home or shared_dir(spark, "dedup")
        self.source = source or f"{self.home}/incoming"

    def add(self, docs: DataFrame) -> None:
        """Let rows of any DataFrame arrive: their digests, ids and locators go to the incoming folder, the texts stay where they are."""
        as_files(docs).select(*_named(docs)).write.mode("append").parquet(self.source)

    def update(self) -> None:
        spark = self.spark
        schema = spark.read.parquet(self.source).schema
        old = {k: spark.conf.get(k, None) for k in STORE}
        for k, v in STORE.items():
            spark.conf.set(k, v)
        try:
            glob = f"{self.source[:-1]}[{self.source[-1]}]"  # as a glob the source may be one file or a folder of them
            rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", self.files_at_once).parquet(glob)
            seen = rows if schema.fieldNames() == FIELDS else rows.select(*_named(rows))
            state = seen.groupBy("text_sha256").agg(F.max(F.struct("has_id", "doc_id", "locator")).alias("keep"), F.count(F.lit(1)).alias("copies"))
            put = lambda df, n: df.write.mode("overwrite").parquet(f"{self.home}/updates/batch={n}")
            q = state.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{self.home}/stream").trigger(availableNow=True).start()
            q.awaitTermination()
        finally:
            for k, v in old.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)

    def state(self) -> DataFrame:
        """(text_sha256, keep struct<has_id, doc_id, locator>, copies), a row for each digest."""
        spark, updates = self.spark, f"{self.home}/updates"
        path = spark._jvm.org.apache.hadoop.fs.Path(updates)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        kinds = f"text_sha256 string, {KEEP}, copies bigint"
        if not fs.exists(path):
            return spark.createDataFrame([], kinds)
        rows = spark.read.schema(f"{kinds}, batch bigint").option("basePath", updates).parquet(f"{updates}/*")
        if len(fs.listStatus(path)) > 1:
            rows = rows.groupBy("text_sha256").agg(F.max_by(F.struct("keep", "copies"), "batch").alias("x")).select("text_sha256", "x.*")
        return rows.select("text_sha256", "keep", "copies")

    def _apart(self, copies: DataFrame) -> DataFrame | None:
        """Of copies(FIELDS, text, keep, copies), the rows whose bytes aren't those of the text that the state's locator points to
        (the kept id, where copies aren't the files that arrived), grouped by the whole text: (locator, text_sha256, keep, copies).
        None: all are equal. A kept text is sent to as many salts as its copies need."""
        spread = copies.withColumn("salts", F.ceil(F.col("copies") / COPIES_AT_ONCE))
        keeper = spread.filter("has_id = keep.has_id and doc_id = keep.doc_id").groupBy("text_sha256", "salts").agg(F.max_by("text", F.col("locator") == F.col("keep.locator")).alias("kept_text"))
        keeper = keeper.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
        same = F.coalesce(F.col("text").cast("binary") == F.col("kept_text").cast("binary"), F.lit(False))
        spread = spread.withColumn("salt", F.pmod(F.xxhash64("locator"), F.col("salts"))).join(keeper, ["text_sha256", "salt"], "left")
        differ = cut(spread.filter(~same).select(*FIELDS, "text"), "dedup-differ")
        if differ.isEmpty():
            return None
        groups = differ.groupBy("text_sha256", "text").agg(F.max(F.struct("has_id", "doc_id", "locator")).alias("keep"), F.count(F.lit(1)).alias("copies"))
        return cut(differ.join(groups, ["text_sha256", "text"]).select("locator", "text_sha256", "keep", "copies"), "dedup-apart")

    def decisions(self, docs: DataFrame) -> DataFrame:
        """(doc_id, keep_id, group_size, kept, text_sha256, locator) for each row of docs, which the state has seen; locator: where the kept text lies.

        Null text counts as empty. Of equal texts the largest doc_id stays; a null doc_id ranks below any other.
        Rows that repeat the kept doc_id with the same text are all marked as kept: they are one document.
        Texts of one digest are compared byte for byte with the kept one; any that differ are regrouped by their whole
        text. No rows: no rows. Further columns of docs are ignored.
        """
        docs, state = as_files(docs.select("doc_id", "text")), self.state()
        rows = docs.select(*_named(docs), F.coalesce("text", F.lit("")).alias("text"))
        copies = cut(rows.join(state.filter("copies > 1"), "text_sha256"), "dedup-copies")
        out = rows.drop("text").join(state, "text_sha256")
        if (again := self._apart(copies)) is not None:  # two texts of one digest
            less = again.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("less"))
            new = again.select("locator", F.col("keep").alias("new_keep"), F.col("copies").alias("new_copies"))
            out = out.join(less, "text_sha256", "left").join(new, "locator", "left")
            out = out.withColumns({"copies": F.coalesce("new_copies", F.col("copies") - F.coalesce("less", F.lit(0))), "keep": F.coalesce("new_keep", "keep")})
        kept = (F.col("has_id") == F.col("keep.has_id")) & (F.col("doc_id") == F.col("keep.doc_id"))
        keep_id = F.when(F.col("keep.has_id"), F.col("keep.doc_id"))
        return out.select(F.when(F.col("has_id"), F.col("doc_id")).alias("doc_id"), keep_id.alias("keep_id"), F.col("copies").alias("group_size"), kept.alias("kept"), "text_sha256", "keep.locator")

    def kept_rows(self, docs: DataFrame) -> DataFrame:
        """The rows of docs (the files that arrived) that the state's locators keep: one of each text. Only texts that occur twice are moved,
        the others go from the scan into the result; a bit for each row of a file tells which."""
        where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")]
        marked = cut(docs.select(*_named(docs), *where).join(self.state().filter("copies > 1"), "text_sha256"), "dedup-marked")
        part = F.floor(F.col("at") / PLACES).alias("part")
        places = cut(marked.groupBy("file", part).agg(F.bitmap_construct_agg(F.col("at") % PLACES).alias("places")), "dedup-places")
        rows = docs.select(F.struct("*").alias("row"), *where).withColumn("part", part)
        rows = rows.join(F.broadcast(places) if places.count() <= SENT_PLACES else places, ["file", "part"], "left")
        byte = f"cast(conv(hex(substring(places, cast(at % {PLACES} div 8 as int) + 1, 1)), 16, 10) as int)"
        again = F.coalesce(F.expr(f"getbit({byte}, cast(at % 8 as int)) = 1"), F.lit(False))
        moved = cut(rows.filter(again).select("row", "file", "at").join(marked, ["file", "at"]).drop("file", "at"), "dedup-moved")
        kept = moved.filter("locator = keep.locator")
        if (apart := self._apart(moved.withColumn("text", F.coalesce("row.text", F.lit(""))).drop("row"))) is not None:
            kept = kept.unionByName(moved.join(apart.filter("locator = keep.locator").select("locator"), "locator", "left_semi"))
        return rows.filter(~again).select("row.*").unionByName(kept.select("row.*"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each text: one with the largest doc_id (null ids rank last, null text counts as empty, rows
    repeated whole count once). All columns are kept, whatever their names. No rows: no rows.
    """
    dedup, docs = StreamingDedup(docs.sparkSession), as_files(docs)
    dedup.add(docs)
    dedup.update()
    return dedup.kept_rows(docs)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    dedup = StreamingDedup(spark, f"{sf_dir}/documents.parquet")
    dedup.update()
    return dedup.decisions(table(spark, sf_dir, "documents")).drop("locator")


ORACLE = """
WITH d AS (SELECT CAST(doc_id AS BIGINT) doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""
