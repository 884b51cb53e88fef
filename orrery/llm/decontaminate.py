"""Benchmark decontamination: a prefix-filtered containment join of item windows with document word sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import LOWER, UPPER, ascii_lower, cut, table

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LITERAL_WORDS = 20_000  # so many words go into the plan as a set; more are joined
BROADCAST_BYTES = 32_000_000
LOWEST = -(2**63)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), GAP, -1), "")


def _few(words: DataFrame) -> list[str] | None:
    got = [r[0] for r in words.limit(LITERAL_WORDS + 1).collect()]
    return got if len(got) <= LITERAL_WORDS else None


def windows_of(items: DataFrame, window: int) -> DataFrame:
    """(w, items): each different window of the items with the sorted ids (strings) of those that hold it."""
    w = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    w = w.withColumn("len", F.least(F.size("words"), F.lit(window)))
    each = w.select("item", "len", "words", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("len"))).alias("off"))
    return each.select("item", F.slice("words", F.col("off") + 1, F.col("len")).alias("w")).groupBy("w").agg(F.array_sort(F.collect_set("item")).alias("items"))


def contamination(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of docs.

    1. Words of the items are counted over all documents. 2. A window's tokens are ordered by rarity; as all of
    them must occur, its prefix is the rarest one. 3. Places of prefix tokens in documents are joined with the
    windows they belong to; the place must leave room for the window before and after (positional and length
    bounds). 4. The words around it are compared with the whole window.
    Null text has no words; a null doc_id keeps its row; rows repeated whole get equal results; a null item_id
    is listed as an empty string. No items: nothing is hit. Further columns are ignored.
    """
    spark = docs.sparkSession
    win = cut(windows_of(items, window), "leak-windows")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), words_of(F.col("text")).alias("words"))
    vocab = win.select(F.explode("w").alias("word")).distinct()
    known = _few(vocab)
    each = rows.select(F.explode(F.filter("words", lambda x: x.isin(known)) if known else "words").alias("word")) if known != [] else None
    if each is None:
        counts = spark.createDataFrame([], "word string, c long")
    else:
        counts = each.groupBy("word").agg(F.count(F.lit(1)).alias("c"))
        counts = cut(counts if known else counts.join(vocab, "word", "left_semi"), "leak-counts")
    placed = win.select("w", "items", F.posexplode("w").alias("p", "word")).join(counts, "word", "left")
    rare = F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "word", "p"))
    prefix = placed.groupBy("w").agg(rare.alias("r"), F.first("items").alias("items")).filter("r.c > 0")
    prefix = cut(prefix.select(F.col("r.word").alias("word"), F.col("r.p").alias("p"), F.size("w").alias("len"), "w", "items"), "leak-prefix")
    size = prefix.select(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0

    at = F.transform("words", lambda x, i: i)
    if (few := _few(prefix.select("word").distinct())) is not None:
        at = F.filter(F.transform("words", lambda x, i: F.when(x.isin(few), i)), lambda i: i.isNotNull()) if few else F.array().cast("array<int>")
    back = window - 1
    around = lambda i: F.struct(i.alias("pos"), F.element_at("words", i + 1).alias("word"), F.slice("words", F.greatest(i - back, F.lit(0)) + 1, F.lit(2 * window - 1)).alias("near"))
    found = cut(rows.select("doc_id", "th", F.size("words").cast("long").alias("n_words"), F.transform(at, around).alias("at")), "leak-places")
    places = found.select("doc_id", "th", "n_words", F.explode("at").alias("x")).select("doc_id", "th", "n_words", "x.*")
    joined = places.join(F.broadcast(prefix) if size <= BROADCAST_BYTES else prefix, "word")
    start = F.col("pos") - F.col("p")
    inside = (start >= 0) & (start + F.col("len") <= F.col("n_words"))
    same = F.slice("near", start - F.greatest(F.col("pos") - back, F.lit(0)) + 1, F.col("len")) == F.col("w")
    hits = joined.filter(inside).filter(same).select("doc_id", "th", F.struct(start.cast("long").alias("s"), (start + F.col("len")).cast("long").alias("e")).alias("span"), "items")
    zero = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n"))
    cover = F.aggregate(F.array_sort("spans"), zero, lambda a, x: F.struct(F.greatest(a["upto"], x["e"]).alias("upto"), (a["n"] + F.greatest(F.lit(0).cast("long"), x["e"] - F.greatest(a["upto"], x["s"]))).alias("n")), lambda a: a["n"])
    got = hits.groupBy("doc_id", "th").agg(F.collect_set("span").alias("spans"), F.collect_set("items").alias("items"))
    got = cut(got.select("doc_id", "th", cover.alias("hit"), F.array_sort(F.array_distinct(F.flatten("items"))).alias("items")), "leak-hits")
    out = found.select("doc_id", "th", "n_words").join(got, ["doc_id", "th"], "left")
    listed = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    n_hit = F.coalesce("hit", F.lit(0).cast("long"))
    return out.select(
        F.when(F.col("doc_id") != LOWEST, F.col("doc_id")).alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, least(10, len(w)) AS l, array_to_string(w[o + 1 : o + least(10, len(w))], ' ') AS g
         FROM iw, unnest(range(0, len(w) - least(10, len(w)) + 1)) t(o) WHERE len(w) > 0),
lens AS (SELECT DISTINCT l FROM wins),
places AS (SELECT doc_id, l, s, array_to_string(w[s + 1 : s + l], ' ') AS g FROM dw, lens, unnest(range(0, greatest(0, len(w) - l + 1))) t(s)),
hits AS (SELECT doc_id, s, l, item_id FROM places JOIN wins USING (l, g)),
hit AS (SELECT doc_id, count(DISTINCT s + i) AS n_hit FROM (SELECT DISTINCT doc_id, s, l FROM hits) h, unnest(range(0, l)) t(i) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
