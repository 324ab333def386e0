"""Benchmark decontamination: a prefix-filtered set join between item windows and documents, by DataFrame functions.

Windows are 13 consecutive item words (or the whole item, if it has fewer). The shingles of a window, three words each,
are ordered by rarity in the documents; as containment is exact, the rarest is a sufficient prefix. Documents' shingles
meet the prefixes in one join; positional and length bounds drop places where the window would not fit, and the words
there are compared one by one.

Nulls, ties and odd rows: null and empty texts have no words and no hits; equal rarities go to the smaller hash and then
the smaller offset; rows equal in doc_id and text give one row; empty items have no windows; a null item_id is not
listed; other columns of docs are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import BETWEEN_WORDS

WINDOW, SHINGLE = 13, 3
#: Prefixes are broadcast up to so many windows (about 0.3 KB each); more go through a shuffle.
BROADCAST_WINDOWS = 100_000
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.translate(text, UPPER, SMALL), BETWEEN_WORDS, " "))
    return F.when(F.length(F.coalesce(plain, F.lit(""))) > 0, F.split(plain, " ", -1)).otherwise(F.array().cast("array<string>"))


def shingle(words: str, at: Column, width: int) -> Column:
    """Hash of width words from an index on; of fewer at the end, which nothing longer equals."""
    return F.xxhash64(F.lit(width), *(F.get(F.col(words), at + j) for j in range(width)))


def windows(items: DataFrame, text: str = "text") -> DataFrame:
    """(item_id, words) of every window of every item."""
    w = items.select("item_id", words_of(F.col(text)).alias("words")).where(F.size("words") > 0).withColumn("len", F.least(F.lit(WINDOW), F.size("words")))
    return w.select("item_id", "words", "len", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("len") + 1)).alias("start")).select("item_id", F.slice("words", F.col("start"), F.col("len")).alias("words"))


def exploded(docs: DataFrame, widths: list[int], text: str = "text") -> DataFrame:
    """A row for every word of every document (at least one a document), with the shingles that start there."""
    d = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), words_of(F.col(text)).alias("words"))
    d = d.select("doc_id", "text_hash", "words", F.posexplode_outer("words").alias("pos", "word"))
    each = d if len(widths) == 1 else d.withColumn("width", F.explode(F.array(*map(F.lit, widths))))
    key = shingle("words", F.col("pos"), widths[0])
    for w in widths[1:]:
        key = F.when(F.col("width") == w, shingle("words", F.col("pos"), w)).otherwise(key)
    return each.withColumn("key", key)


def prefixes(items: DataFrame, docs: DataFrame) -> tuple[DataFrame, list[int], bool]:
    """(key, offset, window) of the rarest shingle of every distinct window; the shingle widths; whether the table may be broadcast."""
    each = windows(items).select(F.col("words").alias("window")).distinct()
    n = F.least(F.lit(SHINGLE), F.size("window"))
    offsets = each.select("window", n.alias("width"), F.explode(F.sequence(F.lit(0), F.size("window") - n)).alias("offset"))
    key = shingle("window", F.col("offset"), 1)
    for w in range(2, SHINGLE + 1):
        key = F.when(F.col("width") == w, shingle("window", F.col("offset"), w)).otherwise(key)
    offsets = offsets.withColumn("key", key)
    widths = sorted((r["width"] for r in offsets.select("width").distinct().collect()), reverse=True) or [SHINGLE]
    small = each.count() <= BROADCAST_WINDOWS
    keys = offsets.select("key").distinct()
    seen = exploded(docs, widths).select("key").join(F.broadcast(keys) if small else keys, "key", "left_semi").groupBy("key").agg(F.count("*").alias("n"))
    rare = offsets.join(seen, "key", "left").groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key", "offset")).alias("rarest"))
    return rare.select("rarest.key", "rarest.offset", "window"), widths, small


def hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_words, and places: distinct (start, length, window) of the windows that occur."""
    table, widths, small = prefixes(items, docs)
    each = exploded(docs, widths)
    start = F.col("pos") - F.col("offset")
    fits = (start >= 0) & (start + F.size("window") <= F.size("words"))
    found = fits & (F.slice("words", F.greatest(start, F.lit(0)) + 1, F.size("window")) == F.col("window"))
    if small:
        # One pass: the words stay beside the position within the stage, and each document leaves a row for its first word.
        met = each.join(F.broadcast(table), "key", "left").withColumn("found", F.coalesce(found, F.lit(False)))
        rows = met.where(F.col("found") | (F.coalesce("pos", F.lit(0)) == 0))
    else:
        # Only positions are shuffled; the words of documents with candidates follow.
        narrow = each.select("doc_id", "text_hash", "pos", "key").join(table, "key")
        own = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("words")).dropDuplicates(["doc_id", "text_hash"])
        met = own.join(narrow, own["doc_id"].eqNullSafe(narrow["doc_id"]) & (own["text_hash"] == narrow["text_hash"]), "left").select(own["doc_id"], own["text_hash"], "words", "pos", "offset", "window")
        rows = met.withColumn("found", F.coalesce(found, F.lit(False)))
    place = F.when(F.col("found"), F.struct(start.alias("start"), F.size("window").alias("len"), F.col("window")))
    return rows.groupBy("doc_id", "text_hash").agg(F.max(F.size("words")).alias("n_words"), F.collect_set(place).alias("places"))


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, text_hash."""
    per_doc = hits(docs, items)
    spans = F.array_sort(F.transform("places", lambda p: F.struct(p["start"], (p["start"] + p["len"]).alias("end"))))
    covered = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("until"), F.lit(0).alias("n")),
        lambda a, s: F.struct(F.greatest(a["until"], s["end"]).alias("until"), (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["until"]))).alias("n")),
        lambda a: a["n"],
    )
    of = windows(items).where("item_id is not null").select("words", F.col("item_id").cast("string").alias("item")).distinct()
    listed = (
        per_doc.where(F.size("places") > 0)
        .select("doc_id", "text_hash", F.explode(F.array_distinct(F.transform("places", lambda p: p["window"]))).alias("words"))
        .join(of, "words")
        .groupBy("doc_id", "text_hash")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    d = per_doc.select("doc_id", "text_hash", "n_words", covered.alias("n_hit"))
    joined = d.join(listed.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), "items"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")), "left")
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "doc_id",
        F.col("n_words").cast("long"),
        F.col("n_hit").cast("long"),
        F.size(items_).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_, ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        "text_hash",
    )


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that are not contaminated, whole, with all columns of docs."""
    bad = contamination(docs, items).where("contaminated").select(F.struct(F.col("doc_id").alias("d"), F.col("text_hash").alias("t")).alias("contaminated_text"))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["contaminated_text"]["d"]) & (F.xxhash64(docs["text"]) == bad["contaminated_text"]["t"]), "left_anti")


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
bw AS (SELECT item_id, least(13, len(w)) AS n, unnest(list_transform(range(1, len(w) - least(13, len(w)) + 2), lambda i: array_to_string(w[i:i + least(13, len(w)) - 1], ' '))) AS win FROM b WHERE len(w) > 0),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS s, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS win FROM d, ns WHERE len(w) >= n),
m AS (SELECT dw.doc_id, dw.s, dw.n, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM m)) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id::varchar AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
  (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w)) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""
