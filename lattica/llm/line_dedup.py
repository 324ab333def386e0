"""Line dedup, by DataFrame functions: signatures of normalised lines, a join on their blocks, edit similarity, connected groups.

Lines are what stands between newlines. Normalised: lower-case, without what is no word at either end. Equal normalised
lines are one group, by two 64-bit hashes. Different ones are linked if their edit similarity over words,
1 - distance / words of the longer, is SIMILARITY or more (so lines that differ in punctuation or blanks alone are), and
the groups are the connected components. The first line, by doc_id and line number, of each group is kept.

SimHash bits move too far when a word of a short line changes (README has figures), so a signature has BLOCKS blocks that
an edit leaves alone or replaces: each block holds the least of the line's word runs that hash to it. Runs are three
words, two in lines of up to nine words, and the whole line up to three; runs of more letters come first, as runs of short
words are in many lines. Lines that share a block are compared: by their numbers of words and the parities of 128 hashed
words, of which an edit flips two at most, then word by word. In a block that more than FEW_LINES lines share, each meets
the one of the smallest hash and the shortest of about its length first, which joins most copies. Then all others meet all lines of the bucket, others being
the lines outside its largest group, if they are MOST_OTHERS at most; else its lines meet those of about their length, if these
have so few others; else by the runs of two words, and then by the words, that are rare among such lines: of these, so many are taken that any two that are alike share one. With `exact`, all runs that the shorter of
two lines of similarity SIMILARITY must share with the longer are keys instead, and every such pair is found: a line of n
words, the longer of two, is cut into n // q disjoint runs of q words, q being 4 from 16 words on, 3 from 6 and 2 for 4 or
5; these are more than the n / 5 edits allowed, so one run is left as it is and stands in the other line too.

Nulls, ties and odd rows: a null text stays null and an empty one empty; lines without a word are always kept; rows
without doc_id are kept unchanged; rows that repeat a doc_id and text are one document, whose lines are judged once, and
the same lines go from all of them; `report` shows a document that loses all its words with empty text or what separates
them, `dedup` drops it, as all it said is kept elsewhere. Long texts and lines are taken whole. Helper columns carry names
that docs can't clash with, as only doc_id and text are read.
"""

from __future__ import annotations

import math
from pyspark.sql import Column, DataFrame, functions as F

from . import common

SIMILARITY, BLOCKS = 0.8, 8
#: Bytes of a run of three words from which on it comes before shorter ones, and those before the rest.
LETTERS = (15, 10)
#: ASCII characters that are not in words.
SEPARATORS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
#: Lines of a bucket whose pairs are all compared at once; in larger ones lines meet the first, and then those that it leaves apart.
FEW_LINES = 16
#: In larger buckets, lines whose numbers of words are within this factor also meet the shortest of them.
LENGTHS = 1.12
#: Lines of buckets of more others meet those whose numbers of words are within this factor, a little above what SIMILARITY allows.
BAND = 1.001 / SIMILARITY
#: Lines outside the largest group of a bucket up to which each line of the bucket meets all of them.
MOST_OTHERS = 256
#: Lengths in words of the rare runs by which the lines of other buckets meet, one after the other while buckets of more others come out.
RARE = (2, 1)
#: Lines of a part of a bucket that is still larger; two parts at a time are compared.
PART = 1024
#: Buckets of three lines or more are broadcast up to so many (16 bytes each); more meet the lines in a shuffle.
BROADCAST_BUCKETS = 500_000
#: Ids of candidate lines are broadcast up to so many (about 50 bytes each); more are looked up by their documents.
BROADCAST_LINES = 500_000
#: Documents with candidate lines are broadcast up to so many (about 100 bytes each); more meet the texts in a shuffle.
BROADCAST_DOCS = 50_000

KEYS = [f"k{i}" for i in range(BLOCKS)]
#: What tells lines apart before their words are read.
TRAITS = ["m", "p0", "p1"]


def words(line: Column) -> Column:
    """Words of a line, lower-cased; one empty word if it has none."""
    return F.split(F.lower(F.btrim(line, F.lit(SEPARATORS))), common.BETWEEN_WORDS, -1)


def normalised(line: str) -> Column:
    return F.lower(F.btrim(line, F.lit(SEPARATORS)))


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, line (from 0) and its text, of all lines."""
    return docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n", -1)).alias("line", "raw"))


def normal(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, line, its normalised text's hash h1 and hash h2, and its words, of all lines with words."""
    plain = lines(docs).select("doc_id", "text_hash", "line", normalised("raw").alias("norm")).where("norm <> ''")
    # Hashes of the line come before any generator, once a line.
    return plain.select("doc_id", "text_hash", "line", F.xxhash64("norm").alias("h1"), F.xxhash64(F.lit("line"), "norm").alias("h2"), F.split("norm", common.BETWEEN_WORDS, -1).alias("words"))


def runs(docs: DataFrame) -> DataFrame:
    """normal's columns but words, the number m of words, and a row per run of up to three words (a, b, c; null where the line ends)."""
    after = [F.slice("words", i, F.size("words")) for i in (2, 3)]
    triples, pairs = F.arrays_zip("words", *after), F.arrays_zip("words", after[0], F.array().cast("array<string>"))
    m = F.size("words")
    each = normal(docs).select("doc_id", "text_hash", "line", "h1", "h2", m.alias("m"), F.posexplode(F.when(m.between(7, 9), F.concat(triples, pairs)).otherwise(triples)).alias("pos", "run"))
    return each.select("doc_id", "text_hash", "line", "h1", "h2", "m", "pos", *(F.col("run").getField(str(k) if k else "words").alias(c) for k, c in enumerate("abc")))


def occurrences(docs: DataFrame) -> DataFrame:
    """id (doc_id, text_hash, line), two hashes, number m of words, parities and signature blocks (null: no run there) of every line with words."""
    m = F.col("m")
    whole = F.when(m <= 3, F.col("pos") == 0).otherwise(F.col("c").isNotNull() | (F.col("b").isNotNull() & (m <= 9)))
    size = sum(F.coalesce(F.octet_length(c), F.lit(0)) for c in "abc")
    late = F.when(size >= LETTERS[0], 0).when(size >= LETTERS[1], 1).otherwise(2).cast("long")
    word = F.when(F.col("pos") < m, F.xxhash64("a")).alias("word")  # those behind repeat words in shorter runs
    each = runs(docs).select("doc_id", "text_hash", "line", "h1", "h2", "m", word, late.alias("late"), F.when(whole, F.xxhash64(F.when(m <= 3, m).otherwise(0), "a", "b", "c")).alias("h"))
    # In a block, the low three bits of the hash are the same; those above come behind the letters' class.
    order = F.call_function("shiftleft", F.col("late"), F.lit(61)) + F.shiftrightunsigned("h", 3)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("word").bitwiseAND(F.lit(63)).cast("int"))
    each = each.select("doc_id", "text_hash", "line", "h1", "h2", "m", bit.alias("bit"), (F.shiftrightunsigned("word", 6).bitwiseAND(F.lit(1)) == 1).alias("upper"), F.col("h").bitwiseAND(F.lit(BLOCKS - 1)).alias("block"), order.alias("order"))
    least = [F.min(F.when(F.col("block") == i, F.col("order"))).alias(k) for i, k in enumerate(KEYS)]
    odd = [F.coalesce(F.bit_xor(F.when(F.col("upper") == part, F.col("bit"))), F.lit(0)).alias(p) for p, part in (("p0", False), ("p1", True))]
    per_line = each.groupBy("doc_id", "text_hash", "line").agg(F.max("h1").alias("h1"), F.max("h2").alias("h2"), F.max("m").alias("m"), *odd, *least)
    return common.stored(per_line.select(F.struct("doc_id", "text_hash", "line").alias("id"), "h1", "h2", *TRAITS, *KEYS), "lines")


def blocks(found: DataFrame) -> DataFrame:
    """bucket, id (the first hash): the signature blocks of lines; equal lines repeat them."""
    each = found.select("h1", F.explode(F.array(*(F.call_function("shiftleft", F.col(k), F.lit(3)) + F.lit(i) for i, k in enumerate(KEYS)))).alias("bucket"))
    return each.where("bucket is not null").select(F.col("h1").alias("id"), "bucket")


def all_runs(docs: DataFrame) -> DataFrame:
    """bucket, id (the first hash): the runs of words that every line shares with each line that is alike; equal lines repeat them."""
    each = normal(docs).select("h1", "words", F.size("words").alias("m"), F.posexplode("words").alias("pos", "word"))

    def run(q: int) -> Column:
        return F.xxhash64(F.lit(q), "word", *(F.get("words", F.col("pos") + i) for i in range(1, q)))

    m, left = F.col("m"), F.col("m") - F.col("pos")
    one = F.when((m >= 13) & (left >= 4), run(4)).when(m.isin(4, 5) & (left >= 2), run(2))
    two = F.when(m.between(5, 15) & (left >= 3), run(3)).when((m < 4) & (left == m), run(3))
    return each.select(F.col("h1").alias("id"), F.explode(F.array(one, two)).alias("bucket")).where("bucket is not null")


def could(x: str, y: str) -> Column:
    """Whether numbers of words and parities, TRAITS behind the prefixes x and y, allow an edit similarity of SIMILARITY."""
    m, n = f"{x}m", f"{y}m"
    allowed = F.floor(F.greatest(m, n) * (1 - SIMILARITY) + 1e-9)
    flipped = sum(F.bit_count(F.col(x + p).bitwiseXOR(F.col(y + p))) for p in TRAITS[1:])
    return (F.abs(F.col(m) - F.col(n)) <= allowed) & (flipped <= 2 * allowed)


def crowded(members: DataFrame) -> DataFrame:
    """members of the buckets of more than FEW_LINES."""
    large = members.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > FEW_LINES)
    return common.stored(common.join_counted(members, large, ["bucket"]).drop("n"), "crowded")


def meeting(members: DataFrame, large: DataFrame | None = None) -> DataFrame:
    """(a, b): members (bucket, id, comp and TRAITS) of a bucket, of two comps, that could be alike: all such pairs in buckets of up to FEW_LINES, else those with the smallest id and with the shortest line of about their length, and `rest` has the others."""
    kept = F.struct("id", "comp", *TRAITS)
    lead = members.groupBy("bucket").agg(F.min_by(kept, "id").alias("a"), F.count("*").alias("n")).where("n > 1")
    met = common.join_counted(members, lead, ["bucket"])
    few = met.where(F.col("n").between(3, FEW_LINES)).groupBy("bucket").agg(F.collect_list(kept).alias("x"))
    few = few.select("x", F.explode("x").alias("a")).select("a", F.explode("x").alias("b")).where("a.id < b.id and a.comp <> b.comp").where(could("a.", "b."))
    led = met.where(F.col("a.comp") != F.col("comp")).where(could("a.", ""))
    sized = (crowded(members) if large is None else large).withColumn("length", F.floor(F.log("m") / math.log(LENGTHS)))
    lead = sized.groupBy("bucket", "length").agg(F.min_by(kept, F.struct("m", "id")).alias("a"), F.count("*").alias("n")).where("n > 1")
    near = common.join_counted(sized, lead, ["bucket", "length"]).where(F.col("a.comp") != F.col("comp")).where(could("a.", ""))
    near = near.select(F.least("a.id", "id").alias("a"), F.greatest("a.id", "id").alias("b"))
    return led.select("a.id", F.col("id").alias("b")).toDF("a", "b").unionByName(few.select("a.id", F.col("b.id").alias("b")).toDF("a", "b")).unionByName(near).distinct()


def apart(members: DataFrame) -> DataFrame:
    """members of the buckets of several comps, with main, the comp of most members of their bucket, n, its members, and others, how many of them are not in main."""
    sums = members.groupBy("bucket", "comp").agg(F.count("*").alias("c")).groupBy("bucket").agg(F.sum("c").alias("n"), F.max(F.struct("c", "comp")).alias("most"))
    sums = sums.where("n > most.c").select("bucket", "n", F.col("most.comp").alias("main"), (F.col("n") - F.col("most.c")).alias("others"))
    return common.stored(common.join_counted(members, sums, ["bucket"]), "apart")


def with_others(each: DataFrame) -> DataFrame:
    """(a, b): of what `apart` returns, pairs that could be alike in the buckets of up to MOST_OTHERS others: every member meets the others, so pairs are as many as MOST_OTHERS a member at most."""
    each = each.where(F.col("others") <= MOST_OTHERS)
    lists = each.where("comp <> main").groupBy("bucket").agg(F.first("n").alias("n"), F.collect_list(F.struct("id", "comp", *TRAITS)).alias("x"))
    met = common.join_counted(each.drop("n"), lists, ["bucket"]).select("id", "comp", "main", *TRAITS, F.explode("x").alias("a"))
    met = met.where("a.comp <> comp and (comp = main or a.id < id)").where(could("a.", ""))
    return met.select(F.least("a.id", "id").alias("a"), F.greatest("a.id", "id").alias("b")).distinct()


def in_parts(each: DataFrame) -> DataFrame:
    """(a, b): of what `apart` returns, all pairs that could be alike in the buckets of more others.

    Members are dealt into parts of about PART lines and those into pairs of parts, a row each, so that no bucket is one task.
    """
    each = each.where(F.col("others") > MOST_OTHERS).withColumn("parts", F.ceil(F.col("n") / PART).cast("int"))
    packed = each.groupBy("bucket", "parts", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part")).agg(F.collect_list(F.struct("id", "comp", *TRAITS)).alias("lines"))
    sides = packed.select("bucket", "part", "lines", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    first = F.col("part") <= F.col("other")
    both = sides.groupBy("bucket", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q")).agg(F.first(F.when(first, F.col("lines")), True).alias("x"), F.first(F.when(~first, F.col("lines")), True).alias("y"))
    # Of two parts one may be empty; a part that meets itself has only one side.
    other = F.when(F.col("p") == F.col("q"), F.col("x")).otherwise(F.col("y"))
    met = both.select("x", F.explode(other).alias("b")).select("b", F.explode("x").alias("a")).where("a.comp <> b.comp").where(could("a.", "b."))
    return met.select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b")).distinct()


def finer(lines: DataFrame, q: int) -> DataFrame:
    """bucket, id, comp, TRAITS: lines (id, comp, TRAITS, codes) by their rarest runs of q words; each two that are alike share one.

    Two lines of m words and n >= m that are alike are e <= n * (1 - SIMILARITY) edits apart, n - m of them insertions at
    least. So of the m words floor(m * (1 - SIMILARITY)) go at most, as of the n words with n; and of the different runs of
    two words twice as many and one (an insertion breaks one run). Of either line one more of the rarest than may go are
    taken, in one order of all runs: if none of these were in both, fewer would be in both than stay. The order is by the
    number of lines that have a run, which leaves out what very many lines share.
    """
    n = F.size("codes")
    edits = F.floor(n * (1 - SIMILARITY) + 1e-9)
    word = F.transform("codes", lambda c: c.cast("long"))
    pair = F.zip_with(F.slice(word, 1, n - 1), F.slice(word, 2, n - 1), lambda x, y: x * (1 << 26) + y)
    each = lines.select("id", "comp", *TRAITS, (q * edits + q).alias("due"), F.array_distinct(F.when(n < q, word).otherwise(pair if q == 2 else word)).alias("runs"))
    each = each.select("id", "comp", *TRAITS, (F.col("due") - F.size("runs")).alias("due"), F.explode("runs").alias("bucket"))
    shared = common.stored(each.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "runs")
    few = shared.limit(BROADCAST_BUCKETS + 1).count() <= BROADCAST_BUCKETS
    # Runs of one line alone come first, and need no bucket: they are those that are missing here.
    met = each.join(F.broadcast(shared), "bucket") if few else common.join_counted(each, shared, ["bucket"])
    met = met.groupBy("id").agg(*(F.first(c).alias(c) for c in ("comp", *TRAITS, "due")), F.sort_array(F.collect_list(F.struct("n", "bucket"))).alias("runs"))
    met = met.withColumn("due", (F.col("due") + F.size("runs")).cast("int")).where("due > 0")
    return common.stored(met.select("id", "comp", *TRAITS, F.explode(F.slice("runs", F.lit(1), F.col("due"))).alias("r")).select("r.bucket", "id", "comp", *TRAITS), "finer")


def by_length(members: DataFrame) -> DataFrame:
    """members with their buckets cut by numbers of words: each is in the parts of its own and of the next greater length.

    Of two lines that are alike the longer has 1 / SIMILARITY times as many words at most, so it is in a part that the shorter is in.
    """
    own = F.floor(F.log("m") / math.log(BAND))
    return members.select("*", F.explode(F.array(own, own + 1)).alias("_band")).withColumn("bucket", F.xxhash64("bucket", "_band")).drop("_band")


def again(large: DataFrame, comps: DataFrame) -> DataFrame:
    """`apart` of large buckets, where comps (id, comp) has connected some."""
    placed = large.drop("comp").join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    return apart(common.stored(placed.select("bucket", "id", "comp", *TRAITS), "placed"))


def rest(members: DataFrame, comps: DataFrame) -> DataFrame:
    """(a, b): all pairs, that could be alike, of members of two comps (id, comp) in the buckets of more than FEW_LINES that comps does not connect yet."""
    each = again(crowded(members), comps)
    return with_others(each).unionByName(in_parts(each)).distinct()


def linked_again(large: DataFrame, comps: DataFrame, known: DataFrame) -> DataFrame:
    """Those of `rest` that are alike, without all pairs of a bucket of many others: its lines meet those of about their length, then by ever shorter runs that are rare among them."""
    each = again(large, comps)
    pairs = common.stored(with_others(each), "pairs")
    for q in (None, *RARE):
        many = each.where(F.col("others") > MOST_OTHERS)
        if many.isEmpty():
            break
        if q is None:
            each = apart(by_length(many.select("bucket", "id", "comp", *TRAITS)))
        else:
            # Stored with their codes, so that runs are cut of these lines alone: Spark may do it ahead of the join.
            crowd = many.select("id", "comp", *TRAITS).distinct().join(known.select("id", "codes"), "id")
            each = apart(finer(common.stored(crowd, "crowd"), q))
        pairs = pairs.unionByName(with_others(each))
    else:
        if not each.where(F.col("others") > MOST_OTHERS).isEmpty():
            pairs = pairs.unionByName(in_parts(each))
    return linked(common.stored(pairs.distinct(), "pairs"), known)


def linked(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Those pairs (a, b) of known lines (id, symbols) that are alike, word by word."""
    ends = [known.select(F.col("id").alias(c), F.col("symbols").alias(x)) for c, x in zip("ab", "xy")]
    return common.stored(pairs.join(ends[0], "a").join(ends[1], "b").where(alike(F.col("x"), F.col("y"))).select("a", "b"), "links")


def codes(line: Column) -> Column:
    """20 bits of the hash of each word, ten in either half of an int."""
    return F.transform(words(line), lambda w: F.xxhash64(w).bitwiseAND(F.lit(0x03FF03FF)).cast("int"))


def as_symbols(codes: Column) -> Column:
    """A string with one character for each code, from U+10000 on: two surrogates, of ten bits each."""
    return F.decode(F.unhex(F.array_join(F.transform(codes, lambda c: F.hex(c.cast("long").bitwiseOR(F.lit(0xD800DC00)))), "")), "UTF-16BE")


def with_words(heads: DataFrame, docs: DataFrame) -> DataFrame:
    """id and codes of heads (id, first), whose lines are read again by their documents, once."""
    wanted = heads.groupBy(F.col("first.doc_id").alias("_doc_id"), F.col("first.text_hash").alias("_hash")).agg(F.collect_list(F.struct("first.line", "id")).alias("_lines"))
    wanted = common.stored(wanted, "wanted")
    few = wanted.limit(BROADCAST_DOCS + 1).count() <= BROADCAST_DOCS
    met = docs.join(F.broadcast(wanted) if few else wanted, (docs["doc_id"] == F.col("_doc_id")) & (F.xxhash64(docs["text"]) == F.col("_hash")))
    each = met.select(F.split(docs["text"], "\n", -1).alias("_split"), F.explode("_lines").alias("l")).select("l.id", codes(F.get("_split", F.col("l.line"))).alias("codes"))
    return each.dropDuplicates(["id"])


def read_again(ids: DataFrame, heads: DataFrame, docs: DataFrame) -> DataFrame:
    """id, codes and symbols of the lines whose first hashes are ids (id), each from its first place. Texts are shuffled only for more than BROADCAST_LINES of them."""
    ids = common.stored(ids.distinct(), "ids")
    if ids.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES:
        # Only what stands at a wanted place is normalised; a line that is met by chance has an id that nothing asks for.
        place = common.stored(heads.join(F.broadcast(ids), F.col("h1") == F.col("id")).select(F.xxhash64("first.doc_id", "first.text_hash", "first.line").alias("place")), "places")
        met = lines(docs).select(F.xxhash64("doc_id", "text_hash", "line").alias("place"), "raw").join(F.broadcast(place), "place")
        each = met.select(normalised("raw").alias("norm")).select(F.xxhash64("norm").alias("id"), codes(F.col("norm")).alias("codes")).dropDuplicates(["id"])
    else:
        each = with_words(heads.select(F.col("h1").alias("id"), "first").join(ids, "id"), docs)
    return common.stored(each.select("id", "codes", as_symbols(F.col("codes")).alias("symbols")), "known")


def alike(x: Column, y: Column) -> Column:
    """Edit similarity of SIMILARITY or more. Limits grow step by step, so that nearly equal lines cost a narrow band of the table.

    Branches of a CASE are only evaluated when reached; operands of AND and OR may be evaluated ahead of both.
    """
    allowed = F.floor(F.greatest(F.length(x), F.length(y)) * (1 - SIMILARITY) + 1e-9).cast("int")
    found = F.when(F.abs(F.length(x) - F.length(y)) > allowed, False).when(x == y, True)
    for limit in (4, 64, 1024):
        found = found.when(allowed <= limit, F.call_function("levenshtein", x, y, allowed) >= 0).when(F.levenshtein(x, y, limit) >= 0, True)
    return found.otherwise(F.call_function("levenshtein", x, y, allowed) >= 0)


def merged(comps: DataFrame, more: DataFrame) -> DataFrame:
    """Components (id, comp) with further links (a, b) between them or lines of none."""
    ends = more
    for c in "ab":
        ends = ends.join(comps.select(F.col("id").alias(c), F.col("comp").alias("to")), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
    found = common.stored(common.connected_components(ends.select(F.col("a").alias("src"), F.col("b").alias("dst")), "all"), "merged")
    moved = comps.join(found.select(F.col("id").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("id", F.coalesce("to", "comp").alias("comp"))
    return moved.unionByName(found.join(comps, "id", "left_anti"))


def groups(docs: DataFrame, several: bool = False, exact: bool = False) -> DataFrame:
    """id (doc_id, text_hash, line) and kept (the id that its group keeps) of every line with words, or of those in groups of several.

    Between different lines the first hash stands for a line, so that the linking works on plain longs.
    """
    docs = docs.select("doc_id", "text")
    with common.scratch() as keep:
        found = keep(occurrences(docs))
        heads = common.stored(found.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.count("*").alias("n"), *(F.max(t).alias(t) for t in TRAITS)), "heads")
        each = all_runs(docs) if exact else blocks(found)
        # Most shared buckets hold two lines, which the aggregation names; only the others are joined with all lines again.
        shared = common.stored(each.groupBy("bucket").agg(F.min("id").alias("a"), F.max("id").alias("z"), F.count("*").alias("n")).where("a <> z"), "shared")
        common.forget(docs.sparkSession)
        large = shared.where("n > 2").select("bucket")
        few = large.limit(BROADCAST_BUCKETS + 1).count() <= BROADCAST_BUCKETS
        pairs = shared.where("n = 2").select("bucket", F.explode(F.array("a", "z")).alias("id"))
        members = pairs.unionByName(each.join(F.broadcast(large) if few else large, "bucket").select("bucket", "id").distinct())
        members = common.stored(members.join(heads.groupBy(F.col("h1").alias("id")).agg(*(F.max(t).alias(t) for t in TRAITS)), "id").withColumn("comp", F.col("id")), "blocks")
        large = crowded(members)
        pairs, comps = common.stored(meeting(members, large), "pairs"), members.select("id", "comp").limit(0)
        ends = pairs.select(F.explode(F.array("a", "b")).alias("id"))
        if not ends.isEmpty() or not large.isEmpty():
            known = read_again(ends.unionAll(large.select("id")), heads, docs)
            common.forget(docs.sparkSession)
            comps = common.connected_components(linked(pairs, known).select(F.col("a").alias("src"), F.col("b").alias("dst")), "few")
            more = linked_again(large, comps, known)
            if not more.isEmpty():
                comps = merged(comps, more)
        joined = common.stored(heads.select("h1", "h2", "first").join(comps.withColumnRenamed("id", "h1"), "h1"), "placed")
        # The smallest line of a component, for which many lines may ask, is its own row of the table of components.
        kept = joined.groupBy("comp").agg(F.min("first").alias("kept"), F.count("*").alias("n"))
        kept = common.join_counted(joined, kept, ["comp"]).select("h1", "h2", "kept")
        every = heads.select("h1", "h2", "first", "n").join(kept, ["h1", "h2"], "left").select("h1", "h2", "n", F.col("first").alias("own"), F.coalesce("kept", "first").alias("kept"))
        if several:
            every = every.where("n > 1 or kept <> own")
        every = keep(common.stored(every.select("h1", "h2", "n", "kept"), "kept"))
        common.forget(docs.sparkSession)
    return common.join_counted(found.select("id", "h1", "h2"), every, ["h1", "h2"]).select("id", "kept")


def rewritten(docs: DataFrame) -> DataFrame:
    """row (docs' columns), text, gone (the numbers of the lines that go; null: none) and rest, what remains of text."""
    gone = groups(docs, several=True).where("id <> kept").groupBy(F.col("id.doc_id").alias("gone_id"), F.col("id.text_hash").alias("gone_hash")).agg(F.collect_set("id.line").alias("gone"))
    own = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["doc_id"].alias("own_id"), docs["text"].alias("text"))
    joined = own.join(gone, (F.col("own_id") == F.col("gone_id")) & (F.xxhash64("text") == F.col("gone_hash")), "left")
    # The text is split once and the numbers of the lines that stay found by hash; a one-element array binds both.
    parts = F.split("text", "\n", -1)
    stay = F.transform(F.array(parts), lambda x: F.struct(x.alias("x"), F.array_except(F.sequence(F.lit(0), F.size(x) - 1), "gone").alias("i")))
    rest = F.transform(stay, lambda s: F.array_join(F.transform(s["i"], lambda i: F.get(s["x"], i)), "\n"))[0]
    return joined.select("row", "text", "gone", F.when(F.col("gone").isNull(), F.col("text")).otherwise(rest).alias("rest"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the hash of what remains, a row per row of docs."""
    lines_ = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1)))
    return rewritten(docs.select("doc_id", "text")).select(
        "row.doc_id", lines_.cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"), F.sha2(F.coalesce("rest", F.lit("")), 256).alias("text_sha256")
    )


def dedup(docs: DataFrame) -> DataFrame:
    """docs with the repeated lines taken out of text, without those that have no words left; all columns stay, n_chars (if there) follows the text."""
    changed = F.col("gone").isNotNull()

    def column(c: str) -> Column:
        if c == "text":
            return F.col("rest").alias(c)
        own = F.col("row").getField(c)
        return (F.when(changed, F.length("rest")).otherwise(own).cast(docs.schema[c].dataType) if c == "n_chars" else own).alias(c)

    return rewritten(docs).where(~changed | (F.btrim("rest", F.lit(SEPARATORS)) != "")).select(*map(column, docs.columns))
