"""MinHash near-dedup: consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard similarity.

The weight of a shingle in a document is (1 + ln tf) * idf, with idf = 1 + ln((1 + N) / (1 + df)) / ln(1 + N): 2 for what
no other text has, 1 for what all have. N counts the documents with words, and df those that hold the shingle, in a
count-min sketch over all documents: two rows of 2 ** SLOTS_LOG2 counters, of which the lesser counts. So df is never too
small, and too large by less than two mean counters (L * N / 2 ** SLOTS_LOG2 with L shingles a document) for three shingles
in four at least (Markov's bound on either row); it is the same for a shingle wherever it stands.

Nulls, ties and odd rows: a null text is empty; a text without words is in a class with equal texts only; a text of fewer than five
words has one shingle of all its words; equal word sequences are one class without sampling. Rows without doc_id are in
no class (`classes` leaves them out, `dedup` keeps them). Rows that repeat a doc_id are one document. Other columns are
not read, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common

WIDTH, SIMILARITY = 5, 0.8
#: 10 bands of 3 samples meet at similarity 0.8 with probability 1 - (1 - 0.8 ** 3) ** 10 = 0.9992.
BANDS, ROWS = 10, 3
#: Counters of a row of the sketch, and those that are shipped as one slice.
SLOTS_LOG2, SLICE = 21, 1 << 15
#: Steps of the logarithm of a counter, to base 2, that the shipped tables keep.
STEPS = 1024


def slots(sid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The counters of shingles in the two rows, the second behind the first."""
    one = (sid >> np.uint64(52 - SLOTS_LOG2)).astype(np.int64)
    return one, (common.mix(sid) >> np.uint64(64 - SLOTS_LOG2)).astype(np.int64) + (1 << SLOTS_LOG2)


def _sketch(batches):
    """Per task: counters of the documents that hold its shingles, in slices: a byte each, and those beyond it by place and count."""
    words, counters, docs = common.Words(), np.zeros(2 << SLOTS_LOG2, np.int64), 0
    for batch in common.slices(batches):
        for _, texts in common.blocks(common.texts_of(batch.column(0))):
            _, sid, _, n, _ = words.shingles(texts, WIDTH)
            for at in slots(sid):
                np.add.at(counters, at, 1)
            docs += int((n > 0).sum())
    rows = [(-1, docs, b"", b"", b"")] if docs else []
    for i in range(0, len(counters), SLICE):
        own = counters[i : i + SLICE]
        if own.any():
            at = np.flatnonzero(own > 255)
            rows.append((i // SLICE, 0, np.where(own > 255, 0, own).astype(np.uint8).tobytes(), at.astype("<u2").tobytes(), own[at].astype("<i8").tobytes()))
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    for row in rows:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], ["slice", "docs", "low", "at", "n"])


def _add_slices(batches):
    sums: dict[int, np.ndarray] = {}
    docs = 0
    for batch in batches:
        for k, d, low, at, n in zip(*(c.to_pylist() for c in batch.columns)):
            docs += d
            if k >= 0:
                own = sums.setdefault(k, np.zeros(SLICE, np.int64))
                own += np.frombuffer(low, np.uint8)
                own[np.frombuffer(at, "<u2")] += np.frombuffer(n, "<i8")
    rows = [(k, 0, coded(s).astype("<u2").tobytes()) for k, s in sums.items()] + ([(-1, docs, b"")] if docs else [])
    for row in rows:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int64(), pa.binary()))], ["slice", "docs", "n"])


def coded(counters: np.ndarray) -> np.ndarray:
    """Logarithms of counters in 16 bits, as they are shipped."""
    return np.round(STEPS * np.log2(1.0 + counters)).astype(np.uint16)


def frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Documents with words, and the codes of the counters of both rows of the sketch: of one size, whatever the input."""
    sketch = (
        docs.select("text")
        .mapInArrow(_sketch, "slice int, docs long, low binary, at binary, n binary")
        .repartition((2 << SLOTS_LOG2) // SLICE, "slice")
        .mapInArrow(_add_slices, "slice int, docs long, n binary")
    )
    total, codes = 0, np.zeros(2 << SLOTS_LOG2, np.uint16)
    for r in sketch.collect():  # a fixed number of counters, each slice from one task
        if r["slice"] < 0:
            total += r["docs"]
        else:
            codes[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["n"], "<u2")
    return total, codes


class Weigher:
    def __init__(self, total: int, codes: np.ndarray | None = None) -> None:
        self.codes = codes
        df = np.exp2(np.arange(1 << 16) / STEPS) - 1
        self.idf = 1 + np.maximum(0.0, np.log((1 + total) / (1 + df))) / np.log(1 + max(1, total))

    def __call__(self, sid: np.ndarray, tf: np.ndarray) -> np.ndarray:
        w = 1 + np.log(tf)
        if self.codes is not None:
            one, two = slots(sid)
            w *= self.idf[np.minimum(self.codes[one], self.codes[two])]
        return w


class Sampler:
    """Improved consistent weighted sampling (Ioffe, 2010). The two gamma variates and the uniform one of a shingle and a
    sample come from 16-bit quantile tables, addressed by three parts of one hash."""

    def __init__(self, samples: int) -> None:
        u = (np.arange(1 << 16) + 0.5) / (1 << 16)
        x = np.full(len(u), 1.0)
        for _ in range(200):  # quantiles of gamma(2, 1): 1 - (1 + x) exp(-x) = u, by bisection on a log scale
            if _ == 0:
                lo, hi = np.full(len(u), -20.0), np.full(len(u), 5.0)
            x = (lo + hi) / 2
            low = -np.expm1(-np.exp(x)) - np.exp(x - np.exp(x)) < u
            lo, hi = np.where(low, x, lo), np.where(low, hi, x)
        self.ln_c = x.astype(np.float32)
        self.r = np.exp(x).astype(np.float32)
        self.inv = np.exp(-x).astype(np.float32)
        self.b = u.astype(np.float32)
        self.odd = common.mix(np.arange(1, samples + 1, dtype=np.uint64)) | np.uint64(1)

    def __call__(self, sid: np.ndarray, ln_w: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """A (documents, samples) table of 64-bit samples."""
        out = np.zeros((len(starts), len(self.odd)), np.uint64)
        ln_w = ln_w.astype(np.float32)
        for k, odd in enumerate(self.odd):
            x = sid * odd
            x ^= x >> np.uint64(31)
            x *= np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(29)
            part = x.view(np.uint16).reshape(-1, 4)
            i, b = part[:, 1], self.b[part[:, 2]]
            r = self.r[i]
            t = np.floor(ln_w * self.inv[i] + b)
            a = self.ln_c[part[:, 3]] - r * (t - b + 1)
            low = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, starts), lengths))
            at = low[np.searchsorted(low, starts)]
            out[:, k] = common.mix(sid[at] * odd + t[at].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return out


def signatures(docs: DataFrame, weigher: Weigher) -> DataFrame:
    """doc_id, h1 and h2 (hashes of the word sequence), total weight, bands: array of band keys."""

    def sign(batches):
        words, sampler = common.Words(), Sampler(BANDS * ROWS)
        for batch in common.slices(batches):
            ids, texts = batch.column(0), common.texts_of(batch.column(1))
            for first, some in common.blocks(texts):
                of, sid, tf, n, whole = words.shingles(some, WIDTH)
                full, bare = np.flatnonzero(n > 0), np.flatnonzero(n == 0)
                if len(bare):  # no words: known by the text itself, in no band
                    own = [hashlib.blake2b(some[i], digest_size=16).digest() for i in bare]
                    h = [pa.array(np.frombuffer(b"".join(own), "<i8")[k::2]) for k in (0, 1)]
                    empty = pa.ListArray.from_arrays(pa.array(np.zeros(len(bare) + 1, np.int32)), pa.array([], pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(bare + first)), *h, pa.array(np.zeros(len(bare))), empty], ["doc_id", "h1", "h2", "weight", "bands"])
                if not len(full):
                    continue
                w = weigher(sid, tf)
                lengths = np.bincount(of, minlength=len(some))[full]
                starts = np.cumsum(lengths) - lengths
                got = sampler(sid, np.log(w), starts, lengths)
                keys = np.zeros((len(full), BANDS), np.uint64)
                for j in range(ROWS):
                    keys = common.mix(keys + got[:, j::ROWS][:, :BANDS] + np.arange(BANDS, dtype=np.uint64) * np.uint64(2 * j + 1))
                flat = pa.array(keys.astype(np.int64).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1, dtype=np.int32) * BANDS), flat)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(full + first)), *(pa.array(whole[full, k].astype(np.int64)) for k in (0, 1)), pa.array(np.add.reduceat(w, starts)), lists],
                    ["doc_id", "h1", "h2", "weight", "bands"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(sign, f"doc_id {kind}, h1 long, h2 long, weight double, bands array<long>")


def verified(pairs: DataFrame, docs: DataFrame, weigher: Weigher) -> DataFrame:
    """Those pairs (a, b) whose texts' weighted Jaccard similarity is SIMILARITY or more, with it."""

    def verify(batches):
        words = common.Words()
        for batch in common.slices(batches):
            a, b = (common.texts_of(batch.column(k)) for k in (2, 3))
            for at, end in common.spans([len(x) + len(y) for x, y in zip(a, b)], rows=2000):
                m = end - at
                of, sid, tf, _, _ = words.shingles(a[at:end] + b[at:end], WIDTH)
                w = weigher(sid, tf)
                cut = np.searchsorted(of, m)
                ka = (of[:cut].astype(np.uint64) << np.uint64(52)) | sid[:cut]
                kb = ((of[cut:] - m).astype(np.uint64) << np.uint64(52)) | sid[cut:]
                total = np.bincount(of[:cut], w[:cut], m) + np.bincount(of[cut:] - m, w[cut:], m)
                shared = np.zeros(m)
                if len(ka) and len(kb):
                    to = np.minimum(np.searchsorted(ka, kb), len(ka) - 1)
                    hit = ka[to] == kb
                    shared = np.bincount(of[cut:][hit] - m, np.minimum(w[:cut][to[hit]], w[cut:][hit]), m)
                alike = shared / np.maximum(total - shared, 1e-300)
                keep = np.flatnonzero(alike >= SIMILARITY - 1e-12) + at
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep)), pa.array(alike[keep - at])], ["a", "b", "similarity"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", "text")
    return (
        pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
        .join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
        .select("a", "b", "text_a", "text_b")
        .mapInArrow(verify, f"a {kind}, b {kind}, similarity double")
    )


#: Documents, and shingles by weight, of a block; two blocks at a time are compared in memory.
BLOCK_DOCS, BLOCK_WEIGHT = 256, 500_000


def blocks_of(members: DataFrame, comps: DataFrame, weight: DataFrame) -> DataFrame:
    """(bucket, p, q, id, comp): members of the buckets that comps doesn't connect, dealt into blocks and those into pairs of blocks."""
    placed = members.join(comps, "id", "left").join(weight.withColumnRenamed("doc_id", "id"), "id").select("bucket", "id", F.coalesce("comp", "id").alias("comp"), "weight")
    mixed = placed.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("n"), F.sum("weight").alias("w")).where("x <> y")
    n = F.greatest(F.ceil(F.col("n") / BLOCK_DOCS), F.ceil(F.col("w") / BLOCK_WEIGHT)).cast("int")
    dealt = placed.join(mixed.select("bucket", n.alias("blocks")), "bucket").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    each = dealt.select("bucket", "id", "comp", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return each.select("bucket", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "id", "comp")


def forest(m: int, i: np.ndarray, j: np.ndarray, comp: np.ndarray) -> list[int]:
    """Which of the links (i, j) a spanning forest needs, where members of one comp are joined already."""
    root = list(range(m))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    _, head, back = np.unique(comp, return_index=True, return_inverse=True)
    for x, y in enumerate(head[back].tolist()):
        root[find(x)] = find(y)
    out = []
    for k, (x, y) in enumerate(zip(i.tolist(), j.tolist())):
        if (x := find(x)) != (y := find(y)):
            root[x] = y
            out.append(k)
    return out


def similarities(words: common.Words, texts: list[bytes], weigher: Weigher) -> np.ndarray:
    """Weighted Jaccard similarity of all texts of two blocks. A count of n is n features with the weights' increments, so that minima are products."""
    m = len(texts)
    of, sid, tf, _, _ = words.shingles(texts, WIDTH)
    idf = weigher(sid, np.ones(len(sid)))
    total = np.bincount(of, (1 + np.log(tf)) * idf, m)
    level = np.arange(tf.sum()) - np.repeat(np.cumsum(tf) - tf, tf) + 1
    of, sid, idf = (np.repeat(x, tf) for x in (of, sid, idf))
    value = np.sqrt(np.where(level == 1, 1.0, np.log(level / np.maximum(level - 1, 1))) * idf)
    _, feature, times = np.unique(sid + common.mix(level.astype(np.uint64)), return_inverse=True, return_counts=True)
    column = np.cumsum(times > 1) - 1
    use = times[feature] > 1
    of, value, feature = of[use], value[use], column[feature[use]]
    order = np.argsort(feature, kind="stable")
    of, value, feature = of[order], value[order], feature[order]
    shared, step = np.zeros((m, m)), 8192
    for first in range(0, int(feature[-1]) + 1 if len(feature) else 0, step):
        lo, hi = np.searchsorted(feature, (first, first + step))
        dense = np.zeros((m, min(step, int(feature[-1]) + 1 - first)))
        dense[of[lo:hi], feature[lo:hi] - first] = value[lo:hi]
        shared += dense @ dense.T
    return shared / np.maximum(total[:, None] + total[None, :] - shared, 1e-300)


def linked(dealt: DataFrame, docs: DataFrame, weigher: Weigher) -> DataFrame:
    """(a, b) of a spanning forest of the links in every pair of blocks."""

    def compare(batches):
        words, rows, key = common.Words(), [], None

        def links():
            comp = np.array([r[1] for r in rows])
            i, j = np.nonzero(np.triu(similarities(words, [r[2] for r in rows], weigher) >= SIMILARITY - 1e-9, 1))
            ids = [r[0] for r in rows]
            return [(ids[i[k]], ids[j[k]]) for k in forest(len(rows), i, j, comp)]

        kind = None
        for batch in common.slices(batches):
            kind = batch.schema.field(1).type
            found = []
            for k, i, c, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), common.texts_of(batch.column(3))):
                if k != key and rows:
                    found += links()
                    rows.clear()
                key = k
                rows.append((i, c, t))
            a, b = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind)], ["a", "b"])
        if rows:
            a, b = zip(*found) if (found := links()) else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind)], ["a", "b"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select(F.col("doc_id").alias("id"), "text").dropDuplicates(["id"])
    keyed = dealt.join(texts, "id").select(F.concat_ws(":", "bucket.band", "bucket.key", "p", "q").alias("key"), "id", "comp", "text")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(compare, f"a {kind}, b {kind}")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its class): a row per doc_id.

    Buckets of a band are first compared with their smallest member, which is linear and joins most copies. Only buckets
    that still hold several components go on to blocks, where all their members meet in memory and a spanning forest of
    the links comes out; so no pairs are written, and no link between components is missed.
    """
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    weigher = Weigher(*frequencies(docs))
    signs = common.stored(signatures(docs, weigher), "signatures")
    same = signs.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    rep = common.stored(common.join_counted(signs, same, ["h1", "h2"]).select("doc_id", "rep", "weight", "bands"), "representatives")
    heads = rep.where("doc_id = rep")
    members = heads.select(F.posexplode("bands").alias("band", "key"), F.col("doc_id").alias("id")).select(F.struct("band", "key").alias("bucket"), "id").distinct()
    shared = members.groupBy("bucket").agg(F.min("id").alias("x"), F.max("id").alias("y")).where("x <> y").select("bucket")
    members = common.stored(members.join(shared, "bucket"), "buckets")
    weight = heads.groupBy("doc_id").agg(F.max("weight").alias("weight"), F.min("weight").alias("low"))
    # Similarity is at most the ratio of the total weights.
    wa, wb = (weight.select(F.col("doc_id").alias(c), F.col("weight").alias(f"w{c}"), F.col("low").alias(f"l{c}")) for c in "ab")
    possible = common.star_pairs(members).join(wa, "a").join(wb, "b").where(f"wa >= {SIMILARITY - 1e-9} * lb and wb >= {SIMILARITY - 1e-9} * la").select("a", "b")
    links = common.stored(verified(possible, docs, weigher), "links")
    copies = rep.where("doc_id <> rep").select(F.col("doc_id").alias("src"), F.col("rep").alias("dst"))
    comps = common.connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionAll(copies), "star")
    more = common.stored(linked(blocks_of(members, comps, weight.select("doc_id", "weight")), docs, weigher), "more")
    if not more.isEmpty():
        comps = common.connected_components(comps.select(F.col("id").alias("src"), F.col("comp").alias("dst")).unionAll(more.select(F.col("a").alias("src"), F.col("b").alias("dst"))), "all")
    return docs.select("doc_id").distinct().join(comps.select(F.col("id").alias("doc_id"), "comp"), "doc_id", "left").select("doc_id", F.coalesce("comp", "doc_id").alias("class_id"))


def dedup(docs: DataFrame) -> DataFrame:
    """One document of each class, whole, with all columns of docs; rows without doc_id stay."""
    stay = classes(docs).where("doc_id = class_id").select("doc_id")
    return docs.where("doc_id is not null").join(stay, "doc_id", "left_semi").dropDuplicates(["doc_id"]).unionByName(docs.where("doc_id is null"))
