"""What several operators share: tables, connected components, and word hashing on byte blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.storage import forget, scratch, shared_dir, stored

#: Word bytes: 0-9, A-Z, a-z and everything outside ASCII.
WORD = np.zeros(256, bool)
WORD[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
WORD[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: What Java and DuckDB regular expressions call the bytes between words.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(id, comp) for every end of edges (src, dst), of any orderable type; comp is the smallest id that can be reached.

    Alternates large-star and small-star steps (Kiveris et al., 2014). Each step is one aggregation with map-side
    minima and one join, so a centre with very many links is split like any skewed join. Empty edges give no rows.
    """
    now = stored(edges.where("src <> dst").select(F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo")).distinct(), label)
    mark = None
    while True:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(least, "hi")
        small = joined.select("lo", "m").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionAll(joined.select("hi", F.col("m").alias("lo"))).distinct()
        now = stored(small, label)
        seen = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("x"), F.bit_xor(F.xxhash64("lo", "hi")).alias("y")).first()
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("hi").alias("id"), F.col("lo").alias("comp")).unionAll(now.select(F.col("lo").alias("id"), F.col("lo").alias("comp"))).distinct()


def star_pairs(members: DataFrame) -> DataFrame:
    """(a, b): every member (bucket, id) of a bucket with the smallest id of that bucket. Linear in the members."""
    lead = members.groupBy("bucket").agg(F.min("id").alias("a"), F.max("id").alias("z"), F.count("*").alias("n")).where("a <> z").select("bucket", "a", "n")
    return join_counted(members, lead, ["bucket"]).where("id <> a").select("a", F.col("id").alias("b")).distinct()


def join_counted(rows: DataFrame, table: DataFrame, on: list[str], share: int = 2000) -> DataFrame:
    """rows joined with table, a row per key, whose column n says how many of rows have the key; no key is one task.

    Keys of at least one in share of all counted rows are at most share, so they are broadcast; the others are shuffled.
    """
    table = stored(table, "counted")
    total = table.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * share >= total
    named = table.where(hot)
    far = rows.join(F.broadcast(named.select(on)), on, "left_anti").join(table.where(~hot), on)
    return rows.join(F.broadcast(named), on).unionByName(far)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def spans(lengths: list[int], size: int = 1 << 20, rows: int = 4000) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of rows of about size bytes; a longer row is a run of its own, whole."""
    first, total = 0, 0
    for i, n in enumerate(lengths):
        if i > first and (total + n > size or i - first >= rows):
            yield first, i
            first, total = i, 0
        total += n
    if first < len(lengths):
        yield first, len(lengths)


def blocks(texts: list[bytes], size: int = 1 << 20, rows: int = 4000) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of such runs."""
    for a, b in spans([len(t) for t in texts], size, rows):
        yield a, texts[a:b]


class Words:
    """Words of many texts at once. A word's 64-bit hash is a polynomial of its lower-cased bytes, by prefix sums over the block."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self) -> None:
        self.byte = np.random.Generator(np.random.PCG64(20240607)).integers(0, 1 << 64, 256, dtype=np.uint64)
        self.power = self.inverse = np.ones(0, np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.power) < n:
            n = max(n, 1 << 21)
            self.power = np.cumprod(np.full(n, self.BASE, np.uint64))
            self.inverse = np.cumprod(np.full(n, pow(self.BASE, -1, 1 << 64), np.uint64))
        return self.power, self.inverse

    def split(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lower-cased block of all texts, starts and ends of its words, and first word of each text (one more at the end)."""
        block = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        step = np.diff(WORD[block].view(np.int8), prepend=np.int8(0))
        starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        begin = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=begin[1:])
        return block, starts, ends, np.searchsorted(starts, begin)

    def hashes(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every word, and first word of each text (one more at the end)."""
        block, starts, ends, first = self.split(texts)
        power, inverse = self.powers(len(block) + 1)
        sums = np.zeros(len(block) + 1, np.uint64)
        np.cumsum(self.byte[block] * power[: len(block)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * inverse[starts]), first

    def shingles(self, texts: list[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct shingles of each text as sorted 52-bit ids: text index, id, count; then words of each text and a hash of all its words, as two columns.

        A text of fewer words than width, but not none, has one shingle of all its words. At most 4,096 texts.
        """
        h, first = self.hashes(texts)
        n = np.diff(first)
        odd = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
        m = max(0, len(h) - width + 1)
        s = np.zeros(m, np.uint64)
        for j in range(width):
            s += h[j : j + m] * odd[j]
        of = np.repeat(np.arange(len(texts), dtype=np.uint64), n)
        whole = np.arange(m) + width <= np.repeat(first[1:], n)[:m]
        keys = [(of[:m][whole] << np.uint64(52)) | (mix(s[whole]) >> np.uint64(12))]
        for i in np.flatnonzero((n > 0) & (n < width)):
            x = np.uint64(int(n[i]))
            for w in h[first[i] : first[i + 1]]:
                x = _fold(x, w)
            keys.append(np.array([(np.uint64(i) << np.uint64(52)) | (x >> np.uint64(12))]))
        key = np.sort(np.concatenate(keys))
        new = np.ones(len(key), bool)
        np.not_equal(key[1:], key[:-1], out=new[1:])
        at = np.flatnonzero(new)
        count = np.diff(np.append(at, len(key)))
        key = key[at]
        return (key >> np.uint64(52)).astype(np.int64), key & np.uint64((1 << 52) - 1), count, n, self.whole(h, first)

    def whole(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Two 64-bit hashes of each text's word sequence."""
        power, inverse = self.powers(len(h) + 1)
        out = np.zeros((len(first) - 1, 2), np.uint64)
        for k in range(2):
            x = mix(h + np.uint64(k + 1)) if k else h
            sums = np.zeros(len(h) + 1, np.uint64)
            np.cumsum(x * power[: len(h)], out=sums[1:])
            out[:, k] = mix((sums[first[1:]] - sums[first[:-1]]) * inverse[np.minimum(first[:-1], max(0, len(h)))] + np.uint64(k) + np.diff(first).astype(np.uint64))
        return out


def _fold(x: np.uint64, w: np.uint64) -> np.uint64:
    return mix(np.array([int(x) * 0x9E3779B97F4A7C15 + int(w) & (1 << 64) - 1], np.uint64))[0]


def slices(batches, rows: int = 1000):
    """Arrow batches in slices of so many rows, so that what is unpacked at a time stays small whatever the batches hold."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def texts_of(column) -> list[bytes]:
    """Arrow strings as UTF-8; null is empty."""
    import pyarrow as pa

    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


__all__ = ["BETWEEN_WORDS", "LOWER", "WORD", "Words", "blocks", "connected_components", "forget", "join_counted", "mix", "scratch", "shared_dir", "slices", "spans", "star_pairs", "stored", "table", "texts_of"]
