"""Language ID by rank-order profiles (Cavnar and Trenkle, 1994).

A profile is the PROFILE most frequent n-grams, of 1 to 3 characters, of lower-cased words with a blank on both sides. A
document goes to the language whose profile has the least out-of-place distance to its own; an n-gram that a profile
lacks counts PROFILE places. Profiles count all labelled rows whose crc32(doc_id as text) mod 3 is not 1.

Nulls, ties and odd rows: a null text, or one without a letter, is `und` with score 0, as is every text where nothing can
be learned; equal counts are ranked by the n-gram's hash, equal distances go to the smaller name; rows without doc_id are
neither learned from nor held out; repeated rows are judged alike. Texts are read whole. Other columns than doc_id, text
and lang are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import mix, slices

PROFILE = 300
UNDETERMINED = "und"
COUNT_BITS = 22


class Grams:
    """N-gram counts of many texts at once; an n-gram is known by 32 bits of its hash."""

    def __init__(self) -> None:
        self.letter = np.array([chr(c).isalpha() for c in range(0x110000)])

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text index, n-gram and count, sorted by text and n-gram. At most 1,024 texts."""
        code = np.frombuffer((" " + " ".join(texts) + " ").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(t.lower()) + 1 for t in texts], np.int64)
        of = np.repeat(np.arange(len(texts), dtype=np.uint64), lengths)
        of = np.concatenate([of[:1], of])  # the first blank belongs to the first text
        code = np.where(self.letter[code], code, np.uint32(32)).astype(np.uint64)
        keep = np.ones(len(code), bool)
        keep[1:] = (code[1:] != 32) | (code[:-1] != 32)
        code, of = np.append(code[keep], np.uint64(32)), np.append(of[keep], of[-1])
        blank = code == 32
        one, two, three = code[:-2], (code[:-2] << np.uint64(21)) | code[1:-1], (code[:-2] << np.uint64(42)) | (code[1:-1] << np.uint64(21)) | code[2:]
        use = ~blank[:-2], ~(blank[:-2] & blank[1:-1]), ~blank[1:-1]
        # An n-gram that starts with a blank belongs to the word after it.
        owner = np.where(blank[:-2], of[1:-1], of[:-2])
        keys = [(owner[u] << np.uint64(32)) | (mix(g[u] + np.uint64(n)) >> np.uint64(32)) for n, (g, u) in enumerate(zip((one, two, three), use))]
        key = np.sort(np.concatenate(keys))
        new = np.ones(len(key), bool)
        np.not_equal(key[1:], key[:-1], out=new[1:])
        at = np.flatnonzero(new)
        return (key[at] >> np.uint64(32)).astype(np.int64), key[at] & np.uint64(0xFFFFFFFF), np.diff(np.append(at, len(key)))

    def top(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text index, n-gram and rank (from 0) of each text's PROFILE most frequent n-grams."""
        of, gram, n = self.counts(texts)
        most = (1 << COUNT_BITS) - 1
        if n.max(initial=0) <= most:  # text, count and n-gram fit one key
            key = np.sort((of.astype(np.uint64) << np.uint64(54)) | ((most - n).astype(np.uint64) << np.uint64(32)) | gram)
            of, gram = (key >> np.uint64(54)).astype(np.int64), key & np.uint64(0xFFFFFFFF)
        else:
            order = np.lexsort((gram, -n, of))
            of, gram = of[order], gram[order]
        rank = np.arange(len(of)) - np.searchsorted(of, of)
        keep = rank < PROFILE
        return of[keep], gram[keep], rank[keep]


def runs(texts: list[str], size: int = 1 << 19, rows: int = 1000):
    """Runs of texts of about size characters; a longer text is a run of its own, whole."""
    first, total = 0, 0
    for i, t in enumerate(texts):
        if i > first and (total + len(t) > size or i - first >= rows):
            yield first, texts[first:i]
            first, total = i, 0
        total += len(t)
    if first < len(texts):
        yield first, texts[first:]


def learned(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages by name, n-grams in order, and ranks (n-grams, languages), PROFILE where a profile lacks the n-gram."""

    def count(batches):
        grams, langs = Grams(), {}
        total_keys, total_n = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def merged(keys, ns):
            key, back = np.unique(np.concatenate(keys), return_inverse=True)
            return key, np.bincount(back, np.concatenate(ns), len(key)).astype(np.int64)

        for batch in slices(batches):
            names = batch.column(1).to_pylist()
            keys, ns = [total_keys], [total_n]
            for first, texts in runs([t or "" for t in batch.column(0).to_pylist()]):
                of, gram, n = grams.counts(texts)
                own = np.array([langs.setdefault(x, len(langs)) for x in names[first : first + len(texts)]], np.uint64)
                key, n = merged([(own[of] << np.uint64(32)) | gram], [n])
                keys.append(key)
                ns.append(n)
            total_keys, total_n = merged(keys, ns)
        name = np.array(list(langs) or [""], object)
        yield pa.RecordBatch.from_arrays(
            [pa.array(name[(total_keys >> np.uint64(32)).astype(np.int64)], pa.string()), pa.array((total_keys & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(total_n)], ["lang", "gram", "n"]
        )

    rows = docs.where("lang is not null and crc32(cast(doc_id as string)) % 3 <> 1").select("text", "lang")
    counts = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1).where(F.col("rank") < PROFILE)
    found = best.select("lang", "gram", "rank").collect()  # PROFILE rows a language
    langs = sorted({r["lang"] for r in found})
    grams = np.array(sorted({r["gram"] for r in found}), np.uint64)
    ranks = np.full((len(grams), len(langs)), PROFILE, np.int64)
    for r in found:
        ranks[np.searchsorted(grams, np.uint64(r["gram"])), langs.index(r["lang"])] = r["rank"]
    return langs, grams, ranks


class Judge:
    """Languages and scores of many texts, by learned profiles."""

    def __init__(self, langs: list[str], known: np.ndarray, ranks: np.ndarray) -> None:
        self.langs, self.known, self.ranks, self.grams = langs, known, ranks, Grams()

    def __call__(self, texts: list[str]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for _, some in runs(texts):
            of, gram, rank = self.grams.top(some)
            if not len(of) or not self.langs:
                names += [UNDETERMINED] * len(some)
                scores += [0.0] * len(some)
                continue
            at = np.minimum(np.searchsorted(self.known, gram), len(self.known) - 1)
            own = np.where((self.known[at] == gram)[:, None], self.ranks[at], PROFILE)
            away = np.where(own < PROFILE, np.abs(own - rank[:, None]), PROFILE)
            n = np.bincount(of, minlength=len(some))
            far = np.stack([np.bincount(of, away[:, k], len(some)) for k in range(len(self.langs))], 1)
            best = far.argmin(1)
            score = 1 - far[np.arange(len(some)), best] / np.maximum(n * PROFILE, 1)
            names += [self.langs[b] if m else UNDETERMINED for b, m in zip(best.tolist(), n.tolist())]
            scores += np.where(n > 0, score, 0.0).tolist()
        return names, scores


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score (1 - distance / largest distance)."""
    model = model or learned(docs)

    def judge(batches):
        of = Judge(*model)
        for batch in slices(batches):
            names, scores = of([t or "" for t in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), "text").mapInArrow(judge, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def identified(docs: DataFrame) -> DataFrame:
    """The documents whose language can be told, whole, with all columns of docs; those that are `und` go."""
    model = learned(docs)

    def keep(batches):
        of = Judge(*model)
        for batch in slices(batches):
            names, _ = of([t or "" for t in batch.column("text").to_pylist()])
            yield batch.filter(pa.array([name != UNDETERMINED for name in names], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
