"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

All distinct words of a block lie in flat symbol arrays. A round finds the smallest pair rank of every word (segmented
minimum), merges all its leftmost non-overlapping places at once, and compacts; it ends when no pair remains. A merge
whose result could be merged at a better rank ends its word's round there, so that the order of merges is the one of
the sequential algorithm. Models with the identity normalizer, a dummy prefix and byte fallback are supported, others
are refused.

Null texts are empty; empty texts have no ids and decode to empty text. Long texts and long words are taken whole: a
word is cut only where no piece of the vocabulary could join the two characters. Repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

SPACE = "▁"
NONE = np.int32(2**31 - 1)
#: Distinct words that a worker remembers; beyond, it forgets and encodes them again.
REMEMBERED = 200_000


class Vocabulary:
    """What the merge rounds need of a model file, as small arrays that tasks carry."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        special = [model.is_control(i) or model.is_unknown(i) for i in range(size)]
        byte = {int(self.pieces[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        if len(byte) != 256 or model.encode("x  x") != model.encode("x" + 2 * SPACE + "x") or any(SPACE in p.lstrip(SPACE) for i, p in enumerate(self.pieces) if not model.is_byte(i)):
            raise ValueError("this model lacks byte fallback, changes white space or joins words")
        self.byte_ids = np.array([byte[i] for i in range(256)], np.int32)
        normal = [i for i in range(size) if not (special[i] or model.is_byte(i) or model.is_unused(i))]
        symbols = {self.pieces[i]: i for i in normal}
        for i in normal:
            for c in self.pieces[i]:
                symbols.setdefault(c, size + len(symbols))
        order = {s: r for r, s in enumerate(sorted({-model.get_score(i) for i in normal}))}
        keys, ranks, merged, bigrams = [], [], [], set()
        for i in normal:
            p = self.pieces[i]
            bigrams.update(ord(a) << 21 | ord(b) for a, b in zip(p, p[1:]))
            for j in range(1, len(p)):
                if p[:j] in symbols and p[j:] in symbols:
                    keys.append(symbols[p[:j]] << 32 | symbols[p[j:]])
                    ranks.append(order[-model.get_score(i)])
                    merged.append(i)
        # Pairs in a table with open addressing, at most a quarter full.
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys, self.ranks, self.merged = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32), np.zeros(1 << self.bits, np.int32)
        for key, rank, into, at in zip(keys, ranks, merged, self.slots(np.array(keys, np.int64)).tolist()):
            while self.keys[at] >= 0:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.keys[at], self.ranks[at], self.merged[at] = key, rank, into
        self.bigrams = np.array(sorted(bigrams), np.int64)
        chars = [(ord(s), i) for s, i in symbols.items() if len(s) == 1]
        self.chars = np.array(chars, np.int64)
        self.size = size

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)


class Codec:
    """encode() and decode() of one vocabulary."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.char = np.full(0x110000, -1, np.int32)
        self.char[vocabulary.chars[:, 0]] = vocabulary.chars[:, 1]
        self.text = [p.replace(SPACE, " ").encode() for p in vocabulary.pieces]
        for b, i in enumerate(vocabulary.byte_ids):
            self.text[i] = bytes([b])
        self.name = [str(i) for i in range(vocabulary.size)]
        self.known: dict[str, str] = {}
        self.odd: dict[str, str] = {}

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of pairs; NONE where there is none. Symbols below 0 have no pair."""
        key = (left.astype(np.int64) << 32) | (right.astype(np.int64) & 0xFFFFFFFF)
        key[(left < 0) | (right < 0)] = -2
        at = self.v.slots(key)
        found = self.v.keys[at]
        lost = np.flatnonzero((found != key) & (found >= 0))
        while len(lost):
            at[lost] = (at[lost] + 1) & (len(self.v.keys) - 1)
            found[lost] = self.v.keys[at[lost]]
            lost = lost[(found[lost] != key[lost]) & (found[lost] >= 0)]
        return np.where(found == key, self.v.ranks[at], NONE), self.v.merged[at]

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of all words in order (below 0: character -1 - symbol, which no piece has), word of each, and index of its first character."""
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), lengths)
        n = len(code)
        sym = self.char[code]
        sym = np.where(sym < 0, -1 - code, sym).astype(np.int32)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        # A segment ends where the next character can't be joined: there, and between words, nothing is ever merged.
        big = (code[:-1] << 21) | code[1:]
        at = np.minimum(np.searchsorted(self.v.bigrams, big), len(self.v.bigrams) - 1)
        joined = np.zeros(n, bool)
        joined[:-1] = (self.v.bigrams[at] == big) & (word[1:] == word[:-1])
        seg = np.cumsum(~joined) - ~joined
        place = np.arange(n)
        rank, into = np.full(n, NONE, np.int32), np.zeros(n, np.int32)
        at = np.flatnonzero(joined)
        rank[at], into[at] = self.pair(sym[at], sym[at + 1])
        while len(sym):
            starts = np.flatnonzero(np.diff(seg, prepend=-1))
            least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(seg))))
            if (over := least == NONE).any():
                done.append((place[over], sym[over]))
                live = ~over
                sym, seg, place, rank, into, least = (x[live] for x in (sym, seg, place, rank, into, least))
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == least)
            run = np.diff(hit, prepend=-2) != 1
            first = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - first) % 2 == 0]
            new = into[hit]
            # Would a merge's result meet a better pair than the one being merged? Then the word's later places wait.
            left = np.where((hit > 0) & (seg[np.maximum(hit - 1, 0)] == seg[hit]), sym[np.maximum(hit - 1, 0)], -1)
            near = np.flatnonzero(np.diff(hit, prepend=-9) == 2)
            near = near[seg[hit[near]] == seg[hit[near] - 2]] if len(near) else near
            left[near] = new[near - 1]
            after = np.minimum(hit + 2, len(sym) - 1)
            right = np.where((hit + 2 < len(sym)) & (seg[after] == seg[hit]), sym[after], -1)
            better = (np.minimum(self.pair(left, new)[0], self.pair(new, right)[0])) < rank[hit]
            if better.any():
                at = np.flatnonzero(better)
                s, lead = np.unique(seg[hit[at]], return_index=True)
                stop = np.full(len(hit), len(sym))
                to = np.searchsorted(s, seg[hit])
                inside = (to < len(s)) & (s[np.minimum(to, len(s) - 1)] == seg[hit])
                stop[inside] = hit[at[lead]][to[inside]]
                stay = hit <= stop
                hit, new = hit[stay], new[stay]
            sym[hit] = new
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            index = np.cumsum(keep) - 1
            sym, seg, place, rank, into = (x[keep] for x in (sym, seg, place, rank, into))
            touched = np.zeros(len(sym) + 1, bool)
            touched[index[hit]] = touched[index[hit] - 1] = True  # -1 falls on the spare place
            touched[-1] = False
            changed = np.flatnonzero(touched[:-1])
            inner = changed < len(sym) - 1
            rank[changed] = NONE
            changed = changed[inner]
            changed = changed[seg[changed] == seg[changed + 1]]
            rank[changed], into[changed] = self.pair(sym[changed], sym[changed + 1])
        if done:
            place, sym = (np.concatenate(x) for x in zip(*done))
            order = np.argsort(place)
            place, sym = place[order], sym[order]
        return sym, word[place], place

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in order, and the word of each; characters outside the vocabulary become bytes."""
        sym, word, _ = self.merge(words)
        odd = np.flatnonzero((sym < 0) | (sym >= self.v.size))
        if len(odd):
            lost = {int(i): c for c, i in self.v.chars if i >= self.v.size}
            raw = [chr(-1 - s if s < 0 else lost[s]).encode("utf-8", "surrogatepass") for s in sym[odd].tolist()]
            times = np.ones(len(sym), np.int64)
            times[odd] = [len(r) for r in raw]
            word, sym, where = np.repeat(word, times), np.repeat(sym, times), np.repeat(np.isin(np.arange(len(times)), odd), times)
            sym[where] = self.v.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        return sym, word

    def learn(self, words: set[str]) -> None:
        """Encodes and decodes words that are not known: ids as text of SPACE + word, and the decoded text where it is not the word behind a blank."""
        new = list(words)
        for i in range(0, len(new), 20_000):
            some = new[i : i + 20_000]
            ids, word = self.ids([SPACE + w for w in some])
            ends = np.cumsum(np.bincount(word, minlength=len(some))).tolist()
            ids, begin = ids.tolist(), 0
            for w, end in zip(some, ends):
                own = ids[begin:end]
                self.known[w] = ",".join([self.name[x] for x in own])
                if (text := b"".join([self.text[x] for x in own]).decode("utf-8", "replace")) != " " + w:
                    self.odd[w] = text
                begin = end

    @staticmethod
    def words(text: str) -> list[str]:
        """The words of a text, each without the one SPACE that it starts with."""
        if not text:
            return []
        if "  " in text or SPACE in text:
            return [w[1:] for w in re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text.replace(" ", SPACE))]
        if text[0] == " " or text[-1] == " ":
            return [w[1:] for w in re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text.replace(" ", SPACE))]
        return text.split(" ")

    def both(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Of each text: number of ids, ids joined by commas, decoded text."""
        split = [self.words(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
            self.odd.clear()
        new = set().union(*split).difference(self.known) if split else set()
        self.learn(new)
        known, odd, out = self.known, self.odd, []
        for words in split:
            ids = ",".join([known[w] for w in words])
            text = " ".join(words) if odd.keys().isdisjoint(words) else "".join([odd.get(w, " " + w) for w in words])[1:]
            out.append((ids.count(",") + 1 if words else 0, ids, text))
        return out

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        return [[int(x) for x in ids.split(",")] if ids else [] for _, ids, _ in self.both([t or "" for t in texts])]

    def decode(self, ids: list[int]) -> str:
        """Text of any ids; bytes that are not UTF-8 become U+FFFD, control ids nothing."""
        out = b"".join(self.text[i] for i in ids if i > 2 or i == 0)
        out = out.decode("utf-8", "replace")
        return out[1:] if out.startswith(" ") and ids and self.v.pieces[[i for i in ids if i not in (1, 2)][0]].startswith(SPACE) else out


def runs(texts: list[str], size: int = 1 << 21):
    """Runs of texts of about size characters."""
    some, total = [], 0
    for t in texts:
        if some and total + len(t) > size:
            yield some
            some, total = [], 0
        some.append(t)
        total += len(t)
    if some:
        yield some


def encode_decode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text, by the model file's vocabulary."""
    vocabulary = Vocabulary(model)

    def run(batches):
        codec = Codec(vocabulary)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows = []
            for some in runs(texts):
                for n, ids, text in codec.both(some):
                    rows.append((n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()))
            n, ids, text = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
