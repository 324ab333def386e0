"""License scans: base phrases by consecutive words, and short notices with a bounded number of edits.

A notice of n characters may have n // ERROR_EVERY edits, k. Cut into k + 1 pieces, one of them must stand unchanged, so
all pieces of all notices are sought at once (Aho-Corasick); around each find the regex library's bounded-error matching
looks for the best match and reports its span and edits. Both work on the words, lower-cased (A-Z) and joined by blanks.

Nulls, ties and odd rows: null and empty texts have no words, places or labels, null first and last words and score 0;
overlapping matches of a notice count once, the one with the fewest edits first; repeated rows are judged alike; texts
are read whole; other columns than doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: Phrases and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Short notices, as words, and their labels.
NOTICES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("this work is licensed under the gnu general public license", "gpl"),
    ("this program is free software you can redistribute it and or modify", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("licensed under a creative commons attribution", "cc-by"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("mozilla public license version 2 0", "mpl"),
    ("eclipse public license version 2 0", "epl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("boost software license version 1 0", "bsl"),
)
ERROR_EVERY = 12


class Scanner:
    def __init__(self, notices=NOTICES, error_every: int = ERROR_EVERY) -> None:
        import ahocorasick
        import regex

        self.words = common.Words()
        self.base = []
        for phrase, label in BASE:
            h, _ = self.words.hashes([phrase.encode()])
            self.base.append((h, label))
        self.seeds = ahocorasick.Automaton()
        self.notices = []
        pieces: dict[str, list[tuple[int, int]]] = {}
        for i, (text, label) in enumerate(notices):
            k = len(text) // error_every
            # One pattern for each number of edits: the first that matches tells the fewest.
            self.notices.append((text, label, k, [regex.compile(f"(?:{regex.escape(text, literal_spaces=True)}){{e<={e}}}") for e in range(k + 1)]))
            cuts = [len(text) * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces.setdefault(text[a:b], []).append((i, a))
        for piece, of in pieces.items():
            self.seeds.add_word(piece, (len(piece), of))
        self.seeds.make_automaton()

    def fuzzy(self, text: str) -> list[tuple[str, int, int, int]]:
        """(label, first character, end, edits) of every notice found in text, which is words joined by blanks."""
        spots: dict[int, list[tuple[int, int]]] = {}
        for end, (length, of) in self.seeds.iter(text):
            for i, offset in of:
                begin = end + 1 - length - offset
                n, k = len(self.notices[i][0]), self.notices[i][2]
                spots.setdefault(i, []).append((max(0, begin - k), begin + n + k))
        out = []
        for i, windows in spots.items():
            notice, label, k, patterns = self.notices[i]
            windows.sort()
            joined = [windows[0]]
            for a, b in windows[1:]:
                if a <= joined[-1][1]:
                    joined[-1] = (joined[-1][0], max(b, joined[-1][1]))
                else:
                    joined.append((a, b))
            free = [(a, min(b, len(text))) for a, b in joined]
            # Every number of edits passes once over what fewer have left, so the time grows with the text, not with its square.
            for pattern in patterns:
                rest = []
                for a, b in free:
                    for m in pattern.finditer(text, a, b):
                        out.append((label, m.start(), m.end(), sum(m.fuzzy_counts)))
                        rest.append((a, m.start()))
                        a = m.end()
                    rest.append((a, b))
                free = [(a, b) for a, b in rest if b - a >= len(notice) - k]
        return sorted(out, key=lambda x: (x[1], x[3], x[0]))

    def scan(self, texts: list[bytes]) -> list[tuple]:
        """Of each text: words, base places, first and last base word, base labels, all labels, score, spans (label, first word, last word, edits)."""
        h, first = self.words.hashes(texts)
        n = np.diff(first)
        places: dict[int, list[tuple[int, str]]] = {}
        for phrase, label in self.base:
            m = len(phrase)
            at = np.flatnonzero(h[: max(0, len(h) - m + 1)] == phrase[0])
            for j in range(1, m):
                at = at[h[at + j] == phrase[j]]
            of = np.searchsorted(first, at, "right") - 1
            for t, w in zip(of.tolist(), at.tolist()):
                if w + m <= first[t + 1]:
                    places.setdefault(t, []).append((w - int(first[t]), label))
        block, _, _, _ = self.words.split(texts)
        word = common.WORD[block]
        keep = word.copy()
        keep[1:] |= word[:-1]
        ends = np.cumsum([len(t) + 1 for t in texts])
        keep[ends - 1] = True
        block = np.where(word, block, np.uint8(32))
        block[ends - 1] = 10
        plain = block[keep].tobytes().decode("utf-8", "replace").split("\n")
        out = []
        for t, text in enumerate(plain[: len(texts)]):
            own = places.get(t, [])
            spans, at, seen = [], 0, -int(text.startswith(" "))
            for label, a, b, edits in self.fuzzy(text):
                body = text[a:b]
                a, b = a + len(body) - len(body.lstrip()), b - (len(body) - len(body.rstrip()))
                seen += text.count(" ", at, a) - text.count(" ", a, at)  # finds are in order, so each counts on from the last
                at = a
                spans.append((label, max(0, seen), max(0, seen) + text.count(" ", a, b), edits, 1 - edits / max(1, b - a)))
            starts = [w for w, _ in own]
            base = sorted({x for _, x in own})
            labels = sorted({*base, *(s[0] for s in spans)})
            score = 1.0 if own else max([0.0, *(min(1.0, max(0.0, s[4])) for s in spans)])
            out.append((int(n[t]), len(own), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(labels), score, [{"label": s[0], "first_word": s[1], "last_word": s[2], "edits": s[3]} for s in spans]))
        return out


COLUMNS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
SPAN = "array<struct<label: string, first_word: bigint, last_word: bigint, edits: bigint>>"


def scan(docs: DataFrame, notices=NOTICES, error_every: int = ERROR_EVERY) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""

    def run(batches):
        scanner = Scanner(notices, error_every)
        spans = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int64())]))
        kinds = (pa.int64(),) * 4 + (pa.string(),) * 2 + (pa.float64(), spans)
        for batch in common.slices(batches):
            rows = [r for _, texts in common.blocks(common.texts_of(batch.column(1))) for r in scanner.scan(texts)]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 8, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *COLUMNS])

    kind = docs.schema["doc_id"].dataType.simpleString()
    kinds = ("bigint",) * 4 + ("string",) * 2 + ("double", SPAN)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} {k}" for c, k in zip(COLUMNS, kinds)))
