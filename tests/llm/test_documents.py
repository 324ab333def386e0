"""Operators on documents: brute force, exact round trips, and tables with everything odd in them."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lattica.llm import common, decontaminate, language_id, licenses, line_dedup, near_dup, queries, sentencepiece_bpe

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def rand_words(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, copies, repeated rows, and extra columns with clashing names."""
    rng = random.Random(4)
    base = rand_words(rng, 60)
    near = base[:30] + ["changed"] + base[31:]
    lines = [" ".join(rand_words(rng, 20)) for _ in range(3)]
    texts = [None, "", " ", "...", "word", "two words", "word", " ".join(base), " ".join(base), " ".join(near), "\n".join(lines), "\n".join(lines[:2] + ["own line of this text here"]), "É\x00ü 漢字 😀", " ".join(rand_words(rng, 30000)), "x" * 100000, "a b\n\n\na b\n", "MIT License", "tab\tand  spaces "]
    rows = [(i, t, ("en", "de", None)[i % 3], None if i % 5 == 0 else "s", None if t is None else len(t), "x", i, float(i)) for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], (None, "no id at all", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    extra = ", line string, words long, id double"
    df = spark.createDataFrame(rows, SCHEMA + extra)
    return df.selectExpr("*", "1 as bucket", "2 as comp", "3 as text_hash", "4 as gone", "5 as rest", "6 as pos", "7 as key", "8 as a", "9 as b", "10 as contaminated")


@pytest.fixture(scope="module")
def small(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


# SentencePiece.


def test_sentencepiece_equals_the_library(small):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=queries.sentencepiece_model())
    codec = sentencepiece_bpe.Codec(sentencepiece_bpe.Vocabulary(queries.sentencepiece_model()))
    rng = random.Random(1)
    alphabet = list("aabbcdeetthhiinng    \n\t▁.,éß漢字😀​\x00\x01<>/s0x")
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["a" * 3000, "ab" * 2000, " " * 500, "aaaaaaab" * 800, "banana" * 500, "▁▁a▁", "<s></s><unk><0x0A>"]
    texts += [r["text"] for r in small.collect()]
    for text, ids, (n, joined, decoded) in zip(texts, model.encode(texts), codec.both(texts)):
        assert (n, joined, decoded) == (len(ids), ",".join(map(str, ids)), model.decode(ids)), text[:80]
    some = model.encode(texts[:50])
    assert [codec.decode(ids) for ids in some] == [model.decode(ids) for ids in some]


def test_sentencepiece_remembers_ids_alone(monkeypatch):
    """A word's decoded text is remembered only where it is not the word; what is remembered stays small, and results don't depend on it."""
    texts = ["plain words of a text", "  two  blanks ", "\u2581odd \u2581\u2581ones", "", "tab\tand \x00 control", "a" * 50, "words words"]
    codec = sentencepiece_bpe.Codec(sentencepiece_bpe.Vocabulary(queries.sentencepiece_model()))
    want = codec.both(texts)
    assert all(isinstance(v, str) for v in codec.known.values()) and "plain" in codec.known and "plain" not in codec.odd
    assert [n for n, ids, _ in want] == [len(codec.encode([t])[0]) for t in texts] and want[3] == (0, "", "")
    assert [text for _, _, text in want] == [codec.decode(codec.encode([t])[0]) for t in texts]
    monkeypatch.setattr(sentencepiece_bpe, "REMEMBERED", 1)
    assert [x for t in texts for x in codec.both([t])] == want


def test_sentencepiece_query(spark, sf, odd):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=queries.sentencepiece_model())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for rows, got in ((odd, sentencepiece_bpe.encode_decode(odd, queries.sentencepiece_model())), (common.table(spark, sf, "documents"), queries.op2_sentencepiece(spark, sf))):
        want = Counter()
        for r in rows.select("doc_id", "text").collect():
            ids = model.encode(r["text"] or "")
            want[r["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids))] += 1
        assert Counter(map(tuple, got.collect())) == want
    assert sentencepiece_bpe.encode_decode(odd.limit(0), queries.sentencepiece_model()).count() == 0


# MinHash near-dedup.


def shingle_weights(texts):
    sets = [Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := words(t)) else Counter() for t in texts]
    n, df = sum(map(bool, sets)), Counter(s for c in sets for s in c)
    return [{s: (1 + math.log(k)) * (1 + math.log((1 + n) / (1 + df[s])) / math.log(1 + n)) for s, k in c.items()} for c in sets]


def brute_classes(ids, texts):
    w = shingle_weights(texts)
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if w[i] and w[j]:
                low = sum(min(v, w[j].get(s, 0)) for s, v in w[i].items())
                if low / (sum(w[i].values()) + sum(w[j].values()) - low) >= 0.8 - 1e-9:
                    root[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        least[find(i)] = min(least.get(find(i), x), x)
    return {x: least[find(i)] for i, x in enumerate(ids)}


def test_near_dup_against_brute_force(spark, small):
    rng, rows = random.Random(2), [(r["doc_id"], r["text"]) for r in small.collect()]
    for family in range(12):
        base = rand_words(rng, rng.choice((8, 40, 200, 400)))
        for _ in range(8):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 60))):
                own[rng.randrange(len(own))] = "edit"
            rows.append((10_000 + len(rows), " ".join(own)))
    got = {r["doc_id"]: r["class_id"] for r in near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(*zip(*rows))


def test_near_dup_of_a_large_group_in_blocks(spark, monkeypatch):
    """Variants of one text that hardly reach the threshold with each other: no link between components may be missed."""
    monkeypatch.setattr(near_dup, "BLOCK_DOCS", 16)
    rng = random.Random(3)
    base, rows = rand_words(rng, 120), []
    for i in range(150):
        own = list(base)
        for _ in range(2):
            own[rng.randrange(len(own))] = f"edit{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    got = {r["doc_id"]: r["class_id"] for r in near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == brute_classes(*zip(*rows))


def test_weighted_similarity_matrix_is_exact():
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 60))) for _ in range(30)]
    got = near_dup.similarities(common.Words(), [t.encode() for t in texts], near_dup.Weigher(0))
    sets = [Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := words(t)) else Counter() for t in texts]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            low = sum(1 + math.log(min(a[s], b[s])) for s in a.keys() & b.keys())
            total = sum(1 + math.log(v) for c in (a, b) for v in c.values()) - low
            assert got[i, j] == pytest.approx(low / total if total else 0.0)


def test_near_dup_on_odd_rows(odd):
    got = {r["doc_id"]: r["class_id"] for r in near_dup.classes(odd).collect()}
    assert sorted(got) == list(range(18))
    assert got[4] == got[6] == 4 and got[7] == got[8] == got[9] == 7 and got[0] == got[1] == 0 and got[2] == 2 and got[3] == 3
    kept = near_dup.dedup(odd)
    assert kept.columns == odd.columns and kept.where("doc_id is null").count() == 2
    assert sorted(r[0] for r in kept.where("doc_id is not null").select("doc_id").collect()) == sorted(k for k, v in got.items() if k == v)
    assert near_dup.classes(odd.limit(0)).count() == 0 and near_dup.dedup(odd.limit(0)).count() == 0


# Language ID.


def test_language_id_by_the_book(small):
    rows = small.collect()
    grams = {}
    for r in rows:
        if r["lang"] and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1:
            grams.setdefault(r["lang"], Counter()).update(brute_grams(r["text"]))
    top = lambda c: [g for g, _ in sorted(c.items(), key=lambda x: (-min(x[1], (1 << 22) - 1), gram_code(x[0])))[: language_id.PROFILE]]
    profiles = {lang: {g: i for i, g in enumerate(top(c))} for lang, c in grams.items()}
    got = {r["doc_id"]: r for r in language_id.predict(small).collect()}
    right = held = 0
    for r in rows:
        own = top(brute_grams(r["text"]))
        far = {lang: sum(abs(p[g] - i) if g in p else language_id.PROFILE for i, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        g = got[r["doc_id"]]
        assert (g["lang_pred"], g["held_out"]) == (best, zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert g["score"] == pytest.approx(1 - far[best] / (len(own) * language_id.PROFILE))
        held += g["held_out"]
        right += g["held_out"] and best == r["lang"]
    assert right / held > 0.95


def brute_grams(text):
    out = Counter()
    for w in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split():
        p = f" {w} "
        out.update(w)
        out.update(p[i : i + 2] for i in range(len(p) - 1))
        out.update(p[i : i + 3] for i in range(len(p) - 2))
    return out


def gram_code(g):
    v = 0
    for c in g:
        v = v << 21 | ord(c)
    return int(common.mix(np.array([v + len(g) - 1], np.uint64))[0] >> np.uint64(32))


def test_letters_beyond_the_first_planes_and_very_many_of_one():
    grams = language_id.Grams()
    assert grams.letter[0x30000] and not grams.letter[ord("1")]
    text = "ab " * (1 << 22) + "c " * 3
    _, gram, rank = grams.top([text])
    by = dict(zip(gram.tolist(), rank.tolist()))
    assert len(by) == len(set(brute_grams("ab c"))) and by[gram_code("c")] > by[gram_code("a")]


def test_language_id_on_odd_rows(spark, odd):
    got = language_id.predict(odd).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (0, 1, 2, 3))
    assert all(0 <= r["score"] <= 1 for r in got) and not any(r["held_out"] for r in got if r["doc_id"] is None)
    kept = language_id.identified(odd)
    assert kept.columns == odd.columns and kept.where("doc_id in (0, 1, 2, 3)").count() == 0 and kept.where("doc_id > 3").count() == 16
    nothing = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in language_id.predict(nothing).select("lang_pred", "score").collect()] == [("und", 0.0)]
    assert language_id.predict(odd.limit(0)).count() == 0


# License scans.


def test_licenses_base_places_against_brute_force(small, odd):
    for df in (small, odd):
        got = Counter(tuple(r)[:6] for r in licenses.scan(df).collect())
        want = Counter()
        for r in df.select("doc_id", "text").collect():
            w = words(r["text"])
            places = [(i, label) for phrase, label in licenses.BASE for p in [phrase.split()] for i in range(len(w)) if w[i : i + len(p)] == p]
            at = [i for i, _ in places]
            want[r["doc_id"], len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))] += 1
        assert got == want
    assert licenses.scan(odd.limit(0)).count() == 0


def fewest_edits(notice, text):
    """Least edits between a notice and any part of text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(notice, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_licenses_within_edits():
    scan = licenses.Scanner().scan
    rng = random.Random(6)
    for text, label in licenses.NOTICES:
        k = len(text) // licenses.ERROR_EVERY
        for edits in range(k + 2):
            own = list(text)
            for i in rng.sample(range(len(own)), edits):
                own[i] = rng.choice("#x")  # a break between words, or another letter
            body = f"Some words before. {''.join(own)} and after"
            row = scan([body.encode()])[0]
            fewest = fewest_edits(text, " ".join(words(body)))
            spans = [s for s in row[7] if s["label"] == label]
            if fewest <= k:
                assert label in row[5].split(",") and min(s["edits"] for s in spans) == fewest, (text, edits, row)
                assert 0 < row[6] <= 1
    assert scan([b"nothing of that kind stands here"])[0][4:7] == ("", "", 0.0)


def test_many_edited_notices_in_one_text():
    """Every notice is found with its place, in a time that grows with the text and not with its square (that would be minutes)."""
    one, n = "this program is free softwore you can redistrbute it and or modify", 30_000
    spans = licenses.Scanner().scan([((one + " ") * n).encode()])[0][7]
    own = [s for s in spans if s["label"] == "gpl"]
    assert [(s["first_word"], s["edits"]) for s in own] == [(12 * i, 2) for i in range(n)]


# Line dedup.


def line_words(line):
    return [w for w in WORD.findall(line.strip(line_dedup.SEPARATORS).lower()) if w]


def brute_lines(rows):
    """kept id of every line with words, rows being (doc_id, text hash, text): all pairs' edit similarity over words."""
    norm, first = {}, {}
    for doc, h, text in rows:
        for i, line in enumerate(text.split("\n")):
            if w := line.strip(line_dedup.SEPARATORS).lower():
                norm[doc, h, i] = w
                first[w] = min(first.get(w, (doc, h, i)), (doc, h, i))
    distinct = sorted(first)
    split = [tuple(line_words(w)) for w in distinct]
    bags = [Counter(w) for w in split]
    root = list(range(len(distinct)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(distinct)):
        for j in range(i):
            longest = max(len(split[i]), len(split[j]))
            allowed = math.floor(longest * (1 - line_dedup.SIMILARITY) + 1e-9)
            # So many words at least are in both, whatever their order.
            if min(len(split[i]), len(split[j])) >= longest - allowed and find(i) != find(j) and (bags[i] & bags[j]).total() >= longest - allowed and edits(split[i], split[j]) <= allowed:
                root[find(i)] = find(j)
    least = {}
    for i, w in enumerate(distinct):
        least[find(i)] = min(least.get(find(i), first[w]), first[w])
    group = {w: least[find(i)] for i, w in enumerate(distinct)}
    return {k: group[w] for k, w in norm.items()}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_lines_against_brute_force(spark, small, monkeypatch):
    """By all runs: the same groups. By blocks: no group holds what similarity alone does not link, and 0.9 or more of the repeats are found."""
    from pyspark.sql import functions as F

    rng = random.Random(7)
    rows = [(r["doc_id"], r["text"]) for r in small.limit(60).collect()]
    for i in range(40):
        base = rand_words(rng, rng.choice((3, 12, 30, 200)))
        for j in range(3):
            own = list(base)
            own[rng.randrange(len(own))] = "edited"
            rows.append((1000 + 10 * i + j, "\n".join([" ".join(own), "Shared, short line!", f"short {i}"])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_lines([tuple(r) for r in df.select("doc_id", F.xxhash64("text"), "text").collect()])
    assert {tuple(r["id"]): tuple(r["kept"]) for r in line_dedup.groups(df, exact=True).collect()} == want
    got = {tuple(r["id"]): tuple(r["kept"]) for r in line_dedup.groups(df).collect()}
    assert got.keys() == want.keys() and all(want[k] == want[v] for k, v in got.items())
    repeats = [k for k in want if want[k] != k]
    assert sum(got[k] == want[k] for k in repeats) >= 0.9 * len(repeats)


def test_share_of_alike_lines_found(spark):
    """Pairs of lines of n words with one word replaced, and with as many as the similarity allows."""
    rng, rows, pairs = random.Random(12), [], []
    for n in (10, 20, 50, 100):
        for k in (1, n // 5):
            for _ in range(100):
                base = rand_words(rng, n)
                own = list(base)
                for at in rng.sample(range(n), k):
                    own[at] = rand_words(rng, 1)[0]
                pairs.append(((n, k), len(rows)))
                rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(own))]
    got = {r["id"]["doc_id"]: r["kept"]["doc_id"] for r in line_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = Counter(of for of, i in pairs if got[i + 1] == i)
    assert all(found[n, k] >= (95 if k == 1 else 85) for n, k in dict(pairs)), found


def test_lines_of_a_very_common_phrase(spark, monkeypatch):
    """Of lines that share one phrase and little else, those that are alike are found; others stay."""
    monkeypatch.setattr(line_dedup, "FEW_LINES", 8)
    rng, rows = random.Random(13), []
    for i in range(150):
        base = rand_words(rng, 14)
        base[4:7] = ["extraordinarily", "commonplace", "expression"]
        own = list(base)
        own[rng.randrange(8, 14)] = "edited"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(own))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["id"]["doc_id"]: r["kept"]["doc_id"] for r in line_dedup.groups(df).collect()}
    assert got == {i: i - i % 2 for i in range(300)}


def test_lines_by_edit_similarity_alone(spark):
    """Lines of 1 to 130 words with up to a fifth and a bit of the words edited, against all pairs' edit similarity."""
    rng = random.Random(11)
    common_words, texts = rand_words(rng, 30), []
    for n in [*range(1, 27), 31, 35, 36, 40, 64, 99, 130]:
        base = [rng.choice(common_words) if rng.random() < 0.4 else w for w in rand_words(rng, n)]
        short = [w[:4] for w in rand_words(rng, n)]  # no word of five characters
        for source in (base, short):
            texts.append(" ".join(source))
            for edits_ in sorted({1, n // 10, n // 5, n // 5 + 1} - {0}):
                own = list(source)
                for at in (range(0, 5 * edits_, 5) if rng.random() < 0.5 and 5 * edits_ <= n else rng.sample(range(n), edits_)):
                    own[at] = rng.choice(("", "x" + own[at], own[at] + " new"))
                texts.append(" ".join(own))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    split = [tuple(line_words(t)) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    linked = set()
    for i, x in enumerate(split):
        for j, y in enumerate(split[:i]):
            allowed = math.floor(max(len(x), len(y)) * 0.2 + 1e-9)
            if x and y and abs(len(x) - len(y)) <= allowed and edits(x, y) <= allowed:
                linked.add(round(1 - edits(x, y) / max(len(x), len(y)), 1))
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert {0.8, 0.9} <= linked
    got = {r["id"]["doc_id"]: r["kept"]["doc_id"] for r in line_dedup.groups(df, exact=True).collect()}
    assert got == {i: find(i) for i, x in enumerate(split) if x}


def test_line_dedup_compares_all_lines_of_a_large_block(spark, monkeypatch):
    """Two lines that could be alike, share one block with many others and nothing else, and are unlike the first of it."""
    monkeypatch.setattr(line_dedup, "PART", 7)
    own = random.Random(4)
    traits = [(own.getrandbits(63), own.getrandbits(63)) for _ in range(60)]
    traits[41] = traits[40]
    members = spark.createDataFrame([(7, i, i, 10, *t) for i, t in enumerate(traits)], "bucket long, id long, comp long, m int, p0 long, p1 long")
    none = members.select("id", "comp").limit(0)
    assert line_dedup.meeting(members).count() == 0
    assert [tuple(r) for r in line_dedup.rest(members, none).collect()] == [(40, 41)]
    joined = spark.createDataFrame([(i, 0) for i in range(60)], "id long, comp long")
    assert line_dedup.rest(members, joined).count() == 0


def test_alike_lines_share_a_rare_run(spark, monkeypatch):
    """Lines with a passage of half of their words in common: every two within a fifth of edits meet by one and by two words, most others do not."""
    from pyspark.sql import functions as F

    rng, rows = random.Random(21), []
    vocabulary, passage = rand_words(rng, 400), rand_words(rng, 20)
    for _ in range(60):
        base = [*rng.choices(vocabulary, k=rng.randrange(10, 30)), *passage]
        for _ in range(rng.randrange(1, 4)):
            own = list(base)
            for _ in range(rng.randrange(len(base) // 5 + 1)):
                at = rng.randrange(len(own))
                own[at : at + rng.randrange(2)] = rng.choice(([], [rng.choice(vocabulary)]))
            rows.append((len(rows), own))
    lines = spark.createDataFrame([(i, i, len(w), 0, 0, [vocabulary.index(x) if x in vocabulary else 400 + passage.index(x) for x in w]) for i, w in rows], "id long, comp long, m int, p0 long, p1 long, codes array<int>")
    want = {(i, j) for i, x in rows for j, y in rows[i + 1 :] if edits(x, y) <= math.floor(max(len(x), len(y)) * 0.2 + 1e-9)}
    assert len(want) > 30
    for q in line_dedup.RARE:
        of = {}
        for r in line_dedup.finer(lines, q).select("bucket", "id").collect():
            of.setdefault(r["bucket"], set()).add(r["id"])
        met = {(i, j) for x in of.values() for i in x for j in x if i < j}
        assert want <= met and (q == 1 or len(met) < len(rows) ** 2 / 8)


def test_large_blocks_are_cut_by_length(spark, monkeypatch):
    """Lines of 1 to 400 words in one block: every two whose lengths allow similarity stay together, others part, and no runs are cut of them."""
    rows = [(7, m, m, m, 0, 0) for m in range(1, 401)]
    cut = line_dedup.by_length(spark.createDataFrame(rows, "bucket long, id long, comp long, m int, p0 long, p1 long"))
    of = {}
    for r in cut.select("bucket", "id").collect():
        of.setdefault(r["bucket"], set()).add(r["id"])
    met = {(i, j) for x in of.values() for i in x for j in x if i < j}
    want = {(m, n) for m in range(1, 401) for n in range(m + 1, 401) if n - m <= math.floor(n * 0.2 + 1e-9)}
    assert want <= met and len(met) < 3 * len(want) and cut.count() == 800
    # Ten lines of each of five lengths share a block; two of them are alike.
    monkeypatch.setattr(line_dedup, "MOST_OTHERS", 16)
    monkeypatch.setattr(line_dedup, "finer", lambda *a: pytest.fail("runs are cut"))
    own = random.Random(24)
    lines = [(i, m, own.getrandbits(63), own.getrandbits(63), own.choices(range(1 << 20), k=m)) for i, m in enumerate(sorted([10, 20, 40, 80, 160] * 10))]
    lines[37] = (37, *lines[36][1:])
    known = spark.createDataFrame([(i, w, "".join(chr(0x10000 + x) for x in w)) for i, *_, w in lines], "id long, codes array<int>, symbols string")
    large = spark.createDataFrame([(7, i, i, m, p, q) for i, m, p, q, _ in lines], "bucket long, id long, comp long, m int, p0 long, p1 long")
    assert [tuple(r) for r in line_dedup.linked_again(large, large.select("id", "comp").limit(0), known).collect()] == [(36, 37)]


def test_codes_are_symbols(spark):
    """A symbol for each word, the same where words are, and distances of symbols are those of words."""
    row = spark.createDataFrame([("One two, three TWO",), ("one two four two",)], "s string").select(line_dedup.as_symbols(line_dedup.codes("s")).alias("x")).collect()
    x, y = (r["x"] for r in row)
    assert len(x) == len(y) == 4 and x[1] == x[3] == y[1] and x[0] == y[0] and x[2] != y[2] and all(ord(c) >= 0x10000 for c in x + y)


def test_lines_of_a_very_common_passage_are_not_compared_in_pairs(spark, monkeypatch):
    """The comparisons grow with the lines that share a passage, not with their square, and the alike ones among them are found."""
    monkeypatch.setattr(line_dedup, "FEW_LINES", 8)
    monkeypatch.setattr(line_dedup, "MOST_OTHERS", 8)
    in_parts = line_dedup.in_parts
    monkeypatch.setattr(line_dedup, "in_parts", lambda each: in_parts(each) if each.where("others > 8").isEmpty() else pytest.fail("all pairs of a bucket are compared"))
    rng, rows = random.Random(22), []
    passage = rand_words(rng, 12)
    for i in range(200):
        base = rand_words(rng, 24)
        base[6:18] = passage
        own = list(base)
        own[rng.choice((1, 3, 20, 22))] = "edited"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(own))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["id"]["doc_id"]: r["kept"]["doc_id"] for r in line_dedup.groups(df).collect()}
    assert got == {i: i - i % 2 for i in range(400)}


def test_line_dedup_leaves_two_tables_and_shuffles_no_text(spark, monkeypatch):
    """What is stored on the way is deleted again, and lines are read again by a broadcast of their ids; by their documents the groups are the same."""
    from pathlib import Path

    from lattica.plans import storage

    rng = random.Random(23)
    base = [rand_words(rng, 20) for _ in range(30)]
    rows = [(2 * i + k, " ".join(w[:10] + (["edited"] if k else []) + w[10:]) + "\nshared by all of them") for i, w in enumerate(base) for k in (0, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    folder, by_documents, calls = Path(storage.shared_dir(spark).removeprefix("file://")), line_dedup.with_words, []
    monkeypatch.setattr(line_dedup, "with_words", lambda *a: calls.append(1) or by_documents(*a))
    got = []
    for most in (line_dedup.BROADCAST_LINES, 0):
        monkeypatch.setattr(line_dedup, "BROADCAST_LINES", most)
        before = set(folder.iterdir())
        found = line_dedup.groups(df)
        got.append({(r["id"]["doc_id"], r["id"]["line"]): r["kept"]["doc_id"] for r in found.collect()})
        assert {p.name.split("-")[1] for p in set(folder.iterdir()) - before} <= {"lines", "kept", "counted"}
        assert len(calls) == (most == 0)
    assert got[0] == got[1] == {(i, k): 0 if k else i - i % 2 for i in range(60) for k in (0, 1)}


def test_ended_plans_are_collected_as_tables_are_stored(spark, monkeypatch):
    """Within scratch every few tables, so that the driver does not keep what ended; elsewhere only when asked."""
    from lattica.plans import storage

    calls = []
    monkeypatch.setattr(storage, "forget", lambda _: calls.append(1))
    with storage.scratch():
        for _ in range(2 * storage.FORGET):
            storage.stored(spark.range(1))
    assert len(calls) == 2
    storage.stored(spark.range(1))
    assert len(calls) == 2


def test_line_dedup_on_odd_rows(odd):
    got = {r["doc_id"]: r for r in line_dedup.report(odd).collect() if r["doc_id"] is not None}
    assert line_dedup.report(odd).count() == odd.count()
    assert got[0]["n_lines"] == 0 and got[1]["n_lines"] == 1 and got[11]["n_dropped"] == 2 and got[15]["n_dropped"] == 1 and got[15]["n_lines"] == 5
    out = line_dedup.dedup(odd)
    assert out.columns == odd.columns and out.dtypes == odd.dtypes
    by = {r["doc_id"]: r for r in out.collect() if r["doc_id"] is not None}
    assert 6 not in by and 8 not in by  # all they said is kept in 4 and 7
    assert by[11]["text"] == "own line of this text here" and by[11]["n_chars"] == 26
    assert by[15]["text"] == "a b\n\n\n" and by[0]["text"] is None and by[1]["text"] == "" and by[3]["text"] == "..."
    assert out.where("doc_id is null").count() == 2
    assert line_dedup.dedup(odd.limit(0)).count() == 0


# Benchmark decontamination.


def brute_hits(text, items):
    w, hit, found = words(text), set(), set()
    for item, own in items:
        v = words(own)
        n = min(13, len(v))
        for k in range(len(v) - n + 1 if n else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == v[k : k + n]:
                    hit.update(range(i, i + n))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)


def test_decontamination_against_brute_force(spark, sf, odd, monkeypatch):
    rng = random.Random(8)
    long = rand_words(rng, 40)
    items = [(1, " ".join(long)), (2, "one"), (3, "Two words"), (4, None), (5, ""), (6, "...?"), (7, " ".join(long[10:30]).upper()), (7, "éa ÉB " + " ".join(long[:14])), (None, "three small words"), (3, "Two words"), (11, "a a a"), (8, " ".join(long[3:15]))]
    docs = [(i, t) for i, t in enumerate([None, "", " ".join(long[5:20]), " ".join(long[:12]), "x one y two, WORDS", " ".join(long * 2), "a a a a a", " ".join(long[3:15]) + " more", "three small words", "éa Éb " + " ".join(long[:14])])]
    docs += [docs[2], docs[2], (None, "one")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    named = [(i, t) for i, t in items]
    want = {(i, *brute(t, named)) for i, t in docs}
    for limit in (100_000, 0):  # by broadcast and by shuffle
        monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", limit)
        got = [tuple(r)[:6] for r in decontaminate.contamination(d, b).collect()]
        assert set(got) == want and len(got) == len(want)
    got = decontaminate.contamination(d, b.limit(0)).collect()
    assert len(got) == len(want) and not any(r["n_hit"] for r in got)
    assert decontaminate.contamination(d.limit(0), b).count() == 0
    out = decontaminate.clean(odd, b)
    assert out.columns == odd.columns and out.where("doc_id is null").count() == 2


def brute(text, items):
    n, hit, k, sha, bad = brute_hits(text, items)
    named = sorted({str(i) for i, own in items if i is not None and brute_hits(text, [(i, own)])[1]})
    return n, hit, len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), bad
