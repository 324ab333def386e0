"""Operators on pages, embeddings and conversations, and the pipeline."""

import base64
import hashlib
import io
import random
import re
import zipfile
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lattica.llm import ann, chat_quotes, common, queries, url_filter, wacz

from .test_documents import brute, brute_classes, brute_lines, rand_words, words

# URL filters.


def split_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host, path = rest[:cut], rest[cut:]
    cut = min([i for i in (path.find(c) for c in "?#") if i >= 0], default=len(path))
    return host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), path[:cut] if path.startswith("/") else ""


def rule_of(host, path):
    fits = [(len(t), k, t) for t, k in url_filter.RULES for d, _, rest in [t.partition("/")] if (host == d or host.endswith("." + d)) and path.startswith("/" + rest)]
    return max(fits)[1:] if fits else (None, None)


def test_url_rules_against_brute_force(spark, sf):
    odd = [None, "", "no scheme", "://", "http://", "http://com", "http://COM/en/x?a", "https://Example.com/en/7", "x://a.example.com/en/71#q", "http://notexample.net/de/8", "http://example.net/de/8", "http://b.example.net/de/9", "http://org/es", "http://org/es/", "http://É.org/es/Ü", "http://u:p@h.com:80/en/", "a://b://c.com/en/", "http://x.com?/en/", "http://x.com#/en/"]
    rows = [(i, u, "p", 1.0, "v") for i, u in enumerate(odd)] + [(None, "http://x.com/en/", None, None, None), (3, odd[3], "p", 1.0, "v")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, score double, grams string")
    for df in (pages, common.table(spark, sf, "pages")):
        got = url_filter.judge(df).collect()
        want = Counter((r["page_id"], *split_url(r["url"])) for r in df.collect())
        assert Counter((r["page_id"], r["host"], r["path"]) for r in got) == want
        for r in got:
            kind, text = rule_of(r["host"], r["path"])
            assert r["rule"] == text and r["verdict"] == (kind or ("block" if r["score"] >= 0.5 else "allow"))
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_url_classifier_on_held_out_rows(spark):
    table = url_filter.labelled(spark).orderBy("url").collect()
    rng = random.Random(1)
    rng.shuffle(table)
    cut = len(table) * 3 // 4
    train, test = (spark.createDataFrame(t, "url string, label double") for t in (table[:cut], table[cut:]))
    truth = {i: r["label"] for i, r in enumerate(table[cut:])}
    pages = spark.createDataFrame([(i, r["url"]) for i, r in enumerate(table[cut:])], "page_id long, url string")
    got = url_filter.judge(pages, (), train).collect()
    assert sum((r["verdict"] == "block") == (truth[r["page_id"]] == 1.0) for r in got) / test.count() > 0.95


def test_url_classifier_on_words_it_has_not_seen(spark):
    """Every fourth host word is held out with all its urls; the paths of its label are known."""
    table, words = url_filter.labelled(spark).collect(), sorted(url_filter.BLOCKED + url_filter.ALLOWED)
    random.Random(1).shuffle(words)
    out = words[::4]
    train, test = ([r for r in table if any(w in r["url"] for w in out) == held] for held in (False, True))
    pages = spark.createDataFrame([(i, r["url"]) for i, r in enumerate(test)], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] == "block" for r in url_filter.judge(pages, (), spark.createDataFrame(train, "url string, label double")).collect()}
    blocked, right = sum(got.values()), sum(got[i] and r["label"] == 1 for i, r in enumerate(test))
    assert right / blocked > 0.75 and right / sum(r["label"] == 1 for r in test) > 0.4


def test_url_grams_against_brute_force_and_of_a_long_path(spark):
    def brute(kind, text):
        return [kind + text[i : i + n] for n in url_filter.SIZES for i in range(max(1, len(text) - n + 1))]

    parts = [("", ""), ("a.b", "/"), ("é", "/𝔘x"), ("x.org", "/" + "abcdefghij" * 20_000)]
    rows = spark.createDataFrame(parts, "host string, path string")
    for r in rows.select("host", "path", url_filter.grams(F.col("host"), F.col("path")).alias("grams")).collect():
        assert Counter(r["grams"]) == Counter(brute("h", f"^{r['host']}$") + brute("p", f"^{r['path']}$"))


def test_passages_of_a_message_of_very_many_lines(spark):
    n = 50_000
    text = "\n".join((">" if i % 3 else "") + f"line {i}" for i in range(n))
    chats = spark.createDataFrame([("c", 1, "user", text)], "conv_id string, turn long, role string, text string")
    got = [(p["level"], p["lines"]) for p in chat_quotes.passages(chats).first()["passages"]]
    want = [x for i in range(0, n, 3) for x in ((0, [f"line {i}"]), (1, [f"line {j}" for j in (i + 1, i + 2) if j < n])) if x[1]]
    assert got == want


# WARC packages.


@pytest.mark.parametrize("zip64", [False, True])
def test_packages_are_zip_files(zip64):
    out = io.BytesIO()
    writer = wacz.PackageWriter(out, zip64)
    payloads = [b"", b"abc", "é\r\n\r\nWARC/1.1".encode(), b"\x00" * 100_000]
    for i, p in enumerate(payloads):
        writer.add(i, f"http://x/{i}", p)
    writer.add(9, None, payloads[1], refers_to=1, revisit=True)
    writer.close()
    data = out.getvalue()
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.testzip() is None and all(i.compress_type == 0 for i in z.infolist())
    got = [(e["page_id"], f["WARC-Type"], p) for e, f, p in wacz.records(pa.BufferReader(data))]
    assert got == [*((i, "response", p) for i, p in enumerate(payloads)), (9, "revisit", b"")]
    with pytest.raises(ValueError):
        wacz.members(pa.BufferReader(b"no zip file at all" * 10))


def test_packages_of_other_zip_writers():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", b"stored", zipfile.ZIP_STORED)
        z.writestr("b.txt", b"packed" * 99, zipfile.ZIP_DEFLATED)
        z.comment = b"a comment"
    data = out.getvalue()
    found = wacz.members(pa.BufferReader(data))
    assert list(found) == ["a.txt"] and data[found["a.txt"][0] :][: found["a.txt"][1]] == b"stored"


def test_wacz_round_trip(spark, sf):
    odd = spark.createDataFrame(
        [(1, "a", "<p>", 0), (2, "b", "<p>", 0), (3, None, None, 0), (4, 'q"\n', "", 0), (None, "d", "<p>", 0), (5, "e", "é" * 70_000, 0), (5, "e", "é" * 70_000, 0), (6, "f", "x\r\n\r\ny", 0)],
        "page_id long, url string, html string, sha int",
    )
    for df in (odd, common.table(spark, sf, "pages")):
        rows = df.collect()
        first = {}
        for r in rows:
            p = (r["html"] or "").encode()
            if r["page_id"] is not None:
                first[p] = min(first.get(p, r["page_id"]), r["page_id"])
        want = Counter()
        seen = set()
        for r in rows:
            p = (r["html"] or "").encode()
            old = first[p] != r["page_id"] or p in seen  # of rows that repeat page_id and payload, one is the response
            if not old:
                seen.add(p)
            want[r["page_id"], len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if old else "response", first[p] if old else None] += 1
        got = wacz.round_trip(df)
        assert Counter(tuple(r) for r in got.drop("url", "payload").collect()) == want
        assert Counter((r["page_id"], r["url"] or "", bytes(r["payload"])) for r in got.where("record_type = 'response'").collect()) <= Counter((r["page_id"], r["url"] or "", (r["html"] or "").encode()) for r in rows)
    assert wacz.round_trip(odd.limit(0)).count() == 0


# Nearest neighbours.


def brute_nearest(rows, top, every=20):
    ok = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)})
    out = {}
    for i, v in ok:
        if i % every == 0:
            near = sorted((-float(np.dot(np.array(v), np.array(w))), j) for j, w in ok if j != i and len(w) == len(v))
            out[i] = [(j, -s) for s, j in near[:top]]
    return out


def test_nearest_recall(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.standard_normal((3000, 24)) * rng.uniform(0.5, 2, (3000, 1)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute_nearest(rows, 20)
    got = {}
    for r in ann.nearest(df, shard=1000).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got.keys() == want.keys() and all(len(g) == 20 for g in got.values())
    assert np.mean([len({j for j, _ in got[q]} & {j for j, _ in want[q]}) / 20 for q in want]) >= 0.95
    exact = dict(rows)
    for q, found in got.items():
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
        assert all(s == pytest.approx(np.dot(exact[q], exact[j]), abs=1e-12) for j, s in found)


def graph_recall(vectors, queries):
    """Shares of the 20 nearest found, all in one shell as the operator deals them."""
    norms = np.linalg.norm(vectors, axis=1)
    shell = np.floor(np.log2(norms) + 0.5)
    want = np.argsort(-(queries @ vectors.T), 1, kind="stable")[:, :20]
    found = [[] for _ in queries]
    for x in np.unique(shell):
        at = np.flatnonzero(shell == x)
        graph = ann.Graph(ann.Graph.build(vectors[at], [[int(i)] for i in at]))
        for i, (_, ids, scores) in enumerate(graph.answers(queries, np.full(len(queries), -1), 20)):
            found[i] += list(zip(-scores, ids))
    return np.mean([len({j for _, j in sorted(f)[:20]} & set(w.tolist())) / 20 for f, w in zip(found, want)])


def test_nearest_recall_on_uneven_vectors():
    rng = np.random.default_rng(3)
    plain = rng.standard_normal((4000, 64))
    plain /= np.linalg.norm(plain, axis=1, keepdims=True)
    queries = plain[:100].copy()
    outlier = plain.copy()
    outlier[7] *= 1e5
    assert graph_recall(outlier, queries) >= 0.95
    assert graph_recall(plain * np.exp(rng.standard_normal((4000, 1))), queries) >= 0.95
    for k in (40, 200):
        tight = plain[rng.integers(k, size=4000)] + 0.02 * rng.standard_normal((4000, 64))
        assert graph_recall(tight, tight[:100]) >= 0.95, k


def test_nearest_on_odd_rows(spark):
    same = [1.0, 2.0, 3.0]
    rows = [(i, same) for i in range(100)] + [(20, same), (200, [3.0, 2.0, 1.0]), (201, None), (202, [0.0] * 3), (203, [1.0, None, 1.0]), (204, [float("nan"), 1.0, 1.0]), (220, [float("inf"), 1.0, 1.0]), (None, same), (240, []), (260, [1.0, 1.0]), (261, [2.0, 2.0]), (300, [5.0] * 7)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, v int, dim string")
    want = brute_nearest(rows, 20)
    got = {}
    for r in ann.nearest(df).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(got.setdefault(r["query_id"], [])) + 1
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert got == {q: n for q, n in want.items() if n}
    assert got[0][0][0] == 1 and got[260] == [(261, 4.0)] and 300 not in got
    assert ann.nearest(df.limit(0)).count() == 0


# Quotation linking.


def test_quotes(spark):
    rows = [
        (1, 0, "user", "Hello there\nhow are you", "x"),
        (1, 1, "assistant", "> hello  THERE\n> how are you\nI am fine.\nThanks!", "x"),
        (1, 2, "user", "> > Hello there\n> > how are you\n> I am fine.\n> Thanks!\nGood.", "x"),
        (2, 0, "user", ">I am fine\nFrom elsewhere", "x"),
        (3, 0, None, None, None),
        (3, 1, "user", "> never said before\nAlone", "x"),
        (4, 0, "user", "Good.\n> Later words\nEnd", "x"),
        (4, 1, "user", "Later words", "x"),
        (None, 1, "user", "> Good.", "x"),
        (5, None, "user", "> Good.", "x"),
        (6, 0, "user", ">>>\n> ...", "x"),
        (6, 1, "user", "> Good.\nsame\n> > deeper", "x"),
        (6, 1, "user", "> Good.\nsame\n> > deeper", "x"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, reply_conv string")
    got = {(r["conv_id"], r["turn"]): r for r in chat_quotes.link(df).collect()}
    assert chat_quotes.link(df).count() == len(rows)
    reply = {k: (r["reply_conv"], r["reply_turn"]) for k, r in got.items() if r["reply_conv"] is not None}
    assert reply == {(1, 1): (1, 0), (1, 2): (1, 1), (2, 0): (1, 1), (6, 1): (1, 2)}
    assert {k: (r["thread_conv"], r["thread_turn"], r["depth"]) for k, r in got.items() if k in reply} == {(1, 1): (1, 0, 1), (1, 2): (1, 0, 2), (2, 0): (1, 0, 2), (6, 1): (1, 0, 3)}
    assert got[1, 2]["own_text"] == "Good." and got[1, 2]["quote_levels"] == 2 and got[3, 0]["own_text"] == "" and got[6, 0]["own_text"] == ""
    assert got[4, 0]["depth"] == 0 and got[4, 0]["own_text"] == "Good.\nEnd"
    assert chat_quotes.link(df.limit(0)).count() == 0


def brute_links(rows):
    """(conv, turn) to (reply, thread, depth), by reading everything again and again."""
    plain = lambda t: " ".join(re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower()))
    parsed, units = {}, {}
    for conv, turn, text in rows:
        passages = []
        for line in text.split("\n"):
            mark = re.match(r"(\s*>)+", line)
            level = sum(c == ">" for c in mark[0]) if mark else 0
            body = re.sub(r"^(\s*>)+ ?", "", line)
            if passages and passages[-1][0] == level:
                passages[-1][1].append(body)
            else:
                passages.append((level, [body]))
        parsed[conv, turn] = passages
        own = [lines for level, lines in passages if level == 0]
        whole = [" ".join(lines) for lines in own]
        for u in {plain(" ".join(whole)), *map(plain, whole), *(plain(x) for lines in own for x in lines)} - {""}:
            units.setdefault(u, set()).add((conv, turn))
    reply = {}
    for at, passages in parsed.items():
        found = []
        for level, lines in passages:
            if level:
                for nr, u in [(True, plain(" ".join(lines))), *((False, plain(x)) for x in lines)]:
                    who = units.get(u, set()) if u else set()
                    here, far = min([w for w in who if w[0] == at[0]], default=None), min([w for w in who if w[0] != at[0]], default=None)
                    to = here if here and here < at else far
                    if to:
                        found.append((nr, -level, to))
        if found:
            reply[at] = max(found)[2]
    def endless(at):
        seen = set()
        while at in reply and at not in seen:
            seen.add(at)
            at = reply[at]
        return at in reply

    if on := [at for at in parsed if endless(at)]:
        for at in on:
            if reply[at] > at:
                del reply[at]
    assert not any(map(endless, parsed))
    out = {}
    for at in parsed:
        root, depth = at, 0
        while root in reply:
            root, depth = reply[root], depth + 1
        out[at] = reply.get(at), root, depth
    return out


def test_quotes_against_brute_force(spark):
    rng, rows = random.Random(9), []
    said = ["yes", "No!", "the first idea", "a second, longer idea", "what about that"]
    for conv in range(40):
        for turn in range(rng.randint(1, 6)):
            lines = [("> " * rng.choice((0, 0, 0, 1, 1, 2))) + rng.choice(said + [f"own {conv} {turn}", "..."]) for _ in range(rng.randint(1, 5))]
            if rows and rng.random() < 0.5:
                lines = ["> " + x for x in rng.choice(rows)[2].split("\n")] + lines
            rows.append((conv, turn, "\n".join(lines)))
    got = chat_quotes.link(spark.createDataFrame([(c, t, "u", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")).collect()
    want = brute_links(rows)
    assert {(r["conv_id"], r["turn"]): ((r["reply_conv"], r["reply_turn"]) if r["reply_conv"] is not None else None, (r["thread_conv"], r["thread_turn"]), r["depth"]) for r in got} == want
    assert max(d for _, _, d in want.values()) > 3


def test_links_to_later_conversations_and_of_several_quotes(spark):
    rows = [(1, 0, "> said by two\nsaid by one"), (2, 0, "> said by one\nsaid by two"), (2, 1, "> said by two\nyes\n> said by one\nno"), (3, 0, "> only later\nwell"), (9, 0, "only later")]
    df = spark.createDataFrame([(c, t, "u", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    links = {tuple(r)[:2] + tuple(r)[-2:] for r in chat_quotes.links(df).where("line = -1").collect()}
    assert links == {(1, 0, 2, 0), (2, 0, 1, 0), (2, 1, 2, 0), (2, 1, 1, 0), (3, 0, 9, 0)}
    got = {(r["conv_id"], r["turn"]): (r["reply_conv"], r["reply_turn"], r["thread_conv"], r["depth"]) for r in chat_quotes.link(df).collect()}
    assert got == {(1, 0): (None, None, 1, 0), (2, 0): (1, 0, 1, 1), (2, 1): (2, 0, 1, 2), (3, 0): (9, 0, 9, 1), (9, 0): (None, None, 9, 0)}


def test_a_long_thread(spark):
    """A chain of replies, each quoting the one before."""
    rows = [(1, 0, "u", "message number 0")] + [(1, i, "u", f"> message number {i - 1}\nmessage number {i}") for i in range(1, 40)]
    got = {r["turn"]: r for r in chat_quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert all((got[i]["thread_turn"], got[i]["depth"], got[i]["own_text"]) == (0, i, f"message number {i}") for i in range(40))


def test_quote_query_keeps_every_message(spark, sf):
    assert queries.op9_quote_links(spark, sf).count() == common.table(spark, sf, "conversations").count()


# Components.


def test_components_of_paths_stars_and_rings(spark):
    rng = random.Random(2)
    names = list(range(400))
    rng.shuffle(names)
    path = [(names[i], names[i + 1]) for i in range(150)]
    star = [(names[200], names[i]) for i in range(201, 300)]
    ring = [(names[300 + i], names[300 + (i + 1) % 50]) for i in range(50)]
    got = {r["id"]: r["comp"] for r in common.connected_components(spark.createDataFrame(path + star + ring + path[:3], "src long, dst long")).collect()}
    for group in (names[:151], names[200:300], names[300:350]):
        assert {got[i] for i in group} == {min(group)}
    assert common.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


# The pipeline.


def test_pipeline_stages(spark, sf):
    docs = common.table(spark, sf, "documents")
    columns = docs.columns
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, common.stored(stage(spark, docs, sf), "test")
        seen.append(docs.count())
        if name != "sentencepiece":
            assert docs.columns == columns and docs.dtypes == before.dtypes
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "minhash_dedup", "decontaminate", "sentencepiece"]
    assert all(a >= b for a, b in zip(seen, seen[1:])) and seen[-1] > 0
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, docs.collect())) == sorted(map(tuple, corpus_pipeline.run(spark, sf).collect()))


def test_pipeline_against_brute_force(spark, tmp_path):
    """All five stages in plain Python, over texts that each of them has something to do with."""
    import sentencepiece

    rng = random.Random(10)
    items = [(i, " ".join(rand_words(rng, rng.choice((5, 13, 30))))) for i in range(4)]
    shared = " ".join(rand_words(rng, 30))
    base = [rand_words(rng, 150) for _ in range(6)]
    texts = [None, "", "... ???", "123 456", "word"]
    for i in range(40):
        own = list(base[i % 6])
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(len(own))] = f"edit{rng.randrange(10**5)}"
        lines = [" ".join(own[k : k + 75]) for k in (0, 75)] + [shared] * (i % 3 == 0) + [" ".join(rand_words(rng, 40))] * (i % 4 == 0) + ["", "   "] * (i % 5 == 0)
        texts.append("\n".join(lines) + (" " + items[i % 4][1] if i % 7 == 0 else ""))
    texts += [texts[8], items[2][1], f"few words {items[0][1]} around it"]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = {i: t for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)}
    hashes = {r[0]: r[1] for r in docs.select("doc_id", F.xxhash64("text")).collect()}
    keep = brute_lines([(i, hashes[i], t) for i, t in kept.items()])
    left = {}
    for i, t in kept.items():
        gone = {k for k, _ in enumerate(t.split("\n")) if keep.get((i, hashes[i], k), (i, hashes[i], k)) != (i, hashes[i], k)}
        rest = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
        if not gone or words(rest):
            left[i] = rest
    classes = brute_classes(list(left), list(left.values()))
    left = {i: t for i, t in left.items() if classes[i] == i and not brute(t, items)[4]}
    model = sentencepiece.SentencePieceProcessor(model_file=queries.sentencepiece_model())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = sorted((i, len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids))) for i, t in left.items() for ids in [model.encode(t)])
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == want
    assert 10 < len(want) < len(texts) - 10


def test_pipeline_on_empty_documents(spark, sf, tmp_path):
    common.table(spark, sf, "documents").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    common.table(spark, sf, "benchmark").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_query_is_registered():
    numbers = [int(name[2:].split("_")[0]) for name in queries.QUERIES]
    assert sorted(numbers) == list(range(1, 11)) and set(queries.ORACLES) <= set(queries.QUERIES)
