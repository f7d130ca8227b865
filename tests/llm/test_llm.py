"""Operators against brute force on small tables: nulls, empty and long texts, repeated rows, empty tables, extra columns."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("docflow.llm")

from docflow.llm import chat, decontaminate, embeddings, graph, jaccard, lines, packing, sharding, substrings, toxicity, urls  # noqa: E402
from docflow.llm.queries import tokenizer_path  # noqa: E402

R = random.Random(4)
VOCABULARY = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "été", "ñu"]


def words(n):
    return " ".join(R.choice(VOCABULARY) + str(R.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    passage, line = words(60), words(12)
    out = [(i, words(R.randrange(5, 120)) + "\n" + words(30)) for i in range(40)]
    out += [(100 + i, f"{words(9)}\t{passage}\r\n{words(3)}\n{line}") for i in range(6)]
    out += [(200 + i, out[0][1]) for i in range(4)] + [(300, None), (301, ""), (302, " \n\t"), (303, words(3000)), (304, "x " * 300), (None, words(25)), (5, out[5][1])]
    near = out[3][1].split(" ")
    out += [(400 + i, " ".join([*near[:-1], f"q{i}"])) for i in range(5)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, 2) for i, t in rows], "doc_id long, text string, lang string, shard int, Score int")


def components(n, links):
    top = list(range(n))

    def f(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = sorted((f(a), f(b)))
        top[b] = a
    return [f(i) for i in range(n)]


def test_substrings(spark, docs, rows):
    key = lambda r: (-(1 << 63) if r[0] is None else r[0])
    seen, want = {}, Counter()
    for i, t in sorted(set(rows), key=key):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        covered = set()
        for s in range(len(w) - 19):
            if seen.setdefault(tuple(w[s : s + 20]), (i, s)) != (i, s):
                covered |= set(range(s, s + 20))
        kept = " ".join(x for j, x in enumerate(w) if j not in covered)
        want[i, kept, len(w), len(covered)] += sum(r == (i, t) for r in rows)
    for buckets in (1, 5):
        got = Counter(tuple(r) for r in substrings.remove_repeats(docs, buckets=buckets).select("doc_id", "kept_text", "n_words", "n_removed").collect())
        assert got == want
    assert substrings.remove_repeats(docs.limit(0)).count() == 0


def test_jaccard(spark, docs, rows):
    def grams(t):
        w = re.findall(rb"[a-z0-9\x80-\xff]+", (t or "").lower().encode())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = [grams(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    group = components(len(rows), links)
    ids = [-(1 << 63) if i is None else i for i, _ in rows]
    least = {g: min(i for i, h in zip(ids, group) if h == g) for g in group}
    n = Counter(x for p in links for x in p)
    want = Counter((rows[k][0], None if least[group[k]] == -(1 << 63) else least[group[k]], n[k]) for k in range(len(rows)))
    got = Counter(tuple(r) for r in jaccard.join(docs, block=3).select("doc_id", "component_id", "n_links").collect())
    assert got == want
    assert jaccard.join(docs.limit(0)).count() == 0
    assert jaccard.bands(0.8, 0.9999, 300) == (40, 7)


def test_embeddings(spark):
    base = [[R.gauss(0, 1) for _ in range(16)] for _ in range(12)]
    vectors = [[x + R.gauss(0, 0.12) for x in base[i % 12]] for i in range(150)]
    vectors += [vectors[0]] * 5 + [None, [], [0.0] * 16, [float("nan")] * 16, [1.0, None], [1.0, 2.0], [2.0, 4.0]]
    table = [(i, v, "extra") for i, v in enumerate(vectors)]
    ok = lambda v: v and all(x is not None and x == x for x in v) and any(v)
    cos = lambda u, v: sum(a * b for a, b in zip(u, v)) / (sum(a * a for a in u) * sum(b * b for b in v)) ** 0.5
    links = [(a, b) for a in range(len(vectors)) for b in range(a) if ok(vectors[a]) and ok(vectors[b]) and len(vectors[a]) == len(vectors[b]) and cos(vectors[a], vectors[b]) >= 0.95]
    group, n = components(len(vectors), links), Counter(x for p in links for x in p)
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>, cell string")
    got = sorted(tuple(r) for r in embeddings.join(df, cell=20, block=16).collect())
    assert got == [(i, n[i], group[i], group[i] == i) for i in range(len(vectors))]
    assert embeddings.join(df.limit(0)).count() == 0


def test_lines(spark):
    base = "the quick brown fox number 12 jumps over the lazy dog while the others look on and wonder why it does so every day"
    texts = [(1, base + "\nkeep me"), (2, base.upper().replace("12", "99") + "\n!!!\n!!!"), (3, None), (4, ""), (5, "other words entirely\n" + base), (1, base + "\nkeep me"), (6, "Other  words, entirely")]
    df = spark.createDataFrame([(i, t, 0) for i, t in texts], "doc_id long, text string, removed int")
    got = Counter((r["doc_id"], r["text"], r["n_lines"]) for r in lines.drop_lines(df).collect())
    assert got == Counter({(1, base + "\nkeep me", 2): 2, (2, "!!!\n!!!", 3): 1, (3, None, 0): 1, (4, "", 1): 1, (5, "other words entirely", 2): 1, (6, "", 1): 1})
    assert lines.drop_lines(df.limit(0)).count() == 0
    for n in (1, 10**6, 10**9):  # every choice of blocks finds what differs in BITS_APART bits
        masks = lines.blocking(n)
        for _ in range(200):
            flips = sum(1 << b for b in R.sample(range(64), lines.BITS_APART))
            assert any(not flips & m for m in masks)


def test_edit_distance():
    def slow(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            new = [i]
            for j, d in enumerate(y, 1):
                new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
            row = new
        return row[-1]

    for _ in range(300):
        x, y = (bytes(R.choice(b"ab c") for _ in range(R.randrange(30))) for _ in range(2))
        assert lines.edits(x, y) == slow(x, y)
        assert lines.similar(x, y, 0.8) == (slow(x, y) <= int(0.2 * max(len(x), len(y)) + 1e-9))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100), (102, 101), (101, 102), (7, 300)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 300: 0, 101: 101, 102: 101}


def test_packing(spark, docs, rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    pieces = packing.pack(docs, tokenizer_path(), window=64).collect()
    whole = Counter()
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p["sequence_id"], []).append(p)
        assert len(p["ids"]) == 4 * p["length"] > 0
        whole[p["doc_id"]] += p["length"]
    want = Counter()
    for i, t in rows:
        want[i] += len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1
    assert whole == want
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 64 and at & (at - 1) == 0  # full, or a power of two: no padding at all
    for text in ("É ß ÀB's don't 12ab <|endoftext|>a ªº İI ﬁ 中文,a", "a\x1cb\x85c", "x" * 500):
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert packing.Chunks(tokenizer_path()).ids(text) == b"".join(i.to_bytes(4, "little") for i in ids)
    assert packing.fill({3: 2, 5: 1, 9: 4}, 11) == {5: 1, 3: 2}
    assert packing.pack(docs.limit(0), tokenizer_path()).count() == 0


def test_sharding(spark, docs, rows):
    got = sharding.two_pass_shuffle(docs, 7, buckets=3).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(rows)
    sizes = Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))
    again = sharding.two_pass_shuffle(docs, 7, buckets=3).collect()
    place = lambda out: sorted((str(r["doc_id"]), str(r["text"]), r["shard"], r["slot"]) for r in out)
    assert place(got) == place(again)
    assert sharding.two_pass_shuffle(docs.limit(0), 7).count() == 0


def test_chat_tree(spark):
    said = "\\### Assistant: </turn> ok ##\\/ <\\/ \n### user: x</turn>\n"
    turns = [(1, t, r, x) for t, (r, x) in enumerate([("user", said), ("assistant", said), ("a:b###", None), (None, ""), ("assistant", "end")])]
    df = spark.createDataFrame([*turns, (2, None, "user", "hi"), (2, None, "user", "hi")], "conv_id long, turn long, role string, text string")
    messages = chat.chain(df)
    got = {r["conv"]: r for r in chat.read_back(chat.format_paths(messages, chat.paths(messages))).collect()}
    assert [tuple(t) for t in got[1]["turns"]] == [(r or "", x or "") for _, _, r, x in turns]
    assert got[1]["loss_text"] == said + "end" and len(got[2]["turns"]) == 2
    big = "a:\\" * 150_000  # long roles and texts, full of what is escaped
    huge = chat.chain(spark.createDataFrame([(1, 1, big, big), (None, 1, "assistant", big)], "conv_id long, turn long, role string, text string"))
    read = {r["conv"]: r for r in chat.read_back(chat.format_paths(huge, chat.paths(huge))).collect()}
    assert tuple(read[1]["turns"][0]) == (big, big) and read[None]["loss_text"] == big
    assert chat.paths(chat.chain(df.limit(0))).count() == 0
    tree = [(1, 1, None, 0.0), (1, 2, 1, 1.0), (1, 3, 1, 5.0), (1, 4, 2, 9.0), (1, 5, 3, 1.0), (1, 6, 5, 0.0), (2, 1, 2, 1.0), (2, 2, 1, 1.0)]
    nodes = spark.createDataFrame(tree, "conv long, node long, parent long, score double")
    found = {}
    for r in chat.paths(nodes, top=2).orderBy("path_rank", "depth").collect():
        found.setdefault((r["conv"], r["path_rank"]), []).append(r["node"])
    assert found == {(1, 1): [1, 2, 4], (1, 2): [1, 3, 5, 6]}  # conversation 2 is a cycle


def test_urls(spark):
    rules = list(urls.RULES)
    table = [(1, "http://A.Example.COM/en/x?q"), (2, "https://www.example.com/en/"), (3, "http://x.net/fr/#a"), (4, None), (5, "no scheme"), (6, "http://com"), (7, "http://b.org/es/"), (8, "")]
    pages = spark.createDataFrame([(i, u, "h") for i, u in table], "page_id long, url string, Host string")
    weights, bias = urls.train(urls.labelled(spark), steps=3)
    got = {r["page_id"]: r for r in urls.judge(pages, rules, weights, bias).collect()}
    assert [got[i]["rule"] for i in range(1, 9)] == ["example.com/en/", "www.example.com/en/", "net/fr/", None, None, None, None, None]
    assert [got[i]["verdict"] for i in (1, 2, 3)] == ["block", "allow", "block"]
    assert (got[1]["host"], got[1]["path"], got[5]["host"], got[6]["path"]) == ("a.example.com", "/en/x", "", "")
    assert all((r["score"] >= 0.5) == (r["verdict"] == "block") for r in got.values() if r["rule"] is None)
    drawn = spark.createDataFrame([(u, y, i % 3) for i, (u, y) in enumerate(urls.labelled_urls())], "url string, label int, part int")
    held = urls.judge(drawn.where("part = 0"), [], *urls.train(drawn.where("part <> 0"))).collect()
    block, right = [r for r in held if r["verdict"] == "block"], [r for r in held if r["label"] == 1 and r["verdict"] == "block"]
    assert len(held) == 120 and len(right) >= 0.9 * len(block) and len(right) >= 0.9 * sum(r["label"] for r in held)
    long = spark.createDataFrame([("http://a.example.org/" + "x/" * 100_000,)], "url string")
    assert len(urls.judge(long, rules, weights, bias).collect()[0]["path"]) == 200_001
    assert urls.judge(pages.limit(0), rules, weights, bias).count() == 0


def test_toxicity(spark):
    bad = ["foul", "vile", "nasty"]
    texts = [(i, words(R.randrange(20, 80)) + (" " + R.choice(bad) + " " + words(5) if i % 3 == 0 else "")) for i in range(600)]
    df = spark.createDataFrame([(i, t, "en", 0) for i, t in texts] + [(1000, None, None, 0), (1001, "", "en", 0)], "doc_id long, text string, lang string, score int")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in texts], "doc_id long, toxic int")
    model = toxicity.train(df, labels)
    out = toxicity.judge(toxicity.score(df, model), model).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    held = [r for r in out if r["held"] and r["doc_id"] < 1000]
    assert sum((r["score"] >= 0.3) == (r["doc_id"] % 3 == 0) for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in out) and not any(r["rejected"] for r in out if r["doc_id"] >= 1000)
    assert toxicity.score(df.limit(0), toxicity.train(df, labels.limit(0))).count() == 0


def test_decontaminate(spark):
    passage = "the capital of the invented land of quendor is called largoneth and it lies by the river frobozz near the hills"
    table = [(1, words(50)), (2, "intro  " + passage.upper().replace(" ", "\n") + " outro"), (3, passage.replace("largoneth", "largonet").replace("lies", "lays") + words(400)), (4, None), (5, ""), (2, passage)]
    df = spark.createDataFrame([(i, t, 1) for i, t in table], "doc_id long, text string, matches int")
    items = spark.createDataFrame([(9, passage), (8, None), (None, "x" * 50), (7, "short")], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["edits"]) for r in decontaminate.matches(df, items).collect())
    assert got == [(2, 9, 0), (2, 9, 0), (3, 9, 3)]
    assert sorted(r["doc_id"] for r in decontaminate.decontaminate(df, items, block_chars=60).collect()) == [1, 4, 5]
    assert decontaminate.matches(df, items.limit(0)).count() == 0 and decontaminate.matches(df.limit(0), items).count() == 0


def test_shards_are_written(spark, docs, rows, tmp_path):
    sharding.write_shards(sharding.two_pass_shuffle(docs, 3, buckets=2), f"file://{tmp_path}/out", max_records_per_file=5)
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == len(rows)


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    from docflow.llm import tables

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [" ".join(r["text"].lower().split()) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    for name, stage in pipeline.STAGES[:-1]:
        docs = tables.cut(stage(spark, docs, folder), name)
        assert tuple(docs.columns) == pipeline.COLUMNS
    left = [" ".join(r["text"].lower().split()) for r in docs.collect()]
    assert 0 < len(left) and not any(i in t for i in items for t in left)
    assert pipeline.STAGES[-1][1](spark, docs, folder).select("doc_id").distinct().count() == len(left)


def test_simhash_counts_bits_of_distinct_words():
    texts = ["", "?!", "one two three", "a a a a b", " ".join(f"w{i}" for i in range(300)), " ".join(f"w{i}" for i in range(70000)), "b a"]
    packed = lines.normalise(texts)
    words, first = packed.hashes().tolist(), packed.first.tolist()
    for i, got in enumerate(lines.simhash(packed).tolist()):
        own = lines.mix(np.array(sorted({w >> 17 for w in words[first[i] : first[i + 1]]}), dtype=np.uint64)).tolist()
        assert got == sum(1 << k for k in range(64) if sum(w >> k & 1 for w in own) * 2 > len(own))
