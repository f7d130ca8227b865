"""Every stage and operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns;
op7's fill, op8's convolution and op10's matches against plain versions."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("docflow.llm")
pipeline = pytest.importorskip("corpus_pipeline")

from docflow.llm import chat, decontaminate, embeddings, jaccard, lines, packing, queries, sharding, substrings, toxicity, urls  # noqa: E402, F401
from docflow.llm.queries import tokenizer_path  # noqa: E402

R = random.Random(21)
WORDS = ["".join(R.choices("abcdefghijklmnop", k=R.randrange(3, 9))) for _ in range(600)]
PASSAGE = " ".join(R.choices(WORDS, k=60))


def _text(n):
    return " ".join(R.choices(WORDS, k=n))


TEXTS = [(None, None), (None, ""), (1, None), (2, ""), (3, " \n\t\n"), (4, "x" * 300_000), (5, _text(60_000)), (6, _text(80)), (6, _text(80)), (7, "\n".join([_text(12)] * 50)), (8, "?!\n?!"), (9, _text(40) + " " + PASSAGE), (10, "one"), (10, "one"), (None, _text(70))]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, removed int, bucket int, low string, kind string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None if k == 3 else "en", "s", len(t or ""), 1.0, 1, 1, "l", "k") for k, (i, t) in enumerate(TEXTS)], SCHEMA)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("edges"))
    spark.createDataFrame([(6, None, 0), (7, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE), (1, PASSAGE), (None, "x"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages(spark, docs, folder):
    kept = {name: stage(spark, docs.select(*pipeline.COLUMNS), folder) for name, stage in pipeline.STAGES[:-1]}
    assert kept["toxicity"].count() == len(TEXTS)  # no toxic label at hand: all stay
    left = [(r["doc_id"], r["text"]) for r in kept["line_dedup"].collect()]
    assert (7, TEXTS[9][1].split("\n")[0]) in left and (8, "?!\n?!") in left and (1, None) in left and (2, "") in left
    once = [(r["doc_id"], r["text"]) for r in kept["ngram_jaccard"].collect()]
    assert once.count((10, "one")) == 1 and {i for i, _ in once} == {i for i, _ in TEXTS} and len(once) == len(TEXTS) - 1
    assert sorted(r["doc_id"] or 0 for r in kept["decontaminate"].collect()) == sorted(i or 0 for i, _ in TEXTS if i != 9)
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.select(*pipeline.COLUMNS).limit(0), folder).count() == 0, name


def test_operators_keep_or_count_every_row(spark, docs):
    n = len(TEXTS)
    assert substrings.remove_repeats(docs).count() == n
    cut = lines.drop_lines(docs)
    assert cut.count() == n and set(cut.columns) == {*docs.columns, "n_lines"}
    assert jaccard.join(docs).count() == n
    got = sharding.two_pass_shuffle(docs, 4)
    assert got.count() == n and {"bucket", "kind", "shard", "slot"} <= set(got.columns)
    pieces = packing.pack(docs, tokenizer_path()).groupBy().agg(F.sum("length").alias("n"), F.count_if(F.col("start") == 0).alias("docs")).first()
    assert pieces["docs"] == n and pieces["n"] > n
    model = toxicity.fit([], [], [], [])
    assert toxicity.score(docs, model).count() == n
    assert decontaminate.decontaminate(docs, spark.createDataFrame([], "item_id long, text string")).count() == n


def test_fill_is_as_close_as_any_choice():
    for _ in range(200):
        counts = {R.randrange(1, 30): R.randrange(1, 4) for _ in range(R.randrange(1, 5))}
        room = R.randrange(0, 60)
        best = max((s for s in (sum(k * x for k, x in zip(counts, take, strict=True)) for take in itertools.product(*[range(v + 1) for v in counts.values()])) if s <= room), default=0)
        used = packing.fill(counts, room)
        assert sum(k * v for k, v in used.items()) == best and all(v <= counts[k] for k, v in used.items())


def test_scores_equal_a_plain_convolution():
    texts = [_text(R.randrange(0, 40)) for _ in range(60)]
    model = toxicity.fit([t + (" vile foul" if i % 3 == 0 else "") for i, t in enumerate(texts)], [int(i % 3 == 0) for i in range(60)], ["en"] * 60, [1.0] * 60)
    words, begin = toxicity.encode(texts + ["vile " + t for t in texts])
    got = model.scores(words, begin)
    for k, (a, b) in enumerate(zip(begin[:-1], begin[1:], strict=True)):
        x = model.embedding[model.rows[words[a:b]]].astype(np.float64)
        pooled = []
        for filters, bias in zip(model.filters, model.biases, strict=True):
            w = len(filters)
            padded = np.concatenate([x, np.zeros((w, x.shape[1]))])
            best = np.zeros(filters.shape[2])  # a window of zeros is always there
            for i in range(len(x)):
                best = np.maximum(best, sum(padded[i + j] @ filters[j] for j in range(w)))
            pooled.append(np.maximum(best + bias, 0))
        logit = np.concatenate(pooled) @ model.out + model.bias
        want = 1 / (1 + np.exp(-np.clip(model.scale[0] * logit + model.scale[1], -30, 30)))
        assert abs(got[k] - want) < 1e-4


def _edits_in(pattern, text):
    """Least edits between the pattern and any part of the text: a full table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_matches_equal_a_full_scan(spark):
    items = [(i, " ".join(R.choices(WORDS, k=R.randrange(8, 16)))) for i in range(6)]
    table = []
    for d in range(40):
        _, p = R.choice(items)
        noisy = list(p)
        for _ in range(R.randrange(0, 14)):
            k = R.randrange(len(noisy))
            noisy[k] = R.choice(["", "z", noisy[k] + "q"])
        table.append((d, _text(R.randrange(0, 20)) + " " + "".join(noisy) + " " + _text(R.randrange(0, 20))))
    want = {}
    for d, t in table:
        folded = " ".join(t.lower().split())
        for i, p in items:
            e = _edits_in(p, folded)
            if e <= decontaminate.budget(len(p), decontaminate.Q, decontaminate.EDIT_RATE):
                want[d, i] = e
    df, bench = spark.createDataFrame(table, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["e"] for r in decontaminate.matches(df, bench).groupBy("doc_id", "item_id").agg(F.min("edits").alias("e")).collect()}
    assert got == want and len(want) > 15


def test_urls_by_brute_force(spark):
    rules = list(urls.RULES)
    parts = [["http://", "https://", "", "x://y://"], ["a.com", "EXAMPLE.com", "www.example.com", "b.net", "example.com.org", "xexample.com", ""], ["", "/en/", "/en", "/es/1", "/fr/?q", "?/en/", "#/en/"]]
    table = [(i, "".join(p)) for i, p in enumerate(itertools.product(*parts))] + [(-1, None)]
    pages = spark.createDataFrame(table, "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in urls.judge(pages, rules, [0.0] * (1 << urls.BITS), 0.0).collect()}
    for i, u in table:
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            end = min([k for k in map(rest.find, "/?#") if k >= 0], default=len(rest))
            host, rest = rest[:end].lower(), rest[end:]
            path = rest[: min([k for k in map(rest.find, "?#") if k >= 0], default=len(rest))]
        fits = [r for _, r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        assert got[i] == (host, path, max(fits, key=len, default=None)), u


def test_shards_move_records_once(spark):
    """The join with the buckets' offsets is a broadcast, so that records are shuffled once, whatever their size."""
    from docflow.llm import sharding

    docs = spark.createDataFrame([(i, "x" * i) for i in range(30)], "doc_id long, text string")
    plan = sharding.two_pass_shuffle(docs, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan


def test_line_blocks_do_not_step_with_size():
    from docflow.llm import lines

    assert {len(lines.blocking(n)) for n in (10**4, 10**6, 10**8)} == {15}


def test_line_loads_are_not_written_before_their_shuffle(spark, monkeypatch):
    """What only goes to a bucket is shuffled once and never written besides: classes once, then what their keys gave."""
    from docflow.llm import lines

    names = []
    plain = lines.written
    monkeypatch.setattr(lines, "written", lambda df, name, *by: names.append(name) or plain(df, name, *by))
    df = spark.createDataFrame([(i, f"one line of some words {'abcdefgh'[i % 4] * 9}") for i in range(8)], "doc_id long, text string")
    assert {r["doc"] for r in lines.dedup(df).collect()} >= {4, 5, 6, 7}
    assert names[:3] == ["lines", "found", "alike"]
