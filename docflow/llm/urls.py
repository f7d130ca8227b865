"""URL filters: rules first, then logistic regression on hashed character n-grams of host and path.

Everything is DataFrame and SQL functions. Training sums gradients of the labelled table with a
grouped aggregation per step, so the labelled table may be of any size; the driver holds the
weights, whose number is fixed (`BITS`). Scoring looks the n-grams' weights up in one constant
array, row by row, without a shuffle, so a host that holds a third of all pages costs nothing.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS, GRAM, STEPS, RATE, DECAY = 12, 4, 20, 16.0, 1e-4

#: Rules of the contract: verdict, then host and path.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))

#: Words of the invented labelled table, those of blocked urls, of allowed ones, and of either.
BLOCKED = "casino bonus pills viagra cams adult poker slots prize winner loans torrent warez crack xxx escort popup banner tracker clickbait jackpot betting replica lottery".split()
ALLOWED = "docs guide blog garden news science library catalogue museum exhibit school lesson weather forecast recipes bread wiki history council minutes forum thread journal archive".split()
EITHER = "www site home page live today online web shop media info portal".split()
#: Rows of the labelled table.
ROWS = 360


def labelled_urls() -> list[tuple[str, int]]:
    """The labelled table: urls drawn from two words of their label and one of either, in four
    shapes; some have hosts of made-up syllables, and some allowed ones no telling word at all."""
    draw = random.Random(11)
    out = []
    for label in (0, 1) * (ROWS // 2):
        one, two = draw.sample(BLOCKED if label else ALLOWED, 2)
        any_ = draw.choice(EITHER)
        odd = "".join(draw.choices(("th", "re", "ou", "bli", "sto", "en", "ar", "mi"), k=3))
        host = draw.choice((f"{odd}.example", f"{one}-{two}.example", f"{one}.{any_}.example", f"{any_}.{one}.example"))
        path = draw.choice((f"{one}/{two}", f"{two}/{draw.randrange(900)}", f"{one}-{two}/{any_}", f"{any_}/{two}"))
        if not label and draw.random() < 0.3:  # an ordinary page of which the url says nothing
            host, path = f"{draw.choice(('', 'm.', 'www.', 'blog.'))}{odd}.example", f"{draw.choice(('en', 'de', 'page', 'item'))}/{draw.randrange(900)}"
        out.append((f"{draw.choice(('http', 'https'))}://{host}.{draw.choice(('com', 'net', 'org'))}/{path}", label))
    return out


def labelled(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{u}', {y})" for u, y in labelled_urls()) + " AS t(url, label)")


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def grams(host: Column, path: Column) -> Column:
    """Hashed character n-grams, those of the host apart from those of the path."""

    def of(side: str, text: Column) -> Column:
        # every character once with its three followers: linear in the length
        each = F.split(F.concat(F.lit("^"), text, F.lit("$$$")), "")
        four = F.arrays_zip(*[F.slice(each, F.lit(k + 1), F.size(each)).alias(f"c{k}") for k in range(GRAM)])
        whole = F.slice(four, F.lit(1), F.length(text) + F.lit(5 - GRAM))
        return F.transform(whole, lambda g: F.pmod(F.xxhash64(F.lit(side), *[g[f"c{k}"] for k in range(GRAM)]), F.lit(1 << BITS)).cast("int"))

    return F.concat(of("h", host), of("p", path))


def _weights(values: list[float]) -> Column:
    return F.split(F.lit(" ".join(f"{v:.9g}" for v in values)), " ").cast("array<double>")  # folded to one constant


def _score(features: Column, weights: Column, bias: float) -> Column:
    """The logit: mean weight of the n-grams, scaled to the root of their number, plus the bias."""
    total = F.aggregate(features, F.lit(0.0), lambda s, i: s + F.element_at(weights, i + 1))
    return total / F.sqrt(F.size(features).cast("double")) + F.lit(bias)


def train(table: DataFrame, *, steps: int = STEPS) -> tuple[list[float], float]:
    """Weights and bias by full gradient descent; null labels are left out. Deterministic."""
    rows = table.where("label is not null").select(grams(host_of(F.col("url")), path_of(F.col("url"))).alias("f"), F.col("label").cast("double").alias("y")).cache()
    weights, bias = [0.0] * (1 << BITS), 0.0
    n = rows.count()
    for _ in range(steps if n else 0):
        off = rows.select("f", (F.lit(1.0) / (F.lit(1.0) + F.exp(-_score(F.col("f"), _weights(weights), bias))) - F.col("y")).alias("e"))
        each = off.select(F.explode(F.concat("f", F.array(F.lit(-1)))).alias("i"), (F.col("e") / F.sqrt(F.size("f").cast("double"))).alias("g"), "e")
        rate = RATE / n
        for r in each.groupBy("i").agg(F.round(F.sum("g"), 9).alias("g"), F.round(F.sum("e"), 9).alias("e")).collect():
            if r["i"] >= 0:
                weights[r["i"]] -= rate * r["g"] + DECAY * weights[r["i"]]
            else:
                bias -= 0.1 * rate * r["e"]
    rows.unpersist()
    return weights, bias


def judge(pages: DataFrame, rules: list[tuple[str, str]], weights: list[float], bias: float, *, url: str = "url", threshold: float = 0.5) -> DataFrame:
    """The pages with host, path, rule (the longest that fits, else null), score and verdict.

    rules: (verdict, host/path). A rule fits its host and all subdomains if the path starts with
    the rule's. Of equal rules the first wins. Empty or null urls have no n-gram of their own and
    are judged by the same model. Columns of these names are replaced.
    """
    new = ("host", "path", "rule", "score", "verdict")
    kept = pages.select(*[c for c in pages.columns if c.lower() not in new or c == url])
    rows = kept.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    rule = verdict = None
    by_text: dict[str, str] = {}
    for what, text in rules:
        by_text.setdefault(text, what)
    for text, what in sorted(by_text.items(), key=lambda r: -len(r[0])):
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        rule = F.when(fits, F.lit(text)) if rule is None else rule.when(fits, F.lit(text))
        verdict = F.when(fits, F.lit(what)) if verdict is None else verdict.when(fits, F.lit(what))
    logit = _score(grams(F.col("host"), F.col("path")), _weights(weights), bias)
    rows = rows.withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-logit)))
    own = F.when(F.col("score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return rows.withColumns({"rule": F.lit(None).cast("string") if rule is None else rule, "verdict": own if verdict is None else verdict.otherwise(own)})
