"""Grounding: claims held against the blocks they cite, violations, repair, and fidelity of trees.

claims: claim_id, doc_id, entity, field, value, ids array; blocks: doc_id, block_id, parent_id (of a
split fragment, else null), page, text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import alnum_fold
from ..functions import fields as P

#: Codes of violations.
MISSING, UNKNOWN, UNSUPPORTED, CROSSED = "MISSING_PROVENANCE", "UNKNOWN_BLOCK_ID", "UNSUPPORTED_CANONICAL_VALUE", "CROSS_ENTITY_SPAN"


def cited(claims: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows (claim_id, doc_id, pos, cited, block_id, page, text): each cited id with its block, or with
    the first fragment of a block of that id; null where neither is known."""
    each = claims.select("claim_id", "doc_id", F.posexplode("ids").alias("pos", "cited"))
    own = blocks.select("doc_id", F.col("block_id").alias("cited"), F.struct("block_id", "page", "text").alias("own"))
    part = blocks.where("parent_id is not null").groupBy("doc_id", F.col("parent_id").alias("cited")).agg(F.min(F.struct("block_id", "page", "text")).alias("part"))
    rows = each.join(own, ["doc_id", "cited"], "left").join(part, ["doc_id", "cited"], "left").withColumn("b", F.coalesce("own", "part"))
    return rows.select("claim_id", "doc_id", F.col("pos").cast("long").alias("pos"), "cited", "b.block_id", "b.page", "b.text")


def _evidence(claims: DataFrame, blocks: DataFrame) -> DataFrame:
    """All claims with `e`: their evidence (pos, page, text, cited) in cited order; null where there is none."""
    found = cited(claims, blocks).where("block_id is not null")
    each = found.groupBy("claim_id", "doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "page", "text", "cited"))).alias("e"))
    return claims.join(each, ["claim_id", "doc_id"], "left").withColumn("texts", F.coalesce(F.col("e.text"), F.array().cast("array<string>")))


def with_evidence(claims: DataFrame, blocks: DataFrame) -> DataFrame:
    """All claims with texts and distinct pages of their evidence, in cited order; empty where there is none."""
    return _evidence(claims, blocks).withColumn("pages", F.coalesce(F.array_distinct("e.page"), F.array().cast("array<bigint>"))).drop("e")


def is_supported(value: Column, texts: Column) -> Column:
    """One cited block supports the value, or several together have exactly its words."""
    joined = F.array_join(texts, " ")
    return F.exists(texts, lambda t: P.supported(value, t, alnum_fold)) | F.contains(alnum_fold(joined), alnum_fold(value)) | P.same_words(value, joined)


def violations(claims: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows (claim_id, doc_id, code, detail): claims without ids, ids without block, values without support.

    Null and blank values claim nothing.
    """
    real = claims.where("value is not null and trim(value) <> ''")
    missing = real.where("ids is null or size(ids) = 0").select("claim_id", "doc_id", F.lit(MISSING).alias("code"), F.col("field").alias("detail"))
    unknown = cited(real, blocks).where("block_id is null").select("claim_id", "doc_id", F.lit(UNKNOWN).alias("code"), F.col("cited").cast("string").alias("detail"))
    known = with_evidence(real, blocks).where("size(ids) > 0 and size(texts) > 0")
    unsupported = known.where(~is_supported(F.col("value"), F.col("texts"))).select("claim_id", "doc_id", F.lit(UNSUPPORTED).alias("code"), F.col("value").alias("detail"))
    return missing.unionByName(unknown).unionByName(unsupported)


def crossed_spans(claims: DataFrame, spans: DataFrame) -> DataFrame:
    """Claims that cite a block of another entity's span. spans: doc_id, entity, block_id."""
    each = claims.select("claim_id", "doc_id", "entity", F.explode("ids").alias("block_id"))
    theirs = spans.withColumnRenamed("entity", "owner")
    return each.join(theirs, ["doc_id", "block_id"]).where("owner <> entity").select("claim_id", "doc_id", F.lit(CROSSED).alias("code"), F.col("owner").cast("string").alias("detail")).distinct()


def sanitised(claims: DataFrame, blocks: DataFrame) -> DataFrame:
    """Claims whose ungrounded values are null, with `dropped`."""
    rows = with_evidence(claims, blocks)
    good = F.coalesce(is_supported(F.col("value"), F.col("texts")), F.lit(False))
    return rows.withColumns({"dropped": F.col("value").isNotNull() & ~good, "value": F.when(good, F.col("value"))}).drop("texts", "pages")


def repaired(claims: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows (claim_id, doc_id, old_ids, new_ids, step): ids kept if they support the value; else cut down
    to known ones; else the first block of the document, by its id, that supports the value; else none.

    The search brings a document's open claims to each of its blocks and judges every such pair, after
    a cheap look for what each kind of support needs: the folded value, its year, the shape of a phone
    number, or the longest of its words. Blocks are never repeated, neither by words nor by claims.
    """
    rows = _evidence(claims, blocks).withColumn("good", F.coalesce(is_supported(F.col("value"), F.col("texts")), F.lit(False)))
    rows = rows.withColumn("known", F.col("e.cited")).drop("e", "texts")
    own = P.words(F.col("value"))
    longest = F.when(F.size(own) >= 2, F.element_at(F.array_sort(own, lambda a, b: F.length(a) - F.length(b)), -1))
    needs = F.struct("claim_id", "value", alnum_fold(F.col("value")).alias("folded"), F.when(F.col("value").rlike(r"^\d{4}"), F.substring("value", 1, 4)).alias("year"), F.col("value").rlike(P.PHONE_SHAPE).alias("phone"), longest.alias("word"))
    wanted = rows.where("not good and value is not null").groupBy("doc_id").agg(F.collect_list(needs).alias("seek"))
    there = blocks.select("doc_id", "block_id", "text").join(wanted, "doc_id").withColumns({"lower": F.lower("text"), "folded": alnum_fold(F.col("text"))})
    part = lambda c: F.contains(F.col("folded"), c["folded"])
    some = F.filter("seek", lambda c: part(c) | F.contains(F.col("text"), c["year"]) | c["phone"] | F.contains(F.col("lower"), c["word"]))
    hits = there.select("doc_id", "block_id", "text", "folded", F.explode(some).alias("c")).where(part(F.col("c")) | P.supported(F.col("c.value"), F.col("text"), alnum_fold))
    first = hits.groupBy(F.col("c.claim_id").alias("claim_id"), "doc_id").agg(F.min("block_id").alias("hit"))
    rows = rows.join(first, ["claim_id", "doc_id"], "left")
    some = F.col("known")
    step = F.when(F.col("good") & (F.size(some) == F.size("ids")), "kept").when(F.col("good"), "known_only").when(F.col("hit").isNotNull(), "found").otherwise("removed")
    rows = rows.withColumn("step", step)
    empty = F.slice("ids", 1, 0)
    new = F.when(F.col("step") == "kept", F.col("ids")).when(F.col("step") == "known_only", some).when(F.col("step") == "found", F.array("hit")).otherwise(empty)
    return rows.select("claim_id", "doc_id", F.col("ids").alias("old_ids"), new.alias("new_ids"), "step")


def coverage(blocks: DataFrame, owned: DataFrame) -> DataFrame:
    """Rows doc_id, blocks, covered, unassigned, unknown, duplicate, share: how far a tree owns its source.

    owned: doc_id, node_id, block_id.
    """
    owners = owned.groupBy("doc_id", "block_id").agg(F.count_distinct("node_id").alias("owners"))
    both = blocks.select("doc_id", "block_id", F.lit(1).alias("own")).join(owners, ["doc_id", "block_id"], "full_outer")
    covered = F.count_if(F.col("own").isNotNull() & F.col("owners").isNotNull())
    n = F.count("own")
    return both.groupBy("doc_id").agg(n.alias("blocks"), covered.alias("covered"), F.count_if(F.col("owners").isNull()).alias("unassigned"), F.count_if(F.col("own").isNull()).alias("unknown"), F.count_if(F.col("owners") > 1).alias("duplicate"), F.round(covered / n * 100, 2).alias("share"))


def tree_violations(nodes: DataFrame) -> DataFrame:
    """Rows (doc_id, node_id, code) of a tree: parents that are unknown, levels that aren't the parent's
    plus one, children on a page before their parent's. nodes: doc_id, node_id, parent_id, level, page."""
    up = nodes.select("doc_id", F.col("node_id").alias("parent_id"), F.col("level").alias("plevel"), F.col("page").alias("ppage"))
    rows = nodes.join(up, ["doc_id", "parent_id"], "left")
    codes = F.array_compact(
        F.array(
            F.when(F.col("parent_id").isNotNull() & F.col("plevel").isNull(), F.lit("UNKNOWN_PARENT")),
            F.when(F.col("parent_id").isNull() & (F.col("level") != 1), F.lit("ROOT_LEVEL")),
            F.when(F.col("level") != F.col("plevel") + 1, F.lit("LEVEL_JUMP")),
            F.when(F.col("page") < F.col("ppage"), F.lit("PAGE_ORDER")),
        )
    )
    return rows.select("doc_id", "node_id", F.explode(codes).alias("code"))


def list_runs(lines: DataFrame, kind: Column) -> DataFrame:
    """Neighbouring lines of one kind as runs: doc_id, kind, first, n, texts in order."""
    w = W.partitionBy("doc_id").orderBy("line_no")
    rows = lines.withColumn("kind", kind)
    rows = rows.withColumn("__new", F.when(F.lag("kind").over(w).eqNullSafe(F.col("kind")), 0).otherwise(1))
    rows = rows.withColumn("run", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy("doc_id", "run", "kind").agg(F.min("line_no").alias("first"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("x")).select("doc_id", "kind", "first", "n", F.col("x.text").alias("texts"))


def section_scores(lines: DataFrame, patterns: dict[str, list[tuple[str, float]]], *, confidence: float = 0.70, margin: float = 0.15) -> DataFrame:
    """The section each document's lines speak for: weights summed over lines, accepted if the best has
    0.70 of the total and leads by 0.15 of it; ties to the name. Null otherwise."""
    each = [F.sum(sum((F.when(F.col("text").rlike(p), w).otherwise(0.0) for p, w in own[1:]), F.when(F.col("text").rlike(own[0][0]), own[0][1]).otherwise(0.0))).alias(name) for name, own in patterns.items()]
    sums = lines.groupBy("doc_id").agg(*each)
    ranked = F.array_sort(F.array(*[F.struct((-F.col(n)).alias("s"), F.lit(n).alias("name")) for n in patterns]))
    rows = sums.withColumn("r", ranked).withColumn("total", sum((F.col(n) for n in list(patterns)[1:]), F.col(next(iter(patterns)))))
    best, second = -F.col("r")[0]["s"], -F.col("r")[1]["s"]
    sure = (F.col("total") > 0) & (best >= confidence * F.col("total")) & (best - second >= margin * F.col("total"))
    return rows.select("doc_id", F.when(sure, F.col("r")[0]["name"]).alias("section"), best.alias("score"), "total")


def contained(texts: DataFrame, items: DataFrame, *, k: int = 16) -> DataFrame:
    """Pairs (doc_id, item_id) of folded texts `t` that contain the folded items `p`.

    Any place of an item of 2k-1 characters or more holds one of the text's k-grams at a multiple of
    k, so those are looked up in the items' k-grams (an equi-join), and what is found is compared.
    Shorter items, of which a query set has few, are held against all texts. An empty item is in all.
    """
    grams = F.transform(F.sequence(F.lit(0), F.length("p") - k), lambda i: F.struct(i.alias("at"), F.substring(F.col("p"), i + 1, F.lit(k)).alias("gram")))
    long = items.where(F.length("p") >= 2 * k - 1)
    # an item's first k grams are enough: one of them stands at a multiple of k in the text
    index = long.select("item_id", F.explode(F.slice(grams, 1, k)).alias("g")).select("item_id", "g.gram").distinct()
    own = F.regexp_extract_all("t", F.lit(f"(?s).{{{k}}}"), F.lit(0))  # the grams at multiples of k, in one pass
    probes = texts.select("doc_id", F.explode(own).alias("gram"))
    pairs = probes.join(index, "gram").select("doc_id", "item_id").distinct()
    exact = pairs.join(texts, "doc_id").join(long, "item_id").where(F.contains("t", "p")).select("doc_id", "item_id")
    short = items.where(F.length("p") < 2 * k - 1)
    return exact.union(texts.join(short, F.contains("t", "p")).select("doc_id", "item_id"))
