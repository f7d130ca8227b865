"""Chat formatting of reply trees, in DataFrame operations only.

Messages point at the message they answer. Iterative self-joins with doubling steps enumerate
root-to-leaf paths: after step k each message knows its ancestor 2^k up and the sum of scores on
the way. Leaves are ranked by their path's mean score, and the chosen paths are walked back down
the same tables, so that rows stay in proportion to the messages and not to depth times messages.

Format of a turn: `### ` role `: ` text `</turn>` and a line end. Inside roles and texts a
backslash is doubled, `##` becomes `#\\#` and `</` becomes `<\\/`; in roles `:` becomes `\\:` too.
No control string can occur inside an escaped text, and dropping each backslash that escapes
gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .tables import forget, written

OPEN, CLOSE = "### ", "</turn>\n"


def escape(text: Column) -> Column:
    for raw, safe in (("\\", "\\\\"), ("##", "#\\#"), ("</", "<\\/")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\:"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def chain(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Turn-ordered rows as a reply tree: each row answers the row before it.

    Rows that share a turn follow each other by role, then text. Null turns come first, null
    roles and texts count as empty.
    """
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = F.row_number().over(W.partitionBy("conv").orderBy("turn", "role", "text")).cast("long")
    rows = rows.withColumn("node", n)
    return rows.select("conv", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def paths(messages: DataFrame, *, top: int = 1) -> DataFrame:
    """Rows (conv, path_rank, depth, node) of the `top` best root-to-leaf paths of each conversation.

    messages: conv, node (unique in its conversation), parent (null or unknown: a root), score
    (null: 0). A leaf's rank is by mean score on its path, ties by longer path, then smaller
    leaf. Messages on a cycle hang from no root and are on no path.
    """
    spark = messages.sparkSession
    light = messages.select("conv", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    known = light.select(F.col("conv").alias("k"), F.col("node").alias("parent"))
    ups = light.join(known, light["conv"].eqNullSafe(known["k"]) & (light["parent"] == known["parent"]), "left").select(light["conv"], light["node"], known["parent"].alias("up"), "score")
    ups = ups.select("conv", "node", "up", F.lit(1).cast("long").alias("steps"), F.col("score").alias("total"))
    levels: list[tuple[DataFrame, str]] = [written(ups, "jump")]
    n_rows = None
    while True:
        now = levels[-1][0]
        open_rows = now.where(F.col("up").isNotNull()).count()
        n_rows = now.count() if n_rows is None else n_rows
        if not open_rows or 2 ** (len(levels) - 1) > n_rows:
            break
        far = now.select(F.col("conv").alias("k"), F.col("node").alias("at"), F.col("up").alias("up2"), F.col("steps").alias("steps2"), F.col("total").alias("total2"))
        # only paths that have not reached their root go on; the others are carried along unjoined
        open_, closed = now.where(F.col("up").isNotNull()), now.where(F.col("up").isNull())
        joined = open_.join(far, open_["conv"].eqNullSafe(far["k"]) & (open_["up"] == far["at"]), "left")
        levels.append(written(closed.unionByName(joined.select("conv", "node", F.col("up2").alias("up"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps"), (F.col("total") + F.coalesce("total2", F.lit(0.0))).alias("total"))), "jump"))
    last = levels[-1][0].where(F.col("up").isNull())  # what is still open lies on a cycle
    inner = light.select(F.col("conv").alias("k"), F.col("parent").alias("at")).where("at is not null").distinct()
    leaves = last.join(inner, last["conv"].eqNullSafe(inner["k"]) & (last["node"] == inner["at"]), "left_anti")
    best = F.row_number().over(W.partitionBy("conv").orderBy(F.desc(F.col("total") / F.col("steps")), F.desc("steps"), "node"))
    walk = leaves.withColumn("path_rank", best).where(F.col("path_rank") <= top).select("conv", "path_rank", F.col("steps").alias("depth"), "node")
    used = [p for _, p in levels]
    for jump, _ in reversed(levels[:-1] or levels):
        # all nodes found so far, and those that lie this level's step above them
        step = jump.select(F.col("conv").alias("k"), F.col("node").alias("at"), "up", "steps").where("up is not null")
        above = walk.join(step, walk["conv"].eqNullSafe(step["k"]) & (walk["node"] == step["at"])).select("conv", "path_rank", (F.col("depth") - F.col("steps")).alias("depth"), F.col("up").alias("node"))
        walk, at = written(walk.unionByName(above), "walk")
        used.append(at)
    forget(spark, *used[:-1])
    return walk


def format_paths(messages: DataFrame, chosen: DataFrame, *, learn: str = "assistant") -> DataFrame:
    """One row per path: conv, path_rank, segments array<struct<text, loss>> and formatted.

    The concatenated segment texts are the formatted conversation; loss marks the escaped texts of
    `learn`'s turns, each a segment of its own.
    """
    body = escape(F.col("text"))
    turn = F.array(
        F.struct(F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit(": ")).alias("text"), F.lit(False).alias("loss")),
        F.struct(body.alias("text"), (F.col("role") == F.lit(learn)).alias("loss")),
        F.struct(F.lit(CLOSE).alias("text"), F.lit(False).alias("loss")),
    )
    m = messages.select(F.col("conv").alias("k"), F.col("node").alias("at"), turn.alias("turn"))
    rows = chosen.join(m, chosen["conv"].eqNullSafe(m["k"]) & (chosen["node"] == m["at"])).select("conv", "path_rank", F.struct("depth", "turn").alias("turn"))
    whole = rows.groupBy("conv", "path_rank").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    whole = whole.select("conv", "path_rank", F.flatten("turns.turn").alias("segments"))
    return whole.withColumn("formatted", F.array_join("segments.text", ""))


def read_back(formatted: DataFrame) -> DataFrame:
    """What a reader gets from the output alone: turns array<struct<role, text>> and loss_text."""
    pieces = F.filter(F.split("formatted", F.lit(CLOSE)), lambda p: p != "")
    mark = r"(?s)^### ([^\\:]*+(?:\\.[^\\:]*+)*+): (.*)$"  # possessive: no recursion, whatever the length
    turns = F.transform(pieces, lambda p: F.struct(unescape(F.regexp_extract(p, mark, 1)).alias("role"), unescape(F.regexp_extract(p, mark, 2)).alias("text")))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return formatted.withColumns({"turns": turns, "loss_text": loss})
