"""Quotation linking: conversations in reply order, without quoted text.

DataFrame functions only. A message's lines are parsed for nested quote marks; runs of
lines with one level are passages. Normalised passages are hashed, and each quoted one is
joined to the first message of its conversation that says it in its own words. Originals
are reduced to one row per conversation and hash before the join, so a passage that
thousands quote adds one row on that side and no pairs. Reply depth comes from pointer
doubling, a round for each doubling of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlab.llm.kernels import without
from pairlab.session import truncate_lineage

MARKS = "^(?:[ \\t]*>)+"
ATTRIBUTION = "^On .{1,300} wrote:$"
ADDED = ("body", "parent_turn", "root_turn", "depth", "n_quotes", "n_linked")


def normal(text: Column) -> Column:
    """Letters and digits in lower case, everything between them one space."""
    return F.btrim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " "))


def parse(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds _passages (level, position, hash) and body.

    A passage ends where the level changes or a blank line follows. The body is the text of
    level 0; a line of attribution right above a quote does not belong to it. Null texts have
    an empty body. Passages without letters and digits are left out.
    """
    line = lambda x: F.struct(
        F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), "[^>]", "")).alias("level"),
        F.btrim(F.regexp_replace(x, MARKS, ""), F.lit(" \t\r")).alias("says"),
    )
    t = df.withColumn("_l", F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), line))
    at = F.col("_l")
    leads = lambda x, i: (x["level"] == 0) & x["says"].rlike(ATTRIBUTION) & F.coalesce(F.get(at, i + 1)["level"] > 0, F.lit(False))
    t = t.withColumn("_l", F.transform(at, lambda x, i: F.struct(x["level"].alias("level"), F.when(leads(x, i), "").otherwise(x["says"]).alias("says"))))
    at = F.col("_l")
    opens = lambda i: (F.get(at, i)["says"] != "") & F.coalesce(
        (F.get(at, i - 1)["level"] != F.get(at, i)["level"]) | (F.get(at, i - 1)["says"] == ""), F.lit(True)
    )
    t = t.withColumn("_s", F.filter(F.sequence(F.lit(0), F.size(at) - 1), opens))
    starts = F.col("_s")
    passage = lambda s, k: F.struct(
        F.get(at, s)["level"].alias("level"),
        k.alias("at"),
        normal(F.array_join(F.transform(F.slice(at, s + 1, F.coalesce(F.get(starts, k + 1), F.size(at)) - s), lambda x: x["says"]), " ")).alias("says"),
    )
    t = t.withColumn("_p", F.filter(F.transform(starts, passage), lambda p: p["says"] != ""))
    own = F.transform(F.filter("_l", lambda x: x["level"] == 0), lambda x: x["says"])
    return t.withColumn("body", F.btrim(F.array_join(own, "\n"), F.lit("\n"))).drop("_l", "_s")


def link(parsed: DataFrame, conv: str, turn: str) -> DataFrame:
    """(conv, turn, parent_turn, n_linked) for every message with a quote that an earlier message says."""
    said = parsed.filter(F.col(conv).isNotNull() & F.col(turn).isNotNull()).select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), "_p", "body")
    quoted = said.filter(F.exists("_p", lambda p: p["level"] > 0)).select("conv", "turn", F.explode("_p").alias("p")).filter("p.level > 0")
    quoted = quoted.select("conv", "turn", F.struct("p.level", "p.at").alias("place"), F.md5("p.says").alias("hash"))
    # what can be quoted: own passages, own lines, the whole body
    lines = F.transform(F.split("body", "\n"), normal)
    own = F.array_union(F.transform(F.filter("_p", lambda p: p["level"] == 0), lambda p: p["says"]), F.array_append(lines, normal(F.col("body"))))
    first = said.select("conv", "turn", F.explode(own).alias("says")).filter("says <> ''")
    first = first.select("conv", F.md5("says").alias("hash"), "turn").groupBy("conv", "hash").agg(F.min("turn").alias("origin"))
    # an original nobody quotes is not needed
    links = quoted.join(first, ["conv", "hash"]).filter("origin < turn")
    return links.groupBy("conv", "turn").agg(F.min_by("origin", "place").alias("parent_turn"), F.count_distinct("place").alias("n_linked"))


def reply_depth(parents: DataFrame) -> DataFrame:
    """(conv, turn, root_turn, depth) of every message with a parent; parents are earlier, so there are no cycles."""
    state = truncate_lineage(parents.select("conv", "turn", F.col("parent_turn").alias("up"), F.lit(1).cast("bigint").alias("depth")).distinct())
    while not state.isEmpty():
        above = state.select("conv", F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2"))
        joined = state.join(above, ["conv", "up"], "left")
        done = truncate_lineage(
            joined.select("conv", "turn", F.coalesce("up2", "up").alias("up"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"), F.col("up2").isNotNull().alias("moved"))
        )
        state = done.drop("moved")
        if done.filter("moved").isEmpty():
            break
    return state.withColumnRenamed("up", "root_turn")


def thread(df: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """Every message with body, parent_turn, root_turn, depth, n_quotes and n_linked.

    Reply order of a conversation: root_turn, depth, turn. The parent is the original of the
    first linked passage of the lowest level. Messages without a linked quote are roots of
    depth 0 (parent_turn null); so are rows without conversation or turn. Rows that repeat
    conversation and turn share their links. Added columns replace ones of the same names.
    """
    df = without(df, *ADDED)
    parsed = parse(df, text)
    parents = truncate_lineage(link(parsed, conv, turn))
    up = parents.join(reply_depth(parents), ["conv", "turn"])
    out = parsed.join(up, (parsed[conv] == up["conv"]) & (parsed[turn] == up["turn"]), "left")
    return out.select(
        *[parsed[c] for c in df.columns],
        parsed["body"],
        up["parent_turn"],
        F.coalesce(up["root_turn"], parsed[turn]).alias("root_turn"),
        F.coalesce(up["depth"], F.lit(0).cast("bigint")).alias("depth"),
        F.size(F.filter(parsed["_p"], lambda p: p["level"] > 0)).cast("bigint").alias("n_quotes"),
        F.coalesce(up["n_linked"], F.lit(0).cast("bigint")).alias("n_linked"),
    )


def in_reply_order(threads: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Conversations one after another, each in reply order, over range partitions."""
    keys = [conv, "root_turn", "depth", turn]
    return threads.repartitionByRange(*keys).sortWithinPartitions(*keys)
