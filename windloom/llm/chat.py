"""Chat formatting of reply trees with DataFrame functions alone.

A message has a conversation, a node, its parent's node (null: a root) and a score. Iterative
self-joins double the distance of each node's ancestor pointer, which gives every node its depth and
the score of its path; leaves are the ends of root-to-leaf paths. Branches of a conversation are
ranked by the mean score of their path, and the same pointers, from the longest to the shortest,
enumerate the messages of each chosen path. Both take as many rounds as the logarithm of the depth.

Template of a turn: <turn>ROLE</role>TEXT</turn> and a newline. Inside roles and texts a backslash
is doubled and each control string gets one after its "<", so none of them is left and the original
comes back by dropping one backslash before any character. The loss mask is a list of spans
(start, length; code points of the formatted string) over the texts of assistant turns.

A null text or role is empty; a parent that is missing makes a root; messages on a cycle belong to
no path. Null conversations are one conversation, with a null id. Repeated nodes of a conversation
are numbered anew in `linear`; in trees the first by (text, role) counts. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windloom.session import landed

#: The control strings, and the longest chain (2^MAX_DOUBLINGS messages).
TURN, ROLE_END, TURN_END = "<turn>", "</role>", "</turn>"
MAX_DOUBLINGS = 40


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in (TURN, ROLE_END, TURN_END):
        out = F.replace(out, F.lit(mark), F.lit("<\\" + mark[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def linear(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Turns in order as a reply tree without branches: each turn answers the one before."""
    order = Window.partitionBy(F.col(conv)).orderBy(F.col(turn).asc_nulls_first(), F.col(role).asc_nulls_first(), F.col(text).asc_nulls_first())
    node = F.row_number().over(order)
    return rows.select(F.col(conv).alias("conv"), node.alias("node"), F.when(node > 1, node - 1).alias("parent"), F.lit(0.0).alias("score"), F.col(role).alias("role"), F.col(text).alias("text"))


def _keyed(nodes: DataFrame) -> DataFrame:
    """Conversations under a key that is never null, roots and missing parents without a parent."""
    key = F.concat(F.when(F.col("conv").isNull(), "n").otherwise("v"), F.coalesce(F.col("conv").cast("string"), F.lit("")))
    first = F.row_number().over(Window.partitionBy("key", "node").orderBy(F.col("text").asc_nulls_first(), F.col("role").asc_nulls_first()))
    rows = nodes.where("node is not null").withColumn("key", key).withColumn("__n", first).where("__n = 1").drop("__n")
    known = rows.select(F.col("key").alias("k"), F.col("node").alias("p"))
    joined = rows.join(known.hint("merge"), (F.col("key") == F.col("k")) & (F.col("parent") == F.col("p")), "left")
    return joined.select("key", "conv", "node", F.col("p").alias("parent"), F.coalesce("score", F.lit(0.0)).cast("double").alias("score"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def paths(nodes: DataFrame, best: int = 1) -> DataFrame:
    """(path_rank, conv, leaf, path_score, depth, role, text): the messages of the best paths of each conversation."""
    base = landed(_keyed(nodes), "messages")
    # Pointers to the ancestor 2^i messages up; depth and score of what lies between.
    now = landed(base.select("key", "node", F.col("parent").alias("up"), F.lit(0).alias("depth"), F.col("score").alias("total")), "pointers")
    now = now.withColumn("depth", F.when(F.col("up").isNull(), 0).otherwise(1))
    jumps = []
    for _ in range(MAX_DOUBLINGS):
        if not now.where("up is not null").take(1):
            break
        jumps.append(now.select("key", "node", "up").where("up is not null"))
        far = now.select(F.col("key").alias("k"), F.col("node").alias("n"), F.col("up").alias("far"), F.col("depth").alias("more"), F.col("total").alias("rest"))
        active = now.where("up is not null")  # the others have reached a root
        both = active.join(far.hint("merge"), (F.col("key") == F.col("k")) & (F.col("up") == F.col("n")), "left")
        grown = landed(both.select("key", "node", F.col("far").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), (F.col("total") + F.coalesce("rest", F.lit(0.0))).alias("total")).unionByName(now.where("up is null")), "pointers")
        if len(jumps) > 1 and not grown.join(now.where("up is null").select("key", "node").hint("merge"), ["key", "node"], "left_anti").where("up is null").take(1):
            now = grown  # nothing more reaches a root: the rest is on cycles
            break
        now = grown
    reached = now.where("up is null")
    leaves = reached.join(base.where("parent is not null").select("key", F.col("parent").alias("node")).distinct().hint("merge"), ["key", "node"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("path_score"), F.desc("depth"), "node"))
    chosen = leaves.select("key", F.col("node"), "depth", (F.col("total") / (F.col("depth") + 1)).alias("path_score")).withColumn("path_rank", rank).where(F.col("path_rank") <= best)
    on_path = landed(chosen.select("key", F.col("node").alias("leaf"), "path_rank", "path_score", "node"), "paths")
    for jump in reversed(jumps):
        up = on_path.join(jump.hint("merge"), ["key", "node"]).select("key", "leaf", "path_rank", "path_score", F.col("up").alias("node"))
        on_path = landed(on_path.unionByName(up), "paths")
    depths = reached.select("key", "node", "depth")
    return on_path.join(depths.hint("merge"), ["key", "node"]).join(base.select("key", "conv", "node", "role", "text").hint("merge"), ["key", "node"])


def format_paths(nodes: DataFrame, best: int = 1, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, path_rank, path_score, formatted, loss_spans): each chosen path as one conversation."""
    turns = paths(nodes, best).withColumn("head", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(ROLE_END))).withColumn("body", escape(F.col("text")))
    turns = turns.withColumn("piece", F.concat("head", "body", F.lit(TURN_END + "\n")))
    before = Window.partitionBy("key", "leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.char_length("piece")).over(before), F.lit(0)) + F.char_length("head")
    span = F.when(F.col("role") == loss_role, F.struct(at.cast("long").alias("start"), F.char_length("body").cast("long").alias("length")))
    turns = turns.select("key", "leaf", "conv", "path_rank", "path_score", F.struct("depth", "piece", span.alias("span")).alias("turn"))
    whole = turns.groupBy("key", "leaf").agg(F.first("conv").alias("conv_id"), F.first("path_rank").alias("path_rank"), F.first("path_score").alias("path_score"), F.array_sort(F.collect_list("turn")).alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda x: x["piece"]), "")
    spans = F.transform(F.filter("turns", lambda x: x["span"].isNotNull()), lambda x: x["span"])
    return whole.select("conv_id", "path_rank", "path_score", formatted.alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    ended = F.split(formatted, TURN_END + "\n", -1)
    halves = F.transform(F.slice(ended, 1, F.size(ended) - 1), lambda x: F.split(F.substr(x, F.lit(len(TURN) + 1)), ROLE_END, -1))
    return F.transform(halves, lambda x: F.struct(unescape(F.get(x, 0)).alias("role"), unescape(F.get(x, 1)).alias("text")))


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
