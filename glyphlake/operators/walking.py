"""Reading within a roster: token scores followed along the options' prefix tree.

The tree is a table of edges (node, token, child); a node is its prefix, so two options share the nodes of their common
beginning. An edge with the end token closes an option. The walk keeps a frontier: a few paths for each cell, extended step by
step by a join with the cell's scores of that step and with the edges, so only allowed tokens go on. Each step is stored, so
plans don't grow; there are as many steps as the longest option has tokens, and one for the end.

Rules: an unfinished path may only take a child of its node; a leaf only the end; a prefix off the tree only the end. A
finished path keeps its total and competes with the others. The best `beam` of a cell stay, by total, then by path. A cell
whose scores leave no allowed token is read as empty. Empty options aren't in the tree. Null scores count as absent, a token
scored twice in a step counts once, at its best.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

END, JOIN = "</s>", "\x1f"


def tree(options: DataFrame, tokens: str = "tokens") -> DataFrame:
    """options(tokens array<string>) -> distinct edges node, token, child (null for the end)."""
    at = F.explode(F.sequence(F.lit(0), F.size(tokens)))
    rows = options.where(F.size(tokens) > 0).select(F.col(tokens).alias("t"), at.alias("i"))
    node = lambda n: F.array_join(F.slice("t", 1, n), JOIN)
    more = F.col("i") < F.size("t")
    token = F.when(more, F.try_element_at("t", F.col("i") + 1)).otherwise(F.lit(END))
    return rows.select(node(F.col("i")).alias("node"), token.alias("token"), F.when(more, node(F.col("i") + 1)).alias("child")).distinct()


def allowed(prefixes: DataFrame, edges: DataFrame, key: str, tokens: str = "tokens") -> DataFrame:
    """prefixes(key, tokens) -> key, next: the tokens that may follow, sorted; the end alone off the tree."""
    follow = edges.groupBy("node").agg(F.array_sort(F.collect_set("token")).alias("next"))
    rows = prefixes.select(key, F.array_join(tokens, JOIN).alias("node"))
    return rows.join(follow, "node", "left").select(key, F.coalesce("next", F.array(F.lit(END))).alias("next"))


def walk(scores: DataFrame, options: DataFrame, beam: int = 4, tokens: str = "tokens") -> DataFrame:
    """scores(cell, step, token, score), steps from 0 -> cell, text (tokens joined by a space), total, steps: the best path."""
    edges = stored(tree(options, tokens), "edges")
    longest = edges.agg(F.max(F.when(F.col("child").isNotNull(), F.size(F.split("child", JOIN)))).alias("m")).first()["m"] or 0
    heard = stored(scores.where("score IS NOT NULL").groupBy("cell", "step", "token").agg(F.max("score").alias("score")), "scores")
    kind = heard.schema["score"].dataType
    front = heard.select("cell").distinct().select("cell", F.lit("").alias("node"), F.lit("").alias("path"), F.lit(0).cast(kind).alias("total"), F.lit(False).alias("done"))
    best = Window.partitionBy("cell").orderBy(F.desc("total"), "path")
    for step in range(longest + 1):
        now = heard.where(F.col("step") == step).drop("step")
        moved = front.where("NOT done").join(now, "cell").join(edges, ["node", "token"])
        path = F.when(F.col("child").isNull(), F.col("path")).otherwise(F.col("child"))
        moved = moved.select("cell", F.coalesce("child", F.lit("")).alias("node"), path.alias("path"), (F.col("total") + F.col("score")).cast(kind).alias("total"), F.col("child").isNull().alias("done"))
        # a cell has beam x tokens rows at most
        both = front.where("done").unionByName(moved)
        front = stored(both.withColumn("k", F.row_number().over(best)).where(F.col("k") <= beam).drop("k"), "front")
    top = front.where("done").withColumn("k", F.row_number().over(best)).where("k = 1")
    cells = heard.select("cell").distinct()
    return cells.join(top, "cell", "left").select("cell", F.coalesce(F.replace("path", F.lit(JOIN), F.lit(" ")), F.lit("")).alias("text"), "total", F.when(F.col("path").isNotNull(), F.size(F.split("path", JOIN))).alias("steps"))
