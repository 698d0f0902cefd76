"""Turn restrictions: parsing relations, chaining their ways, judging turns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIRECTIONS = ("left_turn", "right_turn", "straight_on", "u_turn", "entry", "exit")


def parse(relations: DataFrame) -> DataFrame:
    """relation_id, forbidden, direction, from_way, to_way, via (array), via_is_node.

    ``relations``: id, kind (such as ``no_left_turn``), members (array of role,
    type, ref).  ``no_entry`` may have several from ways and ``no_exit`` several
    to ways: each pair gives a row; other kinds with several are left out.
    """
    prefix, direction = F.regexp_extract("kind", "^(no|only)_", 1), F.regexp_replace("kind", "^(no|only)_", "")

    def refs(role: str, kind: str | None = None):
        return F.transform(F.filter("members", lambda m: (m["role"] == role) & (F.lit(True) if kind is None else m["type"] == kind)), lambda m: m["ref"])

    rows = relations.select(F.col("id").alias("relation_id"), prefix.alias("prefix"), direction.alias("direction"), refs("from", "way").alias("f"), refs("to", "way").alias("t"), refs("via", "way").alias("vw"), refs("via", "node").alias("vn"))
    good = rows.where(F.col("prefix").isin("no", "only") & F.col("direction").isin(*DIRECTIONS) & (F.size("f") > 0) & (F.size("t") > 0))
    good = good.where(((F.size("f") == 1) | (F.col("direction") == "entry")) & ((F.size("t") == 1) | (F.col("direction") == "exit")))
    good = good.where(((F.size("vn") == 1) & (F.size("vw") == 0)) | ((F.size("vn") == 0) & (F.size("vw") > 0)))
    return good.select("relation_id", (F.col("prefix") == "no").alias("forbidden"), "direction", F.explode("f").alias("from_way"), "t", F.when(F.size("vn") == 1, F.col("vn")).otherwise(F.col("vw")).alias("via"), (F.size("vn") == 1).alias("via_is_node")).select(
        "relation_id", "forbidden", "direction", "from_way", F.explode("t").alias("to_way"), "via", "via_is_node"
    )


def judge_turns(turns: DataFrame, rules: DataFrame) -> DataFrame:
    """turns (from_way, node, to_way, u_turn) with ``allowed``.

    Rules (from_way, via node, to_way, forbidden) meet turns on (from_way,
    node).  A rule for exactly this turn decides; without one, an only-rule for
    another turn forbids.  U-turns obey rules for exactly them alone.
    """
    keyed = rules.where("via_is_node").select("from_way", F.get("via", 0).alias("node"), F.col("to_way").alias("ruled"), "forbidden")
    met = turns.join(keyed, ["from_way", "node"], "left")
    exact = F.col("ruled") == F.col("to_way")
    by = met.groupBy("from_way", "node", "to_way", "u_turn").agg(
        F.max(F.when(exact, F.col("forbidden"))).alias("exact"), F.max(F.when(~exact & ~F.col("forbidden"), F.lit(True))).alias("other")
    )
    free = F.when(F.col("exact").isNotNull(), ~F.col("exact")).when(F.col("u_turn"), F.lit(True)).otherwise(F.col("other").isNull())
    return by.select("from_way", "node", "to_way", "u_turn", free.alias("allowed"))


def chained(pieces: DataFrame) -> DataFrame:
    """group, pos, piece, reverse: way pieces (group, piece, first, last) in an order in which ends meet.

    Each group is an ordered chain join of a few pieces, done in its own task;
    pieces that don't connect get no position.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        left = rows.sort_values("piece").to_dict("records")
        out, end = [], None
        while left:
            at = next((n for n, r in enumerate(left) if end is None or end in (r["first"], r["last"])), None)
            if at is None:
                break
            r = left.pop(at)
            turned = end is not None and r["first"] != end
            out.append((r["group"], len(out), r["piece"], turned))
            end = r["first"] if turned else r["last"]
        out += [(r["group"], None, r["piece"], False) for r in left]
        return pd.DataFrame(out, columns=["group", "pos", "piece", "reverse"]).astype({"pos": "Int64"})

    return pieces.groupBy("group").applyInPandas(run, "group long, pos long, piece long, reverse boolean")
