"""Preference formatting: shared prompt, two masked completions.

Chosen and rejected conversations of a pair share their longest common prefix of turns (equal role and
text, nulls equal to nulls). The prefix is rendered once as the prompt, the rest of either side as
its completion. A mask lists the character ranges of a completion that carry loss: what the
assistant says and its end mark. Only DataFrame operations.

Turns stay rows until the end: repeated ones are neighbours in a pair's order, the first one that differs is found by a join on (pair, place) and a
minimum, and ranges come from running sums. Only the finished pieces of a pair meet in one row, which is its result, so a pair that
holds most turns costs a sort, not a comparison of all its turns.

Defined results: turns are ordered by turn number (null first), then role, then text, so repeated numbers
have a fixed order; a turn repeated in all three counts once; rows without a pair id belong to no
conversation and are left out; null roles and texts are rendered as empty; a side that is missing has no
turns, so the prompt is empty; equal sides give two empty completions; empty tables give no pair; other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronomesh.llm.store import staged

LEARNED_ROLE = "assistant"


def _head(turn: DataFrame) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(turn["role"], F.lit("")), F.lit("|>\n"))


def _said(turn: DataFrame) -> Column:
    return F.concat(F.coalesce(turn["text"], F.lit("")), F.lit("<|end|>"))


def _turns(turns: DataFrame, side: str, pair_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(side, pair_id, role, text, p) of the distinct turns; p is a turn's place in its conversation."""
    rows = turns.filter(F.col(pair_col).isNotNull()).select(
        F.lit(side).alias("side"), F.col(pair_col).alias("pair_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"),
        F.col(text_col).alias("text"))
    order = Window.partitionBy("pair_id").orderBy("turn", "role", "text")  # nulls first
    # equal turns are neighbours; only the first of them has a place
    again = F.row_number().over(order) > 1
    for c in ("turn", "role", "text"):
        again &= F.col(c).eqNullSafe(F.lag(c).over(order))
    placed = rows.withColumn("again", again)
    return placed.withColumn("p", F.count_if(~F.col("again")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).filter("not again").drop(
        "turn", "again")


def shared_turns(good: DataFrame, bad: DataFrame) -> DataFrame:
    """(pair_id, k): the number of leading turns in which the two conversations of a pair agree. Digests travel, not texts."""
    same = F.md5(F.concat_ws("|", F.when(F.col("role").isNull(), "n").otherwise(F.concat(F.octet_length("role"), F.lit("="), F.col("role"))),
                             F.when(F.col("text").isNull(), "n").otherwise(F.concat(F.lit("="), F.col("text")))))
    a, b = good.select("pair_id", "p", same.alias("_a")), bad.select("pair_id", "p", same.alias("_b"))
    agree = F.col("_a") == F.col("_b")
    first = F.min(F.when(~F.coalesce(agree, F.lit(False)), F.col("p")))
    return a.join(b, ["pair_id", "p"], "full").groupBy("pair_id").agg(
        F.coalesce(first - 1, F.max("p")).cast("int").alias("k"))


def rendered(turns: DataFrame, role: str) -> DataFrame:
    """Adds to every turn its text ``s`` and, where ``role`` speaks, the range of what it says: start:end in the rendered
    part (``shared`` or not) of its side, in code points, end exclusive."""
    whole = F.concat(_head(turns), _said(turns), F.lit("\n"))
    before = Window.partitionBy("pair_id", "side", "shared").orderBy("p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = turns.withColumn("s", whole).withColumn("stop", F.sum(F.length("s")).over(before))
    low = F.col("stop") - F.length("s") + F.length(_head(turns))
    return out.withColumn("range", F.when(F.col("role") == role, F.concat_ws(":", low.cast("string"), (F.col("stop") - 1).cast("string"))))


def _together(column: str, which: Column, mark: str) -> Column:
    """The values of the chosen turns, in order, as one text."""
    listed = F.array_sort(F.collect_list(F.when(which & F.col(column).isNotNull(), F.struct("p", F.col(column).alias("v")))))
    return F.array_join(F.transform(listed, lambda x: x["v"]), mark)


def preference_pairs(chosen: DataFrame, rejected: DataFrame, pair_col: str = "pair_id", turn_col: str = "turn", role_col: str = "role",
                     text_col: str = "text", learned_role: str = LEARNED_ROLE) -> DataFrame:
    """(pair_id, n_prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask), one row a pair."""
    columns = (pair_col, turn_col, role_col, text_col)
    good = staged(_turns(chosen, "chosen", *columns), "chosen-turns")
    bad = staged(_turns(rejected, "rejected", *columns), "rejected-turns")
    k = staged(shared_turns(good, bad), "shared-turns")
    both = good.unionByName(bad).join(k, "pair_id").withColumn("shared", F.col("p") <= F.col("k"))
    both = both.repartition("pair_id")  # for the running sums and the final grouping alike
    turns = rendered(both, learned_role)
    own = {side: (F.col("side") == side) & ~F.col("shared") for side in ("chosen", "rejected")}
    return turns.groupBy("pair_id").agg(
        F.max("k").alias("n_prompt_turns"), _together("s", (F.col("side") == "chosen") & F.col("shared"), "").alias("prompt"),
        *[c for side, which in own.items() for c in (_together("s", which, "").alias(side), _together("range", which, ",").alias(f"{side}_mask"))])
