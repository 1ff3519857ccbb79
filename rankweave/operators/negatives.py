"""Negative items for training pairs: hashed draws, refused where the user has seen the item, in rounds over what was refused.

A draw is a function of the seed, the pair, its copy and the round, so it is the same on any partitioning, in any order, after any retry. Each round
joins the open draws with the seen pairs; only refused ones go on, and they are stored before the next round. A user who has
seen the share s of all items keeps about s of the draws open per round, so nearly complete users would need many: what is open after `rounds`
rounds gets the exact answer instead, the j-th item that its user hasn't seen, j being a last draw below their number. Both ways are uniform.

Items are 0 to n_items - 1. Defined cases: a pair whose user has seen every item has no negative (null) and stays in the result; null ids are left out; repeated pairs
are copies, each with a draw of its own; seen items outside the range refuse nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.operators.prep import stored_once

#: How many hexadecimal digits of the digest make a draw: a number below 2^60.
DIGITS = 15


def drawn(seed: int, epoch: int, *parts: Column | str, below: Column | int) -> Column:
    """A number from 0 to `below` - 1 by the digest of seed, epoch and parts."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(str(epoch)), *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]))
    return F.pmod(F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("long"), below if isinstance(below, Column) else F.lit(below).cast("long"))


def negative_items(pairs: DataFrame, seen: DataFrame, n_items: int, seed: int = 42, epoch: int = 0, rounds: int = 6) -> DataFrame:
    """(user_id, item_id, copy, negative) of each pair (user_id, item_id). Eager: what a round refuses is counted."""
    if n_items < 1 or rounds < 0:
        raise ValueError("there is one item at least, and no negative number of rounds")
    kinds = dict(pairs.dtypes)
    rows = pairs.where(F.col("user_id").isNotNull() & F.col("item_id").isNotNull()).groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("_n"))
    rows = rows.select("user_id", "item_id", F.explode(F.sequence(F.lit(0), (F.col("_n") - 1).cast("int"))).alias("copy"))
    known = seen.select("user_id", F.col("item_id").cast("long").alias("_seen")).where(F.col("_seen").between(0, n_items - 1)).distinct()
    full = known.groupBy("user_id").agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") >= n_items).select("user_id", F.lit(True).alias("_full"))
    rows = stored_once(rows.join(full, "user_id", "left"))
    out = rows.where(F.col("_full")).select("user_id", "item_id", "copy", F.lit(None).cast("long").alias("negative"))
    left = rows.where(F.col("_full").isNull()).drop("_full")
    for r in range(rounds):
        tried = left.withColumn("negative", drawn(seed, epoch, "user_id", "item_id", "copy", F.lit(r), below=n_items))
        # a draw is refused if the pair of its user and itself was seen
        marked = known.select("user_id", F.col("_seen").alias("negative"), F.lit(True).alias("_refused"))
        tried = stored_once(tried.join(marked, ["user_id", "negative"], "left"))
        out = out.unionByName(tried.where(F.col("_refused").isNull()).select("user_id", "item_id", "copy", "negative"))
        left = tried.where(F.col("_refused")).select("user_id", "item_id", "copy")
        if left.isEmpty():
            break
    else:
        out = out.unionByName(_nth_unseen(left, known, n_items, seed, epoch, rounds))
    return out.select(F.col("user_id").cast(kinds["user_id"]).alias("user_id"), F.col("item_id").cast(kinds["item_id"]).alias("item_id"), "copy", "negative")


def _nth_unseen(left: DataFrame, known: DataFrame, n_items: int, seed: int, epoch: int, rounds: int) -> DataFrame:
    """The j-th unseen item is j plus the number of seen items s_0 < s_1 < ... with s_i - i <= j: a running count over draws and seen items of a user."""
    own = known.join(left.select("user_id").distinct(), "user_id", "left_semi")
    by_item = Window.partitionBy("user_id").orderBy("_seen")
    shifted = own.select("user_id", (F.col("_seen") - (F.row_number().over(by_item) - 1)).alias("_j"), F.lit(1).alias("_one"))
    number = own.groupBy("user_id").agg(F.count(F.lit(1)).alias("_c"))
    draws = left.join(number, "user_id", "left")
    j = drawn(seed, epoch, "user_id", "item_id", "copy", F.lit(rounds), below=F.lit(n_items).cast("long") - F.coalesce("_c", F.lit(0)))
    both = shifted.unionByName(draws.select("user_id", "item_id", "copy", j.alias("_j"), F.lit(0).alias("_one")), allowMissingColumns=True)
    # at one j the seen items come first: they count for it
    running = Window.partitionBy("user_id").orderBy("_j", F.desc("_one")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("negative", F.col("_j") + F.sum("_one").over(running)).where(F.col("_one") == 0).select("user_id", "item_id", "copy", "negative")
