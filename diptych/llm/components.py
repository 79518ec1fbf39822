"""Connected components of a graph given by its links, by alternating star steps; and groups dealt into blocks.

A large step points each node's greater neighbours at its smallest neighbour, a small step each node's smaller ones; the
links never leave their component and end as stars around its smallest node.  Each step is an aggregation, which combines
before it shuffles, and a join of links with one row a node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import checkpointed

#: A key is hot that has over a share of 1 in so many of all rows; there are at most as many such keys.
HOT = 1000


def looked_up(rows: DataFrame, keys: DataFrame, key: str | list[str], size: str, total: int) -> DataFrame:
    """The rows with the columns of their key in ``keys``, which has one row a key and its number of rows in ``size``.

    ``total`` is the number of rows.  Keys with over a thousandth of it, a thousand at most, are broadcast, so that their
    rows stay where they are; the rows of all others meet their key in a shuffle.
    """
    hot = F.col(size) * HOT > F.lit(max(total, HOT))
    few = keys.where(hot)
    by_broadcast = rows.join(F.broadcast(few), key)
    return by_broadcast.unionByName(rows.join(F.broadcast(few.select(key)), key, "left_anti").join(keys.where(~hot), key))


def _settled(links: DataFrame) -> bool:
    """Whether all links are of stars: each node has one neighbour that is smaller, and that one has none."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(links.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and component (the smallest node that links reach) for each node of a link with another; a and b are longs.

    Null ends, links of a node with itself and repeated links say nothing.  Raises if ``most_rounds`` do not end it; a round
    about halves the longest chain, so that takes a chain of 2**60.  A node of very many links is left to Spark's splitting
    of skewed joins, as its neighbours' side has one row a node.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = checkpointed(links)
    for _ in range(most_rounds):
        if _settled(links):
            break
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b")
        links = checkpointed(small.where("a <> b").distinct())
    else:
        raise RuntimeError(f"links are not settled after {most_rounds} rounds")
    stars = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


def paired(members: DataFrame, group: str, node: str, size: str, block: int, shared: int) -> DataFrame:
    """The members of groups, a row for each pair of blocks i <= j that a member is in, with place (its block) and unit.

    A group of ``size`` members is dealt into blocks of about ``block`` by a hash of the node.  Each pair of blocks is a unit
    of work of its own; groups of one block share ``shared`` units.
    """
    blocks = F.ceil(F.col(size) / block).cast("int")
    out = members.withColumn("blocks", blocks).withColumn("place", F.pmod(F.xxhash64(node, group), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(F.col("place"), k).alias("i"), F.greatest(F.col("place"), k).alias("j")))
    out = out.withColumn("pair", F.explode(pairs)).withColumns({"i": F.col("pair.i"), "j": F.col("pair.j")}).drop("pair")
    return out.withColumn("unit", F.when(F.col("blocks") > 1, F.xxhash64(group, "i", "j")).otherwise(F.pmod(F.xxhash64(group), F.lit(shared)))).drop("blocks")
