"""Connected components of a graph given as a table of links, without gathering any component.

Large-star and small-star rounds: each turns the links of a node towards its least neighbour, using
one aggregate and one join on the node, until nothing changes. Rounds grow with the logarithm of
the component's size. Each round is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronograft.storage import forget, keep


#: Links of a node beyond which it may be met by broadcast, and the most such nodes.
HUB, HUBS = 1000, 1000


def _met(near: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """``near`` with the row of ``least`` for each link's node ``u``.

    A hub's links would all be dealt to one task. Nodes with more than 2 * total / HUBS of the at most
    2 * total rows are fewer than HUBS, so these are broadcast and their links stay where they are.
    """
    hub = F.col("n") > max(HUB, 2 * total // HUBS + 1)
    hubs = F.broadcast(least.where(hub))
    rest = near.join(hubs.select("node"), near["u"] == F.col("node"), "left_anti")
    return near.join(hubs, near["u"] == hubs["node"]).union(rest.join(least.where(~hub), F.col("u") == F.col("node")))


def _star(links: DataFrame, large: bool, total: int) -> DataFrame:
    """Links (u, v) turned towards the least of each node's neighbours and the node itself."""
    if large:
        near = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"), F.count("*").alias("n"))
    least = least.select("node", F.least("node", "m").alias("m"), "n")
    turned = _met(near, least, total)
    if large:
        turned = turned.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        turned = turned.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("node").alias("u"), F.col("m").alias("v")))
    return turned.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v) that isn't its component's least node itself."""
    now = keep(links.where("u <> v").distinct(), "links")
    seal, total = None, now.count()
    while True:
        turned = keep(_star(now, True, total), "links")
        # links never grow in number, so the count of the round before bounds the hubs of both stars
        then = keep(_star(turned, False, total), "links")
        forget(turned)
        # the table of links as a multiset-free digest: equal tables end the rounds
        new = then.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        forget(now)
        now, total = then, new[0]
        if new == seal:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seal = new
