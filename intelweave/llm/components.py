"""Connected components of a graph given as a table of links, by alternating stars.

Each round links all larger neighbours of a node to its smallest one (large
star), then its smaller neighbours likewise (small star).  Both are a minimum
by key, combined on the map side, and a join back, so a node with very many
links is never gathered.  Each round is written to the shared folder, and the
links are stars when a round changes nothing.

Defined results: repeated links count once, links to oneself or with a null end
not at all; no links give no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _round(links: DataFrame) -> DataFrame:
    """links: hi > lo, distinct."""
    both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
        links.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    least = large.groupBy("hi").agg(F.min("lo").alias("m"))
    small = large.join(least, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return small.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b: any comparable type); root is the smallest node."""
    links = links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    links = materialize(links.filter("hi <> lo").distinct(), "links")
    mark = None
    while True:
        seen = links.agg(F.count("*"), F.expr("bit_xor(xxhash64(hi, lo))"), F.expr("bit_xor(xxhash64(lo, hi, 1))")).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
        links = materialize(_round(links), "links")
    roots = links.select("lo").distinct()
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(
        roots.select(F.col("lo").alias("node"), F.col("lo").alias("root"))
    )


def local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node reachable from each of n nodes over the links a-b, within one task."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        keep = root[a] != root[b]
        a, b = a[keep], b[keep]
        if np.array_equal(before, root) and not keep.any():
            break
    return root
