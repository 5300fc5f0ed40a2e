"""Connected components of a table of links, as joins and groupings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import saved


def groups_of(links: DataFrame) -> DataFrame:
    """links (a, b) of one orderable type; (node, group) of every node of a link, group being the least node it is linked to, directly or not.

    In each round a node takes the least group among its own, its neighbours' and that of the node its group is named
    after, so that names travel twice as far each time. Rounds are written to the shared folder and end when no
    name changes. Links may repeat and go either way; those with a null are left out.
    """
    ways = links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct()
    ways = saved(ways, "links")
    names = saved(ways.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("group")).withColumnRenamed("a", "node"), "names")
    while True:
        near = ways.join(names, F.col("b") == F.col("node")).groupBy("a").agg(F.min("group").alias("near"))
        further = names.select(F.col("node").alias("named"), F.col("group").alias("further"))
        new = names.join(near, F.col("node") == F.col("a")).join(further, F.col("group") == F.col("named"))
        new = saved(new.select("node", F.least("group", "near", "further").alias("group"), (F.least("near", "further") < F.col("group")).alias("changed")), "names")
        if new.where("changed").isEmpty():
            return new.select("node", "group")
        names = new.select("node", "group")


def least_linked(name: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least number that each one is linked to, by links i, j and those that led to `name` so far (at first each one's own number)."""
    while len(i):
        low = np.minimum(name[i], name[j])
        new = name.copy()
        np.minimum.at(new, name[i], low)
        np.minimum.at(new, name[j], low)
        while (new[new] != new).any():
            new = new[new]
        name, open_ = new, new[i] != new[j]
        i, j = i[open_], j[open_]
    return name
