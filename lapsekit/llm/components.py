"""Connected components of a graph of links, by contraction: every node hands its links to its least neighbour's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapsekit.llm.shared import Work


def _moved(edges: DataFrame, to: DataFrame) -> DataFrame:
    """``edges`` between what their ends become by ``to`` (node, label), but for those inside one node. Ends that ``to``
    lacks stay. Plain shuffles on both sides, so that a node with very many links can be split."""
    for end in ("x", "y"):
        other = to.select(F.col("node").alias(end), F.col("label").alias("to"))
        edges = edges.join(other, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    return edges.filter("x != y").select("x", "y")


def _relabelled(labels: DataFrame, to: DataFrame) -> DataFrame:
    moved = labels.join(to.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left")
    return moved.select("node", F.coalesce("to", "label").alias("label"))


def components(links: DataFrame, work: Work, name: str = "components", labels: DataFrame | None = None) -> DataFrame:
    """``links``: x, y (long, any order, repeats allowed), a written table or as cheap to read again. Gives (node, label), the
    label the least node reachable. With the ``labels`` of other links it goes on from there and gives those of both.

    In each round every node becomes the least neighbour, itself included, of its least neighbour; links inside one
    node are dropped. Least neighbours are a partial aggregate. The greatest node of a component goes in every round, and
    where names are hashes most others do; a path in the order of its names takes half as many rounds as it has nodes.
    """
    small = {"free": False}
    edges = links.filter("x IS NOT NULL AND y IS NOT NULL AND x != y").select("x", "y")
    if labels is not None:
        edges = _moved(edges, labels).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
        edges = work.keep(edges, f"{name}-links0", **small)
    steps = []
    while not steps or not edges.isEmpty():
        both = edges.select(F.col("x").alias("node"), F.col("y").alias("other"))
        both = both.unionByName(edges.select(F.col("y").alias("node"), F.col("x").alias("other")))
        parents = both.groupBy("node").agg(F.min("other").alias("least"))
        parents = work.keep(parents.select("node", F.least("node", "least").alias("label")), f"{name}-parents{len(steps)}", **small)
        steps.append(parents)
        edges = _moved(_moved(edges, parents), parents).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
        edges = work.keep(edges.distinct(), f"{name}-links{len(steps)}", **small)
    found = steps[0]
    for parents in [steps[0], *(p for p in steps[1:] for _ in range(2))]:
        found = _relabelled(found, parents)
    if labels is not None:
        fresh = found.join(labels.select("node"), "node", "left_anti")
        found = _relabelled(labels, found).unionByName(fresh)
    return work.keep(found, f"{name}-labels", **small)
