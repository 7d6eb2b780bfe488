"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.tables import written


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the smallest node of its component among the links from a to b."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        np.minimum.at(label, before, label)  # the old root learns its nodes' new root
        label = label[label]
        if (label == before).all():
            break
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def contracted(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Fewer links with the same components, from what one task holds; no more than most links are held at once."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0

    def out() -> pa.RecordBatch:
        a, b = forest(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["u", "v"])

    for batch in batches:
        if batch.num_rows:
            held.append((batch.column("u").to_numpy(zero_copy_only=False), batch.column("v").to_numpy(zero_copy_only=False)))
            n += batch.num_rows
        if n >= most:
            yield out()
            held, n = [], 0
    if held:
        yield out()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node of the links (u, v: long) between different nodes with the smallest node it reaches.

    Tasks first replace their links by forests of the same components. Then each round a node takes the smallest root of its neighbours, roots pass that on to their nodes, and roots are
    replaced by their own roots, which takes about as many rounds as the longest path has binary digits; labels only fall,
    so the rounds end. Each round is written to the shared folder, so plans stay short; no link is gathered
    on the driver.
    """
    upward = lambda links: links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    fewer = lambda links: upward(links.mapInArrow(contracted, "u long, v long"))
    # before and after links meet their copies: few links, which then lie in one part, are done with that
    links = written(fewer(fewer(edges.where("u <> v").select("u", "v")).distinct()), "links")
    links = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    labels = written(links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("v")).select("node", F.least("node", "v").alias("root")), "labels")
    while True:
        near = links.join(labels.select(F.col("node").alias("v"), F.col("root").alias("near")), "v").groupBy(F.col("u").alias("node")).agg(F.min("near").alias("near"))
        seen = labels.join(near, "node").select("node", "root", F.least("root", "near").alias("low"))
        told = seen.groupBy(F.col("root").alias("node")).agg(F.min("low").alias("told"))
        # written, so that the look-up of roots joins plain rows and adaptive execution may split a root that many nodes have
        low = written(seen.join(told, "node", "left").select("node", "root", F.least("low", F.coalesce("told", "low")).alias("low")), "low")
        jump = low.select(F.col("node").alias("low"), F.col("low").alias("lower"))
        fresh = written(low.join(jump, "low", "left").select("node", F.coalesce("lower", "low").alias("root"), (F.coalesce("lower", "low") != F.col("root")).alias("moved")), "labels")
        labels = fresh.select("node", "root")
        if not fresh.where("moved").limit(1).count():
            return labels


def cluster_ids(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(idx, cluster_id) of every node: components numbered from 0 by their smallest idx, single nodes included.

    Numbers come from counts of roots per range of idx, so no window spans all clusters.
    """
    roots = components(edges).withColumnRenamed("node", "idx")
    labelled = nodes.select("idx").join(roots, "idx", "left").select("idx", F.coalesce("root", "idx").alias("root"))
    heads = labelled.where("idx = root").select("idx", F.floor(F.col("idx") / 65536).alias("part"))
    parts = heads.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offset = parts.select("part", before.alias("offset"))
    number = F.col("offset") + F.row_number().over(Window.partitionBy("part").orderBy("idx")) - 1
    ids = heads.join(offset, "part").select(F.col("idx").alias("root"), number.alias("cluster_id"))
    return labelled.join(ids, "root").select("idx", "cluster_id")
