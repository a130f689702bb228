"""Clusters of profiles that resemble each other, directly or through others.

Two profiles resemble each other when either one, taken as reference, is matched by the other.
Clusters are the connected components of that relation, so the result does not depend on the order
in which profiles are read.  Components need no list of all pairs, and none is made.

Components chain: their ends may be unlike.  ``pivot_clusters`` does not: every member resembles its pivot.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wireloom.functions.binary import hex_lower
from wireloom.operators import blocks
from wireloom.operators.matching import (
    Band,
    matching_pairs,
    profile_means,
    reference_table,
    unbounded_references,
)
from wireloom.plans.numbering import number_by_hash
from wireloom.plans.staging import stage

CLUSTERING = Band(probe_on_top=True)

#: Profiles every other one is compared with in the first leader round, how many times more in each round after it,
#: the most of one round, and the most rounds.  Leaders of a round go through the driver.
LEADERS = 32
LEADER_GROWTH = 4
MOST_LEADERS = 4096
LEADER_ROUNDS = 6

#: Links per leader (one is its own) below which more rounds do not pay.
WORTHWHILE = 4


def copy_edges(profile_table: DataFrame) -> DataFrame:
    """``(src, dst)``: profiles with identical values, each linked to the smallest of them."""
    # 128 bits stand for the values; copies combine before the shuffle.
    keyed = profile_table.select(
        hex_lower(F.col("rowkey")).alias("node"), F.unhex(F.md5(F.to_json("features_value"))).alias("digest")
    )
    least = keyed.groupBy("digest").agg(F.min("node").alias("src"))
    return keyed.join(least, "digest").select("src", F.col("node").alias("dst"))


def leader_edges(table: DataFrame, rounds: int = LEADER_ROUNDS, count: int = LEADERS) -> DataFrame:
    """Links of profiles ``(node, means, top)`` to a few leaders, a bounded number of links each.

    Each round takes profiles that no leader has reached yet, up to ``count`` and then more of them, and compares every
    profile with them, so profiles that resemble many others are joined up without looking at pairs.
    Only a head start: what it finds are true links, what it misses is found afterwards.
    """
    kind = "src string, dst string"
    edges = table.sparkSession.createDataFrame([], kind)
    vectors = table.select("node", "means", "top")
    waiting = vectors
    for _ in range(rounds):
        chosen = waiting.orderBy(F.xxhash64("node"), "node").limit(count).toArrow()
        if not chosen.num_rows:
            break
        links = stage(vectors.mapInArrow(blocks.links_in(chosen, CLUSTERING.rule), kind), "links")
        edges = edges.unionByName(links)
        if links.count() <= WORTHWHILE * count:
            break  # few resemble each other; the equi-join is the shorter way
        reached = edges.select(F.col("dst").alias("node")).unionByName(edges.select(F.col("src").alias("node")))
        tried = table.sparkSession.createDataFrame(chosen.select(["node"]))
        waiting = waiting.join(reached.unionByName(tried).distinct(), "node", "left_anti")
        count = min(LEADER_GROWTH * count, max(count, MOST_LEADERS))
    return edges


def resemblance_labels(profile_table: DataFrame) -> DataFrame:
    """``node, component``: profiles joined up by resemblance, and copies by equality.

    Copies are represented once.  Leaders join up the dense parts; then only pairs across the parts
    found so far are looked for, and whatever links two parts joins them.
    """
    copies = stage(copy_edges(profile_table), "copies")
    values = profile_table.select(
        hex_lower(F.col("rowkey")).alias("node"), "features_name", "features_value"
    ).join(copies.where(F.col("src") == F.col("dst")).select(F.col("src").alias("node")), "node")
    table = stage(
        values.select("node", profile_means(F.col("features_value")).alias("means")).join(
            reference_table(values, "node").withColumnRenamed("ref", "node"), "node"
        ),
        "vectors",
    )
    parts = connected_components(table, leader_edges(table))
    labelled = stage(table.join(parts, "node").withColumnRenamed("component", "part"), "parts")
    across = matching_pairs(
        labelled.withColumnRenamed("node", "probe"),
        labelled.withColumnRenamed("node", "ref"),
        CLUSTERING,
        across="part",
        joining=True,
    )
    # A reference that matches everything links all profiles; one of them is enough for that.
    hub = unbounded_references(table.withColumnRenamed("node", "ref")).agg(F.min("ref").alias("n"))
    everywhere = table.select(hub.scalar().alias("src"), F.col("node").alias("dst"))
    links = across.select(F.col("probe").alias("src"), F.col("ref").alias("dst")).unionByName(
        everywhere.where(F.col("src").isNotNull())
    )
    part_of = parts.withColumnRenamed("component", "part")
    merged = (
        links.join(part_of.withColumnsRenamed({"node": "src", "part": "a"}), "src")
        .join(part_of.withColumnsRenamed({"node": "dst", "part": "b"}), "dst")
        .where(F.col("a") != F.col("b"))
        .select(F.col("a").alias("src"), F.col("b").alias("dst"))
        .distinct()
    )
    whole = connected_components(
        parts.select(F.col("component").alias("node")).distinct(), merged
    ).withColumnsRenamed({"node": "part"})
    labels = part_of.join(whole, "part").select("node", "component")
    return copies.join(labels.withColumnRenamed("node", "src"), "src").select(
        F.col("dst").alias("node"), "component"
    )


def pivot_clusters(profile_table: DataFrame, seed: int = 42) -> DataFrame:
    """``rowkey, pivot, cluster_id``: profiles taken in a seeded order; each resembles its pivot, no two pivots each other.

    A profile no pivot before it resembles is a pivot; the others join the first pivot that they resemble.  Leaders are the first
    profiles still waiting, so rounds of them give the pivots of dense parts without a list of pairs; the rest
    has few links, and of these every profile that is first among its neighbours is a pivot, round by round.
    """
    keyed = profile_table.select(
        hex_lower(F.col("rowkey")).alias("node"), "features_name", "features_value",
        F.unhex(F.md5(F.to_json("features_value"))).alias("digest"),
    ).withColumn("place", F.md5(F.concat(F.lit(f"{seed}|"), F.col("node"))))
    # Copies have the same neighbours; the first in order stands for them.
    first = keyed.groupBy("digest").agg(F.min_by("node", "place").alias("src"))
    copies = stage(keyed.select("node", "digest").join(first, "digest").select("src", F.col("node").alias("dst")), "copies")
    values = keyed.join(copies.where("src = dst").select(F.col("src").alias("node")), "node", "left_semi")
    tops = reference_table(values, "node").withColumnRenamed("ref", "node")
    waiting = stage(
        values.select("node", "place", profile_means(F.col("features_value")).alias("means")).join(tops, "node"), "waiting"
    )
    found, count = [], LEADERS
    for _ in range(LEADER_ROUNDS):
        chosen = waiting.orderBy("place").limit(count).toArrow()
        if not chosen.num_rows:
            break
        pivots = blocks.alone(chosen, CLUSTERING.rule)
        kind = StructType([*waiting.schema.fields]).add("pivot", "string")
        tried = stage(waiting.mapInArrow(blocks.nearest_in(pivots, CLUSTERING.rule), kind), "tried")
        found.append(tried.where(F.col("pivot").isNotNull()).select("node", "pivot"))
        waiting = tried.where(F.col("pivot").isNull()).drop("pivot")
        if found[-1].count() <= WORTHWHILE * pivots.num_rows:
            break
        count = min(LEADER_GROWTH * count, max(count, MOST_LEADERS))
    pairs = matching_pairs(waiting.withColumnRenamed("node", "probe"), waiting.withColumnRenamed("node", "ref"), CLUSTERING)
    one_way = pairs.where("probe <> ref").toDF("a", "b")
    both = one_way.unionByName(one_way.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    places = waiting.select("node", "place")
    links = stage(
        both.join(places.toDF("a", "a_place"), "a").join(places.toDF("b", "b_place"), "b"), "links"
    )
    alive, covered = links, [links.select("a").limit(0)]
    while not alive.isEmpty():
        firsts = alive.groupBy("a", "a_place").agg(F.min("b_place").alias("next")).where("a_place < next")
        firsts = stage(firsts.select("a"), "pivots")
        near = stage(alive.join(firsts, "a", "left_semi").select(F.col("b").alias("a")).distinct(), "near-pivots")
        covered.append(near)
        gone = near.unionByName(firsts)
        left = alive.join(gone, "a", "left_anti").join(gone.withColumnRenamed("a", "b"), "b", "left_anti")
        alive = stage(left.select(*links.columns), "links")
    members = reduce(DataFrame.unionByName, covered).distinct()
    own = places.join(members.withColumnRenamed("a", "node"), "node", "left_anti").select("node", F.col("node").alias("pivot"))
    to_pivots = links.join(members, "a", "left_semi").join(members.withColumnRenamed("a", "b"), "b", "left_anti")
    theirs = to_pivots.groupBy("a").agg(F.min_by("b", "b_place").alias("pivot")).withColumnRenamed("a", "node")
    every = stage(reduce(DataFrame.unionByName, [*found, own, theirs]), "pivots-of-profiles")
    numbered = number_by_hash(every.where("node = pivot").select("pivot"), "pivot", "cluster_id")
    return (
        copies.join(every.withColumnRenamed("node", "src"), "src")
        .join(numbered, "pivot")
        .select(F.unhex("dst").alias("rowkey"), F.unhex("pivot").alias("pivot"), "cluster_id")
    )


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, component``: the smallest node reachable over ``edges (src, dst)``.

    Each round takes the smallest label among neighbours, then the label's own label, and writes the
    result, so lineage stays short and a lost executor costs one round at most.  Labels only fall, so
    the rounds end.
    """
    both = stage(
        edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))),
        "edges",
    )
    labels = stage(nodes.select("node", F.col("node").alias("component")), "labels")
    if both.isEmpty():
        return labels
    while True:
        smallest = (
            both.join(labels, both["src"] == labels["node"])
            .groupBy("dst")
            .agg(F.min("component").alias("near"))
        )
        lowered = labels.join(smallest, labels["node"] == smallest["dst"], "left").select(
            "node", "component", F.least("component", "near").alias("lower")
        )
        own = lowered.select(F.col("node").alias("lower"), F.col("lower").alias("root"))
        jumped = stage(
            lowered.join(own, "lower", "left").select(
                "node", F.least("lower", "root").alias("component"), F.col("component").alias("old")
            ),
            "labels",
        )
        labels = jumped.select("node", "component")
        if jumped.where(F.col("component") != F.col("old")).isEmpty():
            return labels


def cluster_profiles(profile_table: DataFrame) -> DataFrame:
    """``rowkey, cluster_id``: ids count up in the order of each cluster's smallest row key."""
    labels = stage(resemblance_labels(profile_table), "labels")
    numbered = number_by_hash(
        labels.where(F.col("node") == F.col("component")).select("component"),
        "component",
        "cluster_id",
    )
    return labels.join(numbered, "component").select(
        F.unhex("node").alias("rowkey"), "cluster_id"
    )


def cluster_members(clusters: DataFrame) -> DataFrame:
    """``cluster_id, rowkey, members``: every member with the size of its cluster."""
    sizes = clusters.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("members"))
    return clusters.join(sizes, "cluster_id").select("cluster_id", "rowkey", "members")
