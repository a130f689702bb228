"""Merkle manifest of a dataset by lag and lead windows, in Spark expressions only.

A row's leaf is the digest of its columns.  The leaves of a group (a source) in order of id form a tree of
fan-out three, its root is the group's subroot, and the subroots in order of group form the tree above them.

Per level, ``lag`` and ``lead`` at fixed offsets give every first leaf of a node the digests of the nodes
beside it; the node's slot in its run and the run's length mask those that belong to other runs, and rows
that start a run hash the parent.  A node of level l starts at a multiple of 3**l, so its neighbours start 3**l
and 2 * 3**l rows away, and all levels of a block share one partitioning and one sort.  A block is
``3**LEVELS`` leaves, so no window holds more rows than that however large a group is; the roots of the blocks
are the leaves of the next round, a two-thousandth as many.

Positions in a group come from one range partitioning by (group, id, leaf, row), which cuts a hot group and
repeated rows alike: a row's place in its partition plus the rows of the group in the partitions before it.
Only numbers of levels come to the driver.  Texts are read once, for their digests.

Defined results: a null group comes first, null ids come first in a group; rows of equal id are ordered by leaf,
and repeated rows are leaves of their own with equal digests; a long text is one value; a group of one row has
its leaf as subroot, a single group has its subroot as root; siblings of a node without any are the empty
string; an empty table gives no rows.  Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wireloom.llm.common import sized_broadcast, stage

FAN_OUT = 3
#: Levels of one round; a block has ``FAN_OUT ** LEVELS`` leaves.
LEVELS = 7
#: Rows of (digest, id) that one range partition should have at most.
ROWS_PER_RANGE = 2_000_000
#: Bytes of one sibling pair of a path, for the check before a broadcast.
_PAIR_BYTES = 160


def digest(*parts: Column | str) -> Column:
    """Lowercase hex SHA-256 of strings put together."""
    return F.sha2(F.concat(*parts), 256)


def leaf(*values: Column) -> Column:
    """Digest of values as UTF-8 byte count, colon and value each, a hyphen for null."""
    texts = (v.cast("string") for v in values)
    return digest(
        *(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)
    )


def fold(of: Column, path: Column) -> Column:
    """Root that a leaf has with the siblings of ``path`` (array of left, right)."""
    return F.aggregate(path, of, lambda below, at: digest(at["left"], below, at["right"]))


def proof(path: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda at: F.concat(at["left"], at["right"])), ""), 256)


def _placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``_pos``, the place in its group ``_g`` by ``order``, and ``_n``, the size of the group."""
    nodes = nodes.withColumn("_row", F.monotonically_increasing_id())
    shuffled = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(shuffled, -(-nodes.count() // ROWS_PER_RANGE))
    by = ["_g", *order, "_row"]
    ranged = nodes.repartitionByRange(ranges, *by).sortWithinPartitions(*by)
    # Now the number of the partition and the place in it.
    ranged = stage(ranged.withColumn("_row", F.monotonically_increasing_id()), "merkle-ranges")
    part = F.shiftright("_row", 33).alias("_part")
    parts = ranged.groupBy("_g", part).agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    group = Window.partitionBy("_g")
    before = F.sum("_rows").over(group.orderBy("_part")) - F.col("_rows")
    starts = stage(
        parts.select("_g", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(group).alias("_n")),
        "merkle-starts",
    )
    starts = sized_broadcast(starts, size=F.length("_g") + 24)
    placed = ranged.withColumn("_part", part).join(starts, ["_g", "_part"])
    return placed.withColumn("_pos", F.col("_row") + F.col("_shift")).drop("_row", "_part", "_shift")


def _climbed(nodes: DataFrame, levels: int) -> DataFrame:
    """Nodes (_g, _pos, _n, _d): adds ``_block``, ``_path`` inside the block, and the block's ``_top`` at its first node."""
    size = FAN_OUT**levels
    pos, n = F.col("_pos"), F.col("_n")
    rows = nodes.withColumn("_block", F.floor(pos / size))
    block = Window.partitionBy("_g", "_block").orderBy("_pos")
    rows = rows.withColumn("_d0", F.col("_d"))
    beside = []
    for level in range(levels):
        step = FAN_OUT**level
        d = F.col(f"_d{level}")
        lags = {f"_lag{i}": F.lag(d, i * step).over(block) for i in range(1, FAN_OUT)}
        leads = {f"_lead{i}": F.lead(d, i * step).over(block) for i in range(1, FAN_OUT)}
        nodes_here = F.floor((n + (step - 1)) / step)
        slot = F.floor(pos / step) % FAN_OUT
        run = F.least(F.lit(FAN_OUT), nodes_here - F.floor(pos / (step * FAN_OUT)) * FAN_OUT)
        # A lone node is the root of its group; only rows that start a node have neighbours that do.
        climbs = (nodes_here > 1) & (pos % step == 0)
        none = F.lit("")
        left = F.concat(*(F.when(slot >= i, F.col(f"_lag{i}")).otherwise(none) for i in reversed(range(1, FAN_OUT))))
        right = F.concat(*(F.when(run - slot > i, F.col(f"_lead{i}")).otherwise(none) for i in range(1, FAN_OUT)))
        parent = F.when(nodes_here > 1, digest(d, F.col(f"_beside{level}.right"))).otherwise(d)
        rows = (
            rows.withColumns(lags | leads)
            .withColumn(f"_beside{level}", F.when(climbs, F.struct(left.alias("left"), right.alias("right"))))
            .withColumn(f"_d{level + 1}", F.when(pos % (step * FAN_OUT) == 0, parent))
            .drop(*lags, *leads, f"_d{level}")
        )
        beside.append(f"_beside{level}")
    # What a node has beside it holds for all leaves below it, up to the next node of the level.
    upto = block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    path = F.array_compact(F.array(*(F.last(c, ignorenulls=True).over(upto) for c in beside)))
    return rows.withColumn("_path", path).withColumnRenamed(f"_d{levels}", "_top").drop(*beside)


def _tree(nodes: DataFrame, order: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """Rounds of staged nodes with paths, lowest first, and the root ``_top`` of each group ``_g``."""
    nodes, rounds = _placed(nodes, order), []
    while True:
        largest = nodes.agg(F.max("_n")).first()[0] or 1
        levels = next(i for i in range(1, LEVELS + 1) if i == LEVELS or FAN_OUT**i >= largest)
        rounds.append(stage(_climbed(nodes, levels), "merkle-nodes"))
        size = FAN_OUT**levels
        nodes = rounds[-1].where(F.col("_top").isNotNull()).select(
            "_g", F.col("_block").alias("_pos"), F.ceil(F.col("_n") / size).alias("_n"), F.col("_top").alias("_d")
        )
        if size >= largest:
            return rounds, nodes.select("_g", F.col("_d").alias("_top"))


def _with_paths(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """The lowest nodes with whole paths; ``above`` has the rest of the path of each group's root."""
    above = above.withColumn("_block", F.lit(0).cast("long"))
    for i, climbed in reversed(list(enumerate(rounds))):
        above = sized_broadcast(
            stage(above.withColumnRenamed("_path", "_more"), "merkle-paths"),
            size=F.length("_g") + 300 + _PAIR_BYTES * F.size("_more"),
        )
        path = F.concat("_path", "_more").alias("_path")
        joined = climbed.join(above, ["_g", "_block"])
        if i == 0:
            return joined.withColumn("_path", path).drop("_more")
        above = joined.select("_g", F.col("_pos").alias("_block"), path, "_subroot", "_root")


def manifest(
    docs: DataFrame,
    id: str = "doc_id",
    group: str = "source",
    columns: Iterable[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    also: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One row per row of ``docs``: id, leaf, subroot, root, path (array of left, right), and the columns ``also``.

    ``columns`` make the leaf, in this order; ``also`` is computed from ``docs`` on the one pass that reads texts.
    """
    also = dict(also or {})
    name = F.col(f"`{group}`").cast("string")
    # Bytes in order, null before the empty string.
    g = F.when(name.isNull(), F.lit(b"\x00")).otherwise(F.concat(F.lit(b"\x01"), name.cast("binary")))
    extra = {f"_also{i}": c for i, c in enumerate(also.values())}
    leaves = docs.select(
        g.alias("_g"), F.col(f"`{id}`").alias("_id"), leaf(*(F.col(f"`{c}`") for c in columns)).alias("_d"),
        *(c.alias(n) for n, c in extra.items()),
    )
    rounds, subroots = _tree(stage(leaves, "merkle-leaves"), ["_id", "_d"])
    every = subroots.select(F.lit(b"").alias("_g"), F.col("_g").alias("_id"), F.col("_top").alias("_d"))
    over, root = _tree(stage(every, "merkle-subroots"), ["_id"])
    root = root.select(F.col("_top").alias("_root"), "_g").withColumn("_path", F.array().cast(over[0].schema["_path"].dataType))
    of_groups = _with_paths(over, root.withColumn("_subroot", F.lit(None).cast("string")))
    above = of_groups.select(F.col("_id").alias("_g"), "_path", F.col("_d").alias("_subroot"), "_root")
    return _with_paths(rounds, above).select(
        F.col("_id").alias(id), F.col("_d").alias("leaf"), F.col("_subroot").alias("subroot"),
        F.col("_root").alias("root"), F.col("_path").alias("path"),
        *(F.col(n).alias(a) for n, a in zip(extra, also, strict=True)),
    )
