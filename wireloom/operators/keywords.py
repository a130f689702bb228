"""Payload keywords: byte trigrams that most payloads of a session contain, and their item sets.

Input payload rows: ``m, sid, direction, payload`` (binary).  Items are hex strings.  A transaction is
one session of one endpoint and direction, its items the trigrams kept for that session.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from wireloom.functions.binary import md5_bytes
from wireloom.functions.trigrams import item_base64, trigram_positions
from wireloom.plans.staging import stage

# Fixed values of the keyword search.
SHARE_LOW, SHARE_HIGH = 0.5, 1.0
MIN_SUPPORT = 0.2
SAMPLE_FRACTION = 0.05
KEYWORD_SETS = 10

#: Most payload bytes of one session that one task counts, and how many are counted in one step.
BYTES_PER_SESSION = 8 << 20
BYTES_PER_STEP = 2 << 20

#: Items of all transactions of a shard that one task mines.
ITEMS_PER_SHARD = 1_000_000

GROUP = ("m", "direction")
SESSION = ("m", "sid", "direction")


def complete_rows(payloads: DataFrame) -> DataFrame:
    """Rows that have an endpoint, a session and a direction."""
    m, sid, direction = (F.col(c).isNotNull() for c in SESSION)
    return payloads.where(m & sid & direction)


def endpoint_directions(payloads: DataFrame) -> DataFrame:
    return complete_rows(payloads).select(*GROUP).distinct()


def trigram_rows(payloads: DataFrame, *keys: str) -> DataFrame:
    """One row per trigram of each payload: ``keys, gram`` (three bytes).

    Positions are exploded and the bytes cut afterwards, which keeps the work in generated code.
    """
    body = F.col("payload")
    return (
        payloads.where(F.length(body) > 3)
        .select(*keys, body, F.explode(trigram_positions(body)).alias("at"))
        .select(*keys, F.substring(body, F.col("at"), F.lit(3)).alias("gram"))
    )


def keyword_shares(
    payloads: DataFrame,
    low: float = SHARE_LOW,
    high: float = SHARE_HIGH,
    most: int = BYTES_PER_SESSION,
) -> DataFrame:
    """``m, sid, direction, item, share``: occurrences over number of payloads, inside the band.

    A session's payloads meet in one task, which counts their trigrams: what moves is the payloads, not their trigrams, of
    which there are several times as many bytes.  Sessions with more than ``most`` bytes, and payloads that are text,
    are counted where they lie and their counts put together.
    """
    rows = complete_rows(payloads).where(F.col("payload").isNotNull()).select(*SESSION, "payload")
    if rows.schema["payload"].dataType != BinaryType():
        return _counted_shares(rows, low, high)
    sizes = rows.groupBy(*SESSION).agg(F.sum(F.length("payload").cast("bigint")).alias("size"))
    # At most (bytes / most) sessions.
    hot = stage(sizes.where(F.col("size") > most).select(*SESSION), "hot-sessions")
    named = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in SESSION)
    shares = (
        rows.join(F.broadcast(hot), list(SESSION), "left_anti")
        .repartition(*SESSION)
        .sortWithinPartitions(*SESSION)
        .mapInArrow(_share_counter(low, high), f"{named}, gram bigint, share double")
        .select(*SESSION, F.lpad(F.hex("gram"), 6, "0").alias("item"), "share")
    )
    if hot.isEmpty():
        return shares
    return shares.unionByName(_counted_shares(rows.join(F.broadcast(hot), list(SESSION)), low, high))


def _counted_shares(rows: DataFrame, low: float, high: float) -> DataFrame:
    """The shares by trigram rows, counted before they shuffle."""
    plds = rows.groupBy(*SESSION).agg(F.count(F.lit(1)).alias("plds"))
    counted = (
        trigram_rows(rows, *SESSION).groupBy(*SESSION, "gram").agg(F.count(F.lit(1)).alias("n"))
    )
    share = F.col("n") / F.col("plds")
    return (
        counted.join(plds, list(SESSION))
        .withColumn("share", share)
        .where(F.col("share").between(low, high))
        .select(*SESSION, F.hex("gram").alias("item"), "share")
    )


def _share_counter(low: float, high: float):
    """The function that counts the trigrams of whole sessions, from rows in their order.  Workers need no package."""

    def counted(table: pa.Table) -> Iterator[pa.RecordBatch]:
        n = table.num_rows
        new = np.zeros(n, dtype=bool)
        new[0] = True
        for name in SESSION:
            column = table[name].combine_chunks()
            differs = pc.not_equal(column.slice(1), column.slice(0, n - 1))
            new[1:] |= differs.to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(new)
        plds = np.diff(np.append(starts, n))
        body = table["payload"].cast(pa.large_binary()).combine_chunks()
        offsets = np.frombuffer(body.buffers()[1], np.int64)[body.offset : body.offset + n + 1]
        # The bytes of the rows in turn.
        data = np.frombuffer(body.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].astype(np.int64)
        ends = offsets - offsets[0]
        if len(data) <= 3:
            return
        grams = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
        # As many trigrams as bytes but three: places in the last three bytes of a payload start none.
        lengths = np.diff(ends)
        left = np.repeat(ends[1:], lengths) - np.arange(len(data))
        session = np.repeat(np.cumsum(new) - 1, lengths)
        kept = (left > 3)[:-2]
        keys, times = np.unique((session[:-2][kept] << 24) | grams[kept], return_counts=True)
        share = times / plds[keys >> 24]
        inside = (share >= low) & (share <= high)
        keys = keys[inside]
        if len(keys):
            at = pa.array(starts[keys >> 24])
            columns = [table[name].combine_chunks().take(at) for name in SESSION]
            columns += [pa.array(keys & 0xFFFFFF), pa.array(share[inside])]
            yield pa.RecordBatch.from_arrays(columns, names=[*SESSION, "gram", "share"])

    step = BYTES_PER_STEP

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = max(1, batch.num_rows * step // max(batch.nbytes, 1))
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)

    def whole_sessions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for piece in pieces(batches):
            held.append(piece)
            size += piece.nbytes
            if size < step:
                continue
            table = pa.Table.from_batches(held)
            # The last session may go on in the next batch.
            last = np.ones(table.num_rows, dtype=bool)
            for name in SESSION:
                column = table[name].combine_chunks()
                last &= pc.equal(column, column[-1]).to_numpy(zero_copy_only=False)
            cut = int(np.flatnonzero(last)[0])
            if cut:
                yield from counted(table.slice(0, cut))
                held = table.slice(cut).combine_chunks().to_batches()
                size = sum(b.nbytes for b in held)
        if held:
            yield from counted(pa.Table.from_batches(held))

    return whole_sessions


def sessions(payloads: DataFrame) -> DataFrame:
    """``m, sid, direction`` of every transaction, those that keep no trigram included."""
    return complete_rows(payloads).select(*SESSION).distinct()


def sample_transactions(
    rows: DataFrame, fraction: float = SAMPLE_FRACTION, seed: int = 42
) -> DataFrame:
    """A seeded share of the sessions, whole sessions at a time; for shares and sessions alike.

    The choice depends on the session key and the seed alone: the first 32 bits of an MD5.
    """
    if fraction >= 1.0:
        return rows
    key = F.concat_ws("|", F.lit(seed), *SESSION)
    place = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % 1_000_000
    return rows.where(place < int(fraction * 1_000_000))


def least_support(sessions: DataFrame, min_support: float = MIN_SUPPORT) -> DataFrame:
    """``m, direction, least``: ``ceil(min_support * sessions of the group)``, empty ones counted."""
    n = F.count(F.lit(1))
    return sessions.groupBy(*GROUP).agg(F.ceil(F.lit(min_support) * n).alias("least"))


def _singles(shares: DataFrame, sessions: DataFrame, min_support: float) -> DataFrame:
    """Frequent items with ``freq``, ``least`` and an order-free 128-bit digest of their sessions."""
    digest = [F.bit_xor(F.xxhash64(F.lit(salt), "sid")).alias(f"digest{salt}") for salt in (1, 2)]
    counted = shares.groupBy(*GROUP, "item").agg(F.count(F.lit(1)).alias("freq"), *digest)
    return counted.join(least_support(sessions, min_support), list(GROUP)).where("freq >= least")


def frequent_sets(
    shares: DataFrame,
    sessions: DataFrame,
    min_support: float = MIN_SUPPORT,
    max_size: int | None = None,
) -> DataFrame:
    """``m, direction, items, size, freq``: frequent item sets of every size, all groups at once.

    Without ``max_size`` all are listed, by FP-growth, which holds no set per session.  A size limit is
    reached level by level: inside a session, the frequent sets of one size that differ in their last
    item only are joined, so a set is formed once and only from frequent parts; counts combine before
    the shuffle.
    """
    if max_size is None:
        return fp_growth_sets(shares, sessions, min_support)
    singles = stage(_singles(shares, sessions, min_support), "frequent-items")
    level = singles.select(*GROUP, F.array("item").alias("items"), F.lit(1).alias("size"), "freq", "least")
    held = stage(
        shares.join(singles.select(*GROUP, "item"), [*GROUP, "item"]).select(
            *SESSION, F.array().cast("array<string>").alias("prefix"), F.col("item").alias("last")
        ),
        "sets-of-sessions",
    )
    found, size = [level], 1
    while size < max_size and not level.isEmpty():
        size += 1
        other = held.withColumnRenamed("last", "next")
        grown = (
            held.join(other, [*SESSION, "prefix"])
            .where(F.col("last") < F.col("next"))
            .select(*SESSION, F.array_append("prefix", F.col("last")).alias("prefix"), F.col("next").alias("last"))
        )
        counted = grown.groupBy(*GROUP, "prefix", "last").agg(F.count(F.lit(1)).alias("freq"))
        counted = counted.join(singles.select(*GROUP, "least").distinct(), list(GROUP))
        frequent = stage(counted.where("freq >= least"), "frequent-sets")
        held = stage(grown.join(frequent.select(*GROUP, "prefix", "last"), [*GROUP, "prefix", "last"], "left_semi"), "sets-of-sessions")
        level = frequent.select(
            *GROUP, F.array_append("prefix", F.col("last")).alias("items"), F.lit(size).alias("size"), "freq", "least"
        )
        found.append(level)
    return reduce(DataFrame.unionByName, found).drop("least")


def _classes(shares: DataFrame, sessions: DataFrame, min_support: float, count: int) -> DataFrame:
    """Items of a group that occur in the same sessions, as far as the best ``count`` sets can hold them.

    A class of n items gives 2^n - 1 sets of its own frequency, so the groups' bar is the frequency at
    which these reach ``count``; no set under it is among the best.  Rows: ``class`` (its first item),
    ``members``, ``freq``, ``bar``.
    """
    same = _singles(shares, sessions, min_support).groupBy(*GROUP, "freq", "least", "digest1", "digest2")
    classes = same.agg(F.array_sort(F.collect_list("item")).alias("members"))
    by_freq = Window.partitionBy(*GROUP).orderBy(F.desc("freq"))
    # More than 2^30 - 1 sets are more than enough; the number only says where the bar is.
    sets = F.pow(F.lit(2.0), F.least(F.size("members"), F.lit(30))) - 1
    upto = classes.withColumn("upto", F.sum(sets).over(by_freq))
    enough = F.max(F.when(F.col("upto") >= count, F.col("freq"))).over(Window.partitionBy(*GROUP))
    bar = F.greatest(F.coalesce(enough, F.lit(0)), F.col("least"))
    return (
        upto.withColumn("bar", bar)
        .where("freq >= bar")
        .select(*GROUP, F.col("members")[0].alias("class"), "members", "freq", "bar")
    )


def _joint_classes(shares: DataFrame, classes: DataFrame) -> DataFrame:
    """Every combination of classes whose sets are at or above the bar: ``names``, ``freq``.

    Fewer than ``count`` classes lie above the bar, and a combination holds at most one that lies on
    it, so there are few of them whatever the number of items.
    """
    held = stage(
        shares.join(classes.select(*GROUP, F.col("class").alias("item")), [*GROUP, "item"]).select(
            *SESSION, F.array().cast("array<string>").alias("prefix"), F.col("item").alias("last")
        ),
        "classes-of-sessions",
    )
    level = classes.select(*GROUP, F.array("class").alias("names"), "freq")
    bars, found = classes.select(*GROUP, "bar").distinct(), [level]
    while not level.isEmpty():
        other = held.withColumnRenamed("last", "next")
        grown = (
            held.join(other, [*SESSION, "prefix"])
            .where(F.col("last") < F.col("next"))
            .select(*SESSION, F.array_append("prefix", F.col("last")).alias("prefix"), F.col("next").alias("last"))
        )
        counted = grown.groupBy(*GROUP, "prefix", "last").agg(F.count(F.lit(1)).alias("freq")).join(bars, list(GROUP))
        frequent = stage(counted.where("freq >= bar"), "joint-classes")
        held = stage(grown.join(frequent.select(*GROUP, "prefix", "last"), [*GROUP, "prefix", "last"], "left_semi"), "classes-of-sessions")
        level = frequent.select(*GROUP, F.array_append("prefix", F.col("last")).alias("names"), "freq")
        found.append(level)
    return reduce(DataFrame.unionByName, found)


def _expanded(joint: DataFrame, classes: DataFrame, count: int) -> DataFrame:
    """The best ``count`` item sets of each combination: all its items, then with fewer.

    A set keeps an item of every class.  With ``count - 1`` or more items that can be spared, leaving
    out one at a time gives enough, the largest item first; else there are at most 2^(count - 2)
    choices and all are formed.
    """
    parts = (
        joint.withColumn("class", F.explode("names"))
        .join(classes.select(*GROUP, "class", "members"), [*GROUP, "class"])
        .groupBy(*GROUP, "names", "freq")
        .agg(F.collect_list("members").alias("parts"))
        .withColumn("all", F.array_sort(F.flatten("parts")))
        .withColumn("spare", F.array_sort(F.flatten(F.filter("parts", lambda p: F.size(p) > 1))))
    )
    n = F.size("spare")
    one = F.transform(F.slice("spare", -(count - 1), count - 1), lambda x: F.array(x))
    none = F.array(F.array().cast("array<string>"))
    any_ = F.expr(
        "transform(sequence(0, shiftleft(1, size(spare)) - 1), k -> filter(spare, (x, i) -> (shiftright(k, i) & 1) = 1))"
    )
    gone = F.when(n >= count - 1, F.concat(none, one)).otherwise(any_)
    sets = parts.select(*GROUP, "freq", "parts", F.col("all"), F.explode(gone).alias("gone")).select(
        *GROUP, "freq", "parts", F.array_except("all", "gone").alias("items")
    )
    whole = F.forall("parts", lambda p: F.arrays_overlap(p, F.col("items")))
    return sets.where(whole).select(*GROUP, "items", F.size("items").alias("size"), "freq")


def best_sets(
    shares: DataFrame,
    sessions: DataFrame,
    min_support: float = MIN_SUPPORT,
    count: int = KEYWORD_SETS,
) -> DataFrame:
    """The ``count`` best sets of each group, of any size: by frequency, then larger, then by items."""
    classes = stage(_classes(shares, sessions, min_support, count), "item-classes")
    sets = _expanded(_joint_classes(shares, classes), classes, count)
    ranked = Window.partitionBy(*GROUP).orderBy(F.desc("freq"), F.desc("size"), "items")
    return sets.withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= count)


def keywords(
    shares: DataFrame,
    sessions: DataFrame,
    min_support: float = MIN_SUPPORT,
    count: int = KEYWORD_SETS,
) -> DataFrame:
    """``rowkey, m, direction, keywords``: distinct items of the best sets, Base64, comma-joined."""
    # The items of ``count`` sets per group.
    items = F.array_sort(F.collect_set("item"))
    return (
        best_sets(shares, sessions, min_support, count)
        .select(*GROUP, F.explode("items").alias("item"))
        .groupBy(*GROUP)
        .agg(items.alias("items"))
        .select(
            md5_bytes(F.col("m").cast("binary")).alias("rowkey"),
            *GROUP,
            F.array_join(F.transform("items", item_base64), ",").alias("keywords"),
        )
    )


def fp_growth_sets(
    shares: DataFrame, sessions: DataFrame, min_support: float = MIN_SUPPORT
) -> DataFrame:
    """The sets of ``frequent_sets`` by pattern growth, all groups in one job, each at its own support.

    Transactions list a group's frequent items, the commonest first, and equal ones are one row with a count.  A shard is
    the transactions that hold a suffix, cut off before it: at first the whole group.  A shard with up to
    ``ITEMS_PER_SHARD`` items is mined in one task; a larger one is counted by a shuffle and falls into the shards of its frequent items,
    to which each transaction goes once per item it has.  Nothing but whether shards are left comes to the driver.
    """
    transactions = _transactions(shares, sessions, min_support)
    shards = stage(transactions.withColumn("suffix", F.array().cast("array<string>")), "shards")
    named, found = [*GROUP, "suffix"], []
    while True:
        rooms = shards.groupBy(*named).agg(F.sum(F.size("items")).alias("room"))
        sized = shards.join(rooms, named)
        small = sized.where(F.col("room") <= ITEMS_PER_SHARD).drop("room")
        found.append(_dealt(small, named).groupBy(*named).applyInPandas(_miner(), _SETS))
        large = stage(sized.where(F.col("room") > ITEMS_PER_SHARD).drop("room"), "large-shards")
        if large.isEmpty():
            return reduce(DataFrame.unionByName, found)
        each = large.select(*named, "least", "n", "items", F.posexplode("items").alias("at", "item"))
        counted = each.groupBy(*named, "item").agg(F.sum("n").alias("freq"), F.first("least").alias("least"))
        frequent = stage(counted.where("freq >= least"), "frequent-sets")
        grown = F.array_append("suffix", F.col("item"))
        found.append(
            frequent.select(*GROUP, F.array_sort(grown).alias("items"), F.size(grown).alias("size"), "freq")
        )
        before = F.slice("items", F.lit(1), F.col("at")).alias("items")
        cut = each.where("at > 0").join(frequent.select(*named, "item"), [*named, "item"], "left_semi")
        shards = stage(
            cut.select(*GROUP, "least", grown.alias("suffix"), before, "n")
            .groupBy(*named, "least", "items")
            .agg(F.sum("n").alias("n")),
            "shards",
        )


def _transactions(shares: DataFrame, sessions: DataFrame, min_support: float) -> DataFrame:
    """``m, direction, least, items, n``: different lists of frequent items, the group's commonest first, and how many sessions have each."""
    singles = stage(_singles(shares, sessions, min_support), "frequent-items")
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("freq")).alias("rank"), "item")))
    return (
        shares.select(*SESSION, "item")
        .join(singles.select(*GROUP, "item", "freq", "least"), [*GROUP, "item"])
        .groupBy(*SESSION)
        .agg(F.transform(ranked, lambda x: x["item"]).alias("items"), F.first("least").alias("least"))
        .groupBy(*GROUP, "least", "items")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _dealt(shards: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Shards in a fixed number of partitions: mining costs far more than their bytes tell, by which Spark would put all into one task."""
    spark = shards.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return shards.repartition(tasks, *keys)


_SETS = "m string, direction string, items array<string>, size int, freq bigint"


def _miner():
    """The function that mines one shard.  Made here, it goes to the workers by value, which need no package."""

    def mined(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        least, found = int(rows["least"].iloc[0]), []

        def grow(table: Counter, suffix: tuple) -> None:
            counts: Counter = Counter()
            for items, n in table.items():
                for x in items:
                    counts[x] += n
            for item, freq in counts.items():
                if freq < least:
                    continue
                found.append(((*suffix, item), freq))
                below: Counter = Counter()
                for items, n in table.items():
                    if item in items:
                        # Only items that are still frequent: what is left of many transactions is then equal.
                        rest = tuple(x for x in items[: items.index(item)] if counts[x] >= least)
                        if rest:
                            below[rest] += n
                if below:
                    grow(below, (*suffix, item))

        start: Counter = Counter()
        for items, n in zip(rows["items"], rows["n"], strict=True):
            start[tuple(items)] += int(n)
        grow(start, tuple(key[2]))
        out = [(key[0], key[1], sorted(items), len(items), freq) for items, freq in found]
        return pd.DataFrame(out, columns=["m", "direction", "items", "size", "freq"])

    return mined


def closed_sets(
    shares: DataFrame, sessions: DataFrame, min_support: float = MIN_SUPPORT
) -> DataFrame:
    """The frequent sets that no larger set of the same frequency contains; all others follow from these.

    Groups that fit into a task are mined for closed sets alone, of which there are no more than different
    intersections of their sessions, however many items occur together.  Of larger groups all sets are listed first.
    """
    transactions = stage(_transactions(shares, sessions, min_support), "transactions")
    rooms = transactions.groupBy(*GROUP).agg(F.sum(F.size("items")).alias("room"))
    large = stage(rooms.where(F.col("room") > ITEMS_PER_SHARD).select(*GROUP), "large-groups")
    small = transactions.join(large, list(GROUP), "left_anti")
    closed = _dealt(small, GROUP).groupBy(*GROUP).applyInPandas(_closed_miner(), _SETS)
    if large.isEmpty():
        return closed
    rest = (df.join(large, list(GROUP), "left_semi") for df in (shares, sessions))
    return closed.unionByName(closed_of(stage(fp_growth_sets(*rest, min_support), "sets")))


def _closed_miner():
    """The function that mines one group for closed sets: each is reached once, from the closed set before it.

    A set is extended by an item and closed; it belongs to this way only if the closure adds no earlier item.
    """

    def mined(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        least = int(rows["least"].iloc[0])
        weights = [int(n) for n in rows["n"]]

        def mask_of(ts: list[int]) -> int:
            has = np.zeros(len(weights), dtype=np.uint8)
            has[ts] = 1
            return int.from_bytes(np.packbits(has, bitorder="little").tobytes(), "little")

        # The transactions whose count has bit b, as one mask for each b.
        bits = [mask_of([t for t, n in enumerate(weights) if n >> b & 1]) for b in range(max(weights).bit_length())]
        held: dict[str, list[int]] = {}
        for t, items in enumerate(rows["items"]):
            for x in items:
                held.setdefault(x, []).append(t)
        places = {x: mask_of(ts) for x, ts in held.items()}
        # Items of the same sessions always come together: they are one class.
        classes: dict[int, list[str]] = {}
        for item in sorted(places):
            classes.setdefault(places[item], []).append(item)
        masks = list(classes)

        def weight(mask: int) -> int:
            return sum((mask & bit).bit_count() << b for b, bit in enumerate(bits))

        def closure(mask: int) -> list[int]:
            return [c for c, m in enumerate(masks) if m & mask == mask]

        every = (1 << len(weights)) - 1
        found, todo = [], [(closure(every), every, -1)]
        while todo:
            own, mask, core = todo.pop()
            freq = weight(mask)
            if own and freq >= least:
                items = sorted(x for c in own for x in classes[masks[c]])
                found.append((key[0], key[1], items, len(items), freq))
            has = set(own)
            for c in range(core + 1, len(masks)):
                if c in has:
                    continue
                both = mask & masks[c]
                if both and weight(both) >= least:
                    wider = closure(both)
                    if all(x >= c or x in has for x in wider):
                        todo.append((wider, both, c))
        return pd.DataFrame(found, columns=["m", "direction", "items", "size", "freq"])

    return mined


def closed_of(sets: DataFrame) -> DataFrame:
    """Of all frequent sets the closed ones."""
    smaller = sets.select(*GROUP, "freq", "items", F.explode("items").alias("without")).select(
        *GROUP, "freq", F.array_remove("items", F.col("without")).alias("items")
    )
    return sets.join(smaller.distinct(), [*GROUP, "freq", "items"], "left_anti").select(*sets.columns)
