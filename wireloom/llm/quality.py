"""Quality by perplexity under an interpolated modified Kneser-Ney model of character 5-grams.

The model is learned from trusted text: every document labelled good and not toxic.  A gram is five symbols
of 12 bits packed in one number, so the suffix and context of a gram are a mask and a shift.  The characters that are
commonest in trusted text have symbols of their own, whatever their script; rarer ones share one with those of their
block of 256 code points; start and end of a text are symbols that no character has.

Counting: tasks sum grams of trusted documents before the shuffle; lower orders are continuation counts,
grouped from the order above.  Counts, contexts and discounts are tables, never broadcast or collected
(the discounts are three numbers an order).

Scoring: texts are cut into blocks of ``BLOCK_BYTES`` where they are read, and only the different grams of a
block are looked up.  The different grams of all blocks get their probability by joins with the count tables,
sharded by gram, one order after the other; the answers meet the texts of their block, which are read a second
time and move once, compressed, and there every text is scored.  Grams that are at least one in ``COMMON`` of
trusted text, so never more than that many, are sent to all tasks and looked up by no block.  So the input has to give its rows in the same
order on both readings, as files do; if it does not, the job says so.

Held-out scores: a hash of the text deals all texts into ``FOLDS``, and the count tables hold every count once
for all trusted texts and once without each fold.  Every document, trusted or not, is scored by the model that
saw nothing of its fold, so trusted documents score as unseen ones do, and equal texts score alike.

A document is kept if its held-out perplexity is at most the ``QUANTILE`` of trusted documents' held-out scores
in its language, and at least the lower of the ``LOW_QUANTILE`` of those and of their scores by the model of all
trusted texts, so that a near copy of a trusted text is not too likely; give or take ``MARGIN`` bits a symbol and ``WIDTH`` divided by the
root of its length: the mean over few symbols scatters more.  Quantiles are read from counts of hundredths of a
bit, the same however rows are dealt.

Defined results: null text is empty; a very long text is a block of its own; of conflicting label rows any good one counts; an empty text is one symbol, its end; a null language is a group of its
own; a language without trusted documents gets the limits of all trusted documents; with none at all every
document is kept with equal chances for all symbols, which are also the model of a fold that has all trusted
texts; repeated rows get equal results; an empty table gives no rows; other columns are not read and may have
any name.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wireloom.llm.common import ready, sized_broadcast, slices, stage, utf8

ORDER, BITS = 5, 12
SYMBOLS = 1 << BITS
BLOCK_BYTES = 32 << 20
#: Texts that travel in one row.
PACK_BYTES = 1 << 20
#: Different grams counted in a task before they are handed on.
COUNTED_GRAMS = 4_000_000
ROWS_OUT = 50_000
QUANTILE, LOW_QUANTILE, MARGIN, WIDTH = 0.99, 0.01, 0.1, 4.0
STEPS = 100
#: At most 8, as a gram and its fold are packed in one number.
FOLDS, FOLD_BITS = 4, 3
#: Columns of counts: without each fold, then of all texts.
ALL = FOLDS
VARIANTS = FOLDS + 1
#: Continuations of a context with count 1, 2 and 3 or more are packed in one number: at most SYMBOLS each.
CLASS_BITS = BITS + 1
LEAST_DISCOUNT = 0.1
#: A gram of trusted text this frequent is known to every task.
COMMON = 1_000_000
#: Start, end, one symbol for each of 256 blocks of code points, then the characters that have their own.
START, END, BLOCK = 0, 1, 2
OWN = BLOCK + 256


@functools.cache
def _folded() -> np.ndarray:
    """Per code point: lower case, any digit as 0, control characters as a blank."""
    table = np.arange(0x110000, dtype=np.int32)
    for i in range(0x110000):
        c = chr(i)
        low = "0" if c.isdigit() else " " if i < 32 and c != "\n" else c.lower()
        if len(low) == 1:
            table[i] = ord(low)
    return table


@functools.lru_cache(maxsize=2)
def symbol_table(own: tuple[int, ...]) -> np.ndarray:
    """Symbol per code point, where the code points ``own`` have one each."""
    folded = _folded()
    symbols = BLOCK + (np.arange(0x110000) >> 8) % 256
    symbols[list(own)] = OWN + np.arange(len(own))
    return symbols[folded]


def grams_of(texts: list[str], own: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """All grams of texts, one per symbol and one for the end, and where each text's begin."""
    lead, sizes = " " * (ORDER - 1), np.fromiter(map(len, texts), np.int64, len(texts)) + ORDER
    joined = "".join(f"{lead}{t} " for t in texts)
    s = symbol_table(own)[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    first = np.cumsum(sizes) - sizes
    for i in range(ORDER - 1):
        s[first + i] = START
    s[first + sizes - 1] = END
    packed = s[: len(s) - ORDER + 1].copy()
    for i in range(1, ORDER):
        packed = packed << BITS | s[i : len(s) - ORDER + 1 + i]
    keep = np.ones(len(packed), bool)
    for i in range(ORDER - 1):  # windows that run into the next text's start
        over = first[1:] - 1 - i
        keep[over] = False
    counts = sizes - ORDER + 1
    return packed[keep], np.cumsum(counts) - counts


def _characters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count = np.zeros(0x110000, np.int64)
    for batch in batches:
        for start, stop in slices(batch.column(0)):
            codes = "".join(_texts(batch.column(0).slice(start, stop - start))).encode("utf-32-le", "surrogatepass")
            points, n = np.unique(np.frombuffer(codes, np.uint32), return_counts=True)
            np.add.at(count, _folded()[points], n)
    points = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays([pa.array(points), pa.array(count[points])], ["point", "n"])


def alphabet(trusted: DataFrame, text: str = "text") -> tuple[int, ...]:
    """The code points with symbols of their own: as many as there is room for, the commonest first."""
    counts = trusted.select(F.col(f"`{text}`").alias("text")).mapInArrow(_characters, "point bigint, n bigint")
    best = counts.groupBy("point").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "point").limit(SYMBOLS - OWN)
    return tuple(r.point for r in best.collect())


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def folds_of(texts: list[str]) -> np.ndarray:
    digests = (xxhash.xxh32_intdigest(t.encode("utf-8", "surrogatepass")) % FOLDS for t in texts)
    return np.fromiter(digests, np.int64, len(texts))


def _counted(batches: Iterator[pa.RecordBatch], own: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """Texts to (gram and fold, c), summed over the task."""
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def out() -> Iterator[pa.RecordBatch]:
        for a in range(0, len(keys), ROWS_OUT):
            part = slice(a, a + ROWS_OUT)
            yield pa.RecordBatch.from_arrays([pa.array(keys[part]), pa.array(counts[part])], ["key", "c"])

    for batch in batches:
        for start, stop in slices(batch.column(0)):
            texts = _texts(batch.column(0).slice(start, stop - start))
            grams, first = grams_of(texts, own)
            folds = np.repeat(folds_of(texts), np.diff(np.append(first, len(grams))))
            codes, new = pd.factorize(grams << FOLD_BITS | folds)
            n = np.bincount(codes, minlength=len(new))
            codes, both = pd.factorize(np.concatenate((keys, new)))
            counts = np.bincount(codes, np.concatenate((counts, n)), len(both)).astype(np.int64)
            keys = both
        if len(keys) > COUNTED_GRAMS:
            yield from out()
            keys, counts = keys[:0], counts[:0]
    yield from out()


def _name(part: pa.RecordBatch) -> int:
    """A block is named by its first rows, wherever and whenever they are read."""
    ids, texts = repr(part.column(0).to_pylist()).encode(), utf8(part.column(2))[0].tobytes()
    return xxhash.xxh64_intdigest(texts, xxhash.xxh32_intdigest(ids)) - (1 << 63)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, bool]]:
    """(id, language, text) cut into (block, some rows, whether the block ends); the same on every pass."""
    block, size, held = None, 0, None
    for batch in batches:
        for start, stop in slices(batch.column(2), PACK_BYTES):
            if held is not None:
                yield block, held, size >= BLOCK_BYTES
                if size >= BLOCK_BYTES:
                    block, size = None, 0
            held = batch.slice(start, stop - start)
            block = _name(held) if block is None else block
            size += int(utf8(held.column(2))[1][-1])
    if held is not None:
        yield block, held, True


def _block_grams(
    batches: Iterator[pa.RecordBatch], own: tuple[int, ...], common: np.ndarray
) -> Iterator[pa.RecordBatch]:
    """The different grams of each block but the common ones, and a bit for each fold they occur in."""
    seen = np.zeros(0, np.int64)
    for block, part, ends in _blocks(batches):
        texts = _texts(part.column(2))
        grams, first = grams_of(texts, own)
        folds = np.repeat(folds_of(texts), np.diff(np.append(first, len(grams))))
        seen = pd.unique(np.concatenate((seen, pd.unique(grams << FOLD_BITS | folds))))
        if ends:
            # In order, as neighbours then share their first bytes.
            seen = np.sort(seen[~np.isin(seen >> FOLD_BITS, common)])
            codes, grams = pd.factorize(seen >> FOLD_BITS)
            folds = np.bincount(codes, 1 << (seen & ((1 << FOLD_BITS) - 1)), len(grams)).astype(np.int32)
            for a in range(0, len(grams), ROWS_OUT):
                some = grams[a : a + ROWS_OUT]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(some), block)), pa.array(folds[a : a + ROWS_OUT]), pa.array(some)], ["block", "folds", "gram"]
                )
            seen = seen[:0]


def _block_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of each block, compressed, ``PACK_BYTES`` a row."""
    squeeze = zstandard.ZstdCompressor(level=5)
    for block, part, _ in _blocks(batches):
        bodies = [t.encode("utf-8", "surrogatepass") for t in _texts(part.column(2))]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([block]), pa.array([1], pa.int32()), pa.nulls(1, pa.int64()),
                *[pa.array([0.0], pa.float32())] * VARIANTS,
                pa.array([part.column(0).to_pylist()], pa.list_(part.schema.field(0).type)),
                pa.array([part.column(1).to_pylist()], pa.list_(pa.string())),
                pa.array([list(map(len, bodies))], pa.list_(pa.int32())),
                pa.array([squeeze.compress(b"".join(bodies))], pa.binary()),
            ],
            ["block", "kind", "gram", *(f"bits{v}" for v in range(VARIANTS)), "ids", "langs", "sizes", "packed"],
        )


def _scored(
    batches: Iterator[pa.RecordBatch], own: tuple[int, ...], known: tuple[np.ndarray, np.ndarray]
) -> Iterator[pa.RecordBatch]:
    """Rows in order of (block, kind): the block's grams with their bits, then its texts; ``known``: common grams, bits."""
    loosen = zstandard.ZstdDecompressor()
    now, keys, bits, index = None, [], [], None
    for batch in batches:
        block, kind = (batch.column(i).to_numpy() for i in (0, 1))
        borders = np.flatnonzero((np.diff(block) != 0) | (np.diff(kind) != 0)) + 1
        for a, b in zip([0, *borders], [*borders, len(block)], strict=True):
            if block[a] != now:
                now, keys, bits, index = block[a], [known[0]], [known[1]], None
            part = batch.slice(a, b - a)
            if kind[a] == 0:
                keys.append(part.column(2).to_numpy())
                bits.append(np.array([part.column(3 + v).to_numpy(zero_copy_only=False) for v in range(VARIANTS)]))
                continue
            if index is None:
                all_, first_of = np.unique(np.concatenate(keys), return_index=True)
                index, bits = pd.Index(all_), [np.concatenate(bits, axis=1)[:, first_of]]
            for row in part.slice(0).to_pylist():
                data, at, texts = loosen.decompress(row["packed"]), 0, []
                for n in row["sizes"]:
                    texts.append(data[at : at + n].decode("utf-8", "surrogatepass"))
                    at += n
                grams, first = grams_of(texts, own)
                place = index.get_indexer(grams)
                if place.min(initial=0) < 0:
                    raise ValueError("the input gave other rows on its second reading; store it first")
                count = np.diff(np.append(first, len(grams)))
                variants = np.repeat(folds_of(texts), count)
                total, unseen = (np.add.reduceat(bits[0][v, place].astype(float), first) for v in (ALL, variants))
                kind_of_id = batch.schema.field("ids").type.value_type
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["ids"], kind_of_id), pa.array(row["langs"], pa.string()), pa.array(count),
                     pa.array(total / count), pa.array(unseen / count)],
                    ["_id", "_lang", "_n", "_bits", "_held"],
                )


def trusted_ids(labels: DataFrame, id: str = "doc_id") -> DataFrame:
    good = labels.where("quality = 1 and toxic = 0")
    return good.select(F.col(f"`{id}`").alias("_trusted")).where("_trusted is not null").distinct()


class CountTables:
    """Written tables of every order: grams (gram, c0, c1, ..) and contexts (context, total0, n0, ..), and discounts.

    Columns end in the fold they leave out, or ``ALL``; n packs how many grams have count 1, 2 and 3 or more.
    """

    def __init__(self, trusted: DataFrame, text: str = "text"):
        ready(trusted.sparkSession)
        self.alphabet = own = alphabet(trusted, text)
        only = trusted.select(F.col(f"`{text}`").alias("text"))
        counts = only.mapInArrow(lambda batches: _counted(batches, own), "key bigint, c bigint")
        fold = F.col("key").bitwiseAND(F.lit((1 << FOLD_BITS) - 1))
        without = [F.sum(F.when(fold == v, 0).otherwise(F.col("c"))).alias(f"c{v}") for v in range(FOLDS)]
        grams = counts.groupBy(F.shiftright("key", FOLD_BITS).alias("gram")).agg(*without, F.sum("c").alias(f"c{ALL}"))
        grams = stage(grams, "grams")
        self.grams, self.contexts, self.discounts = {}, {}, {}
        for order in range(ORDER, 0, -1):
            if order < ORDER:
                # How many different symbols stand before: grouped from the order above.
                shorter = F.col("gram").bitwiseAND(F.lit((1 << BITS * order) - 1)).alias("gram")
                before = [F.sum((F.col(f"c{v}") > 0).cast("long")).alias(f"c{v}") for v in range(VARIANTS)]
                grams = stage(grams.select(shorter, *(f"c{v}" for v in range(VARIANTS))).groupBy("gram").agg(*before), "grams")
            self.grams[order] = grams
            rare = [F.sum((F.col(f"c{v}") == i).cast("long")) for v in range(VARIANTS) for i in (1, 2, 3, 4)]
            found = [n or 0 for n in grams.agg(*rare).first()]
            self.discounts[order] = [discounts(dict(zip((1, 2, 3, 4), found[4 * v :], strict=False))) for v in range(VARIANTS)]
            sums = []
            for v in range(VARIANTS):
                c = F.col(f"c{v}")
                size = F.when(c == 0, 0).when(c == 1, 1).when(c == 2, 1 << CLASS_BITS).otherwise(F.lit(1 << 2 * CLASS_BITS))
                sums += [F.sum(c).alias(f"total{v}"), F.sum(size.cast("long")).alias(f"n{v}")]
            by_context = grams.groupBy(F.shiftright("gram", BITS).alias("context")).agg(*sums)
            self.contexts[order] = stage(by_context, "contexts")

    def common(self) -> DataFrame:
        """Grams (column gram) that are at least one in ``COMMON`` of all."""
        c = F.col(f"c{ALL}")
        total = self.grams[ORDER].agg(F.sum(c)).first()[0] or 0
        return self.grams[ORDER].where(c * F.lit(COMMON) >= total).select("gram")


def discounts(n: dict[int, int]) -> tuple[float, float, float]:
    """For counts 1, 2 and 3 or more, from how many grams have count 1 to 4; never 0, so no gram is impossible."""
    n1, n2, n3, n4 = (n.get(i, 0) for i in (1, 2, 3, 4))
    if not n1:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    after = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2 if n2 else 0.0, 3 - 4 * y * n4 / n3 if n3 else 0.0]
    return tuple(min(max(d, LEAST_DISCOUNT), float(i)) for i, d in enumerate(after, 1))


def probabilities(grams: DataFrame, model: CountTables) -> DataFrame:
    """Distinct grams (column gram) to (gram, p0, p1, ..), by joins with the counts of each order from the first up."""
    below, few = None, F.lit((1 << CLASS_BITS) - 1)
    for order in range(1, ORDER + 1):
        mask = F.lit((1 << BITS * order) - 1)
        wanted = grams.select(F.col("gram").bitwiseAND(mask).alias("gram")).distinct()
        wanted = wanted.select("gram", F.shiftright("gram", BITS).alias("context"))
        joined = wanted.join(model.grams[order], "gram", "left").join(model.contexts[order], "context", "left")
        if below is not None:
            shorter = F.col("gram").bitwiseAND(F.lit((1 << BITS * (order - 1)) - 1)).alias("short")
            joined = joined.select("*", shorter).join(below, "short")
        chances = []
        for v in range(VARIANTS):
            d1, d2, d3 = (F.lit(d) for d in model.discounts[order][v])
            c, n, total = F.coalesce(f"c{v}", F.lit(0)), F.col(f"n{v}"), F.col(f"total{v}")
            own = F.when(c == 0, 0.0).when(c == 1, 1 - d1).when(c == 2, 2 - d2).otherwise(c - d3)
            n1, n2, n3 = (F.shiftright(n, i * CLASS_BITS).bitwiseAND(few) for i in range(3))
            lower = F.lit(1.0 / SYMBOLS) if below is None else F.col(f"lower{v}").cast("double")
            p = F.when(total > 0, (own + (d1 * n1 + d2 * n2 + d3 * n3) * lower) / total).otherwise(lower)
            chances.append(p.cast("float").alias(f"p{v}"))
        below = stage(joined.select("gram", *chances), "probabilities")
        if order < ORDER:
            below = below.toDF("short", *(f"lower{v}" for v in range(VARIANTS)))
    return below


def _bits(p: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Few grams and, per variant, their bits."""
    table = p.select("gram", *(-F.log2(f"p{v}").cast("float") for v in range(VARIANTS))).toArrow()
    columns = [c.to_numpy() for c in table.columns]
    return columns[0].astype(np.int64), np.array(columns[1:], np.float32).reshape(VARIANTS, len(columns[0]))


def perplexities(docs: DataFrame, model: CountTables, id: str, lang: str, text: str) -> DataFrame:
    """(_id, _lang, _n, _bits, _held): symbols and mean bits a symbol of every row, by all texts and without its fold."""
    rows = docs.select(F.col(f"`{id}`").alias("_id"), F.col(f"`{lang}`").cast("string").alias("_lang"), F.col(f"`{text}`").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    own, frequent = model.alphabet, stage(model.common(), "common-grams")
    common = frequent.toArrow()["gram"].to_numpy()
    wanted = rows.mapInArrow(lambda batches: _block_grams(batches, own, common), "block bigint, folds int, gram bigint")
    wanted = stage(wanted, "block-grams")
    p = probabilities(wanted.select("gram").union(frequent).distinct(), model)
    known = docs.sparkSession.sparkContext.broadcast(_bits(p.join(F.broadcast(frequent), "gram", "left_semi")))
    blocks = wanted.agg(F.count_distinct("block")).first()[0]
    shape = f"block bigint, kind int, gram bigint, {', '.join(f'bits{v} float' for v in range(VARIANTS))}, ids array<{kind}>, langs array<string>, sizes array<int>, packed binary"
    # Read again rather than kept: texts lie on disk only once, in the shuffle to their answers.
    texts = rows.mapInArrow(_block_texts, StructType.fromDDL(shape))
    # Only the folds a block needs; a null takes next to no room.
    needed = [*(F.col("folds").bitwiseAND(F.lit(1 << v)) > 0 for v in range(FOLDS)), F.lit(True)]
    bits = [F.when(n, -F.log2(f"p{v}")).cast("float").alias(f"bits{v}") for v, n in enumerate(needed)]
    answers = wanted.join(p, "gram").select(
        "block", F.lit(0).alias("kind"), "gram", *bits,
        *(F.lit(None).cast(texts.schema[c].dataType).alias(c) for c in ("ids", "langs", "sizes", "packed")),
    )
    # A task has about one block, however many there are.
    parts = max(2 * blocks, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    together = answers.unionByName(texts).repartition(parts, "block").sortWithinPartitions("block", "kind")
    return together.mapInArrow(lambda batches: _scored(batches, own, known.value), StructType.fromDDL(f"_id {kind}, _lang string, _n bigint, _bits double, _held double"))


def limits(scored: DataFrame) -> DataFrame:
    """(lang, low, high) from trusted rows (_lang, _bits, _held); the row with all = true is over all languages."""
    both = [F.struct(F.lit(c == "_held").alias("held"), F.floor(F.col(c) * STEPS).alias("step")) for c in ("_bits", "_held")]
    each = scored.select("_lang", F.explode(F.array(*both)).alias("s")).select("_lang", "s.held", "s.step")
    counts = each.cube("_lang", "held", "step").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    # g: 0 = language and step, 4 = step over all languages; at most steps x languages rows.
    parts = counts.where("g in (0, 4)").select("_lang", (F.col("g") == 4).alias("all"), "held", "step", "n")
    group = Window.partitionBy("_lang", "all", "held")
    parts = parts.select("*", F.sum("n").over(group.orderBy("step")).alias("upto"), F.sum("n").over(group).alias("total"))
    high = F.min(F.when(F.col("held") & (F.col("upto") >= QUANTILE * F.col("total")), F.col("step") + 1)) / STEPS
    low = F.min(F.when(F.col("upto") > LOW_QUANTILE * F.col("total"), F.col("step"))) / STEPS
    return parts.groupBy("_lang", "all").agg(low.alias("low"), high.alias("high"))


def classify(docs: DataFrame, labels: DataFrame, id: str = "doc_id", lang: str = "lang", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, lang, n_symbols, perplexity, low, high, kept."""
    trusted = stage(trusted_ids(labels, id), "trusted")
    known = docs.select(F.col(f"`{id}`").alias("_id"), F.col(f"`{text}`").alias("text"))
    known = known.join(sized_broadcast(trusted), F.col("_id") == F.col("_trusted"), "left_semi")
    scored = stage(perplexities(docs, CountTables(known), id, lang, text), "scored")
    good = scored.join(sized_broadcast(trusted), F.col("_id") == F.col("_trusted"), "left_semi")
    limit = stage(limits(good), "limits")
    own = limit.where("not all").select(F.col("_lang").alias("_of"), "low", "high")
    every = limit.where("all").select(F.col("low").alias("low_all"), F.col("high").alias("high_all"))
    bounds = every.first() or (None, None)
    joined = scored.join(sized_broadcast(own), F.col("_lang").eqNullSafe(F.col("_of")), "left")
    low, high = (F.coalesce(c, F.lit(b).cast("double")) for c, b in zip(("low", "high"), bounds, strict=True))
    slack = MARGIN + WIDTH / F.sqrt("_n")
    low, high = low - slack, high + slack
    return joined.select(
        F.col("_id").alias(id),
        F.col("_lang").alias("lang"),
        F.col("_n").alias("n_symbols"),
        F.pow(F.lit(2.0), "_held").alias("perplexity"),
        F.pow(F.lit(2.0), low).alias("low"),
        F.pow(F.lit(2.0), high).alias("high"),
        F.coalesce(F.col("_held").between(low, high), F.lit(True)).alias("kept"),
    )
