"""Secret scan with an incremental blob ledger, in Spark expressions only.

Every version of every path is a blob named by the SHA-256 of its bytes.  The ledger in shared storage keeps
which (blob, rules version) pairs were scanned and what was found; a scan takes only pairs not in it, each
blob once however many paths and versions hold it, and findings are joined back to all of them.

The rules version is the digest of the rules, so changed rules scan everything anew and leave old results
in place.  Findings are written before the note that a blob was scanned: a job that dies in between scans
those blobs again, and repeated findings count once.

Places come from the pieces between matches: a match starts behind all pieces and matches before it.  They
are summed by a window over narrow rows of lengths, so a blob with any number of matches costs in proportion.

Defined results: null text is an empty blob; a path or id may repeat and each row gets the findings of its
blob; no finding gives zero counts and the empty string; a very long blob takes one pass for each rule; an empty table
gives no rows and adds nothing to the ledger; columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wireloom.llm.common import new_path, sized_broadcast, stage


class Rule(NamedTuple):
    kind: str
    pattern: str
    #: Group that must have at least ``least`` characters; matches that fail are dropped, not searched again.
    group: int = 0
    least: int = 0
    #: Text that every match contains, looked for first; empty: none.
    holds: str = ""


# Runs of one class that are too short can be left to the pattern: a run is matched whole or not at all.
BASE = (
    Rule(
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=6,
    ),
    Rule("access", r"AKIA[A-Z0-9]{16,}", holds="AKIA"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", holds="-----BEGIN "),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", holds="gh"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", holds="xox"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}", holds="AIza"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}", holds="k_live_"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", holds="eyJ"),
)
RULES = BASE + MORE

_FINDING = "blob_id string, rules_version string, kind string, start bigint, end bigint"
_SCANNED = "blob_id string, rules_version string"


def rules_version(rules: tuple[Rule, ...] = RULES) -> str:
    return hashlib.sha256(repr([tuple(r) for r in rules]).encode()).hexdigest()[:16]


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _lengths(rule: Rule, number: int) -> Column:
    """Null without a match; else the lengths of the pieces before each match, of the matches and of the group."""
    text, pattern = F.col("text"), F.lit(rule.pattern)
    sizes = [
        F.transform(a, F.length)
        for a in (
            F.split(text, rule.pattern, -1),
            F.regexp_extract_all(text, pattern, 0),
            F.regexp_extract_all(text, pattern, rule.group),
        )
    ]
    found = text.rlike(rule.pattern)
    if rule.holds:
        found = F.contains(text, F.lit(rule.holds)) & found
    # The last piece stands behind the last match and is cut off.
    before = F.slice(sizes[0], 1, F.size(sizes[0]) - 1)
    zipped = F.arrays_zip(before.alias("before"), sizes[1].alias("size"), sizes[2].alias("part"))
    return F.when(found, F.struct(F.lit(number).alias("rule"), zipped.alias("all")))


def findings(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob_id, text) of distinct blobs to (blob_id, rule, kind, start, end); end is exclusive."""
    every = F.array_compact(F.array(*(_lengths(r, i) for i, r in enumerate(rules))))
    runs = blobs.select("blob_id", F.explode(every).alias("run"))
    places = runs.select("blob_id", "run.rule", F.posexplode("run.all").alias("at", "m"))
    upto = Window.partitionBy("blob_id", "rule").orderBy("at")
    end = F.sum(F.col("m.before") + F.col("m.size")).over(upto)
    kind, least = (F.array(*(F.lit(x) for x in values)) for values in zip(*((r.kind, r.least) for r in rules), strict=True))
    return (
        places.select("blob_id", "rule", end.alias("end"), "m.size", "m.part")
        .where(F.col("part") >= least[F.col("rule")])
        .select("blob_id", "rule", kind[F.col("rule")].alias("kind"), (F.col("end") - F.col("size")).alias("start"), "end")
    )


class Ledger:
    """What was scanned and found, in a folder of shared storage."""

    def __init__(self, spark: SparkSession, path: str, rules: tuple[Rule, ...] = RULES):
        self.spark, self.path, self.rules, self.version = spark, path, rules, rules_version(rules)
        for name, kind in (("scanned", _SCANNED), ("findings", _FINDING)):
            spark.createDataFrame([], kind).write.mode("append").parquet(f"{path}/{name}")

    def _read(self, name: str, kind: str) -> DataFrame:
        table = self.spark.read.schema(kind).parquet(f"{self.path}/{name}")
        return table.where(F.col("rules_version") == self.version).drop("rules_version").distinct()

    def scanned(self) -> DataFrame:
        return self._read("scanned", _SCANNED)

    def findings(self) -> DataFrame:
        return self._read("findings", _FINDING)

    def scan(self, versions: DataFrame, text: str = "text") -> None:
        """Scan the blobs of ``versions`` that are not in the ledger under these rules."""
        rows = versions.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
        unseen = rows.withColumn("blob_id", blob_id(F.col("text"))).join(self.scanned(), "blob_id", "left_anti")
        # Copies combine before the shuffle, so a blob that fills a third of the table moves once per task.
        found = findings(unseen.dropDuplicates(["blob_id"]), self.rules).drop("rule")
        version = F.lit(self.version).alias("rules_version")
        found.select("blob_id", version, "kind", "start", "end").write.mode("append").parquet(f"{self.path}/findings")
        done = unseen.select("blob_id").distinct().select("blob_id", version)
        done.write.mode("append").parquet(f"{self.path}/scanned")

    def report(self, versions: DataFrame, id: str, text: str = "text") -> DataFrame:
        """One row per row of ``versions``: id, blob_id, found (array of start, number, kind, end, in order)."""
        numbers = F.create_map(*(F.lit(x) for i, r in enumerate(self.rules) for x in (r.kind, i)))
        each = F.struct("start", numbers[F.col("kind")].alias("number"), "kind", "end")
        by_blob = stage(
            self.findings().groupBy("blob_id").agg(F.array_sort(F.collect_list(each)).alias("found")), "found"
        )
        paths = versions.select(F.col(f"`{id}`").alias(id), blob_id(F.col(f"`{text}`")).alias("blob_id"))
        none = F.array().cast(by_blob.schema["found"].dataType)
        joined = paths.join(sized_broadcast(by_blob, size=F.size("found") * 24), "blob_id", "left")
        return joined.select(id, "blob_id", F.coalesce("found", none).alias("found"))


def spans_text(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")


def new_ledger(spark: SparkSession, rules: tuple[Rule, ...] = RULES) -> Ledger:
    return Ledger(spark, new_path(spark, "blob-ledger"), rules)
