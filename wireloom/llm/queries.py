"""The registered queries of this folder and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wireloom.llm import (
    bpe,
    decontaminate,
    exact_dedup,
    langid,
    license_scan,
    merkle,
    pii,
    quality,
    secret_scan,
    simhash,
    url_filter,
    warc,
    whitening,
)
from wireloom.llm.common import LOWER, UPPER, ready

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def sql_lower(text: str) -> str:
    return f"translate({text}, '{UPPER}', '{LOWER}')"


@query
def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge_urls(_read(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select(
        "page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict",
        "judged.strict_hits", "judged.soft_hits",
    )


def _op1_sql() -> str:
    def hits(terms: tuple[str, ...]) -> str:
        one = r"regexp_matches(u, '(^|[^a-z0-9]){}($|[^a-z0-9])')::int"
        return " + ".join(one.format(t) for t in terms)

    def fits(r: url_filter.Rule) -> str:
        return f"(host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}')"

    longest = sorted(url_filter.RULES, key=lambda r: -len(r.text))
    rule = " ".join(f"when {fits(r)} then '{r.text}'" for r in longest)
    said = " ".join(f"when {fits(r)} then '{r.verdict}'" for r in longest)
    return rf"""
    with a as (select page_id, {sql_lower("coalesce(url, '')")} u, coalesce(url, '') raw from pages),
    b as (select *, case when strpos(raw, '://') > 0 then substr(raw, strpos(raw, '://') + 3) else '' end rest from a),
    c as (select *, {sql_lower("regexp_extract(rest, '^[^/?#]*')")} host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from b),
    d as (select *, {hits(url_filter.STRICT)} strict_hits, {hits(url_filter.SOFT)} soft_hits from c)
    select page_id, host, path, case {rule} end as rule, case {said} else
           case when 2 * strict_hits + soft_hits >= 2 then 'block' else 'allow' end end as verdict,
           strict_hits, soft_hits
    from d"""


ORACLES["op1_url_filters"] = _op1_sql()


@query
def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def decontamination_digests(rows: DataFrame) -> DataFrame:
    items = F.array_join(F.array_sort("_items"), ",")
    return rows.select(
        F.col("_c0").alias("doc_id"),
        F.col("_n_words").alias("n_words"),
        F.col("_n_hit").alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(items, 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


@query
def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination_digests(
        decontaminate.decontamination(docs, _read(spark, sf_dir, "benchmark"))
    )


WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def decontamination_sql(documents: str) -> str:
    """Per document of a relation with doc_id and text: the columns of the contract."""
    return rf"""
    w as (select doc_id, regexp_extract_all({sql_lower("coalesce(text, '')")}, '{WORD}') w from {documents}),
    i as (select item_id, regexp_extract_all({sql_lower("coalesce(text, '')")}, '{WORD}') w from benchmark),
    m as (select item_id, w, least(13, len(w)) n from i where len(w) > 0),
    iw as (select distinct item_id, n, array_to_string(w[k:k + n - 1], ' ') g
           from (select item_id, n, w, unnest(range(1, len(w) - n + 2)) k from m)),
    dw as (select doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') g
           from (select doc_id, n, w, unnest(range(1, len(w) - n + 2)) k
                 from w, (select distinct n from m) where len(w) >= n)),
    hit as (select doc_id, item_id, dw.n, k from dw join iw using (n, g)),
    words as (select doc_id, count(distinct p) n_hit
              from (select doc_id, unnest(range(k, k + n)) p from (select distinct doc_id, n, k from hit)) group by 1),
    items as (select doc_id, count(*) n_items, string_agg(item_id, ',' order by item_id) l
              from (select distinct doc_id, item_id::varchar item_id from hit) group by 1),
    judged as (
    select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
           sha256(coalesce(l, '')) as items_sha256,
           coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
    from w left join words using (doc_id) left join items using (doc_id))"""


ORACLES["op4_benchmark_decontamination"] = f"with {decontamination_sql('documents')} select * from judged"


@query
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(_read(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLES["op6_exact_dedup"] = """
    select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
           doc_id = max(doc_id) over g as kept, sha256(coalesce(text, '')) as text_sha256
    from documents window g as (partition by coalesce(text, ''))"""


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = langid.fit_on_rest(docs)
    found = docs.select("doc_id", langid.labelled(docs, model).alias("found"))
    return found.select(
        "doc_id", langid.held_out().alias("held_out"), F.col("found.lang").alias("lang_pred"), "found.score"
    )


def token_digests(docs: DataFrame) -> DataFrame:
    """Encode and decode every text: doc_id, n_tokens and the digests of ids and decoded text."""
    tokens = public_tokenizers.path("byte_bpe_50k.json")
    narrow = docs.select("doc_id", "text")
    coded = bpe.encoded(narrow, tokens, bpe.build_lexicon(narrow, tokens), check=True)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op10_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(_read(spark, sf_dir, "documents"))


@query
def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    ledger = secret_scan.new_ledger(spark)
    ledger.scan(docs)
    found = F.col("found")
    base = F.filter(found, lambda f: f["number"] < len(secret_scan.BASE))

    def n(kind: str):
        return F.size(F.filter(found, lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return ledger.report(docs, "doc_id").select(
        "doc_id", *(n(r.kind) for r in secret_scan.BASE),
        F.sha2(secret_scan.spans_text(base), 256).alias("base_sha256"),
        secret_scan.spans_text(found).alias("spans"),
    )


def _op5_sql() -> str:
    def one(number: int, r: secret_scan.Rule) -> str:
        p = r.pattern.replace("'", "''")
        return f"""select doc_id, {number} no, '{r.kind}' kind, {r.least} least, regexp_split_to_array(t, '{p}') g,
            regexp_extract_all(t, '{p}', 0) m, regexp_extract_all(t, '{p}', {r.group}) v from d"""

    every = " union all ".join(one(i, r) for i, r in enumerate(secret_scan.RULES))
    return f"""
    with d as (select doc_id, coalesce(text, '') t from documents), a as ({every}),
    b as (select *, unnest(range(1, len(m) + 1)) i from a),
    c as (select doc_id, no, kind, length(v[i]) >= least fits, length(m[i]) size,
                 length(array_to_string(g[1:i], '')) + length(array_to_string(m[1:i - 1], '')) s from b),
    f as (select doc_id, no, kind, s::bigint s, kind || ':' || s::bigint || ':' || (s + size)::bigint x from c where fits),
    g as (select doc_id, count(*) filter (kind = 'assign') n_assign, count(*) filter (kind = 'access') n_access,
                 count(*) filter (kind = 'hex') n_hex, string_agg(x, ',' order by s, no) filter (no < 3) base,
                 string_agg(x, ',' order by s, no) spans from f group by 1)
    select doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex,
           sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans
    from d left join g using (doc_id)"""


ORACLES["op5_secret_scans"] = _op5_sql()


@query
def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(_read(spark, sf_dir, "documents"))
    places, base = F.col("places"), license_scan.base_places(F.col("places"))
    n = F.size(base).cast("long")
    return found.select(
        "doc_id", "n_words", n.alias("n_base"),
        F.when(n > 0, F.get(base, F.lit(0))["start"].cast("long")).alias("first_word"),
        F.when(n > 0, F.get(base, (n - 1).cast("int"))["start"].cast("long")).alias("last_word"),
        license_scan.labels(base).alias("base_labels"),
        license_scan.labels(places).alias("labels"),
        F.coalesce(F.array_max(F.transform(places, lambda p: p["share"])), F.lit(0.0)).alias("score"),
    )


def _op8_sql() -> str:
    rows = []
    for number, t in enumerate(license_scan.TEMPLATES):
        own = t.words.split()
        key: set[int] = set()
        for phrase in t.keys:
            at = f" {t.words} ".index(f" {phrase} ")
            first = len(t.words[:at].split())
            key |= set(range(first, first + len(phrase.split())))
        rows += [f"({number}, '{t.label}', {t.base}, {len(own)}, {len(key)}, {i}, '{w}', {int(i in key)})" for i, w in enumerate(own)]
    return rf"""
    with t(template, label, base, size, keys, o, word, is_key) as (values {", ".join(rows)}),
    w as (select doc_id, regexp_extract_all({sql_lower("coalesce(text, '')")}, '{WORD}') w from documents),
    p as (select doc_id, unnest(w) word, unnest(range(len(w))) pos from w),
    s as (select doc_id, template, label, base, pos - o start, count(*) / size share
          from p join t using (word) group by doc_id, template, label, base, size, keys, pos - o
          having sum(is_key) = keys and count(*) / size >= {license_scan.LEAST_SHARE}),
    g as (select doc_id, count(*) filter (base) n_base, min(start) filter (base) first_word, max(start) filter (base) last_word,
                 string_agg(distinct label, ',' order by label) filter (base) base_labels,
                 string_agg(distinct label, ',' order by label) labels, max(share) score from s group by 1)
    select doc_id, len(w) n_words, coalesce(n_base, 0) n_base, first_word, last_word, coalesce(base_labels, '') base_labels,
           coalesce(labels, '') labels, coalesce(score, 0) score from w left join g using (doc_id)"""


ORACLES["op8_license_scans"] = _op8_sql()


@query
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The table has no capture times; one second per id stands for them.
    time = F.timestamp_seconds(1_600_000_000 + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(100_000_000)))
    captures = _read(spark, sf_dir, "pages").select(
        F.col("page_id").alias("id"), "url", F.col("html").alias("payload"), time.alias("time")
    )
    return warc.archived(captures).select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def _op7_sql() -> str:
    parts = " || ".join(
        f"to_base(('0x' || substr(d, {5 * i + 1}, 5))::bigint, 32, 4)" for i in range(8)
    )
    return f"""
    with a as (select page_id, encode(coalesce(html, '')) p from pages),
    b as (select page_id, octet_length(p) n, sha1(p) d, max(page_id) over (partition by p) last from a)
    select page_id, n as payload_bytes,
           translate(upper({parts}), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') as payload_digest,
           case when page_id = last then 'response' else 'revisit' end as record_type,
           case when page_id <> last then last end as refers_to
    from b"""


ORACLES["op7_warc"] = _op7_sql()


@query
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, id = F.col("text"), F.col("doc_id")
    hit = F.crc32(id.cast("string").cast("binary")) % 2 == 0
    cut = F.when(hit, F.translate(text, "\n", "")).otherwise(text)
    changed = merkle.leaf(id, F.col("source"), F.col("lang"), F.col("n_chars"), cut)
    rows = merkle.manifest(_read(spark, sf_dir, "documents"), also={"changed": changed})
    rows = rows.withColumn("folded_root", merkle.fold(F.col("changed"), F.col("path")))
    return rows.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def _sql_crc32(text: str) -> str:
    """Unsigned CRC-32 of a text, four bits at a time."""
    table = []
    for i in range(16):
        for _ in range(4):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        table.append(i)
    nibbles = f"flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c) & 15, ascii(c) >> 4]))"
    step = f"xor(a >> 4, ({table}::bigint[])[(xor(a, b) & 15) + 1])"
    return f"xor(list_reduce(list_transform({nibbles}, lambda v: v::bigint), lambda a, b: {step}, 4294967295::bigint), 4294967295::bigint)"


def _op13_sql() -> str:
    def part(c: str) -> str:
        return f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"

    head = " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars"))

    # Nodes of a tree t: g, level l, place p, size n of the level, digest d; paths of its leaves from below.
    def tree(t: str, leaves: str) -> str:
        return f"""
    {t}(g, l, p, n, d) as (
      select g, 0, p, n, d from {leaves} union all
      select g, l + 1, p // 3, (n + 2) // 3, sha256(string_agg(d, '' order by p)) from {t}
      where n > 1 group by g, l, n, p // 3),
    {t}_beside as (
      select g, l, a.p p, coalesce(string_agg(o.d, '' order by o.p) filter (o.p < a.p), '') le,
             coalesce(string_agg(o.d, '' order by o.p) filter (o.p > a.p), '') ri
      from {t} a join {t} o using (g, l) where o.p // 3 = a.p // 3 and a.n > 1 group by g, l, a.p)"""

    def walk(w: str, t: str, start: str) -> str:
        return f"""
    {w}(i, g, l, p, proof, f) as (
      select i, g, 0, p, proof, f from {start} union all
      select i, g, l + 1, p // 3, proof || le || ri, sha256(le || f || ri) from {w} join {t}_beside using (g, l, p))"""

    return rf"""
    with recursive docs as (
      select *, sha256({head} || {part("text")}) d,
             sha256({head} || case when hit then {part("translate(text, chr(10), '')")} else {part("text")} end) f
      from (select *, {_sql_crc32('doc_id::varchar')} % 2 = 0 hit from documents)),
    leaf as (select doc_id, coalesce('1' || source, '0') g, d, f,
             row_number() over (partition by source order by doc_id, d) - 1 p, count(*) over (partition by source) n from docs),
    {tree("a", "leaf")},
    sub as (select '' g, g s, d, row_number() over (order by g) - 1 p, count(*) over () n from a where n = 1),
    {tree("b", "sub")},
    {walk("u", "a", "(select row_number() over (order by g, p) i, g, p, '' proof, f from leaf)")},
    v as (select i, '' g, sub.p, proof, f from (select i, g s, max_by(proof, l) proof, max_by(f, l) f from u group by 1, 2) join sub using (s)),
    {walk("x", "b", "v")},
    z as (select i, max_by(proof, l) proof, max_by(f, l) f from x group by 1)
    select doc_id, leaf.d as leaf, sub.d as subroot, root, sha256(proof) as proof_sha256, z.f as folded_root, z.f = root as verified
    from (select *, row_number() over (order by g, p) i from leaf) leaf join sub on leaf.g = sub.s join z using (i),
         (select d root from b where n = 1)"""


ORACLES["op13_merkle_manifest"] = _op13_sql()


@query
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    fitted = whitening.fit(vectors)
    if fitted is None or not len(fitted.values):
        shape = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
        none = spark.createDataFrame([], shape)
        return vectors.select("vec_id").limit(0).join(none)
    explained = F.array(*(F.lit(float(e / fitted.trace)) for e in fitted.values))
    error = whitening.identity_error(vectors, fitted)
    return whitening.whitened(vectors, fitted).select(
        "vec_id", "component", F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("component") - 1).alias("explained"), F.lit(error).alias("identity_error"),
    )


@query
def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan(_read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < len(pii.BASE))

    def n(number: int):
        return F.size(F.filter("spans", lambda s: s["kind"] == number)).cast("long").alias(f"n_{pii.BASE[number]}")

    return found.select(
        "doc_id", *(n(i) for i in range(len(pii.BASE))),
        F.sha2(pii.spans_text(base), 256).alias("base_sha256"), pii.spans_text(F.col("spans")).alias("spans"),
    )
