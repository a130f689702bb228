"""One query per operator, each over whole tables: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import checks.fixtures as fx
from wireloom.functions import addresses, binary, ratios, sql, trigrams
from wireloom.operators import (
    clusters,
    decode,
    direction,
    features,
    keywords,
    models,
    profiles,
    reports,
    tcp,
    udp,
)
from wireloom.plans import jobs
from wireloom.plans.staging import compact, emptied, new_path, stage
from wireloom.sources import capture, tables
from wireloom.sources.keyed import KeyedTable
from wireloom.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]

UDP_GAP = 21_600_000_000
SESSION = [*addresses.FLOW, "sid_ts"]


def significant(x: Column | str) -> Column:
    """Nine significant digits: sums of doubles differ in the last bits between engines."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(x.isNotNull(), F.format_string("%.8e", x).cast("double"))


def _packets(spark: SparkSession, sf: str) -> DataFrame:
    return fx.packet_table(spark, sf)


def _tagged(spark: SparkSession, sf: str) -> DataFrame:
    return tcp.tag_sessions(_packets(spark, sf))


def _frames(spark: SparkSession, sf: str) -> DataFrame:
    return fx.frame_table(spark, sf)


# --- sources, filters --------------------------------------------------------------------------


def s1_scan_project(spark: SparkSession, sf: str) -> DataFrame:
    return tables.scan(spark, f"{sf}/customer.parquet", ["c_custkey", "c_name"])


def s2_capture_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """All frames written as captures, read and decoded; captures are gone when their packets are stored."""
    for module in (capture, fx):
        cloudpickle.register_pickle_by_value(module)
    out = new_path(spark, "ingested")
    for frames in fx.frame_rounds(spark, sf):
        path = new_path(spark, "captures")
        fx.write_captures(frames, path)
        raw = capture.read_captures(spark, path, range_bytes=1024 * 1024)
        packets = decode.decoded_packets(raw).select(
            "t", "si", "sp", "di", "dp", "pr", "tcp_flags", "seq", "ack", "pkt_len", "pld_len"
        )
        compact(packets.write).mode("append").parquet(out)
        emptied(spark, path)
    return spark.read.schema(packets.schema).parquet(out)


def s4_table_write(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "written")
    tables.write(_packets(spark, sf), path, ["rowkey", "t", "pkt_len"])
    return tables.scan(spark, path)


def s5_catalog_write(spark: SparkSession, sf: str) -> DataFrame:
    records = fx.table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("key"), F.col("c_name").alias("r")
    )
    path = new_path(spark, "records")
    tables.write_records(tables.with_literal(records, "p", b"\x01"), path)
    return tables.scan(spark, path, schema=tables.CATALOG_RECORDS).select(
        "key", "r", F.hex("p").alias("p")
    )


def s7_preview(spark: SparkSession, sf: str) -> DataFrame:
    raw = _frames(spark, sf).select(binary.fixed_width(F.col("rowkey"), 8).alias("rowkey"), "r")
    return tables.preview(raw, "rowkey", "r", 2)


def p6_literal(spark: SparkSession, sf: str) -> DataFrame:
    named = fx.table(spark, sf, "customer").select("c_custkey")
    return tables.with_literal(named, "p", b"\x01").select("c_custkey", F.hex("p").alias("p"))


def x5_non_null(spark: SparkSession, sf: str) -> DataFrame:
    p = _packets(spark, sf)
    with_sid = tables.merge_by_key(p.select("rowkey"), _tagged(spark, sf).select("rowkey", "sid_ts"))
    return tables.present(with_sid, "sid_ts")


def x6_key_filter(spark: SparkSession, sf: str) -> DataFrame:
    return tables.with_key(fx.table(spark, sf, "customer"), "c_custkey", 42).select(
        "c_custkey", "c_name"
    )


def x6_session_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of the clients on every fiftieth port, by their row keys, out of the stored session table."""
    some = fx.session_table(spark, sf).where("least(sport, dport) % 2 = 0 and greatest(sport, dport) % 50 = 0")
    found = fx.keyed_sessions(spark, sf).lookup_all(some.select("rowkey"))
    return _hex_row(found.select("rowkey", "sport", "dport", "sid_ts"))


def x7_prefix_filter(spark: SparkSession, sf: str) -> DataFrame:
    return tables.with_prefix(fx.table(spark, sf, "part"), "p_type", "S").select(
        "p_partkey", "p_type"
    )


def x2_udp_only(spark: SparkSession, sf: str) -> DataFrame:
    both = _packets(spark, sf).select("rowkey", "t", "pr")
    both = both.unionByName(fx.udp_packets(spark, sf).select("rowkey", "t", "pr"))
    return udp.udp_only(both)


def x3_handshake_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return tcp.handshake_candidates(_packets(spark, sf)).select("rowkey", "tcp_flags")


def x4_stop_packets(spark: SparkSession, sf: str) -> DataFrame:
    return tcp.stop_packets(_packets(spark, sf)).select("rowkey", "t", "tcp_flags")


def x8_range(spark: SparkSession, sf: str) -> DataFrame:
    p = _packets(spark, sf)
    ratio = ratios.feature_ratio(F.col("pld_len").cast("double"), F.col("pkt_len").cast("double"))
    return tables.with_range(p.select("rowkey", ratio.alias("ratio")), "ratio", 0.5, 1.0)


# --- decode, marks -----------------------------------------------------------------------------


def p1_five_tuple(spark: SparkSession, sf: str) -> DataFrame:
    return decode.five_tuple(fx.mixed_frame_table(spark, sf)).drop("r")


def x1_decode_succeeded(spark: SparkSession, sf: str) -> DataFrame:
    kept = decode.decode_succeeded(fx.mixed_frame_table(spark, sf))
    return kept.select("rowkey", "t", F.length("r").alias("n_bytes"))


def p2_canonical_mark(spark: SparkSession, sf: str) -> DataFrame:
    mark = addresses.flow_mark(F.col("lo"), F.col("hi"), F.col("pr"))
    return _packets(spark, sf).select("rowkey", binary.hex_lower(mark).alias("fm"))


def p3_packet_features(spark: SparkSession, sf: str) -> DataFrame:
    return decode.packet_features(fx.mixed_frame_table(spark, sf)).withColumn(
        "payload", binary.hex_lower(F.col("payload"))
    )


def p4_packet_direction(spark: SparkSession, sf: str) -> DataFrame:
    d = decode.packet_direction(_packets(spark, sf))
    return d.select(
        "rowkey",
        F.col("direction.src.ip").alias("sip"),
        F.col("direction.src.port").alias("sport"),
        F.col("direction.dst.ip").alias("dip"),
        F.col("direction.dst.port").alias("dport"),
        F.col("direction.proto").alias("proto"),
    )


def p5_tcp_payload(spark: SparkSession, sf: str) -> DataFrame:
    packets = decode.decoded_packets(fx.mixed_frame_table(spark, sf))
    payload = decode.tcp_payload(packets)
    return payload.select("rowkey", binary.hex_lower(F.col("tcp_payload")).alias("tcp_payload"))


def p7_features_long(spark: SparkSession, sf: str) -> DataFrame:
    long = profiles.features_long(fx.session_table(spark, sf), "rowkey")
    return long.select(binary.hex_lower(F.col("rowkey")).alias("rowkey"), "pos", "name", "value")


def p8_feature_columns(spark: SparkSession, sf: str) -> DataFrame:
    columns = profiles.feature_columns(fx.session_table(spark, sf), "m")
    return columns.select(
        binary.hex_lower(F.col("m")).alias("m"), "pos", "name", "n", significant("total").alias("total")
    )


# --- sessions ----------------------------------------------------------------------------------


def j1_handshake_join(spark: SparkSession, sf: str) -> DataFrame:
    return tcp.handshakes_any(_packets(spark, sf))


def j2_asof_tag(spark: SparkSession, sf: str) -> DataFrame:
    return tcp.tag_any(_packets(spark, sf)).select("rowkey", "sid_ts")


def j3_tcp_handshakes(spark: SparkSession, sf: str) -> DataFrame:
    return tcp.handshakes_latest(_packets(spark, sf))


def j4_tcp_sessions(spark: SparkSession, sf: str) -> DataFrame:
    sid = addresses.session_id(*(F.col(c) for c in SESSION))
    return _tagged(spark, sf).select("rowkey", "sid_ts", binary.hex_lower(sid).alias("sid"))


def j6_key_merge(spark: SparkSession, sf: str) -> DataFrame:
    p = _packets(spark, sf)
    tagged = _tagged(spark, sf).select("rowkey", "sid_ts")
    sizes = p.select("rowkey", "pkt_len")
    return tables.merge_by_key(p.select("rowkey", "t"), sizes, tagged)


def j6_keyed_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Two batches with common and new keys put into a stored table, the second one twice."""
    p, number = _packets(spark, sf), F.col("rowkey") % 3
    columns = ["rowkey", "t", "pkt_len", "pld_len", "tcp_flags"]
    table = KeyedTable(new_path(spark, "keyed"), p.select(*columns).schema, prefixes=64).create(spark)
    table.upsert(p.where(number != 0).select("rowkey", "t", "pkt_len"), "first")
    more = p.where(number != 1).select("rowkey", (F.col("t") + 1).alias("t"), F.nullif("pld_len", F.lit(0)).alias("pld_len"), "tcp_flags")
    for _ in range(2):
        table.upsert(more, "second")
    return table.read(spark)


def j6_bucketed_merge(spark: SparkSession, sf: str) -> DataFrame:
    """The merge of ``j6_key_merge`` over tables that lie in buckets of the key."""
    p = _packets(spark, sf)
    base = fx.bucketed(spark, sf, "times", lambda: p.select("rowkey", "t"))
    sizes = fx.bucketed(spark, sf, "sizes", lambda: p.select("rowkey", "pkt_len"))
    tags = fx.bucketed(spark, sf, "tags", lambda: _tagged(spark, sf).select("rowkey", "sid_ts"))
    return tables.merge_buckets(base, sizes, tags)


def u2_markers(spark: SparkSession, sf: str) -> DataFrame:
    return tcp.session_markers(_packets(spark, sf))


def u3_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return tcp.distinct_sessions(_tagged(spark, sf))


def w1_udp_sessions(spark: SparkSession, sf: str) -> DataFrame:
    tagged = udp.tag_sessions(fx.udp_packets(spark, sf), UDP_GAP, ["fm"])
    return tagged.select("rowkey", "fm", "sid_ts")


def w1_udp_sessions_60us(spark: SparkSession, sf: str) -> DataFrame:
    tagged = udp.tag_sessions(fx.udp_packets(spark, sf), keys=["fm"])
    return tagged.select("rowkey", "fm", "sid_ts")


def w2_interarrival(spark: SparkSession, sf: str) -> DataFrame:
    return features.interarrival(_tagged(spark, sf)).select("rowkey", "iat")


def w3_direction(spark: SparkSession, sf: str) -> DataFrame:
    mark = addresses.endpoint_mark(F.col("server"), F.col("pr"))
    return direction.packet_directions(_tagged(spark, sf)).select(
        "rowkey", "direction", binary.hex_lower(mark).alias("m")
    )


def w4_client_side(spark: SparkSession, sf: str) -> DataFrame:
    return direction.client_side(_tagged(spark, sf)).select("rowkey", "client_sent")


def w5_duration(spark: SparkSession, sf: str) -> DataFrame:
    return features.session_duration(_tagged(spark, sf))


def a1_session_features(spark: SparkSession, sf: str) -> DataFrame:
    return features.session_features_wide(_tagged(spark, sf)).drop("first_lo")


def a1_session_features_corrected(spark: SparkSession, sf: str) -> DataFrame:
    wide = features.session_features_wide(_tagged(spark, sf), corrected=True)
    return wide.select(*SESSION, "var_pkt_len", "sc_var_pkt_len", "cs_var_pkt_len")


def a1_session_table(spark: SparkSession, sf: str) -> DataFrame:
    s = fx.session_table(spark, sf)
    return s.select(
        binary.hex_lower(F.col("rowkey")).alias("rowkey"),
        "sport",
        "dport",
        binary.hex_lower(F.col("direction")).alias("direction"),
        binary.hex_lower(F.col("m")).alias("m"),
        F.size("features_name").alias("names"),
        F.array_join("features_name", ",").alias("features_name"),
    )


def a2_direction_stats(spark: SparkSession, sf: str) -> DataFrame:
    return features.direction_statistics(_tagged(spark, sf))


# --- profiles, models --------------------------------------------------------------------------


def a3_profiles(spark: SparkSession, sf: str) -> DataFrame:
    long = profiles.profile_features(fx.session_table(spark, sf))
    return long.select(
        binary.hex_lower(F.col("m")).alias("m"), "pos", "name", "frac", significant("mean").alias("mean")
    )


def t1_top_features(spark: SparkSession, sf: str) -> DataFrame:
    top = profiles.top_features_long(fx.profile_table(spark, sf), "m")
    return top.withColumn("m", binary.hex_lower(F.col("m"))).withColumn("mean", significant("mean"))


def _hex_row(df: DataFrame) -> DataFrame:
    return df.withColumn("rowkey", binary.hex_lower(F.col("rowkey")))


def t2_model_match(spark: SparkSession, sf: str) -> DataFrame:
    known, candidates = fx.model_split(fx.profile_table(spark, sf))
    return _hex_row(models.match_profiles(candidates, known))


def t2_model_match_large(spark: SparkSession, sf: str) -> DataFrame:
    """Every tenth client's profile against the models of all others."""
    known, candidates = fx.client_split(fx.client_profile_table(spark, sf), "c % 10 = 0")
    return _hex_row(models.match_profiles(candidates, known))


def t3_new_models(spark: SparkSession, sf: str) -> DataFrame:
    """New models for the clients that none of a few known ones fits."""
    known, candidates = fx.client_split(fx.client_profile_table(spark, sf), "c % 50 <> 0")
    matched = stage(models.match_profiles(candidates, known), "matched")
    return _hex_row(models.new_assignments(candidates, matched, known))


def u1_union_assignments(spark: SparkSession, sf: str) -> DataFrame:
    known, candidates = fx.model_split(fx.profile_table(spark, sf))
    matched = stage(models.match_profiles(candidates, known), "matched")
    new = models.new_assignments(candidates, matched, known)
    return _hex_row(models.union_assignments(new, matched))


def t4_identify(spark: SparkSession, sf: str) -> DataFrame:
    known, _ = fx.model_split(fx.profile_table(spark, sf))
    return _hex_row(models.identify_sessions(fx.session_table(spark, sf), known))


def t4_identify_large(spark: SparkSession, sf: str) -> DataFrame:
    """All sessions against the profiles of every tenth client as models."""
    known, _ = fx.client_split(fx.client_profile_table(spark, sf), "c % 10 <> 0")
    return _hex_row(models.identify_sessions(fx.session_table(spark, sf), known))


def t5_profile_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return _hex_row(clusters.cluster_profiles(fx.profile_table(spark, sf)))


def a11_cluster_sizes(spark: SparkSession, sf: str) -> DataFrame:
    found = stage(clusters.cluster_profiles(fx.vector_profiles(spark, sf)), "clusters")
    return _hex_row(clusters.cluster_members(found))


def train_job(spark: SparkSession, sf: str) -> DataFrame:
    known, _ = fx.model_split(fx.profile_table(spark, sf))
    trained = jobs.train(fx.session_table(spark, sf), known)
    return _hex_row(trained.profiles.select("rowkey", "id"))


def t2_vector_match(spark: SparkSession, sf: str) -> DataFrame:
    """Matching on signed vectors that mostly do not fit."""
    known, candidates = fx.vector_split(fx.vector_profiles(spark, sf))
    return _hex_row(models.match_profiles(candidates, known))


def t3_vector_models(spark: SparkSession, sf: str) -> DataFrame:
    known, candidates = fx.vector_split(fx.vector_profiles(spark, sf))
    matched = stage(models.match_profiles(candidates, known), "matched")
    return _hex_row(models.new_assignments(candidates, matched, known))


def t5_vector_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return _hex_row(clusters.cluster_profiles(fx.vector_profiles(spark, sf)))


def t5_pivot_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters whose members all resemble their pivot."""
    found = _hex_row(clusters.pivot_clusters(fx.vector_profiles(spark, sf)))
    return found.withColumn("pivot", binary.hex_lower(F.col("pivot")))


# --- reports -----------------------------------------------------------------------------------


def a4_session_report(spark: SparkSession, sf: str) -> DataFrame:
    return reports.session_report(_packets(spark, sf), _tagged(spark, sf))


def t8_extreme_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return reports.extreme_sessions(_tagged(spark, sf))


def a5_udp_report(spark: SparkSession, sf: str) -> DataFrame:
    tagged = udp.tag_sessions(fx.udp_packets(spark, sf), UDP_GAP, ["fm"])
    return reports.udp_report(tagged, ["fm"])


def a6_sessions_per_endpoint(spark: SparkSession, sf: str) -> DataFrame:
    return reports.sessions_per_endpoint(fx.session_table(spark, sf))


def a7_distinct_endpoints(spark: SparkSession, sf: str) -> DataFrame:
    return reports.distinct_endpoints(fx.session_table(spark, sf))


def a7_endpoint_digest(spark: SparkSession, sf: str) -> DataFrame:
    return reports.endpoint_digest(fx.session_table(spark, sf))


def a8_endpoint_directions(spark: SparkSession, sf: str) -> DataFrame:
    return keywords.endpoint_directions(fx.payload_table(spark, sf))


def a10_counters(spark: SparkSession, sf: str) -> DataFrame:
    p = _packets(spark, sf)
    return reports.job_counters(p, _tagged(spark, sf), tcp.handshakes_latest(p))


def a10_job_counters(spark: SparkSession, sf: str) -> DataFrame:
    """The counts of ``a10_counters`` as the preprocess job takes them on its way."""
    counters = jobs.preprocess(_frames(spark, sf)).counters
    return spark.createDataFrame([tuple(counters.values())], ", ".join(f"{n} bigint" for n in counters))


def t7_first_rows(spark: SparkSession, sf: str) -> DataFrame:
    return tables.first_rows(_packets(spark, sf).select("rowkey", "t", "pkt_len"), "rowkey", 10)


# --- keywords ----------------------------------------------------------------------------------


def _shares(spark: SparkSession, sf: str) -> DataFrame:
    return fx.stored(
        spark, sf, "shares", lambda: keywords.keyword_shares(fx.payload_table(spark, sf))
    )


def f11_trigrams(spark: SparkSession, sf: str) -> DataFrame:
    return (
        keywords.trigram_rows(fx.payload_table(spark, sf), "m")
        .groupBy("m", "gram")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("m", F.hex("gram").alias("item"), "n")
    )


def f12_byte_slices(spark: SparkSession, sf: str) -> DataFrame:
    items = trigrams.byte_slices(F.col("payload"), 2)
    return (
        fx.payload_table(spark, sf)
        .select(F.explode(items).alias("item"))
        .groupBy("item")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def a9_keyword_share(spark: SparkSession, sf: str) -> DataFrame:
    return keywords.keyword_shares(fx.payload_table(spark, sf))


def _sessions(spark: SparkSession, sf: str) -> DataFrame:
    return keywords.sessions(fx.payload_table(spark, sf))


def n1_frequent_sets(spark: SparkSession, sf: str) -> DataFrame:
    sets = keywords.frequent_sets(_shares(spark, sf), _sessions(spark, sf))
    return sets.select("m", "direction", F.array_join("items", ",").alias("items"), "size", "freq")


def n1_fpgrowth_full(spark: SparkSession, sf: str) -> DataFrame:
    sets = keywords.fp_growth_sets(_shares(spark, sf), _sessions(spark, sf))
    return sets.select("m", "direction", F.array_join("items", ",").alias("items"), "size", "freq")


def n1_level_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Sets of up to three items, level by level."""
    sets = keywords.frequent_sets(_shares(spark, sf), _sessions(spark, sf), max_size=3)
    return sets.select("m", "direction", F.array_join("items", ",").alias("items"), "size", "freq")


def n1_closed_sets(spark: SparkSession, sf: str) -> DataFrame:
    """The sets from which all others follow; of equal frequency only the largest."""
    closed = keywords.closed_sets(_shares(spark, sf), _sessions(spark, sf))
    return closed.select("m", "direction", F.array_join("items", ",").alias("items"), "size", "freq")


def n2_sample(spark: SparkSession, sf: str) -> DataFrame:
    return keywords.sample_transactions(_sessions(spark, sf))


def n3_keywords(spark: SparkSession, sf: str) -> DataFrame:
    return _hex_row(keywords.keywords(_shares(spark, sf), _sessions(spark, sf)))


# --- scalar functions --------------------------------------------------------------------------


def f_hash(spark: SparkSession, sf: str) -> DataFrame:
    """digest, hex both ways, Base64."""
    mark = addresses.flow_mark(F.col("lo"), F.col("hi"), F.col("pr"))
    digest = binary.md5_bytes(mark)
    return _packets(spark, sf).select(
        "rowkey",
        binary.hex_lower(digest).alias("digest"),
        F.base64(mark).alias("b64"),
        binary.hex_lower(binary.from_hex(F.hex(mark))).alias("back"),
    )


def f_bytes(spark: SparkSession, sf: str) -> DataFrame:
    """slices, fixed width, spaced hex, printable, integers, time."""
    marked = _packets(spark, sf).withColumns(
        {
            "mark": addresses.flow_mark(F.col("lo"), F.col("hi"), F.col("pr")),
            "source": F.concat(
                binary.fixed_width(F.col("si"), 4), binary.fixed_width(F.col("sp"), 2)
            ),
        }
    )
    mark, source = F.col("mark"), F.col("source")
    return marked.select(
        "rowkey",
        binary.hex_lower(F.substring(mark, 5, 2)).alias("port_slice"),
        binary.hex_lower(binary.fixed_width(F.col("t"), 8)).alias("t8"),
        binary.hex_spaced(mark).alias("spaced"),
        binary.printable(mark).alias("shown"),
        binary.unsigned(source).alias("source_unsigned"),
        binary.signed(source, 6).alias("source_signed"),
        binary.timestamp_us(F.col("t") / 1000000, F.col("t") % 1000000).alias("t_again"),
    )


def f_labels(spark: SparkSession, sf: str) -> DataFrame:
    """F8, F15: dotted addresses, endpoint labels, formatted ids."""
    return _packets(spark, sf).select(
        "rowkey",
        addresses.dotted(F.col("si")).alias("sip"),
        addresses.endpoint_label(
            addresses.endpoint_key(F.col("di"), F.col("dp")), F.col("pr")
        ).alias("endpoint"),
        models.model_id(F.col("sp") % 2000).alias("id"),
    )


def f_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """F16, F17: truncated mean, power, root, xor and the guarded ratio."""
    a, b = F.col("pld_len").cast("double"), (F.col("pkt_len") - 154).cast("double")
    unknown = F.when(F.col("tcp_flags") != 2, b)
    return _packets(spark, sf).select(
        "rowkey",
        ratios.feature_ratio(a, unknown).alias("ratio"),
        F.call_function("div", F.col("t"), F.col("pkt_len").cast("bigint")).alias("truncated"),
        F.sqrt(F.pow(a, F.lit(2.0))).alias("root"),
        (F.col("pkt_len").bitwiseXOR(F.lit(2))).alias("flipped"),
    )


# --- SQL text ----------------------------------------------------------------------------------


def sql_endpoints(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of each endpoint, from the stored session table as a view."""
    fx.session_table(spark, sf)
    sql.view(sql.register(spark), "stored_sessions", fx.table_path(spark, sf, "sessions"))
    return spark.sql("SELECT endpoint_label(server, pr) AS endpoint, count(*) AS sessions FROM stored_sessions GROUP BY server, pr")


def sql_flow_ratios(spark: SparkSession, sf: str) -> DataFrame:
    """Mark and ratio of every packet with payload, from the stored packet table as a view."""
    fx.packet_table(spark, sf)
    sql.view(sql.register(spark), "stored_packets", fx.table_path(spark, sf, "packets"))
    return spark.sql("""
        SELECT rowkey, dotted(si) AS sip, hex_lower(flow_mark(lo, hi, pr)) AS fm,
               feature_ratio(pld_len, pkt_len - 154) AS ratio
        FROM stored_packets WHERE pld_len > 0""")


# --- streaming ---------------------------------------------------------------------------------


def _record_stream(spark: SparkSession, sf: str) -> DataFrame:
    """A stream of the files of the frame table: records with time keys and frames as values."""
    schema = _frames(spark, sf).schema
    stream = spark.readStream.schema(schema).parquet(fx.table_path(spark, sf, "frames"))
    return stream.select(
        binary.fixed_width(F.col("t"), 8).alias("key"),
        F.col("r").alias("value"),
        F.lit(0).alias("partition"),
        F.col("rowkey").alias("offset"),
    )


def k1_stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Records with time keys and frames as values, streamed from files into the packet table."""
    sink, checkpoint = (new_path(spark, n) for n in ("ingested", "stream"))
    query = ingest.write_stream(ingest.raw_packets(_record_stream(spark, sf)), sink, checkpoint, interval=None)
    query.awaitTermination()
    return spark.read.schema(tables.RAW_PACKETS).parquet(sink).select(
        binary.hex_lower(F.col("rowkey")).alias("rowkey"), "t", F.length("r").alias("pkt_len")
    )


def k3_keyed_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same records streamed into a keyed table, of which a second stream brings a part again."""
    path, mark = (new_path(spark, n) for n in ("keyed-packets", "stream"))
    table = KeyedTable(path, tables.RAW_PACKETS, prefixes=64).create(spark)
    records = _record_stream(spark, sf)
    for part, some in (("all", records), ("again", records.where("offset % 10 = 0"))):
        ingest.upsert_stream(ingest.raw_packets(some), table, f"{mark}/{part}", part, interval=None).awaitTermination()
    return table.read(spark).select(
        binary.hex_lower(F.col("rowkey")).alias("rowkey"), "t", F.length("r").alias("pkt_len")
    )


def preprocess_job(spark: SparkSession, sf: str) -> DataFrame:
    """Decode, mark, sessions, directions and merge in one job, from raw frames."""
    done = jobs.preprocess(_frames(spark, sf))
    return done.packets.select(
        "rowkey",
        binary.hex_lower(F.col("fm")).alias("fm"),
        binary.hex_lower(F.col("sid")).alias("sid"),
        "direction",
        binary.hex_lower(F.col("m")).alias("m"),
    )


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        s1_scan_project, s2_capture_ingest, s4_table_write, s5_catalog_write, s7_preview,
        p1_five_tuple, p2_canonical_mark, p3_packet_features, p4_packet_direction, p5_tcp_payload,
        p6_literal, p7_features_long, p8_feature_columns,
        x1_decode_succeeded, x2_udp_only, x3_handshake_candidates, x4_stop_packets, x5_non_null, x6_key_filter, x6_session_lookup,
        x7_prefix_filter, x8_range,
        j1_handshake_join, j2_asof_tag, j3_tcp_handshakes, j4_tcp_sessions, j6_key_merge, j6_keyed_upsert, j6_bucketed_merge,
        u1_union_assignments, u2_markers, u3_distinct,
        w1_udp_sessions, w1_udp_sessions_60us, w2_interarrival, w3_direction, w4_client_side,
        w5_duration,
        a1_session_features, a1_session_features_corrected, a1_session_table, a2_direction_stats,
        a3_profiles, a4_session_report, a5_udp_report, a6_sessions_per_endpoint,
        a7_distinct_endpoints, a7_endpoint_digest, a8_endpoint_directions, a9_keyword_share,
        a10_counters, a10_job_counters, a11_cluster_sizes,
        t1_top_features, t2_model_match, t2_model_match_large, t3_new_models, t4_identify,
        t4_identify_large, t2_vector_match, t3_vector_models, t5_vector_clusters, t5_pivot_clusters, t5_profile_clusters, t7_first_rows, t8_extreme_sessions,
        n1_frequent_sets, n1_fpgrowth_full, n1_level_sets, n1_closed_sets, n2_sample, n3_keywords,
        f_hash, f_bytes, f_labels, f_ratio, f11_trigrams, f12_byte_slices, sql_endpoints, sql_flow_ratios,
        k1_stream_ingest, k3_keyed_stream, preprocess_job, train_job,
    )
}
