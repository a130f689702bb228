"""Session features: 44 statistics per TCP session, in one map-side combined aggregation.

Means are truncated integers and variances are taken around them.  Both expand into sums that merge:
``sum((x - a)^2) = sum(x^2) - 2 a sum(x) + n a^2``, and the per-direction length term
``sum((x - a) xor 2)`` depends on ``x`` only through its sum and its remainders modulo 4.  So no
statistic needs a second pass over the packets, and every sum is exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wireloom.functions.addresses import (
    endpoint_bits,
    endpoint_mark,
    flow_mark,
    session_id,
)
from wireloom.functions.binary import md5_bytes
from wireloom.operators.direction import SESSION
from wireloom.plans.skew import CHUNK, running

# The feature names in order (their positions break ties between equal shares).
_MEASURES = ("pkt_len", "ts_IAT", "pld_len")
_STATISTICS = tuple(f"{stat}_{m}" for m in _MEASURES for stat in ("avg", "min", "max", "var"))
DIRECTION_STATISTICS = (*_STATISTICS, "total_bytes", "pkt_cnt")
SESSION_STATISTICS = (*_STATISTICS, "total_bytes", "sessn_dur", "pkts_cnt", "psh_cnt")
FEATURES = (
    *SESSION_STATISTICS,
    *(f"sc_{name}" for name in DIRECTION_STATISTICS),
    *(f"cs_{name}" for name in DIRECTION_STATISTICS),
)

PSH = 0x08


def interarrival(tagged: DataFrame) -> DataFrame:
    """Add ``iat``: time since the session's previous packet, null on its first."""
    spaced = running(
        tagged, SESSION, ("t", "rowkey"), {"prev_t": ("max", F.col("t"))}, inclusive=False
    )
    return spaced.withColumn("iat", F.col("t") - F.col("prev_t")).drop("prev_t")


def session_duration(tagged: DataFrame) -> DataFrame:
    return tagged.groupBy(*SESSION).agg((F.max("t") - F.min("t")).alias("sessn_dur"))


#: Columns of ``spaced``.
SPACING = ("iat", "side_iat", "sends_first")


def spaced(tagged: DataFrame) -> DataFrame:
    """Add ``iat`` and ``side_iat``, the gaps within the session and within the sender's side.

    ``sends_first`` is, on a session's first packet only, whether the ``lo`` endpoint sent it.  A table
    stored with these columns gives features without windows.
    """
    t = F.col("t")
    gaps = running(
        tagged,
        SESSION,
        ("t", "rowkey"),
        {
            "prev_lo": ("max", F.when(F.col("src_lo"), t)),
            "prev_hi": ("max", F.when(~F.col("src_lo"), t)),
        },
        inclusive=False,
    )
    prev = F.greatest("prev_lo", "prev_hi")
    side = F.when(F.col("src_lo"), F.col("prev_lo")).otherwise(F.col("prev_hi"))
    return gaps.withColumns(
        {
            "iat": t - prev,
            "side_iat": t - side,
            "sends_first": F.when(prev.isNull(), F.col("src_lo").cast("int")),
        }
    ).drop("prev_lo", "prev_hi")


def _squares(name: str, x: str) -> dict[str, str]:
    """Exact sum of squares of lengths, as bigint sums of the high and low half of each square."""
    return {
        f"{name}_hi": f"sum(shiftright({x} * {x}, 31))",
        f"{name}_lo": f"sum(({x} * {x}) & 2147483647)",
    }


def _gap_sums(gap: str) -> dict[str, str]:
    """As ``_squares``; only a gap over 35 minutes has a square that needs a decimal."""
    small = f"if({gap} < 2147483648, {gap}, null)"
    large = f"cast(if({gap} >= 2147483648, {gap}, null) as decimal(19,0))"
    return {
        "gap_min": f"min({gap})",
        "gap_max": f"max({gap})",
        **_squares("gap_sq", small),
        "gap_sq_wide": f"sum(cast({large} * {large} as decimal(38,0)))",
    }


def _side_sums(side: str) -> dict[str, str]:
    """Mergeable sums over the packets of one side."""
    size = f"if({side}, size, null)"
    payload = f"if({side} and payload > 0, payload, null)"
    t = f"if({side}, t, null)"
    return {
        "n": f"count({size})",
        "len": f"sum({size})",
        "len_min": f"min({size})",
        "len_max": f"max({size})",
        **_squares("len_sq", size),
        **{f"len_r{r}": f"count_if({side} and size % 4 = {r})" for r in (1, 2, 3)},
        "t_min": f"min({t})",
        "t_max": f"max({t})",
        **_gap_sums(f"if({side}, side_iat, null)"),
        "pld_n": f"count({payload})",
        "pld": f"sum({payload})",
        "pld_min": f"min({payload})",
        "pld_max": f"max({payload})",
        **_squares("pld_sq", payload),
    }


def _sum_of_squares(name: str, wide: bool = False) -> dict[str, str]:
    """The sum as a bigint (null if it might reach 2^60) and as a decimal (null otherwise)."""
    high, low = f"coalesce({name}_hi, 0L)", f"coalesce({name}_lo, 0L)"
    fits = f"{high} < {1 << 28}L and {low} < {1 << 59}L" + (f" and {name}_wide is null" if wide else "")
    large = f"cast(cast({high} as decimal(28,0)) * 2147483648 + {low} as decimal(38,0))"
    large += f" + coalesce({name}_wide, 0)" if wide else ""
    return {"sq": f"if({fits}, {high} * 2147483648L + {low}, null)", "sq_wide": f"if({fits}, null, {large})"}


def _side(p: str) -> str:
    """The sums of one side as a struct, with nothing read as 0."""
    plain = ("len_min", "len_max", "t_min", "t_max", "gap_min", "gap_max", "pld_min", "pld_max")
    counted = ("n", "len", "len_r1", "len_r2", "len_r3", "pld_n", "pld")
    fields = {name: f"{p}_{name}" for name in plain}
    fields |= {name: f"coalesce({p}_{name}, 0L)" for name in counted}
    for x in ("len", "pld", "gap"):
        fields |= {f"{x}_{kind}": e for kind, e in _sum_of_squares(f"{p}_{x}_sq", x == "gap").items()}
    return _struct(dict(sorted(fields.items())) | {"whole": "false"})


def _whole(lo: str, hi: str) -> str:
    """The sums of a session from those of its sides."""
    fields = {x: f"{lo}.{x} + {hi}.{x}" for x in ("n", "len", "len_sq", "pld", "pld_sq")}
    fields |= {x: f"least({lo}.{x}, {hi}.{x})" for x in ("len_min", "t_min")}
    fields |= {x: f"greatest({lo}.{x}, {hi}.{x})" for x in ("len_max", "t_max", "pld_max")}
    fields |= {f"len_r{r}": "0L" for r in (1, 2, 3)}
    # A packet without payload counts as length 0 for the session.
    every = f"{lo}.pld_n + {hi}.pld_n = {lo}.n + {hi}.n"
    fields["pld_min"] = f"if({every}, least({lo}.pld_min, {hi}.pld_min), 0L)"
    fields["pld_n"] = f"{lo}.n + {hi}.n"
    for x in ("len", "pld"):
        each = [f"coalesce({side}.{x}_sq_wide, cast({side}.{x}_sq as decimal(38,0)))" for side in (lo, hi)]
        fields[f"{x}_sq_wide"] = f"if({lo}.{x}_sq + {hi}.{x}_sq is null, {' + '.join(each)}, null)"
    fields |= {"gap_min": "all_gap_min", "gap_max": "all_gap_max"}
    fields |= {f"gap_{kind}": e for kind, e in _sum_of_squares("all_gap_sq", True).items()}
    return _struct(dict(sorted(fields.items())) | {"whole": "true"})


def _struct(fields: dict[str, str]) -> str:
    return f"named_struct({', '.join(f"'{name}', {e}" for name, e in fields.items())})"


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` for ``value``, which is taken once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _around(squares: str, mean: str, n: str, total: str) -> str:
    """Exact ``sum((x - mean)^2)`` as a double; what is added to the squares is at most twice their sum."""
    rest = f"{n} * {mean} - 2 * {total}"
    wide = f"{squares}_wide + cast({mean} as decimal(38,0)) * cast({rest} as decimal(38,0))"
    return f"if({squares} is null, cast({wide} as double), cast({squares} + {mean} * ({rest}) as double))"


def _over(top: str, bottom: str) -> str:
    return f"if({bottom} > 0, try_divide({top}, cast({bottom} as double)), 0D)"


def _flipped_sum() -> str:
    """``sum((x - mean) xor 2)``: plus 2 where bit 1 of the difference is clear, minus 2 where set."""
    counts = {r: f"p.len_r{r}" for r in (1, 2, 3)}
    counts[0] = "(p.n - p.len_r1 - p.len_r2 - p.len_r3)"
    bit_set = " + ".join(f"if(pmod({r} - m.len, 4) >= 2, {count}, 0L)" for r, count in counts.items())
    return f"cast(p.len - p.n * m.len + 2 * (p.n - 2 * ({bit_set})) as double)"


def _part_statistics(corrected: bool) -> str:
    """The statistics of a part ``p`` (a side or the session) in their order, then its duration."""
    means = {
        "len": "if(p.n > 0, p.len div p.n, 0L)",
        "gap": "if(p.n > 1, (p.t_max - p.t_min) div (p.n - 1), 0L)",
        "pld": "if(p.pld_n > 0, p.pld div p.pld_n, 0L)",
    }
    around = _around("p.len_sq", "m.len", "p.n", "p.len")
    of_whole = _over(around, "p.n" if corrected else "m.len")
    of_side = _over(around if corrected else _flipped_sum(), "p.n")
    gaps = _around("p.gap_sq", "m.gap", "(p.n - 1)", "(p.t_max - p.t_min)")
    payload = _around("p.pld_sq", "m.pld", "p.pld_n", "p.pld")
    values = [
        "m.len", "p.len_min", "p.len_max", f"if(p.whole, {of_whole}, {of_side})",
        "m.gap", "p.gap_min", "p.gap_max", _over(gaps, "(p.n - 1)"),
        "m.pld", "p.pld_min", "p.pld_max", _over(payload, "p.pld_n"),
        "p.len", "p.n", "p.t_max - p.t_min",
    ]
    return _let(_struct(means), "m", f"array({', '.join(map(_number, values))})")


def _number(value: str) -> str:
    return f"coalesce(cast({value} as double), 0D)"


def _summed(tagged: DataFrame) -> DataFrame:
    """One row of sums per session, sides still named ``lo`` and ``hi``."""
    columns = [*SESSION, CHUNK, "t", "rowkey", "src_lo", "pkt_len", "pld_len", "tcp_flags", *SPACING]
    narrow = tagged.select(*[c for c in columns if c in tagged.columns])
    with_gaps = narrow if "side_iat" in tagged.columns else spaced(narrow)
    sums = {f"all_{name}": e for name, e in _gap_sums("iat").items()}
    for prefix, side in (("lo", "src_lo"), ("hi", "not src_lo")):
        sums |= {f"{prefix}_{name}": e for name, e in _side_sums(side).items()}
    sums["psh_cnt"] = f"count_if(tcp_flags & {PSH} <> 0)"
    sums["first_lo"] = "max(sends_first) = 1"
    return (
        with_gaps.selectExpr(
            "*", "cast(pkt_len as bigint) as size", "cast(pld_len as bigint) as payload"
        )
        .groupBy(*SESSION)
        .agg(*[F.expr(f"{e} as {name}") for name, e in sums.items()])
    )


def _statistics(tagged: DataFrame, corrected: bool) -> DataFrame:
    """Per session ``first_lo``, ``psh_cnt`` and ``parts``: the statistics of ``lo``, ``hi`` and the session.

    The formulas stand once, in lambda functions.  Written out for each part, Spark fuses them with the aggregation into
    one method, and the JVM never compiles a method of more than 8,000 bytes: it ran as bytecode for every session.
    """
    whole = _let(f"array({_side('lo')}, {_side('hi')})", "s", f"concat(s, array({_whole('s[0]', 's[1]')}))")
    parts = f"transform({whole}, p -> {_part_statistics(corrected)}) as parts"
    return _summed(tagged).selectExpr(*SESSION, "first_lo", "psh_cnt", parts)


def direction_statistics(tagged: DataFrame, corrected: bool = False) -> DataFrame:
    """The 14 statistics of each side: one row per session and side (``cs`` or ``sc``)."""
    sides = []
    for i, client in enumerate(("first_lo", "not first_lo")):
        fields = {"side": f"if({client}, 'cs', 'sc')"}
        fields |= {name: f"parts[{i}][{j}]" for j, name in enumerate(DIRECTION_STATISTICS)}
        sides.append(_struct(fields))
    rows = _statistics(tagged, corrected).selectExpr(*SESSION, f"inline(array({', '.join(sides)}))")
    return rows.where("pkt_cnt > 0")


def _with_values(tagged: DataFrame, corrected: bool) -> DataFrame:
    """One row per session: the session key, ``first_lo`` and ``values``, the 44 features in order."""
    of_session = "slice(parts[2], 1, 13), array(parts[2][14], parts[2][13], cast(psh_cnt as double))"
    server, client = (f"slice(if(first_lo, parts[{a}], parts[{b}]), 1, 14)" for a, b in ((1, 0), (0, 1)))
    return _statistics(tagged, corrected).selectExpr(
        *SESSION, "first_lo", f"concat({of_session}, {server}, {client}) as values"
    )


def session_features_wide(tagged: DataFrame, corrected: bool = False) -> DataFrame:
    """One row per session: the session key, ``first_lo`` and the 44 features by name."""
    named = [f"values[{i}] as {name}" for i, name in enumerate(FEATURES)]
    return _with_values(tagged, corrected).selectExpr(*SESSION, "first_lo", *named)


def session_features(tagged: DataFrame, corrected: bool = False) -> DataFrame:
    """The session table: keys, the first packet's addresses, feature names and values.

    ``corrected`` takes population variances of packet lengths instead of the inherited formulas
    (divided by the mean for the session, xor instead of square for a side).
    """
    sessions = _with_values(tagged, corrected)
    client = F.when(F.col("first_lo"), F.col("lo")).otherwise(F.col("hi"))
    server = F.when(F.col("first_lo"), F.col("hi")).otherwise(F.col("lo"))
    port = F.lit(65535)
    sid = md5_bytes(session_id(F.col("lo"), F.col("hi"), F.col("pr"), F.col("sid_ts")))
    direction = flow_mark(client, server, F.col("pr"))
    return sessions.select(
        sid.alias("rowkey"),
        *SESSION,
        endpoint_bits(client).bitwiseAND(port).cast("int").alias("sport"),
        endpoint_bits(server).bitwiseAND(port).cast("int").alias("dport"),
        direction.alias("direction"),
        endpoint_mark(server, F.col("pr")).alias("m"),
        server.alias("server"),
        sid.alias("sid"),
        F.array(*[F.lit(name) for name in FEATURES]).alias("features_name"),
        F.col("values").alias("features_value"),
    )
