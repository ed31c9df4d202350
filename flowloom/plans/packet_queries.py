"""Queries from packets to flows and flow features."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import FEATURES, FLAG_FEATURES, TCP_FLAG_BITS, TOLERANCES, VALIDATION_CATEGORIES
from ..functions.bounded import stabilise
from ..functions.columns import c
from ..operators import flow_features as ff
from ..operators import flows, quality
from ..sources.bindings import spark_view, sql_view
from .catalog import over_view, query

HOUR = 3600 * flows.SECOND
# The test traffic spreads each key over a month, so the limits are scaled to days.
RULES = flows.FlowRules(idle_timeout=72 * HOUR, active_timeout=5 * 24 * HOUR, max_packets=6, idle_threshold=24 * HOUR)
# The same limits, with most keys large enough for the chunked way of hot keys.
HOT_RULES = dataclasses.replace(RULES, hot_key_packets=10, chunk_packets=8)

FORWARD = "(src_ip < dst_ip or (src_ip = dst_ip and src_port < dst_port))"
KEYED = f"""keyed as (select *, {FORWARD} as is_forward,
  case when {FORWARD}
    then src_ip || ':' || src_port || '-' || dst_ip || ':' || dst_port || '-' || protocol
    else dst_ip || ':' || dst_port || '-' || src_ip || ':' || src_port || '-' || protocol end as flow_key,
  case when {FORWARD} then src_ip else dst_ip end as lo_ip
  from packets)"""
DONE = f"""(n >= {RULES.max_packets} or ts_us - start_us > {RULES.active_timeout}
  or (closing and n >= {RULES.min_closing_packets}))"""
# One row per packet with the state of its flow after it.
FLOWS = f"""with recursive {sql_view('packets')}, {KEYED},
ordered as (select *, row_number() over (partition by flow_key order by ts_us, packet_id) as rn from keyed),
walk as (
  select flow_key, rn, ts_us, cast(0 as bigint) as flow_pos, 1 as n, ts_us as start_us,
    (tcp_flags & 5) <> 0 as closing from ordered where rn = 1
  union all
  select flow_key, rn, ts_us, case when fresh then rn - 1 else flow_pos end,
    case when fresh then 1 else n + 1 end, case when fresh then ts_us else start_us end,
    (not fresh and closing) or closes
  from (
    select o.flow_key, o.rn, o.ts_us, w.flow_pos, w.n, w.start_us, w.closing, (o.tcp_flags & 5) <> 0 as closes,
      (w.n >= {RULES.max_packets} or w.ts_us - w.start_us > {RULES.active_timeout}
        or (w.closing and w.n >= {RULES.min_closing_packets})
        or o.ts_us - w.ts_us > {RULES.idle_timeout}) as fresh
    from walk w join ordered o on o.flow_key = w.flow_key and o.rn = w.rn + 1) step),
pk as (select o.*, w.flow_pos, w.n, w.start_us, w.closing
  from ordered o join walk w on o.flow_key = w.flow_key and o.rn = w.rn)"""
FLOW_WINDOW = "partition by flow_key, flow_pos order by ts_us, packet_id"
TIMED = FLOWS + f""",
gaps as (select *,
  ts_us - lag(ts_us) over (partition by flow_key, flow_pos, is_forward order by ts_us, packet_id) as iat_us,
  ts_us - lag(ts_us) over ({FLOW_WINDOW}) as gap_us from pk),
timed as (select *, case when gap_us > {RULES.idle_threshold} then gap_us end as idle_us,
  sum(case when gap_us > {RULES.idle_threshold} then 1 else 0 end) over ({FLOW_WINDOW}) as period from gaps),
periods as (select flow_key, flow_pos, max(ts_us) - min(ts_us) as active_us
  from timed group by flow_key, flow_pos, period having max(ts_us) > min(ts_us)),
active as (select flow_key, flow_pos, count(*) as active_n, sum(active_us) as active_sum, avg(active_us) as active_mean,
  stddev_pop(active_us) as active_std, max(active_us) as active_max, min(active_us) as active_min
  from periods group by flow_key, flow_pos)"""


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_view(spark, sf_dir, "packets")


def segmented(spark: SparkSession, sf_dir: str, carry: list[str]) -> DataFrame:
    return flows.segment(packets(spark, sf_dir), RULES, carry)


@over_view("packets_by_protocol", "packets", """
select protocol, count(*) as packets, cast(sum(packet_len) as bigint) as bytes
from packets where protocol in (6, 17) group by protocol""")
def packets_by_protocol(df):
    return flows.keep_tcp_udp(df).groupBy("protocol").agg(
        F.count("*").alias("packets"), F.sum(F.col("packet_len").cast("long")).alias("bytes"))


@over_view("flow_key", "packets", f", {KEYED} select packet_id, flow_key from keyed")
def flow_key(df):
    return flows.with_flow_key(df).select("packet_id", "flow_key")


@over_view("packet_direction", "packets", f", {KEYED} select packet_id, is_forward from keyed")
def packet_direction(df):
    return flows.with_flow_key(df).select("packet_id", "is_forward")


@query("flow_segments", FLOWS + " select packet_id, flow_key, flow_pos from pk")
def flow_segments(spark, sf_dir):
    return segmented(spark, sf_dir, []).select("packet_id", "flow_key", "flow_pos")


@query("flow_segments_hot", FLOWS + " select packet_id, flow_key, flow_pos from pk")
def flow_segments_hot(spark, sf_dir):
    return flows.segment(packets(spark, sf_dir), HOT_RULES, []).select("packet_id", "flow_key", "flow_pos")


@query("idle_sessions", f"""with {sql_view('packets')}, {KEYED},
marked as (select *, case when ts_us - lag(ts_us) over (partition by flow_key order by ts_us, packet_id)
  > {RULES.idle_timeout} then 1 else 0 end as splits from keyed where protocol in (6, 17)),
numbered as (select *, sum(splits) over (partition by flow_key order by ts_us, packet_id) as session_no from marked)
select flow_key, cast(session_no as bigint) as session_no, min(ts_us) as start_us, max(ts_us) as last_us,
  count(*) as packets, cast(sum(packet_len) as bigint) as bytes from numbered group by flow_key, session_no""")
def idle_sessions(spark, sf_dir):
    return flows.idle_sessions(packets(spark, sf_dir), RULES.idle_timeout)


@query("packet_iat", TIMED + " select packet_id, iat_us, gap_us from timed")
def packet_iat(spark, sf_dir):
    return flows.with_timing(segmented(spark, sf_dir, []), RULES).select("packet_id", "iat_us", "gap_us")


@query("active_idle", TIMED + """
select t.flow_key, t.flow_pos, coalesce(max(a.active_n), 0) as active_periods,
  cast(coalesce(max(a.active_sum), 0) as bigint) as active_us, count(t.idle_us) as idle_periods,
  cast(coalesce(sum(t.idle_us), 0) as bigint) as idle_us
from timed t left join active a on a.flow_key = t.flow_key and a.flow_pos = t.flow_pos
group by t.flow_key, t.flow_pos""")
def active_idle(spark, sf_dir):
    return flows.active_idle_periods(segmented(spark, sf_dir, []), RULES)


BASE_SQL = """
select flow_key, flow_pos, min(ts_us) as start_us, max(ts_us) as last_us, count(*) as packets,
  cast(sum(packet_len) as bigint) as bytes, arg_min(src_ip, packet_id + ts_us * 1000000::hugeint) as initiator_ip,
  count(*) filter (where is_forward) as fwd_packets,
  cast(coalesce(sum(packet_len) filter (where is_forward), 0) as bigint) as fwd_bytes,
  cast(coalesce(sum(header_len) filter (where is_forward), 0) as bigint) as fwd_header_bytes,
  count(*) filter (where not is_forward) as bwd_packets,
  cast(coalesce(sum(packet_len) filter (where not is_forward), 0) as bigint) as bwd_bytes,
  cast(coalesce(sum(header_len) filter (where not is_forward), 0) as bigint) as bwd_header_bytes,
  greatest(max(ts_us) - min(ts_us), 1) as duration_us
from pk group by flow_key, flow_pos"""


@query("flow_base", FLOWS + BASE_SQL)
def flow_base(spark, sf_dir):
    return flows.flow_base(segmented(spark, sf_dir, ["packet_len", "header_len"]))


_FLAG_SQL = ", ".join(
    f'count(*) filter (where (tcp_flags & {TCP_FLAG_BITS[flag]}) <> 0) as "{name}"' for name, flag in FLAG_FEATURES.items()
) + ", " + ", ".join(
    f'count(*) filter (where (tcp_flags & {TCP_FLAG_BITS[flag]}) <> 0 and {side}) as "{title} {flag} Flags"'
    for flag in ("PSH", "URG") for title, side in (("Fwd", "is_forward"), ("Bwd", "not is_forward")))


@query("flow_flags", FLOWS + f" select flow_key, flow_pos, {_FLAG_SQL} from pk group by flow_key, flow_pos")
def flow_flags(spark, sf_dir):
    return flows.flow_flags(segmented(spark, sf_dir, ["tcp_flags"]))


@query("flow_init_window", FLOWS + """
select flow_key, flow_pos, arg_min(window_size, rn) filter (where is_forward) as init_win_fwd,
  arg_min(window_size, rn) filter (where not is_forward) as init_win_bwd from pk group by flow_key, flow_pos""")
def flow_init_window(spark, sf_dir):
    return flows.flow_init_window(segmented(spark, sf_dir, ["window_size"]))


@query("flow_stats", FLOWS + f""", ends as (
  select flow_key, count(distinct flow_pos) as flows, count(*) as packets, bool_or(is_end and {DONE}) as last_closed
  from (select *, rn = max(rn) over (partition by flow_key) as is_end from pk) x group by flow_key)
select cast(sum(packets) as bigint) as total_packets, cast(sum(flows) as bigint) as flows_created,
  cast(sum(flows) - count(*) filter (where not last_closed) as bigint) as flows_completed,
  count(*) filter (where not last_closed) as active_flows from ends""")
def flow_stats(spark, sf_dir):
    return flows.flow_counters(segmented(spark, sf_dir, []), RULES)


# --------------------------------------------------------------------------- feature groups

def _d(expr: str, name: str) -> str:
    return f'cast(coalesce({expr}, 0) as double) as "{name}"'


def _std(expr: str, name: str, digits: int) -> str:
    return f'round(coalesce({expr}, 0), {digits}) as "{name}"'


def _side(value: str, side: str | None) -> str:
    return value if side is None else f"case when {side} then {value} end"


def _stats_sql(value: str, title: str, side: str | None, digits: int) -> list[str]:
    v = _side(value, side)
    return [_d(f"max({v})", f"{title} Max"), _d(f"min({v})", f"{title} Min"), _d(f"avg({v})", f"{title} Mean"),
            _std(f"stddev_pop({v})", f"{title} Std", digits)]


SIDES = {"Fwd": "is_forward", "Bwd": "not is_forward"}
SECONDS = "(greatest(max(ts_us) - min(ts_us), 1) / 1e6)"
MICRO_DIGITS = -3  # deviations of microsecond values carry about 16 significant digits

GROUPS: dict[str, tuple[list[str], str]] = {}
ALL_SELECTS: list[str] = []


def _group(name: str, select: list[str], source: str = "pk") -> None:
    names = [s.rsplit(' as "', 1)[1].rstrip('"') for s in select]
    prelude = TIMED if source == "timed" else FLOWS
    ALL_SELECTS.extend(select)
    GROUPS[name] = (names, f"{prelude} select flow_key, flow_pos, {', '.join(select)} from {source} group by flow_key, flow_pos")


def _count(side: str) -> str:
    return f"count(*) filter (where {side})"


def _sum(value: str, side: str) -> str:
    return f"sum(case when {side} then {value} end)"


_F, _B = SIDES["Fwd"], SIDES["Bwd"]
_group("feat_volume", [
    _d("greatest(max(ts_us) - min(ts_us), 1)", "Flow Duration"),
    _d(_count(_F), "Total Fwd Packets"), _d(_count(_B), "Total Backward Packets"),
    _d(_sum("packet_len", _F), "Total Length of Fwd Packets"), _d(_sum("packet_len", _B), "Total Length of Bwd Packets")])
_group("feat_length_dir", [s for t, side in SIDES.items()
                           for s in _stats_sql("packet_len", f"{t} Packet Length", side, 6)])
_group("feat_rates", [
    _d(f"cast(sum(packet_len) as double) / {SECONDS}", "Flow Bytes/s"), _d(f"count(*) / {SECONDS}", "Flow Packets/s"),
    _d(f"{_count(_F)} / {SECONDS}", "Fwd Packets/s"), _d(f"{_count(_B)} / {SECONDS}", "Bwd Packets/s")])
_group("feat_iat_flow", _stats_sql("iat_us", "Flow IAT", None, MICRO_DIGITS), "timed")
_group("feat_iat_dir", [s for t, side in SIDES.items()
                        for s in [_d(_sum("iat_us", side), f"{t} IAT Total"),
                                  *_stats_sql("iat_us", f"{t} IAT", side, MICRO_DIGITS)]], "timed")
_group("feat_flags_headers", [
    *[_d(f"count(*) filter (where (tcp_flags & {TCP_FLAG_BITS[f]}) <> 0)", n) for n, f in FLAG_FEATURES.items()],
    *[_d(f"count(*) filter (where (tcp_flags & {TCP_FLAG_BITS[f]}) <> 0 and {side})", f"{t} {f} Flags")
      for f in ("PSH", "URG") for t, side in SIDES.items()],
    _d(_sum("header_len", _F), "Fwd Header Length"), _d(_sum("header_len", _B), "Bwd Header Length"),
    _d(_sum("header_len", _F), "Fwd Header Length.1")])
_group("feat_length_all", [
    _d("min(packet_len)", "Min Packet Length"), _d("max(packet_len)", "Max Packet Length"),
    _d("avg(packet_len)", "Packet Length Mean"), _std("stddev_pop(packet_len)", "Packet Length Std", 6),
    _std("var_pop(packet_len)", "Packet Length Variance", 6)])
_group("feat_ratios", [
    _d(f"case when {_count(_F)} > 0 then {_count(_B)} * 1.0::double / {_count(_F)} end", "Down/Up Ratio"),
    _d("cast(sum(packet_len) as double) / count(*)", "Average Packet Size"),
    *[_d(f"avg({_side('packet_len', side)})", f"Avg {t} Segment Size") for t, side in SIDES.items()],
    *[_d("0.0::double", n) for n in FEATURES if "Bulk" in n],
    *[s for t, side in SIDES.items() for s in (
        _d(_count(side), f"Subflow {t} Packets"), _d(_sum("packet_len", side), f"Subflow {t} Bytes"))]])
_group("feat_window_misc", [
    *[_d(f"coalesce(nullif(arg_min(window_size, rn) filter (where {side}), 0), 65535)", f"Init_Win_bytes_{word}")
      for word, side in (("forward", _F), ("backward", _B))],
    _d(_count(f"{_F} and payload_len > 0"), "act_data_pkt_fwd"),
    _d(f"min({_side('packet_len', _F)})", "min_seg_size_forward")])


def _register_group(name: str, names: list[str], sql: str) -> None:
    def run(spark, sf_dir):
        out = ff.flow_features(packets(spark, sf_dir), RULES, names).select("flow_key", "flow_pos", *[c(n) for n in names])
        stds = {n: 6 if "Length" in n else MICRO_DIGITS for n in names if n.endswith(("Std", "Variance"))}
        return out.withColumns({n: F.round(c(n), d) for n, d in stds.items()}) if stds else out

    run.__name__ = name
    query(name, sql)(run)


for _name, (_names, _sql) in GROUPS.items():
    _register_group(_name, _names, _sql)

_PERIODS = [f"{kind} {s}" for kind in ("Active", "Idle") for s in ("Mean", "Std", "Max", "Min")]
_PERIOD_SELECTS = [
    _d("max(active_mean)", "Active Mean"), _std("max(active_std)", "Active Std", MICRO_DIGITS),
    _d("max(active_max)", "Active Max"), _d("max(active_min)", "Active Min"),
    *_stats_sql("idle_us", "Idle", None, MICRO_DIGITS)]
_WITH_ACTIVE = "from timed left join active using (flow_key, flow_pos) group by flow_key, flow_pos"
_register_group("feat_active_idle", _PERIODS, f"{TIMED} select flow_key, flow_pos, {', '.join(_PERIOD_SELECTS)} {_WITH_ACTIVE}")
# The whole product of the packet side: all 77 features of every flow at once.
_register_group("flow_features", FEATURES,
                f"{TIMED} select flow_key, flow_pos, {', '.join(ALL_SELECTS + _PERIOD_SELECTS)} {_WITH_ACTIVE}")


@query("feat_sanity", f"""{TIMED}, feats as (
    select {', '.join(ALL_SELECTS + _PERIOD_SELECTS)} {_WITH_ACTIVE}),
  long as (unpivot feats on columns(*) into name feature value value)
select feature, count(*) filter (where isnan(value) or isinf(value)) as invalid,
  count(*) filter (where value < 0 and not contains(feature, 'Ratio')) as negative from long group by feature""")
def feat_sanity(spark, sf_dir):
    return ff.sanity_warnings(ff.flow_features(packets(spark, sf_dir), RULES), FEATURES)


# --------------------------------------------------------------------------- extracted against labelled flows

_DEVIATIONS = {n: 6 if "Length" in n else MICRO_DIGITS for n in FEATURES if n.endswith(("Std", "Variance"))}
_TOLERANCES = ", ".join(f"('{n}', {TOLERANCES[k]}::double)" for k, names in VALIDATION_CATEGORIES.items() for n in names)


@query("flow_match_compare", f"""{TIMED}, wide as (
  select flow_key, flow_pos, min(ts_us) as start_us, 1 + (count(*) % 5) / 20.0::double as growth,
    {', '.join(ALL_SELECTS + _PERIOD_SELECTS)} {_WITH_ACTIVE}),
ranked as (select e.flow_key, e.flow_pos, l.flow_pos as labelled_pos, row_number() over (partition by e.flow_key, e.flow_pos
    order by abs(l.start_us + 1000000 - e.start_us), l.start_us, l.flow_pos) as n
  from wide e join wide l on l.flow_key = e.flow_key),
long as (select r.flow_key, r.flow_pos, r.labelled_pos, unnest([{', '.join(f"'{n}'" for n in FEATURES)}]) as feature,
    unnest([{', '.join(f'l."{n}" * l.growth' for n in FEATURES)}]) as expected, unnest([{', '.join(f'e."{n}"' for n in FEATURES)}]) as actual
  from ranked r join wide e on e.flow_key = r.flow_key and e.flow_pos = r.flow_pos
  join wide l on l.flow_key = r.flow_key and l.flow_pos = r.labelled_pos where r.n = 1),
tolerances as (select * from (values {_TOLERANCES}) x(feature, tolerance)),
diff as (select long.*, coalesce(tolerance, 0.20::double) as tolerance, case when expected <> 0 then abs(actual - expected) / abs(expected)
    when actual <> 0 then 1.0 else 0.0 end as d from long left join tolerances using (feature) where expected is not null and actual is not null)
select flow_key, flow_pos, labelled_pos, feature, round(d, 6) as relative_diff, d <= tolerance as passed from diff""")
def flow_match_compare(spark, sf_dir):
    """Every feature of every flow against that of the nearest labelled flow; the features are computed once."""
    features = ff.flow_features(packets(spark, sf_dir), RULES, FEATURES)
    extracted = stabilise(features.withColumns({n: F.round(c(n), d) for n, d in _DEVIATIONS.items()}).withColumnRenamed("flow_pos", "id"))
    growth = 1 + F.pmod(c("Total Fwd Packets") + c("Total Backward Packets"), F.lit(5)) / 20
    labelled = extracted.withColumns({"start_us": F.col("start_us") + flows.SECOND, **{n: c(n) * growth for n in FEATURES}})
    out = quality.compare_matched_flows(extracted, labelled, FEATURES)
    return out.select(
        "flow_key", F.col("id").alias("flow_pos"), F.col("labelled_id").alias("labelled_pos"), "feature",
        F.round("relative_diff", 6).alias("relative_diff"), "passed")
