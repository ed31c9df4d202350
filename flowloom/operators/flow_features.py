"""The 77 flow features, computed in one aggregation per flow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import FEATURES
from ..functions.columns import any_of, c, is_infinite, is_missing
from .flows import ENDPOINTS, FLOW, SIDES, FlowRules, flag_aggregates, per_flow, segment, window_aggregates, with_timing


def _spread(prefix: str, value: str) -> list[str]:
    return [f"max({value}) as {prefix}_max", f"min({value}) as {prefix}_min", f"stddev_pop({value}) as {prefix}_std"]


def _moments() -> list[str]:
    out = ["var_pop(packet_len) as len_var", "stddev_pop(iat_us) as iat_std",
           "count_if(is_forward and payload_len > 0) as act_data_pkt_fwd"]
    for name, side in SIDES.items():
        out += _spread(f"{name}_len", f"if({side}, packet_len, null)")
    for prefix, value in (("fwd_iat", f"if({SIDES['fwd']}, iat_us, null)"), ("bwd_iat", f"if({SIDES['bwd']}, iat_us, null)"),
                          ("active", "active_us"), ("idle", "idle_us")):
        out += [*_spread(prefix, value), f"sum({value}) as {prefix}_total", f"count({value}) as {prefix}_n"]
    return out


def _feature_sql() -> dict[str, str]:
    """Features over the aggregates. Means, and extremes over both directions, follow from the parts."""
    seconds = "(duration_us / 1e6D)"
    fwd_mean, bwd_mean = "fwd_bytes / nullif(fwd_packets, 0)", "bwd_bytes / nullif(bwd_packets, 0)"
    out = {
        "Flow Duration": "duration_us",
        "Total Fwd Packets": "fwd_packets", "Total Backward Packets": "bwd_packets",
        "Total Length of Fwd Packets": "fwd_bytes", "Total Length of Bwd Packets": "bwd_bytes",
        "Fwd Packet Length Mean": fwd_mean, "Bwd Packet Length Mean": bwd_mean,
        "Flow Bytes/s": f"bytes / {seconds}", "Flow Packets/s": f"packets / {seconds}",
        "Fwd Packets/s": f"fwd_packets / {seconds}", "Bwd Packets/s": f"bwd_packets / {seconds}",
        "Flow IAT Mean": "(coalesce(fwd_iat_total, 0) + coalesce(bwd_iat_total, 0)) / nullif(fwd_iat_n + bwd_iat_n, 0)",
        "Flow IAT Std": "iat_std",
        "Flow IAT Max": "greatest(fwd_iat_max, bwd_iat_max)", "Flow IAT Min": "least(fwd_iat_min, bwd_iat_min)",
        "Fwd IAT Total": "fwd_iat_total", "Bwd IAT Total": "bwd_iat_total",
        "Fwd Header Length": "fwd_header_bytes", "Bwd Header Length": "bwd_header_bytes",
        "Fwd Header Length.1": "fwd_header_bytes",
        "Min Packet Length": "least(fwd_len_min, bwd_len_min)", "Max Packet Length": "greatest(fwd_len_max, bwd_len_max)",
        "Packet Length Mean": "bytes / packets", "Packet Length Std": "sqrt(len_var)", "Packet Length Variance": "len_var",
        "Down/Up Ratio": "bwd_packets / nullif(fwd_packets, 0)", "Average Packet Size": "bytes / packets",
        "Avg Fwd Segment Size": fwd_mean, "Avg Bwd Segment Size": bwd_mean,
        "Subflow Fwd Packets": "fwd_packets", "Subflow Fwd Bytes": "fwd_bytes",
        "Subflow Bwd Packets": "bwd_packets", "Subflow Bwd Bytes": "bwd_bytes",
        "Init_Win_bytes_forward": "coalesce(nullif(init_win_fwd, 0), 65535)",
        "Init_Win_bytes_backward": "coalesce(nullif(init_win_bwd, 0), 65535)",
        "act_data_pkt_fwd": "act_data_pkt_fwd", "min_seg_size_forward": "fwd_len_min",
    }
    for title, prefix in (("Fwd Packet Length", "fwd_len"), ("Bwd Packet Length", "bwd_len"),
                          ("Fwd IAT", "fwd_iat"), ("Bwd IAT", "bwd_iat"), ("Active", "active"), ("Idle", "idle")):
        for stat in ("Max", "Min", "Std"):
            out[f"{title} {stat}"] = f"{prefix}_{stat.lower()}"
        if not prefix.endswith("len"):
            out[f"{title} Mean"] = f"{prefix}_total / nullif({prefix}_n, 0)"
    for name in FEATURES:
        if "Bulk" in name:
            out[name] = "0.0D"
        elif "Flag" in name:
            out[name] = f"`{name}`"
    return out


def flow_features(packets: DataFrame, rules: FlowRules = FlowRules(), wanted: list[str] | None = None) -> DataFrame:
    """`flow_key, flow_pos`, endpoints, `start_us`, then the features as doubles.

    A statistic over no packets is 0. `wanted` narrows the features; the aggregates
    behind the others are pruned from the plan.
    """
    return features_of(segment(packets, rules), rules, wanted)


def features_of(segmented: DataFrame, rules: FlowRules = FlowRules(), wanted: list[str] | None = None) -> DataFrame:
    timed = with_timing(segmented, rules)
    flows = per_flow(timed, [*flag_aggregates(), *window_aggregates(), *_moments()], in_order=True)
    sql = _feature_sql()
    return flows.selectExpr(
        *FLOW, *ENDPOINTS, "initiator_ip", "start_us",
        *[f"coalesce(cast({sql[n]} as double), 0.0D) as `{n}`" for n in (wanted or FEATURES)])


def sanitised(features: DataFrame, names: list[str] = FEATURES) -> DataFrame:
    """NaN and infinite feature values become 0."""
    return features.withColumns({
        n: F.when(is_infinite(c(n)) | is_missing(c(n)), 0.0).otherwise(c(n)) for n in names})


def sanity_warnings(features: DataFrame, names: list[str] = FEATURES) -> DataFrame:
    """Per feature, how many values are invalid, and how many are negative where that makes no sense."""
    cells = F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), c(n).alias("value")) for n in names]))
    value = F.col("value")
    return features.select(cells).groupBy("feature").agg(
        F.count_if(any_of([is_infinite(value), is_missing(value)])).alias("invalid"),
        F.count_if((value < 0) & ~is_missing(value) & ~F.contains("feature", F.lit("Ratio"))).alias("negative"),
    )
