"""Queries over labelled flow tables: cleaning, labels, sampling, feature statistics, quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import CALIBRATION_CATEGORIES, CRITICAL_FEATURES, FEATURES, TOLERANCES
from ..functions.columns import c
from ..operators import clean, feature_stats, labels, quality, sampling
from ..sources.bindings import RAW_FEATURES
from .catalog import over_view, query, rounded

VIEW = "raw_flows"
IDS = ["Flow ID", "Source Port"]
# Columns a labelled file has; row_key and source_file are ours.
FILE = [*IDS, *RAW_FEATURES, "Label"]
NUMERIC = ["Flow Bytes/s", "Flow IAT Mean"]
_LIST = ", ".join(f'"{n}"' for n in RAW_FEATURES)


def q(name: str) -> str:
    return f'"{name}"'


def is_inf(name: str) -> str:
    return f"coalesce(abs({q(name)}) = cast('Infinity' as double), false)"


ANY_INF = "(" + " or ".join(is_inf(n) for n in RAW_FEATURES) + ")"
FILLED = ", ".join(f"coalesce({q(n)}, 0.0) as {q(n)}" for n in RAW_FEATURES)


# --------------------------------------------------------------------------- projections and filters

@over_view("project_drop_ids", VIEW, f'select row_key, {_LIST}, "Label", source_file from raw_flows')
def project_drop_ids(df):
    return clean.drop_identifiers(df)


@over_view("filter_nonfinite", VIEW, f"select row_key, {_LIST} from raw_flows where not {ANY_INF}")
def filter_nonfinite(df):
    return clean.drop_infinite_rows(df, RAW_FEATURES).select("row_key", *[c(n) for n in RAW_FEATURES])


@over_view("fill_missing", VIEW, f"select row_key, {FILLED} from raw_flows")
def fill_missing(df):
    return clean.fill_missing(df, 0.0, RAW_FEATURES).select("row_key", *[c(n) for n in RAW_FEATURES])


@over_view("serving_clean", VIEW, "select row_key, " + ", ".join(
    f"case when {q(n)} is null or isnan({q(n)}) or {is_inf(n)} then 0 else {q(n)} end as {q(n)}"
    for n in RAW_FEATURES) + " from raw_flows")
def serving_clean(df):
    return clean.serving_clean(df, RAW_FEATURES).select("row_key", *[c(n) for n in RAW_FEATURES])


@over_view("coerce_numeric", VIEW, """, texts as (select row_key,
  case when "Source Port" % 7 = 0 then 'n/a' else cast("Flow Duration" as varchar) end as t from raw_flows)
select row_key, coalesce(try_cast(t as double), 0.0) as t from texts""")
def coerce_numeric(df):
    texts = df.select("row_key", F.when(c("Source Port") % 7 == 0, "n/a").otherwise(
        c("Flow Duration").cast("string")).alias("t"))
    return clean.coerce_numeric(texts, ["t"])


ALIGNED = ["Flow Duration", "Fwd IAT Mean", "Idle Max", "Flow Bytes/s"]


@over_view("align_schema", VIEW, """select row_key, "Flow Duration", "Fwd IAT Mean",
  cast(0 as double) as "Idle Max", "Flow Bytes/s" from raw_flows""")
def align_schema(df):
    messy = df.withColumnsRenamed({"Flow Duration": " flow duration", "Fwd IAT Mean": "FWD IAT MEAN "})
    return clean.align(messy, ALIGNED, keep=["row_key"])


@over_view("select_features", VIEW,
           'select row_key, "Fwd IAT Mean", "Flow Duration", "Subflow Fwd Bytes" from raw_flows')
def select_features(df):
    return clean.select_features(df, ["Fwd IAT Mean", "Flow Duration", "Subflow Fwd Bytes"], keep=["row_key"])


# --------------------------------------------------------------------------- duplicates, unions, contracts

def _file_with_copies(df):
    """The table with every fiftieth part's rows repeated under another flow id."""
    copies = df.where(F.expr("cast(split(row_key, '[|]')[2] as bigint) % 50 = 0")).withColumn(
        "Flow ID", F.concat(c("Flow ID"), F.lit("-copy")))
    return df.unionByName(copies).select(*[c(n) for n in FILE])


COPIES = f""", files as (select {", ".join(map(q, FILE))} from raw_flows union all
  select "Flow ID" || '-copy', {", ".join(q(n) for n in FILE[1:])} from raw_flows
  where cast(split_part(row_key, '|', 3) as bigint) % 50 = 0)"""


@over_view("dedup_rows", VIEW, COPIES + f""",
cleaned as (select {FILLED}, "Label" from files where not {ANY_INF})
select distinct {_LIST}, "Label" from cleaned""")
def dedup_rows(df):
    return clean.clean(_file_with_copies(df))


@over_view("cleaning_audit", VIEW, COPIES + f""",
good as (select {FILLED}, "Label" from files where not {ANY_INF}),
distinct_rows as (select distinct * from good)
select count(*) as rows_in, count(*) filter (where {ANY_INF}) as infinite_rows,
  cast(sum(case when {ANY_INF} then 0 else {" + ".join(f"(case when {q(n)} is null then 1 else 0 end)" for n in RAW_FEATURES)} end)
    as bigint) as filled_cells,
  (select count(*) from good) - (select count(*) from distinct_rows) as duplicate_rows,
  (select count(*) from distinct_rows) as rows_out from files""")
def cleaning_audit(df):
    return clean.cleaning_audit(_file_with_copies(df))


@over_view("union_files", VIEW, f"""select row_key, "Flow Duration", "Fwd IAT Mean", "Label" from raw_flows where source_file < 1998
union all select row_key, "Flow Duration", null, "Label" from raw_flows where source_file >= 1998""")
def union_files(df):
    early = df.where("source_file < 1998").select("row_key", c("Flow Duration"), c("Fwd IAT Mean"), "Label")
    late = df.where("source_file >= 1998").select("row_key", "Label", c("Flow Duration"))
    return clean.union_files([early, late])


@over_view("distinct_labels", VIEW, 'select distinct "Label" as label from raw_flows order by label')
def distinct_labels(df):
    return labels.distinct_labels(df)


EXPECTED = ["Flow Bytes/s", "Flow Duration", "Flow IAT Mean", "Fwd IAT Mean", "Fwd Avg Bytes/Bulk", "Idle Max"]
_CELLS = f"""cells as (select source_file, unnest([{", ".join("'" + n + "'" for n in RAW_FEATURES)}]) as name,
  unnest([1, 2, 3, 4, 5, 6]) as position,
  unnest([{", ".join(q(n) for n in RAW_FEATURES)}]) as value from raw_flows)"""


def _headers(df):
    """`(file, position, name)`: the features of each file that hold any value above zero."""
    cells = df.select("source_file", F.inline(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(n).alias("name"), c(n).alias("value"))
        for i, n in enumerate(RAW_FEATURES, 1)])))
    return cells.where("value > 0").select(
        F.col("source_file").cast("string").alias("file"), "position", "name").distinct()


_HEADERS = f"""{_CELLS}, headers as (select distinct cast(source_file as varchar) as file, position, name
  from cells where value > 0)"""


@over_view("feature_set_except", VIEW, f""", {_HEADERS},
want as (select unnest([{", ".join("'" + n + "'" for n in EXPECTED)}]) as name, unnest(range(6)) as want),
matched as (select h.*, w.want from headers h left join want w on w.name = h.name),
ranked as (select *, count(want) over (partition by file order by position) as have_rank,
  count(want) over (partition by file order by want nulls last) as want_rank from matched)
select file, name, case when want is null then 'extra' else 'out_of_order' end as problem
  from ranked where want is null or have_rank <> want_rank
union all
select f.file, w.name, 'missing' from (select distinct file from headers) f, want w
  where not exists (select 1 from headers h where h.file = f.file and h.name = w.name)""")
def feature_set_except(df):
    return clean.column_contract(_headers(df), EXPECTED)


# --------------------------------------------------------------------------- labels

@over_view("label_binary", VIEW, """select row_key,
  case when upper(trim("Label")) = 'BENIGN' then 0 else 1 end as label_binary from raw_flows""")
def label_binary(df):
    return df.select("row_key", labels.binary_label(c("Label")).alias("label_binary"))


@over_view("label_multiclass", VIEW, """, codes as (select "Label" as label, dense_rank() over (order by "Label") - 1 as code
  from (select distinct "Label" from raw_flows) x)
select r.row_key, r."Label", cast(k.code as integer) as label_multiclass from raw_flows r join codes k on k.label = r."Label" """)
def label_multiclass(df):
    encoded, _ = labels.encode_labels(df)
    return encoded.select("row_key", "Label", F.col("Label_Multiclass").cast("int").alias("label_multiclass"))


@over_view("class_distribution", VIEW, """select "Label" as label, count(*) as n,
  round(count(*) * 100.0::double / sum(count(*)) over (), 6) as percent from raw_flows group by "Label" """)
def class_distribution(df):
    return rounded(labels.class_distribution(df), ["percent"])


@over_view("label_decode", VIEW, """, codes as (select "Label" as label, dense_rank() over (order by "Label") - 1 as code
  from (select distinct "Label" from raw_flows) x),
predicted as (select row_key, cast("Source Port" % 5 as integer) as prediction from raw_flows)
select p.row_key, p.prediction, coalesce(k.label, 'CLASS_' || p.prediction) as label
  from predicted p left join codes k on k.code = p.prediction""")
def label_decode(df):
    predicted = df.select("row_key", F.pmod(c("Source Port"), F.lit(5)).cast("int").alias("prediction"))
    return labels.decode_labels(predicted, labels.label_mapping(df))


@over_view("class_weights", VIEW, """select "Label" as label, count(*) as n,
  round(sum(count(*)) over () / (count(*) over () * count(*))::double, 9) as weight from raw_flows group by "Label" """)
def class_weights(df):
    return rounded(labels.class_weights(df, "Label"), ["weight"], 9)


# --------------------------------------------------------------------------- sampling

def _binary(df):
    return df.select("row_key", labels.binary_label(c("Label")).alias("y"))


RANKED = """, binary_rows as (select row_key, case when upper(trim("Label")) = 'BENIGN' then 0 else 1 end as y from raw_flows),
ranked as (select *, row_number() over (partition by y order by md5(concat_ws('|', '42', row_key)), row_key) as rn,
  count(*) over (partition by y) as n from binary_rows)"""


@over_view("balance_undersample", VIEW, RANKED + """, sizes as (select min(n) as lo, max(n) as hi from ranked)
select row_key, y from ranked, sizes where n = lo or rn <= cast(floor(lo * 1.5) as bigint)""")
def balance_undersample(df):
    return sampling.balance(_binary(df), "row_key", 1.5, "y")


@over_view("stratified_split", VIEW, RANKED + """,
cut as (select *, cast(floor(0.15::double * n + 0.5) as bigint) as n_test from ranked),
cuts as (select *, cast(floor(0.15::double / (1 - 0.15::double) * (n - n_test) + 0.5) as bigint) as n_val from cut)
select row_key, y, case when rn <= n_test then 'test' when rn <= n_test + n_val then 'val' else 'train' end as split from cuts""")
def stratified_split(df):
    return sampling.stratified_split(_binary(df), "row_key", "y")


@over_view("stratified_sample", VIEW, RANKED + """, total as (select count(*) as m from binary_rows),
shares as (select y as share_of, count(*) as n_of, greatest(1, 1000 * count(*) // m) as base, (1000 * count(*)) % m as rest
  from binary_rows, total group by y, m),
given as (select share_of, base + cast(row_number() over (order by rest desc, share_of) <= 1000 - sum(base) over () as integer) as give
  from shares)
select row_key, y from ranked join given on y = share_of where rn <= give""")
def stratified_sample(df):
    return sampling.stratified_sample(_binary(df), "row_key", 1000, "y")


@over_view("sample_n", VIEW, """select row_key from raw_flows
order by md5(concat_ws('|', '42', row_key)), row_key limit 500""")
def sample_n(df):
    return sampling.sample_n(df.select("row_key"), "row_key", 500)


@over_view("shuffle", VIEW, 'select row_key, "Label" from raw_flows')
def shuffle(df):
    return sampling.shuffle_rows(df.select("row_key", "Label"))


@over_view("kfold_assign", VIEW, RANKED + " select row_key, y, cast((rn - 1) * 5 // n as integer) as fold from ranked")
def kfold_assign(df):
    return sampling.assign_folds(_binary(df), "row_key", 5, "y")


# --------------------------------------------------------------------------- feature statistics

CLEANED = f", cleaned as (select row_key, {FILLED}, \"Label\" from raw_flows where not {ANY_INF})"
_VAR = " union all ".join(f"select '{n}' as feature, var_pop({q(n)}) as variance from cleaned" for n in RAW_FEATURES)
_CORR = " union all ".join(
    f"select '{a}' as feature_a, '{b}' as feature_b, corr({q(a)}, {q(b)}) as r from cleaned"
    for j, b in enumerate(RAW_FEATURES) for a in RAW_FEATURES[:j])


def _cleaned(df):
    return clean.clean(df, deduplicate=False)


@over_view("variance_filter", VIEW, f"{CLEANED}, v as ({_VAR}) select feature, round(variance, 4) as variance, variance > 0 as kept from v")
def variance_filter(df):
    table = feature_stats.variances(_cleaned(df), RAW_FEATURES)
    return rounded(table.withColumn("kept", F.col("variance") > 0), ["variance"], 4)


@over_view("corr_matrix", VIEW, f"{CLEANED}, r as ({_CORR}) select feature_a, feature_b, "
           "round(case when isnan(r) then null else r end, 6) as r from r")
def corr_matrix(df):
    return rounded(feature_stats.correlation_table(_cleaned(df), RAW_FEATURES), ["r"])


@over_view("corr_filter", VIEW, f"""{CLEANED}, v as ({_VAR}), r as ({_CORR})
select feature, case when variance <= 0 then 'variance' when exists (
    select 1 from r where r.feature_b = v.feature and not isnan(r.r) and abs(r.r) > 0.95) then 'correlation'
  else 'kept' end as outcome from v""")
def corr_filter(df):
    return feature_stats.reduction_summary(_cleaned(df), RAW_FEATURES)


SCALED = RAW_FEATURES


@over_view("robust_scale", VIEW, CLEANED + ", fit as (select " + ", ".join(
    f"median({q(n)}) as m{i}, quantile_cont({q(n)}, 0.75) - quantile_cont({q(n)}, 0.25) as s{i}"
    for i, n in enumerate(SCALED)) + " from cleaned) select row_key, " + ", ".join(
    f"round(({q(n)} - m{i}) / (case when s{i} = 0 then 1 else s{i} end), 6) as {q(n)}" for i, n in enumerate(SCALED))
    + " from cleaned, fit")
def robust_scale(df):
    cleaned = _cleaned(df).select("row_key", *[c(n) for n in SCALED])
    return rounded(feature_stats.scale(cleaned, feature_stats.fit_robust_scaler(cleaned, SCALED)), SCALED)


@over_view("standard_scale", VIEW, CLEANED + ", fit as (select " + ", ".join(
    f"avg({q(n)}) as m{i}, stddev_pop({q(n)}) as s{i}" for i, n in enumerate(SCALED))
    + " from cleaned) select row_key, " + ", ".join(
    f"round(({q(n)} - m{i}) / (case when s{i} = 0 then 1 else s{i} end), 6) as {q(n)}" for i, n in enumerate(SCALED))
    + " from cleaned, fit")
def standard_scale(df):
    cleaned = _cleaned(df).select("row_key", *[c(n) for n in SCALED])
    return rounded(feature_stats.scale(cleaned, feature_stats.fit_standard_scaler(cleaned, SCALED)), SCALED)


_ZEROED = ", ".join(f"case when {q(n)} is null or isnan({q(n)}) or {is_inf(n)} then 0 else {q(n)} end as {q(n)}"
                    for n in RAW_FEATURES)
IMPORTANCE = f""", zeroed as (select {_ZEROED},
  case when upper(trim("Label")) = 'BENIGN' then 0.0::double else 1.0::double end as y from raw_flows), i as (""" + " union all ".join(
    f"""select '{n}' as feature, corr({q(n)}, y) as r, var_pop({q(n)}) as v, max(abs({q(n)})) as top from zeroed"""
    for n in RAW_FEATURES) + """), importances as (select feature,
  0.7 * coalesce(case when isnan(r) then 0 else abs(r) end, 0)
  + 0.3 * least(case when top > 0 then v / (top * top) else 0 end, 1.0) as importance from i)"""


@over_view("quick_importance", VIEW, IMPORTANCE + " select feature, round(importance, 6) as importance from importances")
def quick_importance(df):
    return rounded(feature_stats.quick_importance(df, RAW_FEATURES), ["importance"])


@over_view("topk_features", VIEW, IMPORTANCE + """ select feature, round(importance, 6) as importance from importances
order by importances.importance desc, feature limit 3""")
def topk_features(df):
    return rounded(feature_stats.top_features(feature_stats.quick_importance(df, RAW_FEATURES), 3), ["importance"])


# --------------------------------------------------------------------------- quality

WANTED = RAW_FEATURES + ["Fwd IAT Std", "Total Fwd Packets", "Idle Max"]


@over_view("coverage", VIEW, f""", {_HEADERS},
want as (select unnest([{", ".join("'" + n + "'" for n in WANTED)}]) as feature,
  unnest([{", ".join(str(n in CRITICAL_FEATURES).lower() for n in WANTED)}]) as critical),
pairs as (select f.file, w.*, exists (select 1 from headers h where h.file = f.file and h.name = w.feature) as present
  from (select distinct file from headers) f, want w)
select file, count(*) as total, count(*) filter (where present) as passed, count(*) filter (where not present) as missing,
  count(*) filter (where not present and critical) as critical_missing,
  round(count(*) filter (where present) * 100.0::double / count(*), 6) as pass_rate,
  count(*) filter (where present) * 100.0 / count(*) >= 80 and count(*) filter (where not present and critical) = 0 as is_valid
from pairs group by file""")
def coverage(df):
    return rounded(quality.coverage_by_file(_headers(df), WANTED), ["pass_rate"])


_VALIDATION = ", ".join(f"('{f}', '{k}', {TOLERANCES[k]}::double)" for k, names in CALIBRATION_CATEGORIES.items() for f in names)


@over_view("tolerance_lookup", VIEW, CLEANED + ", m as (" + " union all ".join(
    f"select '{n}' as feature, avg({q(n)}) as mean from cleaned" for n in RAW_FEATURES) + f"""),
t as (select * from (values {_VALIDATION}) x(feature, category, tolerance))
select m.feature, round(m.mean, 6) as mean, coalesce(t.category, 'default') as category,
  coalesce(t.tolerance, 0.20::double) as tolerance from m left join t on t.feature = m.feature""")
def tolerance_lookup(df):
    return rounded(quality.calibration_tolerance(quality.feature_means(_cleaned(df), RAW_FEATURES)), ["mean"])


MEANS = RAW_FEATURES
_JUDGED = ", pairs as (" + " union all ".join(
    f"""select '{n}' as feature, avg({q(n)}) filter (where "Label" = 'PortScan' and not {is_inf(n)}) as expected,
  avg({q(n)} * 1.2) filter (where "Label" <> 'PortScan' and not {is_inf(n)}) as actual from raw_flows""" for n in MEANS) + """),
t as (select unnest(['Flow Duration', 'Flow IAT Mean', 'Fwd IAT Mean', 'Flow Bytes/s']) as feature,
  unnest(['temporal', 'temporal', 'temporal', 'rate']) as category, unnest([0.30, 0.30, 0.30, 0.50]::double[]) as tolerance),
diffs as (select p.feature, p.expected, p.actual, coalesce(t.category, 'other') as category,
  coalesce(t.tolerance, 0.20::double) as tolerance,
  case when expected <> 0 then abs(actual - expected) / abs(expected) when actual <> 0 then 1.0 else 0.0 end as d
  from pairs p left join t on t.feature = p.feature)"""


def _means(df):
    attack = F.col("Label") == "PortScan"
    return quality.compare_means(
        df.where(attack), df.where(~attack).withColumns({n: c(n) * 1.2 for n in MEANS}), MEANS)


@over_view("compare_means", VIEW, _JUDGED + """ select feature, category, tolerance, round(expected, 6) as expected,
  round(actual, 6) as actual, round(d, 6) as relative_diff, d <= tolerance as passed from diffs""")
def compare_means(df):
    return rounded(_means(df), ["expected", "actual", "relative_diff"]).select(
        "feature", "category", "tolerance", "expected", "actual", "relative_diff", "passed")


@over_view("failed_features", VIEW, _JUDGED.replace("* 1.2", "* 1.6") + """ select feature, round(d, 6) as relative_diff
  from diffs where d > tolerance order by diffs.d desc, feature limit 20""")
def failed_features(df):
    attack = F.col("Label") == "PortScan"
    results = quality.compare_means(
        df.where(attack), df.where(~attack).withColumns({n: c(n) * 1.6 for n in MEANS}), MEANS)
    return rounded(quality.failed_features(results).select("feature", "relative_diff"), ["relative_diff"])


@over_view("feature_profile", VIEW, " union all ".join(f"""select '{n}' as feature, count(x) as n, round(avg(x), 6) as mean,
  round(stddev_pop(x), 6) as std, min(x) as min, max(x) as max,
  round(count(*) filter (where x = 0) * 100.0::double / count(x), 6) as zero_pct, round(median(x), 6) as median
  from (select {q(n)} as x from raw_flows where not {is_inf(n)}) y""" for n in RAW_FEATURES))
def feature_profile(df):
    return rounded(quality.feature_profile(df, RAW_FEATURES), ["mean", "std", "zero_pct", "median"])


_STDS = [f"case when coalesce(stddev_pop({q(n)}) filter (where not {is_inf(n)}), 0) = 0 then 1 else 0 end" for n in RAW_FEATURES]


@over_view("calibration_score", VIEW, f""", z as (select count(*) as n, {" + ".join(_STDS)} as flat from raw_flows)
select n as n_samples, {len(FEATURES)} as total_features, {len(FEATURES) - len(RAW_FEATURES)} as missing_features,
  cast(flat as integer) as zero_variance_features,
  round({len(RAW_FEATURES)} * 50.0::double / {len(FEATURES)} + ({len(RAW_FEATURES)} - flat) * 50.0::double / {len(FEATURES)}, 6)
    as overall_score from z""")
def calibration_score(df):
    return rounded(quality.calibration_score(df), ["overall_score"])


DRIFT = RAW_FEATURES


@over_view("drift_compare", VIEW, ", d as (" + " union all ".join(
    f"""select '{n}' as feature, avg(x) filter (where a) as ma, avg(x) filter (where not a) as mb,
  stddev_pop(x) filter (where a) as sa, stddev_pop(x) filter (where not a) as sb
  from (select {q(n)} as x, "Label" = 'PortScan' as a from raw_flows where not {is_inf(n)}) y""" for n in DRIFT) + """)
select feature, round(ma, 6) as mean_a, round(sa, 6) as std_a, round(mb, 6) as mean_b, round(sb, 6) as std_b,
  round(case when ma <> 0 then abs((mb - ma) / ma) * 100 when mb = 0 then 0 else 100 end, 6) as mean_diff_pct,
  round(case when sa <> 0 then abs((sb - sa) / sa) * 100 when sb = 0 then 0 else 100 end, 6) as std_diff_pct from d""")
def drift_compare(df):
    attack = F.col("Label") == "PortScan"
    out = quality.drift_compare(df.where(attack), df.where(~attack), DRIFT)
    return rounded(out, ["mean_a", "std_a", "mean_b", "std_b", "mean_diff_pct", "std_diff_pct"])


@query("ks_two_sample", """with v as (select l_extendedprice as x, count(*) filter (where l_returnflag = 'A') as a,
  count(*) filter (where l_returnflag <> 'A') as b from lineitem group by 1),
cum as (select sum(a) over (order by x) as ca, sum(b) over (order by x) as cb, sum(a) over () as n, sum(b) over () as m from v),
s as (select max(abs(ca / n::double - cb / m::double)) as ks, max(n)::double as n, max(m)::double as m from cum),
z as (select *, ks * sqrt(n * m / (n + m)) as z from s),
tail as (select sum((case when k % 2 = 1 then 2.0 else -2.0 end) * exp(-2 * z * z * k * k)) as p
  from z, (select unnest(range(1, 101))::double as k) t)
select round(ks, 9) as ks_statistic, round(case when z < 0.2 then 1.0 else greatest(0.0, least(1.0, p)) end, 6) as ks_pvalue,
  cast(n as bigint) as n_a, cast(m as bigint) as n_b from z, tail""")
def ks_two_sample(spark, sf_dir):
    from ..sources.bindings import table

    lines = table(spark, sf_dir, "lineitem")
    attack = F.col("l_returnflag") == "A"
    out = quality.ks_two_sample(lines.where(attack), lines.where(~attack), "l_extendedprice")
    return out.withColumns({"ks_statistic": F.round("ks_statistic", 9), "ks_pvalue": F.round("ks_pvalue", 6)})


@over_view("ks_all_features", VIEW, ", " + ", ".join(f"""v{i} as (select {q(n)} as x, count(*) filter (where "Label" = 'PortScan') as a,
  count(*) filter (where "Label" <> 'PortScan') as b from raw_flows where {q(n)} is not null and not isnan({q(n)}) and not {is_inf(n)} group by 1),
c{i} as (select '{n}' as feature, sum(a) over (order by x) as ca, sum(b) over (order by x) as cb, sum(a) over () as n, sum(b) over () as m from v{i}),
s{i} as (select feature, max(abs(ca / n::double - cb / m::double)) as ks, max(n)::double as n, max(m)::double as m from c{i} group by feature)"""
    for i, n in enumerate(RAW_FEATURES)) + ", s as (" + " union all ".join(f"select * from s{i}" for i in range(len(RAW_FEATURES))) + """),
z as (select *, ks * sqrt(n * m / (n + m)) as z from s),
tail as (select feature, sum((case when k % 2 = 1 then 2.0 else -2.0 end) * exp(-2 * z * z * k * k)) as p
  from z, (select unnest(range(1, 101))::double as k) t group by feature)
select feature, round(ks, 9) as ks_statistic, round(case when z < 0.2 then 1.0 else greatest(0.0, least(1.0, p)) end, 6) as ks_pvalue,
  cast(n as bigint) as n_a, cast(m as bigint) as n_b from z join tail using (feature)""")
def ks_all_features(df):
    attack = F.col("Label") == "PortScan"
    return rounded(rounded(quality.ks_features(df.where(attack), df.where(~attack), RAW_FEATURES), ["ks_statistic"], 9), ["ks_pvalue"])


@over_view("file_profile", VIEW, f"""select cast(source_file as varchar) as file, count(*) as rows, {len(FILE)} as cols,
  count(*) filter (where upper(trim("Label")) = 'BENIGN') as benign,
  count(*) filter (where upper(trim("Label")) <> 'BENIGN') as attacks,
  array_to_string(list_sort(list_distinct(list(trim("Label")) filter (where upper(trim("Label")) <> 'BENIGN'))), ',')
    as attack_types from raw_flows group by source_file""")
def file_profile(df):
    return quality.file_profile(df.withColumn("source_file", F.col("source_file").cast("string")), "source_file",
                                n_columns=len(FILE))
