"""Queries on reading tables: statistics, scaling, windows and forecast frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from swarf.functions.rounding import round_columns, rounded
from swarf.operators import features, series
from swarf.queries.registry import query, r
from swarf.sources.tables import CHANNELS, with_tables

BY = "series_id, channel"
MOMENTS = """, c AS (SELECT series_id, channel, value, avg(value) OVER (PARTITION BY series_id, channel) AS mu FROM readings),
 m AS (SELECT series_id, channel, avg(value) AS mean, sqrt(avg((value-mu)**2)) AS std, sqrt(avg(value*value)) AS rms, max(abs(value)) AS peak,
 avg((value-mu)**3) AS m3, avg((value-mu)**4) AS m4 FROM c GROUP BY series_id, channel)"""
STAT_COLUMNS = features.STATISTICS


@query(with_tables("readings", body=MOMENTS + f""" SELECT series_id, channel, {r('mean', 7, 'mean')}, {r('std', 7, 'std')}, {r('rms', 7, 'rms')},
 {r('peak', 7, 'peak')}, CASE WHEN std > 1e-9 THEN {r('m4/std**4-3', 7)} END AS kurtosis, CASE WHEN std > 1e-9 THEN {r('m3/std**3', 7)} END AS skewness,
 {r('peak/(rms+1e-10)', 7, 'crest_factor')} FROM m"""))
def time_features_cut(t):
    return round_columns(features.time_features(t.events), STAT_COLUMNS, 7)


@query(with_tables("readings", body=MOMENTS + f""" SELECT series_id, channel, {r('mean', 7, 'mean')}, {r('std', 7, 'std')}, {r('rms', 7, 'rms')},
 {r('peak', 7, 'peak')}, {r('m4/(std**4+1e-12)', 7, 'kurtosis')}, {r('m3/(std**3+1e-12)', 7, 'skewness')},
 {r('peak/(rms+1e-12)', 7, 'crest_factor')} FROM m"""))
def time_features_plain(t):
    return round_columns(features.time_features(t.events, flavor="plain"), STAT_COLUMNS, 7)


def _wide_sql():
    exprs = {"mean": "mean", "std": "std", "rms": "rms", "peak": "peak", "kurtosis": "m4/(std**4+1e-12)", "skewness": "m3/(std**3+1e-12)",
             "crest_factor": "peak/(rms+1e-12)"}
    cols = ", ".join(r(f"max(CASE WHEN channel='{c}' THEN {exprs[s]} END)", 7, f"{c}_{s}") for c in CHANNELS for s in STAT_COLUMNS)
    return with_tables("readings", body=MOMENTS + f" SELECT series_id, {cols} FROM m GROUP BY series_id")


@query(_wide_sql())
def features_wide(t):
    wide = features.features_wide(features.time_features(t.events, flavor="plain"), CHANNELS)
    return round_columns(wide, [c for c in wide.columns if c != "series_id"], 7)


@query(with_tables("cuts", body=f""", s AS (SELECT avg(force_n) AS m1, stddev_pop(force_n) AS s1, avg(axial_depth) AS m2, stddev_pop(axial_depth) AS s2
 FROM cuts WHERE condition_id NOT IN ('c5','c6'))
 SELECT tool_id, cut, condition_id, {r('(force_n-m1)/(s1+1e-8)', 7, 'force_n')}, {r('(axial_depth-m2)/(s2+1e-8)', 7, 'axial_depth')} FROM cuts, s"""))
def standardize_from_train(t):
    columns = ["force_n", "axial_depth"]
    cuts = t.cuts.select("tool_id", "cut", "condition_id", *columns)
    stats = series.fit_standardizer(cuts.filter(~F.col("condition_id").isin("c5", "c6")), columns)
    return round_columns(series.apply_standardizer(cuts, stats, columns), columns, 7)


@query(with_tables("readings", body=f"""SELECT series_id, channel, seq, {r('(value-avg(value) OVER w)/(stddev_pop(value) OVER w+1e-8)', 7, 'scaled')}
 FROM readings WINDOW w AS (PARTITION BY {BY})"""))
def zscore(t):
    return round_columns(series.zscore(t.readings.drop("ts")).drop("value"), ["scaled"], 7)


@query(with_tables("readings", body=f"""SELECT series_id, channel, seq, {r('(value-min(value) OVER w)/(max(value) OVER w-min(value) OVER w+1e-8)', 7, 'scaled')}
 FROM readings WINDOW w AS (PARTITION BY {BY})"""))
def minmax(t):
    return round_columns(series.minmax(t.readings.drop("ts")).drop("value"), ["scaled"], 7)


@query(with_tables("readings", body=f""", q AS (SELECT {BY}, list_sort(list(value)) AS v, count(*) AS n FROM readings GROUP BY {BY})
 SELECT series_id, channel, seq, {r('(value - v[floor(0.5*(n-1))::BIGINT+1])/(v[floor(0.75*(n-1))::BIGINT+1]-v[floor(0.25*(n-1))::BIGINT+1]+1e-8)', 4, 'scaled')}
 FROM readings JOIN q USING ({BY})"""))
def robust_scale(t):
    return round_columns(series.robust_scale(t.readings.drop("ts")).drop("value"), ["scaled"], 4)


@query(with_tables("readings", body=f"""SELECT series_id, channel, seq,
 CASE WHEN stddev_pop(value) OVER w < 1e-6 THEN 0.0::DOUBLE ELSE {r('greatest(-10, least(10, (value-avg(value) OVER w)/(stddev_pop(value) OVER w)))', 7)} END AS scaled
 FROM readings WINDOW w AS (PARTITION BY {BY})"""))
def clip_standardize(t):
    return round_columns(series.clip_standardize(t.readings.drop("ts")).drop("value"), ["scaled"], 7)


ROBUST = f""", c AS (SELECT {BY}, median(value) AS center, stddev_pop(value) AS sd FROM readings GROUP BY {BY}),
 d AS (SELECT {BY}, 1.4826::DOUBLE*median(abs(value-center)) AS mad FROM readings JOIN c USING ({BY}) GROUP BY {BY}),
 st AS (SELECT {BY}, center, greatest(CASE WHEN mad > 1e-6 THEN mad ELSE sd END, 1e-4) AS scale FROM c JOIN d USING ({BY}))"""


@query(with_tables("readings", body=ROBUST + f" SELECT {BY}, {r('center', 6, 'center')}, {r('scale', 6, 'scale')} FROM st"))
def robust_stats(t):
    return round_columns(series.robust_stats(t.events), ["center", "scale"])


@query(with_tables("readings", body=ROBUST + f""" SELECT {BY}, seq, {r('greatest(-30, least(30, asinh((value-center)/scale)))', 6, 'normalized')},
 {r('value', 6, 'restored')} FROM readings JOIN st USING ({BY})"""))
def robust_normalize(t):
    readings = t.readings.drop("ts")
    normal = series.robust_normalize(readings, series.robust_stats(t.events))
    back = series.denormalize(normal, "normalized", "restored")
    return round_columns(back.select("series_id", "channel", "seq", "normalized", "restored"), ["normalized", "restored"])


HOLES = """, h AS (SELECT series_id, channel, seq, CASE WHEN seq % 5 = 1 THEN NULL WHEN seq % 7 = 2 THEN 'nan'::DOUBLE WHEN seq % 11 = 3 THEN 'inf'::DOUBLE ELSE value END AS value FROM readings),
 g AS (SELECT series_id, channel, seq, CASE WHEN isfinite(value) THEN value END AS value FROM h)"""


def _with_holes(readings):
    value = (
        F.when(F.col("seq") % 5 == 1, F.lit(None).cast("double"))
        .when(F.col("seq") % 7 == 2, F.lit(float("nan")))
        .when(F.col("seq") % 11 == 3, F.lit(float("inf")))
        .otherwise(F.col("value"))
    )
    return readings.select("series_id", "channel", "seq", value.alias("value"))


@query(with_tables("readings", body=HOLES + " SELECT series_id, channel, seq, coalesce(value, -1.0::DOUBLE) AS value FROM g"))
def fill_missing_constant(t):
    return series.fill_missing(_with_holes(t.readings), "constant", fill=-1.0)


@query(with_tables("readings", body=HOLES + f""", m AS (SELECT {BY}, median(value) AS f FROM g GROUP BY {BY})
 SELECT series_id, channel, seq, {r('coalesce(value, f, 0)', 6, 'value')} FROM g JOIN m USING ({BY})"""))
def fill_missing_median(t):
    return round_columns(series.fill_missing(_with_holes(t.readings), "median"), ["value"])


@query(with_tables("readings", body=f""", d AS (SELECT {BY}, epoch_us(ts)/1e6 - lag(epoch_us(ts)/1e6) OVER (PARTITION BY {BY} ORDER BY seq) AS d FROM readings)
 SELECT {BY}, {r('1e6/median(d)', 4, 'rate_per_ms')} FROM d WHERE d > 0 GROUP BY {BY}"""))
def estimate_rate(t):
    timed = t.readings.withColumn("time_s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    rate = series.estimate_rate(timed)
    return rate.select("series_id", "channel", rounded(F.col("rate") * 1e6, 4).alias("rate_per_ms"))


WINDOW_SQL = ", n AS (SELECT series_id, channel, count(*) AS n FROM readings GROUP BY ALL)"


@query(with_tables("readings", body=WINDOW_SQL + f""", w AS (SELECT series_id, channel, unnest(range(0, n-4+1, 3))//3 AS window_id FROM n WHERE n >= 4)
 SELECT series_id, channel, window_id, {r('avg(value)', 6, 'mean')}, count(*) AS rows, {r("sum(value*(seq-window_id*3))", 6, 'weighted')}
 FROM w JOIN readings USING ({BY}) WHERE seq BETWEEN window_id*3 AND window_id*3+3 GROUP BY ALL"""))
def sliding_windows(t):
    windows = series.sliding_windows(t.readings.drop("ts"), 4, 3)
    return windows.groupBy("series_id", "channel", "window_id").agg(
        rounded(F.avg("value")).alias("mean"), F.count(F.lit(1)).alias("rows"), rounded(F.sum(F.col("value") * F.col("pos"))).alias("weighted")
    )


@query(with_tables("readings", body=WINDOW_SQL + f""", s AS (SELECT {BY}, ('0x'||substr(sha1(series_id||'|'||channel||'|42'),1,8))::BIGINT % (greatest(0,n-5)+1) AS start FROM n)
 SELECT series_id, channel, seq, start, value FROM readings JOIN s USING ({BY}) WHERE seq >= start AND seq < start+5"""))
def sample_window(t):
    return series.sample_window(t.readings.drop("ts"), 5, "42")


@query(with_tables("readings", body=WINDOW_SQL + f""", p AS (SELECT {BY}, n, unnest(range(0, ceil(greatest(0,n-6)/4.0)::BIGINT+1)) AS patch FROM n),
 q AS (SELECT {BY}, n, patch, unnest(range(0,6)) AS pos FROM p)
 SELECT q.series_id, q.channel, patch, pos, coalesce(value, 0.0::DOUBLE) AS value FROM q LEFT JOIN readings r ON r.series_id=q.series_id AND r.channel=q.channel AND r.seq=patch*4+pos"""))
def patchify(t):
    return series.patchify(t.readings.drop("ts"), 6, 4)


@query(with_tables("readings", body=WINDOW_SQL + f""", p AS (SELECT {BY}, n, unnest(range(0,10)) AS pos FROM n)
 SELECT p.series_id, p.channel, pos::INTEGER AS pos, coalesce(value, 0.0::DOUBLE) AS value FROM p LEFT JOIN readings r ON r.series_id=p.series_id AND r.channel=p.channel AND r.seq=n-10+pos"""))
def tail_window(t):
    tails = series.tail_window(t.readings.drop("ts"), 10)
    return tails.select("series_id", "channel", F.posexplode("values").alias("pos", "value"))


@query(with_tables("readings", body=f"""SELECT series_id, channel, seq, {r('coalesce(value-lag(value) OVER (PARTITION BY series_id, channel ORDER BY seq),0)', 6, 'diff')} FROM readings"""))
def first_difference(t):
    return round_columns(series.first_difference(t.readings.drop("ts")).drop("value"), ["diff"])


@query(with_tables("readings", body=f"""SELECT series_id, channel, seq,
 {r('sum(value) OVER (PARTITION BY series_id, channel ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)/4', 7, 'smooth')} FROM readings"""))
def moving_average(t):
    return round_columns(series.moving_average(t.readings.drop("ts"), 4).drop("value"), ["smooth"], 7)


@query(with_tables("readings", body=f""", d AS (SELECT series_id, channel, value-lag(value) OVER (PARTITION BY {BY} ORDER BY seq) AS d FROM readings)
 SELECT series_id, channel, {r('coalesce(avg((d<0)::INT),0)', 6, 'violation_rate')} FROM d GROUP BY {BY}"""))
def monotonic_violation(t):
    return round_columns(series.monotonic_violation(t.readings, ["series_id", "channel"], "value", "seq"), ["violation_rate"])


@query(with_tables("readings", body=WINDOW_SQL + f""", s AS (SELECT series_id, channel, sc AS scale, seq // least(sc, n) AS patch, avg(value) AS m, sqrt(greatest(avg(value*value),1e-8)) AS rr
 FROM readings JOIN n USING ({BY}), (SELECT unnest([2,4,16,64]) AS sc) GROUP BY ALL)
 SELECT series_id, channel, scale, {r('avg(m)', 7, 'mean_of_means')}, {r('stddev_pop(m)', 7, 'std_of_means')}, {r('avg(rr)', 7, 'mean_rms')}, {r('max(rr)', 7, 'max_rms')} FROM s GROUP BY ALL"""))
def multiscale_summary(t):
    out = series.multiscale_summary(t.readings.drop("ts"), [2, 4, 16, 64])
    return round_columns(out, ["mean_of_means", "std_of_means", "mean_rms", "max_rms"], 7)


@query(with_tables("readings", body=f""", d AS (SELECT series_id, channel, value, coalesce(value-lag(value) OVER (PARTITION BY {BY} ORDER BY seq),0) AS d FROM readings)
 SELECT series_id, channel, {r('avg(value)', 7, 'mean')}, {r('stddev_samp(value)', 7, 'std')}, {r('min(value)', 7, 'min')}, {r('max(value)', 7, 'max')},
 {r('avg(d)', 7, 'diff_mean')}, {r('stddev_samp(d)', 7, 'diff_std')} FROM d GROUP BY {BY}"""))
def cnc_summary(t):
    return round_columns(series.cnc_summary(t.readings.drop("ts")), ["mean", "std", "min", "max", "diff_mean", "diff_std"], 7)


@query(with_tables("readings", body=""", k AS (SELECT channel, series_id, count(*) AS n FROM readings GROUP BY ALL),
 o AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY n DESC, series_id) AS rank FROM k) SELECT channel, series_id, n, rank::INTEGER AS rank FROM o WHERE rank <= 4"""))
def rank_top(t):
    counts = t.events.groupBy("channel", "series_id").agg(F.count(F.lit(1)).alias("n"))
    return series.rank_top(counts, ["channel"], [F.desc("n"), F.col("series_id")], 4)


@query(with_tables("cuts", body=f""", e AS (SELECT tool_id, min(CASE WHEN wear_vb_mm >= 0.2 THEN cut END) AS eol, count(*) AS n FROM cuts GROUP BY tool_id)
 SELECT tool_id, cut, {r('CASE WHEN eol IS NULL THEN n-cut ELSE greatest(0, eol-cut) END * 1.5', 3, 'rul_min')} FROM cuts JOIN e USING (tool_id)"""))
def rul_labels(t):
    return round_columns(series.rul_labels(t.cuts, 0.2, 1.5).select("tool_id", "cut", "rul_min"), ["rul_min"], 3)


@query(with_tables("cuts", body=f"""SELECT tool_id, cut, {r('force_n*cutting_speed/60*0.1', 5, 'energy_j')},
 {r('sum(force_n*cutting_speed/60*0.1) OVER (PARTITION BY tool_id ORDER BY cut ROWS UNBOUNDED PRECEDING)', 3, 'cumulative_energy_j')} FROM cuts"""))
def cumulative_energy(t):
    out = series.cumulative_energy(t.cuts, 0.1).select("tool_id", "cut", rounded("energy_j", 5).alias("energy_j"), rounded("cumulative_energy_j", 3).alias("cumulative_energy_j"))
    return out


@query(with_tables("readings", body=f""", f AS (SELECT series_id, median(CASE WHEN value > 10 THEN value END) AS fill FROM readings WHERE channel='rpm' GROUP BY series_id),
 p AS (SELECT series_id, seq, greatest(1, least(100000, CASE WHEN value > 10 THEN value ELSE coalesce(fill, 6000) END)) AS rpm FROM readings JOIN f USING (series_id) WHERE channel='rpm')
 SELECT series_id, seq, {r('rpm', 6, 'rpm')}, {r('coalesce(sum(2*pi()*rpm/60/50) OVER (PARTITION BY series_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)', 6, 'angle')} FROM p"""))
def rotation_angle(t):
    rpm = t.readings.filter(F.col("channel") == "rpm").select("series_id", "seq", "value")
    out = series.rotation_angle(series.clean_rpm(rpm, 6000.0), 50.0)
    return round_columns(out.select("series_id", "seq", "rpm", "angle"), ["rpm", "angle"])


@query(with_tables("readings", body=f""", z AS (SELECT series_id, channel, seq, CASE WHEN stddev_pop(value) OVER w < 1e-6 THEN 0 ELSE greatest(-10, least(10, (value-avg(value) OVER w)/stddev_pop(value) OVER w)) END AS s,
 CASE WHEN regexp_matches(channel,'load|torque|current|power|force') THEN 1.8::DOUBLE WHEN regexp_matches(channel,'rpm|speed|spindle') THEN 1.2::DOUBLE WHEN regexp_matches(channel,'feed|position|axis') THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END AS wt
 FROM readings WINDOW w AS (PARTITION BY {BY})),
 e AS (SELECT series_id, seq, sum(wt*abs(s))/sum(wt) AS v FROM z GROUP BY ALL),
 k AS (SELECT series_id, greatest(3, least(33, CASE WHEN count(*)//16=0 THEN 3 ELSE count(*)//16 END)) AS w FROM e GROUP BY ALL),
 m AS (SELECT a.series_id, a.seq, sum(b.v)/any_value(w) AS smooth FROM e a JOIN k ON a.series_id=k.series_id JOIN e b ON a.series_id=b.series_id AND b.seq BETWEEN a.seq - w//2 AND a.seq + (w-1)//2 GROUP BY ALL),
 l AS (SELECT series_id, seq, smooth, min(smooth) OVER (PARTITION BY series_id) AS lo, max(smooth) OVER (PARTITION BY series_id) AS hi FROM m)
 SELECT series_id, seq, {r('smooth', 7, 'smooth')}, {r('0.35+0.65*(CASE WHEN hi>lo THEN (smooth-lo)/(hi-lo) ELSE 0.5 END)', 7, 'envelope')} FROM l"""))
def load_envelope(t):
    return round_columns(series.load_envelope(series.clip_standardize(t.readings.drop("ts"))), ["smooth", "envelope"], 7)


CONTEXT = f""", c AS (SELECT {BY}, median(value) AS center, stddev_pop(value) AS sd FROM readings WHERE seq < 6 GROUP BY {BY}),
 d AS (SELECT {BY}, 1.4826::DOUBLE*median(abs(value-center)) AS mad FROM readings JOIN c USING ({BY}) WHERE seq < 6 GROUP BY {BY}),
 st AS (SELECT {BY}, center, greatest(CASE WHEN mad > 1e-6 THEN mad ELSE sd END, 1e-4) AS scale FROM c JOIN d USING ({BY})),
 n AS (SELECT {BY}, count(*) AS n FROM readings GROUP BY {BY}),
 tg AS (SELECT series_id, channel, h AS horizon, seq-6 AS step, value, asinh((value-center)/scale) AS normalized FROM readings JOIN st USING ({BY}) JOIN n USING ({BY}), (SELECT unnest([2,4,8]) AS h) WHERE seq >= 6 AND seq-6 < h AND n >= 6+h)"""


@query(with_tables("readings", body=CONTEXT + f" SELECT series_id, channel, horizon, step, {r('value', 6, 'value')}, {r('normalized', 7, 'normalized')} FROM tg"))
def horizon_targets(t):
    out = series.horizon_targets(t.readings.drop("ts"), 6, [2, 4, 8])
    return round_columns(out.select("series_id", "channel", "horizon", "step", "value", "normalized"), ["value"]).withColumn("normalized", rounded("normalized", 7))


@query(with_tables("readings", body=CONTEXT + f""" SELECT series_id, channel, horizon, step, {r('tg.value', 6, 'value')}, {r('l.value', 6, 'persistence')} FROM tg JOIN readings l USING ({BY}) WHERE l.seq = 5"""))
def persistence_forecast(t):
    readings = t.readings.drop("ts")
    out = series.persistence_forecast(readings, series.horizon_targets(readings, 6, [2, 4, 8]), 6)
    return round_columns(out.select("series_id", "channel", "horizon", "step", "value", "persistence"), ["value", "persistence"])


ALIGNED = f""", g AS (SELECT series_id, channel, seq, value, stddev_pop(value) OVER (PARTITION BY {BY}) AS sd FROM readings),
 cr AS (SELECT a.series_id, a.channel AS channel_a, b.channel AS channel_b, corr(a.value, b.value) AS r FROM g a JOIN g b ON a.series_id=b.series_id AND a.seq=b.seq AND a.channel < b.channel
 WHERE a.sd > 1e-6 AND b.sd > 1e-6 GROUP BY ALL HAVING count(*) > 1 AND isfinite(corr(a.value, b.value)))"""


@query(with_tables("readings", body=ALIGNED + f" SELECT series_id, channel_a, channel_b, {r('r', 7, 'r')} FROM cr"))
def channel_corr(t):
    return round_columns(features.channel_corr(t.readings), ["r"], 7)


@query(with_tables("readings", body=ALIGNED + f""" SELECT series_id, {r('coalesce(avg(abs(r)),0)', 7, 'mean_abs_corr')} FROM (SELECT DISTINCT series_id FROM readings) LEFT JOIN cr USING (series_id) GROUP BY series_id"""))
def mean_abs_corr(t):
    return round_columns(features.mean_abs_corr(features.channel_corr(t.readings), t.events), ["mean_abs_corr"], 7)


EDGES = ALIGNED + """, nd AS (SELECT DISTINCT series_id, channel FROM readings),
 al AS (SELECT series_id, channel_a AS source, channel_b AS target, round(abs(r),6) AS affinity FROM cr UNION ALL SELECT series_id, channel_b, channel_a, round(abs(r),6) FROM cr
 UNION ALL SELECT series_id, channel, channel, 1.0::DOUBLE FROM nd),
 rk AS (SELECT *, row_number() OVER (PARTITION BY series_id, source ORDER BY affinity DESC, target) AS k FROM al),
 ed AS (SELECT *, affinity/sum(affinity) OVER (PARTITION BY series_id, source) AS weight FROM rk WHERE k <= 3 AND affinity >= 0.3)"""


def _edges(t):
    corr = features.channel_corr(t.readings).withColumn("r", rounded("r", 6))
    nodes = t.events.select("series_id", "channel").distinct()
    return features.channel_graph(corr, nodes, 3, 0.3), nodes


@query(with_tables("readings", body=EDGES + f" SELECT series_id, source, target, {r('affinity', 6, 'affinity')}, {r('weight', 9, 'weight')} FROM ed"))
def channel_graph(t):
    edges, _ = _edges(t)
    return edges.withColumn("weight", rounded("weight", 9)).withColumn("affinity", rounded("affinity", 6))


@query(with_tables("readings", body=EDGES + f""" SELECT series_id, any_value(nodes) AS nodes, count(affinity) AS edge_count, {r('count(affinity)/(any_value(nodes)**2)', 6, 'density')}, {r('coalesce(avg(affinity),0)', 9, 'mean_affinity')}
 FROM (SELECT series_id, count(*) AS nodes FROM nd GROUP BY series_id) LEFT JOIN ed USING (series_id) GROUP BY series_id"""))
def graph_summary(t):
    out = features.graph_summary(*_edges(t))
    return out.withColumn("density", rounded("density")).withColumn("mean_affinity", rounded("mean_affinity", 9))


TAGS = {"vibration_x": "high_frequency_vibration", "force_z": "cutting_condition", "spindle_load": "spindle_dynamics", "rpm": "spindle_dynamics", "feed_rate": "feed_drive"}


@query(with_tables("readings", body=MOMENTS + f""" SELECT series_id, CASE channel {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in TAGS.items())} END AS tag, count(*) AS members,
 {r('avg(mean)', 7, 'mean')}, {r('avg(rms)', 7, 'rms')} FROM m GROUP BY ALL"""))
def subgraph_pool(t):
    tags = t.spark.createDataFrame(list(TAGS.items()), "channel string, tag string")
    return round_columns(features.subgraph_pool(features.time_features(t.events), tags, ["mean", "rms"]), ["mean", "rms"], 7)
