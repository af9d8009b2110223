"""Queries on cuts: physics features, labels, splits, metrics and alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from swarf.functions.rounding import round_columns, rounded
from swarf.operators import align, evaluate, physics, series, splits
from swarf.queries.registry import query, r
from swarf.queries.series import BY, CONTEXT
from swarf.rules import physics as rules
from swarf.sources.tables import with_tables

RADIAL_DEPTH = 0.22360679774997896
PARAMS_SQL = "(SELECT * FROM (VALUES " + ", ".join(
    "(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v!r}::DOUBLE" for v in row) + ")" for row in rules.MATERIALS
) + ") p(material, tool, taylor_c, taylor_n, taylor_m, taylor_p, kc11, mc, archard_k, hardness, usui_b1, usui_b2))"
MATERIAL_SQL = "CASE tool_id % 3 WHEN 0 THEN 'generic_steel' WHEN 1 THEN 'Ti6Al4V' ELSE 'unlisted' END"
PREPARED = f""", k0 AS (SELECT *, {MATERIAL_SQL} AS material, (cut+1)*1.5 AS elapsed_min, {RADIAL_DEPTH}::DOUBLE AS radial_depth, 0.25::DOUBLE + (part_id % 4)*0.2 AS engagement, 1.0::DOUBLE + axial_depth AS cutting_width FROM cuts),
 k AS (SELECT k0.*, coalesce(taylor_c,200) AS taylor_c, coalesce(taylor_n,0.25) AS taylor_n, coalesce(taylor_m,0) AS taylor_m, coalesce(taylor_p,0) AS taylor_p, kc11, mc, archard_k, hardness, usui_b1, usui_b2 FROM k0 LEFT JOIN {PARAMS_SQL} USING (material))"""


def prepared(t):
    """Cuts with material, timing and engagement columns and their parameters."""
    material = F.when(F.col("tool_id") % 3 == 0, "generic_steel").when(F.col("tool_id") % 3 == 1, "Ti6Al4V").otherwise("unlisted")
    cuts = t.cuts.withColumns(
        {
            "material": material, "elapsed_min": (F.col("cut") + 1) * 1.5, "radial_depth": F.lit(RADIAL_DEPTH),
            "engagement": 0.25 + (F.col("part_id") % 4) * 0.2, "cutting_width": 1.0 + F.col("axial_depth"),
        }
    )
    return physics.join_params(cuts, physics.material_parameters(t.spark))


@query(with_tables("cuts", body=PREPARED + f""", x AS (SELECT *, pow(taylor_c/(cutting_speed*pow(feed,taylor_m)*pow(axial_depth,taylor_p)), 1/taylor_n) AS life FROM k)
 SELECT tool_id, cut, {r('ln(life)', 6, 'log_life')}, {r('least(1, elapsed_min/life)', 6, 'tool_life_ratio')}, {r('ln(1+greatest(0, life-elapsed_min))', 6, 'log_rul')} FROM x"""))
def tool_life_features(t):
    out = physics.tool_life_features(prepared(t))
    return out.select("tool_id", "cut", rounded(F.log("tool_life_min")).alias("log_life"), rounded("tool_life_ratio").alias("tool_life_ratio"), rounded(F.log1p("taylor_rul_min")).alias("log_rul"))


@query(with_tables("cuts", body=PREPARED + f""", m AS (SELECT tool_id, cut, avg(force_n) AS f FROM cuts GROUP BY tool_id, cut), x AS (SELECT *, feed*sqrt(engagement) AS h FROM k JOIN m USING (tool_id, cut))
 SELECT tool_id, cut, {r('h', 6, 'chip_thickness_mm')}, {r('kc11*pow(h,-mc)', 5, 'specific_force')}, {r('f/(kc11*cutting_width*pow(h,1-mc))', 6, 'force_ratio')}, {r('f-kc11*cutting_width*pow(h,1-mc)', 5, 'force_delta_n')} FROM x"""))
def force_features(t):
    measured = physics.mean_force(t.cuts.select("tool_id", "cut", "force_n"), ["tool_id", "cut"])
    out = physics.force_features(prepared(t).join(measured, ["tool_id", "cut"])).select("tool_id", "cut", "chip_thickness_mm", "specific_force", "force_ratio", "force_delta_n")
    return round_columns(round_columns(out, ["chip_thickness_mm", "force_ratio"]), ["specific_force", "force_delta_n"], 5)


@query(with_tables("cuts", body=PREPARED + f""" SELECT tool_id, cut, {r('force_n*cutting_speed/60', 5, 'cutting_power_w')}, {r('cutting_speed*1000*feed*axial_depth*radial_depth', 5, 'mrr_mm3_per_min')},
 {r('force_n*cutting_speed/60/(cutting_speed*1000*feed*axial_depth*radial_depth/60)', 6, 'specific_cutting_energy_j_per_mm3')} FROM k"""))
def energy_features(t):
    out = physics.energy_features(prepared(t)).select("tool_id", "cut", "cutting_power_w", "mrr_mm3_per_min", "specific_cutting_energy_j_per_mm3")
    return round_columns(round_columns(out, ["cutting_power_w", "mrr_mm3_per_min"], 5), ["specific_cutting_energy_j_per_mm3"])


@query(with_tables("cuts", body=PREPARED + f""" SELECT tool_id, cut, CASE WHEN tool_id % 2 = 0 THEN {r('archard_k*force_n*cutting_speed/hardness', 8)} END AS wear_volume_mm3,
 CASE WHEN tool_id % 2 = 1 THEN {r('1e6*usui_b1*force_n*cutting_speed*exp(-usui_b2/(900+feed*100))', 7)} END AS wear_rate FROM k"""))
def wear_models(t):
    cuts = prepared(t).withColumns(
        {
            "archard_available": F.col("tool_id") % 2 == 0, "usui_available": F.col("tool_id") % 2 == 1, "normal_force_n": F.col("force_n"),
            "sliding_distance_mm": F.col("cutting_speed"), "contact_stress": F.col("force_n"), "sliding_velocity": F.col("cutting_speed"),
            "temperature_k": 900 + F.col("feed") * 100,
        }
    )
    out = physics.wear_rate(physics.wear_volume(cuts))
    return out.select("tool_id", "cut", rounded("wear_volume_mm3", 8).alias("wear_volume_mm3"), rounded(F.col("wear_rate_mm_per_s") * 1e6, 7).alias("wear_rate"))


@query(with_tables("cuts", body=PREPARED + f""" SELECT tool_id, cut, {r('least(1, elapsed_min/pow(taylor_c/(cutting_speed*pow(feed,taylor_m)*pow(axial_depth,taylor_p)), 1/taylor_n))', 6, 'f0')}, 0.0::DOUBLE AS f1,
 {r('force_n*cutting_speed/60/(cutting_speed*1000*feed*axial_depth*radial_depth/60)', 6, 'f4')}, CASE WHEN tool_id % 2 = 0 THEN 'tool_life_ratio,specific_cutting_energy_j_per_mm3,wear_volume_mm3' ELSE 'tool_life_ratio,specific_cutting_energy_j_per_mm3' END AS names FROM k"""))
def physics_vector(t):
    cuts = physics.energy_features(physics.tool_life_features(prepared(t))).withColumn("wear_volume_mm3", F.when(F.col("tool_id") % 2 == 0, 1.0))
    out = physics.physics_vector(cuts)
    slot = lambda i: rounded(F.col("physics")[i]).alias(f"f{i}")
    return out.select("tool_id", "cut", slot(0), slot(1), slot(4), F.array_join("physics_names", ",").alias("names"))


BAD = ", v AS (SELECT *, CASE WHEN part_id % 11 = 0 THEN -1.0::DOUBLE ELSE cutting_speed END AS v2, CASE WHEN part_id % 13 = 0 THEN 0.0::DOUBLE ELSE feed END AS f2, CASE WHEN part_id % 17 = 0 THEN 1.5::DOUBLE ELSE engagement END AS e2 FROM k)"


@query(with_tables("cuts", body=PREPARED + BAD + """ SELECT tool_id, cut, CASE WHEN v2 < 0 THEN 'cutting_speed must be >= 0' WHEN f2 <= 0 THEN 'feed must be > 0' WHEN NOT (e2 > 0 AND e2 <= 1) THEN 'engagement must be in (0, 1]' END AS reject_reason FROM v"""))
def validate_conditions(t):
    part = F.col("part_id")
    cuts = prepared(t).withColumns(
        {
            "cutting_speed": F.when(part % 11 == 0, -1.0).otherwise(F.col("cutting_speed")), "feed": F.when(part % 13 == 0, 0.0).otherwise(F.col("feed")),
            "engagement": F.when(part % 17 == 0, 1.5).otherwise(F.col("engagement")),
        }
    )
    return physics.validate_conditions(cuts).select("tool_id", "cut", "reject_reason")


@query(with_tables("cuts", body=" SELECT tool_id, cut, CASE WHEN wear_vb_mm < 0.1 THEN 0 WHEN wear_vb_mm < 0.2 THEN 1 ELSE 2 END AS wear_stage FROM cuts"))
def wear_stage(t):
    return physics.wear_stage(t.cuts).select("tool_id", "cut", "wear_stage")


@query(with_tables("cuts", body=""", m AS (SELECT *, wear_vb_mm * 0.98765432109 AS w, CASE WHEN part_id % 3 = 0 THEN 50.0::DOUBLE + feed END AS measured FROM cuts)
 SELECT tool_id, cut, round_even(coalesce(-(measured - 50.0::DOUBLE), -0.4::DOUBLE * w), 4) + 0.0::DOUBLE AS offset_mm, round_even(CASE WHEN measured IS NOT NULL THEN 0.9::DOUBLE ELSE greatest(0.05::DOUBLE, 0.75::DOUBLE - 1.5::DOUBLE*w) END, 3) AS confidence FROM m"""))
def tool_offset(t):
    cuts = t.cuts.withColumns({"w": F.col("wear_vb_mm") * 0.98765432109, "nominal_mm": F.lit(50.0), "measured_mm": F.when(F.col("part_id") % 3 == 0, 50.0 + F.col("feed"))})
    return physics.tool_offset(cuts, "w").select("tool_id", "cut", (F.col("offset_mm") + 0.0).alias("offset_mm"), "confidence")


@query(with_tables("cuts", body=f""", lb AS (SELECT condition_id, cut, wear_vb_mm AS label_wear, row_number() OVER (PARTITION BY condition_id, cut ORDER BY tool_id) AS k FROM cuts WHERE cut % 2 = 0)
 SELECT tool_id, c.condition_id, c.cut, {r('label_wear', 6, 'label_wear')} FROM cuts c JOIN lb ON c.condition_id = lb.condition_id AND c.cut = lb.cut AND k = 1"""))
def join_labels(t):
    labels = t.cuts.filter(F.col("cut") % 2 == 0).select("condition_id", "cut", F.col("wear_vb_mm").alias("label_wear"), F.col("tool_id").alias("label_row"))
    return round_columns(physics.join_labels(t.cuts.select("tool_id", "condition_id", "cut"), labels), ["label_wear"])


@query(with_tables("cuts", body=" SELECT condition_id, CASE WHEN condition_id = 'c6' THEN 'test' WHEN condition_id = 'c5' THEN 'val' ELSE 'train' END AS split, count(*) AS cuts FROM cuts GROUP BY ALL"))
def condition_split(t):
    split = splits.condition_split(t.read("lineitem").select(F.concat(F.lit("c"), F.col("l_suppkey") % 6 + 1).alias("condition_id")))
    return split.groupBy("condition_id", "split").agg(F.count(F.lit(1)).alias("cuts"))


@query("""WITH f AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE source END AS source FROM documents), v AS (SELECT source AS s FROM f WHERE source IS NOT NULL ORDER BY doc_id DESC LIMIT 1)
 SELECT doc_id, CASE WHEN source = s THEN 'holdout' ELSE 'train' END AS split FROM f, v""")
def leave_one_out(t):
    docs = t.read("documents").select("doc_id", F.when(F.col("doc_id") % 5 != 0, F.col("source")).alias("source"))
    return splits.leave_one_out(docs, "source", "doc_id").select("doc_id", "split")


@query("SELECT event_id, CASE WHEN row_number() OVER (ORDER BY ts, event_id) - 1 < greatest(1, floor(count(*) OVER () * 0.8)) THEN 'train' ELSE 'holdout' END AS split FROM events")
def chronological_split(t):
    return splits.chronological_split(t.read("events").select("event_id", "ts"), "ts", 0.2, ["event_id"]).select("event_id", "split")


@query("SELECT event_id, CASE WHEN row_number() OVER (ORDER BY sha1(event_id || '|42'), event_id) - 1 < greatest(1, floor(count(*) OVER () * 0.8)) THEN 'train' ELSE 'holdout' END AS split FROM events")
def random_split(t):
    return splits.random_split(t.read("events").select("event_id"), "event_id").select("event_id", "split")


@query("""WITH g AS (SELECT doc_id, coalesce(CASE WHEN doc_id % 4 = 0 THEN NULL ELSE source END, 'p/' || doc_id) AS g FROM documents), h AS (SELECT doc_id, ('0x'||substr(sha1(g),1,8))::BIGINT / 4294967295.0 AS x FROM g)
 SELECT doc_id, CASE WHEN x < 0.1 THEN 'test' WHEN x < 0.3 THEN 'val' ELSE 'train' END AS split, 'run_id' AS split_group_column FROM h""")
def group_hash_split(t):
    docs = t.read("documents").select("doc_id", F.when(F.col("doc_id") % 4 != 0, F.col("source")).alias("run_id"), F.concat(F.lit("p/"), "doc_id").alias("file_path"))
    return splits.group_hash_split(docs, None, val=0.2, test=0.1).select("doc_id", "split", "split_group_column")


@query("""WITH f AS (SELECT doc_id, source || '/' || lang || '/' || doc_id || '.txt' AS p, lower(source || '/' || lang) AS d FROM documents)
 SELECT doc_id, CASE WHEN ('0x'||substr(sha1(d),1,8))::BIGINT / 4294967295.0 < 0.2 THEN 'val' ELSE 'train' END AS split FROM f""")
def parent_dir_split(t):
    docs = t.read("documents").select("doc_id", F.concat_ws("/", "source", "lang", F.concat("doc_id", F.lit(".txt"))).alias("file_path"))
    return splits.parent_dir_split(docs, 0.2).select("doc_id", "split")


@query("""WITH f AS (SELECT doc_id, 'one/' || doc_id AS p FROM documents), k AS (SELECT doc_id, row_number() OVER (ORDER BY sha1(p), p) - 1 AS k, count(*) OVER () AS n FROM f)
 SELECT doc_id, CASE WHEN k < least(n-1, greatest(1, round_even(n*0.2, 0))) THEN 'val' ELSE 'train' END AS split FROM k""")
def parent_dir_split_single(t):
    docs = t.read("documents").select("doc_id", F.concat(F.lit("one/"), "doc_id").alias("file_path"))
    return splits.parent_dir_split(docs, 0.2).select("doc_id", "split")


@query("""WITH s AS (SELECT source, CASE WHEN ('0x'||substr(sha1(doc_id::VARCHAR),1,8))::BIGINT / 4294967295.0 < 0.02 THEN 'test' ELSE 'train' END AS split FROM documents)
 SELECT source, count(DISTINCT split) AS splits FROM s GROUP BY source HAVING count(DISTINCT split) > 1""")
def leaking_groups(t):
    docs = t.read("documents").select("source", F.col("doc_id").alias("run_id"))
    return splits.leaking_groups(splits.group_hash_split(docs, "run_id", val=0.0, test=0.02), "source")


@query("SELECT vec_id AS id, label FROM embeddings ORDER BY sha1(vec_id || '|42'), vec_id LIMIT 25")
def few_shot_sample(t):
    return splits.few_shot_sample(t.vectors, "id", 25).select("id", "label")


@query("""WITH k AS (SELECT vec_id AS id, row_number() OVER (ORDER BY sha1(vec_id || '|42'), vec_id) AS k FROM embeddings) SELECT id, s::INTEGER AS shots FROM k, (SELECT unnest([50,25,10,5]) AS s) WHERE k <= s
 UNION ALL SELECT id, -1 FROM k""")
def few_shot_grid(t):
    return splits.few_shot_grid(t.vectors, "id").select("id", "shots")


@query("SELECT vec_id AS id, label FROM embeddings ORDER BY vec_id LIMIT 20")
def cap_support(t):
    return splits.cap_support(t.vectors, "id").select("id", "label")


METRICS = f"""{r('avg(abs(predicted-target))', 6, 'mae')}, {r('sqrt(avg((predicted-target)**2))', 6, 'rmse')}, {r('1-sum((predicted-target)**2)/(var_pop(target)*count(*))', 6, 'r2')}, {r('avg(2*abs(predicted-target)/(abs(target)+abs(predicted)+1e-12))', 6, 'smape')}"""


@query(with_tables("predictions", body=f" SELECT task, {METRICS} FROM predictions GROUP BY task"))
def regression_metrics(t):
    return round_columns(evaluate.regression_metrics(t.predictions, ["task"]), ["mae", "rmse", "r2", "smape"])


CLASSES = "SELECT l.doc_id, source, quality AS target, CASE WHEN toxic = 1 AND l.doc_id % 2 = 0 THEN 2 WHEN n_chars > 2000 THEN 1 ELSE 0 END AS predicted FROM labels l JOIN documents d ON l.doc_id = d.doc_id"


def _classes(t):
    joined = t.read("labels").join(t.read("documents").select("doc_id", "source", "n_chars"), "doc_id")
    predicted = F.when((F.col("toxic") == 1) & (F.col("doc_id") % 2 == 0), 2).when(F.col("n_chars") > 2000, 1).otherwise(0)
    return joined.select("doc_id", "source", F.col("quality").alias("target"), predicted.alias("predicted"))


@query(f"""WITH c AS ({CLASSES}), l AS (SELECT source, target AS label FROM c UNION SELECT source, predicted FROM c),
 f AS (SELECT l.source, label, count_if(target = label AND predicted = label) AS tp, count_if(target = label) AS tr, count_if(predicted = label) AS ca FROM l JOIN c USING (source) GROUP BY ALL),
 a AS (SELECT source, avg((target = predicted)::INT) AS acc FROM c GROUP BY source) SELECT source, {r('any_value(acc)', 6, 'accuracy')}, {r('avg(2*tp/(tr+ca))', 6, 'macro_f1')} FROM f JOIN a USING (source) GROUP BY source""")
def classification_metrics(t):
    return round_columns(evaluate.classification_metrics(_classes(t), ["source"]), ["accuracy", "macro_f1"])


@query(f"WITH c AS ({CLASSES}), l AS (SELECT unnest([0,1,2]) AS x) SELECT a.x::BIGINT AS truth, b.x::VARCHAR AS called, count(c.doc_id) AS n FROM l a CROSS JOIN l b LEFT JOIN c ON target = a.x AND predicted = b.x GROUP BY ALL")
def confusion_matrix(t):
    return evaluate.confusion_matrix(_classes(t), [0, 1, 2])


SCORES = ", s AS (SELECT tool_id, task, abs(target-predicted)/greatest(exp(log_var/2), 1e-6) AS score FROM predictions)"


def _scores(t):
    return evaluate.residual_score(t.predictions.withColumn("predicted_std", F.exp(F.col("log_var") / 2))).select("tool_id", "task", "score")


@query(with_tables("predictions", body=SCORES + f" SELECT task, {r('quantile_cont(score, 0.95)', 6, 'threshold')} FROM s GROUP BY task"))
def conformal_threshold(t):
    return round_columns(evaluate.conformal_threshold(_scores(t), 0.95, ["task"]), ["threshold"])


@query(with_tables("predictions", body=SCORES + ", h AS (SELECT task, quantile_cont(score, 0.95) AS th FROM s GROUP BY task) SELECT tool_id, count(*) AS rows, count_if(score > th)::BIGINT AS anomalies FROM s JOIN h USING (task) GROUP BY tool_id"))
def flag_anomalies(t):
    scores = _scores(t)
    flagged = evaluate.flag_anomalies(scores, evaluate.conformal_threshold(scores, 0.95, ["task"]), ["task"])
    return flagged.groupBy("tool_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if("anomaly").alias("anomalies"))


@query(with_tables("readings", body=f""", x AS (SELECT series_id, channel, seq, value AS y, value*0.9+sin(seq) AS p, seq % 3 - 1.0 AS lv FROM readings),
 d AS (SELECT *, p-lag(p) OVER w - (y-lag(y) OVER w) AS d FROM x WINDOW w AS (PARTITION BY {BY} ORDER BY seq))
 SELECT series_id, channel, {r('avg(CASE WHEN abs(p-y) < 1 THEN 0.5*(p-y)**2 ELSE abs(p-y)-0.5 END)', 6, 'huber')}, {r('abs(sqrt(avg(p*p))-sqrt(avg(y*y)))', 6, 'rms_gap')},
 {r('avg(CASE WHEN abs(d) < 1 THEN 0.5*d*d ELSE abs(d)-0.5 END)', 6, 'derivative')}, {r('avg(0.5*lv+2*ln(1+(y-p)**2/exp(lv)/3))', 6, 'nll')} FROM d GROUP BY ALL"""))
def forecast_error_components(t):
    rows = t.readings.select("series_id", "channel", "seq", F.col("value").alias("target"), (F.col("value") * 0.9 + F.sin("seq")).alias("predicted"), (F.col("seq") % 3 - 1.0).alias("log_var"))
    return round_columns(evaluate.forecast_error_components(rows, ["series_id", "channel"]), ["huber", "rms_gap", "derivative", "nll"])


@query("SELECT vec_id AS id, (list_position(embedding, list_max(embedding)) - 1)::INTEGER AS predicted_class FROM embeddings")
def finalize_class(t):
    return evaluate.finalize_class(t.vectors, "embedding").select("id", "predicted_class")


@query(f"SELECT l_partkey, CASE WHEN count(*) > 1 THEN {r('stddev_samp(l_quantity)', 7)} END AS uncertainty FROM lineitem GROUP BY l_partkey")
def prediction_spread(t):
    return round_columns(evaluate.prediction_spread(t.read("lineitem"), ["l_partkey"], "l_quantity"), ["uncertainty"], 7)


@query("SELECT 'v' || (l_orderkey % 7) AS name, " + ", ".join(r(f"avg(l_tax) FILTER (l_linenumber = {n})", 7, f"n_{n}") for n in (1, 2, 3, 4)) + " FROM lineitem GROUP BY 1")
def ablation_pivot(t):
    results = t.read("lineitem").groupBy(F.concat(F.lit("v"), F.col("l_orderkey") % 7).alias("name"), F.col("l_linenumber").alias("few_shot_n")).agg(F.avg("l_tax").alias("test_mae"))
    return round_columns(evaluate.ablation_pivot(results, [1, 2, 3, 4]), [f"n_{n}" for n in (1, 2, 3, 4)], 7)


@query(with_tables("readings", body=CONTEXT + f""", p AS (SELECT tg.horizon, tg.value AS y, l.value AS b, 0.3*l.value + 0.7*tg.value + (tg.horizon % 3)*60 AS m FROM tg JOIN readings l USING ({BY}) WHERE l.seq = 5),
 h AS (SELECT horizon, sqrt(avg((m-y)**2)) AS mr, sqrt(avg((b-y)**2)) AS br FROM p GROUP BY horizon), g AS (SELECT *, (br-mr)/br AS gain FROM h)
 SELECT horizon, {r('mr', 6, 'model_rmse')}, {r('br', 6, 'baseline_rmse')}, {r('gain', 6, 'rmse_improvement')}, gain >= 0.15 AS reached, bool_and(gain >= 0.15) OVER () AS passed FROM g"""))
def release_gate(t):
    readings = t.readings.drop("ts")
    rows = series.persistence_forecast(readings, series.horizon_targets(readings, 6, [2, 4, 8]), 6)
    model = F.col("persistence") * 0.3 + F.col("value") * 0.7 + F.col("horizon") % 3 * 60
    scored = rows.select("horizon", F.col("value").alias("target"), F.col("persistence"), model.alias("model"))
    out = evaluate.release_gate(
        evaluate.regression_metrics(scored, ["horizon"], predicted="model"), evaluate.regression_metrics(scored, ["horizon"], predicted="persistence")
    )
    return round_columns(out, ["model_rmse", "baseline_rmse", "rmse_improvement"])


@query(f"WITH c AS ({CLASSES}), a AS (SELECT source, avg((target = predicted)::INT) AS accuracy FROM c GROUP BY source) SELECT source, {r('accuracy', 6, 'accuracy')}, {r('0.5 - accuracy', 6, 'gap')} FROM a")
def evaluate_few_shot(t):
    out = evaluate.evaluate_few_shot(_classes(t), False, ["source"])
    return round_columns(out.withColumn("gap", evaluate.performance_gap(F.col("accuracy"), F.lit(0.5), True)), ["accuracy", "gap"])


SECONDS = ", e AS (SELECT series_id, channel, seq, value, (epoch_us(ts) - 1704067200000000)/1e6 AS time_s FROM readings)"


def _timed(t):
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 1e6
    return t.readings.withColumn("time_s", seconds).drop("ts")


@query(with_tables("readings", body=SECONDS + f""", w AS (SELECT series_id, seq AS window_id, time_s AS start, time_s + 86400.0 AS "end" FROM e WHERE channel = 'rpm')
 SELECT e.series_id, window_id, count(*) AS rows, {r('sum(value)', 5, 'total')} FROM e JOIN w ON e.series_id = w.series_id AND time_s >= start AND time_s < "end" WHERE channel <> 'rpm' GROUP BY ALL"""))
def range_align(t):
    timed = _timed(t)
    windows = timed.filter(F.col("channel") == "rpm").select("series_id", F.col("seq").alias("window_id"), F.col("time_s").alias("start"), (F.col("time_s") + 86400.0).alias("end"))
    fast = timed.filter(F.col("channel") != "rpm")
    return align.range_align(fast, windows, 86400.0).groupBy("series_id", "window_id").agg(F.count(F.lit(1)).alias("rows"), rounded(F.sum("value"), 5).alias("total"))


@query(with_tables("readings", body=SECONDS + f""", s AS (SELECT series_id, channel, min(time_s) AS a, max(time_s) AS b FROM e GROUP BY ALL), o AS (SELECT series_id, max(a) AS a, min(b) AS b FROM s GROUP BY ALL)
 SELECT series_id, CASE WHEN b > a THEN {r('a', 6)} END AS start, CASE WHEN b > a THEN {r('b', 6)} END AS "end" FROM o"""))
def overlap_range(t):
    return round_columns(align.overlap_range(_timed(t)), ["start", "end"])


@query("""WITH q AS (SELECT user_id AS series_id, ts, event_id FROM events WHERE event_type = 'purchase'), k AS (SELECT user_id AS series_id, ts, event_id, value FROM events WHERE event_type = 'view')
 SELECT q.series_id, q.event_id, count(k.event_id) AS visible_keys, arg_max(k.value, (k.ts, k.event_id)) AS as_of FROM q LEFT JOIN k ON q.series_id = k.series_id AND k.ts <= q.ts GROUP BY ALL""")
def as_of_join(t):
    events = t.read("events").select(F.col("user_id").alias("series_id"), F.col("ts").alias("time"), F.col("event_id").alias("id"), "event_type", "value")
    out = align.as_of_join(
        events.filter(F.col("event_type") == "purchase").drop("value", "event_type"), events.filter(F.col("event_type") == "view"),
        "value",
    )
    return out.select("series_id", F.col("id").alias("event_id"), "visible_keys", "as_of")


@query(with_tables("readings", body=CONTEXT + f""", p AS (SELECT tg.horizon, tg.value AS y, l.value AS b, sinh(greatest(-30, least(30, 0.9*tg.normalized)))*st.scale + st.center AS m FROM tg JOIN readings l USING ({BY}) JOIN st USING ({BY}) WHERE l.seq = 5),
 h AS (SELECT horizon, sqrt(avg((m-y)**2)) AS mr, sqrt(avg((b-y)**2)) AS br FROM p GROUP BY horizon) SELECT horizon, {r('mr', 5, 'model_rmse')}, {r('br', 5, 'baseline_rmse')}, {r('(br-mr)/br', 5, 'rmse_improvement')},
 (br-mr)/br >= 0.15 AS reached, bool_and((br-mr)/br >= 0.15) OVER () AS passed FROM h"""))
def evaluate_forecast(t):
    from swarf.plans.forecast import evaluate_forecast as evaluate_plan

    readings = t.readings.drop("ts")
    targets = series.horizon_targets(readings, 6, [2, 4, 8])
    guesses = targets.select("series_id", "channel", "horizon", "step", (F.col("normalized") * 0.9).alias("predicted"))
    return round_columns(evaluate_plan(readings, guesses, 6, [2, 4, 8]), ["model_rmse", "baseline_rmse", "rmse_improvement"], 5)
