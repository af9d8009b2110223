"""Queries on few-shot prediction, models, augmentation and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from swarf.functions.rounding import round_columns, rounded
from swarf.operators import augment, batch, evaluate, fewshot, metric, models, physics, series, spectral, splits
from swarf.operators.lineage import checkpointed, stored
from swarf.queries.physics import PREPARED, prepared
from swarf.queries.registry import query, r
from swarf.queries.series import BY
from swarf.queries.spectral import PROFILE_COLUMNS, profile
from swarf.sources.tables import with_tables

SUPPORT = """, s AS (SELECT * FROM vectors ORDER BY id LIMIT 20), q AS (SELECT * FROM vectors WHERE id NOT IN (SELECT id FROM s)),
 p AS (SELECT q.id, s.id AS support_id, s.label, q.label AS truth, list_distance(q.embedding, s.embedding) AS d FROM q, s),
 k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, support_id) AS k FROM p)"""

# regression and forecasts: a stated query set against all other rows
WHOLE = SUPPORT.replace("SELECT * FROM vectors ORDER BY id LIMIT 20", "SELECT * FROM vectors WHERE id % 20 <> 0").replace("WHERE id NOT IN (SELECT id FROM s)", "WHERE id % 20 = 0")


def _whole(t):
    return t.vectors.filter("id % 20 = 0"), t.vectors.filter("id % 20 <> 0")


def _support(t):
    support = splits.cap_support(t.vectors, "id")
    return t.vectors.join(support.select("id"), "id", "left_anti"), support


@query(with_tables("vectors", body=SUPPORT + f" SELECT id, (k-1)::INTEGER AS pos, support_id, {r('d', 6, 'distance')} FROM k WHERE k <= 3"))
def knn_join(t):
    near = fewshot.knn_join(*_support(t), 3)
    return near.select("id", F.posexplode("neighbors").alias("pos", "n")).select("id", "pos", "n.support_id", rounded("n.distance").alias("distance"))


@query(with_tables("vectors", body=f""", s AS (SELECT * FROM vectors WHERE label < 7), q AS (SELECT * FROM vectors WHERE label >= 7),
 k AS (SELECT q.id, s.id AS support_id, list_distance(q.embedding, s.embedding) AS d, row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.embedding, s.embedding), s.id) AS k FROM q, s)
 SELECT id, (k-1)::INTEGER AS pos, support_id, {r('d', 6, 'distance')} FROM k WHERE k <= 3"""))
def knn_join_blocks(t):
    near = metric.nearest(t.vectors.filter("label >= 7"), t.vectors.filter("label < 7"), 3)
    return near.select("id", F.posexplode("neighbors").alias("pos", "n")).select("id", "pos", "n.support_id", rounded("n.distance").alias("distance"))


@query(with_tables("vectors", body=WHOLE + f" SELECT id, {r('sum(label/(d+1e-8))/sum(1/(d+1e-8))', 6, 'prediction')}, {r('max(label)-min(label)', 6, 'uncertainty')} FROM k WHERE k <= 3 GROUP BY id"))
def knn_regression(t):
    return round_columns(fewshot.knn_predict(*_whole(t), 3).select("id", "prediction", "uncertainty"), ["prediction", "uncertainty"])


@query(with_tables("vectors", body=SUPPORT + f""", v AS (SELECT id, label, count(*) AS n, min(k) AS f FROM k WHERE k <= 5 GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, f) AS o FROM v)
 SELECT id, 'k' || label AS prediction, {r('n/5.0', 6, 'share')} FROM o WHERE o = 1"""))
def knn_class(t):
    named = lambda df: df.withColumn("label", F.concat(F.lit("k"), "label"))
    q, s = _support(t)
    return round_columns(fewshot.knn_predict(named(q), named(s), 5, False).select("id", "prediction", "share"), ["share"])


PROTO = """, e AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM s), mv AS (SELECT label, i, avg(x) AS x FROM e GROUP BY ALL), pt AS (SELECT label, list(x ORDER BY i) AS m FROM mv GROUP BY label),
 pd AS (SELECT q.id, pt.label, list_distance(q.embedding, m) AS d FROM q, pt)"""


@query(with_tables("vectors", body=SUPPORT + PROTO + f" SELECT id, 'k' || arg_min(label, d) AS prediction, {r('min(d)', 6, 'distance')}, {r('arg_min(1/(d+1e-8), d)/sum(1/(d+1e-8))', 6, 'share')} FROM pd GROUP BY id"))
def prototype_predict(t):
    named = lambda df: df.withColumn("label", F.concat(F.lit("k"), "label"))
    q, s = _support(t)
    out = fewshot.prototype_predict(named(q), named(s))
    return out.select("id", "prediction", rounded("distance").alias("distance"), rounded(F.col("shares")[F.col("prediction")]).alias("share"))


@query(with_tables("vectors", body=SUPPORT + f" SELECT id, label AS prediction, {r('1/(d+1e-8)', 6, 'influence')} FROM p WHERE support_id = 0"))
def one_shot_predict(t):
    return round_columns(fewshot.one_shot_predict(*_support(t)).select("id", "prediction", "influence"), ["influence"])


def _forecast_frames(t):
    q, s = _whole(t)
    both = lambda df: df.withColumns({"target": F.slice("embedding", 1, 8), "base": F.slice("embedding", 9, 8)})
    return both(q), both(s)


BLEND = """, w AS (SELECT q.id, s.id AS sid, 1/(list_distance(q.embedding, s.embedding)+1e-8) AS w, s.embedding AS se, q.embedding AS qe FROM q, s),
 st AS (SELECT id, i, sum(w*(se[i]-se[i+8]))/sum(w) AS cor, sum(w*se[i])/sum(w) AS fut, any_value(qe[i+8]) AS base FROM w, (SELECT unnest(range(1,9)) AS i) GROUP BY id, i)"""


def _steps(df, *extra):
    return df.select("id", F.posexplode("prediction").alias("pos", "prediction"), *extra)


@query(with_tables("vectors", body=WHOLE + BLEND + f" SELECT id, (i-1)::INTEGER AS pos, {r('base+cor', 6, 'prediction')}, {r('avg(abs(cor)) OVER (PARTITION BY id)', 6, 'uncertainty')} FROM st"))
def residual_forecast(t):
    return round_columns(_steps(fewshot.residual_forecast(*_forecast_frames(t), 8), "uncertainty"), ["prediction", "uncertainty"])


@query(with_tables("vectors", body=WHOLE + BLEND + f" SELECT id, (i-1)::INTEGER AS pos, {r('fut', 6, 'prediction')}, {r('avg(abs(fut-base)) OVER (PARTITION BY id)', 6, 'uncertainty')} FROM st"))
def knn_forecast(t):
    return round_columns(_steps(fewshot.knn_forecast(*_forecast_frames(t), 8), "uncertainty"), ["prediction", "uncertainty"])


@query()
def ridge_forecast(t):
    return round_columns(_steps(models.ridge_forecast(*_forecast_frames(t), 8)), ["prediction"])


@query(with_tables("predictions", body=f" SELECT l_orderkey, l_linenumber, l_partkey, tool_id, l_shipdate, {r('(1-least(1,greatest(0,sin(target))))*predicted + least(1,greatest(0,sin(target)))*target', 6, 'prediction')} FROM predictions"))
def similarity_blend(t):
    out = fewshot.similarity_blend(t.predictions.withColumn("similarity", F.sin("target")), "predicted", "target", "similarity")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "tool_id", "l_shipdate", rounded("prediction").alias("prediction"))


@query("""WITH x AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN value::VARCHAR END AS s, json_extract_string(props, '$.k') AS k FROM events)
 SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'S' || event_id WHEN event_id % 4 = 1 THEN 'vb' WHEN event_id % 4 = 2 THEN k ELSE 'col' || event_id END AS label_value FROM x""")
def label_value(t):
    key = F.col("event_id") % 4
    labels = F.when(key == 1, F.create_map(F.lit("vb"), F.lit("vb"), F.lit("other"), F.lit("o"))).when(key == 2, F.from_json("props", "map<string,string>"))
    samples = t.read("events").select(
        "event_id", F.when(key == 0, F.concat(F.lit("S"), "event_id")).alias("label_scalar"), labels.alias("label_map"),
        F.when(key == 3, F.create_map(F.lit("target"), F.concat(F.lit("col"), "event_id"))).alias("columns"),
    )
    return fewshot.label_value(samples, "toolwear_regression").select("event_id", "label_value")


@query("WITH l AS (SELECT source, CASE WHEN source = 'src3' AND doc_id % 50 = 1 THEN 'bad' ELSE (doc_id % 5)::VARCHAR END AS v FROM documents) SELECT source, bool_and(try_cast(v AS DOUBLE) IS NOT NULL) AS regression FROM l GROUP BY source")
def is_regression(t):
    odd = (F.col("source") == "src3") & (F.col("doc_id") % 50 == 1)
    labels = t.read("documents").select("source", F.when(odd, "bad").otherwise((F.col("doc_id") % 5).cast("string")).alias("label_value"))
    return fewshot.is_regression(labels, by=("source",))


# --- models ------------------------------------------------------------------------------------------

RIDGE = """, tr AS (SELECT * FROM cuts WHERE condition_id NOT IN ('c5','c6')), g AS (SELECT count(*) AS n, avg(force_n) AS m1, avg(cutting_speed) AS m2, avg({y}) AS my, var_pop(force_n)*count(*)+1 AS a, covar_pop(force_n, cutting_speed)*count(*) AS b,
 var_pop(cutting_speed)*count(*)+1 AS c, covar_pop(force_n, {y})*count(*) AS u, covar_pop(cutting_speed, {y})*count(*) AS v FROM tr),
 w AS (SELECT m1, m2, my, (c*u-b*v)/(a*c-b*b) AS w1, (a*v-b*u)/(a*c-b*b) AS w2 FROM g)"""


def _split_cuts(t):
    cuts = t.cuts.select("tool_id", "cut", "condition_id", "force_n", "cutting_speed", "wear_vb_mm")
    return cuts, cuts.filter(~F.col("condition_id").isin("c5", "c6"))


@query(with_tables("cuts", body=RIDGE.format(y="wear_vb_mm") + f" SELECT tool_id, cut, {r('my + w1*(force_n-m1) + w2*(cutting_speed-m2)', 6, 'predicted')} FROM cuts, w WHERE condition_id = 'c6'"))
def wear_ridge(t):
    cuts, train = _split_cuts(t)
    model = models.fit_ridge(train, ["force_n", "cutting_speed"], "wear_vb_mm")
    out = models.apply_ridge(model, cuts.filter("condition_id = 'c6'"), ["force_n", "cutting_speed"])
    return out.select("tool_id", "cut", rounded("predicted").alias("predicted"))


@query(with_tables("cuts", body=", c0 AS (SELECT *, cut * 1.5 AS rul FROM cuts)" + RIDGE.replace("FROM cuts WHERE", "FROM c0 WHERE").format(y="rul") + f" SELECT tool_id, cut, {r('greatest(600, my + w1*(force_n-m1) + w2*(cutting_speed-m2))', 4, 'predicted')} FROM c0, w WHERE condition_id = 'c6'".replace("greatest(600", "greatest(0")))
def rul_ridge(t):
    cuts, train = _split_cuts(t)
    model = models.fit_ridge(train.withColumn("rul", F.col("cut") * 1.5), ["force_n", "cutting_speed"], "rul")
    out = models.apply_ridge(model, cuts.filter("condition_id = 'c6'"), ["force_n", "cutting_speed"], floor=0.0)
    return out.select("tool_id", "cut", rounded("predicted", 4).alias("predicted"))


@query(with_tables("cuts", body=RIDGE.format(y="wear_vb_mm").replace(" FROM cuts WHERE", ", 0 AS z FROM cuts WHERE").replace("WHERE condition_id NOT IN ('c5','c6')", "").replace("g AS (SELECT ", "g AS (SELECT condition_id, ").replace("FROM tr)", "FROM tr GROUP BY condition_id)").replace("w AS (SELECT ", "w AS (SELECT condition_id, ") + f" SELECT tool_id, cut, {r('my + w1*(force_n-m1) + w2*(cutting_speed-m2)', 6, 'predicted')} FROM cuts JOIN w USING (condition_id)"))
def grouped_ridge(t):
    cuts, _ = _split_cuts(t)
    weights = models.grouped_ridge(cuts, ["condition_id"], ["force_n", "cutting_speed"], "wear_vb_mm")
    return models.apply_grouped(cuts, weights, ["condition_id"], ["force_n", "cutting_speed"], "predicted").select("tool_id", "cut", rounded("predicted").alias("predicted"))


CALIBRATED = PREPARED + """, b AS (SELECT *, least(1, elapsed_min/pow(taylor_c/(cutting_speed*pow(feed,taylor_m)*pow(axial_depth,taylor_p)), 1/taylor_n)) AS tl, 0.05::DOUBLE + force_n/50000 AS p FROM k),
 g AS (SELECT avg(p) AS m1, stddev_pop(p) AS s1, avg(tl) AS m2, stddev_pop(tl) AS s2, avg(wear_vb_mm) AS my, count(*)+1.0 AS a, corr(p, tl)*count(*) AS b, covar_pop(p, wear_vb_mm)/stddev_pop(p)*count(*) AS u, covar_pop(tl, wear_vb_mm)/stddev_pop(tl)*count(*) AS v
  FROM b WHERE condition_id NOT IN ('c5','c6')), w AS (SELECT *, (a*u-b*v)/(a*a-b*b) AS w1, (a*v-b*u)/(a*a-b*b) AS w2 FROM g),
 f AS (SELECT b.*, my + w1*(b.p-m1)/s1 + w2*(b.tl-m2)/s2 AS g FROM b, w)"""


def _calibrated(t):
    cuts = physics.tool_life_features(prepared(t)).withColumn("predicted", 0.05 + F.col("force_n") / 50000)
    fitted = models.fit_calibrator(cuts.filter(~F.col("condition_id").isin("c5", "c6")), "predicted", ["tool_life_ratio"], "wear_vb_mm")
    return models.apply_calibrator(cuts, fitted, "predicted", ["tool_life_ratio"])


@query(with_tables("cuts", body=CALIBRATED + f" SELECT tool_id, cut, {r('g', 6, 'corrected')} FROM f WHERE condition_id = 'c6'"))
def calibrator(t):
    return _calibrated(t).filter("condition_id = 'c6'").select("tool_id", "cut", rounded("corrected").alias("corrected"))


@query(with_tables("cuts", body=CALIBRATED + f""", a AS (SELECT i*0.1 AS alpha, avg(abs((1-i*0.1)*p + i*0.1*g - wear_vb_mm)) AS mae FROM f, (SELECT unnest(range(0, 11)) AS i) WHERE condition_id = 'c5' GROUP BY i)
 SELECT {r('arg_min(alpha, mae)', 6, 'alpha')}, {r('min(mae)', 6, 'val_mae')} FROM a"""))
def select_alpha(t):
    out = models.select_alpha(_calibrated(t).filter("condition_id = 'c5'"), "predicted", "corrected", "wear_vb_mm")
    return round_columns(out, ["alpha", "val_mae"])


STUDY_FEATURES = ["force_n", "cutting_speed", "axial_depth"]


def _study_frames(t):
    cuts = physics.energy_features(physics.tool_life_features(prepared(t)))
    cuts = cuts.withColumns({"kc11": F.coalesce("kc11", F.lit(1800.0)), "mc": F.coalesce("mc", F.lit(0.26)), "measured_force_n": F.col("force_n")})
    # every model and score reads these columns again, so they are derived and written once
    narrow = splits.condition_split(physics.force_features(cuts)).select("split", "tool_id", "cut", *STUDY_FEATURES, "wear_vb_mm", *models.PHYSICS)
    parts = stored(narrow).withColumn("key", F.concat_ws("-", "tool_id", "cut"))
    train = parts.filter("split = 'train'")
    few = checkpointed(splits.few_shot_grid(train, "key", [s for s in models.SHOTS if s is not None]))
    return few.unionByName(splits.few_shot_grid(train, "key", [None])), parts.filter("split = 'val'"), parts.filter("split = 'test'")


@query()
def ablation_study(t):
    out = models.ablation_study(*_study_frames(t), STUDY_FEATURES, "wear_vb_mm")
    return round_columns(out, ["val_mae", "val_rmse", "val_r2", "test_mae", "test_rmse", "test_r2"], 5)


@query()
def few_shot_curve(t):
    out = models.few_shot_curve(*_study_frames(t), STUDY_FEATURES, "wear_vb_mm")
    return round_columns(out, [c for c in out.columns if c != "shots"], 4)


@query()
def stage_logistic(t):
    cuts, _ = _split_cuts(t)
    staged = physics.wear_stage(cuts)
    model = models.fit_logistic(staged.filter(~F.col("condition_id").isin("c5", "c6")), ["force_n", "cutting_speed"], "wear_stage")
    out = models.apply_logistic(model, staged.filter("condition_id = 'c6'"), ["force_n", "cutting_speed"])
    return evaluate.classification_metrics(out.withColumnRenamed("wear_stage", "target"))


@query()
def linear_probe(t):
    q, s = _whole(t)
    return models.apply_ridge(models.fit_ridge(s, "embedding", "label"), q, "embedding").select("id", rounded("predicted", 4).alias("predicted"))


CENTERS = ", c AS (SELECT id, embedding AS m, row_number() OVER (ORDER BY id) - 1 AS cluster FROM vectors ORDER BY id LIMIT 8), d AS (SELECT v.id, cluster, list_distance(v.embedding, m) AS d FROM vectors v, c), n AS (SELECT id, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d FROM d GROUP BY id)"


@query(with_tables("vectors", body=CENTERS + f" SELECT id, cluster::INTEGER AS cluster, {r('d', 6, 'distance')}, CASE WHEN d <= 0.9 THEN 'high' WHEN d <= 1.8 THEN 'medium' ELSE 'low' END AS confidence FROM n"))
def assign_clusters(t):
    centers = t.vectors.orderBy("id").limit(8)
    held = t.vectors.withColumn("_s", fewshot.pack_support(centers)).withColumn("_c", F.transform("_s", lambda s: s["embedding"]))
    out = models.assign_clusters(held, F.col("_c"), 0.9, "embedding")
    return out.select("id", "cluster", rounded("distance").alias("distance"), "confidence")


@query()
def latent_clusters(t):
    profiles = profile(t)
    stats, centers, scales = models.fit_clusters(profiles, PROFILE_COLUMNS)
    held = models.standardized_profile(profiles, PROFILE_COLUMNS, stats)
    out = models.assign_families(held, centers, scales)
    return out.select("series_id", "family", "cluster", rounded("distance", 4).alias("distance"), "confidence")


# --- augmentation ------------------------------------------------------------------------------------


def U(parts, salt):
    return f"(('0x'||substr(sha1(concat_ws('|', {parts}, '{salt}')),1,8))::BIGINT/4294967296.0)"


def H(parts, salt):
    return f"('0x'||substr(sha1(concat_ws('|', {parts}, '{salt}')),1,8))::BIGINT"


@query(with_tables("readings", body=f" SELECT series_id, channel, seq, {r('value*(0.8+0.4*' + U('series_id', 'gain') + ')', 6, 'value')} FROM readings"))
def augment_amplitude(t):
    return round_columns(augment.augment_amplitude(t.readings.drop("ts"), 0.8, 1.2, "gain"), ["value"])


@query(with_tables("readings", body=f" SELECT series_id, channel, seq, {r('value + 0.1*stddev_pop(value) OVER w * (CASE WHEN count(*) OVER w > 1 THEN seq/(count(*) OVER w - 1) - 0.5 ELSE 0 END)', 6, 'value')} FROM readings WINDOW w AS (PARTITION BY series_id, channel)"))
def bias_drift(t):
    return round_columns(augment.bias_drift(t.readings.drop("ts"), 0.1), ["value"])


def _gauss(parts, salt):
    return f"sqrt(-2*ln(1-{U(parts, salt + '/r')}))*cos(6.283185307179586*{U(parts, salt + '/a')})"


@query(with_tables("readings", body=f" SELECT series_id, channel, seq, {r('value + 0.05*(' + _gauss('series_id, channel', 'j/shared') + ' + 0.25*' + _gauss('series_id, channel, seq', 'j/own') + ')*greatest(stddev_pop(value) OVER w, 1e-6)', 6, 'value')} FROM readings WINDOW w AS (PARTITION BY series_id, channel)"))
def jitter(t):
    return round_columns(augment.jitter(t.readings.drop("ts"), 0.05, "j"), ["value"])


@query(with_tables("readings", body=f""", n AS (SELECT series_id, max(seq)+1 AS n FROM readings GROUP BY series_id), s AS (SELECT series_id, greatest(1, floor(n*0.2))::BIGINT AS w, {H('series_id', 'm/start')} % greatest(1, n-greatest(1, floor(n*0.2))::BIGINT+1) AS a, {U('series_id', 'm/gate')} < 0.5 AS g FROM n)
 SELECT series_id, channel, seq, CASE WHEN g AND seq >= a AND seq < a+w THEN 0.0::DOUBLE ELSE value END AS value FROM readings JOIN s USING (series_id)"""))
def time_mask(t):
    return augment.time_mask(t.readings.drop("ts"), 0.5, 0.2, "m")


@query(with_tables("readings", body=f""", k AS (SELECT *, {U('series_id, channel', 'd')} >= 0.6 AS keep FROM readings), a AS (SELECT series_id, bool_or(keep) AS al FROM k GROUP BY series_id)
 SELECT series_id, channel, seq, CASE WHEN al AND NOT keep THEN 0.0::DOUBLE ELSE value END AS value FROM k JOIN a USING (series_id)"""))
def drop_channel(t):
    return augment.drop_channel(t.readings.drop("ts"), 0.6, "d")


@query()
def spectral_augment(t):
    return round_columns(augment.spectral_augment(t.readings.drop("ts"), "s", 0.05, 0.1, 0.02, 0.9), ["value"], 5)


@query(with_tables("readings", body=f""", l AS (SELECT {BY}, list(value ORDER BY seq) AS v, count(*) AS n FROM readings GROUP BY ALL), g AS (SELECT *, unnest(range(0, n)) AS j FROM l),
 p AS (SELECT *, least(1.0::DOUBLE, CASE WHEN n > 1 THEN j/(n-1) ELSE 0 END * 1.07::DOUBLE)*(n-1) AS pos FROM g)
 SELECT series_id, channel, j AS pos, {r('v[floor(pos)::BIGINT+1]*(1-(pos-floor(pos))) + v[least(n-1, floor(pos)::BIGINT+1)+1]*(pos-floor(pos))', 6, 'value')} FROM p"""))
def speed_resample(t):
    return round_columns(augment.speed_resample(t.readings.drop("ts"), 1.07), ["value"])


@query(with_tables("readings", body=f""", f0 AS (SELECT series_id, channel, seq AS bin, value*(0.9+0.2*{U('series_id', 'f/gain')}) AS v FROM readings), n AS (SELECT series_id, max(bin)+1 AS n FROM f0 GROUP BY series_id),
 s AS (SELECT series_id, greatest(1, floor(n*0.1))::BIGINT AS w1, {H('series_id', 'f/mask')} % greatest(1, n-greatest(1, floor(n*0.1))::BIGINT+1) AS a1, {U('series_id', 'f/mask?')} < 0.5 AS g1,
  greatest(1, floor(n*0.15))::BIGINT AS w2, {H('series_id', 'f/drop')} % greatest(1, n-greatest(1, floor(n*0.15))::BIGINT+1) AS a2, {U('series_id', 'f/drop?')} < 0.4 AS g2 FROM n),
 m AS (SELECT series_id, channel, bin, CASE WHEN (g1 AND bin >= a1 AND bin < a1+w1) OR (g2 AND bin >= a2 AND bin < a2+w2) THEN 0 ELSE v END AS v FROM f0 JOIN s USING (series_id))
 SELECT series_id, channel, bin, {r('(coalesce(lag(v) OVER w, v) + v + coalesce(lead(v) OVER w, v))/3', 6, 'value')} FROM m WINDOW w AS (PARTITION BY series_id, channel ORDER BY bin)"""))
def augment_frequency(t):
    bins = t.readings.select("series_id", "channel", F.col("seq").alias("bin"), "value")
    return round_columns(augment.augment_frequency(bins, "f", (0.9, 1.1), 0.5, 0.1, 0.4, 0.15, True), ["value"])


@query("""WITH m AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'steel' WHEN 1 THEN 'brass' ELSE 'wood' END AS material FROM part)
 SELECT p_partkey, CASE material WHEN 'steel' THEN 0.02 WHEN 'brass' THEN 0.5 ELSE 0.01 END::DOUBLE AS jitter, CASE material WHEN 'steel' THEN 0.1 WHEN 'brass' THEN 0.05 ELSE 0.5 END::DOUBLE AS drift FROM m""")
def material_config(t):
    configs = t.spark.createDataFrame([("steel", 0.02, 0.1), ("brass", None, 0.05), ("unknown", 0.01, None)], "material string, jitter double, drift double")
    material = F.when(F.col("p_size") % 3 == 0, "steel").when(F.col("p_size") % 3 == 1, "brass").otherwise("wood")
    samples = t.read("part").select("p_partkey", material.alias("material"))
    return augment.material_config(samples, configs, ["jitter", "drift"], {"jitter": 0.5, "drift": 0.5}).select("p_partkey", "jitter", "drift")


@query(f"""SELECT event_id, {U('event_id', 'x/value')} >= 0.3 AS value_mask, CASE WHEN {U('event_id', 'x/value')} >= 0.3 THEN value END AS value, {U('event_id', 'x/props')} >= 0.3 AS props_mask FROM events""")
def modality_dropout(t):
    out = augment.dropout(t.read("events").select("event_id", "value", "props"), ["event_id"], 0.3, "x", ["value", "props"])
    return out.select("event_id", "value_mask", "value", "props_mask")


@query(f"""WITH c AS (SELECT event_id, 'value' AS name, value FROM events UNION ALL SELECT event_id, 'user', user_id::DOUBLE FROM events UNION ALL SELECT event_id, 'day', date_part('day', ts)::DOUBLE FROM events)
 SELECT event_id, name, {U('event_id, name', 'c')} >= 0.3 AS kept, CASE WHEN {U('event_id, name', 'c')} >= 0.3 THEN value END AS value FROM c""")
def condition_dropout(t):
    entries = {"value": F.col("value"), "user": F.col("user_id").cast("double"), "day": F.dayofmonth("ts").cast("double")}
    events = t.read("events").select("event_id", F.create_map(*[c for n, v in entries.items() for c in (F.lit(n), v)]).alias("conditions"))
    out = augment.condition_dropout(events, ["event_id"], 0.3, "c")
    flat = out.select("event_id", "conditions_mask", F.explode("conditions").alias("name", "value"))
    return flat.select("event_id", "name", F.element_at("conditions_mask", F.col("name")).alias("kept"), "value")


# --- batches -----------------------------------------------------------------------------------------

SLOTS = """, v AS (SELECT series_id AS sample_id, channel, list(value ORDER BY seq) AS values FROM readings GROUP BY ALL), sl AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY channel) - 1 AS slot FROM v WHERE NOT (sample_id % 3 = 0 AND channel = 'rpm')),
 nb AS (SELECT sample_id, (row_number() OVER (ORDER BY sample_id) - 1) // 8 AS batch FROM (SELECT DISTINCT sample_id FROM sl))"""


def _slots(t):
    from pyspark.sql import Window as W

    arrays = spectral.window_arrays(t.readings.drop("ts")).withColumnRenamed("series_id", "sample_id")
    kept = arrays.filter(~((F.col("sample_id") % 3 == 0) & (F.col("channel") == "rpm")))
    return kept.withColumn("slot", F.row_number().over(W.partitionBy("sample_id").orderBy("channel")) - 1).select("sample_id", "slot", "values")


@query(with_tables("readings", body=SLOTS + f""", sh AS (SELECT batch, max(slot)+1 AS c, max(len(values)) AS t FROM sl JOIN nb USING (sample_id) GROUP BY batch), g AS (SELECT nb.sample_id, batch, unnest(range(0, c)) AS slot, t FROM nb JOIN sh USING (batch))
 SELECT batch, g.sample_id, g.slot::INTEGER AS slot, sl.values IS NOT NULL AS mask, t::INTEGER AS length, {r('coalesce(list_sum(sl.values), 0)', 5, 'total')} FROM g LEFT JOIN sl ON sl.sample_id = g.sample_id AND sl.slot = g.slot"""))
def pad_batches(t):
    out = batch.pad_batches(_slots(t), 8)
    return out.select("batch", "sample_id", "slot", "mask", F.size("values").alias("length"), rounded(F.aggregate("values", F.lit(0.0), lambda a, v: a + v), 5).alias("total"))


@query("SELECT vec_id AS sample_id, len(embedding)::INTEGER AS embedding_size, true AS embedding_finite FROM embeddings")
def preflight(t):
    return batch.preflight(t.vectors.withColumnRenamed("id", "sample_id"), ["embedding"])


@query("""WITH n AS (SELECT doc_id FROM documents WHERE doc_id % 4 = 0), o AS (SELECT doc_id, row_number() OVER (ORDER BY sha1(doc_id || '|42'), doc_id) AS k FROM documents WHERE doc_id % 4 <> 0)
 SELECT doc_id, 'new' AS origin FROM n UNION ALL SELECT doc_id, 'replay' FROM o WHERE k <= (SELECT round(count(*) * 1.0) FROM n)""")
def replay_mix(t):
    docs = t.read("documents").select("doc_id")
    return batch.replay_mix(docs.filter("doc_id % 4 = 0"), docs.filter("doc_id % 4 <> 0"), 0.5, "doc_id")


@query()
def training_table(t):
    from swarf.operators import nc
    from swarf.plans.corpus import training_table as build

    programs = t.nc_lines.select("program_id", F.concat(F.lit("nc/O"), "program_id", F.lit(".nc")).alias("path")).distinct()
    samples = t.events.select("series_id").distinct().withColumns(
        {"dataset_id": F.concat(F.lit("Set "), F.col("series_id") % 4), "file_path": F.concat(F.lit("/data/milling/m1/O"), "series_id", F.lit(".csv"))}
    )
    rows = build(samples, t.readings.drop("ts"), nc.program_keys(t.nc_lines, programs), window=16, rate=12800.0, vectors=nc.nc_vector(t.nc_lines))
    finite = lambda c: F.forall(c, lambda v: ~F.isnan(v)).alias(f"{c}_finite")
    return rows.select(
        "series_id", "channel", "channel_id", "context_source", F.size("values").alias("values_size"), finite("values"), F.size("frequency").alias("frequency_size"),
        finite("frequency"), F.size(F.filter("text_ids", lambda v: v > 0)).alias("text_tokens"),
        "nc_context_mask", F.size("nc_context").alias("nc_context_size"), finite("nc_context"),
    )


@query()
def request_few_shot(t):
    from swarf.plans.requests import predict_few_shot

    q, s = _support(t)
    out = predict_few_shot(q, s.withColumn("label", F.concat(F.lit("k"), "label")), "wear_state_classification", "prototype")
    return out.select("id", "prediction", rounded("distance").alias("distance"))
