"""Spectral queries; the SQL twins evaluate the Fourier sums directly."""

from __future__ import annotations

from pyspark.sql import functions as F

from swarf.functions.rounding import round_columns, rounded
from swarf.operators import features, fourier, spectral
from swarf.operators.channels import canonicalize_channels
from swarf.queries.channels import dimension_ctes
from swarf.queries.registry import query, r
from swarf.queries.series import ALIGNED, BY
from swarf.sources.tables import with_tables


def dft(source: str, n: str = "n", out: str = "sp") -> str:
    """CTE with the power per bin of rows (series_id, channel, j, x, n)."""
    return f""", {out} AS (SELECT series_id, channel, any_value({n}) AS n, k, sum(x*cos(2*pi()*k*j/{n}))**2 + sum(x*sin(2*pi()*k*j/{n}))**2 AS p
 FROM (SELECT *, unnest(range(0, {n}//2+1)) AS k FROM {source}) GROUP BY series_id, channel, k)"""


HEADS = ", c AS (SELECT series_id, channel, count(*) AS n, avg(value) AS mu FROM readings GROUP BY ALL), x AS (SELECT series_id, channel, seq AS j, value AS x, n FROM readings JOIN c USING (series_id, channel))"


@query(with_tables("readings", body=HEADS + dft("x") + f""", t AS (SELECT *, sum(p) OVER (PARTITION BY {BY}) + 1e-12 AS tot FROM sp)
 SELECT series_id, channel, {r('any_value(tot)', 4, 'band_energy')}, {r('sum(k*50.0/n*p/tot)', 5, 'spectral_centroid')}, {r('arg_max(k*50.0/n, (p, -k))', 6, 'dominant_frequency')},
 {r('-sum(p/tot*ln(p/tot+1e-12))', 5, 'spectral_entropy')} FROM t GROUP BY ALL"""))
def dft_features(t):
    out = spectral.dft_features(t.readings.drop("ts"), 50.0)
    out = round_columns(out, ["spectral_centroid", "spectral_entropy"], 5)
    return out.withColumns({"band_energy": rounded("band_energy", 4), "dominant_frequency": rounded("dominant_frequency")})


FREE = ", c AS (SELECT series_id, channel, count(*) AS n, avg(value) AS mu FROM readings GROUP BY ALL), x AS (SELECT series_id, channel, seq AS j, value - mu AS x, n FROM readings JOIN c USING (series_id, channel))"
PROFILE_SPECTRUM = dft("x") + f""", t AS (SELECT *, p/(sum(p) OVER (PARTITION BY {BY}) + 1e-12) AS q, n//2+1 AS m FROM sp),
 ps AS (SELECT series_id, channel, any_value(n) AS n, sum(q*k/(m-1)) AS centroid, -sum(q*ln(q+1e-12)) AS entropy, coalesce(sum(q) FILTER (k >= m//2), 0) AS high,
 coalesce(sum(q) FILTER (k >= m//4 AND k < greatest(m//4+1, m//2)), 0) AS mid, coalesce(sum(q) FILTER (k < greatest(1, m//4)), 0) AS low FROM t GROUP BY ALL)"""


@query(with_tables("readings", body=FREE + PROFILE_SPECTRUM + f""" SELECT series_id, channel, {', '.join(r(f'CASE WHEN n >= 4 THEN {c} ELSE 0 END', 5, c) for c in ('centroid','entropy','high','mid','low'))} FROM ps"""))
def profile_spectrum(t):
    return round_columns(spectral.profile_spectrum(t.readings.drop("ts")), ["centroid", "entropy", "high", "mid", "low"], 5)


@query(with_tables("readings", body=HEADS + dft("x") + f""", t AS (SELECT *, greatest(sum(p) OVER (PARTITION BY {BY}), 1e-8) AS tot, n//2+1 AS m, CASE WHEN n > 1 THEN k/(n//2) ELSE 0 END AS ax FROM sp),
 u AS (SELECT *, sum(p*ax) OVER (PARTITION BY {BY})/tot AS cen FROM t)
 SELECT series_id, channel, {r('coalesce(sum(p/tot) FILTER (k < greatest(1, m//8)), 0)', 5, 'low')}, {r('coalesce(sum(p/tot) FILTER (k >= m//8 AND k < greatest(m//2, m//8+1)), 0)', 5, 'mid')},
 {r('coalesce(sum(p/tot) FILTER (k >= greatest(1, m//2)), 0)', 5, 'high')}, {r('any_value(cen)', 5, 'centroid')}, {r('sqrt(sum(p*(ax-cen)**2/tot))', 5, 'spread')}, {r('arg_max(ax, (p, -k))', 5, 'peak')} FROM u GROUP BY ALL"""))
def band_profile(t):
    return round_columns(spectral.band_profile(t.readings.drop("ts")), ["low", "mid", "high", "centroid", "spread", "peak"], 5)


def grid(points: str) -> str:
    return f""", l AS (SELECT series_id, channel, list(value ORDER BY seq) AS v, count(*) AS n FROM readings GROUP BY ALL),
 g0 AS (SELECT *, ({points})::BIGINT AS m FROM l), g1 AS (SELECT *, unnest(range(0, m)) AS j FROM g0),
 g2 AS (SELECT *, CASE WHEN m > 1 THEN j*(n-1)/(m-1) ELSE 0 END AS pos FROM g1),
 g AS (SELECT series_id, channel, j, m, v[floor(pos)::BIGINT+1]*(1-(pos-floor(pos))) + v[least(n-1, floor(pos)::BIGINT+1)+1]*(pos-floor(pos)) AS y FROM g2)"""


@query(with_tables("readings", body=grid("greatest(1, round_even(n*48.0/30.0, 0))") + f" SELECT series_id, channel, j AS pos, {r('y', 6, 'value')} FROM g"))
def resample_linear(t):
    return round_columns(spectral.resample_linear(t.readings.drop("ts"), source_rate=30.0, target_rate=48.0), ["value"])


HANN = ", w AS (SELECT series_id, channel, j, m, y*(0.5-0.5*cos(2*pi()*j/(m-1))) AS x FROM g)"


@query(with_tables("readings", body=grid("256") + HANN + dft("w", "m") + f" SELECT series_id, channel, k::INTEGER AS bin, {r('ln(1+sqrt(p))', 6, 'magnitude')}, {r('ln(1+ln(1+sqrt(p))**2)', 6, 'log_power')} FROM sp"))
def fft_magnitude(t):
    out = spectral.fft_magnitude(t.readings.drop("ts"))
    bins = out.select("series_id", "channel", F.posexplode(F.arrays_zip("magnitude", "log_power")).alias("bin", "e"))
    return round_columns(bins.select("series_id", "channel", "bin", "e.*"), ["magnitude", "log_power"])


@query(with_tables("readings", body=grid("greatest(64, least(2048, 2**ceil(log2(greatest(8, n)))))") + HANN + dft("w", "m") + f""", t AS (SELECT *, k*12800.0/n AS f, sum(p) OVER (PARTITION BY {BY}) + 1e-8 AS tot FROM sp)
 SELECT series_id, channel, {r('coalesce(sum(p/tot) FILTER (f <= 100), 0)', 5, 'low_ratio')}, {r('coalesce(sum(p/tot) FILTER (f >= 100 AND f <= 1000), 0)', 5, 'mid_ratio')}, {r('coalesce(sum(p/tot) FILTER (f >= 1000 AND f <= 6400), 0)', 5, 'high_ratio')},
 {r('sum(p*f/tot)', 4, 'centroid')}, {r('arg_max(f, (p, -k))', 4, 'peak')} FROM t GROUP BY ALL"""))
def band_energy(t):
    out = spectral.band_energy(t.readings.drop("ts"), 12800.0)
    return round_columns(round_columns(out, ["low_ratio", "mid_ratio", "high_ratio"], 5), ["centroid", "peak"], 4)


@query(with_tables("readings", body=grid("128") + HANN + dft("w", "m") + f" SELECT series_id, channel, k::INTEGER AS bin, {r('ln(1+sqrt(p))', 6, 'value')} FROM sp UNION ALL SELECT series_id, channel, (k+65)::INTEGER, 0.0::DOUBLE FROM sp"))
def stft_summary(t):
    # no test series reaches one frame, so each is a single resampled frame without deviation
    out = spectral.stft_summary(t.readings.drop("ts"))
    return round_columns(out.select("series_id", "channel", F.posexplode("summary").alias("bin", "value")), ["value"])


@query(with_tables("readings", body=f""", n AS (SELECT series_id, channel, count(*) AS n FROM readings GROUP BY ALL), s AS (SELECT *, unnest(range(0,32)) AS scale FROM n),
 wd AS (SELECT series_id, channel, n, scale, greatest(2, floor(2 + scale*(least(64, greatest(3, n//4))-2)/31.0 + 1e-12)::BIGINT) AS width FROM s),
 bx AS (SELECT wd.series_id, wd.channel, wd.scale, wd.width, wd.n, a.seq, a.value AS v, sum(b.value)/any_value(wd.width) AS m FROM wd JOIN readings a USING (series_id, channel)
  JOIN readings b ON b.series_id=a.series_id AND b.channel=a.channel AND b.seq BETWEEN a.seq - wd.width//2 AND a.seq + (wd.width-1)//2 GROUP BY wd.series_id, wd.channel, wd.scale, wd.width, wd.n, a.seq, a.value)
 SELECT series_id, channel, scale::INTEGER AS scale, width::INTEGER AS width, {r('ln(1+sqrt(sum((v-m)**2)/any_value(n)))', 6, 'energy')} FROM bx GROUP BY ALL"""))
def width_energies(t):
    return round_columns(spectral.width_energies(t.readings.drop("ts")), ["energy"])


# series of hundreds of readings, cut into windows: all of them count
LONG = with_tables("cuts", body=", readings AS (SELECT tool_id AS series_id, 'w' || (cut // {n}) AS channel, cut % {n} AS seq, force_n / 1000 AS value FROM cuts)")


def _long(t, n):
    cuts = t.cuts.select(F.col("tool_id").alias("series_id"), F.lit("force").alias("channel"), F.col("cut").alias("seq"), (F.col("force_n") / 1000).alias("value"))
    return spectral.cut_windows(cuts, n)


def _window_names(df):
    return df.withColumn("channel", F.concat(F.lit("w"), "window")).drop("window")


@query(LONG.format(n=128) + HEADS + dft("x") + f""", t AS (SELECT *, sum(p) OVER (PARTITION BY {BY}) + 1e-12 AS tot FROM sp)
 SELECT series_id, channel, {r('any_value(tot)', 3, 'band_energy')}, {r('sum(k*50.0/n*p/tot)', 5, 'spectral_centroid')}, {r('-sum(p/tot*ln(p/tot+1e-12))', 5, 'spectral_entropy')} FROM t GROUP BY ALL""")
def dft_features_windows(t):
    out = _window_names(spectral.dft_features(_long(t, 128), 50.0, by=spectral.WINDOWED).drop("dominant_frequency"))
    return round_columns(round_columns(out, ["spectral_centroid", "spectral_entropy"], 5), ["band_energy"], 3)


@query(LONG.format(n=96) + HEADS + dft("x") + f""", t AS (SELECT *, greatest(sum(p) OVER (PARTITION BY {BY}), 1e-8) AS tot, n//2+1 AS m, CASE WHEN n > 1 THEN k/(n//2) ELSE 0 END AS ax FROM sp),
 u AS (SELECT *, sum(p*ax) OVER (PARTITION BY {BY})/tot AS cen FROM t)
 SELECT series_id, channel, {r('coalesce(sum(p/tot) FILTER (k < greatest(1, m//8)), 0)', 5, 'low')}, {r('coalesce(sum(p/tot) FILTER (k >= m//8 AND k < greatest(m//2, m//8+1)), 0)', 5, 'mid')},
 {r('coalesce(sum(p/tot) FILTER (k >= greatest(1, m//2)), 0)', 5, 'high')}, {r('any_value(cen)', 5, 'centroid')}, {r('sqrt(sum(p*(ax-cen)**2/tot))', 5, 'spread')} FROM u GROUP BY ALL""")
def band_profile_windows(t):
    out = _window_names(spectral.band_profile(_long(t, 96), by=spectral.WINDOWED).drop("peak"))
    return round_columns(out, ["low", "mid", "high", "centroid", "spread"], 5)


@query(LONG.format(n=512) + f""", c AS (SELECT series_id, channel, count(*) AS n FROM readings GROUP BY ALL), f AS (SELECT series_id, channel, unnest(range(0, (n-128)//64+1)) AS fr FROM c WHERE n >= 128),
 x AS (SELECT f.series_id, f.channel, fr, seq - fr*64 AS j, value*(0.5-0.5*cos(2*pi()*(seq - fr*64)/127)) AS x FROM f JOIN readings USING (series_id, channel) WHERE seq BETWEEN fr*64 AND fr*64+127),
 s AS (SELECT series_id, channel, fr, k, ln(1+sqrt(sum(x*cos(2*pi()*k*j/128))**2 + sum(x*sin(2*pi()*k*j/128))**2)) AS v FROM (SELECT *, unnest(range(0, 65)) AS k FROM x) GROUP BY ALL)
 SELECT series_id, channel, k::INTEGER AS bin, {r('avg(v)', 5, 'value')} FROM s GROUP BY series_id, channel, k UNION ALL SELECT series_id, channel, (k+65)::INTEGER, {r('stddev_pop(v)', 5)} FROM s GROUP BY series_id, channel, k""")
def stft_summary_windows(t):
    whole = _long(t, 512)
    enough = whole.groupBy(*spectral.WINDOWED).count().filter("count >= 128").drop("count")
    out = _window_names(spectral.stft_summary(whole.join(enough, spectral.WINDOWED), by=spectral.WINDOWED))
    return round_columns(out.select("series_id", "channel", F.posexplode("summary").alias("bin", "value")), ["value"], 5)


WHOLE = with_tables("cuts", body=", readings AS (SELECT tool_id AS series_id, 'force' AS channel, cut AS seq, force_n / 1000 AS value FROM cuts)")


def _whole(t):
    """The force of every cut of a tool as one long series."""
    return t.cuts.select(F.col("tool_id").alias("series_id"), F.lit("force").alias("channel"), F.col("cut").alias("seq"), (F.col("force_n") / 1000).alias("value"))


@query(WHOLE + HEADS + dft("x") + f""", t AS (SELECT *, sum(p) OVER (PARTITION BY {BY}) + 1e-12 AS tot FROM sp)
 SELECT series_id, channel, {r('any_value(tot)', 4, 'band_energy')}, {r('sum(k*50.0/n*p/tot)', 5, 'spectral_centroid')}, {r('arg_max(k*50.0/n, (p, -k))', 6, 'dominant_frequency')},
 {r('-sum(p/tot*ln(p/tot+1e-12))', 5, 'spectral_entropy')} FROM t GROUP BY ALL""")
def dft_features_long(t):
    out = fourier.spectrum_features(_whole(t), 50.0)
    out = round_columns(out, ["spectral_centroid", "spectral_entropy"], 5)
    return out.withColumns({"band_energy": rounded("band_energy", 4), "dominant_frequency": rounded("dominant_frequency")})


@query(WHOLE + f""", c AS (SELECT series_id, channel, count(*) AS n FROM readings GROUP BY ALL), f AS (SELECT series_id, channel, unnest(range(0, (n-128)//64+1)) AS fr FROM c WHERE n >= 128),
 x AS (SELECT f.series_id, f.channel, fr, seq - fr*64 AS j, value*(0.5-0.5*cos(2*pi()*(seq - fr*64)/127)) AS x FROM f JOIN readings USING (series_id, channel) WHERE seq BETWEEN fr*64 AND fr*64+127),
 s AS (SELECT series_id, channel, fr, k, ln(1+sqrt(sum(x*cos(2*pi()*k*j/128))**2 + sum(x*sin(2*pi()*k*j/128))**2)) AS v FROM (SELECT *, unnest(range(0, 65)) AS k FROM x) GROUP BY ALL)
 SELECT series_id, channel, k::INTEGER AS bin, count(*) AS frames, {r('avg(v)', 5, 'mean')}, {r('stddev_pop(v)', 5, 'deviation')} FROM s GROUP BY series_id, channel, k""")
def frame_moments_long(t):
    return round_columns(spectral.frame_moments(_whole(t), rows=256), ["mean", "deviation"], 5)


def _listed(df, column):
    return round_columns(df.select("series_id", "channel", F.posexplode(column).alias("pos", "value")), ["value"])


@query()
def frequency_view(t):
    return _listed(spectral.frequency_view(t.readings.drop("ts"), 12800.0), "frequency")


def _rpm(t):
    order = t.events.select("series_id", "channel").distinct().withColumn("position", F.col("channel"))
    return spectral.first_rpm(t.events.select("series_id", "channel", "value"), order)


ORDERS = dft("w", "n") + f""", rp AS (SELECT series_id, median(value)*60 AS rpm FROM readings WHERE channel = (SELECT min(channel) FROM readings q WHERE q.series_id = readings.series_id AND channel IN ('rpm','spindle_load')) GROUP BY series_id)"""


@query(with_tables("readings", body=HEADS + """, w AS (SELECT series_id, channel, j, n, x*(CASE WHEN n = 1 THEN 1 ELSE 0.5-0.5*cos(2*pi()*j/(n-1)) END) AS x FROM x)""" + ORDERS + f""",
 o AS (SELECT series_id, channel, unnest(range(1,9)) AS ord, any_value(rpm) AS rpm FROM sp LEFT JOIN rp USING (series_id) GROUP BY series_id, channel),
 a AS (SELECT o.series_id, o.channel, ord, any_value(rpm) AS rpm, arg_min(sqrt(p), (round(abs(k*2000.0/n - rpm/60*ord), 9), k)) AS amp FROM o JOIN sp USING (series_id, channel) GROUP BY ALL)
 SELECT series_id, channel, (ord-1)::INTEGER AS pos, CASE WHEN coalesce(any_value(rpm) OVER w, 0) <= 0 OR stddev_pop(amp) OVER w < 1e-6 THEN 0.0::DOUBLE ELSE {r('greatest(-10, least(10, (amp - avg(amp) OVER w) / stddev_pop(amp) OVER w))', 5)} END AS value
 FROM a WINDOW w AS (PARTITION BY series_id, channel)"""))
def order_features(t):
    rpm = _rpm(t).withColumn("rpm", F.col("rpm") * 60.0)
    out = spectral.order_features(t.readings.drop("ts"), rpm, 2000.0)
    return round_columns(out.select("series_id", "channel", F.posexplode("orders").alias("pos", "value")), ["value"], 5)


@query()
def frequency_view_window(t):
    return _listed(spectral.frequency_view(t.readings.drop("ts"), 12800.0, window=4096).drop("window"), "frequency")


@query()
def multirate_spectrum(t):
    return _listed(spectral.multirate_spectrum(t.readings.drop("ts"), _rpm(t), 2000.0), "spectral")


PROFILE_DIM = dimension_ctes("readings", "channel")
PROFILE_COLUMNS = ["channel_count", "external_sensor_ratio", "machine_controller_ratio", "vibration_ratio", "force_ratio", "torque_ratio", "current_ratio", "position_ratio",
                   "position_error_ratio", "mean_rms", "std_rms", "max_rms", "mean_peak", "mean_crest_factor", "mean_kurtosis", "mean_spectral_centroid", "mean_spectral_entropy",
                   "mean_high_band_ratio", "mean_mid_band_ratio", "mean_low_band_ratio", "mean_abs_corr"]
PROFILE = with_tables("readings", body=FREE + PROFILE_SPECTRUM + ALIGNED + PROFILE_DIM + """, ch AS (SELECT series_id, channel, sqrt(avg(value*value)) AS rms, max(abs(value)) AS peak, avg((value-mu)**4) AS m4, stddev_pop(value) AS sd FROM readings JOIN c USING (series_id, channel) GROUP BY ALL),
 ac AS (SELECT series_id, avg(abs(r)) AS mean_abs_corr FROM cr GROUP BY ALL), pf AS (SELECT ch.series_id, count(*)::DOUBLE AS channel_count, """ + ", ".join(
    [f"avg((source='{s}')::INT) AS {s}_ratio" for s in ("external_sensor", "machine_controller")]
    + [f"avg((quantity='{q}')::INT) AS {q}_ratio" for q in ("vibration", "force", "torque", "current", "position", "position_error")]
) + """, avg(rms) AS mean_rms, stddev_pop(rms) AS std_rms, max(rms) AS max_rms, avg(peak) AS mean_peak, avg(peak/(rms+1e-6)) AS mean_crest_factor, avg(m4/(sd+1e-6)**4) AS mean_kurtosis,
 """ + ", ".join(f"avg(CASE WHEN n >= 4 THEN {c} ELSE 0 END) AS {o}" for c, o in (("centroid", "mean_spectral_centroid"), ("entropy", "mean_spectral_entropy"), ("high", "mean_high_band_ratio"), ("mid", "mean_mid_band_ratio"), ("low", "mean_low_band_ratio"))) + """,
 coalesce(any_value(mean_abs_corr), 0) AS mean_abs_corr FROM ch JOIN ps USING (series_id, channel) JOIN dim ON raw_name = channel LEFT JOIN ac ON ac.series_id = ch.series_id GROUP BY ch.series_id)""")


def profile(t):
    """Profile vectors of all test series; shared with the clustering queries."""
    readings = t.readings.drop("ts")
    stats = features.time_features(t.events, flavor="plain")
    s4 = F.pow("std", F.lit(4))
    stats = stats.withColumn("m4", F.col("kurtosis") * (s4 + 1e-12))
    dim = canonicalize_channels(t.events, "channel").withColumnRenamed("raw_name", "channel")
    return features.signal_profile(stats, spectral.profile_spectrum(readings), features.channel_corr(readings), dim)


@query(PROFILE + f" SELECT series_id, {', '.join(r(c, 5, c) for c in PROFILE_COLUMNS)} FROM pf")
def signal_profile(t):
    return round_columns(profile(t), PROFILE_COLUMNS, 5)


@query(PROFILE + """, rq AS (SELECT series_id, list_sort(list_distinct(list(quantity))) AS q FROM ch JOIN dim ON raw_name = channel GROUP BY ALL)
 SELECT series_id, array_to_string(list_concat(list_transform(q, lambda x: 'latent_quantity_' || x), [""" + ", ".join(
    f"'{p}_' || CASE WHEN {c} < {a} THEN 'low' WHEN {c} < {b} THEN 'medium' WHEN {c} < {d} THEN 'high' ELSE 'very_high' END" for p, c, (a, b, d) in features.TOKEN_LEVELS
) + "]), ' ') AS tokens FROM pf JOIN rq USING (series_id)")
def latent_tokens(t):
    dim = canonicalize_channels(t.events, "channel").withColumnRenamed("raw_name", "channel")
    quantities = t.events.select("series_id", "channel").distinct().join(dim, "channel").select("series_id", "quantity")
    out = features.latent_tokens(profile(t), quantities)
    return out.withColumn("tokens", F.array_join("tokens", " "))


@query(with_tables("readings", body=""", ci AS (SELECT series_id, channel, row_number() OVER (PARTITION BY series_id ORDER BY channel) - 1 AS ci, count(*) OVER (PARTITION BY series_id) AS c FROM (SELECT DISTINCT series_id, channel FROM readings)),
 wt AS (SELECT series_id, channel AS src, w FROM ci, (SELECT unnest(range(0, 7)) AS w) WHERE ci = least(w, c-1)), l AS (SELECT series_id, channel AS src, list(value ORDER BY seq) AS v, count(*) AS n FROM readings GROUP BY ALL),
 g AS (SELECT series_id, w, v, n, unnest(range(0, 12)) AS j FROM wt JOIN l USING (series_id, src)), p AS (SELECT *, j*(n-1)/11 AS pos FROM g)
 SELECT series_id AS id, w::INTEGER AS channel, j AS pos, """ + r("v[floor(pos)::BIGINT+1]*(1-(pos-floor(pos))) + v[least(n-1, floor(pos)::BIGINT+1)+1]*(pos-floor(pos))", 6, "value") + " FROM p"))
def resize_series(t):
    from pyspark.sql import Window as W

    names = t.events.select("series_id", "channel").distinct()
    numbered = names.withColumn("channel_index", F.row_number().over(W.partitionBy("series_id").orderBy("channel")) - 1)
    rows = t.readings.join(numbered, ["series_id", "channel"]).select(F.col("series_id").alias("id"), "channel_index", "seq", "value")
    return round_columns(spectral.resize_series(rows, 7, 12), ["value"])
