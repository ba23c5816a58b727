"""Correlograms, noise correlations, lag correlations, permutation, bootstrap and shift tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from axonlake.functions import special
from axonlake.operators import corr, interval, relational as rel, resample as rs, series, stats
from axonlake.plans.registry import Book, Data
from axonlake.plans.statistics import _CNT, BY, deltas, response_counts, shifts, two_classes

book = Book()
S = 1_000_000
KEYS = ["session_id"]

_SPA = "sa AS (SELECT sp.*, row_number() OVER (PARTITION BY session_id, unit_id, t_us ORDER BY 1) AS s FROM sp)"
_LP = f"{_SPA}, lp AS (SELECT a.session_id, a.unit_id AS unit_a, b.unit_id AS unit_b, b.t_us - a.t_us AS dt FROM sa a JOIN sa b ON a.session_id = b.session_id AND b.t_us BETWEEN a.t_us AND a.t_us + 100000 AND NOT (a.unit_id = b.unit_id AND a.t_us = b.t_us AND a.s >= b.s))"
_CCG = f"{_LP}, h AS (SELECT session_id, unit_a, unit_b, dt // 10000 AS lag_bin, count(*) AS n FROM lp WHERE dt < 100000 GROUP BY 1, 2, 3, 4), ccg AS (SELECT session_id, unit_a, unit_b, lag_bin, CAST(sum(n) AS BIGINT) AS n FROM (SELECT * FROM h UNION ALL SELECT session_id, unit_b, unit_a, -lag_bin, n FROM h) GROUP BY 1, 2, 3, 4)"


def ccg(d: Data) -> DataFrame:
    return corr.correlogram(d.spikes(), KEYS, "unit_id", 100_000, 10_000)


@book("ccg_all", f"WITH {_CCG} SELECT * FROM ccg", "sp")
def _(d: Data) -> DataFrame:
    return ccg(d)


_EDGES = [0, 1000, 2000, 5000, 10000, 20000, 50000, 100000]


@book("ccg_log", f"WITH {_LP} SELECT session_id, unit_a, unit_b, " + " + ".join(f"CAST(dt >= {e} AS INT)" for e in _EDGES) + " - 1 AS log_bin, count(*) AS n FROM lp GROUP BY 1, 2, 3, 4", "sp")
def _(d: Data) -> DataFrame:
    n = corr.lag_counts(d.spikes(), KEYS, "unit_id", _EDGES, 100_000, "half")
    return n.select("session_id", "unit_a", "unit_b", F.col("lag_bin").cast("int").alias("log_bin"), "n")


@book("ccg_norm", f"WITH {_CCG}, k AS (SELECT session_id, unit_id, count(*) AS k FROM sa GROUP BY 1, 2), w AS (SELECT session_id, (max(t_us) - min(t_us)) / 1e6 AS span FROM sa GROUP BY 1) SELECT ccg.*, round(n / (a.k * 0.01), 5) AS hertz, round((n - a.k * b.k * 0.01 / span) / sqrt(a.k * b.k * 0.01 / span), 5) AS pearson FROM ccg JOIN k a ON a.session_id = ccg.session_id AND a.unit_id = unit_a JOIN k b ON b.session_id = ccg.session_id AND b.unit_id = unit_b JOIN w ON w.session_id = ccg.session_id", "sp")
def _(d: Data) -> DataFrame:
    c = corr.lag_counts(d.spikes(), KEYS, "unit_id", list(range(0, 100_000, 10_000)), 99_999, "both")
    return corr.normalise_ccg(c, 10_000).withColumns({c: F.round(c, 5) for c in ("hertz", "pearson")})


@book("ccg_centered", f"WITH {_LP} SELECT session_id, unit_a, unit_b, CAST(floor(0.5 + dt / 10000.0) AS BIGINT) AS lag_bin, count(*) AS n FROM lp GROUP BY 1, 2, 3, 4", "sp")
def _(d: Data) -> DataFrame:
    return corr.lag_counts(d.spikes(), KEYS, "unit_id", [0, *range(5_000, 100_000, 10_000)], 100_000, "half")


@book("ccg_props", f"WITH {_CCG} SELECT session_id, unit_a AS unit_id, round(coalesce(sum(n) FILTER (lag_bin = 0), 0) / nullif(avg(n) FILTER (lag_bin BETWEEN 1 AND 9), 0), 5) AS suppression, round(regr_slope(ln(n), lag_bin) FILTER (lag_bin BETWEEN 1 AND 9), 5) AS decay, arg_max(lag_bin, (n, -lag_bin)) FILTER (lag_bin > 0) AS peak_bin FROM ccg WHERE unit_a = unit_b GROUP BY 1, 2", "sp")
def _(d: Data) -> DataFrame:
    a = corr.autocorrelogram(d.spikes(), ["session_id", "unit_id"], 100_000, 10_000)
    in_ = F.col("lag_bin").between(1, 9)
    zero = F.coalesce(F.sum(F.when(F.col("lag_bin") == 0, F.col("n"))), F.lit(0))
    return a.groupBy("session_id", "unit_id").agg(
        F.round(F.try_divide(zero.cast("double"), F.avg(F.when(in_, F.col("n")))), 5).alias("suppression"), F.round(F.regr_slope(F.when(in_, F.ln("n")), F.when(in_, F.col("lag_bin"))), 5).alias("decay"), F.max_by(F.col("lag_bin"), F.when(F.col("lag_bin") > 0, F.struct("n", -F.col("lag_bin")))).alias("peak_bin"),
    )


_CCH = f"WITH {_CCG}, pr AS (SELECT DISTINCT session_id, unit_a, unit_b FROM ccg WHERE unit_a <> unit_b), bins AS (SELECT CAST(unnest(range(-9, 10)) AS BIGINT) AS lag_bin), cch AS (SELECT pr.*, bins.lag_bin, coalesce(ccg.n, 0) AS n FROM pr CROSS JOIN bins LEFT JOIN ccg ON ccg.session_id = pr.session_id AND ccg.unit_a = pr.unit_a AND ccg.unit_b = pr.unit_b AND ccg.lag_bin = bins.lag_bin) "


#: Correlograms at 1 ms: lag bins -100..100, an interaction in bins 2..10 beyond 7 deviations of the first and last 50 bins.
_CCG_MS = _CCG.replace("100000", "101000").replace("10000 ", "1000 ")
_CCH_MS = _CCH.replace(_CCG, _CCG_MS).replace("range(-9, 10)", "range(-100, 101)")
_HIT_MS = ", f AS (SELECT *, avg(n) FILTER (abs(lag_bin) >= 51) OVER w AS m, stddev_pop(n) FILTER (abs(lag_bin) >= 51) OVER w AS s FROM cch WINDOW w AS (PARTITION BY session_id, unit_a, unit_b)), k AS (SELECT *, row_number() OVER (PARTITION BY session_id, unit_a, unit_b ORDER BY lag_bin) AS i FROM f WHERE lag_bin BETWEEN 2 AND 10 AND s > 1e-9 AND abs(n - m) > 7 * s + 1e-9), hit AS (SELECT session_id, unit_a, unit_b, lag_bin, n AS peak, CASE WHEN n > m THEN 'excitatory' ELSE 'inhibitory' END AS kind FROM k WHERE i = 1) "
PAIR = ["session_id", "unit_a", "unit_b"]


def ccg_ms(d: Data, out: str) -> DataFrame:
    """``corr.lag_counts`` of different units at 1 ms."""
    return corr.lag_counts(d.spikes(), KEYS, "unit_id", list(range(0, 101_000, 1_000)), 100_999, out)


@book("cch_pair", _CCH_MS + "SELECT * FROM cch", "sp")
def _(d: Data) -> DataFrame:
    x = ccg_ms(d, "list").select(*PAIR, F.posexplode("counts").alias("_at", "n"))
    return x.select(*PAIR, (F.col("_at").cast("long") - 100).alias("lag_bin"), "n")


def hits(d: Data) -> DataFrame:
    return ccg_ms(d, "found").where("lag_bin is not null")


@book("cch_interactions", _CCH_MS + _HIT_MS + "SELECT * FROM hit", "sp")
def _(d: Data) -> DataFrame:
    return hits(d)


@book("cch_jitter")
def _(d: Data) -> DataFrame:
    """Mean correlogram over 50 surrogates whose spikes are dithered by up to 10 ms, in bins of 1 ms."""
    return corr.dithered(d.spikes(), "session_id", "unit_id", "mean")


@book("cch_pipeline")
def _(d: Data) -> DataFrame:
    """Interactions of all pairs, both orders, in the correlogram less its surrogates' mean."""
    return corr.dithered(d.spikes(), "session_id", "unit_id", "found")


# ---- noise correlations

_RES = _CNT + ", n AS (SELECT session_id, unit_id, analysis, event_id, lick_flag, post, post - avg(post) OVER (PARTITION BY session_id, unit_id, analysis, lick_flag) AS res FROM c) "


def residual_counts(d: Data) -> DataFrame:
    return corr.residuals(response_counts(d), ["session_id", "unit_id", "analysis", "lick_flag"], "post")


@book("nc_residual", _RES + "SELECT session_id, unit_id, event_id, round(res, 6) + 0.0 AS residual FROM n", "us sp tr")
def _(d: Data) -> DataFrame:
    return residual_counts(d).select("session_id", "unit_id", "event_id", (F.round("residual", 6) + 0.0).alias("residual"))


_NC = ", p AS (SELECT a.session_id, a.unit_id AS unit_a, b.unit_id AS unit_b, count(*) AS n, CASE WHEN stddev_pop(a.{v}) > 1e-9 AND stddev_pop(b.{v}) > 1e-9 THEN corr(a.{v}, b.{v}) END AS r FROM n a JOIN n b ON a.session_id = b.session_id AND a.event_id = b.event_id AND a.unit_id < b.unit_id GROUP BY 1, 2, 3) "


def noise_pairs(d: Data) -> DataFrame:
    return corr.pair_correlations(residual_counts(d), KEYS, "unit_id", "event_id", "residual")


@book("nc_pairs", _RES + _NC.format(v="res") + "SELECT session_id, unit_a, unit_b, n, round(r, 5) + 0.0 AS r FROM p", "us sp tr")
@book("cmp_noise_corr", _RES + _NC.format(v="res") + "SELECT session_id, unit_a, unit_b, n, round(r, 5) + 0.0 AS r FROM p", "us sp tr")
def _(d: Data) -> DataFrame:
    return noise_pairs(d).withColumn("r", F.round("r", 5) + 0.0)


@book("nc_matrix", _RES + _NC.format(v="post") + ", q AS (SELECT session_id, unit_a, unit_b, round(r, 5) + 0.0 AS r FROM p) SELECT * FROM q UNION ALL SELECT session_id, unit_b, unit_a, r FROM q", "us sp tr")
def _(d: Data) -> DataFrame:
    p = corr.pair_correlations(response_counts(d), KEYS, "unit_id", "event_id", "post").select("session_id", "unit_a", "unit_b", (F.round("r", 5) + 0.0).alias("r"))
    return rel.mirror(p, "unit_a", "unit_b")


_MNC = _RES + _NC.format(v="res") + ", ar AS (SELECT DISTINCT session_id, unit_id, mouse_id, ccf_parent_acronym AS area FROM units) SELECT a.mouse_id, CASE WHEN a.area = b.area THEN 'within' ELSE 'across' END AS kind, count(r) AS n, round(avg(r), 5) AS r FROM p JOIN ar a ON a.session_id = p.session_id AND a.unit_id = unit_a JOIN ar b ON b.session_id = p.session_id AND b.unit_id = unit_b WHERE a.area IS NOT NULL AND b.area IS NOT NULL GROUP BY 1, 2"


@book("agg_mouse_nc", _MNC, "us sp tr")
@book("cmp_noise_corr_session", _MNC, "us sp tr")
def _(d: Data) -> DataFrame:
    u = d.unit_rows("mouse_id", "ccf_parent_acronym")
    a = u.select("session_id", F.col("unit_id").alias("unit_a"), "mouse_id", F.col("ccf_parent_acronym").alias("area_a"))
    b = u.select("session_id", F.col("unit_id").alias("unit_b"), F.col("ccf_parent_acronym").alias("area_b"))
    p = noise_pairs(d).join(a, ["session_id", "unit_a"]).join(b, ["session_id", "unit_b"]).where("area_a is not null and area_b is not null")
    return p.groupBy("mouse_id", F.when(F.col("area_a") == F.col("area_b"), "within").otherwise("across").alias("kind")).agg(F.count("r").alias("n"), F.round(F.avg("r"), 5).alias("r"))


@book("nc_timecourse", """WITH k AS (SELECT unnest(range(0, 6)) AS w), n AS (SELECT us.session_id, us.unit_id, tr.event_id, k.w, count(sp.t_us) AS n FROM us JOIN tr USING (session_id) CROSS JOIN k LEFT JOIN sp ON sp.session_id = us.session_id AND sp.unit_id = us.unit_id AND sp.t_us >= tr.at_us - 1000000 + k.w * 500000 AND sp.t_us < tr.at_us - 1000000 + k.w * 500000 + 1000000 GROUP BY 1, 2, 3, 4)
SELECT session_id, w, count(*) AS n, round(avg(n), 6) AS mean FROM n GROUP BY 1, 2""", "us sp tr")
def _(d: Data) -> DataFrame:
    """Sliding windows: a spike counts in the two windows of one second (step half a second) that hold it."""
    t = d.trial_rows().select("session_id", "event_id", "at_us")
    r = interval.raster(d.spikes(), t, KEYS, -S, 5 * S // 2, "left")
    first = F.floor(F.col("t_rel_us") / F.lit(S // 2)) + 2
    h = r.withColumn("w", F.explode(F.sequence(F.greatest(first - 1, F.lit(0)), F.least(first, F.lit(5))))).groupBy("session_id", "w").agg(F.count("*").alias("c"))
    n = d.unit_rows().groupBy("session_id").agg(F.count("*").alias("u")).join(t.groupBy("session_id").agg(F.count("*").alias("e")), "session_id").withColumn("w", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))))
    return n.join(h, ["session_id", "w"], "left").select("session_id", "w", (F.col("u") * F.col("e")).alias("n"), F.round(F.coalesce("c", F.lit(0)) / (F.col("u") * F.col("e")), 6).alias("mean"))


# ---- lag correlations of trial series

_SER = _CNT + ", z AS (SELECT session_id, unit_id, event_id, (post - avg(post) OVER g) / nullif(stddev_pop(post) OVER g, 0) AS zx, (lick_flag - avg(lick_flag) OVER g) / nullif(stddev_pop(lick_flag) OVER g, 0) AS zy, count(*) OVER g AS n, row_number() OVER (PARTITION BY session_id, unit_id ORDER BY event_id) AS i FROM c WINDOW g AS (PARTITION BY session_id, unit_id)), lags AS (SELECT unnest(range({a}, 11)) AS lag), xl AS (SELECT y.session_id, y.unit_id, lags.lag, sum(coalesce(x.zx, 0) * y.{y}) / max(y.n) AS r FROM z y CROSS JOIN lags LEFT JOIN z x ON x.session_id = y.session_id AND x.unit_id = y.unit_id AND x.i = y.i + lags.lag GROUP BY 1, 2, 3) "


@book("xcorr_lags", _SER.format(a=-10, y="zy") + "SELECT session_id, unit_id, CAST(lag AS INT) AS lag, round(r, 5) + 0.0 AS r FROM xl", "us sp tr")
def _(d: Data) -> DataFrame:
    return trial_lags(d).withColumn("r", F.round("r", 5) + 0.0)


def trial_lags(d: Data) -> DataFrame:
    return corr.lag_correlation(response_counts(d), ["session_id", "unit_id"], "event_id", "post", "lick_flag", 10)


_AC = _CNT + ", z AS (SELECT session_id, unit_id, post, row_number() OVER (PARTITION BY session_id, unit_id ORDER BY event_id) AS i FROM c), g AS (SELECT session_id, unit_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(post) AS BIGINT) AS s, CAST(sum(post * post) AS BIGINT) AS q FROM z GROUP BY 1, 2), lags AS (SELECT unnest(range(0, 11)) AS lag), k AS (SELECT g.session_id, g.unit_id, lag, n, s, q, CAST(coalesce(sum((n * x.post - s) * (n * y.post - s)), 0) AS BIGINT) AS top FROM g CROSS JOIN lags LEFT JOIN z y ON y.session_id = g.session_id AND y.unit_id = g.unit_id AND y.i + lag <= g.n LEFT JOIN z x ON x.session_id = y.session_id AND x.unit_id = y.unit_id AND x.i = y.i + lag GROUP BY ALL) "


@book("acorr_lags", _AC + "SELECT session_id, unit_id, CAST(lag AS INT) AS lag, CAST(top AS DOUBLE) / CAST(nullif(n * (n * q - s * s), 0) AS DOUBLE) AS r FROM k", "us sp tr")
def _(d: Data) -> DataFrame:
    return corr.autocorrelation(response_counts(d), ["session_id", "unit_id"], "event_id", "post", 10)


@book("agg_ccg_lag_mean", _SER.format(a=-10, y="zy") + "SELECT CAST(lag AS INT) AS lag, count(r) AS n, round(avg(r), 6) + 0.0 AS mean, round(stddev_samp(r) / sqrt(count(r)), 6) AS sem FROM xl GROUP BY 1", "us sp tr")
def _(d: Data) -> DataFrame:
    return trial_lags(d).groupBy("lag").agg(F.count("r").alias("n"), (F.round(F.avg("r"), 6) + 0.0).alias("mean"), F.round(F.stddev_samp("r") / F.sqrt(F.count("r")), 6).alias("sem"))


@book("agg_peak_lag", _SER.format(a=-10, y="zy") + ", q AS (SELECT session_id, unit_id, lag, round(r, 5) + 0.0 AS r FROM xl WHERE r IS NOT NULL) SELECT session_id, unit_id, CAST(arg_max(lag, (abs(r), -lag)) AS INT) AS lag, max(abs(r)) AS peak FROM q GROUP BY 1, 2", "us sp tr")
def _(d: Data) -> DataFrame:
    q = trial_lags(d).withColumn("r", F.round("r", 5) + 0.0).where("r is not null")
    return q.groupBy("session_id", "unit_id").agg(F.max_by("lag", F.struct(F.abs("r"), -F.col("lag"))).alias("lag"), F.max(F.abs("r")).alias("peak"))


_SX = _CNT + f""", e AS (SELECT session_id, event_id, any_value(lick_flag) AS y, row_number() OVER (PARTITION BY session_id ORDER BY event_id) AS i FROM c GROUP BY 1, 2),
m AS (SELECT session_id, count(*) AS n, avg(y) AS m, stddev_pop(y) AS s FROM e GROUP BY 1),
zy AS (SELECT session_id, event_id, i, n, (y - m) / s AS zy FROM e JOIN m USING (session_id) WHERE s > 1e-9 AND n >= 2),
dl AS (SELECT zy.session_id, r.rep, row_number() OVER (PARTITION BY zy.session_id, r.rep ORDER BY {rs.draw_sql('event_id', 'r.rep')}, event_id) AS i, event_id FROM zy, (SELECT unnest(range(1, 1001)) AS rep) r),
py AS (SELECT dl.session_id, dl.rep, list(o.zy ORDER BY t.i) AS ys FROM dl JOIN zy o ON o.session_id = dl.session_id AND o.i = dl.i JOIN zy t ON t.session_id = dl.session_id AND t.event_id = dl.event_id GROUP BY 1, 2
       UNION ALL SELECT session_id, 0, list(zy ORDER BY i) FROM zy GROUP BY 1),
zx AS (SELECT session_id, unit_id, list((post - m) / s ORDER BY event_id) AS xs FROM (SELECT session_id, unit_id, event_id, post, avg(post) OVER g AS m, stddev_pop(post) OVER g AS s FROM c WINDOW g AS (PARTITION BY session_id, unit_id)) WHERE s > 1e-9 GROUP BY 1, 2),
lx AS (SELECT session_id, unit_id, lag, list_transform(range(1, len(xs) + 1), lambda i: CASE WHEN i + lag BETWEEN 1 AND len(xs) THEN xs[i + lag] ELSE 0.0 END) AS xs FROM zx, (SELECT unnest(range(-10, 11)) AS lag)),
g AS (SELECT lx.session_id, unit_id, lag, rep, list_inner_product(xs, ys) / len(xs) AS r FROM lx JOIN py ON py.session_id = lx.session_id),
o AS (SELECT session_id, unit_id, lag, r AS o FROM g WHERE rep = 0),
p AS (SELECT g.session_id, g.unit_id, g.lag, any_value(o) AS o, count(*) AS n_rep, count(*) FILTER (r >= o - 1e-9) / count(*) AS p_pos, count(*) FILTER (r <= o + 1e-9) / count(*) AS p_neg FROM g JOIN o ON o.session_id = g.session_id AND o.unit_id = g.unit_id AND o.lag = g.lag WHERE rep > 0 GROUP BY 1, 2, 3)
SELECT session_id, unit_id, CAST(lag AS INT) AS lag, round(o, 5) + 0.0 AS r, n_rep, round(p_pos, 6) AS p_pos, round(p_neg, 6) AS p_neg, round(CASE WHEN p_pos >= 0.025 AND p_neg < 0.025 THEN p_neg ELSE p_pos END, 6) AS p, least(p_pos, p_neg) < 0.025 AS significant FROM p"""


def shuffled_lags(d: Data) -> DataFrame:
    """Lags -10..10 of every unit's counts and the lick series against 1,000 shuffles of the latter."""
    s = series.lag_shuffles(response_counts(d), ["session_id", "unit_id"], "event_id", "post", "lick_flag", 10, 1000)
    return s.withColumn("r", F.round("r", 5) + 0.0).withColumns({c: F.round(c, 6) for c in ("p_pos", "p_neg", "p")})


@book("res_shuffle_xcorr", _SX, "us sp tr")
def _(d: Data) -> DataFrame:
    return shuffled_lags(d)


@book("cmp_xcorr_trial")
def _(d: Data) -> DataFrame:
    """Lag correlations of every unit with their shuffle p, corrected over the unit's lags (Benjamini-Yekutieli)."""
    return stats.fdr(shuffled_lags(d), ["session_id", "unit_id"], "p", "by")


# ---- resampling: the draws are whole-number arithmetic, so SQL can repeat them


def _labels_sql(entities: str, n: int) -> str:
    """CTEs e and lab: permuted labels of ``entities`` (mouse, reward_group), as ``permuted_labels`` deals them."""
    return (
        f"e AS (SELECT mouse, reward_group, row_number() OVER (ORDER BY mouse) AS i FROM ({entities})), "
        f"dealt AS (SELECT e.mouse, r.rep, row_number() OVER (PARTITION BY r.rep ORDER BY {rs.draw_sql('e.mouse', 'r.rep')}, e.mouse) AS i FROM e, (SELECT unnest(range(1, {n + 1})) AS rep) r), "
        "lab AS (SELECT mouse, 0 AS rep, reward_group FROM e UNION ALL SELECT dealt.mouse, dealt.rep, e.reward_group FROM dealt JOIN e ON e.i = dealt.i)"
    )


def _perm_p_sql(by: str, value: str, table: str, far: str = "abs({v}) >= abs(o) - 1e-12") -> str:
    """CTE o and the final select of a permutation test on ``table`` (by, rep, value)."""
    return (
        f", o AS (SELECT *, max(CASE WHEN rep = 0 THEN {value} END) OVER (PARTITION BY {by}) AS o FROM {table} WHERE {value} IS NOT NULL) "
        f"SELECT {by}, round(max(o), 6) + 0.0 AS observed, count(*) AS n_rep, round((count(*) FILTER ({far.format(v=value)}) + 1) / (count(*) + 1.0), 6) AS p FROM o WHERE rep > 0 AND o IS NOT NULL GROUP BY {by}"
    )


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("observed", F.round("observed", 6) + 0.0).withColumn("p", F.round("p", 6))


_GROUPS = "grp AS (SELECT mouse_id, min(reward_group) AS reward_group, row_number() OVER (ORDER BY mouse_id) AS mouse FROM units WHERE mouse_id IS NOT NULL GROUP BY 1)"
_MV = _GROUPS + ", dp AS (SELECT mouse_id, area_acronym_custom AS area, 100.0 * avg(CAST(significant AS INT)) FILTER (analysis_type = 'whisker_passive_pre') AS pre, 100.0 * avg(CAST(significant AS INT)) FILTER (analysis_type = 'whisker_passive_post') AS post FROM roc WHERE mouse_id IS NOT NULL AND area_acronym_custom IS NOT NULL GROUP BY 1, 2), mv AS (SELECT mouse, reward_group, area, post - pre AS delta FROM dp JOIN grp USING (mouse_id) WHERE pre IS NOT NULL AND post IS NOT NULL)"
_PM = "WITH " + _MV + ", " + _labels_sql("SELECT DISTINCT mouse, reward_group FROM mv", 9999)
_DIFF = ", g AS (SELECT area, rep, avg(delta) FILTER (lab.reward_group = 1) - avg(delta) FILTER (lab.reward_group = 0) AS diff FROM mv JOIN lab USING (mouse) GROUP BY 1, 2)"
_MA = _GROUPS + ", ma AS (SELECT any_value(grp.mouse) AS mouse, any_value(reward_group) AS reward_group, area_acronym_custom AS area, count(*) FILTER (significant) AS k, count(*) AS n FROM roc JOIN grp ON grp.mouse_id = roc.mouse_id WHERE area_acronym_custom IS NOT NULL GROUP BY roc.mouse_id, area_acronym_custom)"


def _draws_sql(entities: str, n: int, by: str, key: str) -> str:
    """CTE bd: how often each entity is drawn, as ``bootstrap_draws`` counts it."""
    return (
        f"en AS (SELECT {by}, {key}, row_number() OVER (PARTITION BY {by} ORDER BY {key}) - 1 AS i, count(*) OVER (PARTITION BY {by}) AS m FROM ({entities})), "
        f"dr AS (SELECT en.{by}, r.rep, {rs.draw_sql('(en.i + 1)', 'r.rep')} * en.m // {rs.P} AS i FROM en, (SELECT unnest(range(1, {n + 1})) AS rep) r), "
        f"bd AS (SELECT en.{by}, en.{key}, dr.rep, count(*) AS times FROM dr JOIN en ON en.{by} = dr.{by} AND en.i = dr.i GROUP BY 1, 2, 3)"
    )




_PL = _CNT + f""", i AS (SELECT *, row_number() OVER (PARTITION BY session_id, unit_id, analysis ORDER BY cls, v) AS i, rank() OVER (PARTITION BY session_id, unit_id, analysis ORDER BY v) + (count(*) OVER (PARTITION BY session_id, unit_id, analysis, v) - 1) / 2.0 AS rk FROM x),
b AS (SELECT session_id, unit_id, analysis, list(CAST(rk AS DOUBLE) ORDER BY i) AS rks, CAST(sum(cls) AS BIGINT) AS n1, count(*) AS n FROM i GROUP BY 1, 2, 3),
w AS (SELECT session_id, unit_id, analysis, rks, n1, n, rep, CASE WHEN rep = 0 THEN list_sum(rks[n - n1 + 1:]) ELSE list_sum(list_transform(list_sort(list_transform(range(1, n + 1), lambda i: {rs.draw_sql('i', '(rep + unit_id)')} * (n + 1) + i))[:n1], lambda k: rks[k % (n + 1)])) END AS total FROM b, (SELECT unnest(range(0, 1001)) AS rep)),
g AS (SELECT session_id, unit_id, analysis, rep, 2 * (total - n1 * (n1 + 1) / 2.0) / (n1 * (n - n1)) - 1 AS s FROM w WHERE n1 > 0 AND n1 < n),
o AS (SELECT *, max(CASE WHEN rep = 0 THEN s END) OVER (PARTITION BY session_id, unit_id, analysis) AS o FROM g),
pv AS (SELECT session_id, unit_id, analysis, round(max(o), 6) + 0.0 AS observed, count(*) AS n_rep, round(count(*) FILTER (abs(s) >= abs(o) - 1e-12) / count(*), 6) AS p FROM o WHERE rep > 0 GROUP BY 1, 2, 3)
SELECT *, p < 0.05 AS significant, CASE WHEN p < 0.05 THEN CASE WHEN observed > 0 THEN 'positive' ELSE 'negative' END END AS direction FROM pv"""


@book("res_perm_label", _PL, "us sp tr")
@book("agg_roc_unit", _PL, "us sp tr")
def _(d: Data) -> DataFrame:
    """AUC of every unit and analysis against 1,000 permutations of the two classes: p, significance and direction."""
    return _rounded(series.label_permutations(two_classes(response_counts(d)), BY, "v", "cls", "unit_id", 1000))


def mice(d: Data) -> DataFrame:
    """mouse_id, reward_group, mouse: a running number of the mice, one row each."""
    g = d.units.where("mouse_id is not null").groupBy("mouse_id").agg(F.min("reward_group").alias("reward_group"))
    return g.withColumn("mouse", F.row_number().over(W.orderBy("mouse_id")).cast("long"))


def mouse_values(d: Data) -> DataFrame:
    """mouse number, reward group, area, delta: one row per mouse and area."""
    x = deltas(d).join(mice(d), "mouse_id")
    return x.select("mouse", "reward_group", "area", (F.col("post") - F.col("pre")).alias("delta"))


def group_difference(x: DataFrame, by: list[str]) -> DataFrame:
    """Mean of group 1 minus mean of group 0 per ``by``; null if a group is empty."""
    m = lambda k: F.avg(F.when(F.col("reward_group") == k, F.col("delta")))
    return x.groupBy(*by).agg((m(1) - m(0)).alias("diff"))


def perm_mouse(d: Data, n: int = 9999) -> DataFrame:
    v = mouse_values(d)
    labels = rs.permuted_labels(v.select("mouse", "reward_group").distinct(), [], "mouse", "reward_group", n)
    return v.drop("reward_group").join(labels, "mouse")


@book("res_perm_mouse", _PM + _DIFF + _perm_p_sql("area", "diff", "g"), "roc")
@book("res_hier_pipeline", _PM + _DIFF + _perm_p_sql("area", "diff", "g"), "roc")
def _(d: Data) -> DataFrame:
    return _rounded(rs.permutation_p(group_difference(perm_mouse(d), ["area", "rep"]), ["area"], "diff"))


@book("res_perm_omnibus")
def _(d: Data) -> DataFrame:
    """The largest absolute area difference against its permutations, and each area's own with false-discovery control."""
    g = group_difference(perm_mouse(d), ["area", "rep"])
    per = stats.fdr(rs.permutation_p(g, ["area"], "diff"), [], "p").select("area", "observed", "n_rep", "p", "p_adj")
    top = rs.permutation_p(g.groupBy("rep").agg(F.max(F.abs("diff")).alias("diff")).withColumn("area", F.lit("(omnibus)")), ["area"], "diff", "greater")
    return per.unionByName(top.withColumn("p_adj", F.col("p")))


_CROSS = "WITH " + _GROUPS + ", f AS (SELECT mouse_id, area_acronym_custom AS area, avg(CAST(significant AS INT)) FILTER (analysis_type = 'whisker_active') AS w, avg(CAST(significant AS INT)) FILTER (analysis_type = 'auditory_active') AS a FROM roc WHERE mouse_id IS NOT NULL GROUP BY 1, 2), mv AS (SELECT mouse, reward_group, area, w - a AS delta FROM f JOIN grp USING (mouse_id) WHERE w IS NOT NULL AND a IS NOT NULL AND area IS NOT NULL), " + _labels_sql("SELECT DISTINCT mouse, reward_group FROM mv", 2000)


@book("res_perm_cross", _CROSS + _DIFF + _perm_p_sql("area", "diff", "g"), "roc")
def _(d: Data) -> DataFrame:
    """Difference in differences: the group effect on whisker minus that on auditory fractions."""
    r = d.roc().where("mouse_id is not null").groupBy("mouse_id", F.col("area_acronym_custom").alias("area")).agg(*[F.avg(F.when(F.col("analysis_type") == k, F.col("significant").cast("int"))).alias(k) for k in ("whisker_active", "auditory_active")]).dropna()
    v = r.join(mice(d), "mouse_id").select("mouse", "reward_group", "area", (F.col("whisker_active") - F.col("auditory_active")).alias("delta"))
    labels = rs.permuted_labels(v.select("mouse", "reward_group").distinct(), [], "mouse", "reward_group", 2000)
    return _rounded(rs.permutation_p(group_difference(v.drop("reward_group").join(labels, "mouse"), ["area", "rep"]), ["area"], "diff"))


def _mouse_area(d: Data) -> DataFrame:
    r = d.roc().where("mouse_id is not null and area_acronym_custom is not null").groupBy("mouse_id", F.col("area_acronym_custom").alias("area")).agg(F.count_if("significant").alias("k"), F.count("*").alias("n"))
    return r.join(mice(d), "mouse_id")


def _focality_of(x: DataFrame, by: list[str], times: str | None = None) -> DataFrame:
    w = F.col(times) if times else F.lit(1)
    p = x.groupBy(*by, "area").agg((F.sum(F.col("k") * w) / F.sum(F.col("n") * w)).alias("p"))
    return stats.focality(p, by, "p")


_FOC = "WITH " + _MA + ", " + _labels_sql("SELECT DISTINCT mouse, reward_group FROM ma", 10000) + ", sh AS (SELECT rep, lab.reward_group, area, sum(k) / sum(n) AS p FROM ma JOIN lab USING (mouse) GROUP BY 1, 2, 3), fo AS (SELECT rep, reward_group, sum(p * p) / nullif(sum(p) * sum(p), 0) AS f FROM sh GROUP BY 1, 2), g AS (SELECT 'focality' AS what, rep, max(f) FILTER (reward_group = 1) - max(f) FILTER (reward_group = 0) AS diff FROM fo GROUP BY 2)"


@book("res_perm_focality", _FOC + _perm_p_sql("what", "diff", "g"), "roc")
def _(d: Data) -> DataFrame:
    v = _mouse_area(d)
    labels = rs.permuted_labels(v.select("mouse", "reward_group").distinct(), [], "mouse", "reward_group", 10000)
    f = _focality_of(v.drop("reward_group").join(labels, "mouse"), ["rep", "reward_group"])
    m = lambda k: F.max(F.when(F.col("reward_group") == k, F.col("focality")))
    diff = f.groupBy("rep").agg((m(1) - m(0)).alias("diff")).withColumn("what", F.lit("focality"))
    return _rounded(rs.permutation_p(diff, ["what"], "diff"))


def _boot(d: Data, n: int, keep_times: bool) -> DataFrame:
    v = _mouse_area(d)
    b = rs.bootstrap_draws(v, ["reward_group"], "mouse", n)
    if not keep_times:
        b = b.withColumn("times", F.lit(1))
    f = _focality_of(v.join(b, ["reward_group", "mouse"]), ["reward_group", "rep"], "times")
    ci = f.groupBy("reward_group").agg(F.percentile("focality", F.array(F.lit(0.025), F.lit(0.975))).alias("c"), F.count("focality").alias("n_rep"))
    return _focality_of(v, ["reward_group"]).join(ci, "reward_group").select("reward_group", F.round("focality", 6).alias("focality"), F.round(F.element_at("c", 1), 6).alias("low"), F.round(F.element_at("c", 2), 6).alias("high"), "n_rep")


def _boot_sql(n: int, t: str) -> str:
    return ("WITH " + _MA + ", " + _draws_sql("SELECT DISTINCT reward_group, mouse FROM ma", n, "reward_group", "mouse") + _BM).replace("{t}", t)


_BM = ", sh AS (SELECT reward_group, rep, area, sum(k * {t}) / sum(n * {t}) AS p FROM ma JOIN bd USING (reward_group, mouse) GROUP BY 1, 2, 3), fo AS (SELECT reward_group, rep, sum(p * p) / nullif(sum(p) * sum(p), 0) AS f FROM sh GROUP BY 1, 2), own AS (SELECT reward_group, area, sum(k) / sum(n) AS p FROM ma GROUP BY 1, 2), ow AS (SELECT reward_group, sum(p * p) / nullif(sum(p) * sum(p), 0) AS focality FROM own GROUP BY 1) SELECT reward_group, round(any_value(focality), 6) AS focality, round(quantile_cont(f, 0.025), 6) AS low, round(quantile_cont(f, 0.975), 6) AS high, count(f) AS n_rep FROM fo JOIN ow USING (reward_group) GROUP BY 1"


@book("res_boot_mouse", _boot_sql(10_000, "times"), "roc")
def _(d: Data) -> DataFrame:
    return _boot(d, 10_000, True)


@book("res_boot_mouse_set", _boot_sql(5_000, "1"), "roc")
def _(d: Data) -> DataFrame:
    return _boot(d, 5_000, False)


def neuron_rows(d: Data) -> DataFrame:
    r = d.roc().where("mouse_id is not null and area_acronym_custom is not null and neuron_id is not null and analysis_type = 'whisker_active'")
    r = r.groupBy("mouse_id", "session_id", "neuron_id").agg(F.min("area_acronym_custom").alias("area"), F.bool_or("significant").cast("int").alias("k")).withColumn("n", F.lit(1))
    return r.join(mice(d), "mouse_id")


def _interval(b: DataFrame) -> DataFrame:
    return b.select("reward_group", *[F.round(c, 6).alias(c) for c in ("focality", "low", "high")], "n_rep")


@book("res_boot_hier")
def _(d: Data) -> DataFrame:
    """Mice drawn with replacement, then neurons within each drawn mouse: percentile interval of the focality."""
    return _interval(series.focality_bootstrap(neuron_rows(d), "reward_group", "mouse", 10_000))


@book("res_boot_pct")
def _(d: Data) -> DataFrame:
    """Neurons drawn with replacement within a group: percentile interval of the focality."""
    return _interval(series.focality_bootstrap(neuron_rows(d), "reward_group", None, 10_000))


@book("res_boot_bca")
def _(d: Data) -> DataFrame:
    """Bias-corrected accelerated interval of the mean shift per group: bias from the draws below the estimate, acceleration from
    leave-one-out means."""
    from axonlake.functions.special import norm_cdf, norm_ppf

    v = mouse_values(d).select("area", "mouse", "delta")
    b = rs.bootstrap_draws(v, ["area"], "mouse", 10_000).join(v, ["area", "mouse"]).groupBy("area", "rep").agg((F.sum(F.col("delta") * F.col("times")) / F.sum("times")).alias("m"))
    w = W.partitionBy("area")
    jack = v.withColumn("n", F.count("*").over(w)).where("n > 2").withColumn("j", (F.sum("delta").over(w) - F.col("delta")) / (F.col("n") - 1)).withColumn("d", F.avg("j").over(w) - F.col("j"))
    acc = jack.groupBy("area").agg(F.coalesce(F.try_divide(F.sum(F.pow("d", 3)), 6 * F.nullif(F.pow(F.sum(F.col("d") * F.col("d")), 1.5), F.lit(0.0))), F.lit(0.0)).alias("a"))
    est = v.groupBy("area").agg(F.avg("delta").alias("mean"))
    z0 = b.join(est, "area").groupBy("area", "mean").agg(((F.count_if(F.col("m") < F.col("mean")) + 0.5) / (F.count("*") + 1)).alias("below"), F.array_sort(F.collect_list("m")).alias("ms"))
    x = z0.join(acc, "area").withColumn("z0", norm_ppf(F.col("below")))
    x = x.withColumn("s", F.explode(F.array(*[F.struct(F.lit(n).alias("end"), F.lit(q).alias("z")) for n, q in (("low", -1.959964), ("high", 1.959964))]))).withColumn("zz", F.col("z0") + F.col("s.z"))
    x = x.withColumn("q", norm_cdf(F.col("z0") + F.col("zz") / (1 - F.col("a") * F.col("zz"))))
    at = F.element_at("ms", (F.greatest(F.least(F.floor(F.col("q") * F.size("ms")), F.size("ms") - 1), F.lit(0)) + 1).cast("int"))
    return x.groupBy("area", "mean").agg(F.max(F.when(F.col("s.end") == "low", at)).alias("low"), F.max(F.when(F.col("s.end") == "high", at)).alias("high"))


@book("smp_with_repl", "WITH " + _MV + ", " + _draws_sql("SELECT DISTINCT reward_group, mouse FROM mv", 50, "reward_group", "mouse") + " SELECT reward_group, mouse, CAST(rep AS INT) AS rep, times FROM bd", "roc")
def _(d: Data) -> DataFrame:
    return rs.bootstrap_draws(mouse_values(d), ["reward_group"], "mouse", 50)


_BME = "WITH " + _MV + ", " + _draws_sql("SELECT DISTINCT area, mouse FROM mv", 2000, "area", "mouse") + ", m AS (SELECT area, rep, sum(delta * times) / sum(times) AS m FROM mv JOIN bd USING (area, mouse) GROUP BY 1, 2), ow AS (SELECT area, avg(delta) AS mean FROM mv GROUP BY 1) SELECT area, round(any_value(mean), 5) + 0.0 AS mean, round(quantile_cont(m, 0.025), 5) + 0.0 AS low, round(quantile_cont(m, 0.975), 5) + 0.0 AS high FROM m JOIN ow USING (area) GROUP BY 1"


@book("res_boot_mean", _BME, "roc")
def _(d: Data) -> DataFrame:
    b = rs.bootstrap_mean(mouse_values(d), ["area"], "mouse", "delta", 2000)
    return b.select("area", *[(F.round(c, 5) + 0.0).alias(c) for c in ("mean", "low", "high")])


@book("res_region_all")
def _(d: Data) -> DataFrame:
    """Every analysis, reward group and area: share of significant neurons, interval over mice, test against mice drawn from all areas
    and false-discovery control per analysis and group."""
    r = d.roc().where("mouse_id is not null and analysis_type is not null").groupBy("mouse_id", "analysis_type", F.col("area_acronym_custom").alias("area"))
    k = r.agg(F.count_if("significant").alias("k"), F.count("significant").alias("known"), F.count("*").alias("n"))
    cells = k.join(mice(d).where("reward_group is not null"), "mouse_id").select("analysis_type", "reward_group", "area", "mouse", "k", "known", "n")
    return series.region_encoding(cells, ["analysis_type", "reward_group"], "area", "mouse")


@book("res_perm_region")
@book("cmp_region_worker")
def _(d: Data) -> DataFrame:
    """Each area's mean against as many mice drawn without replacement from all areas: z, p and false-discovery control."""
    v = mouse_values(d).withColumn("k", F.pmod(F.xxhash64("mouse", "area"), F.lit(1 << 40)))
    out = series.subset_means(v, "reward_group", "area", "k", ["mouse", "area"], "delta", 10_000)
    return stats.fdr(out, ["reward_group"], "p")


def f_statistic(x: DataFrame, by: list[str], group: str, value: str) -> DataFrame:
    """One-way F from sums per group."""
    g = x.groupBy(*by, group).agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    t = g.groupBy(*by).agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    between = F.col("b") - F.col("s") * F.col("s") / F.col("n")
    within = F.col("q") - F.col("b")
    return t.where("k > 1 and n > k").select(*by, F.when(within > 1e-6, between / (F.col("k") - 1) / (within / (F.col("n") - F.col("k")))).alias("f"))


_FSQL = "WITH n AS (SELECT DISTINCT result_id, area, reward_group, CASE WHEN isnan(shift_magnitude) THEN NULL ELSE shift_magnitude END AS x FROM neuron_results), g AS (SELECT area, reward_group, count(x) AS n, sum(x) AS s, sum(x * x) AS q FROM n WHERE x IS NOT NULL GROUP BY 1, 2), t AS (SELECT area, sum(n) AS n, count(*) AS k, sum(s) AS s, sum(q) AS q, sum(s * s / n) AS b FROM g GROUP BY 1) SELECT area, round((b - s * s / n) / (k - 1) / ((q - b) / (n - k)), 4) AS f FROM t WHERE k > 1 AND n > k"


@book("cmp_f_stat", _FSQL)
def _(d: Data) -> DataFrame:
    return f_statistic(shifts(d).where("x is not null"), ["area"], "reward_group", "x").withColumn("f", F.round("f", 4))


_PMA = _PM.replace("range(1, 10000)", "range(1, 1001)") + ", gs AS (SELECT area, rep, lab.reward_group, count(*) AS n, sum(delta) AS s, sum(delta * delta) AS q FROM mv JOIN lab USING (mouse) GROUP BY 1, 2, 3), t AS (SELECT area, rep, sum(n) AS n, count(*) AS k, sum(s) AS s, sum(q) AS q, sum(s * s / n) AS b FROM gs GROUP BY 1, 2), g AS (SELECT area, rep, CASE WHEN q - b > 1e-6 THEN round((b - s * s / n) / (k - 1) / ((q - b) / (n - k)), 6) END AS f FROM t WHERE k > 1 AND n > k)"


@book("res_permanova", _PMA + _perm_p_sql("area", "f", "g", "{v} >= o - 1e-12"), "roc")
def _(d: Data) -> DataFrame:
    v = mouse_values(d)
    labels = rs.permuted_labels(v.select("mouse", "reward_group").distinct(), [], "mouse", "reward_group", 1000)
    f = f_statistic(v.drop("reward_group").join(labels, "mouse"), ["area", "rep"], "reward_group", "delta").withColumn("f", F.round("f", 6))
    return _rounded(rs.permutation_p(f, ["area"], "f", "greater"))


@book("res_permanova_mv")
def _(d: Data) -> DataFrame:
    """Pseudo-F of mouse vectors (one coordinate per area): sums of squares per coordinate add up, no distance table is needed."""
    v = mouse_values(d)
    labels = rs.permuted_labels(v.select("mouse", "reward_group").distinct(), [], "mouse", "reward_group", 9999)
    x = v.drop("reward_group").join(labels, "mouse")
    g = x.groupBy("rep", "area", "reward_group").agg(F.count("*").alias("n"), F.sum("delta").alias("s"), F.sum(F.col("delta") * F.col("delta")).alias("q"))
    a = g.groupBy("rep", "area").agg(F.sum("q").alias("q"), F.sum("s").alias("s"), F.sum("n").alias("n"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    t = a.groupBy("rep").agg(F.sum(F.col("b") - F.col("s") * F.col("s") / F.col("n")).alias("between"), F.sum(F.col("q") - F.col("b")).alias("within"), F.max("n").alias("n"))
    f = t.select("rep", F.lit("all").alias("what"), F.try_divide(F.col("between") * (F.col("n") - 2), F.nullif(F.col("within"), F.lit(0.0))).alias("f"))
    return rs.permutation_p(f, ["what"], "f", "greater")


_SH = _CNT + ", s AS (SELECT session_id, unit_id, event_id, post, lick_flag, row_number() OVER w AS i, count(*) OVER g AS n, least(39, (count(*) OVER g - 8) // 2) AS h FROM c WINDOW w AS (PARTITION BY session_id, unit_id ORDER BY event_id), g AS (PARTITION BY session_id, unit_id)), k AS (SELECT unnest(range(-39, 40)) AS k), r AS (SELECT y.session_id, y.unit_id, any_value(y.h) AS h, k.k, count(*) AS n_rows, CASE WHEN stddev_pop(x.post) > 1e-9 AND stddev_pop(y.lick_flag) > 1e-9 THEN corr(x.post, y.lick_flag) END AS r FROM s y JOIN k ON abs(k.k) <= y.h JOIN s x ON x.session_id = y.session_id AND x.unit_id = y.unit_id AND x.i = y.i + k.k WHERE y.h >= 1 AND y.i > y.h AND y.i <= y.n - y.h GROUP BY 1, 2, 4), o AS (SELECT *, max(CASE WHEN k = 0 THEN r END) OVER (PARTITION BY session_id, unit_id) AS o FROM r), q AS (SELECT session_id, unit_id, max(n_rows) AS n_rows, max(h) AS n_shifts, round(max(o), 5) + 0.0 AS r, count(*) FILTER (abs(r) >= abs(o) - 1e-9) AS m FROM o GROUP BY 1, 2 UNION ALL SELECT session_id, unit_id, count(*), 0, NULL, 0 FROM s WHERE h < 1 GROUP BY 1, 2) SELECT session_id, unit_id, n_rows, CAST(n_shifts AS BIGINT) AS n_shifts, r, m, round(CASE WHEN r IS NULL THEN 1 ELSE m / (2.0 * n_shifts + 1) END, 6) AS p_approx FROM q"


@book("res_shift", _SH, "us sp tr")
def _(d: Data) -> DataFrame:
    s = rs.shift_test(response_counts(d), ["session_id", "unit_id"], "event_id", "post", "lick_flag")
    return s.select("session_id", "unit_id", "n_rows", "n_shifts", (F.round("r", 5) + 0.0).alias("r"), "m", F.round("p_approx", 6).alias("p_approx"))


def _epochs(d: Data, **kw) -> DataFrame:
    """Two epochs (baseline, response) x two factors (lick, reward) per unit."""
    c = response_counts(d).join(d.trial_rows().select("session_id", "event_id", "reward_available"), ["session_id", "event_id"])
    out = None
    for epoch in ("pre", "post"):
        for factor in ("lick_flag", "reward_available"):
            one = rs.shift_test(c, ["session_id", "unit_id"], "event_id", epoch, factor, **kw).withColumn("epoch", F.lit(epoch)).withColumn("factor", F.lit(factor))
            out = one if out is None else out.unionByName(one)
    return out


@book("res_shift_session")
def _(d: Data) -> DataFrame:
    """The four tests of each unit, and the quadrant of its two response tests at the 0.05 level."""
    from axonlake.functions.labels import quadrant

    w = W.partitionBy("session_id", "unit_id")
    p = lambda f: F.max(F.when((F.col("epoch") == "post") & (F.col("factor") == f), F.col("p_approx"))).over(w)
    return _epochs(d).withColumn("quadrant", quadrant(p("lick_flag"), p("reward_available"), F.lit(0.05)))


@book("cmp_shift_helpers")
def _(d: Data) -> DataFrame:
    """The variants of the shift test, summarised per epoch and factor: linear and rank correlation, by size and one-sided, and
    the response's link to licks with the reward's share taken out."""
    c = response_counts(d).join(d.trial_rows().select("session_id", "event_id", "reward_available"), ["session_id", "event_id"])
    keys = ["session_id", "unit_id"]
    runs = [("pearson", "two-sided", None), ("spearman", "two-sided", None), ("pearson", "greater", None), ("pearson", "less", None), ("pearson", "two-sided", "reward_available")]
    out = None
    for score, side, given in runs:
        s = rs.shift_test(c, keys, "event_id", "post", "lick_flag", score=score, alternative=side, given=given)
        one = s.agg(F.count("*").alias("n_units"), F.count_if(F.col("n_shifts") == 0).alias("n_short"), F.count("r").alias("n_scored"), F.count_if(F.col("p_approx") < 0.05).alias("n_significant"), F.avg("r").alias("mean_r"))
        one = one.select(F.lit(score).alias("score"), F.lit(side).alias("alternative"), F.lit(given is not None).alias("partial"), "*")
        out = one if out is None else out.unionByName(one)
    return out


_R2 = _CNT + ", s AS (SELECT session_id, unit_id, event_id, post, row_number() OVER w - 1 AS k, coalesce(sum(post) OVER (PARTITION BY session_id, unit_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, count(*) OVER g AS n, sum(post) OVER g AS t, sum(post * post) OVER g AS q FROM c WINDOW w AS (PARTITION BY session_id, unit_id ORDER BY event_id), g AS (PARTITION BY session_id, unit_id)) SELECT session_id, unit_id, k AS split, round(CASE WHEN q - t * t / n > 1e-9 THEN greatest((s * s / k + (t - s) * (t - s) / (n - k) - t * t / n) / (q - t * t / n), 0) ELSE 0 END, 5) + 0.0 AS r2 FROM s WHERE k > 0"


_R2_SQL = _R2.replace("s * s / k", "CAST(s AS DOUBLE) * s / k").replace("(t - s) * (t - s) / (n - k)", "CAST(t - s AS DOUBLE) * (t - s) / (n - k)").replace("t * t / n", "CAST(t AS DOUBLE) * t / n")


@book("fit_r2_step", _R2_SQL, "us sp tr")
def _(d: Data) -> DataFrame:
    return rs.step_r2(response_counts(d), ["session_id", "unit_id"], "event_id", "post").withColumn("r2", F.round("r2", 5) + 0.0)


_PS = _R2_SQL[: _R2_SQL.index("SELECT session_id, unit_id, k AS split")] + ", r AS (SELECT session_id, unit_id, k AS split, " + _R2_SQL[_R2_SQL.index("round(CASE") + 6 : _R2_SQL.index(", 5) + 0.0 AS r2")] + " AS r2 FROM s WHERE k > 0), y AS (SELECT *, max(split) OVER (PARTITION BY session_id, unit_id) AS n FROM r), z AS (SELECT *, max(CASE WHEN split = greatest(n // 2, 1) THEN r2 END) OVER (PARTITION BY session_id, unit_id) AS o, 1000 * split // n - 1000 * (split - 1) // n AS t FROM y) SELECT session_id, unit_id, round(max(o), 5) + 0.0 AS observed, round((sum(CASE WHEN r2 >= o - 1e-9 THEN t ELSE 0 END) + 1) / (sum(t) + 1.0), 6) AS p FROM z GROUP BY 1, 2"


@book("res_pseudosession", _PS, "us sp tr")
@book("cmp_unit_inflection", _PS, "us sp tr")
def _(d: Data) -> DataFrame:
    """R squared at a given split against those at random pseudo splits: only the distinct splits are computed, weighted by how
    often 1000 draws pick them."""
    r2 = rs.step_r2(response_counts(d), ["session_id", "unit_id"], "event_id", "post")
    w = W.partitionBy("session_id", "unit_id")
    x = r2.withColumn("n", F.max("split").over(w)).withColumn("own", F.floor(F.col("n") / 2)).withColumn("o", F.max(F.when(F.col("split") == F.greatest(F.col("own"), F.lit(1)), F.col("r2"))).over(w))
    times = F.floor(1000 * F.col("split") / F.col("n")) - F.floor(1000 * (F.col("split") - 1) / F.col("n"))
    p = (F.sum(F.when(F.col("r2") >= F.col("o") - 1e-9, F.col("t")).otherwise(0)) + 1) / (F.sum("t") + 1)
    return x.withColumn("t", times).groupBy("session_id", "unit_id").agg((F.round(F.max("o"), 5) + 0.0).alias("observed"), F.round(p, 6).alias("p"))


@book("res_artifact")
def _(d: Data) -> DataFrame:
    t = d.trial_rows().where("trial_type = 'whisker_trial'").select("session_id", "event_id", "at_us")
    return rs.replace_artifact(d.spikes().distinct(), t, KEYS, "unit_id", 0, 100_000, -1_000_000)


QUERIES, ORACLE = book.queries, book.oracle
