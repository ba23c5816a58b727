"""Interval joins and peri-event histograms over units, spikes and trials."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from axonlake.operators import hist, interval
from axonlake.plans.registry import CTE, Book, Data

book = Book()
S = 1_000_000
KEYS, UNIT, EVENT = ["session_id"], ["unit_id"], ["event_id"]

_COUNT = """WITH hit AS (SELECT sp.session_id, sp.unit_id, tr.event_id, count(*) AS n FROM sp JOIN tr ON sp.session_id = tr.session_id
  AND sp.t_us >= tr.at_us + {a} AND sp.t_us {op} tr.at_us + {b} GROUP BY 1, 2, 3)
SELECT us.session_id, us.unit_id, tr.event_id, coalesce(hit.n, 0) AS n FROM us JOIN tr ON us.session_id = tr.session_id
LEFT JOIN hit ON hit.session_id = us.session_id AND hit.unit_id = us.unit_id AND hit.event_id = tr.event_id"""


@book("join_range_count", _COUNT.format(a=0, b=2 * S, op="<"), "us sp tr")
def _(d: Data) -> DataFrame:
    return interval.count_in_window(d.spikes(), d.unit_rows(), d.trial_rows(), KEYS, UNIT, EVENT, 0, 2 * S)


@book("join_range_closed", _COUNT.format(a=-S, b=S, op="<="), "us sp tr")
def _(d: Data) -> DataFrame:
    return interval.count_in_window(d.spikes(), d.unit_rows(), d.trial_rows(), KEYS, UNIT, EVENT, -S, S, "both")


@book("join_range_raster", f"SELECT sp.session_id, unit_id, event_id, t_us - at_us AS t_rel_us FROM sp JOIN tr ON sp.session_id = tr.session_id AND t_us BETWEEN at_us - {S} AND at_us + {S}", "sp tr")
def _(d: Data) -> DataFrame:
    return interval.raster(d.spikes(), d.trial_rows().select("session_id", "event_id", "at_us"), KEYS, -S, S).select("session_id", "unit_id", "event_id", "t_rel_us")


@book("join_range_raster_list", f"SELECT sp.session_id, unit_id, event_id, string_agg(CAST(t_us - at_us AS VARCHAR), ',' ORDER BY t_us) AS times FROM sp JOIN tr ON sp.session_id = tr.session_id AND t_us >= at_us AND t_us < at_us + {S} GROUP BY 1, 2, 3", "sp tr")
def _(d: Data) -> DataFrame:
    r = interval.raster(d.spikes(), d.trial_rows().select("session_id", "event_id", "at_us"), KEYS, 0, S, "left")
    return r.groupBy("session_id", "unit_id", "event_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("t_rel_us")), lambda x: x.cast("string")), ",").alias("times"))


@book("cmp_rate_one", _COUNT.format(a=-S, b=0, op="<").replace("coalesce(hit.n, 0) AS n", "coalesce(hit.n, 0) / 1.0 AS rate"), "us sp tr")
def _(d: Data) -> DataFrame:
    c = interval.count_in_window(d.spikes(), d.unit_rows(), d.trial_rows(), KEYS, UNIT, EVENT, -S, 0)
    return c.select("session_id", "unit_id", "event_id", (F.col("n") / 1.0).alias("rate"))


@book("join_asof_nearest", """SELECT l.session_id, l.trial_id, arg_min(w.at_us, (abs(w.at_us - l.at_us), w.at_us)) AS match_t, arg_min(w.lick_flag, (abs(w.at_us - l.at_us), w.at_us, w.lick_flag)) AS lick
FROM tr l LEFT JOIN tr w ON w.session_id = l.session_id AND w.trial_type = 'whisker_trial' GROUP BY 1, 2""", "tr")
def _(d: Data) -> DataFrame:
    t = d.trial_rows()
    w = t.where("trial_type = 'whisker_trial'").select("session_id", F.col("at_us").alias("w_us"), F.col("lick_flag").alias("lick"))
    return interval.nearest(t.select("session_id", "trial_id", "at_us"), w, KEYS, "at_us", "w_us", "lick").select("session_id", "trial_id", "match_t", "lick")


@book("join_nearest_grid", """WITH g AS (SELECT DISTINCT session_id, imec_id, floor(depth / 500) * 500.0 AS depth_bin FROM u WHERE depth IS NOT NULL),
b AS (SELECT g.session_id, g.imec_id, k.t_bin, g.depth_bin, (k.t_bin / 1000000 * 7 + g.depth_bin) % 13 AS displacement FROM g, (SELECT unnest([15000000, 35000000, 55000000]) AS t_bin) k),
p AS (SELECT DISTINCT sp.session_id, u.imec_id, sp.unit_id, sp.t_us, u.depth FROM sp JOIN u ON sp.session_id = u.session_id AND sp.unit_id = u.unit_id WHERE u.depth IS NOT NULL),
n AS (SELECT *, CASE WHEN t_us <= 25000000 THEN 15000000 WHEN t_us <= 45000000 THEN 35000000 ELSE 55000000 END AS t_bin FROM p)
SELECT n.session_id, n.unit_id, n.t_us, n.t_bin, arg_min(b.displacement, (abs(b.depth_bin - n.depth), b.depth_bin)) AS displacement
FROM n JOIN b ON n.session_id = b.session_id AND n.imec_id IS NOT DISTINCT FROM b.imec_id AND n.t_bin = b.t_bin GROUP BY 1, 2, 3, 4""", "u sp")
def _(d: Data) -> DataFrame:
    u = d.unit_rows("imec_id", "depth").where("depth is not null")
    bins = u.select("session_id", "imec_id", (F.floor(F.col("depth") / 500) * 500.0).alias("depth_bin")).distinct()
    g = bins.withColumn("t_bin", F.explode(F.array(*[F.lit(x).cast("long") for x in (15 * S, 35 * S, 55 * S)])))
    g = g.withColumn("displacement", (F.col("t_bin") / 1000000 * 7 + F.col("depth_bin")) % 13)
    # the hint keeps spikes, few bytes by the size of their file, from being broadcast
    p = d.spikes().hint("merge").join(u, ["session_id", "unit_id"]).distinct()
    return interval.nearest_grid(p, g, ["session_id", "imec_id"], "t_us", "depth").select("session_id", "unit_id", "t_us", "t_bin", "displacement")


_LICKS = "licks AS (SELECT DISTINCT session_id, CAST(round(jaw_onset_time * 1000000) AS BIGINT) AS t_us FROM trials WHERE jaw_onset_time IS NOT NULL AND NOT isnan(jaw_onset_time))"


def licks(d: Data) -> DataFrame:
    return d.trials.select("session_id", interval.micros(F.col("jaw_onset_time")).alias("t_us")).where("t_us is not null").distinct()


@book("join_anti_proximity", f"WITH {_LICKS} SELECT session_id, t_us FROM licks WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr.session_id = licks.session_id AND tr.trial_type <> 'no_stim_trial' AND licks.t_us > tr.at_us AND licks.t_us - tr.at_us <= 500000)", "tr")
def _(d: Data) -> DataFrame:
    ref = d.trial_rows().where("trial_type <> 'no_stim_trial'").select("session_id", F.col("at_us").alias("ref_us"))
    return interval.drop_near(licks(d), ref, KEYS, 500_000)


def _fold_sql(table: str, keys: str, gap: int) -> str:
    """The greedy filter as a recursive query: from each kept time on to the first time beyond the gap."""
    on = " AND ".join(f"nx.{k} = r.{k}" for k in keys.split(", "))
    return (
        f"nx AS (SELECT {keys}, t_us, min(t_us) OVER (PARTITION BY {keys} ORDER BY t_us RANGE BETWEEN {gap + 1} FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt, min(t_us) OVER (PARTITION BY {keys}) AS first_us FROM (SELECT DISTINCT {keys}, t_us FROM {table})), "
        f"r AS (SELECT {keys}, t_us, nxt FROM nx WHERE t_us = first_us UNION ALL SELECT nx.{keys.replace(', ', ', nx.')}, nx.t_us, nx.nxt FROM r JOIN nx ON {on} AND nx.t_us = r.nxt)"
    )


@book("win_refractory", "WITH RECURSIVE " + CTE["sp"] + ", " + _fold_sql("sp", "session_id, unit_id", S) + " SELECT session_id, unit_id, t_us FROM r", "")
def _(d: Data) -> DataFrame:
    return interval.refractory(d.spikes(), ["session_id", "unit_id"], S)


@book("cmp_lick_filter", "WITH RECURSIVE " + CTE["tr"] + f", {_LICKS}, " + _fold_sql("licks", "session_id", 300_000) + " SELECT session_id, t_us FROM r WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr.session_id = r.session_id AND r.t_us > tr.at_us AND r.t_us - tr.at_us <= 500000)", "")
def _(d: Data) -> DataFrame:
    ref = d.trial_rows().select("session_id", F.col("at_us").alias("ref_us"))
    return interval.drop_near(interval.refractory(licks(d), KEYS, 300_000), ref, KEYS, 500_000)


@book("agg_hist_fixed", """SELECT session_id, least((t_us - 10000000) // 6000000, 9) AS bin, count(*) AS n FROM sp WHERE t_us BETWEEN 10000000 AND 70000000 GROUP BY 1, 2""", "sp")
def _(d: Data) -> DataFrame:
    return d.spikes().withColumn("bin", hist.fixed_bins(F.col("t_us"), 10 * S, 70 * S, 6 * S)).where("bin is not null").groupBy("session_id", "bin").agg(F.count("*").alias("n"))


_BINS = "bins AS (SELECT CAST(unnest(range(0, {n})) AS BIGINT) AS bin)"
_PETH = """WITH bins AS (SELECT CAST(unnest(range(0, 8)) AS BIGINT) AS bin),
hit AS (SELECT sp.session_id, unit_id, event_id, (t_us - at_us + 1000000) // 500000 AS bin, count(*) AS n FROM sp JOIN tr ON sp.session_id = tr.session_id AND t_us >= at_us - 1000000 AND t_us < at_us + 3000000 GROUP BY 1, 2, 3, 4),
cell AS (SELECT us.session_id, us.unit_id, tr.trial_type, tr.ctx, tr.lick_flag, tr.event_id, bins.bin, coalesce(hit.n, 0) AS n FROM us JOIN tr ON us.session_id = tr.session_id CROSS JOIN bins
  LEFT JOIN hit ON hit.session_id = us.session_id AND hit.unit_id = us.unit_id AND hit.event_id = tr.event_id AND hit.bin = bins.bin)
"""


@book("agg_session_dynamics", _PETH + "SELECT session_id, unit_id, event_id, bin, n FROM cell", "us sp tr")
def _(d: Data) -> DataFrame:
    return hist.peth(d.spikes(), d.unit_rows(), d.trial_rows().select("session_id", "event_id", "at_us"), KEYS, UNIT, EVENT, -S, 3 * S, S // 2)


def _mean(d: Data, cond: list[str]) -> DataFrame:
    return hist.mean_peth(d.spikes(), d.unit_rows(), d.trial_rows().select("session_id", "event_id", "at_us", *cond), KEYS, UNIT, cond, -S, 3 * S, S // 2)


_BY = "session_id, unit_id, trial_type, ctx, lick_flag, bin"


@book("agg_peth", _PETH + "SELECT session_id, unit_id, bin, count(*) AS n_events, round(avg(n) / 0.5, 6) AS rate FROM cell GROUP BY 1, 2, 3", "us sp tr")
@book("agg_psth_simple", _PETH + "SELECT session_id, unit_id, bin, count(*) AS n_events, round(avg(n) / 0.5, 6) AS rate FROM cell GROUP BY 1, 2, 3", "us sp tr")
def _(d: Data) -> DataFrame:
    return _mean(d, []).select("session_id", "unit_id", "bin", "n_events", F.round("rate", 6).alias("rate"))


@book("agg_peth_cond", _PETH + f"SELECT {_BY}, count(*) AS n_events, CAST(sum(n) AS BIGINT) AS total, round(avg(n) / 0.5, 6) AS rate, round(stddev_pop(n) / sqrt(count(*)) / 0.5, 5) AS sem FROM cell GROUP BY {_BY}", "us sp tr")
def _(d: Data) -> DataFrame:
    p = _mean(d, ["trial_type", "ctx", "lick_flag"])
    return p.select("session_id", "unit_id", "trial_type", "ctx", "lick_flag", "bin", "n_events", "total", F.round("rate", 6).alias("rate"), F.round("sem", 5).alias("sem"))


_BLOCK = "tb AS (SELECT *, (row_number() OVER (PARTITION BY session_id, trial_type ORDER BY at_us, trial_id) - 1) // 3 AS block_id FROM tr)"


@book("agg_peth_block", _PETH.replace("WITH bins", f"WITH {_BLOCK}, bins").replace("tr.trial_type, tr.ctx, tr.lick_flag, tr.event_id", "tb.trial_type, tb.block_id, tb.event_id").replace("us JOIN tr ON us.session_id = tr.session_id", "us JOIN tb ON us.session_id = tb.session_id").replace("hit.event_id = tr.event_id", "hit.event_id = tb.event_id")
      + "SELECT session_id, unit_id, trial_type, block_id, bin, count(*) AS n_events, round(avg(n) / 0.5, 6) AS rate FROM cell GROUP BY 1, 2, 3, 4, 5", "us sp tr")
def _(d: Data) -> DataFrame:
    k = F.row_number().over(W.partitionBy("session_id", "trial_type").orderBy("at_us", "trial_id")) - 1
    t = d.trial_rows().withColumn("block_id", F.floor(k / 3)).select("session_id", "event_id", "at_us", "trial_type", "block_id")
    p = hist.mean_peth(d.spikes(), d.unit_rows(), t, KEYS, UNIT, ["trial_type", "block_id"], -S, 3 * S, S // 2)
    return p.select("session_id", "unit_id", "trial_type", "block_id", "bin", "n_events", F.round("rate", 6).alias("rate"))


_INFL = "ti AS (SELECT tr.*, CASE WHEN row_number() OVER (PARTITION BY session_id, trial_type ORDER BY at_us, trial_id) - 1 < coalesce(l.k, 0) THEN 'pre' ELSE 'post' END AS phase FROM tr LEFT JOIN (SELECT mouse_id AS m, min(inflection_trial) AS k FROM neuron_results GROUP BY 1) l ON l.m = tr.mouse_id)"


@book("agg_peth_inflection", _PETH.replace("WITH bins", f"WITH {_INFL}, bins").replace("tr.trial_type, tr.ctx, tr.lick_flag, tr.event_id", "ti.trial_type, ti.phase, ti.event_id").replace("us JOIN tr ON us.session_id = tr.session_id", "us JOIN ti ON us.session_id = ti.session_id").replace("hit.event_id = tr.event_id", "hit.event_id = ti.event_id")
      + "SELECT session_id, unit_id, trial_type, phase, bin, count(*) AS n_events, round(avg(n) / 0.5, 6) AS rate FROM cell GROUP BY 1, 2, 3, 4, 5", "us sp tr")
def _(d: Data) -> DataFrame:
    learning = d.neuron_results.groupBy("mouse_id").agg(F.min("inflection_trial").alias("_k"))
    k = F.row_number().over(W.partitionBy("session_id", "trial_type").orderBy("at_us", "trial_id")) - 1
    t = d.trial_rows().join(learning, "mouse_id", "left").withColumn("phase", F.when(k < F.coalesce("_k", F.lit(0)), "pre").otherwise("post")).select("session_id", "event_id", "at_us", "trial_type", "phase")
    # planned from the size of files, which says nothing of spikes per unit: without the hint these may be broadcast
    p = hist.mean_peth(d.spikes().hint("merge"), d.unit_rows(), t, KEYS, UNIT, ["trial_type", "phase"], -S, 3 * S, S // 2)
    return p.select("session_id", "unit_id", "trial_type", "phase", "bin", "n_events", F.round("rate", 6).alias("rate"))


_SUB = _PETH + """, b AS (SELECT *, n - avg(n) FILTER (bin < 2) OVER (PARTITION BY session_id, unit_id, event_id) AS v FROM cell)
SELECT session_id, unit_id, ctx, bin, round(avg(v), 6) AS mean, round({sd}(v) / sqrt(count(*)), 5) AS sem FROM b GROUP BY 1, 2, 3, 4"""


def _per_trial(d: Data) -> DataFrame:
    t = d.trial_rows().select("session_id", "event_id", "at_us")
    p = hist.peth(d.spikes(), d.unit_rows(), t, KEYS, UNIT, EVENT, -S, 3 * S, S // 2)
    p = p.join(d.trial_rows().select("session_id", "event_id", "trial_type", "ctx"), ["session_id", "event_id"])
    return hist.subtract_baseline(p, ["session_id", "unit_id", "event_id"], "n", 2)


@book("agg_psth_sem", _SUB.format(sd="stddev_pop"), "us sp tr")
def _(d: Data) -> DataFrame:
    return _per_trial(d).groupBy("session_id", "unit_id", "ctx", "bin").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value") / F.sqrt(F.count("*")), 5).alias("sem"))


@book("agg_psth_sem1", _SUB.format(sd="stddev_samp"), "us sp tr")
def _(d: Data) -> DataFrame:
    return _per_trial(d).groupBy("session_id", "unit_id", "ctx", "bin").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value") / F.sqrt(F.count("*")), 5).alias("sem"))


@book("agg_baseline", _PETH + "SELECT session_id, unit_id, round(avg(n) FILTER (bin < 2), 6) AS baseline, round(avg(n) FILTER (bin >= 2 AND bin < 4) - avg(n) FILTER (bin < 2), 6) AS amplitude FROM cell GROUP BY 1, 2", "us sp tr")
def _(d: Data) -> DataFrame:
    p = _mean(d, []).withColumn("m", F.col("rate") * 0.5)
    base, resp = F.avg(F.when(F.col("bin") < 2, F.col("m"))), F.avg(F.when((F.col("bin") >= 2) & (F.col("bin") < 4), F.col("m")))
    return p.groupBy("session_id", "unit_id").agg(F.round(base, 6).alias("baseline"), F.round(resp - base, 6).alias("amplitude"))


@book("agg_mean_fr", _PETH.split(",\ncell")[0] + " SELECT us.session_id, us.unit_id, round(coalesce(sum(n), 0) / (4.0 * any_value(e.k)), 6) AS rate FROM us JOIN (SELECT session_id, count(*) AS k FROM tr GROUP BY 1) e ON e.session_id = us.session_id LEFT JOIN hit ON hit.session_id = us.session_id AND hit.unit_id = us.unit_id GROUP BY 1, 2", "us sp tr")
def _(d: Data) -> DataFrame:
    return mean_rate(d)


def mean_rate(d: Data) -> DataFrame:
    """Pooled rate over all trials' windows of [-1, 3) s per unit."""
    t = d.trial_rows().select("session_id", "event_id", "at_us")
    hits = interval.range_join(d.spikes(), t, KEYS, -S, 3 * S).groupBy("session_id", "unit_id").agg(F.count("*").alias("c"))
    k = t.groupBy("session_id").agg(F.count("*").alias("k"))
    x = d.unit_rows().join(k, "session_id").join(hits, ["session_id", "unit_id"], "left")
    return x.select("session_id", "unit_id", F.round(F.coalesce("c", F.lit(0)) / (4.0 * F.col("k")), 6).alias("rate"))


@book("flt_fr", _PETH.split(",\ncell")[0] + " SELECT us.session_id, us.unit_id FROM us JOIN (SELECT session_id, count(*) AS k FROM tr GROUP BY 1) e ON e.session_id = us.session_id LEFT JOIN hit ON hit.session_id = us.session_id AND hit.unit_id = us.unit_id GROUP BY 1, 2 HAVING round(coalesce(sum(n), 0) / (4.0 * any_value(e.k)), 6) >= 1", "us sp tr")
def _(d: Data) -> DataFrame:
    return mean_rate(d).where("rate >= 1").select("session_id", "unit_id")


@book("agg_fano", _PETH + "SELECT session_id, unit_id, bin, round(CASE WHEN avg(n) = 0 THEN NULL ELSE var_pop(n) / avg(n) END, 5) AS fano FROM cell GROUP BY 1, 2, 3", "us sp tr")
def _(d: Data) -> DataFrame:
    p = _mean(d, [])
    m = F.col("rate") * 0.5
    var = F.pow(F.col("sem") * 0.5 * F.sqrt("n_events"), 2)
    return p.select("session_id", "unit_id", "bin", F.round(F.try_divide(var, F.nullif(m, F.lit(0.0))), 5).alias("fano"))


@book("agg_psth_area", _PETH + """, p AS (SELECT cell.session_id, cell.unit_id, u.ccf_parent_acronym AS area, u.reward_group, trial_type, bin, avg(n) / 0.5 AS rate FROM cell JOIN (SELECT DISTINCT session_id, unit_id, ccf_parent_acronym, reward_group FROM units) u ON u.session_id = cell.session_id AND u.unit_id = cell.unit_id GROUP BY 1, 2, 3, 4, 5, 6)
SELECT area, reward_group, trial_type, bin, count(*) AS n_units, round(avg(rate), 5) AS rate FROM p GROUP BY 1, 2, 3, 4""", "us sp tr")
@book("cmp_area_matrix", _PETH + """, p AS (SELECT cell.session_id, cell.unit_id, u.ccf_parent_acronym AS area, u.reward_group, trial_type, bin, avg(n) / 0.5 AS rate FROM cell JOIN (SELECT DISTINCT session_id, unit_id, ccf_parent_acronym, reward_group FROM units) u ON u.session_id = cell.session_id AND u.unit_id = cell.unit_id GROUP BY 1, 2, 3, 4, 5, 6)
SELECT area, reward_group, trial_type, bin, count(*) AS n_units, round(avg(rate), 5) AS rate FROM p GROUP BY 1, 2, 3, 4""", "us sp tr")
def _(d: Data) -> DataFrame:
    return area_psth(d).withColumn("rate", F.round("rate", 5))


def area_psth(d: Data) -> DataFrame:
    p = _mean(d, ["trial_type"]).join(d.unit_rows("ccf_parent_acronym", "reward_group"), ["session_id", "unit_id"])
    return p.groupBy(F.col("ccf_parent_acronym").alias("area"), "reward_group", "trial_type", "bin").agg(F.count("*").alias("n_units"), F.avg("rate").alias("rate"))


@book("agg_zscore", _PETH + ", p AS (SELECT session_id, unit_id, bin, avg(n) / 0.5 AS rate FROM cell GROUP BY 1, 2, 3), z AS (SELECT *, avg(rate) OVER w AS m, stddev_pop(rate) OVER w AS s FROM p WINDOW w AS (PARTITION BY session_id, unit_id)) SELECT session_id, unit_id, bin, round((rate - m) / CASE WHEN s < 1e-9 THEN NULL ELSE s END, 4) + 0.0 AS z FROM z", "us sp tr")
def _(d: Data) -> DataFrame:
    w = W.partitionBy("session_id", "unit_id")
    p = _mean(d, [])
    sd = F.stddev_pop("rate").over(w)
    return p.select("session_id", "unit_id", "bin", (F.round((F.col("rate") - F.avg("rate").over(w)) / F.when(sd >= 1e-9, sd), 4) + 0.0).alias("z"))


_RATES = _PETH + ", p AS (SELECT session_id, unit_id, bin, avg(n) / 0.5 AS rate FROM cell GROUP BY 1, 2, 3) "
_W = "OVER (PARTITION BY session_id, unit_id ORDER BY bin"


def _gauss_sql(sigma: float, radius: int, causal: bool) -> str:
    ws = hist.weights_gauss(sigma, radius, causal)
    first = 0 if causal else -radius
    f = lambda k: f"lag(rate, {k})" if k > 0 else ("rate" if k == 0 else f"lead(rate, {-k})")
    return " + ".join(f"{w!r} * coalesce({f(first + i)}" + (f" {_W}), 0)" if first + i else ", 0)") for i, w in enumerate(ws))


def _rate_rows(d: Data) -> DataFrame:
    return _mean(d, []).select("session_id", "unit_id", "bin", "rate")


@book("win_gauss_causal", _RATES + f"SELECT session_id, unit_id, bin, round({_gauss_sql(1.0, 3, True)}, 5) AS smooth FROM p", "us sp tr")
def _(d: Data) -> DataFrame:
    s = hist.fir(_rate_rows(d), ["session_id", "unit_id"], "bin", "rate", hist.weights_gauss(1.0, 3, True), 0)
    return s.select("session_id", "unit_id", "bin", F.round("smooth", 5).alias("smooth"))


@book("win_gauss_sym", _RATES + f"SELECT session_id, unit_id, bin, round({_gauss_sql(1.0, 2, False)}, 5) AS smooth FROM p", "us sp tr")
def _(d: Data) -> DataFrame:
    s = hist.fir(_rate_rows(d), ["session_id", "unit_id"], "bin", "rate", hist.weights_gauss(1.0, 2, False), -2)
    return s.select("session_id", "unit_id", "bin", F.round("smooth", 5).alias("smooth"))


@book("win_moving_avg", _RATES + f"SELECT session_id, unit_id, bin, round(avg(rate) {_W} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 5) AS smooth FROM p", "us sp tr")
def _(d: Data) -> DataFrame:
    return hist.moving_average(_rate_rows(d), ["session_id", "unit_id"], "bin", "rate", 1).select("session_id", "unit_id", "bin", F.round("smooth", 5).alias("smooth"))


@book("win_boxcar_causal", _RATES + f"SELECT session_id, unit_id, bin, round(sum(rate) {_W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 5) AS smooth FROM p", "us sp tr")
def _(d: Data) -> DataFrame:
    return hist.boxcar(_rate_rows(d), ["session_id", "unit_id"], "bin", "rate", 3).select("session_id", "unit_id", "bin", F.round("smooth", 5).alias("smooth"))


@book("win_median", _RATES + f"SELECT session_id, unit_id, bin, round(quantile_cont(rate, 0.5) {_W} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 5) AS smooth FROM p", "us sp tr")
def _(d: Data) -> DataFrame:
    return hist.median_filter(_rate_rows(d), ["session_id", "unit_id"], "bin", "rate", 1).select("session_id", "unit_id", "bin", F.round("smooth", 5).alias("smooth"))


_SG = [repr(x) for x in hist.savgol_weights(5, 2)]


@book("win_savgol", _RATES + "SELECT session_id, unit_id, bin, round(" + " + ".join(f"{w} * coalesce({('lag(rate, ' + str(2 - i) + ')') if i < 2 else ('rate' if i == 2 else 'lead(rate, ' + str(i - 2) + ')')}" + (f" {_W}), 0)" if i != 2 else ", 0)") for i, w in enumerate(_SG)) + ", 4) + 0.0 AS smooth FROM p", "us sp tr")
def _(d: Data) -> DataFrame:
    s = hist.fir(_rate_rows(d), ["session_id", "unit_id"], "bin", "rate", hist.savgol_weights(5, 2), -2)
    return s.select("session_id", "unit_id", "bin", (F.round("smooth", 4) + 0.0).alias("smooth"))


_AREA = _PETH + """, p AS (SELECT cell.session_id, cell.unit_id, u.ccf_parent_acronym AS area, u.reward_group, trial_type, bin, avg(n) / 0.5 AS rate FROM cell JOIN (SELECT DISTINCT session_id, unit_id, ccf_parent_acronym, reward_group FROM units) u ON u.session_id = cell.session_id AND u.unit_id = cell.unit_id GROUP BY 1, 2, 3, 4, 5, 6),
a AS (SELECT area, reward_group, trial_type, bin, round(avg(rate), 7) AS rate FROM p WHERE area IS NOT NULL GROUP BY 1, 2, 3, 4)"""


@book("win_first_crossing", _AREA + ", k AS (SELECT *, max(abs(rate)) OVER (PARTITION BY area, reward_group, trial_type) AS m FROM a) SELECT area, reward_group, trial_type, min(bin) AS latency FROM k WHERE m > 0 AND rate >= 0.5 * m GROUP BY 1, 2, 3", "us sp tr")
def _(d: Data) -> DataFrame:
    a = area_psth(d).where("area is not null").withColumn("rate", F.round("rate", 7))
    return hist.first_crossing(a, ["area", "reward_group", "trial_type"], "bin", "rate", 0.5)


@book("win_onset_2bins", _AREA + ", k AS (SELECT *, avg(rate) FILTER (bin < 2) OVER g + 1 * stddev_pop(rate) FILTER (bin < 2) OVER g AS l, lead(rate) OVER (PARTITION BY area, reward_group, trial_type ORDER BY bin) AS nxt FROM a WINDOW g AS (PARTITION BY area, reward_group, trial_type)) SELECT area, reward_group, trial_type, min(bin) AS onset FROM k WHERE bin >= 2 AND rate > l + 1e-9 AND nxt > l + 1e-9 GROUP BY 1, 2, 3", "us sp tr")
@book("cmp_latency", _AREA + ", k AS (SELECT *, avg(rate) FILTER (bin < 2) OVER g + 1 * stddev_pop(rate) FILTER (bin < 2) OVER g AS l, lead(rate) OVER (PARTITION BY area, reward_group, trial_type ORDER BY bin) AS nxt FROM a WINDOW g AS (PARTITION BY area, reward_group, trial_type)) SELECT area, reward_group, trial_type, min(bin) AS onset FROM k WHERE bin >= 2 AND rate > l + 1e-9 AND nxt > l + 1e-9 GROUP BY 1, 2, 3", "us sp tr")
def _(d: Data) -> DataFrame:
    a = area_psth(d).where("area is not null").withColumn("rate", F.round("rate", 7))
    return hist.onset(a, ["area", "reward_group", "trial_type"], "bin", "rate", F.col("bin") < 2, 1.0)


@book("agg_bin_mean", """WITH s AS (SELECT DISTINCT * FROM samples), b AS (SELECT session_id, signal, CAST(floor(t) AS BIGINT) AS bin, CASE WHEN NOT isnan(value) THEN value END AS value FROM s WHERE t IS NOT NULL AND NOT isnan(t)),
k AS (SELECT session_id, signal, unnest(range(min(bin), max(bin) + 1)) AS bin FROM b GROUP BY 1, 2)
SELECT k.session_id, k.signal, k.bin, coalesce(CAST(sum(CAST(b.value AS DECIMAL(28, 8))) AS DOUBLE) / nullif(count(b.value), 0), 0) AS mean, count(b.value) AS n FROM k LEFT JOIN b ON b.session_id IS NOT DISTINCT FROM k.session_id AND b.signal IS NOT DISTINCT FROM k.signal AND b.bin = k.bin GROUP BY 1, 2, 3""")
def _(d: Data) -> DataFrame:
    """Bins of 1 s of each series from its first to its last sample, whatever the length of the recording; sums in decimals, so exact."""
    b = hist.bin_means_whole(d.samples.distinct(), ["session_id", "signal"], "t", "value", 1.0)
    return b.select("session_id", "signal", "bin", "mean", "n")


@book("agg_event_raster_bin", f"""WITH {_LICKS}, bins AS (SELECT CAST(unnest(range(0, 8)) AS BIGINT) AS bin), h AS (SELECT tr.session_id, event_id, (t_us - at_us) // 500000 AS bin FROM licks JOIN tr ON licks.session_id = tr.session_id AND t_us >= at_us AND t_us < at_us + 4000000),
f AS (SELECT session_id, event_id, min(bin) AS first_bin FROM h GROUP BY 1, 2)
SELECT tr.session_id, tr.event_id, bins.bin, CASE WHEN f.first_bin = bins.bin THEN 1 ELSE 0 END AS first_only, CASE WHEN EXISTS (SELECT 1 FROM h WHERE h.session_id = tr.session_id AND h.event_id = tr.event_id AND h.bin = bins.bin) THEN 1 ELSE 0 END AS any_event
FROM tr CROSS JOIN bins LEFT JOIN f ON f.session_id = tr.session_id AND f.event_id = tr.event_id""", "tr")
def _(d: Data) -> DataFrame:
    t = d.trial_rows().select("session_id", "event_id", "at_us")
    h = interval.raster(licks(d), t, KEYS, 0, 4 * S, "left").withColumn("bin", F.floor(F.col("t_rel_us") / F.lit(S // 2)))
    h = h.select("session_id", "event_id", "bin").distinct().withColumn("first", F.min("bin").over(W.partitionBy("session_id", "event_id")))
    x = hist.with_bins(t, 8).join(h, ["session_id", "event_id", "bin"], "left")
    return x.select("session_id", "event_id", "bin", F.when(F.col("first") == F.col("bin"), 1).otherwise(0).alias("first_only"), F.when(F.col("first").isNotNull(), 1).otherwise(0).alias("any_event"))


QUERIES, ORACLE = book.queries, book.oracle
