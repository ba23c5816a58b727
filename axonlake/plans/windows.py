"""Window features over trial sequences, inter-spike intervals and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from axonlake.operators import relational as rel
from axonlake.plans.registry import Book, Data
from axonlake.plans.statistics import shifts

book = Book()
ORD = ["at_us", "trial_id"]
SEQ = "(PARTITION BY session_id ORDER BY at_us, trial_id)"
TYP = "(PARTITION BY session_id, trial_type ORDER BY at_us, trial_id)"


def by(*keys: str):
    return W.partitionBy(*keys)


def seq():
    return by("session_id").orderBy(*ORD)


def typ():
    return by("session_id", "trial_type").orderBy(*ORD)


@book("win_cumcount", f"SELECT session_id, trial_id, row_number() OVER {TYP} - 1 AS k FROM tr", "tr")
def _(d: Data) -> DataFrame:
    return d.trial_rows().select("session_id", "trial_id", (F.row_number().over(typ()) - 1).alias("k"))


@book("win_block_id", f"SELECT session_id, trial_id, (row_number() OVER {TYP} - 1) // 4 AS block_id FROM tr", "tr")
def _(d: Data) -> DataFrame:
    return d.trial_rows().select("session_id", "trial_id", F.floor((F.row_number().over(typ()) - 1) / 4).alias("block_id"))


_HALF = "WITH p AS (SELECT *, row_number() OVER (PARTITION BY session_id, ctx ORDER BY at_us, trial_id) AS k, count(*) OVER (PARTITION BY session_id, ctx) AS n FROM tr) SELECT session_id, trial_id, CASE WHEN ctx <> 'passive' THEN CASE WHEN lick_flag = 1 THEN 'active_lick' ELSE 'active_nolick' END WHEN k - 1 < n // 2 THEN 'passive_pre' ELSE 'passive_post' END AS period FROM p"


def half_split(t: DataFrame) -> DataFrame:
    """The three-way context: active (lick or not), and the first and second half of the passive trials (odd: second is longer)."""
    k = F.row_number().over(by("session_id", "ctx").orderBy(*ORD))
    n = F.count("*").over(by("session_id", "ctx"))
    period = F.when(F.col("ctx") != "passive", F.when(F.col("lick_flag") == 1, "active_lick").otherwise("active_nolick")).when(k - 1 < F.floor(n / 2), "passive_pre").otherwise("passive_post")
    return t.withColumn("period", period)


@book("win_half_split", _HALF, "tr")
@book("cmp_passive_ctx", _HALF, "tr")
def _(d: Data) -> DataFrame:
    return half_split(d.trial_rows()).select("session_id", "trial_id", "period")


@book("src_units_trials", _HALF.replace("SELECT session_id, trial_id, CASE", "SELECT p.session_id, trial_id, g.n_good, CASE").replace(" FROM p", " FROM p JOIN (SELECT session_id, count(*) AS n_good FROM u WHERE lower(trim(bc_label)) = 'good' GROUP BY 1) g ON g.session_id = p.session_id"), "u tr")
def _(d: Data) -> DataFrame:
    g = d.unit_rows("bc_label").where(F.lower(F.trim("bc_label")) == "good").groupBy("session_id").agg(F.count("*").alias("n_good"))
    return half_split(d.trial_rows()).join(g, "session_id").select("session_id", "trial_id", "n_good", "period")


@book("win_odd_even", f"SELECT session_id, trial_id, row_number() OVER {TYP} % 2 AS half FROM tr", "tr")
def _(d: Data) -> DataFrame:
    return d.trial_rows().select("session_id", "trial_id", (F.row_number().over(typ()) % 2).alias("half"))


@book("cmp_trial_counts", f"WITH h AS (SELECT *, row_number() OVER {TYP} % 2 AS half FROM tr) SELECT mouse_id, trial_type, ctx, count(*) AS n, count(*) FILTER (half = 1) AS n_odd, count(*) FILTER (half = 0) AS n_even FROM h GROUP BY 1, 2, 3", "tr")
def _(d: Data) -> DataFrame:
    h = d.trial_rows().withColumn("half", F.row_number().over(typ()) % 2)
    return h.groupBy("mouse_id", "trial_type", "ctx").agg(F.count("*").alias("n"), F.count_if(F.col("half") == 1).alias("n_odd"), F.count_if(F.col("half") == 0).alias("n_even"))


@book("win_first_active", "WITH f AS (SELECT *, min(CASE WHEN ctx = 'active' THEN trial_id END) OVER (PARTITION BY session_id) AS first_active FROM tr) SELECT session_id, trial_id, first_active, max(CASE WHEN trial_id < first_active THEN trial_id END) OVER (PARTITION BY session_id) AS last_before FROM f", "tr")
def _(d: Data) -> DataFrame:
    w = by("session_id")
    t = d.trial_rows().withColumn("first_active", F.min(F.when(F.col("ctx") == "active", F.col("trial_id"))).over(w))
    return t.select("session_id", "trial_id", "first_active", F.max(F.when(F.col("trial_id") < F.col("first_active"), F.col("trial_id"))).over(w).alias("last_before"))


@book("win_rebase", "SELECT session_id, trial_id, trial_id - min(CASE WHEN trial_type = 'whisker_trial' THEN trial_id END) OVER (PARTITION BY session_id) AS rebased FROM tr", "tr")
def _(d: Data) -> DataFrame:
    first = F.min(F.when(F.col("trial_type") == "whisker_trial", F.col("trial_id"))).over(by("session_id"))
    return d.trial_rows().select("session_id", "trial_id", (F.col("trial_id") - first).alias("rebased"))


_L = "l AS (SELECT mouse_id, min(inflection_trial) AS lt FROM neuron_results WHERE mouse_id IS NOT NULL GROUP BY 1)"
_REL = f"WITH {_L}, x AS (SELECT tr.*, l.lt, row_number() OVER {TYP} - 1 AS k FROM tr LEFT JOIN l USING (mouse_id)) "


def learning(d: Data) -> DataFrame:
    return d.neuron_results.where("mouse_id is not null").groupBy("mouse_id").agg(F.min("inflection_trial").alias("lt"))


def relative(d: Data) -> DataFrame:
    return d.trial_rows().join(learning(d), "mouse_id", "left").withColumn("k", F.row_number().over(typ()) - 1)


@book("win_rel_index", _REL + "SELECT session_id, trial_id, k - lt AS rel FROM x", "tr")
def _(d: Data) -> DataFrame:
    return relative(d).select("session_id", "trial_id", (F.col("k") - F.col("lt")).alias("rel"))


@book("win_block_label", _REL + ", b AS (SELECT *, CAST(floor((k - lt) / 3.0) AS BIGINT) AS b FROM x) SELECT session_id, trial_id, greatest(b * 3, min(k - lt) OVER g) || '..' || least(b * 3 + 2, max(k - lt) OVER g) AS label FROM b WINDOW g AS (PARTITION BY session_id, trial_type)", "tr")
def _(d: Data) -> DataFrame:
    g = by("session_id", "trial_type")
    x = relative(d).withColumn("r", F.col("k") - F.col("lt"))
    b = F.floor(F.col("r") / 3)
    lo, hi = F.greatest(b * 3, F.min("r").over(g)), F.least(b * 3 + 2, F.max("r").over(g))
    # a null learning trial has no label
    return x.select("session_id", "trial_id", F.when(F.col("lt").isNotNull(), F.concat(lo.cast("string"), F.lit(".."), hi.cast("string"))).alias("label"))


@book("win_lag_state", f"SELECT session_id, trial_id, lag(lick_flag) OVER {SEQ} AS prev_lick, last_value(CASE WHEN trial_type = 'whisker_trial' THEN lick_flag END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY at_us, trial_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_whisker FROM tr", "tr")
def _(d: Data) -> DataFrame:
    past = seq().rowsBetween(W.unboundedPreceding, -1)
    return d.trial_rows().select("session_id", "trial_id", F.lag("lick_flag").over(seq()).alias("prev_lick"), F.last(F.when(F.col("trial_type") == "whisker_trial", F.col("lick_flag")), ignorenulls=True).over(past).alias("last_whisker"))


_PAST = "OVER (PARTITION BY session_id ORDER BY at_us, trial_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@book("win_cum_prop", f"SELECT session_id, trial_id, round(sum(CASE WHEN trial_type = 'whisker_trial' THEN reward_available END) {_PAST} / nullif(count(CASE WHEN trial_type = 'whisker_trial' THEN reward_available END) {_PAST}, 0), 6) AS prop FROM tr", "tr")
def _(d: Data) -> DataFrame:
    past = seq().rowsBetween(W.unboundedPreceding, -1)
    x = F.when(F.col("trial_type") == "whisker_trial", F.col("reward_available"))
    return d.trial_rows().select("session_id", "trial_id", F.round(F.try_divide(F.sum(x).over(past).cast("double"), F.count(x).over(past).cast("double")), 6).alias("prop"))


@book("win_trailing5", "SELECT session_id, trial_id, round(avg(lick_flag) OVER (PARTITION BY session_id, trial_type ORDER BY at_us, trial_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS rate FROM tr", "tr")
def _(d: Data) -> DataFrame:
    return d.trial_rows().select("session_id", "trial_id", F.round(F.avg("lick_flag").over(typ().rowsBetween(-5, -1)), 6).alias("rate"))


@book("win_cum_reward", f"SELECT session_id, trial_id, round(sum(lick_flag * reward_available) OVER (PARTITION BY session_id ORDER BY at_us, trial_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / nullif(sum(lick_flag * reward_available) OVER (PARTITION BY session_id), 0), 6) AS cum FROM tr", "tr")
def _(d: Data) -> DataFrame:
    r = F.col("lick_flag") * F.col("reward_available")
    run, all_ = F.sum(r).over(seq().rowsBetween(W.unboundedPreceding, 0)), F.sum(r).over(by("session_id"))
    return d.trial_rows().select("session_id", "trial_id", F.round(F.try_divide(run.cast("double"), all_.cast("double")), 6).alias("cum"))


@book("win_scaled_index", f"SELECT session_id, trial_id, round((row_number() OVER {SEQ} - 1.0) / nullif(count(*) OVER (PARTITION BY session_id) - 1, 0), 6) AS x FROM tr", "tr")
def _(d: Data) -> DataFrame:
    n = F.count("*").over(by("session_id")) - 1
    return d.trial_rows().select("session_id", "trial_id", F.round(F.try_divide((F.row_number().over(seq()) - 1).cast("double"), n.cast("double")), 6).alias("x"))


@book("win_runs", f"WITH c AS (SELECT *, CASE WHEN lick_flag = lag(lick_flag) OVER {SEQ} THEN 0 ELSE 1 END AS ch FROM tr), r AS (SELECT *, sum(ch) OVER {SEQ} AS run FROM c) SELECT session_id, trial_id, CAST(run AS BIGINT) AS run_id, lick_flag = 1 AND count(*) OVER (PARTITION BY session_id, run) >= 3 AS in_run FROM r", "tr")
def _(d: Data) -> DataFrame:
    r = rel.runs(d.trial_rows(), ["session_id"], ORD, F.col("lick_flag") == 1, 3)
    return r.select("session_id", "trial_id", "run_id", "in_run")


@book("agg_perf_blocks", f"WITH b AS (SELECT *, (row_number() OVER {SEQ} - 1) // 5 AS block FROM tr) SELECT session_id, trial_id, block, round(avg(CASE WHEN trial_type = 'whisker_trial' THEN lick_flag END) OVER (PARTITION BY session_id, block), 6) AS hit_rate FROM b", "tr")
def _(d: Data) -> DataFrame:
    b = d.trial_rows().withColumn("block", F.floor((F.row_number().over(seq()) - 1) / 5))
    return b.select("session_id", "trial_id", "block", F.round(F.avg(F.when(F.col("trial_type") == "whisker_trial", F.col("lick_flag"))).over(by("session_id", "block")), 6).alias("hit_rate"))


_ISI = "i AS (SELECT session_id, unit_id, t_us, t_us - lag(t_us) OVER (PARTITION BY session_id, unit_id ORDER BY t_us) AS isi FROM sp)"


def isis(d: Data) -> DataFrame:
    w = by("session_id", "unit_id").orderBy("t_us")
    return d.spikes().withColumn("isi", F.col("t_us") - F.lag("t_us").over(w))


@book("win_isi", f"WITH {_ISI} SELECT session_id, unit_id, isi FROM i WHERE isi IS NOT NULL", "sp")
@book("cmp_isi", f"WITH {_ISI} SELECT session_id, unit_id, isi FROM i WHERE isi IS NOT NULL", "sp")
def _(d: Data) -> DataFrame:
    return isis(d).where("isi is not null").select("session_id", "unit_id", "isi")


_CV2 = f"WITH {_ISI}, c AS (SELECT *, lag(isi) OVER (PARTITION BY session_id, unit_id ORDER BY t_us, isi DESC NULLS FIRST) AS prev FROM i) "


@book("win_cv2", _CV2 + "SELECT session_id, unit_id, round(avg(2.0 * abs(isi - prev) / nullif(isi + prev, 0)), 5) AS cv2 FROM c WHERE prev IS NOT NULL GROUP BY 1, 2", "sp")
def _(d: Data) -> DataFrame:
    i = isis(d).withColumn("prev", F.lag("isi").over(by("session_id", "unit_id").orderBy("t_us", F.desc_nulls_first("isi")))).where("prev is not null")
    x = F.try_divide(2.0 * F.abs(F.col("isi") - F.col("prev")), F.nullif((F.col("isi") + F.col("prev")).cast("double"), F.lit(0.0)))
    return i.groupBy("session_id", "unit_id").agg(F.round(F.avg(x), 5).alias("cv2"))


@book("win_burst_decile", "WITH b AS (SELECT *, min(t_us) OVER w AS a, max(t_us) OVER w AS z FROM sp WINDOW w AS (PARTITION BY session_id, unit_id)), k AS (SELECT session_id, unit_id, least(CAST(floor((t_us - a) * 10.0 / (z - a)) AS BIGINT), 9) AS decile, count(*) AS n FROM b WHERE z > a GROUP BY 1, 2, 3) SELECT session_id, unit_id, max(n) AS peak FROM k GROUP BY 1, 2", "sp")
def _(d: Data) -> DataFrame:
    w = by("session_id", "unit_id")
    b = d.spikes().withColumn("a", F.min("t_us").over(w)).withColumn("z", F.max("t_us").over(w)).where("z > a")
    k = b.groupBy("session_id", "unit_id", F.least(F.floor((F.col("t_us") - F.col("a")) * 10.0 / (F.col("z") - F.col("a"))), F.lit(9)).alias("decile")).agg(F.count("*").alias("n"))
    return k.groupBy("session_id", "unit_id").agg(F.max("n").alias("peak"))


_NX = "WITH n AS (SELECT DISTINCT result_id, area, reward_group, CASE WHEN isnan(shift_magnitude) THEN NULL ELSE shift_magnitude END AS x FROM neuron_results) "


@book("win_tertile", _NX + ", q AS (SELECT area, quantile_cont(x, 1.0 / 3) AS a, quantile_cont(x, 2.0 / 3) AS b FROM n GROUP BY 1) SELECT result_id, CASE WHEN x IS NULL THEN NULL WHEN x <= a THEN 1 WHEN x <= b THEN 2 ELSE 3 END AS tertile FROM n LEFT JOIN q ON q.area IS NOT DISTINCT FROM n.area")
def _(d: Data) -> DataFrame:
    n = shifts(d)
    q = n.groupBy(F.col("area").alias("_a")).agg(F.percentile("x", F.lit(1.0 / 3)).alias("a"), F.percentile("x", F.lit(2.0 / 3)).alias("b"))
    t = F.when(F.col("x").isNull(), None).when(F.col("x") <= F.col("a"), 1).when(F.col("x") <= F.col("b"), 2).otherwise(3)
    return n.join(q, F.col("area").eqNullSafe(F.col("_a")), "left").select("result_id", t.alias("tertile"))


@book("win_quantile_bin", _NX + ", q AS (SELECT reward_group, " + ", ".join(f"quantile_cont(x, {i / 10}) AS q{i}" for i in range(1, 10)) + " FROM n GROUP BY 1) SELECT result_id, CASE WHEN x IS NULL THEN NULL ELSE " + " + ".join(f"CAST(x > q{i} AS INT)" for i in range(1, 10)) + " END AS bin FROM n JOIN q USING (reward_group)")
def _(d: Data) -> DataFrame:
    n = shifts(d)
    q = n.groupBy("reward_group").agg(F.percentile("x", F.array(*[F.lit(i / 10) for i in range(1, 10)])).alias("edges"))
    return n.join(q, "reward_group").select("result_id", F.when(F.col("x").isNotNull(), F.size(F.filter("edges", lambda e: e < F.col("x")))).alias("bin"))


QUERIES, ORACLE = book.queries, book.oracle
