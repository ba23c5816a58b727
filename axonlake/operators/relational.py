"""Relational pieces that analyses of event data keep needing: support filters, domains, audits, reshapes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def domain(df: DataFrame, *column_sets: list[str]) -> DataFrame:
    """The product of the distinct values of each column set: a spine of labels, not of rows.

    The first set may be large; each further one is a set of labels (areas, directions, analyses) that is gathered into one
    array and unfolded beside every row, so no join is needed. Rows with a null label are left out.
    """
    out = df.select(*column_sets[0]).dropna().distinct()
    for c in column_sets[1:]:
        labels = df.select(*c).dropna().agg(F.collect_set(F.struct(*c))).scalar()
        out = out.withColumn("_l", labels).withColumn("_l", F.explode("_l")).select(*out.columns, *[F.col(f"_l.{x}").alias(x) for x in c])
    return out


def fill_domain(df: DataFrame, spine: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """``df`` over the whole ``spine``, absent combinations as 0."""
    out = spine.join(df, keys, "left")
    return out.withColumns({v: F.coalesce(v, F.lit(0)) for v in values})


def outer_audit(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_left, n_right, side (both, left_only, right_only): one row per key of either side, with its multiplicity."""
    a = left.groupBy(*keys).agg(F.count("*").alias("n_left"))
    b = right.groupBy(*keys).agg(F.count("*").alias("n_right"))
    j = a.join(b, keys, "full_outer")
    side = F.when(F.col("n_right").isNull(), "left_only").when(F.col("n_left").isNull(), "right_only").otherwise("both")
    return j.withColumn("side", side).withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_left", "n_right")})


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """A join that fails when the right side holds a key twice."""
    n = F.count("*").over(W.partitionBy(*keys))
    checked = right.withColumn("_ok", F.assert_true(n == 1, F.lit("the right side of a one-to-one join repeats a key"))).where(F.col("_ok").isNull()).drop("_ok")
    return left.join(checked, keys, how)


def supported(df: DataFrame, keys: list[str], checks: dict[str, int], rows: int = 0) -> DataFrame:
    """Rows of ``df`` whose group has at least ``rows`` rows and the given number of distinct values per column."""
    cond = F.count("*") >= rows
    for c, n in checks.items():
        cond = cond & (F.count_distinct(c) >= n)
    good = df.groupBy(*keys).agg(cond.alias("_ok")).where("_ok").select(*keys)
    return df.join(good, keys, "left_semi")


def shared(df: DataFrame, key: str, group: str, entity: str, at_least: int, groups: list) -> DataFrame:
    """The values of ``key`` with at least ``at_least`` distinct entities in every one of ``groups``."""
    cond = reduce(lambda a, b: a & b, [F.count_distinct(F.when(F.col(group) == g, F.col(entity))) >= at_least for g in groups])
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(cond.alias("_ok")).where("_ok").select(key)


def pairs(df: DataFrame, within: list[str], item: str, same: list[str] | None = None, different: list[str] | None = None, repeated: bool = False) -> DataFrame:
    """Unordered pairs of items of one ``within`` (id_a < id_b, or <= if ``repeated``), optionally with equal or different columns.

    This is an output of pair size: use it where every pair is a result row.
    """
    cols = [*within, item, *(same or []), *(different or [])]
    d = df.select(*dict.fromkeys(cols)).distinct()
    a, b = d.alias("a"), d.alias("b")
    cond = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in within] + [F.col(f"a.{item}") <= F.col(f"b.{item}") if repeated else F.col(f"a.{item}") < F.col(f"b.{item}")]
    cond += [F.col(f"a.{c}") == F.col(f"b.{c}") for c in same or []] + [F.col(f"a.{c}") != F.col(f"b.{c}") for c in different or []]
    extra = [F.col(f"{s}.{c}").alias(f"{c}_{s}") for c in [*(same or []), *(different or [])] for s in "ab"]
    return a.join(b, cond).select(*[F.col(f"a.{c}") for c in within], F.col(f"a.{item}").alias("id_a"), F.col(f"b.{item}").alias("id_b"), *extra)


def mirror(df: DataFrame, a: str, b: str, diagonal: bool = True) -> DataFrame:
    """A pair table with (b, a) added to every (a, b); pairs of an item with itself once."""
    back = df.where(F.col(a) != F.col(b)).select(*[F.col(b).alias(a) if c == a else F.col(a).alias(b) if c == b else F.col(c) for c in df.columns])
    return (df if diagonal else df.where(F.col(a) != F.col(b))).unionByName(back)


def flip_negative(df: DataFrame, lag: str, swaps: list[tuple[str, str]]) -> DataFrame:
    """Edges with a negative lag turned round: the lag's sign and each pair of columns swap."""
    neg = F.col(lag) < 0
    new = {lag: F.abs(lag)}
    for x, y in swaps:
        new |= {x: F.when(neg, F.col(y)).otherwise(F.col(x)), y: F.when(neg, F.col(x)).otherwise(F.col(y))}
    return df.withColumns(new)


def lookup(df: DataFrame, key: str, parent: str, table: DataFrame, table_key: str, value: str) -> DataFrame:
    """``value`` by the key, else by the parent key."""
    own = table.select(F.col(table_key).alias("_k1"), F.col(value).alias("_v1"))
    up = table.select(F.col(table_key).alias("_k2"), F.col(value).alias("_v2"))
    j = df.join(own, F.col(key) == F.col("_k1"), "left").join(up, F.col(parent) == F.col("_k2"), "left")
    return j.withColumn(value, F.coalesce("_v1", "_v2")).drop("_k1", "_k2", "_v1", "_v2")


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows: a bounded sort, never a full one. Give a unique last key."""
    return df.orderBy(*order).limit(n)


def top_per(df: DataFrame, by: list[str], n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows per group; Catalyst prunes before the shuffle."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def order_rank(c: Column, order: list[str]) -> Column:
    """The place in a canonical order; unknown values come after all known ones."""
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in order]), c), F.lit(0)), F.lit(len(order) + 1))


def fold_of(key: Column, k: int, seed: int = 0) -> Column:
    """A fold 0..k-1 that depends on the key alone, by an arithmetic hash that any engine can repeat."""
    return F.pmod(F.pmod(key * 7919 + seed * 104729 + 12345, F.lit(1000003)), F.lit(k))


def runs(df: DataFrame, by: list[str], order: list[str], flag: Column, at_least: int) -> DataFrame:
    """Rows with ``run_id`` and ``in_run``: whether they are in at least ``at_least`` consecutive rows for which ``flag`` holds."""
    w = W.partitionBy(*by).orderBy(*order)
    f = F.coalesce(flag, F.lit(False))
    x = df.withColumn("_f", f).withColumn("run_id", F.sum(F.when(F.col("_f") == F.lag("_f").over(w), 0).otherwise(1)).over(w))
    return x.withColumn("in_run", F.col("_f") & (F.count("*").over(W.partitionBy(*by, "run_id")) >= at_least)).drop("_f")
