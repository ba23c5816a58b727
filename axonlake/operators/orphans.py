"""References to parent records that do not exist, or did not exist at the time of the reference.

Keys are a text scope (a session, a mouse) and a whole number within it. Scopes are dictionary-encoded: each that has a parent
gets a whole number, written once, so that no text goes through the later shuffles; a reference to a scope that is not in the
dictionary is an orphan at once. The number is split into a word
(``n div 64``) and a bit, so that the set of keys of a scope and a period is a compressed bitmap: one 64-bit
word per occupied range, absent words being all zero. Per period, the parents that were valid through the
whole period form one bitmap and the references another; reference AND-NOT parent leaves the keys that may
be orphans. Only those are decoded and checked against the exact validity intervals.

Everything is a hash aggregate with map-side combine, except the exact check, whose joins carry a salt so that
a key that holds a third of all references is spread over ``salt`` tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from axonlake.session import materialise

WORD = 64


@dataclass(frozen=True)
class Reference:
    """A referring table: ``scope`` and ``number`` form the key, ``parent_scope`` and ``parent_number`` the columns it means."""

    name: str
    df: DataFrame
    row_id: str
    scope: str
    number: str
    at: str
    parent_scope: str
    parent_number: str


def _month(c: Column) -> Column:
    return (F.year(c) * 12 + F.month(c) - 1).cast("int")


def _word(c: Column) -> Column:
    return F.shiftright(c, 6)


def _bit(c: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), c.bitwiseAND(63).cast("int"))


def bitmap(df: DataFrame, by: list[str], number: str) -> DataFrame:
    """The compressed bitmap of ``number`` per ``by``: rows (by..., _w, _bits), one per occupied word."""
    n = F.col(number).cast("long")
    return df.withColumn("_w", _word(n)).groupBy(*by, "_w").agg(F.bit_or(_bit(n)).alias("_bits"))


def decode(words: DataFrame, bits: str = "_bits") -> DataFrame:
    """Rows of ``words`` once per set bit, with the number in ``_num``."""
    one = F.explode(F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.call_function("shiftright", F.col(bits), i).bitwiseAND(1) != 0))
    return words.withColumn("_i", one).withColumn("_num", F.col("_w") * WORD + F.col("_i")).drop("_i", bits, "_w")


def _collect(refs: list[Reference]) -> DataFrame:
    out = None
    for r in refs:
        one = r.df.select(
            F.lit(r.name).alias("ref_table"),
            F.lit(f"{r.parent_scope}.{r.parent_number}").alias("_space"),
            F.col(r.row_id).cast("long").alias("_row"),
            F.col(r.scope).alias("_scope"),
            F.col(r.number).cast("long").alias("_num"),
            F.col(r.at).cast("timestamp_ntz").alias("_at"),
        ).where(F.col("_num").isNotNull())
        out = one if out is None else out.unionByName(one)
    return out


def orphan_references(refs: list[Reference], parents: DataFrame, valid_from: str = "registered_at", valid_to: str = "deleted_at", salt: int = 8, broadcast_rows: int = 50_000) -> DataFrame:
    """All references without a valid parent: ref_table, row id, scope, number, at, period (months since year 0), state.

    A reference is valid if some parent row with its key has ``valid_from <= at`` and ``valid_to`` null or later than
    ``at``. ``state`` is ``unknown`` (the key is in no parent row), ``early`` (all parents are valid only later) or
    ``deleted``. A null number refers to nothing and is left out. A null scope or a null time matches no parent, so such
    rows are orphans. A parent with a null key or null ``valid_from`` never matches. Repeated rows are one result row.
    A reference without a time is ``deleted`` if its key has a parent. Other columns may have any name. Empty references give an
    empty result, empty parents make every reference an orphan. Calling this writes the dictionary and the surviving bits.
    """
    r = _collect(refs).withColumn("_p", _month(F.col("_at")))
    spaces = list(dict.fromkeys((x.parent_scope, x.parent_number) for x in refs))
    p = None
    for s, n in spaces:
        one = parents.select(F.lit(f"{s}.{n}").alias("_space"), F.col(s).alias("_scope"), F.col(n).cast("long").alias("_num"), F.col(valid_from).cast("timestamp_ntz").alias("_from"), F.col(valid_to).cast("timestamp_ntz").alias("_to"))
        p = one if p is None else p.unionByName(one)
    p = p.where(F.col("_scope").isNotNull() & F.col("_num").isNotNull() & F.col("_from").isNotNull())

    # the dictionary: one row per scope that has a parent
    codes = materialise(p.select("_space", "_scope").distinct().withColumn("_sid", F.monotonically_increasing_id()), "scopes")
    small = codes.count() <= broadcast_rows
    salts = F.explode(F.sequence(F.lit(0), F.lit(salt - 1)))

    def encode(df: DataFrame, how: str) -> DataFrame:
        if small:
            return df.join(F.broadcast(codes), ["_space", "_scope"], how)
        # a scope may hold a third of all rows
        salted = df.withColumn("_x", F.pmod(F.xxhash64("_num", "_scope"), F.lit(salt)).cast("int"))
        return salted.join(codes.withColumn("_x", salts).hint("merge"), ["_space", "_scope", "_x"], how).drop("_x")

    r = encode(r, "left")
    p = encode(p, "inner").select("_sid", "_num", "_from", "_to")

    # reference bitmaps: one word per key range and period. The table is left out: a key that is valid is so for all.
    known = F.col("_sid").isNotNull() & F.col("_p").isNotNull()
    ref_words = bitmap(r.where(known), ["_sid", "_p"], "_num")
    # parent bitmaps hold for a period only what was valid from before its first to after its last moment. Only periods that
    # some reference has can matter: their list is as long as there are different months, however far apart they lie.
    used = r.agg(F.array_sort(F.collect_set("_p"))).scalar()
    whole = p.withColumn("_used", used).withColumn("_p", F.explode(F.filter("_used", lambda m: (m > _month(F.col("_from"))) & (F.col("_to").isNull() | (m < _month(F.col("_to"))))))).drop("_used")
    parent_words = bitmap(whole, ["_sid", "_p"], "_num").withColumnRenamed("_bits", "_have")
    left = (
        ref_words.join(parent_words, ["_sid", "_p", "_w"], "left")
        .withColumn("_bits", F.col("_bits").bitwiseAND(F.bitwise_not(F.coalesce(F.col("_have"), F.lit(0).cast("long")))))
        .where("_bits <> 0")
        .drop("_have")
    )
    # few survive; written once, as both sides of the exact check start from them
    maybe = materialise(decode(left), "orphans")
    # the exact check of what survived: broadcast only if it is small by count, else a salted merge join. The choice is not
    # left to file sizes, as these rows compress to a small part of what they take in memory.
    key = ["_sid", "_num"]
    r = r.withColumn("_x", F.pmod(F.xxhash64("_row", "ref_table"), F.lit(salt)).cast("int"))
    if maybe.count() <= broadcast_rows:
        suspects = r.join(F.broadcast(maybe.select(*key, "_p")), [*key, "_p"], "left_semi")
    else:
        suspects = r.join(maybe.select(*key, "_p").withColumn("_x", salts).hint("merge"), [*key, "_p", "_x"], "left_semi")
    # bounds per key: all that the states need, one row per key whatever the number of parent rows
    maybe_keys = maybe.select(*key).distinct()
    near = p.join(maybe_keys.hint("merge"), key, "left_semi")
    bounds = near.groupBy(*key).agg(F.min("_from").alias("_first")).withColumn("_x", salts)
    intervals = near.select(*key, "_from", "_to").distinct().withColumn("_x", salts)
    s, i = suspects.alias("s"), intervals.alias("i")
    on = [F.col(f"s.{c}") == F.col(f"i.{c}") for c in [*key, "_x"]] + [F.col("i._from") <= F.col("s._at"), F.col("i._to").isNull() | (F.col("i._to") > F.col("s._at"))]
    bad = s.join(i, on, "left_anti").join(bounds, [*key, "_x"], "left")
    names = ["ref_table", "_row", "_scope", "_num", "_at", "_p"]
    state = F.when(F.col("_first").isNull(), "unknown").when(F.col("_first") > F.col("_at"), "early").otherwise("deleted")
    bad = bad.select(*names, state.alias("state"))
    # a scope without any parent, or a reference without a time
    lone = r.where(F.col("_sid").isNull()).select(*names, F.lit("unknown").alias("state"))
    untimed = r.where(F.col("_sid").isNotNull() & F.col("_p").isNull())
    keys = p.select(*key).distinct().withColumn("_x", salts)
    untimed = untimed.join(keys.withColumn("_there", F.lit(True)), [*key, "_x"], "left").select(*names, F.when(F.col("_there"), "deleted").otherwise("unknown").alias("state"))
    return bad.unionByName(lone).unionByName(untimed).distinct().toDF("ref_table", "result_id", "scope", "number", "at", "period", "state")


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Orphans per table, month and state."""
    month = F.make_date(F.floor(F.col("period") / 12).cast("int"), F.pmod(F.col("period"), F.lit(12)) + 1, F.lit(1))
    return orphans.groupBy("ref_table", month.alias("month"), "state").agg(F.count("*").alias("n_refs"), F.count_distinct("scope", "number").alias("n_keys"))
