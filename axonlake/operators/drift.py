"""Schemas that drift between the files of a source: one consistent table and a report of each change.

Every file gets a profile per field: JSON types, counts, and value sketches of bounded size (a numeric range with moments;
for text theta sketches, the smallest hashes, of the values and of their character shapes, which give sizes and overlaps of
sets of any size). Payloads are parsed and profiled in the JVM by plain aggregates with map-side combine, so a file or source
of any size costs one small row per field and task. Each file is compared with the file before it of the same source and
kind. Fields that left and fields that came are matched as a bipartite assignment (Hungarian method on the few fields of one
change) by value sketch, type and name similarity.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from axonlake.session import materialise

TYPES = ("null", "boolean", "integer", "number", "string", "array", "object")


#: log2 of the hashes a theta sketch keeps: sets up to this size are exact, larger ones to about one part in ten.
SKETCH = 7


def shape(text: Column) -> Column:
    """The character shape of a text: runs of digits, capitals and small letters become one mark each."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[0-9]+", "0"), "[A-Z]+", "A"), "[a-z]+", "a")


def _values(exports: DataFrame) -> DataFrame:
    """Every value of every payload: the file, the field's name, its JSON type (null for null), number and text."""
    o = exports.select("source_id", "kind", "file_id", "written_at", F.try_parse_json("payload").alias("_o")).where(F.schema_of_variant("_o").startswith("OBJECT"))
    e = o.lateralJoin(o.sparkSession.tvf.variant_explode(F.col("_o").outer()), how="inner").select("source_id", "kind", "file_id", "written_at", F.col("key").alias("field"), F.col("value").alias("_v"))
    t = F.regexp_extract(F.schema_of_variant("_v"), "^[A-Z]+", 0)
    whole = (t == "BIGINT") | F.schema_of_variant("_v").rlike(r"^DECIMAL\((19|[23]\d),0\)")  # beyond 64 bits a whole number is a decimal
    kind = F.when(t == "VOID", None).when(t == "STRING", "string").when(t == "BOOLEAN", "boolean").when(t == "ARRAY", "array").when(t == "OBJECT", "object").when(whole, "integer").otherwise("number")
    e = e.withColumn("_t", kind)
    number = F.when(F.col("_t").isin("integer", "number"), F.try_variant_get("_v", "$", "double")).when(F.col("_t") == "boolean", F.try_variant_get("_v", "$", "boolean").cast("double"))
    plain = F.to_json("_v")
    text = F.when(F.col("_t") == "string", F.try_variant_get("_v", "$", "string")).when(F.col("_t") == "object", F.concat_ws(",", F.array_sort(F.json_object_keys(plain)))).when(F.col("_t").isin("array", "boolean"), plain)
    return e.select("source_id", "kind", "file_id", "written_at", "field", "_t", number.alias("_n"), text.alias("_s"))


def profile_fields(exports: DataFrame) -> DataFrame:
    """One row per source, kind, file and field (a key of any row of the file), with its type and value sketches.

    ``json_type`` is the type of most of the field's values (on a tie the wider one), with integer and number together
    number; null if all values are null. Rows that are no JSON object (a repeated key or a NaN is none) hold no field.
    """
    v = _values(exports)
    y = F.asinh("_n")  # heavy tails: moments on a log-like scale
    p = v.groupBy("source_id", "kind", "file_id", "written_at", "field").agg(
        *[(F.count("*") - F.count("_t") if t == "null" else F.count_if(F.col("_t") == t)).alias(f"n_{t}") for t in TYPES],
        F.count("_n").alias("v_n"), F.coalesce(F.sum(y), F.lit(0.0)).alias("v_sum"), F.coalesce(F.sum(y * y), F.lit(0.0)).alias("v_sq"), F.min("_n").alias("v_min"), F.max("_n").alias("v_max"),
        F.theta_sketch_agg("_s", SKETCH).alias("words"), F.theta_sketch_agg(shape(F.col("_s")), SKETCH).alias("shapes"),
    )
    numbers = F.when(F.col("n_number") > 0, F.struct((F.col("n_integer") + F.col("n_number")).alias("n"), F.lit("number").alias("t"))).otherwise(F.struct(F.col("n_integer").alias("n"), F.lit("integer").alias("t")))
    others = [F.struct(F.col(f"n_{t}").alias("n"), F.lit(t).alias("t")) for t in ("string", "boolean", "array", "object")]
    best = F.array_max(F.array(numbers, *others))
    return p.withColumn("json_type", F.when(best["n"] > 0, best["t"]))


def _chunked_previous(rows: DataFrame, keys: list[str], order: list[str], chunk: str, value: str) -> DataFrame:
    """``rows`` with ``prev``: the last non-null ``value`` before each row, in ``order`` within ``keys``.

    Within a chunk of time by a window; across chunks by the chunks' own last values, so that a key with very many rows
    is cut into tasks of one chunk each.
    """
    inner = W.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    near = rows.withColumn("_near", F.last(value, ignorenulls=True).over(inner))
    last = rows.where(F.col(value).isNotNull()).groupBy(*keys, chunk).agg(F.max_by(value, F.struct(*order)).alias("_v"))
    spine = rows.select(*keys, chunk).distinct().join(last, [*keys, chunk], "left")
    carry = spine.withColumn("_carry", F.last("_v", ignorenulls=True).over(W.partitionBy(*keys).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1))).drop("_v")
    return near.join(carry, [*keys, chunk]).withColumn("prev", F.coalesce("_near", "_carry")).drop("_near", "_carry")


def name_similarity(a: str, b: str) -> float:
    """Dice coefficient of the letter pairs of two names, without case and separators."""
    clean = [re.sub(r"[^a-z0-9]", "", x.lower()) for x in (a, b)]
    if clean[0] == clean[1]:
        return 1.0
    pairs = [{x[i : i + 2] for i in range(len(x) - 1)} for x in clean]
    return 2 * len(pairs[0] & pairs[1]) / max(1, len(pairs[0]) + len(pairs[1]))


def _common(a: Column, b: Column, whole: bool) -> Column:
    """The common part of two sketched sets, of the smaller one, or (``whole``) the mean of that and of the part of their union."""
    size = F.theta_sketch_estimate
    both = size(F.theta_intersection(a, b))
    part = lambda of: F.coalesce(F.least(F.try_divide(both, of), F.lit(1.0)), F.lit(0.0))
    inner = part(F.least(size(a), size(b)))
    return (inner + part(size(F.theta_union(a, b)))) / 2 if whole else inner


def value_similarity(a: Column, b: Column) -> Column:
    """How alike the values of two fields (structs of ``_SKETCH``) are, from 0 to 1, by their sketches; 0 for different JSON types.

    The mean of two views: the values of the two files, which may be few, and those of all files in which the same kind
    of table has a field of that name and type.
    """
    tiny = 1e-9

    def moments(x: Column, of: str) -> tuple[Column, Column]:
        m = F.try_divide(x[of + "sum"], x[of + "n"])
        return m, F.sqrt(F.greatest(F.try_divide(x[of + "sq"], x[of + "n"]) - m * m, F.lit(0.0)))

    def spread(s: Column, t: Column) -> Column:
        return (F.least(s, t) + tiny) / (F.greatest(s, t) + tiny)

    lo, hi = F.greatest(a["v_min"], b["v_min"]), F.least(a["v_max"], b["v_max"])
    width = F.greatest(a["v_max"], b["v_max"]) - F.least(a["v_min"], b["v_min"])
    overlap = F.when(width == 0, 1.0).otherwise(F.greatest(hi - lo, F.lit(0.0)) / width)
    (m, s), (mm, ss) = moments(a, "v_"), moments(b, "v_")
    near = F.pow(overlap * F.exp(-F.abs(m - mm) / (1.5 * F.greatest(s, ss, F.lit(tiny)))) * spread(s, ss), F.lit(1 / 3))
    (m, s), (mm, ss) = moments(a, "p_"), moments(b, "p_")
    pooled = F.exp(-2 * F.abs(m - mm) / F.greatest(s, ss, F.lit(tiny))) * F.sqrt(spread(s, ss))
    numbers = F.coalesce(0.5 * near + 0.5 * pooled, F.lit(0.0))
    part = lambda of, whole: 0.5 * _common(a[of + "words"], b[of + "words"], whole) + 0.5 * _common(a[of + "shapes"], b[of + "shapes"], whole)
    texts = 0.5 * part("", False) + 0.5 * part("p_", True)
    same = a["json_type"].isNotNull() & (a["json_type"] == b["json_type"])
    return F.when(same & a["json_type"].isin("integer", "number"), numbers).when(same, texts).otherwise(0.0)


def assign(score: np.ndarray) -> list[tuple[int, int]]:
    """The assignment of rows to columns with the largest total score (Hungarian method with potentials)."""
    n, m = score.shape
    if n == 0 or m == 0:
        return []
    if n > m:
        return [(i, j) for j, i in assign(score.T)]
    cost = score.max() - score
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j = i, 0
        dist, way, done = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            done[j] = True
            row = match[j]
            free = ~done[1:]
            slack = cost[row - 1] - u[row] - v[1:]
            better = free & (slack < dist[1:])
            dist[1:][better], way[1:][better] = slack[better], j
            nxt = int(np.argmin(np.where(free, dist[1:], np.inf))) + 1
            delta = dist[nxt]
            u[match[done]] += delta
            v[done] -= delta
            dist[~done] -= delta
            j = nxt
            if match[j] == 0:
                break
        while j:
            match[j], j = match[way[j]], way[j]
    return [(match[j] - 1, j - 1) for j in range(1, m + 1) if match[j]]


_POOL = {"p_n": "v_n", "p_sum": "v_sum", "p_sq": "v_sq", "p_words": "words", "p_shapes": "shapes"}
_SKETCH = ["json_type", "v_n", "v_sum", "v_sq", "v_min", "v_max", "words", "shapes", *_POOL]


def match_fields(gone: list[str], came: list[str], alike: np.ndarray, least: float = 0.5, name_weight: float = 0.3) -> list[tuple[int, int]]:
    """Pairs (gone, came) of the best assignment whose values are of one kind.

    ``alike`` holds the value similarities. The score is value similarity plus a smaller part of name similarity; a pair counts
    as one kind if its types agree and value similarity plus the name's part reaches ``least``.
    """
    if not len(gone) or not len(came):
        return []
    names = np.array([[name_similarity(g, c) for c in came] for g in gone])
    score = np.where(alike > 0, alike + name_weight * names, 0.0)
    return [(i, j) for i, j in assign(score) if score[i, j] >= least]


def _with_pool(p: DataFrame, salt: int = 16) -> DataFrame:
    """Profiles with the sketches of all files pooled by kind, name and type; the join is salted, as a name may be in every file."""
    by = ["kind", "field", "json_type"]
    pool = p.where(F.col("json_type").isNotNull()).groupBy(*by).agg(*[(F.theta_union_agg(c, SKETCH) if c in ("words", "shapes") else F.sum(c)).alias(k) for k, c in _POOL.items()])
    pool = pool.withColumn("_x", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    return p.withColumn("_x", F.pmod(F.xxhash64("file_id"), F.lit(salt)).cast("int")).join(pool, [*by, "_x"], "left").drop("_x")


def schema_changes(exports: DataFrame, least: float = 0.5, profiles: DataFrame | None = None) -> DataFrame:
    """(file_id, change, field_from, field_to): each file against the one before it of its source and kind.

    Files are in order of written_at, then file_id. ``removed`` and ``added`` leave the other name empty; ``renamed`` is a
    field that left and one that came with one JSON type and the same kind of values; ``retyped`` repeats the name. A field
    that is null throughout a file keeps its last known type and values; if none is known, it has no type and neither
    matches nor changes type. The first file of a source and kind reports nothing. Repeated rows and files delivered twice
    change nothing, as profiles only say what occurs. Names are case-sensitive. Rows without a file_id are left out. Empty
    input gives no rows. ``profiles``: those of ``exports``, if they are at hand.

    The payloads are parsed once; the profiles, a small part of them, are written to the shared folder.
    """
    if profiles is None:
        profiles = materialise(profile_fields(exports), "profiles")
    p = profiles.where(F.col("file_id").isNotNull()).withColumn("_m", F.date_trunc("month", "written_at"))
    key, order = ["source_id", "kind"], ["written_at", "file_id"]
    null_safe = {c: F.coalesce(F.col(c), F.lit("\u0000")) for c in key}
    p = p.withColumns(null_safe)
    p = _with_pool(p)
    known = p.withColumn("_sk", F.when(F.col("json_type").isNotNull(), F.struct(*_SKETCH)))
    # a field's last known type and values come from all earlier files, also from before it was absent for a while
    known = _chunked_previous(known, [*key, "field"], order, "_m", "_sk").withColumn("_sk", F.coalesce("_sk", "prev"))
    # the fields of each file: bounded by the width of one file
    files = known.groupBy(*key, "_m", *order).agg(F.array_sort(F.collect_list(F.struct("field", "_sk"))).alias("fields"))
    pairs = _chunked_previous(files, key, order, "_m", "fields").where(F.col("prev").isNotNull())
    names = lambda c: F.transform(c, lambda x: x["field"])
    changed = ~names("fields").eqNullSafe(names("prev")) | ~F.transform("fields", lambda x: x["_sk"]["json_type"]).eqNullSafe(F.transform("prev", lambda x: x["_sk"]["json_type"]))
    # what left, what came, and how alike their values are: in the JVM, on the few fields of one change
    here = lambda old, new: F.filter(old, lambda x: ~F.array_contains(F.transform(new, lambda y: y["field"]), x["field"]))
    moved = pairs.where(changed).withColumn("_gone", here(F.col("prev"), F.col("fields"))).withColumn("_came", here(F.col("fields"), F.col("prev")))
    alike = F.flatten(F.transform("_gone", lambda g: F.transform("_came", lambda c: value_similarity(g["_sk"], c["_sk"]))))
    kind_of = lambda x: x["_sk"]["json_type"]
    other = F.filter("fields", lambda x: F.exists("prev", lambda y: (y["field"] == x["field"]) & kind_of(x).isNotNull() & kind_of(y).isNotNull() & (kind_of(x) != kind_of(y))))
    slim = moved.select("file_id", names("_gone").alias("gone"), names("_came").alias("came"), alike.alias("alike"), names(other).alias("retyped"))

    def compare(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for fid, gone, came, scores, retyped in zip(pdf["file_id"], pdf["gone"], pdf["came"], pdf["alike"], pdf["retyped"]):
                pairs_ = match_fields(gone, came, np.asarray(scores, float).reshape(len(gone), len(came)), least)
                a, b = {i for i, _ in pairs_}, {j for _, j in pairs_}
                out += [(fid, "renamed", gone[i], came[j]) for i, j in pairs_]
                out += [(fid, "removed", g, "") for i, g in enumerate(gone) if i not in a]
                out += [(fid, "added", "", c) for j, c in enumerate(came) if j not in b]
                out += [(fid, "retyped", k, k) for k in retyped]
            yield pd.DataFrame(out, columns=["file_id", "change", "field_from", "field_to"])

    return slim.mapInPandas(compare, "file_id long, change string, field_from string, field_to string")


def canonical_names(changes: DataFrame, profiles: DataFrame, kind_of: DataFrame) -> DataFrame:
    """(kind, field, canonical): one name per chain of renames, the one found in most files (the first by name on a tie).

    Renames are distinct pairs of names, a table of the schema's size. Labels spread along them and jump (a name takes the label
    of its label), so a chain of any length settles in about as many rounds as its length has binary digits; each round is written to the
    shared folder, and the rounds end when nothing moves.
    """
    pairs = changes.where("change = 'renamed'").join(kind_of, "file_id").select("kind", F.col("field_from").alias("a"), F.col("field_to").alias("b")).distinct()
    both = pairs.unionByName(pairs.select("kind", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    names = profiles.groupBy("kind", "field").agg(F.count("*").alias("n")).withColumn("best", F.struct((-F.col("n")).alias("n"), F.col("field").alias("name"))).drop("n")
    both, state = materialise(both, "renames"), materialise(names, "names")
    while True:
        heard = both.join(state.select("kind", F.col("field").alias("b"), "best"), ["kind", "b"]).groupBy("kind", F.col("a").alias("field")).agg(F.min("best").alias("heard"))
        new = state.join(heard, ["kind", "field"], "left").withColumn("near", F.least("best", F.coalesce("heard", "best")))
        labels = state.select("kind", F.col("field").alias("_f"), F.col("best").alias("_far"))
        new = new.join(labels, (new["kind"] == labels["kind"]) & (F.col("near.name") == F.col("_f")), "left").select(new["kind"], "field", "best", F.least("near", F.coalesce("_far", "near")).alias("new"))
        new = materialise(new, "names")
        state = new.select("kind", "field", F.col("new").alias("best"))
        if not new.where("new <> best").take(1):
            break
    return state.select("kind", "field", F.col("best.name").alias("canonical"))


def unify(exports: DataFrame) -> DataFrame:
    """All exports as one consistent long table: source_id, kind, file_id, written_at, row_no, field (canonical), name (as exported), value (text).

    Renamed fields share the canonical name, whatever their JSON type; values are the JSON text without outer quotes, null
    stays null, so that no record is lost whatever its type was. Repeated rows count once.
    """
    kind_of = exports.select("file_id", "kind").distinct()
    profiles = materialise(profile_fields(exports), "profiles")
    names = canonical_names(materialise(schema_changes(exports, profiles=profiles), "changes"), profiles, kind_of)
    rows = exports.select("source_id", "kind", "file_id", "written_at", "row_no", "payload").distinct()
    v = F.explode(F.from_json("payload", "map<string,string>"))
    cells = rows.select("source_id", "kind", "file_id", "written_at", "row_no", v.alias("name", "value")).withColumn("_x", F.pmod(F.xxhash64("file_id", "row_no"), F.lit(16)).cast("int"))
    salted = names.withColumn("_x", F.explode(F.sequence(F.lit(0), F.lit(15)))).withColumnRenamed("field", "name")
    return cells.join(salted, ["kind", "name", "_x"], "left").select("source_id", "kind", "file_id", "written_at", "row_no", F.coalesce("canonical", "name").alias("field"), "name", "value")


def wide(unified: DataFrame, kind: str, fields: list[str]) -> DataFrame:
    """One row per exported row of a kind with the given canonical fields as columns (text; null if absent)."""
    u = unified.where(F.col("kind") == kind)
    return u.groupBy("source_id", "file_id", "written_at", "row_no").pivot("field", fields).agg(F.max("value"))
