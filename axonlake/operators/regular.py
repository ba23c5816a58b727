"""Irregular readings onto a regular grid, with the cells without data filled or marked.

Every grid time from a stream's first to its last cell with data gets a local linear fit, weighted by a compact kernel, of
the readings near it. Streams are cut into chunks of cells; a reading goes to its chunk and, near a border, also to the
neighbour, so chunks are evaluated independently and in any number of tasks. Within a chunk the readings are indexed by
their cell: each adds its moments to the few grid times in reach, in one streaming pass whose state is one chunk.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F


def gap_spans(cells: DataFrame, keys: list[str], cell: str = "cell", chunk: int = 4096) -> DataFrame:
    """keys..., _a, _z: the first and last cell of every gap between occupied cells of a stream (distinct rows keys..., cell).

    Within a piece of ``chunk`` cells the next occupied cell is a window over at most ``chunk`` rows; between pieces it
    comes from the pieces' own first and last cells, 1/``chunk`` of the rows at most.
    """
    c = cells.withColumn("_k", F.floor(F.col(cell) / F.lit(chunk)))
    inner = W.partitionBy(*keys, "_k").orderBy(cell)
    near = c.withColumn("_next", F.lead(cell).over(inner)).where(F.col("_next") > F.col(cell) + 1).select(*keys, (F.col(cell) + 1).alias("_a"), (F.col("_next") - 1).alias("_z"))
    pieces = c.groupBy(*keys, "_k").agg(F.min(cell).alias("_lo"), F.max(cell).alias("_hi"))
    outer = W.partitionBy(*keys).orderBy("_k")
    far = pieces.withColumn("_next", F.lead("_lo").over(outer)).where(F.col("_next") > F.col("_hi") + 1).select(*keys, (F.col("_hi") + 1).alias("_a"), (F.col("_next") - 1).alias("_z"))
    return near.unionByName(far)


def span_cells(spans: DataFrame, keys: list[str], cell: str = "cell", chunk: int = 4096) -> DataFrame:
    """Every cell of every span. A long span is cut into pieces first, so that no row holds a long array."""
    cut = spans.withColumn("_s", F.explode(F.sequence("_a", "_z", F.lit(chunk)))).withColumn("_e", F.least(F.col("_s") + (chunk - 1), F.col("_z")))
    return cut.select(*keys, F.explode(F.sequence("_s", "_e")).alias(cell))


def gaps(cells: DataFrame, keys: list[str], cell: str = "cell", chunk: int = 4096) -> DataFrame:
    """The cells between the first and last of each stream that are not in ``cells``."""
    return span_cells(gap_spans(cells, keys, cell, chunk), keys, cell, chunk)


def _fresh(t: np.ndarray, v: np.ndarray, ids: pa.Array, group: np.ndarray) -> np.ndarray:
    """False where a row repeats the one before it (same group, time, id and value)."""
    out = np.ones(len(t), bool)
    a, b = ids.slice(1), ids.slice(0, max(0, len(ids) - 1))
    same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
    out[1:] = ~((t[1:] == t[:-1]) & (v[1:] == v[:-1]) & (group[1:] == group[:-1]) & same)
    return out


def _evaluator(keys: list[str], step: float, radius: float, least_support: float, once: bool, marks: int = 512):
    """The streaming pass over rows sorted by chunk: each chunk's mark (its cells _a.._z), then its readings by time."""
    reach = math.ceil(radius + 0.5) - 1

    def finish(table: pa.Table, at: np.ndarray, a: np.ndarray, size: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        n, s0, s1, s2, t0, t1, q = sums
        first = np.cumsum(size) - size
        cell = np.arange(len(n)) - np.repeat(first - a, size)
        with np.errstate(divide="ignore", invalid="ignore"):
            det = s0 * s2 - s1 * s1
            value = np.where(det > 1e-3 * s0 * s0, (s2 * t0 - s1 * t1) / det, t0 / s0)
            support = np.where(q > 0, s0 * s0 / q, 0.0)
        status = np.where(n > 0, "observed", np.where(support >= least_support, "filled", "missing"))
        owner = pa.array(np.repeat(at, size))
        cols = [table[k].combine_chunks().take(owner) for k in keys]
        cols += [pa.array(cell, pa.int64()), pa.array(n.astype(np.int64)), pa.array(value, mask=status == "missing"), pa.array(support), pa.array(status.tolist(), pa.string())]
        return pa.RecordBatch.from_arrays(cols, names=[*keys, "cell", "n", "value", "support", "status"])

    def evaluate(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the open chunk: its mark, its sums and its last reading
        for batch in it:
            where = np.flatnonzero(batch.column("_m").to_numpy() == 0)
            cuts = [0, *where[marks::marks].tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi == lo:
                    continue
                rows = [batch.slice(lo, hi - lo)]
                table = pa.Table.from_batches(held[:2] + rows if held and held[1] is not None else held[:1] + rows if held else rows)
                get = lambda c: table[c].combine_chunks().to_numpy()
                mark = get("_m") == 0
                at = np.flatnonzero(mark)
                a, z = get("_a")[at], get("_z")[at]
                size = np.maximum(z - a + 1, 0)
                off = np.cumsum(size) - size
                total = int(size.sum())
                sums = np.zeros((7, total))
                g = np.cumsum(mark) - 1
                own = ~mark
                t, v = get("_t"), get("_v")
                if once:
                    own &= _fresh(t, v, table["_id"].combine_chunks(), g)
                if held:
                    sums[:, : size[0]] = held[2]
                    own[: 1 + (held[1] is not None)] = False  # the last reading is there for comparison only
                t, v, w0, c, g = t[own], v[own], get("_w")[own], get("_a")[own], g[own]
                x = t / step
                for o in range(-reach, reach + 1):
                    u, cell = x - (c + o + 0.5), c + o
                    ok = (np.abs(u) < radius) & (cell >= a[g]) & (cell <= z[g])
                    u, y = u[ok], v[ok]
                    # a tricube, kept off zero at its edge so that a cell's own readings always count
                    w = ((1 - (np.abs(u) / radius) ** 3) ** 3 + 1e-6) * w0[ok]
                    i = off[g[ok]] + cell[ok] - a[g[ok]]
                    for m, f in enumerate((np.full(len(u), float(o == 0)), w, w * u, w * u * u, w * y, w * u * y, w * w)):
                        sums[m] += np.bincount(i, weights=f, minlength=total)
                done = total - int(size[-1])
                if done:
                    yield finish(table, at[:-1], a[:-1], size[:-1], sums[:, :done])
                flat = table.combine_chunks().to_batches()[0]
                last = len(mark) - 1
                held = [flat.slice(int(at[-1]), 1), flat.slice(last, 1) if not mark[last] else None, sums[:, done:].copy()]
        if held and held[2].shape[1]:
            one = pa.Table.from_batches(held[:1])
            yield finish(one, np.zeros(1, int), one["_a"].to_numpy(), np.array([held[2].shape[1]]), held[2])

    return evaluate


def regular_grid(
    readings: DataFrame,
    keys: list[str],
    t: str = "t",
    value: str = "value",
    step: float = 0.25,
    radius: float = 1.5,
    least_support: float = 1.5,
    weight: str | None = None,
    reading_id: str | None = None,
    chunk: int = 1024,
) -> DataFrame:
    """keys..., cell, t_center, n, value, support, status for every cell from a stream's first to its last with data.

    ``radius`` (in cells) is the reach of the tricube kernel. ``n`` counts the readings of the cell itself, ``support`` is
    the effective number of readings in the fit (squared sum of weights over the sum of squares). ``status`` is ``observed``
    (n > 0), ``filled`` (no own reading, but the support reaches ``least_support``) or ``missing`` (value null).

    Readings with a null or NaN time or value are no data. With ``reading_id`` repeated rows count once. A null key is a
    stream of its own. With one distinct time in reach, or too little spread, the fit is the weighted mean. Empty input
    gives no rows. ``weight``: a column of positive reading weights, 1 if absent.

    The readings are shuffled once, by stream and chunk of ``chunk`` cells. The table of chunks is small: its size follows
    from the time that a stream spans, not from its readings.
    """
    inner = [f"_k{i}" for i in range(len(keys))]
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c))
    cols = [F.col(k).alias(a) for k, a in zip(keys, inner)] + [F.col(t).cast("double").alias("_t"), F.col(value).cast("double").alias("_v"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("_w")]
    cols.append((F.col(reading_id) if reading_id else F.lit(0)).alias("_id"))
    base = readings.select(*cols).where(fine("_t") & fine("_v")).withColumn("_a", F.floor(F.col("_t") / F.lit(step)))
    pieces = base.groupBy(*inner, F.floor(F.col("_a") / F.lit(chunk)).alias("_c")).agg(F.min("_a").alias("_lo"), F.max("_a").alias("_hi"))
    stream = W.partitionBy(*inner)
    along = stream.orderBy("_c")
    # a chunk answers for the chunks without data behind it; one before the first and one after the last take what only reaches there
    begin = F.when(F.lag("_c").over(along).isNull(), F.col("_c") - 1).otherwise(F.col("_c"))
    end = F.coalesce(F.lead("_c").over(along) - 1, F.col("_c") + 1)
    spans = pieces.select(*inner, begin.alias("_b"), end.alias("_e"), F.min("_lo").over(stream).alias("_lo"), F.max("_hi").over(stream).alias("_hi"))
    marks = spans.withColumn("_c", F.explode(F.sequence("_b", "_e"))).select(
        *inner, "_c", F.lit(0).alias("_m"), F.lit(0.0).alias("_t"), F.lit(0.0).alias("_v"), F.lit(0.0).alias("_w"), F.lit(None).cast(base.schema["_id"].dataType).alias("_id"),
        F.greatest(F.col("_c") * chunk, F.col("_lo")).alias("_a"), F.least((F.col("_c") + 1) * chunk - 1, F.col("_hi")).alias("_z"),
    )
    reach = math.ceil(radius + 0.5) - 1
    near = F.sequence(F.floor((F.col("_a") - reach) / F.lit(chunk)), F.floor((F.col("_a") + reach) / F.lit(chunk)))
    rows = base.withColumn("_c", F.explode(near)).select(*inner, "_c", F.lit(1).alias("_m"), "_t", "_v", "_w", "_id", "_a", F.lit(0).cast("long").alias("_z"))
    sorted_ = marks.unionByName(rows).repartition(*inner, "_c").sortWithinPartitions(*inner, "_c", "_m", "_t", "_id", "_v")
    schema = ", ".join(f"{a} {base.schema[a].dataType.simpleString()}" for a in inner) + ", cell long, n long, value double, support double, status string"
    out = sorted_.mapInArrow(_evaluator(inner, step, radius, least_support, reading_id is not None), schema)
    return out.select(*[F.col(a).alias(k) for a, k in zip(inner, keys)], "cell", ((F.col("cell") + 0.5) * step).alias("t_center"), "n", "value", "support", "status")


def event_rates(events: DataFrame, keys: list[str], t: str = "t", step: float = 1.0, **kw) -> DataFrame:
    """The grid of a point process: the reading of a cell is its number of events, at the cell's centre.

    Cells without events are no data (an interruption of the recording looks the same), so they are filled or marked.
    """
    fine = F.col(t).isNotNull() & ~F.isnan(F.col(t))
    cells = events.where(fine).groupBy(*keys, F.floor(F.col(t) / F.lit(step)).alias("_cell")).agg(F.count("*").cast("double").alias("_n"))
    return regular_grid(cells.withColumn("_mid", (F.col("_cell") + 0.5) * step), keys, "_mid", "_n", step, **kw)
