"""Correlograms of point processes and correlations of trial series, in long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from axonlake.functions import special


def lag_counts(spikes: DataFrame, keys: list[str], unit: str, edges: list[int], last: int, out: str, block: int = 128, most: int = 1_000_000, lo: int = 2, hi: int = 10, sds: float = 7.0, flank: int = 51) -> DataFrame:
    """Counts of the pairs of spikes of one key at most ``last`` apart, by lag bins that begin at ``edges`` (from 0 on). A spike is not paired with itself.

    out "half": keys, unit_a, unit_b, lag_bin, n: pairs with 0 <= t_b - t_a; spikes of two units at one time are a pair of each order,
    two of one unit a single pair. Bins without a pair have no row.
    out "both": the same with each pair also mirrored, (b, a) at -lag_bin; the zero bin holds both orders. Also n_a, n_b (spikes of each
    unit) and span_us (first to last spike of the key).
    out "list": keys, unit_a, unit_b, counts: the mirrored counts of all bins in order, for different units with any count.
    out "found": keys, unit_a, unit_b, lag_bin, peak, kind: what ``sparse_interactions`` says of each such pair, nulls where it says nothing.

    Pairs of spikes are never rows: units are cut into blocks of ``block`` units or ``most`` spikes (or one longer unit), a task holds
    two blocks and counts in chunks of half a million pairs. Null keys are left out; a null unit is a unit of its own.
    """
    u = spikes.where(F.col("t_us").isNotNull()).dropna(subset=keys).groupBy(*keys, unit).agg(F.collect_list("t_us").alias("_t"))
    g = W.partitionBy(*keys)
    weight = F.sum(F.greatest(F.lit(1.0 / block), F.size("_t") / most)).over(g.orderBy(unit).rowsBetween(W.unboundedPreceding, 0))
    u = u.withColumns({"_b": F.floor(weight - 1e-9).cast("int"), "_span": F.max(F.array_max("_t")).over(g) - F.min(F.array_min("_t")).over(g)})
    u = u.withColumn("_m", F.max("_b").over(g)).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_m"))))
    u = u.select(*keys, F.col(unit).alias("_u"), "_b", F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"), "_span", "_t")
    bins, width = len(edges), len(keys)

    def kernel(key, x):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        i, j = key[-2].as_py(), key[-1].as_py()
        side = [x.filter(pc.equal(x["_b"], k)) for k in ((i,) if i == j else (i, j))]
        ta, wa, na = _flat(side[0])
        tb, wb, nb = (ta, wa, na) if i == j else _flat(side[1])
        a, b = len(na), len(nb)
        ab = np.zeros(a * b * bins, np.int64)
        ba = ab if i == j else np.zeros(a * b * bins, np.int64)
        # within a block every pair is met once, from the earlier spike; between two blocks from the first
        first = np.arange(1, len(ta) + 1) if i == j else np.searchsorted(tb, ta - last, "left")
        for ia, ib in _pair_chunks(first, np.searchsorted(tb, ta + last, "right")):
            d, p, q = tb[ib] - ta[ia], wa[ia], wb[ib]
            at = np.searchsorted(edges, np.abs(d), "right") - 1
            f, r = (d >= 0), (d <= 0) & (p != q) if i == j else (d <= 0)
            ab += np.bincount(((p * b + q) * bins + at)[f], minlength=len(ab))
            ba += np.bincount(((q * a + p) * bins + at)[r], minlength=len(ba))
        ab, ba = ab.reshape(a, b, bins), ba.reshape(b, a, bins)
        ua, ub = side[0]["_u"].combine_chunks(), side[-1]["_u"].combine_chunks()
        if out == "half":
            found = [(ua, ub, na, nb, ab)] + ([] if i == j else [(ub, ua, nb, na, ba)])
        else:
            back = ba.transpose(1, 0, 2)
            c = np.concatenate([back[:, :, :0:-1], back[:, :, :1] + ab[:, :, :1], ab[:, :, 1:]], axis=2)
            found = [(ua, ub, na, nb, c)] + ([] if i == j else [(ub, ua, nb, na, c.transpose(1, 0, 2)[:, :, ::-1])])
        parts = []
        for n, (one, two, n1, n2, c) in enumerate(found):
            if out in ("half", "both"):
                p, q, k = np.nonzero(c)
                cols = [k - (0 if out == "half" else bins - 1), c[p, q, k]]
                if out == "both":
                    cols += [n1[p], n2[q], np.full(len(p), x["_span"][0].as_py(), np.int64)]
            else:
                some = c.any(axis=2)
                if i == j:
                    np.fill_diagonal(some, False)
                p, q = np.nonzero(some)
                c = c[p, q]
                cols = [pa.ListArray.from_arrays(np.arange(len(p) + 1, dtype=np.int32) * c.shape[1], c.ravel())] if out == "list" else _beyond(c, bins - 1, lo, hi, sds, flank)
            parts.append([*[pa.repeat(k, len(p)) for k in key[:width]], one.take(pa.array(p)), two.take(pa.array(q)), *[pa.array(v) if isinstance(v, np.ndarray) else v for v in cols]])
        return pa.concat_tables([pa.table(dict(zip(names, v))) for v in parts])

    types = {f.name: f.dataType.simpleString() for f in spikes.schema}
    value = {"half": "lag_bin long, n long", "both": "lag_bin long, n long, n_a long, n_b long, span_us long", "list": "counts array<long>", "found": "lag_bin long, peak long, kind string"}[out]
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], f"unit_a {types[unit]}, unit_b {types[unit]}", value])
    names = [*keys, "unit_a", "unit_b", *[v.split()[0] for v in value.split(", ")]]
    return u.groupBy(*keys, "_i", "_j").applyInArrow(kernel, schema)


def _flat(x):
    """Times of all trains of an Arrow table in order, the row of each, and the number of spikes of each row."""
    import numpy as np

    t = x["_t"].combine_chunks()
    n = np.diff(t.offsets.to_numpy())
    v, w = t.flatten().to_numpy(), np.repeat(np.arange(len(n)), n)
    o = np.argsort(v, kind="stable")
    return v[o], w[o], n.astype(np.int64)


def _pair_chunks(first, last, size: int = 500_000):
    """Index pairs (i, first[i]..last[i] - 1), at most ``size`` at a time or those of one i."""
    import numpy as np

    total = np.concatenate([[0], np.cumsum(last - first)])
    at = 0
    while at < len(first):
        to = max(at + 1, int(np.searchsorted(total, total[at] + size, "right")) - 1)
        k = (last - first)[at:to]
        yield np.repeat(np.arange(at, to), k), np.arange(total[to] - total[at]) - np.repeat(total[at:to] - total[at], k) + np.repeat(first[at:to], k)
        at = to


def _beyond(c, lags: int, lo: int, hi: int, sds: float, flank: int) -> list:
    """lag_bin, peak and kind of ``sparse_interactions`` for each row of bins -lags..lags; nulls where there is none."""
    import numpy as np
    import pyarrow as pa

    far = np.concatenate([c[:, : lags - flank + 1], c[:, lags + flank :]], axis=1).astype(float)
    m = far.sum(axis=1) / far.shape[1]
    s = np.sqrt(np.maximum((far * far).sum(axis=1) / far.shape[1] - m * m, 0.0))
    hit = np.abs(c[:, lags + lo : lags + hi + 1] - m[:, None]) > sds * s[:, None] + 1e-9
    k = hit.argmax(axis=1) + lo
    none = ~(hit.any(axis=1) & (s > 1e-9))
    peak = c[np.arange(len(c)), lags + k]
    return [pa.array(k, mask=none), pa.array(peak, mask=none), pa.array(np.where(peak > m, "excitatory", "inhibitory").astype(object), type=pa.string(), mask=none)]


def _bins(window: int, bin_: int) -> tuple[list[int], int]:
    """Edges of the bins that begin within ``window``, and the longest lag in them."""
    return list(range(0, window, bin_)), window - 1 if window % bin_ == 0 else window


def correlogram(spikes: DataFrame, keys: list[str], unit: str, window: int, bin_: int) -> DataFrame:
    """keys, unit_a, unit_b, lag_bin, n for all pairs of units with any count; lag bins floor(dt / bin), mirrored to negative lags.

    The pair (a, b) at lag bin k equals (b, a) at -k; the zero bin holds both orders, without a spike's pair with itself.
    """
    return lag_counts(spikes, keys, unit, *_bins(window, bin_), "both").select(*keys, "unit_a", "unit_b", "lag_bin", "n")


def autocorrelogram(spikes: DataFrame, by: list[str], window: int, bin_: int) -> DataFrame:
    """by, lag_bin, n: the ``correlogram`` of every ``by`` with itself. One row of spikes per ``by``, counted where it lies."""
    edges, last = _bins(window, bin_)
    u = spikes.where(F.col("t_us").isNotNull()).groupBy(*by).agg(F.collect_list("t_us").alias("_t"))

    def kernel(it):
        import numpy as np
        import pyarrow as pa

        for x in it:
            rows, lag, n = [], [], []
            for row, t in enumerate(x.column("_t")):
                v = np.sort(t.values.to_numpy())
                h = np.zeros(len(edges), np.int64)
                for i, j in _pair_chunks(np.arange(1, len(v) + 1), np.searchsorted(v, v + last, "right")):
                    h += np.bincount(np.searchsorted(edges, v[j] - v[i], "right") - 1, minlength=len(h))
                c = np.concatenate([h[:0:-1], 2 * h[:1], h[1:]])
                k = np.flatnonzero(c)
                rows.append(np.full(len(k), row))
                lag.append(k - len(edges) + 1)
                n.append(c[k])
            if rows:
                at = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([*[x.column(c).take(at) for c in by], pa.array(np.concatenate(lag)), pa.array(np.concatenate(n))], names=[*by, "lag_bin", "n"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spikes.select(*by).schema)
    return u.mapInArrow(kernel, f"{types}, lag_bin long, n long")


def normalise_ccg(ccg: DataFrame, bin_: int) -> DataFrame:
    """Counts of ``lag_counts`` ("both") with ``hertz`` (per spike of a and second) and ``pearson`` ((observed - expected) / root of expected)."""
    sec = bin_ / 1e6
    expected = F.col("n_a") * F.col("n_b") * sec / F.nullif(F.col("span_us") / 1e6, F.lit(0.0))
    hertz, pearson = F.col("n") / (F.col("n_a") * sec), F.try_divide(F.col("n") - expected, F.nullif(F.sqrt(expected), F.lit(0.0)))
    return ccg.withColumns({"hertz": hertz, "pearson": pearson}).drop("n_a", "n_b", "span_us")


def interactions(cch: DataFrame, by: list[str], lo: int = 2, hi: int = 10, sds: float = 7.0, flank: int = 50) -> DataFrame:
    """by, lag_bin, peak, kind: the first bin in lo..hi whose count leaves the flank's mean by ``sds`` of its population deviations.

    ``cch`` must hold every bin (zeros included). The flank is abs(lag_bin) >= ``flank``.
    """
    w = W.partitionBy(*by)
    out = F.abs("lag_bin") >= flank
    m, s = F.avg(F.when(out, F.col("n"))).over(w), F.stddev_pop(F.when(out, F.col("n"))).over(w)
    x = cch.withColumn("_m", m).withColumn("_s", s).where(F.col("lag_bin").between(lo, hi) & (F.abs(F.col("n") - F.col("_m")) > sds * F.col("_s")) & (F.col("_s") > 0))
    first = F.min_by(F.struct("lag_bin", "n", F.when(F.col("n") > F.col("_m"), "excitatory").otherwise("inhibitory").alias("kind")), "lag_bin")
    return x.groupBy(*by).agg(first.alias("f")).select(*by, "f.lag_bin", F.col("f.n").alias("peak"), "f.kind")


def sparse_interactions(ccg: DataFrame, by: list[str], lags: int, lo: int = 2, hi: int = 10, sds: float = 7.0, flank: int = 51) -> DataFrame:
    """``interactions`` from the counted bins alone: a bin of -lags..lags without a row is 0.

    The flank enters by its moments and only the bins lo..hi are looked at one by one, so no pair is spread over its bins. A count at
    the level itself, to 1e-9, is not beyond it.
    """
    size = 2.0 * (lags - flank + 1)
    n = F.col("n").cast("double")
    far = F.abs("lag_bin").between(flank, lags)
    near = F.when(F.col("lag_bin").between(lo, hi), F.struct(F.col("lag_bin").cast("int").alias("k"), n.alias("v")))
    g = ccg.groupBy(*by).agg((F.sum(F.when(far, n).otherwise(0.0)) / size).alias("_m"), (F.sum(F.when(far, n * n).otherwise(0.0)) / size).alias("_q"), F.map_from_entries(F.collect_list(near)).alias("_c"))
    g = g.withColumn("_s", F.sqrt(F.greatest(F.col("_q") - F.col("_m") * F.col("_m"), F.lit(0.0)))).where("_s > 1e-9")
    count = lambda k: F.coalesce(F.try_element_at("_c", k), F.lit(0.0))
    beyond = F.filter(F.sequence(F.lit(lo), F.lit(hi)), lambda k: F.abs(count(k) - F.col("_m")) > F.lit(sds) * F.col("_s") + 1e-9)
    x = g.withColumn("_k", F.try_element_at(beyond, F.lit(1))).where("_k is not null")
    return x.select(*by, F.col("_k").cast("long").alias("lag_bin"), count(F.col("_k")).cast("long").alias("peak"), F.when(count(F.col("_k")) > F.col("_m"), "excitatory").otherwise("inhibitory").alias("kind"))


def dithered(spikes: DataFrame, key: str, unit: str, out: str, lags: int = 100, bin_: int = 1_000, dither: int = 10_000, n: int = 50, lo: int = 2, hi: int = 10, sds: float = 7.0, flank: int = 51, block: int = 64) -> DataFrame:
    """Cross-correlograms against ``n`` surrogates in which the second unit's spikes are dithered by up to ``dither``.

    out "mean": key, unit_a, unit_b, lag_bin, jittered (mean count over the surrogates, both orders, bins above 0).
    out "found": key, unit_a, unit_b, lag_bin, peak, kind: the first bin in lo..hi whose count less the surrogates' mean
    leaves 0 by ``sds`` population deviations of that difference in the flank (abs(lag_bin) >= ``flank``), both orders. A
    flank without deviation gives no row.

    Of the units a < b, b is dithered, by a hash of key, unit, time and surrogate; (b, a) is the mirror image. Lag bins are
    those of ``correlogram``. A task holds the spikes of two blocks of ``block`` units and counts in bounded chunks.
    """
    u = spikes.groupBy(key, unit).agg(F.collect_list("t_us").alias("_t"))
    names = u.select(key, unit).withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(unit)) - 1).withColumn("_n", F.count("*").over(W.partitionBy(key)))
    u = u.join(names, [key, unit]).withColumn("_b", F.floor(F.col("_r") / block).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / block).cast("int"))))
    u = u.select(F.col(key).alias("_key"), F.col(unit).alias("_unit"), F.col("_r").cast("long").alias("_r"), "_b", F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"), "_t")
    width = 2 * (lags + dither // bin_ + 12) + 1
    mid, reach = width // 2, (lags + 1) * bin_ + dither

    def kernel(pdf):
        import zlib

        import numpy as np
        import pandas as pd

        i, j = pdf["_i"].iat[0], pdf["_j"].iat[0]
        a, b = pdf[pdf["_b"] == i].sort_values("_r"), pdf[pdf["_b"] == j].sort_values("_r")
        name = pdf["_key"].iat[0]

        def flat(x):
            t = np.concatenate([np.asarray(v, dtype=np.int64) for v in x["_t"]])
            w = np.repeat(np.arange(len(x)), [len(v) for v in x["_t"]])
            o = np.argsort(t, kind="stable")
            return t[o], w[o]

        (ta, wa), (tb, wb) = flat(a), flat(b)
        salt = np.array([zlib.crc32(f"{name}/{v}".encode()) for v in b["_unit"]], dtype=np.uint64)
        seed = (salt[wb] << np.uint64(32)) ^ tb.astype(np.uint64)

        def dithers(rep):
            z = seed + np.uint64(rep * 0x9E3779B97F4A7C15 % 2**64)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            return ((z ^ (z >> np.uint64(31))) % np.uint64(2 * dither + 1)).astype(np.int64) - dither

        first, last = np.searchsorted(tb, ta - reach, "left"), np.searchsorted(tb, ta + reach, "right")
        total = np.concatenate([[0], np.cumsum(last - first)])
        raw, jit = np.zeros((2, len(a) * len(b) * width))
        at = 0
        while at < len(ta):
            to = max(at + 1, int(np.searchsorted(total, total[at] + 500_000, "right")) - 1)
            k = (last - first)[at:to]
            ia = np.repeat(np.arange(at, to), k)
            ib = np.arange(total[to] - total[at]) - np.repeat(total[at:to] - total[at], k) + np.repeat(first[at:to], k)
            if i == j:
                keep = wa[ia] < wb[ib]
                ia, ib = ia[keep], ib[keep]
            dt, cell = tb[ib] - ta[ia], (wa[ia] * len(b) + wb[ib]) * width + mid
            # truncation to zero: a negative lag bin mirrors the positive one
            raw += np.bincount(cell + (dt / bin_).astype(np.int64), minlength=len(raw))
            for rep in range(1, n + 1):
                jit += np.bincount(cell + ((dt + dithers(rep)[ib]) / bin_).astype(np.int64), minlength=len(jit))
            at = to
        raw, jit = (x.reshape(-1, width)[:, mid - lags : mid + lags + 1] for x in (raw, jit / n))
        ua, ub = np.repeat(a["_unit"].to_numpy(), len(b)), np.tile(b["_unit"].to_numpy(), len(a))
        parts = []
        for x, y, c, m in ((ua, ub, raw, jit), (ub, ua, raw[:, ::-1], jit[:, ::-1])):
            if out == "mean":
                p, q = np.nonzero(m)
                parts.append(pd.DataFrame({key: name, "unit_a": x[p], "unit_b": y[p], "lag_bin": q - lags, "jittered": m[p, q]}))
                continue
            d = c - m
            s = np.concatenate([d[:, : lags - flank + 1], d[:, lags + flank :]], axis=1).std(axis=1)
            far = np.abs(d[:, lags + lo : lags + hi + 1]) > sds * s[:, None] + 1e-9
            p = np.nonzero(far.any(axis=1) & (s > 1e-9))[0]
            q = far[p].argmax(axis=1) + lo
            v = d[p, q + lags]
            parts.append(pd.DataFrame({key: name, "unit_a": x[p], "unit_b": y[p], "lag_bin": q, "peak": v, "kind": np.where(v > 0, "excitatory", "inhibitory")}))
        return pd.concat(parts, ignore_index=True)

    types = {f.name: f.dataType.simpleString() for f in spikes.schema}
    value = "jittered double" if out == "mean" else "peak double, kind string"
    return u.groupBy("_key", "_i", "_j").applyInPandas(kernel, f"{key} {types[key]}, unit_a {types[unit]}, unit_b {types[unit]}, lag_bin long, {value}")


def residuals(counts: DataFrame, condition: list[str], value: str) -> DataFrame:
    """``value`` minus its mean over the condition: what is left of a response when the stimulus is taken away."""
    return counts.withColumn("residual", F.col(value) - F.avg(value).over(W.partitionBy(*condition)))


def pair_correlations(counts: DataFrame, keys: list[str], unit: str, event: str, value: str, extra: Column | None = None) -> DataFrame:
    """Pearson r of the values of all unordered pairs of units of a key over common events: keys, unit_a, unit_b, n, r (null for a constant).

    Sums over joined events: the join is on (key, event), so its size is the number of pair-event values of the result.
    """
    a = counts.select(*keys, event, F.col(unit).alias("unit_a"), F.col(value).cast("double").alias("_x"))
    b = counts.select(*keys, event, F.col(unit).alias("unit_b"), F.col(value).cast("double").alias("_y"))
    j = a.join(b, [*keys, event]).where("unit_a < unit_b")
    g = j.groupBy(*keys, "unit_a", "unit_b").agg(F.count("*").alias("n"), special.corr("_x", "_y").alias("r"))
    return g.select(*keys, "unit_a", "unit_b", "n", "r")


def lag_correlation(series: DataFrame, by: list[str], index: str, x: str, y: str, max_lag: int) -> DataFrame:
    """Normalised cross-correlation of two series at lags -max..max: sum of z_x(i + lag) z_y(i) over N (biased); null for a constant.

    by, lag, r. Zero beyond the ends. One window pass: lagged copies, no self join.
    """
    g = W.partitionBy(*by)
    z = lambda c: F.try_divide(F.col(c) - F.avg(c).over(g), F.nullif(F.stddev_pop(c).over(g), F.lit(0.0)))
    s = series.select(*by, index, z(x).alias("_x"), z(y).alias("_y"), F.count("*").over(g).alias("_n"))
    w = W.partitionBy(*by).orderBy(index)
    at = lambda k: F.lead("_x", k).over(w) if k >= 0 else F.lag("_x", -k).over(w)
    prods = F.array(*[F.struct(F.lit(k).alias("lag"), (F.coalesce(at(k), F.lit(0.0)) * F.col("_y")).alias("p")) for k in range(-max_lag, max_lag + 1)])
    e = s.withColumn("_ps", prods).withColumn("_e", F.explode("_ps")).groupBy(*by, F.col("_e.lag").alias("lag")).agg((F.sum("_e.p") / F.max("_n")).alias("r"))
    return e


def autocorrelation(series: DataFrame, by: list[str], index: str, x: str, max_lag: int) -> DataFrame:
    """by, lag, r at lags 0..max of a series of whole numbers (biased, zero beyond the ends); null for a constant.

    Exact: both sums are whole numbers and are divided once at the end, so no order of summation can change a digit.
    """
    g, w = W.partitionBy(*by), W.partitionBy(*by).orderBy(index)
    v = F.col("_v")
    s = series.select(*by, index, F.col(x).cast("long").alias("_v"))
    s = s.withColumn("_n", F.count("*").over(g)).withColumn("_s", F.sum(v).over(g)).withColumn("_q", F.sum(v * v).over(g))
    d = F.col("_n") * v - F.col("_s")
    s = s.withColumn("_d", d)
    prods = F.array(*[F.struct(F.lit(k).alias("lag"), (F.coalesce(F.lead("_d", k).over(w), F.lit(0)) * F.col("_d")).alias("p")) for k in range(max_lag + 1)])
    e = s.withColumn("_p", prods).withColumn("_e", F.explode("_p")).groupBy(*by, F.col("_e.lag").alias("lag")).agg(F.sum("_e.p").alias("_t"), F.max("_n").alias("_n"), F.max("_s").alias("_s"), F.max("_q").alias("_q"))
    low = F.col("_n") * (F.col("_n") * F.col("_q") - F.col("_s") * F.col("_s"))
    return e.select(*by, "lag", F.try_divide(F.col("_t").cast("double"), F.nullif(low, F.lit(0)).cast("double")).alias("r"))
