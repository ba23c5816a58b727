"""Names and labels: areas and layers, probes, outcomes, literal text, coordinates, cell classes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Areas that are known by another name in the simplified atlas.
SIMPLE = {"SSp-bfd": "SSp-bfd", "SSp-m": "SSp", "SSp-ul": "SSp", "SSp-n": "SSp", "VISp": "VIS", "VISal": "VIS", "AUDp": "AUD", "AUDd": "AUD", "AUDv": "AUD", "TEa": "TEa", "VISa": "PPC", "VISrl": "PPC"}

LAYER = r"(?<=[a-zA-Z])(1|2/3|2|4|5|6a|6b|6)$"


def layer(acronym: Column) -> Column:
    """The cortical layer at the end of an acronym; null if there is none. Hippocampal fields (CA1...) have none."""
    x = F.regexp_extract(acronym, LAYER, 1)
    return F.when((x != "") & ~acronym.rlike("^CA[123]$"), x)


def layer_number(acronym: Column) -> Column:
    return F.regexp_extract(layer(acronym), r"^(\d)", 1).try_cast("int")


def without_layer(acronym: Column) -> Column:
    return F.when(layer(acronym).isNull(), acronym).otherwise(F.regexp_replace(acronym, LAYER, ""))


def layer_group(acronym: Column) -> Column:
    n = layer_number(acronym)
    return F.when(n.isNull(), "none").when(n <= 3, "superficial").when(n == 4, "granular").otherwise("deep")


def simplify(area: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in SIMPLE.items() for x in kv])
    return F.coalesce(F.try_element_at(m, area), area)


def probe_number(name: Column) -> Column:
    """The number of a probe, whatever its number of digits."""
    return F.regexp_extract(name, r"imec(\d+)", 1).try_cast("int")


def location_map(text: Column) -> Column:
    """A dictionary literal (single quotes, bare names) as a map; null if it is none. Never evaluated as code."""
    quoted = F.regexp_replace(F.regexp_replace(text, "'", '"'), r'([{,]\s*)([A-Za-z_]\w*)(\s*:)', r'$1"$2"$3')
    bare = F.regexp_replace(quoted, r'(:\s*)([A-Za-z_]\w*)(\s*[,}])', r'$1"$2"$3')
    return F.from_json(bare, "map<string,string>")


def parse_numbers(text: Column) -> Column:
    """The text of a numeric array (``[1 2. 3e-1]``, spaces or commas) as an array; what is no number becomes null."""
    body = F.trim(F.regexp_replace(F.regexp_replace(text, r"[\[\],\n]", " "), r"\s+", " "))
    return F.when(body == "", F.array().cast("array<double>")).otherwise(F.transform(F.split(body, " "), lambda x: x.try_cast("double")))


def quadrant(x: Column, y: Column, cut: Column | float = 0.05) -> Column:
    """Which of two p-values is below the cut: both, first, second or none."""
    a, b = x < cut, y < cut
    return F.when(a & b, "both").when(a, "first").when(b, "second").otherwise("none")


def direction_cosines(azimuth: Column, elevation: Column) -> list[Column]:
    a, e = F.radians(azimuth), F.radians(elevation)
    return [F.cos(e) * F.cos(a), F.cos(e) * F.sin(a), F.sin(e)]


def bregma(ap: Column, ml: Column, dv: Column, swapped: Column | None = None) -> list[Column]:
    """Atlas coordinates relative to bregma; for subjects in ``swapped`` the first two axes are exchanged."""
    #: Bregma in atlas coordinates (micrometres).
    x, y, z = F.lit(5400.0) - ap, ml - F.lit(5700.0), dv - F.lit(332.0)
    if swapped is None:
        return [x, y, z]
    return [F.when(swapped, y).otherwise(x), F.when(swapped, x).otherwise(y), z]


def first_box(ap: Column, ml: Column, dv: Column, boxes: list[tuple]) -> Column:
    """The name of the first box (name, lower and upper bounds of three axes) that holds a point."""
    out = F.lit("outside")
    for name, *b in reversed(boxes):
        inside = ap.between(b[0], b[1]) & ml.between(b[2], b[3]) & dv.between(b[4], b[5])
        out = F.when(inside, F.lit(name)).otherwise(out)
    return out


def cell_type(width: Column, area: Column, cut: float = 400.0, striatum: tuple[str, ...] = ("CP", "ACB", "OT")) -> Column:
    """Regular or fast spiking by waveform width; in the striatum projection neuron or interneuron."""
    narrow = width < cut
    return F.when(width.isNull() | F.isnan(width), None).when(area.isin(*striatum), F.when(narrow, "interneuron").otherwise("projection")).otherwise(F.when(narrow, "fsu").otherwise("rsu"))


def waveform_stats(w: Column) -> dict[str, Column]:
    """trough and peak positions and sizes, width (peak after trough minus trough), zero crossings of an array."""
    lo = F.array_min(w)
    at = F.array_position(w, lo).cast("int")
    n = F.size(w)
    after = F.slice(w, at, n - at + 1)
    hi = F.array_max(after)
    crossings = F.size(F.filter(F.zip_with(F.slice(w, 1, n - 1), F.slice(w, 2, n - 1), lambda a, b: a * b < 0), lambda x: x))
    ok = w.isNotNull() & (n > 1)
    named = {"trough": lo, "trough_at": at - 1, "peak": hi, "width": F.array_position(after, hi).cast("int") - 1, "amplitude": hi - lo, "crossings": crossings}
    return {k: F.when(ok, v) for k, v in named.items()}


def oddness(w: Column) -> Column:
    """A suspicion score in [0, 1] of a waveform: many zero crossings, small amplitude against its own spread, late trough."""
    s = waveform_stats(w)
    n = F.size(w)
    mean = F.aggregate(w, F.lit(0.0), lambda a, x: a + x) / n
    spread = F.sqrt(F.aggregate(w, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n)
    parts = F.least(s["crossings"] / 6.0, F.lit(1.0)) + F.least(F.try_divide(spread, s["amplitude"]), F.lit(1.0)) + s["trough_at"] / n
    return parts / 3.0
