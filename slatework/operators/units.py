"""Quantities recorded in different units, brought to metres and to whole storeys.

A row's own entry decides where it names a unit. For the other rows the unit is that
of the segment of its source's history: histories are binned by day, cut by an exact
penalised changepoint search on log values, and the level of every segment is
matched with the known factors. What the catalogue says enters the search: a cut at
an edge it names costs nothing, and its unit holds in a segment whose level doesn't
contradict it. No row gets a unit but from a segment or from its own entry.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slatework.functions import entries
from slatework.session import small, written

#: Penalty of a changepoint in units of variance x log(rows), and the rows a segment must have to overrule the catalogue.
PENALTY = 6.0
LEAST_ROWS = 30
#: A level overrules the catalogue when it is off by more than this on the log scale (half of ln 3.28 is 0.594).
OFF_LOG = 0.594
#: Factors that a level shift may stand for; a yard is too close to a metre to be told from it by level.
LEVEL_UNITS = ("m", "ft", "cm", "mm")
DAY_US = 86_400_000_000
#: A time before all others, for the piece of the catalogue ahead of its first edge.
EVER_US = -(1 << 60)
INPUTS = ["source", "captured_at", "height", "height_text", "numstories", "stories_text"]
RESULTS = ["height_m", "height_unit_used", "height_changed", "stories_total", "stories_basis_used", "stories_changed", "height_missing", "stories_missing"]


def changepoints(n: np.ndarray, mean: np.ndarray, square: np.ndarray, penalty: float, free: np.ndarray | None = None) -> list[int]:
    """Starts of the optimal segments of a binned series (pruned exact linear time).

    n, mean and square are rows, mean and mean of squares per bin. The cost of a
    segment is its within sum of squares over all rows; every segment costs
    ``penalty``, but those that start at a ``free`` bin cost nothing, and a tie goes to
    the cut there. The result is exact: the minimum over all segmentations. A start
    is pruned once it costs as much as the best segmentation with a cut at the end,
    which holds for penalties that differ by place.
    """
    if len(n) == 0:
        return []
    due = np.full(len(n) + 1, float(penalty))
    if free is not None:
        due[:-1][np.asarray(free, dtype=bool)] = -penalty / 1000  # a tie goes to the cut
    c0 = np.concatenate([[0], np.cumsum(n)])
    c1 = np.concatenate([[0.0], np.cumsum(n * mean)])
    c2 = np.concatenate([[0.0], np.cumsum(n * square)])
    best = np.full(len(n) + 1, np.inf)  # with the cost of a segment that starts there
    best[0] = 0.0
    prev = np.zeros(len(n) + 1, dtype=int)
    alive = np.array([0])
    for t in range(1, len(n) + 1):
        w = c0[t] - c0[alive]
        cost = best[alive] + (c2[t] - c2[alive]) - (c1[t] - c1[alive]) ** 2 / np.maximum(w, 1e-12)
        i = int(np.argmin(cost))
        best[t] = cost[i] + due[t]
        prev[t] = alive[i]
        alive = np.append(alive[cost < best[t]] if due[t] > 0 else alive[:0], t)
    starts, t = [], len(n)
    while t > 0:
        starts.append(int(prev[t]))
        t = prev[t]
    return starts[::-1]


def _decided(n: np.ndarray, mean: np.ndarray, square: np.ndarray, free: np.ndarray, told: list, logs: dict[str, float], centre: float, penalty: float):
    """(start bin, unit, rows, level) of the segments of one history; ``told`` has the catalogue's unit of each bin."""
    total = n.sum()
    mean, square = mean - centre, square - 2 * centre * mean + centre * centre  # logs relative to the centre, for precision
    if total:
        spread = max((n * square).sum() / total - ((n * mean).sum() / total) ** 2, 1e-6)
        # Noise level: within days, not over the shifts that are searched for.
        within = max((n * (square - mean**2)).sum() / max(total - len(n), 1.0), 1e-6) if total > len(n) + 10 else spread
        spread = min(spread, within)
    else:
        spread = 1.0
    starts = changepoints(n, mean, square, penalty * spread * math.log(max(total, 2.0)), free)
    for i, end in zip(starts, [*starts[1:], len(n)], strict=True):
        prior, unit, weight = told[i], told[i], n[i:end].sum()
        level = float((n[i:end] * mean[i:end]).sum() / weight) if weight else None
        if level is not None and (prior is None or prior in logs):
            nearest = min(logs, key=lambda u: abs(level + logs[u]))
            overruled = prior is not None and weight >= LEAST_ROWS and logs[nearest] != logs[prior] and abs(level + logs[prior]) > OFF_LOG
            if prior is None or overruled:
                unit = nearest
        yield i, unit, float(weight), level


PIECES = "source string, from_us long, until_us long, unit string, basis string, rows double, level double"


def _segments(centres: dict[str, float], penalty: float):
    """For the bins of a source: the pieces of its history with the unit of heights and the basis of storeys."""
    heights = {u: math.log(entries.METRES_IN[u]) for u in LEVEL_UNITS}
    # A storey more or less is no factor: counts without the ground floor lie at the level of those with it.
    storeys = {"storeys": 0.0, "above": 0.0, "tenths": math.log(0.1)}

    def run(bins: pd.DataFrame) -> pd.DataFrame:
        bins = bins.sort_values(["at", "edge"])
        at, edge = bins["at"].to_numpy(), bins["edge"].to_numpy()
        free = np.append(False, edge[1:] != edge[:-1])
        starts: dict[int, dict] = {}
        for kind, logs, told in (("h", heights, "unit"), ("s", storeys, "basis")):
            n, mean, square = (np.nan_to_num(bins[f"{kind}_{c}"].to_numpy(float)) for c in ("n", "mean", "square"))
            prior = [None if pd.isna(x) else x for x in bins[told]]
            for i, unit, weight, level in _decided(n, mean, square, free, prior, logs, centres[kind], penalty):
                starts.setdefault(i, {})[kind] = (unit, weight, level)
        rows, unit, basis = [], (None, 0.0, None), None
        order = sorted(starts)
        for i, after in zip(order, [*order[1:], None], strict=True):
            unit = starts[i].get("h", unit)
            basis = starts[i]["s"][0] if "s" in starts[i] else basis
            # A cut at an edge of the catalogue lies there to the microsecond, any other at the start of its day.
            rows.append((bins["source"].iloc[0], None if i == 0 else int(at[i]), None if after is None else int(at[after]), unit[0], basis, unit[1], unit[2]))
        return pd.DataFrame(rows, columns=["source", "from_us", "until_us", "unit", "basis", "rows", "level"])

    return run


def catalogue_pieces(catalogue: DataFrame) -> DataFrame:
    """(source, from_us, until_us, unit, basis) without overlaps, the note read where a unit is null.

    Every edge of a source starts a piece, and one reaches back for ever. Where
    intervals overlap the one that starts last holds; where none holds both are null.
    """
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    basis = F.coalesce("stories_basis", entries.note_stories_basis(F.col("note")))
    c = catalogue.where("source is not null").select(
        "source", F.coalesce(us("valid_from"), F.lit(EVER_US)).alias("f"), us("valid_until").alias("u"),
        F.coalesce(F.lower(F.trim("height_unit")), entries.note_height_unit(F.col("note"))).alias("unit"),
        F.when(basis.isin("above", "tenths"), basis).otherwise(F.lit("storeys")).alias("basis"),
    )
    # A catalogue has few intervals for each source.
    spans = c.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("f", "u", "unit", "basis")), asc=False).alias("s"), F.array_distinct(F.array_compact(F.flatten(F.collect_list(F.array("f", "u"))))).alias("e"))
    at = spans.select("source", "s", F.explode(F.array_union("e", F.array(F.lit(EVER_US)))).alias("from_us"))
    hit = F.try_element_at(F.filter("s", lambda x: (F.col("from_us") >= x.f) & (x.u.isNull() | (F.col("from_us") < x.u))), F.lit(1))
    return at.select("source", "from_us", F.lead("from_us").over(Window.partitionBy("source").orderBy("from_us")).alias("until_us"), hit["unit"].alias("unit"), hit["basis"].alias("basis"))


def histories(values: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Bins of every source's history: (source, at, edge, unit, basis, and n, mean, square of the logs of both fields).

    values: (source, us, h, s), h and s positive or null. A bin is a day, or the part of
    it from an edge of the catalogue on, so that no bin has two entries of the
    catalogue. Rows are summed before the shuffle: a task holds the days of a source,
    never its rows. Pieces of the catalogue without values are bins without rows.
    """
    told = catalogue_pieces(catalogue)
    c = told.select(F.col("source").alias("_source"), F.col("from_us").alias("edge"), "until_us", "unit", "basis")
    v = values.where("source is not null and us is not null and (h > 0 or s > 0)")
    v = v.join(small(c), (v["source"] == F.col("_source")) & (v["us"] >= F.col("edge")) & (F.col("until_us").isNull() | (v["us"] < F.col("until_us"))), "left")
    day = F.floor(F.col("us") / DAY_US) * DAY_US
    v = v.select("source", F.greatest(day, F.col("edge")).cast("long").alias("at"), F.coalesce("edge", F.lit(EVER_US)).alias("edge"), "unit", "basis", *[F.when(F.col(x) > 0, F.log(x)).alias(x) for x in "hs"])
    sums = lambda x: [F.count(x).cast("double").alias(f"{x}_n"), F.avg(x).alias(f"{x}_mean"), F.avg(F.col(x) * F.col(x)).alias(f"{x}_square")]
    empty = told.select("source", F.col("from_us").alias("at"), F.col("from_us").alias("edge"), "unit", "basis", *[F.lit(None).cast("double").alias(x) for x in "hs"])
    return v.unionByName(empty).groupBy("source", "at", "edge", "unit", "basis").agg(*sums("h"), *sums("s"))


def source_pieces(values: DataFrame, catalogue: DataFrame, penalty: float = PENALTY) -> DataFrame:
    """PIECES of every source's history: where its segments start and end, the unit of its heights and the basis of its storeys.

    See ``histories`` for the inputs. Sources without a catalogue entry get the
    units that their levels fit best; a source in neither gives no piece.
    """
    bins = written(histories(values, catalogue), "units-bins")
    # Centres of the logs in the common unit, over the rows of documented sources; over all rows where none is.
    centres = {}
    told = {"h": ("unit", {u: math.log(entries.METRES_IN[u]) for u in entries.METRES_IN}), "s": ("basis", {"storeys": 0.0, "above": 0.0, "tenths": math.log(0.1)})}
    sums = []
    for x, (unit, logs) in told.items():
        shift = F.try_element_at(F.create_map(*[F.lit(v) for kv in logs.items() for v in kv]), F.col(unit))
        n, mean = F.col(f"{x}_n"), F.col(f"{x}_mean")
        sums += [(F.sum(n * (mean + shift)) / F.sum(F.when(shift.isNotNull() & mean.isNotNull(), n))).alias(f"{x}_told"), (F.sum(n * mean) / F.sum(F.when(mean.isNotNull(), n))).alias(f"{x}_all")]
    row = bins.agg(*sums).first()  # one row
    for x in told:
        centres[x] = float(next((c for c in (row[f"{x}_told"], row[f"{x}_all"]) if c is not None), 0.0))
    return bins.groupBy("source").applyInPandas(_segments(centres, penalty), PIECES)


def stories_missing(basis: str = "_basis"):
    """Missing storey counts: 0 is a number where the row or its source leaves out the ground floor."""
    v = F.col("numstories")
    ground = (v == 0) & F.coalesce((F.col("_form") == "above") | (F.col("_form").isNull() & (F.col(basis) == "above")), F.lit(False))
    return entries.missing_number(v) & ~F.coalesce(ground, F.lit(False))


def common_units(df: DataFrame, catalogue: DataFrame, penalty: float = PENALTY) -> DataFrame:
    """``df`` with heights in metres and storeys including the ground floor.

    Adds: height_m, height_unit_used, height_changed, stories_total, stories_basis_used,
    stories_changed. Missing values (null, NaN, stand-ins) give null and false.
    A height that no unit of its source makes possible (over 115 m) is read in
    the first of cm, mm that makes it possible; if none does it stays as it is.
    Rows with a null or unknown source count as metres and storeys; a row without a
    time of capture gets the units of its source where these never changed. Needs the
    columns source, captured_at, height, height_text, numstories, stories_text;
    other columns pass through, but for those with the name of
    a result, which is put in their place. Repeated rows stay repeated.
    """
    kept = F.struct(*[c for c in df.columns if c not in (*RESULTS, *INPUTS)], F.lit(None).cast("int").alias("_none"))
    df = df.select(*[F.col(c) for c in INPUTS], kept.alias("_kept"))
    d = df.withColumns({"_own": entries.height_unit(F.col("height_text")), "_form": entries.stories_form(F.col("stories_text")), "_us": F.unix_micros(F.col("captured_at").cast("timestamp"))})
    h = F.when(F.col("_own").isNull() & ~entries.missing_number(F.col("height")), F.col("height"))
    s = F.when(F.col("_form").isNull() & ~entries.missing_number(F.col("numstories")), F.col("numstories"))
    p = source_pieces(d.select("source", F.col("_us").alias("us"), h.alias("h"), s.alias("s")), catalogue, penalty)
    p = p.select(F.col("source").alias("_source"), "from_us", "until_us", F.col("unit").alias("_hu"), F.col("basis").alias("_basis"))
    # The pieces of a source don't overlap, so a row meets one of them.
    within = (F.col("from_us").isNull() | (F.col("_us") >= F.col("from_us"))) & (F.col("until_us").isNull() | (F.col("_us") < F.col("until_us")))
    d = d.join(small(written(p, "units-pieces")), (d["source"] == F.col("_source")) & within, "left")
    d = d.withColumn("_hu", F.coalesce("_own", "_hu", F.lit("m")))
    no_height, no_stories = entries.missing_number(F.col("height")), stories_missing()

    factor = F.try_element_at(F.create_map(*[F.lit(x) for kv in entries.METRES_IN.items() for x in kv]), F.col("_hu"))
    v = F.col("height")
    # In steps of their own: each is read more than once, and repeated in one expression they would outgrow what is compiled.
    d = d.withColumn("_stated", F.when(F.col("_own").isNotNull(), entries.entry_metres(F.col("height_text"), F.col("_own"))).otherwise(v * F.coalesce(factor, F.lit(1.0))))
    tall = F.col("_own").isNull() & (F.col("_stated") > entries.TALLEST_M)
    d = d.withColumn("_small", F.when(tall & (v * 0.01 <= entries.TALLEST_M), F.lit("cm")).when(tall & (v * 0.001 <= entries.TALLEST_M), F.lit("mm")))
    d = d.withColumns({"_no_height": no_height, "_no_stories": no_stories})
    no_height, no_stories = F.col("_no_height"), F.col("_no_stories")
    unit = F.coalesce("_small", "_hu")
    metres = F.when(F.col("_small") == "cm", v * 0.01).when(F.col("_small") == "mm", v * 0.001).otherwise(F.col("_stated"))

    n = F.col("numstories")
    basis = F.coalesce("_form", F.when(F.col("_basis").isin("tenths", "above"), F.col("_basis")), F.lit("total"))
    total = (
        F.when(F.col("_b") == "above", n + 1).when(F.col("_b") == "tenths", n / 10)
        .when(F.col("_b") == "metres", F.coalesce(entries.entry_number(F.col("stories_text")), n) / entries.STOREY_M).otherwise(n)
    )
    d = d.withColumn("_b", basis)
    return d.select(
        *INPUTS, "_kept.*",
        F.when(~no_height, metres).alias("height_m"), F.when(~no_height, unit).alias("height_unit_used"), (~no_height & (unit != "m")).alias("height_changed"),
        F.when(~no_stories, total).alias("stories_total"), F.when(~no_stories, F.col("_b")).alias("stories_basis_used"), (~no_stories & F.col("_b").isin("above", "tenths", "metres")).alias("stories_changed"),
        no_height.alias("height_missing"), no_stories.alias("stories_missing"),
    ).drop("_none")
