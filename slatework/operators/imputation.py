"""Filling missing values by chained equations with distributed fits.

Numeric fields are regressed in logs, the categorical field is predicted by a
linear discriminant. A round is one pass over the rows with gaps: it draws their missing
values from the models of the round before and sums the cross products of all fields by
what is missing, so each field's next fit takes the patterns in which it was recorded. What
reaches the driver is a matrix per pattern, whatever the number of rows. A draw needs the
row's recorded fields and the latest models alone, so no state is kept between rounds;
rows without gaps are summed once.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatework.session import small, written

#: Rounds at most, and the change of a round's coefficients (in standard deviations of the field) at which they have settled.
ROUNDS = 6
SETTLED = 0.02
#: Residuals are kept by bins of the prediction (of equal width over the recorded range) and of the residual, which reach to REACH
#: standard deviations; a bin of predictions with fewer than BIN_ROWS takes the residuals of all.
MEANS, BINS, REACH, BIN_ROWS = 24, 120, 6.0, 30
#: Rows without gaps for each column, from which on they give the first models.
WHOLE_ROWS = 20
#: Ridge on the normal equations.
RIDGE = 1e-4
#: Rows of prior weight that pull a group's mean to the overall mean.
PRIOR_ROWS = 5.0


@dataclass(frozen=True)
class Plan:
    """numeric: positive fields; categorical: one field of few classes; groups: columns whose mean levels are predictors."""

    numeric: tuple[str, ...]
    categorical: str
    classes: tuple[str, ...]
    groups: tuple[str, ...]
    seed: int = 42
    rounds: int = ROUNDS
    shares: tuple[float, ...] = ()  # of the recorded classes; found by ``chained``
    bounds: tuple[tuple[float, float], ...] = ()  # least and largest recorded log of each numeric field; found by ``chained``


def _start(pdf: pd.DataFrame, plan: Plan):
    """Columns (fixed, numbers in logs, classes) of a batch and its patterns of gaps; gaps start at their groups' level."""
    none = np.zeros((len(pdf), 0))
    logs = np.column_stack([none, *(pdf[f"v_{f}"].to_numpy(float) for f in plan.numeric)])
    start = np.column_stack([none, *(pdf[f"s_{f}"].to_numpy(float) for f in plan.numeric)])
    gap = np.isnan(logs)
    code = pdf["v_class"].to_numpy(float)
    no_class = np.isnan(code)
    hot = np.where(no_class[:, None], np.array(plan.shares)[None, :], np.eye(len(plan.classes))[np.where(no_class, 0, code).astype(int)]) if plan.classes else none
    return np.hstack([np.ones((len(pdf), 1)), start, pdf[["year"]].to_numpy(float), np.where(gap, start, logs), hot]), _patterns(gap, no_class)


def _noise(ids: np.ndarray, salt: int) -> np.ndarray:
    """Standard normal values that depend on the id and the salt alone."""
    with np.errstate(over="ignore"):
        z = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt) * np.uint64(0xBF58476D1CE4E5B9)
        z ^= z >> np.uint64(30)
        z *= np.uint64(0xBF58476D1CE4E5B9)
        z ^= z >> np.uint64(27)
        z *= np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    u1 = ((z >> np.uint64(40)).astype(float) + 0.5) / 2**24
    u2 = ((z & np.uint64(0xFFFFFF)).astype(float) + 0.5) / 2**24
    return np.sqrt(-2 * np.log(u1)) * np.cos(2 * np.pi * u2)


def _uniform(ids: np.ndarray, salt: int) -> np.ndarray:
    """Values in (0, 1) that depend on the id and the salt alone."""
    with np.errstate(over="ignore"):
        z = (ids.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
        z ^= z >> np.uint64(29)
        z *= np.uint64(0xBF58476D1CE4E5B9)
        z ^= z >> np.uint64(32)
    return ((z >> np.uint64(11)).astype(float) + 0.5) / 2**53


def _patterns(gap: np.ndarray, no_class: np.ndarray) -> np.ndarray:
    """What is missing in each row: a bit per numeric field, and one more for the class."""
    return (np.column_stack([gap, no_class]) << np.arange(gap.shape[1] + 1)).sum(axis=1)


def _steps(pattern: int, k: int) -> list[tuple[int, int]]:
    """(field, numeric fields known by then as bits) in the order in which a pattern's gaps are drawn: the class (as k) first, then the numbers.

    Each draw is from the recorded fields and those drawn before it, so the draws of a
    row are one draw of all its gaps together, however strongly the fields are tied.
    """
    known, out = ~pattern & ((1 << k) - 1), []
    if pattern >> k & 1:
        out.append((k, known))
    for j in range(k):
        if pattern >> j & 1:
            out.append((j, known))
            known |= 1 << j
    return out


def _columns(target: int, known: int, k: int, classes: int) -> list[int]:
    """Columns of (fixed, numbers, classes) that predict the target: the fixed ones, the known numbers and, for a number, the classes but the last."""
    first = 2 + k
    return [*range(first), *(first + i for i in range(k) if known >> i & 1), *(range(first + k, first + k + classes - 1) if target < k else ())]


def _drawn(pdf: pd.DataFrame, plan: Plan, models: dict, shapes: dict | None = None):
    """Columns (fixed, numbers in logs, classes) of a batch with its gaps drawn, and its patterns of gaps.

    Residuals are normal, or of the shapes found, then also drawn anew where the
    number would lie beyond what was ever recorded.
    """
    z, patterns = _start(pdf, plan)
    ids, k, c = pdf["id"].to_numpy(), len(plan.numeric), len(plan.classes)
    first, last = 2 + k, 2 + 2 * k
    for pattern in np.unique(patterns).tolist():
        at = np.flatnonzero(patterns == pattern)
        for target, known in _steps(pattern, k):
            model = models.get((target, known))
            if model is None:
                continue
            rows = z[np.ix_(at, _columns(target, known, k, c))]
            if target == k:
                w, b = model
                score = rows @ w + b
                p = np.exp(score - score.max(axis=1, keepdims=True))
                pick = (p.cumsum(axis=1) < _uniform(ids[at], plan.seed)[:, None] * p.sum(axis=1, keepdims=True)).sum(axis=1)
                z[at, last:] = np.eye(c)[np.minimum(pick, c - 1)]
                continue
            beta, sd = model
            mean = rows @ beta
            if shapes is None:
                z[at, first + target] = mean + sd * _noise(ids[at], plan.seed + target)
                continue
            low, high = plan.bounds[target]
            group = _level(mean, low, high)
            y = np.empty(len(at))
            for g in np.unique(group).tolist():
                some = np.flatnonzero(group == g)
                y[some] = _residuals(mean[some], sd, shapes[target, known][g], ids[at][some], plan.seed + 1 + target, low, high)
            z[at, first + target] = y
    return z, patterns


def _level(mean: np.ndarray, low: float, high: float) -> np.ndarray:
    """The bin of each prediction."""
    return np.clip((mean - low) / max(high - low, 1e-9) * MEANS, 0, MEANS - 1).astype(int)


def _residuals(mean: np.ndarray, sd: float, shares: np.ndarray, ids: np.ndarray, salt: int, low: float, high: float) -> np.ndarray:
    """Predictions with residuals drawn from their distribution; what lies beyond the recorded range is drawn anew."""
    edges = np.linspace(-REACH, REACH, BINS + 1)
    y = mean + sd * np.interp(_uniform(ids, salt), shares, edges)
    for again in range(1, 9):
        out = np.flatnonzero((y < low) | (y > high))
        if not len(out):
            break
        y[out] = mean[out] + sd * np.interp(_uniform(ids[out], salt + 100 * again), shares, edges)
    return np.clip(y, low, high)


def _narrow(df: DataFrame) -> DataFrame:
    """Without the kept columns, which the passes that fit don't read."""
    return df.select(*[c for c in df.columns if not c.startswith("k_") and c != "whole"])


def _shapes(df: DataFrame, plan: Plan, models: dict) -> dict[tuple[int, int], np.ndarray]:
    """Per model of a number the distribution of its residuals in standard deviations, over the rows that recorded it: MEANS rows of cumulated shares."""
    k, c = len(plan.numeric), len(plan.classes)
    keys = sorted(m for m in models if m[0] < k)
    shape = (len(keys), MEANS, BINS)

    def run(batches):
        total = np.zeros(shape).ravel()
        for pdf in batches:
            z, patterns = _drawn(pdf, plan, models)
            for i, (target, known) in enumerate(keys):
                at = np.flatnonzero(~patterns >> target & 1)
                beta, sd = models[target, known]
                mean = z[np.ix_(at, _columns(target, known, k, c))] @ beta
                rest = np.clip((z[at, 2 + k + target] - mean) / max(sd, 1e-9), -REACH, REACH)
                b = np.minimum((rest + REACH) * (BINS / (2 * REACH)), BINS - 1).astype(int)
                total += np.bincount((i * MEANS + _level(mean, *plan.bounds[target])) * BINS + b, minlength=len(total))
        at = np.flatnonzero(total)
        if len(at):
            yield pd.DataFrame({"i": at.astype(np.int32), "n": total[at]})

    rows = _narrow(df).mapInPandas(run, "i int, n double").groupBy("i").agg(F.sum("n").alias("n")).collect()  # MEANS x BINS numbers per model
    counts = np.zeros(shape).ravel()
    for r in rows:
        counts[r["i"]] = r["n"]
    counts = counts.reshape(shape)
    counts = np.where(counts.sum(axis=2, keepdims=True) >= BIN_ROWS, counts, counts.sum(axis=1, keepdims=True))
    shares = np.cumsum(counts, axis=2) / np.maximum(counts.sum(axis=2, keepdims=True), 1.0)
    shares = np.concatenate([np.zeros((len(keys), MEANS, 1)), shares], axis=2)
    return dict(zip(keys, shares, strict=True))


def _sums(df: DataFrame, plan: Plan, models: dict, whole: bool) -> dict[int, np.ndarray]:
    """Per pattern of gaps the cross products of all columns; of the rows without gaps, or of those with one."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            z, patterns = _drawn(pdf, plan, models)
            for p in np.unique(patterns).tolist():
                rows = z[patterns == p]
                total[p] = total.get(p, 0) + rows.T @ rows
        for p, m in total.items():
            yield pd.DataFrame({"p": np.full(m.size, p, dtype=np.int32), "i": np.arange(m.size, dtype=np.int32), "v": m.ravel()})

    part = _narrow(df.where("whole" if whole else "not whole"))
    rows = part.mapInPandas(run, "p int, i int, v double").groupBy("p", "i").agg(F.sum("v").alias("v")).collect()  # a matrix of fixed size per pattern
    size = 2 + 2 * len(plan.numeric) + len(plan.classes)
    flat: dict[int, np.ndarray] = {}
    for r in rows:
        flat.setdefault(r["p"], np.zeros(size * size))[r["i"]] = r["v"]
    return {p: m.reshape(size, size) for p, m in flat.items()}


def _fitted(by_pattern: dict[int, np.ndarray], gaps: list[int], plan: Plan) -> dict[tuple[int, int], tuple]:
    """Models (field, known) of all draws that the patterns in ``gaps`` need; each is fitted over the rows that recorded its field."""
    k, c = len(plan.numeric), len(plan.classes)
    first, last = 2 + k, 2 + 2 * k
    sums = [sum((m for p, m in by_pattern.items() if not p >> j & 1), np.zeros((last + c, last + c))) for j in range(k + 1)]
    out: dict[tuple[int, int], tuple] = {}
    for pattern in gaps:
        for target, known in _steps(pattern, k):
            if (target, known) in out or (target == k and not c):
                continue
            columns = _columns(target, known, k, c) + (list(range(last, last + c)) if target == k else [first + target])
            part = sums[target][np.ix_(columns, columns)]
            model = _fit_classes(part, c) if target == k else _fit_numeric(part)
            if model is not None:
                out[target, known] = model
    return out


def _settled(old: dict, new: dict, by_pattern: dict[int, np.ndarray], plan: Plan) -> bool:
    """Whether no coefficient of a numeric field moves its prediction by more than SETTLED standard deviations, and no residual deviation changes by as much."""
    k, c = len(plan.numeric), len(plan.classes)
    s = sum(by_pattern.values())
    n = max(s[0, 0], 1.0)
    spread = np.sqrt(np.maximum(np.diag(s) / n - (s[0] / n) ** 2, 0.0))
    for (target, known), model in new.items():
        if target < k:
            scale = max(spread[2 + k + target], 1e-9)
            (b0, d0), (b1, d1) = old.get((target, known), model), model
            if np.abs((b1 - b0) * spread[_columns(target, known, k, c)]).max() > SETTLED * scale or abs(d1 - d0) > SETTLED * scale:
                return False
    return True


def _fit_numeric(s: np.ndarray):
    if s.size == 0 or s[0, 0] <= 0:  # no row records the field
        return None
    a, b, yy, n = s[:-1, :-1], s[:-1, -1], s[-1, -1], max(s[0, 0], 1.0)
    beta = np.linalg.solve(a + RIDGE * n * np.diag(np.where(np.arange(len(a)) == 0, 1e-9, np.maximum(np.diag(a) / n, 1e-6))), b)
    rest = max(yy - 2 * beta @ b + beta @ a @ beta, 0.0)
    return beta, float(np.sqrt(rest / n))


def _fit_classes(s: np.ndarray, classes: int):
    """Linear discriminant: class means and the pooled covariance, from the cross products."""
    if s.size == 0 or s[0, 0] <= 0:  # no row records the field
        return None
    p = len(s) - classes
    counts = np.diag(s[p:, p:]).copy()
    n = max(counts.sum(), 1.0)
    means = s[:p, p:] / np.maximum(counts, 1e-9)
    pooled = (s[:p, :p] - (means * counts) @ means.T) / n
    pooled += np.diag(RIDGE * np.maximum(np.diag(pooled), 1e-4) + 1e-6)
    w = np.linalg.solve(pooled, means)
    b = np.log((counts + 1e-3) / (n + 1e-3 * classes)) - 0.5 * np.einsum("pc,pc->c", means, w)
    return w, b


def _group_level(d: DataFrame, fields: list[str], group: str) -> DataFrame:
    """Sums and counts of recorded logs per group value (pre-aggregated before the shuffle)."""
    aggs = [a for f in fields for a in (F.sum(f"v_{f}").alias(f"{group}_sum_{f}"), F.count(f"v_{f}").alias(f"{group}_n_{f}"))]
    return d.where(F.col(group).isNotNull()).groupBy(group).agg(*aggs)


def prepared(df: DataFrame, plan: Plan, id_col: str, when: str | None, keep: tuple[str, ...] = ()) -> tuple[DataFrame, Plan]:
    """One row per record: recorded logs (null where missing), class code, and the group start of every field; and the plan with the recorded distributions.

    The start is the mean of the record's groups, shrunk to the overall mean: the
    finest group that has recorded values counts most. A record's own value is left
    out of its start, so that the start tells recorded and missing values alike.
    """
    order = {c: i for i, c in enumerate(plan.classes)}
    code = F.try_element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col(plan.categorical)) if order else F.lit(None).cast("int")
    year = (F.year(when) - 2020) / 10.0 if when else F.lit(0.0)
    d = df.select(
        F.col(id_col).alias("id"), *[F.when((F.col(f) > 0) & (F.col(f) < float("inf")), F.log(f)).alias(f"v_{f}") for f in plan.numeric], code.cast("double").alias("v_class"),
        F.coalesce(year, F.lit(0.0)).cast("double").alias("year"), *[F.col(g).alias(f"g{i}") for i, g in enumerate(plan.groups)],
        *[F.col(c).alias(f"k_{c}") for c in keep],
    )
    fields = list(plan.numeric)
    told = d.agg(*[a for f in fields for a in (F.avg(f"v_{f}").alias(f), F.min(f"v_{f}").alias(f"{f}_low"), F.max(f"v_{f}").alias(f"{f}_high"))], *[F.count_if(F.col("v_class") == i).alias(f"c{i}") for i in range(len(plan.classes))]).first()  # one row
    overall = {f: (told[f] if told[f] is not None else 0.0) for f in fields}
    total = sum(told[f"c{i}"] for i in range(len(plan.classes)))
    shares = tuple(told[f"c{i}"] / total if total else 1.0 / len(plan.classes) for i in range(len(plan.classes)))
    bounds = tuple((told[f"{f}_low"], told[f"{f}_high"]) if told[f"{f}_low"] is not None else (-np.inf, np.inf) for f in fields)
    starts = {f: F.lit(float(overall[f])) for f in fields}
    out = d
    # From coarse to fine: each level's mean, without the record itself, is shrunk to the level before.
    for i, _ in enumerate(plan.groups):
        out = out.join(small(_group_level(d, fields, f"g{i}")), f"g{i}", "left")
        for f in fields:
            own = F.col(f"v_{f}").isNotNull().cast("int")
            n = F.coalesce(F.col(f"g{i}_n_{f}") - own, F.lit(0))
            rest = F.coalesce(F.col(f"g{i}_sum_{f}") - F.coalesce(F.col(f"v_{f}"), F.lit(0.0)), F.lit(0.0))
            starts[f] = (F.when(n > 0, rest).otherwise(0.0) + PRIOR_ROWS * starts[f]) / (n + PRIOR_ROWS)
    whole = F.col("v_class").isNotNull()
    for f in fields:
        whole = whole & F.col(f"v_{f}").isNotNull()
    out = out.select("id", *[f"v_{f}" for f in fields], "v_class", "year", *[starts[f].alias(f"s_{f}") for f in fields], whole.alias("whole"), *[f"k_{c}" for c in keep])
    return out, replace(plan, shares=shares, bounds=bounds)


def chained(df: DataFrame, plan: Plan, id_col: str, when: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Fill ``plan``'s fields; returns id, per field ``f`` the filled value and ``f_filled``, and the ``keep`` columns.

    Numeric fields are missing where null, not a number, infinite or not positive. Recorded
    values come out unchanged. The gaps of a row are drawn together: the class
    first, then each number around its prediction from the fields that are recorded or
    drawn by then, with a residual of the distribution that this very prediction leaves; so spread and
    relations of the fields are kept. No number is drawn beyond the recorded ones. A draw depends on the id and the seed alone, never on the
    partitioning. Rounds end when the coefficients have settled, or after ``plan.rounds``.
    A field that no row records stays null and unmarked. Ids
    should be unique; repeated ids get repeated rows. ``df`` is read several times: cut its lineage first.
    """
    d, plan = prepared(df, plan, id_col, when, keep)
    d = written(d, "impute-prepared")
    k, c = len(plan.numeric), len(plan.classes)
    complete = _sums(d, plan, {}, True)
    bits = F.when(F.col("v_class").isNull(), 1 << k).otherwise(0)
    for j, f in enumerate(plan.numeric):
        bits = bits + F.when(F.col(f"v_{f}").isNull(), 1 << j).otherwise(0)
    missing = sorted(r["p"] for r in d.where("not whole").select(bits.alias("p")).distinct().collect())  # at most 2^fields
    enough = sum(m[0, 0] for m in complete.values()) >= WHOLE_ROWS * (2 + 2 * k + c)
    models: dict | None = None
    for _ in range(plan.rounds if missing else 0):
        # Rows without gaps give the first models where there are enough, as gaps at their groups' level would weaken them.
        sums = complete if enough and models is None else {**complete, **_sums(d, plan, models or {}, False)}
        before, models = models, _fitted(sums, missing, plan)
        if before is not None and _settled(before, models, sums, plan):
            break
    models = models or {}
    shapes = _shapes(d, plan, models) if models else {}
    have = {j for j, _ in models}

    def fill(batches):
        for pdf in batches:
            z, patterns = _drawn(pdf, plan, models, shapes)
            out = {"id": pdf["id"]}
            for j, f in enumerate(plan.numeric):
                gap = (patterns >> j & 1).astype(bool)
                out[f] = np.where(gap & (j not in have), np.nan, np.exp(z[:, 2 + k + j]))
                out[f"{f}_filled"] = gap & (j in have)
            classless = (patterns >> k & 1).astype(bool)
            told = np.array(plan.classes, dtype=object)[z[:, 2 + 2 * k :].argmax(axis=1)] if c else np.full(len(pdf), None, dtype=object)
            out[plan.categorical] = np.where(classless & (k not in have), None, told)
            out[f"{plan.categorical}_filled"] = classless & (k in have)
            yield pd.DataFrame(out | {x: pdf[f"k_{x}"] for x in keep})

    types = dict(df.dtypes)
    parts = [p for f in plan.numeric for p in (f"{f} double", f"{f}_filled boolean")] + [f"{plan.categorical} string", f"{plan.categorical}_filled boolean"] + [f"`{c}` {types[c]}" for c in keep]
    filled = d.drop("whole").mapInPandas(fill, "id long, " + ", ".join(parts))
    null = F.lit(None).cast("double")
    numbers = [c for f in plan.numeric for c in (F.when(F.isnan(f), null).otherwise(F.col(f)).alias(f), F.col(f"{f}_filled"))]
    return filled.select("id", *numbers, plan.categorical, f"{plan.categorical}_filled", *keep)


def donated(df: DataFrame, key: str, fields: list[str], order: list[str]) -> DataFrame:
    """Per key the first recorded value of each field (by ``order``): what copies of a record tell of it."""
    picks = [F.min_by(F.when(F.col(f).isNotNull(), F.col(f)), F.when(F.col(f).isNotNull(), F.struct(*order))).alias(f"d_{f}") for f in fields]
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*picks)


__all__ = ["Plan", "chained", "donated"]
