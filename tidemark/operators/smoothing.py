"""Curves along a key's rows: a constant-velocity filter and the natural cubic spline.

Both are sequential in their plain form. Here a key's rows are cut into ranges in order; each range
is reduced to a few numbers at once, these are put together a key, and with them each range gives its
rows, so a key may hold any share of the rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import is_number
from tidemark.operators.keys import keyed_join
from tidemark.operators.ranges import fit_a_task, in_ranges
from tidemark.plans.staging import drop, staged

EYE = np.eye(2)


def _fields(df: DataFrame, keys: list[str]) -> list[T.StructField]:
    return [df.schema[k] for k in keys]


def _inverse(m: np.ndarray) -> np.ndarray:
    """Inverses of a stack of 2 x 2 matrices."""
    (a, b), (c, d) = (m[:, 0, 0], m[:, 0, 1]), (m[:, 1, 0], m[:, 1, 1])
    return np.stack([d, -b, -c, a], axis=1).reshape(-1, 2, 2) / (a * d - b * c)[:, None, None]


class Elements:
    """A stack of filter elements (A, b, C, e, J): after one, a state known as mean m and covariance P
    before it has a mean and covariance that follow from these five, and two in a row are again one
    (Särkkä and García-Fernández, 2021)."""

    def __init__(self, a, b, c, e, j):
        self.a, self.b, self.c, self.e, self.j = a, b, c, e, j

    def __len__(self) -> int:
        return len(self.a)

    def __getitem__(self, at) -> Elements:
        return Elements(self.a[at], self.b[at], self.c[at], self.e[at], self.j[at])

    def then(self, o: Elements) -> Elements:
        """Each of these followed by each of ``o``."""
        turn = lambda m: m.transpose(0, 2, 1)
        on = lambda m, v: (m @ v[:, :, None])[:, :, 0]
        d = o.a @ _inverse(EYE + self.c @ o.j)
        back = turn(self.a) @ _inverse(EYE + o.j @ self.c)
        return Elements(d @ self.a, on(d, self.b + on(self.c, o.e)) + o.b, d @ self.c @ turn(o.a) + o.c, on(back, o.e - on(o.j, self.b)) + self.e, back @ o.j @ self.a + self.j)

    def together(self) -> Elements:
        """All in a row as one: neighbours are joined in pairs until one is left."""
        found = self
        while len(found) > 1:
            n = len(found) // 2 * 2
            joined = found[:n:2].then(found[1:n:2])
            found = joined if n == len(found) else Elements(*[np.concatenate([p, q]) for p, q in zip(joined.parts(), found[n:].parts(), strict=True)])
        return found

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.a, self.b, self.c, self.e, self.j

    def flat(self) -> list[float]:
        return np.concatenate([p.reshape(len(self), -1) for p in self.parts()], axis=1).ravel().tolist()


def _unflat(rows: np.ndarray) -> Elements:
    a, b, c, e, j = np.split(rows, [4, 6, 10, 12], axis=1)
    return Elements(a.reshape(-1, 2, 2), b, c.reshape(-1, 2, 2), e, j.reshape(-1, 2, 2))


def _steps(dt: np.ndarray, z: np.ndarray, noise: float, drift: float) -> Elements:
    """The element of each row: time goes on by ``dt``, then ``z`` is seen, or nothing where it is NaN."""
    n, one, zero = len(dt), np.ones(len(dt)), np.zeros(len(dt))
    f = np.stack([one, dt, zero, one], axis=1).reshape(n, 2, 2)
    q = drift * np.stack([dt**3 / 3, dt**2 / 2, dt**2 / 2, dt], axis=1).reshape(n, 2, 2)
    seen, y = ~np.isnan(z), np.nan_to_num(z)
    s = q[:, 0, 0] + noise
    gain = np.where(seen[:, None], q[:, :, 0] / s[:, None], 0.0)
    left = np.broadcast_to(EYE, (n, 2, 2)).copy()
    left[:, :, 0] -= gain
    h = f[:, 0, :] * (seen / s)[:, None]  # the row that the value is seen through, over its variance
    return Elements(left @ f, gain * y[:, None], left @ q, h * y[:, None], h[:, :, None] * f[:, 0, None, :])


def _begun(value: float, noise: float) -> Elements:
    """The element that forgets what was before it: the first value seen, at rest."""
    zero = np.zeros((1, 2, 2))
    return Elements(zero, np.array([[value, 0.0]]), noise * EYE[None], np.zeros((1, 2)), zero)


def _filtered(times: np.ndarray, seen: np.ndarray, noise: float, drift: float, before: float, state: np.ndarray | None, cover: np.ndarray) -> np.ndarray:
    """State after each row, from ``state`` and ``cover`` at the time ``before``."""
    out = np.full((len(times), 2), np.nan)
    for i, z in enumerate(seen):
        if state is None:
            if not np.isnan(z):
                state = np.array([z, 0.0])
        else:
            dt = times[i] - (times[i - 1] if i else before)
            f = np.array([[1, dt], [0, 1]])
            state, cover = f @ state, f @ cover @ f.T + drift * np.array([[dt**3 / 3, dt**2 / 2], [dt**2 / 2, dt]])
            if not np.isnan(z):
                gain = cover[:, 0] / (cover[0, 0] + noise)
                state, cover = state + gain * (z - state[0]), cover - np.outer(gain, cover[0])
        if state is not None:
            out[i] = state
    return out


def smooth_constant_velocity(df: DataFrame, keys: list[str], t: str, value: str, tie: str, noise: float, drift: float) -> DataFrame:
    """``smooth`` and ``velocity``: a Kalman filter with a constant-velocity model over each key's rows
    in the order of ``t``, ``tie``. It begins with the first value, at rest; a null or NaN value is
    predicted only; both are null before the first value. Rows with a null or NaN ``t`` get null and
    take no part; rows of one time follow each other without drift; a null key is one like others.

    Keys of up to ranges.RANGE_ROWS rows are taken one to a task. Where one has more, a range's rows
    are composed to one element of the associative scan, these are composed a key (one row a range),
    and each range is then filtered from the state before it.
    """
    spark, scratch = df.sparkSession, []
    timed, columns = is_number(t), df.columns
    two = [T.StructField("smooth", T.DoubleType()), T.StructField("velocity", T.DoubleType())]
    apart = df.where(~timed).select("*", *[F.lit(None).cast("double").alias(f.name) for f in two])
    null = [F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) for f in two]
    sort = lambda pdf: pdf.sort_values([t, tie], ignore_index=True)

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = sort(pdf)
        out = _filtered(pdf[t].to_numpy(float), pdf[value].to_numpy(float), noise, drift, np.nan, None, np.diag([noise, noise]))
        return pdf.assign(smooth=out[:, 0], velocity=out[:, 1])

    if fit_a_task(df.where(timed), keys):
        found = df.where(timed).groupBy(*keys).applyInPandas(whole, T.StructType([*df.schema, *two]))
        return found.select(*df.columns, *null).unionByName(apart)
    ranged = in_ranges(df.where(timed), [*keys, t, tie], scratch)
    along = Window.partitionBy(*keys).orderBy("_range")
    ends = ranged.groupBy(*keys, "_range").agg(F.max(F.col(t).cast("double")).alias("_end"), F.count(F.nanvl(F.col(value).cast("double"), F.lit(None))).alias("_seen"))
    known = F.coalesce(F.sum("_seen").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) > 0
    ends = staged(ends.select(*keys, "_range", F.lag("_end").over(along).alias("_before"), known.alias("_known")), "ends", scratch)
    parts = keyed_join(ranged, ends, [*keys, "_range"])

    def composed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = sort(pdf)
        times, seen = pdf[t].to_numpy(float), pdf[value].to_numpy(float)
        found, dt = None, np.diff(times, prepend=pdf["_before"].iloc[0])
        if pdf["_known"].iloc[0]:
            found = _steps(dt, seen, noise, drift).together()
        elif (~np.isnan(seen)).any():
            at = int((~np.isnan(seen)).argmax())
            found = _begun(seen[at], noise)
            if at + 1 < len(seen):
                found = found.then(_steps(dt[at + 1 :], seen[at + 1 :], noise, drift).together())
        return pd.DataFrame([[*[pdf[k].iloc[0] for k in keys], pdf["_range"].iloc[0], found.flat() if found else None]], columns=[*keys, "_range", "_element"])

    def stitched(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, found, states = pdf.sort_values("_range", ignore_index=True), None, []
        for flat in pdf["_element"]:
            states.append(None if found is None else [*found.b[0], *found.c[0].ravel()])
            if flat is not None:
                here = _unflat(np.array([flat], float))
                found = here if found is None else found.then(here)
        return pdf.drop(columns="_element").assign(_state=states)

    ranges = T.StructType([*_fields(df, keys), T.StructField("_range", T.IntegerType())])
    numbers = T.ArrayType(T.DoubleType())
    elements = staged(parts.groupBy(*keys, "_range").applyInPandas(composed, T.StructType([*ranges, T.StructField("_element", numbers)])), "elements", scratch)
    states = elements.groupBy(*keys).applyInPandas(stitched, T.StructType([*ranges, T.StructField("_state", numbers)]))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = sort(pdf)
        state = pdf["_state"].iloc[0]
        cover = np.diag([noise, noise]) if state is None else np.array(state[2:]).reshape(2, 2)
        out = _filtered(pdf[t].to_numpy(float), pdf[value].to_numpy(float), noise, drift, pdf["_before"].iloc[0], None if state is None else np.array(state[:2]), cover)
        return pdf[columns].assign(smooth=out[:, 0], velocity=out[:, 1])

    begun = keyed_join(parts, states, [*keys, "_range"])
    found = staged(begun.groupBy(*keys, "_range").applyInPandas(run, T.StructType([*df.schema, *two])), "smooth")
    drop(spark, scratch)
    return found.select(*df.columns, *null).unionByName(apart)


def _eliminated(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bends at the inner knots of a piece of the spline as p + q * bend at its first knot + r * bend at
    its last: the tridiagonal system for three right sides at once."""
    h = np.diff(a)
    d, n = 2 * (h[:-1] + h[1:]), len(a) - 2
    right = np.zeros((n, 3))
    right[:, 0] = 6 * np.diff(np.diff(b) / h)
    if n:
        right[0, 1] -= h[0]
        right[-1, 2] -= h[-1]
    for i in range(1, n):
        share = h[i] / d[i - 1]
        d[i] -= h[i] * share
        right[i] -= share * right[i - 1]
    for i in range(n - 1, -1, -1):
        right[i] = (right[i] - (h[i + 1] * right[i + 1] if i + 1 < n else 0)) / d[i]
    return right[:, 0], right[:, 1], right[:, 2]


def _piece(pdf: pd.DataFrame, x: str, y: str) -> tuple[np.ndarray, np.ndarray, bool]:
    """Knots of a range with the first of the next, and whether there is a next."""
    a, b, further = pdf[x].to_numpy(float), pdf[y].to_numpy(float), pdf["_next_x"].iloc[0]
    if np.isnan(further):
        return a, b, False
    return np.append(a, further), np.append(b, pdf["_next_y"].iloc[0]), True


def _curve(keys: list[str], x: str, y: str, step: float):
    """The curve over one piece, from the bends at its two ends."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(x, ignore_index=True)
        a, b, further = _piece(pdf, x, y)
        zero = a[0] if np.isnan(pdf["_zero"].iloc[0]) else pdf["_zero"].iloc[0]
        named = lambda at, out: pdf[keys].iloc[np.zeros(len(at), int)].reset_index(drop=True).assign(**{x: at, y: out})
        if len(a) < 2:  # the key's only knot, or the last one, which the piece before ends with
            alone = int(a[0] == zero)
            return named(a[:alone], b[:alone])
        p, q, r = _eliminated(a, b)
        m, n = pdf["_first"].iloc[0], pdf["_last"].iloc[0]
        bend, h = np.concatenate([[m], p + q * m + r * n, [n]]), np.diff(a)
        k = np.arange(np.floor((a[0] - zero) / step) - 1, np.ceil((a[-1] - zero) / step) + 2)
        at = zero + k * step
        last = not further or bool(pdf["_ends_here"].iloc[0])
        at = at[(k >= 0) & (at >= a[0]) & ((at < a[-1] + step * 1e-9) if last else (at < a[-1]))]
        i = np.clip(np.searchsorted(a, at, side="right") - 1, 0, len(h) - 1)
        u, v = at - a[i], a[i + 1] - at
        out = (bend[i] * v**3 + bend[i + 1] * u**3) / (6 * h[i]) + (b[i] / h[i] - bend[i] * h[i] / 6) * v + (b[i + 1] / h[i] - bend[i + 1] * h[i] / 6) * u
        return named(at, out)

    return run


def spline_at(df: DataFrame, keys: list[str], x: str, y: str, step: float) -> DataFrame:
    """keys, x, y of the natural cubic spline through each key's points (mean ``y`` of equal ``x``) at
    every ``step`` from its first; one point gives itself. Rows with a null or NaN x or y are none; a
    null key is one like others.

    Keys of up to ranges.RANGE_ROWS knots are taken one to a task. Where one has more, each range of
    knots, with the first of the next, solves its inner bends in terms of those at its
    two ends; a key's ends, two a range, make a small system of the same kind; with its solution
    each range gives its share of the curve.
    """
    spark, scratch = df.sparkSession, []
    knots = df.where(is_number(x) & is_number(y)).groupBy(*keys, F.col(x).cast("double").alias(x)).agg(F.avg(y).alias(y))
    fields = [*_fields(df, keys), T.StructField(x, T.DoubleType()), T.StructField(y, T.DoubleType())]
    alone = {"_zero": F.lit(None).cast("double"), "_next_x": F.lit(None).cast("double"), "_next_y": F.lit(None).cast("double"), "_first": F.lit(0.0), "_last": F.lit(0.0), "_ends_here": F.lit(True)}
    if fit_a_task(knots, keys):
        return knots.withColumns(alone).groupBy(*keys).applyInPandas(_curve(keys, x, y, step), T.StructType(fields))
    ranged = in_ranges(knots, [*keys, x], scratch)
    along = Window.partitionBy(*keys).orderBy("_range")
    ends = ranged.groupBy(*keys, "_range").agg(F.min(F.struct(F.col(x).alias("x"), F.col(y).alias("y"))).alias("_head"))
    ends = ends.select(*keys, "_range", F.first("_head.x").over(along).alias("_zero"), F.lead("_head").over(along).alias("_next"))
    ends = staged(ends.select(*keys, "_range", "_zero", F.col("_next.x").alias("_next_x"), F.col("_next.y").alias("_next_y")), "ends", scratch)
    parts = keyed_join(ranged, ends, [*keys, "_range"])

    def reduced(pdf: pd.DataFrame) -> pd.DataFrame:
        """The piece's share of the equations at its two ends: width and slope of the chord beside them, and
        the bend at the inner knot beside them as (p, q, r). Without inner knots that is the other end."""
        pdf = pdf.sort_values(x, ignore_index=True)
        a, b, _ = _piece(pdf, x, y)
        told = [0.0] * 10
        if len(a) > 1:
            h, chord = np.diff(a), np.diff(b) / np.diff(a)
            p, q, r = _eliminated(a, b)
            first = (p[0], q[0], r[0]) if len(p) else (0.0, 0.0, 1.0)
            last = (p[-1], q[-1], r[-1]) if len(p) else (0.0, 1.0, 0.0)
            told = [h[0], chord[0], *first, h[-1], chord[-1], *last]
        return pd.DataFrame([[*[pdf[k].iloc[0] for k in keys], pdf["_range"].iloc[0], [float(v) for v in told], len(a) > 1]], columns=[*keys, "_range", "_ends", "_long"])

    def solved(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_range", ignore_index=True)
        e, n = np.array(pdf["_ends"].tolist(), float), len(pdf)
        bend = np.zeros(n + 1)  # at the first knot of each range, and after the last
        low, mid, up, right = np.zeros(n), np.ones(n), np.zeros(n), np.zeros(n)
        for i in range(1, n):
            if not pdf["_long"].iloc[i]:  # the key's last knot alone
                continue
            (h, chord, p, q, r), (g, slope, s, u, v) = e[i, :5], e[i - 1, 5:]
            low[i], mid[i], up[i] = g * u, 2 * (g + h) + g * v + h * q, h * r
            right[i] = 6 * (chord - slope) - g * s - h * p
        for i in range(1, n):
            share = low[i] / mid[i - 1]
            mid[i] -= share * up[i - 1]
            right[i] -= share * right[i - 1]
        for i in range(n - 1, 0, -1):
            bend[i] = (right[i] - up[i] * bend[i + 1]) / mid[i]
        return pdf.drop(columns=["_ends", "_long"]).assign(_first=bend[:-1], _last=bend[1:])

    ranges = [*_fields(df, keys), T.StructField("_range", T.IntegerType())]
    number = T.DoubleType()
    reduced_to = staged(parts.groupBy(*keys, "_range").applyInPandas(reduced, T.StructType([*ranges, T.StructField("_ends", T.ArrayType(number)), T.StructField("_long", T.BooleanType())])), "reduced", scratch)
    bends = reduced_to.groupBy(*keys).applyInPandas(solved, T.StructType([*ranges, T.StructField("_first", number), T.StructField("_last", number)]))

    last = reduced_to.select(*keys, "_range", (~F.coalesce(F.lead("_long").over(along), F.lit(True))).alias("_ends_here"))
    told = keyed_join(keyed_join(parts, bends, [*keys, "_range"]), last, [*keys, "_range"])
    found = staged(told.groupBy(*keys, "_range").applyInPandas(_curve(keys, x, y, step), T.StructType(fields)), "curve")
    drop(spark, scratch)
    return found
