"""Profiles of tables: numeric and categorical columns, outliers, correlations, principal components, scatter correction."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.base import looked_up, materialized, numbered

QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
#: Values that a range may still hold for its ranks to be read off, and the accuracy of the sketches that narrow a range.
READ_OFF, ACCURACY = 4096, 5000


def quantiles(df: DataFrame, columns: list[str], probabilities: tuple[float, ...]) -> dict[str, list[float | None]]:
    """Exact quantiles with linear interpolation, per column; nulls don't count, NaN is larger than any number, a column without values has none.

    Distributed selection: the open range that holds a wanted rank is narrowed by two values of a sketch, which a pass then counts exactly, until
    few values are left in it or the rank falls on one of its ends. A pass is one aggregation of all columns and ranks; no task holds a column's
    distinct values, and values that repeat without end fall on an end.
    """
    x = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    sizes = df.agg(*(F.count(x[c]).alias(f"n{i}") for i, c in enumerate(columns)), *(F.count(c).alias(f"all{i}") for i, c in enumerate(columns))).first()
    found: dict[tuple[str, int], float | None] = {}
    wanted: dict[str, list[tuple[int, int, float]]] = {}
    ranges: dict[tuple[str, int], Range] = {}
    for i, c in enumerate(columns):
        whole, real = sizes[f"all{i}"], sizes[f"n{i}"]
        places = [p * (whole - 1) if whole else 0.0 for p in probabilities]
        wanted[c] = [(math.floor(at), math.ceil(at), at) for at in places]
        for r in {r for low, high, _ in wanted[c] for r in (low, high)}:
            if r < real:
                ranges[c, r] = Range(None, None, 0, real)
            else:
                found[c, r] = float("nan") if whole else None
    while ranges:
        few = {k: v for k, v in ranges.items() if v.inside <= READ_OFF}
        found.update(_read_off(df, x, few))
        ranges = {k: v for k, v in ranges.items() if k not in few}
        if ranges:
            hit, ranges = _narrowed(df, x, ranges)
            found.update(hit)
    return {c: [_between(found[c, low], found[c, high], low, high, at) for low, high, at in wanted[c]] for c in columns}


class Range(NamedTuple):
    """An open range of values, unbounded where an end is null: how many values lie up to its low end, and how many inside."""

    low: float | None
    high: float | None
    upto: int
    inside: int

    def of(self, value: Column) -> Column:
        """The value where it lies inside."""
        if self.low is not None:
            value = F.when(value > self.low, value)
        return value if self.high is None else F.when(value < self.high, value)


def _between(a: float | None, b: float | None, low: int, high: int, at: float) -> float | None:
    return a if a is None or low == high or a == b else (high - at) * a + (at - low) * b


def _narrowed(df: DataFrame, x: dict[str, Column], ranges: dict[tuple[str, int], Range]) -> tuple[dict, dict]:
    """(values of ranks that an end was found to be, narrower ranges of the others), after one sketch and one count."""
    keys, sketches, counts = list(ranges), [], []
    for i, (c, r) in enumerate(keys):
        v = ranges[c, r]
        margin = 2 * v.inside / ACCURACY + 2
        share = [min(max((r - v.upto + d) / v.inside, 0.0), 1.0) for d in (-margin, margin)]
        sketches.append(F.percentile_approx(v.of(x[c]), F.array(*map(F.lit, share)), ACCURACY).alias(f"s{i}"))
    ends = df.agg(*sketches).first()
    for i, (c, _) in enumerate(keys):
        a, b = ends[f"s{i}"]
        counts += [F.count_if(x[c] < a).alias(f"a{i}"), F.count_if(x[c] <= a).alias(f"b{i}"), F.count_if(x[c] < b).alias(f"c{i}"), F.count_if(x[c] <= b).alias(f"d{i}")]
    row = df.agg(*counts).first()
    hit, left = {}, {}
    for i, (c, r) in enumerate(keys):
        v, (a, b) = ranges[c, r], ends[f"s{i}"]
        below_a, upto_a, below_b, upto_b = (row[f"{k}{i}"] for k in "abcd")
        if r < below_a:
            left[c, r] = Range(v.low, a, v.upto, below_a - v.upto)
        elif r < upto_a:
            hit[c, r] = a
        elif r < below_b:
            left[c, r] = Range(a, b, upto_a, below_b - upto_a)
        elif r < upto_b:
            hit[c, r] = b
        else:
            left[c, r] = Range(b, v.high, upto_b, v.upto + v.inside - upto_b)
    return hit, left


def _read_off(df: DataFrame, x: dict[str, Column], ranges: dict[tuple[str, int], Range]) -> dict[tuple[str, int], float]:
    """The values at ranks whose ranges hold few values."""
    if not ranges:
        return {}
    keys = list(ranges)
    held = F.array(*(F.struct(F.lit(i).alias("i"), ranges[c, r].of(x[c]).alias("v")) for i, (c, r) in enumerate(keys)))
    rows = df.select(F.inline(held)).where("v IS NOT NULL").groupBy("i", "v").agg(F.count("*").alias("n")).orderBy("i", "v").collect()
    out, place = {}, [ranges[k].upto for k in keys]
    for row in rows:
        i, key = row["i"], keys[row["i"]]
        if place[i] <= key[1] < place[i] + row["n"]:
            out[key] = row["v"]
        place[i] += row["n"]
    return out


def numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: counts, also of NaN and infinities, quantiles (linear), mean, population deviation, bias-corrected skew and kurtosis."""
    found = quantiles(df, columns, QUANTILES)

    def stats(c: str) -> Column:
        x, n = F.col(c).cast("double"), F.count(c).cast("double")
        g1, g2 = F.skewness(x), F.kurtosis(x)
        skew = F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))
        kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
        q = [F.lit(v).cast("double") for v in found[c]]
        return F.struct(
            F.lit(c).alias("column"), F.count("*").alias("rows"), F.count(c).alias("n"), F.count_if(F.isnan(x)).alias("nan"),
            F.count_if(F.abs(x) == float("inf")).alias("infinite"), F.min(x).alias("min"), F.max(x).alias("max"), F.round(F.avg(x), 6).alias("mean"),
            F.round(F.stddev_pop(x), 6).alias("std"), *(F.round(q[i], 6).alias(f"q{int(p * 100):02d}") for i, p in enumerate(QUANTILES)), F.round(skew, 5).alias("skew"), F.round(kurt, 5).alias("kurtosis"),
        )

    return df.agg(*(stats(c).alias(f"_{c}") for c in columns)).select(F.inline(F.array(*(F.col(f"_{c}") for c in columns))))


def categorical(df: DataFrame, columns: list[str], top: int = 10) -> DataFrame:
    """One row per column: distinct values, nulls, and the most frequent values with their counts."""
    long = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))))
    counts = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    by = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    ranked = counts.where("value IS NOT NULL").withColumn("r", F.row_number().over(by)).where(F.col("r") <= top)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "value", "n"))), lambda x: F.concat(x["value"], F.lit("="), x["n"].cast("string"))), ", ")
    totals = counts.groupBy("column").agg(F.count("value").alias("n_unique"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"))
    return totals.join(ranked.groupBy("column").agg(text.alias("top_values")), "column", "left")


def summary(df: DataFrame) -> DataFrame:
    """One row per column: type, missing and distinct values, and how many rows of the table repeat another one."""
    repeated = F.count("*") - F.count_distinct(F.struct(*df.columns))
    parts = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.count_if(F.col(c).isNull()).alias("missing"), F.count_distinct(c).alias("unique"), repeated.alias("repeated")) for c, t in df.dtypes]
    return df.agg(*(p.alias(f"_{i}") for i, p in enumerate(parts))).select(F.inline(F.array(*(F.col(f"_{i}") for i in range(len(parts))))))


def outliers(df: DataFrame, columns: list[str], factor: float = 1.5) -> DataFrame:
    """Limits at `factor` times the interquartile range beyond the quartiles, and how many values lie outside."""
    found = quantiles(df, columns, (0.25, 0.75))
    limits = {c: (None, None) if a is None else (a - factor * (b - a), b + factor * (b - a)) for c, (a, b) in found.items()}
    low, high = ({c: F.lit(limits[c][i]).cast("double") for c in columns} for i in (0, 1))
    parts = [F.struct(F.lit(c).alias("column"), F.round(low[c], 6).alias("low"), F.round(high[c], 6).alias("high"), F.count_if((F.col(c) < low[c]) | (F.col(c) > high[c])).alias("outside")) for c in columns]
    return df.agg(*(p.alias(f"_{i}") for i, p in enumerate(parts))).select(F.inline(F.array(*(F.col(f"_{i}") for i in range(len(parts))))))


def correlations(df: DataFrame, columns: list[str], least: float = 0.0) -> DataFrame:
    """Pairs of columns with an absolute Pearson correlation above the threshold."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*(F.round(F.corr(a, b), 6).alias(f"{a}|{b}") for a, b in pairs))
    parts = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs]
    return row.select(F.inline(F.array(*parts))).where(F.abs("r") > least)


def principal_components(df: DataFrame, columns: list[str], k: int) -> tuple[DataFrame, list[float]]:
    """(rows with the first k component scores, explained variance ratios) of standardized columns."""
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler

    gathered = VectorAssembler(inputCols=columns, outputCol="_raw", handleInvalid="skip").transform(df)
    scaled = StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True).fit(gathered).transform(gathered)
    model = PCA(k=k, inputCol="_scaled", outputCol="components").fit(scaled)
    return model.transform(scaled).drop("_raw", "_scaled"), [float(x) for x in model.explainedVariance]


def absorbance(v: Column) -> Column:
    """ln(1 / x) of each part of a spectrum."""
    return F.transform(v, lambda x: F.log(1 / x))


def normal_variate(v: Column) -> Column:
    """A spectrum less its mean, over its deviation (of the sample)."""
    n = F.size(v).cast("double")
    mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.nullif(n, F.lit(0.0))
    deviation = lambda m: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, y: s + (y - m) * (y - m)) / F.nullif(n - 1, F.lit(0.0)))
    # an array of one value names it, so that it is computed once and not for each part
    known = lambda value, use: F.transform(F.array(value), use)[0]
    return known(mean, lambda m: known(deviation(m), lambda d: F.transform(v, lambda x: (x - m) / d)))


def scatter_corrected(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Each spectrum less the offset and over the slope of its regression on the mean spectrum."""
    parts = df.select(key, F.posexplode(vector).alias("i", "x"))
    mean = parts.groupBy("i").agg(F.avg("x").alias("m"))
    fitted = parts.join(mean, "i")
    lines = fitted.groupBy(key).agg(F.regr_slope("x", "m").alias("slope"), F.regr_intercept("x", "m").alias("offset"))
    return fitted.join(lines, key).select(key, "i", ((F.col("x") - F.col("offset")) / F.col("slope")).alias("x"))


class ClassModel(NamedTuple):
    """Of one class the mean and scale of each feature, the first principal axes of the scaled features, and the variance along each."""

    mean: np.ndarray
    scale: np.ndarray
    axes: np.ndarray
    variance: np.ndarray

    def scores(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(q, t2) of each row: the squared residual outside of the axes, and Hotelling's T2 within them."""
        scaled = (vectors - self.mean) / self.scale
        along = scaled @ self.axes
        return ((scaled - along @ self.axes.T) ** 2).sum(axis=1), (along**2 / self.variance).sum(axis=1)


def class_models(df: DataFrame, label: str, vector: str, k: int) -> dict[str, ClassModel]:
    """A model per class, by its label as text, from sums of the vectors and of their products.

    Each task adds up its own rows and sends 1 + d + d^2 sums per class; the driver gets as many per class. Vectors have one length d.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list] = {}
        for batch in batches:
            labels, m = np.array(batch.column("label").to_pylist(), dtype=object), _matrix(batch)
            for c in dict.fromkeys(labels.tolist()):
                rows = m[labels == c]
                add = np.concatenate([[float(len(rows))], rows.sum(axis=0), (rows.T @ rows).ravel()])
                sums[c] = sums[c] + add if c in sums else add
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.float64()))], ["label", "sums"])

    parts = _labelled(df, label, vector).select("label", "vector").mapInArrow(run, "label string, sums array<double>")
    whole = parts.select("label", F.posexplode("sums").alias("at", "x")).groupBy("label", "at").agg(F.sum("x").alias("x"))
    found: dict[str, list] = {}
    for r in whole.orderBy("label", "at").collect():
        found.setdefault(r["label"], []).append(r["x"])
    return {c: _model(np.array(x), k) for c, x in found.items()}


def _model(sums: np.ndarray, k: int) -> ClassModel:
    d = int((np.sqrt(4 * len(sums) - 3) - 1) / 2)
    n, mean = sums[0], sums[1 : d + 1] / sums[0]
    covariance = sums[d + 1 :].reshape(d, d) / n - np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(covariance), 0))
    scale = np.where(spread > 1e-12, spread, 1.0)
    values, axes = np.linalg.eigh(covariance / np.outer(scale, scale) * n / max(n - 1, 1))
    return ClassModel(mean, scale, axes[:, ::-1][:, :k], np.maximum(values[::-1][:k], 1e-12))


def _labelled(df: DataFrame, label: str, vector: str, *others: str) -> DataFrame:
    rows = df.where(F.col(label).isNotNull() & F.col(vector).isNotNull())
    return rows.select(*others, F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("vector"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 0))


def group_quantile(df: DataFrame, group: str, value: str, p: float, name: str) -> DataFrame:
    """(group, name): the exact quantile of each group, linear; the rows are numbered over all partitions, so that a group of any size is spread."""
    placed = numbered(df.select(group, value), F.col(group), F.col(value), name="_at")
    ends = placed.groupBy(group).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    at = F.lit(p) * (F.col("_n") - 1)
    ends = ends.withColumn("_low", F.col("_first") + F.floor(at)).withColumn("_high", F.col("_first") + F.ceil(at)).withColumn("_share", at - F.floor(at))
    near = looked_up(placed, ends, group).where(F.col("_at").isin(F.col("_low"), F.col("_high")))
    low, high = F.max(F.when(F.col("_at") == F.col("_low"), F.col(value))), F.max(F.when(F.col("_at") == F.col("_high"), F.col(value)))
    return near.groupBy(group).agg((low + (high - low) * F.max("_share")).alias(name))


def verified_identities(df: DataFrame, key: str, label: str, vector: str, k: int = 5, q_quantile: float = 0.95, t2_quantile: float = 0.95) -> DataFrame:
    """(key, label, q, t2, accepted, accepting) of each labelled vector: its scores under the model of its class, whether both are within the limits of the
    class, and how many classes' models accept it.

    A class's limits are quantiles of its own rows' scores. Rows with a null label or vector are left out.
    """
    models = class_models(df, label, vector, k)
    rows = _labelled(df, label, vector, key)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch)
            for c, model in models.items():
                q, t2 = model.scores(m) if batch.num_rows else (np.zeros(0), np.zeros(0))
                names = pa.array([c] * batch.num_rows, pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column("label"), names, pa.array(q), pa.array(t2)], [key, "label", "model", "q", "t2"])

    scored = materialized(rows.mapInArrow(run, f"{key} {kind}, label string, model string, q double, t2 double"))
    own = scored.where("label = model").select("label", "q", "t2")
    limits = group_quantile(own, "label", "q", q_quantile, "_q").join(group_quantile(own, "label", "t2", t2_quantile, "_t2"), "label")
    judged = looked_up(scored, limits.withColumnRenamed("label", "model"), "model").withColumn("_ok", (F.col("q") <= F.col("_q")) & (F.col("t2") <= F.col("_t2")))
    mine = lambda c: F.max(F.when(F.col("label") == F.col("model"), F.col(c)))
    return judged.groupBy(key, "label").agg(mine("q").alias("q"), mine("t2").alias("t2"), mine("_ok").alias("accepted"), F.count_if("_ok").alias("accepting"))
