"""Least squares by group: cross-products are summed by Spark, and only the small normal
equations of each group are solved in Python."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def grouped_ols(rows: DataFrame, by: list[str], y: str, x: list[str], order: str | None = None, newey_west: bool = False) -> DataFrame:
    """(by, n, coef, r2[, se]): coef starts with the intercept. Newey-West errors take a
    second pass: products of residuals and regressors with those of the days before."""
    v = [F.lit(1.0), *[F.col(c) for c in x]]
    m = len(v)
    sums = [F.sum(v[i] * v[j]).alias(f"s{i}_{j}") for i in range(m) for j in range(i, m)] + [F.sum(v[i] * F.col(y)).alias(f"y{i}") for i in range(m)]
    g = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col(y) * F.col(y)).alias("yy"), *sums).where(F.col("n") > m)

    def solve(batches):
        for p in batches:
            out = []
            for r in p.to_dict("records"):
                a = np.array([[r[f"s{min(i, j)}_{max(i, j)}"] for j in range(m)] for i in range(m)])
                b = np.array([r[f"y{i}"] for i in range(m)])
                inv = np.linalg.pinv(a)
                coef = inv @ b
                total = r["yy"] - r["y0"] ** 2 / r["n"]
                out.append([*[r[k] for k in by], r["n"], coef.tolist(), float(1 - (r["yy"] - coef @ b) / total) if total else None, inv.ravel().tolist()])
            yield pd.DataFrame(out, columns=[*by, "n", "coef", "r2", "inv"])

    kinds = dict(rows.dtypes)
    shape = ", ".join([*[f"{k} {kinds[k]}" for k in by], "n bigint, coef array<double>, r2 double, inv array<double>"])
    fit = g.mapInPandas(solve, shape)
    if not newey_west:
        return fit.drop("inv")
    vec = F.array(*v)
    u = rows.join(fit.select(*by, "coef", F.col("n").alias("n_")), by)
    dot = F.aggregate(F.zip_with(vec, "coef", lambda a, b: a * b), F.lit(0.0), lambda s, t: s + t)
    u = u.withColumns({"lags": F.floor(4 * F.pow(F.col("n_") / 100, F.lit(2 / 9))), "e": F.col(y) - dot})
    u = u.withColumn("z", F.transform(vec, lambda a: a * F.col("e")))
    w = Window.partitionBy(*by).orderBy(order)
    u = u.withColumn("zs", F.collect_list("z").over(w.rowsBetween(-12, 0)))
    u = u.withColumn("l", F.explode(F.sequence(F.lit(0), F.least(F.col("lags"), F.size("zs") - 1)))).withColumn("zl", F.get("zs", (F.size("zs") - 1 - F.col("l")).cast("int")))
    weight = F.when(F.col("l") == 0, 1.0).otherwise(1 - F.col("l") / (F.col("lags") + 1))
    terms = [F.sum(weight * F.col("z")[i] * F.col("zl")[j]).alias(f"q{i}_{j}") for i in range(m) for j in range(m)]
    zero = [F.sum(F.when(F.col("l") == 0, F.col("z")[i] * F.col("z")[j])).alias(f"d{i}_{j}") for i in range(m) for j in range(m)]
    q = u.groupBy(*by).agg(*terms, *zero).join(fit, by)

    def errors(batches):
        for p in batches:
            out = []
            for r in p.to_dict("records"):
                s = np.array([[r[f"q{i}_{j}"] for j in range(m)] for i in range(m)])
                d = np.array([[r[f"d{i}_{j}"] for j in range(m)] for i in range(m)])
                inv = np.array(r["inv"]).reshape(m, m)
                cov = inv @ (s + s.T - d) @ inv  # the day itself counts once
                out.append([*[r[k] for k in by], r["n"], list(r["coef"]), r["r2"], np.sqrt(np.maximum(np.diag(cov), 0)).tolist()])
            yield pd.DataFrame(out, columns=[*by, "n", "coef", "r2", "se"])

    return q.mapInPandas(errors, shape.replace("inv", "se"))
