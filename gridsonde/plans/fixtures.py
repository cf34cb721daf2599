"""Gridded and profile-shaped views over the supplied star-schema tables.

The view text is plain SQL that Spark SQL and DuckDB read alike: queries use it as DataFrames, the
oracle statements inline it as common table expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

_DEPTH = ("CASE l_linenumber WHEN 1 THEN 0e0 WHEN 2 THEN 10e0 WHEN 3 THEN 30e0 WHEN 4 THEN 75e0 "
          "WHEN 5 THEN 200e0 WHEN 6 THEN 500e0 ELSE 1000e0 END")
_CELL = "CAST(((l_partkey % 100) - (l_partkey % 10)) / 10 AS INT) AS iy, CAST(l_partkey % 10 AS INT) AS ix"

VIEWS: dict[str, str] = {
    # day x cell x depth
    "f_obs": f"""SELECT CAST(l_shipdate AS DATE) AS day, {_CELL}, {_DEPTH} AS depth,
        AVG(2e1 + l_quantity / 5e0) AS theta, AVG(3.3e1 + l_discount * 2e1) AS sp,
        AVG(l_extendedprice / 1e3) AS raw
        FROM {{lineitem}} GROUP BY 1, 2, 3, 4""",
    # one column of up to seven levels per part: the number of columns grows with the data
    "f_column": f"""SELECT CAST(l_partkey AS BIGINT) AS cid, {_DEPTH} AS depth,
        3e1 - 2e-2 * ({_DEPTH}) + (AVG(l_quantity) - 25e0) / 1e2 AS theta,
        3.45e1 + 1e-3 * ({_DEPTH}) + (AVG(l_discount) - 5e-2) * 2e0 AS sp
        FROM {{lineitem}} GROUP BY CAST(l_partkey AS BIGINT), l_linenumber""",
    # the same with missing values: partial columns and columns with too few levels
    "f_gappy": """SELECT cid, depth, sp,
        CASE WHEN cid % 4 = 0 AND depth IN (0e0, 75e0, 1000e0) THEN NULL
             WHEN cid % 7 = 3 AND depth > 1e1 THEN NULL ELSE theta END AS theta
        FROM {f_column}""",
    # columns with inversions: the means of the rows swing by several degrees around 26 and 20
    "f_inverted": f"""SELECT CAST(l_partkey AS BIGINT) AS cid, {_DEPTH} AS depth,
        27e0 - 9e-3 * ({_DEPTH}) + (AVG(l_quantity) - 25.5e0) / 8e0 AS theta,
        3.45e1 + 1e-3 * ({_DEPTH}) + (AVG(l_discount) - 5e-2) * 2e0 AS sp
        FROM {{lineitem}} GROUP BY CAST(l_partkey AS BIGINT), l_linenumber""",
    # one seven-level column per cell
    "f_profile": """SELECT iy, ix, 5.125e0 + 0.25e0 * iy AS lat, 45.125e0 + 0.25e0 * ix AS lon, depth,
        3e1 - 2e-2 * depth + (AVG(theta) - 25.1e0) / 5e1 AS theta,
        3.45e1 + 1e-3 * depth + (AVG(sp) - 3.4e1) / 2e1 AS sp
        FROM {f_obs} GROUP BY iy, ix, depth""",
    # one wind vector per cell and month
    "f_wind": f"""SELECT CAST(YEAR(l_shipdate) * 100 + MONTH(l_shipdate) AS INT) AS ym, {_CELL},
        AVG(l_discount) * 1e2 AS u10, AVG(l_tax) * 1e2 AS v10
        FROM {{lineitem}} GROUP BY 1, 2, 3""",
    # elevation per cell, about half of it land
    "f_elev": """SELECT CAST(((c_custkey % 100) - (c_custkey % 10)) / 10 AS INT) AS iy,
        CAST(c_custkey % 10 AS INT) AS ix, AVG(c_acctbal) - 4.5e3 AS elevation_m
        FROM {customer} GROUP BY 1, 2""",
    # a mostly wet mask (a quarter land) for gradient tests
    "f_mask": """SELECT iy, ix, elevation_m, elevation_m >= 3e2 AS land FROM {f_elev}""",
    "f_series": "SELECT event_type AS series, CAST(ts AS TIMESTAMP) AS ts, value FROM {events}",
    # daily means per series
    "f_daily": """SELECT series, CAST(ts AS DATE) AS day, AVG(value) AS value FROM {f_series} GROUP BY 1, 2""",
    # scattered in-situ samples with quality flags
    "f_insitu": """SELECT event_id AS obs_id, user_id AS platform, CAST(ts AS TIMESTAMP) AS ts,
        5.125e0 + 0.25e0 * (user_id % 10) + 0.0007e0 * (event_id % 100) AS lat,
        45.125e0 + 0.25e0 * ((user_id * 7) % 10) + 0.0009e0 * (event_id % 100) AS lon,
        CAST((event_id * 37) % 1000 AS DOUBLE) AS depth,
        2.9e1 - 1.9e-2 * ((event_id * 37) % 1000) + value / 1e3 AS temp,
        3.45e1 + 1e-3 * ((event_id * 37) % 1000) - value / 2e3 AS psal,
        CAST(1 + event_id % 4 AS INT) AS qc
        FROM {events}""",
    # model days: every fourth day, so that every time-distance class occurs
    "f_model_day": """SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS t_model, AVG(value) AS scale
        FROM {events} WHERE DAY(ts) % 4 = 0 GROUP BY 1""",
    # model cube on seven days, every fourth one
    "f_model": f"""SELECT CAST(DATE '2024-01-04' + CAST(4 * (DAY(l_shipdate) % 7) AS INT) AS TIMESTAMP) AS t_model,
        {_CELL}, {_DEPTH} AS depth, 3e1 - 2e-2 * ({_DEPTH}) + (AVG(l_quantity) - 25e0) / 1e2 AS theta,
        3.45e1 + 1e-3 * ({_DEPTH}) + (AVG(l_discount) - 5e-2) * 2e0 AS sp
        FROM {{lineitem}} GROUP BY 1, 2, 3, l_linenumber""",
    # prediction, truth and spread
    "f_pred": """SELECT day, iy, ix, 5.125e0 + 0.25e0 * iy AS lat, depth, theta AS obs,
        theta + (raw - 3.8e1) / 4e1 AS pred, sp AS obs_sp, sp + (raw - 3.8e1) / 2e2 AS pred_sp,
        2e-1 + sp / 4e1 - 8e-1 AS sigma FROM {f_obs}""",
    # repeated predictions per column and level
    "f_ensemble": """SELECT l_suppkey % 10 AS member, CAST(l_partkey AS BIGINT) AS cid, CAST(l_linenumber AS INT) AS k,
        AVG(l_quantity) AS pred, AVG(l_tax) AS sigma FROM {lineitem} GROUP BY 1, 2, 3""",
}

_REF = re.compile(r"\{(\w+)\}")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of ``sf_dir`` or a view over it."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    parts = {ref: view(spark, sf_dir, ref) for ref in set(_REF.findall(text))}
    return spark.sql(text, **parts)


def with_views(*names: str) -> str:
    """``WITH`` clause text (without the keyword) defining views in dependency order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in TABLES or name in order:
            return
        for ref in _REF.findall(VIEWS[name]):
            visit(ref)
        order.append(name)

    for name in names:
        visit(name)
    return ", ".join(f"{n} AS ({_REF.sub(lambda m: m.group(1), VIEWS[n])})" for n in order)
