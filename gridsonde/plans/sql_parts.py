"""Reusable oracle SQL: cubic interpolation by window functions."""

from __future__ import annotations

from collections.abc import Sequence

# Value of a knot interval at depth z, in the four-basis Hermite form.
_T = "((z - z0) / (z1 - z0))"
SEG_VALUE = (f"((2 * POW({_T}, 3) - 3 * POW({_T}, 2) + 1) * y0 + (POW({_T}, 3) - 2 * POW({_T}, 2) + {_T}) * (z1 - z0) * d0"
             f" + (3 * POW({_T}, 2) - 2 * POW({_T}, 3)) * y1 + (POW({_T}, 3) - POW({_T}, 2)) * (z1 - z0) * d1)")


def PCHIP(name: str, src: str, keys: Sequence[str], z: str, v: str) -> str:
    """CTEs ending in ``<name>_seg``: knot intervals of each usable column with both end slopes."""
    k = ", ".join(keys)
    w = f"(PARTITION BY {k} ORDER BY z0)"
    edge = ("CASE WHEN SIGN({d}) <> SIGN({m}) THEN 0e0 WHEN SIGN({m}) <> SIGN({m2}) AND ABS({d}) > 3 * ABS({m}) THEN 3 * {m} ELSE {d} END")
    head = edge.format(d="(((2 * hn + hnn) * mn - hn * mnn) / (hn + hnn))", m="mn", m2="mnn")
    tail = edge.format(d="(((2 * hp + hpp) * mp - hp * mpp) / (hp + hpp))", m="mp", m2="mpp")
    return f"""{name}_a AS (SELECT {k}, {z} AS z0, {v} AS y0, COUNT(*) OVER (PARTITION BY {k}) AS n_all FROM {src}),
{name}_b AS (SELECT *, COUNT(*) OVER (PARTITION BY {k}) AS n, z0 - LAG(z0) OVER {w} AS hp, LEAD(z0) OVER {w} - z0 AS hn,
    (y0 - LAG(y0) OVER {w}) / (z0 - LAG(z0) OVER {w}) AS mp, (LEAD(y0) OVER {w} - y0) / (LEAD(z0) OVER {w} - z0) AS mn
    FROM {name}_a WHERE y0 IS NOT NULL),
{name}_c AS (SELECT *, LAG(hp) OVER {w} AS hpp, LAG(mp) OVER {w} AS mpp, LEAD(hn) OVER {w} AS hnn, LEAD(mn) OVER {w} AS mnn FROM {name}_b),
{name}_d AS (SELECT *, CASE WHEN n = 2 THEN COALESCE(mn, mp) WHEN hp IS NULL THEN {head} WHEN hn IS NULL THEN {tail}
    WHEN mp * mn <= 0 THEN 0e0 ELSE 3 * (hp + hn) / ((2 * hn + hp) / mp + (hn + 2 * hp) / mn) END AS d0 FROM {name}_c),
{name}_e AS (SELECT *, LEAD(z0) OVER {w} AS z1, LEAD(y0) OVER {w} AS y1, LEAD(d0) OVER {w} AS d1, n = n_all AS complete,
    hp IS NULL AS is_first, hnn IS NULL AS is_last FROM {name}_d),
{name}_seg AS (SELECT * FROM {name}_e WHERE z1 IS NOT NULL AND (n >= 3 OR (complete AND n >= 2)))"""


def metre_profile(name: str) -> str:
    """CTE ``<name>_m``: the interpolated value of every whole metre."""
    return f"""{name}_m AS (SELECT cid, z, {SEG_VALUE} AS v FROM {name}_seg
    JOIN (SELECT UNNEST(GENERATE_SERIES(0, 1000)) AS z) ON (z >= z0 OR (is_first AND complete)) AND (z < z1 OR (is_last AND z <= z1)))"""


def level_values(out: str, name: str, levels: Sequence[float], keys: Sequence[str] = ("cid",)) -> str:
    """CTE: value at fixed levels; the top value above the range, NULL below it or for unusable columns."""
    zs = ", ".join(f"{float(z)!r}e0" for z in levels)
    k, qk = ", ".join(keys), ", ".join(f"q.{c}" for c in keys)
    on = " AND ".join(f"s.{c} = q.{c}" for c in keys)
    return f"""{out}_q AS (SELECT {k}, depth, GREATEST(depth, top) AS z FROM (SELECT {k}, MIN(z0) AS top FROM {name}_b GROUP BY {k}),
    (SELECT UNNEST([{zs}]) AS depth)),
{out} AS (SELECT {qk}, q.depth, {SEG_VALUE} AS v FROM {out}_q q LEFT JOIN {name}_seg s
    ON {on} AND q.z >= s.z0 AND (q.z < s.z1 OR (s.is_last AND q.z <= s.z1)))"""
