"""What the query modules share."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyaccord.operators.match import sky_match
from skyaccord.plans.fixtures import view, with_views


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that results do not hang on the order of summation; no negative zero."""
    return df.withColumns({c: F.round(c, digits) + 0.0 for c, kind in df.dtypes if kind == "double"})


def sql(text: str, *views: str) -> str:
    """R(x) in the text stands for a rounded double."""
    return with_views(_expand(text), *views)


# Pixels, spectra and prices have seven decimals: six would cut many of them at exactly one half.
def rounded9(df: DataFrame, digits: int = 9) -> DataFrame:
    return rounded(df, digits)


def sql9(text: str, *views: str) -> str:
    return with_views(_expand(text, 9), *views)


def _expand(text: str, digits: int = 6) -> str:
    out, at = [], 0
    for m in re.finditer(r"\bR\(", text):
        if m.start() < at:
            continue
        depth, end = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        out += [text[at : m.start()], "(round(CAST((", text[m.end() : end - 1], f") AS DOUBLE), {digits}) + 0.0)"]
        at = end
    return "".join([*out, text[at:]])


_SEP = """degrees(atan2(sqrt(pow(cos(radians(b.dec))*sin(radians(b.ra - a.ra)), 2)
   + pow(cos(radians(a.dec))*sin(radians(b.dec)) - sin(radians(a.dec))*cos(radians(b.dec))*cos(radians(b.ra - a.ra)), 2)),
   sin(radians(a.dec))*sin(radians(b.dec)) + cos(radians(a.dec))*cos(radians(b.dec))*cos(radians(b.ra - a.ra)))) * 3600"""

_COLUMNS = ("source_id", "ra", "dec", "peak_flux", "e_peak_flux", "total_flux", "xposn", "yposn")

#: Common tables: pairs within one arcsecond, and the one-to-one matches.
MATCHED = f"""pairs AS (
  SELECT * FROM (
    SELECT {', '.join(f'a.{c} AS {c}_1, b.{c} AS {c}_2' for c in _COLUMNS)}, {_SEP} AS sep
    FROM cat_ref a JOIN cat_test b ON b.dec BETWEEN a.dec - 0.001 AND a.dec + 0.001 AND b.ra BETWEEN a.ra - 0.001 AND a.ra + 0.001) AS p
  WHERE sep <= 1.0
), near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id_1 ORDER BY sep, source_id_2) AS k FROM pairs) AS p WHERE k = 1
), m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id_2 ORDER BY sep, source_id_1) AS k2 FROM near) AS p WHERE k2 = 1)"""


def matched(spark: SparkSession, sf_dir: str, mode: str = "one_to_one") -> DataFrame:
    return sky_match(view(spark, sf_dir, "cat_ref"), view(spark, sf_dir, "cat_test"), 1.0, mode)


def matched_sql(text: str) -> str:
    """SQL over m (one-to-one) and pairs (one-to-many)."""
    rest = text.strip()
    rest = ", " + rest[5:] if rest.upper().startswith("WITH ") else " " + rest
    return sql("WITH " + MATCHED + rest, "cat_ref", "cat_test")


def harmonic_sql(points: str, key: str, digits: int) -> str:
    """Common tables after `points` (key, phi, y) and the fit of y by first and second harmonics of phi.

    Each basis column loses what the columns before it explain, so that the squares it explains add up.
    """
    def less(column: str, by: str) -> str:
        return f"{column} - {by}*sum({column}*{by}) OVER w/sum({by}*{by}) OVER w AS {column}"

    def r(e: str) -> str:
        return f"round(CASE WHEN n >= 5 THEN {e} END, {digits}) + 0.0"

    return f""", h0 AS (SELECT {key}, radians(phi) AS t, y FROM {points} WHERE phi IS NOT NULL AND y IS NOT NULL),
h1 AS (SELECT {key}, y - avg(y) OVER w AS y, cos(t) - avg(cos(t)) OVER w AS c, sin(t) - avg(sin(t)) OVER w AS s, cos(2*t) - avg(cos(2*t)) OVER w AS c2, sin(2*t) - avg(sin(2*t)) OVER w AS s2 FROM h0 WINDOW w AS (PARTITION BY {key})),
h2 AS (SELECT {key}, y, c, {less('s', 'c')}, {less('c2', 'c')}, {less('s2', 'c')} FROM h1 WINDOW w AS (PARTITION BY {key})),
h3 AS (SELECT {key}, y, c, s, {less('c2', 's')}, {less('s2', 's')} FROM h2 WINDOW w AS (PARTITION BY {key})),
h4 AS (SELECT {key}, y, c, s, c2, {less('s2', 'c2')}, sum(s2*c2) OVER w/sum(c2*c2) OVER w AS k FROM h3 WINDOW w AS (PARTITION BY {key})),
h5 AS (SELECT {key}, count(*) AS n, sum(y*y) AS tss, max(k) AS k, {', '.join(f'sum(y*{b})/sum({b}*{b}) AS b_{b}, pow(sum(y*{b}), 2)/sum({b}*{b}) AS e_{b}' for b in ('c', 's', 'c2', 's2'))} FROM h4 GROUP BY {key})
SELECT {key}, n, {r('sqrt(pow(b_c2 - k*b_s2, 2) + b_s2*b_s2)')} AS a2, {r('degrees(atan2(b_s2, b_c2 - k*b_s2))/2')} AS psi2, {r('(e_c2 + e_s2)/tss')} AS d_r2, {r('(e_c + e_s + e_c2 + e_s2)/tss')} AS r2 FROM h5"""


def huber_sql(points: str, key: str, name: str, passes: int = 20) -> str:
    """Common tables after `points` (id, key, x, y, base): a line reweighted pass by pass until no weight of its group moves.

    `{name}_fit` has the line of each group, `{name}_in` the points within 1.345 of the last scale.
    """
    line = f"""AS MATERIALIZED (SELECT {key}, count(*) AS n, sum(u) AS s, sum(u*x) AS sx, sum(u*x*x) AS sxx, (sum(u)*sum(u*x*y) - sum(u*x)*sum(u*y))/(sum(u)*sum(u*x*x) - sum(u*x)*sum(u*x)) AS slope,
  (sum(u*x*x)*sum(u*y) - sum(u*x)*sum(u*x*y))/(sum(u)*sum(u*x*x) - sum(u*x)*sum(u*x)) AS intercept, bool_and(abs(w - old) <= 1e-6 + 1e-6*abs(old)) AS settled FROM (SELECT *, greatest(w, 1e-12) AS u FROM {name}_r{{}}) AS t GROUP BY {key})"""
    scale = f"""AS MATERIALIZED (SELECT {key}, CASE WHEN a > 1e-12 THEN a WHEN b > 1e-12 THEN b ELSE 1.0 END AS scale FROM (
  SELECT {key}, median(abs(y - intercept - slope*x)*sqrt(w))/0.6745 AS a, sqrt(sum(w*pow(y - intercept - slope*x, 2))/sum(w)) AS b FROM {name}_r{{0}} JOIN {name}_l{{0}} USING ({key}) GROUP BY {key}) AS t)"""
    out = [f", {name}_r0 AS MATERIALIZED (SELECT *, base AS w, CAST(NULL AS DOUBLE) AS old FROM {points})"]
    for k in range(passes + 1):
        out.append(f"{name}_l{k} {line.format(k)}")
        out.append(f"{name}_s{k} {scale.format(k)}")
        if k < passes:
            z = "(abs(y - intercept - slope*x)*sqrt(w)/scale)"
            step = f"CASE WHEN settled THEN w WHEN {z} > 1.345 THEN base*1.345/{z} ELSE base END"
            out.append(f"{name}_r{k + 1} AS MATERIALIZED (SELECT r.id, {key}, r.x, r.y, r.base, {step} AS w, r.w AS old FROM {name}_r{k} AS r JOIN {name}_l{k} USING ({key}) JOIN {name}_s{k} USING ({key}))")
    every = f"{name}_r{passes} JOIN {name}_l{passes} USING ({key})"
    var = "sum(greatest(w, 1e-12)*pow(y - intercept - slope*x, 2))/greatest(count(*) - 2, 1)"
    out.append(f"""{name}_fit AS (SELECT {key}, count(*) AS n, max(slope) AS slope, max(intercept) AS intercept, sqrt({var}*max(s)/(max(s)*max(sxx) - max(sx)*max(sx))) AS slope_err, sqrt({var}*max(sxx)/(max(s)*max(sxx) - max(sx)*max(sx))) AS intercept_err FROM {every} GROUP BY {key})""")
    out.append(f"{name}_in AS (SELECT id, {key}, x, y, base FROM {every} JOIN {name}_s{passes} USING ({key}) WHERE abs(y - intercept - slope*x)*sqrt(w)/scale <= 1.345)")
    return ",\n".join(out)
