"""DuckDB SQL twins of the registered queries (the correctness oracle).

Each statement starts from the driver's tables with the same stand-in views
as ``sources.fixtures`` written as CTEs.  Literals in arithmetic are cast to
DOUBLE so that DuckDB does not switch to DECIMAL arithmetic; sums over
integers are cast to BIGINT.  Floating results whose last digits depend on
summation order are rounded half to even in both engines.
"""

from __future__ import annotations

import math

from .. import schema as S

D = "CAST({} AS DOUBLE)".format


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _band(expr: str, cuts, labels=None) -> str:
    labels = labels if labels is not None else list(range(1, len(cuts) + 2))
    arms = " ".join(f"WHEN {expr} < {D(c)} THEN {_lit(l)}" for c, l in zip(cuts, labels[:-1]))
    return f"CASE {arms} WHEN {expr} IS NOT NULL THEN {_lit(labels[-1])} END"


def _lit(v) -> str:
    return _q(v) if isinstance(v, str) else str(v)


def _label(idx: str, labels, missing: str | None = None) -> str:
    arms = " ".join(f"WHEN {idx} = {i} THEN {_q(l)}" for i, l in enumerate(labels, start=1))
    tail = f" WHEN {idx} IS NULL THEN {_q(missing)}" if missing is not None else ""
    return f"CASE {arms}{tail} END"


def _bmi(h: str, w: str) -> str:
    return f"{w} / (({h} / {D(100)}) * ({h} / {D(100)}))"


def _re(expr: str, digits: int) -> str:
    """Round half to even at ``digits`` decimals, as ``rint(x*10^d)/10^d``."""
    k = D(float(10 ** digits))
    return f"round_even(({expr}) * {k}, 0) / {k}"


def _q7(col: str, p: float) -> str:
    """Type-7 quantile of ``col`` in the current group, written out:
    ``x[floor h] + (x[ceil h] - x[floor h]) * (h - floor h)``, h = (n-1)p."""
    arr = f"list_sort(list({col}) FILTER (WHERE {col} IS NOT NULL))"
    h = f"((COUNT({col}) - 1) * {D(p)})"
    lo = f"{arr}[CAST(floor({h}) AS BIGINT) + 1]"
    hi = f"{arr}[CAST(ceil({h}) AS BIGINT) + 1]"
    return f"(CASE WHEN {lo} = {hi} THEN {lo} ELSE {lo} + ({hi} - {lo}) * ({h} - floor({h})) END)"


def _q5(col: str, p: float) -> str:
    """Chart-library linear quartile: position ``Np - 1/2`` clamped to ``[0, N-1]``."""
    arr = f"list_sort(list({col}) FILTER (WHERE {col} IS NOT NULL))"
    n = f"CAST(COUNT({col}) AS DOUBLE)"
    h = f"LEAST(GREATEST({n} * {D(p)} - {D(0.5)}, {D(0)}), {n} - {D(1)})"
    lo = f"{arr}[CAST(floor({h}) AS BIGINT) + 1]"
    hi = f"{arr}[CAST(ceil({h}) AS BIGINT) + 1]"
    return f"(CASE WHEN {lo} = {hi} THEN {lo} ELSE {lo} + ({hi} - {lo}) * ({h} - floor({h})) END)"


_VALID = " AND ".join(
    f"{c} BETWEEN {D(lo)} AND {D(hi)}" for c, (lo, hi) in S.VALID_RANGES.items())

BASE = f"""
m AS (
  SELECT o_orderkey AS person_id,
         CASE WHEN o_custkey % 50 = 0 THEN NULL
              WHEN o_custkey % 20 < 9 THEN 'female' ELSE 'male' END AS gender,
         CASE WHEN o_orderkey % 97 = 0 THEN NULL
              ELSE CAST(15 + o_orderkey % 50 AS INTEGER) END AS age,
         {D(140)} + ((o_orderkey * 7919 + o_custkey * 31) % 750) / {D(10)} AS height,
         {D(30)} + ((o_orderkey * 104729 + o_custkey * 17) % 950) / {D(10)} AS weight
  FROM orders),
v AS (SELECT * FROM m WHERE {_VALID}),
xb AS (SELECT *, {_bmi('height', 'weight')} AS BMI FROM v),
x AS (SELECT *, CAST({_band('BMI', S.BMI_CUTS)} AS INTEGER) AS BMI_Index,
             {_band('age', S.AGE_CUTS, S.AGE_LABELS)} AS age_interval FROM xb),
xl AS (SELECT *, {_label('BMI_Index', S.BMI_LABELS_SHORT)} AS BMI_Category FROM x),
sub AS (
  SELECT user_id, event_id, ts,
         {D(140)} + ((event_id * 7919 + user_id * 31) % 750) / {D(10)} AS height,
         {D(30)} + ((event_id * 104729 + user_id * 17) % 950) / {D(10)} AS weight
  FROM events),
lg AS (
  SELECT user_id, event_id, ts AS "timestamp", CAST(15 + user_id % 50 AS INTEGER) AS age,
         CASE WHEN user_id % 20 < 9 THEN 'Female' ELSE 'Male' END AS gender,
         height AS height_cm, weight AS weight_kg
  FROM sub),
scored AS (
  SELECT *, CAST({_band('bmi', S.BMI_CUTS)} AS INTEGER) AS "index",
         {_label(_band('bmi', S.BMI_CUTS), S.BMI_LABELS_LONG)} AS category
  FROM (SELECT *, {_bmi('height_cm', 'weight_kg')} AS bmi FROM lg
        WHERE age > 0 AND height_cm > 0 AND weight_kg > 0)),
pv AS (SELECT BMI AS value, COUNT(*) AS n FROM x GROUP BY 1),
steps AS (SELECT value, SUM(n) OVER (ORDER BY value) AS le, n AS eq,
                 SUM(n) OVER () AS total FROM pv)
"""


def _with(body: str, extra: str = "") -> str:
    ctes = BASE.strip()
    if extra:
        ctes += ",\n" + extra.strip()
    return f"WITH {ctes}\n{body.strip()}"


def _rank(probes: str, col: str) -> str:
    """Probe rows with percentile (<=), below (<) and above, via ASOF join."""
    return f"""
SELECT p.*,
       {D(100)} * (COALESCE(s.le, 0) / (SELECT COUNT(*) FROM x)) AS percentile,
       {D(100)} * ((COALESCE(s.le, 0) - CASE WHEN s.value = p.{col} THEN s.eq ELSE 0 END)
                   / (SELECT COUNT(*) FROM x)) AS below,
       {D(100)} - {D(100)} * ((COALESCE(s.le, 0) - CASE WHEN s.value = p.{col} THEN s.eq ELSE 0 END)
                   / (SELECT COUNT(*) FROM x)) AS above
FROM {probes} p ASOF LEFT JOIN steps s ON p.{col} >= s.value"""


_LATEST_SUB = """(SELECT * FROM sub QUALIFY row_number() OVER
                  (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)"""

_USERS = f"""
users AS (SELECT user_id, event_id, ts, height, weight, {_bmi('height', 'weight')} AS user_bmi
          FROM {_LATEST_SUB}),
ranked AS ({_rank('users', 'user_bmi')})
"""

_GENDER_COUNTS = """
SELECT BMI_Index,
       CAST(SUM(CASE WHEN gender = 'female' THEN 1 END) AS BIGINT) AS Female_Count,
       CAST(SUM(CASE WHEN gender = 'male' THEN 1 END) AS BIGINT) AS Male_Count
FROM x GROUP BY BMI_Index"""

_GENDER_PROPS = f"""
SELECT *, Female_Count / (Female_Count + Male_Count) AS Female_Proportion,
       Male_Count / (Female_Count + Male_Count) AS Male_Proportion
FROM ({_GENDER_COUNTS})"""


def _box(src: str, col: str, key: str) -> str:
    k = D(S.BOX_WHISKER)
    return f"""
b AS (SELECT {key}, COUNT(*) AS n, AVG({col}) AS mean, MIN({col}) AS "min", MAX({col}) AS "max",
             {_q5(col, 0.25)} AS q1, {_q5(col, 0.5)} AS median,
             {_q5(col, 0.75)} AS q3
      FROM {src} WHERE {col} IS NOT NULL GROUP BY {key}),
f AS (SELECT *, q3 - q1 AS iqr, q1 - {k} * (q3 - q1) AS lower_fence,
             q3 + {k} * (q3 - q1) AS upper_fence FROM b),
w AS (SELECT f.{key}, MIN(s.{col}) AS whisker_low, MAX(s.{col}) AS whisker_high
      FROM f JOIN {src} s ON s.{key} = f.{key}
      WHERE s.{col} >= f.lower_fence AND s.{col} <= f.upper_fence GROUP BY f.{key}),
box AS (SELECT f.* REPLACE ({_re('f.mean', 9)} AS mean), w.whisker_low, w.whisker_high
        FROM f JOIN w ON f.{key} = w.{key})
"""


def _chisq(src: str, a: str, b: str, name: str, texts) -> str:
    """Dense table, Pearson statistic and p-value: closed form for even dof,
    ``1 - P(dof/2, stat/2)`` by its power series for odd dof."""
    return f"""
cells AS (SELECT {a} AS a, {b} AS b, COUNT(*) AS n FROM {src}
          WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL),
dense AS (SELECT ra.a, cb.b, COALESCE(cells.n, 0) AS n
          FROM (SELECT DISTINCT a FROM cells) ra CROSS JOIN (SELECT DISTINCT b FROM cells) cb
          LEFT JOIN cells ON cells.a = ra.a AND cells.b = cb.b),
ex AS (SELECT a, b, CAST(n AS DOUBLE) AS o,
              SUM(n) OVER (PARTITION BY a) * SUM(n) OVER (PARTITION BY b) / SUM(n) OVER () AS e
       FROM dense),
st AS (SELECT SUM((o - e) * (o - e) / e) AS statistic,
              CAST((COUNT(DISTINCT a) - 1) * (COUNT(DISTINCT b) - 1) AS INTEGER) AS dof,
              CAST(SUM(o) AS BIGINT) AS n FROM ex),
pv2 AS (SELECT *, CASE WHEN statistic <= 0 THEN {D(1)}
                       WHEN dof % 2 = 0 THEN LEAST({D(1)}, list_sum(list_transform(
                    range(0, dof // 2),
                    lambda i: exp(i * ln(statistic / 2) - lgamma(i + 1) - statistic / 2))))
                       ELSE {D(1)} - list_sum(list_transform(range(0, 400),
                    lambda j: exp((dof / 2 + j) * ln(statistic / 2) - statistic / 2
                                  - lgamma(dof / 2 + j + 1)))) END AS p_value
        FROM st),
res AS (SELECT {_q(name)} AS test, {_re('statistic', 6)} AS statistic, dof, n,
               {_re('p_value', 9)} AS p_value, p_value < {D(S.ALPHA)} AS significant,
               CASE WHEN p_value < {D(S.ALPHA)} THEN {_q(texts[0])} ELSE {_q(texts[1])} END
                 AS interpretation
        FROM pv2)
"""


_NORM = repr(1.0 / math.sqrt(2 * math.pi))


def _density(grid: int = 64) -> str:
    k, div, span = D(S.KDE_BW_FACTOR), D(S.KDE_IQR_DIVISOR), D(S.KDE_SPAN)
    return f"""
d AS (SELECT gender, BMI AS v FROM x WHERE gender IN ('female', 'male') AND BMI IS NOT NULL),
st AS (SELECT gender, COUNT(*) AS n, MIN(v) AS lo, MAX(v) AS hi, stddev_samp(v) AS sd,
              {_q5('v', 0.75)} - {_q5('v', 0.25)} AS iqr FROM d GROUP BY gender),
pr0 AS (SELECT *, CASE WHEN LEAST(sd, iqr / {div}) > 0 THEN LEAST(sd, iqr / {div})
                       ELSE sd END AS spread FROM st),
pr AS (SELECT gender, n, lo, hi,
              CASE WHEN {k} * spread * pow(CAST(n AS DOUBLE), {D(-0.2)}) > 0
                   THEN {k} * spread * pow(CAST(n AS DOUBLE), {D(-0.2)}) ELSE {D(1)} END AS bw
       FROM pr0),
vc AS (SELECT gender, v, COUNT(*) AS c FROM d GROUP BY ALL),
ex AS (SELECT pr.gender, bw, n, g.g, v, c,
              (lo - {span} * bw) + g.g * (((hi + {span} * bw) - (lo - {span} * bw)) / {D(max(grid - 1, 1))}) AS gx
       FROM pr JOIN vc ON vc.gender = pr.gender, (SELECT range AS g FROM range(0, {grid})) g)
"""


def _density_body() -> str:
    """The exact kernel sum over all distinct values."""
    z = "(gx - v) / bw"
    return f"""
SELECT gender, CAST(g AS INTEGER) AS point, {_re('FIRST(gx)', 9)} AS x,
       {_re(f'SUM(c * exp({D(-0.5)} * ({z}) * ({z}))) * {_NORM} / (FIRST(n) * FIRST(bw))', 5)}
         AS density
FROM ex GROUP BY gender, g"""


_EXAMPLE = D(68.0 / ((160.0 / 100.0) * (160.0 / 100.0)))
_EXAMPLE_2 = D(round(68.0 / ((160.0 / 100.0) * (160.0 / 100.0)), 2))

_STRING_COLS = ["person_id", "gender", "age", "height", "weight"]


def _profile() -> str:
    parts = []
    for i, c in enumerate(_STRING_COLS):
        num = "CAST(NULL AS DOUBLE)" if c == "gender" else f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT {_q(c)} AS \"column\", {i} AS position, COUNT(*) AS n_rows, "
            f"COUNT(*) FILTER (WHERE {c} IS NULL) AS n_missing, MIN({num}) AS \"min\", "
            f"MAX({num}) AS \"max\", {_re(f'AVG({num})', 6)} AS mean, "
            + ", ".join(f"{_q7(num, p) if c != 'gender' else num} AS {n}" for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)))
            + " FROM m")
    return "\nUNION ALL\n".join(parts)


def _given(kinds: int) -> str:
    """People with rounded measures and the given BMI of the first ``kinds`` rests by 13, else the computed one."""
    values = ("22.5", "0", "-3.25", None, "100", None, "'NaN'", "'inf'", "'-inf'")[:kinds]
    arms = " ".join(f"WHEN {i} THEN CAST({v} AS DOUBLE)" for i, v in enumerate(values) if v)
    return f"""
SELECT *, COALESCE(CASE person_id % 13 {arms} END,
                   {_bmi('CAST(height AS DOUBLE)', 'CAST(weight AS DOUBLE)')}) AS BMI FROM (
  SELECT person_id, gender, age, CAST(round_even(height, 0) AS INTEGER) AS height,
         CAST(round_even(weight, 0) AS INTEGER) AS weight FROM m)"""


def _reasons() -> str:
    arms = []
    for c, (lo, hi) in S.VALID_RANGES.items():
        arms.append(f"CASE WHEN {c} IS NULL THEN '{c}:missing' "
                    f"WHEN NOT ({c} BETWEEN {D(lo)} AND {D(hi)}) THEN '{c}:range' END")
    return "concat_ws(',', " + ", ".join(arms) + ")"


def _fmt2(e: str) -> str:
    return f"printf('%.2f', {_re(e, 2)})"


ORACLE: dict[str, str] = {
    # sources and sinks
    "read_people": _with("SELECT person_id, gender, CAST(age AS DOUBLE) AS age, height, weight FROM m"),
    "read_mixed": _with(f"""
SELECT 'people' AS source, person_id AS row_id, height, weight, CAST(NULL AS DOUBLE) AS BMI,
       CAST(NULL AS DOUBLE) AS BMI_index, lower(trim(gender)) AS gender, CAST(age AS DOUBLE) AS age FROM m
UNION ALL
SELECT 'log', event_id, height_cm, weight_kg, NULL, NULL, lower(trim(gender)) AS gender, CAST(age AS DOUBLE) FROM lg"""),
    "write_clean": _with("SELECT * FROM v"),
    "write_enriched": _with("SELECT * FROM x"),
    "write_pivot": _with(_GENDER_PROPS),
    "append_submissions": _with(f"""
SELECT strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS "timestamp", printf('%d', age) AS age, gender,
       {_fmt2('height_cm')} AS height_cm, {_fmt2('weight_kg')} AS weight_kg, {_fmt2('bmi')} AS bmi,
       printf('%d', "index") AS "index", category
FROM scored"""),
    # cleaning
    "safe_numeric": _with("""
SELECT event_id, TRY_CAST(CAST(value AS VARCHAR) AS DOUBLE) AS value_num,
       TRY_CAST(props AS DOUBLE) AS props_num FROM events"""),
    "valid_rows": _with("SELECT * FROM v"),
    "invalid_rows": _with(f"SELECT *, {_reasons()} AS reasons FROM m WHERE NOT COALESCE({_VALID}, FALSE)"),
    "round_measure": _with(f"""
SELECT person_id, gender, age, {_re('height', 1)} AS height, {_re('weight', 1)} AS weight FROM m"""),
    "round_int": _with("""
SELECT person_id, gender, age, CAST(round_even(height, 0) AS INTEGER) AS height,
       CAST(round_even(weight, 0) AS INTEGER) AS weight FROM m"""),
    "fill_derived": _with(_given(6)),
    "finite_positive": _with(f"""
SELECT * FROM ({_given(9)})
WHERE BMI IS NOT NULL AND isfinite(BMI) AND BMI > 0"""),
    "require_rows": _with("SELECT COUNT(*) AS n FROM m"),
    "valid_submission": _with("""
SELECT user_id, event_id, age, height_cm, weight_kg FROM lg
WHERE age > 0 AND height_cm > 0 AND weight_kg > 0
  AND event_id % 29 > 3 AND event_id % 31 > 3 AND event_id % 37 > 3"""),
    "complete_cases": _with("SELECT * FROM m WHERE gender IS NOT NULL AND age IS NOT NULL"),
    "gender_subset": _with("SELECT * FROM x WHERE gender = 'male'"),
    "profile": _with(_profile()),
    "preview": _with("SELECT * FROM x ORDER BY person_id LIMIT 5"),
    # projections
    "bmi": _with(f"SELECT person_id, {_bmi('height', 'weight')} AS BMI FROM m"),
    "band_index": _with(f"""
SELECT person_id, CAST({_band(_bmi('height', 'weight'), S.BMI_CUTS)} AS INTEGER) AS BMI_Index FROM m"""),
    "band_label": _with("SELECT person_id, BMI_Category FROM xl"),
    "band_label_long": _with(f"SELECT person_id, {_label('BMI_Index', S.BMI_LABELS_LONG)} AS category FROM x"),
    "age_interval": _with(f"SELECT person_id, {_band('age', S.AGE_CUTS, S.AGE_LABELS)} AS age_interval FROM m"),
    "percentile_text": _with(f"""
SELECT person_id, percentile, {_band('percentile', S.PERCENTILE_CUTS, S.PERCENTILE_TEXTS)} AS interpretation
FROM (SELECT person_id, {D(100)} * cume_dist() OVER (ORDER BY BMI) AS percentile FROM x)"""),
    "default_level": _with(f"""
SELECT person_id, COALESCE(gender, 'Unknown') AS gender,
       CASE WHEN cat IN ({", ".join(_q(c) for c in S.BMI_LABELS_SHORT)}) THEN cat
            WHEN cat IS NOT NULL THEN 'Other' END AS category
FROM (SELECT person_id, gender, CASE person_id % 17 WHEN 0 THEN 'Normal' WHEN 1 THEN 'Gigantic' WHEN 2 THEN 'normal' ELSE
             {_label(_band(_bmi('height', 'weight'), S.BMI_CUTS), S.BMI_LABELS_SHORT, 'Missing')} END AS cat
      FROM m)"""),
    "score_person": _with(f"""
SELECT user_id, event_id, {_re('b', 2)} AS bmi, CAST({_band('b', S.BMI_CUTS)} AS INTEGER) AS bmi_index,
       {_label(_band('b', S.BMI_CUTS), S.BMI_LABELS_SHORT)} AS bmi_category
FROM (SELECT *, {_bmi('height', 'weight')} AS b FROM sub)"""),
    "format_report": _with(f"""
SELECT user_id, {_fmt2('user_bmi')} AS bmi_text,
       printf('%.1f%%', {_re('percentile', 1)}) AS percentile_text,
       printf('%.1f%%', {_re('below', 1)}) AS below_text
FROM ranked""", _USERS),
    # aggregations
    "distinct_levels": _with("SELECT DISTINCT gender FROM x"),
    "count_by_gender": _with('SELECT gender, COUNT(*) AS "Count" FROM x GROUP BY gender'),
    "count_band_age": _with('SELECT BMI_Index, age_interval, COUNT(*) AS "count" FROM x GROUP BY ALL'),
    "count_gender_band": _with('SELECT gender, BMI_Index, COUNT(*) AS "Count" FROM x GROUP BY ALL'),
    "count_category_gender": _with("""
SELECT COALESCE(gender, 'Unknown') AS gender, COALESCE(BMI_Category, 'Missing') AS cat,
       COUNT(*) AS "count" FROM xl GROUP BY ALL"""),
    "all_counts": _with("""
SELECT gender, BMI_Index, age_interval, GROUPING(gender, BMI_Index, age_interval) AS set_id,
       COUNT(*) AS "count"
FROM x GROUP BY GROUPING SETS ((gender), (BMI_Index, age_interval), (gender, BMI_Index))"""),
    "pct_within_band": _with(f"""
SELECT BMI_Index, age_interval, "count",
       {_re(f'{D(100)} * "count" / SUM("count") OVER (PARTITION BY BMI_Index)', 1)} AS pct_within_bmi
FROM (SELECT BMI_Index, age_interval, COUNT(*) AS "count" FROM x GROUP BY ALL)"""),
    "pct_pivot": _with("SELECT BMI_Index, " + ", ".join(
        f"MAX(CASE WHEN age_interval = {_q(lv)} THEN pct END) AS \"{lv}\"" for lv in S.AGE_LABELS) + f"""
FROM (SELECT BMI_Index, age_interval,
             {_re(f'{D(100)} * "count" / SUM("count") OVER (PARTITION BY BMI_Index)', 1)} AS pct
      FROM (SELECT BMI_Index, age_interval, COUNT(*) AS "count" FROM x GROUP BY ALL))
GROUP BY BMI_Index"""),
    "pct_of_total": _with(f"""
SELECT BMI_Category, "Count",
       {_re(f'"Count" / GREATEST(SUM("Count") OVER (), 1) * {D(100)}', 2)} AS "Percent"
FROM (SELECT BMI_Category, COUNT(*) AS "Count" FROM xl WHERE BMI_Category IS NOT NULL GROUP BY 1)"""),
    "gender_pivot": _with(_GENDER_COUNTS),
    "gender_proportions": _with(_GENDER_PROPS),
    "contingency": _with("""
SELECT ra.age_interval, cb.BMI_Index, COALESCE(c.n, 0) AS n
FROM (SELECT DISTINCT age_interval FROM x WHERE age_interval IS NOT NULL AND BMI_Index IS NOT NULL) ra
CROSS JOIN (SELECT DISTINCT BMI_Index FROM x WHERE age_interval IS NOT NULL AND BMI_Index IS NOT NULL) cb
LEFT JOIN (SELECT age_interval, BMI_Index, COUNT(*) AS n FROM x GROUP BY ALL) c
  ON c.age_interval = ra.age_interval AND c.BMI_Index = cb.BMI_Index"""),
    "mean_by_age": _with(f"""
SELECT age, {_re('AVG(weight)', 9)} AS Mean_Weight FROM x
WHERE age IS NOT NULL AND weight IS NOT NULL GROUP BY age"""),
    "share_at_least": _with(f"""
SELECT {D(100)} * AVG(CAST(BMI >= {D(S.OVERWEIGHT_CUT)} AS INTEGER)) AS overweight_share FROM x"""),
    "cohort_summary": _with(f"""
SELECT user_id, user_bmi, percentile, below, above, (SELECT COUNT(*) FROM x) AS "N",
       (SELECT {D(100)} * AVG(CAST(BMI >= {D(S.OVERWEIGHT_CUT)} AS INTEGER)) FROM x) AS overweight_share
FROM ({_rank(f"(SELECT user_id, {_bmi('height', 'weight')} AS user_bmi FROM {_LATEST_SUB})", 'user_bmi')})"""),
    # distributions
    "quantiles": _with(f"""
SELECT CAST(0.1 AS DOUBLE) AS p, {_q7('BMI', 0.1)} AS q FROM x
UNION ALL SELECT CAST(0.9 AS DOUBLE), {_q7('BMI', 0.9)} FROM x"""),
    "quantiles_approx": _with("""
SELECT p, (SELECT COUNT(BMI) FROM x) AS n, TRUE AS within
FROM (VALUES (0.1::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE)) AS t(p)"""),
    "quantiles_sketch": _with("""
SELECT event_type, p, n, TRUE AS within
FROM (SELECT event_type, COUNT(value) AS n FROM events WHERE NOT isnan(value) GROUP BY event_type),
     (VALUES (0.1::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE)) AS t(p)"""),
    "ecdf": _with("""
SELECT value, n, CAST(SUM(n) OVER (ORDER BY value) AS BIGINT) AS cum,
       CAST(SUM(n) OVER () AS BIGINT) AS total,
       SUM(n) OVER (ORDER BY value) / SUM(n) OVER () AS cdf
FROM pv"""),
    "percentile_of": _with(f"""
SELECT {_re(f'SUM(CASE WHEN BMI <= {_EXAMPLE_2} THEN 1 ELSE 0 END) / COUNT(BMI) * {D(100)}', 2)}
  AS percentile FROM x"""),
    "percentile_many": _with(_rank(f"(SELECT user_id, event_id, {_bmi('height', 'weight')} AS bmi FROM sub)", "bmi")),
    "below_above": _with(f"""
SELECT below, {D(100)} - below AS above
FROM (SELECT {D(100)} * AVG(CASE WHEN BMI < {_EXAMPLE} THEN 1 ELSE 0 END) AS below FROM x)"""),
    "histogram": _with(f"""
SELECT bin, lo + bin * width AS lo, lo + (bin + 1) * width AS hi, n
FROM (SELECT CAST(LEAST(floor((BMI - lo) / width), {S.HISTOGRAM_BINS - 1}) AS INTEGER) AS bin,
             COUNT(*) AS n, FIRST(lo) AS lo, FIRST(width) AS width
      FROM x, (SELECT MIN(BMI) AS lo, (MAX(BMI) - MIN(BMI)) / {D(S.HISTOGRAM_BINS)} AS width FROM x) r
      GROUP BY 1)"""),
    "box_by_gender": _with("SELECT * FROM box",
                           _box("(SELECT * FROM x WHERE gender IN ('female', 'male'))", "height", "gender")),
    "box_by_category": _with("SELECT * FROM box", _box("xl", "BMI", "BMI_Category")),
    "box_outliers": _with("""
SELECT s.person_id, s.BMI_Category, s.BMI FROM xl s JOIN box f ON s.BMI_Category = f.BMI_Category
WHERE s.BMI < f.lower_fence OR s.BMI > f.upper_fence""", _box("xl", "BMI", "BMI_Category")),
    "violin_by_gender": _with(_density_body(), _density()),
    "scatter_gender": _with("""
SELECT gender, CAST(floor(weight / 1.0) AS BIGINT) AS x_bin, CAST(floor(height / 1.0) AS BIGINT) AS y_bin,
       COUNT(*) AS n
FROM x WHERE gender IN ('female', 'male') AND weight IS NOT NULL AND height IS NOT NULL GROUP BY ALL"""),
    "scatter_bmi": _with(f"""
SELECT CAST(floor(height / 1.0) AS BIGINT) AS x_bin, CAST(floor(weight / 1.0) AS BIGINT) AS y_bin,
       COUNT(*) AS n, {_re('AVG(BMI)', 9)} AS mean_BMI
FROM x WHERE height IS NOT NULL AND weight IS NOT NULL GROUP BY ALL"""),
    # hypothesis tests
    "chisq_age_band": _with("SELECT test, statistic, dof, n, p_value, significant, interpretation FROM res",
                            _chisq("x", "age_interval", "BMI_Index", "age_interval x BMI_Index",
                                   S.VERDICT_AGE_BAND)),
    "chisq_gender_band": _with("SELECT test, statistic, dof, n, p_value, significant, interpretation FROM res",
                               _chisq("(SELECT * FROM x WHERE gender IN ('female', 'male'))", "gender",
                                      "BMI_Index", "gender x BMI_Index", S.VERDICT_GENDER_BAND)),
    # users, ranking, sorting
    "latest_row": _with(f"SELECT user_id, event_id, ts, height, weight FROM {_LATEST_SUB}"),
    "user_vs_population": _with(f"""
SELECT user_id, event_id, user_bmi, CAST({_band('user_bmi', S.BMI_CUTS)} AS INTEGER) AS user_index,
       {_label(_band('user_bmi', S.BMI_CUTS), S.BMI_LABELS_SHORT, 'Missing')} AS user_category,
       percentile, below, above,
       {_band('percentile', S.PERCENTILE_CUTS, S.PERCENTILE_TEXTS)} AS interpretation
FROM ranked""", _USERS),
    "sort_values": _with("""
SELECT person_id, BMI, row_number() OVER (ORDER BY BMI NULLS FIRST, person_id) AS position,
       rank() OVER (ORDER BY BMI NULLS FIRST) AS "rank" FROM x"""),
    # streaming (batch twins)
    "stream_score": _with('SELECT user_id, event_id, bmi, "index", category FROM scored'),
    "stream_percentile": _with(_rank("(SELECT user_id, event_id, bmi FROM scored)", "bmi")),
    "stream_latest": _with("""
SELECT user_id, event_id, "timestamp" AS ts, height_cm, weight_kg FROM lg
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY "timestamp" DESC, event_id DESC) = 1"""),
    "stream_category_counts": _with("""
SELECT time_bucket(INTERVAL 1 day, "timestamp") AS window_start,
       time_bucket(INTERVAL 1 day, "timestamp") + INTERVAL 1 day AS window_end,
       category, COUNT(*) AS n
FROM scored GROUP BY ALL"""),
}

ORACLE["cell_cube_counts"] = ORACLE["all_counts"]

# verdict: both tests' verdict columns
ORACLE["verdict"] = (
    _with("SELECT test, p_value, significant, interpretation FROM res",
          _chisq("x", "age_interval", "BMI_Index", "age_interval x BMI_Index", S.VERDICT_AGE_BAND))
    + "\nUNION ALL\n"
    + "(" + _with("SELECT test, p_value, significant, interpretation FROM res",
                  _chisq("(SELECT * FROM x WHERE gender IN ('female', 'male'))", "gender", "BMI_Index",
                         "gender x BMI_Index", S.VERDICT_GENDER_BAND)) + ")"
)


GENERIC_VERDICT = ("The two variables are associated (p < 0.05).",
                   "No evidence of association (p >= 0.05).")
EVENT_VALUE_CUTS = (10.0, 50.0, 100.0, 200.0)
QUANTITY_CUTS = (10.0, 25.0, 40.0)

ORACLE.update({
    "detect_dialect": _with("\nUNION ALL\n".join(
        f"SELECT {_q(lab)} AS file, {sep} AS delimiter, COUNT(*) AS \"rows\", COUNT(weight) AS weights FROM m"
        for lab, sep in (("tab", "chr(9)"), ("semicolon", "';'"), ("comma", "','")))),
    "collapse_delims": _with("""
SELECT person_id, gender, CAST(age AS DOUBLE) AS age, height, weight, 'a,,b "' || person_id || '", c' AS note FROM m"""),
    "null_tokens": _with("SELECT person_id, gender, CAST(age AS DOUBLE) AS age, height FROM m"),
    "harmonize_headers": _with(f"""
SELECT person_id, gender, age, height, weight, {_bmi('height', 'weight')} AS BMI,
       CAST({_band(_bmi('height', 'weight'), S.BMI_CUTS)} AS INTEGER) AS BMI_index FROM m"""),
    "sort_pivot": _with("SELECT age_interval, " + ", ".join(
        f'COUNT(*) FILTER (WHERE BMI_Index = {i}) AS "{i}"' for i in range(1, 6))
        + " FROM x WHERE age_interval IS NOT NULL GROUP BY age_interval"),
    "box_events_value": _with("SELECT * FROM box", _box("events", "value", "event_type")),
    "ecdf_lineitem_price": _with("""
SELECT l_returnflag, value, n,
       CAST(SUM(n) OVER (PARTITION BY l_returnflag ORDER BY value) AS BIGINT) AS cum,
       CAST(SUM(n) OVER (PARTITION BY l_returnflag) AS BIGINT) AS total,
       SUM(n) OVER (PARTITION BY l_returnflag ORDER BY value) / SUM(n) OVER (PARTITION BY l_returnflag) AS cdf
FROM (SELECT l_returnflag, l_extendedprice AS value, COUNT(*) AS n FROM lineitem
      WHERE l_extendedprice IS NOT NULL GROUP BY ALL)"""),
    "quantiles_events_value": _with("\nUNION ALL\n".join(
        f"SELECT event_type, {D(p)} AS p, {_q7('value', p)} AS q FROM events GROUP BY event_type"
        for p in (0.1, 0.5, 0.9))),
    "chisq_events": _with(
        "SELECT statistic, dof, n, p_value, significant, interpretation FROM res",
        _chisq(f"(SELECT *, CAST({_band('value', EVENT_VALUE_CUTS)} AS INTEGER) AS value_band FROM events)",
               "event_type", "value_band", "events", GENERIC_VERDICT)),
    "chisq_lineitem": _with(
        "SELECT statistic, dof, n, p_value, significant, interpretation FROM res",
        _chisq(f"(SELECT *, CAST({_band('l_quantity', QUANTITY_CUTS)} AS INTEGER) AS qty_band FROM lineitem)",
               "l_linestatus", "qty_band", "lineitem", GENERIC_VERDICT)),
})


def _analysis_summary() -> str:
    ub = "CAST(round_even({}, 0) AS INTEGER)"
    users = f"""
u AS (SELECT weight_kg, height_cm FROM lg
      ORDER BY date_trunc('second', "timestamp") DESC, event_id DESC LIMIT 1),
ubmi AS (SELECT {_bmi(f"CAST({ub.format('height_cm')} AS DOUBLE)",
                      f"CAST({ub.format('weight_kg')} AS DOUBLE)")} AS user_bmi FROM u),
sm AS (SELECT user_bmi, CAST({_band('user_bmi', S.BMI_CUTS)} AS INTEGER) AS user_index,
              {_label(_band('user_bmi', S.BMI_CUTS), S.BMI_LABELS_SHORT, 'Missing')} AS user_category,
              (SELECT COUNT(*) FROM x) AS "N",
              {D(100)} * ((SELECT COUNT(*) FROM x WHERE BMI <= user_bmi) / (SELECT COUNT(*) FROM x))
                AS percentile,
              (SELECT {D(100)} * AVG(CAST(BMI >= {D(S.OVERWEIGHT_CUT)} AS INTEGER)) FROM x)
                AS overweight_share,
              {D(100)} * ((SELECT COUNT(*) FROM x WHERE BMI < user_bmi) / (SELECT COUNT(*) FROM x))
                AS below
       FROM ubmi)
"""
    body = f"""
SELECT *, printf('User BMI = %s (%s). Percentile = %s', {_fmt2('user_bmi')}, user_category,
                 printf('%.1f%%', {_re('percentile', 1)})) AS summary,
       printf('Overweight+ share = %s | Below user = %s | Above user = %s',
              printf('%.1f%%', {_re('overweight_share', 1)}), printf('%.1f%%', {_re('below', 1)}),
              printf('%.1f%%', {_re('above', 1)})) AS shares
FROM (SELECT *, {D(100)} - below AS above FROM sm)"""
    return _with(body, users)


ORACLE["analysis_summary"] = _analysis_summary()


ORACLE["percentile_orders"] = """
WITH pv AS (SELECT l_extendedprice AS value, COUNT(*) AS n FROM lineitem
            WHERE l_extendedprice IS NOT NULL GROUP BY 1),
steps AS (SELECT value, SUM(n) OVER (ORDER BY value) AS le, n AS eq FROM pv),
tot AS (SELECT COUNT(l_extendedprice) AS total FROM lineitem)
SELECT o.o_orderkey, o.o_totalprice,
       CAST(100 AS DOUBLE) * (COALESCE(s.le, 0) / (SELECT total FROM tot)) AS percentile,
       CAST(100 AS DOUBLE) * ((COALESCE(s.le, 0) - CASE WHEN s.value = o.o_totalprice THEN s.eq ELSE 0 END)
                              / (SELECT total FROM tot)) AS below,
       CAST(100 AS DOUBLE) - CAST(100 AS DOUBLE) * ((COALESCE(s.le, 0)
           - CASE WHEN s.value = o.o_totalprice THEN s.eq ELSE 0 END) / (SELECT total FROM tot)) AS above
FROM orders o ASOF LEFT JOIN steps s ON o.o_totalprice >= s.value"""
