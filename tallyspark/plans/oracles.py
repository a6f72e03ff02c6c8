"""The same tables and reports as plain SQL for a second engine, to check results against.

Written independently of the operators: household values by aggregate instead of by
ordered pick, principal components by repeated matrix squaring in a recursive query,
quantiles, ranks and running totals by that engine's own functions.
"""

from __future__ import annotations

from tallyspark import settings
from tallyspark.plans.census import CENSUS_COLUMNS

COLUMNS = list(CENSUS_COLUMNS)

CENSUS = "SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in CENSUS_COLUMNS.items()) + (
    " FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"
)

_CODES = {v: codes.split("|") for v, _, codes in settings.MISSING_RULES}


def _nulled(column: str) -> str:
    if column == "WATSUP":
        return (
            "CASE WHEN YEAR = 2019 AND WATSUP IN ('30', '99') THEN NULL "
            "WHEN YEAR <> 2019 AND WATSUP IN ('99', '999') THEN NULL ELSE WATSUP END"
        )
    if column in _CODES:
        listed = ", ".join(f"'{c}'" for c in _CODES[column])
        return f"CASE WHEN CAST({column} AS VARCHAR) IN ({listed}) THEN NULL ELSE {column} END"
    return column


def _cleaned(column: str) -> str:
    text = _nulled(column)
    if column in settings.NUMERIC_VARS and column not in ("YEAR", "PERNUM"):
        text = f"CAST({text} AS DOUBLE)"
    return f"{text} AS {column}"


NULLED = "SELECT " + ", ".join(f"{_nulled(c)} AS {c}" for c in COLUMNS) + " FROM census"
CLEAN = "SELECT " + ", ".join(_cleaned(c) for c in COLUMNS) + " FROM census"

_MAPPED = {
    "URBAN": "CASE URBAN WHEN '1' THEN '1' WHEN '2' THEN '0' ELSE URBAN END",
    "ELECTRIC": "CASE ELECTRIC WHEN '1' THEN '1' WHEN '2' THEN '0' ELSE ELECTRIC END",
    "SEX": "CASE WHEN YEAR = 2019 AND SEX = '1' THEN 'M' ELSE SEX END",
}
TWINS = {f"{v}_H": _MAPPED.get(v, v) for v in settings.HARMONIZE_VARS}
HARM = "SELECT *, " + ", ".join(f"{sql} AS {name}" for name, sql in TWINS.items()) + " FROM clean"
HARM_COLUMNS = COLUMNS + list(TWINS)

PERSON = (
    f"SELECT {', '.join(settings.PERSON_COLUMNS)}, CASE WHEN AGE >= 15 AND AGE <= 64 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END "
    "AS IS_WORKING_AGE FROM harm"
)

HOUSEHOLD = (
    "SELECT *, LIVEAREA / HOUSEHOLD_SIZE AS AREA_PER_PERSON, ROOMS / HOUSEHOLD_SIZE AS ROOMS_PER_PERSON, "
    "coalesce(AUTOS, 0) + coalesce(MOTORCYCLE, 0) AS VEHICLE_COUNT FROM (SELECT YEAR, SERIAL, count(*) AS HOUSEHOLD_SIZE, "
    + ", ".join(f"arg_min({c}, PERNUM) AS {c}" for c in settings.HOUSEHOLD_COLUMNS)
    + " FROM harm GROUP BY YEAR, SERIAL)"
)
HOUSEHOLD_COLUMNS = [
    "YEAR", "SERIAL", "HOUSEHOLD_SIZE", *settings.HOUSEHOLD_COLUMNS, "AREA_PER_PERSON", "ROOMS_PER_PERSON", "VEHICLE_COUNT",
]


def component_ctes(prefix: str, source: str, specs: dict[int, list[str]], keys: str = "YEAR, SERIAL") -> list[tuple[str, str]]:
    """CTEs ending in ``<prefix>_score`` (keys, score) and ``<prefix>_lead`` (YEAR, i, w)."""
    variables = list(dict.fromkeys(v for vs in specs.values() for v in vs))
    parts = []
    for v in variables:
        years = ", ".join(str(y) for y, vs in specs.items() if v in vs)
        parts.append(f"SELECT {keys}, '{v}' AS var, TRY_CAST({v} AS DOUBLE) AS v FROM {source} WHERE YEAR IN ({years})")
    p = prefix
    using = ", ".join(k.strip() for k in keys.split(","))
    return [
        (f"{p}_long", " UNION ALL ".join(parts)),
        (f"{p}_med", f"SELECT YEAR, var, quantile_cont(v, 0.5) AS m FROM {p}_long GROUP BY YEAR, var HAVING count(DISTINCT v) > 1"),
        (f"{p}_use", f"SELECT YEAR, var, m FROM (SELECT *, count(*) OVER (PARTITION BY YEAR) AS k FROM {p}_med) WHERE k >= 3"),
        (f"{p}_fill", f"SELECT l.*, coalesce(v, m) AS x FROM {p}_long l JOIN {p}_use u USING (YEAR, var)"),
        (f"{p}_mom", f"SELECT YEAR, var, avg(x) AS mu, stddev_pop(x) AS sd FROM {p}_fill GROUP BY YEAR, var"),
        (f"{p}_z", f"SELECT {keys}, var, (x - mu) / sd AS z FROM {p}_fill JOIN {p}_mom USING (YEAR, var)"),
        (
            f"{p}_cor",
            f"SELECT a.YEAR, a.var AS i, b.var AS j, avg(a.z * b.z) AS v FROM {p}_z a JOIN {p}_z b USING ({using}) "
            "GROUP BY a.YEAR, a.var, b.var",
        ),
        (
            f"{p}_pow",
            f"SELECT 0 AS k, YEAR, i, j, v FROM {p}_cor UNION ALL "
            "SELECT k, YEAR, i, j, v / sum(CASE WHEN i = j THEN v END) OVER (PARTITION BY YEAR) FROM ("
            f"SELECT a.k + 1 AS k, a.YEAR, a.i, b.j, sum(a.v * b.v) AS v FROM {p}_pow a JOIN {p}_pow b "
            "ON a.YEAR = b.YEAR AND a.j = b.i WHERE a.k < 24 GROUP BY a.k, a.YEAR, a.i, b.j)",
        ),
        (f"{p}_peak", f"SELECT YEAR, arg_max(i, v) AS p, max(v) AS d FROM {p}_pow WHERE k = 24 AND i = j GROUP BY YEAR"),
        (
            f"{p}_lead",
            f"SELECT m.YEAR, m.i, m.v / sqrt(q.d) AS w FROM {p}_pow m JOIN {p}_peak q ON m.YEAR = q.YEAR AND m.j = q.p WHERE m.k = 24",
        ),
        (
            f"{p}_score",
            # Summed in a fixed order, so that equal rows get equal scores to the last digit.
            f"SELECT {keys}, list_sum(list(z * w ORDER BY var)) AS score FROM (SELECT z.*, l.w FROM {p}_z z JOIN {p}_lead l ON z.YEAR = l.YEAR AND z.var = l.i) "
            f"GROUP BY {keys}",
        ),
    ]


ENRICHED = (
    "SELECT *, CASE WHEN wealth_index IS NULL THEN NULL WHEN wealth_index <= q30 THEN 'poor' "
    "WHEN wealth_index <= q70 THEN 'middle' ELSE 'rich' END AS wealth_class FROM ("
    "SELECT s.*, quantile_cont(wealth_index, 0.3) OVER (PARTITION BY YEAR) AS q30, "
    "quantile_cont(wealth_index, 0.7) OVER (PARTITION BY YEAR) AS q70 FROM ("
    "SELECT h.*, w.score AS wealth_index, g.score AS housing_quality_index FROM hh h "
    "LEFT JOIN wp_score w USING (YEAR, SERIAL) LEFT JOIN gp_score g USING (YEAR, SERIAL)) s)"
)

SPLIT = (
    "SELECT *, CAST('0x' || substr(md5('42|' || wealth_class || '|' || YEAR || '|' || SERIAL), 1, 8) AS BIGINT) % 100 < 80 AS train "
    "FROM enriched WHERE wealth_class IS NOT NULL"
)

MODES = (
    "SELECT URBAN_H, YEAR, arg_min(wealth_class, rk) AS prediction FROM (SELECT *, row_number() OVER "
    "(PARTITION BY URBAN_H, YEAR ORDER BY n DESC, wealth_class) AS rk FROM (SELECT URBAN_H, YEAR, wealth_class, count(*) AS n "
    "FROM split WHERE train GROUP BY ALL)) GROUP BY URBAN_H, YEAR"
)

PREDICTED = "SELECT s.*, m.prediction FROM split s JOIN modes m USING (URBAN_H, YEAR) WHERE NOT train"

REGIONS = (
    "SELECT YEAR, GEO1_VN, sum(wealth_index * coalesce(HHWT, 1.0)) AS wealth_x_weight, count(*) AS household_count, "
    "sum(coalesce(HHWT, 1.0)) AS weight_sum, sum(wealth_index * coalesce(HHWT, 1.0)) / nullif(sum(coalesce(HHWT, 1.0)), 0) "
    "AS weighted_mean_wealth FROM enriched WHERE YEAR IS NOT NULL AND GEO1_VN IS NOT NULL AND wealth_index IS NOT NULL GROUP BY YEAR, GEO1_VN"
)

PERSON_WEALTH = "SELECT p.*, e.wealth_index, e.wealth_class FROM person p LEFT JOIN enriched e USING (YEAR, SERIAL)"

EDUCATION = (
    "SELECT * REPLACE (TRY_CAST(EDATTAIN_H AS DOUBLE) AS EDATTAIN_H), YEAR - AGE AS BIRTH_YEAR_PROXY, "
    "CAST(floor((YEAR - AGE) / 10) * 10 AS INTEGER) AS COHORT_DECADE FROM pw "
    "WHERE YEAR IS NOT NULL AND AGE IS NOT NULL AND TRY_CAST(EDATTAIN_H AS DOUBLE) IS NOT NULL"
)

TOP_REGIONS = (
    f"SELECT GEO1_VN FROM (SELECT GEO1_VN, count(*) AS n FROM enriched WHERE wealth_class IS NOT NULL AND GEO1_VN IS NOT NULL "
    f"GROUP BY GEO1_VN) ORDER BY n DESC, GEO1_VN LIMIT {settings.NETWORK_TOP_REGIONS}"
)

NETWORK = (
    "SELECT YEAR AS k_year, SERIAL AS k_serial, coalesce(CAST(YEAR AS VARCHAR), 'MISSING') AS YEAR, "
    "CASE WHEN GEO1_VN IN (SELECT GEO1_VN FROM top_regions) THEN GEO1_VN ELSE 'OTHER' END AS GEO1_VN, "
    "coalesce(URBAN_H, 'MISSING') AS URBAN_H, coalesce(ELECTRIC_H, 'MISSING') AS ELECTRIC_H, coalesce(WATSUP_H, 'MISSING') AS WATSUP_H, "
    "wealth_class, CAST('0x' || substr(md5('42|' || wealth_class || '|' || YEAR || '|' || SERIAL), 1, 8) AS BIGINT) % 100 < 80 AS train "
    "FROM enriched WHERE wealth_class IS NOT NULL"
)

_ASSETS = component_ctes("wp", "hh", settings.ASSET_VARS_BY_YEAR)
_HOUSING = component_ctes("gp", "hh", settings.HOUSING_VARS_BY_YEAR)

# name -> (definition, names it needs)
CTES: dict[str, tuple[str, list[str]]] = {
    "census": (CENSUS, []),
    "nulled": (NULLED, ["census"]),
    "clean": (CLEAN, ["census"]),
    "harm": (HARM, ["clean"]),
    "person": (PERSON, ["harm"]),
    "hh": (HOUSEHOLD, ["harm"]),
    **{name: (sql, ["hh", *[n for n, _ in _ASSETS[:i]]]) for i, (name, sql) in enumerate(_ASSETS)},
    **{name: (sql, ["hh", *[n for n, _ in _HOUSING[:i]]]) for i, (name, sql) in enumerate(_HOUSING)},
    "enriched": (ENRICHED, ["hh", *[n for n, _ in _ASSETS], *[n for n, _ in _HOUSING]]),
    "split": (SPLIT, ["enriched"]),
    "modes": (MODES, ["split"]),
    "predicted": (PREDICTED, ["split", "modes"]),
    "regions": (REGIONS, ["enriched"]),
    "pw": (PERSON_WEALTH, ["person", "enriched"]),
    "edu": (EDUCATION, ["pw"]),
    "top_regions": (TOP_REGIONS, ["enriched"]),
    "network": (NETWORK, ["enriched", "top_regions"]),
}


def with_ctes(body: str, needs: list[str], extra: list[tuple[str, str]] = []) -> str:
    """``body`` behind the CTEs it needs, in dependency order."""
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for need in CTES[name][1]:
                add(need)
            order.append(name)

    for name in needs:
        add(name)
    listed = [(n, CTES[n][0]) for n in order] + list(extra)
    if not listed:
        return body
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({s})" if n.endswith(("_pow", "_gj")) else f"{n} AS MATERIALIZED ({s})" for n, s in listed) + "\n" + body


def rounded(source: str, plain: list[str], doubles: list[str], digits: int = 6) -> str:
    """Select plain columns as they are and double columns rounded."""
    picks = plain + [f"round({d}, {digits}) AS {d}" for d in doubles]
    return f"SELECT {', '.join(picks)} FROM ({source})"


def ols_ctes(p: str, source: str, y: str, parts: list[str]) -> list[tuple[str, str]]:
    """CTEs ending in ``<p>_fit``: least squares with HC1 errors by elimination in long form."""
    pieces = list(dict.fromkeys(f.strip() for part in parts for f in part.split("*")))
    cats = [f[2:-1] for f in pieces if f.startswith("C(")]
    nums = [f for f in pieces if not f.startswith("C(")]
    columns = [f"TRY_CAST({y} AS DOUBLE) AS yy"]
    columns += [f"TRY_CAST({c} AS DOUBLE) AS n_{c}" for c in nums] + [f"CAST({c} AS VARCHAR) AS c_{c}" for c in cats]
    present = " AND ".join(["yy IS NOT NULL", *[f"n_{c} IS NOT NULL" for c in nums], *[f"c_{c} IS NOT NULL" for c in cats]])

    def base(c: str) -> str:
        return f"(SELECT c_{c} FROM {p}_d GROUP BY 1 ORDER BY TRY_CAST(c_{c} AS DOUBLE) NULLS LAST, c_{c} LIMIT 1)"

    def name(c: str) -> str:
        return f"'C({c})[T.' || c_{c} || ']'"

    rows = [f"SELECT rid, 'Intercept' AS t, 1.0::DOUBLE AS v FROM {p}_d"]
    rows += [f"SELECT rid, '{c}', n_{c} FROM {p}_d" for c in nums]
    rows += [f"SELECT rid, {name(c)}, 1.0 FROM {p}_d WHERE c_{c} <> {base(c)}" for c in cats]
    for part in parts:
        if "*" in part:
            a, b = (f.strip()[2:-1] for f in part.split("*"))
            rows.append(f"SELECT rid, {name(a)} || ':' || {name(b)}, 1.0 FROM {p}_d WHERE c_{a} <> {base(a)} AND c_{b} <> {base(b)}")
    tail = "list_sum(list_transform(range(0, 200), lambda q: exp(-x * x + (2 * q + 1) * ln(greatest(x, 1e-300)) - lgamma(q + 1.5))))"
    return [
        (f"{p}_d", f"SELECT *, row_number() OVER () AS rid FROM (SELECT {', '.join(columns)} FROM {source}) WHERE {present}"),
        (f"{p}_long", " UNION ALL ".join(rows)),
        (f"{p}_t", f"SELECT t, row_number() OVER (ORDER BY t) AS p FROM (SELECT DISTINCT t FROM {p}_long)"),
        (f"{p}_x", f"SELECT rid, p, v FROM {p}_long JOIN {p}_t USING (t)"),
        (f"{p}_g", f"SELECT a.p AS i, b.p AS j, sum(a.v * b.v) AS v FROM {p}_x a JOIN {p}_x b USING (rid) GROUP BY ALL"),
        (f"{p}_s", f"SELECT i AS p, sqrt(v) AS s FROM {p}_g WHERE i = j"),
        (f"{p}_xy", f"SELECT p, sum(v * yy) AS v FROM {p}_x JOIN {p}_d USING (rid) GROUP BY p"),
        (
            f"{p}_a",
            f"SELECT a.p AS i, b.p AS j, coalesce(g.v, 0) / (a.s * b.s) AS v FROM {p}_s a CROSS JOIN {p}_s b LEFT JOIN {p}_g g ON g.i = a.p AND g.j = b.p "
            f"UNION ALL SELECT p, 0, v / s FROM {p}_xy JOIN {p}_s USING (p) "
            f"UNION ALL SELECT a.p, (SELECT count(*) FROM {p}_t) + b.p, CASE WHEN a.p = b.p THEN 1.0 ELSE 0.0 END FROM {p}_s a CROSS JOIN {p}_s b",
        ),
        (
            f"{p}_gj",
            f"SELECT CAST(0 AS BIGINT) AS k, i, j, CAST(v AS DOUBLE) AS v FROM {p}_a UNION ALL "
            f"SELECT g.k + 1, g.i, g.j, CASE WHEN g.i = g.k + 1 THEN g.v / q.v ELSE g.v - c.v * r.v / q.v END FROM {p}_gj g "
            f"JOIN {p}_gj r ON r.i = g.k + 1 AND r.j = g.j JOIN {p}_gj c ON c.i = g.i AND c.j = g.k + 1 "
            f"JOIN {p}_gj q ON q.i = g.k + 1 AND q.j = g.k + 1 WHERE g.k < (SELECT count(*) FROM {p}_t)",
        ),
        (f"{p}_end", f"SELECT i, j, v FROM {p}_gj WHERE k = (SELECT count(*) FROM {p}_t)"),
        (f"{p}_b", f"SELECT i AS p, v / s AS b FROM {p}_end JOIN {p}_s ON i = p WHERE j = 0"),
        (
            f"{p}_inv",
            f"SELECT e.i, a.p AS j, e.v / (a.s * b.s) AS v FROM {p}_end e JOIN {p}_s a ON e.j = a.p + (SELECT count(*) FROM {p}_t) JOIN {p}_s b ON b.p = e.i",
        ),
        (f"{p}_e", f"SELECT rid, max(yy) AS yy, max(yy) - sum(v * b) AS e FROM {p}_x JOIN {p}_b USING (p) JOIN {p}_d USING (rid) GROUP BY rid"),
        (f"{p}_m", f"SELECT a.p AS i, b.p AS j, sum(e * e * a.v * b.v) AS v FROM {p}_x a JOIN {p}_x b USING (rid) JOIN {p}_e USING (rid) GROUP BY ALL"),
        (
            f"{p}_sum",
            f"SELECT count(*) AS n, (SELECT count(*) FROM {p}_t) AS k, 1 - sum(e * e) / (sum((yy - (SELECT avg(yy) FROM {p}_e)) ** 2)) AS r2 FROM {p}_e",
        ),
        (
            f"{p}_v",
            f"SELECT l.i AS p, sum(l.v * m.v * r.v) AS v FROM {p}_inv l JOIN {p}_m m ON m.i = l.j JOIN {p}_inv r ON r.i = m.j AND r.j = l.i GROUP BY l.i",
        ),
        (
            f"{p}_fit",
            f"SELECT term, coefficient, std_error, greatest(CASE WHEN x > 8 THEN 0.0 ELSE 1 - {tail} END, 0) AS p_value, "
            "coefficient - 1.959963984540054 * std_error AS ci_lower, coefficient + 1.959963984540054 * std_error AS ci_upper, nobs, r_squared, "
            "1 - (nobs - 1.0) / (nobs - k) * (1 - r_squared) AS adj_r_squared FROM (SELECT *, abs(coefficient / std_error) / sqrt(2.0) AS x FROM ("
            f"SELECT t AS term, b AS coefficient, sqrt(v * n / (n - k)) AS std_error, n AS nobs, r2 AS r_squared, k FROM {p}_b JOIN {p}_t USING (p) JOIN {p}_v USING (p), {p}_sum))",
        ),
    ]
