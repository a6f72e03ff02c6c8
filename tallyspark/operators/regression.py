"""Least squares with HC1 errors from grouped sums.

All categorical columns of a model make cells; one aggregate over the rows gives each cell's count, sums and
cross products of the numeric columns, and everything after it works on cells. A design whose terms are all explicit needs
no Python: a cell names its active terms, and sums over pairs of them are the normal equations. The driver solves a
k x k system, and a second aggregate gives the squared-error sums of the robust errors.

Factors with very many levels are absorbed instead of being spelled out: all columns are swept of the factors' level means
in turn until nothing is left to sweep (alternating projections), which gives the same coefficients and errors as
indicators would. The sweeps run on the cells of the absorbed factors and join one mean per level; no level ever
reaches the driver, and the levels' own coefficients come back as rows of the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.columns import canon, number
from tallyspark.functions.joins import skew_join
from tallyspark.operators.profiles import normal_p_value
from tallyspark.session import SMALL_SHARES, bounded_rows, configured, new_stage_path, stage

EXPLICIT_TERMS = 400
MAX_SWEEPS = 1_000
SWEEP_TOLERANCE = 1e-9
LONGEST_STEP = 1e4
RANK_TOLERANCE = 1e-10
SPANNED = 1e-9
NORMAL_95 = 1.959963984540054
SUM_SCHEMA = "i int, j int, v double"
COEFFICIENT_SCHEMA = (
    "term string, coefficient double, std_error double, p_value double, ci_lower double, ci_upper double, "
    "model string, nobs bigint, r_squared double, adj_r_squared double"
)
SEPARATOR = "\u0001"


@dataclass
class Term:
    """Product of indicator and numeric factors; an empty product is the intercept."""

    name: str
    levels: list[tuple[str, str]]
    numeric: list[str]


@dataclass
class Plan:
    """What a model spells out and what it absorbs; each absorbed factor is one column or a pair of columns."""

    y: str
    parts: list[str]
    cats: list[str]
    nums: list[str]
    absorbed: list[tuple[str, ...]] = field(default_factory=list)
    levels: dict[str, list[str]] = field(default_factory=dict)

    @property
    def slots(self) -> list[str]:
        """Columns whose sums the cells hold; slot 0 is the constant."""
        return [*self.nums, self.y]

    @property
    def keys(self) -> list[str]:
        """Columns of the absorbed factors."""
        return list(dict.fromkeys(c for f in self.absorbed for c in f))

    @property
    def whole(self) -> bool:
        """Whether no other column divides the cells: there is one for each combination of the absorbed columns."""
        return set(self.keys) == set(self.cats)

    def terms(self) -> list[Term]:
        made = build_terms(self.levels, self.parts)
        if not self.absorbed:
            return made
        # The absorbed factors span the intercept and their own indicators.
        spanned = [set(f) for f in self.absorbed]
        return [t for t in made if t.numeric or (t.levels and not any({c for c, _ in t.levels} <= s for s in spanned))]


def _level_key(level: str):
    try:
        return (0, float(level), level)
    except ValueError:
        return (1, 0.0, level)


def build_terms(levels: dict[str, list[str]], parts: list[str]) -> list[Term]:
    """Treatment-coded terms; parts are ``x``, ``C(a)`` or ``C(a)*C(b)`` with the lowest level as base."""
    terms = [Term("Intercept", [], [])]
    seen = set()

    def dummies(part: str) -> list[Term]:
        column = part[2:-1]
        return [Term(f"C({column})[T.{lv}]", [(column, lv)], []) for lv in levels[column][1:]]

    def add(new: list[Term]) -> None:
        for term in new:
            if term.name not in seen:
                seen.add(term.name)
                terms.append(term)

    for part in parts:
        factors = [p.strip() for p in part.split("*")]
        if len(factors) == 1 and not factors[0].startswith("C("):
            add([Term(factors[0], [], [factors[0]])])
            continue
        for factor in factors:
            add(dummies(factor))
        if len(factors) == 2:
            left, right = dummies(factors[0]), dummies(factors[1])
            add([Term(f"{a.name}:{b.name}", a.levels + b.levels, []) for a in left for b in right])
    return terms


def _columns_of(part: str) -> tuple[str, ...]:
    return tuple(p.strip()[2:-1] for p in part.split("*") if p.strip().startswith("C("))


def _factors(parts: list[str]) -> tuple[list[str], list[str]]:
    pieces = [p.strip() for part in parts for p in part.split("*")]
    cats = list(dict.fromkeys(p[2:-1] for p in pieces if p.startswith("C(")))
    nums = list(dict.fromkeys(p for p in pieces if not p.startswith("C(")))
    return cats, nums


def _upper(m: np.ndarray) -> pd.DataFrame:
    i, j = np.triu_indices(m.shape[0])
    return pd.DataFrame({"i": i.astype("int32"), "j": j.astype("int32"), "v": m[i, j]})


def _gather(df: DataFrame, size: int) -> np.ndarray:
    sums = df.groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((size, size))
    for row in bounded_rows(sums, size * size, "cross products"):
        out[row["i"], row["j"]] = out[row["j"], row["i"]] = row["v"]
    return out


def _minimum_norm(inverse: np.ndarray, scaled: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """The generalised inverse that gives the shortest coefficients in the design's own units.

    Any generalised inverse solves the normal equations; the shortest solution has no part in the null space, which is
    found on the scaled matrix and taken back to the units of the design.
    """
    values, vectors = np.linalg.eigh(scaled)
    null = vectors[:, values <= RANK_TOLERANCE * len(values)] / scale[:, None]
    if not null.shape[1]:
        return inverse
    basis, _ = np.linalg.qr(null)
    keep = np.eye(len(scaled)) - basis @ basis.T
    return keep @ inverse @ keep


def _moments(rows: DataFrame, keys: list[str], values: list[str], weight: Column | None = None, carried: list[str] = []) -> DataFrame:
    """Per cell the (weighted) sums ``m_i_j`` of products of values, and columns that are the same all over it; value 0 is the constant."""
    columns = [F.lit(1.0), *[F.col(v) for v in values]]
    sums = [
        F.sum(a * b if weight is None else weight * a * b).alias(f"m_{i}_{j}")
        for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j
    ]
    return rows.groupBy(*keys).agg(*sums, *[F.max(c).alias(c) for c in carried])


def _moment(i: int, j: int) -> str:
    return f"m_{min(i, j)}_{max(i, j)}"


# --- explicit designs, without Python -----------------------------------------------------


def _by_levels(plan: Plan, values: dict[str, float | int], kind: str) -> list[Column]:
    """One column per categorical part: what ``values`` gives the indicator that a row switches on, else null."""
    found = []
    groups: dict[tuple[str, ...], dict[str, str]] = {}
    for term in plan.terms():
        if term.levels:
            columns = tuple(c for c, _ in term.levels)
            groups.setdefault(columns, {})[SEPARATOR.join(level for _, level in term.levels)] = term.name
    for columns, names in groups.items():
        pairs = [F.lit(x) for key, name in names.items() for x in (key, values[name])]
        key = F.concat_ws(SEPARATOR, *columns) if len(columns) > 1 else F.col(columns[0])
        found.append(F.element_at(F.create_map(*pairs), key).cast(kind))
    return found


def _pair_sums(cells: DataFrame, plan: Plan, slots: list[str], with_y: bool) -> np.ndarray:
    """Sums over all rows of the products of each two terms, from the cells' sums."""
    terms = plan.terms()
    places = {t.name: i for i, t in enumerate(terms)}
    size = len(terms) + with_y
    always = [(places["Intercept"], 0)] if "Intercept" in places else []
    always += [(places[c], 1 + slots.index(c)) for c in plan.nums]
    always += [(len(terms), 1 + slots.index(plan.y))] if with_y else []
    active = F.array(
        *[F.struct(F.lit(t).alias("t"), F.lit(s).alias("s")) for t, s in always],
        *[F.when(t.isNotNull(), F.struct(t.alias("t"), F.lit(0).alias("s"))) for t in _by_levels(plan, places, "int")],
    )
    width = len(slots) + 1
    table = F.array(*[F.col(_moment(i, j)) for i in range(width) for j in range(width)])
    listed = cells.select(F.filter(active, lambda a: a.isNotNull()).alias("active"), table.alias("table"))
    first = listed.select("active", "table", F.explode("active").alias("a"))
    pairs = first.select("table", "a", F.explode("active").alias("b")).filter("a.t <= b.t")
    value = F.element_at("table", (F.col("a.s") * width + F.col("b.s") + 1).cast("int"))
    return _gather(pairs.select(F.col("a.t").alias("i"), F.col("b.t").alias("j"), value.alias("v")), size)


def _fitted(plan: Plan, beta: np.ndarray) -> Column:
    """The part of a row's fit that its numbers and explicit indicators give."""
    given = {t.name: float(b) for t, b in zip(plan.terms(), beta)}
    total = F.lit(given.get("Intercept", 0.0))
    for c in plan.nums:
        total = total + F.col(c) * given[c]
    for column in _by_levels(plan, given, "double"):
        total = total + F.coalesce(column, F.lit(0.0))
    return total


# --- absorbed factors ---------------------------------------------------------------------


@dataclass
class Swept:
    """Level means that the absorbed factors take out of each column."""

    cells: DataFrame  # absorbed columns, n, and the part a_i of column i that all factors explain together
    means: list[list[DataFrame]]  # for each factor, the tables of its sweeps: factor columns and d_i
    shares: list[np.ndarray]  # how much of each sweep's means counts, by column
    width: int


def _design_sums(plan: Plan) -> list[Column]:
    """Each explicit term's sum in a cell, then that of y."""
    slots = plan.slots
    sums = []
    for term in plan.terms():
        if term.numeric:
            sums.append(F.col(_moment(0, 1 + slots.index(term.numeric[0]))))
        else:
            on = F.lit(True)
            for column, level in term.levels:
                on = on & (F.col(column) == level)
            sums.append(F.when(on, F.col("m_0_0")).otherwise(0.0))
    return [*sums, F.col(_moment(0, 1 + slots.index(plan.y)))]


def _sweep(cells: DataFrame, plan: Plan, spread: np.ndarray) -> Swept:
    """Alternating projections: take each factor's level means out of all columns until none is left.

    Sums live on the cells of the absorbed factors, so a sweep costs one aggregate and one many-to-one join per factor and
    its work does not grow with the rows. Every second sweep is extended along its own direction by the ratio at which
    the sweeps shrink, column by column, so factors that go together do not need hundreds of them.
    """
    spark = cells.sparkSession
    keys = plan.keys
    design = _design_sums(plan)
    every = range(len(design))
    held = cells.select(*keys, F.col("m_0_0").alias("n"), *[s.alias(f"v_{i}") for i, s in enumerate(design)])
    if not plan.whole:
        held = held.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.sum(f"v_{i}").alias(f"v_{i}") for i in every])
    if len(plan.absorbed) == 1:
        # The means of a single factor are those of its cells: nothing is left to sweep, and nothing to join.
        levels = held.select(*keys, "n", *[(F.col(f"v_{i}") / F.col("n")).alias(f"a_{i}") for i in every])
        levels = levels if plan.whole else stage(levels, "swept")
        means = levels.select(*keys, *[F.col(f"a_{i}").alias(f"d_{i}") for i in every])
        return Swept(levels, [[means]], [np.ones(len(design))], len(design))
    held = stage(held.select("*", *[F.lit(0.0).alias(f"{x}_{i}") for x in "ab" for i in every]), "swept")
    swept = Swept(held, [[] for _ in plan.absorbed], [], len(design))
    fixed = [*keys, "n", *[f"v_{i}" for i in every]]
    for turn in range(MAX_SWEEPS):
        # a: taken out so far; b: what the last sweep took; o: a before this sweep.
        held = held.select(*fixed, *[f"{x}_{i}" for x in "ab" for i in every], *[F.col(f"a_{i}").alias(f"o_{i}") for i in every])
        for place, factor in enumerate(plan.absorbed):
            found = held.groupBy(*factor).agg(
                *[(F.sum(F.col(f"v_{i}") - F.col("n") * F.col(f"a_{i}")) / F.sum("n")).alias(f"d_{i}") for i in every]
            )
            path = new_stage_path(spark, "means")
            found.write.parquet(path)
            means = spark.read.schema(found.schema).parquet(path)
            swept.means[place].append(means)
            joined = held.join(means, list(factor))
            held = joined.select(
                *fixed, *[(F.col(f"a_{i}") + F.col(f"d_{i}")).alias(f"a_{i}") for i in every], *[f"{x}_{i}" for x in "bo" for i in every]
            )
        moved = [F.col(f"a_{i}") - F.col(f"o_{i}") for i in every]
        held = stage(held.select(*fixed, *[f"a_{i}" for i in every], *[m.alias(f"o_{i}") for i, m in enumerate(moved)],
                                 *[(m - F.col(f"b_{i}")).alias(f"c_{i}") for i, m in enumerate(moved)]), "swept")
        n = F.col("n")
        sums = held.agg(
            *[F.max(F.abs(f"o_{i}")) for i in every], *[F.sum(n * F.col(f"o_{i}") * F.col(f"c_{i}")) for i in every],
            *[F.sum(n * F.col(f"c_{i}") * F.col(f"c_{i}")) for i in every],
        ).first()
        largest, along, across = (np.array([x or 0.0 for x in sums[k * len(design) : (k + 1) * len(design)]]) for k in range(3))
        swept.shares.append(np.ones(len(design)))
        if (largest / spread).max() <= SWEEP_TOLERANCE:
            swept.cells = held
            return swept
        further = np.zeros(len(design))
        if turn % 3 == 2:
            further = np.clip(-along / np.where(across > 0, across, 1.0), 0.0, LONGEST_STEP)
            swept.shares[-1] += further
        held = held.select(
            *fixed, *[(F.col(f"a_{i}") + F.col(f"o_{i}") * float(further[i])).alias(f"a_{i}") for i in every],
            *[F.col(f"o_{i}").alias(f"b_{i}") for i in every],
        )
    raise RuntimeError(f"sweeping {plan.absorbed} did not settle in {MAX_SWEEPS} sweeps")


def _swept_products(plan: Plan, width: int, values: int):
    """Sums of products of swept columns over cells: indicators less their means, plus the numbers' own sums."""
    terms = plan.terms()
    slots = plan.slots[:values]
    carry = np.zeros((width, values))
    for i, term in enumerate(terms):
        if term.numeric:
            carry[i, slots.index(term.numeric[0])] = 1.0
    if width > len(terms):
        carry[len(terms), slots.index(plan.y)] = 1.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc, weight = np.zeros((width, width)), 0.0
        for pdf in batches:
            fixed = -pdf[[f"a_{i}" for i in range(width)]].to_numpy(dtype=float)
            for i, term in enumerate(terms):
                if not term.numeric:
                    on = np.ones(len(pdf))
                    for column, level in term.levels:
                        on *= pdf[column].to_numpy() == level
                    fixed[:, i] += on
            n = pdf["m_0_0"].to_numpy(dtype=float)
            sums = pdf[[_moment(0, 1 + i) for i in range(values)]].to_numpy(dtype=float) @ carry.T
            mixed = fixed.T @ sums
            acc += (fixed * n[:, None]).T @ fixed + mixed + mixed.T
            inner = np.array([[pdf[_moment(1 + i, 1 + j)].sum() for j in range(values)] for i in range(values)])
            acc += carry @ inner.reshape(values, values) @ carry.T
            weight += n.sum()
        yield pd.concat([_upper(acc), pd.DataFrame({"i": np.array([width], "int32"), "j": np.array([width], "int32"), "v": [weight]})])

    return run


def _swept_gram(cells: DataFrame, plan: Plan, width: int, values: int) -> tuple[np.ndarray, float]:
    """The normal equations of swept columns and the cells' whole weight, from cells that carry their means a_i."""
    spelled = {c for t in plan.terms() for c, _ in t.levels}
    means = {f"a_{i}" for i in range(width)}
    cells = cells.select(*[c for c in cells.columns if c in spelled or c in means or c.startswith("m_")])
    gram = _gather(cells.mapInPandas(_swept_products(plan, width, values), SUM_SCHEMA), width + 1)
    return gram[:width, :width], gram[width, width]


def _with_means(cells: DataFrame, swept: Swept, plan: Plan) -> DataFrame:
    """Cells beside the means of their levels; where a cell is a level, they come from its own sums."""
    every = range(swept.width)
    if plan.whole and len(plan.absorbed) == 1:
        return cells.select("*", *[(s / F.col("m_0_0")).alias(f"a_{i}") for i, s in enumerate(_design_sums(plan))])
    return cells.join(swept.cells.select(*plan.keys, *[f"a_{i}" for i in every]), plan.keys)


def _components(cells: DataFrame, left: tuple[str, ...], right: tuple[str, ...]) -> int:
    """Connected parts of the graph that links two factors' levels wherever they share a cell."""
    ends = [F.concat_ws(SEPARATOR, F.lit(str(side)), *factor) for side, factor in enumerate((left, right))]
    links = stage(cells.select(ends[0].alias("a"), ends[1].alias("b")).distinct(), "links")
    names = stage(links.groupBy("a").agg(F.min("b").alias("name")), "names")
    while True:
        # A level takes the least name among its neighbours' names, the two sides in turn, until no name changes.
        other = links.join(names, "a").groupBy("b").agg(F.min("name").alias("name"))
        least = links.join(other, "b").groupBy("a").agg(F.min("name").alias("least"))
        moved = stage(names.join(least, "a").select("a", F.least("name", "least").alias("name"), (F.col("least") < F.col("name")).alias("moved")), "names")
        names = moved.select("a", "name")
        if moved.filter("moved").isEmpty():
            return names.select("name").distinct().count()


def _absorbed_rank(cells: DataFrame, plan: Plan) -> int:
    """Independent columns among the absorbed indicators; from a third factor on, ties are counted with the first only."""
    if plan.whole and len(plan.absorbed) == 1:
        return cells.count()
    rank = 0
    for place, factor in enumerate(plan.absorbed):
        rank += cells.select(*factor).distinct().count()
        rank -= _components(cells, plan.absorbed[0], factor) if place else 0
    return rank


def _absorbed_terms(swept: Swept, plan: Plan, beta: np.ndarray) -> tuple[DataFrame, float]:
    """Coefficients of the absorbed levels against each factor's lowest one, and the intercept."""
    weights = [*(-beta), 1.0]
    out, intercept = None, 0.0
    for factor, tables in zip(plan.absorbed, swept.means):
        parts = None
        for means, shares in zip(tables, swept.shares):
            effect = F.lit(0.0)
            for i, w in enumerate(weights):
                effect = effect + F.col(f"d_{i}") * float(w * shares[i])
            part = means.select(*factor, effect.alias("effect"))
            parts = part if parts is None else parts.unionByName(part)
        effects = parts if len(tables) == 1 else stage(parts.groupBy(*factor).agg(F.sum("effect").alias("effect")), "effects")
        order = [x for c in factor for x in (F.col(c).try_cast("double").asc_nulls_last(), F.col(c))]
        base = effects.orderBy(*order).first()
        intercept += base["effect"]
        name = F.concat_ws(":", *[F.concat(F.lit(f"C({c})[T."), F.col(c), F.lit("]")) for c in factor])
        same = F.lit(True)
        for c in factor:
            same = same & (F.col(c) == base[c])
        table = effects.filter(~same).select(name.alias("term"), (F.col("effect") - base["effect"]).alias("coefficient"))
        out = table if out is None else out.unionByName(table)
    return out, intercept


# --- the fit ------------------------------------------------------------------------------


def _plan(cells: DataFrame, plan: Plan, absorb: list[str]) -> Plan:
    """Absorbs what is asked for, and the largest factors until the rest can be spelled out."""
    plan.absorbed = [tuple(p.strip() for p in a.split("*")) for a in absorb]

    def spelled() -> list[str]:
        """Parts with something left to spell out."""
        return [p for p in plan.parts if not _columns_of(p) or not any(set(_columns_of(p)) <= set(f) for f in plan.absorbed)]

    # Levels matter where they may be spelled out; those of absorbed factors alone are not even counted.
    open_cats = list(dict.fromkeys(c for p in spelled() for c in _columns_of(p)))
    levels: dict[str, list[str]] = {c: [] for c in open_cats}
    counts = {}
    if plan.cats and not open_cats and cells.isEmpty():
        raise ValueError("no complete rows to fit")
    if open_cats:
        seen = cells.unpivot([], open_cats, "c", "v").distinct()
        rows = seen.limit(EXPLICIT_TERMS + 1).collect()
        if not rows:
            raise ValueError("no complete rows to fit")
        if len(rows) > EXPLICIT_TERMS:
            counts = {r["c"]: r["count"] for r in seen.groupBy("c").count().collect()}
        else:
            for row in rows:
                levels[row["c"]].append(row["v"])
            counts = {c: len(v) for c, v in levels.items()}

    def size(part: str) -> int:
        levels = [counts[c] for c in _columns_of(part)]
        return math.prod(levels) if levels else 1

    while sum(size(p) for p in spelled()) > EXPLICIT_TERMS:
        widest = max((p for p in spelled() if _columns_of(p)), key=size, default=None)
        if widest is None:
            raise ValueError(f"more than {EXPLICIT_TERMS} numeric columns in one model")
        factor = _columns_of(widest)
        plan.absorbed = [f for f in plan.absorbed if not set(f) < set(factor)] + [factor]
    plan.parts = spelled()
    explicit = list(dict.fromkeys(c for p in plan.parts for c in _columns_of(p)))
    if explicit and not any(levels.values()):
        for row in bounded_rows(cells.unpivot([], explicit, "c", "v").distinct(), EXPLICIT_TERMS, "factor levels"):
            levels[row["c"]].append(row["v"])
    plan.levels = {c: sorted(levels[c], key=_level_key) for c in explicit}
    return plan


def ols_hc1(df: DataFrame, y: str, parts: list[str], model: str = "", absorb: list[str] = []) -> DataFrame:
    """Coefficient table of a least-squares fit with HC1 robust errors.

    Rows with a null in any model column drop out. A rank-deficient design gets the minimum-norm solution.
    ``absorb`` names factors (``a`` or ``a*b``) to be swept out instead of spelled out; beyond ``EXPLICIT_TERMS``
    terms the largest factors are absorbed on their own. Absorbed levels have coefficients but no errors.
    The frame is read twice and should be a stored table.
    """
    with configured(df.sparkSession, SMALL_SHARES):
        return _fit(df, y, parts, model, absorb)


def _fit(df: DataFrame, y: str, parts: list[str], model: str, absorb: list[str]) -> DataFrame:
    swept_columns = [c.strip() for a in absorb for c in a.split("*")]
    cats, nums = _factors(parts)
    cats = list(dict.fromkeys([*cats, *swept_columns]))
    nums = [c for c in nums if c != y]
    frame = df.select(
        number(y).alias(y), *[canon(c).alias(c) for c in cats], *[number(c).alias(c) for c in nums],
    ).dropna()
    plan = Plan(y, parts, cats, nums)
    cells = stage(_moments(frame, cats, plan.slots).filter("m_0_0 > 0"), "cells")
    plan = _plan(cells, plan, absorb)
    terms = plan.terms()
    size, slots = len(terms), plan.slots
    swept, means = None, []
    if plan.absorbed:
        found = cells.agg(F.sum("m_0_0"), F.sum(_moment(0, len(slots))), F.sum(_moment(len(slots), len(slots)))).first()
        n, total, total_squared = found
        squares = [F.col(_moment(1 + slots.index(t.numeric[0]), 1 + slots.index(t.numeric[0]))) if t.numeric else s for t, s in zip(terms, _design_sums(plan))]
        found = cells.agg(*[F.sum(s).alias(f"q_{i}") for i, s in enumerate([*squares, F.col(_moment(len(slots), len(slots)))])]).first()
        raw = np.array([found[i] or 0.0 for i in range(size + 1)])
        swept = _sweep(cells, plan, np.sqrt(np.maximum(raw / n, 1e-300)))
        gram, _ = _swept_gram(_with_means(cells, swept, plan), plan, size + 1, len(slots))
        # A column that the absorbed factors span is left with rounding noise only.
        gone = np.flatnonzero(np.diag(gram)[:size] <= SPANNED * raw[:size])
        gram[gone, :] = gram[:, gone] = 0.0
    else:
        gram = _pair_sums(cells, plan, slots, True)
        n, total, total_squared = gram[0, 0], gram[0, size], gram[size, size]
        if n == 0:
            raise ValueError("no complete rows to fit")
    xx, xy = gram[:size, :size], gram[:size, size]
    # Unit-diagonal scaling keeps squared terms from swamping the rank decision.
    scale = np.sqrt(np.where(np.diag(xx) > 0, np.diag(xx), 1.0))
    scaled = xx / np.outer(scale, scale)
    rank = int(np.linalg.matrix_rank(scaled, tol=RANK_TOLERANCE * size, hermitian=True)) if size else 0
    inverse = np.linalg.pinv(scaled, rcond=RANK_TOLERANCE, hermitian=True) / np.outer(scale, scale) if size else np.zeros((0, 0))
    inverse = _minimum_norm(inverse, scaled, scale) if size else inverse
    beta = inverse @ xy
    error = F.col(y) - _fitted(plan, beta)
    rows = frame
    if swept is not None:
        rank += _absorbed_rank(cells, plan)
        part = F.col(f"a_{size}")
        for i, b in enumerate(beta):
            part = part - F.col(f"a_{i}") * float(b)
        means = [f"a_{i}" for i in range(size)]
        levels = swept.cells.select(*plan.keys, *means, part.alias("_level"), F.col("n").alias("_size"))
        rows = skew_join(frame, levels, plan.keys, "_size", "inner")
        error = error - F.col("_level")
    # The join leaves a cell's rows together, and the sums take its level's means along: no second join.
    squared = _moments(rows.withColumn("_e", error), cats, nums, F.col("_e") * F.col("_e"), means)
    if swept is not None:
        second, ssr = _swept_gram(squared, plan, size, len(nums))
        second[gone, :] = second[:, gone] = 0.0
    else:
        second = _pair_sums(squared, plan, nums, False)
        ssr = second[0, 0]
    free = n - rank
    cov = inverse @ second @ inverse * (n / free if free > 0 else math.nan)
    spread = total_squared - total**2 / n
    r2 = 1 - ssr / spread if spread > 0 else math.nan
    adjusted = 1 - (n - 1) / free * (1 - r2) if free > 0 else math.nan
    out = []
    for place, term in enumerate(terms):
        b, se = float(beta[place]), math.sqrt(max(float(cov[place, place]), 0.0))
        p = normal_p_value(b / se) if se > 0 else None
        out.append(
            (term.name, b, se, p, b - NORMAL_95 * se, b + NORMAL_95 * se, model or y, int(n), float(r2), float(adjusted))
        )
    spark = df.sparkSession
    if swept is None:
        return spark.createDataFrame(out, COEFFICIENT_SCHEMA)
    effects, intercept = _absorbed_terms(swept, plan, beta)
    out.insert(0, ("Intercept", float(intercept), None, None, None, None, model or y, int(n), float(r2), float(adjusted)))
    constants = {"model": F.lit(model or y), "nobs": F.lit(int(n)).cast("bigint"), "r_squared": F.lit(float(r2)), "adj_r_squared": F.lit(float(adjusted))}
    empty = {c: F.lit(None).cast("double") for c in ("std_error", "p_value", "ci_lower", "ci_upper")}
    made = spark.createDataFrame(out, COEFFICIENT_SCHEMA)
    return made.unionByName(effects.withColumns({**empty, **constants}).select(*made.columns))


def _given(df: DataFrame, parts: list[str]) -> list[str]:
    return [p for p in parts if all(c in df.columns for f in _factors([p]) for c in f)]


def household_models(households: DataFrame) -> DataFrame:
    """Wealth and housing quality on size, density, place and tenure."""
    urban = "URBAN_H" if "URBAN_H" in households.columns else "URBAN"
    parts = ["HOUSEHOLD_SIZE"] + _given(households, ["AREA_PER_PERSON", "ROOMS_PER_PERSON", "VEHICLE_COUNT"])
    parts.append(f"C({urban})*C(YEAR)" if urban in households.columns else "C(YEAR)")
    parts += _given(households, ["C(GEO1_VN)", "C(OWNERSHIP_H)"])
    out = None
    for dependent in ["wealth_index", "housing_quality_index"]:
        if dependent in households.columns:
            table = ols_hc1(households, dependent, parts, dependent)
            out = table if out is None else out.unionByName(table)
    return out


def _with_age2(df: DataFrame) -> DataFrame:
    return df.withColumn("AGE2", number("AGE") ** 2) if "AGE" in df.columns else df


def person_returns(persons: DataFrame, wealth: str = "wealth_index") -> DataFrame:
    df = _with_age2(persons)
    parts = ["C(EDATTAIN_H)*C(SEX_H)", "C(YEAR)"] + _given(df, ["AGE", "AGE2", "C(URBAN_H)", "C(GEO1_VN)"])
    return ols_hc1(df, wealth, parts, "person_education_gender_returns")


def gender_education(persons: DataFrame) -> DataFrame:
    df = _with_age2(persons)
    return ols_hc1(
        df, "EDATTAIN_H", ["C(SEX_H)*C(YEAR)", "AGE", "AGE2"] + _given(df, ["C(URBAN_H)", "C(GEO1_VN)"]), "gender_education"
    )


def gender_wealth(persons: DataFrame, wealth: str = "wealth_index") -> DataFrame:
    df = _with_age2(persons)
    parts = ["C(SEX_H)*C(URBAN_H)", "C(YEAR)"] + _given(df, ["C(EDATTAIN_H)", "AGE", "AGE2", "C(GEO1_VN)"])
    return ols_hc1(df, wealth, parts, "gender_wealth")


def education_returns(frame: DataFrame, wealth: str = "wealth_index") -> DataFrame:
    parts = ["C(EDATTAIN_H)*C(YEAR)", "AGE"] + _given(frame, ["C(SEX_H)", "C(URBAN_H)", "C(GEO1_VN)"])
    return ols_hc1(frame, wealth, parts, "education_returns")
