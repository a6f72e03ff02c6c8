"""Discrete Bayesian network on category cells: preparation, search, tables, queries."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark import settings
from tallyspark.functions.columns import canon, hash_word, number
from tallyspark.functions.ordered import exact_quantiles
from tallyspark.session import bounded_rows, stage

COUNT = "n"
MAX_VARIABLES = 12
MAX_PARAMETERS = 1_000_000
EPSILON = 1e-4

Edges = list[tuple[str, str]]


def quantile_bins(df: DataFrame, value: str, labels: list[str], out: str) -> DataFrame:
    """Label rows by equal-count bins; repeated edges merge, a constant column becomes its text.

    Bins are open on the left and closed on the right, the lowest value is included. If
    merging leaves fewer bins than labels, equal-width bins are used instead.
    """
    k = len(labels)
    probs = {f"_q{i}": i / k for i in range(k + 1)}
    v = number(value)
    keyed = df.select(F.lit(1).alias("_g"), v.alias("_v"))
    cuts = exact_quantiles(keyed, ["_g"], "_v", probs).first()
    if cuts is None or cuts["_q0"] == cuts[f"_q{k}"]:
        return df.withColumn(out, F.coalesce(v.cast("string"), F.lit("-1.0")))
    edges = sorted({cuts[f"_q{i}"] for i in range(k + 1)})
    if len(edges) - 1 != k:
        low, high = edges[0], edges[-1]
        edges = [low + (high - low) * i / k for i in range(k + 1)]
    label = F.when(v.isNull(), F.lit(None))
    for upper, name in zip(edges[1:-1], labels):
        label = label.when(v <= upper, name)
    return df.withColumn(out, label.otherwise(labels[-1]))


def lump_top_n(df: DataFrame, column: str, n: int, other: str = "OTHER") -> DataFrame:
    """Keep the n commonest codes (ties by code), call the rest ``other``."""
    code = canon(column)
    counts = df.select(code.alias("_c")).filter(F.col("_c").isNotNull()).groupBy("_c").agg(F.count(F.lit(1)).alias("_k"))
    top = [r["_c"] for r in counts.orderBy(F.desc("_k"), "_c").limit(n).collect()]
    kept = F.coalesce(code.isin(*top), F.lit(False)) if top else F.lit(False)
    return df.withColumn(column, F.when(kept, code).otherwise(other))


def prepare(
    df: DataFrame, features: list[str] = settings.NETWORK_FEATURES, target: str = "wealth_class", keep: list[str] = []
) -> DataFrame:
    """All-category frame: rare regions lumped, nulls as MISSING, rows without a target dropped."""
    present = [c for c in features if c in df.columns]
    data = df.filter(F.col(target).isNotNull())
    if "GEO1_VN" in present:
        data = lump_top_n(data, "GEO1_VN", settings.NETWORK_TOP_REGIONS)
    return data.select(*keep, *[F.coalesce(canon(c), F.lit("MISSING")).alias(c) for c in present])


def network_cells(prepared: DataFrame, variables: list[str], target: str, keys: list[str]) -> DataFrame:
    train = hash_word(settings.SEED, target, *keys) % 100 < 80
    counted = prepared.select(*variables, F.coalesce(train, F.lit(False)).alias("train"))
    return stage(counted.groupBy(*variables, "train").agg(F.count(F.lit(1)).alias(COUNT)), "cells")


def subset_statistics(cells: DataFrame, variables: list[str]) -> dict[frozenset, tuple[float, int]]:
    """For every set of variables: sum of n log n over its states, and the number of states.

    One cube over the cells serves every family the search may look at; one row per
    set of variables comes back.
    """
    if len(variables) > MAX_VARIABLES:
        raise ValueError(f"more than {MAX_VARIABLES} network variables")
    states = cells.cube(*variables).agg(F.sum(COUNT).alias("_k"), F.grouping_id(*variables).alias("_id"))
    sums = states.groupBy("_id").agg(
        F.sum(F.col("_k") * F.log(F.col("_k").cast("double"))).alias("t"), F.count(F.lit(1)).alias("r")
    )
    width, out = len(variables), {}
    for row in bounded_rows(sums, 2**width, "variable sets"):
        names = frozenset(v for i, v in enumerate(variables) if not (row["_id"] >> (width - 1 - i)) & 1)
        out[names] = (row["t"], row["r"])
    return out


def search_structure(cells: DataFrame, variables: list[str]) -> Edges:
    """Greedy hill climbing by BIC: add, remove or turn one edge while it gains."""
    stats = subset_statistics(cells, variables)
    total = cells.agg(F.sum(COUNT)).first()[0]
    if not total:
        return []
    card = {v: stats[frozenset([v])][1] for v in variables}

    def score(child: str, parents: frozenset) -> float:
        fit = stats[parents | {child}][0] - stats[parents][0]
        free = (card[child] - 1) * math.prod(card[p] for p in parents)
        return fit - 0.5 * math.log(total) * free

    parents = {v: frozenset() for v in variables}

    def reaches(start: str, goal: str, without: tuple[str, str] | None = None) -> bool:
        todo, seen = [start], set()
        while todo:
            node = todo.pop()
            if node == goal:
                return True
            seen.add(node)
            todo += [c for c in variables if node in parents[c] and c not in seen and (node, c) != without]
        return False

    while True:
        best, change = EPSILON, None
        for child in variables:
            for other in variables:
                if other == child:
                    continue
                if other in parents[child]:
                    fewer = parents[child] - {other}
                    lost = score(child, fewer) - score(child, parents[child])
                    turned = lost + score(other, parents[other] | {child}) - score(other, parents[other])
                    options = [(lost, {child: fewer})]
                    if not reaches(other, child, without=(other, child)):
                        options.append((turned, {child: fewer, other: parents[other] | {child}}))
                elif not reaches(child, other):
                    more = parents[child] | {other}
                    options = [(score(child, more) - score(child, parents[child]), {child: more})]
                else:
                    options = []
                for gain, update in options:
                    if gain > best:
                        best, change = gain, update
        if change is None:
            return sorted((p, c) for c in variables for p in parents[c])
        parents.update(change)


def parents_of(edges: Edges, variables: list[str]) -> dict[str, list[str]]:
    return {v: sorted(p for p, c in edges if c == v) for v in variables}


def conditional_table(cells: DataFrame, child: str, parents: list[str]) -> DataFrame:
    """(parents, child, prob) from counts; one row per observed state."""
    counts = cells.groupBy(*parents, child).agg(F.sum(COUNT).alias("_k"))
    group = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(1))
    return counts.select(*parents, child, (F.col("_k") / F.sum("_k").over(group)).alias("prob"))


def table_summary(cells: DataFrame, edges: Edges, variables: list[str]) -> DataFrame:
    """Variable, number of states, parents and state names of every node."""
    states = cells.select(*variables).unpivot([], variables, "variable", "state").distinct()
    listed = states.groupBy("variable").agg(
        F.count(F.lit(1)).alias("cardinality"), F.array_join(F.array_sort(F.collect_list("state")), " | ").alias("state_names")
    )
    evidence = F.lit("")
    for child, given in parents_of(edges, variables).items():
        evidence = F.when(F.col("variable") == child, " | ".join(given)).otherwise(evidence)
    return listed.select("variable", "cardinality", evidence.alias("evidence"), "state_names")


def predict(train: DataFrame, test: DataFrame, edges: Edges, target: str, variables: list[str]) -> DataFrame:
    """Most probable target state given every other variable, per test cell.

    Given all the rest, only tables that mention the target matter. Each candidate state
    is tried by equi-joining those tables and adding logs. A cell no state explains gets
    the commonest training state.
    """
    given = parents_of(edges, variables)
    counts = train.groupBy(target).agg(F.sum(COUNT).alias("_k"))
    seen = {r[target]: r["_k"] for r in bounded_rows(counts, 10_000, "target states")}
    mode = min(seen, key=lambda s: (-seen[s], s))
    states = sorted(seen)
    evidence = [v for v in variables if v != target]
    trial = "_state"
    tried = (
        test.groupBy(*evidence)
        .agg(F.lit(1).alias("_one"))
        .select(*evidence, F.explode(F.array(*[F.lit(s) for s in states])).alias(trial))
    )
    logs: list[Column] = []
    for child in variables:
        if child != target and target not in given[child]:
            continue
        table = conditional_table(train, child, given[child]).withColumnRenamed(target, trial)
        on = [trial if v == target else v for v in [*given[child], child]]
        name = f"_p_{child}"
        tried = tried.join(table.withColumnRenamed("prob", name), on, "left")
        logs.append(F.log(F.col(name)))
    weight = reduce(lambda a, b: a + b, logs)
    ranked = F.when(weight.isNotNull(), F.struct((-weight).alias("cost"), F.col(trial).alias("state")))
    best = tried.groupBy(*evidence).agg(F.min(ranked).alias("_best"))
    chosen = best.select(*evidence, F.coalesce(F.col("_best.state"), F.lit(mode)).alias("prediction"))
    return test.join(chosen, evidence)


def posterior(cells: DataFrame, edges: Edges, target: str, variables: list[str], evidence: dict[str, str]) -> DataFrame:
    """P(target | evidence) by multiplying tables on shared variables and summing them out.

    Tables are as small as the state space of one family. Every product joins tables
    that share the variable being summed out, so no join is without a key.
    """
    factors: list[tuple[set, DataFrame]] = []
    for child, given in parents_of(edges, variables).items():
        table = conditional_table(cells, child, given)
        for name, value in evidence.items():
            if name in table.columns:
                table = table.filter(F.col(name) == value).drop(name)
        factors.append((set(table.columns) - {"prob"}, table))
    linked = _linked(target, factors)
    factors = [f for f in factors if f[0] & linked]
    hidden = [v for v in variables if v in linked and v != target and v not in evidence]
    for name in sorted(hidden, key=lambda v: sum(v in f[0] for f in factors)):
        touching = [f for f in factors if name in f[0]]
        scope, table = reduce(_product, touching)
        rest = sorted(scope - {name})
        summed = table.groupBy(*rest).agg(F.sum("prob").alias("prob"))
        factors = [f for f in factors if name not in f[0]] + ([(set(rest), summed)] if rest else [])
    scope, table = reduce(_product, [f for f in factors if target in f[0]])
    norm = F.sum("prob").over(Window.partitionBy(F.lit(1)))
    return table.select(target, (F.col("prob") / F.nullif(norm, F.lit(0.0))).alias("prob"))


def _linked(target: str, factors: list[tuple[set, DataFrame]]) -> set:
    known = {target}
    while True:
        grown = known.union(*[scope for scope, _ in factors if scope & known])
        if grown == known:
            return known
        known = grown


def _product(a: tuple[set, DataFrame], b: tuple[set, DataFrame]) -> tuple[set, DataFrame]:
    shared = sorted(a[0] & b[0])
    joined = a[1].join(b[1].withColumnRenamed("prob", "_r"), shared)
    return a[0] | b[0], joined.withColumn("prob", F.col("prob") * F.col("_r")).drop("_r")


def scenarios(
    cells: DataFrame,
    edges: Edges,
    variables: list[str],
    target: str = "wealth_class",
    specs: dict[str, dict[str, str]] = settings.NETWORK_SCENARIOS,
) -> DataFrame:
    """Class probabilities under each named evidence; evidence never observed gives no row."""
    tables = []
    for name, wanted in specs.items():
        evidence = {k: v for k, v in wanted.items() if k in variables}
        if wanted and not evidence:
            continue
        probs = posterior(cells, edges, target, variables, evidence)
        text = " | ".join(f"{k}={v}" for k, v in evidence.items())
        tables.append(
            probs.agg(
                *[F.max(F.when(F.col(target) == c, F.col("prob"))).alias(f"{c}_prob") for c in ["poor", "middle", "rich"]],
                F.count("prob").alias("_n"),
            )
            .filter("_n > 0")
            .select(F.lit(name).alias("scenario"), F.lit(text).alias("evidence"), "poor_prob", "middle_prob", "rich_prob")
        )
    return reduce(lambda a, b: a.unionByName(b), tables)
