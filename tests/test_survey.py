import os

import pytest

import __spark_entry__ as entry
from tallyspark import session
from tallyspark.plans.census import CENSUS_RULES, read_census, survey
from tallyspark.plans import survey as plan
from tallyspark.plans.survey import Survey
from tests_support import compare, connect

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables absent")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    assert compare(entry.queries()[name](spark, FOLDER), con, entry.oracle_sql()[name]) == ""


def test_all_reports_have_rows(spark):
    tables = survey(spark, FOLDER)
    for name, report in {**tables.reports(), **tables.validation()}.items():
        assert report.count() > 0, name
    assert tables.notes().count() == 2 and tables.status({"a": "b"}).first()["status"] == "skipped"


def test_model_reports(spark):
    reports = survey(spark, FOLDER).model_reports(["logistic_regression"])
    for name, report in reports.items():
        assert report.count() > 0, name


def test_run_summary_counts_what_ran(spark):
    tables = Survey(read_census(spark, FOLDER), CENSUS_RULES)
    none = tables.run_summary().first()
    assert none.households_analyzed > 0 and none.person_rows_for_regressions > 0 and none.streaming_stage_used == 1
    assert (none.traditional_models_run, none.deep_learning_components_run, none.bayesian_network_run) == (0, 0, 0)
    tables.learner("logistic_regression")
    tables.bayes_network
    some = tables.run_summary().first()
    assert (some.traditional_models_run, some.deep_learning_components_run, some.bayesian_network_run) == (1, 0, 1)


def test_tables_divide_their_shuffles_by_size(spark, monkeypatch):
    """However few partitions a session deals, a stored table's tasks take a bounded share; the session is left as it was."""
    small = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "20k"}
    for name, value in small.items():
        monkeypatch.setitem(session.SMALL_SHARES, name, value)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        tables = Survey(read_census(spark, FOLDER), CENSUS_RULES)
        for table in (tables.harmonized, tables.households):
            assert len(table.inputFiles()) > 2
        tables.enriched, tables.persons_with_wealth, tables.cells
        assert all(spark.conf.get(name, None) != value for name, value in small.items())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_wide_tables_run_piecewise(spark, monkeypatch):
    """Tables with many computed columns are not fused into methods that the JVM leaves unoptimised."""
    limit, seen = "spark.sql.codegen.hugeMethodLimit", {}
    keep, before = plan.stage, spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    monkeypatch.setattr(plan, "stage", lambda df, name, *more: seen.update({name: spark.conf.get(limit)}) or keep(df, name, *more))
    spark.conf.set(limit, "65535")
    try:
        tables = Survey(read_census(spark, FOLDER), CENSUS_RULES)
        tables.persons_with_wealth
        assert seen == dict.fromkeys(("master", "households", "enriched", "persons"), "8000") and spark.conf.get(limit) == "65535"
    finally:
        spark.conf.set(limit, before)
