import pytest
from pyspark.sql import functions as F

from tallyspark.operators import quality
from tallyspark.operators.cleaning import clean_and_harmonize
from tallyspark.sources import loose_csv, rules, tables
from tallyspark.streaming import ingest

LOOSE = "\n---\n\n# a heading\n\n```csv\nvariable_name,level,dtype\nYEAR,both,int\nAGE,person,\"a, b\"\n```\nno comma here\n"
WIDE = 'Source,Some bank,,\n,,,\nUpdated,4/8,,\n,,,\nCountry Name,Country Code,1999,2009\n"Far Land",FAR,1.5E+09,\nNear Land,NEA,7,8\n'


def test_loose_csv(spark, tmp_path):
    path = tmp_path / "d.csv"
    path.write_text(LOOSE)
    rows = [tuple(r) for r in loose_csv.read_loose_csv(spark, str(path)).collect()]
    assert rows == [("YEAR", "both", "int"), ("AGE", "person", "a, b")]
    assert rules.load_rule_table(spark, str(path)).columns == ["variable_name", "level", "dtype"]
    empty = tmp_path / "e.csv"
    empty.write_text("nothing\n")
    with pytest.raises(ValueError):
        loose_csv.read_loose_csv(spark, str(empty))


def test_strict_rule_table(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text('Variable_Name,year,missing_codes,treat_as_na\nELECTRIC,ALL,"99|999",1\nELECTRIC,2009,"7",0\n')
    got = rules.RuleSet.from_frames(rules.load_rule_table(spark, str(path)), None)
    assert got.missing == {"ELECTRIC": {"ALL": ["99", "999"], "2009": ["7"]}}


def test_yearly_series(spark, tmp_path):
    path = tmp_path / "w.csv"
    path.write_text(WIDE)
    wide = loose_csv.read_yearly_series(spark, str(path))
    long = loose_csv.unpivot_years(wide.filter("`Country Name` = 'Far Land'"), ["Country Name"])
    assert sorted((r["year"], r["value"]) for r in long.collect()) == [(1999, 1.5e9), (2009, None)]


def test_scan_prunes_to_the_file(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).selectExpr("id AS Year", "id * 2 AS other", "'x' AS text").write.parquet(path)
    df = tables.scan(spark, path, ["YEAR", "nope"])
    assert df.columns == ["YEAR"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "struct<Year:bigint>" in plan
    assert tables.scan(spark, path).columns == ["YEAR", "OTHER", "TEXT"]


def test_reports_and_fallback(spark, tmp_path):
    frame = spark.createDataFrame([(1, "a")], "k int, v string")
    paths = tables.write_reports({"r": frame}, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(paths["r"]).first()["v"] == "a"
    stored = {"hh": str(tmp_path / "hh")}
    with pytest.raises(FileNotFoundError):
        tables.load_or_build(spark, str(tmp_path / "raw"), stored, lambda p: {})
    tables.write_table(frame, stored["hh"], ["k"])
    assert tables.load_or_build(spark, str(tmp_path / "raw"), stored, lambda p: {})["hh"].count() == 1
    tables.write_table(frame, str(tmp_path / "raw"))
    assert tables.load_or_build(spark, str(tmp_path / "raw"), stored, lambda p: {"built": frame})["built"] is frame


def test_streams_over_many_batches_equal_batch(spark, tmp_path):
    folder = str(tmp_path / "in")
    raw = spark.range(300).selectExpr(
        "cast(if(id % 3 = 0, 1989, if(id % 3 = 1, 1999, null)) as int) AS YEAR", "cast(id AS string) AS SERIAL", "1 AS PERNUM",
        "if(id % 5 = 0, '99', '1') AS ELECTRIC", "if(id % 7 = 0, null, cast(id as double)) AS AGE",
    )
    raw.repartition(6).write.parquet(folder)
    rule_set = rules.RuleSet.default()
    source = lambda: ingest.file_stream(spark, folder, raw.schema, files_per_batch=2)
    ingest.ingest(source(), rule_set, str(tmp_path / "out"), str(tmp_path / "c1"))
    expected = clean_and_harmonize(raw, rule_set)
    got = spark.read.schema(expected.schema).parquet(str(tmp_path / "out")).select(*expected.columns)
    assert got.exceptAll(expected).count() == 0 and got.count() == 300
    audit = ingest.stream_missingness(source(), str(tmp_path / "c2"))
    batch = quality.missingness(raw)
    assert audit.exceptAll(batch).count() == 0 and audit.count() == batch.count()


def test_stream_summaries_merge(spark, tmp_path):
    """Two streams of several batches each, merged, give what one pass over all rows gives."""
    raw = spark.range(4_000).selectExpr(
        "cast(if(id % 4 = 0, null, 1989 + 10 * (id % 2)) as int) AS YEAR", "cast(id % 5 as string) AS GEO1_VN",
        "cast(if(id % 7 = 0, null, id % 90) as double) AS AGE", "cast(1 + id % 3 as double) AS PERWT", "cast(id as string) AS SERIAL",
        "if(id % 11 = 0, null, 'c' || id % 13) AS WALL",
    )
    frames = []
    for part in (0, 1):
        folder = str(tmp_path / f"in{part}")
        raw.filter(f"cast(SERIAL as int) % 2 = {part} or SERIAL < '3'").filter(f"{part} = 0 or cast(SERIAL as int) % 2 = 1").repartition(5).write.parquet(folder)
        frames.append(lambda folder=folder: ingest.file_stream(spark, folder, raw.schema, files_per_batch=2))
    log = lambda n: str(tmp_path / f"log{n}")
    sketches = [ingest.stream_sketches(f(), ["WALL", "SERIAL"], log(f"s{k}")) for k, f in enumerate(frames)]
    got = {(r.YEAR, r.VARIABLE): r.N_UNIQUE for r in ingest.distinct_counts(sketches).collect()}
    both = spark.read.parquet(str(tmp_path / "in0"), str(tmp_path / "in1"))
    want = both.filter("YEAR is not null").groupBy("YEAR").agg(F.countDistinct("WALL").alias("w"), F.countDistinct("SERIAL").alias("s")).collect()
    assert len(got) == 2 * len(want)
    for r in want:
        assert got[r.YEAR, "WALL"] == r.w and abs(got[r.YEAR, "SERIAL"] - r.s) <= 0.03 * r.s
    checks = quality.combine_checks([ingest.stream_checks(f(), log(f"c{k}")) for k, f in enumerate(frames)])
    assert {tuple(r) for r in checks.select("CHECK", "N_FAIL").collect()} == {tuple(r) for r in quality.logical_checks(both).select("CHECK", "N_FAIL").collect()}
    sums = [ingest.stream_sums(f(), ["YEAR", "GEO1_VN"], "AGE", "PERWT", log(f"r{k}")) for k, f in enumerate(frames)]
    means = {(r.YEAR, r.GEO1_VN): (r.weighted_mean, r.n_obs) for r in ingest.group_means(sums, ["YEAR", "GEO1_VN"]).collect()}
    present = both.dropna(subset=["YEAR", "GEO1_VN", "AGE", "PERWT"]).groupBy("YEAR", "GEO1_VN")
    batch = present.agg((F.sum(F.col("AGE") * F.col("PERWT")) / F.sum("PERWT")).alias("m"), F.count(F.lit(1)).alias("n")).collect()
    assert means == {(r.YEAR, r.GEO1_VN): (r.m, r.n) for r in batch}


def test_session_options_are_put_back(spark):
    from tallyspark.session import PIECEWISE, configured

    name = next(iter(PIECEWISE))
    before = spark.conf.get(name)
    spark.conf.set(name, "65535")
    try:
        with configured(spark, {**PIECEWISE, "tallyspark.only.here": "1"}):
            assert spark.conf.get(name) == "8000" and spark.conf.get("tallyspark.only.here") == "1"
        assert spark.conf.get(name) == "65535" and spark.conf.get("tallyspark.only.here", None) is None
    finally:
        spark.conf.set(name, before)
