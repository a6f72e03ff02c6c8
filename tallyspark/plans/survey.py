"""From person rows to analysis tables: each table is built once and stored."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark import settings
from tallyspark.operators import bayes, classifiers, indices, profiles, quality, regression, unsupervised
from tallyspark.operators.cleaning import clean_and_harmonize
from tallyspark.operators.features import model_cells
from tallyspark.operators.tables import education_frame, household_rollup, join_households, person_table
from tallyspark.session import PIECEWISE, ROW_GROUP, SMALL_READS, SMALL_SHARES, configured, stage
from tallyspark.sources.rules import RuleSet, dictionary_frame
from tallyspark.functions.ordered import gini


class Survey:
    """Lazily staged tables over one raw person DataFrame."""

    def __init__(self, raw: DataFrame, rules: RuleSet):
        self.raw, self.rules, self.spark = raw, rules, raw.sparkSession
        self._learners: dict[str, classifiers.Classifier] = {}

    @cached_property
    def harmonized(self) -> DataFrame:
        """The harmonised master, written once; readers scan only the columns they need."""
        with configured(self.spark, PIECEWISE | SMALL_READS | SMALL_SHARES):
            return stage(clean_and_harmonize(self.raw, self.rules), "master", ROW_GROUP)

    @cached_property
    def persons(self) -> DataFrame:
        return person_table(self.harmonized)

    @cached_property
    def households(self) -> DataFrame:
        rolled = household_rollup(self.harmonized)
        with configured(self.spark, PIECEWISE | SMALL_READS | SMALL_SHARES):
            return stage(rolled, "households")

    @cached_property
    def enriched(self) -> DataFrame:
        """Households with wealth index, class and housing-quality index."""
        with configured(self.spark, PIECEWISE | SMALL_SHARES):
            return stage(indices.household_indices(self.households), "enriched")

    @cached_property
    def persons_with_wealth(self) -> DataFrame:
        """The one join of persons and households; eight analyses read its result."""
        joined = join_households(self.persons, self.enriched, ["wealth_index", "wealth_class", "URBAN_H"])
        with configured(self.spark, PIECEWISE | SMALL_SHARES):
            return stage(joined, "persons")

    @cached_property
    def education(self) -> DataFrame:
        return education_frame(self.persons_with_wealth)

    @cached_property
    def cells(self) -> DataFrame:
        return model_cells(self.enriched)

    @cached_property
    def flagged(self) -> DataFrame:
        """Households with anomaly score and flag; the forest is grown and all rows are scored once for all reports."""
        keys = settings.HOUSEHOLD_KEYS
        rows = self.enriched.select(*keys, "wealth_index", "URBAN_H", "GEO1_VN")
        return unsupervised.isolation_forest(rows, ["YEAR", "wealth_index", "URBAN_H"], keys)

    def learner(self, name: str) -> classifiers.Classifier:
        """A learner of full size on the training cells; every report uses the same fit."""
        if name not in self._learners:
            self._learners[name] = classifiers.fit_classifier(name, self.cells.filter("train"), "wealth_class", settings.MODEL_FEATURES)
        return self._learners[name]

    @cached_property
    def network(self) -> tuple[classifiers.Classifier, list[float]]:
        """The feed-forward net on the training cells, with its loss history."""
        return classifiers.fit_network_cells(self.cells.filter("train"), "wealth_class", settings.MODEL_FEATURES)

    def reports(self) -> dict[str, DataFrame]:
        """Descriptive, inequality, regional, gender, education and regression tables."""
        hh, persons = self.enriched, self.persons_with_wealth
        region_year = stage(profiles.region_year_wealth(hh), "regions")
        return {
            "wealth_pca_loadings": indices.loadings_table(self.households, indices.fit_components(self.households, settings.ASSET_VARS_BY_YEAR)),
            "housing_pca_loadings": indices.loadings_table(self.households, indices.fit_components(self.households, settings.HOUSING_VARS_BY_YEAR)),
            "progress_by_schooling": indices.progress_by_schooling(self.harmonized),
            "household_summary_statistics": profiles.summary_stats(hh),
            "yearly_weighted_wealth_mean": profiles.yearly_mean(hh, "wealth_index", "HHWT"),
            "yearly_weighted_gini": gini(hh, ["YEAR"], "wealth_index", "HHWT"),
            "urban_rural_wealth_by_year": profiles.urban_rural_wealth(hh),
            "household_regression_coefficients": regression.household_models(hh),
            "person_education_gender_returns_coefficients": regression.person_returns(persons),
            "gender_gaps_by_year": profiles.gender_gap(persons, ["YEAR", "SEX_H"]),
            "gender_gaps_by_year_urban": profiles.gender_gap(persons, ["YEAR", "URBAN_H", "SEX_H"], observed_rate=False),
            "gender_education_regression": regression.gender_education(persons),
            "gender_wealth_regression": regression.gender_wealth(persons),
            "education_cohort_profiles": profiles.cohort_profiles(self.education),
            "education_wealth_relationship_over_time": profiles.education_rich_probability(self.education),
            "education_returns_proxy_regression": regression.education_returns(self.education),
            "region_year_wealth": region_year,
            "regional_sigma_convergence": profiles.sigma_convergence(region_year),
            "regional_beta_convergence": profiles.beta_convergence(region_year),
            "robustness_wealth_measurement": indices.robustness_main(hh),
            "robustness_alternative_pca_specs": indices.robustness_alternatives(hh),
            "robustness_subgroup_sensitivity": profiles.subgroup_sensitivity(hh),
        }

    def notes(self) -> DataFrame:
        """How to read the proxy and robustness tables."""
        return self.spark.createDataFrame(
            [
                ("education_mobility", "Cohorts and schooling-wealth links come from repeated cross-sections; they do not follow persons or families."),
                ("wealth_measurement", "The main index is compared with an additive score, with other variable sets, and within area and period."),
            ],
            "topic string, note string",
        )

    def status(self, skipped: dict[str, str]) -> DataFrame:
        """One row per component that did not run, with the reason."""
        return self.spark.createDataFrame(
            [(name, "skipped", reason) for name, reason in skipped.items()], "component string, status string, reason string"
        )

    def validation(self, rule_files: dict[str, tuple[DataFrame, list[str]]] = {}) -> dict[str, DataFrame]:
        """All validation reports; of rule files (frame, required columns) by name also their schema."""
        return quality.validation_suite(self.harmonized, self.rules, dictionary_frame(self.spark), rule_files)

    def network_cells(self) -> DataFrame:
        keys = settings.HOUSEHOLD_KEYS
        keyed = self.enriched.select("*", *[self.enriched[k].alias(f"_k_{k}") for k in keys])
        prepared = bayes.prepare(keyed, keep=[f"_k_{k}" for k in keys])
        return bayes.network_cells(prepared, settings.NETWORK_FEATURES, "wealth_class", [f"_k_{k}" for k in keys])

    @cached_property
    def bayes_network(self) -> tuple[DataFrame, list]:
        """The network's cells and the edges that the search finds on the training cells."""
        cells = stage(self.network_cells(), "network")
        return cells, bayes.search_structure(cells.filter("train"), settings.NETWORK_FEATURES)

    @cached_property
    def representation(self) -> DataFrame:
        scored = self.enriched.groupBy(*settings.MODEL_FEATURES, "wealth_index").agg(F.count(F.lit(1)).alias("n"))
        return unsupervised.representation_benchmark(self.cells, scored, "wealth_class", settings.MODEL_FEATURES)

    def model_reports(self, learners: list[str]) -> dict[str, DataFrame]:
        """Classifier, network and cluster tables."""
        target, features = "wealth_class", settings.MODEL_FEATURES
        net, history = self.network
        test_cells = self.cells.filter("NOT train")
        labelled, metrics = unsupervised.kmeans_clusters(self.cells, features)
        models = {name: self.learner(name) for name in learners}
        return {
            "traditional_model_comparison": classifiers.compare_fitted(models, test_cells, target),
            "temporal_model_validation": classifiers.temporal_validation(self.cells, learners, target, features),
            "deep_learning_model_comparison": classifiers.evaluate(net.predict(test_cells), target),
            "mlp_training_history": self.spark.createDataFrame(list(enumerate(history)), "iteration int, loss double"),
            "subgroup_model_performance": classifiers.subgroups(
                self.learner("random_forest").predict(test_cells), target, ["URBAN_H", "YEAR", "GEO1_VN"]
            ),
            "kmeans_cluster_summary": unsupervised.cluster_summary(labelled),
            "kmeans_cluster_metrics": metrics,
        }

    def run_summary(self) -> DataFrame:
        """One row: what was analysed, and how many learners, latent models and networks this survey has fitted so far."""
        households = self.enriched.agg(F.count(F.lit(1)).alias("households_analyzed"))
        persons = self.persons.agg(F.count(F.lit(1)).alias("n")).first()["n"]
        done = self.__dict__
        return households.select(
            F.lit(int("harmonized" in done)).alias("streaming_stage_used"),
            "households_analyzed",
            F.lit(persons).cast("bigint").alias("person_rows_for_regressions"),
            F.lit(len(self._learners)).alias("traditional_models_run"),
            F.lit(("network" in done) + ("representation" in done)).alias("deep_learning_components_run"),
            F.lit(int("bayes_network" in done)).alias("bayesian_network_run"),
        )
