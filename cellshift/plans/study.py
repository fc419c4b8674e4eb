"""Frames shared by the registered queries: controls, deltas, references, predictors."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellshift.operators import controls, folds, prepare, priors
from cellshift.sources.star import Star

FOLDS = 4
ALPHA = 8.0
SCENARIO_SEEDS = {"chemical": 101, "strain": 211, "time": 307, "nested_time": 353, "forward": 401, "plate": 503}


class Study:
    """Lazy building blocks over one :class:`Star`."""

    def __init__(self, star: Star):
        self.star = star

    @cached_property
    def all_controls(self) -> DataFrame:
        return self.star.stored("all-controls", lambda: controls.control_means(self.star.samples, self.star.log2))

    @cached_property
    def train_controls(self) -> DataFrame:
        return self.star.stored("train-controls", lambda: controls.control_means(self.star.train, self.star.log2))

    @cached_property
    def protein_means(self) -> DataFrame:
        return self.star.stored("protein-means", lambda: priors.protein_means(self.star.log2, self.star.train))

    def _fit_totals(self, key: str, prefix: str) -> DataFrame:
        """Sums and counts of train cells per (key, protein)."""
        fit = lambda: prepare.with_samples(self.star.log2, self.star.train.select("sample_id", key))
        return self.star.stored(f"totals-{key}", lambda: priors.group_totals(fit(), [key], "y", prefix))

    @cached_property
    def deltas(self) -> DataFrame:
        """Truth deltas of all treatments against controls of every released row."""
        return controls.truth_deltas(self.star.samples, self.star.log2, self.all_controls)

    @cached_property
    def train_deltas(self) -> DataFrame:
        """Truth deltas of train treatments against train controls."""
        return controls.truth_deltas(self.star.train, self.star.log2, self.train_controls)

    @cached_property
    def context_reference(self) -> DataFrame:
        return self.star.stored("context-reference", lambda: controls.mean_reference(self.train_deltas, ["match_key"], "context_ref"))

    @cached_property
    def drug_reference(self) -> DataFrame:
        return self.star.stored("drug-reference", lambda: controls.mean_reference(self.train_deltas, ["chemical"], "drug_ref"))

    def predicted(self, rows: DataFrame, alphas: dict[str, float] | None = None) -> DataFrame:
        """Add statistical predictions m0 (protein mean), m1 (+ strain), m2 (+ chemical) to cells.

        ``rows`` needs protein, strain and chemical.  ``alphas`` adds further
        strain-shrunk members under the given names.
        """
        strain, chemical = self._fit_totals("strain", "_s"), self._fit_totals("chemical", "_c")
        mean = F.col("protein_mean")
        strain_effect = lambda alpha: priors.shrunk_effect(F.col("_s_n"), F.col("_s_sum") / F.col("_s_n"), mean, alpha)
        chemical_effect = priors.shrunk_effect(F.col("_c_n"), F.col("_c_sum") / F.col("_c_n"), mean, ALPHA)
        wide = (
            rows.join(self.protein_means.select("protein", "protein_mean"), "protein")
            .join(strain, ["strain", "protein"], "left")
            .join(chemical, ["chemical", "protein"], "left")
            .withColumn("m0", mean)
            .withColumn("m1", mean + strain_effect(ALPHA))
            .withColumn("m2", mean + strain_effect(ALPHA) + chemical_effect)
        )
        for name, alpha in (alphas or {}).items():
            wide = wide.withColumn(name, mean + strain_effect(alpha))
        return wide.drop("protein_mean", "_s_sum", "_s_n", "_c_sum", "_c_n")

    @cached_property
    def absolute(self) -> DataFrame:
        """Observed cells of every sample with the three predictions."""
        rows = prepare.with_samples(self.star.log2, self.star.samples.select("sample_id", "split", "kind", "strain", "chemical", "match_key"))
        return self.predicted(rows)

    @cached_property
    def scored(self) -> DataFrame:
        """Treatment cells with control, truth delta, references and predictions."""
        with_refs = controls.with_reference(
            controls.with_reference(self.deltas, self.context_reference, ["match_key"]), self.drug_reference, ["chemical"]
        )
        keep = ["sample_id", "protein", "split", "strain", "chemical", "match_key", "y", "control", "truth_delta", "context_ref", "drug_ref"]
        return self.predicted(with_refs.select(*keep))

    def scored_model(self, column: str) -> DataFrame:
        """The scored table of one predictor under the standard names."""
        return self.scored.withColumn("pred_delta", F.col(column) - F.col("control")).withColumn("m", F.col(column))

    @cached_property
    def chemical_folds(self) -> DataFrame:
        treatments = self.star.train.filter(F.col("kind") == "treatment")
        dealt = folds.balanced_group_folds(treatments, "chemical", FOLDS, SCENARIO_SEEDS["chemical"])
        return self.star.stored("chemical-folds", lambda: dealt.select("chemical", "fold"))

    @cached_property
    def oof(self) -> DataFrame:
        """Out-of-fold cells of the chemical hold-out, derived once per application."""
        return self.star.stored("out-of-fold", self._derive_oof)

    def _derive_oof(self) -> DataFrame:
        """Fold-local predictors and references of every held-out cell.

        The fit side of a fold is every train row outside its held-out chemicals,
        expressed as totals minus the fold's own share.
        """
        train = self.star.train.select("sample_id", "strain", "chemical", "match_key", "kind").join(
            self.chemical_folds, "chemical", "left"
        )
        fit = prepare.with_samples(self.star.log2, train.select("sample_id", "strain", "fold"))
        protein = self.star.stored("oof-protein", lambda: controls.leave_fold_out_mean(fit, [], "y", out="m0"))
        strain = self.star.stored("oof-strain", lambda: controls.leave_fold_out_mean(fit, ["strain"], "y", out="_sm", count_out="_sn"))
        deltas = self.train_deltas.join(self.chemical_folds, "chemical")
        context = self.star.stored("oof-context", lambda: controls.leave_fold_out_mean(deltas, ["match_key"], "truth_delta", out="context_ref"))
        effect = priors.shrunk_effect(F.col("_sn"), F.col("_sm"), F.col("m0"), ALPHA)
        return (
            deltas.select("sample_id", "fold", "strain", "chemical", "match_key", "protein", "y", "control", "truth_delta")
            .join(protein, ["protein", "fold"])
            .join(strain, ["strain", "protein", "fold"])
            .join(context, ["match_key", "protein", "fold"], "left")
            .withColumn("m1", F.col("m0") + effect)
            .withColumn("drug_ref", F.lit(None).cast("double"))
            .drop("_sm", "_sn")
        )

    @cached_property
    def raw_rates(self) -> DataFrame:
        return prepare.missing_rates(self.star.cells, self.star.train)
