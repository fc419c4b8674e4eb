"""Routed ensemble: member average, per-split blend, support regimes, gated fusion, routing."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellshift.operators import predict
from cellshift.operators.prepare import with_samples
from cellshift.plans.queries_entities import audited
from cellshift.plans.study import Study
from cellshift.sources.star import Star


def routed_ensemble(star: Star, split_weights: Mapping[str, float], members: Mapping[str, float], threshold: float = 0.02, takeover: float = 0.25) -> DataFrame:
    """Final predictions of the held-out rows with their regime.

    Members are averaged column-wise (they share one row), blended with the
    chemical predictor by split; rows of unseen chemicals take the gated fusion.
    """
    study = Study(star)
    held = star.samples.filter(F.col("split") != "train").select("sample_id", "split", "strain", "chemical")
    wide = study.predicted(with_samples(star.log2, held), dict(members))
    names = ["m1", *members]
    average = sum((F.col(name) for name in names), F.lit(0.0)) / F.lit(len(names))
    blended = predict.blend(average, F.col("m2"), predict.split_weight(F.col("split"), split_weights))
    first, second = F.col("m1") - F.col("m0"), F.col("m2") - F.col("m0")
    fused = F.col("m0") + predict.gated_takeover(predict.blend(first, second, 0.5), first, threshold, takeover)
    regimes = audited(star).select("sample_id", "support_regime")
    cells = with_samples(wide.withColumns({"blended": blended, "fused": fused}), regimes)
    return predict.route_rows(cells, {"R10": (1.0, {"fused": 1.0})}, "support_regime", "blended")
