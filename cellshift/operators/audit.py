"""Data audits: splits, levels, coverage, overlap, retention, replay."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellshift.functions.numbers import non_finite, ratio
from cellshift.functions.text import composite_key, text_flag
from cellshift.operators import controls
from cellshift.operators.prepare import with_samples


def split_summary(samples: DataFrame, cells: DataFrame) -> DataFrame:
    """Per split: row kinds, observed cells, distinct entities and the list of times."""
    kinds = samples.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[
            F.count(F.when(F.col("kind") == kind, F.lit(1))).alias(name)
            for kind, name in (("treatment", "n_treatments"), ("control", "n_controls"), ("quality_control", "n_quality_controls"))
        ],
        F.size(F.collect_set("strain")).cast("bigint").alias("n_strains"),
        F.size(F.collect_set("chemical")).cast("bigint").alias("n_chemicals"),
        F.array_join(F.transform(F.sort_array(F.collect_set("pert_time")), lambda t: t.cast("string")), "|").alias("times"),
    )
    observed = with_samples(cells, samples.select("sample_id", "split")).groupBy("split").agg(F.count(F.lit(1)).alias("_cells"))
    n_proteins = cells.agg(F.countDistinct("protein")).scalar()
    return (
        kinds.join(observed, "split", "left")
        .withColumn("observed_fraction", ratio(F.coalesce("_cells", F.lit(0)), F.col("n_rows") * n_proteins))
        .drop("_cells")
    )


def level_audit(samples: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Per split and field: number of levels, seen-in-train count and the unseen list."""
    entries = F.array(*[F.struct(F.lit(name).alias("field"), F.col(name).cast("string").alias("level")) for name in fields])
    levels = samples.select("split", F.explode(entries).alias("e")).select("split", "e.field", "e.level").distinct()
    train = levels.filter(F.col("split") == "train").select("field", "level", F.lit(True).alias("_seen"))
    marked = levels.join(train, ["field", "level"], "left")
    return marked.groupBy("split", "field").agg(
        F.count(F.lit(1)).alias("n_levels"),
        F.count("_seen").alias("n_seen_in_train"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("_seen").isNull(), F.col("level")))), "|").alias("unseen"),
    )


def control_coverage(samples: DataFrame, y: DataFrame, pools: dict[str, DataFrame | None]) -> DataFrame:
    """Matched rows and observable delta cells per split and control pool."""
    treated = samples.filter(F.col("kind") == "treatment").select("sample_id", "split", "match_key")
    parts = []
    for label, pool in pools.items():
        flagged = controls.match_flags(treated, samples, pool)
        rows = flagged.groupBy("split").agg(
            F.count(F.lit(1)).alias("n_treatments"), F.count(F.when(F.col("has_exact_match"), F.lit(1))).alias("n_matched")
        )
        means = controls.control_means(samples, y, pool).select("match_key", "protein")
        cells = with_samples(y, treated).join(means, ["match_key", "protein"], "left_semi").groupBy("split").agg(
            F.count(F.lit(1)).alias("n_delta_cells")
        )
        parts.append(rows.join(cells, "split", "left").withColumn("n_delta_cells", F.coalesce("n_delta_cells", F.lit(0))).withColumn("pool", F.lit(label)))
    table = reduce(DataFrame.unionByName, parts)
    return table.withColumn("matched_fraction", ratio(F.col("n_matched"), F.col("n_treatments")))


def context_overlap(samples: DataFrame, tuples: dict[str, Sequence[str]]) -> DataFrame:
    """Share of rows per split whose field tuple also occurs in train."""
    result = samples
    for name, fields in tuples.items():
        keyed = result.withColumn("_k", composite_key(fields))
        seen = samples.filter(F.col("split") == "train").select(composite_key(fields).alias("_k")).distinct().withColumn(f"_{name}", F.lit(1.0))
        result = keyed.join(seen, "_k", "left").drop("_k")
    return result.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.avg(F.coalesce(F.col(f"_{name}"), F.lit(0.0))).alias(f"{name}_seen_fraction") for name in tuples],
    )


def structure_map_issues(mapping: DataFrame, names: DataFrame) -> DataFrame:
    """Missing and extra names, unresolved treatments and duplicate structures: (issue, name)."""
    used = names.select("raw_name").distinct()
    mapped = mapping.select("raw_name").distinct()
    control = F.coalesce(text_flag("is_control"), F.lit(False))
    parts = [
        used.join(mapped, "raw_name", "left_anti").select(F.lit("missing_name").alias("issue"), F.col("raw_name").alias("name")),
        mapped.join(used, "raw_name", "left_anti").select(F.lit("extra_name").alias("issue"), F.col("raw_name").alias("name")),
        mapping.filter(~control & (F.col("status") != "resolved")).select(F.lit("unresolved_noncontrol").alias("issue"), F.col("raw_name").alias("name")),
        mapping.filter((F.col("status") == "resolved") & (F.coalesce("inchikey", F.lit("")) != ""))
        .groupBy(F.col("inchikey").alias("name"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > 1)
        .select(F.lit("duplicate_structure").alias("issue"), "name"),
    ]
    return reduce(DataFrame.unionByName, parts)


def retention_audit(rates: DataFrame, threshold: float) -> DataFrame:
    """Kept and removed proteins with their fit missing rates."""
    return rates.groupBy((F.col("missing_rate") < threshold).alias("kept")).agg(
        F.count(F.lit(1)).alias("n_proteins"),
        F.min("missing_rate").alias("rate_min"),
        F.percentile("missing_rate", 0.5).alias("rate_median"),
        F.max("missing_rate").alias("rate_max"),
    )


def artifact_checks(real: DataFrame, shuffled: DataFrame, mapping: DataFrame, entity: str) -> DataFrame:
    """Feature artifact against its shuffled twin, both long (entity, feature, value).

    Counts entities, non-finite values, key mismatches and shuffled values that
    differ from the declared donor's.
    """
    r = real.select(entity, "feature", F.col("value").alias("_r"))
    s = shuffled.select(entity, "feature", F.col("value").alias("_s"))
    both = r.join(s, [entity, "feature"], "full_outer").join(mapping.withColumnRenamed("recipient", entity), entity, "left")
    donors = r.select(F.col(entity).alias("donor"), "feature", F.col("_r").alias("_d"))
    checked = both.join(donors, ["donor", "feature"], "left")
    count = lambda rule, name: F.count(F.when(rule, F.lit(1))).alias(name)
    return checked.agg(
        F.count(F.lit(1)).alias("n_values"),
        count(non_finite("_r") | non_finite("_s"), "n_non_finite"),
        count(F.col("_r").isNull() | F.col("_s").isNull(), "n_key_mismatch"),
        count(F.abs(F.col("_s") - F.coalesce("_d", "_r")) > 1e-9, "n_not_donor_value"),
        count(F.col("donor") == F.col(entity), "n_fixed_points"),
    )


def replay_comparison(left: DataFrame, right: DataFrame, value: str = "value", tolerance: float = 3e-6) -> DataFrame:
    """Largest and mean absolute difference of two prediction sets and the count above tolerance."""
    pairs = left.select("sample_id", "protein", F.col(value).alias("_l")).join(
        right.select("sample_id", "protein", F.col(value).alias("_r")), ["sample_id", "protein"], "full_outer"
    )
    gap = F.abs(F.col("_l") - F.col("_r"))
    return pairs.agg(
        F.count(gap).alias("n_compared"),
        F.count(F.when(gap.isNull(), F.lit(1))).alias("n_unpaired"),
        F.max(gap).alias("max_abs_diff"),
        F.avg(gap).alias("mean_abs_diff"),
        F.count(F.when(gap > tolerance, F.lit(1))).alias("n_above_tolerance"),
    )
