"""What must not grow with the input: tables on the driver, one task's share, rows kept per group."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

import __spark_entry__ as entry
from cellshift.operators import folds, inference, shuffled
from cellshift.plans import queries_decisions, queries_models
from cellshift.plans.study import Study
from cellshift.sources.star import BUCKET_BYTES, Star
from tests.conftest import SF


def nodes(plan) -> list:
    """Nodes of a plan of the JVM, each before its children."""
    children = plan.children()
    return [plan] + [node for i in range(children.size()) for node in nodes(children.apply(i))]


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def axis_rows(spark):
    rows = [(i, f"s{i % 3}", f"c{i % 5}", "treatment" if i % 4 else "control", i % 2, i % 3) for i in range(40)]
    axis = spark.createDataFrame(rows, "sample_id bigint, strain string, chemical string, kind string, chemical_fold bigint, strain_fold bigint")
    return axis.withColumn("pair_key", F.concat_ws("/", "strain", "chemical"))


def test_fold_membership_joins_no_table_of_samples(spark):
    rows = folds.membership(axis_rows(spark), "S1", 3)
    joins = [line for line in optimized(rows).splitlines() if "Join" in line]
    assert joins and not any("sample_id" in line for line in joins)
    got = {r["sample_id"]: (r["fit"], r["valid"]) for r in rows.collect()}
    assert len(got) == 40 and got[1] == (0b101, 0b010) and got[4] == (0b110, 0)


def test_stitched_winners_broadcast_the_winners_not_the_cells(spark):
    plan = queries_decisions.l03_stitched(Star(spark, SF))._jdf.queryExecution().optimizedPlan()
    joins = [node for node in nodes(plan) if node.nodeName() == "Join"]
    cells, winners = (joins[0].children().apply(i).stats().sizeInBytes() for i in (0, 1))
    assert winners < cells


def test_rank_null_counts_do_not_grow_with_the_rows(spark):
    """The table of bucket counts, which the planner may broadcast: 256 rows a draw at most, not 4096."""
    rows = spark.range(3000).select(F.col("id").alias("k"), F.concat(F.lit("p"), F.col("id") % 4).alias("plate"), F.concat(F.lit("x"), F.col("id") % 3).alias("a"), F.lit("one").alias("b"))
    drawn = inference.permuted_contingency(rows, "k", "plate", ["a", "b"], 2, 7)
    plan = drawn._jdf.queryExecution().optimizedPlan()
    digits = [line for line in plan.toString().splitlines() if "substring(md5" in line]
    assert digits and all(", 1, 2) AS _bucket" in line for line in digits)
    executed = drawn._jdf.queryExecution().executedPlan().toString()
    assert any("SortMergeJoin" in line and "_place" in line for line in executed.splitlines())
    got = {(r["draw"], r["target"], r["u"], r["v"]): r["n"] for r in drawn.collect()}
    want: dict = {}
    for draw in range(2):
        order = {side: sorted(range(3000), key=lambda i: hashlib.md5(f"7-{side}|{draw}|{i}".encode()).hexdigest()) for side in ("to", "from")}
        for to, give in zip(order["to"], order["from"], strict=True):
            for target, v in (("a", f"x{to % 3}"), ("b", "one")):
                want[draw, target, f"p{give % 4}", v] = want.get((draw, target, f"p{give % 4}", v), 0) + 1
    assert got == want


def test_association_table_has_the_whole_null(spark):
    assert {"observed", "null_mean", "null_p95", "p_ge_observed"} <= set(entry.queries()["n08_plate_association_table"](spark, SF).columns)


def test_cells_are_shuffled_once_into_small_buckets(spark):
    star = Star(spark, SF)
    plan = star._derive_cells().repartition(star._buckets(), "sample_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert BUCKET_BYTES <= 16 * 1024 * 1024


def test_views_of_a_cell_need_no_join(spark):
    assert "Join" not in optimized(entry.queries()["d17_delta_and_absolute_views"](spark, SF))


def test_id_sets_are_read_off_one_aggregate(spark):
    assert "Join" not in optimized(entry.queries()["p04_id_set_algebra"](spark, SF))


def test_winner_keeps_no_samples_per_group(spark):
    plan = optimized(entry.queries()["e07_guarded_winner"](spark, SF))
    assert not any("Aggregate [" in line and "sample_id" in line for line in plan.splitlines())


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def joins_by_sample(df) -> list[str]:
    return [line for line in physical(df).splitlines() if "Join" in line and "sample_id" in line]


def test_cells_meet_their_samples_without_a_broadcast(spark):
    star = Star(spark, SF)
    study = Study(star)
    for rows in (study.absolute, study.scored, study.train_deltas, queries_models.member_predictions(star), queries_decisions.seeded_cells(star)):
        joins = joins_by_sample(rows)
        assert joins and all("SortMergeJoin" in line for line in joins)
        assert "Exchange hashpartitioning(sample_id" not in physical(rows)


def test_seed_average_stays_in_the_buckets(spark):
    assert "Exchange hashpartitioning(sample_id" not in physical(entry.queries()["i03_seed_average"](spark, SF))


def test_pairs_are_counted_in_small_buckets(spark):
    """One shuffle of bare keys into buckets, and no count of a whole input split before it."""
    star = Star(spark, SF)
    plan = physical(star.links)
    assert plan.count("Exchange") == 1 and f", {star._buckets()}), REPARTITION_BY_NUM" in plan
    assert plan.index("HashAggregate") < plan.rindex("HashAggregate") < plan.index("Exchange")


def test_regimes_meet_the_cells_in_their_buckets(spark):
    routed = queries_models.routed_cells(Star(spark, SF))
    # The names are looked up in a small table; only ids with their regime are shuffled.
    assert physical(routed).count("Exchange hashpartitioning") == 1
    joins = joins_by_sample(routed)
    assert joins and all("SortMergeJoin" in line for line in joins)


def test_samples_are_derived_without_a_broadcast_of_parts_or_customers(spark):
    plan = physical(Star(spark, SF)._derive_samples())
    joins = [line for line in plan.splitlines() if "Join" in line and ("p_partkey" in line or "o_custkey" in line)]
    assert len(joins) == 2 and all("SortMergeJoin" in line for line in joins)


def test_samples_meet_their_first_parts_without_a_broadcast(spark):
    joins = joins_by_sample(Star(spark, SF)._derive_samples())
    assert len(joins) == 1 and "SortMergeJoin" in joins[0]


def test_first_parts_are_counted_in_the_buckets(spark):
    """Nothing is counted per input split, and the last join stays in the buckets whatever partitions the session asks for."""
    star = Star(spark, SF)
    default = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 50)
        lines = [line.strip(" :+-") for line in physical(star._derive_samples()).splitlines()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", default)
    first = min(i for i, line in enumerate(lines) if "partial_min" in line)
    dealt = [line for line in lines if "Exchange hashpartitioning(sample_id" in line]
    assert lines[first + 1] in dealt and len(dealt) == 3
    assert all(f", {star._buckets()}), REPARTITION_BY_NUM" in line for line in dealt)


def test_orders_travel_wide_only_to_their_customers(spark):
    plan = Star(spark, SF)._derive_samples()._jdf.queryExecution().optimizedPlan()
    wide = [node for node in nodes(plan) if node.nodeName() == "Join" and "o_orderpriority" in node.output().mkString(" ")]
    assert len(wide) == 1


def odd_rows(spark):
    """Keys of one to two blocks of the digest, missing levels, many levels."""
    i = F.col("id")
    key = F.concat(F.when(i % 7 == 0, F.repeat(F.lit("long"), i.cast("int") % 40 + 1)).otherwise(F.lit("")), i.cast("string"))
    return spark.range(1200).select(
        key.alias("k"), F.when(i % 11 > 0, F.concat(F.lit("p"), i % 4)).alias("plate"), F.when(i % 5 > 0, F.concat(F.lit("\u00e9"), i % 3)).alias("a"), (i % 250).alias("b")
    )


def counted(counts) -> list:
    return sorted(map(tuple, counts.select("draw", "target", "u", "v", "n").collect()))


def test_batched_rank_null_counts_what_the_joined_one_counts(spark, monkeypatch):
    """Also over several batches, slices and chunks, and where leading bits leave rows without an order."""
    rows, how = odd_rows(spark), ("k", "plate", ["a", "b"], 5, 7)
    want = counted(inference.permuted_contingency(rows, *how))
    assert counted(shuffled.permuted_counts(rows, *how)) == want
    for name, value in (("BATCH_ROWS", 3000), ("BATCH_DRAWS", 1), ("SLICE_ROWS", 400), ("CHUNK_ROWS", 500)):
        monkeypatch.setattr(shuffled, name, value)
    monkeypatch.setattr(shuffled, "_code_bits", lambda size: 46)
    monkeypatch.setattr(shuffled, "EXPECTED_TIES", 1e9)
    again, batches, tied = [], [], shuffled._tied
    monkeypatch.setattr(shuffled, "_tied", lambda *args: (batches.append(len(args[2])), again.extend(ties := tied(*args)), ties)[2])
    assert counted(shuffled.permuted_counts(rows, *how)) == want
    assert again and max(batches) <= 2 and len(batches) >= 4


def shuffle_bytes(spark) -> int:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
    total = 0
    while files.hasNext():
        file = files.next()
        total += file.length() if file.getName().startswith("shuffle_") else 0
    return total


def test_rank_null_leaves_no_row_per_draw_on_disk(spark):
    """Nothing of draws x rows is left to the driver's garbage collection; a row and draw takes over ten bytes."""
    star = Star(spark, SF)
    draws_x_rows = queries_decisions.PERMUTATIONS * star.samples.count()
    before = shuffle_bytes(spark)
    entry.queries()["k12_permutation_null_by_ranks"](spark, SF).collect()
    assert shuffle_bytes(spark) - before < 2 * draws_x_rows
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_association_table_leaves_no_row_per_draw_on_disk(spark):
    draws_x_rows = queries_decisions.PERMUTATIONS * Star(spark, SF).samples.count()
    before = shuffle_bytes(spark)
    assert entry.queries()["n08_plate_association_table"](spark, SF).count() == 5
    assert shuffle_bytes(spark) - before < 2 * draws_x_rows
