"""Near-duplicate classes by a signature-coordinate inverted join.

Every distinct shingle set is posted under its (coordinate, value) pairs.  A pair of
sets whose signatures agree in at least ``least`` of ``coordinates`` places must meet
in the rarest ``coordinates - least + 1`` postings of each of them, so only these are
joined and the long lists of common values are skipped (prefix filtering over a global
order by list length).  Pairs that meet have their agreements counted, those above the
match threshold are confirmed on the full sets.

Pairs are never enumerated inside a list.  Every list is first compared with its most
central member, whose tokens are the most widespread.  Matches give loose components,
confirmed matches the strict ones.  What is left is compared in blocks of bounded size:
members of one list from different loose components, and members of one loose component
from different strict ones; the latter meet with their full sets and only links come out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cellshift.llm.common import ascii_lower, bounded_batches, text_of, words_of
from cellshift.llm.graphs import components
from cellshift.session import written

COORDINATES = 48
# Agreements that a candidate needs.  At similarity 0.8 the count is binomial(48, 0.8);
# fewer than 25 has probability 3.3e-6.  A text whose coordinates are shared by chance
# (as in a large corpus, where most values occur twice somewhere) seldom has so many.
LEAST_MATCHES = 25
# Members of a block: of signatures, and of full sets.
BLOCK, SET_BLOCK = 1024, 128

_MIX_A = np.uint64(0x9E3779B97F4A7C15)
_MIX_B = np.uint64(0xBF58476D1CE4E5B9)
_MIX_C = np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX_B
    x = (x ^ (x >> np.uint64(27))) * _MIX_C
    return x ^ (x >> np.uint64(31))


def _multipliers(n: int) -> np.ndarray:
    return _mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * _MIX_A) | np.uint64(1)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles of one text's word hashes.

    A text with fewer words is one shingle of all of them; an empty text has none.
    """
    if len(words) == 0:
        return np.empty(0, np.uint64)
    take = min(width, len(words))
    n = len(words) - take + 1
    h = np.full(n, take, np.uint64)
    for k in range(take):
        h = _mix(h ^ words[k : k + n]) + _MIX_A
    return np.unique(h)


def word_hashes(text: Column) -> Column:
    """64-bit hashes of a text's words, lower-cased A-Z."""
    return F.transform(words_of(ascii_lower(text)), lambda word: F.xxhash64(word))


def _lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column(batch.schema.get_field_index(name))
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False).view(np.uint64), offsets


def _list_of(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _signer(width: int, coordinates: int):
    factors = _multipliers(coordinates)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values, offsets = _lists(batch, "words")
            sets = [shingle_hashes(values[a:b], width) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            sizes = np.array([len(s) for s in sets], np.int64)
            some = np.flatnonzero(sizes)
            flat = np.concatenate(sets) if len(some) else np.empty(0, np.uint64)
            starts = (np.cumsum(sizes) - sizes)[some]
            signature = np.zeros((len(some), coordinates), np.int32)
            high, low = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.uint64)
            if len(some):
                for k in range(coordinates):
                    v = flat * factors[2 * k]
                    v = (v ^ (v >> np.uint64(32))) * factors[2 * k + 1]
                    signature[:, k] = (np.minimum.reduceat(v, starts) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                high[some] = np.add.reduceat(_mix(flat), starts)
                low[some] = np.add.reduceat(_mix(flat ^ _MIX_A), starts)
            lengths = np.where(sizes > 0, coordinates, 0)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(batch.schema.get_field_index("doc_id")),
                    pa.array(sizes),
                    pa.array(high.view(np.int64)),
                    pa.array(low.view(np.int64)),
                    _list_of(signature.ravel(), lengths, pa.int32()),
                ],
                ["doc_id", "n_shingles", "set_high", "set_low", "signature"],
            )

    return sign


def signatures(docs: DataFrame, width: int = 2, coordinates: int = COORDINATES) -> DataFrame:
    """(doc_id, n_shingles, set_high, set_low, signature) of every row of (doc_id, text).

    (set_high, set_low) is a 128-bit hash of the set; an empty text has no signature.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", word_hashes(text_of()).alias("words"))
    return rows.mapInArrow(_signer(width, coordinates), f"doc_id {kind}, n_shingles bigint, set_high bigint, set_low bigint, signature array<int>")


def _setter(width: int):
    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values, offsets = _lists(batch, "words")
            sets = [shingle_hashes(values[a:b], width).view(np.int64) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            lengths = np.array([len(s) for s in sets], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")), _list_of(np.concatenate(sets), lengths, pa.int64())], ["doc_id", "shingles"]
            )

    return collect


def shingle_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(doc_id, shingles) of the documents named in ``wanted``; only these are hashed in full."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.join(wanted.hint("shuffle_hash"), "doc_id", "left_semi").select("doc_id", word_hashes(text_of()).alias("words"))
    return rows.mapInArrow(_setter(width), f"doc_id {kind}, shingles array<bigint>").dropDuplicates(["doc_id"])


def prefix_postings(signed: DataFrame, least: int) -> DataFrame:
    """(token, doc_id, weight): each document under its rarest tokens, as many as any match must touch.

    A token is a coordinate with its value.  Tokens of a single document lie in front
    of the order and meet nobody, so they only use up prefix places; a document with
    fewer than ``least`` shared tokens meets nobody at all.  The weight is the number of
    postings that a document's tokens share; it is largest for the original of many copies.
    """
    spread = signed.select("doc_id", F.posexplode("signature").alias("place", "value")).select(
        "doc_id", (F.col("place").cast("bigint") * F.lit(1 << 32) + F.col("value")).alias("token")
    )
    shared = spread.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    listed = spread.join(shared, "token").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("tokens"))
    prefix = F.slice("tokens", F.lit(1), F.size("tokens") - least + 1)
    weight = F.aggregate("tokens", F.lit(0).cast("bigint"), lambda acc, t: acc + t["n"])
    return listed.filter(F.size("tokens") >= least).select("doc_id", weight.alias("weight"), F.explode(prefix).alias("t")).select(F.col("t.token").alias("token"), "doc_id", "weight")


def _agreements(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda n, x: n + x)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the similarity: 100 * shared >= percent * all."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    measured = both.select("a", "b", (F.size("sa") + F.size("sb")).alias("total"), shared.alias("shared"))
    return measured.filter(100 * F.col("shared") >= percent * (F.col("total") - F.col("shared"))).select("a", "b")


def _near_pairs(percent: int, least: int, coordinates: int):
    """Matching pairs between askers and members of other labels, sizes permitting."""

    def compare(unit: pa.Table) -> list[tuple]:
        doc, label, asks, size = (unit[c].to_numpy() for c in ("doc_id", "label", "asks", "n_shingles"))
        signature = unit["signature"].combine_chunks().flatten().to_numpy().reshape(-1, coordinates)
        found = []
        for i in np.flatnonzero(asks):
            fits = 100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i])
            near = np.flatnonzero(~asks & (label != label[i]) & fits)
            near = near[(signature[near] == signature[i]).sum(axis=1) >= least]
            found += [(min(doc[i], doc[j]), max(doc[i], doc[j])) for j in near]
        return found

    return compare


def _linked_pairs(percent: int, least: int, coordinates: int):
    """Links between askers and members of other labels, one for each asker and label."""

    def compare(unit: pa.Table) -> list[tuple]:
        doc, label, asks = (unit[c].to_numpy() for c in ("doc_id", "label", "asks"))
        signature = unit["signature"].combine_chunks().flatten().to_numpy().reshape(-1, coordinates)
        listed = unit["shingles"].combine_chunks()
        flat, ends = listed.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(listed.value_lengths().to_numpy())])
        found = []
        for i in np.flatnonzero(asks):
            near = np.flatnonzero(~asks & (label != label[i]))
            near = near[(signature[near] == signature[i]).sum(axis=1) >= least]
            if not len(near):
                continue
            own, sizes = flat[ends[i] : ends[i + 1]], ends[near + 1] - ends[near]
            others = np.concatenate([flat[ends[j] : ends[j + 1]] for j in near])
            hit = own[np.minimum(np.searchsorted(own, others), len(own) - 1)] == others
            shared = np.add.reduceat(hit, np.cumsum(sizes) - sizes, dtype=np.int64)
            linked = near[100 * shared >= percent * (len(own) + sizes - shared)]
            _, first = np.unique(label[linked], return_index=True)
            found += [(min(doc[i], doc[j]), max(doc[i], doc[j])) for j in linked[first]]
        return found

    return compare


def _by_unit(compare, kind: pa.DataType):
    """Run ``compare`` on units that arrive one after the other, sorted by unit."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(found: list[tuple]) -> pa.RecordBatch:
            pairs = sorted(set(found))
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], kind), pa.array([p[1] for p in pairs], kind)], ["a", "b"])

        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            unit = np.stack([rows[c].to_numpy() for c in ("team", "a", "q")])
            edges = np.concatenate([[0], np.flatnonzero((unit[:, 1:] != unit[:, :-1]).any(axis=0)) + 1])
            # The last unit may go on in the next batch.
            found = [pair for first, last in zip(edges[:-1], edges[1:], strict=True) for pair in compare(rows.slice(first, last - first))]
            held = rows.slice(edges[-1])
            yield result(found)
        if held is not None:
            yield result(compare(held))

    return walk


def compare_apart(placed: DataFrame, payload: DataFrame, compare, block: int) -> DataFrame:
    """Pairs (a, b) that ``compare`` finds between members of one team with different labels.

    ``placed`` has (team, doc_id, label), ``payload`` (doc_id, ...) what is compared.  In a
    team the largest label asks nothing of itself: the others' members ask all members.
    Both sides are cut into blocks, one unit of work per block pair.
    """
    kind = placed.schema["doc_id"].dataType
    per_label = placed.groupBy("team", "label").agg(F.count(F.lit(1)).alias("n"))
    split = (
        per_label.groupBy("team")
        .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("labels"), F.max(F.struct("n", "label")).alias("top"))
        .filter("labels > 1")
        .select("team", F.col("top.label").alias("main"), F.ceil(F.col("n") / block).cast("int").alias("na"), F.ceil((F.col("n") - F.col("top.n")) / block).cast("int").alias("nq"))
    )
    rows = placed.join(split, "team").join(payload, "doc_id")
    place = F.xxhash64("doc_id", "team")
    carried = ["team", "doc_id", "label", *[c for c in payload.columns if c != "doc_id"]]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = rows.select(*carried, F.lit(False).alias("asks"), F.pmod(place, F.col("na")).cast("int").alias("a"), every("nq").alias("q"))
    asks = rows.filter("label <> main").select(*carried, F.lit(True).alias("asks"), every("na").alias("a"), F.pmod(place, F.col("nq")).cast("int").alias("q"))
    units = members.unionByName(asks).repartition("team", "a", "q").sortWithinPartitions("team", "a", "q")
    ddl = kind.simpleString()
    return units.mapInArrow(_by_unit(compare, to_arrow_type(kind)), f"a {ddl}, b {ddl}").distinct()


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with the label of their doc_id, its own where it has none."""
    return rows.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))


def hub_pairs(postings: DataFrame) -> DataFrame:
    """Pairs (a, b) of every list member with the list's most central member."""
    hubs = postings.groupBy("token").agg(F.max(F.struct("weight", "doc_id")).alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = postings.join(hubs.select("token", F.col("hub.doc_id").alias("hub")), "token").filter("doc_id <> hub")
    return met.select(F.least("doc_id", "hub").alias("a"), F.greatest("doc_id", "hub").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, coordinates: int = COORDINATES, least: int = LEAST_MATCHES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_shingles, component_id, kept.

    Two documents are linked when 100 * |A and B| >= percent * |A or B| for their sets
    of ``width``-word shingles; component_id is the smallest doc_id reachable by links.
    Null and empty texts have no shingles and link with nothing.  Equal sets are one
    node, so copies cost one row each.  Repeated rows get equal answers.  Rows without
    a doc_id link with nothing, have a null component and are kept.  Other columns of
    ``docs`` are ignored.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    signed = written(signatures(docs, width, coordinates), "signatures")
    sets_of = signed.filter("n_shingles > 0 and doc_id is not null").groupBy("set_high", "set_low")
    nodes = written(sets_of.agg(F.min(F.struct("doc_id", "n_shingles", "signature")).alias("first")).select("set_high", "set_low", "first.*"), "shingle-sets")
    postings = written(prefix_postings(nodes, least), "postings")
    signature = nodes.select("doc_id", "n_shingles", "signature")
    left, right = (signature.select(*[F.col(x).alias(y + c) for x, y in (("doc_id", ""), ("n_shingles", "n"), ("signature", "s"))]) for c in ("a", "b"))
    # Sets of similarity s have sizes within a factor s of each other.
    fits = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    met = hub_pairs(postings).join(left, "a").join(right, "b").filter(fits & (_agreements("sa", "sb") >= least)).select("a", "b")
    met = written(met, "met-pairs")
    loose = components(met, "a", "b")
    lists = _labelled(postings.select(F.col("token").alias("team"), "doc_id"), loose)
    apart = written(compare_apart(lists, signature, _near_pairs(percent, least, coordinates), BLOCK), "apart-pairs")
    pairs = met.unionByName(apart)
    # Full sets of those that met a match, hashed once.
    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    sets = written(shingle_sets(docs, wanted, width), "sets")
    links = written(confirm(pairs, sets, percent), "links")
    strict = components(links, "a", "b")
    groups = _labelled(loose.select(F.col("node").alias("doc_id"), F.col("label").alias("team")), strict)
    mixed = groups.groupBy("team").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("team")
    groups = written(groups.join(mixed, "team", "left_semi"), "mixed-groups")
    payload = signature.drop("n_shingles").join(sets.join(groups.select("doc_id").distinct(), "doc_id", "left_semi"), "doc_id")
    within = written(compare_apart(groups, payload, _linked_pairs(percent, least, coordinates), SET_BLOCK), "links-within")
    links = links.unionByName(within)
    labels = components(links, "a", "b")
    named = nodes.join(labels, nodes["doc_id"] == labels["node"], "left").select("set_high", "set_low", F.coalesce("label", "doc_id").alias("component_id"))
    rows = signed.select("doc_id", "n_shingles", *[F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col(c)).alias(c) for c in ("set_high", "set_low")])
    joined = rows.join(named, ["set_high", "set_low"], "left")
    component = F.coalesce("component_id", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each near-duplicate class: that of the smallest doc_id, all columns kept.

    Repeated rows of one doc_id are one document and leave one row.
    """
    found = near_duplicates(docs.select("doc_id", "text"), width, percent).filter("kept").select("doc_id").distinct()
    unnamed = docs.filter(F.col("doc_id").isNull())
    named = docs.join(found.filter("doc_id is not null").hint("shuffle_hash"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.select(*docs.columns).unionByName(unnamed)
