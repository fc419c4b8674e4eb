"""Removal of word sequences that already occur in an earlier document.

Method: suffix automata of reference shards.  A document's words are streamed
through the automaton of a shard; the length of the longest suffix found there is
the matching statistic of a position, and spans that reach the threshold are removed.
Every automaton state carries the smallest document that holds its strings.

The corpus is its own reference, so three steps keep the shards small and complete:

1. Every window of ``window`` words names an anchor, the smallest hash of its 4-word
   sequences.  Equal windows name equal anchors, so an anchor named in one text only
   cannot take part in a repeat.
2. Neighbouring windows with the same shared anchor form one context, and contexts are
   dealt to shards by anchor.  All equal windows meet in one shard.  Anchors with very
   many different contexts are dealt by single windows instead.
3. Equal contexts are one row with their smallest document before they are dealt.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellshift.llm.common import bounded_batches, text_of, words_of
from cellshift.llm.minhash import _lists, _mix
from cellshift.session import written

WINDOW = 13
ANCHOR_WORDS = 4
# Shared anchors that may be broadcast (8 bytes each); beyond it they are joined.
BROADCAST_ANCHORS = 4_000_000
# Contexts of one shard, and of one anchor before it is dealt by windows.
SHARD_CONTEXTS = 4_000
WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Automaton:
    """Suffix automaton over sequences of word codes; each state knows its smallest owner."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]
        self.owner: list = [None]

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(-1)
        self.length.append(length)
        self.owner.append(None)
        return len(self.link) - 1

    def _split(self, parent: int, code, child: int) -> int:
        copy = self._state(self.length[parent] + 1)
        self.next[copy] = dict(self.next[child])
        self.link[copy] = self.link[child]
        self.link[child] = copy
        while parent != -1 and self.next[parent].get(code) == child:
            self.next[parent][code] = copy
            parent = self.link[parent]
        return copy

    def _extend(self, last: int, code) -> int:
        known = self.next[last].get(code)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, code, known)
        state, parent = self._state(self.length[last] + 1), last
        while parent != -1 and code not in self.next[parent]:
            self.next[parent][code] = state
            parent = self.link[parent]
        if parent == -1:
            self.link[state] = 0
        else:
            child = self.next[parent][code]
            self.link[state] = child if self.length[child] == self.length[parent] + 1 else self._split(parent, code, child)
        return state

    def add(self, codes: Iterable, owner) -> None:
        last = 0
        for code in codes:
            last = self._extend(last, code)
            if self.owner[last] is None or owner < self.owner[last]:
                self.owner[last] = owner

    def finish(self) -> Automaton:
        """Hand owners down to shorter suffixes, longest states first."""
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            up, owner = self.link[state], self.owner[state]
            if up > 0 and owner is not None and (self.owner[up] is None or owner < self.owner[up]):
                self.owner[up] = owner
        return self

    def matching_statistics(self, codes: Iterable) -> Iterator[tuple[int, int]]:
        """(state, length) of the longest suffix of the words so far that the shard holds."""
        state = length = 0
        for code in codes:
            while state and code not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if code in self.next[state]:
                state = self.next[state][code]
                length += 1
            yield state, length

    def owner_of_suffix(self, state: int, size: int):
        """Smallest owner of the last ``size`` words of a match at ``state``."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return self.owner[state]


def automaton_of(sequences: Iterable[tuple[Iterable, object]]) -> Automaton:
    built = Automaton()
    for codes, owner in sequences:
        built.add(codes, owner)
    return built.finish()


def _windows(values: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchor hash of the window that starts at each word, and whether that window lies in one text."""
    n = len(values)
    valid = np.zeros(n, bool)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        valid[a : max(a, b - window + 1)] = True
    if n < window:
        return np.zeros(n, np.uint64), valid
    grams = n - ANCHOR_WORDS + 1
    h = np.zeros(grams, np.uint64)
    for k in range(ANCHOR_WORDS):
        h = _mix(h ^ values[k : k + grams]) + np.uint64(0x9E3779B97F4A7C15)
    # Minimum over the window's word sequences by doubling.
    size, span = 1, window - ANCHOR_WORDS + 1
    low = h
    while size * 2 <= span:
        low = np.minimum(low[: len(low) - size], low[size:])
        size *= 2
    rest = span - size
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    anchors = np.zeros(n, np.uint64)
    anchors[: len(low)] = low
    return anchors, valid


def _sequence_hash(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hash of each text's whole word sequence."""
    lengths = np.diff(offsets)
    place = np.arange(len(values), dtype=np.int64) - np.repeat(offsets[:-1] - offsets[0], lengths)
    mixed = _mix(values ^ _mix(place.astype(np.uint64) + np.uint64(1)))
    out = np.zeros(len(lengths), np.uint64)
    some = np.flatnonzero(lengths)
    if len(some):
        out[some] = np.add.reduceat(mixed, (offsets[:-1] - offsets[0])[some])
    return _mix(out ^ lengths.astype(np.uint64))


def _copy_anchor(sequence: np.ndarray) -> np.ndarray:
    """Anchor that stands for a whole text; it is shared when another document has the same words."""
    return _mix(sequence ^ np.uint64(0xD6E8FEB86659FD93))


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    values, offsets = _lists(batch, "words")
    return values[offsets[0] : offsets[-1]], offsets - offsets[0]


def _anchors(window: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values, offsets = _flat(batch)
            anchors, valid = _windows(values, offsets, window)
            sequence = _sequence_hash(values, offsets)
            by_word = np.repeat(sequence, np.diff(offsets))
            # One row per run of windows with the same anchor; further repeats meet in the sums.
            first = valid.copy()
            first[1:] &= ~((anchors[1:] == anchors[:-1]) & valid[:-1])
            long = np.diff(offsets) >= window
            code = batch.column(batch.schema.get_field_index("code")).to_numpy()
            named = np.concatenate([anchors[first], _copy_anchor(sequence)[long]])
            owners = np.concatenate([by_word[first], code[long].view(np.uint64)])
            yield pa.RecordBatch.from_arrays([pa.array(named.view(np.int64)), pa.array(owners.view(np.int64))], ["anchor", "sequence"])

    return emit


def _among(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values a sorted table holds."""
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def _marker(window: int, shared):
    """Contexts of each text whose anchors are shared; ``shared`` is a sorted array or a column of lists."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value if shared is not None else None
        for batch in batches:
            if not batch.num_rows:
                continue
            values, offsets = _flat(batch)
            anchors, valid = _windows(values, offsets, window)
            sequence = _sequence_hash(values, offsets)
            signed = anchors.view(np.int64)
            whole = _copy_anchor(sequence)
            if table is not None:
                known = valid & _among(table, signed)
                copied = _among(table, whole.view(np.int64))
            else:
                own, own_offsets = _lists(batch, "anchors")
                known, copied = np.zeros(len(valid), bool), np.zeros(batch.num_rows, bool)
                for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                    mine = own[own_offsets[i] : own_offsets[i + 1]]
                    if len(mine):
                        known[a:b] = valid[a:b] & np.isin(anchors[a:b], mine)
                        copied[i] = whole[i] in mine
            named = batch.column(batch.schema.get_field_index("doc_id")).is_valid().to_numpy(zero_copy_only=False)
            known &= np.repeat(named, np.diff(offsets))
            begins = known.copy()
            begins[1:] &= ~(known[:-1] & (signed[1:] == signed[:-1]))
            starts = np.flatnonzero(begins)
            ends = known.copy()
            ends[:-1] &= ~(known[1:] & (signed[1:] == signed[:-1]))
            stops = np.flatnonzero(ends) + window
            doc = np.searchsorted(offsets, starts, side="right") - 1
            lengths = stops - starts
            picks = np.repeat(starts, lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            words = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(values[picks].view(np.int64)))
            contexts = pa.StructArray.from_arrays(
                [pa.array(signed[starts]), pa.array((starts - offsets[doc]).astype(np.int64)), words], ["anchor", "start", "words"]
            )
            per_doc = np.bincount(doc, minlength=batch.num_rows)
            listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_doc)]).astype(np.int32)), contexts)
            column = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [column("row"), column("doc_id"), pa.array(sequence.view(np.int64)), pa.array(np.diff(offsets).astype(np.int64)), pa.array(copied), listed],
                ["row", "doc_id", "sequence", "n_words", "copied", "contexts"],
            )

    return emit


def _first_owners(window: int):
    """For each distinct context of a shard: the smallest document of each of its windows."""

    def solve(unit: pd.DataFrame) -> pd.DataFrame:
        contexts = [list(words) for words in unit["words"]]
        shard = automaton_of(zip(contexts, unit["doc_id"], strict=True))
        firsts = [
            [shard.owner_of_suffix(state, window) for state, length in shard.matching_statistics(codes) if length >= window] for codes in contexts
        ]
        return pd.DataFrame({"route": unit["route"], "code": unit["code"], "firsts": firsts})

    return solve


def _cut(window: int):
    """Mark the words under the removed windows and rebuild the text of what is left."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            removed, left = [], []
            for text, starts, whole in zip(frame["text"], frame["starts"], frame["whole"], strict=True):
                words = WORD.findall(text)
                gone = np.zeros(len(words), bool)
                if whole:
                    gone[:] = True
                elif starts is not None and len(starts):
                    edge = np.zeros(len(words) + 1, np.int64)
                    at = np.unique(np.asarray(starts, np.int64))
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                removed.append(int(gone.sum()))
                left.append(" ".join(word for word, out in zip(words, gone, strict=True) if not out))
            yield pd.DataFrame({"row": frame["row"], "n_words": frame["n_words"], "n_removed": removed, "kept_text": left})

    return cut


def _hashed(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(
        F.struct(*docs.columns).alias("row"), F.col(key).alias("doc_id"), F.transform(words_of(text_of(text)), lambda w: F.xxhash64(w)).alias("words")
    )


def shared_anchors(hashed: DataFrame, window: int) -> DataFrame:
    """Anchors named in at least two different texts; copies of one text count once."""
    named = hashed.filter("doc_id is not null").select("words", F.xxhash64("doc_id").alias("code")).mapInArrow(_anchors(window), "anchor bigint, sequence bigint")
    ends = named.groupBy("anchor").agg(F.min("sequence").alias("low"), F.max("sequence").alias("high"))
    return ends.filter("low <> high").select("anchor")


def marked(docs: DataFrame, key: str, text: str, window: int, broadcast_anchors: int) -> DataFrame:
    """Every row with its word count, sequence hash and the contexts of its shared anchors."""
    spark = docs.sparkSession
    hashed = _hashed(docs, key, text)
    shared = written(shared_anchors(hashed, window), "shared-anchors")
    kind = docs.schema[key].dataType
    context = T.ArrayType(T.StructType([T.StructField("anchor", T.LongType()), T.StructField("start", T.LongType()), T.StructField("words", T.ArrayType(T.LongType()))]))
    schema = T.StructType(
        [
            T.StructField("row", hashed.schema["row"].dataType),
            T.StructField("doc_id", kind),
            T.StructField("sequence", T.LongType()),
            T.StructField("n_words", T.LongType()),
            T.StructField("copied", T.BooleanType()),
            T.StructField("contexts", context),
        ]
    )
    if shared.count() <= broadcast_anchors:
        table = np.sort(shared.toArrow()["anchor"].to_numpy())
        return hashed.mapInArrow(_marker(window, spark.sparkContext.broadcast(table)), schema)
    # Too many to broadcast: each text gets the list of its own shared anchors by a join.
    own = hashed.select("doc_id", "words").filter("doc_id is not null").mapInArrow(_named_anchors(window, kind), T.StructType([T.StructField("doc_id", kind), T.StructField("anchor", T.LongType())]))
    lists = own.join(shared, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))
    rows = hashed.join(lists, "doc_id", "left").withColumn("anchors", F.coalesce("anchors", F.array().cast("array<bigint>")))
    return rows.mapInArrow(_marker(window, None), schema)


def _named_anchors(window: int, kind: T.DataType):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values, offsets = _flat(batch)
            anchors, valid = _windows(values, offsets, window)
            first = valid.copy()
            first[1:] &= ~((anchors[1:] == anchors[:-1]) & valid[:-1])
            doc = np.searchsorted(offsets, np.flatnonzero(first), side="right") - 1
            long = np.flatnonzero(np.diff(offsets) >= window)
            ids = batch.column(batch.schema.get_field_index("doc_id")).take(pa.array(np.concatenate([doc, long])))
            named = np.concatenate([anchors[first], _copy_anchor(_sequence_hash(values, offsets))[long]])
            yield pa.RecordBatch.from_arrays([ids, pa.array(named.view(np.int64))], ["doc_id", "anchor"])

    return emit


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, broadcast_anchors: int = BROADCAST_ANCHORS) -> DataFrame:
    """Cut every word under a window that also starts in a document with a smaller key.

    Returns (row, n_words, n_removed, kept_text), ``row`` being the input row; kept words
    are joined by one space.  Windows are judged on the input.  Null texts have no words;
    texts shorter than a window lose nothing.  A null key is not smaller than any other
    and loses nothing.  Rows that share a key do not cut each other.  Word equality is
    decided on 64-bit word hashes, 13 of which must agree in order.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    table = written(marked(docs, key, text, window, broadcast_anchors), "marked-texts", compression="zstd")
    contexts = table.select("doc_id", "sequence", F.explode("contexts").alias("c")).select("doc_id", "sequence", "c.*")
    crowded = contexts.select("anchor", F.xxhash64("words").alias("code")).distinct().groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SHARD_CONTEXTS)
    crowded = written(crowded.select("anchor", F.lit(True).alias("crowded")), "crowded-anchors")
    single = F.transform(
        F.sequence(F.lit(0), F.size("words") - window),
        lambda i: F.struct((F.col("start") + i).alias("start"), F.slice("words", i + 1, F.lit(window)).alias("words")),
    )
    whole = F.array(F.struct("start", "words"))
    dealt = contexts.join(crowded, "anchor", "left").withColumn("piece", F.explode(F.when(F.col("crowded"), single).otherwise(whole)))
    dealt = dealt.select(
        "doc_id", "sequence", F.col("piece.start").alias("start"), F.col("piece.words").alias("words"), F.xxhash64("piece.words").alias("code"), "anchor", "crowded"
    )
    dealt = dealt.withColumn("route", F.when(F.col("crowded"), F.col("code")).otherwise(F.col("anchor"))).drop("anchor", "crowded")
    distinct = dealt.groupBy("route", "code", "words").agg(F.min("doc_id").alias("doc_id"))
    shards = (table.agg(F.sum(F.size("contexts"))).first()[0] or 0) // SHARD_CONTEXTS + 1
    firsts = (
        distinct.withColumn("shard", F.pmod("route", F.lit(shards)))
        .groupBy("shard")
        .applyInPandas(_first_owners(window), f"route bigint, code bigint, firsts array<{kind}>")
    )
    hits = dealt.select("doc_id", "sequence", "start", "route", "code").join(firsts, ["route", "code"])
    starts = F.filter(F.transform("firsts", lambda first, i: F.when(first < F.col("doc_id"), F.col("start") + i)), lambda at: at.isNotNull())
    cuts = hits.withColumn("starts", starts).filter(F.size("starts") > 0).groupBy("doc_id", "sequence").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    copies = table.filter(F.col("copied") & (F.col("n_words") >= window)).select("doc_id", "sequence", "n_words")
    origin = copies.groupBy("sequence", "n_words").agg(F.min("doc_id").alias("first"))
    again = copies.distinct().join(origin, ["sequence", "n_words"]).filter("first < doc_id").select("doc_id", "sequence", F.lit(True).alias("whole"))
    edits = written(cuts.join(again, ["doc_id", "sequence"], "full"), "edits")
    # Only texts that may change are moved; the others are passed on from where they lie.
    may_change = F.col("copied") | (F.size("contexts") > 0)
    plain = F.coalesce(F.col(f"row.{text}").cast("string"), F.lit(""))
    changed = table.filter(may_change).select("row", plain.alias("text"), "n_words", "doc_id", "sequence").join(edits, ["doc_id", "sequence"], "left")
    changed = changed.select("row", "text", "n_words", "starts", F.coalesce("whole", F.lit(False)).alias("whole"))
    schema = T.StructType(
        [
            T.StructField("row", table.schema["row"].dataType),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("kept_text", T.StringType()),
        ]
    )
    same = table.filter(~may_change).select("row", "n_words", F.lit(0).cast("bigint").alias("n_removed"), F.concat_ws(" ", words_of(plain)).alias("kept_text"))
    return changed.mapInPandas(_cut(window), schema).unionByName(same)
