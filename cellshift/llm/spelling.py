"""Spelling variants of a corpus' vocabulary, by composing acceptors with a one-edit transducer.

Words are counted over whole texts.  Of two words one edit apart, the shorter one of m
letters, either the first k letters agree or the last m - k do.  So the search space of
the composition falls apart into partitions by initial state: all words that share a head
(or, read backwards, a tail) of that length, for every m.  Within a partition the words of
m and of m + 1 letters become minimal acceptors over one register, so states with equal
right languages are one state.  The composition walks both along equal labels (state pair
before the edit), takes one edit arc, and intersects the right languages behind it.

A partition with more words than ``MOST_WORDS`` is entered ``STEP`` letters deeper; pairs
whose edit lies at one of the letters passed over meet in partitions of their own, named
by what both words have besides that letter, which no alphabet of 90 letters can fill.
Partitions yield one row per word (number of near words, most frequent one), never pairs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from os.path import commonprefix
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellshift.llm.common import bounded_batches, partitions_for, text_of
from cellshift.session import written

LEAST_LENGTH, LEAST_COUNT, RATIO, RATE = 7, 2, 10, 31
MOST_WORDS, STEP = 20_000, 4
FLUSH_WORDS, ROWS_PER_TASK = 200_000, 100_000
NO_END = 1 << 30

# In Latin-1: letters a-z and U+00C0 to U+00FF stay, A-Z become lower case, the rest is blank.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 192 or 97 <= b <= 122 else 32 for b in range(256))


def noted(run: bytes, seed: int, rate: int) -> bytes:
    """The run as it is counted: where ``rate`` divides its digest, one code point is gone."""
    h = crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
    return run if h % rate else run[: h % len(run)] + run[h % len(run) + 1 :]


def _counter(least: int, rate: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def table() -> pa.RecordBatch:
            words = [w.decode("latin-1") for w in counts]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            ids, texts = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "text"))
            for doc, text in zip(ids, texts, strict=True):
                seed = crc32(b"%d:" % doc if doc is not None else b":")
                own = Counter(text.encode("latin-1", "replace").translate(LETTERS).split())
                runs = [w for w in own if len(w) >= least]
                for run, word in zip(runs, map(noted, runs, repeat(seed), repeat(rate)), strict=True):
                    if len(word) >= least:
                        counts[word] += own[run]
                if len(counts) > FLUSH_WORDS:
                    yield table()
                    counts.clear()
        yield table()

    return count


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, rate: int = RATE) -> DataFrame:
    """(word, n): words of at least ``least_length`` letters found ``least_count`` times over all rows of (doc_id, text)."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    counts = rows.mapInArrow(_counter(least_length, rate), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.filter(F.col("n") >= least_count)


class Acceptors:
    """Minimal acyclic acceptors over one register; a state's arcs are (letter, state) in order.

    All words of one acceptor have equal length, so only state 0 is final and has no arcs.
    """

    def __init__(self) -> None:
        self.arcs: list[tuple] = [()]
        self.branching = [False]
        self.register: dict[tuple, int] = {(): 0}
        self._common: dict[tuple[int, int], list[str]] = {}

    def accept(self, words: list[str]) -> int:
        """Initial state of the acceptor of sorted distinct words, -1 for none."""
        if not words:
            return -1
        open_: list[list] = [[]]
        previous = ""

        def close(depth: int) -> None:
            while len(open_) > depth + 1:
                state = self._state(tuple(open_.pop()))
                open_[-1].append((previous[len(open_) - 1], state))

        for word in words:
            close(len(commonprefix((previous, word))))
            open_.extend([] for _ in range(len(word) + 1 - len(open_)))
            previous = word
        close(0)
        return self._state(tuple(open_[0]))

    def _state(self, arcs: tuple) -> int:
        state = self.register.setdefault(arcs, len(self.arcs))
        if state == len(self.arcs):
            self.arcs.append(arcs)
            self.branching.append(len(arcs) > 1 or any(self.branching[to] for _, to in arcs))
        return state

    def common(self, p: int, q: int) -> list[str]:
        """Words accepted from both states, which are equally far from the end."""
        found = self._common.get((p, q))
        if found is not None:
            return found
        found, path, stack = [], [], [(p, q, 0, "")]
        while stack:
            p_, q_, depth, letter = stack.pop()
            path[max(depth - 1, 0) :] = [letter]
            if p_ == 0 or q_ == 0:
                if p_ == q_:
                    found.append("".join(path[:depth]))
                continue
            others = None if p_ == q_ else dict(self.arcs[q_])
            for label, to in self.arcs[p_]:
                other = to if others is None else others.get(label)
                if other is not None:
                    stack.append((to, other, depth + 1, label))
        self._common[p, q] = found
        return found

    def edits(self, p: int, q: int) -> list[tuple[str, str]]:
        """Pairs of rests with the edit at their first letter: replaced within p, inserted from p to q.

        An inserted letter that equals the next one could stand there as well; such a
        pair belongs to the state behind it.
        """
        arcs = self.arcs[p]
        pairs = [(x + rest, y + rest) for i, (x, a) in enumerate(arcs) for y, b in arcs[i + 1 :] for rest in self.common(a, b)]
        # Along a run of one letter all rests begin with it; then there is nothing to list.
        for x, a in self.arcs[q] if q >= 0 else ():
            if not arcs or any(label != x for label, _ in arcs):
                pairs += [(rest, x + rest) for rest in self.common(a, p) if rest[:1] != x]
        return pairs

    def one_edit(self, p: int, q: int, deepest: int) -> Iterator[tuple[str, str]]:
        """Accepted pairs of the composition from a pair of initial states (of m and of m + 1 letters)."""
        path: list[str] = []
        stack = [(p, q, 0, "")] if p >= 0 else []
        while stack:
            p, q, depth, letter = stack.pop()
            path[max(depth - 1, 0) :] = [letter]
            pairs = self.edits(p, q) if q >= 0 or len(self.arcs[p]) > 1 else ()
            if pairs:
                head = "".join(path[:depth])
                for a, b in pairs:
                    yield head + a, head + b
            if depth < deepest:
                others = dict(self.arcs[q]) if q >= 0 else {}
                for label, to in self.arcs[p]:
                    other = others.get(label, -1)
                    if other >= 0 or self.branching[to]:
                        stack.append((to, other, depth + 1, label))


def near_in(m: int, backward: bool, low: int, high: int, counts: dict[str, int]) -> dict[str, list]:
    """word -> [near words, largest count of one, that word] within one partition.

    ``counts`` has the words of m and m + 1 letters in order, spelt backwards where
    ``backward``; all share the first ``low`` letters.  Backward partitions leave out
    pairs that share their first letters too: those meet in a forward one.
    """
    acceptors, k = Acceptors(), (m - 1) // 2
    tails = [[w[low:] for w in counts if len(w) == n] for n in (m, m + 1)]
    found: dict[str, list] = {}
    if not tails[0] or len(counts) < 2:
        return found
    turn, head = -1 if backward else 1, next(iter(counts))[:low]
    for a, b in acceptors.one_edit(acceptors.accept(tails[0]), acceptors.accept(tails[1]), high - low):
        a, b = head + a, head + b
        if backward and a[-k:] == b[-k:]:
            continue
        for word, other in ((a, b), (b, a)):
            key, near, n = word[::turn], other[::turn], counts[other]
            entry = found.get(key)
            if entry is None:
                found[key] = [1, n, near]
            else:
                entry[0] += 1
                if n > entry[1] or n == entry[1] and near < entry[2]:
                    entry[1:] = [n, near]
    return found


def _composer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["part", "m", "backward", "low", "high", "text", "n"]
    key, counts = None, {}
    rows: list[tuple] = []

    def table() -> pa.RecordBatch:
        words, sizes, most, best = zip(*rows, strict=True) if rows else ((), (), (), ())
        arrays = [pa.array(words, pa.string()), pa.array(sizes, pa.int64()), pa.array(most, pa.int64()), pa.array(best, pa.string())]
        rows.clear()
        return pa.RecordBatch.from_arrays(arrays, ["word", "n_near", "best_n", "best"])

    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names]
        for part, m, backward, low, high, text, n in zip(*columns, strict=True):
            here = (part, m, backward, low, high, text[:low])
            if here != key:
                if len(counts) > 1:
                    rows += ((word, *entry) for word, entry in near_in(*key[1:5], counts).items())
                key, counts = here, {}
            counts[text] = n
        if rows:
            yield table()
    if len(counts) > 1:
        rows += ((word, *entry) for word, entry in near_in(*key[1:5], counts).items())
    yield table()


def _named(low: Column, *rest: Column) -> Column:
    return F.xxhash64(F.col("m"), F.col("backward"), low, *rest)


def initial_partitions(words: DataFrame, shortest: int) -> DataFrame:
    """Each word of (word, n) under the heads and tails by which its near words are found."""
    length = F.length("word")
    kinds = F.array(*[F.struct((length - F.lit(less)).alias("m"), F.lit(back).alias("backward")) for less in (0, 1) for back in (False, True)])
    rows = words.select("word", "n", F.explode(kinds).alias("kind")).select("word", "n", "kind.*").filter(F.col("m") >= shortest)
    k = F.expr("(m - 1) div 2").cast("int")
    rows = rows.select(
        "m",
        "backward",
        F.when(F.col("backward"), F.col("m") - k).otherwise(k).alias("low"),
        F.lit(NO_END).alias("high"),
        F.when(F.col("backward"), F.reverse("word")).otherwise(F.col("word")).alias("text"),
        "n",
    )
    return rows.withColumn("part", _named(F.col("low"), F.substr("text", F.lit(1), F.col("low"))))


def deeper(rows: DataFrame, step: int) -> DataFrame:
    """Partitions entered ``step`` letters deeper, and those of edits at the letters passed over."""
    low, text = F.col("low"), F.col("text")
    short, onward = F.length(text) == F.col("m"), F.col("m") >= low + step
    far = rows.filter(onward).withColumn("low", low + step).withColumn("part", _named(F.col("low"), F.substr(text, F.lit(1), F.col("low"))))
    at = rows.withColumn("at", F.explode(F.sequence(low, low + F.lit(step - 1)))).filter(F.col("at") <= F.col("m"))
    head, rest = F.substr(text, F.lit(1), F.col("at")), F.substr(text, F.col("at") + 2)
    passed = lambda kind, *named: _named(F.col("at"), F.lit(kind), *named)
    whole, without, open_ = passed("insert", text), passed("insert", F.concat(head, rest)), passed("replace", head, rest)
    parts = F.when(short, F.array(whole, open_)).otherwise(F.array(without))
    edge = at.withColumn("part", F.explode(parts)).withColumn("low", F.col("at")).withColumn("high", F.col("at")).drop("at")
    return far.unionByName(edge)


def near_words(words: DataFrame, shortest: int = LEAST_LENGTH, most: int = MOST_WORDS, step: int = STEP) -> DataFrame:
    """(word, n_near, best_n, best) of the words of (word, n) that have near words.

    Words are distinct; ``best`` is the near word with the largest count, ties to the
    smaller one.
    """
    spark = words.sparkSession
    rows = written(initial_partitions(words, shortest), "partitions")
    ready = []
    while True:
        hot = written(rows.filter(F.col("high") == NO_END).groupBy("part").agg(F.count(F.lit(1)).alias("words")).filter(F.col("words") > most).select("part"), "large-partitions")
        if hot.isEmpty():
            break
        ready.append(rows.join(hot, "part", "left_anti"))
        rows = written(deeper(rows.join(hot, "part", "left_semi"), step), "partitions")
    for part in ready:
        rows = rows.unionByName(part.select(*rows.columns))
    dealt = rows.repartition(partitions_for(rows.count(), ROWS_PER_TASK, spark), "part").sortWithinPartitions("part", "m", "backward", "low", "high", "text")
    found = dealt.mapInArrow(_composer, "word string, n_near bigint, best_n bigint, best string")
    first = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("first")).select("word", "n_near", (-F.col("first.less")).alias("best_n"), "first.best")


def with_roots(words: DataFrame) -> DataFrame:
    """Add ``root``: where the forms of (word, form, ...) lead in the end, the word itself without one.

    A form is many times as frequent as its word, so chains are short and end.
    """
    forms = words.filter(F.col("form").isNotNull())
    links = forms.select(F.col("word").alias("root"), F.col("form").alias("next"))
    roots = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        moved = written(roots.join(links, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        roots = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return words.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, ratio: int = RATIO, shortest: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, rate: int = RATE, most: int = MOST_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of (doc_id, text).

    A word's form is its most frequent near word, if that is ``ratio`` times as frequent.
    Null and empty texts have no words, a null id counts as an empty one in the digest,
    repeated rows count each; other columns are not looked at.
    """
    words = written(vocabulary(docs, shortest, least_count, rate), "vocabulary")
    joined = words.join(near_words(words, shortest, most), "word", "left")
    fits = F.col("best_n") >= ratio * F.col("n")
    formed = written(
        joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(fits, F.col("best")).alias("form"), F.when(fits, F.col("best_n")).alias("form_n")),
        "forms",
    )
    return with_roots(formed).select("word", "form", "root", "n", "n_near", "form_n")
