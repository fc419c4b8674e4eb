"""Importance resampling, toxicity and spelling variants against plain versions and on odd tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellshift.llm import resampling, spelling, toxicity

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def make(spark, rows, schema="doc_id bigint, text string, n bigint, part string, score double"):
    """Rows with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(d, t, 1, "p", 0.5) for d, t in rows], schema)


# --- importance resampling -------------------------------------------------------------


def runs(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(words), [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def plain_resample(docs, target, percent=5, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, runs(text)[1]))
    for text in target:
        t.update(map(bucket, runs(text)[1]))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000))))
    out = []
    for doc, text in docs:
        words, found = runs(text)
        weight = sum(gain(bucket(f)) for f in found)
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, words, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    ranked = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for i, row in enumerate(ranked[: percent * len(ranked) // 100]):
        row[5] = i + 1
    return sorted((tuple(r) for r in out), key=str)


def test_resampling_equals_a_plain_version(spark):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcXYZ019") for _ in range(rng.randint(1, 6))) for _ in range(60)] + ["É", "日本", "x\u00a0y", "🙂"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", "\n", "--", "'", "\x00"]) for _ in range(n))
    docs = [(i, text(rng.choice([0, 5, 19, 20, 25, 80]))) for i in range(300)] + [(300, None), (301, ""), (302, "w " * 60_000), (None, text(40)), (None, text(40)), (5, text(30)), (5, text(30))]
    docs += [(i, docs[4][1]) for i in range(400, 420)]
    target = [text(200), None, "", text(50)]
    got = resampling.resample(make(spark, docs), spark.createDataFrame([(t, 1) for t in target], "text string, doc_id bigint"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_resample(docs, target)


def test_resampling_ranks_do_not_depend_on_ranges(spark, monkeypatch):
    docs = [(i, f"w{i % 7} " * 25) for i in range(200)]
    want = plain_resample(docs, ["w1 w2"], percent=30)
    monkeypatch.setattr(resampling, "ROWS_PER_RANGE", 9)
    got = resampling.resample(make(spark, docs), spark.createDataFrame([("w1 w2",)], "text string"), percent=30)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_resampling_of_empty_tables(spark):
    none, some = make(spark, []), make(spark, [(1, "a b c " * 10)])
    assert resampling.resample(none, some.select("text")).count() == 0
    (row,) = resampling.resample(some, none.select("text"), percent=100).collect()
    assert (row.n_features, row["rank"]) == (87, 1) and row.weight < 0


# --- spelling variants -----------------------------------------------------------------


def plain_variants(docs):
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            word = run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(word) >= 7:
                counts[word] += 1
    words = {w: n for w, n in counts.items() if n >= 2}

    def near(a, b):
        a, b = sorted((a, b), key=len)
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    links = {w: [] for w in words}
    for a, b in combinations(words, 2):
        if near(a, b):
            links[a].append(b)
            links[b].append(a)
    form = {}
    for w, n in words.items():
        best = min(links[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 10 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(links[w]), words[form[w]] if form[w] else None))
    return sorted(out)


@pytest.fixture(scope="module")
def misspelt():
    """Few letters, so words have many near words; frequent bases, chains of forms and long words."""
    rng = random.Random(9)
    bases = ["".join(rng.choice("abÀ") for _ in range(rng.randint(7, 10))) for _ in range(60)] + ["prefixedlongword" + "".join(rng.choice("xy") for _ in range(4)) for _ in range(16)]

    def changed(word):
        i = rng.randrange(len(word))
        return rng.choice([word[:i] + word[i + 1 :], word[:i] + rng.choice("abÀ") + word[i:], word[:i] + rng.choice("abÿ") + word[i + 1 :]])

    docs = []
    for i in range(250):
        words = [rng.choice(bases[:6] * 6 + bases) for _ in range(40)]
        words = [changed(w) if rng.random() < 0.3 else w for w in words]
        docs.append((i, " ".join(w.upper() if rng.random() < 0.1 else w for w in words)))
    return docs + [(1000, None), (1001, ""), (1002, "z" * 50_000 + " " + "z" * 50_001), (1003, "z" * 50_000 + " " + "z" * 50_001), (None, "aaaaaaaa aaaaaaaa"), docs[0], docs[0]]


@pytest.mark.parametrize("most", [20_000, 6])
def test_variants_equal_all_pairs(spark, misspelt, most):
    got = spelling.variants(make(spark, misspelt), most=most)
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(plain_variants(misspelt), key=str)


def test_variants_of_empty_tables(spark):
    assert spelling.variants(make(spark, [])).count() == 0
    assert spelling.variants(make(spark, [(1, None), (2, "short words")])).count() == 0


def test_equal_right_languages_are_one_state():
    acceptors = spelling.Acceptors()
    words = sorted(a + b for a in ("tap", "top", "sip") for b in ("ped", "per"))
    root = acceptors.accept(words)
    assert acceptors.accept(words) == root and acceptors.common(root, root) and sorted(acceptors.common(root, root)) == words
    assert len(acceptors.arcs) < len({w[:k] for w in words for k in range(len(w) + 1)})
    assert acceptors.accept([]) == -1


# --- toxicity --------------------------------------------------------------------------


def test_nearest_examples_are_exact():
    rng = random.Random(6)
    terms = [(f"t{i}", rng.uniform(1, 5)) for i in range(40)]
    vectors = toxicity.Vectors(terms)
    keys = [tuple(sorted({rng.randrange(40): rng.randint(1, 5) for _ in range(rng.randint(1, 8))}.items())) for _ in range(700)]
    units = [vectors.unit(k) for k in keys]
    index = toxicity.BlockMaxIndex(units, len(terms), block=16)
    dense = np.zeros((len(keys), len(terms)))
    for row, (at, weights) in zip(dense, units, strict=True):
        row[at] = weights
    for places, weights in units[:120]:
        query = np.zeros(len(terms))
        query[places] = weights
        cosines = dense @ query
        want = sorted(((-c, i) for i, c in enumerate(cosines.tolist()) if c > 0))[:9]
        got = index.nearest(places, weights, 9)
        assert np.allclose([c for c, _ in got], [-c for c, _ in want])
        assert all(abs(cosines[i] - c) < 1e-9 for c, i in got)
    assert toxicity.BlockMaxIndex([], 3).nearest(np.array([1]), np.array([1.0]), 5) == []


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    rows = []
    for i in range(600):
        words, bad = [rng.choice(vocabulary) for _ in range(40)], i % 6 == 0
        if bad:
            words[rng.randrange(40)] = rng.choice(["nastyish", "nastyly", "rotten", "Vile!"])
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_scores_separate_labels_they_have_not_seen(spark, labelled):
    docs = make(spark, [(d, t) for d, t, _ in labelled] + [(9000, None), (9001, ""), (9002, "x " * 60_000 + "nastyfully"), (9003, "?!"), (None, "rotten"), (7, "again"), (7, "again")])
    labels = spark.createDataFrame([(d, y, "clash") for d, _, y in labelled if d % 4] + [(None, 1, ""), (9000, None, ""), (1, 0, ""), (1, 0, "")], "doc_id bigint, label int, text string")
    judge = toxicity.learn(docs, labels)
    got = toxicity.scores(docs, judge).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    truth = {d: y for d, _, y in labelled if d % 4 == 0}
    found = {r.doc_id: r.score >= toxicity.THRESHOLD for r in got if r.doc_id in truth}
    assert sum(found[d] == bool(y) for d, y in truth.items()) >= 0.97 * len(truth)
    by_id = {r.doc_id: r for r in got}
    assert by_id[9000].score == by_id[9001].score == by_id[9003].score < toxicity.THRESHOLD and by_id[9000].evidence == []
    assert by_id[9002].score >= toxicity.THRESHOLD and by_id[9002].evidence[0].toxic_share > 0.5


def test_toxicity_without_labels_or_rows(spark, labelled):
    docs = make(spark, [(d, t) for d, t, _ in labelled[:20]])
    none = spark.createDataFrame([], "doc_id bigint, label int")
    assert {r.score for r in toxicity.scores(docs, toxicity.learn(docs, none)).collect()} == {0.0}
    assert toxicity.scores(docs.limit(0), toxicity.learn(docs.limit(0), none)).count() == 0
    one = toxicity.learn(docs, docs.select("doc_id", F.lit(1).alias("label")))
    assert {r.score for r in toxicity.scores(docs, one).collect()} == {1.0}


def test_learning_rows_are_bounded_and_distinct(spark):
    docs = make(spark, [(i, f"text {i // 2}") for i in range(2000)])
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("label"))
    rows = toxicity.learning_rows(docs, labels, most=10_000)
    assert rows.count() == 1000 and rows.filter("label = 1").count() == 1000
    assert 150 < toxicity.learning_rows(docs, labels, most=300).count() < 450
    assert {r.h for r in docs.select(toxicity.held_out().alias("h")).collect()} == {True, False}
