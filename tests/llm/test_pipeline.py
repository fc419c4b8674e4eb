"""The whole pipeline against a plain version on a small folder, and the queries against their SQL."""

from __future__ import annotations

import os
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from cellshift.llm import catalog, quality, secrets
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def _small(folder: str, spark) -> list[tuple]:
    rng = random.Random(11)
    words = "the of and to in that with for on are as it".split() + ["".join(rng.choice("abcdefg") for _ in range(rng.randint(3, 8))) for _ in range(500)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = text(70), text(150)
    rows = [(0, None), (1, ""), (2, text(20)), (3, base), (4, base), (5, base + " tail"), (6, text(80) + " " + passage), (7, passage + " " + text(90)), (8, text(60) + " token=abcdefghijkl99 " + text(9)), (9, "# | " * 90 + text(60)), (10, text(4000))]
    rows += [(i, text(rng.randint(50, 200))) for i in range(11, 25)]
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    return rows


def _kept_by_rules(text: str | None) -> bool:
    n, chars, symbols, dups, _, failed = brute.quality_counts(text)
    if failed:
        return False
    words, lines = brute.WORD.findall(text), [x for x in text.split("\n") if brute.WORD.search(x)]
    share = {
        "mean_word_chars": chars / n, "symbol_ratio": symbols / n, "stop_word_ratio": sum(w.lower() in quality.STOP_WORDS for w in words) / n,
        "dup_line_ratio": dups / len(lines), "ellipsis_line_ratio": sum(x.endswith(("...", "…")) for x in lines) / len(lines), "bullet_line_ratio": sum(x.startswith(("- ", "* ", "•")) for x in lines) / len(lines),
    }
    return all((r.low is None or share[r.metric] >= r.low) and (r.high is None or share[r.metric] <= r.high) for r in quality.THRESHOLDS)


def test_pipeline_matches_plain_version(spark, tmp_path):
    rows = [(d, t) for d, t in _small(str(tmp_path), spark) if _kept_by_rules(t)]
    classes = brute.classes(rows, corpus_pipeline.SHINGLE_WORDS, corpus_pipeline.SIMILARITY_PERCENT)
    rows = [(d, t) for d, t in rows if classes[d][1] == d]
    cut = {d: (left if gone else dict(rows)[d]) for d, _, gone, left in brute.without_repeats(rows)}
    mask = re.compile("|".join(r.pattern for r in secrets.RULES if r.kind == "assign"))
    texts = {d: mask.sub("[REDACTED]", t) for d, t in cut.items()}
    model = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    want = set()
    for doc, text in texts.items():
        ids = [*model.encode(text, add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at : at + 2048], "<u4")
            want.add((doc, piece, at, len(part), zlib.crc32(part.tobytes())))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    ends: dict = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048
    assert {8, 10} <= set(texts) and not {0, 1, 2, 4, 5, 9} & set(texts) and "[REDACTED]" in texts[8]


def test_stages_keep_the_columns_of_documents_and_extra_ones(spark, tmp_path):
    _small(str(tmp_path), spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").selectExpr("*", "1 as row", "2 as kept", "3 as findings", "4 as sequence", "5 as before")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and {(r.row, r.kept, r.findings) for r in out.collect()} == {(1, 2, 3)}
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(catalog.all_oracles()))
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{os.path.join(SF, table)}.parquet'")
    want = con.execute(catalog.all_oracles()[name])
    columns = [c[0] for c in want.description]
    rows = want.fetchall()
    frame = catalog.all_queries()[name](spark, SF)
    assert sorted(frame.columns) == sorted(columns)
    assert sorted(map(str, (tuple(r) for r in frame.select(*columns).collect()))) == sorted(map(str, rows))
