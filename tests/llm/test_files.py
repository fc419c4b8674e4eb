"""Archives, token files, packing, URLs, fingerprints and BPE against plain versions and on odd tables."""

from __future__ import annotations

import gzip
import hashlib
import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cellshift.llm import binary, imatch, packing, transducer, urls, warc
from cellshift.llm.tokens import WordIds
from tests.llm import brute

WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None, "", "  ", "I'll don't STOP'S", "x\xa0y  z", "a\x1cb \x1d", "<|endoftext|>a b<|startoftext|>c", "İstanbul ΣΑΣ ß", "🙂👍 x", "1234 a1b2", "\n\n a",
    "é̀ ́x", "a" * 3000, " ab" * 3000, "日本語 テスト　x", "...\t\t\n x  ", "a\u200bb\ufeff \u180e c", "\r\n\r\n y", "ª º µ × ÷", "ab\x85cd\x85 \x85", "é ü ñ ÀÉ",
]


def make(spark, texts, first=0):
    rows = [(first + i, t, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, ids string")


@pytest.fixture(scope="module")
def word_model():
    return Tokenizer.from_file(WORD_BPE)


@pytest.fixture(scope="module")
def byte_model():
    return Tokenizer.from_file(BYTE_BPE)


def test_word_ids_equal_the_library(word_model):
    cache = WordIds(WORD_BPE, 2, limit=5)
    for _ in range(2):
        for text in ODD[1:]:
            assert np.frombuffer(cache.of(text), "<u2").tolist() == word_model.encode(text, add_special_tokens=False).ids


def test_token_files_round_trip(spark, word_model, tmp_path):
    docs = make(spark, ODD).union(spark.createDataFrame([(None, "no id", "x"), (3, "again", "x")], "doc_id bigint, text string, ids string"))
    folder = str(tmp_path / "store")
    binary.write_store(docs, folder, WORD_BPE, docs_per_part=4)
    got = sorted(binary.read_store(spark, folder).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in got]
    assert ids == [None, 0, 1, 2, 3, 3, *range(4, len(ODD))]
    want = {r.doc_id: set() for r in got}
    for doc, text in [*enumerate(ODD), (None, "no id"), (3, "again")]:
        want[doc].add(tuple([*word_model.encode(text or "", add_special_tokens=False).ids, 1]))
    at = 0
    for r in got:
        found = tuple(np.frombuffer(r.ids, "<u4").tolist())
        assert found in want[r.doc_id] and r.start == at and r.n_tokens == len(found) and r.ids_crc32 == zlib.crc32(r.ids)
        at += r.n_tokens
    assert binary.round_trip(make(spark, []), WORD_BPE).count() == 0


def test_pieces_are_whole_and_sequences_gapless(spark, word_model):
    docs = make(spark, ODD).union(make(spark, ODD[3:5], 3))
    pieces = packing.token_pieces(docs, WORD_BPE, capacity=256)
    placed = packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")), 256, shard_pieces=10).cache()
    by_doc: dict = {}
    for r in placed.collect():
        by_doc.setdefault(r.doc_id, []).append(r)
        assert r.length == len(r.ids) // 4 <= 256
    for doc, text in enumerate(ODD):
        whole = [*word_model.encode(text or "", add_special_tokens=False).ids, 0]
        rows = sorted(by_doc[doc], key=lambda r: r.start)
        if doc not in (3, 4):
            assert [t for r in rows for t in np.frombuffer(r.ids, "<u4")] == whole
            assert [r.length for r in rows[:-1]] == [256] * (len(rows) - 1)
    for r in packing.sequences(placed).collect():
        assert r.length * 4 == len(r.ids) and r.length <= 256
    ends: dict = {}
    for r in sorted(placed.collect(), key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert packing.pack_documents(make(spark, []), WORD_BPE).count() == 0


def test_sum_of_squares_rule_step_by_step():
    """The chosen gap is the one that makes the sum of squared counts smallest."""
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 21, 300)
    sequence, offset = packing.place_pieces(lengths, 20)
    used: dict[int, int] = {}
    for i in np.argsort(-lengths, kind="stable"):
        counts = np.bincount([20 - u for u in used.values() if u < 20], minlength=21)
        fits = [b for b, u in used.items() if 20 - u >= lengths[i]]

        def cost(b, i=i, counts=counts):
            after = counts.copy()
            after[20 - used[b]] -= 1
            after[20 - used[b] - lengths[i]] += 1
            return int((after[1:] ** 2).sum())

        if sequence[i] in used:
            assert offset[i] == used[sequence[i]] and cost(sequence[i]) == min(map(cost, fits))
        else:
            assert not fits and offset[i] == 0
        used[sequence[i]] = used.get(sequence[i], 0) + int(lengths[i])
    assert len(used) <= np.ceil(lengths.sum() / 20) + 1


def test_archives_round_trip(spark):
    same = "<p>" + "same " * 40 + "</p>"
    rows = [(3, "http://a.b/c d", same), (1, "http://a.b/\n", same), (2, None, same), (4, "u", None), (5, "u", "short"), (6, "u", "short"), (7, "é://x", "é" * 60), (None, "n", same), (1, "http://a.b/2", same), (8, "u", "x\r\n\r\ny" * 9)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "key bigint, url string, payload string, record_type string")
    got = warc.archive_round_trip(spark, pages).collect()
    found = sorted(((r.key, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str)
    want = []
    for key, _, payload in rows:
        raw = (payload or "").encode()
        again = payload == same and key != 1
        want.append((key, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", 1 if again else None))
    assert found == sorted(want, key=str)
    assert warc.archive_round_trip(spark, pages.limit(0)).count() == 0


def test_pages_named_like_a_version_block_stay(spark):
    rows = [(i, url, f"text {i}") for i, url in enumerate(["filedesc://x.arc", "filedesc:", "http://a.b/"])]
    pages = spark.createDataFrame(rows, "key bigint, url string, payload string")
    got = sorted((r.key, r.payload_bytes, r.record_type) for r in warc.archive_round_trip(spark, pages).collect())
    assert got == [(i, 6, "response") for i in range(3)]


def test_both_arc_versions_are_parsed():
    v2 = b"filedesc://x 0.0.0.0 20010203040506 text/plain 200 - - 0 x 10\n2 0 org\nU\n" + b"http://h/ 1.2.3.4 20010203 text/html 404 abc - 99 f 5\nhello\n\n"
    records = list(warc.arc_records(io.BytesIO(v2)))
    assert records[1]["Result-code"] == "404" and records[1]["block"] == b"hello"
    made = warc.as_warc("f", records[1])
    (headers, block), = warc.warc_records(io.BytesIO(made))
    assert headers["warc-type"] == "resource" and headers["warc-date"] == "2001-02-03T00:00:00Z" and block == b"hello"
    v1 = b"filedesc://x 0.0.0.0 20010203040506 text/plain 10\n1 0 org\nU\nhttp://h/a b 1.2.3.4 20010203040506 text/html 3\nabc\n"
    assert list(warc.arc_records(io.BytesIO(v1)))[1]["URL"] == "http://h/a b"
    with pytest.raises(ValueError):
        list(warc.arc_records(io.BytesIO(v1[:-3])))
    assert gzip.decompress(gzip.compress(v1)) == v1


def test_url_parts_rules_and_verdicts(spark):
    cases = {
        None: ("", "", None), "": ("", "", None), "no scheme/x": ("", "", None), "http://A.Net": ("a.net", "", None), "http://x.NET/": ("x.net", "/", "net/"),
        "https://www.example.net/en/1?q#f": ("www.example.net", "/en/1", "example.net/en/"), "http://notexample.com/de/": ("notexample.com", "/de/", None),
        "http://example.com/de/": ("example.com", "/de/", "example.com/de/"), "http://o.org/fr/?x": ("o.org", "/fr/", "org/fr/"), "a://b://c/d": ("b:", "//c/d", None),
        "http://casino-x.example.org#z": ("casino-x.example.org", "", None), "http://é.org/\n/x": ("é.org", "/\n/x", None),
    }
    rows = [(i, u, "h") for i, u in enumerate(cases)] * 2
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string")
    labelled = spark.createDataFrame([(f"http://{w}-{i}.example.org/x{i}", 1.0) for w in ("casino", "bets") for i in range(40)] + [(f"http://good{i}.example.net/en/{i}", 0.0) for i in range(80)] + [(None, None)], "url string, label double")
    for r in urls.judge(pages, labelled).collect():
        host, path, rule = cases[r.url]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        if rule:
            assert r.verdict == {x.name: x.verdict for x in urls.RULES}[rule]
    held = spark.createDataFrame([(f"http://pills-{i}.example.com/y", 1) for i in range(30)] + [(f"http://fine{i}.example.com/en/{i}", 0) for i in range(30)], "url string, bad int")
    judged = urls.judge(held, labelled, rules=[]).collect()
    assert sum((r.verdict == "block") == bool(r.bad) for r in judged) >= 54
    none = urls.judge(pages.limit(0), labelled.limit(0))
    assert none.count() == 0
    assert {r.verdict for r in urls.judge(pages, labelled.limit(0), rules=[]).collect()} == {"allow"}


def test_suffixes_count_all_labelled_urls(spark):
    rows = [(f"http://h{i}.common.net/{i}", float(i % 2)) for i in range(2000)] + [(f"http://casino{i}.rare.org/", 1.0) for i in range(60)] + [("http://hot.example.com/x", 0.0)] * 1000
    labelled = spark.createDataFrame(rows, "url string, label double")
    model, suffixes = urls.train(labelled, 300)
    assert {tuple(r) for r in suffixes.collect()} == {("common.net", 2000, 1000.0), ("rare.org", 60, 60.0), ("example.com", 1000, 0.0)}
    counted = labelled.groupBy("url", "label").agg(F.count(F.lit(1)).alias("n"))
    taken = {r.url: r.taken for r in urls.fit_rows(counted, 300).collect()}
    assert abs(sum(taken.values()) - 300) < 60 and taken["http://hot.example.com/x"] in (98, 99)
    assert sum(r.taken for r in urls.fit_rows(counted, 5000).collect()) == len(rows)
    pages = labelled.select("url")
    want = urls.judge(pages, labelled, train_rows=300).collect()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(urls.judge(pages, labelled, train_rows=300).collect(), key=str) == sorted(want, key=str)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_fingerprints_of_edited_texts(spark, monkeypatch):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    texts = [None, "", "!!", "a", *[" ".join(rng.choice(words) for _ in range(rng.randint(1, 200))) for _ in range(30)], "日本 ü" * 50]
    texts += [texts[5], texts[5]]
    monkeypatch.setattr(imatch, "DOCS_PER_BLOCK", 7)
    docs = make(spark, texts)
    lexicon = imatch.lexicon_of(docs)
    got = {r.doc_id: r for r in imatch.compare_with_edits(docs).collect()}
    printer = imatch.Fingerprinter(lexicon)
    plain = [t or "" for t in texts]
    for i, text in enumerate(plain):
        follow, r = plain[(i + 1) % len(plain)], got[i]
        half = len(text) // 2
        edited = text[: len(text) - half] + follow[:half]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (printer.of(text), printer.of(edited))
        assert r.near_edited == imatch.likeness(printer.of(text), printer.of(edited)) and r.near_next == imatch.likeness(printer.of(text), printer.of(follow))
    assert {r.doc_id: r.fingerprint for r in imatch.fingerprints(docs, lexicon).collect()} == {i: printer.of(t) for i, t in enumerate(plain)}
    assert imatch.compare_with_edits(make(spark, [])).count() == 0
    (one,) = imatch.compare_with_edits(make(spark, ["ab cd"])).collect()
    assert one.edited_sha256 == hashlib.sha256(b"ab ab").hexdigest()
    odd = spark.createDataFrame([(None, "x y"), (None, "x y"), (1, "z"), (1, "z")], "doc_id bigint, text string")
    assert imatch.compare_with_edits(odd).count() == 4


def test_band_counts_all_documents(spark):
    docs = make(spark, ["common rare" if i == 0 else f"common mid{i % 2} mid{i % 2}" for i in range(20)])
    assert imatch.lexicon_of(docs, 0.1, 0.6) == ["mid0", "mid1"]
    with pytest.raises(ValueError, match="may be broadcast"):
        imatch.lexicon_of(docs, 0.1, 1.0, most=1)


def test_fingerprints_equal_a_plain_version(spark):
    """Lexicon, sub-lexicons and likeness from a separate walk over all documents, long terms and long texts included."""
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcde") for _ in range(rng.randint(2, 5))) for _ in range(150)] + ["x" * 60, "y" * 4000]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 30, 200]))) for _ in range(60)] + [None, "z" * 90, "q " * 30_000]
    docs = spark.createDataFrame([(i, t, "clash", 0) for i, t in enumerate(texts)], "doc_id bigint, text string, fingerprint string, block int")
    got = {r.doc_id: r for r in imatch.compare_with_edits(docs).collect()}
    want = brute.imatch([t or "" for t in texts], imatch.LOW_SHARE, imatch.HIGH_SHARE, imatch.FRACTIONS)
    assert {d: (r.fingerprint, r.near_edited, r.near_next) for d, r in got.items()} == want


def test_bpe_equals_the_library(spark, byte_model):
    docs = make(spark, ODD)
    got = {r.doc_id: r for r in transducer.decode(transducer.encode_corpus(docs, BYTE_BPE), BYTE_BPE).collect()}
    for doc, text in enumerate(ODD):
        ids = byte_model.encode(text or "", add_special_tokens=False).ids
        assert got[doc].ids == ids and got[doc].text == byte_model.decode(ids, skip_special_tokens=False)
    assert transducer.encode_corpus(make(spark, []), BYTE_BPE).count() == 0


def test_transducer_holds_its_words_and_no_others():
    words = sorted({w.encode() for w in ["tap", "taps", "top", "tops", "stop", "stops", "é", "日本", "日"]})
    ids = [np.array([i, i + 1], "<i4").tobytes() for i in range(len(words))]
    lexicon = transducer.Lexicon(transducer.compile_lexicon(words, ids))
    numbers = lexicon.find([*words, b"ta", b"tapsx", b"", b"x"])
    assert numbers.tolist() == [*range(len(words)), -1, -1, -1, -1]
    assert lexicon.ids_of(np.arange(3)) == ids[:3]
    assert len(lexicon.final) < len({w[:k] for w in words for k in range(len(w) + 1)})
    none = transducer.Lexicon(transducer.compile_lexicon([], []))
    assert none.find([b"a"]).tolist() == [-1]


def test_long_words_merge_like_short_ones(byte_model):
    merges = transducer.Merges(BYTE_BPE)
    rng = random.Random(1)
    words = ["".join(rng.choice("etaoin shrdlu".replace(" ", "")) for _ in range(rng.randint(1, 30))) for _ in range(200)]
    want = [byte_model.encode(w, add_special_tokens=False).ids for w in words]
    listed = lambda ids: [np.frombuffer(x, "<i4").tolist() for x in ids]
    assert listed(merges.merge_all([w.encode() for w in words])) == want
    assert listed(merges.merge_one(w.encode()) for w in words) == want


def test_chunks_are_the_words_of_a_text():
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice("ab \n\t\u3000,.") for _ in range(rng.randint(0, 12)))
        words = []
        for alone, later in zip(*transducer.chunks_of(text), strict=True):
            for chunk in [alone, *map(transducer.spelled, later)]:
                words += transducer.WORDS.findall(chunk)
        assert words == transducer.WORDS.findall(text), repr(text)


def test_invalid_bytes_become_replacement_characters(spark, byte_model):
    encoded = spark.createDataFrame([(1, [160, 50256, 64])], "doc_id bigint, ids array<int>")
    (row,) = transducer.decode(encoded, BYTE_BPE).collect()
    assert row.text == byte_model.decode([160, 50256, 64], skip_special_tokens=False)
