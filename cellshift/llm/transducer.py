"""Byte-level BPE with a word lexicon held as a minimal acyclic transducer.

Frequent words of the corpus are compiled into an automaton that shares suffixes as well
as prefixes.  Arcs carry numbers; their sum along a word is the word's place in a flat
table of token ids.  The arrays lie in one file that workers memory-map.  Words outside
the lexicon are merged by the vocabulary's ranks, all new words of a batch at once.

A word here is a run of other characters than white space with at most one blank before
it, or a run of white space: pieces of the vocabulary's own pre-tokenisation never reach
across such words, so their ids can be looked up and joined.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import tempfile
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellshift.llm.common import bounded_batches, text_of
from cellshift.llm.tokens import byte_letters
from cellshift.session import written

LEXICON_WORDS = 100_000
LEAST_COUNT = 8
FLUSH_WORDS = 400_000
# Words outside the lexicon whose ids a worker keeps.
CACHE_WORDS = 400_000
LONG_WORD = 48

_WHITE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
# Fixed value: the split pattern of the byte-level vocabulary, white space spelt out.
PIECES = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WHITE}\p{{L}}\p{{N}}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+"
)


# White space other than single blanks and line ends between words.
ODD_WHITE = re.compile(f"[{_WHITE}](?:[{_WHITE}]+|(?<![ \n]))")
# Most words are one run of letters, perhaps with a mark behind it, in blocks of settled categories.
PLAIN = re.compile("( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([.,;:!?]?)")


def chunks_of(text: str) -> tuple[list[str], list[list[str]]]:
    """Words of a text by plain splitting, as (exact, spaced), to be read alternately.

    ``exact[i]`` are words as they stand (or empty), followed by the chunks ``spaced[i]``:
    a chunk that begins with a line end stands for itself, any other for itself behind a
    blank.  Both kinds split into words independently of what is around them.
    """
    exact, spaced, at, head = [], [], 0, ""
    for odd in ODD_WHITE.finditer(text):
        if odd.start() > at or head:
            first, *rest = (head + text[at : odd.start()]).replace("\n", " \n").split(" ")
            exact.append(first)
            spaced.append(rest)
        run, at = odd.group(), odd.end()
        # The last character of a run belongs to what follows: a blank or line end leads it, others stand alone.
        lead = run[-1] if at < len(text) else ""
        head = lead if lead in (" ", "\n") else ""
        for whole in (run[: len(run) - len(lead)], lead if lead != head else ""):
            if whole:
                exact.append(whole)
                spaced.append([])
    if at < len(text) or head:
        first, *rest = (head + text[at:]).replace("\n", " \n").split(" ")
        exact.append(first)
        spaced.append(rest)
    return exact, spaced


def spelled(chunk: str) -> str:
    """What a spaced chunk stands for."""
    return chunk if chunk[:1] == "\n" else " " + chunk


class Merges:
    """Merge ranks of a byte-level vocabulary file, as sorted arrays."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as source:
            data = json.load(source)
        vocabulary = data["model"]["vocab"]
        letters = byte_letters()
        back = {letter: b for b, letter in letters.items()}
        self.of_byte = np.array([vocabulary[letters[b]] for b in range(256)], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
        keys = np.array([vocabulary[a] << 32 | vocabulary[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        bytes_of = [b""] * (max([*vocabulary.values(), *self.special.values()]) + 1)
        for token, at in vocabulary.items():
            bytes_of[at] = bytes(back[letter] for letter in token)
        for token, at in self.special.items():
            bytes_of[at] = token.encode()
        # Bytes of all tokens in one array, with where each begins and its length.
        self.flat = np.frombuffer(b"".join(bytes_of), np.uint8)
        self.lengths = np.array([len(x) for x in bytes_of], np.int32)
        self.begins = (np.cumsum(self.lengths) - self.lengths).astype(np.int32)
        self._rank: dict[int, int] | None = None

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, a large number where it does not merge."""
        key = a << np.int64(32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], np.iinfo(np.int64).max)

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """Token ids of many short words: the best leftmost pair of each merges, round by round.

        A merge changes the ranks of two pairs only; the others move along.
        """
        if not words:
            return []
        lengths = np.array([len(w) for w in words])
        width = int(lengths.max())
        none = np.iinfo(np.int64).max
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
        ids = self.of_byte[raw]
        if width > 1:
            ranks = self.rank(ids[:, :-1], ids[:, 1:])
            ranks[np.arange(width - 1)[None, :] >= (lengths - 1)[:, None]] = none
            ranks = np.concatenate([ranks, np.full((len(words), 1), none)], axis=1)
            live, block = np.arange(len(words)), ids
            columns = np.arange(width)[None, :]
            while True:
                best = ranks.argmin(axis=1)
                row = np.arange(len(best))
                value = ranks[row, best]
                go = value < none
                if not go.all():
                    ids[live[~go]] = block[~go]
                    live, best, value, block, ranks = live[go], best[go], value[go], block[go], ranks[go]
                    row = row[: len(live)]
                if not len(live):
                    break
                # Close the gap behind each merged pair.
                behind = columns > best[:, None]
                block = np.where(behind, np.concatenate([block[:, 1:], np.zeros((len(row), 1), np.int64)], axis=1), block)
                ranks = np.where(behind, np.concatenate([ranks[:, 1:], np.full((len(row), 1), none)], axis=1), ranks)
                block[row, best] = self.made[value]
                lengths[live] -= 1
                # The pair that begins at the new token, and the one that ends there.
                nexts = np.flatnonzero(best + 1 < lengths[live])
                ranks[row, best] = none
                ranks[nexts, best[nexts]] = self.rank(block[nexts, best[nexts]], block[nexts, best[nexts] + 1])
                prior = np.flatnonzero(best > 0)
                ranks[prior, best[prior] - 1] = self.rank(block[prior, best[prior] - 1], block[prior, best[prior]])
        flat = ids[np.arange(width)[None, :] < lengths[:, None]].astype("<i4").tobytes()
        ends = (np.cumsum(lengths) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def merge_one(self, word: bytes) -> bytes:
        """Token ids of one long word by a queue of pairs."""
        if self._rank is None:
            self._rank = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        rank, ids = self._rank, self.of_byte[np.frombuffer(word, np.uint8)].tolist()
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        queue: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j != -1 and (r := rank.get(ids[i] << 32 | ids[j])) is not None:
                heapq.heappush(queue, (r, i, ids[i], ids[j]))

        for i in range(len(ids)):
            offer(i)
        while queue:
            r, i, a, b = heapq.heappop(queue)
            j = after[i]
            if ids[i] != a or j == -1 or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.made[r]), -1
            after[i] = after[j]
            if after[j] != -1:
                before[after[j]] = i
            offer(i)
            if before[i] != -1:
                offer(before[i])
        return np.array([t for t in ids if t != -1], "<i4").tobytes()

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Token ids of words as little-endian 32-bit integers, each split into the vocabulary's pieces first."""
        plain = PLAIN.fullmatch
        pieces = [m.groups() if (m := plain(word)) else [p for w in WORDS.findall(word) for p in PIECES.findall(w)] for word in words]
        listed = list(set(chain.from_iterable(pieces)))
        known = dict(zip(listed, self._by_length([p.encode() for p in listed]), strict=True))
        return [known[row[0]] + known[row[1]] if len(row) == 2 else b"".join([known[p] for p in row]) for row in pieces]

    def _by_length(self, words: list[bytes]) -> list[bytes]:
        """Merge words in groups of similar length, so padding stays small; long ones one by one."""
        out: list[bytes] = [b""] * len(words)
        groups: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            if len(word) > LONG_WORD:
                out[i] = self.merge_one(word)
            elif word:
                groups.setdefault(-(-len(word) // 3), []).append(i)
        for members in groups.values():
            for first in range(0, len(members), 20_000):
                part = members[first : first + 20_000]
                for i, ids in zip(part, self.merge_all([words[i] for i in part]), strict=True):
                    out[i] = ids
        return out

    def text_of(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Texts of ids, text i having those from offsets[i] to offsets[i + 1].

        Bytes that are no UTF-8 become replacement characters.
        """
        lengths = self.lengths[ids]
        ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        raw = self.flat[np.repeat(self.begins[ids] - ends[:-1], lengths) + np.arange(ends[-1])]
        cuts = ends[offsets]
        starts = cuts[:-1][np.diff(cuts) > 0]
        whole = raw.tobytes()
        try:
            whole.decode()
            fine = ends[-1] < 1 << 31 and not ((raw[starts] & 0xC0) == 0x80).any()
        except UnicodeDecodeError:
            fine = False
        if fine:
            return pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int32).tobytes()), pa.py_buffer(whole))
        return pa.array([whole[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.string())


def compile_lexicon(words: list[bytes], ids: list[bytes]) -> bytes:
    """Minimal acyclic transducer of sorted distinct words, with their ids, as one blob.

    Words are added in order; states that can no longer change are replaced by equal
    ones already registered.  Arc numbers count the words that come before in order.
    """
    arcs: list[dict[int, int]] = [{}]
    final = [False]
    register: dict[tuple, int] = {}
    path: list[tuple[int, int, int]] = []  # parent, label, child: not registered yet

    def settle(depth: int) -> None:
        while len(path) > depth:
            parent, label, child = path.pop()
            key = (final[child], *arcs[child].items())
            arcs[parent][label] = register.setdefault(key, child)

    previous = b""
    for word in words:
        shared = os.path.commonprefix([previous, word])
        settle(len(shared))
        state = path[-1][2] if path else 0
        for label in word[len(shared) :]:
            arcs.append({})
            final.append(False)
            arcs[state][label] = len(arcs) - 1
            path.append((state, label, len(arcs) - 1))
            state = len(arcs) - 1
        final[state] = True
        previous = word
    settle(0)

    count: dict[int, int] = {}
    order = [0]
    for state in order:  # every reachable state once, parents may come again later
        if state not in count:
            count[state] = -1
            order += arcs[state].values()
    stack = [0]
    while stack:
        state = stack[-1]
        open_ = [t for t in arcs[state].values() if count[t] < 0]
        if open_:
            stack += open_
            continue
        count[state] = int(final[state]) + sum(count[t] for t in arcs[state].values())
        stack.pop()
    number = {state: i for i, state in enumerate(count)}
    rows = []
    for state in count:
        passed = int(final[state])
        for label in sorted(arcs[state]):
            target = arcs[state][label]
            rows.append((number[state] << 8 | label, number[target], passed))
            passed += count[target]
    rows.sort()
    columns = list(zip(*rows, strict=True)) if rows else [(), (), ()]
    arrays = {
        "keys": np.array(columns[0], np.int64),
        "targets": np.array(columns[1], np.int32),
        "numbers": np.array(columns[2], np.int32),
        "final": np.array([final[s] for s in count], np.uint8),
        "offsets": np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int64),
        "ids": np.frombuffer(b"".join(ids), "<i4"),
    }
    head, at = {}, 0
    for name, array in arrays.items():
        head[name] = (str(array.dtype), at, len(array))
        at += -(-array.nbytes // 8) * 8
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 8)
    return len(text).to_bytes(8, "little") + text + b"".join(a.tobytes().ljust(-(-a.nbytes // 8) * 8, b"\0") for a in arrays.values())


class Lexicon:
    """A compiled lexicon, memory-mapped from a file of the worker's own that has no name any more."""

    def __init__(self, blob: bytes) -> None:
        size = int.from_bytes(blob[:8], "little")
        head = json.loads(blob[8 : 8 + size])
        handle, path = tempfile.mkstemp()
        with os.fdopen(handle, "wb") as out:
            out.write(blob)
        whole = np.asarray(np.memmap(path, np.uint8, "r"))
        os.unlink(path)
        base = 8 + size
        arrays = {n: whole[base + at : base + at + np.dtype(k).itemsize * c].view(k) for n, (k, at, c) in head.items()}
        self.keys, self.targets, self.numbers = arrays["keys"], arrays["targets"], arrays["numbers"]
        self.final, self.offsets, self.ids = arrays["final"], arrays["offsets"], arrays["ids"]

    def find(self, words: list[bytes]) -> np.ndarray:
        """Number of each word, -1 where it is not in the lexicon; all words walk at once."""
        out = np.full(len(words), -1, np.int64)
        if not len(self.keys) or not words:
            return out
        lengths = np.array([len(w) for w in words])
        joined = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(lengths) - lengths
        live = np.flatnonzero(lengths > 0)
        state, total = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        depth = 0
        while len(live):
            key = state[live] << np.int64(8) | joined[starts[live] + depth]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            going = self.keys[at] == key
            live, at = live[going], at[going]
            state[live] = self.targets[at]
            total[live] += self.numbers[at]
            depth += 1
            ended = live[lengths[live] == depth]
            done = ended[self.final[state[ended]] == 1]
            out[done] = total[done]
            live = live[lengths[live] > depth]
        return out

    def ids_of(self, numbers: np.ndarray) -> list[bytes]:
        """Ids of each numbered word, as bytes."""
        return [self.ids[a:b].tobytes() for a, b in zip(self.offsets[numbers].tolist(), self.offsets[numbers + 1].tolist(), strict=True)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial word counts, flushed before the table grows large."""
    exact: Counter = Counter()
    spaced: Counter = Counter()

    def table() -> pa.RecordBatch:
        # A chunk is one word, or a line end and perhaps a word without a blank.
        counts = {" " + c: n for c, n in spaced.items() if c[:1] != "\n" and len(c) < LONG_WORD}
        for word, n in chain(exact.items(), ((w, n) for c, n in spaced.items() if c[:1] == "\n" for w in ("\n", c[1:]))):
            if word and len(word) <= LONG_WORD:
                counts[word] = counts.get(word, 0) + n
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
            alone, later = chunks_of(text)
            exact.update(alone)
            for chunks in later:
                spaced.update(chunks)
            if len(exact) + len(spaced) > FLUSH_WORDS:
                yield table()
                exact.clear(), spaced.clear()
    yield table()


def frequent_words(docs: DataFrame, most: int = LEXICON_WORDS, least: int = LEAST_COUNT) -> list[str]:
    """The most frequent words of (text), counted over all rows; at most ``most``.

    The count that a word needs is read from the histogram of counts, so no more than
    ``most`` words ever leave the executors.
    """
    bounded_batches(docs.sparkSession)
    counts = docs.select(text_of().alias("text")).mapInArrow(_count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    stored = written(counts.filter(F.col("n") >= least), "word-counts")
    # Counts above the cap share one bar; they are frequent in any case.
    bars = stored.groupBy(F.least("n", F.lit(1_000_000)).alias("n")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).collect()
    need, total = None, 0
    for bar in bars:
        total += bar["words"]
        if total > most:
            break
        need = bar["n"]
    if need is None:
        return []
    return stored.filter(F.col("n") >= need).select("word").toArrow()["word"].to_pylist()


def lexicon_blob(words: list[str], tokenizer: str) -> bytes:
    """Compile words with their ids under a vocabulary file."""
    merges = Merges(tokenizer)
    words = sorted({w for w in words if not any(s in w for s in merges.special)}, key=str.encode)
    return compile_lexicon([w.encode() for w in words], merges.encode_words(words))


_MERGES: dict[str, Merges] = {}


def merges_of(tokenizer: str) -> Merges:
    """The merges of a vocabulary file, read once per worker."""
    if tokenizer not in _MERGES:
        _MERGES[tokenizer] = Merges(tokenizer)
    return _MERGES[tokenizer]


class Encoder:
    """Texts to ids: known words in front of the lexicon, exact merging behind it."""

    def __init__(self, tokenizer: str, blob: bytes) -> None:
        self.merges, self.lexicon = merges_of(tokenizer), Lexicon(blob)
        # Ids of spaced chunks and of exact words; those of lexicon words stay when the others are dropped.
        self.spaced: dict[str, bytes] = {}
        self.exact: dict[str, bytes] = {"": b""}
        self.kept: dict[str, bytes] = {}
        special = self.merges.special
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def _learn(self, chunks: list[str], words: list[str]) -> None:
        """Ids of new spaced chunks and new exact words."""
        listed = [*map(spelled, chunks), *words]
        numbers = self.lexicon.find([w.encode() for w in listed])
        held = np.flatnonzero(numbers >= 0)
        ids: list[bytes] = [b""] * len(listed)
        for i, found in zip(held.tolist(), self.lexicon.ids_of(numbers[held]), strict=True):
            ids[i] = found
            if i < len(chunks):
                self.kept[chunks[i]] = found
        rest = np.flatnonzero(numbers < 0).tolist()
        for i, made in zip(rest, self.merges.encode_words([listed[i] for i in rest]), strict=True):
            ids[i] = made
        self.spaced.update(zip(chunks, ids, strict=False))
        self.exact.update(zip(words, ids[len(chunks) :], strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        if len(self.spaced) > CACHE_WORDS:
            self.spaced = self.kept.copy()
        if len(self.exact) > CACHE_WORDS:
            self.exact = {"": b""}
        special = self.merges.special
        cut = []
        for text in texts:
            parts = self.split.split(text) if special and any(s in text for s in special) else [text]
            cut.append([special[part] if part in special else chunks_of(part) for part in parts])
        usual = [p for row in cut for p in row if not isinstance(p, int)]
        chunks = set().union(*[c for _, later in usual for c in later]).difference(self.spaced)
        words = set().union(*[alone for alone, _ in usual]).difference(self.exact)
        self._learn(list(chunks), list(words))
        spaced, exact = self.spaced.__getitem__, self.exact
        out = []
        for row in cut:
            ids: list[bytes] = []
            for part in row:
                if isinstance(part, int):
                    ids.append(part.to_bytes(4, "little"))
                    continue
                for alone, later in zip(*part, strict=True):
                    ids.append(exact[alone])
                    ids += map(spaced, later)
            out.append(b"".join(ids))
        return out


_ENCODERS: dict[tuple[str, int], Encoder] = {}
# Texts that are encoded at a time.
SLICE = 1000


def _encoder(tokenizer: str, shared, with_text: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (tokenizer, id(shared))
        if key not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[key] = Encoder(tokenizer, shared.value)
        encoder = _ENCODERS[key]
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE):
                part = batch.slice(first, SLICE)
                found = encoder.encode(part.column(part.schema.get_field_index("text")).to_pylist())
                offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])]).astype(np.int32)
                ids = np.frombuffer(b"".join(found), np.int32)
                columns = {"doc_id": part.column(part.schema.get_field_index("doc_id")), "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))}
                if with_text:
                    columns["text"] = encoder.merges.text_of(ids, offsets)
                yield pa.RecordBatch.from_arrays([*columns.values()], [*columns])

    return encode


def encode(docs: DataFrame, tokenizer: str, blob: bytes, with_text: bool = False) -> DataFrame:
    """(doc_id, ids) of every row of (doc_id, text); null texts are empty and have no ids.

    Strings of special tokens in a text become their ids, as the vocabulary's library does.
    Repeated rows are encoded one by one.  ``with_text`` adds the text decoded from the ids
    in the same pass.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(blob)
    fields = f"doc_id {kind}, ids array<int>" + (", text string" if with_text else "")
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(_encoder(tokenizer, shared, with_text), fields)


def _decoder(tokenizer: str):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = merges_of(tokenizer)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("ids"))
            offsets = column.offsets.to_numpy()
            texts = merges.text_of(column.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0])
            names = ["doc_id", "ids"]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(n)) for n in names], texts], [*names, "text"])

    return decode


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids, text) of every row of (doc_id, ids); special tokens keep their strings.

    Bytes that are no UTF-8 become replacement characters.
    """
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(_decoder(tokenizer), f"doc_id {kind}, ids array<int>, text string")


def encode_corpus(docs: DataFrame, tokenizer: str, most: int = LEXICON_WORDS, with_text: bool = False) -> DataFrame:
    """Encode with a lexicon of the corpus' own frequent words."""
    return encode(docs, tokenizer, lexicon_blob(frequent_words(docs, most), tokenizer), with_text)
