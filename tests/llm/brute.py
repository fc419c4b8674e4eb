"""Plain Python versions of the corpus operators, for comparison on small tables."""

from __future__ import annotations

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def shingles(text: str | None, width: int) -> set[tuple]:
    words = WORD.findall((text or "").translate(UPPER))
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or {tuple(words)}


def classes(docs: list[tuple], width: int, percent: int) -> dict:
    """doc_id to (n_shingles, component_id) by comparing all pairs."""
    sets = {doc: shingles(text, width) for doc, text in docs}
    label = {doc: doc for doc in sets}

    def top(doc):
        while label[doc] != doc:
            doc = label[doc]
        return doc

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                low, high = sorted((top(a), top(b)))
                label[high] = low
    return {doc: (len(sets[doc]), top(doc)) for doc in sets}


def without_repeats(docs: list[tuple], window: int = 13) -> list[tuple]:
    """(doc_id, n_words, n_removed, kept text) of each row, judged on the input."""
    first: dict[tuple, int] = {}
    for doc, text in docs:
        words = WORD.findall(text or "")
        for i in range(len(words) - window + 1 if doc is not None else 0):
            key = tuple(words[i : i + window])
            first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text in docs:
        words = WORD.findall(text or "")
        gone = set()
        for i in range(len(words) - window + 1 if doc is not None else 0):
            if first[tuple(words[i : i + window])] < doc:
                gone |= set(range(i, i + window))
        out.append((doc, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return out


BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 16),
}


def base_spans(text: str | None) -> list[tuple]:
    found = []
    for place, (kind, (pattern, good)) in enumerate(BASE.items()):
        found += [(m.start(), place, m.end(), kind) for m in pattern.finditer(text or "") if good(m)]
    return sorted(found)


def quality_counts(text: str | None) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows: dict[tuple, list[int]] = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed)


def imatch(texts: list[str], low: float, high: float, fractions: tuple[float, ...]) -> dict:
    """doc_id to (fingerprint, likeness to its edited text, likeness to the next text), all terms and hashes spelt out."""
    named = lambda t: t if len(t) <= 48 else "#" + hashlib.blake2b(t.encode(), digest_size=16).hexdigest()
    sets = lambda text: {named(t) for t in re.findall(r"[^\W_]+", text.lower())}
    counts: dict[str, int] = {}
    for text in texts:
        for term in sets(text):
            counts[term] = counts.get(term, 0) + 1
    least, most = max(2, -int(-len(texts) * low // 1)), max(2, int(len(texts) * high))
    band = {t for t, n in counts.items() if least <= n <= most}

    def inside(code: int, k: int) -> bool:
        x = (code ^ (k + 1)) * 0x9E3779B97F4A7C15 % (1 << 64)
        x = (x ^ x >> 29) * 0xBF58476D1CE4E5B9 % (1 << 64)
        return (x >> 11) / (1 << 53) < fractions[k]

    def prints(text: str) -> list[str] | str:
        terms = sets(text)
        found = sorted(terms & band)
        if not found:
            return "=" + hashlib.blake2b("\n".join(sorted(terms)).encode(), digest_size=8).hexdigest()
        codes = [hashlib.blake2b(t.encode(), digest_size=8).digest() for t in found]
        kept = [[c for c in codes if inside(int.from_bytes(c, "little"), k)] for k in range(len(fractions))]
        return [hashlib.blake2b(b"".join(c), digest_size=4).hexdigest() if c else "-" for c in kept]

    def like(a, b) -> float:
        if a == b:
            return 1.0
        if isinstance(a, str) or isinstance(b, str):
            return 0.0
        both = [(x, y) for x, y in zip(a, b, strict=True) if (x, y) != ("-", "-")]
        return sum(x == y for x, y in both) / len(both)

    out = {}
    for i, text in enumerate(texts):
        follow, half = texts[(i + 1) % len(texts)], len(text) // 2
        own, edited = prints(text), prints(text[: len(text) - half] + follow[:half])
        out[i] = (own if isinstance(own, str) else ".".join(own), like(own, edited), like(own, prints(follow)))
    return out
