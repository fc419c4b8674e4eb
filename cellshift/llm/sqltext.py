"""DuckDB SQL of the corpus queries, where SQL can express them."""

from __future__ import annotations

from cellshift.llm import quality, secrets


def _quality() -> str:
    stop = ", ".join("'" + word + "'" for word in quality.STOP_WORDS)
    checks = " AND ".join(
        f"{rule.metric} {sign} {float(bound)!r}" for rule in quality.THRESHOLDS for sign, bound in ((">=", rule.low), ("<=", rule.high)) if bound is not None
    )
    share = lambda part, whole: f"CASE WHEN {whole} > 0 THEN {part}::DOUBLE / {whole} ELSE 0.0 END"
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), win AS (
  SELECT doc_id, unnest(range(1, len(words) - 1)) AS pos, words FROM w WHERE len(words) >= 3
), named AS (
  SELECT doc_id, pos, words[pos] || chr(32) || words[pos + 1] || chr(32) || words[pos + 2] AS win FROM win
), twice AS (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, win) AS n FROM named) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT pos + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
         len(lines) AS n_lines,
         len(list_filter(words, lambda x: lower(x) IN ({stop}))) AS n_stop_words,
         len(list_filter(lines, lambda x: ends_with(x, '...') OR ends_with(x, '…'))) AS n_ellipsis_lines,
         len(list_filter(lines, lambda x: starts_with(x, '- ') OR starts_with(x, '* ') OR starts_with(x, '•'))) AS n_bullet_lines
  FROM w LEFT JOIN covered USING (doc_id)
), r AS (
  SELECT *, {share("word_chars", "n_words")} AS mean_word_chars, {share("n_symbols", "n_words")} AS symbol_ratio,
         {share("n_stop_words", "n_words")} AS stop_word_ratio, {share("n_dup_lines", "n_lines")} AS dup_line_ratio,
         {share("n_ellipsis_lines", "n_lines")} AS ellipsis_line_ratio, {share("n_bullet_lines", "n_lines")} AS bullet_line_ratio,
         n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed) AND {checks} AS kept
FROM r
"""


def _secrets() -> str:
    def one(place: int, rule: secrets.Rule) -> str:
        pattern = rule.pattern.replace("'", "''")
        return f"""
SELECT doc_id, '{rule.kind}' AS kind, {place} AS place, {rule.base} AS base, {rule.group} AS grp, {rule.least} AS least, '{pattern}' AS pattern,
       regexp_extract_all(t, '{pattern}') AS found, regexp_extract_all(t, '{pattern}', {rule.group}) AS part, string_split_regex(t, '{pattern}') AS pieces
FROM d"""

    kinds = "\nUNION ALL".join(one(i, rule) for i, rule in enumerate(secrets.RULES))
    count = lambda kind: f"count(*) FILTER (WHERE kind = '{kind}')::BIGINT AS n_{kind}"
    base = [rule.kind for rule in secrets.RULES if rule.base]
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), k AS ({kinds}
), e AS (
  SELECT doc_id, kind, place, base, least, unnest(range(1, len(found) + 1)) AS i, found, part, pieces FROM k WHERE len(found) > 0
), l AS (
  SELECT doc_id, kind, place, base, i, length(pieces[i]) AS gap, length(found[i]) AS n, length(part[i]) >= least AS stays FROM e
), p AS (
  SELECT *, sum(gap + n) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop FROM l
), s AS (
  SELECT doc_id, kind, place, base, (stop - n)::BIGINT AS start, kind || ':' || (stop - n)::BIGINT || ':' || stop::BIGINT AS name FROM p WHERE stays
), g AS (
  SELECT doc_id, {", ".join(count(kind) for kind in base)},
         string_agg(name, ',' ORDER BY start, place) FILTER (WHERE base) AS base_names,
         string_agg(name, ',' ORDER BY start, place) AS names
  FROM s GROUP BY doc_id
)
SELECT d.doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in base)},
       sha256(coalesce(base_names, '')) AS base_sha256, coalesce(names, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""


def _near(width: int, percent: int) -> str:
    window = " || ' ' || ".join(f"words[i + {k}]" for k in range(width))
    return rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, {window} AS sh FROM (SELECT doc_id, words, unnest(range(1, len(words) - {width} + 2)) AS i FROM w WHERE len(words) >= {width})
  UNION ALL
  SELECT doc_id, array_to_string(words, ' ') AS sh FROM w WHERE len(words) BETWEEN 1 AND {width - 1}
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), met AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM met JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared >= {percent} * (p.n + q.n - shared)
), either AS (
  SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT reach.a, either.b FROM reach JOIN either ON reach.b = either.a
), least_of AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents JOIN least_of USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def _repeats(window: int) -> str:
    return rf"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(words[i : i + {window - 1}], ' ') AS seq
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - {window} + 2)) AS i FROM w WHERE len(words) >= {window})
), first AS (
  SELECT seq, min(doc_id) AS origin FROM win GROUP BY seq
), gone AS (
  SELECT DISTINCT doc_id, i + k AS at_word FROM win JOIN first USING (seq), (SELECT unnest(range(0, {window})) AS k) WHERE origin < doc_id
), lost AS (
  SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id
), each_word AS (
  SELECT doc_id, unnest(range(1, len(words) + 1)) AS at_word, unnest(words) AS word FROM w
), left_over AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY at_word) AS text FROM each_word ANTI JOIN gone USING (doc_id, at_word) GROUP BY doc_id
)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(lost.n, 0)::BIGINT AS n_removed, sha256(coalesce(left_over.text, '')) AS kept_sha256
FROM w LEFT JOIN lost USING (doc_id) LEFT JOIN left_over USING (doc_id)
"""


ARCHIVES = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS origin FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN origin IS NULL OR origin = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN origin <> page_id THEN origin END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
NEAR = _near(2, 80)
REPEATS = _repeats(13)
QUALITY = _quality()
SECRETS = _secrets()


def crc32_of(text: str) -> str:
    """DuckDB expression of the CRC-32 of a text's UTF-8 bytes, one table entry per bit."""
    entries = []
    for bit in range(8):
        value = 1 << bit
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        entries.append(value)
    step = "(c >> 8)"
    for bit, value in enumerate(entries):
        step = f"xor({step}, ((xor(c, b) >> {bit}) & 1) * {value})"
    digits = f"hex(encode({text}))"
    listed = f"list_transform(range(length({digits}) // 2), lambda i: ('0x' || substr({digits}, 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce({listed}, lambda c, b: {step}, 4294967295::BIGINT), 4294967295::BIGINT)"


_WORDS_OF = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

RESAMPLED = rf"""
WITH rows AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS_OF} AS w FROM documents
  UNION ALL SELECT NULL, NULL, {_WORDS_OF} FROM benchmark
), runs AS MATERIALIZED (
  SELECT r, unnest(list_concat(w,
    list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f
  FROM rows
), per_row AS MATERIALIZED (
  SELECT r, f, count(*) AS n FROM runs GROUP BY r, f
), bucketed AS MATERIALIZED (
  SELECT f, {crc32_of("f")} % 10000 AS bucket FROM (SELECT DISTINCT f FROM per_row)
), counted AS (
  SELECT bucket, coalesce(sum(n) FILTER (r IS NOT NULL), 0) AS s, coalesce(sum(n) FILTER (r IS NULL), 0) AS t
  FROM per_row JOIN bucketed USING (f) GROUP BY bucket
), totals AS (
  SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM counted
), gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1) * (s_all + 10000))::DOUBLE / ((s + 1) * (t_all + 10000))::DOUBLE))::BIGINT AS gain FROM counted, totals
), weights AS (
  SELECT r, sum(n) AS n_features, sum(n * gain) AS weight
  FROM per_row JOIN bucketed USING (f) JOIN gains USING (bucket) WHERE r IS NOT NULL GROUP BY r
), scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM rows LEFT JOIN weights USING (r) WHERE rows.r IS NOT NULL
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place,
         count(*) FILTER (n_words >= 20) OVER () AS n
  FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * n // 100 THEN place END::BIGINT AS rank FROM placed
"""


SPELLINGS = rf"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run
  FROM documents
), per_doc AS (
  SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS named, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL
), digests AS MATERIALIZED (
  SELECT run, n, {crc32_of("named")} AS h FROM per_doc
), noted AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM digests
), words AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM noted WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), cut AS MATERIALIZED (
  SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)
), pairs AS (
  SELECT a.word AS word, b.word AS other FROM cut a JOIN cut b USING (i, rest) WHERE a.word <> b.word
  UNION SELECT cut.word, words.word FROM cut JOIN words ON cut.rest = words.word
  UNION SELECT words.word, cut.word FROM cut JOIN words ON cut.rest = words.word
), near AS (
  SELECT pairs.word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS best, max(n) AS best_n
  FROM pairs JOIN words ON words.word = other GROUP BY pairs.word
), formed AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best_n >= 10 * n THEN best END AS form, CASE WHEN best_n >= 10 * n THEN best_n END AS form_n
  FROM words LEFT JOIN near USING (word)
), led AS (
  SELECT word, coalesce(form, word) AS root, form IS NOT NULL AS going FROM formed
  UNION ALL SELECT led.word, f.form, TRUE FROM led JOIN formed f ON f.word = led.root WHERE led.going AND f.form IS NOT NULL
), steps AS (
  SELECT word, root, row_number() OVER (PARTITION BY word ORDER BY n DESC) AS back FROM led JOIN (SELECT word AS root, n FROM words) USING (root)
)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN (SELECT word, root FROM steps WHERE back = 1) USING (word)
"""
