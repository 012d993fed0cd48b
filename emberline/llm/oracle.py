"""DuckDB SQL of the numbered queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SHARED_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORDS = r"[^\x20\x09-\x0D]+"

_PREFERENCE = """
WITH numbered AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS i FROM conversations WHERE conv_id IS NOT NULL
), chosen AS (SELECT *, max(CASE WHEN role = 'assistant' THEN i END) OVER (PARTITION BY conv_id) AS pos FROM numbered),
parts AS (
  SELECT conv_id, i, pos, role, '<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10) AS good,
    '<|' || role || '|>' || chr(10) || CASE WHEN i = pos THEN array_to_string(list_reverse(string_split(text, ' ')), ' ') ELSE text END || chr(10) || '<|end|>' || chr(10) AS bad FROM chosen WHERE pos IS NOT NULL
), placed AS (
  SELECT *, coalesce(sum(CASE WHEN i >= pos THEN length(good) ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM parts
)
SELECT conv_id AS pair_id, min(pos) AS n_common, coalesce(string_agg(good, '' ORDER BY i) FILTER (i < pos), '') AS prompt, string_agg(good, '' ORDER BY i) FILTER (i >= pos) AS chosen_completion,
  string_agg(CASE WHEN role = 'assistant' THEN '1' ELSE '0' END, '' ORDER BY i) FILTER (i >= pos) AS chosen_mask, string_agg((start + length(role) + 5) || ':' || (start + length(good)), ',' ORDER BY i) FILTER (i >= pos AND role = 'assistant') AS chosen_spans,
  string_agg(bad, '' ORDER BY i) FILTER (i >= pos) AS rejected_completion, string_agg(CASE WHEN role = 'assistant' THEN '1' ELSE '0' END, '' ORDER BY i) FILTER (i >= pos) AS rejected_mask,
  string_agg((start + length(role) + 5) || ':' || (start + length(bad)), ',' ORDER BY i) FILTER (i >= pos AND role = 'assistant') AS rejected_spans
FROM placed GROUP BY conv_id HAVING bool_or(i = pos AND good <> bad)
"""

_DIGEST = "".join(f"{' || ' if i else ''}translate(upper(to_base(CAST('0x' || substr(h, {i * 5 + 1}, 5) AS BIGINT), 32, 4)), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')" for i in range(8))
_WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages), d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, {_DIGEST} AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS head FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> head THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> head THEN head END AS refers_to FROM f
"""

_DECONTAMINATION = f"""
WITH items AS (SELECT item_id, regexp_extract_all({_LOWER.format('text')}, '{_SHARED_WORDS}') AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (SELECT DISTINCT item_id, array_to_string(w[i:least(i + 9, len(w))], ' ') AS g, least(10, len(w)) AS n FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_SHARED_WORDS}') AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM windows),
spots AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, spots.n, item_id FROM spots JOIN windows USING (g, n)),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""

_NEAR_DUPLICATES = f"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORDS}') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, CASE WHEN len(w) >= 3 THEN unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], chr(9)))) END AS g FROM docs WHERE len(w) >= 3 UNION ALL SELECT doc_id, array_to_string(w, chr(9)) FROM docs WHERE len(w) BETWEEN 1 AND 2)),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * both_ >= 85 * (x.n + y.n - both_)),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) LEFT JOIN sizes USING (doc_id)
"""

_REPETITION = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
grams AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (VALUES (4), (8), (101)) AS sizes(n) WHERE len(w) >= n)),
twice AS (SELECT doc_id, n, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, n, g) AS c FROM grams) WHERE c > 1),
spans AS (SELECT doc_id, n, unnest(range(i, i + n)) AS k FROM twice WHERE n < 101),
covered AS (SELECT doc_id, count(DISTINCT k) FILTER (n = 8) AS n_repeat, count(DISTINCT k) FILTER (n = 4) AS n_covered FROM spans GROUP BY doc_id),
long_ AS (SELECT DISTINCT doc_id FROM twice WHERE n = 101),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '{_WORDS}') GROUP BY doc_id),
sums AS (
  SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words, coalesce(n_covered, 0) AS n_covered, long_.doc_id IS NOT NULL AS is_long
  FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN long_ USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_covered <= 0.30 * n_words AND NOT is_long AS kept FROM sums
"""

# The jumps of a key are the same for any number of shards: its shard is the last place below it. CRC-32 goes byte by byte through its table.
_SHARDS = """
WITH RECURSIVE docs AS (SELECT doc_id, coalesce(text, '') AS text, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS hash FROM documents),
jumps AS (
  SELECT DISTINCT hash, CAST(hash AS HUGEINT) AS state, CAST(0 AS BIGINT) AS place FROM docs
  UNION ALL
  SELECT hash, state, CAST(floor((place + 1) * (CAST(2147483648 AS DOUBLE) / (CAST(state // 8589934592 AS DOUBLE) + 1))) AS BIGINT) FROM (SELECT hash, (state * 2862933555777941757 + 1) % 18446744073709551616 AS state, place FROM jumps WHERE place < 17)
), shards AS (SELECT hash, max(place) FILTER (place < 16) AS shard, max(place) FILTER (place < 17) AS grown FROM jumps GROUP BY hash),
steps AS (SELECT n, n AS c, 0 AS k FROM range(256) AS bytes(n) UNION ALL SELECT n, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM steps WHERE k < 8),
crcs AS (SELECT list(c ORDER BY n) AS remainders FROM steps WHERE k = 8),
sums AS (
  SELECT doc_id, hash, octet_length(encode(text)) + 1 AS size,
    xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS BIGINT))), lambda a, x: xor(a // 256, remainders[xor(a, x) % 256 + 1])), 4294967295) AS text_crc32 FROM docs, crcs
)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || size || ':' || text_crc32 || ':0'), 1, 15) AS BIGINT), doc_id, size, text_crc32) - 1 AS slot, CAST(grown AS INTEGER) AS grown_shard FROM sums JOIN shards USING (hash)
"""

# Paths of edits go turn by turn, one row a grammar state (0 start, 1 system, 2 user, 3 assistant): the cheapest, and the least audit of those.
_REPAIR = r"""
WITH RECURSIVE steps AS (SELECT n, n AS c, 0 AS k FROM range(256) AS bytes(n) UNION ALL SELECT n, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM steps WHERE k < 8),
crcs AS (SELECT list(c ORDER BY n) AS remainders FROM steps WHERE k = 8),
kinds AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))), '..'), lambda h: CAST('0x' || h AS BIGINT))),
      lambda a, x: xor(a // 256, remainders[xor(a, x) % 256 + 1])), 4294967295) % 20 AS kind
  FROM conversations, crcs
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM kinds, (VALUES (1), (2)) AS copies(n) WHERE kind <> 0 AND (n = 1 OR kind = 3)
), numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM damaged),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS copy, left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) AS follows FROM numbered),
marked AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN copy > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS mark FROM seen),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (mark = 'blank') AS blank, count(*) FILTER (mark = 'duplicate') AS duplicate, count(*) FILTER (mark = 'truncated') AS truncated,
    count(*) FILTER (follows NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM marked GROUP BY conv_id
), moves AS (FROM (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) AS moves(q, x, r)),
roles AS (FROM (VALUES ('u', 'user'), ('a', 'assistant')) AS roles(x, name)),
edits AS (
  SELECT q, q AS r, 'D' AS letter, 4 AS price, '' AS x, '' AS name FROM (VALUES (0), (1), (2), (3)) AS states(q)
  UNION ALL SELECT q, r, 'K', 0, x, '' FROM moves
  UNION ALL SELECT q, r, 'R', 3, '', name FROM moves JOIN roles USING (x)
), inserts AS (
  SELECT q, q AS r, 0 AS n, '' AS lines FROM (VALUES (0), (1), (2), (3)) AS states(q)
  UNION ALL SELECT inserts.q, moves.r, n + 1, lines || chr(10) || name || ':' FROM inserts JOIN moves ON moves.q = inserts.r JOIN roles USING (x) WHERE n < 3
), paths AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 0 AS q, 0 AS cost, '' AS audit, '' AS lines FROM marked
  UNION ALL
  SELECT conv_id, i, q, cost, audit, lines FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, q ORDER BY cost, audit) AS best FROM (
      SELECT p.conv_id, t.i, e.r AS q, p.cost + 3 * s.n + e.price + CASE WHEN mark = 'truncated' AND letter <> 'D' THEN 3 ELSE 0 END AS cost, p.audit || repeat('I', s.n) || letter AS audit,
        p.lines || s.lines || CASE letter WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || role || ':' || text ELSE chr(10) || name || ':' || text END AS lines
      FROM paths p JOIN marked t ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.i = p.i + 1 JOIN inserts s ON s.q = p.q JOIN edits e ON e.q = s.r AND (letter = 'D' OR mark IN ('', 'truncated')) AND (letter <> 'K' OR x = left(role, 1))
    )
  ) WHERE best = 1
), ended AS (
  SELECT p.conv_id, p.cost + 3 * s.n AS cost, p.audit || repeat('I', s.n) AS audit, p.lines || s.lines AS lines FROM paths p JOIN counts c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.n = p.i JOIN inserts s ON s.q = p.q WHERE s.r IN (0, 3)
), repaired AS (SELECT * FROM ended QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(substr(coalesce(lines, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM o.conv_id
"""

_TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_SEARCH = f"""
WITH docs AS (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_TERMS}') AS w FROM documents),
totals AS (SELECT CAST(count(*) FILTER (len(w) > 0) AS BIGINT) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_all FROM docs),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all({_LOWER.format('text')}, '{_TERMS}')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)) GROUP BY ALL),
hits AS (SELECT d, doc_id, len(w) AS n, term, count(*) AS tf FROM (SELECT d, doc_id, w, unnest(w) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM hits, totals GROUP BY term, n_docs),
scores AS (
  SELECT item_id, d, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_all)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN hits USING (term), totals GROUP BY item_id, d, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0 QUALIFY rank <= 10
"""

_SKETCH = r"""list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: substr(md5(array_to_string(w[i:i + 4], ' ')), 1, 16))))[1:128]"""
_FINGERPRINTS = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lead(text) OVER t, first_value(text) OVER t, '') AS next FROM documents WINDOW t AS (ORDER BY doc_id NULLS FIRST, text NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
edits AS (SELECT *, substr(text, 1, length(text) - length(text) // 2) || substr(next, 1, length(text) // 2) AS edited FROM docs),
splits AS (SELECT *, ['', '', '', ''] || regexp_extract_all(lower(text), '{_WORDS}') AS w0, ['', '', '', ''] || regexp_extract_all(lower(edited), '{_WORDS}') AS w1, ['', '', '', ''] || regexp_extract_all(lower(next), '{_WORDS}') AS w2 FROM edits),
sketches AS (SELECT *, {_SKETCH.replace('w', 'w0')} AS a, {_SKETCH.replace('w', 'w1')} AS b, {_SKETCH.replace('w', 'w2')} AS c FROM splits),
unions AS (SELECT *, list_sort(list_distinct(a || b))[1:128] AS ab, list_sort(list_distinct(a || c))[1:128] AS ac FROM sketches)
SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, array_to_string(a, '') AS fingerprint, array_to_string(b, '') AS edited_fingerprint,
  CASE WHEN len(ab) = 0 THEN 1.0 ELSE CAST(len(list_filter(ab, lambda x: list_contains(a, x) AND list_contains(b, x))) AS DOUBLE) / len(ab) END AS near_edited,
  CASE WHEN len(ac) = 0 THEN 1.0 ELSE CAST(len(list_filter(ac, lambda x: list_contains(a, x) AND list_contains(c, x))) AS DOUBLE) / len(ac) END AS near_next
FROM unions
"""

SQL: dict[str, str] = {"op1_preference_formatting": _PREFERENCE, "op3_warc_index": _WARC, "op4_decontamination": _DECONTAMINATION, "op6_near_duplicates": _NEAR_DUPLICATES, "op7_jump_shards": _SHARDS, "op10_repetition": _REPETITION, "op11_conversation_repair": _REPAIR, "op12_ranked_search": _SEARCH, "op13_fingerprints": _FINGERPRINTS}
