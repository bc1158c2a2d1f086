"""SQL of the corpus queries that SQL can express, written from their contracts: windows and joins of
whole lists, for tables of a size that one process can hold."""

from __future__ import annotations

from tidemark.llm import chat_format, fill_middle, prefix_trie, secret_scan
from tidemark.llm.common import WORD
from tidemark.llm.decontamination import ITEM_WORD
from tidemark.llm.quality import FENCE, MAX_REPEAT_PERCENT, MEASURES, MIN_DOCUMENTS, MIN_WORDS

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LONGER = "length(t) - length(regexp_replace(t, '[{}]', '', 'g'))"

# Each measure is a row; each level of grouping gives its documents' buckets in order.
_LEAST = ", ".join(f"('{name}', {least}, {str(lower).lower()})" for name, (least, lower) in MEASURES.items())

QUALITY = f"""
WITH texts AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
split AS MATERIALIZED (
  SELECT r, doc_id, lang, source, t, regexp_extract_all(t, '{WORD}') AS w,
         list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{WORD}')) AS lines
  FROM texts),
windows AS (
  SELECT r, k, w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] AS key
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS k FROM split)),
repeated AS (SELECT r, k FROM windows QUALIFY count(*) OVER (PARTITION BY r, key) > 1),
covered AS (
  SELECT r, count(DISTINCT place) AS n FROM (SELECT r, unnest([k, k + 1, k + 2]) AS place FROM repeated) GROUP BY r),
counts AS (
  SELECT s.r, doc_id, lang, source, len(w) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
         {_LONGER.format("#*$%&|<>")} AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(c.n, 0) AS n_repeat_words, len(lines) AS n_lines, {_LONGER.format("A-Z")} AS n_capitals
  FROM split s LEFT JOIN covered c USING (r)),
measured AS MATERIALIZED (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
         coalesce(word_chars * 100 // nullif(n_words, 0), 0) AS word_length,
         coalesce(n_symbols * 1000 // nullif(word_chars, 0), 0) AS symbols,
         coalesce(n_dup_lines * 1000 // nullif(n_lines, 0), 0) AS dup_lines,
         coalesce(n_repeat_words * 1000 // nullif(n_words, 0), 0) AS repeats,
         coalesce(n_capitals * 1000 // nullif(word_chars, 0), 0) AS capitals
  FROM counts),
long AS MATERIALIZED (
  SELECT r, lang, source, measure, value, value - value % (1::BIGINT << greatest(length(bin(value)) - 6, 0)) AS bucket
  FROM (SELECT r, lang, source, unnest([{", ".join(f"'{m}'" for m in MEASURES)}]) AS measure,
               unnest([{", ".join(f"{m}::BIGINT" for m in MEASURES)}]) AS value
        FROM measured WHERE NOT base_failed)),
levels AS (
  SELECT 1 AS level, lang, source, measure, bucket FROM long
  UNION ALL SELECT 2, lang, NULL, measure, bucket FROM long
  UNION ALL SELECT 3, NULL, NULL, measure, bucket FROM long),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY level, lang, source, measure ORDER BY bucket) AS nth,
         count(*) OVER (PARTITION BY level, lang, source, measure) AS n FROM levels),
quartiles AS (
  SELECT level, lang, source, measure, n, min(bucket) FILTER (4 * nth >= n) AS q1, min(bucket) FILTER (4 * nth >= 3 * n) AS q3
  FROM ordered GROUP BY ALL),
cuts AS (
  SELECT level, lang, source, measure, n, q3 + {FENCE} * greatest(q3 - q1, least_width) AS high,
         CASE WHEN lower_too THEN q1 - {FENCE} * greatest(q3 - q1, least_width) // 2 END AS low
  FROM quartiles JOIN (VALUES {_LEAST}) AS m(measure, least_width, lower_too) USING (measure)),
judged AS (
  SELECT r, value > high OR coalesce(value < low, false) AS outside
  FROM long l JOIN cuts c ON l.measure = c.measure AND (c.level = 3 OR c.n >= {MIN_DOCUMENTS} AND l.lang IS NOT DISTINCT FROM c.lang
       AND (c.level = 2 OR l.source IS NOT DISTINCT FROM c.source))
  QUALIFY row_number() OVER (PARTITION BY r, l.measure ORDER BY c.level) = 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals, base_failed,
       NOT base_failed AND r NOT IN (SELECT r FROM judged WHERE outside) AS kept, {", ".join(MEASURES)}
FROM measured"""

DECONTAMINATION = f"""
WITH texts AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{ITEM_WORD}') AS w FROM documents),
items AS (
  SELECT row_number() OVER () AS i, CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_LOWER}, '{ITEM_WORD}') AS w FROM benchmark),
words AS MATERIALIZED (SELECT DISTINCT doc_id, w, pos, w[pos] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS pos FROM texts)),
counts AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM texts) GROUP BY word),
places AS (
  SELECT i, place, w[place] AS word, coalesce(n, 0) AS n, least(len(w), 10) AS size, len(w) AS len
  FROM (SELECT i, w, unnest(range(1, len(w) + 1)) AS place FROM items) p LEFT JOIN counts c ON c.word = p.w[p.place]),
anchors AS (
  SELECT DISTINCT i, place, word FROM (
    SELECT i, place, word, n, unnest(range(greatest(place - size + 1, 1), least(place, len - size + 1) + 1)) AS start FROM places)
  QUALIFY row_number() OVER (PARTITION BY i, start ORDER BY n, place) <= 2),
shifts AS MATERIALIZED (SELECT doc_id, w, i, place, pos - place AS shift FROM words JOIN anchors USING (word)),
near AS (
  SELECT doc_id, w, count(*) AS n_near, count(DISTINCT i) AS n_near_items FROM shifts x
  WHERE EXISTS (SELECT 1 FROM shifts y WHERE y.doc_id IS NOT DISTINCT FROM x.doc_id AND y.w = x.w AND y.i = x.i
                AND y.place <> x.place AND x.shift - y.shift BETWEEN 1 AND 5) GROUP BY doc_id, w),
windows AS MATERIALIZED (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[k:k + 9], ' ') AS key
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM items WHERE len(w) > 0)),
runs AS (
  SELECT r, k, size, array_to_string(w[k:k + size - 1], ' ') AS key
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM texts, (SELECT DISTINCT size FROM windows))),
hits AS MATERIALIZED (SELECT r, k, size, item_id FROM runs JOIN windows USING (size, key)),
covered AS (
  SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(k, k + size)) AS place FROM hits) GROUP BY r),
listed AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT r, item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT t.doc_id, len(t.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       coalesce(n_near, 0) AS n_near, coalesce(n_near_items, 0) AS n_near_items
FROM texts t LEFT JOIN covered USING (r) LEFT JOIN listed USING (r)
     LEFT JOIN near n ON n.doc_id IS NOT DISTINCT FROM t.doc_id AND n.w = t.w"""

# The checksum takes one byte a step, by the table of its 256 remainders.
_REMAINDERS = """remainders AS MATERIALIZED (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)
              ORDER BY i) AS tab FROM range(256) AS t(i)),"""
SHARDS = f"""
WITH {_REMAINDERS}
texts AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(md5(text), '') AS digest,
         16 + octet_length(encode(coalesce(text, ''))) AS size FROM documents),
sums AS (
  SELECT r, xor(list_reduce(list_transform(regexp_extract_all(hex(t), '..'), lambda h: ('0x' || h)::BIGINT),
                            lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32
  FROM texts, remainders),
placed AS (
  SELECT *, sum(size) OVER () AS total, sum(size) OVER (PARTITION BY digest) AS held,
         sum(size) OVER (ORDER BY digest, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size AS start
  FROM texts),
grouped AS (
  SELECT *, CASE WHEN held * 32 * 40 > total THEN 2 * start + size
                 ELSE 2 * min(start) OVER (PARTITION BY digest) + held END AS middle FROM placed),
sharded AS (SELECT *, CAST(least(39, middle * 40 // (2 * total)) AS INTEGER) AS shard FROM grouped)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY digest, doc_id NULLS FIRST, size) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM sharded JOIN sums USING (r)"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE texts AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOWER}, '{WORD}') AS w FROM documents),
sets AS MATERIALIZED (
  SELECT DISTINCT doc_id, md5(array_to_string(w[k:k + 4], ' ')) AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM texts WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (
  SELECT a, b FROM shared s JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * s.n >= 85 * (x.n + y.n - s.n)),
reached(v, c) AS (
  SELECT a, a FROM links UNION SELECT b, c FROM reached JOIN links ON a = v),
least_reached AS (SELECT v, min(c) AS c FROM reached GROUP BY v)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, doc_id) AS component_id, coalesce(c, doc_id) = doc_id AS kept
FROM texts LEFT JOIN sizes USING (doc_id) LEFT JOIN least_reached ON v = doc_id"""

# Letters in either case are spelled out, as case-blind matching here goes beyond ASCII.
_EITHER = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
                   for word in ("password", "passwd", "secret", "token", "api_?key"))
_PATTERNS = (rf"""({_EITHER})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "AKIA[A-Z0-9]+", "[0-9a-f]+",
             "[A-Za-z0-9+/_=-]+")
_PIECES = " UNION ALL ".join(
    "SELECT r, {0} AS kind, string_split_regex(t, '{1}') AS gaps, regexp_extract_all(t, '{1}') AS found, "
    "regexp_extract_all(t, '{1}', {2}) AS parts FROM texts".format(kind, pattern.replace("'", "''"), 0 if kind else 2)
    for kind, pattern in enumerate(_PATTERNS))
_BITS = " ".join(f"WHEN regexp_matches(part, '{pattern}') THEN {secret_scan.most(bits)}"
                 for pattern, bits in secret_scan.CLASSES.values())
# Possessive or not is the same here: no word can give up a character to what follows.
_ALLOWED = " OR ".join(f"regexp_matches(part, '{pattern.replace('++', '+').replace('*+', '*')}')" for pattern in secret_scan.ALLOWED)
# A window of hexadecimal digits, in a run of these with a letter: in the window, or next to its decimal digits.
_HEX_WINDOW = (f"regexp_full_match(seen, '{secret_scan.HEX_DIGIT}+') AND (regexp_matches(seen, '[A-Fa-f]') OR "
               f"regexp_matches(substr(part, k + {secret_scan.WINDOW + 1}), '^[0-9]*[A-Fa-f]') OR "
               "regexp_matches(substr(part, 1, k), '[A-Fa-f][0-9]*$'))")
_SCALED = [secret_scan.scaled(c) for c in range(secret_scan.WINDOW + 1)]
_LIST = f"{list(secret_scan.KINDS)}[kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind, stop"

SECRETS = f"""
WITH texts AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
pieces AS (
  SELECT r, kind, unnest(found) AS hit, unnest(parts) AS part, unnest(gaps[1:len(found)]) AS gap,
         unnest(range(1, len(found) + 1)) AS j FROM ({_PIECES})),
located AS MATERIALIZED (
  SELECT r, kind, part, stop - length(hit) AS start, stop
  FROM (SELECT *, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY r, kind ORDER BY j) AS BIGINT) AS stop FROM pieces)),
base AS MATERIALIZED (
  SELECT r, kind, start, stop FROM located WHERE length(part) >= [{secret_scan.ASSIGN_LENGTH}, 18, 16][kind + 1] AND kind < 3),
candidates AS (
  SELECT r, part, start, CASE {_BITS} END AS most FROM located
  WHERE kind = 3 AND length(part) >= {secret_scan.WINDOW} AND regexp_matches(part, '[0-9]') AND NOT ({_ALLOWED})),
windows AS (
  SELECT r, start, k, list_histogram(string_split(seen, '')) AS counts,
         CASE WHEN {_HEX_WINDOW} THEN greatest(most, {secret_scan.most(secret_scan.CLASSES["hex"][1])}) ELSE most END AS most
  FROM (SELECT *, part[k + 1:k + {secret_scan.WINDOW}] AS seen
        FROM (SELECT *, unnest(range(0, length(part) - {secret_scan.WINDOW - 1})) AS k FROM candidates))),
dense AS (
  SELECT r, start + min(k) AS start, start + max(k) + {secret_scan.WINDOW} AS stop FROM windows w
  WHERE list_sum(list_transform(map_values(counts), lambda c: {_SCALED}[c::BIGINT + 1])) <= most GROUP BY r, w.start),
spans AS (
  SELECT * FROM base UNION ALL
  SELECT r, 3, start, stop FROM dense d
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = d.r AND b.start < d.stop AND d.start < b.stop)),
listed AS (
  SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         string_agg({_LIST}) FILTER (kind < 3) AS base, string_agg({_LIST}) AS spans FROM spans GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN listed USING (r)"""

_SPM, _PREFIX, _SUFFIX, _MIDDLE = fill_middle.SPM, *(m.decode() for m in (fill_middle.PREFIX, fill_middle.SUFFIX, fill_middle.MIDDLE))

FILL_MIDDLE = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{fill_middle.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS digest FROM documents),
split AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+') AS lines,
         [('0x' || substr(digest, 8 * k + 1, 8))::BIGINT FOR k IN range(4)] AS h FROM texts),
cuts AS (
  SELECT *, len(lines) AS n, least(h[1] % (len(lines) + 1), h[2] % (len(lines) + 1)) AS low,
         greatest(h[1] % (len(lines) + 1), h[2] % (len(lines) + 1)) AS high,
         CASE WHEN t = '' OR contains(t, '{_PREFIX}') OR contains(t, '{_SUFFIX}') OR contains(t, '{_MIDDLE}')
                   OR h[3] % 100 >= {fill_middle.RATE} THEN 'plain' WHEN h[4] % 100 < {_SPM} THEN 'spm' ELSE 'psm' END AS form
  FROM split),
parts AS (
  SELECT *, array_to_string(lines[1:low], '') AS prefix, array_to_string(lines[low + 1:high], '') AS middle,
         array_to_string(lines[high + 1:], '') AS suffix FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '{_SUFFIX}' || suffix || '{_PREFIX}' || prefix || '{_MIDDLE}' || middle
              ELSE '{_PREFIX}' || prefix || '{_SUFFIX}' || suffix || '{_MIDDLE}' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts"""

_CLOSED = f"chr(10) || '{chat_format.END}' || chr(10)"

CHAT = f"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, 0 AS planted FROM conversations
  UNION ALL VALUES ({chat_format.PLANTED_ID}, 0, 'user', '{chat_format.PLANTED}', 1),
                   ({chat_format.PLANTED_ID}, 1, '{chat_format.LEARNED}', '{chat_format.PLANTED}', 1)),
turns AS (
  SELECT *, length({_CLOSED}) AS closing,
         CASE WHEN regexp_matches(text, '{chat_format.ESCAPED}') OR strpos(text || {_CLOSED}, {_CLOSED}) <= length(text)
              THEN regexp_replace(text, '{chat_format.CONTROL}', '\\\\\\1', 'g') ELSE text END AS body,
         replace(replace(role, '\\', '\\\\'), chr(10), '\\n') AS head FROM given)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = '{chat_format.LEARNED}'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = '{chat_format.LEARNED}'), '')) AS loss_sha256,
       sum(length('{chat_format.HEAD}') + length(head) + 1 + length(body) + closing)::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id, planted"""

# Here a prefix is the digest of its turns' digests, and subtrees are read off the paths of their nodes' first conversations.
TRIE = f"""
WITH {_REMAINDERS}
turns AS MATERIALIZED (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS pos, digest, bytes
  FROM (SELECT conv_id, turn, octet_length(encode(coalesce(text, ''))) AS bytes,
               md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
        FROM conversations WHERE conv_id IS NOT NULL)),
convs AS (
  SELECT c, c - c % {prefix_trie.GROUP} AS first,
         xor(list_reduce(list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
                         lambda s, x: xor(s >> 8, tab[(xor(s, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) % {prefix_trie.MOST} AS h
  FROM (SELECT DISTINCT c FROM turns), remainders),
rebuilt AS (
  SELECT v.c, 0 AS part, pos, digest, bytes FROM convs v JOIN turns t ON t.c = v.first AND pos <= h
  UNION ALL SELECT v.c, 1, pos, digest, bytes FROM convs v JOIN turns t ON t.c = v.c AND pos > h),
depths AS (SELECT c, digest, bytes, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS d FROM rebuilt),
paths AS MATERIALIZED (
  SELECT c, d, bytes, md5(string_agg(digest, ',') OVER up) AS key, coalesce(md5(string_agg(digest, ',') OVER above), '') AS parent
  FROM depths WINDOW up AS (PARTITION BY c ORDER BY d),
                     above AS (PARTITION BY c ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
  UNION ALL SELECT c, 0, 0, '', NULL FROM convs),
nodes AS MATERIALIZED (
  SELECT key, min(parent) AS parent, min(c) AS c, min(d) AS d, count(*) AS n, min(bytes) AS bytes FROM paths GROUP BY key),
children AS (SELECT parent, count(*) AS n_children FROM nodes GROUP BY parent),
below AS (
  SELECT p.key, count(*) FILTER (x.parent IS NULL) AS n_leaves, sum((v.n - 1) * v.bytes)::BIGINT AS saved_tokens
  FROM nodes v JOIN paths p ON p.c = v.c AND p.d <= v.d LEFT JOIN children x ON x.parent = v.key GROUP BY p.key),
ends AS (
  SELECT key, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS digest
  FROM (SELECT key, c, d, max(d) OVER (PARTITION BY c) AS last FROM paths) WHERE d = last GROUP BY key)
SELECT v.c AS conv_id, v.d AS depth, u.c AS parent_conv_id, v.n AS n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens,
       coalesce(e.digest, sha256('')) AS ends_sha256
FROM nodes v LEFT JOIN nodes u ON u.key = v.parent LEFT JOIN children x ON x.parent = v.key JOIN below b ON b.key = v.key
     LEFT JOIN ends e ON e.key = v.key"""
