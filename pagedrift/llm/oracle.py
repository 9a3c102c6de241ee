"""The queries that SQL can express, as DuckDB SQL over whole tables."""

from __future__ import annotations

#: Space and U+0009 to U+000D, as characters to trim and as a pattern between words.
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_BETWEEN = r"'[\x20\x09-\x0D]+'"
_A_TO_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _words(text: str) -> str:
    return f"string_split_regex(trim({text}, {_BLANKS}), {_BETWEEN})"


def _shingles(words: str) -> str:
    """The distinct runs of five of a list of words; the whole sequence if it has fewer."""
    return f"list_distinct(list_transform(range(1, greatest(len({words}) - 4, 1) + 1), lambda i: array_to_string({words}[i:i + 4], ' ')))"


OP1 = f"""
WITH line AS (
  SELECT doc_id, unnest(range(0, len(lines))) AS pos, unnest(lines) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL)
), spelled AS MATERIALIZED (
  SELECT *, array_to_string(w, ' ') AS said, min(ord) OVER (PARTITION BY array_to_string(w, ' ')) AS first
  FROM (SELECT doc_id, pos, line, {_words("line")} AS w, doc_id * 1000000 + pos AS ord FROM line)
), said_line AS MATERIALIZED (
  SELECT said, any_value(w) AS w, min(ord) AS ord FROM spelled WHERE len(w) >= 5 GROUP BY said
), without AS MATERIALIZED (
  SELECT said, ord, n, i, array_to_string(list_concat(w[1:i - 1], w[i + 1:n]), ' ') AS rest
  FROM (SELECT said, ord, w, len(w) AS n, unnest(range(1, len(w) + 1)) AS i FROM said_line)
), shorter AS (
  SELECT rest, min(ord) AS ord FROM without GROUP BY rest
), gone AS (
  SELECT said FROM (SELECT said, ord, min(ord) OVER (PARTITION BY n, i, rest) AS first FROM without) WHERE ord > first
  UNION SELECT v.said FROM without v JOIN said_line w ON v.rest = w.said WHERE w.ord < v.ord
  UNION SELECT t.said FROM said_line t JOIN shorter s ON t.said = s.rest WHERE s.ord < t.ord
), judged AS (
  SELECT s.*, s.said <> '' AND (s.ord <> s.first OR g.said IS NOT NULL) AS dropped FROM spelled s LEFT JOIN gone g ON g.said = s.said
), told AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped) AS text
  FROM judged GROUP BY doc_id
)
SELECT d.doc_id, coalesce(t.n_lines, 0) AS n_lines, coalesce(t.n_dropped, 0) AS n_dropped, md5(coalesce(t.text, '')) AS text_md5
FROM documents d LEFT JOIN told t USING (doc_id)
"""


def op4(shards: int) -> str:
    """Rendezvous hashing over equal weights; the checksum is folded over the text's bytes with the table of its polynomial."""
    table = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        table.append(x)
    score = "-1.0::DOUBLE / ln((('0x' || substr(md5(doc_id::VARCHAR || '/' || j::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE)"
    return f"""
WITH score AS (
  SELECT doc_id, j, {score} AS score FROM documents, range(0, {shards + 1}) t(j)
), chosen AS (
  SELECT doc_id, arg_max(j, (score, -j)) FILTER (j < {shards}) AS shard, arg_max(j, (score, -j)) AS grown FROM score GROUP BY doc_id
), summed AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size,
    xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT),
      lambda c, b: xor(c >> 8, ({table}::BIGINT[])[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32
  FROM documents
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY md5(doc_id::VARCHAR), doc_id, size, text_crc32) - 1 AS slot, grown::INTEGER AS grown_shard
FROM chosen JOIN summed USING (doc_id)
"""


OP5 = f"""
WITH item_words AS (
  SELECT item_id, w, least(len(w), 5) AS k FROM (SELECT item_id, {_words("lower(coalesce(text, ''))")} AS w FROM benchmark) WHERE w[1] <> ''
), item AS (
  SELECT item_id, k, list_distinct(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s FROM item_words
), doc AS (
  SELECT doc_id, k, list_distinct(list_transform(range(1, greatest(len(w) - k + 2, 1)), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s
  FROM (SELECT doc_id, {_words("lower(coalesce(text, ''))")} AS w FROM documents), (SELECT DISTINCT k FROM item_words) WHERE w[1] <> ''
)
SELECT doc_id, item_id, n AS n_shingles, count(*) AS n_found, count(*)::DOUBLE / n AS containment
FROM (SELECT item_id, k, len(s) AS n, unnest(s) AS x FROM item) JOIN (SELECT doc_id, k, unnest(s) AS x FROM doc) USING (k, x)
GROUP BY doc_id, item_id, n HAVING count(*) * 10 >= n * 8
"""

OP6 = f"""
WITH RECURSIVE doc AS MATERIALIZED (
  SELECT doc_id, CASE WHEN w[1] <> '' THEN {_shingles("w")} ELSE [] END AS s
  FROM (SELECT doc_id, {_words(f"translate(coalesce(text, ''), {_A_TO_Z})")} AS w FROM documents)
), shingle AS MATERIALIZED (
  SELECT doc_id, len(s) AS n, unnest(s) AS x FROM doc
), link AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingle a JOIN shingle b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id, doc_id AS root FROM doc
  UNION SELECT link.b, reach.root FROM reach JOIN link ON link.a = reach.doc_id
)
SELECT doc_id, len(any_value(s)) AS n_shingles, min(root) AS component_id, min(root) = doc_id AS kept FROM doc JOIN reach USING (doc_id) GROUP BY doc_id
"""

OP7 = """
WITH spoken AS (
  SELECT conv_id, coalesce(turn, CAST('-9223372036854775808' AS BIGINT)) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), answer AS (
  SELECT conv_id, turn, max(text) AS text FROM spoken
  WHERE role = 'assistant' AND turn = (SELECT max(turn) FROM spoken s WHERE s.conv_id = spoken.conv_id AND s.role = 'assistant') GROUP BY ALL
), told AS (
  SELECT conv_id AS pair_id, 'chosen' AS side, turn, role, text FROM spoken
  UNION ALL SELECT conv_id, 'rejected', turn, role, text FROM spoken WHERE NOT (role = 'assistant' AND (conv_id, turn) IN (SELECT (conv_id, turn) FROM answer))
  UNION ALL SELECT a.conv_id, 'rejected', a.turn, 'assistant', b.text FROM answer a JOIN answer b ON b.conv_id = xor(a.conv_id, 1)
), heads AS (
  SELECT pair_id, turn, list_sort(list(role || chr(1) || text) FILTER (side = 'chosen')) IS NOT DISTINCT FROM list_sort(list(role || chr(1) || text) FILTER (side = 'rejected')) AS same
  FROM told GROUP BY pair_id, turn
), parted AS (
  SELECT pair_id, min(turn) FILTER (NOT same) AS differs FROM heads GROUP BY pair_id
), said AS (
  SELECT t.*, CASE WHEN differs IS NULL OR turn < differs THEN 'prompt' ELSE side END AS part, '<|' || role || '|>' || chr(10) AS head FROM told t JOIN parted USING (pair_id)
), placed AS (
  SELECT *, head || text || '<|end|>' || chr(10) AS segment,
    coalesce(sum(length(head || text || '<|end|>' || chr(10))) OVER (PARTITION BY pair_id, part ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM said WHERE part <> 'prompt' OR side = 'chosen'
), part AS (
  SELECT pair_id, part, string_agg(segment, '' ORDER BY turn, role, text) AS text,
    string_agg((start + length(head)) || '-' || (start + length(segment)), ',' ORDER BY turn, role, text) FILTER (part <> 'prompt' AND role = 'assistant') AS spans
  FROM placed GROUP BY pair_id, part
)
SELECT pair_id, 0::BIGINT AS piece, coalesce(max(text) FILTER (part = 'prompt'), '') AS prompt, coalesce(max(text) FILTER (part = 'chosen'), '') AS chosen, coalesce(max(text) FILTER (part = 'rejected'), '') AS rejected,
  coalesce(max(spans) FILTER (part = 'chosen'), '') AS chosen_trained, coalesce(max(spans) FILTER (part = 'rejected'), '') AS rejected_trained
FROM part GROUP BY pair_id
"""

_MASK = (1 << 64) - 1
#: A run of eight mixed code points as a number in the base of the fingerprints, and the mixing of 64 bits, step by step.
_GRAM = " + ".join(f"((coalesce(lead(x, {j}) OVER w, 0) * {pow(0x9E3779B97F4A7C15, 7 - j, 1 << 64)}::UHUGEINT) & {_MASK})" for j in range(8))

OP10 = f"""
WITH doc AS MATERIALIZED (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(lead(text) OVER w, first_value(text) OVER w, '') AS after
  FROM documents WINDOW w AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
), edition AS MATERIALIZED (
  SELECT doc_id, false AS edited, text FROM doc
  UNION ALL SELECT doc_id, true, left(text, length(text) - length(text) // 3) || left(after, length(text) // 3) FROM doc
), point AS (
  SELECT doc_id, edited, length(text) AS n, unnest(range(0, length(text))) AS pos, (unicode(unnest(string_split(text, ''))) + 1)::UHUGEINT AS x FROM edition WHERE length(text) >= 8
), first_mix AS (
  SELECT doc_id, edited, n, pos, (xor(x, x >> 30) * {0xBF58476D1CE4E5B9}) & {_MASK} AS x FROM point
), second_mix AS (
  SELECT doc_id, edited, n, pos, (xor(x, x >> 27) * {0x94D049BB133111EB}) & {_MASK} AS x FROM first_mix
), mixed AS (
  SELECT doc_id, edited, n, pos, xor(x, x >> 31) AS x FROM second_mix
), gram AS (
  SELECT doc_id, edited, n - 7 AS grams, pos, ({_GRAM}) & {_MASK} AS x FROM mixed WINDOW w AS (PARTITION BY doc_id, edited ORDER BY pos)
), third_mix AS (
  SELECT doc_id, edited, grams, pos, (xor(x, x >> 30) * {0xBF58476D1CE4E5B9}) & {_MASK} AS x FROM gram WHERE pos < grams
), fourth_mix AS (
  SELECT doc_id, edited, grams, pos, (xor(x, x >> 27) * {0x94D049BB133111EB}) & {_MASK} AS x FROM third_mix
), hashed AS (
  SELECT doc_id, edited, grams, pos, least(64, 1 << greatest(0, floor(log2(greatest(grams // 8, 1)))::INT)) AS size, ((xor(x, x >> 31) >> 20) << 24) + (16777215 - pos)::UHUGEINT AS x FROM fourth_mix
), least_of AS (
  SELECT doc_id, edited, min(x) OVER (PARTITION BY doc_id, edited ORDER BY pos ROWS BETWEEN CURRENT ROW AND size - 1 FOLLOWING) AS x, pos, grams, size FROM hashed
), chosen AS MATERIALIZED (
  SELECT DISTINCT doc_id, edited, (x >> 24)::UBIGINT AS h, 16777215 - (x & 16777215)::BIGINT AS p FROM least_of WHERE pos <= grams - size
  UNION ALL SELECT doc_id, edited, ('0x' || left(sha256(text), 16))::UBIGINT >> 20, 0 FROM edition WHERE length(text) BETWEEN 1 AND 7
), told AS MATERIALIZED (
  SELECT doc_id, edited, coalesce(string_agg(printf('%016x%08x', h::BIGINT, p), '' ORDER BY p), '') AS fingerprint, coalesce(list_distinct(list(h)), []) AS hs FROM edition LEFT JOIN chosen USING (doc_id, edited) GROUP BY 1, 2
), next AS (
  SELECT doc_id, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id FROM documents WINDOW w AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
), like_of AS (
  SELECT a.doc_id, a.fingerprint, e.fingerprint AS edited_fingerprint, len(list_intersect(a.hs, e.hs)) AS ie, len(list_distinct(list_concat(a.hs, e.hs))) AS ue, len(list_intersect(a.hs, b.hs)) AS ib, len(list_distinct(list_concat(a.hs, b.hs))) AS ub
  FROM told a JOIN told e ON e.doc_id = a.doc_id AND e.edited JOIN next x ON x.doc_id = a.doc_id JOIN told b ON b.doc_id = next_id AND NOT b.edited WHERE NOT a.edited
)
SELECT d.doc_id, length(d.text) AS n_chars, sha256(e.text) AS edited_sha256, fingerprint, edited_fingerprint,
  CASE WHEN ue > 0 THEN ie / ue ELSE 1 END AS near_edited, CASE WHEN ub > 0 THEN ib / ub ELSE 1 END AS near_next
FROM doc d JOIN edition e ON e.doc_id = d.doc_id AND e.edited JOIN like_of l ON l.doc_id = d.doc_id
"""


def op9(path: str) -> str:
    """Byte-pair encoding by the rank file at path: a white-space run before a word is cut before its last character, for the
    pattern looks ahead; each distinct pre-token merges its pair of the lowest rank, the leftmost of equal ones, step by step."""
    return f"""
WITH RECURSIVE rank AS MATERIALIZED (
  SELECT hex(from_base64(token)) AS token, id FROM read_csv('{path}', delim = ' ', header = false, quote = '', escape = '', columns = {{'token': 'VARCHAR', 'id': 'INTEGER'}})
), piece AS (
  SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS piece
  FROM (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '(\\s+)(\\s)(\\S)', '\\1' || chr(1) || '\\2\\3', 'g'), chr(1)) AS p FROM documents)
), token AS MATERIALIZED (
  SELECT doc_id, i, generate_subscripts(w, 1) AS j, unnest(w) AS word
  FROM (SELECT doc_id, i, regexp_extract_all(piece, '''s|''t|''re|''ve|''m|''ll|''d| ?\\pL+| ?\\pN+| ?[^\\s\\pL\\pN]+|\\s+') AS w FROM piece)
), word AS MATERIALIZED (
  SELECT DISTINCT word, hex(encode(word)) AS bytes FROM token
), split AS (
  SELECT word, CASE WHEN id IS NOT NULL THEN [bytes] ELSE regexp_extract_all(bytes, '..') END AS parts FROM word LEFT JOIN rank ON token = bytes
), merging AS (
  SELECT word, parts, len(parts) > 1 AS more FROM split
  UNION ALL
  SELECT m.word, CASE WHEN at_i IS NOT NULL THEN list_concat(parts[1:at_i - 1], [parts[at_i] || parts[at_i + 1]], parts[at_i + 2:]) ELSE parts END, at_i IS NOT NULL
  FROM merging m LEFT JOIN (
    SELECT word, arg_min(k, (id, k)) AS at_i FROM (SELECT word, unnest(range(1, len(parts))) AS k, parts FROM merging WHERE more) JOIN rank ON token = parts[k] || parts[k + 1] GROUP BY word
  ) b USING (word) WHERE more
), coded AS MATERIALIZED (
  SELECT word, count(*) AS n, string_agg(printf('%02x%02x%02x%02x', id & 255, (id >> 8) & 255, (id >> 16) & 255, (id >> 24) & 255), '' ORDER BY k) AS ids, string_agg(token, '' ORDER BY k) AS spelled
  FROM (SELECT word, unnest(parts) AS part, generate_subscripts(parts, 1) AS k FROM merging WHERE NOT more) JOIN rank ON token = part GROUP BY word
)
SELECT d.doc_id, coalesce(sum(n), 0)::BIGINT AS n_tokens, sha256(unhex(coalesce(string_agg(ids, '' ORDER BY i, j), ''))) AS ids_sha256, sha256(unhex(coalesce(string_agg(spelled, '' ORDER BY i, j), ''))) AS decoded_sha256
FROM documents d LEFT JOIN token USING (doc_id) LEFT JOIN coded USING (word) GROUP BY d.doc_id
"""
