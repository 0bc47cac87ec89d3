"""DuckDB SQL for the operators that SQL can express."""

EXACT_DEDUP = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

#: The targets by repeated resharing in closed form; a document's words by its place in its source's stream.
MIXING = r"""
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS ord FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS sid
  FROM rows GROUP BY source),
weighed AS (SELECT *, [5.0, 2.0, 1.0][((sid - 1) % 3 + 1)::INT]::DOUBLE AS w, 3 * source_size AS cap FROM sources),
levels AS (
  SELECT a.sid, ((SELECT sum(source_size) FROM weighed)
    - coalesce((SELECT sum(b.cap) FROM weighed b WHERE (b.cap / b.w, b.sid) < (a.cap / a.w, a.sid)), 0))::DOUBLE
    / (SELECT sum(b.w) FROM weighed b WHERE (b.cap / b.w, b.sid) >= (a.cap / a.w, a.sid)) AS level FROM weighed a),
water AS (SELECT level FROM weighed JOIN levels USING (sid) WHERE level * w <= cap ORDER BY cap / w, sid LIMIT 1),
targets AS (
  SELECT source, source_size, least(cap, (SELECT level FROM water) * w)::DOUBLE AS target FROM weighed),
placed AS (
  SELECT r.*, source_size, target, round(target)::BIGINT AS quota,
         sum(size) OVER (PARTITION BY r.source ORDER BY ord, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS b
  FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CASE WHEN size = 0 THEN 0 ELSE
  (quota // source_size) * size + greatest(0, least(b, quota % source_size) - (b - size)) END::BIGINT AS taken
FROM placed
"""

#: All pairs that share a shingle, exact similarities, and the groups as the closure of the links.
NEAR_DUPLICATES = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS rid, doc_id,
         list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
spots AS (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w),
sh AS (SELECT DISTINCT rid, array_to_string(ws[i:i + 4], ' ') AS s FROM spots),
n AS (SELECT rid, count(*) AS n FROM sh GROUP BY rid),
met AS (SELECT a.rid AS l, b.rid AS r, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.rid <> b.rid GROUP BY ALL),
links AS (SELECT l, r FROM met JOIN n a ON a.rid = l JOIN n b ON b.rid = r WHERE c / (a.n + b.n - c) >= 0.8),
reach AS (SELECT rid AS a, rid AS b FROM w UNION SELECT reach.a, links.r FROM reach JOIN links ON reach.b = links.l),
grp AS (SELECT a AS rid, max(doc_id) AS class_id, count(*) AS group_size FROM reach JOIN w ON w.rid = b GROUP BY a)
SELECT w.doc_id, class_id, (SELECT count(*) FROM links WHERE l = w.rid) AS n_links, group_size, w.doc_id = class_id AS kept
FROM w JOIN grp USING (rid)
"""

#: Digests straight from the turns; the formatted length from the template's marks and escapes.
CHAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations UNION ALL
  SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, t) AS k FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(t)) FILTER (r = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY k) FILTER (r = 'assistant'), '')) AS loss_sha256,
  sum(length('### ' || regexp_replace(r, '(\\|###|:|</turn>)', '\\\1', 'g') || ': '
      || regexp_replace(t, '(\\|###|</turn>)', '\\\1', 'g') || ' </turn>' || chr(10)))::BIGINT AS formatted_chars,
  regexp_full_match(string_agg(r || ',', '' ORDER BY k), '(system,)?(user,assistant,)+') AS valid
FROM ordered GROUP BY conv_id
"""

#: crc32 by its table over the bytes; near words by shared deletions: of one word, or of both at one place.
SPELLING = r"""
WITH RECURSIVE t AS (
  SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
runs AS (
  SELECT doc_id, run, count(*) AS k FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= 5 GROUP BY ALL),
coded AS (SELECT run, k, hex(coalesce(doc_id::VARCHAR, '') || ':' || run) AS x FROM runs),
hashed AS (
  SELECT run, k, xor(list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM coded, t),
words AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed),
v AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM words WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
cut AS MATERIALIZED (
  SELECT word, i, left(word, i) || substr(word, i + 2) AS d FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
pairs AS (
  SELECT cut.word AS a, v.word AS b FROM cut JOIN v ON cut.d = v.word UNION
  SELECT v.word, cut.word FROM cut JOIN v ON cut.d = v.word UNION
  SELECT x.word, y.word FROM cut x JOIN cut y ON x.d = y.d AND x.i = y.i AND x.word <> y.word),
best AS (
  SELECT a, count(*) AS n_near, first(b ORDER BY v.n DESC, b) AS b, max(v.n) AS m FROM pairs JOIN v ON v.word = b GROUP BY a),
formed AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN b END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n
  FROM v LEFT JOIN best ON a = word),
hop AS (
  SELECT word, form AS up, 1 AS k FROM formed WHERE form IS NOT NULL UNION ALL
  SELECT hop.word, f.form, k + 1 FROM hop JOIN formed f ON hop.up = f.word WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(up, k) AS root FROM hop GROUP BY word)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM formed LEFT JOIN ends USING (word)
"""

#: Every document's score for every item, straight from the terms.
RANKED = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
s AS (SELECT (count(*) FILTER (len(ts) > 0))::BIGINT AS nd, sum(len(ts))::BIGINT AS nt FROM d),
q AS (
  SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM benchmark),
qt AS (SELECT q, item_id, term, count(*)::BIGINT AS r FROM (SELECT q, item_id, unnest(ts) AS term FROM q) GROUP BY ALL),
p AS (
  SELECT rid, doc_id, n, term, count(*)::BIGINT AS tf
  FROM (SELECT rid, doc_id, len(ts)::BIGINT AS n, unnest(ts) AS term FROM d) GROUP BY ALL),
w AS (
  SELECT term, floor(1000 * ln((2 * nd::DOUBLE + 2) / (2 * count(*)::DOUBLE + 1)))::BIGINT AS w
  FROM p, s WHERE term IN (SELECT term FROM qt) GROUP BY term, nd),
scored AS (
  SELECT q, item_id, rid, doc_id,
         sum(r * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // nt))))::BIGINT AS score
  FROM p JOIN w USING (term) JOIN qt USING (term), s GROUP BY ALL),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 20
"""

ORACLE: dict[str, str] = {"op1_exact_dedup": EXACT_DEDUP, "op3_mixing": MIXING, "op5_near_duplicates": NEAR_DUPLICATES,
                          "op6_chat": CHAT, "op11_spelling": SPELLING, "op12_ranked_search": RANKED}
