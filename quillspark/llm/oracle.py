"""DuckDB SQL for the queries that SQL can express."""

WORD = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x{7F}]+"
LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = rf"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
         md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(md5(text), '')) AS key
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS weight
  FROM docs GROUP BY source),
filled AS (
  SELECT *, row_number() OVER o AS k, sum(2 * source_size) OVER o AS upto, sum(weight) OVER o AS weight_upto,
         sum(source_size) OVER () AS total, sum(weight) OVER () AS weights
  FROM sources WINDOW o AS (ORDER BY source_size / weight, source IS NULL, source ROWS UNBOUNDED PRECEDING)),
levels AS (
  SELECT (total * 1.5::DOUBLE - (upto - 2 * source_size)) / (weights - (weight_upto - weight)) AS level,
         2 * source_size / weight AS own, k FROM filled),
level AS (SELECT min_by(level, k) AS level FROM levels WHERE own >= level),
targets AS (
  SELECT source, source_size, least(source_size * 2.0::DOUBLE, weight * level) AS target,
         CASE WHEN source_size > 0 THEN floor(least(source_size * 2.0::DOUBLE, weight * level) / source_size) ELSE 0 END::BIGINT AS whole
  FROM sources, level),
placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.whole, t.target - t.whole * t.source_size AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.size ROWS UNBOUNDED PRECEDING) - d.size AS start
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target::DOUBLE AS target,
       (whole * size + CASE WHEN rest > 0 AND start * 2 + size <= rest * 2 THEN size ELSE 0 END)::BIGINT AS taken
FROM placed
"""

OP3 = rf"""
WITH items AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all({LOWERED}, '{ALNUM}') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, list_slice(w, i, i + 12) AS win, len(list_slice(w, i, i + 12)) AS n
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM items WHERE len(w) > 0)),
docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({LOWERED}, '{ALNUM}'), []) AS w FROM documents),
lengths AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT r, i, n, list_slice(w, i, i + n - 1) AS win
  FROM (SELECT r, w, n, unnest(range(1, greatest(len(w) - n + 1, 0) + 1)) AS i FROM docs, lengths)),
found AS (SELECT g.r, g.i, g.n, x.item FROM grams g JOIN windows x ON g.n = x.n AND g.win = x.win),
hit AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM found)) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM found WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN ids USING (r)
"""

#: CRC-32 of the list `bytes`: the table of the reflected polynomial is made by its rule, and bytes are folded one by one.
CRC_BITS = "list_reduce(list_prepend(c, range(8)), lambda a, k: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END))"
OP4 = f"""
WITH crc AS (SELECT list_transform(range(256), lambda c: {CRC_BITS}) AS t),
texts AS (
  SELECT doc_id, source, octet_length(encode(coalesce(text, '')))::BIGINT + 8 AS size,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes
  FROM documents),
docs AS (
  SELECT doc_id, source, size,
         xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295) AS crc
  FROM texts, crc),
keyed AS (
  SELECT *, md5('29:' || coalesce(doc_id::VARCHAR, '') || ':' || crc || ':' || size) AS key,
         ('0x' || left(md5('29:' || (source IS NULL)::VARCHAR || ':' || coalesce(source, '')), 8))::BIGINT::DOUBLE / 4294967296 AS unit
  FROM docs),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY key) - 1 AS rank, count(*) OVER (PARTITION BY source) AS n FROM keyed),
placed AS (
  SELECT *, row_number() OVER (ORDER BY (rank + unit) / n, source IS NULL, coalesce(source, ''), rank) - 1 AS place, count(*) OVER () AS total FROM ranked)
SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, (place * 24 // total)::INT AS shard,
       (place - ((place * 24 // total) * total + 23) // 24)::BIGINT AS slot, NULL::INT AS grown_shard
FROM placed
"""

OP6 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""

OP8 = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (
  SELECT a.r AS a, b.r AS b, b.vec_id FROM ok a JOIN ok b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT r AS a, r AS b FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
least AS (SELECT reach.a, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.b GROUP BY 1)
SELECT v.vec_id, (SELECT count(*) FROM link WHERE link.a = v.r)::BIGINT AS n_links, component_id, coalesce(v.vec_id = component_id, false) AS kept
FROM v JOIN least ON least.a = v.r
"""

BLOCKS = "address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|select|table|tbody|td|th|thead|title|tr|ul"
DECODED = "regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>|<!--.*?-->', chr(10), 'g'), '(?i)</?(?:" + BLOCKS + ")\\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g')"
for _entity, _char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&amp;", "&")):
    DECODED = f"replace({DECODED}, '{_entity}', '{_char}')"
OP9 = rf"""
WITH p AS (
  SELECT row_number() OVER () AS r, page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         list_filter(list_transform(string_split({DECODED}, chr(10)), lambda x: regexp_replace(x, '^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$', '', 'g')), lambda x: x <> '') AS lines
  FROM pages),
sites AS (SELECT host, count(*) AS pages FROM p GROUP BY 1),
seen AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM p) GROUP BY ALL),
common AS (SELECT host, list(line) AS common FROM seen JOIN sites USING (host) WHERE n > 1 AND n > 0.5 * pages GROUP BY 1),
cut AS (SELECT page_id, host, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(common, []), x)) AS kept FROM p LEFT JOIN common USING (host))
SELECT page_id, host, len(lines)::BIGINT AS n_lines, len(kept)::BIGINT AS n_kept, sha256(coalesce(array_to_string(kept, chr(10)), '')) AS text_sha256 FROM cut
"""

ORACLES: dict = {"op2_mixing": OP2, "op3_decontamination": OP3, "op4_sharding": OP4, "op6_warc": OP6, "op8_embedding_dedup": OP8, "op9_line_dedup": OP9}

#: Crossing batches with keyed state in plain SQL: a conversation closes after its first arrival that no other follows within three batches.
OP13 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         ('0x' || left(sha256(coalesce(conv_id::VARCHAR, '') || ':' || turn), 8))::BIGINT AS h
  FROM conversations WHERE turn IS NOT NULL),
dealt AS (
  SELECT conv_id, turn, role, text, h % 8 AS batch FROM rows
  UNION ALL SELECT conv_id, turn, 'user', text, (h + 3) % 8 FROM rows WHERE h % 7 < 2),
arrived AS (
  SELECT conv_id, turn, batch, min(struct_pack(payload := role || '|' || text, role := role)) AS m FROM dealt GROUP BY ALL),
last AS (
  SELECT conv_id, least(min(batch) + 3, 8) AS closed
  FROM (SELECT conv_id, batch, lead(batch) OVER (PARTITION BY conv_id ORDER BY batch) AS after FROM (SELECT DISTINCT conv_id, batch FROM arrived))
  WHERE after IS NULL OR after > batch + 3 GROUP BY 1),
firsts AS (SELECT conv_id, min(turn) AS first FROM arrived GROUP BY 1),
heard AS (SELECT a.*, closed FROM arrived a JOIN last l ON a.conv_id IS NOT DISTINCT FROM l.conv_id),
kept AS (
  SELECT h.conv_id, turn, min(batch) AS batch, min_by(m, batch) AS m, any_value(closed) AS closed, any_value(first) AS first
  FROM heard h JOIN firsts f ON h.conv_id IS NOT DISTINCT FROM f.conv_id WHERE batch <= closed GROUP BY h.conv_id, turn),
placed AS (
  SELECT *, turn - first = row_number() OVER w - 1 AS run, max(batch) OVER w AS released,
         coalesce(lag(turn) OVER w = turn - 1 AND lag(m.role) OVER w = m.role, false) AS breaks
  FROM kept WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT 'release' AS event, conv_id, turn, released AS batch, sha256(m.payload) AS sha256, NULL::BIGINT AS n_missing, NULL::BIGINT AS n_breaks FROM placed WHERE run
UNION ALL
SELECT 'reject', conv_id, turn, batch, sha256(m.payload), NULL, NULL FROM heard WHERE batch > closed
UNION ALL
SELECT 'close', conv_id, -1, any_value(closed), sha256(coalesce(string_agg(turn::VARCHAR, ',' ORDER BY turn) FILTER (NOT run), '')),
       (max(turn) - min(first) + 1 - count(*))::BIGINT, count(*) FILTER (breaks)::BIGINT
FROM placed GROUP BY conv_id
"""

#: The same repairs by another way: costs, audits and lines of all states are carried from the last row to the first.
_RETAINED = {"0": "u", "s": "u", "u": "a", "a": "u"}
_NAME = {"u": "user", "a": "assistant"}


def _choices(state: str) -> str:
    to = _RETAINED[state]
    kept = f"CASE WHEN free AND letter = '{to}' THEN {{c: v{to}.c + 5 * cut, a: 'K' || v{to}.a, r: list_prepend(role || ':' || text, v{to}.r)}} END"
    again = f"CASE WHEN free THEN {{c: v{to}.c + 1 + 5 * cut, a: 'R' || v{to}.a, r: list_prepend('{_NAME[to]}:' || text, v{to}.r)}} END"
    first = "CASE WHEN free AND letter = 's' THEN {c: vs.c + 5 * cut, a: 'K' || vs.a, r: list_prepend(role || ':' || text, vs.r)} END, " if state == "0" else ""
    return f"list_sort([{first}{{c: v{state}.c + 2, a: 'D' || v{state}.a, r: v{state}.r}}, {kept}, {again}], 'ASC', 'NULLS LAST')[1] AS w{state}"


def _inserted(state: str, to: str, of: str) -> str:
    return f"list_sort([w{state}, {{c: {of}.c + 5, a: 'I' || {of}.a, r: list_prepend('{_NAME[to]}:', {of}.r)}}])[1]"


OP12 = rf"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda c: {CRC_BITS}) AS t),
src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_transform(regexp_extract_all(hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes
  FROM conversations),
kinds AS (
  SELECT conv_id, turn, role, text,
         xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295) % 20 AS kind
  FROM src, crc),
marred AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM kinds),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM marred),
turns AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS again,
         NOT regexp_matches(text, '[^ 	-
]') AS blank, regexp_matches(text, '[.!?][ 	-
]*\z') AS ended,
         left(role, 1) AS letter
  FROM ordered),
placed AS MATERIALIZED (
  SELECT *, NOT blank AND NOT again AS free, (NOT blank AND NOT again AND NOT ended)::BIGINT AS cut,
         lag(letter) OVER (PARTITION BY conv_id ORDER BY k) || letter NOT IN ('su', 'ua', 'au') AS illegal
  FROM turns),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (again AND NOT blank) AS duplicate, sum(cut)::BIGINT AS truncated, count(*) FILTER (illegal) AS illegal, max(k) AS n
  FROM placed GROUP BY 1),
states AS (
  SELECT conv_id, n + 1 AS k, {{c: 0::BIGINT, a: '', r: []::VARCHAR[]}} AS v0, {{c: 10::BIGINT, a: 'II', r: ['user:', 'assistant:']}} AS vs,
         {{c: 5::BIGINT, a: 'I', r: ['assistant:']}} AS vu, {{c: 0::BIGINT, a: '', r: []::VARCHAR[]}} AS va
  FROM counted
  UNION ALL
  SELECT conv_id, k, {_inserted("0", "u", "vu")}, {_inserted("s", "u", "vu")}, vu, va
  FROM (SELECT conv_id, k, w0, ws, {_inserted("u", "a", "wa")} AS vu, {_inserted("a", "u", "wu")} AS va
        FROM (SELECT p.conv_id, p.k, {", ".join(map(_choices, "0sua"))}
              FROM states s JOIN placed p ON p.conv_id IS NOT DISTINCT FROM s.conv_id AND p.k = s.k - 1)))
SELECT d.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(v0.c, 0)::BIGINT AS cost,
       coalesce(v0.a, '') AS audit, sha256(coalesce(array_to_string(v0.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d
LEFT JOIN counted c ON d.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN states s ON d.conv_id IS NOT DISTINCT FROM s.conv_id AND s.k = 1
"""

OP11 = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

ORACLES |= {"op11_exact_dedup": OP11, "op12_conversation_repair": OP12, "op13_turn_reassembly": OP13}
