"""Pieces of DuckDB SQL that the oracles share."""

SPACE = r"\s\v\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def words(text: str) -> str:
    return f"regexp_extract_all({text}, '[^{SPACE}]+')"


def word_count(text: str) -> str:
    return f"coalesce(len({words(text)}), 0)"


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def squeeze(text: str) -> str:
    return strip(f"regexp_replace({text}, '[{SPACE}]+', ' ', 'g')")


def newlines(text: str) -> str:
    return rf"regexp_replace({text}, '\r\n?', chr(10), 'g')"


def clean_text(text: str) -> str:
    single = rf"regexp_replace({newlines(text)}, '[ \t]+', ' ', 'g')"
    joined = f"array_to_string(list_transform(string_split({single}, chr(10)), lambda x: {strip('x')}), chr(10))"
    return strip(rf"regexp_replace({joined}, '\n{{3,}}', chr(10) || chr(10), 'g')")


def sentences(text: str) -> str:
    cut = rf"string_split(regexp_replace({text}, '([.!?])[{SPACE}]+', '\1' || chr(1), 'g'), chr(1))"
    return f"list_filter(list_transform({cut}, lambda x: {strip('x')}), lambda x: x <> '')"


def slug(text: str, most: int, fallback: str) -> str:
    own = f"lower(regexp_replace(regexp_replace({text}, '[^a-zA-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'))"
    return f"coalesce(nullif(regexp_replace(left({own}, {most}), '_+$', ''), ''), '{fallback}')"


def fraction(key: str) -> str:
    return f"('0x' || substr(sha256({key}), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE"


def overlap(before: str, after: str, most: int = 30) -> str:
    bare = lambda t: f"list_transform({words(t)}, lambda w: regexp_replace(lower(w), '^[^\\pL\\pN\\pM_]+|[^\\pL\\pN\\pM_]+$', '', 'g'))"
    a, b = bare(before), bare(after)
    return f"coalesce(list_max(list_filter(range(1, least(len({a}), len({b}), {most}) + 1), lambda k: list_slice({a}, len({a}) - k + 1, len({a})) = list_slice({b}, 1, k))), 0)"


def chunks(sections: str, target: int = 450, most: int = 700, least: int = 120, extra: int = 60, keep: bool = False) -> str:
    """CTEs that end in `chunks` (doc_id, chunk_index, text, word_count, split_reason, n_sections) from a query of (doc_id, sec, text).

    The folds are recursions over the pieces, the parts and the packs of a document.
    """
    return f"""
sections AS ({sections}),
counted AS (SELECT *, {word_count("text")} AS n FROM sections),
strings AS (
  SELECT doc_id, sec, k, unnest(s) AS piece, generate_subscripts(s, 1) AS j
  FROM (SELECT doc_id, sec, 0 AS k, {sentences("text")} AS s FROM counted WHERE n > {most})),
sized AS (SELECT *, {words("piece")} AS w FROM strings),
pieces AS (
  SELECT doc_id, sec, row_number() OVER (PARTITION BY doc_id, sec ORDER BY j, off) AS i, txt, n, alone FROM (
    SELECT doc_id, sec, j, 0 AS off, piece AS txt, len(w) AS n, false AS alone FROM sized WHERE len(w) <= {most}
    UNION ALL
    SELECT doc_id, sec, j, off, array_to_string(list_slice(w, off + 1, off + {most}), ' '), len(list_slice(w, off + 1, off + {most})), true
    FROM (SELECT *, unnest(range(0, len(w), {most})) AS off FROM sized WHERE len(w) > {most}))),
fold AS (
  SELECT doc_id, sec, i, 1 AS part, CASE WHEN alone THEN 1000000 ELSE n END AS held FROM pieces WHERE i = 1
  UNION ALL
  SELECT p.doc_id, p.sec, p.i, CASE WHEN p.alone OR f.held + p.n > {most} THEN f.part + 1 ELSE f.part END,
         CASE WHEN p.alone THEN 1000000 WHEN f.held + p.n > {most} THEN p.n ELSE f.held + p.n END
  FROM fold f JOIN pieces p ON p.doc_id = f.doc_id AND p.sec = f.sec AND p.i = f.i + 1),
cut AS (
  SELECT doc_id, sec, part, sum(n)::BIGINT AS n, string_agg(txt, chr(10) || chr(10) ORDER BY i) AS text
  FROM fold JOIN pieces USING (doc_id, sec, i) GROUP BY ALL),
parts AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sec, part) AS i FROM (
    SELECT doc_id, sec, part, n, {strip("text")} AS text, count(*) OVER (PARTITION BY doc_id, sec) > 1 AS is_cut, part = 1 AS opens FROM cut
    UNION ALL SELECT doc_id, sec, 1, n, {strip("text")}, false, true FROM counted WHERE n BETWEEN 1 AND {most})),
packing AS (
  SELECT doc_id, i, 1 AS pack, n AS held, sec FROM parts WHERE i = 1
  UNION ALL
  SELECT p.doc_id, p.i, CASE WHEN fresh THEN pack + 1 ELSE pack END, CASE WHEN fresh THEN p.n ELSE held + p.n END, p.sec
  FROM (SELECT f.*, p, f.held >= {target} OR f.held + p.n > {most} OR ({str(keep).lower()} AND p.opens AND p.sec <> f.sec) AS fresh
        FROM packing f JOIN parts p ON p.doc_id = f.doc_id AND p.i = f.i + 1) x(doc_id, i, pack, held, sec, p, fresh)),
packs AS (
  SELECT doc_id, pack, sum(n)::BIGINT AS n, string_agg(text, chr(10) || chr(10) ORDER BY i) AS text, list(DISTINCT k.sec) AS secs,
         CASE WHEN last(is_cut ORDER BY i) THEN 'split_oversized_section' WHEN count(DISTINCT k.sec) > 1 THEN 'merged_small_sections' ELSE 'single_section' END AS reason
  FROM packing k JOIN parts USING (doc_id, i) GROUP BY ALL),
neighbours AS (SELECT *, lead(n) OVER w AS next, count(*) OVER (PARTITION BY doc_id) AS total FROM packs WINDOW w AS (PARTITION BY doc_id ORDER BY pack)),
judged AS (
  SELECT doc_id, pack, n AS eff, CASE WHEN total = 1 OR n >= {least} THEN 'keep' WHEN n + next <= {most} THEN 'carry' ELSE 'drop' END AS act,
         (total = 1 OR n >= {least})::INT AS kept, CASE WHEN total = 1 OR n >= {least} THEN n ELSE 0 END AS tail FROM neighbours WHERE pack = 1
  UNION ALL
  SELECT doc_id, pack, eff, act, kept + (act = 'keep')::INT, CASE act WHEN 'keep' THEN eff WHEN 'back' THEN tail + eff ELSE tail END
  FROM (SELECT q.doc_id, q.pack, j.kept, j.tail, e AS eff,
               CASE WHEN e >= {least} THEN 'keep' WHEN q.next IS NOT NULL AND e + q.next <= {most} THEN 'carry' WHEN j.kept > 0 AND j.tail + e <= {most} THEN 'back' ELSE 'drop' END AS act
        FROM judged j JOIN neighbours q ON q.doc_id = j.doc_id AND q.pack = j.pack + 1, LATERAL (SELECT q.n + CASE WHEN j.act = 'carry' THEN j.eff ELSE 0 END AS e))),
ends AS (
  SELECT j.doc_id, j.pack, (SELECT min(e.pack) FROM judged e WHERE e.doc_id = j.doc_id AND e.pack >= j.pack AND e.act <> 'carry') AS stop FROM judged j),
best AS (SELECT doc_id, arg_max(pack, eff * 100000 - pack) AS pack FROM judged GROUP BY doc_id HAVING max(kept) = 0),
placed AS (
  SELECT e.doc_id, e.pack, j.kept AS final FROM ends e JOIN judged j ON j.doc_id = e.doc_id AND j.pack = e.stop WHERE j.act IN ('keep', 'back')
  UNION ALL
  SELECT b.doc_id, j.pack, 1 FROM best b JOIN judged j USING (doc_id)
  WHERE j.pack <= b.pack AND NOT EXISTS (FROM judged s WHERE s.doc_id = b.doc_id AND s.pack >= j.pack AND s.pack < b.pack AND s.act <> 'carry')),
final AS (
  SELECT doc_id, final, sum(n)::BIGINT AS n, string_agg(text, chr(10) || chr(10) ORDER BY pack) AS text, list_distinct(flatten(list(secs))) AS secs,
         CASE WHEN count(*) = 1 THEN any_value(reason) WHEN len(list_distinct(flatten(list(secs)))) > 1 THEN 'merged_small_sections'
              WHEN bool_or(reason = 'split_oversized_section') THEN 'split_oversized_section' ELSE 'single_section' END AS reason
  FROM placed JOIN packs USING (doc_id, pack) GROUP BY ALL),
tails AS (
  SELECT *, CASE WHEN {extra} > 0 AND reason = 'split_oversized_section' AND lag(reason) OVER w = 'split_oversized_section'
                 THEN array_to_string({words("lag(text) OVER w")}[-{max(extra, 1)}:], ' ') || chr(10) || chr(10) ELSE '' END AS tail
  FROM final WINDOW w AS (PARTITION BY doc_id ORDER BY final)),
chunks AS (
  SELECT doc_id, (final - 1)::INT AS chunk_index, tail || text AS text, {word_count("tail || text")}::INT AS word_count, reason AS split_reason, len(secs)::INT AS n_sections FROM tails)
"""
