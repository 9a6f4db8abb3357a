"""DuckDB SQL for the queries that SQL can express over whole tables."""

OP9 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), ordered AS (
  SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after_role,
         lead(1) OVER w IS NULL AS is_last
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id,
  count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(10 + length(role) + length(text) + length(regexp_replace(role || text, '[^<\[\\]', '', 'g'))) AS BIGINT) AS formatted_chars,
  bool_and(CASE
    WHEN before IS NULL THEN role IN ('system', 'user')
    WHEN before = 'system' THEN role = 'user'
    WHEN before = 'user' THEN role = 'assistant'
    WHEN before = 'assistant' THEN role = 'user'
    ELSE false END AND (NOT is_last OR role = 'assistant')) AS valid
FROM ordered GROUP BY conv_id
"""

#: Least id that links reach, over links(a, b) in both directions.
REACH = """reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least_id AS (SELECT a, min(b) AS b FROM reach GROUP BY a)"""

OP5 = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), sound AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM sound x JOIN sound y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.98
), {REACH}, degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(l.b, vec_id)) AS component_id, vec_id <= coalesce(l.b, vec_id) AS kept
FROM v LEFT JOIN degree d ON d.a = vec_id LEFT JOIN least_id l ON l.a = vec_id
"""

OP6 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), starts AS (
  SELECT doc_id, words, unnest(range(greatest(len(words) - 4, 1))) AS i FROM w WHERE len(words) > 0
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(words[i + 1:i + 5], ' ') AS shingle FROM starts
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c.n >= 75 * (x.n + y.n - c.n)
), {REACH}
SELECT w.doc_id, coalesce(s.n, 0) AS n_shingles, least(w.doc_id, coalesce(l.b, w.doc_id)) AS component_id, w.doc_id <= coalesce(l.b, w.doc_id) AS kept
FROM w LEFT JOIN sizes s ON s.doc_id = w.doc_id LEFT JOIN least_id l ON l.a = w.doc_id
"""

OP8 = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(words[i + 1:i + 35], ' ') AS passage
  FROM (SELECT doc_id, words, unnest(range(len(words) - 34)) AS i FROM w WHERE len(words) >= 35)
), repeated AS (
  SELECT doc_id, i FROM windows WHERE passage IN (SELECT passage FROM windows GROUP BY passage HAVING count(*) > 1)
), gone AS (
  SELECT DISTINCT doc_id, i + k AS i FROM repeated, range(35) AS t(k)
), each AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS i FROM w
), marked AS (
  SELECT e.*, g.i IS NOT NULL AS gone FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.i = e.i
), kept AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS text FROM marked GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM w LEFT JOIN kept k USING (doc_id)
"""

ORACLE: dict[str, str] = {
    "op5_embedding_dedup": OP5,
    "op6_minhash": OP6,
    "op8_substring": OP8,
    "op9_chat_format": OP9,
}
