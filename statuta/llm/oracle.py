"""DuckDB SQL of the queries of this folder that SQL can express on whole tables."""
from __future__ import annotations

from statuta.llm.decontaminate import CONTAINMENT, SHINGLE
from statuta.llm.line_templates import CONSTANT, FIELD_TOKENS, FIELDS, LEADING, MASK

SQL: dict[str, str] = {}

# --- 3: line templates: each line's templates with one field open, or its very tokens ---------
_LEAST, _OF = CONSTANT
SQL["op3_line_templates"] = f"""WITH l AS (
  SELECT doc_id, generate_subscripts(x, 1) - 1 AS no, unnest(x) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)),
t AS (SELECT doc_id, no, string_split(trim(regexp_replace(line, '[\\x20\\x09-\\x0D]+', ' ', 'g')), ' ') AS raw FROM l),
w AS (SELECT doc_id, no, raw, list_transform(raw, lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '{MASK}' ELSE t END) AS w
      FROM t WHERE raw[1] <> ''),
f AS (SELECT doc_id, no, j, len(w) AS n, w[:{LEADING} + (len(w) - {LEADING}) * j // {FIELDS}] AS head,
        w[{LEADING} + 1 + (len(w) - {LEADING}) * (j + 1) // {FIELDS}:] AS tail
      FROM w, range({FIELDS}) t(j) WHERE len(w) >= {FIELD_TOKENS}),
k AS (SELECT * FROM f WHERE len(list_filter(head || tail, lambda t: t <> '{MASK}')) * {_OF} >= n * {_LEAST}
      UNION ALL SELECT doc_id, no, -1, len(raw), raw, [] FROM w WHERE (doc_id, no) NOT IN (
        SELECT (doc_id, no) FROM f WHERE len(list_filter(head || tail, lambda t: t <> '{MASK}')) * {_OF} >= n * {_LEAST})),
g AS (SELECT j, n, head, tail, min((doc_id, no)) AS first FROM k GROUP BY ALL HAVING min(doc_id) <> max(doc_id)),
candidate AS (SELECT doc_id, no, first FROM k JOIN g USING (j, n, head, tail) WHERE (doc_id, no) <> first),
gone AS (SELECT DISTINCT doc_id, no FROM candidate WHERE first NOT IN (SELECT (doc_id, no) FROM candidate)),
cut AS (SELECT l.doc_id, count(gone.no) AS n_lines_dropped,
          coalesce(string_agg(l.line, chr(10) ORDER BY l.no) FILTER (gone.no IS NULL), '') AS rest
        FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.no = l.no GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN n_lines_dropped > 0 THEN rest ELSE text END AS text,
  CAST(coalesce(n_lines_dropped, 0) AS BIGINT) AS n_lines_dropped
FROM documents d LEFT JOIN cut ON cut.doc_id = d.doc_id"""


# --- 7: shared shingles of every document and item -----------------------------
def _shingles(table: str, key: str) -> str:
    return f"""SELECT DISTINCT {key}, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {SHINGLE} + 2), lambda i: array_to_string(w[i:i + {SHINGLE} - 1], ' ')) END) AS s
  FROM (SELECT {key}, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w
        FROM {table} WHERE {key} IS NOT NULL AND text IS NOT NULL)"""


# runs of words as long as the items of under SHINGLE words
_RUNS = f"""SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS s
  FROM (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w
        FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
    (SELECT DISTINCT len(list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS n FROM benchmark)
  WHERE n BETWEEN 1 AND {SHINGLE - 1} AND len(w) >= n"""
SQL["op7_decontaminate"] = f"""WITH d AS ({_shingles('documents', 'doc_id')} UNION {_RUNS}), b AS ({_shingles('benchmark', 'item_id')}),
n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_shared, n_item, count(*) / n_item AS containment
FROM d JOIN b USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_item
HAVING count(*) * 100 >= n_item * {CONTAINMENT}"""


# --- 8: digests of the turns, and the length of the formatted text --------------
def _escaped(text: str) -> str:
    return rf"regexp_replace({text}, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g')"


SQL["op8_chat_format"] = f"""WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (SELECT *, '<|turn|>' || {_escaped('role')} || '<|body|>' || {_escaped('text')} || '<|end|>' AS seg FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, seg)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, seg) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(seg)) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id"""
