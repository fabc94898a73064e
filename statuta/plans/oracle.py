"""DuckDB SQL equal to each catalogue query (tables are pre-registered views)."""
from __future__ import annotations

from statuta.plans import pagesets
from statuta.plans.probes import probe_sql

# Whitespace class of Python's str.split()/strip(), valid in RE2.
WS = r"[\t\n\x0B\f\r\x1C-\x1F\x{85}\p{Z}]"


def py_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+\\z', '', 'g')"


def strip_tags(x: str) -> str:
    return f"regexp_replace({x}, '<.*?>', '', 'g')"


def translate(x: str, frm: str, to: str) -> str:
    return f"translate({x}, {frm}, {to})"


Q = "''''"           # one apostrophe
NL, CR, TAB = "chr(10)", "chr(13)", "chr(9)"

HTML_INPUT = f"(SELECT page_id, html FROM pages UNION ALL {probe_sql('page_id', 'html')})"
DIRTY_INPUT = (f"(SELECT doc_id, replace(text, ' t', '  ' || {NL} || ' t') AS text FROM documents "
               f"UNION ALL {probe_sql('doc_id', 'text')})")


def delete_block(x: str, tag: str, compat: bool) -> str:
    pat = f"<{tag} (.*?)</{tag}>" if compat else f"(?s)<{tag}\\b.*?</{tag}>"
    return py_strip(f"regexp_replace({x}, '{pat}', '', 'g')")


def ten_pass_ws(x: str) -> str:
    for pat, rep in (("'  '", "' '"), (f"' ' || {NL}", NL), (f"{NL} || ' '", NL),
                     (f"{NL} || ' ' || {NL}", NL), (f"{NL} || {NL}", NL)):
        for _ in range(10):
            x = f"replace({x}, {pat}, {rep})"
    return x


SQL: dict[str, str] = {}

SQL["strip_tags_plain"] = f"SELECT page_id, {strip_tags('html')} AS out FROM {HTML_INPUT}"
FIVE_SPACES = "'     '"
SQL["strip_tags_flat"] = (
    f"SELECT page_id, {strip_tags(translate('html', f'{NL}||{CR}||chr(92)||{Q}||chr(34)', FIVE_SPACES))} AS out "
    f"FROM {HTML_INPUT}")
SQL["strip_tags_keep_newlines"] = (
    f"SELECT page_id, {strip_tags(translate('html', f'{CR}||{TAB}||chr(92)||{Q}||chr(34)', FIVE_SPACES))} AS out "
    f"FROM {HTML_INPUT}")
_NO_TAGS = "regexp_replace(html, '<[^>]+>', '', 'g')"
SQL["strip_tags_multiline"] = (
    f"SELECT page_id, translate({py_strip(_NO_TAGS)}, {NL}||{CR}||chr(34), '  ' || {Q}) AS out "
    f"FROM {HTML_INPUT}")
SQL["delete_tag_block"] = (
    f"SELECT page_id, {delete_block('html', 'div', False)} AS div_default, "
    f"{delete_block('html', 'div', True)} AS div_compat, "
    f"{delete_block('html', 'table', False)} AS table_default, "
    f"{delete_block('html', 'table', True)} AS table_compat FROM {HTML_INPUT}")
SQL["normalize_whitespace"] = (
    f"SELECT doc_id, regexp_replace(regexp_replace(text, ' +', ' ', 'g'), ' ?\\n[ \\n]*', {NL}, 'g') AS out_default, "
    f"{ten_pass_ws('text')} AS out_compat FROM {DIRTY_INPUT}")
SQL["collapse_whitespace"] = (
    f"SELECT doc_id, trim(regexp_replace(text, '{WS}+', ' ', 'g')) AS out FROM {DIRTY_INPUT}")
SQL["escape_columns"] = (
    f"SELECT d.doc_id, translate(d.text, {Q}, ' ') AS content, lower(m.source) AS source, "
    f"translate(lower(m.lang), {Q}, ' ') AS lang, 'legal-portal' AS domain "
    f"FROM {DIRTY_INPUT} d LEFT JOIN documents m USING (doc_id)")

# --- BM25 -----------------------------------------------------------------

BM25_CORPUS_DOCS = "SELECT doc_id, text FROM documents"


def bm25_ctes(corpus_sql: str, keys: list[str], queries_sql: str, qkeys: list[str]) -> str:
    k = ", ".join(keys)
    qk = ", ".join(qkeys)
    tk = ", ".join(f"t.{c}" for c in keys)
    qqk = ", ".join(f"q.{c}" for c in qkeys)
    return f"""
    toks AS (SELECT {k}, len(string_split(text, ' ')) AS dl, unnest(string_split(text, ' ')) AS token
             FROM ({corpus_sql})),
    tf AS MATERIALIZED (SELECT {k}, dl, token, count(*) AS tf FROM toks GROUP BY ALL),
    docs AS (SELECT DISTINCT {k}, dl FROM tf),
    n AS MATERIALIZED (SELECT count(*) AS n_docs, sum(dl) AS total_len, sum(dl) / count(*) AS avgdl FROM docs),
    vraw AS MATERIALIZED (SELECT token, count(*) AS df,
                    ln((SELECT n_docs FROM n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw_idf
             FROM tf GROUP BY token),
    vocab AS (SELECT token, df, CASE WHEN raw_idf < 0 THEN 0.25 * (SELECT avg(raw_idf) FROM vraw)
                                     ELSE raw_idf END AS idf FROM vraw),
    qt AS (SELECT {qk}, token, count(*) AS qtf
           FROM (SELECT {qk}, unnest(string_split(text, ' ')) AS token FROM ({queries_sql})) GROUP BY ALL),
    sc AS (SELECT {qqk}, {tk},
                  sum(CAST(round(q.qtf * v.idf * t.tf * (1.5 + 1)
                      / (t.tf + 1.5 * (1 - 0.75 + 0.75 * t.dl / (SELECT avgdl FROM n))) * 1e12) AS BIGINT)) / 1e12 AS score
           FROM qt q JOIN vocab v USING (token) JOIN tf t USING (token) GROUP BY ALL)
    """


SQL["term_frequency"] = """
WITH toks AS (SELECT doc_id, len(string_split(text, ' ')) AS dl, unnest(string_split(text, ' ')) AS token
              FROM documents)
SELECT doc_id, token, count(*) AS tf, dl FROM toks GROUP BY doc_id, dl, token
"""
_BM25_DOCS = bm25_ctes(BM25_CORPUS_DOCS, ["doc_id"], "SELECT item_id, text FROM benchmark", ["item_id"])
SQL["document_frequency"] = f"WITH {_BM25_DOCS} SELECT token, df FROM vocab"
SQL["bm25_idf"] = f"WITH {_BM25_DOCS} SELECT token, round(idf, 6) AS idf FROM vocab"
SQL["corpus_stats"] = f"""WITH {_BM25_DOCS}
SELECT n_docs, CAST(total_len AS BIGINT) AS total_len, round(avgdl, 6) AS avgdl,
       (SELECT count(*) FROM vraw) AS n_terms, round((SELECT avg(raw_idf) FROM vraw), 6) AS mean_idf,
       round(0.25 * (SELECT avg(raw_idf) FROM vraw), 6) AS eps FROM n"""
SQL["bm25_top1"] = f"""WITH {_BM25_DOCS},
best AS (SELECT item_id, doc_id, score,
                row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rn
         FROM sc WHERE score > 0)
SELECT b.item_id, x.doc_id, round(x.score, 6) AS score FROM benchmark b LEFT JOIN (SELECT * FROM best WHERE rn = 1) x USING (item_id)"""

SENTENCES_SQL = """SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS line_no, unnest(l) AS text
FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"""
_BM25_SENT = bm25_ctes(SENTENCES_SQL, ["doc_id", "line_no"], "SELECT item_id, text FROM benchmark", ["item_id"])
SQL["bm25_top15"] = f"""WITH {_BM25_SENT},
ranked AS (SELECT item_id, doc_id, line_no, score,
                  row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, line_no) AS rank
           FROM sc WHERE score > 0)
SELECT item_id, rank, doc_id, line_no, round(score, 6) AS score FROM ranked WHERE rank <= 15"""

# --- statute segmentation ---------------------------------------------------


def art_no(x: str) -> str:
    inner = py_strip(f"replace(split_part(lower({x}), '.', 1), 'điều', '')")
    return f"coalesce(TRY_CAST({inner} AS BIGINT), -1)"


def kind(x: str) -> str:
    return (f"CASE WHEN starts_with({x}, 'Chương') THEN 'chapter' "
            f"WHEN starts_with({x}, 'Điều') AND {art_no(x)} > 0 THEN 'article' ELSE 'body' END")


LINEITEM_STATUTE_LINES = f"""
r AS (SELECT l_orderkey AS law_id, l_linenumber, l_returnflag, l_linestatus, l_shipdate,
             row_number() OVER w AS rn, lag(l_returnflag) OVER w AS prev_flag
      FROM lineitem
      WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
                   l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)),
r2 AS (SELECT *, list_filter([
          CASE WHEN (rn = 1 AND l_returnflag <> 'A') OR (rn > 1 AND l_returnflag <> prev_flag)
               THEN 'Chương ' || l_returnflag END,
          'Điều ' || l_linenumber || '. ' || l_linestatus,
          '  ' || CAST(CAST(l_shipdate AS DATE) AS VARCHAR) || '   ' || l_returnflag,
          CASE WHEN l_linestatus = 'O' THEN '' END], lambda x: x IS NOT NULL) AS l FROM r),
r3 AS (SELECT *, coalesce(sum(len(l)) OVER (PARTITION BY law_id ORDER BY rn
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS base FROM r2),
lines AS (SELECT DISTINCT law_id, CAST(0 AS BIGINT) AS line_no, 'LUẬT  ' || law_id AS raw FROM r
          UNION ALL
          SELECT law_id, CAST(base + generate_subscripts(l, 1) - 1 AS BIGINT) AS line_no, unnest(l) AS raw
          FROM r3)
"""


def segment_sql(compat: bool) -> str:
    body_filter = "chap_seen = 1" if compat else "line <> ''"
    next_join = ("JOIN heads n ON n.law_id = h.law_id AND n.seg = h.seg + 1 AND n.kind = 'article'"
                 if compat else "")
    return f"""WITH {LINEITEM_STATUTE_LINES},
cls AS (SELECT law_id, line_no, raw, trim(regexp_replace(raw, '{WS}+', ' ', 'g')) AS line FROM lines),
cls2 AS (SELECT *, {kind('line')} AS kind FROM cls),
st AS (SELECT *, sum(CASE WHEN kind <> 'body' THEN 1 ELSE 0 END) OVER wl AS seg,
                 max(CASE WHEN kind = 'chapter' THEN 1 ELSE 0 END) OVER wl AS chap_seen
       FROM cls2 WINDOW wl AS (PARTITION BY law_id ORDER BY line_no
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
titles AS (SELECT law_id, raw AS title FROM lines WHERE line_no = 0),
heads AS (SELECT law_id, seg, kind, line, {art_no('line')} AS art_no FROM st WHERE kind <> 'body'),
body AS (SELECT law_id, seg, string_agg(line, chr(10) ORDER BY line_no) AS body, count(*) AS n_body
         FROM st WHERE kind = 'body' AND {body_filter} GROUP BY law_id, seg),
arts AS (SELECT h.law_id, h.seg, h.art_no,
                CASE WHEN coalesce(b.n_body, 0) > 0 THEN t.title || chr(10) || h.line || chr(10) || b.body
                     ELSE t.title || chr(10) || h.line END AS content
         FROM heads h {next_join} JOIN titles t ON t.law_id = h.law_id
         LEFT JOIN body b ON b.law_id = h.law_id AND b.seg = h.seg
         WHERE h.kind = 'article')
SELECT law_id, art_no, law_id || '-' || art_no AS key, CAST(min(seg) AS BIGINT) AS pos,
       arg_max(content, seg) AS content
FROM arts GROUP BY law_id, art_no"""


SQL["articles_reference"] = segment_sql(True)
SQL["articles_all"] = segment_sql(False)

HEADING_LINES = """(SELECT l_orderkey, CASE WHEN l_returnflag = 'A' THEN 'Điều ' || l_linenumber || '. ' || l_linestatus
     WHEN l_returnflag = 'N' THEN 'điều ' || l_linenumber
     ELSE 'Điều ' || l_linenumber || 'a. ' || l_linestatus END AS line FROM lineitem)"""
SQL["article_number"] = f"SELECT line, {art_no('line')} AS art_no, {kind('line')} AS kind FROM {HEADING_LINES}"
SQL["article_keys"] = (f"SELECT l_orderkey, l_orderkey || '-' || {art_no('line')} AS key FROM {HEADING_LINES} "
                       f"WHERE {kind('line')} = 'article'")


def gold_keys_sql(law: str, art: str, compat: bool) -> str:
    law_id = f"split_part({law}, '.', 1)"
    a = f"regexp_replace({art}, '^(\\d+)\\.0+$', '\\1')"
    if compat:
        a = f"CASE WHEN contains({a}, 'Điều') THEN string_split({a}, ' ')[2] ELSE {a} END"
        parts = f"list_transform(string_split({a}, ','), lambda p: {py_strip('p')})"
    else:
        a = f"replace({a}, 'Điều', '')"
        parts = (f"list_filter(list_transform(string_split({a}, ','), lambda p: {py_strip('p')}), "
                 f"lambda p: p <> '')")
    return f"list_transform({parts}, lambda p: {law_id} || '-' || p)"


SQL["gold_labels"] = f"""WITH x AS (
  SELECT l_orderkey || '. LUẬT' AS law,
         CASE WHEN l_returnflag = 'A' THEN CAST(l_linenumber AS VARCHAR)
              WHEN l_returnflag = 'N' THEN 'Điều ' || l_linenumber || ', ' || l_suppkey
              ELSE l_linenumber || '.0' END AS art FROM lineitem)
SELECT law, art, array_to_string({gold_keys_sql('law', 'art', False)}, '|') AS gold_default,
       array_to_string({gold_keys_sql('law', 'art', True)}, '|') AS gold_compat,
       CAST(len({gold_keys_sql('law', 'art', False)}) AS BIGINT) AS n_gold FROM x"""

# --- questions, containment, votes, accuracy ---------------------------------

BQ = """bq0 AS (SELECT item_id, text, string_split(text, ' ') AS w, len(string_split(text, ' ')) AS n FROM benchmark),
bq1 AS (SELECT *, CAST(ceil(n / 2) AS BIGINT) AS h FROM bq0),
bq2 AS (SELECT *, list_slice(w, h + 1, n) AS rest, CAST(ceil((n - h) / 4) AS BIGINT) AS c FROM bq1),
bq AS (SELECT item_id, text, array_to_string(list_slice(w, 1, h), ' ') AS quest,
   CASE WHEN len(list_slice(rest, 1, c)) > 0 THEN array_to_string(list_slice(rest, 1, c), ' ') END AS A,
   CASE WHEN len(list_slice(rest, c + 1, 2 * c)) > 0 THEN array_to_string(list_slice(rest, c + 1, 2 * c), ' ') END AS B,
   CASE WHEN len(list_slice(rest, 2 * c + 1, 3 * c)) > 0 THEN array_to_string(list_slice(rest, 2 * c + 1, 3 * c), ' ') END AS C,
   CASE WHEN len(list_slice(rest, 3 * c + 1, 4 * c)) > 0 THEN array_to_string(list_slice(rest, 3 * c + 1, 4 * c), ' ') END AS D
   FROM bq2),
choices AS (SELECT item_id, CAST(choice_no AS BIGINT) AS choice_no, choice, quest || chr(10) || ctext AS text FROM (
   SELECT item_id, quest, 1 AS choice_no, 'A' AS choice, A AS ctext FROM bq UNION ALL
   SELECT item_id, quest, 2, 'B', B FROM bq UNION ALL
   SELECT item_id, quest, 3, 'C', C FROM bq UNION ALL
   SELECT item_id, quest, 4, 'D', D FROM bq) WHERE ctext IS NOT NULL),
forms AS (SELECT item_id, CAST(0 AS BIGINT) AS choice_no, text FROM benchmark
          UNION ALL SELECT item_id, choice_no, text FROM choices)"""

SQL["choices_expanded"] = f"WITH {BQ} SELECT item_id, choice_no, choice, text FROM choices"

_BM25_FORMS = bm25_ctes(BM25_CORPUS_DOCS, ["doc_id"], "SELECT item_id, choice_no, text FROM forms",
                        ["item_id", "choice_no"])
VOTE = """best AS (SELECT item_id, choice_no, doc_id FROM (
            SELECT *, row_number() OVER (PARTITION BY item_id, choice_no ORDER BY score DESC, doc_id) AS rn
            FROM sc WHERE score > 0) WHERE rn = 1),
tally AS (SELECT item_id, doc_id, count(*) AS votes, min(choice_no) AS first FROM best
          WHERE choice_no > 0 GROUP BY ALL),
win AS (SELECT item_id, doc_id, votes FROM (
          SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY votes DESC, first) AS rn FROM tally)
        WHERE rn = 1),
vote AS (SELECT b.item_id, w.doc_id, coalesce(w.votes, 0) AS votes FROM benchmark b LEFT JOIN win w USING (item_id))"""
SQL["bm25_choice_vote"] = f"WITH {BQ}, {_BM25_FORMS}, {VOTE} SELECT item_id, doc_id, votes FROM vote"

PAIRS = f"""pairs AS (SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)
          WHERE {py_strip('b.text')} <> '')"""
SQL["passage_containment"] = f"WITH {PAIRS} SELECT item_id, doc_id FROM pairs"

SQL["sentence_hits"] = f"""WITH {_BM25_SENT},
ranked AS (SELECT item_id, doc_id, line_no, score,
                  row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, line_no) AS rank
           FROM sc WHERE score > 0),
sl AS ({SENTENCES_SQL}),
top AS (SELECT r.item_id, r.rank, s.text AS stext FROM ranked r JOIN sl s USING (doc_id, line_no) WHERE r.rank <= 15),
hits AS (SELECT t.item_id, d.doc_id, count(*) AS hits, min(t.rank) AS first_rank
         FROM top t JOIN documents d ON contains(d.text, t.stext) WHERE {py_strip('t.stext')} <> '' GROUP BY ALL),
win AS (SELECT item_id, doc_id, hits FROM (
          SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, first_rank, doc_id) AS rn
          FROM hits) WHERE rn = 1)
SELECT b.item_id, w.doc_id, coalesce(w.hits, 0) AS hits FROM benchmark b LEFT JOIN win w USING (item_id)"""

JUDGED = f"""top1 AS (SELECT item_id, choice_no, doc_id FROM best),
preds AS (SELECT 'tf' AS kind, b.item_id, t.doc_id AS pred FROM benchmark b
            LEFT JOIN (SELECT * FROM top1 WHERE choice_no = 0) t USING (item_id)
          UNION ALL SELECT 'mc', item_id, doc_id FROM vote),
{PAIRS},
ng AS (SELECT item_id, count(*) AS n_gold FROM pairs GROUP BY item_id),
judged AS (SELECT p.kind, p.item_id, p.pred, coalesce(ng.n_gold, 0) AS n_gold,
             CASE WHEN coalesce(ng.n_gold, 0) = 1 AND h.doc_id IS NOT NULL THEN 1.0 ELSE 0.0 END AS correct,
             CASE WHEN h.doc_id IS NOT NULL THEN 1.0 ELSE 0.0 END AS any_match
           FROM preds p LEFT JOIN ng USING (item_id)
           LEFT JOIN pairs h ON h.item_id = p.item_id AND h.doc_id = p.pred)"""
ACC = "count(*) AS n, round(avg(correct), 6) AS accuracy, round(avg(any_match), 6) AS any_match"
SQL["retrieval_accuracy"] = f"""WITH {BQ}, {_BM25_FORMS}, {VOTE}, {JUDGED}
SELECT kind, {ACC} FROM judged GROUP BY kind
UNION ALL SELECT 'all' AS kind, {ACC} FROM judged"""
SQL["retrieval_accuracy_by_source"] = f"""WITH {BQ}, {_BM25_FORMS}, {VOTE}, {JUDGED},
src AS (SELECT g.item_id, d.source FROM (SELECT item_id, min(doc_id) AS gold_doc FROM pairs GROUP BY item_id) g
        JOIN documents d ON d.doc_id = g.gold_doc)
SELECT s.source, {ACC} FROM judged j LEFT JOIN src s USING (item_id) GROUP BY s.source"""
SQL["training_set"] = f"""WITH {BQ}, {PAIRS}
SELECT b.item_id, CASE WHEN b.D IS NOT NULL THEN 'Trắc nghiệm' ELSE 'Đúng/Sai' END AS question_type, b.quest,
       b.A, b.B, b.C, b.D, b.A AS answer, a.doc_id, a.article,
       CAST(a.quality AS BIGINT) AS quality, CAST(a.toxic AS BIGINT) AS toxic
FROM bq b LEFT JOIN (
  SELECT p.item_id, p.doc_id, d.text AS article, l.quality, l.toxic FROM pairs p JOIN documents d USING (doc_id)
  LEFT JOIN labels l USING (doc_id)) a USING (item_id)"""


def evaluation_sql(source: str, group: str) -> str:
    """Accuracy of lineitem questions (qid, grp, kind, quest, A, B, C, gold, n_gold) per group."""
    forms = """SELECT qid, CAST(0 AS BIGINT) AS choice_no, quest AS text FROM q WHERE kind = 'tf' UNION ALL
      SELECT qid, unnest([1, 2, 3]) AS choice_no, quest || chr(10) || unnest([A, B, C]) AS text FROM q WHERE kind = 'mc'"""
    ranked = bm25_ctes("SELECT law_id, pos, content AS text FROM art", ["law_id", "pos"], forms, ["qid", "choice_no"])
    return f"""WITH art AS ({segment_sql(False)}), q AS ({source}), {ranked},
best AS (SELECT qid, choice_no, law_id, pos FROM (SELECT *, row_number() OVER (
           PARTITION BY qid, choice_no ORDER BY score DESC, law_id, pos) AS rn FROM sc WHERE score > 0) WHERE rn = 1),
named AS (SELECT b.qid, b.choice_no, a.key FROM best b JOIN art a USING (law_id, pos)),
tally AS (SELECT qid, key, count(*) AS votes, min(choice_no) AS first FROM named GROUP BY ALL),
win AS (SELECT qid, key FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY votes DESC, first) AS rn
        FROM tally) WHERE rn = 1),
judged AS (SELECT q.grp, CASE WHEN w.key = q.gold THEN 1.0 ELSE 0.0 END AS any_match,
             CASE WHEN w.key = q.gold AND q.n_gold = 1 THEN 1.0 ELSE 0.0 END AS correct FROM q LEFT JOIN win w USING (qid))
SELECT {group}{ACC} FROM judged GROUP BY grp"""


_DATED = "l_linestatus || chr(10) || CAST(CAST(l_shipdate AS DATE) + {} AS VARCHAR)"
_QUESTION = f"""CASE WHEN l_linestatus = 'O' THEN 'mc' ELSE 'tf' END AS kind, {_DATED.format(0)} || ' ?' AS quest,
  'là ' || {_DATED.format(1)} AS A, 'là ' || {_DATED.format(0)} AS B, 'là ' || {_DATED.format(2)} AS C,
  l_orderkey || '-' || l_linenumber AS gold"""
SQL["eval_csv"] = evaluation_sql(
    f"SELECT row_number() OVER () AS qid, l_returnflag AS grp, {_QUESTION}, 1 AS n_gold FROM lineitem", "grp AS part, ")
SQL["eval_json"] = evaluation_sql(f"""SELECT row_number() OVER () AS qid, * FROM (SELECT DISTINCT 'all' AS grp, {_QUESTION},
  CASE WHEN l_linenumber IN (5, 6) THEN 2 ELSE 1 END AS n_gold FROM lineitem)""", "")

# --- store, bookmarks, frontier, lookups ------------------------------------

SQL["insert_if_absent_text"] = """WITH d AS (SELECT doc_id, text, lang, n_chars,
    CAST(CASE WHEN lang = 'en' THEN 1 ELSE 2 END AS BIGINT) AS batch FROM documents),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY batch, text ORDER BY doc_id) AS rn FROM d) WHERE rn = 1),
s1 AS (SELECT * FROM f WHERE batch = 1),
s2 AS (SELECT * FROM f WHERE batch = 2 AND text NOT IN (SELECT text FROM s1))
SELECT doc_id, batch, lang, n_chars FROM s1 UNION ALL SELECT doc_id, batch, lang, n_chars FROM s2"""
SQL["insert_if_absent_link"] = """WITH d AS (SELECT doc_id, '/' || source || '/' || lang AS link,
    CAST(CASE WHEN n_chars < 2000 THEN 1 ELSE 2 END AS BIGINT) AS batch FROM documents),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY batch, link ORDER BY doc_id) AS rn FROM d) WHERE rn = 1),
s1 AS (SELECT * FROM f WHERE batch = 1),
s2 AS (SELECT * FROM f WHERE batch = 2 AND link NOT IN (SELECT link FROM s1))
SELECT link, doc_id, batch FROM s1 UNION ALL SELECT link, doc_id, batch FROM s2"""
SQL["seen_links"] = "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)"
SQL["unseen_links"] = "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)"
EV = "(SELECT event_id, ts, user_id, event_type, '/p/' || CAST(floor(value) AS BIGINT) AS link FROM events)"
SQL["visited_append"] = f"SELECT user_id, link, event_id FROM {EV} WHERE event_type = 'view'"
SQL["bookmark_latest"] = f"SELECT user_id, arg_max(link, (ts, event_id)) AS link FROM {EV} GROUP BY user_id"
SQL["bookmark_cleared"] = f"""SELECT user_id, CASE WHEN arg_max(event_type, (ts, event_id)) = 'error' THEN NULL
  ELSE arg_max(link, (ts, event_id)) END AS link FROM {EV} GROUP BY user_id"""
FRONTIER = """WITH RECURSIVE e AS (
  SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem
  UNION SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey FROM lineitem),
walk(node, d) USING KEY (node) AS (
  SELECT 's' || min(l_suppkey) AS node, 0 AS d FROM lineitem
  UNION (SELECT e.dst, min(w.d) + 1 FROM walk w JOIN e ON e.src = w.node
         WHERE e.dst NOT IN (SELECT node FROM recurring.walk) GROUP BY e.dst)),
rounds AS (SELECT node, CAST(d AS BIGINT) AS round FROM walk)"""
SQL["frontier_round"] = f"{FRONTIER} SELECT node, round FROM rounds"
SQL["frontier_reach"] = f"{FRONTIER} SELECT round, count(*) AS n_new FROM rounds GROUP BY round"
SQL["law_lookup"] = """WITH dim AS (SELECT lower(n_name) AS name_key, CAST(n_nationkey + 1 AS BIGINT) AS law_id FROM nation),
fact AS (SELECT c.c_custkey, CASE WHEN c.c_acctbal >= 0 THEN n.n_name ELSE c.c_mktsegment END AS name
         FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey)
SELECT f.c_custkey, f.name, d.law_id, CASE WHEN d.law_id IS NULL THEN 'unknown' ELSE 'ok' END AS status
FROM fact f LEFT JOIN dim d ON lower(f.name) = d.name_key"""
CONVQ = """cq0 AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations
         WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
cq AS (SELECT conv_id, turn,
         CASE WHEN next_role = 'assistant' AND len(string_split(next_text, chr(10))) >= 4 THEN 'Trắc nghiệm'
              WHEN next_role = 'assistant' THEN 'Đúng/Sai' END AS format,
         conv_id || '. LUẬT' AS law, CASE WHEN turn > 0 THEN turn || '.0' END AS art, text AS quest,
         string_split(next_text, chr(10))[1] AS A, string_split(next_text, chr(10))[2] AS B,
         string_split(next_text, chr(10))[3] AS C, string_split(next_text, chr(10))[4] AS D
       FROM cq0 WHERE role = 'user'),
cqf AS (SELECT * FROM cq WHERE format IS NOT NULL AND quest IS NOT NULL AND art IS NOT NULL)"""
SQL["qa_filter"] = f"""WITH {CONVQ} SELECT conv_id, turn, format, law,
  regexp_replace(art, '^(\\d+)\\.0+$', '\\1') AS art, quest FROM cqf"""
SQL["qa_kind_split"] = f"""WITH {CONVQ} SELECT conv_id, turn,
  CASE WHEN format = 'Trắc nghiệm' THEN 'mc' ELSE 'tf' END AS kind,
  array_to_string({gold_keys_sql('law', 'art', False)}, '|') AS gold,
  CASE WHEN format = 'Trắc nghiệm' THEN A END AS A, CASE WHEN format = 'Trắc nghiệm' THEN B END AS B,
  CASE WHEN format = 'Trắc nghiệm' THEN C END AS C, CASE WHEN format = 'Trắc nghiệm' THEN D END AS D
FROM cqf"""
SQL["text_lines"] = f"""SELECT doc_id, line_no, text AS line, CAST(len(string_split(text, ' ')) AS BIGINT) AS n_tokens
FROM ({SENTENCES_SQL})"""
SQL["seed_urls"] = """SELECT CAST(page_id + 4000 AS BIGINT) AS page_no,
  'https://legal.example/search?page=' || CAST(page_id + 4000 AS BIGINT) AS url FROM pages"""
SQL["quarantine_split"] = f"""WITH l AS (SELECT doc_id, CAST(generate_subscripts(s, 1) - 1 AS BIGINT) AS line_no, unnest(s) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM {DIRTY_INPUT}))
SELECT doc_id, line_no, string_split(line, ' ')[1] AS token, TRY_CAST(string_split(line, ' ')[1] AS BIGINT) AS value,
  CASE WHEN TRY_CAST(string_split(line, ' ')[1] AS BIGINT) IS NULL THEN 'quarantine' ELSE 'ok' END AS status FROM l"""
# the text between an opening <p> or <a> and its end, for any attributes and line breaks
HREF_RE = '<a\\s(?:[^>]*?\\s)?href="([^"]*)"'
SQL["page_links"] = f"""SELECT page_id, CAST(generate_subscripts(h, 1) - 1 AS BIGINT) AS pos, unnest(h) AS href
FROM (SELECT page_id, regexp_extract_all(html, '{HREF_RE}', 1) AS h FROM pages)"""
SQL["page_links_absolute"] = f"""SELECT page_id, CAST(generate_subscripts(h, 1) - 1 AS BIGINT) AS pos,
  'https://legal.example/page/' || unnest(h) AS url
FROM (SELECT page_id, regexp_extract_all(html, '{HREF_RE}', 1) AS h FROM pages)"""
SQL["page_links_union"] = f"""SELECT DISTINCT unnest(regexp_extract_all(html, '{HREF_RE}', 1)) AS href FROM pages"""

# a paragraph runs from its start tag to its end, the next paragraph or the next block
P_END = '(?s)(</p>|<(?:article|aside|div|footer|h[1-6]|header|li|main|nav|ol|pre|section|table|ul)[\\s>]|</(?:article|body|div|section|main)>).*'
SQL["paragraphs_merged"] = f"""SELECT page_id, array_to_string(p, ' ') AS content, CAST(len(p) AS BIGINT) AS n_paragraphs
FROM (SELECT page_id, list_transform(string_split_regex(html, '<p(?:\\s[^>]*)?>')[2:],
        lambda x: replace(regexp_replace(regexp_replace(x, '{P_END}', ''), '<.*?>', '', 'g'), '&quot;', '"')) AS p FROM pages)"""

# --- HTML ------------------------------------------------------------------
SQL["element_counts"] = """SELECT page_id, lower(tag) AS tag, count(*) AS n FROM (
  SELECT page_id, unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag FROM pages)
GROUP BY page_id, lower(tag)"""

SQL["stream_insert_if_absent"] = SQL["insert_if_absent_text"]
SQL["stream_resume"] = SQL["insert_if_absent_text"]

# --- pages composed from the tables: expectations come from the source rows ------
SQL |= pagesets.oracles("https://legal.example/page/", "legal-portal", *(
    x.replace("FROM lineitem", "FROM (SELECT * REPLACE (l_suppkey AS l_orderkey) FROM lineitem)")
    for x in (segment_sql(False), LINEITEM_STATUTE_LINES)))


# --- landed pages -----------------------------------------------------------
SQL["snapshot_changes"] = """
WITH a AS (SELECT url, min(html) AS html FROM pages GROUP BY url),
b AS (SELECT url, html || CASE WHEN page_id % 5 = 0 THEN '<p>v3</p>' ELSE '' END AS html FROM pages WHERE page_id % 7 <> 0
      UNION ALL SELECT url || '#new', html FROM pages WHERE page_id % 11 = 0)
SELECT coalesce(a.url, b.url) AS url, CASE WHEN a.url IS NULL THEN 'added' WHEN b.url IS NULL THEN 'removed'
  WHEN a.html <> b.html THEN 'changed' ELSE 'same' END AS change FROM a FULL JOIN b ON a.url = b.url"""
SQL["landed_files"] = """
SELECT page_id, length(h) AS n_chars, sha256(h) AS digest
FROM (SELECT page_id, replace(html, chr(10), ' ') AS h FROM pages WHERE html IS NOT NULL)"""
SQL["url_list_statutes"] = f"""
SELECT row_number() OVER (ORDER BY page_id) AS law_id, text, status FROM ({SQL["main_text"]}) WHERE page_id % 2 = 0 AND status = 'ok'"""
SQL["bookmark_stream"] = SQL["bookmark_cleared"]
