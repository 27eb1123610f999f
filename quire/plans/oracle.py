"""Shared parts of the DuckDB SQL that the queries are held against."""

from quire.functions import chunking
from quire.functions import text as X

DOT = "chr(1)"

CATALOG = """
catalog AS (SELECT doc_id AS id, source AS user_id, 'doc_' || doc_id || '.txt' AS file_name, n_chars::INTEGER AS file_size, 'txt' AS document_type,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS created_at, text FROM documents)"""

#: The encoding steps, of a column t.
NORMAL = r"""regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(t, chr(65279), ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(160), ' '), chr(8203), ''), chr(8204), ''), chr(8205), ''), chr(65533), ''){tabs}, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '\n{{4,}}', chr(10) || chr(10) || chr(10), 'g')"""


def normal(t: str, tabs: bool = True) -> str:
    x = NORMAL.replace("replace(t,", f"replace({t},")
    if tabs:
        return x.format(tabs=", chr(9), ' ')")
    return x.replace("replace(replace(replace(replace(replace(replace(replace(replace(replace(", "replace(replace(replace(replace(replace(replace(replace(replace(", 1).format(tabs="")


HEADING_EN, HEADING_VI, CAPITALS = X.LEGAL_EN, X.LEGAL_VI, X.CAPITALS
NUMBERED = X.NUMBERED.replace(r"(\.", r"(?:\.")  # its groups are numbered otherwise


def heading_level(line: str) -> str:
    """The level of a heading line, null of any other."""
    word = lambda p: f"lower(regexp_extract({line}, '{p}', 1))"
    rest = f"regexp_extract({line}, '{NUMBERED}', 2)"
    dots = f"length(regexp_replace(regexp_extract({line}, '{NUMBERED}', 1), '[^.]', '', 'g'))"
    return f"""CASE WHEN trim({line}) = '' OR length({line}) > 200 THEN NULL
    WHEN regexp_matches({line}, '^#{{1,4}}\\s+.+$') THEN length(regexp_extract({line}, '^(#{{1,4}})\\s', 1))
    WHEN regexp_matches({line}, '{HEADING_VI}') THEN CASE WHEN {word(HEADING_VI)} IN ('chương','phần','bài') THEN 1 WHEN {word(HEADING_VI)} IN ('mục','điều') THEN 2 WHEN {word(HEADING_VI)} IN ('khoản','tiết') THEN 3 ELSE 4 END
    WHEN regexp_matches({line}, '{HEADING_EN}') THEN CASE WHEN {word(HEADING_EN)} IN ('chapter','part','appendix') THEN 1 WHEN {word(HEADING_EN)} IN ('article','section') THEN 2 ELSE 3 END
    WHEN regexp_matches({line}, '{NUMBERED}') AND NOT ends_with({rest}, '.') AND length(regexp_replace({rest}, '[^,]', '', 'g')) <= 2 THEN least({dots} + 1, 4)
    WHEN regexp_matches({line}, '{CAPITALS}') AND NOT contains({line}, ',') AND NOT ends_with({line}, '.') THEN 1 END"""


_CONNECT = f"^({'|'.join(X.CONNECTORS)}) "
NOISE = f"(regexp_matches(t, '{X.PAGE_NUMBER}') OR regexp_matches(t, '{X.PAGE_LABEL}') OR (t <> '' AND length(t) < 3))"

#: lines: (doc_id, i, t, nxt) stripped lines; clean: (doc_id, clean).
CLEAN = (
    f"""
lines AS (SELECT doc_id, i, t, lead(t) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM (
  SELECT doc_id, generate_subscripts(ls, 1) AS i, regexp_replace(unnest(ls), '^\\s+|\\s+$', '', 'g') AS t FROM (SELECT doc_id, string_split({normal('text')}, chr(10)) AS ls FROM documents))),
kept AS (SELECT doc_id, i, t, nxt, count(*) FILTER (t <> '') OVER (PARTITION BY doc_id ORDER BY i) AS g FROM lines WHERE NOT {NOISE}),
capped AS (SELECT *, row_number() OVER (PARTITION BY doc_id, g, t = '' ORDER BY i) AS nth FROM kept),
emitted AS (SELECT doc_id, i, CASE WHEN t = '' THEN chr(10)
  WHEN NOT (regexp_matches(t, '[.!?:;]$') OR length(t) > 80 OR ({heading_level('t')}) IS NOT NULL OR regexp_matches(t, '^[§•]'))
    AND nxt <> '' AND ({heading_level('nxt')}) IS NULL AND (regexp_matches(nxt, '^\\p{{Ll}}') OR regexp_matches(lower(nxt[1:20]), '{_CONNECT}')) THEN t || ' '
  ELSE t || chr(10) END AS e FROM capped WHERE t <> '' OR nth <= 2),
clean AS (SELECT d.doc_id, coalesce(regexp_replace(s.c, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g'), '') AS clean FROM documents d LEFT JOIN (SELECT doc_id, string_agg(e, '' ORDER BY i) AS c FROM emitted GROUP BY doc_id) s USING (doc_id))"""
)

_PROTECT = f"({'|'.join(chunking.ABBREVIATIONS)})"
_marked = "x"
for _c, _n in ((".", 57344), ("!", 57345), ("?", 57346)):
    _marked = f"regexp_replace({_marked}, '{_PROTECT}\\{_c}', '\\1' || chr({_n}), 'g')"
_marked = f"regexp_replace({_marked}, '([.!?])([\\s\"'']|$)', '\\1' || chr(1) || '\\2', 'g')"
for _c, _n in ((".", 57344), ("!", 57345), ("?", 57346)):
    _marked = f"replace({_marked}, chr({_n}), '{_c}')"

#: sents: (doc_id, i from 1, s) of texts that are one section and one paragraph each, as all in these tables are.
SENTENCES = (
    CLEAN
    + f""",
flat AS (SELECT doc_id, {_marked} AS m FROM (SELECT doc_id, trim(regexp_replace(replace(clean, chr(10), ' '), ' {{2,}}', ' ', 'g')) AS x FROM clean WHERE clean <> '')),
pieces AS (SELECT doc_id, CASE WHEN contains(m, chr(1)) THEN list_filter(list_transform(string_split(m, chr(1)), lambda p: trim(p)), lambda p: p <> '') ELSE [m, m] END AS ps FROM flat),
sents AS (SELECT doc_id, generate_subscripts(ps, 1) AS i, unnest(ps) AS s FROM pieces)"""
)

#: wins: (doc_id, w from 0, i, e): windows of sentences i to e, both included; chunks: those long enough.
CHUNKS = (
    SENTENCES
    + """,
sized AS (SELECT doc_id, i, s, length(s) AS l, sum(length(s) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS c, sum(ceil(length(s) / 3.8::DOUBLE)) OVER (PARTITION BY doc_id ORDER BY i) AS tk FROM sents),
ends AS (SELECT a.doc_id, a.i, a.c - a.l - 1 AS c0, coalesce(b.i, n.n) AS j, coalesce(b.c, n.c) - (a.c - a.l - 1) - 1 AS len FROM sized a JOIN (SELECT doc_id, max(i) AS n, max(c) AS c FROM sized GROUP BY doc_id) n ON n.doc_id = a.doc_id
  ASOF LEFT JOIN sized b ON b.doc_id = a.doc_id AND b.c >= a.c - a.l - 1 + 1138),
cut AS (SELECT doc_id, i, CASE WHEN len >= 1901 AND j > i THEN j - 1 ELSE j END AS e FROM ends),
before AS (SELECT doc_id, i + 1 AS k, tk FROM sized UNION ALL SELECT DISTINCT doc_id, 1, 0 FROM sized),
steps AS (SELECT c.doc_id, c.i, c.e, greatest(c.i + 1, b.k) AS nxt FROM cut c JOIN sized s ON s.doc_id = c.doc_id AND s.i = c.e ASOF LEFT JOIN before b ON b.doc_id = c.doc_id AND b.tk >= s.tk - 50),
walk AS (SELECT doc_id, 0 AS w, i, e, nxt FROM steps WHERE i = 1 UNION ALL SELECT s.doc_id, w.w + 1, s.i, s.e, s.nxt FROM walk w JOIN steps s ON s.doc_id = w.doc_id AND s.i = w.nxt),
wins AS (SELECT w.doc_id, w.w, w.i, w.e, array_to_string(list_slice(p.ps, w.i, w.e), ' ') AS body FROM walk w JOIN pieces p USING (doc_id)),
chunks AS (SELECT doc_id AS document_id, (row_number() OVER (PARTITION BY doc_id ORDER BY w) - 1)::INTEGER AS chunk_index, '[General]' || chr(10) || body AS chunk_text, body FROM wins WHERE length(body) >= 149 AND doc_id IN (SELECT doc_id FROM clean WHERE length(clean) >= 152)),
named AS (SELECT document_id, chunk_index, CASE WHEN length(words) > 80 THEN words[1:80] || '…' ELSE words END AS chunk_title, chunk_text, ceil(length(chunk_text) / 3.8::DOUBLE)::INTEGER AS token_count, length(chunk_text)::INTEGER AS char_count
  FROM (SELECT *, array_to_string(list_slice(string_split(body, ' '), 1, 10), ' ') AS words FROM chunks)),
processed AS (SELECT id, user_id, file_name, file_size, document_type, created_at, CASE WHEN error_message IS NULL THEN 'COMPLETED' ELSE 'FAILED' END AS status, coalesce(n, 0)::INTEGER AS chunk_count, error_message FROM (
  SELECT c.*, k.n, CASE WHEN trim(c.text) = '' OR c.text IS NULL THEN 'Extracted text is empty' WHEN length(clean) < 152 THEN 'Text too short after cleaning: ' || length(clean) || ' chars' WHEN k.n IS NULL THEN 'No chunks produced after chunking' END AS error_message
  FROM catalog c JOIN clean ON clean.doc_id = c.id LEFT JOIN (SELECT document_id, count(*) AS n FROM chunks GROUP BY 1) k ON k.document_id = c.id))"""
)


def with_chunks(select: str) -> str:
    return f"WITH RECURSIVE {CATALOG}, {CHUNKS} {select}"


VECTORS = """
vectors AS (SELECT vec_id AS id, text AS content, embedding::DOUBLE[] AS embedding, doc_id::VARCHAR AS m_document_id, source AS m_user_id, CASE WHEN doc_id IS NOT NULL THEN 'doc_' || vec_id || '.txt' END AS m_file_name,
  CASE WHEN label % 2 = 0 THEN array_to_string(list_slice(string_split(text, ' '), 1, 3), ' ') ELSE '' END AS m_title FROM embeddings LEFT JOIN documents ON vec_id = doc_id)"""

SEARCH = (
    VECTORS
    + """,
queries AS (SELECT id AS query_id, embedding AS q FROM vectors WHERE id % 100 = 0),
scored AS (SELECT query_id, vectors.*, round(list_cosine_similarity(embedding, q), 6) AS score FROM queries, vectors),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored WHERE score >= {t} QUALIFY rank <= 5)"""
)
TOPIC = "CASE WHEN trim(coalesce(m_title, '')) <> '' THEN m_title ELSE {name} END"

MESSAGES = """
messages AS (SELECT conv_id AS conversation_id, turn AS id, role, text AS content, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(turn) AS created_at FROM conversations)"""
CONVERSATIONS = """
convs AS (SELECT conv_id AS id, (conv_id % 50)::VARCHAR AS user_id, CASE WHEN conv_id % 3 <> 0 THEN 'chat-' || conv_id END AS chat_id, CASE WHEN conv_id % 2 = 0 THEN 'Chat ' || conv_id ELSE 'New Conversation' END AS title,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(conv_id) AS created_at, count(*) AS n_messages FROM conversations GROUP BY conv_id)"""
