"""The same queries in plain SQL, over the given tables as views."""

from __future__ import annotations

from pagelore.showcase.inputs import CHAT_SYSTEM, CHUNK_TOKENS, DIM, MODEL, ONEOFF_SYSTEM, VERSION

# White space by code point, and markup patterns with their replacements, in
# order. Written out here too, so that a wrong one of the library shows.
_SPACES = "".join(
    chr(c)
    for c in (9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)
)
_MARKUP = (
    (r"(?s)(\|image.?=.?)?<gallery.*?>.*?</gallery>\\?\n?", ""),
    (r"(?s)\[\[File:.*?\]\]\\?", ""),
    (r"(?s)__.*?__", ""),
    (r"(?s)<!--.*?-->\\?\n?", ""),
    (r"(?s)<span.*?>|</span>\\?\n?|<br.*?>\\?\n?", ""),
    (r"(?s)<div.*?>|</div>\\?\n?", ""),
    (r"'{3,}(.*?)'{3,}", r"\1"),
    (r"\[\[([^\[\]\|]+?)\|([^\[\]]+?)\]\]", r"\2"),
    (r"\[\[(.*?)\]\]", r"\1"),
)
_WS = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_FLAGGED = "The question was flagged by the moderation API"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _trim(column: str) -> str:
    return f"trim({column}, {_text(_SPACES)})"


def _clean(column: str) -> str:
    sql = f"replace({column}, chr(10), ' ')"
    for pattern, replacement in _MARKUP:
        sql = f"regexp_replace({sql}, {_text(pattern)}, {_text(replacement)}, 'g')"
    return f"trim(regexp_replace({sql}, '{_WS}', ' ', 'g'))"


def _tokens(column: str) -> str:
    return f"regexp_extract_all({column}, ' ?[^ ]+| ')"


def _count(column: str) -> str:
    return f"len({_tokens(column)})::INTEGER"


def _clean_pages(pages: str) -> str:
    return f"""
        SELECT page_id, {_trim("replace(title, '_', ' ')")} AS title, {_clean("content")} AS content
        FROM ({pages}) WHERE title <> '' AND content <> '' AND {_clean("content")} <> ''
          AND {_trim("replace(title, '_', ' ')")} <> ''"""


def _chunk(pages: str) -> str:
    n = CHUNK_TOKENS
    return f"""
        SELECT page_id, chunk_no::INTEGER AS chunk_no, n_chunks::INTEGER AS n_chunks,
               CASE WHEN n_chunks > 1 THEN title || ' (' || (chunk_no + 1) || ')' ELSE title END AS title,
               array_to_string(list_slice(tokens, chunk_no * {n} + 1, (chunk_no + 1) * {n}), '') AS content
        FROM (SELECT *, unnest(range(n_chunks)) AS chunk_no FROM
              (SELECT page_id, title, {_tokens("content")} AS tokens,
                      (len({_tokens("content")}) + {n - 1}) // {n} AS n_chunks FROM ({pages})))"""


def _vectors(texts: str) -> str:
    """``id, v`` of hashed words for ``id, text``."""
    return f"""
        SELECT id, list((coalesce(c, 0) / norm)::FLOAT::DOUBLE ORDER BY bucket) AS v
        FROM (SELECT id, norm, bucket FROM
                (SELECT id, sqrt(sum(c * c)) AS norm FROM ({_counts(texts)}) GROUP BY id),
                (SELECT unnest(range({DIM})) AS bucket))
        LEFT JOIN ({_counts(texts)}) USING (id, bucket)
        GROUP BY id"""


def _counts(texts: str) -> str:
    return f"""
        SELECT id, ('0x' || substr(md5(w), 1, 7))::BIGINT % {DIM} AS bucket, count(*) AS c
        FROM (SELECT id, unnest(string_split(text, ' ')) AS w FROM ({texts})) WHERE w <> '' GROUP BY ALL"""


def _ranked(points: str, questions: str) -> str:
    """``question_id, rank, score, id`` from points ``id, v`` and questions ``question_id, v, k``."""
    return f"""
        SELECT question_id, rank::INTEGER AS rank, score, id FROM
          (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS rank FROM
             (SELECT q.question_id, q.k, p.id, round(list_cosine_similarity(q.v, p.v), 6) + 0.0 AS score
              FROM ({questions}) q, ({points}) p))
        WHERE rank <= k"""


def _context(hits: str) -> str:
    return f"""
        SELECT question_id, {_trim("string_agg('Page: ' || title || chr(10) || 'Content: ' || content || repeat(chr(10), 3) || '###' || repeat(chr(10), 3), '' ORDER BY rank)")} AS context
        FROM ({hits}) GROUP BY question_id"""


_DOCUMENT_PAGES = "SELECT doc_id AS page_id, 'Doc_' || doc_id AS title, text AS content FROM documents"
_WEB_PAGES = "SELECT page_id, url AS title, html AS content FROM pages"
_WIKI_PAGES = r"""
    SELECT doc_id AS page_id, ' Doc_' || doc_id || '_' || chr(160) AS title,
           CASE WHEN doc_id % 29 = 3 THEN '__TOC__ <br>' ELSE '__NOTOC__<!-- note -->{{Box|image = <gallery mode=slideshow>a.png|A' || chr(10) || 'b.png</gallery>\'
           || chr(10) || '}}' || repeat(chr(39), 3) || source || repeat(chr(39), 3) || ' is ' || repeat(chr(39), 2)
           || 'in' || repeat(chr(39), 2) || ' [[Lang ' || lang || '|the language]] and [[Plain link]].' || chr(10)
           || '[[File:x.png|thumb|see [[cap]]]]\<br />' || chr(13) || chr(10)
           || '<div class="c"><span style="x">' || text || '</span></div>' || chr(160) || chr(8232) || ' end__TOC__ ' END AS content
    FROM documents"""
_DUMPED_PAGES = f"SELECT page_id, title, replace(content, '\\' || chr(10), chr(10)) AS content FROM ({_WIKI_PAGES})"
_CHUNKS = _chunk(_clean_pages(_DOCUMENT_PAGES))

_STORED_POINTS = """
    SELECT vec_id AS id, 'Doc_' || vec_id AS title, text AS content, embedding::DOUBLE[] AS v
    FROM embeddings JOIN documents ON vec_id = doc_id"""
_STORED_QUESTIONS = """
    SELECT item_id AS question_id, embedding::DOUBLE[] AS v,
           coalesce(CASE WHEN item_id % 4 <> 1 THEN item_id % 9 END, 5) AS k
    FROM benchmark JOIN embeddings ON item_id = vec_id"""
# The mean of all stored vectors as a question.
_MEAN = """
    SELECT 0 AS question_id, 10 AS k, list(m ORDER BY i) AS v FROM
      (SELECT i, avg(embedding[i]::DOUBLE)::FLOAT::DOUBLE AS m
       FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY i)"""
_STORED_HITS = f"""
    SELECT h.question_id, h.rank, h.score, h.id, p.title, p.content
    FROM ({_ranked(_STORED_POINTS, _STORED_QUESTIONS)}) h JOIN ({_STORED_POINTS}) p USING (id)"""

# Every third point twice, under ids that order as those of the table.
_REPEATED_POINTS = f"""
    SELECT md5('["' || id || '","0"]') || copy AS id, title, content, v
    FROM ({_STORED_POINTS}), unnest(range(CASE WHEN id % 3 = 0 THEN 2 ELSE 1 END)) AS u(copy)"""
_CHANGED_PAGES = """
    SELECT doc_id AS page_id, 'Doc_' || doc_id AS title,
           CASE WHEN doc_id % 3 = 0 THEN 'New: ' || text ELSE text END AS content FROM documents"""

# The points of the rebuilt table, under the order of their ids.
_TABLE_POINTS = f"""
    SELECT md5('["' || page_id || '","' || chunk_no || '"]') AS id, title, content FROM ({_CHUNKS})"""

_REQUESTS = f"""
    SELECT item_id AS request_id,
           CASE item_id % 17 WHEN 3 THEN chr(160) || ' ' || chr(10) WHEN 7 THEN NULL ELSE text END AS prompt,
           CASE WHEN item_id % 3 = 0 THEN 'other-model' ELSE 'gpt-4o-mini' END AS model,
           CASE item_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Éloïse M.' WHEN 2 THEN '!?*' WHEN 3 THEN ' ' || chr(160)
                ELSE 'user-' || item_id || '_x y' END AS username,
           CASE WHEN item_id % 6 <> 0 THEN (item_id % 11)::INTEGER END AS max_length,
           coalesce(CASE WHEN item_id % 4 <> 0 THEN item_id % 7 END, 5) AS max_context_length
    FROM benchmark"""
_REASON = f"""
    CASE WHEN prompt IS NULL OR {_trim("prompt")} = '' THEN 'blank_question'
         WHEN max_length = 0 THEN 'zero_max_tokens' END"""


def _outcome(rows: str) -> str:
    """Adds status and error to rows with a reason."""
    return f"""
        SELECT *, CASE WHEN reason IS NULL THEN 'ok' ELSE 'rejected' END AS status,
               CASE reason WHEN 'blank_question' THEN 'The question cannot be empty.'
                    WHEN 'zero_max_tokens' THEN 'The maximum output token count cannot be 0'
                    WHEN 'flagged_input' THEN '{_FLAGGED}' WHEN 'flagged_output' THEN '{_FLAGGED}'
                    WHEN 'malformed_request' THEN 'The request could not be read.'
                    WHEN 'no_user_turn' THEN 'The conversation has no user message.'
                    WHEN 'duplicate_completion' THEN 'There is more than one completion for this request.'
                    WHEN 'no_completion' THEN 'There is no completion for this request.' END AS error
        FROM ({rows})"""


def _gate(rows: str, key: str, flag: str, stage: str) -> str:
    """Rows with a reason, gated by the labels; replaces the reason."""
    return f"""
        SELECT r.* EXCLUDE (reason),
               coalesce(r.reason, CASE WHEN {flag} THEN 'flagged_{stage}' END) AS reason,
               r.reason IS NULL AND l.doc_id IS NOT NULL AS {stage}_moderated
        FROM ({rows}) r LEFT JOIN labels l ON l.doc_id = r.{key}"""


_VALIDATED = f"SELECT *, {_REASON} AS reason FROM ({_REQUESTS})"
_CHECKED = _gate(_VALIDATED, "request_id", "toxic = 1", "input")
_DOC_REQUESTS = f"""
    SELECT doc_id AS request_id, text AS prompt,
           CASE WHEN {_trim("text")} = '' THEN 'blank_question' END AS reason FROM documents"""


def _contexts_for(questions: str) -> str:
    """``question_id, context`` from the rebuilt table for ``question_id, text, k``."""
    points = f"SELECT id, v FROM ({_vectors(f'SELECT id, content AS text FROM ({_TABLE_POINTS})')})"
    vectors = _vectors(f"SELECT question_id AS id, text FROM ({questions})")
    asked = f"SELECT id AS question_id, v, k FROM ({vectors}) JOIN ({questions}) ON id = question_id"
    return _context(
        f"SELECT h.*, p.title, p.content FROM ({_ranked(points, asked)}) h JOIN ({_TABLE_POINTS}) p USING (id)"
    )


_ASKED = f"SELECT request_id AS question_id, prompt AS text, max_context_length AS k FROM ({_CHECKED}) WHERE reason IS NULL"


def _prepared(given: str = "NULL") -> str:
    return f"""
    SELECT c.*, CASE WHEN c.reason IS NULL THEN coalesce({given}, x.context, '') END AS context,
           CASE WHEN c.reason IS NULL THEN {_count("prompt")} END AS question_tokens
    FROM ({_CHECKED}) c LEFT JOIN ({_contexts_for(_ASKED)}) x ON x.question_id = c.request_id"""


_PREPARED = _prepared()


def _completed(rows: str) -> str:
    """Rows with their completion; those with none, or with two, are rejected."""
    return f"""
    SELECT r.* EXCLUDE (reason), CASE WHEN r.reason IS NULL AND c.n = 1 THEN c.completion END AS completion,
           coalesce(r.reason, CASE WHEN c.n = 2 THEN 'duplicate_completion' WHEN c.n IS NULL THEN 'no_completion' END) AS reason
    FROM ({rows}) r LEFT JOIN (
      SELECT item_id AS request_id, CASE WHEN item_id % 13 = 6 THEN 2 ELSE 1 END AS n,
             ' ' || chr(10) || chr(160) || 'In short:  ' || text || chr(10) || ' ' AS completion
      FROM benchmark WHERE item_id % 11 <> 8) c USING (request_id)"""


_CLEAN_NAME = f"""
    CASE WHEN username IS NULL OR {_trim("username")} = '' THEN username
         ELSE regexp_extract(username, '[a-zA-Z0-9_-]+') END"""
_MESSAGES = f"""
    SELECT request_id, 0::INTEGER AS position, 'system' AS role, {_text(ONEOFF_SYSTEM)} AS text, NULL AS participant
    FROM ({_PREPARED}) WHERE reason IS NULL
    UNION ALL
    SELECT request_id, 1, 'user', 'Information:' || chr(10) || context || repeat(chr(10), 3) || '---'
           || repeat(chr(10), 3) || 'Question: ' || prompt || chr(10) || 'Username: '
           || coalesce({_CLEAN_NAME}, 'N/A') || chr(10), upper(sha256({_CLEAN_NAME}))
    FROM ({_PREPARED}) WHERE reason IS NULL"""


def _responses(prepared: str) -> str:
    answered = _outcome(_gate(_completed(prepared), "request_id", "quality = 0", "output"))
    return f"""
    SELECT request_id, status, reason, error,
           CASE WHEN reason IS NULL THEN {_trim("completion")} END AS answer,
           CASE WHEN reason IS NULL THEN context END AS context,
           CASE WHEN reason IS NULL THEN '{VERSION}' END AS version,
           CASE WHEN reason IS NULL THEN question_tokens::VARCHAR END AS question_tokens,
           CASE WHEN reason IS NULL THEN {_count("completion")}::VARCHAR END AS response_tokens
    FROM ({answered})"""


_RESPONSES = _responses(_PREPARED)

_MIXED = """
    SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 6 = 5 OR conv_id % 9 = 4 THEN 'x-' || role ELSE role END AS role, text
    FROM conversations"""
_KNOWN = f"SELECT * FROM ({_MIXED}) WHERE role IN ('system', 'assistant', 'user')"


def _summary(turns: str) -> str:
    return f"""
        SELECT conv_id, min(turn) FILTER (role IN ('system', 'assistant', 'user')) AS first_turn,
               max(turn) FILTER (role IN ('system', 'assistant', 'user')) AS last_turn,
               max(turn) FILTER (role = 'user') AS asked, arg_max(text, turn) FILTER (role = 'user') AS question
        FROM ({turns}) GROUP BY conv_id"""


_CHAT_CHECKED = _gate(
    f"""SELECT *, CASE WHEN asked IS NULL THEN 'no_user_turn' WHEN {_trim("question")} = '' THEN 'blank_question' END AS reason
        FROM ({_summary(_MIXED)})""",
    "conv_id",
    "toxic = 1",
    "input",
)
_LIMITED = _gate(
    f"""SELECT *, CASE WHEN asked IS NULL THEN 'no_user_turn' WHEN {_trim("question")} = '' THEN 'blank_question'
                       WHEN conv_id % 7 = 0 THEN 'zero_max_tokens' END AS reason
        FROM ({_summary(_MIXED)})""",
    "conv_id",
    "toxic = 1",
    "input",
)
_CHAT_OUTCOMES = _outcome(_gate(_CHAT_CHECKED, "conv_id", "quality = 0", "output"))
_CHAT_OK = f"SELECT * FROM ({_CHAT_OUTCOMES}) WHERE status = 'ok'"


def _rewrite(turns: str, asked: str, context: str) -> str:
    return f"""
        SELECT conv_id, first_turn - 1 AS turn, 'system' AS role, {_text(CHAT_SYSTEM)} AS text FROM ({asked})
        UNION ALL
        SELECT t.conv_id, t.turn, t.role, t.text FROM ({turns}) t JOIN ({asked}) a
          ON t.conv_id = a.conv_id AND t.turn <> a.asked
        UNION ALL
        SELECT conv_id, last_turn + 1, 'user',
               'Question: ' || question || repeat(chr(10), 2) || 'Information:' || chr(10) || {context}
        FROM ({asked})"""


_CHAT_CONTEXTS = _contexts_for(f"SELECT conv_id AS question_id, question AS text, 5 AS k FROM ({_CHAT_OK})")
_CHAT_ASKED = f"SELECT * FROM ({_CHAT_OK}) LEFT JOIN ({_CHAT_CONTEXTS}) ON question_id = conv_id"


def _followup(context: str) -> str:
    return f"""
    {_rewrite(_KNOWN, _CHAT_ASKED, context)}
    UNION ALL
    SELECT conv_id, last_turn + 2, 'assistant', 'Reply to ' || conv_id || ' ' FROM ({_CHAT_OK})"""


_FOLLOWUP = _followup("coalesce(context, '')")


def _renumbered(turns: str) -> str:
    return f"""
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, role, text
        FROM ({turns})"""


_CHAT_RESPONSES = f"""
    SELECT o.conv_id, status, reason, error, said AS conversation,
           CASE WHEN reason IS NULL THEN '{VERSION}' END AS version,
           NULL::VARCHAR AS question_tokens, NULL::VARCHAR AS response_tokens
    FROM ({_CHAT_OUTCOMES}) o LEFT JOIN (
      SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS said
      FROM ({_FOLLOWUP}) GROUP BY conv_id) USING (conv_id)"""
# Lines of a stream that cannot be read: every other one tells its id.
_BAD_LINES = """
    SELECT CASE WHEN item_id % 8 = 1 THEN 'bad-' || item_id END AS {key}, 'rejected' AS status,
           'malformed_request' AS reason, 'The request could not be read.' AS error
    FROM benchmark WHERE item_id % 4 = 1"""

_TOTAL = "round(list_sum(embedding::DOUBLE[]), 4)"

ORACLES: dict[str, str] = {
    "clean_pages_html": _clean_pages(_WEB_PAGES),
    "clean_pages_wiki": _clean_pages(_WIKI_PAGES),
    "drop_empty_pages": """
        SELECT doc_id AS page_id, source AS title, text AS content FROM documents
        WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND doc_id % 13 <> 0
          AND source <> '' AND text <> ''""",
    "chunk_documents": f"SELECT page_id, chunk_no, n_chunks, content FROM ({_CHUNKS})",
    "chunk_titles": f"SELECT page_id, chunk_no, title FROM ({_CHUNKS})",
    "chunk_tokens": f"SELECT page_id, chunk_no, {_count('content')} AS tokens FROM ({_CHUNKS})",
    "token_count": f"SELECT doc_id, {_count('text')} AS tokens FROM documents",
    "chunk_by_function": f"""
        SELECT page_id, chunk_no, n_chunks, content, {_count('content')} AS tokens FROM ({_chunk(_DOCUMENT_PAGES)})""",
    "duplicate_chunk_keys": f"""
        SELECT title, count(*) AS n_rows
        FROM ({_chunk('SELECT doc_id AS page_id, source AS title, text AS content FROM documents')})
        GROUP BY title HAVING count(*) > 1""",
    "embed_hashed": f"""
        SELECT id AS doc_id, bucket::INTEGER AS bucket, round((c / norm)::FLOAT, 5)::FLOAT AS weight
        FROM ({_counts('SELECT doc_id AS id, text FROM documents')})
        JOIN (SELECT id, sqrt(sum(c * c)) AS norm
              FROM ({_counts('SELECT doc_id AS id, text FROM documents')}) GROUP BY id) USING (id)""",
    "batch_requests": f"""
        SELECT title AS custom_id, 'POST' AS method, '/v1/embeddings' AS url, content AS input,
               '{MODEL}' AS model FROM ({_CHUNKS})""",
    "batch_results": f"""
        SELECT 'Doc_' || vec_id AS custom_id, len(embedding)::INTEGER AS n_values, {_TOTAL} AS total
        FROM embeddings""",
    "batch_attach": f"""
        SELECT doc_id AS page_id, 'Doc_' || doc_id AS title, text AS content, {_TOTAL} AS total
        FROM documents LEFT JOIN embeddings ON doc_id = vec_id""",
    "batch_missing": """
        SELECT doc_id AS page_id, 'Doc_' || doc_id AS title, text AS content
        FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)""",
    "batch_progress": """
        SELECT count(*) AS total, count(vec_id) AS completed, count(*) = count(vec_id) AS done
        FROM documents LEFT JOIN embeddings ON doc_id = vec_id""",
    "rebuild_points": f"""
        SELECT 'Doc_' || vec_id AS title, text AS content, {_count('text')} AS tokens, {_TOTAL} AS total
        FROM embeddings JOIN documents ON vec_id = doc_id""",
    "snapshot_points": f"SELECT title, content, {_count('content')} AS tokens FROM ({_STORED_POINTS})",
    "batch_import": f"""
        SELECT 'Doc_' || vec_id AS title, text AS content, {_count('text')} AS tokens, {_TOTAL} AS total
        FROM embeddings JOIN documents ON vec_id = doc_id""",
    "build_dataset": f"""
        SELECT title, content, {_count('content')} AS tokens, {DIM}::INTEGER AS n_values
        FROM ({_chunk(_clean_pages(_DUMPED_PAGES))})""",
    "build_dataset_dates": f"""
        WITH chunks AS (
          SELECT title, content FROM ({_CHUNKS}) UNION ALL
          SELECT title, content FROM ({_chunk(_clean_pages(_CHANGED_PAGES))}))
        SELECT title, content, count(*)::INTEGER AS n_points FROM chunks GROUP BY ALL""",
    "topk_repeated": f"""
        SELECT question_id, rank, score, title, content
        FROM ({_ranked(_REPEATED_POINTS, _STORED_QUESTIONS)}) h JOIN ({_REPEATED_POINTS}) p USING (id)""",
    "cosine_score": """
        SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
        FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    "topk_one": f"""
        SELECT rank, score, id, title, content FROM
          ({_ranked(_STORED_POINTS, _MEAN)})
        JOIN ({_STORED_POINTS}) USING (id)""",
    "topk_batch": _ranked(_STORED_POINTS, _STORED_QUESTIONS),
    "topk_clustered": _ranked(_STORED_POINTS, _STORED_QUESTIONS),
    "topk_whole": _ranked(_STORED_POINTS, _MEAN.replace("10 AS k", "1099511627776 AS k")),
    "topk_batch_blocked": _STORED_HITS,
    "context_text": f"""
        SELECT question_id, coalesce(context, '') AS context
        FROM ({_STORED_QUESTIONS}) LEFT JOIN ({_context(_STORED_HITS)}) USING (question_id)""",
    "retrieved_context": f"""
        WITH chunks AS (SELECT page_id || ':' || lpad(chunk_no::VARCHAR, 6, '0') AS id, title, content FROM ({_CHUNKS})),
             p AS ({_vectors('SELECT id, content AS text FROM chunks')}),
             q AS (SELECT id AS question_id, v, 5 AS k FROM ({_vectors('SELECT item_id AS id, text FROM benchmark')})),
             hits AS ({_ranked('SELECT * FROM p', 'SELECT * FROM q')})
        {_context('SELECT hits.*, title, content FROM hits JOIN chunks USING (id)')}""",
    "question_tokens": f"""
        SELECT request_id, {_count('prompt')} AS question_tokens FROM ({_VALIDATED}) WHERE reason IS NULL""",
    "request_lines": f"""
        SELECT request_id::VARCHAR AS request_id, prompt, model, username, max_length, max_context_length,
               FALSE AS parse_error FROM ({_REQUESTS})""",
    "validate_requests": f"SELECT request_id, status, reason, error FROM ({_outcome(_VALIDATED)})",
    "rejected_requests": f"""
        SELECT request_id, prompt, model, status, reason, error FROM ({_outcome(_CHECKED)})
        WHERE status = 'rejected'""",
    "moderate_inputs": f"""
        SELECT request_id, status, reason, error, input_moderated
        FROM ({_outcome(_gate(_DOC_REQUESTS, 'request_id', 'toxic = 1', 'input'))})""",
    "moderate_outputs": f"""
        SELECT request_id, status, reason, error, output_moderated
        FROM ({_outcome(_gate(_DOC_REQUESTS, 'request_id', 'quality = 0', 'output'))})""",
    "moderate_by_function": f"""
        SELECT request_id, status, reason, error, input_moderated FROM ({_outcome(f'''
            SELECT request_id, coalesce(reason, CASE WHEN length(prompt) > 5000 THEN 'flagged_input' END) AS reason,
                   reason IS NULL AS input_moderated FROM ({_DOC_REQUESTS})''')})""",
    "unmoderated": f"""
        SELECT request_id, status, reason, error, FALSE AS input_moderated FROM ({_outcome(_DOC_REQUESTS)})""",
    "usernames": f"""
        SELECT request_id, username, {_CLEAN_NAME} AS clean_name, upper(sha256({_CLEAN_NAME})) AS participant
        FROM ({_REQUESTS})""",
    "oneoff_messages": _MESSAGES,
    "attach_answers": f"""
        SELECT request_id, completion,
               CASE WHEN completion IS NOT NULL THEN {_count('completion')} END AS response_tokens, status, reason, error
        FROM ({_outcome(_completed(_VALIDATED))})""",
    "ask": _RESPONSES,
    "ask_given_context": _responses(
        _prepared("CASE WHEN c.request_id % 2 = 0 THEN 'Known about ' || c.request_id END")
    ),
    "ask_by_function": f"""
        SELECT request_id, status, reason, error,
               CASE WHEN reason IS NULL THEN '2 messages for ' || model || ', at most ' || coalesce(max_length, -1) END AS answer
        FROM ({_outcome(_gate(_CHECKED, "request_id", "quality = 0", "output"))})""",
    "answers_written": _RESPONSES,
    "answer_lines": _RESPONSES,
    "known_roles": _KNOWN,
    "nested_turns": _renumbered("SELECT * FROM conversations"),
    "conversation_lines": f"""
        SELECT conv_id::VARCHAR AS conv_id, turn, role, text
        FROM ({_renumbered("SELECT * FROM conversations")})""",
    "last_user_turn": f"""
        SELECT conv_id, asked AS turn, question AS text,
               CASE WHEN asked IS NULL THEN 'no_user_turn' ELSE 'ok' END AS status FROM ({_summary(_MIXED)})""",
    "followup_rewrite": _rewrite(
        "SELECT * FROM conversations",
        f"SELECT * FROM ({_summary('SELECT * FROM conversations')}) WHERE asked IS NOT NULL",
        "'Context of ' || conv_id",
    ),
    "append_reply": """
        SELECT * FROM conversations UNION ALL
        SELECT conv_id, max(turn) + 1, 'assistant', 'Reply to ' || conv_id || ' ' FROM conversations GROUP BY conv_id""",
    "followup": _FOLLOWUP,
    "followup_given_context": _followup(
        "CASE WHEN conv_id % 2 = 0 THEN 'Known about ' || conv_id ELSE coalesce(context, '') END"
    ),
    "followup_outcomes": f"""
        SELECT conv_id, status, reason, error, input_moderated, output_moderated FROM ({_CHAT_OUTCOMES})""",
    "followup_payloads": _renumbered(_FOLLOWUP),
    "followup_by_function": f"""
        SELECT conv_id, status, reason, error, CASE WHEN reason IS NULL THEN
                 (n + 1) || ' messages for None, at most ' || (conv_id % 7) END AS reply
        FROM ({_outcome(_gate(_LIMITED, "conv_id", "quality = 0", "output"))})
        LEFT JOIN (SELECT conv_id, count(*) AS n FROM ({_KNOWN}) GROUP BY conv_id) USING (conv_id)""",
    "chat_answer_lines": _CHAT_RESPONSES,
    "followup_rows_by_function": f"""
        SELECT conv_id, status, reason, error,
               CASE WHEN reason IS NULL THEN (n + 1) || ' messages for None, at most ' || (conv_id % 7) END AS reply,
               CASE WHEN reason IS NULL THEN (n + 2)::INTEGER END AS n_turns
        FROM ({_outcome(_gate(_LIMITED, "conv_id", "quality = 0", "output"))})
        LEFT JOIN (SELECT conv_id, count(*) AS n FROM ({_KNOWN}) GROUP BY conv_id) USING (conv_id)""",
    "stream_ask": f"""
        SELECT request_id::VARCHAR AS request_id, * EXCLUDE (request_id) FROM ({_RESPONSES})
        UNION ALL BY NAME {_BAD_LINES.format(key="request_id")}""",
    "stream_followup": f"""
        SELECT conv_id::VARCHAR AS conv_id, * EXCLUDE (conv_id) FROM ({_CHAT_RESPONSES})
        UNION ALL BY NAME {_BAD_LINES.format(key="conv_id")}""",
    "wiki_current_text": """
        SELECT 'Doc_' || doc_id AS page_title, text AS content FROM documents
        WHERE doc_id % 5 IN (0, 4) AND doc_id % 7 <> 0 AND doc_id % 11 <> 0""",
    "dump_roundtrip": f"SELECT title, content FROM ({_DUMPED_PAGES})",
    "dump_in_blocks": f"SELECT title, content FROM ({_DUMPED_PAGES})",
}
