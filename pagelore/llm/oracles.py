"""SQL counterparts of the queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"[^\x20\x09-\x0D]+"

NEAR_COPIES = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN []::VARCHAR[] ELSE regexp_extract_all({_LOWER}, '{_WORDS}') END AS w
  FROM documents
), listed AS (
  SELECT doc_id,
         CASE WHEN len(w) = 0 THEN []::VARCHAR[]
              WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
              ELSE list_distinct(list_transform(range(1, len(w) - 2),
                     lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s
  FROM words
), one AS (SELECT doc_id, unnest(s) AS shingle FROM listed),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n
  FROM one x JOIN one y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN listed p ON p.doc_id = a JOIN listed q ON q.doc_id = b
  WHERE 100 * n >= 80 * (len(p.s) + len(q.s) - n)
), reach AS (
  SELECT doc_id, doc_id AS other FROM listed
  UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
), smallest AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM listed JOIN smallest USING (doc_id)
"""

QUALITY = r"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         string_split(coalesce(text, ''), chr(10)) AS lines
  FROM documents
), windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM split, unnest(range(1, len(w) - 1)) AS u(i)
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM again, unnest([0, 1, 2]) AS u(k) GROUP BY doc_id
), full_lines AS (
  SELECT doc_id, list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS f FROM split
), line AS (
  SELECT doc_id, unnest(f) AS x FROM full_lines
), measured AS (
  SELECT doc_id, x, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS words,
         length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) AS chars,
         len(regexp_extract_all(x, '[#*$%&|<>{}!~^=_\\]')) AS signs,
         len(list_filter(regexp_extract_all(x, '[^\x20\x09-\x0D]+'),
                         lambda s: s IN ('|', '>', '/', '·', '•', '›', '»'))) AS separators
  FROM line
), passing AS (
  SELECT doc_id, sum(chars) AS kept_chars FROM measured
  WHERE NOT (words < 6 AND NOT regexp_matches(x, '[.!?:;…。！？]["''”’»)\]]*[\x20\x09-\x0D]*$'))
    AND 100 * signs <= 10 * chars AND 100 * separators <= 20 * words
    AND NOT (words <= 30 AND regexp_matches(x, '(?i)all rights reserved|terms of (use|service)|privacy policy|cookie'
      || '|javascript|lorem ipsum|newsletter|click here|read more|sign (in|up)|log ?in'
      || '|^[\x20\x09-\x0D]*(©|\(c\)|copyright)'))
  GROUP BY doc_id
), counts AS (
  SELECT s.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(f) - len(list_distinct(f)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(kept_chars, 0) AS BIGINT) AS kept_chars
  FROM split s JOIN full_lines USING (doc_id) LEFT JOIN covered c USING (doc_id) LEFT JOIN passing USING (doc_id)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * kept_chars >= 50 * word_chars AS kept
FROM counts
"""

_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((h // {0}) % 32)::INT, 1)"

# SHA-1 in 8 groups of 5 hex digits; each is four digits of base 32.
WARC = f"""
WITH given AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), grouped AS (
  SELECT page_id, hex, i, ('0x' || substr(hex, 1 + 5 * i, 5))::BIGINT AS h FROM given, unnest(range(8)) AS u(i)
), digest AS (
  SELECT hex, string_agg({" || ".join(_DIGIT.format(32**k) for k in (3, 2, 1, 0))}, '' ORDER BY i) AS payload_digest
  FROM (SELECT DISTINCT hex, i, h FROM grouped) GROUP BY hex
), latest AS (SELECT hex, max(page_id) AS response FROM given GROUP BY hex)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id < response THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < response THEN response END AS refers_to
FROM given JOIN digest USING (hex) JOIN latest USING (hex)
"""

def _level(number: int, parents: tuple[str, ...], name: str, weight: str) -> str:
    """Budgets of one level: the greatest number of scarce children that are exhausted, the rest by weight."""
    group = ", ".join(parents)
    by = f"PARTITION BY {group}" if parents else ""
    using = f"JOIN b{number - 1} USING ({group})" if parents else f"CROSS JOIN b{number - 1}"
    key = ", ".join((*parents, name))
    return f"""
c{number} AS (
  SELECT {key}, CASE WHEN w > 0 THEN room ELSE 0 END AS room, w, budget
  FROM (SELECT {key}, sum(room)::HUGEINT AS room, ({weight})::HUGEINT AS w FROM leaves GROUP BY {key}) {using}
), e{number} AS (
  SELECT *, room * (sum(w) OVER ({by}) - coalesce(sum(w) OVER before, 0))
            <= w * (budget - coalesce(sum(room) OVER before, 0)) AS exhausted
  FROM c{number}
  WINDOW before AS ({by} ORDER BY CASE WHEN w > 0 THEN room::DOUBLE / w::DOUBLE ELSE 0 END, {name}
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), s{number} AS (
  SELECT *, budget - sum(CASE WHEN exhausted THEN room ELSE 0 END) OVER ({by}) AS rest,
         sum(CASE WHEN exhausted THEN 0 ELSE w END) OVER ({by}) AS all_w,
         sum(CASE WHEN exhausted THEN 0 ELSE w END) OVER ({by} ORDER BY {name}) AS to_w
  FROM e{number}
), b{number} AS (
  SELECT {key}, CASE WHEN exhausted THEN room
                ELSE (rest * to_w)::HUGEINT // nullif(all_w, 0)::HUGEINT
                     - (rest * (to_w - w))::HUGEINT // nullif(all_w, 0)::HUGEINT END AS budget
  FROM s{number}
)"""


MIXING = f"""
WITH docs AS (
  SELECT doc_id, coalesce((strlen(text) + 3) // 4, 0) AS n_tokens,
         coalesce('d' || (TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) % 3), '') AS domain,
         coalesce(lang, '') AS language, coalesce(source, '') AS source_name
  FROM documents
), leaves AS (
  SELECT domain, language, source_name, sum(n_tokens)::HUGEINT AS tokens, 3 * sum(n_tokens)::HUGEINT AS room
  FROM docs GROUP BY ALL
), b0 AS (SELECT sum(tokens)::HUGEINT * 70 // 100 AS budget FROM leaves),
{_level(1, (), "domain", "CASE domain WHEN 'd0' THEN 3 WHEN 'd1' THEN 2 ELSE 1 END")},
{_level(2, ("domain",), "language", "CASE language WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END")},
{_level(3, ("domain", "language"), "source_name", "1")},
epochs AS (
  SELECT domain, language, source_name, budget // tokens AS whole, budget % tokens AS rest
  FROM b3 JOIN leaves USING (domain, language, source_name) WHERE budget > 0
), ordered AS (
  SELECT d.*, whole, rest, md5('7:' || whole || ':' || coalesce(doc_id::VARCHAR, '')) AS place
  FROM docs d JOIN epochs USING (domain, language, source_name)
), summed AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY domain, language, source_name ORDER BY place, n_tokens
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS till
  FROM ordered
), cut AS (
  SELECT domain, language, source_name, max(place) AS last FROM summed
  WHERE rest > 0 AND (till <= rest OR (till - n_tokens < rest AND till - rest < rest - (till - n_tokens)))
  GROUP BY ALL
)
SELECT doc_id, CAST(u.e AS INTEGER) AS epoch, n_tokens::BIGINT AS n_tokens, domain, language, source_name
FROM ordered LEFT JOIN cut USING (domain, language, source_name),
     unnest(range((whole + CASE WHEN place <= last THEN 1 ELSE 0 END)::BIGINT)) AS u(e)
"""


def _plus(state: str, cost: str, letter: str) -> str:
    """A way ``state`` (six digits of cost, then the audit) after one more edit; null stays null."""
    return f"lpad((left({state}, 6)::INT + {cost})::VARCHAR, 6, '0') || substr({state}, 7) || {letter}"


def _stays(state: str, role: str) -> str:
    """A way after a turn that is kept as ``role``, or made it."""
    change = f"CASE WHEN t.role1 = '{role}' THEN 0 ELSE 3 END + CASE WHEN t.fault = 't' THEN 3 ELSE 0 END"
    moved = _plus(state, change, f"CASE WHEN t.role1 = '{role}' THEN 'K' ELSE 'R' END")
    return f"CASE WHEN t.fault NOT IN ('b', 'd') THEN {moved} END"


# Ways from the start through four states: nothing yet, after the system turn, a user turn is
# next, an assistant turn is next. Each is its cost and audit as a string, so least() chooses.
REPAIR = rf"""
WITH RECURSIVE crcs AS (
  SELECT list(list_reduce([i::BIGINT] || list_transform(range(8), lambda x: 0::BIGINT),
                          lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)
              ORDER BY i) AS crc
  FROM range(256) AS r(i)
), given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key
  FROM conversations
), kinds AS (
  SELECT given.*, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT),
                                  lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS kind
  FROM given, crcs
), damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM kinds, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS u(copy)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged
), told AS (
  SELECT *, left(role, 1) AS role1,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
              WHEN regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN '-' ELSE 't' END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS role0
  FROM placed
), counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
         count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (i > 1 AND role0 || role1 NOT IN ('su', 'ua', 'au')) AS illegal
  FROM told GROUP BY conv_id
), ways AS (
  SELECT conv_id, 0::BIGINT AS i, '000000' AS s0, NULL::VARCHAR AS s1, NULL::VARCHAR AS s2, NULL::VARCHAR AS s3 FROM counted
  UNION ALL
  SELECT t.conv_id, t.i, {_plus("s0", "4", "'D'")},
         least({_plus("s1", "4", "'D'")},
               CASE WHEN t.fault NOT IN ('b', 'd') AND t.role1 = 's'
                    THEN {_plus("s0", "CASE WHEN t.fault = 't' THEN 3 ELSE 0 END", "'K'")} END),
         least({_plus("r2", "4", "'D'")}, {_stays("r3", "a")}),
         least({_plus("r3", "4", "'D'")}, {_stays("s0", "u")}, {_stays("s1", "u")}, {_stays("r2", "u")})
  FROM (SELECT *, least(s2, {_plus("s3", "3", "'I'")}) AS r2,
               least(s3, {_plus("s0", "3", "'I'")}, {_plus("s1", "3", "'I'")}, {_plus("s2", "3", "'I'")}) AS r3
        FROM ways) w
  JOIN told t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.i = w.i + 1
), best AS (
  SELECT w.conv_id, least(s0, s2, {_plus("s3", "3", "'I'")}) AS way
  FROM ways w JOIN counted c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i
), letters AS (
  SELECT conv_id, k, substr(way, 6 + k, 1) AS letter FROM best, unnest(range(1, length(way) - 5)) AS u(k)
), numbered AS (
  SELECT *, count(*) FILTER (letter <> 'I') OVER w AS i, count(*) FILTER (letter <> 'D') OVER w AS o
  FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY k)
), said AS (
  SELECT x.conv_id, k, o, letter, t.role, t.role1, CASE letter WHEN 'I' THEN '' ELSE t.text END AS text,
         max(CASE WHEN o = 1 AND letter = 'K' AND t.role1 = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY x.conv_id) AS led
  FROM numbered x LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM x.conv_id AND t.i = x.i AND letter <> 'I'
  WHERE letter <> 'D'
), repaired AS (
  SELECT conv_id, string_agg(CASE letter WHEN 'K' THEN role ELSE CASE (o - led) % 2 WHEN 1 THEN 'user' ELSE 'assistant' END END
                             || ':' || text, chr(10) ORDER BY k) AS lines
  FROM said GROUP BY conv_id
)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
       coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(left(way, 6)::BIGINT, 0) AS cost,
       coalesce(substr(way, 7), '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM a.conv_id
"""

ORACLES: dict[str, str] = {
    "op2_quality": QUALITY,
    "op4_warc": WARC,
    "op7_mixing": MIXING,
    "op9_near_copies": NEAR_COPIES,
    "op11_conversation_repair": REPAIR,
}
