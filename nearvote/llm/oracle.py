"""SQL that gives the rows of those queries that SQL can express, over the same tables."""

from __future__ import annotations

from . import chat
from .license_scan import LEAST, TEMPLATES, WORDS

BLANK = "[^ \\t\\n\\x0B\\f\\r]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def shingles(w: str, k: int) -> str:
    """The k-word shingles of a list of words; fewer words make one shingle, none make none."""
    joined = " || ' ' || ".join(f"{w}[i + {j}]" for j in range(k))
    return f"CASE WHEN len({w}) = 0 THEN [] WHEN len({w}) < {k} THEN [array_to_string({w}, ' ')] ELSE list_transform(range(1, len({w}) - {k} + 2), lambda i: {joined}) END"


def substrings(length: int = 50, step: int = 1000) -> str:
    """Texts as hexadecimal digits, two a byte, cut into pieces first so that each prefix is read from a short string."""
    return f"""WITH d AS MATERIALIZED (SELECT doc_id, hex(coalesce(text, '')) AS h FROM documents),
piece AS (SELECT doc_id, k, substr(h, 2 * k + 1, {2 * (step + length - 1)}) AS part FROM (SELECT *, unnest(range(0, length(h) // 2, {step})) AS k FROM d)),
place AS MATERIALIZED (SELECT doc_id, k + j AS p, substr(part, 2 * j + 1, {2 * length}) AS s FROM (SELECT *, unnest(range(0, least({step}, length(part) // 2 - {length - 1}))) AS j FROM piece)),
first AS (SELECT s, min(doc_id) AS least FROM place GROUP BY s HAVING count(DISTINCT doc_id) > 1),
hit AS (SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS gap FROM place JOIN first USING (s) WHERE least < doc_id),
run AS (SELECT doc_id, p, count(*) FILTER (gap IS NULL OR gap > {length}) OVER (PARTITION BY doc_id ORDER BY p) AS number FROM hit),
gone AS (SELECT doc_id, number, min(p) AS a, max(p) + {length} AS b FROM run GROUP BY doc_id, number),
cut AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM gone),
kept AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS rest FROM cut JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, cast(length(h) // 2 AS bigint) AS n_bytes, cast(coalesce(n_removed, 0) AS bigint) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""


def licenses() -> str:
    known = ", ".join(f"({k}, {quoted(name)}, {quoted(text)})" for k, name, text in TEMPLATES)
    words = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')"
    return f"""WITH t AS (SELECT template_id, license, {words} AS w FROM (VALUES {known}) v(template_id, license, text)),
want AS MATERIALIZED (SELECT DISTINCT template_id, license, len(w) AS size, unnest({shingles('w', WORDS)}) AS s FROM t),
d AS MATERIALIZED (SELECT doc_id, {words} AS w FROM documents),
have AS MATERIALIZED (SELECT DISTINCT doc_id, unnest({shingles('w', WORDS)}) AS s FROM d),
total AS (SELECT template_id, license, count(*) AS n FROM want GROUP BY ALL)
SELECT doc_id, template_id, license, cast(count(*) AS double) / any_value(n) AS containment FROM have JOIN want USING (s) JOIN total USING (template_id, license) GROUP BY doc_id, template_id, license HAVING count(*) >= {LEAST} * any_value(n)"""


def near_copies(words: int = 4, percent: int = 80) -> str:
    return f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BLANK}') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest({shingles('w', words)}) AS s FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS same FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
link AS MATERIALIZED (SELECT a, b FROM pair JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * same >= {percent} * (p.n + q.n - same)),
reach(doc_id, other) AS (SELECT a, b FROM link UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.other),
root AS (SELECT doc_id, min(other) AS least FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(least, doc_id) AS component_id, coalesce(least, doc_id) = doc_id AS kept FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN root USING (doc_id)"""


def conversations(extra: str) -> str:
    def size(x: str) -> str:
        """Characters after escaping: one more for each backslash and control string."""
        return " + ".join([f"length({x})", f"length({x}) - length(replace({x}, chr(92), ''))", *[f"(length({x}) - length(replace({x}, '{c}', ''))) // {len(c)}" for c in chat.CONTROL]])

    marks = sum(map(len, (chat.TURN, chat.TEXT, chat.END)))
    own = ", ".join(f"(-7, {k}, '{role}', {quoted(extra)})" for k, role in enumerate(("user", "assistant")))
    order = "ORDER BY turn NULLS FIRST, role, text"
    said = "CASE WHEN role = 'assistant' THEN text ELSE '' END"
    return f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL VALUES {own}))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256, cast(sum(length({said})) AS bigint) AS loss_chars, sha256(string_agg({said}, '' {order})) AS loss_sha256,
cast({len(chat.CONV)} + sum({marks} + {size('role')} + {size('text')}) AS bigint) AS formatted_chars FROM t GROUP BY conv_id"""
