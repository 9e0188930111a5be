"""SQL of those queries that it can express over whole tables."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(pattern: str, text: str = "text") -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{pattern}')"


NEARDUP = f"""WITH RECURSIVE d AS (SELECT doc_id, {_words('[^ \\t\\n\\x0B\\f\\r]+')} AS w FROM documents),
 s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda p: w[p] || ' ' || w[p + 1] || ' ' || w[p + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
 n AS (SELECT doc_id, len(g) AS n FROM s), e AS (SELECT doc_id, unnest(g) AS sh FROM s),
 p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM e a JOIN e b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
 l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 85 * (a.n + b.n - shared)),
 u AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
 r(doc_id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT u.y, r.root FROM r JOIN u ON u.x = r.doc_id)
 SELECT n.doc_id, n.n AS n_shingles, min(root) AS component_id, n.doc_id = min(root) AS kept FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n.n"""

_ALNUM = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
DECONTAMINATION = f"""WITH d AS (SELECT doc_id, {_words(_ALNUM)} AS w FROM documents), i AS (SELECT item_id, {_words(_ALNUM)} AS w FROM benchmark),
 t AS (SELECT item_id, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda p: array_to_string(w[p:p + least(len(w), 10) - 1], ' '))) AS g FROM i WHERE len(w) > 0),
 ns AS (SELECT DISTINCT n FROM t), q AS (SELECT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda p: {{'p': p, 'g': array_to_string(w[p:p + n - 1], ' ')}})) AS x FROM d, ns WHERE len(w) >= n),
 m AS (SELECT q.doc_id, q.x.p AS p, q.n AS n, t.item_id FROM q JOIN t ON t.n = q.n AND t.g = q.x.g),
 h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS k FROM m) GROUP BY doc_id),
 c AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM m GROUP BY doc_id)
 SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN c USING (doc_id)"""


#: Kind, pattern, group whose length counts, and the least length: the three base kinds as the contract states them (of hexadecimal runs those
#: long enough alone, which are the same), then the further formats.
SECRETS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("google", r"AIza[0-9A-Za-z_-]{35}", 0, 1),
)
BASE_KINDS = ("assign", "access", "hex")


def _secrets() -> str:
    parts = []
    for place, (kind, written, group, least) in enumerate(SECRETS):
        pattern = written.replace("'", "''")
        parts.append(
            f"""SELECT doc_id, {place} AS place, '{kind}' AS kind, unnest(list_transform(range(1, len(m) + 1), lambda k: {{'s': list_sum(list_transform(p[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0), 'n': length(m[k]), 'g': length(c[k])}})) AS x
 FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}', 0) AS m, regexp_extract_all(text, '{pattern}', {group}) AS c, regexp_split_to_array(text, '{pattern}') AS p FROM documents WHERE regexp_matches(text, '{pattern}')) WHERE {least} > 0"""
        )
    shortest = "CASE kind " + " ".join(f"WHEN '{kind}' THEN {least}" for kind, _, _, least in SECRETS) + " END"
    line = "kind || ':' || x.s::BIGINT || ':' || (x.s + x.n)::BIGINT"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE_KINDS)
    return f"""WITH a AS ({' UNION ALL '.join(parts)}), b AS (SELECT * FROM a WHERE x.g >= {shortest}),
 g AS (SELECT doc_id, {counts}, string_agg(CASE WHEN place < {len(BASE_KINDS)} THEN {line} END, ',' ORDER BY x.s, place) AS base, string_agg({line}, ',' ORDER BY x.s, place) AS spans FROM b GROUP BY doc_id)
 SELECT d.doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in BASE_KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents d LEFT JOIN g USING (doc_id)"""


def _conversations() -> str:
    blanks = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    state = lambda x, cost, letter, text="''": f"CASE WHEN {x} IS NOT NULL THEN {{'c': {x}.c + {cost}, 'a': {x}.a || '{letter}', 't': {x}.t || {text}}} END"
    line = lambda role, text="''": f"(chr(10) || {role} || ':' || {text})"
    least = lambda *x: f"least({', '.join(x)})"
    extra = "(CASE WHEN cut THEN 3 ELSE 0 END)"
    kept = lambda x, initial: f"CASE WHEN stays AND initial = '{initial}' THEN {state(x, extra, 'K', line('role', 'text'))} END"
    reroled = lambda x, role: f"CASE WHEN stays THEN {state(x, f'{extra} + 3', 'R', line(repr(role), 'text'))} END"
    dropped = lambda x: state(x, 4, "D")
    after_u = least("u", *(state(x, 3, "I", line("'user'")) for x in "esa"))
    after_a = least("a", state("iu", 3, "I", line("'assistant'")))
    new_u = least(dropped("u"), *(f(x, r) for x in ("e", "s", "ia") for f, r in ((kept, "u"), (reroled, "user"))))
    return f"""WITH RECURSIVE b AS (SELECT list(list_reduce([i::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) q(i)),
 o AS (SELECT coalesce(conv_id::VARCHAR, ' ') AS conv, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations),
 k AS (SELECT o.*, xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(conv || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::UBIGINT)), lambda c, x: xor(c >> 8, tab[((xor(c, x) & 255) + 1)::BIGINT])), 4294967295::UBIGINT) % 20 AS kind FROM o, b),
 d AS (SELECT conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE kind <> 0),
 p AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, sha256(text)) AS pos, rtrim(text, {blanks}) AS body FROM d),
 f AS (SELECT *, length(body) = 0 AS blank, length(body) > 0 AND right(body, 1) NOT IN ('.', '!', '?') AS cut, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv, role, text ORDER BY pos) > 1 AS seen, lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY pos) AS before FROM p),
 g AS (SELECT *, NOT blank AND NOT seen AS stays FROM f),
 r(conv, pos, e, s, u, a) AS (SELECT DISTINCT conv, 0::BIGINT, {{'c': 0::BIGINT, 'a': '', 't': ''}}, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR), NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR), NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) FROM g
  UNION ALL SELECT conv, pos, {dropped('e')}, {least(dropped('s'), kept('e', 's'))}, {new_u}, {least(dropped('a'), kept('iu', 'a'), reroled('iu', 'assistant'))}
  FROM (SELECT *, {after_a} AS ia FROM (SELECT g.*, e, s, u, a, {after_u} AS iu FROM r JOIN g ON g.conv = r.conv AND g.pos = r.pos + 1))),
 n AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (seen AND NOT blank) AS duplicate, count(*) FILTER (cut AND NOT seen) AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS pos FROM g GROUP BY conv),
 z AS (SELECT conv, {least('e', 'ia')} AS best FROM (SELECT *, {after_a} AS ia FROM (SELECT r.*, {after_u} AS iu FROM r JOIN n ON n.conv = r.conv AND n.pos = r.pos)))
 SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.t, 2), '')) AS repaired_sha256
 FROM (SELECT DISTINCT conv, conv_id FROM o) i LEFT JOIN n ON n.conv = i.conv LEFT JOIN z ON z.conv = i.conv"""


ORACLE_SQL = {"op1_neardup": NEARDUP, "op2_decontamination": DECONTAMINATION, "op6_secrets": _secrets(), "op11_conversations": _conversations()}
