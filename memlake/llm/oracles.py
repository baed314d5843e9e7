"""DuckDB SQL for what SQL can say of these operators: pairs and components, and all columns that exact rules fix."""

from __future__ import annotations

#: A-Z only, as the operators lower-case.
_LOWER = "translate(coalesce({x}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Links l(x, y) in both directions between the ids of n(id) to the smallest id reachable.
_REACH = "r AS (SELECT id AS x, id AS y FROM n UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y), c AS (SELECT x AS id, min(y) AS component_id FROM r GROUP BY 1)"

VECTORS = f"""WITH RECURSIVE v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), n AS (SELECT DISTINCT id FROM v),
 g AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda z: z IS NULL OR NOT isfinite(z))) = 0 AND len(list_filter(e, lambda z: z <> 0)) > 0),
 l AS (SELECT a.id AS x, b.id AS y FROM g a JOIN g b ON a.label = b.label AND a.id <> b.id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93), {_REACH}
 SELECT v.id AS vec_id, (SELECT count(*) FROM l WHERE l.x = v.id) AS n_links, component_id, v.id = component_id AS kept FROM v JOIN c ON c.id = v.id"""

DOCUMENTS = f"""WITH RECURSIVE w AS (SELECT doc_id AS id, regexp_extract_all({_LOWER.format(x='text')}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
 s AS (SELECT id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM w), n AS (SELECT id, len(s) AS k FROM s),
 u AS (SELECT id, unnest(s) AS h FROM s), p AS (SELECT a.id AS x, b.id AS y, count(*) AS c FROM u a JOIN u b ON a.h = b.h AND a.id <> b.id GROUP BY 1, 2),
 l AS (SELECT x, y FROM p JOIN n a ON a.id = x JOIN n b ON b.id = y WHERE 100 * c >= 85 * (a.k + b.k - c)), {_REACH}
 SELECT n.id AS doc_id, k AS n_shingles, component_id, n.id = component_id AS kept FROM n JOIN c ON c.id = n.id"""


def _spans(name: str, kind: str, rank: int, pattern: str, good: str) -> str:
    """(id, kind, rank, m, a, b) of the matches in t(id, t) that are good. A match begins after the gaps and matches before it."""
    return f"""{name}0 AS (SELECT id, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS g FROM t WHERE regexp_matches(t, '{pattern}')),
 {name}1 AS (SELECT id, unnest(m) AS m, unnest(g[1:len(m)]) AS g, generate_subscripts(m, 1) AS i FROM {name}0),
 {name}2 AS (SELECT id, m, sum(len(g) + len(m)) OVER (PARTITION BY id ORDER BY i) AS b FROM {name}1),
 {name} AS (SELECT id, '{kind}' AS kind, {rank} AS rank, m, CAST(b - len(m) AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM {name}2 WHERE {good})"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum([CASE WHEN (len(d) - i) % 2 = 0 THEN CAST(d[i] AS INT) ELSE CAST(d[i] AS INT) * 2 - 9 * CAST(CAST(d[i] AS INT) > 4 AS INT) END FOR i IN range(1, len(d) + 1)]) % 10 = 0"
_PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "TRUE"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda z: len(ltrim(z, '0')) > 3 OR CAST('0' || substring(ltrim(z, '0'), 1, 3) AS INT) > 255)) = 0"),
    ("card", r"[0-9]([\x20-]?[0-9])+", f"len({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN.replace('d[i]', _DIGITS + '[i]').replace('len(d)', f'len({_DIGITS})')}"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"len({_DIGITS}) BETWEEN 9 AND 15"),
]
_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_SECRETS = [
    ("assign", _ASSIGN, f"len(regexp_extract(m, '{_ASSIGN}', 1)) >= 8"),
    ("access", "AKIA[A-Z0-9]+", "len(m) >= 16"),
    ("hex", "[0-9a-f]+", "len(m) >= 32"),
]


def _base(rules: list[tuple[str, str, str]], order: str) -> str:
    names = [f"k{i}" for i in range(len(rules))]
    parts = ",\n ".join(_spans(n, kind, i, pattern, good) for n, (i, (kind, pattern, good)) in zip(names, enumerate(rules)))
    counts = ", ".join(f"count_if(rank = {i}) AS n_{kind}" for i, (kind, _, _) in enumerate(rules))
    every = " UNION ALL ".join(f"SELECT * FROM {n}" for n in names)
    return f"""WITH t AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
 {parts}, s AS (SELECT id, {counts}, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY {order}) AS spans FROM ({every}) GROUP BY 1)
 SELECT doc_id, {', '.join(f'CAST(coalesce(n_{kind}, 0) AS BIGINT) AS n_{kind}' for kind, _, _ in rules)}, sha256(coalesce(spans, '')) AS base_sha256 FROM t LEFT JOIN s USING (id)"""


PII = _base(_PII, "rank, a")
SECRETS = _base(_SECRETS, "a, rank")

_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def _places(phrase: str) -> str:
    words = phrase.split()
    return f"[i FOR i IN range(0, len(w)) IF w[i + 1:i + {len(words)}] = [{', '.join(repr(x) for x in words)}]]"


LICENCES = f"""WITH w AS (SELECT doc_id, regexp_extract_all({_LOWER.format(x='text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
 p AS (SELECT doc_id, len(w) AS n_words, {', '.join(f"{_places(x)} AS p{i}" for i, x in enumerate(_PHRASES))} FROM w), a AS (SELECT *, p0 || p1 || p2 AS p FROM p)
 SELECT doc_id, n_words, len(p) AS n_base, list_min(p) AS first_word, list_max(p) AS last_word, array_to_string(list_sort(list_filter([{', '.join(f"CASE WHEN len(p{i}) > 0 THEN '{v}' END" for i, v in enumerate(_PHRASES.values()))}], lambda z: z IS NOT NULL)), ',') AS base_labels FROM a"""

_LE32 = lambda x: "||".join(f"printf('%02x', ({x} >> {8 * i}) & 255)" for i in range(4))
MEDIA = f"""WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents), n AS (SELECT *, octet_length(b) AS n, greatest(1, (octet_length(b) + 63) // 64) * 64 AS m FROM t),
 p AS (SELECT doc_id, n, m, b || unhex(repeat('00', CAST(m - n AS BIGINT))) AS p FROM n),
 h AS (SELECT *, unhex('52494646' || {_LE32('(36 + m)')} || '57415645666d7420' || '10000000' || '0100' || '0100' || '401f0000' || '401f0000' || '0100' || '0800' || '64617461' || {_LE32('m')}) || p AS media FROM p)
 SELECT doc_id, n AS n_bytes, m AS payload_bytes, sha256(p) AS payload_sha256, octet_length(media) AS media_bytes, sha256(media) AS media_sha256 FROM h"""

# Conversations: a shortest path over (row, state), whose values (c: cost, a: audit, r: repaired lines) are compared as they stand.

_CRC = "xor(list_reduce([4294967295] || [CAST(ascii(x) AS BIGINT) FOR x IN string_split({k}, '')], lambda c, b: list_reduce([xor(c, b)] || CAST(range(8) AS BIGINT[]), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295)"


def _edit(v: str, cost: str, letter: str, line: str | None = None, when: str = "TRUE") -> str:
    return f"CASE WHEN {v} IS NOT NULL AND {when} THEN {{'c': {v}.c + {cost}, 'a': {v}.a || '{letter}', 'r': {v}.r{f' || [{line}]' if line else ''}}} END"


def _states(x: str, *cells: list[str]) -> str:
    return ", ".join(f"list_min([{', '.join(c)}]) AS {x}{i}" for i, c in enumerate(cells))


_PUT = lambda v, *roles: _edit(v, str(5 * len(roles)), "I" * len(roles), ", ".join(f"'{r}:'" for r in roles))
_INSERTED = _states("w", ["v0"], ["v1"], ["v2", *(_PUT(v, "user") for v in ("v0", "v1", "v3"))], ["v3", _PUT("v2", "assistant"), *(_PUT(v, "user", "assistant") for v in ("v0", "v1"))])
_D = lambda v: _edit(v, "2", "D")
_K = lambda v, role: _edit(v, "more", "K", "role || ':' || text", f"NOT gone AND left(role, 1) = '{role}'")
_R = lambda v, role: _edit(v, "1 + more", "R", f"'{role}:' || text", "NOT gone")
_EDITED = _states("v", [_D("w0")], [_D("w1"), _K("w0", "s")], [_D("w2"), *(e for v in ("w0", "w1", "w3") for e in (_K(v, "u"), _R(v, "user")))], [_D("w3"), _K("w2", "a"), _R("w2", "assistant")])
_KEY = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"

TURNS = f"""WITH RECURSIVE ids AS (SELECT conv_id, row_number() OVER () AS k FROM (SELECT DISTINCT conv_id FROM conversations)),
 s AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC.format(k=_KEY)} % 20 AS fault FROM conversations),
 d AS (SELECT k, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE fault WHEN 3 THEN 2 ELSE 1 END)) AS again FROM s JOIN ids ON s.conv_id IS NOT DISTINCT FROM ids.conv_id WHERE fault <> 0),
 o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text, again) AS i FROM d),
 f AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 AS met,
  regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') AS ends, lag(left(role, 1)) OVER (PARTITION BY k ORDER BY i) || left(role, 1) AS pair FROM o),
 g AS (SELECT k, i, role, text, blank OR met AS gone, CASE WHEN ends THEN 5 ELSE 0 END AS more FROM f),
 p AS (SELECT k, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 'a': '', 'r': CAST([] AS VARCHAR[])}} AS v0, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, r VARCHAR[])) AS v1, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, r VARCHAR[])) AS v2,
  CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, r VARCHAR[])) AS v3 FROM ids
  UNION ALL SELECT k, i, {_EDITED} FROM (SELECT p.k, g.i, role, text, gone, more, {_INSERTED} FROM p JOIN g ON g.k = p.k AND g.i = p.i + 1)),
 n AS (SELECT k, count(i) AS n FROM ids LEFT JOIN g USING (k) GROUP BY 1),
 e AS (SELECT k, list_min([w0, w3]) AS b FROM (SELECT p.k, {_INSERTED} FROM p JOIN n ON n.k = p.k AND n.n = p.i)),
 c AS (SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(met AND NOT blank) AS duplicate, count_if(ends AND NOT met AND NOT blank) AS truncated,
  count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY 1)
 SELECT conv_id, {', '.join(f'CAST(coalesce({x}, 0) AS BIGINT) AS {x}' for x in ('gaps', 'blank', 'duplicate', 'truncated', 'illegal'))}, CAST(b.c AS BIGINT) AS cost, b.a AS audit, sha256(array_to_string(b.r, chr(10))) AS repaired_sha256
 FROM ids JOIN e USING (k) LEFT JOIN c USING (k)"""

SQL = {"op12_turns": TURNS, "op6_vectors": VECTORS, "op9_minhash": DOCUMENTS, "pii_base": PII, "secret_base": SECRETS, "licence_base": LICENCES, "media_base": MEDIA}
