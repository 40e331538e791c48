"""What SQL can say of this subpackage's queries, for DuckDB."""

from __future__ import annotations

from terralode.llm import licences

SUBSTRING_DEDUP = r"""
WITH d AS (
  SELECT doc_id, coalesce(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> ''), []) AS w FROM documents
), p AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50
), win AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM p
), firsts AS (
  SELECT h, min(doc_id) AS lo FROM win GROUP BY h
), gone AS (
  SELECT DISTINCT win.doc_id, unnest(range(win.i, win.i + 50)) AS i FROM win JOIN firsts USING (h) WHERE firsts.lo < win.doc_id
), lost AS (
  SELECT doc_id, list(i) AS xs, count(*) AS n FROM gone GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
  sha256(CASE WHEN n IS NULL THEN array_to_string(w, ' ')
    ELSE coalesce(array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda k: NOT list_contains(xs, k)), lambda k: w[k]), ' '), '') END) AS kept_sha256
FROM d LEFT JOIN lost USING (doc_id)
"""

URL_FILTER = r"""
WITH u AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), s AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r AS (
  SELECT *, CASE
    WHEN '.' || host LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN '.' || host LIKE '%.example.com' AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN '.' || host LIKE '%.net' AND path LIKE '/es/%' THEN 'net/es/'
    WHEN '.' || host LIKE '%.net' AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN '.' || host LIKE '%.com' AND path LIKE '/%' THEN 'com/' END AS rule FROM s
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
  WHEN rule IS NOT NULL THEN 'block'
  WHEN '.' || host LIKE '%.spam-%' OR '.' || host LIKE '%cheap-pills%' OR path LIKE '%/wp-login.php' OR path LIKE '%/trackback/_%' THEN 'block'
  ELSE 'allow' END AS verdict
FROM r
"""


def licence_digests() -> str:
    """The canonical form as nested replacements, of documents and of the known texts alike."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in licences.known_texts())
    fixed = ", ".join(f"({quoted(d)}, {quoted(k)})" for k, d, _ in licences.DIGESTS)
    spelt = "b"
    for a, b in licences.SPELLINGS:
        spelt = f"regexp_replace({spelt}, '\\b{a}\\b', '{b}', 'g')"
    odd = "|".join(a for a, _ in licences.SPELLINGS)
    return rf"""
WITH known(licence, text) AS (VALUES {known}),
t AS (SELECT doc_id, NULL AS licence, text FROM documents UNION ALL SELECT NULL, licence, text FROM known),
a AS (SELECT doc_id, licence, array_to_string(list_transform(string_split(regexp_replace(lower(text), '\r\n?', chr(10), 'g'), chr(10)), lambda x: CASE
  WHEN regexp_matches(x, '^[ \t]*copyright[ \t]*[^\s]') AND NOT regexp_matches(x, '^[ \t]*copyright[ \t]+({licences._BODY})\b') OR regexp_matches(x, '^[ \t]*\(c\)[ \t]*copyright')
    OR regexp_matches(x, '^[ \t]*\(c\).*\b(19|20)\d\d\b') OR regexp_matches(x, '^[ \t]*(©|all rights reserved)') THEN '' ELSE x END), chr(10)) AS a FROM t),
b AS (SELECT doc_id, licence, regexp_replace(a, '[^\p{{L}}\p{{N}}\n]+', ' ', 'g') AS b FROM a),
c AS (SELECT doc_id, licence, CASE WHEN regexp_matches(b, '\b({odd})\b') THEN {spelt} ELSE b END AS c FROM b),
w AS (SELECT doc_id, licence, c, trim(regexp_replace(c, '[ \n]+', ' ', 'g')) AS w FROM c),
f(digest, licence) AS (VALUES {fixed}),
k AS (SELECT digest, min(licence) AS licence FROM (SELECT sha256(w) AS digest, licence FROM w WHERE licence IS NOT NULL AND w <> '' UNION ALL SELECT digest, licence FROM f) GROUP BY 1),
d AS (SELECT doc_id, c, CASE WHEN w <> '' THEN sha256(w) END AS digest FROM w WHERE licence IS NULL),
l AS (SELECT doc_id, trim(regexp_replace(unnest(string_split(c, chr(10))), '[ ]+', ' ', 'g')) AS x FROM d),
h AS (SELECT doc_id, array_to_string(list_sort(list(DISTINCT k.licence)), ',') AS names FROM l JOIN k ON k.digest = sha256(l.x) WHERE l.x <> '' GROUP BY doc_id)
SELECT d.doc_id, d.digest, k.licence, coalesce(h.names, '') AS line_licences
FROM d LEFT JOIN k USING (digest) LEFT JOIN h ON h.doc_id = d.doc_id
"""


#: crc32 of the text {key}, a list of its bytes' numbers folded through the table `tab`.
_CRC_TABLE = """tab AS (
  SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce([i::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c
    FROM range(256) AS r(i))
)"""
_CRC = "xor(list_reduce([4294967295::UBIGINT] || list_transform(string_split({key}, ''), lambda x: ascii(x)::UBIGINT), lambda c, x: xor(c >> 8, tab[((xor(c, x) & 255) + 1)::BIGINT])), 4294967295::UBIGINT)"


def merkle_manifest(levels: int = 6) -> str:
    """Levels of the trees written out: a group of up to 16 ** levels leaves."""

    def tree(name: str, leaves: str, group: str) -> list[str]:
        """Nodes of each level (group, i, n, h), n how many there are; where one is left it stays as it is."""
        out = [f"{name}0 AS ({leaves})"]
        for k in range(1, levels + 1):
            out.append(
                f"{name}{k} AS (SELECT {group}, i // 16 AS i, any_value((n + 15) // 16) AS n, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h FROM {name}{k - 1} GROUP BY {group}, i // 16)"
            )
        return out

    def steps(name: str, paths: str, group: str, start: str) -> list[str]:
        """From rows of `start` with (id, i) the joined siblings and the folded hash, level by level."""
        out, before = [], start
        for k in range(levels):
            out.append(
                f"""{paths}{k} AS (
  SELECT p.* EXCLUDE (pos, proof, fold), p.pos // 16 AS pos, p.proof || coalesce(b.l, '') || coalesce(b.r, '') AS proof,
    CASE WHEN b.n > 1 THEN sha256(coalesce(b.l, '') || p.fold || coalesce(b.r, '')) ELSE p.fold END AS fold
  FROM {before} p JOIN (
    SELECT {group}, i, n, string_agg(h, '') OVER (PARTITION BY {group}, i // 16 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l,
      string_agg(h, '') OVER (PARTITION BY {group}, i // 16 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r FROM {name}{k}
  ) b ON b.{group} IS NOT DISTINCT FROM p.{group} AND b.i = p.pos)"""
            )
            before = f"{paths}{k}"
        return out

    field = "coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"
    fields = lambda text: " || ".join(field.format(c=c) for c in ("doc_id", "source", "lang", "n_chars", text))
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        _CRC_TABLE,
        f"m AS (SELECT *, doc_id IS NOT NULL AND {_CRC.format(key='doc_id::VARCHAR')} % 5 = 0 AS hit FROM documents, tab)",
        f"t AS (SELECT *, CASE WHEN hit THEN {lower} ELSE text END AS other FROM m)",
        f"leaf AS (SELECT doc_id, source, sha256({fields('text')}) AS h, sha256({fields('other')}) AS claimed FROM t)",
        "ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM leaf)",
        *tree("s", "SELECT source, i, n, h FROM ranked", "source"),
        f"sub AS (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n, 0 AS one FROM s{levels})",
        *tree("g", "SELECT one, i, n, h FROM sub", "one"),
        "p AS (SELECT doc_id, source, h AS leaf, i AS pos, '' AS proof, claimed AS fold FROM ranked)",
        *steps("s", "p", "source", "p"),
        f"q AS (SELECT p.* EXCLUDE (pos), sub.i AS pos, sub.h AS subroot, 0 AS one FROM p{levels - 1} p JOIN sub ON sub.source IS NOT DISTINCT FROM p.source)",
        *steps("g", "q", "one", "q"),
    ]
    return f"""
WITH {", ".join(parts)}
SELECT doc_id, leaf, subroot, g.h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = g.h AS verified FROM q{levels - 1}, g{levels} g
"""


def conversation_repair() -> str:
    """The least (cost, edits) to each state after each row, row by row."""
    at = ["w.s", "CASE w.s WHEN 2 THEN 3 ELSE 2 END", "CASE w.s WHEN 2 THEN 2 ELSE 3 END"]
    after = lambda s: f"(CASE {s} WHEN 2 THEN 3 ELSE 2 END)"
    role = lambda s: f"(CASE {s} WHEN 2 THEN 'user' ELSE 'assistant' END)"
    ways = []
    for k in range(3):
        s, ins = at[k], "[" + ", ".join(f"{role(x)} || ':'" for x in at[1 : k + 1]) + "]::VARCHAR[]"
        keeps = f"CASE WHEN ini = 's' AND {s} = 0 THEN 1 WHEN ini = {role(after(s))}[1] THEN {after(s)} END"
        extra = "CASE kind WHEN 'truncated' THEN 3 ELSE 0 END"
        stays = "coalesce(kind, '') NOT IN ('blank', 'duplicate')"
        ways += [
            f"{{'c': w.c + {3 * k + 4}, 'a': w.a || '{'I' * k}D', 'p': w.p || {ins}, 's': {s}}}",
            f"{{'c': CASE WHEN {stays} AND ({keeps}) IS NOT NULL THEN w.c + {3 * k} + {extra} END, 'a': w.a || '{'I' * k}K', 'p': w.p || {ins} || [role || ':' || text], 's': {keeps}}}",
            f"{{'c': CASE WHEN {stays} THEN w.c + {3 * k + 3} + {extra} END, 'a': w.a || '{'I' * k}R', 'p': w.p || {ins} || [{role(after(s))} || ':' || text], 's': {after(s)}}}",
        ]
    best = ", ".join(f"list_min(list_filter(cands, lambda x: x.s = {s} AND x.c IS NOT NULL))" for s in range(4))
    space = r"[\x20\x09-\x0D]"
    return rf"""
WITH RECURSIVE {_CRC_TABLE},
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC.format(key="(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS kind FROM conversations, tab),
e AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM k WHERE kind <> 0
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen, regexp_replace(text, '{space}+$', '') AS bare FROM e
), f AS (
  SELECT *, role[1] AS ini, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY n) AS ini_before,
    CASE WHEN bare = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN bare[-1] NOT IN ('.', '!', '?') THEN 'truncated' END AS kind FROM o
), r(conv_id, n, ways) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, [{{'c': 0, 'a': '', 'p': []::VARCHAR[], 's': 0}}] FROM conversations
  UNION ALL
  SELECT conv_id, n, list_filter([{best}], lambda x: x IS NOT NULL) FROM (
    SELECT f.conv_id, f.n, flatten(list_transform(r.ways, lambda w: [{", ".join(ways)}])) AS cands
    FROM r JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.n = r.n + 1)
), z AS (
  SELECT conv_id, list_min(list_transform(ways, lambda w: {{'c': w.c + CASE w.s WHEN 1 THEN 6 WHEN 2 THEN 3 ELSE 0 END, 'a': w.a || CASE w.s WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END,
    'p': w.p || CASE w.s WHEN 1 THEN ['user:', 'assistant:'] WHEN 2 THEN ['assistant:'] ELSE []::VARCHAR[] END}})) AS w
  FROM r QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1
), c AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (kind = 'blank') AS blank, count(*) FILTER (kind = 'duplicate') AS duplicate,
    count(*) FILTER (kind = 'truncated') AS truncated, count(*) FILTER (ini_before IS NOT NULL AND ini_before || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id
)
SELECT z.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, w.c::BIGINT AS cost, w.a AS audit, sha256(array_to_string(w.p, chr(10))) AS repaired_sha256
FROM z LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM z.conv_id
"""
