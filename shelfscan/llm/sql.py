"""SQL that checks the registered queries, where SQL can express them."""

from __future__ import annotations

from shelfscan.llm import chat, decontaminate, divergence, licenses, lines, urls

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _lowered(text: str) -> str:
    return f"translate({text}, '{_UPPER}', '{_LOWER}')"


def _words(table: str, key: str) -> str:
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"SELECT {key}, regexp_extract_all({_lowered("coalesce(text, '')")}, '{pattern}') AS w FROM {table}"


OP1 = f"""
WITH iw AS ({_words("benchmark", "item_id")}), dw AS ({_words("documents", "doc_id")}),
windows AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, size, array_to_string(w[i:i + size - 1], ' ') AS gram
  FROM (SELECT item_id, w, least(len(w), {decontaminate.WINDOW}) AS size, unnest(range(1, len(w) - least(len(w), {decontaminate.WINDOW}) + 2)) AS i FROM iw WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT size FROM windows),
grams AS (
  SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS gram
  FROM (SELECT doc_id, w, size, unnest(range(1, CAST(len(w) - size + 2 AS BIGINT))) AS i FROM dw CROSS JOIN sizes WHERE len(w) >= size)
),
hits AS (SELECT g.doc_id, g.i, g.size, v.item FROM grams g JOIN windows v ON g.gram = v.gram AND g.size = v.size),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, i, size FROM hits)) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

_TEMPLATES = ", ".join(f"({_quoted(k)}, {i}, {_quoted(v)})" for k, texts in licenses.TEMPLATES.items() for i, v in enumerate(texts))


def _split_terms(text: str) -> str:
    return f"unnest(list_filter(regexp_split_to_array(lower({text}), '[^a-z0-9]+'), lambda x: x <> ''))"


_TELLING = ", ".join(map(_quoted, licenses.telling_terms(licenses.TEMPLATES)))


def _plain_loops(pattern: str) -> str:
    """A pattern without the marks of loops that give nothing back, which DuckDB's engine neither has nor needs."""
    return pattern.replace("*+", "*").replace("++", "+").replace("?+", "?")


OP2 = rf"""
WITH rows AS (
  SELECT doc_id, row_number() OVER () AS row,
    'source/' || CASE WHEN doc_id % 10 > 0 THEN lang || '/' ELSE '' END
      || CASE WHEN doc_id % 10 > 1 THEN CAST(doc_id // 1000 AS VARCHAR) || '/' ELSE '' END || CAST(doc_id AS VARCHAR) || '.txt' AS path_tail,
    source, text,
    contains(text, chr(10)) AND regexp_matches(string_split(text, chr(10))[-1], '{licenses.STATEMENT}') AS is_licence_file
  FROM documents
),
statements AS (
  SELECT row, CASE WHEN is_licence_file THEN text ELSE
    regexp_extract(text || chr(10), '{_plain_loops(licenses.BLOCK_COMMENT)}', 0) || regexp_extract(text || chr(10), '{_plain_loops(licenses.LINE_COMMENTS)}', 0) || chr(10)
      || array_to_string(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{licenses.STATEMENT}')), chr(10)) END AS statement
  FROM rows
),
said AS (SELECT row, part FROM (SELECT row, unnest(list_distinct(list_prepend(statement, string_split(statement, chr(10))))) AS part FROM statements)
  WHERE list_has_any(regexp_split_to_array(lower(part), '[^a-z0-9]+'), [{_TELLING}])),
parts AS (SELECT part, count(*) AS files FROM said GROUP BY part),
counts AS (SELECT part, files, term, count(*) AS tf FROM (SELECT part, files, {_split_terms("part")} AS term FROM parts) GROUP BY ALL),
patterns AS (SELECT licence, notice, term, count(*) AS tf FROM (SELECT licence, notice, {_split_terms("body")} AS term FROM (VALUES {_TEMPLATES}) v(licence, notice, body)) GROUP BY ALL),
seen AS (SELECT term, sum(files) AS df FROM counts GROUP BY term),
idf AS (
  SELECT term, ln(((SELECT coalesce(sum(files), 0) FROM parts) + 1) / CAST(coalesce(df, 0) + 1 AS DOUBLE)) + 1 AS idf
  FROM (SELECT term FROM seen UNION SELECT term FROM patterns) LEFT JOIN seen USING (term)
),
own AS (SELECT part, term, tf * idf AS w FROM counts JOIN idf USING (term)),
other AS (SELECT licence, notice, term, tf * idf AS v FROM patterns JOIN idf USING (term)),
own_norm AS (SELECT part, sqrt(sum(w * w)) AS wn FROM own GROUP BY part),
other_norm AS (SELECT licence, notice, sqrt(sum(v * v)) AS vn FROM other GROUP BY ALL),
dots AS (SELECT part, licence, notice, sum(w * v) AS dot FROM own JOIN other USING (term) GROUP BY ALL),
scored AS (SELECT part, licence, round(dot / (wn * vn), 6) AS score FROM dots JOIN own_norm USING (part) JOIN other_norm USING (licence, notice)),
matched AS (
  SELECT row, licence, score FROM said JOIN scored USING (part) WHERE score >= {licenses.LEAST_SCORE}
  QUALIFY row_number() OVER (PARTITION BY row ORDER BY score DESC, licence) = 1
),
marked AS (
  SELECT doc_id, source || substr(path_tail, 7) AS path, is_licence_file, regexp_replace(source || substr(path_tail, 7), '/[^/]*$', '') AS dir, licence, score
  FROM rows LEFT JOIN matched USING (row)
),
holders AS (
  SELECT dir AS up, path AS from_path, licence, score FROM marked WHERE is_licence_file AND licence IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, path) = 1
),
found AS (
  SELECT dir, from_path, h.licence, h.score FROM (SELECT DISTINCT dir FROM marked WHERE licence IS NULL) d JOIN holders h ON d.dir = h.up OR starts_with(d.dir, h.up || '/')
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY length(h.up) DESC) = 1
)
SELECT doc_id, path, coalesce(m.licence, f.licence) AS licence,
  CASE WHEN m.licence IS NOT NULL THEN 'own' WHEN f.licence IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN m.licence IS NOT NULL THEN m.path ELSE f.from_path END AS from_path,
  CASE WHEN m.licence IS NOT NULL THEN m.score ELSE f.score END AS score
FROM marked m LEFT JOIN found f USING (dir)
"""

OP4 = r"""
WITH t AS (SELECT doc_id, coalesce(length(text), 0) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id FROM t)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""


def _escaped(text: str) -> str:
    for plain, safe in (("\\", "\\\\"), ("#", "\\#"), ("</turn>", "<\\/turn>"), ("<next/>", "<\\next/>")):
        text = f"replace({text}, {_quoted(plain)}, {_quoted(safe)})"
    return text


OP6 = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, turn, role, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)
),
placed AS (
  SELECT *, row_number() OVER w AS pos, lag(role) OVER w AS before, lead(role) OVER w AS after FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = '{chat.LOSS_ROLE}'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = '{chat.LOSS_ROLE}'), '')) AS loss_sha256,
  CAST(sum(length({_escaped("text")})
    + CASE WHEN before IS NOT DISTINCT FROM role AND pos > 1 THEN {len(chat.NEXT)} ELSE {len(chat.HEAD) + len(chat.HEAD_END)} + length(replace({_escaped("role")}, ':', '\:')) END
    + CASE WHEN after IS NOT DISTINCT FROM role THEN 0 ELSE {len(chat.END)} END) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id
"""


def _suffix(n: int) -> str:
    return f"array_to_string(list_slice(string_split(host, '.'), greatest(1, len(string_split(host, '.')) - {n - 1}), len(string_split(host, '.'))), '.')"


_TWO = f"{_suffix(2)} IN ({', '.join(map(_quoted, urls.SUFFIXES))})"


def _rules(of_rule: bool) -> str:
    cases = []
    for kind, text in sorted(urls.RULES, key=lambda r: -len(r[1])):
        name, _, rest = text.partition("/")
        cases.append(f"WHEN (host = {_quoted(name)} OR ends_with(host, {_quoted('.' + name)})) AND starts_with(path, {_quoted('/' + rest)}) THEN {_quoted(text if of_rule else kind)}")
    return f"CASE {' '.join(cases)} END"


def _strength(level: str) -> str:
    m = "(sum(bad) / CAST(sum(n) AS DOUBLE))"
    between = f"(sum(bad * bad / CAST(n AS DOUBLE)) / sum(n) - {m} * {m} - {m} * (1 - {m}) * (count(*) - 1) / sum(n))"
    low, high = urls.STRENGTH
    return f"(SELECT greatest({low}, least({high}, CASE WHEN {between} > 0 THEN {m} * (1 - {m}) / {between} - 1 ELSE {high} END)) FROM {level} WHERE n > 0)"


OP7 = rf"""
WITH split AS (
  SELECT page_id, {_lowered(r"regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1)")} AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages
),
outcomes AS (SELECT doc_id AS page_id, max(CAST(toxic = 1 OR quality = 0 AS INTEGER)) AS bad FROM labels GROUP BY doc_id),
hosts AS (
  SELECT host, CASE WHEN {_TWO} THEN {_suffix(3)} ELSE {_suffix(2)} END AS domain, CASE WHEN {_TWO} THEN {_suffix(2)} ELSE {_suffix(1)} END AS suffix, n, bad
  FROM (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM split LEFT JOIN outcomes USING (page_id) WHERE host <> '' GROUP BY host)
),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY suffix),
k AS (SELECT {_strength("suffixes")} AS ks, {_strength("domains")} AS kd, {_strength("hosts")} AS kh, (SELECT (sum(bad) + 1) / CAST(sum(n) + 2 AS DOUBLE) FROM suffixes) AS rate),
top AS (SELECT suffix, (bad + ks * rate) / (n + ks) AS suffix_rate FROM suffixes, k),
middle AS (SELECT domain, (bad + kd * suffix_rate) / (n + kd) AS domain_rate FROM domains JOIN top USING (suffix), k),
low AS (SELECT host, (bad + kh * domain_rate) / (n + kh) AS mean, n + kh AS total FROM hosts JOIN middle USING (domain), k),
bad AS (SELECT host FROM low WHERE mean - {urls.Z} * sqrt(mean * (1 - mean) / (total + 1)) > {urls.LIMIT})
SELECT page_id, host, path, {_rules(True)} AS rule,
  coalesce({_rules(False)}, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict
FROM split
"""

OP10 = f"""
WITH l AS (
  SELECT doc_id, i, line, {_lowered(f"trim(line, {_SPACES})")} AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
),
r AS (SELECT key, min(doc_id) AS keeper FROM l WHERE length(key) >= {lines.LEAST} GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT l.doc_id, i, line, r.key IS NOT NULL AND l.doc_id <> keeper AS gone FROM l LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

OP12 = rf"""
WITH rows AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all({_lowered("coalesce(text, '')")}, '{divergence.TERM}') AS w
  FROM documents
),
words AS (SELECT id, lang, source, unnest(w) AS term FROM rows),
kept AS (SELECT lang, term, count(*) AS total FROM words GROUP BY ALL HAVING count(DISTINCT id) >= {divergence.LEAST_DOCS}),
languages AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
counts AS (SELECT w.lang, w.source, term, count(*) AS n FROM words w JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT lang, source, sum(n) AS n FROM counts GROUP BY ALL),
groups AS (SELECT g.lang, g.source, coalesce(s.n, 0) AS n FROM (SELECT DISTINCT lang, source FROM rows) g LEFT JOIN sizes s USING (lang, source)),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS own,
    1 + (CAST({divergence.UNIT} AS HUGEINT) * (coalesce(c.n, 0) + {divergence.PRIOR})) // CAST(g.n + {divergence.PRIOR} * l.v AS HUGEINT) AS p,
    1 + (CAST({divergence.UNIT} AS HUGEINT) * (k.total + {divergence.PRIOR})) // CAST(l.n + {divergence.PRIOR} * l.v AS HUGEINT) AS q
  FROM groups g JOIN kept k ON k.lang = g.lang JOIN languages l ON l.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
),
distances AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(d.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN distances d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source
),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value FROM shares WHERE own > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {divergence.TOP_TERMS}
"""

ORACLES = {
    "op1_decontaminate": OP1, "op2_licenses": OP2, "op4_exact_dedup": OP4, "op6_chat": OP6, "op7_urls": OP7, "op10_lines": OP10,
    "op12_divergence": OP12,
}
