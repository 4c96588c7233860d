"""DuckDB SQL of the queries that SQL can express, built from the operators' own constants."""

from __future__ import annotations

from kairos.llm import licenses, mixing, pii, urls


def _luhn(digits: str) -> str:
    worth = ("CASE WHEN i % 2 = 0 THEN ch::INT WHEN ch::INT > 4 THEN ch::INT * 2 - 9 ELSE ch::INT * 2 END")
    return (f"list_sum(list_transform(string_split(reverse({digits}), ''), lambda ch, j: "
            + worth.replace("i % 2 = 0", "j % 2 = 1") + ")) % 10 = 0")


def _ibans(number: int, kind: pii.Kind) -> str:
    """Every opening on its own: at its country's length, else as the longest run, if mod-97 and the character after it agree."""
    assert kind.prior + pii.ADDED_AGAINST >= pii.MIN_SCORE  # so no score drops a confirmed one
    countries = "|".join(f"(?:{'|'.join(codes.split())})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")
                         for n, codes in pii.IBAN_LENGTHS.items())
    mod = ("list_reduce(list_prepend(0::BIGINT, list_transform(string_split(concat(substr(code, 5), substr(code, 1, 4)), ''), "
           "lambda ch: (CASE WHEN ascii(ch) >= 65 THEN ascii(ch) + 45 ELSE ascii(ch) - 48 END)::BIGINT)), "
           "lambda a, v: CASE WHEN v >= 100 THEN (a * 100 + v - 100) % 97 ELSE (a * 10 + v) % 97 END) = 1")
    opening = "[^A-Za-z0-9][A-Z]{2}[0-9]{2}"  # of ' ' and the text
    return f"""
  SELECT rid, {number} AS k, '{kind.name}' AS kind, s, s + length(value) AS e FROM (
    SELECT rid, s, arg_min(value, way) AS value FROM (
      SELECT *, replace(value, ' ', '') AS code FROM (
        SELECT rid, s, ahead, unnest([1, 2]) AS way, unnest([regexp_extract(ahead, '^(?:{countries})'), regexp_extract(ahead, '^{kind.plain}')]) AS value
        FROM (SELECT rid, s, substr(text, (s + 1)::BIGINT, 48) AS ahead FROM (
          SELECT rid, text, list_sum(list_transform(pieces[1:i], lambda x: length(x))) + 5 * (i - 1) AS s FROM (
            SELECT rid, text, unnest(range(1, len(pieces))) AS i, pieces FROM (
              SELECT rid, text, string_split_regex(concat(' ', text), '{opening}') AS pieces FROM d))))
        WHERE regexp_matches(ahead, '^[A-Z]{{2}}[0-9]{{2}} ?[A-Z0-9]')))
    WHERE value <> '' AND NOT regexp_matches(substr(ahead, length(value) + 1, 1), '[A-Za-z0-9]')
      AND length(code) BETWEEN 15 AND 34 AND ({mod})
    GROUP BY rid, s)"""


def _pii() -> str:
    near = "lower(concat(before, ' ', after))"

    def says(words):
        return "(" + " OR ".join(f"contains({near}, '{w}')" for w in words) + ")"

    def good(k):
        digits = "regexp_replace(value, '[^0-9]', '', 'g')"
        bounded = "NOT regexp_matches(before, '[A-Za-z0-9]$') AND NOT regexp_matches(after, '^[A-Za-z0-9]')"
        score = (f"{k.prior} + CASE WHEN {says(pii.CONTEXT[k.name])} THEN {pii.ADDED_CONTEXT} ELSE 0 END"
                 f" + CASE WHEN {says(pii.AGAINST[k.name])} THEN {pii.ADDED_AGAINST} ELSE 0 END >= {pii.MIN_SCORE}")
        return {
            "email": "true",
            "ip": f"regexp_matches(value, '{pii.IP_RANGE}')",
            "card": f"CASE WHEN length({digits}) BETWEEN 13 AND 19 THEN {_luhn(digits)} ELSE false END",
            "phone": f"length({digits}) BETWEEN 9 AND 15",
            "ssn": f"{bounded} AND NOT regexp_matches(value, '^(000|666|9)') AND NOT contains(value, '-00-') "
                   f"AND NOT regexp_matches(value, '0000$') AND {score}",
        }[k.name]

    parts = []
    for i, k in enumerate(pii.KINDS):
        if k.opens:
            parts.append(_ibans(i, k))
            continue
        plain = k.plain.replace("'", "''")
        parts.append(f"""
  SELECT rid, {i} AS k, '{k.name}' AS kind, s, s + length(value) AS e FROM (
    SELECT rid, value, right(pieces[i], {pii.CONTEXT_CHARS}) AS before, left(pieces[i + 1], {pii.CONTEXT_CHARS}) AS after,
      list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS s
    FROM (SELECT rid, hits, pieces, unnest(range(1, len(hits) + 1)) AS i, unnest(hits) AS value FROM (
      SELECT rid, regexp_extract_all(text, '{plain}') AS hits, string_split_regex(text, '{plain}') AS pieces FROM d)))
  WHERE {good(k)}""")
    base = sum(k.base for k in pii.KINDS)
    counts = ", ".join(f"count(*) FILTER (WHERE k = {i}) AS n_{k.name}" for i, k in enumerate(pii.KINDS) if k.base)
    code = "concat(kind, ':', s::BIGINT, ':', e::BIGINT)"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
sp AS ({' UNION ALL '.join(parts)}),
g AS (SELECT rid, {counts}, string_agg({code}, ',' ORDER BY k, s) FILTER (WHERE k < {base}) AS b,
  string_agg({code}, ',' ORDER BY k, s) AS spans FROM sp GROUP BY rid)
SELECT doc_id, {', '.join(f"coalesce(n_{k.name}, 0)::BIGINT AS n_{k.name}" for k in pii.KINDS if k.base)},
  sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)"""


def _licenses() -> str:
    def rx(items):
        out = ""
        for it in items:
            out += {"word": f"{it.word} ", "optional": f"({rx(it.inside)})?", "var": f"([^ ]+ ){{{it.low},{it.high}}}"}[it.kind]
        return out
    by_label: dict[str, list[str]] = {}
    for t in licenses.templates():
        by_label.setdefault(t.label, []).append(rx(t.items))
    has = {label: "(" + " OR ".join(f"regexp_matches(line, ' {r}')" for r in rs) + ")" for label, rs in by_label.items()}
    places = []
    for t in licenses.templates():
        if t.base:
            same = " AND ".join(f"w[i + {k}] = '{word}'" for k, word in enumerate(t.mandatory))
            places.append(f"list_filter(range(1, len(w) + 1), lambda i: {same})")
    joined = lambda names: "concat_ws(',', " + ", ".join(f"CASE WHEN {has[x]} THEN '{x}' END" for x in sorted(names)) + ")"
    left = " * ".join(f"(CASE WHEN {has[x]} THEN 1.0::DOUBLE - {wt!r}::DOUBLE ELSE 1.0::DOUBLE END)" for x, wt in licenses.weights().items())
    base = {t.label for t in licenses.templates() if t.base}
    word = licenses.WORD.pattern.decode()
    return f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{word}') AS w
  FROM documents),
p AS MATERIALIZED (SELECT doc_id, w, concat(' ', array_to_string(w, ' '), ' ') AS line, list_concat({', '.join(places)}) AS pos FROM d)
SELECT doc_id, len(w)::BIGINT AS n_words, len(pos)::BIGINT AS n_base, (list_min(pos) - 1)::BIGINT AS first_word,
  (list_max(pos) - 1)::BIGINT AS last_word, {joined(base)} AS base_labels, {joined(has)} AS labels, 1.0::DOUBLE - {left} AS score
FROM p"""


def _mixing(t: mixing.Targets, documents: str = "documents") -> str:
    def by_domain(value):
        whens = [(f"regexp_matches(source, '{p}')" if p else "true", value(n, w)) for n, w, p in t.domains]
        return "CASE " + " ".join(f"WHEN {test} THEN {v}" for test, v in whens) + " END"
    language = "CASE language " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in t.languages.items()) + f" ELSE {t.language_default} END"
    if not t.languages:
        language = str(t.language_default)

    def level(name, path, weight, above):
        parent = ", ".join(path[:-1])
        over = f"OVER (PARTITION BY {parent} ORDER BY r, {path[-1]}" if parent else f"OVER (ORDER BY r, {path[-1]}"
        join = f"JOIN {above} USING ({parent})" if parent else f"CROSS JOIN {above}"
        cols = ", ".join(path)
        return f"""
{name}_s AS MATERIALIZED (SELECT *, capacity::DOUBLE / weight AS r FROM (
  SELECT {cols}, sum(capacity)::BIGINT AS capacity, max({weight})::BIGINT AS weight FROM leaf GROUP BY {cols}) {join}),
{name}_w AS (SELECT *, sum(capacity) {over}) - capacity AS used,
  sum(weight) {over} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight FROM {name}_s),
{name}_f AS (SELECT *, capacity * open_weight <= (budget - used) * weight AS is_full FROM {name}_w),
{name}_t AS (SELECT {parent + "," if parent else ""} coalesce(sum(capacity) FILTER (WHERE is_full), 0)::BIGINT AS used_all,
  coalesce(sum(weight) FILTER (WHERE NOT is_full), 0)::BIGINT AS open_all FROM {name}_f {"GROUP BY " + parent if parent else ""}),
{name} AS MATERIALIZED (SELECT {cols}, CASE WHEN is_full THEN capacity ELSE ((budget - used_all) * weight) // open_all END::BIGINT AS budget
  FROM {name}_f {f"JOIN {name}_t USING ({parent})" if parent else f"CROSS JOIN {name}_t"})"""
    leaf = ", ".join(mixing.TREE[2])
    return f"""
WITH n AS MATERIALIZED (SELECT doc_id, coalesce(lang, '') AS language, coalesce(source, '') AS source,
  len(regexp_extract_all(coalesce(text, ''), '{mixing.TOKEN}'))::BIGINT AS n_tokens FROM {documents}),
rows_ AS MATERIALIZED (SELECT *, {by_domain(lambda n, w: f"'{n}'")} AS domain FROM n),
leaf AS MATERIALIZED (SELECT {leaf}, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens)::BIGINT * {t.max_epochs} AS capacity FROM rows_ GROUP BY {leaf}),
root AS (SELECT (coalesce(sum(tokens), 0)::BIGINT * {t.percent}) // 100 AS budget FROM leaf),
{level("l1", mixing.TREE[0], by_domain(lambda n, w: w), "root")},
{level("l2", mixing.TREE[1], language, "l1")},
{level("l3", mixing.TREE[2], "1", "l2")},
dealt AS (SELECT {leaf}, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS epochs,
  CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest FROM l3 JOIN leaf USING ({leaf})),
keyed AS (SELECT *, md5(concat_ws('|', '{t.seed}', epochs::VARCHAR, doc_id::VARCHAR)) AS k FROM rows_ JOIN dealt USING ({leaf}))
SELECT doc_id, {leaf}, n_tokens,
  (epochs + CASE WHEN rest > 0 AND sum(n_tokens) OVER (PARTITION BY {leaf} ORDER BY k) <= rest THEN 1 ELSE 0 END)::BIGINT AS copies
FROM keyed"""


def _urls(rules=urls.RULES) -> str:
    def fits(h, p):
        return f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    ordered = urls.by_length(rules)
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in ordered) + " END"
    judged = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in ordered) + " END"
    lower = lambda c: f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    link = urls.LINK.replace("'", "''")
    rounds = "".join(f""",
r{i} AS MATERIALIZED (SELECT s.kind, s.a, {1 - urls.DAMPING!r}::DOUBLE * seed + {urls.DAMPING}::DOUBLE * coalesce(came, 0) AS mass
  FROM seeds s LEFT JOIN (SELECT f.kind, f.b, sum(mass * part) AS came FROM flow f JOIN r{i - 1} r ON r.kind = f.kind AND r.a = f.a
    GROUP BY f.kind, f.b) c ON c.kind = s.kind AND c.b = s.a)""" for i in range(1, urls.ROUNDS + 1))
    return f"""
WITH u AS MATERIALIZED (SELECT page_id, {lower(f"regexp_extract(coalesce(url, ''), '{urls.URL}', 1)")} AS host,
  regexp_extract(coalesce(url, ''), '{urls.URL}', 2) AS path, coalesce(html, '') AS html FROM pages),
p AS MATERIALIZED (SELECT *, {rule} AS rule, {judged} AS judged FROM u),
links AS MATERIALIZED (SELECT a, b, count(*) AS n FROM (
  SELECT host AS a, unnest(list_distinct(list_transform(regexp_extract_all(html, '{link}', 1), lambda x: {lower("x")}))) AS b FROM p)
  WHERE a <> '' AND b <> '' AND a <> b GROUP BY a, b),
hosts AS (SELECT host FROM p WHERE host <> '' UNION SELECT b FROM links),
family AS MATERIALIZED (SELECT DISTINCT a, b FROM (
  SELECT array_to_string(l[len(l) - i:], '.') AS a, array_to_string(l[len(l) - i + 1:], '.') AS b
  FROM (SELECT l, unnest(range(1, len(l))) AS i FROM (SELECT string_split(host, '.') AS l FROM hosts))) WHERE contains(b, '.')),
edges AS MATERIALIZED (SELECT a, b, sum(n)::DOUBLE AS n FROM (
  SELECT a, b, n FROM links UNION ALL SELECT a, b, 1 FROM family UNION ALL SELECT b, a, 1 FROM family) GROUP BY a, b),
both_ways AS (SELECT 'trust' AS kind, a, b, n FROM edges UNION ALL SELECT 'distrust', b, a, n FROM edges),
flow AS MATERIALIZED (SELECT kind, a, b, n / sum(n) OVER (PARTITION BY kind, a) AS part FROM both_ways),
said AS (SELECT host AS a, count(*) FILTER (WHERE judged = 'allow') AS trust, count(*) FILTER (WHERE judged = 'block') AS distrust FROM p GROUP BY host),
kinds AS (SELECT kind, a, seed * coalesce((SELECT count(*) FROM p) / nullif(sum(seed) OVER (PARTITION BY kind), 0), 0)::DOUBLE AS seed
  FROM (SELECT 'trust' AS kind, a, trust::DOUBLE AS seed FROM said UNION ALL SELECT 'distrust', a, distrust::DOUBLE FROM said)),
seeds AS MATERIALIZED (SELECT kind, a, coalesce(seed, 0)::DOUBLE AS seed
  FROM kinds FULL JOIN (SELECT kind, a FROM flow UNION SELECT kind, b FROM flow) USING (kind, a)),
r0 AS (SELECT kind, a, seed AS mass FROM seeds){rounds},
ranks AS (SELECT kind, a, mass * coalesce(sum(seed) OVER (PARTITION BY kind) / nullif(sum(mass) OVER (PARTITION BY kind), 0), 0) AS mass
  FROM r{urls.ROUNDS} JOIN seeds USING (kind, a)),
scores AS (SELECT a AS host, sum(CASE WHEN kind = 'trust' THEN mass ELSE 0 END) AS trust,
  sum(CASE WHEN kind = 'distrust' THEN mass ELSE 0 END) AS distrust FROM ranks GROUP BY a)
SELECT page_id, host, path, rule, coalesce(judged, CASE WHEN round(distrust - {urls.THRESHOLD} * (trust + distrust), 9) > 0
  THEN 'block' ELSE 'allow' END) AS verdict, round(trust, 6) AS trust, round(distrust, 6) AS distrust
FROM p LEFT JOIN scores USING (host)"""


PII = _pii()
URLS = _urls()
MIXING = _mixing(mixing.Targets())
LICENSES = _licenses()

TOPK = """
WITH v AS MATERIALIZED (SELECT vec_id, min(vec) AS vec FROM (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS vec FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
  GROUP BY vec_id),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.vec, c.vec)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20"""

FILTER_AUDIT = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
fails AS MATERIALIZED (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (CASE WHEN len(w) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
    + (CASE WHEN min(d.doc_id) OVER (PARTITION BY t) < d.doc_id THEN 16 ELSE 0 END) AS mask
  FROM d LEFT JOIN marks USING (doc_id)),
cells AS MATERIALIZED (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY ALL),
letters AS (SELECT substr('ABCDE', i::INT, 1) AS letter, 1 << (i::INT - 1) AS bit FROM range(1, 6) r(i)),
walk AS (
  SELECT '' AS prefix, 0 AS step, 0 AS before, 0 AS applied, 0 AS bit
  UNION ALL
  SELECT prefix || letter, step + 1, applied, applied | l.bit, l.bit FROM walk JOIN letters l ON applied & l.bit = 0),
full_orders AS (SELECT prefix AS filter_order FROM walk WHERE step = 5),
m AS MATERIALIZED (
  SELECT part, prefix, step, bit, sum(CASE WHEN mask & applied = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells CROSS JOIN walk WHERE step > 0 GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM full_orders JOIN m ON m.prefix = substr(filter_order, 1, m.step)"""

SOURCE_DIVERGENCE = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
words AS MATERIALIZED (SELECT rid, lang, source, term, count(*) AS n FROM (SELECT rid, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, term, sum(n) AS total FROM words GROUP BY ALL HAVING count(*) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(total) AS s FROM kept GROUP BY lang),
cells AS MATERIALIZED (SELECT lang, source, term, sum(n) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
groups AS MATERIALIZED (SELECT g.lang, g.source, coalesce(v, 0) AS v, coalesce(c.s, 0) AS s, coalesce(l.s, 0) AS ls
  FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN langs l USING (lang)
  LEFT JOIN (SELECT lang, source, sum(n) AS s FROM cells GROUP BY ALL) c USING (lang, source)),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (g.s + 5 * g.v) AS p, 1 + (1000000000::HUGEINT * (total + 5)) // (g.ls + 5 * g.v) AS q
  FROM groups g JOIN kept k USING (lang) LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
    SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term
    GROUP BY ALL) t ON t.lang = a.lang AND t.source = a.source AND t.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value,
  (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM found QUALIFY part = 'pair' OR rank <= 50"""
