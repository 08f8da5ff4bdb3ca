"""DuckDB SQL for the queries that SQL can express, over the same tables."""

from __future__ import annotations

from . import interaction, licenses, mixing, privacy, quality

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op1() -> str:
    """Measures and votes by row; then the rounds of expectation-maximisation, a pair of steps each."""
    rules = list(quality.RULES)
    kinds = " + ".join(f"contains(t, '{c}')::INT" for c in quality.SYMBOLS)
    vote = ", ".join(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END AS v_{r}" for r, (bad, good) in quality.RULES.items())

    def posterior(p: str) -> str:
        good = " * ".join([f"{p}.share", *(f"CASE v_{r} WHEN 1 THEN {p}.good_{r} WHEN -1 THEN 1 - {p}.good_{r} ELSE 1.0 END" for r in rules)])
        bad = " * ".join([f"(1 - {p}.share)", *(f"CASE v_{r} WHEN -1 THEN {p}.bad_{r} WHEN 1 THEN 1 - {p}.bad_{r} ELSE 1.0 END" for r in rules)])
        return f"({good}) / (({good}) + ({bad}))"

    def clip(x: str) -> str:
        return f"least(greatest({x}, {quality.LOW}), {quality.HIGH})"

    g, b = quality.RIGHT_GOOD, quality.RIGHT_BAD
    steps = [f"p0 AS MATERIALIZED (SELECT {quality.GOOD_SHARE}::DOUBLE AS share, " + ", ".join(f"{g}::DOUBLE AS good_{r}, {b}::DOUBLE AS bad_{r}" for r in rules) + ")"]
    for k in range(quality.ROUNDS):
        cols = [clip("sum(n * p) / sum(n)") + " AS share"]
        for r in rules:
            cols.append(clip(f"(coalesce(sum(n * p) FILTER (v_{r} = 1), 0) + {g * 2}) / (coalesce(sum(n * p) FILTER (v_{r} <> 0), 0) + 2)") + f" AS good_{r}")
            cols.append(clip(f"(coalesce(sum(n * (1 - p)) FILTER (v_{r} = -1), 0) + {b * 2}) / (coalesce(sum(n * (1 - p)) FILTER (v_{r} <> 0), 0) + 2)") + f" AS bad_{r}")
        steps.append(f"p{k + 1} AS MATERIALIZED (SELECT {', '.join(cols)} FROM (SELECT q.*, {posterior('x')} AS p FROM patterns q, p{k} x))")
    names = ", ".join(f"v_{r}" for r in rules)
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS MATERIALIZED (SELECT r, doc_id, t, regexp_extract_all(t, '{WORD}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM d),
g AS (SELECT r, i, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS g FROM (SELECT r, w, unnest(range(0, len(w) - 2)) AS i FROM w WHERE len(w) >= 3)),
c AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n >= 2) GROUP BY r),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  (length(t) - length(translate(t, '{quality.SYMBOLS}', '')))::BIGINT AS n_symbols,
  len(list_filter(w, lambda x: contains('{quality.SYMBOLS}', right(x, 1)))) AS n_symbol_words, {kinds} AS n_symbol_kinds,
  len(l) AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
  length(t) - length(translate(t, '{UPPER}', '')) AS n_capitals, length(t) - length(replace(t, '!', '')) AS n_shouts,
  length(t) - length(translate(t, '.?!', '')) AS n_ends
  FROM w LEFT JOIN c USING (r)),
v AS MATERIALIZED (SELECT m.*, {vote} FROM m),
patterns AS MATERIALIZED (SELECT {names}, count(*) AS n FROM v GROUP BY ALL),
{", ".join(steps)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND {posterior('x')} >= {quality.KEEP} AS kept
FROM v, p{quality.ROUNDS} x"""


def op2() -> str:
    weights = ", ".join(map(str, mixing.WEIGHTS))
    return f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
o AS (SELECT *, [{weights}][(row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1] AS weight, source_size * {mixing.MOST} AS cap FROM s),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * {mixing.SHARE} - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
  / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
t AS (SELECT source, source_size, least(cap::DOUBLE, (max(level) OVER ()) * weight) AS target FROM l),
r AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
  ('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + (u < rate - floor(rate))::INT))::BIGINT AS taken FROM r"""


OP4 = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, coalesce(doc_id, 9223372036854775807) AS k, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, k, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT r, k, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d WHERE length(h) >= 100)),
m AS (SELECT r, i FROM (SELECT r, k, i, min(k) OVER (PARTITION BY s) AS least FROM w) WHERE least < k),
e AS (SELECT r, i, max(CASE WHEN i - prev <= 50 THEN 0 ELSE 1 END) AS begins FROM (SELECT r, i, coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -1000) AS prev FROM m) GROUP BY r, i),
p AS (SELECT r, g, min(i) AS a, max(i) + 50 AS b FROM (SELECT r, i, sum(begins) OVER (PARTITION BY r ORDER BY i) AS g FROM e) GROUP BY r, g),
n AS (SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed, list({'a': a, 'b': b} ORDER BY a) AS spans FROM p GROUP BY r),
f AS (SELECT d.r, doc_id, h, coalesce(n_spans, 0)::BIGINT AS n_spans, coalesce(n_removed, 0)::BIGINT AS n_removed,
  list_concat([{'a': 0::BIGINT, 'b': 0::BIGINT}], coalesce(spans, []), [{'a': length(h)::BIGINT // 2, 'b': 0::BIGINT}]) AS cuts FROM d LEFT JOIN n USING (r))
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, n_removed, n_spans,
  sha256(unhex(array_to_string(list_transform(range(1, len(cuts)), lambda j: substr(h, 2 * cuts[j].b + 1, 2 * (cuts[j + 1].a - cuts[j].b))), ''))) AS kept_sha256
FROM f"""

OP9 = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, len(w) - 3)) AS i FROM d WHERE len(w) >= 4)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 3),
n AS MATERIALIZED (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
e AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
ways AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(a, b) AS (SELECT a, b FROM ways UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a),
root AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, m) AS component_id, least(doc_id, m) = doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN root USING (doc_id)"""


def op10() -> str:
    texts = licenses.PHRASES + licenses.TEMPLATES
    k = licenses.GRAM
    grams = [(" ".join(t.split()[i : i + k]), n, i) for n, (t, _) in enumerate(texts) for i in range(len(t.split()) - k + 1)]
    values = ", ".join(f"('{g}', {n}, {i})" for g, n, i in grams)
    names = ", ".join(f"({n}, {len(t.split())}, '{label}')" for n, (t, label) in enumerate(texts))
    base = len(licenses.PHRASES)
    return f"""
WITH known(g, tid, tpos) AS (VALUES {values}), template(tid, size, label) AS (VALUES {names}),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
h AS (SELECT r, tid, tpos, i - tpos AS diagonal FROM (SELECT r, i, array_to_string(w[i + 1 : i + {k}], ' ') AS g FROM (SELECT r, w, unnest(range(0, len(w) - {k - 1})) AS i FROM d WHERE len(w) >= {k})) JOIN known USING (g)),
v AS (SELECT r, tid, diagonal, CASE WHEN tid < {base} THEN {licenses.LOOSE + 1} ELSE 1 END * diagonal AS along, flatten(list([{", ".join(f"tpos + {j}" for j in range(k))}])) AS places FROM h GROUP BY r, tid, diagonal),
c AS (SELECT r, tid, diagonal, len(list_distinct(flatten(list(places) OVER (PARTITION BY r, tid ORDER BY along RANGE BETWEEN CURRENT ROW AND {licenses.LOOSE} FOLLOWING)))) AS covered FROM v),
x AS (SELECT r, diagonal, label, covered / size AS share, tid < {base} AND covered = size AS base, CASE WHEN tid < {base} THEN covered = size ELSE covered / size >= {licenses.COVER} END AS found FROM c JOIN template USING (tid)),
y AS (SELECT r, count(*) FILTER (base) AS n_base, min(diagonal) FILTER (base) AS first_word, max(diagonal) FILTER (base) AS last_word,
  array_to_string(list_sort(list_distinct(list(label) FILTER (base))), ',') AS base_labels, array_to_string(list_sort(list_distinct(list(label) FILTER (found))), ',') AS labels, max(share) AS score FROM x GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN y USING (r)"""


def op11() -> str:
    """Trees level by level: siblings of a node are the others of its run.  The check sum runs over the bits of the id's digits."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c} END"
    leaf = lambda text: f"sha256({' || '.join(map(field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"
    bits = "list_reduce([c, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, (a & 1) * 3988292384))"
    crc = f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, x: {bits.replace('[c,', '[xor(a, x),').replace('lambda a, z: xor(a >> 1, (a & 1)', 'lambda b, z: xor(b >> 1, (b & 1)')}))"
    up = "SELECT level + 1, tree, i // 16, sha256(string_agg(h, '' ORDER BY i)), (n + 15) // 16 FROM {0} WHERE n > 1 GROUP BY level, tree, i // 16, n"
    others = "SELECT r, level, coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (x.i < p.i), '') AS a, coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (x.i > p.i), '') AS b FROM {0} p JOIN {1} x USING (level, tree) WHERE x.i // 16 = p.i // 16 AND x.n > 1 GROUP BY r, level"
    return f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, source, {leaf("text")} AS leaf,
  CASE WHEN doc_id IS NOT NULL AND {crc} % 5 = 0 THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} ELSE {leaf("text")} END AS claimed FROM documents),
s AS MATERIALIZED (SELECT source, row_number() OVER (ORDER BY source COLLATE "C" NULLS FIRST) - 1 AS tree, count(*) AS n FROM d GROUP BY source),
l AS MATERIALIZED (SELECT r, doc_id, leaf, claimed, tree, n, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
nodes(level, tree, i, h, n) AS (SELECT 0, tree, i, leaf, n FROM l UNION ALL {up.format("nodes")}),
sub AS MATERIALIZED (SELECT tree, h, max(level) OVER () AS most FROM nodes WHERE n = 1),
tops(level, tree, i, h, n) AS (SELECT 0, 0, tree, h, count(*) OVER () FROM sub UNION ALL {up.format("tops")}),
root AS (SELECT h AS root FROM tops WHERE n = 1),
way AS MATERIALIZED (SELECT r, x.level, x.tree, l.i // (16 ** x.level)::BIGINT AS i FROM l JOIN (SELECT DISTINCT tree, level FROM nodes WHERE n > 1) x USING (tree)),
way2 AS MATERIALIZED (SELECT r, x.level, 0 AS tree, l.tree // (16 ** x.level)::BIGINT AS i FROM l CROSS JOIN (SELECT DISTINCT level FROM tops WHERE n > 1) x),
steps AS MATERIALIZED (SELECT * FROM ({others.format("way", "nodes")}) UNION ALL SELECT r, level + 1000, a, b FROM ({others.format("way2", "tops")})),
listed AS (SELECT r, list({{'a': a, 'b': b}} ORDER BY level) AS w, string_agg(a || b, '' ORDER BY level) AS all_of FROM steps GROUP BY r),
f AS (SELECT l.r, doc_id, leaf, tree, sha256(coalesce(all_of, '')) AS proof_sha256,
  list_reduce(list_prepend({{'a': claimed, 'b': ''}}, coalesce(w, [])), lambda x, y: {{'a': sha256(y.a || x.a || y.b), 'b': ''}}).a AS folded_root FROM l LEFT JOIN listed USING (r))
SELECT doc_id, leaf, sub.h AS subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM f JOIN sub USING (tree) CROSS JOIN root"""


def op12() -> str:
    names = [*interaction.FILTERS, interaction.COPY]
    fails = ", ".join(f"'{k}'" for k in names)
    conditions = ", ".join([f"({c})" for c in interaction.FILTERS.values()] + ["is_copy"])
    orders = " CROSS JOIN ".join(f"(SELECT unnest([{fails}]) AS f{k}) t{k}" for k in range(len(names)))
    apart = " AND ".join(f"f{a} <> f{b}" for a in range(len(names)) for b in range(a))
    return f"""
WITH m AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
  coalesce(doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')), doc_id IS NULL AND min(doc_id) OVER (PARTITION BY coalesce(text, '')) IS NOT NULL) AS is_copy FROM documents),
c AS (SELECT doc_id, part, is_copy, len(w) AS n_words, len(list_distinct(w)) AS n_distinct, length(t) - length(translate(t, '{UPPER}', '')) AS n_capitals, length(t) AS n_chars, length(t) - length(translate(t, '#$%&*|', '')) AS n_symbols FROM m),
g AS (SELECT doc_id, max((quality = 1)::INT) = 1 AS good, max((toxic = 1)::INT) = 1 AS toxic FROM labels GROUP BY doc_id),
d AS MATERIALIZED (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, list_filter([{fails}], lambda x, k: [{conditions}][k]) AS failed FROM c LEFT JOIN g USING (doc_id)),
o AS (SELECT {" || ".join(f"f{k}" for k in range(len(names)))} AS filter_order FROM {orders} WHERE {apart}),
s AS (SELECT filter_order, step::INT AS step, filter_order[step] AS f, string_split(filter_order[: step - 1], '') AS before FROM o, (SELECT unnest(range(1, {len(names) + 1})) AS step)),
x AS MATERIALIZED (SELECT part, filter_order, step, f, good, toxic, len(failed) = 1 AS alone, list_contains(failed, f) AS fails, list_has_any(failed, before) AS gone FROM d CROSS JOIN s),
y AS (SELECT part, filter_order, step, f, count(*) FILTER (NOT fails AND NOT gone) AS kept, count(*) FILTER (fails AND NOT gone) AS removed, count(*) FILTER (fails AND gone) AS redundant,
  count(*) FILTER (fails AND alone) AS unique_fails, count(*) FILTER (fails AND NOT gone AND good) AS good_lost, count(*) FILTER (fails AND NOT gone AND toxic) AS toxic_lost FROM x GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM y"""


def op13() -> str:
    """Matches and the gaps between them give places; then terms near mentions, and counts over all documents."""
    lower = lambda c: f"translate({c}, '{UPPER}', '{LOWER}')"
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(length({digits})), lambda i: CASE WHEN i % 2 = 0 THEN {digits}[-1 - i]::INT ELSE 2 * {digits}[-1 - i]::INT - CASE WHEN {digits}[-1 - i]::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda x: NOT regexp_matches(x, '^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$'))) = 0"),
        "card": (r"[0-9]([\x20-]?[0-9])+", f"length({digits}) BETWEEN 16 AND 19 AND {luhn}"),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({digits}) BETWEEN 8 AND 15"),
    }

    def found(source: str, pattern: str) -> str:
        return f"""(SELECT r, m, s, s + length(m) AS e FROM (SELECT r, ms[i] AS m, (sum(length(gs[i])) OVER w + sum(length(ms[i])) OVER w)::BIGINT - length(ms[i]) AS s
  FROM (SELECT r, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT r, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS gs FROM {source})) WINDOW w AS (PARTITION BY r ORDER BY i)))"""

    base = " UNION ALL ".join(f"SELECT r, '{k}' AS kind, {n} AS o, s, e, '{k}:' || {lower('m') if k in ('email', 'ip') else digits} AS entity FROM {found('d', pattern)} WHERE {good}" for n, (k, (pattern, good)) in enumerate(kinds.items()))
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in kinds)
    general = f"left(term, {privacy.GENERAL}) || '*'"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
b AS MATERIALIZED ({base}),
bs AS MATERIALIZED (SELECT r, {counts}, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY o, s) AS base FROM b GROUP BY r),
w AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY r ORDER BY s) AS j FROM (SELECT r, {lower('m')} AS term, s, e FROM {found('(SELECT d.* FROM d SEMI JOIN b ON b.r = d.r)', privacy.TERM)}) x
  WHERE length(term) >= {privacy.SHORTEST} AND NOT EXISTS (SELECT 1 FROM b WHERE b.r = x.r AND b.s < x.e AND b.e > x.s)),
m AS MATERIALIZED (SELECT b.r, b.s, entity, count(w.r) AS k FROM b LEFT JOIN w ON w.r = b.r AND w.s < b.s GROUP BY b.r, b.s, b.e, entity),
near AS MATERIALIZED (SELECT DISTINCT m.r, entity, term, w.s, w.e FROM m JOIN w ON w.r = m.r AND j > k - {privacy.REACH} AND j <= k + {privacy.REACH}),
pairs AS MATERIALIZED (SELECT entity, unit, count(DISTINCT near.r) AS n_both FROM (SELECT r, entity, unnest([term, {general}]) AS unit FROM near) near JOIN d USING (r) GROUP BY ALL HAVING count(DISTINCT t) >= {privacy.SUPPORT}),
own AS (SELECT entity, count(DISTINCT r) AS n_entity FROM b GROUP BY entity),
seen AS (SELECT unit, count(*) AS n_unit FROM (SELECT r, unnest(list_distinct(list_concat(ws, list_transform(ws, lambda term: {general})))) AS unit
  FROM (SELECT r, list_filter(regexp_extract_all({lower('t')}, '{privacy.TERM}'), lambda x: length(x) >= {privacy.SHORTEST}) AS ws FROM d)) SEMI JOIN pairs USING (unit) GROUP BY unit),
n AS (SELECT count(*)::DOUBLE AS n FROM d),
tells AS MATERIALIZED (SELECT entity, unit FROM pairs JOIN own USING (entity) JOIN seen USING (unit), n WHERE n_entity < n AND ln(n * n_both / (n_entity::DOUBLE * n_unit)) >= {privacy.DISCLOSES} * ln(n / n_entity)),
hits AS (SELECT r, s, e, max(CASE WHEN g.unit IS NULL THEN '{privacy.METHOD[0]}' ELSE '{privacy.METHOD[1]}' END) AS kind FROM near JOIN tells x ON x.entity = near.entity AND x.unit = term LEFT JOIN tells g ON g.entity = near.entity AND g.unit = {general} GROUP BY r, s, e),
hs AS (SELECT r, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY kind, s) AS method FROM hits GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in kinds)}, sha256(coalesce(base, '')) AS base_sha256, concat_ws(',', base, method) AS spans FROM d LEFT JOIN bs USING (r) LEFT JOIN hs USING (r)"""


ORACLE = {
    "op1_quality_rules": op1(),
    "op2_mix_sources": op2(),
    "op4_suffix_dedup": OP4,
    "op9_minhash_dedup": OP9,
    "op10_license_scan": op10(),
    "op11_merkle_manifest": op11(),
    "op12_filter_interaction": op12(),
    "op13_personal_data": op13(),
}
