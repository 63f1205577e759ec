"""SQL for the queries that SQL can express, for DuckDB; written apart from the operators."""

from __future__ import annotations

import math

from . import fim, licenses, mixing, parity, quality, secrets, trie


def _spans(table: str, kind: str, order: int, pattern: str, keep: str = "true", skip: str = "0") -> str:
    """Rows (rid, s, o, e, kind) of the kept matches; ends add up lengths of gaps and hits. The
    first `skip` characters of a hit are not part of the span."""
    p = pattern.replace("'", "''")
    return f"""
      SELECT rid, s + {skip} AS s, {order} AS o, s + length(hit) AS e, '{kind}' AS kind FROM (
        SELECT rid, hits[i] AS hit,
          list_sum(list_transform(gaps[1:i], lambda g: length(g)))::BIGINT
            + coalesce(list_sum(list_transform(hits[1:i-1], lambda h: length(h))), 0)::BIGINT AS s
        FROM (SELECT rid, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM (
          SELECT rid, regexp_extract_all(text, '{p}') AS hits, string_split_regex(text, '{p}') AS gaps FROM {table})))
      WHERE {keep}"""


def op1() -> str:
    head = secrets.ASSIGN_HEAD.replace("'", "''")
    keeps = {
        "assign": f"length(regexp_replace(hit, '^{head}', '')) >= 6",
        "access": "length(hit) >= 20",
    }
    # the same languages without look-behinds and possessive repeats
    web = secrets.WEB
    plain = {
        "pem": "-----BEGIN [A-Z ]*PRIVATE KEY-----",
        "jwt": rf"(?:^|[^A-Za-z0-9_-])eyJ{web}{{8,}}\.eyJ{web}{{8,}}\.{web}{{8,}}",
        "prefixed": r"(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35,})",
        "address": r"://[A-Za-z0-9._~-]*:[^\x00-\x20/@:]{3,}@",
    }
    skips = {"jwt": "(CASE WHEN hit LIKE 'e%' THEN 0 ELSE 1 END)"}
    parts = [_spans("d", r.name, i, plain.get(r.name, r.pattern), keeps.get(r.name, "true"), skips.get(r.name, "0")) for i, r in enumerate(secrets.RULES)]
    text = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o)"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
    f AS ({" UNION ALL ".join(parts)}),
    g AS (SELECT rid, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in secrets.BASE)},
      {text} FILTER (o < 3) AS base, {text} AS spans FROM f GROUP BY rid)
    SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in secrets.BASE)},
      sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN g USING (rid)"""


WS = "[\\x20\\x09-\\x0D]"


def op3() -> str:
    stop = ", ".join(f"'{w}'" for w in quality.STOP_FORMS)
    rules = " OR ".join(f"(({r.measure}) {r.comparison} {r.bound:g})" for r in quality.RULES)
    base = " OR ".join(f"(({r.measure}) {r.comparison} {r.bound:g})" for r in quality.BASE_RULES)
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, list_filter(string_split_regex(text, '{WS}+'), lambda x: x <> '') AS words,
      list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
    g AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
      FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
    r AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM (
      SELECT rid, i, unnest([0, 1, 2]) AS k FROM (SELECT *, count(*) OVER (PARTITION BY rid, gram) AS c FROM g) WHERE c > 1) GROUP BY rid),
    m AS (SELECT doc_id, len(words)::BIGINT AS n_words,
      length(regexp_replace(text, '{WS}', '', 'g'))::BIGINT AS word_chars,
      length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
      (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_text_lines,
      coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
      len(list_filter(list_distinct(words), lambda x: x IN ({stop}))) AS n_stop_words,
      length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_ascii_letters
      FROM w LEFT JOIN r USING (rid)),
    b AS (SELECT *, ({base}) AS base_failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
      NOT (base_failed OR {rules}) AS kept FROM b"""


def op4() -> str:
    other = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    split = lambda t: f"list_filter(string_split_regex({t}, '{other}'), lambda x: x <> '')"
    bases = []
    for phrase, label in licenses.PHRASES.items():
        words = phrase.split()
        same = " AND ".join(f"words[i + {k}] = '{x}'" for k, x in enumerate(words))
        bases.append(f"SELECT rid, i - 1 AS pos, '{label}' AS label FROM p WHERE {same}")
    tokens, rules = [], []
    for label, text in licenses.TEMPLATES.items():
        own = sorted(set(text.split()))
        need, span = math.ceil(licenses.THRESHOLD * len(own) - 1e-9), math.ceil(len(text.split()) / licenses.THRESHOLD - 1e-9)
        tokens += [f"('{label}', '{t}')" for t in own]
        rules.append(f"('{label}', {len(own)}, {need}, {span})")
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {lower} AS text FROM documents),
    w AS (SELECT rid, doc_id, {split("text")} AS words FROM d),
    p AS (SELECT rid, words, unnest(range(1, len(words) + 1)) AS i FROM w),
    b AS ({" UNION ALL ".join(bases)}),
    bs AS (SELECT rid, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list_sort(list_distinct(list(label))) AS base FROM b GROUP BY rid),
    t(label, token) AS (VALUES {", ".join(tokens)}),
    k(label, size, need, span) AS (VALUES {", ".join(rules)}),
    l AS (SELECT rid, j, unnest({split("part")}) AS w FROM (SELECT rid, unnest(range(1, len(parts) + 1)) AS j, unnest(parts) AS part
      FROM (SELECT rid, string_split_regex(text, '\n[\x20\x09\x0B-\x0D]*\n') AS parts FROM d))),
    h AS (SELECT rid, label, i, words[i] AS w FROM p JOIN t ON words[i] = token),
    c AS (SELECT rid, label, count(DISTINCT w) AS n FROM l JOIN t ON w = token GROUP BY rid, label, j
      UNION ALL SELECT a.rid, a.label, count(DISTINCT b.w) FROM h a JOIN k USING (label) JOIN h b ON a.rid = b.rid AND a.label = b.label AND b.i BETWEEN a.i AND a.i + span - 1
      GROUP BY a.rid, a.label, a.i),
    m AS (SELECT rid, label, max(n) / any_value(size) AS score FROM c JOIN k USING (label) WHERE n >= need GROUP BY rid, label),
    ms AS (SELECT rid, list(label) AS more, max(score) AS score FROM m GROUP BY rid)
    SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
      coalesce(array_to_string(base, ','), '') AS base_labels,
      coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ','), '') AS labels,
      CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(score, 0.0) END::DOUBLE AS score
    FROM w LEFT JOIN bs USING (rid) LEFT JOIN ms USING (rid)"""


def op5() -> str:
    lower = "translate(k, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
    l AS (SELECT rid, doc_id, i, lines[i] AS line FROM (SELECT rid, doc_id, lines, unnest(range(1, len(lines) + 1)) AS i
      FROM (SELECT rid, doc_id, string_split(text, chr(10)) AS lines FROM d))),
    s AS (SELECT *, regexp_replace(regexp_replace(line, '^{WS}+', ''), '{WS}+$', '') AS k FROM l),
    x AS (SELECT rid, doc_id, i, line, {lower} AS k FROM s),
    c AS (SELECT k, min(doc_id) AS keeper FROM x WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
    j AS (SELECT x.*, coalesce(c.keeper <> x.doc_id, false) AS gone FROM x LEFT JOIN c ON x.k = c.k)
    SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
      sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
    FROM j GROUP BY rid, doc_id"""


def op6() -> str:
    return f"""
    WITH d AS (SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '{WS}+'), lambda x: x <> ''))::BIGINT AS size,
      md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, '')))) AS h FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
    w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, source_size * {mixing.MAX_EPOCHS} AS cap FROM s),
    f AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0) AS lw, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS lg,
      row_number() OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST) AS k FROM w
      WINDOW o AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    v AS (SELECT arg_min(lw::DOUBLE / lg::DOUBLE, k) AS level FROM f WHERE cap >= lw::DOUBLE / lg::DOUBLE * weight),
    t AS (SELECT source, source_size, least(cap::DOUBLE, weight * level) AS target FROM f, v),
    e AS (SELECT *, floor(target)::BIGINT AS words, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS whole FROM t),
    a AS (SELECT d.*, source_size, target, whole, words - whole * source_size AS extra,
      coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
    SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, extra - before)))::BIGINT AS taken FROM a"""


def op9() -> str:
    return """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5"""


def op11() -> str:
    (p, q), k = parity.SIMILAR, parity.SHINGLE
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    gram = f"array_to_string(words[i:i + {k - 1}], ' ')"
    return f"""
    WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex({lower}, '{WS}+'), lambda x: x <> '') AS words FROM documents),
    g AS (SELECT rid, doc_id, list_sort(list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {k} THEN [array_to_string(words, ' ')]
      ELSE list_transform(range(1, len(words) - {k - 2}), lambda i: {gram}) END)) AS grams FROM d),
    s AS (SELECT rid, doc_id, grams, len(grams) AS n, md5(array_to_string(grams, chr(10))) AS node FROM g),
    o AS (SELECT node, any_value(n) AS n, any_value(grams) AS grams FROM s WHERE n > 0 GROUP BY node),
    x AS (SELECT node, n, unnest(grams) AS gram FROM o),
    e AS (SELECT a.node AS u, b.node AS v FROM x a JOIN x b ON a.gram = b.gram AND a.node <> b.node
      GROUP BY a.node, b.node HAVING {q} * count(*) >= {p} * (any_value(a.n) + any_value(b.n) - count(*))),
    r(node, hit) AS (SELECT node, node FROM o UNION SELECT r.node, e.v FROM r JOIN e ON r.hit = e.u),
    c AS (SELECT r.node, min(doc_id) AS low FROM r JOIN s ON r.hit = s.node GROUP BY r.node)
    SELECT doc_id, n::BIGINT AS n_shingles, CASE WHEN n = 0 THEN doc_id ELSE low END AS component_id FROM s LEFT JOIN c USING (node)"""


def op12() -> str:
    bit = "CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END"  # the polynomial of CRC-32, reflected
    byte = f"list_reduce([1, 2, 3, 4, 5, 6, 7, 8], lambda a, k: {bit}, xor(z, x))"
    digits = "list_transform(string_split(conv_id::VARCHAR, ''), lambda y: ascii(y)::BIGINT)"
    crc = f"xor(list_reduce({digits}, lambda z, x: {byte}, 4294967295), 4294967295)"
    b, most = trie.BLOCK, trie.MOST_SHARED
    return f"""
    WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS place FROM m),
    k AS (SELECT conv_id, count(*) AS size, {crc} % {most + 1} AS h, conv_id - conv_id % {b} AS base FROM m GROUP BY conv_id),
    z AS (SELECT k.*, least(k.h, coalesce(o.size, 0)) AS head FROM k LEFT JOIN k o ON k.base = o.conv_id),
    r AS (SELECT z.conv_id, head + place - h AS place, role, text FROM z JOIN t ON z.conv_id = t.conv_id AND place >= h
      UNION ALL SELECT z.conv_id, place, role, text FROM z JOIN t ON z.base = t.conv_id AND place < h),
    c AS (SELECT *, string_agg(sha256(length(role) || ':' || role || text), ',') OVER (PARTITION BY conv_id ORDER BY place) AS path FROM r),
    p AS (SELECT conv_id, place + 1 AS depth, strlen(text) AS bytes, md5(path) AS node, lag(md5(path), 1, 'root') OVER w AS parent,
      lead(place) OVER w IS NULL AS last FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY place)),
    n AS (SELECT node, any_value(parent) AS parent, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, any_value(bytes) AS bytes FROM p GROUP BY node
      UNION ALL SELECT 'root', NULL, min(conv_id), 0, count(*), 0 FROM z HAVING count(*) > 0),
    f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN (SELECT parent AS up, count(*) AS n_children FROM n GROUP BY parent) ON n.node = up),
    a AS (SELECT f.node AS low, p.node AS high FROM f JOIN p ON f.conv_id = p.conv_id AND p.depth <= f.depth UNION ALL SELECT node, 'root' FROM f),
    s AS (SELECT high, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * bytes) AS saved FROM a JOIN f ON low = node GROUP BY high),
    e AS (SELECT node, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (SELECT node, conv_id FROM p WHERE last
      UNION ALL SELECT 'root', conv_id FROM z WHERE conv_id NOT IN (SELECT conv_id FROM p)) GROUP BY node)
    SELECT f.conv_id, f.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, f.n_convs::BIGINT AS n_convs, f.n_children::BIGINT AS n_children,
      n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
    FROM f JOIN s ON f.node = high LEFT JOIN n u ON f.parent = u.node LEFT JOIN e ON f.node = e.node"""


def op13() -> str:
    p, s, m = fim.Marks()
    draw = lambda k: f"('0x' || substr(h, {8 * k + 1}, 8))::BIGINT"
    cut = lambda lo, hi: f"coalesce(array_to_string(units[{lo}:{hi}], ''), '')"
    marked = " OR ".join(f"contains(text, '{x}')" for x in (p, s, m))
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{fim.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
    u AS (SELECT *, regexp_extract_all(text, '{WS}*[^\\x20\\x09-\\x0D]+|{WS}+') AS units FROM d),
    n AS (SELECT *, len(units)::BIGINT AS n, {draw(0)} % (len(units) + 1) AS a, {draw(1)} % (len(units) + 1) AS b,
      CASE WHEN text = '' OR {marked} OR {draw(2)} % 100 >= {fim.RATE} THEN 'plain' WHEN {draw(3)} % 100 < {fim.SPM} THEN 'spm' ELSE 'psm' END AS form FROM u),
    c AS (SELECT *, {cut("1", "least(a, b)")} AS prefix, {cut("least(a, b) + 1", "greatest(a, b)")} AS middle, {cut("greatest(a, b) + 1", "n")} AS suffix FROM n)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
      sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{p}' || prefix || '{s}' || suffix || '{m}' || middle
        ELSE '{s}' || suffix || '{p}' || prefix || '{m}' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM c"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_secret_scan": op1(),
        "op3_quality_rules": op3(),
        "op4_license_scan": op4(),
        "op5_line_dedup": op5(),
        "op6_mixing": op6(),
        "op9_exact_topk": op9(),
        "op11_jaccard_join": op11(),
        "op12_prefix_trie": op12(),
        "op13_fill_in_middle": op13(),
    }
