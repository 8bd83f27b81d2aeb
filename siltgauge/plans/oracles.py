"""SQL for DuckDB that states the catalogue's results independently of the operators."""

from __future__ import annotations


def _scale(x: str, limit, names=("Critical", "High", "Medium")) -> str:
    return f"CASE WHEN {x} >= {limit} * 3 THEN '{names[0]}' WHEN {x} >= {limit} * 2 THEN '{names[1]}' ELSE '{names[2]}' END"


def _offset(x: str, limit: int, high: int, top: int) -> str:
    return f"CASE WHEN {x} >= {limit + top} THEN 'Critical' WHEN {x} >= {limit + high} THEN 'High' ELSE 'Medium' END"


def _n(text: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({text}, '{pattern}')) AS BIGINT)"


DOCS = f"""d0 AS (SELECT CAST(doc_id AS VARCHAR) AS path, coalesce(text, '') AS text, lang, source FROM documents),
    facts AS (SELECT path, text, lang, source, CAST(strlen(text) AS BIGINT) AS size_bytes,
        CAST(length(text) - length(replace(text, chr(10), '')) + 1 - CASE WHEN text = '' OR suffix(text, chr(10)) THEN 1 ELSE 0 END AS BIGINT) AS line_count,
        CAST(len(list_filter(string_split(text, chr(10)), lambda x: length(x) < 30)) AS BIGINT) AS comment_line_count,
        {_n("text", "[A-Za-z0-9_.]@[A-Za-z0-9]|password|secret|token|licen[cs]e")} AS dangerous_pattern_count,
        {_n("text", "[?!;:,]")} AS branch_count, {_n("text", "[.]")} AS function_count FROM d0)"""


def _row_rules(lines: int, branches: int, low: float, high: float, risky: int) -> str:
    """Findings of the four rules whose facts documents have."""
    b = "(branch_count / CAST(greatest(function_count, 1) AS DOUBLE))"
    c = "(comment_line_count / CAST(greatest(line_count, 1) AS DOUBLE))"
    return f"""SELECT path, 'context-bomb' AS kind, CASE WHEN line_count >= {lines} * 4 THEN 'Critical' WHEN line_count >= {lines} * 2 THEN 'High' ELSE 'Medium' END AS severity,
            CASE WHEN line_count >= {lines} * 4 THEN 0.95 WHEN line_count >= {lines} * 2 THEN 0.85 ELSE 0.75 END::DOUBLE AS confidence, size_bytes // 4 AS estimated_tokens FROM facts WHERE line_count >= {lines}
        UNION ALL SELECT path, 'branch-density', {_scale(b, branches)}, 0.85::DOUBLE, NULL FROM facts WHERE {b} > {branches}
        UNION ALL SELECT path, 'comment-ratio', CASE WHEN {c} < {low} THEN 'Medium' ELSE 'Low' END, 0.65::DOUBLE, NULL FROM facts WHERE {c} < {low} OR {c} > {high}
        UNION ALL SELECT path, 'dangerous-pattern', {_scale("dangerous_pattern_count", risky)}, 0.70::DOUBLE, NULL FROM facts WHERE dangerous_pattern_count > {risky}"""


def _clones(key: str) -> str:
    return f"""b AS (SELECT CAST(doc_id AS VARCHAR) AS path, {key} AS k FROM documents WHERE text IS NOT NULL),
    pp AS (SELECT sha256(k) AS digest, path, count(*) AS n FROM b WHERE length(k) >= 40 GROUP BY ALL),
    clones AS (SELECT digest, count(*) AS n_paths, CAST(sum(n) AS BIGINT) AS n_bodies, min(path) AS path, array_to_string(list_slice(list_sort(list(path)), 1, 5), ',') AS paths FROM pp GROUP BY digest HAVING count(*) >= 2)"""


EXACT = r"regexp_replace(text, '[ \t\n\f\r;]+', '', 'g')"
TYPE2 = r"regexp_replace(regexp_replace(text, '[A-Za-z]+', '_', 'g'), '[ \t\n\f\r;]+', '', 'g')"
WEIGHT = "CASE severity WHEN 'Critical' THEN 1.0 WHEN 'High' THEN 0.75 WHEN 'Medium' THEN 0.5 ELSE 0.25 END"
BUCKET = "CASE WHEN kind = 'context-bomb' THEN 'context_waste' WHEN kind IN ('dead-weight', 'code-duplication') THEN 'structural_entropy' ELSE 'reasoning_complexity' END"
PREFIX = "CASE kind WHEN 'context-bomb' THEN 'cb' WHEN 'branch-density' THEN 'bd' WHEN 'comment-ratio' THEN 'cr' WHEN 'dangerous-pattern' THEN 'dp' WHEN 'dead-weight' THEN 'dw' ELSE 'dup' END"
CODE = "CASE kind WHEN 'context-bomb' THEN 'OVS' WHEN 'branch-density' THEN 'BRAN' WHEN 'comment-ratio' THEN 'CMNT' WHEN 'dangerous-pattern' THEN 'DANG' WHEN 'dead-weight' THEN 'DEAD' ELSE 'DUPL' END"
ALL = f"""WITH {DOCS}, {_clones(EXACT)},
    found AS ({_row_rules(25, 2, 0.03, 0.30, 1)}
        UNION ALL SELECT path, 'dead-weight', CASE WHEN line_count >= 50 THEN 'Critical' WHEN line_count >= 25 THEN 'High' ELSE 'Medium' END, 0.6::DOUBLE, size_bytes // 4
            FROM facts WHERE line_count >= 10 AND path NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE doc_id IS NOT NULL)
        UNION ALL SELECT path, 'code-duplication', CASE WHEN n_paths >= 5 THEN 'High' WHEN n_paths >= 3 THEN 'Medium' ELSE 'Low' END, 0.85::DOUBLE, NULL FROM clones),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY {WEIGHT} DESC, path, confidence) AS nth FROM found),
    named AS (SELECT *, {PREFIX} || '-' || CASE WHEN nth < 1000 THEN lpad(CAST(nth AS VARCHAR), 3, '0') ELSE CAST(nth AS VARCHAR) END AS id FROM ranked)"""
HOSTS = "h AS (SELECT CAST(page_id AS VARCHAR) AS src_path, list_reverse(string_split(regexp_extract(url, '^[a-z]+://([^/]+)', 1), '.')) AS p FROM pages)"
NESTED = r"<(?:ul|li|div|nav|a|h1|article|footer)(?: [^>]*)?>|</(?:ul|li|div|nav|a|h1|article|footer)>"


def _degrees(edges: str) -> str:
    return f"""WITH e AS ({edges}), i AS (SELECT dst AS path, count(*) AS n FROM e GROUP BY dst), o AS (SELECT src AS path, count(*) AS n FROM e GROUP BY src),
        g AS (SELECT DISTINCT 's' || s_suppkey AS path, coalesce(i.n, 0) AS fan_in, coalesce(o.n, 0) AS fan_out FROM supplier LEFT JOIN i ON i.path = 's' || s_suppkey LEFT JOIN o ON o.path = 's' || s_suppkey)
        SELECT path, fan_in, fan_out, CASE WHEN fan_in + fan_out = 0 THEN 0.0::DOUBLE ELSE fan_out / (fan_in + fan_out)::DOUBLE END AS instability FROM g"""


def _profile(name: str, sql: str) -> str:
    return f"SELECT path, kind, '{name}' AS report FROM ({sql})"


def _score(where: str) -> str:
    return f"CAST(least(round(coalesce(CAST(sum(CASE WHEN {where} THEN CAST({WEIGHT} * CAST(confidence AS DECIMAL(18,6)) AS DECIMAL(18,6)) END) AS DOUBLE), 0) / greatest((SELECT count(*) FROM facts) * 0.4, 1.0)::DOUBLE * 100), 100) AS INTEGER)"


KEYWORDS = "'if', 'else', 'for', 'while', 'do', 'switch', 'case', 'break', 'continue', 'return', 'try', 'catch', 'finally', 'throw', 'new', 'typeof', 'instanceof', 'in', 'of', 'var', 'let', 'const', 'function', 'class', 'extends', 'super', 'this', 'import', 'export', 'default', 'async', 'await', 'yield', 'null', 'undefined', 'true', 'false', 'void', 'delete', 'fn', 'match', 'loop', 'impl', 'struct', 'enum', 'trait', 'pub', 'use', 'mod', 'where', 'mut', 'ref', 'move', 'self', 'static', 'type', 'as'"

ORACLES: dict[str, str] = {
    "corpus_scan": """SELECT doc_id, CAST(strlen(t) AS BIGINT) AS size_bytes, CAST(length(t) - length(replace(t, chr(10), '')) + 1 - CASE WHEN t = '' OR suffix(t, chr(10)) THEN 1 ELSE 0 END AS BIGINT) AS line_count,
        strlen(t) // 4 AS tokens_floor, CAST(floor(strlen(t) / 4 + 0.5) AS BIGINT) AS tokens_round FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
    "corpus_totals": f"WITH {DOCS} SELECT source, lang, count(*) AS n_files, CAST(sum(line_count) AS BIGINT) AS total_lines, CAST(sum(size_bytes // 4) AS BIGINT) AS total_tokens FROM facts GROUP BY ROLLUP (source, lang)",
    "context_bomb": f"""WITH {DOCS} SELECT path, line_count, size_bytes, 'context-bomb' AS kind, CASE WHEN line_count >= 100 THEN 'Critical' WHEN line_count >= 50 THEN 'High' ELSE 'Medium' END AS severity,
        CASE WHEN line_count >= 100 THEN 0.95 WHEN line_count >= 50 THEN 0.85 ELSE 0.75 END::DOUBLE AS confidence FROM facts WHERE line_count >= 25""",
    "branch_density": f"""WITH p AS (SELECT page_id, {_n("coalesce(html, '')", "<li")} AS branch_count, {_n("coalesce(html, '')", "<ul")} AS function_count FROM pages), x AS (SELECT *, branch_count / greatest(function_count, 1)::DOUBLE AS r FROM p)
        SELECT page_id, branch_count, function_count, 'branch-density' AS kind, {_scale("r", 3)} AS severity, 0.85::DOUBLE AS confidence FROM x WHERE r > 3""",
    "deep_nesting": f"""WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '{NESTED}')) AS m, generate_subscripts(regexp_extract_all(html, '{NESTED}'), 1) AS k FROM pages),
        r AS (SELECT page_id, sum(CASE WHEN m LIKE '</%' THEN -1 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY k) AS depth FROM t), x AS (SELECT page_id, CAST(greatest(max(depth), 0) AS INTEGER) AS max_nesting_depth FROM r GROUP BY page_id)
        SELECT page_id, max_nesting_depth, 'deep-nesting' AS kind, {_offset("max_nesting_depth", 3, 2, 4)} AS severity, 0.85::DOUBLE AS confidence FROM x WHERE max_nesting_depth > 3""",
    "nesting_window": """WITH r AS (SELECT l_orderkey, sum(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS depth FROM lineitem)
        SELECT l_orderkey, CAST(greatest(max(depth), 0) AS INTEGER) AS max_depth FROM r GROUP BY l_orderkey""",
    "type_complexity": f"SELECT p_partkey, p_size AS max_type_depth, 'type-complexity' AS kind, {_offset('p_size', 44, 2, 3)} AS severity, 0.5::DOUBLE AS confidence FROM part WHERE p_size > 44",
    "comment_ratio": f"""WITH {DOCS}, x AS (SELECT *, comment_line_count / greatest(line_count, 1)::DOUBLE AS r FROM facts)
        SELECT path, comment_line_count, line_count, 'comment-ratio' AS kind, CASE WHEN r < 0.03 THEN 'Medium' ELSE 'Low' END AS severity, 0.65::DOUBLE AS confidence FROM x WHERE r < 0.03 OR r > 0.30""",
    "implicit_control": f"""WITH p AS (SELECT page_id, {_n("coalesce(html, '')", '[a-z]="')} AS decorator_count, {_n("coalesce(html, '')", "<[a-z]")} AS function_count, 0.1::DOUBLE * CASE WHEN contains(url, '//blog.') THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS l FROM pages),
        x AS (SELECT *, decorator_count / greatest(function_count, 1)::DOUBLE AS r FROM p)
        SELECT page_id, decorator_count, function_count, 'implicit-control' AS kind, CASE WHEN r >= l * 3 THEN 'High' WHEN r > l * 2 THEN 'Medium' ELSE 'Low' END AS severity, 0.4::DOUBLE AS confidence FROM x WHERE r > l""",
    "error_swallow": """WITH w AS (SELECT user_id, CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS empty_catch_count FROM events WHERE event_type = 'error' GROUP BY ALL)
        SELECT user_id, week, empty_catch_count, 'error-swallow' AS kind, CASE WHEN empty_catch_count >= 5 THEN 'High' WHEN empty_catch_count >= 3 THEN 'Medium' ELSE 'Low' END AS severity, 0.75::DOUBLE AS confidence FROM w WHERE empty_catch_count > 1""",
    "dangerous_pattern": f"WITH {DOCS} SELECT path, dangerous_pattern_count, 'dangerous-pattern' AS kind, {_scale('dangerous_pattern_count', 1)} AS severity, 0.7::DOUBLE AS confidence FROM facts WHERE dangerous_pattern_count > 1",
    "stringly_typed": f"""WITH o AS (SELECT l_orderkey, count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS string_comparison_count FROM lineitem GROUP BY l_orderkey)
        SELECT *, 'stringly-typed' AS kind, {_scale("string_comparison_count", 2, ("High", "Medium", "Low"))} AS severity, 0.65::DOUBLE AS confidence FROM o WHERE string_comparison_count > 2""",
    "import_diversity": f"""WITH o AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n_domains FROM lineitem GROUP BY l_orderkey)
        SELECT *, 'import-diversity' AS kind, {_scale("n_domains", 4, ("High", "Medium", "Low"))} AS severity, 0.7::DOUBLE AS confidence FROM o WHERE n_domains > 4""",
    "import_domains": "SELECT CASE WHEN s = '' OR s LIKE '.%' THEN NULL ELSE string_split(s, '/')[1] END AS domain, count(*) AS n FROM (SELECT trim(regexp_replace(url, '^[a-z]+://', '')) AS s FROM pages) GROUP BY 1",
    "naming_entropy": "SELECT p_partkey, CAST(3 * (p_size % 6) AS BIGINT) AS n_identifiers, 'naming-entropy' AS kind, 'Low' AS severity, 0.5::DOUBLE AS confidence FROM part WHERE 3 * (p_size % 6) >= 10",
    "classify_names": """WITH n AS (SELECT unnest([replace(p_name, ' ', '_'), replace(p_type, ' ', '_'), replace(p_brand, '#', ''), p_name, 'xY']) AS x FROM part)
        SELECT CASE WHEN length(x) < 3 THEN 'other' WHEN contains(x, '_') AND NOT regexp_matches(x, '[A-Z]') THEN 'snake' WHEN contains(x, '_') AND NOT regexp_matches(x, '[a-z]') THEN 'screaming'
            WHEN regexp_matches(x, '^[a-z]') AND regexp_matches(x, '[A-Z]') THEN 'camel' WHEN regexp_matches(x, '^[A-Z]') AND regexp_matches(x, '[a-z]') THEN 'pascal' ELSE 'other' END AS convention, count(*) AS n FROM n GROUP BY 1""",
    "reexport_entropy": """WITH o AS (SELECT l_orderkey, count(*) AS n_exports, sum(CAST(trunc(l_quantity) AS BIGINT)) AS items, bool_or(l_returnflag = 'R') AS wild FROM lineitem GROUP BY l_orderkey)
        SELECT l_orderkey, n_exports, 'reexport-entropy' AS kind, CASE WHEN wild OR items >= 300 THEN 'High' WHEN items >= 100 THEN 'Medium' ELSE 'Low' END AS severity, 0.8::DOUBLE AS confidence FROM o WHERE wild OR (n_exports >= 3 AND items >= 100)""",
    "unused_import": r"""WITH w AS (SELECT doc_id AS path, regexp_extract_all(lower(coalesce(text, '')), '[a-z]{9,}') AS names, regexp_extract_all(lower(coalesce(text, '')), '([a-z]+)[.]', 1) AS ids FROM documents),
        u AS (SELECT path, list_filter(names, lambda x: NOT list_contains(ids, x) AND x NOT IN ('something', 'anonymous')) AS un FROM w)
        SELECT path, 'unused-import' AS kind, CASE WHEN len(un) >= 5 THEN 'Medium' ELSE 'Low' END AS severity, 0.65::DOUBLE AS confidence, CAST(len(un) AS BIGINT) AS unused_count,
            array_to_string(un[1:5], ', ') AS preview FROM u WHERE len(un) >= 2""",
    "dominant_convention": r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z_]+')) AS x FROM documents),
        k AS (SELECT doc_id, CASE WHEN length(x) < 3 THEN 'other' WHEN contains(x, '_') AND NOT regexp_matches(x, '[A-Z]') THEN 'snake' WHEN contains(x, '_') AND NOT regexp_matches(x, '[a-z]') THEN 'screaming'
              WHEN regexp_matches(x, '^[a-z]') AND regexp_matches(x, '[A-Z]') THEN 'camel' WHEN regexp_matches(x, '^[A-Z]') AND regexp_matches(x, '[a-z]') THEN 'pascal' ELSE 'other' END AS c FROM w),
        n AS (SELECT doc_id, c, count(*) AS n FROM k GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS total, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, c) AS nth FROM n)
        SELECT doc_id, 'Low' AS severity, max(CASE WHEN nth = 1 THEN c END) AS dominant, count(CASE WHEN n > total * 0.05 THEN 1 END) AS mixed FROM r GROUP BY doc_id HAVING max(total) >= 10 AND count(CASE WHEN n > total * 0.05 THEN 1 END) >= 2""",
    "body_keys": f"""WITH b AS (SELECT p_partkey, 'const ' || p_name || ' = new ' || p_type || '( ' || p_brand || ' );' || chr(10) || '  if (this) return ' || p_name || ';' AS body FROM part),
        t AS (SELECT *, array_to_string(list_transform(regexp_extract_all(body, '[A-Za-z0-9_$]+|[^A-Za-z0-9_$]+'), lambda x: CASE WHEN regexp_matches(x, '^[A-Za-z_$]') AND x NOT IN ({KEYWORDS}) THEN '_' ELSE x END), '') AS blank FROM b)
        SELECT p_partkey, regexp_replace(body, '[ \\t\\n\\f\\r;]+', '', 'g') AS plain, regexp_replace(blank, '[ \\t\\n\\f\\r;]+', '', 'g') AS type2, contains(body, 'widget') OR contains(body, 'gear') AS named_test FROM t""",
    "path_predicates": r"""WITH p AS (SELECT p_partkey, 'src/' || replace(p_name, ' ', '_') || ['.ts', '.test.ts', '/tests/x.py', '.spec.jsx', '_test.rs', '/conftest.py', '/vite.config.ts', '/jestHelpers.ts', '/.eslintrc.cjs', '/build.py'][p_partkey % 10 + 1] AS path,
            ['lodash', '@nestjs/core', '@angular/core', 'dataclasses', 'typing_extensions', 'react'][p_partkey % 6 + 1] AS i FROM part)
        SELECT p_partkey, path, p_partkey % 10 IN (1, 2, 3, 4, 5) AS is_test, p_partkey % 10 IN (6, 8) AS is_config, starts_with(i, '@nestjs/') OR starts_with(i, '@angular/') AS heavy_typescript, i IN ('dataclasses', 'typing_extensions') AS heavy_python FROM p""",
    "report_words": r"""WITH p AS (SELECT *, p_size * 2 AS score, upper(p_name[1]) || string_split(p_name, ' ')[1][2:] || '-' || string_split(p_name, ' ')[-1] AS two FROM part)
        SELECT p_partkey, lower(two || '-' || p_type) AS kebab, p_type[1] || lower(p_type[2:]) AS severity,
            repeat('█', CAST(round(least(score, 100) / 10.0) AS INTEGER)) || repeat('░', 10 - CAST(round(least(score, 100) / 10.0) AS INTEGER)) AS bar,
            repeat('█', CAST(floor(least(score, 100) / 10.0) AS INTEGER)) || repeat('░', 10 - CAST(floor(least(score, 100) / 10.0) AS INTEGER)) AS bar_floor,
            CASE WHEN score >= 70 THEN 'high' WHEN score >= 40 THEN 'moderate' WHEN score >= 20 THEN 'low' ELSE 'minimal' END AS level,
            CASE WHEN p_size < 5 THEN 'stable' WHEN p_size > 45 THEN 'volatile' ELSE 'mixed' END AS label, 'x::' || p_type AS module FROM p""",
    "unused_names": """WITH w AS (SELECT conv_id, role, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS name FROM conversations),
        u AS (SELECT conv_id, count(*) AS unused_count FROM w WHERE role = 'user' AND NOT EXISTS (SELECT 1 FROM w a WHERE a.role = 'assistant' AND a.conv_id = w.conv_id AND a.name = w.name) GROUP BY conv_id)
        SELECT conv_id, unused_count, CASE WHEN unused_count >= 60 THEN 'Medium' ELSE 'Low' END AS severity FROM u WHERE unused_count >= 2""",
    "degrees_edges": _degrees("SELECT 'o' || l_orderkey AS src, 's' || l_suppkey AS dst FROM lineitem"),
    "degrees_distinct": _degrees("SELECT DISTINCT 'o' || l_orderkey AS src, 's' || l_suppkey AS dst FROM lineitem"),
    "coupling_hotspot": """WITH e AS (SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem),
        i AS (SELECT dst AS path, count(*) AS n FROM e GROUP BY dst), o AS (SELECT src AS path, count(*) AS n FROM e GROUP BY src),
        v AS (SELECT 'p' || p_partkey AS path FROM part UNION ALL SELECT 's' || s_suppkey FROM supplier),
        g AS (SELECT path, coalesce(i.n, 0) AS fan_in, coalesce(o.n, 0) AS fan_out FROM v LEFT JOIN i USING (path) LEFT JOIN o USING (path))
        SELECT path, fan_in, fan_out, 'coupling-hotspot' AS kind,
            CASE WHEN fan_in >= 515 AND fan_out >= 30 AND (fan_in >= 1545 OR fan_out >= 60) OR fan_in < 515 AND fan_out >= 90 THEN 'High' ELSE 'Medium' END AS severity,
            CASE WHEN fan_in >= 515 AND fan_out >= 30 THEN 0.85 WHEN fan_in >= 515 THEN 0.65 ELSE 0.7 END::DOUBLE AS confidence FROM g WHERE fan_in >= 515 OR fan_out >= 30""",
    "dead_weight": f"{ALL} SELECT path, kind, severity, confidence, estimated_tokens FROM found WHERE kind = 'dead-weight'",
    "clones_exact": f"WITH {_clones(EXACT)} SELECT * FROM clones",
    "clones_type2": f"WITH {_clones(TYPE2)} SELECT * FROM clones",
    "prefix_resolve": f"""WITH {HOSTS}, known AS (SELECT DISTINCT array_to_string(p[1:3], '.') AS m FROM h),
        t AS (SELECT src_path, array_to_string(p, '.') AS spec, m, row_number() OVER (PARTITION BY src_path ORDER BY length(m) DESC) AS nth FROM h JOIN known ON array_to_string(p, '.') = m OR starts_with(array_to_string(p, '.'), m || '.'))
        SELECT src_path, spec, m AS dst FROM t WHERE nth = 1""",
    "prefix_resolve_strict": f"""WITH {HOSTS}, known AS (SELECT array_to_string(p[1:2], '.') AS m FROM h UNION SELECT array_to_string(p[1:3], '.') FROM h WHERE length(array_to_string(p, '.')) > 22),
        tree AS (SELECT DISTINCT array_to_string(x[1:k], '.') AS m FROM (SELECT string_split(m, '.') AS x, unnest(range(1, len(string_split(m, '.')) + 1)) AS k FROM known)),
        t AS (SELECT src_path, array_to_string(p, '.') AS spec, k, array_to_string(p[1:k], '.') AS m FROM (SELECT *, unnest(range(1, len(p) + 1)) AS k FROM h)),
        best AS (SELECT src_path, max(k) AS k FROM t WHERE m IN (SELECT m FROM known) GROUP BY src_path)
        SELECT t.src_path, t.spec, t.m AS dst FROM t JOIN best USING (src_path, k)
        WHERE NOT EXISTS (SELECT 1 FROM t u WHERE u.src_path = t.src_path AND u.k > t.k AND u.m NOT IN (SELECT m FROM tree))""",
    "prefix_resolve_scoped": f"""WITH {HOSTS}, f AS (SELECT h.*, regexp_extract(url, '^[a-z]+://[^/]+/([a-z]+)/', 1) AS package FROM h JOIN pages ON src_path = CAST(page_id AS VARCHAR)),
        known AS (SELECT DISTINCT package, array_to_string(p[1:3], '.') AS m FROM f),
        t AS (SELECT src_path, array_to_string(p, '.') AS spec, f.package, m, row_number() OVER (PARTITION BY src_path ORDER BY length(m) DESC) AS nth
              FROM f JOIN known ON f.package = known.package AND (array_to_string(p, '.') = m OR starts_with(array_to_string(p, '.'), m || '.')))
        SELECT src_path, spec, package || '/' || m AS dst FROM t WHERE nth = 1""",
    "referenced_closure": f"WITH {HOSTS}, n AS (SELECT p, unnest(range(1, len(p) + 1)) AS k FROM h) SELECT DISTINCT array_to_string(p[1:k], '.') AS module_path FROM n",
    "relative_resolve": """WITH q AS (SELECT p_partkey, lower(replace(p_brand, '#', '')) || '/' || replace(p_name, ' ', '_') || p_partkey AS stem, ['.ts', '.tsx', '/index.ts'][p_size % 3 + 1] AS e FROM part)
        SELECT a.stem || a.e AS src_path, '../' || b.stem AS spec, b.stem || b.e AS dst FROM q a JOIN q b ON b.p_partkey = a.p_partkey + 1 WHERE a.e <> '/index.ts'""",
    "evidence_parse": "SELECT doc_id, coalesce(CAST(n_chars AS VARCHAR), '') AS chars, 'a: ' || coalesce(source, '') AS pair, CAST(2 AS BIGINT) AS n FROM documents",
    "findings_all": f"{ALL} SELECT path, kind, severity, confidence, estimated_tokens FROM found",
    "ranked_findings": f"{ALL} SELECT id, path, kind, severity FROM named",
    "kind_severity_pivot": f"""{ALL} SELECT kind, count(CASE WHEN severity = 'Critical' THEN 1 END) AS "Critical", count(CASE WHEN severity = 'High' THEN 1 END) AS "High",
        count(CASE WHEN severity = 'Medium' THEN 1 END) AS "Medium", count(CASE WHEN severity = 'Low' THEN 1 END) AS "Low" FROM found GROUP BY kind""",
    "topk_per_kind": f"{ALL} SELECT kind, path, severity, nth, greatest(count_all - 5, 0) AS more FROM (SELECT *, count(*) OVER (PARTITION BY kind) AS count_all FROM ranked) WHERE nth <= 5",
    "priority_targets": f"{ALL} SELECT kind, path, severity FROM found WHERE severity IN ('Critical', 'High') ORDER BY {WEIGHT} DESC, kind, path LIMIT 5",
    "global_score": f"""{ALL} SELECT {_score("true")} AS ai_friction_score, {_score("kind = 'context-bomb'")} AS context_waste_score, {_score("kind IN ('dead-weight', 'code-duplication')")} AS structural_entropy_score,
        {_score("kind IN ('branch-density', 'comment-ratio', 'dangerous-pattern')")} AS reasoning_complexity_score, (SELECT sum(size_bytes // 4) FROM facts) / 128000.0::DOUBLE AS context_waste_ratio,
        CAST(least(round((SELECT sum(size_bytes // 4) / greatest(count(*) * 128000, 1)::DOUBLE * 100 FROM facts)), 100) AS INTEGER) AS estimated_waste_pct FROM found""",
    "score_rollup": f"{ALL} SELECT {BUCKET} AS bucket, count(*) AS n_findings, CAST(sum(CAST({WEIGHT} * CAST(confidence AS DECIMAL(18,6)) AS DECIMAL(18,6))) AS DOUBLE) AS weighted FROM found GROUP BY ROLLUP (1)",
    "profile_compare": f"""WITH {DOCS}, r AS ({_profile("strict", _row_rules(15, 8, 0.03, 0.20, 3))} UNION ALL {_profile("relaxed", _row_rules(50, 16, 0.01, 0.40, 10))}),
        n AS (SELECT kind, path, count(CASE WHEN report = 'strict' THEN 1 END) AS strict, count(CASE WHEN report = 'relaxed' THEN 1 END) AS relaxed FROM r GROUP BY kind, path) SELECT * FROM n WHERE strict <> relaxed""",
    "report_tsv": f"{ALL} SELECT concat_ws(chr(9), id, severity[1], {CODE}, path, CAST(CAST(round(confidence * 100) AS INTEGER) AS VARCHAR), coalesce(CAST(estimated_tokens AS VARCHAR), '')) AS line FROM named",
    "explain_largest": f"WITH {DOCS} SELECT path, line_count, size_bytes, comment_line_count, branch_count, function_count FROM facts WHERE size_bytes = (SELECT max(size_bytes) FROM facts)",
}
