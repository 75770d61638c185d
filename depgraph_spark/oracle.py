"""Check queries: plain SQL for DuckDB over the given tables, written independently of the Spark jobs."""

from __future__ import annotations

from .fixtures import COMMIT_CTES, GATE_CTES, LANGS, LISTING_CTES, duck, graph_ctes

GRAPH = graph_ctes()

# Reachability against the edges with the first level a pair is seen at; rows are keyed by (start, node).
CLOSURE = """
closure(repo, start, node, level) USING KEY (repo, start, node) AS (
  SELECT repo, dst, src, 1 FROM edges WHERE src <> dst
  UNION
  SELECT t.repo, t.start, e.src, min(t.level) + 1
  FROM closure t JOIN edges e ON e.repo = t.repo AND e.dst = t.node
  LEFT JOIN recurring.closure r ON r.repo = t.repo AND r.start = t.start AND r.node = e.src
  WHERE r.node IS NULL AND e.src <> t.start GROUP BY 1, 2, 3)"""

# Components by mutual reachability.
SCC = """
mutual AS (
  SELECT a.repo, a.start AS path, least(a.start, min(a.node)) AS comp
  FROM closure a JOIN closure b ON a.repo = b.repo AND a.start = b.node AND a.node = b.start GROUP BY a.repo, a.start),
scc AS MATERIALIZED (SELECT f.repo, f.path, coalesce(m.comp, f.path) AS comp
  FROM files f LEFT JOIN mutual m ON f.repo = m.repo AND f.path = m.path),
sizes AS (SELECT repo, comp, count(*) AS size FROM scc GROUP BY repo, comp),
comp_edges AS MATERIALIZED (
  SELECT DISTINCT e.repo, a.comp AS s, b.comp AS d FROM edges e
  JOIN scc a ON a.repo = e.repo AND a.path = e.src JOIN scc b ON b.repo = e.repo AND b.path = e.dst
  WHERE a.comp <> b.comp)"""

COMP_REACH = """
comp_reach(repo, start, node, level) USING KEY (repo, start, node) AS (
  SELECT repo, d, s, 1 FROM comp_edges
  UNION
  SELECT t.repo, t.start, e.s, min(t.level) + 1
  FROM comp_reach t JOIN comp_edges e ON e.repo = t.repo AND e.d = t.node
  LEFT JOIN recurring.comp_reach r ON r.repo = t.repo AND r.start = t.start AND r.node = e.s
  WHERE r.node IS NULL GROUP BY 1, 2, 3)"""

DEGREES = """
fan_in AS (SELECT repo, dst AS path, count(*) AS fan_in, sum(n_refs) AS n_refs_in FROM edges GROUP BY repo, dst),
fan_out AS (SELECT repo, src AS path, count(*) AS fan_out FROM edges GROUP BY repo, src),
degrees AS (SELECT f.repo, f.path, coalesce(i.fan_in, 0) AS fan_in, coalesce(o.fan_out, 0) AS fan_out,
    CAST(coalesce(i.n_refs_in, 0) AS BIGINT) AS n_refs_in
  FROM files f LEFT JOIN fan_in i ON f.repo = i.repo AND f.path = i.path
  LEFT JOIN fan_out o ON f.repo = o.repo AND f.path = o.path)"""

LEVELS = """
walk(repo, node, level) AS (
  SELECT repo, comp, 0 FROM sizes
  UNION
  SELECT e.repo, e.s, w.level + 1 FROM walk w JOIN comp_edges e ON e.repo = w.repo AND e.d = w.node)"""


def risk(count: str) -> str:
    return f"CASE WHEN {count} >= 10 THEN 'HIGH' WHEN {count} >= 5 THEN 'MEDIUM' WHEN {count} >= 1 THEN 'LOW' ELSE 'NONE' END"


def graph(select: str, *ctes: str) -> str:
    """A check query over the graph; a ``select`` that begins with a comma continues the list of CTEs."""
    return duck(",".join([GRAPH, *ctes]), select, recursive=bool(ctes))


def listing(select: str, *ctes: str) -> str:
    return duck(",".join([LISTING_CTES, *ctes]), select)


IMPACT_TOTALS = """
outer_reach AS (SELECT r.repo, r.start AS comp, sum(z.size) AS others, max(r.level) AS depth
  FROM comp_reach r JOIN sizes z ON z.repo = r.repo AND z.comp = r.node GROUP BY r.repo, r.start),
totals AS MATERIALIZED (SELECT c.repo, c.path AS file, z.size AS cluster_size, coalesce(o.depth, 0) AS cascade_depth,
    CAST(coalesce(o.others, 0) + z.size - 1 AS BIGINT) AS total_impacted
  FROM scc c JOIN sizes z ON z.repo = c.repo AND z.comp = c.comp
  LEFT JOIN outer_reach o ON o.repo = c.repo AND o.comp = c.comp)"""


def traversal_sql() -> dict[str, str]:
    q = {}
    q["transitive_dependents"] = graph(
        "SELECT repo, start AS file, node AS impacted, level FROM closure", CLOSURE
    )
    q["check_safe"] = graph(
        f"""SELECT f.repo, f.path AS file, coalesce(c.total, 0) AS total_impacted, coalesce(c.direct, 0) AS direct,
          CAST(coalesce(r.n_refs, 0) AS BIGINT) AS n_refs, {risk("coalesce(c.total, 0)")} AS risk_level
        FROM files f
        LEFT JOIN (SELECT repo, start, count(*) AS total, count(*) FILTER (level = 1) AS direct
                   FROM closure GROUP BY repo, start) c ON c.repo = f.repo AND c.start = f.path
        LEFT JOIN (SELECT repo, dst, sum(n_refs) AS n_refs FROM edges GROUP BY repo, dst) r
          ON r.repo = f.repo AND r.dst = f.path""",
        CLOSURE,
    )
    q["scc"] = graph("SELECT repo, path, comp FROM scc", CLOSURE, SCC)
    q["condensed_dag"] = graph(
        """SELECT e.repo, e.s AS src_comp, e.d AS dst_comp, a.size > 1 AS src_cyclic, b.size > 1 AS dst_cyclic
        FROM comp_edges e JOIN sizes a ON a.repo = e.repo AND a.comp = e.s JOIN sizes b ON b.repo = e.repo AND b.comp = e.d""",
        CLOSURE, SCC,
    )
    q["cyclic_clusters"] = graph(
        """SELECT c.repo, c.comp, c.path AS member, z.size FROM scc c
        JOIN sizes z ON z.repo = c.repo AND z.comp = c.comp WHERE z.size > 1""",
        CLOSURE, SCC,
    )
    q["bounded_cycles"] = graph(
        """, cycles AS (
          SELECT a.repo, 2 AS length, concat(a.src, ' -> ', a.dst) AS cycle
          FROM edges a JOIN edges b ON b.repo = a.repo AND b.src = a.dst AND b.dst = a.src WHERE a.src < a.dst
          UNION ALL
          SELECT a.repo, 3, concat(a.src, ' -> ', a.dst, ' -> ', b.dst)
          FROM edges a JOIN edges b ON b.repo = a.repo AND b.src = a.dst
          JOIN edges c ON c.repo = b.repo AND c.src = b.dst AND c.dst = a.src
          WHERE a.src < a.dst AND a.src < b.dst AND a.dst <> b.dst)
        SELECT repo, length, cycle FROM cycles"""
    )
    q["impact"] = graph(
        """, levels AS (
          SELECT repo, start, node, level FROM comp_reach
          UNION ALL SELECT repo, comp, comp, 0 FROM sizes WHERE size > 1)
        SELECT a.repo, a.path AS file, b.path AS impacted, l.level, l.level = 0 OR e.src IS NOT NULL AS is_direct
        FROM levels l JOIN scc a ON a.repo = l.repo AND a.comp = l.start JOIN scc b ON b.repo = l.repo AND b.comp = l.node
        LEFT JOIN edges e ON e.repo = a.repo AND e.dst = a.path AND e.src = b.path WHERE a.path <> b.path""",
        CLOSURE, SCC, COMP_REACH,
    )
    q["impact_summary_all"] = graph(
        f""", direct AS (
          SELECT e.repo, e.dst AS file, count(*) AS outside FROM edges e
          JOIN scc a ON a.repo = e.repo AND a.path = e.src JOIN scc b ON b.repo = e.repo AND b.path = e.dst
          WHERE a.comp <> b.comp GROUP BY e.repo, e.dst)
        SELECT t.repo, t.file, t.total_impacted, coalesce(d.outside, 0) + t.cluster_size - 1 AS direct,
          t.total_impacted - (coalesce(d.outside, 0) + t.cluster_size - 1) AS transitive,
          t.cascade_depth, t.cluster_size, {risk("t.total_impacted")} AS risk_level
        FROM totals t LEFT JOIN direct d ON d.repo = t.repo AND d.file = t.file""",
        CLOSURE, SCC, COMP_REACH, IMPACT_TOTALS,
    )
    q["cascade_depth"] = graph(
        "SELECT repo, file, cascade_depth FROM totals", CLOSURE, SCC, COMP_REACH, IMPACT_TOTALS
    )
    q["topological_levels"] = graph(
        "SELECT repo, node AS comp, max(level) AS level FROM walk GROUP BY repo, node", CLOSURE, SCC, LEVELS
    )
    return q


def graph_sql() -> dict[str, str]:
    q = {"dependency_edges": graph("SELECT repo, src, dst, n_refs FROM edges")}
    for lang in LANGS:
        q[f"imports_{lang}"] = duck(graph_ctes(lang), "SELECT repo, src, dst, n_refs FROM edges")
    q["imports_typescript_alias"] = q["imports_typescript"]
    q["register_language"] = duck(
        graph_ctes("ruby"), "SELECT repo, concat(src, 'x') AS src, concat(dst, 'x') AS dst, n_refs FROM edges"
    )
    q["reverse_dependencies"] = graph("SELECT repo, dst AS file, src AS importer, n_refs FROM edges")
    q["forward_dependencies"] = graph(
        "SELECT repo, src AS file, dst AS dependency, n_refs FROM edges"
    )
    q["direct_dependents"] = graph(
        "SELECT repo, dst AS file, src AS dependent, n_refs FROM edges"
    )
    q["isolated_files"] = graph(
        """SELECT f.repo, f.path FROM files f WHERE NOT EXISTS (
          SELECT 1 FROM edges e WHERE e.repo = f.repo AND (e.src = f.path)) AND NOT EXISTS (
          SELECT 1 FROM edges e WHERE e.repo = f.repo AND (e.dst = f.path))"""
    )
    q["unknown_files"] = duck(
        GRAPH + "," + LISTING_CTES,
        """SELECT DISTINCT l.repo, l.path AS file FROM listing l WHERE NOT EXISTS (
          SELECT 1 FROM files f WHERE f.repo = l.repo AND f.path = l.path)""",
    )
    q["degrees"] = graph("SELECT * FROM degrees", DEGREES)
    q["instability"] = graph(
        """SELECT *, CASE WHEN fan_in + fan_out > 0 THEN fan_out / CAST(fan_in + fan_out AS DOUBLE) END AS instability
        FROM degrees""",
        DEGREES,
    )
    q["hub_files"] = graph(
        f"""SELECT repo, path, fan_in AS dependents, {risk("fan_in")} AS risk_level, rank FROM (
          SELECT *, row_number() OVER (PARTITION BY repo ORDER BY fan_in DESC, path) AS rank FROM degrees) AS r
        WHERE rank <= 10""",
        DEGREES,
    )
    q["graph_stats"] = graph(
        """SELECT f.repo, f.files, e.edges, CAST(e.import_lines AS BIGINT) AS import_lines, c.components, c.cyclic_components,
          l.lang AS languages
        FROM (SELECT repo, count(*) AS files FROM files GROUP BY repo) f
        JOIN (SELECT repo, count(*) AS edges, sum(n_refs) AS import_lines FROM edges GROUP BY repo) e ON e.repo = f.repo
        JOIN (SELECT repo, count(*) AS components, count(*) FILTER (size > 1) AS cyclic_components FROM sizes GROUP BY repo) c
          ON c.repo = f.repo
        JOIN (SELECT DISTINCT repo, lang FROM files) l ON l.repo = f.repo""",
        CLOSURE, SCC,
    )
    return q



# --- file selection ---

EXTENSIONS = """
exts AS (SELECT * FROM (VALUES ('dart', '.dart'), ('typescript', '.ts'), ('typescript', '.tsx'), ('typescript', '.js'),
  ('typescript', '.jsx'), ('python', '.py'), ('go', '.go'), ('rust', '.rs'), ('java', '.java'), ('cpp', '.cpp'),
  ('cpp', '.cc'), ('cpp', '.cxx'), ('cpp', '.c'), ('cpp', '.h'), ('cpp', '.hpp'), ('cpp', '.hxx'), ('ruby', '.rb'))
  AS x(lang, ext))"""
SKIPPED = (
    "['node_modules', '.git', 'dist', 'build', '.dart_tool', '.pub-cache', '__pycache__', '.mypy_cache', "
    "'.pytest_cache', 'venv', '.venv', 'target', 'vendor', '.gradle', 'bin', 'obj', '.next', 'out', '.nuxt', '.output']"
)
SPLIT = """
parts AS (SELECT repo, path, string_split(path, '/') AS seg, string_split(path, '/')[:-2] AS folders FROM listing)"""
DETECTED = f"""
known_manifests AS (SELECT * FROM (VALUES ('dart', 'pubspec.yaml', 0), ('typescript', 'tsconfig.json', 1),
  ('typescript', 'package.json', 1), ('python', 'pyproject.toml', 1), ('python', 'requirements.txt', 1),
  ('python', 'setup.py', 1), ('python', 'setup.cfg', 1), ('go', 'go.mod', 0), ('rust', 'Cargo.toml', 0),
  ('java', 'pom.xml', 0), ('java', 'build.gradle', 0), ('java', 'build.gradle.kts', 0), ('cpp', 'CMakeLists.txt', 0),
  ('cpp', 'Makefile', 0), ('cpp', 'meson.build', 0), ('ruby', 'Gemfile', 0)) AS k(lang, name, depth)),
detected AS (SELECT DISTINCT p.repo, k.lang FROM parts p JOIN known_manifests k ON p.seg[-1] = k.name
  WHERE len(p.folders) = 0 OR (len(p.folders) = 1 AND k.depth = 1 AND NOT starts_with(p.folders[1], '.')
    AND NOT list_contains({SKIPPED}, p.folders[1])))"""
MARKERS = (
    "('.git', 'pubspec.yaml', 'package.json', 'tsconfig.json', 'pyproject.toml', 'requirements.txt', 'setup.py', "
    "'go.mod', 'Cargo.toml', 'pom.xml', 'build.gradle', 'CMakeLists.txt', 'Makefile', 'Gemfile')"
)


def listing_sql() -> dict[str, str]:
    q = {}
    q["discover_files"] = listing(
        f"""SELECT p.repo, p.path, x.lang FROM parts p JOIN exts x ON ends_with(p.path, x.ext)
        WHERE NOT list_has_any(p.folders, {SKIPPED}) AND NOT (x.lang = 'typescript' AND ends_with(p.path, '.d.ts'))
          AND NOT (x.lang = 'go' AND ends_with(p.path, '_test.go'))""",
        EXTENSIONS, SPLIT,
    )
    q["language_of_file"] = listing(
        """SELECT p.repo, p.path, p.ext, x.lang FROM (
          SELECT repo, path, lower(CASE WHEN contains(path, '.') THEN concat('.', string_split(path, '.')[-1]) ELSE '' END) AS ext
          FROM listing) p LEFT JOIN exts x ON x.ext = p.ext""",
        EXTENSIONS,
    )
    q["detect_languages"] = listing(
        "SELECT repo, string_agg(lang, '+' ORDER BY lang) AS languages FROM detected GROUP BY repo", SPLIT, DETECTED
    )
    q["project_roots"] = listing(
        f"""SELECT p.repo, p.path, coalesce(max_by(m.dir, length(m.dir)), array_to_string(p.folders, '/')) AS root
        FROM parts p LEFT JOIN (SELECT DISTINCT repo, array_to_string(folders, '/') AS dir FROM parts WHERE seg[-1] IN {MARKERS}) m
          ON m.repo = p.repo AND (m.dir = '' OR starts_with(p.path, concat(m.dir, '/')))
        GROUP BY p.repo, p.path, p.folders""",
        SPLIT,
    )
    q["source_dirs"] = listing(
        rf"""SELECT DISTINCT p.repo, d.lang, CASE WHEN len(p.folders) = 0 THEN '' ELSE p.folders[1] END AS source_dir
        FROM parts p JOIN exts x ON ends_with(p.path, x.ext) JOIN detected d ON d.repo = p.repo AND d.lang = x.lang
        WHERE d.lang IN ('typescript', 'python') AND NOT list_has_any(p.folders, {SKIPPED})
          AND NOT regexp_matches(concat('/', p.path), '/\.[^/]*/')
        UNION ALL SELECT repo, lang, '' FROM detected WHERE lang = 'go'
        UNION ALL SELECT d.repo, d.lang, f.dir FROM detected d
          JOIN (VALUES ('dart', 'lib', 0), ('rust', 'src', 0), ('java', 'src/main/java', 0), ('java', 'src', 1),
            ('cpp', 'src', 0), ('cpp', 'include', 0), ('ruby', 'lib', 0)) AS f(lang, dir, pref) ON f.lang = d.lang
          WHERE EXISTS (SELECT 1 FROM parts p WHERE p.repo = d.repo AND starts_with(p.path, concat(f.dir, '/')))
            AND NOT (f.pref = 1 AND EXISTS (SELECT 1 FROM parts p WHERE p.repo = d.repo AND starts_with(p.path, 'src/main/java/')))
        UNION ALL SELECT d.repo, d.lang, '' FROM detected d WHERE d.lang IN ('cpp', 'ruby', 'python')
          AND NOT EXISTS (SELECT 1 FROM parts p WHERE p.repo = d.repo AND (
            (d.lang = 'cpp' AND (starts_with(p.path, 'src/') OR starts_with(p.path, 'include/')))
            OR (d.lang = 'ruby' AND starts_with(p.path, 'lib/'))
            OR (d.lang = 'python' AND ends_with(p.path, '.py') AND NOT list_has_any(p.folders, {SKIPPED})
                AND NOT regexp_matches(concat('/', p.path), '/\.[^/]*/'))))""",
        EXTENSIONS, SPLIT, DETECTED,
    )
    lang = fx_lang("n_nationkey")
    app = "concat('nation_', n_nationkey)"
    q["package_names"] = (
        f"SELECT concat('repo', n_nationkey) AS repo, {lang} AS lang, CASE {lang} WHEN 'go' THEN concat('example.org/', {app}) "
        f"WHEN 'java' THEN concat('org.', {app}) ELSE {app} END AS package FROM nation"
    )
    q["path_aliases"] = (
        "SELECT concat('repo', n_nationkey) AS repo, a.ord, a.prefix, a.target_ord, a.target FROM nation, "
        "(VALUES (0, '#x/', 0, 'none'), (1, '@/', 0, 'gen'), (1, '@/', 1, 'src')) AS a(ord, prefix, target_ord, target) "
        f"WHERE {lang} = 'typescript'"
    )
    q["scan_source_files"] = "SELECT source AS repo, doc_id, concat(text, chr(10)) AS content FROM documents"
    q["write_graph"] = graph("SELECT repo, src, dst, n_refs FROM edges")
    q["normalize_path"] = graph("SELECT repo, path FROM files")
    q["relative_path"] = listing(
        """SELECT repo, path, CASE WHEN starts_with(path, 'src/') THEN substring(path, 5) ELSE concat('../', path) END AS relative
        FROM listing"""
    )
    q["resolve_request_path"] = listing(
        """SELECT repo, path, CASE WHEN starts_with(path, 'src/') THEN concat('app/', path) ELSE concat('app/src/', path) END
          AS resolved FROM listing"""
    )
    return q


def fx_lang(nation: str) -> str:
    return f"CASE {nation} % 8 " + " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(LANGS)) + " END"


# --- row functions ---


def complexity(lang: str, text: str) -> str:
    c_comments, c_words = ("//", "/*", "*"), ("if", "for", "while", "case", "catch")
    rules = {
        "go": (c_comments, ("if", "for", "case", "select"), ("&&", "||")),
        "rust": (c_comments, ("if", "for", "while", "match", "loop"), ("&&", "||", "?")),
        "python": (("#",), ("if", "elif", "for", "while", "except", "and", "or"), ()),
        "ruby": (
            ("#",), ("if", "elsif", "unless", "for", "while", "until", "when", "rescue", "and", "or"), ("&&", "||", "?"),
        ),
    }
    comments, words, operators = rules.get(lang, (c_comments, c_words, ("&&", "||", "?")))
    kept = " AND ".join(f"NOT starts_with(ltrim(replace(l, chr(9), ' ')), '{c}')" for c in comments)
    code = f"array_to_string(list_filter(string_split({text}, chr(10)), lambda l: {kept}), chr(10))"
    listed = ", ".join(f"'{w}'" for w in words)
    total = f"1 + len(list_filter(regexp_split_to_array({code}, '[^A-Za-z0-9_]+'), lambda w: w IN ({listed})))"
    for op in operators:
        total += f" + (length({code}) - length(replace({code}, '{op}', ''))) // {len(op)}"
    return f"CAST({total} AS BIGINT)"


TS_LAYER = """CASE
  WHEN ends_with(name, '.jsx') OR ends_with(name, '.tsx') OR contains(p, 'components/') OR contains(p, 'web/public/') THEN 'FE'
  WHEN ends_with(name, 'server.ts') OR ends_with(name, 'server.js') OR contains(p, 'web/server') THEN 'API'
  WHEN ends_with(name, '.model.ts') OR ends_with(name, '.entity.ts') OR ends_with(name, '.schema.ts') THEN 'DB'
  WHEN ends_with(name, '.service.ts') OR ends_with(name, '.controller.ts') OR contains(p, 'tools/') OR contains(p, 'ai/')
    OR contains(p, 'watcher/') THEN 'BE'
  WHEN name IN ('index.ts', 'index.js') OR ends_with(name, '.config.ts') OR ends_with(name, '.config.js') THEN 'CONFIG'
  WHEN ends_with(name, '.util.ts') OR ends_with(name, '.helper.ts') THEN 'UTIL' END"""
DART_LAYER = r"""CASE
  WHEN regexp_matches(p, '/(presentation|widgets|screens|pages)/')
    OR regexp_matches(name, '_(screen|page|widget|dialog|view|card|tile|form|bottom_sheet)\.dart$') THEN 'FE'
  WHEN regexp_matches(p, '/(data|domain|application|providers|notifiers)/')
    OR regexp_matches(name, '_(repository|service|provider|notifier|controller|usecase|state|bloc|cubit)\.dart$') THEN 'BE'
  WHEN regexp_matches(p, '/(models|entities)/') OR regexp_matches(name, '_(model|entity|dto)\.dart$') THEN 'DB'
  WHEN contains(p, '/api/') OR regexp_matches(name, 'cloud_function|_(api|client|remote)\.dart$|_datasource|_data_source') THEN 'API'
  WHEN regexp_matches(p, '/(config|theme|router|routing)/')
    OR regexp_matches(name, '_(config|theme|constants|routes)\.dart$|^main\.dart$') THEN 'CONFIG'
  WHEN regexp_matches(p, '/(utils|helpers|extensions)/|shared/')
    OR regexp_matches(name, '_(util|helper|extension|mixin)\.dart$') THEN 'UTIL' END"""


def scalar_sql() -> dict[str, str]:
    q = {}
    q["classify_risk"] = graph(
        f"SELECT repo, path, fan_in, {risk('fan_in')} AS risk_level FROM degrees", DEGREES
    )
    q["map_severity"] = duck(
        ",".join([GRAPH, GATE_CTES]),
        """SELECT repo, id, risk_level, CASE WHEN risk_level IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW') THEN risk_level END AS severity
        FROM warnings""",
    )
    named = "FROM (SELECT repo, path, lower(path) AS p, string_split(lower(path), '/')[-1] AS name FROM listing) AS l"
    q["classify_layer_typescript"] = listing(f"SELECT repo, path, {TS_LAYER} AS layer {named}")
    q["classify_layer_dart"] = listing(f"SELECT repo, path, {DART_LAYER} AS layer {named}")
    q["cyclomatic_complexity"] = " UNION ALL ".join(
        f"SELECT doc_id, '{lang}' AS rules, {complexity(lang, 'text')} AS complexity FROM documents" for lang in LANGS
    )
    return q


# --- ranks and scores ---


def _pagerank_ctes() -> str:
    steps = [
        """
out_deg AS MATERIALIZED (SELECT repo, src, count(*) AS deg FROM edges WHERE src <> dst GROUP BY repo, src),
repo_n AS MATERIALIZED (SELECT repo, CAST(count(*) AS DOUBLE) AS n FROM files GROUP BY repo),
flow AS MATERIALIZED (SELECT e.repo, e.src, e.dst, 1.0::DOUBLE / o.deg AS w FROM edges e
  JOIN out_deg o ON o.repo = e.repo AND o.src = e.src WHERE e.src <> e.dst),
pr0 AS MATERIALIZED (SELECT f.repo, f.path, 1.0::DOUBLE / n.n AS pr, o.src IS NULL AS sink FROM files f
  JOIN repo_n n ON n.repo = f.repo LEFT JOIN out_deg o ON o.repo = f.repo AND o.src = f.path)"""
    ]
    for i in range(20):
        steps.append(
            f"""
pr{i + 1} AS MATERIALIZED (SELECT p.repo, p.path, p.sink,
    (1 - 0.85::DOUBLE) / n.n + 0.85::DOUBLE * (coalesce(g.x, 0) + coalesce(s.idle, 0) / n.n) AS pr
  FROM pr{i} p JOIN repo_n n ON n.repo = p.repo
  LEFT JOIN (SELECT f.repo, f.dst, sum(q.pr * f.w) AS x FROM flow f JOIN pr{i} q ON q.repo = f.repo AND q.path = f.src
             GROUP BY f.repo, f.dst) g ON g.repo = p.repo AND g.dst = p.path
  LEFT JOIN (SELECT repo, sum(pr) AS idle FROM pr{i} WHERE sink GROUP BY repo) s ON s.repo = p.repo)"""
        )
    steps.append(
        """
ranked AS MATERIALIZED (SELECT repo, path, pagerank, rank() OVER (PARTITION BY repo ORDER BY pagerank DESC) AS rank,
    count(*) OVER (PARTITION BY repo) AS n
  FROM (SELECT repo, path, round(pr, 9) AS pagerank FROM pr20) AS r)"""
    )
    return ",".join(steps)


PAGERANK = _pagerank_ctes()
PERCENTILE = "CASE WHEN n > 1 THEN CAST(floor(100.0::DOUBLE * (n - rank) / (n - 1) + 0.5) AS BIGINT) ELSE 0 END"


def _scores_cte() -> str:
    cases = " ".join(f"WHEN '{lang}' THEN {complexity(lang, 'd.text')}" for lang in LANGS)
    return f"""
complexities AS (SELECT f.repo, f.path, CASE WHEN d.text IS NULL THEN 1 ELSE CASE f.lang {cases} END END AS complexity
  FROM files f LEFT JOIN documents d ON f.name = concat('o', d.doc_id)),
signals AS (SELECT g.repo, g.path, t.total_impacted AS transitive_fan_in, g.fan_in, g.fan_out,
    CASE WHEN g.fan_in + g.fan_out > 0 THEN g.fan_out / CAST(g.fan_in + g.fan_out AS DOUBLE) END AS instability,
    c.complexity, t.cascade_depth, r.pagerank,
    CASE WHEN r.n > 1 THEN (r.n - r.rank) / CAST(r.n - 1 AS DOUBLE) ELSE 0 END AS position
  FROM degrees g JOIN totals t ON t.repo = g.repo AND t.file = g.path
  JOIN ranked r ON r.repo = g.repo AND r.path = g.path JOIN complexities c ON c.repo = g.repo AND c.path = g.path),
tops AS (SELECT repo, max(transitive_fan_in) AS mi, max(complexity) AS mc, max(cascade_depth) AS md FROM signals GROUP BY repo),
scores AS MATERIALIZED (SELECT s.* EXCLUDE (position), round(
    0.30::DOUBLE * CASE WHEN mi > 0 THEN transitive_fan_in / CAST(mi AS DOUBLE) ELSE 0 END
    + 0.20::DOUBLE * coalesce(1 - instability, 0)
    + 0.20::DOUBLE * CASE WHEN mc > 0 THEN complexity / CAST(mc AS DOUBLE) ELSE 0 END
    + 0.15::DOUBLE * CASE WHEN md > 0 THEN cascade_depth / CAST(md AS DOUBLE) ELSE 0 END
    + 0.15::DOUBLE * position, 6) AS composite FROM signals s JOIN tops ON tops.repo = s.repo),
levelled AS (SELECT *, CASE WHEN composite >= 0.8 THEN 'CRITICAL' WHEN composite >= 0.6 THEN 'HIGH'
    WHEN composite >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
    CASE WHEN composite < 0.3 THEN 'proceed' WHEN composite <= 0.7 THEN 'warn' ELSE 'block' END AS action FROM scores)"""


def rank_sql() -> dict[str, str]:
    scores = (CLOSURE, SCC, COMP_REACH, IMPACT_TOTALS, DEGREES, PAGERANK, _scores_cte())
    return {
        "pagerank": graph("SELECT repo, path, pagerank FROM ranked", PAGERANK),
        "pagerank_percentile": graph(
            f"SELECT repo, path, pagerank, rank, n, {PERCENTILE} AS percentile FROM ranked", PAGERANK
        ),
        "risk_score": graph("SELECT * FROM levelled", *scores),
        "risk_action": graph("SELECT repo, path, composite, action FROM levelled", *scores),
        "hub_files_pagerank": graph(
            f"""SELECT r.repo, r.path, r.position, r.pagerank, r.percentile, s.fan_in AS dependents, s.composite AS risk_score,
              s.risk_level FROM (SELECT *, {PERCENTILE} AS percentile,
                row_number() OVER (PARTITION BY repo ORDER BY pagerank DESC, path) AS position FROM ranked) r
            JOIN levelled s ON s.repo = r.repo AND s.path = r.path WHERE r.position <= 10""",
            *scores,
        ),
    }


# --- coupling ---


def coupling_ctes(max_files: int) -> str:
    return f"""{COMMIT_CTES},
kept AS MATERIALIZED (SELECT repo, commit_id, file FROM commit_files WHERE (repo, commit_id) IN (
  SELECT (repo, commit_id) FROM commit_files GROUP BY repo, commit_id HAVING count(*) <= {max_files})),
pairs AS MATERIALIZED (SELECT a.repo, a.file AS file1, b.file AS file2, count(*) AS co_changes FROM kept a
  JOIN kept b ON a.repo = b.repo AND a.commit_id = b.commit_id AND a.file < b.file GROUP BY 1, 2, 3),
per_file AS (SELECT repo, file, count(*) AS commits FROM kept GROUP BY repo, file),
coupling AS MATERIALIZED (SELECT p.repo, p.file, p.other, p.co_changes, p.co_changes / CAST(f.commits AS DOUBLE) AS confidence
  FROM (SELECT repo, file1 AS file, file2 AS other, co_changes FROM pairs
        UNION ALL SELECT repo, file2, file1, co_changes FROM pairs) p
  JOIN per_file f ON f.repo = p.repo AND f.file = p.file),
neighbours AS MATERIALIZED (SELECT repo, src AS file, dst AS other FROM edges UNION SELECT repo, dst, src FROM edges)"""


COUPLING = coupling_ctes(20)


def coupling_sql() -> dict[str, str]:
    def sql(select: str, ctes: str = COUPLING) -> str:
        return duck(",".join([GRAPH, ctes]), select)

    return {
        "mega_commit_filter": sql("SELECT repo, commit_id, file FROM kept"),
        "co_change_pairs": sql("SELECT repo, file1, file2, co_changes FROM pairs"),
        "change_coupling": sql(
            """SELECT c.*, n.file IS NOT NULL AS in_graph FROM coupling c
            LEFT JOIN neighbours n ON n.repo = c.repo AND n.file = c.file AND n.other = c.other"""
        ),
        "hidden_coupling": sql(
            """SELECT * FROM coupling c WHERE NOT EXISTS (SELECT 1 FROM neighbours n
              WHERE n.repo = c.repo AND n.file = c.file AND n.other = c.other)"""
        ),
        "coupling_percent": sql(
            """SELECT repo, file, other, CAST(floor(confidence * 100 + 0.5) AS BIGINT) AS percent,
              CASE WHEN confidence >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM coupling WHERE confidence >= 0.3"""
        ),
        "recent_commits": duck(
            ",".join([GRAPH, COMMIT_CTES]),
            """SELECT repo, commit_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY ts DESC, commit_id DESC) AS rn
            FROM commits) AS c WHERE rn <= 500""",
        ),
    }


# --- gate ---

OPEN = "open_warnings AS (SELECT * FROM warnings w WHERE NOT EXISTS (SELECT 1 FROM acks a WHERE a.repo = w.repo AND a.id = w.id))"

# Warnings named in other ways than by the graph path: cut short, cut to the name or digits, or longer than the path.
RENAMED = """
renamed AS (SELECT repo, id, CASE
    WHEN risk_level = 'HIGH' THEN string_split(file, '/')[-1]
    WHEN risk_level = 'MEDIUM' THEN concat('home/', file)
    WHEN risk_level = 'LOW' THEN substring(file, 5)
    WHEN risk_level = 'SAFE' THEN concat('x', file) ELSE file END AS file FROM open_warnings)"""

SETS = """
change_sets AS (SELECT DISTINCT repo, change_id, TRUE AS has_files FROM changes
  UNION ALL SELECT concat('repo', n_nationkey), -1, FALSE FROM {nation}
  UNION ALL SELECT concat('repo', n_nationkey), -2, TRUE FROM {nation})"""

COUPLING_ISSUES = """
coupling_issues AS (SELECT c.repo, c.change_id, c.file, CASE WHEN k.confidence >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
    'coupling' AS kind, concat('Historical coupling: ', k.other, ' changes with this file in ',
      CAST(floor(k.confidence * 100 + 0.5) AS BIGINT), '% of commits (', k.co_changes, ' times) -- consider reviewing') AS description
  FROM changes c JOIN coupling k ON k.repo = c.repo AND k.file = c.file AND k.confidence >= 0.3
  WHERE NOT EXISTS (SELECT 1 FROM changes o WHERE o.repo = c.repo AND o.change_id = c.change_id AND o.file = k.other)
    AND NOT EXISTS (SELECT 1 FROM neighbours n WHERE n.repo = k.repo AND n.file = k.file AND n.other = k.other))"""

ISSUES = """
matched AS MATERIALIZED (
  SELECT DISTINCT c.repo, c.change_id, w.id FROM changes c JOIN open_warnings w ON w.repo = c.repo AND w.file = c.file
  UNION ALL SELECT s.repo, s.change_id, w.id FROM change_sets s JOIN open_warnings w ON w.repo = s.repo WHERE NOT s.has_files),
warning_issues AS (SELECT m.repo, m.change_id, w.file, w.risk_level AS severity, 'warning' AS kind,
    concat(w.summary, CASE WHEN broken_import IS NULL THEN '' ELSE concat(' (broken imports: ', broken_import, ')') END) AS description
  FROM matched m JOIN open_warnings w ON w.repo = m.repo AND w.id = m.id WHERE w.risk_level <> 'SAFE'),
cyclic AS MATERIALIZED (SELECT c.repo, c.comp, c.path, z.size FROM scc c JOIN sizes z ON z.repo = c.repo AND z.comp = c.comp WHERE z.size > 1),
touched AS MATERIALIZED (SELECT c.repo, c.change_id, y.comp, min(c.file) AS file, max(y.size) AS size
  FROM changes c JOIN cyclic y ON y.repo = c.repo AND y.path = c.file GROUP BY c.repo, c.change_id, y.comp),
cycle_issues AS (SELECT repo, change_id, file, 'CRITICAL' AS severity, 'cycle' AS kind,
    concat('Circular dependency detected (', size, ' files)') AS description FROM touched),
top5 AS (SELECT repo, path, fan_in FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY fan_in DESC, path) AS rn
  FROM degrees) AS d WHERE rn <= 5),
hub_issues AS (SELECT c.repo, c.change_id, c.file, CASE WHEN t.fan_in >= 10 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
    'hub' AS kind, concat('Hub file modified (', t.fan_in, ' dependents, ',
      CASE WHEN t.fan_in >= 10 THEN 'HIGH' WHEN t.fan_in >= 5 THEN 'MEDIUM' ELSE 'LOW' END, ' risk)') AS description
  FROM changes c JOIN top5 t ON t.repo = c.repo AND t.path = c.file),
issues AS MATERIALIZED (SELECT * FROM warning_issues UNION ALL SELECT * FROM cycle_issues UNION ALL SELECT * FROM hub_issues
  UNION ALL SELECT * FROM coupling_issues),
counts AS (SELECT repo, change_id, count(*) AS issues, count(*) FILTER (severity = 'CRITICAL') AS critical,
    count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium,
    count(*) FILTER (severity = 'LOW') AS low, count(*) FILTER (kind = 'cycle') AS cycles FROM issues GROUP BY repo, change_id),
breaking AS (SELECT DISTINCT m.repo, m.change_id FROM matched m JOIN open_warnings w ON w.repo = m.repo AND w.id = m.id
  WHERE w.risk_level = 'HIGH' AND w.broken_import IS NOT NULL),
judged AS (SELECT s.repo, s.change_id, coalesce(c.issues, 0) AS issues, coalesce(critical, 0) AS critical,
    coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low, coalesce(cycles, 0) AS cycles,
    coalesce(high, 0) > 0 AND b.change_id IS NOT NULL AS broken
  FROM change_sets s LEFT JOIN counts c ON c.repo = s.repo AND c.change_id = s.change_id
  LEFT JOIN breaking b ON b.repo = s.repo AND b.change_id = s.change_id),
verdicts AS (SELECT *, CASE WHEN critical > 0 OR broken OR cycles > 0 THEN 'FAIL' WHEN high > 0 OR medium > 0 THEN 'WARN'
    ELSE 'PASS' END AS verdict FROM judged)"""

STATS = """
repo_stats AS (SELECT f.repo, f.n AS files_in_graph, coalesce(w.n, 0) AS unresolved_warnings, z.n AS scc_count, z.cyclic AS cyclic_sccs
  FROM (SELECT repo, count(*) AS n FROM files GROUP BY repo) f
  LEFT JOIN (SELECT repo, count(*) AS n FROM open_warnings GROUP BY repo) w ON w.repo = f.repo
  JOIN (SELECT repo, count(*) AS n, count(*) FILTER (size > 1) AS cyclic FROM sizes GROUP BY repo) z ON z.repo = f.repo)"""


def gate_sql() -> dict[str, str]:
    def sql(select: str, *ctes: str) -> str:
        return duck(",".join([GRAPH, GATE_CTES, OPEN, *ctes]), select, recursive=CLOSURE in ctes)

    full = (SETS, CLOSURE, SCC, DEGREES, COUPLING, COUPLING_ISSUES, ISSUES)
    issue = "SELECT repo, change_id, file, severity, kind, description FROM "
    return {
        "unacknowledged_warnings": sql("SELECT repo, id, ts, file, risk_level FROM open_warnings"),
        "acknowledge_warnings": sql("SELECT repo, id, TIMESTAMP '2024-06-01 00:00:00' AS ts FROM open_warnings"),
        "warnings_for_files": sql(
            """SELECT DISTINCT c.repo, c.change_id, w.id FROM changes c JOIN renamed w ON w.repo = c.repo
            WHERE ends_with(c.file, w.file) OR ends_with(w.file, c.file)
            UNION ALL SELECT s.repo, s.change_id, w.id FROM change_sets s JOIN renamed w ON w.repo = s.repo
              WHERE NOT s.has_files""",
            RENAMED, SETS,
        ),
        "warning_issues": sql(issue + "warning_issues", *full),
        "cycles_for_files": sql("SELECT repo, change_id, comp, file, size FROM touched", *full),
        "cycle_issues": sql(issue + "cycle_issues", *full),
        "hub_issues": sql(issue + "hub_issues", *full),
        "coupling_issues": sql(issue + "coupling_issues", COUPLING, COUPLING_ISSUES),
        "cycle_members": sql(
            """SELECT t.repo, t.change_id, t.comp, y.path AS member, y.size FROM touched t
            JOIN cyclic y ON y.repo = t.repo AND y.comp = t.comp""", *full,
        ),
        "gate_issues": sql(issue + "issues WHERE change_id <> -1", *full),
        "pass_acknowledgements": sql(
            """SELECT repo, id, TIMESTAMP '2024-06-01 00:00:00' AS ts FROM open_warnings
            WHERE repo IN (SELECT repo FROM verdicts WHERE verdict = 'PASS')""", *full,
        ),
        "gate_verdict": sql(
            """SELECT v.repo, v.change_id, v.issues, v.critical, v.high, v.medium, v.low, v.cycles, v.verdict,
              CASE v.verdict WHEN 'FAIL' THEN concat('BUILD BLOCKED — ', concat_ws(', ',
                  CASE WHEN critical > 0 THEN 'CRITICAL warnings' END,
                  CASE WHEN broken THEN 'HIGH warnings with broken imports' END,
                  CASE WHEN cycles > 0 THEN concat(cycles, ' circular dependency(ies)') END))
                WHEN 'WARN' THEN concat('PROCEED WITH CAUTION — ', issues, ' issue(s) detected')
                ELSE 'All clear — safe to build' END AS status_line,
              CASE v.verdict WHEN 'FAIL' THEN 'Fix the issues above before building. Use `check_warnings` for details, then `analyze_impact` on affected files.'
                WHEN 'WARN' THEN 'Review the issues. If you''ve verified they''re safe, proceed with the build. Use `check_warnings acknowledge=true` to clear warnings.'
                ELSE 'No issues detected. You may proceed with build/deploy.' END AS recommendation,
              s.files_in_graph, s.unresolved_warnings, s.scc_count, s.cyclic_sccs,
              CASE WHEN v.verdict = 'PASS' THEN s.unresolved_warnings ELSE 0 END AS auto_acknowledged
            FROM verdicts v JOIN repo_stats s ON s.repo = v.repo""",
            *full, STATS,
        ),
    }


# --- versions of the graph ---

EDITED = (
    graph_ctes(edited=True)
    .replace("placed_orders", "placed_orders2").replace("chained", "chained2").replace("placed_lines", "placed_lines2")
    .replace("all_refs", "all_refs2").replace("gone AS", "gone2 AS").replace("FROM gone", "FROM gone2")
    .replace("names AS", "names2 AS").replace("FROM names", "FROM names2").replace("edges AS", "edges2 AS")
    .replace("files AS", "files2 AS").replace("\nrefs AS", "\nrefs2 AS").replace("FROM refs", "FROM refs2")
)
DIFF = """
diff AS (SELECT repo, src, dst, 'added' AS change FROM (SELECT repo, src, dst FROM edges2 EXCEPT SELECT repo, src, dst FROM edges)
  UNION ALL SELECT repo, src, dst, 'removed' FROM (SELECT repo, src, dst FROM edges EXCEPT SELECT repo, src, dst FROM edges2))"""
INVALID = """
invalid(repo, path) AS (SELECT repo, dst FROM diff
  UNION SELECT e.repo, e.dst FROM invalid i JOIN (
    SELECT repo, src, dst FROM edges UNION SELECT repo, src, dst FROM edges2) e ON e.repo = i.repo AND e.src = i.path)"""
BROKEN = """
deleted AS (SELECT f.repo, f.path AS file FROM files f JOIN gone g ON g.name = f.name),
broken AS (SELECT e.repo, e.dst AS file, e.src AS importer FROM edges e JOIN deleted d ON d.repo = e.repo AND d.file = e.dst
  WHERE NOT EXISTS (SELECT 1 FROM deleted x WHERE x.repo = e.repo AND x.file = e.src))"""


def incremental_sql() -> dict[str, str]:
    q = {
        "updated_components": graph(
            "SELECT repo, path, comp FROM scc",
            EDITED,
            "kept_files AS (SELECT * FROM files f WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.name = f.name))",
            CLOSURE.replace("edges", "edges2"),
            SCC.replace("edges e", "edges2 e").replace("FROM files f", "FROM kept_files f"),
        ),
        "updated_pagerank": graph(
            "SELECT repo, path, pagerank FROM ranked",
            EDITED,
            "kept_files AS (SELECT * FROM files f WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.name = f.name))",
            PAGERANK.replace("FROM edges", "FROM edges2").replace("FROM files", "FROM kept_files"),
        ),
        "edge_diff": graph("SELECT * FROM diff", EDITED, DIFF),
        "invalidation_set": graph("SELECT repo, path FROM invalid", EDITED, DIFF, INVALID),
        "broken_imports": graph("SELECT repo, 1 AS change_id, file, importer FROM broken", BROKEN),
        "broken_import_warnings": graph(
            f"""SELECT b.repo, 1 AS change_id, b.file, b.n AS broken, c.n AS affected, {risk("c.n")} AS risk_level
            FROM (SELECT repo, file, count(*) AS n FROM broken GROUP BY repo, file) b
            JOIN (SELECT repo, start, count(*) AS n FROM closure GROUP BY repo, start) c ON c.repo = b.repo AND c.start = b.file""",
            CLOSURE, BROKEN,
        ),
        "apply_file_changes": graph("SELECT repo, src, dst, n_refs FROM edges2", EDITED),
        "warning_stream": graph("SELECT repo, file, importer FROM broken", BROKEN),
        "open_warning_state": duck(
            ",".join([GRAPH, GATE_CTES]),
            """SELECT coalesce(w.repo, a.repo) AS repo, coalesce(w.id, a.id) AS id, w.id IS NOT NULL AS seen, a.id IS NOT NULL AS acked,
              w.id IS NOT NULL AND a.id IS NULL AS open
            FROM (SELECT repo, id FROM warnings) w FULL JOIN (SELECT DISTINCT repo, id FROM acks) a ON a.repo = w.repo AND a.id = w.id""",
        ),
    }
    q["file_change_stream"] = q["apply_file_changes"]
    q["refresh_graph"] = graph_sql()["graph_stats"]
    q["resolve_imports"] = graph(
        "SELECT e.repo, e.src, e.dst, r.i AS occurrence FROM edges e, LATERAL (SELECT unnest(range(1, e.n_refs + 1)) AS i) r"
    )
    q["unresolved_imports"] = graph(
        """SELECT e.repo, e.src AS path, CAST(sum(e.n_refs) AS BIGINT) AS n FROM edges e
        JOIN deleted d ON d.repo = e.repo AND d.file = e.dst GROUP BY e.repo, e.src""",
        BROKEN,
    )
    return q


# --- overview ---


def profile_sql() -> dict[str, str]:
    layer = f"CASE lang WHEN 'typescript' THEN {TS_LAYER} WHEN 'dart' THEN {DART_LAYER} END"
    profile = f"""
rows AS (SELECT f.repo, f.lang, coalesce({layer}, 'NONE') AS layer, f.lines, coalesce(o.fan_out, 0) AS imports,
    CASE WHEN z.size > 1 THEN 1 ELSE 0 END AS cyclic
  FROM (SELECT x.repo, x.path, x.lang, lower(x.path) AS p, string_split(lower(x.path), '/')[-1] AS name,
          3 + CASE WHEN x.lang = 'go' AND x.name LIKE 'o%' THEN 2 WHEN x.lang IN ('go', 'java') THEN 1 ELSE 0 END
            + greatest(coalesce(r.refs, 0) - 1, 0) + coalesce(length(d.text) - length(replace(d.text, chr(10), '')), 0) AS lines
        FROM files x LEFT JOIN documents d ON x.name = concat('o', d.doc_id)
        LEFT JOIN (SELECT repo, src, sum(n_refs) AS refs FROM edges GROUP BY repo, src) r ON r.repo = x.repo AND r.src = x.path) f
  LEFT JOIN fan_out o ON o.repo = f.repo AND o.path = f.path JOIN scc c ON c.repo = f.repo AND c.path = f.path
  JOIN sizes z ON z.repo = c.repo AND z.comp = c.comp)"""
    return {
        "project_profile": graph(
            """SELECT repo, lang, layer, count(*) AS files, CAST(sum(lines) AS BIGINT) AS lines,
              CAST(sum(imports) AS BIGINT) AS imports, CAST(sum(cyclic) AS BIGINT) AS cyclic_files,
              CAST(grouping(repo, lang, layer) AS BIGINT) AS level
            FROM rows GROUP BY GROUPING SETS ((repo, lang, layer), (repo, lang), (repo))""",
            CLOSURE, SCC, DEGREES, profile,
        ),
        "analysis_context": graph(
            """, bodies AS (SELECT f.repo, f.path, coalesce(d.text, '') AS content FROM files f
              LEFT JOIN documents d ON f.name = concat('o', d.doc_id))
            SELECT repo, path, NULL AS dependent, md5(content) AS content_md5 FROM bodies
            UNION ALL SELECT e.repo, e.dst, e.src, md5(b.content) FROM edges e JOIN bodies b ON b.repo = e.repo AND b.path = e.src"""
        ),
    }


def all_sql() -> dict[str, str]:
    return {
        **listing_sql(), **graph_sql(), **scalar_sql(), **traversal_sql(), **rank_sql(), **coupling_sql(), **gate_sql(),
        **incremental_sql(), **profile_sql(),
    }
