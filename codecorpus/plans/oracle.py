"""DuckDB SQL oracles, one per catalog query.

The SQL recomputes each expected result from the generator recipe of
FIXTURES.md §3 directly (the oracle knows how the files were made, so it needs
no parser).  Only DuckDB syntax; the driver pre-registers the test tables as
views.
"""

from __future__ import annotations

NL = "E'\\n'"

KINDS = ("['ParserError', 'DocstringParsingError', 'SyntaxError', 'DeclarationError', 'TypeError',"
         " 'UnimplementedFeatureError', 'InternalCompilerError', 'Exception', 'CompilerError']")

# Solidity compiler logs (same recipe as fixtures.solidity_logs)
SOL_LOGS = f"""
sol_logs AS (
  SELECT event_id, 'own_src' || CAST(user_id % 20 AS VARCHAR) AS proj_name,
    'Compiling 1 file with 0.8.19' || {NL} ||
      CASE WHEN event_type <> 'error' THEN 'Compiled 1 Solidity file successfully' || {NL} ELSE '' END AS stdout,
    CASE WHEN event_type = 'error' THEN
      CASE WHEN event_id % 11 = 0 THEN 'Error HH600: Compilation failed for run ' || event_id || E'\\n\\nsee above'
      ELSE ({KINDS})[event_id % 9 + 1] || ': problem ' || event_id || E'\\n --> contracts/sample.sol:'
           || (event_id % 50 + 1) || ':5:' || E'\\n\\nWarning: unused local variable'
           || CASE WHEN event_id % 4 = 0 THEN E'\\n\\n' || ({KINDS})[(event_id + 4) % 9 + 1] || ': second ' || event_id ELSE '' END
           || E'\\n\\nError HH600: Compilation failed' END
    ELSE '' END AS stderr
  FROM events
)"""

COMPILE_INFO = f"""
compiled AS (
  SELECT event_id, proj_name,
    CASE WHEN contains(stdout, 'Compiled 1 Solidity file successfully') THEN '<COMPILED_SUCCESSFULLY>'
         WHEN len(kept) = 0 THEN stderr
         ELSE array_to_string(kept, {NL}) END AS compile_info
  FROM (SELECT *, list_filter(string_split(stderr, E'\\n\\n'),
                   lambda b: len(list_filter({KINDS}, lambda k: contains(b, k))) > 0) AS kept
        FROM sol_logs)
)"""

ORACLE: dict[str, str] = {}

ORACLE["compile_status"] = f"""
WITH {SOL_LOGS}, {COMPILE_INFO}
SELECT event_id, proj_name, compile_info FROM compiled
"""

ORACLE["compilable_rate_by_project"] = f"""
WITH {SOL_LOGS}, {COMPILE_INFO}
SELECT proj_name, count(*) AS n,
       sum(CAST(compile_info = '<COMPILED_SUCCESSFULLY>' AS BIGINT)) AS n_ok,
       round(sum(CAST(compile_info = '<COMPILED_SUCCESSFULLY>' AS BIGINT)) / count(*), 6) AS rate
FROM compiled GROUP BY proj_name
"""

MAVEN_BASE = "/work/projects"
MSGS = ("['cannot find symbol', 'incompatible types: int cannot be converted to String',"
        " ''';'' expected', 'missing return statement']")

MAVEN_LOGS = f"""
mvn_events AS (
  SELECT e.event_id, e.event_type, e.event_id // 5 AS doc,
    'own_' || coalesce(d.source, 'src' || CAST(e.user_id % 20 AS VARCHAR)) AS proj_name
  FROM events e LEFT JOIN documents d ON d.doc_id = e.event_id // 5
),
mvn_err AS (
  SELECT e.event_id, j,
    '[ERROR] {MAVEN_BASE}/' || e.proj_name || '/mod/src/' || CASE WHEN (e.doc + j) % 10 = 9 THEN 'test' ELSE 'main' END
      || '/java/p' || CAST((e.doc + j) % 7 AS VARCHAR) || '/C' || CAST(e.doc + j AS VARCHAR)
      || '.java:[' || CAST(1 + (e.event_id + 3 * j) % 12 AS VARCHAR) || ','
      || CAST(1 + (e.event_id * (j + 1)) % 20 AS VARCHAR) || '] '
      || ({MSGS})[(e.event_id + j) % 4 + 1] AS line
  FROM mvn_events e, range(0, 3) r(j)
  WHERE e.event_type = 'error' AND j <= e.event_id % 3
),
mvn_logs AS (
  SELECT event_id, proj_name,
    'mod/src/' || CASE WHEN doc % 10 = 9 THEN 'test' ELSE 'main' END || '/java/p' || CAST(doc % 7 AS VARCHAR)
      || '/C' || CAST(doc AS VARCHAR) || '.java' AS relative_path,
    event_type = 'purchase' AND event_id % 7 = 0 AS fill_failed,
    event_type
  FROM mvn_events
),
mvn_entries AS (
  SELECT event_id,
    list_sort(list_distinct(list(
      '<file>' || replace(regexp_extract(line, '^\\[ERROR\\] (.+?):\\[(\\d+),(\\d+)\\] (.+)$', 1), '{MAVEN_BASE}/', '')
      || '<line>' || regexp_extract(line, '^\\[ERROR\\] (.+?):\\[(\\d+),(\\d+)\\] (.+)$', 2)
      || '<col>' || regexp_extract(line, '^\\[ERROR\\] (.+?):\\[(\\d+),(\\d+)\\] (.+)$', 3)
      || '<err>' || regexp_extract(line, '^\\[ERROR\\] (.+?):\\[(\\d+),(\\d+)\\] (.+)$', 4)))) AS entries
  FROM mvn_err GROUP BY event_id
)"""

ORACLE["maven_feedback"] = f"""
WITH {MAVEN_LOGS}
SELECT l.event_id, l.proj_name, l.relative_path,
  CASE WHEN l.fill_failed THEN '<execute_error>'
       WHEN m.entries IS NULL THEN '<success>'
       ELSE array_to_string(m.entries, {NL}) END AS compiler_feedback
FROM mvn_logs l LEFT JOIN mvn_entries m USING (event_id)
"""

# ---------------------------------------------------------------------------
# Generated code corpora (FIXTURES §3.1 / §3.2), recomputed from documents
# ---------------------------------------------------------------------------

DOCS = r"""
docs AS (
  SELECT doc_id AS d, source,
    list_filter(list_transform(string_split(text, E'\n'),
      lambda x: trim(regexp_replace(x, '[^A-Za-z0-9 ]', '', 'g'))), lambda x: x <> '') AS ls
  FROM documents
),
lines AS (
  SELECT d, source, i, ls[i + 1] AS x, len(ls) AS n
  FROM (SELECT d, source, ls, unnest(range(0, len(ls))) AS i FROM docs)
)"""

# Solidity contract C<d>: per line i a comment, signature, body; offsets of each
# line inside the contract text (which starts at the 'contract' keyword).
SOL = DOCS + r""",
sol_l AS (
  SELECT d, i, x,
    CASE i % 3 WHEN 0 THEN '  // note ' || i || E'\n'
               WHEN 1 THEN '  /* note ' || i || E' */\n  // more ' || i || E'\n' ELSE '' END AS cm,
    '  function f' || (i // 2) || '(uint256 a, address b) public {' AS sig,
    ' ' || x || ' ' AS body
  FROM lines
),
sol_head AS (
  SELECT d, 'contract C' || d || ' is Base' || d || '_' || (d % 4)
         || CASE WHEN d % 10 = 0 THEN ', Side' || d ELSE '' END || E' {\n' AS head
  FROM docs
),
sol_c AS (
  SELECT h.d, h.head || coalesce(string_agg(l.cm || l.sig || l.body || E'}\n', '' ORDER BY l.i), '') || '}' AS c_text,
         h.head
  FROM sol_head h LEFT JOIN sol_l l ON l.d = h.d GROUP BY h.d, h.head
),
sol_fn AS (
  SELECT l.d, l.i, l.x, l.cm, l.sig, l.body, c.c_text,
    length(c.head) + coalesce(sum(length(l.cm || l.sig || l.body) + 2) OVER (
      PARTITION BY l.d ORDER BY l.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
  FROM sol_l l JOIN sol_c c ON c.d = l.d
),
base_k AS (
  SELECT d, unnest(range(0, d % 4 + 1)) AS k FROM docs
),
base_c AS (
  SELECT d, k, 'Base' || d || '_' || k AS name,
    'contract Base' || d || '_' || k || CASE WHEN k > 0 THEN ' is Base' || d || '_' || (k - 1) ELSE '' END || E' {\n'
      || '  uint256 public s' || d || '_' || k || E';\n'
      || '  uint256 private p' || d || '_' || k || E';\n' AS pre,
    '  function g' || d || '_' || k || '() internal {' AS gsig,
    '  function h' || d || '_' || k || '() external {' AS hsig
  FROM base_k
),
side_c AS (
  SELECT d, 'Side' || d AS name,
    'contract Side' || d || ' is Base' || d || E'_0 {\n  uint256 internal q' || d || E';\n' AS pre,
    '  function m' || d || '(uint256 v) public virtual returns (uint256) {' AS msig
  FROM docs WHERE d % 10 = 0
)"""

ORACLE["contracts"] = "WITH " + SOL + r"""
SELECT d AS source_idx, name AS contract_name,
       pre || gsig || E' return; }\n' || hsig || E' return; }\n}' AS contract_source FROM base_c
UNION ALL
SELECT d, name, pre || msig || E' return v; }\n}' FROM side_c
UNION ALL
SELECT d, 'C' || d, c_text FROM sol_c
"""

ORACLE["function_spans"] = "WITH " + SOL + r"""
SELECT d AS source_idx, name AS contract_name, 'g' || d || '_' || k AS func_name, ' return; ' AS func_body,
       pre || gsig || E'<FILL_FUNCTION_BODY>}\n' || hsig || E' return; }\n}' AS masked_contract FROM base_c
UNION ALL
SELECT d, name, 'h' || d || '_' || k, ' return; ',
       pre || gsig || E' return; }\n' || hsig || E'<FILL_FUNCTION_BODY>}\n}' FROM base_c
UNION ALL
SELECT d, name, 'm' || d, ' return v; ', pre || msig || E'<FILL_FUNCTION_BODY>}\n}' FROM side_c
UNION ALL
SELECT d, 'C' || d, 'f' || (i // 2), body,
       left(c_text, CAST(off + length(cm) + length(sig) AS BIGINT)) || '<FILL_FUNCTION_BODY>'
       || substr(c_text, CAST(off + length(cm) + length(sig) + length(body) + 1 AS BIGINT))
FROM sol_fn
"""

ORACLE["whole_functions"] = "WITH " + SOL + r"""
SELECT d AS source_idx, name AS contract_name, 'g' || d || '_' || k AS func_name,
       ltrim(gsig) || ' return; }' AS function,
       pre || E'  <FILL_FUNCTION>\n' || hsig || E' return; }\n}' AS masked_contract FROM base_c
UNION ALL
SELECT d, name, 'h' || d || '_' || k, ltrim(hsig) || ' return; }',
       pre || gsig || E' return; }\n' || E'  <FILL_FUNCTION>\n}' FROM base_c
UNION ALL
SELECT d, name, 'm' || d, ltrim(msig) || ' return v; }', pre || E'  <FILL_FUNCTION>\n}' FROM side_c
UNION ALL
SELECT d, 'C' || d, 'f' || (i // 2), ltrim(sig) || body || '}',
       left(c_text, CAST(off + length(cm) + 2 AS BIGINT)) || '<FILL_FUNCTION>'
       || substr(c_text, CAST(off + length(cm) + length(sig) + length(body) + 2 AS BIGINT))
FROM sol_fn
"""

# Java class C<d>: text from the 'class' keyword to its closing brace.
JAVA = DOCS + r""",
java_l AS (
  SELECT d, source, i, x, n,
    CASE WHEN d % 5 = 0 AND i = n - 1 THEN '  static class N' || d || E' {\n' ELSE '' END AS nopen,
    CASE i % 3 WHEN 0 THEN '  /** note ' || i || E' */\n' WHEN 1 THEN '  // more ' || i || E'\n' ELSE '' END AS cm,
    '  public void f' || (i // 2) || '(int a, ' || CASE WHEN i % 2 = 1 THEN 'C' || (d + 7) ELSE 'String' END || ' b) {' AS sig,
    ' ' || x || ' ' AS body,
    CASE WHEN d % 5 = 0 AND i = n - 1 THEN E'  }\n' ELSE '' END AS nclose
  FROM lines
),
java_head AS (
  SELECT d, source, 'class C' || d || E' {\n  private int x' || d || E';\n  private static final String NAME'
         || d || E' = "a//b{";\n' AS head,
         CASE WHEN d % 7 = 0 THEN '  interface J' || d || E' {\n    void ping' || d || E'(int a);\n  }\n' ELSE '' END AS iface,
         'mod/src/' || CASE WHEN d % 10 = 9 THEN 'test' ELSE 'main' END || '/java/p' || (d % 7) || '/C' || d || '.java' AS relative_path,
         'own_' || source AS proj_name
  FROM docs
),
java_c AS (
  SELECT h.d, h.proj_name, h.relative_path, h.head,
    h.head || coalesce(string_agg(l.nopen || l.cm || l.sig || l.body || E'}\n' || l.nclose, '' ORDER BY l.i), '')
      || h.iface || '}' AS c_text
  FROM java_head h LEFT JOIN java_l l ON l.d = h.d
  GROUP BY h.d, h.proj_name, h.relative_path, h.head, h.iface
),
java_fn AS (
  SELECT l.*, c.c_text, c.proj_name, c.relative_path,
    length(c.head) + coalesce(sum(length(l.nopen || l.cm || l.sig || l.body || l.nclose) + 2) OVER (
      PARTITION BY l.d ORDER BY l.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
  FROM java_l l JOIN java_c c ON c.d = l.d
)"""

ORACLE["masked_samples"] = "WITH " + JAVA + r"""
SELECT proj_name, relative_path, 'C' || d AS class_name, 'f' || (i // 2) AS func_name, body AS func_body,
  left(c_text, CAST(off + length(nopen) + length(cm) + length(sig) AS BIGINT)) || '<FILL_FUNCTION_BODY>'
  || substr(c_text, CAST(off + length(nopen) + length(cm) + length(sig) + length(body) + 1 AS BIGINT)) AS masked_class
FROM java_fn
"""

# Whole Solidity / Java files (for text-level operators)
SOL_FILE = SOL + r""",
sol_file AS (
  SELECT c.d,
    'pragma solidity ^0.8.0;' || E'\n'
    || CASE WHEN c.d % 5 = 1 THEN 'interface I' || c.d || E' {\n  function ping' || c.d || E'(uint256 x) external returns (bool);\n}\n' ELSE '' END
    || (SELECT string_agg(b.pre || b.gsig || E' return; }\n' || b.hsig || E' return; }\n}\n', '' ORDER BY b.k) FROM base_c b WHERE b.d = c.d)
    || coalesce((SELECT s.pre || s.msig || E' return v; }\n}\n' FROM side_c s WHERE s.d = c.d), '')
    || c.c_text || E'\n' AS source_code
  FROM sol_c c
)"""

JAVA_FILE = JAVA + r""",
java_file AS (
  SELECT d, proj_name, relative_path,
    'package p' || (d % 7) || E';\n\nimport java.util.List;\n\n/** Class C' || d || E'. */\npublic ' || c_text || E'\n' AS source_code
  FROM java_c
)"""

ORACLE["path_columns"] = "WITH " + JAVA + r"""
SELECT proj_name, relative_path,
  '/work/projects/' || proj_name || '/' || relative_path AS abs_path,
  regexp_replace(proj_name, '^[^_]*_?', '') AS repo,
  replace(replace(relative_path, '/src/main/java', '/target/classes'), '.java', '.class') AS class_path,
  regexp_replace(replace(split_part(relative_path, 'src/main/java/', 2), '/', '.'), '\.java$', '') AS fq_class,
  regexp_replace(regexp_replace(replace(split_part(relative_path, 'src/main/java/', 2), '/', '.'), '\.java$', ''), '\.?[^.]*$', '') AS package,
  split_part(relative_path, '/src/main/java', 1) AS module_dir,
  concat_ws('/', '/work/projects', proj_name, split_part(relative_path, '/src/main/java', 1), 'evosuite-tests',
    replace(regexp_replace(replace(split_part(relative_path, 'src/main/java/', 2), '/', '.'), '\.java$', ''), '.', '/')) AS test_dir
FROM java_head
"""

ORACLE["url_parts"] = r"""
SELECT page_id, split_part(url, '/', 1) AS proj_name, regexp_extract(url, '^[^/]*/(.*)$', 1) AS relative_path,
  string_split(url, '/')[-2] AS owner, string_split(url, '/')[-1] AS repo,
  concat_ws('_', string_split(url, '/')[-2], string_split(url, '/')[-1]) AS owner_repo
FROM pages
"""

ORACLE["filter_funnel"] = "WITH " + JAVA + r"""
SELECT proj_name, count(*) AS n_files,
  count(*) FILTER (WHERE NOT contains(relative_path, 'test')) AS n_not_test,
  count(*) FILTER (WHERE NOT contains(relative_path, 'test') AND contains(relative_path, 'src/main/java')) AS n_main,
  count(*) FILTER (WHERE NOT contains(relative_path, 'test') AND contains(relative_path, 'src/main/java') AND d % 4 <> 3) AS n_compiled
FROM java_head GROUP BY proj_name
"""

ORACLE["remove_comments"] = "WITH " + SOL_FILE + r"""
SELECT d AS source_idx,
  regexp_replace(source_code, '//[^\n]*\n?\z|//[^\n]*|/\*[\s\S]*?\*/|(/\*[\s\S]*)\z', '\1', 'g') AS source_code_removed_comment
FROM sol_file
"""

ORACLE["strip_private"] = "WITH " + JAVA_FILE + r"""
SELECT proj_name, relative_path, regexp_replace(source_code, '(\s)(?:private\s)+', '\1', 'g') AS source_code
FROM java_file
"""

ORACLE["text_measures"] = r"""
SELECT doc_id, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS collapsed,
  length(regexp_replace(text, '[\n\t\r\x07]', '', 'g')) AS len_no_control,
  coalesce(regexp_replace(text, '[\t\n\r ]', '', 'g') = '', true) AS is_blank,
  CAST(doc_id AS VARCHAR) AS doc_key
FROM documents
"""

ORACLE["capped_sample"] = r"""
SELECT source, doc_id, sample_rank FROM (
  SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('0:' || doc_id), doc_id) AS sample_rank
  FROM documents) WHERE sample_rank <= 20
"""

ORACLE["weighted_sample"] = r"""
SELECT source, arg_min(doc_id, k) AS doc_id, arg_min(n_chars, k) AS n_chars FROM (
  SELECT source, doc_id, n_chars,
    struct_pack(e := -ln((CAST(('0x' || substr(md5('11:' || source || ':' || doc_id), 1, 8)) AS BIGINT) + 1.0) / 4294967296.0) / n_chars, i := doc_id) AS k
  FROM documents WHERE n_chars > 0) GROUP BY source
"""

ORACLE["uniform_sample"] = r"""
SELECT source, arg_min(doc_id, md5('0:' || source || ':' || doc_id)) AS doc_id FROM documents GROUP BY source
"""

ORACLE["shards"] = r"""
SELECT doc_id, idx, CAST(least(floor(idx / ceil(n / 4.0)) + 1, 4) AS BIGINT) AS shard FROM (
  SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx, count(*) OVER () AS n FROM documents)
"""

ORACLE["positional_zip"] = r"""
SELECT coalesce(d.idx, l.idx) AS idx, d.doc_id, l.label_doc_id, l.quality,
  CASE WHEN d.idx IS NULL THEN 'no_left' WHEN l.idx IS NULL THEN 'no_right' ELSE 'ok' END AS status FROM
  (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents) d
  FULL JOIN (SELECT doc_id AS label_doc_id, quality, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM labels) l
  ON d.idx = l.idx
"""

ORACLE["orders_histogram"] = r"""
SELECT coalesce(o.n, 0) AS n_matches, count(*) AS n_rows
FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey
GROUP BY 1
"""

ORACLE["project_batches"] = r"""
SELECT proj_name, n_files, (row_number() OVER (ORDER BY proj_name) - 1) // 3 AS batch FROM (
  SELECT 'own_' || source AS proj_name, count(*) AS n_files FROM documents GROUP BY 1)
"""

ORACLE["stage_reached"] = r"""
SELECT event_id, event_type <> 'error' AS runnable,
  CASE WHEN event_type NOT IN ('click', 'error') THEN 'ok' WHEN event_type = 'click' THEN 'some_fail' ELSE 'cannot_run' END AS run_label,
  CAST(1 + event_id % 13 AS INTEGER) AS stage,
  CASE WHEN 1 + event_id % 13 = 13 THEN '/work/tests/' || event_id || '/clover_html_pass' END AS pass_test_info_url,
  CASE WHEN 1 + event_id % 13 = 13 THEN '/work/tests/' || event_id || '/clover_html_fail' END AS fail_test_info_url
FROM events
"""

# Every Solidity function with a body, with offsets inside its contract text:
# fs = function start, bs/be = body (no braces), fe = function end, ext = start
# of the leading comments (or fs); ovl = index among same-name overloads.
ALL_FN = SOL_FILE + r""",
all_fn AS (
  SELECT d, name AS contract, pre || gsig || E' return; }\n' || hsig || E' return; }\n}' AS cs,
    'g' || d || '_' || k AS fname, 0 AS fpos, 0 AS ovl, ' return; ' AS body,
    length(pre) + 2 AS fs, length(pre) + length(gsig) AS bs, '' AS req FROM base_c
  UNION ALL
  SELECT d, name, pre || gsig || E' return; }\n' || hsig || E' return; }\n}',
    'h' || d || '_' || k, 1, 0, ' return; ',
    length(pre) + length(gsig) + 11 + 2, length(pre) + length(gsig) + 11 + length(hsig), '' FROM base_c
  UNION ALL
  SELECT d, name, pre || msig || E' return v; }\n}', 'm' || d, 0, 0, ' return v; ',
    length(pre) + 2, length(pre) + length(msig), '' FROM side_c
  UNION ALL
  SELECT d, 'C' || d, c_text, 'f' || (i // 2), i, i % 2, body,
    off + length(cm) + 2, off + length(cm) + length(sig),
    CASE i % 3 WHEN 0 THEN 'note ' || i WHEN 1 THEN 'note ' || i || E'\nmore ' || i ELSE '' END
  FROM sol_fn
),
fn AS (
  SELECT *, bs + length(body) AS be, bs + length(body) + 1 AS fe,
    CASE WHEN req <> '' THEN fs - length(fs_cm) ELSE fs END AS ext
  FROM (SELECT *, CASE WHEN contract LIKE 'C%' AND fpos % 3 = 0 THEN '// note ' || fpos || E'\n  '
                       WHEN contract LIKE 'C%' AND fpos % 3 = 1 THEN '/* note ' || fpos || E' */\n  // more ' || fpos || E'\n  '
                       ELSE '' END AS fs_cm FROM all_fn)
),
h14 AS (
  SELECT d AS source_idx, contract AS contract_name, fname AS func_name,
    left(cs, CAST(bs AS BIGINT)) || '<FILL_FUNCTION_BODY>' || substr(cs, CAST(be + 1 AS BIGINT)) AS masked_body,
    left(cs, CAST(ext AS BIGINT)) || '<FILL_FUNCTION>' || substr(cs, CAST(fe + 1 AS BIGINT)) AS masked_all,
    body AS func_body,
    substr(cs, CAST(fs + 1 AS BIGINT), CAST(bs - 1 - fs AS BIGINT)) AS signature_only,
    substr(cs, CAST(ext + 1 AS BIGINT), CAST(bs - 1 - ext AS BIGINT)) AS signature_extend,
    fpos, ovl, length(body) AS blen
  FROM fn
)"""

ORACLE["commented_functions"] = "WITH " + SOL + r"""
SELECT d AS source_idx, 'C' || d AS contract_name, 'f' || (i // 2) AS func_name,
  left(c_text, CAST(off + length(cm) + length(sig) AS BIGINT)) || '<FILL_FUNCTION_BODY>'
  || substr(c_text, CAST(off + length(cm) + length(sig) + length(body) + 1 AS BIGINT)) AS masked_contract,
  body AS func_body,
  CASE i % 3 WHEN 0 THEN 'note ' || i ELSE 'note ' || i || E'\nmore ' || i END AS func_requirement
FROM sol_fn WHERE i % 3 <> 2
"""

ORACLE["solidity_samples"] = "WITH " + ALL_FN + r"""
SELECT source_idx, contract_name, func_name, masked_body, masked_all, func_body, signature_only, signature_extend
FROM h14
"""

ORACLE["cumulative_weight_sample"] = "WITH " + ALL_FN + r"""
, w AS (
  SELECT *, sum(blen) OVER (PARTITION BY source_idx, contract_name ORDER BY blen, fpos
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cw
  FROM h14
)
SELECT source_idx, contract_name,
  arg_min(func_name, k) AS func_name, arg_min(masked_body, k) AS masked_body, arg_min(masked_all, k) AS masked_all,
  arg_min(func_body, k) AS func_body, arg_min(signature_only, k) AS signature_only,
  arg_min(signature_extend, k) AS signature_extend
FROM (SELECT *, struct_pack(e := -ln((CAST(('0x' || substr(md5('42:' || source_idx || ':' || contract_name || ':'
        || func_name || ':' || ovl), 1, 8)) AS BIGINT) + 1.0) / 4294967296.0) / cw, p := fpos) AS k
      FROM w WHERE cw > 0)
GROUP BY source_idx, contract_name
"""

INHERIT = r"""
edges AS (
  SELECT d, 'C' || d AS child, 'Base' || d || '_' || (d % 4) AS base, 0 AS pos FROM docs
  UNION ALL SELECT d, 'C' || d, 'Side' || d, 1 FROM docs WHERE d % 10 = 0
  UNION ALL SELECT d, name, 'Base' || d || '_' || (k - 1), 0 FROM base_c WHERE k > 0
  UNION ALL SELECT d, name, 'Base' || d || '_0', 0 FROM side_c
),
roots AS (
  SELECT d, name AS root FROM base_c UNION ALL SELECT d, name FROM side_c UNION ALL SELECT d, 'C' || d FROM docs
),
rec(d, root, node, depth, path) AS (
  SELECT r.d, r.root, e.base, 1, [e.pos] FROM roots r JOIN edges e ON e.d = r.d AND e.child = r.root
  UNION ALL
  SELECT r.d, r.root, e.base, r.depth + 1, list_append(r.path, e.pos)
  FROM rec r JOIN edges e ON e.d = r.d AND e.child = r.node
),
best AS (
  SELECT d, root, node, depth, path FROM (
    SELECT *, row_number() OVER (PARTITION BY d, root, node ORDER BY depth, path) AS rn FROM rec) WHERE rn = 1
),
members AS (
  SELECT d, name AS node, 0 AS m, 'uint256 public s' || d || '_' || k || ';' AS element FROM base_c
  UNION ALL SELECT d, name, 1, ltrim(gsig) || '<BODY>}' FROM base_c
  UNION ALL SELECT d, name, 0, 'uint256 internal q' || d || ';' FROM side_c
  UNION ALL SELECT d, name, 1, ltrim(msig) || '<BODY>}' FROM side_c
),
agg AS (
  SELECT b.d, b.root, string_agg(m.element, E'\n' ORDER BY b.depth, b.path, m.m) AS els, count(*) AS n
  FROM best b JOIN members m ON m.d = b.d AND m.node = b.node GROUP BY b.d, b.root
)"""

ORACLE["inherited_members"] = "WITH RECURSIVE " + SOL + "," + INHERIT + r"""
SELECT r.d AS source_idx, r.root AS contract_name, coalesce(a.els, '') AS inherit_elements,
  CAST(coalesce(a.n, 0) AS INTEGER) AS n_elements
FROM roots r LEFT JOIN agg a ON a.d = r.d AND a.root = r.root
"""

# Dice similarity of lower-cased, white-space-free bodies among same-name
# functions of a contract; the winner is the most similar (ties: file order).
# A contract's offset in its file is where its (unique) text occurs.
SIM = ALL_FN + r""",
cand AS (
  SELECT f.d, f.contract, f.fpos AS i, f.fname, f.body,
    strpos(s.source_code, f.cs) - 1 + f.bs AS abs_bs,
    regexp_replace(lower(f.body), '\s+', '', 'g') AS nb
  FROM all_fn f JOIN sol_file s ON s.d = f.d
),
pairs AS (
  SELECT a.d, a.contract, a.i AS si, b.i AS ci, a.fname, a.body AS sbody, b.body AS cbody, b.abs_bs, a.nb AS sa, b.nb AS cb
  FROM cand a JOIN cand b ON a.d = b.d AND a.contract = b.contract AND a.fname = b.fname
),
bg_s AS (SELECT d, contract, si, ci, substr(sa, g, 2) AS bg, count(*) AS c
         FROM (SELECT *, unnest(range(1, length(sa))) AS g FROM pairs) GROUP BY ALL),
bg_c AS (SELECT d, contract, si, ci, substr(cb, g, 2) AS bg, count(*) AS c
         FROM (SELECT *, unnest(range(1, length(cb))) AS g FROM pairs) GROUP BY ALL),
inter AS (SELECT s.d, s.contract, s.si, s.ci, sum(least(s.c, c.c)) AS hit
          FROM bg_s s JOIN bg_c c USING (d, contract, si, ci, bg) GROUP BY ALL),
scored AS (
  SELECT p.*, CASE WHEN p.sa = p.cb THEN 1.0 WHEN length(p.sa) < 2 OR length(p.cb) < 2 THEN 0.0
                   ELSE 2.0 * coalesce(i.hit, 0) / (length(p.sa) + length(p.cb) - 2) END AS sim,
         count(*) OVER (PARTITION BY p.d, p.contract, p.si) AS ncand
  FROM pairs p LEFT JOIN inter i USING (d, contract, si, ci)
),
chosen AS (
  SELECT d, contract, si, arg_min(struct_pack(ci := ci, bs := abs_bs, sim := sim, cbody := cbody), struct_pack(ns := -sim, c := ci)) AS c,
         any_value(fname) AS fname, any_value(sbody) AS sbody
  FROM scored WHERE ncand = 1 OR sim > 0 GROUP BY d, contract, si
)"""

ORACLE["similar_overload"] = "WITH " + SIM + r"""
SELECT d AS source_idx, contract AS contract_name, fname AS func_name, sbody AS func_body,
  CAST(c.bs AS INTEGER) AS body_start, round(c.sim, 6) AS sim
FROM chosen
"""

ORACLE["refill_files"] = "WITH " + SIM + r"""
SELECT ch.d AS source_idx, ch.contract AS contract_name, ch.fname AS func_name,
  left(s.source_code, CAST(ch.c.bs AS BIGINT)) || ch.sbody || E'\n' || substr(s.source_code, CAST(ch.c.bs + length(ch.c.cbody) + 1 AS BIGINT)) AS filled_source_body,
  left(s.source_code, CAST(ch.c.bs AS BIGINT)) || upper(ch.sbody) || E'\n' || substr(s.source_code, CAST(ch.c.bs + length(ch.c.cbody) + 1 AS BIGINT)) AS filled_source_deepseek
FROM chosen ch JOIN sol_file s ON s.d = ch.d
"""

# Training tables
TOK = r"regexp_extract_all({s}, '[A-Za-z0-9_]+|[^A-Za-z0-9_\s]')"
IDS = r"list_transform(" + TOK + r", lambda t: CAST(CAST(('0x' || substr(md5(t), 1, 6)) AS BIGINT) % 50000 + 1 AS INTEGER))"

ORACLE["token_filter"] = r"""
SELECT doc_id, len_input, len_output, len_input + len_output AS total FROM (
  SELECT doc_id, CAST(len(""" + TOK.format(s="text") + r""") AS BIGINT) AS len_input,
         CAST(len(""" + TOK.format(s="split_part(text, E'\n', 1)") + r""") AS BIGINT) AS len_output
  FROM documents) WHERE len_input + len_output <= 2048
"""

INSTR = r"""
instr AS (
  SELECT conv_id, turn,
    'You are an AI programming assistant, utilizing the DeepSeek Coder model, developed by DeepSeek Company, and you only answer questions related to computer science. For politically sensitive questions, security and privacy issues, and other non-computer science questions, you will refuse to answer.'
    || E'\n### Instruction:\n' || regexp_replace(text, '^\s+|\s+$', '', 'g') || E'\n### Response:\n' AS source,
    next_text || E'\n<|EOT|>' AS target
  FROM (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
               lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text FROM conversations)
  WHERE role = 'user' AND next_role = 'assistant'
),
masked AS (
  SELECT conv_id, turn, ids, source_len,
    list_transform(ids, lambda x, i: CASE WHEN i - 1 < source_len THEN -100 ELSE x END) AS labels
  FROM (SELECT conv_id, turn,
          """ + IDS.format(s="source || target") + r"""[1:512] AS ids,
          CAST(len(""" + IDS.format(s="source") + r"""[1:512]) AS INTEGER) AS source_len
        FROM instr)
)"""

ORACLE["instruction_prompts"] = "WITH " + INSTR + " SELECT conv_id, turn, source, target FROM instr"

ORACLE["loss_mask"] = "WITH " + INSTR + r"""
SELECT conv_id, turn, CAST(len(ids) AS INTEGER) AS n_ids, source_len,
  array_to_string(ids, ',') AS input_ids, array_to_string(labels, ',') AS labels FROM masked
"""

ORACLE["padded_batches"] = "WITH " + INSTR + r""",
b AS (
  SELECT *, (row_number() OVER (ORDER BY conv_id, turn) - 1) // 4 AS batch FROM masked
),
p AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch) - len(ids) AS pad FROM b)
SELECT conv_id, turn, batch,
  array_to_string(list_concat(ids, list_transform(range(pad), lambda x: 0)), ',') AS input_ids,
  array_to_string(list_concat(labels, list_transform(range(pad), lambda x: -100)), ',') AS labels,
  array_to_string(list_transform(list_concat(ids, list_transform(range(pad), lambda x: 0)), lambda x: x <> 0), ',') AS attention_mask
FROM p
"""

ORACLE["fim_prompts"] = "WITH " + ALL_FN + ", " + SOL_LOGS + ", " + COMPILE_INFO + r"""
SELECT f.source_idx, f.contract_name, f.func_name,
  '<｜fim▁begin｜>' || replace(f.masked_body, '<FILL_FUNCTION_BODY>', '<｜fim▁hole｜>') || '<｜fim▁end｜>' AS prompt_fim,
  CASE WHEN f.func_name NOT IN ('f1', 'f2') THEN '▁<PRE>' || split_part(f.masked_body, '<FILL_FUNCTION_BODY>', 1) || '▁<SUF>' || split_part(f.masked_body, '<FILL_FUNCTION_BODY>', 2) || '▁<MID>' END AS prompt_psm,
  CASE WHEN f.func_name IN ('f1', 'f2') THEN 'bad_marker' ELSE 'ok' END AS marker_status,
  '<｜fim▁begin｜>' || replace(f.masked_body, '<FILL_FUNCTION_BODY>', '<｜fim▁hole｜>') || '<｜fim▁end｜>'
    || E'\n<ouput>\n' || upper(f.func_body) || E'\n<compile>\n' || replace(c.compile_info, '<COMPILED_SUCCESSFULLY>', 'success') || E'\n<correct> ' AS source_refine,
  CASE WHEN f.func_name NOT IN ('f1', 'f2') THEN '▁<PRE>' || split_part(f.masked_body, '<FILL_FUNCTION_BODY>', 1) || '▁<SUF>' || split_part(f.masked_body, '<FILL_FUNCTION_BODY>', 2) || '▁<MID>'
    || E'\n' || upper(f.func_body) || E'\n<correct>' END AS source_psm,
  f.func_body || E'\n<|EOT|>' AS target
FROM h14 f LEFT JOIN compiled c ON c.event_id = f.source_idx
"""

JAVA_T = JAVA + r""",
jt AS (
  SELECT h.d, h.proj_name, h.relative_path, h.head, h.iface,
    coalesce(string_agg(l.nopen || l.cm || left(l.sig, length(l.sig) - 2) || E';\n' || l.nclose, '' ORDER BY l.i), '') AS abs_lines,
    coalesce(string_agg(l.nopen || CASE l.i % 3 WHEN 0 THEN '  ' ELSE l.cm END
      || CASE WHEN l.i % 3 = 0 THEN ltrim(left(l.sig, length(l.sig) - 2)) ELSE left(l.sig, length(l.sig) - 2) END
      || E';\n' || l.nclose, '' ORDER BY l.i), '') AS cmp_lines
  FROM java_head h LEFT JOIN java_l l ON l.d = h.d
  GROUP BY h.d, h.proj_name, h.relative_path, h.head, h.iface
),
types AS (
  SELECT t.d, t.proj_name, t.relative_path, 'C' || t.d AS name, 'public' AS modifiers,
    'p' || (t.d % 7) || '.C' || t.d AS qualified_name, '' AS extend, '' AS implements,
    'public ' || c.c_text AS raw,
    'public ' || t.head || t.abs_lines || t.iface || '}' AS abstract,
    'public ' || t.head || t.cmp_lines || t.iface || '}' AS abstract_compact
  FROM jt t JOIN java_c c ON c.d = t.d
)"""

ORACLE["java_types"] = "WITH " + JAVA_T + r"""
SELECT proj_name, relative_path, name, modifiers, qualified_name, extend, implements, raw, abstract, abstract_compact
FROM types
"""

ORACLE["java_fields"] = "WITH " + JAVA + r"""
SELECT proj_name, relative_path, 'C' || d AS class, 'int' AS type, 'private' AS modifiers, 'x' || d AS name,
  'private int x' || d || ';' AS raw FROM java_head
UNION ALL
SELECT proj_name, relative_path, 'C' || d, 'String', 'private static final', 'NAME' || d,
  'private static final String NAME' || d || ' = "a//b{";' FROM java_head
"""

ORACLE["java_methods"] = "WITH " + JAVA + r"""
SELECT c.proj_name, c.relative_path,
  CASE WHEN l.d % 5 = 0 AND l.i = l.n - 1 THEN 'N' || l.d ELSE 'C' || l.d END AS class,
  'f' || (l.i // 2) AS name, 'void' AS return_type, 'public' AS modifiers,
  'int a, ' || CASE WHEN l.i % 2 = 1 THEN 'C' || (l.d + 7) ELSE 'String' END || ' b' AS parameters,
  ltrim(l.sig) || l.body || '}' AS raw
FROM java_l l JOIN java_head c ON c.d = l.d
UNION ALL
SELECT proj_name, relative_path, 'J' || d, 'ping' || d, 'void', '', 'int a', 'void ping' || d || '(int a);'
FROM java_head WHERE d % 7 = 0
"""

ORACLE["type_context"] = "WITH " + JAVA_T + r"""
SELECT c.proj_name, c.relative_path,
  CASE WHEN l.d % 5 = 0 AND l.i = l.n - 1 THEN 'N' || l.d ELSE 'C' || l.d END AS class,
  'f' || (l.i // 2) AS name,
  CASE WHEN l.i % 2 = 1 AND t.abstract IS NOT NULL THEN t.abstract || '<param_class>'
       ELSE '<not_self_defined_class>' END AS param_context
FROM java_l l JOIN java_head c ON c.d = l.d
LEFT JOIN types t ON t.proj_name = c.proj_name AND t.qualified_name = 'p' || (l.d % 7) || '.C' || (l.d + 7)
"""

TEST_LOG = r"""
fails AS (
  SELECT e.event_id, list((e.event_id + n) % 10) AS f
  FROM events e, range(1, 4) r(n) WHERE e.event_type = 'click' AND n <= 1 + e.event_id % 3 GROUP BY e.event_id
),
tcase AS (
  SELECT k, E'\n  @Test\n  public void test' || k || E'() throws Throwable {\n    int v = ' || k || E';\n    if (v > 0) { v--; }\n  }\n' AS code
  FROM range(0, 10) r(k)
)"""

ORACLE["test_split"] = "WITH " + TEST_LOG + r"""
SELECT e.event_id, 10 AS n_tests,
  E'package p;\n\nimport org.junit.Test;\n\npublic class RegressionPassTest0 {\n'
    || (SELECT string_agg(CASE WHEN list_contains(coalesce(f.f, []), t.k) THEN E'\n  \n' ELSE t.code END, '' ORDER BY t.k) FROM tcase t)
    || E'}\n' AS pass_test_code,
  E'package p;\n\nimport org.junit.Test;\n\npublic class RegressionFailTest0 {\n'
    || (SELECT string_agg(CASE WHEN list_contains(coalesce(f.f, []), t.k) THEN t.code ELSE E'\n  \n' END, '' ORDER BY t.k) FROM tcase t)
    || E'}\n' AS fail_test_code
FROM events e LEFT JOIN fails f ON f.event_id = e.event_id
"""

ORACLE["feedback_lines"] = "WITH " + JAVA_FILE + ", " + MAVEN_LOGS + r""",
fb AS (
  SELECT l.event_id, l.proj_name, l.relative_path,
    CASE WHEN l.fill_failed THEN '<execute_error>' WHEN m.entries IS NULL THEN '<success>'
         ELSE array_to_string(m.entries, E'\n') END AS compiler_feedback
  FROM mvn_logs l LEFT JOIN mvn_entries m USING (event_id)
),
ent AS (
  SELECT fb.event_id, fb.proj_name, fb.relative_path, fb.compiler_feedback, j.source_code, u.e, u.i
  FROM fb LEFT JOIN java_file j ON j.relative_path = fb.relative_path AND j.proj_name = fb.proj_name,
       unnest(string_split(fb.compiler_feedback, E'\n')) WITH ORDINALITY AS u(e, i)
)
SELECT event_id, CASE WHEN any_value(source_code) IS NULL THEN 'no_file' ELSE 'ok' END AS feedback_status,
  CASE WHEN any_value(source_code) IS NULL OR any_value(compiler_feedback) IN ('<success>', '<execute_error>')
       THEN any_value(compiler_feedback) ELSE coalesce(string_agg(
  CASE WHEN regexp_extract(e, '<file>(.*?)<line>(\d+)<col>(\d+)<err>(.*)', 1) = proj_name || '/' || relative_path
        AND string_split(source_code, E'\n')[CAST(regexp_extract(e, '<file>(.*?)<line>(\d+)<col>(\d+)<err>(.*)', 2) AS INTEGER)] IS NOT NULL
       THEN '<file>' || regexp_extract(e, '<file>(.*?)<line>(\d+)<col>(\d+)<err>(.*)', 1)
         || '<line>' || regexp_extract(e, '<file>(.*?)<line>(\d+)<col>(\d+)<err>(.*)', 2)
         || '<col>' || regexp_extract(e, '<file>(.*?)<line>(\d+)<col>(\d+)<err>(.*)', 3)
         || '<line_of_code>' || coalesce(string_split(source_code, E'\n')[CAST(regexp_extract(e, '<file>(.*?)<line>(\d+)<col>(\d+)<err>(.*)', 2) AS INTEGER)], '')
         || '<err>' || regexp_extract(e, '<file>(.*?)<line>(\d+)<col>(\d+)<err>(.*)', 4)
       ELSE e END, E'\n' ORDER BY i) FILTER (WHERE regexp_matches(e, '<file>(.*?)<line>(\d+)<col>(\d+)<err>(.*)')), '') END AS new_compiler_feedback
FROM ent GROUP BY event_id
"""

ORACLE["generation_status"] = r"""
SELECT event_id, 'test' || (event_id % 12) AS func_name,
  event_type NOT IN ('click', 'error') AND event_id % 12 < 10 AS generate_status
FROM events
"""

ORACLE["build_status"] = r"""
SELECT 'own_src' || CAST(user_id % 20 AS VARCHAR) AS proj_name,
  bool_or(event_type NOT IN ('click', 'error')) AS builds, count(*) AS n_runs
FROM events GROUP BY 1
"""

ORACLE["run_status_counts"] = r"""
SELECT CASE WHEN event_type NOT IN ('click', 'error') THEN 'ok' WHEN event_type = 'click' THEN 'some_fail' ELSE 'cannot_run' END AS run_label,
  count(*) FILTER (WHERE event_type <> 'error') AS n_true, count(*) AS n
FROM events GROUP BY 1
"""

ORACLE["jar_choice"] = r"""
SELECT 'own_' || source AS proj_name, 'mod/target' AS target_dir,
  CASE WHEN count(*) FILTER (WHERE doc_id % 3 < 2) = 0 THEN ''
       ELSE coalesce('mod/target/' || min('x-' || doc_id || '-jar-with-dependencies.jar') FILTER (WHERE doc_id % 3 = 0),
                     'mod/target/classes') END AS jar
FROM documents GROUP BY 1
"""

ORACLE["candidate_split"] = r"""
SELECT conv_id, turn, CAST(i - 1 AS INTEGER) AS idx, candidate FROM (
  SELECT conv_id, turn, u.candidate, u.i
  FROM conversations, unnest(string_split(text, '.')[1:len(string_split(text, '.')) - 1]) WITH ORDINALITY AS u(candidate, i)
  WHERE role = 'assistant')
"""

ORACLE["java_used_context"] = "WITH " + JAVA + r"""
SELECT c.proj_name, c.relative_path, 'f' || k AS func_name,
  CASE WHEN max(l.i) % 2 = 1 THEN 'C' || (c.d + 7) ELSE '' END AS re_type, '' AS re_method
FROM (SELECT *, i // 2 AS k FROM java_l) l JOIN java_head c ON c.d = l.d
GROUP BY c.proj_name, c.relative_path, c.d, k
"""

KEYWORDS = ("['return', 'new', 'throw', 'if', 'else', 'for', 'while', 'do', 'switch', 'case', 'try', 'catch',"
            " 'finally', 'break', 'continue', 'assert', 'yield', 'emit', 'require', 'revert', 'delete', 'this', 'super']")

ORACLE["accessible_identifiers"] = "WITH " + SOL + r"""
SELECT d AS source_idx, 'C' || d AS contract_name, 'f' || (i // 2) AS func_name,
  array_to_string(list_sort(list_distinct(list_filter(string_split(x, ' '),
    lambda w: regexp_matches(w, '^[A-Za-z_]') AND NOT list_contains(""" + KEYWORDS + r""", w)))), ',') AS identifiers
FROM sol_l
UNION ALL SELECT d, name, 'g' || d || '_' || k, '' FROM base_c
UNION ALL SELECT d, name, 'h' || d || '_' || k, '' FROM base_c
UNION ALL SELECT d, name, 'm' || d, 'v' FROM side_c
"""

ORACLE["lookup_chain"] = r"""
SELECT l.l_orderkey, l.l_linenumber, o.o_custkey, c.c_name
FROM lineitem l LEFT JOIN orders o ON o.o_orderkey = l.l_orderkey LEFT JOIN customer c ON c.c_custkey = o.o_custkey
"""

ORACLE["profile"] = r"""
SELECT 'lang' AS column, sum(freq) AS count, count(value) AS unique,
  arg_min(value, struct_pack(f := -freq, v := value)) AS top, max(freq) AS freq
FROM (SELECT lang AS value, count(*) AS freq FROM documents GROUP BY 1)
UNION ALL
SELECT 'source', sum(freq), count(value), arg_min(value, struct_pack(f := -freq, v := value)), max(freq)
FROM (SELECT source AS value, count(*) AS freq FROM documents GROUP BY 1)
"""

ORACLE["new_repos"] = r"""
WITH p AS (SELECT page_id, string_split(url, '/')[-2] || '_' || string_split(url, '/')[-1] AS owner_repo FROM pages)
SELECT page_id, owner_repo FROM p WHERE owner_repo NOT IN (SELECT owner_repo FROM p WHERE page_id % 3 = 0)
"""

ORACLE["first_rows"] = "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 100"

ORACLE["row_range"] = "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 20 OFFSET 10"

ORACLE["inspect_rows"] = r"""
SELECT conv_id, turn, role FROM conversations ORDER BY md5('42:' || conv_id || ':' || turn), conv_id, turn LIMIT 3
"""


ORACLE["match_back"] = "WITH " + JAVA + r"""
, m AS (
  SELECT proj_name, relative_path, d, i, 'f' || (i // 2) AS func_name, body,
    left(c_text, CAST(off + length(nopen) + length(cm) + length(sig) AS BIGINT)) || '<FILL_FUNCTION_BODY>'
    || substr(c_text, CAST(off + length(nopen) + length(cm) + length(sig) + length(body) + 1 AS BIGINT)) AS masked_class
  FROM java_fn
)
SELECT proj_name, relative_path, 'C' || d AS class_name, func_name, body AS func_body, masked_class
FROM m WHERE EXISTS (SELECT 1 FROM lines e WHERE e.d = m.d AND 'f' || (e.i // 2) = m.func_name AND e.x = trim(m.body)
  AND NOT (e.d % 3 = 1 AND e.i % 4 = 3))
"""

ORACLE["java_refill"] = "WITH " + JAVA_FILE + r"""
SELECT f.proj_name, f.relative_path, CASE WHEN f.i // 2 = 2 THEN 'Gone' ELSE 'C' || f.d END AS class_name, 'f' || (f.i // 2) AS func_name,
  CASE WHEN f.i // 2 = 2 THEN 'not_found' ELSE 'ok' END AS status,
  CASE WHEN f.i // 2 <> 2 THEN 'package p' || (f.d % 7) || E';\n\nimport java.util.List;\n\n/** Class C' || f.d || E'. */\npublic '
  || left(f.c_text, CAST(f.off + length(f.nopen) + length(f.cm) + length(f.sig) AS BIGINT)) || upper(f.body)
  || substr(f.c_text, CAST(f.off + length(f.nopen) + length(f.cm) + length(f.sig) + length(f.body) + 1 AS BIGINT)) || E'\n' END AS filled_file
FROM java_fn f
"""

ORACLE["refill_contracts"] = "WITH " + ALL_FN + r"""
SELECT h.source_idx, h.contract_name, h.func_name,
  left(s.source_code, CAST(strpos(s.source_code, f.cs) - 1 AS BIGINT))
  || replace(h.masked_body, '<FILL_FUNCTION_BODY>', upper(h.func_body) || E'\n')
  || substr(s.source_code, CAST(strpos(s.source_code, f.cs) + length(f.cs) AS BIGINT)) AS source_code_filled
FROM h14 h JOIN fn f ON f.d = h.source_idx AND f.contract = h.contract_name AND f.fname = h.func_name AND f.fpos = h.fpos
JOIN sol_file s ON s.d = h.source_idx
"""

ORACLE["overload_histogram"] = "WITH " + SOL + r"""
, names AS (
  SELECT d, 'C' || d AS c, 'f' || (i // 2) AS n, count(*) AS k FROM sol_l GROUP BY 1, 2, 3
  UNION ALL SELECT d, name, 'g', 1 FROM base_c
  UNION ALL SELECT d, name, 'h', 1 FROM base_c
  UNION ALL SELECT d, name, 'm', 1 FROM side_c
)
SELECT k AS n_matches, sum(k) AS n_rows, count(*) AS n_keys FROM names GROUP BY k
"""


ORACLE["line_offsets"] = r"""
SELECT doc_id, CAST(i AS INTEGER) AS line_no,
  CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS line_start,
  CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 3 AS INTEGER) AS col3
FROM (SELECT doc_id, u.line, u.i FROM documents, unnest(string_split(text, E'\n')) WITH ORDINALITY AS u(line, i))
"""

ORACLE["task_sources"] = "WITH RECURSIVE " + ALL_FN + "," + INHERIT + ", " + SOL_LOGS + ", " + COMPILE_INFO + r""",
fim AS (
  SELECT f.*, '<｜fim▁begin｜>' || replace(f.masked_body, '<FILL_FUNCTION_BODY>', '<｜fim▁hole｜>') || '<｜fim▁end｜>' AS p,
    coalesce(a.els, '') AS inherit, c.compile_info
  FROM h14 f LEFT JOIN agg a ON a.d = f.source_idx AND a.root = f.contract_name
  LEFT JOIN compiled c ON c.event_id = f.source_idx
)
SELECT source_idx, contract_name, func_name,
  p || E'\n<ouput>\n' || upper(func_body) || E'\n<compile>\n' || replace(compile_info, '<COMPILED_SUCCESSFULLY>', 'success')
    || E'\n<inherit>\n' || inherit || E'\n<correct> ' AS source_final,
  p || E'\n<ouput>\n' || upper(func_body) || E'\n<inherit>\n' || inherit || E'\n<correct> ' AS source_disable,
  p AS source_plain
FROM fim
"""


# --- joins without an equal key ---

ORACLE["nearest_event"] = """
WITH e AS (SELECT event_id, event_type, epoch_us(ts) AS t FROM events),
k AS (SELECT t, list(event_id ORDER BY event_id)[1] AS a, list(event_id ORDER BY event_id)[2] AS b FROM e GROUP BY t),
er AS (SELECT * FROM e WHERE event_type = 'error'),
c AS (
  SELECT er.event_id, 0 AS gap, er.t AS t, CASE WHEN k.a = er.event_id THEN k.b ELSE k.a END AS near FROM er JOIN k USING (t)
  UNION ALL SELECT er.event_id, er.t - k.t, k.t, k.a FROM er ASOF JOIN k ON er.t > k.t
  UNION ALL SELECT er.event_id, k.t - er.t, k.t, k.a FROM er ASOF JOIN k ON er.t < k.t),
r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY gap, t, near) AS n FROM c WHERE near IS NOT NULL)
SELECT er.event_id, r.near AS near_id, e.event_type AS near_type, r.gap::BIGINT AS gap_us
FROM er LEFT JOIN r ON r.event_id = er.event_id AND r.n = 1 LEFT JOIN e ON e.event_id = r.near
"""

ORACLE["nearest_purchase"] = """
WITH e AS (SELECT event_id, event_type, user_id, epoch_us(ts) AS t FROM events),
k AS (SELECT user_id, t, min(event_id) AS a FROM e WHERE event_type = 'purchase' GROUP BY ALL),
er AS (SELECT * FROM e WHERE event_type = 'error'),
c AS (
  SELECT er.event_id, er.t - k.t AS gap, k.t AS t, k.a AS near FROM er ASOF JOIN k ON er.user_id = k.user_id AND er.t >= k.t
  UNION ALL SELECT er.event_id, k.t - er.t, k.t, k.a FROM er ASOF JOIN k ON er.user_id = k.user_id AND er.t < k.t),
r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY gap, t, near) AS n FROM c)
SELECT er.event_id, er.user_id, r.near AS near_id, r.gap::BIGINT AS gap_us
FROM er LEFT JOIN r ON r.event_id = er.event_id AND r.n = 1
"""

ORACLE["best_document"] = r"""
WITH t AS (
  SELECT 'i' AS side, item_id AS id, regexp_replace(lower(text), '\s+', '', 'g') AS x FROM benchmark
  UNION ALL SELECT 'd', doc_id, regexp_replace(lower(text), '\s+', '', 'g') FROM documents),
g AS (SELECT side, id, length(x) - 1 AS n, x[i:i + 1] AS b FROM (SELECT *, unnest(range(1, length(x))) AS i FROM t)),
c AS (SELECT side, id, n, b, count(*) AS k FROM g GROUP BY ALL),
s AS (
  SELECT i.id AS item_id, d.id AS doc_id, 2.0::DOUBLE * sum(least(i.k, d.k)) / any_value(i.n + d.n) AS similarity
  FROM c i JOIN c d ON i.b = d.b WHERE i.side = 'i' AND d.side = 'd' GROUP BY ALL)
SELECT item_id, doc_id, round(similarity, 6) AS similarity
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, doc_id) AS r FROM s) WHERE r = 1
"""

ORACLE["containment_samples"] = ORACLE["masked_samples"]

_NAMES = "SELECT item_id, string_split(text, ' ')[item_id % 5 + 1] AS name FROM benchmark"

ORACLE["name_mentions"] = f"""
SELECT item_id, name, doc_id FROM ({_NAMES}) JOIN documents ON contains(text, name)
"""

ORACLE["generation_mentions"] = f"""
SELECT item_id, any_value(name) AS func_name, count(doc_id) AS n_mentions, item_id % 3 = 0 AND count(doc_id) > 0 AS generate_status
FROM ({_NAMES}) LEFT JOIN documents ON contains(text, name) GROUP BY item_id
"""

ORACLE["brace_samples"] = ORACLE["masked_samples"]

ORACLE["nested_samples"] = "WITH " + DOCS + r""",
piece AS (
  SELECT d, i, '  int g' || i || '() {' AS gsig, ' ' || x || ' ' AS body,
    CASE i % 3 WHEN 0 THEN '  void f' || i || '(int a) {'
      WHEN 1 THEN '  Runnable r' || i || E' = new Thread() {\n    public void run' || i || '() {'
      ELSE '  int g' || i || E'() {\n    class L' || i || E' {\n      String h' || i || '(String s) {' END AS pre,
    CASE i % 3 WHEN 0 THEN E'}\n' WHEN 1 THEN E'}\n  };\n' ELSE E'}\n    }\n    return 0;\n  }\n' END AS post
  FROM lines),
file AS (
  SELECT h.d, 'own_' || h.source AS proj_name,
    'mod/src/' || CASE WHEN h.d % 10 = 9 THEN 'test' ELSE 'main' END || '/java/p' || (h.d % 7) || '/C' || h.d || '.java' AS relative_path,
    'class C' || h.d || E' {\n  private int x = "{".length(); // }\n  C' || h.d || E'(int a) { super(); }\n' AS head,
    coalesce((SELECT string_agg(pre || body || post, '' ORDER BY i) FROM piece p WHERE p.d = h.d), '') AS members,
    '  interface J' || h.d || E' { default void q(int a) { return; } }\n}' AS tail
  FROM docs h),
placed AS (
  SELECT p.*, f.proj_name, f.relative_path, f.head || f.members || f.tail AS c_text,
    length(f.head) + coalesce(sum(length(pre || body || post)) OVER (PARTITION BY p.d ORDER BY i
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
  FROM piece p JOIN file f USING (d)),
fn AS (
  SELECT d, proj_name, relative_path, c_text, CASE i % 3 WHEN 0 THEN 'f' WHEN 1 THEN 'run' ELSE 'h' END || i AS func_name,
    body AS func_body, (off + length(pre))::BIGINT AS a FROM placed
  UNION ALL
  SELECT d, proj_name, relative_path, c_text, 'g' || i, substr(pre || body || post, length(gsig) + 1,
    length(pre || body || post) - length(gsig) - 2), (off + length(gsig))::BIGINT FROM placed WHERE i % 3 = 2)
SELECT proj_name, relative_path, 'C' || d AS class_name, func_name, func_body,
  left(c_text, a) || '<FILL_FUNCTION_BODY>' || substr(c_text, a + length(func_body) + 1) AS masked_class
FROM fn
"""

ORACLE["commented_functions_flat"] = ORACLE["commented_functions"]
ORACLE["batched_results"] = ORACLE["compile_status"]

ORACLE["numbered_lines"] = """
SELECT 'doc' || doc_id || '.txt' AS file, (unnest(range(len(l))))::BIGINT AS line_no, unnest(l) AS line
FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
"""

ORACLE["benchmark_rows"] = "WITH " + SOL_FILE + """,
fns AS (
  SELECT d, 'g' || d || '_' || k AS func_name, ' return; ' AS func_body FROM base_c
  UNION ALL SELECT d, 'h' || d || '_' || k, ' return; ' FROM base_c
  UNION ALL SELECT d, 'm' || d, ' return v; ' FROM side_c
  UNION ALL SELECT d, 'f' || (i // 2), body FROM sol_fn)
SELECT d AS file_source_idx, func_name, func_body, upper(func_body) AS output, 'ok' AS status, md5(source_code) AS file_source_md5
FROM fns JOIN sol_file USING (d)
"""


def _profile(table: str, columns: list[str]) -> str:
    """Every column of a table counted by itself."""
    one = ("SELECT '{t}' AS \"table\", '{c}' AS \"column\", sum(n)::BIGINT AS count, count(v) AS \"unique\","
           " arg_min(v, (-n, v)) FILTER (v IS NOT NULL) AS top, max(n) FILTER (v IS NOT NULL) AS freq"
           " FROM (SELECT {c}::VARCHAR AS v, count(*) AS n FROM {t} GROUP BY 1)")
    return " UNION ALL ".join(one.format(t=table, c=c) for c in columns)


ORACLE["profile_tables"] = " UNION ALL ".join([
    _profile("documents", ["doc_id", "text", "lang", "source", "n_chars"]), _profile("labels", ["doc_id", "quality", "toxic"]),
    _profile("events", ["event_id", "user_id", "event_type", "value", "props"])])

# Random inputs: md5 words to decimal digits, 32 bits at a time, in limbs of 18 digits.
_VALUES = """
parsed AS (
  SELECT *, CASE WHEN type LIKE '%]' THEN regexp_extract(type, '^(.+)\\[([0-9]+)\\]$', 1) ELSE type END AS base,
         CASE WHEN type LIKE '%]' THEN regexp_extract(type, '^(.+)\\[([0-9]+)\\]$', 2)::INT END AS n
  FROM params),
items AS (
  SELECT *, key || ':' || i AS item FROM (SELECT *, unnest(range(1, coalesce(n, 1) + 1)) AS i FROM parsed)
  WHERE regexp_full_match(base, 'u?int[0-9]*|bool|address|string')),
ints AS (
  SELECT *, right(CASE WHEN bits > 128 THEN md5(item || ':0') || md5(item || ':1') ELSE md5(item || ':0') END, bits // 4) AS own
  FROM (SELECT *, coalesce(nullif(regexp_extract(base, '([0-9]*)$', 1), ''), '256')::INT AS bits FROM items WHERE base LIKE '%int%')),
signs AS (
  SELECT *, base NOT LIKE 'u%' AND own[1] < '8' AS negative FROM ints),
sized AS (
  SELECT *, CASE WHEN base LIKE 'u%' THEN own
    WHEN negative THEN substr('76543210', ('0x' || own[1])::INT + 1, 1) || translate(own[2:], '0123456789abcdef', 'fedcba9876543210')
    ELSE (('0x' || own[1])::INT - 8)::VARCHAR || own[2:] END AS size_hex FROM signs),
horner AS (
  SELECT item, lpad(size_hex, 64, '0') AS x, negative, 0 AS step, 0::HUGEINT AS a, 0::HUGEINT AS b, 0::HUGEINT AS c, 0::HUGEINT AS d, 0::HUGEINT AS e
  FROM sized
  UNION ALL
  SELECT item, x, negative, step + 1, ta % q, tb % q, tc % q, td % q, e * 4294967296 + td // q
  FROM (SELECT *, d * 4294967296 + tc // q AS td FROM (SELECT *, c * 4294967296 + tb // q AS tc
        FROM (SELECT *, b * 4294967296 + ta // q AS tb FROM (
          SELECT *, 1000000000000000000::HUGEINT AS q, a * 4294967296 + ('0x' || substr(x, step * 8 + 1, 8))::BIGINT
                    + CASE WHEN step = 7 AND negative THEN 1 ELSE 0 END AS ta FROM horner WHERE step < 8))))),
digits AS (
  SELECT item, negative, ltrim(lpad(e::VARCHAR, 18, '0') || lpad(d::VARCHAR, 18, '0') || lpad(c::VARCHAR, 18, '0')
         || lpad(b::VARCHAR, 18, '0') || lpad(a::VARCHAR, 18, '0'), '0') AS t FROM horner WHERE step = 8),
elements AS (
  SELECT i.*, CASE WHEN base LIKE '%int%' THEN CASE WHEN negative THEN '-' ELSE '' END || CASE WHEN t = '' THEN '0' ELSE t END
    WHEN base = 'bool' THEN CASE WHEN ('0x' || substr(md5(i.item), 1, 2))::INT % 2 = 1 THEN 'true' ELSE 'false' END
    WHEN base = 'address' THEN (['0xca35b7d915458ef540ade6068dfe2f44e8fa733c', '0x14723a09acff6d2a60dcdf7aa4aff308fddc160c',
      '0x4b0897b0513fdc7c541b6d9d7e929c4e5364d2db', '0x583031d1113ad414f02576bd6afabfb302140225',
      '0xdd870fa1b7c4700f2bd7f44238821c26f7392148'])[('0x' || substr(md5(i.item), 1, 2))::INT % 5 + 1]
    ELSE array_to_string(list_transform(range(10), lambda k: chr(32 + ('0x' || substr(md5(i.item), (2 * k + 1)::INT, 2))::INT % 95)), '') END AS v
  FROM items i LEFT JOIN digits USING (item))"""

ORACLE["abi_inputs"] = """
WITH RECURSIVE params AS (
  SELECT doc_id AS source_idx, pos::INT AS pos, 'p' || pos AS name, '42:' || doc_id || ':C' || doc_id || ':f:' || pos AS key,
    (['uint256', 'int256', 'uint8', 'int8', 'uint', 'int', 'int128[3]', 'uint72[2]', 'bool', 'bool[2]',
      'address', 'string', 'string[2]', 'bytes32', 'int104'])[(2 * doc_id + pos) % 15 + 1] AS type
  FROM documents, range(2) r(pos)),""" + _VALUES + """
SELECT source_idx, pos, any_value(type) AS type, any_value(name) AS name,
       CASE WHEN any_value(n) IS NULL THEN any_value(v) ELSE '[' || string_agg(v, ', ' ORDER BY i) || ']' END AS value
FROM elements GROUP BY source_idx, pos
"""

# A function's key holds its position among the spans of its file: contracts, members and comments in order.
ORACLE["typed_inputs"] = "WITH RECURSIVE " + DOCS + """,
fns AS (
  SELECT d, 'I' || d AS contract_name, 'ping' || d AS func_name, 1 AS ord, [('uint256', 'x')] AS ps FROM docs WHERE d % 5 = 1
  UNION ALL
  SELECT d, 'Side' || d, 'm' || d, 5 * (d % 4 + 1) + CASE WHEN d % 5 = 1 THEN 2 ELSE 0 END + 2, [('uint256', 'v')] FROM docs WHERE d % 10 = 0
  UNION ALL
  SELECT d, 'C' || d, 'f' || (i // 2), 5 * (d % 4 + 1) + CASE WHEN d % 5 = 1 THEN 2 ELSE 0 END + CASE WHEN d % 10 = 0 THEN 3 ELSE 0 END
    + 1 + i + (i + 1) // 3 * 3 + [0, 1, 3][(i + 1) % 3 + 1], [('uint256', 'a'), ('address', 'b')] FROM lines),
params AS (
  SELECT d AS source_idx, contract_name, func_name, ord, pos::INT AS pos, ps[pos + 1][1] AS type, ps[pos + 1][2] AS name,
         '42:' || d || ':' || contract_name || ':' || func_name || ':' || ord || ':' || pos AS key
  FROM (SELECT *, unnest(range(len(ps))) AS pos FROM fns)),""" + _VALUES + """
SELECT source_idx, contract_name, func_name, pos, type, name, v AS value FROM elements
"""

ORACLE["nested_types"] = ORACLE["java_types"]
ORACLE["brace_contracts"] = ORACLE["contracts"]
ORACLE["brace_functions"] = ORACLE["function_spans"]

ORACLE["test_split_varied"] = "WITH " + TEST_LOG + r""",
cases AS (
  SELECT event_id, k, E'\n  @Test' || CASE WHEN k % 2 = 1 THEN '(timeout = ' || event_id || ')' ELSE '' END
    || E'\n  public void test' || k || E'() throws Throwable {\n    String s = "}" + ' || (event_id * k) || E'; // @Test\n  }\n' AS code,
    CASE WHEN k % 3 = 0 THEN '  private int helper' || k || '() { return ' || event_id || E'; }\n' ELSE '' END AS helper
  FROM (SELECT event_id, unnest(range(event_id % 12)) AS k FROM events)),
flagged AS (SELECT c.*, list_contains(coalesce(f.f, []), c.k) AS fails FROM cases c LEFT JOIN fails f USING (event_id)),
parts AS (
  SELECT event_id, string_agg(CASE WHEN fails THEN E'\n  \n' ELSE code END || helper, '' ORDER BY k) AS passing,
    string_agg(CASE WHEN fails THEN code ELSE E'\n  \n' END || helper, '' ORDER BY k) AS failing
  FROM flagged GROUP BY event_id)
SELECT e.event_id, (e.event_id % 12)::INT AS n_tests,
  'package p' || (e.event_id % 5) || E';\n\nimport org.junit.Test;\n\npublic class RegressionPassTest0 {\n' || coalesce(passing, '') || E'}\n' AS pass_test_code,
  'package p' || (e.event_id % 5) || E';\n\nimport org.junit.Test;\n\npublic class RegressionFailTest0 {\n' || coalesce(failing, '') || E'}\n' AS fail_test_code
FROM events e LEFT JOIN parts p ON p.event_id = e.event_id
"""

ORACLE["brace_tree"] = "WITH " + DOCS + """,
node AS (
  SELECT d, 0 AS a, 0 AS b, 'interface' AS kind, 'I' || d AS name, 1 AS depth FROM docs WHERE d % 5 = 1
  UNION ALL SELECT d, 1, 3 * k, 'contract', 'Base' || d || '_' || k, 1 FROM (SELECT d, unnest(range(d % 4 + 1)) AS k FROM docs)
  UNION ALL SELECT d, 1, 3 * k + 1, 'function', 'g' || d || '_' || k, 2 FROM (SELECT d, unnest(range(d % 4 + 1)) AS k FROM docs)
  UNION ALL SELECT d, 1, 3 * k + 2, 'function', 'h' || d || '_' || k, 2 FROM (SELECT d, unnest(range(d % 4 + 1)) AS k FROM docs)
  UNION ALL SELECT d, 2, 0, 'contract', 'Side' || d, 1 FROM docs WHERE d % 10 = 0
  UNION ALL SELECT d, 2, 1, 'function', 'm' || d, 2 FROM docs WHERE d % 10 = 0
  UNION ALL SELECT d, 3, 0, 'contract', 'C' || d, 1 FROM docs
  UNION ALL SELECT d, 4, i, 'function', 'f' || (i // 2), 2 FROM lines)
SELECT d AS source_idx, CASE WHEN d % 7 = 3 THEN 'parse_error' ELSE 'ok' END AS status,
  CASE WHEN d % 7 = 3 THEN '<PARSER_ERROR>' ELSE to_json(list({'kind': kind, 'name': name, 'depth': depth} ORDER BY a, b))::VARCHAR END AS ast
FROM node GROUP BY d
"""
