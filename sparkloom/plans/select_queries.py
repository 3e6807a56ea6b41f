"""Queries over budgets, diffs and commit messages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.functions import tables
from sparkloom.functions import text as T
from sparkloom.operators import diff as D
from sparkloom.operators import select as SEL
from sparkloom.sources import bindings as B

from . import sql as S
from .registry import register

BUDGET = 9000


def _candidates(spark, sf_dir):
    """Files of each source with made-up depth, importance and one parent each."""
    f = B.files(spark, sf_dir)
    ws = F.split_part("path", F.lit("/"), F.lit(2))
    parent = F.when(F.col("doc_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("p"), (F.col("doc_id") % 5).cast("string"))))
    return f.select(
        ws.alias("workspace"), F.when(F.col("doc_id") < 20, F.concat(F.lit("p"), (F.col("doc_id") % 5).cast("string"))).otherwise(F.col("path")).alias("path"), (F.col("doc_id") < 20).alias("is_root"),
        (F.col("doc_id") % 11 == 0).alias("is_companion"), (F.col("doc_id") % 4).cast("int").alias("depth"), (F.col("doc_id") * 37 % 100).cast("int").alias("importance"),
        T.token_estimate(F.col("content")).alias("tokens"), parent.alias("parents"), "doc_id",
    )


_CAND = "WITH RECURSIVE " + B.files_sql() + f""", cand AS (SELECT split_part(path, '/', 2) AS workspace, CASE WHEN doc_id < 20 THEN 'p' || (doc_id % 5) ELSE path END AS path, doc_id < 20 AS is_root, doc_id % 11 = 0 AS is_companion,
 (doc_id % 4)::INT AS depth, (doc_id * 37 % 100)::INT AS importance, {S.token_estimate('content')} AS tokens, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'p' || (doc_id % 5) END AS parent, doc_id FROM files)"""


@register("budget_none", _CAND + ", x AS (SELECT workspace, sum(tokens)::BIGINT + 500 AS full_tokens FROM cand GROUP BY workspace) SELECT * FROM x")
def budget_none(spark, sf_dir):
    return SEL.totals(_candidates(spark, sf_dir))


_GREEDY = _CAND + f""", ord AS (SELECT *, row_number() OVER (PARTITION BY workspace ORDER BY is_companion DESC, depth, importance DESC, upper(path)) AS rn FROM cand WHERE NOT is_root),
 st AS (SELECT w.workspace, coalesce(sum(tokens), 0)::BIGINT AS acc, coalesce(list(DISTINCT path) FILTER (path IS NOT NULL), []) AS inc FROM (SELECT DISTINCT workspace FROM cand) w LEFT JOIN (SELECT * FROM cand WHERE is_root) r USING (workspace) GROUP BY w.workspace),
 g(workspace, rn, acc, inc, doc_id, taken) AS (SELECT workspace, 0::BIGINT, acc, inc, -1::BIGINT, false FROM st UNION ALL
  SELECT g.workspace, o.rn, CASE WHEN (o.parent IS NULL OR list_contains(g.inc, o.parent)) AND g.acc + o.tokens <= {SEL.available(BUDGET)} THEN g.acc + o.tokens ELSE g.acc END,
   CASE WHEN (o.parent IS NULL OR list_contains(g.inc, o.parent)) AND g.acc + o.tokens <= {SEL.available(BUDGET)} THEN list_append(g.inc, o.path) ELSE g.inc END, o.doc_id,
   (o.parent IS NULL OR list_contains(g.inc, o.parent)) AND g.acc + o.tokens <= {SEL.available(BUDGET)} FROM g JOIN ord o ON o.workspace = g.workspace AND o.rn = g.rn + 1),
 sel AS (SELECT c.*, is_root OR coalesce(g.taken, false) AS included FROM cand c LEFT JOIN g ON g.doc_id = c.doc_id)"""


@register("budget_greedy", _GREEDY + " SELECT doc_id, included, CASE WHEN NOT included THEN 'TokenBudget' END AS reason FROM sel")
def budget_greedy(spark, sf_dir):
    return SEL.greedy(_candidates(spark, sf_dir), BUDGET).select("doc_id", "included", "reason")


@register("budget_summary", _GREEDY + f", z AS (SELECT workspace, sum(CASE WHEN included THEN tokens ELSE 0 END)::BIGINT + 500 AS final_tokens, coalesce(sum(tokens) FILTER (is_root), 0) > {SEL.available(BUDGET)} AS root_alone FROM sel GROUP BY workspace) SELECT *, final_tokens <= {BUDGET} OR root_alone AS budget_met FROM z")
def budget_summary(spark, sf_dir):
    return SEL.summary(SEL.greedy(_candidates(spark, sf_dir), BUDGET), BUDGET)


@register("budget_auto_comments")
def budget_auto_comments(spark, sf_dir):
    files = B.files(spark, sf_dir).select(F.split_part("path", F.lit("/"), F.lit(2)).alias("workspace"), "doc_id", "path", "ext", "content")
    return SEL.auto_tokens(files, 40_000).select("doc_id", "workspace", "removed", "tokens")


@register("running_budget_cut", _CAND + ", r AS (SELECT doc_id, workspace, tokens, sum(tokens) OVER w AS total, row_number() OVER w AS nth FROM cand WINDOW w AS (PARTITION BY workspace ORDER BY importance DESC, upper(path), doc_id ROWS UNBOUNDED PRECEDING)) SELECT doc_id, workspace, tokens, total::BIGINT AS total FROM r WHERE total <= 6000 OR nth = 1")
def running_budget_cut(spark, sf_dir):
    c = _candidates(spark, sf_dir)
    return SEL.running_cut(c, 6000, [F.desc("importance"), F.upper("path"), F.asc("doc_id")]).select("doc_id", "workspace", "tokens", "total")


# --- diffs -----------------------------------------------------------------

_SYM = D.SYMBOL.replace("*+", "*")
_KW = S.listed(tables.DIFF_KEYWORDS)
_sym = "CASE " + " ".join(f"WHEN regexp_extract(body, {S.text(_SYM)}, {g}) <> '' AND regexp_extract(body, {S.text(_SYM)}, {g}) NOT IN {_KW} THEN regexp_extract(body, {S.text(_SYM)}, {g})" for g in (1, 2, 3)) + " END"
_PARSED = "WITH " + B.diff_sql() + f""", d1 AS (SELECT path, status, line, CASE WHEN regexp_matches(line, {S.text(D.HUNK)}) THEN 'hunk' WHEN starts_with(line, '+') THEN 'add' WHEN starts_with(line, '-') THEN 'del' END AS kind
  FROM diff_lines WHERE NOT (starts_with(line, '+++') OR starts_with(line, '---') OR starts_with(line, 'diff --git') OR starts_with(line, 'index ')) AND line <> ''),
 d2 AS (SELECT path, status, kind, CASE WHEN kind = 'hunk' THEN trim(regexp_extract(line, {S.text(D.HUNK)}, 1)) ELSE substr(line, 2) END AS body FROM d1 WHERE kind IS NOT NULL),
 parsed AS (SELECT path, status, kind, {_sym} AS symbol, kind = 'add' AND regexp_matches(body, {S.text(D.FIX)}) AS fix FROM d2),
 stats AS (SELECT path, status, count(*) FILTER (kind = 'add') AS insertions, count(*) FILTER (kind = 'del') AS deletions, count(*) FILTER (fix) AS fixes FROM parsed GROUP BY path, status),
 flags AS (SELECT path, symbol, bool_or(kind = 'add') AS a, bool_or(kind = 'del') AS d, bool_or(kind = 'hunk') AS h FROM parsed WHERE symbol IS NOT NULL GROUP BY path, symbol),
 sets AS (SELECT path, list_sort(list(symbol) FILTER (a AND NOT d)) AS added, list_sort(list(symbol) FILTER ((a AND d) OR (h AND NOT a))) AS modified, list_sort(list(symbol) FILTER (d AND NOT a)) AS removed FROM flags GROUP BY path)"""


@register("diff_stats", _PARSED + " SELECT * FROM stats")
def diff_stats(spark, sf_dir):
    return D.stats(B.diff_lines(spark, sf_dir))


@register("diff_symbol_sets", _PARSED + " SELECT path, coalesce(array_to_string(added, ','), '') AS added, coalesce(array_to_string(modified, ','), '') AS modified, coalesce(array_to_string(removed, ','), '') AS removed FROM sets")
def diff_symbol_sets(spark, sf_dir):
    s = D.symbol_sets(B.diff_lines(spark, sf_dir))
    return s.select("path", *[F.array_join(c, ",").alias(c) for c in ("added", "modified", "removed")])


def _changes(spark, sf_dir):
    rows = D.summaries(B.diff_lines(spark, sf_dir))
    return rows.withColumn("grp", F.concat_ws("/", F.split_part("path", F.lit("/"), F.lit(2)), T.extension(F.col("path"))))


_CHANGES = _PARSED + ", ch AS (SELECT s.*, added, modified, removed, coalesce(len(added), 0) AS n_added, split_part(path, '/', 2) || '/' || CASE WHEN position('.' IN split_part(path, '/', -1)) > 0 THEN '.' || lower(split_part(path, '.', -1)) ELSE '' END AS grp FROM stats s LEFT JOIN sets USING (path))"
_e = lambda *xs: S.any_of([f"ends_with(upper(path), {S.text(x.upper())})" for x in xs])


_TYPE = _CHANGES + f""" SELECT grp, CASE WHEN bool_and({_e('.md', '.txt')} OR starts_with(upper(path), 'DOCS/')) THEN 'docs'
 WHEN bool_and(starts_with(upper(path), 'TESTS/') OR starts_with(upper(path), 'TEST/') OR contains(upper(path), '.TEST.') OR contains(upper(path), '.SPEC.') OR {_e('Tests.cs')}) THEN 'test'
 WHEN bool_and({_e('.css', '.scss', '.sass', '.svg')}) THEN 'style' WHEN bool_and({_e('.json', '.csproj', '.sln', '.yml', '.yaml', '.toml')}) THEN 'chore'
 WHEN bool_or(status = 'Added') OR sum(n_added) > 0 THEN 'feat' WHEN sum(fixes) >= 2 THEN 'fix' ELSE 'refactor' END AS type FROM ch GROUP BY grp"""


@register("commit_type", _TYPE)
def commit_type(spark, sf_dir):
    return D.commit_type(_changes(spark, sf_dir), "grp")


_SCOPE = _CHANGES + f""", f AS (SELECT grp, count(*) AS files, min(path) AS only_path FROM ch GROUP BY grp), sp AS (SELECT grp, path, string_split(path, '/')[1:-2] AS segs FROM ch),
 sg AS (SELECT grp, path, lower(unnest(segs)) AS seg, generate_subscripts(segs, 1) AS pos FROM sp), vt AS (SELECT grp, seg, count(*) AS votes, min(path || lpad(pos::VARCHAR, 4, '0')) AS fst FROM sg WHERE seg NOT IN {S.listed(tables.GENERIC_DIRS)} GROUP BY grp, seg),
 tp AS (SELECT DISTINCT ON (grp) grp, seg, votes FROM vt ORDER BY grp, votes DESC, fst, seg), st AS (SELECT f.*, regexp_replace(split_part(only_path, '/', -1), '\\.[^.]*$', '') AS own FROM f)
 SELECT st.grp, CASE WHEN files = 1 AND length(own) BETWEEN 1 AND 20 AND lower(own) NOT IN ('program', 'index') THEN lower(own) WHEN votes >= greatest(1, files // 2) THEN seg END AS scope FROM st LEFT JOIN tp USING (grp)"""


@register("commit_scope_vote", _SCOPE)
def commit_scope_vote(spark, sf_dir):
    return D.scope_votes(_changes(spark, sf_dir), "grp")


_told = lambda c, verb, most: f"CASE WHEN len({c}) > 0 THEN '{verb} ' || array_to_string({c}[1:{most}], ', ') END"
_DETAILS = f"concat_ws('; ', {_told('added', 'add', 4)}, {_told('modified', 'update', 4)}, {_told('removed', 'remove', 3)})"


@register("commit_draft", _CHANGES + f""", t AS (SELECT *, {_DETAILS} AS details FROM ch) SELECT grp, path, '- ' || CASE status WHEN 'Added' THEN 'Add' WHEN 'Deleted' THEN 'Remove' WHEN 'Renamed' THEN 'Rename' ELSE 'Update' END || ' '
 || CASE WHEN details <> '' THEN split_part(path, '/', -1) || ': ' || details ELSE path END || CASE WHEN insertions > 0 OR deletions > 0 THEN ' (+' || insertions || '/-' || deletions || ')' ELSE '' END AS bullet FROM t""")
def commit_draft(spark, sf_dir):
    """The lines of each group's commit message."""
    return D.draft(_changes(spark, sf_dir), "en", "grp")


_stem = "regexp_replace(split_part(path, '/', -1), '\\.[^.]*$', '')"
_two = lambda name, rows: f"{name} AS (SELECT grp, list(v ORDER BY p, k)[1:2] AS {name} FROM (SELECT grp, v, arg_min(p, (p, k)) AS p, arg_min(k, (p, k)) AS k FROM ({rows}) x GROUP BY grp, v) y GROUP BY grp)"
_of = lambda status: f"SELECT grp, {_stem} AS v, path AS p, 0 AS k FROM ch WHERE status = '{status}'"
_sy = lambda c: f"SELECT grp, unnest({c}) AS v, path AS p, generate_subscripts({c}, 1) AS k FROM ch WHERE len({c}) > 0"
_join = lambda c: f"array_to_string({c}, ', ')"
_SUBJECT = _CHANGES + ", " + ", ".join([_two("xnew", _of("Added")), _two("xold", _of("Modified")), _two("xgone", _of("Deleted")), _two("xsym", _sy("added")), _two("xmod", _sy("modified"))]) + f""",
 g AS (SELECT grp, count(*) AS files, sum(insertions)::BIGINT AS insertions, sum(deletions)::BIGINT AS deletions, min(path) AS hp, arg_min(status, path) AS hs, arg_min(coalesce(added, []), path) AS ha, arg_min(coalesce(modified, []), path) AS hm FROM ch GROUP BY grp),
 j AS (SELECT *, split_part(hp, '/', -1) AS file, coalesce('add ' || {_join('xnew')}, 'add ' || {_join('xsym')}) AS p1 FROM g LEFT JOIN xnew USING (grp) LEFT JOIN xold USING (grp) LEFT JOIN xgone USING (grp) LEFT JOIN xsym USING (grp) LEFT JOIN xmod USING (grp)
   JOIN ({_TYPE}) ty USING (grp) JOIN ({_SCOPE}) sc USING (grp)),
 q AS (SELECT *, coalesce('update ' || {_join('xold')}, CASE WHEN p1 IS NULL THEN 'update ' || {_join('xmod')} END) AS p2 FROM j),
 a AS (SELECT *, concat_ws(' and ', p1, p2, CASE WHEN p1 IS NULL OR p2 IS NULL THEN 'remove ' || {_join('xgone')} END) AS several,
   CASE WHEN hs = 'Added' AND len(ha) > 0 THEN 'add ' || file || ' (' || {_join('ha[1:2]')} || ')' WHEN hs = 'Added' THEN 'add ' || file WHEN hs = 'Deleted' THEN 'remove ' || file
     WHEN len(ha) > 0 THEN 'add ' || {_join('ha[1:2]')} || ' in ' || file WHEN len(hm) > 0 THEN 'update ' || {_join('hm[1:2]')} || ' in ' || file ELSE 'update ' || file END AS single FROM q),
 s AS (SELECT *, type || coalesce('(' || scope || ')', '') || ': ' || CASE WHEN files = 1 THEN single WHEN several <> '' THEN several ELSE 'update ' || files || ' files' END AS title FROM a)
 SELECT grp, CASE WHEN length(title) > 76 THEN regexp_replace(substr(title, 1, 73), '[, ;]+$', '') || '...' ELSE title END AS subject, files, insertions, deletions FROM s"""


@register("commit_subject", _SUBJECT)
def commit_subject(spark, sf_dir):
    """The first line of each group's commit message."""
    return D.subjects(_changes(spark, sf_dir), "en", "grp")


_UNTRACKED = "WITH " + B.files_sql() + ", l AS (SELECT path, string_split(content, chr(10)) AS l FROM files) SELECT path, '+' || unnest(l) AS line, generate_subscripts(l, 1)::INT AS line_no FROM l"


@register("untracked_diff", _UNTRACKED)
@register("untracked_diff_all", _UNTRACKED)
def untracked_diff(spark, sf_dir):
    """Every document stands for an untracked file."""
    return D.untracked_diff(B.files(spark, sf_dir))


@register("name_status_parse", "WITH " + B.files_sql() + " SELECT path, CASE doc_id % 4 WHEN 0 THEN 'Added' WHEN 1 THEN 'Deleted' WHEN 2 THEN 'Renamed' ELSE 'Modified' END AS status FROM files")
def name_status_parse(spark, sf_dir):
    f = B.files(spark, sf_dir)
    head = F.element_at(F.array(*[F.lit(x) for x in ("A", "D", "R100\told.cs", "M")]), (F.col("doc_id") % 4 + 1).cast("int"))
    return D.name_status(f.select(F.concat_ws("\t", head, F.replace("path", F.lit("/"), F.lit("\\"))).alias("line")))


@register("name_list_parse", "WITH " + B.files_sql() + " SELECT DISTINCT path FROM files")
def name_list_parse(spark, sf_dir):
    f = B.files(spark, sf_dir).select(F.concat(F.lit(' "'), "path", F.lit('" ')).alias("line"))
    return D.name_list(f.unionByName(f))


@register("diff_snippets", "WITH " + B.files_sql() + ", s AS (SELECT split_part(path, '/', 2) AS workspace, path, substr(content, 1, 2000) AS snippet FROM files), r AS (SELECT *, coalesce(sum(length(snippet)) OVER (PARTITION BY workspace ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM s) SELECT workspace, path, length(snippet) AS chars FROM r WHERE used < 12000")
def diff_snippets(spark, sf_dir):
    f = B.files(spark, sf_dir).select(F.split_part("path", F.lit("/"), F.lit(2)).alias("workspace"), "path", F.col("content").alias("diff"))
    return D.snippets(f).select("workspace", "path", F.length("snippet").cast("long").alias("chars"))


@register("history_top15", "SELECT user_id, event_type, max(ts) AS seen FROM events GROUP BY user_id, event_type QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY max(ts) DESC, event_type) <= 15")
def history_top15(spark, sf_dir):
    """The latest visit of each kind, the newest fifteen of a user."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id", "event_type").agg(F.max("ts").alias("seen"))
    w = Window.partitionBy("user_id").orderBy(F.desc("seen"), "event_type")
    return e.withColumn("_n", F.row_number().over(w)).where("_n <= 15").drop("_n")


@register("untracked_paths", "WITH " + B.files_sql() + " SELECT path FROM files WHERE doc_id % 2 = 0 AND doc_id % 3 <> 0")
def untracked_paths(spark, sf_dir):
    """Even documents' files, of which every third one is tracked, in another case and with backslashes."""
    f = B.files(spark, sf_dir).select("doc_id", "path")
    tracked = f.where("doc_id % 3 = 0").select(F.upper(F.replace("path", F.lit("/"), F.lit("\\"))).alias("path"))
    return D.untracked(f.where("doc_id % 2 = 0"), tracked)
