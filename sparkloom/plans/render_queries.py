"""Queries over renderings and end-to-end plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import filters, tables
from sparkloom.functions import text as T
from sparkloom.operators import extract as X
from sparkloom.operators import graph as G
from sparkloom.operators import select as SEL
from sparkloom.sources import bindings as B

from . import graph_queries as GQ
from . import render
from . import select_queries as SQ
from . import sql as SQL
from .registry import register


@register("dependency_tree")
def dependency_tree(spark, sf_dir):
    nodes = B.files(spark, sf_dir).select(F.col("doc_id").alias("id"), "path", (F.col("doc_id") % 9 == 0).alias("modified")).withColumnRenamed("path", "label")
    return render.dependency_tree(nodes, B.edges(spark, sf_dir), nodes.where("id IN (0, 1)"))


@register("context_markdown")
def context_markdown(spark, sf_dir):
    """The context document of every source under a budget."""
    chosen = SEL.greedy(SQ._candidates(spark, sf_dir), SQ.BUDGET)
    text = B.files(spark, sf_dir).select("doc_id", "content")
    return render.context_markdown(chosen.join(text, "doc_id"))


def _chars(s: str) -> str:
    return SQL.text(s).replace("\n", "' || chr(10) || '")


_FENCE = "repeat('`', greatest(3, 1 + coalesce(list_max(list_transform(regexp_extract_all(body, '`+'), lambda r: length(r))), 0))::INT)"
_DOCUMENT = SQ._GREEDY + f""", d AS (SELECT sel.workspace, sel.path, included, is_root, depth, importance, tokens, doc_id % 6 = 0 AS modified, {SQL.redacted("content")} AS body, files.ext AS ext FROM sel JOIN files USING (doc_id)),
 per AS (SELECT workspace, min(path) FILTER (is_root) AS root, count(*) FILTER (NOT included) AS n_out, count(*) FILTER (included) AS n_in, coalesce(sum(tokens) FILTER (is_root), 0) > {SEL.available(SQ.BUDGET)} AS alone FROM d GROUP BY workspace)
 SELECT workspace, 0 AS part, '' AS ord, {_chars(render.opening())} || {_chars("## Target Scope" + chr(10) * 2)} || coalesce('- Root: `' || root || '`' || chr(10), '') || '- Workspace: `' || workspace || '`' || chr(10) || {_chars("- Response Language: " + tables.LANGUAGE_NAMES["en"] + chr(10))}
   || CASE WHEN n_out > 0 THEN '- Excluded dependencies: ' || n_out || ' files (see Excluded Files section below)' || chr(10) ELSE '' END || chr(10) AS text FROM per
 UNION ALL SELECT workspace, 1, '', {_chars("## Analysis Warnings" + chr(10) * 2 + "- " + render.ROOT_WARNING % SQ.BUDGET + chr(10) * 2)} FROM per WHERE alone
 UNION ALL SELECT workspace, 4, '', {_chars("## Included Files" + chr(10) * 2)} FROM per
 UNION ALL SELECT workspace, 4, '1' || path, '- `' || path || '`' || CASE WHEN modified THEN ' *(Modified)*' ELSE '' END || chr(10) FROM d WHERE included
 UNION ALL SELECT workspace, 5, '', {_chars(chr(10) + "## Excluded Files" + chr(10) * 2 + render.EXCLUDED_HEAD)} FROM per WHERE n_out > 0
 UNION ALL SELECT workspace, 5, '1' || path, '| `' || path || '` | TokenBudget | ' || depth || ' | ' || importance || ' | Yes |' || chr(10) FROM d WHERE NOT included
 UNION ALL SELECT workspace, 6, '', {_chars(chr(10) + "## Source Files" + chr(10) * 2)} FROM per WHERE n_in > 0
 UNION ALL SELECT workspace, 6, '1' || path, '### File: `' || path || CASE WHEN modified THEN '` (Modified)' ELSE '`' END || chr(10) || chr(10) || {_FENCE} || CASE WHEN is_root THEN 'text' ELSE {SQL.mapped("ext", tables.FENCE_BY_EXT, "text")} END || chr(10) || body || chr(10) || {_FENCE} || chr(10) || chr(10) FROM d WHERE included"""


@register("context_document", _DOCUMENT)
def context_document(spark, sf_dir):
    """The whole context document of every source under a budget, as ordered parts."""
    chosen = SEL.greedy(SQ._candidates(spark, sf_dir), SQ.BUDGET).withColumn("modified", F.col("doc_id") % 6 == 0)
    text = B.files(spark, sf_dir).select("doc_id", "content")
    return render.context_document(chosen.join(text, "doc_id"), SQ.BUDGET)


@register("knowledge_markdown")
def knowledge_markdown(spark, sf_dir):
    m = G.materialise(GQ._metrics(spark, sf_dir))
    gods = G.god_nodes(m, m.count())
    files = B.files(spark, sf_dir)
    clusters = files.groupBy(T.cluster_name(F.col("path")).alias("cluster")).agg(F.count("*").alias("files"), F.sum(T.line_count(F.col("content"))).alias("lines"))
    return render.knowledge_markdown(gods, clusters, GQ.cycles(spark, sf_dir))


@register("knowledge_document")
def knowledge_document(spark, sf_dir):
    """The whole knowledge document of the bound files, with code under a budget."""
    files, edges = B.files(spark, sf_dir), B.edges(spark, sf_dir)
    m = G.materialise(GQ._metrics(spark, sf_dir))
    gods = G.god_nodes(m, m.count()).select("id", "place")
    sccs = G.materialise(G.strong_components(m.select("id"), edges))
    looped = sccs.join(G.cycles(sccs), "scc").select("id", F.lit(True).alias("in_cycle"))
    text = F.col("content")
    types = X.declared_types(text)
    own = files.select(F.col("doc_id").alias("id"), T.language(F.col("ext")).alias("language"), T.line_count(text).alias("lines"), T.token_estimate(text).alias("tokens"), X.symbols(types, X.declared_functions(text, types)).alias("symbols"), (F.col("doc_id") % 9 == 0).alias("modified"), T.cluster_name(F.col("path")).alias("cluster"))
    n = m.join(own, "id").join(F.broadcast(gods), "id", "left").join(looped, "id", "left")  # ten hubs at most
    role = T.node_role(F.col("name"), F.col("path"), F.col("language"), F.col("place").isNotNull(), F.col("in_degree"), F.col("out_degree"))
    nodes = G.materialise(n.withColumn("role", role).drop("name", "ext"))
    few = SEL.running_cut(nodes.select(F.lit("").alias("workspace"), "path", "tokens", "page_rank"), 6000, [F.desc("page_rank"), F.upper("path")])
    code = few.select("path", "total").join(files.select("path", "content"), "path")
    return render.knowledge_document(nodes, edges, G.cycle_list(sccs, edges), mermaid_chart(spark, sf_dir), workspace="documents", scope="All files", sources=code)


_CHART = GQ._MERMAID + """, few AS (SELECT *, split_part(path, '/', 2) || '/' || split_part(path, '/', 3) AS cluster FROM top), c AS (SELECT upper(cluster) AS ck, min(place) AS first, min_by(cluster, place) AS name FROM few GROUP BY 1),
 n AS (SELECT *, row_number() OVER (ORDER BY first) AS nth FROM c), drawn AS (SELECT a.place AS pa, b.place AS pb FROM e JOIN few a ON e.src = a.id JOIN few b ON e.dst = b.id ORDER BY pa, pb LIMIT 45),
 pad AS (SELECT 1)
 SELECT '0' AS ord, 'flowchart LR' AS line UNION ALL SELECT '1' || lpad(nth::VARCHAR, 4, '0') || '0000', '    subgraph C' || nth || '["' || translate(name, '"[]', '''()') || '"]' FROM n
 UNION ALL SELECT '1' || lpad(nth::VARCHAR, 4, '0') || '9999', '    end' FROM n
 UNION ALL SELECT '1' || lpad(nth::VARCHAR, 4, '0') || lpad(place::VARCHAR, 4, '0'), '        N' || place || '["' || translate(split_part(path, '/', -1) || CASE WHEN place <= 10 THEN ' ★' ELSE '' END, '"[]', '''()') || '"]' FROM few JOIN n ON upper(cluster) = ck
 UNION ALL SELECT '2' || lpad(pa::VARCHAR, 4, '0') || lpad(pb::VARCHAR, 4, '0'), '    N' || pa || ' --> N' || pb FROM drawn"""


@register("mermaid_chart", _CHART)
def mermaid_chart(spark, sf_dir):
    top = GQ._mermaid_top(spark, sf_dir).select("id", "path", "place", (F.col("place") <= 10).alias("god"), F.lit(False).alias("modified"), T.cluster_name(F.col("path")).alias("cluster"))
    return render.mermaid(G.materialise(top), G.distinct_edges(B.edges(spark, sf_dir)))


@register("file_json", "WITH " + B.files_sql() + " SELECT doc_id, CAST(to_json({'docId': doc_id, 'path': path, 'ext': ext}) AS VARCHAR) AS json FROM files")
def file_json(spark, sf_dir):
    f = B.files(spark, sf_dir).select("doc_id", "path", "ext")
    return f.select("doc_id", render.as_json(f, "doc_id", "path", "ext").alias("json"))


@register("candidate_reasons", None)
def candidate_reasons(spark, sf_dir):
    """Every file with its filter reason, depth from document 0 and secrets found."""
    files = B.files(spark, sf_dir)
    nodes = files.select(F.col("doc_id").alias("id"))
    depth = G.bfs(B.edges(spark, sf_dir), nodes.where("id = 0"), nodes).select(F.col("id").alias("doc_id"), "depth")
    reason = filters.exclusion_reason(F.col("path"), F.col("content"), F.col("doc_id") == 0, F.coalesce("depth", F.lit(99)), filters.FilterConfig(max_depth=12))
    secret = F.size(F.filter(F.split("content", "\n"), lambda line: T.secret_category(line).isNotNull()))
    return files.join(depth, "doc_id", "left").select("doc_id", "path", "depth", reason.alias("reason"), secret.alias("secrets"))
