"""URL filter: host and path rules, and redirect equivalence.

Rules judge the urls they fit. Pages of redirects and canonical links name the same document, so the other
urls get their verdict from the connected component they lie in: an explicit allow of any member comes
before a block of any other. All steps are DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantarow.llm.common import keep
from vantarow.llm.graph import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path): the rules of the query.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Rules up to this many become one expression; more are joined by suffixes of the host.
MAX_INLINE = 32

_CANONICAL = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
_HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
_REFRESH = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
_TARGET = r"""(?is)\bcontent\s*=\s*["']?[^"'>]*\burl\s*=\s*([^"'\s>]+)"""


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))


def parsed(rows: DataFrame, url: Column) -> DataFrame:
    """Adds host, path and node, each computed once a row: expressions over them don't repeat the patterns they come from."""
    rest = rows.select("*", F.inline(F.array(F.struct(_rest(url).alias("__rest")))))
    names = F.struct(
        F.coalesce(F.translate(F.regexp_extract("__rest", r"^[^/?#]*", 0), UPPER, LOWER), F.lit("")).alias("host"),
        F.coalesce(F.regexp_extract("__rest", r"^[^/?#]*([^?#]*)", 1), F.lit("")).alias("path"),
        F.coalesce(F.regexp_extract("__rest", r"^[^?#]*(\?[^#]*)", 1), F.lit("")).alias("__query"),
    )
    whole = rest.select(*[c for c in rest.columns if c != "__rest"], F.inline(F.array(names)))
    node = F.when(F.col("host") != "", F.concat("host", F.when(F.col("path") == "", "/").otherwise(F.col("path")), "__query"))
    return whole.withColumn("node", node).drop("__query")


def _ranked(rules: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    """Longest first; of equal length, the longer host, then allow."""
    return sorted(set(rules), key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "allow", r))


def judged(df: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Adds rule and ruled (its verdict) to rows with host and path; both null where no rule fits."""
    ranked = _ranked(rules)
    if not ranked:
        return df.withColumns({"rule": F.lit(None).cast("string"), "ruled": F.lit(None).cast("string")})
    if len(ranked) <= MAX_INLINE:
        chosen: Column | None = None
        for place, (_, host, path) in enumerate(ranked):
            fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
            chosen = F.when(fits, place) if chosen is None else chosen.when(fits, place)
        rules_of, verdicts = (F.array(*[F.lit(x) for x in xs]) for xs in ([h + p for _, h, p in ranked], [v for v, _, _ in ranked]))
        placed = df.select("*", F.inline(F.array(F.struct(chosen.alias("__place")))))
        return placed.withColumns({"rule": F.get(rules_of, F.col("__place")), "ruled": F.get(verdicts, F.col("__place"))}).drop("__place")
    table = df.sparkSession.createDataFrame([(h, p, v, i) for i, (v, h, p) in enumerate(ranked)], "rule_host string, rule_path string, ruled string, place int")
    most = max(h.count(".") + 1 for _, h, _ in ranked)
    named = df.select("host", "path").distinct()
    ends = named.withColumn("rule_host", F.explode(F.array_distinct(F.array(*[F.substring_index("host", ".", -k) for k in range(1, most + 1)]))))
    best = (
        ends.join(table, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
        .groupBy("host", "path").agg(F.min(F.struct("place", F.concat("rule_host", "rule_path").alias("rule"), "ruled")).alias("r"))
        .select("host", "path", F.col("r.rule").alias("rule"), F.col("r.ruled").alias("ruled"))
    )
    return df.join(best, ["host", "path"], "left")


def _absolute(target: Column) -> Column:
    """Resolve a link against its page (columns scheme, host and folder)."""
    root = F.concat("scheme", F.lit("://"), "host")
    return (
        F.when(F.instr(target, "://") > 0, target)
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.startswith("/"), F.concat(root, target))
        .otherwise(F.concat(root, "folder", target))
    )


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once a row: what uses them doesn't repeat their expressions."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def _edges(rows: DataFrame, source: str, target: str) -> DataFrame:
    """Edges (u, v) between the documents that two columns of urls name."""
    u = parsed(rows.select(F.col(source).alias("__u"), F.col(target).alias("__v")), F.col("__u")).select("__v", F.col("node").alias("u"))
    both = _once(parsed(u, F.col("__v")).select("u", "node"), v=F.col("node"))
    return both.where("u != v").select("u", "v").distinct()


def alias_edges(pages: DataFrame) -> DataFrame:
    """Redirect and canonical-link edges (u, v) between documents, from the html of pages."""
    low = F.lower("html")
    some = pages.select("url", "html").where(low.contains("canonical") | low.contains("http-equiv"))
    page = parsed(some, F.col("url")).where("host != ''")
    folder = F.regexp_extract("path", r"^(.*/)", 1)
    page = _once(page, scheme=F.substring_index("url", "://", 1), folder=F.when(folder == "", "/").otherwise(folder))
    targets = F.array(
        F.regexp_extract(F.regexp_extract("html", _CANONICAL, 0), _HREF, 1),
        F.regexp_extract(F.regexp_extract("html", _REFRESH, 0), _TARGET, 1),
    )
    found = page.select("url", "scheme", "host", "folder", F.explode(targets).alias("target")).where("target != ''")
    return _edges(_once(found, to=_absolute(F.col("target"))), "url", "to")


def filter_urls(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """Verdict of every page.

    ``pages``: page_id, url and html; other columns are ignored, whatever their names. ``redirects``: further
    edges, columns source and target (urls). Null urls, and those without ``://``, have empty host and path,
    fit no rule and are allowed; null html gives no edges; repeated rows get a row each; an empty table gives
    an empty result. A rule that fits decides (the longest; of equals the longer host, then allow). Else any
    explicit allow in the component allows, else any block blocks, else the page is allowed.
    Returns page_id, host, path, rule, verdict.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    edges = alias_edges(rows)
    if redirects is not None:
        edges = edges.unionByName(_edges(redirects, "source", "target")).distinct()
    edges = keep(edges, "aliases")
    own = judged(parsed(rows.select("page_id", "url"), F.col("url")).select("page_id", "node", "host", "path"), list(rules))
    if edges.isEmpty():
        return own.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit("allow")).alias("verdict"))
    members = connected_components(edges)
    named = F.concat(F.lit("x://"), F.col("node"))
    members = judged(parsed(members.select("node", "component"), named).select("component", F.col("node"), "host", "path"), list(rules))
    decided = members.groupBy("component").agg(F.max(F.col("ruled") == "allow").alias("allowed"), F.max(F.col("ruled") == "block").alias("blocked"))
    passed = members.join(decided.where("blocked and not coalesce(allowed, false)").select("component"), "component", "left_semi").select("node", F.lit("block").alias("passed"))
    return own.join(passed, "node", "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", "passed", F.lit("allow")).alias("verdict"))


def op9(spark, sf_dir: str) -> DataFrame:
    """Verdict of every row of ``pages``; see :func:`filter_urls`."""
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _sql() -> str:
    rest = "CASE WHEN instr({0}, '://') > 0 THEN substr({0}, instr({0}, '://') + 3) ELSE '' END"
    host = f"translate(regexp_extract({rest}, '^[^/?#]*'), '{UPPER}', '{LOWER}')"
    path = f"regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1)"
    query = f"regexp_extract({rest}, '^[^?#]*(\\?[^#]*)', 1)"
    node = f"CASE WHEN {host} != '' THEN {host} || CASE WHEN {path} = '' THEN '/' ELSE {path} END || {query} END"

    def q(pattern: str) -> str:
        return pattern.replace("'", "''")

    def case(value) -> str:
        whens = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{value(v, h, p)}'" for v, h, p in _ranked(list(RULES)))
        return f"CASE {whens} END"

    rule, ruled = case(lambda v, h, p: h + p), case(lambda v, h, p: v)
    root = f"split_part(url, '://', 1) || '://' || {host.format('url')}"
    folder = f"regexp_extract({path.format('url')}, '^(.*/)', 1)"
    absolute = (
        f"CASE WHEN instr(target, '://') > 0 THEN target WHEN starts_with(target, '//') THEN 'http:' || target "
        f"WHEN starts_with(target, '/') THEN {root} || target ELSE {root} || CASE WHEN {folder} = '' THEN '/' ELSE {folder} END || target END"
    )
    return f"""
WITH RECURSIVE links AS (
  SELECT url, unnest([regexp_extract(regexp_extract(html, '{q(_CANONICAL)}'), '{q(_HREF)}', 1),
                      regexp_extract(regexp_extract(html, '{q(_REFRESH)}'), '{q(_TARGET)}', 1)]) AS target FROM pages),
absolutes AS (SELECT url, {absolute} AS target FROM links WHERE target != ''),
edges AS (SELECT DISTINCT u, v FROM (SELECT {node.format('url')} AS u, {node.format('target')} AS v FROM absolutes) WHERE u != v),
both_ways AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges),
reach(node, other) AS (SELECT u, u FROM both_ways UNION SELECT r.node, b.v FROM reach r JOIN both_ways b ON r.other = b.u),
others AS (SELECT node, {host.format("('x://' || other)")} AS host, {path.format("('x://' || other)")} AS path FROM reach),
passed AS (SELECT node FROM (SELECT node, {ruled} AS ruled FROM others) GROUP BY node
           HAVING bool_or(ruled = 'block') AND NOT coalesce(bool_or(ruled = 'allow'), false)),
own AS (SELECT page_id, {node.format('url')} AS node, coalesce({host.format('url')}, '') AS host, coalesce({path.format('url')}, '') AS path FROM pages)
SELECT page_id, host, path, {rule} AS rule,
       coalesce({ruled}, CASE WHEN node IN (SELECT node FROM passed) THEN 'block' END, 'allow') AS verdict FROM own"""


ORACLE = _sql()
