"""URL verdicts by host and path rules, spread over redirect and canonical-link equivalence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_hot, let, save, table
from .components import connected_components

#: Fixed by the contract: verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: So many rules are tried in one expression; more are joined on the host's suffixes.
INLINE_RULES = 256
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_LINK = r"(?is)<link\b[^>]*?\brel\s*=\s*[\"']?canonical\b[^>]*>"
_META = r"(?is)<meta\b[^>]*?\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
_BASE = r"(?is)<base\b[^>]*?\bhref\s*=[^>]*>"
#: An attribute's value in double quotes, in single quotes or bare; of a refresh, what follows url= in its content.
_HREF = r"(?is)\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\"'\s>]+))"
_URL = r"(?is)\burl\s*=\s*(?:\"([^\">]*)|'([^'>]*)|([^\"'\s>]+))"
#: Character references that occur in written URLs. Those of the ampersand come last, all at once, so that nothing is decoded twice.
ENTITIES = (("&quot;", '"'), ("&#34;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&#x27;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&#x2F;", "/"), ("&#47;", "/"))
_AMPERSAND = "&(?:amp|#38|#x26);"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _inline(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    fits = [F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("len"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in rules]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<len:int,rule:string,verdict:string>")


def _by_join(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The same for any number of rules: hosts meet rules on equal suffixes of no more labels than a rule has."""
    most = rules.agg(F.max(F.size(F.split("r_host", r"\."))).alias("n")).first()["n"] or 0
    labels = F.reverse(F.slice(F.reverse(F.split("host", r"\.")), 1, most)) if most else F.array(F.lit(""))
    suffixes = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.array_join(F.slice("labels", i, F.size("labels")), "."))
    hosts = urls.select("host", "path").distinct().withColumn("labels", labels).withColumn("suffix", F.explode(suffixes))
    hits = hosts.join(rules, (F.col("suffix") == F.col("r_host")) & F.col("path").startswith(F.col("r_path")))
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.length(F.concat("r_host", "r_path")).alias("len"), F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"))).alias("hit"))
    return urls.join(best, ["host", "path"], "left")


def without_dots(path: Column) -> Column:
    """A path that begins with a slash, with "." and ".." followed (RFC 3986, 5.2.4)."""
    step = lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, x))

    def joined(p: Column) -> Column:
        kept = F.aggregate(F.slice(F.split(p, "/"), F.lit(2), F.length(p)), F.array().cast("array<string>"), step)
        return F.concat(F.lit("/"), F.array_join(F.concat(kept, F.when(p.rlike(r"/\.\.?$"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))), "/"))

    return let(path, joined)


def _value(tag: Column, pattern: str) -> Column:
    """The value that ``pattern`` finds in a tag, by the group that fits, with character references decoded; empty if there is none."""
    text = F.trim(F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)]))
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.regexp_replace(text, _AMPERSAND, "&")


def _parts(url: Column) -> Column:
    """struct(known, scheme, host, path, query) of a URL; known: it has ://."""
    host, path = host_and_path(url)
    scheme = F.translate(F.regexp_extract(url, r"^\s*([^/?#]*?)://", 1), UPPER, LOWER)
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)
    return F.named_struct(F.lit("known"), F.instr(url, "://") > 0, F.lit("scheme"), scheme, F.lit("host"), host, F.lit("path"), path, F.lit("query"), query)


def node_of(url: Column) -> Column:
    """The name under which a URL is known: scheme (https counts as http) and host in lower case, path (a slash if it is empty) and query as written, no fragment; null without ://."""
    named = lambda u: F.when(u["known"], F.concat(F.regexp_replace(u["scheme"], "^https$", "http"), F.lit("://"), u["host"], F.when(u["path"] == "", F.lit("/")).otherwise(u["path"]), u["query"]))
    return let(_parts(url), named)


def resolved(to: Column, base: Column) -> Column:
    """The full URL of a reference found on a page, against its base URL (RFC 3986, 5.2); null if it names no host (mailto: and the like) or the base has none."""
    ref = F.named_struct(F.lit("to"), to, F.lit("own"), F.regexp_extract(to, "^([^?#]*)", 1), F.lit("query"), F.regexp_extract(to, r"^[^?#]*(\?[^#]*)", 1))

    def against(x: Column) -> Column:
        u, r = x["base"], x["ref"]
        at = F.concat(u["scheme"], F.lit("://"), u["host"])
        folder = F.coalesce(F.nullif(F.regexp_extract(u["path"], "^(.*/)", 1), F.lit("")), F.lit("/"))
        same = F.concat(at, u["path"], F.when(r["query"] == "", u["query"]).otherwise(r["query"]))
        long = F.when(r["own"].startswith("/"), r["own"]).otherwise(F.concat(folder, r["own"]))
        below = F.when(r["own"] == "", same).otherwise(F.concat(at, without_dots(long), r["query"]))
        other = r["to"].rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:")
        return F.when(r["to"].rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), r["to"]).when(u["known"] & r["to"].startswith("//"), F.concat(u["scheme"], F.lit(":"), r["to"])).when(u["known"] & ~other, below)

    return let(F.named_struct(F.lit("base"), _parts(base), F.lit("ref"), ref), against)


def link_edges(pages: DataFrame) -> DataFrame:
    """(a, b): from each page (url, html) to the targets of all its canonical links and refresh redirects, as names of node_of().

    Character references in values are decoded. Relative targets are resolved against the page's first base element
    with href, if there is one, itself resolved against the page, else against the page. Full URLs are taken as written.
    """
    tags = lambda mark, pattern: F.when(F.lower("html").contains(mark), F.regexp_extract_all("html", F.lit(pattern), F.lit(0)))
    none = F.array().cast("array<string>")
    targets = lambda mark, pattern, value: F.coalesce(F.transform(tags(mark, pattern), lambda t: _value(t, value)), none)
    goes = F.concat(targets("canonical", _LINK, _HREF), targets("refresh", _META, _URL))
    found = pages.select("url", "html", goes.alias("goes")).where((F.size("goes") > 0) & (F.instr("url", "://") > 0))
    own_base = let(_value(F.regexp_extract("html", _BASE, 0), _HREF), lambda v: F.when(v != "", resolved(v, F.col("url"))))
    out = found.select("url", F.coalesce(own_base, F.col("url")).alias("base"), F.explode("goes").alias("to")).where("to <> ''")
    return out.select(node_of(F.col("url")).alias("a"), let(resolved(F.col("to"), F.col("base")), node_of).alias("b")).where("b is not null")


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame = RULES, redirects: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """One row for each row of ``pages`` (page_id, url, html): page_id, host, path, rule, verdict, component.

    Host: between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z lower-cased; path: from there up to ``?``
    or ``#``. A rule (verdict, host, path) fits its host and all subdomains if the path starts with the rule's; the
    longest decides. ``redirects`` (from_url, to_url) and the pages' own canonical links and refresh redirects join
    URLs into components. A URL is known by scheme (https as http), host, path and query, without fragment; an empty
    path is a slash.
    A page that no rule fits takes the decision of its aliases: allow if a rule allows one of them, else block if a
    rule blocks one, else ``default``. A page's own rule always stands.

    Null urls, and those without ``://``, have empty host and path, are in no component and get ``default``. Null
    html has no links. Repeated rows stay, and a URL that very many pages have is joined without exchange of these;
    further columns are ignored. No rows give no rows.
    """
    url = F.col("url").cast("string")
    host, path = host_and_path(url)
    edges = link_edges(pages.select(url.alias("url"), F.col("html").cast("string").alias("html")))
    if redirects is not None:
        edges = edges.union(redirects.select(*[node_of(F.col(c).cast("string")) for c in ("from_url", "to_url")]))
    linked = connected_components(edges)

    def decided(df: DataFrame) -> DataFrame:
        if isinstance(rules, DataFrame):
            return _by_join(df, rules.select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")))
        if len(rules) <= INLINE_RULES:
            return df.withColumn("hit", _inline(F.col("host"), F.col("path"), rules))
        return _by_join(df, df.sparkSession.createDataFrame(list(rules), "r_verdict string, r_host string, r_path string"))

    own = decided(pages.select("page_id", host.alias("host"), path.alias("path"), node_of(url).alias("node")))
    result = lambda df, verdict: df.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce(F.col("hit.verdict"), verdict).alias("verdict"), "component")
    if not linked.limit(1).count():
        return result(own.withColumn("component", F.lit(None).cast("string")), F.lit(default))
    node_host, node_path = host_and_path(F.col("id"))
    nodes = decided(linked.select("id", "component", node_host.alias("host"), node_path.alias("path")))
    sides = nodes.groupBy("component").agg(F.max(F.col("hit.verdict") == "allow").alias("any_allow"), F.max(F.col("hit.verdict") == "block").alias("any_block"), F.count("*").alias("nodes"))
    aliases = join_hot(linked.withColumnRenamed("id", "node"), save(sides, "url-sides"), "component", "nodes", linked.count())
    times = own.where("node is not null").groupBy("node").agg(F.count("*").alias("times"))
    sized = save(aliases.join(times, "node"), "url-aliases")
    spread = F.when(F.col("any_allow"), F.lit("allow")).when(F.col("any_block"), F.lit("block")).otherwise(F.lit(default))
    return result(join_hot(own, sized, "node", "times", pages.count(), "left"), spread)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


#: The pages of the test tables hold no canonical links or redirects, so that the rules and the default are all of it; components are tested apart.
SQL = """
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (SELECT page_id, host, path, r.h || r.p AS rule, r.verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(r.h || r.p) DESC NULLS LAST) AS k
      FROM p LEFT JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.p))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""
