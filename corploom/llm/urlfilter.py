"""URL filters with redirect equivalence, in DataFrame operations only.

Rules are (host, path prefix, verdict).  A rule fits its host and all
subdomains; the longest fitting rule decides.  Pages that no rule fits get the
verdict of their aliases: connected components over redirect and canonical-link
edges carry a block to every alias, and an explicit allow takes precedence over
a carried block, for the page itself and, where an alias is explicitly allowed,
for its whole component.

Defined results: a null url, or one without ``://``, has empty host and path,
fits no rule and is nobody's alias; null html has no links; very long html is
read whole; of two fitting rules of one length the one whose host and path
sort last decides; repeated rows each get a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table
from .components import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path), fixed by the contract.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """From after the first :// to / ? # or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(_rest(F.coalesce(url, F.lit(""))), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(F.coalesce(url, F.lit(""))), r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """``struct(rule, verdict)`` of the longest fitting rule, or null.

    The rules are a stated list, so they become one CASE, longest host and path
    first; there is no join.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1:])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _name(url: Column) -> Column:
    """A url as a node: no fragment, scheme and host lower-cased, at least a slash as path; null where it has no host."""
    whole = r"(?s)^(.*?)://([^/?#]+)(/?)([^#]*).*$"
    head = F.translate(F.regexp_extract(url, r"^(.*?://[^/?#]+)", 1), UPPER, LOWER)
    return F.when(head != "", F.concat(head, F.lit("/"), F.regexp_replace(url, whole, "$4")))


def _folder(base: Column) -> Column:
    """A page's url up to its last slash; none if it has no path."""
    return F.regexp_extract(base, r"^([^?#]*://[^/?#]+(?:/[^?#]*)?/)", 1)


def _absolute() -> Column:
    """Column ``link`` as a full url; the page's ``u``, ``scheme``, ``host`` and ``folder`` fill in."""
    link, host = F.col("link"), F.concat("scheme", F.lit("://"), "host")
    folder = F.when(F.col("folder") != "", F.col("folder")).otherwise(F.concat(host, F.lit("/")))
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat("scheme", F.lit(":"), link))
        .when(link.startswith("/"), F.concat(host, link))
        .when(link.startswith("?"), F.concat(F.regexp_extract("u", r"^([^?#]*)", 1), link))
        .when((link != "") & ~link.rlike(r"^#|^[A-Za-z][A-Za-z0-9+.-]*:"), F.concat(folder, link))
    )


def _without_dots(url: Column) -> Column:
    """A url whose path has no ``.`` and ``..`` segments left; beyond the root ``..`` has no effect."""
    whole = r"(?s)^(.*?://[^/?#]*)(/[^?#]*)?(.*)$"
    path = F.regexp_extract(url, whole, 2)
    kept = F.aggregate(
        F.split(F.substring(path, F.lit(2), F.length(path)), "/"), F.array().cast("array<string>"),
        lambda held, s: F.when(s == "..", F.slice(held, F.lit(1), F.greatest(F.lit(0), F.size(held) - 1))).when(s == ".", held).otherwise(F.concat(held, F.array(s))),
    )
    end = F.when(path.rlike(r"/\.\.?$") & (F.size(kept) > 0), F.lit("/")).otherwise("")
    made = F.concat(F.regexp_extract(url, whole, 1), F.lit("/"), F.array_join(kept, "/"), end, F.regexp_extract(url, whole, 3))
    return F.when(path.rlike(r"/\.\.?(/|$)"), made).otherwise(url)


_CANON = r"(?i)<link\b(?=[^>]*\brel\s*=\s*(?:canonical(?=[\s>/])|\"(?:[^\">]*\s)?canonical[\s\"]|'(?:[^'>]*\s)?canonical[\s']))[^>]*>"
_META = r"(?i)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*>"


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(a, b)``: a page's node and the node of each canonical link or refresh target."""
    html = F.col(html_col).cast("string")
    may = html.rlike(r"(?i)canonical|http-equiv")  # one pass; most pages have neither
    own = pages.select(F.col(url_col).cast("string").alias("u"), F.when(may, html).alias("h")).where("u is not null and h is not null")
    href = F.regexp_extract(F.col("tag"), r"(?i)\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", 0)
    href = F.regexp_replace(F.regexp_replace(href, r"(?i)^href\s*=\s*", ""), r"^[\"']|[\"']$", "")
    goal = F.regexp_extract(F.col("tag"), r"(?i)\burl\s*=\s*['\"]?([^'\"\s>]+)", 1)
    # step by step, so that no expression is generated many times over
    tags = own.select(F.col("u"), F.explode(F.concat(
        F.transform(F.regexp_extract_all("h", F.lit(_CANON), F.lit(0)), lambda t: F.struct(t.alias("tag"), F.lit(True).alias("canon"))),
        F.transform(F.regexp_extract_all("h", F.lit(_META), F.lit(0)), lambda t: F.struct(t.alias("tag"), F.lit(False).alias("canon"))),
    )).alias("t")).select("u", "t.tag", "t.canon")
    link = F.regexp_replace(F.trim(F.when(F.col("canon"), href).otherwise(goal)), "&amp;", "&")
    found = tags.select("u", link.alias("link"))
    full = found.select("u", "link", host_of(F.col("u")).alias("host"), F.substring_index("u", "://", 1).alias("scheme"), _folder(F.col("u")).alias("folder"))
    full = full.select("u", _absolute().alias("to")).select("u", _without_dots(F.col("to")).alias("to"))
    full = Scratch(pages.sparkSession, "urlfilter").save(full)  # links only: small
    return full.select(_name(F.col("u")).alias("a"), _name(F.col("to")).alias("b"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, host, path, rule, verdict, carried)`` for every page.

    ``redirects(src, dst)`` may add known redirects between urls.  ``carried``
    is true where the verdict came from the component.
    """
    scratch = Scratch(pages.sparkSession, "urlfilter")
    edges = alias_edges(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(_name(F.col("src")).alias("a"), _name(F.col("dst")).alias("b")))
    edges = scratch.save(edges.where("a is not null and b is not null and a <> b").distinct())
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("u"))
    rows = rows.select("page_id", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"), _name(F.col("u")).alias("node"))
    rows = rows.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    if edges.isEmpty():
        told = rows.withColumn("carried_verdict", F.lit(None).cast("string"))
    else:
        comp = scratch.save(connected_components(edges, scratch))
        # verdicts of a component's urls, pages or mere link targets, from the rules alone
        nodes = comp.withColumn("r", rule_of(host_of(F.col("node")), path_of(F.col("node")), rules))
        said = nodes.groupBy("component").agg(
            F.max(F.col("r.verdict") == "allow").alias("allowed"), F.max(F.col("r.verdict") == "block").alias("blocked")
        ).select("component", F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").alias("carried_verdict"))
        # few nodes have links: their verdicts, joined to all pages, sorted and split where a url is hot
        named = scratch.save(comp.join(said, "component").where("carried_verdict is not null").select(F.col("node").alias("n"), "carried_verdict"))
        told = rows.join(named, rows["node"] == named["n"], "left")
    verdict = F.coalesce(F.col("r.verdict"), F.col("carried_verdict"), F.lit("allow"))
    return told.select(
        "page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"),
        (F.col("r").isNull() & F.col("carried_verdict").isNotNull()).alias("carried"),
    )


def op4_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


#: The rules alone; the driver's pages hold no canonical or refresh links (tests cover those by brute force).
OP4_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), s AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), m AS (
  SELECT page_id, max_by(struct_pack(rule := h || p, verdict := verdict), length(h || p)) AS r
  FROM s JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
)
SELECT s.page_id, host, path, m.r.rule AS rule, coalesce(m.r.verdict, 'allow') AS verdict, false AS carried
FROM s LEFT JOIN m USING (page_id)
"""
