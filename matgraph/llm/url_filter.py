"""URL filters whose block decisions reach every alias of an address.

Rules name a host and the start of a path. A rule fits its host and all subdomains where
the path starts with the rule's; of the rules that fit, the longest decides (by code points
of host and path together, then of the host; of one rule with both verdicts, allow).
A few rules are one expression over the scan; many are joined by (host suffix, path prefix).

An address that no rule fits takes the decision of its redirect class: addresses are nodes,
redirects and canonical links are edges, and the distributed connected components of the
two are the classes. A class is blocked if a rule blocks one of its addresses, in the table
or only linked to, and none is explicitly allowed. What a rule says about an address itself
always stands.

A node is an address without its fragment, with A-Z lower-cased in scheme and host. Links are
read from ``<link rel=canonical href>`` and ``<meta http-equiv=refresh content>`` (comments
and scripts are skipped), and resolved against the page's address: absolute, ``//host``,
``/path``, ``?query`` and relative references; dot segments stay as written. A crawl's own
redirects may be given beside them.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no
rule and is no node; every row gives one row, repeats and null ids included; a null or empty
html has no links; an address or html of any length is read whole; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._base import staged
from ._graph import components

#: Up to so many rules are one expression; more are joined.
FEW = 64

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_S = r"[\x09-\x0D\x20]"
#: Kept as plain patterns that Java's and RE2's engines read alike.
HINT = r"(?i)canonical|refresh"
HIDDEN = r"(?is)<!--.*?-->|<script.*?</script>"
TAG = rf"(?i)<(?:link|meta){_S}[^>]*>"
CANONICAL = rf"""(?i)^<link(?:{_S}|{_S}[^>]*{_S})rel{_S}*=(?:{_S}*canonical[\x09-\x0D\x20/>]|{_S}*"(?:[^"]*{_S})?canonical(?:{_S}[^"]*)?"|{_S}*'(?:[^']*{_S})?canonical(?:{_S}[^']*)?')"""
REFRESH = rf"""(?i)^<meta(?:{_S}|{_S}[^>]*{_S})http-equiv{_S}*={_S}*["']?refresh["'\x09-\x0D\x20/>]"""
HREF = rf"""(?i){_S}href{_S}*={_S}*(?:"([^"]*)"|'([^']*)'|([^\x09-\x0D\x20"'>]+))"""
CONTENT = rf"""(?i){_S}content{_S}*={_S}*(?:"([^"]*)"|'([^']*)'|([^\x09-\x0D\x20"'>]+))"""
TARGET = rf"""(?i)^{_S}*[0-9.]+{_S}*[;,]{_S}*url{_S}*={_S}*["']?([^"']*)"""


def _lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def _after(url: Column) -> Column:
    """What follows the first ``://``; null if there is none."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(_lower(F.regexp_extract(_after(url), "^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """The address as a node; null if it is none."""
    rest = F.regexp_extract(_after(url), "^[^/?#]*([^#]*)", 1)
    return F.concat(_lower(F.substring(url, F.lit(1), F.locate("://", url) - 1)), F.lit("://"), host_of(url), rest)


def rules_of(spark, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) rows, with ``verdict`` allow or block."""
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def ruled(urls: DataFrame, rules: DataFrame, few: int = FEW) -> DataFrame:
    """``urls`` (with host and path) and the rule that decides each, or nulls: columns rule, ruled."""
    rules = rules.select(_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").filter("host <> ''")
    # allow sorts before block
    rules = rules.groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    own = rules.limit(few + 1).collect()
    if len(own) <= few:
        own.sort(key=lambda r: (-len(r["host"] + r["path"]), -len(r["host"]), r["host"], r["path"]))
        host, path = F.col("host"), F.col("path")
        fits = [((host == r["host"]) | host.endswith("." + r["host"])) & path.startswith(r["path"]) for r in own]
        first = lambda f: F.coalesce(*[F.when(c, F.lit(f(r))) for c, r in zip(fits, own)], F.lit(None).cast("string"))
        return urls.withColumns({"rule": first(lambda r: r["host"] + r["path"]), "ruled": first(lambda r: r["verdict"])})
    # An address is looked up under each suffix of its host, and each length that a path of a rule of that suffix has.
    lengths = rules.groupBy("host").agg(F.collect_set(F.length("path")).alias("lengths")).withColumnRenamed("host", "suffix")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    tried = urls.select("host", "path").filter("host <> ''").distinct().withColumn("suffix", F.explode(suffixes)).join(lengths, "suffix")
    tried = tried.withColumn("n", F.explode("lengths")).filter(F.col("n") <= F.length("path"))
    tried = tried.select("host", "path", "suffix", F.substring(F.col("path"), F.lit(1), F.col("n")).alias("start"))
    named = rules.select(F.col("host").alias("suffix"), F.col("path").alias("start"), "verdict")
    order = F.struct(F.length("suffix") + F.length("start"), F.length("suffix"))
    best = tried.join(named, ["suffix", "start"]).groupBy("host", "path").agg(
        F.max_by(F.struct(F.concat("suffix", "start").alias("rule"), F.col("verdict").alias("ruled")), order).alias("best")
    )
    return urls.join(best, ["host", "path"], "left").select(*[urls[c] for c in urls.columns], "best.rule", "best.ruled")


def _value(tag: Column, pattern: str) -> Column:
    return F.concat(*[F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)])


def _resolved() -> Column:
    """``ref`` as found on ``page`` of ``site``; null if it leads nowhere else."""
    ref, page, site = F.col("ref"), F.col("page"), F.col("site")
    folder = F.when(page == site, F.concat(site, F.lit("/"))).otherwise(F.regexp_extract(page, "^.*/", 0))
    return (
        F.when(ref.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), ref)
        .when(ref.rlike("^(?:#|$)") | ref.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(ref.startswith("//"), F.concat(F.regexp_extract(site, "^[^:]*", 0), F.lit(":"), ref))
        .when(ref.startswith("/"), F.concat(site, ref))
        .when(ref.startswith("?"), F.concat(page, ref))
        .otherwise(F.concat(folder, ref))
    )


def links_of(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b): nodes that a canonical link or a refresh of a page joins."""
    found = pages.filter(F.col(html_col).cast("string").rlike(HINT)).select(node_of(F.col(url_col).cast("string")).alias("a"), F.col(html_col).cast("string").alias("html"))
    tags = F.regexp_extract_all(F.regexp_replace("html", HIDDEN, ""), F.lit(TAG), 0)
    tag = F.col("tag")
    found = staged(found.filter("a is not null").select("a", F.explode(tags).alias("tag")), "tags")
    canonical = found.filter(tag.rlike(CANONICAL)).select("a", _value(tag, HREF).alias("ref"))
    refresh = found.filter(~tag.rlike(CANONICAL) & tag.rlike(REFRESH)).select("a", _value(tag, CONTENT).alias("content"))
    found = canonical.unionByName(refresh.select("a", F.regexp_extract("content", TARGET, 1).alias("ref")))
    ref = F.regexp_replace("ref", "^[\\x09-\\x0D\\x20]+|[\\x09-\\x0D\\x20]+$", "")
    ref = F.replace(F.replace(ref, F.lit("&#38;"), F.lit("&")), F.lit("&amp;"), F.lit("&"))
    found = staged(found.select("a", ref.alias("ref")), "references").filter("ref <> ''")
    found = found.withColumns({"site": F.regexp_extract("a", "^[^:]*://[^/?]*", 0), "page": F.regexp_extract("a", r"^[^?]*", 0)})
    found = found.select("a", _resolved().alias("url")).select("a", node_of(F.col("url")).alias("b"))
    return found.filter("b is not null and a <> b").distinct()


def blocked(links: DataFrame, rules: DataFrame) -> DataFrame:
    """The nodes (column node) of the classes that are blocked. Nodes are compared by 128 bits
    of their SHA-256 while classes are sought."""
    name = lambda c: F.unhex(F.substring(F.sha2(F.col(c), 256), 1, 32))
    links = staged(links, "links")
    roots = components(links.select(name("a").alias("a"), name("b").alias("b")))
    nodes = links.select(F.explode(F.array("a", "b")).alias("url")).distinct()
    nodes = ruled(nodes.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), rules)
    nodes = nodes.withColumn("node", name("url")).join(roots, "node", "left").select("url", "ruled", F.coalesce("root", "node").alias("root"))
    nodes = staged(nodes, "nodes")
    classes = nodes.filter("ruled is not null").groupBy("root").agg(F.max("ruled").alias("most"), F.min("ruled").alias("least"))
    return nodes.join(classes.filter("least = 'block'"), "root").select(F.col("url").alias("node"))


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", few: int = FEW) -> DataFrame:
    """page_id, host, path, rule, verdict, aliased (the verdict comes from the class). ``redirects``
    has pairs of addresses (a, b) beside those found in the pages."""
    links = links_of(pages, url_col, html_col)
    if redirects is not None:
        more = redirects.select(node_of(F.col("a")).alias("a"), node_of(F.col("b")).alias("b"))
        links = links.unionByName(more.filter("a is not null and b is not null and a <> b")).distinct()
    reached = staged(blocked(links, rules), "blocked")
    url = F.col(url_col).cast("string")
    own = ruled(pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node")), rules, few)
    own = own.join(reached.withColumnRenamed("node", "_node"), F.col("ruled").isNull() & (F.col("node") == F.col("_node")), "left")
    aliased = F.col("_node").isNotNull()
    verdict = F.coalesce("ruled", F.when(aliased, "block").otherwise("allow"))
    return own.select("page_id", "host", "path", "rule", verdict.alias("verdict"), aliased.alias("aliased"))
