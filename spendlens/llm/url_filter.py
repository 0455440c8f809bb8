"""URL filters with redirect equivalence: block decisions reach every alias of a page. DataFrame functions only."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A rule list is part of the plan; longer lists are refused.
MOST_RULES = 1000


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules that the contract states.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def url_host(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node(url: Column) -> Column:
    """What an edge joins: the url without fragment, its scheme and host in lower case; null where it has no `://`."""
    scheme = F.translate(F.regexp_extract(url, r"(?s)^(.*?)://", 1), UPPER, LOWER)
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    rest = F.when(rest == "", "/").otherwise(rest)
    return F.when(F.instr(url, "://") > 0, F.concat(scheme, F.lit("://"), url_host(url), rest))


def _without_dots(path: Column) -> Column:
    """The path with its `.` and `..` segments resolved."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    steps = F.aggregate(
        F.slice(parts, 2, F.size(parts)), F.array().cast("array<string>"),
        lambda acc, x: F.when(x == ".", acc)
        .when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(x))),
    )
    open_end = F.when(last.isin(".", ".."), F.concat(steps, F.array(F.lit("")))).otherwise(steps)
    return F.concat(F.lit("/"), F.array_join(open_end, "/"))


def resolved(url: Column, target: Column) -> Column:
    """A link's target as an absolute address, seen from the page at url; null where neither has one."""
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    site = F.concat(scheme, F.lit("://"), F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    own_path = F.when(url_path(url) == "", "/").otherwise(url_path(url))
    path, rest = F.regexp_extract(target, r"(?s)^([^?#]*)", 1), F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.regexp_extract(own_path, r"(?s)^(.*/)", 1)
    full = F.when(path == "", own_path).when(path.startswith("/"), _without_dots(path)).otherwise(_without_dots(F.concat(folder, path)))
    own_query = F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1)
    query = F.when((path == "") & ~rest.startswith("?"), F.concat(own_query, rest)).otherwise(rest)
    inside = F.when(target.startswith("//"), F.concat(scheme, F.lit(":"), target)).otherwise(F.concat(site, full, query))
    return F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), target).when(F.instr(url, "://") > 0, inside)


def page_edges(pages: DataFrame) -> DataFrame:
    """(a, b): links from a page to what it calls its canonical address or refreshes to; relative ones start at the page's url."""
    tag = r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)"
    refresh = r"(?is)<meta\b(?=[^>]*http-equiv\s*=\s*[\"']?refresh\b)[^>]*\burl\s*=\s*[\"']?([^\"'\s>]+)"
    some = F.col("html").rlike(r"(?i)canonical|http-equiv")  # most pages are done here
    targets = F.flatten(F.array(*(F.regexp_extract_all("html", F.lit(p), F.lit(1)) for p in (tag, refresh))))
    found = pages.where(some).select("url", node(F.col("url")).alias("a"), F.explode(targets).alias("target"))
    return found.select("a", node(resolved(F.col("url"), F.col("target"))).alias("b")).where("a is not null and b is not null and a != b")


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The position of the longest rule that fits (of equally long ones an allow), or null."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    found = F.lit(None).cast("int")
    for i, rule in sorted(enumerate(rules), key=lambda x: (len(x[1].name), x[1].verdict == "allow")):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.lit(i)).otherwise(found)
    return found


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, redirects: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict, component, propagated) for every row of pages (page_id, url, html).

    A url's own rule decides. Without one, a url is blocked if redirect or canonical-link edges connect it, over any number
    of steps and in either direction, with a url that a rule blocks; an explicit allow of its own always wins over that.
    Everything else gets `default`. Edges come from the pages' html and from `redirects` (from_url, to_url); their ends need
    not be pages. component is the smallest address of the connected group (null without edges), propagated tells whether
    the verdict came over edges.

    A null url or one without `://` has empty host and path, fits no rule, has no edges. Null html has no edges; repeated
    rows are judged alike; other columns are ignored. Only pages with edges are shuffled, and a group's decision is one flag.
    """
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    names = F.array(*[F.lit(r.name) for r in rules]) if rules else F.array(F.lit(None).cast("string"))
    verdicts = F.array(*[F.lit(r.verdict) for r in rules]) if rules else F.array(F.lit(None).cast("string"))

    def ruled(url: Column) -> Column:
        at = rule_of(url_host(url), url_path(url), rules)
        return F.when(at.isNotNull(), F.element_at(verdicts, at + 1))

    edges = page_edges(pages)
    if redirects is not None:
        more = redirects.select(node(F.col("from_url")).alias("a"), node(F.col("to_url")).alias("b"))
        edges = edges.union(more.where("a is not null and b is not null and a != b"))
    groups = components(edges)
    blocked = groups.where(ruled(F.col("id")) == "block").select("component").distinct().withColumn("blocked", F.lit(True))
    aliases = saved(groups.join(blocked, "component", "left"), "aliases").select(F.col("id").alias("_node"), "component", "blocked")

    at = rule_of(F.col("host"), F.col("path"), rules)
    judged = pages.select("page_id", host.alias("host"), path.alias("path"), node(F.col("url")).alias("_node"))
    judged = judged.withColumn("_at", at).join(aliases, "_node", "left")
    return judged.select(
        "page_id", "host", "path",
        F.when(F.col("_at").isNotNull(), F.element_at(names, F.col("_at") + 1)).alias("rule"),
        F.when(F.col("_at").isNotNull(), F.element_at(verdicts, F.col("_at") + 1))
        .when(F.col("blocked"), "block").otherwise(default).alias("verdict"),
        "component",
        (F.col("_at").isNull() & F.coalesce("blocked", F.lit(False))).alias("propagated"),
    )
