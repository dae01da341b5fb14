"""URL filtering with redirect equivalence (operator 1).

Rules name a host (with its subdomains) and a path prefix; the longest rule that fits a url decides it.  Urls that
redirect to each other, or name each other as canonical, are one resource: connected components over those edges carry
a block decision to every alias.  A url that an allow rule itself fits stays allowed, whatever its aliases are.

Nodes are host and path (scheme, query and fragment don't make another resource).  Edges come from the pages
(``<link rel=canonical>``, ``<meta http-equiv=refresh>``) and from a table of redirects; targets are resolved against the
page's url with ``.`` and ``..`` segments taken out.  Only edges between different nodes enter the component rounds, and
component verdicts are aggregated per component with partial sums.

Edge cases: a null url, or one without ``://``, has an empty host and path, fits no rule and has no aliases: its
verdict is the default, allow; equally long rules that fit tie for allow; a link to a fragment or of a scheme without a
host names no resource; a page's own path is taken as it is; html of any length is searched whole; empty tables give no
rows; repeated pages are judged each; further columns are ignored.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import connected_components, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path) of the query's contract
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)


def _ordered(rules) -> list:
    """Longest first; of equally long ones an allow rule first."""
    return sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r[1], r[2]))


def fitting_rule(host: Column, path: Column, rules) -> Column:
    """The place in ``_ordered(rules)``, from 1, of the longest rule that fits; null if none does."""
    out = None
    for k, (_, h, p) in enumerate(_ordered(rules), 1):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, k) if out is None else out.when(fits, k)
    return F.lit(None).cast("int") if out is None else out


def _of_rule(place: Column, rules, pick) -> Column:
    """What ``pick`` takes from the rule at a place; null for a null place."""
    return F.element_at(F.array(F.lit(""), *(F.lit(pick(r)) for r in _ordered(rules))), F.coalesce(place, F.lit(0)) + 1)


#: Character references that occur in urls and attribute values.
ENTITIES = (("&quot;", '"'), ("&#34;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&#x27;", "'"), ("&#47;", "/"), ("&#x2f;", "/"), ("&#x2F;", "/"), ("&#38;", "&"), ("&#x26;", "&"), ("&amp;", "&"))


def _attribute(tag: Column, name: str) -> Column:
    """An attribute's value in a tag, quoted or bare, with character references decoded; null without the attribute.

    The tag is read attribute by attribute, so a name within another name or within a value is none.
    """
    each = F.regexp_extract_all(F.regexp_replace(tag, r"^<\w+", ""), F.lit(r"""[^\s=>"'/]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"']+))?"""), F.lit(0))
    own = F.element_at(F.concat(F.filter(each, lambda a: F.lower(a).rlike(rf"^{name}\s*=")), F.array(F.lit(None).cast("string"))), 1)
    bare = F.regexp_replace(own, r"^[^=]*=\s*", "")
    value = F.when(bare.rlike(r"^[\"']"), F.substr(bare, F.lit(2), F.length(bare) - 2)).otherwise(bare)
    for code, char in ENTITIES:
        value = F.replace(value, F.lit(code), F.lit(char))
    return F.btrim(value, F.lit(" \t\n\x0b\f\r"))


def without_dots(path: Column) -> Column:
    """A path without its ``.`` and ``..`` segments."""
    parts = F.split(path, "/", -1)

    def step(acc, x):
        up = F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)
        return F.when(x["p"] == "..", F.when(x["last"], F.concat(up, F.array(F.lit("")))).otherwise(up)).when(x["p"] == ".", F.when(x["last"], F.concat(acc, F.array(F.lit("")))).otherwise(acc)).otherwise(F.concat(acc, F.array(x["p"])))

    def fold(parts):
        each = F.transform(parts, lambda p, i: F.struct(p.alias("p"), (i == F.size(parts) - 1).alias("last")))
        return F.array_join(F.aggregate(each, F.array().cast("array<string>"), step), "/")

    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), _bound(parts, fold)).otherwise(path)


def resolved(base: Column, link: Column) -> Column:
    """The absolute url (host and path) that a link on a page names; null if it names none."""
    site = F.regexp_extract(base, r"^[^:]*://[^/?#]*", 0)
    path = F.regexp_extract(base, r"^[^:]*://[^/?#]*([^?#]*)", 1)
    bare = F.regexp_replace(link, r"[?#].*$", "")
    own = lambda to: F.concat(site, without_dots(F.when(to.startswith("/"), to).otherwise(F.concat(F.when(path == "", "/").otherwise(F.regexp_replace(path, r"[^/]*$", "")), to))))
    whole = lambda url: F.concat(F.regexp_extract(url, r"^[^:]*://[^/]*", 0), without_dots(F.regexp_extract(url, r"^[^:]*://[^/]*(.*)$", 1)))
    other = link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")
    return (
        F.when(link.isNull() | (link == "") | link.startswith("#"), F.lit(None).cast("string")).when(other & bare.contains("://"), whole(bare)).when(other, F.lit(None).cast("string"))
        .when(bare.startswith("//"), whole(F.concat(F.regexp_extract(base, r"^[^:]*:", 0), bare))).when(bare == "", F.concat(site, path)).otherwise(own(bare))
    )


def alias_edges(pages: DataFrame) -> DataFrame:
    """src, dst urls of the canonical and refresh links in the pages' html."""
    tags = pages.where("url IS NOT NULL AND html IS NOT NULL").where(F.col("html").rlike("(?i)canonical|refresh"))
    tags = tags.select("url", F.explode(F.regexp_extract_all("html", F.lit(r"""(?is)<(?:link|meta)\b(?:[^>"']|"[^"]*"|'[^']*')*+>"""), F.lit(0))).alias("tag"))
    tags, _ = stored(tags.where(F.col("tag").rlike("(?i)canonical|refresh")), "alias-tags")  # few rows, and short expressions from here on
    canonical = F.when(F.array_contains(F.split(F.lower(_attribute(F.col("tag"), "rel")), r"\s+"), "canonical"), _attribute(F.col("tag"), "href"))
    goal = F.btrim(F.regexp_extract(_attribute(F.col("tag"), "content"), r"(?is)^[^;,]*[;,]\s*url\s*=\s*(.*)$", 1), F.lit("\"' "))
    refresh = F.when(F.lower(_attribute(F.col("tag"), "http-equiv")) == "refresh", goal)
    return tags.select(F.col("url").alias("src"), _bound(F.coalesce(canonical, refresh), lambda link: resolved(F.col("url"), link)).alias("dst"))


def _resource(url: Column) -> Column:
    """Host and path in one, null without a host."""
    return _bound(url, lambda u: F.when(split_url(u)[0] != "", F.concat(*split_url(u))))


def filter_urls(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """One row a page: page_id, host, path, rule (or null), verdict, component (or null for urls without aliases)."""
    host, path = split_url(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"))
    judged = judged.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules)).withColumn("resource", F.when(F.col("host") != "", F.concat("host", "path")))
    edges = alias_edges(pages)
    if redirects is not None:
        edges = edges.unionAll(redirects.select("src", "dst"))
    edges, _ = stored(edges.select(_resource(F.col("src")).alias("a"), _resource(F.col("dst")).alias("b")), "alias-edges")
    edges = edges.where("a <> b").distinct()
    alias = connected_components(edges).withColumnRenamed("node", "resource")
    alias, _ = stored(alias, "aliases")
    # a component's verdict also counts resources that are only named by links
    at = F.instr("resource", "/")
    h = F.when(at > 0, F.substring_index("resource", "/", 1)).otherwise(F.col("resource"))
    p = F.when(at > 0, F.substr("resource", at)).otherwise(F.lit(""))
    verdicts = alias.withColumn("fit", fitting_rule(h, p, rules)).groupBy("component").agg(F.max(F.coalesce(_of_rule(F.col("fit"), rules, lambda r: r[0]) == "block", F.lit(False))).alias("blocked"))
    component = alias.join(verdicts, "component")
    out = judged.join(component, "resource", "left")
    fits = F.col("fit").isNotNull()
    own = F.when(fits, _of_rule(F.col("fit"), rules, lambda r: r[0]))
    verdict = F.coalesce(own, F.when(F.col("blocked"), "block"), F.lit(default))
    return out.select("page_id", "host", "path", F.when(fits, _of_rule(F.col("fit"), rules, lambda r: r[1] + r[2])).alias("rule"), verdict.alias("verdict"), "component")


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


def _sql_rules() -> tuple[str, str]:
    order = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow"))
    fits = [f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND path LIKE '{p}%'" for _, h, p in order]
    return " ".join(f"{f} THEN '{h}{p}'" for f, (_, h, p) in zip(fits, order, strict=True)), " ".join(f"{f} THEN '{v}'" for f, (v, _, _) in zip(fits, order, strict=True))


#: For pages without canonical or refresh links, which the given tables are; tests hold the rest against brute force.
OP1_SQL = f"""
WITH rest AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS h, regexp_extract(substr(coalesce(rest, ''), length(regexp_extract(coalesce(rest, ''), '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM rest
), named AS (SELECT page_id, translate(h, '{UPPER}', '{LOWER}') AS host, path FROM parts)
SELECT page_id, host, path, CASE {_sql_rules()[0]} END AS rule, coalesce(CASE {_sql_rules()[1]} END, 'allow') AS verdict, NULL::VARCHAR AS component
FROM named
"""
