"""URL filters with redirect equivalence, in DataFrame operations only.

Rules judge what they fit. A url without a rule is judged by its aliases: redirect and
canonical-link edges make components, and a block anywhere in a component reaches every member
that no rule of its own allows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.llm.components import connected_components
from cuelake.llm.workdir import Scratch

#: Verdict, host and path of each rule of the contract.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), 0)


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; null if there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(after_scheme(url), "^[^/?#]*", 0), CAPITALS, SMALL), F.lit(""))


def path_of(url: Column) -> Column:
    rest = after_scheme(url)
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def without_dots(path: Column) -> Column:
    """A path without its ``.`` and ``..`` segments; an empty one is ``/``."""
    up = lambda kept, s: F.when(s == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).when(s == ".", kept).otherwise(F.concat(kept, F.array(s)))

    def joined(parts: Column) -> Column:
        kept = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array().cast("array<string>"), up)
        end = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.lit("/"), F.array_join(F.concat(kept, end), "/"))

    return _let(path, lambda p: F.when(p.rlike(r"/\.\.?(/|$)"), _let(F.split(p, "/"), joined)).when(p == "", "/").otherwise(p))


def page_key(url: Column) -> Column:
    """Host, path and query: what a server is asked for. Urls that differ in scheme or fragment, by dot segments, or by an empty path for ``/`` are one page; null without ``://``."""
    return F.concat(host_of(url), without_dots(path_of(url)), F.regexp_extract(after_scheme(url), r"(?s)^[^?#]*(\?[^#]*)?", 1))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null; of equally long ones the first."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, domain, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(prefix)
        out = F.when(fits, F.struct(F.lit(domain + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _tags(html: Column, name: str) -> Column:
    return F.regexp_extract_all(html, F.lit(f"(?is)<{name}\\s[^>]*>"), F.lit(0))


def unescaped(value: Column) -> Column:
    """Text of an html attribute: numbered references and the five of XML become their characters; others stay."""
    named = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}

    def char(name: Column) -> Column:
        number = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 9), 16, 10)).when(name.startswith("#"), F.substring(name, 2, 9)).try_cast("long")
        out = _let(number, lambda n: F.when(n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")))
        for k, c in named.items():
            out = F.when(name == k, c).otherwise(out)
        return out

    def piece(p: Column) -> Column:
        name = F.regexp_extract(p, "^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|amp|lt|gt|quot|apos);", 1)
        return _let(name, lambda m: F.coalesce(F.concat(char(m), F.substring(p, F.length(m) + 2, F.length(p))), F.concat(F.lit("&"), p)))

    def joined(parts: Column) -> Column:
        return F.concat(F.element_at(parts, 1), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), piece), ""))

    return _let(value, lambda v: F.when(v.contains("&"), _let(F.split(v, "&"), joined)).otherwise(v))


def _attribute(tag: Column, name: str) -> Column:
    return F.trim(unescaped(F.regexp_replace(F.regexp_extract(tag, f"(?is)\\s{name}\\s*=\\s*(\"[^\"]*\"|'[^']*'|[^\\s>]+)", 1), "^[\"']|[\"']$", "")))


def alias_targets(html: Column) -> Column:
    """Addresses that a page names as itself: canonical links, and refreshes with a url."""
    canonical = F.transform(F.filter(_tags(html, "link"), lambda t: _attribute(t, "rel").rlike("(?i)(^|\\s)canonical(\\s|$)")), lambda t: _attribute(t, "href"))
    refresh = F.transform(F.filter(_tags(html, "meta"), lambda t: F.lower(_attribute(t, "http-equiv")) == "refresh"), lambda t: F.trim(F.regexp_replace(F.regexp_extract(_attribute(t, "content"), "(?is)url\\s*=\\s*(.*)$", 1), "^[\"']|[\"']$", "")))
    found = F.filter(F.concat(canonical, refresh), lambda u: u != "")
    return F.when(html.rlike("(?i)canonical|refresh"), found)


def resolved(target: Column, url: Column) -> Column:
    """A target as an absolute url without dot segments, relative ones from ``url``; null for schemes without ``://``, and for relative ones if ``url`` has none."""
    scheme = "^[A-Za-z][A-Za-z0-9+.-]*:"
    start = F.when(url.contains("://"), F.regexp_extract(url, "^(.*?)://", 1))

    def far(t: Column) -> Column:
        return F.concat(F.regexp_extract(t, "^(.*?)://", 1), F.lit("://"), host_of(t), without_dots(path_of(t)), F.regexp_extract(after_scheme(t), "(?s)^[^?#]*(.*)$", 1))

    def near(t: Column) -> Column:
        own, path, tail = path_of(url), F.regexp_extract(t, "^[^?#]*", 0), F.regexp_extract(t, "(?s)[?#].*$", 0)
        query = F.regexp_extract(after_scheme(url), r"(?s)^[^?#]*(\?[^#]*)?", 1)
        folder = F.when(own == "", "/").otherwise(F.regexp_extract(own, "(?s)^.*/", 0))
        whole = F.when(path.startswith("/"), path).when(path != "", F.concat(folder, path)).otherwise(own)
        kept = F.when((path == "") & ~t.startswith("?"), query).otherwise("")
        return F.concat(start, F.lit("://"), host_of(url), without_dots(whole), kept, tail)

    return _let(target, lambda t: F.when(t.rlike(f"{scheme}//"), far(t)).when(t.startswith("//"), _let(F.concat(start, F.lit(":"), t), far)).when(~t.rlike(scheme), near(t)))


def judge_urls(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", rules: Sequence[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, aliased) of every row of ``pages``.

    ``rules`` is a list of (verdict, host, path) known on the driver. Edges come from canonical
    links and refreshes in the html, relative ones resolved, and from ``redirects`` (source_url,
    target_url) if given. The verdict is that of the longest fitting rule; without one, block if the component of the url
    holds a blocked address, else allow; aliased tells the former. Null urls, and those without
    ``://``, have empty host and path, no rule and no alias. Null html has no edges; repeated rows
    are judged alike; an empty table gives an empty result.
    """
    with Scratch(pages.sparkSession, "urls") as scratch:
        own = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
        linked = _links(own, scratch)
        if redirects is not None:
            linked = linked.unionByName(redirects.select(F.col("source_url").alias("url"), F.col("target_url").alias("target")))
        ends = scratch.save(linked.where("target is not null").select(page_key(F.col("url")).alias("a"), page_key(F.col("target")).alias("b"), "url", "target").distinct(), "links")
        judged = own.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), page_key(F.col("url")).alias("key"))
        judged = judged.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
        if ends.isEmpty():
            return scratch.keep(_verdicts(judged.withColumn("aliased", F.lit(False))))
        known = ends.select(F.col("a").alias("node"), F.col("url")).unionByName(ends.select(F.col("b").alias("node"), F.col("target").alias("url")))
        blocked = known.where(rule_of(host_of(F.col("url")), path_of(F.col("url")), rules).getField("verdict") == "block").select("node").distinct()
        members = connected_components(ends, scratch)
        bad = scratch.save(members.join(blocked, "node").select("component").distinct(), "bad")  # a table, so that Spark can split a large component
        tainted = members.join(bad, "component").select(F.col("node").alias("key"), F.lit(True).alias("aliased"))
        return scratch.keep(_verdicts(judged.join(tainted, "key", "left")))


def _links(own: DataFrame, scratch: Scratch) -> DataFrame:
    """(url, target): where pages lead, as absolute urls.

    What is named is taken out of the pages first and written; addresses are then resolved step by
    step on these few short rows, as one expression of it all would be very long.
    """
    base = F.when(F.col("html").rlike("(?i)<base"), F.get(F.filter(F.transform(_tags(F.col("html"), "base"), lambda t: _attribute(t, "href")), lambda u: u != ""), 0))
    named = scratch.save(own.where(F.col("html").rlike("(?i)canonical|refresh")).select("url", base.alias("base"), F.explode(F.array_distinct(alias_targets(F.col("html")))).alias("target")), "named")
    based = scratch.save(named.select("url", "target", F.when(F.col("base").isNull(), F.col("url")).otherwise(F.coalesce(resolved(F.col("base"), F.col("url")), "url")).alias("base")), "based")
    return scratch.save(based.select("url", resolved(F.col("target"), F.col("base")).alias("target")), "targets")


def _verdicts(judged: DataFrame) -> DataFrame:
    aliased = F.col("found").isNull() & F.coalesce("aliased", F.lit(False))
    verdict = F.coalesce(F.col("found.verdict"), F.when(aliased, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), aliased.alias("aliased"))
