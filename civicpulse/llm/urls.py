"""URL filter: rules on hosts and paths, and a tree of path templates for what no rule decides."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Branches of a node are one variable segment if there are so many ...
LEAST_KINDS = 8
#: ... and no more pages than this per branch: names of sections are shared by ever more pages, identifiers aren't.
PAGES_PER_KIND = 4
#: Squared deviation, in its variances, up to which a branch's share of blocked pages is like its node's (5 %).
ALIKE = 3.84
#: Labelled pages that the share of the node above counts as.
WEIGHT = 10.0
#: Smoothed share of blocked pages from which a template is rejected.
REJECTED = 0.8
#: Hosts that differ in one of these first labels are one site.
SITE = r"^(?:www|m|mobile|blog)\.(.+\..+)$"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str) -> tuple[Column, Column]:
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*+", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*+([^?#]*+)", 1)


def rule_for(rules: tuple[Rule, ...], value: str) -> Column:
    """``text`` or ``verdict`` of the longest rule that fits ``host`` and ``path``, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((F.col("host") == rule.host) | F.endswith("host", F.lit("." + rule.host))) & F.startswith("path", F.lit(rule.path))
        out = F.when(fits, getattr(rule, value)).otherwise(out)
    return out


def _smoothed(blocked: str, labelled: str) -> Column:
    """The share of blocked pages, that of the node above counting as WEIGHT pages."""
    return (F.col(blocked) + F.lit(WEIGHT) * F.col("share")) / (F.col(labelled) + F.lit(WEIGHT))


def _grown(active: DataFrame, level: int) -> DataFrame:
    """The active shapes one level down: the prefix of their template grows by a segment, and their node's share is its."""
    active = active.withColumn("child", F.element_at("segments", level))
    kids = active.groupBy("prefix", "child").agg(
        F.sum("pages").alias("p"), F.sum("labelled").alias("l"), F.sum("blocked").alias("b"), F.first("share").alias("share")
    )
    nodes = kids.groupBy("prefix").agg(F.count("*").alias("kids"), F.sum("p").alias("all_p"))
    apart, share = _smoothed("b", "l") - F.col("share"), F.col("share")
    alike = apart * apart <= F.lit(ALIKE) * (share * (F.lit(1.0) - share)) / (F.col("l") + F.lit(WEIGHT))
    variable = (F.col("kids") >= LEAST_KINDS) & (F.col("kids") * PAGES_PER_KIND >= F.col("all_p"))
    segment = F.when(F.col("kids") == 1, F.col("child")).when(variable, "*").when(alike, "+").otherwise(F.col("child"))
    kids = kids.join(nodes, "prefix").withColumn("grown", F.concat_ws("/", "prefix", segment))
    # Branches that became one are a node with the labels of all.
    merged = kids.groupBy("grown").agg(F.sum("l").alias("l"), F.sum("b").alias("b"), F.first("share").alias("share"))
    merged = merged.select("grown", _smoothed("b", "l").alias("new_share"))
    named = kids.select("prefix", "child", "grown").join(merged, "grown")
    found = active.join(named, ["prefix", "child"])
    return found.select("site", "shape", "segments", "pages", "labelled", "blocked", F.col("grown").alias("prefix"), F.col("new_share").alias("share"))


def templates(shapes: DataFrame) -> DataFrame:
    """Per shape (site, shape): its template and the smoothed share of blocked pages in the template's branch.

    Level by level below each site, many branches with few pages each become one wildcard ``*``, and
    branches whose smoothed share is like their node's become one branch ``+``: a branch without labels
    is like its node. A node's share is smoothed towards that of the node above, a site's towards the
    whole table's. A shape that is alone in its node is its own template below, so the levels end where
    the paths part. The tree, a row per shape, is checkpointed at each level.
    """
    path = F.split(F.substring("shape", 2, 1 << 30), "/", -1)
    sums = [F.sum("labelled").alias("l"), F.sum("blocked").alias("b")]
    whole = shapes.agg(*sums).head()
    prior = F.lit(((whole["b"] or 0) + 1.0) / ((whole["l"] or 0) + 2.0))
    sites = shapes.groupBy("site").agg(*sums).withColumn("share", prior).select("site", _smoothed("b", "l").alias("share"))
    tree = shapes.withColumn("segments", F.when(F.col("shape") == "", F.array().cast("array<string>")).otherwise(path))
    tree = tree.withColumn("prefix", F.col("site")).join(sites, "site").checkpoint()
    done, level = [], 0
    while True:
        goes_on = F.size("segments") > level
        shared = tree.where(goes_on).groupBy("prefix").agg((F.count("*") > 1).alias("together")).where("together")
        known = tree.join(shared, "prefix", "left")
        active = known.where(goes_on & F.col("together").isNotNull()).drop("together").checkpoint()
        rest = F.array_join(F.slice("segments", level + 1, F.greatest(F.size("segments") - level, F.lit(0))), "/")
        template = F.when(goes_on, F.concat("prefix", F.lit("/"), rest)).otherwise(F.col("prefix"))
        ended = known.where(~goes_on | F.col("together").isNull())
        done.append(ended.select("site", "shape", template.alias("template"), "share"))
        if active.isEmpty():
            break
        level += 1
        tree = _grown(active, level).checkpoint()
    found = done[0]
    for more in done[1:]:
        found = found.union(more)
    return found


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict and template.

    A page that a rule fits has the longest rule's verdict. These pages are also the labels of the
    method, which gives the verdict of all others: block if the smoothed share of blocked pages in
    their template is REJECTED or more, else allow. Hosts like www.a.com and m.a.com are one site. Digits
    count as one variable number from the start, and pages with equal sites and shapes are counted
    before anything is grouped, so a host with very many pages is a few rows of the tree.

    A null url, or one without "://", has empty host and path and is judged like any other page;
    repeated rows have a row each; an empty table gives an empty one.
    """
    host, path = host_and_path("url")
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumns({
        "rule": rule_for(rules, "text"), "by_rule": rule_for(rules, "verdict"),
        "shape": F.regexp_replace("path", "[0-9]++", "#"), "site": F.regexp_replace("host", SITE, "$1"),
    })
    shapes = rows.groupBy("site", "shape").agg(
        F.count("*").alias("pages"), F.count("by_rule").alias("labelled"), F.count(F.when(F.col("by_rule") == "block", 1)).alias("blocked")
    )
    found = templates(shapes)
    verdict = F.coalesce("by_rule", F.when(F.col("share") >= REJECTED, "block").otherwise("allow"))
    return rows.join(found, ["site", "shape"], "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template")


def judge_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same for DuckDB, over the view ``pages``."""
    ordered = sorted(rules, key=lambda r: (-len(r.text), r.text))
    fits = [f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')" for r in ordered]
    cases = lambda value: "CASE " + " ".join(f"WHEN {f} THEN '{getattr(r, value)}'" for r, f in zip(ordered, fits)) + " END"
    smoothed = f"(sum(blocked) OVER (PARTITION BY {{0}}) + {WEIGHT}::DOUBLE * share) / (sum(labelled) OVER (PARTITION BY {{0}}) + {WEIGHT}::DOUBLE)"
    return f"""
      WITH RECURSIVE
        rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        parsed AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}') AS host,
          regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
        ruled AS (SELECT *, {cases("text")} AS rule, {cases("verdict")} AS by_rule, regexp_replace(path, '[0-9]+', '#', 'g') AS shape,
          regexp_replace(host, '{SITE}', '\\1') AS site FROM parsed),
        shapes AS (SELECT site, shape, count(*) AS pages, count(by_rule) AS labelled, count(*) FILTER (by_rule = 'block') AS blocked FROM ruled GROUP BY ALL),
        prior AS (SELECT (coalesce(sum(blocked), 0) + 1.0::DOUBLE) / (coalesce(sum(labelled), 0) + 2.0::DOUBLE) AS share FROM shapes),
        walk(site, shape, segments, pages, labelled, blocked, prefix, share, level) AS (
          SELECT site, shape, CASE WHEN shape = '' THEN [] ELSE string_split(substr(shape, 2), '/') END, pages, labelled, blocked, site,
            {smoothed.format("site")}, 0 FROM shapes, prior
          UNION ALL
          SELECT site, shape, segments, pages, labelled, blocked, grown, {smoothed.format("grown")}, level + 1
          FROM (SELECT *, prefix || '/' || CASE WHEN kids = 1 THEN child WHEN kids >= {LEAST_KINDS} AND kids * {PAGES_PER_KIND} >= all_pages THEN '*'
                WHEN pow(kid - share, 2) <= {ALIKE}::DOUBLE * (share * (1.0::DOUBLE - share)) / (l + {WEIGHT}::DOUBLE) THEN '+' ELSE child END AS grown
            FROM (SELECT *, count(DISTINCT child) OVER (PARTITION BY prefix) AS kids, sum(pages) OVER (PARTITION BY prefix) AS all_pages,
                count(*) OVER (PARTITION BY prefix) AS together, sum(labelled) OVER (PARTITION BY prefix, child) AS l,
                {smoothed.format("prefix, child")} AS kid
              FROM (SELECT *, segments[level + 1] AS child FROM walk WHERE len(segments) > level)) WHERE together > 1)),
        last AS (SELECT *, prefix || CASE WHEN len(segments) > level THEN '/' || array_to_string(segments[level + 1:], '/') ELSE '' END AS template
          FROM walk QUALIFY row_number() OVER (PARTITION BY site, shape ORDER BY level DESC) = 1)
      SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN share >= {REJECTED}::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict, template
      FROM ruled r JOIN last f ON r.site = f.site AND r.shape = f.shape"""
