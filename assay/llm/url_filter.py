"""URL filter: a path-template tree per host, judged by smoothed labelled purity.

Only DataFrame functions.  Urls that a rule fits are labelled by that rule
(block = bad) and keep its verdict; the others get that of their template:

1. Generalise, level by level from the host down.  A path segment that looks like
   an id (digits, hex, dates, numbered slugs) is ``*`` from the start.  Under a
   node with at least ``min_children`` different children those that hold less
   than ``rare`` of its urls become ``*`` too.  The node of the next level is named
   by the generalised segments, so children of a wildcard are pooled.
2. Merge, again from the host down.  Siblings are put in the order of their most
   frequent next segment, then of their smoothed bad rates, so that those with like
   subtrees and rates are neighbours.  Neighbours are alike if their distributions of
   next segments pass a two-sample chi-square test (at most df + z * sqrt(2 df)) and
   their labels speak for it: both labelled, the later one's bad rate passes a
   two-proportion z test against the last labelled sibling before it; both unlabelled,
   the subtrees are enough; one labelled and one not, the subtrees must be evidence,
   with at least ``min_urls`` urls each and two or more next segments in all (a lone
   wildcard is none).  A run of two or more neighbours that are alike becomes one
   branch ``+1``, ``+2``, ... whose subtrees are merged.  (After step 1 a node has few
   children: fewer than ``min_children``, or those with the share ``rare`` at least
   and ``*``.)
3. Judge.  The purity of a node is (bad + k * prior) / (labelled + k), over all urls at
   or below it.  A host's prior is the rate of all labels.  Below it, the prior is the
   parent's purity as far as the parent's urls are labelled, and the parent's own prior
   for the rest: prior + (purity - prior) * labelled / urls.  So a branch without labels
   follows its host where the host is known, and not where only a part of it is; a host
   without any label has the overall rate.  A template is blocked from purity
   ``reject`` on.

Segments from level ``levels`` on count as one, so work grows with a path's length
and not with its square, however long it is.  Counts are made per (host, id-free
path) before anything is joined, so a hot host costs one partial sum per task; each
level is written once, and joins are plain equi-joins, which Spark may split when
skewed.

Null urls and urls without ``://`` have an empty host and path, no rule, and the
verdict of that host's root.  Repeated rows are judged alike and all returned; ids
may have any type; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.llm.common import ascii_lower, materialise

#: (verdict, host, path) of the production list.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Levels of the tree.
LEVELS = 6
VARIABLE = r"^([0-9]+(\.[A-Za-z0-9]+)?|[0-9a-fA-F]{8,}|[0-9]{4}-[0-9]{2}-[0-9]{2}|[^/]*-[0-9]{3,})\z"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    rest = _rest(url)
    tail = F.substring(rest, F.length(F.regexp_extract(rest, r"^[^/?#]*", 0)) + 1, F.length(rest))
    return F.coalesce(F.regexp_extract(tail, r"^[^?#]*", 0), F.lit(""))


def _longest(rules: Sequence[tuple[str, str, str]], host: Column, path: Column, value) -> Column:
    out = None
    for rule in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2])
        out = F.when(fits, F.lit(value(rule))) if out is None else out.when(fits, F.lit(value(rule)))
    return F.lit(None).cast("string") if out is None else out


def _segments(path: Column, levels: int) -> Column:
    cut = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: F.when(s.rlike(VARIABLE), "*").otherwise(s))
    rest = F.array(F.array_join(F.slice(cut, levels, F.greatest(F.size(cut), F.lit(1))), "/"))
    return F.when(F.size(cut) > levels, F.concat(F.slice(cut, 1, levels - 1), rest)).otherwise(cut)


def _generalised(paths: DataFrame, depth: int, min_children: int, rare: float) -> DataFrame:
    """paths (host, segs, ...) with ``gens``, the segments with wildcards."""
    out = paths.withColumns({"gens": F.array().cast("array<string>"), "node": F.lit("")})
    for k in range(1, depth + 1):
        out = materialise(out.withColumn("seg", F.try_element_at("segs", F.lit(k))))
        children = out.where("seg is not null").groupBy("host", "node", "seg").agg(F.sum("n").alias("c"))
        nodes = children.groupBy("host", "node").agg(F.sum("c").alias("total"), F.count("*").alias("kinds")).where(F.col("kinds") >= min_children)
        wild = children.join(nodes, ["host", "node"]).where(F.col("c") < rare * F.col("total")).select("host", "node", "seg", F.lit(True).alias("wild"))
        out = out.join(wild, ["host", "node", "seg"], "left").withColumn("gen", F.when(F.col("wild"), "*").otherwise(F.col("seg")))
        out = out.withColumns({"gens": F.when(F.col("gen").isNull(), F.col("gens")).otherwise(F.concat("gens", F.array("gen"))), "node": F.when(F.col("gen").isNull(), F.col("node")).otherwise(F.concat("node", F.lit("/"), "gen"))})
        out = out.drop("seg", "wild", "gen")
    return materialise(out.drop("node"))


def _merged(level: DataFrame, z: float, k: float, min_urls: int) -> DataFrame:
    """level (host, branch, g, next, n, labelled, bad, prior of the siblings) -> (host, branch, g, name) of the siblings' runs."""
    cells = level.groupBy("host", "branch", "g", "next").agg(*[F.sum(c).cast("double").alias(a) for a, c in (("o", "n"), ("l", "labelled"), ("b", "bad"))], F.max("prior").alias("p"))
    main = F.max(F.struct("o", "next"))["next"]
    each = cells.groupBy("host", "branch", "g").agg(F.sum("o").alias("n"), F.sum("l").alias("l"), F.sum("b").alias("b"), F.max("p").alias("p"), main.alias("main"))
    each = each.withColumn("rate", (F.col("b") + k * F.col("p")) / (F.col("l") + k))
    order = Window.partitionBy("host", "branch").orderBy("main", "rate", "g")
    before = F.last(F.when(F.col("l") > 0, F.struct("l", "b")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    each = each.withColumns({"prev": F.lag("g").over(order), "np": F.lag("n").over(order), "lp": F.lag("l").over(order), "last": before})
    pairs = each.where("prev is not null").select("host", "branch", "g", "prev", F.sqrt(F.col("np") / F.col("n")).alias("a"))
    mine = pairs.join(cells, ["host", "branch", "g"]).select("host", "branch", "g", "next", "a", F.col("o").alias("og"), F.lit(0.0).alias("op"))
    theirs = pairs.join(cells.withColumnRenamed("g", "prev"), ["host", "branch", "prev"]).select("host", "branch", "g", "next", "a", F.lit(0.0).alias("og"), F.col("o").alias("op"))
    both = mine.unionByName(theirs).groupBy("host", "branch", "g", "next").agg(F.sum("og").alias("og"), F.sum("op").alias("op"), F.max("a").alias("a"))
    gap = F.col("og") * F.col("a") - F.col("op") / F.col("a")
    shape = both.groupBy("host", "branch", "g").agg(F.sum(gap * gap / (F.col("og") + F.col("op"))).alias("chi"), (F.count("*") - 1).cast("double").alias("df"))
    l, b, m, c = F.col("l"), F.col("b"), F.col("last.l"), F.col("last.b")
    rate, apart = F.try_divide(b + c, l + m), F.try_divide(b, l) - F.try_divide(c, m)
    same_rate = F.coalesce(apart * apart <= z * z * rate * (1.0 - rate) * (F.try_divide(F.lit(1.0), l) + F.try_divide(F.lit(1.0), m)) + 1e-9, F.lit(True))
    evidence = ((l > 0) == (F.col("lp") > 0)) | ((F.col("df") > 0) & (F.least("n", "np") >= min_urls))
    alike = F.coalesce((F.col("chi") <= F.col("df") + z * F.sqrt(2.0 * F.col("df")) + 1e-6) & evidence, F.lit(False)) & same_rate
    runs = each.join(shape, ["host", "branch", "g"], "left").withColumn("run", F.sum(F.when(alike, 0).otherwise(1)).over(order))
    size = F.count("*").over(Window.partitionBy("host", "branch", "run"))
    return runs.select("host", "branch", "g", F.when(size > 1, F.concat(F.lit("+"), F.col("run").cast("string"))).otherwise(F.col("g")).alias("name"))


def _judged(shapes: DataFrame, depth: int, z: float, k: float, min_urls: int) -> DataFrame:
    """shapes (host, gens, n, labelled, bad) with template, purity and the labels at or below the template's node."""
    purity = lambda c, prior: (F.col(c + "bad").cast("double") + k * prior) / (F.col(c + "labelled").cast("double") + k)
    overall = shapes.agg(F.coalesce(F.try_divide(F.sum("bad").cast("double"), F.sum("labelled")), F.lit(0.0)).alias("rate"))
    hosts = shapes.groupBy("host").agg(F.sum("n").alias("m_n"), F.sum("labelled").alias("m_labelled"), F.sum("bad").alias("m_bad")).crossJoin(F.broadcast(overall))  # one row
    hosts = hosts.withColumnRenamed("rate", "prior").withColumn("purity", purity("m_", F.col("prior")))
    out = shapes.join(hosts, "host").withColumn("branch", F.lit(""))
    known = F.col("prior") + (F.col("purity") - F.col("prior")) * (F.col("m_labelled").cast("double") / F.col("m_n").cast("double"))
    for i in range(1, depth + 1):
        out = materialise(out.withColumns({"g": F.try_element_at("gens", F.lit(i)), "next": F.coalesce(F.try_element_at("gens", F.lit(i + 1)), F.lit("")), "prior": known}))
        merged = _merged(out.where("g is not null"), z, k, min_urls)
        out = out.join(merged, ["host", "branch", "g"], "left")
        out = materialise(out.withColumn("branch", F.when(F.col("g").isNotNull(), F.concat("branch", F.lit("/"), "name")).otherwise(F.col("branch"))).drop("name"))
        below = out.where("g is not null").groupBy("host", "branch").agg(F.sum("n").alias("b_n"), F.sum("labelled").alias("b_labelled"), F.sum("bad").alias("b_bad"))
        out = out.join(below.withColumn("here", F.lit(True)), ["host", "branch"], "left")
        here = F.col("here") & F.col("g").isNotNull()
        out = out.withColumns({
            "purity": F.when(here, purity("b_", F.col("prior"))).otherwise(F.col("purity")),
            **{f"m_{c}": F.when(here, F.col(f"b_{c}")).otherwise(F.col(f"m_{c}")) for c in ("n", "labelled", "bad")},
        }).drop("g", "next", "b_n", "b_labelled", "b_bad", "here")
    return out.select("host", "gens", F.when(F.col("branch") == "", "/").otherwise(F.col("branch")).alias("template"), F.col("m_labelled").alias("labelled"), F.col("m_bad").alias("bad"), "purity")


def url_filter(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url",
    min_children: int = 8, rare: float = 0.1, z: float = 1.96, k: float = 10.0, reject: float = 0.8, min_urls: int = 20, levels: int = LEVELS,
) -> DataFrame:
    """(id, host, path, rule, verdict, template, labelled, bad, purity): one row for each row of pages."""
    url = F.col(url_col).cast("string")
    seen = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    host, path = F.col("host"), F.col("path")
    seen = seen.select("id", "host", "path", _longest(rules, host, path, lambda r: r[1] + r[2]).alias("rule"), _longest(rules, host, path, lambda r: r[0]).alias("by_rule"), _segments(path, levels).alias("segs"))
    paths = materialise(seen.groupBy("host", "segs").agg(F.count("*").alias("n"), F.count("by_rule").alias("labelled"), F.count_if(F.col("by_rule") == "block").alias("bad")))
    depth = paths.agg(F.max(F.size("segs")).alias("d")).head().d or 0
    named = _generalised(paths, depth, min_children, rare)
    shapes = materialise(named.groupBy("host", "gens").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")))
    lookup = materialise(named.select("host", "segs", "gens").join(_judged(shapes, depth, z, k, min_urls), ["host", "gens"]).drop("gens"))
    by_template = F.when(F.col("purity") >= reject, "block").otherwise("allow")
    return seen.join(lookup, ["host", "segs"], "left").select(
        F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("by_rule", by_template).alias("verdict"), "template", "labelled", "bad", "purity",
    )
