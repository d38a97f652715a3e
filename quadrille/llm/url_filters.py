"""URL filters by rules and a path-template tree (native).

Digits, long hexadecimal runs and slugs (segments of four words or more) of a path are generalised, which leaves few
templates for each host.  The templates of a host form a tree.  From the root down, to the end of the longest path, the
branches of a node whose labelled share of bad pages doesn't differ significantly from the node's, or that have too few
labels to tell, are merged into a wildcard; a path alone in its node keeps the rest as it is.  A template is rejected if
its share of bad labelled pages, smoothed towards its host's and the corpus's, is high enough.  Explicit rules come
before the tree.

Everything after the first grouping works on templates, not pages, and each level of the tree is made by groupings with
partial sums and look-ups in which no host is hot, so neither a third of all pages nor of all templates on one host
meets in one task.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is judged with the
others of the empty host.  Repeated rows are judged each.  Without labels nothing is rejected.  An empty table gives an
empty result.  Other columns of the input are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import look_up, materialise, whole
from quadrille.llm.licenses import LOWER, UPPER

#: Rules as (verdict, host and path).
Rules = list[tuple[str, str]]
#: Branches differ significantly beyond so many standard errors, corrected for whole numbers.
ERRORS = 2.0
#: Labelled pages that the smoothing counts for; least number and bad share of a rejected template.
SMOOTH, LEAST_LABELS, LEAST_BAD = 4.0, 5, 0.6


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(whole(url), r"(?s)://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(whole(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def template_of(path: Column) -> Column:
    """The path with numbers, long hexadecimal runs and slugs replaced, cut into its segments."""
    general = F.regexp_replace(F.regexp_replace(path, r"\b(?=[0-9a-fA-F-]*[0-9])[0-9a-fA-F-]{12,}\b", "{x}"), "[0-9]+", "{n}")
    slugs = F.regexp_replace(general, r"(?<=^|/)[^/._-]+(?:[_-]+[^/._-]+){3,}", "{s}")
    return F.split(F.regexp_replace(slugs, "^/+", ""), "/", -1)


def rule_for(host: Column, path: Column, rules: Rules) -> Column:
    """The longest rule that fits, as struct(rule, verdict), or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda x: len(x[1])):
        where, sep, rest = rule.partition("/")
        fits = ((host == where) | host.endswith("." + where)) & path.startswith(sep + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _counts(urls: DataFrame, url_col: str, n: Column, labelled: Column, bad: Column) -> DataFrame:
    url = F.col(url_col)
    return urls.groupBy(host_of(url).alias("host"), template_of(path_of(url)).alias("parts")).agg(F.sum(n).alias("n"), F.sum(labelled).alias("labelled"), F.sum(bad).alias("bad"))


def templates(pages: DataFrame, labelled: DataFrame, url_col: str = "url") -> DataFrame:
    """host, parts, merged, n, rejected: every generalised path with its template after merging, and the verdict on it.

    ``labelled`` has columns url and bad (0 or 1).
    """
    zero = F.lit(0).cast("long")
    there = _counts(pages, url_col, F.lit(1), zero, zero)
    known = _counts(labelled.where("bad IS NOT NULL"), "url", zero, F.lit(1), F.col("bad").cast("long"))
    tree = there.unionByName(known).groupBy("host", "parts").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "bad")])
    tree = materialise(tree, "templates").withColumn("merged", F.lit(""))
    tree = tree.withColumn("path", F.concat_ws("/", "parts"))
    done, level, deeper = [], 0, True
    while deeper:
        # A host has no slash and a template begins with one, so the two together name a node, and with the branch a branch.
        tree = tree.withColumn("__node", F.concat("host", "merged")).withColumn("branch", F.coalesce(F.get("parts", F.lit(level)), F.lit("")))
        tree = tree.withColumn("__branch", F.concat_ws("//", "__node", "branch"))
        branches = materialise(tree.groupBy("__node", "branch", "__branch").agg(F.count(F.lit(1)).alias("paths"), *[F.sum(c).alias(f"own_{c}") for c in ("labelled", "bad")]), "branches")
        nodes = branches.groupBy("__node").agg(F.count(F.lit(1)).alias("branches"), F.sum("paths").alias("all_paths"), (F.sum("own_bad") / F.greatest(F.sum("own_labelled"), F.lit(1))).alias("share"))
        known = look_up(branches, "__node", materialise(nodes, "nodes"), "branches", branches.count(), "__branch")
        expected = F.col("share") * F.col("own_labelled")
        alike = F.abs(F.col("own_bad") - expected) - 0.5 <= ERRORS * F.sqrt(expected * (1 - F.col("share")))
        wild = (F.col("branches") > 1) & (F.col("branch") != "") & ((F.col("own_labelled") < LEAST_LABELS) | alike)
        known = materialise(known.select("__branch", "paths", wild.alias("wild"), (F.col("all_paths") == 1).alias("alone")), "branches")
        tree = look_up(tree, "__branch", known, "paths", tree.count(), "path")
        step = F.when(F.col("branch") == "", "").otherwise(F.concat(F.lit("/"), F.when(F.col("wild"), "*").otherwise(F.col("branch"))))
        ends = F.concat_ws("", F.transform(F.filter(F.slice("parts", F.lit(level + 1), F.greatest(F.size("parts") - level, F.lit(0))), lambda x: x != ""), lambda x: F.concat(F.lit("/"), x)))
        tree = tree.withColumn("merged", F.concat("merged", F.when(F.col("alone"), ends).otherwise(step)))
        tree = tree.withColumn("more", F.when(F.col("alone"), -1).otherwise(F.size("parts") - level - 1))
        tree = materialise(tree.drop("__node", "__branch", "branch", "paths", "wild", "alone"), "templates")
        deeper = not tree.where("more > 0").isEmpty()
        done.append(tree.where("more < 0") if deeper else tree)
        tree, level = tree.where("more >= 0"), level + 1
    tree = materialise(reduce(DataFrame.unionByName, done).drop("more", "path"), "templates")
    start = tree.agg(F.sum("bad"), F.sum("labelled")).first()
    everywhere = (start[0] or 0) / max(1, start[1] or 0)
    hosts = tree.groupBy("host").agg(F.sum("bad").alias("host_bad"), F.sum("labelled").alias("host_labelled"), F.count(F.lit(1)).alias("__rows"))
    merged = tree.groupBy("host", "merged").agg(F.sum("bad").alias("all_bad"), F.sum("labelled").alias("all_labelled"), F.count(F.lit(1)).alias("paths"))
    merged = materialise(merged.withColumn("template", F.concat("host", "merged")), "merged")
    at_host = (F.col("host_bad") + SMOOTH * everywhere) / (F.col("host_labelled") + SMOOTH)
    purity = (F.col("all_bad") + SMOOTH * at_host) / (F.col("all_labelled") + SMOOTH)
    known = look_up(merged, "host", materialise(hosts, "hosts"), "__rows", merged.count(), "template")
    judged = known.select("template", "paths", ((F.col("all_labelled") >= LEAST_LABELS) & (purity >= LEAST_BAD)).alias("rejected"))
    out = look_up(tree.withColumn("template", F.concat("host", "merged")), "template", materialise(judged, "judged"), "paths", tree.count(), "parts")
    return out.drop("template", "paths")


def judge(pages: DataFrame, rules: Rules, labelled: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: page_id, host, path, rule, verdict."""
    pages = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    gone = templates(pages, labelled).where("rejected").select(_key(F.col("host"), F.col("parts")).alias("key"), F.col("n").alias("pages"))
    gone = materialise(gone, "rejected")
    total = gone.agg(F.sum("pages")).first()[0] or 0
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    parsed = parsed.withColumn("key", _key(F.col("host"), template_of(F.col("path")))).withColumn("found", rule_for(F.col("host"), F.col("path"), rules))
    joined = look_up(parsed, "key", gone, "pages", total, "page_id")
    verdict = F.coalesce(F.col("found.verdict"), F.when(F.col("pages").isNotNull(), "block").otherwise("allow"))
    return joined.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"))


def _key(host: Column, parts: Column) -> Column:
    return F.concat_ws("/", host, F.concat_ws("/", parts))
