"""URL filter: explicit host/path rules, then a path-template tree per host whose templates are judged by labelled purity.

Templates: every path is cut into segments; segments that are numbers, hashes or dates become wildcards at once. Then, level by
level and per host, a child becomes a wildcard if it is one of many rare children of its node, or if its labelled share of bad
pages is statistically the same as that of its labelled siblings. Pages of equal template are one branch. A template is
rejected if its smoothed share of bad pages among its labelled pages reaches the threshold. It is smoothed towards the share that the
same template has on all hosts together, itself smoothed towards PRIOR, so hosts without labels are judged by what their templates
mean elsewhere. Labels come from a column of the input or, by default, from the rules' own verdicts.

All steps pre-aggregate: the tree is built from counts per distinct host and template, not from pages, and a large host is
spread by its templates. No user functions.

Defined cases: a null url or one without ``://`` has empty host and path and takes part as the empty host's root template;
repeated rows are judged alike; among rules of equal length the first listed wins; an empty table gives an empty table; what a path
has below `depth` segments counts as one last segment, whole; columns of pages named like a column that is made give way. Working
columns carry a leading ``_u_``.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

#: (verdict, host/path), as the production filter has them.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
DEPTH = 4
MANY_CHILDREN = 16
SAME_Z = 1.0
PRIOR, WEIGHT, THRESHOLD = 0.1, 4.0, 0.5
#: Segments that vary from page to page: numbers, long hexadecimal strings, dates.
VARIABLE = r"^([0-9]+|[0-9a-f]{8,}|[0-9]{4}-[0-9]{2}-[0-9]{2})$"


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    get = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    return F.translate(get(1), string.ascii_uppercase, string.ascii_lowercase), get(2)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null if none fits: a rule fits its host and all subdomains."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):  # the longest is tested first: it ends up outermost
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def segments_of(path: Column, depth: int = DEPTH) -> Column:
    """depth + 1 strings: the path's segments, variable ones as ``*``, missing ones empty, and all deeper ones joined."""
    parts = F.split(path, "/")
    bare = F.transform(
        parts,
        lambda s: F.when(F.regexp_replace(s, r"\.[a-z]{1,5}$", "").rlike(VARIABLE), F.lit("*")).otherwise(s),
    )
    return F.array(
        *[F.coalesce(F.get(bare, F.lit(k + 1)), F.lit("")) for k in range(depth)],
        F.array_join(F.slice(bare, depth + 2, F.greatest(F.size(parts), F.lit(1))), "/"),
    )


def template_tree(pages: DataFrame, depth: int = DEPTH) -> DataFrame:
    """_u_host, _u_segments (as written), _u_template, _u_purity: one row for each distinct host and list of segments.

    pages has _u_host, _u_segments (depth + 1 of them), _u_bad (1, 0 or null).
    """
    df = pages.groupBy("_u_host", "_u_segments").agg(
        F.count(F.lit(1)).alias("_u_n"), F.count("_u_bad").alias("_u_labelled"), F.sum(F.coalesce("_u_bad", F.lit(0))).alias("_u_bad")
    )
    df = materialise(df.withColumn("_u_template", F.lit("")), "templates")
    sums = [F.sum(c).alias(c) for c in ("_u_n", "_u_labelled", "_u_bad")]
    for level in range(depth + 1):
        before = df
        df = df.withColumn("_u_segment", F.get("_u_segments", F.lit(level)))
        children = df.groupBy("_u_host", "_u_template", "_u_segment").agg(*sums)
        node = children.groupBy("_u_host", "_u_template").agg(
            F.count(F.lit(1)).alias("_u_children"), *[F.sum(c).alias(c + "_all") for c in ("_u_n", "_u_labelled", "_u_bad")]
        )
        said = children.join(node, ["_u_host", "_u_template"])
        rest, bad_rest = F.col("_u_labelled_all") - F.col("_u_labelled"), F.col("_u_bad_all") - F.col("_u_bad")
        pooled = F.try_divide(F.col("_u_bad_all").cast("double"), F.col("_u_labelled_all"))
        gap = F.abs(F.try_divide(F.col("_u_bad").cast("double"), F.col("_u_labelled")) - F.try_divide(bad_rest.cast("double"), rest))
        noise = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), F.col("_u_labelled")) + F.try_divide(F.lit(1.0), rest)))
        same = F.coalesce(gap <= SAME_Z * noise, F.lit(False))
        rare = (F.col("_u_children") >= MANY_CHILDREN) & (F.col("_u_n") * F.col("_u_children") <= 4 * F.col("_u_n_all"))
        wild = (F.col("_u_segment") != "") & (rare | same)
        said = said.select("_u_host", "_u_template", "_u_segment", F.when(wild, F.lit("*")).otherwise(F.col("_u_segment")).alias("_u_step"))
        df = df.join(said, ["_u_host", "_u_template", "_u_segment"])
        df = df.withColumn("_u_template", F.concat("_u_template", F.lit("/"), "_u_step")).drop("_u_step", "_u_segment")
        df = materialise(df, "templates")  # each level reads the one before three times
        discard(before)
    own = df.groupBy("_u_host", "_u_template").agg(F.sum("_u_bad").alias("_u_bad"), F.sum("_u_labelled").alias("_u_labelled"))
    anywhere = own.groupBy("_u_template").agg(
        ((F.sum("_u_bad") + F.lit(PRIOR * WEIGHT)) / (F.sum("_u_labelled") + F.lit(WEIGHT))).alias("_u_anywhere")
    )
    smoothed = (F.col("_u_bad") + F.col("_u_anywhere") * F.lit(WEIGHT)) / (F.col("_u_labelled") + F.lit(WEIGHT))
    purity = own.join(anywhere, "_u_template").select("_u_host", "_u_template", smoothed.alias("_u_purity"))
    return df.select("_u_host", "_u_segments", "_u_template").join(purity, ["_u_host", "_u_template"])


def judge_urls(pages: DataFrame, url: str = "url", rules: Sequence[tuple[str, str]] = RULES, bad: str | None = None, depth: int = DEPTH) -> DataFrame:
    """pages with host, path, rule, template, purity, verdict. bad: a column of labels (1 bad, 0 good, null unknown). depth: levels of the tree."""
    host, path = host_and_path(F.col(url))
    df = pages.withColumns({"_u_host": host, "_u_path": path})
    rule, verdict = rule_of(F.col("_u_host"), F.col("_u_path"), rules)
    df = df.withColumns({"_u_rule": rule, "_u_verdict": verdict, "_u_segments": segments_of(F.col("_u_path"), depth)})
    label = F.col(bad).cast("int") if bad else F.when(F.col("_u_verdict") == "block", 1).when(F.col("_u_verdict") == "allow", 0)
    tree = template_tree(df.select("_u_host", "_u_segments", label.alias("_u_bad")), depth)
    df = df.join(tree, ["_u_host", "_u_segments"], "left")
    own = F.when(F.col("_u_purity") >= THRESHOLD, F.lit("block")).otherwise(F.lit("allow"))
    made = {"host": "_u_host", "path": "_u_path", "rule": "_u_rule", "template": "_u_template", "purity": "_u_purity"}
    return df.select(
        *[F.col(f"`{c}`") for c in pages.columns if c not in {*made, "verdict"}],
        *[F.col(v).alias(k) for k, v in made.items()],
        F.coalesce("_u_verdict", own).alias("verdict"),
    )
