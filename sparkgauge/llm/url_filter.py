"""URL filters: rules first, then a tree of path templates for each host.

The segments of a path become a template: numbers, hexadecimal strings and other codes turn into wildcards. Level by
level from the root, the branches under a node are merged into ``*`` where their labelled bad share doesn't differ from
the node's by more than chance. Labels come from the pages themselves (``bad_page``), so every template with a page that
has a text is labelled, whether a rule fits it or not. A template whose smoothed labelled purity is too low is rejected. All
statistics are sums over aggregated templates, so a host with any share of the pages is as spread out as others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgauge.llm.common import cut, table
from sparkgauge.llm.decontaminate import LOWER, UPPER

#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Standard errors up to which a branch is like its node.
Z = 1.96
#: Rows that the prior counts for, its purity, and the purity under which a template is rejected.
PRIOR_ROWS, PRIOR_PURITY, MIN_PURITY = 5.0, 0.8, 0.5

#: A page with fewer words of text than this, or with one of these words, is labelled as bad.
MIN_WORDS, BAD_WORDS = 50, ("casino", "bets", "pills", "viagra", "poker", "lottery")


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; of rules of equal length the one given last; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule, verdict = F.when(fits, rule_host + rule_path).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def bad_page(html: Column) -> Column:
    """1 if a page's text (without scripts, styles, comments and tags) is short or has a bad word, else 0; null without a page."""
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^<>]*>", " ")
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return F.when(html.isNotNull(), ((words < MIN_WORDS) | text.rlike(rf"(?i)\b({'|'.join(BAD_WORDS)})\b")).cast("int"))


def template_of(path: Column) -> Column:
    """The path's segments, variable ones as wildcards."""
    segments = F.filter(F.split(path, "/", -1), lambda s: s != "")

    def general(s: Column) -> Column:
        dot = F.regexp_extract(s, r"(\.[A-Za-z]{1,5})$", 1)
        bare = F.regexp_replace(s, r"\.[A-Za-z]{1,5}$", "")
        kind = (
            F.when(bare.rlike(r"^[0-9]+$"), "{n}")
            .when(bare.rlike(r"^[0-9a-fA-F-]{8,}$") & bare.rlike("[0-9]"), "{h}")
            .when(bare.rlike("[0-9]"), F.regexp_replace(bare, "[0-9]+", "{n}"))
            .when(F.length(bare) > 32, "{w}")
            .otherwise(bare)
        )
        return F.concat(kind, dot)

    return F.transform(segments, general)


def _merge_level(tree: DataFrame, level: int) -> DataFrame:
    """``tree`` (host, first, at, n, labelled, bad) with the branches of ``level`` merged where they are alike."""
    keyed = tree.withColumn("_node", F.concat_ws("/", F.slice("at", 1, level))).withColumn("_branch", F.get("at", F.lit(level)))
    branches = keyed.filter("_branch is not null").groupBy("host", "_node", "_branch").agg(
        *[F.sum(c).alias(c) for c in ("n", "labelled", "bad")]
    )
    nodes = branches.groupBy("host", "_node").agg(
        F.count(F.lit(1)).alias("_width"), F.sum("labelled").alias("_labelled"), F.sum("bad").alias("_bad")
    )
    share = (F.col("_bad") + PRIOR_ROWS * (1 - PRIOR_PURITY)) / (F.col("_labelled") + PRIOR_ROWS)
    own = (F.col("bad") + PRIOR_ROWS * (1 - PRIOR_PURITY)) / (F.col("labelled") + PRIOR_ROWS)
    error = F.sqrt(share * (1 - share) * (1 / (F.col("labelled") + PRIOR_ROWS) + 1 / (F.col("_labelled") + PRIOR_ROWS)))
    alike = branches.join(nodes.filter(F.col("_width") > 1), ["host", "_node"]).filter(F.abs(own - share) <= Z * error)
    merged = keyed.join(alike.select("host", "_node", "_branch", F.lit(True).alias("_alike")), ["host", "_node", "_branch"], "left")
    star = F.transform("at", lambda s, i: F.when(F.col("_alike") & (i == level), F.lit("*")).otherwise(s))
    return merged.select("host", "first", F.when(F.col("_alike"), star).otherwise(F.col("at")).alias("at"), "n", "labelled", "bad")


def _branches(tree: DataFrame, level: int) -> bool:
    """Whether any node of ``level`` has more than one row below it, so that it or a deeper one can have branches."""
    below = tree.filter(F.size("at") > level).groupBy("host", F.slice("at", 1, level).alias("_node")).agg(F.count(F.lit(1)).alias("_rows"))
    return not below.filter("_rows > 1").isEmpty()


def template_purity(pages: DataFrame) -> DataFrame:
    """(host, first, template, purity): the merged template of each template ``first`` of a host. ``pages`` has host,
    first (the template as text), at (its segments) and bad (1, 0, or null without a label)."""
    tree = pages.groupBy("host", "first").agg(
        F.first("at").alias("at"), F.count(F.lit(1)).alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")
    )
    tree, level = cut(tree, "url-tree"), 0
    while _branches(tree, level):
        tree, level = cut(_merge_level(tree, level), "url-tree"), level + 1
    tree = tree.withColumn("template", F.concat(F.lit("/"), F.concat_ws("/", "at")))
    sums = tree.groupBy("host", "template").agg(F.sum("labelled").alias("_labelled"), F.sum("bad").alias("_bad"))
    purity = (F.col("_labelled") - F.col("_bad") + PRIOR_ROWS * PRIOR_PURITY) / (F.col("_labelled") + PRIOR_ROWS)
    return cut(tree.join(sums, ["host", "template"]).select("host", "first", "template", purity.alias("purity")), "url-purity")


def judge_urls(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", bad: Column | None = None) -> DataFrame:
    """(id, host, path, rule, verdict, template, purity): one row per row of ``pages``.

    A page that a rule fits has the rule's verdict; any other is blocked if the purity of its template is under
    MIN_PURITY. Labels are ``bad`` (1, 0 or null, by any columns of ``pages``), by default the rules' own verdicts. A
    template without labels has the prior's purity. A null url, or one without ``://``, has an empty host and path; null
    ids and repeated rows are judged like others, and each repeated row counts. Urls of any length are read whole; further
    columns of any name aren't looked at; an empty table gives an empty one.
    """
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), (bad if bad is not None else F.lit(None)).cast("int").alias("_given"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    at = template_of(F.col("path"))
    rows = rows.withColumns({"rule": rule, "_verdict": verdict, "at": at}).withColumn("first", F.concat_ws("/", "at"))
    label = F.col("_given") if bad is not None else F.when(F.col("_verdict").isNotNull(), (F.col("_verdict") == "block").cast("int"))
    purity = template_purity(rows.select("host", "first", "at", label.alias("bad")))
    judged = rows.join(purity, ["host", "first"], "left")
    method = F.when(F.coalesce("purity", F.lit(PRIOR_PURITY)) < MIN_PURITY, "block").otherwise("allow")
    return judged.select("id", "host", "path", "rule", F.coalesce("_verdict", method).alias("verdict"), "template", "purity")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url", "html"), bad=bad_page(F.col("html")))
    return found.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")
