"""URL filters: pattern rules found through their rarest literal token, so only few rules run as regular expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, fresh, materialize, table

#: Fixed rules of the contract: (layer, verdict, rule).
HOST_RULES = (
    (0, "allow", "org/"), (0, "block", "example.org/es/"), (0, "block", "example.org/en/1"), (0, "allow", "com/fr/"), (0, "block", "com/de/"),
)
#: Rules of the method for what no other rule settles: farms, advertisements, gambling, and pages without prose.
PATTERN_RULES = tuple(
    (1, "block", r)
    for r in (
        "spam*/", "*-spam.*/", "*-farm.*/", "ads.*/", "adserver.*/", "*tracker.*/", "*casino*/", "*/*casino", "*/*porn", "*/*viagra",
        "*/wp-login", "*/cart/", "*/checkout/", "*/login", "*/signup", "*/tag/*/page/", "*/*/feed/", "*/*.exe", "*/*.zip",
    )
)
DEFAULT_VERDICT = "allow"
#: Rules that are broadcast at most; more of them are joined by a shuffle.
BROADCAST_RULES = 200_000
#: Characters of a token: ASCII letters and digits, and whatever is not ASCII.
TOKEN = r"0-9A-Za-z\x{80}-\x{10FFFF}"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    """What stands between the first :// and the next of / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ? or # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_table(spark: SparkSession, rules) -> DataFrame:
    """(layer, verdict, rule) of a short list; long lists are read as tables."""
    rows = [F.struct(F.lit(a).alias("layer"), F.lit(v).alias("verdict"), F.lit(r).alias("rule")) for a, v, r in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def rule_regex(rule: Column) -> Column:
    """Regular expression over host and path of a rule host/path.

    The host stands for itself and all its subdomains, the path for all that begin with it, and * for any characters, in
    the host for those of a host.
    """
    quoted = lambda part, star: F.regexp_replace(F.regexp_replace(part, r"([^0-9A-Za-z*/\x{80}-\x{10FFFF}])", r"\\$1"), r"\*", star)
    host, path = F.substring_index(rule, "/", 1), F.expr("substring(rule, locate('/', rule))")
    return F.concat(F.lit(r"(?s)^(?:[^/]*\.)?"), quoted(host, "[^/]*"), quoted(path, ".*"))


def rule_tokens(rule: Column) -> Column:
    """Literal tokens that every URL of a rule holds whole: no token beside a * and not the last one of an open end."""
    return F.array_distinct(F.regexp_extract_all(rule, F.lit(f"(?<![{TOKEN}*])[{TOKEN}]++(?=[^{TOKEN}*])"), F.lit(0)))


def url_tokens(subject: Column) -> Column:
    """Distinct tokens of a URL's host and path, and the empty one, under which rules without a literal token are found."""
    return F.array_distinct(F.concat(F.array(F.lit("")), F.regexp_extract_all(subject, F.lit(f"[{TOKEN}]+"), F.lit(0))))


def rule_index(rules: DataFrame, tokens: DataFrame) -> DataFrame:
    """rules (layer, verdict, rule) with regex and token, the rule's token that the fewest of tokens (token, n) hold.

    Ties go to the lesser token; a token that no URL holds is the rarest of all, and a rule without tokens gets the
    empty one.
    """
    listed = rules.where("rule LIKE '%/%'").distinct()
    each = listed.select("layer", "verdict", "rule", F.explode_outer(rule_tokens(F.col("rule"))).alias("token"))
    counted = each.join(tokens, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    best = counted.groupBy("layer", "verdict", "rule").agg(F.min(F.struct("n", "token"))["token"].alias("token"))
    return best.select("layer", "verdict", "rule", F.coalesce("token", F.lit("")).alias("token"), rule_regex(F.col("rule")).alias("regex"))


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """pages with host, path, layer, rule and verdict of the rule that decides each URL.

    rules: layer int, verdict string, rule string (host/path, see rule_regex); a rule without a / or null is no rule. Of
    the rules that fit, the lowest layer decides, then the longest rule, then the lesser text, then block before allow.
    Where none fits, layer and rule are null and verdict is default. Null and empty URLs and those without :// have an
    empty host and path; no rule fits them. Rows with equal URLs are judged once; a URL that many rows share is one row
    until the last join, whose hot keys are split. Columns of pages called like a result give way to it, and an empty
    table gives no rows. Any number of rules: each is fetched by one token, and only fetched rules run.
    """
    results = ("host", "path", "layer", "rule", "verdict")
    given = [c for c in pages.columns if c.lower() not in results]
    judged = _judged(pages.select(F.col(url_col).alias("_url")), rules)
    key = fresh("_url", pages)
    found = judged.withColumnsRenamed({c: f"_{c}" for c in ("layer", "rule", "verdict")}).withColumnRenamed("_url", key)
    url = F.col("_judged_url")
    return (
        pages.withColumn("_judged_url", F.col(url_col)).join(found, F.col("_judged_url") == F.col(key), "left")
        .select(
            *given, url_host(url).alias("host"), url_path(url).alias("path"), F.col("_layer").alias("layer"),
            F.col("_rule").alias("rule"), F.coalesce("_verdict", F.lit(default)).alias("verdict"),
        )
    )


def _judged(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(_url, layer, rule, verdict) of the different URLs that a rule fits."""
    subject = F.concat(url_host(F.col("_url")), url_path(F.col("_url")))
    different = urls.where("_url IS NOT NULL").distinct().withColumn("subject", subject)
    spread = different.select("_url", "subject", F.explode(url_tokens(F.col("subject"))).alias("token"))
    rules = materialize(rules.select("layer", "verdict", "rule"))
    wanted = rules.select(F.explode(rule_tokens(F.col("rule"))).alias("token")).distinct()
    tokens = spread.join(broadcast_if_small(materialize(wanted), BROADCAST_RULES), "token", "left_semi")
    index = materialize(rule_index(rules, tokens.groupBy("token").agg(F.count("*").alias("n"))))
    met = spread.join(broadcast_if_small(index, BROADCAST_RULES), "token").where(F.regexp_like("subject", F.col("regex")))
    order = F.struct("layer", -F.length("rule"), "rule", (F.col("verdict") != "block").alias("mild"), "verdict")
    best = met.groupBy("_url").agg(F.min(order).alias("b"))
    return best.select("_url", "b.layer", "b.rule", "b.verdict")


def op13_url_rules(spark, sf_dir) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    out = judge_urls(pages, rule_table(spark, HOST_RULES + PATTERN_RULES))
    return out.select(
        "page_id", "host", "path", F.when(F.col("layer") == 0, F.col("rule")).alias("rule"), "verdict",
        F.when(F.col("layer") == 1, F.col("rule")).alias("pattern"),
    )


def _sql() -> str:
    import re

    def regex(rule):
        host, _, path = rule.partition("/")
        wild = lambda part, star: star.join(re.escape(x) for x in part.split("*"))
        return r"(?s)^(?:[^/]*\.)?" + wild(host, "[^/]*") + wild("/" + path, ".*")

    fixed = ", ".join(f"('{v}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for _, v, r in HOST_RULES)
    patterns = ", ".join(f"('{r}', '{regex(r)}')" for _, _, r in PATTERN_RULES)
    return rf"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '{_PARTS}', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
         coalesce(regexp_extract(url, '{_PARTS}', 2), '') AS path, row_number() OVER () AS row
  FROM pages
), fixed(verdict, h, p) AS (VALUES {fixed}), patterns(pattern, regex) AS (VALUES {patterns}), a AS (
  SELECT row, arg_max(h || fixed.p, length(h || fixed.p)) AS rule, arg_max(verdict, length(h || fixed.p)) AS verdict
  FROM p JOIN fixed ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, fixed.p) GROUP BY 1
), b AS (
  SELECT row, first(pattern ORDER BY length(pattern) DESC, pattern) AS pattern
  FROM p JOIN patterns ON regexp_matches(host || path, regex) GROUP BY 1
)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN pattern IS NULL THEN '{DEFAULT_VERDICT}' ELSE 'block' END) AS verdict,
       CASE WHEN rule IS NULL THEN pattern END AS pattern
FROM p LEFT JOIN a USING (row) LEFT JOIN b USING (row)
"""


SQL = _sql()
