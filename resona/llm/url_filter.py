"""URL filters: pattern rules found through their rarest literal token.

A rule is a pattern over a url without its scheme, with ``||`` for the start of the host or of one
of its parent domains, ``^`` for one separator or the end, ``*`` for anything, and all else
literal.  The runs of a-z0-9 of a pattern that end at a separator on both sides are tokens of every
url that it fits; the one in the fewest urls is the rule's key.  The tokens of a url fetch the
rules with these keys, and only these rules' regular expressions run on it.  All is DataFrame
functions; distinct urls are judged once and joined back.

Cases: a url that is null or has no ``://`` has an empty host and path and fits no rule; of two
rules of equal length that fit, the greater text wins; repeated rows are judged alike; other
columns stay, and clashing ones give way; a null page_id is kept; a url of any length is judged whole;
an empty table gives none.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import lookup, table

#: Host and path rules; the longest that fits wins (fixed values).
HOST_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: The method's own patterns, asked where no host rule fits; the longest that fits wins, else DEFAULT.
PATTERNS = (
    ("||ads.", "block"),
    ("||adserver.", "block"),
    ("||tracker.", "block"),
    ("/ads/", "block"),
    ("/banners/", "block"),
    ("/casino/", "block"),
    ("/wp-login.php", "block"),
    ("/cgi-bin/", "block"),
    ("^phpsessid=", "block"),
    ("^sessionid=", "block"),
    ("^malware^", "block"),
    ("^phishing^", "block"),
    ("/robots.txt^", "allow"),
    ("/ads/*/opt-out^", "allow"),
)
DEFAULT = "allow"


def pattern_tokens(pattern: str) -> list[str]:
    """The literal tokens that every url which the pattern fits has."""
    body = pattern.removeprefix("||")
    anchored = pattern.startswith("||")
    found = []
    for m in re.finditer(r"[a-z0-9]+", body.lower()):
        left = m.start() > 0 and body[m.start() - 1] != "*" or m.start() == 0 and anchored
        right = m.end() < len(body) and body[m.end()] != "*"
        if left and right:
            found.append(m[0])
    return found


def pattern_regex(pattern: str, folded: bool) -> str:
    start = r"^(?:[^/?#]*\.)?" if pattern.startswith("||") else ""
    parts = {"*": ".*", "^": r"(?:[^a-zA-Z0-9_.%-]|$)"}
    return ("(?i)" if folded else "") + start + "".join(parts.get(c) or re.escape(c) for c in pattern.removeprefix("||"))


def split_url(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and all after the scheme, with A-Z of the host lower-cased."""
    known = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    after = F.when(known, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    host = F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    rest = F.regexp_extract(after, r"(?s)^[^/?#]*(.*)$", 1)
    return host, path, F.concat(host, rest)


def rule_table(spark: SparkSession, host_rules=HOST_RULES, patterns=PATTERNS) -> DataFrame:
    """(rule, tier, length, verdict, regex, tokens); tier 1: host rules, 0: patterns."""
    rows = [(rule, 1, len(rule), verdict, pattern_regex("||" + rule, False), pattern_tokens("||" + rule)) for rule, verdict in host_rules]
    rows += [(rule, 0, len(rule), verdict, pattern_regex(rule, True), pattern_tokens(rule)) for rule, verdict in patterns]
    if bare := [r[0] for r in rows if not r[5]]:
        raise ValueError(f"patterns without a literal token: {bare}")
    return spark.createDataFrame(rows, "rule string, tier int, length int, verdict string, regex string, tokens array<string>")


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, url: str = "url") -> DataFrame:
    """The rows with host, path, rule, pattern and verdict."""
    # the columns that stay are packed away, so that none clashes with those of the work
    new = ("host", "path", "rule", "pattern", "verdict")
    named = [F.col(f"`{c}`") for c in pages.columns]
    keyed = pages.select(F.struct(*named).alias("row"), F.col(url).alias("url"), F.coalesce(F.col(url), F.concat(F.lit("\0"), F.xxhash64(*named).cast("string"))).alias("at"))
    held = keyed.select(F.col("url").alias("_url")).where("_url is not null").distinct()
    subject = split_url(F.col("_url"))[2]
    held = held.select("_url", subject.alias("subject"))
    words = F.array_distinct(F.filter(F.split(F.lower("subject"), "[^a-z0-9]+"), lambda t: t != ""))
    tokens = held.select("_url", "subject", F.explode(words).alias("token"))
    wanted = rules.select("rule", "tier", F.explode("tokens").alias("token"))
    names = wanted.select("token").distinct()
    n_rules = rules.count()
    common = lookup(tokens.select("token"), names.withColumnRenamed("token", "_t"), F.col("token") == F.col("_t"), "left_semi", rows=n_rules * 8).groupBy("token").agg(F.count("*").alias("urls"))
    rarest = wanted.join(common, "token", "left").groupBy("rule", "tier").agg(F.min_by("token", F.struct(F.coalesce("urls", F.lit(0)), "token")).alias("_key"))
    index = rules.join(rarest, ["rule", "tier"]).select("_key", "rule", "tier", "length", "verdict", "regex")
    fits = lookup(tokens, index, F.col("token") == F.col("_key"), rows=n_rules).where("subject rlike regex")
    best = fits.groupBy("_url").agg(F.max(F.struct("tier", "length", "rule", "verdict")).alias("_best"))
    host, path, _ = split_url(F.col("url"))
    rule = lambda tier: F.when(F.col("_best.tier") == tier, F.col("_best.rule"))
    made = (host, path, rule(1), rule(0), F.coalesce("_best.verdict", F.lit(default)))
    kept = (F.col("row").getField(c).alias(c) for c in pages.columns if c not in new)
    return keyed.join(best, keyed["at"] == best["_url"], "left").select(*kept, *(c.alias(k) for k, c in zip(new, made, strict=True)))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


def _pattern_sql() -> str:
    cases = sorted(PATTERNS, key=lambda p: (len(p[0]), p[0]), reverse=True)
    return "case " + " ".join(f"when regexp_matches(subject, '{pattern_regex(p, True)}') then '{v}'" for p, v in cases) + f" else '{DEFAULT}' end"


SQL = (
    r"""
with u as (
  select page_id, case when contains(url, '://') then substr(url, position('://' in url) + 3) else '' end as a from pages
), p as (
  select page_id, translate(regexp_extract(a, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(a, '^[^/?#]*([^?#]*)', 1) as path, regexp_extract(a, '(?s)^[^/?#]*(.*)$', 1) as rest
  from u
), r(rule, rhost, rpath, v) as (values """
    + ", ".join(f"('{rule}', '{rule.split('/', 1)[0]}', '/{rule.split('/', 1)[1]}', '{v}')" for rule, v in HOST_RULES)
    + r"""), f as (
  select p.*, host || rest as subject,
         (select arg_max({'rule': rule, 'v': v}, length(rule)) from r where (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)) as best
  from p
)
select page_id, host, path, best.rule as rule, coalesce(best.v, """
    + _pattern_sql()
    + ") as verdict from f"
)
