"""URL filters: host rules by longest match, pattern rules found through their rarest token.

Pattern rules are indexed by the literal token that fewest URLs contain. URL tokens fetch
candidate rules by an equality join, and only those run their regular expression. DataFrame
operations only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

TOKEN = "[^A-Za-z0-9]+"


@dataclass(frozen=True)
class HostRule:
    """``rule`` is host and path in one, like ``example.net/en/``."""

    rule: str
    verdict: str


@dataclass(frozen=True)
class PatternRule:
    """``pattern`` runs on the whole URL in lower case; ``literals`` are tokens that every match contains."""

    name: str
    verdict: str
    pattern: str
    literals: tuple[str, ...]


HOST_RULES = (
    HostRule("net/", "block"),
    HostRule("example.net/en/", "allow"),
    HostRule("example.com/de/", "block"),
    HostRule("org/fr/", "allow"),
)

# Hosts that sell through spam, and tracking paths.
PATTERN_RULES = (
    PatternRule("casino", "block", r"^[a-z]+://([^/?#]*[.-])?casino-[^/?#]*", ("casino",)),
    PatternRule("pills", "block", r"^[a-z]+://([^/?#]*[.-])?cheap-pills\.[^/?#]*", ("cheap", "pills")),
    PatternRule("spam farm", "block", r"^[a-z]+://([^/?#]*[.-])?spam-farm\.[^/?#]*", ("spam", "farm")),
    PatternRule("ad tracker", "block", r"^[a-z]+://([^/?#]*[.-])?ads-track\.[^/?#]*", ("ads", "track")),
    PatternRule("click tracker", "block", r"^[a-z]+://[^/?#]*/click\?.*[?&]redirect=", ("click", "redirect")),
    PatternRule("own search", "allow", r"^[a-z]+://search\.casino-museum\.[^/?#]*", ("search", "casino", "museum")),
)
DEFAULT = "allow"


def split_url(pages: DataFrame) -> DataFrame:
    """Adds ``host`` (A-Z lowered) and ``path``; both are empty for a null URL or one without ``://``."""
    rest = F.when(F.instr("url", "://") > 0, F.substring("url", F.instr("url", "://") + 3, F.length("url"))).otherwise("")
    host = F.translate(F.regexp_extract("__rest", r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract("__rest", r"^[^/?#]*([^?#]*)", 1)
    return pages.withColumn("__rest", F.coalesce(rest, F.lit(""))).withColumns({"host": host, "path": path}).drop("__rest")


def host_rule(rules=HOST_RULES) -> dict[str, F.Column]:
    """``rule`` and ``rule_verdict`` of the longest host rule that fits, as column expressions.

    A handful of rules is one ``case`` in order of length; no join is needed.
    """
    rule = verdict = None
    for r in sorted(rules, key=lambda r: (-len(r.rule), r.rule)):
        host, slash, path = r.rule.partition("/")
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(slash + path))
        rule = F.when(fits, r.rule) if rule is None else rule.when(fits, r.rule)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    nothing = F.lit(None).cast("string")
    return {"rule": nothing if rule is None else rule, "rule_verdict": nothing if verdict is None else verdict}


def _tokens(urls: DataFrame) -> DataFrame:
    return urls.select("url", F.explode(F.array_distinct(F.split(F.lower("url"), TOKEN))).alias("token")).where("token <> ''")


def pattern_index(urls: DataFrame, rules=PATTERN_RULES) -> DataFrame:
    """One row per rule with the literal that fewest of ``urls`` contain (ties: the first in order).

    A token that no URL has is the rarest of all: its rule can match nothing and costs nothing.
    """
    spark: SparkSession = urls.sparkSession
    listed = spark.createDataFrame(
        [(r.name, r.verdict, r.pattern, i, t) for r in rules for i, t in enumerate(r.literals)],
        "name string, rule_verdict string, pattern string, place int, token string",
    )
    counted = _tokens(urls).join(listed.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return (
        listed.join(counted, "token", "left")
        .groupBy("name", "rule_verdict", "pattern")
        .agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), F.col("place"))).alias("token"))
    )


def pattern_verdict(urls: DataFrame, rules=PATTERN_RULES) -> DataFrame:
    """``url``, ``matched`` (rule names in order) and ``pattern_verdict`` for URLs that any rule matches.

    An allow rule outranks block rules. Rows with equal URLs are judged once.
    """
    index = pattern_index(urls, rules)
    hits = _tokens(urls).join(index, "token").where(F.expr("lower(url) rlike pattern"))
    return hits.groupBy("url").agg(
        F.array_join(F.sort_array(F.collect_set("name")), ",").alias("matched"),
        F.min("rule_verdict").alias("pattern_verdict"),
    )


def judge(pages: DataFrame, host_rules=HOST_RULES, pattern_rules=PATTERN_RULES) -> DataFrame:
    """Adds ``host``, ``path``, ``rule``, ``matched`` and ``verdict`` to every page.

    The longest host rule decides; without one, the pattern rules do; without any, ``allow``.
    Columns of these names are replaced, others pass through; null URLs have no host and are
    allowed. Pages that share an URL, however many, meet that URL's one verdict in a join that
    adaptive execution can split or broadcast.
    """
    made = ("host", "path", "rule", "matched", "verdict", "rule_verdict", "pattern_verdict")
    named = split_url(pages.select(*[F.col(f"`{c}`") for c in pages.columns if c.lower() not in made]))
    urls = pages.select("url").where("url is not null").distinct()
    judged = named.withColumns(host_rule(host_rules)).join(pattern_verdict(urls, pattern_rules), "url", "left")
    verdict = F.coalesce("rule_verdict", "pattern_verdict", F.lit(DEFAULT))
    return judged.withColumn("verdict", verdict).drop("rule_verdict", "pattern_verdict")
