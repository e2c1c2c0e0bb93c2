"""URL filters (operator 4): rules indexed by their rarest literal token, DataFrame functions only.

A rule is a regular expression over ``host + path`` with the literal tokens that every match contains.
Token frequencies come from the URLs themselves; each rule is filed under its rarest token. A URL's
tokens fetch the rules filed under them, and only those run their expression.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules travel to all executors as one broadcast table up to this many; more are joined by shuffle.
BROADCAST_RULES = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``name`` is reported; ``pattern`` is a Java expression that ``tokens`` occur in; the highest ``weight`` wins."""

    name: str | None
    pattern: str
    tokens: tuple[str, ...]
    verdict: str
    weight: int


def host_rule(verdict: str, rule: str) -> Rule:
    """``host/path``: fits the host and its subdomains, and paths that start with the rule's; longer wins."""
    host, slash, rest = rule.partition("/")
    path = slash + rest
    whole = path.split("/")[1:-1]  # the last segment may go on in a URL, so it is no token
    pattern = r"(?s)^(?:[^/]*\.)?" + "".join(rf"\Q{x}\E" for x in (host, path) if x) + ("" if path else "(?:/.*)?$")
    return Rule(rule, pattern, tuple(x for x in [*host.split("."), *whole] if x), verdict, 1000 + len(rule))


def word_rule(word: str) -> Rule:
    """Block URLs that hold the word, in any case, between characters that aren't letters or digits."""
    return Rule(None, rf"(?si)(?:^|[^a-z0-9]){re.escape(word)}(?:$|[^a-z0-9])", (word,), "block", 1)


#: The rules of the query's contract.
CONTRACT = [host_rule("allow", "com/"), host_rule("block", "example.com/en/"), host_rule("allow", "www.example.com/en/"), host_rule("block", "net/es/"), host_rule("block", "net/fr/")]
#: The filter's own words: where no host rule fits, these decide; a URL that none fits is allowed.
WORDS = [word_rule(w) for w in ("casino", "porn", "xxx", "viagra", "malware", "phishing", "torrent", "warez")]


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(host: Column, path: Column) -> Column:
    """Host labels, path segments and runs of letters and digits, each once."""
    low = F.translate(path, UPPER, LOWER)
    return F.array_distinct(F.concat(F.split(host, r"\."), F.split(path, "/"), F.split(F.concat_ws("/", host, low), "[^a-z0-9]+")))


def rule_index(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """token, rule fields: each rule under the token of its own that fewest URLs hold (ties: the first by name).

    ``urls`` has an array column ``tokens``. At most one count for each token of a rule reaches the
    driver, so its size is bound by the rules. A rule without tokens can't be filed and is refused.
    """
    spark = urls.sparkSession
    if bare := [r for r in rules if not r.tokens]:
        raise ValueError(f"rules without a literal token: {bare}")
    known = sorted({t for r in rules for t in r.tokens})
    wanted = F.filter("tokens", lambda t: t.isin(known))
    seen = {r["token"]: r["n"] for r in urls.select(F.explode(wanted).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = [(min(r.tokens, key=lambda t: (seen.get(t, 0), t)), r.name, r.pattern, r.verdict, r.weight) for r in rules]
    return spark.createDataFrame(rows, "token string, rule string, pattern string, verdict string, weight int")


def judge_urls(pages: DataFrame, rules: list[Rule], *, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (null where none with a name fits) and verdict of every page.

    Of the rules that fit, the heaviest wins, ties to the greater name. A null url, or one
    without ``://``, has an empty host and path, and gets the default unless a rule fits that. Repeated
    rows stay repeated; extra columns go. Rows are grouped by page and url once: the verdicts come back
    by the same grouping, so the rules cost no second shuffle, and a token that a third of the URLs
    hold meets the broadcast side of its join.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    cut = p.groupBy("page_id", "url").agg(F.count(F.lit(1)).alias("copies")).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    index = rule_index(p.select(url_tokens(host_of(F.col("url")), path_of(F.col("url"))).alias("tokens")), rules)
    if len(rules) <= BROADCAST_RULES:
        index = F.broadcast(index)
    filed = sorted({t for r in rules for t in r.tokens})
    tokens = url_tokens(F.col("host"), F.col("path"))
    if len(filed) <= 1000:  # a short list of literals drops the other tokens before they become rows
        tokens = F.filter(tokens, lambda t: t.isin(filed))
    fetched = cut.withColumn("token", F.explode_outer(tokens)).join(index, "token", "left")
    fits = F.col("pattern").isNotNull() & F.expr("concat(host, path) rlike pattern")
    best = F.max(F.when(fits, F.struct("weight", "rule", "verdict"))).alias("best")
    judged = fetched.groupBy("page_id", "url").agg(best, F.max("copies").alias("copies"), F.max("host").alias("host"), F.max("path").alias("path"))
    return judged.select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")
    ).drop("copy")
