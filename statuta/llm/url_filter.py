"""URL filters (operator 4).

A rule is a pattern of literals and marks: `||` is a host or any subdomain of it, `^` a separator (any
character but ASCII letters and digits, or either end), `*` anything. A URL is judged by its subject,
host followed by path. A literal token is a run of ASCII letters and digits with something other than
such a character on both sides, so a URL that matches the rule has it as a whole token. Each rule is
filed under its rarest token, by the number of URLs of the table that hold it; a URL's tokens fetch
candidate rules, and only these run as regular expressions. Rules without such a token are candidates of
every URL. Of the rules that match, the highest tier wins, then the longest, then the least name.

Nulls: a null URL, or one without `://`, has an empty host and path and so the default verdict. Repeated
URLs and ids get equal results. URLs of any length are judged whole; tokens and rules are matched in linear
time, but for rules with several `*`. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = "[A-Za-z0-9]+"
#: Up to so many rules go with the plan as a literal; more are joined by token.
INLINE_RULES = 5_000


@dataclass(frozen=True)
class Rule:
    name: str
    action: str  # allow or block
    pattern: str
    tier: int = 0


def host_rule(name: str, action: str, tier: int = 1) -> Rule:
    """`host/path`: the host and its subdomains, paths that start so."""
    return Rule(name, action, f"||{name}", tier)


def to_regex(pattern: str) -> str:
    """The Java regular expression of a pattern."""
    out, rest = "", pattern.rstrip("*")  # a search needs no marks at the ends; with them it would try all places from all places
    if rest.startswith("||"):
        out, rest = r"^(?:[^/]*\.)?", rest[2:]
    else:
        rest = rest.lstrip("*")
    for part in re.split(r"([\^*])", rest):
        out += {"^": "(?:[^A-Za-z0-9]|^|$)", "*": "[\\s\\S]*"}.get(part) or re.sub(r"([^A-Za-z0-9])", r"\\\1", part)
    return out


def literal_tokens(pattern: str) -> list[str]:
    """Tokens that each matching URL holds whole."""
    anchored = pattern.startswith("||")
    body = pattern[2:] if anchored else pattern
    found = []
    for m in re.finditer(TOKEN, body):
        left = anchored if m.start() == 0 else body[m.start() - 1] != "*"
        right = m.end() < len(body) and body[m.end()] != "*"
        if left and right:
            found.append(m[0])
    return found


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end; A-Z lower-cased, else empty."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://[^/?#]*([^?#]*)", 1)


def rarest_tokens(subjects: DataFrame, rules: list[Rule]) -> dict[str, str | None]:
    """Each rule's rarest literal token by the number of subjects that hold it; none: null."""
    spark = subjects.sparkSession
    tokens = {r.name: sorted(set(literal_tokens(r.pattern))) for r in rules}
    every = sorted({t for ts in tokens.values() for t in ts})
    seen: dict[str, int] = {}
    if every:
        held = subjects.select(F.explode("tokens").alias("token")).join(
            F.broadcast(spark.createDataFrame([(t,) for t in every], "token string")) if len(every) <= INLINE_RULES else spark.createDataFrame([(t,) for t in every], "token string"), "token", "left_semi"
        )
        # a row for each token of a rule: as many as the rules, which the driver holds already
        seen = {r.token: r.n for r in held.groupBy("token").agg(F.count("*").alias("n")).collect()}
    return {name: min(ts, key=lambda t: (seen.get(t, 0), t)) if ts else None for name, ts in tokens.items()}


def judge(df: DataFrame, url_col: str, rules: list[Rule], default: str = "allow", inline: int = INLINE_RULES) -> DataFrame:
    """df with host, path, matched_rule, matched_tier and verdict; columns of df with these names are replaced."""
    names = [r.name for r in rules]
    if len(set(names)) != len(names):
        raise ValueError("rule names must differ")
    spark, url = df.sparkSession, F.col(url_col)
    kept = [c for c in df.columns if c not in ("host", "path", "matched_rule", "matched_tier", "verdict", "__subject", "__tokens", "__best")]
    out = df.select(*kept, host_of(url).alias("host"), path_of(url).alias("path")).withColumn("__subject", F.concat("host", "path"))
    out = out.withColumn("__tokens", F.array_distinct(F.regexp_extract_all("__subject", F.lit(f"({TOKEN})"), 1)))
    filed = rarest_tokens(out.select(F.col("__tokens").alias("tokens")), rules)
    entry = "struct<tier:int,len:int,name:string,action:string,regex:string>"
    best = lambda found: F.array_max(F.transform(found, lambda c: F.struct(c["tier"].alias("tier"), c["len"].alias("len"), c["name"].alias("name"), c["action"].alias("action"))))
    # among equal tiers and lengths the least name: names are ranked beforehand
    order = {n: i for i, n in enumerate(sorted(names, reverse=True))}
    rows = [(filed[r.name], (r.tier, len(r.pattern) * len(names) + order[r.name], r.name, r.action, to_regex(r.pattern))) for r in rules]
    if len(rules) <= inline:
        index: dict[str, list] = {}
        for token, row in rows:
            index.setdefault(token or "", []).append(row)
        literal = lambda row: F.struct(*(F.lit(v).alias(n) for n, v in zip(("tier", "len", "name", "action", "regex"), row, strict=True)))
        always = F.array(*map(literal, index.pop("", []))).cast(f"array<{entry}>")
        filed_under = F.create_map(*[x for t, found in index.items() for x in (F.lit(t), F.array(*map(literal, found)))]) if index else F.create_map().cast(f"map<string,array<{entry}>>")
        fetched = F.flatten(F.transform("__tokens", lambda t: F.coalesce(F.try_element_at(filed_under, t), F.array().cast(f"array<{entry}>"))))
        hits = F.filter(F.concat(fetched, always), lambda c: F.regexp(F.col("__subject"), c["regex"]))
        out = out.withColumn("__best", best(hits))
    else:
        index = spark.createDataFrame(rows, f"token string, rule {entry}")
        seen = out.select("__subject", "__tokens").distinct()
        fetched = seen.select("__subject", F.explode("__tokens").alias("token")).join(index.filter("token IS NOT NULL"), "token").select("__subject", "rule")
        if any(token is None for token, _ in rows):
            loose = [row for token, row in rows if token is None]
            fetched = fetched.union(seen.select("__subject", F.explode(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("tier", "len", "name", "action", "regex"), row, strict=True))) for row in loose))).alias("rule")))
        won = fetched.filter(F.regexp("__subject", F.col("rule.regex"))).groupBy("__subject").agg(F.max(F.struct("rule.tier", "rule.len", "rule.name", "rule.action")).alias("__best"))
        out = out.join(won, "__subject", "left")
    return out.select(
        *kept, "host", "path", F.col("__best.name").alias("matched_rule"), F.col("__best.tier").alias("matched_tier"), F.coalesce("__best.action", F.lit(default)).alias("verdict")
    )


#: The listed rules, and the patterns that judge URLs which no listed rule fits.
LISTED = [host_rule("net/", "block"), host_rule("example.net/en/", "allow"), host_rule("example.com/de/", "block"), host_rule("org/fr/", "allow")]
SPAM = ["spam-farm", "cheap-pills", "casino", "viagra", "payday-loans", "porn", "xxx", "warez", "free-download", "replica-watches", "poker", "slots", "escort", "crack", "keygen", "torrent", "link-farm", "essay-writing", "weight-loss", "forex-signals"]
PATHS = ["wp-login", "wp-admin", "phpmyadmin", "cgi-bin", "doorway", "affiliate", "adclick", "popunder"]
FILES = ["exe", "msi", "apk", "dmg", "iso", "rar", "torrent"]
#: A word anywhere between separators, a folder or file of the path, a kind of file at the end of a name.
PATTERNS = [Rule(f"word:{x}", "block", f"^{x}^", 0) for x in SPAM] + [Rule(f"path:{x}", "block", f"/{x}^", 0) for x in PATHS] + [Rule(f"file:{x}", "block", f"*.{x}^", 0) for x in FILES]


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    judged = judge(pages, "url", LISTED + PATTERNS)
    return judged.select("page_id", "host", "path", F.when(F.col("matched_tier") == 1, F.col("matched_rule")).alias("rule"), "verdict")


OP4_SQL = r"""
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url FROM pages
), p AS (
  SELECT page_id,
         translate(regexp_extract(url, '^[\s\S]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(url, '^[\s\S]*?://[^/?#]*([^?#]*)', 1) AS path
  FROM u
), h AS (
  SELECT *, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                 WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                 WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                 WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM p
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
            WHEN rule IS NOT NULL THEN 'allow'
            WHEN regexp_matches(concat(host, path), '(^|[^A-Za-z0-9])(SPAMWORDS)([^A-Za-z0-9]|$)') OR regexp_matches(concat(host, path), '/(PATHWORDS)([^A-Za-z0-9]|$)') OR regexp_matches(concat(host, path), '\.(FILEWORDS)([^A-Za-z0-9]|$)') THEN 'block'
            ELSE 'allow' END AS verdict
FROM h
""".replace("SPAMWORDS", "|".join(SPAM)).replace("PATHWORDS", "|".join(PATHS)).replace("FILEWORDS", "|".join(FILES))
