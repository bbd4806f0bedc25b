"""Pattern rules for URLs, fetched through their rarest literal token.

Every rule is a regular expression with the literal tokens that any match must
contain. A rule is filed under the token that is rarest in the URLs themselves;
the tokens of a URL fetch candidate rules, and only those run their expressions.
Rules without a literal token are filed under the empty token, which every URL has.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col

#: Runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased.
TOKEN = r"[0-9a-z\x{80}-\x{10FFFF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MOST_RULES = 100_000


@dataclass(frozen=True)
class Rule:
    """``pattern`` runs on host + path; ``tokens`` are whole tokens that each match contains, none if unknown."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int


def literal_tokens(text: str) -> list[str]:
    """Tokens of a literal text, cut as those of the URLs are."""
    return re.findall("[0-9a-z\x80-\U0010ffff]+", lowered(text))


def lowered(text: str) -> str:
    """A-Z in lower case, all else as it is."""
    return text.translate(str.maketrans(UPPER, LOWER))


def host_rule(host: str, path: str, verdict: str) -> Rule:
    """For a host in either case with its subdomains and a path prefix. The longest such rule wins."""
    # the last part of the path may go on in the URL, so its tokens need not be whole there
    tokens = literal_tokens(host) + literal_tokens(path.rsplit("/", 1)[0])
    return Rule(
        host + path, verdict, rf"^(?:[^/]*\.)?{re.escape(lowered(host))}(?=/|$){re.escape(path)}", tuple(dict.fromkeys(tokens)), 1000 + len(host + path)
    )


def label_rule(word: str, verdict: str = "block") -> Rule:
    """For hosts with a label that is ``word``, or ``word`` and a hyphen and more; after all host rules."""
    return Rule(f"label:{word}", verdict, rf"^(?:[^/]*\.)?{re.escape(lowered(word))}(?:-[^./]*)?\.", tuple(literal_tokens(word)), len(word))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def judge_urls(pages: DataFrame, rules: list[Rule], otherwise: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, url, host, path, rule (the name of the best match, else null) and verdict for every row.

    Among matching rules the one of the highest rank wins, then the smaller name.
    Null URLs and those without ``://`` have an empty host and path, match nothing
    and get ``otherwise``. Repeated rows are each judged. No page: no row. At most
    ``MOST_RULES`` rules, so that their index stays small enough to broadcast. A
    rule without tokens runs on every distinct URL.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    spark = pages.sparkSession
    url = c(f"`{url_col}`").cast("string")
    parts = pages.select(c(f"`{id_col}`").alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    where = F.concat("host", "path")
    tokens = F.array_distinct(F.regexp_extract_all(F.translate(where, UPPER, LOWER), F.lit(TOKEN), 0))
    wanted = sorted({t for r in rules for t in r.tokens})
    schema = "name string, verdict string, pattern string, rank int, token string"
    times: dict[str, int] = {}
    if wanted:
        # how many URLs hold each literal token: counts over all rows, one per token of the rules
        listed = F.array(*map(F.lit, wanted))
        seen = parts.select(F.explode(F.array_intersect(tokens, listed)).alias("token")).groupBy("token").count()
        times = {r.token: r["count"] for r in seen.collect()}
    filed = [
        (r.name, r.verdict, r.pattern, r.rank, min(r.tokens, key=lambda t: (times.get(t, 0), t), default="")) for r in rules
    ]
    index = spark.createDataFrame(filed, schema)
    fetch = tokens if all(r.tokens for r in rules) else F.array_append(tokens, F.lit(""))
    urls = parts.select("host", "path").where("host <> ''").distinct()
    found = (
        urls.select("host", "path", F.explode(fetch).alias("token"))
        .join(F.broadcast(index), "token")
        .where(F.expr("concat(host, path) rlike pattern"))
        .groupBy("host", "path")
        .agg(F.min(F.struct((-c("rank")).alias("below"), "name", "verdict")).alias("best"))
        .select("host", "path", c("best.name").alias("rule"), c("best.verdict").alias("found"))
    )
    out = parts.join(found, ["host", "path"], "left")
    return out.select("page_id", "url", "host", "path", "rule", F.coalesce("found", F.lit(otherwise)).alias("verdict"))
