"""URL filters: pattern rules indexed by their rarest literal token.

A rule names a host (its subdomains too), a pattern of its path, and an action; * stands for anything, ^
for what separates words of a URL, and a | at the end for the end of the path. Host labels and closed path
segments are literal tokens; each rule hangs on the one that is rarest among the table's URLs. A URL's
tokens fetch the rules that hang on them, and only those run their regular expressions. A rule list of up
to some thousands lies in the plan itself: one projection over the URLs, no shuffle, no Python. A longer
one is a table that the URLs' tokens are joined with.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagoon.llm.common import materialise


@dataclass(frozen=True)
class Rule:
    """block or allow what lies under host + path; of rules that fit, tier 0 goes before 1, then the longest.

    A path begins where the host ends. In host and path * stands for anything; in a path ^ stands for a
    character that is no letter, digit, - or ., or for the end, and a | at its end for the end of the path.
    """

    action: str
    host: str
    path: str
    tier: int = 0

    @property
    def text(self) -> str:
        return self.host + self.path

    @property
    def regex(self) -> str:
        """Over host + path of a URL; a host's labels end at the first slash."""
        path, ends = (self.path[:-1], "$") if self.path.endswith("|") else (self.path, "")
        some = {"*": ".*", "^": "(?:[^A-Za-z0-9.-]|$)"}
        path = "".join(some.get(c, re.escape(c)) for c in path)
        host = "[^/]*".join(re.escape(p) for p in self.host.split("*"))
        host = rf"(?:[^/]*\.)?{host}" if self.host else "[^/]*"
        return f"(?s)^{host}(?=/|$){path}{ends}"

    @property
    def tokens(self) -> list[str]:
        """Tokens that every URL the rule fits has: those with a delimiter, or an end, on both sides."""
        closed = re.findall(r"(?<![A-Za-z0-9*])[A-Za-z0-9]+(?=[^A-Za-z0-9*])", self.path)
        labels = re.findall(r"(?<![A-Za-z0-9*])[A-Za-z0-9]+(?![A-Za-z0-9*])", self.host)
        return sorted({*labels, *closed})


def url_host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(site: Column) -> Column:
    return F.array_distinct(F.split(site, "[^A-Za-z0-9]+"))


def rarest_tokens(sites: DataFrame, rules: list[Rule]) -> dict[str, str]:
    """For each rule's text the token to hang it on: of its tokens the one in the fewest sites.

    Counts only tokens that occur in rules, so the result has at most that many rows. A rule without a
    token hangs on the empty one, which is fetched for every URL.
    """
    wanted = sorted({t for r in rules for t in r.tokens})
    many = {}
    if wanted:
        each = sites.select(F.explode(F.array_intersect(tokens(F.col("site")), F.split(F.lit(" ".join(wanted)), " "))).alias("t"))
        many = {r["t"]: r["n"] for r in each.groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {r.text: min(r.tokens, key=lambda t: (many.get(t, 0), t), default="") for r in rules}


DECIDES = ("order", "size", "text", "action", "regex")
WINNER = "struct<order:int,size:int,text:string,action:string,regex:string>"


def listed(rules: list[Rule], hung: dict[str, str]) -> list[dict]:
    """Rules as rows: the token, and what decides; sorted by token."""
    rows = [{"token": hung[r.text], "order": -r.tier, "size": len(r.text), "text": r.text, "action": r.action, "regex": r.regex} for r in rules]
    return sorted(rows, key=lambda r: r["token"])


def winner_in_plan(site: Column, found: Column, rules: list[dict]) -> Column:
    """The winning rule as a struct, or null. The rules are one literal, looked at only where a token is theirs."""
    known = {r["token"] for r in rules}
    table = F.from_json(F.lit(json.dumps(rules)), "array<struct<token:string,order:int,size:int,text:string,action:string,regex:string>>")
    some = [F.lit(t) for t in sorted(known)]

    def best(mine: Column) -> Column:
        fetched = F.filter(table, lambda r: F.array_contains(mine, r["token"]) & F.regexp_like(site, r["regex"]))
        return F.when(F.size(mine) > 0, F.array_max(F.transform(fetched, lambda r: F.struct(*[r[c].alias(c) for c in DECIDES]))))

    # a lambda's argument is worked out once, not for every rule; a long list of literals is looked up by hash
    return F.transform(F.array(F.filter(found, lambda t: t.isin(some))), best)[0]


def winners_by_join(found: DataFrame, rules: list[dict], most_broadcast: int) -> DataFrame:
    """(nr, best) of the rows of `found` that a rule fits: an equi-join of tokens with the rules' tokens."""
    spark = found.sparkSession
    table = materialise(spark.createDataFrame(pd.DataFrame(rules), "token string, order int, size int, text string, action string, regex string"))
    table = F.broadcast(table) if len(rules) <= most_broadcast else table.hint("merge")
    each = found.select("nr", "site", F.explode("tokens").alias("token")).join(table, "token").where("regexp_like(site, regex)")
    return each.groupBy("nr").agg(F.max(F.struct(*DECIDES)).alias("best"))


def judge_urls(pages: DataFrame, rules: list[Rule], otherwise: str = "allow", in_plan: int = 2000, most_broadcast: int = 500_000, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of `pages`: the id, host, path, rule, verdict, pattern.

    rule is the text of the winning tier-0 rule, else null; pattern that of a tier-1 rule if no tier-0
    rule fits; verdict the winner's action, else `otherwise`. A null URL or one without :// has an empty
    host and path and fits no rule with a host. Repeated rows and null ids stay, an empty table gives an
    empty result, other columns are not read.

    Up to `in_plan` rules are a literal of the plan. More are a table: hosts and paths are written once,
    their tokens joined with it (broadcast up to `most_broadcast` rules of some 200 bytes, shuffled
    beyond), and of the rows that a rule fits the numbers joined back.
    """
    sites = pages.select(F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    sites = sites.withColumn("site", F.concat("host", "path"))
    hung = rarest_tokens(sites, rules)
    rows = listed(rules, hung)
    found = sites.withColumn("tokens", F.concat(tokens(F.col("site")), F.array(F.lit(""))) if "" in hung.values() else tokens(F.col("site")))
    if not rules:
        judged = sites.withColumn("best", F.lit(None).cast(WINNER))
    elif len(rules) <= in_plan:
        judged = found.withColumn("best", winner_in_plan(F.col("site"), F.col("tokens"), rows))
    else:
        found = materialise(found.withColumn("nr", F.monotonically_increasing_id()))
        judged = found.join(winners_by_join(found, rows, most_broadcast), "nr", "left")
    explicit = F.col("best.order") == 0
    return judged.select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.when(explicit, F.col("best.text")).alias("rule"),
        F.coalesce("best.action", F.lit(otherwise)).alias("verdict"),
        F.when(~explicit, F.col("best.text")).alias("pattern"),
    )


#: The explicit rules.
EXPLICIT = [
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
]

#: What a corpus does not want, each a kind of page. Path segments on any host.
UNWANTED_SEGMENTS = "ads adserver advert adverts affiliate affiliates banner banners basket beacon cart cgi-bin checkout click clicks coupon coupons doubleclick escorts login logout pixel popunder popup register share signin signup sponsor sponsored track tracker tracking unsubscribe wishlist wp-admin wp-content wp-json wp-login xmlrpc".split()
#: Host labels, at any depth.
UNWANTED_LABELS = "ads adserver adult bet bets betting casino doubleclick escort escorts gambling lottery payday pixel poker porn sex slots telemetry torrent torrents track tracker tracking viagra warez xxx".split()
#: Words inside a host label, set off by hyphens.
UNWANTED_HOST_WORDS = "adult bets betting casino escort gambling loans lottery payday pills poker porn sex slots torrent viagra warez xxx".split()
#: Hosts that serve adverts and counters only.
UNWANTED_HOSTS = "adnxs.com adsrvr.org amazon-adsystem.com criteo.com doubleclick.net exoclick.com googlesyndication.com googletagmanager.com google-analytics.com hotjar.com moatads.com outbrain.com popads.net pubmatic.com quantserve.com rubiconproject.com scorecardresearch.com taboola.com trafficjunky.com zedo.com".split()
#: Ends of paths that hold no page.
UNWANTED_ENDINGS = "apk avi bin css csv dmg doc docx eot exe gif gz ico iso jar jpeg jpg js json map mov mp3 mp4 mpeg msi pdf png ppt pptx rar rss svg swf tar tgz ttf wav webm webp woff woff2 xls xlsx xml zip".split()
#: Other shapes of paths, by hand.
UNWANTED_PATHS = ["*/wp-login.php^", "*/index.php/component/users^", "*/user/login^", "*/account/login^", "*/accounts/signin^", "*/password/reset^", "*/cart/add^", "*/compare/add^", "*/product/review^", "*/search/results^", "*/tag/feed^", "*/comments/feed^", "*/print/view^", "*/calendar/day^", "*/out/redirect*", "*/go/to/*", "*/ad/click*", "*/ajax/*/load^"]
#: What goes through although a shorter rule blocks it.
WANTED = [Rule("allow", "", "*/wp-content/uploads/", 1), Rule("allow", "", "*/sitemap.xml|", 1)]


def default_patterns() -> list[Rule]:
    """Tier-1 rules, some 200: of the lists above, each under its own shape."""
    return [
        *(Rule("block", "", f"*/{s}/", 1) for s in UNWANTED_SEGMENTS),
        *(Rule("block", s, "", 1) for s in UNWANTED_LABELS),
        *(Rule("block", f"{s}.*", "", 1) for s in UNWANTED_LABELS),
        *(Rule("block", f"*-{s}.*", "", 1) for s in UNWANTED_HOST_WORDS),
        *(Rule("block", f"{s}-*", "", 1) for s in UNWANTED_HOST_WORDS),
        *(Rule("block", h, "", 1) for h in UNWANTED_HOSTS),
        *(Rule("block", "", f"*.{e}|", 1) for e in UNWANTED_ENDINGS),
        *(Rule("block", "", p, 1) for p in UNWANTED_PATHS),
        *WANTED,
    ]
