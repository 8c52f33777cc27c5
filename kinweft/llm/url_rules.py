"""URL filters by pattern rules that are looked up under their rarest literal token; DataFrame functions only.

A rule is a text of a host and a path.  Its literal tokens, the runs of letters and digits that stand whole in every
URL that fits it, are known when it is written.  It is posted under the one that the fewest URLs have, each URL asks
the index with its own tokens, and only the rules it so fetches run their regular expressions on it.  Rules without
such a token are posted under the empty token, which every URL has.

All work is on distinct hosts and paths under their digests.  The long text of a URL is never repeated for each of its
tokens, and a URL that a third of all rows have is judged once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweft.llm.shared import durable, free, small_join

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TOKEN = re.compile("[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    """``pattern`` is host and path: ``example.org/fr/`` fits that host and its subdomains where the path begins so.

    The host ``*`` is any host.  In the path one ``*`` stands for any characters, and a ``$`` at the end for the
    path's end.  ``action`` is ``allow`` or ``block``.  Of the rules that fit, those of the lowest ``tier`` come
    first, then the longest pattern, then the one given first.
    """

    pattern: str
    action: str
    tier: int = 0

    def __post_init__(self):
        host, slash, path = self.pattern.partition("/")
        if not host or not slash or self.action not in ("allow", "block") or path.count("*") > 1 or "*" in host and host != "*" or host != host.translate(str.maketrans(_UPPER, _LOWER)) or re.search("[?#]", self.pattern):
            raise ValueError(f"not a rule: {self.pattern!r}, {self.action!r}")

    @property
    def regex(self) -> str:
        """What host and path, written one after the other, match.  Linear: each class stops at what follows it, or is followed by nothing but one literal."""
        host, _, path = self.pattern.partition("/")
        end, path = ("\\z", path[:-1]) if path.endswith("$") else ("", path)
        quoted = lambda s: re.sub(r"[^A-Za-z0-9/_\x80-\U0010ffff]", lambda m: "\\" + m[0], s)
        return "^" + ("[^/?#]*" if host == "*" else r"(?:[^/?#]*\.)?" + quoted(host)) + "/" + "[^?#]*".join(map(quoted, path.split("*"))) + end

    @property
    def tokens(self) -> list[str]:
        """The lower-case runs of letters and digits that stand whole in every URL that fits."""
        host, _, path = self.pattern.partition("/")
        pieces = (host.replace("*", "") + "/" + path.removesuffix("$")).split("*")
        found = set()
        for k, piece in enumerate(pieces):
            low = piece.translate(str.maketrans(_UPPER, _LOWER))
            goes_on = k + 1 < len(pieces) or not path.endswith("$")
            for m in _TOKEN.finditer(low):
                if not (k > 0 and m.start() == 0) and not (goes_on and m.end() == len(low)):
                    found.add(m[0])
        return sorted(found)


#: What the operator blocks by itself: pages that hold no text worth training on.
GENERAL = tuple(Rule(p, "block", 1) for p in ("*/wp-admin/", "*/wp-login.php", "*/cgi-bin/", "*/cart/", "*/*/cart/", "*/checkout/", "*/*/checkout/", "*/login/", "*/*/login/", "*/search/", "*/*/search/", "*/*.zip$", "*/*.exe$", "*/*.jpg$", "*/*.png$", "*/*.mp4$"))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (A-Z lower-cased) after the first ``://``, and the path up to ``?`` or ``#``; both empty where there is none."""
    at = F.instr(url, "://")
    rest = F.substr(url, at + 3)
    known = url.isNotNull() & (at > 0)
    return F.when(known, ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))).otherwise(""), F.when(known, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def judge(addresses: DataFrame, rules: list[Rule] | tuple[Rule, ...]) -> DataFrame:
    """(key, pattern, action, tier) of the winning rule of every row of ``addresses`` (key, address) that has one.

    ``address`` is host and path together, ``key`` its digest, distinct.  The rules come from the caller's list and so
    fit the driver; the index is broadcast while it is small, and else joined with salted tokens.
    """
    spark = addresses.sparkSession
    told = [(i, r.pattern, r.regex, r.action, r.tier, len(r.pattern), r.tokens or [""]) for i, r in enumerate(rules)]
    rules_ = spark.createDataFrame(told, "rule int, pattern string, regex string, action string, tier int, size int, tokens array<string>")
    # every URL has the empty token as well
    asked = addresses.select("key", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), F.split(ascii_lower(F.col("address")), "[^a-z0-9]+")))).alias("token"))
    wanted = rules_.select("rule", F.explode("tokens").alias("token"))
    counts = small_join(asked, wanted.select("token").distinct(), ["token"]).groupBy("token").agg(F.count("*").alias("n"))
    rarest = wanted.join(counts, "token").groupBy("rule").agg(F.min_by("token", F.struct("n", "token")).alias("token"), F.count("*").alias("there"))
    # a rule one of whose tokens no URL has fits none
    index = durable(rarest.join(rules_, "rule").where(F.col("there") == F.size("tokens")).select("token", "rule"), "url-index")
    fetched = small_join(asked, index, ["token"]).select("key", "rule")
    run = small_join(fetched, rules_.drop("tokens"), ["rule"]).join(addresses, "key").where(F.regexp_like("address", F.col("regex")))
    best = F.max_by(F.struct("pattern", "action", "tier"), F.struct(-F.col("tier"), F.col("size"), -F.col("rule")))
    return run.groupBy("key").agg(best.alias("best")).select("key", "best.*")


def verdicts(pages: DataFrame, rules: list[Rule] | tuple[Rule, ...], general: tuple[Rule, ...] = GENERAL, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id_col, host, path, rule, verdict, general_rule) for every row of ``pages``.

    ``rule`` is the pattern of the winning rule of ``rules`` (null: none fits) and decides; where there is none
    ``general`` rules do (``general_rule``, else null), and where none of these fits the verdict is ``default``.  A
    null url, or one without ``://``, has an empty host and path and gets ``default``.  Repeated rows give repeated
    rows, an empty table an empty result; other columns are ignored, whatever they are called.
    """
    both = [*(Rule(r.pattern, r.action, 0) for r in rules), *(Rule(r.pattern, r.action, 1) for r in general)]
    host, path = host_and_path(F.col(f"`{url_col}`"))
    made = pages.select(F.col(f"`{id_col}`").alias("id"), host.alias("host"), path.alias("path")).withColumn("address", F.concat("host", "path")).withColumn("key", F.unhex(F.sha2("address", 256)))
    addresses = durable(made.where("address <> ''").groupBy("key").agg(F.first("address").alias("address")), "urls")
    found = judge(addresses, both)
    name = free(id_col, ["host", "path", "rule", "verdict", "general_rule"])
    joined = made.select("id", "host", "path", "key").join(found, "key", "left")
    return joined.select(F.col("id").alias(name), "host", "path", F.when(F.col("tier") == 0, F.col("pattern")).alias("rule"), F.coalesce("action", F.lit(default)).alias("verdict"), F.when(F.col("tier") == 1, F.col("pattern")).alias("general_rule"))


def sql(rules: list[Rule] | tuple[Rule, ...], general: tuple[Rule, ...] = GENERAL, default: str = "allow") -> str:
    """DuckDB SQL that runs every rule on every distinct URL."""
    both = [*((r, 0) for r in rules), *((r, 1) for r in general)]
    rows = ", ".join(f"({i}, '{r.pattern}', '{r.regex}', '{r.action}', {tier}, {len(r.pattern)})" for i, (r, tier) in enumerate(both))
    return f"""
WITH rules(i, pattern, regex, action, tier, size) AS (VALUES {rows}),
p AS (SELECT page_id, url, instr(url, '://') AS pos, substr(url, instr(url, '://') + 3) AS rest FROM pages),
h AS (SELECT page_id, CASE WHEN pos > 0 THEN translate(regexp_extract(rest, '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}') ELSE '' END AS host, CASE WHEN pos > 0 THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM p),
b AS (SELECT host || path AS address, arg_max(struct_pack(pattern, action, tier), [-tier, size, -i]) AS best FROM (SELECT DISTINCT host, path FROM h) JOIN rules ON regexp_matches(host || path, regex) GROUP BY 1)
SELECT page_id, host, path, CASE WHEN best.tier = 0 THEN best.pattern END AS rule, coalesce(best.action, '{default}') AS verdict, CASE WHEN best.tier = 1 THEN best.pattern END AS general_rule
FROM h LEFT JOIN b ON host || path = address
"""
