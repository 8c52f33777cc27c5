"""Secret scans over an incremental blob ledger, in DataFrame and SQL functions only.

Every version of every file is addressed by the digest of its content.  The ledger holds the findings of
each pair of blob and rule version that was ever scanned; a scan reads only blobs without such a pair, each
once, and joins the findings back to all versions and paths that have the content.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweft.llm.quality import let
from kinweft.llm.shared import free, new_path


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` of which group ``group`` has at least ``least`` characters.

    ``after`` is a class of characters (the inside of square brackets); a match does not begin behind one of them.
    Patterns take time linear in the text: no group repeats without a bound, and where a class is followed by what it
    holds itself, ``after`` lets a run of it be tried from its beginning only.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    after: str = ""


BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace("password|passwd|secret|token|api_?key", "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"), 2, 6),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", "[0-9a-f]+", 0, 24),
)
#: Well-known credential formats, beyond the base rules.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\x20\x09-\x0D]+-----END [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", after="A-Za-z0-9_-"),
    Rule("host_token", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/:@]+@", after="A-Za-z0-9+.-"),
)
RULES = BASE_RULES + MORE_RULES
RULE_VERSION = "1.1"


def running(sizes: Column) -> Column:
    """The sums of an array of integers before each of its elements.

    Beyond 64 of them within blocks of about the square root of their number and over the blocks, so a text of very
    many matches costs no square of them.
    """

    def grown(a: Column) -> Column:
        return F.aggregate(a, F.array(F.lit(0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))

    def dealt(z: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(z["a"]))).cast("int")
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(z["a"]) - 1) / width).cast("int")), lambda i: grown(F.slice(z["a"], i * width + 1, width)))

        def placed(y: Column) -> Column:
            before = grown(F.transform(y["parts"], lambda x: F.element_at(x, -1)))
            return let(F.struct(y["parts"].alias("parts"), before.alias("before")), lambda w: F.flatten(F.transform(w["parts"], lambda x, i: F.transform(F.slice(x, 1, F.size(x) - 1), lambda v: v + w["before"][i]))))

        return let(F.struct(parts.alias("parts")), placed)

    few = F.slice(grown(sizes), 1, F.size(sizes))
    return F.when(F.size(sizes) == 0, F.array().cast("array<int>")).when(F.size(sizes) <= 64, few).otherwise(let(F.struct(sizes.alias("a")), dealt))


def _spans(text: Column, order: int, rule: Rule) -> Column:
    """array(struct(start, kind_order, kind, stop)) of one rule; code points, ``stop`` exclusive."""
    # hexadecimal runs shorter than wanted are skipped by the pattern: a run is matched whole or not at all
    pattern = "[0-9a-f]{%d,}" % rule.least if rule.pattern == "[0-9a-f]+" else rule.pattern
    if rule.after:
        pattern = f"(?<![{rule.after}])" + pattern
    kind = "array<struct<start:int,kind_order:int,kind:string,stop:int>>"

    def place(z: Column) -> Column:
        between = F.split(text, pattern, -1)
        parts = F.regexp_extract_all(text, F.lit(pattern), rule.group) if rule.group else z
        each = F.transform(F.arrays_zip(F.slice(between, 1, F.size(z)).alias("before"), z.alias("match"), parts.alias("part")), lambda x: F.struct(F.length(x["before"]).alias("skip"), F.length(x["match"]).alias("size"), F.length(x["part"]).alias("part")))

        def spans(y: Column) -> Column:
            before = running(F.transform(y["e"], lambda x: x["skip"] + x["size"]))
            both = F.arrays_zip(y["e"].alias("e"), before.alias("at"))
            good = F.filter(both, lambda x: x["e"]["part"] >= rule.least)
            return F.transform(good, lambda x: F.struct((x["at"] + x["e"]["skip"]).alias("start"), F.lit(order).alias("kind_order"), F.lit(rule.kind).alias("kind"), (x["at"] + x["e"]["skip"] + x["e"]["size"]).alias("stop"))).cast(kind)

        return let(F.struct(each.alias("e")), spans)

    return let(F.regexp_extract_all(text, F.lit(pattern), 0), lambda z: F.when(F.size(z) == 0, F.array().cast(kind)).otherwise(place(z)))


def scan(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All spans of a text, by start and then by the order of the rules."""
    return F.array_sort(F.concat(*[_spans(text, i, r) for i, r in enumerate(rules)]))


def joined(spans: Column) -> Column:
    """``kind:start:stop`` of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def blob(text: Column) -> Column:
    """The content address of a text; null is the empty text."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def update_ledger(versions: DataFrame, ledger: DataFrame | None = None, text_col: str = "text", rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION) -> DataFrame:
    """(blob, rule_version, spans) of the blobs of ``versions`` that ``ledger`` has no such pair for."""
    blobs = versions.select(blob(F.col(text_col)).alias("blob"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).dropDuplicates(["blob"])
    if ledger is not None:
        blobs = blobs.join(ledger.where(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")
    return blobs.select("blob", F.lit(rule_version).alias("rule_version"), scan(F.col("text"), rules).alias("spans"))


def findings(versions: DataFrame, ledger: DataFrame, keys: list[str], text_col: str = "text", rule_version: str = RULE_VERSION) -> DataFrame:
    """``keys`` of every version and its ``spans``, from the ledger.

    Versions without findings have an empty array.  Copies of a blob all get its spans.  Keys may have any names but
    ``spans``, which is the result's: that is an error.
    """
    if "spans" in {k.lower() for k in keys}:
        raise ValueError("a key is called spans, as the findings are")
    held = ledger.where((F.col("rule_version") == rule_version) & (F.size("spans") > 0)).select("blob", "spans")
    name = free("blob", keys)
    made = versions.select(*[F.col(f"`{k}`") for k in keys], blob(F.col(text_col)).alias(name)).alias("v").join(held.alias("h"), F.col(f"v.`{name}`") == F.col("h.blob"), "left")
    return made.select(*[F.col(f"v.`{k}`") for k in keys], F.coalesce("h.spans", F.array().cast(dict(held.dtypes)["spans"])).alias("spans"))


def scan_versions(versions: DataFrame, ledger_path: str | None = None, keys: tuple[str, ...] = ("doc_id",), text_col: str = "text", rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION) -> DataFrame:
    """``keys`` and ``spans`` of every version, after bringing the ledger up to date.

    ``ledger_path`` is the ledger's folder, to which what is scanned now is added; by default a new one in the
    shared folder.  Null texts are empty texts; repeated rows give repeated rows; columns other than ``keys`` and
    the text are ignored.
    """
    spark = versions.sparkSession
    path = ledger_path or new_path(spark, "ledger")
    schema = "blob binary, rule_version string, spans array<struct<start:int,kind_order:int,kind:string,stop:int>>"
    there = None
    if ledger_path is not None:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
            there = spark.read.schema(schema).parquet(path)
    update_ledger(versions, there, text_col, rules, rule_version).write.mode("append").parquet(path)
    return findings(versions, spark.read.schema(schema).parquet(path), list(keys), text_col, rule_version)
