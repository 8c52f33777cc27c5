"""Text, date and number functions of the analytics, as Columns.

All but two run in generated code.  Unicode compatibility forms of texts that are not ASCII and URL parsing need
Python; they are Arrow-batched, and used at ingest only, never in the evaluation.
"""

from __future__ import annotations

import re
import unicodedata
from urllib.parse import quote, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Mailboxes that several people read, and domains anyone can have an address at.
SHARED_MAILBOXES = ("admin", "contact", "hello", "info", "office", "sales", "support", "team")
FREE_MAIL_DOMAINS = ("gmail.com", "yahoo.com", "outlook.com", "hotmail.com", "icloud.com", "proton.me")
# Fixed value: characters a spreadsheet skips before it looks for a formula.
SKIPPED_BEFORE_FORMULA = r"\x00-\x20\x7F\x80-\x9F\xA0\x{1680}\x{2000}-\x{200F}\x{2028}\x{202F}\x{205F}\x{2060}\x{2066}-\x{2069}\x{3000}\x{FEFF}"

_JS_SPACE = r"[\s\x{FEFF}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_DAY_MS = 86_400_000


@F.pandas_udf(T.StringType())
def _composed(text: pd.Series) -> pd.Series:
    """Unicode compatibility composition of the texts that are not null."""
    return text.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def nfkc(text: Column) -> Column:
    """Unicode compatibility composition; only what is not ASCII is handed to Python."""
    odd = ~text.rlike(r"\A\p{ASCII}*\z")
    return F.coalesce(_composed(F.when(odd, text)), text)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{_JS_SPACE}|{_JS_SPACE}\z", "")


def folded(text: Column) -> Column:
    """Trimmed and lower-cased; what compares equal in rules, headers and aliases once compatibility forms are gone."""
    return F.lower(trimmed(text))


def normalize_email(text: Column) -> Column:
    return folded(nfkc(text))


def is_email(text: Column) -> Column:
    return text.rlike(r"\A[^\s@]+@[^\s@]+\.[^\s@]+\z")


def email_risk(email: Column) -> Column:
    """``shared_or_role`` or ``unique_candidate`` for a folded address; null for none."""
    local, domain = F.split_part(email, F.lit("@"), F.lit(1)), F.split_part(email, F.lit("@"), F.lit(2))
    shared = (local == "") | (domain == "") | local.isin(*SHARED_MAILBOXES) | domain.isin(*FREE_MAIL_DOMAINS) | local.rlike(r"\A(?:family|household|the[a-z]+s)\z")
    return F.when(shared, "shared_or_role").when(email.isNotNull(), "unique_candidate")


def normalize_domain(text: Column) -> Column:
    """A bare lower-case domain; null where there is none."""
    bare = F.split_part(F.regexp_replace(folded(text), r"\Ahttps?://", ""), F.lit("/"), F.lit(1))
    return F.when(bare.rlike(r"\A(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,63}\z"), bare)


def profile_url(raw: str | None) -> str | None:
    """An https address without query, fragment and trailing slashes; None for anything else."""
    if raw is None:
        return None
    try:
        parts = urlsplit(unicodedata.normalize("NFKC", raw).strip())
        if parts.scheme.lower() != "https" or not parts.hostname:
            return None
        port = f":{parts.port}" if parts.port not in (None, 443) else ""
    except ValueError:
        return None
    return f"https://{parts.hostname.lower()}{port}{quote(parts.path, safe='/%:@!$&()*+,;=~-._' + chr(39)).rstrip('/')}"


@F.pandas_udf(T.StringType())
def normalize_profile_url(text: pd.Series) -> pd.Series:
    return text.map(profile_url)


def has_control(text: Column) -> Column:
    return text.rlike(r"\p{Cc}")


def observed_ts(text: Column) -> Column:
    """The instant of an ISO date or date-time, or of ``dd Mon yyyy``; null for anything else."""
    tries = [F.try_to_timestamp(text)] + [F.try_to_timestamp(text, F.lit(p)) for p in ("d MMM yyyy", "yyyy-MM-dd'T'HH:mm:ss[.SSS]XXX")]
    return F.coalesce(*tries)


def iso_millis(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def age_days(clock: Column, observed: Column) -> Column:
    """Whole days between two timestamps, rounded down; negative for what lies in the future."""
    return F.floor((F.unix_millis(clock) - F.unix_millis(observed)) / _DAY_MS)


def score(value: Column) -> Column:
    """0 to 100, halves rounded up."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.floor(value + 0.5))).cast("int")


def neutralize_formula(text: Column) -> Column:
    """A cell that no spreadsheet takes for a formula: NUL taken out, an apostrophe before what could start one."""
    clean = F.regexp_replace(text, r"\x00", "")
    risky = clean.rlike(rf"\A[{SKIPPED_BEFORE_FORMULA}]*[=+\-@]") | clean.rlike(r"\A[\t\r\n]")
    return F.when(risky, F.concat(F.lit("'"), clean)).otherwise(clean)


_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\u2028\u2029]")
_CONTROL_CLASS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\x{2028}\x{2029}]"
_NAMED = str.maketrans({"\r": "\\r", "\n": "\\n", "\t": "\\t"})


def terminal_safe(text: str) -> str:
    """Text whose control characters a terminal shows instead of obeying."""
    return _CONTROL.sub(lambda m: f"\\u{ord(m[0]):04x}", text).translate(_NAMED)


def escape_terminal(text: Column) -> Column:
    """:func:`terminal_safe` of a column, in generated code."""
    named = F.replace(F.replace(F.replace(text, F.lit("\r"), F.lit("\\r")), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))
    # each control character is a split point of its own; texts that have none are not split
    shown = F.aggregate(F.split(named, ""), F.lit(""), lambda a, c: F.concat(a, F.when(c.rlike(_CONTROL_CLASS), F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(F.ascii(c).cast("long"))), 4, "0"))).otherwise(c)))
    return F.when(named.rlike(_CONTROL_CLASS), shown).otherwise(named)


def csv_cell(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(neutralize_formula(F.coalesce(text, F.lit(""))), F.lit('"'), F.lit('""')), F.lit('"'))


def source_class_covers(source_class: Column, source_kind: Column) -> Column:
    """Whether a consented source class lets a kind of source be imported."""
    a, b = folded(source_class), folded(source_kind)
    return (a == b) | ((a == "connections_csv") & (b.endswith("connections_export") | (b == "generic_contacts_csv")))
