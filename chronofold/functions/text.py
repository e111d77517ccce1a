"""Text functions as Column expressions; pandas UDFs only where Spark has no equivalent."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Full-width ASCII and its plain form, the part of NFKC that a character map can do.
WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
NARROW = "".join(chr(c) for c in range(0x21, 0x7F)) + " "

#: Words that place a text relative to its own time.
RELATIVE_TIME_WORDS = ("今天", "今日", "今晚", "今早", "明天", "明早", "明晚", "昨天", "昨晚", "前天", "后天", "上周", "下周", "本周", "这周", "周一", "周二", "周三", "周四", "周五", "周六", "周日", "星期一", "星期二", "星期三", "星期四", "星期五", "星期六", "星期日", "星期天", "礼拜一", "礼拜二", "礼拜三", "礼拜四", "礼拜五", "礼拜六", "礼拜日", "礼拜天", "上个月", "下个月", "去年", "今年", "最近", "这段时间", "当前", "现在", "刚才", "一会儿", "过几天")

#: What a credential is called in running text.
#: Names of fields that hold credentials.
CREDENTIALS = ("api[_-]?key", "authorization", "auth[_-]?key", "pt[_-]?key", "access[_-]?token", "refresh[_-]?token", "password", "passwd", "secret")
#: Fixed value: what stands in for a credential.
SECRET_MARK = "[secret value omitted]"
_ASSIGNED = rf"((?<![A-Za-z0-9_])['\"]?(?:{'|'.join(CREDENTIALS)}|token)['\"]?\s*[:=]\s*)"
#: Credentials inside running text, and what they become ($n is the nth group).
CREDENTIAL_TEXT = (
    (r"(?i)(\bBearer\s+)[A-Za-z0-9._~+/=-]{12,}", f"$1{SECRET_MARK}"),
    (r"(?i)\bsk-[A-Za-z0-9_-]{12,}", SECRET_MARK),
    (r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b", SECRET_MARK),
    (rf"(?i){_ASSIGNED}(['\"])[^'\"\r\n]{{8,}}\2", f"$1$2{SECRET_MARK}$2"),
    (rf"(?i){_ASSIGNED}[A-Za-z0-9_~+/=-]{{16,}}(?=$|[\s,;}}\]])", f"$1{SECRET_MARK}"),
)


def narrow(text: Column) -> Column:
    """Full-width ASCII to plain; the exact normal form is :func:`nfkc`."""
    return F.when(text.rlike("[！-～　]"), F.translate(text, WIDE, NARROW)).otherwise(text)


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """NFKC and strip, for stored terms; the hot paths use :func:`narrow`."""
    return text.map(lambda t: None if t is None else t if t.isascii() else unicodedata.normalize("NFKC", t).strip())


@F.pandas_udf(T.StringType())
def folded(text: pd.Series) -> pd.Series:
    """NFKC, casefold, single spaces: the key under which terms and entities are equal."""
    return text.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()))


def tokens(text: Column) -> Column:
    """Lower-case runs of Latin letters and digits, then single and paired characters of each Chinese run."""
    latin = lambda low: F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0))
    low = F.lower(narrow(text))
    runs = F.regexp_extract_all(low, F.lit("[一-鿿]+"), F.lit(0))
    ones = lambda run: F.transform(F.sequence(F.lit(1), F.length(run)), lambda i: F.substr(run, i, F.lit(1)))
    pairs = lambda run: F.when(F.length(run) > 1, F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substr(run, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    wide = F.when(low.rlike("[一-鿿]"), F.concat(latin(low), F.flatten(F.transform(runs, lambda r: F.concat(ones(r), pairs(r)))))).otherwise(latin(low))
    # Text of one byte a character has nothing to narrow and no Chinese.
    plain = F.octet_length(text) == F.length(text)
    return F.when(text.isNull(), F.array().cast("array<string>")).when(plain, latin(F.lower(text))).otherwise(wide)


def utf8_bytes(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit("")))


def token_estimate(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded up, at least one."""
    return F.greatest(F.lit(1), F.floor((utf8_bytes(text) + 3) / 4)).cast("long")


def compact(text: Column, most: int) -> Column:
    """At most ``most`` characters of the single-spaced text, cut with an ellipsis."""
    one = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(one) > most, F.concat(F.rtrim(F.substring(one, 1, most - 1)), F.lit("…"))).otherwise(one)


def join_tags(tags: Column) -> Column:
    """Non-empty trimmed tags, space-joined."""
    trimmed = F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.trim(t))
    return F.array_join(F.filter(trimmed, lambda t: t.isNotNull() & (t != "")), " ")


def redact(text: Column) -> Column:
    """Credential values replaced, what surrounds them kept: bearer values, keys, signed tokens, assignments."""
    for pattern, to in CREDENTIAL_TEXT:
        text = F.regexp_replace(text, pattern, to)
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", " ")


def has_relative_time(text: Column) -> Column:
    return F.coalesce(text.rlike("|".join(RELATIVE_TIME_WORDS)), F.lit(False))


def valid_kind(kind: Column) -> Column:
    """A lower-case dotted path of at least two segments and at most 160 characters."""
    return F.coalesce((F.length(kind) <= 160) & kind.rlike(r"^[a-z0-9_-]+(\.[a-z0-9_-]+)+$"), F.lit(False))


def kind_prefixes(kind: Column) -> Column:
    """Every dotted prefix of a kind, itself included."""
    parts = F.split(F.lower(F.trim(kind)), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))


def speaker_label(name: Column) -> Column:
    """A display name without control and structural characters, at most 80 characters."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"[\x00-\x1F\x7F\[\]{}<>|:：`]", " "), r"\s+", " "))
    return F.trim(F.substring(bare, 1, 80))


def valid_channel(channel: Column) -> Column:
    return F.coalesce(channel.rlike(r"^[a-z][a-z0-9_-]{0,31}$"), F.lit(False))


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x.cast("double"), F.lit(0.0))))


def distinct_terms(terms: Column) -> Column:
    """Terms in order, blanks out, one for each case-insensitive spelling, the first spelling kept."""
    clean = F.filter(F.transform(F.coalesce(terms, F.array().cast("array<string>")), lambda t: F.trim(F.regexp_replace(t, r"\s+", " "))), lambda t: t.isNotNull() & (t != ""))
    keys = F.transform(clean, lambda t: F.lower(t))
    return F.filter(clean, lambda t, i: F.array_position(keys, F.lower(t)) == i + 1)


def topics_without_entities(topics: Column, entities: Column) -> Column:
    keys = F.transform(distinct_terms(entities), lambda t: F.lower(t))
    return F.filter(distinct_terms(topics), lambda t: ~F.array_contains(keys, F.lower(t)))


def keyword_witness(pool: Column, query: Column) -> Column:
    """The stored term equal to the query but for case, else the first that contains it, else null."""
    key = F.lower(query)
    exact = F.get(F.filter(pool, lambda t: F.lower(t) == key), F.lit(0))
    return F.coalesce(exact, F.get(F.filter(pool, lambda t: F.contains(F.lower(t), key)), F.lit(0)))
