"""Text columns: licences, years, cleaning, JSON, similarity."""

from __future__ import annotations

import difflib
import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import dims

_NOTICE = r"(?:[Ll]icensed? under|[Rr]eleased under) (?:the )?([^\n.]*(?:\.[0-9][^\n.]*)*)"


def license_notice(text: Column) -> Column:
    """The licence named in a notice such as 'Licensed under CC BY-NC 4.0.'; '' if there is none."""
    return F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), _NOTICE, 1))


def license_ok(name: Column) -> Column:
    n = F.trim(F.coalesce(name, F.lit("")))
    return (n != "") & n.rlike(f"(?i){dims.ALLOWED_LICENSE}") & ~n.rlike(f"(?i){dims.BLOCKED_LICENSE}")


def rights_ok(url: Column) -> Column:
    u = F.coalesce(url, F.lit(""))
    return u.rlike(f"(?i){dims.OPEN_RIGHTS}") & ~u.rlike(f"(?i){dims.BLOCKED_RIGHTS}")


def license_name(code: Column, version: Column) -> Column:
    c = F.lower(F.coalesce(code, F.lit("")))
    return F.when(c == "cc0", "CC0").when(c == "pdm", "Public domain").otherwise(F.trim(F.concat(F.lit("CC "), F.upper(c), F.lit(" "), F.coalesce(version, F.lit("")))))


def rights_name(url: Column) -> Column:
    u = F.lower(url)
    kind, version = (F.regexp_extract(u, r"licenses/(by(?:-sa)?)/(\d\.\d)", k) for k in (1, 2))
    return (
        F.when(u.contains("publicdomain/zero"), "CC0")
        .when(u.contains("publicdomain/mark"), "Public domain")
        .when(kind != "", F.concat(F.lit("CC "), F.upper(kind), F.lit(" "), version))
        .otherwise(url)
    )


def year_of(text: Column) -> Column:
    """The first 19xx or 20xx."""
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"((?:19|20)\d{2})", 1), F.lit("")).cast("int")


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", "")


@F.pandas_udf(T.StringType())
def unescape(text: pd.Series) -> pd.Series:
    return text.map(lambda t: html.unescape(t or "").strip())


def clean(text: Column) -> Column:
    return unescape(strip_tags(text))


@F.pandas_udf(T.DoubleType())
def text_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity over digits and lower-case letters; two empty texts are alike."""
    keep = re.compile(r"[^0-9a-z]")
    plain = lambda t: keep.sub("", (t or "").lower())
    return pd.Series([difflib.SequenceMatcher(None, plain(x), plain(y)).ratio() if plain(x) or plain(y) else 1.0 for x, y in zip(a, b, strict=True)])


def fenced_json(text: Column) -> Column:
    """The JSON inside a fenced block, or the text itself; null if it doesn't parse."""
    bare = F.regexp_replace(text, r"^[\s`]+|[\s`]+$", "")
    bare = F.regexp_replace(bare, r"^json\s*", "")
    return F.when(F.try_parse_json(bare).isNotNull(), bare)


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
