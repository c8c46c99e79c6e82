"""Text functions: white space, tagged literals, links, keys, redaction."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode text processing has it (separators and the control characters that count).
SPACE = r"[\s\p{Z}\x1c-\x1f\x85]+"
#: Keys whose values are always masked, and those masked unless content may be shown. Fixed values.
SECRET_KEYS = ("password", "passwd", "secret", "token", "api_key", "apikey", "authorization", "credential", "credentials", "access_key", "private_key")
CONTENT_KEYS = ("content", "text", "label", "title", "navtitle", "source_label", "locale_label", "message", "source_content", "locale_content")
REDACTED = "[REDACTED]"


def collapsed(value: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(value, SPACE, " "))


def tagged(value: Column) -> Column:
    """A string column as a tagged literal; null stays null."""
    return F.concat(F.lit("s:"), value)


def plain(literal: Column) -> Column:
    """The text of a tagged literal."""
    return F.substring(literal, 3, 2**31 - 1)


def link(href: Column) -> Column:
    """A link without the ``./`` in front, however often it stands there."""
    return F.regexp_replace(F.trim(href), r"^(\./)+", "")


def key_list(keys: Column) -> Column:
    return F.filter(F.split(keys, SPACE), lambda x: x != "")


def redacted(props: Column, with_content: bool = False) -> Column:
    """A string map with the values of credential (and content) keys masked."""
    hidden = SECRET_KEYS if with_content else (*SECRET_KEYS, *CONTENT_KEYS)
    return F.transform_values(props, lambda k, v: F.when(F.lower(k).isin(*hidden), F.lit(REDACTED)).otherwise(v))


def redacted_json(value: Column, with_content: bool = False) -> Column:
    """A JSON text with such values masked in objects within objects, however deep; lists stay as they are.
    A text that is no JSON object is masked whole, null stays null."""
    hidden = frozenset(SECRET_KEYS if with_content else (*SECRET_KEYS, *CONTENT_KEYS))

    def masked(x):
        return {k: REDACTED if k.lower() in hidden else masked(v) for k, v in x.items()} if isinstance(x, dict) else x

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            x = json.loads(text)
            return json.dumps(masked(x), ensure_ascii=False, separators=(",", ":")) if isinstance(x, dict) else REDACTED
        except (ValueError, RecursionError):
            return REDACTED

    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return mask(value)


def safe_name(value: Column) -> Column:
    """A name for a folder or file; raises if nothing is left."""
    name = F.regexp_replace(F.regexp_replace(value, r"[^A-Za-z0-9._-]", "_"), r"^[._]+|[._]+$", "")
    return F.when(name == "", F.raise_error(F.lit("ARTIFACT_WRITE_FAILED: empty name"))).otherwise(name)
