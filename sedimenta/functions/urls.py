"""URLs as Columns."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _join(base: str | None, rel: str | None) -> str | None:
    if base is None or rel is None:
        return None
    try:
        return urljoin(base, rel)
    except ValueError:
        return rel


@F.pandas_udf(T.StringType())
def any_join(base: pd.Series, rel: pd.Series) -> pd.Series:
    """rel resolved against base, by the general rule; null if either is null."""
    return pd.Series([_join(None if pd.isna(b) else b, None if pd.isna(r) else r) for b, r in zip(base, rel)], dtype=object)


def join_rooted(base: Column, rel: Column) -> Column:
    """rel resolved against base without leaving the JVM, for a rel that is absolute or begins with one '/'; others give null."""
    origin = F.regexp_extract(base, r"^([a-zA-Z][\w+.-]*://[^/?#]*)", 1)
    return F.when(rel.rlike(r"^[a-zA-Z][\w+.-]*:"), rel).when(rel.startswith("/") & ~rel.startswith("//"), F.concat(origin, rel))


def origin(url: Column) -> Column:
    """Scheme and host, in lower case; null if there is no host."""
    return F.lower(F.nullif(F.regexp_extract(url, r"^([a-zA-Z][\w+.-]*://[^/?#]+)", 1), F.lit("")))


def unquoted(url_part: Column) -> Column:
    """Percent escapes resolved, '+' kept."""
    return F.coalesce(F.try_url_decode(F.replace(url_part, F.lit("+"), F.lit("%2B"))), url_part)


def path_and_query(url: Column) -> Column:
    """What robots rules look at: the path, or '/', and the query with its '?', percent escapes resolved."""
    rest = F.regexp_extract(url, r"^(?:[a-zA-Z][\w+.-]*:)?(?://[^/?#]*)?([^#]*)", 1)
    path, query = F.regexp_extract(rest, r"^([^?]*)", 1), F.regexp_extract(rest, r"\?(.*)$", 1)
    return F.concat(F.when(path == "", "/").otherwise(unquoted(path)), F.when(query == "", "").otherwise(F.concat(F.lit("?"), unquoted(query))))
