"""Expressions over paths, URIs and tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Where the documentation lives and how its topic is found in a URI.
SCHEME = "https://"
DOMAIN = "docs.ray.io"
TAG_PATTERN = r"docs\.ray\.io/en/latest/([^/]+)"


def path_to_uri(path: Column, scheme: str = SCHEME, domain: str = DOMAIN) -> Column:
    """Scheme, domain and whatever follows the last occurrence of the domain in the path."""
    return F.concat(F.lit(scheme + domain), F.substring_index(path, domain, -1))


def uri_page(uri: Column) -> Column:
    """The part before the anchor."""
    return F.split_part(uri, F.lit("#"), F.lit(1))


def uri_anchor(uri: Column) -> Column:
    """The part after the anchor sign; NULL if there is none."""
    return F.nullif(F.split_part(uri, F.lit("#"), F.lit(2)), F.lit(""))


def tag_of(uri: Column, pattern: str = TAG_PATTERN) -> Column:
    """The topic of a URI; NULL if the pattern does not match."""
    return F.nullif(F.split_part(F.regexp_extract(uri, pattern, 1), F.lit("#"), F.lit(1)), F.lit(""))
