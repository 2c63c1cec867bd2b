"""User names as they appear in prompts, and their pseudonyms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelore.functions.text import is_blank

# Fixed value: what a user name may consist of; the first such run is kept.
_NAME = "[a-zA-Z0-9_-]+"


def clean_username(username: Column) -> Column:
    """First run of legal characters (maybe none); blank and null stay as they are."""
    kept = F.regexp_extract(username, _NAME, 0)
    return F.when(is_blank(username), username).otherwise(kept)


def pseudonym(username: Column) -> Column:
    """Upper-case hex SHA-256 of the UTF-8 name; null for null."""
    return F.upper(F.sha2(F.encode(username, "UTF-8"), 256))
