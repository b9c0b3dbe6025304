"""File names, city names and other keys made of text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def stem(filename: Column) -> Column:
    """The name without folders and its last extension."""
    return F.regexp_replace(F.regexp_replace(filename, r"^.*[/\\]", ""), r"\.[^.]*$", "")


def uid(filename: Column) -> Column:
    """What follows the last ``pre_disaster_`` of a name without its ``.png``."""
    return F.element_at(F.split(F.regexp_replace(filename, r"\.png$", ""), "pre_disaster_"), -1)


def city_of(filename: Column) -> Column:
    """City of a file name: up to the first dash, else up to ``_height`` or ``_imsat``, words capitalised; else the stem as it is."""
    base = stem(filename)
    named = lambda part: F.initcap(F.replace(part, F.lit("_"), F.lit(" ")))
    before = lambda mark: F.element_at(F.split(base, mark), 1)
    return F.when(base.contains("-"), named(before("-"))).when(base.contains("height"), named(before("_height"))).when(base.contains("imsat"), named(before("_imsat"))).otherwise(base)


def image_name(place: Column, number: Column) -> Column:
    """File name of an image: the place up to its first comma, lower case, blanks as underscores, the number, ``.png``."""
    return F.concat(F.lower(F.replace(F.split_part(place, F.lit(","), F.lit(1)), F.lit(" "), F.lit("_"))), F.lit("_"), number.cast("string"), F.lit(".png"))


def city_key(city: Column) -> Column:
    """Key under which cities are compared: lower case, blanks as underscores, no commas."""
    return F.translate(F.lower(city), " ,", "_")


def split_label(split: Column) -> Column:
    """A split in lower case without blanks around it; ``unknown`` for null and empty."""
    return F.coalesce(F.nullif(F.trim(F.lower(split)), F.lit("")), F.lit("unknown"))


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Canonical composition; Spark has no such function."""
    return s.map(lambda v: unicodedata.normalize("NFC", v), na_action="ignore")


def capture(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null if there is none."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))
