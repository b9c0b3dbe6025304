"""Reading typed measurement entries and telling missing values from recorded ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slatework.functions import text

# Metres in one unit.
METRES_IN = {"m": 1.0, "ft": 0.3048, "yd": 0.9144, "cm": 0.01, "mm": 0.001}
#: Metres in an inch, and in a storey.
INCH_M = 0.0254
STOREY_M = 3.0
#: No building is taller than 115 m; half a decimetre more for values that were rounded in another unit.
TALLEST_M = 115.05

# Entries that stand for "not recorded", lower case, without blanks at the ends.
NOT_RECORDED = [
    "", "?", "??", "???", "-", "--", "n/a", "na", "n.a.", "none", "null", "nil", "nan", "unknown", "unk", "missing",
    "not measured", "not seen", "not recorded", "not known", "no data", "tbd",
]


def says_nothing(c: Column) -> Column:
    """True for null and for text that stands for "not recorded"."""
    return F.coalesce(F.lower(text.bare(c)).isin(NOT_RECORDED), F.lit(True))


def missing_number(c: Column) -> Column:
    """True for null, NaN, infinities and anything that is no positive amount (0, -1, -99, -9999...)."""
    return F.coalesce(F.isnan(c) | (c <= 0) | (c == float("inf")), F.lit(True))


_UNITS = [
    ("ft", r"(?:ft|feet|foot|pies?)(?![a-z])|['′’]"),
    ("cm", r"(?:cms?|centimet[a-z]*|centímet[a-z]*)(?![a-z])"),
    ("mm", r"(?:mm|millimet[a-z]*|milímet[a-z]*)(?![a-z])"),
    ("yd", r"(?:yds?|yards?)(?![a-z])"),
    ("m", r"(?:m|mts?|met(?:er|re|ro)s?)(?![a-z])"),
]


def height_unit(entry: Column) -> Column:
    """Unit named by a typed height (m, ft, yd, cm, mm), null if it names none."""
    e = F.lower(text.bare(entry))
    out = F.lit(None).cast("string")
    for unit, pattern in reversed(_UNITS):
        out = F.when(e.rlike(r"[0-9]\s*(?:" + pattern + ")"), F.lit(unit)).otherwise(out)
    return out


def entry_metres(entry: Column, unit: Column | None = None) -> Column:
    """Metres of a typed height that names its unit; feet may carry inches. Null otherwise. ``unit`` is that of ``height_unit``, if it is there already."""
    e = F.regexp_replace(F.lower(text.bare(entry)), r"([0-9]),([0-9])", "$1.$2")
    number = F.regexp_extract(e, r"([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    inches = F.regexp_extract(e, r"[0-9]\s*(?:ft|feet|foot|['′’])\.?\s*([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    unit = height_unit(entry) if unit is None else unit
    factor = F.create_map(*[F.lit(x) for kv in METRES_IN.items() for x in kv])
    return F.when(unit.isNotNull(), number * F.try_element_at(factor, unit) + F.coalesce(F.when(unit == "ft", inches * INCH_M), F.lit(0.0)))


def stories_form(entry: Column) -> Column:
    """How a typed storey count counts: ``above`` (ground floor left out), ``total``, ``metres``; null if it doesn't say."""
    e = F.lower(text.bare(entry))
    return (
        F.when(e.rlike(r"^(?:g|r|gf|eg|rc|rdc)\s*\+\s*[0-9]|ground floor|above ground|plus ground"), F.lit("above"))
        .when(e.rlike(r"[0-9]\s*(?:m|metres?|meters?|metros?)\b"), F.lit("metres"))
        .when(e.rlike(r"total|incl"), F.lit("total"))
    )


def entry_number(entry: Column) -> Column:
    """The first number in an entry, decimal commas allowed."""
    return F.regexp_extract(F.regexp_replace(entry, r"([0-9]),([0-9])", "$1.$2"), r"([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")


def note_height_unit(note: Column) -> Column:
    """Height unit described by a catalogue note."""
    n = F.lower(note)
    return (
        F.when(n.rlike(r"hundredths? of a met|centimet|\bcm\b"), F.lit("cm"))
        .when(n.rlike(r"thousandths? of a met|millimet|\bmm\b"), F.lit("mm"))
        .when(n.rlike(r"\bfeet\b|\bfoot\b|imperial|\bft\b"), F.lit("ft"))
        .when(n.rlike(r"\bmet(?:re|er)s?\b|metric"), F.lit("m"))
    )


def note_stories_basis(note: Column) -> Column:
    """Storey basis described by a catalogue note: ``above``, ``tenths`` or null."""
    n = F.lower(note)
    return F.when(n.rlike(r"tenths? of a (?:storey|story|floor|level)"), F.lit("tenths")).when(n.rlike(r"(?:street|ground)[^;.]* (?:is |are )?not counted|without (?:the )?ground|above (?:the )?ground"), F.lit("above"))
