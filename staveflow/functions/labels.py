"""Class names, categories and time signatures as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Category by the first of these parts of a lower-cased name.
CATEGORIES = (("notehead", "noteheads"), ("flag", "flags"), ("rest", "rests"), ("clef", "clefs"), ("key", "keys/accidentals"), ("accidental", "keys/accidentals"), ("timesig", "time signatures"))
# Signature and beats by the first of these parts of a lower-cased name.
SIGNATURES = (("timesigcommon", "4/4 (Common Time)", 4), ("timesig4", "4/4", 4), ("timesig3", "3/4", 3), ("timesig2", "2/4", 2), ("timesig6", "6/8", 6), ("timesig9", "9/8", 9), ("timesig12", "12/8", 12))
# Signature of a lone number.
BY_NUMBER = {4: "4/4", 3: "3/4", 2: "2/4", 6: "6/8", 9: "9/8", 12: "12/8"}
DEFAULT_BEATS = 4
# Classes of noteheads.
NOTEHEADS = ("noteheadBlackOnLine", "noteheadBlackInSpace", "noteheadHalfOnLine")


def category(name: Column, parts: tuple = CATEGORIES) -> Column:
    """The label of the first of the parts (part, label) that a name holds in any case; other without one."""
    low, out = F.lower(name), F.lit("other")
    for part, label in reversed(parts):
        out = F.when(low.contains(part), label).otherwise(out)
    return out


def signature(name: Column) -> Column:
    """struct(signature, beats): by known parts, else by the numbers in the name, else none and four beats."""
    low = F.lower(name)
    numbers = F.regexp_extract_all(low, F.lit(r"(\d+)"), F.lit(1))
    first = F.get(numbers, F.lit(0)).cast("int")
    make = lambda s, b: F.struct(F.lit(s).alias("signature") if not isinstance(s, Column) else s.alias("signature"), (F.lit(b) if not isinstance(b, Column) else b).cast("int").alias("beats"))
    out = make(F.lit(None).cast("string"), DEFAULT_BEATS)
    for n, s in BY_NUMBER.items():
        out = F.when((F.size(numbers) == 1) & (first == n), make(s, n)).otherwise(out)
    out = F.when(F.size(numbers) >= 2, make(F.concat_ws("/", F.get(numbers, F.lit(0)), F.get(numbers, F.lit(1))), first)).otherwise(out)
    for part, s, beats in reversed(SIGNATURES):
        out = F.when(low.contains(part), make(s, beats)).otherwise(out)
    return out


def first_filled(*cols: Column) -> Column:
    """The first value that is neither null nor an empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def first_true(*cols: tuple[Column, str]) -> Column:
    """The first value that counts as true, as text; cols are (column, kind) with kind text, number or list: '', 0 and empty lists are passed over."""
    empty = {"text": lambda c: c == "", "number": lambda c: c == 0, "list": lambda c: F.size(c) == 0}
    return F.coalesce(*[F.when(~empty[kind](c), F.to_json(c) if kind == "list" else c.cast("string")) for c, kind in cols])


def stamp(at: Column, iso: bool = False) -> Column:
    """A time as a folder's date (20250131), or in ISO form to the second."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss" if iso else "yyyyMMdd")


def is_notehead(name: Column) -> Column:
    """Whether a class is one of the three that stems are sought for."""
    return name.isin(*NOTEHEADS)


def stem(path: Column) -> Column:
    """File name without folder and last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
