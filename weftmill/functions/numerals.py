"""Chapter numbers: Chinese and Roman numerals and the patterns around them, as Column expressions.

numerals="intended" reads the numbers as written; "compat" keeps what the extraction this engine replaces makes of them.
A numeral beyond 64 bits, or a volume beyond 32, is no number: null, and so 0 for a title.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
UNITS = {"十": 10, "百": 100, "千": 1000, "万": 10000}
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}
CHINESE = "0-9〇零一二三四五六七八九十百千两万"


def _look(table: dict[str, int], c: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[c]


def _chars(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def chinese(c: Column, compat: bool = False) -> Column:
    """A Chinese or Arabic numeral as a number; null where it is neither."""
    digit = lambda x: F.coalesce(_look(DIGITS, x), F.when(x.rlike("^[0-9]$"), x.try_cast("int")))
    chars = _chars(F.trim(c))
    zero = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(1).cast("long").alias("unit"))
    if compat:  # from the right; a unit forgets what came before it
        step = lambda s, x: F.when(_look(UNITS, x).isNotNull(), F.struct(F.lit(0).cast("long").alias("sum"), _look(UNITS, x).cast("long").alias("unit"))).otherwise(F.struct(F.try_add(s["sum"], F.coalesce(_look(DIGITS, x), F.lit(0)) * s["unit"]).alias("sum"), s["unit"].alias("unit")))
        folded = F.aggregate(F.reverse(chars), zero, step, lambda s: s["sum"])
    else:
        start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("held"), F.lit(False).alias("some"))
        unit = lambda x: _look(UNITS, x).cast("long")
        big = lambda s, x: F.struct(F.try_multiply(F.try_add(s["sum"], s["held"]), F.lit(10_000).cast("long")).alias("sum"), F.lit(0).cast("long").alias("held"), F.lit(False).alias("some"))
        small = lambda s, x: F.struct(F.try_add(s["sum"], F.try_multiply(F.when(s["some"], s["held"]).otherwise(F.lit(1).cast("long")), unit(x))).alias("sum"), F.lit(0).cast("long").alias("held"), F.lit(False).alias("some"))
        one = lambda s, x: F.struct(s["sum"].alias("sum"), F.try_add(F.try_multiply(s["held"], F.lit(10).cast("long")), digit(x).cast("long")).alias("held"), (F.coalesce(_look(DIGITS, x), F.lit(1)) > 0).alias("some"))
        folded = F.aggregate(chars, start, lambda s, x: F.when(x == "万", big(s, x)).when(unit(x).isNotNull(), small(s, x)).otherwise(one(s, x)), lambda s: F.try_add(s["sum"], s["held"]))
    return F.when(F.trim(c).rlike("^[0-9]+$"), F.trim(c).try_cast("long")).when(F.trim(c).rlike(f"^[{CHINESE}]+$"), folded)


def roman(c: Column) -> Column:
    """A Roman numeral by subtractive notation; 0 where another character occurs."""
    value = lambda x: _look(ROMAN, x).cast("long")
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("last"))
    step = lambda s, x: F.struct(F.when(value(x) < s["last"], s["sum"] - value(x)).otherwise(s["sum"] + value(x)).alias("sum"), F.greatest(value(x), s["last"]).alias("last"))
    folded = F.aggregate(F.reverse(_chars(F.upper(c))), start, step, lambda s: s["sum"])
    return F.when(F.upper(c).rlike("^[IVXLCDM]+$"), folded).otherwise(F.lit(0).cast("long"))


def chapter_number(title: Column, numerals: str = "intended") -> Column:
    """struct(number double, volume int) of a chapter title; zeros where it has none. Patterns are tried in order, the first that matches counts."""
    compat = numerals == "compat"
    n = f"([{CHINESE}]+)"
    volume = rf"第\s*{n}\s*卷.*?第\s*{n}\s*章"
    chapter = rf"第\s*{n}\s*章"
    english = r"(?i)chap(?:ter)?\.?\s*([0-9IVXLCDM]+)"
    leading = r"^\s*([0-9]+)\s*[.、]"
    alone = r"^\s*([IVXLCDM]+)\s*[:.、]?" if compat else r"^\s*([IVXLCDM]+)\s*(?:[:.、]|$)"
    take = lambda pattern, k=1: F.regexp_extract(title, pattern, k)
    word = take(english)
    arabic = F.when(word.rlike("^[0-9]+$"), F.lit(0).cast("long") if compat else word.try_cast("long")).otherwise(roman(word))
    number = (
        F.when(title.rlike(volume), chinese(take(volume, 2), compat))
        .when(title.rlike(chapter), chinese(take(chapter), compat))
        .when(title.rlike(english), arabic)
        .when(title.rlike(leading), take(leading).try_cast("long"))
        .when(title.rlike(alone), roman(take(alone)))
    )
    book = F.when(title.rlike(volume), chinese(take(volume), compat))
    return F.struct(F.coalesce(number, F.lit(0)).cast("double").alias("number"), F.coalesce(book.try_cast("int"), F.lit(0)).alias("volume"))
