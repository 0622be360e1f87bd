"""Unit-aware parsing of specification values, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from forecourt.functions import fixed

WHOLE = r"(\d+)"
DECIMAL = r"([\d.]+)"
GROUPED = r"(\d+(?:\.\d+)?)"


def _found(text: Column, pattern: str, kind: str, group: int = 1) -> Column:
    return F.regexp_extract(text, "(?i)" + pattern, group).try_cast(kind)


def _plain(text: Column) -> Column:
    """Text without thousands commas."""
    return F.regexp_replace(text, r"(?<=\d),(?=\d{3})", "")


def _rounded(text: Column, pattern: str) -> Column:
    return _found(_plain(text), pattern, "double").cast("int")


def value_and_unit(raw: Column) -> Column:
    """Split a value into number, text and unit: ``4,983 mm`` is (4983, null, 'mm'), ``Petrol`` has only text."""
    text = F.trim(raw)
    pattern = r"^\s*([\d.,]+)\s*([^\d\s].*)?$"
    matched = F.rlike(text, F.lit(pattern))
    digits = F.translate(F.regexp_extract(text, pattern, 1), ",", "")
    number = digits.try_cast("double")
    unit = F.trim(F.substring_index(F.regexp_extract(text, pattern, 2), "@", 1))
    unit = F.nullif(F.regexp_replace(unit, r"[.,;:]+$", ""), F.lit(""))
    empty = F.coalesce(raw, F.lit("")) == ""
    return F.struct(
        F.when(matched & ~empty, number).alias("value_num"),
        F.when(empty, F.lit(None).cast("string")).when(~matched, text)
        .when(number.isNull(), digits).alias("value_text"),
        F.when(matched & ~empty, unit).alias("unit"),
    )


def power(text: Column) -> Column:
    return F.struct(
        _found(text, WHOLE + r"\s*kw", "int").alias("kw"),
        _found(text, WHOLE + r"\s*hp", "int").alias("hp"),
        _found(text, WHOLE + r"\s*bhp", "int").alias("bhp"),
        _found(text, r"@\s*(\d+)\s*rpm", "int").alias("rpm"),
    )


def torque(text: Column) -> Column:
    span = r"@\s*(\d+)[-–](\d+)\s*rpm"
    single = _found(text, r"@\s*(\d+)\s*rpm", "int")
    return F.struct(
        _found(text, WHOLE + r"\s*lb[- ]ft", "int").alias("lb_ft"),
        _found(text, WHOLE + r"\s*nm", "int").alias("nm"),
        F.coalesce(_found(text, span, "int", 1), single).alias("rpm_min"),
        F.coalesce(_found(text, span, "int", 2), single).alias("rpm_max"),
    )


def dimension(text: Column) -> Column:
    return F.struct(
        _rounded(text, GROUPED + r"\s*mm").alias("mm"),
        _found(_plain(text), DECIMAL + r"\s*in", "double").alias("in"),
    )


def fuel_economy(text: Column) -> Column:
    return F.struct(
        _found(text, DECIMAL + r"\s*mpg", "double").alias("mpg"),
        _found(text, DECIMAL + r"\s*l/100", "double").alias("l_100km"),
    )


def fuel_capacity(text: Column) -> Column:
    return F.struct(
        _found(text, DECIMAL + r"\s*l\b", "double").alias("l"),
        _found(text, DECIMAL + r"\s*gal", "double").alias("gal"),
    )


def weight(text: Column) -> Column:
    return F.struct(
        _rounded(text, GROUPED + r"\s*kg").alias("kg"),
        _rounded(text, GROUPED + r"\s*lbs?").alias("lbs"),
    )


def speed(text: Column) -> Column:
    """Top speed in both units, from the given one; a number without unit is in km/h."""
    plain = _plain(text)
    mph = _found(plain, GROUPED + r"\s*mph", "double")
    kph = _found(plain, GROUPED + r"\s*(?:km/h|kph|kmh|km/hr)", "double")
    bare = F.when(mph.isNull() & kph.isNull(), _found(plain, r"^\s*" + GROUPED, "double"))
    metric = F.coalesce(kph, bare)
    return F.struct(
        F.coalesce(metric, mph / F.lit(fixed.MPH_PER_KPH)).cast("int").alias("kph"),
        F.coalesce(mph, metric.cast("int") * F.lit(fixed.MPH_PER_KPH)).cast("int").alias("mph"),
    )


def normal_key(text: Column) -> Column:
    """Specification name as a key: lower case, blanks to underscores, no colons or parentheses."""
    return F.regexp_replace(F.translate(F.lower(F.trim(text)), " :()", "_"), "_+$", "")


def normal_category(heading: Column, block: Column) -> Column:
    """Heading above a block as a key, or its number on the page."""
    given = F.replace(F.lower(F.trim(heading)), F.lit(" "), F.lit("_"))
    return F.when(F.coalesce(heading, F.lit("")) != "", given).otherwise(F.concat(F.lit("block_"), block.cast("string")))


def year_span(name: Column) -> Column:
    """Production years in a generation name; an open end is null."""
    pattern = r"(\d{4})-(\d{4}|present)"
    return F.struct(
        F.regexp_extract(name, pattern, 1).try_cast("int").alias("start_year"),
        F.regexp_extract(name, pattern, 2).try_cast("int").alias("end_year"),
    )


def title_parts(title: Column) -> Column:
    """Brand, model and generation of a page title such as ``Brand Model (Generation) ...``."""
    pattern = r"^(.*?)\s(.*?)\s\((.*?)\)"
    part = lambda i: F.when(F.rlike(title, F.lit(pattern)), F.regexp_extract(title, pattern, i))
    return F.struct(part(1).alias("brand"), part(2).alias("model"), part(3).alias("generation"))


def version_name(heading: Column, anchor: Column, number: Column) -> Column:
    """Heading above the block, else the words of its anchor, else its number."""
    words = F.replace(F.replace(anchor, F.lit("aeng_"), F.lit("")), F.lit("-"), F.lit(" "))
    return F.coalesce(
        F.nullif(heading, F.lit("")), title_case(F.nullif(words, F.lit(""))),
        F.concat(F.lit("Version "), number.cast("string")),
    )


def title_case(text: Column) -> Column:
    """First letter of every run of letters in upper case, the others in lower case."""
    pieces = F.regexp_extract_all(text, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    cased = F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, F.lit(2), F.length(p)))))
    return F.array_join(cased, "")


def anchored(url: Column, anchor: Column) -> Column:
    return F.concat(url, F.coalesce(F.concat(F.lit("#"), anchor), F.lit("")))


def leading_int(text: Column) -> Column:
    """First number of a text with all separators removed: ``1,825 kg`` is 1825, ``4.4 L`` is 44."""
    return F.regexp_replace(F.regexp_extract(text, r"[\d.,]+", 0), "[.,]", "").try_cast("int")


def leading_float(text: Column) -> Column:
    """First number of a text, a comma read as the decimal point."""
    return F.translate(F.regexp_extract(text, r"[\d.,]+", 0), ",", ".").try_cast("double")
