"""Text and unit normalisation, value and clause tests, and content flags as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Spellings of units in the order they are replaced, and marks of deleted clauses.
UNITS = (("m²", "m2"), ("㎡", "m2"), ("m^2", "m2"), ("m^{2}", "m2"), ("m 2", "m2"), ("平方米", "m2"), ("m³", "m3"), ("㎥", "m3"), ("m^3", "m3"), ("m^{3}", "m3"), ("m 3", "m3"), ("立方米", "m3"), ("℃", "c"), ("°c", "c"), ("°C", "c"))
DELETED = ("本条删除", "本条已删除", "本条作废", "已废止")
#: Comparison words in front of a claimed value, in the order they are taken off.
COMPARISONS = ("不应大于", "不应小于", "不得大于", "不得小于", "不宜大于", "不宜小于", "不大于", "不小于", "大于", "小于", "不超过", "不少于", "≥", "≤", ">", "<")
#: Factors of units to their base unit.
FACTORS = {"mm": 0.001, "cm": 0.01, "m": 1.0, "km": 1000.0, "min": 60.0, "h": 3600.0, "d": 86400.0, "%": 0.01, "kN": 1000.0, "N": 1.0, "MPa": 1e6, "kPa": 1e3, "t": 1000.0, "kg": 1.0}


def unit_text(text: Column) -> Column:
    """Spellings of square and cubic metres and degrees in one form."""
    for old, new in UNITS:
        text = F.replace(text, F.lit(old), F.lit(new))
    text = F.regexp_replace(text, r"(?i)m\s*\^\s*\{?2\}?", "m2")
    text = F.regexp_replace(text, r"(?i)m\s*\^\s*\{?3\}?", "m3")
    return F.regexp_replace(text, r"(?i)(m)\s+([23])\b", "$1$2")


def plain_text(text: Column) -> Column:
    """Text without formula marks and white space, units in one form, in lower case."""
    text = F.replace(F.coalesce(text, F.lit("")), F.lit("\\mathrm"), F.lit(""))
    return F.lower(F.regexp_replace(unit_text(F.regexp_replace(text, r"[{}$]", "")), r"\s+", ""))


def condition_tokens(text: Column) -> Column:
    """Pieces of a condition of two signs or more."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[、，,；;或和/\s]+"), lambda t: F.length(t) >= 2)


def value_hit(plain: Column, value: Column, unit: Column) -> Column:
    """Whether a plain text holds a value with its unit, also without trailing zeros; true without a value."""
    v = F.replace(unit_text(F.coalesce(value, F.lit(""))), F.lit(" "), F.lit(""))
    short = F.when(v.contains("."), F.regexp_replace(F.regexp_replace(v, "0+$", ""), r"\.$", "")).otherwise(v)
    u = plain_text(unit)
    return (v == "") | plain.contains(F.concat(v, u)) | (short != "") & plain.contains(F.concat(short, u))


def has_clause(plain: Column, clause: Column) -> Column:
    """Whether a plain text names a clause; true without a number."""
    c = plain_text(clause)
    return (c == "") | plain.contains(c)


def fact_hit(text: Column, plain: Column, fact: Column) -> Column:
    """Whether a text holds a fact (fact, value, unit, condition): its words with its value, or value and any word of each."""
    words, value = plain_text(fact["fact"]), value_hit(plain, fact["value"], fact["unit"])
    any_of = lambda tokens: (F.size(tokens) == 0) | F.exists(tokens, lambda t: plain.contains(plain_text(t)))
    loose = value & any_of(condition_tokens(fact["fact"])) & any_of(condition_tokens(fact["condition"]))
    return F.when((words != "") & plain.contains(words), value).otherwise(loose)


def content_flags(text: Column) -> Column:
    """Whether a clause has a table, a formula, a quantity to check, a method, a demand, an appendix or is deleted."""
    deleted = F.lit(False)
    for mark in DELETED:
        deleted = deleted | text.contains(mark)
    return F.struct(
        (text.contains("<table") | text.rlike(r"表\s*\d")).alias("has_table"), (text.contains("$") | text.contains("式中")).alias("has_formula"),
        text.contains("检查数量").alias("has_quantity"), text.contains("检验方法").alias("has_method"), text.rlike("必须|严禁|不得").alias("is_strict"),
        text.contains("附录").alias("has_appendix"), deleted.alias("is_deleted"),
    )


def without_comparison(value: Column) -> Column:
    """A claimed value without the comparison in front of it."""
    return F.trim(F.regexp_replace(F.trim(value), "^(" + "|".join(COMPARISONS) + ")", ""))


def base_value(value: Column) -> Column:
    """A claimed value in its base unit; null without a number and a known unit."""
    number = F.regexp_extract(value, r"(\d+(?:\.\d+)?)\s*(mm|cm|km|kN|MPa|kPa|min|kg|m|h|d|%|N|t)", 1)
    unit = F.regexp_extract(value, r"(\d+(?:\.\d+)?)\s*(mm|cm|km|kN|MPa|kPa|min|kg|m|h|d|%|N|t)", 2)
    factor = F.try_element_at(F.create_map(*[F.lit(x) for kv in FACTORS.items() for x in kv]), unit)
    return number.try_cast("double") * factor


def claim_in_text(claim: Column, text: Column) -> Column:
    """Whether a clause holds a claimed value: as written, its number and unit apart, or another spelling within a hundredth."""
    bare = without_comparison(claim)
    number, unit = F.regexp_extract(bare, r"(\d+(?:\.\d+)?)", 1), F.trim(F.regexp_replace(bare, r"^[\d.\s]+", ""))
    apart = (number != "") & text.contains(number) & ((unit == "") | text.contains(unit))
    values = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?\s*(?:mm|cm|km|kN|MPa|kPa|min|kg|m|h|d|%|N|t))"), F.lit(1)), base_value)
    return text.contains(bare) | apart | F.coalesce(F.exists(values, lambda v: F.abs(v - base_value(bare)) < 0.01), F.lit(False))
