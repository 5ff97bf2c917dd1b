"""Places and dates in texts."""

from __future__ import annotations

import datetime
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

# Labels of places, and provinces.
PLACE_LABEL = r"(?:项目地点|工程地点|建设地点|建设地址|会议地点)[：:\s]*([^\n。，]{2,60})"
PLACE_PHRASE = r"(?:项目位于|工程位于|本工程位于|本工程地处|地处|施工范围为)[：:\s]*([^\n。，]{2,80})"
PROVINCES = "江苏|浙江|广东|山东|湖北|四川|安徽|福建|河南|湖南|河北|陕西|辽宁|吉林|黑龙江|江西|山西|甘肃|云南|贵州|海南|青海|台湾|广西|内蒙古|宁夏|新疆|西藏|北京|上海|天津|重庆"
#: Year whose calendar dates without year follow.
CALENDAR = 2023
RANGE = re.compile(r"(\d{1,2})月(\d{1,2})日\s*([-~～至到])\s*(\d{1,2})日")
DATE = re.compile(r"(\d{1,2})月(\d{1,2})日")


def places(texts: DataFrame, key: str, text: str, cities: DataFrame) -> DataFrame:
    """Places that texts give, by label or else by phrase: key, place, province, city.

    The province is the one named, else that of the first listed city in the place; cities: (city, province).
    """
    found = F.coalesce(F.nullif(F.regexp_extract(text, PLACE_LABEL, 1), F.lit("")), F.nullif(F.regexp_extract(text, PLACE_PHRASE, 1), F.lit("")))
    rows = texts.select(key, F.trim(found).alias("place")).filter("place is not null")
    held = rows.join(F.broadcast(cities), F.col("place").contains(F.col("city"))).groupBy(key, "place").agg(F.min(F.struct(F.instr(F.col("place"), F.col("city")).alias("at"), "city", "province")).alias("c"))
    named = F.nullif(F.regexp_extract("place", f"({PROVINCES})", 1), F.lit(""))
    return rows.join(held, [key, "place"], "left").select(key, "place", F.coalesce(named, "c.province").alias("province"), F.col("c.city").alias("city"))


def _moved(month: str, day: str, days: int) -> str | None:
    try:
        date = datetime.date(CALENDAR, int(month), int(day)) + datetime.timedelta(days)
    except ValueError:
        return None
    return f"{date.month}月{date.day}日"


def shift_text(text: str, days: int) -> str:
    """A text with its dates of month and day moved; the second day of a short range gets its month first."""
    full = RANGE.sub(lambda m: f"{m[1]}月{m[2]}日{m[3]}{m[1]}月{m[4]}日", text)
    return DATE.sub(lambda m: _moved(m[1], m[2], days) or m[0], full)


def shifted(text: Column, days: int) -> Column:
    """shift_text over a column; null for null, dates that don't exist stay."""

    @F.pandas_udf(T.StringType())
    def shift(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else shift_text(t, days))

    return shift(text)
