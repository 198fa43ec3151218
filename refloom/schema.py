"""Spark types of the bibliographic entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

NAME = "struct<family:string,given:string,dropping_particle:string,non_dropping_particle:string,suffix:string,literal:string>"
DATE = "struct<date_parts:array<array<int>>,season:string,circa:boolean,literal:string,raw:string>"
#: Text fields of an item besides id and type.
TEXT_FIELDS = (
    "title container_title container_title_short event_title publisher volume issue page number citation_number authority version genre DOI URL ISSN ISBN PMID PMCID abstract language original source_format"
).split()
ITEM_DDL = "ord long, id string, type string, author array<" + NAME + ">, issued " + DATE + ", accessed " + DATE + ", " + ", ".join(f"{f} string" for f in TEXT_FIELDS) + ", parse_confidence double, extra map<string,string>"
ISSUE_FIELDS = ["citation_id", "rule_id", "severity", "field", "message", "auto_fixable"]


def as_items(df: DataFrame) -> DataFrame:
    """Completes df to the item columns; missing ones are null."""
    want = StructType.fromDDL(ITEM_DDL)
    have = {c.lower() for c in df.columns}
    return df.select(*[(F.col(f.name) if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in want])


def is_blank(c: Column) -> Column:
    """Null or empty, without trimming."""
    return c.isNull() | (c == "")


def is_missing(c: Column) -> Column:
    return c.isNull()


def year_of(date: Column) -> Column:
    return F.get(F.get(date["date_parts"], 0), 0)


def first_author(author: Column) -> Column:
    a = F.get(author, 0)
    return F.coalesce(a["family"], a["literal"])


def uniquify(df: DataFrame, key: str = "id", order: str = "ord") -> DataFrame:
    """Repeated ids get -2, -3 and so on in order.  A made id that another row has already is told apart by a second suffix."""
    def once(d: DataFrame, sep: str) -> DataFrame:
        n = F.row_number().over(Window.partitionBy(key).orderBy(order))
        return d.withColumn(key, F.when(n == 1, F.col(key)).otherwise(F.concat(F.col(key), F.lit(sep), n.cast("string"))))

    return once(once(df, "-"), "-dup-")
