"""Texts of paged and structured files, from tables of what was extracted of them."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from io import BytesIO
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .readers import DOCX_MOST_BYTES

MARKER = r"(?i)<!--\s*Page\s+(\d+)\s*-->"


def page_spans(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, page, start, end, content of a text cut by <!-- Page n --> markers.

    Places are those of the text without its markers.  What stands before the first marker belongs to no page; a text without markers
    is page 1, trimmed.  Null texts have no pages.
    """
    bare = docs.filter(F.col(text).isNotNull() & ~F.col(text).rlike(MARKER)).select(key, F.lit(1).alias("page"), F.lit(0).cast("long").alias("start"), F.regexp_replace(text, r"\A\s+|\s+\z", "").alias("content"))
    bare = bare.select(key, "page", "start", (F.col("start") + F.char_length("content")).alias("end"), "content")
    numbers = F.regexp_extract_all(F.col(text), F.lit(MARKER), 1)
    cut = docs.filter(F.col(text).rlike(MARKER)).select(key, numbers.alias("_numbers"), F.posexplode(F.split(text, MARKER, -1)).alias("_at", "content"))
    end = F.sum(F.char_length("content").cast("long")).over(Window.partitionBy(key).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    cut = cut.withColumn("end", end).filter("_at > 0").withColumn("page", F.get("_numbers", F.col("_at") - 1).cast("int"))
    return bare.unionByName(cut.select(key, "page", (F.col("end") - F.char_length("content")).alias("start"), "end", "content"))


def pdf_text(mode: str = "auto", embedded: str = "embedded_text", review: str = "needs_review", arabic: str = "arabic", ocr: str = "ocr_text") -> Column:
    """struct(text, tier) of an extraction row.

    The embedded text where it is good; where it is mostly Arabic it stays (tier deferred), since recognition garbles it; otherwise the
    recognised text.  With mode auto a poor embedded text is better than none, with ocr_preferred it isn't; embedded_only never
    looks further.  No text: tier null.
    """
    e, o = F.col(embedded), F.col(ocr)
    pick = lambda c, tier: F.struct(c.alias("text"), F.lit(tier).alias("tier"))
    there = e.isNotNull()
    if mode == "embedded_only":
        return F.when(there, pick(e, "embedded")).otherwise(pick(F.lit(None).cast("string"), None))
    good = there & (e != "") & ~F.coalesce(F.col(review), F.lit(False))
    out = F.when(good, pick(e, "embedded")).when(there & F.coalesce(F.col(arabic), F.lit(False)), pick(e, "deferred")).when(o.isNotNull(), pick(o, "ocr"))
    if mode == "auto":
        out = out.when(there, pick(e, "embedded"))
    return out.otherwise(pick(F.lit(None).cast("string"), None))


W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_blocks(content: bytes | None) -> list[tuple[str, int | None]] | None:
    """Paragraphs of a DOCX file that aren't blank, with their heading's level; null if it isn't one or is too large."""
    if content is None or len(content) > DOCX_MOST_BYTES:
        return None
    try:
        root = ElementTree.fromstring(zipfile.ZipFile(BytesIO(content)).read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    out = []
    for p in root.iter(W + "p"):
        text = "".join("\n" if t.tag == W + "br" else t.text or "" for t in p.iter() if t.tag in (W + "t", W + "br")).strip()
        style = p.find(f"{W}pPr/{W}pStyle")
        level = re.fullmatch(r"(?i)heading\s*([1-6])", style.get(W + "val", "")) if style is not None else None
        if text:
            out.append((text, int(level.group(1)) if level else None))
    return out


def with_blocks(files: DataFrame, content: str = "content") -> DataFrame:
    """files with text (paragraphs with an empty line between), headings (title, level, start, end in it) and needs_review."""

    @F.arrow_udf("array<struct<text:string,level:int>>")
    def blocks(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("text", pa.string()), ("level", pa.int32())]))
        for b in batches:
            found = (docx_blocks(x.as_py()) for x in b)
            yield pa.array([None if f is None else [{"text": t, "level": n} for t, n in f] for f in found], kind)

    rows = files.withColumn("_blocks", blocks(F.col(content)))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<title:string,level:int,start:bigint,end:bigint>>").alias("found"))
    step = lambda s, b: F.struct((s["at"] + F.char_length(b["text"]) + 2).alias("at"), F.when(b["level"].isNull(), s["found"]).otherwise(F.concat(s["found"], F.array(F.struct(b["text"].alias("title"), b["level"].alias("level"), s["at"].alias("start"), (s["at"] + F.char_length(b["text"])).alias("end"))))).alias("found"))
    text = F.array_join(F.transform("_blocks", lambda b: b["text"]), "\n\n")
    return rows.select(*files.columns, text.alias("text"), F.aggregate("_blocks", start, step)["found"].alias("headings"), (F.coalesce(text, F.lit("")) == "").alias("needs_review"))


def read_structured_docx(spark: SparkSession, path: str) -> DataFrame:
    """src, text, headings, needs_review of DOCX files."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("src"), "content")
    return with_blocks(files).drop("content")
