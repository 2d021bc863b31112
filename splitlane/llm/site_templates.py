"""Main text of web pages, by removal of what a site repeats on its pages.

Every element's subtree is hashed, and Spark counts the hashes per host. A subtree is part
of the site's template when it recurs on at least ``LEAST_PAGES`` pages and ``LEAST_SHARE``
of the host's pages, or of those of one section (first folder of the path), among differing
neighbours. Adjacent recurring subtrees count as one, whose neighbours are what stands
before and after the run: all of an article that the site carries many times has none, and
stays. Template subtrees go, and
with them what HTML itself marks as furniture (menus, footers, forms, adverts and so on),
which a count cannot show on hosts with few pages.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitlane.llm.common import small_side, stored
from splitlane.llm.html_tree import hashed, main_text, neighbours, parse, subtrees

LEAST_PAGES = 10
LEAST_SHARE = 0.5
#: Of a template's pages, the share of differing neighbourhoods.
LEAST_CONTEXTS = 0.5
#: Parts that a large host's template list is repeated for, so that its pages spread.
SALTS = 16


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit(""))


def section_of(url: Column) -> Column:
    """The first folder of the path, if there is one."""
    return F.regexp_extract(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "^/+([^/]+)/", 1)


def beside(pages: DataFrame, url_col: str, html_col: str, lists: DataFrame) -> DataFrame:
    """``row``, ``host`` and the ``hashes`` of its host (or null) for every page."""
    salted = lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    size = lists.agg(F.sum(F.size("hashes"))).first()[0] or 0
    row = F.struct(*[F.col(f"`{c}`") for c in pages.columns])
    source = pages.select(
        row.alias("row"),
        host_of(F.col(url_col)).alias("host"),
        F.pmod(F.xxhash64(F.col(url_col), F.octet_length(F.col(html_col))), F.lit(SALTS)).cast("int").alias("salt"),
    )
    return source.join(small_side(salted, size * SALTS), ["host", "salt"], "left").select("row", "host", "hashes")


def recurring(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """``host`` and ``hashes`` of subtrees on enough pages of the host or of one section."""
    source = pages.select(
        host_of(F.col(url_col)).alias("host"), section_of(F.col(url_col)).alias("section"), F.col(html_col).alias("html")
    ).where("html is not null")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, keys = [], []
            for k, text in enumerate(batch.column(2)):
                root = parse(text.as_py())
                hashed(root)
                found = subtrees(root)
                at += [k] * len(found)
                keys += found
            places = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(places), batch.column(1).take(places), pa.array(keys, pa.int64())],
                names=["host", "section", "subtree"],
            )

    counted = source.mapInArrow(emit, "host string, section string, subtree long").groupBy("host", "section", "subtree").agg(F.count("*").alias("n"))
    sections = source.groupBy("host", "section").agg(F.count("*").alias("of"))
    hosts = sections.groupBy("host").agg(F.sum("of").alias("total"))
    enough = (F.col("n") >= LEAST_PAGES) & (F.col("n") >= LEAST_SHARE * F.col("of"))
    return (
        counted.join(sections, ["host", "section"])
        .groupBy("host", "subtree")
        .agg(F.sum("n").alias("n"), F.max(enough).alias("local"))
        .where(F.col("n") >= LEAST_PAGES)
        .join(hosts, "host")
        .where(F.col("local") | (F.col("n") >= LEAST_SHARE * F.col("total")))
        .groupBy("host")
        .agg(F.collect_list("subtree").alias("hashes"))
    )


def templates(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """``host`` and ``hashes`` of its template subtrees."""
    own = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html")).where("html is not null")
    joined = beside(own, "url", "html", stored(recurring(pages, url_col, html_col), "recurring")).where("hashes is not null")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, keys, sides = [], [], []
            texts, lists = batch.column(0).field(1), batch.column(2).to_pylist()
            for k, (text, hashes) in enumerate(zip(texts, lists, strict=True)):
                root = parse(text.as_py())
                hashed(root)
                found = neighbours(root, set(hashes))
                at += [k] * len(found)
                keys += found.keys()
                sides += found.values()
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).take(pa.array(at, pa.int64())), pa.array(keys, pa.int64()), pa.array(sides, pa.int64())],
                names=["host", "subtree", "sides"],
            )

    return (
        joined.mapInArrow(emit, "host string, subtree long, sides long")
        .groupBy("host", "subtree")
        .agg(F.count("*").alias("n"), F.approx_count_distinct("sides", 0.1).alias("contexts"))
        .where(F.col("contexts") >= LEAST_CONTEXTS * F.col("n"))
        .groupBy("host")
        .agg(F.collect_list("subtree").alias("hashes"))
    )


def extracted(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``row`` (the input columns) and ``out.text``, the main text, for every page.

    Character references are decoded, white space inside a block is one space, blocks are
    joined in page order by two newlines. Null and empty html give an empty text. Pages
    without a readable host count as one host of that name. Repeated rows count each.
    """
    joined = beside(pages, url_col, html_col, stored(templates(pages, url_col, html_col), "templates")).select("row", "hashes")
    place = pages.columns.index(html_col)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, lists = batch.column(0), batch.column(1).to_pylist()
            texts = []
            for text, hashes in zip(rows.field(place), lists, strict=True):
                root = parse(text.as_py() or "")
                if hashes:
                    hashed(root)
                texts.append(main_text(root, set(hashes or ())))
            out = pa.StructArray.from_arrays([pa.array(texts, pa.string())], names=["text"])
            yield pa.RecordBatch.from_arrays([rows, out], names=["row", "out"])

    kind = joined.schema["row"].dataType.simpleString()
    return joined.mapInArrow(extract, f"row {kind}, out struct<text:string>")
