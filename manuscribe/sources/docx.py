"""DOCX manuscripts as rows of runs, by Spark's binary file source and the standard library's XML reader."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUNS = "book string, para_idx int, run_idx int, text string, style string, highlight string, color string, strike boolean, underline boolean"
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def parse(data: bytes) -> Iterator[tuple]:
    """(para_idx, run_idx, text, style, highlight, color, strike, underline) of every run; a line break is U+000B."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
        names = {}
        if "word/styles.xml" in z.namelist():
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{W}style"):
                name = s.find(f"{W}name")
                names[s.get(f"{W}styleId")] = name.get(f"{W}val") if name is not None else None
    for i, p in enumerate(body.iter(f"{W}p")):
        style = p.find(f"{W}pPr/{W}pStyle")
        style = "Normal" if style is None else names.get(style.get(f"{W}val")) or style.get(f"{W}val")
        runs = list(p.iter(f"{W}r"))
        if not runs:
            yield i, 0, "", style, None, None, False, False
        for j, r in enumerate(runs):
            text = "".join({f"{W}t": x.text or "", f"{W}tab": "\t", f"{W}br": "\x0b"}.get(x.tag, "") for x in r)

            def prop(name: str, r=r) -> str | None:
                x = r.find(f"{W}rPr/{W}{name}")
                return None if x is None else x.get(f"{W}val", "true")

            on = lambda v: v is not None and v not in ("false", "0", "none")
            yield i, j, text, style, prop("highlight"), prop("color"), on(prop("strike")), on(prop("u"))


def runs(spark: SparkSession, path: str) -> DataFrame:
    """RUNS of all manuscripts at path, but fake.docx; book is the file's name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = [(name, *r) for r in parse(content.as_py())]
                if rows:
                    types = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in RUNS.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path)
    book = F.element_at(F.split("path", "/"), -1)
    return files.select(book.alias("book"), "content").filter("book <> 'fake.docx'").mapInArrow(run, RUNS)


def paragraphs(runs: DataFrame) -> DataFrame:
    """(book, para_idx, text, style) of runs."""
    g = runs.groupBy("book", "para_idx").agg(F.sort_array(F.collect_list(F.struct("run_idx", "text"))).alias("r"), F.first("style").alias("style"))
    return g.select("book", "para_idx", F.array_join(F.transform("r", lambda x: x["text"]), "").alias("text"), "style")
