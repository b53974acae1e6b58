"""Documents of a corpus: a manifest of what is wanted, files as they were fetched, and texts decoded from them.

A document has up to two files: a web page, taken if it is long enough, or else a source package, which is a tar archive of
texts or one compressed text. Texts that a cache holds already aren't decoded again.
"""

from __future__ import annotations

import gzip
import io
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftglass.functions import text

# Sizes from which a page, a package and a cached text count, and the members of a package that are read.
LEAST_HTML, LEAST_PACKAGE, LEAST_CACHED, MEMBER_MOST = 20_000, 1000, 2000, 3_000_000
MEMBERS = (".tex", ".bbl", ".txt")
# End of fixed values.
UNPACKED_MOST = 200_000_000  # bytes that a package may unpack to; one that goes on beyond that counts as not readable
DECODED = "doc_id string, packed string, how string"


def manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records of a JSON list."""
    return spark.read.schema(schema).json(path, multiLine=True)


def files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, kind ('html' or 'package'), content of a folder of files named by document, pages with the ending .html."""
    rows = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.when(name.endswith(".html"), "html").otherwise("package")
    return rows.select(F.regexp_replace(name, r"(\.tar)?\.[A-Za-z]+$", "").alias("doc_id"), kind.alias("kind"), "content")


def unpacked(content: bytes | None, most: int = UNPACKED_MOST) -> tuple[str | None, str]:
    """The text of a source package, and how it was packed; nothing if it is too short, too large or not readable."""
    if content is None or len(content) <= LEAST_PACKAGE:
        return None, "fail"
    try:
        with tarfile.open(fileobj=io.BytesIO(content)) as archive:
            held = []
            for m in archive:
                if m.offset_data + m.size > most:  # before anything of it is unpacked
                    return None, "fail"
                if m.isfile() and m.name.lower().endswith(MEMBERS) and m.size < MEMBER_MOST:
                    held.append(archive.extractfile(m).read())
        return (" ".join(x.decode("utf-8", "ignore") for x in held), "package") if held else (None, "fail")
    except (tarfile.TarError, EOFError, OSError):
        try:
            with gzip.GzipFile(fileobj=io.BytesIO(content)) as file:
                text = file.read(most + 1)
            return (text.decode("utf-8", "ignore"), "compressed") if len(text) <= most else (None, "fail")
        except (OSError, EOFError):
            return None, "fail"


def packed(text: str) -> bytes:
    """A source package of one text: compressed, or as an archive with one member where that would be too short to count."""
    body, out = text.encode(), io.BytesIO()
    if len(body) > LEAST_PACKAGE:
        return gzip.compress(body, 0, mtime=0)
    with tarfile.open(fileobj=out, mode="w") as archive:
        about = tarfile.TarInfo("text.txt")
        about.size = len(body)
        archive.addfile(about, io.BytesIO(body))
    return out.getvalue()


def pack_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc_id, text_ in zip(batch.column("doc_id"), batch.column("text")):
            yield pa.RecordBatch.from_arrays([pa.array([doc_id.as_py()], pa.string()), pa.array(["package"]), pa.array([packed(text_.as_py() or "")])], names=["doc_id", "kind", "content"])


def as_packages(docs: DataFrame) -> DataFrame:
    """doc_id, kind, content of docs(doc_id, text): what `decoded` reads."""
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(pack_batches, "doc_id string, kind string, content binary")


def unpack_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc_id, content in zip(batch.column("doc_id"), batch.column("content")):
            made, how = unpacked(content.as_py())
            yield pa.RecordBatch.from_arrays([pa.array([doc_id.as_py()]), pa.array([made], pa.string()), pa.array([how])], names=["doc_id", "packed", "how"])


def decoded(rows: DataFrame, least_html: int = LEAST_HTML) -> DataFrame:
    """doc_id, text, how ('html', 'package', 'compressed' or 'fail') of rows(doc_id, kind, content)."""
    pages = rows.where("kind = 'html'").select("doc_id", F.decode("content", "utf-8").alias("html")).where(F.length("html") > least_html)
    pages = pages.select("doc_id", text.strip_html(F.col("html")).alias("page"))
    packages = rows.where("kind = 'package'").join(pages.select("doc_id"), "doc_id", "left_anti").select("doc_id", "content")
    packages = packages.mapInArrow(unpack_batches, DECODED)
    out = rows.select("doc_id").distinct().join(pages, "doc_id", "left").join(packages, "doc_id", "left")
    body = F.coalesce("page", F.regexp_replace("packed", r"(?U)\s+", " "))
    return out.select("doc_id", body.alias("text"), F.when(F.col("page").isNotNull(), "html").otherwise(F.coalesce("how", F.lit("fail"))).alias("how"))


def read_through(wanted: DataFrame, cache: DataFrame, fetch) -> DataFrame:
    """doc_id, text, how of wanted(doc_id): from cache(doc_id, text) where its text is long enough, from fetch(the rest) otherwise."""
    held = wanted.join(cache.where(F.octet_length("text") > LEAST_CACHED), "doc_id").select("doc_id", "text", F.lit("cached").alias("how"))
    return held.unionByName(fetch(wanted.join(held.select("doc_id"), "doc_id", "left_anti")))


def accounting(fetched: DataFrame) -> DataFrame:
    """how, documents: how many documents came in each way, or failed."""
    return fetched.groupBy("how").agg(F.count("*").alias("documents"))
