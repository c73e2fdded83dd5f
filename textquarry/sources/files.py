"""Files of submissions: which can be read, their kind, and their text.

``texts`` reads a folder with Spark's binaryFile source, so any store that Spark reaches will do.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.sources import docx, pdf

IMAGES = ("png", "jpg", "jpeg", "gif", "bmp", "tif", "tiff", "webp")


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))


def file_type(name: Column, mime: Column) -> Column:
    """pdf, docx, image or unsupported: by extension, else by MIME type; doc counts as docx."""
    ext, kind = extension(name), F.lower(F.coalesce(mime, F.lit("")))
    return (
        F.when(ext == "pdf", "pdf").when(ext.isin("docx", "doc"), "docx").when(ext.isin(*IMAGES), "image")
        .when(F.contains(kind, F.lit("pdf")), "pdf").when(F.contains(kind, F.lit("wordprocessingml")) | F.contains(kind, F.lit("msword")), "docx")
        .when(kind.startswith("image/"), "image").otherwise("unsupported")
    )


def supported(name: Column, mime: Column, ocr: bool = False) -> Column:
    """Whether a file can be read; images only where text recognition is available."""
    kind = file_type(name, mime)
    return kind.isin("pdf", "docx") | (F.lit(ocr) & (kind == "image"))


def capabilities() -> dict[str, bool]:
    """What this build reads. Recognition of images needs an outside program and is not part of it."""
    return {"docx": True, "pdf": True, "ocr": False}


_SCHEMA = "path string, method string, text string, error string, fields map<string,string>"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            ext = path.rsplit(".", 1)[-1].lower()
            content, text, error, fields, method = content or b"", None, None, {}, "none"
            try:
                if ext in ("docx", "doc"):
                    method, text, fields = "docx", docx.text_of(content), docx.fields_of(content)
                elif ext == "pdf":
                    method, text, fields = "pdf", pdf.text_of(content), pdf.fields_of(content)
                elif ext in IMAGES:
                    error = "text recognition is not available"
                else:
                    error = "unsupported file type"
            except Exception as e:  # noqa: BLE001 - a damaged file becomes a row with an error, not a failed job
                error = str(e) or type(e).__name__
            rows.append((path, method, text, error, list(fields.items())))
        kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()))
        columns = zip(*rows, strict=True) if rows else ((),) * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["path", "method", "text", "error", "fields"])


def extract(files: DataFrame) -> DataFrame:
    """path, method, text, error and metadata fields of files (path, content)."""
    return files.select("path", "content").mapInArrow(_extract, _SCHEMA)


def texts(spark: SparkSession, folder: str) -> DataFrame:
    return extract(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder))
