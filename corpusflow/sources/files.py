"""SRC-3, SRC-5, SRC-6: landed page snapshots and uploaded documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions import text as tx
from corpusflow.settings import MAX_UPLOAD_BYTES, UPLOAD_EXTENSIONS


def utf8(content: Column) -> Column:
    """Bytes as text; malformed sequences become the replacement character."""
    return F.make_valid_utf8(content.cast("string"))


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """SRC-3: (id, content, bytes, fetched_at): one row per landed .html file, malformed UTF-8 replaced."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").load(path)
    return files.select(
        F.regexp_extract("path", r"([^/]+)\.html$", 1).alias("id"),
        utf8(F.col("content")).alias("content"),
        F.col("length").alias("bytes"), F.col("modificationTime").alias("fetched_at"))


def extension(path: Column) -> Column:
    return F.regexp_extract(F.lower(path), r"\.([^./\\]+)$", 1)


def classify_uploads(files: DataFrame) -> DataFrame:
    """SRC-5: files(path, length) gain ``extension`` and ``reason`` (null when accepted)."""
    ext = extension(F.col("path"))
    reason = (F.when(~ext.isin(*UPLOAD_EXTENSIONS), F.lit("unsupported type"))
              .when(F.col("length") > MAX_UPLOAD_BYTES, F.lit("too large")))
    return files.withColumn("extension", ext).withColumn("reason", reason)


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder with their upload decision; contents load only where they are used."""
    return classify_uploads(spark.read.format("binaryFile").load(path))


def docx_text(xml: Column) -> Column:
    """SRC-6, native part: text runs of a word/document.xml, or all text when it has no run."""
    runs = F.transform(F.regexp_extract_all(xml, F.lit(r"<w:t[^>]*>(.*?)</w:t>"), F.lit(1)), tx.decode_entities)
    stripped = tx.decode_entities(F.regexp_replace(xml, r"<[^>]+>", " "))
    return tx.collapse_ws(F.when(F.size(runs) > 0, F.array_join(runs, " ")).otherwise(stripped))


def _document_xml(files: DataFrame) -> DataFrame:
    def unzip(batches):
        import io
        import zipfile
        for pdf in batches:
            out = []
            for blob in pdf["content"]:
                try:
                    with zipfile.ZipFile(io.BytesIO(blob)) as z:
                        out.append(z.read("word/document.xml").decode("utf-8", "replace"))
                except (zipfile.BadZipFile, KeyError):
                    out.append(None)
            yield pdf.assign(xml=out)[["path", "xml"]]

    return files.select("path", "content").mapInPandas(unzip, "path string, xml string")


def extract_text(uploads: DataFrame) -> DataFrame:
    """SRC-6: (path, text, error) of accepted files(path, content, extension, reason).

    txt and md are decoded, docx is unpacked in Arrow batches and read with expressions.
    PDF decoding is not part of Spark: pass such files with a ``pdf_text`` column.
    """
    accepted = uploads.where(F.col("reason").isNull())
    plain = accepted.where(F.col("extension").isin("txt", "md")).select(
        "path", utf8(F.col("content")).alias("text"), F.lit(None).cast("string").alias("error"))
    xml = _document_xml(accepted.where(F.col("extension") == "docx"))
    docx = xml.select("path", docx_text(F.col("xml")).alias("text"),
                      F.when(F.col("xml").isNull(), "missing word/document.xml").alias("error"))
    ready = F.col("pdf_text") if "pdf_text" in uploads.columns else F.lit(None).cast("string")
    pdf = accepted.where(F.col("extension") == "pdf").select(
        "path", ready.alias("text"), F.when(ready.isNull(), "no extracted text for pdf").alias("error"))
    refused = uploads.where(F.col("reason").isNotNull()).select(
        "path", F.lit(None).cast("string").alias("text"), F.col("reason").alias("error"))
    return plain.unionByName(docx).unionByName(pdf).unionByName(refused)
