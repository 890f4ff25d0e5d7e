"""Document folders and the item, chunk and vector tables on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.functions import text as X
from keepsake.operators.blocks import top_n
from keepsake.sources.capture import PREVIEW_CHARS, file_kind

# Fixed values.
NO_TEXT = "(未提取到文本)"


def read_text_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per text file: ``path``, ``body``."""
    return spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Path, size and kind of every file below a folder; file contents are not read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
            .select("path", "length", file_kind(F.col("path")).alias("kind")))


def split_supported(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents to ingest, and rejects with a reason. Spark's file scans skip empty files."""
    ok = F.col("kind") == "document"
    return files.filter(ok), files.filter(~ok).withColumn(
        "reason", F.concat(F.lit("unsupported kind "), F.col("kind")))


def document_items(docs: DataFrame, path: str = "path", body: str = "body") -> DataFrame:
    """Document rows to items: title = file stem, preview of the text, whole body kept."""
    stem = F.regexp_replace(F.regexp_replace(F.col(path), r"^.*[/\\]", ""), r"\.[^.]*$", "")
    return docs.withColumns({
        "id": F.xxhash64(path), "title": stem, "type": F.lit("doc"), "source_type": F.lit("file"),
        "source_ref": F.col(path),
        "content_text": F.coalesce(F.nullif(F.substring(body, 1, PREVIEW_CHARS), F.lit("")),
                                   F.lit(NO_TEXT))})


def chunk_rows(items: DataFrame, item_id: str = "id", body: str = "body",
               limit: int = X.MAX_CHUNK, max_chunks: int | None = None) -> DataFrame:
    """(item_id, seq, content): the whole body in chunks, one row each."""
    return items.select(F.col(item_id).alias("item_id"), F.posexplode(
        X.chunk_text(F.col(body), limit, max_chunks)).alias("seq", "content"))


def write_items_chunks(items: DataFrame, chunks: DataFrame, root: str, mode: str = "append") -> None:
    items.write.mode(mode).partitionBy("domain").parquet(f"{root}/items")
    chunks.write.mode(mode).parquet(f"{root}/chunks")


def newest_per_source(items: DataFrame, source_ref: str = "source_ref", id_: str = "id") -> DataFrame:
    """Re-captured sources keep their newest item. The long key is hashed before the shuffle."""
    return top_n(items.withColumn("_src", F.sha2(source_ref, 256)), ["_src"], [F.desc(id_)], 1).drop("_src")


def children_of(children: DataFrame, parents: DataFrame, key: str = "item_id", id_: str = "id") -> DataFrame:
    return children.join(parents.select(F.col(id_).alias(key)), key, "left_semi")


def upsert_vectors(old: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """New rows replace old rows of the same id, one row for each id: an anti join, old vectors are never sorted.

    Of new rows with the same id the one with the largest other columns (in their order) stays.
    """
    rest = [c for c in new.columns if c != key]
    last = new.groupBy(key).agg(F.max(F.struct(*rest)).alias("_row")).select(key, "_row.*")
    return old.join(last.select(key), key, "left_anti").unionByName(last, allowMissingColumns=True)
