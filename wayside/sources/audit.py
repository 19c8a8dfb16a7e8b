"""File lineage, bundle verification, archives and import run logs."""

from __future__ import annotations

import io
import tarfile
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayside.functions.text import non_blank

# fixed values: unpack limits
MAX_ENTRY_BYTES = 64 * 1024 * 1024
MAX_TOTAL_BYTES = 256 * 1024 * 1024
FORMATS = ("csv", "ndjson")


def file_audit(spark: SparkSession, paths: list[str] | str, header_ext: str = ".csv") -> DataFrame:
    """sha256, size and row count of each file.

    The row count comes from a line scan split over tasks, not from the file
    bytes; a header line of CSV files and blank lines do not count.
    """
    files = spark.read.format("binaryFile").load(paths).select(
        F.col("path"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("checksum_sha256")
    )
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("path"))
    counted = lines.where(non_blank("value").isNotNull()).groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    rows = F.coalesce("n", F.lit(0).cast("long"))
    rows = F.when(F.col("path").endswith(header_ext), F.greatest(rows - 1, F.lit(0).cast("long"))).otherwise(rows)
    joined = files.withColumn("path", F.regexp_replace("path", "^file:/+", "file:/")).join(
        counted.withColumn("path", F.regexp_replace("path", "^file:/+", "file:/")), "path", "left"
    )
    return joined.select(
        "path", F.element_at(F.split("path", "/"), -1).alias("file_name"), "size_bytes", "checksum_sha256",
        rows.alias("row_count"), F.lit("staged").alias("status"),
    )


def verify_bundle(manifest: DataFrame, audit: DataFrame) -> DataFrame:
    """Manifest rows against the files found; ``reason`` is null when they agree.

    manifest: logical_name, path, format, checksum_sha256, row_count.
    audit: path, checksum_sha256, row_count.
    """
    c = F.col
    names = manifest.groupBy("logical_name").agg(F.count(F.lit(1)).alias("_names"))
    paths = manifest.groupBy("path").agg(F.count(F.lit(1)).alias("_paths"))
    listed = manifest.join(names, "logical_name", "left").join(paths, "path", "left")
    found = audit.select("path", c("checksum_sha256").alias("actual_checksum"), c("row_count").alias("actual_rows"), F.lit(True).alias("_found"))
    both = listed.join(found, "path", "full")
    reason = F.coalesce(
        F.when(c("format").isNull() & c("_found"), F.lit("file is not listed")),
        F.when(non_blank("logical_name").isNull(), F.lit("empty logical_name")),
        F.when(c("_names") > 1, F.lit("duplicate logical_name")),
        F.when(non_blank("path").isNull(), F.lit("empty path")),
        F.when(c("_paths") > 1, F.lit("duplicate path")),
        F.when(~c("format").isin(*FORMATS), F.lit("unsupported format")),
        F.when(c("_found").isNull(), F.lit("missing file")),
        F.when(c("checksum_sha256") != c("actual_checksum"), F.lit("checksum mismatch")),
        F.when(c("row_count") != c("actual_rows"), F.lit("row_count mismatch")),
    )
    return both.select("logical_name", "path", "checksum_sha256", "actual_checksum", "row_count", "actual_rows", reason.alias("reason"))


def _read_capped(stream, budget: int) -> bytes:
    data = stream.read(min(MAX_ENTRY_BYTES, budget) + 1)
    if len(data) > MAX_ENTRY_BYTES or len(data) > budget:
        raise ValueError("archive entry exceeds unpack size limits")
    return data


def _members(name: str, content: bytes):
    """Yield (member, opener) of a zip, tar or tar.gz file."""
    if name.endswith(".zip"):
        archive = zipfile.ZipFile(io.BytesIO(content))
        for info in archive.infolist():
            if not info.is_dir():
                yield info.filename, (lambda i=info: archive.open(i))
    else:
        archive = tarfile.open(fileobj=io.BytesIO(content), mode="r:*")
        for info in archive:
            if info.isfile():
                yield info.name, (lambda i=info: archive.extractfile(i))


ARCHIVE_ROWS = "path string, member string, content binary, size_bytes long, reason string"


def expand_archives(spark: SparkSession, paths: list[str] | str, members: DataFrame | None = None) -> DataFrame:
    """Archive members as rows, one archive per task at a time.

    ``members`` (file_name, checksum_sha256, member?) names the archives that
    are expected: an archive whose checksum differs gives one row with a
    reason, a listed member that is absent gives one, too.  Limits: 64 MiB per
    entry, 256 MiB per archive.
    """
    files = spark.read.format("binaryFile").load(paths).select("path", "content", F.sha2("content", 256).alias("actual"))
    files = files.withColumn("file_name", F.element_at(F.split("path", "/"), -1))
    if members is not None:
        wanted = members.groupBy("file_name").agg(
            F.first("checksum_sha256").alias("expected"), F.collect_set("member").alias("wanted")
        )
        files = files.join(wanted, "file_name")
    else:
        files = files.withColumns({"expected": F.col("actual"), "wanted": F.array().cast("array<string>")})

    def unpack(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                out = []
                if row.expected != row.actual:
                    out.append((row.path, None, None, None, "checksum mismatch"))
                else:
                    budget, seen, wanted = MAX_TOTAL_BYTES, set(), set(row.wanted)
                    try:
                        for member, opener in _members(row.file_name, row.content):
                            if wanted and member not in wanted:
                                continue
                            data = _read_capped(opener(), budget)
                            budget -= len(data)
                            seen.add(member)
                            out.append((row.path, member, data, len(data), None))
                    except (ValueError, tarfile.TarError, zipfile.BadZipFile) as error:
                        out = [(row.path, None, None, None, str(error))]
                    else:
                        out += [(row.path, m, None, None, "missing member") for m in sorted(wanted - seen)]
                yield pd.DataFrame(out, columns=["path", "member", "content", "size_bytes", "reason"])

    cols = ["path", "file_name", "content", "actual", "expected", "wanted"]
    return files.select(*cols).mapInPandas(unpack, ARCHIVE_ROWS)


def import_audit(
    run_id: Column, source_id: Column, files: DataFrame, rows: DataFrame, rejected: DataFrame, as_of: Column
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Run row, file rows and report rows of one import.

    A run with a rejected row has failed, and is kept as such.
    """
    ok = rows.agg(F.count(F.lit(1)).alias("normalized_rows"))
    bad = rejected.agg(F.count(F.lit(1)).alias("n")).scalar()
    run = ok.select(
        run_id.alias("id"), source_id.alias("source_id"), F.when(bad > 0, "failed").otherwise("succeeded").alias("status"),
        (F.col("normalized_rows") + bad).alias("total_rows"), "normalized_rows", as_of.alias("completed_at"),
    )
    file_rows = files.select(run_id.alias("import_run_id"), "path", "checksum_sha256", "size_bytes", "row_count", "status")
    done = ok.select(
        run_id.alias("import_run_id"), F.lit("info").alias("level"), F.lit("rows_normalized").alias("code"), F.lit("rows normalized").alias("message"),
        F.col("normalized_rows").alias("row_count"), as_of.alias("created_at"),
    )
    why = rejected.groupBy("reason").agg(F.count(F.lit(1)).alias("row_count")).select(
        run_id.alias("import_run_id"), F.lit("error").alias("level"), F.lit("row_rejected").alias("code"), F.col("reason").alias("message"), "row_count",
        as_of.alias("created_at"),
    )
    return run, file_rows, done.unionByName(why)
