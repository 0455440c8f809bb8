"""Report files: guards, encoding classes, latest-file picks, scans and checksums."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cleaning import raw_text_flags
from ..functions.headers import as_written, clean_headers
from .configs import Source

# Columns that say where a row came from.
PLACE = ("source_file", "source_row")
FILE_DATE = r"(\d{4}-\d{2}-\d{2})"
# Bytes that have no character in Windows-1252; a file holding one is read as Latin-1.
NOT_WINDOWS = (0x81, 0x8D, 0x8F, 0x90, 0x9D)

# Reader options per encoding class. A UTF-16 file cannot be split at line ends, so it is one task per file.
READERS = {
    "utf-16": {"encoding": "UTF-16", "sep": "\t", "multiLine": True},
    "utf-8": {"encoding": "UTF-8", "sep": ","},
    "cp1252": {"encoding": "windows-1252", "sep": ","},
    "latin1": {"encoding": "ISO-8859-1", "sep": ","},
}


def classified(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """One row per non-empty file: path, name, modification time, length, encoding class, first line, content guards.

    One splittable scan of the lines as raw bytes, reduced to a row per file before the shuffle; files may be of any size.
    A guard looks at the first line alone, so a cell that merely speaks of a login page says nothing.
    """
    lines = spark.read.text(path, pathGlobFilter=pattern).select("value", "_metadata")
    mark = F.hex(F.substring(F.col("value").cast("binary"), 1, 2))
    latin = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    unmapped = F.lit(False)
    for code in NOT_WINDOWS:
        unmapped = unmapped | latin.contains(F.char(F.lit(code)))
    start = F.col("_metadata.file_block_start") == 0
    files = lines.groupBy(F.col("_metadata.file_path").alias("path")).agg(
        F.first("_metadata.file_name").alias("file_name"),
        F.first("_metadata.file_modification_time").alias("modificationTime"),
        F.first("_metadata.file_size").alias("length"),
        F.first(F.when(start, F.col("value").cast("binary")), ignorenulls=True).alias("header"),
        F.first(F.when(start, mark), ignorenulls=True).isin("FFFE", "FEFF").alias("marked"),
        F.bool_and(F.is_valid_utf8("value")).alias("utf8"),
        F.bool_or(unmapped).alias("unmapped"),
    )
    kind = F.when(F.col("marked"), "utf-16").when(F.col("utf8"), "utf-8").when(F.col("unmapped"), "latin1").otherwise("cp1252")
    flags = raw_text_flags(F.decode("header", "ISO-8859-1"))
    return files.select(
        "path", "file_name", "modificationTime", "length", kind.alias("encoding_class"), "header",
        *[c.alias(n) for n, c in flags.items()],
    )


def rejected_files(files: DataFrame) -> DataFrame:
    """Downloads that are a login page, HTML or JSON instead of a table."""
    reason = (
        F.when(F.col("looks_like_login"), "login page").when(F.col("looks_like_html"), "html").when(F.col("looks_like_json"), "json")
    )
    return files.withColumn("reject_reason", reason).where("reject_reason is not null")


def latest_file(files: DataFrame, by: str = "mtime") -> DataFrame:
    """The newest file, by modification time or by the date in its name."""
    name_date = F.regexp_extract("file_name", FILE_DATE, 1)
    order = F.struct("modificationTime", "file_name") if by == "mtime" else F.struct(name_date, "file_name")
    return files.agg(F.max_by(F.struct(*files.columns), order).alias("f")).where("f is not null").select("f.*")


def distinct_files(files: DataFrame, by: str = "modificationTime") -> DataFrame:
    """One row per file name: of files with the same name in several folders, the newest by ``by`` (a timestamp or
    a number), then the path that sorts first, so the choice does not depend on listing order. Rows without a name
    are each kept. One aggregation, no window: a name held by many files is reduced before the shuffle."""
    age = F.col(by).cast("timestamp") if dict(files.dtypes)[by] == "timestamp" else F.col(by)
    first = F.min_by(F.struct(*files.columns), F.struct((F.lit(0) - age.cast("double")).alias("a"), F.col("path")))
    named = files.where(F.col("file_name").isNotNull()).groupBy("file_name").agg(first.alias("f")).select("f.*")
    return named.unionByName(files.where(F.col("file_name").isNull()))


def checksums(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """SHA-256 of each file. A file is one value here, so Spark's binary reader refuses files beyond 2 GB."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), "length")


#: Bytes of a chunk of the chunked file digest. Part of the digest's definition: another size gives other values.
DIGEST_CHUNK = 8 << 20


def _chunk_digests(batches, size: int):
    """sha256 of the byte range of each (path, chunk, length) row, read from the shared file system by the task."""
    import hashlib

    import pyarrow as pa
    from pyarrow import fs

    for batch in batches:
        out = []
        for path, chunk, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
            uri = "file://" + path[5:] if path.startswith("file:") and not path.startswith("file://") else path
            system, inner = fs.FileSystem.from_uri(uri)
            with system.open_input_file(inner) as f:
                f.seek(chunk * size)
                data = f.read(min(size, length - chunk * size))
            out.append(hashlib.sha256(data).digest())
        yield pa.record_batch({"path": batch.column(0), "chunk": batch.column(1), "digest": pa.array(out, pa.binary())})


def chunked_checksums(spark: SparkSession, path: str, pattern: str = "*", per_task: int = 16,
                      chunk_bytes: int = DIGEST_CHUNK) -> DataFrame:
    """(path, sha256, length, chunks) of each file of any size: sha256 over the sha256 digests of its chunks of
    ``chunk_bytes`` (8 MiB) in
    order. Empty files are not listed: Spark's file listing leaves them out. The value is the same however the chunks
    are dealt to tasks; ``per_task`` chunks are read by a task, so one large file is read by many tasks at once.
    Only file names and lengths pass through Spark's binary reader (its content column is never read)."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
             .select("path", "length"))
    chunks = files.select("path", "length", F.explode(F.sequence(
        F.lit(0).cast("long"), F.greatest(F.ceil(F.col("length") / chunk_bytes) - 1, F.lit(-1)).cast("long"))
    ).alias("chunk"))
    parts = max(1, -(-chunks.count() // per_task))  # one count of chunk rows, a few per file
    digests = chunks.select("path", "chunk", "length").repartitionByRange(parts, "path", "chunk").mapInArrow(
        lambda batches: _chunk_digests(batches, chunk_bytes), "path string, chunk long, digest binary")
    ordered = F.array_sort(F.collect_list(F.struct("chunk", F.hex("digest").alias("hex"))))
    joined = digests.groupBy("path").agg(  # raw digests in chunk order, joined once
        F.sha2(F.unhex(F.array_join(F.transform(ordered, lambda x: x["hex"]), "")), 256).alias("sha256"),
        F.count("*").alias("chunks"))
    return files.join(joined, "path").select("path", "sha256", "length", "chunks")


def _tagged(df: DataFrame) -> DataFrame:
    """With the file's name, and where in it a row stands: the split's first byte, then the row's number in the task."""
    place = F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"))
    return df.withColumn("source_file", F.col("_metadata.file_name")).withColumn("source_row", place)


def csv_options(kind: str = "utf-8", quoting: bool = True, multi_line: bool = False) -> dict:
    """Reader options: a doubled quote is a quote. Without quoting, quotes are ordinary characters."""
    options = dict(READERS[kind]) | {"escape": '"'}
    if multi_line:
        options["multiLine"] = True
    return options | ({} if quoting else {"quote": ""})


def read_table_files(
    spark: SparkSession, paths: Iterable[str], kind: str = "utf-8", quoting: bool = True, multi_line: bool = False
) -> DataFrame:
    """Delimited text files with one header line, the same in all of them; every cell is text.

    multi_line allows line breaks in quoted cells; such a file cannot be split and is one task.
    """
    # Old reports spell empty cells in many ways, so emptiness is decided by the cleaning step.
    raw = spark.read.options(header=True, inferSchema=False, **csv_options(kind, quoting, multi_line)).csv(list(paths))
    return _tagged(raw)


def refused_files(files: DataFrame, source: Source) -> DataFrame:
    """Files that are not read, with the reason: those that begin as an HTML page, and for a guarded source every reject."""
    rejected = rejected_files(files)
    return rejected if source.guarded else rejected.where("looks_like_html")


def usable_files(files: DataFrame, source: Source) -> DataFrame:
    return files.join(refused_files(files, source).select("path"), "path", "left_anti")


def read_reports(spark: SparkSession, path: str, source: Source, latest: bool = False) -> DataFrame:
    """All files of a source (or its latest) as one text table with normalized headers, ``source_file`` and ``source_row``.

    Columns are matched by name: files of one encoding and header line are read together, and the groups united. Names and
    first lines pass the driver, about 1 kB per file; contents never do.
    """
    files = usable_files(classified(spark, path, source.pattern), source)
    if latest:
        files = latest_file(files)
    groups: dict[tuple[str, bytes], list[str]] = {}
    for row in files.select("path", "encoding_class", "header").toLocalIterator():
        kind = row["encoding_class"] if source.mixed_encoding else "utf-8"
        groups.setdefault((kind, bytes(row["header"] or b"")), []).append(row["path"])
    if not groups:
        raise FileNotFoundError(f"no usable file for {source.name} under {path}")
    out = None
    for (kind, _), paths in sorted(groups.items()):
        part = read_table_files(spark, paths, kind, source.quoting, source.multi_line)
        named = clean_headers(as_written([c for c in part.columns if c not in PLACE]), source.renames)
        part = part.toDF(*named, *PLACE)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def read_parquet_files(spark: SparkSession, path: str, merge_schema: bool = False) -> DataFrame:
    return _tagged(spark.read.option("mergeSchema", merge_schema).parquet(path))


def read_json_items(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list (or object) per file, one row per item."""
    return spark.read.json(path, multiLine=True)


def read_alert_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines alert log; ``details`` stays text."""
    schema = "timestamp timestamp_ntz, level string, title string, message string, details string"
    return spark.read.schema(schema).json(path)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options) -> DataFrame:
    """Partitioned scan of an external database table."""
    return spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts, **options
    ).load()
