"""Reading uploads and tables, checking uploads, exporting a user's data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragmill.functions.text import file_type

#: Types that are accepted and the size limit.
TYPES = ("pdf", "docx", "xlsx", "pptx", "txt", "md", "csv")
MAX_BYTES = 50 * 1024 * 1024

#: Schemas of the stored tables, for reader.schema().
DOCUMENTS = (
    "document_id string, user_id string, filename string, file_type string, page_count int, word_count long, storage_key string, "
    "outline_json string, highlights_json string, summary string, processing_status string, version_number int, duplicate_of string, "
    "chunking_strategy string, created_at timestamp, deleted_at timestamp"
)
CHUNKS = "chunk_id string, document_id string, chunk_index int, content string, embedding array<double>, importance_score double, page_number int, section_heading string, retrieved_count long"
QUERY_LOG = "id string, user_id string, question string, answer string, mode string, sources_json string, confidence_score double, bookmarked boolean, collection_id string, created_at timestamp, deleted_at timestamp"


def read_uploads(spark: SparkSession, root: str) -> DataFrame:
    """Files laid out {user}/{name}.{ext} below root: path, user_id, filename, file_type, length, content."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return f.select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("user_id"), name.alias("filename"), file_type(name).alias("file_type"), "length", "content")


def content_ok(content: Column, kind: Column) -> Column:
    """Whether the first bytes fit the type."""
    head = F.substring(content, 1, 8_192)
    as_hex = F.hex(head)
    pdf = F.regexp_replace(F.hex(F.substring(content, 1, 1_024)), "^(20|09|0A|0B|0C|0D)+", "").startswith("255044462D")
    zipped = F.hex(F.substring(content, 1, 4)).isin("504B0304", "504B0506", "504B0708")
    # bytes that count as printable: tab, line ends, 32-126 and 160 up
    odd = F.length(F.regexp_replace(F.regexp_replace(as_hex, "(..)", "$1 "), "(09|0A|0D|[2-6].|7[0-9A-E]|[A-F].) ", "")) / 3
    text = ~F.regexp_replace(as_hex, "(..)", "$1 ").contains("00 ") & (F.is_valid_utf8(head.cast("string")) | (1 - odd / F.greatest(F.length(head), F.lit(1)) > 0.85))
    return F.when(kind == "pdf", pdf).when(kind.isin("docx", "xlsx", "pptx"), zipped).when(kind.isin("txt", "md", "csv"), text).otherwise(False)


def upload_gate(uploads: DataFrame) -> DataFrame:
    """Add status: ok, or the first failing check of 415 (type), 400 (empty), 413 (too large), 422 (content)."""
    size = F.octet_length("content")
    status = F.when(~F.col("file_type").isin(*TYPES), "415").when(size == 0, "400").when(size > MAX_BYTES, "413").when(~content_ok(F.col("content"), F.col("file_type")), "422").otherwise("ok")
    return uploads.withColumn("status", status)


def decode_text(content: Column) -> Column:
    """UTF-8 with replacement of what is not."""
    return F.make_valid_utf8(content.cast("string"))


def json_vectors(col: Column) -> Column:
    """Vectors kept as JSON text; null where it is no list or empty."""
    v = F.from_json(col, "array<double>")
    return F.when(F.size(v) > 0, v)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, partitions: int, lower: int | None = None, upper: int | None = None, **options: str) -> DataFrame:
    """A table of a database in ranges of a numeric column, one connection a range; bounds that are not given are the column's
    least and largest value. Bounds only place the ranges: rows beyond them or without a value are read too."""
    r = spark.read.format("jdbc").option("url", url).options(**options)
    if lower is None or upper is None:
        ends = r.option("query", f"SELECT MIN({column}) AS lo, MAX({column}) AS hi FROM {table}").load().first()
        lower, upper = (ends[0] if lower is None else lower), (ends[1] if upper is None else upper)
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if lower is None or upper is None or lower == upper or partitions < 2:  # empty, or nothing to divide
        return r.load()
    return r.option("partitionColumn", column).option("lowerBound", lower).option("upperBound", upper).option("numPartitions", partitions).load()


def write_jdbc(df: DataFrame, url: str, table: str, partitions: int, mode: str = "append", **options: str) -> None:
    """Write a table to a database over at most `partitions` connections."""
    df.coalesce(partitions).write.format("jdbc").option("url", url).option("dbtable", table).options(**options).mode(mode).save()


#: What a user gets of each document and query.
EXPORT_DOCUMENTS = ("id", "filename", "file_type", "page_count", "word_count", "version_number", "created_at")
EXPORT_QUERIES = ("id", "question", "answer", "mode", "confidence_score", "bookmarked", "sources", "created_at")
_SOURCES = "array<struct<chunk_id:string,document_id:string,document_name:string,page_number:int,section_heading:string,ranked_score:double,importance_score:double>>"
_HIGHLIGHTS = "array<struct<text:string,chunk_index:int,score:double>>"


def exports(documents: DataFrame, log: DataFrame) -> dict[str, DataFrame]:
    """What is exported of the live rows of every user: documents, queries (sources parsed) and highlights (parsed), with
    ISO times. Columns that the tables lack are null; JSON that is missing or bad is an empty list."""

    def live(df: DataFrame) -> DataFrame:
        return df.where(F.col("deleted_at").isNull())

    def col(df: DataFrame, name: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast("string")

    def pick(df: DataFrame, names: tuple[str, ...], **own: Column) -> DataFrame:
        iso = F.date_format(col(df, "created_at").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ssXXX")
        made = {"created_at": iso} | own
        return live(df).select("user_id", *[made.get(n, col(df, n)).alias(n) for n in names])

    def parsed(df: DataFrame, name: str, kind: str) -> Column:
        return F.coalesce(F.from_json(col(df, name), kind), F.array().cast(kind))

    return {
        "documents": pick(documents, EXPORT_DOCUMENTS, id=F.col("document_id")),
        "queries": pick(log, EXPORT_QUERIES, sources=parsed(log, "sources_json", _SOURCES)),
        "highlights": live(documents).select("user_id", "document_id", col(documents, "filename").alias("filename"), parsed(documents, "highlights_json", _HIGHLIGHTS).alias("highlights")),
    }


def export_user_data(documents: DataFrame, log: DataFrame, path: str) -> None:
    """The three sets of exports() as JSON, a folder a user."""
    for name, df in exports(documents, log).items():
        df.write.mode("overwrite").partitionBy("user_id").option("ignoreNullFields", "false").json(f"{path}/{name}")
