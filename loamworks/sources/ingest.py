"""Raw material from CSV, JSON lines, text and archives, normalised; refused rows with a reason."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Domains that a file's name may start with, and the least length of material.
DOMAINS = ("medical", "legal", "code", "education", "finance", "general")
LEAST = 10
SCHEMA = "content string, material_type string, domain string, tags array<string>, source_name string"


def tags(c: Column) -> Column:
    """Comma-separated tags, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != "")


def normalise(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Material, and refused rows with reason (SRC-06): CRLF to LF, trimmed, at least LEAST characters."""
    content = F.trim(F.regexp_replace(F.coalesce("content", F.lit("")), "\r\n?", "\n"))
    clean = df.withColumns({"content": content, "material_type": F.coalesce(F.nullif("material_type", F.lit("")), F.lit("text")), "domain": F.coalesce("domain", F.lit(""))})
    short = F.length("content") < LEAST
    return clean.where(~short), clean.where(short).withColumn("reason", F.lit("too short"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; content is required, other columns optional; label is row_ and the row's number in its file, from 2 (SRC-01)."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    if "content" not in raw.columns:
        raise ValueError("a content column is required")
    col = lambda n: F.col(n) if n in raw.columns else F.lit(None).cast("string")
    rows = raw.select("content", col("material_type").alias("material_type"), col("domain").alias("domain"), tags(col("tags")).alias("tags"), F.input_file_name().alias("source_name"), F.monotonically_increasing_id().alias("at"))
    place = F.row_number().over(Window.partitionBy("source_name").orderBy("at")) + 1  # a file of rows over several lines is one task's already
    return rows.withColumn("label", F.concat(F.lit("row_"), place.cast("string"))).drop("at")


def read_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """JSON lines, and the lines that are none (SRC-02); tags may be a text or a list."""
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", F.input_file_name().alias("source_name"))
    parsed = lines.withColumn("v", F.try_parse_json("value"))
    get = lambda k: F.try_variant_get("v", f"$.{k}", "string")
    listed = F.try_variant_get("v", "$.tags", "array<string>")
    good = parsed.where(F.col("v").isNotNull() & get("content").isNotNull())
    rows = good.select(get("content").alias("content"), get("material_type").alias("material_type"), get("domain").alias("domain"), F.coalesce(listed, tags(get("tags"))).alias("tags"), "source_name")
    bad = parsed.where(F.col("v").isNull() | get("content").isNull()).select("value", "source_name", F.lit("not a material").alias("reason"))
    return rows, bad


def paragraphs(text: Column) -> Column:
    """The parts of a text between blank lines (SRC-04)."""
    return F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n\n")


def read_txt(spark: SparkSession, path: str) -> DataFrame:
    """Text files, a row for each paragraph between blank lines (SRC-04)."""
    raw = spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("source_name"))
    each = raw.select(F.explode(paragraphs(F.col("value"))).alias("content"), "source_name").where(F.trim("content") != "")
    return each.select("content", F.lit("text").alias("material_type"), F.lit("").alias("domain"), F.array().cast("array<string>").alias("tags"), "source_name")


def read_zip(spark: SparkSession, path: str) -> DataFrame:
    """Text and Markdown members of archives (SRC-03); the domain from the member's name; unreadable archives give one row with an error."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out = []
                try:
                    with zipfile.ZipFile(io.BytesIO(body.as_py())) as archive:
                        for info in archive.infolist():
                            base = info.filename.rsplit("/", 1)[-1]
                            if info.is_dir() or base.startswith(".") or info.filename.startswith("__MACOSX") or base.rsplit(".", 1)[-1].lower() not in ("txt", "md", "text"):
                                continue
                            domain = next((d for d in DOMAINS if base.lower().startswith(d)), "")
                            out.append((archive.read(info).decode("utf-8", "replace"), "text", domain, [], f"{where}!{info.filename}", None))
                except (zipfile.BadZipFile, OSError, RuntimeError) as why:
                    out.append((None, "text", "", [], where, str(why)))
                for row in out:
                    kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], ["content", "material_type", "domain", "tags", "source_name", "error"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(members, SCHEMA + ", error string")


REFUSED = "value string, source_name string, reason string"


def read_with_refused(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Material by the file's extension, and what isn't any: value, source_name, reason (SRC-01, SRC-05).

    Refused are CSV rows without content, lines that are no material, and unreadable archives. Files of an unknown
    kind are read as JSON lines, else CSV, else text.
    """
    kind = path.rsplit(".", 1)[-1].lower()
    none = spark.createDataFrame([], REFUSED)
    if kind == "csv":
        rows = read_csv(spark, path)
        empty = F.col("content").isNull() | (F.trim("content") == "")
        return rows.where(~empty), rows.where(empty).select(F.to_json(F.struct("material_type", "domain", "tags")).alias("value"), "source_name", F.lit("no content").alias("reason"))
    if kind in ("jsonl", "ndjson", "json"):
        return read_jsonl(spark, path)
    if kind == "zip":
        rows = read_zip(spark, path)
        failed = F.col("error").isNotNull()
        return rows.where(~failed).drop("error"), rows.where(failed).select(F.lit(None).cast("string").alias("value"), "source_name", F.col("error").alias("reason"))
    if kind in ("txt", "md", "text"):
        return read_txt(spark, path), none
    rows, refused = read_jsonl(spark, path)
    if not rows.isEmpty():
        return rows, refused
    try:
        return read_csv(spark, path), none
    except ValueError:
        return read_txt(spark, path), none


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Material by the file's extension; read_with_refused also tells what was left out."""
    return read_with_refused(spark, path)[0]


def read_jobs(spark: SparkSession, path: str, n: int = 50) -> DataFrame:
    """name and state of the newest n files of a folder, by name; of these, unreadable ones and other files than JSON are left out (SRC-09)."""
    files = spark.read.format("binaryFile").load(path).select("path")
    newest = [r["path"] for r in files.orderBy(F.desc(F.element_at(F.split("path", "/"), -1))).limit(n).collect()]  # n names
    known = [p for p in newest if p.endswith(".json")]
    if not known:
        return spark.createDataFrame([], "name string, state string")
    raw = spark.read.text(known, wholetext=True).select("value", F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"))
    return raw.withColumn("v", F.try_parse_json("value")).where(F.col("v").isNotNull()).select("name", F.to_json("v").alias("state"))


def job_state(spark: SparkSession, path: str, job: str, memory: DataFrame | None = None) -> DataFrame:
    """state of one job: that in memory (job, state), else that of its file, else no row (SRC-09)."""
    held = memory.where(F.col("job") == job).select("state").limit(1) if memory is not None else None
    if held is not None and not held.isEmpty():
        return held
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"{job}.json").load(path)
    text = found.select(F.try_parse_json(F.decode("content", "UTF-8")).alias("v")).where(F.col("v").isNotNull())
    return text.select(F.to_json("v").alias("state"))


def decode_media(payload: Column) -> Column:
    """The bytes of a base64 payload or data URI, or null (SRC-11)."""
    return F.try_to_binary(F.regexp_replace(F.regexp_replace(payload, r"^data:[^,]*,", ""), r"\s", ""), F.lit("base64"))


def ledger_rows(spark: SparkSession, path: str) -> DataFrame:
    """A JSON ledger of two nested maps as rows: creator, field, amount (SRC-10)."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,map<string,double>>").alias("m"))
    return raw.select(F.explode("m").alias("creator", "fields")).select("creator", F.explode("fields").alias("field", "amount"))
