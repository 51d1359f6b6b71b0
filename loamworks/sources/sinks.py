"""Packages of samples on shared storage."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamworks.operators.relational import share_of_sum


def write_package(samples: dict[str, DataFrame], path: str, columns: dict[str, list[str]]) -> DataFrame:
    """Each kind's columns as JSON lines and Parquet, and a manifest of counts and mean scores (SNK-01 to SNK-03, PK-01)."""
    manifest = None
    for kind, df in samples.items():
        out = df.select(*columns[kind])
        out.write.mode("overwrite").json(f"{path}/{kind}_jsonl")
        out.write.mode("overwrite").parquet(f"{path}/{kind}_parquet", compression="snappy")
        score = F.round(F.avg("quality_score"), 2) if "quality_score" in df.columns else F.lit(None).cast("double")
        row = df.agg(F.lit(kind).alias("kind"), F.count("*").alias("rows"), score.alias("avg_quality"))
        manifest = row if manifest is None else manifest.unionByName(row)
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def contributions(samples: dict[str, DataFrame], creator: str, weights: dict[str, Column]) -> DataFrame:
    """Each creator's share of a package: weights of all kinds' samples, united, over their sum (PK-01, U-02)."""
    each = None
    for kind, df in samples.items():
        one = df.select(F.col(creator).alias("creator"), weights[kind].cast("double").alias("weight"))
        each = one if each is None else each.unionByName(one)
    return share_of_sum(each, "creator", F.col("weight")).select("creator", "ratio")


def write_card(manifest: DataFrame, path: str, name: str, description: str, license_type: str) -> None:
    """A package's card in Markdown: counts by kind, mean score, license (SNK-02, SNK-03)."""
    lines = F.array_sort(F.collect_list(F.concat(F.lit("- "), "kind", F.lit(": "), F.col("rows").cast("string"))))  # one for each kind
    known = F.when(F.col("avg_quality").isNotNull(), F.col("rows"))
    mean = F.round(F.try_divide(F.sum(F.col("avg_quality") * F.col("rows")), F.sum(known)), 2).cast("string")
    head = F.lit(f"# {name}\n\n{description}\n\n- samples: ")
    total = F.coalesce(F.sum("rows"), F.lit(0)).cast("string")
    body = F.concat(head, total, F.lit("\n"), F.array_join(lines, "\n"), F.lit("\n- mean score: "), F.coalesce(mean, F.lit("none")), F.lit(f"\n- license: {license_type}\n"))
    manifest.agg(body.alias("value")).write.mode("overwrite").text(f"{path}/card")


def manifest_json(manifest: DataFrame, shares: DataFrame, package: str, name: str, paths: dict[str, str]) -> DataFrame:
    """A package's manifest as one JSON text (value): id, name, counts by kind, mean score, paths, and each creator's share (PK-01)."""
    known = F.when(F.col("avg_quality").isNotNull(), F.col("rows"))
    mean = F.round(F.try_divide(F.sum(F.col("avg_quality") * F.col("rows")), F.sum(known)), 2)
    counts = manifest.agg(F.sum("rows").alias("total_samples"), mean.alias("avg_quality"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "rows")))).alias("counts"))
    dealt = shares.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("creator", "ratio")))).alias("creator_contributions"))  # a row for each creator of the package
    told = F.create_map(*[F.lit(x) for pair in paths.items() for x in pair]) if paths else F.create_map().cast("map<string,string>")
    both = counts.join(F.broadcast(dealt))
    return both.select(F.to_json(F.struct(F.lit(package).alias("package_id"), F.lit(name).alias("name"), "total_samples", "avg_quality", "counts", told.alias("export_paths"), "creator_contributions")).alias("value"))


def write_bundle(samples: dict[str, DataFrame], path: str, columns: dict[str, list[str]], creator: str, weights: dict[str, Column], package: str, name: str, description: str, license_type: str) -> DataFrame:
    """A whole package: files of each kind, card, manifest, and the bundle of archives with all of it (SNK-03, PK-01).

    Returns the bundle as written: member (what an archive holds), rows and archive. One archive holds README.md and
    manifest.json, the others samples, so that each is bounded.
    """
    spark = next(iter(samples.values())).sparkSession
    manifest = write_package(samples, path, columns)
    write_card(spark.read.json(f"{path}/manifest").select("kind", "rows", *(["avg_quality"] if "avg_quality" in spark.read.json(f"{path}/manifest").columns else [F.lit(None).cast("double").alias("avg_quality")])), path, name, description, license_type)
    paths = {f"{kind}_{form}": f"{path}/{kind}_{form}" for kind in samples for form in ("jsonl", "parquet")}
    shares = contributions(samples, creator, weights)
    manifest_json(manifest, shares, package, name, paths).coalesce(1).write.mode("overwrite").text(f"{path}/manifest_json")
    card = spark.read.text(f"{path}/card", wholetext=True).select(F.lit("README.md").alias("file"), "value")
    told = spark.read.text(f"{path}/manifest_json", wholetext=True).select(F.lit("manifest.json").alias("file"), "value")
    out = _files(card.unionByName(told)).withColumn("member", F.lit("package"))
    for kind, df in samples.items():
        out = out.unionByName(zipped(df.select(*columns[kind]), kind).withColumn("member", F.lit(kind)))
    out.write.mode("overwrite").parquet(f"{path}/bundle")
    return spark.read.parquet(f"{path}/bundle")


def _files(texts: DataFrame) -> DataFrame:
    """One archive of a few whole texts (file, value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        if rows:
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
                for file, value in rows:
                    archive.writestr(file, value)
            yield pa.RecordBatch.from_pydict({"rows": pa.array([0], pa.int64()), "archive": pa.array([out.getvalue()], pa.binary())})

    return texts.coalesce(1).select("file", "value").mapInArrow(run, "rows long, archive binary")


def zipped(df: DataFrame, name: str, rows: int = 100_000) -> DataFrame:
    """A bundle as rows (rows, archive): ZIP archives of JSON lines with up to so many rows each, made where the rows are (SNK-03).

    Archives are bounded, so a package of any size is a table of them, and none is built in one task.
    """

    def packed(lines: list[str]) -> pa.RecordBatch:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr(f"{name}.jsonl", "".join(line + "\n" for line in lines))
        return pa.RecordBatch.from_pydict({"rows": pa.array([len(lines)], pa.int64()), "archive": pa.array([out.getvalue()], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        for batch in batches:
            held += batch.column(0).to_pylist()
            while len(held) >= rows:
                yield packed(held[:rows])
                held = held[rows:]
        if held:
            yield packed(held)

    return df.select(F.to_json(F.struct("*")).alias("line")).mapInArrow(run, "rows long, archive binary")


def replace_table(df: DataFrame, path: str) -> None:
    """Writes a new state beside the old one and swaps them, since a table being read can't be overwritten (SNK-05 to SNK-08).

    The old state is moved aside and deleted last, so a crash in between leaves it in path.old.
    """
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}.new")
    now, new, old = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.new", f"{path}.old"))
    fs = new.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(now):
        fs.delete(old, True)
        fs.rename(now, old)
    fs.rename(new, now)
    fs.delete(old, True)
