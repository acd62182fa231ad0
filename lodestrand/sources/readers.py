"""Readers: tables, JSON artifacts, listings, zipped JSON lines."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions.strings import basename
from lodestrand.schemas import SCHEMAS


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A Parquet table with its declared schema."""
    return spark.read.schema(SCHEMAS[name]).parquet(path)


def load_questions(raw: DataFrame, videos: DataFrame | None = None) -> DataFrame:
    """Questions with options parsed, answers stripped and upper-cased, all else as strings; of ``videos`` only, if given."""
    from lodestrand.functions.strings import parse_options

    text = lambda c: F.col(c).cast("string") if c in raw.columns else F.lit("")
    options = parse_options(F.col("options")) if dict(raw.dtypes).get("options") == "string" else F.col("options")
    out = raw.select("*", options.alias("_options")).select(
        *[text(c).alias(c) for c in ("video_id", "question_id", "question")], F.col("_options").alias("options"), F.upper(F.trim(text("answer"))).alias("answer"), *[text(c).alias(c) for c in ("level", "group_type", "second_head", "third_head")]
    )
    return out.join(videos.select("video_id").distinct(), "video_id", "left_semi") if videos is not None else out


def read_artifacts(spark: SparkSession, folder: str, name: str, glob: str = "*.json") -> DataFrame:
    """JSON artifacts, one array or object a file; a corrupt file gives no rows; ``video_id`` is the file's stem."""
    rows = spark.read.schema(SCHEMAS[name]).option("mode", "DROPMALFORMED").option("multiLine", True).option("pathGlobFilter", glob).json(folder)
    stem = F.regexp_replace(basename(F.input_file_name()), r"\.[^.]*$", "")
    return rows.withColumn("video_id", F.coalesce("video_id", stem)) if "video_id" in rows.columns else rows.withColumn("video_id", stem)


def list_files(spark: SparkSession, folder: str, extensions: tuple[str, ...], recursive: bool = True) -> DataFrame:
    """path, name, stem, length, modified of the files with these extensions, in any case; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder).select("path", "length", F.col("modificationTime").alias("modified"))
    name = basename("path")
    wanted = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).isin([e.lower().lstrip(".") for e in extensions])
    return files.where(wanted).select("path", name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), "length", "modified")


def discover_videos(spark: SparkSession, folder: str) -> DataFrame:
    """video_id of every .mp4 in the folder, sorted."""
    return list_files(spark, folder, ("mp4",), recursive=False).select(F.col("stem").alias("video_id")).orderBy("video_id")


def _unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for content in batch["content"]:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for member in z.namelist():
                    if member.endswith(".jsonl"):
                        lines = z.read(member).decode("utf-8", errors="replace").splitlines()
                        rows = [x for x in lines if x.strip()]
                        stem = member.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                        yield pd.DataFrame({"video_id": stem, "ord": range(len(rows)), "line": rows})


def read_zipped_words(spark: SparkSession, archives: str, videos: DataFrame | None = None) -> DataFrame:
    """Words of ``subtitle/<id>.jsonl`` in zip archives: file order in ``ord``, blank lines left out, bad bytes replaced.

    Only unpacking runs in Python; lines are parsed by Spark.  A video without a member has no rows.
    """
    lines = spark.read.format("binaryFile").load(archives).select("content").mapInPandas(_unzip, "video_id string, ord long, line string")
    word = F.from_json("line", "text string, start_time double, end_time double")
    words = lines.select("video_id", "ord", word.alias("w")).select("video_id", "ord", "w.*")
    return words.join(videos.select("video_id").distinct(), "video_id", "left_semi") if videos is not None else words


def with_probe_defaults(probes: DataFrame) -> DataFrame:
    """fps 25 where it is unknown; the frame count from duration where it is unknown."""
    fps: Column = F.when(F.coalesce("fps", F.lit(0.0)) > 0, F.col("fps")).otherwise(25.0)
    frames = F.when(F.coalesce("frames", F.lit(0)) > 0, F.col("frames")).otherwise(F.floor(F.coalesce("duration", F.lit(0.0)) * fps).cast("int"))
    return probes.withColumn("frames", frames).withColumn("fps", fps)
