"""Text, time and identifier expressions.  White space and word edges are Unicode's, as ``(?U)`` asks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrand.functions.vectors import as_column

#: Fixed values.
UUID_NAMESPACE = "6f3a1e84-0d2b-4c7e-9f15-8b2d4a6c1e90"
VIDEO_NAME = r"(?i)^(?:[A-Z][0-9]+_V[0-9]+|[0-9]{3})$"
UUID_SHAPE = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
EXTENSIONS = ("mp4", "mkv", "avi", "webm", "mov", "flv", "wmv", "jpg", "jpeg", "png", "webp", "gif", "json")
NAME_SUFFIX = r"(?i)__(?:shot|pos|frame|ts)_.*$"


def parse_options(text: Column | str) -> Column:
    """Options A to H of a question: cut before each label, labels kept, trimmed; what precedes the first goes."""
    parts = F.split(as_column(text), r"(?U)(?:^|\s)(?=[A-H]\.\s*)")
    return F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"(?U)\s+$", ""))), lambda p: p.rlike(r"^[A-H]\."))


def parse_letter(text: Column | str, options: Column) -> Column:
    """The first stand-alone letter that is an allowed option, else null; 0 or null options mean eight."""
    limit = F.greatest(F.least(F.when(F.coalesce(options, F.lit(0)) == 0, 8).otherwise(options), F.lit(8)), F.lit(1))
    letters = F.regexp_extract_all(F.upper(as_column(text)), F.lit(r"(?U)\b([A-H])\b"), F.lit(1))
    return F.get(F.filter(letters, lambda c: F.ascii(c) < limit + 65), F.lit(0))


def mmss(seconds: Column | str) -> Column:
    s = F.floor(F.coalesce(as_column(seconds), F.lit(0.0))).cast("long")
    return F.format_string("[%02d:%02d]", F.floor(s / 60), s % 60)


def minutes_seconds(seconds: Column | str) -> Column:
    """MM:SS.ss."""
    s = as_column(seconds).cast("double")
    m = F.floor(s / 60)
    return F.format_string("%02d:%05.2f", m, s - m * 60)


def hours_minutes_seconds(seconds: Column | str) -> Column:
    s = F.floor(as_column(seconds)).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def srt_time(seconds: Column | str) -> Column:
    ms = F.floor(as_column(seconds) * 1000 + 1e-6).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def parse_hms(text: Column | str) -> Column:
    """Seconds of ``[HH:]MM:SS[.f]``, null if malformed."""
    parts = F.split(F.trim(as_column(text)), ":")
    at = lambda i: F.get(parts, F.lit(i)).try_cast("double")
    return F.when(F.size(parts) == 3, at(0) * 3600 + at(1) * 60 + at(2)).when(F.size(parts) == 2, at(0) * 60 + at(1))


def found(text: Column | str, pattern: str, group: int = 1) -> Column:
    """regexp_extract with null for no match."""
    return F.nullif(F.regexp_extract(as_column(text), pattern, group), F.lit(""))


def basename(path: Column | str) -> Column:
    return F.substring_index(F.replace(as_column(path), F.lit("\\"), F.lit("/")), "/", -1)


def frame_id(index: Column, filename: Column, path: Column) -> Column:
    rx = r"__frame_([0-9]+)"
    return F.coalesce(index.cast("long"), found(filename, rx).try_cast("long"), found(path, rx).try_cast("long"))


def parse_keyframe_name(name: Column | str) -> Column:
    """struct<video, shot, pos, frame, ts> of ``video__shot_n__pos_p__frame_f__ts_t.ext``; absent parts are null."""
    base = basename(name)
    return F.struct(
        found(base, r"^(.*?)__(?:shot|pos|frame|ts)_").alias("video"),
        found(base, r"__shot_([0-9]+)").try_cast("int").alias("shot"),
        found(base, r"__pos_([A-Za-z0-9]+?)(?:__|\.|$)").alias("pos"),
        found(base, r"__frame_([0-9]+)").try_cast("int").alias("frame"),
        found(base, r"__ts_([0-9]+(?:\.[0-9]+)?)").try_cast("double").alias("ts"),
    )


def infer_video(path: Column | str) -> Column:
    """The parent folder where it is a video's name, else such a prefix of the file's name, else null."""
    parent = found(as_column(path), r"([^/\\]+)[/\\][^/\\]*$")
    prefix = found(basename(path), r"(?i)^([A-Z][0-9]+_V[0-9]+|[0-9]{3})(?:[_.]|$)")
    return F.coalesce(F.when(parent.rlike(VIDEO_NAME), parent), prefix)


def clean_video_id(raw: Column) -> Column:
    """Base name without known extensions (however many) and keyframe suffix; blank or "unknown" is null."""
    stem = F.regexp_replace(basename(F.trim(raw)), rf"(?i)(?:\.(?:{'|'.join(EXTENSIONS)}))+$", "")
    stem = F.trim(F.regexp_replace(stem, NAME_SUFFIX, ""))
    return F.when((stem != "") & (F.lower(stem) != "unknown"), stem)


def canonical_video_id(*candidates: Column) -> Column:
    """The first candidate, in the order of trust, that cleans to an id."""
    return F.coalesce(*[clean_video_id(c) for c in candidates])


def is_video_name(name: Column | str) -> Column:
    return F.coalesce(as_column(name).rlike(VIDEO_NAME), F.lit(False))


def uuid_stem(path: Column | str) -> Column:
    """The lower-cased stem of a file named by a UUID, else null."""
    stem = F.regexp_replace(basename(path), r"\.[^.]*$", "")
    return F.when(stem.rlike(UUID_SHAPE), F.lower(stem))


def uuid5(name: Column | str, namespace: str = UUID_NAMESPACE) -> Column:
    """RFC 4122 version 5: SHA-1 of namespace and name, version and variant bits set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(as_column(name), "utf-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("long").bitwiseAND(3).bitwiseOR(8)))
    s = lambda a, n: F.substring(h, a, n)
    return F.concat_ws("-", s(1, 8), s(9, 4), F.concat(F.lit("5"), s(14, 3)), F.concat(variant, s(18, 3)), s(21, 12))


def point_id(video: Column, shot: Column, frame: Column) -> Column:
    return uuid5(F.concat_ws(":", video, shot.cast("string"), frame.cast("string")))


def shot_id(video: Column, number: Column) -> Column:
    return F.format_string("%s_shot_%03d", video, number)


def word_count(text: Column | str) -> Column:
    return F.size(F.filter(F.split(F.coalesce(as_column(text), F.lit("")), r"(?U)\s+"), lambda w: w != ""))


def timestamp_seconds(top: Column, seconds: Column, stamp: Column, formatted: Column, index: Column, fps: Column) -> Column:
    """The first usable time: own, of the frame, another of the frame, formatted, index over frame rate."""
    return F.coalesce(top.try_cast("double"), seconds.try_cast("double"), stamp.try_cast("double"), parse_hms(formatted), F.when(fps > 0, index / fps))


def strip_fences(reply: Column | str) -> Column:
    return F.trim(F.regexp_replace(as_column(reply), r"(?is)^\s*```(?:json)?\s*|\s*```\s*$", ""))


def parse_pairs(reply: Column | str, expected: int) -> Column:
    """array<struct<text, caption>> of a model's reply, padded with nulls; an object fills the first place."""
    clean = strip_fences(reply)
    pair = "text string, caption string"
    many = F.from_json(clean, f"array<struct<{pair.replace(' string', ':string').replace(' ', '')}>>")
    single = F.from_json(clean, pair)
    got = F.when(clean.startswith("["), many).when(clean.startswith("{"), F.array(single))
    return F.transform(F.sequence(F.lit(0), F.lit(expected - 1)), lambda i: F.get(F.coalesce(got, F.array().cast(f"array<struct<text:string,caption:string>>")), i))


def decay(gap: Column | str, rate: float) -> Column:
    g = as_column(gap)
    return F.when(g <= 0, 1.0).otherwise(F.greatest(F.exp(-F.lit(rate) * g), F.lit(0.001)))


def shrink(width: Column, height: Column, max_side: int) -> Column:
    """struct<width, height> scaled down so that the longer side fits."""
    k = F.least(F.lit(1.0), F.lit(float(max_side)) / F.greatest(width, height))
    return F.struct((width * k).cast("int").alias("width"), (height * k).cast("int").alias("height"))


def grow(width: Column, height: Column, min_side: int = 512) -> Column:
    """struct<width, height> scaled up so that the shorter side has at least ``min_side``."""
    k = F.greatest(F.lit(1.0), F.lit(float(min_side)) / F.least(width, height))
    return F.struct((width * k).cast("int").alias("width"), (height * k).cast("int").alias("height"))


def score_of(*scores: Column) -> Column:
    """The first score that is there, else 0."""
    return F.coalesce(*scores, F.lit(0.0))
