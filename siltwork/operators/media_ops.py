"""Cleaning operations on tables of media metrics: one row per file."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltwork.operators.near import near_audio_groups, near_image_groups, near_video_groups
from siltwork.operators.registry import RID, Param, keep_first, op
from siltwork.operators.text_ops import existing, flag_paths

FILES = {"files": Param(list, most=500)}


def _or(name: str, value) -> Column:
    return F.coalesce(F.col(name), F.lit(value))


@op("image audio video", "remove_corrupt", "destructive", "files that can't be read go")
def remove_corrupt(df, columns):
    return df.filter(~F.coalesce("corrupt", F.lit(False)))


@op("image audio video", "drop_exact_duplicates", "destructive", "the first of equal files stays")
def drop_exact_files(df, columns):
    return keep_first(df, F.col("sha256"))


def _first_of(df, groups):
    return df.join(groups.filter(F.col("id") != F.col("label")).select(F.col("id").alias(RID)), RID, "left_anti")


@op("image", "drop_near_duplicates", "destructive", "the first of similar images stays", params={"max_distance": Param(int, 6, 0, 16)})
def drop_near_images(df, columns, max_distance):
    return _first_of(df, near_image_groups(df, max_distance))


@op("audio", "drop_near_duplicates", "destructive", "the first of similar clips stays", params={"max_distance": Param(float, 3.0, 0, 64)})
def drop_near_audio(df, columns, max_distance):
    return _first_of(df, near_audio_groups(df, max_distance))


@op("video", "drop_near_duplicates", "destructive", "the first of similar videos stays", params={"max_distance": Param(float, 6.0, 0, 64)})
def drop_near_video(df, columns, max_distance):
    return _first_of(df, near_video_groups(df, max_distance))


@op("image", "drop_cross_class_duplicates", "destructive", "similar images of several classes go", params={"max_distance": Param(int, 6, 0, 16)})
def drop_cross_class(df, columns, max_distance):
    named = near_image_groups(df, max_distance).join(df.select(F.col(RID).alias("id"), F.coalesce("class", F.lit("")).alias("class")), "id")
    mixed = named.groupBy("label").agg(F.min("class").alias("a"), F.max("class").alias("z")).filter("a <> z").select("label")
    return df.join(named.join(mixed, "label", "left_semi").select(F.col("id").alias(RID)), RID, "left_anti")


# Filters: what a file must reach to stay, with a value for files without a figure.
@op("image", "drop_too_small", "destructive", "small images go", params={"min_side": Param(int, 32, 1)})
def drop_too_small(df, columns, min_side):
    return df.filter(F.least(_or("width", 0), _or("height", 0)) >= min_side)


@op("image", "drop_blurry", "destructive", "blurry images go", params={"min_blur": Param(float)})
def drop_blurry(df, columns, min_blur):
    return df.filter(_or("blur", 0.0) >= min_blur)


@op("image", "drop_too_dark", "destructive", "dark images go", params={"min_brightness": Param(float, 20.0)})
def drop_too_dark(df, columns, min_brightness):
    return df.filter(_or("brightness", 0.0) > min_brightness)


@op("image", "drop_too_bright", "destructive", "bright images go", params={"max_brightness": Param(float, 240.0)})
def drop_too_bright(df, columns, max_brightness):
    return df.filter(_or("brightness", 255.0) < max_brightness)


@op("image", "drop_near_blank", "destructive", "blank images go", params={"min_contrast": Param(float, 4.0)})
def drop_near_blank(df, columns, min_contrast):
    return df.filter(_or("contrast", 0.0) >= min_contrast)


@op("audio", "drop_silent", "destructive", "silent clips go", params={"max_silence": Param(float, 0.97, 0, 1)})
def drop_silent(df, columns, max_silence):
    return df.filter(_or("silence_ratio", 1.0) < max_silence)


@op("audio", "drop_too_short", "destructive", "short clips go", params={"min_seconds": Param(float, 0.3, 0)})
def drop_short_audio(df, columns, min_seconds):
    return df.filter(_or("duration", 0.0) >= min_seconds)


@op("audio", "drop_clipped", "destructive", "clipped clips go", params={"max_clipping": Param(float, 0.001, 0, 1)})
def drop_clipped(df, columns, max_clipping):
    return df.filter(_or("clipping", 0.0) <= max_clipping)


@op("audio", "drop_noisy", "destructive", "noisy clips go", params={"min_snr_db": Param(float, 10.0)})
def drop_noisy(df, columns, min_snr_db):
    return df.filter(_or("snr_db", 60.0) >= min_snr_db)


@op("video", "drop_too_short", "destructive", "short videos go", params={"min_seconds": Param(float, 1.0, 0)})
def drop_short_video(df, columns, min_seconds):
    return df.filter(_or("duration", 0.0) >= min_seconds)


@op("video", "drop_black", "destructive", "black videos go", params={"min_brightness": Param(float, 16.0)})
def drop_black(df, columns, min_brightness):
    return df.filter(_or("brightness", 0.0) >= min_brightness)


@op("video", "drop_frozen", "destructive", "videos without motion go", params={"min_motion": Param(float, 1.0)})
def drop_frozen(df, columns, min_motion):
    return df.filter(_or("motion", 0.0) >= min_motion)


@op("video", "drop_without_audio", "destructive", "videos without sound go")
def drop_without_audio(df, columns):
    return df.filter(_or("has_audio", False))


@op("image audio video", "drop_files", "destructive", "named files go", params=FILES)
def drop_files(df, columns, files, known=None):
    existing(df, files, known)
    return df.filter(~F.col("path").isin(*files))


@op("image audio video", "flag_suspected_mislabels", "safe", "named files are flagged", params=FILES)
def flag_file_mislabels(df, columns, files, known=None):
    existing(df, files, known)
    return flag_paths(df, files)


def _setter(media: str, name: str, risk: str, about: str, column: str, param: str | None = None, spec: Param | None = None) -> None:
    """An operation that only notes, per file, what is to be done when files are written."""

    def run(df, columns, **given):
        return df.withColumn(column, F.lit(given[param] if param else True))

    op(media, name, risk, about, params={param: spec} if param else {})(run)


_setter("image", "fix_exif_orientation", "safe", "turn by the camera's note", "apply_orientation")
_setter("image", "convert_to_rgb", "safe", "three colours", "to_rgb")
_setter("image", "strip_exif", "safe", "no camera notes", "strip_metadata")
_setter("image", "resize_max_side", "lossy", "smaller images", "max_side", "max_side", Param(int, 512, 16, 8192))
_setter("audio", "to_mono", "lossy", "one channel", "mono")
_setter("audio", "trim_silence", "lossy", "no silence at the ends", "trim_ends")
_setter("audio", "convert_to_wav", "safe", "one format", "to_wav")
_setter("audio", "resample", "lossy", "one rate", "sample_rate_to", "sample_rate", Param(int, 16000, 4000, 192000))
_setter("audio", "normalize_loudness", "lossy", "one loudness", "loudness_to", "target_dbfs", Param(float, -20.0, -60, 0))
_setter("video", "downscale", "lossy", "smaller frames", "max_height", "max_height", Param(int, 720, 16, 4320))
_setter("video", "trim", "lossy", "no longer than this", "max_seconds", "max_seconds", Param(float, 60.0, 0.1))
_setter("video", "strip_audio", "lossy", "no sound", "drop_audio")
_setter("video", "extract_audio", "safe", "sound as a file of its own", "audio_out")
_setter("video", "sample_frames", "safe", "frames as images", "frames_per_second", "fps", Param(float, 1.0, 0.01, 60))


@op("video", "fix_rotation", "safe", "turn where the file says so")
def fix_rotation(df, columns):
    return df.withColumn("apply_rotation", _or("rotation", 0) != 0)
