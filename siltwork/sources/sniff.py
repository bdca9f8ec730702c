"""What a file holds, from its first bytes; an inventory of files; safe unpacking."""

from __future__ import annotations

import csv
import json
import os
import re
import stat
import zipfile
from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltwork.functions import fixed as X

HEAD = 65_536
ENCODINGS = ("utf-8-sig", "cp1252", "latin-1")
# First bytes of file formats.
MAGIC = (
    (b"\x89PNG\r\n\x1a\n", 0, "image", "png"), (b"\xff\xd8\xff", 0, "image", "jpeg"), (b"GIF8", 0, "image", "gif"), (b"BM", 0, "image", "bmp"),
    (b"WEBP", 8, "image", "webp"), (b"II*\x00", 0, "image", "tiff"), (b"MM\x00*", 0, "image", "tiff"), (b"WAVE", 8, "audio", "wav"), (b"ID3", 0, "audio", "mp3"),
    (b"\xff\xfb", 0, "audio", "mp3"), (b"fLaC", 0, "audio", "flac"), (b"OggS", 0, "audio", "ogg"), (b"AVI ", 8, "video", "avi"), (b"ftyp", 4, "video", "mp4"),
    (b"\x1aE\xdf\xa3", 0, "video", "webm"), (b"\xd0\xcf\x11\xe0", 0, "table", "xls"), (b"%PDF", 0, "unknown", "pdf"), (b"\x1f\x8b", 0, "archive", "gz"),
)
DELIMITERS = ",;\t|"


@dataclass(frozen=True)
class Detection:
    modality: str
    format: str
    detail: str = ""


def decode(raw: bytes) -> str:
    for e in ENCODINGS:
        try:
            return raw.decode(e)
        except UnicodeDecodeError:
            # a cut may fall within a character
            if e == "utf-8-sig":
                for k in (1, 2, 3):
                    try:
                        return raw[:-k].decode(e)
                    except UnicodeDecodeError:
                        continue
    return raw.decode("latin-1")


def delimiter(lines: list[str]) -> str | None:
    """The sign that parts most lines into equally many fields, two or more; none for prose."""
    lines = [x for x in lines if x.strip()][:50]
    best = None
    for d in DELIMITERS:
        widths = Counter(len(r) for r in csv.reader(lines, delimiter=d))
        width, n = widths.most_common(1)[0] if widths else (0, 0)
        if width >= 2 and n >= 0.9 * len(lines) and len(lines) > 1 and (best is None or (n, width) > best[:2]):
            best = (n, width, d)
    if best is None:
        return None
    if best[2] == ",":
        commas = sum(x.count(",") for x in lines)
        if sum(x.count(", ") for x in lines) >= 0.8 * commas and sum(len(x.split()) for x in lines) >= 6 * len(lines):
            return None
    return best[2]


def _log_share(lines: list[str]) -> float:
    forms = [re.compile(p) for p, _ in X.LOG_FORMATS.values()]
    return max(sum(bool(f.match(x)) for x in lines) for f in forms) / len(lines) if lines else 0.0


def text_kind(text: str, complete: bool = False) -> Detection:
    lines = [x for x in text.splitlines() if x.strip()]
    lines = lines if complete or len(lines) < 2 else lines[:-1]
    if not lines:
        return Detection("text", "txt", "empty")
    head = lines[:20]

    def is_json(x: str) -> bool:
        try:
            return x.lstrip()[:1] in "{[" and json.loads(x) is not None
        except ValueError:
            return False

    if len(head) >= 2 and sum(map(is_json, head)) >= 0.9 * len(head):
        return Detection("table", "jsonl")
    share = _log_share(lines[:200])
    if share >= 0.8:
        return Detection("log", "log")
    if d := delimiter(lines):
        return Detection("table", "tsv" if d == "\t" else "csv", d)
    return Detection("log", "log") if share >= 0.6 else Detection("text", "txt")


def sniff_bytes(head: bytes, name: str = "") -> Detection:
    if head[:2] == b"PK":
        if b"xl/" in head or name.lower().endswith(".xlsx"):
            return Detection("table", "xlsx")
        return Detection("unknown", "office") if b"word/" in head or b"ppt/" in head else Detection("archive", "zip")
    for sign, at, modality, form in MAGIC:
        if head[at : at + len(sign)] == sign:
            return Detection(modality, form)
    if b"\x00" in head[:1024]:
        return Detection("unknown", "binary")
    return text_kind(decode(head), len(head) < HEAD)


_FOUND = T.StructType([T.StructField("modality", T.StringType()), T.StructField("format", T.StringType()), T.StructField("detail", T.StringType())])


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """An entry per file below a folder: path, size, modality, format, detail, class (first folder); a distributed scan."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)

    @F.pandas_udf(_FOUND)
    def told(heads: pd.Series, names: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(d.modality, d.format, d.detail) for d in map(sniff_bytes, heads, names)], columns=_FOUND.names)

    root = re.escape(folder.rstrip("/").split("://")[-1].lstrip("/"))
    rel = F.regexp_replace("path", rf"^.*?{root}/", "")
    found = files.select(rel.alias("path"), F.col("length").alias("size"), F.substring("content", 1, HEAD).alias("head"))
    out = found.withColumn("d", told("head", "path")).select("path", "size", "d.*")
    return out.withColumn("class", F.when(F.instr("path", "/") > 0, F.split_part("path", F.lit("/"), F.lit(1))).otherwise(""))


def manifest(entries: DataFrame) -> dict:
    """Counts by modality, the dominant one, whether several are mixed, whether folders are labels."""
    known = entries.filter(~F.col("modality").isin("unknown", "archive"))
    counts = {r["modality"]: r["n"] for r in known.groupBy("modality").agg(F.count("*").alias("n")).collect()}
    facts = known.agg(F.count("*").alias("n"), F.count_if(F.col("class") != "").alias("grouped"), F.countDistinct(F.when(F.col("class") != "", F.col("class"))).alias("groups")).first()
    dominant = max(counts, key=lambda m: (counts[m], m)) if counts else None
    return {
        "counts": counts, "dominant": dominant, "is_mixed": len(counts) > 1, "skipped": entries.count() - facts["n"],
        "folders_as_labels": facts["groups"] >= 2 and facts["grouped"] >= 0.9 * facts["n"],
    }


def subset(entries: DataFrame, modality: str) -> DataFrame:
    """Files of one modality, with paths from their common folder on."""
    own = entries.filter(F.col("modality") == modality)
    ends = own.agg(F.min("path").alias("a"), F.max("path").alias("z")).first()
    shared = os.path.commonprefix([ends["a"] or "", ends["z"] or ""]).rpartition("/")[0]
    return own.withColumn("path", F.substring("path", len(shared) + 2, 1_000_000)) if shared else own


class UnsafeArchive(ValueError):
    pass


# Limits of archives.
MOST_RATIO, MOST_BYTES, MOST_ENTRIES, MOST_DEPTH = 200, 2 << 30, 10_000, 2


def safe_unzip(archive: str, to: str, depth: int = 1) -> list[str]:
    """Unpack without leaving the folder, links, bombs, encrypted entries or deep nesting; sizes are checked as they come."""
    out, total = [], 0
    with zipfile.ZipFile(archive) as z:
        infos = z.infolist()
        if len(infos) > MOST_ENTRIES:
            raise UnsafeArchive("too many entries")
        if sum(i.file_size for i in infos) > MOST_BYTES:
            raise UnsafeArchive("too large")
        for i in infos:
            name = i.filename.replace("\\", "/")
            parts = [p for p in name.split("/") if p not in ("", ".")]
            if name.startswith("/") or ".." in parts or re.match(r"^[A-Za-z]:", name):
                raise UnsafeArchive(f"path {name!r}")
            if stat.S_ISLNK(i.external_attr >> 16):
                raise UnsafeArchive(f"link {name!r}")
            if i.flag_bits & 1:
                raise UnsafeArchive("encrypted")
            if i.file_size > MOST_RATIO * max(1, i.compress_size) and i.file_size > 1 << 20:
                raise UnsafeArchive(f"compression of {name!r}")
            if i.is_dir() or not parts or parts[0] == "__MACOSX" or parts[-1].startswith("._") or parts[-1] in (".DS_Store", "Thumbs.db"):
                continue
            path = os.path.join(to, *[re.sub(r'[<>:"|?*\x00-\x1f]', "_", p) for p in parts])
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with z.open(i) as src, open(path, "wb") as dst:
                while block := src.read(1 << 20):
                    total += len(block)
                    if total > MOST_BYTES:
                        raise UnsafeArchive("too large")
                    dst.write(block)
            if path.lower().endswith(".zip"):
                if depth >= MOST_DEPTH:
                    raise UnsafeArchive("nested too deep")
                out += safe_unzip(path, path[:-4], depth + 1)
                os.remove(path)
            else:
                out.append(path)
    return out
