"""Registered queries on tables of media metrics: an operation each, with the column it sets or the rows it keeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltwork.operators import near, scores
from siltwork.operators.registry import apply_op
from siltwork.plans.queries import deducted_sql, query
from siltwork.session import read_table

#: the tables made of parts, as select lists that Spark and DuckDB read alike
IMAGES = """p_partkey AS rid, p_name || '/' || p_partkey AS path, p_brand AS class, md5(p_type || '|' || p_size) AS sha256, p_size = 50 AS corrupt, p_size * 4 AS width, p_size * 3 AS height,
p_retailprice / 8 AS brightness, p_size / 4.0 AS contrast, CASE WHEN p_size > 3 THEN p_retailprice / 10 END AS blur"""
AUDIO = """p_partkey AS rid, p_name || '/' || p_partkey AS path, p_brand AS class, md5(p_type || '|' || p_size) AS sha256, p_size = 50 AS corrupt, p_size / 50.0 AS silence_ratio, p_size / 20.0 AS duration,
p_size / 40000.0 AS clipping, p_retailprice / 50 AS snr_db, -p_size * 1.0 AS rms_db"""
VIDEO = """p_partkey AS rid, p_name || '/' || p_partkey AS path, p_brand AS class, md5(p_type || '|' || p_size) AS sha256, p_size = 50 AS corrupt, p_size / 10.0 AS duration, p_retailprice / 20 AS brightness,
p_size / 5.0 AS motion, p_size > 5 AS has_audio, CASE WHEN p_size % 4 = 0 THEN 90 ELSE 0 END AS rotation, CASE WHEN p_size > 45 THEN 0.95 ELSE 0.0 END AS black_ratio"""
TABLES = {"image": IMAGES, "audio": AUDIO, "video": VIDEO}


def files(spark, d, media):
    return read_table(spark, d, "part").selectExpr(*_parts(TABLES[media]))


def _parts(select: str) -> list[str]:
    out, depth, at = [], 0, 0
    for k, c in enumerate(select + ","):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(select[at:k].strip())
            at = k + 1
    return out


def _op(media: str, name: str, sql: str, keep: tuple[str, ...] = ("rid",), **params) -> None:
    def run(spark, d):
        return apply_op(files(spark, d, media), media, name, None, params).select(*keep)

    query(f"WITH f AS (SELECT {TABLES[media]} FROM part) {sql}", f"{media}_{name}")(run)


for _m in TABLES:
    _op(_m, "remove_corrupt", "SELECT rid FROM f WHERE NOT corrupt")
    _op(_m, "drop_exact_duplicates", "SELECT min(rid) AS rid FROM f GROUP BY sha256")
_op("image", "drop_too_small", "SELECT rid FROM f WHERE least(width, height) >= 32")
_op("image", "drop_blurry", "SELECT rid FROM f WHERE coalesce(blur, 0) >= 91", min_blur=91.0)
_op("image", "drop_too_dark", "SELECT rid FROM f WHERE brightness > 113", min_brightness=113.0)
_op("image", "drop_too_bright", "SELECT rid FROM f WHERE brightness < 114", max_brightness=114.0)
_op("image", "drop_near_blank", "SELECT rid FROM f WHERE contrast >= 4")
_op("audio", "drop_silent", "SELECT rid FROM f WHERE silence_ratio < 0.97")
_op("audio", "drop_too_short", "SELECT rid FROM f WHERE duration >= 0.3")
_op("audio", "drop_clipped", "SELECT rid FROM f WHERE clipping <= 0.001")
_op("audio", "drop_noisy", "SELECT rid FROM f WHERE snr_db >= 18.2", min_snr_db=18.2)
_op("video", "drop_too_short", "SELECT rid FROM f WHERE duration >= 1")
_op("video", "drop_black", "SELECT rid FROM f WHERE brightness >= 45.5", min_brightness=45.5)
_op("video", "drop_frozen", "SELECT rid FROM f WHERE motion >= 1")
_op("video", "drop_without_audio", "SELECT rid FROM f WHERE has_audio")
for _m, _n, _c, _v, _p in (
    ("image", "fix_exif_orientation", "apply_orientation", "true", {}), ("image", "convert_to_rgb", "to_rgb", "true", {}), ("image", "strip_exif", "strip_metadata", "true", {}), ("image", "resize_max_side", "max_side", "640", {"max_side": 640}),
    ("audio", "to_mono", "mono", "true", {}), ("audio", "trim_silence", "trim_ends", "true", {}), ("audio", "convert_to_wav", "to_wav", "true", {}), ("audio", "resample", "sample_rate_to", "8000", {"sample_rate": 8000}), ("audio", "normalize_loudness", "loudness_to", "-18.0::DOUBLE", {"target_dbfs": -18.0}),
    ("video", "fix_rotation", "apply_rotation", "rotation <> 0", {}), ("video", "downscale", "max_height", "480", {"max_height": 480}), ("video", "trim", "max_seconds", "30.0::DOUBLE", {"max_seconds": 30.0}), ("video", "strip_audio", "drop_audio", "true", {}), ("video", "extract_audio", "audio_out", "true", {}), ("video", "sample_frames", "frames_per_second", "2.0::DOUBLE", {"fps": 2.0}),
):
    _op(_m, _n, f"SELECT rid, {_v} AS {_c} FROM f", ("rid", _c), **_p)


def _named(media: str) -> None:
    """The two operations on named files: those of the two least keys."""

    def two(f):
        return [r["path"] for r in f.orderBy("rid").select("path").limit(2).collect()]

    def drop(spark, d):
        f = files(spark, d, media)
        return apply_op(f, media, "drop_files", None, {"files": two(f)}).select("rid")

    def flag(spark, d):
        f = files(spark, d, media)
        return apply_op(f, media, "flag_suspected_mislabels", None, {"files": two(f)}).select("rid", "suspected_mislabel")

    query("SELECT p_partkey AS rid FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM part ORDER BY 1 LIMIT 2)", f"{media}_drop_files")(drop)
    query("SELECT p_partkey AS rid, p_partkey IN (SELECT p_partkey FROM part ORDER BY 1 LIMIT 2) AS suspected_mislabel FROM part", f"{media}_flag_suspected_mislabels")(flag)


for _m in TABLES:
    _named(_m)

# ---------------------------------------------------------------- near duplicates of media, on signatures made from vectors

_HEX = "lower(lpad(to_hex(cast(least(255, greatest(0, floor(128 + 96 * embedding[{k}]))) AS BIGINT)), 2, '0'))"


def _signature_sql(n: int) -> str:
    return " || ".join(_HEX.format(k=k + 1) for k in range(n))


def _signature(n: int):
    byte = lambda k: F.lpad(F.lower(F.hex(F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor(128 + 96 * F.element_at("embedding", k + 1).cast("double")).cast("double"))).cast("long"))), 2, "0")
    return F.concat(*[byte(k) for k in range(n)])


#: each vector twice, once a bit off in its first byte, so that there are pairs
_TWICE_SQL = f"""v AS (SELECT vec_id AS rid, label, {_signature_sql(16)} AS s FROM embeddings), w AS (SELECT rid, label, s FROM v UNION ALL SELECT rid + 1000000000, label + 1, CASE WHEN substr(s, 1, 2) = 'ff' THEN 'fe' ELSE lower(lpad(to_hex(('0x' || substr(s, 1, 2))::INTEGER + 1), 2, '0')) END || substr(s, 3) FROM v)"""
_DISTANCE = "list_sum(list_transform(range(0, 16), lambda k: abs(('0x' || substr(x.s, 2 * k + 1, 2))::INTEGER - ('0x' || substr(y.s, 2 * k + 1, 2))::INTEGER))) / 16.0"


def _twice(spark, d):
    v = read_table(spark, d, "embeddings").select(F.col("vec_id").alias("rid"), F.col("label").cast("long").alias("label"), _signature(16).alias("s"))
    head = F.conv(F.substring("s", 1, 2), 16, 10).cast("int")
    other = F.concat(F.when(head == 255, "fe").otherwise(F.lpad(F.lower(F.hex(head + 1)), 2, "0")), F.substring("s", 3, 100))
    return v.union(v.select(F.col("rid") + 1_000_000_000, F.col("label") + 1, other))


def _groups_sql(pairs: str) -> str:
    """Components of pairs (a, b) by reaching out."""
    return f"""e AS ({pairs}), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS id, a AS x FROM u UNION SELECT r.id, u.b FROM r JOIN u ON u.a = r.x)
SELECT id, min(x) AS label FROM r GROUP BY id"""


@query(f"WITH RECURSIVE {_TWICE_SQL}, {_groups_sql(f'SELECT x.rid AS a, y.rid AS b FROM w x JOIN w y ON x.rid < y.rid AND {_DISTANCE} <= 3.0')}")
def audio_near_groups(spark, d):
    return near.near_audio_groups(_twice(spark, d).select("rid", F.lit(2.0).alias("duration"), F.col("s").alias("signature")))


@query(f"WITH RECURSIVE {_TWICE_SQL}, {_groups_sql(f'SELECT x.rid AS a, y.rid AS b FROM w x JOIN w y ON x.rid < y.rid AND x.rid % 7 = y.rid % 7 AND {_DISTANCE} <= 6.0')}")
def video_near_groups(spark, d):
    # durations far apart part what would else be near
    t = _twice(spark, d)
    return near.near_video_groups(t.select("rid", F.pow(F.lit(2.0), F.col("rid") % 7).alias("duration"), F.col("s").alias("signature")))


def _image_table(spark, d):
    return _twice(spark, d).select("rid", F.col("label").cast("string").alias("class"), F.substring("s", 1, 16).alias("phash"), F.col("s").alias("thumb"))


_IMAGE_PAIRS = f"""SELECT x.rid AS a, y.rid AS b FROM w x JOIN w y ON x.rid < y.rid AND {_DISTANCE} <= 8.0
AND bit_count(xor(('0x' || substr(x.s, 1, 8))::BIGINT, ('0x' || substr(y.s, 1, 8))::BIGINT)) + bit_count(xor(('0x' || substr(x.s, 9, 8))::BIGINT, ('0x' || substr(y.s, 9, 8))::BIGINT)) <= 6"""


@query(f"WITH RECURSIVE {_TWICE_SQL}, {_groups_sql(_IMAGE_PAIRS)}")
def image_near_groups(spark, d):
    return near.near_image_groups(_image_table(spark, d))


@query(f"WITH RECURSIVE {_TWICE_SQL}, g AS (WITH RECURSIVE {_groups_sql(_IMAGE_PAIRS)}) SELECT rid FROM w WHERE rid NOT IN (SELECT id FROM g WHERE id <> label)")
def image_drop_near_duplicates(spark, d):
    return apply_op(_image_table(spark, d), "image", "drop_near_duplicates").select("rid")


@query(f"""WITH RECURSIVE {_TWICE_SQL}, g AS (WITH RECURSIVE {_groups_sql(_IMAGE_PAIRS)}), m AS (SELECT g.label FROM g JOIN w ON w.rid = g.id GROUP BY 1 HAVING count(DISTINCT w.label) > 1)
SELECT rid FROM w WHERE rid NOT IN (SELECT id FROM g WHERE label IN (SELECT label FROM m))""")
def image_drop_cross_class_duplicates(spark, d):
    return apply_op(_image_table(spark, d), "image", "drop_cross_class_duplicates").select("rid")


@query(f"WITH RECURSIVE {_TWICE_SQL}, g AS (WITH RECURSIVE {_groups_sql(f'SELECT x.rid AS a, y.rid AS b FROM w x JOIN w y ON x.rid < y.rid AND {_DISTANCE} <= 3.0')}) SELECT rid FROM w WHERE rid NOT IN (SELECT id FROM g WHERE id <> label)")
def audio_drop_near_duplicates(spark, d):
    return apply_op(_twice(spark, d).select("rid", F.lit(2.0).alias("duration"), F.col("s").alias("signature")), "audio", "drop_near_duplicates").select("rid")


# ---------------------------------------------------------------- categories, overviews, scores


@query(f"""WITH f AS (SELECT {IMAGES} FROM part), b AS (SELECT 0.25 * quantile_cont(blur, 0.5) AS b FROM f WHERE NOT corrupt)
SELECT rid, CASE WHEN corrupt THEN 'corrupt' WHEN least(width, height) < 32 THEN 'tiny' WHEN brightness < 25 THEN 'too_dark' WHEN brightness > 235 THEN 'too_bright' WHEN contrast < 4 THEN 'near_blank' WHEN blur < b THEN 'blurry' ELSE 'ok' END AS category FROM f, b""")
def image_categories(spark, d):
    from siltwork.operators.textprof import media_category

    return media_category(files(spark, d, "image"), "image").select("rid", "category")


@query(f"""WITH f AS (SELECT {AUDIO} FROM part) SELECT rid, CASE WHEN corrupt THEN 'corrupt' WHEN silence_ratio >= 0.97 THEN 'silent' WHEN duration < 0.3 THEN 'too_short' WHEN clipping > 0.001 THEN 'clipped'
WHEN snr_db < 10 THEN 'noisy' WHEN rms_db < -40 THEN 'very_quiet' ELSE 'ok' END AS category FROM f""")
def audio_categories(spark, d):
    from siltwork.operators.textprof import media_category

    return media_category(files(spark, d, "audio"), "audio").select("rid", "category")


@query(f"""WITH f AS (SELECT {VIDEO} FROM part) SELECT rid, CASE WHEN corrupt THEN 'corrupt' WHEN duration < 1 THEN 'too_short' WHEN black_ratio >= 0.9 THEN 'black' WHEN motion < 1 THEN 'frozen' WHEN brightness < 40 THEN 'very_dark' ELSE 'ok' END AS category FROM f""")
def video_categories(spark, d):
    from siltwork.operators.textprof import media_category

    return media_category(files(spark, d, "video"), "video").select("rid", "category")


_FACTS = " UNION ALL ".join(f"SELECT '{c}' AS fact, '{n}' AS value, round({x}, 4) AS number FROM f WHERE NOT corrupt" for c in ("width", "brightness") for n, x in (("min", f"min({c})::DOUBLE"), ("median", f"quantile_cont({c}, 0.5)::DOUBLE"), ("max", f"max({c})::DOUBLE"), ("total", f"sum({c})::DOUBLE")))


@query(f"""WITH f AS (SELECT {IMAGES} FROM part) SELECT 'files' AS fact, 'all' AS value, count(*)::DOUBLE AS number FROM f WHERE NOT corrupt UNION ALL {_FACTS}
UNION ALL SELECT 'dark', 'true', count(*)::DOUBLE FROM f WHERE NOT corrupt AND brightness < 113 UNION ALL SELECT 'class', class, count(*)::DOUBLE FROM f WHERE NOT corrupt GROUP BY 2""")
def image_overview(spark, d):
    return scores.media_overview(files(spark, d, "image").withColumn("dark", F.col("brightness") < 113), ["width", "brightness"], ["dark"], ["class"])


@query(f"""WITH f AS (SELECT {AUDIO} FROM part), n AS (SELECT count(*)::DOUBLE AS n FROM f), c AS (SELECT class, count(*) AS c FROM f GROUP BY 1),
b AS (SELECT count(*) FILTER (NOT corrupt AND (silence_ratio >= 0.97 OR duration < 0.3 OR clipping > 0.001 OR snr_db < 10 OR rms_db < -40)) AS low, count(*) FILTER (corrupt) AS bad FROM f)
SELECT 'corrupt' AS part, 0.0 - round(least(20, 100 * bad / n * 2), 1) AS deduction FROM b, n UNION ALL SELECT 'low_quality', 0.0 - round(least(25, 100 * low / n * 1.5), 1) FROM b, n
UNION ALL SELECT 'duplicates', 0.0 UNION ALL SELECT 'class_imbalance', 0.0 - round(least(15, greatest(0, (SELECT max(c) / min(c)::DOUBLE FROM c) - 1.5) * 3), 1)""")
def audio_deductions(spark, d):
    # signatures all of other lengths, so that none are near each other
    f = files(spark, d, "audio").withColumn("signature", F.lpad(F.hex(F.col("rid")), 16, "0")).withColumn("duration", F.col("duration")).withColumn("signature", F.md5("path"))
    return scores.deductions(scores.media_shares(f, "audio"), "audio").select("part", "deduction")


#: near copies of few vectors only, some of another class, so that no deduction reaches its most by them alone
_SOME_SQL = f"""{_TWICE_SQL}, i AS (SELECT rid, CASE WHEN rid % 1000 <> 0 AND rid >= 1000000000 THEN label - 1 ELSE label END AS label, s FROM w WHERE rid < 1000000000 OR rid % 50 = 0)"""
_SHOWN = """rid % 29 = 0 AS corrupt, 30 + rid % 60 AS width, 40 AS height, cast(20 + rid % 218 AS DOUBLE) AS brightness, cast(rid % 200 AS DOUBLE) AS contrast,
cast(CASE WHEN rid % 41 = 0 THEN 5 ELSE 50 + rid % 97 END AS DOUBLE) AS blur, CASE WHEN label = 3 AND rid % 3 > 0 THEN 4 ELSE label END AS own"""
_PLAYED = """rid % 31 = 0 AS corrupt, cast(35 + rid % 60 AS DOUBLE) AS brightness, cast(rid % 43 AS DOUBLE) AS motion, cast(rid % 37 AS DOUBLE) / 38 AS black_ratio, rid % 12 <> 0 AS has_audio,
CASE WHEN label = 3 AND rid % 3 > 0 THEN 4 ELSE label END AS own"""


def _some(spark, d, metrics: str):
    t = _twice(spark, d).filter("rid < 1000000000 OR rid % 50 = 0")
    label = F.when((F.col("rid") % 1000 != 0) & (F.col("rid") >= 1_000_000_000), F.col("label") - 1).otherwise(F.col("label"))
    return t.withColumn("label", label).selectExpr("rid", "s", *_parts(metrics)).withColumn("class", F.col("own").cast("string"))


@query(f"""WITH RECURSIVE {_SOME_SQL}, f AS (SELECT rid, {_SHOWN} FROM i), g AS (WITH RECURSIVE {_groups_sql(_IMAGE_PAIRS.replace("w x", "i x").replace("w y", "i y"))}),
b AS (SELECT 0.25 * quantile_cont(blur, 0.5) AS b FROM f WHERE NOT corrupt), c AS (SELECT own, count(*) AS c FROM f WHERE own IS NOT NULL GROUP BY 1),
t AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (corrupt) AS bad, count(*) FILTER (NOT corrupt AND (least(width, height) < 32 OR brightness < 25 OR brightness > 235 OR contrast < 4 OR blur < b)) AS low,
(SELECT count(*) - count(DISTINCT label) FROM g) AS extra, (SELECT max(c) / min(c)::DOUBLE FROM c) AS ratio,
(SELECT count(*) FROM (SELECT g.label FROM g JOIN f ON f.rid = g.id GROUP BY 1 HAVING count(DISTINCT f.own) > 1)) AS crossing FROM f, b)
{deducted_sql({"corrupt": ("100 * bad / n", 20, 2), "duplicates": ("100 * extra / n", 20, 1.5), "low_quality": ("100 * low / n", 25, 1.5), "class_imbalance": ("ratio", 15, 3), "cross_class": ("crossing::DOUBLE", 10, 2)})}""")
def image_deductions(spark, d):
    f = _some(spark, d, _SHOWN).withColumns({"phash": F.substring("s", 1, 16), "thumb": F.col("s")})
    return scores.told(scores.media_shares(f, "image"), "image")


@query(f"""WITH RECURSIVE {_SOME_SQL}, f AS (SELECT rid, {_PLAYED} FROM i),
g AS (WITH RECURSIVE {_groups_sql(f'SELECT x.rid AS a, y.rid AS b FROM i x JOIN i y ON x.rid < y.rid AND x.rid % 1000000000 % 7 = y.rid % 1000000000 % 7 AND {_DISTANCE} <= 6.0')}),
c AS (SELECT own, count(*) AS c FROM f WHERE own IS NOT NULL GROUP BY 1),
t AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (corrupt) AS bad, count(*) FILTER (NOT corrupt AND (black_ratio >= 0.9 OR motion < 1 OR brightness < 40)) AS low,
count(*) FILTER (NOT corrupt AND NOT has_audio) AS silent, (SELECT count(*) - count(DISTINCT label) FROM g) AS extra, (SELECT max(c) / min(c)::DOUBLE FROM c) AS ratio FROM f)
{deducted_sql({"corrupt": ("100 * bad / n", 20, 2), "duplicates": ("100 * extra / n", 15, 1.5), "unusable": ("100 * low / n", 25, 1.5), "silent_audio": ("100 * silent / n", 5, 0.5), "class_imbalance": ("ratio", 15, 3)})}""")
def video_deductions(spark, d):
    f = _some(spark, d, _PLAYED).withColumns({"duration": F.pow(F.lit(2.0), F.col("rid") % 1_000_000_000 % 7), "signature": F.col("s")})
    return scores.told(scores.media_shares(f, "video"), "video")


@query("""WITH p AS (SELECT p_brand AS m, round(avg(p_size), 4) AS b, round(avg(p_size) * 1.37, 4) AS a, count(*) AS ib, count(*) FILTER (p_size > 10) AS ia FROM part WHERE p_brand NOT LIKE '%1' GROUP BY 1)
SELECT count(*) AS types, round(avg(b), 1) AS quality_before, round(avg(a), 1) AS quality_after, cast(sum(ib) AS BIGINT) AS items_before, cast(sum(ia) AS BIGINT) AS items_after,
arg_min(m, (-round(a - b, 1), m)) AS helped_most, max(round(a - b, 1)) AS gain FROM p""")
def group_scorecard_parts(spark, d):
    p = read_table(spark, d, "part").groupBy(F.col("p_brand").alias("modality")).agg(
        F.round(F.avg("p_size"), 4).alias("quality_before"), F.round(F.avg("p_size") * 1.37, 4).alias("quality_after"), F.count("*").alias("items_before"), F.count_if(F.col("p_size") > 10).alias("items_after"),
    )
    return scores.group_scorecard(p.withColumn("status", F.when(F.col("modality").endswith("1"), "failed").otherwise("done")))


@query("""WITH v AS (SELECT 'v' || p_partkey AS path, p_size / 1.0 AS duration, p_size FROM part), s AS (SELECT path, unnest([1, 2, 3]) AS n, unnest([0.0, duration / 4, duration / 2]) AS start, unnest([duration / 4, duration / 2, duration]) AS "end", p_size FROM v WHERE p_size <> 50)
SELECT path, cast(n AS INTEGER) AS n, start::DOUBLE AS start, "end"::DOUBLE AS "end", cast(CASE WHEN n = 2 AND p_size % 3 = 0 THEN 4 ELSE 0 END AS BIGINT) AS words, CASE WHEN n = 2 AND p_size % 3 = 0 THEN 'so many words said' ELSE '' END AS said FROM s""")
def video_scenes_with_speech(spark, d):
    v, said = _videos(spark, d)
    return scores.scenes_with_speech(v, said)


def _videos(spark, d):
    p = read_table(spark, d, "part").select(F.concat(F.lit("v"), F.col("p_partkey").cast("string")).alias("path"), F.col("p_size").cast("double").alias("duration"), "p_size")
    v = p.select("path", "duration", (F.col("p_size") == 50).alias("corrupt"), F.to_json(F.array(F.col("duration") / 2, F.col("duration") / 4, F.col("duration") / 2, F.lit(0.0))).alias("scenes"))
    said = p.filter("p_size % 3 = 0").select(F.concat("path", F.lit("#s2")).alias("path"), F.lit(" ♪ so many words said [").alias("text"), F.lit(4).alias("words"))
    silent = p.select(F.concat("path", F.lit("#s1")).alias("path"), F.lit("[Music]").alias("text"), F.lit(0).alias("words"))
    return v, said.union(silent)


@query("""WITH s AS (SELECT p_partkey, p_size, unnest([p_size / 4.0, p_size / 4.0, p_size / 2.0]) AS x FROM part WHERE p_size <> 50)
SELECT count(*) AS scenes, round(quantile_cont(x, 0.5), 4)::DOUBLE AS median_scene_seconds, count(DISTINCT CASE WHEN p_size % 3 = 0 THEN p_partkey END) AS videos_with_speech,
count(DISTINCT CASE WHEN p_size % 3 = 0 THEN p_partkey END) AS scenes_with_speech FROM s""")
def video_timeline_facts(spark, d):
    v, said = _videos(spark, d)
    return scores.timeline_facts(scores.scenes_with_speech(v, said))


@query(f"WITH RECURSIVE {_TWICE_SQL}, g AS (WITH RECURSIVE {_groups_sql(f'SELECT x.rid AS a, y.rid AS b FROM w x JOIN w y ON x.rid < y.rid AND x.rid % 7 = y.rid % 7 AND {_DISTANCE} <= 6.0')}) SELECT rid FROM w WHERE rid NOT IN (SELECT id FROM g WHERE id <> label)")
def video_drop_near_duplicates(spark, d):
    t = _twice(spark, d).select("rid", F.pow(F.lit(2.0), F.col("rid") % 7).alias("duration"), F.col("s").alias("signature"))
    return apply_op(t, "video", "drop_near_duplicates").select("rid")
