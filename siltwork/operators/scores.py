"""Scores of data quality, tables behind charts, and timelines of videos, all as small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltwork.functions import fixed as X
from siltwork.functions import texts as T
from siltwork.functions import values as V
from siltwork.operators.near import near_audio_groups, near_image_groups, near_text_groups, near_video_groups
from siltwork.operators.profile import median, quantile_values
from siltwork.operators.registry import RID
from siltwork.operators.textprof import categories, label_check, media_category, scene_rows
from siltwork.session import cut_lineage


def deductions(shares: DataFrame, media: str) -> DataFrame:
    """shares (part, amount) -> part, deduction: what each part takes from 100, by its rate and up to its most.

    Parts that the table lacks take nothing; label_imbalance and class_imbalance are given as the ratio of the largest
    class to the smallest one, all others in percent of the items (cross_class: as a number)."""
    spark = shares.sparkSession
    rates = spark.createDataFrame([(k, p, float(r), float(m)) for k, (p, r, m) in enumerate(X.DEDUCTIONS[media])], "place int, part string, rate double, most double")
    held = rates.join(shares, "part", "left")
    amount = F.when(F.col("part").endswith("_imbalance"), F.greatest(F.lit(0.0), F.coalesce("amount", F.lit(1.0)) - 1.5)).otherwise(F.coalesce("amount", F.lit(0.0)))
    return held.select("place", "part", (0.0 - F.round(F.least(F.col("most"), amount * F.col("rate")), 1)).alias("deduction"))


def told(shares: DataFrame, media: str) -> DataFrame:
    """shares (part, amount) -> part, amount, deduction, of which the amounts are worked out once."""
    held = cut_lineage(shares)
    return deductions(held, media).join(held, "part", "left").select("part", V.r4(F.col("amount")).alias("amount"), "deduction")


def score(parts: DataFrame) -> DataFrame:
    """One row: 100 less all deductions, none below 0."""
    return parts.agg(F.round(F.greatest(F.lit(0.0), 100 + F.coalesce(F.sum("deduction"), F.lit(0.0))), 1).alias("score"))


def imbalance(df: DataFrame, label: str = "class") -> DataFrame:
    """One row: the size of the largest class through that of the smallest one; null without classes."""
    n = df.filter(F.coalesce(F.col(label), F.lit("")) != "").groupBy(label).agg(F.count("*").alias("n"))
    return n.agg((F.max("n") / F.greatest(F.min("n"), F.lit(1))).alias("ratio"))


def _shares(total: DataFrame, parts: dict[str, Column]) -> DataFrame:
    return total.select(F.explode(F.array(*[F.struct(F.lit(p).alias("part"), c.cast("double").alias("amount")) for p, c in parts.items()])).alias("s")).select("s.*")


def extra_copies(groups: DataFrame) -> DataFrame:
    """One row: copies beyond the first of each group."""
    return groups.agg((F.count("*") - F.count_distinct("label")).alias("extra"))


def text_shares(docs: DataFrame, label: str = "class") -> DataFrame:
    """docs (rid, text, class) -> part, amount for deductions(..., 'text')."""
    told = categories(docs).groupBy("category").agg(F.count("*").alias("c"))
    low = F.col("category").isin("empty", "encoding_damage", "html_markup", "too_short")
    c = told.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("all"), F.coalesce(F.sum(F.when(low, F.col("c"))), F.lit(0)).alias("low"), F.coalesce(F.sum(F.when(F.col("category") == "other_language", F.col("c"))), F.lit(0)).alias("other"))
    private = docs.agg(F.count_if(F.size(T.pii(F.col("text"))) > 0).alias("private"))
    wrong = label_check(docs.filter(F.coalesce(F.col(label), F.lit("")) != ""), label).agg(F.count_if("suspected").alias("wrong"))
    row = c.join(private).join(extra_copies(near_text_groups(docs))).join(wrong).join(imbalance(docs, label))
    n = F.greatest("all", F.lit(1))
    return _shares(row, {
        "low_quality": 100 * F.col("low") / n, "duplicates": 100 * F.col("extra") / n, "privacy": 100 * F.col("private") / n,
        "other_language": 100 * F.col("other") / n, "label_noise": 100 * F.col("wrong") / n, "label_imbalance": F.coalesce("ratio", F.lit(1.0)),
    })


def media_shares(files: DataFrame, media: str, label: str = "class") -> DataFrame:
    """files (rid, class, metrics) -> part, amount for deductions(..., media)."""
    told = media_category(files, media)
    c = told.agg(F.count("*").alias("all"), F.count_if(F.col("category") == "corrupt").alias("corrupt"), F.count_if(~F.col("category").isin("corrupt", "ok")).alias("low"))
    groups = {"image": near_image_groups, "audio": near_audio_groups, "video": near_video_groups}[media](files)
    row = c.join(extra_copies(groups)).join(imbalance(files, label))
    n = F.greatest("all", F.lit(1))
    parts = {"corrupt": 100 * F.col("corrupt") / n, "duplicates": 100 * F.col("extra") / n, "unusable" if media == "video" else "low_quality": 100 * F.col("low") / n, "class_imbalance": F.coalesce("ratio", F.lit(1.0))}
    if media == "image":
        named = groups.join(files.select(F.col(RID).alias("id"), F.coalesce(label, F.lit("")).alias("c")), "id").filter("c <> ''")
        cross = named.groupBy("label").agg(F.count_distinct("c").alias("k")).agg(F.count_if(F.col("k") > 1).alias("cross"))
        row, parts = row.join(cross), parts | {"cross_class": F.col("cross")}
    if media == "video":
        row = row.join(files.agg(F.count_if(~F.coalesce(F.col("has_audio"), F.lit(False)) & ~F.coalesce(F.col("corrupt"), F.lit(False))).alias("silent")))
        parts |= {"silent_audio": 100 * F.col("silent") / n}
    return _shares(row, parts)


def media_overview(files: DataFrame, figures: list[str], flags: list[str], kinds: list[str]) -> DataFrame:
    """(fact, value, number): least, median, greatest and sum of figures, counts of flags, and how often each kind of value
    occurs, of the files that can be read."""
    ok = files.filter(~F.coalesce(F.col("corrupt"), F.lit(False)))
    facts = [F.struct(F.lit("files").alias("fact"), F.lit("all").alias("value"), F.count("*").cast("double").alias("number"))]
    middle = {c: F.lit(q[0]) for c, q in quantile_values(ok, figures, [0.5]).items()}
    for c in figures:
        v = F.col(c).cast("double")
        facts += [F.struct(F.lit(c).alias("fact"), F.lit(name).alias("value"), V.r4(x).alias("number")) for name, x in (("min", F.min(v)), ("median", middle.get(c, F.lit(None).cast("double"))), ("max", F.max(v)), ("total", F.sum(v)))]
    facts += [F.struct(F.lit(c).alias("fact"), F.lit("true").alias("value"), F.count_if(F.col(c).cast("boolean")).cast("double").alias("number")) for c in flags]
    out = ok.agg(F.array(*facts).alias("f")).select(F.explode("f").alias("f")).select("f.*")
    for c in kinds:
        out = out.union(ok.groupBy(F.col(c).cast("string").alias("value")).agg(F.count("*").cast("double").alias("number")).select(F.lit(c).alias("fact"), "value", "number"))
    return out


def ranked_bars(counts: DataFrame, top: int = 15) -> DataFrame:
    """counts (value, n) -> rank, value, n, pct (of all) of the largest; ties by name."""
    total = counts.agg(F.sum("n").alias("all"))
    first = counts.orderBy(F.desc("n"), "value").limit(top)
    ranked = first.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "value"))).alias("l")).select(F.posexplode("l").alias("k", "x"))
    return ranked.join(F.broadcast(total)).select((F.col("k") + 1).alias("rank"), F.col("x.value").alias("value"), (-F.col("x.m")).alias("n"), V.r4(100 * -F.col("x.m") / F.col("all")).alias("pct"))


def balance(df: DataFrame, label: str = "class") -> DataFrame:
    """One row: classes, items, even split, ratio of the largest to the smallest, and what that is called."""
    n = df.filter(F.coalesce(F.col(label).cast("string"), F.lit("")) != "").groupBy(label).agg(F.count("*").alias("n"))
    ratio = F.col("hi") / F.greatest("lo", F.lit(1))
    return n.agg(F.count("*").alias("classes"), F.sum("n").alias("items"), F.max("n").alias("hi"), F.min("n").alias("lo")).select(
        "classes", "items", V.r4(F.col("items") / F.greatest("classes", F.lit(1))).alias("even_split"), V.r4(ratio).alias("ratio"),
        F.when(F.coalesce(ratio, F.lit(1.0)) < 1.5, "balanced").when(ratio < 3, "imbalanced").otherwise("heavily imbalanced").alias("verdict"),
    )


def skew_note(mean: Column, median: Column) -> Column:
    return F.when((mean > median * 1.15) & (median > 0), "right-skewed").otherwise("")


def group_scorecard(parts: DataFrame) -> DataFrame:
    """parts (modality, status, quality_before, quality_after, items_before, items_after) -> one row over those done."""
    done = parts.filter(F.col("status") == "done")
    gain = F.round(F.col("quality_after") - F.col("quality_before"), 1)
    return done.agg(
        F.count("*").alias("types"), F.round(F.avg("quality_before"), 1).alias("quality_before"), F.round(F.avg("quality_after"), 1).alias("quality_after"),
        F.sum("items_before").alias("items_before"), F.sum("items_after").alias("items_after"),
        F.min(F.struct((-gain).alias("loss"), "modality")).alias("best"),
    ).select("types", "quality_before", "quality_after", "items_before", "items_after", F.col("best.modality").alias("helped_most"), (-F.col("best.loss")).alias("gain"))


def clean_transcript(c: Column) -> Column:
    """Without signs of music and brackets; empty where nothing was said."""
    text = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[♪♫*\[\]()]+", " "))
    bare = F.trim(F.regexp_replace(F.lower(text), r"(?U)[^\w\s']", ""))
    return F.when((bare == "") | bare.isin(*X.NOTHING_SAID), "").otherwise(text)


def scenes_with_speech(videos: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Scenes of each video with what was said in them; transcripts are keyed path#s<n>."""
    said = transcripts.select(F.col("path").alias("key"), clean_transcript(F.col("text")).alias("text"), F.coalesce("words", F.lit(0)).cast("long").alias("words"))
    scenes = scene_rows(videos.filter(~F.coalesce(F.col("corrupt"), F.lit(False)))).withColumn("key", F.concat("path", F.lit("#s"), F.col("n").cast("string")))
    return scenes.join(said, "key", "left").select("path", "n", "start", "end", F.coalesce("words", F.lit(0).cast("long")).alias("words"), F.coalesce("text", F.lit("")).alias("said"))


def timeline_facts(scenes: DataFrame) -> DataFrame:
    """One row on the scenes of scenes_with_speech."""
    middle = median(scenes, F.col("end") - F.col("start"))
    return scenes.agg(
        F.count("*").alias("scenes"), V.r4(F.lit(middle or 0.0)).alias("median_scene_seconds"),
        F.count_distinct(F.when(F.col("words") > 0, F.col("path"))).alias("videos_with_speech"), F.count_if(F.col("words") > 0).alias("scenes_with_speech"),
    )
