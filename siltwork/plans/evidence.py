"""Evidence: every figure under an artifact and a dotted key, and claims checked against it."""

from __future__ import annotations

import json
import math
import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltwork.functions import fixed as V
from siltwork.functions import texts as X

SCHEMA = "artifact_id string, kind string, tool string, key string, value_double double, value_string string, summary string"
CAUSAL = re.compile(V.CAUSAL)


def flatten(data: Any, prefix: str = "") -> dict[str, Any]:
    """Nested maps and lists as dotted keys; places in lists are parts of keys."""
    if isinstance(data, dict):
        items = data.items()
    elif isinstance(data, list | tuple):
        items = enumerate(data)
    else:
        return {prefix: data}
    out: dict[str, Any] = {}
    for k, v in items:
        out |= flatten(v, f"{prefix}.{k}" if prefix else str(k))
    return out


class Evidence:
    """Collects artifacts on the driver (summaries, never rows) and shows them as a table."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._rows: list[tuple] = []
        self._next: dict[str, int] = {}

    def add(self, prefix: str, kind: str, tool: str, summary: str, data: dict) -> str:
        self._next[prefix] = self._next.get(prefix, 0) + 1
        name = f"{prefix}_{self._next[prefix]:03d}"
        for k, v in flatten(data).items():
            number = float(v) if isinstance(v, int | float) and not isinstance(v, bool) else None
            number = None if number is not None and not math.isfinite(number) else number
            self._rows.append((name, kind, tool, k, number, None if v is None else str(v), summary))
        return name

    def add_frame(self, prefix: str, kind: str, tool: str, summary: str, df: DataFrame, key: str, most: int = 10_000) -> str:
        """A small result, a row per key."""
        return self.add(prefix, kind, tool, summary, {str(r[key]): {c: r[c] for c in df.columns if c != key} for r in df.limit(most).collect()})

    def table(self) -> DataFrame:
        df = self.spark.createDataFrame(self._rows, SCHEMA)
        return df.withColumn("summary", X.mask_injection(F.col("summary")))


def lookup(evidence: DataFrame, claims: DataFrame) -> DataFrame:
    """claims (claim_id, artifact_ids, key) -> claim_id, value: by the key itself, else by its end, else by its parts.

    The first cited artifact that has the key wins; an end or parts count if all keys they fit have one value.
    """
    cited = claims.select("claim_id", "key", F.posexplode("artifact_ids").alias("place", "artifact_id"))
    cited = cited.withColumn("key", F.when(F.col("key").startswith(F.concat(F.col("artifact_id"), F.lit("."))), F.substring("key", F.length("artifact_id") + 2, F.lit(10_000))).otherwise(F.col("key")))
    e = evidence.select(F.col("artifact_id").alias("e_id"), F.col("key").alias("e_key"), "value_double", "value_string")
    both = cited.join(e, F.col("artifact_id") == F.col("e_id"))
    parts = lambda c: F.split(F.lower(c), r"[._]")
    level = (
        F.when(F.col("e_key") == F.col("key"), 0).when(F.col("e_key").endswith(F.concat(F.lit("."), F.col("key"))), 1)
        .when(F.size(F.array_except(parts(F.col("key")), parts(F.col("e_key")))) == 0, 2)
    )
    hits = both.withColumn("level", level).filter("level IS NOT NULL")
    per = hits.groupBy("claim_id", "level", "place").agg(F.count_distinct("value_string").alias("values"), F.first("value_double").alias("value"), F.first("value_string").alias("text"))
    one = per.filter("values <= 1").groupBy("claim_id").agg(F.min_by(F.struct("value", "text"), F.struct("level", "place")).alias("v"))
    return claims.select("claim_id").join(one, "claim_id", "left").select("claim_id", F.col("v.value").alias("value"), F.col("v.text").alias("text"))


def lookup_all(evidence: DataFrame, claims: DataFrame) -> DataFrame:
    """claims (claim_id, artifact_ids, key) -> claim_id, artifact_id, value: one value for each cited artifact that has the
    key, by the rules of lookup, and each item of a list of numbers that stands under it."""
    one = claims.select("claim_id", "key", F.explode("artifact_ids").alias("artifact_id")).distinct()
    one = one.withColumn("own_id", F.concat_ws("\x00", "claim_id", "artifact_id"))
    key = F.trim("key")
    named = F.lower(key).startswith(F.concat(F.lower("artifact_id"), F.lit(".")))
    one = one.withColumn("key", F.when(named, F.substring(key, F.length("artifact_id") + 2, F.length(key))).otherwise(key))
    place = F.regexp_extract("key", r"^(.*)\.\d+$", 1)
    flat = F.coalesce(F.col("value_double").isNotNull(), F.lit(False))
    lists = evidence.filter(place != "").groupBy("artifact_id", place.alias("key")).agg(F.bool_and(flat).alias("numbers"), F.array_sort(F.collect_list(F.struct(F.regexp_extract("key", r"(\d+)$", 1).cast("int").alias("k"), "value_double"))).alias("items"))
    items = one.join(lists.filter("numbers"), ["artifact_id", "key"]).select("own_id", "claim_id", "artifact_id", F.explode("items.value_double").alias("value"))
    rest = one.join(items.select("own_id").distinct(), "own_id", "left_anti")
    single = lookup(evidence, rest.select(F.col("own_id").alias("claim_id"), F.array("artifact_id").alias("artifact_ids"), "key")).filter("text IS NOT NULL")
    found = rest.join(single.select(F.col("claim_id").alias("own_id"), "value"), "own_id").select("claim_id", "artifact_id", "value")
    return items.select("claim_id", "artifact_id", "value").union(found)


def matches(a, b):
    return F.abs(a - b) <= F.greatest(F.abs(a) * 0.01, F.lit(0.06))


def find_value(evidence: DataFrame, numbers: DataFrame, most: int = 3) -> DataFrame:
    """numbers (number) -> number, artifact_id, key of up to `most` figures within one percent, or 0.06, of it."""
    from pyspark.sql import Window as W

    e = evidence.filter(~F.col("kind").isin("chart") & F.col("value_double").isNotNull())
    # buckets on a logarithmic scale, neighbours included, make the tolerance an equi-join; small numbers share one
    def bucket(c):
        return F.when(F.abs(c) < 10, F.lit(0).cast("long")).otherwise(F.floor(F.log(F.abs(c)) / F.lit(math.log(1.02))).cast("long"))

    n = numbers.select("number").distinct().withColumn("b", F.explode(F.array(bucket(F.col("number")) - 1, bucket(F.col("number")), bucket(F.col("number")) + 1, F.lit(0).cast("long")))).distinct()
    hit = n.join(e.withColumn("b", bucket(F.col("value_double"))), "b").filter(matches(F.col("value_double"), F.col("number")))
    # a number that is itself a key, as in rates.16000; from 1000 on, so that places in lists don't count
    last = e.withColumn("last", F.regexp_extract("key", r"\.(\d+)$", 1)).filter("last <> ''").withColumn("number", F.col("last").cast("double")).filter("number >= 1000")
    named = numbers.select("number").distinct().join(last, "number").select("number", "artifact_id", F.regexp_replace("key", r"\.\d+$", "").alias("key"))
    hit = hit.select("number", "artifact_id", "key").union(named)
    rank = F.row_number().over(W.partitionBy("number").orderBy("artifact_id", "key"))
    return hit.distinct().withColumn("rank", rank).filter(F.col("rank") <= most).drop("rank")


_NUMBER, _SCALE, _NAME = re.compile(V.CLAIMED_NUMBER), re.compile(V.SCALE), re.compile(r"(?=[\w.-]*[A-Za-z])(?=[\w.-]*\d)\w[\w.]*(?:[-_][\w.]+)+")


def prose_numbers(text: str) -> list[float]:
    """Numbers that a text claims: no parts of names such as tbl_01 or model-3.5-x, no scales, no whole numbers under 10,
    no years."""
    bare = _SCALE.sub(" ", _NAME.sub(" ", text))
    claims = [(m[0].endswith("%") or "." in m[0], float(m[0].rstrip("%").replace(",", ""))) for m in _NUMBER.finditer(bare)]
    return [value for exact, value in claims if exact or not (abs(value) < 10 or 1900 <= value <= 2100)]


def fact_check(spark: SparkSession, findings: list[dict], evidence: DataFrame, least: int = 3, exact_counts: bool = False) -> list[str]:
    """What is wrong with findings (title, text, evidence ids, metrics {key: value}); an empty list if nothing is.

    A metric may be off by one percent, or 0.06. With exact_counts that holds for measures only: a whole number claimed of
    a whole number is that number."""
    errors = []
    if len(findings) < least:
        errors.append(f"{least} findings at least are asked for")
    ids = {r[0] for r in evidence.select("artifact_id").distinct().collect()}
    claims, prose = [], []
    for k, f in enumerate(findings):
        if unknown := set(f.get("evidence", ())) - ids:
            errors.append(f"finding {k + 1}: unknown evidence {', '.join(sorted(unknown))}")
        if CAUSAL.search(f.get("text", "")):
            errors.append(f"finding {k + 1}: it claims a cause")
        known = [x for x in f.get("evidence", ()) if x in ids]
        claims += [(f"{k}:{key}", known, key, float(v)) for key, v in f.get("metrics", {}).items()]
        prose += [(k, known, v) for v in prose_numbers(f.get("text", ""))]
    if claims:
        c = spark.createDataFrame(claims, "claim_id string, artifact_ids array<string>, key string, claimed double")
        for r in lookup(evidence, c.drop("claimed")).join(c.select("claim_id", "claimed"), "claim_id").collect():
            counted = exact_counts and r["claimed"].is_integer() and re.fullmatch(r"-?\d+", r["text"] or "")
            if r["value"] is None or abs(r["value"] - r["claimed"]) > (0 if counted else max(abs(r["claimed"]) * 0.01, 0.06)):
                k, _, key = r["claim_id"].partition(":")
                errors.append(f"finding {int(k) + 1}: {key} is {r['value']}, not {r['claimed']}")
    if prose:
        p = spark.createDataFrame(prose, "k int, artifact_ids array<string>, number double")
        found = find_value(evidence, p, 1000).select("number", "artifact_id")
        good = p.select("k", "number", F.explode_outer("artifact_ids").alias("artifact_id")).join(found, ["number", "artifact_id"], "left_semi").select("k", "number")
        for r in p.join(good, ["k", "number"], "left_anti").select("k", "number").distinct().orderBy("k", "number").collect():
            errors.append(f"finding {r['k'] + 1}: {r['number']:g} is in none of its evidence")
    return errors


def brief(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("artifact_id").agg(F.first("summary").alias("s")).select(F.concat(F.lit("["), F.col("artifact_id"), F.lit("] "), F.col("s")).alias("line"))


def check_target(df: DataFrame, target: str) -> str | None:
    """Why a column can't be a target; none if it can."""
    if target not in df.columns:
        return "no such column"
    r = df.agg(F.count(target).alias("n"), F.countDistinct(target).alias("d")).first()
    text = df.schema[target].dataType.typeName() == "string"
    return "it looks like an identifier" if text and r["n"] >= 20 and r["d"] >= 0.95 * r["n"] else None


def to_json(data: Any) -> str:
    def clean(x):
        if isinstance(x, dict):
            return {k: clean(v) for k, v in x.items()}
        if isinstance(x, list | tuple):
            return [clean(v) for v in x]
        return None if isinstance(x, float) and not math.isfinite(x) else x

    return json.dumps(clean(data), ensure_ascii=False, default=str)
