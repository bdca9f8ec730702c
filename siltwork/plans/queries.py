"""Registered queries over the driver's tables, each over whole tables, and what DuckDB must find for the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltwork.functions import fixed as X
from siltwork.functions import texts
from siltwork.operators import links, near, profile, sketches, textprof, timeline
from siltwork.operators.registry import apply_op
from siltwork.plans import plan as plans
from siltwork.plans.evidence import Evidence, find_value, lookup
from siltwork.session import cut_lineage, read_table
from siltwork.sources.readers import split_documents
from siltwork.sources.sinks import neutralized

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def put(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return put


# ---------------------------------------------------------------- a table of strings with the usual faults

MESSY_SQL = """
SELECT o_orderkey AS rid, cast(o_orderkey AS VARCHAR) AS order_id,
  CASE o_orderstatus WHEN 'F' THEN '  fulfilled o''neil ' WHEN 'O' THEN 'OPEN' ELSE 'N/A' END AS status,
  CASE WHEN o_orderpriority = '5-LOW' THEN '-' ELSE '$' || cast(cast(o_totalprice AS DECIMAL(15,2)) AS VARCHAR) END AS price,
  cast(o_custkey AS VARCHAR) || '%' AS discount, strftime(o_orderdate, '%m/%d/%Y') AS placed,
  CASE WHEN o_orderpriority LIKE '1%' THEN 'Yes' WHEN o_orderpriority LIKE '2%' THEN 'n' ELSE '?' END AS urgent,
  CASE WHEN o_orderpriority LIKE '3%' THEN NULL ELSE o_orderpriority END AS priority,
  CASE WHEN o_totalprice > 200000 THEN NULL ELSE o_totalprice END AS amount,
  'USD' AS currency, '' AS notes FROM orders"""


def messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    p = F.col("o_orderpriority")
    return o.select(
        F.col("o_orderkey").alias("rid"), F.col("o_orderkey").cast("string").alias("order_id"),
        F.when(F.col("o_orderstatus") == "F", "  fulfilled o'neil ").when(F.col("o_orderstatus") == "O", "OPEN").otherwise("N/A").alias("status"),
        F.when(p == "5-LOW", "-").otherwise(F.concat(F.lit("$"), F.col("o_totalprice").cast("decimal(15,2)").cast("string"))).alias("price"),
        F.concat(F.col("o_custkey").cast("string"), F.lit("%")).alias("discount"), F.date_format("o_orderdate", "MM/dd/yyyy").alias("placed"),
        F.when(p.startswith("1"), "Yes").when(p.startswith("2"), "n").otherwise("?").alias("urgent"), F.when(~p.startswith("3"), p).alias("priority"),
        F.when(F.col("o_totalprice") <= 200000, F.col("o_totalprice")).alias("amount"), F.lit("USD").alias("currency"), F.lit("").alias("notes"),
    )


def _table(name: str, sql: str, columns: list[str] | None = None, keep: list[str] | None = None, **params):
    """A query that applies one operation to the table of faults."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = apply_op(messy(spark, sf_dir), "table", name, columns, params)
        return out.select(*keep) if keep else out

    query(f"WITH m AS ({MESSY_SQL}) {sql}", f"table_{name}")(run)


_TOKENS = ", ".join(f"'{t}'" for t in X.NULL_TOKENS)


def _null(c: str) -> str:
    return f"CASE WHEN lower(trim({c})) IN ({_TOKENS}) THEN NULL ELSE {c} END AS {c}"


_table("standardize_null_tokens", f"SELECT rid, {_null('status')}, {_null('price')}, {_null('urgent')}, {_null('notes')} FROM m", ["status", "price", "urgent", "notes"], ["rid", "status", "price", "urgent", "notes"])
_table("trim_whitespace", "SELECT rid, trim(status) AS status FROM m", ["status"], ["rid", "status"])
_table("normalize_case", "SELECT rid, CASE trim(status) WHEN 'fulfilled o''neil' THEN 'Fulfilled O''Neil' WHEN 'OPEN' THEN 'Open' ELSE 'N/A' END AS status FROM m", ["status"], ["rid", "status"], case="title")
_table("strip_currency", "SELECT rid, try_cast(replace(price, '$', '') AS DOUBLE) AS price FROM m", ["price"], ["rid", "price"])
_table("cast_numeric", "SELECT rid, try_cast(order_id AS DOUBLE) AS order_id FROM m", ["order_id"], ["rid", "order_id"])
_table("parse_percent", "SELECT rid, try_cast(replace(discount, '%', '') AS DOUBLE) / 100 AS discount FROM m", ["discount"], ["rid", "discount"], as_fraction=True)
_table("parse_dates", "SELECT rid, strptime(placed, '%m/%d/%Y') AS placed FROM m", ["placed"], ["rid", "placed"])
_table("parse_boolean", "SELECT rid, CASE urgent WHEN 'Yes' THEN true WHEN 'n' THEN false END AS urgent FROM m", ["urgent"], ["rid", "urgent"])
_table("drop_empty_columns", "SELECT * EXCLUDE (notes) FROM m")
_table("drop_constant_columns", "SELECT * EXCLUDE (notes, currency) FROM m")
_table("drop_columns", "SELECT * EXCLUDE (notes, placed) FROM m", ["notes", "placed"])
_table("drop_rows_missing_in", "SELECT rid, priority FROM m WHERE priority IS NOT NULL", ["priority"], ["rid", "priority"])
_table("impute_median", "SELECT rid, round(coalesce(amount, (SELECT quantile_cont(amount, 0.5) FROM m)), 4) AS amount FROM m", ["amount"], None)
_table("impute_mode", "SELECT rid, coalesce(priority, (SELECT priority FROM m WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS priority FROM m", ["priority"], ["rid", "priority"])
_table("impute_constant", "SELECT rid, coalesce(priority, 'none') AS priority FROM m", ["priority"], ["rid", "priority"], value="none")
_table("add_missing_indicator", "SELECT rid, priority, priority IS NULL AS priority_was_missing FROM m", ["priority"], ["rid", "priority", "priority_was_missing"])
_table("winsorize", "SELECT rid, round(greatest(least(amount, (SELECT quantile_cont(amount, 0.95) FROM m)), (SELECT quantile_cont(amount, 0.05) FROM m)), 2) AS amount FROM m WHERE true", ["amount"], None, lower=0.05, upper=0.95)
_table("flag_outliers", """, q AS (SELECT quantile_cont(amount, 0.25) AS a, quantile_cont(amount, 0.75) AS b FROM m)
SELECT rid, coalesce(amount < a - 1.5 * (b - a) OR amount > b + 1.5 * (b - a), false) AS amount_outlier FROM m, q""", ["amount"], ["rid", "amount_outlier"])


def _rounded(name: str, digits: int) -> None:
    f = QUERIES[name]
    QUERIES[name] = lambda spark, d: f(spark, d).select("rid", F.round("amount", digits).alias("amount"))


_rounded("table_impute_median", 4)
_rounded("table_winsorize", 2)
ORACLES["table_winsorize"] = ORACLES["table_winsorize"].replace("round(greatest", "round(CASE WHEN amount IS NOT NULL THEN greatest").replace(", 2) AS amount", " END, 2) AS amount")


@query("SELECT DISTINCT o_orderstatus, o_orderpriority, o_custkey FROM orders")
def table_drop_exact_duplicates(spark, d):
    return apply_op(read_table(spark, d, "orders").select("o_orderstatus", "o_orderpriority", "o_custkey"), "table", "drop_exact_duplicates")


@query('SELECT c_custkey AS customer_key, c_name AS customer_name, c_mktsegment AS market_segment FROM customer')
def table_standardize_column_names(spark, d):
    c = read_table(spark, d, "customer").select(F.col("c_custkey").alias("Customer Key"), F.col("c_name").alias("Customer-Name"), F.col("c_mktsegment").alias(" Market  Segment!"))
    return apply_op(c, "table", "standardize_column_names")


@query("SELECT c_custkey, CASE WHEN regexp_matches(c_name, '^[=+\\-@\\t\\r]') THEN '''' || c_name ELSE c_name END AS c_name, '''=' || c_mktsegment AS formula FROM customer")
def sink_formula_safe(spark, d):
    return neutralized(read_table(spark, d, "customer").select("c_custkey", "c_name", F.concat(F.lit("="), "c_mktsegment").alias("formula")))


# ---------------------------------------------------------------- profiles of tables

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _numeric_sql(table: str, columns: list[str]) -> str:
    one = """SELECT '{c}' AS "column", count(*) AS rows, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS "unique", round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
round(min({c}), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS p25, round(quantile_cont({c}, 0.5), 4) AS median, round(quantile_cont({c}, 0.75), 4) AS p75, round(max({c}), 4) AS max, round(skewness({c}), 4) AS skew,
count(*) FILTER ({c} < q[1] - 1.5 * (q[2] - q[1]) OR {c} > q[2] + 1.5 * (q[2] - q[1])) AS outliers_iqr,
round(100.0 * count(*) FILTER ({c} < q[1] - 1.5 * (q[2] - q[1]) OR {c} > q[2] + 1.5 * (q[2] - q[1])) / count({c}), 4) AS outliers_pct,
count(*) FILTER ({c} < 0) AS negatives, count(*) FILTER ({c} = 0) AS zeros FROM {t}, (SELECT quantile_cont({c}, [0.25, 0.75]) AS q FROM {t})"""
    return " UNION ALL ".join(one.format(c=c, t=table) for c in columns)


@query(_numeric_sql("lineitem", LINE))
def numeric_profile_lineitem(spark, d):
    return profile.numeric_profile(read_table(spark, d, "lineitem").select(*LINE), LINE)


def _columns_sql(columns: list[str]) -> str:
    one = """SELECT '{c}' AS "column", count(*) AS rows, count(*) FILTER ({c} IS NULL OR lower(trim({c})) IN ({t})) AS missing,
count(*) FILTER (lower(trim({c})) IN ({t}) AND trim({c}) <> '') AS hidden_missing, count(DISTINCT CASE WHEN lower(trim({c})) NOT IN ({t}) THEN trim({c}) END) AS "unique",
round(avg(CASE WHEN lower(trim({c})) NOT IN ({t}) THEN length(trim({c})) END), 4) AS avg_length, max(CASE WHEN lower(trim({c})) NOT IN ({t}) THEN length(trim({c})) END) AS max_length FROM m"""
    parts = " UNION ALL ".join(one.format(c=c, t=_TOKENS) for c in columns)
    return f"""WITH m AS ({MESSY_SQL}) SELECT "column", rows, missing, round(100.0 * missing / rows, 4) AS missing_pct, hidden_missing, "unique", round(100.0 * "unique" / rows, 4) AS unique_pct, coalesce(avg_length, 0.0) AS avg_length, coalesce(max_length, 0) AS max_length FROM ({parts})"""


@query(_columns_sql(["order_id", "status", "price", "urgent", "priority", "notes"]))
def column_profile_orders(spark, d):
    m = messy(spark, d).select("order_id", "status", "price", "urgent", "priority", "notes")
    return profile.column_profile(m).fillna(0, ["avg_length", "max_length"])


@query("""SELECT * FROM (VALUES ('order_id', 'id'), ('status', 'category'), ('price', 'currency'), ('discount', 'percent'), ('placed', 'datetime'), ('urgent', 'boolean'), ('priority', 'category'), ('currency', 'constant'), ('notes', 'empty')) AS t("column", kind)""")
def kinds_orders(spark, d):
    kinds = profile.detect_kinds(messy(spark, d).drop("amount"))
    return spark.createDataFrame([(c, k.kind) for c, k in kinds.items()], "column string, kind string")


def _pairs_sql(columns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 4) AS r, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM lineitem" for i, a in enumerate(columns) for b in columns[i + 1 :])


@query(_pairs_sql(LINE))
def correlations_lineitem(spark, d):
    return profile.correlations(read_table(spark, d, "lineitem"), LINE)


@query("""WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS rx, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS ry
FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL) SELECT round(corr(rx, ry), 4) AS rho, count(*) AS n FROM r""")
def spearman_lineitem(spark, d):
    return profile.spearman(read_table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")


_RANKED = {"q": "l_quantity", "e": "CASE WHEN l_linenumber <> 3 THEN l_extendedprice END", "d": "CASE WHEN l_linenumber <> 5 THEN l_discount END", "t": "l_tax"}
_RANK = "SELECT '{a}' AS a, '{b}' AS b, round(corr(x, y), 4) AS rho, count(*) AS n FROM (SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS x, rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS y FROM r WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"


@query(f"WITH r AS (SELECT {', '.join(f'{x} AS {n}' for n, x in _RANKED.items())} FROM lineitem) " + " UNION ALL ".join(_RANK.format(a=a, b=b) for a, b in ("qe", "qd", "qt", "ed", "et", "dt")))
def rank_correlations_lineitem(spark, d):
    return profile.rank_correlations(read_table(spark, d, "lineitem").selectExpr(*[f"{x} AS {n}" for n, x in _RANKED.items()]), list(_RANKED))


_AREA = """SELECT '{c}' AS "column", 'auc' AS how, greatest(a, 1 - a) AS value FROM (SELECT round((sum(k) FILTER (p) - count(*) FILTER (p) * (count(*) FILTER (p) + 1) / 2.0) / (count(*) FILTER (p) * count(*) FILTER (NOT p)), 4) AS a
FROM (SELECT p, rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS k FROM x)) WHERE greatest(a, 1 - a) >= 0.97"""


@query(f"""WITH x AS (SELECT l_linestatus = 'O' AS p, l_linestatus AS s, l_shipdate - DATE '1992-01-01' AS day, l_quantity AS quantity, l_tax AS tax, l_returnflag AS flag, lower(l_linestatus) AS state FROM (SELECT * REPLACE (cast(l_shipdate AS DATE) AS l_shipdate) FROM lineitem)),
u AS (SELECT 'flag' AS "column", flag AS v, s, count(*) AS n FROM x GROUP BY ALL UNION ALL SELECT 'state', state, s, count(*) FROM x GROUP BY ALL),
v AS (SELECT "column", v, max(n)::DOUBLE / sum(n) AS share FROM u GROUP BY ALL), m AS (SELECT "column", round(min(share), 4) AS value FROM v GROUP BY 1)
{' UNION ALL '.join(_AREA.format(c=c) for c in ('day', 'quantity', 'tax'))} UNION ALL SELECT "column", 'purity', value FROM m WHERE value >= 0.999""")
def leaks_lineitem(spark, d):
    x = read_table(spark, d, "lineitem").selectExpr("l_linestatus AS s", "datediff(cast(l_shipdate AS date), DATE'1992-01-01') AS day", "l_quantity AS quantity", "l_tax AS tax", "l_returnflag AS flag", "lower(l_linestatus) AS state")
    found = profile.leaks(x, "s", ["day", "quantity", "tax"], ["flag", "state"])
    return spark.createDataFrame(found, "column string, how string, value double")


_SKETCHED = """SELECT '{c}' AS "column", count(*) AS rows, count(*) - count({c}) AS missing, min({c})::DOUBLE + 0.0 AS least, max({c})::DOUBLE + 0.0 AS greatest, true AS distinct_within, true AS median_within FROM lineitem"""


@query(" UNION ALL ".join(_SKETCHED.format(c=c) for c in LINE))
def sketches_lineitem(spark, d):
    """Sketches of each day, merged and held against exact figures: exact ones, and whether the others are within bounds."""
    t = read_table(spark, d, "lineitem")
    merged = sketches.told(sketches.merge(sketches.sketch(t, LINE, ["l_shipdate"])), [0.5])
    exact = profile.placed_values(t, LINE).join(merged.select("column", F.col("quantiles")[0].alias("q")), "column").groupBy("column").agg(
        F.count("*").alias("values"), F.sum("n").alias("all"), F.sum(F.when(F.col("value") < F.col("q"), F.col("n")).otherwise(0)).alias("below"), F.sum(F.when(F.col("value") <= F.col("q"), F.col("n")).otherwise(0)).alias("upto")
    )
    slack = sketches.RANK_ERROR * F.col("all")
    return merged.join(exact, "column").select(
        "column", "rows", "missing", "least", "greatest", (F.abs(F.col("distinct") - F.col("values")) <= sketches.DISTINCT_ERROR * F.col("values")).alias("distinct_within"),
        ((F.col("below") - slack <= F.col("all") / 2) & (F.col("all") / 2 <= F.col("upto") + slack)).alias("median_within"),
    )


@query()
def topics_documents(spark, d):
    found = textprof.topics(read_table(spark, d, "documents"), key="doc_id")
    return spark.createDataFrame([(t["topic"], t["words"], t["share"]) for t in found], "topic int, words array<string>, share double")


@query("""WITH v AS (SELECT n_chars::DOUBLE AS v, quality = 1 AS p FROM labels JOIN documents USING (doc_id) WHERE n_chars IS NOT NULL AND quality IS NOT NULL),
r AS (SELECT p, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS rk FROM v)
SELECT round((sum(rk) FILTER (p) - count(*) FILTER (p) * (count(*) FILTER (p) + 1) / 2.0) / (count(*) FILTER (p) * count(*) FILTER (NOT p)), 4) AS auc, count(*) AS n FROM r""")
def leakage_auc_labels(spark, d):
    j = read_table(spark, d, "labels").join(read_table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return profile.auc(j, "n_chars", F.col("quality") == 1)


@query("""SELECT count(*) AS "values", round(min(top / total), 4) AS min_purity, cast(sum(total) AS BIGINT) AS n FROM (SELECT l_linestatus, max(n)::DOUBLE AS top, sum(n) AS total
FROM (SELECT l_linestatus, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY 1)""")
def leakage_purity_lineitem(spark, d):
    return profile.purity(read_table(spark, d, "lineitem"), "l_linestatus", "l_returnflag")


@query("SELECT cast(quality AS VARCHAR) AS value, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM labels WHERE quality IS NOT NULL GROUP BY 1")
def class_balance_labels(spark, d):
    return profile.class_balance(read_table(spark, d, "labels"), "quality")


@query("""WITH q AS (SELECT quantile_cont(o_totalprice, 0.05) AS a, quantile_cont(o_totalprice, 0.95) AS b FROM orders),
v AS (SELECT o_totalprice AS v, 1 AS x, 0 AS y FROM orders UNION ALL SELECT greatest(least(o_totalprice, b), a), 0, 1 FROM orders, q),
g AS (SELECT v, sum(x) AS x, sum(y) AS y FROM v GROUP BY v), c AS (SELECT sum(x) OVER w AS cx, sum(y) OVER w AS cy, sum(x) OVER () AS nx, sum(y) OVER () AS ny FROM g WINDOW w AS (ORDER BY v))
SELECT round(max(abs(cx / nx - cy / ny)), 4) AS ks, cast(max(nx) AS BIGINT) AS n_a, cast(max(ny) AS BIGINT) AS n_b FROM c""")
def ks_shift_orders(spark, d):
    o = read_table(spark, d, "orders").select("o_totalprice")
    return profile.ks_statistic(o, apply_op(o, "table", "winsorize", ["o_totalprice"], {"lower": 0.05, "upper": 0.95}), "o_totalprice")


@query("""SELECT count(*) AS rows, 3::BIGINT AS columns, count(*) - count(DISTINCT (o_orderstatus, o_orderpriority, o_custkey)) AS duplicate_rows,
round(100.0 * (count(*) - count(DISTINCT (o_orderstatus, o_orderpriority, o_custkey))) / count(*), 4) AS duplicate_pct FROM orders""")
def overview_orders(spark, d):
    return profile.table_overview(read_table(spark, d, "orders").select("o_orderstatus", "o_orderpriority", "o_custkey"))


@query("SELECT trim(p_type) AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 8")
def top_values_part(spark, d):
    return profile.top_values(read_table(spark, d, "part"), "p_type")


@query("""WITH s AS (SELECT count(l_extendedprice) AS n, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem),
b AS (SELECT lo, hi, cast(least(40, greatest(6, ceil((hi - lo) / (2 * (q3 - q1) / pow(n, 1 / 3.0))))) AS INTEGER) AS k FROM s)
SELECT bin, n, round(lo + bin * ((hi - lo) / k), 4) AS lo, round(lo + (bin + 1) * ((hi - lo) / k), 4) AS hi FROM (SELECT cast(least(floor((l_extendedprice - lo) / ((hi - lo) / k)), k - 1) AS INTEGER) AS bin, count(*) AS n FROM lineitem, b GROUP BY 1), b""")
def histogram_lineitem(spark, d):
    bins = profile.histogram(read_table(spark, d, "lineitem"), "l_extendedprice")
    return bins.select("bin", "n", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"))


# ---------------------------------------------------------------- documents


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select(F.col("doc_id").alias("rid"), F.col("doc_id").cast("string").alias("path"), F.col("source").alias("class"), "text")


W = r"\p{L}+(?:[''’]\p{L}+)?"
KEY = r"trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}_]+', ' ', 'g'))"
WORDS = f"regexp_extract_all(coalesce(text, ''), '{W}')"


def _text(name: str, sql: str | None, column=None, **params):
    def run(spark, d):
        out = apply_op(corpus(spark, d), "text", name, None, params)
        return out.select("rid", "text") if column is None else out.select("rid", column)

    query(sql, f"text_{name}")(run)


@query(f"SELECT min(doc_id) AS rid FROM documents GROUP BY {KEY}")
def text_drop_exact_duplicates(spark, d):
    return apply_op(corpus(spark, d), "text", "drop_exact_duplicates").select("rid")


@query(f"SELECT doc_id AS rid FROM documents WHERE len({WORDS}) >= 50")
def text_drop_short_documents(spark, d):
    return apply_op(corpus(spark, d), "text", "drop_short_documents", None, {"min_words": 50}).select("rid")


_text("normalize_whitespace", r"SELECT doc_id AS rid, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[ \t\x{A0}]+', ' ', 'g'), '\s*\n\s*(\n\s*)+', E'\n\n', 'g'), '^[\s\x{A0}\x{2028}\x{3000}]+|[\s\x{A0}\x{2028}\x{3000}]+$', '', 'g') AS text FROM documents")
_text("truncate_long_documents", f"SELECT doc_id AS rid, CASE WHEN len({WORDS}) > 60 THEN regexp_extract(text, '(?s)^((?:.*?{W}){{60}})', 1) ELSE text END AS text FROM documents", max_words=60)


@query("SELECT doc_id AS rid FROM documents WHERE doc_id NOT IN (0, 1)")
def text_drop_documents(spark, d):
    return apply_op(corpus(spark, d), "text", "drop_documents", None, {"documents": ["0", "1"]}).select("rid")


@query("SELECT doc_id AS rid, doc_id IN (0, 1) AS suspected_mislabel FROM documents")
def text_flag_suspected_mislabels(spark, d):
    return apply_op(corpus(spark, d), "text", "flag_suspected_mislabels", None, {"documents": ["0", "1"]}).select("rid", "suspected_mislabel")


def _language_sql() -> str:
    hits = ", ".join(f"len(list_filter(w, lambda x: x IN ({', '.join(repr(s) for s in stop.split())}))) AS {code}" for code, stop in X.STOPWORDS.items())
    best = ", ".join(X.STOPWORDS)
    order = " ".join(f"WHEN {c} = best THEN '{c}'" for c in X.STOPWORDS)
    scripts = " ".join(f"WHEN len(regexp_extract_all(text, '[\\x{{{ord(s[0]):X}}}-\\x{{{ord(s[2]):X}}}]')) > 0.3 * letters THEN '{c}'" for c, s in X.SCRIPTS)
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, list_transform({WORDS}, lambda x: lower(x)) AS w, len(regexp_extract_all(coalesce(text, ''), '\\p{{L}}')) AS letters FROM documents),
h AS (SELECT *, {hits} FROM t), b AS (SELECT *, greatest({best}) AS best FROM h)
SELECT doc_id, CASE WHEN letters < 12 THEN 'unknown' {scripts} WHEN len(w) < 3 THEN 'unknown' WHEN best < 2 AND best < 0.15 * len(w) THEN 'unknown' {order} END AS language FROM b"""


@query(_language_sql())
def language_documents(spark, d):
    return read_table(spark, d, "documents").select("doc_id", texts.language(F.col("text")).alias("language"))


@query(f"SELECT language, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM ({_language_sql()}) GROUP BY 1")
def language_mix_documents(spark, d):
    return textprof.language_mix(read_table(spark, d, "documents"))


@query(f"SELECT doc_id AS rid FROM ({_language_sql()}) WHERE language IN ('en', 'de')")
def text_filter_language(spark, d):
    return apply_op(corpus(spark, d), "text", "filter_language", None, {"languages": ["English", "de"], "keep_unknown": False}).select("rid")


@query(rf"""SELECT doc_id, cast(len({WORDS}) AS BIGINT) AS words, cast(CASE WHEN trim(coalesce(text, '')) = '' THEN 0 ELSE greatest(len(regexp_extract_all(text, '[.!?]+(?:\s|$)')), 1) END AS BIGINT) AS sentences,
cast(length(coalesce(text, '')) AS BIGINT) AS chars FROM documents""")
def metrics_documents(spark, d):
    return textprof.doc_metrics(read_table(spark, d, "documents")).select("doc_id", "words", "sentences", "chars")


@query(rf"""WITH l AS (SELECT DISTINCT doc_id, regexp_replace(unnest(regexp_split_to_array(coalesce(text, ''), '\r\n|\n|\r|\x0b|\x0c|\x{{85}}|\x{{2028}}|\x{{2029}}')), '^\s+|\s+$', '', 'g') AS line FROM documents)
SELECT line, count(*) AS docs FROM l WHERE length(line) >= 8 GROUP BY 1""")
def boilerplate_lines_documents(spark, d):
    return near_lines(read_table(spark, d, "documents"))


def near_lines(df: DataFrame) -> DataFrame:
    from siltwork.operators.text_ops import line_counts

    return line_counts(df)


@query(f"SELECT term, count(*) AS docs FROM (SELECT DISTINCT doc_id, lower(unnest({WORDS})) AS term FROM documents) WHERE length(term) >= 0 GROUP BY 1 ORDER BY docs DESC, term LIMIT 15")
def top_terms_documents(spark, d):
    return textprof.document_terms(read_table(spark, d, "documents"))


@query(f"""WITH w AS (SELECT doc_id, list_transform({WORDS}, lambda x: lower(x)) AS w FROM documents)
SELECT term, count(*) AS docs FROM (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM w) GROUP BY 1 ORDER BY docs DESC, term LIMIT 10""")
def top_bigrams_documents(spark, d):
    return textprof.document_terms(read_table(spark, d, "documents"), 10, bigrams=True)


@query(f"""WITH s AS (SELECT DISTINCT doc_id, lang, lower(unnest({WORDS})) AS term FROM documents), c AS (SELECT lang, term, count(*) AS c FROM s GROUP BY ALL), t AS (SELECT term, sum(c) AS df FROM c GROUP BY 1),
m AS (SELECT lang, count(*) AS members FROM documents GROUP BY 1), n AS (SELECT count(*) AS n FROM documents),
x AS (SELECT lang AS label, term, (c::DOUBLE / members) / ((df + 1)::DOUBLE / n) AS score FROM c JOIN t USING (term) JOIN m USING (lang), n WHERE c >= 2 AND c >= 0.1 * members),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, term) AS rank FROM x) SELECT label, term, round(score, 4) AS score, cast(rank AS INTEGER) AS rank FROM r WHERE rank <= 6""")
def distinctive_words_documents(spark, d):
    return textprof.distinctive_words(read_table(spark, d, "documents"), "lang")


TFIDF_SQL = f"""w AS (SELECT doc_id, lower(unnest({WORDS})) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL), n AS (SELECT count(*) AS n FROM documents),
f AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), v AS (SELECT term, df FROM f, n WHERE df >= 2 AND df <= 0.5 * n ORDER BY df DESC, term LIMIT 2000),
x AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + n)::DOUBLE / (1 + df)) + 1) AS w FROM tf JOIN v USING (term), n)"""


@query(f"WITH {TFIDF_SQL} SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 4) AS weight FROM x")
def tfidf_documents(spark, d):
    return textprof.tfidf(read_table(spark, d, "documents"), "doc_id").withColumn("weight", F.round("weight", 4))


@query(r"""SELECT count(*) FILTER (regexp_matches(text, 'https?://\S+|www\.\S+')) AS urls, count(*) FILTER (regexp_matches(text, '(^|\W)@\w{2,}')) AS mentions,
count(*) FILTER (regexp_matches(text, '(^|\W)#[A-Za-z]\w+')) AS hashtags, count(*) FILTER (regexp_matches(text, '(?i)[$€£¥]\s?\d[\d,.]*|\b\d[\d,.]*\s?(?:USD|EUR|GBP|dollars|euros)\b')) AS money FROM conversations""")
def entities_conversations(spark, d):
    return textprof.entities(read_table(spark, d, "conversations")).drop("names")


SHINGLES_SQL = f"""w AS (SELECT doc_id, list_transform({WORDS}, lambda x: lower(x)) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 1, 2)), lambda i: array_to_string(w[i:i + 2], ' '))) AS g FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, '|' ORDER BY g)) AS k FROM s GROUP BY 1), r AS (SELECT k, min(doc_id) AS doc_id FROM n GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL)"""


@query(f"""WITH {SHINGLES_SQL} SELECT a, b, round(c::DOUBLE / (x.n + y.n - c), 4) AS similarity FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
WHERE c::DOUBLE / (x.n + y.n - c) >= 0.8 AND a IN (SELECT doc_id FROM r) AND b IN (SELECT doc_id FROM r)""")
def near_duplicate_pairs_documents(spark, d):
    return near.near_text_pairs(corpus(spark, d), 0.8).withColumn("similarity", F.round("similarity", 4))


@query(f"""WITH {SHINGLES_SQL} SELECT a, b, round(c::DOUBLE / (x.n + y.n - c), 4) AS similarity, true AS estimated FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
WHERE c::DOUBLE / (x.n + y.n - c) >= 0.8 AND a IN (SELECT doc_id FROM r) AND b IN (SELECT doc_id FROM r)""")
def signature_similarity_documents(spark, d):
    # 64 minima estimate a similarity of 0.8 with a deviation of 0.05
    docs = corpus(spark, d)
    sets = cut_lineage(docs.select(F.col("rid").alias("id"), near.shingles(F.col("text")).alias("s")))
    signed = sets.select("id", near.minhash(F.col("s")).alias("sig"))
    pairs = near.near_text_pairs(docs, 0.8)
    pairs = pairs.join(signed.select(F.col("id").alias("a"), F.col("sig").alias("s")), "a").join(signed.select(F.col("id").alias("b"), F.col("sig").alias("t")), "b")
    near_enough = F.abs(near.signature_similarity(F.col("s"), F.col("t")) - F.col("similarity")) <= 0.25
    return pairs.select("a", "b", F.round("similarity", 4).alias("similarity"), near_enough.alias("estimated"))


@query("SELECT conv_id, turn, regexp_replace(unnest(list_filter(regexp_split_to_array(coalesce(text, ''), '\\r\\n|\\n|\\r|\\x0b|\\x0c|\\x{85}|\\x{2028}|\\x{2029}'), lambda x: trim(x) <> '')), '^ +| +$', '', 'g') AS text FROM conversations")
def split_lines_conversations(spark, d):
    return split_documents(read_table(spark, d, "conversations").select("conv_id", "turn", "text"), "lines").drop("part")


@query(r"""SELECT doc_id, cast(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS part, regexp_replace(p, '^[ \t\n\f\r\x0b]+|[ \t\n\f\r\x0b]+$', '', 'g') AS text
FROM (SELECT doc_id, unnest(p) AS p, unnest(range(len(p))) AS k FROM (SELECT doc_id, regexp_split_to_array(text, '\n[ \t\n\f\r\x0b]*\n') AS p FROM (SELECT doc_id, replace(text, '. ', E'.\n \n') AS text FROM documents) WHERE text IS NOT NULL)) WHERE trim(p) <> ''""")
def split_paragraphs_documents(spark, d):
    apart = F.replace(F.col("text"), F.lit(". "), F.lit(".\n \n"))  # a paragraph to each sentence
    return split_documents(read_table(spark, d, "documents").select("doc_id", apart.alias("text")), "paragraphs")


@query(r"""SELECT conv_id, cast(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS part, upper(left(role, 1)) || substr(role, 2) AS speaker,
upper(left(role, 1)) || substr(role, 2) || ': turn ' || turn || ' of ' || conv_id || CASE WHEN length(text) % 3 = 0 THEN E'\n... and ' || length(text) || ' more' ELSE '' END AS text FROM conversations WHERE text IS NOT NULL""")
def split_turns_conversations(spark, d):
    c = read_table(spark, d, "conversations").filter("text IS NOT NULL")
    role = F.concat(F.upper(F.substring("role", 1, 1)), F.expr("substring(role, 2)"))
    more = F.when(F.length("text") % 3 == 0, F.concat(F.lit("\n   ... and "), F.length("text").cast("string"), F.lit(" more "))).otherwise("")
    line = F.concat(role, F.lit(": turn "), F.col("turn").cast("string"), F.lit(" of "), F.col("conv_id").cast("string"), more)
    whole = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    return split_documents(whole, "transcript")


# ---------------------------------------------------------------- logs: events

GAPS = {"min_seconds": 60.0, "factor": 8.0, "most": 3}


@query("""WITH t AS (SELECT ts, event_id, lag(ts) OVER (ORDER BY ts, event_id) AS previous FROM events WHERE ts IS NOT NULL), s AS (SELECT previous, ts, (epoch_us(ts) - epoch_us(previous)) / 1e6 AS seconds FROM t WHERE previous IS NOT NULL),
m AS (SELECT quantile_cont(seconds, 0.5) AS median, count(*) AS n FROM s)
SELECT previous::TIMESTAMP AS start, ts::TIMESTAMP AS "end", seconds FROM s, m WHERE seconds >= 60 AND seconds >= 8 * median AND n >= 9 ORDER BY seconds DESC, start LIMIT 3""")
def event_gaps(spark, d):
    return timeline.gaps(read_table(spark, d, "events"), "ts", "event_id", **GAPS)


@query("""WITH e AS (SELECT cast(floor(epoch_us(ts) / 1e6 / 3600) * 3600 AS BIGINT) AS slot, cast(user_id AS VARCHAR) AS source FROM events WHERE ts IS NOT NULL AND event_type = 'error'),
z AS (SELECT count(*) AS n, greatest((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 / 3600, 1.0) AS b, count(*) FILTER (event_type = 'error') AS k FROM events),
h AS (SELECT slot, count(*) AS c FROM e GROUP BY 1), hot AS (SELECT slot FROM h, z WHERE c >= greatest(3.0, 1.5 * k / b) AND n >= 10),
i AS (SELECT slot, sum(f) OVER (ORDER BY slot) AS island FROM (SELECT slot, CASE WHEN slot - lag(slot) OVER (ORDER BY slot) <= 7200 THEN 0 ELSE 1 END AS f FROM hot)),
s AS (SELECT island, min(slot) AS a, max(slot) + 3600 AS b FROM i GROUP BY 1), x AS (SELECT a, b, source, count(*) AS c FROM s JOIN e ON slot >= a AND slot < b GROUP BY ALL)
SELECT make_timestamp(a * 1000000) AS start, make_timestamp(b * 1000000) AS "end", cast(sum(c) AS BIGINT) AS errors, round(100.0 * max(c) / sum(c), 4) AS top_share FROM x GROUP BY a, b ORDER BY errors DESC, start LIMIT 3""")
def event_error_bursts(spark, d):
    return timeline.bursts(read_table(spark, d, "events"), "ts", F.col("event_type") == "error", "user_id", 3600, 3, 1.5, 7200)


@query("SELECT upper(event_type) AS level, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM events GROUP BY 1")
def event_levels(spark, d):
    return timeline.log_facts(read_table(spark, d, "events"), "event_type")


@query("SELECT user_id AS source, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1 ORDER BY n DESC, source LIMIT 8")
def event_errors_by_source(spark, d):
    return timeline.errors_by_source(read_table(spark, d, "events"), "user_id", F.col("event_type") == "error")


@query("SELECT event_id AS line_no, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level, event_type AS logger, 'user ' || user_id || E'\\nmore' AS message, 1::BIGINT AS extra_lines FROM events")
def parse_log_events(spark, d):
    e = read_table(spark, d, "events")
    first = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO"), F.lit(" ["), "event_type", F.lit("] user "), F.col("user_id").cast("string"))
    lines = e.select("event_id", F.posexplode(F.array(first, F.lit("more"))).alias("k", "value"))
    out = timeline.parse_log(lines.select(F.col("event_id").alias("file"), (2 * F.col("event_id") + F.col("k")).alias("line_no"), "value"), "app", ["file"])
    return out.select((F.col("line_no") / 2).cast("long").alias("line_no"), "timestamp", "level", "logger", "message", "extra_lines")


# ---------------------------------------------------------------- links, media, evidence, plans


@query("SELECT c_custkey AS rid, c_mktsegment || '/' || c_name || '.txt' AS path FROM customer")
def link_rows_to_files(spark, d):
    c = read_table(spark, d, "customer")
    files = c.select(F.concat_ws("", "c_mktsegment", F.lit("/"), "c_name", F.lit(".txt")).alias("path"))
    return links.link(c.select(F.col("c_custkey").alias("rid"), F.upper(F.concat("c_name", F.lit(".TXT"))).alias("file")), "file", files)


@query("SELECT n_nationkey AS rid FROM nation WHERE n_regionkey IN (0, 1)")
def label_disagreements_nation(spark, d):
    n, r = read_table(spark, d, "nation"), read_table(spark, d, "region")
    files = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.concat_ws("/", "r_name", "n_name").alias("path"), F.col("r_name").alias("class"))
    rows = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_nationkey").alias("rid"), F.col("n_name").alias("file"), F.when(F.col("n_regionkey") < 2, "elsewhere").otherwise(F.concat(F.lower("r_name"), F.lit("s"))).alias("label"))
    return links.label_disagreements(rows, "file", "label", files).select("rid")


@query("""WITH v AS (SELECT vec_id, list_sum(list_transform(range(1, 64), lambda k: CASE WHEN embedding[k + 1] > 0 THEN (1::BIGINT << (k - 1)) ELSE 0 END))::BIGINT AS h FROM embeddings), h AS (SELECT * FROM v UNION ALL SELECT vec_id + 1000000000, xor(h, 5) FROM v)
SELECT x.vec_id AS a, y.vec_id AS b FROM h x JOIN h y ON x.vec_id < y.vec_id AND bit_count(xor(x.h, y.h)) <= 3""")
def hamming_pairs_embeddings(spark, d):
    bits = F.aggregate(F.sequence(F.lit(1), F.lit(63)), F.lit(0).cast("long"), lambda s, k: s + F.when(F.element_at("embedding", k + 1) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), k - 1)).otherwise(F.lit(0).cast("long")))
    v = read_table(spark, d, "embeddings").select(F.col("vec_id").alias("rid"), bits.alias("h"))
    twins = v.select((F.col("rid") + 1_000_000_000).alias("rid"), F.col("h").bitwiseXOR(F.lit(5).cast("long")).alias("h"))
    return near.hamming_pairs(v.union(twins), "h", 3)


@query("SELECT 'mean' AS claim_id, round(avg(o_totalprice), 2) AS value FROM orders UNION ALL SELECT 'parts', count(*)::DOUBLE FROM orders")
def evidence_lookup_orders(spark, d):
    o = read_table(spark, d, "orders").agg(F.avg("o_totalprice").alias("mean"), F.count("*").alias("n")).first()
    e = Evidence(spark)
    name = e.add("tbl_columns", "stats", "profile", "orders", {"o_totalprice": {"mean": o["mean"]}, "table": {"row_count": o["n"]}})
    claims = spark.createDataFrame([("mean", [name], f"{name}.o_totalprice.mean"), ("parts", [name], "count.row")], "claim_id string, artifact_ids array<string>, key string")
    return lookup(e.table(), claims).select("claim_id", F.round("value", 2).alias("value"))


@query("SELECT round(avg(o_totalprice)) AS number, 'tbl_001' AS artifact_id, 'o_totalprice.mean' AS key FROM orders")
def evidence_find_value_orders(spark, d):
    mean = read_table(spark, d, "orders").agg(F.avg("o_totalprice").alias("m")).first()["m"]
    e = Evidence(spark)
    e.add("tbl", "stats", "profile", "orders", {"o_totalprice": {"mean": mean}, "other": -1.5})
    return find_value(e.table(), spark.createDataFrame([(float(round(mean)),)], "number double"))


@query(f"""WITH m AS ({MESSY_SQL}) SELECT rid, try_cast(replace(price, '$', '') AS DOUBLE) AS price, CASE urgent WHEN 'Yes' THEN true WHEN 'n' THEN false END AS urgent,
strptime(placed, '%m/%d/%Y') AS placed, coalesce(priority, 'none') AS priority, priority IS NULL AS priority_was_missing FROM m""")
def cleaning_plan_orders(spark, d):
    op = plans.CleaningOp
    plan = plans.CleaningPlan((
        op("standardize_null_tokens", ("status", "price", "urgent", "notes")), op("trim_whitespace", ("status",)), op("strip_currency", ("price",)), op("parse_boolean", ("urgent",)), op("parse_dates", ("placed",)),
        op("drop_empty_columns"), op("add_missing_indicator", ("priority",)), op("impute_constant", ("priority",), {"value": "none"}),
    ))
    run = plans.execute_plan(plan, messy(spark, d))
    if run.errors:
        raise plans.PlanError("; ".join(run.errors))
    return run.df.select("rid", "price", "urgent", "placed", "priority", "priority_was_missing")


@query(f"""WITH m AS ({MESSY_SQL}), a AS (SELECT count(*) FILTER (status <> trim(status)) AS n FROM m) SELECT 'status' AS "column", n AS changed, 0::BIGINT AS retyped FROM a
UNION ALL SELECT 'order_id', 0, count(*) FROM m""")
def changed_values_orders(spark, d):
    m = messy(spark, d)
    after = apply_op(apply_op(m, "table", "trim_whitespace", ["status"]), "table", "cast_numeric", ["order_id"])
    return plans.changed_values(m, after, ["status", "order_id"]).select("column", "changed", "retyped")


def deducted_sql(parts: dict[str, tuple[str, int, float]]) -> str:
    """What each part takes: its amount in the one row of t, at a rate, and up to its most."""
    return " UNION ALL ".join(f"SELECT '{p}' AS part, round({amount}, 4) AS amount, 0.0 - round(least({most}, {f'greatest(0, {amount} - 1.5)' if amount == 'ratio' else amount} * {rate}), 1) AS deduction FROM t" for p, (amount, most, rate) in parts.items())


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return numeric_profile_lineitem(spark, d)


from siltwork.plans import corpus_queries, media_queries  # noqa: E402, F401  they register more
