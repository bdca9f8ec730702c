"""Cleaning plans: ordered operations, run lazily one after the other, with guards on what they may lose."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from siltwork.functions import values as V
from siltwork.operators import media_ops, table_ops, text_ops  # noqa: F401  they fill the catalogue
from siltwork.operators.links import align, class_loss
from siltwork.operators.profile import ks_statistic
from siltwork.operators.registry import CATALOG, RID, PlanError, apply_op, with_rid
from siltwork.session import cut_lineage, free

# Limits of what a plan may do.
MOST_ROW_LOSS, MOST_NEW_MISSING, MOST_IMPUTED, MOST_SHIFT, LEAST_FOR_SHIFT, MOST_CLASS_LOSS = 0.30, 0.10, 0.40, 0.20, 20, 0.50


@dataclass(frozen=True)
class CleaningOp:
    op: str
    columns: tuple[str, ...] = ()
    params: dict = field(default_factory=dict)
    rationale: str = ""
    evidence: tuple[str, ...] = ()


@dataclass(frozen=True)
class CleaningPlan:
    ops: tuple[CleaningOp, ...]
    summary: str = ""
    media: str = "table"

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False)

    @staticmethod
    def from_json(text: str) -> CleaningPlan:
        d = json.loads(text)
        ops = tuple(CleaningOp(o["op"], tuple(o.get("columns") or ()), dict(o.get("params") or {}), o.get("rationale", ""), tuple(o.get("evidence") or ())) for o in d["ops"])
        return CleaningPlan(ops, d.get("summary", ""), d.get("media", "table"))

    def lint(self) -> list[str]:
        """Advice that doesn't stop a plan."""
        out, names = [], [o.op for o in self.ops]
        numbers = {"winsorize", "flag_outliers", "impute_median"}
        typed: set[str] = set()
        for k, o in enumerate(self.ops):
            if o.op in ("cast_numeric", "strip_currency", "parse_percent"):
                typed |= set(o.columns)
            if o.op in numbers and not set(o.columns) <= typed:
                out.append(f"step {k + 1}: {o.op} before its columns are numbers")
            if o.op.startswith("impute") and not any(p.op == "add_missing_indicator" and set(o.columns) & set(p.columns) for p in self.ops[:k]):
                out.append(f"step {k + 1}: {o.op} without a missing indicator before it")
        if "standardize_null_tokens" in names[1:]:
            out.append("standardize_null_tokens should come first")
        if "standardize_column_names" in names[:-1]:
            out.append("standardize_column_names should come last")
        return out


@dataclass(frozen=True)
class StepResult:
    op: str
    columns: tuple[str, ...]
    rows_before: int
    rows_after: int
    columns_before: int
    columns_after: int
    new_missing: dict[str, int]
    description: str


@dataclass
class PlanRun:
    df: DataFrame
    steps: list[StepResult]
    errors: list[str]

    @property
    def ok(self) -> bool:
        return not self.errors


class _Run:
    """Steps that change values only, applied one after the other and written in one pass over the data.

    Columns that a guard asks about are carried along, as they were before and after its step, so that the metrics of all
    guards are observed in the pass that writes the table."""

    def __init__(self, base: DataFrame, media: str, known: DataFrame):
        self.base, self.media, self.known = base, media, known
        self.steps: list[tuple[int, CleaningOp]] = []

    def takes(self, spec) -> bool:
        return spec.risk != "destructive" and (spec.needs_columns or self.media != "table")

    def build(self) -> tuple[DataFrame, list[str], dict, list[tuple], dict[int, str]]:
        """The table with what is carried, the names of that, metrics, what was done by step, and steps that can't be."""
        frame, carried, metrics, done, wrong = self.base, [], {}, [], {}
        for k, o in self.steps:
            spec = CATALOG[self.media][o.op]
            touched = [c for c in o.columns if c in frame.columns]
            guarded = touched if spec.converts or o.op.startswith("impute") else []
            columns = list(o.columns) or ([c for c in frame.columns if c != RID and c not in carried] if spec.needs_columns and spec.all_columns_ok else [])
            was = {f"__was_{k}_{n}": F.col(f"`{c}`") for n, c in enumerate(guarded)}
            try:
                new = apply_op(frame.withColumns(was) if was else frame, self.media, o.op, columns, o.params, self.known)
            except PlanError as e:
                wrong[k] = str(e)
                continue
            now = {f"__now_{k}_{n}": F.col(f"`{c}`") for n, c in enumerate(guarded)} if spec.converts else {}
            done.append((k, o, spec, guarded, frame.drop(*carried), new.drop(*carried, *was)))
            for c in was:
                metrics[f"m{c}"] = F.count_if(V.is_missing(F.col(c)))
            for c in now:
                metrics[f"m{c}"] = F.count_if(F.col(c).isNull())
            frame, carried = new.withColumns(now) if now else new, [*carried, *was, *now]
        return frame, carried, metrics, done, wrong


def _refused(k: int, o: CleaningOp, spec, guarded: list[str], before: DataFrame, after: DataFrame, m: dict) -> tuple[str | None, dict[str, int]]:
    """Why a step is refused, if it is, and values that it loses by column."""
    rows, more = m["rows"], {}
    for n, c in enumerate(guarded):
        missing = m[f"m__was_{k}_{n}"]
        if not spec.converts:
            if rows and missing > MOST_IMPUTED * rows:
                return f"{c}: {missing} of {rows} values are missing, too many to fill in", {}
            continue
        lost, all_ = m[f"m__now_{k}_{n}"] - missing, rows - missing
        if lost > 0:
            more[c] = lost
        if lost > 0 and all_ and lost > MOST_NEW_MISSING * all_:
            return f"{c}: {lost} of {all_} values would be lost, such as {', '.join(map(repr, _unparsed(before, after, c)))}", {}
    return None, more


def _observed(df: DataFrame, metrics: dict, drop: list[str]) -> tuple[DataFrame, dict]:
    """df written without some columns, and its metrics, observed while it is written."""
    seen = Observation()
    out = cut_lineage(df.observe(seen, F.count("*").alias("rows"), *[c.alias(n) for n, c in metrics.items()]).drop(*drop))
    return out, seen.get


def execute_plan(plan: CleaningPlan, df: DataFrame, known_evidence: set[str] | None = None) -> PlanRun:
    """Run a plan on df (a row number is added as rid where there is none). Steps that fail a guard are skipped and told.

    Steps that only change values are run together and written once; what their guards ask is observed in that pass, which
    is repeated without a step that a guard refuses. Steps that remove rows, or that look at all columns, start from the
    written table."""
    catalog = CATALOG[plan.media]
    start = now = with_rid(df)
    total = rows = None
    steps: list[tuple[int, StepResult]] = []
    errors: list[tuple[int, str]] = []

    def told(k: int, o: CleaningOp, before: DataFrame, after: DataFrame, n: int, m: int, more: dict) -> None:
        steps.append((k, StepResult(o.op, o.columns, n, m, len(before.columns) - 1, len(after.columns) - 1, more, describe(before, after, n, m))))

    def replace(new: DataFrame) -> None:
        nonlocal now
        if now is not start:
            free(now)
        now = new

    def settle(run: _Run, last: bool = False) -> DataFrame:
        """The table after a run; written where guards ask, or where its rows aren't counted yet."""
        nonlocal total, rows
        while run.steps:
            frame, carried, metrics, done, wrong = run.build()
            errors.extend(wrong.items())
            run.steps = [s for s in run.steps if s[0] not in wrong]
            if not run.steps:
                break
            if not metrics and rows is not None:
                for k, o, _, _, before, after in done:
                    told(k, o, before, after, rows, rows, {})
                return frame
            out, m = _observed(frame, metrics, carried)
            total, rows = m["rows"] if total is None else total, m["rows"]
            verdicts = [(k, *_refused(k, o, spec, guarded, before, after, m)) for k, o, spec, guarded, before, after in done]
            if bad := [(k, why) for k, why, _ in verdicts if why]:
                errors.append(bad[0])  # later steps are judged again without it
                run.steps = [s for s in run.steps if s[0] != bad[0][0]]
                free(out)
                continue
            for (k, o, _, _, before, after), (_, _, more) in zip(done, verdicts):
                told(k, o, before, after, rows, rows, more)
            replace(out)
            return out
        return run.base

    run = _Run(now, plan.media, start)
    for k, o in enumerate(plan.ops):
        spec = catalog.get(o.op)
        try:
            if spec is None:
                raise PlanError("unknown operation")
            if spec.risk == "destructive" and not o.evidence:
                raise PlanError("destructive operations need evidence")
            if known_evidence is not None and (unknown := set(o.evidence) - known_evidence):
                raise PlanError(f"unknown evidence {', '.join(sorted(unknown))}")
            if run.takes(spec):
                run.steps.append((k, o))
                continue
            before = settle(run)
            run = _Run(before, plan.media, start)
            after = apply_op(before, plan.media, o.op, list(o.columns), o.params, start)
            if spec.risk != "destructive" and rows is not None:
                told(k, o, before, after, rows, rows, {})
                run = _Run(after, plan.media, start)
                continue
            if rows is None:
                total = rows = before.count()
            out, m = _observed(after, {}, []) if spec.risk == "destructive" else (after, {"rows": rows})
            told(k, o, before, after, rows, m["rows"], {})
            rows = m["rows"]
            if out is not after:
                replace(out)
            run = _Run(out, plan.media, start)
        except PlanError as e:
            errors.append((k, str(e)))
    now_ = settle(run)
    out = [f"step {k + 1} ({plan.ops[k].op}): {why}" for k, why in sorted(errors, key=lambda e: e[0])]
    if total and total - rows > MOST_ROW_LOSS * total:
        out.append(f"the plan removes {total - rows} of {total} rows")
    if "class" in start.columns and "class" in now_.columns:
        for r in class_loss(start, now_).collect():
            out.append(f"class {r['class']!r} falls from {r['before']} to {r['after']}")
    return PlanRun(now_, [s for _, s in sorted(steps, key=lambda s: s[0])], out)


def _unparsed(before: DataFrame, after: DataFrame, column: str, k: int = 5) -> list[str]:
    a = before.filter(~V.is_missing(F.col(f"`{column}`"))).select(RID, F.col(f"`{column}`").cast("string").alias("v"))
    b = after.filter(F.col(f"`{column}`").isNull()).select(RID)
    return [r["v"] for r in a.join(b, RID, "left_semi").select("v").distinct().orderBy("v").limit(k).collect()]


def describe(before: DataFrame, after: DataFrame, rows_before: int, rows_after: int) -> str:
    parts = []
    if rows_before != rows_after:
        parts.append(f"removed {rows_before - rows_after} rows")
    gone, new = [c for c in before.columns if c not in after.columns], [c for c in after.columns if c not in before.columns]
    if gone and len(gone) == len(new):
        parts.append("renamed " + ", ".join(f"{a} to {b}" for a, b in zip(gone, new)))
    else:
        parts += [f"removed columns {', '.join(gone)}"] * bool(gone) + [f"added columns {', '.join(new)}"] * bool(new)
    typed = [c for c in after.columns if c in before.columns and before.schema[c].dataType != after.schema[c].dataType]
    parts += [f"changed the type of {', '.join(typed)}"] * bool(typed)
    return "; ".join(parts) or "changed values"


def change_notes(before: DataFrame, after: DataFrame, columns: list[str], unit: str = "rows", most: int = 6) -> list[str]:
    """What a step changed, in words, with examples; of values, the columns with most changes."""
    n, m = before.count(), after.count()
    notes = [f"removed {n - m:,} {unit}"] if m < n else [f"added {m - n:,} {unit}"] if m > n else []
    notes += [describe(before, after, m, m)] if before.columns != after.columns or before.dtypes != after.dtypes else []
    shared = [c for c in columns if c in before.columns and c in after.columns]
    for r in changed_values(before, after, shared).filter("changed > 0").orderBy(F.desc("changed"), "column").limit(most).collect() if shared else []:
        gone = "" if not r["emptied"] else ", all now missing" if r["emptied"] == r["changed"] else f", {r['emptied']:,} of them now missing"
        notes.append(f"changed {r['changed']:,} values in '{r['column']}'{gone} (e.g. {'; '.join(r['examples'])})")
    return notes or ["nothing needed changing"]


def changed_values(before: DataFrame, after: DataFrame, columns: list[str], examples: int = 3) -> DataFrame:
    """Per column: values that differ between rows of one rid, values that only changed type, and some examples."""
    both = align(before.select(RID, *columns), after.select(RID, *columns)).filter("before IS NOT NULL AND after IS NOT NULL")
    pieces = []
    for c in columns:
        b, a = F.col("before")[c].cast("string"), F.col("after")[c].cast("string")
        differs = ~b.eqNullSafe(a)
        same_number = F.coalesce(b.try_cast("double") == a.try_cast("double"), F.lit(False))
        pieces.append(F.struct(F.lit(c).alias("column"), (differs & ~same_number).alias("changed"), (differs & a.isNull()).alias("emptied"), (differs & same_number).alias("retyped"), F.concat_ws(" -> ", F.coalesce(b, F.lit("null")), F.coalesce(a, F.lit("null"))).alias("example")))
    long = both.select("k", F.explode(F.array(*pieces)).alias("p")).select("k", "p.*").filter("changed OR retyped")
    kinds = long.groupBy("column", "changed", "emptied", "example").agg(F.count("*").alias("n"), F.min("k").alias("first"))
    some = F.slice(F.array_sort(F.collect_list(F.when(F.col("changed") & (F.col("first") <= F.lit(2**62)), F.struct("first", "example")))), 1, examples)
    # few examples only: those of the first rows
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy("column", "changed").orderBy("first"))
    totals = kinds.groupBy("column").agg(F.sum(F.when(F.col("changed"), F.col("n")).otherwise(0)).alias("changed"), F.sum(F.when(~F.col("changed"), F.col("n")).otherwise(0)).alias("retyped"), F.sum(F.when(F.col("emptied"), F.col("n")).otherwise(0)).alias("emptied"))
    shown = kinds.filter("changed").withColumn("rank", rank).filter(F.col("rank") <= examples).groupBy("column").agg(some.alias("e"))
    return totals.join(shown, "column", "left").select("column", "changed", "retyped", "emptied", F.transform("e", lambda x: x["example"]).alias("examples"))


def distribution_shifts(before: DataFrame, after: DataFrame, columns: list[str]) -> list[tuple[str, float]]:
    """Numeric columns whose distribution moves by more than the limit."""
    out = []
    for c in columns:
        r = ks_statistic(before.select(V.to_number(F.col(f"`{c}`").cast("string")).alias(c)), after, c).first()
        if r["ks"] is not None and min(r["n_a"], r["n_b"]) >= LEAST_FOR_SHIFT and r["ks"] > MOST_SHIFT:
            out.append((c, r["ks"]))
    return out


def conservative_plan(df: DataFrame) -> CleaningPlan:
    """Safe steps that fit any table of strings."""
    cols = tuple(c for c in df.columns if c != RID)
    return CleaningPlan((CleaningOp("standardize_null_tokens", cols), CleaningOp("trim_whitespace", cols), CleaningOp("drop_empty_columns")), "safe steps only")
