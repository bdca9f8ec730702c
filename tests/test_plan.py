import pytest

from siltwork.operators.registry import CATALOG, PlanError, apply_op
from siltwork.plans.plan import CleaningOp, CleaningPlan, conservative_plan, distribution_shifts, execute_plan
from siltwork.session import cut_lineage as plans_cut
from siltwork.sources.sinks import plan_script


def table(spark, n=40):
    return spark.createDataFrame([(k, f"${k}.50" if k % 4 else "N/A", " a " if k % 2 else "b", None if k % 10 else "x") for k in range(n)], "rid long, price string, kind string, rare string")


def test_catalogue_is_whole():
    assert {m: len(ops) for m, ops in CATALOG.items()} == {"table": 22, "text": 15, "image": 15, "audio": 14, "video": 15}


def test_plan_runs_and_describes(spark):
    plan = CleaningPlan((CleaningOp("standardize_null_tokens"), CleaningOp("strip_currency", ("price",)), CleaningOp("trim_whitespace", ("kind",))))
    run = execute_plan(plan, table(spark))
    assert run.ok and run.df.schema["price"].dataType.typeName() == "double"
    assert "changed the type of price" in run.steps[1].description
    assert CleaningPlan.from_json(plan.to_json()) == plan
    assert "execute_plan" in plan_script(plan)


def test_guards(spark):
    ops = (
        CleaningOp("cast_numeric", ("kind",)), CleaningOp("impute_constant", ("rare",), {"value": "y"}), CleaningOp("drop_columns", ("kind",)),
        CleaningOp("nothing"), CleaningOp("winsorize", ("price",), {"lower": 0.5}), CleaningOp("drop_rows_missing_in", ("rare",), {}, "", ("tbl_001",)),
    )
    run = execute_plan(CleaningPlan(ops), table(spark), {"tbl_001"})
    text = "\n".join(run.errors)
    for part in ("would be lost", "too many to fill in", "need evidence", "unknown operation", "is not between", "the plan removes 36 of 40"):
        assert part in text
    assert [s.op for s in run.steps] == ["drop_rows_missing_in"]


def test_a_plan_reads_the_data_once_for_a_written_table(spark, monkeypatch):
    from siltwork.plans import plan as plans

    written = []
    monkeypatch.setattr(plans, "cut_lineage", lambda df: written.append(1) or plans_cut(df))
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            reads.add(len(b))
            yield b

    base = table(spark)
    df = base.mapInPandas(counted, base.schema)
    ops = [CleaningOp("standardize_null_tokens"), CleaningOp("strip_currency", ("price",), {"decimal_comma": False}), CleaningOp("trim_whitespace", ("kind",)), CleaningOp("add_missing_indicator", ("price",))]
    run = execute_plan(CleaningPlan(tuple(ops)), df)
    assert run.ok and len(run.steps) == 4 and len(written) == 1 and reads.value == 40
    refused = CleaningOp("cast_numeric", ("kind",), {"decimal_comma": False})
    again = execute_plan(CleaningPlan((ops[0], refused, *ops[1:])), df)
    assert [s.op for s in again.steps] == [o.op for o in ops] and len(again.errors) == 1 and len(written) == 3


def test_rows_that_went_before_may_be_named(spark):
    docs = spark.createDataFrame([(1, "a", "one two"), (2, "b", "ONE two"), (3, "c", "three")], "rid long, path string, text string")
    drop = CleaningOp("drop_documents", (), {"documents": ["b"]}, "", ("e",))
    run = execute_plan(CleaningPlan((CleaningOp("drop_exact_duplicates", evidence=("e",)), drop), media="text"), docs)
    assert [s.op for s in run.steps] == ["drop_exact_duplicates", "drop_documents"] and sorted(r.rid for r in run.df.collect()) == [1, 3]
    run = execute_plan(CleaningPlan((CleaningOp("drop_documents", (), {"documents": ["z"]}, "", ("e",)),), media="text"), docs)
    assert "no such path: z" in run.errors[0]


def test_parameters_are_checked(spark):
    for params in ({"case": "wide"}, {"case": 3}, {"other": 1}):
        with pytest.raises(PlanError):
            apply_op(table(spark), "table", "normalize_case", ["kind"], params)
    with pytest.raises(PlanError):
        apply_op(table(spark), "table", "trim_whitespace", ["no"])


def test_shift_and_lint(spark):
    a = spark.createDataFrame([(float(k),) for k in range(100)], "v double")
    b = spark.createDataFrame([(float(k) + 50,) for k in range(100)], "v double")
    assert distribution_shifts(a, b, ["v"]) == [("v", 0.5)]
    assert distribution_shifts(a, a, ["v"]) == []
    assert CleaningPlan((CleaningOp("impute_median", ("v",)),)).lint()
    assert execute_plan(conservative_plan(table(spark)), table(spark)).ok
