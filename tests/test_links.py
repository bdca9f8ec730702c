from siltwork.operators import links


def test_links_by_path_name_end_and_stem(spark):
    files = spark.createDataFrame([("a/b/x.png",), ("a/c/x.png",), ("d/y.png",), ("z.png",), ("q/z.png",), ("e/only.png",)], "path string")
    rows = [(1, "a/b/x.png"), (2, "b/x.png"), (3, "x.png"), (4, "Y.PNG"), (5, "z.png"), (6, "only"), (7, "c\\x.png"), (8, "nothing.png"), (9, ""), (10, None), (11, "other/y.png")]
    got = {r.rid: r.path for r in links.link(spark.createDataFrame(rows, "rid long, file string"), "file", files).collect()}
    assert got == {1: "a/b/x.png", 2: "a/b/x.png", 4: "d/y.png", 5: "z.png", 6: "e/only.png", 7: "a/c/x.png", 11: "d/y.png"}


def test_quotas_keep_the_total(spark):
    counts = spark.createDataFrame([(f"g{k}", 100) for k in range(10)], "g string, n long")
    got = {r.g: r.quota for r in links.quotas(counts, 20).collect()}
    assert sum(got.values()) == 20 and sorted(got.values()) == [0] * 6 + [5] * 4
    mixed = spark.createDataFrame([("a", 3), ("b", 50), ("c", 47)], "g string, n long")
    assert {r.g: r.quota for r in links.quotas(mixed, 40).collect()} == {"a": 3, "b": 19, "c": 18}
    assert {r.g: r.quota for r in links.quotas(mixed, 400).collect()} == {"a": 3, "b": 50, "c": 47}
