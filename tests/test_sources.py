import stat
import zipfile

import pytest

from siltwork.sources import readers, sinks, sniff


def test_sniff_kinds():
    assert sniff.sniff_bytes(b"\x89PNG\r\n\x1a\n123").modality == "image"
    assert sniff.sniff_bytes(b'{"a":1}\n{"a":2}\n').format == "jsonl"
    assert sniff.sniff_bytes(b"a;b;c\n1;2;3\n4;5;6\n") == sniff.Detection("table", "csv", ";")
    assert sniff.sniff_bytes(b"2024-01-01 10:00:00 INFO [x] hello\n2024-01-01 10:00:01 ERROR [x] bad\n").modality == "log"
    assert sniff.sniff_bytes(b"Well, this is prose, with commas, as people write it down.\nAnd so, it goes on, line by line, for a while.\n").modality == "text"


def test_table_with_title_and_short_rows(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text('Report\n\nid,name,name,\n1,"a, b",x,y\n2,c\n\n3,d,e,f\n')
    df, meta = readers.read_table(spark, str(p), ",")
    assert df.columns == ["rid", "id", "name", "name_2", "column_4"] and meta.header_row == 1
    assert [tuple(r)[1:] for r in df.orderBy("rid").collect()] == [("1", "a, b", "x", "y"), ("2", "c", "", ""), ("3", "d", "e", "f")]


def test_jsonl(spark, tmp_path):
    p = tmp_path / "t.jsonl"
    p.write_text('{"a": 1, "b": {"c": 2}}\n{"a": null}\n')
    assert sorted((r.a, r.b) for r in readers.read_jsonl(spark, str(p)).collect()) == [("", ""), ("1", '{"c":"2"}')]


def test_log_with_continuation(spark, tmp_path):
    p = tmp_path / "a.log"
    p.write_text("junk\n2024-01-01 10:00:00 ERROR [pay] boom\n  Traceback\n  line 2\n2024-01-01 10:00:01 INFO web: fine\n")
    df, name = readers.read_log(spark, str(p))
    got = [(r.level, r.logger, r.message, r.extra_lines) for r in df.orderBy("line_no").collect()]
    assert name == "app" and got == [("ERROR", "pay", "boom\nTraceback\nline 2", 2), ("INFO", "web", "fine", 0)]


def test_documents(spark, tmp_path):
    (tmp_path / "d" / "x").mkdir(parents=True)
    (tmp_path / "d" / "x" / "1.txt").write_text("one")
    (tmp_path / "d" / "2.txt").write_text("two")
    got = {(r.path, r["class"], r.text) for r in readers.read_documents(spark, str(tmp_path / "d")).collect()}
    assert got == {("x/1.txt", "x", "one"), ("2.txt", "", "two")}
    one = tmp_path / "talk.txt"
    one.write_text("Ann: hello there\nmore\nBob: hi you\nAnn: bye now\n")
    turns = [(r["class"], r.text) for r in readers.read_documents(spark, str(one)).orderBy("rid").collect()]
    assert turns == [("Ann", "Ann: hello there\nmore"), ("Bob", "Bob: hi you"), ("Ann", "Ann: bye now")]


def test_inventory_and_manifest(spark, tmp_path):
    for k, name in enumerate(("a/1.txt", "a/2.txt", "b/3.txt")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(f"some words here {k}")
    (tmp_path / "b" / "x.png").write_bytes(b"\x89PNG\r\n\x1a\n")
    m = sniff.manifest(sniff.inventory(spark, str(tmp_path)))
    assert m["counts"] == {"text": 3, "image": 1} and m["dominant"] == "text" and m["is_mixed"] and m["folders_as_labels"]


@pytest.mark.parametrize("name", ["../x", "/abs", "C:/x"])
def test_unzip_refuses(tmp_path, name):
    z = tmp_path / "z.zip"
    with zipfile.ZipFile(z, "w") as f:
        f.writestr(name, "x")
    with pytest.raises(sniff.UnsafeArchive):
        sniff.safe_unzip(str(z), str(tmp_path / "out"))


def test_unzip_links_and_good(tmp_path):
    z = tmp_path / "z.zip"
    with zipfile.ZipFile(z, "w") as f:
        i = zipfile.ZipInfo("link")
        i.external_attr = (stat.S_IFLNK | 0o777) << 16
        f.writestr(i, "/etc/passwd")
    with pytest.raises(sniff.UnsafeArchive):
        sniff.safe_unzip(str(z), str(tmp_path / "out"))
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a/b.txt", "x")
        f.writestr("__MACOSX/b.txt", "x")
    assert [p.split("/out/")[1] for p in sniff.safe_unzip(str(z), str(tmp_path / "out"))] == ["a/b.txt"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "p", "c", "=x", False)], "rid long, path string, class string, text string, suspected_mislabel boolean")
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).first()["text"] == "'=x"
    sinks.write_corpus(df, str(tmp_path / "corpus"))
    assert spark.read.json(str(tmp_path / "corpus" / "documents")).first()["label"] == "c"


def test_documents_in_any_encoding(spark, tmp_path):
    files = {"all/b/2.txt": "Straße – café".encode("cp1252"), "all/a/1.txt": "﻿Über".encode(), "all/a/3.txt": b"caf\xe9 \x81", "all/a/10.txt": "plain, Größe".encode(), "all/README.txt": b"no document", "all/b/readme_too.txt": b"nor this"}
    for name, raw in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    rows = readers.read_documents(spark, str(tmp_path)).orderBy("rid").collect()
    assert [r.path for r in rows] == sorted(n for n in files if "readme" not in n.lower())
    assert {r.path: r.text for r in rows} == {n: sniff.decode(raw) for n, raw in files.items() if "readme" not in n.lower()}
    assert {r["class"] for r in rows if r.path.startswith("all/a/")} == {"a"} and {r["class"] for r in rows if r.path.startswith("all/b/")} == {"b"}


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "cp1252", "latin-1"])
def test_tables_in_any_encoding(spark, tmp_path, encoding):
    cells = {"latin-1": "caf\xe9 \x81", "cp1252": "Straße – “x”"}.get(encoding, "Größe – 東京")
    (tmp_path / "t.csv").write_bytes(f'Näme;b\n{cells};"two\nlines"\nx;y\n'.encode(encoding))
    df, meta = readers.read_table(spark, str(tmp_path / "t.csv"), ";")
    assert meta.encoding == encoding.removesuffix("-sig") and [tuple(r)[1:] for r in df.orderBy("rid").collect()] == [(cells, "two\nlines"), ("x", "y")] and df.columns[1:] == ["Näme", "b"]
    (tmp_path / "one.csv").write_bytes(f"Näme;b\n{cells};1\nx;y\n".encode(encoding))
    assert [tuple(r)[1:] for r in readers.read_table(spark, str(tmp_path / "one.csv"))[0].orderBy("rid").collect()] == [(cells, "1"), ("x", "y")]
