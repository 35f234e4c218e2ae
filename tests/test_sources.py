"""Readers of whole files, JSON lines and CSV."""

from __future__ import annotations

import hashlib

from strataloom.sources.tables import csv_rows, json_lines, text_files


def test_whole_files_with_bytes_that_are_no_text(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.md").write_bytes("é\n".encode())
    (tmp_path / "deep" / "b.md").write_bytes(b"\xff ok")
    (tmp_path / "c.bin").write_bytes(b"x")
    got = {r["file_path"].rpartition("/")[2]: r for r in text_files(spark, str(tmp_path), "*.md").collect()}
    assert set(got) == {"a.md", "b.md"} and got["a.md"]["content"] == "é\n" and got["b.md"]["content"] == "� ok"
    assert got["b.md"]["sha256"] == hashlib.sha256(b"\xff ok").hexdigest() and got["a.md"]["size"] == 3


def test_json_lines_that_do_not_fit_go(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1, "b": "x"}\nnot json\n{"a": "no number"}\n{"a": null}\n')
    assert sorted(map(tuple, json_lines(spark, str(tmp_path), "a long, b string").collect()), key=repr) == [(1, "x"), (None, None)]


def test_csv_rows_under_a_schema(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,b\n1,"x, y"\n2,\n')
    assert sorted(map(tuple, csv_rows(spark, str(tmp_path), "a long, b string").collect())) == [(1, "x, y"), (2, None)]
