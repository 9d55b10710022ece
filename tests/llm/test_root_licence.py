"""A licence file in the top directory counts for all below it."""

from shelfscan.llm import licenses


def test_root_licence_is_inherited(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [(1, "LICENSE", mit, True), (2, "a/b/f.py", "code", False), (3, "top.py", "code", False), (4, "c/LICENSE", apache, True), (5, "c/d/g.py", "code", False), (6, "/e/f.py", "code", False)]
    files = spark.createDataFrame(rows, "id long, path string, text string, is_licence_file boolean")
    got = {r["id"]: (r["licence"], r["origin"], r["from_path"]) for r in licenses.scan(files).collect()}
    assert got[2] == got[3] == ("MIT", "inherited", "LICENSE")
    assert got[5] == ("Apache-2.0", "inherited", "c/LICENSE")
