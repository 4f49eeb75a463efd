"""License scans over the licences' own texts, ids of any kind and directories that hold very many files."""

from __future__ import annotations

import os

import pytest

from pricegrain.llm import common, licenses

#: Folder of Debian and the like that holds licences as published.
PUBLISHED = "/usr/share/common-licenses"
FILES = {"Apache-2.0": "Apache-2.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GPL-1": "GPL", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL", "MPL-2.0": "MPL-2.0", "Artistic": None, "GFDL-1.3": None}
LINES = {
    "MIT License": "MIT", "Apache License": "Apache", "BSD 3-Clause License": "BSD-3-Clause", "ISC License": "ISC", "Mozilla Public License Version 2.0": "MPL-2.0", "// SPDX-License-Identifier: MIT": "MIT",
    "# SPDX-License-Identifier: GPL-3.0-or-later": "GPL-3.0", "Permission is hereby granted, free of charge, to any person obtaining a copy": "MIT", "Redistribution and use in source and binary forms, with or without": "BSD-2-Clause",
    "it under the terms of the GNU General Public License as published by": "GPL", "Licensed under the GNU General Public License": "GPL", "Licensed under the GNU General Public License, version 2": "GPL-2.0",
    "Licensed under the Apache License, Version 2.0": "Apache-2.0", "License": None, "MIT": None, "All rights reserved.": None, "See the LICENSE file for details": None, "the software is free": None, "This is the house of the dog": None,
}


def scan(spark, rows, ids="long"):
    return licenses.license_scan(spark.createDataFrame(rows, f"doc_id {ids}, path string, text string"))


def test_lines(spark):
    rows = [(i, f"d{i}/x.py", line) for i, line in enumerate(LINES)]
    got = {r.doc_id: r.license for r in scan(spark, rows).collect()}
    assert {line: got[i] for i, line in enumerate(LINES)} == LINES


@pytest.mark.skipif(not os.path.isdir(PUBLISHED), reason="no published licences here")
def test_published_licences(spark):
    names = [n for n in FILES if os.path.exists(f"{PUBLISHED}/{n}")]
    rows = [(i, f"{n}/LICENSE", open(f"{PUBLISHED}/{n}", errors="replace").read()) for i, n in enumerate(names)]
    rows += [(1000 + i, f"{n}/src/deep/x.c", "int x;") for i, n in enumerate(names)]
    got = {r.doc_id: r.license for r in scan(spark, rows).collect()}
    assert {n: got[i] for i, n in enumerate(names)} == {n: FILES[n] for n in names}
    assert {n: got[1000 + i] for i, n in enumerate(names)} == {n: FILES[n] for n in names}


MIT_BODY = """/*
 * Permission is hereby granted, free of charge, to any person obtaining a copy of
 * this software and associated documentation files (the "Software"), to deal in
 * the Software without restriction, including without limitation the rights to
 * use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies
 * of the Software, and to permit persons to whom the Software is furnished to do
 * so, subject to the following conditions:
 */
int main(void) { return 0; }"""
GPL_HEADER = """# This program is free software; you can redistribute it and/or
# modify it under the terms of the GNU General Public License
# as published by the Free Software Foundation; either version %s
# of the License, or (at your option) any later version.
import os"""


def test_wrapped_headers(spark):
    rows = [(1, "a/x.c", MIT_BODY), (2, "b/x.py", GPL_HEADER % 2), (3, "c/x.py", GPL_HEADER % 3), (4, "d/x.py", GPL_HEADER.replace("; either version %s", ""))]
    assert {r.doc_id: r.license for r in scan(spark, rows).collect()} == {1: "MIT", 2: "GPL-2.0", 3: "GPL-3.0", 4: "GPL"}


def test_ids_of_any_kind(spark):
    """Rows without id, and rows that share one, have a license of their own; of licence files alike the smallest id's counts."""
    mit, isc = "Released under the MIT License", "ISC License"
    rows = [(None, "a/x.py", mit), (None, "a/y.py", "nothing"), ("k", "b/LICENSE", "ISC License"), ("k", "b/z.py", mit), ("k", "b/z.py", mit), ("j", "b/LICENSE.md", "MIT License"), ("l", "b/w.py", None), (None, "b/COPYING", "BSD License")]
    got = sorted((r.doc_id or "", r.path, r.license or "", r.found_in or "") for r in scan(spark, rows, "string").collect())
    assert got == sorted([
        ("", "a/x.py", "MIT", "header"), ("", "a/y.py", "", ""), ("k", "b/LICENSE", "ISC", "header"), ("k", "b/z.py", "MIT", "header"), ("k", "b/z.py", "MIT", "header"),
        ("j", "b/LICENSE.md", "MIT", "header"), ("l", "b/w.py", "MIT", "directory"), ("", "b/COPYING", "BSD", "header"),
    ])
    assert isc and scan(spark, [], "string").count() == 0


def test_a_third_of_all_in_one_directory(spark):
    rows = [(i, f"hot/sub{i}/x.py" if i % 3 else "hot/x%d.py" % i, "x") for i in range(1500)] + [(5000, "hot/LICENSE", "MIT License"), (5001, "hot/sub7/LICENSE", "ISC License"), (5002, "cold/x.py", "x"), (5003, "LICENSE", "BSD 3-Clause License")]
    got = {r.doc_id: (r.license, r.inherited_from) for r in scan(spark, rows).collect()}
    assert all(got[i] == (("ISC", "hot/sub7") if i == 7 else ("MIT", "hot")) for i in range(1500)) and got[5002] == ("BSD-3-Clause", "")


def test_very_many_partitions(spark):
    """Above 5,000 partitions the share from which a key is hot stays what freqItems takes."""
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "6000")
    try:
        df = spark.createDataFrame([(i % 5,) for i in range(1000)], "k long")
        assert common.hot_support(spark) == 1e-4 and {r.k for r in common.hot_keys(df, "k").collect()} == set(range(5))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_skewed_left_join(spark):
    left = spark.createDataFrame([(1 if i % 2 else i % 40, i) for i in range(2000)] + [(None, 3)], "k long, v long")
    right = spark.createDataFrame([(k, f"r{k}") for k in range(1, 30)], "k long, r string")
    want = sorted(map(str, left.join(right, "k", "left").select("k", "v", "r").collect()))
    assert sorted(map(str, common.left_join_skewed(left, right, "k").select("k", "v", "r").collect())) == want
    none = right.filter("k > 1")
    assert common.left_join_skewed(left, none, "k").filter("r IS NULL").count() == left.join(none, "k", "left").filter("r IS NULL").count()
