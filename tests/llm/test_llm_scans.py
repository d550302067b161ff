"""Licence and secret scans."""

import hashlib
import random
import re
from base64 import b64encode

import duckdb
import pytest
from pyspark.sql import functions as F

from sheaf.llm import licenses, secrets
from sheaf.llm.queries import QUERIES

DOCS = "doc_id long, text string"
ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A
)
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may
not use this file except in compliance with the License. You may obtain a copy of
the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed
under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
CONDITIONS OF ANY KIND, either express or implied."""


def base(text):
    text, spans = text or "", []
    found = (
        [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= 6],
        [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20],
        [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24],
    )
    for k, kind in enumerate(found):
        spans += [(s, k, e) for s, e in kind]
    joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(spans))
    return (*map(len, found), hashlib.sha256(joined.encode()).hexdigest()), joined


def rows():
    rng = random.Random(1)
    code = lambda n: b64encode(rng.randbytes(n)).decode()
    out = [
        (1, None), (2, ""), (3, "token=secret=abcdef1"), (4, 'secret: token = abcdefgh PASSWORD:"x"'),
        (5, "é😀 password= 'abcdef' ü AKIA" + "A" * 16 + " AKIAAKIA12 " + "0123456789abcdef" * 2),
        (6, "api_key=abcdefg APIKEY: 1234567 apikey:ab"), (7, "x " + code(30) + " y " + code(24) + " " + rng.randbytes(20).hex()),
        (8, "internationalization-of-everything aaaaaaaaaaaaaaaaaaaaaaaa1111111111 " + "abc123" * 10),
        (9, "ſecret=abcdefgh toKen=abcdefgh"), (9, "ſecret=abcdefgh toKen=abcdefgh"), (10, "hex:" + "a" * 24 + "g" + "b" * 23),
    ]
    return out + [(100 + i, f"w {code(18 + i)} password: {code(6)}\n") for i in range(20)]


def test_base_spans(spark):
    df = spark.createDataFrame(rows(), DOCS).selectExpr("*", "1 AS spans", "2 AS hex")
    got = secrets.find_secrets(df).collect()
    assert len(got) == len(rows())
    texts = dict(rows())
    for r in got:
        want, joined = base(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == want
        assert [s for s in r.spans.split(",") if s and not s.startswith("random")] == [s for s in joined.split(",") if s]
    random_ = {r.doc_id: r.n_random for r in got}
    assert random_[7] == 2 and sum(random_[100 + i] for i in range(20)) > 15


def test_battery_tells_words_from_codes(spark):
    rng = random.Random(5)
    codes = [(i, rng.randbytes(24).hex() + "Q" if i % 2 else b64encode(rng.randbytes(30)).decode()) for i in range(100)]
    plain = [(200 + i, "Abc" * 12 + "1") for i in range(50)] + [(300 + i, "A" * 20 + "a1" * 10) for i in range(50)]
    got = {r.doc_id: r.n_random for r in secrets.find_secrets(spark.createDataFrame(codes + plain, DOCS)).collect()}
    assert sum(got[i] for i in range(0, 100, 2)) >= 45
    assert sum(got[200 + i] + got[300 + i] for i in range(50)) == 0


def test_tokens_after_names_and_of_other_alphabets(spark):
    rng = random.Random(11)
    draw = lambda symbols, n: "".join(rng.choices(symbols, k=n))
    digits, lower = "0123456789", "abcdefghijklmnopqrstuvwxyz"
    both = digits + lower + lower.upper()
    made = {
        0: lambda: ("AWS_SECRET_ACCESS_KEY=", draw(both + "+/", 40), ""),
        1: lambda: ("sig=", draw(both, 24), ""),
        2: lambda: ("key ", draw(digits + lower, 40), ""),
        3: lambda: ("id:", draw(digits + lower.upper(), 64), ""),
        4: lambda: ("a_b-c/", draw(both, 32), "/d-e_f"),
        5: lambda: ("NAME=", draw(digits + lower, 64), ""),
        6: lambda: ("X_Y=", draw(both + "+/", 31) + "a==", " b"),
    }
    pieces = {100 * k + i: make() for k, make in made.items() for i in range(30)}
    known = [(1, "AWS_SECRET_ACCESS_KEY=wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"), (2, "sig=Zx9Qk3Lm2Vb8Nc7Tr5Yp1Hs6")]
    docs = [(1000 + i, "".join(x)) for i, x in pieces.items()] + known
    got = {r.doc_id: r for r in secrets.find_secrets(spark.createDataFrame(docs, DOCS)).collect()}
    assert got[1].spans == "random:22:62" and got[2].spans == "random:4:28"
    for k in made:
        hits = 0
        for i in range(100 * k, 100 * k + 30):
            before, token, _ = pieces[i]
            spans = [tuple(map(int, s.split(":")[1:])) for s in got[1000 + i].spans.split(",") if s]
            assert len(spans) == len(set(spans)) and got[1000 + i].n_random <= 1
            hits += any(a <= len(before) and b >= len(before + token) for a, b in spans)
        assert hits >= 25, (k, hits)


def test_no_secrets(spark):
    assert secrets.find_secrets(spark.createDataFrame([], DOCS)).collect() == []


def test_query_base(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in QUERIES["op6_secrets"](spark, folder).collect():
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == base(texts[r.doc_id])[0]


@pytest.fixture
def license_rows():
    return [
        (1, None), (2, ""), (3, APACHE), (4, "/*\n * Released under the MIT License.\n */\nint x;"),
        (5, "foo bar\nThis work is licensed under the GNU General Public Licence, version 3."), (6, "Licensed under CC BY-NC 4.0."),
        (7, "Released under the MIT License. Licensed under the Apache License, Version 2.0."), (7, "I have a license to drive."),
        (8, "Licensed under CC BY 4.0.\nLicensed under CC BY 4.0.\n" + "word " * 5000), (9, "See the MIT License"),
    ]


def test_licenses(spark, license_rows):
    df = spark.createDataFrame(license_rows, DOCS).selectExpr("*", "1 AS licenses")
    got = {(r.doc_id, r.n_sentences): r.licenses for r in licenses.scan_licenses(df).collect()}
    assert got[4, 1] == "MIT" and got[5, 1] == "GPL-3.0" and got[6, 1] == "CC-BY-NC-4.0" and got[8, 2] == "CC-BY-4.0"
    assert got[7, 2] == "Apache-2.0,MIT" and got[7, 0] == got[1, 0] == got[2, 0] == got[9, 0] == ""
    assert "Apache-2.0" in {v for (d, _), v in got.items() if d == 3} and len(got) == len(license_rows)
    duck = duckdb.connect()
    duck.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    duck.executemany("INSERT INTO documents VALUES (?, ?)", license_rows)
    want = duck.sql(licenses.oracle_sql()).fetchall()
    assert sorted(map(tuple, licenses.scan_licenses(df).collect())) == sorted(want)


def test_rules_use_up_what_they_match(spark):
    known = {"a": "one license", "b": "two license", "c": "three license"}
    rules = (("AB", ("a", "b")), ("B", ("b",)), ("AC", ("a", "c")))
    rows = [(1, "One license. Two license."), (2, "One license. Two license. Three license."), (3, "Two license. One license. x. Three license.")]
    got = dict(licenses.scan_licenses(spark.createDataFrame(rows, DOCS), known, rules).select("doc_id", "licenses").collect())
    assert got == {1: "AB", 2: "AB", 3: "B,AC"}


MIT_FILE = """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED.
"""
BSD_FILE = """Copyright (c) 2020, Some One
Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
APACHE_FILE = """Copyright 2020 Some One

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
GPL_FILE = """Some program
Copyright (C) 2020 Some One

This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.
"""
MPL_FILE = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""


def test_whole_license_files(spark):
    from sheaf.llm import queries

    files = [(MIT_FILE, "MIT", 2), (BSD_FILE, "BSD-3-Clause", 4), (APACHE_FILE, "Apache-2.0", 5), (GPL_FILE, "GPL-2.0-or-later", 1)]
    files += [(MPL_FILE, "MPL-2.0", 1), ("I was\nreleased under the\nMIT license last year", "", 0)]
    files += [("\n".join("# " + line for line in text.split("\n")).replace("\n", end), name, n) for text, name, n in files for end in ("\n", "\r\n")]
    docs = spark.createDataFrame([(i, text) for i, (text, _, _) in enumerate(files)], DOCS)
    table, queries.table = queries.table, lambda *_: docs
    try:
        got = {r.doc_id: (r.licenses, r.n_sentences) for r in QUERIES["op3_licenses"](spark, "").collect()}
    finally:
        queries.table = table
    assert got == {i: (name, n) for i, (_, name, n) in enumerate(files)}


def test_license_query_has_the_results_of_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = duck.sql(licenses.oracle_sql()).fetchall()
    assert sorted(map(tuple, QUERIES["op3_licenses"](spark, folder).collect())) == sorted(want)


def test_no_licenses(spark):
    assert licenses.scan_licenses(spark.createDataFrame([], DOCS)).collect() == []


def test_long_tokens_and_many_spans(spark):
    """A token of a megabyte, of one letter or of random ones, and a text of many tokens end in linear time."""
    rng = random.Random(8)
    digits = "".join(rng.choices("0123456789abcdef", k=1_000_000))
    both = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_", k=200_000))
    many = " ".join("".join(rng.choices("0123456789abcdef", k=rng.randrange(20, 30))) for _ in range(20_000))
    docs = [(1, digits), (2, "A" * 1_000_000), (3, both), (4, many), (5, "a1" * 400_000), (6, "token=" + "x" * 500_000)]
    got = {r.doc_id: r for r in secrets.find_secrets(spark.createDataFrame(docs, DOCS)).collect()}
    for doc_id, text in docs:
        counts, _ = base(text)
        r = got[doc_id]
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == counts, doc_id
    assert got[1].spans == "hex:0:1000000"
    assert got[2].n_random == 0 and got[5].n_random == 0


def test_spans_apart_and_united(spark):
    """Overlaps against plain loops, with ties, spans inside others and spans that touch."""
    rng = random.Random(9)

    def some(n):
        return [(s, s + rng.randrange(1, 9)) for s in (rng.randrange(60) for _ in range(n))]

    cases = [(i, some(rng.randrange(12)), some(rng.randrange(6))) for i in range(300)]
    kind = "array<struct<start:int,end:int>>"
    df = spark.createDataFrame(cases, f"i int, a {kind}, b {kind}")
    got = df.select("i", secrets._apart(F.col("a"), F.col("b")).alias("free"), secrets._united(F.col("a")).alias("one"))
    found = {r.i: (sorted(map(tuple, r.free)), [tuple(s) for s in r.one]) for r in got.collect()}
    for i, a, b in cases:
        free = sorted(s for s in a if not any(x < s[1] and y > s[0] for x, y in b))
        one = []
        for s, e in sorted(a):
            if one and one[-1][1] > s:
                one[-1] = (one[-1][0], max(one[-1][1], e))
            else:
                one.append((s, e))
        assert found[i] == (free, one), (a, b)
