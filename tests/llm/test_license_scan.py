import textwrap

import duckdb
import pytest

from spindrift.llm import license_scan as scan
from spindrift.llm.license_sql import OP10_SQL
from tests.oracle import same

MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
"""


def test_rules(spark):
    texts = [
        None,
        "",
        "Nothing here.\nAt all.",
        "Intro text. This work is licensed under the GNU General Public License, version 3. More text.",
        MIT,
        "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0.\nLicensed under CC BY-NC 4.0.",
        "Licensed under the Moon License.",
        "word " * 200000 + "\nReleased under the MIT License.",
    ]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(None, texts[5], None), (3, texts[3], None)], "doc_id long, text string, licences string")
    got = {}
    for r in scan.scan(df).collect():
        assert got.setdefault(r.id, r) == r
    assert [got[k].licences for k in range(8)] == [[], [], [], ["GPL-3.0"], ["MIT"], ["CC-BY-NC-4.0", "Apache-2.0"], [], ["MIT"]]
    assert got[4].sentence_ids == ["mit-name", "unknown", "mit-grant", "mit-notice"]
    assert got[6].n_unknown == 1 and got[None].licences == got[5].licences
    assert scan.scan(df.limit(0)).count() == 0


def test_plan_has_no_python(spark):
    plan = scan.op10_license_scan(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_equals_sql(spark, sf):
    d = f"/root/testdata/sf{sf}"
    same(scan.op10_license_scan(spark, d), d, OP10_SQL)


def test_every_sentence_and_every_rule(spark):
    known = [(name, v) for name, variants in scan.SENTENCES.items() for v in variants]
    known += [(name, x) for name, (names, tags) in scan.NAMES.items() for x in [*names, *(f"Licensed under the {v}." for v in names), *(f"SPDX-License-Identifier: {t}" for t in tags)]]
    written = {name: variants[0] for name, variants in scan.SENTENCES.items()} | {name: names[0] for name, (names, _) in scan.NAMES.items()}
    texts = [f"Code follows.\n{v}\n" for _, v in known] + ["\n".join(written[n] for n in need) for _, need in scan.RULES]
    wrapped = [textwrap.fill(t, 40, break_long_words=False) for t in texts[: len(known)]]
    df = spark.createDataFrame(list(enumerate(texts + wrapped)), "doc_id long, text string")
    got = {r.id: r for r in scan.scan(df).collect()}
    assert [got[k].sentence_ids for k in range(len(known))] == [[name] for name, _ in known]
    assert [got[len(known) + k].licences for k in range(len(scan.RULES))] == [[licence] for licence, _ in scan.RULES]
    assert [got[len(texts) + k].sentence_ids for k in range(len(known))] == [[name] for name, _ in known]


def test_sql_equals_query_on_real_headers(spark, tmp_path):
    texts = [None, "", MIT + AS_IS, GPL2, APACHE, BSD, MPL, "SPDX-License-Identifier: MIT", "x\n" * 5 + "Licensed under the Moon\nLicense. All rights reserved.\n\n\nBSD-style license; GPLv3. CC BY-NC-SA 4.0!"]
    texts += [textwrap.fill(t or "", 60) for t in texts] + [textwrap.indent("\n\n".join(textwrap.fill(p, 70) for p in (t or "").split("\n\n")), " * ", lambda _: True) for t in texts]
    texts += [v for variants in scan.SENTENCES.values() for v in variants] + [x for names, tags in scan.NAMES.values() for x in [*names, *(f"SPDX-License-Identifier: {t}" for t in tags)]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(map(str, r)) for r in scan.op10_license_scan(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == sorted(tuple(map(str, r)) for r in con.execute(OP10_SQL).fetchall())


def test_long_runs_of_marks(spark):
    texts = ["\n" * 300_000 + "MIT License", ". " * 300_000 + "\nMIT License\n" + "! " * 1000, "- " * 300_000 + "license", "license\n" * 50_000, "license" + " " * 500_000 + "x"]
    got = {r.id: r for r in scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[k].licences for k in range(5)] == [["MIT"], ["MIT"], [], [], []] and [got[k].n_unknown for k in range(5)] == [0, 0, 1, 1, 1]


GPL2 = """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of it was not given, ask for one."
AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'


def test_wrapped_headers(spark):
    want = [
        (MIT + "\n" + AS_IS, "MIT", ["mit-name", "unknown", "mit-grant", "mit-notice", "as-is-mit"]),
        (GPL2, "GPL-2.0", ["gpl-2-grant", "gpl-warranty", "gpl-details"]),
        (GPL2.replace("version 2", "version 3").replace("; you", ": you"), "GPL-3.0", ["gpl-3-grant", "gpl-warranty", "gpl-details"]),
        (APACHE, "Apache-2.0", ["apache-2-name", "apache-comply", "apache-copy", "apache-as-is", "apache-see"]),
        (BSD, "BSD-3-Clause", ["bsd-head", "bsd-source", "bsd-binary", "bsd-endorse"]),
        (MPL, "MPL-2.0", ["mpl-2-form"]),
    ]
    texts = []
    for text, _, _ in want:
        texts.append(text)
        for width in (70, 80):
            wrapped = "\n\n".join(textwrap.fill(p, width) for p in text.split("\n\n"))
            texts += [wrapped, wrapped.replace("\n", "\r\n"), textwrap.indent(wrapped, " * ", lambda _: True), textwrap.indent(wrapped, "# ", lambda _: True)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: r for r in scan.scan(df).collect()}
    for k in range(len(texts)):
        _, licence, ids = want[k // 9]
        assert got[k].licences == [licence], texts[k]
        assert got[k].sentence_ids == ids, texts[k]


def test_known_words_within_a_sentence_are_not_known(spark):
    texts = ["It says licensed under the MIT License here.", "Released under the MIT License, perhaps, or not."]
    got = {r.id: r for r in scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[k].sentence_ids for k in range(2)] == [["unknown"]] * 2
