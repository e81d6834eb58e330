import base64
import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackscan.llm import chat, licenses, sketch, topk


def decoded(text):
    return np.frombuffer(base64.b64decode(text), "<u8")


@pytest.mark.parametrize("name", ["odd", "docs", "none"])
def test_fingerprints(request, name, monkeypatch):
    monkeypatch.setattr(sketch, "RANGES", 5)
    table = request.getfixturevalue(name)
    source = [(r["doc_id"], r["text"] or "") for r in table.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).orderBy(F.asc_nulls_first("doc_id"), "h").collect()]
    rows = sketch.query(table).collect()
    assert len(rows) == len(source)
    texts = [t for _, t in source]
    expected = Counter()
    for (key, own), after in zip(source, texts[1:] + texts[:1]):
        changed = sketch.edited(own, after)
        expected[key, len(own), hashlib.sha256(changed.encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows) == expected
    by_text = {}
    for r in rows:
        own = next(t for k, t in source if k == r["doc_id"])
        assert by_text.setdefault(own, r["fingerprint"]) == r["fingerprint"]
        assert decoded(r["fingerprint"]).tolist() == sketch.sketches([own])[0].tolist()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1


def exact(a, b):
    """Resemblance of the sets of shingles, and the size of both together."""
    sets = []
    for t in (a, b):
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 5 else {tuple(w)} if w else set())
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0, len(sets[0] | sets[1])


@pytest.mark.parametrize("kind", ["long", "string"])
def test_fingerprints_equal_brute_force(spark, docs, kind):
    """Hot and null ids over several tasks against sets of shingles: exact where both together fit a sketch."""
    texts = [r["text"] for r in docs.orderBy("doc_id").limit(70).collect()] + ["", "one", "a b c d e f g"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, t) for t in texts[:40]] + [(None, t) for t in texts[20:50]] + [(7, "same words in every row")] * 50 + [(None, "null")] * 40 + [(None, None)] * 3
    table = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(f"CAST(doc_id AS {kind}) AS doc_id", "text", "1 AS k", "2 AS h", "3 AS n").repartition(6)
    source = [(r["doc_id"], r["text"] or "") for r in table.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).orderBy(F.asc_nulls_first("doc_id"), "h").collect()]
    expected = {}
    for (key, own), (_, after) in zip(source, source[1:] + source[:1]):
        changed = own[: len(own) - len(own) // 2] + after[: len(own) // 2]
        expected.setdefault((key, len(own), hashlib.sha256(changed.encode()).hexdigest()), []).append((exact(own, changed), exact(own, after)))
    got = {}
    for r in sketch.query(table).collect():
        got.setdefault((r["doc_id"], r["n_chars"], r["edited_sha256"]), []).append((r["near_edited"], r["near_next"]))
    assert {k: len(v) for k, v in got.items()} == {k: len(v) for k, v in expected.items()}
    for k, found in got.items():
        for near, known in zip(sorted(found), sorted(expected[k])):
            for x, (y, size) in zip(near, known):
                assert x == y if size <= sketch.K else abs(x - y) < 0.15


def test_sketch_estimates(docs):
    texts = [r["text"] for r in docs.select("text").limit(60).collect()]
    for a, b in zip(texts, texts[1:]):
        changed = sketch.edited(a, b)
        x, y = sketch.sketches([a, changed])
        assert abs(sketch.resemblance(x, y) - exact(a, changed)[0]) < 0.15
    words = [f"w{i}" for i in range(20000)]
    whole, first, second = sketch.sketches([" ".join(words), " ".join(words[:12004]), " ".join(words[12000:])])
    assert sketch.merged(first, second).tolist() == whole.tolist()
    assert abs(sketch.distinct(whole) / 19996 - 1) < 0.2
    assert abs(sketch.containment(first, whole) - 1) < 0.2 and abs(sketch.containment(whole, first) - 0.6) < 0.15


def test_merge_over_parts(spark, docs):
    prints = sketch.fingerprint(docs).selectExpr("doc_id % 3 AS part", "sketch").unionByName(spark.createDataFrame([(9, None)], "part long, sketch binary"))
    got = {r["part"]: np.frombuffer(r["sketch"], "<u8").tolist() for r in sketch.merge_sketches(prints, "part").collect()}
    for part in range(3):
        expected = np.zeros(0, np.uint64)
        for r in docs.where(f"doc_id % 3 = {part}").select("text").collect():
            expected = sketch.merged(expected, sketch.sketches([r["text"]])[0])
        assert got[part] == expected.tolist()
    assert got[9] == []


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_top_k_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "LEAST_BLOCK", 40)
    monkeypatch.setattr(topk, "LEAF", 8)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=6).astype(np.float32)], 0) for i in range(400)] + [(400 + i, [0.5] * 6, 0) for i in range(220)]
    rows += [(1000, None, 0), (1050, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (1100, [float("nan")] * 6, 0), (1150, [float("inf")] * 6, 0), (None, [1.0] * 6, 0), (1200, [2.0, 1.0], 0), (1250, [], 0)]
    own = {k: np.floor(256 * np.array([*v, *[0.0] * (6 - len(v))], np.float64)).astype(np.int64) for k, v, _ in rows if k is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    expected = set()
    for q in own:
        if q % 50 == 0:
            best = sorted((-int(own[q] @ v), k) for k, v in own.items() if k != q)[:5]
            expected |= {(q, i + 1, k, -s) for i, (s, k) in enumerate(best)}
    got = [tuple(r) for r in topk.query(vectors(spark, rows)).collect()]
    assert set(got) == expected and len(got) == len(expected)


def test_top_k_of_a_hot_id(spark):
    """More rows of one id than a key of the search has room for."""
    frame = spark.range(200_000).selectExpr("CAST(if(id % 4 = 0, id / 4, 7) AS long) AS vec_id", "array(CAST(id % 997 AS float) / 100, CAST(id % 1009 AS float) / 50 - 9) AS embedding", "'x' AS block", "'y' AS v")
    frame = frame.where("vec_id = 7 OR vec_id % 10 = 0")
    rows = frame.select("vec_id", "embedding").toPandas()
    ids, v = rows["vec_id"].to_numpy(), np.floor(256 * np.stack(rows["embedding"]).astype(np.float64)).astype(np.int64)
    assert (ids == 7).sum() > 1 << topk.TIE
    wanted = [0, 50, 24950, 49950]
    expected = set()
    for q in wanted:
        score = v @ v[ids == q][0]
        others = np.flatnonzero(ids != q)
        best = others[np.lexsort((ids[others], -score[others]))[:5]]
        expected |= {(q, i + 1, int(ids[j]), int(score[j])) for i, j in enumerate(best)}
    got = [tuple(r) for r in topk.top_k(frame, F.col("id").isin(wanted)).collect()]
    assert set(got) == expected and len(got) == 20
    data = v[ids == 7]
    row, found, score = topk.search(data[: 1 << topk.TIE], ids[ids == 7][: 1 << topk.TIE], v[:3], np.array([-1, -2, -3]), np.full(3, topk.NONE))
    for i in range(3):
        assert sorted(score[row == i].tolist()) == sorted((data[: 1 << topk.TIE] @ v[i]).tolist())[-5:]


def test_top_k_small_tables(spark):
    assert topk.query(vectors(spark, [])).collect() == []
    assert topk.query(vectors(spark, [(0, [1.0], 0)])).collect() == []
    got = sorted(tuple(r) for r in topk.query(vectors(spark, [(0, [1e9, 1e9], 0), (1, [-1e9, 5.0], 0), (50, [0.0, 0.0], 0)])).collect())
    assert [r[:3] for r in got] == [(0, 1, 50), (0, 2, 1), (50, 1, 0), (50, 2, 1)]


def test_chat_rotation(spark):
    rows = [(1, 0, "ann", "hi"), (1, 1, "bob", "yo"), (1, 70, "ann", None), (None, None, None, "x"), (2, 0, "ann", "a"), (2, 0, "ann", "a")]
    done = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS part", "2 AS start")).collect()
    by = {(r["conv_id"], r["participant"], r["part"]): r for r in done}
    assert len(by) == len(done) == 6
    whole = by[1, "bob", 0]["rendered"] + by[1, "bob", 1]["rendered"]
    assert whole == "<|user name=ann|>\nhi<|end|>\n<|assistant|>\nyo<|end|>\n<|user name=ann|>\n<|end|>\n"
    for key in ("ann", "bob"):
        text = by[1, key, 0]["rendered"] + by[1, key, 1]["rendered"]
        said = [text[m["start"] : m["end"]] for p in (0, 1) for m in by[1, key, p]["masks"]]
        assert said == (["hi<|end|>\n", "<|end|>\n"] if key == "ann" else ["yo<|end|>\n"])
    assert by[2, "ann", 0]["n_turns"] == 2 and by[None, "unknown", 0]["rendered"] == "<|assistant|>\nx<|end|>\n"


@pytest.mark.parametrize("hot,block", [(4096, 1024), (3, 2), (1, 1)])
def test_chat_slices_hold_the_whole_dialogue(spark, monkeypatch, hot, block):
    """Null, repeated and far turn numbers: the slices of a perspective, in order of start, are gapless and hold each turn once."""
    monkeypatch.setattr(chat, "BLOCK", block)
    monkeypatch.setattr(chat, "COPIES", 2)
    rows = [(1, n, who, text) for n, who, text in [(None, "a", "x"), (None, None, None), (0, "a", "hi"), (1, "b", "yo"), (64, "a", "far"), (64 * 9, "c", ""), (65, "b", "é" * 9)]]
    rows += [(1, 1, "a", "same")] * 9 + [(1, 1, "b", f"t{i}") for i in range(7)] + [(1, None, "a", "n")] * 5 + [(None, 3, "a", "q"), (None, None, "b", "r"), (2, 0, "a", "z" * 50000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS part", "2 AS c", "3 AS copy", "4 AS participant")
    done = chat.rotate(frame, hot=hot).collect()
    people = {(c, who or "unknown") for c, _, who, _ in rows}
    assert {(r["conv_id"], r["participant"]) for r in done} == people
    for c, person in people:
        own = sorted((r for r in done if (r["conv_id"], r["participant"]) == (c, person)), key=lambda r: r["start"])
        order = [(r["part"], *((r["slice"]["turn"] is not None, r["slice"]["turn"] or 0, r["slice"]["bucket"], r["slice"]["copy"]) if r["slice"] else ())) for r in own]
        assert order == sorted(order)
        whole = "".join(r["rendered"] for r in own)
        assert [r["start"] for r in own] == [len("".join(x["rendered"] for x in own[:i])) for i in range(len(own))]
        turns = whole.split("<|end|>\n")[:-1]
        expected = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "unknown", r[3] or ""))
        lines = [("<|assistant|>\n" if (who or "unknown") == person else f"<|user name={who or 'unknown'}|>\n") + (text or "") for _, _, who, text in expected]
        assert turns == lines if hot == 4096 else sorted(turns) == sorted(lines)
        said = [whole[m["start"] : m["end"]] for r in own for m in r["masks"]]
        assert said == [t.split("\n", 1)[1] + "<|end|>\n" for t in turns if t.startswith("<|assistant|>")]
        assert sum(r["n_turns"] for r in own) == len(expected)
    assert chat.rotate(frame.limit(0)).collect() == []


def test_native_operators_run_no_python(spark, odd):
    turns = spark.createDataFrame([(1, 0, "a", "b")], "conv_id long, turn long, role string, text string")
    for frame in (chat.query(turns), licenses.query(odd)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


MIT = """Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,"""


def test_license_rules(spark, odd, none):
    texts = [
        (1, "Some words.\nLicensed under the Apache License, Version 2.0."),
        (2, "Released under the MIT License. All rights reserved!"),
        (3, "licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\nhttp://x"),
        (4, "This work is licensed under the GNU General Public License, version 3. Licensed under CC BY-NC 4.0."),
        (5, "A licence is nothing here"),
    ]
    got = {r["doc_id"]: (r["identifiers"], r["licenses"]) for r in licenses.query(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {1: ("a", "Apache-2.0"), 2: ("fx", "MIT,Proprietary"), 3: ("abc", "Apache-2.0"), 4: ("jo", "CC-BY-NC-4.0,GPL-3.0-only"), 5: ("", "")}
    more = odd.unionByName(odd.where("doc_id = 7").selectExpr("* EXCEPT (text)", "'Licensed under CC BY 4.0' AS text")).selectExpr("*", "1 AS identifiers", "2 AS licenses")
    rows = [(r["doc_id"], r["identifiers"], r["n_licenses"], r["licenses"]) for r in licenses.query(more).collect()]
    assert Counter(rows) == Counter([*((r["doc_id"], "", 0, "") for r in odd.collect()), *[(7, "p", 1, "CC-BY-4.0")] * 2])
    assert licenses.query(none).count() == 0


WRAPPED = {
    "MIT": ("ghi", f"""{MIT}
modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS"""),
    "Apache-2.0": ("abcde", """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""),
    "GPL-3.0-or-later": ("kmn", """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""),
    "GPL-2.0-or-later": ("lmn", """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License along
with this program; if not, write to the Free Software Foundation"""),
    "BSD-3-Clause": ("rstu", """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""),
    "MPL-2.0": ("v", """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    "ISC": ("w", """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""),
    "CC-BY-4.0": ("p", "This work is licensed under a Creative Commons\nAttribution 4.0 International License."),
    "CC-BY-SA-4.0": ("q", "This work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("o", "This work is licensed under a Creative Commons\nAttribution-NonCommercial 4.0 International License."),
    "GPL-3.0-only": ("j", "This work is licensed under the GNU General\nPublic License, version 3."),
    "Proprietary": ("x", "Copyright 2020 Someone. All rights\nreserved."),
}


def twin(rows):
    """The SQL twin's rows for (doc_id, text)."""
    import duckdb
    import pandas as pd

    documents = pd.DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841
    return {r[0]: (r[3], r[1]) for r in duckdb.sql(f"SELECT doc_id, identifiers, n_licenses, licenses FROM ({licenses.ORACLE_SQL})").fetchall()}


def test_canonical_wrapped_notices(spark):
    cases = [(name, ids, before + text.replace("\n", f"\n{before}")) for name, (ids, text) in WRAPPED.items() for before in ("", "# ", " * ", ";; ")]
    cases += [(name, ids, text.replace("\n", "\r\n")) for name, (ids, text) in WRAPPED.items()]
    cases += [("BSD-2-Clause", "rst", WRAPPED["BSD-3-Clause"][1].split("\n\n3.")[0]), ("MIT", "gh", WRAPPED["MIT"][1].split("\n\nTHE")[0]), ("MIT", "f", "This project is licensed\nunder the MIT License.")]
    cases += [("MIT", "y", "# SPDX-License-Identifier: MIT\nx = 1"), ("Apache-2.0", "z", "// SPDX-License-Identifier: Apache-2.0"), ("", "", "SPDX-License-Identifier: MIT OR X"), ("", "", "licensed under the\n\nMIT License")]
    cases += [("Apache-2.0", "a", "Licensed under the Apache License,\nVersion 2.0"), ("GPL-3.0-or-later", "k", WRAPPED["GPL-3.0-or-later"][1].split("\n\n")[0]), ("GPL-2.0-or-later", "l", WRAPPED["GPL-2.0-or-later"][1].split("\n\n")[0])]
    cases += [("Apache-2.0", "abc", WRAPPED["Apache-2.0"][1].split("\n\nUnless")[0])]
    # on one line, behind a title and a copyright line without a full stop
    cases += [(name, ids, f"{title}Copyright (c) 2020 Some One " + " ".join(text.split("Someone\n")[-1].split())) for name, (ids, text) in WRAPPED.items() if name != "Proprietary" for title in ("", f"The {name} License ")]
    rows = [(i, text) for i, (_, _, text) in enumerate(cases)]
    assert twin(rows) == {i: (name, ids) for i, (name, ids, _) in enumerate(cases)}
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["licenses"], r["identifiers"]) for r in licenses.query(frame).collect()}
    assert [got[i] for i in range(len(cases))] == [(name, ids) for name, ids, _ in cases]
    assert {name for name, _, _ in cases} >= {name for name, _ in licenses.RULES}
