from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from trackscan.llm import simhash


def brute(values):
    """Component (least position) of each fingerprint."""
    parent = list(range(len(values)))

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for i in range(len(values)):
        for j in range(i):
            if (int(values[i]) ^ int(values[j])).bit_count() <= 4:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def plain(text):
    words = (text or "").encode().lower().split()
    parts = [words[i : i + 4] for i in range(len(words) - 3)] if len(words) > 4 else [words] if words else []
    hashes = [xxhash.xxh64_intdigest(b" ".join(p), 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


@pytest.mark.parametrize("name", ["odd", "docs", "none"])
def test_query_matches_brute_force(request, name):
    table = request.getfixturevalue(name)
    rows = table.select("doc_id", "text").collect()
    prints = [plain(r["text"]) for r in rows]
    root = brute(prints)
    ids = {}
    for r, x in zip(rows, root):
        if r["doc_id"] is not None:
            ids[x] = min(ids.get(x, r["doc_id"]), r["doc_id"])
    expected = Counter((r["doc_id"], f"{p:016x}", ids.get(x)) for r, p, x in zip(rows, prints, root))
    assert Counter(map(tuple, simhash.query(table).collect())) == expected


@pytest.mark.parametrize("hot", [50_000, 3])
def test_links_with_split_leads(spark, hot):
    rng = np.random.default_rng(hot)
    base = rng.integers(0, 2**63, 3, dtype=np.uint64)
    near = [int(b) ^ int(np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, 5, dtype=np.uint64))) for b in base for _ in range(25)]
    values = sorted({*near, *(int(x) for x in rng.integers(0, 2**63, 60, dtype=np.uint64))})
    frame = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in values], "fp long")
    index = {x: i for i, x in enumerate(values)}
    parent = list(range(len(values)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for r in simhash.star_links(frame, len(values), hot=hot).collect():
        a, b = find(index[r["src"] % (1 << 64)]), find(index[r["dst"] % (1 << 64)])
        parent[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(values))] == brute(values)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32 - 1), st.sampled_from([10, 10**6, 10**9, 10**12]))
def test_every_scheme_finds_every_link(seed, count):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**63, dtype=np.uint64)
    b = a
    for bit in rng.choice(64, 4, replace=False):
        b ^= np.uint64(1) << np.uint64(bit)
    both = np.array([a, b])
    met = False
    for lead in simhash.scheme(count):
        x = simhash.turned(both, lead)
        assert (simhash.restored(x, lead) == both).all()
        met = met or x[0] >> np.uint64(64 - sum(w for _, w in lead)) == x[1] >> np.uint64(64 - sum(w for _, w in lead))
    assert met


def test_rows_of_one_id_are_one_node(spark):
    rows = [(5, "a b c d e f"), (5, "totally other words are in this text"), (6, "a b c d e f"), (9, "totally other words are in this text")]
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in found} == {5}


def test_keep_one_leaves_one_of_each_group(spark, odd):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    # 2, 3 and 4 have no words; 0 and 1 are copies; 7 is there twice
    assert ids == [0, 2, 5, 6, 7, 9, 10]
