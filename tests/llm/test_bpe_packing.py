import base64
import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trackscan.llm import bpe, packing, pretokenize
from trackscan.llm import textvec as tv
from trackscan.llm.registry import vocabulary

RANKS, MERGES = vocabulary("byte_bpe_50k.tiktoken"), vocabulary("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(MERGES)
    made.encode_special_tokens = True
    return made


TEXTS = st.lists(st.text(alphabet="abst'rvemld  \n\t12!?’é　中\U0001f642ǅ", max_size=40), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_boundaries_are_those_of_the_pattern(texts):
    import public_tokenizers
    import regex

    points, bounds = tv.points(texts)
    starts = pretokenize.boundaries(points, bounds).tolist()
    whole = "".join(texts)
    assert [whole[a:b] for a, b in zip(starts, [*starts[1:], len(whole)])] == [m for t in texts for m in regex.findall(public_tokenizers.PATTERN, t)]


def test_ids_are_the_libraries(library, tokenizer):
    texts = ["", "a" * 500, "hello  world's end\n\n x", "ab" * 300, " " * 90, "é" * 200, "<|endoftext|>", "The quick brown fox; it's 12345"]
    for own, theirs in ((bpe.encoder(RANKS), library.encode_ordinary), (bpe.encoder(MERGES), lambda t: tokenizer.encode(t, add_special_tokens=False).ids)):
        ids, counts = own.encode(texts)
        ends = np.cumsum(counts)
        assert [ids[e - n : e].tolist() for e, n in zip(ends, counts)] == [theirs(t) for t in texts]


def test_cache_starts_anew_without_changing_ids():
    vocab = bpe.vocabulary(RANKS)
    small = bpe.Cached(lambda words: vocab.merge([w.encode() for w in words]), limit=2)
    for _ in range(3):
        for text in ("one two three four", "five six seven one", "two"):
            assert small.encode([text])[0].tolist() == bpe.encoder(RANKS).encode([text])[0].tolist()


@pytest.mark.parametrize("name", ["odd", "docs", "none"])
def test_query_matches_the_library_and_round_trips(request, library, name):
    table = request.getfixturevalue(name)
    expected = []
    for r in table.select("doc_id", "text").collect():
        text = r["text"] or ""
        ids = library.encode_ordinary(text)
        expected.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert Counter(map(tuple, bpe.query(table, RANKS).collect())) == Counter(expected)


def test_decode_is_its_own_step(odd):
    tokens = bpe.encode(odd, RANKS)
    two = Counter((r["doc_id"], bytes(r["decoded"])) for r in bpe.decode(tokens, RANKS).collect())
    assert two == Counter((r["doc_id"], (r["text"] or "").encode()) for r in odd.collect())


@pytest.mark.parametrize("name", ["odd", "docs", "none"])
def test_packing(request, tokenizer, name):
    table = request.getfixturevalue(name)
    rows = packing.query(table, MERGES).collect()
    ids = {}
    for r in table.select("doc_id", "text").collect():
        ids[r["doc_id"]] = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0]
    assert {r["doc_id"] for r in rows} == set(ids)
    held = defaultdict(list)
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] <= 2048 and zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r["length"] for r in rows)
    assert len(held) <= -(-total // 2048) * 1.02 + 2
    per_doc = defaultdict(list)
    for r in rows:
        per_doc[r["doc_id"]].append(r)
    if name == "docs":
        for key, parts in per_doc.items():
            parts.sort(key=lambda r: r["piece"])
            assert [r["piece"] for r in parts] == list(range(len(parts))) and sum(r["length"] for r in parts) == len(ids[key])
            assert all(r["length"] == 2048 for r in parts[1:])


def test_added_tokens_are_taken_whole(spark):
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(MERGES)
    texts = ["a<|endoftext|>b", "<|endoftext|>", "", "<|endoftext|><|endoftext|> x", "two  <|endoftext|>\n\nthree <|endoftext|", "plain text", "it<|endoftext|>'s"] * 2
    expected = [loaded.encode(t, add_special_tokens=False).ids for t in texts]
    assert expected[0] == [64, 50256, 65]
    ids, counts = packing._encoder(MERGES).encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == expected
    rows = packing.query(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), MERGES).collect()
    got = {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in rows}
    assert got == {i: (len(x) + 1, zlib.crc32(np.array([*x, 0], "<u4").tobytes())) for i, x in enumerate(expected)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_plan_uses_every_piece_once(lengths):
    counts = np.bincount(np.array(lengths, int), minlength=65)
    used = np.zeros(65, int)
    for held, n in packing.plan(counts, 64):
        assert n > 0 and sum(held) <= 64
        for x in held:
            used[x] += n
    assert (used == counts).all()


def best_fit(counts, size):
    gaps = np.zeros(size + 1, int)
    for x in range(size, 0, -1):
        for _ in range(counts[x]):
            room = np.flatnonzero(gaps[x:])
            gap = size
            if len(room):
                gap = x + int(room[0])
                gaps[gap] -= 1
            gaps[gap - x] += 1
    return gaps.sum()


@pytest.mark.parametrize("hot", [{900: 1000, 500: 1000}, {600: 100, 590: 100}, {600: 99}, {680: 90, 700: 90, 4: 50}, {1000: 300, 40: 300, 350: 70}])
@pytest.mark.parametrize("others", [0, 300])
def test_hot_lengths_are_packed_as_by_best_fit(hot, others):
    counts = np.bincount(np.random.default_rng(5).integers(1, 2049, others), minlength=2049)
    for x, n in hot.items():
        counts[x] += n
    found = packing.plan(counts)
    assert sum(n for _, n in found) <= best_fit(counts, 2048)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=12))
def test_plan_is_never_longer_than_best_fit(hist):
    counts = np.zeros(65, int)
    for x, n in hist.items():
        counts[x] = n
    least = best_fit(counts, 64)
    assert sum(n for _, n in packing.plan(counts, 64)) <= least
    assert sum(n for _, n in packing.best_fit(counts.tolist(), 64)) == least


@pytest.mark.parametrize("hist", [{700: 20, 648: 10}, {900: 20, 248: 10}, {600: 30, 248: 10}])
def test_sums_may_repeat_the_opening_length(hist):
    counts = np.zeros(2049, int)
    for x, n in hist.items():
        counts[x] = n
    found = packing.complements(counts.tolist(), 2048)
    assert sum(n for _, n in found) == 10 and all(sum(held) == 2048 for held, _ in found)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 3), max_size=10), st.lists(st.integers(1, 40), max_size=12))
def test_sums_are_those_at_hand(hist, taken):
    have = [hist.get(x, 0) for x in range(41)]
    sums = packing.Sums(have)
    for x in [0, *taken]:
        have[x] = max(0, have[x] - 1)
        at_hand = [x for x in range(1, 41) for _ in range(have[x])]
        two = {a + b for i, a in enumerate(at_hand) for b in at_hand[:i]}
        three = {a + b + c for i, a in enumerate(at_hand) for j, b in enumerate(at_hand[:i]) for c in at_hand[:j]}
        for total in range(41):
            for found, known in ((sums.pair(total), two), (sums.triple(total), three)):
                assert bool(found) == (total in known) and sum(found) == total * bool(found)
                assert all(have[x] >= found.count(x) for x in found)
            assert sums.longest(total) == max([x for x in at_hand if x <= total], default=0)


def test_plan_of_many_pieces_is_short():
    counts = np.random.default_rng(6).integers(0, 20000, 2049)
    counts[0], counts[500] = 0, 10**7
    found = packing.plan(counts)
    used = sum(n * sum(held) for held, n in found)
    assert len(found) <= 4 * 2048 and used == (counts * np.arange(2049)).sum() and sum(n for _, n in found) <= used / 2048 * 1.02 + 2


def test_exact_complements_fill_sequences():
    counts = np.zeros(65, int)
    counts[[40, 24, 30, 20, 14]] = [3, 3, 5, 5, 5]
    assert sum(n for _, n in packing.plan(counts, 64)) == 8


def test_hot_lengths_are_ranked_in_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 7)
    rows = spark.createDataFrame([(i, 0, 0, 500 if i % 3 else i % 50 + 1) for i in range(600)], "doc_id long, piece int, start long, length long")
    rows = rows.selectExpr("*", "1 AS _salt", "2 AS _rank", "3 AS _place", "4 AS _own0", "5 AS _before", "'x' AS n")
    done = packing.assign(rows, ("doc_id", "piece"))
    assert done.columns == [*rows.columns, "sequence_id", "offset"] and {tuple(r)[4:10] for r in done.collect()} == {(1, 2, 3, 4, 5, "x")}
    done = done.collect()
    places = Counter((r["sequence_id"], r["offset"]) for r in done)
    assert len(done) == 600 and max(places.values()) == 1
