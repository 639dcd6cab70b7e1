import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from townscribe.llm import packing

from .tables import DOC, awkward


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(packing.TOKENIZER, packing.RANKS)


def ids(encoder, text):
    return encoder.tok.encode(text or "", add_special_tokens=False).ids


def test_ranks_give_the_tokenizers_ids(encoder):
    rng = random.Random(4)
    letters = list(" \n\t\r\x0b\x1c\x85\xa0　ab'sltd1.é-²५中🙂́_€")
    texts = ["", None, "a  b", "x<|endoftext|>y", "don't I'LL", "a" * 2000, " " * 999, "tab\there\r\n"] + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    for t in texts:
        assert np.frombuffer(encoder.encode(t), dtype=encoder.kind).tolist() == ids(encoder, t)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 5000), min_size=1, max_size=8), st.integers(1, 64), st.integers(1, 300))
def test_schedule_places_every_token_once(totals, length, window):
    plan = packing.Schedule(totals, length, window)
    taken = []
    for q, t in enumerate(totals):
        got = list(plan.runs(q, 0, t))
        assert sum(n for _, _, n in got) == t and [a for _, a, _ in got] == list(np.cumsum([0, *(n for _, _, n in got)])[:-1])
        taken += [(p, n) for p, _, n in got]
        # any cut of a queue into documents gives the same places
        k = t // 2
        if k:
            halves = [(p, n) for a, n_ in ((0, k), (k, t - k)) for p, _, n in plan.runs(q, a, n_)]
            cells = lambda runs: {p + i for p, n in runs for i in range(n)}
            assert cells(halves) == cells([(p, n) for p, _, n in got])
    taken.sort()
    assert [p for p, _ in taken] == list(np.cumsum([0, *(n for _, n in taken)])[:-1])
    for w in range(plan.windows + 1):  # a deficit is under one token
        exact = np.array(totals) * w / plan.windows
        assert (np.abs(plan.served(w) - exact) < 1).all()


def test_pieces_are_an_exact_round_trip(spark, encoder):
    rows = awkward()
    got = packing.pack(spark.createDataFrame(rows, DOC), length=64, window=512).collect()
    want = Counter((r[0], tuple(ids(encoder, r[1]) + [0])) for r in rows)
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r["doc_id"], r["doc_tokens"]].append(r)
    for (doc, tokens), n in want.items():
        pieces = sorted(by_doc[doc, len(tokens)], key=lambda r: r["start"])
        assert sum(r["length"] for r in pieces) == n * len(tokens)
        for r in pieces:
            part = np.array(tokens[r["start"] : r["start"] + r["length"]], dtype="<u4")
            assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
    assert sum(len(v) for v in by_doc.values()) == len(got)
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    sizes = []
    for v in sequences.values():
        at = 0
        for offset, n in sorted(v):
            assert offset == at
            at += n
        sizes.append(at)
    assert all(s == 64 or s & (s - 1) == 0 for s in sizes) and sum(s != 64 for s in sizes) <= 6


def test_windows_hold_the_mixture(spark):
    rows = [(i, "word " * 400, "en", "hot" if i % 3 == 0 else f"s{i % 5}", 0) for i in range(120)]
    got = packing.pack(spark.createDataFrame(rows, DOC), length=64, window=1024).collect()
    source = {r[0]: r[3] for r in rows}
    total, per = Counter(), defaultdict(Counter)
    for r in got:
        total[source[r["doc_id"]]] += r["length"]
        per[r["sequence_id"] * 64 // 1024][source[r["doc_id"]]] += r["length"]
    whole = sum(total.values())
    for _, window in sorted(per.items())[:-1]:
        for s in total:
            assert abs(window[s] / sum(window.values()) - total[s] / whole) < 0.07


def test_empty_table_and_no_source(spark):
    assert packing.pack(spark.createDataFrame([], DOC)).collect() == []
    got = packing.pack(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["length"], r["doc_tokens"]) for r in got) == [(1, 1, 1), (2, 1, 1)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 3000), st.integers(1, 9)), min_size=1, max_size=6), st.integers(1, 64), st.integers(20, 300))
def test_weighted_schedule(queues, length, window):
    totals, weights = [t for t, _ in queues], [w for _, w in queues]
    plan = packing.Weighted(totals, weights, length, window)
    cells = sorted((p + i, q) for q, t in enumerate(totals) for p, _, n in plan.runs(q, 0, t) for i in range(n))
    assert [p for p, _ in cells] == list(range(sum(totals)))  # every token in one place
    for w in range(plan.windows + 1):
        served = plan.served(w)
        for a, t, x in zip(served, totals, weights):
            for b, u, y in zip(served, totals, weights):
                if a < t and b < u:  # while both have tokens, they are served by weight
                    assert abs(a / x - b / y) <= 1 / x + 1 / y


def test_weights_by_source(spark):
    rows = [(i, "word " * 50, "en", "a" if i % 4 else None, 0) for i in range(80)]
    df = spark.createDataFrame(rows, DOC)
    got = packing.pack(df, length=16, window=160, weights={"a": 1, None: 1}).collect()
    rare = {i for i in range(80) if i % 4 == 0}
    shares = defaultdict(Counter)
    for r in got:
        shares[r["sequence_id"] // 10][r["doc_id"] in rare] += r["length"]
    first = [shares[w] for w in sorted(shares)][:5]
    assert all(abs(c[True] - c[False]) <= 32 for c in first)
    assert sum(r["length"] for r in got) == sum({r["doc_id"]: r["doc_tokens"] for r in got}.values())
    with pytest.raises(ValueError):
        packing.pack(df, weights={"a": 1})


def test_ranks_give_the_tokenizers_ids_on_the_sample_table(spark, data, encoder):
    for (t,) in spark.read.parquet(data.replace("sf0.001", "sf0.01") + "/documents.parquet").select("text").collect():
        assert np.frombuffer(encoder.encode(t), dtype=encoder.kind).tolist() == ids(encoder, t)


def test_extra_columns_and_long_texts(spark):
    df = spark.createDataFrame([(1, "a long text " * 40_000, "en", "s", 0), (2, "b", "en", "s", 0)], DOC)
    clash = df.selectExpr("*", "1 queue", "2 part", "3 place", "4 n", "5 ids", "6 before")
    order = lambda rows: sorted(map(tuple, rows))
    assert order(packing.pack(clash).collect()) == order(packing.pack(df).collect())
