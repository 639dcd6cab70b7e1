import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from townscribe.llm import queries, token_alignment

from .tables import DOC, awkward

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def alphabet():
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, n = {chr(b): b for b in kept}, 0
    for b in range(256):
        if b not in kept:
            table[chr(256 + n)] = b
            n += 1
    return table


LETTERS = alphabet()


def whole_groups(text):
    """Groups of a whole text, tokenised in one piece; None if it has no tokens."""
    if not text:
        return None
    a = A.encode(" " + text, add_special_tokens=False).ids
    b = B.encode(text)
    a_bytes = [bytes(LETTERS[c] for c in A.id_to_token(i)) for i in a]
    b_bytes = [bytes([int(B.id_to_piece(i)[3:-1], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode() for i in b]
    raw = (" " + text).encode()
    if b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
        return None
    ends = []
    for parts in (a_bytes, b_bytes):
        n, own = 0, []
        for x in parts:
            n += len(x)
            own.append(n)
        ends.append(own)
    groups, i, j = [], 0, 0
    for e in sorted(set(ends[0]) & set(ends[1])):
        x, y = ends[0].index(e, i) + 1, ends[1].index(e, j) + 1
        groups.append((a[i:x], b[j:y]))
        i, j = x, y
    return groups


def brute(docs):
    made = [whole_groups(t) for _, t in docs]
    linked = [Counter((x, y) for a, b in g or () for x in a for y in b) for g in made]
    count, best = Counter(p for c in linked for p in c), defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for (d, _), g, c in zip(docs, made, linked, strict=True):
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g or ())
        sums = (sum(len(a) for a, _ in g or ()), sum(len(b) for _, b in g or ()), len(g or ()), sum(c.values()))
        out.append((d, *sums, sum(n for p, n in c.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in c.items()), text))
    return sorted(out, key=str)


def got(spark, docs, **more):
    frame = spark.createDataFrame([(d, t, None, None, None) for d, t in docs], DOC).repartition(3)
    rows = token_alignment.align(frame, **more).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups").collect()
    return sorted(map(tuple, rows), key=str)


ODD = [
    None, "", " ", "  ", "   ", "\n", "\t", "\r\n", "\n\n\n", "a", " a", "a ", " a ", "a  b", "a   \n b", "a\n b\t\tc \n", " ", "a  b", "a  b", "a    b  ", "x᠎ y", "x ᠎y",
    "a　b 　 c", "a\x1c b\x1d\x1e c\x1f", "a\x0b b\x0c\x0cc", "tab\tand;\r\nnext {\r\n", "▁ mark", "in▁side", "<|endoftext|> and <s></s><unk> <0x41>", "it's we'll I'd 'S", "don 't", "123 45 6,7.8", "Ünïcode ẞtraße 🙂🙂 漢字 힣",
    "́ combining é", "x" * 4000, " " * 500, "ab " * 900, "\x00 zero\x00", "…—“q”", "e​ f‍ g", "a b  c\x85 d", "!!!??? ...   ---\n\n   end   ",
]


def test_odd_texts_equal_whole_texts(spark):
    docs = list(enumerate(ODD)) + [(None, "a  b"), (7, "\t")]
    assert got(spark, docs) == brute(docs)


@pytest.mark.parametrize("block_chars", [token_alignment.BLOCK_CHARS, 300])
def test_awkward_rows_in_any_blocks(spark, block_chars):
    docs = [(r[0], r[1]) for r in awkward()]
    assert got(spark, docs, block_chars=block_chars) == brute(docs)


def test_segments_are_independent():
    """Random mixtures of what the tokenizers treat in special ways: joined segments are the whole text."""
    cuts = token_alignment.cut_characters()
    assert cuts == " \t\n"  # B has pieces such as ';' followed by a carriage return
    import re

    split = re.compile(token_alignment.segment_pattern(cuts)).findall
    aligner = token_alignment.Aligner(token_alignment.A_FILE, token_alignment.B_FILE)
    rng = random.Random(7)
    parts = [" ", "  ", "\n", "\t", "\r", " ", "　", "᠎", "\x1c", "\x85", "a", "word", "'s", "'ll", "12", ",", ";", "{", "é", "漢", "🙂", "́", "\x00", "<s>", "_", " "]
    for _ in range(2500):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        segments = split(" " + text)
        assert "".join(segments) == " " + text
        whole = whole_groups(text)
        made = aligner.align(segments)
        assert None not in made
        assert ";".join(made) == ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in whole), repr(text)


def test_each_distinct_segment_is_aligned_once(spark):
    docs = spark.createDataFrame([(i, f"same words {i % 5}", None, None, None) for i in range(200)], DOC).repartition(4)
    table = token_alignment.blocks(docs, token_alignment.cut_characters(), 60)
    listed = table.where("place is not null")
    assert listed.select("segment").distinct().count() == 7 and listed.count() > 50
    plan = token_alignment.aligned_segments(listed)._jdf.queryExecution().toString()
    assert "hashpartitioning(segment" in plan and "BatchEvalPython" not in plan


def test_tables(spark):
    empty = spark.createDataFrame([], DOC)
    assert token_alignment.align(empty).count() == 0
    clash = spark.createDataFrame([("x", "a b", 1, "k"), (None, "a b", 2, None)], "doc_id string, text string, block int, groups string")
    rows = token_alignment.align(clash, digest=True).collect()
    assert {r["doc_id"] for r in rows} == {"x", None} and {r["count_sum"] for r in rows} == {4}
    assert rows[0]["groups"] == hashlib.sha256(brute([(1, "a b")])[0][-1].encode()).hexdigest()


def test_query_equals_brute_force(spark, data):
    import duckdb

    docs = duckdb.sql(f"select doc_id, text from '{data}/documents.parquet'").fetchall()
    rows = queries.QUERIES["op12_token_alignment"](spark, data).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    want = [(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in brute(docs)]
    assert sorted(map(tuple, rows)) == sorted(want)
