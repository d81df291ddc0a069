import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomline.llm import packing, pretokens, queries
from tests.llm.cases import DOCUMENTS, documents, with_clashes

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, out, room=1024):
    tokenizer = Tokenizer.from_file(PATH)
    ids = [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for _, t in rows]
    want = defaultdict(int)
    for (doc_id, _), x in zip(rows, ids, strict=True):
        for at in range(0, len(x), room):
            want[doc_id, at, len(x[at : at + room]), zlib.crc32(x[at : at + room].tobytes()), len(x)] += 1
    got = defaultdict(int)
    sequences = defaultdict(list)
    for r in out:
        got[r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens] += 1
        sequences[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= room
    return sequences


def test_edge_documents(spark):
    rows = [(r[0], r[1]) for r in DOCUMENTS] + [(50, "<|endoftext|> is a token here"), (51, "don't   we'll\n\n")]
    df = with_clashes(documents(spark, [(i, t, "en", "s", 1) for i, t in rows]))
    check(rows, packing.pack_documents(df, PATH, group_docs=4).collect())


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from([*map(chr, range(256)), *" '  \n\nsrevdltmAB12"]), max_size=30))
def test_the_split_of_the_first_256_characters(text):
    tokenizer = packing.tokenizer(PATH, 0)
    assert np.frombuffer(next(iter(tokenizer.encode_batch([text]))), "<u4").tolist() == [*tokenizer.tokenizer.encode(text, add_special_tokens=False).ids, 0]
    assert pretokens.LATIN(text) == pretokens.Splitter(pretokens.BYTE_LEVEL).any(text)


def test_whole_table_with_little_padding(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    sequences = check(rows, queries.op3_packing(spark, small).collect())
    used = [sum(length for _, length in p) for p in sequences.values()]
    assert sum(1024 - u for u in used if u & (u - 1)) <= 0.02 * sum(used)


def test_empty(spark):
    assert packing.pack_documents(documents(spark, []), PATH).count() == 0


@given(st.lists(st.integers(1, 64), max_size=60))
def test_first_fit_decreasing_is_the_plain_one(lengths):
    bins, offsets = packing.first_fit_decreasing(lengths, 64)
    free, want = [], {}
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        at = next((i for i, f in enumerate(free) if f >= lengths[k]), len(free))
        if at == len(free):
            free.append(64)
        want[k] = (at, 64 - free[at])
        free[at] -= lengths[k]
    assert {k: (int(bins[k]), int(offsets[k])) for k in want} == want
