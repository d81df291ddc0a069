import base64
import hashlib

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from loomline.llm import bpe, queries
from tests.llm.cases import DOCUMENTS, documents, with_clashes

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


def ids(engine, texts):
    return [np.frombuffer(x, "<u4").tolist() for x in engine.encode_batch(texts)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab eEé\n\t'sto1日🙂 \x00!"), max_size=200), max_size=5))
def test_as_the_library(texts):
    engine = bpe.encoder(PATH, PATTERN)
    assert ids(engine, texts) == [LIBRARY.encode_ordinary(t) for t in texts]


def test_long_pieces_and_both_trees():
    engine = bpe.encoder(PATH, PATTERN)
    texts = ["the" * 2000, "x" * 5000 + "y", "ab" * 700 + "!" * 300, "<|endoftext|>", ""]
    assert ids(engine, texts) == [LIBRARY.encode_ordinary(t) for t in texts]
    pieces = [("abcde" * k).encode() for k in range(1, 60)]
    for piece, found in zip(pieces, engine.vocabulary._merge_trees(pieces, 512), strict=True):
        assert found.tolist() == engine.vocabulary._merge_tree(piece, 512).tolist()


def test_a_small_memory_changes_nothing():
    engine = bpe.Encoder(bpe.encoder(PATH, PATTERN).vocabulary, remember=2, short=3, together=10)
    texts = ["some words here and there", "some other words", "", "words"]
    assert ids(engine, texts) == [LIBRARY.encode_ordinary(t) for t in texts]


def test_tables(spark, small):
    df = with_clashes(documents(spark))
    out = bpe.encode_table(df, PATH, PATTERN).collect()
    assert len(out) == len(DOCUMENTS)
    assert sorted(bytes(r.decoded).decode() for r in out) == sorted(t or "" for _, t, *_ in DOCUMENTS)
    assert bpe.digest_table(documents(spark, []), PATH, PATTERN).count() == 0
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in queries.op6_bpe(spark, small).collect():
        want = LIBRARY.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(want) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_ids_of_any_name(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (None, None, "y")], "`doc id` long, `the text` string, ids string")
    out = bpe.digest_table(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, id_col="doc id", text_col="the text")
    assert out.columns[0] == "doc id" and {(r[0], r.n_tokens) for r in out.collect()} == {(1, 2), (None, 0)}
