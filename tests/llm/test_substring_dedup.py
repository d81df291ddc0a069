import hashlib
import random
import re

import pytest

from loomline.llm import substring_dedup as sub
from tests.llm.cases import DOCUMENTS, documents, with_clashes


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def expected(rows, width):
    """(doc_id, n_words, n_removed, sha256 of the rest) of each row, over all windows."""
    first = {}
    for doc_id, text, *_ in rows:
        words = words_of(text)
        for k in range(len(words) - width + 1):
            key = tuple(words[k : k + width])
            at = sub.MISSING if doc_id is None else doc_id
            first[key] = min(first.get(key, at), at)
    out = []
    for doc_id, text, *_ in rows:
        words = words_of(text)
        mine = sub.MISSING if doc_id is None else doc_id
        gone = set()
        for k in range(len(words) - width + 1):
            if first[tuple(words[k : k + width])] < mine:
                gone |= set(range(k, k + width))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((doc_id, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def shown(out):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out.documents.collect()), key=repr)


def passages(n, seed, vocabulary=6, passages=12):
    """Documents made of shared passages and noise, some of them copies."""
    pick = random.Random(seed)
    noise = lambda k: " ".join(f"w{pick.randrange(vocabulary)}" for _ in range(k))
    shared = [noise(pick.randint(5, 40)) for _ in range(passages)]
    out = []
    for doc_id in range(n):
        if out and pick.random() < 0.2:
            text = pick.choice(out)[1]
        else:
            text = "\n".join(pick.choice(shared) if pick.random() < 0.7 else noise(pick.randint(1, 20)) for _ in range(pick.randint(0, 6)))
        out.append((doc_id, text, "en", "s", 1))
    pick.shuffle(out)
    return out


@pytest.mark.parametrize("width,bucket_bytes", [(5, 2000), (13, 1 << 20)])
def test_against_all_windows(spark, width, bucket_bytes):
    rows = passages(150, width) + [(1000 + k, *r[1:]) for k, r in enumerate(DOCUMENTS)] + DOCUMENTS[-5:]
    out = sub.substring_dedup(with_clashes(documents(spark, rows).repartition(6)), width=width, bucket_bytes=bucket_bytes)
    assert shown(out) == expected(rows, width)


def test_long_passage_planted(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(k, " ".join(f"d{k}x{j}" for j in range(30)) + " " + passage + " " + " ".join(f"e{k}x{j}" for j in range(k)), "en", "s", 1) for k in range(200)]
    out = sub.substring_dedup(documents(spark, rows), keep_texts=True)
    got = {r.doc_id: r for r in out.documents.collect()}
    assert got[0].n_removed == 0 and all(got[k].n_removed == 60 and "p5" not in got[k].kept.split() for k in range(1, 200))
    (path,) = out.paths.collect()
    assert (path.source_id, path.source_start, path.n_words, path.words) == (0, 30, 60, passage)
    assert {(r.doc_id, r.start, r.n_words, r.source_id, r.source_start, *r.paths) for r in out.spans.collect()} == {(k, 30, 60, 0, 30, path.path) for k in range(1, 200)}


def text(*letters):
    """Each letter stands for 20 words of its own."""
    return " ".join(f"{x}{k}" for x in letters for k in range(20))


def test_paths_branch_and_join(spark):
    # A and B, then B and C, follow each other only so: one path over two sources. D and E share their beginning with each other.
    rows = [(1, text("a", "b", "x"), "", "", 1), (2, text("a", "b", "c", "y"), "", "", 1), (3, text("z", "b", "c"), "", "", 1), (4, text("d", "e", "f"), "", "", 1), (5, text("d", "e"), "", "", 1), (6, text("d", "g"), "", "", 1), (7, text("d", "g"), "", "", 1)]
    out = sub.substring_dedup(documents(spark, rows))
    assert shown(out) == expected(rows, 13)
    by_path = {}
    for r in sorted(out.paths.collect(), key=lambda r: (r.path, r.place)):
        by_path.setdefault(r.path, []).append((r.source_id, r.words.split()[0], r.words.split()[-1]))
    assert sorted(by_path.values()) == sorted([[(1, "a0", "b19"), (2, "b8", "c19")], [(4, "d0", "d19"), ], [(4, "d8", "e19")], [(6, "d8", "g19")]])


def test_a_ring(spark):
    # every edge follows another one round: a0 ... a29 a0 ... again and again, begun elsewhere in each document
    rows = [(k, " ".join(f"a{(7 * k + j) % 30}" for j in range(25 + 13 * (k % 3))), "", "", 1) for k in range(12)]
    out = sub.substring_dedup(documents(spark, rows))
    assert shown(out) == expected(rows, 13)
    parts = out.paths.collect()
    assert len({r.path for r in parts}) == 1 and sorted(r.place for r in parts) == list(range(len(parts)))


def test_hashes_that_collide_are_found_out(spark):
    rows = [(k, " ".join(f"u{k}x{j}" for j in range(400)), "", "", 1) for k in range(20)]
    got = shown(sub.substring_dedup(documents(spark, rows), bits=10))
    assert got == expected(rows, 13)


def test_very_long_text_in_parts(spark, monkeypatch):
    monkeypatch.setattr(sub, "AT_ONCE", 100)
    words = [[f"w{k % 997}".encode() for k in range(1234)], [b"x"] * 13, [b"y"] * 12]
    parts = {}
    for k, h in sub.window_hashes(words, sub.Naming(13)):
        parts.setdefault(k, []).extend(h.tolist())
    monkeypatch.setattr(sub, "AT_ONCE", 1 << 17)
    whole = {k: h.tolist() for k, h in sub.window_hashes(words, sub.Naming(13))}
    assert parts == whole and sorted(whole) == [0, 1] and len(whole[0]) == 1222


def test_repeats_nulls_and_empty(spark):
    long_text = text("q", "r")
    rows = [(None, long_text, None, None, None), (None, long_text, "x", None, None), (5, long_text, "", "", 1), (5, long_text, "", "", 1), (5, text("q"), "", "", 1), (6, None, "", "", 0), (7, "", "", "", 0)]
    assert shown(sub.substring_dedup(documents(spark, rows))) == expected(rows, 13)
    assert shown(sub.substring_dedup(documents(spark, []))) == []
