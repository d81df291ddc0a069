import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from loomline.llm import merkle, queries
from tests.llm.cases import DOCUMENTS, documents, with_clashes


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(row):
    doc_id, text, lang, source, n_chars = row
    return sha(*[framed(v) for v in (doc_id, source, lang, n_chars, text)])


def up(nodes, fan_out):
    """All levels of a tree."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][k : k + fan_out]) for k in range(0, len(levels[-1]), fan_out)])
    return levels


def path(levels, at, fan_out):
    out = []
    for nodes in levels[:-1]:
        first = at - at % fan_out
        run = nodes[first : first + fan_out]
        out.append(("".join(run[: at - first]), "".join(run[at - first + 1 :])))
        at //= fan_out
    return out


def expected(rows, fan_out=2):
    """(doc_id, leaf, subroot, root, proof) of every row, over whole trees."""
    groups = {}
    for row in rows:
        groups.setdefault((row[2] is not None, (row[2] or "").encode()), []).append(row)
    trees = []
    for key in sorted(groups):
        inside = sorted(groups[key], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees.append((inside, up([leaf_of(r) for r in inside], fan_out)))
    top = up([levels[-1][0] for _, levels in trees], fan_out) if trees else []
    out = []
    for g, (inside, levels) in enumerate(trees):
        out += [(r[0], leaf_of(r), levels[-1][0], top[-1][0], path(levels, k, fan_out) + path(top, g, fan_out)) for k, r in enumerate(inside)]
    return out


def shown(rows):
    return sorted((r.doc_id, r.leaf, r.subroot, r.root, [(x.before, x.after) for x in r.proof]) for r in rows)


def run(df, **how):
    cells = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    return merkle.manifest(df, merkle.leaf_digest(*cells), group_col="lang", order_cols=["doc_id"], **how)


def null_first(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


@pytest.mark.parametrize("fan_out,levels", [(2, 1), (2, 3), (3, 2), (2, 10)])
def test_every_row_against_whole_trees(spark, fan_out, levels):
    rows = DOCUMENTS + [(100 + k, f"text {k}", ("en", "zz", "Z", "é")[k % 4 if k < 40 else 0], None, k) for k in range(90)]
    got = run(with_clashes(documents(spark, rows).repartition(7)), fan_out=fan_out, block_levels=levels).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, [(x.before, x.after) for x in r.proof]) for r in got), key=key) == sorted(expected(rows, fan_out), key=key)


@pytest.mark.parametrize("n", [1, 2, 5, 16, 17])
def test_sizes_of_one_group(spark, n):
    rows = [(k, f"t{k}", None, "s", 1) for k in range(n)]
    got = run(documents(spark, rows), block_levels=2).withColumn("folded", merkle.fold(F.col("leaf"), F.col("proof"))).collect()
    assert shown(got) == sorted(expected(rows)) and all(r.folded == r.root for r in got)


def test_empty(spark):
    out = run(documents(spark, []))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof"] and out.count() == 0


def test_the_query(spark, tmp_path):
    rows = DOCUMENTS + [(50 + k, f"text {k}", ("en", "de")[k % 2], "s", None if k % 3 else k) for k in range(60)]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_merkle(spark, str(tmp_path)).collect()
    want = {}
    by_leaf = {leaf_of(r): r for r in rows}
    for doc_id, leaf, subroot, root, proof in expected(rows):
        row = by_leaf[leaf]
        bad = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
        node = leaf_of((*row[:4], row[4] + 1)) if bad and row[4] is not None else leaf
        for before, after in proof:
            node = sha(before, node, after)
        want.setdefault((doc_id, leaf), []).append((subroot, root, sha(*[b + a for b, a in proof]), node, node == root))
    have = {}
    for r in got:
        have.setdefault((r.doc_id, r.leaf), []).append((r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    assert any(not r.verified for r in got)
