import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from loomline.llm import conversation_repair as repair
from loomline.llm import queries
from tests.llm.cases import with_clashes

SCHEMA = "conv_id long, turn long, role string, text string"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def faults(rows):
    """Sorted rows of one conversation with their fault."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, out = set(), []
    for turn, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((turn, role, text, fault))
    return out


def cheapest(rows):
    """(cost, audit, repaired) over all sequences of edits with two insertions at most in a place."""
    best = None
    inserts = [(), ("u",), ("a",), ("u", "a"), ("a", "u")]
    for edits in itertools.product("KRD", repeat=len(rows)):
        if any(e != "D" and r[3] in ("blank", "duplicate") for e, r in zip(edits, rows, strict=True)):
            continue
        for new_roles in itertools.product(*[("u", "a") if e == "R" else ("",) for e in edits]):
            base, parts = 0, []
            for e, role, r in zip(edits, new_roles, rows, strict=True):
                base += {"K": 0, "R": 3, "D": 4}[e] + (3 if e != "D" and r[3] == "truncated" else 0)
                parts.append((e, r[1][:1] or "?" if e == "K" else role, {"K": r[1], "R": {"u": "user", "a": "assistant"}.get(role), "D": None}[e], r[2]))
            if best and base > best[0]:
                continue
            for places in itertools.product(inserts, repeat=len(rows) + 1):
                cost = base + 3 * sum(map(len, places))
                if best and cost > best[0]:
                    continue
                audit, initials, said = "", "", []
                for k, place in enumerate(places):
                    for x in place:
                        audit, initials = audit + "I", initials + x
                        said.append({"u": "user", "a": "assistant"}[x] + ":")
                    if k < len(parts):
                        e, x, role, text = parts[k]
                        audit += e
                        if e != "D":
                            initials += x
                            said.append(f"{role}:{text}")
                if GRAMMAR.fullmatch(initials) and (best is None or (cost, audit) < best[:2]):
                    best = (cost, audit, "\n".join(said))
    return best


def told(rows):
    """What the summary says besides the repair."""
    known = [r[0] for r in rows if r[0] is not None]
    initials = [r[1][:1] or "?" for r in rows]
    count = lambda f: sum(r[3] == f for r in rows)
    illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:], strict=False))
    return (max(known) - min(known) + 1 - len(set(known)) if known else 0, count("blank"), count("duplicate"), count("truncated"), illegal)


def run(df, **how):
    out = repair.repair(df, conversation=F.col("conv_id"), turn=F.col("turn"), role=F.col("role"), text=F.col("text"), **how)
    return {r.conversation: tuple(r)[1:] for r in out.summary.join(out.digests(), "conversation").select("conversation", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "sha256").collect()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def conversations(n, most, seed):
    """Random conversations with nulls, ties, repeats and strange roles."""
    pick = random.Random(seed)
    out = []
    for conv in range(n):
        for _ in range(pick.randint(1, most)):
            out.append((None if conv == 0 else conv, pick.choice([None, *range(6)]), pick.choice(["user", "assistant", "system", "tool", None, ""]), pick.choice(["Yes.", "No!", "so", " ", None, "", "é?\n", "a"])))
    return out


def grouped(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault("" if conv is None else f"={conv}", []).append((turn, " " if role is None else role, " " if text is None else text))
    return {k: faults(v) for k, v in by.items()}


def test_against_all_edits(spark):
    rows = conversations(60, 3, 5) + [(99, k, r, "ok.") for k, r in enumerate(("assistant", "user", "user", "assistant"))]
    got = run(with_clashes(spark.createDataFrame(rows, SCHEMA)))
    want = {k: (*told(v), *cheapest(v)) for k, v in grouped(rows).items()}
    assert got == {k: (*w[:-1], sha(w[-1])) for k, w in want.items()}


@pytest.mark.parametrize("block_rows,block_bytes", [(1, 1 << 20), (3, 1 << 20), (1000, 20)])
def test_blocks_change_nothing(spark, block_rows, block_bytes):
    pick = random.Random(9)
    rows = conversations(30, 12, 8) + [(500, k, pick.choice(["user", "assistant", "system"]), pick.choice(["Yes.", "no", "", f"{k}!", f"{k}?", f"{k}."])) for k in range(400)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert run(df, block_rows=block_rows, block_bytes=block_bytes) == run(df)


def test_one_conversation_over_many_partitions(spark):
    rows = [(1, k // 2, ("user", "assistant")[k % 2] if k % 7 else "system", "x" * 50 + str(k) + ".") for k in range(600)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = run(spark.createDataFrame(rows, SCHEMA), block_rows=64)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    whole = grouped(rows)["=1"]
    paths = repair.compose(tuple((r[1][:1], {"truncated": "t", None: "g"}.get(r[3], "x")) for r in whole), True, repair.DIALOGUE, repair.Costs(), ("a", "u"))
    cost, edits, roles = min(p[2:] for p in paths if p[1] in (0, 3))
    said = repair.applied([r[1] for r in whole], [r[2] for r in whole], edits, roles, repair.ROLES)
    assert got == {"=1": (*told(whole), cost, edits, sha("\n".join(f"{r}:{t}" for r, t in said)))}


def test_very_long_texts_and_repeats(spark):
    rows = [(1, 0, "user", "word " * 300_000 + "end.")] * 3 + [(1, 1, "assistant", "Fine.")]
    got = run(spark.createDataFrame(rows, SCHEMA))
    assert got == {"=1": (0, 0, 2, 0, 2, 8, "KDDK", sha("user:" + "word " * 300_000 + "end.\nassistant:Fine."))}


def test_other_grammar(spark):
    ask_only = repair.Grammar(((0, "u", 0),), (0,))
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Hm."), (1, 2, "tool", "x")]
    got = run(spark.createDataFrame(rows, SCHEMA), grammar=ask_only, costs=repair.Costs(rerole=1, delete=5), roles={"u": "user"})
    assert got["=1"][4:7] == (2, 5, "KRR")


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert run(spark.createDataFrame([], SCHEMA)) == {} and queries.op11_conversation_repair(spark, str(tmp_path)).count() == 0


def test_the_query(spark, tmp_path):
    rows = conversations(120, 2, 3)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    damaged = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        damaged += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    want = {k: (*told(v), *cheapest(v)) for k, v in grouped(damaged).items()}
    out = queries.op11_conversation_repair(spark, str(tmp_path)).collect()
    got = {"" if r.conv_id is None else f"={r.conv_id}": (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in out}
    every = {"" if r[0] is None else f"={r[0]}" for r in rows}
    assert set(got) == every and len(out) == len(every)
    for k, v in got.items():
        w = want.get(k, (0, 0, 0, 0, 0, 0, "", ""))
        assert v == (*w[:-1], sha(w[-1])), k
