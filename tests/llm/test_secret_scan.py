import hashlib
import re
import time
from collections import defaultdict

from loomline.llm import secret_scan
from tests.llm.cases import DOCUMENTS, documents, rows, with_clashes

BASE = (
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 2, lambda v: len(v) >= 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, lambda v: len(v) >= 20),
    ("hex", re.compile("[0-9a-f]+"), 0, lambda v: len(v) >= 24),
)
KEY = "AKIA" + "Q7Z2" * 5
HEX = "0f1e2d3c4b5a69788796a5b4c3d2e1f0"
WIDE = "Zx81-qLm_4420-ppQ99r"
TEXTS = [
    f"é🙂 password = \"hunter22\" and TOKEN:{HEX} end", f"{KEY} {HEX}{KEY}", "secret=token:abcdefgh", "token=api_key=abcdef passwd : 'short'", "secret = abc token='abcdef'", f"x{HEX[:23]} {HEX[:24]}",
    f"my key {WIDE}", f"copied {WIDE.replace('9', '8')}", f"also copied {WIDE.replace('9', '8')}", f"and {WIDE.replace('9', '8')}", "AKIAAKIAAKIA " + "AKIA" * 6, "API_KEY=\nabcdefgh apikey=   abcdefgh", "wordswithoutdigitsbutverylong", "\n".join(["token=abcdef1"] * 300),
]


def base(text):
    spans = []
    for kind, (name, pattern, group, good) in enumerate(BASE):
        spans += [(m.start(), kind, m.end(), name, m[group]) for m in pattern.finditer(text) if good(m[group])]
    return sorted(spans)


def expected(table):
    """table: (text, owner, repository) rows -> what scan_secrets says of each."""
    wide = re.compile("[A-Za-z0-9_-]{20,}")
    found, owners, repos = [], defaultdict(set), defaultdict(set)
    for text, owner, repo in table:
        spans = base(text)
        more = [(m.start(), 3, m.end(), "owned", m[0]) for m in wide.finditer(text) if re.search("[A-Za-z]", m[0]) and len(re.findall("[0-9]", m[0])) >= 4 and not any(s[0] < m.end() and m.start() < s[2] for s in spans)]
        found.append((spans, more))
        for s in spans + more:
            owners[s[4]].add(owner)
            repos[s[4]].add((owner, repo))
    live = lambda s: len(owners[s[4]]) <= 2 and len(repos[s[4]]) <= 3
    say = lambda spans: ",".join(f"{s[3]}:{s[0]}:{s[2]}" for s in spans)
    out = []
    for spans, more in found:
        owned, n_live = list(filter(live, more)), sum(map(live, spans))
        every = sorted(spans + owned)
        numbers = [",".join(str(len(of[s[4]])) for s in every) for of in (owners, repos)]
        out.append((*[sum(s[1] == k for s in spans) for k in range(3)], hashlib.sha256(say(spans).encode()).hexdigest(), say(every), len(owned), n_live, len(spans) - n_live, *numbers))
    return out


def test_against_plain_python(spark):
    table = [(k, t, "en", f"s{k}", 1) for k, t in enumerate(TEXTS)] + [(100, f"again {HEX}", None, None, 1), *DOCUMENTS]
    # one owner's, in three repositories and in four; two owners'
    table += [(200 + k, f"many {WIDE}{n}x", f"r{k}", "t", 1) for n in (3, 4) for k in range(n)] + [(300 + k, f"two {WIDE}-shared", "en", f"t{k}", 1) for k in range(2)]
    df = with_clashes(documents(spark, table))
    want = [(r[0], *w) for r, w in zip(table, expected([(r[1] or "", r[3] or "", r[2] or "") for r in table]), strict=True)]
    assert rows(secret_scan.scan_secrets(df).drop("span_list")) == sorted(want, key=repr)


def test_redaction(spark):
    table = [(k, t, "en", f"s{k}", 1) for k, t in enumerate(TEXTS)] + DOCUMENTS
    df = with_clashes(documents(spark, table))
    out = secret_scan.redact(df)
    assert out.columns == df.columns and out.count() == len(table)
    texts = {(r.doc_id, r.source): r.text for r in out.collect()}
    assert texts[0, "s0"] == 'é🙂 [assign]" and [assign] end'
    assert texts[2, "s2"] == TEXTS[2] and texts[6, "s6"] == "my key [owned]" and texts[7, "s7"] == TEXTS[7]
    assert texts[13, "s13"] == "\n".join(["[assign]"] * 300)
    assert sorted((r.text or "") for r in out.where("doc_id IS NULL OR lang = 'de' OR n_chars > 1000").collect()) == sorted((t or "") for i, t, lang, _, n in DOCUMENTS if i is None or lang == "de" or (n or 0) > 1000)


def test_empty(spark):
    assert secret_scan.scan_secrets(documents(spark, [])).count() == 0
    assert secret_scan.redact(documents(spark, [])).count() == 0


def test_many_matches_in_one_text(spark):
    texts = ["token=abcdef1 " * 200_000, f"x {WIDE}{{}} " * 50_000, ("token=abcdef1 " + WIDE + " ") * 50_000]
    df = documents(spark, [(k, t, "en", "s", 1) for k, t in enumerate(texts)])
    began = time.monotonic()
    out = {r.doc_id: r for r in secret_scan.scan_secrets(df).collect()}
    clean = {r.doc_id: r.text for r in secret_scan.redact(df).collect()}
    assert time.monotonic() - began < 60
    assert out[0].n_assign == 200_000 and out[0].spans.endswith(f"assign:{14 * 199_999}:{14 * 199_999 + 13}")
    assert out[1].n_owned == 50_000 and out[2].n_assign == out[2].n_owned == 50_000
    assert clean == {0: "[assign] " * 200_000, 1: "x [owned]{} " * 50_000, 2: "[assign] [owned] " * 50_000}
