import hashlib
import random
import re

import pytest

from prodlake.llm import secrets
from prodlake.session import scratch_path

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")
MORE = [(3, re.compile("-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"), "private_key"), (4, re.compile(r"eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,}", re.A), "web_token")]


def want(text):
    text = text or ""
    spans = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    spans += [(m.start(), 1, m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end(), "hex") for m in HEX.finditer(text) if len(m[0]) >= 16]
    base = sorted(spans)
    spans += [(m.start(), k, m.end(), kind) for k, p, kind in MORE for m in p.finditer(text)]
    spell = lambda found: ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in found)
    n = [sum(s[1] == k for s in base) for k in range(3)]
    return (*n, hashlib.sha256(spell(base).encode()).hexdigest(), spell(sorted(spans)))


def found(docs):
    return sorted(((-1 if r.doc_id is None else r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in secrets.find_secrets(docs).collect())


@pytest.mark.parametrize("name", ["small", "edge", "clashing"])
def test_given_texts(name, request):
    docs = request.getfixturevalue(name)
    assert found(docs) == sorted((-1 if r.doc_id is None else r.doc_id, *want(r.text)) for r in docs.collect())


def test_pieced_texts(spark):
    rng = random.Random(4)
    parts = [
        "password", "PASSWD", "secret", "Token", "api_key", "apikey", "'", '"', " ", "  ", ":", "=", "abcdefghijkl", "AKIA", "ABCDEFGH1234567", "AKIAAKIA",
        "0123456789abcdef", "deadbeef", "é", "日", "𝒳", "\n", "-----BEGIN RSA PRIVATE KEY-----", "eyJabcdefgh.ijklmnop.qrstuvwx", "ſecret", "toKen=", ".", "_-",
    ]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 30))) for _ in range(1500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert found(docs) == sorted((i, *want(t)) for i, t in enumerate(texts))


def test_ledger_scans_what_is_new(spark):
    path = scratch_path(spark, "ledger")
    old = secrets.Ledger(spark, path, secrets.BASE[:1])
    first = spark.createDataFrame([(1, "token: abcdefghijklmnop"), (2, "token: abcdefghijklmnop"), (3, "deadbeefdeadbeef")], "path bigint, content string")
    old.scan(first)
    assert old.scans().count() == 2  # blobs, not paths
    old.scan(first)
    assert old.scans().count() == 2
    more = spark.createDataFrame([(4, "token: abcdefghijklmnop"), (5, "deadbeefdeadbeef0")], "path bigint, content string")
    old.scan(more)
    assert old.scans().count() == 3
    new = secrets.Ledger(spark, path, secrets.BASE)  # two more rules: every blob is scanned for these alone
    new.scan(first.union(more))
    assert [r.rules for r in new.scans().collect()].count(["access@1", "hex@1"]) == 3
    spelled = {(r.path, r.s) for r in new.findings().select("path", secrets.spelled(secrets.F.col("spans")).alias("s")).collect()}
    assert spelled == {(1, "assign:0:23"), (2, "assign:0:23"), (4, "assign:0:23"), (3, "hex:0:16"), (5, "hex:0:17")}


def spelled(ledger):
    return sorted(tuple(r) for r in ledger.findings().select("path", secrets.spelled(secrets.F.col("spans"))).collect())


def test_a_scan_that_is_repeated_adds_nothing(spark, monkeypatch):
    monkeypatch.setattr(secrets, "COPIES", 2)
    ledger = secrets.Ledger(spark, scratch_path(spark, "ledger"), secrets.BASE)
    rows = [(1, "deadbeefdeadbeef"), (2, "deadbeefdeadbeef"), (3, "nothing"), *[(4, "AKIAABCDEFGHIJKLMN1")] * 5, (None, "deadbeefdeadbeef"), (None, None)]
    contents = spark.createDataFrame(rows, "path bigint, content string")
    ledger.scan(contents)
    once = sorted(map(repr, ledger.findings().collect()))
    assert len(once) == len(rows)
    ledger.scan(contents)
    ledger.scan(contents.limit(3))
    assert sorted(map(repr, ledger.findings().collect())) == once
    ledger.scan(spark.createDataFrame([(1, "deadbeefdeadbeef0"), *[(4, "AKIAABCDEFGHIJKLMN1")] * 6], "path bigint, content string"))
    assert len(ledger.findings().collect()) == len(rows) + 2  # a new version of path 1, one copy more of path 4


def test_findings_of_retired_rules_go(spark):
    path = scratch_path(spark, "ledger")
    contents = spark.createDataFrame([(1, "deadbeefdeadbeef token=abcdefghijkl"), (2, "0123456789abcdef0123")], "path bigint, content string")
    secrets.Ledger(spark, path, secrets.BASE).scan(contents)
    longer = secrets.Rule("hex", 2, "[0-9a-f]{20,}")
    ledger = secrets.Ledger(spark, path, (longer, secrets.BASE[0]))
    assert spelled(ledger) == [(1, "assign:17:35"), (2, "")]  # of hex@2 nothing was scanned yet
    ledger.scan(contents)
    assert spelled(ledger) == [(1, "assign:17:35"), (2, "hex:0:20")]
    assert spelled(secrets.Ledger(spark, path, secrets.BASE)) == [(1, "hex:0:16,assign:17:35"), (2, "hex:0:20")]


def test_empty(none):
    assert found(none) == []
