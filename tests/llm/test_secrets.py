import random
import re

import numpy as np
from xylem.llm.queries import op1_secrets
from xylem.llm.secrets import BASE, compile_rules, find, scan_secrets

BRUTE = {
    "assign": (re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 16),
}


def brute(text):
    out = []
    for i, k in enumerate(BASE):
        rx, ok = BRUTE[k]
        out += [(m.start(), i, m.end()) for m in rx.finditer(text) if ok(m)]
    return sorted(out)


def random_text(rng):
    bits = ["token", "PassWord", "passwd", "secret", "api_key", "APIKEY", "api", "=", ":", " ", "  ", '"', "'", "abc", "Zz9", "AKIA", "AKIAIOSFODNN7", "EXAMPLE", "0123", "deadbeef", "cafe01", "é", "日本", "\n", ",", ".", "x" * 9, "a" * 14, "AKI", "=="]
    return "".join(rng.choice(bits) for _ in range(rng.randrange(60)))


def test_spans_equal_brute_force():
    rng, scanner = random.Random(5), compile_rules()
    texts = [random_text(rng) for _ in range(4000)] + ["", "a" * 3000, "token=" + "A" * 5000, "api_key : 'x", "0" * 15, "0" * 16]
    raw = [t.encode() for t in texts]
    at = np.cumsum([0, *map(len, raw)]).astype(np.int64)
    got = find(scanner, np.frombuffer(b"".join(raw), np.uint8), at)
    for i, t in enumerate(texts):
        want = [(len(t[:s].encode()), k, len(t[:e].encode())) for s, k, e in brute(t)]
        assert [x for x in got.get(i, []) if x[1] < 3] == want, t


def test_added_kinds_and_edges(spark):
    long = "x y\n" * 200_000 + "ghp_" + "a1B2" * 9 + " -----BEGIN RSA PRIVATE KEY-----"
    rows = [(1, None, "q"), (2, "", "q"), (3, long, "q"), (None, "AKIA" + "A" * 14, "q"), (4, "é" * 5 + "0123456789abcdef", "q"), (4, "é" * 5 + "0123456789abcdef", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted(((r.doc_id, [tuple(s) for s in r.spans]) for r in scan_secrets(df).collect()), key=str)
    assert got == sorted([(1, []), (2, []), (3, [("github", 800_000, 800_040), ("private_key", 800_041, 800_072)]), (None, [("access", 0, 18)]), (4, [("hex", 5, 21)]), (4, [("hex", 5, 21)])], key=str)
    assert scan_secrets(df.limit(0)).count() == 0


def test_query(spark, sf):
    import hashlib

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op1_secrets(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        spans = brute(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{BASE[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in spans) for i in range(3)]


def test_time_follows_the_number_of_matches():
    import time

    scanner, one = compile_rules(), b"token=" + b"Ab9" * 6 + b" password: 'zzzzzzzzzzzzz' x "
    took = []
    for n in (10_000, 80_000):
        raw = one * n
        began = time.process_time()
        found = find(scanner, np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        took.append(time.process_time() - began)
        assert len(found[0]) == 2 * n
    assert took[1] < 20 * took[0]
