import hashlib
import random
import re

import pytest

from sylva.llm import secrets

ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)


def base(text):
    text = text or ""
    found = {
        "assign": [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= 8],
        "access": [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16],
        "hex": [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32],
    }
    order = sorted((s, k, f"{name}:{s}:{e}") for k, (name, spans) in enumerate(found.items()) for s, e in spans)
    joined = ",".join(x for *_, x in order)
    return tuple(len(v) for v in found.values()), hashlib.sha256(joined.encode()).hexdigest(), [x for *_, x in order]


def scan(spark, texts):
    frame = spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(texts)], "doc_id long, text string, h int, spans string")
    return {r.doc_id: r for r in secrets.scan(frame).collect()}


def test_base_spans(spark, sf):
    rng = random.Random(7)
    parts = ["password", "Token", "api_key", "APIKEY", "secret", "=", ":", " ", '"', "'", "AKIA", "AKIAKIA", "ABCD1234EFGH", "deadbeef" * 4, "0123456789abcdef", "a1", "x.y-z_9", "é", "ſecret", "user", "https://h.example/x", "\n", "==", "tokens"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(1500)]
    texts += [None, "", "token: secret: abcdefgh1", "secret=abcdefg", "secret=abcdefgh", "AKIA" + "A" * 11, "AKIA" + "A" * 12, "f" * 31 + "g" + "f" * 32, "password = 12345678 " * 5000]
    texts += [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = scan(spark, texts)
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        counts, digest, spans = base(t)
        assert (got[k].n_assign, got[k].n_access, got[k].n_hex, got[k].base_sha256) == (*counts, digest), t
        assert set(spans) <= set(got[k].spans.split(",") if got[k].spans else [])


def test_weak_parts_need_each_other(spark):
    far = " " * 300
    got = scan(spark, ["user=bob token=abc12", f"user=bob {far} token=abc12", "user=bob", "token=abc12", "https://db.example/ and secret: longenough99", "https://db.example/", "AKIAABCDEF and 0123456789abcdef"])
    assert [got[k].spans for k in range(7)] == ["ident:0:8,weak_assign:9:20", "", "", "", "endpoint:0:19,assign:24:44", "", "weak_access:0:10,weak_hex:15:31"]
    assert all(got[k].n_assign == (k == 4) for k in range(7))


def test_repeats_nulls_and_empty_table(spark):
    rows = [(1, "token=abcdefgh"), (1, "token=abcdefgh"), (1, "other"), (None, "token=abcdefgh"), (None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_assign) for r in secrets.scan(frame).collect()) == [("1", 0), ("1", 1), ("1", 1), ("None", 0), ("None", 1)]
    assert secrets.scan(frame.limit(0)).collect() == []
    plan = secrets.scan(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def every(text):
    """All spans that are reported, by all pairs."""
    text, found = text or "", []
    for number, (name, pattern, _, least, strong, part) in enumerate(secrets.KINDS):
        for m in re.finditer(pattern, text, re.ASCII):
            n = len(m[2] if name == "assign" else m[0])
            if n >= least:
                found.append((m.start(), strong is None or n < strong, number, m.end(), name, part))
    out = []
    for s in found:
        near = any((o[5] == "secret") != (s[5] == "secret") and o[0] <= s[3] + secrets.SCOPE and s[0] <= o[3] + secrets.SCOPE for o in found)
        if not s[1] or near:
            label = s[4] if not s[1] or s[4] in ("ident", "endpoint") else f"weak_{s[4]}"
            out.append((s[0], s[1], s[2], f"{label}:{s[0]}:{s[3]}"))
    return ",".join(x[3] for x in sorted(out))


@pytest.mark.parametrize("stretch", [1 << 16, 64])
def test_linking_by_brute_force(spark, monkeypatch, stretch):
    monkeypatch.setattr(secrets, "STRETCH", stretch)
    rng = random.Random(stretch)
    parts = ["user=bob", "token=abc12", "https://db.example/" + "p" * 230, "https://h/x", "AKIAABCDEF", "0123456789abcdef", "secret: longenough99", "login: éva", "password=" + "q" * 400, "AKIA" + "Z" * 20]
    gaps = [1, 5, 60, 150, 198, 199, 200, 201, 202, 260, 700]
    texts = ["".join(rng.choice(parts) + " " + "é" * (rng.choice(gaps) - 1) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    endpoint = "https://h.example/" + "p" * 230
    texts += [endpoint + " token=abc12", "token=abc12 " + endpoint, "token=abc12 " + " " * 187 + endpoint]
    texts += ["token=abc12" + " " * k + "user=bob" for k in (199, 200, 201)] + ["user=bob" + " " * k + "token=abc12" for k in (199, 200, 201)]
    texts.append("".join(rng.choice(parts) + " " + "x " * rng.choice([1, 90, 400]) for _ in range(4000)))
    got = scan(spark, texts)
    for k, t in enumerate(texts):
        assert got[k].spans == every(t), t[:300]
