import hashlib
from collections import defaultdict

import pytest

from sylva.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, name string, part int"


def brute(rows, size):
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is None, t or 0, r or "unknown", hashlib.md5((x or "").encode()).hexdigest(), x or ""))
    out = []
    for c, ms in by.items():
        ms.sort()
        for who in {m[2] for m in ms} - {"system"}:
            whole, spans, starts = "", [], []
            for *_, r, _, x in ms:
                starts.append(len(whole))
                whole += "<|assistant|>\n" if r == who else "<|system|>\n" if r == "system" else f"<|user:{r}|>\n"
                spans.append((len(whole), len(whole) + len(x)) if r == who else None)
                whole += x + "\n"
            starts.append(len(whole))
            for part in range(0, len(ms), size):
                end = min(len(ms), part + size)
                mask = [s for s in spans[part:end] if s]
                out.append((str(c), who, part // size, starts[part], end - part, len(mask), whole[starts[part] : starts[end]], ",".join(f"{a}-{b}" for a, b in mask)))
    return sorted(out)


@pytest.mark.parametrize("size", [1, 2, 7, chat.WHOLE])
def test_perspectives(spark, size):
    rows = [(1, 0, "system", "s"), (1, 1, "ann", "hé"), (1, 2, "bob", ""), (1, 3, "ann", None), (1, 3, "ann", None), (1, 3, "cid", "tie"), (1, None, "bob", "no turn"), (2, 5, None, "who"), (2, 6, "ann", "x" * 50_000)]
    rows += [(3, 0, "system", "alone"), (None, 0, "a", "null id"), (None, 1, "b", "null id")] + [(4, k, "ab"[k % 2], f"t{k}") for k in range(150)]
    rows += [(5, None, "a", "same")] * 23 + [(5, 1, "b", "same")] * 9 + [(5, 1, "a", f"m{k}") for k in range(20)]
    got = chat.rotate(spark.createDataFrame([(*r, "clash", 3) for r in rows], SCHEMA), whole=size).collect()
    assert sorted((str(r.conv_id), r.assistant, r.part, r.start, r.n_messages, r.n_masked, r.rendered, r["mask"]) for r in got) == brute(rows, size)


def test_a_dialogue_is_one_row(spark, sf):
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    longest = table.groupBy("conv_id").count().agg({"count": "max"}).first()[0]
    got = chat.rotate(table).collect()
    assert longest <= chat.WHOLE and {(r.part, r.start) for r in got} == {(0, 0)}


def test_empty(spark):
    assert chat.rotate(spark.createDataFrame([], SCHEMA)).collect() == []


def test_plan_has_no_python(spark, sf):
    plan = chat.rotate(spark.read.parquet(f"{sf}/conversations.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
