import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sylva.llm import entry, toxicity


def edits(a, b):
    """Levenshtein distance, two neighbours swapped being one edit."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            best = min(new[-1] + 1, rows[-1][j] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, rows[-2][j - 2] + 1)
            new.append(best)
        rows.append(new)
    return rows[-1][-1]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=8), min_size=1, max_size=8, unique=True), st.text("abc", max_size=9))
def test_automata_match_brute_force(terms, word):
    lexicon = toxicity.Lexicon(dict.fromkeys(terms, 2.0))
    near = [edits(t, word) for t in terms if t == word or len(t) >= toxicity.FUZZY_LENGTH and edits(t, word) <= 1]
    found = lexicon.match(word)
    assert (found is None) == (not near)
    assert found is None or (found[1] == min(near) == edits(found[0], word) and found[2] == (2.0 if not found[1] else 2.0 * toxicity.FUZZY_CREDIT))


def plainly(lexicon, text):
    """Contexts and features by positions, without automata or windows of spans."""
    low = text.lower()
    spans = [m.span() for m in re.finditer(r"[^\W_]+", low)]
    words = [low[a:b] for a, b in spans]
    meant, said, out, told = {}, {}, [], 0
    for i, w in enumerate(words):
        near = [(edits(t, w), -v, t) for t, v in lexicon.weights.items() if t == w or len(t) >= toxicity.FUZZY_LENGTH and abs(len(t) - len(w)) < 2 and edits(t, w) <= 1]
        if not near:
            continue
        e, v, t = min(near)
        credit = -v * (toxicity.FUZZY_CREDIT if e else 1)
        first, last = max(0, i - toxicity.WINDOW), min(len(words) - 1, i + toxicity.WINDOW)
        before = [c for c in low[max(0, spans[first][0] - 1) : spans[i][0]] if c in "\"“”„«»‘’‚"]
        after = [c for c in low[spans[i][1] : spans[last][1] + 1] if c in "\"“”„«»‘’‚"]
        inside = bool(before and after) and after[0] in toxicity.QUOTES.get(before[-1], "")
        if inside and before[-1] == '"':
            inside = low[: spans[i][0]].split("\n")[-1].count('"') % 2 == 1
        if inside or set(words[first:i]) & toxicity.SAYING:
            said[t] = max(said.get(t, 0), credit)
            out.append((w, t, e, "quotation"))
            continue
        direct = bool(set(words[first : last + 1]) & toxicity.SECOND_PERSON)
        told += direct
        meant[t] = max(meant.get(t, (0, 0)), (credit, -e))
        out.append((w, t, e, "address" if direct else "plain"))
    if not out:
        return [1.0, *[0.0] * 8, np.log1p(len(words))], []
    worth = [c for c, _ in meant.values()]
    n = sum(c != "quotation" for *_, c in out)
    wrong = sum(e < 0 for _, e in meant.values())
    return [1.0, float(bool(worth)), np.log1p(len(worth)), np.log1p(sum(worth)), max(worth, default=0) / 5, wrong / max(1, len(worth)), np.sqrt(n / len(words)), np.log1p(sum(said.values())), told / max(1, n), np.log1p(len(words))], out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["idiot", "idoit", "scum", "scun", "clown", "clwn", "you", "said", "le", '"', "“", "”", "«", "»", "\n", "x", "it's", "du"]), max_size=60), st.sampled_from([" ", ""]))
def test_windows_and_score_by_brute_force(parts, gap):
    lexicon = toxicity.Lexicon({"idiot": 3.0, "scum": 2.5, "clown": 1.0})
    text = " ".join(parts) if gap else "".join(p if p in '"“”«»\n' else f" {p} " for p in parts)
    x, hits = lexicon.features(text)
    y, expected = plainly(lexicon, text)
    assert hits == expected and np.allclose(x, y)
    model = toxicity.Model(lexicon, np.linspace(-1, 1, len(toxicity.FEATURES)))
    assert abs(model.score(text)[0] - 1 / (1 + np.exp(-np.dot(y, model.weights)))) < 1e-12


@settings(max_examples=200, deadline=None)
@given(st.text("abcdexz", min_size=5, max_size=9), st.integers(0, 50))
def test_misspellings_are_one_edit(word, seed):
    assert edits(word, toxicity.misspelt(word, seed)) <= 1


def test_context_separates_quotation_from_address():
    lexicon = toxicity.Lexicon({"idiot": 3.0})
    kinds = lambda t: [c for *_, c in lexicon.features(t)[1]]
    assert kinds('he was named "the idiot of town" there') == ["quotation"]
    assert kinds("they called him an idiot back then") == ["quotation"]
    assert kinds("you are an idiot") == ["address"]
    assert kinds('"no" he cried, idiot that he was, "no"') == ["plain"] == kinds("l’un idiot et l’autre")
    assert kinds("ein „idiot“ war es") == ["quotation"] == kinds("un « idiot » encore")
    assert kinds("an idiott walked by") == ["plain"]
    assert lexicon.features(None)[1] == [] == lexicon.features("")[1]


def frames(spark, n=400):
    rng = random.Random(4)
    vocab = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in ("n", "r", "lo", "tan")]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        ws = [rng.choice(vocab) for _ in range(rng.randrange(20, 60))]
        if toxic:
            for _ in range(3):
                ws[rng.randrange(len(ws))] = rng.choice(["moronic", "scumbag", "worthless"])
        docs.append((i, " ".join(ws), "en", "src", 1, "clash"))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_learns_and_catches_misspellings(spark):
    docs, labels = frames(spark)
    model = toxicity.train(docs, labels)
    assert {"moronic", "scumbag", "worthless"} <= set(model.lexicon.weights)
    extra = [(9000, "you are a moronic scumbag and worthless"), (9001, "ban cer dilo"), (9002, None), (9003, ""), (9004, "ban " * 50_000), (9004, "ban")]
    got = toxicity.score(spark.createDataFrame(extra, "doc_id long, text string"), model).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[9000] > 0.5 > max(by[9001], by[9002], by[9003])
    assert model.lexicon.match("wortless")[:2] == ("worthless", 1) == model.lexicon.match("worhtless")[:2]
    assert sorted(r.doc_id for r in toxicity.keep(docs, model).collect()) == [i for i in range(400) if i % 4]


def test_copies_count_once_in_the_sample(spark, monkeypatch):
    docs, labels = frames(spark, 120)
    more = docs.filter("doc_id in (0, 1)").selectExpr("*", "explode(sequence(1, 300)) as k").selectExpr("k * 1000 + doc_id as doc_id", *docs.columns[1:])
    marks = more.selectExpr("doc_id", "1 as quality", "int(doc_id % 2 = 0) as toxic")
    seen = {}
    monkeypatch.setattr(toxicity, "materialize", lambda df, label: seen.update({label: df.count()}) or df)
    model = toxicity.train(docs.unionByName(more), labels.unionByName(marks))
    assert seen["toxic-sample"] == 120 and len(model.weights) == len(toxicity.FEATURES)


def test_without_labels(spark):
    docs, labels = frames(spark, 20)
    for some in (labels.limit(0), labels.filter("toxic = 0"), labels.withColumn("toxic", labels.toxic.cast("string")).filter("toxic = 'x'")):
        assert all(r.score < 0.5 for r in toxicity.score(docs, toxicity.train(docs, some)).collect())
    assert toxicity.score(docs.limit(0), toxicity.train(docs, labels)).collect() == []


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = entry.table(spark, sf, "documents"), entry.table(spark, sf, "labels")
    model = toxicity.train(docs, labels.filter(entry.fold(5) != 0))
    held = docs.join(labels.filter(entry.fold(5) == 0), "doc_id").select("text", "toxic").collect()
    s, y = np.array([model.score(r.text)[0] for r in held]), np.array([r.toxic for r in held])
    rank = s.argsort().argsort()
    auc = (rank[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (1 - y).sum())
    assert auc > 0.95 and ((s >= 0.5) == y).mean() > 0.97
    # misspelt, the terms of held-out toxic texts still tell; quoted, they don't
    caught = [r.text for r, v in zip(held, s) if r.toxic and v >= 0.5]
    misspelt = [model.score(toxicity.rewritten(t, model.lexicon, False, 7))[0] for t in caught]
    quoted = [model.score(toxicity.rewritten(t, model.lexicon, True, 7))[0] for t in caught]
    assert np.mean(np.array(misspelt) >= 0.5) >= 0.9 and np.mean(np.array(quoted) < 0.5) >= 0.9
    abuse = "you are a {}, a {} and a {}".format(*sorted(model.lexicon.weights, key=model.lexicon.weights.get)[-3:])
    assert model.score(f"she said “{abuse}”, and left")[0] < 0.2 < 0.9 < model.score(abuse)[0]


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    got = entry.op1_toxicity(spark, sf).collect()
    assert len(got) == entry.table(spark, sf, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in got)


def test_evidence_ranks_terms(spark):
    rows = [("a", 30, 1), ("b", 8, 0), ("c", 30, 30), ("d", 3, 0), ("e", 40, 0)]
    counts = spark.createDataFrame(rows, "word string, a long, b long")

    def g2(a, b, t=50, c=200):
        rate, total = (a + b) / (t + c), 0.0
        for got, of in ((a, t), (b, c)):
            for x, p in ((got, rate), (of - got, 1 - rate)):
                total += 2 * x * np.log(x / (of * p)) if x else 0.0
        return total

    expected = sorted((w for w, a, b in rows if a >= toxicity.LEAST_TOXIC and g2(a, b) >= toxicity.LEAST_G2 and toxicity.evidence(a, b, 50, 200) >= toxicity.LEAST_LOG_ODDS), key=lambda w: [-g2(a, b) for v, a, b in rows if v == w][0])
    got = toxicity.weigh(counts, 50, 200)
    assert list(got) == expected and all(abs(got[w] - toxicity.evidence(a, b, 50, 200)) < 1e-9 for w, a, b in rows if w in got)
    assert toxicity.weigh(counts, 0, 5) == {}


def test_repeated_labels_and_ids(spark):
    docs, labels = frames(spark, 120)
    twice = labels.unionByName(labels).unionByName(spark.createDataFrame([(None, 1, 1), (1, 1, 7)], labels.schema))
    once, more = toxicity.train(docs, labels), toxicity.train(docs, twice)
    assert once.lexicon.weights == more.lexicon.weights and np.allclose(once.weights, more.weights)
