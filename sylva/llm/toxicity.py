"""Toxicity: a learnt lexicon, Levenshtein automata over its trie, context windows.

The lexicon holds the words whose document counts among labelled rows lean to
toxic (signed log-likelihood ratio). Its trie is intersected with the Levenshtein
automata of its terms: a state is the set of (trie node, edits, awaited character) that a prefix of
a word can reach, determinised lazily, so that a word costs a table lookup a
character and dies early. Terms of ``FUZZY_LENGTH`` characters and more allow one
edit (a character more, less or other, or two swapped), the others none. A misspelling is worth ``FUZZY_CREDIT`` of its
term, moved by how the labelled rows themselves use that word: a word that clean rows use is none.

Around every hit a window of ``WINDOW`` words tells quotation (between a pair of quote marks, or after a verb of saying)
from direct address (a second person) and plain use. What is quoted and what isn't enter a logistic regression apart. It is fitted on the
labelled texts and on two copies of the toxic ones: with their terms misspelled, still toxic, and with their terms quoted, not toxic.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Bound of the sample that lexicon and regression are fitted on, and of the lexicon.
TRAIN_ROWS, LEXICON = 20_000, 4_000
#: A term needs so much evidence (log-likelihood ratio), so many toxic documents and such odds.
LEAST_G2, LEAST_TOXIC, LEAST_LOG_ODDS = 15.0, 4, 1.5
FUZZY_LENGTH, WINDOW = 5, 8
#: Worth of a misspelling by its term's, and in how many documents a word must be seen to outweigh that.
FUZZY_CREDIT, CREDIT_DOCS = 0.8, 2.0
#: States and words that a worker keeps; it starts afresh beyond.
STATES, WORDS = 30_000, 100_000

WORD = re.compile(r"[^\W_]+")
#: Marks that open a quotation and those that close it.
QUOTES = {'"': '"', "“": "”", "„": "“”", "«": "»", "»": "«", "‘": "’", "‚": "‘’"}
MARK = re.compile("[\"“”„«»‘’‚]")
SAYING = frozenset("said says say wrote writes called calls quote quoted quotes term word sagte schrieb genannt dit écrit appelé dijo escribió llamó".split())
SECOND_PERSON = frozenset("you your yours youre du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú usted ustedes vosotros os tus".split())
FEATURES = ("bias", "any", "distinct", "weight", "top", "misspelled", "share", "quoted", "direct", "words")
Hit = tuple[str, str, int, str]


def evidence(toxic_with: float, clean_with: float, toxic: int, clean: int) -> float:
    """Log odds of a word of which so many toxic and clean documents have it."""
    return float(np.log((toxic_with + 0.5) / (toxic + 1)) - np.log((clean_with + 0.5) / (clean + 1)))


@dataclass
class Lexicon:
    """Terms with weights; ``match`` gives ``(term, edits, credit)`` of a word, or None.

    ``credits``: what misspellings seen in training are worth; 0 or less is no hit.
    """

    weights: dict[str, float]
    credits: dict[str, float] = field(default_factory=dict)
    children: list[dict[str, int]] = field(default_factory=lambda: [{}])
    term_at: dict[int, str] = field(default_factory=dict)
    longest: list[int] = field(default_factory=lambda: [0])

    def __post_init__(self) -> None:
        for term in self.weights:
            node = 0
            self.longest[0] = max(self.longest[0], len(term))
            for c in term:
                node = self.children[node].setdefault(c, len(self.children))
                if node == len(self.children):
                    self.children.append({})
                    self.longest.append(0)
                self.longest[node] = max(self.longest[node], len(term))
            self.term_at[node] = term
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.accepts: list[tuple[str, int] | None] = []
        self.known: dict[str, tuple[str, int, float] | None] = {}
        self.start = self._state({(0, 0, "")})

    def _fuzzy(self, node: int) -> bool:
        return self.longest[node] >= FUZZY_LENGTH

    def _state(self, items: set[tuple[int, int, str]]) -> int:
        """Closes ``items`` under deletions (a term's character missing in the word), keeps the least edits of a node."""
        least: dict[tuple[int, str], int] = {}
        for node, e, awaited in items:
            least[node, awaited] = min(e, least.get((node, awaited), 9))
            if e == 0:
                for child in self.children[node].values():
                    if self._fuzzy(child):
                        least[child, ""] = min(1, least.get((child, ""), 9))
        key = frozenset((node, e, awaited) for (node, awaited), e in least.items())
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            fits = [(e, -self.weights[t], t) for node, e, awaited in key if not awaited and (t := self.term_at.get(node)) and (e == 0 or len(t) >= FUZZY_LENGTH)]
            self.accepts.append((min(fits)[2], min(fits)[0]) if fits else None)
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        """-1: no term can be reached."""
        out: set[tuple[int, int, str]] = set()
        for node, e, awaited in self.sets[state]:
            if awaited:  # the second of two swapped characters
                if c == awaited:
                    out.add((node, 1, ""))
                continue
            child = self.children[node].get(c)
            if child is not None:
                out.add((child, e, ""))
            if e == 0 and self._fuzzy(node):
                out.add((node, 1, ""))
                for own, k in self.children[node].items():
                    if self._fuzzy(k):
                        out.add((k, 1, ""))
                        if own != c and (after := self.children[k].get(c)) is not None:
                            out.add((after, 1, own))
        to = self._state(out) if out else -1
        self.steps[state][c] = to
        return to

    def match(self, word: str) -> tuple[str, int, float] | None:
        if word in self.known:
            return self.known[word]
        if len(self.known) > WORDS:
            self.known = {}
        if len(self.sets) > STATES:
            self._reset()
        state, steps = self.start, self.steps
        for c in word:
            to = steps[state].get(c)
            state = self._step(state, c) if to is None else to
            if state < 0:
                break
        found = self.accepts[state] if state >= 0 else None
        if found is not None:
            term, e = found
            credit = self.credits.get(word, FUZZY_CREDIT * self.weights[term]) if e else self.weights[term]
            found = (term, e, credit) if credit > 0 else None
        self.known[word] = found
        return found

    def quoted(self, low: str, words: list[str], spans: list[tuple[int, int]], i: int) -> bool:
        """Word ``i`` stands between a pair of quote marks of its window, or after a verb of saying in it."""
        first, last = max(0, i - WINDOW), min(len(words), i + WINDOW + 1)
        if not SAYING.isdisjoint(words[first:i]):
            return True
        before, after = MARK.findall(low, max(0, spans[first][0] - 1), spans[i][0]), MARK.search(low, spans[i][1], spans[last - 1][1] + 1)
        if not before or after is None or after[0] not in QUOTES.get(before[-1], ""):
            return False
        # a straight mark may as well close: an odd number of them on the line opens
        return before[-1] != '"' or low.count('"', low.rfind("\n", 0, spans[i][0]) + 1, spans[i][0]) % 2 == 1

    def features(self, text: str | None) -> tuple[list[float], list[Hit]]:
        """``FEATURES`` of a whole text and its hits: (word, term, edits, context).

        A term counts once, by its best use; ``any`` to ``share`` are of what isn't quoted, ``quoted`` of what is.
        """
        low = (text or "").lower()
        found = WORD.findall(low)
        match = self.match
        hits = {w: m for w in set(found) if (m := match(w))}
        if not hits:
            return [1.0, *[0.0] * 8, np.log1p(len(found))], []
        out: list[Hit] = []
        spans = [m.span() for m in WORD.finditer(low)]
        meant: dict[str, tuple[float, int]] = {}
        said: dict[str, float] = {}
        plain = direct = 0
        for i, w in enumerate(found):
            if w not in hits:
                continue
            term, e, credit = hits[w]
            if self.quoted(low, found, spans, i):
                said[term] = max(credit, said.get(term, 0.0))
                out.append((w, term, e, "quotation"))
                continue
            told = not SECOND_PERSON.isdisjoint(found[max(0, i - WINDOW) : i + WINDOW + 1])
            plain, direct = plain + 1, direct + told
            meant[term] = max((credit, -e), meant.get(term, (0.0, 0)))
            out.append((w, term, e, "address" if told else "plain"))
        worth = [c for c, _ in meant.values()]
        wrong = sum(e < 0 for _, e in meant.values())
        return [
            1.0, float(bool(worth)), np.log1p(len(worth)), np.log1p(sum(worth)), max(worth, default=0.0) / 5, wrong / max(1, len(worth)),
            np.sqrt(plain / len(found)), np.log1p(sum(said.values())), direct / max(1, plain), np.log1p(len(found)),
        ], out


def misspelt(word: str, seed: int) -> str:
    """One edit of ``word``, past its first character where there are others: left out, doubled, swapped or replaced."""
    h = zlib.crc32(f"{seed} {word}".encode())
    at = 1 + (h >> 4) % max(1, len(word) - 1)
    kind = h % 4 if at + 1 < len(word) else h % 2
    if kind == 0:
        return word[:at] + word[at + 1 :]
    if kind == 1:
        return word[:at] + word[at - 1] + word[at:]
    if kind == 2:
        return word[:at] + word[at + 1] + word[at] + word[at + 2 :]
    return word[:at] + ("x" if word[at] != "x" else "z") + word[at + 1 :]


def rewritten(text: str, lexicon: Lexicon, quote: bool, seed: int = 0) -> str:
    """``text`` with every term misspelt that allows it, or every hit quoted."""

    def change(m: re.Match) -> str:
        low = m[0].lower()
        found = lexicon.match(low)
        if found is None:
            return m[0]
        if quote:
            return f"“{m[0]}”" if zlib.crc32(low.encode()) + seed & 1 else f"said {m[0]}"
        return misspelt(low, seed) if len(low) >= FUZZY_LENGTH and not found[1] else m[0]

    return WORD.sub(change, text)


#: SQL of the log-likelihood ratio of a word with ``a`` of {t} toxic and ``b`` of {c} clean documents, and of its log odds.
_TERM = "{x} * ln({x} / ({of} * ((a + b) / ({t} + {c}))))"
_REST = "({of} - {x}) * ln(({of} - {x}) / ({of} * (1 - (a + b) / ({t} + {c}))))"


def _g2(toxic: int, clean: int) -> str:
    parts = []
    for x, of in (("a", toxic), ("b", clean)):
        parts.append(f"if({x} > 0, {_TERM.format(x=x, of=f'{of}D', t=toxic, c=clean)}, 0)")
        parts.append(f"if({x} < {of}, {_REST.format(x=x, of=f'{of}D', t=toxic, c=clean)}, 0)")
    return f"2 * ({' + '.join(parts)})"


def weigh(counts: DataFrame, toxic: int, clean: int) -> dict[str, float]:
    """Log odds of the terms of ``counts(word, a, b)`` whose lean to toxic is beyond chance, the ``LEXICON`` of most evidence; a, b: toxic and clean documents."""
    if not toxic or not clean:
        return {}
    odds = f"ln((a + 0.5D) / ({toxic} + 1)) - ln((b + 0.5D) / ({clean} + 1))"
    rows = counts.filter(f"a >= {LEAST_TOXIC}").selectExpr("word", f"{odds} as odds", f"{_g2(toxic, clean)} as g2").filter(f"odds >= {LEAST_LOG_ODDS} and g2 >= {LEAST_G2}")
    return {r.word: float(r.odds) for r in rows.orderBy(F.desc("g2"), "word").limit(LEXICON).collect()}


def regress(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps; the bias isn't penalised."""
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray

    def score(self, text: str | None) -> tuple[float, list[Hit]]:
        x, hits = self.lexicon.features(text)
        return float(1 / (1 + np.exp(-np.clip(np.dot(x, self.weights), -30, 30)))), hits


def _seen(counts: DataFrame, weights: dict[str, float], toxic: int, clean: int) -> dict[str, float]:
    """Worth of the misspellings of terms that the rows of ``counts(word, a, b)`` have: few, as they are within an edit of the lexicon."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(weights)
        for batch in batches:
            near = [(w, a, b, m[0]) for w, a, b in zip(*(c.to_pylist() for c in batch.columns)) if (m := own.match(w)) and m[1]]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in near], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], ["word", "a", "b", "term"])

    out = {}
    for r in counts.select("word", "a", "b").mapInArrow(run, "word string, a bigint, b bigint, term string").collect():
        n = r.a + r.b
        out[r.word] = (CREDIT_DOCS * FUZZY_CREDIT * weights[r.term] + n * min(weights[r.term], evidence(r.a, r.b, toxic, clean))) / (CREDIT_DOCS + n)
    return out


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fits on a sample of about ``rows`` of the rows of ``labels(doc_id, toxic)`` at most, chosen by a hash of the text; copies count once.

    Lexicons of two halves give the features of the other half for the
    regression; the lexicon of all is used afterwards: the ``LEXICON`` terms of most evidence. Without labels of both
    classes the score is the same for every text, under 0.5 unless all are toxic; so it is for empty tables. Rows of either table that repeat a doc_id
    pair all texts of it with all labels of it, and a text of both labels counts as a toxic and a clean one; labels other than 0 and 1 and rows without an id are left out.
    """
    labels = labels.select("doc_id", F.col("toxic").cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)").distinct()
    n = labels.count()
    picked = docs.select("doc_id", "text").join(labels, "doc_id").filter(F.expr(f"pmod(xxhash64(text, 7), 1000000) < {min(1.0, rows / max(n, 1)) * 1e6}"))
    picked = picked.select("text", "y").distinct()  # else a text that a third of the rows repeat would break the bound
    picked = materialize(picked.select("text", "y", F.expr("pmod(xxhash64(text, 8), 2)").alias("half")), "toxic-sample")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, y, half in zip(*(c.to_pylist() for c in batch.columns)):
                own = sorted(set(WORD.findall((t or "").lower())))
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([2 * half + y] * len(own), pa.int32())], ["word", "k"])

    sizes = {(r.half, r.y): r.n for r in picked.groupBy("half", "y").agg(F.count("*").alias("n")).collect()}
    of = lambda halves, y: sum(sizes.get((h, y), 0) for h in halves)
    if not of((0, 1), 1) or not of((0, 1), 0):
        return Model(Lexicon({}), np.array([4.0 if of((0, 1), 1) else -4.0, *[0.0] * (len(FEATURES) - 1)]))
    counts = materialize(picked.mapInArrow(explode, "word string, k int").groupBy("word").agg(*(F.sum((F.col("k") == k).cast("bigint")).alias(f"k{k}") for k in range(4))), "toxic-words")
    by = {}
    for halves in ((0,), (1,), (0, 1)):
        own = counts.select("word", *(sum(F.col(f"k{2 * h + y}") for h in halves).alias(c) for y, c in ((1, "a"), (0, "b"))))
        weights = weigh(own, of(halves, 1), of(halves, 0))
        by[halves] = (weights, _seen(own, weights, of(halves, 1), of(halves, 0)))

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        other = [Lexicon(*by[(1,)]), Lexicon(*by[(0,)])]
        for batch in batches:
            x, y = [], []
            for k, (t, label, half) in enumerate(zip(*(c.to_pylist() for c in batch.columns))):
                own = other[half]
                found, hits = own.features(t)
                x.append(found)
                y.append(label)
                if label and hits:
                    x += [own.features(rewritten(t, own, False, k))[0], own.features(rewritten(t, own, True, k))[0]]
                    y += [1, 0]
            yield pa.RecordBatch.from_arrays([pa.array([list(map(float, r)) for r in x], pa.list_(pa.float64())), pa.array(y, pa.int32())], ["x", "y"])

    sample = picked.mapInArrow(featurise, "x array<double>, y int").collect()
    return Model(Lexicon(*by[(0, 1)]), regress(np.array([r.x for r in sample]), np.array([r.y for r in sample], float)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score, hits)`` for every row of ``docs``, whole texts; null texts count as empty.

    ``hits``: the distinct finds, as ``word>term/edits:context``. Repeated rows get a row each, rows without an id too; other columns of
    ``docs`` are not read; an empty table gives no rows.
    """
    lexicon, weights = (model.lexicon.weights, model.lexicon.credits), model.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(Lexicon(*lexicon), weights)
        for batch in batches:
            found = [own.score(t.as_py()) for t in batch.column(1)]
            hits = ["; ".join(dict.fromkeys(f"{w}>{t}/{e}:{c}" for w, t, e, c in h)) for _, h in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in found], pa.float64()), pa.array(hits, pa.string())], ["doc_id", "score", "hits"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, score double, hits string")


def keep(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """Rows of ``docs`` whose score is under ``least``, all columns, repeated ones and those without an id or text too, without a shuffle."""
    lexicon, weights = (model.lexicon.weights, model.lexicon.credits), model.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(Lexicon(*lexicon), weights)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            yield batch.filter(pa.array([own.score(t.as_py())[0] < least for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
