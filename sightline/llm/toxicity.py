"""Operator 5: toxicity by a lexicon trie that Levenshtein automata walk.

The lexicon is learned from labelled rows: whole words and stems (first letters of
words) that toxic documents have and others do not. Its entries form a trie. Each word of
a text gives a Levenshtein automaton, and the automaton and the trie are walked together,
so that misspelled terms are found without comparing a word with every term. Terms under
``FUZZY_LETTERS`` letters must be spelled right. Of a token each run of letters is looked up
("l'idiot", "you-idiot"), and its letters with the digits and marks between them, where each of
those is a wrong letter ("id1ot", "st*pid"); the reading with the fewest errors counts.

A term weighs as much as its log-odds between toxic and clean training rows. A misspelling that clean rows
have of their own is an ordinary word and no hit; the other misspellings of a term weigh as the term itself
until clean rows have them, too. A hit then gets a score from its context window: between quotation marks, or
near a word that reports speech, it counts for a part only, so quotation and abuse part. How much exact,
misspelled and quoted hits count is fitted on the same rows, around ``PRIOR``: that alone decides where rows say nothing.

Scale: one pass over the texts, no shuffle of them; a worker looks each word up once in
a bounded table. The labelled sample is written once. Broadcast are at most ``LEXICON_TERMS`` terms,
as many ordinary words, and a few weights.

Defined cases: a null or empty text has no hit and gets the score of texts without hits;
repeated rows each get the same score, and copies of a text count once for the lexicon; labels without their document and null labels are
left out; without labels of both kinds the lexicon is empty and the score is the share
of toxic labels (0.5 if none); an empty table gives no rows; extra columns don't matter, whatever
their names. A text is read in parts of a million letters, so a very long one takes no more room.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm.batches import lean
from sightline.llm.quality import crc32_of_id, labelled_sample
from sightline.llm.store import drop, saved
from sightline.llm.textbytes import fresh_name

#: Labelled rows that lexicon and weights are fitted on at most, half of each label where there are enough.
TRAIN_ROWS = 6000
#: Terms at most; the sample's size and ``EVIDENCE`` bind first in all tables seen so far.
LEXICON_TERMS = 2000
#: Least and most letters of a stem; least letters of a term that may be misspelled.
STEM, FUZZY_LETTERS = (4, 6), 5
ERRORS = 1
#: A term's least share of toxic documents among those that have it (as if both kinds were equally many), and least evidence in nats
#: (Chernoff's bound: a key whose documents are toxic by chance reaches it once in e to that number).
PURITY, EVIDENCE = 0.9, 10.0
#: Clean rows from which a misspelling that they have is looked at as a word of its own.
ORDINARY = 3
#: What misspelled and quoted hits count beside exact ones where labelled rows say nothing, and the bounds of what rows can make of it.
PRIOR, BOUNDS = (0.5, 0.2), ((0.25, 1.0), (0.05, 0.3))
#: Words either way that a context window spans.
CONTEXT = 8
#: Words whose hits a worker keeps at most, and letters of such a word.
KEPT_WORDS, KEPT_LETTERS = 200_000, 64
#: Letters of a text that are split into words at a time.
_PART = 1 << 20

# Words that report speech, in the corpus' four languages, and quotation marks.
REPORTING = frozenset("said says called calls quoted quote wrote dit a-dit appelé cité sagte nannte zitiert schrieb dijo llamó citó escribió".split())
OPENING, CLOSING = "\"“„«‹", "\"”“»›"

_SPACE = re.compile(r"\s")
_LETTERS = re.compile(r"[^\W\d_]+")
_MASKED = re.compile(r"[^\W\d_].*[^\W\d_]", re.DOTALL)


def letters(word: str) -> str:
    """The first run of letters of a word, composed and in lower case."""
    if not word.isalpha():
        found = _LETTERS.search(word)
        if not found:
            return ""
        word = found[0]
    return (word if word.isascii() else unicodedata.normalize("NFC", word)).lower()


def runs(word: str) -> list[str]:
    """All runs of letters of a token, composed and in lower case."""
    if word.isalpha():
        return [letters(word)]
    found = _LETTERS.findall(word if word.isascii() else unicodedata.normalize("NFC", word))
    return [x.lower() for x in found]


def masked(word: str) -> str:
    """A token from its first letter to its last, with what stands between letters; empty where that is one run."""
    found = _MASKED.search(word if word.isascii() else unicodedata.normalize("NFC", word))
    return found[0].lower() if found and not found[0].isalpha() else ""


class Trie:
    """Terms by letter; ``ends`` of a node: the term, and whether it is a stem."""

    def __init__(self, terms: list[tuple[str, bool]], errors: int = ERRORS):
        self.errors, self.follow, self.ends = errors, [{}], [[]]
        for i, (term, stem) in enumerate(terms):
            node = 0
            for letter in term:
                if letter not in self.follow[node]:
                    self.follow[node][letter] = len(self.follow)
                    self.follow.append({})
                    self.ends.append([])
                node = self.follow[node][letter]
            self.ends[node].append((i, stem, len(term)))
        # one error leaves either half of a term in place, its second one at most a letter off
        self.halves: dict[int, set[str]] = {}
        self.others: dict[tuple[int, int], set[str]] = {}
        for term, _ in terms:
            half = len(term) // 2 if errors and len(term) >= FUZZY_LETTERS else len(term)
            self.halves.setdefault(half, set()).add(term[:half])
            if half < len(term):
                for at in range(half - errors, half + errors + 1):
                    self.others.setdefault((at, at + len(term) - half), set()).add(term[half:])
        self.looks = [(slice(0, n), x) for n, x in self.halves.items()] + [(slice(*at), x) for at, x in self.others.items()]

    def find(self, word: str) -> tuple[int, int] | None:
        """The term with the fewest errors that the word is, or begins with, and their number."""
        for part, known in self.looks:
            if word[part] in known:
                break
        else:
            return None
        masks: dict[str, int] = {}
        for i, letter in enumerate(word):
            masks[letter] = masks.get(letter, 0) | 1 << i
        whole, best = 1 << len(word), None
        start = [1]
        for _ in range(self.errors):
            start.append(start[-1] | start[-1] << 1)
        todo = [(0, start)]
        while todo:
            node, states = todo.pop()
            for term, stem, size in self.ends[node]:
                for errors in range((self.errors if size >= FUZZY_LETTERS else 0) + 1):
                    if (states[errors] if stem else states[errors] & whole) and (best is None or (errors, -size, term) < (best[1], -best[2], best[0])):
                        best = (term, errors, size)
            for letter, below in self.follow[node].items():
                mask = masks.get(letter, 0)
                now = [(states[0] & mask) << 1]
                for e in range(1, self.errors + 1):
                    # the same letter; a letter too few; another letter; a letter too many
                    now.append((states[e] & mask) << 1 | states[e - 1] | states[e - 1] << 1 | now[e - 1] << 1)
                now = [x & (whole << 1) - 1 for x in now]
                if now[-1]:
                    todo.append((below, now))
        return best and best[:2]


class Hits(dict):
    """word as written -> (term, errors) or None; ``ordinary``: readings that are words of their own, not misspellings."""

    def __init__(self, trie: Trie, weights: np.ndarray | None = None, ordinary: frozenset[str] = frozenset()):
        super().__init__()
        self.trie, self.ordinary = trie, ordinary
        self.weights = np.ones((2, len(trie.ends))) if weights is None else weights

    def readings(self, word: str) -> list[tuple[str, tuple[int, int]]]:
        """Each reading of a token that is a hit, and its term and errors."""
        hits = [(x, hit) for x in runs(word) if len(x) >= 3 and (hit := self.trie.find(x))]
        if not word.isalpha() and not any(hit[1] == 0 for _, hit in hits) and (x := masked(word)) and (hit := self.trie.find(x)):
            hits.append((x, hit))
        return [(x, hit) for x, hit in hits if not hit[1] or x not in self.ordinary]

    def __missing__(self, word: str) -> tuple[int, int] | None:
        hit = min((hit for _, hit in self.readings(word)), key=lambda x: (x[1], x[0]), default=None)
        if len(word) <= KEPT_LETTERS:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = hit
        return hit

    def features(self, text: str | None) -> tuple[float, float, float]:
        """Exact, misspelled and quoted hits: of each term the logarithm of their number, by its weight."""
        seen: tuple[Counter, Counter, Counter] = Counter(), Counter(), Counter()
        for words, first, end in word_parts(text or ""):
            found = list(map(self.__getitem__, words))
            if any(found[first:end]):
                for i in range(first, end):
                    if hit := found[i]:
                        fuzzy = min(hit[1], 1)
                        seen[2 if in_quotation(words, i) else fuzzy][fuzzy, hit[0]] += 1
        return tuple(sum(float(np.log1p(n)) * float(self.weights[key]) for key, n in sorted(x.items())) for x in seen)


def word_parts(text: str, size: int = _PART) -> Iterator[tuple[list[str], int, int]]:
    """The words of a text in parts, each with ``CONTEXT`` words of its neighbours: the words, the first of the part's own, the one after its last."""
    at, before = 0, []
    while at < len(text):
        end = _part_end(text, at, size)
        own = text[at:end].split()
        after = text[end : _part_end(text, end, 80 * CONTEXT)].split()[:CONTEXT] if end < len(text) else []
        yield [*before, *own, *after], len(before), len(before) + len(own)
        at, before = end, [*before, *own][-CONTEXT:]


def _part_end(text: str, at: int, size: int) -> int:
    """A place after ``at + size`` letters at which a word ends, or the text's end."""
    found = _SPACE.search(text, at + size) if at + size < len(text) else None
    return found.start() if found else len(text)


def in_quotation(words: list[str], i: int) -> bool:
    """Whether the window before word i opens a quotation that it doesn't close, or reports speech with quotation marks about."""
    before, after = words[max(0, i - CONTEXT) : i], words[i + 1 : i + 1 + CONTEXT]
    opened = words[i][0] in OPENING
    for word in before:
        if word[0] in OPENING:
            opened = True
        if len(word) > 1 and word.rstrip(".,;:!?")[-1:] in CLOSING:
            opened = False
    closed = any(w.rstrip(".,;:!?")[-1:] in CLOSING for w in [words[i], *after])
    return opened and (closed or any(letters(w) in REPORTING for w in before))


def _logistic(x: np.ndarray, y: np.ndarray, means: np.ndarray) -> np.ndarray:
    """Intercept and weights of a logistic regression, drawn to ``means`` by a small ridge."""
    a, middle = np.c_[np.ones(len(x)), x], np.r_[0.0, means]
    w, ridge = middle.copy(), np.diag([1e-3, *[1.0] * x.shape[1]])
    loss = lambda w: np.logaddexp(0, a @ w).sum() - y @ (a @ w) + (w - middle) @ ridge @ (w - middle) / 2
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a.T @ (a * (p * (1 - p))[:, None])) + ridge, a.T @ (p - y) + ridge @ (w - middle))
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return w


class Judge:
    """A lexicon, the weights of its terms (spelled right and misspelled), ordinary words, and what kinds of hits count."""

    def __init__(self, terms: list[tuple[str, bool]], base: float):
        self.terms, self.trie, self.base, self.weights = terms, Trie(terms), base, None
        self.term_weights, self.ordinary = np.ones((2, len(terms))), frozenset()

    def hits(self) -> Hits:
        return Hits(self.trie, self.term_weights, self.ordinary)

    def fit(self, x: np.ndarray, y: np.ndarray, ratio: float) -> Judge:
        """``ratio``: how much rarer toxic rows are than in ``y``, as odds."""
        if len(set(y.tolist())) < 2:
            return self
        exact = max(_logistic(x[:, :1], y, np.ones(1))[1], 0.05)
        w = _logistic(x, y, exact * np.array([1.0, *PRIOR]))
        w[0] += np.log(ratio)
        w[1] = max(w[1], 0.05)
        for i, (low, high) in enumerate(BOUNDS, 2):
            w[i] = min(max(w[i], low * w[1]), high * w[1])
        self.weights = w
        return self

    def score(self, features: tuple[float, float, float]) -> float:
        if self.weights is None:
            return self.base
        z = self.weights[0] + float(np.dot(self.weights[1:], features))
        return 1 / (1 + float(np.exp(-max(-500.0, min(500.0, z)))))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and stems of training rows, each once per document, with a hash of the neighbours where it stands first."""
    for batch in batches:
        keys, marks, about = [], [], []
        for y, text in zip(batch.column("y").to_pylist(), batch.column("text"), strict=True):
            seen: dict[str, int] = {}
            words = (text.as_py() or "").split()
            first: dict[str, int] = {}
            for i, w in enumerate(words):
                first.setdefault(w, i)
            for w, i in first.items():
                beside = crc32(" ".join([*words[max(0, i - 1) : i], "|", *words[i + 1 : i + 2]]).encode())
                for word in runs(w):
                    if len(word) >= 3:
                        seen.setdefault(word, beside)
                        for n in range(STEM[0], min(STEM[1], len(word) - 1) + 1):
                            seen.setdefault(word[:n] + "*", beside)
            keys += seen
            about += seen.values()
            marks += [y] * len(seen)
        yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.string()), "y": pa.array(marks, pa.int32()), "beside": pa.array(about, pa.int64())})


def _odds(toxic: float, clean: float, totals: dict[int, int]) -> float:
    return float(np.log((toxic + 0.5) / (totals[1] + 1)) - np.log((clean + 0.5) / (totals[0] + 1)))


def learn_lexicon(sample: DataFrame, totals: dict[int, int]) -> tuple[list[tuple[str, bool]], list[float]]:
    """Terms (word or stem, whether a stem) and their log-odds, chosen in turn by evidence, of equals words before stems and the longest first; none that a chosen stem covers.

    Documents in which a key has the same neighbours count once, so near copies of a toxic text don't make all of its words terms.
    """
    if len(totals) < 2:
        return [], []
    met = sample.select("y", "text").mapInArrow(lean(_keys), "key string, y int, beside long").dropDuplicates(["key", "y", "beside"])
    keys = met.groupBy("key").agg(F.sum("y").alias("toxic"), F.count("*").alias("n"))
    clean, share, base = (F.col("n") - F.col("toxic")) / totals[0], F.col("toxic") / totals[1], totals[1] / (totals[0] + totals[1])
    p = F.col("toxic") / F.col("n")
    evidence = F.col("n") * (p * F.log(p / base) + F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - base))).otherwise(0.0))
    pure = keys.filter((F.col("toxic") > 0) & (share >= PURITY * (share + clean)) & (F.length("key") >= 4)).withColumn("evidence", evidence).filter(F.col("evidence") >= EVIDENCE)
    found = pure.orderBy(F.desc(F.round("evidence", 6)), F.endswith("key", F.lit("*")), F.desc(F.length("key")), "key").limit(20 * LEXICON_TERMS).collect()
    terms: list[tuple[str, bool]] = []
    odds: list[float] = []
    stems: set[str] = set()
    begun: set[str] = set()
    for r in found:
        word, stem = r["key"].rstrip("*"), r["key"].endswith("*")
        # a shorter stem with no more evidence than a chosen term adds nothing
        if len(terms) < LEXICON_TERMS and not any(word[:n] in stems for n in range(1, len(word) + 1)) and not (stem and word in begun):
            terms.append((word, stem))
            odds.append(_odds(r["toxic"], r["n"] - r["toxic"], totals))
            begun.update(word[:n] for n in range(1, len(word) + 1))
            if stem:
                stems.add(word)
    return terms, odds


def _misspelled(sample: DataFrame, judge: Judge, totals: dict[int, int]) -> None:
    """Gives the judge its ordinary words and the weights of misspelled terms, from the sample's misspellings."""
    held = sample.sparkSession.sparkContext.broadcast(judge.trie)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = Hits(held.value)
        for batch in batches:
            rows = [
                (form, term, y)
                for y, text in zip(batch.column("y").to_pylist(), batch.column("text"), strict=True)
                for form, term in {(x, hit[0]) for w in set((text.as_py() or "").split()) for x, hit in hits.readings(w) if hit[1]}
            ]
            form, term, y = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_pydict({"form": pa.array(form, pa.string()), "term": pa.array(term, pa.int32()), "y": pa.array(y, pa.int32())})

    forms = sample.select("y", "text").mapInArrow(lean(met), "form string, term int, y int").groupBy("form", "term").agg(F.sum("y").alias("toxic"), F.count("*").alias("n"))
    forms = saved(forms, "toxic-forms")
    clean = F.col("n") - F.col("toxic")
    share = F.col("toxic") / totals[1]
    own = (clean >= ORDINARY) & (share < PURITY * (share + clean / totals[0]))
    common = forms.filter(own).orderBy(F.desc(clean), "form").limit(LEXICON_TERMS).collect()
    judge.ordinary = frozenset(r["form"] for r in common)
    rest = forms.join(F.broadcast(sample.sparkSession.createDataFrame([(x,) for x in sorted(judge.ordinary)], "form string")), "form", "left_anti")  # at most LEXICON_TERMS words
    for r in rest.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n")).collect():
        term = judge.term_weights[0, r["term"]]
        # one toxic row's worth of the term's own odds stands beside what the misspellings show
        seen = _odds(r["toxic"] + 0.5, r["n"] - r["toxic"] + 0.5 * float(np.exp(-term)) * totals[0] / totals[1], totals)
        judge.term_weights[1, r["term"]] = min(max(seen, 0.0), term)
    drop(forms)


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", train, rows: int = TRAIN_ROWS, doc_id: str = "doc_id", text: str = "text") -> Judge:
    chosen, share = labelled_sample(docs, labels, label, train, rows, doc_id=doc_id, text=text)
    sample = saved(chosen.select("y", "text"), "toxic-sample")  # a bounded number of rows
    distinct = sample.dropDuplicates(["y", "text"])
    totals = {r["y"]: r["n"] for r in distinct.groupBy("y").agg(F.count("*").alias("n")).collect()}
    terms, odds = learn_lexicon(distinct, totals)
    judge = Judge(terms, share)
    if terms:
        judge.term_weights = np.array([odds, odds])
        _misspelled(distinct, judge, totals)
    held = sample.sparkSession.sparkContext.broadcast(judge)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = held.value.hits()
        for batch in batches:
            x = [hits.features(t.as_py()) for t in batch.column("text")]
            columns = list(zip(*x, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_pydict({"y": batch.column("y")} | {n: pa.array(c, pa.float64()) for n, c in zip(("exact", "fuzzy", "quoted"), columns, strict=True)})

    got = sample.mapInArrow(lean(counted), "y int, exact double, fuzzy double, quoted double").collect()
    drop(sample)
    got.sort(key=lambda r: (r["y"], r["exact"], r["fuzzy"], r["quoted"]))
    x = np.array([(r["exact"], r["fuzzy"], r["quoted"]) for r in got]).reshape(-1, 3)
    y = np.array([r["y"] for r in got], dtype=float)
    drawn = y.mean() if len(y) else 0
    ratio = share / (1 - share) / (drawn / (1 - drawn)) if 0 < share < 1 and 0 < drawn < 1 else 1.0
    return judge.fit(x, y, ratio)


def _score(batches: Iterator[pa.RecordBatch], judge: Judge, text: str) -> Iterator[pa.RecordBatch]:
    hits = judge.hits()
    for batch in batches:
        score = [judge.score(hits.features(t.as_py())) for t in batch.column(text)]
        yield pa.RecordBatch.from_pydict({n: batch.column(n) for n in batch.schema.names if n != text} | {"score": pa.array(score, pa.float64())})


def score_toxicity(docs: DataFrame, judge: Judge, *, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` of each document, and its ``score`` (in place of a column of that name)."""
    held = docs.sparkSession.sparkContext.broadcast(judge)
    keep = [n for n in keep if n != "score"]
    said = fresh_name("__text", keep)
    rows = docs.select(*keep, F.col(text).alias(said))
    schema = T.StructType([*(rows.schema[n] for n in keep), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(lean(lambda batches: _score(batches, held.value, said)), schema)


def reject_toxic(docs: DataFrame, judge: Judge, *, limit: float = 0.5, text: str = "text") -> DataFrame:
    """``docs`` without those that score ``limit`` or more."""
    held = docs.sparkSession.sparkContext.broadcast(judge)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = held.value.hits()
        for batch in batches:
            keep = [held.value.score(hits.features(t.as_py())) < limit for t in batch.column(text)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(lean(kept), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: toxicity of all documents; a fifth is held out."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = crc32_of_id() % 5 == 0
    judge = fit(docs, labels, train=~held_out)
    scored = score_toxicity(docs, judge, keep=["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
