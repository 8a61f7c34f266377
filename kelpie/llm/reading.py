"""Reading level of English prose: a linear pairwise ranker over syntax and vocabulary features, calibrated by isotonic regression.

What English prose is, is learned from the rated documents: words that many of them have, and that texts marked as another
language lack, mark a sentence as English. The English sentences of a document are taken out of what surrounds them (code,
logs, tracebacks, tables, headings, text in other languages). From a bounded sample of rated documents the ranker learns
weights such that of two documents the one with the higher rating scores higher; scores of held-out folds against ratings
give, by isotonic regression, the cuts between levels. Executors parse the sample and count its terms; the driver gets the
known terms' counts only. Every document is then scored by one pass over the whole table.

Bounds of the fit, all parameters of `train`: `train_rows` rated documents (and as many in other languages), `terms` words
and word pairs, `pairs` drawn pairs, `steps` of the optimiser. They bound what is learned from, not what is scored."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpie.sources.tables import durable

#: English function words: of a pair of words that is a term one is among these; they also tell English where fewer than
#: `_FEW` rated documents are there to learn it from.
FUNCTION_WORDS = frozenset("a about after all although an and any are as at be because been before both but by can could did do does each either every for from had has have he her his how i if in into is it its may might more most must near neither no nor not of on one or our out over shall she should since so some than that the their them then there these they this those though through to under unless until up was we were what when where whereas which while who whose will with would you your".split())
#: Words that open subordinate clauses, and forms of "be".
SUBORDINATE = frozenset("after although as because before if insofar inasmuch lest notwithstanding provided since that though unless until whereas whereby wherever whether which while who whom whose".split())
BE = frozenset("be been being is are was were".split())

_FENCE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)", re.S)
_TAG = re.compile(r"<[^<>\n]{1,80}>|&[a-z]{2,8};|&#\d+;")
_LINK = re.compile(r"https?://\S+|www\.\S+")
_DOTTED = re.compile(r"\b\w+(?:\.\w+){1,}\b")
_LOG = re.compile(r"^\s*(?:\d{4}-\d\d-\d\d[ T]|File \"|Traceback |at [\w.$]+\(|>>> |[\w.]*(?:Error|Exception)\b:|Run [0-9a-f]{6,}\b|#|\|)")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_PLAIN = re.compile(r"[a-z]+(?:['-][a-z]+)*")  # the same over ASCII, faster
_COUNT = re.compile(r"\w+")
_IDEOGRAPH = re.compile("[\u3040-\u30ff\u3400-\u9fff]")
_PARTICIPLE = ("ed", "en", "wn", "pt", "ld")
_STOP = re.compile(r"[.!?;…]+(?=\s|$)")


Sentence = tuple[str, list[str]]  # its text, and its words in lower case without dotted names


def parse(text: str | None, least: float = 0.2, marks: frozenset[str] = FUNCTION_WORDS) -> tuple[list[Sentence], int, float]:
    """The English sentences of a text (of whose words at least the share `least` is among `marks`), how many words they have, and
    their share of the words outside of code and logs (an ideograph counts as half a word). One pass; the rarer patterns are tried only where a character of theirs occurs."""
    if not text:
        return [], 0, 0.0
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n", text)
    if "<" in text or "&" in text:
        text = _TAG.sub(" ", text)
    out, words, every = [], 0, 0
    for line in text.replace("\r", "\n").split("\n"):
        if not line or _LOG.match(line):
            continue
        if "http" in line or "www." in line:
            line = _LINK.sub(" ", line)
        if not line.isascii():
            every += len(_IDEOGRAPH.findall(line)) // 2
        for part in _STOP.split(line.strip(" \t-*•>+")):
            n = len(_COUNT.findall(part))
            every += n
            if n < 2:
                continue
            plain = (_DOTTED.sub(" ", part) if "." in part else part).lower()
            found = (_PLAIN if plain.isascii() else _WORD).findall(plain)
            known = len([w for w in found if w in marks])
            if known and known >= least * len(found):
                out.append((part, found))
                words += n
    return out, words, words / every if every else 0.0


def english(text: str | None, least: float = 0.2) -> tuple[list[str], int]:
    """The English sentences of a text and how many words they have."""
    sentences, words, _ = parse(text, least)
    return [s for s, _ in sentences], words


def line_words(text: str | None) -> set[str]:
    """The words of a text outside of code and logs, in lower case."""
    out: set[str] = set()
    if not text:
        return out
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n", text)
    if "<" in text or "&" in text:
        text = _TAG.sub(" ", text)
    for line in text.replace("\r", "\n").split("\n"):
        if line and not _LOG.match(line):
            line = (_DOTTED.sub(" ", _LINK.sub(" ", line)) if "." in line else line).lower()
            out.update((_PLAIN if line.isascii() else _WORD).findall(line))
    return out


def _opens(a: str, b: str) -> bool:
    return a in FUNCTION_WORDS or b in FUNCTION_WORDS or a in SUBORDINATE


def terms(sentences: list[Sentence]) -> Counter:
    """Words, and adjacent pairs of words of which one is a function word."""
    out: Counter = Counter()
    for _, w in sentences:
        out.update(w)
        out.update(p for p in zip(w, w[1:]) if _opens(*p))
    return out


def syntax(sentences: list[Sentence]) -> list[float]:
    """Sentence length, its spread, clauses, commas, passives, word length, long words, distinct words."""
    n = max(1, len(sentences))
    flat = [w for _, s in sentences for w in s]
    m = max(1, len(flat))
    length = [len(s) for _, s in sentences]
    mean = sum(length) / n
    size = list(map(len, flat))
    passive = sum(b.endswith(_PARTICIPLE) for _, s in sentences for a, b in zip(s, s[1:]) if a in BE)
    return [
        mean,
        math.sqrt(sum((x - mean) ** 2 for x in length) / n),
        len([w for w in flat if w in SUBORDINATE]) / n,
        sum(t.count(",") for t, _ in sentences) / n,
        passive / n,
        sum(size) / m,
        len([x for x in size if x >= 9]) / m,
        len([x for x in size if x >= 12]) / m,
        len(set(flat)) / math.sqrt(m),
    ]


_SYNTAX = 9


@dataclass
class Model:
    """vocabulary: term -> feature; the first features are the syntactic ones. cuts: the least score of levels 2, 3, ..."""

    vocabulary: dict[str | tuple[str, str], int]
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    cuts: np.ndarray
    levels: np.ndarray
    marks: frozenset[str] = FUNCTION_WORDS

    def known(self, sentences: list[Sentence]) -> tuple[list[int], int]:
        """The features of the terms that are known, one entry per occurrence, and the number of words."""
        get, at, total = self.vocabulary.get, [], 0
        for _, w in sentences:
            total += len(w)
            at += [i for x in w if (i := get(x)) is not None]
            at += [i for x in zip(w, w[1:]) if (i := get(x)) is not None]
        return at, max(1, total)

    def score_one(self, sentences: list[Sentence]) -> float:
        """As score(..) of the features, over the terms that occur only."""
        if not hasattr(self, "_pull"):
            self._pull = self.weight / self.scale
            self._base = float(-(self.mean * self._pull).sum())
        at, total = self.known(sentences)
        return self._base + float(self._pull[at].sum()) / total + float(np.dot(syntax(sentences), self._pull[:_SYNTAX]))

    def score(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weight

    def level(self, score: np.ndarray) -> np.ndarray:
        return self.levels[np.searchsorted(self.cuts, score, side="right")]


def rank_weights(x: np.ndarray, y: np.ndarray, seed: int, pairs: int = 50_000, steps: int = 150, decay: float = 0.03) -> np.ndarray:
    """Weights of a linear pairwise ranker: logistic loss over drawn pairs of different ratings, by Adam on all of them at once."""
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, len(y), (2, 3 * pairs))
    keep = y[a] > y[b]
    a, b = a[keep][:pairs], b[keep][:pairs]
    w = np.zeros(x.shape[1], np.float64)
    if not len(a):
        return w
    m, v = np.zeros_like(w), np.zeros_like(w)
    gap = np.sqrt((y[a] - y[b]).astype(np.float64))  # farther apart counts more
    for t in range(1, steps + 1):
        s = (x @ w.astype(x.dtype)).astype(np.float64)
        pull = gap / (1 + np.exp(np.clip(s[a] - s[b], -30, 30))) / gap.sum()
        coef = np.bincount(a, pull, len(y)) - np.bincount(b, pull, len(y))
        g = decay * w - coef.astype(x.dtype) @ x  # in the features' own type: else all of them are copied at every step
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling adjacent violators: (least score of each block, its value)."""
    order = np.argsort(score, kind="stable")
    s, blocks = score[order], []
    for i, v in enumerate(y[order]):
        blocks.append([float(v), 1, s[i]])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            value, n, _ = blocks.pop()
            blocks[-1][0] = (blocks[-1][0] * blocks[-1][1] + value * n) / (blocks[-1][1] + n)
            blocks[-1][1] += n
    return np.array([b[2] for b in blocks]), np.array([b[0] for b in blocks])


def cuts_of(score: np.ndarray, y: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The scores at which the isotonic fit passes half-way between levels."""
    at, value = isotonic(score, y)
    out = []
    for lo, hi in zip(levels, levels[1:]):
        above = np.flatnonzero(value >= (lo + hi) / 2)
        if not len(above):
            out.append(np.inf)
        elif above[0] == 0:
            out.append(-np.inf)
        else:
            first = at[above[0]]
            out.append((score[score < first].max() + first) / 2)
    return np.array(out)


def _spread(x: np.ndarray, mean: np.ndarray, block: int = 1024) -> np.ndarray:
    """The standard deviation of each column, without a second array of the size of x."""
    total = np.zeros(x.shape[1])
    for lo in range(0, len(x), block):
        total += ((x[lo : lo + block] - mean) ** 2).sum(0)
    return np.sqrt(total / max(1, len(x)))


def learn(x: np.ndarray, ratings: np.ndarray, words: list, seed: int = 11, folds: int = 4, pairs: int = 50_000, steps: int = 150) -> Model:
    """A model from the features of rated documents: syntax, then the counts of `words` per word. Ratings of one document are averaged beforehand.

    Without ratings of two different levels the model knows one level only (1 without any). x is scaled in place."""
    levels = np.unique(np.round(ratings).astype(int)) if len(ratings) else np.array([1])
    model = Model({w: _SYNTAX + i for i, w in enumerate(words)}, np.zeros(1), np.ones(1), np.zeros(1), np.array([]), levels)
    model.mean = x.mean(0) if len(x) else np.zeros(x.shape[1])
    model.scale = np.maximum(_spread(x, model.mean), 1e-6) if len(x) else np.ones(x.shape[1])
    rare = model.scale[_SYNTAX:]
    model.scale[_SYNTAX:] = np.sqrt(rare * rare.mean()) if len(rare) else rare  # rare terms are raised by half, so that their noise isn't
    model.weight = np.zeros(x.shape[1])
    if len(levels) < 2:
        return model
    z = x  # the one large array
    z -= model.mean
    z /= model.scale
    part = np.random.default_rng(seed).integers(0, folds, len(z))
    held = np.zeros(len(z))
    for f in range(folds):
        out = part == f
        if out.any() and not out.all():
            held[out] = z[out] @ rank_weights(z[~out], ratings[~out], seed, pairs, steps)
    model.weight = rank_weights(z, ratings, seed, pairs, steps)
    # A fold's scores are brought to the scale of the whole model's before they calibrate it.
    own = z @ model.weight
    for f in range(folds):
        out = part == f
        if out.sum() > 1 and held[out].std() > 0:
            held[out] = (held[out] - held[out].mean()) / held[out].std() * own[out].std() + own[out].mean()
    model.cuts = cuts_of(held, ratings, levels)
    return model


def ratings_of(labels: DataFrame) -> DataFrame:
    """(doc_id, rating): the mean of a document's ratings; empty ones don't count, and neither does one given twice by a rater."""
    ok = labels.where(F.col("doc_id").isNotNull() & F.col("level").isNotNull()).select("doc_id", "level", "rater").distinct()
    return ok.groupBy("doc_id").agg(F.avg("level").alias("rating"))


_FEW = 50


def _sampled(rows: DataFrame, n: int, most: int) -> DataFrame:
    """About `most` of n rows, by a hash of doc_id; all if there are fewer."""
    return rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1.0, most / max(n, 1)) * (1 << 30)))


def marking_words(texts: DataFrame, share: float = 0.1, contrast: float = 3.0) -> frozenset[str]:
    """Words that at least the share `share` of the rated texts has, and `contrast` times as often as those in other languages.

    texts: text, rating (null: in another language), a bounded sample. By their share such words are few: at most ten times
    the words of an average text. Under `_FEW` rated texts the fixed function words are taken instead."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, seen = [0, 0], (Counter(), Counter())
        for b in batches:
            for t, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n[r is None] += 1
                seen[r is None].update(line_words(t))
        words = [("", k, n[k]) for k in (0, 1)] + [(w, k, c) for k in (0, 1) for w, c in seen[k].items()]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in words]), pa.array([x[1] for x in words], pa.int32()), pa.array([x[2] for x in words], pa.int64())], ["word", "other", "n"])

    each = durable(texts.select("text", "rating").mapInArrow(count, "word string, other int, n bigint").groupBy("word").agg(F.sum(F.when(F.col("other") == 0, F.col("n")).otherwise(0)).alias("e"), F.sum(F.when(F.col("other") == 1, F.col("n")).otherwise(0)).alias("o")))
    got = each.where("word = ''").first()
    n_e, n_o = (got.e, got.o) if got else (0, 0)
    if n_e < _FEW:
        return FUNCTION_WORDS
    found = each.where((F.col("word") != "") & (F.col("e") >= share * n_e) & (F.col("e") / n_e >= contrast * F.col("o") / max(n_o, 1)))
    return frozenset(r.word for r in found.select("word").collect())


def train(docs: DataFrame, labels: DataFrame, train_rows: int = 20_000, least: int = 60, terms_kept: int = 900, pairs: int = 50_000, steps: int = 150) -> Model:
    """A model from at most about `train_rows` rated documents, and the words of as many in other languages (both chosen by hash)."""
    rated = ratings_of(labels)
    some = _sampled(rated, rated.count(), train_rows)
    lang = F.lower(F.trim("lang")) if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select("doc_id", "text", lang.alias("lang"))
    foreign = F.col("lang").rlike("^[a-z]{2}") & ~F.col("lang").rlike("^(en|un|no)")  # a language is told, and it isn't English
    n_foreign = rows.where(foreign).count() if "lang" in docs.columns else 0
    chance = int(min(1.0, train_rows / max(n_foreign, 1)) * (1 << 30))
    rows = rows.join(F.broadcast(some), "doc_id", "left")  # `some` is bounded by train_rows
    rows = durable(rows.where(F.col("rating").isNotNull() | (foreign & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < chance))).select("doc_id", "text", "rating"))
    marks = marking_words(rows)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, feats, names, counts, size = [], [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                sentences, words, _ = parse(t, marks=marks)
                if words >= least:
                    keep.append(i)
                    feats.append(syntax(sentences))
                    got = terms(sentences)
                    names.append([w if isinstance(w, str) else " ".join(w) for w in got])
                    counts.append(list(got.values()))
                    size.append(max(1, sum(len(w) for _, w in sentences)))
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(2).take(at), pa.array(feats, pa.list_(pa.float64())), pa.array(names, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int32())), pa.array(size, pa.int32())], ["doc_id", "rating", "syntax", "terms", "counts", "size"])

    kind = dict(docs.dtypes)["doc_id"]
    read = durable(rows.where("rating is not null").mapInArrow(clean, f"doc_id {kind}, rating double, syntax array<double>, terms array<string>, counts array<int>, size int"))
    n = read.count()
    often = read.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(3, n // 400))
    kept = [r.t for r in often.orderBy(F.desc("n"), "t").limit(terms_kept).collect()]
    place = {w: i for i, w in enumerate(kept)}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, part = [], []
            for names, counts, size in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(5).to_pylist()):
                known = [(i, c / size) for w, c in zip(names, counts) if (i := place.get(w)) is not None]
                at.append([i for i, _ in known])
                part.append([c for _, c in known])
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(at, pa.list_(pa.int32())), pa.array(part, pa.list_(pa.float32()))], ["doc_id", "rating", "syntax", "at", "part"])

    got = read.mapInArrow(encode, f"doc_id {kind}, rating double, syntax array<double>, at array<int>, part array<float>").toArrow().combine_chunks()
    x = np.zeros((got.num_rows, _SYNTAX + len(kept)), np.float32)
    y = np.zeros(0)
    if got.num_rows:
        got = got.sort_by("doc_id")  # one order, whatever the partitions
        flat = lambda c: got.column(c).combine_chunks()
        x[:, :_SYNTAX] = flat("syntax").flatten().to_numpy().reshape(-1, _SYNTAX)
        x[np.repeat(np.arange(len(x)), flat("at").value_lengths().to_numpy()), _SYNTAX + flat("at").flatten().to_numpy()] = flat("part").flatten().to_numpy()
        y = flat("rating").to_numpy()
    del got
    model = learn(x, y, [tuple(w.split(" ")) if " " in w else w for w in kept], pairs=pairs, steps=steps)
    model.marks = marks
    return model


def reading_level(docs: DataFrame, labels: DataFrame, least: int = 60, prose: float = 0.5) -> DataFrame:
    """(doc_id, level, score, words) of every document with at least `least` words of English sentences as its main content.

    The main content is English if English sentences hold at least the share `prose` of the words outside of code and logs.
    Null, empty and blank texts, other languages, code and logs have no level. A document id that occurs twice is levelled
    twice. A column `lang`, if there is one, only tells which texts are surely not English, for learning what is. Other columns are ignored; without labels every document has level 1; an empty table gives an empty result."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, least=least))  # about 1,000 terms and weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                b = whole.slice(lo, 1024)
                keep, score, count = [], [], []
                for i, t in enumerate(b.column(1).to_pylist()):
                    sentences, words, share = parse(t, marks=m.marks)
                    if words >= least and share >= prose:
                        keep.append(i)
                        score.append(m.score_one(sentences))
                        count.append(words)
                if keep:
                    score = np.array(score)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), pa.array(m.level(score).astype(np.int32)), pa.array(score), pa.array(count, pa.int32())], ["doc_id", "level", "score", "words"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, level int, score double, words int")
