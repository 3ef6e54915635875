"""Toxicity classifier: gradient-boosted trees over dense features.

1. A lexicon is mined from at most ``SAMPLE`` labelled rows outside the held-out
   fold: lower-cased words and word beginnings of ``PREFIXES`` letters, with the
   number of toxic and other documents they occur in, counted on Spark.  Entries
   whose smoothed log odds reach ``LEAST_ODDS`` stay, the best ``ENTRIES`` of them.
   A short fixed list of common insults is added.  Words are compared after
   undoing digits and signs put for letters, and single letters spelled out.
2. Features (``FEATURES``) of the whole text: densities and peaks of lexicon hits,
   hits near the second person, capitals, punctuation and obfuscation rates.
   For training they come from lexicons mined without the row's own part
   of the sample, else a rare word of a training row would look like proof.
3. Boosted trees on quantile bins with logistic loss, and isotonic calibration
   on predictions for parts that the trees were not fitted on.

Labels, language, source and id are no inputs of a score.  A null text counts
as empty.  Without labelled rows of both classes every score is the share of
label 1 (0 without any labels).
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, label_sample, labelled_rows, written

FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3
#: labelled rows fitted on, lexicon entries kept, parts for cross-fitting
SAMPLE, ENTRIES, PARTS = 20_000, 5_000, 3
PREFIXES = range(3, 9)
LEAST_ODDS, LEAST_DOCS = 2.0, 3

# Common insults and second-person words of four languages.
INSULTS = ["idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic",
           "disgusting", "clown", "dumb", "fool", "imbecile", "garbage", "dummkopf", "trottel",
           "abschaum", "crétin", "imbécile", "ordure", "estúpido", "imbécil", "basura", "idiota"]
SECOND_PERSON = ["you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein",
                 "deine", "tu", "te", "toi", "ton", "ta", "vous", "votre", "ti", "usted", "vos"]

FEATURES = ["hits", "hit_density", "odds_top", "odds_second", "odds_third", "odds_density",
            "insults", "insult_density", "near_person", "obfuscated_hits", "capitals",
            "exclamations", "punctuation", "obfuscation", "words"]

_PLAIN = str.maketrans("013457@$!", "oieastasi")
_OUTER = "!?.,;:'\"()[]{}*_-%&#|/"
_CORE = re.compile(r"^[\W_]+|[\W_]+$")
_ODD = re.compile(r"[\W\d_]")


def plain_words(text: str | None) -> list[tuple[str, bool]]:
    """(lower-cased word without outer marks, obfuscated?) for the words of a
    text; runs of three and more single letters are read as one word."""
    out, run = [], []

    def end():
        if len(run) >= 3:
            out.append(("".join(run), True))
        else:
            out.extend((x, False) for x in run)
        run.clear()

    for raw in (text or "").lower().split():
        core = raw if raw.isalpha() else _CORE.sub("", raw)
        if len(core) == 1 and core.isalpha():
            run.append(core)
            continue
        if run:
            end()
        if core.isalpha() and raw[0] not in "$@":
            out.append((core, False))
        elif core:
            fixed = _ODD.sub("", raw.strip(_OUTER).translate(_PLAIN))
            if any(c.isalpha() for c in core) and fixed:
                out.append((fixed, True))
    end()
    return out


def _marks(words) -> set:
    """Lexicon candidates of a document."""
    own = set(w for w, _ in words)
    return own | {w[:k] for w in own for k in PREFIXES if len(w) > k}


class Lexicon:
    """Entry -> log odds; a word has the odds of its best entry."""

    def __init__(self, counts: pd.DataFrame, toxic: int, other: int):
        """counts: mark, toxic, other (documents that hold the mark)."""
        odds = (np.log((counts["toxic"] + 0.5) / (toxic + 1.0))
                - np.log((counts["other"] + 0.5) / (other + 1.0)))
        ok = (odds >= LEAST_ODDS) & (counts["toxic"] >= LEAST_DOCS)
        top = counts[ok].assign(odds=odds[ok])
        top = top.assign(gain=top["odds"] * top["toxic"]).sort_values(
            ["gain", "mark"], ascending=[False, True])[:ENTRIES]
        self.odds = dict(zip(top["mark"], top["odds"].astype(float)))
        self.known: dict = {}

    def of(self, word: str) -> float:
        got = self.known.get(word)
        if got is None:
            odds = self.odds
            got = max([odds.get(word, 0.0)] + [odds.get(word[:k], 0.0) for k in PREFIXES
                                               if len(word) > k])
            if len(self.known) < 500_000:   # a memo; what does not fit is looked up again
                self.known[word] = got
        return got

    def __getstate__(self):
        return {"odds": self.odds, "known": {}}


_INSULTS, _PERSON = frozenset(INSULTS), frozenset(SECOND_PERSON)


def features(text: str | None, words: list, lexicon: Lexicon) -> list[float]:
    """The dense features of one text, in the order of ``FEATURES``."""
    text = text or ""
    n = max(1, len(words))
    of = lexicon.of
    odds = [of(w) for w, _ in words]
    hits = [k for k, o in enumerate(odds) if o]
    best = sorted((odds[k] for k in hits), reverse=True)[:3] + [0.0] * 3
    insults = [k for k, (w, _) in enumerate(words) if w in _INSULTS]
    person = [k for k, (w, _) in enumerate(words) if w in _PERSON] if hits or insults else []
    near = 0
    if person:
        at = np.array(sorted({*hits, *insults}))
        near = int((np.abs(np.searchsorted(person, at + 6) - np.searchsorted(person, at - 5)) > 0).sum())
    letters = sum(map(str.isupper, text))
    size = max(1, len(text))
    return [
        np.log1p(len(hits)), len(hits) / n, best[0], best[1], best[2], sum(odds) / n,
        np.log1p(len(insults)), len(insults) / n, np.log1p(near),
        sum(1 for k in hits if words[k][1]) / n, letters / size,
        text.count("!") / size, (text.count(".") + text.count(",") + text.count("?")) / size,
        sum(1 for _, odd in words if odd) / n, np.log1p(len(words)),
    ]


# ------------------------------------------------------------ trees


class Boosted:
    """Boosted depth-wise trees on quantile bins, logistic loss."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48,
                 least: float = 3.0, ridge: float = 1.0):
        self.n, self.depth, self.rate, self.bins = trees, depth, rate, bins
        self.least, self.ridge = least, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        self.cuts = [np.unique(np.quantile(col[np.isfinite(col)], np.linspace(0, 1, self.bins + 1)[1:-1]))
                     for col in x.T]
        for k, col in enumerate(x.T):   # mostly zero columns: cuts inside the rest too
            rest = col[col > col.min()]
            if len(rest) and len(rest) < 0.2 * len(col):
                self.cuts[k] = np.unique(np.concatenate((
                    self.cuts[k], [(col.min() + rest.min()) / 2],
                    np.quantile(rest, np.linspace(0, 1, self.bins // 2)))))
        b = self._bin(x)
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(rate / (1 - rate)))
        f = np.full(len(y), self.start)
        self.trees = []
        for _ in range(self.n):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(b, p - y, p * (1 - p))
            self.trees.append(tree)
            f += self._value(tree, b)
        return self

    def _bin(self, x):
        return np.column_stack([np.searchsorted(c, col, side="right") for c, col in zip(self.cuts, x.T)])

    def _grow(self, b, grad, hess):
        """Complete tree: (feature, bin) of the inner nodes, values of the leaves."""
        split = [(0, 1 << 30)] * ((1 << self.depth) - 1)
        at = np.zeros(len(grad), np.int64)
        for level in range(self.depth):
            first, width = (1 << level) - 1, 1 << level
            local = at - first
            best = np.full(width, 1e-6)
            for k in range(b.shape[1]):
                size = len(self.cuts[k]) + 1
                cell = local * size + b[:, k]
                g = np.bincount(cell, grad, width * size).reshape(width, size).cumsum(1)
                h = np.bincount(cell, hess, width * size).reshape(width, size).cumsum(1)
                all_g, all_h = g[:, -1:], h[:, -1:]
                gain = (g ** 2 / (h + self.ridge) + (all_g - g) ** 2 / (all_h - h + self.ridge)
                        - all_g ** 2 / (all_h + self.ridge))
                gain[(h < self.least * 0.1) | (all_h - h < self.least * 0.1)] = 0
                top = gain[:, :-1].argmax(1) if size > 1 else np.zeros(width, int)
                for node in np.flatnonzero(gain[np.arange(width), top] > best):
                    best[node] = gain[node, top[node]]
                    split[first + node] = (k, int(top[node]))
            where = np.array([split[i] for i in range(first, first + width)])
            right = b[np.arange(len(b)), where[local, 0]] > where[local, 1]
            at = 2 * at + 1 + right
        leaf = at - ((1 << self.depth) - 1)
        g = np.bincount(leaf, grad, 1 << self.depth)
        h = np.bincount(leaf, hess, 1 << self.depth)
        return np.array(split), -self.rate * g / (h + self.ridge)

    def _value(self, tree, b):
        split, value = tree
        at = np.zeros(len(b), np.int64)
        rows = np.arange(len(b))
        for _ in range(self.depth):
            at = 2 * at + 1 + (b[rows, split[at, 0]] > split[at, 1])
        return value[at - ((1 << self.depth) - 1)]

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self._bin(x)
        return self.start + sum((self._value(t, b) for t in self.trees), np.zeros(len(x)))


class Isotonic:
    """Least-squares rising step function (pool adjacent violators), linear
    between the steps' centres."""

    def __init__(self, margin: np.ndarray, y: np.ndarray):
        order = np.argsort(margin, kind="stable")
        blocks: list = []                    # weight, label sum, margin sum
        for m, v in zip(margin[order].tolist(), y[order].tolist()):
            blocks.append([1, v, m])
            while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
                w, s, c = blocks.pop()
                blocks[-1] = [blocks[-1][0] + w, blocks[-1][1] + s, blocks[-1][2] + c]
        self.x = np.array([c / w for w, _, c in blocks])
        self.y = np.array([s / w for w, s, _ in blocks])

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        # a small share of the logistic keeps the order inside a step
        return (0.995 * np.interp(margin, self.x, self.y)
                + 0.005 / (1 + np.exp(-np.clip(margin, -30, 30))))


class ToxicityModel:
    def __init__(self, lexicon: Lexicon, trees: Boosted | None, calibrate, share: float):
        self.lexicon, self.trees, self.calibrate, self.share = lexicon, trees, calibrate, share

    def score(self, texts: list) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.share)
        x = np.array([features(t, plain_words(t), self.lexicon) for t in texts], float)
        return self.calibrate(self.trees.margin(x.reshape(len(texts), len(FEATURES))))


# ------------------------------------------------------------ Spark


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = FOLDS,
        held_out: int = HELD_OUT, bound: int = SAMPLE, id_col: str = "doc_id",
        text_col: str = "text") -> ToxicityModel:
    """Train on the documents of the bounded label sample, at most ``bound`` distinct ids and
    texts; rows that repeat count once."""
    sample = label_sample(labels, label, folds, held_out, bound)
    rows = written(
        labelled_rows(docs, sample, bound, id_col, text_col)
        .select("label", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(PARTS)).cast("int").alias("part"),
                "text", "name"), "toxicity-sample")

    def count(batches):
        """Per task one row for each mark and part: documents with it, by class."""
        seen: dict = {}
        for pdf in batches:
            for y, part, text in zip(pdf["label"], pdf["part"], pdf["text"]):
                for mark in _marks(plain_words(text)):
                    seen.setdefault(mark, [0] * (2 * PARTS))[2 * part + y] += 1
        # a mark without toxic documents in the task still counts against it elsewhere
        if seen:
            got = np.array(list(seen.values()), np.int64).reshape(len(seen), PARTS, 2)
            yield pd.DataFrame({"mark": list(seen), "toxic": list(got[:, :, 1]),
                                "other": list(got[:, :, 0])})

    marks = rows.mapInPandas(count, "mark string, toxic array<long>, other array<long>")
    col = lambda c, k: F.sum(F.col(c)[k]).alias(f"{c}{k}")
    summed = marks.groupBy("mark").agg(*[col(c, k) for k in range(PARTS) for c in ("toxic", "other")])
    toxic = sum(F.col(f"toxic{k}") for k in range(PARTS))
    other = sum(F.col(f"other{k}") for k in range(PARTS))
    sizes = {(r["part"], r["label"]): r["count"]
             for r in rows.groupBy("part", "label").count().collect()}
    total = [sum(n for (_, y), n in sizes.items() if y == c) for c in (0, 1)]
    share = total[1] / sum(total) if sum(total) else 0.0
    if not all(total):
        return ToxicityModel(Lexicon(pd.DataFrame({"mark": [], "toxic": [], "other": []}), 0, 0),
                             None, None, share)
    # only marks near the required odds go on, the best of a bounded number
    odds = F.log((toxic + 0.5) / (total[1] + 1)) - F.log((other + 0.5) / (total[0] + 1))
    counts = summed.where((toxic >= LEAST_DOCS) & (odds >= LEAST_ODDS - 1)).orderBy(
        F.desc(odds * toxic), "mark").limit(4 * ENTRIES).toPandas()

    def lexicon(parts) -> Lexicon:
        c = pd.DataFrame({"mark": counts["mark"]})
        for k, kind in ((1, "toxic"), (0, "other")):
            c[kind] = sum((counts[f"{kind}{p}"] for p in parts), pd.Series(0, index=counts.index))
        n = [sum(sizes.get((p, y), 0) for p in parts) for y in (1, 0)]
        return Lexicon(c, *n)

    everything = range(PARTS)
    without = [lexicon([p for p in everything if p != k]) for k in everything]

    def describe(batches):
        for pdf in batches:
            x = [features(t, plain_words(t), without[p]) for t, p in zip(pdf["text"], pdf["part"])]
            yield pd.DataFrame({"label": pdf["label"], "part": pdf["part"], "x": x, "name": pdf["name"]})

    # at most `bound` rows of a few numbers reach the driver
    got = rows.mapInPandas(describe, "label int, part int, x array<double>, name string").toPandas().sort_values("name")
    x, y, part = np.vstack(got["x"]), got["label"].to_numpy(float), got["part"].to_numpy()
    margin = np.zeros(len(y))
    for k in everything:
        own = part == k
        if own.any():
            margin[own] = (Boosted().fit(x[~own], y[~own]).margin(x[own])
                           if 0 < y[~own].sum() < (~own).sum() else 0.0)
    return ToxicityModel(lexicon(everything), Boosted().fit(x, y), Isotonic(margin, y), share)


def add_scores(docs: DataFrame, model: ToxicityModel, text_col: str = "text",
               score_col: str = "score") -> DataFrame:
    """``docs`` with the score column (one of that name is replaced), in one pass
    without a shuffle."""
    docs = docs.drop(score_col)
    schema = docs.select("*", F.lit(0.0).alias(score_col)).schema
    at = docs.columns.index(text_col)
    # the model, a bounded lexicon and some trees, goes out once per executor
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for b in batches:
            s = shared.value.score(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], schema.names)

    return docs.mapInArrow(score, schema)


def clean_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD,
                    text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the classifier rejects, columns unchanged."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, text_col=text_col))
    at = docs.columns.index(text_col)

    def keep(batches):
        for b in batches:
            yield b.filter(pa.array(model.value.score(b.column(at).to_pylist()) < threshold))

    return docs.mapInArrow(keep, docs.schema)


def op5_toxicity_trees(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return add_scores(docs, model).select(
        "doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
