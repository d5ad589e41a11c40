"""Languages of documents and of the runs of paragraphs in mixed documents.

Classifier: sparse multinomial logistic regression on TF-IDF character n-grams (1 to 3
characters, hashed), trained with follow-the-regularised-leader (FTRL-proximal) under elastic
net penalties, then calibrated by one temperature on held-out rows. It is fitted on a bounded
sample of labelled rows (`PER_LANGUAGE` texts for each language, chosen by a hash of the
text); the document frequencies cover all texts. Labels may be wrong, so the rows a first fit
firmly contradicts are left out of the second.

Scoring runs in Arrow batches: n-gram identifiers of a whole batch are computed in numpy,
weights are gathered and summed by paragraph. A mixed document is cut by a Viterbi pass over
its paragraphs with a price for each change of language, so a short paragraph of names does
not make a run of its own.

Defined results: null and empty texts, and texts without any letter, have no language and
give no row; empty paragraphs join the run before them (the first run, where there is none
before); texts may be of any length; repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANGUAGES = ["en", "de", "fr", "es", "pt", "ru", "zh", "ja", "ko"]

# Common codes and names of the languages, without region.
LABELS = {
    "en": "en eng english anglais englisch inglés inglês",
    "de": "de deu ger german deutsch allemand alemán alemão",
    "fr": "fr fra fre french français francais französisch francés francês",
    "es": "es spa spanish español espanol castellano spanisch espagnol",
    "pt": "pt por portuguese português portugues portugiesisch portugais",
    "ru": "ru rus russian русский russisch russe",
    "zh": "zh zho chi chinese cn cmn ch chi_sim chi_tra mandarin chinesisch chinois 中文 汉语 漢語",
    "ja": "ja jpn jp japanese japan japanisch japonais 日本語",
    "ko": "ko kor kr korean koreanisch coréen 한국어",
}

# Frequent words, so that a language without labelled rows is known at all.
SEED = {
    "en": "the of and to in is that which wherein with for said comprising between from one of the claims is provided",
    "de": "der die das und ist nicht mit dem einer von für wobei auf werden durch zwischen nach einem der ansprüche",
    "fr": "le la les des et est dans une que pour par dont avec selon entre sur lequel au moins une des revendications",
    "es": "el la los las de que y en un por con para según entre sobre al menos una de las reivindicaciones donde",
    "pt": "o a os as de que e em um por com para segundo entre pelo menos uma das reivindicações não são em que",
    "ru": "и в на с по что который между от для из способ устройство отличающийся тем что по одному из пунктов",
    "zh": "的 一种 其中 所述 方法 装置 和 在 根据 权利要求 包括 至少 用于 之间",
    "ja": "の に を は が と で する こと から および 方法 装置 請求項 少なくとも 間 により",
    "ko": "의 에 를 은 는 이 가 과 하는 방법 장치 청구항 적어도 사이 따른 및",
}

BITS = 16  # hashed n-grams: 65,536 features
PER_LANGUAGE = 300  # labelled texts per language at most
PIECE = 30  # characters of the pieces on which the temperature is fitted
SWITCH = 5.0  # price of a change of language between paragraphs, in nats


def label_language(label: Column) -> Column:
    """The language a label names (any case, with or without region), else null."""
    low = F.lower(F.trim(label))
    pairs = [F.lit(x) for lang, names in LABELS.items() for n in names.split() for x in (n, lang)]
    table = F.create_map(*pairs)
    bare = F.regexp_extract(low, r"^([\p{L}]+)(?:[-_ (].*)?$", 1)
    return F.coalesce(F.element_at(table, low), F.element_at(table, bare))


MARK = "\ue000"  # begins a text; a private character


@cache
def _letters() -> np.ndarray:
    """Whether a code point below 0xFFFF is a letter; all above count as letters."""
    out = np.array([chr(c).isalnum() and not chr(c).isdecimal() for c in range(0xFFFF)] + [True])
    out[0xE000:0xF900] = False
    return out


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts in lower case, each text between a mark (10) and spaces, with
    anything between letters as one space; and the positions of the marks."""
    bare = [t.replace(MARK, " ") if MARK in t else t for t in texts]
    joined = f"{MARK} " + f" {MARK} ".join(bare) + " "
    codes = np.frombuffer(joined.lower().encode("utf-32-le"), np.uint32)
    letter = _letters()[np.minimum(codes, 0xFFFF)]
    mark = codes == 0xE000
    solid = letter | mark
    keep = solid.copy()
    keep[1:] |= solid[:-1]  # a space after a letter or mark
    codes = np.where(letter, codes, np.where(mark, np.uint32(10), np.uint32(32)))[keep]
    return codes, np.flatnonzero(codes == 10)


def _hashed(codes: np.ndarray) -> list[np.ndarray]:
    """Hashed 1-, 2- and 3-gram that begins at each position; those that reach over a mark or
    hold nothing but a space get the number 2 ** BITS."""
    out, key, bad = [], np.zeros(len(codes), np.uint32), np.zeros(len(codes), bool)
    for n in range(3):
        part = codes[n:]
        key = key[: len(part)] * np.uint32(0x01000193) ^ part
        bad = bad[: len(part)] | (part == 10)
        mixed = (key ^ (key >> np.uint32(15))) * np.uint32(0x9E3779B1 + 2 * n)
        ids = (mixed >> np.uint32(32 - BITS)).astype(np.int32)
        ids[bad | (part == 32) if n == 0 else bad] = 2**BITS
        out.append(ids)
    return out


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(feature, index of the text) of every character 1- to 3-gram of the texts."""
    codes, marks = _codes(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(np.append(marks, len(codes))))
    parts = [(ids, owner[: len(ids)]) for ids in _hashed(codes)]
    ids, rows = np.concatenate([i for i, _ in parts]), np.concatenate([r for _, r in parts])
    good = ids < 2**BITS
    return ids[good].astype(np.int64), rows[good]


@dataclass
class Model:
    """weights (features x languages) times idf, bias and temperature of the classifier."""

    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    @cached_property
    def table(self) -> np.ndarray:
        """Rows of 32 bytes: only differences of scores matter, so the last language is 0. Built
        once in each worker."""
        out = np.zeros((2**BITS + 1, len(LANGUAGES) - 1), np.float32)
        out[:-1] = self.weights[:, :-1] - self.weights[:, -1:]
        return out

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "table"}

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities (texts x languages) and the number of letters' n-grams."""
        # The weights of the n-grams at a position are added up, then those of a text by
        # sums between its marks: one gather of a row of weights for each n-gram.
        if not texts:
            return np.zeros((0, len(LANGUAGES))), np.zeros(0)
        codes, marks = _codes(texts)
        table = self.table
        at = np.zeros((len(codes), len(LANGUAGES) - 1), np.float32)
        row, total = np.empty_like(at), np.zeros(len(texts))
        for ids in _hashed(codes):
            at[: len(ids)] += np.take(table, ids, axis=0, out=row[: len(ids)], mode="clip")
            total += np.add.reduceat(np.append(ids < 2**BITS, np.zeros(len(codes) - len(ids), bool)), marks, dtype=np.int64)
        raw = np.zeros((len(texts), len(LANGUAGES)))
        raw[:, :-1] = np.add.reduceat(at, marks, axis=0)
        raw = (raw / np.sqrt(np.maximum(total, 1))[:, None] + self.bias) / self.temperature
        return _log_softmax(raw), total


class Ftrl:
    """FTRL-proximal for a multinomial logistic regression with L1 and L2 penalties."""

    def __init__(self, alpha: float = 0.1, beta: float = 1.0, l1: float = 0.2, l2: float = 1.0) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((2**BITS + 1, len(LANGUAGES)))
        self.n = np.zeros_like(self.z)

    def weights(self, rows: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, features: np.ndarray, values: np.ndarray, language: int) -> None:
        w = self.weights(features)
        s = values @ w
        p = np.exp(s - s.max())
        p /= p.sum()
        p[language] -= 1
        g = np.outer(values, p)
        n = self.n[features]
        root = np.sqrt(n + g * g)
        self.z[features] += g - (root - np.sqrt(n)) / self.alpha * w
        self.n[features] = n + g * g


def _vectors(texts: list[str], idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    ids, rows = grams(texts)
    out = []
    order = np.argsort(rows, kind="stable")
    ids, bounds = ids[order], np.searchsorted(rows[order], np.arange(len(texts) + 1))
    for a, b in zip(bounds, bounds[1:]):
        f, n = np.unique(ids[a:b], return_counts=True)
        x = n * idf[f] / np.sqrt(max(b - a, 1))
        out.append((np.append(f, 2**BITS), np.append(x, 1.0)))  # the last feature is the bias
    return out


def _log_softmax(scores: np.ndarray) -> np.ndarray:
    scores = scores - scores.max(axis=1, keepdims=True)
    return scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))


def fit(texts: list[str], languages: list[str], idf: np.ndarray, epochs: tuple[int, ...] = (1, 2, 3)) -> Model:
    """The model of labelled texts; every fifth text is held out for the temperature."""
    texts = [*texts, *SEED.values()]
    target = [LANGUAGES.index(x) for x in [*languages, *SEED]]
    vectors = _vectors(texts, idf)
    held = np.arange(len(texts)) % 5 == 4
    held[-len(SEED) :] = False
    rng = np.random.default_rng(0)
    keep = ~held
    for n in epochs:  # the first fit is short, so that it doesn't learn wrong labels by heart
        learner = Ftrl()
        for _ in range(n):
            for i in rng.permutation(np.flatnonzero(keep)):
                learner.learn(*vectors[i], target[i])
        w = learner.weights(slice(None))
        logits = np.array([x @ w[f] for f, x in vectors])
        best = logits.max(axis=1)
        own = logits[np.arange(len(texts)), target]
        keep = ~held & (own >= best)  # the next fit leaves out rows whose label this one contradicts
    # Whole texts are told apart without error, so the temperature is fitted on short pieces of
    # the held-out texts; wrong labels say nothing about confidence and are left out.
    pieces = [(texts[i][k : k + PIECE], target[i]) for i in np.flatnonzero(held & (own >= best - 1)) for k in range(0, len(texts[i]), PIECE)]
    temperature = 1.0
    if pieces:
        vectors = _vectors([t for t, _ in pieces], idf)
        logits, right = np.array([x @ w[f] for f, x in vectors]), np.array([k for _, k in pieces])
        grid = np.geomspace(0.05, 5, 60)
        temperature = float(min(grid, key=lambda t: -_log_softmax(logits / t)[np.arange(len(right)), right].mean()))
    return Model((w[:-1] * idf[:, None]).astype(np.float32), w[-1], temperature)


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """idf of each hashed n-gram over all rows of the one text column; the result that comes
    to the driver has 2 ** BITS rows at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(2**BITS, np.int64), 0
        for batch in batches:
            part = [t for t in batch.column(0).to_pylist() if t]
            for k in range(0, len(part), 64):
                flags = np.zeros((64, 2**BITS + 1), np.bool_)
                codes, marks = _codes(part[k : k + 64])
                owner = np.repeat(np.arange(len(marks)), np.diff(np.append(marks, len(codes))))
                for ids in _hashed(codes):
                    flags[owner[: len(ids)], ids] = True
                seen += flags[:, :-1].sum(axis=0, dtype=np.int64)
            n += len(part)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"feature": np.append(at, -1), "n": np.append(seen[at], n)})

    rows = texts.mapInArrow(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    found = {r.feature: r.n for r in rows}
    total, df = found.pop(-1, 0), np.zeros(2**BITS)
    df[list(found)] = list(found.values())
    return np.log((1 + total) / (1 + df)) + 0.5


def training_sample(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """`labelled` has text, label. At most about `per_language` texts of each language by a
    hash of the text: the label counts of all rows give the share to keep, so no group is ever
    gathered in one task."""
    rows = labelled.select("text", label_language(F.col("label")).alias("lang")).filter("lang is not null and length(text) >= 20")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    share = F.broadcast(counts.select("lang", (F.lit(float(per_language)) / F.col("n")).alias("share")))  # one row a language
    at = F.pmod(F.xxhash64("text"), F.lit(1_000_000)) / F.lit(1_000_000.0)
    return rows.join(share, "lang").filter(at < F.col("share")).select("text", "lang")


def train(texts: DataFrame, labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Fits the classifier: document frequencies over all `texts` (column text), weights on a
    bounded sample of `labelled` (text, label)."""
    rows = sorted((r.lang, r.text) for r in training_sample(labelled, per_language).distinct().collect())
    return fit([t for _, t in rows], [x for x, _ in rows], document_frequencies(texts))


def runs(log_p: np.ndarray, weight: np.ndarray, switch: float = SWITCH) -> list[tuple[int, int, float]]:
    """Viterbi over the paragraphs of one text: (first paragraph, language, confidence) of
    each run of one language. Paragraphs of no weight (no letters) follow their neighbours."""
    live = np.flatnonzero(weight > 0)
    if not len(live):
        return []
    gain, back = log_p[live[0]].copy(), []
    for i in live[1:]:
        best = int(gain.argmax())
        stay = gain >= gain[best] - switch
        back.append(np.where(stay, np.arange(len(gain)), best))
        gain = np.where(stay, gain, gain[best] - switch) + log_p[i]
    path = [int(gain.argmax())]
    for step in reversed(back):
        path.append(int(step[path[-1]]))
    path.reverse()
    out: list[tuple[int, int, float]] = []
    start = 0
    for k in range(1, len(path) + 1):
        if k == len(path) or path[k] != path[start]:
            w = weight[live[start:k]]
            p = np.exp(log_p[live[start:k], path[start]])
            out.append((0 if not out else int(live[start]), path[start], float((p * w).sum() / w.sum())))
            start = k
    return out


def segments(texts: DataFrame, model: Model) -> DataFrame:
    """`texts` has rec, rec_id, label, mixed (whether paragraphs are judged one by one), text.
    Rows rec, rec_id, label, seg_no, lang, confidence, n_segments of each run."""
    schema = "rec string, rec_id bigint, label string, seg_no int, lang string, confidence double, n_segments int"
    shared = texts.sparkSession.sparkContext.broadcast(model)  # of a fixed size: 2 ** BITS rows

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            rows = [r for r in batch.to_pylist() if r["text"]]
            out, part, size = [], [], 0
            for r in rows:
                part.append(r)
                size += len(r["text"])
                if size > 400_000:
                    out += _judged(part, model)
                    part, size = [], 0
            out += _judged(part, model)
            names = ["rec", "rec_id", "label", "seg_no", "lang", "confidence", "n_segments"]
            types = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.float64(), pa.int32()]
            cols = list(zip(*out)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return texts.select("rec", "rec_id", "label", "mixed", "text").mapInArrow(judge, schema)


def _judged(rows: list[dict], model: Model) -> list[tuple]:
    if not rows:
        return []
    parts = [r["text"].split("\n\n") if r["mixed"] else [r["text"]] for r in rows]
    log_p, weight = model.scores([p for ps in parts for p in ps])
    out, at = [], 0
    for r, ps in zip(rows, parts):
        found = runs(log_p[at : at + len(ps)], weight[at : at + len(ps)])
        at += len(ps)
        out += [(r["rec"], r["rec_id"], r["label"], n, LANGUAGES[k], c, len(found)) for n, k, c in found]
    return out


def stacked(responses: DataFrame, pages: DataFrame, documents: DataFrame) -> DataFrame:
    """The labelled texts of the three tables: rec, rec_id, label, mixed, text."""

    def part(df: DataFrame, rec: str, key: str, label: str, text: str, mixed: bool) -> DataFrame:
        return df.select(
            F.lit(rec).alias("rec"), F.col(key).cast("bigint").alias("rec_id"), F.col(label).alias("label"), F.lit(mixed).alias("mixed"), F.col(text).alias("text")
        )

    return (
        part(responses, "published", "response_id", "publication_language", "abstract", False)
        .unionByName(part(responses, "filed", "response_id", "filing_language", "filed_abstract", False))
        .unionByName(part(pages, "page", "page_id", "language", "text", False))
        .unionByName(part(documents, "document", "doc_id", "lang", "text", True))
        .filter("text is not null and text <> ''")
    )


def found(responses: DataFrame, pages: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows (rec, rec_id, seg_no, lang) of the records whose label is missing, names no
    language or another one than their first text, or that are in more than one language."""
    texts = stacked(responses, pages, documents)
    first = F.when(F.col("mixed"), F.split_part("text", F.lit("\n\n"), F.lit(1))).otherwise(F.col("text"))
    model = train(texts.select("text"), texts.select(first.alias("text"), "label"))
    judged = segments(texts, model).withColumn("stated", label_language(F.col("label")))
    # With one run its language is that of the first text; with more every run is a case. So
    # no row needs its neighbours.
    case = F.col("stated").isNull() | (F.col("n_segments") > 1) | (F.col("lang") != F.col("stated"))
    return judged.filter(case).select("rec", "rec_id", "seg_no", "lang").distinct()
