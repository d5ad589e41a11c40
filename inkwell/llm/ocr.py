"""Repair of text from scanned pages: running matter, broken words, misrecognised words.

Lines are read in the order of the page. Running headers and page numbers are recognised by
their form and leave the stream; a word broken over two lines is joined over whatever running
matter lies between. Misrecognised words are found by a noisy channel: every distinct word of
the corpus is undone by the inverse confusions of `CONFUSIONS`, what hits a word of the corpus
that is more frequent becomes an option, and a Viterbi pass over the options of a line picks
the sequence with the highest product of confusion probability and corpus bigram likelihood.

The probability of each confusion is estimated from the corpus by expectation maximisation:
the misreadings a confusion would cause among the words of the corpus are matched against the
words as read, over the occurrences of the character it needs.

Counts cover all texts. They are taken with the noise in them, so a word's own counts are
first reduced by what misreadings of its options would explain (`DOUBT` times the expected
number); a word that is nothing but a misreading keeps no likelihood of its own, while a right
word keeps that of the contexts its look-alikes don't have.

Two passes over the texts in Arrow batches: one counts, one emits the running lines and the
runs of neighbouring words that may be corrected. Which words have options is told to the
workers by a bit table of fixed size (`TABLE_BITS`); a word that it lets through without
options drops out at the join. Runs then meet their options, their bigrams and the decoder as
one row each. Defined results: null and empty texts give no rows; a text without line breaks is
one line; repeated rows give repeated results.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.session import cut, spread

# Characters as recognised, and what they stood for.
CONFUSIONS = [
    ("c", "e"), ("1", "i"), ("1", "l"), ("f", "t"), ("o", "a"), ("0", "o"), ("5", "s"), ("9", "g"), ("cl", "d"), ("(", "c"),
    ("n", "u"), ("b", "h"), ("rn", "m"), ("m", "rn"), ("6", "b"), ("6", "é"), ("vv", "w"), ("11", "ll"), ("rm", "nn"), ("g", "q"), ("a", "ä"),
    ("o", "ö"), ("u", "ü"), ("ii", "ü"), ("B", "ß"), ("e", "é"), ("e", "è"), ("l", "i"), ("i", "l"), ("u", "n"), ("ii", "n"), ("ri", "n"), ("li", "h"), ("h", "b"),
    ("0", "O"), ("1", "I"), ("l", "I"), ("5", "S"), ("8", "B"), ("6", "G"), ("G", "C"), ("e", "c"), ("t", "f"), ("y", "v"), ("vv", "W"), ("VV", "W"), ("D", "O"),
]

RATE = 0.03  # misread words among all words
PRIOR = 0.003  # probability of a confusion at one place before the corpus is looked at
START = 0.03  # and from which the estimation sets out: too high a rate comes down, too low a one may not rise
PRIOR_PLACES = 1000  # places in the corpus that weigh as much as that prior
ROUNDS = 4  # of the estimation of the confusions
DOUBT = 20.0  # times the expected misreadings that a word's own count must exceed
RATIO = 4  # times a word's count in distinct texts that an option must have, unless no right word looks like it
SHORTEST = 2  # letters of the shortest right word
SMOOTH = 5.0  # weight of the unigram in the bigram likelihood
UNSEEN = 1e-9
TABLE_BITS = 26  # of the table that says which words have options: 8 MB

_NO_MARKS = dict.fromkeys((1, 2, 3), "\ufffd")  # these set off the parts of keys and runs

_D = r"[0-9OoIl]"
_PUB = rf"(?:[A-Z]{{2}}\s?[/-]?\s?{_D}{{1,4}}(?:[\s./,-]{{0,2}}{_D}){{2,14}}(?:\s?[ABCTU]{_D}?)?)"
_PCT = rf"(?:PCT\s?/\s?[A-Z]{{2}}\s?{_D}{{2,4}}\s?/\s?{_D}{{3,7}})"
_REMARK = rf"(?:[A-Z]{{2}}\s(?:ref|case|file|Az|No|Nr|réf|ref\.?ª)\.?\s?:?\s?{_D}{{3,8}})"
_SHEET = r"(?:ERSATZBLATT|ERSATZBLÄTTER|GEÄNDERTES BLATT|(?:REPLACEMENT|SUBSTITUTE|AMENDED|CORRECTED|RECTIFIED) SHEETS?|FEUILLES? (?:DE REMPLACEMENT|RECTIFIÉES?|MODIFIÉES?)|HOJAS? (?:SUSTITUTIVAS?|DE REEMPLAZO|MODIFICADAS?))(?:\s?\(.{1,20}\))?"
HEADER = re.compile(rf"^\s*(?:{_PUB}|{_PCT}|{_REMARK}|{_SHEET})(?:\s+(?:{_PUB}|{_PCT}|{_REMARK}|{_D}{{1,3}}))*\s*$")
PAGENO = re.compile(
    r"^\s*(?:[-–—~=]{1,2}\s*\d{1,4}\s*[-–—~=]{1,2}|\[\s*\d{1,3}\s*\]|(?:(?:page|seite|p|s|pág|pag|página|blatt|sheet|feuille|hoja)\b\.?\s*)?\d{1,4}(?:\s*(?:/|of|von|de|sur|out of)\s*\d{1,4})?)\s*$",
    re.IGNORECASE,
)
_BREAKS = set("-‐‑\u00ad")
BREAK = re.compile(r"[^\W\d_]([-‐‑­])\s*$")
_TRIM = re.compile(r"^[^\w]+|[^\w]+$")
_NO_WORD = re.compile(r"[\d(]")  # no right word holds these beside letters
_NUMERAL = re.compile(r"[\d.,/%°x×()-]+[a-z]?")


def _unmarked(text: str) -> str:
    return text.translate(_NO_MARKS) if "\u0001" in text or "\u0002" in text or "\u0003" in text else text


def running(line: str) -> str | None:
    """`header` or `pageno` if the line is running matter, else None."""
    if HEADER.match(line):
        return "header"
    return "pageno" if PAGENO.match(line) else None


def core(chunk: str) -> str:
    """A chunk between spaces without surrounding punctuation; an opening bracket that is not
    closed and stands before letters may be a misread letter and stays."""
    if chunk.isalpha():
        return chunk
    word = _TRIM.sub("", chunk)
    at = chunk.find(word) if word else 0
    if word and at and chunk[at - 1] == "(" and ")" not in chunk and len(word) >= SHORTEST - 1 and word[0].islower():
        return "(" + word
    return word


def tokens(text: str) -> list[tuple[int, str, str, str]]:
    """(line, kind, word, other) in reading order: kind `word`, `hyphen` (word joined without,
    other with the hyphen; other empty for a soft hyphen), `header`, `pageno`."""
    out: list[tuple[int, str, str, str]] = []
    lines = text.split("\n")
    body = []
    for i, line in enumerate(lines):
        kind = running(line)
        if kind:
            out.append((i, kind, "", ""))
        else:
            body.append(i)
    taken = set()
    for k, i in enumerate(body):
        chunks = lines[i].split()
        first = 1 if i in taken else 0
        last = None
        m = BREAK.search(lines[i]) if lines[i].rstrip()[-1:] in _BREAKS else None
        if m and k + 1 < len(body) and len(chunks) > first:
            after = lines[body[k + 1]].split()
            head = _TRIM.sub("", after[0]) if after else ""
            tail = chunks[-1].rstrip("-‐‑­")
            if head and head[0].islower() and after[0][0].isalpha():
                last = (core(tail + head), "" if m.group(1) == "­" else core(f"{tail}-{head}"))
                taken.add(body[k + 1])
        for chunk in chunks[first : len(chunks) - 1 if last else None]:
            word = core(chunk)
            if word:
                out.append((i, "word", word, ""))
        if last:
            out.append((i, "hyphen", *last))
    return out


def lm_form(word: str) -> str:
    """The word as the language model counts it: numerals are one word."""
    return "#" if not word.isalpha() and _NUMERAL.fullmatch(word) else word


def undone(word: str) -> dict[str, tuple[str, tuple[int, ...]]]:
    """Words that one inverse confusion makes of `word` (two, where it holds a sign no word
    has), each with its displayed form (the case of the first letter is kept) and the numbers
    of the confusions."""
    starts = [(word, False)]
    if word[:1].isupper() and word[1:2].islower():
        starts.append((word[0].lower() + word[1:], True))
    out: dict[str, tuple[str, tuple[int, ...]]] = {}
    for start, lowered in starts:
        found = {w: (k,) for w, k in _once(start).items()}
        if _NO_WORD.search(start):
            for first, (k,) in list(found.items()):
                for w, j in _once(first).items():
                    found.setdefault(w, (k, j))
        for w, path in found.items():
            if w not in (start, word) and len(w) >= SHORTEST and not _NO_WORD.search(w):
                out.setdefault(w, (w[0].upper() + w[1:] if lowered else w, path))
    return out


def _once(word: str) -> dict[str, int]:
    """Words that one inverse confusion makes of `word`, and its number."""
    out: dict[str, int] = {}
    for k, (seen, meant) in enumerate(CONFUSIONS):
        i = word.find(seen)
        while i >= 0:
            out.setdefault(word[:i] + meant + word[i + len(seen) :], k)
            i = word.find(seen, i + 1)
    return out


def _correctable(word: str) -> bool:
    if len(word) < SHORTEST - 1 or word.isalpha():
        return len(word) >= SHORTEST - 1
    return not _NUMERAL.fullmatch(word) and any(c.isalpha() for c in word)


WORD, PAIR, BROKEN = 0, 1, 2  # what a count is of


def counts(texts: DataFrame) -> DataFrame:
    """(kind, key, n, once): words, bigrams (`first U+0002 second`) and broken words (`joined
    U+0002 with its hyphen`) of all texts, added up within each batch before the shuffle; once
    counts those of equal texts once (words only)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter, Counter] = (Counter(), Counter(), Counter())
        once: Counter = Counter()

        def flush() -> pa.RecordBatch:
            keys = [k for c in seen for k in c]
            kinds = np.repeat(np.array([WORD, PAIR, BROKEN], np.int8), [len(c) for c in seen])
            n = pa.array([x for c in seen for x in c.values()], pa.int64())
            alone = pa.array([once[k] for k in seen[WORD]] + [0] * (len(keys) - len(seen[WORD])), pa.int64())
            for c in (*seen, once):
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(keys, pa.string()), n, alone], names=["kind", "key", "n", "once"])

        for batch in batches:
            for text, copies in zip(batch.column("text").to_pylist(), batch.column("copies").to_pylist()):
                if not text:
                    continue
                found: tuple[list[str], list[str], list[str]] = ([], [], [])
                prev = None
                for _, kind, word, other in tokens(_unmarked(text)):
                    if kind == "word":
                        form = word if word.isalpha() else lm_form(word)
                        found[WORD].append(form)
                        if prev is not None:
                            found[PAIR].append(f"{prev}\u0002{form}")
                        prev = form
                    elif kind == "hyphen":
                        found[BROKEN].append(f"{word}\u0002{other}")
                        prev = word
                once.update(found[WORD])
                for counter, keys in zip(seen, found):
                    if copies == 1:
                        counter.update(keys)
                    else:
                        for k in keys:
                            counter[k] += copies
                if len(seen[PAIR]) > 300_000:
                    yield flush()
        if any(seen):
            yield flush()

    distinct = spread(texts.groupBy("text").agg(F.count("*").alias("copies")))
    rows = distinct.mapInArrow(count, "kind tinyint, key string, n long, once long")
    return rows.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("once").alias("once"))


def _vocabulary(counted: DataFrame) -> DataFrame:
    return counted.filter(F.col("kind") == WORD).select(F.col("key").alias("word"), "n", "once")


def _tried(counted: DataFrame) -> DataFrame:
    """Every option of every distinct word (also of broken words): word, other, own_n (0 where
    nothing speaks for the word), text, shown, path (numbers of confusions, empty for the word
    as it stands), n (count of text in the corpus); own_once and known_once count distinct
    texts."""
    parts = F.split("key", "\u0002")
    observed = counted.filter(F.col("kind") != PAIR).select(parts[0].alias("word"), F.when(F.col("kind") == BROKEN, parts[1]).alias("other"), "once")

    def undo(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for word, other, once in zip(*(c.to_pylist() for c in batch.columns)):
                once = 0 if other is not None else once
                for own in dict.fromkeys(x for x in (word, other) if x):
                    if other is not None:
                        rows.append((word, other, 0, 0, own, own, []))
                    if _correctable(own):
                        # No count speaks for a word that can be no right one.
                        least = 0 if _NO_WORD.search(own) else once
                        rows += [(word, other, least, once, t, shown, list(path)) for t, (shown, path) in undone(own).items()]
                if other is None and _correctable(word):
                    rows.append((word, other, once, once, word, word, []))
            yield _batch(rows, types, names)

    names = ["word", "other", "own_n", "own_once", "text", "shown", "path"]
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())]
    tried = observed.mapInArrow(undo, "word string, other string, own_n long, own_once long, text string, shown string, path array<int>")
    known = _vocabulary(counted).select(F.col("word").alias("text"), "n", F.col("once").alias("known_once"))
    return tried.join(known, "text", "left")


def confusion_rates(counted: DataFrame, hits: DataFrame) -> list[float]:
    """Probability of each confusion at a place where its character stands, by expectation
    maximisation over the distinct words, equal texts counted once.

    A word as read is a misreading altogether, then its count is geometric about what the
    confusions would cause among its right words (their rates differ from word to word), or a
    word of its own, then any count will do (1 / (n + 1)(n + 2)); the share of the former is
    estimated as well, and a word that holds a sign no word has is one of them. The misreadings
    are shared out by what each confusion would cause."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * len(CONFUSIONS)
        for batch in batches:
            for word, n in zip(*(c.to_pylist() for c in batch.columns)):
                for k, (_, meant) in enumerate(CONFUSIONS):
                    if meant in word:
                        total[k] += n * word.count(meant)
        yield _batch(list(enumerate(total)), [pa.int32(), pa.int64()], ["k", "n"])

    vocabulary = _vocabulary(counted).select("word", "once")
    # One row for each confusion.
    at = {r.k: r.n for r in vocabulary.mapInArrow(places, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()}
    words = hits.filter(f"other is null and size(path) = 1 and known_once >= {RATIO} * own_once").groupBy("word").agg(
        F.max("own_once").alias("own"), F.collect_list(F.struct(F.col("path")[0].alias("k"), F.col("known_once").alias("n"))).alias("ways")
    )
    words = cut(words.filter("own > 0"))
    rates, share = [START] * len(CONFUSIONS), 0.5
    for _ in range(ROUNDS):
        rate = F.array(*(F.lit(r) for r in rates))
        caused = F.transform("ways", lambda w: F.struct(w["k"].alias("k"), (w["n"] * F.get(rate, w["k"])).alias("n")))
        rows = words.select("word", "own", caused.alias("c")).withColumn("all", F.aggregate("c", F.lit(0.0), lambda s, x: s + x["n"]))
        own, every = F.col("own"), F.col("all")
        odds = F.exp(own * F.log(every / (1 + every)) - F.log(1 + every) + F.log((own + 1) * (own + 2))) * share / (1 - share)
        rows = rows.withColumn("misread", F.when(F.col("word").rlike(_NO_WORD.pattern), 1.0).when(odds > 1e9, 1.0).otherwise(odds / (1 + odds)))
        parts = rows.select("misread", F.explode("c").alias("c"), (own * F.col("misread") / every).alias("part"), (1 / F.size("c")).alias("w"))
        seen = {r.k: r for r in parts.groupBy("c.k").agg(F.sum(F.col("c.n") * F.col("part")).alias("n"), F.sum(F.col("misread") * F.col("w")).alias("m"), F.sum("w").alias("w")).collect()}
        share = min(0.999, max(0.001, sum(r.m for r in seen.values()) / max(1.0, sum(r.w for r in seen.values()))))
        rates = [((seen[k].n if k in seen else 0.0) + PRIOR * PRIOR_PLACES) / (at.get(k, 0) + PRIOR_PLACES) for k in range(len(CONFUSIONS))]
    return rates


def options(counted: DataFrame) -> DataFrame:
    """For each distinct word or broken word that has options: (word, other, total, options)
    with options an array of struct(text, shown, n, changed, chance), chance the probability
    that text is read as the word."""
    total = _vocabulary(counted).agg(F.sum("n")).first()[0] or 0
    hits = cut(_tried(counted))
    rate = F.array(*(F.lit(r) for r in confusion_rates(counted, hits)))
    chance = F.aggregate("path", F.lit(1.0), lambda p, k: p * F.get(rate, k))
    changed = F.size("path") > 0
    # An option that changes the word must be known and clearly more frequent than the word,
    # copies of one text counted once; the decoder chooses.
    hits = hits.filter(~changed | ((F.col("n") >= 2) & (F.col("n") >= RATIO * F.col("own_n"))))
    grouped = hits.groupBy("word", "other").agg(
        F.collect_list(F.struct("text", "shown", F.coalesce("n", F.lit(0)).alias("n"), changed.alias("changed"), chance.alias("chance"))).alias("options"),
        F.max(changed).alias("any"),
    )
    grouped = grouped.filter(F.col("any") | F.col("other").isNotNull())
    return grouped.select("word", F.coalesce("other", F.lit("\u0001")).alias("other"), F.lit(total).cast("bigint").alias("total"), "options")


def _bit_table(words: DataFrame, bits: int = TABLE_BITS) -> bytes:
    """Bits at two hashes of every word; 2 ** bits of them, however many words."""
    h, size = F.xxhash64("word"), F.lit(2**bits)
    at = words.select(F.explode(F.array(F.pmod(h, size), F.pmod(F.shiftrightunsigned(h, 32), size))).alias("at"))
    parts = at.groupBy((F.col("at") / 32768).cast("int").alias("part")).agg(F.bitmap_construct_agg(F.col("at") % 32768).alias("bits"))
    table = bytearray(2**bits // 8)
    for r in parts.collect():  # 2 ** bits / 32768 rows at most
        table[r.part * 4096 : (r.part + 1) * 4096] = r.bits
    return bytes(table)


def _in_table(table: bytes, word: str) -> bool:
    h = xxhash.xxh64_intdigest(word.encode(), seed=42)
    for at in (h % (len(table) * 8), (h >> 32) % (len(table) * 8)):
        if not table[at >> 3] >> (at & 7) & 1:
            return False
    return True


def _emit(texts: DataFrame, table: Broadcast) -> DataFrame:
    """Running lines and runs of all texts: rec, rec_id, line_no, seq, kind (`header`,
    `pageno`, `run`), run. A run holds neighbouring words of a line that may have options or are
    broken, each with what it is joined with a hyphen (U+0001 for words that aren't broken), and
    before them the words around it; parts are set off by U+0002, a missing word is U+0003. seq
    is the place of its first word."""
    schema = "rec string, rec_id bigint, line_no int, seq int, kind string, run string"
    names = ["rec", "rec_id", "line_no", "seq", "kind", "run"]
    types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, known = table.value, {}
        for batch in batches:
            rows = []
            for rec, key, text in zip(*(batch.column(c).to_pylist() for c in ("rec", "rec_id", "text"))):
                if not text:
                    continue
                stream = []
                for t in tokens(_unmarked(text)):
                    if t[1] in ("word", "hyphen"):
                        stream.append(t)
                    else:
                        rows.append((rec, key, t[0], 0, t[1], None))
                forms = [lm_form(t[2]) for t in stream]
                run: list[str] = []
                for k, (line, kind, word, other) in enumerate(stream):
                    may = kind == "hyphen"
                    if not may:
                        may = known.get(word)
                        if may is None:
                            may = known[word] = _in_table(bits, word)
                    if may:
                        run += (word, other if kind == "hyphen" else "\u0001")
                    if run and (not may or k + 1 == len(stream) or stream[k + 1][0] != line):
                        end = k if may else k - 1
                        start = end - len(run) // 2 + 1
                        around = (forms[start - 1] if start else "\u0003", forms[end + 1] if end + 1 < len(forms) else "\u0003")
                        rows.append((rec, key, stream[end][0], start, "run", "\u0002".join((*around, *run))))
                        run = []
                if len(rows) > 50_000:
                    yield _batch(rows, types, names)
                    rows = []
            if len(known) > 1_000_000:
                known.clear()
            yield _batch(rows, types, names)

    return texts.select("rec", "rec_id", "text").mapInArrow(emit, schema)


def _batch(rows: list[tuple], types: list, names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)


@dataclass(slots=True)
class Token:
    """A word of a chain with its options (text, shown, n, changed, chance); the first one of a
    chain has prev and the last one next, the words around it."""

    seq: int
    word: str
    other: str
    total: int
    options: list[tuple[str, str, int, bool, float]]
    prev: str | None = None
    next: str | None = None


def _flat(column: pa.ListArray) -> tuple[np.ndarray, list[pa.Array]]:
    """(offsets, members) of a column of lists of structs, without a Python object a struct."""
    offsets = column.offsets.to_numpy()
    return offsets - offsets[0], column.flatten().flatten()


def _chains(batch: pa.RecordBatch) -> Iterator[tuple[int, list[Token]]]:
    """(row, chain) of the neighbouring tokens of a run that have options."""
    at, (_, words, others, totals, options) = _flat(batch.column("tokens"))
    words, others, totals, known = words.to_pylist(), others.to_pylist(), totals.to_pylist(), options.is_valid().to_pylist()
    bounds, members = _flat(options)
    held = list(zip(*(m.to_pylist() for m in members)))
    prevs, nexts = batch.column("prev").to_pylist(), batch.column("next").to_pylist()
    for row, (first, end) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        chain: list[Token] = []
        for i in range(first, end):
            if known[i]:
                one = Token(i - first, words[i], others[i], totals[i], held[bounds[i] : bounds[i + 1]])
                if not chain:
                    one.prev = lm_form(words[i - 1]) if i > first else prevs[row]
                chain.append(one)
            elif chain:
                chain[-1].next = lm_form(words[i])
                yield row, chain
                chain = []
        if chain:
            chain[-1].next = nexts[row]
            yield row, chain


def _asked(chain: list[Token]) -> set[str]:
    """The bigrams that decoding a chain needs."""
    out = set()
    before = [chain[0].prev] if chain[0].prev is not None else []
    for t in chain:
        texts = [o[0] for o in t.options]
        out.update(f"{b}\u0002{x}" for b in before for x in texts)
        before = texts
    if chain[-1].next is not None:
        out.update(f"{b}\u0002{chain[-1].next}" for b in before)
    return out


def decode(chain: list[Token], pairs: dict[str, int]) -> list[str | None]:
    """The displayed form chosen for each token of a chain (null: as it stands), by Viterbi.
    `pairs` counts bigrams."""
    best: list[list[tuple[float, int]]] = []
    before: list[tuple[str | None, float]] = [(chain[0].prev, SMOOTH)]  # texts and weights of contexts
    for i, token in enumerate(chain):
        total, broken = max(token.total, 1), token.other != "\u0001"
        share = [(t, p) for t, _, _, changed, p in token.options if changed]
        last = i + 1 == len(chain) and token.next is not None
        row = []
        for text, _, n, changed, chance in token.options:
            # Counts of the word as it stands are less by what its misreadings and this very
            # token explain; a word that can be none has none.
            whole, never = changed or (broken and not share), not changed and _NO_WORD.search(text) is not None

            def own(mine: float, of) -> float:
                if whole:
                    return mine
                return 0.0 if never else max(0.0, mine - (0 if broken else 1) - sum(DOUBT * p * of(t) for t, p in share))

            p = own(n, lambda t: next(o[2] for o in token.options if o[0] == t)) / total + UNSEEN
            here = math.log(chance if changed else 1 - RATE)
            if last:
                here += math.log((own(pairs.get(f"{text}\u0002{token.next}", 0), lambda t: pairs.get(f"{t}\u0002{token.next}", 0)) + SMOOTH * 1e-4) / (n + SMOOTH))
            scored = []
            for j, (key, size) in enumerate(before):
                like = math.log((own(pairs.get(f"{key}\u0002{text}", 0), lambda t: pairs.get(f"{key}\u0002{t}", 0)) + SMOOTH * p) / size)
                scored.append((like + here + (best[-1][j][0] if i else 0.0), j))
            row.append(max(scored, key=lambda x: (x[0], -x[1])))
        best.append(row)
        before = [(o[0], SMOOTH + o[2]) for o in token.options]
    out: list[str | None] = [None] * len(chain)
    at = None
    for i in range(len(chain) - 1, -1, -1):
        row, options = best[i], chain[i].options
        k = at if at is not None else max(range(len(row)), key=lambda x: (row[x][0], not options[x][3], -x))
        out[i] = options[k][1] if options[k][3] or chain[i].other != "\u0001" else None
        at = row[k][1] if i else None
    return out


def findings(texts: DataFrame) -> DataFrame:
    """`texts` has rec, rec_id, text. Rows rec, rec_id, line_no, seq, kind, word, repaired:
    every running line, broken word and misread word."""
    counted = cut(counts(texts))
    opts = cut(options(counted))
    table = texts.sparkSession.sparkContext.broadcast(_bit_table(opts.filter("other = '\u0001'").select("word")))
    emitted = cut(_emit(texts, table))
    # Equal runs, as in copies of a page, are decoded once.
    distinct = cut(emitted.filter("kind = 'run'").select("run").distinct().withColumn("uid", F.monotonically_increasing_id()))
    part = F.split("run", "\u0002")
    around = F.struct("run", *(F.nullif(part[k], F.lit("\u0003")).alias(c) for k, c in enumerate(("prev", "next")))).alias("at")
    words = distinct.withColumn("p", part).select("uid", around, F.posexplode(F.transform(F.sequence(F.lit(1), (F.size("p") / 2 - 1).cast("int")), lambda k: F.struct(F.get("p", (2 * k).cast("int")).alias("word"), F.get("p", (2 * k + 1).cast("int")).alias("other")))).alias("i", "t"))
    # A skewed word is split by adaptive execution.
    with_options = words.select("uid", "at", "i", "t.word", "t.other").join(opts, ["word", "other"], "left")
    runs = with_options.groupBy("uid").agg(F.any_value("at").alias("at"), F.array_sort(F.collect_list(F.struct("i", "word", "other", "total", "options"))).alias("tokens"))
    runs = cut(runs.filter(F.exists("tokens", lambda t: t["options"].isNotNull())).select("uid", "at.*", "tokens"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys = [], []
            for row, chain in _chains(batch):
                asked = _asked(chain)
                keys += asked
                rows += [row] * len(asked)
            yield pa.RecordBatch.from_arrays([batch.column("uid").take(pa.array(rows, pa.int64())), pa.array(keys, pa.string())], names=["uid", "key"])

    asked = runs.select("uid", "prev", "next", "tokens").mapInArrow(ask, "uid long, key string")
    bigrams = counted.filter(F.col("kind") == PAIR).select("key", "n")
    answered = asked.join(bigrams, "key").groupBy("uid").agg(F.collect_list(F.struct("key", "n")).alias("pairs"))

    names = ["run", "i", "kind", "word", "repaired"]
    types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, (asked_keys, numbers) = _flat(batch.column("pairs"))
            said = list(zip(asked_keys.to_pylist(), numbers.to_pylist()))
            keys = batch.column("run").to_pylist()
            rows, of, pairs = [], -1, {}
            for row, chain in _chains(batch):
                if row != of:
                    of, pairs = row, dict(said[at[row] : at[row + 1]])
                for t, shown in zip(chain, decode(chain, pairs)):
                    if shown is not None:
                        rows.append((keys[row], t.seq, "misread" if t.other == "\u0001" else "hyphen", t.word, shown))
            yield _batch(rows, types, names)

    chosen = runs.join(answered, "uid", "left").mapInArrow(choose, "run string, i int, kind string, word string, repaired string")
    placed = emitted.filter("kind = 'run'").drop("kind").join(chosen, "run").select("rec", "rec_id", "line_no", (F.col("seq") + F.col("i")).alias("seq"), "kind", "word", "repaired")
    plain = emitted.filter("kind <> 'run'").select("rec", "rec_id", "line_no", "seq", "kind", F.lit("").alias("word"), F.lit("").alias("repaired"))
    return plain.unionByName(placed)


def stacked(pages: DataFrame, drafts: DataFrame) -> DataFrame:
    page = pages.select(F.lit("page").alias("rec"), F.col("page_id").cast("bigint").alias("rec_id"), "text")
    draft = drafts.select(F.lit("draft").alias("rec"), F.col("draft_id").cast("bigint").alias("rec_id"), "text")
    return page.unionByName(draft).filter("text is not null and text <> ''")


def found(pages: DataFrame, drafts: DataFrame) -> DataFrame:
    """Rows (rec, rec_id, line_no, kind, repaired) of the repairs that both tables need."""
    return findings(stacked(pages, drafts)).select("rec", "rec_id", "line_no", "kind", "repaired").distinct()


def rebuilt(text: str, fixes: dict[int, str]) -> str:
    """The text as running paragraphs: without running lines, broken words joined, words at
    the positions (seq) of `fixes` replaced, lines of a paragraph joined by spaces."""
    lines, out, paragraph = text.split("\n"), [], []
    by_line: dict[int, list[tuple[str, str, str]]] = {}
    for line, kind, word, other in tokens(text):
        by_line.setdefault(line, []).append((kind, word, other))
    seq, carried = 0, False
    for i, line in enumerate(lines):
        if running(line):
            continue
        chunks = line.split()
        if not chunks:
            if paragraph:
                out.append(" ".join(paragraph))
                paragraph = []
            continue
        if carried:
            end = _tail(chunks[0])
            paragraph[-1] += end
            chunks = chunks[1:]
        carried = False
        items = by_line.get(i, [])
        joined = bool(items and items[-1][0] == "hyphen")
        for k, chunk in enumerate(chunks):
            if joined and k == len(chunks) - 1:
                lead = chunk[: len(chunk) - len(chunk.lstrip("([{\"'«„“"))]
                paragraph.append(lead + fixes.get(seq, items[-1][1]))
                seq, carried = seq + 1, True
                continue
            word = core(chunk)
            if word:
                paragraph.append(chunk.replace(word, fixes[seq], 1) if seq in fixes else chunk)
                seq += 1
            else:
                paragraph.append(chunk)
    if paragraph:
        out.append(" ".join(paragraph))
    return "\n\n".join(out)


def _tail(chunk: str) -> str:
    """The punctuation after the word of a chunk."""
    word = _TRIM.sub("", chunk)
    return chunk[chunk.find(word) + len(word) :] if word else chunk


def repaired_texts(texts: DataFrame) -> DataFrame:
    """`texts` (rec, rec_id, text) with repaired, the text as running paragraphs."""
    fixes = findings(texts).filter("kind in ('hyphen', 'misread')").groupBy("rec", "rec_id").agg(F.collect_list(F.struct("seq", "repaired")).alias("fixes"))
    rows = texts.select("rec", "rec_id", "text").join(fixes, ["rec", "rec_id"], "left")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [
                None if t is None else rebuilt(t, {f["seq"]: f["repaired"] for f in x or []})
                for t, x in zip(batch.column("text").to_pylist(), batch.column("fixes").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("rec"), batch.column("rec_id"), batch.column("text"), pa.array(done, pa.string())], names=["rec", "rec_id", "text", "repaired"]
            )

    return rows.mapInArrow(build, "rec string, rec_id bigint, text string, repaired string")
