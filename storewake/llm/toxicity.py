"""Toxicity of texts after noisy-channel restoration.

A token that is more than letters without doubles between ordinary punctuation,
and a run of letters spelled out one by one, becomes a lattice of readings. A character language model, counted over all texts, decides by
Viterbi decoding which reading it is: digits and signs as the letters they
resemble or as a boundary, runs as one or two letters, separators as nothing or
as a boundary. Restored words are scored next to the words as written.

Words and beginnings of words carry the evidence. They are learnt from labelled
rows: how much likelier a text with them is toxic, counted over distinct
contexts so that copies of one text count once.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storewake.llm.common import land, work_folder

#: Labelled rows that the model is fitted to at most, the first by a hash of their id.
MAX_LABELLED = 20_000
PREFIXES = range(3, 9)
#: Evidence that a feature needs (G statistic) and the share of its texts that are toxic.
MIN_G = 20.0
MIN_SHARE = 0.2
#: A text's words with a feature count up to this many.
MOST = 4
#: A task forgets what it knows of distinct tokens beyond this many.
MEMO = 300_000

#: The letters that digits and signs stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e",
}
_SIGNS = re.escape("".join(LOOKALIKES))
_OPENING = r"[(\[{<\"'«“„‘¿¡–—]*"
_CLOSING = r"[)\]}>\"'»”“’.,;:?!…–—]*"
#: Tokens that have one reading: letters without doubles between ordinary punctuation.
_PLAIN = re.compile(rf"{_OPENING}(?:([^\W\d_])(?!\1))*{_CLOSING}")
_SPELLED = re.compile(rf"(?<!\S){_OPENING}(?:\S\s+){{3,}}\S{_CLOSING}(?!\S)")
_WIDE = re.compile(r"\s{2,}")
_DOUBLE = re.compile(r"([^\W\d_])\1")
_SEPARATED = re.compile(rf"[^\W\d_](?:[^\w\s{_SIGNS}*]|_)+[^\W\d_]")
_WORD = re.compile(r"[^\W\d_]+")

_LETTERS = 28  # 0 boundary, 1 to 26 a to z, 27 any other letter


def _letter_codes() -> np.ndarray:
    codes = np.zeros(0x250, np.int64)
    for code in range(0x250):
        c = chr(code).lower()
        if c.isalpha():
            codes[code] = ord(c) - 96 if "a" <= c <= "z" else 27
    return codes


_CODES = _letter_codes()


def _coded(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 0x250, _CODES[np.minimum(points, 0x24F)], 27)


def trigram_counts(texts: DataFrame) -> np.ndarray:
    """Letter trigrams of all texts (`text`); a fixed number of counts whatever the input."""
    size = _LETTERS**3

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                if text:
                    c = np.concatenate([[0, 0], _coded(text), [0]])
                    total += np.bincount((c[:-2] * _LETTERS + c[1:-1]) * _LETTERS + c[2:], minlength=size)
        places = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"place": places, "n": total[places]})

    rows = texts.select("text").mapInArrow(run, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n"))
    counts = np.zeros(size, np.int64)
    for row in rows.collect():  # at most 28^3 rows
        counts[row.place] = row.n
    return counts


class LanguageModel:
    """Interpolated letter trigrams, as log probabilities."""

    def __init__(self, counts: np.ndarray):
        tri = counts.reshape(_LETTERS, _LETTERS, _LETTERS).astype(float)
        bi, uni = tri.sum(0), tri.sum((0, 1))
        p1 = (uni + 1) / (uni.sum() + _LETTERS)
        p2 = (bi + 5 * p1) / (bi.sum(1, keepdims=True) + 5)
        p3 = (tri + 5 * p2[None]) / (tri.sum(2, keepdims=True) + 5)
        self.log = np.log(p3).tolist()

    @staticmethod
    def code(c: str) -> int:
        return int(_CODES[ord(c)]) if ord(c) < 0x250 else (27 if c.isalpha() else 0)

    def decode(self, lattice: list[list[tuple[str, float]]]) -> str:
        """The likeliest reading; each step of the lattice has readings with log channel weights."""
        states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        for step in [*lattice, [(" ", 0.0)]]:
            new: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (score, path) in states.items():
                for reading, weight in step:
                    x, y, s = a, b, score + weight
                    for c in reading:
                        z = self.code(c)
                        if not z and not y:
                            continue  # one boundary is as good as two
                        s += self.log[x][y][z]
                        x, y = y, z
                    old = new.get((x, y))
                    if old is None or s > old[0]:
                        new[(x, y)] = (s, (path, reading))
            states = new
        _, path = max(states.values(), key=lambda v: v[0])
        out = []
        while path:
            path, reading = path
            out.append(reading)
        return "".join(reversed(out)).strip()


_ANY_LETTER = [(chr(c), math.log(1 / 26)) for c in range(97, 123)]


def lattice_of(token: str, collapse: bool = False, single: bool = False) -> list[list[tuple[str, float]]]:
    """The readings of a lower-case token, symbol by symbol.

    Letters stay; three or more of one are one or two, with `collapse` two may be
    one. A digit or sign is most likely a letter, a final `!` or `|` a boundary. A
    separator between short pieces is most likely nothing, else a boundary. With
    `single` repeated letters are one and any separator is most likely nothing.
    """
    steps: list[list[tuple[str, float]]] = []
    runs = [m[0] for m in re.finditer(r"(.)\1*", token, re.DOTALL)]
    pieces = re.split(rf"[^\w{_SIGNS}*]|_", token)
    short = single or max(map(len, pieces)) <= 2
    for i, run in enumerate(runs):
        c, inner = run[0], 0 < i < len(runs) - 1
        if c.isalpha():
            if single:
                steps.append([(c, 0.0)])
            elif len(run) > 2:
                steps.append([(c, math.log(0.5)), (c * 2, math.log(0.5))])
            elif len(run) == 2 and collapse:
                steps.append([(run, math.log(0.5)), (c, math.log(0.5))])
            else:
                steps.append([(run, 0.0)])
        elif c in LOOKALIKES:
            sure = 0.9999 if inner or c not in "!|+" else 0.05
            as_letter = math.log(sure / len(LOOKALIKES[c]))
            for _ in run:
                steps.append([(x, as_letter) for x in LOOKALIKES[c]] + [(" ", math.log(1 - sure))])
        elif c == "*" and inner and runs[i - 1].isalpha() and runs[i + 1].isalpha():
            steps += [[*_ANY_LETTER, ("", math.log(0.1))] for _ in run]
        else:
            joined = 0.97 if short else 0.03
            steps.append([("", math.log(joined)), (" ", math.log(1 - joined))])
    return steps


class Restorer:
    """Restored words of whole texts, with a bounded memory of tokens."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.memo: dict[str, tuple[str, ...]] = {}

    def read(self, token: str) -> tuple[str, ...]:
        """Words of a token as written and, if it may be disguised, as restored."""
        written = _WORD.findall(token)
        if written and not _PLAIN.fullmatch(token):
            written += _WORD.findall(self.model.decode(lattice_of(token)))
        return tuple(dict.fromkeys(written))

    def reread(self, token: str) -> tuple[str, ...]:
        """Words of the less likely readings: repeated letters as they may be and as one, separated
        pieces as one word."""
        doubled = _DOUBLE.search(token)
        readings = [lattice_of(token, collapse=True)] if doubled else []
        if doubled or _SEPARATED.search(token):
            readings.append(lattice_of(token, single=True))
        return tuple(dict.fromkeys(w for steps in readings for w in _WORD.findall(self.model.decode(steps))))

    def words(self, token: str) -> tuple[str, ...]:
        found = self.memo.get(token)
        if found is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            found = self.memo[token] = self.read(token)
        return found

    def spelled(self, text: str) -> list[str]:
        """Words that are written letter by letter."""
        out = []
        for match in _SPELLED.finditer(text):
            # Where some gaps are wider than others, they may part words.
            for letters in dict.fromkeys([match[0], *_WIDE.split(match[0])]):
                if sum(c.isalpha() for c in letters) >= 2:
                    out += [*self.read(letters), *self.reread(letters)]
        return out


def features(word: str) -> list[str]:
    """The word itself (marked) and the beginnings that it goes beyond."""
    return [word + "$"] + [word[:n] for n in PREFIXES if len(word) > n]


class Model:
    """Evidence of each feature by how many of a text's words have it, and of texts without any."""

    def __init__(self, evidence: dict[str, list[float]], none: float, language: LanguageModel):
        self.evidence = evidence
        self.none = none
        self.language = language

    def score(self, hits: dict[str, int]) -> float:
        """Naive Bayes over the features that a text has; texts without any share one score."""
        logit = sum(self.evidence[f][min(n, MOST) - 1] for f, n in hits.items()) if hits else 0.0
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, logit + self.none))))


class Finder:
    """Features of whole texts, with a bounded memory of tokens."""

    def __init__(self, language: LanguageModel, wanted: Iterable[str]):
        self.restorer = Restorer(language)
        self.wanted = frozenset(wanted)
        # A feature that goes on from another one needs its letters too.
        stems = {f.rstrip("$") for f in self.wanted}
        first = {s for s in stems if not any(s[:n] in stems for n in PREFIXES if n < len(s))}
        self.needs = tuple({frozenset(s) for s in first})
        self.known: dict[str, tuple[tuple[str, str], ...]] = {}

    def _pairs(self, words: Iterable[str]) -> tuple[tuple[str, str], ...]:
        return tuple((f, w) for w in words for f in features(w) if f in self.wanted)

    def possible(self, token: str) -> bool:
        """Whether some reading may have a feature: the token has its letters, or signs for them."""
        if "*" in token:
            return True
        have = set(token)
        for sign in have & LOOKALIKES.keys():
            have.update(LOOKALIKES[sign])
        return any(need <= have for need in self.needs)

    def _of(self, token: str) -> tuple[tuple[str, str], ...]:
        found = self.known.get(token)
        if found is None:
            if len(self.known) >= MEMO:
                self.known.clear()
            if _PLAIN.fullmatch(token):
                found = self._pairs(dict.fromkeys(_WORD.findall(token)))
            elif self.possible(token):
                # A word that has evidence as it is needs no other reading, so it counts once.
                found = self._pairs(self.restorer.read(token)) or self._pairs(self.restorer.reread(token))
            else:
                found = ()
            self.known[token] = found
        return found

    def hits(self, text: str | None) -> list[tuple[str, str]]:
        """Distinct (feature, word) of a text, as written and restored."""
        if not text:
            return []
        low = text.lower()
        out: set[tuple[str, str]] = set()
        for token in set(low.split()):
            out.update(self._of(token))
        if _SPELLED.search(low):
            out.update(self._pairs(self.restorer.spelled(low)))
        return sorted(out)


def _g(toxic: int, clean: int, base: float) -> float:
    """How surely a feature's texts are toxic more often than all (0 if they are not)."""
    n = toxic + clean
    if toxic <= n * base:
        return 0.0
    part = toxic * math.log(toxic / (n * base))
    return 2 * (part + (clean * math.log(clean / (n * (1 - base))) if clean else 0.0))


def _chosen(toxic: dict[str, int], clean: dict[str, int], base: float) -> list[str]:
    """The surest features of which none is the beginning of another; of equal ones the longest."""
    sure = [
        (_g(n, clean.get(f, 0), base), len(f), f)
        for f, n in toxic.items()
        if n >= MIN_SHARE * (n + clean.get(f, 0))
    ]
    out: set[str] = set()
    begun: set[str] = set()
    for g, _, feature in sorted(sure, reverse=True):
        stem = feature.rstrip("$")
        shorter = {stem[:n] for n in PREFIXES if n < len(stem)}
        if g >= MIN_G and not (shorter & out) and feature not in begun:
            out.add(feature)
            begun |= shorter
    return sorted(out)


def _hit_counts(sample: DataFrame, toxic: int, finder: tuple, by_words: bool) -> Counter:
    """Number of sample texts with a label by feature (and by number of words)."""
    spread = sample.sparkSession.sparkContext.broadcast(finder)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, counts = Finder(*spread.value), Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                per = Counter(f for f, _ in find.hits(text))
                counts.update((f, min(n, MOST) if by_words else 0) for f, n in (per or {"": 1}).items())
        yield pa.RecordBatch.from_pydict(
            {
                "feature": pa.array([k[0] for k in counts], pa.string()),
                "words": pa.array([k[1] for k in counts], pa.int32()),
                "n": pa.array(list(counts.values()), pa.int64()),
            }
        )

    rows = (
        sample.where(F.col("toxic") == toxic)
        .select("text")
        .mapInArrow(run, "feature string, words int, n bigint")
        .groupBy("feature", "words")
        .agg(F.sum("n").alias("n"))
    )
    return Counter({(r.feature, r.words): r.n for r in rows.collect()})


def fit(texts: DataFrame, sample: DataFrame) -> Model:
    """A model from all `texts` (letters) and from labelled rows (`doc`, `text`, `toxic`) of bounded
    number. What reaches the driver is bounded by the labelled rows."""
    language = LanguageModel(trigram_counts(texts))
    n = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    base = (n_toxic + 0.5) / (n_toxic + n_clean + 1)

    def toxic_features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(language)
        for batch in batches:
            rows = set()
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), strict=True):
                previous = ""
                low = (text or "").lower()
                seen: set[str] = set()
                for token in [*low.split(), *restorer.spelled(low)]:
                    for word in restorer.words(token):
                        if word not in seen:
                            seen.add(word)
                            rows.update((f, previous, doc) for f in features(word))
                    previous = token
            listed = list(rows)
            yield pa.RecordBatch.from_pydict(
                {
                    "feature": pa.array([r[0] for r in listed], pa.string()),
                    "previous": pa.array([r[1] for r in listed], pa.string()),
                    "doc": pa.array([r[2] for r in listed], pa.int64()),
                }
            )

    least = MIN_G / (-2 * math.log(base))
    found = (
        sample.where("toxic = 1")
        .select("doc", "text")
        .mapInArrow(toxic_features, "feature string, previous string, doc bigint")
        .groupBy("feature", "previous")
        .agg(F.min("doc").alias("doc"))
        .groupBy("feature")
        .agg(F.count_distinct("doc").alias("n"))
        .where(F.col("n") >= least)
    )
    toxic = {r.feature: r.n for r in found.collect()}
    clean = _hit_counts(sample, 0, (language, list(toxic)), by_words=False)
    chosen = _chosen(toxic, {f: k for (f, _), k in clean.items()}, base)
    by_label = [_hit_counts(sample, label, (language, chosen), by_words=True) for label in (0, 1)]

    def log_ratio(feature: str, words: int) -> float:
        odds = [(c[(feature, words)] + 0.5) / (total + 1) for c, total in zip(by_label, (n_clean, n_toxic), strict=True)]
        return math.log(odds[1] / odds[0])

    evidence = {}
    for feature in chosen:
        # More words of a kind are no weaker evidence than fewer.
        ratios = [log_ratio(feature, words) for words in range(1, MOST + 1)]
        evidence[feature] = np.maximum.accumulate(ratios).tolist()
    prior = math.log(base / (1 - base))
    none = prior + min(0.0, log_ratio("", 1))
    return Model({f: [r + prior - none for r in e] for f, e in evidence.items()}, none, language)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, held_out: Column | None = None, max_rows: int = MAX_LABELLED
) -> DataFrame:
    """`doc`, `text`, `toxic` of at most `max_rows` labelled documents, the first by a hash of
    their id. Rows without a label are left out, a document labelled both ways counts as toxic."""
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    if held_out is not None:
        usable = usable.where(~held_out)
    picked = (
        usable.groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    texts = docs.select(F.col("doc_id").alias("_id"), F.col("text"))
    return texts.join(F.broadcast(picked), F.col("_id") == F.col("doc_id")).select(
        F.col("_id").cast("bigint").alias("doc"), "text", F.col("toxic").cast("int").alias("toxic")
    )


def scored(texts: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Id, `score` and `hits` (restored words with evidence), one row per input row.

    Null and empty texts have no hits and the score of such texts. Null ids are
    ids, repeated rows stay, other columns are not read.
    """
    kind = texts.schema[id_column].dataType.simpleString()
    spread = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = spread.value
        finder = Finder(model.language, model.evidence)
        for batch in batches:
            hits = [finder.hits(text) for text in batch.column("text").to_pylist()]
            scores = [model.score(Counter(f for f, _ in h)) for h in hits]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(scores, pa.float64()),
                    pa.array([sorted({w for _, w in h}) for h in hits], pa.list_(pa.string())),
                ],
                names=["id", "score", "hits"],
            )

    source = texts.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return source.mapInArrow(run, f"id {kind}, score double, hits array<string>").withColumnRenamed(
        "id", id_column
    )


def is_held_out(id_column: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def toxicity_model(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED) -> Model:
    """The model of a table of documents and its labels, without held-out rows."""
    sample = land(
        labelled_sample(docs, labels, is_held_out(F.col("doc_id")), max_rows),
        f"{work_folder(docs.sparkSession)}/labelled",
    )
    return fit(docs.select("text"), sample)
