"""Toxicity by class-conditional Kneser-Ney models.

Two models of expressions, one of toxic and one of ordinary documents. Each predicts a word from the one before it: a
class's counts of pairs of words are discounted by DISCOUNT and what that frees goes to its counts of single words,
whose freed part goes to its model of letters. That predicts a letter from the ORDER-1 before it, words being set apart
by marks at their ends, and what its discounts free goes to backoff counts that both classes share: in how many contexts
shorter runs of letters stand in the whole corpus (Kneser-Ney continuation counts, level by level). So an expression
that a class has rarely or never seen differs little between the models, and one that toxic documents repeat differs
much, in any of its forms. Every word and pair of the sample counts, those that a class has once too.

A document's two log-likelihoods are compared for a word, that is, normalised by length: of its expressions (words after
words), of its words' letters, and of the letters of its PEAK strongest distinct words, so that a few toxic words in a
long text aren't thinned out. A logistic curve over the three differences, fitted by cross-validation (each sampled row
is scored by models that weren't counted on it), gives the score.

Corpus counts cover all documents and all their words, rare ones too. Spark counts the distinct words and what stands in
them. The classes' counts and the curve come from a bounded sample of labelled rows: MOST_ROWS for each class, in the
order of a hash of the id. Of the corpus counts those are collected that the sample's grams fall back on, and no others
are needed: what is collected and broadcast grows with the sample's text, not with the corpus. Pairs are known by the
64-bit hashes of their words and lie in sorted arrays; a text's words are looked up once each and its pairs all at once.

Defined cases: null or empty text has no words and all differences are 0; a null doc_id is never held out; rows that
are the same score the same; without toxic or without ordinary labels every score is 0 and nothing is predicted toxic;
an empty table gives no rows; extra columns are ignored; of several labels of an id the most toxic counts.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import pairwise
from math import exp, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, cut, give_back, read, tidy

MOST_ROWS, FOLDS, SAMPLE_TASKS = 4000, 3, 24
ORDER, DISCOUNT, PEAK, THRESHOLD = 5, 0.75, 3, 0.3
#: A-Z to a-z; digits and ASCII signs to a space.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: A task's tables of counts are written out and begun anew at so many words, those of its words' scores beyond so many.
MOST_HELD, MOST_KNOWN = 100_000, 300_000
MOST_TOGETHER = 2 << 20
SCORED = "n_words long, difference double, letters double, peak double, score double"


def words(text: bytes) -> list[bytes]:
    return text.translate(LETTERS).split()


def grams(word: bytes) -> list[bytes]:
    """What ends with each letter of the word, and with its end: ORDER letters, fewer near its begin."""
    word = b"^%b$" % word
    return [word[:i] for i in range(2, min(ORDER, len(word)) + 1)] + [word[i - ORDER : i] for i in range(ORDER + 1, len(word) + 1)]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def held_words(text: Column) -> Column:
    """The same words as an array of strings."""
    return F.filter(_split(text), lambda w: w != "")


def _split(text: Column) -> Column:
    return F.split(ascii_lower(text), "[\\x00-\\x60\\x7B-\\x7F]+")


@tidy
def _grams_of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the grams of rows (other columns, word, n), by the other columns' values."""
    keys: list[str] = []
    held: dict[tuple, Counter[bytes]] = defaultdict(Counter)

    def rows() -> Iterator[pa.RecordBatch]:
        for key, found in held.items():
            cols = [pa.array([k] * len(found), pa.int32()) for k in key]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([*found], pa.binary()), pa.array([*found.values()], pa.int64())], names=[*keys, "gram", "n"])
        held.clear()

    for batch in batches:
        keys = [c for c in batch.schema.names if c not in ("word", "n")]
        for word, n, *key in zip(batch.column("word").cast(pa.binary()).to_pylist(), batch.column("n").to_pylist(), *(batch.column(c).to_pylist() for c in keys), strict=True):
            found = held[tuple(key)]
            for g in grams(word):
                found[g] += n
        if sum(map(len, held.values())) >= MOST_HELD:
            yield from rows()
    yield from rows()


def word_counts(docs: DataFrame, *keys: str) -> DataFrame:
    """keys, word, n: how often each word stands in the texts."""
    return docs.select(*keys, F.explode(_split(F.col("text"))).alias("word")).where("word <> ''").groupBy(*keys, "word").agg(F.count("*").alias("n"))


def corpus_grams(docs: DataFrame) -> DataFrame:
    """gram (binary), n: how often each gram stands in all of docs; expanded from the distinct words."""
    return word_counts(docs).mapInArrow(_grams_of_words, "gram binary, n long").groupBy("gram").agg(F.sum("n").alias("n"))


@tidy
def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of bytes for each batch: its keys, where they end if they have no fixed length, and its counts."""
    for batch in batches:
        keys = [c for c in batch.schema.names if c != "n"]
        made = [batch.column("n").flatten().to_numpy().astype("i4").tobytes()]
        for c in keys:
            if pa.types.is_binary(batch.column(c).type):
                ends = np.cumsum(pc.binary_length(batch.column(c)).to_numpy(), dtype="i8")
                made += [ends.tobytes(), b"".join(batch.column(c).to_pylist())]
            else:
                made.append(batch.column(c).to_numpy().tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([made], pa.list_(pa.binary()))], names=["packed"])


def _parts(counted: DataFrame) -> Iterator[list[bytes]]:
    """Straight from the shuffle, partition by partition: each is needed once."""
    for row in counted.mapInArrow(_packed, "packed array<binary>").toLocalIterator():
        yield row.packed


def _narrow(n: np.ndarray) -> np.ndarray:
    """Counts in two bytes each where they all fit."""
    return n.astype("u2") if n.max(initial=0) < 1 << 16 else n


def _counts(parts: list[np.ndarray]) -> np.ndarray:
    """Of the widest type among the parts."""
    return np.concatenate([*parts, np.zeros(0, "u2")]).reshape(-1, 2, FOLDS)


class Pairs:
    """Counts of a sample's pairs of words, held once, by key: the places of both words among the vocabulary's hashes, and a count for each class and fold."""

    def __init__(self, rows: DataFrame, hashes: np.ndarray):
        found = rows.select("toxic", "fold", F.transform(held_words(F.col("text")), lambda w: F.xxhash64(w)).alias("w")).where(F.size("w") > 1)
        pairs = found.select("toxic", "fold", F.explode(F.arrays_zip(F.slice("w", 1, F.size("w") - 1).alias("before"), F.slice("w", 2, F.size("w")).alias("word"))).alias("p"))
        counted = pairs.groupBy(F.col("p.before").alias("before"), F.col("p.word").alias("word")).agg(F.array(*_cells(F.lit(1))).alias("n"))
        keys, places, counts = [], [], []
        for packed in _parts(counted):
            n, before, word = (np.frombuffer(x, kind) for x, kind in zip(packed, ("i4", "i8", "i8"), strict=True))
            keys.append(pair_key(before, word))
            places.append(np.stack([np.searchsorted(hashes, before), np.searchsorted(hashes, word)], 1).astype("i4"))
            counts.append(_narrow(n))
        self.keys = np.concatenate([*keys, np.zeros(0, "i8")])
        order = np.argsort(self.keys)
        self.keys = self.keys[order]
        self.places = np.concatenate([*places, np.zeros((0, 2), "i4")])[order]
        self.counts = _counts(counts)[order]

    def of(self, toxic: int, but: int | None = None) -> np.ndarray:
        return _but(self.counts, toxic, but)


def _but(counts: np.ndarray, toxic: int, but: int | None) -> np.ndarray:
    """A class's counts of all folds but one."""
    return counts[:, toxic, [f for f in range(FOLDS) if f != but]].sum(1, dtype="i4")


def hashed(word: bytes) -> int:
    """As Spark's xxhash64 of the word."""
    h = xxhash.xxh64_intdigest(word, 42)
    return h - (1 << 64) if h >> 63 else h


def pair_key(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return np.left_shift(word, 1) ^ before


def _cells(n: Column) -> list[Column]:
    return [F.coalesce(F.sum(F.when((F.col("toxic") == c) & (F.col("fold") == f), n)), F.lit(0)).cast("long") for c in (0, 1) for f in range(FOLDS)]


class Table:
    """Counts of a sample's grams or words, held once, with a column for each class and fold."""

    def __init__(self, counted: DataFrame, key: str):
        rows = counted.groupBy(key).agg(F.array(*_cells(F.col("n"))).alias("n")).select(F.col(key).cast("binary").alias(key), "n")
        self.keys: list[bytes] = []
        found = []
        for n, ends, joined in _parts(rows):
            found.append(_narrow(np.frombuffer(n, "i4")))
            ends = [0, *np.frombuffer(ends, "i8").tolist()]
            self.keys += [joined[a:b] for a, b in pairwise(ends)]
        self.counts = _counts(found)

    def of(self, toxic: int, but: int | None = None) -> Counter:
        """A class's counts of all folds but one, of what it has there."""
        n = _but(self.counts, toxic, but)
        return Counter({self.keys[i]: int(n[i]) for i in np.flatnonzero(n)})


class Vocabulary(Table):
    """The sample's words, in the order of their hashes."""

    def __init__(self, counted: DataFrame):
        super().__init__(counted, "word")
        hashes = np.fromiter(map(hashed, self.keys), "i8", len(self.keys))
        order = np.argsort(hashes)
        self.hashes, self.counts, self.keys = hashes[order], self.counts[order], [self.keys[i] for i in order]


def _tails(longest: Column, shortest: int) -> Column:
    """The ends of gram of shortest to longest letters."""
    return F.transform(F.sequence(F.lit(shortest), longest), lambda k: F.substr("gram", F.length("gram") - k + 1, k))


def continuations(found: DataFrame) -> DataFrame:
    """gram, n: of each expression of 1 to ORDER-1 letters in found (gram, distinct) how many letters, or a word's begin, stand before it."""
    longer = found.select(F.explode(_tails(F.length("gram"), 2)).alias("gram")).distinct().select(F.substr("gram", F.lit(2)).alias("gram"))
    return longer.union(found.where(F.length("gram") < ORDER).select("gram")).groupBy("gram").agg(F.count("*").alias("n"))


def sample(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """text, toxic, fold: at most so many labelled rows of each class, none of them held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and __id is not null").groupBy("__id").agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("__id")))
    of = lambda c: known.where(F.col("toxic") == c).orderBy(F.xxhash64("__id"), "__id").limit(most_rows)
    picked = of(0).union(of(1)).withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "__id"), F.lit(FOLDS)).cast("int"))
    # at most 2 * most_rows rows of three numbers; the few texts of many partitions come to a few tasks, which sum up more before they shuffle
    return docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id").cast("long") == F.col("__id")).select("text", "toxic", "fold").repartition(SAMPLE_TASKS)


class Shared:
    """Backoff probabilities of the whole corpus, from its distinct grams."""

    def __init__(self, found: list[bytes]):
        #: by length: in how many contexts a gram stands, in how many its context's continuations do, and how many there are
        self.levels: dict[int, tuple[Counter, Counter, Counter]] = {}
        now = set(found)
        for k in range(ORDER - 1, 0, -1):
            shorter: Counter[bytes] = Counter(g[1:] if len(g) == k + 1 else g for g in now)
            total: Counter[bytes] = Counter()
            kinds: Counter[bytes] = Counter()
            for g, n in shorter.items():
                total[g[:-1]] += n
                kinds[g[:-1]] += 1
            self.levels[k] = shorter, total, kinds
            now = set(shorter)
        self.letters = len({g[-1:] for g in found}) + 1
        self.known: dict[bytes, float] = {}

    @classmethod
    def counted(cls, found: DataFrame, needed: DataFrame) -> Shared:
        """The same for needed (gram) of found (gram, distinct): counted over all of found by Spark, and only what needed falls back on is collected."""
        every, before = continuations(found), F.substr("gram", F.lit(1), F.length("gram") - 1).alias("gram")
        wanted = needed.select(F.explode(_tails(F.least(F.length("gram"), F.lit(ORDER - 1)), 1)).alias("gram")).distinct()
        contexts = every.groupBy(before).agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))
        counts = every.select("gram", "n", F.lit(None).cast("long").alias("kinds")).join(wanted, "gram", "left_semi")
        out = cls([])
        for gram, n, kinds in cut(counts.union(contexts.join(wanted.select(before).distinct(), "gram", "left_semi"))).coalesce(1).toLocalIterator():
            gram = bytes(gram)
            if kinds is None:
                out.levels[len(gram)][0][gram] = n
            else:
                _, total, kinds_of = out.levels[len(gram) + 1]
                total[gram], kinds_of[gram] = n, kinds
        out.letters = out.levels[1][2][b""] + 1
        return out

    def p(self, gram: bytes) -> float:
        """Of gram's last letter after those before it, of which ORDER-2 count."""
        gram = gram[-(ORDER - 1) :]
        if not gram:
            return 1 / self.letters
        out = self.known.get(gram)
        if out is None:
            shorter, total, kinds = self.levels[len(gram)]
            below, n = self.p(gram[1:]), total.get(gram[:-1], 0)
            out = self.known[gram] = max(shorter.get(gram, 0) - DISCOUNT, 0) / n + DISCOUNT * kinds[gram[:-1]] / n * below if n else below
        return out


class Side:
    """What a class has of grams (letters), of words and of pairs of words (a count for each one of the sample)."""

    def __init__(self, found: Counter[bytes], words_: np.ndarray, pairs: np.ndarray):
        self.found, self.total, self.freed = found, Counter(), Counter()
        for g, n in found.items():
            self.total[g[:-1]] += n
            self.freed[g[:-1]] += min(n, DISCOUNT)
        self.words, self.pairs, self.n = words_, pairs, int(words_.sum())
        self.left = 1 - float(np.maximum(words_ - DISCOUNT, 0).sum()) / self.n if self.n else 1.0

    def rest(self, h: bytes) -> float:
        return self.freed[h] / self.total[h] if self.total.get(h) else 1.0

    def letter(self, g: bytes, shared: float) -> float:
        h = g[:-1]
        return self.rest(h) * shared + (max(self.found.get(g, 0) - DISCOUNT, 0) / self.total[h] if self.total.get(h) else 0)

    def of_words(self, letters: np.ndarray) -> np.ndarray:
        """letters: the words' probabilities by their letters."""
        return self.left * letters + np.maximum(self.words - DISCOUNT, 0) / max(self.n, 1)


class Model:
    """Differences of the toxic and the ordinary log-likelihood, for what a class has and for contexts."""

    def __init__(self, ordinary: Side, toxic: Side, shared: Shared, vocabulary: Vocabulary, pairs: Pairs):
        sides = ordinary, toxic
        by_letter: dict[bytes, tuple[float, float]] = {}

        def letters(w: bytes) -> tuple[float, float]:
            a = b = 0.0
            for g in grams(w):
                p = by_letter.get(g)
                if p is None:
                    base = shared.p(g)
                    p = by_letter[g] = tuple(log(side.letter(g, base)) for side in sides)
                a += p[0]
                b += p[1]
            return a, b

        apart = lambda f: log(f(toxic)) - log(f(ordinary))
        self.rest: dict[bytes, float] = {h: apart(lambda side: side.rest(h)) for h in {*ordinary.total, *toxic.total}}  # noqa: B023
        self.gram: dict[bytes, float] = {}
        for g in {*ordinary.found, *toxic.found}:
            base = shared.p(g)
            self.gram[g] = apart(lambda side: side.letter(g, base))  # noqa: B023
        self.unseen = apart(lambda side: side.left)
        size = len(vocabulary.keys)
        logs = np.fromiter((x for w in vocabulary.keys for x in letters(w)), "f8", 2 * size).reshape(-1, 2)
        #: the words' differences by their letters, in the order of the hashes
        self.letters = logs[:, 1] - logs[:, 0]
        p = np.stack([side.of_words(np.exp(logs[:, k])) for k, side in enumerate(sides)], 1)
        #: by hash of the word
        self.hashes = vocabulary.hashes
        self.words = np.log(p[:, 1]) - np.log(p[:, 0])
        # of each pair that either class has: what it adds to what its words have by themselves
        held = (ordinary.pairs + toxic.pairs) > 0
        seen = np.stack([np.maximum(side.words, 1) for side in sides], 1).astype("f8")
        # what is left for what a context hasn't been seen with
        left = 1 - np.stack([np.bincount(pairs.places[:, 0], np.maximum(side.pairs - DISCOUNT, 0), size) for side in sides], 1) / seen
        self.after = np.log(left[:, 1]) - np.log(left[:, 0])
        self.keys = pairs.keys[held]
        self.adds = np.empty(len(self.keys), "f4")
        done = 0
        for i in range(0, len(held), 1 << 18):
            some = slice(i, i + (1 << 18))
            h, w = pairs.places[some][held[some]].T
            kept = [np.maximum(side.pairs[some][held[some]] - DISCOUNT, 0) for side in sides]
            a, b = (np.log(left[h, k] * p[w, k] + kept[k] / seen[h, k]) for k in (0, 1))
            self.adds[done : done + len(h)] = b - a - self.after[h] - self.words[w]
            done += len(h)
        self.curve = np.zeros(4)

    def word(self, word: bytes) -> float:
        """By its letters. Where neither class has a gram, both fall back on the same shared probability and only their rests differ."""
        out, get, rest = 0.0, self.gram.get, self.rest.get
        for g in grams(word):
            d = get(g)
            out += rest(g[:-1], 0.0) if d is None else d
        return out

    def differences(self, texts: list[bytes], known: Known) -> list[np.ndarray]:
        """Of each text the number of words, and the difference for a word: of expressions, of letters, and of letters over the strongest."""
        found = [words(t) for t in texts]
        n, size = np.fromiter(map(len, found), "i8", len(found)), len(found)
        places = known.places([w for ws in found for w in ws])
        text = np.repeat(np.arange(size), n)
        each = np.maximum(n, 1)
        letters = np.bincount(text, known.letters[places], size).astype("f8")
        total = np.bincount(text, known.alone[places], size).astype("f8")
        ends = np.cumsum(n) - 1
        some = n > 0
        total[some] -= known.after[places[ends[some]]]  # nothing follows the last
        if len(places) > 1 and len(self.keys):
            inner = np.flatnonzero(text[1:] == text[:-1])
            hashes = known.hashes[places]
            keys = pair_key(hashes[inner], hashes[inner + 1])
            order = np.argsort(keys)  # keys looked for in their order lie near each other
            keys, of = keys[order], text[inner[order]]
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = self.keys[at] == keys
            total += np.bincount(of[hit], self.adds[at[hit]], size).astype("f8")
        # the strongest of a text's distinct words
        distinct = np.unique(text * len(known) + places) if len(places) else places
        of, strength = distinct // max(len(known), 1), known.letters[distinct % max(len(known), 1)]
        order = np.lexsort((-strength, of))
        of, strength = of[order], strength[order]
        rank = np.arange(len(of)) - np.searchsorted(of, of)
        peak = np.bincount(of[rank < PEAK], strength[rank < PEAK], size).astype("f8")
        return [n.astype("f8"), total / each, letters / each, peak / PEAK]

    def scores(self, *differences: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_features(*differences) @ self.curve, -30, 30)))


class Known(dict):
    """The words that a task has met, by their place in arrays: the difference by letters, that of the word with what follows it left open, that part, the hash."""

    def __init__(self, model: Model):
        self.model, self.waiting = model, []
        self.letters, self.alone, self.after = (np.zeros(1 << 12) for _ in range(3))
        self.hashes = np.zeros(1 << 12, "i8")

    def __missing__(self, word: bytes) -> int:
        place = self[word] = len(self)
        self.waiting.append(word)
        return place

    def places(self, found: list[bytes]) -> np.ndarray:
        """Where the words stand; new ones are worked out together."""
        out = np.fromiter(map(self.__getitem__, found), "i8", len(found))
        if self.waiting:
            m, last = self.model, len(self)
            first = last - len(self.waiting)
            if last > len(self.hashes):
                for name in ("letters", "alone", "after", "hashes"):
                    setattr(self, name, np.resize(getattr(self, name), 2 * last))
            h = np.fromiter(map(hashed, self.waiting), "i8", len(self.waiting))
            letters, alone, after = (np.zeros(len(h)) for _ in range(3))
            if len(m.hashes):
                at = np.minimum(np.searchsorted(m.hashes, h), len(m.hashes) - 1)
                seen = m.hashes[at] == h
                letters[seen], alone[seen], after[seen] = m.letters[at[seen]], m.words[at[seen]], m.after[at[seen]]
            else:
                seen = np.zeros(len(h), bool)
            for i in np.flatnonzero(~seen):
                letters[i] = m.word(self.waiting[i])
                alone[i] = m.unseen + letters[i]
            self.letters[first:last], self.alone[first:last], self.after[first:last], self.hashes[first:last] = letters, alone + after, after, h
            self.waiting = []
        return out


def _apart(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Each batch with its rows' numbers of words and differences; texts are taken together up to so many bytes, a longer one by itself."""
    known = Known(model)
    for batch in batches:
        texts = [t.as_py() or b"" for t in batch.column("text").cast(pa.binary())]
        found, first, held = [], 0, 0
        for i, t in enumerate(texts):
            held += len(t)
            if held >= MOST_TOGETHER or i == len(texts) - 1:
                if len(known) > MOST_KNOWN:
                    known = Known(model)
                found.append(model.differences(texts[first : i + 1], known))
                first, held = i + 1, 0
        yield batch, [np.concatenate([f[k] for f in found]) if found else np.zeros(0) for k in range(4)]


def _features(difference: np.ndarray, letters: np.ndarray, peak: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(peak)), np.clip(difference, -5, 5), np.clip(letters, -5, 5), np.clip(peak, -30, 30)], 1)


def fit_curve(differences: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Newton's steps for the logistic curve, with a little ridge."""
    x, y = _features(*differences), toxic.astype(float)
    b = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(b)), x.T @ (y - p) - 1e-3 * b)
        b = b + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return b


def _scorer(shared, extra: list[str]):
    @tidy
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch, (n, *apart) in _apart(model, batches):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in extra), pa.array(n.astype("i8")), *map(pa.array, apart), pa.array(model.scores(*apart))], names=[*extra, "n_words", "difference", "letters", "peak", "score"])

    return score


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Model | None:
    """The fitted model; None if the sample lacks toxic or ordinary rows."""
    rows = sample(docs, labels, most_rows).cache()
    by_word = cut(word_counts(rows, "toxic", "fold"))
    counted = cut(by_word.mapInArrow(_grams_of_words, "toxic int, fold int, gram binary, n long").groupBy("toxic", "fold", "gram").agg(F.sum("n").alias("n")))
    letters = Table(counted, "gram")
    if not letters.counts.sum((0, 2)).all():
        rows.unpersist()
        return None
    vocabulary = Vocabulary(by_word)
    pairs = Pairs(rows, vocabulary.hashes)
    give_back()
    shared = Shared.counted(cut(corpus_grams(docs).select("gram")), counted.select("gram"))

    def side(toxic: int, but: int | None = None) -> Side:
        return Side(letters.of(toxic, but), _but(vocabulary.counts, toxic, but), pairs.of(toxic, but))

    sc, seen = docs.sparkSession.sparkContext, []
    for f in range(FOLDS):  # one model at a time, on the driver, in the workers and on their disks
        held = sc.broadcast(Model(side(0, f), side(1, f), shared, vocabulary, pairs))
        seen += rows.where(F.col("fold") == f).select("toxic", "text").mapInArrow(_scorer(held, ["toxic"]), f"toxic int, {SCORED}").select("toxic", "difference", "letters", "peak").collect()
        held.destroy()
        give_back()
    rows.unpersist()
    toxic, *apart = np.array(sorted(tuple(r) for r in seen), "f8").reshape(-1, 4).T  # sorted: the same sums on any cluster
    model = Model(side(0), side(1), shared, vocabulary, pairs)
    model.curve = fit_curve(apart, toxic)
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """doc_id, n_words, difference, letters, peak, score for each row of docs."""
    model = train(docs, labels, most_rows)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if model is None:
        return plain.select("doc_id", F.lit(0).cast("long").alias("n_words"), *(F.lit(0.0).alias(c) for c in ("difference", "letters", "peak", "score")))
    return plain.mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(model), ["doc_id"]), f"doc_id long, {SCORED}")


def _keeper(shared, threshold: float):
    @tidy
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch, (_, *apart) in _apart(model, batches):
            yield batch.filter(pa.array(model.scores(*apart) < threshold, pa.bool_()))

    return keep


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most_rows: int = MOST_ROWS) -> DataFrame:
    """docs without the rows that score threshold or more, with all their columns; nothing is shuffled for it."""
    model = train(docs, labels, most_rows)
    if model is None:
        return docs
    return docs.mapInArrow(_keeper(docs.sparkSession.sparkContext.broadcast(model), threshold), docs.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_words", "difference", "letters", "peak")
