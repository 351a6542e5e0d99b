"""A toxicity classifier that is held to treat mentions of groups alike.

Words, and stems of words, that part toxic from other labelled texts are chosen by the z-score of their log odds.
A logistic regression over the words present is fitted to a bounded sample of labelled rows;
besides the usual loss it is penalised for every change of a sentence's score when the identity
terms of a labelled sentence, in whatever form they stand, are swapped for others of their group
(women for men, one faith for another), so that a mention of a group alone tells nothing. The
swapped sentence is given features anew, stems included. ``Model.swapped`` says how many labelled
sentences hold a term: where it is 0 the fit is a plain one. Groups of terms are an argument;
those given here are of four languages.

The sample is taken from the labels alone, by least hash of doc_id, and only its ids meet the
texts, by a broadcast of at most ``Fit.sample`` ids; so no text is shuffled.

Labels come only from rows outside the held-out fold; lang, source and doc_id are never
inputs. Null and empty texts are scored by the intercept. Very long texts are read whole.
Documents without a label are scored and not learnt from; repeated rows are scored each.
Equal labels of one id count once, conflicting ones each; of several texts with one id the one
of least hash is learnt from. Ties of the sample's hash go by doc_id, then label. Without labels
of both kinds every score is the share of toxic labels (0 if none). An empty table gives an
empty result. Only the named columns are read, so others may have any names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, blank, stash, table, texts

#: Identity terms by language and group. Terms of a group are swapped for one
#: another, form for form where both have it (singular, plural, others), else for the first.
IDENTITY: dict[str, tuple[tuple[tuple[str, ...], ...], ...]] = {
    "en": (
        (("woman", "women"), ("man", "men"), ("girl", "girls"), ("boy", "boys"), ("female", "females"), ("male", "males"), ("transgender", "transgenders"), ("nonbinary",)),
        (("christian", "christians"), ("muslim", "muslims"), ("jewish", "jews", "jew"), ("hindu", "hindus"), ("buddhist", "buddhists"), ("sikh", "sikhs"), ("atheist", "atheists"), ("catholic", "catholics")),
        (("black", "blacks"), ("white", "whites"), ("asian", "asians"), ("african", "africans"), ("latino", "latinos"), ("hispanic", "hispanics"), ("arab", "arabs"), ("indigenous",)),
        (("gay", "gays"), ("lesbian", "lesbians"), ("bisexual", "bisexuals"), ("straight", "straights"), ("queer", "queers"), ("heterosexual", "heterosexuals")),
        (("immigrant", "immigrants"), ("refugee", "refugees"), ("foreigner", "foreigners"), ("native", "natives"), ("mexican", "mexicans"), ("chinese",), ("indian", "indians"), ("german", "germans")),
        (("disabled",), ("blind",), ("deaf",), ("autistic",), ("old", "older", "oldest"), ("young", "younger", "youngest")),
    ),
    "fr": (
        (("femme", "femmes"), ("homme", "hommes"), ("fille", "filles"), ("garçon", "garçons")),
        (("chrétien", "chrétiens"), ("musulman", "musulmans"), ("juif", "juifs"), ("athée", "athées")),
        (("homosexuel", "homosexuels"), ("hétérosexuel", "hétérosexuels"), ("lesbienne", "lesbiennes")),
        (("immigré", "immigrés"), ("réfugié", "réfugiés"), ("étranger", "étrangers"), ("africain", "africains"), ("asiatique", "asiatiques")),
    ),
    "de": (
        (("frau", "frauen"), ("mann", "männer"), ("mädchen",), ("junge", "jungen")),
        (("christ", "christen"), ("muslim", "muslime"), ("jude", "juden"), ("atheist", "atheisten")),
        (("homosexueller", "homosexuelle"), ("heterosexueller", "heterosexuelle"), ("lesbe", "lesben")),
        (("einwanderer",), ("flüchtling", "flüchtlinge"), ("ausländer",), ("afrikaner",), ("asiate", "asiaten")),
    ),
    "es": (
        (("mujer", "mujeres"), ("hombre", "hombres"), ("niña", "niñas"), ("niño", "niños")),
        (("cristiano", "cristianos"), ("musulmán", "musulmanes"), ("judío", "judíos"), ("ateo", "ateos")),
        (("homosexual", "homosexuales"), ("heterosexual", "heterosexuales"), ("lesbiana", "lesbianas")),
        (("inmigrante", "inmigrantes"), ("refugiado", "refugiados"), ("extranjero", "extranjeros"), ("africano", "africanos"), ("asiático", "asiáticos")),
    ),
}
Groups = dict[str, tuple[tuple[tuple[str, ...], ...], ...]]


def swaps_of(groups: Groups) -> list[list[dict[bytes, bytes]]]:
    """For each group, for each turn, what every form of its terms becomes."""
    out = []
    for group in (g for language in groups.values() for g in language):
        turns = []
        for turn in range(1, len(group)):
            to: dict[bytes, bytes] = {}
            for i, own in enumerate(group):
                other = group[(i + turn) % len(group)]
                for k, form in enumerate(own):
                    to.setdefault(form.encode(), other[k if k < len(other) else 0].encode())
            turns.append(to)
        out.append(turns)
    return out


#: Punctuation becomes white space; letters A-Z lose their case.
_PLAIN = bytes(32 if chr(b) in "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~" else b + 32 if 65 <= b <= 90 else b for b in range(256))


#: Ends of sentences.
SENTENCE = re.compile(rb"[.!?\n]+")


@dataclass(frozen=True)
class Fit:
    """sample: most labelled rows that are learnt from, those with the least hash of doc_id.
    rare: documents of the sample that a feature is in, at least. z: least z-score of its log
    odds; every feature that has it is taken. ridge, swap: weights of the penalties."""

    sample: int = 8000
    rare: int = 4
    z: float = 3.5
    ridge: float = 2e-3
    swap: float = 1.0
    steps: int = 400


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


#: Bytes of a word's beginning that are features too, as marked stems: languages that join
#: words carry insults as parts of longer words.
STEMS = (5, 6, 7, 8)


def _with_stems(words: set[bytes]) -> set[bytes]:
    return words.union(*[{b"^" + w[:k] for w in words if len(w) > k} for k in STEMS])


def features_of(text: bytes) -> set[bytes]:
    """The words of a text, and their stems after a "^"."""
    return _with_stems(set(text.translate(_PLAIN).split()))


Change = tuple[tuple[bytes, ...], tuple[bytes, ...]]


def changes_of(text: bytes, swaps: list[list[dict[bytes, bytes]]]) -> tuple[int, Counter[Change]]:
    """How many sentences hold a term; and for every swap that changes one, the features that
    it gains and loses, with how often."""
    touched, out = 0, Counter()
    for sentence in SENTENCE.split(text):
        words = set(sentence.translate(_PLAIN).split())
        mine = [group for group in swaps if group and not words.isdisjoint(group[0])]
        touched += bool(mine)
        before = _with_stems(words) if mine else words
        for to in (t for group in mine for t in group):
            after = _with_stems({to.get(w, w) for w in words})
            out[tuple(sorted(after - before)), tuple(sorted(before - after))] += 1
    return touched, out


def _bags(rows: DataFrame, groups: Groups) -> DataFrame:
    """Features and changes of labelled texts: doc_id, toxic, key (of the text), words, touched
    (sentences with a term), changes."""
    swaps = swaps_of(groups)
    plain = lambda features: [w.decode("latin-1") for w in features]

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        split = texts(batch)
        found = [changes_of(t, swaps) for t in split]
        yield {n: batch.column(n) for n in ("doc_id", "toxic", "key")} | {
            "words": [plain(sorted(features_of(t))) for t in split],
            "touched": [n for n, _ in found],
            "changes": [[{"gain": plain(g), "loss": plain(d), "n": n} for (g, d), n in c.items()] for _, c in found],
        }

    kind = dict(rows.dtypes)["doc_id"]
    changes = "array<struct<gain:array<string>,loss:array<string>,n:bigint>>"
    return arrow_map(rows.select("doc_id", "toxic", "key", "text"), run, f"doc_id {kind}, toxic int, key bigint, words array<string>, touched bigint, changes {changes}")


@dataclass
class Model:
    """swapped: labelled sentences in which an identity term was swapped."""

    weights: dict[str, float]
    intercept: float
    swapped: int = 0

    def score(self, docs: DataFrame) -> DataFrame:
        """doc_id and score."""
        weights, intercept = {w.encode("latin-1"): v for w, v in self.weights.items()}, self.intercept

        def run(batch: pa.RecordBatch) -> Iterator[dict]:
            keys = weights.keys()
            total = np.array([intercept + sum(weights[w] for w in sorted(keys & features_of(t))) for t in texts(batch)])
            yield {"doc_id": batch.column("doc_id"), "score": 1 / (1 + np.exp(-np.clip(total, -30, 30)))}

        return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def train(docs: DataFrame, labels: DataFrame, how: Fit = Fit(), groups: Groups = IDENTITY) -> Model:
    """Fits to texts of ``docs`` (doc_id, text) by at most ``how.sample`` rows of ``labels``
    (doc_id, toxic)."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    sample = stash(known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(how.sample), "sample")
    # at most how.sample rows of two numbers
    rows = docs.select("doc_id", "text", F.xxhash64(blank(F.col("text"))).alias("key")).join(F.broadcast(sample), "doc_id")
    each = _bags(rows, groups).groupBy("doc_id", "toxic").agg(F.min_by(F.struct("words", "touched", "changes"), "key").alias("bag"))
    bags = stash(each.select("toxic", "bag.*"), "bags")
    totals = {r["toxic"]: r["n"] for r in bags.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    if not n0 or not n1:
        return Model({}, 30.0 if n1 else -30.0)
    counts = bags.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum("toxic").alias("k1"), F.sum(1 - F.col("toxic")).alias("k0"))
    a, b = F.col("k1") + 0.5, F.col("k0") + 0.5
    odds = F.log(a / (n1 + 1 - a)) - F.log(b / (n0 + 1 - b))
    z = odds / F.sqrt(1 / a + 1 / b)
    telling = counts.where(F.col("k1") + F.col("k0") >= how.rare).where(F.abs(z) >= how.z).select("word")
    changes = bags.select(F.explode("changes").alias("c")).groupBy("c.gain", "c.loss").agg(F.sum("c.n").alias("n")).collect()
    vocabulary = {w: i for i, w in enumerate(sorted(r["word"] for r in telling.collect()))}

    def places(batch: pa.RecordBatch) -> Iterator[dict]:
        yield {"toxic": batch.column("toxic"), "at": [[vocabulary[w] for w in words if w in vocabulary] for words in batch.column("words").to_pylist()]}

    found = arrow_map(bags.select("toxic", "words"), places, "toxic int, at array<int>").collect()  # at most how.sample rows
    y = np.array([r["toxic"] for r in found], dtype=np.float64)
    x = _Sparse([r["at"] for r in found], None, len(vocabulary))
    signed = [[(vocabulary[w], v) for v, words in ((1.0, r["gain"]), (-1.0, r["loss"])) for w in words if w in vocabulary] for r in changes]
    swap = _Sparse([[at for at, _ in r] for r in signed], [[v for _, v in r] for r in signed], len(vocabulary))
    often = np.array([r["n"] for r in changes], dtype=np.float64) / len(y)
    w, bias = _descend(x, y, swap, often, how)
    touched = bags.agg(F.sum("touched")).first()[0]
    return Model({t: float(w[i]) for t, i in vocabulary.items() if w[i]}, bias, int(touched))


class _Sparse:
    """Rows of few columns."""

    def __init__(self, rows: list[list[int]], values: list[list[float]] | None, width: int) -> None:
        sizes = [len(r) for r in rows]
        self.row, self.shape = np.repeat(np.arange(len(rows)), sizes), (len(rows), width)
        self.column = np.array([c for r in rows for c in r], dtype=np.int64)
        self.value = np.array([v for r in values for v in r]) if values is not None else np.ones(len(self.column))

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=self.value * w[self.column], minlength=self.shape[0])

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, weights=self.value * r[self.row], minlength=self.shape[1])


def _descend(x: _Sparse, y: np.ndarray, swap: _Sparse, often: np.ndarray, how: Fit) -> tuple[np.ndarray, float]:
    """``swap``: rows of a swap's changes; ``often``: how many a text there are of each."""
    w, bias = np.zeros(x.shape[1], dtype=np.float64), float(np.log(y.mean() / (1 - y.mean())))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, how.steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x.times(w) + bias, -30, 30)))
        pull = swap.back(often * swap.times(w)) if len(often) else 0.0
        g = np.append(x.back(p - y) / len(y) + how.ridge * w + how.swap * pull, (p - y).mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - float(move[-1])
    return w, bias


def op7_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learn = labels.where(~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    model = train(docs, learn)
    out = model.score(docs)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
