"""Quality classifier from weak labels.

Heuristic labellers vote on each text: keep, reject or abstain. They come in aspects (abuse, symbols, shouting, repetition); within an aspect
expectation-maximisation estimates the prior and each labeller's accuracy from how often the labellers agree, over the counts of
vote patterns of the whole table (a pattern has at most 3^labellers values, however large the table). The posterior
probability that a text is to go, over all aspects, is its weak label. A linear scorer over hashed features is then fitted to the posteriors
of a bounded sample, and scores every text; texts with a positive score are rejected.

Some labellers look for word beginnings that mark abuse. They are learnt from at most LABEL_ROWS annotated rows (id, toxic): those
beginnings that STEM_ROWS or more toxic texts hold and that seldom occur in others. Without annotations these labellers abstain.

Features are the words a text holds and their beginnings (as a set, hashed to 2^BITS), and the ranges that its character statistics fall in.
The L1 penalty leaves most weights at zero, so that a long text is not judged by the noise of many words.

SAMPLE_ROWS bounds the rows that the scorer is fitted on; votes, pattern counts and scores cover every row.

Defined cases: a null text counts as empty, and an empty text gets votes like any other; repeated rows are scored each; an
empty table gives no rows; a table without one of the classes follows the prior; other columns are kept by `filter_rows` and ignored otherwise.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHashes, documents

KEEP, REJECT, ABSTAIN = 0, 1, 2
BITS = 18
SAMPLE_ROWS = 8_000
LABEL_ROWS = 6_000
STEM_ROWS = 6
STEM_BYTES = (6, 8)
ABUSE = (
    "abhorrent bastard clown contemptible cretin degenerate despicable disgusting dumb filthy garbage halfwit idiot imbecile loathsome "
    "loser lowlife moron nitwit pathetic repulsive scum scumbag stupid trash vermin wanker worthless wretch"
).split()
_ABUSE = frozenset(w.encode() for w in ABUSE)
_STRIP = b".,;:!?\"'()[]{}*#$%&|<>-"
_SYMBOLS = re.compile(r"[#*$%&|<>]+")
_LETTERS = re.compile(r"[^\W\d_]+")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]+")


def _length(pattern: re.Pattern, text: str) -> int:
    return sum(map(len, pattern.findall(text)))


def stems(words) -> set[bytes]:
    """The beginnings of words, each at STEM_BYTES bytes."""
    return {w[:n] for w in words for n in STEM_BYTES if len(w) >= n}


@dataclass(frozen=True)
class Stats:
    """What labellers and features see of a text."""

    n_words: int
    distinct: frozenset
    abusive: int
    marked: int
    symbols: int
    chars: int
    letters: int
    lines: int
    repeated_lines: int
    top: int
    doubled: int
    upper: int
    shouts: int

    @classmethod
    def of(cls, text: str, marks: frozenset = frozenset()) -> Stats:
        words = text.encode().lower().split()
        counts = Counter(words)
        distinct = frozenset(w.strip(_STRIP) for w in counts)
        lines = [x for x in text.split("\n") if x.strip()]
        marked = sum(1 for w in distinct if w[:6] in marks or w[:8] in marks) if marks else 0
        return cls(
            len(words), distinct, len(distinct & _ABUSE), marked, _length(_SYMBOLS, text), sum(map(len, text.split())), _length(_LETTERS, text), len(lines), len(lines) - len(set(lines)),
            max(counts.values(), default=0), sum(map(eq, words, words[1:])), _length(_UPPER, text), text.count("!"),
        )


def _share(part: float, whole: float) -> float:
    return part / whole if whole else 0.0


def _vote(reject: bool, keep: bool) -> int:
    return REJECT if reject else KEEP if keep else ABSTAIN


#: aspect -> labellers; each sees Stats and gives KEEP, REJECT or ABSTAIN.
LABELLERS = {
    "abuse": (
        lambda s: _vote(s.abusive >= 1, s.marked <= 1),
        lambda s: _vote(s.abusive >= 2, s.abusive == 0 and s.marked == 0),
        lambda s: _vote(s.marked >= 2, s.marked == 0 and s.abusive == 0),
        lambda s: _vote(s.marked >= 3, s.marked == 0 and s.abusive == 0),
    ),
    "symbols": (
        lambda s: _vote(_share(s.symbols, s.n_words) > 0.3, _share(s.symbols, s.n_words) < 0.05),
        lambda s: _vote(_share(s.symbols, s.chars) > 0.05, _share(s.symbols, s.chars) < 0.01),
        lambda s: _vote(s.n_words >= 20 and _share(s.letters, s.chars) < 0.75, _share(s.letters, s.chars) > 0.9 or s.n_words < 20),
    ),
    "shouting": (
        lambda s: _vote(s.n_words >= 10 and _share(s.upper, s.letters) > 0.5, _share(s.upper, s.letters) < 0.25 or s.n_words < 10),
        lambda s: _vote(s.n_words >= 10 and _share(s.shouts, s.n_words) > 0.4, _share(s.shouts, s.n_words) < 0.1 or s.n_words < 10),
        lambda s: _vote(s.n_words >= 10 and _share(s.upper, s.chars) > 0.3, _share(s.upper, s.chars) < 0.2 or s.n_words < 10),
    ),
    "repetition": (
        lambda s: _vote(s.n_words >= 40 and _share(s.top, s.n_words) > 0.25, _share(s.top, s.n_words) < 0.15 or s.n_words < 40),
        lambda s: _vote(s.n_words >= 40 and _share(s.doubled, s.n_words) > 0.25, _share(s.doubled, s.n_words) < 0.1 or s.n_words < 40),
        lambda s: _vote(s.n_words >= 40 and _share(len(s.distinct), s.n_words) < 0.08, s.n_words < 40 or _share(len(s.distinct), s.n_words) > 0.2),
        lambda s: _vote(s.lines >= 6 and _share(s.repeated_lines, s.lines) > 0.6, _share(s.repeated_lines, s.lines) < 0.4),
    ),
}


def votes(stats: Stats) -> str:
    """One digit a labeller, aspects in order, apart by a dash."""
    return "-".join("".join(str(f(stats)) for f in own) for own in LABELLERS.values())


class LabelModel:
    """Two latent classes and, for each labeller, the chance of each vote in each class."""

    def __init__(self, prior: float, table: np.ndarray):
        self.prior, self.table = prior, table  # table[labeller, class, vote]

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """P(reject | votes) of each row of an integer matrix."""
        log = np.log(self.table)
        at = np.arange(patterns.shape[1])
        keep = np.log1p(-self.prior) + log[at, 0, patterns].sum(axis=1)
        reject = np.log(self.prior) + log[at, 1, patterns].sum(axis=1)
        return 1 / (1 + np.exp(np.clip(keep - reject, -700, 700)))

    def accuracy(self) -> list[float]:
        """Of each labeller, where it votes."""
        right = (1 - self.prior) * self.table[:, 0, KEEP] + self.prior * self.table[:, 1, REJECT]
        says = (1 - self.prior) * self.table[:, 0, :2].sum(axis=1) + self.prior * self.table[:, 1, :2].sum(axis=1)
        return (right / says).tolist()

    @classmethod
    def fit(cls, patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
        """EM from the majority vote; `counts` weighs the patterns. Each vote has a pseudo-count, so no chance becomes 0."""
        rejects, keeps = (patterns == REJECT).sum(axis=1), (patterns == KEEP).sum(axis=1)
        p = np.where(rejects * 2 >= np.maximum(1, keeps), 0.9, 0.05) if len(patterns) else np.zeros(0)
        prior, table = 0.1, np.full((patterns.shape[1], 2, 3), 1 / 3)
        for _ in range(rounds):
            was = table
            weights = np.stack([counts * (1 - p), counts * p])
            prior = float(np.clip((weights[1].sum() + 0.1) / (counts.sum() + 1), 1e-4, 0.5))
            table = np.stack([[np.bincount(patterns[:, k], weights[c], 3) + 0.1 for c in (0, 1)] for k in range(patterns.shape[1])])
            table /= table.sum(axis=2, keepdims=True)
            p = cls(prior, table).posterior(patterns)
            if np.abs(table - was).max() < 1e-9:
                break
        return cls(prior, table)


def weak_posteriors(pattern_counts: dict[str, int]) -> tuple[dict[str, float], dict[str, LabelModel]]:
    """P(reject) of each vote pattern, one minus the chance that no aspect rejects; and the aspects' models."""
    names = list(pattern_counts)
    counts = np.array([pattern_counts[n] for n in names], float)
    keep, models = np.ones(len(names)), {}
    for k, aspect in enumerate(LABELLERS):
        matrix = np.array([[int(c) for c in n.split("-")[k]] for n in names], int).reshape(len(names), len(LABELLERS[aspect]))
        models[aspect] = LabelModel.fit(matrix, counts)
        keep *= 1 - models[aspect].posterior(matrix)
    return dict(zip(names, (1 - keep).tolist(), strict=True)), models


def feature_names(s: Stats) -> list[bytes]:
    """Words, their beginnings (after a byte that no word has), and the ranges that the text's statistics fall in."""
    n = s.n_words
    return [
        *s.distinct,
        *(b"\1" + x for x in stems(s.distinct)),
        b"\0symbols%d" % min(20, int(20 * _share(s.symbols, n))),
        b"\0upper%d" % (int(10 * _share(s.upper, s.letters)) if n >= 10 else 0),
        b"\0shouts%d" % (min(10, int(10 * _share(s.shouts, n))) if n >= 10 else 0),
        b"\0letters%d" % (int(20 * _share(s.letters, s.chars)) if n >= 20 else 20),
        b"\0repeated%d" % (int(10 * _share(s.repeated_lines, s.lines)) if s.lines >= 6 else 0),
        b"\0top%d" % (int(20 * _share(s.top, n)) if n >= 40 else 0),
        b"\0doubled%d" % (int(20 * _share(s.doubled, n)) if n >= 40 else 0),
    ]


def features(s: Stats, hashes: WordHashes, bits: int = BITS) -> np.ndarray:
    """Distinct hashed features, uint32."""
    return np.unique(hashes.of(feature_names(s)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


@dataclass
class Scorer:
    """score = bias + sum of the weights of the features a text holds."""

    bias: float
    weights: np.ndarray

    def score(self, found: np.ndarray) -> float:
        return self.bias + float(self.weights[found].sum())

    @classmethod
    def fit(cls, rows: list[np.ndarray], target: np.ndarray, bits: int = BITS, penalty: float = 2e-4, rounds: int = 500) -> Scorer:
        """Logistic loss against soft labels with an L1 penalty, both classes weighing the same, by accelerated proximal gradient."""
        weights = np.zeros(1 << bits)
        total = target.sum()
        if not len(rows) or min(total, len(rows) - total) < 0.5:
            return cls(-1.0 if not len(rows) or total < len(rows) / 2 else 1.0, weights)
        columns, where = np.unique(np.concatenate(rows), return_inverse=True)
        sizes = np.array([len(r) for r in rows])
        owner = np.repeat(np.arange(len(rows)), sizes)
        share = 0.5 * target / total + 0.5 * (1 - target) / (len(rows) - total)
        # Columns seen in many texts would set the step for all; each column gets its own, by its weighted size and the texts' lengths.
        reach = np.bincount(where, (share * np.sqrt(sizes))[owner], len(columns))
        step = 4.0 / np.maximum(reach, 1e-6) / np.sqrt(sizes.max())
        w = ahead = np.zeros(len(columns))
        bias = bias_ahead = 0.0
        momentum = 1.0
        for _ in range(rounds):
            z = bias_ahead + np.bincount(owner, ahead[where], len(rows))
            error = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target)
            moved = ahead - step * np.bincount(where, error[owner], len(columns))
            new = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0)
            new_bias = bias_ahead - 2.0 * error.sum()
            following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
            ahead, bias_ahead = new + (momentum - 1) / following * (new - w), new_bias + (momentum - 1) / following * (new_bias - bias)
            if (ahead - new) @ (new - w) < 0:
                following, ahead, bias_ahead = 1.0, new, new_bias
            w, bias, momentum = new, new_bias, following
        weights[columns] = w
        return cls(float(bias), weights)


@dataclass
class Model:
    """What `fit` learns: marking word beginnings, label models by aspect, the posterior of each vote pattern, the scorer, its threshold."""

    marks: frozenset
    labels: dict[str, LabelModel]
    posterior: dict[str, float]
    scorer: Scorer


def _text(docs: DataFrame, text_col: str):
    return F.coalesce(F.col(f"`{text_col}`"), F.lit(""))


def _marks(docs: DataFrame, annotated: DataFrame | None, id_col: str, text_col: str, label_rows: int) -> frozenset:
    """Word beginnings of toxic texts, from at most `label_rows` annotated rows (columns `doc_id`, `toxic`), picked by a hash of the id."""
    if annotated is None:
        return frozenset()
    picked = annotated.where("doc_id IS NOT NULL AND toxic IS NOT NULL").select(F.col("doc_id").alias("_key"), F.col("toxic").cast("int").alias("_toxic"))
    picked = picked.orderBy(F.xxhash64("_key"), "_key", "_toxic").limit(label_rows)  # bounded, so it may be broadcast

    def gather(batches):
        for batch in batches:
            got = [b"\0".join(sorted(stems(Stats.of(t).distinct))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_toxic"), pa.array(got, pa.binary())], names=["toxic", "stems"])

    rows = docs.select(F.col(f"`{id_col}`").alias("_key"), _text(docs, text_col).alias("text")).join(F.broadcast(picked), "_key").select("_toxic", "text")
    inside, outside = Counter(), Counter()
    for r in rows.mapInArrow(gather, "toxic int, stems binary").toLocalIterator():
        (inside if r["toxic"] else outside).update(bytes(r["stems"]).split(b"\0"))
    return frozenset(x for x, n in inside.items() if x and n >= STEM_ROWS and n >= 9 * outside[x])


def fit(docs: DataFrame, annotated: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, label_rows: int = LABEL_ROWS) -> Model:
    """Learn from `docs`, all of which vote; `annotated` (doc_id, toxic) may name some of them."""
    marks = _marks(docs, annotated, id_col, text_col, label_rows)

    def vote(batches):
        for batch in batches:
            got = [votes(Stats.of(t, marks)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.string())], names=["pattern"])

    texts = docs.select(_text(docs, text_col).alias("text"))
    counts = {r["pattern"]: r["count"] for r in texts.mapInArrow(vote, "pattern string").groupBy("pattern").count().collect()}
    posterior, models = weak_posteriors(dict(sorted(counts.items())))

    # The sample: about half from each side, by a hash of id and text, so that it is the same however the table is partitioned.
    sides = [sum(n for p, n in counts.items() if (posterior[p] >= 0.5) == side) for side in (False, True)]
    shares = [min(1.0, sample_rows / 2 / max(1, n)) for n in sides]
    drawn = (F.xxhash64(F.col(f"`{id_col}`"), _text(docs, text_col), F.lit("sample")) % 1_000_000 + 1_000_000) / 2_000_000
    chosen = docs.select(_text(docs, text_col).alias("text"), drawn.alias("u")).where(F.col("u") < max(shares))

    def sample(batches):
        hashes = WordHashes()
        for batch in batches:
            rows = []
            for t, u in zip(batch.column("text").to_pylist(), batch.column("u").to_pylist(), strict=True):
                s = Stats.of(t, marks)
                p = posterior.get(votes(s), 0.0)
                if u < shares[p >= 0.5]:
                    rows.append((u, p, features(s, hashes).tobytes()))
            if rows:
                u, p, f = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.float64()), pa.array(p, pa.float64()), pa.array(f, pa.binary())], names=["u", "p", "f"])

    rows = sorted(chosen.mapInArrow(sample, "u double, p double, f binary").collect(), key=lambda r: (r["u"], r["f"]))
    scorer = Scorer.fit([np.frombuffer(r["f"], np.uint32) for r in rows], np.array([r["p"] for r in rows]))
    # The sample holds both sides alike; the table does not.
    share = min(0.5, max(1e-3, sum(n * posterior[p] for p, n in counts.items()) / max(1, sum(counts.values()))))
    scorer.bias -= float(np.log((1 - share) / share))
    return Model(marks, models, posterior, scorer)


def _score(model: Model, names: list[str]):
    """Batches of `names`, and the weak posterior and the score of the column `_text`."""
    weights, bias, marks, posterior = model.scorer.weights, model.scorer.bias, model.marks, model.posterior
    active = np.flatnonzero(weights)
    table = dict(zip(active.tolist(), weights[active].tolist(), strict=True))

    def run(batches):
        import xxhash

        mask, known = (1 << BITS) - 1, {}
        for batch in batches:
            scores, weak = [], []
            for t in batch.column("_text").to_pylist():
                s = Stats.of(t, marks)
                slots = set()
                for name in feature_names(s):
                    slot = known.get(name)
                    if slot is None:
                        if len(known) > 300_000:
                            known.clear()
                        slot = xxhash.xxh3_64_intdigest(name) & mask
                        slot = known[name] = slot if slot in table else -1
                    if slot >= 0:
                        slots.add(slot)
                scores.append(bias + sum(table[x] for x in sorted(slots)))
                weak.append(posterior.get(votes(s), 0.0))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(weak, pa.float64()), pa.array(scores, pa.float64())], names=[*names, "_weak", "_score"])

    return run


def _scored(docs: DataFrame, model: Model, column, text_col: str) -> DataFrame:
    rows = docs.select(column.alias("_row"), _text(docs, text_col).alias("_text"))
    schema = T.StructType([rows.schema["_row"], T.StructField("_weak", T.DoubleType()), T.StructField("_score", T.DoubleType())])
    return rows.mapInArrow(_score(model, ["_row"]), schema)


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, p_weak (the label models' probability that the text is to go), score, kept. Nothing is shuffled."""
    out = _scored(docs, model, F.col(f"`{id_col}`"), text_col)
    return out.select(F.col("_row").alias("doc_id"), F.col("_weak").alias("p_weak"), F.col("_score").alias("score"), (F.col("_score") <= 0).alias("kept"))


def filter_rows(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that are not rejected, with all their columns."""
    return _scored(docs, model, F.struct(*[F.col(f"`{c}`") for c in docs.columns]), text_col).where("_score <= 0").select("_row.*")


def annotations(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")


def op9_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return classify(docs, fit(docs, annotations(spark, sf_dir)))
