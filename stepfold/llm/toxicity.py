"""Toxicity by compression distance: how much shorter a window gets when zstandard may refer to toxic text.

Two zstandard dictionaries of one budget are trained apart, on a bounded sample of labelled rows: one on windows of
ordinary texts, one on the stretches of toxic texts whose fragments ordinary texts lack beyond chance. Every window of
a text is compressed once with the ordinary dictionary and once with both. A logistic model over the differences (how
many windows, and what share of them, gain so many bytes), fitted on sampled rows that the dictionaries did not see,
gives the score, so that the threshold is calibrated.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 6000  #: labelled rows that reach the driver for fitting, at most
SAMPLE_TEXT_BYTES = 1 << 16  #: longer texts are not learned from, so the sample has 400 MB at most; all are scored
#: Words of a window, to choose from: in longer ones the noise of ordinary words drowns a match, in shorter ones a match of
#: several words is cut. `fit` takes the length of least loss by cross-validation within the sample.
WINDOWS = (1, 2, 3, 4)
DICTIONARY_BYTES = 4096  #: of either trained dictionary, at most
RAW_BYTES = 1 << 14  #: of a dictionary of samples that are too few for training, at most; the compressor's window holds two
FRAGMENTS = (6, 8)  #: bytes of the fragments whose texts are counted; words are led and followed by a space
CHANCE = 1.0  #: number of fragments that are expected to count as telling by chance, at most
LIFT = 3.0  #: times that a telling fragment is commoner in toxic texts, at least
MIN_MATCH = 6  #: bytes; a shorter match costs as much as the bytes themselves
GAINS = (2, 3, 4, 5, 6)  #: bytes that a window must gain to be counted
#: Follows every window and ends either dictionary: zstandard seeks no match in the last bytes and stores raw what does
#: not shrink; so each match in the window itself shows in its length.
PAD = b"0123456789" * 6
N_FEATURES = 2 * len(GAINS) + 2
THRESHOLD = 0.3
KNOWN_WINDOWS = 1 << 18  #: gains that a task keeps before it starts anew, about; 30 MB
PLAIN_WINDOWS = 100_000  #: windows that the ordinary dictionary is trained on, at most
#: ASCII bytes that are no letter count as white space; all other bytes stay.
LETTERS_ONLY = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(LETTERS_ONLY).split()


def windows(text: str | None, n: int) -> list[bytes]:
    """Consecutive windows of n words that together cover the whole text."""
    w = words(text)
    return [b" %b " % b" ".join(w[i : i + n]) for i in range(0, len(w), n)]


@dataclass
class Classifier:
    ordinary: bytes
    toxic: bytes
    weights: list[float]
    window: int = WINDOWS[0]
    mean: list[float] = field(default_factory=lambda: [0.0] * N_FEATURES)
    spread: list[float] = field(default_factory=lambda: [1.0] * N_FEATURES)

    def compressors(self):
        def make(content: bytes):
            d = zstandard.ZstdCompressionDict(content + PAD, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            return zstandard.ZstdCompressor(compression_params=params, dict_data=d).compress

        params = zstandard.ZstdCompressionParameters(
            window_log=15, hash_log=15, chain_log=15, search_log=4, min_match=MIN_MATCH, strategy=zstandard.STRATEGY_GREEDY, write_content_size=0, write_checksum=0, write_dict_id=0
        )
        return make(self.ordinary), make(self.ordinary + self.toxic)

    def features(self, text: str | None, pair=None, known: dict[bytes, int] | None = None) -> list[float]:
        """`known` keeps the gains of windows that were compressed before; most windows of few words occur often."""
        ordinary, toxic = pair or self.compressors()
        known = {} if known is None else known
        if len(known) > KNOWN_WINDOWS:
            known.clear()
        of = windows(text, self.window)
        for w in of:
            if w not in known:
                known[w] = len(ordinary(w + PAD)) - len(toxic(w + PAD))
        d = np.array([known[w] for w in of], dtype=float)
        strong = np.array([(d >= g).sum() for g in GAINS])
        return [*np.log((strong + 0.25) / (len(d) + 5)), *np.log1p(strong), np.log1p(len(d)), d.mean() if len(d) else 0.0]

    def rows(self, texts) -> np.ndarray:
        pair, known = self.compressors(), {}
        return np.array([self.features(t, pair, known) for t in texts]).reshape(-1, N_FEATURES)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        z = (rows - np.array(self.mean)) / np.array(self.spread) @ np.array(self.weights[1:]) + self.weights[0]
        return 1 / (1 + np.exp(-z.clip(-30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> list[float]:
    """Newton's method with a small ridge; the intercept is not shrunk."""
    x = np.column_stack([np.ones(len(x)), x])
    w, shrink = np.zeros(x.shape[1]), np.r_[0, np.full(x.shape[1] - 1, ridge)]
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ w).clip(-30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(shrink + 1e-9), x.T @ (y - p) - shrink * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def fragments(data: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each n-byte piece of one word, or of one word and a space at either end, begins, and the piece as a number."""
    blank = np.concatenate([[0], np.cumsum(data == 32)])
    at = np.arange(max(len(data) - n + 1, 0))
    at = at[blank[at + n - 1] == blank[at + 1]]
    code = np.zeros(len(at), dtype=np.uint64)
    for k in range(n):
        code |= data[at + k].astype(np.uint64) << np.uint64(8 * k)
    return at, code


def _present(data: np.ndarray) -> list[np.ndarray]:
    """Fragments of a text, and those that it has twice at least."""
    seen, times = np.unique(np.concatenate([fragments(data, n)[1] for n in FRAGMENTS]), return_counts=True)
    return [seen, seen[times > 1]]


def telling_stretches(toxic: list[np.ndarray], ordinary: list[np.ndarray]) -> list[bytes]:
    """The stretches of toxic texts that consist of telling fragments.

    A fragment tells if the likelihood ratio of the share of toxic to that of ordinary texts that have it (or have it
    twice) is LIFT at least and beyond chance. Only fragments of enough toxic texts to get there are counted in ordinary ones.
    """
    n1, n0 = len(toxic), len(ordinary)
    texts, found = [_present(t) for t in toxic], []
    for twice in (0, 1):
        code, a = np.unique(np.concatenate([t[twice] for t in texts]), return_counts=True)
        if not len(code):
            continue
        # by chance a fragment has a gain of g or more with probability exp(-g) at most
        least = np.log(max(len(code), 2) / CHANCE)
        enough = a * np.log((n1 + n0) / n1) > least
        code, a = code[enough], a[enough]
        b = np.zeros(len(code))
        for t in ordinary:
            b += np.isin(code, _present(t)[twice], assume_unique=True)
        share = (a + b) / (n1 + n0)
        gain = a * np.log(a / (share * n1)) + np.where(b > 0, b * np.log(np.maximum(b, 1) / (share * n0)), 0)
        found.append(code[(a * n0 >= LIFT * b * n1) & (gain > least)])
    telling, stretches = np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64), []
    for data in toxic:
        edge = np.zeros(len(data) + 1, dtype=np.int64)
        for n in FRAGMENTS:
            at, code = fragments(data, n)
            hit = at[np.isin(code, telling)]
            edge[hit] += 1
            edge[hit + n] -= 1
        inside = np.diff(np.concatenate([[0], np.cumsum(edge[:-1]) > 0, [0]]).astype(np.int8))
        stretches += [data[i:j].tobytes() for i, j in zip(np.flatnonzero(inside == 1), np.flatnonzero(inside == -1))]
    return stretches


def trained(samples: list[bytes]) -> bytes:
    """The bytes of a dictionary that zstandard trains. It refuses too few samples; then the dictionary is all of the
    distinct samples, whole, and where these are more than a dictionary may hold, the refusal stands."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        whole = b"".join(sorted(set(samples)))
        if len(whole) > RAW_BYTES:
            raise
        return whole


def dictionaries(rows: list[tuple[str | None, int]], lengths=WINDOWS) -> list[Classifier]:
    """For each window length a classifier with both dictionaries and no weights yet."""
    of = lambda y: [np.frombuffer(b" %b " % b" ".join(words(t)), np.uint8) for t, k in rows if k == y]
    toxic, out = trained(telling_stretches(of(1), of(0))), []
    for n in lengths:
        plain = [w for t, y in rows if not y for w in windows(t, n)]
        plain = [plain[i] for i in np.random.default_rng(0).permutation(len(plain))[:PLAIN_WINDOWS]]
        out.append(Classifier(trained(plain), toxic, [0.0] * (N_FEATURES + 1), n))
    return out


def _folded_loss(x: np.ndarray, y: np.ndarray, folds: int = 5) -> float:
    """Log loss of rows, each judged by a logistic model of the other folds."""
    fold, loss = np.arange(len(y)) % folds, 0.0
    for k in range(folds):
        a, b = fold != k, fold == k
        if b.any():
            mean, spread = x[a].mean(axis=0), x[a].std(axis=0) + 1e-9
            w = np.array(_logistic((x[a] - mean) / spread, y[a]))
            z = ((x[b] - mean) / spread @ w[1:] + w[0]).clip(-30, 30)
            loss += float(np.sum(np.logaddexp(0, z) - y[b] * z))
    return loss / max(len(y), 1)


def fit(rows: list[tuple[str | None, int]]) -> Classifier:
    """From (text, toxic) rows. Without both labels the score is the share of toxic rows, 0 for no rows at all."""
    rows = list({t or "": (t, y) for t, y in rows}.values())  # copies of a text would vote together
    labels = np.array([y for _, y in rows])
    share = labels.mean() if len(rows) else 0.0
    if not 0 < share < 1:
        return Classifier(b"", b"", [30.0 if share else -30.0] + [0.0] * N_FEATURES)
    # the dictionaries come from two thirds of the sample, the window's length and the weights from the rest
    draw, apart = np.random.default_rng(0), np.zeros(len(rows), dtype=bool)
    for y in (0, 1):
        apart[draw.permutation(np.flatnonzero(labels == y))[::3]] = labels.sum() >= 6
    judged = apart if apart.any() else ~apart
    found = []
    for model in dictionaries([r for r, x in zip(rows, apart) if not x]):
        x = model.rows([t for (t, _), j in zip(rows, judged) if j])
        found.append((_folded_loss(x, labels[judged]), model.window, model, x))
    _, _, model, x = min(found, key=lambda f: f[:2])
    model.mean, model.spread = x.mean(axis=0).tolist(), (x.std(axis=0) + 1e-9).tolist()
    model.weights = _logistic((x - x.mean(axis=0)) / (x.std(axis=0) + 1e-9), labels[judged])
    return model


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, toxic) of labelled rows to learn from: crc32 of the id as text, modulo 4, is not 2.

    The `limit` ids that come first by hash are chosen from the labels alone, so that only their texts are moved. An id
    with several labels counts as toxic if one says so; of several texts under an id one is taken. Null ids, labels
    other than 0 and 1, and texts beyond SAMPLE_TEXT_BYTES are left out; without labels there are no rows.
    """
    marked = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = marked.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    chosen = F.broadcast(chosen.withColumnRenamed("doc_id", "marked_id"))  # `limit` rows of two numbers at most
    own = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_TEXT_BYTES)
    found = own.join(chosen, F.col("doc_id") == F.col("marked_id"))
    return found.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text"), F.max("toxic").alias("toxic"))


def held_out(doc_id) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS) -> Classifier:
    """A classifier from the sampled labelled rows, `limit` at most; nothing else reaches the driver.

    Null and empty texts take part as texts without windows. Of an empty sample, or one with a single label, the
    classifier gives every text the same score (`fit`). Reruns learn the same.
    """
    rows = training_rows(docs, labels, limit).collect()
    return fit([(r.text, r.toxic) for r in sorted(rows, key=lambda r: r.doc_id)])


def score(docs: DataFrame, model: Classifier, text: str = "text", column: str = "toxicity") -> DataFrame:
    """`docs` with one more double column. Null and empty texts have no window and get the score of no evidence.

    Rows, ties, repeated rows and other columns pass through unchanged; an own column named `column` is replaced.
    """
    rest = [c for c in docs.columns if c.lower() != column.lower()]
    packed = docs.select(F.struct(*rest).alias("row"), F.col(text).cast("string").alias("said"))

    def run(batches):
        for b in batches:
            x = model.rows(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(x))], names=["row", "score"])

    scored = packed.mapInArrow(run, packed.select("row").withColumn("score", F.lit(0.0)).schema)
    return scored.select("row.*", F.col("score").alias(column))


def classify(docs: DataFrame, model: Classifier, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score, predicted.

    A null id is not held out. Null and empty texts have the score of no evidence, repeated rows come back as often as
    they came, other columns are left out, and an empty table gives none.
    """
    s = score(docs.select("doc_id", "text"), model).drop("text")
    return s.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Classifier, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` less the rows that score at or above the threshold; all columns pass through, whatever their names.

    Null and empty texts are judged by the score of no evidence; equal texts share their fate.
    """
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col("text"))
    return score(packed, model).where(F.col("toxicity") < threshold).select("row.*")
