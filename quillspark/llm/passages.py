"""Quality classifier by attention over passages (multiple-instance learning).

A document is a bag of passages (PASSAGE consecutive words; an empty text is one passage without words), of which any may
carry what its label is about. Each passage is encoded: measures of its words and lines and counts of hashed trigrams of character classes,
through a tanh layer. A gate and a tanh unit give each passage a weight, which a softmax over the document's passages turns into attention; the weighted
mean of the encoded passages is scored by a logistic unit. All layers are learned from the documents' labels only, by Adam on mini-batches
of whole documents; the epoch with the least loss on a tenth of the training documents is kept.

Learning takes a bounded sample: of the labelled documents outside the held-out fold the TRAINING_DOCUMENTS with the least hash of their
id, and TRAINING_PASSAGES evenly spaced passages of a document with more. Its features go to one task, at most
TRAINING_DOCUMENTS * TRAINING_PASSAGES * N_FEATURES 2-byte numbers. Scoring takes all passages of all documents in one pass without a shuffle; a document's
weighted mean is carried along its stretches of STRETCH bytes, so a very long text needs no more memory than a stretch.

Defined results: a null text is empty; equal texts get equal scores; rows with a null id are scored, held_out is false; a document with several labels counts
as good if one of them says so, one with several texts teaches by the least of them; labels that are null or of unknown ids teach nothing; without any label of either kind the score is the share of good ones, 0.5 without
any; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .words import U, Words, mix, slices

PASSAGE, STRETCH = 48, 1 << 20
TRAINING_DOCUMENTS, TRAINING_PASSAGES = 8_000, 32
BUCKETS, HIDDEN, ATTENTION = 128, 32, 16
EPOCHS, BATCH, RATE, DECAY, SEED = 20, 64, 3e-3, 1e-4, 5
THRESHOLD = 0.3
BREAK = re.compile("[ \t-\r]")
#: Classes of characters; what none of them holds is class 0, bytes outside ASCII are the last two (first bytes, others).
CLASSES = (" ", "\n\r\t\x0b\x0c", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:", "!?", "|", "#$%&*<>@^~=+\\/_", "'\"()[]{}-`")
N_CLASSES = len(CLASSES) + 3
MEASURES = ("words", "length", "spread", "upper", "digits", "symbols", "ends in symbol", "bare", "repeats", "distinct", "capitals", "lines", "foreign", "ends sentence", "exclaims", "bars")
N_FEATURES = len(MEASURES) + BUCKETS


def class_table() -> np.ndarray:
    out = np.zeros(256, np.int16)
    for k, chars in enumerate(CLASSES, 1):
        out[list(chars.encode())] = k
    out[0x80:0xC0], out[0xC0:] = N_CLASSES - 1, N_CLASSES - 2
    return out


def bucket_table() -> np.ndarray:
    """The bucket of each trigram of classes."""
    return (mix(np.arange(N_CLASSES**3, dtype=U) + U(1)) % U(BUCKETS)).astype(np.int32)


KIND, BUCKET = class_table(), bucket_table()
LOWER, UPPER, DIGIT, BAR, SYMBOL = 3, 4, 5, 8, 9


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The features of all passages (float32), and how many passages each text has."""
    w = Words(texts)
    data, kind = w.data, KIND[w.data]
    n = np.maximum(1, -(-w.counts // PASSAGE))
    first = np.cumsum(n) - n
    total = int(n.sum())
    in_row = np.arange(len(w.starts)) - w.first[w.rows]
    of_word = first[w.rows] + in_row // PASSAGE
    # a passage's bytes: from its first word (the text's first byte for the first one) to the next passage
    begins = np.repeat(w.offsets[:-1], n)
    later = (in_row % PASSAGE == 0) & (in_row > 0)
    begins[of_word[later]] = w.starts[later]
    size = np.diff(np.append(begins, len(data)))
    of_byte = np.repeat(np.arange(total, dtype=np.int32), size)
    in_class = np.bincount(of_byte * np.int32(N_CLASSES) + kind, minlength=total * N_CLASSES).reshape(total, N_CLASSES)

    def in_words(flags: np.ndarray) -> np.ndarray:
        """How many bytes of each word have a flag."""
        sums = np.zeros(len(data) + 1, np.int32)
        np.cumsum(flags, out=sums[1:])
        return sums[w.ends] - sums[w.starts]

    n_words = np.bincount(of_word, minlength=total)
    some, bytes_in = np.maximum(n_words, 1), np.maximum(size, 1)
    of_words = lambda flags: np.bincount(of_word[flags], minlength=total) / some
    length = in_words((data & 0xC0) != 0x80).astype(float)
    mean = np.bincount(of_word, length, total) / some
    upper, lower = in_words(kind == UPPER), in_words(kind == LOWER)
    solid = upper + lower + in_words((kind == DIGIT) | (data >= 0x80))
    hashes = w.hashes()
    repeats = np.zeros(len(hashes), bool)
    repeats[1:] = (hashes[1:] == hashes[:-1]) & (in_row[1:] > 0)
    distinct = np.zeros(len(hashes), bool)
    distinct[np.unique(hashes ^ mix(of_word.astype(U) + U(1)), return_index=True)[1]] = True
    last = data[w.ends - 1] if len(w.ends) else data[:0]
    last_kind = KIND[last]
    share = lambda *kinds: in_class[:, kinds].sum(1) / bytes_in
    measures = [
        np.log1p(n_words), np.log1p(mean), np.sqrt(np.maximum(np.bincount(of_word, length**2, total) / some - mean**2, 0)), share(UPPER), share(DIGIT), share(SYMBOL, BAR),
        of_words(last_kind == SYMBOL), of_words(solid == 0), of_words(repeats), of_words(distinct), of_words((upper > 1) & (lower == 0)),
        in_class[:, 2] / some, share(N_CLASSES - 1, N_CLASSES - 2), of_words((last == 46) | (last == 33) | (last == 63)), of_words(last == 33), of_words(last_kind == BAR),
    ]
    # class trigrams within a text
    gram, ends = kind.astype(np.int32) * N_CLASSES**2, w.offsets[1:]
    for k, weight in ((1, N_CLASSES), (2, 1)):
        after = np.zeros(len(kind), np.int16)
        after[: max(0, len(kind) - k)] = kind[k:]
        for e in range(1, k + 1):
            at = ends - e
            after[at[at >= w.offsets[:-1]]] = 0
        gram += after * np.int32(weight)
    grams = np.bincount(of_byte * np.int32(BUCKETS) + BUCKET[gram], minlength=total * BUCKETS).reshape(total, BUCKETS)
    return np.concatenate([np.stack(measures, 1), np.sqrt(grams / bytes_in[:, None])], 1).astype(np.float32), n


def stretches(text: str) -> list[str]:
    """A text in stretches of about STRETCH characters that end at white space; most texts are one."""
    out, at = [], 0
    while len(text) - at > STRETCH:
        found = BREAK.search(text, at + STRETCH)
        end = found.start() if found else len(text)
        out.append(text[at:end])
        at = end
    return out + [text[at:]] if at < len(text) or not out else out


def parts(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(features, passages of each stretch, its text's number) of all texts, some stretches at a time."""
    done = 0
    for part in slices(texts):
        cut = [stretches(t or "") for t in part.to_pylist()]
        owner = np.repeat(np.arange(done, done + len(part)), [len(c) for c in cut])
        flat, at = pa.array([s for c in cut for s in c], pa.string()), 0
        for few in slices(flat):
            x, n = features(few)
            yield x, n, owner[at : at + len(few)]
            at += len(few)
        done += len(part)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Attention:
    """The network: an encoder (w, b), gated attention (v, u, a) and a logistic unit (c, d), after centring and scaling by mean and scale."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        glorot = lambda m, n: r.normal(0, np.sqrt(2 / (m + n)), (m, n))
        self.p = {"w": glorot(len(mean), HIDDEN), "b": np.zeros(HIDDEN), "v": glorot(HIDDEN, ATTENTION), "u": glorot(HIDDEN, ATTENTION), "a": glorot(ATTENTION, 1)[:, 0], "c": glorot(HIDDEN, 1)[:, 0], "d": np.zeros(1)}

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -5, 5)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """The encoded passages, the two attention units and the attention's logits, of scaled features."""
        p = self.p
        h = np.tanh(x @ p["w"] + p["b"])
        t, g = np.tanh(h @ p["v"]), sigmoid(h @ p["u"])
        return h, t, g, (t * g) @ p["a"]

    def loss(self, x: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The mean loss of documents with labels y and n passages each, whose scaled features are x, and its gradients."""
        p, at = self.p, np.cumsum(n) - n
        h, t, g, s = self.encode(x)
        e = np.exp(s - np.repeat(np.maximum.reduceat(s, at), n))
        alpha = e / np.repeat(np.add.reduceat(e, at), n)
        z = np.add.reduceat(alpha[:, None] * h, at)
        q = sigmoid(z @ p["c"] + p["d"])
        loss = -np.mean(y * np.log(q + 1e-12) + (1 - y) * np.log(1 - q + 1e-12))
        dq = (q - y) / len(y)
        dz = np.repeat(dq[:, None] * p["c"], n, axis=0)
        d_alpha = (dz * h).sum(1)
        ds = alpha * (d_alpha - np.repeat(np.add.reduceat(alpha * d_alpha, at), n))
        dt, dg = (ds[:, None] * p["a"] * g) * (1 - t**2), (ds[:, None] * p["a"] * t) * g * (1 - g)
        dh = (alpha[:, None] * dz + dt @ p["v"].T + dg @ p["u"].T) * (1 - h**2)
        return loss, {"w": x.T @ dh, "b": dh.sum(0), "v": h.T @ dt, "u": h.T @ dg, "a": (t * g).T @ ds, "c": z.T @ dq, "d": dq.sum(keepdims=True)}


def learn(bags: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS) -> Attention:
    """Fits the network to bags of passages; every tenth bag only chooses the epoch."""
    whole = np.concatenate(bags).astype(float)
    net = Attention(whole.mean(0), whole.std(0) + 0.01)
    bags = [net.scaled(b) for b in bags]
    n = np.array([len(b) for b in bags])
    check = np.arange(len(bags)) % 10 == 9
    fit = np.flatnonzero(~check)
    best, chosen = np.inf, net.p
    one, two = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    r, step = np.random.default_rng(SEED), 0
    take = lambda rows: (np.concatenate([bags[i] for i in rows]), n[rows], y[rows])
    for _ in range(epochs):
        r.shuffle(fit)
        for low in range(0, len(fit), BATCH):
            step += 1
            _, grad = net.loss(*take(fit[low : low + BATCH]))
            fresh = {}
            for k, v in net.p.items():
                one[k], two[k] = 0.9 * one[k] + 0.1 * grad[k], 0.999 * two[k] + 0.001 * grad[k] ** 2
                fresh[k] = v - RATE * (one[k] / (1 - 0.9**step) / (np.sqrt(two[k] / (1 - 0.999**step)) + 1e-8) + DECAY * v)
            net.p = fresh
        held = np.flatnonzero(check) if check.any() else fit
        loss = sum(net.loss(*take(held[k : k + BATCH]))[0] * len(held[k : k + BATCH]) for k in range(0, len(held), BATCH)) / len(held)
        if loss < best:
            best, chosen = loss, net.p
    net.p = chosen
    return net


def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, good and the features of at most TRAINING_PASSAGES evenly spaced passages as 2-byte numbers."""
    for batch in batches:
        kept: list[list[np.ndarray]] = [[] for _ in range(batch.num_rows)]
        for x, n, owner in parts(batch.column("text")):
            at = 0
            for k, i in zip(n.tolist(), owner.tolist(), strict=True):
                kept[i].append(x[at : at + k].astype(np.float16))
                at += k
        out = []
        for found in kept:
            x = np.concatenate(found)
            out.append(x[np.linspace(0, len(x) - 1, min(len(x), TRAINING_PASSAGES)).round().astype(int)].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("good"), pa.array(out, pa.binary())], ["doc_id", "good", "x"])


def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: the fitted network's numbers; none without labels of both kinds."""
    rows = [r for b in batches for r in zip(b.column("doc_id").to_pylist(), b.column("good").to_pylist(), b.column("x").to_pylist(), strict=True)]
    rows.sort()  # the same network, whatever the order of arrival
    y = np.array([g for _, g, _ in rows], float)
    if not len(y) or y.min() == y.max():
        return
    net = learn([np.frombuffer(x, np.float16).reshape(-1, N_FEATURES) for *_, x in rows], y)
    numbers = {"mean": net.mean, "scale": net.scale, **net.p}
    yield pa.RecordBatch.from_arrays([pa.array(list(numbers)), pa.array([v.astype("<f8").tobytes() for v in numbers.values()], pa.binary())], ["name", "numbers"])


def score(batches: Iterator[pa.RecordBatch], numbers: dict[str, bytes] | None, otherwise: float) -> Iterator[pa.RecordBatch]:
    net = None
    if numbers:
        net = Attention(*(np.frombuffer(numbers[k], "<f8") for k in ("mean", "scale")))
        net.p = {k: np.frombuffer(numbers[k], "<f8").reshape(v.shape) for k, v in net.p.items()}
    for batch in batches:
        out = np.full(batch.num_rows, otherwise)
        # of each text so far: the greatest logit, and relative to it the sums of weights and of weighted passages
        top, mass, pooled = np.full(batch.num_rows, -np.inf), np.zeros(batch.num_rows), np.zeros((batch.num_rows, HIDDEN))
        for x, n, owner in parts(batch.column("text")) if net else ():
            h, _, _, s = net.encode(net.scaled(x))
            at = np.cumsum(n) - n
            high = np.maximum.reduceat(s, at)
            e = np.exp(s - np.repeat(high, n))
            for i, m, a, z in zip(owner.tolist(), high.tolist(), np.add.reduceat(e, at).tolist(), np.add.reduceat(e[:, None] * h, at), strict=True):
                most = max(top[i], m)
                old, new = np.exp(top[i] - most), np.exp(m - most)
                top[i], mass[i], pooled[i] = most, mass[i] * old + a * new, pooled[i] * old + z * new
        if net:
            out = sigmoid(pooled / mass[:, None] @ net.p["c"] + net.p["d"])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.float64())], ["doc_id", "score"])


def in_fold(doc_id: Column | str, folds: int = 5) -> Column:
    """Whether a document is held out: crc32 of its id as text leaves no remainder."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % folds == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, bytes] | None, float]:
    """The network's numbers (a few thousand), and the share of good documents in its sample."""
    known = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).cast("int").alias("good"))
    known = known.where(~in_fold("doc_id")).groupBy("doc_id").agg(F.max("good").alias("good"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAINING_DOCUMENTS)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "good").agg(F.min("text").alias("text"))
    encoded = store.write(chosen.mapInArrow(bags, "doc_id long, good int, x binary"), "passages")
    numbers = {r["name"]: bytes(r["numbers"]) for r in encoded.repartition(1).mapInArrow(train, "name string, numbers binary").collect()}
    share = encoded.agg(F.avg("good")).first()[0]
    store.drop(encoded)
    return numbers or None, 0.5 if share is None else share


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    numbers, share = fit(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda it: score(it, numbers, share), "doc_id long, score double")
    return rows.select("doc_id", in_fold("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(store.read(spark, sf_dir, "documents"), store.read(spark, sf_dir, "labels"))
