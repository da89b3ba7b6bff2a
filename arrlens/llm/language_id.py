"""Language identification by averaged hashed subword embeddings.

A text is the mean of the embeddings of its subwords: the 1- to 4-grams of
its lower-cased words, with one blank standing for each word edge, hashed into
BUCKETS rows. A linear softmax over the mean gives the language. Embeddings
and softmax are trained together by stochastic gradient descent in numpy. Rows of a
calibration share, which training does not see, give the temperature that makes
the score a probability and the score below which an answer counts as
rejected. Subwords never seen in training have a zero embedding, so texts in
unknown scripts score like the mean language and are rejected.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, id_and_text, staged, table

BUCKETS = 1 << 16
DIM = 16
GRAMS = (1, 2, 3, 4)
SAMPLE_ROWS = 4_000         # labelled texts the model is fitted on, at most about
EPOCHS = 8
RATE = 1.0
BATCH = 32
CALIBRATION = 5             # one sample row in so many calibrates
MAX_ERROR = 0.01            # share of wrong answers allowed among those that are not rejected
PIECE = 1 << 19             # characters that are hashed at once
UNKNOWN = "und"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_CODE_POINTS = 0x110000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether a code point is a letter; 1 MB a worker."""
    return np.frombuffer(bytes(chr(i).isalpha() for i in range(_CODE_POINTS)), np.uint8).astype(bool)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text; 0 for all that is no letter, and at both ends."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros(len(c) + 2, np.uint32)
    out[1:-1] = np.where(_letters()[c], c, 0)
    return out


def subwords(text: str) -> list[np.ndarray]:
    """Bucket numbers of all subwords of the whole text, by pieces of PIECE
    characters: grams that hold letters only, but for one edge at either end."""
    codes = _codes(text)
    out, longest = [], max(GRAMS)
    for at in range(0, len(codes), PIECE):
        c = codes[at:at + PIECE + longest - 1].astype(np.uint64)
        letter = c > 0
        m = min(PIECE, len(codes) - at)
        h = np.zeros(len(c), np.uint64)
        inner = np.ones(len(c), bool)    # no edge strictly inside the gram
        for n in range(1, longest + 1):
            k = len(c) - n + 1
            if k <= 0:
                break
            h = h[:k] * _MIX + c[n - 1:]
            h ^= h >> np.uint64(29)
            if n > 2:
                inner = inner[:k] & letter[n - 2:n - 2 + k]
            else:
                inner = inner[:k]
            if n not in GRAMS:
                continue
            use = inner & (letter[:k] | letter[n - 1:] if n > 1 else letter)
            if n > 2:  # a gram of edges around letters always has a letter inside
                use = inner.copy()
            use[m:] = False
            out.append(((h[use] * _MIX) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32))
    return out


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(bucket numbers, shares) of the text; both empty without letters."""
    counts = np.zeros(BUCKETS, np.int64)
    for part in subwords(text):
        counts += np.bincount(part, minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at.astype(np.int32), (counts[at] / max(counts.sum(), 1)).astype(np.float32)


@dataclass
class Model:
    langs: list[str]            # in the order of the softmax's columns
    table: np.ndarray           # BUCKETS x classes: embeddings times softmax weights
    bias: np.ndarray
    temperature: float
    reject_below: float

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, probability, rejected); UNKNOWN without a letter."""
        if not self.langs or not has_letter(text):
            return UNKNOWN, 0.0, True
        total, n = np.zeros(len(self.langs)), 0
        for part in subwords(text):
            if len(part):
                total += self.table[part].sum(axis=0, dtype=np.float64)
                n += len(part)
        z = (total / max(n, 1) + self.bias) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(np.argmax(p))
        # without one learned subword only the bias speaks
        return self.langs[best], float(p[best]), bool(p[best] < self.reject_below or not total.any())


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def fit(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_classes: int, epochs: int = EPOCHS,
        rate: float = RATE, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(embeddings, softmax weights, bias) by stochastic gradient descent on the
    cross entropy, classes weighted evenly up to a factor of 10, with a linearly falling rate."""
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1, 1, (BUCKETS, DIM)).astype(np.float32) / DIM
    w = rng.normal(0, 0.1, (DIM, n_classes)).astype(np.float32)
    b = np.zeros(n_classes, np.float32)
    share = np.bincount(y, minlength=n_classes) / max(len(y), 1)
    even = np.minimum(1 / np.maximum(share * n_classes, 1e-9), 10.0).astype(np.float32)
    seen = np.zeros(BUCKETS, bool)
    for at, _ in bags:
        seen[at] = True
    steps = max(epochs * -(-len(bags) // BATCH), 1)
    t = 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for k in range(0, len(order), BATCH):
            rows = order[k:k + BATCH]
            at = np.concatenate([bags[i][0] for i in rows])
            x = np.concatenate([bags[i][1] for i in rows])
            row = np.repeat(np.arange(len(rows)), [len(bags[i][0]) for i in rows])
            used, local = np.unique(at, return_inverse=True)
            dense = np.zeros((len(rows), len(used)), np.float32)
            dense[row, local] = x
            hidden = dense @ emb[used]
            d = _softmax(hidden @ w + b)
            d[np.arange(len(rows)), y[rows]] -= 1
            d *= even[y[rows]][:, None] / len(rows)
            step = rate * (1 - t / steps)
            back = d @ w.T
            for of, factor, g in ((w, 1.0, hidden.T @ d), (b, 0.1, d.sum(axis=0))):
                of -= step * factor * g / max(1.0, float(np.linalg.norm(g)))
            # a subword is in few texts and its share is small: its row moves by a larger step
            g = dense.T @ back
            emb[used] -= step * 10 * g / max(1.0, float(np.linalg.norm(g)))
            t += 1
    emb[~seen] = 0
    return emb, w, b


def calibrate(logits: np.ndarray, y: np.ndarray, max_error: float = MAX_ERROR) -> tuple[float, float]:
    """(temperature, score): the temperature with the least cross entropy on the
    calibration rows, and the least score such that at most ``max_error`` of the rows
    from it on are wrong, one more wrong row allowed for."""
    if not len(y):
        return 1.0, 0.5
    temps = np.geomspace(0.05, 20, 121)
    loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean() for t in temps]
    temp = float(temps[int(np.argmin(loss))])
    p = _softmax(logits / temp)
    best, wrong = p.max(axis=1), p.argmax(axis=1) != y
    order = np.argsort(-best, kind="stable")
    share = (np.cumsum(wrong[order]) + 1) / (np.arange(len(y)) + 1)
    good = np.flatnonzero(share <= max_error)
    at = best[order[good[-1]]] if len(good) else 0.5
    return temp, float(min(at, 0.95))


def labelled_texts(docs: DataFrame, max_rows: int) -> DataFrame:
    """Distinct (lang, text, use) of at most about ``max_rows`` documents with a
    language outside the held-out fold, chosen by the hash of their id and text;
    languages share the bound evenly, so that a frequent one leaves room for the others."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                        F.col("lang").cast("string").alias("lang"))
    known = known.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), 4, 2))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return known.select("lang", "text", F.lit(0).alias("use")).limit(0)
    quota, left, room = {}, len(counts), max_rows
    for lang, n in sorted(counts.items(), key=lambda e: (e[1], e[0])):
        quota[lang] = min(n, room // left)
        room, left = room - quota[lang], left - 1
    parts = F.create_map(*[v for lang, n in sorted(counts.items())
                           for v in (F.lit(lang), F.lit(int(2 ** 31 * quota[lang] / n)))])
    at = F.pmod(F.xxhash64("doc_id", "text", F.lit("lang")), F.lit(2 ** 31))
    chosen = known.where(at < parts[F.col("lang")]).select("lang", "text").distinct()
    return chosen.withColumn("use", (F.crc32(F.col("text").cast("binary")) % CALIBRATION).cast("int"))


def _bags(batches):
    for batch in batches:
        rows = [(lang, use, *bag(text)) for lang, text, use in
                zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), batch["use"].to_pylist())]
        rows = [r for r in rows if len(r[2])]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()),
             pa.array([r[2] for r in rows], pa.list_(pa.int32())),
             pa.array([r[3] for r in rows], pa.list_(pa.float32()))], ["lang", "use", "at", "x"])


def _fit(batches):
    rows = []
    for batch in batches:
        for lang, use, at, x in zip(batch["lang"].to_pylist(), batch["use"].to_pylist(), batch["at"], batch["x"]):
            rows.append((lang, use, at.values.to_numpy(), x.values.to_numpy()))
    # the same steps whatever the order of arrival
    rows.sort(key=lambda r: (r[0], len(r[2]), r[2].tobytes(), r[3].tobytes()))
    learn = [r for r in rows if r[1]] or rows
    langs = sorted({r[0] for r in learn})
    if not langs:
        out = ([], b"", [], 1.0, 0.5)
    else:
        number = {v: i for i, v in enumerate(langs)}
        emb, w, b = fit([r[2:] for r in learn], np.array([number[r[0]] for r in learn]), len(langs))
        scores = emb @ w
        held = [r for r in rows if not r[1] and r[0] in number]
        logits = np.array([r[3] @ scores[r[2]] + b for r in held], dtype=np.float64).reshape(-1, len(langs))
        temp, low = calibrate(logits, np.array([number[r[0]] for r in held], dtype=int))
        out = (langs, scores.astype(np.float32).tobytes(), b.astype(float).tolist(), temp, low)
    yield pa.RecordBatch.from_arrays(
        [pa.array([out[0]], pa.list_(pa.string())), pa.array([out[1]], pa.binary()),
         pa.array([out[2]], pa.list_(pa.float64())), pa.array([out[3]]), pa.array([out[4]])],
        ["langs", "scores", "bias", "temperature", "low"])


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most about ``sample_rows`` whole texts outside the held-out fold
    (repeated texts once): their bags are counted in parallel, one task fits them. The
    model, BUCKETS numbers a language, is read by the driver. Without labelled texts
    every answer is UNKNOWN; with one language it is that one."""
    sample = staged(labelled_texts(docs, sample_rows), "lang-sample")
    bags = sample.mapInArrow(_bags, "lang string, use int, at array<int>, x array<float>").repartition(1)
    r = bags.mapInArrow(_fit, "langs array<string>, scores binary, bias array<double>, temperature double, "
                              "low double").first()
    if r is None or not r["langs"]:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 0.5)
    scores = np.frombuffer(bytes(r["scores"]), np.float32).reshape(BUCKETS, -1)
    return Model(list(r["langs"]), scores, np.array(r["bias"]), r["temperature"], r["low"])


def _identifier(model: Model):
    def identify(batches):
        for batch in batches:
            out = [model.predict(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["held_out"], pa.array([o[0] for o in out], pa.string()),
                 pa.array([o[1] for o in out], pa.float64()), pa.array([o[2] for o in out], pa.bool_())],
                ["doc_id", "held_out", "lang_pred", "score", "rejected"])
    return identify


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) per document row, the whole
    text read in one narrow pass. A text that is null or without a letter gets
    ``und`` and 0; ``rejected`` marks it and answers below the calibrated
    score. Repeated rows give repeated results; a null doc_id stays null and
    is not held out; an empty table gives no rows; other columns are ignored."""
    rows = id_and_text(docs).withColumn("held_out", held_out(F.col("doc_id"), 4, 2))
    return rows.mapInArrow(_identifier(model), "doc_id long, held_out boolean, lang_pred string, score double, "
                                               "rejected boolean")


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
