"""Language of whole texts: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of 1 to ORDERS letters inside words, word ends included; a text's term frequencies are
shares of all its n-grams. Weights are learnt by follow-the-regularised-leader with an elastic net, which leaves most
of them 0, and the probabilities are then calibrated by one temperature on documents that the weights have not seen.

Document frequencies are counted over all training rows. The weights are fitted on a bounded sample (PER_LANG documents
a language, fewer where there are very many languages) in one task; the model is a table of weights, so each task that
scores adds up the rows of its texts' n-grams. Scoring reads every text once, with no shuffle; long texts go through in
pieces that end at white space, which leaves their n-grams as they are.
"""

from __future__ import annotations

import io
import re
import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rideledger.llm.bpe import slices
from rideledger.llm.common import free, held_out, result_schema, table

ORDERS = 4
BITS = 15
#: About as many documents of each language are sampled for fitting, by a hash of id and text.
PER_LANG = 500
#: Documents that the fit takes at most in all, and at least of each language.
MAX_SAMPLE, MIN_PER_LANG = 20_000, 20
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.5
#: Term frequencies are shares below a hundredth; this brings inputs near 1.
SCALE = 30.0
SLICE_BYTES = 400_000
#: Characters of a text that are worked on at once.
PIECE_CHARS = 200_000
_SPACE = re.compile(r"[\x20\x09-\x0D]")
UNKNOWN = "und"
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1))
    return _LETTERS[0]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' code points in lower case, a space before and after each, and where each begins."""
    low = [t.lower() for t in texts]
    joined = np.frombuffer("".join(f" {t} " for t in low).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return joined, np.concatenate([[0], np.cumsum([len(t) + 2 for t in low])[:-1]]).astype(np.int64)


def in_pieces(texts: list[str], seam: re.Pattern = _SPACE, limit: int | None = None) -> tuple[list[str], np.ndarray]:
    """The texts in pieces of limit characters (PIECE_CHARS) and more, each up to the next seam (left out), and whose each piece is."""
    limit, out, owner = limit or PIECE_CHARS, [], []
    for i, text in enumerate(texts):
        at = 0
        while len(text) - at > limit and (cut := seam.search(text, at + limit)):
            out.append(text[at : cut.start()])
            at = cut.end()
            owner.append(i)
        out.append(text[at:] if at else text)
        owner.append(i)
    return out, np.array(owner, dtype=np.int64)


def grams(cp: np.ndarray):
    """For each order, the feature of the n-gram at each position; 2**BITS where there is none."""
    space = ~letters()[cp]
    c = np.where(space, 32, cp).astype(np.uint32)
    h = np.full(len(c), 2166136261, dtype=np.uint32)
    for n in range(1, ORDERS + 1):
        m = max(0, len(c) - n + 1)
        h = (h[:m] ^ c[n - 1 :]) * np.uint32(16777619)
        x = h ^ (h >> np.uint32(15))
        x = (x + np.uint32(n)) * np.uint32(2654435761)
        none = space[:m] & space[n - 1 :] if n <= 2 else space[1 : 1 + m]
        for j in range(2, n - 1):
            none = none | space[j : j + m]
        out = np.full(len(c), 2**BITS, dtype=np.int32)
        out[:m] = np.where(none, 2**BITS, (x >> np.uint32(32 - BITS)).astype(np.int32))
        yield out


class Model:
    """Languages, a row of weights for each feature (and a last one of zeros), and a temperature."""

    def __init__(self, langs: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.langs, self.weights, self.bias, self.temperature = langs, weights, bias, temperature

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, langs=np.array(self.langs), weights=self.weights, bias=self.bias, temperature=self.temperature)
        return out.getvalue()

    @staticmethod
    def load(raw: bytes) -> Model:
        x = np.load(io.BytesIO(raw))
        return Model([str(v) for v in x["langs"]], x["weights"], x["bias"], float(x["temperature"]))

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each text a logit for each language, and how many n-grams it has."""
        total, n = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), dtype=np.int64)
        pieces, owner = in_pieces(texts)
        # The characters at once are bounded, and so are the rows of weights that they gather.
        first = 0
        for some in slices(pieces, max(1, 4 * PIECE_CHARS // max(4, len(self.langs)))):
            cp, starts = code_points(some)
            whose = owner[first : first + len(some)]
            first += len(some)
            for g in grams(cp):
                for at in range(0, len(self.langs), 64):
                    np.add.at(total[:, at : at + 64], whose, np.add.reduceat(self.weights[g, at : at + 64], starts, axis=0))
                np.add.at(n, whose, np.add.reduceat((g < 2**BITS).astype(np.int64), starts))
        return total / np.maximum(n, 1)[:, None] + self.bias, n

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """A language and its probability for each text; und and 0 for texts without a letter."""
        z, n = self.logits(texts)
        p = softmax(z / self.temperature)
        best = p.argmax(axis=1)
        return [self.langs[b] if k else UNKNOWN for b, k in zip(best, n, strict=True)], np.where(n > 0, p.max(axis=1), 0.0)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def counts(text: str) -> np.ndarray:
    """How often a text has each feature."""
    cp, _ = code_points([text])
    return sum(np.bincount(g, minlength=2**BITS + 1)[:-1] for g in grams(cp))


def fit(texts: list[str], langs: list[str], document: np.ndarray | None = None, n_documents: int = 0) -> Model:
    """A model from labelled texts; every fifth text sets the temperature and is not learnt from, where there are enough.

    document has each feature's number of documents out of n_documents; without it, those of texts are counted.
    """
    names = sorted(set(langs))
    rows = []
    for text in texts:
        c = counts(text)
        at = np.flatnonzero(c)
        rows.append((at, c[at] / max(1, c.sum())))
    if document is None:
        document, n_documents = np.zeros(2**BITS), len(rows)
        for at, _ in rows:
            document[at] += 1
    idf = np.log((1 + n_documents) / (1 + document)) + 1
    y = np.array([names.index(x) for x in langs])
    tune = np.arange(len(rows)) % 5 == 4 if len(rows) >= 50 else np.zeros(len(rows), dtype=bool)
    learn = np.flatnonzero(~tune)
    z, g2 = np.zeros((2**BITS, len(names))), np.zeros((2**BITS, len(names)))
    bias, bias2 = np.zeros(len(names)), np.full(len(names), 1.0)
    rng = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in rng.permutation(learn):
            at, tf = rows[i]
            x = (tf * idf[at] * SCALE)[:, None]
            zi, gi = z[at], g2[at]
            root = np.sqrt(gi)
            w = np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + root) / ALPHA + L2))
            error = softmax((x * w).sum(axis=0) + bias)
            error[y[i]] -= 1
            g = x * error
            more = gi + g * g
            z[at], g2[at] = zi + g - (np.sqrt(more) - root) / ALPHA * w, more
            bias2 += error * error
            bias -= 0.1 * error / np.sqrt(bias2)
    w = np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(g2)) / ALPHA + L2)) * idf[:, None] * SCALE
    model = Model(names, np.vstack([w, np.zeros(len(names))]).astype(np.float32), bias, 1.0)
    if tune.any():
        logits = np.concatenate([model.logits([texts[i]])[0] for i in np.flatnonzero(tune)])
        want = y[tune]
        loss = lambda t: -np.log(np.maximum(softmax(logits / t)[np.arange(len(want)), want], 1e-12)).mean()
        model.temperature = float(min(np.geomspace(0.05, 20, 120), key=loss))
    return model


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """In how many rows of texts (one text column without nulls) each feature is: partial counts, summed by Spark."""

    def task(batches):
        seen = np.zeros(2**BITS + 1, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                has = np.zeros(2**BITS + 1, dtype=bool)
                for piece in in_pieces([text.as_py()])[0]:
                    for g in grams(code_points([piece])[0]):
                        has[g] = True
                seen += has
        at = np.flatnonzero(seen[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["feature", "n"])

    out = np.zeros(2**BITS)
    # 2 ** BITS rows at most.
    for r in texts.mapInArrow(task, "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).collect():
        out[r["feature"]] = r["n"]
    return out


def train(docs: DataFrame, per_lang: int = PER_LANG, max_sample: int = MAX_SAMPLE) -> Model | None:
    """A model from the labelled rows of docs (doc_id, text, lang) that are not held out; None where there are none.

    Every language is learnt. The sample has about per_lang documents of each, fewer (MIN_PER_LANG at least) where that
    would be more than max_sample in all; document frequencies are those of all labelled rows.
    """
    known = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "text", "lang")
    numbers = known.groupBy("lang").count().collect()  # a row for each language
    if not numbers:
        return None
    want = min(per_lang, max(MIN_PER_LANG, max_sample // len(numbers)))
    shares = docs.sparkSession.createDataFrame([(r["lang"], want / r["count"]) for r in numbers], "lang string, share double")
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) / 1e6
    sample = known.join(F.broadcast(shares), "lang").filter(draw < F.col("share")).select("doc_id", "text", "lang")
    document, n_documents = document_frequencies(known.select("text")), sum(r["count"] for r in numbers)

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "text"])
        return pd.DataFrame({"model": [fit(pdf["text"].tolist(), pdf["lang"].tolist(), document, n_documents).dump()]})

    models = sample.groupBy(F.lit(0).alias("one")).applyInPandas(task, "model binary").collect()
    return Model.load(models[0]["model"]) if models else None


def predict(docs: DataFrame, keep: list[str], model: Model | None, text: str = "text") -> DataFrame:
    """keep columns plus lang_pred and score. Null texts and texts without a letter are und with score 0, as all are without a model.

    Columns kept under these two names give way to them.
    """
    keep = [c for c in keep if c not in ("lang_pred", "score")]
    kept = [F.col(f"`{c}`") for c in keep]
    if model is None:
        return docs.select(*kept, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    source = docs.select(*kept, F.coalesce(F.col(text), F.lit("")).alias(*free(keep, "__text")))
    shared = docs.sparkSession.sparkContext.broadcast(model.dump())

    def task(batches):
        m = Model.load(shared.value)
        for batch in batches:
            at = 0
            for some in slices(batch.column(len(keep)).to_pylist(), SLICE_BYTES):
                langs, scores = m.predict(some)
                own = [batch.column(i).slice(at, len(some)) for i in range(len(keep))]
                at += len(some)
                yield pa.RecordBatch.from_arrays([*own, pa.array(langs), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    return source.mapInArrow(task, result_schema(docs, keep, "lang_pred string, score double"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: every document's predicted language."""
    docs = table(spark, sf_dir, "documents")
    out = predict(docs, ["doc_id"], train(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
