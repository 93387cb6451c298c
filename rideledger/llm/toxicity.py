"""Toxicity of whole texts: a support vector machine on a gappy string kernel, with Nystroem landmarks.

Strings are words with their edges, or runs of RUN places inside longer ones. The kernel counts common subsequences of three letters that span
at most SPAN letters, each weighted by DECAY for every letter it leaves out; letters put in between stretch a subsequence,
they don't break it. Any number of signs inside a word and spaces that set single letters apart count for nothing.

Labels are of documents, not of the word that gave offence. Words that toxic documents have significantly more often
(by a likelihood ratio over documents, in contexts not seen before, so that copies count once) are the positive strings, the surest also disguised; words of clean documents the negative ones, those
that score highest joining in a second round. Landmarks are strings of both kinds. A string's coordinates are its
kernel values with the landmarks, whitened; a linear machine on them is, spelled out, a weight for each subsequence.
So scoring adds up weights exactly as the kernel machine would, at every place of every word, and a document scores by
its three best words and its number of positive ones, through a logistic curve fitted on documents it hasn't seen, and
on clean ones of these with a single insult put in, plain or disguised, as an insult offends however it is written.
"""

from __future__ import annotations

import io
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rideledger.llm.bpe import slices
from rideledger.llm.common import broadcast_checked, free, held_out, result_schema, table
from rideledger.llm.langid import code_points, in_pieces, letters

#: About as many labelled documents of each class are sampled for fitting, by a hash of their ids.
MAX_TOXIC, MAX_CLEAN = 1_500, 3_000
SPAN, DECAY, RUN = 5, 0.6, 12
REPEAT = 6
LANDMARKS = 64
#: Words that the fit takes as insults at most (the surest), words of clean documents, and of these those that look most
#: like insults in each round. They bound the fit, as the sample does.
POSITIVES, NEGATIVES, HARD = 256, 8_000, 1_000
#: The cost of errors against the margin: high, as a common word that looks like an insult must stay below.
COST = 10_000.0
#: The likelihood ratio (twice its logarithm) that makes a word positive: among 100,000 words hardly one gets it by chance.
MIN_RATIO = 25.0
ROUNDS = 4
MIN_LETTERS = 3
#: Of how many of a text's best words the values count, beside the number of words on the positive side.
TOP = 3
#: Values above count as this; a plain insult is far beyond the margin.
CAP = 4.0
SLICE_BYTES = 150_000
#: Where a long text may be cut: at white space that sets no single letters apart.
_SEAM = re.compile(r"(?<=\S\S)[\x20\x09-\x0D](?=\S\S)")
EDGE = 27
_SYMBOLS = 32
_SIZE = _SYMBOLS**3
_LOWEST = -2.0
_GAPS = [(j, k) for k in range(2, SPAN) for j in range(1, k)]


def symbols(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each place's symbol (a-z 1 to 26, EDGE the white space around words, 28 to 31 other letters, 0 anything else), and
    the next EDGE after it. A single space between two single letters is no edge."""
    space = (cp == 32) | ((cp >= 9) & (cp <= 13))
    padded = np.concatenate([[True, True], space, [True, True]])
    soft = space & padded[:-4] & padded[4:] & ~padded[1:-3] & ~padded[3:-1]
    s = np.where(letters()[cp], 28 + cp % 4, 0)
    s = np.where((cp >= 97) & (cp <= 122), cp - 96, s)
    s = np.where(space & ~soft, EDGE, s).astype(np.int32)
    at = np.flatnonzero(s == EDGE)
    return s, np.repeat(np.append(at, len(cp)), np.diff(at, prepend=0, append=len(cp)))


def spelled(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """symbols() of the letters and edges alone, and their places in cp."""
    s, ends = symbols(cp)
    at = np.flatnonzero(s > 0)
    return s[at], np.searchsorted(at, ends[at]), at


def subsequences(s: np.ndarray, ends: np.ndarray):
    """(code, weight, whether it is one) at each place, for each way to leave places out.

    One that its word has had up to REPEAT places before doesn't count again, so that echoes don't add up.
    """
    n = len(s)
    inner, any_ = (s > 0) & (s != EDGE), s > 0
    place = np.arange(n)
    same = []
    for d in range(1, REPEAT + 1):
        e = np.zeros(n, dtype=bool)
        e[d:] = (s[d:] == s[:-d]) & (ends[d:] == ends[:-d])
        same.append(e)
    for j, k in _GAPS:
        m = max(0, n - k)
        ok = any_[:m] & inner[j : j + m] & any_[k : k + m] & (place[k : k + m] <= ends[:m])
        for e in same:
            ok &= ~(e[:m] & e[j : j + m] & e[k : k + m])
        yield (s[:m] * _SYMBOLS + s[j : j + m]) * _SYMBOLS + s[k : k + m], DECAY ** (k - 2), ok


def string_rows(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words' kernel features as (word, code, value), and each word's norm."""
    cp, starts = code_points(words)
    s, ends, places = spelled(cp)
    word = np.searchsorted(starts, places, side="right") - 1
    rows, codes, values = [], [], []
    for code, weight, ok in subsequences(s, ends):
        at = np.flatnonzero(ok)
        rows.append(word[at])
        codes.append(code[at])
        values.append(np.full(len(at), weight))
    r, c, v = np.concatenate(rows), np.concatenate(codes), np.concatenate(values)
    norm = np.sqrt(np.bincount(r, weights=v * v, minlength=len(words)) + 1.0)
    return r, c, v / norm[r], norm


class Model:
    """A weight for each subsequence, the machine's threshold, and the logistic curve over documents' best strings."""

    def __init__(self, weights: np.ndarray, bias: float, slope: np.ndarray, offset: float):
        self.weights, self.bias, self.slope, self.offset = weights, bias, slope, offset

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, weights=self.weights.astype(np.float32), rest=np.array([self.bias, self.offset, *self.slope]))
        return out.getvalue()

    @staticmethod
    def load(raw: bytes) -> Model:
        x = np.load(io.BytesIO(raw))
        return Model(x["weights"], float(x["rest"][0]), x["rest"][2:], float(x["rest"][1]))

    def values(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The machine's value for the best string of each word (any edge begins one), and the word's text."""
        pieces, owner = in_pieces(texts, _SEAM)
        found, first = [], 0
        for some in slices(pieces, SLICE_BYTES):
            f, piece = self._values(some)
            found.append((f, owner[first + piece]))
            first += len(some)
        return np.concatenate([f for f, _ in found]), np.concatenate([text for _, text in found])

    def _values(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """values() of texts worked on at once."""
        cp, starts = code_points(texts)
        s, ends, places = spelled(cp)
        value, square = np.zeros(len(s) + 1), np.zeros(len(s) + 1)
        for code, weight, ok in subsequences(s, ends):
            value[: len(ok)] += np.where(ok, self.weights[code], 0) * weight
            square[: len(ok)] += ok * (weight * weight)
        to = np.minimum(np.arange(len(s)) + RUN - 1, ends)
        c, e = np.concatenate([[0], np.cumsum(value[:-1])]), np.concatenate([[0], np.cumsum(square[:-1])])
        mass = e[to] - e[:-1]
        f = np.where(mass > 0, (c[to] - c[:-1]) / np.sqrt(mass + 1.0) + self.bias, _LOWEST)
        words = np.flatnonzero(s == EDGE)  # every text begins with one
        return np.maximum.reduceat(f, words), np.searchsorted(starts, places[words], side="right") - 1

    def best(self, texts: list[str]) -> np.ndarray:
        """The value of each text's best string; a floor for texts without one."""
        f, text = self.values(texts)
        out = np.full(len(texts), _LOWEST)
        np.maximum.at(out, text, f)
        return out

    def features(self, texts: list[str]) -> np.ndarray:
        """For each text its three best words' values, up to CAP, and how many words are on the positive side."""
        f, text = self.values(texts)
        out = np.zeros((len(texts), TOP + 1))
        out[:, :TOP] = -1.0
        at = np.flatnonzero(f > -1)
        at = at[np.lexsort((-f[at], text[at]))]
        rank = np.arange(len(at)) - np.searchsorted(text[at], text[at])
        top = at[rank < TOP]
        out[text[top], rank[rank < TOP]] = np.minimum(f[top], CAP)
        out[:, TOP] = np.log1p(np.bincount(text[f > 0], minlength=len(texts)))
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.slope + self.offset, -30, 30)))


def _words(text: str) -> list[str]:
    """The words of a text as letters in lower case, single letters set apart by spaces taken together."""
    cp, _ = code_points([text])
    cuts = np.flatnonzero(symbols(cp)[0] == EDGE)
    low = cp.tobytes().decode("utf-32-le", "surrogatepass")
    out, at = [], 0
    for end in cuts.tolist():
        if w := "".join(ch for ch in low[at:end] if ch.isalpha()):
            out.append(w)
        at = end
    return out


def _machine(x: np.ndarray, y: np.ndarray, c: float = COST, steps: int = 60) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, both classes weighing the same, by Newton's method."""
    x1 = np.column_stack([x, np.ones(len(x))])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * c
    keep = np.append(np.full(x.shape[1], 0.01), 1e-6)
    w = np.zeros(x1.shape[1])
    for _ in range(steps):
        slack = 1 - y * (x1 @ w)
        on = slack > 0
        gradient = keep * w - x1[on].T @ (weight[on] * y[on] * slack[on])
        step = np.linalg.solve(np.diag(keep) + (x1[on] * weight[on, None]).T @ x1[on], gradient)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def _curve(f: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes and offset of a logistic curve, shrunk a little; targets are pulled in from 0 and 1."""
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    x, w, keep = np.column_stack([f, np.ones(len(f))]), np.zeros(f.shape[1] + 1), np.append(np.full(f.shape[1], 0.1), 1e-6)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (p - target) + keep * w)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return w[:-1], float(w[-1])


def disguised(word: str) -> list[str]:
    """A word as it may be written to get past a list: set apart by dots or spaces, or with a sign or letter put in."""
    half = len(word) // 2
    return [".".join(word), " ".join(word), f"{word[:half]}*{word[half:]}", f"{word[:half]}x{word[half:]}", f"{word[:half]}{word[half]}{word[half:]}"]


def _with(text: str, word: str, where: float) -> str:
    """text with a word put in at a space, at that share of its length or after."""
    at = text.find(" ", int(where * len(text)))
    return f"{text} {word}" if at < 0 else f"{text[:at]} {word}{text[at:]}"


def _ratio(toxic: int, clean: int, share: float) -> float:
    """Twice the log-likelihood ratio of a word's share of toxic documents against the overall one; 0 if it is lower."""
    own = toxic / (toxic + clean)
    if not 0 < share < own:
        return 0.0
    return 2 * (toxic * np.log(own / share) + (clean * np.log((1 - own) / (1 - share)) if clean else 0.0))


def fit(texts: list[str], toxic: list[int], positives: int = POSITIVES, negatives: int = NEGATIVES, min_letters: int = MIN_LETTERS) -> Model:
    """A model from labelled texts, in any order; a third of them, taken in turn, only sets the curve.

    positives and negatives bound the words learnt; words of fewer letters than min_letters have no subsequence of three
    letters and edges that tells them from parts of others, and are not learnt.
    """
    y = np.array(toxic)
    share = float(y.mean()) if len(y) else 0.0
    prior = Model(np.zeros(_SIZE), 0.0, np.zeros(TOP + 1), float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    turn = np.empty(len(y), dtype=np.int64)
    for k in (0, 1):
        turn[y == k] = np.arange((y == k).sum())
    learn = np.flatnonzero((turn % 3 != 2) | (len(y) < 30))
    near: tuple[Counter, Counter] = (Counter(), Counter())
    seen: set = set()
    for i in learn:
        words = ["", *_words(texts[i]), ""]
        contexts = set(zip(words, words[1:], words[2:], strict=False))
        new = contexts - seen
        seen |= new
        if 2 * len(new) < len(contexts):  # a copy of what has been seen
            continue
        near[int(y[i])].update({w for _, w, _ in new})
    share = float(y[learn].mean())
    ratio = {w: _ratio(n, near[0][w], share) for w, n in near[1].items() if len(w) >= min_letters}
    positive = sorted((w for w, x in ratio.items() if x >= MIN_RATIO and near[1][w] > 2 * near[0][w]), key=lambda w: (-ratio[w], w))[:positives]
    clean = sorted((w for w in near[0] if len(w) >= min_letters and near[0][w] >= near[1][w]), key=lambda w: (-near[0][w], w))
    if not positive or not clean:
        return prior
    often, rest = clean[: negatives // 2], clean[negatives // 2 :]
    negative = often + rest[:: max(1, len(rest) // (negatives // 2))][: negatives // 2]
    marks = list(dict.fromkeys(positive[:LANDMARKS] + negative[:: max(1, len(negative) // LANDMARKS)][:LANDMARKS]))
    pool = negative
    sure = [w for w in positive if ratio[w] >= ratio[positive[0]] / 2]
    positive = list(dict.fromkeys([*positive, *(v for w in sure for v in disguised(w))]))
    for _ in range(ROUNDS):
        r, c, v, _ = string_rows(marks)
        kernel = np.zeros((len(marks), _SIZE), dtype=np.float32)
        np.add.at(kernel, (r, c), v)
        values, vectors = np.linalg.eigh((kernel @ kernel.T).astype(np.float64))
        good = values > 1e-5 * values.max()
        whiten = vectors[:, good] / np.sqrt(values[good])
        names = positive + pool
        w, bias = _machine(_coordinates(names, kernel) @ whiten, np.concatenate([np.ones(len(positive)), -np.ones(len(pool))]))
        model = Model((whiten @ w) @ kernel, bias, np.zeros(TOP + 1), 0.0)
        # Clean words that the machine takes for insults, or nearly: it learns them next, the worst as landmarks too.
        hard = [clean[i] for i in np.argsort(-model.best(clean), kind="stable")[:HARD]]
        pool = list(dict.fromkeys([*pool, *hard]))
        marks = list(dict.fromkeys([*marks, *hard[: LANDMARKS // 2]]))
    tune = np.flatnonzero((turn % 3 == 2) | (len(y) < 30))
    more: list[str] = []
    # As many clean ones with a single insult, written in all ways in turn.
    ways = [v for w in sure for v in [w, *disguised(w)]]
    random = np.random.default_rng(0)
    for i in np.resize(tune[y[tune] == 0], min((y[tune] == 1).sum(), len(tune))):
        more.append(_with(texts[i], ways[random.integers(len(ways))], random.random()))
    told = np.concatenate([y[tune], np.ones(len(more), dtype=y.dtype)])
    model.slope, model.offset = _curve(np.concatenate([model.features([x]) for x in [*(texts[i] for i in tune), *more]]), told)
    return model


def _coordinates(words: list[str], kernel: np.ndarray) -> np.ndarray:
    """Kernel values of words with the landmarks whose features are the rows of kernel."""
    r, c, v, _ = string_rows(words)
    order = np.argsort(r, kind="stable")
    r, c, v = r[order], c[order], v[order].astype(np.float32)
    out = np.zeros((len(words), len(kernel)))
    if len(r):
        first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        by = kernel.T
        for a in range(0, len(first), 2_000):
            lo, hi = first[a], first[a + 2_000] if a + 2_000 < len(first) else len(r)
            out[r[first[a : a + 2_000]]] = np.add.reduceat(by[c[lo:hi]] * v[lo:hi, None], first[a : a + 2_000] - lo, axis=0)
    return out


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Model | None:
    """A model from labels (doc_id, toxic) that are not held out and the texts of docs; None where there are none.

    The sample, bounded by the two parameters, picks its texts by id and is fitted in one task. Null texts, labels that
    are neither 0 nor 1 and repeated ids teach nothing more.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1))
    numbers = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not numbers:
        return None
    share = F.when(F.col("toxic") == 1, F.lit(max_toxic / numbers.get(1, 1))).otherwise(F.lit(max_clean / numbers.get(0, 1)))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1e6
    sample = broadcast_checked(known.filter(draw < share).dropDuplicates(["doc_id"]), 4 * (max_toxic + max_clean))
    texts = docs.select("doc_id", "text").filter("text is not null").join(sample, "doc_id")

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("doc_id").sort_values("doc_id")
        return pd.DataFrame({"model": [fit(pdf["text"].tolist(), pdf["toxic"].tolist()).dump()]})

    models = texts.groupBy(F.lit(0).alias("one")).applyInPandas(task, "model binary").collect()
    return Model.load(models[0]["model"]) if models else None


def score(docs: DataFrame, keep: list[str], model: Model | None, text: str = "text") -> DataFrame:
    """keep columns plus score (0 to 1). Null and empty texts score as texts without any string; without a model, all 0.

    A column kept under that name gives way to it.
    """
    keep = [c for c in keep if c != "score"]
    kept = [F.col(f"`{c}`") for c in keep]
    if model is None:
        return docs.select(*kept, F.lit(0.0).alias("score"))
    source = docs.select(*kept, F.coalesce(F.col(text), F.lit("")).alias(*free(keep, "__text")))
    shared = docs.sparkSession.sparkContext.broadcast(model.dump())

    def task(batches):
        m = Model.load(shared.value)
        for batch in batches:
            at = 0
            for some in slices(batch.column(len(keep)).to_pylist(), SLICE_BYTES):
                own = [batch.column(i).slice(at, len(some)) for i in range(len(keep))]
                at += len(some)
                yield pa.RecordBatch.from_arrays([*own, pa.array(m.scores(some), pa.float64())], names=[*keep, "score"])

    return source.mapInArrow(task, result_schema(docs, keep, "score double"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: every document's toxicity."""
    docs = table(spark, sf_dir, "documents")
    out = score(docs, ["doc_id"], train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
