"""Toxicity: a support vector machine on a gap-weighted subsequence kernel with Nystroem landmarks.

The kernel of two words is the sum over letter subsequences of length three of both words' weights for it, where an occurrence
that spans n letters weighs DECAY ** n; it is normalised to 1 for equal words. So "idxiot" or "id*iot" stay close to
"idiot". Single letters set apart ("i d i o t") are read as one word. Letters of all scripts count.

Labels exist for documents, so the machine learns from bags: the sentences of a clean document are clean, and a toxic one has
toxic words in some of its sentences. First witnesses are the words that toxic documents hold far more often than due; a
machine trained on them names the witnesses of the next round in the sentences of each toxic document, whereupon it
is trained again. A word's feature vector is its kernel with the landmarks, times the inverse square root of the landmarks' own
kernel matrix. The decision is linear in the kernel, so it sums up in one weight for each subsequence: a word is scored
exactly by looking up its subsequences, without a pass over landmarks. A document's score is a logistic function of the
largest decision, the number and the share of toxic words, fitted on labelled documents.
"""

import functools
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DECAY = 0.5
#: Codes of letters: 1 to 26 for Latin base letters, the rest for the letters of all other scripts.
LETTERS = 64
#: Longer words are read in windows of this many letters, half of it apart.
LONGEST = 16
APART = re.compile(r"(?<!\S)\w(?:[^\w\n]{1,2}\w){2,}(?!\w)")
MAX_WORDS_KEPT = 500_000
#: Decision of a text without a word, and the decision from which a word counts as clearly toxic.
LOWEST, CLEAR = -1.0, 0.85
SENTENCE = re.compile(r"[.!?…。！？]+\s|\n")


@functools.lru_cache
def codes() -> np.ndarray:
    """Code of each character below U+20000: Latin letters fold to their base letter; the letters of another script go by their
    number, so that neighbouring ones, as those of an alphabet, differ. 0 is left out."""
    table = np.zeros(0x20000, np.uint8)
    for i in range(0x20000):
        c = chr(i)
        if not c.isalpha():
            continue
        base = unicodedata.normalize("NFKD", c.lower())[:1]
        if "a" <= base <= "z":
            table[i] = ord(base) - 96
        else:
            table[i] = 19 if c in "ßẞ" else 27 + ord(base or c) % (LETTERS - 27)
    return table


def letters(words: list[str]) -> list[bytes]:
    """Each word's letters as codes; what isn't a letter is left out. The words hold no line ends."""
    c = np.frombuffer("\n".join(words).encode("utf-32-le", "replace"), np.uint32)
    ends, table = c == 10, codes()
    c = table[np.where(c < len(table), c, 0)]
    c[ends] = 255
    return c[c > 0].tobytes().split(b"\xff") if words else []


def windows(code: bytes) -> list[bytes]:
    if len(code) <= LONGEST:
        return [code] if len(code) >= 3 else []
    return [code[i : i + LONGEST] for i in range(0, len(code) - LONGEST // 2, LONGEST // 2)]


def words_of(text: str) -> set[str]:
    """The distinct words of a whole text, and letters set apart read as words."""
    low = text.lower()
    found = set(low.split())
    found.update("".join(ch for ch in m if ch.isalnum()) for m in APART.findall(low))
    return found


def gap_matrix(n: int) -> np.ndarray:
    """DECAY ** (i - j) below the diagonal."""
    i = np.arange(n)
    return np.where(i[:, None] > i, DECAY ** np.maximum(i[:, None] - i, 0.0), 0.0)


def kernel(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Subsequence kernels of words s[i] with t[i], each a matrix of letter codes of one length."""
    match = (s[:, :, None] == t[:, None, :]).astype(float)
    ds, dt = gap_matrix(s.shape[1]), gap_matrix(t.shape[1])
    a = DECAY**2 * match
    for _ in range(2):
        a = match * (ds @ a @ dt.T)
    return a.sum(axis=(1, 2))


def subsequences(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, weight) of the three-letter subsequences of words of one length."""
    n = s.shape[1]
    i, j, k = (x.ravel() for x in np.meshgrid(*[np.arange(n)] * 3, indexing="ij"))
    up = (i < j) & (j < k)
    i, j, k = i[up], j[up], k[up]
    s = s.astype(np.int32)
    return (s[:, i] * LETTERS + s[:, j]) * LETTERS + s[:, k], DECAY ** (k - i + 1.0)


def by_length(words: list[bytes]):
    """(places, matrix of codes) for each length."""
    sizes = np.array([len(w) for w in words])
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        for part in np.array_split(at, -(-len(at) // 4096)):
            yield part, np.frombuffer(b"".join(words[p] for p in part), np.uint8).reshape(-1, n)


@dataclass
class Model:
    """table: weight of each subsequence; bias of the machine; document: (intercept, slope) of the logistic function of the largest decision."""

    table: np.ndarray
    bias: float
    document: np.ndarray

    def decide(self, words: list[bytes]) -> np.ndarray:
        """The machine's decision for each word of at least three letters, as codes."""
        out = np.empty(len(words))
        for at, s in by_length(words):
            index, weight = subsequences(s)
            out[at] = (self.table[index] @ weight) / np.sqrt(kernel(s, s)) + self.bias
        return out

    def features(self, texts: list[str | None], known: dict[str, float]) -> np.ndarray:
        """For each text, of its distinct words' decisions: the largest, how many are over 0 and over CLEAR as log(1 + n), the share over 0.
        known: decisions of words met before."""
        found = [words_of(t) if isinstance(t, str) and t else set() for t in texts]
        if len(known) > MAX_WORDS_KEPT:
            known.clear()
        new = [w for w in set().union(*found) if w not in known]
        codes = letters(new)
        parts = {c: windows(c) for c in codes}
        flat = list(dict.fromkeys(p for ps in parts.values() for p in ps))
        score = dict(zip(flat, self.decide(flat).tolist())) if flat else {}
        best = {c: score[c] if c in score else max([score[p] for p in ps], default=LOWEST) for c, ps in parts.items()}
        known.update(zip(new, map(best.__getitem__, codes)))
        return np.array([document_features(np.fromiter(map(known.__getitem__, words), float, len(words))) for words in found]).reshape(-1, 4)

    def score(self, features: np.ndarray) -> np.ndarray:
        z = np.column_stack([np.ones(len(features)), features]) @ self.document
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def document_features(d: np.ndarray) -> tuple[float, ...]:
    over = (d > 0).sum()
    return max(d.max(initial=LOWEST), LOWEST), np.log1p(over), np.log1p((d > CLEAR).sum()), over / max(1, len(d))


def decisions(z: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The decision for each row of z, in lots, as z is kept in half precision."""
    v = w[:-1].astype(np.float32)
    return np.concatenate([np.empty(0), *(z[i : i + 8192].astype(np.float32) @ v for i in range(0, len(z), 8192))]) + w[-1]


def train_svm(z: np.ndarray, rows: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, steps: int = 30) -> np.ndarray:
    """Weights of a linear machine for the rows of z with labels y, the last one the bias: squared hinge loss, Newton steps on the
    active set. Weights sum up to 1."""
    w = np.zeros(z.shape[1] + 1)
    penalty = np.diag(np.append(np.full(z.shape[1], ridge), 1e-9))
    for _ in range(steps):
        active = np.flatnonzero(1 - y * decisions(z, w)[rows] > 0)
        left, right = penalty.copy(), np.zeros(len(w))
        for i in range(0, len(active), 8192):
            at = active[i : i + 8192]
            x = np.column_stack([z[rows[at]].astype(np.float32), np.ones(len(at), np.float32)])
            left += x.T @ (weight[at, None].astype(np.float32) * x)
            right += x.T @ (weight[at] * y[at])
        new = np.linalg.solve(left, right)
        if np.allclose(new, w, atol=1e-4):
            break
        w = new
    return w


def train_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Landmarks:
    """Landmark words, the subsequences that they hold, and the inverse square root of their kernel matrix."""

    def __init__(self, words: list[bytes]):
        self.number = np.zeros(LETTERS**3, np.int32)  # row of rows for each subsequence; 0: in no landmark
        parts = [(at, *subsequences(s), np.sqrt(kernel(s, s))) for at, s in by_length(words)]
        held = np.unique(np.concatenate([index.ravel() for _, index, _, _ in parts]))
        self.number[held] = np.arange(1, len(held) + 1)
        self.held, self.rows = held, np.zeros((len(held) + 1, len(words)), np.float32)
        for at, index, weight, norm in parts:
            np.add.at(self.rows, (self.number[index], at[:, None]), (weight / norm[:, None]).astype(np.float32))
        values, vectors = np.linalg.eigh((self.rows.T @ self.rows).astype(float))
        self.root = vectors / np.sqrt(np.maximum(values, 1e-3)) @ vectors.T

    def features(self, words: list[bytes]) -> np.ndarray:
        """A row for each word."""
        out, root = np.empty((len(words), len(self.root)), np.float16), self.root.astype(np.float32)
        for at, s in by_length(words):
            index, weight = subsequences(s)
            norm, weight = np.sqrt(kernel(s, s))[:, None], weight.astype(np.float32)
            step = 512
            for i in range(0, len(at), step):
                near = np.zeros((len(index[i : i + step]), len(self.root)), np.float32)
                for column, x in zip(self.number[index[i : i + step]].T, weight):
                    near += x * self.rows[column]
                out[at[i : i + step]] = near / norm[i : i + step] @ root
        return out

    def table(self, w: np.ndarray) -> np.ndarray:
        """The weight of each subsequence in a decision that is linear in the features."""
        table = np.zeros(LETTERS**3)
        table[self.held] = self.rows[1:].astype(float) @ (self.root @ w)
        return table


def bags_of(texts: list[str]) -> tuple[list[bytes], list[np.ndarray]]:
    """All distinct words, as windows of codes, and the numbers of those in the sentences of each text."""
    number: dict[bytes, int] = {}
    bags = []
    for text in texts:
        own = {w for sentence in SENTENCE.split(text) for c in letters(sorted(words_of(sentence))) for w in windows(c)}
        bags.append(np.array(sorted(number.setdefault(w, len(number)) for w in sorted(own)), np.int32))
    return list(number), bags


def train(sample: pd.DataFrame, landmarks: int = 256, rounds: int = 3, ridge: float = 1e-4, surprise: float = 6.0, seed: int = 5) -> Model:
    """A model from labelled rows (text, toxic). Without toxic or clean rows, or witnesses in them, every document scores low.

    All words of all rows take part. First witnesses are the words that exceed their share of toxic documents by `surprise`
    deviations. Words of clean documents are clean, unless toxic ones hold them too often (by two deviations) to tell. Half
    of the landmarks are witnesses at most, the others clean words, at random and of those that the first machine found worst.
    """
    toxic = sample["toxic"].to_numpy() == 1
    words, held = bags_of(sample["text"].tolist())
    in_toxic, in_clean = (np.bincount(np.concatenate([*(h for h, t in zip(held, toxic) if t == kind), np.empty(0, np.int32)]), minlength=len(words)) for kind in (True, False))
    due = (in_toxic + in_clean) * (toxic.sum() / max(1, len(toxic)))
    over = (in_toxic - due) / np.sqrt(np.maximum(due, 1e-9))
    share, clean = np.where(over >= surprise, in_toxic, 0).astype(float), np.flatnonzero((in_clean > 0) & (over < 2))
    if not share.any() or not len(clean):
        rate = min(-0.1, np.log((toxic.sum() + 0.5) / ((~toxic).sum() + 5.0)))
        return Model(np.zeros(LETTERS**3), -1.0, np.array([rate, 0.0, 0.0, 0.0, 0.0]))
    shuffled, hard = np.random.default_rng(seed).permutation(clean), clean[:0]
    sick = [h for h, t in zip(held, toxic) if t]
    for n in range(rounds):
        positive = np.flatnonzero(share)
        if n < 2:
            best = positive[np.argsort(-over[positive], kind="stable")][: landmarks // 2]
            chosen = np.unique(np.concatenate([best, hard, shuffled[: landmarks - len(best) - len(hard)]]))
            marks = Landmarks([words[i] for i in chosen])
            z = marks.features(words)
        weight = np.append(share[positive] / share.sum(), np.full(len(clean), 1 / len(clean))) / 2
        w = train_svm(z, np.append(positive, clean), np.append(np.ones(len(positive)), -np.ones(len(clean))), weight, ridge)
        decision = decisions(z, w)
        hard = clean[np.argsort(-decision[clean], kind="stable")][: landmarks // 4]
        if n:
            # Witnesses of the next round: what is toxic in the sentences of toxic documents, as far as clean ones don't hold it as often.
            share = np.zeros(len(words))
            for own in sick:
                share[own[(decision[own] > 0) & (over[own] >= 2)]] += 1
    model = Model(marks.table(w[:-1]), float(w[-1]), np.zeros(5))
    model.document = train_logistic(np.array([document_features(decision[h]) for h in held]), toxic.astype(float))
    return model


def _frames(batches, chars: int = 4_000_000):
    for b in batches:
        part = b["text"].str.len().fillna(0).cumsum() // chars
        for _, rows in b.groupby(part, sort=True):
            yield rows


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for each row of docs (doc_id, text), from the whole text. Null counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 160 kB, whatever the data

    def run(batches):
        known: dict[str, float] = {}
        m = shared.value
        for b in _frames(batches):
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": m.score(m.features(b["text"].tolist(), known))})

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def held_out(doc_id="doc_id"):
    """Whether a document's label is kept from training: crc32 of the id's text is 0 modulo 5."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def fitted(docs: DataFrame, labels: DataFrame, max_docs: int = 5000, **options) -> Model:
    """train() on at most max_docs labelled documents that aren't held out: those of the smallest hash of the id.

    Only ids choose the sample; labels, languages and sources are no inputs of the features. A document with
    several labels is toxic if one of them says so; one with several texts counts once, by the least of them.
    """
    known = labels.filter("doc_id is not null and toxic is not null").filter(~held_out()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    sample = docs.filter("text is not null").select("doc_id", "text").join(F.broadcast(known), "doc_id")  # max_docs ids at most
    sample = sample.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    return train(sample.toPandas().sort_values("doc_id"), **options)


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs (doc_id, text).

    Null and empty texts have no words and get the lowest score. Repeated rows and null ids are kept; a null id counts as
    held out. Without labels every score is under 0.5. An empty table gives no rows.
    """
    out = score(docs, fitted(docs, labels, **options))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The rows of docs whose score is under the threshold, with their columns as they are."""
    model = fitted(docs, labels, **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, float] = {}
        for texts in batches:
            yield pd.Series(np.concatenate([shared.value.score(shared.value.features(texts.iloc[i : i + 500].tolist(), known)) for i in range(0, len(texts), 500)]) if len(texts) else [], dtype=float)

    return docs.filter(F.pandas_udf(scores, "double")("text") < threshold)
