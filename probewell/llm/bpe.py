"""BPE encoding and decoding in batched numpy merge rounds.

The symbols of many words stand in one flat array. In each round the rank of every neighbouring pair is found by binary
search over the sorted pair keys, each word merges its pair of lowest rank wherever it stands, and words without a known
pair leave the array. Long words (texts without spaces) stand in an array of their own: there a round merges the lowest
rank of all, and ranks are searched for again only beside what it merged, so that the work grows with the merges and not
with rounds times length.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import json

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

#: Unicode's White_Space, spelled out: other engines' \s hold the separators U+001C to U+001F too.
SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The pattern that byte-level BPE splits texts with. Fixed value.
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
NONE = np.iinfo(np.int64).max
#: Bytes from which a word counts as long.
LONG = 256


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in vocabulary files: printable Latin-1 as itself, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Bpe:
    """A byte-level BPE vocabulary read from a tokenizers JSON file. Words met are kept, up to `keep` of them."""

    def __init__(self, path: str, keep: int = 200_000):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab, letters = file["model"]["vocab"], byte_letters()
        self.byte_ids = np.array([vocab[c] for c in letters], np.int64)
        self.bits = 1 + max([*vocab.values(), *(t["id"] for t in file["added_tokens"])]).bit_length()
        left, right, made = (np.empty(len(file["model"]["merges"]), np.int64) for _ in range(3))
        for i, pair in enumerate(file["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left[i], right[i], made[i] = vocab[a], vocab[b], vocab[a + b]
        keys = left << self.bits | right
        latest = np.full(1 << self.bits, -1, np.int64)
        np.maximum.at(latest, made, np.arange(len(made)))
        if (np.maximum(latest[left], latest[right]) >= np.arange(len(made))).any():
            raise ValueError(f"{path}: a merge stands before one that makes its part")
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.special_split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.split = regex.compile(SPLIT)
        of = {c: b for b, c in enumerate(letters)}
        pieces = {i: bytes(of[c] for c in t) for t, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        table = [pieces.get(i, b"") for i in range(max(pieces) + 1)]
        self.piece_at = np.concatenate([[0], np.cumsum([len(p) for p in table])])
        self.pieces = np.frombuffer(b"".join(table), np.uint8)
        self.keep, self.forget = keep, None
        self.forget_words()

    def forget_words(self):
        # Special tokens count as words met, each with its one id.
        self.number = {s: n for n, s in enumerate(self.special)}
        self.ids, self.at = np.array([*self.special.values()], np.int64), np.arange(len(self.special) + 1)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, NONE if it isn't known."""
        key = left << self.bits | right
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[place] == key, self.rank[place], NONE)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of all words in a row, and where each word's ids end."""
        long = [i for i, w in enumerate(words) if len(w) >= LONG]
        short = [w if len(w) < LONG else b"" for w in words] if long else words
        done = self.merge_short(short)
        if long:
            word, ids = self.merge_long([words[i] for i in long])
            done = [*done, (np.array(long, np.int64)[word], ids)]
        word, ids = (np.concatenate([d[i] for d in done]) for i in (0, 1)) if done else (np.empty(0, np.int64),) * 2
        order = np.argsort(word, kind="stable")
        return ids[order], np.cumsum(np.bincount(word, minlength=len(words)))

    def merge_short(self, words: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(words, ids) of the symbols left, in lots that hold whole words."""
        sizes = np.array([len(w) for w in words], np.int64)
        sym = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        done = []
        while len(sym):
            rank = np.where(word[:-1] == word[1:], self.ranks(sym[:-1], sym[1:]), NONE)
            rank = np.append(rank, NONE)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            lengths = np.diff(np.append(first, len(sym)))
            low = np.repeat(np.minimum.reduceat(rank, first), lengths)
            over = low == NONE
            if over.any():
                done.append((word[over], sym[over]))
                stay = ~over
                sym, word, rank, low = sym[stay], word[stay], rank[stay], low[stay]
                if not len(sym):
                    break
            at = every_other(np.flatnonzero(rank == low), np.arange(1, len(sym) + 1))
            sym[at] = self.made[rank[at]]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            sym, word = sym[stay], word[stay]
        return done

    def merge_long(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(words, ids) of the symbols left. Places wait under their pair's rank until it is the lowest of all.

        Merging the lowest rank of all words keeps each word's own order, as words don't touch; a product only
        occurs in later merges, so all places of a rank merge together.
        """
        sym = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        n = len(sym)
        word = np.append(np.repeat(np.arange(len(words)), [len(w) for w in words]), -1)
        after, before = np.arange(1, n + 1), np.arange(-1, n)  # the neighbours still there; n: none
        rank = np.append(np.where(word[:-2] == word[1:-1], self.ranks(sym[:-1], sym[1:]), NONE), NONE)
        waiting: dict[int, list[np.ndarray]] = {}
        lowest: list[int] = []

        def wait(at: np.ndarray) -> None:
            at = at[rank[at] != NONE]
            at = at[np.argsort(rank[at], kind="stable")]
            r = rank[at]
            cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
            for part in np.split(at, cuts) if len(at) else []:
                key = int(rank[part[0]])
                if key not in waiting:
                    waiting[key] = []
                    heapq.heappush(lowest, key)
                waiting[key].append(part)

        wait(np.arange(n))
        there = np.ones(n, bool)
        while lowest:
            r = heapq.heappop(lowest)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = every_other(at[rank[at] == r], after)
            if not len(at):
                continue
            gone = after[at]
            sym[at], rank[gone], there[gone], after[at] = self.made[r], NONE, False, after[gone]
            before[after[at]] = at
            changed = np.unique(np.concatenate([before[at], at]))
            changed = changed[changed >= 0]
            nexts = after[changed]
            same = word[changed] == word[nexts]
            rank[changed] = NONE
            rank[changed[same]] = self.ranks(sym[changed[same]], sym[nexts[same]])
            wait(changed)
        return word[:n][there], sym[there]

    def learn(self, words: list[str]) -> None:
        """Encodes words that have no number yet."""
        ids, ends = self.merge([w.encode() for w in words])
        self.number.update(zip(words, range(len(self.number), len(self.number) + len(words))))
        self.ids, self.at = np.concatenate([self.ids, ids]), np.concatenate([self.at, ends + self.at[-1]])

    def words_of(self, text: str) -> list[str]:
        """The words of a text; a special token's string is a word of its own."""
        if not self.special_split or not any(s in text for s in self.special):
            return self.split.findall(text)
        return [w for part in self.special_split.split(text) for w in ([part] if part in self.special else self.split.findall(part))]

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. Words not met before, of all texts, are merged together."""
        words = [self.words_of(t) for t in texts]
        if len(self.number) > self.keep:
            self.forget_words()
        met: set[str] = set()
        for w in words:
            met.update(w)
        if new := [w for w in met if w not in self.number]:
            self.learn(new)
        numbers = np.fromiter(map(self.number.__getitem__, itertools.chain.from_iterable(words)), np.int64, sum(map(len, words)))
        ids = ragged(self.ids, self.at, numbers)
        ends = np.append(0, np.cumsum(self.at[numbers + 1] - self.at[numbers]))[np.cumsum([len(w) for w in words])]
        return np.split(ids, ends[:-1]) if len(ends) else []

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        return ragged(self.pieces, self.piece_at, ids).tobytes().decode("utf-8", "replace")


def every_other(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of pairs that start at `at`, in order, those to merge: a run that overlaps itself (aaa) merges every other one, from the left."""
    starts = np.flatnonzero(np.append(True, after[at[:-1]] != at[1:])) if len(at) else at
    nth = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
    return at[nth % 2 == 0]


def ragged(values: np.ndarray, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """values[at[r]:at[r + 1]] for each r of rows, in a row."""
    sizes = at[rows + 1] - at[rows]
    ends = np.cumsum(sizes)
    if not len(ends) or not ends[-1]:
        return values[:0]
    return values[np.arange(ends[-1]) + np.repeat(at[rows] - ends + sizes, sizes)]


def chunks(batches, chars: int = 1_000_000):
    """Frames of about `chars` characters of text: what is in memory at once doesn't depend on the rows of a batch."""
    for b in batches:
        part = b["text"].str.len().fillna(0).cumsum() // chars
        for _, rows in b.groupby(part, sort=True):
            yield rows


@functools.lru_cache(maxsize=2)
def loaded(path: str) -> Bpe:
    return Bpe(path)


def encode_decode(docs: DataFrame, vocabulary: str | None = None, with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row of docs (doc_id, text); ids and decoded on request.

    Null text is empty: no tokens, the digests of nothing. Repeated rows and null ids are kept as they are. The
    vocabulary's path is read by each Python worker.
    """
    path = vocabulary or default_vocabulary()

    def run(batches):
        bpe = loaded(path)
        for b in chunks(batches):
            texts = [t if isinstance(t, str) else "" for t in b["text"]]
            rows = {"doc_id": b["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], **({"ids": []} if with_ids else {}), **({"decoded": []} if with_text else {})}
            for ids in bpe.encode_many(texts):
                decoded = bpe.decode(ids)
                rows["n_tokens"].append(len(ids))
                rows["ids_sha256"].append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                rows["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                if with_ids:
                    rows["ids"].append(ids.astype(np.int32))
                if with_text:
                    rows["decoded"].append(decoded)
            yield pd.DataFrame(rows)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_text
    return docs.select("doc_id", "text").mapInPandas(run, schema)
