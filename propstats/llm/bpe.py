"""BPE encoding and decoding by speculation and verification.

A word is first cut greedily into the longest tokens the vocabulary has. That proposal is right exactly
where each token is what its own string encodes to and no merge crosses the border of two adjacent
tokens before both sides are complete. The second test runs for all adjacent pairs of a batch at once on
arrays of merge ranks; only words that fail either test are merged step by step.

The border test: left of a border stand, in turn, the pieces on the right spine of the left token's
merge tree, right of it those on the left spine of the right token's. A merge of two such pieces happens
only if its rank comes before the merge that absorbs the left piece, and no later than the one that
absorbs the right piece (the leftmost of equals goes first).

The tokenizer's file says what a word is. Its patterns never cross white space, so texts are
split there, and each distinct piece between spaces is encoded once per worker and kept in a bounded
cache. Special tokens in a text stand for themselves.

Defined cases: a null text is empty; an empty text has no tokens; repeated rows are encoded alike; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from propstats.llm.common import slices

SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
ODD_CONTROLS = re.compile("[\x1c-\x1f]")
CACHE_PIECES = 600_000
#: Proposals are made and tested together for so many new words.
BATCH_WORDS = 20_000
#: Words of more letters are merged with a heap.
SHORT_WORD = 64
#: Byte letters have codes below this.
LETTERS = 324
_NONE = 1 << 60


class Tokenizer:
    """One vocabulary file, ready to encode and decode. Built once per worker process."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer as Library

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings: dict[int, str] = {i: s for s, i in (self.vocab | self.special).items()}
        # The file's normaliser and word patterns, which end in one printable letter for each byte.
        library = Library.from_file(path)
        self.normalise = library.normalizer.normalize_str
        self.words = library.pre_tokenizer.pre_tokenize_str
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self._load_trie()
        self._load_merges([tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]])
        self.pieces: dict[str, bytes] = {}

    def _load_merges(self, merges: list[tuple[str, str]]) -> None:
        v, size = self.vocab, max(self.vocab.values()) + 1
        self.size = size
        # Ranks by pair, the token made by rank, and the pair that makes a token first.
        self.rank: dict[int, int] = {}
        self.made = [v[a + b] for a, b in merges]
        made: dict[int, tuple[int, int, int]] = {}
        for i, (a, b) in enumerate(merges):
            self.rank.setdefault(v[a] * size + v[b], i)
            made.setdefault(v[a + b], (v[a], v[b], i))
        keys = np.fromiter(self.rank.keys(), dtype=np.int64)
        order = np.argsort(keys)
        self.merge_keys, self.merge_ranks = keys[order], np.fromiter(self.rank.values(), dtype=np.int64)[order]
        # Spines: the pieces that stand at a token's right (left) border in turn, and the rank that absorbs each.
        never = np.iinfo(np.int64).max
        spines: list[list[list[tuple[int, int]]]] = [[], []]
        for side in (0, 1):
            for token in range(size):
                chain, absorbed = [], never
                while True:
                    chain.append((token, absorbed))
                    if token not in made:
                        break
                    left, right, absorbed = made[token]
                    token = right if side == 0 else left
                spines[side].append(chain)
        self.right_spine, self.left_spine = (self._padded(x) for x in spines)
        # A token is sound if its own string encodes to it alone.
        self.sound: dict[int, bool] = {}

    @staticmethod
    def _padded(chains: list[list[tuple[int, int]]]) -> tuple[np.ndarray, np.ndarray]:
        width = max(map(len, chains))
        tokens = np.full((len(chains), width), -1, dtype=np.int64)
        ranks = np.full((len(chains), width), -1, dtype=np.int64)
        for i, chain in enumerate(chains):
            tokens[i, : len(chain)] = [t for t, _ in chain]
            ranks[i, : len(chain)] = [r for _, r in chain]
        return tokens, ranks

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Of each pair of adjacent tokens, whether no merge crosses their border."""
        good = np.ones(len(left), dtype=bool)
        (a_tokens, a_ends), (b_tokens, b_ends) = self.right_spine, self.left_spine
        for i in range(a_tokens.shape[1]):
            a, a_end = a_tokens[left, i], a_ends[left, i]
            if (a < 0).all():
                break
            for j in range(b_tokens.shape[1]):
                b, b_end = b_tokens[right, j], b_ends[right, j]
                there = np.flatnonzero((a >= 0) & (b >= 0) & good)
                if not len(there):
                    break
                keys = a[there] * self.size + b[there]
                at = np.minimum(np.searchsorted(self.merge_keys, keys), len(self.merge_keys) - 1)
                rank = self.merge_ranks[at]
                good[there[(self.merge_keys[at] == keys) & (rank < a_end[there]) & (rank <= b_end[there])]] = False
        return good

    def symbols(self, word: str) -> list[int]:
        """A word's first tokens: its letters, the last with the end-of-word mark."""
        return [*map(self.vocab.__getitem__, word[:-1]), self.vocab[word[-1] + self.suffix]]

    def merge(self, word: str) -> list[int]:
        """Exact encoding of a word."""
        return self._merged(self.symbols(word))

    def _merged(self, ids: list[int]) -> list[int]:
        """The lowest-ranked merge first, the leftmost of equals."""
        if len(ids) > SHORT_WORD:
            return self._merged_long(ids)
        rank, size = self.rank.get, self.size
        ranks = [rank(a * size + b, _NONE) for a, b in zip(ids, ids[1:])]
        while ranks and (least := min(ranks)) < _NONE:
            i = ranks.index(least)
            ids[i] = self.made[least]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(ids[i - 1] * size + ids[i], _NONE)
            if i < len(ranks):
                ranks[i] = rank(ids[i] * size + ids[i + 1], _NONE)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of candidates over a linked list."""
        rank, size, n = self.rank.get, self.size, len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(rank(a * size + b, _NONE), i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:]))]
        heapq.heapify(heap)
        while heap and heap[0][0] < _NONE:
            least, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue  # one side has merged since
            ids[i], ids[j] = self.made[least], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                heapq.heappush(heap, (rank(ids[i] * size + ids[after[j]], _NONE), i, ids[i], ids[after[j]]))
            if before[i] >= 0:
                heapq.heappush(heap, (rank(ids[before[i]] * size + ids[i], _NONE), before[i], ids[before[i]], ids[i]))
        return [t for t in ids if t >= 0]

    def _load_trie(self) -> None:
        """Tokens as paths of symbols (a letter's code, raised where it carries the end-of-word mark)."""
        children: dict[int, int] = {}
        token_of = [-1]
        for text, token in self.vocab.items():
            ending = bool(self.suffix) and text.endswith(self.suffix) and text != self.suffix
            path = [*map(ord, text.removesuffix(self.suffix) if ending else text)]
            if ending:
                path[-1] += LETTERS
            node = 0
            for symbol in path:
                node = children.setdefault(node * 2 * LETTERS + symbol, len(token_of))
                if node == len(token_of):
                    token_of.append(-1)
            token_of[node] = token
        keys = np.fromiter(children.keys(), dtype=np.int64)
        order = np.argsort(keys)
        self.trie_keys, self.trie_nodes = keys[order], np.fromiter(children.values(), dtype=np.int64)[order]
        self.token_of = np.array(token_of, dtype=np.int64)

    def propose(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match of all words at once: tokens in order, and the word of each."""
        symbols = np.frombuffer("".join(words).encode("utf-16-le"), dtype="<u2").astype(np.int64)
        ends = np.cumsum([len(w) for w in words])
        symbols[ends - 1] += LETTERS
        at, words_left = np.concatenate([[0], ends[:-1]]), np.arange(len(words))
        found, of = [], []
        while len(words_left):
            end = ends[words_left]
            place, node = at.copy(), np.zeros(len(at), dtype=np.int64)
            token, upto = np.full(len(at), -1), at.copy()
            walking = np.arange(len(at))
            while len(walking):
                key = node[walking] * (2 * LETTERS) + symbols[place[walking]]
                child = np.minimum(np.searchsorted(self.trie_keys, key), len(self.trie_keys) - 1)
                step = self.trie_keys[child] == key
                walking = walking[step]
                node[walking] = self.trie_nodes[child[step]]
                place[walking] += 1
                here = self.token_of[node[walking]]
                whole = walking[here >= 0]
                token[whole], upto[whole] = here[here >= 0], place[whole]
                walking = walking[place[walking] < end[walking]]
            found.append(token)
            of.append(words_left)
            rest = upto < end
            at, words_left = upto[rest], words_left[rest]
        of = np.concatenate(of)
        order = np.argsort(of, kind="stable")
        return np.concatenate(found)[order], of[order]

    def is_sound(self, token: int) -> bool:
        known = self.sound.get(token)
        if known is None:
            text = self.strings[token]
            ending = bool(self.suffix) and text.endswith(self.suffix) and text != self.suffix
            ids = self.symbols(text.removesuffix(self.suffix)) if ending else [*map(self.vocab.__getitem__, text)]
            known = self.sound[token] = self._merged(ids) == [token]
        return known

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word (in byte letters): proposed, tested pair by pair, merged where a test fails."""
        flat, word_of = self.propose(words)
        inner = np.flatnonzero(word_of[:-1] == word_of[1:])
        pairs, back = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        good = self.compatible(pairs // self.size, pairs % self.size)[back]
        failed = np.zeros(len(words), dtype=bool)
        failed[word_of[inner[~good]]] = True
        tokens, back = np.unique(flat, return_inverse=True)
        sound = np.array([self.is_sound(int(t)) for t in tokens], dtype=bool)
        failed[word_of[~sound[back]]] = True
        data = flat.astype("<u4").tobytes()
        ends = np.cumsum(np.bincount(word_of, minlength=len(words)) * 4).tolist()
        out = [data[a:b] for a, b in zip([0, *ends], ends)]
        for i in np.flatnonzero(failed).tolist():
            out[i] = array("I", self.merge(words[i])).tobytes()
        return out

    def _words(self, piece: str) -> list[str]:
        """The words of a piece, one printable letter per byte, as the file's normaliser and patterns have them."""
        if piece.isascii():
            # Unaccented letters are one word; a full stop or comma after them is another.
            if piece.isalpha():
                return [piece.lower()]
            if piece[-1] in ".," and piece[:-1].isalpha():
                return [piece[:-1].lower(), piece[-1]]
        return [word for word, _ in self.words(self.normalise(piece))]

    def learn(self, pieces: list[str]) -> None:
        """Encode pieces that hold no white space into the cache."""
        words = [self._words(piece) for piece in pieces]
        unique = list({w for found in words for w in found})
        known: dict[str, bytes] = {}
        for i in range(0, len(unique), BATCH_WORDS):
            part = unique[i : i + BATCH_WORDS]
            known.update(zip(part, self.encode_words(part)))
        self.pieces.update((p, known[w[0]] if len(w) == 1 else b"".join([known[x] for x in w])) for p, w in zip(pieces, words))

    def _pieces(self, text: str) -> list[str]:
        if not ODD_CONTROLS.search(text):
            return text.split()
        return [piece for piece in SPACE.split(text) if piece]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = []
        for text in texts:
            parts = self.split_special.split(text) if "<|" in text else [text]
            split.append([self._pieces(p) if i % 2 == 0 else p for i, p in enumerate(parts)])
        wanted = {p for parts in split for x in parts if isinstance(x, list) for p in x}
        if len(self.pieces) + len(wanted) > CACHE_PIECES:
            # What this batch uses stays: frequent pieces outlive the cache.
            self.pieces = {p: self.pieces[p] for p in wanted if p in self.pieces}
        new = [p for p in wanted if p not in self.pieces]
        if new:
            self.learn(new)
        get = self.pieces.__getitem__
        return [
            b"".join([b"".join(map(get, x)) if isinstance(x, list) else self.special[x].to_bytes(4, "little") for x in parts])
            for parts in split
        ]

    def decode(self, ids: bytes) -> str:
        """Token strings joined by spaces, as a vocabulary file without a decoder says."""
        return " ".join(map(self.strings.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_TOKENIZERS: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Tokenizer(path)
    return _TOKENIZERS[path]


def _slices(texts: list[str], most: int = 4_000_000):
    """Runs of texts of a few million characters, so that neither a batch nor its tokens weigh much."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield texts[start:i]
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield texts[start:]


def encoded(text: Column, path: str) -> Column:
    """array<int>: the ids of a text."""

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        known = tokenizer(path)
        return pd.Series(
            [np.frombuffer(x, dtype="<u4").astype(np.int32) for part in _slices(texts.fillna("").tolist()) for x in known.encode(part)], dtype=object
        )

    return ids(text.cast("string"))


def encode_rows(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the column ``text`` replaced by ``ids`` (array<int>), in Arrow lists over one buffer per few megabytes of text."""
    from pyspark.sql.pandas.types import to_arrow_schema

    others = [c for c in df.columns if c != text]
    schema = T.StructType([*[df.schema[c] for c in others], T.StructField(ids, T.ArrayType(T.IntegerType()))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tokenizer(path)
        for part in slices(batches, text, 1 << 20):
            found = known.encode(part.column(text).fill_null("").to_pylist())
            ends = np.cumsum([0, *(len(x) // 4 for x in found)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), dtype="<i4")))
            columns = [*[part.column(c) for c in others], lists]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)
        # Workers are used again for other work: what the encoder has learnt goes with its last row.
        _TOKENIZERS.pop(path, None)

    return df.select(*others, F.col(text).cast("string").alias(text)).mapInArrow(run, schema)


def decoded(ids: Column, path: str) -> Column:
    """The text that an array of ids decodes to; null ids are null."""

    @F.pandas_udf("string")
    def text(rows: pd.Series) -> pd.Series:
        known = tokenizer(path)
        return pd.Series([None if x is None else known.decode(np.asarray(x, dtype="<u4").tobytes()) for x in rows], dtype=object)

    return text(ids)


def digest(text: Column, path: str) -> Column:
    """struct<n_tokens, ids_sha256, decoded_sha256>: encode a text, decode its ids, and keep the digests."""

    @F.pandas_udf("struct<n_tokens:long,ids_sha256:string,decoded_sha256:string>")
    def row(texts: pd.Series) -> pd.DataFrame:
        known = tokenizer(path)
        out = []
        for part in _slices(texts.fillna("").tolist()):
            for ids in known.encode(part):
                out.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(known.decode(ids).encode()).hexdigest()))
        return pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return row(text.cast("string"))
