"""SentencePiece encoding and decoding for merge-type vocabularies, by an agenda of adjacent symbol pairs.

A text is normalised, cut into symbols of one character each, and every two neighbours whose joined
string is a piece go on the agenda, ordered by the piece's score and then from left to right. The best
pair is merged, its new neighbours join the agenda, and entries whose symbols have changed since are
skipped. What is left when the agenda is empty is the encoding; a symbol outside the vocabulary becomes
the pieces of its UTF-8 bytes, or the unknown piece where the vocabulary has none for bytes.

No piece holds a character followed by another unless the two stand side by side in some piece. Where
they never do, no merge can cross, so texts are cut there beforehand and each distinct chunk goes through
the agenda once per worker, kept in a cache of bounded size.

What the agenda makes of the new chunks of each Arrow batch is checked against the sentencepiece library, which gets
them as one text; a chunk that comes out otherwise stops the job with its name.

Defined cases: a null text is empty; an empty text has no pieces; repeated rows are encoded alike; a text
of any length is one text; an empty table gives no rows; other columns are not read. Vocabularies with
user-defined pieces are refused, as those are cut out before merging.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propstats.llm.common import slices

SPACE = "▁"
CACHE_CHUNKS = 600_000
CACHE_CHARS = 16_000_000
SLICE_BYTES = 1 << 20
#: Chunks of more symbols have a heap as agenda.
ROW_SYMBOLS = 40
NEVER = np.iinfo(np.int32).max


class Pieces:
    """One model file, ready to encode and decode. Built once per worker process."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = library.get_piece_size()
        self.strings = [library.id_to_piece(i) for i in range(n)]
        self.special = {i for i in range(n) if library.is_control(i) or library.is_unknown(i)}
        self.unknown = library.unk_id()
        byte_ids = [i for i in range(n) if library.is_byte(i)]
        self.byte_of = {i: int(self.strings[i][3:5], 16) for i in byte_ids}
        self.id_of_byte = {b: i for i, b in self.byte_of.items()}
        if any(library.is_unused(i) for i in range(n)):
            raise ValueError("vocabularies with unused pieces are not supported")
        own = [i for i in range(n) if i not in self.special and i not in self.byte_of]
        self.id_of = {self.strings[i]: i for i in own}
        #: A pair's place on the agenda: the greater its piece's score, the lesser the number.
        self.place_of = {self.strings[i]: -library.get_score(i) for i in own}
        self.said = [self._bytes(i) for i in range(n)]
        self.decimal = [str(i) for i in range(n)]
        # The dummy prefix that the normaliser sets, and that decoding takes off again.
        self.prefixed = library.normalize("a").startswith(SPACE)
        self._load_cuts()
        self._load_pairs()
        self.lettered = re.compile("[" + "".join(map(re.escape, self.letters)) + "]+").fullmatch
        # Between chunks of a text under check stands a character that no piece joins to another.
        inside = {c for s in self.id_of if len(s) > 1 for c in s}
        self.border = next(c for c in "\n\x00\x01\x02" if c not in inside and library.normalize(f"a{c}a").endswith(f"a{c}a"))
        self.chunks: dict[str, bytes] = {}
        self.held = 0

    def _bytes(self, piece: int) -> bytes:
        if piece in self.byte_of:
            return bytes([self.byte_of[piece]])
        if piece == self.unknown:
            return self.library.decode([piece]).encode()
        return b"" if piece in self.special else self.strings[piece].replace(SPACE, " ").encode()

    def _load_cuts(self) -> None:
        """A pattern of chunks that no merge crosses: runs of spaces with what follows, and characters that never merge."""
        merging = {c for s in self.id_of if len(s) > 1 for c in s}
        after = any(SPACE in s.lstrip(SPACE) for s in self.id_of)
        inner = "".join(map(re.escape, sorted(merging - {SPACE})))
        # Where some piece holds a space after another character, only the characters that never merge are borders.
        together = f"[{inner}{SPACE}]+" if after else f"{SPACE}+[{inner}]*|[{inner}]+"
        self.cut = re.compile(f"{together}|[^{inner}{SPACE}]").findall

    def _load_pairs(self) -> None:
        """Every pair of symbols that joins to a piece: its place and the piece, in an open hash table of two arrays."""
        self.letters = {c: i for i, c in enumerate(sorted({c for s in self.id_of for c in s}))}
        #: Symbols are numbered: letters first, then pieces of several letters; -1 ends a row.
        self.symbol_of = dict(self.letters)
        for s in self.id_of:
            self.symbol_of.setdefault(s, len(self.symbol_of))
        self.symbols = list(self.symbol_of)
        self.ids_of_symbol = [self._ids(s) for s in self.symbols]
        # Places as whole numbers: equal scores share one, as ties go from left to right.
        order = {v: i for i, v in enumerate(sorted(set(self.place_of.values())))}
        number, pairs = self.symbol_of, {}
        for s in self.id_of:
            for k in range(1, len(s)):
                left, right = number.get(s[:k]), number.get(s[k:])
                if left is not None and right is not None:
                    pairs[left * len(number) + right] = (order[self.place_of[s]], number[s])
        self.size = len(number)
        keys = np.fromiter(pairs.keys(), dtype=np.int64, count=len(pairs))
        bits = max(len(keys), 1).bit_length() + 1
        self.slots, self.shift = 1 << bits, np.uint64(64 - bits)
        self.table = np.full(self.slots, -1, dtype=np.int64)
        self.table_place, self.table_joined = np.full(self.slots, NEVER, dtype=np.int32), np.zeros(self.slots, dtype=np.int32)
        values = np.array(list(pairs.values()), dtype=np.int32).reshape(-1, 2)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            # In each round the first key that wants a free slot has it; the others go one slot on.
            wanted, first = np.unique(at[left], return_index=True)
            free = self.table[wanted] < 0
            put = left[first[free]]
            self.table[at[put]] = keys[put]
            self.table_place[at[put]], self.table_joined[at[put]] = values[put, 0], values[put, 1]
            left = np.setdiff1d(left, put)
            at[left] = (at[left] + 1) & (self.slots - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        # The upper bits of a product with an odd number, 2 ** 64 over the golden ratio.
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and joined symbol of each pair; ``NEVER`` where the two do not join."""
        keys = left.astype(np.int64) * self.size + right
        at = self._slot(keys)
        found = self.table[at]
        missed = (found != keys) & (found >= 0)
        while missed.any():
            at[missed] = (at[missed] + 1) & (self.slots - 1)
            found = self.table[at]
            missed = (found != keys) & (found >= 0)
        return np.where(found == keys, self.table_place[at], NEVER), self.table_joined[at]

    def _ids(self, symbol: str) -> list[int]:
        known = self.id_of.get(symbol)
        if known is not None:
            return [known]
        return [*map(self.id_of_byte.__getitem__, symbol.encode())] if self.id_of_byte else [self.unknown]

    def merge_rows(self, chunks: list[str]) -> list[bytes]:
        """The ids of chunks of one length whose letters are known, each row with its own agenda.

        A row's agenda is the places of its pairs; the least, the leftmost of equals, is merged in all rows at
        once. Every row still at work is one symbol shorter then, so the rows stay a rectangle.
        """
        count, width = len(chunks), len(chunks[0])
        rows = np.array([*map(self.letters.__getitem__, "".join(chunks))], dtype=np.int32).reshape(count, width)
        # One column more than pairs, where no pair is: an agenda that ends finds its least place there.
        place, joined = np.full((count, width), NEVER, dtype=np.int32), np.zeros((count, width), dtype=np.int32)
        place[:, :-1], joined[:, :-1] = self._look_up(rows[:, :-1], rows[:, 1:])
        of, out = np.arange(count), [b""] * count
        while len(of):
            best = place.argmin(axis=1)
            done = place[np.arange(len(of)), best] == NEVER
            for i, symbols in zip(of[done].tolist(), rows[done].tolist()):
                ids = self.ids_of_symbol[symbols[0]] if len(symbols) == 1 else [x for s in symbols for x in self.ids_of_symbol[s]]
                out[i] = array("I", ids).tobytes()
            rows, place, joined, of, best = rows[~done], place[~done], joined[~done], of[~done], best[~done]
            line, width = np.arange(len(of)), width - 1
            rows[line, best] = joined[line, best]
            other, pair = np.ones(rows.shape, dtype=bool), np.ones(rows.shape, dtype=bool)
            other[line, best + 1], pair[line, best] = False, False
            rows, place, joined = (x[keep].reshape(len(of), width) for x, keep in ((rows, other), (place, pair), (joined, pair)))
            # The pairs on either side of what was merged are new.
            there = np.concatenate([np.flatnonzero(best > 0), np.flatnonzero(best < width - 1)])
            where = np.concatenate([best[best > 0] - 1, best[best < width - 1]])
            place[there, where], joined[there, where] = self._look_up(rows[there, where], rows[there, where + 1])
        return out

    def merge(self, chunk: str) -> list[int]:
        """The ids of one chunk of any length and any letters, its agenda a heap."""
        place, symbols = self.place_of.get, list(chunk)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []
        for i in range(n - 1):
            at = place(symbols[i] + symbols[i + 1])
            if at is not None:
                agenda.append((at, i, symbols[i], symbols[i + 1]))
        heapq.heapify(agenda)
        pop, push = heapq.heappop, heapq.heappush
        while agenda:
            _, i, left, right = pop(agenda)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue  # a side has changed since
            symbols[i] = joined = left + right
            symbols[j] = ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                at = place(joined + symbols[k])
                if at is not None:
                    push(agenda, (at, i, joined, symbols[k]))
            h = before[i]
            if h >= 0:
                at = place(symbols[h] + joined)
                if at is not None:
                    push(agenda, (at, h, symbols[h], joined))
        return [i for symbol in symbols if symbol for i in self._ids(symbol)]

    def _known(self, chunks: list[list[str]]) -> None:
        """Bring the chunks of a batch into the cache; what the batch uses outlives a full one."""
        wanted = {c for found in chunks for c in found}
        new = [c for c in wanted if c not in self.chunks]
        if len(self.chunks) + len(new) > CACHE_CHUNKS or self.held + sum(map(len, new)) > CACHE_CHARS:
            self.chunks = {c: self.chunks[c] for c in wanted if c in self.chunks}
            self.held = sum(map(len, self.chunks))
        by_length: dict[int, list[str]] = defaultdict(list)
        for chunk in new:
            if len(chunk) <= ROW_SYMBOLS and self.lettered(chunk):
                by_length[len(chunk)].append(chunk)
            else:
                self.chunks[chunk] = array("I", self.merge(chunk)).tobytes()
        for found in by_length.values():
            self.chunks.update(zip(found, self.merge_rows(found)))
        self.held += sum(map(len, new))
        for start in range(0, len(new), 4096):
            self._check(new[start : start + 4096])

    def _check(self, chunks: list[str]) -> None:
        """Hold the chunks' ids against the library's of one text of them all."""
        text = self.border + "".join(c + self.border for c in chunks).replace(SPACE, " ")
        wanted = self.library.normalize(text)
        if wanted.replace(SPACE, " ").strip(" ") != text.strip(" "):
            raise ValueError("the vocabulary's normaliser changes normalised text again")
        border = array("I", self._ids(self.border)).tobytes()
        start = array("I", self.merge(wanted[: wanted.index(self.border)])).tobytes()
        got = start + border + b"".join([self.chunks[c] + border for c in chunks])
        if array("I", self.library.encode(text)).tobytes() != got:
            wrong = next((c for c in chunks if self.library.encode(self.border + c.replace(SPACE, " "))[-len(self.chunks[c]) // 4 :] != list(array("I", self.chunks[c]))), chunks[0])
            raise AssertionError(f"the agenda and the sentencepiece library differ on {wrong!r}")

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        chunks = [self.cut(self.library.normalize(text)) if text else [] for text in texts]
        self._known(chunks)
        get = self.chunks.__getitem__
        out = [b"".join(map(get, found)) for found in chunks]
        return out if self.id_of_byte else [self._fused(ids) for ids in out]

    def _fused(self, ids: bytes) -> bytes:
        """Without byte pieces, unknown characters side by side are one piece, across chunks too."""
        found = np.frombuffer(ids, dtype="<u4")
        again = (found[1:] == self.unknown) & (found[:-1] == self.unknown)
        return found[np.concatenate([[True], ~again])[: len(found)]].tobytes()

    def decode(self, ids: list[int]) -> str:
        """Pieces joined, spaces for their marks, the dummy prefix off; bytes outside UTF-8 become U+FFFD each."""
        if self.prefixed and ids:
            first = next((k for k, i in enumerate(ids) if i not in self.special), None)
            if first is not None and self.strings[ids[first]].startswith(SPACE) and not any(self.said[i] for i in ids[:first]):
                lead = self.said[ids[first]][1:]
                ids = ids[first + 1 :]
            else:
                lead = b""
        else:
            lead = b""
        if self.special.isdisjoint(ids):
            return _as_text(lead + b"".join(map(self.said.__getitem__, ids)))
        # A special piece ends a run of bytes.
        runs = [[lead]]
        for i in ids:
            if i in self.special:
                runs += [[self.said[i]], []]
            else:
                runs[-1].append(self.said[i])
        return "".join(_as_text(b"".join(run)) for run in runs)


def _as_text(said: bytes) -> str:
    try:
        return said.decode()
    except UnicodeDecodeError:
        return _each_replaced(said)


def _each_replaced(said: bytes) -> str:
    out, at = [], 0
    while at < len(said):
        try:
            out.append(said[at:].decode())
            break
        except UnicodeDecodeError as broken:
            out.append(said[at : at + broken.start].decode())
            out.append("�" * (broken.end - broken.start))
            at += broken.end
    return "".join(out)


_PIECES: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def _texts(batch: pa.RecordBatch) -> list[str]:
    return batch.column("t").fill_null("").to_pylist()


def encoded(df: DataFrame, key: str, path: str, text: str = "text") -> DataFrame:
    """Rows (``key``, ids array<int>): each whole text's ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces(path)
        for part in slices(batches, most=SLICE_BYTES):
            found = known.encode(_texts(part))
            flat = np.frombuffer(b"".join(found), dtype="<u4").astype(np.int32)
            ends = np.cumsum([0, *(len(x) // 4 for x in found)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([part.column("k"), ids], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decoded(ids: Column, path: str) -> Column:
    """The text that an array of ids decodes to; null ids are null."""

    @F.udf("string", useArrow=True)
    def said(row):
        return None if row is None else pieces(path).decode([int(i) for i in row])

    return said(ids)


def digest(df: DataFrame, key: str, path: str, text: str = "text") -> DataFrame:
    """One row per text: ``key``, n_tokens, ids_sha256 and decoded_sha256; the decoded text comes from the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces(path)
        for part in slices(batches, most=SLICE_BYTES):
            counts, hashes, saids = [], [], []
            for data in known.encode(_texts(part)):
                ids = np.frombuffer(data, dtype="<u4").tolist()
                said = known.decode(ids)
                counts.append(len(ids))
                hashes.append(hashlib.sha256(",".join(map(known.decimal.__getitem__, ids)).encode()).hexdigest())
                saids.append(hashlib.sha256(said.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [part.column("k"), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(saids, pa.string())],
                names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(
        run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
