"""Byte-level BPE encoding and decoding by prefix-sharing trie traversal.

A text is cut into words by the tokenizer's pattern; distinct words that a worker hasn't
met are put into a trie. In a valid encoding every two neighbours are compatible: merging
their joined bytes gives these two tokens again; and an encoding whose neighbours are all
compatible is the encoding. So the encoding of each prefix is that of a shorter prefix
plus one last token, and there is just one such token. A depth-first walk of the trie
carries the last token of every prefix of the path and finds that of the next node among
the tokens that end there; prefixes that words share are worked out once. A word's ids
are read off by following last tokens back from its end.

Defined cases: null text is empty and has no ids; a special token's string inside a text
is that token, as the library has it; lone surrogates can't occur in Spark strings;
repeated rows give repeated rows; an empty table gives no rows; columns other than the
two named are ignored. An endless word is one path of the trie and isn't kept, so it
costs its own length only.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

#: The pattern that this kind of vocabulary splits texts by (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Stands for the token before the first one.
START = 1 << 19
#: The rank of a merge that doesn't happen.
NEVER = 1 << 60
#: Marks that are words of their own after letters.
_MARKS = frozenset(".,;:!?")
CACHE_UNITS = 900_000
ROWS = 1024


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files, by the public rule: printable
    Latin-1 stands for itself, the other bytes for code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def forget(kept: dict[str, bytes], share: float = 0.4) -> dict[str, bytes]:
    """What stays of a full cache: at most that share of it, the shortest words, which come back most often."""
    most, length = share * len(kept), 0
    sizes = Counter(map(len, kept))
    while sizes and (most := most - sizes.pop(length, 0)) >= 0:
        length += 1
    return {k: v for k, v in kept.items() if len(k) < length}


class TrieBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str, cache_units: int = CACHE_UNITS):
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        symbols = byte_symbols()
        raw = lambda token: bytes(symbols[c] for c in token)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {raw(token): i for token, i in vocab.items() if token not in self.special}
        self.pieces = {i: b for b, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.ranks = {(raw(a), raw(b)): k for k, (a, b) in enumerate(pairs)}
        self.pair_ranks = {self.ids[a] << 20 | self.ids[b]: k for (a, b), k in self.ranks.items()}
        # how a token is made: rank and parts; of several ways the first
        self.made: dict[int, tuple[int, tuple[int, int]]] = {}
        for (a, b), k in self.ranks.items():
            self.made.setdefault(self.ids[a + b], (k, (self.ids[a], self.ids[b])))
        self.spines: tuple[dict, dict] = ({}, {})
        self.whole: dict[int, bool] = {}
        self.sizes = {i: len(b) for i, b in self.pieces.items()}
        self.codes = {i: i.to_bytes(4, "little") for i in self.pieces}
        self._automaton()
        self.pattern = regex.compile(PATTERN)
        self.special_pattern = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.fits: dict[int, bool] = {}
        self.steps: dict[int, int] = {}
        self.cache_units = cache_units
        self.kept: dict[str, bytes] = {}

    def merge(self, data: bytes) -> list[bytes]:
        """Plain merging, lowest rank first; used on two tokens' bytes only."""
        parts = [data[k : k + 1] for k in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda k: self.ranks.get((parts[k], parts[k + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _automaton(self) -> None:
        """Which tokens end at a byte: states for all beginnings of tokens, with fall-backs to shorter ones."""
        self.go: dict[int, int] = {}
        self.fail, own = [0], [None]
        for data, token in self.ids.items():
            state = 0
            for byte in data:
                after = self.go.get(state << 8 | byte)
                if after is None:
                    after = self.go[state << 8 | byte] = len(own)
                    own.append(None)
                    self.fail.append(0)
                state = after
            own[state] = (len(data), token)
        below: list[list[tuple[int, int]]] = [[] for _ in own]
        for key, after in self.go.items():
            below[key >> 8].append((key & 255, after))
        self.ending: list[tuple] = [()] * len(own)
        row = [0]
        for state in row:
            shorter = self.ending[self.fail[state]] if state else ()
            self.ending[state] = ((own[state],) if own[state] else ()) + shorter
            for byte, after in below[state]:
                self.fail[after] = self.step(self.fail[state], byte) if state else 0
                row.append(after)

    def spine(self, token: int, side: int) -> tuple[tuple[int, int], ...]:
        """The parts at a token's first (side 0) or last (side 1) byte while it is merged, from the byte on,
        each with the rank of the merge that ends it."""
        known = self.spines[side].get(token)
        if known is None:
            parts, rank = [], NEVER
            while token is not None:  # a part ends when the one it is a part of is made
                parts.append((token, rank))
                rank, parents = self.made.get(token, (NEVER, (None, None)))
                token = parents[side]
            known = tuple(reversed(parts))
            self.spines[side][parts[0][0]] = known
        return known

    def is_whole(self, token: int) -> bool:
        """Whether a token's bytes merge into it."""
        known = self.whole.get(token)
        if known is None:
            known = self.whole[token] = self.merge(self.pieces[token]) == [self.pieces[token]]
        return known

    def compatible(self, left: int, right: int) -> bool:
        """Whether two tokens may stand side by side; START on the left: whether one may stand first.

        Both are merged from their bytes; the border between them holds if no two parts that
        ever face each other across it could merge before one of them is merged on its own
        side. Of merges of one rank the leftmost comes first.
        """
        if len(self.fits) > 2_000_000:
            self.fits.clear()
        known = self.is_whole(right) and (left == START or (self.is_whole(left) and self._border_holds(left, right)))
        self.fits[left << 20 | right] = known
        return known

    def _border_holds(self, left: int, right: int) -> bool:
        ends, begins, pairs = self.spine(left, 1), self.spine(right, 0), self.pair_ranks
        i = j = 0
        while True:
            (a, a_ends), (b, b_ends) = ends[i], begins[j]
            rank = pairs.get(a << 20 | b, NEVER)
            if rank < a_ends and rank <= b_ends and rank < NEVER:
                return False
            if a_ends == b_ends == NEVER:
                return True
            if a_ends <= b_ends:
                i += 1
            else:
                j += 1

    def step(self, state: int, byte: int) -> int:
        """The longest token prefix that ends here, as a state of the automaton over all tokens."""
        go, fail = self.go, self.fail
        while (after := go.get(state << 8 | byte)) is None and state:
            state = fail[state]
        return after or 0

    def read_off(self, end: int, last: list[int]) -> bytes:
        out, sizes, codes = [], self.sizes, self.codes
        while end:
            token = last[end]
            out.append(codes[token])
            end -= sizes[token]
        out.reverse()
        return b"".join(out)

    def encode_words(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Ids of distinct words, by one depth-first walk of their trie.

        The trie is the sorted list of the words: a node is a prefix, its words stand
        together, and sorted order is depth-first order. What the path to the next word
        shares with the one before keeps its states and last tokens.
        """
        out: dict[bytes, bytes] = {}
        last, states, path = [START], [0], b""
        steps, fits, ending = self.steps, self.fits, self.ending
        for word in sorted(words):
            depth = 0
            for x, y in zip(path, word):
                if x != y:
                    break
                depth += 1
            del last[depth + 1 :], states[depth + 1 :]
            path, state = word, states[depth]
            for byte in word[depth:]:
                depth += 1
                after = steps.get(state << 8 | byte)
                if after is None:
                    after = steps[state << 8 | byte] = self.step(state, byte)
                state = after
                # the last token of this prefix is the one that is compatible with what stands before it
                for size, token in ending[state]:
                    before = last[depth - size]
                    known = fits.get(before << 20 | token)
                    if known is None:
                        known = self.compatible(before, token)
                    if known:
                        break
                else:
                    raise ValueError("no token ends a prefix; the vocabulary lacks single bytes")
                last.append(token)
                states.append(state)
            out[word] = self.read_off(depth, last)
        if len(steps) > 2_000_000:
            steps.clear()
        return out

    def words_of(self, unit: str) -> list[str]:
        """The words of a unit; letters alone, or with one mark after them, need no pattern."""
        body = unit[1:] if unit[:1] == " " else unit
        if body.isalpha():
            return [unit]
        if body[-1:] in _MARKS and body[:-1].isalpha():
            return [unit[:-1], unit[-1]]
        return self.pattern.findall(unit)

    def encode_units(self, units: set[str]) -> dict[str, bytes]:
        """Units are whole numbers of words; words met before aren't put into the trie again."""
        kept = self.kept
        words = {u: self.words_of(u) for u in units}
        fresh = {w for ws in words.values() for w in ws if w not in kept}
        ids = self.encode_words({w.encode("utf-8") for w in fresh})
        known = {w: ids[w.encode("utf-8")] for w in fresh}
        for u, ws in words.items():
            if len(ws) != 1:
                known[u] = b"".join([known[w] if w in known else kept[w] for w in ws])
        return known

    #: Between two characters that aren't white space, a word begins at a single space.
    _BORDER = re.compile(r"(?<=\S)(?= \S)")
    _ODD = re.compile(r" \s|\s |^\s|\s$")

    def units(self, text: str) -> list[str]:
        if self._ODD.search(text):
            return self._BORDER.split(text)
        first, *rest = text.split(" ")
        return [first, *[" " + r for r in rest]]

    def encode(self, text: str | None, units: list[str] | None = None) -> list[int]:
        """The ids of a whole text; units: as warm() has split it."""
        return np.frombuffer(self.encode_bytes(text, units), "<u4").tolist()

    def encode_bytes(self, text: str | None, units: list[str] | None = None) -> bytes:
        """The same as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if units is not None:
            return self._encode_units(units)
        if self.special_pattern and self.special_pattern.search(text):
            out, at = [], 0
            for m in self.special_pattern.finditer(text):
                out += [self._encode(text[at : m.start()]), self.codes[self.special[m[0]]]]
                at = m.end()
            return b"".join([*out, self._encode(text[at:])])
        return self._encode(text)

    def _encode(self, text: str) -> bytes:
        return self._encode_units(self.units(text)) if text else b""

    def _encode_units(self, units: list[str]) -> bytes:
        kept = self.kept
        try:  # after warm() all are there, but for long words
            return b"".join(map(kept.__getitem__, units))
        except KeyError:
            pass
        missing = {u for u in set(units) if u not in kept}
        if missing:
            if len(kept) + len(missing) > self.cache_units:
                self.kept = kept = forget(kept)
                missing = {u for u in set(units) if u not in kept}
            # long texts are done in parts, which bounds the trie
            ordered, extra = list(missing), {}
            for at in range(0, len(ordered), 20_000):
                extra |= self.encode_units(set(ordered[at : at + 20_000]))
            kept.update((u, t) for u, t in extra.items() if len(u) <= 64 and len(kept) < self.cache_units)
            return b"".join([extra[u] if u in extra else kept[u] for u in units])
        return b"".join(map(kept.__getitem__, units))

    def warm(self, texts: list[str | None]) -> list[list[str] | None]:
        """Put the words of several texts into one trie before they are encoded one by one; the
        texts' units, None where special tokens or nothing is in them."""
        plain = lambda text: text and not (self.special_pattern and self.special_pattern.search(text))
        split = [self.units(text) if plain(text) else None for text in texts]
        fresh = {u for u in set().union(*filter(None, split)).difference(self.kept) if len(u) <= 64}
        if len(self.kept) + len(fresh) > self.cache_units:
            self.kept = forget(self.kept)
        if len(fresh) <= self.cache_units // 2:
            self.kept.update(self.encode_units(fresh))
        return split

    def decode(self, ids: list[int]) -> bytes:
        """The UTF-8 bytes of ids; where tokens cut a character in two, replacement characters, as the library has it."""
        data = b"".join(map(self.pieces.__getitem__, ids))
        try:
            data.decode("utf-8")
        except UnicodeDecodeError:
            return data.decode("utf-8", "replace").encode("utf-8")
        return data


@lru_cache(2)
def trie_bpe(path: str) -> TrieBpe:
    """One for each worker process, kept between tasks."""
    return TrieBpe(path)


def encode_docs(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded): a row for each row of docs."""
    ship(docs.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = trie_bpe(tokenizer)
        for part, ids in _encoded(batches, bpe):
            decoded = [bpe.decode(x).decode("utf-8") for x in ids]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(of, "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): as encode_docs, with digests taken where ids are made."""
    ship(docs.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = trie_bpe(tokenizer)
        decimal = {i: str(i) for i in bpe.pieces}
        for part, ids in _encoded(batches, bpe):
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(map(len, ids), pa.int64()),
                    pa.array([hashlib.sha256(",".join(map(decimal.__getitem__, x)).encode()).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(of, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _encoded(batches: Iterator[pa.RecordBatch], bpe: TrieBpe) -> Iterator[tuple[pa.RecordBatch, list[list[int]]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            texts = part.column(1).to_pylist()
            yield part, [bpe.encode(t, u) for t, u in zip(texts, bpe.warm(texts))]
