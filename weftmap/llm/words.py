"""Whole texts to token ids, the distinct words of a stretch of texts at a time.

For a tokenizer that drops white space and never looks across it, a text's ids are those of
its parts between ASCII white space, one after the other. The parts of some megabytes of
texts are made distinct by Arrow, each distinct part is encoded once, and ids are put
together by one gather. Nothing is kept between stretches, so memory doesn't grow.

Most parts hold only ASCII and letters whose lower case is one letter, so lower-casing and
the tokenizer's split are plain string work. Merging is then done by a byte-level encoder
that joins neighbours whose bytes together are a token, the lowest token first. This is the
tokenizer's own merging: merging a token's bytes passes through one state of two parts
only, so neighbours that make up a token are always the pair its rule names. Tokens whose
own bytes don't merge into them never come about and are left out; ``mergeable`` checks
each one. All other parts go through the tokenizer itself.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .bpe import byte_symbols
from .common import kept

#: Bytes of text that are worked on at once; a longer text is a stretch of its own.
STRETCH_BYTES = 2 << 20
#: Longer parts go through the tokenizer, whose merging isn't quadratic.
LONGEST = 256
#: Stands for the end of a word in the byte-level encoder.
WORD_END = "\x01"
#: Letters whose lower case is one letter and which no composition changes.
LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ſ"
#: How the one kind of tokenizer known here prepares and splits texts (fixed values).
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@lru_cache(4)
def load(path: str, special_as_text: bool = False):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = special_as_text
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def mergeable(path: str) -> dict[bytes, int] | None:
    """Each token's bytes, with WORD_END where it ends a word, and its id; None if the tokenizer isn't of the known kind."""
    from tokenizers import models

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, split = spec["model"], (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    suffix = model.get("end_of_word_suffix")
    if not suffix or (spec.get("normalizer") or {}).get("normalizers") != NORMALIZER or split[0].get("pattern") != {"Regex": SPLIT}:
        return None
    symbols, vocab = byte_symbols(), model["vocab"]
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    if any(vocab.get(a + b) != 2 * len(symbols) + k for k, (a, b) in enumerate(pairs)):
        return None
    if not all(s in vocab and s + suffix in vocab and vocab[s] < 2 * len(symbols) > vocab[s + suffix] for s in symbols):
        return None
    end = WORD_END.encode()
    inside, whole = models.BPE(vocab, pairs), load(path).model  # the first merges without marking the end of a word
    raw = lambda token: bytes(symbols[c] for c in token)
    found = {}
    for token, i in vocab.items():
        stem = token.removesuffix(suffix) if token.endswith(suffix) and token != suffix else token
        if len((inside if stem == token else whole).tokenize(stem)) == 1:
            found[raw(stem) + (b"" if stem == token else end)] = i
    return found


def stretches(texts: pa.Array, most: int = STRETCH_BYTES) -> Iterator[pa.Array]:
    """texts in slices of about that many bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield texts.slice(at, to - at)
        at = to


def in_lines(parts: pa.Array, places: np.ndarray, border: str) -> str:
    """The parts at places in lower case, border after each."""
    if not len(places):
        return ""
    some = parts.take(pa.array(places))
    lines = pa.LargeListArray.from_arrays(pa.array([0, len(some)], pa.int64()), some.cast(pa.large_string()))
    return pc.binary_join(lines, pa.scalar(border, pa.large_string()))[0].as_py().lower() + border


class WordEncoder:
    """Encodes texts by a tokenizer whose words end at white space."""

    def __init__(self, path: str, special_as_text: bool = False, stretch_bytes: int = STRETCH_BYTES, ranks: dict[bytes, int] | None = None):
        """ranks: what mergeable(path) gives, where that is known already; it takes more memory to make than to hold."""
        self.path, self.special_as_text, self.stretch_bytes = path, special_as_text, stretch_bytes
        self.plain = None
        ranks = mergeable(path) if ranks is None else ranks
        if ranks:
            import tiktoken

            self.plain = tiktoken.Encoding("words", pat_str=rf"\n|[^\n{WORD_END}]+{WORD_END}", mergeable_ranks=ranks, special_tokens={})
            self.border = ranks[b"\n"]
            self.odd = rf"[^\x21-\x7E{LETTERS}]|<\|"
            self.words = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\n0-9{LETTERS}]+")

    @property
    def tokenizer(self):
        """Loaded when the first part needs it."""
        return load(self.path, self.special_as_text)

    def _plain_ids(self, marked: str) -> list[np.ndarray]:
        """Ids of lines, and their bounds, the words of which end in WORD_END."""
        ids = self.plain.encode_to_numpy(marked, disallowed_special=())
        borders = np.flatnonzero(ids == self.border)
        ends = borders - np.arange(len(borders))
        return np.delete(ids, borders), np.concatenate(([0], ends))

    def _by_tokenizer(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not parts:
            return np.empty(0, np.uint32), np.zeros(1, np.int64)
        found = [e.ids for at in range(0, len(parts), 4096) for e in self.tokenizer.encode_batch_fast(parts[at : at + 4096], add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], np.uint32), np.concatenate(([0], np.cumsum(list(map(len, found)), dtype=np.int64)))

    def distinct_ids(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begin, length): where in ids each of the parts, without white space, has its own."""
        if self.plain is None:
            groups = [(np.arange(len(parts)), self._by_tokenizer(parts.to_pylist()))]
        else:
            odd = pc.or_(pc.match_substring_regex(parts, self.odd), pc.greater(pc.binary_length(parts), LONGEST))
            one_word = pc.and_not(pc.match_substring_regex(parts, rf"^[{LETTERS}]+$"), odd)
            kinds = np.where(odd.to_numpy(zero_copy_only=False), 2, np.where(one_word.to_numpy(zero_copy_only=False), 0, 1))
            places = [np.flatnonzero(kinds == k) for k in range(3)]
            marked = [in_lines(parts, places[0], WORD_END + "\n"), self.words.sub(rf"\g<0>{WORD_END}", in_lines(parts, places[1], "\n"))]
            groups = [(places[k], self._plain_ids(marked[k])) for k in range(2)]
            groups.append((places[2], self._by_tokenizer(parts.take(pa.array(places[2])).to_pylist())))
        begin, length, base = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64), 0
        for place, (ids, bounds) in groups:
            begin[place], length[place] = bounds[:-1] + base, np.diff(bounds)
            base += len(ids)
        return np.concatenate([ids for _, (ids, _) in groups]), begin, length

    def encode_stretch(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): the ids of each text are ids[bounds[k]:bounds[k + 1]]; end_id is put after each."""
        parts = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        offsets = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        coded = parts.flatten().dictionary_encode()
        ids, begin, length = self.distinct_ids(coded.dictionary)
        which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        if end_id is not None:  # one more part, at the end of each text
            ids, begin, length = np.append(ids, np.uint32(end_id)), np.append(begin, len(ids)), np.append(length, 1)
            which = np.insert(which, offsets[1:], len(begin) - 1)
            offsets = offsets + np.arange(len(offsets))
        sizes = length[which]
        stops = np.concatenate(([0], np.cumsum(sizes)))
        places = np.arange(stops[-1]) + np.repeat(begin[which] - stops[:-1], sizes)
        return ids[places].astype("<u4"), stops[offsets]

    def encode_texts(self, texts: pa.Array, end_id: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each stretch of texts the place of its first one, and encode_stretch's ids and bounds."""
        at = 0
        for some in stretches(texts, self.stretch_bytes):
            yield at, *self.encode_stretch(some, end_id)
            at += len(some)

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of whole texts as little-endian unsigned 32-bit integers."""
        return [ids[a:b].tobytes() for _, ids, bounds in self.encode_texts(pa.array(texts, pa.string())) for a, b in zip(bounds[:-1], bounds[1:])]

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]


def word_encoder(path: str, special_as_text: bool = False, ranks: dict[bytes, int] | None = None) -> WordEncoder:
    """One for each worker process, kept between tasks."""
    return kept(("words", path, special_as_text), lambda: WordEncoder(path, special_as_text, ranks=ranks))
