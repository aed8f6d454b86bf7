"""Language identification by prediction by partial matching (PPM).

For each language a variable-order byte context tree (contexts of up to 3 bytes) holds how
often each byte followed. A byte costs ``-log2`` of its probability in the longest known
context; a byte not seen there first costs an escape (method C: distinct bytes / (count +
distinct bytes)) and goes on in the next shorter context, without the bytes already ruled
out (exclusion); below the empty context all 256 bytes left over are equally likely. The
statistics are frozen, so the code length of a text is the exact sum of table entries: its
contexts are turned into states of the joint trees and looked up for all bytes at once.
The language with the shortest code wins; score is its posterior under equal priors.

Learning uses a bounded sample: about ``sample_docs`` labelled documents or ``sample_bytes``
of their texts a language, whichever is less, chosen by a hash of id and text, so the same
in every run; rows held out are never learnt from. The sample bounds the statistics: every
context met in it is kept. Prediction covers every row and whole text.

Defined cases: null texts and texts without a letter are ``und`` with score 0, so are all
texts if nothing can be learnt; ties go to the first language by name; rows with a null
doc_id are predicted, but neither learnt from nor held out; repeated rows give repeated
rows; an empty table gives no rows; columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, release, ship

UND = "und"
ORDER = 3
#: Bytes before the first one of a text.
PAD = b"\n" * ORDER
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; the rows at 0 are held out."""
    return F.crc32(doc_id.cast("string")) % 5


def to_bytes(text: str) -> bytes:
    return PAD + text.encode("utf-8").translate(_LOWER)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def gram_codes(data: np.ndarray) -> np.ndarray:
    """Each byte after the padding with its context, as one number: 3 context bytes, then the byte."""
    x = data.astype(np.uint32)
    return x[:-3] << 24 | x[1:-2] << 16 | x[2:-1] << 8 | x[3:]


@dataclass(frozen=True)
class Counts:
    """Frozen statistics: how often each gram occurred in each language."""

    languages: tuple[str, ...]
    language: np.ndarray
    gram: np.ndarray
    n: np.ndarray


class Model:
    """Cost of each byte in each state of the joint trees, for each language.

    A state is a context that some language has. A language has a row of costs for each
    context of its own; in a state that it lacks its row is that of the longest shorter
    context it has, which is what escaping comes to. So the tables grow with what each
    language was learnt from, and nothing is cut.
    """

    def __init__(self, counts: Counts):
        self.languages = counts.languages
        if not self.languages:
            return
        # the padding stands in contexts alone
        used = np.unique(np.append(counts.gram & 255, np.frombuffer(PAD, np.uint8)))
        self.symbol = np.full(256, len(used), np.int64)  # the last one: bytes never met
        self.symbol[used] = np.arange(len(used))
        self.width = a = len(used) + 1
        parts = [self.symbol[counts.gram >> s & 255] for s in (24, 16, 8, 0)]
        # contexts of 0 to 3 bytes as numbers: order, then its bytes in base a, the nearest one last
        context = [np.zeros(len(counts.gram), np.int64)]
        for order in range(1, ORDER + 1):
            code = np.zeros(len(counts.gram), np.int64)
            for p in parts[ORDER - order : ORDER]:
                code = code * a + p
            context.append(code)
        known = [np.unique(c) for c in context]
        bases = np.concatenate(([0], np.cumsum([len(c) for c in known])))
        state_of = np.zeros(1, np.int32)  # for each context of an order its state, or that of the next shorter one
        shorter = []  # for each order, the states of its contexts' next shorter ones
        for order in range(1, ORDER + 1):
            shorter.append(state_of[known[order] % a ** (order - 1)])
            state_of = np.tile(state_of, a)
            state_of[known[order]] = bases[order] + np.arange(len(known[order]))
        self.state_of = state_of
        self.row_of, self.cost = [], []  # for each language: row of each state, costs of each row and symbol
        for lang in range(len(self.languages)):
            mine = counts.language == lang
            own = [np.unique(c[mine]) for c in context]
            row_of, base = np.zeros(bases[-1], np.int32), len(own[0])
            for order in range(1, ORDER + 1):
                here = row_of[bases[order] : bases[order + 1]]
                here[:] = row_of[shorter[order - 1]]
                here[np.searchsorted(known[order], own[order])] = base + np.arange(len(own[order]))
                base += len(own[order])
            self.row_of.append(row_of)
            self.cost.append(self._costs(own, [c[mine] for c in context], parts[ORDER][mine], counts.n[mine]).reshape(-1))

    def _costs(self, own: list[np.ndarray], context: list[np.ndarray], symbol: np.ndarray, n: np.ndarray, stretch: int = 4096) -> np.ndarray:
        """Costs of a language's contexts (own, sorted, by order) and all symbols, from its grams."""
        a = self.width
        out = np.empty((sum(map(len, own)), a), np.float32)
        seen: list[np.ndarray] = []  # counts of the contexts of each lower order
        at = 0
        for order in range(ORDER + 1):
            place = np.searchsorted(own[order], context[order])
            by_place = np.argsort(place, kind="stable")
            bounds = np.searchsorted(place[by_place], np.arange(0, len(own[order]) + stretch, stretch))
            kept = np.empty((len(own[order]), a), np.float32) if order < ORDER else None
            for k, begin in enumerate(range(0, len(own[order]), stretch)):
                codes, some = own[order][begin : begin + stretch], by_place[bounds[k] : bounds[k + 1]]
                counts = np.bincount((place[some] - begin) * a + symbol[some], n[some], len(codes) * a).reshape(-1, a)
                if kept is not None:
                    kept[begin : begin + len(codes)] = counts
                shorter = [seen[d][np.searchsorted(own[d], codes % a**d)] for d in range(order - 1, -1, -1)]
                out[at : at + len(codes)] = self._escapes([counts, *shorter])
                at += len(codes)
            if kept is not None:
                seen.append(kept)
        return out

    def _escapes(self, counts: list[np.ndarray]) -> np.ndarray:
        """Costs from the counts of some contexts and those of their shorter ones, the longest first."""
        cost = np.zeros(counts[0].shape)
        open_ = np.ones(cost.shape, bool)
        spent = np.zeros(len(cost))
        for found in counts:
            found = np.where(open_, found, 0.0)
            hit = found > 0
            distinct = hit.sum(1)
            total = found.sum(1) + distinct
            with np.errstate(divide="ignore", invalid="ignore"):
                cost = np.where(hit, spent[:, None] - np.log2(found / total[:, None]), cost)
                spent = spent + np.where(distinct > 0, -np.log2(distinct / np.maximum(total, 1)), 0.0)
            open_ &= ~hit
        left = open_[:, :-1].sum(1) + (256 - (self.width - 1))
        return np.where(open_, (spent + np.log2(np.maximum(left, 1)))[:, None], cost)

    def bits(self, texts: list[str]) -> np.ndarray:
        """Code length of each text in each language, in bits."""
        out = np.zeros((len(texts), len(self.languages)))
        batch: list[tuple[int, bytes]] = []
        size = 0
        for k, text in enumerate(texts):
            data = to_bytes(text)
            for at in range(0, max(1, len(data) - ORDER), 1 << 20):  # long texts in stretches, each with its context
                batch.append((k, data[at : at + (1 << 20) + ORDER]))
                size += len(batch[-1][1])
                if size > 1 << 20:
                    self._add(out, batch)
                    batch, size = [], 0
        self._add(out, batch)
        return out

    def _add(self, out: np.ndarray, batch: list[tuple[int, bytes]]) -> None:
        batch = [(k, d) for k, d in batch if len(d) > ORDER]
        if not batch:
            return
        s = self.symbol[np.frombuffer(b"".join(d for _, d in batch), np.uint8)]
        a = self.width
        state = self.state_of[(s[:-3] * a + s[1:-2]) * a + s[2:-1]]
        # a text's bytes begin after its padding; what overlaps the next padding isn't counted
        sizes = np.array([len(d) for _, d in batch])
        begin = np.cumsum(sizes) - sizes
        texts = np.array([k for k, _ in batch])
        for lang, (row_of, cost) in enumerate(zip(self.row_of, self.cost)):
            sums = np.concatenate(([0.0], np.cumsum(cost[row_of[state].astype(np.int64) * a + s[3:]], dtype=np.float64)))
            np.add.at(out[:, lang], texts, sums[begin + sizes - ORDER] - sums[begin])

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        ok = [k for k, t in enumerate(texts) if self.languages and has_letter(t)]
        names, scores = [UND] * len(texts), [0.0] * len(texts)
        if ok:
            bits = self.bits([texts[k] for k in ok])
            best = bits.argmin(1)
            share = 1 / np.exp2(np.maximum(bits.min(1)[:, None] - bits, -1000)).sum(1)
            for k, b, p in zip(ok, best, share):
                names[k], scores[k] = self.languages[b], float(p)
        return names, scores


def learn(docs: DataFrame, sample_docs: int = 4000, sample_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Counts:
    """Statistics of a bounded sample of the labelled rows that aren't held out."""
    ship(docs.sparkSession)
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where((fold(F.col("id")) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("text").cast("long")).alias("size"))
    totals = {r["lang"]: (r["rows"], r["size"]) for r in sizes.collect()}  # one row a language
    languages = tuple(sorted(totals))
    if not languages:
        return Counts((), np.empty(0, np.int64), np.empty(0, np.uint32), np.empty(0, np.float64))
    number = {x: k for k, x in enumerate(languages)}
    million = 1_000_000
    part = lambda rows, size: min(million, int(million * min(sample_docs / rows, sample_bytes / max(size, 1))) + 1)
    share = F.create_map(*[v for x in languages for v in (F.lit(x), F.lit(part(*totals[x])))])
    sample = labelled.where(F.pmod(F.xxhash64("id", "text"), F.lit(million)) < share[F.col("lang")]).select("lang", "text")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_language: dict[int, list[np.ndarray]] = {}
            for lang, text in zip(batch.column(0), batch.column(1)):
                by_language.setdefault(number[lang.as_py()], []).append(gram_codes(np.frombuffer(to_bytes(text.as_py()), np.uint8)))
            for lang, found in by_language.items():
                gram, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), lang, np.int32)), pa.array(gram.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    counted = sample.mapInArrow(grams, "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    order = np.lexsort((counted["gram"].to_numpy(), counted["lang"].to_numpy()))
    return Counts(languages, counted["lang"].to_numpy()[order].astype(np.int64), counted["gram"].to_numpy()[order].astype(np.uint32), counted["n"].to_numpy()[order].astype(np.float64))


def _model(counts: Counts) -> Model:
    """The tables for counts, kept by a worker process between tasks."""
    key = hash((counts.languages, counts.language.tobytes(), counts.gram.tobytes(), counts.n.tobytes()))
    return kept(("langid", key), lambda: Model(counts))


def predictor(docs: DataFrame, sample_docs: int = 4000, sample_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"):
    """A function of a text column giving struct<lang_pred, score>, learnt from docs."""
    return predictor_of(docs.sparkSession, learn(docs, sample_docs, sample_bytes, id_col, text_col, lang_col))


def predictor_of(spark: SparkSession, counts: Counts):
    """The function that predictor gives, of statistics already learnt."""
    shared = spark.sparkContext.broadcast(counts)  # bounded by the sample

    @F.arrow_udf("lang_pred string, score double")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = _model(shared.value)
        for batch in batches:
            names, scores = [], []
            for at in range(0, len(batch), 256):
                n, s = model.predict(batch.slice(at, 256).to_pylist())
                names += n
                scores += s
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])
        release()

    return predict


def lettered(text: Column) -> Column:
    """Whether a text has a letter; null has none."""

    @F.arrow_udf("boolean")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([has_letter(text.as_py()) for text in batch], pa.bool_())

    return of(text)


def identify(docs: DataFrame, sample_docs: int = 4000, sample_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score): a row for each row of docs."""
    predict = predictor(docs, sample_docs, sample_bytes, id_col, text_col, lang_col)
    found = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(fold(F.col(id_col)) == 0, F.lit(False)).alias("held_out"), predict(F.col(text_col)).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")
