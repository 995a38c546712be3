"""Subject areas of documents, by latent Dirichlet topics.

Topics are fitted by variational expectation-maximisation over all documents, without
any guidance: each task updates its documents' topic proportions and sends back the
expected counts of terms by topic, which Spark sums; rounds go on until the topics stand
still.  Terms are weighted by the logarithm of how rare they are, so common words need
no list and no upper limit.  After the fit the top terms of each topic are looked up
among inspected ones, which give the topic a subject, or none.

A document's proportions are those of its sentences, each taken as a short document: its
topic proportions are inferred under the fitted topics and summed by subject, and the
sentence is about the subject that holds at least half of them.
"""

from __future__ import annotations

import re
import unicodedata
import warnings
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voxtide.session import drop_path, materialise

#: A term stands in at least so many documents and such a share of them.  The share bounds the model:
#: there are at most (mean of distinct words a document) / MIN_SHARE terms, however many documents.
MIN_DOCUMENTS = 5
MIN_SHARE = 0.0005
#: Topics for each subject; what is about nothing in particular takes some of them.
PER_SUBJECT = 6
INNER = 8
ALPHA, ETA = 0.1, 0.05
#: Rounds end when the topics' distributions move by less than this (mean of the absolute differences summed
#: over terms); a fit that still moves after MOST_ROUNDS is used, with a warning.
STILL, MOST_ROUNDS = 0.01, 100
#: Of a topic, so many top terms are looked up; a subject needs this share of their weight, and twice that of the next.
TOP, TOP_SHARE = 30, 0.02
#: Words that a task lays out at once.
WORDS = 400_000

# Words inspected among the top terms of fitted topics, by subject.
TERMS = {
    "science": "hypothesis telescope isotope centrifuge observatory orbit pendulum molecule vacuum chemistry physics theory thí nghiệm hóa ly thuyết tử đo sóng trắc quỹ thiên loãng",
    "law": "court judge magistrate's notary's deed witness oath testified affidavit appeal verdict inheritance tòa án luật kiện cáo xử thẩm chứng chấp khiếu nại thừa",
    "sport": "pitch penalty relay stadium lap match finals medal overtime coach hamstring goalkeeper chạy bơi vợt hiệp đội cú bóng cúp đền phạt hạng khán",
    "software": "server code database parser branch release terminal test login compiler bug renamed lỗi mã dịch máy thử nhánh dữ trỏ hàm phiên lưu trình",
    "medicine": "ward blood pharmacy clinic operation insulin dressing fever x-ray wrist dentist's pneumonia thuốc phổi mổ cứu sĩ tim băng khâu viêm máu vắc đau",
    "farming": "barn grain paddy greenhouse cattle silo field bales barley sheep weeds tractor ruộng thóc bò lúa rào chuồng trâu rơm cày gieo chấu lợn",
    "cooking": "dumplings caramel sauce dough stove pantry oven charcoal simmered garlic baked eggs bánh củ tỏi bún muỗng nồi vịt bếp nướng mắm tôm bột",
    "music": "drum choir melody harmony concert waltz flute verse overture organ guitar piano nhạc đàn hát nhịp điệu giai khúc ca sáo trống cầm xướng",
}

_MARKS = re.compile(r"<\|[^|]*\|>|\x15[^\x15]*\x15|\(\([^()]*\)\)|\([^()]*\)|\[[^\[\]]*\]|<[^<>]*>|\{[^{}]*\}|♪[^♪]*♪|\*[^*\s:][^*:\n]{0,40}\*|&[=-]\S+|\d\d:\d\d:\d\d(?:\.\d+)?(?:\s*-->\s*)?")
_HAS_MARK = re.compile(r"[<\x15(\[{♪*&]|:\d\d:")
_TIER = re.compile(r"^(?:@.*|[>\s-]+(?=\S)|\*[a-z]{3}:\s*)", re.M)
#: A word, or what ends a sentence; and a piece that stands for the end of a line.
_TOKEN = re.compile(r"[^\W\d_][\w'’-]*|[.!?…;]+$")
_ENDS, _LINE = ".!?…;", "\x00"


def filler_pattern(forms: Sequence[str]) -> re.Pattern | None:
    """The forms, any letter lengthened."""
    each = ["".join(re.escape(c) + "+" for c in unicodedata.normalize("NFC", f).casefold()) for f in forms if f and f.strip()]
    return re.compile("|".join(each)) if each else None


class Scanner:
    """Texts into numbers of words and ends of sentences, without marks of tools, tier labels, header lines and fillers.

    What punctuation behind a filler writes is a pause, no end.  Pieces between
    white space are parsed once and remembered.
    """

    def __init__(self, fillers: re.Pattern | None = None) -> None:
        self.fillers = fillers
        #: Of a piece, its word's number, 0 for a filler, -1 for an end, -2 for that of a line; several of these where it holds more.
        self.known: dict[str, int | tuple[int, ...]] = {_LINE: -2}

    def _parse(self, piece: str) -> int | tuple[int, ...]:
        if len(self.known) > 1_000_000:
            self.known = {_LINE: -2}
        parts = tuple(-1 if t[0] in _ENDS else 0 if self.fillers is not None and self.fillers.fullmatch(t) else word_hash(t) for t in _TOKEN.findall(piece))
        self.known[piece] = parts[0] if len(parts) == 1 else parts
        return self.known[piece]

    def scan(self, text: str | None, flat: list[int]) -> list[int]:
        """Append the numbers of the words of ``text`` to ``flat``; where, counted from the first of them, its sentences end."""
        if not text:
            return []
        t = unicodedata.normalize("NFC", text).casefold()
        if not t.isascii():
            t = unicodedata.normalize("NFC", t)
        t = _TIER.sub(" ", t)
        if _HAS_MARK.search(t):
            t = _MARKS.sub(" ", t)
        known, add = self.known.get, flat.append
        base = start = len(flat)
        ends: list[int] = []
        pause = False
        for piece in t.replace("\n", f" {_LINE} ").split():
            n = known(piece)
            if n.__class__ is int and n > 0:  # one word, as most pieces are
                add(n)
                pause = False
                continue
            if n is None:
                n = self._parse(piece)
                known = self.known.get
            for x in (n,) if n.__class__ is int else n:
                if x > 0:
                    add(x)
                    pause = False
                elif x == 0:
                    pause = True
                elif pause and x == -1:
                    pause = False
                elif len(flat) > start:
                    start = len(flat)
                    ends.append(start - base)
        if len(flat) > start:
            ends.append(len(flat) - base)
        return ends


def word_hash(w: str) -> int:
    """A word's number, from 1 to 2**32 - 1."""
    return zlib.crc32(w.encode()) or 1


def hashed(docs: DataFrame, key: str, text: str, fillers: re.Pattern | None) -> DataFrame:
    """(key, words, ends): the words of each document as numbers, and where each sentence ends."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(fillers)
        for b in batches:
            lo = 0
            while lo < b.num_rows:
                flat: list[int] = []
                ends: list[int] = []
                at, cut = [0], [0]
                while lo + len(at) - 1 < b.num_rows and len(flat) < WORDS:
                    ends.extend(scanner.scan(b.column(1)[lo + len(at) - 1].as_py(), flat))
                    at.append(len(flat))
                    cut.append(len(ends))
                words = pa.array(np.array(flat, np.uint32).view(np.int32))
                keys = b.column(0).slice(lo, len(at) - 1)
                yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(at, pa.int32()), words), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ends, pa.int32()))], names=["key", "words", "ends"])
                lo += len(at) - 1

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, words array<int>, ends array<int>")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about WORDS words, of one document at least."""
    for b in batches:
        total = np.cumsum(b.column("words").value_lengths().to_numpy(zero_copy_only=False))
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + WORDS)))
            yield b.slice(lo, hi - lo)
            lo = hi


def usual_length(words: DataFrame) -> tuple[float, float]:
    """(median, upper fence) of the words of a sentence over all documents; the fence is three interquartile ranges above the upper quartile."""
    size = F.transform("ends", lambda e, i: e - F.when(i == 0, 0).otherwise(F.get("ends", i - 1)))
    counts = words.select(F.explode(size).alias("size")).groupBy("size").count()
    q = counts.agg(F.percentile("size", [0.25, 0.5, 0.75], F.col("count")).alias("q")).first().q
    return (float(q[1]), float(q[2] + 3 * (q[2] - q[0]))) if q else (1.0, 1.0)


def sentence_ends(ends: np.ndarray, usual: tuple[float, float]) -> np.ndarray:
    """The ends of sentences laid end to end, where a piece beyond the fence (several sentences without
    marks between them) is cut into as many of like length as usual sentences are in it."""
    median, fence = usual
    size = np.diff(ends, prepend=0)
    n = np.where(size > fence, np.maximum(1, np.rint(size / median)), 1).astype(np.int64)
    at = np.repeat(np.arange(len(ends)), n)
    k = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + 1
    return (ends - size)[at] + np.rint(k * size[at] / n[at]).astype(np.int64)


@dataclass
class Model:
    """``terms``: numbers of the terms, ascending; ``idf``: weight of each; ``topics``: exp E[log] of terms by topic;
    ``subject``: of each topic, -1 for none."""

    terms: np.ndarray
    idf: np.ndarray
    names: list[str]
    topics: np.ndarray
    subject: np.ndarray
    rounds: int = 0


def document_frequencies(words: DataFrame) -> DataFrame:
    """(term, n): in how many documents each term stands; counted in each task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def sums() -> tuple[np.ndarray, np.ndarray]:
            t, n = (np.concatenate(x) for x in zip(*held))
            u, at = np.unique(t, return_inverse=True)
            return u, np.bincount(at, weights=n).astype(np.int64)

        for b in _parts(batches):
            col = b.column("words")
            w = col.flatten().to_numpy().view(np.uint32).astype(np.uint64)
            d = np.repeat(np.arange(b.num_rows, dtype=np.uint64), col.value_lengths().to_numpy(zero_copy_only=False))
            # A document counts a term once.
            u, n = np.unique((np.unique(w << np.uint64(32) | d) >> np.uint64(32)).astype(np.int64), return_counts=True)
            held.append((u, n))
            size += len(u)
            if size > 2_000_000:
                u, n = sums()
                held, size = [(u, n)], len(u)
                if size > 1_000_000:
                    yield pa.RecordBatch.from_pydict({"term": pa.array(u), "n": pa.array(n)})
                    held, size = [], 0
        if held:
            u, n = sums()
            yield pa.RecordBatch.from_pydict({"term": pa.array(u), "n": pa.array(n)})

    return words.select("words").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _weighted(col: pa.Array, unit: np.ndarray, n_units: int, terms: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Known terms of each unit (a document, a sentence), their weights, and how many each unit has; ``unit`` is that of each word."""
    w = col.flatten().to_numpy().view(np.uint32).astype(np.int64)
    i = np.minimum(np.searchsorted(terms, w), len(terms) - 1)
    there = terms[i] == w
    key, n = np.unique(unit[there] * len(terms) + i[there], return_counts=True)
    ids = key % len(terms)
    return ids, (n * idf[ids]).astype(np.float32), np.bincount(key // len(terms), minlength=n_units)


def _bags(words: DataFrame, terms: np.ndarray, idf: np.ndarray) -> DataFrame:
    """(ids, n): the model's terms of each document and their weights."""
    known = words.sparkSession.sparkContext.broadcast((terms, idf))  # two numbers a term

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches):
            col = b.column("words")
            ids, n, size = _weighted(col, np.repeat(np.arange(b.num_rows), col.value_lengths().to_numpy(zero_copy_only=False)), b.num_rows, *known.value)
            at = pa.array(np.append(0, np.cumsum(size)), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(at, pa.array(ids, pa.int32())), pa.ListArray.from_arrays(at, pa.array(n))], names=["ids", "n"])

    return words.select("words").mapInArrow(bag, "ids array<int>, n array<float>").where(F.size("ids") > 0)


def _digamma(x: np.ndarray) -> np.ndarray:
    """By recurrence up to 6 and the asymptotic series."""
    r = np.zeros_like(x)
    y = x.copy()
    for _ in range(6):
        r -= np.where(y < 6, 1 / y, 0)
        y = np.where(y < 6, y + 1, y)
    f = 1 / (y * y)
    return r + np.log(y) - 0.5 / y - f * (1 / 12 - f * (1 / 120 - f / 252))


def _exp_digamma(x: np.ndarray) -> np.ndarray:
    """exp of the digamma function of single-precision numbers above 0.05, to their precision: four steps of recurrence and the asymptotic series."""
    y = x + np.float32(4)
    f = 1 / (y * y)
    below = 1 / x + 1 / (x + np.float32(1)) + 1 / (x + np.float32(2)) + 1 / (x + np.float32(3))
    return y * np.exp(-below - np.float32(0.5) / y - f * (np.float32(1 / 12) - f * (np.float32(1 / 120) - f * np.float32(1 / 252))))


#: Entries (documents by terms) that one update holds.
ENTRIES = 100_000


def _inferred(ids: np.ndarray, n: np.ndarray, lengths: np.ndarray, b: np.ndarray, inner: int) -> Iterator[tuple]:
    """Blocks of documents of like length, with what ``inner`` updates of their proportions give:
    documents, what of the block is inside, terms, ratios of weights to expectations, exp E[log] of proportions, Dirichlet parameters.

    Documents laid end to end are padded to one block, so that an update is two products of matrices.
    """
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(lengths, kind="stable")
    order = order[np.searchsorted(lengths[order], 1) :]  # documents without terms have nothing to infer from
    padded = np.vstack([b, np.zeros((1, b.shape[1]), b.dtype)])
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi - lo + 1) * lengths[order[hi]] <= ENTRIES:
            hi += 1
        docs, lo = order[lo:hi], hi
        width = int(lengths[docs[-1]])
        inside = np.arange(width) < lengths[docs][:, None]
        at = np.where(inside, starts[docs][:, None] + np.arange(width), 0)
        i, c = np.where(inside, ids[at], len(b)), np.where(inside, n[at], 0).astype(np.float32)
        block = padded[i]  # documents, terms, topics
        gamma = np.full((len(docs), b.shape[1]), 1.0, np.float32)
        for _ in range(inner):
            theta = _exp_digamma(gamma)  # up to a factor of each document, which the ratios take out again
            r = c / (np.matmul(block, theta[:, :, None])[:, :, 0] + 1e-30)
            gamma = ALPHA + theta * np.matmul(r[:, None, :], block)[:, 0, :]
        yield docs, inside, i, r, theta, gamma


def expected(ids: np.ndarray, n: np.ndarray, lengths: np.ndarray, b: np.ndarray, total: np.ndarray, inner: int = INNER) -> None:
    """Add to ``total`` the expected counts of terms by topic of documents laid end to end."""
    for docs, inside, i, r, theta, _ in _inferred(ids, n, lengths, b, inner):
        # Expected counts are b * sum over documents of r * theta: one sparse product, by sorted terms.
        flat = i[inside]
        by = np.argsort(flat, kind="stable")
        first = np.flatnonzero(np.diff(flat[by], prepend=-1))
        d = np.repeat(np.arange(len(docs)), lengths[docs])[by]
        total[flat[by][first]] += np.add.reduceat(r[inside][by][:, None] * theta[d], first, axis=0) * b[flat[by][first]]


def proportions(ids: np.ndarray, n: np.ndarray, lengths: np.ndarray, b: np.ndarray, inner: int = 2 * INNER) -> np.ndarray:
    """Topic proportions of documents laid end to end, without the prior's part; zeros where a document has no term."""
    out = np.zeros((len(lengths), b.shape[1]), np.float32)
    for docs, _, _, _, _, gamma in _inferred(ids, n, lengths, b, inner):
        out[docs] = gamma - ALPHA
    return out / np.maximum(out.sum(1, keepdims=True), 1e-30)


def _round(bags: DataFrame, b: np.ndarray) -> np.ndarray:
    """Expected counts of terms by topic over all documents."""
    k = b.shape[1]
    sent = bags.sparkSession.sparkContext.broadcast(b.astype(np.float32))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        total = np.zeros(w.shape)
        for batch in batches:
            col = batch.column("ids")
            if batch.num_rows:
                expected(col.flatten().to_numpy(), batch.column("n").flatten().to_numpy(), col.value_lengths().to_numpy(), w, total)
        used = np.flatnonzero(total.sum(1) > 0)
        yield pa.RecordBatch.from_pydict({"term": pa.array(used, pa.int32()), **{f"t{j}": pa.array(total[used, j]) for j in range(k)}})

    cols = [f"t{j}" for j in range(k)]
    got = bags.mapInArrow(step, "term int, " + ", ".join(f"{c} double" for c in cols)).groupBy("term").agg(*(F.sum(c).alias(c) for c in cols)).toPandas()
    sent.destroy()
    out = np.zeros(b.shape)
    out[got["term"].to_numpy()] = got[cols].to_numpy()
    return out


def topic_subjects(p: np.ndarray, common: np.ndarray, terms: np.ndarray, names: Sequence[str], inspected: dict[str, str] = TERMS) -> np.ndarray:
    """The subject of each topic (a column of ``p``, its distribution over ``terms``), -1 for none, by its top terms.

    Top terms are those that weigh most by how far the topic's share of them exceeds the share ``common`` to all topics.
    """
    known = [np.isin(terms, [word_hash(w) for w in inspected.get(n, "").split()]) for n in names]
    weight = np.maximum(p * np.log(np.maximum(p, 1e-30) / np.maximum(common, 1e-30)[:, None]), 0)
    subject = np.full(p.shape[1], -1)
    for k in range(p.shape[1]):
        top = np.argsort(-weight[:, k], kind="stable")[:TOP]
        w = weight[top, k]
        score = sorted(((w[m[top]].sum() / max(w.sum(), 1e-30), j) for j, m in enumerate(known)), reverse=True)
        if score and score[0][0] >= TOP_SHARE and (len(score) == 1 or score[0][0] >= 2 * score[1][0]):
            subject[k] = score[0][1]
    return subject


def fit(words: DataFrame, names: Sequence[str], *, most_rounds: int = MOST_ROUNDS, seed: int = 5) -> Model:
    """Topics of all documents (as from ``hashed``), each mapped to a subject of ``names`` or to none.

    A corpus too small for any term gives a model without terms, in which no sentence is about anything.
    """
    names = list(names)
    n_docs = words.count()
    df = document_frequencies(words).where((F.col("n") >= max(MIN_DOCUMENTS, MIN_SHARE * n_docs)) & (F.col("n") < n_docs)).toPandas().sort_values("term")
    terms, idf = df["term"].to_numpy(np.int64), np.log(n_docs / np.maximum(df["n"].to_numpy(np.float64), 1))
    k = max(1, len(names) * PER_SUBJECT)
    if not len(terms) or not names:
        return Model(terms[:0], idf[:0], names, np.zeros((0, k), np.float32), np.full(k, -1))
    bags, path = materialise(_bags(words, terms, idf), "bags")
    size = float(bags.agg(F.sum(F.aggregate("n", F.lit(0.0), lambda a, x: a + x))).first()[0] or 0)
    lam = ETA + np.random.default_rng(seed).gamma(100, 0.01, (len(terms), k)) * size / k / len(terms)
    before = lam / lam.sum(0)
    for r in range(most_rounds):
        lam = ETA + _round(bags, np.exp(_digamma(lam) - _digamma(lam.sum(0, keepdims=True))))
        p = lam / lam.sum(0)
        moved, before = np.abs(p - before).sum(0).mean(), p
        if moved < STILL:
            break
    else:
        warnings.warn(f"topics still move by {moved:.4f} after {most_rounds} rounds", stacklevel=2)
    drop_path(words.sparkSession, path)
    common = (lam - ETA).sum(1) / max((lam - ETA).sum(), 1e-30)
    b = np.exp(_digamma(lam) - _digamma(lam.sum(0, keepdims=True)))
    return Model(terms, idf, names, b.astype(np.float32), topic_subjects(before, common, terms, names), r + 1)


#: A sentence is about a subject that holds this share of its topic proportions.
ABOUT = 0.5


def shares(words: DataFrame, model: Model, about: float = ABOUT) -> DataFrame:
    """(key, sentences, subject, about): how many sentences of each document are about each subject, where any is."""
    sent = words.sparkSession.sparkContext.broadcast((model, usual_length(words)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, usual = sent.value
        member = np.stack([m.subject == s for s in range(len(m.names))], 1).astype(np.float32) if m.names else None
        for b in _parts(batches):
            col, cut = b.column("words"), b.column("ends")
            if not len(m.terms) or member is None or not len(col.flatten()):
                continue
            n_words, n_cut = (x.value_lengths().to_numpy(zero_copy_only=False) for x in (col, cut))
            ends = sentence_ends(cut.flatten().to_numpy() + np.repeat(np.cumsum(n_words) - n_words, n_cut), usual)
            doc = np.searchsorted(np.cumsum(n_words), ends)  # documents without words end where the next begins
            size = np.diff(ends, prepend=0)
            count = np.bincount(doc, minlength=b.num_rows)
            told = proportions(*_weighted(col, np.repeat(np.arange(len(ends)), size), len(ends), m.terms, m.idf), m.topics) @ member
            best = told.argmax(1)
            sure = told[np.arange(len(best)), best] >= about
            key, n = np.unique(doc[sure] * len(m.names) + best[sure], return_counts=True)
            d = pa.array(key // len(m.names))
            yield pa.RecordBatch.from_pydict({"key": b.column("key").take(d), "sentences": pa.array(count, pa.int32()).take(d), "subject": pa.array([m.names[x] for x in key % len(m.names)], pa.string()), "about": pa.array(n, pa.int32())})

    return words.mapInArrow(score, f"key {dict(words.dtypes)['key']}, sentences int, subject string, about int")


def subjects(docs: DataFrame, key: str, text: str, names: Sequence[str], least: float = 0.25, *, fillers: re.Pattern | None = None) -> DataFrame:
    """(key, subject, share) of the subjects that at least ``least`` of a document's sentences are about: none, one or several.

    - Null, blank and wordless texts are about nothing; whole texts are read, however long.
    - Repeated rows (same key) count once in the result; a null key is left out.  An empty table gives an empty result.
    - Names without inspected terms get no topic, so no document.
    """
    words, _ = materialise(hashed(docs.where(F.col(key).isNotNull()), key, text, fillers), "words")
    got = shares(words, fit(words, names))
    return got.where(F.col("about") >= F.lit(least) * F.col("sentences")).select(F.col("key").alias(key), "subject", (F.col("about") / F.col("sentences")).alias("share")).dropDuplicates([key, "subject"])
