"""Subject areas of documents by latent semantic analysis of their sentences, with seed centroids refined over all documents.

1. Each document's sentences become sets of hashed terms (runs of one script in Japanese, words and word pairs elsewhere). All
   counts are made over all documents, in tables of fixed size.
2. Terms are weighted by inverse sentence frequency, by how much more they clump in documents than chance would have it
   (residual frequency), and by how far the labelled documents that hold them agree on a subject; common words and the frames
   of sentences get a weight near 0.
3. A truncated singular value decomposition of the weighted document by term matrix comes from subspace iteration: each pass
   multiplies the matrix and its transpose with a block of vectors, inside the tasks; only the block is summed up. The iteration
   begins on a few blocks of documents, then passes over all documents go on until the subspace has settled.
4. Labelled documents seed one centroid for each subject and kind of script; each sentence goes to the centroid of the greatest
   cosine, and centroids move to their sentences until few sentences change.
5. The sentences' subjects now say for every term of the corpus how far it belongs to one subject. With these weights steps 3
   and 4 are repeated. A document has each subject that its share of sentences reaches `SHARE` for.

The fixed sizes are BUCKETS terms, RANK dimensions a subject and LABELLED documents for the seeds. Sums of tables and blocks are made in
parts, one task a part, and the driver gets one table of fixed size.
"""

from __future__ import annotations

import html
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kumiki.llm import fold
from kumiki.session import checkpointed, slots, spread, swept

BUCKETS, LABELLED = 1 << 17, 50_000
#: Dimensions of the space for each subject: enough for its words in three scripts, few enough that they fall together.
RANK = 4
SHARE, COSINE, STRENGTH, PURITY, CLUMPED = 0.25, 0.5, 1.0, 0.4, 0.1
WEAK = 0.3
#: What the cosine of a sentence with its nearest centroid must exceed where the subject is named; to move a centroid, COSINE.
NAMED = 0.1
#: A subspace has settled if its directions keep this share (mean squared cosine) in a pass, centroids if no more than this share
#: of the sentences near one changes. More than LONGEST passes are an error.
SETTLED, CHANGED, LONGEST = 0.995, 0.001, 100
#: A term of fewer places says nothing of the sentences, however many there are.
PLACES = 2
#: Documents that are multiplied at a time.
STEP = 500
#: Entries of a sentence that are added together with those of others, those beyond are added by themselves.
SHORT = 64
#: A part of the matrix is multiplied as a whole if it has at most so many cells, and so many for each that isn't 0.
CELLS, THIN = 1 << 22, 128
#: Blocks of documents on which the iteration begins.
START = 20
assert STEP * BUCKETS < 2**31
BINS = 64

_MARKUP = re.compile(r"<[^<>]{1,300}>|https?://\S+")
_STOP = re.compile(r"[。｡!?！？\n]|[.．](?!\d)")
#: Runs of one Japanese script, ends of sentences and of texts, words.
_TERM = re.compile(r"[一-鿿々]+|[ァ-ヺー]+|[ぁ-ゖ]+|[\x00\x01]|[^\W\d_぀-ヿ一-鿿々ー]+")
_VIETNAMESE = re.compile("[ăđơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹĩũ]")
_ENDS = re.compile("[\x00\x01]")


class Terms(dict):
    """Terms as numbers, remembered: four times a 32-bit hash, 1 more for a word with a Vietnamese letter, 2 more for a Japanese
    run; ends below 0."""

    def __missing__(self, term: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        if term < "\x02":
            k = -2 if term == "\x01" else -1
        else:
            c = term[0]
            japanese = "ぁ" <= c <= "ヺ" or "一" <= c <= "鿿" or c in "ー々"
            k = 4 * zlib.crc32(term.encode("utf-8", "surrogatepass")) + (2 if japanese else _VIETNAMESE.search(term) is not None)
        self[term] = k
        return k

    def sentences(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sentences with a word, of each text; of each sentence its terms and script: 0 Japanese, 1 Vietnamese, 2 other; the terms."""
        clean = []
        for text in texts:
            text = _ENDS.sub(" ", text) if text else ""
            if "<" in text or "http" in text:
                text = _MARKUP.sub("\n", text)
            if "&" in text:
                text = _ENDS.sub(" ", html.unescape(text))
            if not text.isascii() and not unicodedata.is_normalized("NFKC", text):
                text = re.sub("[​-‏­⁠﻿]", "", unicodedata.normalize("NFKC", text))
            clean.append(text)
        whole = _STOP.sub("\x00", "\x01".join(clean).lower()) + "\x01"
        k = np.fromiter(map(self.__getitem__, _TERM.findall(whole)), np.int64)
        end = k < 0
        at, ends = np.cumsum(end)[~end], k[end]
        k = k[~end]
        japanese = (k & 2) > 0
        word, s_word = k[~japanese] >> 2, at[~japanese]
        after = np.flatnonzero(s_word[1:] == s_word[:-1])
        two = fold.mix((word[after] << 32 | word[after + 1]).view(np.uint64)) % np.uint64(BUCKETS)
        term = np.concatenate([(k >> 2) % BUCKETS, two.astype(np.int64)]).astype(np.int32)
        of = np.concatenate([at, s_word[after]])
        order = np.argsort(of, kind="stable")
        text_of = np.cumsum(ends == -2) - (ends == -2)  # of each sentence
        sizes = np.bincount(of, minlength=len(ends))[: len(ends)]
        kind = np.full(len(ends), 2, np.uint8)
        kind[at[(k & 1) > 0]] = 1
        kind[at[japanese]] = 0
        on = sizes > 0
        return np.bincount(text_of[on], minlength=len(texts)), sizes[on], kind[on], term[order]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each STEP documents: their ids, labels and sentence counts, and a compressed body of the sentences' sizes,
    scripts and terms, byte planes apart (what numbers repeat is in their upper bytes)."""
    t = Terms()
    for b in batches:
        for k in range(0, b.num_rows, STEP):
            part = b.slice(k, STEP)
            per, sizes, kinds, terms = t.sentences(part.column("text").to_pylist())
            flat = _planed(sizes) + kinds.tobytes() + _planed(terms)
            body = len(flat).to_bytes(8, "little") + pa.compress(flat, codec="zstd", asbytes=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([part.column("labels").to_pylist()], pa.list_(pa.list_(pa.int32()))),
                 pa.array([per], pa.list_(pa.int32())), pa.array([body], pa.binary())],
                ["ids", "labels", "per", "body"],
            )


def _planed(numbers: np.ndarray) -> bytes:
    return numbers.astype(np.int32).view(np.uint8).reshape(-1, 4).T.tobytes()


def _planes(body: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(body.reshape(4, -1).T).view(np.int32).reshape(-1)


class Block:
    """A row of documents as flat arrays: terms, the sentence of each, the document of each sentence."""

    def __init__(self, ids: list[int], labels: list, per: list[int], body: bytes):
        raw = np.frombuffer(pa.decompress(body[8:], int.from_bytes(body[:8], "little"), codec="zstd", asbytes=True), np.uint8)
        self.ids, self.labels, self.n = ids, labels, len(ids)
        self.per = np.array(per, np.int64)
        self.sentences = s = int(self.per.sum())
        sizes = _planes(raw[: 4 * s])
        self.kind = raw[4 * s : 5 * s]
        self.term = _planes(raw[5 * s :])
        self.sentence = np.repeat(np.arange(s), sizes)
        self.doc = np.repeat(np.arange(self.n), self.per)

    def labelled(self) -> Block:
        """The block's documents with labels, as a block."""
        b = object.__new__(Block)
        on = np.array([bool(x) for x in self.labels], bool)
        of, number = on[self.doc], np.cumsum(on) - 1
        b.ids, b.labels, b.n = [i for i, k in zip(self.ids, on) if k], [x for x in self.labels if x], int(on.sum())
        b.per, b.kind, b.sentences = self.per[on], self.kind[of], int(of.sum())
        use = of[self.sentence]
        b.term, b.sentence, b.doc = self.term[use], (np.cumsum(of) - 1)[self.sentence[use]], number[self.doc[of]]
        return b

    def targets(self, subjects: int) -> np.ndarray:
        """(document, subject): the labels of a document, together 1."""
        t = np.zeros((self.n, subjects), np.float32)
        for i, x in enumerate(self.labels):
            for k in x or ():
                t[i, k] = 1
        return t / np.maximum(t.sum(1, keepdims=True), 1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for b in batches:
        for row in zip(*(b.column(c) for c in ("ids", "labels", "per", "body"))):
            yield Block(*(x.as_py() for x in row))


def _rows(out: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    """out[at] += values, row by row, where rows may repeat."""
    if len(at):
        order = np.argsort(at, kind="stable")
        at = at[order]
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        out[at[starts]] += np.add.reduceat(values[order], starts, axis=0)


def _ordered(out: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    """As `_rows`, for `at` in ascending order."""
    if len(at):
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        out[at[starts]] += np.add.reduceat(values, starts, axis=0)


def _summed(out: np.ndarray, at: np.ndarray, table: np.ndarray, rows: np.ndarray) -> None:
    """As `_ordered` with table[rows]: the first entries of all sums are added together, then the second ones, up to SHORT."""
    if not len(at):
        return
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    sizes = np.diff(np.r_[starts, len(at)])
    by = np.argsort(-sizes, kind="stable")
    first, sizes = starts[by], sizes[by]
    sums = table[rows[first]]
    left = np.searchsorted(-sizes, -np.arange(2, SHORT + 1), "right")  # sums with so many entries at least
    for k, n in enumerate(left.tolist(), 1):
        if not n:
            break
        sums[:n] += table[rows[first[:n] + k]]
    for i in range(int(np.searchsorted(-sizes, -SHORT, "left"))):
        sums[i] += table[rows[first[i] + SHORT : first[i] + sizes[i]]].sum(0)
    out[at[first]] += sums


def _total(features: DataFrame, shape: tuple[int, int], add: Callable[[Block, np.ndarray], None]) -> np.ndarray:
    """The sum over all blocks of what `add` puts into a table of `shape`; parts of the table are summed by tasks of their own."""
    parts = max(1, min(64, shape[0] * shape[1] // 65_536))
    cuts = np.linspace(0, shape[0], parts + 1).astype(int)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(shape, np.float64)
        for x in _blocks(batches):
            add(x, table)
        for k in range(parts):
            own = table[cuts[k] : cuts[k + 1]]
            if own.any():
                yield pa.RecordBatch.from_pydict({"part": pa.array([k], pa.int32()), "body": pa.array([zlib.compress(own.astype(np.float32).tobytes(), 1)], pa.binary())})

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, body in zip(b.column("part").to_pylist(), b.column("body").to_pylist()):
                v = np.frombuffer(zlib.decompress(body), np.float32).astype(np.float64)
                sums[k] = sums[k] + v if k in sums else v
        for k, v in sums.items():
            yield pa.RecordBatch.from_pydict({"part": pa.array([k], pa.int32()), "body": pa.array([v.astype(np.float32).tobytes()], pa.binary())})

    schema = "part int, body binary"
    spark = features.sparkSession
    with swept(spark):
        got = features.mapInArrow(run, schema)
        few = min(parts, 2 * slots(spark))
        got = got.repartitionById(few, F.col("part") % few) if parts > 1 else got.repartition(1)
        rows = got.mapInArrow(join, schema).collect()  # one row a part
    table = np.zeros(shape, np.float64)
    for r in rows:
        table[cuts[r["part"]] : cuts[r["part"] + 1]] += np.frombuffer(r["body"], np.float32).reshape(-1, shape[1])
    return table


def _counts(subjects: int) -> Callable[[Block, np.ndarray], None]:
    """Columns: places of the term, documents with it, its places in labelled sentences, and of these those of each subject.

    Below the terms: sentence counts of documents in BINS logarithmic bins (documents, sentences), then the sums."""

    def add(x: Block, out: np.ndarray) -> None:
        out[:BUCKETS, 0] += np.bincount(x.term, minlength=BUCKETS)
        doc = x.doc[x.sentence]
        both = np.sort(doc.astype(np.int32) * BUCKETS + x.term)  # STEP documents a block: no overflow
        both = both[np.r_[True, both[1:] != both[:-1]]] if len(both) else both
        out[:BUCKETS, 1] += np.bincount(both % BUCKETS, minlength=BUCKETS)
        t = x.targets(subjects)
        on = t.sum(1) > 0
        use = np.flatnonzero(on[doc])
        if len(use):
            term, w = x.term[use], t[doc[use]]
            np.add.at(out[:, 2], term, 1.0)
            for c in range(subjects):
                own = w[:, c] > 0
                np.add.at(out[:, 3 + c], term[own], w[own, c])
            s = t[x.doc]
            out[BUCKETS + BINS, 2] += on[x.doc].sum()
            out[BUCKETS + BINS, 3:] += s.sum(0)
        full = x.per[x.per > 0]
        bins = np.minimum((4 * np.log2(full)).astype(int), BINS - 1)
        out[BUCKETS : BUCKETS + BINS, 0] += np.bincount(bins, minlength=BINS)
        out[BUCKETS : BUCKETS + BINS, 1] += np.bincount(bins, weights=full, minlength=BINS)
        out[BUCKETS + BINS, 0] += x.sentences
        out[BUCKETS + BINS, 1] += x.n

    return add


def _clumping(counts: np.ndarray) -> np.ndarray:
    """Of each term the logarithm of the documents that chance would spread it over against those that hold it."""
    f, d = counts[:BUCKETS, 0], counts[:BUCKETS, 1]
    docs, sents = counts[BUCKETS : BUCKETS + BINS, 0], counts[BUCKETS : BUCKETS + BINS, 1]
    some = docs > 0
    share = sents[some] / docs[some] / max(1.0, counts[BUCKETS + BINS, 0])
    grid = np.unique(np.round(np.logspace(0, np.log10(max(f.max(), 2)), 80)))
    spread_ = np.array([(docs[some] * -np.expm1(g * np.log1p(-np.minimum(share, 0.999999)))).sum() for g in grid])
    return np.log(np.maximum(np.interp(f, grid, spread_), 1) / np.maximum(d, 1))


def _purity(held: np.ndarray, of: np.ndarray, base: float) -> np.ndarray:
    return np.clip((of.max(1) / np.maximum(held, 1e-9) - base) / (1 - base), 0, 1)


class Weighing:
    """Weights of terms, packed to those above WEAK (weaker ones decide nothing), and the vectors of their space."""

    def __init__(self, weight: np.ndarray, rank: int):
        on = np.flatnonzero(weight > WEAK)
        self.place = np.full(BUCKETS, -1, np.int32)
        self.place[on] = np.arange(len(on))
        self.weight = weight[on].astype(np.float32)
        self.rank = rank
        self.vectors = np.zeros((len(on), rank), np.float32)

    def entries(self, x: Block) -> tuple[np.ndarray, np.ndarray]:
        at = self.place[x.term]
        use = at >= 0
        return at[use], x.sentence[use]


class Iteration:
    """Subspace iteration: directions and, after each product of the matrix with them, the next ones."""

    def __init__(self, q: np.ndarray):
        self.q = q.astype(np.float32)

    def advance(self, z: np.ndarray) -> bool:
        """Takes the product `z` of the matrix with `q`; says whether the directions have settled: their mean squared cosine with
        those before is SETTLED, directions that the product holds nothing of aside."""
        new, length, _ = np.linalg.svd(z, full_matrices=False)
        lead = new[:, length > 1e-6 * max(length.max(initial=0), 1e-30)]
        kept = ((self.q.T @ lead) ** 2).sum() / max(1, lead.shape[1])
        self.q = new.astype(np.float32)
        return bool(kept >= SETTLED)


def _products(x: Block, w: Weighing) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's part of the matrix, each document's terms once: documents, terms, values; and the documents' sizes."""
    n = len(w.weight)
    at, sentence = w.entries(x)
    both, c = np.unique((x.doc[sentence] * n + at).astype(np.int32), return_counts=True)  # STEP documents: no overflow
    doc, at = both // n, both % n
    v = w.weight[at]
    size = np.maximum(np.bincount(doc, weights=c * v * v, minlength=x.n), 1e-12).astype(np.float32)
    return doc, at, v * c.astype(np.float32), size


def _multiplied(part: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], q: np.ndarray, out: np.ndarray) -> None:
    """Adds the product of a part, transposed, with the part and `q`."""
    doc, at, v, size = part
    here = np.zeros(len(q), bool)
    here[at] = True
    terms = np.flatnonzero(here)
    if len(size) * len(terms) <= min(CELLS, THIN * len(at)):
        m = np.zeros((len(size), len(terms)), np.float32)
        m[doc, (np.cumsum(here) - 1)[at]] = v  # each document's terms are there once
        out[terms] += m.T @ (m @ q[terms] / size[:, None])
        return
    y = np.zeros((len(size), q.shape[1]), np.float32)
    _ordered(y, doc, q[at] * v[:, None])
    y /= size[:, None]
    _rows(out, at, y[doc] * v[:, None])


def _beginning(features: DataFrame) -> DataFrame:
    """The first part of the blocks, where they lie: nothing is shuffled."""
    return features.where(F.spark_partition_id() == 0)


def _iterated(parts: list[tuple], q: np.ndarray) -> np.ndarray:
    it = Iteration(q)
    for _ in range(LONGEST):
        z = np.zeros(q.shape)
        for p in parts:
            _multiplied(p, it.q, z)
        if it.advance(z):
            break
    return it.q


def _first_space(features: DataFrame, w: Weighing, q: np.ndarray) -> np.ndarray:
    """Vectors to begin with: `q` iterated over START blocks at most of the first part, inside one task. They only save passes over all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_products(x, w) for x in islice(_blocks(batches), START)]
        if parts:
            yield pa.RecordBatch.from_pydict({"body": pa.array([_iterated(parts, q).tobytes()], pa.binary())})

    body = _beginning(features).mapInArrow(run, "body binary").first()
    return np.frombuffer(body["body"], np.float32).reshape(q.shape) if body else q


def _space(features: DataFrame, w: Weighing) -> None:
    """Sets w.vectors to the leading right singular vectors of the weighted document by term matrix.

    Passes over all documents go on until the subspace has settled.
    """
    n = len(w.weight)
    start = np.random.default_rng(7).standard_normal((n, min(w.rank, max(1, n))))
    it = Iteration(_first_space(features, w, np.linalg.qr(start)[0].astype(np.float32)))
    for _ in range(LONGEST):

        def add(x: Block, out: np.ndarray, q: np.ndarray = it.q) -> None:
            _multiplied(_products(x, w), q, out)

        if it.advance(_total(features, it.q.shape, add)):
            break
    else:
        raise RuntimeError(f"the space did not settle in {LONGEST} passes")
    w.vectors = np.zeros((n, w.rank), np.float32)
    q = it.q[:, : w.rank]
    w.vectors[:, : q.shape[1]] = q * w.weight[:, None]


def _embedded(x: Block, w: Weighing) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the sentences (0 without weighted terms) and the greatest weight in each."""
    at, sentence = w.entries(x)
    e = np.zeros((x.sentences, w.rank), np.float32)
    top = np.zeros(x.sentences, np.float32)
    if len(at):
        _summed(e, sentence, w.vectors, at)
        starts = np.flatnonzero(np.r_[True, sentence[1:] != sentence[:-1]])
        top[sentence[starts]] = np.maximum.reduceat(w.weight[at], starts)
    size = np.linalg.norm(e, axis=1)
    return e / np.maximum(size, 1e-9)[:, None], np.where(size > 1e-6, top, 0)


def _nearest(e: np.ndarray, top: np.ndarray, centroids: np.ndarray, strength: float = 0.0, cosine: float = COSINE) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each sentence, whether its cosine exceeds `cosine` and a weight `strength`."""
    cos = e @ centroids.T
    near = cos.argmax(1)
    return near, (cos[np.arange(len(cos)), near] > cosine) & (top > strength)


def _assigned(x: Block, w: Weighing, centroids: np.ndarray, strength: float = 0.0, cosine: float = COSINE) -> tuple[np.ndarray, np.ndarray]:
    """`_nearest` of the sentences of a block."""
    return _nearest(*_embedded(x, w), centroids, strength, cosine)


def _unit(c: np.ndarray) -> np.ndarray:
    return (c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def _moved(e: np.ndarray, top: np.ndarray, c: np.ndarray, before: np.ndarray, out: np.ndarray) -> None:
    """Adds the sentences near each centroid; below them, how many changed since `before` and how many are near one."""
    near, ok = _nearest(e, top, c)
    old, was = _nearest(e, top, before)
    _rows(out, near[ok], e[ok].astype(np.float64))
    out[-1, :2] += (ok != was).sum() + (ok & was & (near != old)).sum(), (ok | was).sum()


def _first_centroids(features: DataFrame, w: Weighing, c: np.ndarray) -> np.ndarray:
    """`c` moved over START blocks at most of the first part until few change, inside one task. It only saves passes over
    all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_embedded(x, w) for x in islice(_blocks(batches), START)]
        if parts:
            yield pa.RecordBatch.from_pydict({"body": pa.array([_settled(parts, c).tobytes()], pa.binary())})

    body = _beginning(features).mapInArrow(run, "body binary").first()
    return np.frombuffer(body["body"], np.float32).reshape(c.shape) if body else c


def _settled(parts: list[tuple[np.ndarray, np.ndarray]], c: np.ndarray) -> np.ndarray:
    before = np.zeros_like(c)
    for _ in range(LONGEST):
        t = np.zeros((len(c) + 1, c.shape[1]))
        for e, top in parts:
            _moved(e, top, c, before, t)
        if t[-1, 0] <= CHANGED * t[-1, 1]:
            break
        before, c = c, _unit(t[:-1] + 0.01 * c)
    return c


def _centroids(features: DataFrame, w: Weighing, seeds: Callable[[Block], tuple[Block, np.ndarray]], subjects: int) -> np.ndarray:
    """Seed centroids (script and subject) from `seeds` (a part of a block, sentence by subject), moved over all sentences until
    few change."""

    def seed(x: Block, out: np.ndarray) -> None:
        x, r = seeds(x)
        on = np.flatnonzero(r.sum(1) > 0)
        if len(on):
            e, _ = _embedded(x, w)
            for g in range(3):
                s = on[x.kind[on] == g]
                out[g * subjects : (g + 1) * subjects] += r[s].T @ e[s]

    c = _first_centroids(features, w, _unit(_total(features, (3 * subjects, w.rank), seed)))
    before = np.zeros_like(c)  # near nothing
    for _ in range(LONGEST):

        def move(x: Block, out: np.ndarray, c: np.ndarray = c, before: np.ndarray = before) -> None:
            _moved(*_embedded(x, w), c, before, out)

        t = _total(features, (3 * subjects + 1, w.rank), move)
        if t[-1, 0] <= CHANGED * t[-1, 1]:
            return c
        before, c = c, _unit(t[:-1] + 0.01 * c)
    raise RuntimeError(f"centroids did not settle in {LONGEST} passes")


def subject_areas(docs: DataFrame, labels: DataFrame, subjects: list[str], share: float = SHARE, labelled: int = LABELLED) -> DataFrame:
    """(doc_id, subject): each subject that at least `share` of a document's sentences are about.

    `docs` has doc_id and text, `labels` doc_id and subject. At most `labelled` labelled documents, the first by hash, seed the
    subjects; everything else is taken from all documents. Null, empty and blank texts have no row, nor have texts of which no
    subject holds enough sentences. Labels of unknown subjects or documents are ignored; without labels there is no row.
    """
    spark = docs.sparkSession
    code = F.create_map(*[F.lit(v) for k, s in enumerate(subjects) for v in (s, k)])
    known = labels.where(F.col("subject").isin(subjects) & F.col("doc_id").isNotNull())
    known = known.groupBy(F.col("doc_id").alias("k")).agg(F.sort_array(F.collect_set(code[F.col("subject")])).alias("labels"))
    known = known.orderBy(F.xxhash64("k"), "k").limit(labelled)  # the bound of what is broadcast
    text = spread(docs.select("doc_id", "text"), "doc_id", per_slot=1).join(F.broadcast(known), F.expr("doc_id = k"), "left").select("doc_id", "text", "labels")
    features = checkpointed(text.mapInArrow(_features, "ids array<long>, labels array<array<int>>, per array<int>, body binary"))
    n = len(subjects)
    counts = _total(features, (BUCKETS + BINS + 1, 3 + n), _counts(n))
    f, sums = counts[:BUCKETS, 0], counts[BUCKETS + BINS]
    rarity = np.log(max(sums[0], 2) / (1 + f))
    often = f >= PLACES
    base = 2 * float((sums[3:] / max(sums[2], 1)).max())
    held = counts[:BUCKETS, 2]
    sure = held / (held + 2)
    agreed = sure * _purity(held, counts[:BUCKETS, 3:], min(base, 0.9)) + (1 - sure) * 0.4
    weight = np.where(often, rarity * np.clip(_clumping(counts) - CLUMPED, 0, 1.5) * agreed, 0)
    if not (weight > WEAK).any() or not sums[2]:
        return spark.createDataFrame([], "doc_id long, subject string")
    w = Weighing(weight, RANK * n)
    _space(features, w)

    def known_ones(x: Block) -> tuple[Block, np.ndarray]:
        x = x.labelled()
        return x, x.targets(n)[x.doc]

    c = _centroids(features, w, known_ones, n)

    def first(x: Block) -> tuple[np.ndarray, np.ndarray]:
        near, ok = _assigned(x, w, c, WEAK)
        return near % n, ok

    def again(x: Block, out: np.ndarray) -> None:
        near, ok = first(x)
        at = near[x.sentence]
        use = ok[x.sentence]
        out += np.bincount(x.term[use] * n + at[use], minlength=BUCKETS * n).reshape(BUCKETS, n)

    of = _total(features, (BUCKETS, n), again)
    v = Weighing(np.where(often, rarity * f / (f + 2) * _purity(f, of, PURITY), 0), RANK * n)
    if not len(v.weight):
        return spark.createDataFrame([], "doc_id long, subject string")
    _space(features, v)

    def seeds(x: Block) -> tuple[Block, np.ndarray]:
        near, ok = first(x)
        r = np.zeros((x.sentences, n), np.float32)
        r[np.flatnonzero(ok), near[ok]] = 1
        return x, r

    c2 = _centroids(features, v, seeds, n)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _blocks(batches):
            near, ok = _assigned(x, v, c2, STRENGTH, NAMED)
            hits = np.bincount(x.doc[ok] * n + near[ok] % n, minlength=x.n * n).reshape(x.n, n)
            d, s = np.nonzero((hits > 0) & (hits >= share * x.per[:, None] - 1e-9))
            yield pa.RecordBatch.from_arrays([pa.array([x.ids[i] for i in d], pa.int64()), pa.array([subjects[k] for k in s], pa.string())], ["doc_id", "subject"])

    return features.mapInArrow(name, "doc_id long, subject string")
