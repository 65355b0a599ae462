"""Encoding of texts with a public byte-level BPE tokenizer, by recursive DuckDB queries inside each partition.

A text is cut into words by the tokenizer's pattern, and each word that a task hasn't met where no entry of the vocabulary can
reach across: two neighbouring bytes that no entry holds together with the byte before or after them, and that are no entry
themselves, are never joined. The distinct segments are laid out as rows (segment, position, token) of single bytes. A recursive
query joins each position and its right neighbour with the merge table, finds the
least rank of each word and contracts that pair where it stands leftmost in each run, until no word has a pair left; an
ordered aggregation then gives the ids of each segment. A text's ids are those of its words' segments in order.

The pair of least rank is contracted at all places at once that don't touch: a merge can only make pairs of a greater rank, so
the result is that of one contraction after another, leftmost first.

The rows that a query keeps are bounded: segments come in pieces by the square of their length, and a query that would keep more
stops after some rounds and is taken up from its last state.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kumiki.session import spread

TOKENIZER = "byte_bpe_50k"
FOLDER = "/opt/tokenizers"
#: Rows that one recursive query may keep, and words that a task remembers.
ROWS, WORDS = 3_000_000, 400_000
#: Texts whose words are encoded together.
STEP = 2_000
#: Fixed value: the tokenizer's pattern of words.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_STEP = """
WITH RECURSIVE s(w, pos, tok, it) AS (
  SELECT w, pos, tok, 0 FROM state
  UNION ALL
  SELECT w, pos, CASE WHEN c THEN id ELSE tok END, it + 1 FROM (
    SELECT *, coalesce(lag(c) OVER (PARTITION BY w ORDER BY pos), false) AS gone FROM (
      SELECT *, rank IS NOT DISTINCT FROM best
                AND lag(rank) OVER (PARTITION BY w ORDER BY pos) IS DISTINCT FROM best AS c FROM (
        SELECT w, pos, tok, it, id, rank, min(rank) OVER (PARTITION BY w) AS best FROM (
          SELECT w, pos, tok, it, lead(tok) OVER (PARTITION BY w ORDER BY pos) AS nxt FROM s WHERE it < {rounds}
        ) LEFT JOIN merges ON l = tok AND r = nxt
      ) WHERE best IS NOT NULL
    )
  ) WHERE NOT gone
), last AS (SELECT w, max(it) AS it FROM s GROUP BY w)
SELECT w, list(tok ORDER BY pos) AS ids, any_value(it) AS it FROM s JOIN last USING (w, it) GROUP BY w
"""


def byte_symbols() -> dict[str, int]:
    """The characters by which the vocabulary file writes bytes: printable ones stand for themselves, the others follow 255."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Encodes words with one in-memory database; made once in each task."""

    def __init__(self, path: str, rows: int = ROWS):
        import duckdb
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.bytes = np.zeros(256, np.int32)
        for c, b in byte_symbols().items():
            self.bytes[b] = vocab[c]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "500MB"})
        merges = pa.table({
            "l": pa.array([vocab[a] for a, _ in pairs], pa.int32()), "r": pa.array([vocab[b] for _, b in pairs], pa.int32()),
            "rank": pa.array(range(len(pairs)), pa.int32()), "id": pa.array([vocab[a + b] for a, b in pairs], pa.int32()),
        })
        self.db.register("given", merges)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM given")
        self.split = regex.compile(PATTERN).findall
        symbol = byte_symbols()
        entries = [np.frombuffer(bytes(map(symbol.__getitem__, t)), np.uint8).astype(np.int32) for t in vocab if all(c in symbol for c in t)]
        self.pair, self.triple = np.zeros(1 << 16, bool), np.zeros(1 << 24, bool)
        for t in entries:
            if len(t) == 2:
                self.pair[t[0] << 8 | t[1]] = True
            elif len(t) > 2:
                self.triple[t[:-2] << 16 | t[1:-1] << 8 | t[2:]] = True
        self.known: dict[str, bytes] = {}
        self.segments: dict[bytes, bytes] = {}
        self.rows = rows

    def cut(self, raw: bytes) -> list[bytes]:
        """The segments of a word that no entry of the vocabulary reaches across."""
        b = np.frombuffer(raw, np.uint8).astype(np.int32)
        if len(b) < 2:
            return [raw]
        joined = self.pair[b[:-1] << 8 | b[1:]]
        t = self.triple[b[:-2] << 16 | b[1:-1] << 8 | b[2:]]
        joined[1:] |= t
        joined[:-1] |= t
        ends = (np.flatnonzero(~joined) + 1).tolist()
        return [raw[i:j] for i, j in zip([0, *ends], [*ends, len(raw)])]

    def words(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each word with its ids as bytes of 32-bit numbers."""
        parts = [self.cut(w.encode("utf-8")) for w in words]
        new = list({s for p in parts for s in p if s not in self.segments})
        if len(self.segments) > WORDS:
            self.segments = {}
            new = list({s for p in parts for s in p})
        at = 0
        while at < len(new):  # pieces whose queries keep a bounded number of rows
            stop, cost = at, 0
            while stop < len(new) and (stop == at or cost + len(new[stop]) ** 2 // 2 <= self.rows):
                cost += len(new[stop]) ** 2 // 2
                stop += 1
            self.segments.update(self._piece(new[at:stop]))
            at = stop
        for w, p in zip(words, parts):
            yield w, b"".join(map(self.segments.__getitem__, p))

    def _piece(self, raw: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        tok = self.bytes[np.frombuffer(b"".join(raw), np.uint8)]
        w = np.repeat(np.arange(len(raw), dtype=np.int32), size)
        while len(w):
            rounds = max(8, self.rows // len(w))
            state = pa.table({"w": w, "pos": np.arange(len(w), dtype=np.int32), "tok": tok})
            self.db.register("state", state)
            got = self.db.execute(_STEP.format(rounds=rounds)).fetchall()
            self.db.unregister("state")
            more = [(k, ids) for k, ids, it in got if it >= rounds]
            for k, ids, it in got:
                if it < rounds:
                    yield raw[k], np.array(ids, np.int32).tobytes()
            w = np.concatenate([np.full(len(ids), k, np.int32) for k, ids in more]) if more else w[:0]
            tok = np.concatenate([np.array(ids, np.int32) for _, ids in more]) if more else tok[:0]

    def batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as bytes of 32-bit numbers; None is as the empty text: no ids."""
        cut = [self.split(t) if t else [] for t in texts]
        if len(self.known) > WORDS:
            self.known = {}
        new = set().union(*cut).difference(self.known)
        self.known.update(self.words(list(new)))
        get = self.known.__getitem__
        return [b"".join(map(get, ws)) for ws in cut]


def encoded(docs: DataFrame, tokenizer: str = TOKENIZER, folder: str = FOLDER) -> DataFrame:
    """(doc_id, ids): the token ids of each text, without special tokens, whose strings are ordinary text.

    Null and empty texts have the empty list; blank ones the ids of their white space. Rows that repeat a doc_id stay. Other
    columns are ignored. `folder` holds the public vocabulary files.
    """
    path = f"{folder}/{tokenizer}.json"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = None
        for b in batches:
            e = e or Encoder(path)
            for k in range(0, b.num_rows, STEP):
                part = b.slice(k, STEP)
                ids = e.batch(part.column("text").to_pylist())
                offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
                flat = np.frombuffer(b"".join(ids), np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], ["doc_id", "ids"])

    kind = dict(docs.dtypes)["doc_id"]
    return spread(docs.select("doc_id", "text"), "doc_id", per_slot=1).mapInArrow(run, f"doc_id {kind}, ids array<int>")
