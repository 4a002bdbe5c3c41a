"""Byte-level BPE by recursive DuckDB queries.

Each task splits its texts into pieces and encodes the pieces it has not met yet in a recursive query: rows (word,
position, token) join the merge table on neighbouring tokens, each word contracts its leftmost pair of least rank, and a
word ends when no pair of it can merge. The recursion keeps one row for each position (USING KEY), so that its memory
follows the bytes. Decoding joins ids to the vocabulary and aggregates the bytes in order.

Long words contract more pairs in a round, with the same result. A pair that comes first by rank and position among all
pairs nearer than the longest token can't be reached by any other merge before its own turn: what would reach it were a
longer token. And of the pairs of the word's least rank all are contracted that do not overlap, if their token is no part
of a token of lesser rank, so that nothing they make comes before them."""

from __future__ import annotations

import base64
import hashlib
from functools import cache

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import col, map_arrow, quoted

#: Bytes of pieces encoded in one query, and the MB that DuckDB may take for them; a longer piece is a query of its own.
STEP_BYTES, STEP_MB = 500_000, 400
#: Bytes, about, of the pieces that a worker remembers.
KNOWN_BYTES = 360_000_000

#: k holds a pair's rank and position.
ENCODE = """
WITH RECURSIVE state(word, pos, tok) USING KEY (word, pos) AS (
    SELECT word, pos, tok FROM pieces
  UNION ALL
    (WITH live AS MATERIALIZED (SELECT word, pos, tok, lead(tok) OVER w AS nxt, lag(pos) OVER w AS ppos
                                FROM state WHERE tok >= 0 WINDOW w AS (PARTITION BY word ORDER BY pos)),
          best AS (SELECT word, min(m.tok::BIGINT << 31 | l.pos) AS k FROM live l JOIN merges m ON l.tok = m.a AND l.nxt = m.b GROUP BY word)
     SELECT l.word, l.pos, CASE b.k & 2147483647 WHEN l.pos THEN (b.k >> 31)::INTEGER WHEN l.ppos THEN -1 ELSE l.tok END FROM live l JOIN best b USING (word))
)
SELECT word, list(tok ORDER BY pos) FROM state WHERE tok >= 0 GROUP BY word
"""
#: The same for words of more than {part} bytes, three times the longest token: `first` is a pair that comes before all of its
#: own and the neighbouring parts, `same` those of the word's least rank.
ENCODE_LONG = """
WITH RECURSIVE state(word, pos, tok) USING KEY (word, pos) AS (
    SELECT word, pos, tok FROM pieces
  UNION ALL
    (WITH live AS MATERIALIZED (SELECT word, pos, tok, lead(tok) OVER w AS nxt, lead(pos) OVER w AS npos, row_number() OVER w AS n
                                FROM state WHERE tok >= 0 WINDOW w AS (PARTITION BY word ORDER BY pos)),
          pairs AS MATERIALIZED (SELECT l.word, l.pos, l.npos, l.n, m.tok, m.early FROM live l JOIN merges m ON l.tok = m.a AND l.nxt = m.b),
          best AS MATERIALIZED (SELECT word, pos // {part} AS part, min(tok::BIGINT << 31 | pos) AS k, arg_min(npos, tok::BIGINT << 31 | pos) AS npos FROM pairs GROUP BY word, part),
          first AS (SELECT word, k, npos, min(k) OVER (PARTITION BY word ORDER BY part RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS least FROM best),
          same AS (SELECT p.word, p.pos, p.npos, p.tok, p.n - row_number() OVER (PARTITION BY p.word ORDER BY p.pos) AS run
                   FROM pairs p JOIN (SELECT word, min(k) >> 31 AS tok FROM best GROUP BY word) b ON p.word = b.word AND p.tok = b.tok WHERE NOT p.early),
          hits AS MATERIALIZED (SELECT word, (k & 2147483647)::INTEGER AS pos, npos, (k >> 31)::INTEGER AS tok FROM first WHERE k = least
                                UNION SELECT word, pos, npos, tok FROM (SELECT *, row_number() OVER (PARTITION BY word, run ORDER BY pos) AS nth FROM same) WHERE nth % 2 = 1),
          changed AS (SELECT word, pos, tok FROM hits UNION ALL SELECT word, npos, -1 FROM hits)
     SELECT l.word, l.pos, coalesce(c.tok, l.tok) FROM live l SEMI JOIN hits h ON l.word = h.word LEFT JOIN changed c ON l.word = c.word AND l.pos = c.pos)
)
SELECT word, list(tok ORDER BY pos) FROM state WHERE tok >= 0 GROUP BY word
"""


class Encoder:
    """Encodes and decodes with the ranks of a .tiktoken file and a splitting pattern, as the tiktoken library does without special tokens."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.byte = [self.ranks[bytes([i])] for i in range(256)]
        rows = [(a, b, r) for token, r in self.ranks.items() for i in range(1, len(token)) if (a := self.ranks.get(token[:i])) is not None and (b := self.ranks.get(token[i:])) is not None]
        early = {t for *parts, r in rows for t in parts if r < t}
        self.part = 3 * max(map(len, self.ranks))
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": f"{STEP_MB}MB", "temp_directory": ""})
        merges = pa.table({k: pa.array([x[i] for x in rows], pa.int32()) for i, k in enumerate(("a", "b", "tok"))} | {"early": pa.array([x[2] in early for x in rows])})
        vocabulary = pa.table({"tok": pa.array(list(self.bytes_of), pa.int32()), "hex": pa.array([x.hex() for x in self.bytes_of.values()])})
        for name, data in (("merges", merges), ("vocabulary", vocabulary)):
            self.db.register("given", data)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.held = 0

    def _rows(self, lists: list) -> pa.Table:
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        ends = np.cumsum(sizes)
        toks = np.fromiter((t for x in lists for t in x), np.int32, int(sizes.sum()))
        return pa.table({"word": np.repeat(np.arange(len(lists), dtype=np.int32), sizes), "pos": (np.arange(len(toks)) - np.repeat(ends - sizes, sizes)).astype(np.int32), "tok": toks})

    def _query(self, name: str, rows: pa.Table, sql: str) -> list:
        self.db.register(name, rows)
        try:
            return self.db.execute(sql).fetchall()
        finally:
            self.db.unregister(name)

    def encode_pieces(self, pieces: list[bytes], step: int = STEP_BYTES) -> list[list[int]]:
        """Ids of each piece."""
        out: list = [[self.ranks[p]] if p in self.ranks else None for p in pieces]
        sizes = [len(p) for p in pieces]
        short, long = ([i for i, x in enumerate(out) if x is None and (sizes[i] > self.part) == many] for many in (False, True))
        for part, sql in [*((x, ENCODE) for x in _parts(short, sizes, step)), *((x, ENCODE_LONG.replace("{part}", str(self.part))) for x in _parts(long, sizes, step))]:
            size = sum(len(pieces[i]) for i in part)
            if size > step:
                self.db.execute(f"SET memory_limit = '{STEP_MB * -(-size // step)}MB'")
            for word, ids in self._query("pieces", self._rows([[self.byte[b] for b in pieces[i]] for i in part]), sql):
                out[part[word]] = ids
            if size > step:
                self.db.execute(f"SET memory_limit = '{STEP_MB}MB'")
        return [x or [] for x in out]

    def decode_ids(self, lists: list[list[int]], step: int = STEP_BYTES) -> list[bytes]:
        """The bytes of each list of ids; ids outside the vocabulary raise KeyError."""
        out = [b""] * len(lists)
        for part in _parts(range(len(lists)), [len(x) for x in lists], step):
            met = 0
            for word, text, n in self._query("ids", self._rows([lists[i] for i in part]), "SELECT word, string_agg(hex, '' ORDER BY pos), count(*) FROM ids JOIN vocabulary USING (tok) GROUP BY word"):
                met += n
                out[part[word]] = bytes.fromhex(text)
            if met != sum(len(lists[i]) for i in part):
                raise KeyError("an id is not in the vocabulary")
        return out

    def learn(self, new: list[str]) -> None:
        """Encodes and decodes pieces that are not known yet."""
        ids = self.encode_pieces([p.encode("utf-8", "surrogatepass") for p in new])
        for p, x, b in zip(new, ids, self.decode_ids(ids), strict=True):
            self.known[p] = (np.array(x, "<u4").tobytes(), b)
            self.held += 260 + 6 * len(b)

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """Each text's ids as little-endian unsigned 32-bit integers, and the bytes decoded from them."""
        split = [self.split(t or "") for t in texts]
        met = {p for x in split for p in x}
        new = [p for p in met if p not in self.known]
        if self.held > KNOWN_BYTES:  # forget what these texts do not use
            self.known = {p: x for p in met if (x := self.known.get(p))}
            self.held = sum(260 + 6 * len(b) for _, b in self.known.values())
        self.learn(new)
        found = [[self.known[p] for p in x] for x in split]
        return [(b"".join([y[0] for y in x]), b"".join([y[1] for y in x])) for x in found]


def _parts(items, sizes: list[int], step: int) -> list[list[int]]:
    """Items in runs of at most `step` in all, by their sizes; a larger item is a run of its own."""
    out, room = [], 0
    for i in items:
        if not out or sizes[i] > room:
            out.append([])
            room = step
        out[-1].append(i)
        room -= sizes[i]
    return out


@cache
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document its id and ids array<int>, the tokens of the whole text.

    A null or empty text has an empty list; a null id and repeated rows stay; other columns are not read; an empty table
    gives no rows. Memory holds a batch's pieces, never the corpus's; a piece of any length (a text without white space) is
    one query, whose memory is in proportion to it."""
    return _mapped(docs, path, pattern, id_col, text, "ids array<int>", lambda found: [pa.array([np.frombuffer(a, "<u4").astype(np.int32) for a, _ in found], pa.list_(pa.int32()))])


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document its id, n_tokens long, and the hexadecimal SHA-256 of its ids (little-endian, unsigned, 32 bits) and of the bytes decoded from them."""
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return _mapped(
        docs, path, pattern, id_col, text, "n_tokens long, ids_sha256 string, decoded_sha256 string",
        lambda found: [pa.array([len(a) // 4 for a, _ in found], pa.int64()), pa.array([sha(a) for a, _ in found]), pa.array([sha(b) for _, b in found])],
    )


def _mapped(docs, path, pattern, id_col, text, fields, columns):
    source = docs.select(col(id_col).alias("id"), col(text).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    names = [id_col, *(x.split()[0] for x in fields.split(", "))]

    def make():
        use = encoder(path, pattern)

        def step(batch, most=1000):
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                found = use.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), *columns(found)], names)

        return step

    return map_arrow(source, make, f"{quoted(id_col)} {kind}, {fields}")
