"""Byte-level BPE encoding and decoding with DuckDB recursive queries, one database per Python worker.

A text is cut by the pattern of the rank file; each distinct piece is encoded once while it is kept. A piece that is a token is its rank, as the
format has it. In the database any other piece is a set of token-position rows. A recursive query joins each position and the next with the
merge table, takes each piece's minimum rank, and contracts its leftmost pair of that rank; rounds go on until no piece has a pair. Decoding
aggregates the tokens' bytes in order.

Rounds grow with a piece's length, so a piece over ``SHORT_BYTES`` is contracted in windows. Contraction inside a stretch whose ends are never
crossed doesn't depend on what lies outside. Hence a row of tokens is a text's encoding if, and only if, each two neighbours are the
encoding of their joined bytes. Two windows that share a token therefore continue each other there. Where they share none (runs of one
sign), the next window starts at an end of a token of this one, such that the two tokens at that place pass this test. Time is proportional
to the length. If no place passes, the whole piece is contracted, all pairs of the least rank in a round where that is provably the same.

Defined results: null and empty texts have no ids and decode to no bytes; special tokens are ordinary text; further columns pass
through where they are asked for.
"""

from __future__ import annotations

import base64
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import release, released, table

ROUNDS = 24
#: Pieces kept by a task, rows that a query's rounds may make, and pieces decoded at a time.
KEEP, QUERY_ROWS, DECODED = 80_000, 500_000, 20_000
LONG_PIECE = 64
#: Longest piece, or window of a piece, that is contracted pair by pair; and the bytes by which windows overlap.
SHORT_BYTES, OVERLAP = 64, 24

#: Short pieces: the leftmost pair of the least rank, one a round.
#: Rows know the next position and its token, so a round needs no sort: rank, position and next position of a piece's pick are one number.
CONTRACT_ONE = f"""
WITH RECURSIVE state(round, w, pos, id, nextpos, after) AS (
  SELECT 0, w, pos, id, nextpos, after FROM start
  UNION ALL
  (WITH pick AS (
     SELECT s.w, min((m.made << 40) | (s.pos << 20) | s.nextpos) AS best
     FROM state s JOIN merges m ON m.l = s.id AND m.r = s.after WHERE s.round < {ROUNDS} GROUP BY s.w),
   pair AS (
     SELECT p.w, p.best >> 40 AS made, (p.best >> 20) & 1048575 AS pos, p.best & 1048575 AS gone, s.nextpos, s.after
     FROM pick p JOIN state s ON s.w = p.w AND s.pos = p.best & 1048575)
   SELECT s.round + 1, s.w, s.pos, CASE WHEN s.pos = p.pos THEN p.made ELSE s.id END, CASE WHEN s.pos = p.pos THEN p.nextpos ELSE s.nextpos END,
          CASE WHEN s.pos = p.pos THEN p.after WHEN s.nextpos = p.pos THEN p.made ELSE s.after END
   FROM state s JOIN pair p ON s.w = p.w WHERE s.pos <> p.gone))
SELECT s.w, s.pos, s.id, s.round FROM state s JOIN (SELECT w, max(round) AS round FROM state GROUP BY w) f ON s.w = f.w AND s.round = f.round
ORDER BY (s.w << 20) | s.pos
"""
#: Pieces of any length: all pairs of the least rank from the left, where that is the same.
CONTRACT_ALL = f"""
WITH RECURSIVE state(round, w, pos, id) AS (
  SELECT 0, w, pos, id FROM start
  UNION ALL
  SELECT round + 1, w, pos, CASE WHEN chosen THEN made ELSE id END FROM (
    SELECT *, coalesce(lag(chosen) OVER (PARTITION BY w ORDER BY pos), false) AS eaten FROM (
      SELECT *, here = best >> 32 AND (here << 32 | idx) >= best AND (idx - coalesce(gap, 0)) % 2 = 1 AND (whole OR (here << 32 | idx) = best) AS chosen FROM (
        SELECT *, max(CASE WHEN here IS NULL OR here <> best >> 32 THEN idx END) OVER (PARTITION BY w ORDER BY pos) AS gap FROM (
          SELECT *, min(here << 32 | idx) OVER (PARTITION BY w) AS best FROM (
            SELECT s.round, s.w, s.pos, s.id, s.idx, m.made, m.made AS here, m.whole
            FROM (SELECT *, lead(id) OVER (PARTITION BY w ORDER BY pos) AS after, row_number() OVER (PARTITION BY w ORDER BY pos) AS idx FROM state WHERE round < {ROUNDS}) s
            LEFT JOIN merges m ON m.l = s.id AND m.r = s.after))
        WHERE best IS NOT NULL)))
  WHERE NOT eaten)
SELECT w, pos, id, round FROM (SELECT *, max(round) OVER (PARTITION BY w) AS last FROM state) WHERE round = last ORDER BY w, pos
"""


def cut_by_rows(pieces: list, rows: int):
    """Runs of pieces, in their order, whose rounds make about so many rows at most."""
    at = size = 0
    for i, p in enumerate(pieces):
        size += len(p) * min(len(p), ROUNDS)
        if size >= rows:
            yield pieces[at : i + 1]
            at, size = i + 1, 0
    if at < len(pieces):
        yield pieces[at:]


class DuckBPE:
    """Ids and decoded bytes of pieces, by the ranks of a tiktoken file."""

    def __init__(self, path: str) -> None:
        import duckdb

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        left, right, made, unsafe = [], [], [], set()
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(rank)
                    unsafe |= {x for x in (a, b) if x > rank}
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "256MB", "temp_directory": ""})
        whole = [r not in unsafe for r in made]
        merges = pa.table({"l": pa.array(left, pa.int64()), "r": pa.array(right, pa.int64()), "made": pa.array(made, pa.int64()), "whole": pa.array(whole)})  # noqa: F841
        tokens = pa.table({"id": pa.array(list(self.ranks.values()), pa.int64()), "bytes": pa.array([t.hex() for t in self.ranks], pa.string())})  # noqa: F841
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges")
        self.db.execute("CREATE TABLE tokens AS SELECT * FROM tokens")
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.seen: dict[bytes, list[int]] = {}
        self.stage: int | None = None
        self.forget()
        del left, right, made, whole, merges, tokens
        release()

    def ids(self, pieces: list[bytes], whole: bool = False) -> pa.Table:
        """w, pos, id of pieces, which are not empty and of SHORT_BYTES at most, or any length if ``whole``."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        w = np.repeat(np.arange(len(pieces)), lengths)
        pos = np.arange(len(w)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        start = pa.table({"w": w, "pos": pos, "id": self.bytes[np.frombuffer(b"".join(pieces), np.uint8)]})
        done = []
        while start.num_rows:
            w, pos, id_ = (start.column(c).to_numpy() for c in ("w", "pos", "id"))
            inside = np.append(w[1:] == w[:-1], False)
            self.db.register("start", pa.table({"w": w, "pos": pos, "id": id_, "nextpos": np.where(inside, np.append(pos[1:], 0), -1), "after": np.where(inside, np.append(id_[1:], 0), -1)}))
            out = self.db.sql(CONTRACT_ALL if whole else CONTRACT_ONE).to_arrow_table()
            self.db.unregister("start")
            more = out.column("round").to_numpy() >= ROUNDS
            done.append((out.filter(pa.array(~more)) if more.any() else out).select(["w", "pos", "id"]))
            start = out.filter(pa.array(more)).select(["w", "pos", "id"])
        return done[0] if len(done) == 1 else pa.concat_tables(done).sort_by([("w", "ascending"), ("pos", "ascending")])

    def _contracted(self, pieces: list[bytes]) -> None:
        """Puts the ids of short pieces into ``seen``, by queries of bounded size."""
        for some in cut_by_rows(sorted({p for p in pieces if p not in self.seen}, key=len), QUERY_ROWS):
            rows = self.ids(some)
            ids = rows.column("id").to_pylist()
            ends = np.cumsum(np.bincount(rows.column("w").to_numpy(), minlength=len(some))).tolist()
            self.seen.update(zip(some, map(ids.__getitem__, map(slice, [0, *ends[:-1]], ends))))

    def _window(self, piece: bytes, at: int) -> tuple[list[int], list[int]]:
        """Ids, and ends in the piece, of the window that begins at ``at``."""
        self._contracted([some := piece[at : at + SHORT_BYTES]])
        ids = self.seen[some]
        return ids, (at + np.cumsum([len(self.tokens[i]) for i in ids])).tolist()

    def _fit(self, a: int, b: int) -> bool:
        """Whether two tokens are the encoding of their joined bytes."""
        both = self.tokens[a] + self.tokens[b]
        if len(both) > SHORT_BYTES:
            return self.ids([both], True).column("id").to_pylist() == [a, b]
        self._contracted([both])
        return self.seen[both] == [a, b]

    def _joined(self, piece: bytes) -> list[int]:
        """Ids of a long piece whose windows of the grid are in ``seen``."""
        step, n = SHORT_BYTES - OVERLAP, len(piece)
        out, at = [], 0  # ids up to the current window's first used token, whose index is at
        ids, ends = self._window(piece, 0)
        while ends[-1] < n:
            grid = (ends[-1] - OVERLAP) // step * step
            found = None
            if grid + SHORT_BYTES > ends[-1]:
                ids2, ends2 = self._window(piece, grid)
                there = {(e - len(self.tokens[i]), e): k for k, (i, e) in enumerate(zip(ids2, ends2))}
                for k in range(len(ids) - 1, at - 1, -1):
                    if (same := there.get((ends[k] - len(self.tokens[ids[k]]), ends[k]))) is not None and same + 1 < len(ids2):
                        found = k, same + 1, ids2, ends2
                        break
            if not found:
                for k in range(len(ids) - 1, at - 1, -1):
                    ids2, ends2 = self._window(piece, ends[k])
                    if self._fit(ids[k], ids2[0]):
                        found = k, 0, ids2, ends2
                        break
            if not found:
                return self.ids([piece], True).column("id").to_pylist()
            out += ids[at : found[0] + 1]
            _, at, ids, ends = found
        return out + ids[at:]

    def decode(self, rows: pa.Table) -> list[bytes]:
        """The bytes of each w of rows (w, pos, id), in order of w."""
        self.db.register("coded", rows)
        got = self.db.sql("SELECT unhex(string_agg(t.bytes, '' ORDER BY c.pos)) AS b FROM coded c JOIN tokens t USING (id) GROUP BY c.w ORDER BY c.w").to_arrow_table()
        self.db.unregister("coded")
        return got.column("b").to_pylist()

    def _keep(self, pieces: list[str], rows: pa.Table) -> None:
        """Takes the rows (w, pos, id) of pieces."""
        ids = rows.column("id").to_numpy().astype("<u4").tobytes()
        ends = 4 * np.cumsum(np.bincount(rows.column("w").to_numpy(), minlength=len(pieces)))
        cut = map(slice, [0, *ends[:-1].tolist()], ends.tolist())
        self.ids_of.update(zip(pieces, map(ids.__getitem__, cut)))
        self.text_of.update(zip(pieces, self.decode(rows)))

    def learn(self, pieces: list[str]) -> None:
        coded = {p: p.encode("utf-8", "surrogatepass") for p in pieces}
        lists = {p: [self.ranks[c]] for p, c in coded.items() if c in self.ranks}
        short = sorted((p for p, c in coded.items() if p not in lists and len(c) <= SHORT_BYTES), key=len)
        long_ = [p for p, c in coded.items() if p not in lists and len(c) > SHORT_BYTES]
        for some in cut_by_rows(short, QUERY_ROWS):
            self._keep(some, self.ids([coded[p] for p in some]))
        self._contracted([coded[p][i : i + SHORT_BYTES] for p in long_ for i in range(0, len(coded[p]), SHORT_BYTES - OVERLAP)])
        lists |= {p: self._joined(coded[p]) for p in long_}
        self.seen.clear()
        names = list(lists)
        for first in range(0, len(names), DECODED):
            some = names[first : first + DECODED]
            n = np.fromiter((len(lists[p]) for p in some), np.int64, len(some))
            ids = np.fromiter(chain.from_iterable(lists[p] for p in some), np.int64, n.sum())
            self._keep(some, pa.table({"w": np.repeat(np.arange(len(some)), n), "pos": np.arange(len(ids)), "id": ids}))

    def forget(self) -> None:
        self.ids_of, self.text_of, self.old = {}, {}, ({}, {})

    def __call__(self, texts: list[bytes], pattern) -> list[tuple[bytes, bytes]]:
        """Of each text, the ids as little-endian unsigned 32-bit integers, and the bytes that they decode to. Of the pieces seen, those of
        the last KEEP to twice KEEP are kept."""
        split = [pattern.findall(t.decode("utf-8", "surrogatepass")) for t in texts]
        if len(self.ids_of) > KEEP:
            self.ids_of, self.text_of, self.old = {}, {}, (self.ids_of, self.text_of)
        new = set().union(*split).difference(self.ids_of)
        again = new.intersection(self.old[0])
        for now, before in zip((self.ids_of, self.text_of), self.old):
            now.update(zip(again, map(before.__getitem__, again)))
        self.learn(list(new - again))
        out = [(b"".join(map(self.ids_of.__getitem__, pieces)), b"".join(map(self.text_of.__getitem__, pieces))) for pieces in split]
        for x in new:  # long pieces hardly come again
            if len(x) > LONG_PIECE:
                del self.ids_of[x], self.text_of[x]
        return out


_open: dict[str, DuckBPE] = {}


def coder(path: str, stage: int | None = None) -> DuckBPE:
    """The merge table of a file, loaded once by each Python worker. What was encoded in another stage is forgotten."""
    if path not in _open:
        _open[path] = DuckBPE(path)
    if _open[path].stage != stage:
        _open[path].forget()
        _open[path].stage = stage
    return _open[path]


def close(path: str) -> None:
    """Drops a worker's merge table and what its database holds: an idle worker would keep them beside other stages."""
    if bpe := _open.pop(path, None):
        bpe.forget()
        bpe.db.close()


def encoded(docs: DataFrame, text: str, ranks: str, pattern: str, keep: list[str], rows: int = 256, hold: bool = False, compared: bool = False) -> DataFrame:
    """The columns ``keep`` of docs, with ids (little-endian unsigned 32-bit integers) and decoded (bytes). hold: a worker's pieces stay for
    the stage's next tasks, within the same bound; else they and the merge table go with the task. compared: in place of decoded, round_trip, which says whether
    that is the text; neither is sent back then."""
    told = T.StructField("round_trip", T.BooleanType()) if compared else T.StructField("decoded", T.BinaryType())
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("ids", T.BinaryType()), told])

    def run(batches):
        import regex

        task = TaskContext.get()
        bpe, cut = coder(ranks, task.stageId() if task else None), regex.compile(pattern)
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, rows):
                    part = batch.slice(at, rows)
                    texts = [x or b"" for x in part.column(part.num_columns - 1).cast(pa.large_binary()).to_pylist()]
                    got = bpe(texts, cut)
                    back = pa.array([b == t for (_, b), t in zip(got, texts)], pa.bool_()) if compared else pa.array([b for _, b in got], pa.binary())
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([a for a, _ in got], pa.binary()), back], [*keep, "ids", told.name])
                    del texts, got, back
                    if not hold:  # other stages' memory is beside this one's
                        release(cycles=False)
        finally:
            if not hold:
                close(ranks)

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(released(run), schema)


def op8_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encoded(docs, "text", public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ["doc_id"], hold=True)
    return out.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
