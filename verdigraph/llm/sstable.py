"""Token-id output: sorted-string-table shards.

Documents are range-partitioned and sorted by identifier; each task writes shards of bounded size. A shard holds prefix-compressed
blocks of (key, ids), a sparse index with the first key of each block, a Bloom filter of the keys, and a footer of fixed length, so a
lookup reads footer, filter, index and one block. A manifest row names a finished shard; files of lost attempts are in no manifest.

Layout (integers little-endian, varint = LEB128):
  block   entries: shared varint, rest varint, ids varint, key bytes that are not shared, ids of ``width`` bytes; then crc32 of these
  index   for each block: key length varint, first key, offset varint, length varint
  bloom   bits, as bytes
  footer  index offset, index length, bloom offset, bloom length, blocks, entries, ids (8 bytes each), width, hashes (4 bytes each), magic

Keys: an identifier is 8 bytes, big-endian, with its sign bit turned, so bytes sort as numbers; a null one is the empty key and comes
first. Defined results: a null text is an empty one, and gives the end id alone; repeated identifiers are entries of their own, ordered
by length and text; an empty table gives no shard and no row; further columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import uuid
import zlib
from array import array
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import opened, parts, released, scratch_path, stored, table

MAGIC = b"VGSST001"
BLOCK_BYTES = 1 << 16
SHARD_BYTES = 64 << 20
BLOOM_BITS, BLOOM_HASHES = 10, 7
FOOTER = 7 * 8 + 2 * 4 + len(MAGIC)
SIGN = 1 << 63


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else ((doc_id + SIGN) & (2 * SIGN - 1)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key, "big") - SIGN if key else None


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def probes(key: bytes, bits: int, hashes: int) -> list[int]:
    a, b = xxhash.xxh64_intdigest(key, 1), xxhash.xxh64_intdigest(key, 2) | 1
    return [(a + i * b) % bits for i in range(hashes)]


class ShardWriter:
    """Writes entries, given in key order, to a binary stream."""

    def __init__(self, out, width: int) -> None:
        self.out, self.width, self.at = out, width, 0
        self.block, self.last, self.first = bytearray(), b"", None
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.ids = 0

    def add(self, key: bytes, ids: bytes) -> None:
        shared = len(os.path.commonprefix([self.last, key])) if self.block else 0
        if not self.block:
            self.first = key
        n = len(ids) // self.width
        self.block += varint(shared) + varint(len(key) - shared) + varint(n) + key[shared:] + ids
        self.last = key
        self.keys.append(key)
        self.ids += n
        if len(self.block) >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.block:
            data = bytes(self.block) + zlib.crc32(self.block).to_bytes(4, "little")
            self.out.write(data)
            self.index.append((self.first, self.at, len(data)))
            self.at += len(data)
            self.block = bytearray()

    def close(self) -> int:
        self.flush()
        index = b"".join(varint(len(k)) + k + varint(at) + varint(n) for k, at, n in self.index)
        bits = max(64, -(-len(self.keys) * BLOOM_BITS // 8) * 8)
        bloom = bytearray(bits // 8)
        for key in self.keys:
            for p in probes(key, bits, BLOOM_HASHES):
                bloom[p >> 3] |= 1 << (p & 7)
        tail = [self.at, len(index), self.at + len(index), len(bloom), len(self.index), len(self.keys), self.ids]
        self.out.write(index + bytes(bloom) + b"".join(x.to_bytes(8, "little") for x in tail) + self.width.to_bytes(4, "little") + BLOOM_HASHES.to_bytes(4, "little") + MAGIC)
        return self.at + len(index) + len(bloom) + FOOTER


class ShardReader:
    """Reads a shard from a random-access file: all entries in order, or those of one identifier."""

    def __init__(self, file) -> None:
        self.file = file
        size = file.size()
        foot = self._read(size - FOOTER, FOOTER)
        if foot[-len(MAGIC) :] != MAGIC:
            raise ValueError("not a shard")
        n = [int.from_bytes(foot[i * 8 : i * 8 + 8], "little") for i in range(7)]
        self.index_at, self.index_len, self.bloom_at, self.bloom_len, self.blocks, self.entries, self.ids = n
        self.width, self.hashes = (int.from_bytes(foot[i : i + 4], "little") for i in (56, 60))
        data, at = self._read(self.index_at, self.index_len), 0
        self.first, self.where = [], []
        for _ in range(self.blocks):
            k, at = read_varint(data, at)
            self.first.append(data[at : at + k])
            off, at = read_varint(data, at + k)
            length, at = read_varint(data, at)
            self.where.append((off, length))

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def block(self, i: int):
        data = self._read(*self.where[i])
        body = data[:-4]
        if zlib.crc32(body) != int.from_bytes(data[-4:], "little"):
            raise ValueError(f"block {i} is damaged")
        at, key = 0, b""
        while at < len(body):
            shared, at = read_varint(body, at)
            rest, at = read_varint(body, at)
            n, at = read_varint(body, at)
            key = key[:shared] + body[at : at + rest]
            at += rest
            yield key, body[at : at + n * self.width]
            at += n * self.width

    def __iter__(self):
        for i in range(self.blocks):
            yield from self.block(i)

    def may_hold(self, key: bytes) -> bool:
        bloom = self._read(self.bloom_at, self.bloom_len)
        return all(bloom[p >> 3] >> (p & 7) & 1 for p in probes(key, len(bloom) * 8, self.hashes))

    def lookup(self, doc_id: int | None) -> list[bytes]:
        key = key_of(doc_id)
        if not self.may_hold(key):
            return []
        i = max(0, bisect_right(self.first, key) - 1)
        while i > 0 and self.first[i] == key:  # entries with equal keys may start in an earlier block
            i -= 1
        found = []
        while i < self.blocks and self.first[i] <= key:
            found += [ids for k, ids in self.block(i) if k == key]
            i += 1
        return found


def lowers_and_drops_blanks(told: dict) -> bool:
    """Whether a tokenizers file's rules reach over no blank and lower-case first, so that words between blanks can be encoded alone: the
    normaliser composes, replaces white space and lower-cases, the splitter keeps what its pattern finds and no white space, added tokens
    are found in the raw text, and nothing comes after the model."""
    normal, split = told.get("normalizer") or {}, told.get("pre_tokenizer") or {}
    steps = [(n["type"], n.get("pattern"), n.get("content")) for n in normal.get("normalizers", [])]
    cuts = split.get("pretokenizers", [])
    return (
        steps == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
        and [c["type"] for c in cuts] == ["Split", "ByteLevel"]
        and (cuts[0]["behavior"], cuts[0]["invert"], cuts[0]["pattern"]) == ("Removed", True, {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"})
        and not (cuts[1]["add_prefix_space"] or cuts[1]["use_regex"])
        and not any(told.get(k) for k in ("truncation", "padding", "post_processor"))
        and told["model"]["type"] == "BPE" and not any(told["model"].get(k) for k in ("dropout", "ignore_merges", "byte_fallback"))
        and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in told.get("added_tokens", []))
    )


class WordEncoder:
    """Ids of texts by a tokenizers file, as bytes: what the library gives with add_special_tokens=False.

    Where :func:`lowers_and_drops_blanks` holds of the file, pieces between blanks are encoded once and kept. A piece that is one run of
    lower-case Latin letters, with at most one full stop or comma behind it, is what normaliser and splitter would leave of it, so its runs
    go to the file's BPE model at once. A text that holds an added token, and any text of another kind of file, goes to the library whole."""

    def __init__(self, path: str, width: int, keep: int = 400_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        self.by_word, self.added = lowers_and_drops_blanks(told), [t["content"] for t in told.get("added_tokens", [])]
        self.model = self.tokenizer.model
        self.kind, self.keep, self.known = "H" if width == 2 else "I", keep, {}
        if self.by_word:
            as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            latin = [c for c in map(chr, range(0x61, 0x250)) if unicodedata.category(c) in ("Ll", "Lo") and self.tokenizer.normalizer.normalize_str(c) == c]
            self.letters = {ord(c): as_bytes.pre_tokenize_str(c)[0][0] for c in latin}
            self.plain = re.compile(f"([{''.join(latin)}]+)([.,]?)")

    def _coded(self, ids: list[int]) -> bytes:
        return array(self.kind, ids).tobytes()

    def _learn(self, new: list[bytes]) -> None:
        rest = []
        for piece in new:
            if m := self.plain.fullmatch(word := piece.decode("utf-8", "surrogatepass")):
                ids = [t.id for t in self.model.tokenize(m[1].translate(self.letters))]
                if m[2]:
                    ids += [t.id for t in self.model.tokenize(m[2])]
                self.known[piece] = self._coded(ids)
            else:
                rest.append((piece, word))
        for i in range(0, len(rest), 20_000):
            some = rest[i : i + 20_000]
            for (piece, _), got in zip(some, self.tokenizer.encode_batch_fast([w for _, w in some], add_special_tokens=False)):
                self.known[piece] = self._coded(got.ids)

    def __call__(self, texts: list[str]) -> list[bytes]:
        whole = [i for i, t in enumerate(texts) if not self.by_word or any(x in t for x in self.added)]
        apart = set(whole)
        split = [[] if i in apart else t.encode("utf-8", "surrogatepass").lower().split() for i, t in enumerate(texts)]
        if len(self.known) > self.keep:
            self.known.clear()
        self._learn([x for x in set().union(*split) if x not in self.known])
        out = [b"".join(map(self.known.__getitem__, pieces)) for pieces in split]
        for i in whole:
            out[i] = self._coded(self.tokenizer.encode(texts[i], add_special_tokens=False).ids)
        return out


_open: dict[tuple[str, int], WordEncoder] = {}


def encoder(path: str, width: int) -> WordEncoder:
    """One for each Python worker, which runs one task at a time."""
    if (path, width) not in _open:
        _open[path, width] = WordEncoder(path, width)
    return _open[path, width]


MANIFEST = "part int, seq int, path string, entries long, n_ids long, bytes long"


def write_shards(docs: DataFrame, key: str, text: str, tokenizer: str, end_id: int, folder: str, width: int = 2, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encodes docs and writes them as shards in ascending key order; the manifest, a row for each shard."""
    ordered = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).repartitionByRange(parts(docs.sparkSession), "k", F.length("t")).sortWithinPartitions("k", F.length("t"), "t")

    def write(batches):
        try:
            yield from written(batches)
        finally:
            encoder(tokenizer, width).known.clear()

    def written(batches):
        encode, end = encoder(tokenizer, width), end_id.to_bytes(width, "little")
        part, seq, writer = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            while at < len(keys):
                upto, chars = at, 0
                while upto < len(keys) and (upto == at or chars < 1 << 20):
                    chars += len(texts[upto])
                    upto += 1
                for k, ids in zip(keys[at:upto], encode(texts[at:upto])):
                    if writer is None:
                        path = f"{folder}/shard-{part:06d}-{seq:04d}-{uuid.uuid4().hex}.sst"
                        out = opened(path, True)
                        writer = ShardWriter(out, width)
                    writer.add(key_of(k), ids + end)
                    if writer.at >= shard_bytes:
                        size = writer.close()
                        out.close()
                        yield manifest(part, seq, path, writer, size)
                        writer, seq = None, seq + 1
                at = upto
        if writer is not None:
            size = writer.close()
            out.close()
            yield manifest(part, seq, path, writer, size)

    def manifest(part, seq, path, writer, size):
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((part, pa.int32()), (seq, pa.int32()), (path, pa.string()), (len(writer.keys), pa.int64()), (writer.ids, pa.int64()), (size, pa.int64()))], ["part", "seq", "path", "entries", "n_ids", "bytes"])

    return stored(ordered.mapInArrow(released(write), MANIFEST), "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """Every entry of the shards: doc_id, start (ids before it), n_tokens, ids_crc32 of its ids as unsigned 32-bit integers."""
    starts = manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    n = parts(manifest.sparkSession)

    def read(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with opened(path) as file:
                    shard = ShardReader(file)
                    for i in range(shard.blocks):
                        rows = []
                        for key, ids in shard.block(i):
                            n_ids = len(ids) // shard.width
                            rows.append((id_of(key), start, n_ids, zlib.crc32(np.frombuffer(ids, f"<u{shard.width}").astype("<u4").tobytes())))
                            start += n_ids
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return starts.select("path", "start").repartition(n, "path").mapInArrow(released(read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_sstable_token_shards(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = scratch_path(spark, "shards")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return read_shards(write_shards(docs, "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"), 1, folder))
