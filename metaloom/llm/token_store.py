"""Token-id output: shards of one concatenated id array with Elias-Fano document boundaries.

A shard holds consecutive documents in ascending doc_id order: a header, the doc_ids and the boundaries as Elias-Fano
sequences, then all ids at 2 or 4 bytes. Elias-Fano keeps n ascending values below u in about n * (2 + log2(u / n)) bits;
a 32-bit sample of every 256th set bit lets select() return any boundary without a table of 64-bit offsets.

Shards are written as the binary column of a table in the shared folder by Spark's own writer, so a store of any kind
does, a lost task leaves nothing behind, and readers see complete shards only. Documents are dealt by ranges of doc_id
before they are encoded, so a text is shuffled once and its ids never are. A shard closes at SHARD_IDS ids (a longer
document has a shard of its own), which bounds what a task holds.

Null texts count as empty: the end id alone. Repeated doc_ids stay together, ordered by their texts' hashes. Rows
without a doc_id have no place in the order and are left out. Extra columns are ignored. Empty input: no shard, no row.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metaloom.llm.shared import SLICE, memo, new_dir

END_ID, SHARD_IDS = 2, 2_000_000
#: Words whose ids a Python worker remembers, at about 250 bytes each.
MEMORY = 800_000
#: ASCII marks; at a word's end a run of them is one piece.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
MAGIC, SAMPLE = b"MLTOK\x01", 256
#: Values whose low bits are packed at a time; a multiple of 8.
PART = 1 << 16
HEAD, EF_HEAD = "<6sBxQQQII", "<QBxxxIQ"


class EliasFano:
    """An ascending sequence of non-negative integers, with random access by select()."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        if not n:
            return cls(0, 0, np.empty(0, np.uint8), np.empty(0, np.uint8), np.empty(0, "<u4"))
        low_bits = max(0, (int(values[-1]) // n).bit_length() - 1)
        low = b"".join(cls._low_part(values[i : i + PART], low_bits) for i in range(0, n, PART)) if low_bits else b""
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(ones[-1]) + 1, np.uint8)
        unary[ones] = 1
        return cls(n, low_bits, np.frombuffer(low, np.uint8), np.packbits(unary, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    @staticmethod
    def _low_part(values: np.ndarray, low_bits: int) -> bytes:
        """The low bits of PART values (whole bytes) or of the last ones."""
        bits = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)).astype(np.uint8) & 1
        return np.packbits(bits.ravel(), bitorder="little").tobytes()

    def to_bytes(self) -> bytes:
        return struct.pack(EF_HEAD, self.n, self.low_bits, len(self.samples), len(self.high)) + self.samples.tobytes() + self.high.tobytes() + self.low.tobytes()

    @classmethod
    def from_bytes(cls, data: memoryview | bytes) -> EliasFano:
        n, low_bits, samples, high = struct.unpack_from(EF_HEAD, data, 0)
        at = struct.calcsize(EF_HEAD)
        marks = np.frombuffer(data, "<u4", samples, at)
        at += 4 * samples
        return cls(n, low_bits, np.frombuffer(data, np.uint8, -1, at + high) if len(data) > at + high else np.empty(0, np.uint8), np.frombuffer(data, np.uint8, high, at), marks)

    def _low_at(self, i: int) -> int:
        value = 0
        for k in range(self.low_bits):
            bit = i * self.low_bits + k
            value |= (int(self.low[bit >> 3]) >> (bit & 7) & 1) << k
        return value

    def select(self, i: int) -> int:
        """Value i: from the sampled set bit before it, over bytes' bit counts, to the bit itself."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        byte = at >> 3
        word = int(self.high[byte]) >> (at & 7) << (at & 7)
        while left >= word.bit_count():
            left -= word.bit_count()
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        position = byte * 8 + (word & -word).bit_length() - 1
        return (position - i) << self.low_bits | self._low_at(i)

    def values(self) -> np.ndarray:
        """All values, as unsigned 64-bit integers."""
        if not self.n:
            return np.empty(0, np.uint64)
        ones = np.nonzero(np.unpackbits(self.high, bitorder="little"))[0][: self.n].astype(np.uint64)
        high = (ones - np.arange(self.n, dtype=np.uint64)) << np.uint64(self.low_bits)
        if not self.low_bits:
            return high
        for i in range(0, self.n, PART):
            k = min(PART, self.n - i)
            bits = np.unpackbits(self.low[i * self.low_bits // 8 :], count=k * self.low_bits, bitorder="little").reshape(k, self.low_bits).astype(np.uint64)
            high[i : i + k] |= (bits << np.arange(self.low_bits, dtype=np.uint64)).sum(1, dtype=np.uint64)
        return high


def pack_shard(doc_ids: list[int], sizes: list[int], ids: bytes, width: int) -> bytes:
    """doc_ids ascending; sizes: ids of each document; ids: all of them, little-endian, width bytes each."""
    first = doc_ids[0] if doc_ids else 0
    docs = EliasFano.of(np.array(doc_ids, np.int64).astype(np.uint64) - np.uint64(first % 2**64)).to_bytes()
    ends = EliasFano.of(np.cumsum(np.array(sizes, np.uint64))).to_bytes()
    return struct.pack(HEAD, MAGIC, width, len(doc_ids), sum(sizes), first % 2**64, len(docs), len(ends)) + docs + ends + ids


class Shard:
    """A shard's documents: doc_id(i), bounds(i), ids(i)."""

    def __init__(self, data: bytes) -> None:
        magic, self.width, self.n_docs, self.n_ids, self._first, a, b = struct.unpack_from(HEAD, data, 0)
        if magic != MAGIC:
            raise ValueError("not a shard")
        view = memoryview(data)
        at = struct.calcsize(HEAD)
        self.doc_set, self.ends = EliasFano.from_bytes(view[at : at + a]), EliasFano.from_bytes(view[at + a : at + a + b])
        self.all_ids = np.frombuffer(view, "<u2" if self.width == 2 else "<u4", self.n_ids, at + a + b)

    def doc_id(self, i: int) -> int:
        x = (self.doc_set.select(i) + self._first) % 2**64
        return x - 2**64 if x >> 63 else x

    def doc_ids(self) -> np.ndarray:
        return (self.doc_set.values() + np.uint64(self._first)).astype(np.int64)

    def bounds(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def ids(self, i: int) -> np.ndarray:
        a, b = self.bounds(i)
        return self.all_ids[a:b]


def encoder(path: str) -> tuple[Callable[[list[str]], list[bytes]], int]:
    """(ids of whole texts as little-endian bytes, bytes an id).

    For tokenizers that drop white space before they cut a text into pieces (word_bpe_49k.json: white space is removed by
    its pattern, and neither its normaliser nor its pattern looks across it), a text's ids are its words' ids in a row.
    The library encodes each distinct word once and a Python worker remembers it. Any other file encodes whole texts.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    width = 2 if tok.get_vocab_size(with_added_tokens=True) <= 65536 else 4
    kind = np.dtype("<u2" if width == 2 else "<u4")
    plain = lambda texts: [np.array(e.ids, kind).tobytes() for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
    if not drops_white_space(path):
        return plain, width
    is_end = np.zeros(tok.get_vocab_size(with_added_tokens=True), bool)
    is_end[[i for t, i in tok.get_vocab(with_added_tokens=False).items() if t.endswith("</w>")]] = True
    kept = memo(f"ids of {path}")

    count = lambda x: len(tok.pre_tokenizer.pre_tokenize_str(x))
    letters: set[str] = set()
    others: set[str] = set()

    def all_letters(word: str) -> bool:
        """Whether the tokenizer takes each character, normalised, for a letter: it joins others and no mark after it."""
        if not letters.issuperset(word):
            for c in set(word) - letters - others:
                form = tok.normalizer.normalize_str(c) if tok.normalizer else c
                (letters if (count(form), count(form + form), count(form + ".")) == (1, 1, 2) else others).add(c)
            return letters.issuperset(word)
        return True

    def learn(words: set[str]) -> None:
        """Letters make one piece with one closing id, so many go into one call and are cut apart at the closing ids.
        Words of letters and marks at their end are two pieces; any other word is encoded on its own."""
        heads = {w: w.rstrip(MARKS) for w in words}
        heads = {w: c for w, c in heads.items() if c and all_letters(c)}
        plainly = {c for c in heads.values() if c not in kept}
        single = {x for x in (w[len(heads.get(w, "")) :] for w in words) if x and x not in kept}
        row = list(plainly)
        chunks = [row[i : i + 2000] for i in range(0, len(row), 2000)]
        for chunk, e in zip(chunks, tok.encode_batch_fast([" ".join(c) for c in chunks], add_special_tokens=False)):
            ids = np.array(e.ids, kind)
            stops = ((np.nonzero(is_end[ids])[0] + 1) * width).tolist()
            if len(stops) != len(chunk):  # a letter that the normaliser turned into more than letters
                single.update(chunk)
                continue
            raw = ids.tobytes()
            kept.update(zip(chunk, [raw[i:j] for i, j in zip([0, *stops], stops)]))
        row = list(single)
        kept.update(zip(row, plain(row)))
        kept.update((w, kept[c] + kept[w[len(c) :]]) for w, c in heads.items() if w not in kept)

    def encode(texts: list[str]) -> list[bytes]:
        # U+001C to U+001F are white space for Python, not for the tokenizer
        split = [None if any(c in t for c in "\x1c\x1d\x1e\x1f") else t.split() for t in texts]
        fresh = set().union(*(w for w in split if w is not None)).difference(kept)
        if len(fresh) > MEMORY // 4:
            return plain(texts) if len(texts) == 1 else [x for t in texts for x in encode([t])]
        if fresh:
            if len(kept) + 2 * len(fresh) > MEMORY:
                kept.clear()
                fresh = set().union(*(w for w in split if w is not None))
            learn(fresh)
        return [plain([t])[0] if w is None else b"".join(map(kept.__getitem__, w)) for t, w in zip(texts, split)]

    return encode, width


def drops_white_space(path: str) -> bool:
    """Whether the file's pattern removes white space and matches none, without special tokens that take some along."""
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    split = parts[0] if parts else {}
    pattern = (split.get("pattern") or {}).get("Regex", "")
    norms = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers") or []]
    added = all(not (t.get("lstrip") or t.get("rstrip") or t.get("single_word") or any(c.isspace() for c in t["content"])) for t in spec.get("added_tokens") or [])
    known = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    return (spec.get("model") or {}).get("end_of_word_suffix") == "</w>" and split.get("type") == "Split" and split.get("behavior") == "Removed" and bool(split.get("invert")) and pattern == known and set(norms) <= {"NFC", "Replace", "Lowercase"} and added and not spec.get("post_processor") and all(p.get("type") == "Split" or not (p.get("add_prefix_space") or p.get("use_regex")) for p in parts)


def write_shards(docs: DataFrame, path: str, out: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> None:
    """Writes the shards of (doc_id, text) to the folder out: part, seq, first_doc, n_docs, n_ids, shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, width = encoder(path)
        end = int(end_id).to_bytes(width, "little")
        part, seq = TaskContext.get().partitionId(), 0
        docs, sizes, ids, n = [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal seq, n
            blob = pack_shard(docs, sizes, b"".join(ids), width)
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([seq], pa.int64()), pa.array([docs[0]], pa.int64()), pa.array([len(docs)], pa.int64()), pa.array([n], pa.int64()), pa.array([blob], pa.binary())], ["part", "seq", "first_doc", "n_docs", "n_ids", "shard"])
            docs.clear(), sizes.clear(), ids.clear()
            seq, n = seq + 1, 0
            return row

        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                piece = batch.slice(i, SLICE)
                texts = [t or "" for t in piece.column("text").to_pylist()]
                for doc, raw in zip(piece.column("doc_id").to_pylist(), encode(texts)):
                    size = len(raw) // width + 1
                    if docs and n + size > shard_ids:
                        yield close()
                    docs.append(doc)
                    sizes.append(size)
                    ids.append(raw + end)
                    n += size
        if docs:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long"), "text").where(F.col("doc_id").isNotNull())
    dealt = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    shards = dealt.mapInArrow(run, "part long, seq long, first_doc long, n_docs long, n_ids long, shard binary")
    shards.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(out)


def read_documents(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the shards in the folder out."""
    shards = spark.read.parquet(out)
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    bases = shards.select("part", "seq", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))  # a row per shard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                shard = Shard(batch.column("shard")[r].as_py())
                ends = shard.ends.values().astype(np.int64)
                starts = np.concatenate((np.zeros(1, np.int64), ends[:-1])) if len(ends) else ends
                crc = [zlib.crc32(shard.all_ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts.tolist(), ends.tolist())]
                n = shard.n_docs
                same = lambda c: pa.array(np.full(n, batch.column(c)[r].as_py(), np.int64))
                yield pa.RecordBatch.from_arrays([same("part"), same("seq"), pa.array(shard.doc_ids()), pa.array(starts), pa.array(ends - starts), pa.array(crc, pa.int64())], ["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"])

    rows = shards.select("part", "seq", "shard").mapInArrow(run, "part long, seq long, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(bases, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, path: str) -> DataFrame:
    """Writes the shards of docs to the shared folder and returns what reading them back gives."""
    out = new_dir(docs.sparkSession, "tokens")
    write_shards(docs, path, out)
    return read_documents(docs.sparkSession, out)
