"""Token counts, with overlap resynchronisation for huge documents.

A text of up to HUGE code points is cut at all such boundaries as named below, and a Python worker remembers the counts
of the pieces between them, so the library encodes each distinct piece once. A longer one is encoded in chunks. Around each cut an overlap is encoded twice with
offsets, once from before the cut and once from a boundary in it, and the chunks are spliced there if it is proven
stable: a space with no white space beside it, where both encodings start a token, after which they agree token
by token up to the end of the overlap. The pre-tokenizer's pattern has no
look-behind and no alternative that runs from a non-space into a space, so such a space always starts a pre-token, and
what follows depends on the text from there on only. Where no boundary lies in the overlap or the encodings disagree,
the overlap is widened; at worst the document is encoded whole. Tokenizers with any other pre-tokenizer encode whole.

Null counts as empty: 0 bytes, 0 tokens. Strings of special tokens inside texts are handled as the library does by
default. Repeated rows each get their count; a count does not depend on other rows, so there are no ties. An empty table
gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaloom.llm.shared import memo

HUGE, CHUNK, OVERLAP, LIMIT = 32_768, 16_384, 256, 512
BATCH = 128
#: Pieces whose counts a Python worker remembers, at about 150 bytes each.
MEMORY = 1_000_000
#: A space among white space, or after it at the end, may belong to a longer run; such texts are encoded whole.
RUN = re.compile(r"\s (?:\s|\Z)")


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _starts(tok, text: str) -> np.ndarray:
    return np.fromiter((a for a, _ in tok.encode(text, add_special_tokens=False).offsets), np.int64)


def _boundary(tok, text: str, left: np.ndarray, high: int, after: int, tries: int = 4) -> int:
    """A stable boundary p > after, or -1. left: token starts, as places in the text, of an encoding that ends at high
    and began before. From p on, an encoding that begins at p has to agree with it, but for what the cut at high may
    change."""
    if not len(left) or (np.diff(left) < 0).any():
        return -1
    for s in sorted(left.tolist(), key=lambda x: abs(x - (left[0] + high) // 2)):
        p = s if text[s] == " " else s - 1  # with the space or, where offsets are trimmed, without
        if p > after and p + 1 < high and text[p] == " " and not text[p - 1].isspace() and not text[p + 1].isspace():
            right = _starts(tok, text[p:high]) + p
            mine, other = left[(left >= s) & (left < high - 32)], right[right < high - 32]
            if len(mine) >= 8 and np.array_equal(mine, other):
                return p
            tries -= 1
            if not tries:
                break
    return -1


def count_in_chunks(tok, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of the whole text; equal to encoding it at once."""
    n, base, parts = len(text), 0, []
    while n - base > chunk + overlap:
        p, wide = -1, overlap
        while p < 0:
            low, high = max(base, base + chunk - wide), min(n, base + chunk + wide)
            p = _boundary(tok, text, _starts(tok, text[low:high]) + low, high, max(base, low))
            if p < 0 and low == base and high == n:
                break
            wide *= 4
        if p < 0:
            break
        parts.append(text[base:p])
        base = p
    parts.append(text[base:])
    return sum(len(e) for e in tok.encode_batch_fast(parts, add_special_tokens=False))


def resynchronises(path: str) -> bool:
    """Whether the tokenizer file is of the kind that the proof covers: byte-level with the usual pattern, no normaliser."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    plain = all(not (t.get("lstrip") or t.get("rstrip") or t.get("single_word") or " " in t["content"]) for t in spec.get("added_tokens") or [])
    return not spec.get("normalizer") and pre.get("type") == "ByteLevel" and bool(pre.get("use_regex")) and plain and not spec.get("truncation")


def counter(path: str, huge: int = HUGE) -> Callable[[list[str]], list[int]]:
    """Counts for texts, by the library of the file."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    splits = resynchronises(path)

    whole = lambda texts: [len(e) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
    if not splits:
        return whole
    kept = memo(f"counts of {path}")

    def count(texts: list[str]) -> list[int]:
        """A space after a non-space, or before one, starts a pre-token: a text's count is the sum over the pieces that
        begin at its spaces. kept has the counts of pieces by what follows their space."""
        rows = [None if len(t) > huge or RUN.search(t) else t.split(" ") for t in texts]
        fresh = set().union(*(r[1:] for r in rows if r)).difference(kept)
        if len(fresh) > MEMORY // 4:
            return whole(texts) if len(texts) == 1 else [n for t in texts for n in count([t])]
        if len(kept) + len(fresh) > MEMORY:
            kept.clear()
            fresh = set().union(*(r[1:] for r in rows if r))
        if fresh:
            row = list(fresh)
            kept.update(zip(row, whole([f" {w}" for w in row])))
        heads = whole([r[0] if r else "" for r in rows])
        return [count_in_chunks(tok, t) if len(t) > huge else whole([t])[0] if r is None else n + sum(map(kept.__getitem__, r[1:])) for t, r, n in zip(texts, rows, heads)]

    return count


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: a row per document. path: a tokenizer file that every executor has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                part = batch.slice(i, BATCH)
                texts = [t or "" for t in part.column("text").to_pylist()]
                n = count(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
