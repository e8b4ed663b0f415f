"""Packing by minimum bin slack: each window takes the remaining lengths whose sum comes closest to its capacity.

The lengths still to be placed are a multiset. A bitset whose bit s says that
some of them add up to s is filled length by length; the highest bit is the
best sum, and going back through the bitsets gives how often each length is
used. Every window starts with the largest length left, since long pieces that
are put off meet no short ones to go with; the bitset fills the rest of it. The
same choice is repeated for as long as the counts allow.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter, deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from laneflow.llm.base import ship_code

END_ID = 1
CUT = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
DEAL = "deal long"  # 0 for the first of equal pieces in a task, else a number of its own


def best_window(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """The (length, times) with the largest sum within the capacity; longer lengths are tried first."""
    full, reach, steps = (1 << (capacity + 1)) - 1, 1, []
    target = 1 << capacity
    for length in sorted(counts, reverse=True):
        many, part = min(counts[length], capacity // length), 1
        while many > 0:  # counts in powers of two, so each step uses its part or not
            part = min(part, many)
            steps.append((reach, length, part))
            reach |= (reach << (length * part)) & full
            many, part = many - part, part * 2
        if reach & target:
            break
    left, used = reach.bit_length() - 1, Counter()
    for before, length, part in reversed(steps):
        if not before >> left & 1:
            used[length] += part
            left -= length * part
    return list(used.items())


def pack_lengths(lengths: list[int], capacity: int) -> list[list[int]]:
    """Windows as lists of positions in `lengths`; every length is between 1 and the capacity."""
    waiting: dict[int, deque[int]] = {}
    for i, length in enumerate(lengths):
        waiting.setdefault(length, deque()).append(i)
    counts = {length: len(w) for length, w in waiting.items()}
    windows = []
    while counts:
        largest = max(counts)
        others = Counter(counts)
        others[largest] -= 1
        used = Counter(dict(best_window(+others, capacity - largest)))
        used[largest] += 1
        chosen = list(used.items())
        for _ in range(min(counts[length] // times for length, times in chosen)):
            windows.append([waiting[length].popleft() for length, times in chosen for _ in range(times)])
        for length, _ in chosen:
            counts[length] = len(waiting[length])
            if not counts[length]:
                del counts[length]
    return windows


# The byte-level pre-tokenizer's fixed pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PROBE = "It's 3 o'clock:\n\n  naïve  übergroß_words %%% 1234.5 日本語 \U0001F600 <|endoftext|>\t."


def byte_symbols() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others
    for the code points from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def encoder(path: str) -> Callable[[str], list[int]]:
    """Token ids of a text by the tokenizer file at `path`, special tokens' strings being ordinary text.

    Byte-level vocabularies in which a later merge has a higher id, as is usual,
    are run by a byte-pair encoder that is several times as fast on the same
    vocabulary, once it has given the same ids for a probe; all others by the
    file's own tokenizer.
    """
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True

    def plain(text: str) -> list[int]:
        return tokenizer.encode(text, add_special_tokens=False).ids

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    before, vocabulary = spec.get("pre_tokenizer") or {}, spec["model"].get("vocab")
    if (
        spec["model"].get("type", "BPE") != "BPE" or spec.get("normalizer") or before.get("type") != "ByteLevel"
        or before.get("add_prefix_space") or not before.get("use_regex", True)
    ):
        return plain
    pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    merged = [vocabulary.get(a + b, -1) for a, b in pairs]
    symbols, special = byte_symbols(), {t["content"] for t in spec.get("added_tokens", [])}
    if any(x >= y for x, y in zip(merged, merged[1:])):
        return plain
    ranks = {bytes(symbols[c] for c in token): i for token, i in vocabulary.items() if token not in special}
    fast = tiktoken.Encoding("of-file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return fast if fast(PROBE) == plain(PROBE) else plain


def cut_documents(docs: DataFrame, path: str, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """Pieces of at most `capacity` ids: whole windows, then the rest. The end id 1 follows each document."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, task = encoder(path), TaskContext.get().partitionId()
        seen: Counter = Counter()
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = np.array([*encode(text or ""), END_ID], dtype="<u4")
                for start in range(0, len(ids), capacity):
                    piece = ids[start : start + capacity]
                    crc = zlib.crc32(piece.tobytes())
                    copy = seen[hash((str(doc_id), start, crc))]
                    seen[hash((str(doc_id), start, crc))] += 1
                    out.append((doc_id, start, len(piece), crc, len(ids), copy and (task << 32) + copy))
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in f"{CUT}, {DEAL}".split(", ")])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInPandas(cut, f"{CUT}, {DEAL}")


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 2048,
    group_pieces: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Documents longer than a window are cut into whole windows and a rest; rests
    are packed by minimum bin slack within groups of about `group_pieces`
    pieces, dealt by a hash, so no group grows with the data and each leaves
    one window or two with room. Sequence ids are unique, not gapless.

    Null and empty texts are the end id alone. Repeated ids and rows are
    separate documents, and the repeats that a task meets are dealt out one by one; null ids are kept. An empty table gives an empty
    result; other columns are ignored. Equal lengths are placed in the order of
    (doc_id, start, crc).
    """
    ship_code(docs.sparkSession)
    groups = max(1, -(-docs.count() // group_pieces))
    pieces = cut_documents(docs, tokenizer_path, capacity, id_col, text_col).withColumn(
        "pack_group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "deal"), F.lit(groups)).cast("int")
    )
    schema = CUT + ", sequence_id long, offset long"

    def place(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "start", "ids_crc32"], kind="stable").reset_index(drop=True)
        sequence = np.zeros(len(frame), dtype="int64")
        offset = np.zeros(len(frame), dtype="int64")
        lengths = frame["length"].tolist()
        for number, window in enumerate(pack_lengths(lengths, capacity)):
            at = 0
            for i in window:
                sequence[i], offset[i] = (int(key[0]) << 32) + number, at
                at += lengths[i]
        frame["sequence_id"], frame["offset"] = sequence, offset
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        return frame.drop(columns=["pack_group", "deal"])

    return pieces.groupBy("pack_group").applyInPandas(place, schema)
