import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from laneflow.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_window_is_the_fullest_possible():
    draw = random.Random(6)
    for _ in range(40):
        lengths = [draw.randint(1, 40) for _ in range(draw.randint(1, 9))]
        best = max(s for n in range(len(lengths) + 1) for c in itertools.combinations(lengths, n) if (s := sum(c)) <= 60)
        counts = {x: lengths.count(x) for x in lengths}
        chosen = packing.best_window(counts, 60)
        assert sum(a * n for a, n in chosen) == best
        assert all(n <= counts[a] for a, n in chosen)


def test_every_piece_is_in_one_window():
    draw = random.Random(7)
    lengths = [draw.randint(1, 2048) for _ in range(3000)]
    windows = packing.pack_lengths(lengths, 2048)
    assert sorted(i for w in windows for i in w) == list(range(3000))
    assert all(sum(lengths[i] for i in w) <= 2048 for w in windows)
    least = max(-(-sum(lengths) // 2048), sum(x > 1024 for x in lengths))
    assert len(windows) <= 1.01 * least
    assert packing.pack_lengths([], 2048) == []


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_tokenizers(name):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    tokenizer.encode_special_tokens = True
    encode = packing.encoder(public_tokenizers.path(name))
    texts = [packing.PROBE, "", " ", "\n\n\n a", "½ ² ٣ Ⅷ", "a" * 3000, "don't  stop<|endoftext|>", "\x00\x85  x", "é́  　y"]
    for text in texts:
        assert list(encode(text)) == tokenizer.encode(text, add_special_tokens=False).ids


def test_pieces_hold_every_id_once(documents, words):
    w = words(5)
    rows = [(i, w.text(w.random.randint(1, 90))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, w.text(9000)), (203, "x"), (203, "x"), (None, "no id")]
    docs = documents(rows, extra=("start", "length", "pack_group"))
    found = packing.pack(docs, PATH, group_pieces=64).collect()
    tokenizer = Tokenizer.from_file(PATH)
    ids = {r[0]: tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1] for r in rows}
    sequences, total = {}, {}
    for p in found:
        own = np.array(ids[p["doc_id"]][p["start"] : p["start"] + p["length"]], dtype="<u4")
        assert len(own) == p["length"] and zlib.crc32(own.tobytes()) == p["ids_crc32"]
        assert p["doc_tokens"] == len(ids[p["doc_id"]])
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        total[p["doc_id"]] = total.get(p["doc_id"], 0) + p["length"]
    assert total == {k: len(v) * (2 if k == 203 else 1) for k, v in ids.items()}
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(documents([]), PATH).collect() == []


def test_repeats_of_a_row_are_dealt_out(spark, documents, words):
    w = words(6)
    rows = [(i, w.text(20)) for i in range(600)] + [(1000, "the same row again")] * 300  # a third of all rows
    pieces = packing.cut_documents(documents(rows).coalesce(1), PATH, 2048, "doc_id", "text")
    deals = [r["deal"] for r in pieces.where("doc_id = 1000").collect()]
    assert len(set(deals)) == 300 and deals.count(0) == 1
    assert {r["deal"] for r in pieces.where("doc_id < 1000").collect()} == {0}
    assert sum(r["length"] for r in packing.pack(documents(rows), PATH, group_pieces=50).where("doc_id = 1000").collect()) % 300 == 0
