import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from linkspan.llm import packing as P
from linkspan.llm import token_store as R
from linkspan.llm import tokens as T

ALPHABET = ["a", "B", "word", "é", " ", "  ", "\n", "\t", "\r\n", ".", ",", "'s", "1", "23", "中", " ", "!", "​", "́", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "😀", "\x1c", "᠎"]


def library(name):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name,blanks", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_ids_are_the_librarys(name, blanks, monkeypatch):
    monkeypatch.setattr(T, "STRETCH", 5)
    mine, theirs, draw = T.Encoder(name, blanks), library(name), random.Random(1)
    for _ in range(4000):
        text = "".join(draw.choice(ALPHABET) for _ in range(draw.randrange(20)))
        assert np.frombuffer(mine.ids(text), "<u4").tolist() == theirs(text), repr(text)


@pytest.mark.parametrize("n", [0, 1, 5, 64, 1000, 4097])
def test_rans_round_trip_and_sections(n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 5000).astype("<u4")
    symbols, counts = np.unique(np.r_[ids, np.uint32(0)], return_counts=True)
    table = R.Table.quantised(symbols, counts)
    raw = R.frame(np.array([7]), np.array([False]), np.array([n]), ids, table, lanes=64, every=8)
    read = R.Frame(raw, table)
    assert (read.ids() == ids).all()
    for k in reversed(range(len(read.checkpoints))):
        at = read.checkpoints[k][0] * read.lanes
        part = read.section(k)
        assert (part == ids[at : at + len(part)]).all()
    for at in (9, len(raw) // 2, len(raw) - 1):
        with pytest.raises(ValueError):
            R.Frame(raw[:at] + bytes([raw[at] ^ 1]) + raw[at + 1 :], table)


def test_store_against_the_library(spark, tricky, empty, tmp_path):
    encode = library("byte_bpe_50k.json")
    path = R.write(tricky.repartition(3), f"file://{tmp_path}/a", block_tokens=50, lanes=8, every=4)
    got = R.read(spark, path).orderBy("start").collect()
    texts = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in tricky.collect()))
    assert [r.doc_id for r in got] == [t[1] if t[0] else None for t in texts]
    start = 0
    for row, (_, _, text) in zip(got, texts):
        ids = np.array([*encode(text), 0], dtype="<u4")
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert R.read(spark, R.write(empty, f"file://{tmp_path}/b")).count() == 0


def fewest(items, capacity):
    best = len(items)

    def go(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(items):
            best = len(rooms)
            return
        for i in range(len(rooms)):
            if rooms[i] >= items[k] and rooms[i] not in rooms[:i]:
                go(k + 1, [*rooms[:i], rooms[i] - items[k], *rooms[i + 1 :]])
        go(k + 1, [*rooms, capacity - items[k]])

    items = sorted(items, reverse=True)
    go(0, [])
    return best if items else 0


def whole(patterns, histogram, capacity):
    """The number of sequences of a plan that uses each piece once."""
    used = {}
    for repeats, pattern in patterns:
        assert 0 < sum(pattern) <= capacity and repeats > 0
        for x in pattern:
            used[x] = used.get(x, 0) + repeats
    assert used == {x: n for x, n in histogram.items() if n}
    return sum(r for r, _ in patterns)


def test_plans_are_optimal_on_small_histograms():
    draw = random.Random(4)
    for k in range(400):
        capacity = draw.choice([10, 20, 30])
        low, high = draw.choice([(1, capacity), (capacity // 4, capacity // 2), (2, capacity // 3)])
        items = [draw.randint(low, high) for _ in range(draw.randrange(11))]
        histogram = {x: items.count(x) for x in items}
        assert whole(P.plan(histogram, capacity, nodes=None), histogram, capacity) == fewest(items, capacity)


def plain_best_fit(items, capacity):
    rooms = []
    for x in sorted(items, reverse=True):
        fits = [r for r in rooms if r >= x]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else capacity) - x)
    return sorted(rooms)


def test_best_fit_of_a_histogram_is_that_of_its_items():
    draw = random.Random(8)
    for _ in range(300):
        capacity = draw.choice([12, 50, 100])
        histogram = {draw.randint(1, capacity): draw.randint(1, 30) for _ in range(draw.randrange(12))}
        groups = P.best_fit(histogram, capacity)
        whole(groups, histogram, capacity)
        rooms = sorted(capacity - sum(p) for n, p in groups for _ in range(n))
        assert rooms == plain_best_fit([x for x, n in histogram.items() for _ in range(n)], capacity)


def test_never_more_sequences_than_best_fit():
    draw, better = random.Random(9), 0
    for k in range(1000):
        capacity, low, high = draw.choice([(100, 20, 50), (150, 30, 75), (2048, 515, 1000), (256, 1, 256), (100, 26, 40)])
        histogram = {}
        for _ in range(draw.randrange(1, 300)):
            x = draw.randint(low, high)
            histogram[x] = histogram.get(x, 0) + draw.choice([1, 1, 2, 50])
        n = whole(P.plan(histogram, capacity, nodes=2000), histogram, capacity)
        plain = sum(r for r, _ in P.best_fit(histogram, capacity))
        assert lower_bound(histogram, capacity) <= n <= plain
        better += n < plain
    assert better > 20


def test_bound_is_the_plain_one():
    draw = random.Random(2)
    for _ in range(200):
        histogram = {draw.randint(1, 40): draw.randint(1, 9) for _ in range(10)}
        counts = np.array([histogram.get(x, 0) for x in range(41)])
        assert P.least_sequences(counts, 40) == lower_bound(histogram, 40)


def lower_bound(histogram, capacity):
    """Martello and Toth's second bound."""
    best = 0
    for a in range(capacity // 2 + 1):
        alone = sum(n for x, n in histogram.items() if x > capacity - a)
        half = [(x, n) for x, n in histogram.items() if capacity / 2 < x <= capacity - a]
        small = sum(x * n for x, n in histogram.items() if a <= x <= capacity / 2)
        free = sum((capacity - x) * n for x, n in half)
        best = max(best, alone + sum(n for _, n in half) + max(0, -((free - small) // capacity)))
    return best


def test_plan_uses_every_piece():
    draw = random.Random(9)
    histogram = {x: draw.randint(1, 400) for x in draw.sample(range(1, 257), 120)}
    patterns = P.plan(histogram, 256)
    used = {}
    for repeats, pattern in patterns:
        assert sum(pattern) <= 256
        for x in pattern:
            used[x] = used.get(x, 0) + repeats
    assert used == histogram
    assert sum(r for r, _ in patterns) <= lower_bound(histogram, 256) + 1


def test_pack_whole_documents(spark, tricky, empty):
    encode = library("word_bpe_49k.json")
    rows = P.pack(P.pieces(tricky.repartition(3))).collect()
    want = []
    for r in tricky.collect():
        ids = np.array([*encode(r.text or ""), 0], dtype="<u4")
        want += [(r.doc_id, k, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
    key = lambda t: tuple(-1 if v is None else v for v in t)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(want, key=key)
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for got in places.values():
        at = 0
        for offset, length in sorted(got):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) == -(-sum(r.length for r in rows) // 2048)
    assert P.pack(P.pieces(empty)).count() == 0


def test_plan_with_thousands_of_short_pieces():
    for histogram in ({1: 5000}, {2: 3000}, {1: 4000, 2: 4000, 900: 3, 2048: 2}, {1: 3000, 2: 1500, 3: 10, 700: 400}):
        patterns, used = P.plan(histogram, 2048), {}
        for repeats, pattern in patterns:
            assert sum(pattern) <= 2048
            for x in pattern:
                used[x] = used.get(x, 0) + repeats
        assert used == histogram
        half = -(-sum(n for x, n in histogram.items() if x > 2048 // 3) // 2)  # 700: two go together
        assert sum(r for r, _ in patterns) == max(half if 700 in histogram else 0, -(-sum(x * n for x, n in histogram.items()) // 2048))
