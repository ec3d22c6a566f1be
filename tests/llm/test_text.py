import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from holdfast.llm import simple8b
from holdfast.llm.bloom import may_contain
from holdfast.llm.text import ALNUM, BETWEEN_SPACE, SLICE, grams, slices, starts_of_grams, word_hashes
from holdfast.llm.winnow import sliding_min
from brute import words

PATTERNS = [(BETWEEN_SPACE, r"[^\x20\x09-\x0D]+"), (ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é\t\n.1\x00ß x"), st.text()), max_size=6))
def test_words_are_those_of_the_pattern(texts):
    texts = [None if t is None else t.encode("utf-8", "ignore").decode() for t in texts]
    for kind, pattern in PATTERNS:
        known = {}
        for low, high, data, offsets in slices(pa.array(texts, pa.string()), 4):
            hashes, first = word_hashes(data, offsets, kind)
            for i in range(low, high):
                want = words(texts[i], pattern)
                got = hashes[first[i - low] : first[i - low + 1]].tolist()
                assert len(got) == len(want)
                for w, h in zip(want, got):
                    assert known.setdefault(w, h) == h
        assert len(set(known.values())) == len(known)


def test_a_text_longer_than_a_slice_is_one():
    text = "word Two " * (SLICE // 4) + "y" * 100
    (low, high, data, offsets), = slices(pa.array([text]))
    hashes, first = word_hashes(data, offsets, BETWEEN_SPACE)
    assert (low, high) == (0, 1) and first.tolist() == [0, 2 * (SLICE // 4) + 1]
    assert len(set(hashes.tolist())) == 3


def test_grams_stay_in_their_row():
    first = np.array([0, 3, 3, 4, 9])
    assert starts_of_grams(first, 3).tolist() == [0, 4, 5, 6]
    hashes = np.arange(9, dtype=np.uint64)
    assert len(grams(hashes, 3)) == 7 and len(grams(hashes, 10)) == 0
    assert grams(hashes, 2)[0] != grams(hashes[::-1].copy(), 2)[-1]


@pytest.mark.parametrize("width", [1, 2, 3, 5, 8])
def test_sliding_min(width):
    x = np.random.default_rng(0).integers(0, 100, 40)
    assert sliding_min(x, width).tolist() == [x[i : i + width].min() for i in range(41 - width)]
    assert len(sliding_min(x[: width - 1], width)) == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.just(0), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=400))
def test_simple8b_round_trip(values):
    values = np.array(values, dtype=np.uint64)
    coded = simple8b.encode(values)
    assert simple8b.decode(*coded, 0, len(values)).tolist() == values.tolist()


def test_simple8b_blocks_are_decoded_alone():
    rng = np.random.default_rng(3)
    values = (50_000 ** rng.random(3 * simple8b.BLOCK + 77)).astype(np.uint64)
    values[5000:5400] = 0
    values[[1, 4095, 4096, 9000]] = 2**63 + 1
    words, escapes, blocks = simple8b.encode(values)
    assert len(words) * 8 < 2.2 * len(values) and len(escapes) == 4 and len(blocks) == 4
    for low, high in [(0, 1), (4090, 4100), (8191, 8192), (5, len(values)), (12288, len(values)), (7, 7)]:
        assert simple8b.decode(words, escapes, blocks, low, high).tolist() == values[low:high].tolist()


def test_bit_set_of_spark(spark):
    from holdfast.llm import bloom

    keys = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 500)
    bits = bloom.build(spark.createDataFrame([(int(k),) for k in keys], "key long"), "key", 16)
    bits = np.frombuffer(bits, np.uint8)
    assert len(bits) == 8192 and may_contain(bits, keys.view(np.uint64)).all()
    others = np.random.default_rng(2).integers(0, 2**63 - 1, 5000).view(np.uint64)
    assert may_contain(bits, others).mean() < 0.01
    empty = bloom.build(spark.createDataFrame([], "key long"), "key", 16)
    assert not may_contain(np.frombuffer(empty, np.uint8), others).any()
