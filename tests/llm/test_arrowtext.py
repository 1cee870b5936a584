import re

import numpy as np
import pyarrow as pa
import pytest

from themeflow.llm.arrowtext import hash_words, split_words, text_slices, word_ids

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = [None, "", " ", "A b\x1cc\x85d e\x0bF", "éÀ x \r\n y", "K", "z" * 100] * 7


@pytest.mark.parametrize("lo,n", [(0, 49), (3, 20), (40, 9), (10, 1)])
def test_words_of_slices(lo, n):
    part = pa.array(TEXTS).slice(lo, n)
    words, counts = split_words(part, lower=True)
    want = [re.findall("[^\x20\x09-\x0D]+", (t or "").translate(FOLD)) for t in part.to_pylist()]
    assert counts.tolist() == [len(w) for w in want]
    assert words.to_pylist() == [x for w in want for x in w]


def test_hashes_depend_on_the_word_alone():
    one, two = pa.array(["a", "b", "a"]), pa.array(["b", "a"])
    assert hash_words(one)[:2].tolist() == hash_words(two)[::-1].tolist()
    assert len(hash_words(pa.array([], pa.string()))) == 0
    assert word_ids(one).tolist() == [0, 1, 0]


def test_slices_hold_every_row_once_and_bounded():
    batch = pa.record_batch({"text": TEXTS, "i": list(range(len(TEXTS)))})
    parts = list(text_slices([batch, batch.slice(0, 0)], limit=120))
    assert np.concatenate([p.column("i").to_numpy() for p in parts]).tolist() == list(range(len(TEXTS)))
    assert len(parts) > 4
