"""Shingles of many texts at once are those of each text alone."""

import random

import numpy as np
import pyarrow as pa

from lodestone.operators import contain


def test_shingles_of_many_texts_are_those_of_each():
    r = random.Random(3)
    texts = ["".join(r.choices("abcé \n\t", k=r.randrange(40))) for _ in range(500)] + ["", " ", "a b c", "a b", " a\x0bb\x0cc ", "x" * 700 + " b c", "a b c d"]
    lines = pa.array(["left out", *texts])[1:]
    keys = {}
    for row, key in zip(*(x.tolist() for x in contain.shingle_keys(lines, 3)), strict=True):
        keys.setdefault(row, []).append(key)
    names = {}
    for i, text in enumerate(texts):
        words = text.encode().split()
        runs = {tuple(words[j : j + 3]) for j in range(len(words) - 2)}
        assert len(keys.get(i, [])) == len(set(keys.get(i, []))) == len(runs)
        alone = contain.shingle_keys(pa.array([text]), 3)[1].tolist()
        assert sorted(alone) == sorted(keys.get(i, []))
        for run in runs:
            own = contain.shingle_keys(pa.array([" ".join(w.decode() for w in run)]), 3)[1].tolist()
            assert len(own) == 1 and own[0] in keys[i] and names.setdefault(run, own[0]) == own[0]
    assert len(set(names.values())) == len(names)
    table = np.zeros(contain.CELLS, bool)
    table[np.array([k for k in names.values() if k % 2]) & (contain.CELLS - 1)] = True
    some = contain.shingle_keys(lines, 3, table)[1]
    assert set(k for k in names.values() if k % 2) <= set(some.tolist()) < set(names.values())
