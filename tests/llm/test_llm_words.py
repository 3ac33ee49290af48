"""The word scanner against plain Python."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from framelight.llm.hash_blocks import cuts, distinct, pack, unpack
from framelight.llm.words import flat, scan, slices, windows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
texts = st.lists(st.one_of(st.none(), st.text(alphabet="abAB é\n\t.\x0b ", max_size=30)), max_size=12)


@settings(max_examples=200, deadline=None)
@given(texts)
def test_words_and_hashes(rows):
    whole = flat(pa.array(rows, pa.string()))
    want = [WORD.findall(x or "") for x in rows]
    for low in (0, len(rows) // 2):
        w = scan(whole.slice(low))
        assert [w.data[a:b].tobytes().decode() for a, b in zip(w.start, w.end, strict=True)] == [x for words in want[low:] for x in words]
        assert np.diff(w.first).tolist() == [len(x) for x in want[low:]]
        words = [x for y in want[low:] for x in y]
        for fold in (False, True):
            h = w.hashes(fold)
            name = [re.sub("[A-Z]", lambda m: m[0].lower(), x) if fold else x for x in words]
            assert len(set(h.tolist())) == len(set(name))
            assert all((h[i] == h[j]) == (name[i] == name[j]) for i in range(len(name)) for j in range(i))


@settings(max_examples=100, deadline=None)
@given(texts)
def test_windows_are_alike_only_if_their_words_are(rows):
    w = scan(flat(pa.array(rows, pa.string())))
    h, whole = windows(w.hashes(), w.doc, 3)
    words = [w.data[a:b].tobytes() for a, b in zip(w.start, w.end, strict=True)]
    found = {}
    for i in np.flatnonzero(whole):
        assert found.setdefault(int(h[i]), words[i : i + 3]) == words[i : i + 3]
    assert len(found) == len({tuple(words[i : i + 3]) for i in np.flatnonzero(whole)})


def test_slices_cover_all_texts():
    whole = pa.array(["x" * n for n in (0, 3 << 20, 10, 700_000, 700_000, 0)])
    got = list(slices(whole))
    assert got[0][0] == 0 and got[-1][1] == 6 and all(a[1] == b[0] for a, b in zip(got, got[1:], strict=False))


@given(st.lists(st.integers(0, 2**64 - 1), max_size=50))
def test_blocks_round_trip(values):
    h = np.array(values, np.uint64)
    ordered, first, number = distinct(h)
    assert ordered.tolist() == sorted(set(values)) and (ordered[number] == h).all() and all(values.index(x) == i for x, i in zip(ordered.tolist(), first.tolist(), strict=True))
    at = cuts(ordered, 7)
    assert at[0] == 0 and at[-1] == len(ordered)
    for b in range(7):
        assert all(int(x) * 7 >> 64 == b for x in ordered[at[b] : at[b + 1]].tolist())
    assert unpack(pack(ordered), len(ordered), np.uint64).tolist() == ordered.tolist() if len(ordered) else True
