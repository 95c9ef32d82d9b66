"""Properties of the parts that need no session."""

import gzip

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.llm import _bytes as B
from strandline.llm import chat_format, decontaminate, neardup, suffix_dedup, warc

MARKERS = st.lists(st.sampled_from(["<", "|", "\\", "<|im_end|>", "<|im_start|>", "\n", "%", "é", "x"]), max_size=12).map("".join)


@given(MARKERS, MARKERS)
def test_a_turn_reads_back(role, text):
    piece = f"{chat_format.START}{chat_format.escape_role(role)}\n{chat_format.escape(text)}{chat_format.END}\n"
    assert chat_format.parse_piece(piece) == (role, text)
    assert piece.count("<|") == 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=30).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=12), st.integers(1, 6))
def test_index_marks_what_started_earlier(strings, length):
    index, seen, want = suffix_dedup.RunLengthIndex(strings), set(), []
    for k, s in enumerate(strings):
        for p in range(len(s) - length + 1):
            if s[p : p + length] in seen:
                want.append(int(index.offsets[k]) + p)
            seen.add(s[p : p + length])
    assert index.repeats(length).tolist() == want


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=400), max_size=8), st.integers(1, 50))
def test_records_survive_any_cut_of_the_stream(bodies, cut):
    records = [b"WARC/1.0\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(b), b) for b in bodies]
    whole = b"".join(records)
    assert list(warc.split_records(whole[i : i + cut] for i in range(0, len(whole), cut))) == records
    members = b"".join(map(warc.member, records))
    assert gzip.decompress(members) == whole if records else members == b""
    assert [r for _, _, r in warc.members(memoryview(members))] == records


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB c\té\n", max_size=40)), max_size=10), st.integers(1, 4), st.integers(1, 64))
def test_shingle_sets_are_sets_of_words(texts, size, limit):
    column = pa.array(texts, pa.string())
    got = []
    for _, _, h, n in neardup.shingle_sets(column, size):
        end = np.cumsum(n)
        got += [frozenset(h[a:b].tolist()) for a, b in zip(end - n, end, strict=True)]
    want = []
    for t in texts:
        w = [x.encode() for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()]
        want.append(frozenset(tuple(w[k : k + size]) for k in range(max(len(w) - size + 1, 1))) if w else frozenset())
    assert [len(x) for x in got] == [len(x) for x in want]
    for i, j in [(i, j) for i in range(len(texts)) for j in range(i)]:
        assert len(got[i] & got[j]) == len(want[i] & want[j])
    whole = [b"".join(bytes(buf[own[k] : own[k + 1] - 1]) + b"|" for k in range(len(own) - 1)) for _, _, buf, own in B.chunks(column, limit)]
    assert b"".join(whole) == b"".join((t or "").encode() + b"|" for t in texts)


@given(st.integers(1, 200))
def test_densified_bins_depend_on_the_set_alone(n):
    h = np.sort(np.random.default_rng(n).integers(0, 2**64, n, dtype=np.uint64))
    one = neardup.bands(h, np.array([n]))
    two = neardup.bands(np.concatenate((h, h)), np.array([n, n]))
    assert (one[0] == two[0]).all() and (one[0] == two[1]).all()


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**64, 400, dtype=np.uint64)
    a, b = np.sort(pool[:360]), np.sort(pool[40:])  # similarity 0.8
    x, y = neardup.bands(a, np.array([360]))[0], neardup.bands(b, np.array([360]))[0]
    assert (x == y).sum() >= 4


def test_candidates_of_an_empty_benchmark():
    none = np.zeros(4, np.uint64)
    assert sum(len(at) for at, _ in decontaminate._candidates(np.arange(5, dtype=np.uint64), np.array([2, 0, 3]), (none, none))) == 0


@given(st.lists(st.integers(0, 5), max_size=6))
def test_shingles_stay_inside_their_rows(many):
    h = np.arange(sum(many), dtype=np.uint64)
    full = np.full(4, 2**64 - 1, np.uint64)
    got = decontaminate._candidates(h, np.array(many, np.int64), (full, full))
    starts = np.cumsum([0, *many])
    want = [p for k, n in enumerate(many) for p in range(starts[k], starts[k] + n - 1)]
    assert (got[0][0].tolist(), got[1][0].tolist()) == (want, list(range(sum(many)))) if len(h) else got == []
