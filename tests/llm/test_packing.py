import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from docloom.llm import cutting, packing

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def checked(rows, docs, library, capacity):
    """Pieces rebuild every document, sequences are gapless and unpadded; the number of pieces."""
    want = Counter((i, tuple([*library.encode(t or "", add_special_tokens=False).ids, 0])) for i, t in docs)
    rows = [(r.doc_id, r.start, r.length, np.frombuffer(r.ids, "<u4").tolist(), r.doc_tokens, r.sequence_id, r.offset) for r in rows]
    by, places = {}, {}
    for i, start, length, ids, n, sequence, offset in rows:
        assert length == len(ids) > 0
        by.setdefault((i, n), []).append((start, ids))
        places.setdefault(sequence, []).append((offset, length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at == capacity or at < capacity and at & (at - 1) == 0
    if len({i for i, _ in docs}) == len(docs):
        got = Counter()
        for (i, n), own in by.items():
            whole = [x for start, ids in sorted(own) for x in ids]
            assert [s for s, _ in sorted(own)] == np.cumsum([0, *(len(x) for _, x in sorted(own))])[:-1].tolist() and len(whole) == n
            got[i, tuple(whole)] += 1
        assert got == want
    assert sum(r[2] for r in rows) == sum(len(k[1]) * v for k, v in want.items())
    return len(rows)


@pytest.mark.parametrize("capacity, group", [(64, 10_000), (100, 3)])
def test_pieces_rebuild_documents_without_padding(table, library, monkeypatch, capacity, group):
    monkeypatch.setattr(packing, "GROUP_ROWS", group)
    rng = np.random.default_rng(3)
    docs = [(i, " ".join(f"word{int(w)}" for w in rng.integers(0, 40, int(n)))) for i, n in enumerate(rng.integers(0, 60, 500))] + [(1000 + i, "same words here") for i in range(300)]
    rows = packing.pack(table(docs, "doc_id long, text string", parts=5), capacity=capacity).collect()
    n = checked(rows, docs, library, capacity)
    tails = sum((len(library.encode(t).ids) + 1) % capacity > 0 for _, t in docs)
    whole = sum((len(library.encode(t).ids) + 1) // capacity for _, t in docs)
    assert n - tails - whole < 0.12 * len(docs)  # few tails are cut


def test_edges(edges, no_docs, library):
    rows = packing.pack(edges, capacity=32).collect()
    docs = [(r.doc_id, r.text) for r in edges.collect()]
    checked(rows, docs, library, 32)
    assert packing.pack(no_docs).count() == 0
    by = {r.doc_id: r for r in rows if r.doc_id in (1, 2)}
    assert all((r.doc_tokens, r.length, r.ids) == (1, 1, bytes(4)) for r in by.values())


TEXTS = [
    "", " ", "  a  b ", "a, b.c's 'tis don't d'l", "é ü ñ,x  y   z　w", "x <|endoftext|> y<|endoftext|>", "<|endoftext", "|>", "a\n b\n\n c \t d", "1,000.5 a1b2 __x__ (y) [z]", "\U0001f600 \U0001f600,a", "nul\x00 \x1f a",
    "d́ é, f", "word​ word", "''' ''s 's't", "Ω Ωα, а б,в", "tab\t,x ,y , z", "x" * 5000, "! ?!. a", "\x85 \x85a  b",
]


def test_ids_equal_the_library_s(library):
    own = packing.Encoder(packing.tokenizer_json())
    for texts in (TEXTS, [None, *TEXTS, "".join(TEXTS), " ".join(TEXTS), ",".join(TEXTS)]):
        ids, offsets = own.ids(pa.array(texts, pa.string()))
        for k, t in enumerate(texts):
            assert ids[offsets[k] : offsets[k + 1]].tolist() == library.encode(t or "", add_special_tokens=False).ids, t
    rng = np.random.default_rng(9)
    letters = list(" \n\t.,'!ab1Zéß 　 中'\U0001f600s<|>-_\x00́")
    texts = ["".join(rng.choice(letters, 40)) for _ in range(1500)]
    ids, offsets = own.ids(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_kept_parts_stay_bounded(monkeypatch, library):
    monkeypatch.setattr(packing, "MOST_KEPT", 10)
    own = packing.Encoder(packing.tokenizer_json())
    for k in range(8):
        text = " ".join(f"w{k}x{j}" for j in range(3 + k))
        assert own.ids(pa.array([text]))[0].tolist() == library.encode(text).ids and len(own.kept) <= 10 + 3 + k


def best_gain(sizes, prices, capacity):
    best = -np.inf
    stack = [(0, 0, 0.0)]
    while stack:
        i, full, paid = stack.pop()
        if full in cutting.fills(capacity):
            best = max(best, full - cutting.SEQUENCE_COST - paid)
        stack += [(j, full + sizes[j], paid + prices[j]) for j in range(i, len(sizes)) if full + sizes[j] <= capacity]
    return best


def test_knapsack_and_plan():
    rng = np.random.default_rng(4)
    for _ in range(20):
        sizes = np.sort(rng.choice(np.arange(1, 10), 5, replace=False))
        prices = rng.uniform(0, 9, 5)
        gain, pattern = cutting.dearest_pattern(sizes, prices, 20)
        assert gain == pytest.approx(best_gain(sizes.tolist(), prices.tolist(), 20)) and int(sizes @ pattern) in cutting.fills(20)
    parts = (np.diff([0, *sorted(rng.choice(np.arange(1, 100), 3, replace=False)), 100]) for _ in range(20_000))  # such as can all be packed
    counts = dict(Counter(int(x) for p in parts for x in p))
    found = cutting.plan(counts, 100)
    used = Counter()
    for pattern, times in found:
        assert times > 0 and sum(s * c for s, c in pattern.items()) in cutting.fills(100)
        used.update({s: c * times for s, c in pattern.items()})
    assert all(used[s] <= counts[s] for s in used) and sum(s * c for s, c in used.items()) >= 0.98 * sum(s * c for s, c in counts.items())
    assert cutting.plan({}, 100) == [] and cutting.plan({7: 1}, 100) == []


def test_query(spark, table, tmp_path, library):
    from docloom.llm.queries import op12_cutting_stock

    docs = [(i, " ".join(["some text of a page,"] * (7 * i))) for i in range(90)]
    table(docs, "doc_id long, text string")
    df = op12_cutting_stock(spark, str(tmp_path))
    assert dict(df.dtypes) == dict.fromkeys(("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"), "bigint")
    ids = {i: [*library.encode(t).ids, 0] for i, t in docs}
    for r in df.collect():
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) and r.doc_tokens == len(ids[r.doc_id])
