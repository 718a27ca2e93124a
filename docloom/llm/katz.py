"""LM scoring: a Katz backoff bigram model.

Counts are Good-Turing discounted; the mass that discounting frees in a context
goes to the words not seen after it, in proportion to their unigram
probabilities, by a backoff weight that makes each context sum to one exactly.
Unigrams back off to one symbol for all unknown words. The model is two stored
tables (unigrams by word, bigrams by context), partitioned by hash bucket.

Rows of these tables and of the shuffles are packed: one row holds a bucket's
sorted hash columns, so a token costs bytes, not rows. Words are known by 56
bits of their hash. Contexts with a large share of all tokens are dealt over all
buckets by their following word, so no task gets a whole hot context.

Texts are scored in the same buckets: a bigram that is known is done; one that
isn't takes its context's backoff weight and goes on to the unigrams, which are
dealt by word. Frequent words (at most ``FREQUENT``) are looked up where they
are read.

Defined results: null and empty texts are one end token; repeated rows are
scored each; a null doc_id is held out by no rule; without training texts every
token has probability 1. ``docs`` has to be a stored Parquet table (its rows are
told apart by file and place). Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import numbered, staged, text_or_empty
from docloom.llm.words import U64, Words, bucket_of, dealt, mixed, pack, runs, tallied, unpack

WORD = 7
END, BEGIN = U64(1), U64(0)
FREQUENT = 1 << 16
CHUNK_TOKENS = 1_000_000
#: Counts up to this one are discounted.
K = 5
BLOBS = "kind int, bucket int, key binary, len binary, other binary, num binary, doc binary"
_SCHEMA = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), *((n, pa.binary()) for n in ("key", "len", "other", "num", "doc"))])


def _blob(kind: int, bucket: int, key: bytes = b"", len_: bytes = b"", other: bytes = b"", num: bytes = b"", doc: bytes = b"") -> pa.RecordBatch:
    return pa.record_batch([pa.array([v], f.type) for v, f in zip((kind, bucket, key, len_, other, num, doc), _SCHEMA, strict=True)], schema=_SCHEMA)


@dataclass
class Counts:
    """What the driver knows of a model: sums, discounts, and the frequent words."""

    buckets: int
    tokens: int
    words: int
    frequent: np.ndarray
    frequent_counts: np.ndarray
    discount1: np.ndarray
    discount2: np.ndarray
    #: Probability of an unknown word, and what unigram counts are divided by.
    unknown: float
    divisor: float
    salted: np.ndarray
    salted_sums: np.ndarray | None = None

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        known = _discounted(counts, self.discount1) / self.divisor
        return np.where(counts > 0, known, self.unknown)


@dataclass
class Model:
    counts: Counts
    unigrams: DataFrame
    bigrams: DataFrame


def good_turing(n: list[int]) -> np.ndarray:
    """Discounts d[0..K] from the numbers of items seen 1..K+1 times.

    Where a corpus is too small for Katz's formula (some d outside (0, 1]),
    one absolute discount is taken from all counts up to K.
    """
    d = np.ones(K + 1)
    n1, rest = n[0], n[K]
    common = (K + 1) * rest / n1 if n1 else 1.0
    if n1 and common < 1:
        for r in range(1, K + 1):
            star = (r + 1) * n[r] / n[r - 1] if n[r - 1] else 0.0
            d[r] = (star / r - common) / (1 - common)
    else:
        d[1:] = -1
    if np.any(d[1:] <= 0) or np.any(d[1:] > 1):
        off = n1 / (n1 + 2 * n[1]) if n1 + n[1] else 0.5
        d[1:] = 1 - min(max(off, 0.1), 0.9) / np.arange(1, K + 1)
    return d


def _discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return counts * np.where(counts <= K, d[np.minimum(counts, K)], 1.0)


def shares(total: np.ndarray, disc: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(divisor, backoff weight) of contexts from their count, discounted count, and lower-order probability of followers.

    A context from which discounting frees nothing is given one count more, for the words it wasn't seen with.
    """
    left = total - disc
    bare = left < 1e-9 * np.maximum(total, 1)
    divisor = np.where(bare, total + 1, total)
    return divisor, np.where(bare, 1.0, left) / divisor / (1 - lower)


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words with an end after each text, and the number of tokens of each text."""
    words = Words(column)
    counts = words.counts()
    sizes = counts + 1
    ids = np.full(int(sizes.sum()), END)
    row = np.repeat(np.arange(len(sizes)), counts)
    ids[np.arange(len(row)) + row] = words.hash >> U64(8)
    return ids, sizes


def _chunks(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Table]]:
    """Tokens of some texts at a time, and the other columns of their rows."""
    held, n, rows = [], 0, []
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            ids, sizes = _tokens(part.column(column))
            held.append((ids, sizes))
            rows.append(part.drop_columns([batch.schema.names[column]]))
            n += len(ids)
            if n >= CHUNK_TOKENS:
                yield *(np.concatenate(x) for x in zip(*held, strict=True)), pa.Table.from_batches(rows)
                held, n, rows = [], 0, []
    if held:
        yield *(np.concatenate(x) for x in zip(*held, strict=True)), pa.Table.from_batches(rows)


def _home(key: np.ndarray, other: np.ndarray, salted: np.ndarray, n: int) -> np.ndarray:
    """The bucket of each pair: by key, or by both where the key is hot."""
    hot = np.isin(key, salted)
    return bucket_of(mixed(np.where(hot, key ^ mixed(other), key)), n)


def _coded(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words after BEGIN, sorted, and each token's place among them."""
    codes, found = pd.factorize(ids)
    order = np.argsort(found)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    return np.append(BEGIN, found[order]), rank[codes]


def _before(code: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    out = np.empty_like(code)
    out[1:] = code[:-1]
    out[np.cumsum(sizes) - sizes] = 0
    return out


def _summed_pairs(key: np.ndarray, other: np.ndarray, *sums: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.lexsort((other, key))
    key, other = key[order], other[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (other[1:] != other[:-1])
    at = np.flatnonzero(new)
    return key[at], other[at], *(np.add.reduceat(x[order], at) if len(at) else x[:0] for x in sums)


def _grouped(key: np.ndarray) -> tuple[bytes, bytes]:
    """A sorted column as its distinct values and their numbers."""
    at = runs(key)
    return pack(key[at], WORD), pack(np.diff(np.append(at, len(key))), 5)


def _ungrouped(key: bytes, length: bytes) -> np.ndarray:
    return np.repeat(unpack(key, WORD), unpack(length, 5).astype(np.int64))


def _columns(table: pa.Table, *names: str) -> Iterator[tuple]:
    return zip(*(table[n].to_pylist() for n in names), strict=True)


def _joined(parts: list[np.ndarray], dtype=U64) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def _by_bucket(df: DataFrame, merge: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    return df.groupBy("bucket").applyInArrow(merge, schema)


def _word_blobs(n: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, _ in _chunks(batches):
            words, counts = tallied(ids)
            for b, at in dealt(bucket_of(mixed(words), n), n):
                yield _blob(0, b, pack(words[at], WORD), num=pack(counts[at]))

    return count


_N = [f"n{r}" for r in range(1, K + 2)]
UNIGRAMS = "bucket int, key binary, num binary, tokens long, words long, " + ", ".join(f"{n} long" for n in _N)


def _spectrum(counts: np.ndarray) -> list[pa.Array]:
    return [pa.array([int((counts == r).sum())], pa.int64()) for r in range(1, K + 2)]


def _merge_words(table: pa.Table) -> pa.Table:
    words = _joined([unpack(x, WORD) for (x,) in _columns(table, "key")])
    words, counts = tallied(words, _joined([unpack(x) for (x,) in _columns(table, "num")]).astype(np.int64))
    sums = [pa.array([int(counts.sum())], pa.int64()), pa.array([len(words)], pa.int64()), *_spectrum(counts)]
    return pa.table([table["bucket"].slice(0, 1).combine_chunks(), pa.array([pack(words, WORD)]), pa.array([pack(counts)]), *sums], names=["bucket", "key", "num", "tokens", "words", *_N])


def _pair_blobs(c: Counts):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sizes, _ in _chunks(batches):
            u, code = _coded(ids)
            both, counts = tallied((code.astype(U64) << U64(32)) | _before(code, sizes).astype(U64))
            word, context = u[both >> U64(32)], u[both & U64(0xFFFFFFFF)]
            for b, at in dealt(_home(word, context, c.salted, c.buckets), c.buckets):
                key, length = _grouped(word[at])
                yield _blob(0, b, key, length, pack(context[at], WORD), pack(counts[at], 5))

    return count


PAIRS = "bucket int, key binary, len binary, other binary, num binary, total binary, " + ", ".join(f"{n} long" for n in _N)


def _merge_pairs(c: Counts):
    """Bigrams of a bucket of words, each with its word's own count."""

    def merge(table: pa.Table) -> pa.Table:
        parts = [(_ungrouped(k, n), unpack(o, WORD), unpack(m, 5).astype(np.int64)) for k, n, o, m in _columns(table, "key", "len", "other", "num")]
        word, context, counts = _summed_pairs(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        at = runs(word)
        total = np.add.reduceat(counts, at)
        place = np.minimum(np.searchsorted(c.frequent, word[at]), max(len(c.frequent) - 1, 0))
        if len(c.frequent):
            total = np.where(c.frequent[place] == word[at], c.frequent_counts[place], total)
        key, length = _grouped(word)
        blobs = [key, length, pack(context, WORD), pack(counts, 5), pack(total)]
        return pa.table([table["bucket"].slice(0, 1).combine_chunks(), *(pa.array([x]) for x in blobs), *_spectrum(counts)], names=["bucket", "key", "len", "other", "num", "total", *_N])

    return merge


def _turned(c: Counts):
    """Bigrams dealt anew by context, with the counts of their words."""

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, n, o, m, t in _columns(batch, "key", "len", "other", "num", "total"):
                word, context, counts = _ungrouped(k, n), unpack(o, WORD), unpack(m, 5)
                total = np.repeat(unpack(t), unpack(n, 5).astype(np.int64))
                for b, at in dealt(_home(context, word, c.salted, c.buckets), c.buckets):
                    at = at[np.argsort(context[at], kind="stable")]
                    key, length = _grouped(context[at])
                    yield _blob(0, b, key, length, pack(word[at], WORD), pack(counts[at], 5), pack(total[at]))

    return turn


BIGRAMS = "bucket int, key binary, len binary, other binary, num binary, sums binary"


def _merge_contexts(c: Counts):
    """Bigrams of a bucket of contexts, and of each context its count, discounted count and followers' unigram probability."""

    def merge(table: pa.Table) -> pa.Table:
        parts = [(_ungrouped(k, n), unpack(o, WORD), unpack(m, 5).astype(np.int64), c.unigram(unpack(t).astype(np.int64))) for k, n, o, m, t in _columns(table, "key", "len", "other", "num", "doc")]
        context, word, counts, lower = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((word, context))
        context, word, counts, lower = context[order], word[order], counts[order], lower[order]
        at = runs(context)
        sums = np.stack([np.add.reduceat(x, at) for x in (counts.astype(float), _discounted(counts, c.discount2), lower)])
        key, length = _grouped(context)
        return pa.table([table["bucket"].slice(0, 1).combine_chunks(), *(pa.array([x]) for x in (key, length, pack(word, WORD), pack(counts, 5), sums.tobytes()))], names=["bucket", "key", "len", "other", "num", "sums"])

    return merge


def _only(names: list[str], kinds: list[pa.DataType], keep: Callable[[dict], list[np.ndarray]]):
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.record_batch([pa.array(x, k) for x, k in zip(keep(row), kinds, strict=True)], names=names)

    return pick


def fit(texts: DataFrame, bucket_bytes: int = 12 << 20) -> Model:
    """A model of the column ``text``; its tables are written to the shared folder."""
    texts = texts.select("text")
    size = texts.agg(F.coalesce(F.sum(F.octet_length(text_or_empty()) + 1), F.lit(0))).first()[0]
    n = max(1, -(-size // bucket_bytes))
    unigrams = staged(_by_bucket(texts.mapInArrow(_word_blobs(n), BLOBS), _merge_words, UNIGRAMS), "unigrams", by="bucket")
    sums = unigrams.agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("tokens", "words", *_N))).first()
    spectrum = [sums[x] for x in _N]
    d1 = good_turing(spectrum)
    freed = sum(r * spectrum[r - 1] * (1 - d1[r]) for r in range(1, K + 1))
    unknown, divisor = (freed / sums.tokens, sums.tokens) if freed > 1e-9 * max(sums.tokens, 1) else (1 / (sums.tokens + 1), sums.tokens + 1)

    least = max(1, sums.tokens // FREQUENT + 1)

    def frequent(row: dict) -> list[np.ndarray]:
        words, counts = unpack(row["key"], WORD), unpack(row["num"]).astype(np.int64)
        return [words[counts >= least].astype(np.int64), counts[counts >= least]]

    common = unigrams.select("key", "num").mapInArrow(_only(["word", "count"], [pa.int64(), pa.int64()], frequent), "word long, count long").collect()
    common.sort()
    words, counts = np.array([r.word for r in common], U64), np.array([r["count"] for r in common], np.int64)
    salted = np.append(words[counts >= max(1, sums.tokens // (8 * n))], BEGIN)
    c = Counts(n, sums.tokens, sums.words, words, counts, d1, np.ones(K + 1), unknown, float(divisor), salted)

    by_word = staged(_by_bucket(texts.mapInArrow(_pair_blobs(c), BLOBS), _merge_pairs(c), PAIRS), "pairs")
    c.discount2 = good_turing(list(by_word.agg(*(F.coalesce(F.sum(x), F.lit(0)) for x in _N)).first()))
    turned = by_word.select("key", "len", "other", "num", "total").mapInArrow(_turned(c), BLOBS)
    bigrams = staged(_by_bucket(turned, _merge_contexts(c), BIGRAMS), "bigrams", by="bucket", drop=by_word)

    def hot(row: dict) -> list[np.ndarray]:
        context = unpack(row["key"], WORD)
        at = np.flatnonzero(np.isin(context, c.salted))
        return [context[at].astype(np.int64), *np.frombuffer(row["sums"]).reshape(3, -1)[:, at]]

    found = bigrams.select("key", "sums").mapInArrow(_only(["h", "a", "b", "c"], [pa.int64(), *[pa.float64()] * 3], hot), "h long, a double, b double, c double")
    sums_of = {r.h: (r.a, r.b, r.c) for r in found.groupBy("h").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("c").alias("c")).collect()}
    c.salted = np.sort(np.array([h for h in c.salted.tolist() if h in sums_of], U64))
    c.salted_sums = np.array([sums_of[h] for h in c.salted.tolist()]).reshape(-1, 3).T
    return Model(c, unigrams, bigrams)


def _home_of(rid: np.ndarray, n: int) -> np.ndarray:
    """The bucket in which a row's sums meet; rows that stand together stay together."""
    return bucket_of(mixed(rid.astype(U64) >> U64(9)), n)


def _rows(rid: np.ndarray, row: np.ndarray) -> bytes:
    """The rows that tokens stand in: the numbers of those that any does, and each token's place among them."""
    used, at = np.unique(row, return_inverse=True)
    return pack(rid[used]) + pack(at, 4)


def _rows_of(data: bytes, tokens: int) -> tuple[np.ndarray, np.ndarray]:
    cut = len(data) - 4 * tokens
    return unpack(data[:cut]), unpack(data[cut:], 4).astype(np.int64)


def _bigram_asks(c: Counts):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sizes, rows in _chunks(batches):
            u, code = _coded(ids)
            both = (_before(code, sizes).astype(U64) << U64(32)) | code.astype(U64)
            order = np.argsort(both, kind="stable")
            both = both[order]
            row = np.repeat(np.arange(len(sizes)), sizes)[order]
            at = runs(both)
            times = np.diff(np.append(at, len(both)))
            both = both[at]
            context, word = u[both >> U64(32)], u[both & U64(0xFFFFFFFF)]
            place = rows["rid"].to_numpy()
            for b, some in dealt(_home(context, word, c.salted, c.buckets), c.buckets):
                key, length = _grouped(context[some])
                begin, many = at[some], times[some]
                each = np.repeat(begin - np.cumsum(many) + many, many) + np.arange(many.sum())
                yield _blob(0, b, key, length, pack(word[some], WORD), pack(many, 5), _rows(place, row[each]))

    return ask


def _answer(c: Counts):
    """Score what the bigrams know; ask the unigrams for the rest."""

    def answer(key: tuple, asked: pa.Table, known: pa.Table) -> pa.Table:
        rids, scores, missed, missed_rids = [], [], [], []
        contexts = words = counts = np.zeros(0, U64)
        length = np.zeros(0, np.int64)
        sums = np.zeros((3, 0))
        for k, n, o, m, s in _columns(known, "key", "len", "other", "num", "sums"):
            contexts, length, words, counts = unpack(k, WORD), unpack(n, 5).astype(np.int64), unpack(o, WORD), unpack(m, 5).astype(np.int64)
            sums = np.frombuffer(s).reshape(3, -1).copy()
        if len(c.salted):  # hot contexts are known in every bucket, with or without a follower there
            extra = np.setdiff1d(c.salted, contexts)
            order = np.argsort(np.concatenate([contexts, extra]), kind="stable")
            contexts = np.concatenate([contexts, extra])[order]
            length = np.concatenate([length, np.zeros(len(extra), np.int64)])[order]
            sums = np.concatenate([sums, np.zeros((3, len(extra)))], axis=1)[:, order]
            at, hot = _found(c.salted, contexts)
            sums[:, hot] = c.salted_sums[:, at[hot]]
        divisor, backoff = shares(*sums)
        vocabulary = np.unique(words)
        pairs = (np.repeat(np.arange(len(contexts)), length).astype(U64) << U64(32)) | np.searchsorted(vocabulary, words).astype(U64)
        seen_score = np.log10(_discounted(counts, c.discount2) / np.repeat(divisor, length)) if len(counts) else np.zeros(0)
        for k, n, o, m, d in _columns(asked, "key", "len", "other", "num", "doc"):
            own, own_length, word, times = unpack(k, WORD), unpack(n, 5).astype(np.int64), unpack(o, WORD), unpack(m, 5).astype(np.int64)
            place, doc = _rows_of(d, int(times.sum()))
            h, met = _found(contexts, own)
            w, listed = _found(vocabulary, word)
            rank = np.repeat(h, own_length)
            at, seen = _found(pairs, (rank.astype(U64) << U64(32)) | w.astype(U64))
            seen &= listed & np.repeat(met, own_length)
            score = np.where(np.repeat(met, own_length), np.log10(backoff)[rank] if len(backoff) else 0.0, 0.0)
            score[seen] = seen_score[at[seen]]
            rids.append(place)
            scores.append(np.bincount(doc, np.repeat(score, times), len(place)))
            missing = np.repeat(~seen, times)
            missed.append(np.repeat(word, times)[missing])
            missed_rids.append(place[doc[missing]])
        rid, score = _joined(rids), _joined(scores, float)
        out = [_blob(0, b, key=pack(rid[at]), num=score[at].tobytes()) for b, at in dealt(_home_of(rid, c.buckets), c.buckets)]
        word, rid = _joined(missed), _joined(missed_rids)
        order = np.argsort(word, kind="stable")
        word, rid = word[order], rid[order]
        for b, at in dealt(bucket_of(mixed(word), c.buckets), c.buckets):
            out.append(_blob(1, b, *_grouped(word[at]), doc=_rows(rid, at)))
        return pa.Table.from_batches(out, _SCHEMA)

    return answer


def _found(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in a sorted column, and whether they are there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def _base(c: Counts, counts: np.ndarray) -> np.ndarray:
    return np.log10((counts + 1.0) / (c.tokens + 1.0 * (c.words + 1)))


_ROW = np.dtype([("rid", "<i8"), ("tokens", "<i8"), ("known", "<i8"), ("base", "<f8")])


def _word_asks(c: Counts):
    """Each row's tokens, and the words that aren't frequent by bucket; frequent words are scored on the way."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sizes, rows in _chunks(batches):
            u, at = _coded(ids)
            row = np.repeat(np.arange(len(sizes)), sizes)
            place, often = _found(c.frequent, u)
            score = np.where(often, _base(c, c.frequent_counts[place] if len(c.frequent) else np.zeros(len(u))), 0.0)
            own = np.zeros(len(sizes), _ROW)
            own["rid"], own["tokens"] = rows["rid"].to_numpy(), sizes
            own["known"] = np.bincount(row, often[at], len(sizes))
            own["base"] = np.bincount(row, score[at], len(sizes))
            for b, some in dealt(_home_of(own["rid"], c.buckets), c.buckets):
                yield _blob(2, b, doc=own[some].tobytes())
            rest = np.flatnonzero(~often[at])
            rest = rest[np.argsort(at[rest], kind="stable")]
            word, row = ids[rest], row[rest]
            for b, some in dealt(bucket_of(mixed(word), c.buckets), c.buckets):
                yield _blob(3, b, *_grouped(word[some]), doc=_rows(own["rid"], row[some]))

    return ask


def _unigram_answer(c: Counts):
    """Score what was asked of the unigrams, by the rows' buckets: kind 1 for the model, kind 3 for the base."""

    def answer(key: tuple, asked: pa.Table, known: pa.Table) -> pa.Table:
        words, counts = np.zeros(0, U64), np.zeros(0, np.int64)
        for k, m in _columns(known, "key", "num"):
            words, counts = unpack(k, WORD), unpack(m).astype(np.int64)
        out = []
        by_kind: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {1: [], 3: []}
        for kind, k, n, d in _columns(asked, "kind", "key", "len", "doc"):
            if kind == 2:
                out.append(_blob(2, key[0].as_py(), doc=d))
                continue
            at, there = _found(words, unpack(k, WORD))
            count = np.where(there, counts[at] if len(counts) else 0, 0)
            many = unpack(n, 5).astype(np.int64)
            rid, doc = _rows_of(d, int(many.sum()))
            value = np.log10(c.unigram(count)) if kind == 1 else _base(c, count)
            sums, hits = (np.bincount(doc, np.repeat(x, many), len(rid)) for x in (value, there))
            by_kind[kind].append((rid, sums, np.rint(hits).astype(np.int64)))
        for kind, parts in by_kind.items():
            if parts:
                rid, sums, hits = (np.concatenate(x) for x in zip(*parts, strict=True))
                out += [_blob(kind, b, key=pack(rid[at]), num=sums[at].tobytes(), len_=pack(hits[at], 5)) for b, at in dealt(_home_of(rid, c.buckets), c.buckets)]
        return pa.Table.from_batches(out, _SCHEMA)

    return answer


SUMS = "rid long, n_tokens long, n_known long, base_score double, score double"


def _sums(table: pa.Table) -> pa.Table:
    """The sums of each row from all the buckets that saw its tokens."""
    rids, parts = [], []
    for kind, k, n, m, d in _columns(table, "kind", "key", "len", "num", "doc"):
        own = np.frombuffer(d, _ROW)
        rid = own["rid"].astype(U64) if kind == 2 else unpack(k)
        sums = np.zeros((4, len(rid)))
        if kind == 2:
            sums[:3] = own["tokens"], own["known"], own["base"]
        elif kind == 3:
            sums[1:3] = unpack(n, 5), np.frombuffer(m)
        else:
            sums[3] = np.frombuffer(m)
        rids.append(rid)
        parts.append(sums)
    rid, at = np.unique(np.concatenate(rids), return_inverse=True)
    tokens, known, base, total = (np.bincount(at, x, len(rid)) for x in np.concatenate(parts, axis=1))
    return pa.table([rid.astype(np.int64), np.rint(tokens).astype(np.int64), np.rint(known).astype(np.int64), base, total], names=["rid", "n_tokens", "n_known", "base_score", "score"])


def score(docs: DataFrame, model: Model, slices: int = 2) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``n_known``, ``base_score`` and ``score`` of each row of a stored table.

    The bigrams are asked for one slice of the rows after the other, so that the
    asks of one slice are all that is on disk at once.
    """
    c = model.counts
    rows = numbered(docs.select("doc_id", "text"))
    parts = None
    for k in range(slices):
        asks = rows.where(F.pmod(F.col("rid"), F.lit(slices)) == k).select("text", "rid").mapInArrow(_bigram_asks(c), BLOBS)
        answers = staged(asks.groupBy("bucket").cogroup(model.bigrams.groupBy("bucket")).applyInArrow(_answer(c), BLOBS), f"answers{k}")
        parts = answers if parts is None else parts.unionByName(answers)
    asks = rows.select("text", "rid").mapInArrow(_word_asks(c), BLOBS)
    asked = parts.where("kind = 1").unionByName(asks)
    words = asked.groupBy("bucket").cogroup(model.unigrams.select("bucket", "key", "num").groupBy("bucket")).applyInArrow(_unigram_answer(c), BLOBS)
    summed = parts.where("kind = 0").unionByName(words).groupBy("bucket").applyInArrow(_sums, SUMS)
    return rows.select("doc_id", "rid").join(summed, "rid").drop("rid")


def held_out(mod: int = 7, rest: int = 2):
    """Whether the CRC-32 of the doc_id, as text, leaves the given remainder."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % mod == rest, F.lit(False))
