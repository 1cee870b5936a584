"""A bigram language model by deleted interpolation, trained and applied on
Spark.

p(w | h) = l2 * c(h, w) / c(h) + l1 * c(w) / N + l0 / (V + 1), where the weights
l depend on the frequency bucket of the context h (powers of two). The weights
are learned by expectation-maximisation on held-out counts in the deleted
sense: every training bigram is predicted by counts from which that one
occurrence is taken away. EM sees a histogram of bounded size (bucket, and the
logarithms of both estimates in small steps), summed over the whole corpus.

Counts cover all training texts exactly, words and bigrams being 64-bit hashes.
They travel packed: a chunk of texts asks for each of its distinct words or
bigrams once, in one sorted and compressed block per bucket of the hash space;
the bucket adds up all blocks and answers each with the totals. So no row per
token is shuffled, a very common word is one number per chunk, and a task holds
one chunk or one bucket (``bucket_keys`` keys or so), whatever the corpus. The
chunks are stored once, coded by their own vocabularies; weights and scores are
worked out per distinct bigram of a chunk.

Order 2 was chosen because nearly every trigram here is new: a third exchange
would move more than the text itself.

Tokens: words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, then one end. A null
or empty text is an end alone. Training texts are those whose crc32 of the id
as text (null: empty) has not the remainder ``held_remainder``. Without any
training text all words are unknown, and the weights are uniform. Rows are
texts: repeated rows or ids count and score one by one. Other columns are
ignored, whatever their names are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeflow.llm.arrowtext import mix64, split_words, text_slices, word_table
from themeflow.llm.packed import bucket_of, cut_points, pack, record_batch, unpack
from themeflow.llm.stored import Stored, free_shuffles

#: White space is no word, so no word has these hashes but by accident.
END = np.uint64(xxhash.xxh3_64_intdigest(" end"))
START = np.uint64(xxhash.xxh3_64_intdigest(" start"))


@dataclass(frozen=True)
class LmSettings:
    folds: int = 7
    held_remainder: int = 2
    chunk_bytes: int = 8 << 20
    bucket_keys: int = 1_500_000
    em_rounds: int = 60
    log_step: float = 0.25


def code_texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Some texts as numbers: each text's length, the distinct tokens' hashes,
    the most frequent first (small numbers pack best), and every token's place
    among them."""
    words, counts = split_words(texts, lower=True)
    lens = counts.astype(np.int64) + 1
    hashes, places = word_table(words)
    vocab, rank = np.unique(np.r_[hashes, END], return_inverse=True)
    ids = np.full(int(lens.sum()), rank[-1], np.int64)
    is_word = np.ones(len(ids), bool)
    is_word[np.cumsum(lens) - 1] = False
    ids[is_word] = rank[places]
    order = np.argsort(-np.bincount(ids), kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return lens, vocab[order], place[ids]


def bigrams(lens: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct bigrams of a chunk as places of context and word in its
    vocabulary of ``n`` (place n is the start of a text), in that order, and
    every token's place among them."""
    context = np.r_[n, ids[:-1]].astype(np.int64)
    context[np.r_[0, np.cumsum(lens)[:-1]]] = n
    pair, at = np.unique(context * n + ids, return_inverse=True)
    return pair // n, pair % n, at


def bigram_keys(vocab: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bigrams' hashes in order, and whose they are."""
    hashes = np.r_[vocab, START]
    keys = mix64(hashes[first] * np.uint64(0x9E3779B97F4A7C15) + hashes[second])
    order = np.argsort(keys)
    return keys[order], order


_WIDTH = {"lens": np.int64, "vocab": np.uint64, "ids": np.uint32}


def _chunks(docs: DataFrame, s: LmSettings) -> DataFrame:
    size = s.chunk_bytes

    def code(batches):
        task, k = TaskContext.get().partitionId(), 0
        for part in text_slices(batches, limit=size):
            coded = code_texts(part.column("text"))
            yield pa.RecordBatch.from_pydict({
                "chunk": pa.array([(task << 32) + k], pa.int64()),
                "doc_ids": pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                "held": pa.array([part.column("held").to_pylist()], pa.list_(pa.bool_())),
                **{name: pa.array([pack(x.astype(kind))], pa.binary()) for x, (name, kind) in zip(coded, _WIDTH.items())},
                "n_tokens": pa.array([len(coded[2])], pa.int64())})
            k += 1

    return docs.mapInArrow(code, "chunk long, doc_ids array<long>, held array<boolean>, lens binary, vocab binary, "
                                 "ids binary, n_tokens long")


def _numbers(row: dict, *names: str) -> list[np.ndarray]:
    return [unpack(row[name], _WIDTH[name]) for name in names]


def _training_counts(row: dict, lens: np.ndarray, at: np.ndarray, n_keys: int) -> np.ndarray:
    """How often each key of a chunk occurs in the texts that train."""
    return np.bincount(at[np.repeat(~np.array(row["held"], bool), lens)], minlength=n_keys)


#: Keys are sorted and travel as steps from one to the next, which pack better.
_ASK = "bucket long, chunk long, kind int, keys binary, counts binary"
_ANSWER = "bucket long, chunk long, kind int, totals binary, n_distinct long, n_total long"


def _totals(chunks: DataFrame, buckets: int, s: LmSettings) -> DataFrame:
    """For every chunk the training totals of its words (kind 1) and bigrams
    (kind 2), block by block; and per bucket a row without chunk that has how
    many distinct keys occur in training, and how often."""
    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                lens, vocab, ids = _numbers(row, *_WIDTH)
                first, second, at = bigrams(lens, ids, len(vocab))
                keys, order = bigram_keys(vocab, first, second)
                by_hash = np.argsort(vocab)
                words = _training_counts(row, lens, ids, len(vocab))[by_hash]
                pairs = _training_counts(row, lens, at, len(keys))[order]
                for kind, k, counts in ((1, vocab[by_hash], words), (2, keys, pairs)):
                    counts = counts.astype(np.uint32)
                    home = bucket_of(k, buckets)
                    rows = [(int(home[a]), row["chunk"], kind, pack(np.diff(k[a:b], prepend=np.uint64(0))), pack(counts[a:b]))
                            for a, b in cut_points(home)]
                    yield record_batch(rows, _ASK)

    def answer(t: pa.Table) -> pa.Table:
        bucket, kinds = t["bucket"][0].as_py(), t["kind"].to_numpy()
        out = []
        for kind in (1, 2):
            own = t.filter(pa.array(kinds == kind)).to_pylist()
            if not own:
                continue
            blocks = [np.cumsum(unpack(r["keys"], np.uint64), dtype=np.uint64) for r in own]
            _, at = np.unique(np.concatenate(blocks), return_inverse=True)
            counts = np.concatenate([unpack(r["counts"], np.uint32) for r in own])
            total = np.bincount(at, weights=counts).astype(np.int64)
            out.append((bucket, None, kind, None, int((total > 0).sum()), int(total.sum())))
            lo = 0
            for r, block in zip(own, blocks):
                out.append((bucket, r["chunk"], kind, pack(total[at[lo:lo + len(block)]]), None, None))
                lo += len(block)
        return pa.Table.from_batches([record_batch(out, _ANSWER)])

    asked = chunks.select("chunk", "held", *_WIDTH).mapInArrow(ask, _ASK)
    return asked.groupBy("bucket").applyInArrow(answer, _ANSWER)


_RESOLVED = "doc_ids array<long>, held array<boolean>, lens binary, ids binary, pair binary, word binary"


def _resolve(chunks: DataFrame, answers: DataFrame) -> DataFrame:
    """Chunks with the totals of their bigrams (``pair``) and of their tokens
    (``word``, that of a text's start last). What a chunk knew already travels
    on as it was packed."""
    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        lens, vocab, ids = _numbers(row, *_WIDTH)
        first, second, _ = bigrams(lens, ids, len(vocab))
        of = {1: [], 2: []}
        for r in sorted(right.select(["kind", "bucket", "totals"]).to_pylist(), key=lambda r: r["bucket"]):
            of[r["kind"]].append(unpack(r["totals"], np.int64))
        word, pair = (np.empty(len(x), np.int64) for x in (vocab, first))
        word[np.argsort(vocab)] = np.concatenate(of[1])
        pair[bigram_keys(vocab, first, second)[1]] = np.concatenate(of[2])
        word = np.r_[word, word[vocab == END]]
        return pa.table({
            "doc_ids": pa.array([row["doc_ids"]], pa.list_(pa.int64())),
            "held": pa.array([row["held"]], pa.list_(pa.bool_())),
            "lens": pa.array([row["lens"]], pa.binary()), "ids": pa.array([row["ids"]], pa.binary()),
            "pair": pa.array([pack(pair)], pa.binary()), "word": pa.array([pack(word)], pa.binary())})

    left = chunks.select("chunk", "doc_ids", "held", *_WIDTH)
    right = answers.filter("chunk is not null").select("chunk", "kind", "bucket", "totals")
    return left.groupBy("chunk").cogroup(right.groupBy("chunk")).applyInArrow(join, _RESOLVED)


def context_bucket(count: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + the whole part of its log2."""
    return np.where(count > 0, np.floor(np.log2(np.maximum(count, 1))) + 1, 0).astype(np.int64)


def _histogram(resolved: DataFrame, n: int, v: int, s: LmSettings) -> DataFrame:
    """Training bigrams by (context bucket, steps of the two logarithms), each
    predicted without itself."""
    step = s.log_step

    def cells(batches):
        for batch in batches:
            for row in batch.to_pylist():
                lens, ids = _numbers(row, "lens", "ids")
                pair, total = unpack(row["pair"], np.int64), unpack(row["word"], np.int64)
                first, second, at = bigrams(lens, ids, len(total) - 1)
                weight = _training_counts(row, lens, at, len(pair))
                seen = weight > 0
                if not seen.any():
                    continue
                pair, context, word, weight = pair[seen], total[first[seen]], total[second[seen]], weight[seen]
                two = _steps((pair - 1) / np.maximum(context - 1, 1), v, step)
                one = _steps((total - 1) / max(n - 1, 1), v, step)[second[seen]]
                key = (context_bucket(context - 1) * _WIDE + two + _WIDE // 2) * _WIDE + one + _WIDE // 2
                key, cell = np.unique(key, return_inverse=True)
                mass = np.bincount(cell, weights=weight)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((key // _WIDE ** 2).astype(np.int32)),
                     pa.array((key // _WIDE % _WIDE - _WIDE // 2).astype(np.int32)),
                     pa.array((key % _WIDE - _WIDE // 2).astype(np.int32)), pa.array(mass)],
                    ["bucket", "two", "one", "weight"])

    return (resolved.select("held", "lens", "ids", "pair", "word")
            .mapInArrow(cells, "bucket int, two int, one int, weight double")
            .groupBy("bucket", "two", "one").agg(F.sum("weight").alias("weight")))


def _steps(p: np.ndarray, v: int, step: float) -> np.ndarray:
    """ln(p * (V + 1)) in steps; a number below all others for p = 0."""
    return np.where(p > 0, np.round(np.log(np.maximum(p, 1e-300) * (v + 1)) / step), _ZERO).astype(np.int64)


_ZERO = -1_000_000
#: Steps are numbers between -_WIDE / 2 and _WIDE / 2.
_WIDE = 1 << 22


def learn_weights(cells: pa.Table, s: LmSettings) -> np.ndarray:
    """(bucket, order 0-2) weights by expectation-maximisation. Buckets
    without training bigrams take those of the next smaller one."""
    bucket = cells["bucket"].to_numpy()
    ratio = lambda c: np.where(c == _ZERO, 0.0, np.exp(c * s.log_step))
    p = np.stack([np.ones(len(bucket)), ratio(cells["one"].to_numpy()), ratio(cells["two"].to_numpy())], axis=1)
    mass = cells["weight"].to_numpy()
    weights = np.full((65, 3), 1 / 3)
    weights[0] = (0.5, 0.5, 0.0)
    for _ in range(s.em_rounds):
        share = p * weights[bucket]
        share *= (mass / share.sum(axis=1))[:, None]
        new = np.zeros_like(weights)
        np.add.at(new, bucket, share)
        total = new.sum(axis=1, keepdims=True)
        weights = np.where(total > 0, new / np.maximum(total, 1e-300), weights)
    for b in range(2, 65):
        if not (bucket == b).any():
            weights[b] = weights[b - 1]
    return np.maximum(weights, [1e-9, 0, 0]) if len(bucket) else weights


_SCORES = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
           "score double")


def score_documents(docs: DataFrame, s: LmSettings = LmSettings(), id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per text: id, whether it was held out, tokens, known tokens,
    training tokens, and its log10 probability under add-one unigrams (base)
    and under the model (score)."""
    held = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % s.folds == s.held_remainder
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), held.alias("held"))
    chunks = Stored(_chunks(docs, s), "lm-chunks")
    tokens = chunks.read().agg(F.sum("n_tokens")).first()[0] or 0
    buckets = max(1, -(-tokens // s.bucket_keys))
    answers = Stored(_totals(chunks.read(), buckets, s), "lm-totals", free=True)
    free_shuffles(docs.sparkSession)
    known = answers.read().filter("chunk is null and kind = 1").agg(F.sum("n_distinct"), F.sum("n_total")).first()
    v, n = int(known[0] or 0), int(known[1] or 0)
    resolved = Stored(_resolve(chunks.read(), answers.read()), "lm-resolved", free=True)
    chunks.drop()
    answers.drop()
    weights = learn_weights(_histogram(resolved.read(), n, v, s).toArrow(), s)

    def score(batches):
        for batch in batches:
            for row in batch.to_pylist():
                lens, ids = _numbers(row, "lens", "ids")
                pair, word = unpack(row["pair"], np.int64), unpack(row["word"], np.int64)
                first, second, at = bigrams(lens, ids, len(word) - 1)
                own = weights[context_bucket(word)]
                p = (own[first, 2] * pair / np.maximum(word, 1)[first] + own[first, 1] * (word / max(n, 1))[second]
                     + own[first, 0] / (v + 1))
                starts = np.cumsum(lens) - lens
                total = lambda x: np.add.reduceat(x[at], starts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(lens),
                     pa.array(total((word > 0).astype(np.int64)[second])), pa.array(np.full(len(lens), n, np.int64)),
                     pa.array(total(np.log10((word + 1) / (n + v + 1))[second])), pa.array(total(np.log10(p)))],
                    [f.split()[0] for f in _SCORES.split(", ")])

    return resolved.read().select("doc_ids", "held", "lens", "ids", "pair", "word").mapInArrow(score, _SCORES)


def brute_force(rows: list[tuple[int, str | None]], s: LmSettings = LmSettings()) -> list[tuple]:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, and the
    three estimates with the context's count for each token), for tests."""
    import re
    import zlib
    from collections import Counter
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = [re.findall("[^\x20\x09-\x0D]+", (t or "").translate(fold)) + [" end"] for _, t in rows]
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % s.folds == s.held_remainder for d, _ in rows]
    one, two, ctx = Counter(), Counter(), Counter()
    for t, h in zip(texts, held):
        if not h:
            one.update(t)
            two.update(zip([" start"] + t, t))
            ctx.update([" start"] + t[:-1])
    n, v = sum(one.values()), len(one)
    out = []
    for (d, _), t, h in zip(rows, texts, held):
        base = float(np.log10([(one[w] + 1) / (n + v + 1) for w in t]).sum())
        parts = [(ctx[c], two[c, w] / max(ctx[c], 1), one[w] / max(n, 1), 1 / (v + 1)) for c, w in zip([" start"] + t, t)]
        out.append((d, h, len(t), sum(one[w] > 0 for w in t), n, base, parts))
    return out
