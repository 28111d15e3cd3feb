"""Scores of texts by a hashed maximum-entropy language model, beside those of smoothed unigrams.

Tokens are the words of a text, A-Z as a-z, then one end. The softmax is factored by classes: the most frequent training
tokens (TABLE at most, broadcast) stand in classes of SIDE by their rank, and a place of its own stands for all others; a
token is predicted as its class, then as a member of it. Three families of hashed features, each nested in the one before:
the last token; the last two; the last two with the one that is four back (a skip over the third). A feature has a weight
for every class, and for every member of a class, that was seen with it in training, so weights grow with the corpus. A
probability is the unigram share times the exponentials of the weights, over their sum; weights never seen are zero, so
the sum takes the seen ones only. A token outside the table has the probability of the outside place times its smoothed
share of the training tokens outside, whose counts are joined.

Every occurrence of a token is sent, as a few bytes, to the task that owns its last token. All its features hold that
token, so an owner has all the data of its weights: it takes ROUNDS steps along the gradient of the penalised log
likelihood (observed less expected counts, scaled by the curvature), family after family, in numpy arrays of the pairs
that occur, and then scores its occurrences, those of held-out texts too. A last token of more than a quarter of an
owner's load is dealt to several owners by the token before it, and where both are that frequent by the text too; each of
them has weights of its own. The texts' sums come back by flush (see `packed`).

Null texts count as empty (one token, the end); null ids count as the empty text in the split; words are told apart by
64-bit hashes; equal rows get equal scores up to rounding, unless so frequent that they were dealt apart; without training
rows all words are unknown and both scores are zero; an empty table gives no rows. Long texts come in chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packed
from .shared import crc_mod, saved, texts
from .textops import Words, chunks, mix, signed

FOLDS, HELD_OUT = 7, 2
SIDE_BITS, TABLE, BACK = 9, 1 << 18, 4
SIDE = 1 << SIDE_BITS
ROUNDS, PULL = 8, 0.3
#: Bytes of text in an owner's share: about 600,000 occurrences, for which an owner takes some 80 MB.
OWNER_BYTES = 4 << 20
END, BEGIN = (int(x) for x in mix(np.array([101, 102], dtype=np.uint64)))
SLICE = 1 << 18


@dataclass
class Table:
    """Frequent training tokens: hashes in order, counts and places in the vocabulary by rank (place 0: all others)."""

    hashes: np.ndarray
    counts: np.ndarray
    places: np.ndarray
    total: int
    distinct: int

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, place) of tokens; counts are -1 for tokens outside of the table."""
        if not len(self.hashes):
            return np.full(len(h), -1), np.zeros(len(h), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = self.hashes[at] == h
        return np.where(hit, self.counts[at], -1), np.where(hit, self.places[at], 0)

    def shares(self) -> tuple[np.ndarray, np.ndarray]:
        """Shares of the classes, and of each place within its class."""
        n = np.zeros(-(-(len(self.hashes) + 1) // SIDE) * SIDE)
        n[: len(self.hashes) + 1] = 0.5
        n[self.places] += self.counts
        n[0] += self.total - self.counts.sum()
        n = n.reshape(-1, SIDE)
        kinds = n.sum(axis=1)
        return kinds / kinds.sum(), (n / kinds[:, None]).ravel()


def tokens(w: Words, base: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, place among the tokens of the chunk) of the tokens of all texts, each with its end where it ends here."""
    h = w.hashes(lower=True)
    size = np.diff(w.first)
    if w.ends:
        h, size = np.insert(h, w.first[1:], np.uint64(END)), size + 1
    doc = np.repeat(np.arange(w.n_docs), size)
    return h, doc, np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)


def before(h: np.ndarray, at: np.ndarray, back: int) -> np.ndarray:
    """The token `back` places before each, or the beginning."""
    out = np.full(len(h), np.uint64(BEGIN))
    out[back:] = h[: len(h) - back]
    out[at < back] = np.uint64(BEGIN)
    return out


def word_counts(docs: DataFrame, most: int = 1 << 20) -> DataFrame:
    """h and n of every distinct token; a task adds up what it has read and passes it on at `most` distinct tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_h, held_n, parts, size = np.empty(0, np.uint64), np.empty(0, np.int64), [], 0

        def merged(parts):
            h, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return h, np.bincount(back, np.concatenate([p[1] for p in parts]), len(h)).astype(np.int64)

        def out(h, n):
            return pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(n)], names=["h", "n"])

        for b in batches:
            for _, _, w, _ in chunks(b.column("text"), 0, SLICE):
                parts.append(np.unique(tokens(w)[0], return_counts=True))
                size += len(parts[-1][0])
                if size > most // 2:
                    held_h, held_n = merged([(held_h, held_n), *parts])
                    parts, size = [], 0
                    if len(held_h) > most:
                        yield out(held_h, held_n)
                        held_h, held_n = held_h[:0], held_n[:0]
        yield out(*merged([(held_h, held_n), *parts]))

    return docs.select("text").mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int = TABLE) -> Table:
    """The table of the tokens of at least 2**k occurrences, for the least k that gives fewer than `most` of them."""
    # how many tokens have counts from each power of two on: the table is one filter, whatever the number of tokens
    powers = [F.count(F.when(F.col("n") >= 1 << k, 1)).alias(f"p{k}") for k in range(63)]
    found = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("distinct"), *powers).first()
    least = next((1 << k for k in range(63) if found[f"p{k}"] < most), 1 << 62)
    rows = counts.filter(F.col("n") >= least).toArrow()
    h = rows.column("h").to_numpy().view(np.uint64)
    n = rows.column("n").to_numpy()
    place = np.empty(len(h), dtype=np.int64)
    place[np.lexsort((h, -n))] = np.arange(1, len(h) + 1)
    order = np.argsort(h)
    return Table(h[order], n[order], place[order], int(found["total"]), int(found["distinct"]))


def fitted(prior: np.ndarray, seen: np.ndarray, start: np.ndarray, group: np.ndarray, rounds: int = ROUNDS, pull: float = PULL) -> np.ndarray:
    """Weights of the pairs of a feature and what it predicts: prior is their probability without the feature, seen their
    training count; pairs of one feature stand together, from start on. Pairs never seen keep weight zero."""
    n = np.add.reduceat(seen, start)[group]
    w, on = np.zeros(len(prior)), seen > 0
    for _ in range(rounds):
        p = normalised(prior, w, start, group)
        gradient = seen - n * p - pull * w
        w = np.where(on, np.clip(w + np.clip(gradient / (n * p * (1 - p) + pull), -2, 2), -12, 12), 0)
    return w


def normalised(prior: np.ndarray, w: np.ndarray, start: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Probabilities of pairs under weights: what a feature doesn't have a pair for keeps its prior in the sum."""
    up = prior * np.exp(w)
    return up / np.maximum(1 + np.add.reduceat(up - prior, start), 1e-12)[group]


def family(known: np.ndarray, feature: np.ndarray, target: np.ndarray, p: np.ndarray, training: np.ndarray, rounds: int = ROUNDS, pull: float = PULL) -> tuple[np.ndarray, np.ndarray]:
    """Adds one family of features: known numbers the context so far, feature (16 bits) is what the family adds to it, p is
    the probability of the target (below SIDE) so far. Returns the new probabilities and contexts."""
    key = (known << 16 | feature) << SIDE_BITS | target
    pairs, one, back = np.unique(key, return_index=True, return_inverse=True)
    context = pairs >> SIDE_BITS
    start = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
    group = np.cumsum(np.r_[False, context[1:] != context[:-1]])
    seen = np.bincount(back, training, len(pairs))
    w = fitted(p[one], seen, start, group, rounds, pull)
    return normalised(p[one], w, start, group)[back], group[back]


def learnt(features: list[np.ndarray], place: np.ndarray, training: np.ndarray, shares: tuple[np.ndarray, np.ndarray], rounds: int = ROUNDS, pull: float = PULL) -> np.ndarray:
    """log10 probabilities of occurrences (places after features), learnt from those of them that are for training."""
    kind, member = place >> SIDE_BITS, place & (SIDE - 1)
    out = np.zeros(len(place))
    for known, target, p in ((np.zeros(len(place), dtype=np.int64), kind, shares[0][kind]), (kind, member, shares[1][place])):
        for f in features:
            p, known = family(known, f, target, p, training, rounds, pull)
        out += np.log10(np.maximum(p, 1e-300))
    return out


_SENT = "owner int, flush bigint, events binary, texts binary, lists binary, rare binary"
_WIDTHS = (2, 2, 2, 3, 1)


def _occurrences(rows: DataFrame, table, owners: int, flush: int) -> DataFrame:
    """Rows for the owners (features, place and training of occurrences, and their texts in the flush) and, for each flush,
    its list of texts: uid, doc_id, whether it has one, held out, tokens, known ones, base score, score of its own, and
    the hashes of tokens outside the table."""

    def sent(items, lists, number):
        one, two, four, place, training, text, owner = items
        made = []
        for o, at in packed.dealt(owner, owners):
            columns = (one, two, four, place, training)
            body = b"".join(packed.planes(c[at], k) for c, k in zip(columns, _WIDTHS))
            made.append((o, number, body, packed.places(text[at]), None, None))
        made.append((number % owners, number, None, None, np.stack([x.view(np.int64) for x in lists[1:-1]]).tobytes(), np.concatenate(lists[-1]).tobytes() if len(lists[-1]) else b""))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), (pa.int32(), pa.int64(), *[pa.binary()] * 4))], names=["owner", "flush", "events", "texts", "lists", "rare"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part = table.value, TaskContext.get().partitionId()
        number, row = part << 32, part << 40
        load = max(1.0, known.total / (4 * owners))
        base_log, rest_log = logs(known)
        n_end = int(known.find(np.array([END], dtype=np.uint64))[0][0])
        held, rare, n_texts = packed.Flush(), [], 0

        def parts(h, n):
            return 1 + (np.where(h == np.uint64(BEGIN), n_end, n) / load).astype(np.int64)

        for b in batches:
            ids = b.column("doc_id")
            doc_ids, real = ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False)
            out, keys = b.column("held_out").to_numpy(zero_copy_only=False), b.column("row_key").to_numpy().view(np.uint64)
            for i, j, w, base in chunks(b.column("text"), BACK, SLICE):
                h, doc, at = tokens(w)
                n, place = known.find(h)
                one, two, four = (before(h, at, k) for k in (1, 2, 4))
                n_one, n_two = known.find(one)[0], known.find(two)[0]
                many, also = parts(one, n_one), parts(two, n_two)
                apart = mix(keys[i + doc] + np.uint64(5)) % np.minimum(many, also).astype(np.uint64)
                owner = packed.owner_of(mix(one + (mix(two) % many.astype(np.uint64)) * np.uint64(0x9FB21C651E98DF25) + apart * np.uint64(0xC2B2AE3D27D4EB4F)), owners)
                # the first words of a later chunk were counted in the one before
                own = np.ones(len(h), dtype=bool) if not base else at >= BACK
                low = lambda x: mix(x + np.uint64(7)).astype(np.uint16)
                items = (low(one), low(two), low(four), place.astype(np.uint32), ~out[i + doc], doc + n_texts, owner)
                found = n >= 0
                add = lambda x, doc=doc, own=own, k=w.n_docs: np.bincount(doc[own], x[own], k)
                n_tokens = np.bincount(doc[own], minlength=w.n_docs)
                lost = ~found & own
                n_rare = np.bincount(doc[lost], minlength=w.n_docs)
                base_score = add(np.log10(np.where(found, n, 0) + 1.0)) - n_tokens * base_log
                if known.total:
                    held.add(tuple(x[own] for x in items), np.zeros(w.n_docs, np.int64), (row + np.arange(i, j), doc_ids[i:j], real[i:j].astype(np.int64), out[i:j].astype(np.int64), n_tokens, add(found).astype(np.int64), base_score, -rest_log * n_rare, n_rare))
                else:
                    held.add(tuple(x[:0] for x in items), np.zeros(w.n_docs, np.int64), (row + np.arange(i, j), doc_ids[i:j], real[i:j].astype(np.int64), out[i:j].astype(np.int64), n_tokens, 0 * n_tokens, 0.0 * n_tokens, 0.0 * n_tokens, n_rare))
                rare.append(h[lost])
                n_texts += w.n_docs
                if held.size >= flush or n_texts >= flush:
                    items, lists = held.taken()
                    yield sent(items, [*lists, rare], number)
                    number, rare, n_texts = number + 1, [], 0
            row += b.num_rows
        if n_texts:
            items, lists = held.taken()
            yield sent(items, [*lists, rare], number)

    return rows.select("doc_id", "row_key", "held_out", "text").mapInArrow(run, _SENT)


def logs(table: Table) -> tuple[float, float]:
    """log10 of what counts plus one are divided by: for all tokens, and for those outside the table."""
    inside = int(table.counts.sum()), len(table.counts)
    return float(np.log10(table.total + table.distinct + 1)), float(np.log10(table.total - inside[0] + table.distinct - inside[1] + 1))


def _trained(table, rounds: int, pull: float):
    def owned(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("flush", pa.int64()), ("texts", pa.binary()), ("scores", pa.binary()), ("lists", pa.binary()), ("rare", pa.binary())])
        flush, text, parts = [], [], []
        for b in batches:
            for f, e, t, lists, rare in zip(b.column("flush").to_pylist(), *(b.column(c) for c in ("events", "texts", "lists", "rare"))):
                if lists.is_valid:
                    yield pa.RecordBatch.from_arrays([pa.array([f], pa.int64()), pa.array([None], pa.binary()), pa.array([None], pa.binary()), pa.array([lists.as_py()], pa.binary()), pa.array([rare.as_py()], pa.binary())], schema=schema)
                    continue
                raw = np.frombuffer(e.as_buffer(), dtype=np.uint8)
                n, at, columns = len(raw) // sum(_WIDTHS), 0, []
                for k in _WIDTHS:
                    columns.append(packed.numbers(raw[at : at + n * k], k))
                    at += n * k
                flush.append(f)
                text.append(packed.placed(t.as_buffer()))
                parts.append(columns)
        if not parts:
            return
        one, two, four, place, training = (np.concatenate(c) for c in zip(*parts))
        parts.clear()
        logp = learnt([one, two, four], place.astype(np.int64), training, table.value.shares(), rounds, pull)
        cuts = np.cumsum([0, *map(len, text)])
        for f, t, i, j in zip(flush, text, cuts[:-1], cuts[1:]):
            some, first = np.unique(t, return_index=True)
            sums = np.add.reduceat(logp[i:j], first)
            yield pa.RecordBatch.from_arrays([pa.array([f], pa.int64()), pa.array([packed.places(some)], pa.binary()), pa.array([sums.astype(np.float32).tobytes()], pa.binary()), pa.array([None], pa.binary()), pa.array([None], pa.binary())], schema=schema)

    return owned


def _summed(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of one flush with their scores."""
    lists, hashes, parts = None, None, []
    for b in batches:
        for t, s, found, rare in zip(*(b.column(c) for c in ("texts", "scores", "lists", "rare"))):
            if found.is_valid:
                lists = np.frombuffer(found.as_buffer(), dtype=np.int64).reshape(9, -1)
                hashes = np.frombuffer(rare.as_buffer(), dtype=np.int64)
            else:
                parts.append((packed.placed(t.as_buffer()), np.frombuffer(s.as_buffer(), dtype=np.float32)))
    uid, doc_id, real, out, n_tokens, n_known, base, own, n_rare = lists
    score = own.view(np.float64).copy()
    for t, s in parts:
        score[t] += s
    ids = pa.array(doc_id, mask=real == 0)
    outside = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n_rare)).astype(np.int32)), pa.array(hashes))
    yield pa.RecordBatch.from_arrays([pa.array(uid), ids, pa.array(out == 1), pa.array(n_tokens), pa.array(n_known), pa.array(base.view(np.float64)), pa.array(score), outside], names=["uid", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare"])


def score(docs: DataFrame, rounds: int = ROUNDS, pull: float = PULL, most: int = TABLE, owner_bytes: int = OWNER_BYTES, flush: int = packed.FLUSH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities) of each row of docs."""
    rows = texts(docs).withColumn("held_out", crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT)
    counts = saved(word_counts(rows.filter(~F.col("held_out"))), "counts")
    table = frequent(counts, most)
    shared = docs.sparkSession.sparkContext.broadcast(table)
    owners = packed.n_owners(docs, owner_bytes)
    sent = _occurrences(rows, shared, owners, flush)
    answers = sent.groupBy("owner").applyInArrow(_trained(shared, rounds, pull), "flush bigint, texts binary, scores binary, lists binary, rare binary")
    found = answers.groupBy("flush").applyInArrow(_summed, "uid bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double, rare array<bigint>")
    first = saved(found, "scores")
    # every such token adds the logarithm of its count to both scores; a token that isn't counted adds nothing
    more = first.select("uid", F.explode("rare").alias("h")).join(counts, "h").groupBy("uid").agg(F.count(F.lit(1)).alias("more"), F.sum(F.log10(F.col("n") + 1.0)).alias("logs"))
    # the chunks of a long text are one row
    sums = [F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")]
    out = first.groupBy("uid").agg(F.max("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), *sums).join(more, "uid", "left")
    extra = F.coalesce("logs", F.lit(0.0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).cast("bigint").alias("n_known"), F.lit(table.total).cast("bigint").alias("train_tokens"), (F.col("base_score") + extra).alias("base_score"), (F.col("score") + extra).alias("score"))
