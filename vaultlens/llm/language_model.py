"""Language-model scoring by a weighted backoff automaton over words.

Unigrams are smoothed by adding one; bigrams and trigrams by a Dirichlet prior
on the order below: p(w | uv) = (c(uvw) + mu * p(w | v)) / (c(uv) + mu).  The
states are the words and the bigrams seen in training.  A state has an arc,
weighted log10 p, for each word seen after it, which leads to the longest state
that ends the history then; its failure arc, weighted log10(mu / (c + mu)),
leads from a bigram to its second word and from a word to the root, which has
an arc for every word.  A text is read once from left to right from the state
of the end token; the state is carried on, failure arcs are followed until an
arc fits, and the weights of all arcs taken are added up.

The model is never gathered in one place.  Texts become blocks of about 6 MB,
stored once with words as local codes.  A block sends the hash and count of
each of its distinct n-grams to the group that the hash falls in; the group adds
up all blocks' counts and answers each block with the totals of what it asked
for, from which the block builds its part of the automaton.  A word with a
third of all tokens is one entry of each block.  Entries travel sorted, as
compressed differences, so a block and a group exchange one row for each order;
block_bytes and group_entries should both grow with the square root of the
input where blocks times groups would be more rows than entries justify.

Words are told apart by 64-bit hashes.  Longer n-grams are told apart by as
many bits of theirs, up to 64, as keep the chance that one meets another's
below 2 ** -24.  Counts and codes have no fixed width.

Defined cases: null text is the empty text, which is the end token alone; a
null doc_id has the empty string's remainder; repeated rows each count; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultlens.llm import common
from vaultlens.llm.common import NOT_BLANK, arrow_schema, batch, expand, picked, scratch, spark_type, squeeze, stored

ORDER = 3
BLOCK_BYTES = 6 << 20
#: Entries that a group adds up at once.
GROUP_ENTRIES = 1_000_000
#: Tasks that the groups are dealt out to at most; beyond it a task reads several groups, one after the other.
MOST_TASKS = 20_000
#: Bits of an n-gram's hash beyond those that number the corpus's tokens.
CLASH_BITS = 24
END = np.uint64(0x5851F42D4C957F2D)
BLOCK = "block long, doc_ids array<bigint>, held binary, ends binary, codes binary, vocabulary binary, n_words long, n_tokens long, train_tokens long"
ASKED = "block long, part long, hashes binary, counts binary"
ANSWER = "block long, part long, totals binary, n_distinct long"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def held_out(doc_id: int | None, of: int, is_: int) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % of == is_


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each token, tokens up to the end of each document); END closes each document."""
    data = common.ascii_lower(data)
    starts, ends, doc = common.words(data, offsets, NOT_BLANK)
    stop = np.searchsorted(doc, np.arange(1, len(offsets)))
    hashes = np.insert(common.span_hash(data, starts, ends), stop, END)
    return hashes, stop + np.arange(1, len(offsets))


def make_blocks(docs: DataFrame, path: str, of: int, is_: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Store the blocks of docs (doc_id, text), bucketed by block so that answers join them where they are."""
    out, spark = arrow_schema(BLOCK), docs.sparkSession

    def block(part: int, seq: int, ids: list, hashes: list, ends: list) -> pa.RecordBatch:
        flat, n = np.concatenate(hashes), 0
        for e in ends:
            e += n
            n = e[-1]
        ends = np.concatenate(ends)
        vocabulary, code, count = np.unique(flat, return_inverse=True, return_counts=True)
        order = np.argsort(-count, kind="stable")  # frequent words get small codes
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        vocabulary, code = vocabulary[order], rank[code]
        held = np.array([held_out(i, of, is_) for i in ids])
        length = np.diff(ends, prepend=0)
        return batch(out, [part << 32 | seq], [ids], [held.tobytes()], [squeeze(ends)], [squeeze(code)], [vocabulary.tobytes()],
                     [len(vocabulary)], [len(code)], [int(length[~held].sum())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, size = TaskContext.get().partitionId(), 0, 0
        ids, hashes, ends = [], [], []
        for b in batches:
            names = b.column("doc_id").to_pylist()
            for i, j, data, off in common.chunks(b.column("text")):
                h, e = tokens(data, off)
                ids += names[i:j]
                hashes.append(h)
                ends.append(e)
                size += len(data)
                if size >= block_bytes:
                    yield block(part, seq, ids, hashes, ends)
                    ids, hashes, ends, seq, size = [], [], [], seq + 1, 0
        if ids:
            yield block(part, seq, ids, hashes, ends)

    name = "language_model_blocks_" + path.rpartition("-")[2]
    made = docs.select("doc_id", "text").mapInArrow(run, spark_type(BLOCK))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made.write.option("path", path).option("compression", "zstd").bucketBy(n, "block").saveAsTable(name)
    blocks = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # its files stay, and blocks knows their buckets
    return blocks


def train_places(held: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each token is learnt from."""
    return np.repeat(~held, np.diff(ends, prepend=0))


class Local:
    """A block's words and documents, and the hashes of the n-grams that its tokens end."""

    def __init__(self, row: dict, bits: int):
        self.codes, self.vocabulary = expand(row["codes"]).astype(np.int64), np.frombuffer(row["vocabulary"], np.uint64)
        self.ends, self.held = expand(row["ends"]).astype(np.int64), np.frombuffer(row["held"], bool)
        self.first = np.concatenate([[0], self.ends[:-1]])
        self.end_code = int(np.flatnonzero(self.vocabulary == END)[0])
        self.train, self.bits = train_places(self.held, self.ends), bits

    def before(self) -> np.ndarray:
        """The word before each token; a document begins after an end token."""
        out = np.empty_like(self.codes)
        out[1:] = self.codes[:-1]
        out[self.first] = self.end_code
        return out

    def ngrams(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places of the tokens that end one, its hash) for each order from 2 on; its context begins in the document or is its end mark."""
        word = self.vocabulary[self.codes]
        hashes = common.mix64(self.vocabulary[self.before()] * common.PRIME + word)
        drop, place = np.uint64(64 - self.bits), np.arange(len(word))
        yield place, hashes >> drop
        for _ in range(3, ORDER + 1):
            inner = np.ones(len(word), bool)
            inner[self.first] = False
            place = place[inner[place]]
            hashes = np.append(np.uint64(0), hashes[:-1])
            hashes = common.mix64(hashes * common.PRIME + word)
            yield place, hashes[place] >> drop


def runs(values: np.ndarray) -> np.ndarray:
    """The first place of each distinct value of a sorted array."""
    return np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)


def tally(hashes: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hashes in order, how often each is learnt from)."""
    seen, rest = np.sort(hashes[train]), np.sort(hashes[~train])
    first = runs(seen)
    distinct, n = seen[first], np.diff(first, append=len(seen))
    rest = rest[runs(rest)]
    if len(distinct):
        rest = rest[distinct[np.minimum(np.searchsorted(distinct, rest), len(distinct) - 1)] != rest]
    both = np.concatenate([distinct, rest])
    order = np.argsort(both, kind="stable")
    return both[order], np.concatenate([n, np.zeros(len(rest), np.int64)])[order]


def bounds(hashes: np.ndarray, bits: int, groups: int) -> np.ndarray:
    """Where each of the groups, equal ranges of all hashes of so many bits, begins and ends in sorted hashes."""
    high = hashes >> np.uint64(bits - 32)
    return np.searchsorted((high * np.uint64(groups)) >> np.uint64(32), np.arange(groups + 1, dtype=np.uint64))


def ask(blocks: DataFrame, groups: list[int], bits: int) -> DataFrame:
    """ASKED: each block's distinct n-grams with their training counts, by group; groups: how many each order has."""
    out = arrow_schema(ASKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1).to_pylist()[0]
                local, part = Local(row, bits), 0
                order = np.argsort(local.vocabulary)
                words = np.bincount(local.codes[local.train], minlength=len(local.vocabulary))
                tallies = [(local.vocabulary[order], words[order], 64), *((*tally(h, local.train[place]), bits) for place, h in local.ngrams())]
                for (hashes, counts, wide), n in zip(tallies, groups, strict=True):
                    at = bounds(hashes, wide, n)
                    here = np.flatnonzero(at[1:] > at[:-1])
                    cut = [(int(at[g]), int(at[g + 1])) for g in here]
                    gaps = [squeeze(np.diff(hashes[x:y], prepend=np.uint64(0))) for x, y in cut]
                    yield batch(out, [row["block"]] * len(cut), here + part, gaps, [squeeze(counts[x:y]) for x, y in cut])
                    part += n

    return blocks.select("block", "held", "ends", "codes", "vocabulary").mapInArrow(run, ASKED)


def answer(asked: DataFrame, groups: int) -> DataFrame:
    """ANSWER: the totals over all blocks of what each block asked for, in its order; groups: how many all orders have together.

    There are as many tasks as groups, so what one reads stays the same as the input grows.
    """
    out = arrow_schema(ANSWER)

    def total(part: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        hashes = [np.cumsum(expand(h), dtype=np.uint64) for _, h, _ in rows]
        counts = np.concatenate([expand(c) for *_, c in rows]).astype(np.int64)
        flat = np.concatenate(hashes)
        order = np.argsort(flat, kind="stable")  # a merge of sorted runs
        first = runs(flat[order])
        sums = np.add.reduceat(counts[order], first)
        of = np.empty(len(flat), np.int64)
        of[order] = np.repeat(sums, np.diff(first, append=len(flat)))
        distinct, n = int(np.count_nonzero(sums)), 0
        for k, (block, *_) in enumerate(rows):
            size = len(hashes[k])
            yield batch(out, [block], [part], [squeeze(of[n : n + size])], [distinct if k == 0 else 0])
            n += size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        for b in batches:
            for block, part, hashes, counts in zip(*(b.column(c).to_pylist() for c in ("block", "part", "hashes", "counts")), strict=True):
                if part != at and rows:
                    yield from total(at, rows)
                    rows = []
                at = part
                rows.append((block, hashes, counts))
        if rows:
            yield from total(at, rows)

    n = max(int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(groups, MOST_TASKS))
    return asked.repartition(n, "part").sortWithinPartitions("part", "block").mapInArrow(run, ANSWER)


class Automaton:
    """States are numbers; those below the number of words are the words themselves, and the root has the number past the last.

    arcs: sorted state * words + word; weights and targets: of each arc;
    fail and back: weight and target of each state's failure arc; root: the
    weights of the root's arcs, which lead to the words.
    """

    LANES = 4096

    def __init__(self, arcs: np.ndarray, weights: np.ndarray, targets: np.ndarray, fail: np.ndarray, back: np.ndarray, root: np.ndarray):
        self.arcs, self.weights, self.targets, self.fail, self.back, self.root = arcs, weights, targets, fail, back, root

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next state, log10 probability) for reading word in state."""
        to, weight = word.copy(), np.zeros(len(word))
        on = np.arange(len(word))
        while len(on):
            s, w = state[on], word[on]
            rooted = s == len(self.fail)
            weight[on[rooted]] += self.root[w[rooted]]
            on, s, w = on[~rooted], s[~rooted], w[~rooted]
            if len(self.arcs):
                at = np.minimum(np.searchsorted(self.arcs, s * len(self.root) + w), len(self.arcs) - 1)
                hit = self.arcs[at] == s * len(self.root) + w
                weight[on[hit]] += self.weights[at[hit]]
                to[on[hit]] = self.targets[at[hit]]
                on, s = on[~hit], s[~hit]
            weight[on] += self.fail[s]
            state = state.copy()
            state[on] = self.back[s]
        return to, weight

    def read(self, words: np.ndarray, first: np.ndarray, start: int) -> np.ndarray:
        """Weights along one traversal of words, back in state start at each of the positions first.

        The traversal is cut into lanes that advance side by side.  A lane
        enters in the state its predecessor ends in: the longest that the words
        before it make, to which any history leads that is read for ORDER - 2
        words from a word's state.
        """
        n = len(words)
        out = np.zeros(n)
        steps = max(1, -(-n // self.LANES))
        fresh = np.zeros(n, bool)
        fresh[first] = True
        lanes = np.arange(0, n, steps)
        state = words[np.maximum(lanes - ORDER + 1, 0)]
        for k in range(2 - ORDER, steps):
            on = np.flatnonzero((lanes + k >= 0) & (lanes + k < n))
            at = lanes[on] + k
            state[on], weight = self.step(np.where(fresh[at], start, state[on]), words[at])
            if k >= 0:
                out[at] = weight
        return out


def numbered(hashes: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(total of each hash, the place of one token of each distinct hash), totals in the hashes' order."""
    order = np.argsort(hashes)
    first = runs(hashes[order])
    of = np.empty(len(hashes), np.int64)
    of[order] = np.repeat(totals, np.diff(first, append=len(hashes)))
    return of, order[first]


def score_block(row: dict, answers: dict[int, bytes], n_train: int, n_distinct: int, groups: list[int], bits: int, mu: float) -> tuple:
    local = Local(row, bits)
    ends = np.cumsum(groups)
    totals = [np.concatenate([np.zeros(0, np.int64), *(expand(answers[g]).astype(np.int64) for g in range(e - n, e) if g in answers)]) for e, n in zip(ends.tolist(), groups, strict=True)]
    words = np.empty(len(local.vocabulary), np.int64)
    words[np.argsort(local.vocabulary)] = totals[0]
    size = len(words)
    chance = (words + 1) / (n_train + n_distinct + 1)
    root, codes, before = np.log10(chance), local.codes, local.before()
    (_, pair_hash), (place, triple_hash) = local.ngrams()
    pairs, at = numbered(pair_hash, totals[1])
    chance = (pairs + mu * chance[codes]) / (words[before] + mu)  # of each token after the one before it
    at = at[pairs[at] > 0]
    keys = before[at] * size + codes[at]
    order = np.argsort(keys)
    keys, at = keys[order], at[order]
    state = np.full(len(codes), -1)  # the bigram that each token ends, if it was seen
    seen = np.flatnonzero(pairs > 0)
    state[seen] = size + np.searchsorted(keys, before[seen] * size + codes[seen])
    triples, last = numbered(triple_hash, totals[2])
    triples, last = triples[last], place[last]
    last, triples = last[triples > 0], triples[triples > 0]
    long_keys = state[last - 1] * size + codes[last]
    order = np.argsort(long_keys)
    last, triples, long_keys = last[order], triples[order], long_keys[order]
    context = pairs[last - 1]
    automaton = Automaton(
        np.concatenate([keys, long_keys]),
        np.log10(np.concatenate([chance[at], (triples + mu * chance[last]) / (context + mu)])),
        np.concatenate([size + np.arange(len(keys)), state[last]]),
        np.log10(mu / (np.concatenate([words, pairs[at]]) + mu)),
        np.concatenate([np.full(size, size + len(keys)), codes[at]]), root,
    )
    weights = automaton.read(codes, local.first, local.end_code)
    add = lambda x: np.add.reduceat(x, local.first)  # noqa: E731  every document has a token at least
    return local.held, np.diff(local.ends, prepend=0), add((words[codes] > 0).astype(np.int64)), add(root[codes]), add(weights)


def score(docs: DataFrame, of: int = 7, is_: int = 2, mu: float = 100.0, block_bytes: int = BLOCK_BYTES, group_entries: int = GROUP_ENTRIES) -> DataFrame:
    """SCORED for every row of docs (doc_id, text); rows with crc32(doc_id) mod ``of`` = ``is_`` aren't learnt from."""
    spark = docs.sparkSession
    blocks = make_blocks(picked(docs, "doc_id", "text"), scratch(spark, "model-blocks"), of, is_, block_bytes)
    size = [n or 0 for n in blocks.agg(F.sum("n_words"), F.sum("n_tokens"), F.sum("train_tokens")).first()]
    groups = [max(1, -(-n // group_entries)) for n in (size[0], *[size[1]] * (ORDER - 1))]
    bits, word_groups = min(64, max(40, size[1].bit_length() + CLASH_BITS)), groups[0]
    answers = stored(answer(ask(blocks, groups, bits), sum(groups)), "model-answers")
    n_distinct = answers.where(F.col("part") < word_groups).agg(F.sum("n_distinct")).first()[0] or 0
    by_block = answers.groupBy("block").agg(F.collect_list(F.struct("part", "totals")).alias("answers"))
    out = arrow_schema(SCORED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1).to_pylist()[0]
                got = {a["part"]: a["totals"] for a in row.pop("answers")}
                held, n_tokens, n_known, base, full = score_block(row, got, size[2], n_distinct, groups, bits, mu)
                yield batch(out, row["doc_ids"], held, n_tokens, n_known, np.full(len(held), size[2]), base, full)

    return blocks.drop("n_words", "n_tokens", "train_tokens").join(by_block, "block").mapInArrow(run, SCORED)
