"""Byte-level byte-pair encoding by a rank file.

``fold_merges`` is the encoder as column code: a higher-order fold over the pieces of a distinct word that joins, step by step, the
neighbours of lowest rank, with the ranks as one literal (buckets of small maps, so a look-up does not scan the vocabulary).
``encode_words`` applies it to a table of distinct words.

Whole documents take the same fold in Arrow batches instead: bringing the ids of distinct words back to every occurrence would shuffle the
corpus several times over (figures in the README). The new words of a run of texts are folded side by side (``joins``). A task keeps the words it has
met, within a bound; a forgotten word is folded again. Decoding concatenates the binary pieces of the ids.
"""
import base64
import hashlib
import json
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import LONGEST, MOST_RANKS, Joins, grouped, looked_up

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
KEPT_WORDS = 200_000
KEPT_LENGTH = 64
LONG_WORD = 400
RANK_BUCKETS = 1 << 15
_BYTES = [bytes([i]) for i in range(256)]
_NONE = 1 << 60


def read_ranks(path):
    """Ranks by token bytes from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}


def default_ranks():
    import public_tokenizers
    return read_ranks(public_tokenizers.path(VOCABULARY)), public_tokenizers.PATTERN


def fold(word, ranks):
    """The ids of a word: neighbours of lowest rank join first, the leftmost of equals."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > LONG_WORD:
        return _fold_long(word, ranks)
    n = len(word)
    parts, get = [_BYTES[c] for c in word], ranks.get
    score = [get(word[i:i + 2], _NONE) for i in range(n - 1)]
    while score:
        best = min(score)
        if best == _NONE:
            break
        at = score.index(best)
        parts[at] += parts.pop(at + 1)
        del score[at]
        if at < len(score):
            score[at] = get(parts[at] + parts[at + 1], _NONE)
        if at:
            score[at - 1] = get(parts[at - 1] + parts[at], _NONE)
    return [ranks[p] for p in parts]


def _fold_long(word, ranks):
    """The same for very long words: a heap of candidate joins over a linked list, n log n instead of n squared."""
    from heapq import heapify, heappop, heappush
    n = len(word)
    end, nxt, prev = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    get, alive = ranks.get, [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(word[i:i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, stop = heappop(heap)
        j = nxt[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue  # one side has changed since
        end[i], nxt[i], alive[j] = end[j], nxt[j], False
        if nxt[i] < n:
            prev[nxt[i]] = i
            if (r := get(word[i:end[nxt[i]]])) is not None:
                heappush(heap, (r, i, end[nxt[i]]))
        if prev[i] >= 0 and (r := get(word[prev[i]:end[i]])) is not None:
            heappush(heap, (r, prev[i], end[i]))
    return [ranks[word[i:end[i]]] for i in range(n) if alive[i]]


class Coder:
    """Splits, folds and decodes; remembers at most ``keep`` words, or those of the texts at hand.

    A word's ids are kept as their decimal text, and the bytes they decode to under that text. The new words of several texts are folded
    together, very long ones by themselves.
    """

    def __init__(self, ranks, pattern, keep=KEPT_WORDS):
        import regex
        self.ranks, self.split, self.keep, self.words, self.bytes = ranks, regex.compile(pattern), keep, {}, {}
        self.pieces = {i: b for b, i in ranks.items()}
        self.decimal = {i: str(i) for i in self.pieces}
        self.spelled = {self.decimal[i]: b for i, b in self.pieces.items()}

    @cached_property
    def joins(self):
        """The first token of each byte and the joins; none for rank files without every byte or with huge ranks."""
        ranks = self.ranks
        first, top = np.array([ranks.get(b, -1) for b in _BYTES]), max(ranks.values(), default=0) + 1
        if first.min() < 0 or top > MOST_RANKS:
            return None
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        return first, Joins(pairs, np.arange(top), top)

    def _folded(self, words):
        words = [w.encode("utf-8") for w in words]
        decimal, out, many = self.decimal, [None] * len(words), []
        for k, w in enumerate(words):
            if w in self.ranks:
                out[k] = decimal[self.ranks[w]]
            elif len(w) > LONGEST or not self.joins:
                out[k] = ",".join([decimal[i] for i in fold(w, self.ranks)])
            else:
                many.append(k)
        if many:
            first, joins = self.joins
            sizes = np.array([len(words[k]) for k in many])
            ids, counts = joins.words(first[np.frombuffer(b"".join([words[k] for k in many]), np.uint8)], sizes)
            ids, end = [decimal[i] for i in ids.tolist()], 0
            for k, n in zip(many, counts.tolist()):
                end += n
                out[k] = ",".join(ids[end - n:end])
        return out

    def _decoded(self, words):
        piece = self.spelled.__getitem__
        return [b"".join(map(piece, ids.split(","))) for ids in words]

    def words_of(self, texts):
        """For each text the ids of its words, as decimal numbers joined by commas."""
        return looked_up(self.words, list(map(self.split.findall, texts)), self._folded, self.keep, KEPT_LENGTH)

    def bytes_of(self, coded):
        """For each text its words' bytes, from what ``words_of`` gives."""
        return looked_up(self.bytes, coded, self._decoded, self.keep, 6 * KEPT_LENGTH)

    def word_ids(self, text):
        return self.words_of([text])[0]

    def word_bytes(self, ids):
        return self.bytes_of([ids])[0]

    def encode(self, text):
        words = self.word_ids(text)
        return [int(i) for i in ",".join(words).split(",")] if words else []

    def decode(self, ids):
        return b"".join(map(self.pieces.__getitem__, ids))


_CODERS = {}


def _coder(path, pattern):
    """One coder per worker process, from the vocabulary that is installed with the tokenizers there."""
    if (path, pattern) not in _CODERS:
        import public_tokenizers
        ranks = read_ranks(public_tokenizers.path(path)) if "/" not in path else read_ranks(path)
        _CODERS[path, pattern] = Coder(ranks, pattern)
    return _CODERS[path, pattern]


def encode_documents(docs: DataFrame, id_col="doc_id", text_col="text", vocabulary=VOCABULARY, pattern=None) -> DataFrame:
    """One row per input row: doc_id, ids array<int>. ``vocabulary`` names an installed rank file or gives a path that every executor has.

    A null or empty text has no ids. Other columns are ignored.
    """
    kind, pattern = docs.schema[id_col].dataType.simpleString(), pattern or default_pattern()

    def run(batches):
        coder = _coder(vocabulary, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([coder.encode(t or "") for t in b.column(1).to_pylist()], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode_documents(coded: DataFrame, vocabulary=VOCABULARY, pattern=None) -> DataFrame:
    """One row per row of (doc_id, ids): doc_id, bytes. Null ids decode to no bytes."""
    kind, pattern = coded.schema["doc_id"].dataType.simpleString(), pattern or default_pattern()

    def run(batches):
        coder = _coder(vocabulary, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([coder.decode(x or ()) for x in b.column(1).to_pylist()], pa.binary())], names=["doc_id", "bytes"])

    return coded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, bytes binary")


def default_pattern():
    import public_tokenizers
    return public_tokenizers.PATTERN


def round_trip(docs: DataFrame, id_col="doc_id", text_col="text", vocabulary=VOCABULARY, pattern=None) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256 of the decimal ids joined by commas, decoded_sha256 of the decoded bytes.

    Texts are encoded whole, without special tokens; a null text counts as empty. Encoding and decoding share one pass over a batch, so ids
    are not kept. Other columns are ignored; an empty table gives no rows.
    """
    kind, pattern = docs.schema[id_col].dataType.simpleString(), pattern or default_pattern()

    def run(batches):
        coder = _coder(vocabulary, pattern)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for texts in grouped(b.column(1).to_pylist()):
                coded = coder.words_of(texts)
                for words, parts in zip(coded, coder.bytes_of(coded)):
                    ids = ",".join(words)
                    n.append(ids.count(",") + bool(words))
                    ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                    text_sha.append(hashlib.sha256(b"".join(parts)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"))


def rank_literal(ranks, buckets=RANK_BUCKETS) -> Column:
    """The rank map as one constant: an array of small maps from hex tokens to ranks, by CRC of the hex."""
    import zlib
    table = [{} for _ in range(buckets)]
    for token, rank in ranks.items():
        h = token.hex().upper()
        table[zlib.crc32(h.encode()) % buckets][h] = rank
    return F.from_json(F.lit(json.dumps(table)), "array<map<string,int>>")


def fold_merges(word: Column, ranks, buckets=RANK_BUCKETS) -> Column:
    """Ids of a binary word, as column code: n - 1 fold steps, each joining the leftmost neighbours of lowest rank if any."""
    table = rank_literal(ranks, buckets)

    def rank(h):
        return F.element_at(F.element_at(table, (F.crc32(h.cast("binary")) % buckets + 1).cast("int")), h)

    n = F.octet_length(word)
    none = F.lit(2 ** 31 - 1)
    start = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.hex(F.substring(word, i, F.lit(1))))).otherwise(F.expr("array()").cast("array<string>"))

    def step(parts, _):
        pairs = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))),
                            lambda p, i: F.struct(F.coalesce(rank(F.concat(p, F.element_at(parts, i + 2))), none).alias("r"), i.alias("i")))
        best = F.array_min(pairs)
        joined = F.concat(F.slice(parts, 1, best["i"]), F.array(F.concat(F.element_at(parts, best["i"] + 1), F.element_at(parts, best["i"] + 2))),
                          F.slice(parts, best["i"] + 3, F.size(parts)))
        return F.when((F.size(parts) < 2) | (best["r"] == none), parts).otherwise(joined)

    merged = F.aggregate(F.when(n > 1, F.sequence(F.lit(2), n)).otherwise(F.expr("array()").cast("array<int>")), start, step)
    whole = rank(F.hex(word))
    return F.when(whole.isNotNull(), F.array(whole)).otherwise(F.transform(merged, rank))


def encode_words(words: DataFrame, ranks, word_col="word") -> DataFrame:
    """(word, ids) for each distinct binary word."""
    return words.select(F.col(word_col).alias("word")).distinct().withColumn("ids", fold_merges(F.col("word"), ranks))
