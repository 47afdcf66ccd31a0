"""Byte-pair encoding with word ends, by a contiguous rank array.

A word is its bytes as printable characters with an end mark on the last one. ``join_parts`` holds the boundaries of its parts and, side by
side, the rank of every adjacent pair; it scans the array for the lowest rank, deletes that boundary and refreshes the two
neighbouring ranks, until no pair has a rank. A scan of a short list is cheaper than a queue. The new words of a run of texts take these steps
together, a column of ranks each (``joins``), unless they have more than ``LONGEST`` bytes. Words of more than ``LONG_WORD`` characters use
``join_long``: the same array in blocks that remember their minimum, so a step looks at one block and at the minima.

Around it: texts are cut at the special tokens' strings, brought to composed form and lower case character by character, and split by
the pattern of the vocabulary file; white space vanishes. Decoding joins the ids' tokens by blanks, as the file names no decoder.
Each worker reads the file where the tokenizers are installed and remembers a bounded number of words. Character classes come from the
installed Unicode tables: characters that Unicode assigned after version 15.1 may be classed otherwise than by the library; all others agree.
"""
import hashlib
import json
import unicodedata
from functools import cached_property
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import LONGEST, MOST_RANKS, Joins, grouped, looked_up

VOCABULARY = "word_bpe_49k.json"
LONG_WORD = 256
BLOCK = 512
KEPT_WORDS = 200_000
KEPT_LENGTH = 48
NONE = 1 << 40


def byte_characters():
    """A printable character for each byte: Latin-1's own where it is printable, else the next free one from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(rest)) for b in range(256)]


def join_parts(word, n, ranks):
    """Parts of a word whose first n - 1 parts are single characters and whose n-th is the remainder; the leftmost of equal ranks joins first."""
    get = ranks.get
    edges = [*range(n), len(word)]
    near = [get((word[i], word[i + 1:edges[i + 2]]), NONE) for i in range(n - 1)]
    while near:
        low = min(near)
        if low == NONE:
            break
        i = near.index(low)
        del edges[i + 1], near[i]
        if i < len(near):
            near[i] = get((word[edges[i]:edges[i + 1]], word[edges[i + 1]:edges[i + 2]]), NONE)
        if i:
            near[i - 1] = get((word[edges[i - 1]:edges[i]], word[edges[i]:edges[i + 1]]), NONE)
    return [word[a:b] for a, b in pairwise(edges)]


def join_long(word, n, ranks, block=BLOCK):
    """The same for long words. A deleted boundary leaves an unused place; ``after`` and ``before`` lead to the next parts."""
    get = ranks.get
    end = [*range(1, n), len(word)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    near = np.full(-(-n // block) * block, NONE, np.int64)
    near[:n - 1] = [get((word[i], word[i + 1:end[i + 1]]), NONE) for i in range(n - 1)]
    rows = near.reshape(-1, block)
    low = rows.min(axis=1)

    def put(i, rank):
        near[i] = rank
        low[i // block] = rows[i // block].min()

    def rank(i):
        j = after[i]
        return get((word[i:end[i]], word[j:end[j]]), NONE) if j < n else NONE

    while True:
        b = int(low.argmin())
        if low[b] == NONE:
            break
        i = b * block + int(rows[b].argmin())
        j = after[i]
        end[i], after[i] = end[j], after[j]
        if after[i] < n:
            before[after[i]] = i
        put(j, NONE)
        put(i, rank(i))
        if before[i] >= 0:
            put(before[i], rank(before[i]))
    out, i = [], 0
    while i < n:
        out.append(word[i:end[i]])
        i = after[i]
    return out


class WordCoder:
    """Encoder and decoder of one vocabulary file; remembers at most ``keep`` words.

    Only files of the kind described above are taken: other normalizers, splits or decoders raise.
    """

    def __init__(self, path, keep=KEPT_WORDS):
        import regex
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        kinds = [s["type"] for s in spec["normalizer"]["normalizers"]], [s["type"] for s in steps]
        if kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or spec["decoder"] or model["continuing_subword_prefix"]:
            raise ValueError(f"not a lower-case vocabulary with word ends: {kinds}")
        self.vocab, self.suffix = model["vocab"], model["end_of_word_suffix"]
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(model["merges"])}
        self.tokens = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        self.split = regex.compile(steps[0]["pattern"]["Regex"])
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.chars = dict(enumerate(byte_characters()))
        self.keep, self.words, self.texts = keep, {}, {}

    def parts(self, word):
        s = word.encode("utf-8").decode("latin-1").translate(self.chars)
        return (join_parts if len(s) <= LONG_WORD else join_long)(s + self.suffix, len(s), self.ranks)

    @cached_property
    def joins(self):
        """The first tokens of each byte, within a word and at its end, and the joins; none if the vocabulary lacks one of them."""
        vocab, chars = self.vocab, self.chars.values()
        first = np.array([[vocab.get(c, -1) for c in chars], [vocab.get(c + self.suffix, -1) for c in chars]])
        pairs = [(vocab.get(a, -1), vocab.get(b, -1), i) for (a, b), i in self.ranks.items()]
        joined, top = np.full(max(self.ranks.values(), default=-1) + 1, -1), max(vocab.values()) + 1
        for (a, b), i in self.ranks.items():
            joined[i] = vocab.get(a + b, -1)
        if first.min() < 0 or len(joined) > MOST_RANKS or any(min(p[0], p[1], joined[p[2]]) < 0 for p in pairs):
            return None
        return first, Joins(pairs, joined, top)

    def _coded(self, keys):
        """Ids of new words; a special token is its string in a tuple."""
        out, many = [None] * len(keys), []
        for k, w in enumerate(keys):
            if isinstance(w, tuple):
                out[k] = np.array([self.special[w[0]]], "<u4").tobytes()
            elif 4 * len(w) > LONGEST and len(w.encode("utf-8")) > LONGEST or not self.joins:
                out[k] = np.array([self.vocab[p] for p in self.parts(w)], "<u4").tobytes()
            else:
                many.append(k)
        if many:
            first, joins = self.joins
            words = [keys[k].encode("utf-8") for k in many]
            sizes, code = np.array([len(w) for w in words]), np.frombuffer(b"".join(words), np.uint8)
            tokens = first[0][code]
            last = np.cumsum(sizes) - 1
            tokens[last] = first[1][code[last]]
            ids, counts = joins.words(tokens, sizes)
            ids, end = ids.astype("<u4").tobytes(), 0
            for k, n in zip(many, (4 * counts).tolist()):
                end += n
                out[k] = ids[end - n:end]
        return out

    def _texts(self, words):
        token = self.tokens.__getitem__
        ids = iter(np.frombuffer(b"".join(words), "<u4").tolist())
        return [" ".join(map(token, islice(ids, len(w) // 4))) for w in words]

    def _split(self, text):
        """The words and special tokens of a text, the latter in tuples."""
        out = []
        for i, part in enumerate(self.cut.split(text) if "<|" in text else (text,)):
            if i % 2:
                out.append((part,))
            elif part.isascii():
                out += self.split.findall(part.lower())
            else:  # a capital sigma has one lower form here, wherever it stands
                out += self.split.findall(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())
        return out

    def words_of(self, texts):
        """For each text the ids of its words and special tokens, as little-endian unsigned 32-bit numbers."""
        return looked_up(self.words, list(map(self._split, texts)), self._coded, self.keep, KEPT_LENGTH)

    def texts_of(self, coded):
        """For each text its words' decoded texts, from what ``words_of`` gives."""
        return looked_up(self.texts, coded, self._texts, self.keep, 4 * KEPT_LENGTH)

    def word_ids(self, text):
        return self.words_of([text])[0]

    def encode(self, text):
        return np.frombuffer(b"".join(self.word_ids(text)), "<u4").tolist()

    def decode(self, ids):
        return " ".join([self.tokens[i] for i in ids])

    def decode_words(self, words):
        return " ".join(self.texts_of([words])[0])


_CODERS = {}


def _coder(vocabulary):
    """One coder per worker process, from the file that is installed with the tokenizers there."""
    if vocabulary not in _CODERS:
        import public_tokenizers
        _CODERS[vocabulary] = WordCoder(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary))
    return _CODERS[vocabulary]


def _mapped(rows: DataFrame, columns, kinds, make, vocabulary):
    """Arrow batches of two columns through ``make(coder, values)``, which gives the columns after the first."""
    names = [n for n, _ in kinds]
    types = [t for _, t in kinds]
    schema = ", ".join([f"`{names[0]}` {rows.schema[columns[0]].dataType.simpleString()}"] + [f"{n} {t}" for n, t in kinds[1:]])
    arrow = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}

    def run(batches):
        coder = _coder(vocabulary)
        for b in batches:
            made = make(coder, b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(m, arrow[t]) for m, t in zip(made, types[1:]))], names=names)

    return rows.select(F.col(columns[0]).alias(names[0]), F.col(columns[1]).alias("value")).mapInArrow(run, schema)


def encode_documents(docs: DataFrame, id_col="doc_id", text_col="text", vocabulary=VOCABULARY) -> DataFrame:
    """One row per input row: doc_id, ids array<int>. ``vocabulary`` names an installed file or gives a path that every executor has.

    A null or empty text has no ids. Other columns are ignored; repeated rows and ids stay; an empty table gives no rows.
    """
    return _mapped(docs, (id_col, text_col), [("doc_id", None), ("ids", "array<int>")],
                   lambda coder, texts: [[coder.encode(t or "") for t in texts]], vocabulary)


def decode_documents(coded: DataFrame, vocabulary=VOCABULARY) -> DataFrame:
    """One row per row of (doc_id, ids): doc_id, text, special tokens included. Null ids decode to the empty text."""
    return _mapped(coded, ("doc_id", "ids"), [("doc_id", None), ("text", "string")],
                   lambda coder, ids: [[coder.decode(x or ()) for x in ids]], vocabulary)


def round_trip(docs: DataFrame, id_col="doc_id", text_col="text", vocabulary=VOCABULARY) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256 of the ids as little-endian 32-bit numbers, decoded_sha256 of the decoded text.

    Texts are encoded whole; null counts as empty. Encoding and decoding share one pass over a batch, so ids are not kept. Other columns
    are ignored; an empty table gives no rows.
    """
    def digests(coder, texts):
        n, ids_sha, text_sha = [], [], []
        for group in grouped(texts):
            coded = coder.words_of(group)
            for words, parts in zip(coded, coder.texts_of(coded)):
                ids = b"".join(words)
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(" ".join(parts).encode("utf-8")).hexdigest())
        return n, ids_sha, text_sha

    return _mapped(docs, (id_col, text_col), [("doc_id", None), ("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")], digests, vocabulary)
