"""BPE encoding and decoding by speculation: greedy longest match proposes tokens, checks of adjacent pairs accept them.

A sequence of tokens is what merging makes of their text if and only if every two adjacent tokens are what merging
makes of those two (merging only ever looks at neighbours). So a word is cut greedily into the longest tokens; all
adjacent pairs of all new words are then tested at once in NumPy by walking back the merges that made the two tokens
along their common edge; only words with a failing pair are merged step by step.

Works for vocabularies of word-final tokens (suffix "</w>") in which the id of a token rises with the rank of its merge.
Nulls count as empty texts: no tokens, decoded to the empty text. Repeated rows stay; extra columns are kept, but one
of the name of a new column gives way to it (digests() takes doc_id and text alone). Very long texts are cut at safe
boundaries into pieces, whose tokens are the text's. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import struct
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from . import common
from .token_counts import pieces, vocabulary_path

#: White space by Unicode's White_Space property.
SPACE = "\t-\r \u0085   -     　"
#: Text of these characters alone is normalised and split here; any other text by the library's own normaliser.
PLAIN = regex.compile(r"[\t\n\r -~ -ɏ‐-‧]*")
#: Superscripts and fractions of Latin-1: numbers that are no digits.
NUMBERS = "²³¹¼-¾"
#: Bytes of texts that are encoded at a time.
SLICE_BYTES = 1 << 20
#: Words kept with their tokens by a Python worker.
CACHE_WORDS = 150_000
#: The end of a word, and what stands for it where no token holds it. No spelled letter is a NUL.
END, NO_TOKEN = "\0", -1
#: Letters up to which a list is merged faster than a heap.
SHORT_WORD = 48


def byte_letters() -> list[str]:
    """The printable letter of each byte: itself where it is printable Latin-1, else the next free one from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


class WordBPE:
    """A vocabulary, and how to encode words and texts with it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.path = path
        self.suffix = model["end_of_word_suffix"]
        vocab: dict[str, int] = dict(model["vocab"])
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = [""] * size
        for t, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = t
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.left, self.right = np.arange(size, dtype=np.int64), np.arange(size, dtype=np.int64)
        self.size = size
        keys, made = np.empty(len(merges), np.int64), np.empty(len(merges), np.int64)
        for k, (a, b) in enumerate(merges):
            i, j, m = vocab[a], vocab[b], vocab[a + b]
            self.left[m], self.right[m] = i, j
            keys[k], made[k] = i * size + j, m
        if (np.diff(made) <= 0).any():
            raise ValueError(f"{path}: token ids don't rise with the rank of their merges")
        self.made = dict(zip(keys.tolist(), made.tolist(), strict=True))
        order = np.argsort(keys)
        self.pair_keys, self.pair_made = keys[order], made[order]
        self.final = {t[: -len(self.suffix)]: i for t, i in vocab.items() if t.endswith(self.suffix) and len(t) > len(self.suffix)}
        self.inner = {t: i for t, i in vocab.items() if not t.endswith(self.suffix) or len(t) == len(self.suffix)}
        self.matcher = ahocorasick.Automaton()
        for t, i in [*self.inner.items(), *((t + END, i) for t, i in self.final.items()), (END, NO_TOKEN)]:
            self.matcher.add_word(t, i)
        self.matcher.make_automaton()
        self.letters = byte_letters()
        if any(x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec["added_tokens"]):
            raise ValueError(f"{path}: special tokens that look at their surroundings")
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.cut_start = os.path.commonprefix(list(self.special))
        # the pre-tokenizer's pattern ('s and the like, letters, a number, the rest), as it is on PLAIN texts
        self.word = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_{NUMBERS}]+|[\d{NUMBERS}]|(?:[^\w{SPACE}]|_)+")
        self.cache: dict[str, bytes] = {}
        self.exact_words = self.all_words = 0
        self._library = None

    # words

    def spell(self, word: str) -> str:
        letters = self.letters
        return "".join([letters[b] for b in word.encode("utf-8", "surrogatepass")])

    def propose(self, spelled: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match of all words at once: tokens, and the place of the word that each belongs to.

        Words stand one after the other with END behind each, which only a word-final token can take; NO_TOKEN stands
        where a word's last letters make no word-final token.
        """
        found = list(self.matcher.iter_long(END.join(spelled) + END))
        ends = np.cumsum([len(s) + 1 for s in spelled])
        tokens = np.fromiter((t for _, t in found), np.int64, len(found))
        return tokens, np.searchsorted(ends, np.fromiter((e for e, _ in found), np.int64, len(found)), side="right")

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the text of each a[i] and b[i] leaves these two tokens.

        From the last merge backwards, the edge of one of the two is undone; no merge across the boundary may have
        come before the merges that are still to be done on either side.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), np.iinfo(np.int64).max)
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            key = x * self.size + y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            bad = (self.pair_keys[at] == key) & (self.pair_made[at] < limit[live])
            good[live[bad]] = False
            live, x, y = live[~bad], x[~bad], y[~bad]
            # undo the later of the two merges; where it can't be undone, the other
            first = x > y
            whole_x, whole_y = self.right[x] == x, self.left[y] == y
            undo_x = np.where(first, ~whole_x, whole_y & ~whole_x)
            undo_y = np.where(first, whole_x & ~whole_y, ~whole_y)
            limit[live] = np.where(undo_x, x, np.where(undo_y, y + 1, limit[live]))
            a[live] = np.where(undo_x, self.right[x], x)
            b[live] = np.where(undo_y, self.left[y], y)
            live = live[undo_x | undo_y]
        return good

    def merge(self, s: str) -> list[int]:
        """Exact merging: lowest rank first, leftmost on ties."""
        ids = [self.inner[c] for c in s[:-1]] + [self.final[s[-1]]]
        return self.merge_short(ids) if len(ids) <= SHORT_WORD else self.merge_long(ids)

    def merge_short(self, ids: list[int]) -> list[int]:
        get, size, none = self.made.get, self.size, self.size
        made = [get(x * size + y, none) for x, y in zip(ids, ids[1:], strict=False)]
        while made and (m := min(made)) < none:
            i = made.index(m)
            ids[i : i + 2] = [m]
            del made[i]
            if i:
                made[i - 1] = get(ids[i - 1] * size + m, none)
            if i < len(made):
                made[i] = get(m * size + ids[i + 1], none)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap, whose time isn't the square of the length."""
        n, get, size = len(ids), self.made.get, self.size
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := get(ids[i] * size + ids[i + 1]))]
        heapq.heapify(heap)
        gone = [False] * n
        while heap:
            made, i, x, y = heapq.heappop(heap)
            j = after[i]
            if gone[i] or ids[i] != x or j < 0 or ids[j] != y:
                continue
            ids[i], gone[j] = made, True
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if m := get(made * size + ids[k]):
                    heapq.heappush(heap, (m, i, made, ids[k]))
            h = before[i]
            if h >= 0 and (m := get(ids[h] * size + made)):
                heapq.heappush(heap, (m, h, ids[h], made))
        return [t for t, g in zip(ids, gone, strict=True) if not g]

    def learn(self, words: list[str]) -> None:
        """Put the tokens of new words into the cache."""
        spelled = [self.spell(w) for w in words]
        flat, owner = self.propose(spelled)
        inside = (owner[1:] == owner[:-1]) & (flat[1:] != NO_TOKEN)
        pairs, back = np.unique(flat[:-1][inside] * self.size + flat[1:][inside], return_inverse=True)
        bad = ~self.compatible(pairs // self.size, pairs % self.size)[back]
        failed = np.unique(np.concatenate([owner[1:][inside][bad], owner[flat == NO_TOKEN]]))
        raw, edges = flat.astype("<u4").tobytes(), (4 * np.searchsorted(owner, np.arange(len(words) + 1))).tolist()
        tokens = [raw[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        for k in failed.tolist():
            ids = self.merge(spelled[k])
            tokens[k] = struct.pack(f"<{len(ids)}I", *ids)
        self.exact_words += len(failed)
        self.all_words += len(words)
        self.cache.update(zip(words, tokens, strict=True))

    # texts

    def split(self, text: str) -> list[str]:
        """The words of a stretch without special tokens."""
        if PLAIN.fullmatch(text):
            if not text.isascii() and not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            return self.word.findall("".join([c.lower() for c in text]) if "İ" in text else text.lower())
        if self._library is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
            self._unspell = {c: b for b, c in enumerate(self.letters)}
        shown = self._library.normalizer.normalize_str(text)
        return [bytes(self._unspell[c] for c in w).decode("utf-8") for w, _ in self._library.pre_tokenizer.pre_tokenize_str(shown)]

    def stretches(self, text: str) -> Iterator[list[str] | int]:
        """Lists of words, and ids of special tokens between them."""
        at = 0
        for m in self.cut.finditer(text) if self.cut and self.cut_start in text else ():
            for x in pieces(text[at : m.start()]):
                yield self.split(x)
            yield self.special[m[0]]
            at = m.end()
        for x in pieces(text[at:]):
            yield self.split(x)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        split = [list(self.stretches(t)) for t in texts]
        words = {w for parts in split for p in parts if isinstance(p, list) for w in p}
        fresh = [w for w in words if w not in self.cache]
        if len(self.cache) + len(fresh) > CACHE_WORDS:
            self.cache.clear()
            fresh = list(words)
        if fresh:
            self.learn(fresh)
        get = self.cache.__getitem__
        return [b"".join([b"".join(map(get, p)) if isinstance(p, list) else p.to_bytes(4, "little") for p in parts]) for parts in split]


_LOADED: dict[str, WordBPE] = {}
_TOKENS: dict[str, pa.Array] = {}


def load(vocabulary: str) -> WordBPE:
    path = vocabulary_path(vocabulary)
    if path not in _LOADED:
        _LOADED[path] = WordBPE(path)
    return _LOADED[path]


def token_list(vocabulary: str) -> pa.Array:
    """The tokens by id: all that decoding needs."""
    path = vocabulary_path(vocabulary)
    if path not in _TOKENS:
        if path in _LOADED:
            tokens = _LOADED[path].tokens
        else:
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            ids = dict(spec["model"]["vocab"]) | {x["content"]: x["id"] for x in spec["added_tokens"]}
            tokens = [""] * (max(ids.values()) + 1)
            for t, i in ids.items():
                tokens[i] = t
        _TOKENS[path] = pa.array(tokens, pa.large_string())
    return _TOKENS[path]


def decode_batch(ids: list[bytes], tokens: pa.Array) -> pa.Array:
    """The text of each binary of ids: tokens joined by single spaces, as a vocabulary without a decoder has them."""
    flat = np.frombuffer(b"".join(ids), "<u4")
    offsets = np.cumsum([0, *map(len, ids)]) // 4
    lists = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), tokens.take(pa.array(flat.astype(np.int64))))
    return pc.binary_join(lists, pa.scalar(" ", pa.large_string()))


def texts_in_slices(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, int, list[str]]]:
    """Rows of a batch by about SLICE_BYTES of text: from, to, texts (null as the empty one)."""
    text = pc.fill_null(batch.column(at), "")
    for a, b in common.slices(pc.binary_length(text).to_pylist(), SLICE_BYTES):
        yield a, b, text.slice(a, b - a).to_pylist()


def encode(docs: DataFrame, vocabulary: str, text_col: str = "text", ids_col: str = "ids", drop_text: bool = True) -> DataFrame:
    """docs with ids_col: the token ids as a binary of little-endian unsigned 32-bit integers."""
    common.bounded_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    kept, fields = common.others(docs, ids_col, *[text_col] * drop_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bpe = load(vocabulary)
            for a, b, texts in texts_in_slices(batch, at):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), pa.array(bpe.encode_batch(texts), pa.binary())], names=[*(f.name for f in fields), ids_col])

    return common.map_rows(docs, run, StructType([*fields, StructField(ids_col, BinaryType())]))


def decode(encoded: DataFrame, vocabulary: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """encoded with out_col: the text of the tokens of ids_col; null ids are none."""
    at = encoded.columns.index(ids_col)
    kept, fields = common.others(encoded, out_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = pc.fill_null(batch.column(at), b"")
            for a, b in common.slices(pc.binary_length(raw).to_pylist(), SLICE_BYTES):
                part = batch.slice(a, b - a)
                decoded = decode_batch(raw.slice(a, b - a).to_pylist(), token_list(vocabulary))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), decoded.cast(pa.string())], names=[*(f.name for f in fields), out_col])

    return common.map_rows(encoded, run, StructType([*fields, StructField(out_col, StringType())]))


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoded and decoded in one pass, of which only digests are kept."""
    common.bounded_batches(docs.sparkSession)
    narrow = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            bpe, tokens = load(vocabulary), token_list(vocabulary)
            for a, b, texts in texts_in_slices(batch, 1):
                ids = bpe.encode_batch(texts)
                decoded = decode_batch(ids, tokens)
                columns = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(sha, ids), pa.string()), pa.array([sha(x.as_buffer() or b"") for x in decoded], pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    fields = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]
    return narrow.mapInArrow(common.tidy(run), StructType([narrow.schema["doc_id"], *fields]))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.documents(spark, sf_dir), "word_bpe_49k.json")
