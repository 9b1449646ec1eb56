"""Token counts: Arrow functions that return lengths only.

Texts are gathered into batches of about equal bytes; a text longer than SPLIT_CHARS is cut where no token can cross,
so one long text neither fills a batch by itself nor takes more than linear time. A vocabulary that drops white space
never has a token across it: there each distinct run between white space is encoded once and its length kept.

Nulls count as empty texts (0 tokens); repeated rows give repeated rows; extra columns are left out of the result. An
empty table gives an empty one. Ids of any type are returned as they are.
A text without any safe boundary is kept in one piece.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import common

SPLIT_CHARS = 8192
BATCH_CHARS = 1 << 19
#: Distinct runs that a Python worker keeps with their numbers of tokens.
KNOWN_RUNS = 400_000
TOKEN_LIMIT = 2048
#: One white-space character between ASCII letters or digits: no normaliser looks across it, no token of a vocabulary that drops white space spans it.
SAFE = re.compile(r"(?<=[A-Za-z0-9])[ \t\n](?=[A-Za-z0-9])")


def pieces(text: str, size: int = SPLIT_CHARS) -> list[str]:
    """Cut a text at safe boundaries into pieces of little more than size characters; their concatenation is the text."""
    if len(text) <= size:
        return [text]
    out, start = [], 0
    while len(text) - start > size and (m := SAFE.search(text, start + size)):
        out.append(text[start : m.start()])
        start = m.start()
    out.append(text[start:])
    return out


def library_counter(path: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to their numbers of tokens; path ends in .json (tokenizers) or .model (sentencepiece)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_padding()
    tok.no_truncation()
    encode = getattr(tok, "encode_batch_fast", tok.encode_batch)
    return lambda texts: [len(x) for x in encode(texts, add_special_tokens=False)]


def drops_white_space(path: str) -> bool:
    """Whether a vocabulary cuts texts at ASCII white space and drops it, by what its file says: then no token has any.

    Such are tokenizers whose pre-tokenizers cut with a pattern and keep matches alone, if the pattern matches no white
    space, or cut at white space itself, and whose normaliser and special tokens don't look across it.
    """
    if path.endswith(".model"):
        return False
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if any(re.search(r"\s", x["content"]) or x.get("lstrip") or x.get("rstrip") for x in spec.get("added_tokens", [])):
        return False
    first = spec.get("pre_tokenizer") or {}
    first = first["pretokenizers"][0] if first.get("type") == "Sequence" and first.get("pretokenizers") else first
    plain = all(n.get("type") in ("NFC", "NFD", "NFKC", "NFKD", "Lowercase", "StripAccents") or n.get("type") == "Replace" and (n.get("pattern") or {}).get("Regex") == r"\s+" and n.get("content") == " " for n in parts(spec.get("normalizer"), "normalizers"))
    if first.get("type") in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer"):
        return plain
    pattern = (first.get("pattern") or {}).get("Regex")
    if not plain or first.get("type") != "Split" or first.get("behavior") != "Removed" or not first.get("invert") or pattern is None:
        return False
    try:
        return not any(regex.search(pattern, f"{a}{w}{b}") and any(w in m for m in regex.findall(pattern, f"{a}{w}{b}")) for w in "\t\n\x0b\x0c\r " for a in ("", "a", "1", "'", "!") for b in ("", "a", "1", "s", "!"))
    except regex.error:
        return False


def parts(spec: dict | None, key: str) -> list[dict]:
    """The steps of a sequence, or the one step."""
    return [] if not spec else spec[key] if spec.get("type") == "Sequence" else [spec]


class LengthCounter:
    """Numbers of tokens of texts. Where a vocabulary drops white space, each distinct word-like run is encoded once."""

    def __init__(self, path: str, by_runs: bool | None = None):
        self.count, self.by_runs = library_counter(path), drops_white_space(path) if by_runs is None else by_runs
        self.known: dict[bytes, int] = {}

    def encode(self, texts: list[str]) -> list[int]:
        """Lengths of texts, encoded in batches of about BATCH_CHARS characters."""
        out: list[int] = []
        batch: list[str] = []
        chars = 0
        for x in texts:
            batch.append(x)
            chars += len(x)
            if chars >= BATCH_CHARS:
                out += self.count(batch)
                batch, chars = [], 0
        return out + (self.count(batch) if batch else [])

    def __call__(self, texts: list[str]) -> list[int]:
        if not self.by_runs:
            return self.encode(texts)
        runs = [t.encode("utf-8", "surrogatepass").split() for t in texts]  # at ASCII white space, all of it safe boundaries here
        every = set().union(*runs)
        new = [r for r in every if r not in self.known]
        if len(self.known) + len(new) > KNOWN_RUNS:
            self.known.clear()
            new = list(every)
        cut = [pieces(x.decode("utf-8", "surrogatepass")) for x in new]
        lengths = iter(self.encode([p for c in cut for p in c]))
        self.known.update((x, sum(next(lengths) for _ in c)) for x, c in zip(new, cut, strict=True))
        get = self.known.__getitem__
        return [sum(map(get, r)) for r in runs]


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = TOKEN_LIMIT) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row of docs. vocabulary: a file name among the public tokenizers, or a path.

    Texts are cut into their runs between white space where the vocabulary drops it; others are encoded whole.
    """
    common.bounded_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            counter = counter or LengthCounter(vocabulary_path(vocabulary))
            text = pc.fill_null(batch.column(1), "")
            n_bytes = pc.binary_length(text).cast(pa.int64())
            totals: list[int] = []
            for a, b in common.slices(n_bytes.to_pylist(), BATCH_CHARS):
                totals += counter(text.slice(a, b - a).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array(totals, pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

    schema = StructType([narrow.schema[id_col], StructField("n_bytes", LongType()), StructField("n_tokens", LongType())])
    return common.map_rows(narrow, run, schema).withColumn("over_limit", F.col("n_tokens") > limit)


def vocabulary_path(name: str) -> str:
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(common.documents(spark, sf_dir), "word_bpe_49k.json")
