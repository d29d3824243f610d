"""Byte-level BPE encoding by corpus-level merge replay.

A block of documents is one corpus.  Its texts are cut into distinct words
once, every distinct word is laid out in one long token chain, and the merges
of the vocabulary are applied in rank order to the whole chain at once.  An
inverted index from rank (that is, from token pair) to chain positions says
where a merge applies; applying it touches only the two neighbours of each
position, whose new pairs are entered under their own, always later, ranks.
Every document is then spelled out as the ids of its words.

A word's ids never depend on other words, so splitting the documents into
blocks changes nothing but how often a frequent word is replayed: the operator
needs no shuffle, and no word list is ever gathered on the driver.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Characters of text whose words form one corpus; bounds a worker's memory.
BLOCK_CHARS = 12_000_000

# Fixed value: the word pattern of the byte-level tokenizers.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: A unit is white space and the characters after it.  No word runs from a
#: character that isn't white space into white space, so words never cross units.
_UNITS = re.compile(r"\s*\S+|\s+")
#: Python counts these as white space, the word pattern doesn't.
_CONTROL = re.compile("[\x1c-\x1f]")
#: The word pattern as it reads for ASCII texts, for the faster engine.
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")


def _byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    symbols = {chr(b): b for b in plain}
    rest = (b for b in range(256) if chr(b) not in symbols)
    symbols.update({chr(256 + k): b for k, b in enumerate(list(rest))})
    return symbols


class MergeTable:
    """Merges of a byte-level BPE vocabulary, by rank."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.byte_ids = [0] * 256
        for symbol, byte in _byte_symbols().items():
            self.byte_ids[byte] = vocab[symbol]
        self.left: list[int] = []
        self.right: list[int] = []
        self.made: list[int] = []
        for merge in model["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.left.append(vocab[a])
            self.right.append(vocab[b])
            self.made.append(vocab[a + b])
        self.rank = {pair: r for r, pair in enumerate(zip(self.left, self.right))}  # -1, between words, is in no pair

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and the number of each."""
        byte_ids, rank = self.byte_ids, self.rank
        token, start = [-1], []
        for word in words:
            start.append(len(token))
            token.extend([byte_ids[b] for b in word])
            token.append(-1)
        n = len(token)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        index: list[list[int] | None] = [None] * len(self.made)

        rank_of = rank.get
        for i, pair in enumerate(zip(token, token[1:])):
            r = rank_of(pair)
            if r is not None:
                if index[r] is None:
                    index[r] = [i]
                else:
                    index[r].append(i)
        for r, positions in enumerate(index):
            if positions is None:
                continue
            a, b, new = self.left[r], self.right[r], self.made[r]
            if a == b:
                positions.sort()  # equal neighbours pair up from the left
            for i in positions:
                if token[i] != a:
                    continue
                j = after[i]
                if token[j] != b:
                    continue
                k = after[j]
                token[i], token[j] = new, -2
                after[i], before[k] = k, i
                p = before[i]
                q = rank_of((token[p], new))
                if q is not None:
                    if index[q] is None:
                        index[q] = [p]
                    else:
                        index[q].append(p)
                q = rank_of((new, token[k]))
                if q is not None:
                    if index[q] is None:
                        index[q] = [i]
                    else:
                        index[q].append(i)
            index[r] = None
        chain = np.array(token, dtype=np.int32)
        ids = chain[chain >= 0]
        edges = np.concatenate([np.zeros(1, np.int64), np.cumsum(chain >= 0)])
        first = np.array(start, dtype=np.int64)
        size = np.fromiter((len(w) for w in words), np.int64, len(words))
        return ids, edges[first + size] - edges[first]


@lru_cache(maxsize=4)
def merge_table(path: str) -> MergeTable:
    return MergeTable(path)


class _Codes(dict):
    """Numbers new keys in order of appearance."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def _gather(values: np.ndarray, offset: np.ndarray, size: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate values[offset[c] : offset[c] + size[c]] over codes; sizes."""
    taken = size[codes]
    ends = np.cumsum(taken)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total, dtype=np.int64) + np.repeat(offset[codes] - (ends - taken), taken)
    return values[at], taken


def encode_block(texts: list[str | None], table: MergeTable) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a block of texts and the number of ids of each text."""
    import regex

    word_of = regex.compile(WORD_PATTERN)
    units, codes, per_text = _Codes(), [], []
    code_of = units.__getitem__
    for text in texts:
        if not text:
            per_text.append(0)
            continue
        found = [text] if _CONTROL.search(text) else _UNITS.findall(text)
        codes.append(np.fromiter(map(code_of, found), np.int64, len(found)))
        per_text.append(len(found))
    if not codes:
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    words = _Codes()
    word_code, spelled, unit_words = words.__getitem__, [], []
    for unit in units:
        found = (_ASCII_WORDS if unit.isascii() else word_of).findall(unit)
        spelled.extend(map(word_code, found))
        unit_words.append(len(found))
    ids, word_len = table.replay([w.encode("utf-8", "surrogatepass") for w in words])
    word_at = np.cumsum(word_len) - word_len
    by_unit, lens = _gather(ids, word_at, word_len, np.array(spelled, np.int64))
    unit_words = np.array(unit_words, np.int64)
    unit_end = np.concatenate([np.zeros(1, np.int64), np.cumsum(lens)])[np.cumsum(unit_words)]
    unit_at = np.concatenate([np.zeros(1, np.int64), unit_end[:-1]])
    all_ids, taken = _gather(by_unit, unit_at, unit_end - unit_at, np.concatenate(codes))
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(taken)])[np.cumsum(per_text)]
    return all_ids, np.diff(ends, prepend=0)


def _blocks(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[pa.Table]:
    held, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            held.append(part)
            size += part.column(0).nbytes if part.num_rows else 0
            size += sum(c.nbytes for c in part.columns[1:])
            if size >= chars:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def encode(df: DataFrame, text: str = "text", ids: str = "ids", *, keep: list[str] | None = None,
           tokenizer: str = DEFAULT_TOKENIZER, counts_only: bool = False, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Token ids of every row's text, without special tokens.

    Strings that look like special tokens are ordinary text.  A null and an
    empty text both give an empty list (or the count 0 with ``counts_only``).
    ``keep`` names the columns to carry along (default: all but the text; a
    column already called ``ids`` is replaced).  Rows are neither dropped nor
    merged: repeated rows come out repeated.  An empty table gives no rows.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c not in (text, ids)]
    picked = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))
    kind = "int" if counts_only else "array<int>"
    schema = ", ".join([*(f"`{c}` {picked.schema[c].dataType.simpleString()}" for c in keep), f"`{ids}` {kind}"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = merge_table(tokenizer)
        for block in _blocks(batches, block_chars):
            texts = block.column(block.num_columns - 1).to_pylist()
            values, sizes = encode_block(texts, table)
            if counts_only:
                made = pa.array(sizes.astype(np.int32))
            else:
                offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)]).astype(np.int32)
                made = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            out = block.select(range(block.num_columns - 1)).append_column(ids, made)
            yield from out.combine_chunks().to_batches(max_chunksize=2000)

    return picked.mapInArrow(run, schema)
