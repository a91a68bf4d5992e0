"""Token ids and counts of text artifacts with a fixed public tokenizer.

Words repeat, so a worker remembers the ids of pieces it has seen.  For the word tokenizer a piece is what its own splitting
pattern cuts; the cut is made here only for texts in which that is certain to agree (ASCII and Latin-1 letters, whose
lower case and normal form are one character each); every other text goes to the library whole.

Very long texts are encoded in overlapping chunks.  Two neighbouring chunks are spliced at a boundary that both agree on:
white space before it, the same token starts and ids from there to the end of the overlap.  Without one the overlap doubles.
"""

import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 16
OVERLAP = 256
#: Pieces a worker remembers.
MEMO = 300_000
LIMIT = 2048
WORD_PIECES = "'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-z0-9ß-öø-ÿ]+"
#: Texts of these characters only are cut here; the special strings of the tokenizer start with the excluded pair.
PLAIN = "[\t\n\r\x0b\x0c\x20-;=-~À-ÖØ-öø-ÿ]*+(?:<(?!\\|)[\t\n\r\x0b\x0c\x20-;=-~À-ÖØ-öø-ÿ]*+)*+"


@lru_cache(2)
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Pieces(dict):
    """Ids by piece, from the library's model; bounded."""

    def __init__(self, library):
        super().__init__()
        from tokenizers.pre_tokenizers import ByteLevel

        self.model, self.bytes = library.model, ByteLevel(add_prefix_space=False, use_regex=False)

    def __missing__(self, piece):
        text = piece if piece.isascii() else self.bytes.pre_tokenize_str(piece)[0][0]
        ids = tuple([t.id for t in self.model.tokenize(text)])
        if len(self) < MEMO and len(piece) < 64:
            self[piece] = ids
        return ids


@lru_cache(2)
def _fast(path: str):
    """(pieces pattern, plain pattern, memo), or None if the tokenizer does not cut words as WORD_PIECES does."""
    import json

    with open(path) as f:
        spec = json.load(f)
    kinds = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    splits = [p.get("pattern", {}).get("Regex") for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
    known = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
    if kinds != ["NFC", "Replace", "Lowercase"] or splits[:1] != [known]:
        return None
    return re.compile(WORD_PIECES), re.compile(PLAIN), Pieces(tokenizer(path))


def encode(text: str, path: str) -> list[int]:
    """Ids of a text as the library gives them, without added special tokens."""
    fast = _fast(path)
    if fast and fast[1].fullmatch(text):
        memo = fast[2]
        return list(chain.from_iterable(map(memo.__getitem__, fast[0].findall(text.lower()))))
    return tokenizer(path).encode(text, add_special_tokens=False).ids


def _offsets(text: str, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, character starts) of a text."""
    fast = _fast(path)
    if fast and fast[1].fullmatch(text):
        memo = fast[2]
        found = [(memo[m.group()], m.start()) for m in fast[0].finditer(text.lower())]
        counts = [len(i) for i, _ in found]
        return np.fromiter(chain.from_iterable(i for i, _ in found), np.int64, sum(counts)), np.repeat(np.array([s for _, s in found], np.int64), counts)
    got = tokenizer(path).encode(text, add_special_tokens=False)
    return np.array(got.ids, np.int64), np.array([s for s, _ in got.offsets], np.int64)


def splice(text: str, left: tuple, right: tuple, at: int, end: int):
    """(tokens of left to keep, tokens of right to drop) at the first boundary in [at, end) both sides agree on, or None.

    ``left`` and ``right`` are (ids, absolute starts); they overlap on text[at:end].  A boundary is proven where a word
    starts after white space: no piece of the tokenizer spans white space, so what follows does not depend on what is
    before; that both sides give the same tokens from there up to the last white space of the overlap confirms it.
    """
    stop = end
    while stop > at and not text[stop - 1].isspace():
        stop -= 1
    (a, sa), (b, sb) = left, right
    for p in range(at + 1, stop):
        if not text[p - 1].isspace() or text[p].isspace():
            continue
        i, j = np.searchsorted(sa, p), np.searchsorted(sb, p)
        m, n = np.searchsorted(sa, stop), np.searchsorted(sb, stop)
        if i < m and m - i == n - j and (a[i:m] == b[j:n]).all() and (sa[i:m] == sb[j:n]).all():
            return int(i), int(j)
    return None


def encode_long(text: str, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
    """Ids of a long text from overlapping chunks, equal to those of the whole text."""
    parts, left, done = [], None, 0
    while True:
        end = min(len(text), done + chunk)
        wide = min(overlap, done)
        while True:
            begin = done - wide
            ids, starts = _offsets(text[begin:end], path)
            right = (ids, starts + begin)
            if left is None:
                break
            cut = splice(text, left, right, begin, done)
            if cut:
                parts.append(left[0][: cut[0]])
                right = (right[0][cut[1]:], right[1][cut[1]:])
                break
            if wide >= done:  # no common boundary at all: the text up to here is encoded as one
                parts, right = [], (ids, starts + begin)
                break
            wide = min(2 * wide, done)
            if wide > done - (done - chunk):  # the overlap has outgrown the left chunk: join it to the right one
                wide = done
        left, done = right, end
        if end == len(text):
            return np.concatenate([*parts, left[0]])


def count_tokens(artifacts: DataFrame, path: str, key: str = "frame_id", content: str = "content", limit: int = LIMIT,
                 chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every text artifact with the tokenizer file at ``path`` (on every executor).

    n_bytes counts UTF-8, n_tokens the library's tokens of the whole text without added special tokens; special strings
    inside a text are handled as the library does by default.  Texts beyond ``chunk`` characters are encoded in overlapping
    chunks.  Null counts as empty; null keys and repeated rows stay as they are; other columns are not read; an empty
    table gives an empty one.
    """
    def step(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = [len(encode_long(t, path, chunk, overlap)) if len(t) > chunk else len(encode(t, path)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["_key", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(content), F.lit(""))
    rows = artifacts.select(F.col(key).alias("_key"), text.alias("_text"), F.octet_length(text).cast("bigint").alias("n_bytes"))
    kind = rows.schema["_key"].dataType.simpleString()
    counted = rows.mapInArrow(step, f"_key {kind}, n_bytes bigint, n_tokens bigint")
    return counted.select(F.col("_key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
