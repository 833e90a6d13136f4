"""Sequence packing by power-of-two decomposition.

A document's ids are cut into as many pieces of ``LENGTH`` as fit, then into one piece for each binary digit
of the rest, longest first. Every piece is a sequence of its own and of a power-of-two length, so nothing is
padded and no sequence crosses documents; ``bucket`` (the power) puts sequences of equal length together for
batching, and ``write_buckets`` lays them out so.

Ids come from a public tokenizer whose file the workers find by name or path. For a tokenizer that drops
white space, ids of a text are the ids of its words one after another, so words are encoded once and kept in
a table of bounded size, and a text of over ``TOGETHER`` characters is read in parts that end with a word; others
encode each text whole. Nothing is shuffled.

Defined cases: a null or empty text has no ids but its end id, one piece of length 1; a long text gives more
pieces, and each piece is one row; repeated rows are packed one by one; other columns are ignored; a null
doc_id is kept. ``sequence_id`` is unique in a result and grows with the table's own order.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

TOKENIZER, LENGTH, END = "word_bpe_49k.json", 2048, 1
#: Words whose ids a worker keeps.
KEPT = 1_200_000
#: Characters of text whose words are encoded together.
TOGETHER = 1 << 21


def parts(text: str) -> Iterator[str]:
    """The text in parts of at most ``TOGETHER`` characters, or a word more, cut after spaces and line ends."""
    at = 0
    while len(text) - at > TOGETHER:
        stop = max(text.rfind(c, at, at + TOGETHER) for c in " \n") + 1
        if not stop:  # a word of more than that
            stop = min((k + 1 for k in (text.find(c, at + TOGETHER) for c in " \n") if k >= 0), default=len(text))
        yield text[at:stop]
        at = stop
    yield text[at:]


class WordIds:
    """Ids of texts, as little-endian unsigned 32-bit bytes."""

    def __init__(self, file: str, by_word: bool = True):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file if os.path.isabs(file) else public_tokenizers.path(file))
        self.by_word, self.known = by_word, {"": b""}
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.mark = special[-1] if special else None
        self.mark_id = self.tokenizer.token_to_id(self.mark) if self.mark else None
        ends = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a word
        if ends:
            self.last[[i for t, i in vocabulary.items() if t.endswith(ends)]] = True

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _encode_letters(self, words: list[str]) -> bool:
        """Words of letters only, which the tokenizer leaves whole, in one call: a word ends with its last kind of token."""
        ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words):
            return False
        raw, begins = ids.tobytes(), [0, *ends.tolist()]
        self.known.update((w, raw[4 * a : 4 * b]) for w, a, b in zip(words, begins, begins[1:]))
        return True

    def _encode(self, words: list[str]) -> None:
        """Words without the mark, in one call: the mark between them shows where each ends."""
        ids = np.array(self.tokenizer.encode(self.mark.join(words), add_special_tokens=False).ids, "<u4")
        at = np.flatnonzero(ids == self.mark_id)
        begins, ends = np.concatenate(([0], at + 1)).tolist(), np.concatenate((at, [len(ids)])).tolist()
        raw = ids.tobytes()
        self.known.update((w, raw[4 * a : 4 * b]) for w, a, b in zip(words, begins, ends))

    def learn(self, words: set[str]) -> None:
        """Words that end in one stop or comma, or differ in case, are made from plain ones: the tokenizer splits
        letters from marks and lower-cases. Kept to Latin letters, where lower-casing is one character's affair."""
        plain, made = set(), []
        for w in words:
            base, tail = (w[:-1], w[-1]) if w[-1] in ".," and w[:-1].isalpha() else (w, "")
            low = base.lower() if base.isalpha() and (base.isascii() or max(base) < "İ") else base
            plain.add(low)
            if low != w:
                made.append((w, low, tail))
                if tail:
                    plain.add(tail)
        plain = [w for w in plain if w not in self.known]
        if self.mark is None or self.mark[:2] in "\n".join(plain):
            self.known.update((w, self.whole(w)) for w in plain if self.mark is None or self.mark[:2] in w)
            plain = [w for w in plain if w not in self.known]
        letters = [w for w in plain if w.isalpha() and (w.isascii() or max(w) < "İ")]
        if letters and self._encode_letters(letters):
            plain = [w for w in plain if w not in self.known]
        if plain:
            self._encode(plain)
        known = self.known
        for w, low, tail in made:
            known[w] = known[low] + known[tail] if tail else known[low]

    def _together(self, texts: list[str]) -> Iterator[bytes]:
        split = [t.replace("\n", " ").split(" ") for t in texts]
        if len(self.known) > KEPT:
            self.known = {"": b""}
        self.learn(set().union(*split).difference(self.known))
        for words in split:
            yield b"".join(map(self.known.__getitem__, words))

    def of(self, texts: list[str]) -> Iterator[bytes]:
        if not self.by_word:
            yield from map(self.whole, texts)
            return
        first = 0
        while first < len(texts):
            if len(texts[first]) > TOGETHER:
                yield b"".join(ids for part in parts(texts[first]) for ids in self._together([part]))
                first += 1
                continue
            last, held = first, 0
            while last < len(texts) and held < TOGETHER and len(texts[last]) <= TOGETHER:
                held += len(texts[last])
                last += 1
            yield from self._together(texts[first:last])
            first = last


@lru_cache(2)
def word_ids(file: str, by_word: bool) -> WordIds:
    return WordIds(file, by_word)


def cuts(n: int, length: int = LENGTH) -> list[int]:
    """Lengths of the pieces of a document of n ids."""
    rest = n % length
    return [length] * (n // length) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


_PIECE = "doc_id long, start long, length long, ids binary, doc_tokens long"
#: Rows of pieces in a batch to Spark.
_ROWS = 4096


def _pieces(batches: Iterator[pa.RecordBatch], file: str, by_word: bool, length: int, end: int) -> Iterator[pa.RecordBatch]:
    tail = np.array([end], "<u4").tobytes()
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
    names = [x.split()[0] for x in _PIECE.split(", ")]
    out: list[tuple] = []

    def packed():
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names)

    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        for doc, ids in zip(batch.column("doc_id").to_pylist(), word_ids(file, by_word).of(texts)):
            ids += tail
            n, start = len(ids) // 4, 0
            for size in cuts(n, length):
                out.append((doc, start, size, ids[4 * start : 4 * (start + size)], n))
                start += size
                if len(out) >= _ROWS:
                    yield packed()
                    out = []
    if out:
        yield packed()


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, by_word: bool = True, length: int = LENGTH, end: int = END) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (bytes), doc_tokens, bucket, sequence_id, offset.

    ``length`` is a power of two. ``by_word`` is right for tokenizers that drop white space and mark word ends.
    """
    if length < 1 or length & length - 1:
        raise ValueError("length must be a power of two")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    pieces = docs.mapInArrow(lambda it: lean(_pieces(it, tokenizer, by_word, length, end)), _PIECE)
    return pieces.select("*", F.log2("length").cast("int").alias("bucket"), F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Sequences as Parquet, a folder for each length."""
    pieces.write.partitionBy("bucket").parquet(path)


def op5_packing(docs: DataFrame) -> DataFrame:
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")
