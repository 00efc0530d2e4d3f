"""Token counts (op1): overlapping chunks of huge texts, spliced where two encodings provably agree."""

from __future__ import annotations

import functools
import json
import os
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import lean, resolve

#: Characters before a chunk's end whose pre-tokens may still change with what follows (longest special string, contractions).
GUARD = 32


def _boundaries(encoding, base: int) -> dict[int, int]:
    """End offset of each pre-token (in the whole text) -> number of tokens up to there."""
    words, offsets, n = encoding.word_ids, encoding.offsets, len(encoding)
    return {base + offsets[i][1]: i + 1 for i in range(n) if i + 1 == n or words[i] is None or words[i] != words[i + 1]}


def encode_long(text: str, encode: Callable, chunk: int = 1 << 15, overlap: int = 256) -> list[int]:
    """The ids of a text of any length, exactly as one call of encode gives them, with memory for a chunk only.

    encode(text) gives an encoding with ids, offsets and word_ids. A chunk A is followed by a chunk B that starts
    inside A. A common boundary p, where a pre-token ends in both, is stable: left of it A's pre-tokens have seen all
    that can decide them (p lies GUARD before A's end and no combining mark follows p), and right of it B's scan starts
    afresh at p as the scan of the whole text does, since the pre-tokenizer looks back at nothing. So A's tokens up to
    p and B's after p are the text's own. If the overlap holds no such p it is doubled, and once it covers all of A,
    A itself is doubled; a text without any boundary is thus encoded whole.
    """
    n, start, end = len(text), 0, min(len(text), chunk)
    first, done = encode(text[start:end]), 0
    ids: list[int] = []
    while end < n:
        wide, spliced = overlap, False
        ends = _boundaries(first, start)
        while not spliced:
            begin = max(start, end - wide)
            stop = min(n, begin + max(chunk, 2 * wide))
            if begin == start:  # the overlap has grown to all of A
                end = min(n, max(stop, start + 2 * (end - start)))
                first, spliced = encode(text[start:end]), True
                continue
            second = encode(text[begin:stop])
            there = _boundaries(second, begin)
            stable = [p for p in ends if p in there and begin < p <= end - GUARD and ends[p] >= done and not unicodedata.combining(text[p])]
            if stable:
                p = max(stable)
                ids += first.ids[done : ends[p]]
                start, end, first, done, spliced = begin, stop, second, there[p], True
            else:
                wide *= 2
    return ids + first.ids[done:]


@functools.cache
def load(path: str, specials: bool = True):
    """A tokenizer of a .json file, loaded once a worker. specials: special strings inside texts become their ids, the library's default."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(resolve(path))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    if not specials:
        tokenizer.encode_special_tokens = True
    return tokenizer


#: Characters of the pieces between white space whose counts a task keeps, those of a kept piece at most, and those of
#: unknown pieces that are encoded at once.
KEPT, LONGEST, JOINED = 8 << 20, 1024, 16384
#: All that str.split() takes for white space.
_SPACES = [chr(i) for i in range(0x3001) if chr(i).isspace()]
#: Of these, the characters that the tokenizers' pattern does not take for white space.
_SEPARATORS = re.compile("[\x1c-\x1f]")


class Pieces:
    """Token counts of texts from those of their pieces between white space, each distinct piece encoded once.

    For tokenizers that drop white space: their words, special strings and normal forms never span it, so a text's
    tokens are those of its pieces. Unknown pieces are encoded joined by spaces, and their tokens told apart by offsets.
    """

    def __init__(self, tokenizer):
        self.tokenizer, self.known, self.kept = tokenizer, {}, 0

    def _learn(self, pieces: list[str]) -> None:
        at = 0
        while at < len(pieces):
            size, end = 0, at
            while end < len(pieces) and (end == at or size + len(pieces[end]) < JOINED):
                size += len(pieces[end]) + 1
                end += 1
            part = pieces[at:end]
            starts = np.cumsum([0, *(len(p) + 1 for p in part)])
            offsets = self.tokenizer.encode(" ".join(part), add_special_tokens=False).offsets
            first = np.array([o[0] for o in offsets], np.int64)
            counts = np.bincount(np.searchsorted(starts, first, "right") - 1, minlength=len(part))
            self.known.update(zip(part, counts.tolist(), strict=True))
            at = end

    def __call__(self, texts: list[str]) -> list[int]:
        split = [t.split() for t in texts]
        unknown = set().union(*split).difference(self.known)
        if self.kept > KEPT:
            self.known.clear()
            unknown, self.kept = set().union(*split), 0
        self.kept += sum(map(len, unknown))
        self._learn(list(unknown))
        count = self.known.__getitem__
        found = [sum(map(count, pieces)) for pieces in split]
        for piece in [x for x in unknown if len(x) > LONGEST]:
            self.kept -= len(piece)
            del self.known[piece]
        return found


def drops_space(tokenizer) -> bool:
    """Whether a tokenizer's tokens never hold white space nor depend on it: its rules keep only what a pattern matches, no
    special string has or strips white space, and no white space character adds a token or changes those beside it."""
    rules = json.loads(tokenizer.to_str())
    steps = (rules["pre_tokenizer"] or {}).get("pretokenizers", [rules["pre_tokenizer"] or {}])
    if not any(x.get("type") == "Split" and x.get("behavior") == "Removed" and x.get("invert") for x in steps):
        return False
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in rules["added_tokens"]):
        return False
    encode = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    beside = [*encode("a1,"), *encode(".b'")]
    return all(encode(f"a1,{x}.b'") == encode(f"{x}{x}a1, {x}\n.b'{x}") == beside and not encode(x) for x in _SPACES if not _SEPARATORS.match(x))


def counter(path: str, chunk: int, overlap: int) -> Callable[[list[str]], list[int]]:
    """A function that counts the tokens of texts."""
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=resolve(path))
        return lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]
    tokenizer = load(path)
    whole = lambda text: tokenizer.encode(text, add_special_tokens=False)
    batch = lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    quick = Pieces(tokenizer) if drops_space(tokenizer) else batch

    def count(texts: list[str]) -> list[int]:
        found = [0] * len(texts)
        huge = [i for i, t in enumerate(texts) if len(t) > chunk]
        odd = [i for i, t in enumerate(texts) if len(t) <= chunk and _SEPARATORS.search(t)]
        rest = sorted(set(range(len(texts))).difference(huge, odd))
        for i in huge:
            found[i] = len(encode_long(texts[i], whole, chunk, overlap))
        for chosen, how in ((odd, batch), (rest, quick)):
            for i, n in zip(chosen, how([texts[i] for i in chosen]) if chosen else [], strict=True):
                found[i] = n
        return found

    return count


def token_counts(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, chunk: int = 1 << 14, overlap: int = 256) -> DataFrame:
    """Tokens of every whole text: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    path: a tokenizers .json or a sentencepiece .model file. One narrow pass, no shuffle; any input row gives one row,
    so repeated rows and null ids are kept. A null or empty text has 0 bytes and 0 tokens. Texts longer than chunk
    characters are encoded in overlapping chunks (encode_long). Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path, chunk, overlap)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n = pa.array(np.array(count([x or "" for x in part.column(2).to_pylist()]), np.int64), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), n], ["doc_id", "n_bytes", "n_tokens"])

    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(F.octet_length(docs[text_col]), F.lit(0)).cast("long").alias("n_bytes"), docs[text_col].cast("string").alias("text"))
    counted = texts.mapInArrow(lean(run), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
