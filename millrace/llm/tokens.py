"""Tokens of whole texts, counted or encoded inside Arrow batches.

Files of public tokenizers are opened once per Python worker, from a path that is
a parameter of every operator.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import body, ship, table

#: Texts up to so many characters are encoded whole.
HUGE_CHARS = 32_768
CHUNK_CHARS = 16_384
OVERLAP_CHARS = 512
#: Texts of a batch are encoded in runs of about this many characters.
RUN_CHARS = 500_000
#: Longer texts are encoded in stretches of about this many characters, cut at blanks.
STRETCH_CHARS = 1 << 20
#: Encoded pre-tokens that one worker remembers.
MEMO_WORDS = 800_000

_OPEN: dict[str, object] = {}
_COUNTERS: dict[str, object] = {}


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def open_tokenizer(name: str):
    """The tokenizer behind ``name``, a file name of the public set or a full path."""
    if name not in _OPEN:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        path = name if os.path.sep in name else tokenizer_path(name)
        if path.endswith(".model"):
            import sentencepiece

            _OPEN[name] = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer

            found = Tokenizer.from_file(path)
            found.no_truncation()
            found.no_padding()
            _OPEN[name] = found
    return _OPEN[name]


def _reach(tok) -> int:
    """Characters beyond a boundary that may decide what stands before it.

    Contractions look at three characters, trailing white space at one, and an
    added token is only seen where its whole string is.
    """
    added = [len(t.content) for t in tok.get_added_tokens_decoder().values()]
    return max([4, *added]) + 1


def _starts(encoding, base: int) -> dict[int, int]:
    """Where pre-tokens start: character position in the text -> index of the token.

    Only the first token of a pre-token (or an added token) counts: merges never
    cross into it, and nothing before it decides how it or what follows is encoded.
    """
    found, last = {}, -2
    for i, (word, (start, _)) in enumerate(zip(encoding.word_ids, encoding.offsets, strict=True)):
        if word is None or word != last:
            found.setdefault(base + start, i)
        last = -2 if word is None else word
    return found


def count_huge(
    tok, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS
) -> int:
    """Tokens of ``text``, from overlapping chunks spliced where they agree.

    The left chunk is exact up to any pre-token start that is ``_reach`` characters
    from its end, since pre-tokens are found from left to right with bounded
    lookahead.  Where the right chunk has a pre-token start at that position too,
    it has resynchronised: from there on both read the same characters from the
    same state.  The two are spliced there.  Without such a position the overlap is
    doubled; when it has grown to the chunk, the chunk is doubled, at last to the text.
    """
    reach, total, at, n = _reach(tok), 0, 0, len(text)
    encode = lambda a, b: tok.encode(text[a:b], add_special_tokens=False)
    end = min(n, chunk)
    left, skipped, base = encode(0, end), 0, 0
    while end < n:
        stable = {p: i for p, i in _starts(left, base).items() if at < p <= end - reach}
        width = overlap
        while True:
            start = max(base + 1, end - width)
            if width >= end - base:
                # No common boundary in the whole chunk: read a longer one instead.
                end = min(n, end + (end - base))
                left = encode(base, end)
                break
            stop = min(n, start + max(chunk, 2 * width))
            right = encode(start, stop)
            common = [p for p in _starts(right, start).items() if p[0] in stable]
            if common:
                p, i = common[-1]
                total += stable[p] - skipped
                left, skipped, base, at, end = right, i, start, p, stop
                break
            width *= 2
    return total + len(left.ids) - skipped


def _runs(texts: list[str]) -> Iterator[tuple[int, int]]:
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > RUN_CHARS:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def count_tokens(
    docs: DataFrame,
    tokenizer: str = "byte_bpe_50k.json",
    limit: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
    huge: int = HUGE_CHARS,
    chunk: int = CHUNK_CHARS,
    overlap: int = OVERLAP_CHARS,
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every document.

    Tokens are those the tokenizer's library gives for the whole text, without
    added begin or end tokens; special strings inside texts count as its default
    has them.  A null or empty text has no tokens; repeated rows each give a row;
    other columns are ignored; an empty table gives no rows.  One pass, no shuffle;
    memory is bounded by a batch and, beyond ``huge`` characters, by chunks.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = open_tokenizer(tokenizer)
        pieces = not hasattr(tok, "encode_batch_fast")
        if not pieces and tokenizer not in _COUNTERS:
            _COUNTERS[tokenizer] = ByteCounter(tok) if ByteCounter.fits(tok) else None
        counter = _COUNTERS.get(tokenizer)
        for batch in batches:
            texts, counts = batch.column(1).to_pylist(), []
            for a, b in _runs(texts):
                run = texts[a:b]
                if pieces:
                    counts += [len(x) for x in tok.encode(run, num_threads=1)]
                    continue
                found = [count_huge(tok, t, chunk, overlap) if len(t) > huge else counter and counter.count(t) for t in run]
                left = [i for i, n in enumerate(found) if n is None]
                for i, e in zip(left, tok.encode_batch_fast([run[i] for i in left], add_special_tokens=False), strict=True):
                    found[i] = len(e)
                counts += found
            tokens = pa.array(counts, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), tokens,
                 pa.array(np.asarray(counts, dtype=np.int64) > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    ship(docs.sparkSession)
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    text = body(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        text.alias("text"),
        F.octet_length(text).cast("bigint").alias("n_bytes"),
    ).mapInArrow(count, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 characters stand for themselves; the other bytes take the
    characters from U+0100 on, in order.
    """
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = (b for b in range(256) if b not in shown)
    return {b: chr(0x100 + i) for i, b in enumerate(rest)}


# The letters, numbers and white space among the Latin-1 characters.
UPPERS, LOWERS = "A-Z\xc0-\xd6\xd8-\xde", "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
NUMBERS, BLANKS = "0-9\xb2\xb3\xb9\xbc-\xbe", "\\t-\\r \x85\xa0"
# The pre-tokens of the two tokenizers, over Latin-1 characters.
_TAILS = "'(?:s|t|re|ve|m|ll|d)"
_SYMBOLS = f"[^{UPPERS}{LOWERS}{NUMBERS}{BLANKS}]+"
WORD_PIECES = re.compile(f"[{LOWERS}]+|{_TAILS}|{_SYMBOLS}|[{NUMBERS}]")
BYTE_PIECES = re.compile(
    f"{_TAILS}| ?[{UPPERS}{LOWERS}]+| ?[{NUMBERS}]+| ?{_SYMBOLS}|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+"
)


def is_latin(text: str) -> bool:
    """Whether all characters are below U+0100, so that the patterns above hold for them."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Memo(dict):
    """Results of ``learn`` by key; what was met since the last time survives ``trim``."""

    def __init__(self, learn, limit: int):
        self.learn, self.limit, self.older = learn, limit, {}

    def __missing__(self, key):
        found = self.older.get(key)
        if found is None:
            found = self.learn(key)
        self[key] = found
        return found

    def trim(self) -> None:
        """Keep at most ``limit`` entries, and as many as one text may add."""
        if len(self) > self.limit // 2:
            self.older = dict(self)
            self.clear()


def stretches(text: str, most: int) -> Iterator[str]:
    """``text`` in parts of about ``most`` characters, each later one beginning with a blank."""
    begin = 0
    while len(text) - begin > most:
        cut = text.rfind(" ", begin + 1, begin + most)
        if cut < 0:
            cut = text.find(" ", begin + most)
        if cut < 0:
            break
        yield text[begin:cut]
        begin = cut
    yield text[begin:]


class WordEncoder:
    """Ids of texts under a lower-casing tokenizer that drops white space.

    Such a tokenizer never lets a token, an added token or a normalisation reach over a
    blank, and merges never leave a pre-token.  In Latin-1 texts, which composition
    leaves as they are, one pattern finds the pre-tokens; each goes to the model once and
    is remembered.  Other texts, and those where an added token may stand, are taken by
    blank-separated words, and of these a word that is not Latin-1 goes through the
    whole tokenizer.
    """

    def __init__(self, name: str, limit: int = MEMO_WORDS):
        self.tok = open_tokenizer(name)
        self.letters, self.model = _byte_letters(), self.tok.model.tokenize
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.pieces, self.words = Memo(self._piece, limit), Memo(self._word, limit)

    def _piece(self, piece: str) -> bytes:
        if not (piece.isascii() and piece.isprintable()):
            piece = piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model(piece)]).tobytes()

    def _plain(self, text: str) -> bool:
        return is_latin(text) and not any(t in text for t in self.added)

    def _word(self, word: str) -> bytes:
        if self._plain(word):
            return b"".join(map(self.pieces.__getitem__, WORD_PIECES.findall(word.lower())))
        return array("I", self.tok.encode(word, add_special_tokens=False).ids).tobytes()

    def _stretch(self, text: str) -> bytes:
        if self._plain(text):
            out = b"".join(map(self.pieces.__getitem__, WORD_PIECES.findall(text.lower())))
        else:
            blank = text.replace("\n", " ").replace("\t", " ").replace("\r", " ")
            out = b"".join(map(self.words.__getitem__, blank.split(" ")))
            self.words.trim()
        self.pieces.trim()
        return out

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a text."""
        if len(text) <= STRETCH_CHARS:
            return self._stretch(text)
        return b"".join(map(self._stretch, stretches(text, STRETCH_CHARS)))


class ByteCounter:
    """Numbers of tokens of Latin-1 texts under a byte-level tokenizer that keeps white space.

    Merges never leave a pre-token, so a text has the tokens of its pre-tokens; how many
    one has is asked of the model once and remembered.
    """

    def __init__(self, tok, limit: int = MEMO_WORDS):
        self.letters, self.model = _byte_letters(), tok.model.tokenize
        self.added = [t.content for t in tok.get_added_tokens_decoder().values()]
        self.pieces = Memo(self._piece, limit)

    @staticmethod
    def fits(tok) -> bool:
        """Whether ``tok`` is such a tokenizer, as its file says."""
        told = json.loads(tok.to_str())
        pre, model = told["pre_tokenizer"] or {}, told["model"]
        return (
            told["normalizer"] is None
            and told["post_processor"] is None
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex") is True
            and pre.get("add_prefix_space") is False
            and model["type"] == "BPE"
            and model["dropout"] is None
        )

    def _piece(self, piece: str) -> int:
        return len(self.model(piece.encode().decode("latin-1").translate(self.letters)))

    def count(self, text: str) -> int | None:
        """The tokens of ``text``; None where only the library can tell."""
        if not is_latin(text) or any(t in text for t in self.added):
            return None
        found = sum(map(self.pieces.__getitem__, BYTE_PIECES.findall(text)))
        self.pieces.trim()
        return found


def op5_token_counts(spark, sf_dir):
    return count_tokens(table(spark, sf_dir, "documents"))
