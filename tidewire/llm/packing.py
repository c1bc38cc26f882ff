"""Packing documents into training sequences by bounded-space online best-fit.

Each task tokenises its documents and packs them as they come.  It keeps a fixed number of
open sequences in a bit set keyed by free space; a piece goes to the open sequence with the
least free space that still holds it, a new sequence is opened where none does, and when
too many are open the fullest closes.  Nothing is shuffled: a sequence belongs to the
partition that opened it, and what is left open at its end is at most ``OPEN_SEQUENCES``.

The ids are those of ``tokenizers`` for the vocabulary file.  A byte-level vocabulary is
applied to the words of its split pattern one by one, so a text of common characters is
split here and each distinct word is encoded by the model of ``tokenizers`` once and
remembered; texts with other characters or with a special token's string are given to it as
they are.  Where words get too many, those are kept that texts with new words had again.

Edge cases: a null or empty text is the end id alone; a document longer than a sequence is
cut into full pieces after a shorter first one; repeated rows are packed each; an empty
table gives an empty result; other columns are ignored.  One task packs what one partition
of the table holds, so a partition that is computed again gives the same pieces.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm.common import give_back, ids_and_texts

SEQUENCE = 2048
END_ID = 0
OPEN_SEQUENCES = 2048
#: Distinct words whose ids a worker remembers, some 200 bytes each.
REMEMBERED = 600_000
#: Texts that are split at a time by a worker that is to remember less than that.
FEW_TEXTS = 100
#: Words that are encoded as one text, such texts at once, and the byte between words, which UTF-8 never has.
_TOGETHER, _AT_ONCE, _BETWEEN = 200, 50, 0xFF
#: Characters whose class no Unicode version changes, and the letters, digits and blanks among them.
COMMON = "\\x00-\u024f\u2010-\u2027\u2030-\u205e\u20ac"
LETTERS, DIGITS, BLANKS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", " \\t\\n\\r\\f\\v\x85\xa0"
#: Fixed value: the split pattern of the byte-level BPE vocabulary, for common characters.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{DIGITS}]+| ?[^{BLANKS}{LETTERS}{DIGITS}]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+"
#: The same words, with what occurs most tried first.
WORD_PATTERN = rf" ?[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{BLANKS}{LETTERS}{DIGITS}]+| ?[{DIGITS}]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+"
#: The same for texts of ASCII alone, whose classes are small and tried in the order of how often they occur.
ASCII_PATTERN = r" ?[A-Za-z]+|'(?:s|t|re|ve|m|ll|d)| ?[^ \t\n\r\f\vA-Za-z0-9]+| ?[0-9]+|[ \t\n\r\f\v]+(?![^ \t\n\r\f\v])|[ \t\n\r\f\v]+"

PIECE = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
    ]
)


class BestFit:
    """Open sequences in an integer used as a bit set: bit f is set if some open one has f free places."""

    def __init__(self, size: int = SEQUENCE, most_open: int = OPEN_SEQUENCES) -> None:
        self.size, self.most_open = size, most_open
        self.bits = 0
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]
        self.open = 0
        self.opened = 0

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset in it) for a piece of so many ids."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            sequence = self._take(free)
        else:
            sequence, free = self.opened, self.size
            self.opened += 1
        left = free - length
        if left:
            self.by_free[left].append(sequence)
            self.bits |= 1 << left
            self.open += 1
            if self.open > self.most_open:
                self._take((self.bits & -self.bits).bit_length() - 1)
        return sequence, self.size - free

    def _take(self, free: int) -> int:
        held = self.by_free[free]
        sequence = held.pop()
        if not held:
            self.bits ^= 1 << free
        self.open -= 1
        return sequence


def cut(n: int, size: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids; only the first may be short."""
    if n <= size:
        return [(0, n)]
    head = n % size
    return ([(0, head)] if head else []) + [(s, size) for s in range(head, n, size)]


def _byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary; a blank for the byte between words."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)} | {_BETWEEN: " "}


class Encoder:
    """Token ids of texts, as numpy arrays."""

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.remembered = remembered
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = [t["content"] for t in spec.get("added_tokens", [])]
        splits_alike = spec["model"]["type"] == "BPE" and not spec.get("normalizer") and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} | {k: v for k, v in spec["pre_tokenizer"].items() if k == "trim_offsets"}
        self.special = special if splits_alike else [""]
        self.uncommon, self.word, self.ascii_word = re.compile(f"[^{COMMON}]"), re.compile(WORD_PATTERN), re.compile(ASCII_PATTERN)
        self.exact = Tokenizer.from_file(path)
        # the same model, for words that are split and written in the vocabulary's characters already
        self.words = Tokenizer(self.exact.model)
        self.words.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.characters = _byte_characters()
        self.known: dict[str, bytes] = {}
        self.again: set[str] = set()

    def _learn(self, words: set[str]) -> None:
        """Ids of new words, many at once."""
        between = bytes([_BETWEEN])
        for batch in itertools.batched(itertools.batched(words, _TOGETHER), _AT_ONCE):
            written = [between.join(map(str.encode, g)).decode("latin-1").translate(self.characters) for g in batch]
            for group, found in zip(batch, self.words.encode_batch(written, add_special_tokens=False)):
                raw, of = np.array(found.ids, dtype=np.uint32).tobytes(), np.array(found.word_ids)
                # byte offsets of the words
                at = (4 * np.searchsorted(of, np.arange(len(group) + 1))).tolist()
                self.known.update(zip(group, [raw[a:b] for a, b in zip(at, at[1:])]))

    def _make_room(self, words: set[str]) -> None:
        """Before the words of texts with new words are learned: where they get too many, only those that came again stay, or none."""
        if len(self.known) + len(words) <= self.remembered:
            self.again.update(words.intersection(self.known))
            return
        keep = self.again if 2 * len(self.again) <= self.remembered else ()
        self.known = {w: self.known[w] for w in keep}
        self.again = set()

    def forget(self) -> None:
        self.known, self.again = {}, set()

    def _plain(self, text: str) -> bool:
        """Whether a text has common characters only and no special token's string."""
        return not any(s in text for s in self.special) and (text.isascii() or self.uncommon.search(text) is None)

    def _split(self, text: str) -> list[str] | None:
        """Words of a text, or None where it must be encoded as it is."""
        if not self._plain(text):
            return None
        return (self.ascii_word if text.isascii() else self.word).findall(text)

    def _joined(self, words: list[str]) -> bytes | None:
        """Ids of words, None if one of them is new."""
        try:
            return b"".join(map(self.known.__getitem__, words))
        except KeyError:
            return None

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self._split(t) for t in texts]
        found = [None if w is None else self._joined(w) for w in split]
        late = [k for k, (w, raw) in enumerate(zip(split, found)) if w is not None and raw is None]
        if late:
            distinct = set(itertools.chain.from_iterable(split[k] for k in late))
            self._make_room(distinct)
            self._learn(distinct.difference(self.known))
            for k in late:
                found[k] = self._joined(split[k])
        return [np.array(self.exact.encode(t, add_special_tokens=False).ids, dtype=np.uint32) if raw is None else np.frombuffer(raw, dtype=np.uint32) for t, raw in zip(texts, found)]


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, remembered: int = REMEMBERED) -> Encoder:
    if (path, remembered) not in _ENCODERS:
        _ENCODERS[path, remembered] = Encoder(path, remembered)
    return _ENCODERS[path, remembered]


def pack(docs: DataFrame, tokenizer_path: str, size: int = SEQUENCE, most_open: int = OPEN_SEQUENCES, remembered: int = REMEMBERED) -> DataFrame:
    """One row per piece: its ids (little-endian unsigned 32-bit) and its place in a sequence.

    With less to remember than usual, few texts are split at a time and a worker forgets its
    words when its task ends: slower, for jobs whose workers go on with other work.
    """
    return ids_and_texts(docs).mapInArrow(packer(tokenizer_path, size, most_open, remembered), PIECE)


def packer(tokenizer_path: str, size: int = SEQUENCE, most_open: int = OPEN_SEQUENCES, remembered: int = REMEMBERED) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What packs the batches of one task."""
    names, lean = [f.name for f in PIECE], remembered < REMEMBERED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 36
        bins = BestFit(size, most_open)
        tokens = encoder(tokenizer_path, remembered)
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            texts = batch.column("text")
            step = FEW_TEXTS if lean else max(1, len(texts))
            encoded = itertools.chain.from_iterable(tokens.encode(["" if t is None else t for t in texts.slice(lo, step).to_pylist()]) for lo in range(0, len(texts), step))
            rows = []
            for doc_id, ids in zip(doc_ids, encoded):
                whole = np.append(ids, END_ID).astype("<u4")
                for k, (s, n) in enumerate(cut(len(whole), size)):
                    sequence, offset = bins.place(n)
                    rows.append((doc_id, k, s, n, whole[s : s + n].tobytes(), base + sequence, offset))
            if rows:
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
        if lean:
            tokens.forget()
            give_back()

    return run


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
