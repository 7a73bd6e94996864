"""Hierarchical packing of documents into training windows of several lengths."""

from __future__ import annotations

import bisect
import json
import os
import re
import struct
import unicodedata
import zlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import cut, ship

#: The context sizes; a sequence that fills one exactly needs no padding.
TIERS = (512, 1024, 2048, 4096)
#: Tokens that are packed together, and tokens of one training step.
GROUP_TOKENS, STEP_TOKENS = 1 << 20, 1 << 18
#: Partitions whose last, unfilled windows are packed together.
FAN_IN = 512

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
_LONG = re.compile(r"\s")
#: Characters on which str.split and the tokenizer's idea of white space differ or may differ.
_ODD = re.compile("[\x1c-\x1f\x85᠎​﻿]")


# The normaliser and split steps of the tokenizer files whose words WordTokenizer takes apart itself.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}
# The same runs, faster to find, in lower-cased texts of few letters.
_ASCII_RUNS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII).findall
_LATIN_RUNS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\\sa-zªµºß-öø-ÿ0-9²³¹¼½¾]+").findall


class WordTokenizer:
    """Token ids of whole texts by a word-level BPE tokenizer file, with the ids of frequent words kept.

    The tokenizer drops white space and splits what is left into runs (of letters, or of other signs, or single digits), whose ids never
    depend on their neighbours: the ids of a text are those of its runs in order. Runs seen before cost one dictionary lookup; the
    table is emptied when it holds ``keep`` of them. A file with other steps than these is used as it is, on whole texts.
    """

    def __init__(self, path: str, keep: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.by_word = all(spec.get(k) == v for k, v in _STEPS.items()) and spec["model"].get("end_of_word_suffix") == "</w>" and not spec["model"].get("ignore_merges")
        if not self.by_word:
            return
        self.by_run = Tokenizer(self.whole.model)
        self.by_run.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.any_runs = regex.compile(_SPLIT).findall
        vocabulary = self.by_run.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # the ids that end a run
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.keep, self.known = keep, {}
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        alphabet = {}
        for code in range(0x80, 0x800):  # the two bytes of each of these show how every byte from 0x80 to 0xdf is written
            alphabet.update(zip(chr(code).encode(), level.pre_tokenize_str(chr(code))[0][0], strict=True))
        for code in (0x1000, 0x2000, 0x3000, 0x4000, 0x5000, 0x6000, 0x7000, 0x8000, 0x9000, 0xA000, 0xB000, 0xC000, 0xD000, 0xE000, 0xF000, 0x800, *range(0x10000, 0x110000, 0x40000 // 4)):
            alphabet.update(zip(chr(code).encode(), level.pre_tokenize_str(chr(code))[0][0], strict=True))
        for code in range(0x80):
            alphabet[code] = level.pre_tokenize_str(chr(code))[0][0]
        self.alphabet = alphabet

    def _spelled(self, run: str) -> str:
        """A run in the letters by which the vocabulary spells bytes."""
        if run.isascii() and run.isprintable():
            return run
        return run.encode().decode("latin-1").translate(self.alphabet)

    def _runs(self, text: str) -> list[str]:
        """What the tokenizer's normaliser and split step make of a text."""
        if text.isascii():
            return _ASCII_RUNS(text.lower())
        plain = unicodedata.normalize("NFC", text)
        plain = "".join([c.lower() for c in plain]) if "Σ" in plain else plain.lower()
        try:
            plain.encode("latin-1")
        except UnicodeEncodeError:
            return self.any_runs(plain)
        return _LATIN_RUNS(plain)

    def _learn(self, new: set[str]) -> None:
        if len(self.known) + len(new) > self.keep:
            self.known.clear()
        runs = list(new)
        if runs:
            ids = np.array(self.by_run.encode_batch_fast([" ".join(map(self._spelled, runs))], add_special_tokens=False)[0].ids, "<u4")
            ends = [0, *(4 * np.flatnonzero(self.last[ids]) + 4).tolist()]
            data = ids.tobytes()
            self.known.update(zip(runs, [data[i:k] for i, k in pairwise(ends)], strict=True))

    def _ids(self, runs: list[str]) -> bytes:
        get = self.known.get
        try:
            return b"".join(map(get, runs))
        except TypeError:  # a run is not known
            pass
        if len(runs) > self.keep // 4:
            return b"".join(self._ids(runs[i : i + self.keep // 8]) for i in range(0, len(runs), self.keep // 8))
        self._learn(set(runs) - self.known.keys())
        if missing := set(runs) - self.known.keys():  # the table has been emptied
            self._learn(missing)
        return b"".join(map(get, runs))

    def _part(self, text: str) -> bytes:
        if not self.by_word or _ODD.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self._ids(self._runs(text))

    def many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; new runs are learnt for all of them at once, which is cheaper than text by text."""
        if not self.by_word:
            return [self(t) for t in texts]
        parts = [None if len(t) >= 1 << 20 or _ODD.search(t) else self._runs(t) for t in texts]
        get, out, new, open_ = self.known.get, [], set(), []
        for k, runs in enumerate(parts):
            if runs is None:
                out.append(self(texts[k]))
                continue
            found = list(map(get, runs))
            try:
                out.append(b"".join(found))
            except TypeError:  # some are not known
                holes = [i for i, ids in enumerate(found) if ids is None]
                new.update([runs[i] for i in holes])
                open_.append((k, found, holes))
                out.append(b"")
        if len(new) > self.keep // 2:
            for k, _, _ in open_:
                out[k] = self._ids(parts[k])
            return out
        self._learn(new)
        for k, found, holes in open_:
            runs = parts[k]
            for i in holes:
                found[i] = self.known[runs[i]]
            out[k] = b"".join(found)
        return out

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of the whole text. Long texts are taken in parts that end at white space."""
        if len(text) <= 1 << 20 or not self.by_word:
            return self._part(text)
        out, at = [], 0
        while at < len(text):
            end = len(text) if at + (1 << 20) >= len(text) else ((m := _LONG.search(text, at + (1 << 20))) and m.start()) or len(text)
            out.append(self._part(text[at:end]))
            at = end
        return b"".join(out)


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One a Python worker, kept from task to task."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


class Packer:
    """Packs the pieces of one stream of documents.

    A piece is ``[doc_id, start, ids (bytes), doc_tokens]``. Whole windows of the longest tier leave at once; the rest of a
    document waits in the tier of the smallest window that holds it. ``pack`` opens a window for the longest piece of the
    longest tier, fills its gap with the longest waiting pieces that fit, which come from shorter tiers, and closes the last
    gap with a part cut from a shorter piece. A window that cannot be filled is split back and waits for the next group.
    """

    def __init__(self, base: int, tiers=TIERS, group=GROUP_TOKENS, step=STEP_TOKENS):
        self.tiers, self.group, self.step = tuple(sorted(tiers)), group, step
        self.base, self.n, self.steps = base, 0, 0
        self.by_length: dict[int, list] = {}
        self.lengths: list[int] = []
        self.tokens = 0
        self.closed: list[tuple[int, list]] = []

    def _put(self, piece: list) -> None:
        n = len(piece[2]) // 4
        if n not in self.by_length:
            bisect.insort(self.lengths, n)
            self.by_length[n] = []
        self.by_length[n].append(piece)
        self.tokens += n

    def _take(self, most: int):
        """The longest waiting piece of at most so many tokens."""
        k = bisect.bisect_right(self.lengths, most) - 1
        if k < 0:
            return None
        n = self.lengths[k]
        piece = self.by_length[n].pop()
        if not self.by_length[n]:
            del self.by_length[n]
            self.lengths.pop(k)
        self.tokens -= n
        return piece

    @staticmethod
    def _split(piece: list, n: int) -> tuple[list, list]:
        doc, start, ids, total = piece
        return [doc, start, ids[: 4 * n], total], [doc, start + n, ids[4 * n :], total]

    def add(self, piece: list) -> None:
        top = self.tiers[-1]
        while len(piece[2]) // 4 >= top:
            head, piece = self._split(piece, top)
            self.closed.append((top, [head]))
        if piece[2]:
            self._put(piece)

    def pack(self) -> None:
        """Fills windows until what waits cannot fill the window of its longest piece."""
        while self.lengths:
            size = self.tiers[bisect.bisect_left(self.tiers, self.lengths[-1])]
            if self.tokens < size:
                break
            gap, window = size, []
            while gap:
                piece = self._take(gap)
                if piece is None:
                    head, rest = self._split(self._take(self.tiers[-1]), gap)
                    self._put(rest)
                    piece = head
                window.append(piece)
                gap -= len(piece[2]) // 4
            self.closed.append((size, window))

    def full(self) -> bool:
        return self.tokens + sum(n for n, _ in self.closed) >= self.group

    def emit(self) -> list[tuple]:
        """The rows of the closed windows, each in the step group that had the fewest tokens so far, longest windows first."""
        if not self.closed:
            return []
        groups = max(1, round(sum(n for n, _ in self.closed) / self.step))
        load, rows = [0] * groups, []
        for size, window in sorted(self.closed, key=lambda x: -x[0]):
            least = min(range(groups), key=load.__getitem__)
            load[least] += size
            offset, sequence = 0, self.base | self.n
            self.n += 1
            for doc, start, ids, total in window:
                n = len(ids) // 4
                rows.append((doc, start, n, zlib.crc32(ids), total, sequence, offset, size, self.base | (self.steps + least)))
                offset += n
        self.steps += groups
        self.closed = []
        return rows

    def rest(self) -> list[list]:
        return [p for n in self.lengths for p in self.by_length[n]]

    def close(self) -> None:
        """Concatenates what waits into windows of the longest tier; only the last of them is not full."""
        window, room = [], self.tiers[-1]
        for piece in self.rest():
            while piece[2]:
                n = min(room, len(piece[2]) // 4)
                head, piece = self._split(piece, n)
                window.append(head)
                room -= n
                if not room:
                    self.closed.append((self.tiers[-1], window))
                    window, room = [], self.tiers[-1]
        if window:
            self.closed.append((self.tiers[-1], window))
        self.by_length, self.lengths, self.tokens = {}, [], 0


_ROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()), ("step_group", pa.int64()), ("waits", pa.int64()), ("ids", pa.binary())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _ROW]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ROW, strict=True)], schema=_ROW)


def pack_documents(docs: DataFrame, tokenizer_path: str, tiers=TIERS, end_id: int = 2) -> DataFrame:
    """One row a piece: which ids of which document stand where in which sequence.

    ``docs`` needs doc_id and text; other columns are not read. A document's ids are its text's tokens and ``end_id``; a null
    or empty text has ``end_id`` alone. Each partition packs its own documents (no shuffle of texts or ids); what its last
    windows lack is packed with the rests of up to FAN_IN partitions, and the last window of each such set is the only one
    with padding. An empty table gives no rows; repeated rows are packed as often as they occur; a null doc_id is kept.
    """
    ship(docs.sparkSession)

    def each(batches):
        own = TaskContext.get().partitionId()
        packer, encode, end = Packer(own << 33, tiers), tokenizer(tokenizer_path), struct.pack("<I", end_id)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for at in range(0, len(ids), 512):
                part = texts[at : at + 512]
                for doc, tokens in zip(ids[at : at + 512], encode.many(part), strict=True):
                    tokens += end
                    packer.add([doc, 0, tokens, len(tokens) // 4])
                    if packer.full():
                        packer.pack()
                        yield _batch([(*r, None, None) for r in packer.emit()])
        packer.pack()
        yield _batch([(*r, None, None) for r in packer.emit()])
        yield _batch([(doc, start, len(ids) // 4, None, total, None, None, None, None, own // FAN_IN, ids) for doc, start, ids, total in packer.rest()])

    def rests(key, table):
        packer = Packer((1 << 62) | (key[0].as_py() << 33), tiers)
        for doc, start, ids, total in zip(*(table.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")), strict=True):
            packer.add([doc, start, ids, total])
        packer.pack()
        packer.close()
        return pa.Table.from_batches([_batch([(*r, None, None) for r in packer.emit()])]).select(_ROW.names[:9])

    rows = cut(docs.select("doc_id", "text").mapInArrow(each, f"{PIECES}, waits long, ids binary"))
    done = rows.filter(F.col("waits").isNull()).drop("waits", "ids")
    return done.unionByName(rows.filter(F.col("waits").isNotNull()).groupBy("waits").applyInArrow(rests, PIECES))
