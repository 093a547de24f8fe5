"""Encoding whole texts with a public byte-level BPE tokenizer file, by the tokenizers library.

The tokenizer first cuts a text before any space that follows a non-space, and never joins across
such a cut, so a text's ids are those of its space-separated parts in turn. Parts repeat a lot: each
worker keeps the ids of up to ``cache`` parts and gives only unknown ones to the library's pre-tokenizer and
model.
"""

from __future__ import annotations

import re
from itertools import chain
from string import punctuation

import numpy as np

from varlens.session import held

_CUT = re.compile(r"(?<=\S) ")
#: White space other than the space itself (fixed values of the Unicode standard).
_BLANK = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"
_ODD = _BLANK.replace("\n", "")
_BREAK = ("\n",)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def parts_of(text: str, plain: bool = False) -> list:
    """The text cut where tokens never cross: before each space that follows a non-space (that space left out), and, if
    every line break stands between non-spaces, around line breaks. A part that no space precedes is a 1-tuple.
    ``plain``: the text is known to have no white space but spaces and line breaks."""
    odd = not plain and any(c in text for c in _ODD)
    if odd or "  " in text or "\n " in text or text[:1] == " ":
        parts: list = _CUT.split(text)
        parts[0] = (parts[0],)
        return parts
    if "\n\n" in text or " \n" in text or text[:1] == "\n" or text[-1:] == "\n":
        parts = text.split(" ")
        parts[0] = (parts[0],)
        return parts
    parts = []
    for line in text.split("\n"):
        words = line.split(" ")
        parts.append(_BREAK)
        parts.append((words[0],))
        parts += words[1:]
    return parts[1:]


class _Known(dict):
    """Places of known parts; -1 for others."""

    def __missing__(self, key) -> int:
        return -1


class Encoder:
    """One worker's tokenizer and part cache. ``special`` strings in a text are ordinary text."""

    def __init__(self, path: str, cache: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
        # How the byte-level pre-tokenizer shows each byte: the n-th byte without a picture is character 256 + n.
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = [b for b in range(256) if b not in shown]
        self.shown = {b: 256 + n for n, b in enumerate(hidden)}
        self.marks: dict[str, list[int]] = {}
        self.cache = cache
        self.known = _Known()
        self.ids = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 12, np.int64)
        self.length = np.zeros(1 << 12, np.int64)
        self.used = 0

    def _ids(self, part) -> list[int]:
        """Ids of one part: the model's of each of its pre-tokens. Letters alone are one; so are the ASCII marks after them."""
        space, text = ("\u0120", part) if isinstance(part, str) else ("", part[0])
        core = text.rstrip(punctuation)
        if core and not core.isalpha():
            return [t.id for piece, _ in self.cut((" " if space else "") + text) for t in self.model.tokenize(piece)]
        marks = text[len(core) :]
        if not core:
            return [t.id for t in self.model.tokenize(space + marks)]
        if marks:
            if marks not in self.marks:
                if len(self.marks) > 10_000:
                    self.marks.clear()
                self.marks[marks] = [t.id for t in self.model.tokenize(marks)]
            tail = self.marks[marks]
            place = self.known[core if space else (core,)]
            if place >= 0:
                a = int(self.start[place])
                return self.ids[a : a + int(self.length[place])].tolist() + tail
        else:
            tail = []
        shown = core if core.isascii() else core.encode().decode("latin-1").translate(self.shown)
        return [t.id for t in self.model.tokenize(space + shown)] + tail

    def _learn(self, fresh: list) -> None:
        """Append the ids of parts that the arrays don't hold yet."""
        lists = list(map(self._ids, fresh))
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        base = int(self.start[self.count - 1] + self.length[self.count - 1]) if self.count else 0
        total = int(lengths.sum())
        while len(self.ids) < base + total:
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.start) < self.count + len(fresh):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
        self.ids[base : base + total] = np.fromiter(chain.from_iterable(lists), np.uint32, total)
        self.length[self.count : self.count + len(fresh)] = lengths
        self.start[self.count : self.count + len(fresh)] = base + np.cumsum(lengths) - lengths
        self.count += len(fresh)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and how many each text has."""
        keys: list = []
        whole = "".join(texts)
        plain = not any(c in whole for c in _ODD)
        counts = np.zeros(len(texts), np.int64)
        for n, text in enumerate(texts):
            if text:
                parts = parts_of(text, plain)
                counts[n] = len(parts)
                keys += parts
        self.count = self.used
        known = self.known
        index = np.fromiter(map(known.__getitem__, keys), np.int64, len(keys))
        missed = np.flatnonzero(index < 0)
        if len(missed):
            local: dict = {}
            index[missed] = np.fromiter((self.used + local.setdefault(keys[i], len(local)) for i in missed.tolist()), np.int64, len(missed))
            fresh = list(local)
            self._learn(fresh)
            keep = max(0, self.cache - len(known))
            for i, key in enumerate(fresh[:keep]):
                known[key] = self.used + i
            self.used += min(keep, len(fresh))
        length = self.length[index]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(self.start[index] - ends + length, length)
        of_text = np.add.reduceat(np.append(length, 0), np.cumsum(counts) - counts) if len(counts) else counts
        return self.ids[at], np.where(counts > 0, of_text, 0)


def encoder_of(path: str) -> Encoder:
    """This worker's encoder, which outlives a task."""
    return held(("encoder", path), lambda: Encoder(path))


def text_runs(texts: list, most: int = 1 << 20):
    """Ranges [a, b) of a batch with about ``most`` characters each, so that no step holds much."""
    a, size = 0, 0
    for b, text in enumerate(texts):
        size += len(text)
        if size >= most:
            yield a, b + 1
            a, size = b + 1, 0
    if a < len(texts):
        yield a, len(texts)


def encode_documents(batches, path: str, end_id: int):
    """Per run of texts of Arrow batches with columns doc_id and text: (doc_ids, uint32 ids with end ids, starts, lengths)."""
    encoder = encoder_of(path)
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        doc_ids = batch.column("doc_id")
        for a, b in text_runs(texts):
            ids, counts = encoder.encode(texts[a:b])
            lengths = counts + 1
            ends = np.cumsum(lengths)
            out = np.full(int(ends[-1]), end_id, "<u4")
            keep = np.ones(len(out), bool)
            keep[ends - 1] = False
            out[keep] = ids
            yield doc_ids.slice(a, b - a), out, ends - lengths, lengths
