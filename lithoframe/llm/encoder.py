"""Whole-text encoding with the ``tokenizers`` library, each distinct word run encoded once.

A text is split before each space and each line end that stands alone between
printable characters. The byte-level pre-tokenizer always ends a token there,
so runs encode alone as they do in the text, and most runs repeat. Arrow splits
the texts of a call and numbers their distinct runs, so Python looks up each of
these once, not each place. New runs are
encoded many at a time, with line ends between them. A text with any other
white space, or with a token that was added to the vocabulary, is encoded whole.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_NEW = object()
#: Rows of a slice and characters of a call: in more text at once, more places share a look-up.
ROWS, CHARS = 1024, 1 << 22


def printable(c: str) -> bool:
    return "!" <= c <= "~" or c.isalnum()


class TextEncoder:
    """Texts to ids, as bytes of little-endian unsigned 32-bit integers.

    Runs are kept in two generations of about ``max_known``: a full one becomes
    the old one, from which runs that are met again move up.
    """

    def __init__(self, path: str, max_known: int = 400_000, longest_known: int = 40):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.vocab_size = self.tokenizer.get_vocab_size()
        self.max_known, self.longest_known = max_known, longest_known
        self.known: dict[str, bytes | None] = {}
        self.old: dict[str, bytes | None] = {}
        self.marks = {c: self.library([c])[0] for c in "\n.,"}

    def library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def marked(self, text: str) -> bool:
        """Whether an added token stands in a text; the library then cuts around it first."""
        return any(a in text for a in self.added)

    def runs(self, runs: list[str], before: str = "", at_once: int = 128) -> list[bytes]:
        """Ids of runs without line ends, each after ``before``."""
        end = int.from_bytes(self.marks["\n"], "little")
        out: list[bytes] = []
        for ids in self.library([before + ("\n" + before).join(runs[i : i + at_once]) for i in range(0, len(runs), at_once)]):
            cuts = (4 * np.flatnonzero(np.frombuffer(ids, "<u4") == end)).tolist()
            out += [ids[a:b] for a, b in zip([0, *[c + 4 for c in cuts]], [*cuts, len(ids)], strict=True)]
        return out

    def learn(self, new: list[str]) -> None:
        """Runs follow a space, or start with the line end that they follow. Others get None: their white space is part of something longer."""
        known, marks = self.known, self.marks
        bare, lines, ended = [], [], []
        for w in new:
            if w.isalpha():
                bare.append(w)
            elif w[:1] == "\n":
                if len(w) > 1 and printable(w[1]) and printable(w[-1]):
                    lines.append(w)
                else:
                    known[w] = None
            elif not w or not printable(w[0]) or not printable(w[-1]):
                known[w] = None
            elif w[-1] in ".," and w[-2:-1].isalpha():
                ended.append(w)
            else:
                bare.append(w)
        plain = list(dict.fromkeys([*bare, *[w for w in [w[:-1] for w in ended] if w not in known]]))
        known.update(zip(plain, self.runs(plain, " "), strict=True))
        known.update(zip(lines, [marks["\n"] + ids for ids in self.runs([w[1:] for w in lines])], strict=True))
        for w in ended:
            known[w] = known[w[:-1]] + marks[w[-1]]

    def known_ids(self, runs: list[str]) -> list[bytes | None]:
        """Ids of distinct runs; None for those that don't encode alone."""
        known, old = self.known, self.old
        out = [known.get(w, _NEW) for w in runs]
        missing = [i for i, ids in enumerate(out) if ids is _NEW]
        new = []
        for i in missing:
            w = runs[i]
            found = old.get(w, _NEW)
            if found is _NEW:
                new.append(w)
            else:
                known[w] = found
        self.learn(new)
        for i in missing:
            out[i] = known[runs[i]]
        for w in new:
            if len(w) > self.longest_known:
                del known[w]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.max_known:
            self.known, self.old = {}, self.known
        heads, rests, lasts, odd = [], [], [], np.zeros(len(texts), bool)
        for i, t in enumerate(texts):
            head, rest, last = "", None, b""
            if self.marked(t) or " \n" in t:  # a space before a line end would be lost in the splitting
                odd[i] = True
            else:
                s = t
                if t[-1:] == "\n":  # so would one before what the text ends with
                    s, last = t[:-1], self.marks["\n"]
                    odd[i] = not s or s[-1] == " "
                head, space, rest = s.replace("\n", " \n").partition(" ")
                rest = rest if space else None
                if head and not printable(head[-1]):
                    odd[i] = True
            heads.append(head)
            rests.append(None if odd[i] else rest)
            lasts.append(last)
        split = pc.split_pattern(pa.array(rests, pa.large_string()), " ")
        cuts, runs = split.offsets.to_numpy(), split.values.dictionary_encode()
        known = self.known_ids(runs.dictionary.to_numpy(zero_copy_only=False).tolist())
        numbers = runs.indices.to_numpy()
        unlike = np.concatenate([[0], np.cumsum(np.array([ids is None for ids in known], bool)[numbers])])
        odd |= unlike[cuts[1:]] > unlike[cuts[:-1]]
        joined = pa.array(known, pa.large_binary()).take(runs.indices)
        _, offsets, data = joined.buffers()
        ends = np.frombuffer(offsets, "<i8", len(joined) + 1)[cuts].tolist() if len(joined) else [0] * len(cuts)
        view = memoryview(data or b"")
        heads = self.library(heads)
        out = [b"".join((h, view[a:b], e)) for h, a, b, e in zip(heads, ends[:-1], ends[1:], lasts, strict=True)]
        whole = np.flatnonzero(odd).tolist()
        for i, ids in zip(whole, self.library([texts[i] for i in whole]), strict=True):
            out[i] = ids
        return out


def cut_text(text: str, most: int = 1 << 20) -> list[str]:
    """A long text in parts of about ``most`` characters, cut before spaces between ASCII letters, where a token always ends; whole if there are none."""
    parts, at = [], 0
    while len(text) - at > most:
        cut = text.find(" ", at + most)
        while cut > 0 and not (cut + 1 < len(text) and text[cut - 1].isascii() and text[cut - 1].isalpha() and text[cut + 1].isascii() and text[cut + 1].isalpha()):
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        parts.append(text[at:cut])
        at = cut
    return [*parts, text[at:]]


def encode_each(encode, texts: list[str], whole: Callable[[str], bool] = lambda t: False) -> list[bytes]:
    """Ids of texts, long ones part by part but for those that must stay ``whole``."""
    if all(len(t) <= 1 << 20 for t in texts):
        return encode(texts)
    parts = [[t] if whole(t) else cut_text(t) for t in texts]
    flat = [p for ps in parts for p in ps]
    ids = (x for _, group in in_groups(flat, flat) for x in encode(group))
    return [b"".join([next(ids) for _ in ps]) for ps in parts]


_encoders: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """This process's encoder for a tokenizer file; later tasks of a worker use what it knows."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = TextEncoder(path)
    return _encoders[path]


def in_groups(ids: list, texts: list[str | None], chars: int = 1 << 20):
    """Consecutive (ids, texts) groups of about ``chars`` characters, so that work on long texts stays small. Null texts are empty."""
    at, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total >= chars or i == len(texts) - 1:
            yield ids[at : i + 1], [x or "" for x in texts[at : i + 1]]
            at, total = i + 1, 0
