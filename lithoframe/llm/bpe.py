"""Byte-level BPE by corpus-level merge replay, a block of the corpus at a time.

All words that a block of texts has and that its worker does not know yet are laid out as
one array of symbols. An inverted index leads from each token that two
neighbours can form to the places where they do. Tokens are formed in rank
order, each at all its places at once; only the pairs beside a merge change,
and only those enter the index anew.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lithoframe.llm.common import keyed_text, lean, sliced
from lithoframe.llm.encoder import encode_each, in_groups


def read_ranks(path: str) -> dict[bytes, int]:
    """A file of ranks: base64 of a token, a space, its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class MergeTable:
    """Which token two neighbours form. ``after[a]`` and ``before[b]`` list partners in order, with the token formed."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.text = {r: t for t, r in ranks.items()}
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = np.array([(a, b, r) for t, r in ranks.items() for i in range(1, len(t)) if (a := ranks.get(t[:i])) is not None and (b := ranks.get(t[i:])) is not None], np.int64).reshape(-1, 3)
        self.after, self.before = self.partners(pairs, 0), self.partners(pairs, 1)
        self.two = np.full((256, 256), -1, np.int32)
        for t, r in ranks.items():
            if len(t) == 2:
                self.two[t[0], t[1]] = r
        # Tokens that, once formed, may form one of lower rank: their places in a word are taken one at a time.
        self.early = set(pairs[pairs[:, 0] > pairs[:, 2], 0].tolist()) | set(pairs[pairs[:, 1] > pairs[:, 2], 1].tolist())

    @staticmethod
    def partners(pairs: np.ndarray, side: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        pairs = pairs[np.lexsort((pairs[:, 1 - side], pairs[:, side]))]
        keys, first = np.unique(pairs[:, side], return_index=True)
        ends = [*first[1:].tolist(), len(pairs)]
        return {k: (pairs[i:j, 1 - side].astype(np.int32), pairs[i:j, 2].astype(np.int32)) for k, i, j in zip(keys.tolist(), first.tolist(), ends, strict=True)}

    @staticmethod
    def formed(table: dict, token: int, partners: np.ndarray) -> np.ndarray:
        """The token formed with each partner, or -1."""
        if token not in table:
            return np.full(len(partners), -1, np.int32)
        keys, out = table[token]
        at = np.minimum(np.searchsorted(keys, partners), len(keys) - 1)
        return np.where(keys[at] == partners, out[at], -1)


def replay(words: list[bytes], table: MergeTable) -> list[bytes]:
    """Ids of each word as little-endian unsigned 32-bit integers. A word that is a token is that token."""
    if not words:
        return []
    flat = np.frombuffer(b"".join(words), np.uint8)
    n = len(flat)
    lengths = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(lengths)
    symbol = table.byte[flat].astype(np.int32)
    following, previous = np.arange(1, n + 1), np.arange(-1, n - 1)
    following[ends - 1] = n
    previous[ends - lengths] = -1
    alive = np.ones(n + 1, bool)
    pair = np.full(n + 1, -1, np.int32)
    pair[: n - 1] = table.two[flat[:-1], flat[1:]]
    pair[ends - 1] = -1
    index: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []

    def enter(places: np.ndarray, tokens: np.ndarray) -> None:
        real = tokens >= 0
        places, tokens = places[real], tokens[real]
        if not len(places):
            return
        order = np.argsort(tokens, kind="stable")
        tokens, places = tokens[order], places[order]
        cuts = np.flatnonzero(np.diff(tokens)) + 1
        for token, group in zip(tokens[np.concatenate([[0], cuts])].tolist(), np.split(places, cuts), strict=True):
            if token in index:
                index[token].append(group)
            else:
                index[token] = [group]
                heappush(queue, token)

    enter(np.arange(n), pair[:n])
    heapify(queue)
    while queue:
        token = heappop(queue)
        groups = index.pop(token)
        places = groups[0] if len(groups) == 1 else np.concatenate(groups)
        places = places[pair[places] == token]
        if not len(places):
            continue
        places = np.unique(places)
        if token in table.early and len(places) > 1:
            _, lead = np.unique(np.searchsorted(ends, places, side="right"), return_index=True)
            rest = np.delete(places, lead)
            places = places[lead]
            if len(rest):
                index[token] = [rest]
                heappush(queue, token)
        if len(places) > 1:
            chained = np.concatenate([[False], following[places[:-1]] == places[1:]])
            if chained.any():  # of overlapping places, every other from the left
                at = np.arange(len(places))
                since = at - np.maximum.accumulate(np.where(chained, 0, at))
                places = places[since % 2 == 0]
        right = following[places]
        beyond = following[right]
        symbol[places] = token
        following[places] = beyond
        alive[right] = False
        pair[right] = -1
        within = beyond < n
        previous[beyond[within]] = places[within]
        new = np.full(len(places), -1, np.int32)
        new[within] = table.formed(table.after, token, symbol[beyond[within]])
        pair[places] = new
        enter(places, new)
        left = previous[places]
        left = left[left >= 0]
        new = table.formed(table.before, token, symbol[left])
        pair[left] = new
        enter(left, new)
    counts = np.add.reduceat(alive[:n], ends - lengths)
    ids = symbol[alive[:n]].astype("<u4").tobytes()
    stops = (4 * np.cumsum(counts)).tolist()
    out = [ids[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]
    ranks = table.ranks
    return [ranks[w].to_bytes(4, "little") if w in ranks else got for w, got in zip(words, out, strict=True)]


class BytePairCoder:
    """Texts to ids and back. Words met before are kept, about ``max_known`` of them."""

    def __init__(self, path: str, pattern: str, max_known: int = 300_000, longest_known: int = 64):
        import regex

        self.table = MergeTable(read_ranks(path))
        self.words = regex.compile(pattern).findall
        # Very long texts are cut before a space between ASCII letters, for patterns that always end a match there.
        self.cuts = all(self.words(a + b) == [*self.words(a), *self.words(b)] for a in ("ab", "x's Ab", "1 b", "one, two") for b in (" cd", " c's", " d1, e"))
        self.max_known, self.longest_known = max_known, longest_known
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.max_known:
            self.known.clear()
        known = self.known
        split = [self.words(t) for t in texts]
        new = [w for w in set().union(*split) if w not in known]
        known.update(zip(new, replay([w.encode("utf-8", "surrogatepass") for w in new], self.table), strict=True))
        out = [b"".join(map(known.__getitem__, p)) for p in split]
        for w in new:
            if len(w) > self.longest_known:
                del known[w]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.text.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_coders: dict[tuple[str, str], BytePairCoder] = {}


def coder(path: str, pattern: str) -> BytePairCoder:
    """This process's coder; later tasks of a worker use the words it knows."""
    if (path, pattern) not in _coders:
        _coders.clear()
        _coders[path, pattern] = BytePairCoder(path, pattern)
    return _coders[path, pattern]


def _encoded(use: BytePairCoder, batches, block_chars: int):
    for batch in sliced(batches, 1024):
        for keys, texts in in_groups(batch.column(0).to_pylist(), batch.column(1).to_pylist(), block_chars):
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(encode_each(use.encode, texts, lambda t: not use.cuts), pa.binary())], ["doc_id", "ids"])


def _decoded(use: BytePairCoder, batches):
    for part in sliced(batches, 256):
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([use.decode(x or b"") for x in part.column(1).to_pylist()], pa.binary())], ["doc_id", "ids", "decoded"])


def _digested(batches):
    sha = lambda x: hashlib.sha256(x or b"").hexdigest()
    for batch in batches:
        ids = batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x or b"") // 4 for x in ids], pa.int64()), pa.array(map(sha, ids), pa.string()), pa.array(map(sha, batch.column(2).to_pylist()), pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def bpe_encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 3 << 20) -> DataFrame:
    """``doc_id`` and ``ids`` (binary, little-endian unsigned 32-bit) of every whole text; a null or empty text has none.

    Each match of ``pattern`` is encoded alone. Rows that repeat an id are each
    encoded; other columns play no part; an empty table gives no rows. Merges
    are replayed for blocks of about ``block_chars`` characters, or one text.
    """
    return keyed_text(df, id_col, text_col).mapInArrow(lean(lambda b: _encoded(coder(path, pattern), b, block_chars)), "doc_id long, ids binary")


def bpe_decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id``, ``ids`` and ``decoded`` (binary) for what ``bpe_encode`` gives; null ids decode to nothing."""
    return encoded.select("doc_id", "ids").mapInArrow(lean(lambda b: _decoded(coder(path, pattern), b)), "doc_id long, ids binary, decoded binary")


def bpe_digests(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 3 << 20) -> DataFrame:
    """Encode and decode in one pass: token count and SHA-256 of ids and of decoded bytes. Rows are handled as ``bpe_encode`` says."""

    def run(batches):
        use = coder(path, pattern)
        yield from _digested(_decoded(use, _encoded(use, batches, block_chars)))

    return keyed_text(df, id_col, text_col).mapInArrow(lean(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
