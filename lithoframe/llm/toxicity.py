"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input joins a hashed word embedding, the mean embedding of its
character trigrams, and the log-odds of the label given the word and given its
most telling character n-gram (from other folds while training). Overlapping windows of words run through the network in
both directions; attention pools each window, and the text's score is that of
its highest window. Only the highest window of a text trains, with some others
where the text is clean, since a label does not say where a text is toxic.

A run of more than ``LONGEST`` characters without white space, as in languages
that write no spaces, becomes overlapping parts that each count as a word, so
that all of it is read. A part stands for the word of five characters or more
that it holds anywhere, if one tells of the label; its own n-grams are those of
such runs in the training texts.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lithoframe.llm.common import keyed_text, lean, sliced
from lithoframe.llm.encoder import in_groups
from lithoframe.llm.labelled import training_rows

WINDOW, STRIDE, FOLDS = 24, 12, 4
STRIP = ".,;:!?\"'()[]{}<>*#$%&-_|/\\"
LONGEST, PART_STEP, INNER = 32, 16, "\0"
PAD_GATE = -30.0
# crc32 of three bytes is the exclusive or of a number for each of them and one for three zeros.
_ZERO = zlib.crc32(bytes(3))
_CRC = [np.array([zlib.crc32(bytes(k) + bytes([b]) + bytes(2 - k)) ^ _ZERO for b in range(256)], np.uint32) for k in range(3)] + [np.uint32(_ZERO)]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def words_of(text: str) -> list[str]:
    """Words in lower case, long ones in parts."""
    return parted(text.lower().split())


def parted(words: list[str]) -> list[str]:
    """Words, those of more than ``LONGEST`` characters as overlapping parts, which begin with ``INNER``."""
    out = []
    for w in words:
        if len(w) <= LONGEST:
            out.append(w)
        else:
            out += [INNER + w[i : i + LONGEST] for i in range(0, len(w) - LONGEST + PART_STEP, PART_STEP)]
    return out


def inner_words(part: str) -> list[str]:
    """All stretches of 5 to 16 characters of a part, any of which may be a word."""
    return [part[i : i + n] for n in range(5, 17) for i in range(1, len(part) - n + 1)]


def grams_of(word: str) -> list[str]:
    """The marked word's beginnings and ends of 4 to 8 characters; of a part, all its stretches of 2 to 8, marked as such."""
    if word[:1] == INNER:
        return [INNER + word[i : i + n] for n in range(2, 9) for i in range(1, len(word) - n + 1)]
    marked = f"<{word}>"
    longest = min(8, len(marked))
    return [marked[:n] for n in range(4, longest + 1)] + [marked[-n:] for n in range(4, longest + 1)]


def window_starts(n: int) -> range:
    """Every ``STRIDE`` words, until a window reaches the end."""
    return range(0, max(1, n - WINDOW + STRIDE), STRIDE)


class GatedNet:
    """Parameters, forward and backward passes. Rows of an input are words; time is the first axis of windows."""

    def __init__(self, seed: int = 0, hidden: int = 8, embed: int = 6, word_rows: int = 8192, char_rows: int = 4096):
        rng = np.random.default_rng(seed)
        self.hidden, self.embed, self.word_rows, self.char_rows = hidden, embed, word_rows, char_rows
        size = 2 * embed + 2
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"word": 0.1 * draw(1, word_rows, embed)[0], "char": 0.1 * draw(1, char_rows, embed)[0], "att_w": draw(2 * hidden, hidden), "att_v": draw(hidden), "out_w": draw(2 * hidden), "out_b": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"{d}_x": draw(size, 3 * hidden), f"{d}_h": draw(hidden, 3 * hidden), f"{d}_b": np.zeros(3 * hidden, np.float32)}
        self.odds: dict[str, float] = {}
        self.gram_odds: dict[str, float] = {}

    def told(self, word: str) -> str:
        """What stands for a word in the tables: the word, or of a part the inner word of the highest log-odds, if any are above 0."""
        if word[:1] != INNER:
            return word
        best = max(inner_words(word), key=lambda w: self.odds.get(w, 0.0), default="")
        return best if self.odds.get(best, 0.0) > 0 else word[1:]

    def evidence(self, words: list[str]) -> np.ndarray:
        """Log-odds of each word and the highest of its n-grams'."""
        grams = self.gram_odds
        most = lambda w: max((grams.get(g, 0.0) for g in grams_of(w)), default=0.0)
        out = np.array([(self.odds.get(w, 0.0), most(w)) for w in words], np.float32).reshape(-1, 2)
        for i in [i for i, w in enumerate(words) if w[:1] == INNER]:
            held = self.told(words[i])
            out[i] = self.odds.get(held, 0.0), max(out[i, 1], most(held) if held in self.odds else 0.0)
        return out

    def hashes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Embedding row of each word, then trigram rows one after another and where each word's begin."""
        words = [self.told(w) if w[:1] == INNER else w for w in words]
        word = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) % self.word_rows for w in words], np.int64)
        marked = [f"<{w}>".encode("utf-8", "surrogatepass") for w in words]
        sizes = np.array([len(b) for b in marked], np.int64)
        data = np.frombuffer(b"".join([*marked, b"  "]), np.uint8)
        crc = _CRC[0][data[:-2]] ^ _CRC[1][data[1:-1]] ^ _CRC[2][data[2:]] ^ _CRC[3]
        ends = np.cumsum(sizes)
        first = ends - sizes
        bare = sizes < 3  # the empty word has its two marks only
        crc[first[bare]] = zlib.crc32(b"<>")
        counts = np.maximum(sizes - 2, 1)
        begins = np.cumsum(counts) - counts
        at = np.repeat(first - begins, counts) + np.arange(int(counts.sum()))
        return word, crc[at].astype(np.int64) % self.char_rows, begins

    def inputs(self, hashed, odds: np.ndarray) -> np.ndarray:
        word, grams, begins = hashed
        if not len(word):
            return np.zeros((0, 2 * self.embed + 2), np.float32)
        counts = np.diff([*begins, len(grams)])[:, None]
        chars = np.add.reduceat(self.p["char"][grams], begins, axis=0) / counts
        return np.concatenate([self.p["word"][word], chars, odds], axis=1, dtype=np.float32)

    def projected(self, x: np.ndarray) -> np.ndarray:
        """Both directions' input part of gates and candidates; the first row is padding, whose update gate stays shut."""
        out = np.zeros((len(x) + 1, 6 * self.hidden), np.float32)
        out[1:] = np.concatenate([x @ self.p["f_x"] + self.p["f_b"], x @ self.p["b_x"] + self.p["b_b"]], axis=1)
        for d in (0, 3):
            out[0, d * self.hidden : (d + 1) * self.hidden] = PAD_GATE
        return out

    def run(self, table: np.ndarray, index: np.ndarray, keep: bool = False):
        """Logits of windows. ``index``: rows of ``table`` (time, window); row 0 pads."""
        steps, n = index.shape
        h = self.hidden
        states = np.empty((2, steps, n, h), np.float32)
        kept = [[None] * steps, [None] * steps]
        for d, name in enumerate("fb"):
            state, weights = np.zeros((n, h), np.float32), self.p[f"{name}_h"]
            part = table[:, 3 * h * d : 3 * h * (d + 1)]
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                x = part[index[t]]
                back = state @ weights
                gates = x[:, : 2 * h] + back[:, : 2 * h]
                gates *= 0.5
                np.tanh(gates, out=gates)
                gates *= 0.5
                gates += 0.5
                z, r = gates[:, :h], gates[:, h:]
                new = np.tanh(x[:, 2 * h :] + r * back[:, 2 * h :])
                if keep:
                    kept[d][t] = (state, z, r, new, back[:, 2 * h :])
                state = state + z * (new - state)
                states[d, t] = state
        joined = np.concatenate([states[0], states[1]], axis=2)
        hid = np.tanh(joined @ self.p["att_w"])
        logit = hid @ self.p["att_v"]
        pad = index == 0
        logit[pad] = -1e9
        e = np.exp(logit - logit.max(axis=0))
        e[pad] = 0
        share = e / np.maximum(e.sum(axis=0), 1e-12)
        pooled = np.einsum("tn,tnh->nh", share, joined)
        out = pooled @ self.p["out_w"] + self.p["out_b"]
        return (out, (joined, hid, share, pooled, kept)) if keep else out

    def gradients(self, x: np.ndarray, index: np.ndarray, labels: np.ndarray, weights: np.ndarray):
        """Gradients of the weighted log loss, and that for the rows of ``x``."""
        h, p = self.hidden, self.p
        out, (joined, hid, share, pooled, kept) = self.run(self.projected(x), index, keep=True)
        g = {k: np.zeros_like(v) for k, v in p.items() if k not in ("word", "char")}
        d_out = (sigmoid(out) - labels) * weights / weights.sum()
        g["out_w"], g["out_b"] = pooled.T @ d_out, d_out.sum(keepdims=True)
        d_pool = d_out[:, None] * p["out_w"]
        d_joined = share[:, :, None] * d_pool
        d_share = np.einsum("nh,tnh->tn", d_pool, joined)
        d_logit = share * (d_share - (share * d_share).sum(axis=0))
        g["att_v"] = np.einsum("tn,tnh->h", d_logit, hid)
        d_hid = d_logit[:, :, None] * p["att_v"] * (1 - hid * hid)
        g["att_w"] = np.einsum("tna,tnb->ab", joined, d_hid)
        d_joined += d_hid @ p["att_w"].T
        d_x = np.zeros((len(x) + 1, x.shape[1]), np.float32)
        steps = index.shape[0]
        padded = np.concatenate([np.zeros((1, x.shape[1]), np.float32), x])
        for d, name in enumerate("fb"):
            carry = np.zeros((index.shape[1], h), np.float32)
            for t in range(steps - 1, -1, -1) if d == 0 else range(steps):
                state, z, r, new, back = kept[d][t]
                total = carry + d_joined[t, :, h * d : h * (d + 1)]
                d_new = total * z * (1 - new * new)
                d_z = total * (new - state) * z * (1 - z)
                d_r = d_new * back * r * (1 - r)
                d_back = np.concatenate([d_z, d_r, d_new * r], axis=1)
                d_in = np.concatenate([d_z, d_r, d_new], axis=1)
                d_in[index[t] == 0] = 0
                g[f"{name}_h"] += state.T @ d_back
                g[f"{name}_x"] += padded[index[t]].T @ d_in
                g[f"{name}_b"] += d_in.sum(axis=0)
                np.add.at(d_x, index[t], d_in @ p[f"{name}_x"].T)
                carry = total * (1 - z) + d_back @ p[f"{name}_h"].T
        return g, d_x[1:]


def layout(lengths: list[int], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows (time, window) of texts whose words' rows follow each other in ``rows``, and each window's text."""
    starts, owner, ends = [], [], []
    at = 0
    for i, n in enumerate(lengths):
        s = window_starts(n)
        starts += [at + k for k in s]
        owner += [i] * len(s)
        ends += [at + n] * len(s)
        at += n
    place = np.array(starts, np.int64)[None, :] + np.arange(WINDOW)[:, None]
    inside = place < np.array(ends, np.int64)[None, :]
    rows = np.concatenate([rows, np.zeros(1, rows.dtype)])
    return np.where(inside, rows[np.minimum(place, len(rows) - 1)], 0), np.array(owner, np.int64)


def log_odds(uses: list[np.ndarray], size: int, labels: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """Smoothed log-odds of label 1 for features in two texts or more: a column for each fold, from the others, and one from all.

    ``uses``: the distinct features of each text.
    """
    owner = np.repeat(2 * fold + labels, [len(u) for u in uses])
    flat = np.concatenate(uses) if uses else np.zeros(0, np.int64)
    seen = np.bincount(flat * (2 * FOLDS) + owner, minlength=size * 2 * FOLDS).reshape(size, FOLDS, 2)
    texts = np.bincount(2 * fold + labels, minlength=2 * FOLDS).reshape(1, FOLDS, 2)
    without = lambda x: np.concatenate([x.sum(axis=1, keepdims=True) - x, x.sum(axis=1, keepdims=True)], axis=1)
    n, total = without(seen), without(texts)
    odds = np.log((n[..., 1] + 0.5) / (total[..., 1] + 1)) - np.log((n[..., 0] + 0.5) / (total[..., 0] + 1))
    return np.where(n.sum(axis=2) > 1, np.clip(odds, -4, 4) / 2, 0).astype(np.float32)


def fit(rows: list[tuple[str, int]], epochs: int = 5, seed: int = 0, batch: int = 64, rate: float = 0.01, least_steps: int = 250, with_odds: bool = True) -> GatedNet:
    """Train on texts and labels, for ``epochs`` or as many as make ``least_steps``. Without both labels the net stays as drawn, with its bias at the label.

    Without ``with_odds`` the log-odds are all 0, and the net has only its embeddings.
    """
    net = GatedNet(seed)
    labels = np.array([y for _, y in rows], np.int64)
    if len(set(labels.tolist())) < 2:
        net.p["out_w"][:] = 0
        net.p["out_b"][:] = 3.0 if labels.sum() else -3.0
        return net
    docs = [[w.strip(STRIP) for w in words_of(t)] for t, _ in rows]
    fold = np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) % FOLDS for t, _ in rows])
    vocab: dict[str, int] = {}
    grams: dict[str, int] = {}
    for d in docs:
        for w in d:
            vocab.setdefault(w, len(vocab))
    words = list(vocab)
    own_grams = [np.array([grams.setdefault(g, len(grams)) for g in grams_of(w)] or [grams.setdefault("", len(grams))], np.int64) for w in words]
    uses = [np.unique(np.array([vocab[w] for w in d], np.int64)) for d in docs]
    by_word = log_odds(uses, len(words), labels, fold)
    by_gram = log_odds([np.unique(np.concatenate([own_grams[i] for i in u])) if len(u) else u for u in uses], len(grams), labels, fold)
    by_word[np.abs(by_word) <= 0.25] = 0
    by_gram[by_gram <= 0.5] = 0
    if not with_odds:
        by_word[:], by_gram[:] = 0, 0
    sizes = np.array([len(g) for g in own_grams])
    best = np.maximum.reduceat(by_gram[np.concatenate(own_grams)], np.cumsum(sizes) - sizes, axis=0)
    for i, w in enumerate(words):
        if w[:1] == INNER:  # a part has the log-odds of what it holds, as it has when texts are scored
            held = max((vocab[x] for x in inner_words(w) if x in vocab), key=lambda k: by_word[k, FOLDS], default=i)
            by_word[i] = by_word[held] if held != i and by_word[held, FOLDS] > 0 else 0
            best[i] = np.maximum(best[i], best[held]) if by_word[i, FOLDS] else best[i]
    odds = np.stack([by_word.T, best.T], axis=2)[:FOLDS]
    net.odds = {w: float(v) for w, v in zip(words, by_word[:, FOLDS], strict=True) if v and w[:1] != INNER}
    net.gram_odds = {g: float(v) for g, v in zip(grams, by_gram[:, FOLDS], strict=True) if v}
    flat = np.array([vocab[w] + 1 for d in docs for w in d], np.int32)
    index, owner = layout([len(d) for d in docs], flat)
    hashed = net.hashes(words)
    spans = [hashed[1][a:b] for a, b in zip(hashed[2], [*hashed[2][1:], len(hashed[1])], strict=True)]
    rng = np.random.default_rng(seed)
    first = np.searchsorted(owner, np.arange(len(docs) + 1))
    with_pad = np.concatenate([np.zeros((FOLDS, 1), np.float32), odds.sum(axis=2)], axis=1)
    score = with_pad[fold[owner][None, :], index].max(axis=0)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step = 0
    epochs = max(epochs, -(-least_steps * batch // len(docs)))
    for epoch in range(epochs):
        if epoch and epoch % max(1, epochs // 6) == 0:
            score = np.empty(len(owner), np.float32)
            for f in range(FOLDS):
                table = net.projected(net.inputs(hashed, odds[f]))
                mine = np.flatnonzero(fold[owner] == f)
                for i in range(0, len(mine), 8192):
                    score[mine[i : i + 8192]] = net.run(table, index[:, mine[i : i + 8192]])
        order = rng.permutation(len(docs))
        for at in range(0, len(order), batch):
            chosen = []
            for i in order[at : at + batch]:
                a, b = first[i], first[i + 1]
                chosen.append(a + int(np.argmax(score[a:b])))
                if not labels[i]:
                    chosen += rng.integers(a, b, 2).tolist()
            part = index[:, chosen]
            f = fold[owner[chosen]]
            pairs, inverse = np.unique(np.where(part, part * FOLDS + f[None, :], 0), return_inverse=True)
            inverse = inverse.reshape(part.shape)
            real = pairs[pairs > 0]
            ids = real // FOLDS - 1
            local = inverse + (1 if pairs[0] else 0)
            lens = [len(spans[i]) for i in ids]
            own = (hashed[0][ids], np.concatenate([spans[i] for i in ids]), np.concatenate([[0], np.cumsum(lens)[:-1]]).astype(np.int64)) if len(ids) else net.hashes([])
            x = net.inputs(own, odds[real % FOLDS, ids])
            y = labels[owner[chosen]].astype(np.float32)
            g, d_x = net.gradients(x, local, y, np.where(y > 0, 3.0, 1.0).astype(np.float32))
            e = net.embed
            g["word"], g["char"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["char"])
            np.add.at(g["word"], own[0], d_x[:, :e])
            np.add.at(g["char"], own[1], np.repeat(d_x[:, e : 2 * e] / np.array(lens, np.float32)[:, None], lens, axis=0) if len(ids) else np.zeros((0, e)))
            step += 1
            for k, v in net.p.items():
                m, s = moments[k]
                m += 0.1 * (g[k] - m)
                s += 0.001 * (g[k] ** 2 - s)
                v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return net


class Scorer:
    """A trained net with the input part of every word met so far, at most ``max_words``."""

    def __init__(self, net: GatedNet, max_words: int = 120_000):
        self.net, self.max_words = net, max_words
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.table, self.used = np.zeros((1024, 6 * self.net.hidden), np.float32), 1
        self.table[:1] = self.net.projected(np.zeros((0, 2 * self.net.embed + 2), np.float32))

    def learn(self, new: list[str]) -> None:
        plain = [w.strip(STRIP) for w in new]
        part = self.net.projected(self.net.inputs(self.net.hashes(plain), self.net.evidence(plain)))[1:]
        while self.used + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[self.used : self.used + len(new)] = part
        self.rows.update(zip(new, range(self.used, self.used + len(new)), strict=True))
        self.used += len(new)

    def score(self, texts: list[str], at_once: int = 4096) -> np.ndarray:
        """The score of each whole text: that of its highest window."""
        if self.used > self.max_words:
            self.clear()
        split = [t.lower().split() for t in texts]
        rows = self.rows
        new = [w for w in set().union(*split) if w not in rows]
        long = {w for w in new if len(w) > LONGEST}
        if long:  # a long word is never known itself, only its parts are
            split = [d if long.isdisjoint(d) else parted(d) for d in split]
            parts = set(parted(list(long)))
            new = [w for w in (*(set(new) - long), *parts) if w not in rows]
        if new:
            self.learn(new)
        flat = np.array([rows[w] for d in split for w in d], np.int64)
        index, owner = layout([len(d) for d in split], flat)
        logit = np.concatenate([self.net.run(self.table, index[:, i : i + at_once]) for i in range(0, index.shape[1], at_once)])
        best = np.maximum.reduceat(logit, np.searchsorted(owner, np.arange(len(texts))))
        return sigmoid(best.astype(np.float64))


def train_toxicity(documents: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held_fold: int = 0, max_rows: int = 3000, max_chars: int = 8_000, epochs: int = 5) -> GatedNet:
    """Fit on at most ``max_rows`` labelled rows whose text has at most ``max_chars`` characters, outside the held-out fold."""
    return fit(training_rows(documents, labels, label, folds, held_fold, max_rows, max_chars), epochs)


def with_toxicity(df: DataFrame, net: GatedNet, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of ``df`` with ``score_col`` (0 to 1), over all windows of each whole text; a column of that name is replaced.

    A null or empty text, or one of white space only, gets the score of a
    window without words. Rows that repeat are each scored; further columns
    pass through; an empty table gives no rows.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(net)
    own = df.drop(score_col)
    at = own.columns.index(text_col)

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in sliced(batches, 512):
            done = 0
            for rows, texts in in_groups(list(range(batch.num_rows)), batch.column(at).to_pylist(), 1 << 19):
                part = batch.slice(done, len(rows))
                done += len(rows)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scorer.score(texts))], [*batch.schema.names, score_col])

    return own.mapInArrow(lean(run), T.StructType([*own.schema.fields, T.StructField(score_col, T.DoubleType())]))


def score_toxicity(df: DataFrame, net: GatedNet, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` for every row, as ``with_toxicity`` gives it."""
    return with_toxicity(keyed_text(df, id_col, text_col), net).select("doc_id", "score")
