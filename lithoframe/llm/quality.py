"""Quality by histogram gradient-boosted trees over document statistics, in numpy.

Statistics are computed over the whole text. Trees are grown on binned
statistics to a fixed depth and flattened into arrays (feature, threshold, left,
right, value), so that all rows go down a tree together.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lithoframe.llm.common import keyed_text, lean, sliced
from lithoframe.llm.labelled import training_rows

STATISTICS = (
    "log_bytes", "log_words", "mean_word", "long_word", "distinct_words", "top_word", "log_lines", "mean_line", "distinct_lines", "log_sentences",
    "words_a_sentence", "upper", "digit", "space", "comma", "period", "pipe", "other_punct", "high_bytes", "entropy", "capital_words", "marked_words", "repeated_pairs", "short_words",
)
_UPPER, _DIGIT, _SPACE, _COMMA, _PERIOD, _PIPE, _OTHER, _HIGH = (np.zeros(256, bool) for _ in range(8))
_UPPER[65:91] = _DIGIT[48:58] = _HIGH[128:] = True
_SPACE[[32, 9, 10, 11, 12, 13]] = _COMMA[44] = _PERIOD[46] = _PIPE[124] = True
_OTHER[[c for c in range(33, 127) if not chr(c).isalnum() and c not in (44, 46, 124)]] = True
_CLASSES = np.stack([_UPPER, _DIGIT, _SPACE, _COMMA, _PERIOD, _PIPE, _OTHER, _HIGH]).astype(np.float64)


def statistics(text: str) -> list[float]:
    """The statistics of one whole text, in the order of ``STATISTICS``; all are finite, for an empty text too."""
    data = text.encode("utf-8", "surrogatepass")
    n = max(1, len(data))
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    upper, digit, space, comma, period, pipe, other, high = (_CLASSES @ count / n).tolist()
    share = count[count > 0] / n
    words = text.split()
    w = max(1, len(words))
    uses: dict[str, int] = {}
    for x in words:
        uses[x] = uses.get(x, 0) + 1
    lines = text.split("\n")
    stops = int(count[46] + count[33] + count[63])
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    same = sum(map(str.__eq__, words[1:], words))
    last = "".join([x[-1] for x in words])
    marked = sum(last.count(c) for c in "%$&#*!|")
    first = "".join([x[0] for x in words])
    return [
        math.log1p(len(data)), math.log1p(len(words)), len(data) / w, math.log1p(int(lengths.max())), len(uses) / w, max(uses.values(), default=0) / w, math.log1p(len(lines)), math.log1p(len(data) / len(lines)), len(set(lines)) / len(lines), math.log1p(stops),
        math.log1p(w / max(1, stops)), upper, digit, space, comma, period, pipe, other, high, float(-(share * np.log2(share)).sum()) if len(share) else 0.0, sum(map(str.isupper, first)) / w, marked / w, same / w, float((lengths <= 2).mean()),
    ]


@dataclass
class Trees:
    """Flattened trees: node arrays, each tree's root, and the score that all start from. A leaf's children are itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float = 0.0
    importance: dict = field(default_factory=dict)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots.tolist():
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out += self.value[node]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 0.5 * np.tanh(0.5 * self.margin(x)) + 0.5


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 1.0, ridge: float = 1.0) -> Trees:
    """Boost the log loss. A split needs ``least`` summed curvature on both sides; ties go to the first feature and lowest bin.

    With one label only, no tree is grown and every score is near that label.
    """
    positive = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    base = math.log(positive / (1 - positive))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    nodes: list[list[float]] = []
    roots, margin = [], np.full(len(y), base)
    gain_of: dict[int, float] = {}
    offset = np.arange(x.shape[1]) * bins
    for _ in range(trees if 0 < y.sum() < len(y) else 0):
        p = 0.5 * np.tanh(0.5 * margin) + 0.5
        grad, curve = y - p, p * (1 - p)
        root = len(nodes)
        roots.append(root)
        nodes.append([0, np.inf, root, root, 0.0])
        todo = [(root, np.arange(len(y)), 0)]
        while todo:
            at, rows, level = todo.pop()
            g, h = grad[rows].sum(), curve[rows].sum()
            best = (1e-6, -1, -1)
            if level < depth and len(rows) > 1:
                flat = (binned[rows] + offset).ravel()
                wide = lambda v: np.bincount(flat, np.repeat(v[rows], x.shape[1]), minlength=bins * x.shape[1]).reshape(x.shape[1], bins).cumsum(axis=1)[:, :-1]  # noqa: B023, E731
                gl, hl = wide(grad), wide(curve)
                gain = np.where((hl >= least) & (h - hl >= least), gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge), 0)
                f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
                if gain[f, b] > best[0] and b < len(edges[f]):
                    best = (float(gain[f, b]), int(f), int(b))
            if best[1] < 0:
                nodes[at][4] = rate * g / (h + ridge)
                margin[rows] += nodes[at][4]
                continue
            f, b = best[1:]
            gain_of[f] = gain_of.get(f, 0.0) + best[0]
            left, right = len(nodes), len(nodes) + 1
            nodes[at] = [f, float(edges[f][b]), left, right, 0.0]
            nodes += [[0, np.inf, left, left, 0.0], [0, np.inf, right, right, 0.0]]
            low = binned[rows, f] <= b
            todo += [(left, rows[low], level + 1), (right, rows[~low], level + 1)]
    a = np.array(nodes or [[0, np.inf, 0, 0, 0.0]])
    whole = lambda i: a[:, i].astype(np.int64)
    return Trees(whole(0), a[:, 1], whole(2), whole(3), a[:, 4], np.array(roots, np.int64), depth, base, {STATISTICS[k] if x.shape[1] == len(STATISTICS) else k: v for k, v in sorted(gain_of.items(), key=lambda i: -i[1])})


def train_quality(documents: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 4, held_fold: int = 2, max_rows: int = 4000, max_chars: int = 20_000, **options) -> Trees:
    """Fit on at most ``max_rows`` labelled rows whose text has at most ``max_chars`` characters, outside the held-out fold."""
    rows = training_rows(documents, labels, label, folds, held_fold, max_rows, max_chars)
    x = np.array([statistics(t) for t, _ in rows]).reshape(-1, len(STATISTICS))
    return fit(x, np.array([y for _, y in rows], np.float64), **options)


def score_quality(df: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1) for every row, over its whole text.

    A null text counts as empty, and an empty text has statistics and a score
    like any other. Rows that repeat an id are each scored; other columns play
    no part; an empty table gives no rows.
    """
    shared = df.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        for batch in sliced(batches, 512):
            x = np.array([statistics(t or "") for t in batch.column(1).to_pylist()]).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(x))], ["doc_id", "score"])

    return keyed_text(df, id_col, text_col).mapInArrow(lean(run), "doc_id long, score double")
