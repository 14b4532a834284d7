"""Main text of pages: a linear-chain conditional random field over leaf blocks, decoded by Viterbi."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from diffspark.llm.html_blocks import Block, blocks
from diffspark.llm.html_training import labelled_pages

TRAINING_PAGES = 500  # bound of the labelled sample
STEPS = 200
RATE = 0.1
PENALTY = 1e-3


@dataclass
class Tagger:
    """Weights of a two-label chain: 1 is main text."""

    names: dict[str, int]
    unary: np.ndarray  # features x 2
    step: np.ndarray  # from label x to label

    def scores(self, page: list[Block]) -> np.ndarray:
        out = np.zeros((len(page), 2))
        for k, block in enumerate(page):
            known = [self.names[f] for f in block.features if f in self.names]
            out[k] = self.unary[known].sum(0)
        return out

    def tag(self, page: list[Block]) -> list[int]:
        """The best label sequence (Viterbi); a tie goes to the lower label."""
        if not page:
            return []
        (a00, a01), (a10, a11) = self.step.tolist()
        rows = self.scores(page).tolist()
        s0, s1 = rows[0]
        back = []
        for u0, u1 in rows[1:]:
            from0, from1 = int(s1 + a10 > s0 + a00), int(s1 + a11 > s0 + a01)
            back.append((from0, from1))
            s0, s1 = max(s0 + a00, s1 + a10) + u0, max(s0 + a01, s1 + a11) + u1
        label = int(s1 > s0)
        labels = [label]
        for choice in reversed(back):
            label = choice[label]
            labels.append(label)
        return labels[::-1]


def _aligned(page: list[Block], truth: list[str]) -> list[int]:
    """1 for the blocks whose texts are the article's, in order."""
    wanted = [" ".join(t.split()) for t in truth]
    out, k = [], 0
    for block in page:
        hit = k < len(wanted) and block.text == wanted[k]
        k += hit
        out.append(int(hit))
    return out


def train(pages: list[tuple[str, list[str]]]) -> Tagger:
    """Fit by gradient ascent on the penalised log-likelihood, all pages side by side, padded to the longest."""
    read = [(p, _aligned(p, truth)) for html, truth in pages if (p := blocks(html))]
    names = {f: i for i, f in enumerate(sorted({f for p, _ in read for b in p for f in b.features}))}
    n, length = len(read), max(len(p) for p, _ in read)
    x = np.zeros((n, length, len(names)))
    y = np.zeros((n, length), int)
    live = np.zeros((n, length))
    for k, (page, labels) in enumerate(read):
        for t, block in enumerate(page):
            x[k, t, [names[f] for f in block.features]] = 1
        y[k, : len(labels)] = labels
        live[k, : len(labels)] = 1
    gold = np.eye(2)[y] * live[..., None]
    both = live[:, 1:] * live[:, :-1]
    gold_step = np.einsum("nta,ntb,nt->ab", gold[:, :-1], gold[:, 1:], both)
    flat = x.reshape(-1, len(names))
    weights = [np.zeros((len(names), 2)), np.zeros((2, 2))]
    slow = [[np.zeros_like(w), np.zeros_like(w)] for w in weights]

    for turn in range(1, STEPS + 1):
        unary, step = weights
        u = (flat @ unary).reshape(n, length, 2)
        ahead, behind = np.zeros((n, length, 2)), np.zeros((n, length, 2))
        ahead[:, 0] = u[:, 0]
        for t in range(1, length):
            new = u[:, t] + np.logaddexp.reduce(ahead[:, t - 1, :, None] + step, axis=1)
            ahead[:, t] = np.where(live[:, t, None] > 0, new, ahead[:, t - 1])
        total = np.logaddexp.reduce(ahead[:, -1], axis=1)
        for t in range(length - 2, -1, -1):
            new = np.logaddexp.reduce(step + (u[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
            behind[:, t] = np.where(live[:, t + 1, None] > 0, new, 0)
        share = np.exp(ahead + behind - total[:, None, None]) * live[..., None]
        pair = ahead[:, :-1, :, None] + step + (u + behind)[:, 1:, None, :] - total[:, None, None, None]
        pair = np.exp(pair) * both[..., None, None]
        grads = [
            flat.T @ (gold - share).reshape(-1, 2) / n - PENALTY * unary,
            (gold_step - pair.sum((0, 1))) / n - PENALTY * step,
        ]
        for w, g, (m, v) in zip(weights, grads, slow, strict=True):  # Adam
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w += RATE * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
    return Tagger(names, *weights)


@lru_cache(maxsize=1)
def default_tagger() -> Tagger:
    return train(labelled_pages(TRAINING_PAGES))


def main_text(html: str | None, tagger: Tagger) -> str:
    page = blocks(html)
    return "\n".join(b.text for b, label in zip(page, tagger.tag(page), strict=True) if label)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), tagger: Tagger | None = None) -> DataFrame:
    """``(*keep, text)`` of every page, one pass without a shuffle; the text is empty if there is none.

    NULL and empty pages give an empty text; repeated rows stand alone; no rows give no rows; columns not in ``keep`` are not read, so
    only names among ``keep`` and ``text`` could clash.  A page of any length is read as a whole by its task.
    """
    tagger = tagger or default_tagger()

    def run(batches):
        for batch in batches:
            texts = [main_text(h, tagger) for h in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string())], [*keep, "text"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.select(*keep, html_col).mapInArrow(run, "".join(f"`{k}` {kinds[k]}, " for k in keep) + "text string")
