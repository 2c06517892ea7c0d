"""Token models: windows over a text's tokens, one inference per distinct window, labels decoded to spans.

A model is two functions, one from a text to token ids and offsets and one from windows of ids to a row of logits per
token. Anything that computes those fits; the functions travel to the workers with the plan.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspan.functions.spans import SPANS
from veilspan.operators.shapes import check_coverage
from veilspan.operators.windows import SEPARATOR_LABELS, decode_tags, stitch

FOUND = T.StructType([T.StructField("spans", SPANS), T.StructField("failed", T.BooleanType())])


@dataclass(frozen=True)
class TokenModel:
    """``encode`` gives the ids and (start, end) offsets of a whole text, without special tokens. ``infer`` gives
    logits[window, token, label] of windows of equal length. ``names`` are the labels by number, ``labels`` the entity
    types of those that count. ``frame`` holds the ids put before and after each window."""

    encode: Callable[[str], tuple[Sequence[int], Sequence[tuple[int, int]]]]
    infer: Callable[[np.ndarray], np.ndarray]
    names: Sequence[str]
    labels: Mapping[str, str]
    window: int = 1024
    overlap: int = 128
    threshold: float = 0.5
    frame: tuple[Sequence[int], Sequence[int]] = ((), ())
    batch: int = 16
    source: str = "model"
    separators: frozenset[str] = field(default=SEPARATOR_LABELS)

    def __post_init__(self) -> None:
        if not 0 <= self.overlap < self.window:
            raise ValueError("the overlap must be smaller than the window")


def best_labels(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(label number, softmax probability) of the likeliest label of each token."""
    shifted = logits - logits.max(axis=-1, keepdims=True)
    # The likeliest label has the exponent 0, so its probability is one over the sum.
    return shifted.argmax(axis=-1), 1.0 / np.exp(shifted).sum(axis=-1)


def ranges(count: int, window: int, overlap: int) -> list[tuple[int, int]]:
    """Windows over ``count`` tokens that leave none out."""
    step = window - overlap
    return [(i, min(i + window, count)) for i in range(0, max(count - overlap, 1), step)] if count else []


def infer_windows(model: TokenModel, windows: Sequence[tuple[int, ...]], known: dict) -> list[tuple[np.ndarray, np.ndarray]]:
    """Labels and scores of each window. Equal windows are inferred once as long as ``known`` lives; those of a length
    go together in batches."""
    before, after = (list(x) for x in model.frame)
    by_length: dict[int, list[tuple[int, ...]]] = {}
    for w in dict.fromkeys(windows):
        if w not in known:
            by_length.setdefault(len(w), []).append(w)
    for length, group in by_length.items():
        for i in range(0, len(group), model.batch):
            part = group[i : i + model.batch]
            logits = np.asarray(model.infer(np.array([[*before, *w, *after] for w in part], np.int64)))
            if logits.shape[:2] != (len(part), length + len(before) + len(after)):
                raise RuntimeError("a model must label every token of every window")
            numbers, scores = best_labels(logits[:, len(before) : len(before) + length])
            known.update(zip(part, zip(numbers, scores, strict=True), strict=True))
    return [known[w] for w in windows]


def text_spans(model: TokenModel, text: str | None, known: dict | None = None) -> list[dict]:
    """Spans of one whole text. Tokens that leave text out, or offsets that don't fit the ids, are refused."""
    if not text:
        return []
    ids, offsets = model.encode(text)
    if len(ids) != len(offsets):
        raise RuntimeError("a model must give one offset per token")
    check_coverage([o for o in offsets if o[0] != o[1]], text)
    cuts = ranges(len(ids), model.window, model.overlap)
    found = infer_windows(model, [tuple(int(x) for x in ids[a:z]) for a, z in cuts], {} if known is None else known)
    parts = []
    for (a, z), (numbers, scores) in zip(cuts, found, strict=True):
        # A token of no characters is a special one and carries no label.
        at = [i for i in range(z - a) if offsets[a + i][0] != offsets[a + i][1]]
        name = lambda n: model.names[n] if n < len(model.names) else "O"
        parts.append(([name(int(numbers[i])) for i in at], [float(scores[i]) for i in at], [tuple(offsets[a + i]) for i in at]))
    decoded = decode_tags(*stitch(parts, model.overlap), text, model.separators)
    return [
        {"entity_type": model.labels[kind], "text": text[a:z], "start": a, "end": z, "score": score, "source": model.source}
        for kind, a, z, score in decoded if kind in model.labels and score >= model.threshold
    ]


def with_model(df: DataFrame, model: TokenModel, text_col: str = "text", out: str = "model_spans", failed: str = "model_failed") -> DataFrame:
    """``df`` with a model's spans of each text, and whether the model failed on it (then there are no spans).

    Null and empty texts have none. A text is read whole, window by window; windows that repeat within an Arrow batch
    are inferred once, so what is remembered is bounded by the batch.
    """

    @F.pandas_udf(FOUND)
    def run(text: pd.Series) -> pd.DataFrame:
        known: dict = {}
        spans, fails = [], []
        for t in text:
            try:
                spans.append(text_spans(model, t, known))
                fails.append(False)
            except Exception:  # noqa: BLE001 - a model's own errors may quote the text, so only the fact is kept
                spans.append([])
                fails.append(True)
        return pd.DataFrame({"spans": pd.Series(spans, dtype=object), "failed": fails})

    names = [F.col(f"`{c}`") for c in df.columns]
    found = df.select(*names, F.explode(F.array(run(F.col(f"`{text_col}`")))).alias("_found"))
    return found.select(*names, F.col("_found.spans").alias(out), F.col("_found.failed").alias(failed))


def pipeline_spans(results: Sequence[Mapping], text: str, labels: Mapping[str, str], threshold: float = 0.5, source: str = "model") -> list[dict]:
    """Spans of a model pipeline's own results: ``entity_group``, ``entity`` or ``label``, ``score``, ``start``, ``end``.
    A B-, I-, E- or S- before a label is no part of it; unknown labels, low scores and empty or unfit places go."""
    out = []
    for r in results:
        said = str(r.get("entity_group") or r.get("entity") or r.get("label") or "")
        kind = said if said in labels else said[2:] if said[1:2] == "-" else said
        a, z, score = r.get("start"), r.get("end"), float(r.get("score", 0.0))
        if kind in labels and score >= threshold and a is not None and z is not None and 0 <= a < z <= len(text):
            out.append({"entity_type": labels[kind], "text": text[a:z], "start": int(a), "end": int(z), "score": score, "source": source})
    return out
