"""Token counts by rank-synchronous array merging.

Pre-tokens of many texts are held as ragged numpy arrays (one flat symbol array and the starts of its rows).
In each round every row applies its own lowest-rank pair at the same time; what is left of a row when no pair
has a rank is counted. Only counts leave the worker.
"""

from __future__ import annotations

import re

import numpy as np
import regex

from veilspan.llm.bpe import SPACE, MergeTable, TwoAges, merge_rounds, text_batches
from veilspan.llm.common import worker_state


class TokenCounter:
    """Counts the tokens of a byte-level BPE with the library's defaults: strings of special tokens inside a
    text count as one token each.

    A text falls apart into segments (white space and the run after it) whose tokens don't depend on each
    other; the count of each distinct segment is kept in a bounded cache.
    """

    _segments = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
    _pretokens = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")

    def __init__(self, path: str):
        self.table = MergeTable(path)
        self._special = re.compile("|".join(map(re.escape, sorted(self.table.specials, key=len, reverse=True))))
        self._known, self._pre_known = TwoAges(), TwoAges()

    def merge_counts(self, pretokens: list[bytes]) -> np.ndarray:
        """Surviving symbols of each pre-token."""
        out = np.zeros(len(pretokens), np.int64)
        at = 0
        while at < len(pretokens):
            end, total = at, 0
            while end < len(pretokens) and (end == at or total + len(pretokens[end]) <= 1_000_000):
                total += len(pretokens[end])
                end += 1
            for rows, sym, starts in merge_rounds(self.table, *self.table.symbols(pretokens[at:end])):
                out[at + rows] = np.diff(np.append(starts, len(sym)))
            at = end
        return out

    def _learn(self, segments: set[str]) -> None:
        order = list(segments)
        parts = [self._pretokens.findall(s) for s in order]
        fresh = list(self._pre_known.missing({p for ps in parts for p in ps}))
        count = self._pre_known.young
        count.update(zip(fresh, self.merge_counts([p.encode("utf-8", "surrogatepass") for p in fresh]).tolist(), strict=True))
        self._known.young.update({s: count[ps[0]] if len(ps) == 1 else sum([count[p] for p in ps]) for s, ps in zip(order, parts, strict=True)})
        self._pre_known.forget_long(fresh)

    def count_batch(self, texts: list[str]) -> list[int]:
        split, extra = [], []
        for t in texts:
            parts = self._special.split(t) if "<|" in t else [t]
            extra.append(len(parts) - 1)
            split.append([s for p in parts for s in self._segments.findall(p)] if len(parts) > 1 else self._segments.findall(t))
        missing = self._known.missing(set().union(*split))
        self._learn(missing)
        get = self._known.young.__getitem__
        out = [n + sum(map(get, segments)) for n, segments in zip(extra, split, strict=True)]
        self._known.forget_long(missing)
        return out


def token_counter(path: str) -> TokenCounter:
    """One counter per worker process and vocabulary."""
    return worker_state(TokenCounter, path)


def count_tokens(docs, vocab_path: str, limit: int, id_col: str = "doc_id", text_col: str = "text"):
    """One row per input row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A null or empty text has 0 bytes and 0 tokens. Rows are counted on their own, so repeated rows repeat and
    an empty table gives no rows; other columns are not read. ``vocab_path`` must exist on every executor.
    """
    import pyarrow as pa
    from pyspark.sql import functions as F

    def run(batches):
        counter = token_counter(vocab_path)
        for batch in batches:
            counts = [n for _, texts in text_batches(batch, 1) for n in counter.count_batch(texts)]
            size = [len(t.encode("utf-8")) for _, texts in text_batches(batch, 1) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(counts, pa.int64())], ["_id", "n_bytes", "n_tokens"])

    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"_id {kind}, n_bytes bigint, n_tokens bigint")
    return out.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
