"""BPE encoding and decoding in batched numpy merge rounds.

The symbols of many words lie in one flat array. In every round each word's lowest-rank adjacent pair is
found (ranks come from a binary search over sorted pair keys) and merged in all words at once. Distinct words
are merged once per worker and remembered in a bounded cache.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import regex

from veilspan.llm.common import worker_state

#: Rank of a pair that has no merge.
NONE = np.int32(2**31 - 1)

#: Bound of a worker's cache: entries, and characters of the longest word it keeps.
CACHE_ENTRIES, CACHE_WORD = 120_000, 256

#: Characters of text that are split before their unknown words are merged together.
BATCH_CHARS = 1_000_000

#: Unicode White_Space, as the tokenizers' pattern engine has it; Python's own class also has U+001C to U+001F.
SPACE = "\t-\r \x85\xa0  -     　"


@lru_cache(maxsize=1)
def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1
    characters stand for themselves, the other bytes for U+0100 onwards in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(other)) for b in range(256)]


class MergeTable:
    """A BPE vocabulary from a tokenizer JSON file, with its merges as sorted pair keys."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        vocab = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.specials = {t["content"]: t["id"] for t in whole["added_tokens"]}
        self.size = max([*vocab.values(), *self.specials.values()]) + 1
        self.token = [""] * self.size
        for s, i in [*vocab.items(), *self.specials.items()]:
            self.token[i] = s
        chars = byte_chars()
        self.byte_id = np.array([vocab[c] for c in chars], np.int32)
        self.last_id = np.array([vocab[c + self.suffix] for c in chars], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int32)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int32), made
        # A merge may be applied at every place of a word at once unless a pair with its product ranks before it.
        lowest = np.full(self.size, NONE, np.int32)
        ranks = np.arange(len(merges), dtype=np.int32)
        np.minimum.at(lowest, left, ranks)
        np.minimum.at(lowest, right, ranks)
        self.everywhere = lowest[made] > ranks
        # Ranks of pairs of initial symbols, which are most of all look-ups, as a small square.
        ids = np.unique(np.concatenate([self.byte_id, self.last_id]))
        self.square = int(ids.max()) + 1 if ids.max() < 1024 else 0
        if self.square:
            a, b = np.divmod(np.arange(self.square**2), self.square)
            self.first = self.ranks(a, b)

    def first_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of initial symbols."""
        return self.first[a * self.square + b] if self.square else self.ranks(a, b)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of symbol pairs by binary search over the sorted pair keys; NONE where there is no merge."""
        want = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.rank[at], NONE)

    def symbols(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Initial symbols of non-empty words in one flat array, and where each word starts."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(sizes)
        sym = self.byte_id[flat]
        if len(words):
            sym[ends - 1] = self.last_id[flat[ends - 1]]
        return sym, ends - sizes


def merge_rounds(table: MergeTable, sym: np.ndarray, starts: np.ndarray):
    """Yield (word numbers, symbols, starts) of words as they are finished, until none is left."""
    word = np.arange(len(starts))
    sizes = np.diff(np.append(starts, len(sym)))
    rank = np.full(len(sym), NONE, np.int32)
    if len(sym) > 1:
        inner = np.ones(len(sym) - 1, bool)
        inner[starts[1:] - 1] = False
        at = np.flatnonzero(inner)
        rank[at] = table.first_ranks(sym[at], sym[at + 1])
    while len(word):
        low = np.minimum.reduceat(rank, starts)
        live = low != NONE
        if not live.all():
            keep = np.repeat(live, sizes)
            yield word[~live], sym[~keep], np.cumsum(sizes[~live]) - sizes[~live]
            word, sym, rank, sizes, low = word[live], sym[keep], rank[keep], sizes[live], low[live]
            starts = np.cumsum(sizes) - sizes
            if not len(word):
                return
        owner = np.repeat(np.arange(len(word)), sizes)
        at = np.flatnonzero(rank == low[owner])
        # Pairs that overlap (a run of one symbol) merge from the left: every second one of the run.
        fresh = np.append(True, np.diff(at) > 1)
        run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - run) % 2 == 0]
        first = np.append(True, np.diff(owner[at]) > 0)
        at = at[table.everywhere[low[owner[at]]] | first]
        sym[at] = table.made[rank[at]]
        gone = np.ones(len(sym), bool)
        gone[at + 1] = False
        sizes = sizes - np.bincount(owner[at], minlength=len(word))
        new_at = at - np.arange(len(at))
        sym, rank, owner = sym[gone], rank[gone], owner[gone]
        starts = np.cumsum(sizes) - sizes
        touched = np.concatenate([new_at, new_at[new_at > 0] - 1])
        rank[touched] = NONE
        touched = touched[touched + 1 < len(sym)]
        touched = touched[owner[touched] == owner[touched + 1]]
        rank[touched] = table.ranks(sym[touched], sym[touched + 1])


def merge_words(table: MergeTable, words: list[bytes]) -> list[np.ndarray]:
    """Token ids of each word. Words are merged in groups of about a million symbols to bound memory."""
    out: list[np.ndarray] = [np.empty(0, np.int32)] * len(words)
    at = 0
    while at < len(words):
        end, total = at, 0
        while end < len(words) and (end == at or total + len(words[end]) <= 1_000_000):
            total += len(words[end])
            end += 1
        group = [i for i in range(at, end) if words[i]]
        if group:
            for done, sym, starts in merge_rounds(table, *table.symbols([words[i] for i in group])):
                for i, ids in zip(done.tolist(), np.split(sym, starts[1:]), strict=True):
                    out[group[i]] = ids
        at = end
    return out


class TwoAges:
    """A bounded map of what has been computed: when the young half is full it becomes the old half, and what
    is asked for again moves back, so frequent keys stay."""

    def __init__(self, entries: int = CACHE_ENTRIES):
        self.entries, self.young, self.old = entries, {}, {}

    def missing(self, keys: set) -> set:
        """The keys that must be computed; all others are in ``young`` from now on."""
        if len(self.young) > self.entries:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        out = keys.difference(young)
        if old:
            for k in out.intersection(old):
                young[k] = old[k]
            out.difference_update(young)
        return out

    def forget_long(self, keys) -> None:
        for k in keys:
            if len(k) > CACHE_WORD:
                self.young.pop(k, None)


class WordEncoder:
    """Encoder and decoder of a word-end BPE: NFC, white space dropped, lower case, words of one class.

    Strings of the special tokens inside a text become those tokens, as the tokenizers library has it by
    default; the parts around them are encoded on their own.
    """

    _space = re.compile(f"[{SPACE}]+")
    _odd = re.compile("[\x1c-\x1f]")
    _pieces = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+")

    def __init__(self, path: str):
        self.table = MergeTable(path)
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.table.specials, key=len, reverse=True))) + ")")
        self._runs_known, self._pieces_known = TwoAges(), TwoAges()

    def _runs(self, part: str) -> list[str]:
        """The runs between white space of a normalised text."""
        if not part.isascii():
            part = unicodedata.normalize("NFC", part)
        part = part.replace("Σ", "σ").lower()  # letter by letter: no final sigma
        return [x for x in self._space.split(part) if x] if self._odd.search(part) else part.split()

    def decode(self, ids: np.ndarray) -> str:
        """The tokens with a space between, as a tokenizer without a decoder gives them."""
        token = self.table.token
        return " ".join([token[i] for i in ids.tolist()])

    def _learn(self, runs: set[str]) -> None:
        order = list(runs)
        pieces = [self._pieces.findall(r) for r in order]
        fresh = list(self._pieces_known.missing({p for ps in pieces for p in ps}))
        known = self._pieces_known.young
        for p, ids in zip(fresh, merge_words(self.table, [p.encode("utf-8", "surrogatepass") for p in fresh]), strict=True):
            known[p] = (ids.astype("<u4").tobytes(), self.decode(ids).encode())
        out = self._runs_known.young
        for r, ps in zip(order, pieces, strict=True):
            out[r] = known[ps[0]] if len(ps) == 1 else (b"".join([known[p][0] for p in ps]), b" ".join([known[p][1] for p in ps]))
        self._pieces_known.forget_long(fresh)

    def encode_batch(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """For each text its ids (little-endian unsigned 32-bit) and the decoding of those ids in UTF-8."""
        specials = self.table.specials
        split = []
        for t in texts:
            parts = self._special.split(t) if "<|" in t else [t]
            split.append([specials[p] if i % 2 else self._runs(p) for i, p in enumerate(parts)])
        missing = self._runs_known.missing({r for parts in split for p in parts if isinstance(p, list) for r in p})
        self._learn(missing)
        get = self._runs_known.young.__getitem__
        out = []
        for parts in split:
            ids, said = [], []
            for p in parts:
                if isinstance(p, int):
                    ids.append(np.array([p], "<u4").tobytes())
                    said.append(self.table.token[p].encode())
                elif p:
                    a, b = zip(*map(get, p), strict=True)
                    ids.extend(a)
                    said.extend(b)
            out.append((b"".join(ids), b" ".join(said)))
        self._runs_known.forget_long(missing)
        return out


def word_encoder(path: str) -> WordEncoder:
    """One encoder per worker process and vocabulary."""
    return worker_state(WordEncoder, path)


def text_batches(batch, text: int, size: int = BATCH_CHARS):
    """(first row, texts) of an Arrow batch in pieces of about ``size`` characters; null counts as empty."""
    col = batch.column(text)
    start, chars, texts = 0, 0, []
    for at in range(0, len(col), 64):
        for t in col.slice(at, 64).to_pylist():
            t = t or ""
            texts.append(t)
            chars += len(t)
            if chars >= size:
                yield start, texts
                start, chars, texts = start + len(texts), 0, []
    if texts:
        yield start, texts


def encode_documents(docs, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True):
    """One row per input row: id, n_tokens, ids (array<int>, when ``keep_ids``), ids_sha256, decoded_sha256.

    A null or empty text has no tokens. Each row is encoded on its own, so repeated rows repeat and an empty
    table gives no rows; other columns are not read. ``vocab_path`` must exist on every executor.
    """
    import pyarrow as pa
    from pyspark.sql import functions as F

    def run(batches):
        coder = word_encoder(vocab_path)
        for batch in batches:
            counts, arrays, hashes, said = [], [], [], []
            for _, texts in text_batches(batch, 1):
                for ids, decoded in coder.encode_batch(texts):
                    counts.append(len(ids) // 4)
                    if keep_ids:
                        arrays.append(np.frombuffer(ids, "<u4").astype(np.int32))
                    hashes.append(hashlib.sha256(ids).hexdigest())
                    said.append(hashlib.sha256(decoded).hexdigest())
            cols = [batch.column(0), pa.array(counts, pa.int64())]
            names = ["_id", "n_tokens"]
            if keep_ids:
                cols.append(pa.array(arrays, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays([*cols, pa.array(hashes, pa.string()), pa.array(said, pa.string())], [*names, "ids_sha256", "decoded_sha256"])

    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    schema = f"_id {kind}, n_tokens bigint, {'ids array<int>, ' if keep_ids else ''}ids_sha256 string, decoded_sha256 string"
    out = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, schema)
    return out.withColumnRenamed("_id", id_col)
