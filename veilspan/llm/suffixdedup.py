"""Removal of byte strings that also start in an earlier document, by suffix arrays over shards.

Two equal strings of LENGTH bytes have to meet in one shard. They share the content-chosen anchor of a
window inside them (the least-hashed GRAM bytes), so:

1. Documents fall into blocks by a hash of the row. Each block lists its distinct anchors with their first
   document; lists are exchanged by anchor hash, which tells what anchors occur in several documents and
   which document has them first (the leader).
2. Each block cuts the stretches around its repeated anchors and sends them to the leader's shard. A passage
   copied in one piece travels in one piece. Anchors that many blocks have are first resolved inside the
   block, and beyond FAN blocks in groups of blocks, so a passage that a third of all documents hold reaches
   its last shard a bounded number of times.
3. A shard sorts, with induced sorting, what of its stretches is covered by windows of LENGTH bytes whose hash
   occurs again there (agreements of an anchor alone, which grow with the table, are left out); runs of common
   prefixes of LENGTH or more are the equal strings, and all but those of the smallest id are removed. A shard
   larger than CHUNK bytes is worked through in order of ids against what has been found to be first so far.
4. Removed ranges go back to their blocks and are cut from the texts.

Anchors only route: hashes that collide bring strings together that differ, and the suffix array tells.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm.suffixarray import _words, permuted_lcp, suffix_array

LENGTH, GRAM = 50, 20
#: Bytes: of a block's texts, of what is hashed at once, of a shard, and of what is sorted at once.
BLOCK, PIECE, SHARD, CHUNK = 6 << 20, 1 << 19, 3 << 19, 2 << 20
#: Distinct anchors that one bucket of the exchange aims at; anchors are about one byte in fifteen.
BUCKET, ANCHOR_BYTES = 2_000_000, 15
#: Anchors in more blocks than this (or than half of all blocks) are resolved inside blocks first; groups of
#: blocks above FAN blocks.
HOT_BLOCKS, FAN = 64, 512

_NULL_ID = 2**63 - 1


def find_anchors(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchor positions in concatenated texts and their 64-bit hashes, in order.

    Every string of LENGTH bytes inside one text contains a whole anchor, chosen by its bytes alone.
    """
    n = len(flat) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    w = _words(flat)
    h = w[:n] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h += w[8 : 8 + n]
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h += w[GRAM - 8 : GRAM - 8 + n]
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    order = (h >> np.uint64(32)).astype(np.uint32)
    inside = np.zeros(len(flat) + 1, np.int32)
    whole = sizes >= GRAM
    np.add.at(inside, starts[whole], 1)
    np.add.at(inside, starts[whole] + sizes[whole] - GRAM + 1, -1)
    valid = np.cumsum(inside[:n]) > 0
    order[~valid] = np.iinfo(np.uint32).max
    width = LENGTH - GRAM + 1

    def slide(a, pick):
        span = 1
        while 2 * span <= width:
            a = pick(a[:-span], a[span:])
            span *= 2
        return pick(a[: len(a) - (width - span)], a[width - span :]) if span < width else a

    if n < width:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    edge = np.zeros(width - 1, np.uint32)
    most = slide(np.concatenate([edge, slide(order, np.minimum), edge]), np.maximum)
    at = np.flatnonzero((order == most) & valid)
    # Anchors have small hashes; mixed again, all bits are even.
    h = h[at] * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return at, h * np.uint64(0xBF58476D1CE4E5B9)


def _pieces(texts: list[bytes]):
    """(first text, texts) in runs of about PIECE bytes."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= PIECE:
            yield first, texts[first : i + 1]
            first, size = i + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def _block_anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, position in the text, hash) of all anchors."""
    docs, offs, hashes = [], [], []
    for first, part in _pieces(texts):
        sizes = np.fromiter(map(len, part), np.int64, len(part))
        starts = np.cumsum(sizes) - sizes
        at, h = find_anchors(np.frombuffer(b"".join(part), np.uint8), starts, sizes)
        full = np.flatnonzero(sizes)
        d = full[np.searchsorted(starts[full], at, "right") - 1] if len(at) else at
        docs.append(d + first)
        offs.append(at - starts[d])
        hashes.append(h)
    if not docs:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(docs), np.concatenate(offs), np.concatenate(hashes)


def _bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _recurring(flat: np.ndarray, fits: np.ndarray) -> np.ndarray:
    """Starts among ``fits`` whose window's hash occurs again; equal windows are never told apart.

    A count by some bits of the hash leaves fewer to be sorted by all of it.
    """
    likely = np.zeros(len(flat), bool)
    p = np.flatnonzero(fits)
    if not len(p):
        return likely
    n = len(flat) - LENGTH + 1
    w = _words(flat)
    h = np.zeros(n, np.uint64)
    for off in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        h ^= h >> np.uint64(29)
        h += w[off : off + n]
        h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h = (h * np.uint64(0x94D049BB133111EB))[p]
    bits = int(len(p)).bit_length() + 1
    slot = (h >> np.uint64(64 - bits)).astype(np.int64)
    again = np.bincount(slot, minlength=1 << bits)[slot] > 1
    p, h = p[again], h[again]
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    p = p[order[np.append(same, False) | np.append(False, same)]] if len(p) else p
    likely[p] = True
    return likely


def _covered(starts: np.ndarray) -> np.ndarray:
    """Positions that windows at the marked starts cover."""
    p = np.flatnonzero(starts)
    step = np.zeros(len(starts) + 1, np.int32)
    step[p] += 1
    step[p + LENGTH] -= 1
    return np.flatnonzero(np.cumsum(step[:-1]) > 0)


def resolve(rows: np.ndarray, ids: np.ndarray, begins: np.ndarray, texts: list[bytes], chunk: int = CHUNK, survivors: bool = False):
    """Which windows of stretches also occur in a stretch of a smaller id.

    ``rows``, ``ids``, ``begins`` describe stretches of documents. Returns (stretch number, begin, end) of
    removed ranges in document offsets and, with ``survivors``, (stretch number, begin, end) of what is first.
    """
    order = np.argsort(ids, kind="stable")
    removed: list[np.ndarray] = []
    first: list[tuple[int, int, int]] = []  # stretch, begin and end inside it
    at = 0
    while at < len(order):
        end, size = at, sum(e - b for _, b, e in first)
        room = max(chunk, 2 * size)  # twice what is kept, so that what is kept is not sorted again too often
        while end < len(order) and (end == at or size + len(texts[order[end]]) <= room):
            size += len(texts[order[end]])
            end += 1
        now = [*first, *((int(i), 0, len(texts[i])) for i in order[at:end])]
        last = end == len(order)
        no = np.array([i for i, _, _ in now])
        lo = np.array([b for _, b, _ in now], np.int64)
        sizes = np.array([e - b for _, b, e in now], np.int64)
        flat = np.frombuffer(b"".join([texts[i][b:e] for i, b, e in now]), np.uint8)
        starts = np.cumsum(sizes) - sizes
        seg = np.repeat(np.arange(len(now), dtype=np.int32), sizes)
        fits = np.repeat(starts + sizes - LENGTH, sizes) >= np.arange(len(flat))
        gone = np.zeros(len(flat), bool)
        likely = _recurring(flat, fits)
        covered = _covered(likely)
        if len(covered):
            part, at_part, who = flat[covered], likely[covered], ids[no[seg[covered]]]
            sa = suffix_array(part)
            long = permuted_lcp(part, sa)[sa] >= LENGTH
            heads = np.flatnonzero(~long)
            known = np.where(at_part[sa], who[sa], np.iinfo(np.int64).max)
            least = np.repeat(np.minimum.reduceat(known, heads), np.diff(np.append(heads, len(sa))))
            gone[covered[sa]] = at_part[sa] & (known > least)

        def runs(mark, seg=seg, starts=starts, lo=lo, no=no):
            p = np.flatnonzero(mark)
            if not len(p):
                return np.empty((0, 3), np.int64)
            new = np.append(True, (np.diff(p) > 1) | (np.diff(seg[p]) != 0))
            a, b = p[new], p[np.append(np.flatnonzero(new)[1:], len(p)) - 1]
            s = seg[a]
            return np.stack([no[s], a - starts[s] + lo[s], b - starts[s] + lo[s] + LENGTH], 1)

        removed.append(runs(gone))
        if survivors or not last:
            first = [tuple(map(int, x)) for x in runs(fits & ~gone)]
        at = end
    out = np.concatenate(removed) if removed else np.empty((0, 3), np.int64)
    out[:, 1:] += begins[out[:, :1].ravel()][:, None]
    return out, first


_ROWS = "_kind int, _shard int, _g int, _hot int, _rows binary, _ids binary, _begins binary, _ends binary, _data binary"


def _row(kind, shard, g, hot, rows, ids, begins, ends, data=b""):
    pack = lambda a: np.asarray(a, np.int64).tobytes()
    return (kind, int(shard), int(g), int(hot), pack(rows), pack(ids), pack(begins), pack(ends), data)


def _table(rows):
    import pyarrow as pa

    kinds = [pa.int32()] * 4 + [pa.binary()] * 5
    names = ["_kind", "_shard", "_g", "_hot", "_rows", "_ids", "_begins", "_ends", "_data"]
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def _removed_rows(found, rows, blocks, shards):
    """One row of removed ranges for each block."""
    out = []
    if len(found):
        g = blocks[found[:, 0]]
        order = np.argsort(g, kind="stable")
        cuts = np.flatnonzero(np.diff(g[order])) + 1
        for part in np.split(order, cuts):
            x = found[part]
            out.append(_row(1, g[part[0]] % shards, g[part[0]], 0, rows[x[:, 0]], [], x[:, 1], x[:, 2]))
    return out


def _stretch_rows(shard, hot, g, rows, ids, begins, texts):
    return _row(0, shard, g, hot, rows, ids, begins, np.asarray(begins) + [len(t) for t in texts], b"".join(texts))


def _unpack(table):
    """Stretches of a group's rows: row keys, ids, begins, blocks and bytes."""
    rows, ids, begins, blocks, texts = [], [], [], [], []
    for r in table.to_pylist():
        b, e = np.frombuffer(r["_begins"], np.int64), np.frombuffer(r["_ends"], np.int64)
        rows.append(np.frombuffer(r["_rows"], np.int64))
        ids.append(np.frombuffer(r["_ids"], np.int64))
        begins.append(b)
        blocks.append(np.full(len(b), r["_g"], np.int64))
        ends = np.cumsum(e - b)
        data = r["_data"]
        texts += [data[x:y] for x, y in zip((ends - (e - b)).tolist(), ends.tolist(), strict=True)]
    cat = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
    return cat(rows), cat(ids), cat(begins), cat(blocks), texts


def _live(left, right):
    """Rows of a block in order of ids, without later copies of a whole text."""
    skip = set()
    for r in right.to_pylist():
        if r["_kind"] == 2:
            skip.update(np.frombuffer(r["_rows"], np.int64).tolist())
    k, r = left.column("_k").to_pylist(), left.column("_r").to_pylist()
    order = sorted((i for i in range(len(k)) if r[i] not in skip), key=k.__getitem__)
    text = left.column("_text")
    return np.array([k[i] for i in order], np.int64), np.array([r[i] for i in order], np.int64), [text[i].as_py() for i in order], skip


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Cut every byte covered by a LENGTH-byte string that also starts in a document with a smaller id.

    Texts are UTF-8 bytes, judged as they came in; matches never cross documents. Result: id, n_bytes,
    n_removed, n_spans (maximal removed runs), kept_sha256 and, with ``keep_text``, ``spans``
    (array<struct<start,end>> of removed bytes) and ``kept`` (binary; a cut may split a character).
    A null text is empty. Ids are integers; a null id counts as larger than all others. Rows that share an id
    never remove each other, and identical rows get the same result. An empty table gives no rows.
    """
    import pyarrow as pa

    total = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).collect()[0][0]
    blocks = max(1, math.ceil(total / BLOCK))
    buckets = max(1, math.ceil(total / ANCHOR_BYTES / BUCKET))
    shards = max(8, math.ceil(total / 4 / SHARD))
    busy = min(HOT_BLOCKS, blocks // 2)
    body = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("_k"),
        F.xxhash64(F.lit(11), F.col(id_col), body).alias("_r"),
        body.cast("binary").alias("_text"),
    ).withColumn("_g", F.pmod(F.xxhash64(F.lit(5), "_r"), F.lit(blocks)).cast("int"))

    # Later copies of a whole text are settled by their hashes.
    keyed = base.select("_k", "_r", "_g", F.xxhash64("_text").alias("_h1"), F.xxhash64(F.lit(1), "_text").alias("_h2"), F.octet_length("_text").alias("_n"))
    keyed = keyed.where(F.col("_n") >= LENGTH)
    firsts = keyed.groupBy("_h1", "_h2", "_n").agg(F.min("_k").alias("_m"), F.max("_k").alias("_x")).where("_m < _x").select(F.col("_h1").alias("_f1"), F.col("_h2").alias("_f2"), F.col("_n").alias("_fn"), "_m")
    later = keyed.join(firsts, (F.col("_h1") == F.col("_f1")) & (F.col("_h2") == F.col("_f2")) & (F.col("_n") == F.col("_fn"))).where("_k > _m").select("_r", "_g")

    def pack_copies(batches):
        for b in batches:
            r, g = b.column(0).to_numpy(), b.column(1).to_numpy()
            rows = [_row(2, x % shards, x, 0, r[g == x], [], [], []) for x in np.unique(g)]
            yield from _table(rows).to_batches()

    copies = later.mapInArrow(pack_copies, _ROWS)

    def list_anchors(left, right):
        k, _, texts, _ = _live(left, right)
        d, _, h = _block_anchors(texts)
        order = np.argsort(h, kind="stable")  # texts are in order of ids, so the first of a hash has the smallest
        h, d = h[order], d[order]
        new = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.empty(0, np.int64)
        ends = np.append(new[1:], len(h))
        lowest, several = k[d[new]] if len(new) else new, (k[d[ends - 1]] != k[d[new]] if len(new) else new.astype(bool))
        h = h[new]
        b = _bucket_of(h, buckets)
        g = left.column("_g")[0].as_py() if left.num_rows else 0
        out = []
        for part in np.split(np.arange(len(h)), np.flatnonzero(np.diff(b)) + 1) if len(h) else []:
            ids, index = np.unique(lowest[part], return_inverse=True)
            out.append((int(b[part[0]]), g, h[part].astype(np.uint32).tobytes(), ids.tobytes(), index.astype(np.uint16 if len(ids) < 65536 else np.uint32).tobytes(), several[part].astype(np.uint8).tobytes()))
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["_b", "_g", "_hash", "_ids", "_index", "_several"])

    def find_leaders(table):
        rows = table.to_pylist()
        keys = np.concatenate([np.frombuffer(r["_hash"], np.uint32) for r in rows])
        sizes = np.array([len(r["_hash"]) // 4 for r in rows])
        ids = np.concatenate([np.frombuffer(r["_ids"], np.int64)[np.frombuffer(r["_index"], np.uint16 if len(r["_index"]) < 3 * len(r["_hash"]) // 4 else np.uint32)] for r in rows])
        several = np.concatenate([np.frombuffer(r["_several"], np.uint8) for r in rows])
        order = np.argsort(keys, kind="stable")
        new = np.flatnonzero(np.append(True, np.diff(keys[order]) != 0))
        count = np.diff(np.append(new, len(keys)))
        leader = np.minimum.reduceat(ids[order], new)
        again = (count > 1) | (np.maximum.reduceat(several[order], new) > 0)
        group = np.empty(len(keys), np.int64)
        group[order] = np.repeat(np.arange(len(new)), count)
        take = again[group]
        out = []
        for r, a, e in zip(rows, np.cumsum(sizes) - sizes, np.cumsum(sizes), strict=True):
            mine = np.flatnonzero(take[a:e]) + a
            if len(mine):
                full = keys[mine].astype(np.int64) | np.int64(r["_b"]) << 32
                out.append(_row(3, 0, r["_g"], 0, full, leader[group[mine]], (count[group[mine]] > busy).astype(np.int64), []))
        return _table(out)

    def cut_stretches(left, right):
        k, rows, texts, _ = _live(left, right)
        flags = [r for r in right.to_pylist() if r["_kind"] == 3]
        if not flags or not texts:
            return _table([])
        g = flags[0]["_g"]
        want = np.concatenate([np.frombuffer(r["_rows"], np.int64) for r in flags])
        lead = np.concatenate([np.frombuffer(r["_ids"], np.int64) for r in flags])
        warm = np.concatenate([np.frombuffer(r["_begins"], np.int64) for r in flags])
        order = np.argsort(want)
        want, lead, warm = want[order], lead[order], warm[order]
        d, off, h = _block_anchors(texts)
        full = (_bucket_of(h, buckets).astype(np.int64) << 32) | (h & np.uint64(0xFFFFFFFF)).astype(np.int64)
        at = np.minimum(np.searchsorted(want, full), len(want) - 1)
        hit = want[at] == full
        d, off, lead, warm = d[hit], off[hit], lead[at[hit]], warm[at[hit]]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.lexsort((off, lead, warm, d))
        d, off, lead, warm = d[order], off[order], lead[order], warm[order]
        begin, end = np.maximum(off - (LENGTH - GRAM), 0), np.minimum(off + LENGTH, sizes[d])
        if not len(d):
            return _table([])
        apart = np.append(True, (np.diff(d) != 0) | (np.diff(lead) != 0) | (np.diff(warm) != 0) | (begin[1:] >= end[:-1]))
        a = np.flatnonzero(apart)
        z = np.append(a[1:], len(d)) - 1
        d, lead, warm, begin, end = d[a], lead[a], warm[a], begin[a], end[z]
        wide = end - begin >= LENGTH
        d, lead, warm, begin, end = d[wide], lead[wide], warm[wide], begin[wide], end[wide]
        mixed = (lead.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        shard = (mixed % np.uint64(shards)).astype(np.int64)
        out = []
        cut = [texts[i][b:e] for i, b, e in zip(d.tolist(), begin.tolist(), end.tolist(), strict=True)]
        r, ids = rows[d], k[d]
        hot = np.flatnonzero(warm)
        if len(hot):
            # One sort for all of the block's hot stretches; what is first among them goes on.
            found, first = resolve(r[hot], ids[hot], begin[hot], [cut[i] for i in hot], survivors=True)
            out += _removed_rows(found, r[hot], np.full(len(hot), g, np.int64), shards)
            no = hot[np.array([i for i, _, _ in first], np.int64)]
            cold = np.flatnonzero(warm == 0)
            cut = [cut[i] for i in cold] + [cut[i][x:y] for i, (_, x, y) in zip(no.tolist(), first, strict=True)]
            begin = np.concatenate([begin[cold], begin[no] + np.array([x for _, x, _ in first], np.int64)])
            pick = np.concatenate([cold, no])
            r, ids, shard, warm = r[pick], ids[pick], shard[pick], warm[pick]
        order = np.lexsort((ids, warm, shard))
        for part in np.split(order, np.flatnonzero((np.diff(shard[order]) != 0) | (np.diff(warm[order]) != 0)) + 1):
            if len(part):
                out.append(_stretch_rows(shard[part[0]], int(warm[part[0]]), g, r[part], ids[part], begin[part], [cut[i] for i in part]))
        return _table(out)

    def settle(final):
        def run(table):
            turn = (table.column("_kind").to_numpy() == 0) & (final | (table.column("_hot").to_numpy() == 1))
            kept = table.filter(pa.array(~turn))
            stretches = table.filter(pa.array(turn))
            if not stretches.num_rows:
                return kept.select(_table([]).column_names)
            shard = stretches.column("_shard")[0].as_py()
            r, ids, b, g, texts = _unpack(stretches)
            found, left_over = resolve(r, ids, b, texts, survivors=not final)
            out = _removed_rows(found, r, g, shards)
            if not final and left_over:
                no = np.array([i for i, _, _ in left_over], np.int64)
                lo = np.array([x for _, x, _ in left_over], np.int64)
                cut = [texts[i][x:y] for i, x, y in left_over]
                order = np.argsort(g[no], kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(g[no][order])) + 1):
                    out.append(_stretch_rows(shard, 1, g[no[part[0]]], r[no[part]], ids[no[part]], b[no[part]] + lo[part], [cut[i] for i in part]))
            return pa.concat_tables([kept.select(_table([]).column_names), _table(out)])

        return run

    def cut_texts(left, right):
        ranges: dict[int, list[tuple[int, int]]] = {}
        skip: set[int] = set()
        for r in right.to_pylist():
            keys = np.frombuffer(r["_rows"], np.int64).tolist()
            if r["_kind"] == 2:
                skip.update(keys)
            else:
                for key, a, e in zip(keys, np.frombuffer(r["_begins"], np.int64).tolist(), np.frombuffer(r["_ends"], np.int64).tolist(), strict=True):
                    ranges.setdefault(key, []).append((a, e))
        out = []
        text = left.column("_text")
        for i, (k, r) in enumerate(zip(left.column("_k").to_pylist(), left.column("_r").to_pylist(), strict=True)):
            t = text[i].as_py()
            spans: list[tuple[int, int]] = []
            for a, e in [(0, len(t))] if r in skip else sorted(ranges.get(r, ())):
                if spans and a <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], max(e, spans[-1][1]))
                else:
                    spans.append((a, e))
            keep, at = [], 0
            for a, e in spans:
                keep.append(t[at:a])
                at = e
            keep = b"".join([*keep, t[at:]])
            out.append((None if k == _NULL_ID else k, len(t), len(t) - len(keep), len(spans), hashlib.sha256(keep).hexdigest(), [{"start": a, "end": e} for a, e in spans], keep))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
        names = ["_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
        n = 7 if keep_text else 5
        return pa.table([pa.array([r[j] for r in out], kinds[j]) for j in range(n)], names=names[:n])

    by_block = base.groupBy("_g")
    listed = by_block.cogroup(copies.groupBy("_g")).applyInArrow(list_anchors, "_b int, _g int, _hash binary, _ids binary, _index binary, _several binary")
    leaders = listed.groupBy("_b").applyInArrow(find_leaders, _ROWS)
    work = by_block.cogroup(copies.unionByName(leaders).groupBy("_g")).applyInArrow(cut_stretches, _ROWS)
    if blocks > FAN:
        # What many blocks hold is resolved in groups of blocks; all else passes through.
        groups = math.ceil(blocks / FAN)
        work = work.withColumn("_fold", F.col("_g") % groups).groupBy("_shard", "_fold").applyInArrow(settle(False), _ROWS)
    settled = work.groupBy("_shard").applyInArrow(settle(True), _ROWS)
    schema = "_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", spans array<struct<start:bigint,end:bigint>>, kept binary" if keep_text else "")
    return by_block.cogroup(copies.unionByName(settled).groupBy("_g")).applyInArrow(cut_texts, schema).withColumnRenamed("_id", id_col)
