"""Substring dedup: difference-cover anchors find repeated passages, whole windows settle them.

A window is ``WINDOW`` consecutive words of one document. Every word that a
window covers goes, if the same window also starts earlier (smaller doc_id,
or the same document further left).

Anchors. Only windows of ``ANCHOR`` words at positions that fall, modulo
``PERIOD``, on the difference cover ``COVER`` are hashed first. Any two
positions have a shift below the period that puts both on the cover, so two
equal windows of ``ANCHOR + PERIOD - 1`` words share an anchor at the same
place within them. A window without an anchor that occurs twice is thus
unique; the others are extended to whole windows, and their 96-bit hashes
decide.

How it runs. Documents are packed into blocks of bounded size, written once.
A block sends every distinct hash once per hash range, whatever the number of
its copies, and gets back one bit per hash; the reply joins the block by its
number. So a passage that stands in a third of all documents costs a hash
range one entry per block, and no text is gathered by content. Blocks work
out again what they sent, which needs no state between the passes.

Defined cases: a null text has no words; documents of fewer words than a
window lose nothing; rows without doc_id count as one document after all
others; repeated rows are one document and get the same result; columns
besides doc_id and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairos.llm.common import materialize, pick

WINDOW = 20
PERIOD, COVER = 13, (0, 1, 3, 9)  # every remainder modulo 13 is a difference of two of these
ANCHOR = WINDOW - PERIOD + 1
BLOCK_BYTES = 8 << 20         # text in a block; a longer document is a block of its own
RANGE_BYTES = 160 << 20       # text per hash range, which makes about eight million anchors
MIN_RANGES = 64
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
NO_ID = np.iinfo(np.int64).max

BLOCKS = "block long, ids binary, sizes binary, body binary"


# ---- blocks -------------------------------------------------------------------------------------------------------

def _pack(number: int, ids: list, texts: list[bytes]) -> dict:
    return {"block": number, "ids": np.array([NO_ID if i is None else i for i in ids], np.int64).tobytes(),
            "sizes": np.array([len(t) for t in texts], np.int64).tobytes(), "body": zlib.compress(b"".join(texts), 1)}


def _unpack(row) -> tuple[np.ndarray, list[bytes]]:
    ends = np.cumsum(np.frombuffer(row["sizes"], np.int64))
    body = zlib.decompress(row["body"])
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    return np.frombuffer(row["ids"], np.int64), [body[s:e] for s, e in zip(starts.tolist(), ends.tolist())]


def to_blocks(docs: DataFrame) -> DataFrame:
    def work(batches):
        part, count = TaskContext.get().partitionId(), 0
        for b in batches:
            ids, texts, size = [], [], 0
            for i, t in zip(b["doc_id"].astype("Int64"), b["text"]):
                raw = (t or "").encode("utf-8", "surrogatepass")
                if texts and size + len(raw) > BLOCK_BYTES:
                    yield pd.DataFrame([_pack(part << 32 | count, ids, texts)])
                    ids, texts, size, count = [], [], 0, count + 1
                ids.append(None if i is pd.NA else int(i))
                texts.append(raw)
                size += len(raw)
            if texts:
                yield pd.DataFrame([_pack(part << 32 | count, ids, texts)])
                count += 1
    return materialize(pick(docs, "doc_id", "text").mapInPandas(work, BLOCKS), "blocks")


# ---- hashes -------------------------------------------------------------------------------------------------------

def word_hashes(words: list[bytes]) -> np.ndarray:
    """Two independent 64-bit hashes per word."""
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(w) for w in words]), np.uint64).reshape(-1, 2)


def run_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` words from each position on."""
    n = len(hashes) - length + 1
    out = np.zeros(max(0, n), np.uint64)
    for k in range(length if n > 0 else 0):
        out = out * MULTIPLIER + hashes[k:k + n]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def anchor_positions(n_words: int) -> np.ndarray:
    at = np.arange(max(0, n_words - ANCHOR + 1)) if n_words >= WINDOW else np.arange(0)
    return at[np.isin(at % PERIOD, COVER)]


def _edges(sorted_hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Where each of the equal ranges of the hash space begins in sorted hashes."""
    step = (1 << 64) // ranges
    return np.searchsorted(sorted_hashes, np.array([r * step for r in range(ranges)], np.uint64)).tolist() + [len(sorted_hashes)]


class Block:
    """A block's documents and what it sends; every pass builds it anew."""

    def __init__(self, row):
        self.ids, self.texts = _unpack(row)
        self.hashes, self.anchors = [], []
        for t in self.texts:
            words = WORD.findall(t)
            h = word_hashes(words) if len(words) >= WINDOW else np.empty((0, 2), np.uint64)
            self.hashes.append(h)
            self.anchors.append(run_hashes(h[:, 0], ANCHOR)[anchor_positions(len(h))])
        every = np.concatenate([np.empty(0, np.uint64), *self.anchors])
        self.sent, self.back, counts = np.unique(every, return_inverse=True, return_counts=True)
        self.local = counts > 1

    def windows(self, elsewhere: np.ndarray) -> None:
        """Windows that hold an anchor seen twice; ``elsewhere``: the replies to ``sent``."""
        twice = (self.local | elsewhere)[self.back]
        parts, at = [], 0
        for d, h in enumerate(self.hashes):
            n = len(self.anchors[d])
            hit = twice[at:at + n]
            at += n
            if not hit.any():
                continue
            marks = np.zeros(len(h) + 1, np.int64)
            marks[anchor_positions(len(h))[hit] + 1] = 1
            upto = np.cumsum(marks)
            start = np.arange(len(h) - WINDOW + 1)
            start = start[upto[start + PERIOD] > upto[start]]
            first, second = run_hashes(h[:, 0], WINDOW)[start], run_hashes(h[:, 1], WINDOW)[start]
            parts.append((first, second.astype(np.uint32), np.full(len(start), self.ids[d]), start, np.full(len(start), d)))
        kinds = (np.uint64, np.uint32, np.int64, np.int64, np.int64)
        cols = [np.concatenate([np.empty(0, k), *[p[i] for p in parts]]).astype(k) for i, k in enumerate(kinds)]
        order = np.lexsort((cols[3], cols[2], cols[1], cols[0]))
        self.first, self.second, self.doc, self.start, self.row = [c[order] for c in cols]
        new = np.ones(len(order), bool)
        new[1:] = (self.first[1:] != self.first[:-1]) | (self.second[1:] != self.second[:-1])
        self.group = np.cumsum(new) - 1
        self.leader = np.flatnonzero(new)

    def removed(self, earlier: np.ndarray) -> list[np.ndarray]:
        """Per document a mark for each word; ``earlier``: the replies to the leaders."""
        lead = self.leader[self.group]
        gone = earlier[self.group] | (self.doc != self.doc[lead]) | (self.start != self.start[lead])
        out = [np.zeros(len(h) + 1, np.int64) for h in self.hashes]
        rows, starts = self.row[gone], self.start[gone]
        order = np.argsort(rows, kind="stable")
        rows, starts = rows[order], starts[order]
        cuts = np.searchsorted(rows, np.arange(len(self.hashes) + 1))
        for d in np.unique(rows):
            s = starts[cuts[d]:cuts[d + 1]]
            np.add.at(out[d], s, 1)
            np.add.at(out[d], s + WINDOW, -1)
        return [np.cumsum(m[:-1]) > 0 for m in out]


def _bits(replies, edges: list[int]) -> np.ndarray:
    """Replies of the hash ranges put together, False where none came."""
    out = np.zeros(edges[-1], bool)
    for reply in replies if replies is not None else ():
        lo, hi = edges[reply["part"]], edges[reply["part"] + 1]
        out[lo:hi] = np.unpackbits(np.frombuffer(reply["bits"], np.uint8), count=hi - lo).astype(bool)
    return out


# ---- passes -------------------------------------------------------------------------------------------------------

MESSAGE = "part int, block long, payload binary"
REPLY = "block long, part int, bits binary"


def _messages(block: int, edges: list[int], payload) -> pd.DataFrame:
    full = [r for r in range(len(edges) - 1) if edges[r] < edges[r + 1]]
    return pd.DataFrame({"part": full, "block": block, "payload": [payload(edges[r], edges[r + 1]) for r in full]}).astype(
        {"part": "int32", "block": "int64"})


def _answer(messages: DataFrame, ranges: int, judge) -> DataFrame:
    """Every hash range's messages together; ``judge`` gives a mark per hash, sent back per message if any is set."""
    def work(batches):
        part, held = None, []

        def settle():
            marks = judge([p for _, p in held])
            for (block, _), m in zip(held, marks):
                if m.any():
                    yield {"block": block, "part": part, "bits": np.packbits(m).tobytes()}
        for b in batches:
            out = []
            for p, block, payload in zip(b["part"], b["block"], b["payload"]):
                if p != part and held:
                    out += settle()
                    held = []
                part = p
                held.append((block, payload))
            if out:
                yield pd.DataFrame(out).astype({"part": "int32"})
        out = list(settle()) if held else []
        if out:
            yield pd.DataFrame(out).astype({"part": "int32"})
    dealt = messages.repartition(ranges, "part").sortWithinPartitions("part")
    replies = dealt.mapInPandas(work, REPLY)
    # a block's replies are bounded by the block: a bit for each hash it sent
    return materialize(replies.groupBy("block").agg(F.collect_list(F.struct("part", "bits")).alias("replies")), "replies")


def _cut(sizes: list[int], marks: np.ndarray) -> list[np.ndarray]:
    return np.split(marks, np.cumsum(sizes)[:-1])


def _judge_anchors(payloads: list[bytes]) -> list[np.ndarray]:
    sizes = [len(p) // 5 for p in payloads]
    keys = np.concatenate([np.frombuffer(p, np.uint32, n).astype(np.uint64) | np.frombuffer(p, np.uint8, n, 4 * n).astype(np.uint64) << np.uint64(32)
                           for p, n in zip(payloads, sizes)])
    _, back, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return _cut(sizes, counts[back] > 1)


ENTRY = np.dtype([("first", "<u8"), ("second", "<u4"), ("doc", "<i8"), ("start", "<i4")])


def _judge_windows(payloads: list[bytes]) -> list[np.ndarray]:
    sizes = [len(p) // ENTRY.itemsize for p in payloads]
    cols = [np.concatenate([_column(p, n, c) for p, n in zip(payloads, sizes)]) for c in ENTRY.names]
    first, second, doc, start = cols
    order = np.lexsort((start, doc, second, first))
    new = np.ones(len(order), bool)
    f, s = first[order], second[order]
    new[1:] = (f[1:] != f[:-1]) | (s[1:] != s[:-1])
    lead = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    later = np.empty(len(order), bool)
    later[order] = (doc[order] != doc[lead]) | (start[order] != start[lead])
    return _cut(sizes, later)


def _column(payload: bytes, n: int, name: str) -> np.ndarray:
    """Column of a payload that holds one column of ENTRY after the other."""
    at = n * sum(ENTRY[c].itemsize for c in ENTRY.names[:ENTRY.names.index(name)])
    return np.frombuffer(payload, ENTRY[name], n, at)


def dedup(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256`` of the kept words joined by one space.

    With ``with_text`` also ``removed`` (runs of removed words, first and
    end) and ``kept`` (that text).
    """
    size = pick(docs, "text").agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ranges = max(MIN_RANGES, -(-size // RANGE_BYTES))
    blocks = to_blocks(docs)

    def send_anchors(batches):
        for b in batches:
            for row in b.to_dict("records"):
                block = Block(row)
                low = block.sent
                yield _messages(row["block"], _edges(block.sent, ranges), lambda lo, hi: low[lo:hi].astype(np.uint32).tobytes()
                                + (low[lo:hi] >> np.uint64(32)).astype(np.uint8).tobytes())
    seen = _answer(blocks.mapInPandas(send_anchors, MESSAGE), ranges, _judge_anchors)

    def send_windows(batches):
        for b in batches:
            for row in b.to_dict("records"):
                block = Block(row)
                block.windows(_bits(row["replies"], _edges(block.sent, ranges)))
                at = block.leader
                cols = (block.first[at], block.second[at], block.doc[at], block.start[at].astype(np.int32))
                yield _messages(row["block"], _edges(cols[0], ranges), lambda lo, hi: b"".join(c[lo:hi].tobytes() for c in cols))
    asked = blocks.join(seen, "block", "left")
    earlier = _answer(asked.mapInPandas(send_windows, MESSAGE), ranges, _judge_windows)

    def finish(batches):
        for b in batches:
            for row in b.to_dict("records"):
                block = Block(row)
                block.windows(_bits(row["replies"], _edges(block.sent, ranges)))
                gone = block.removed(_bits(row["earlier"], _edges(block.first[block.leader], ranges)))
                out = []
                for i, text, g in zip(block.ids, block.texts, gone):
                    words = WORD.findall(text)
                    if g.any():
                        kept = b" ".join([words[k] for k in np.flatnonzero(~g)])
                        turn = np.flatnonzero(np.diff(np.concatenate(([0], g, [0]))))
                    else:
                        kept, turn = b" ".join(words), ()
                    r = [None if i == NO_ID else int(i), len(words), int(g.sum()), hashlib.sha256(kept).hexdigest()]
                    if with_text:
                        r += [[dict(first=int(s), end=int(e)) for s, e in zip(turn[::2], turn[1::2])], kept.decode("utf-8", "surrogatepass")]
                    out.append(r)
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + (["removed", "kept"] if with_text else [])
                yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})
    settled = blocks.join(seen, "block", "left").join(earlier.withColumnRenamed("replies", "earlier"), "block", "left")
    return settled.mapInPandas(finish, "doc_id long, n_words long, n_removed long, kept_sha256 string"
                               + (", removed array<struct<first:long,end:long>>, kept string" if with_text else ""))
