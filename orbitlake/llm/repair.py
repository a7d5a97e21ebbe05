"""Token ids in a Re-Pair grammar (operator 7).

Texts become ids of a public byte-level BPE vocabulary (a file; its path is a parameter).
A shard gathers documents of one partition until it holds ``SHARD_TOKENS`` ids. In each
round the pairs of neighbouring symbols within documents are counted. Those that occur at
least as often as the round's limit are taken if every symbol of them only ends or only
begins pairs (a symbol does what its pairs weigh more for), so they can be replaced side by
side, left to right. The limit starts at a share of the highest count, falls when a round
finds few pairs, and ends at ``LEAST``: the grammar is complete when no pair is left twice.
Places whose pair occurs once are not counted again until one of their symbols is replaced.

Rules of the shard are stored as pairs of symbols, with each rule's expansion length, so
``decode`` can enter a document at any position: it finds the symbol that covers the
position by the running sum of lengths and descends only into it.

Rows: ``kind`` ``rules`` (one a shard; ``n_ids`` is the number of rules, ``symbols`` the
pairs, ``lengths`` the expansion lengths) and ``document`` (``n_ids`` ids, ``symbols`` the
shard's encoding of them). Symbols take ``width`` bits each and lengths ``length_width``,
lowest bit first; terminals come first, nonterminals are numbered from ``base``.

Tokenising splits texts in pieces before white space that follows something else; the
vocabulary's pattern never joins across such a place, so each distinct piece is tokenised
once a worker and looked up afterwards. Pieces after Unicode spaces beyond ASCII aren't split.
The vocabulary's file must be readable under its path by every worker.

Cases: a null text gives null ``n_ids`` and ``symbols``; an empty text 0 ids; a null
``doc_id`` stays null; special tokens' strings are ordinary text; repeated rows are encoded
each; of symbols that begin as often as they end pairs (a tie) half, by a hash, do either;
a document longer than a shard is a shard; a partition without rows, and an empty table,
give no rows; columns other than ``doc_id`` and ``text`` aren't read, whatever their names.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import kind, pick, thrifty
from .text import SPACE, Column, prefix_hash, span_hash

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHARD_TOKENS = 1 << 21
LEAST = 2
DROP = 16  # the limit falls by this factor …
FEW = 0.03  # … when a round adds less than this share of the rules
_SLOTS = 1 << 20
_CACHE = 600_000
_CHUNK = 1 << 22


@lru_cache(maxsize=2)
def encoder(path: str) -> tuple[tiktoken.Encoding, int]:
    """The vocabulary and its number of ids."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 1


_pieces: dict[str, dict[bytes, bytes]] = {}
_wide = {b"\xc2\x85", b"\xc2\xa0"}, {b"\xe1\x9a\x80", *(b"\xe2\x80" + bytes([c]) for c in [*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF]), b"\xe2\x81\x9f", b"\xe3\x80\x80"}


def _starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the pieces: row starts, and ASCII white space after anything but white space."""
    space = SPACE[data]
    cut = np.zeros(len(data), bool)
    cut[1:] = space[1:] & ~space[:-1]
    at = np.flatnonzero(cut)
    high = at[data[at - 1] >= 0x80]
    for i in high.tolist() if len(high) < 64 else high[np.isin(data[high - 1], _LAST)].tolist():
        if data[i - 2 : i].tobytes() in _wide[0] or data[max(i - 3, 0) : i].tobytes() in _wide[1]:
            cut[i] = False
    first = offsets[:-1][np.diff(offsets) > 0]
    cut[first] = True
    return np.flatnonzero(cut)


_LAST = np.array(sorted({x[-1] for s in _wide for x in s}), np.uint8)


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct value, and which of them each is; any place will do, so the sort needn't be stable."""
    order = np.argsort(h)
    ranked = h[order]
    new = np.ones(len(h), bool)
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    which = np.empty(len(h), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which


def tokenize(data: np.ndarray, offsets: np.ndarray, path: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows end to end, and the number of ids of each row."""
    enc, _ = encoder(path)
    known = _pieces.setdefault(path, {})
    start = _starts(data, offsets)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    end = np.append(start[1:], len(data))
    h = span_hash(prefix_hash(data), start, end)
    first, which = _distinct(h)
    if len(known) > _CACHE:
        known.clear()
    raw, spell = data.tobytes(), []
    for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True):
        piece = raw[a:b]
        ids = known.get(piece)
        if ids is None:
            ids = known[piece] = array("i", enc.encode_ordinary(piece.decode("utf-8", "replace"))).tobytes()
        spell.append(ids)
    size = np.fromiter(map(len, spell), np.int64, len(spell)) >> 2
    table = np.frombuffer(b"".join(spell), np.int32)
    begin = np.cumsum(size) - size
    n = size[which]
    total = np.cumsum(n)
    at = np.arange(int(total[-1])) + np.repeat(begin[which] - (total - n), n)
    return table.take(at).astype(np.int64), np.diff(np.append(0, total)[np.searchsorted(start, offsets)])


def _slot(a: np.ndarray, b: np.ndarray, turn: int) -> np.ndarray:
    """Slots of pairs, others each round: pairs that share one seldom do so again."""
    a = a + np.uint32(turn * 0x27D4EB2F & 0xFFFFFFFF)
    slot = a * np.uint32(0x9E3779B1) ^ b * np.uint32(0x85EBCA77)
    slot ^= slot >> np.uint32(15)
    return slot & np.uint32(_SLOTS - 1)


def _split(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (code >> np.uint64(32)).astype(np.uint32), code.astype(np.uint32)


def _choose(pairs: np.ndarray, count: np.ndarray, size: int, turn: int) -> np.ndarray:
    """Those of the frequent pairs that can't overlap each other, one at least; each has its own slot."""
    x, y = _split(pairs)
    twin = x == y
    begins, ends = (np.bincount(s[~twin], weights=count[~twin], minlength=size) for s in (x, y))
    coin = ((np.arange(size, dtype=np.uint32) + np.uint32(turn * 7_919)) * np.uint32(0x9E3779B1) >> np.uint32(16)) & np.uint32(1)
    role = np.where((begins > ends) | ((begins == ends) & (coin == 1)), 1, 2)
    t = x[twin]
    role[t[count[twin] >= np.maximum(begins[t], ends[t])]] = 3
    top = int(count.argmax())
    role[y[top]], role[x[top]] = (3, 3) if twin[top] else (2, 1)
    chosen = pairs[np.where(twin, role[x] == 3, (role[x] == 1) & (role[y] == 2))]
    _, own = np.unique(_slot(*_split(chosen), turn), return_index=True)
    return chosen[np.sort(own)]


def compress(ids: np.ndarray, counts: np.ndarray, base: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols end to end, symbols per row, rule pairs (n, 2)). Pairs never cross rows."""
    seq = ids.astype(np.uint32)
    last = np.zeros(len(seq), bool)
    last[np.cumsum(counts[counts > 0]) - 1] = True
    live = ~last  # places that begin a pair which may occur again
    rare = np.zeros(len(seq), bool)  # … but less often than the limit: a pair's places come at once and only get fewer, so these wait until it falls
    made: list[np.ndarray] = []
    n_rules, limit, turn = 0, 0, 0
    while live.any():
        turn += 1
        at = np.flatnonzero(live & ~rare)
        a, b = seq.take(at, mode="clip"), seq.take(at + 1, mode="clip")
        slot = _slot(a, b, turn).astype(np.intp)  # once, for all that it indexes
        in_slot = np.bincount(slot, minlength=_SLOTS).astype(np.int32)
        limit = limit or max(int(in_slot.max()) // DROP, least)
        in_slot = in_slot.take(slot, mode="clip")  # in range by their mask: clip goes without a copy
        live[at[in_slot < least]] = False
        often = in_slot >= limit
        rare[at[~often]] = True
        often = np.flatnonzero(often)
        code = a[often].astype(np.uint64) << np.uint64(32) | b[often]
        pairs, count = np.unique(code, return_counts=True)
        pairs, count = pairs[count >= limit], count[count >= limit]
        if not len(pairs):
            if limit <= least:
                break
            limit = max(limit // DROP, least)
            rare[:] = False
            continue
        chosen = _choose(pairs, count, base + n_rules, turn)
        table = np.full(_SLOTS, -1, np.int32)
        table[_slot(*_split(chosen), turn)] = np.arange(len(chosen), dtype=np.int32)
        which = table.take(slot.take(often, mode="clip"), mode="clip")
        hit = np.flatnonzero(which >= 0)
        hit = hit[chosen[which[hit]] == code[hit]]
        place, which = at[often[hit]], which[hit]
        twin = np.flatnonzero(seq[place] == seq[place + 1])
        if len(twin):  # in runs of one id only every other place begins a pair
            t = place[twin]
            head = np.ones(len(t), bool)
            head[1:] = t[1:] != t[:-1] + 1
            run = np.maximum.accumulate(np.where(head, np.arange(len(t)), 0))
            keep = np.ones(len(place), bool)
            keep[twin[(np.arange(len(t)) - run) % 2 == 1]] = False
            place, which = place[keep], which[keep]
        seq[place] = (base + n_rules + which).astype(np.uint32)
        last[place] = last[place + 1]
        before = place[place > 0] - 1
        live[place], live[before] = ~last[place], ~last[before]
        rare[place] = rare[before] = False
        stay = np.ones(len(seq), bool)
        stay[place + 1] = False
        stay = np.flatnonzero(stay)
        seq, last, live, rare = (x.take(stay, mode="clip") for x in (seq, last, live, rare))
        made.append(chosen)
        n_rules += len(chosen)
        if len(chosen) < FEW * n_rules:
            limit = max(limit // DROP, least)
            rare[:] = False
    per = np.zeros(len(counts), np.int64)
    per[counts > 0] = np.diff(np.append(-1, np.flatnonzero(last)))
    x, y = _split(np.concatenate(made) if made else np.zeros(0, np.uint64))
    return seq.astype(np.int64), per, np.stack([x, y], axis=1).astype(np.int64)


def expansion_lengths(pairs: np.ndarray, base: int) -> np.ndarray:
    """Ids that each rule expands to; a rule only names earlier ones."""
    out = np.zeros(len(pairs), np.int64)
    inner = pairs >= base
    todo = np.arange(len(pairs))
    while len(todo):  # rules whose parts are known, level by level
        parts = np.where(inner[todo], out[np.where(inner[todo], pairs[todo] - base, 0)], 1)
        known = (parts > 0).all(1)
        out[todo[known]] = parts[known].sum(1)
        todo = todo[~known]
    return out


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """One byte (0 or 1) for each of the lowest ``width`` bits of each value, lowest first."""
    return np.unpackbits(values.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width].ravel()


def unpack(raw: bytes, width: int) -> np.ndarray:
    """The values of ``width`` bits (8 at least) that ``raw`` holds."""
    bits = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")
    n = len(bits) // width
    return bits[: n * width].reshape(n, width) @ (1 << np.arange(width, dtype=np.int64))


def decode(symbols: np.ndarray, pairs: np.ndarray, lengths: np.ndarray, base: int, start: int = 0, count: int | None = None) -> list[int]:
    """``count`` ids of a document from position ``start`` on (default: to its end), expanding only what they need."""
    symbols = symbols.astype(np.int64)
    size = np.ones(len(symbols), np.int64)
    inner = symbols >= base
    size[inner] = lengths[symbols[inner] - base]
    ends = np.cumsum(size)
    stop = int(ends[-1]) if len(ends) else 0
    stop = stop if count is None else min(stop, start + count)
    if start >= stop:
        return []
    i = int(np.searchsorted(ends, start, side="right"))
    j = int(np.searchsorted(ends, stop, side="left"))
    skip = start - int(ends[i] - size[i])
    out: list[int] = []
    stack = symbols[i : j + 1][::-1].tolist()
    while stack and len(out) < stop - start:
        s = stack.pop()
        n = int(lengths[s - base]) if s >= base else 1
        if skip >= n:
            skip -= n
        elif s < base:
            out.append(s)
        else:
            stack += [int(pairs[s - base, 1]), int(pairs[s - base, 0])]
    return out


def encode_documents(docs: DataFrame, path: str = VOCABULARY, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The encoded shards of ``docs(doc_id, text)``."""
    id_type = kind(docs, "doc_id")
    names = ["shard", "kind", "doc_id", "n_ids", "base", "width", "length_width", "symbols", "lengths"]

    def shard(name: str, ids: pa.Array, valid: np.ndarray, tokens: list[np.ndarray], counts: np.ndarray, base: int) -> Iterator[pa.RecordBatch]:
        flat = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
        symbols, per, pairs = compress(flat, counts, base)
        lengths = expansion_lengths(pairs, base)
        width = max(8, (base + len(pairs) - 1).bit_length())
        length_width = max(8, int(lengths.max(initial=0)).bit_length())
        bits = pack_bits(symbols, width)
        ends = np.cumsum(per) * width
        packed = [np.packbits(bits[e - p : e], bitorder="little").tobytes() if ok else None for e, p, ok in zip(ends.tolist(), (per * width).tolist(), valid.tolist(), strict=True)]
        rules, sizes = (np.packbits(pack_bits(v, w), bitorder="little").tobytes() for v, w in ((pairs.ravel(), width), (lengths, length_width)))
        n = len(ids) + 1
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([name] * n),
                pa.array(["rules"] + ["document"] * (n - 1)),
                pa.concat_arrays([pa.nulls(1, ids.type), ids]),
                pa.array(np.append(len(pairs), counts), mask=np.append(False, ~valid)),
                pa.array(np.full(n, base, np.int32)),
                pa.array(np.full(n, width, np.int32)),
                pa.array(np.full(n, length_width, np.int32)),
                pa.array([rules, *packed], pa.binary()),
                pa.array([sizes, *[None] * (n - 1)], pa.binary()),
            ],
            names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        base = encoder(path)[1]
        ids, valid, tokens, counts, held = [], [], [], [], 0
        for batch in batches:
            col = Column(batch.column(1))
            for lo, hi, data, off in col.chunks(min(_CHUNK, 2 * shard_tokens)):
                t, n = tokenize(data, off, path)
                ids.append(batch.column(0).slice(lo, hi - lo))
                valid.append(col.valid[lo:hi])
                tokens.append(t)
                counts.append(n)
                held += len(t)
                if held >= shard_tokens:
                    yield from shard(f"{part}-{made}", pa.concat_arrays(ids), np.concatenate(valid), tokens, np.concatenate(counts), base)
                    made += 1
                    ids, valid, tokens, counts, held = [], [], [], [], 0
        if ids:
            yield from shard(f"{part}-{made}", pa.concat_arrays(ids), np.concatenate(valid), tokens, np.concatenate(counts), base)

    schema = f"shard string, kind string, doc_id {id_type}, n_ids bigint, base int, width int, length_width int, symbols binary, lengths binary"
    return pick(docs, "doc_id", "text").mapInArrow(thrifty(run), schema)


def decode_documents(encoded: DataFrame, start: int = 0, count: int | None = None) -> DataFrame:
    """``(doc_id, ids)``: ids ``start`` to ``start + count`` of every document; null for a null text. A group is one shard."""
    id_type = kind(encoded, "doc_id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rules = pdf[pdf["kind"] == "rules"].iloc[0]
        width = int(rules["width"])
        pairs, lengths = unpack(rules["symbols"], width).reshape(-1, 2), unpack(rules["lengths"], int(rules["length_width"]))
        docs = pdf[pdf["kind"] == "document"]
        ids = [None if s is None else decode(unpack(s, width), pairs, lengths, int(rules["base"]), start, count) for s in docs["symbols"]]
        return pd.DataFrame({"doc_id": docs["doc_id"], "ids": pd.Series(ids, index=docs.index, dtype=object)})

    return encoded.groupBy("shard").applyInPandas(run, f"doc_id {id_type}, ids array<int>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
