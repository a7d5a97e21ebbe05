"""Secret scans over a trigram inverted index (operator 1).

Each rule's regular expression is turned into a Boolean query of byte trigrams that any
match must hold (ASCII letters folded, so the query also serves case-insensitive rules).
Documents are indexed in segments of bounded size inside the scan itself: a segment holds
the sorted postings of every trigram that occurs in some rule's query (no other posting
can be asked for). A rule's candidates are the intersections and unions of postings its
query names; only they are verified with the regular expression. A rule without mandatory
trigrams has no query and scans every document. Segments never leave their task, so
nothing is shuffled.

One row per match: ``(doc_id, rule, start, n_chars, secret_sha256)``, ``start`` counted in
characters from 0. The secret itself isn't copied.

Cases: null and empty texts have no match; a null ``doc_id`` is reported as null; repeated
rows are reported each; matches of one rule don't overlap (the leftmost wins, then the
first alternative), matches of several rules may; a text longer than a segment is a segment
of its own and is scanned whole; an empty table gives an empty table; columns other than
``doc_id`` and ``text`` aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import re._constants as rc
import re._parser as rp
from collections.abc import Iterator, Mapping
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import kind, pick, thrifty
from .text import Column, _lower

#: name: (pattern valid for Python and RE2 alike, case-insensitive). Character classes are ASCII.
RULES: dict[str, tuple[str, bool]] = {
    "aws_access_key": (r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", False),
    "assigned_token": (
        r"(?:api_?key|secret|token|password|passwd)[\"']?[ \t]*[:=][ \t]*"
        r"(?:\"[^\"\n]{8,}\"|'[^'\n]{8,}'|[A-Za-z_./+-]*[0-9][A-Za-z0-9_./+=-]{7,})",
        True,
    ),
    "github_token": (r"\bgh[pousr]_[A-Za-z0-9]{36}\b", False),
    "slack_token": (r"\bxox[baprs]-[A-Za-z0-9-]{10,}", False),
    "google_api_key": (r"\bAIza[0-9A-Za-z_-]{35}", False),
    "private_key": (r"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----", False),
    "json_web_token": (r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", False),
    "url_credentials": (r"\b[a-z][a-z0-9+.-]{1,20}://[^ \t\n\r/:@\"]+:[^ \t\n\r/@\"]+@", False),
    "hex_digest_40": (r"\b[0-9a-f]{40}\b", False),
    "card_number": (r"\b[0-9]{16}\b", False),
}
SEGMENT_BYTES = 1 << 21
_MOST = 64

# A query is None (no constraint), ("tri", code), ("and", [...]) or ("or", [...]).


def _both(op: str, parts: list) -> tuple | None:
    if op == "or" and any(p is None for p in parts):
        return None
    parts = [p for p in parts if p is not None]
    flat = []
    for p in parts:
        flat += p[1] if p[0] == op else [p]
    if not flat:
        return None
    return flat[0] if len(flat) == 1 else (op, flat)


def _of_strings(exact: set[bytes]) -> tuple | None:
    """Some string of ``exact`` occurs."""
    alternatives = []
    for s in sorted(exact):
        tri = sorted({s[i] << 16 | s[i + 1] << 8 | s[i + 2] for i in range(len(s) - 2)})
        alternatives.append(_both("and", [("tri", t) for t in tri]))
    return _both("or", alternatives)


def _folded(code: int) -> set[bytes] | None:
    return {chr(code).lower().encode()} if code < 128 else {chr(code).encode()}


def _sequence(nodes, ignore: bool) -> tuple[set[bytes] | None, tuple | None]:
    """The folded strings a sequence can match (None: too many), and the query of what it must hold."""
    exact: set[bytes] | None = {b""}
    whole, held = True, []
    for op, arg in nodes:
        strings, query = _node(op, arg, ignore)
        if strings is not None and exact is not None and len(strings) * len(exact) <= _MOST:
            exact = {x + y for x in exact for y in strings}
            continue
        whole = False
        held += [_of_strings(exact) if exact else None, query]
        exact = strings if strings is not None else {b""}
    held.append(_of_strings(exact))
    return (exact if whole else None), _both("and", held)


def _node(op, arg, ignore: bool) -> tuple[set[bytes] | None, tuple | None]:
    if op is rc.LITERAL:
        return (None, None) if arg >= 128 and ignore else (_folded(arg), None)
    if op is rc.IN:
        out: set[bytes] = set()
        for kind_, value in arg:
            if kind_ is rc.LITERAL:
                codes = [value]
            elif kind_ is rc.RANGE and value[1] - value[0] < _MOST:
                codes = range(value[0], value[1] + 1)
            else:
                return None, None
            for c in codes:
                if c >= 128 and ignore:
                    return None, None
                out |= _folded(c)
        return (out, None) if len(out) <= 8 else (None, None)
    if op in (rc.AT, rc.ASSERT, rc.ASSERT_NOT):
        return {b""}, None
    if op is rc.SUBPATTERN:
        return _sequence(arg[3], ignore or bool(arg[1] & re.I))
    if op is rc.ATOMIC_GROUP:
        return _sequence(arg, ignore)
    if op is rc.BRANCH:
        parts = [_sequence(p, ignore) for p in arg[1]]
        if all(e is not None for e, _ in parts) and len(union := set().union(*[e for e, _ in parts])) <= _MOST:
            return union, None
        return None, _both("or", [q for _, q in parts])
    if op in (rc.MAX_REPEAT, rc.MIN_REPEAT, rc.POSSESSIVE_REPEAT):
        least, most, inner = arg
        exact, query = _sequence(inner, ignore)
        if least == most and exact is not None and len(exact) ** least <= _MOST:
            out = {b""}
            for _ in range(least):
                out = {x + y for x in out for y in exact}
            return out, None
        if most == 1 and exact is not None:
            return exact | {b""}, None
        return None, query if least else None
    return None, None


def trigram_query(pattern: str, ignore_case: bool = False) -> tuple | None:
    """The Boolean trigram query that every match of ``pattern`` satisfies; None if there is none."""
    tree = rp.parse(pattern, re.A | (re.I if ignore_case else 0))
    return _sequence(tree, bool(tree.state.flags & re.I))[1]


def _vocabulary(query: tuple | None) -> set[int]:
    if query is None:
        return set()
    return {query[1]} if query[0] == "tri" else set().union(*map(_vocabulary, query[1]))


@lru_cache(maxsize=4)
def _compiled(rules: tuple[tuple[str, str, bool], ...]):
    out = [(name, re.compile(p, re.A | (re.I if i else 0)), trigram_query(p, i)) for name, p, i in rules]
    vocabulary = sorted(set().union(*[_vocabulary(q) for _, _, q in out], set()))
    table = np.zeros(1 << 24, np.uint16)
    table[vocabulary] = np.arange(1, len(vocabulary) + 1)
    return out, vocabulary, table


def index_segment(data: np.ndarray, offsets: np.ndarray, vocabulary: list[int], table: np.ndarray) -> dict[int, np.ndarray]:
    """Sorted postings (row numbers) of each trigram of the vocabulary in one segment."""
    low = _lower[data]
    if len(low) < 3:
        return {}
    code = (low[:-2].astype(np.uint32) << 16) | (low[1:-1].astype(np.uint32) << 8) | low[2:]
    term = table[code]
    at = np.flatnonzero(term)
    row = np.searchsorted(offsets, at, side="right") - 1
    inside = at + 3 <= offsets[row + 1]
    pairs = np.unique(term[at[inside]].astype(np.int64) * len(offsets) + row[inside])
    terms, rows = np.divmod(pairs, len(offsets))
    cuts = np.flatnonzero(np.diff(terms)) + 1
    return {vocabulary[int(terms[a]) - 1]: rows[a:b] for a, b in zip(np.append(0, cuts), np.append(cuts, len(terms)), strict=True) if b > a}


_NONE = np.zeros(0, np.int64)


def candidates(query: tuple, postings: Mapping[int, np.ndarray]) -> np.ndarray:
    """Rows of a segment that satisfy a query, by intersecting and uniting postings (shortest first)."""
    if query[0] == "tri":
        return postings.get(query[1], _NONE)
    parts = sorted((candidates(q, postings) for q in query[1]), key=len)
    out = parts[0]
    for p in parts[1:]:
        if query[0] == "and" and not len(out):
            break
        out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
    return out


def scan(docs: DataFrame, rules: Mapping[str, tuple[str, bool]] = RULES) -> DataFrame:
    """Every match of every rule in ``docs(doc_id, text)``."""
    frozen = tuple((name, p, i) for name, (p, i) in rules.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled, vocabulary, table = _compiled(frozen)
        for batch in batches:
            col = Column(batch.column(1))
            rows, names, starts, sizes, digests = [], [], [], [], []
            for lo, hi, data, off in col.chunks(SEGMENT_BYTES):
                postings = index_segment(data, off, vocabulary, table)
                texts: dict[int, str] = {}
                for name, regex, query in compiled:
                    for r in range(hi - lo) if query is None else candidates(query, postings).tolist():
                        if r not in texts:
                            texts[r] = data[off[r] : off[r + 1]].tobytes().decode("utf-8", "replace")
                        for m in regex.finditer(texts[r]):
                            rows.append(lo + r)
                            names.append(name)
                            starts.append(m.start())
                            sizes.append(m.end() - m.start())
                            digests.append(hashlib.sha256(m.group().encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(names, pa.string()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())],
                ["doc_id", "rule", "start", "n_chars", "secret_sha256"],
            )

    return pick(docs, "doc_id", "text").mapInArrow(thrifty(run), f"doc_id {kind(docs, 'doc_id')}, rule string, start bigint, n_chars bigint, secret_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    parts = []
    for name, (pattern, ignore) in RULES.items():
        p = ("(?i)" if ignore else "") + pattern
        p = p.replace("'", "''")
        parts.append(f"SELECT doc_id, '{name}' AS rule, regexp_extract_all(text, '{p}') AS ms, string_split_regex(text, '{p}') AS ps FROM documents WHERE regexp_matches(text, '{p}')")
    return f"""
WITH hit AS ({' UNION ALL '.join(parts)}),
each AS (SELECT doc_id, rule, ms, ps, unnest(range(1, len(ms) + 1)) AS i FROM hit)
SELECT doc_id, rule,
       (coalesce(list_sum(list_transform(ps[1:i], lambda x: length(x))), 0)
        + CASE WHEN i > 1 THEN coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) ELSE 0 END)::BIGINT AS start,
       length(ms[i])::BIGINT AS n_chars, sha256(ms[i]) AS secret_sha256
FROM each"""


SQL = _sql()
