"""Operator 10: secret scans by patterns and by token efficiency."""

from __future__ import annotations

import base64
import hashlib
import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlight.llm.batches import bound_batches, column, texts
from tarnlight.llm.shipping import remote

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ASSIGN_HINTS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
#: What may be a random string: a run of at least 16 of these characters.
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
#: Known digests: hexadecimal in one case, as long as MD5, SHA-1, SHA-224, SHA-256, SHA-384 or SHA-512.
_DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z")
_DIGEST_LENGTHS = frozenset((32, 40, 56, 64, 96, 128))
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z")
#: An identifier or a stamp: three parts or more, each letters, then digits, or either alone.
_PARTS = re.compile(r"[A-Za-z]*+[0-9]*+(?:[-_/]++[A-Za-z]*+[0-9]*+){2,}+\Z")
#: A part of a run between separators; a UUID is one part.
_PART = re.compile(rf"(?<![A-Za-z0-9]){_UUID.pattern[:-2]}(?![A-Za-z0-9])|[A-Za-z0-9]+")
#: The least length of a run, as in _RUN, and of a stretch of its parts.
LEAST = 16
MAX_RATIO = 2.2
#: The pattern that cuts a run before merging, as byte-level vocabularies of this kind have it, for the characters of a run.
_CUTS = r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+"


def secret_scan(docs: DataFrame, ranks_path: str, max_ratio: float = MAX_RATIO) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_random for every row of docs(doc_id, text).

    Base kinds are found by pattern: assignments of 8 or more characters, access keys of 16 or
    more, runs of 32 or more hexadecimal digits. The kind `random` adds runs of 16 or more
    characters that have a letter and, under the vocabulary of byte ranks at ranks_path, at
    most max_ratio characters to a token (in lower case too, as words in capitals cost many tokens), but
    that are no digest, UUID or identifier of several parts and touch no base span. Where a run as a whole does not pass,
    its stretches between separators are judged by themselves. A span is kind:start:end in code points, the end exclusive; spans are sorted by start, then
    by kind in the order above, and joined by commas. base_sha256 is of the base kinds' spans alone.

    A map over the rows without a shuffle. A null or empty text has no spans (spans is an
    empty string). Rows may repeat, doc_id may be null, other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = rows.mapInArrow(remote(__name__, "scan_batches", ranks_path, max_ratio), "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random")


@lru_cache(maxsize=2)
def ranks(path: str):
    """The vocabulary as a tiktoken encoding without special tokens."""
    import tiktoken

    with open(path, "rb") as file:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=_CUTS, mergeable_ranks=table, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, sorted. Matches are leftmost and do not overlap within a kind."""
    found = []
    lowered = text.lower()
    if any(hint in lowered for hint in _ASSIGN_HINTS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    # a run that is too short fails whole, so asking for the length within the pattern finds the same runs
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def is_known(run: str) -> bool:
    """True for digests and identifiers, which are long without being secret."""
    return bool((len(run) in _DIGEST_LENGTHS and _DIGEST.match(run)) or _UUID.match(run) or _PARTS.match(run))


def is_inefficient(run: str, encoding, max_ratio: float) -> bool:
    """True if the run has few characters to a token as it stands and in lower case, in which the vocabulary knows most words."""
    return all(len(run) <= max_ratio * len(encoding.encode_ordinary(x)) for x in {run, run.lower()})


def random_stretches(run: str, encoding, max_ratio: float) -> list[tuple[int, int]]:
    """(start, end) of the stretches of a run, from separator to separator, that are inefficient without what they are joined to.

    Each part counts max_ratio for a token less one for a character, separators count nothing. At each part, the fewest
    parts up to it that have LEAST characters are judged, less those at either end that lower the sum and can be spared;
    stretches that overlap are one. Digests and UUIDs are in none. Work and memory follow LEAST, not the run.
    """
    found: list[tuple[int, int]] = []
    window: deque[tuple[int, int, float]] = deque()
    for m in _PART.finditer(run):
        if is_known(m[0]):
            window.clear()
            continue
        tokens = min(len(encoding.encode_ordinary(x)) for x in {m[0], m[0].lower()})
        window.append((m.start(), m.end(), max_ratio * tokens - len(m[0])))
        while len(window) > 1 and m.end() - window[1][0] >= LEAST:
            window.popleft()
        parts = list(window)
        while len(parts) > 1 and parts[-1][2] < 0 and parts[-2][1] - parts[0][0] >= LEAST:
            parts.pop()
        start, end = parts[0][0], parts[-1][1]
        if end - start >= LEAST and sum(p[2] for p in parts) >= 0 and has_letter(run[start:end]) and not is_known(run[start:end]):
            if found and start < found[-1][1]:
                start, _ = found.pop()
            found.append((start, end))
    return found


def has_letter(run: str) -> bool:
    return any(c.isalpha() for c in run)


def random_spans(text: str, base: list[tuple[int, int, int]], encoding, max_ratio: float) -> list[tuple[int, int, int]]:
    found = []
    for m in _RUN.finditer(text):
        run = m[0]
        near = [(s, e) for s, _, e in base if s < m.end() and m.start() < e]
        if not near and has_letter(run) and not is_known(run) and is_inefficient(run, encoding, max_ratio):
            found.append((m.start(), 3, m.end()))
            continue
        for start, end in random_stretches(run, encoding, max_ratio):
            start, end = start + m.start(), end + m.start()
            if not any(s < end and start < e for s, e in near):
                found.append((start, 3, end))
    return found


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan_batches(batches: Iterator[pa.RecordBatch], path: str, max_ratio: float) -> Iterator[pa.RecordBatch]:
    encoding = ranks(path)
    for batch in batches:
        counts: list[list[int]] = []
        shas, joined = [], []
        for text in texts(batch):
            base = base_spans(text)
            more = random_spans(text, base, encoding, max_ratio)
            counts.append([sum(k == kind for _, k, _ in base) for kind in range(3)] + [len(more)])
            shas.append(hashlib.sha256(written(base).encode()).hexdigest())
            joined.append(written(sorted(base + more)))
        columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(4)]
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), *columns, pa.array(shas, pa.string()), pa.array(joined, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])
