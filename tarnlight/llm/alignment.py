"""Operator 13: alignment of two tokenizers by a transducer over dangling suffixes."""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlight.llm.batches import bound_batches, column, texts
from tarnlight.llm.byte_pairs import CACHED_LENGTH, byte_alphabet
from tarnlight.llm.shipping import remote
from tarnlight.llm.staging import Workspace, broadcast_below

#: Remembered transitions, beyond which the memory starts anew.
MOVES = 2_000_000
#: Remembered stretches of text of a generation.
STRETCHES = 300_000
#: What B encodes a stretch behind that does not start with a space.
LETTER = "a"
#: An id pair as one number: A's id times this plus B's id.
SPAN = 1 << 24
BROADCAST_ROWS = 1_000_000
#: Characters of a text that are taken at once, about.
BLOCK = 1 << 20
#: The pattern by which byte-level vocabularies of this kind cut texts before merging (a fixed value), and characters on whose classes all libraries agree.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_COMMON = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-ɏ‐-‧€]*")
_LATIN = "[A-Za-zÀ-ÖØ-öø-ɏ]"
#: Where both tokenizers end a token: before a single space between characters that are no white space, and between a Latin letter and a sign.
_CUT = re.compile(rf"(?<=\S)(?= \S)|(?<={_LATIN})(?=[.,;:!?])")


class Transducer:
    """Walks two token sequences that spell the same bytes.

    A state is the residual: the bytes by which one side leads, and which side that is (even numbers: A, odd ones: B); the empty residual is
    state 0. The side that lags hands in its next token, which takes bytes off the residual or turns the lead. What a
    token does to a state is remembered, so bytes are compared once for each residual and next token that meet.
    """

    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes]):
        self.spell = (a_bytes, b_bytes)
        self.forget()

    def forget(self) -> None:
        self.states: dict[tuple[int, bytes], int] = {}
        self.residuals: list[bytes] = [b"", b""]
        self.moves: dict[int, int] = {}

    def _state(self, leader: int, rest: bytes) -> int:
        if not rest:
            return 0
        state = self.states.get((leader, rest))
        if state is None:
            state = self.states[leader, rest] = len(self.residuals) + leader
            self.residuals += [rest, rest]
        return state

    def _move(self, state: int, token: int) -> int:
        """The state after the lagging side's token; -1 if its bytes are not those that the leader has. From state 0 A goes first."""
        side = 1 - (state & 1) if state else 0
        rest, own = self.residuals[state], self.spell[side][token]
        if len(own) <= len(rest):
            made = self._state(1 - side, rest[len(own) :]) if rest.startswith(own) else -1
        else:
            made = self._state(side, own[len(rest) :]) if own.startswith(rest) else -1
        self.moves[state * SPAN + token] = made
        return made

    def align(self, a_ids: list[int], b_ids: list[int]) -> tuple[list[tuple[int, int]], list[int]] | None:
        """Where each group ends in both sequences, and every overlapping pair as A's id * SPAN + B's id; None if the bytes differ.

        A token that meets a residual overlaps the token that the residual is of, and no other before it, so each step
        out of a state other than 0 is one link.
        """
        if len(self.moves) > MOVES:
            self.forget()
        known, move = self.moves.get, self._move
        ends, links = [], []
        i = j = 0
        n_a, n_b = len(a_ids), len(b_ids)
        while i < n_a:
            a = a_ids[i]
            i += 1
            state = known(a)
            if state is None:
                state = move(0, a)
            a *= SPAN
            while state > 0:
                if state & 1:
                    if i == n_a:
                        return None
                    token = a_ids[i]
                    i += 1
                    a = token * SPAN
                else:
                    if j == n_b:
                        return None
                    token = b = b_ids[j]
                    j += 1
                links.append(a + b)
                after = known(state * SPAN + token)
                state = move(state, token) if after is None else after
            if state < 0:
                return None
            ends.append((i, j))
        return (ends, links) if j == n_b else None


class Aligner:
    """Both tokenizers, the transducer, and what the stretches between cuts became.

    A text, with the space before it, is cut where neither tokenizer can have a token across; if B's model could (another normaliser,
    or pieces with an inner space or a sign behind a letter), it is taken whole. So memory follows the longest stretch without a
    cut, and what is remembered in two generations of bounded size.
    """

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        spec = sentencepiece_model_pb2.ModelProto()
        with open(b_path, "rb") as file:
            spec.ParseFromString(file.read())
        with open(a_path, encoding="utf-8") as file:
            model = json.load(file)
        how = spec.normalizer_spec
        known = model["normalizer"] is None and model["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self.cuts = known and how.name == "identity" and how.add_dummy_prefix and how.escape_whitespaces
        self.cuts = self.cuts and len(self.b.encode(LETTER)) == 1 and not how.remove_extra_whitespaces and not any(re.search(f"[^▁]▁|{_LATIN}[.,;:!?]", p) for p in pieces)
        back = {c: b for b, c in byte_alphabet().items()}
        size = self.a.get_vocab_size(with_added_tokens=True)
        a_bytes = [bytes(back[c] for c in token) if token and all(c in back for c in token) else (token or "").encode() for token in map(self.a.id_to_token, range(size))]
        b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        self.spell = (a_bytes, b_bytes)
        # where a trained vocabulary's ids are in the order of its merges, merging by ids gives the same tokens
        merged = [model["model"]["vocab"][m.replace(" ", "") if isinstance(m, str) else "".join(m)] for m in model["model"]["merges"]]
        self.ranks = None
        if known and merged == sorted(merged):
            import tiktoken

            own = {t["id"] for t in model["added_tokens"]}
            self.ranks = tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks={t: i for i, t in enumerate(a_bytes) if i not in own}, special_tokens={})
        self.written = [str(i) for i in range(max(len(a_bytes), len(b_bytes)))].__getitem__
        self.transducer = Transducer(a_bytes, b_bytes)
        self.young: dict[str, tuple | None] = {}
        self.old: dict[str, tuple | None] = {}

    def _stretch(self, part: str, a_ids: list[int], b_ids: list[int]) -> tuple[bytes, bytes, int] | None:
        """The groups as written, the links as 64-bit integers, and the numbers of A's tokens, B's tokens and groups in one; None if it has no tokens."""
        if b"".join(map(self.spell[0].__getitem__, a_ids)) != part.encode():
            return None
        found = self.transducer.align(a_ids, b_ids)
        if found is None:
            return None
        ends, links = found
        groups, i, j, written = [], 0, 0, self.written
        for to_i, to_j in ends:
            groups.append(",".join(map(written, a_ids[i:to_i])) + "|" + ",".join(map(written, b_ids[j:to_j])))
            i, j = to_i, to_j
        return ";".join(groups).encode(), array("q", links).tobytes(), len(a_ids) | len(b_ids) << 40 | len(ends) << 80

    def _known(self, parts: list[str]) -> list[tuple | None]:
        """What the parts become; those not remembered are encoded together."""
        if len(self.young) > STRETCHES:
            self.young, self.old = {}, self.young
        young = self.young
        new = []
        for part in {*parts}:
            if part in young:
                continue
            if part in self.old:
                young[part] = self.old[part]
            else:
                new.append(part)
        if new:
            # B puts a space before what it encodes: a stretch without one is encoded behind a letter
            b_ids = self.b.encode([p[1:] if p[0] == " " else LETTER + p for p in new], num_threads=1)
            for part, own_a, own_b in zip(new, self._a_ids(new), b_ids, strict=True):
                young[part] = self._stretch(part, own_a, own_b if part[0] == " " else own_b[1:])
        found = [young[part] for part in parts]
        for part in new:
            if len(part) > CACHED_LENGTH:
                del young[part]
        return found

    def _a_ids(self, parts: list[str]) -> list[list[int]]:
        """A's ids, of short stretches of common characters by the faster library."""
        if self.ranks is None:
            return [e.ids for e in self.a.encode_batch_fast(parts, add_special_tokens=False)]
        quick = [len(p) <= CACHED_LENGTH and _COMMON.fullmatch(p) is not None for p in parts]
        slow = iter(self.a.encode_batch_fast([p for p, q in zip(parts, quick, strict=True) if not q], add_special_tokens=False))
        return [self.ranks.encode_ordinary(p) if q else next(slow).ids for p, q in zip(parts, quick, strict=True)]

    def blocks(self, text: str) -> Iterator[list[str]]:
        """The text's stretches, those of about BLOCK characters at once."""
        text, at = " " + text, 0
        while at < len(text):
            cut = _CUT.search(text, at + BLOCK) if self.cuts else None
            end = cut.start() if cut else len(text)
            block = text[at:end]
            yield _CUT.split(block) if self.cuts else [block]
            at = end

    def document(self, text: str) -> tuple[int, int, int, str, np.ndarray, np.ndarray]:
        """n_a, n_b, n_groups, groups_sha256, the distinct links and their numbers; zeros without tokens."""
        digest, first, numbers = hashlib.sha256(), True, 0
        links, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for parts in self.blocks(text) if text else ():
            found = self._known(parts)
            if None in found:
                return 0, 0, 0, "", links[:0], times[:0]
            digest.update((b"" if first else b";") + b";".join([f[0] for f in found]))
            own, n = np.unique(np.frombuffer(b"".join([f[1] for f in found]), np.int64), return_counts=True)
            numbers += sum([f[2] for f in found])
            if first:
                links, times = own, n
            else:
                links, back = np.unique(np.concatenate([links, own]), return_inverse=True)
                times = np.bincount(back, np.concatenate([times, n])).astype(np.int64)
            first = False
        low = (1 << 40) - 1
        return numbers & low, numbers >> 40 & low, numbers >> 80, "" if first else digest.hexdigest(), links, times


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One for each worker."""
    return Aligner(a_path, b_path)


def align_batches(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str) -> Iterator[pa.RecordBatch]:
    own = aligner(a_path, b_path)
    for batch in batches:
        numbers: list[list[int]] = [[], [], []]
        shas, pairs, times = [], [], []
        for text in texts(batch):
            *counts, sha, links, n = own.document(text)
            for kept, count in zip(numbers, counts, strict=True):
                kept.append(count)
            shas.append(sha)
            pairs.append(links)
            times.append(n)
        arrays = [column(batch, "doc_id"), *[pa.array(n, pa.int64()) for n in numbers], pa.array(shas, pa.string()), pa.array(pairs, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times"])


def _aligned(docs: DataFrame, a_path: str, b_path: str, space: Workspace) -> DataFrame:
    """A staged row for each document, with a number of its own and its distinct links."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        remote(__name__, "align_batches", a_path, b_path), "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<long>"
    )
    return space.stage(rows.withColumn("row_no", F.monotonically_increasing_id()), "aligned")


def _counted(rows: DataFrame, space: Workspace) -> DataFrame:
    """pair, n_docs, is_best: each linked pair of ids, the documents that hold it, and whether none of its A id's pairs has more."""
    counts = space.stage(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n_docs")), "pairs")
    top = counts.groupBy(F.floor(F.col("pair") / SPAN).alias("of_a")).agg(F.max("n_docs").alias("top"))
    return space.stage(counts.join(top, F.floor(F.col("pair") / SPAN) == F.col("of_a")).select("pair", "n_docs", (F.col("n_docs") == F.col("top")).alias("is_best")), "counted")


def token_map(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """a_id, b_id, n_docs, is_best: which ids of both vocabularies overlap in docs(doc_id, text), and in how many documents.

    For carrying what is known of one vocabulary's tokens, such as embeddings, to the other's. Bad rows as in align_tokenizers.
    """
    space = Workspace(docs.sparkSession, "token-map")
    counted = _counted(_aligned(docs, a_path, b_path, space), space)
    return counted.select(F.floor(F.col("pair") / SPAN).alias("a_id"), (F.col("pair") % SPAN).alias("b_id"), "n_docs", "is_best")


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 for every row of docs(doc_id, text).

    A is a byte-level vocabulary of the tokenizers library and encodes a space and the text, B a sentencepiece model, which adds the space itself.
    Both sequences are cut where tokens of both end (groups); every pair of tokens that share bytes is a link. A pair of ids counts the
    documents that hold it linked; n_best is the number of a document's links whose count is the highest of their A id, count_sum the sum of the
    counts over its links. Texts whose tokens of either side do not spell a space and the text have no tokens, as have null and empty ones: zeros
    and an empty groups_sha256.

    Rows are counted each, also repeated ones; a null doc_id stays null; other columns are ignored; an empty table gives
    no rows. The pairs' counts, which the two vocabularies bound, are broadcast if they number at most broadcast_rows, and merged by
    pair beyond; both sides of that join are staged, so adaptive execution can split a pair that many documents hold.
    """
    space = Workspace(docs.sparkSession, "alignment")
    rows = _aligned(docs, a_path, b_path, space)
    counted = _counted(rows, space)
    links = rows.select("row_no", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("row_no", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
    judged = links.join(broadcast_below(counted, counted.count(), broadcast_rows), "pair")
    sums = judged.groupBy("row_no").agg(
        F.sum("times").alias("n_links"), F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n_docs")).alias("count_sum")
    )
    whole = rows.select("row_no", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256").join(sums, "row_no", "left")
    return whole.select("doc_id", "n_a", "n_b", "n_groups", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_links", "n_best", "count_sum")], "groups_sha256")
