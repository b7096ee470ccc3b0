"""Operator 13 against all pairs of overlapping byte ranges."""

import hashlib
import itertools
import random
import re
from collections import Counter

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tarnlight.llm import alignment
from tarnlight.llm.byte_pairs import byte_alphabet

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def ranges(tokens):
    at, found = 0, []
    for t in tokens:
        found.append((at, at + len(t)))
        at += len(t)
    return found


def plain(rows):
    """Every row's result from whole texts, with byte ranges compared one by one."""
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    back = {c: x for x, c in byte_alphabet().items()}
    docs = []
    for doc_id, text in rows:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(back[c] for c in a.id_to_token(i)) for i in ids_a]
        pieces = [b.id_to_piece(i) for i in ids_b]
        bytes_b = [bytes.fromhex(p[3:5]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in pieces]
        whole = (" " + text).encode() if text else b""
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            ids_a = ids_b = bytes_a = bytes_b = []
        spans_a, spans_b = ranges(bytes_a), ranges(bytes_b)
        links, k = [], 0
        for i, (s, e) in enumerate(spans_a):
            while k < len(spans_b) and spans_b[k][1] <= s:
                k += 1
            for j in range(k, len(spans_b)):
                if spans_b[j][0] >= e:
                    break
                links.append((ids_a[i], ids_b[j]))
        ends = sorted({e for _, e in spans_a} & {e for _, e in spans_b})
        groups, low = [], 0
        for end in ends:
            own = [",".join(str(i) for i, (s, e) in zip(ids, spans, strict=True) if low <= s and e <= end) for ids, spans in ((ids_a, spans_a), (ids_b, spans_b))]
            groups.append("|".join(own))
            low = end
        docs.append((doc_id, len(ids_a), len(ids_b), len(ends), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if ids_a else ""))
    counts = Counter(p for *_, links, _ in docs for p in set(links))
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    return Counter((d, na, nb, g, len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), sha) for d, na, nb, g, links, sha in docs), counts, best


def awkward():
    rng = random.Random(13)
    words = "the of and lake naïve straße Éric   über 日本語 テスト emoji😀 don't it's x1y2 3.14 <s> </s> <|endoftext|> <0x41> ...! \n \t ﬁ é   \x1c \x85 　".split(" ")
    texts = ["".join(rng.choice(words) + rng.choice(["", " ", " ", "  ", "\n"]) for _ in range(rng.randint(1, 60))) for _ in range(80)]
    texts += [None, "", " ", "  ", "\n", "a", " a", "a ", "▁", "a▁b c", "x" * 3000, "ab " * 4000, "<unk>", texts[0], texts[0], "\x00\x01 \x7f"]
    return [*enumerate(texts), (3, texts[3]), (None, "no id"), (None, None)]


def test_alignment_equals_overlapping_ranges(spark):
    rows = awkward()
    expect, counts, best = plain(rows)
    docs = spark.createDataFrame([(i, t, i, "s", None) for i, t in rows], "doc_id long, text string, n_a long, pair string, row_no string").repartition(3)
    for options in ({}, {"broadcast_rows": 0}):
        assert Counter(map(tuple, alignment.align_tokenizers(docs, A, B, **options).select(*COLUMNS).collect())) == expect
    assert sum(e[1] == 0 for e in expect.elements()) >= 4
    found = {(r.a_id, r.b_id): (r.n_docs, r.is_best) for r in alignment.token_map(docs, A, B).collect()}
    assert found == {p: (n, n == best[p[0]]) for p, n in counts.items()}
    assert alignment.align_tokenizers(docs.limit(0), A, B).count() == 0


def test_the_query_equals_overlapping_ranges(spark):
    from tarnlight.llm import registry

    rows = [(r.doc_id, r.text) for r in registry.documents(spark, "/root/testdata/sf0.001").select("doc_id", "text").collect()]
    out = registry.op13_tokenizer_alignment(spark, "/root/testdata/sf0.001")
    assert Counter(map(tuple, out.select(*COLUMNS).collect())) == plain(rows)[0]


@pytest.mark.parametrize("seed", range(3))
def test_transducer_on_random_cuts(seed):
    """Two ways of cutting one byte string into tokens, and strings that differ."""
    rng = random.Random(seed)
    spell = [bytes(x) for n in (1, 2, 3) for x in itertools.product(b"ab", repeat=n)]
    ids = {t: i for i, t in enumerate(spell)}
    machine = alignment.Transducer(spell, spell)

    def cut(data):
        out = []
        while data:
            n = rng.randint(1, min(3, len(data)))
            out.append(ids[data[:n]])
            data = data[n:]
        return out

    for _ in range(300):
        data = bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 40)))
        a, b = cut(data), cut(data)
        ends, links = machine.align(a, b)
        sa, sb = ranges([spell[i] for i in a]), ranges([spell[i] for i in b])
        assert Counter(links) == Counter(x * alignment.SPAN + y for x, (s, e) in zip(a, sa, strict=True) for y, (t, f) in zip(b, sb, strict=True) if s < f and t < e)
        assert [sum(len(spell[t]) for t in a[:i]) for i, _ in ends] == sorted({e for _, e in sa} & {e for _, e in sb})
        other = bytes([data[0] ^ 3]) + data[1:]
        assert machine.align(a, cut(other)) is None and machine.align(a, cut(data + b"a")) is None


def test_both_libraries_give_the_same_ids():
    own = alignment.aligner(A, B)
    rng = random.Random(4)
    letters = [*"aeinrstAZ0129'.,;- \t\n", "ll", "'s", "'re", "the", "ing", "tion", "é", "ß", "ɏ", "€", "—", "½", "²", "  "]
    parts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 20))) for _ in range(20_000)]
    assert own.ranks is not None and sum(alignment._COMMON.fullmatch(p) is not None for p in parts) > 19_000
    assert own._a_ids(parts) == [e.ids for e in own.a.encode_batch(parts, add_special_tokens=False)]
