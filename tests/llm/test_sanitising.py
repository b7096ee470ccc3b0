"""Operator 11 against a plain scanner and plain statistics."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
import regex
from pyspark.sql import functions as F

from tarnlight.llm import sanitising

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
WORD = regex.compile(r"[\p{L}\p{N}][\p{L}\p{M}\p{N}_]*+")
COLUMNS = ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_terms", "sanitised")


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def plain_base(text):
    found = []
    for place, (kind, pattern) in enumerate(PLAIN.items()):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                found.append((m.start(), place, m.end(), m[0]))
    return sorted(found)


def of(place, value):
    return (place, value.lower() if place == 0 else value if place == 1 else re.sub("[^0-9]", "", value))


def words(line):
    return {m[0].lower() for m in WORD.finditer(line)}


def general(term):
    return re.sub("[0-9]", "#", term) if re.search("[0-9]", term) else term[0] + "*"


def plain_verdicts(texts, threshold):
    lines = [x for t in texts for x in (t or "").split("\n") if re.search(r"[^ \t\n\x0b\f\r]", x)]
    contexts = []
    for line in lines:
        base, rest = plain_base(line), line
        for *_, value in base:
            rest = rest.replace(value, " ")
        contexts.append((line, {of(p, v) for _, p, _, v in base}, words(rest), words(line)))
    n_entity, marks = Counter(), defaultdict(set)
    for line, own, _, _ in contexts:
        for e in own:
            n_entity[e] += 1
            marks[e].add(line)
    good = {e for e in n_entity if len(marks[e]) > 1 and n_entity[e] < len(lines)}

    def over(made):
        joint, marks, n_term = Counter(), defaultdict(set), Counter()
        for line, own, terms, every in contexts:
            for t in {made(x) for x in every}:
                n_term[t] += 1
            for e in own & good:
                for t in {made(x) for x in terms}:
                    joint[e, t] += 1
                    marks[e, t].add(line)
        out = {}
        for (e, t), n in joint.items():
            if len(marks[e, t]) > 1:
                d = math.log2(n * len(lines) / (n_entity[e] * n_term[t])) / math.log2(len(lines) / n_entity[e])
                if d > threshold:
                    out[e, t] = d
        return out

    found, wide = over(lambda t: t), over(general)
    verdicts = {}
    for e, t in found:
        verdicts[t] = "" if (e, general(t)) in wide or verdicts.get(t) == "" else general(t)
    return verdicts


def plain(rows, threshold):
    verdicts = plain_verdicts([t for _, t in rows], threshold)
    out = Counter()
    for doc_id, text in rows:
        text = text or ""
        base = plain_base(text)
        more = [(m.start(), 4, m.end(), m[0]) for m in WORD.finditer(text) if m[0].lower() in verdicts and not any(s < m.end() and m.start() < e for s, _, e, _ in base)]
        kinds = [*PLAIN, "term"]
        parts, at = [], 0
        for s, k, e, v in sorted(base + more):
            if s >= at:
                parts += [text[at:s], f"[{kinds[k]}]" if k < 4 else verdicts[v.lower()]]
                at = e

        def written(spans):
            return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e, _ in sorted(spans))

        out[(doc_id, *[sum(k == i for _, k, _, _ in base) for i in range(4)], hashlib.sha256(written(base).encode()).hexdigest(), written(base + more), len(more), "".join(parts) + text[at:])] += 1
    return out, verdicts


def awkward():
    rng = random.Random(11)
    people = [("Zoë Quill", "zoe.quill@mail.example.org"), ("Ødegård", "10.0.0.255"), ("7B-Wing", "4952 9359 0025 3052"), ("Marlow", "+1 (017) 555-7713")]
    plainly = "the of a lake road 12 under é 日本 x9 river green and stone".split(" ")
    texts = []
    for i in range(160):
        bits = [rng.choice(plainly) for _ in range(rng.randint(3, 14))]
        if i % 4 == 0:
            name, value = people[i // 4 % 4]
            bits[1:1] = [name, "\U0001f600", value]
            bits.append(rng.choice(["Card.", "4952935900253053", "256.1.1.1", "00000000000000", "+123", "a@b", "1.2.3.4.5.6.7.8.9"]))
        texts.append(" ".join(bits) + rng.choice(["", "\n", "\n\nend of it", "\nMarlow again"]))
    texts += [texts[0]] * 30  # copies are no second line
    texts += [None, "", " ", "\n", "x" * 40_000, "1" * 20_000, "1 " * 20_000, "a@b.c_d@e.f " * 900, "+1 " * 900, "9.9.9.9 " * 1500, "." * 5000 + "@" * 5000]
    return [*enumerate(texts), (0, texts[0]), (None, "10.0.0.255 without an id"), (None, None)]


@pytest.mark.parametrize(("threshold", "limit"), [(0.95, 500_000), (0.4, 0)])
def test_sanitising_equals_plain_statistics(spark, threshold, limit):
    rows = awkward()
    expect, verdicts = plain(rows, threshold)
    docs = spark.createDataFrame([(i, t, "x", 1, None, "k") for i, t in rows], "doc_id long, text string, base string, n_ip long, hits string, term string").repartition(3)
    out = sanitising.sanitise(docs, threshold, limit)
    assert tuple(out.columns) == COLUMNS
    assert Counter(map(tuple, out.collect())) == expect
    assert {"quill", "zoë"} <= set(verdicts) and {"the", "river"}.isdisjoint(verdicts)
    assert {v == "" for v in verdicts.values()} == {True, False} or threshold < 0.9
    assert sanitising.sanitise(docs.limit(0)).count() == 0


def test_base_spans_equal_a_plain_scanner(spark):
    rng = random.Random(3)
    bits = ["a", "Z9", "@", ".", "-", "_", "%", "+", " ", "(", ")", "1", "25", "255", "256", "4952935900253052", "\n", "é", "😀", "00", "4111-1111", "+1 (017) 555-7713", "a@b.c", "1.2.3.4"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(6000)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    found = [[(s.start, s.kind, s.end, s.value) for s in r.base] for r in rows.select(sanitising.base_spans(F.col("text")).alias("base")).collect()]
    assert found == [plain_base(t) for t in texts]
    assert {k for own in found for _, k, _, _ in own} == {0, 1, 2, 3}


def test_only_spark_expressions_are_used(spark):
    docs = spark.createDataFrame([(1, "a@b.cd")], "doc_id long, text string")
    plan = sanitising.sanitise(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_the_query_equals_plain_statistics(spark):
    from tarnlight.llm import registry

    rows = [(r.doc_id, r.text) for r in registry.documents(spark, "/root/testdata/sf0.01").select("doc_id", "text").collect()]
    out = registry.op11_sanitisation(spark, "/root/testdata/sf0.01")
    expect = Counter({k[:-1]: n for k, n in plain(rows, sanitising.THRESHOLD)[0].items()})
    assert Counter(map(tuple, out.select(*COLUMNS[:-1]).collect())) == expect
