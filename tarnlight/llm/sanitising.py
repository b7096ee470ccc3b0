"""Operator 11 [native]: personal data by patterns, and terms that disclose it by their co-occurrence in the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlight.llm.staging import Workspace, broadcast_below, named, text_mark

KINDS = ("email", "ip", "card", "phone")
TERM_KIND = "term"
#: The kinds' patterns. A run is tried from its start, or from where the last match ended, as a later start in it ends at the
#: same place and fails alike; with that and possessive repeats, work is linear in the text and no stack grows with it.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for a kind to be looked for.
_HINTS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"(?:[0-9][\x20-]?+){13}[0-9]", "phone": r"\+[0-9]"}
_BYTE = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])?"
_IP = rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"
#: A term: a run of letters, marks and digits.
TERM = r"[\p{L}\p{N}][\p{L}\p{M}\p{N}_]*+"
#: The share of an entity's information that a term may give away.
THRESHOLD = 0.95
BROADCAST_ROWS = 500_000
_STEP = 256
_SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"


def _positions(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of all matches in code points; a match is never empty.

    Lengths are added up in steps of 256 matches, then over the steps, so arrays are not copied for each match of a long text.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = F.zip_with(F.split(text, pattern, -1), matches, lambda gap, own: F.struct(F.char_length(gap).alias("gap"), own.alias("value")))
    span = "array<struct<start:int,end:int,value:string>>"

    def add(done: Column, size: Column) -> Column:
        start = done["at"] + size["gap"]
        end = start + F.char_length(size["value"])
        return F.struct(end.alias("at"), F.array_append(done["found"], F.struct(start.alias("start"), end.alias("end"), size["value"].alias("value"))).alias("found"))

    def step(at: Column) -> Column:
        own = F.filter(F.slice(sizes, at, _STEP), lambda size: size["value"].isNotNull())
        return F.aggregate(own, F.struct(F.lit(0).alias("at"), F.array().cast(span).alias("found")), add)

    def shift(done: Column, own: Column) -> Column:
        moved = F.transform(own["found"], lambda s: F.struct((s["start"] + done["at"]).alias("start"), (s["end"] + done["at"]).alias("end"), s["value"].alias("value")))
        return F.struct((done["at"] + own["at"]).alias("at"), F.array_append(done["parts"], moved).alias("parts"))

    steps = F.transform(F.sequence(F.lit(1), F.size(matches), F.lit(_STEP)), step)
    whole = F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("parts")), shift)
    return F.when(F.size(matches) > 0, F.flatten(whole["parts"])).otherwise(F.array().cast(span))


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    return {
        "email": F.lit(True),
        "ip": value.rlike(_IP),
        "card": F.char_length(digits).between(14, 19) & F.call_function("luhn_check", digits),
        "phone": F.char_length(digits).between(10, 15),
    }[kind]


def _of_kind(spans: Column, place: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(place).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))


def _number(spans: Column, place: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == place)).cast("long")


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, end, value>> of the four kinds, by start, then kind; kind is a place in KINDS."""

    def found(place: int, kind: str) -> Column:
        own = F.filter(_positions(text, PATTERNS[kind]), lambda s: _valid(kind, s["value"]))
        return F.when(text.rlike(_HINTS[kind]), _of_kind(own, place)).otherwise(F.array().cast(_SPANS))

    return F.array_sort(F.concat(*[found(place, kind) for place, kind in enumerate(KINDS)]))


def entity(kind: Column, value: Column) -> Column:
    """One spelling for a span's value: e-mail addresses in lower case, numbers by their digits, with the kind before it."""
    same = F.when(kind == 0, F.lower(value)).when(kind == 1, value).otherwise(F.regexp_replace(value, "[^0-9]", ""))
    return F.concat(kind.cast("string"), F.lit(":"), same)


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _terms(line: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(line, F.lit(TERM), F.lit(0)), F.lower))


def generalised(term: Column) -> Column:
    """What stands for a term when it says too much: a number's shape, or a word's first letter."""
    return F.when(term.rlike("[0-9]"), F.regexp_replace(term, "[0-9]", "#")).otherwise(F.concat(F.substring(term, 1, 1), F.lit("*")))


def disclosure(joint: Column, of_entity: Column, of_term: Column, lines: Column) -> Column:
    """Pointwise mutual information of entity and term over the entity's information content: 1 where the term stands with the entity alone, below 0 where it speaks against it."""
    return F.log2(joint * lines / (of_entity * of_term)) / F.log2(lines / of_entity)


def _counts(bodies: DataFrame, wanted: DataFrame, made, limit: int) -> DataFrame:
    """name, n: the lines of all bodies(text) that have each wanted(name); made turns a line into an array of distinct names."""
    names = bodies.select(F.explode(F.flatten(F.transform(_lines(F.col("text")), made))).alias("name"))
    return names.join(broadcast_below(wanted, wanted.count(), limit), "name", "left_semi").groupBy("name").agg(F.count("*").alias("n"))


def disclosing_terms(docs: DataFrame, threshold: float = THRESHOLD, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """term, disclosure, replacement: the terms that give away more than the threshold of some entity's information; staged.

    Contexts are the lines of docs(text) that are not blank. An entity is what a base pattern finds, a line's terms are its words outside its entities, in lower case. Of a pair
    of entity and term that stand together in two lines that differ, disclosure is measured from the numbers of lines with either and both;
    copies of one line count, but are no second line. A term over the threshold is generalised if its generalised form, counted in the same way, is not over it
    for any entity that the term discloses, and removed (an empty replacement) otherwise.
    """
    space = Workspace(docs.sparkSession, "disclosing-terms")
    bodies = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    n_lines = bodies.agg(F.coalesce(F.sum(F.size(F.filter(_lines(F.col("text")), lambda x: x.rlike(r"\S")))), F.lit(0)).alias("n")).first()["n"]
    some = bodies.filter(F.greatest(*[F.col("text").rlike(h) for h in _HINTS.values()])).select(F.explode(_lines(F.col("text"))).alias("line"))
    some = some.filter(F.greatest(*[F.col("line").rlike(h) for h in _HINTS.values()])).select("line", base_spans(F.col("line")).alias("base")).filter(F.size("base") > 0)
    rest = F.aggregate("base", F.col("line"), lambda line, s: F.replace(line, s["value"], F.lit(" ")))
    seen = some.select(F.xxhash64("line").alias("mark"), F.array_distinct(F.transform("base", lambda s: entity(s["kind"], s["value"]))).alias("entities"), _terms(rest).alias("terms"))
    seen = space.stage(seen, "seen")
    entities = seen.select(F.explode("entities").alias("entity"), "mark", "terms")
    of_entity = entities.groupBy("entity").agg(F.count("*").alias("n_entity"), F.min("mark").alias("low"), F.max("mark").alias("high"))
    of_entity = of_entity.filter((F.col("low") != F.col("high")) & (F.col("n_entity") < n_lines)).select("entity", "n_entity")  # one line proves nothing, and what is in all lines is no secret
    of_entity = space.stage(of_entity, "entities")

    def judged(terms: Column, pairs_of: DataFrame, made, name: str) -> DataFrame:
        """name, entity, disclosure of what pairs_of(name, entity) and the lines hold together."""
        together = entities.join(broadcast_below(of_entity, of_entity.count(), broadcast_rows), "entity").select("entity", "n_entity", "mark", F.explode(terms).alias("name"))
        if pairs_of is not None:
            together = together.join(broadcast_below(pairs_of, pairs_of.count(), broadcast_rows), ["name", "entity"], "left_semi")
        joint = together.groupBy("entity", "name").agg(F.count("*").alias("joint"), F.max("n_entity").alias("n_entity"), F.min("mark").alias("low"), F.max("mark").alias("high"))
        joint = space.stage(joint.filter(F.col("low") != F.col("high")).select("entity", "name", "joint", "n_entity"), f"{name}-joint")
        counts = space.stage(_counts(bodies, space.stage(joint.select("name").distinct(), f"{name}-wanted"), made, broadcast_rows), f"{name}-counts")
        measured = disclosure(F.col("joint"), F.col("n_entity"), F.col("n"), F.lit(n_lines))
        return space.stage(joint.join(counts, "name").select("name", "entity", measured.alias("disclosure")).filter(F.col("disclosure") > threshold), name)

    found = judged(F.col("terms"), None, _terms, "terms")
    pairs = space.stage(found.select(generalised(F.col("name")).alias("name"), "entity").distinct(), "general-pairs")
    general = judged(F.array_distinct(F.transform("terms", generalised)), pairs, lambda line: F.array_distinct(F.transform(_terms(line), generalised)), "general")
    over = general.select("name", "entity", F.lit(True).alias("over"))
    named_general = found.withColumn("general", generalised(F.col("name"))).join(over.withColumnRenamed("name", "general"), ["general", "entity"], "left")
    verdict = named_general.groupBy(F.col("name").alias("term")).agg(F.max("disclosure").alias("disclosure"), F.max(F.coalesce("over", F.lit(False))).alias("over"), F.first("general").alias("general"))
    return space.stage(verdict.select("term", "disclosure", F.when(F.col("over"), F.lit("")).otherwise(F.col("general")).alias("replacement")), "verdicts")


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, [*KINDS, TERM_KIND]))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _replaced(text: Column, spans: Column) -> Column:
    """The text with each span's value in its place; of overlapping spans the first counts."""

    def put(done: Column, s: Column) -> Column:
        more = F.concat(done["parts"], F.array(F.substring(text, done["at"] + 1, s["start"] - done["at"]), s["value"]))
        return F.when(s["start"] >= done["at"], F.struct(s["end"].alias("at"), more.alias("parts"))).otherwise(done)

    whole = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts")), put)
    return F.concat(F.array_join(whole["parts"], ""), F.substring(text, whole["at"] + 1, F.lit(2**31 - 1)))


def sanitise(docs: DataFrame, threshold: float = THRESHOLD, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms and sanitised for every row of docs(doc_id, text).

    Base kinds are found by pattern: e-mail addresses; four numbers of at most 255; 14 to 19 digits that pass Luhn's check; `+` and 10 to 15 digits. Matches that fail are dropped.
    Kind `term` adds the words that disclose a base entity somewhere in docs (see disclosing_terms), wherever they stand outside the text's own base spans. A span is kind:start:end in
    code points, the end exclusive; spans are sorted by start, then kind in that order, and joined by commas; base_sha256 is of the base kinds' spans alone.
    sanitised is the text with base spans replaced by their kind in brackets, terms by what generalises them, or by nothing.

    The patterns are a map over the rows. Statistics are sums with partial sums before the shuffle, taken over all lines; what terms are wanted is broadcast if it
    numbers at most broadcast_rows, and merged by word beyond. A null or empty text has no spans; repeated rows are judged alike; doc_id may be
    null; other columns are ignored; an empty table gives no rows.
    """
    space = Workspace(docs.sparkSession, "sanitising")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    verdicts = disclosing_terms(docs, threshold, broadcast_rows)
    words = rows.select("doc_id", text_mark(F.col("text")).alias("text_mark"), F.explode(_terms(F.col("text"))).alias("term"))
    hits = words.join(broadcast_below(verdicts, verdicts.count(), broadcast_rows), "term").groupBy("doc_id", "text_mark").agg(F.map_from_entries(F.collect_set(F.struct("term", "replacement"))).alias("hits"))
    hits = space.stage(hits, "hits")
    keys, same, (found,) = named(rows, hits, ("hits",))
    marked = rows.withColumn("base", base_spans(F.col("text"))).join(broadcast_below(keys, hits.count(), broadcast_rows), same, "left")
    words = F.filter(_positions(F.col("text"), TERM), lambda t: F.try_element_at(F.col(found), F.lower(t["value"])).isNotNull() & ~F.exists("base", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    marked = marked.withColumn("more", F.when(F.col(found).isNotNull(), _of_kind(words, len(KINDS))).otherwise(F.array().cast(_SPANS)))
    whole = F.array_sort(F.concat("base", "more"))
    labels = F.array(*[F.lit(f"[{kind}]") for kind in KINDS])
    put = F.transform(whole, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["kind"] < len(KINDS), F.get(labels, s["kind"])).otherwise(F.try_element_at(F.col(found), F.lower(s["value"]))).alias("value")))
    return marked.select(
        "doc_id",
        *[_number(F.col("base"), place).alias(f"n_{kind}") for place, kind in enumerate(KINDS)],
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
        _written(whole).alias("spans"),
        F.size("more").cast("long").alias("n_terms"),
        _replaced(F.col("text"), put).alias("sanitised"),
    )


def op11_sanitisation(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return sanitise(docs).drop("sanitised")
