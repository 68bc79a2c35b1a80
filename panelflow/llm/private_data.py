"""Personal data and what gives it away (operator 5, DataFrame operations only).

Base spans are found by pattern, per kind, leftmost and without overlaps. The method then asks
which other terms disclose a protected entity (a value found by a pattern): over the lines of the
corpus, ``PMI(entity; term) / IC(entity)`` is the share of the entity's information that the term
reveals, with PMI and information content from counts of lines. A term occurs with an entity if it
stands within ``NEAR`` characters of it on its line, so a line gives as many pairs as it has words.
A pair must be seen in ``SUPPORT`` different lines, so that copies of one line prove nothing.

Terms at ``REMOVE`` or above are removed, in the texts that hold the entity. Terms at ``GENERALISE``
or above are generalised: their place takes the longest stem that they share with other words of
the corpus and that, with the counts of all those words, stays below ``GENERALISE``. A term without
such a stem is removed.

Positions: the pieces between matches (``split``) and the matches (``regexp_extract_all``) take
turns, so running sums of their lengths are the offsets, in code points. The patterns are written
with possessive quantifiers and look-behinds that change no match but bound the work on long runs.

Defined cases: a null text counts as empty (no spans); repeated rows are rows of their own, but
copies of a line count once as support; rows with a null or repeated doc_id are handled each by
their own text; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stored

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns of the base spans.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
SUPPORT, GENERALISE, REMOVE, TERM_CHARS = 3, 0.9, 0.97, 4
#: Characters on either side of an entity in which terms stand with it; longest stem of a term.
NEAR, STEM_CHARS = 200, 24


def _sql(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _valid(kind: str, m: str) -> str:
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    if kind == "email":
        return "true"
    if kind == "ip":
        return f"{m} rlike {_sql(f'^{_OCTET}(?:[.]{_OCTET}){{3}}$')}"
    if kind == "phone":
        return f"length({digits}) between 8 and 15"
    return (
        f"if(length({digits}) between 16 and 19, aggregate(sequence(1, length({digits})), 0, (a, i) -> a + "
        f"if(i % 2 = 0, array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(substr(reverse({digits}), i, 1))], int(substr(reverse({digits}), i, 1)))) % 10 = 0, false)"
    )


def _near(chars: int) -> str:
    """What stands around a match, without words that the border cuts."""
    before = f"if(length(x.before) > {chars}, regexp_replace(right(x.before, {chars}), '^[^\\\\s]+', ''), x.before)"
    after = f"if(length(x.after) > {chars}, regexp_replace(left(x.after, {chars}), '[^\\\\s]+$', ''), x.after)"
    return f"concat({before}, ' ', {after})"


def spans_of(text: str, kind: str, pattern: str, valid: str, near: int = 0) -> Column:
    """``array<struct<kind, s, e, value>>`` of the matches that are valid, in order of place.

    With ``near``, each has one more field: the text that many characters around it, up to the next match.
    """
    fields = SPAN + (",near:string" if near else "")
    place = "a.at + length(x.before)"
    one = f"named_struct('kind', '{kind}', 's', {place}, 'e', {place} + length(x.hits), 'value', x.hits" + (f", 'near', {_near(near)}" if near else "") + ")"
    fold = (
        "aggregate(transform(h.hits, (m, i) -> named_struct('before', get(h.cut, i), 'hits', m, 'after', get(h.cut, i + 1))), "
        f"named_struct('at', 0, 'out', cast(array() as array<struct<{fields}>>)), "
        f"(a, x) -> named_struct('at', {place} + length(x.hits), 'out', if({valid}, concat(a.out, array({one})), a.out)), a -> a.out)"
    )
    read = f"named_struct('cut', split({text}, {_sql(pattern)}, -1), 'hits', regexp_extract_all({text}, {_sql(pattern)}, 0))"
    return F.expr(f"transform(array({read}), h -> {fold})[0]")


SPAN = "kind:string,s:int,e:int,value:string"


def base_spans(text: str, near: int = 0) -> Column:
    """All base spans of a text column, by kind and then by place."""
    none = F.expr(f"cast(array() as array<struct<{SPAN}{',near:string' if near else ''}>>)")
    found = []
    for kind in KINDS:
        mark = "contains({t}, '@')" if kind == "email" else "contains({t}, '+')" if kind == "phone" else "{t} rlike '[0-9]'"
        found.append(F.when(F.expr(mark.format(t=text)), spans_of(text, kind, PATTERNS[kind], _valid(kind, "x.hits"), near)).otherwise(none))
    return F.concat(*found)


def _texts(docs: DataFrame) -> DataFrame:
    """Each row's text with a digest of it: what a row discloses depends on its text alone."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.concat(F.lit("\u0001"), F.col("text")))})


def _terms(line: str) -> str:
    return f"array_distinct(filter(split(lower({line}), '[^\\\\p{{L}}]+'), t -> length(t) >= {TERM_CHARS}))"


def _stems(term: str) -> str:
    return f"if(length({term}) > {TERM_CHARS}, transform(sequence({TERM_CHARS}, least(length({term}) - 1, {STEM_CHARS})), i -> left({term}, i)), array())"


def _lines_with_entities(texts: DataFrame) -> Stored:
    """``k1, k2, at`` (digests of text and line) and ``met``: the line's entities, each with the terms near it."""
    # what the patterns ask for at least: an at sign, a plus, or two digits next to one another but for one mark
    lines = texts.select("k1", "k2", F.explode(F.split("text", "\n")).alias("line")).where(F.expr("contains(line, '@') or contains(line, '+') or line rlike '[0-9][ .-]?[0-9]'"))
    masked = "regexp_replace(f.near, " + _sql("|".join(f"(?:{PATTERNS[k]})" for k in ("email", "phone", "card"))) + ", ' ')"
    met = f"transform(found, f -> named_struct('entity', concat(f.kind, ':', lower(f.value)), 'terms', {_terms(masked)}))"
    return Stored(lines.withColumn("found", base_spans("line", NEAR)).where("size(found) > 0").select("k1", "k2", F.xxhash64("line").alias("at"), F.expr(met).alias("met")), "entity_lines")


def disclosing_terms(docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE, held: DataFrame | None = None) -> DataFrame:
    """``entity, term, disclosed, general``: terms that reveal at least ``generalise`` of an entity's
    information, and the stem that stands for them (null if there is none).

    Words are counted before anything is joined, so joins see one row a word, entity or pair.
    """
    texts = _texts(docs)
    held = _lines_with_entities(texts).df if held is None else held
    n = float(texts.agg(F.sum(F.size(F.split("text", "\n")))).first()[0] or 0)
    # copies of a line become one row with their number
    lines = held.groupBy("at").agg(F.count("*").alias("n"), F.first("met").alias("met"))
    lines = Stored(lines, "distinct_entity_lines").df
    entities = lines.select("n", F.explode(F.expr("array_distinct(transform(met, m -> m.entity))")).alias("entity")).groupBy("entity").agg(F.sum("n").alias("c_e"), F.count("*").alias("lines"))
    entities = entities.where((F.col("lines") >= support) & (F.col("c_e") < n)).select("entity", "c_e")
    near = lines.select("at", "n", F.explode("met").alias("m")).select("at", "n", "m.entity", F.explode("m.terms").alias("term"))
    joint = near.groupBy("entity", "term", "at").agg(F.max("n").alias("n")).groupBy("entity", "term").agg(F.sum("n").alias("c_et"), F.count("*").alias("lines"))
    joint = Stored(joint.join(entities, "entity"), "joint")
    words = texts.select(F.explode(F.split("text", "\n")).alias("line")).select(F.explode(F.expr(_terms("line"))).alias("term")).groupBy("term").agg(F.count("*").alias("c_t"))
    words = Stored(words, "words").df
    share = lambda both, seen: F.log2(F.lit(n) * F.col(both) / (F.col("c_e") * F.col(seen))) / F.log2(F.lit(n) / F.col("c_e"))
    found = joint.df.where(F.col("lines") >= support).join(words, "term").withColumn("disclosed", share("c_et", "c_t")).where(F.col("disclosed") >= generalise)
    found = Stored(found.select("entity", "term", "c_e", "disclosed"), "found").df
    # stems of the terms found, with the counts of all words that have them
    wanted = found.select("entity", "term", "c_e", F.explode(F.expr(_stems("term"))).alias("stem"))
    shared = words.select("c_t", F.explode(F.expr(_stems("concat(term, ' ')"))).alias("stem")).join(wanted.select("stem").distinct(), "stem", "left_semi")
    shared = shared.groupBy("stem").agg(F.sum("c_t").alias("c_s"), F.count("*").alias("words")).where("words > 1")
    together = joint.df.select("entity", "c_et", F.explode(F.expr(_stems("concat(term, ' ')"))).alias("stem"))
    together = together.join(wanted.select("entity", "stem").distinct(), ["entity", "stem"], "left_semi").groupBy("entity", "stem").agg(F.sum("c_et").alias("c_es"))
    general = wanted.join(shared, "stem").join(together, ["entity", "stem"]).where(share("c_es", "c_s") < generalise)
    general = general.groupBy("entity", "term").agg(F.max(F.struct(F.length("stem").alias("n"), "stem")).getField("stem").alias("general"))
    return found.select("entity", "term", "disclosed").join(general, ["entity", "term"], "left")


def find(docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """``doc_id, text, base, added`` of each row; both are arrays of ``kind, s, e, value``.

    ``added`` has the kinds ``general`` (to be generalised; ``value`` is what takes its place) and
    ``term`` (to be removed).
    """
    texts = _texts(docs)
    held = _lines_with_entities(texts).df
    terms = Stored(disclosing_terms(docs, support, generalise, held), "disclosing")
    none = F.expr(f"cast(array() as array<struct<{SPAN}>>)")
    rows = texts.withColumn("base", base_spans("text"))
    if terms.df.isEmpty():
        return rows.select("doc_id", "text", "base", none.alias("added"))
    entities = held.select("k1", "k2", F.explode(F.expr("transform(met, m -> m.entity)")).alias("entity")).distinct()
    # where several entities are at stake, the surest disclosure and the shortest stem count
    risks = entities.join(terms.small(), "entity").groupBy("k1", "k2", "term").agg(F.max("disclosed").alias("disclosed"), F.min(F.struct(F.coalesce(F.length("general"), F.lit(0)).alias("n"), "general")).getField("general").alias("general"))
    fate = F.when((F.col("disclosed") >= remove) | F.col("general").isNull(), F.lit("")).otherwise(F.concat("general", F.lit("*")))
    hits = Stored(risks.groupBy("k1", "k2").agg(F.map_from_entries(F.collect_list(F.struct("term", fate.alias("fate")))).alias("terms")), "disclosing_by_text")
    located = rows.join(hits.small(), ["k1", "k2"], "left")
    # only the few listed terms are gathered, so the fold over all words stays linear
    tokens = spans_of("text", "term", r"\p{L}+", f"length(x.hits) >= {TERM_CHARS} and map_contains_key(terms, lower(x.hits))")
    chosen = F.expr(
        "transform(filter(_tokens, t -> not exists(base, b -> t.s < b.e and t.e > b.s)), "
        "t -> named_struct('kind', if(terms[lower(t.value)] = '', 'term', 'general'), 's', t.s, 'e', t.e, 'value', if(terms[lower(t.value)] = '', t.value, terms[lower(t.value)])))"
    )
    located = located.withColumn("_tokens", F.when(F.col("terms").isNotNull(), tokens).otherwise(none))
    return located.select("doc_id", "text", "base", F.when(F.col("terms").isNotNull(), chosen).otherwise(none).alias("added"))


def sanitised(found: DataFrame) -> DataFrame:
    """``doc_id, text`` with every span of ``find`` replaced by its kind, or by its stem and a star; of overlapping ones the first and longest counts."""
    order = "array_sort(concat(base, added), (a, b) -> if(a.s <> b.s, a.s - b.s, b.e - a.e))"
    text = (
        f"aggregate({order}, named_struct('at', 0, 'out', ''), (a, x) -> if(x.s < a.at, a, named_struct('at', x.e, 'out', "
        "concat(a.out, substr(text, a.at + 1, x.s - a.at), case x.kind when 'term' then '[REMOVED]' when 'general' then x.value else concat('[', upper(x.kind), ']') end))), "
        "a -> concat(a.out, substr(text, a.at + 1)))"
    )
    return found.select("doc_id", F.expr(text).alias("text"))


def digests(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: counts, digest of the base spans, and all spans as a string."""
    found = find(docs, **options)
    listed = "array_join(transform({0}, x -> concat_ws(':', x.kind, x.s, x.e)), ',')"
    count = lambda kind: F.expr(f"cast(size(filter(base, x -> x.kind = '{kind}')) as bigint)").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(F.expr(listed.format("base")).cast("binary"), 256).alias("base_sha256"), F.expr(listed.format("concat(base, added)")).alias("spans"))
