"""Personal data: patterns, and information-theoretic sanitisation of the texts. DataFrame operations only.

Protected entities are what the patterns find (emails, ip addresses, cards, phones): the values, their parts that many values
share (domain and name of an email, first digits of a number, network of an address), and their kinds. A term discloses an
entity as far as corpus co-occurrence says so: disclosure = PMI(term, entity) / IC(entity), with document frequencies of
whole texts over the whole corpus (after Sanchez and Batet, C-sanitized, 2016). It is 1 for a term that occurs only with
the entity and about 0 for one that occurs everywhere. A term of at least THRESHOLD is a span of kind term wherever it
occurs, in any document, unless chance alone explains it (CHANCE): so entities of few documents count too, as far as the
corpus has few terms as rare as theirs. Copies of a text are one piece of evidence.

Texts are cut into words once; what later steps read is a table of entities and distinct words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logoscope.llm.shared import Workspace

KINDS = ("email", "ip", "card", "phone", "term")
#: Fixed patterns, as possessive forms that match the same spans in linear time. A local part or number that a search
#: would enter in its middle is entered at its start or where the last match ended (\G), as leftmost matching does.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text with a valid match must hold; keeps the patterns off most texts.
HINTS = {"ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}"}
#: Least share of an entity's information that a term discloses: with it, a term of an entity of one in a million
#: documents must meet it in a quarter of its own. Of an entity, terms as frequent as one that would meet it as often by
#: chance: so many are expected at most.
THRESHOLD, CHANCE = 0.9, 0.05
#: First digits of a card or phone number that are an entity of their own.
PREFIX = 6
#: Disclosing terms that are broadcast at most; a shuffle join beyond.
BROADCAST_TERMS = 100_000


def luhn(digits: Column) -> Column:
    turned = F.reverse(digits)

    def add(total, i):
        d = F.substring(turned, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(n.between(12, 19), luhn(digits)).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


SPAN = "array<struct<s:int,k:int,e:int,value:string>>"
PLACE = "array<struct<s:int,k:int,e:int>>"


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def blocks(items: Column) -> Column:
    """An array as an array of about sqrt(n) arrays. Folds that build arrays copy what they have; over blocks that is
    n * sqrt(n) elements and not n * n."""

    def cut(all_):
        width = F.greatest(F.ceil(F.sqrt(F.size(all_))).cast("int"), F.lit(1))
        starts = F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / width).cast("int"))
        return F.when(F.size(all_) > 0, F.transform(starts, lambda i: F.slice(all_, i * width + 1, width)))

    return once(items, cut)


def located(items: Column, advance, hit, span, kind: str) -> Column:
    """Spans of items that lie one after the other: ``span(item, start)`` of each item that ``hit``s, where starts are
    the sums of ``advance(item)`` of the items before."""
    empty = F.array().cast(kind)

    def starts(parts):
        lengths = F.transform(parts, lambda part: F.aggregate(part, F.lit(0), lambda n, x: n + advance(x)))
        state = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        return F.aggregate(lengths, state, step, lambda s: s["out"])

    def of_block(part, at):
        def step(s, x):
            out = F.when(hit(x), F.concat(s["out"], F.array(span(x, s["at"])))).otherwise(s["out"])
            return F.struct((s["at"] + advance(x)).alias("at"), out.alias("out"))

        return F.aggregate(part, F.struct(at.alias("at"), empty.alias("out")), step, lambda s: s["out"])

    found = once(blocks(items), lambda parts: F.flatten(F.zip_with(parts, starts(parts), of_block)))
    return F.coalesce(found, empty)


def matches(text: Column, pattern: str) -> Column:
    """(gap, match) of every match of a pattern: the text since the match before, and the match."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(g.alias("gap"), m.alias("match")))


def spans_of(kind: str, text: Column) -> Column:
    """Valid matches of one kind as SPAN, positions in code points."""
    number = KINDS.index(kind)

    def span(x, at):
        s = at + F.length(x["gap"])
        return F.struct(s.alias("s"), F.lit(number).alias("k"), (s + F.length(x["match"])).alias("e"), x["match"].alias("value"))

    spans = located(matches(text, PATTERNS[kind]), lambda x: F.length(x["gap"]) + F.length(x["match"]), lambda x: valid(kind, x["match"]), span, SPAN)
    hint = text.contains({"email": "@", "phone": "+"}[kind]) if kind not in HINTS else text.rlike(HINTS[kind])
    return F.when(hint, spans).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    return F.array_sort(F.concat(*[spans_of(kind, text) for kind in KINDS[:4]]))


def outside(text: Column) -> Column:
    """``text`` with spaces over its emails, the only base spans that hold letters, so that places stay as they are."""
    pattern = PATTERNS["email"]
    covered = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.repeat(F.lit(" "), F.length(m)))
    both = F.zip_with(F.split(text, pattern, -1), covered, lambda g, m: F.concat(g, F.coalesce(m, F.lit(""))))
    return F.when(text.contains("@"), F.array_join(both, "")).otherwise(text)


def terms_of(text: Column) -> Column:
    """Distinct words of letters, in lower case, and maybe an empty one. Each word is put in lower case by itself, as in
    ``places``; the whole text at once is faster, and the same unless one of two letters occurs."""
    split = lambda x: F.split(x, r"[^\p{L}]+")
    return F.when(text.rlike("[\u03a3\u0130]"), F.array_distinct(F.transform(split(text), F.lower))).otherwise(F.array_distinct(split(F.lower(text))))


def places(text: Column, terms: Column) -> Column:
    """Spans of all words of ``text`` that are among ``terms``."""
    span = lambda x, at: F.struct(at.alias("s"), F.lit(KINDS.index("term")).alias("k"), (at + F.length(x)).alias("e"))
    found = located(F.split(text, r"[^\p{L}]", -1), lambda x: F.length(x) + 1, lambda x: F.array_contains(terms, F.lower(x)), span, PLACE)
    return F.when(terms.isNotNull(), found).otherwise(F.array().cast(PLACE))


def entities_of(base: Column) -> Column:
    """Distinct entities of base spans: values in lower case, their shared parts, and their kinds."""
    name = lambda what, value: F.concat_ws(":", F.lit(what), value)
    of = lambda k, parts: F.flatten(F.transform(F.filter(base, lambda x: x["k"] == KINDS.index(k)), lambda x: parts(F.lower(x["value"]))))
    digits = lambda v: F.substring(F.regexp_replace(v, "[^0-9]", ""), 1, PREFIX)
    emails = of("email", lambda v: F.array(name("email", v), name("name", F.substring_index(v, "@", 1)), name("domain", F.substring_index(v, "@", -1)), F.lit("email")))
    ips = of("ip", lambda v: F.array(name("ip", v), name("network", F.substring_index(v, ".", 2)), F.lit("ip")))
    cards, phones = (of(k, lambda v, k=k: F.array(name(k, v), name(f"{k} prefix", digits(v)), F.lit(k))) for k in ("card", "phone"))
    return F.when(F.size(base) > 0, F.array_distinct(F.concat(emails, ips, cards, phones))).otherwise(F.array().cast("array<string>"))


def level(n: Column) -> Column:
    return F.floor(F.log2(n.cast("double") + 1e-9)).cast("int")


def disclosing_terms(tables: Workspace, words: DataFrame) -> DataFrame:
    """(term) of all terms that disclose an entity, from rows (h, entities, terms).

    Frequencies are of rows, over whole texts: n_t rows hold the term, n_e the entity, n_te both. For evidence against
    chance equal texts count once: ``texts`` is the number of different texts that hold both. A term of more than
    most = n_e ** THRESHOLD * n ** (1 - THRESHOLD) rows can't reach THRESHOLD, so it isn't paired with the entity: both sides meet by
    text and power of two of n_t, so a text of many entities and words makes no more pairs than about twice those that can."""
    frequencies = words.select(F.explode("terms").alias("term")).where("term <> ''").groupBy("term").agg(F.count("*").alias("n_t"))
    frequencies = tables.written(frequencies, "frequencies")
    bearing = words.where(F.size("entities") > 0).groupBy("h").agg(F.count("*").alias("w"), F.first("entities").alias("entities"), F.first("terms").alias("terms"))
    bearing = tables.written(bearing, "classes")
    n = float(max(1, words.count()))
    held = bearing.select("h", "w", F.explode("entities").alias("entity"))
    entities = held.groupBy("entity").agg(F.sum("w").alias("n_e")).where(F.col("n_e") < n)
    entities = tables.written(entities.withColumn("most", F.pow("n_e", F.lit(THRESHOLD)) * n ** (1 - THRESHOLD) * (1 + 1e-9)), "entities")
    most = entities.agg(F.max("most")).first()[0] or 0.0
    met = bearing.select("h", F.explode("terms").alias("term")).join(frequencies.where(F.col("n_t") <= most), "term").withColumn("level", level(F.col("n_t")))
    asked = held.join(entities, "entity").withColumn("level", F.explode(F.sequence(F.lit(0), level(F.col("most")))))
    pairs = asked.join(met, ["h", "level"]).where(F.col("n_t") <= F.col("most"))
    pairs = pairs.groupBy("entity", "term", "n_e", "n_t").agg(F.sum("w").alias("n_te"), F.count("*").alias("texts"))
    alike = frequencies.where(F.col("n_t") <= most).groupBy("n_t").agg(F.count("*").alias("alike"))
    share = F.col("n_e") / n
    gain = F.log2(F.col("n_te") / F.col("n_t") / share) / F.log2(1 / share)
    # Chernoff's bound of the chance that so many texts of the term, or more, are among the entity's
    apart = F.col("n_t") - F.col("n_te")
    every = F.col("texts") + apart
    without = F.when(apart > 0, apart * F.log(apart / every / (1 - share))).otherwise(0.0)
    chance = F.when(F.col("texts") / every > share, F.exp(-(F.col("texts") * F.log(F.col("texts") / every / share) + without))).otherwise(1.0)
    found = pairs.where(gain >= THRESHOLD).join(alike, "n_t").where(F.col("alike") * chance <= CHANCE)
    return tables.written(found.select("term").distinct(), "terms")


def find(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with columns __base and __terms: of every row its spans by pattern, and its spans of disclosing terms.

    Null text counts as empty; repeated rows and ids are rows of their own; an empty table gives no rows; other columns
    may have any names. Statistics are of all rows. Terms lie outside the emails of a text. The terms of texts that have
    some are a table of the shared folder; what led to it is deleted."""
    t = F.coalesce(docs[text_col], F.lit(""))
    with Workspace(docs.sparkSession, "private") as tables:
        read = docs.select(F.xxhash64(t).alias("h"), entities_of(base_spans(t)).alias("entities"), terms_of(outside(t)).alias("terms"))
        words = tables.written(read, "words")
        disclosing = disclosing_terms(tables, words)
        count = disclosing.count()
        every = words.select("h", F.explode("terms").alias("term"))
        hits = every.join(F.broadcast(disclosing) if count <= BROADCAST_TERMS else disclosing, "term")
        marks = tables.kept(hits.groupBy("h").agg(F.collect_set("term").alias("__said")).withColumnRenamed("h", "__h"), "private-marks")
    few = (marks.agg(F.sum(F.size("__said"))).first()[0] or 0) <= BROADCAST_TERMS
    found = docs.withColumn("__base", base_spans(t)).join(F.broadcast(marks) if few else marks, F.xxhash64(t) == F.col("__h"), "left")
    plain = F.transform("__base", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    said = F.when(F.col("__said").isNotNull(), places(outside(t), F.col("__said"))).otherwise(F.array().cast(PLACE))
    return found.select(*[docs[f"`{c}`"] for c in docs.columns], plain.alias("__base"), said.alias("__terms"))


def listed(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"], x["e"])), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_email, n_ip, n_card, n_phone, base_sha256, spans (see ``find``)."""
    def count(k):
        return F.size(F.filter("__base", lambda x: x["k"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    counts = [count(k) for k in range(4)]
    return find(docs, text_col).select(
        F.col(id_col), *counts, F.sha2(listed(F.col("__base")), 256).alias("base_sha256"),
        listed(F.array_sort(F.concat("__base", "__terms"))).alias("spans"),
    )


def sanitise(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``find`` generalised to the name of its kind in brackets; columns and rows as before.

    Of spans that overlap, a later one that ends later gives what it adds. Null texts stay null. A column n_chars, where
    there is one, is renewed for changed texts."""
    text, hit = F.col(text_col), F.size("__spans") > 0
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def last(spans):
        return F.aggregate(spans, F.lit(0), lambda m, x: F.greatest(m, x["e"]))

    def ends(parts):
        """How far the spans before each block reach."""
        state = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda s, m: F.struct(F.greatest(s["at"], m).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        return F.aggregate(F.transform(parts, last), state, step, lambda s: s["out"])

    def of_block(part, at):
        def step(s, x):
            gap = F.substring(text, s["at"] + 1, F.greatest(x["s"] - s["at"], F.lit(0)))
            out = F.when(x["e"] > s["at"], F.concat(s["out"], F.array(gap, F.element_at(names, x["k"] + 1)))).otherwise(s["out"])
            return F.struct(F.greatest(x["e"], s["at"]).alias("at"), out.alias("out"))

        return F.aggregate(part, F.struct(at.alias("at"), F.array().cast("array<string>").alias("out")), step, lambda s: s["out"])

    said = once(blocks(F.col("__spans")), lambda parts: F.flatten(F.zip_with(parts, ends(parts), of_block)))
    clean = F.concat(F.array_join(said, ""), F.substring(text, last(F.col("__spans")) + 1, F.length(text)))
    found = find(docs, text_col).withColumn("__spans", F.array_sort(F.concat("__base", "__terms")))
    changed = found.withColumn(text_col, F.when(hit, clean).otherwise(text))
    if "n_chars" in docs.columns:
        renewed = F.when(hit, F.length(text_col).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        changed = changed.withColumn("n_chars", renewed)
    return changed.select([f"`{c}`" for c in docs.columns])
