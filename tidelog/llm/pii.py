"""Personal data: patterns, and terms that give a protected value away.

Base spans are e-mail addresses, IP addresses, card and phone numbers, found by pattern with
offsets in code points. A value found this way is a protected entity. Terms of the texts that hold
an entity are then judged by what the corpus says about them: with p(e) the share of the corpus'
terms that stand in texts with entity e, the entity's information is -log2 p(e), and a term t tells
log2(p(e, t) / (p(e) p(t))) of it. A term that tells at least ``disclose`` of the information is a
span as well, wherever it stands in a text with the entity: from ``remove`` on it is removed, below
it is generalised to its class.

How strongly a term reveals an entity is an estimate, so p(e, t) is taken at its lower confidence
bound: seen in k different contexts of the entity, the count is lowered by ``confidence`` times its
standard error, that is by 1/sqrt(k) of itself each. A word that stands by an address once, however
rare, has the bound 0 and stays, whatever the size of the corpus; a name that stands by it in one
text after the other goes. Copies of a text count as occurrences, but are one context.

Counts cover the whole corpus: every term of every text, every text of every entity. A word is a
run of letters with single ' or - inside, whatever stands around it; words of an address are none.
A term is a word of three letters or more, a context the sequence of a text's terms. Entities that
occur in the same texts have equal counts and are judged once. Contexts are joined with entities by
distinct term, and only where the bound can still be met: entities of several contexts, terms that
are not too common for the entity. Places are looked up at the end, for the terms found. Texts
without an entity keep their words.

Everything is DataFrame code. Defined cases: NULL and empty texts have no spans; equal texts have
equal spans, so spans are joined by the text's hash and repeated rows or ids do no harm; extra
columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import land, skew_join

# Fixed: the kinds in the order of the result. Runs are taken whole (possessive) and start where
# no character of the same run stands in front, which changes no match and keeps the search linear.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# a text without this character or digit has no match
NEEDS = {"email": "@", "phone": "+"}
TERM = "term"
WORD = r"\p{L}++(?:['-]\p{L}++)*+"
TERM_LETTERS = 3
RUN = 64
# standard errors that a count is lowered by
CONFIDENCE = 1.0
DISCLOSE, REMOVE = 0.85, 0.95
SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"
TERMS = "array<struct<start:int,end:int,act:string>>"


def _luhn(digits: Column) -> Column:
    """Whether the digit string passes the checksum."""

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        double = digit * 2 - F.when(digit > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 1, double).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        small = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.concat(F.lit("0"), F.substring(F.ltrim(p, F.lit("0")), 1, 3)).cast("int") <= 255)
        return F.forall(F.split(value, r"\."), small)
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(F.lit(False))
    return F.length(digits).between(9, 15)


def _let(value: Column, body) -> Column:
    """``body`` of the value, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _located(text: Column, pattern: str) -> Column:
    """ARRAY<STRUCT<start, end, value>> of the matches, in code points, end exclusive.

    Places are summed up within runs of RUN matches, then over the runs, as arrays are copied to be appended to.
    """
    kind = "array<struct<start:int,end:int,value:string>>"
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # what stands in front of each match, and behind the last
    between = F.split(text, pattern, -1)

    def add(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["between"])
        end = start + F.length(pair["match"])
        one = F.struct(start.alias("start"), end.alias("end"), pair["match"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

    first = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
    cut = lambda pairs: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / RUN).cast("int")),
        lambda n: F.aggregate(F.slice(pairs, n * RUN + 1, F.lit(RUN)), first, add),
    )
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    starts = lambda runs: F.aggregate(
        runs, begin, lambda s, r: F.struct((s["at"] + r["at"]).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"]
    )
    shift = lambda run, by: F.transform(
        run["out"], lambda w: F.struct((w["start"] + by).alias("start"), (w["end"] + by).alias("end"), w["value"].alias("value"))
    )
    whole = lambda runs: F.flatten(F.zip_with(runs, starts(runs), shift))
    pairs = F.arrays_zip(F.slice(between, F.lit(1), F.size(matches)).alias("between"), matches.alias("match"))
    return F.when(F.regexp_like(text, F.lit(pattern)), _let(pairs, lambda p: _let(cut(p), whole))).otherwise(F.array().cast(kind))


def _kind_spans(text: Column, kind: str) -> Column:
    valid = F.filter(_located(text, PATTERNS[kind]), lambda m: _valid(kind, m["value"]))
    named = F.transform(valid, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"], m["end"], m["value"]))
    there = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else F.regexp_like(text, F.lit("[0-9]"))
    return F.when(there, named.cast(SPANS)).otherwise(F.array().cast(SPANS))


def base_spans(text: Column) -> Column:
    """ARRAY<STRUCT<kind, start, end, value>>: by kind as listed, then by start."""
    return F.concat(*[_kind_spans(text, kind) for kind in KINDS])


def text_key(text: Column) -> Column:
    return F.struct(F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("g"))


def _without_addresses(text: Column) -> Column:
    """The text with spaces for every e-mail address: the only entities with letters."""
    pattern = PATTERNS["email"]
    blank = lambda front, match: F.concat(front, F.repeat(F.lit(" "), F.coalesce(F.length(match), F.lit(0))))
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    blanked = F.array_join(F.zip_with(F.split(text, pattern, -1), matches, blank), "")
    return F.when(F.contains(text, F.lit(NEEDS["email"])), blanked).otherwise(text)


def _terms_of(text: Column) -> Column:
    return F.filter(_located(_without_addresses(text), WORD), lambda w: F.length(w["value"]) >= TERM_LETTERS)


def _texts(docs: DataFrame, text: str) -> DataFrame:
    """One row per text with entities: key, copies, context, entities, terms with their places."""
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("spans", base_spans(F.col("t"))).where(F.size("spans") > 0)
    named = F.transform("spans", lambda s: F.concat_ws(":", s["kind"], F.lower(s["value"])))
    words = F.transform(_terms_of(F.col("t")), lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), F.lower(w["value"]).alias("value")))
    rows = rows.select(text_key(F.col("t")).alias("key"), F.array_distinct(named).alias("entities"), words.alias("words"))
    rows = rows.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.first("entities").alias("entities"), F.first("words").alias("words"))
    return rows.withColumn("context", text_key(F.array_join(F.transform("words", lambda w: w["value"]), " ")))


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, n) over all terms of all texts."""
    words = F.regexp_extract_all(_without_addresses(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD), F.lit(0))
    terms = docs.select(F.explode(words).alias("term")).where(F.length("term") >= TERM_LETTERS)
    return terms.select(F.lower("term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def _held(texts: DataFrame, total: int, confidence: float) -> DataFrame:
    """(entity, context, copies, n_e): entities that stand in enough contexts to be judged.

    Entities of the same texts are one. A frequent entity is a hot key, so both joins are those of ``skew_join``.
    """
    held = texts.select("key", "context", "copies", F.size("words").alias("size"), F.explode("entities").alias("name"))
    held = held.withColumn("id", F.xxhash64("name"))
    same = F.struct(F.bit_xor("key.h").alias("h"), F.bit_xor("key.g").alias("g"), F.count(F.lit(1)).alias("n"))
    alike = land(held.groupBy("id", F.col("name").alias("_name")).agg(same.alias("entity")), "pii-entities")
    held = skew_join(held, alike, "id").where("name = _name").select("key", "entity", "context", "copies", "size").distinct()
    held = held.groupBy("entity", "context").agg(F.sum("copies").alias("copies"), F.first("size").alias("size"))
    held = land(held.withColumn("id", F.xxhash64("entity")), "pii-held")
    near = held.groupBy("id", F.col("entity").alias("_entity")).agg(F.sum(F.col("copies") * F.col("size")).alias("n_e"), F.count(F.lit(1)).alias("k"))
    near = land(near.where((F.col("k") > confidence**2) & (F.col("n_e") > 0) & (F.col("n_e") < total)).drop("k"), "pii-judged")
    return skew_join(held, near, "id").where("entity = _entity").select("entity", "context", "copies", "n_e")


def term_pairs(texts: DataFrame, counts: DataFrame, total: int, disclose: float = DISCLOSE, confidence: float = CONFIDENCE) -> DataFrame:
    """(entity, context, term, m, n_e, n_t): m occurrences of a term in a context of an entity, where it could tell enough.

    A term tells at most what it would if all terms around the entity were this one, which needs
    n_t <= n_e * (total / n_e) ** (1 - disclose); and it must occur more often than contexts are asked for.
    """
    held = land(_held(texts, total, confidence), "pii-contexts")
    of_these = texts.join(held.select("context").distinct(), "context", "left_semi").groupBy("context").agg(F.first("words").alias("words"))
    terms = of_these.select("context", F.explode("words.value").alias("term")).groupBy("context", "term").agg(F.count(F.lit(1)).alias("m"))
    known = terms.join(counts.withColumnRenamed("n", "n_t").where(F.col("n_t") > confidence**2), "term")
    most = F.col("n_e") * F.pow(F.lit(float(total)) / F.col("n_e"), F.lit(1 - disclose))
    # a hair above the bound, so that rounding leaves nothing out
    pairs = known.join(held, "context").where(F.col("n_t") <= most * 1.000001)
    return pairs.select("entity", "context", "term", (F.col("m") * F.col("copies")).alias("m"), "n_e", "n_t")


def revealing_terms(pairs: DataFrame, total: int, disclose: float = DISCLOSE, confidence: float = CONFIDENCE) -> DataFrame:
    """(entity, term, share): terms that tell at least ``disclose`` of an entity's information."""
    seen = pairs.groupBy("entity", "term", "n_e", "n_t").agg(F.sum("m").alias("n_et"), F.count(F.lit(1)).alias("k")).where(F.col("k") > confidence**2)
    lower = F.col("n_et") * (1 - F.lit(confidence) / F.sqrt("k"))
    told = F.log2(F.lit(float(total)) * lower / (F.col("n_t") * F.col("n_e")))
    share = told / F.log2(F.lit(float(total)) / F.col("n_e"))
    return seen.select("entity", "term", share.alias("share")).where(F.col("share") >= disclose)


def term_spans(docs: DataFrame, text: str = "text", disclose: float = DISCLOSE, remove: float = REMOVE, confidence: float = CONFIDENCE) -> DataFrame:
    """(key, terms): the places of revealing terms by text. Landed, so that Spark knows its size."""
    texts = land(_texts(docs, text), "pii-texts")
    counts = land(word_counts(docs, text), "pii-words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    pairs = land(term_pairs(texts, counts, total, disclose, confidence), "pii-pairs")
    telling = land(revealing_terms(pairs, total, disclose, confidence), "pii-telling")
    act = F.max(F.when(F.col("share") >= remove, "remove").otherwise("generalise")).alias("act")
    told = land(pairs.join(telling, ["entity", "term"]).groupBy("context", "term").agg(act), "pii-told")
    words = texts.join(told.select("context").distinct(), "context", "left_semi").select("key", "context", F.explode("words").alias("w"))
    places = words.select("key", "context", F.col("w.value").alias("term"), F.col("w.start").alias("start"), F.col("w.end").alias("end"))
    spans = F.sort_array(F.collect_list(F.struct("start", "end", "act"))).cast(TERMS)
    return land(places.join(told, ["context", "term"]).groupBy("key").agg(spans.alias("terms")), "pii-terms")


def _found(docs: DataFrame, text: str, disclose: float, remove: float, confidence: float) -> DataFrame:
    """Add _spans and _terms."""
    added = term_spans(docs, text, disclose, remove, confidence).toDF("_key", "_terms")
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.withColumn("_key", text_key(whole)).join(added, "_key", "left").drop("_key")
    return rows.withColumns({"_spans": base_spans(whole), "_terms": F.coalesce("_terms", F.array().cast(TERMS))})


def find(docs: DataFrame, text: str = "text", disclose: float = DISCLOSE, remove: float = REMOVE, confidence: float = CONFIDENCE) -> DataFrame:
    """Add ``spans`` (base) and ``terms`` (added by the corpus); columns of these names are replaced."""
    rows = _found(docs.drop("spans", "terms"), text, disclose, remove, confidence)
    return rows.withColumnsRenamed({"_spans": "spans", "_terms": "terms"})


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def as_spans(terms: Column) -> Column:
    return F.transform(terms, lambda t: F.struct(F.lit(TERM).alias("kind"), t["start"], t["end"], t["act"].alias("value"))).cast(SPANS)


def sanitised(text: Column, spans: Column, terms: Column) -> Column:
    """The text with base spans replaced by [KIND], terms generalised to [TERM] or removed.

    Overlapping spans are replaced together, by the mark of the first of them.
    """
    kind = "array<struct<start:int,end:int,mark:string>>"
    base = F.transform(spans, lambda s: F.struct(s["start"], s["end"], F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("mark")))
    more = F.transform(terms, lambda t: F.struct(t["start"], t["end"], F.when(t["act"] == "remove", "").otherwise("[TERM]").alias("mark")))
    every = F.sort_array(F.concat(base.cast(kind), more.cast(kind)))

    def merge(state: Column, s: Column) -> Column:
        last = F.element_at(state, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["mark"].alias("mark"))
        joined = F.concat(F.slice(state, F.lit(1), F.size(state) - 1), F.array(longer))
        apart = F.concat(state, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"), s["mark"].alias("mark"))))
        return F.when((F.size(state) > 0) & (F.try_element_at(state, F.lit(-1))["end"] > s["start"]), joined).otherwise(apart)

    whole = F.aggregate(every, F.array().cast(kind), merge)
    after = lambda s, i: F.concat(  # noqa: E731  the mark and what stands between it and the next span
        s["mark"], F.substring(text, s["end"] + 1, F.coalesce(F.get(whole, i + 1)["start"], F.length(text)) - s["end"])
    )
    front = F.substring(text, F.lit(1), F.get(whole, F.lit(0))["start"])
    return F.when(F.size(every) == 0, text).otherwise(F.concat(front, F.array_join(F.transform(whole, after), "")))


def sanitise(docs: DataFrame, text: str = "text", disclose: float = DISCLOSE, remove: float = REMOVE, confidence: float = CONFIDENCE) -> DataFrame:
    """The documents with their texts sanitised; no other column changes. NULL stays NULL."""
    found = _found(docs, text, disclose, remove, confidence)
    return found.withColumn(text, sanitised(F.col(text), F.col("_spans"), F.col("_terms"))).select(*docs.columns)
