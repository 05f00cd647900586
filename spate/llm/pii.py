"""PII: pattern spans, and terms that disclose the entities behind them.

Native: DataFrame functions only.

Base spans (e-mail, ip, card, phone) are found by one regular expression per
kind whose matches are taken together with the gaps before them, so that
positions are sums of lengths (code points).  The found values are the
protected entities, and so is what rare values have in common: the domain and
the name parts of an e-mail address, the network of an ip, the first six digits
of a card or phone (pools), because one text alone says little of its entity.
Information-theoretic sanitisation then asks how much a word of the text
reveals an entity or a pool e: with counts over the whole corpus,

    PMI(t; e) = log2(N * low(n(t, e), n(t)) / n(e))     IC(e) = -log2(n(e) / N)

where low is the lower end of Wilson's one-sided 90 % interval of the share
n(t, e) / n(t).  A term discloses e in a text that holds both when
PMI >= IC(e) - BITS, that is when at most BITS bits of e stay hidden.  A term
of a single text never has that evidence; one that is met with e in two
different texts and nowhere else has.  Every entity and every term, of any
length, is judged.  The broader form of a term of more than three characters
is all words with its first three; it is counted and judged like a term.  A
disclosing term is generalised to its broader form where that discloses
nothing in the text, and removed otherwise.

All counts and N are numbers of different texts: copies of one text count once.

Null texts are empty: no spans.  Null ids and repeated rows are kept row by
row.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spate.llm.common import stage

#: Bits of an entity that a term may leave hidden and still disclose it.
BITS = 1.0
#: Normal quantile of the one-sided 90 % bound on the share of a term's texts that hold the entity.
Z = 1.2816
#: Characters that a term's broader form keeps.
BROAD = 3
KINDS = ("email", "ip", "card", "phone")

#: The contract's patterns, started only where a leftmost match can start and
#: with possessive repeats (no repeat here can match again in a shorter form),
#: so that long texts neither backtrack nor nest.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap necessary conditions, so that most texts skip the exact search.
GUARDS = {
    "email": r"@[A-Za-z0-9-]+\.",
    "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){15}",
    "phone": r"\+[0-9]",
}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_TERM = r"[\p{L}\p{N}]++"
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "removed": "[REMOVED]"}


def _found(text: Column, kind: str, group: int) -> Column:
    """Gaps (group 1) or matches (group 2) of a kind, in order; empty where the guard rules a match out."""
    every = F.regexp_extract_all(text, F.lit(rf"(?s)\G(.*?)({PATTERNS[kind]})"), F.lit(group))
    return F.when(text.rlike(GUARDS[kind]), every).otherwise(F.array().cast("array<string>"))


def _total(lengths: Column, n: Column) -> Column:
    return F.aggregate(F.slice(lengths, F.lit(1), n), F.lit(0), lambda a, x: a + x)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(acc, i):
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        d = _digits(value)
        return F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``__email`` ... ``__phone``: arrays of (kind, start, end, value), start ascending."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumns({f"__g_{k}": _found(t, k, 1) for k in KINDS} | {f"__h_{k}": _found(t, k, 2) for k in KINDS})
    out = out.withColumns(
        {f"__gl_{k}": F.transform(f"__g_{k}", F.length) for k in KINDS} | {f"__hl_{k}": F.transform(f"__h_{k}", F.length) for k in KINDS}
    )

    def spans(kind):
        def one(value, i):
            start = _total(F.col(f"__gl_{kind}"), i + 1) + _total(F.col(f"__hl_{kind}"), i)
            return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"))

        return F.filter(F.transform(f"__h_{kind}", one), lambda s: _valid(kind, s["value"]))

    out = out.withColumns({f"__{k}": spans(k) for k in KINDS})
    return out.drop(*[f"__{p}_{k}" for p in ("g", "h", "gl", "hl") for k in KINDS])


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _entities(span: Column) -> Column:
    """Names of what a span protects: its value without writing variants, and the pools the value belongs to."""
    kind, low, digits = span["kind"], F.lower(span["value"]), _digits(span["value"])
    value = F.when(kind.isin("card", "phone"), digits).otherwise(low)
    pool = (
        F.when(kind == "email", F.substring_index(low, "@", -1))
        .when(kind == "ip", F.substring_index(low, ".", 3))
        .otherwise(F.substring(digits, 1, 6))
    )
    names = F.filter(F.split(F.substring_index(low, "@", 1), "[^a-z]+"), lambda x: F.length(x) >= 3)
    parts = F.when(kind == "email", F.transform(names, lambda x: F.concat(F.lit("name:"), x))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(F.concat_ws(":", kind, value), F.concat_ws(":", F.lit("pool"), kind, pool)), parts)


def _broader(term: Column) -> Column:
    """The broader form of a lower-case term; null where it has none.  No term holds an asterisk."""
    return F.when(F.length(term) > BROAD, F.concat(F.substring(term, 1, BROAD), F.lit("*")))


def _terms(words: Column) -> Column:
    """The different terms of a text and their broader forms."""
    low = F.array_distinct(F.transform(words, F.lower))
    return F.concat(low, F.array_distinct(F.filter(F.transform(low, _broader), lambda x: x.isNotNull())))


def _low(k: Column, n: Column) -> Column:
    """Lower end of Wilson's interval of the share k / n."""
    p, zz = k / n, Z * Z
    return (p + zz / (2 * n) - Z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n)


def survey(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Stage table, one row per document: id, text hash, base spans; for texts with entities also their
    entities and words (the word with the characters before it)."""
    t = F.coalesce(F.col(text), F.lit(""))
    src = base_spans(docs.select(F.col(doc_id).alias("doc_id"), t.alias("text")), "text")
    every = F.concat(*[F.col(f"__{k}") for k in KINDS])
    src = src.withColumn("spans", every).withColumn("h", F.sha1(F.col("text").cast("binary")))
    some = F.size("spans") > 0
    gap = F.regexp_extract_all("text", F.lit(rf"(?s)\G(.*?)({_TERM})"), F.lit(1))
    word = F.regexp_extract_all("text", F.lit(rf"(?s)\G(.*?)({_TERM})"), F.lit(2))
    return stage(
        src.select(
            "doc_id", "h", "spans",
            F.when(some, F.array_distinct(F.flatten(F.transform("spans", _entities)))).alias("entities"),
            F.when(some, F.transform(gap, F.length)).alias("gaps"),
            F.when(some, word).alias("words"),
        ),
        "pii-survey",
    )


def disclosures(found: DataFrame, docs: DataFrame, text: str, bits: float = BITS) -> DataFrame:
    """(h, term, broader): the terms that disclose an entity, for each text that holds both; ``broader`` is
    null where the term has to be removed."""
    ent = found.filter("entities is not null").select("h", F.explode("entities").alias("e")).distinct()
    # Entities of the same texts have the same counts with every term: they are judged as one.
    key = [F.bit_xor(F.xxhash64(F.lit(k), "h")).alias(f"e{k}") for k in (1, 2)]
    n_e = ent.groupBy("e").agg(F.count(F.lit(1)).alias("n_e"), *key)
    # The bound is at most n / (n + Z^2) for n texts, so entities and terms of fewer texts than this cannot pass.
    least = Z * Z / (2**bits - 1)
    entities = stage(ent.join(n_e.filter(F.col("n_e") >= least), "e").select("h", "n_e", "e1", "e2").distinct(), "pii-entities")
    words = found.filter("words is not null").dropDuplicates(["h"]).select("h", F.explode(_terms(F.col("words"))).alias("t"))
    n = float(found.select("h").distinct().count())
    # The bound lies below n(t, e) / n(t), and n(t, e) <= n(e).
    within = lambda most: F.col("n_t") <= most * (2**bits)
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", F.sha1(F.col("text").cast("binary"))).dropDuplicates(["h"])
    term = _terms(F.regexp_extract_all("text", F.lit(_TERM), F.lit(0)))
    n_t = texts.select(F.explode(term).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n_t")).filter(F.col("n_t") >= least)
    most = F.lit(entities.agg(F.max("n_e")).first()[0] or 0)
    n_t = stage(n_t.filter(within(most)).join(words.select("t").distinct(), "t", "left_semi"), "pii-terms")
    pairs = stage(words.join(n_t, "t").join(entities, "h").filter(within(F.col("n_e"))), "pii-pairs")
    pmi = F.log2(F.lit(n) * _low(F.col("n_te"), F.col("n_t")) / F.col("n_e"))
    ic = F.log2(F.lit(n) / F.col("n_e"))
    judged = pairs.groupBy("t", "e1", "e2", "n_e", "n_t").agg(F.count(F.lit(1)).alias("n_te"))
    judged = judged.filter((ic > 0) & (pmi >= ic - bits)).select("t", "e1", "e2")
    shown = stage(pairs.join(judged, ["t", "e1", "e2"], "left_semi").select("h", "t").distinct(), "pii-shown")
    wide = shown.filter(F.col("t").endswith("*")).select("h", F.col("t").alias("broader"), F.lit(True).alias("telling"))
    out = shown.filter(~F.col("t").endswith("*")).withColumn("broader", _broader(F.col("t"))).join(wide, ["h", "broader"], "left")
    return out.select("h", F.col("t").alias("term"), F.when(F.col("telling").isNull(), F.col("broader")).alias("broader"))


def term_spans(found: DataFrame, revealed: DataFrame) -> DataFrame:
    """(h, terms): spans of the disclosing terms of each text, by kind and start; positions are running sums over its words."""
    some = found.filter("words is not null").join(revealed.select("h").distinct(), "h", "left_semi")
    some = some.select("h", "spans", "gaps", "words").dropDuplicates(["h"])
    rows = some.select("h", "spans", F.posexplode(F.arrays_zip("gaps", "words")).alias("i", "w")).select(
        "h", "spans", "i", F.lower("w.words").alias("term"), F.length("w.words").alias("size"), (F.col("w.gaps") + F.length("w.words")).alias("step")
    )
    end = F.sum("step").over(Window.partitionBy("h").orderBy("i")).cast("int")
    at = rows.withColumn("end", end)
    # Words of the entity itself belong to its base span.
    at = at.filter(~F.exists("spans", lambda s: (s["start"] < F.col("end")) & (s["end"] > F.col("end") - F.col("size"))))
    at = at.drop("spans").join(revealed, ["h", "term"])
    span = F.struct(
        F.when(F.col("broader").isNull(), "removed").otherwise("term").alias("kind"),
        (F.col("end") - F.col("size")).alias("start"), F.col("end"), F.coalesce("broader", "term").alias("value"),
    )
    # By kind, then start, like the base spans.
    return at.groupBy("h").agg(F.sort_array(F.collect_list(span)).alias("terms"))


def _spans(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    found = survey(docs, doc_id, text)
    revealed = stage(disclosures(found, docs, text), "pii-disclosures")
    return found, stage(term_spans(found, revealed), "pii-term-spans")


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    found, terms = _spans(docs, doc_id, text)
    joined = found.select("doc_id", "h", "spans").join(terms, "h", "left")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    extra = F.when(F.col("terms").isNotNull(), _written("terms")).otherwise(F.lit(""))
    base = _written("spans")
    return joined.select(
        F.col("doc_id").alias(doc_id), *[count(k) for k in KINDS],
        F.sha2(base, 256).alias("base_sha256"),
        F.array_join(F.filter(F.array(base, extra), lambda x: x != ""), ",").alias("spans"),
    )


_SPAN = "array<struct<start:int,end:int,label:string>>"


def _merged(spans: Column) -> Column:
    """Spans in order of their start, overlapping ones as one under the first one's label."""

    def add(acc, s):
        last = F.element_at(acc, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["label"].alias("label"))
        head = F.slice(acc, F.lit(1), F.size(acc) - 1)
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] > s["start"]), F.concat(head, F.array(joined)).cast(_SPAN)).otherwise(
            F.concat(acc, F.array(s)).cast(_SPAN)
        )

    return F.aggregate(F.array_sort(spans), F.array().cast(_SPAN), add)


def sanitise(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every base span replaced by its label, and disclosing terms removed or generalised.

    Null texts stay null, repeated rows stay, an empty table gives none; texts without spans come back as they are."""
    _, terms = _spans(docs, doc_id, text)
    columns = docs.columns
    src = base_spans(docs, text).withColumn("__k", F.sha1(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    src = src.join(terms.select(F.col("h").alias("__k"), F.col("terms").alias("__terms")), "__k", "left")
    every = F.concat(*[F.col(f"__{k}") for k in KINDS], F.coalesce("__terms", F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")))
    label = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    marks = F.transform(every, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["kind"] == "term", s["value"]).otherwise(label[s["kind"]]).alias("label")))
    src = src.withColumn("__cut", _merged(marks.cast(_SPAN)))

    def piece(s, i):
        before = F.when(i > 0, F.try_element_at("__cut", i)["end"]).otherwise(F.lit(0))
        return F.concat(F.substring(F.col(text), before + 1, s["start"] - before), s["label"])

    tail = F.substring(F.col(text), F.element_at("__cut", -1)["end"] + 1, F.length(text))
    clean = F.when(F.size("__cut") > 0, F.concat(F.array_join(F.transform("__cut", piece), ""), tail)).otherwise(F.col(text))
    return src.withColumn(text, clean).select(*columns)
