"""Personal data: regular seeds, and identifiers found by bootstrapped context.

Seeds are matches of four base patterns that pass their checks, and long quoted hexadecimal strings as seeds of secrets. An
instance is a whole seed match, or else a run of neighbouring tokens that look like identifiers (with a digit or an
at sign). It has two lexical patterns: the two words before it, and the words on either side; a word that is itself
such a token stands as "#". Patterns and instances form a graph, scored in ROUNDS rounds: a pattern's confidence for a
kind is the summed confidence of its distinct instances over their number plus one, and counts only from
SUPPORT up; an instance's confidence is that at least one of its patterns is right. Seeds stay at one.
Occurrences of confident instances in confident patterns are added to the base matches; a seed of a secret is such an
occurrence like any other, so such a string counts as a secret only where its context says so.

The patterns are written for linear time: possessive, and not tried again inside a run that they have left.
Positions are code points, end exclusive, counted from 0.

Defined results: null and empty texts have no spans; equal rows have equal spans; spans of different kinds may
overlap, as each kind is matched by itself; an empty table gives an empty result; a null doc_id is unlike every other;
of the input only doc_id and text are read, so other names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind, cut, doc_key, table

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = 4
# The base patterns, with (?:\G|(?<!x)) for the start of a run of x.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
EDGE = r"^[^\p{L}\p{N}+(@]+|[^\p{L}\p{N})]+$"
SECRET = r"^[\"'](?=[^\"']*[0-9])(?=[^\"']*[a-fA-F])[0-9a-fA-F]{32,}+[\"']"
ROUNDS = 3
SUPPORT = 3.0
CONFIDENT = 0.9
CONTEXT_CHARS = 64
BROADCAST_SPANS = 300_000
_SPAN = "array<struct<s:int,k:int,e:int>>"
_FOUND = "array<struct<s:int,e:int,m:string,before:string,after:string>>"


def matches(text: Column, pattern: str, gate: Column) -> Column:
    """array<struct<s, e, m, before, after>>: the matches of a pattern with their surroundings, where the gate is open.

    before and after hold CONTEXT_CHARS of the text up to the neighbouring match, which stands as "#".
    """

    def placed(found: Column) -> Column:
        gap = lambda i: F.get(found["gaps"], i)
        last = F.size(found["hits"]) - 1

        def step(acc: Column, i: Column) -> Column:
            s = acc["at"] + F.length(gap(i))
            m = F.get(found["hits"], i)
            e = s + F.length(m)
            before = F.when(i > 0, F.concat(F.substring(gap(i - 1), -CONTEXT_CHARS, CONTEXT_CHARS), F.lit("#"), F.substring(gap(i), -CONTEXT_CHARS, CONTEXT_CHARS))).otherwise(F.substring(gap(i), -CONTEXT_CHARS, CONTEXT_CHARS))
            after = F.when(i < last, F.concat(F.substring(gap(i + 1), 1, CONTEXT_CHARS), F.lit("#"))).otherwise(F.substring(gap(i + 1), 1, CONTEXT_CHARS))
            one = F.struct(s.alias("s"), e.alias("e"), m.alias("m"), before.alias("before"), after.alias("after"))
            return F.struct(e.alias("at"), F.concat(acc["all"], F.array(one)).alias("all"))

        many = F.aggregate(F.sequence(F.lit(0), last), F.struct(F.lit(0).alias("at"), F.array().cast(_FOUND).alias("all")), step, lambda acc: acc["all"])
        return F.when(last >= 0, many).otherwise(F.array().cast(_FOUND))

    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    return F.when(gate, bind(both, placed)).otherwise(F.array().cast(_FOUND))


def _luhn(digits: Column) -> Column:
    def value(i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def _passes(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return m.rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|)(?:\.|$)){4}$") & ~m.rlike(r"\.\.|\.$")
    if kind == "card":
        return F.length(digits).between(14, 19) & bind(digits, _luhn)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def base_matches(text: Column) -> Column:
    """array<struct<s, k, e, m, before, after>> of the base matches, by start and kind; k counts KINDS from 0."""
    digits = text.rlike("[0-9]")
    gates = {"email": text.contains("@"), "ip": digits & text.rlike(r"[0-9]\.[0-9]+\.[0-9]"), "card": digits & text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), "phone": text.contains("+")}

    def of(k: int, kind: str, pattern: str) -> Column:
        good = F.filter(matches(text, pattern, gates[kind]), lambda x: _passes(kind, x["m"]))
        return F.transform(good, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), x["m"].alias("m"), x["before"].alias("before"), x["after"].alias("after")))

    parts = [of(k, kind, pattern) for k, (kind, pattern) in enumerate(zip(KINDS, (EMAIL, IP, CARD, PHONE)))]
    return F.sort_array(F.concat(*parts))


def spans_of(found: Column) -> Column:
    """array<struct<s, k, e>> of base matches."""
    return F.transform(found, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))


def _patterns(before: Column, after: Column) -> Column:
    """The lexical patterns of a place, from the text on either side; what adheres to the instance is no context."""
    plain = lambda c: F.lower(F.regexp_replace(c, r"[^\x20\x09-\x0D]*[0-9@#][^\x20\x09-\x0D]*", "#"))
    left, right = plain(F.regexp_replace(before, r"[^\x20\x09-\x0D]+$", "")), plain(F.regexp_replace(after, r"^[^\x20\x09-\x0D]+", ""))
    two = F.regexp_extract(left, r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]+[^\x20\x09-\x0D]+)[\x20\x09-\x0D]+$", 1)
    last = F.regexp_extract(left, r"([^\x20\x09-\x0D]+)[\x20\x09-\x0D]+$", 1)
    following = F.regexp_extract(right, r"^[\x20\x09-\x0D]+([^\x20\x09-\x0D]+)", 1)
    squeeze = lambda c: F.regexp_replace(c, r"[\x20\x09-\x0D]+", " ")
    return F.array_compact(F.array(F.when(two != "", F.concat(F.lit("before:"), squeeze(two))), F.when((last != "") & (following != ""), F.concat(F.lit("around:"), last, F.lit(" _ "), following))))


def runs(found: Column) -> Column:
    """Neighbouring tokens, one character apart, joined to one."""

    def step(acc: Column, x: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        whole = F.struct(last["s"].alias("s"), x["e"].alias("e"), F.concat(last["m"], F.lit(" "), x["m"]).alias("m"), last["before"].alias("before"), x["after"].alias("after"))
        return F.when((F.size(acc) > 0) & (last["e"] + 1 == x["s"]), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(whole))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(found, F.array().cast(_FOUND), step)


def instances(text: Column, base: Column) -> Column:
    """array<struct<s, e, value, k, patterns>>: base matches, and runs of other identifier-like tokens; k is null where unknown."""

    def one(x: Column) -> Column:
        lead = F.length(x["m"]) - F.length(F.regexp_replace(x["m"], r"^[^\p{L}\p{N}+(@]+", ""))

        def trimmed(core: Column) -> Column:
            k = F.when(x["m"].rlike(SECRET), F.lit(BASE))
            s = x["s"] + lead
            return F.struct(s.alias("s"), (s + F.length(core)).alias("e"), F.lower(core).alias("value"), k.alias("k"), _patterns(x["before"], x["after"]).alias("patterns"))

        return bind(F.regexp_replace(x["m"], EDGE, ""), trimmed)

    other = F.filter(matches(text, TOKEN, text.rlike("[0-9@]")), lambda x: ~F.exists(base, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    seeds = F.transform(base, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lower(x["m"]).alias("value"), x["k"].alias("k"), _patterns(x["before"], x["after"]).alias("patterns")))
    return F.concat(seeds, F.transform(bind(other, runs), one))


def _keys() -> list[Column]:
    """What equal rows share: joins by it may not multiply rows, as each key has one row of spans."""
    return [doc_key(), F.xxhash64(F.coalesce("text", F.lit(""))).alias("__hash")]


def scan(documents: DataFrame) -> DataFrame:
    """One pass over the texts: the base spans and the instances of every document, without its text."""
    text = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    based = text.withColumn("base", base_matches(F.col("text")))
    return based.select("doc_id", *_keys(), spans_of(F.col("base")).alias("base"), instances(F.col("text"), F.col("base")).alias("tokens"))


def discovered(scanned: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(__doc, __hash, more): the spans that the context adds, for documents that have any."""
    instance = scanned.select("__doc", "__hash", F.explode("tokens").alias("t")).select("__doc", "__hash", "t.*").filter("size(patterns) > 0 and value <> ''")
    links = cut(instance.select("value", "k", F.explode("patterns").alias("pattern")).distinct(), narrow=True)
    seeds = links.filter("k is not null").groupBy("value", "k").agg(F.lit(1.0).alias("conf"))
    spread = links.select("pattern", "value").distinct()
    sizes = spread.groupBy("pattern").agg(F.count("*").alias("n"))
    belief, good = seeds, None
    for left in reversed(range(rounds)):
        weight = spread.join(belief, "value").groupBy("pattern", "k").agg(F.sum("conf").alias("w"))
        good = weight.filter(F.col("w") >= SUPPORT).join(sizes, "pattern").select("pattern", "k", (F.col("w") / (F.col("n") + 1)).alias("score")).filter("score >= 0.5")
        good = good if left else cut(good, narrow=True)
        reached = spread.join(good, "pattern").groupBy("value", "k").agg((1 - F.exp(F.sum(F.log1p(-F.least("score", F.lit(0.999)))))).alias("conf"))
        belief = reached.unionByName(seeds).groupBy("value", "k").agg(F.max("conf").alias("conf"))
    sure = good.filter(F.col("score") >= CONFIDENT).select("pattern", "k")
    known = belief.filter(F.col("conf") >= CONFIDENT).select("value", "k")
    fresh = instance.filter(f"k is null or k >= {BASE}").select("__doc", "__hash", "s", "e", "value", F.explode("patterns").alias("pattern"))
    hits = fresh.join(sure, "pattern").join(known, ["value", "k"]).select("__doc", "__hash", F.struct("s", "k", "e").alias("span")).distinct()
    return hits.groupBy("__doc", "__hash").agg(F.collect_list("span").alias("more"))


def _text_of(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def personal_spans(documents: DataFrame) -> DataFrame:
    """doc_id, the count of base spans by kind, base_sha256, spans (text) and n_found, the spans that context added."""
    scanned = cut(scan(documents))
    joined = scanned.select("doc_id", "__doc", "__hash", "base").join(discovered(scanned), ["__doc", "__hash"], "left")
    more = F.coalesce("more", F.array().cast(_SPAN))
    of_kind = lambda k: F.filter("base", lambda x: x["k"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS[:BASE])]
    return joined.select(
        "doc_id", *counts, F.sha2(_text_of(F.col("base")).cast("binary"), 256).alias("base_sha256"), _text_of(F.sort_array(F.concat("base", more))).alias("spans"), F.size(more).cast("long").alias("n_found")
    )


def masked(text: Column, spans: Column) -> Column:
    """The text with every span, overlapping ones as one, replaced by its kind in brackets."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def step(acc: Column, x: Column) -> Column:
        fresh = x["s"] >= acc["at"]
        added = F.array(F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.get(names, x["k"]))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(fresh, F.concat(acc["out"], added)).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    whole = F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def masked_documents(documents: DataFrame) -> DataFrame:
    """The documents with personal data masked; n_chars follows the text, a null text stays null."""
    found = cut(discovered(cut(scan(documents))), narrow=True)
    carried = documents.select(*_keys(), F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("__row"))
    # Few documents have a span beyond the base; where they are few enough to send to every task, no text is shuffled.
    few = found.agg(F.sum(F.size("more"))).first()[0] or 0
    joined = carried.join(F.broadcast(found) if few <= BROADCAST_SPANS else found, ["__doc", "__hash"], "left")
    text = F.coalesce("__row.text", F.lit(""))
    spans = joined.withColumn("__spans", F.sort_array(F.concat(spans_of(base_matches(text)), F.coalesce("more", F.array().cast(_SPAN)))))
    new = spans.withColumn("__text", F.when(F.col("__row.text").isNotNull(), bind(F.col("__spans"), lambda s: masked(text, s))))
    values = {"text": F.col("__text")}
    if "n_chars" in documents.columns:
        values["n_chars"] = F.length("__text").cast(documents.schema["n_chars"].dataType)
    return new.select(*[values.get(c, F.col("__row").getField(c)).alias(c) for c in documents.columns])


def query(spark, sf_dir):
    """op6: personal data in the whole of documents."""
    return personal_spans(table(spark, sf_dir, "documents"))
