"""Personal data: exact formats, and information-theoretic sanitisation of the terms about them.

Spans of e-mail addresses, IP addresses, card and phone numbers are protected entities. Words about an entity may give it away: over the
whole corpus, df counts the documents of every word and of every entity, and n those that have both, wherever they stand. A word is a run of
three or more letters with no letter or digit about it; n and what is sanitised leave out words inside entities.
What a word discloses of an entity is their pointwise mutual information as a share of the entity's information content,
log2(n * N / (df_word * df_entity)) / log2(N / df_entity): 1 if the entity stands wherever the word does. Words that share at least two documents
with an entity and disclose more than a threshold of it are generalised or, above a higher one, removed, wherever they stand in a document with that entity.

The patterns are written so that a failed attempt is never retried inside the same run of characters, so time is linear in the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salvora.session import cut

KINDS = ("email", "ip", "card", "phone")
ACTIONS = ("generalise", "remove")
#: Matches of a block, and slots of word hashes, of which those in use are broadcast.
BLOCK, TERM_SLOTS = 128, 1 << 20
#: Documents that a word and an entity share at least, and shares of an entity's information from which a word is generalised or removed.
SUPPORT, GENERALISE, REMOVE = 2, 0.7, 0.9

# A run that must be taken whole is possessive, and starts where a match before it ended or where no such run goes on.
_PATTERN = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must have for a match of the kind: spares the others the longer pattern.
_HINT = {"email": "@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
_TERM = r"(?<![\p{L}\p{N}])\p{L}{3,}+(?![\p{L}\p{N}])"
_SPAN = "array<struct<start:bigint,end:bigint,value:string>>"


def located(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of the pattern's matches, in code points from 0, end exclusive.

    An array grows by copying, so matches are gathered in blocks and these put together: of n matches some n * n / BLOCK are copied.
    """
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    empty = lambda: F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(_SPAN).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        hit = F.array(F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("value")))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.when(x["hit"].isNotNull(), hit).otherwise(F.array().cast(_SPAN))).alias("spans"))

    def joined(acc: Column, block: Column) -> Column:
        moved = F.transform(block["spans"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end"), s["value"].alias("value")))
        return F.struct((acc["at"] + block["at"]).alias("at"), F.concat(acc["spans"], moved).alias("spans"))

    def whole(p: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.size(p), F.lit(BLOCK))
        blocks = F.transform(firsts, lambda first: F.aggregate(F.slice(p, first, F.lit(BLOCK)), empty(), step))
        return F.aggregate(blocks, empty(), joined, lambda acc: acc["spans"])

    return F.transform(F.array(pairs), whole)[0]  # names the pairs, which a lambda would else find anew for each block


def luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def step(acc: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _valid(kind: str, value: Column) -> Column | None:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.regexp_like(value, F.lit(r"^0*+(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{0,2})(?:\.0*+(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{0,2})){3}$"))
    if kind == "card":
        return luhn(digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return None


def spans_of(text: Column, kind: str) -> Column:
    """Spans of one base kind; text must not be null."""
    found = F.when(F.regexp_like(text, F.lit(_HINT[kind])), located(text, _PATTERN[kind])).otherwise(F.array().cast(_SPAN))
    return found if kind == "email" else F.filter(found, lambda s: _valid(kind, s["value"]))


def _words_of(rows: DataFrame) -> DataFrame:
    """(row, term, start, end): words of the texts of rows (row, text, entities) outside all entities; linear in a text, whose pieces are rows."""
    pieces = rows.select("row", "entities", F.posexplode(F.arrays_zip(F.split("text", _TERM, -1).alias("gap"), F.regexp_extract_all("text", F.lit(_TERM), F.lit(0)).alias("hit"))).alias("i", "x"))
    size = F.coalesce(F.length("x.hit"), F.lit(0)).cast("bigint")
    end = F.sum(F.length("x.gap") + size).over(Window.partitionBy("row").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    words = pieces.withColumn("end", end).filter("x.hit is not null").withColumn("start", F.col("end") - size)
    outside = ~F.exists("entities", lambda e: (F.col("start") < e["end"]) & (e["start"] < F.col("end")))
    return words.filter(outside).select("row", F.lower("x.hit").alias("term"), "start", "end")


def sanitise(docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE, keep_text: bool = False) -> DataFrame:
    """(doc_id, email, ip, card, phone, terms[, text]) for every row of docs (doc_id, text).

    The four kinds are arrays of spans; terms are array<struct<action, start, end>> in the order of actions and starts. With
    keep_text, text is the sanitised text too. Null texts count as empty, empty texts have no spans. Repeated rows each give a row and each count as a document; so do
    rows without a doc_id. An entity that every document has discloses nothing. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id"), text.alias("text")).select("doc_id", "text", *(spans_of(F.col("text"), k).alias(k) for k in KINDS))
    base = base.withColumn("entities", F.concat(*KINDS))
    base = cut(base.withColumn("row", F.monotonically_increasing_id()).withColumn("body", F.when(F.size("entities") > 0, F.col("text"))).drop(*(() if keep_text else ("text",))))

    total = base.count()
    held = base.filter(F.size("entities") > 0).select("row", F.explode(F.array_distinct(F.transform("entities", lambda e: e["value"]))).alias("entity"))
    entities = cut(held.groupBy("entity").agg(F.count("*").alias("df_entity")).filter(F.col("df_entity") >= support))
    held = cut(held.join(entities.select("entity"), "entity"))
    shared = base.select("row", F.col("body").alias("text"), "entities").join(held.select("row").distinct(), "row", "left_semi")
    places = cut(_words_of(shared))
    pairs = held.join(places.select("row", "term").distinct(), "row").groupBy("entity", "term").agg(F.count("*").alias("n")).filter(F.col("n") >= support)
    pairs = cut(pairs)
    # document counts only of words that stand with an entity: a filter of a fixed number of slots goes out first
    slot = F.pmod(F.xxhash64("term"), F.lit(TERM_SLOTS))
    own = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_TERM), F.lit(0)), F.lower))
    words = docs.select(F.explode(own).alias("term")).withColumn("slot", slot).join(F.broadcast(pairs.select(slot.alias("slot")).distinct()), "slot", "left_semi").groupBy("term").agg(F.count("*").alias("df_term"))
    known = words.join(pairs, "term").join(entities, "entity")
    n = F.lit(float(total))
    mutual, content = F.log2(F.col("n") * n / (F.col("df_term") * F.col("df_entity"))), F.log2(n / F.col("df_entity"))
    share = F.when(content > 0, mutual / content).otherwise(F.lit(0.0))
    disclosing = known.select("entity", "term", share.alias("share")).filter(F.col("share") >= generalise)
    worst = held.join(disclosing, "entity").groupBy("row", "term").agg(F.max("share").alias("share")).join(places, ["row", "term"])
    action = F.when(F.col("share") >= remove, F.lit("remove")).otherwise(F.lit("generalise"))
    terms = worst.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(action.alias("action"), "start", "end"))).alias("terms"))
    out = base.join(terms, "row", "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<struct<action:string,start:bigint,end:bigint>>")))
    if keep_text:
        out = out.withColumn("text", _sanitised(F.col("text")))
    return out.drop("row", "entities", "body")


def _sanitised(text: Column) -> Column:
    """text with entities named by their kind, disclosing words as [word] or gone; of overlapping entities the first holds."""
    put = lambda spans, what: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), what(s).alias("by")))
    every = F.concat(*(put(F.col(k), lambda s, k=k: F.lit(f"[{k.upper()}]")) for k in KINDS), put(F.col("terms"), lambda s: F.when(s["action"] == "remove", F.lit("")).otherwise(F.lit("[word]"))))

    def step(acc: Column, s: Column) -> Column:
        free = s["start"] >= acc["at"]
        grown = F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), s["by"])
        return F.struct(F.when(free, s["end"]).otherwise(acc["at"]).alias("at"), F.when(free, grown).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    return F.aggregate(F.array_sort(every), start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))


def op5_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of all documents."""
    named = lambda kind: F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))
    base = F.concat(*map(named, KINDS))
    terms = F.transform("terms", lambda t: F.concat_ws(":", t["action"], t["start"], t["end"]))
    return sanitise(docs).select("doc_id", *(F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS), F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(F.concat(base, terms), ",").alias("spans"))
