"""Personal data: base patterns, and terms that give protected entities away.

Base: email, ip, card and phone matches are the protected entities. Method:
the words of all documents that mention an entity, mentions left out, are its
possible giveaways. How much a term t reveals of an entity e is their pointwise
mutual information, ln(p(e | t) / p(e)), as a share of the entity's information,
-ln p(e). p(e) is a share of all documents; p(e | t) is the share of t's
documents that mention e, smoothed by ``smooth`` documents that mention e as
often as any: (together + smooth p(e)) / (df + smooth). So an entity mentioned
once has giveaways, and a term is the surer the more documents bear it out.

That a word is rare doesn't make it a giveaway. ``likely`` is the least p(e | t),
however large the corpus. And where words that tell as much are usual in the
entity's documents, as in texts full of rare words or in copies, none of them
stands out: of an entity's terms, those that tell most count as long as their
occurrences are no more than ``usual`` of the words of its documents, terms of
the same level (``LEVELS`` a unit of the share) all or none.

At ``general`` of the information or more such a term is generalised to a class,
at ``remove`` it is removed, in all documents that mention the entity.

Terms are runs of letters and their marks, of any length. Documents are rows:
copies count each, in all counts alike, so a copied passage reveals as much.

Column expressions only. Of the texts, only those with mentions are stored.

Null and empty texts have no spans. Rows are told apart by id and text, so
repeated rows all get their spans, null ids too. Of terms that two entities
give away, the severer action counts. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearbit.llm.common import barrier, set_aside, stored

KINDS = ("email", "ip", "card", "phone")
# Possessive, and anchored where a run of characters begins or the last match ended: linear in the text, and the same
# leftmost matches, since the first part of a match always reaches to the end of its run.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What each kind becomes.
TAGS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>", "term": "<TERM>", "cut": ""}
WORD = r"\p{L}[\p{L}\p{M}]*+"
#: Documents of no evidence that every estimate starts from.
SMOOTH = 1.0
GENERAL, REMOVE = 0.6, 0.85
#: Least likelihood of the entity given the term, and the share of words that giveaways may take up.
LIKELY, USUAL = 0.3, 0.05
#: Steps in which shares are compared.
LEVELS = 1_000

#: Matches that are summed in one go.
RUN = 256

SPAN = "struct<start:bigint,end:bigint,value:string>"


def _none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, with the value computed once: inside a function of elements it would be at each."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def running(lengths: Column) -> Column:
    """The sum up to each element, in runs of ``RUN``: an array that grows by an element a step is copied at each."""

    def sums(values: Column, start: Column) -> Column:
        zero = F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("out"))
        step = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"] + n)).alias("out"))
        return F.aggregate(values, zero, step, lambda acc: acc["out"])

    none = F.lit(0).cast("bigint")
    total = lambda r: F.aggregate(r, none, lambda acc, n: acc + n)
    cut = lambda all_: F.transform(F.sequence(F.lit(0), F.greatest(F.size(all_) - 1, F.lit(0)), F.lit(RUN)), lambda i: F.slice(all_, i + 1, F.lit(RUN)))
    added = lambda runs: F.flatten(F.zip_with(runs, sums(F.transform(runs, total), none), lambda r, end: sums(r, end - total(r))))
    return _once(lengths, lambda all_: _once(cut(all_), added))


def spans_of(text: Column, pattern: str) -> Column:
    """All matches with their code point offsets, from the text between them."""

    def placed(found: Column) -> Column:
        between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        ends = running(F.zip_with(found, between, lambda m, b: (F.length(b) + F.length(m)).cast("bigint")))
        return F.zip_with(found, ends, lambda m, end: F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("value")).cast(SPAN))

    return _once(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def each(i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        twice = 2 * d
        return F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), each), F.lit(0), lambda a, b: a + b)
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))
    n = F.length(_digits(value))
    if kind == "card":
        return F.when((n >= 13) & (n <= 19), _luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    return F.lit(True)


def base(text: Column, kind: str) -> Column:
    """Spans of one kind; cheap tests come first, since most texts have none."""
    may = {
        "email": F.contains(text, F.lit("@")),
        "phone": F.contains(text, F.lit("+")),
        "ip": F.contains(text, F.lit(".")) & text.rlike(r"[0-9]\.[0-9]++\.[0-9]"),
        "card": text.rlike(r"[0-9](?:[ -]?[0-9]){12}"),
    }[kind]
    return F.when(may, F.filter(spans_of(text, PATTERNS[kind]), lambda s: _valid(kind, s["value"]))).otherwise(_none())


def with_base(df: DataFrame, text: Column) -> DataFrame:
    """Adds ``_email``, ``_ip``, ``_card`` and ``_phone``."""
    for kind in KINDS:
        df = barrier(df, **{f"_{kind}": base(text, kind)})
    return df


def _words(text: Column) -> Column:
    """Words, lower case; those of addresses are none. The other kinds hold no letters."""
    rest = F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, PATTERNS["email"], " ")).otherwise(text)
    return F.regexp_extract_all(F.lower(rest), F.lit(WORD), F.lit(0))


def _terms(text: Column) -> Column:
    """Words, once each."""
    return F.array_distinct(_words(text))


def _entities() -> Column:
    """The entities that a row mentions, once each."""
    return F.array_distinct(F.concat(*[F.transform(f"_{k}", lambda s, k=k: F.concat(F.lit(f"{k}:"), s["value"])) for k in KINDS]))


def flagged_terms(mentions: DataFrame, rows: DataFrame, *, smooth: float = SMOOTH, general: float = GENERAL, remove: float = REMOVE, likely: float = LIKELY, usual: float = USUAL) -> DataFrame:
    """``(_row, entity, term, share, action)`` for each row's terms that give an entity of it away.

    ``mentions``: ``(_row, _entities, _t)`` of the rows that mention any, ``_row`` unique; ``rows``: all, as ``_t``.
    """
    each = mentions.select("_row", F.explode("_entities").alias("entity"))
    n = float(max(1, rows.count()))
    # Entities of the same documents have all counts in common, so one of them stands for all: a document with thousands
    # that no other mentions does not pair each with each of its terms.
    h = F.xxhash64("_row")
    rated = each.groupBy("entity").agg(F.count("*").alias("docs"), F.sum(h.bitwiseAND(0xFFFFFFFF)).alias("s"), F.bit_xor(h).alias("x"))
    entities = stored(rated.where(F.col("docs") < n).groupBy("docs", "s", "x").agg(F.min("entity").alias("entity")).select("entity", "docs"), "entities")
    each = each.join(entities.select("entity").hint("merge"), "entity", "left_semi")
    most = entities.agg(F.max("docs")).first()[0] or 1
    # Even if all its documents mention the commonest entity, a term of more documents reveals too little: nothing that
    # could be flagged is lost, and common words go. Half a document more, for rounding.
    bound = F.lit(min(n * (most / n) ** general, (most + smooth) / likely) + 0.5)
    # Counted before the join, not after: tasks send a count a word, and no occurrence is joined.
    words = rows.select(F.explode(_terms(F.col("_t"))).alias("term")).groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") <= bound)
    said = mentions.select("_row", F.explode(_words(F.col("_t"))).alias("term")).groupBy("_row", "term").agg(F.count("*").alias("times"))
    pairs = stored(said.join(words.hint("merge"), "term").join(each.hint("merge"), "_row"), "pairs")
    counted = pairs.groupBy("entity", "term", "df").agg(F.count("*").alias("together"), F.sum("times").alias("times"))
    p = F.col("docs") / n
    given = (F.col("together") + smooth * p) / (F.col("df") + smooth)
    scored = counted.join(entities.hint("merge"), "entity").withColumn("share", F.log(given / p) / -F.log(p)).where((F.col("share") >= general) & (given >= likely))
    scored = stored(scored.withColumn("level", F.floor(F.col("share") * LEVELS)).select("entity", "term", "share", "times", "level"), "scored")
    # What the terms of a level and above take up of the entity's documents: a row for each entity and level.
    length = mentions.select("_row", F.size(_words(F.col("_t"))).alias("n_words"))
    long = each.join(length.hint("merge"), "_row").groupBy("entity").agg(F.sum("n_words").alias("n_words"))
    above = F.sum("times").over(Window.partitionBy("entity").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, 0))
    taken = scored.groupBy("entity", "level").agg(F.sum("times").alias("times")).withColumn("above", above)
    least = taken.join(long.hint("merge"), "entity").where(F.col("above") <= usual * F.col("n_words")).groupBy("entity").agg(F.min("level").alias("least"))
    telling = scored.join(least.hint("merge"), "entity").where(F.col("level") >= F.col("least"))
    action = F.when(F.col("share") >= remove, "cut").otherwise("term").alias("action")
    return pairs.select("_row", "entity", "term").join(telling.select("entity", "term", "share", action).hint("merge"), ["entity", "term"])


def _term_spans(mentions: DataFrame, flagged: DataFrame) -> DataFrame:
    """``(_doc, _mark, _term)``: spans of flagged terms, whole words, in the rows that mention their entity; in addresses none."""
    told = flagged.groupBy("_row", "term").agg(F.min("action").alias("kind"))
    # A row for each word and a running sum, since arrays that grow by a word and lookups in a map are quadratic.
    found, between = F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)), F.split("_t", WORD, -1)
    every = F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda m, b: F.struct(F.lower(m).alias("term"), F.length(b).cast("bigint").alias("gap"), F.length(m).cast("bigint").alias("n")))
    words = mentions.select("_row", F.posexplode(every).alias("i", "w")).select("_row", "i", "w.*")
    at = F.sum(F.col("gap") + F.col("n")).over(Window.partitionBy("_row").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    words = words.select("_row", "term", "n", at.alias("end")).join(told.hint("merge"), ["_row", "term"])
    # In order, with the furthest end of the addresses that begin before a word ends: beyond the word's start, they overlap.
    of_words = words.select("_row", (F.col("end") - 1).alias("at"), F.lit(1).alias("late"), F.lit(None).cast("bigint").alias("far"), (F.col("end") - F.col("n")).alias("start"), "end", "kind")
    address = mentions.select("_row", F.explode("_email").alias("e"))
    address = address.select("_row", F.col("e.start").alias("at"), F.lit(0).alias("late"), F.col("e.end").alias("far"), "e.start", "e.end", F.lit(None).cast("string").alias("kind"))
    before = Window.partitionBy("_row").orderBy("at", "late").rowsBetween(Window.unboundedPreceding, 0)
    apart = of_words.union(address).withColumn("far", F.max("far").over(before)).where(F.col("kind").isNotNull() & (F.coalesce("far", F.lit(0)) <= F.col("start")))
    spans = apart.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("_term"))
    got = mentions.select("_row", "_doc", "_mark").join(spans.hint("merge"), "_row").dropDuplicates(["_doc", "_mark"])
    return got.select("_doc", "_mark", "_term")


def _prepared(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = df.select(F.col(doc_id).alias("_doc"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    return rows.withColumn("_mark", F.xxhash64("_t"))


def find(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **thresholds) -> DataFrame:
    """``(_doc, _mark, _email, _ip, _card, _phone, _term)`` for every row, in spans of code points.

    ``_mark`` hashes the text; with the id it tells rows apart.
    """
    rows = _prepared(df, doc_id, text)
    cols = [f"_{k}" for k in KINDS]
    held = barrier(with_base(rows, F.col("_t")), _entities=_entities())
    # One pass for spans and mentions: texts without mentions are not kept.
    held = held.select("_doc", "_mark", *cols, "_entities", F.when(F.size("_entities") > 0, F.col("_t")).alias("_t"), F.monotonically_increasing_id().alias("_row"))
    held = stored(held, "spans")
    narrow, mentions = held.select("_doc", "_mark", *cols), held.where("_t is not null")
    flagged = stored(flagged_terms(mentions, rows, **thresholds), "flagged")
    empty = F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>")
    if not flagged.limit(1).count():
        return narrow.withColumn("_term", empty)
    terms = stored(_term_spans(mentions, flagged), "terms")
    same = [F.col("x._doc").eqNullSafe(F.col("y._doc")), F.col("x._mark") == F.col("y._mark")]
    return narrow.alias("x").join(terms.alias("y").hint("merge"), same, "left").select(*[f"x.{c}" for c in ("_doc", "_mark", *cols)], F.coalesce("y._term", empty).alias("_term"))


def described(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))


def sanitised(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **thresholds) -> DataFrame:
    """All rows and columns, whatever their names, with base spans generalised to their tag, giveaway terms generalised or removed."""
    found = find(df, doc_id=doc_id, text=text, **thresholds)

    def named(kind: str) -> Column:
        return F.transform(f"_{kind}", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    each = found.select("_doc", "_mark", F.explode(F.concat(*map(named, KINDS), F.col("_term"))).alias("s")).select("_doc", "_mark", "s.*").distinct()
    # Spans that overlap become one, under the tag of the first: it ends where the next begins behind all before it.
    order = Window.partitionBy("_doc", "_mark").orderBy("start", "end", "kind")
    each = each.withColumn("far", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    each = each.withColumn("range", F.sum(F.when(F.col("start") < F.col("far"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ranges = each.groupBy("_doc", "_mark", "range").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", "end", "kind")).alias("kind"))
    edits = ranges.groupBy("_doc", "_mark").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("_edits"))
    rows, back = set_aside(df, doc_id, text)
    names = rows.columns
    rows = rows.withColumn("_mark", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    same = [F.col(f"x.{doc_id}").eqNullSafe(F.col("y._doc")), F.col("x._mark") == F.col("y._mark")]
    got = rows.alias("x").join(edits.alias("y").hint("merge"), same, "left").select(*[F.col(f"x.{c}") for c in names], F.col("y._edits").alias("_edits"))
    t = F.col(text)
    tag = lambda k: F.coalesce(*[F.when(k == kind, F.lit(v)) for kind, v in TAGS.items()], F.lit(""))
    # What stands between the edits, each with the tag before it.
    first = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("end"), F.lit("").alias("kind")))
    last = F.array(F.struct(F.length(t).cast("bigint").alias("start"), F.length(t).cast("bigint").alias("end"), F.lit("").alias("kind")))
    parts = F.zip_with(F.concat(first, "_edits"), F.concat("_edits", last), lambda e, n: F.concat(tag(e["kind"]), F.substring(t, (e["end"] + 1).cast("int"), (n["start"] - e["end"]).cast("int"))))
    return got.withColumn(text, F.when(F.col("_edits").isNull(), t).otherwise(F.array_join(parts, ""))).select(*back)
