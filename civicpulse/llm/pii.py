"""Personal data in texts: base patterns, and identifiers found by bootstrapped contexts.

Only DataFrame functions: regular expressions and array functions find spans, joins and aggregates
score patterns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicpulse.llm.common import fresh, keyed_rows

KINDS = ("email", "ip", "card", "phone")

# The contract's expressions. Possessive quantifiers and look-behinds don't change what they match:
# a failed start inside a run of a class fails like the run's start. They keep the time linear.
_LOCAL = "[A-Za-z0-9._%+-]"
EXPRESSIONS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Words with a digit may be identifiers; ends of punctuation don't belong to them.
TOKEN = r"(?<!\S)(?=[^\s0-9]*+[0-9])\S++"
#: Two such words or more of digits, dots, hyphens and brackets, one beside the other, are one candidate.
_NUMBER = r"""(?=[^\s0-9]*+[0-9])[0-9().\[\]-]++(?=["'>},;:!?]*+(?!\S))"""
RUN = rf"""(?<!\S)["'<{{]*+{_NUMBER}(?:\x20(?:[.-]\x20)?+{_NUMBER})++"""
#: An e-mail address with "at" in brackets, or a wide sign, for the at-sign; its dots may be "dot" in brackets.
_OPENS, _CLOSES = r"\x20?+[(\[{<]\x20?+", r"\x20?+[)\]}>]\x20?+"
MAIL = (
    rf"(?<!{_LOCAL}){_LOCAL}++(?:{_OPENS}(?i:at){_CLOSES}|\uFF20)"
    rf"[A-Za-z0-9-]++(?:(?:\.|{_OPENS}(?i:dot){_CLOSES})[A-Za-z0-9-]++)++"
)
#: What a text with such a match has; most texts have none of it, and one look for the first spares them the search.
_NEEDED = {
    "email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]", "token": "[0-9]", "run": "[0-9]",
    "mail": r"(?i)[(\[{<]\x20?at\x20?[)\]}>]|\uFF20",
}
_BEFORE = r"""^[("'<\[{]+"""
#: A run keeps the bracket of an area code.
_BEFORE_RUN = r"""^(?:["'<\[{]|\((?![0-9]++\)))+"""
_AFTER = r"""[)"'>\]},.;:!?]+$"""

#: Numbers after those of the kinds: candidates of any kind, and those that can be e-mail addresses only.
OPEN, OPEN_MAIL = len(KINDS), len(KINDS) + 1
#: Digits of a candidate from which it can be an identifier; one with fewer only speaks against a pattern.
LEAST_DIGITS = 4
#: Distinct values of a kind that a context needs before it is a pattern.
SUPPORT = 3
#: Confidence from which a pattern speaks for its instances, and finds identifiers in the end.
SPEAKS, FINDS = 0.5, 0.8
#: Values that a pattern is smoothed by.
SMOOTHING = 1.0
ROUNDS = 3
#: Array elements whose running sum is taken at once.
_STRIDE = 256


def _with(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), 0)


def running_sums(values: Column) -> Column:
    """The sum before each element of an array of longs, in steps so that long arrays stay cheap."""
    none = F.array().cast("array<long>")

    def sums(part: Column) -> Column:
        begin = F.struct(F.lit(0).cast("long").alias("sum"), none.alias("out"))
        grown = lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.array_append(acc["out"], acc["sum"]).alias("out"))
        return F.aggregate(part, begin, grown, lambda acc: acc["out"])

    def joined(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x))
        return F.flatten(F.zip_with(blocks, sums(totals), lambda part, base: F.transform(sums(part), lambda x: x + base)))

    def cut(all_values: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(all_values), F.lit(_STRIDE))
        return F.transform(starts, lambda at: F.slice(all_values, at, F.lit(_STRIDE)))

    return _with(values, lambda v: F.when(F.size(v) > 0, _with(cut(v), joined)).otherwise(none))


def _matches(text: Column, expression: str) -> Column:
    return F.regexp_extract_all(text, F.lit(expression), F.lit(0))


def _spans(pieces: Column, found: Column) -> Column:
    """start, end, value and the text before it, of all matches, from what lies between them."""
    steps = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, f: (F.length(p) + F.length(f)).cast("long"))
    spans = F.transform(
        F.arrays_zip(F.slice(pieces, 1, F.size(found)).alias("gap"), found.alias("value"), running_sums(steps).alias("base")),
        lambda z: F.struct(
            (z["base"] + F.length(z["gap"])).alias("start"),
            (z["base"] + F.length(z["gap"]) + F.length(z["value"])).alias("end"),
            z["value"].alias("value"),
            context(z["gap"]).alias("context"),
        ),
    )
    return spans


def context(gap: Column) -> Column:
    """The last two words of the text before a match, in lower case; blank where there are fewer.

    Looked for from the back, so that it costs a look per character however far away a word begins.
    """
    near = F.reverse(F.regexp_extract(F.reverse(gap), r"^\s*+(?:\S++(?:\s++\S++)?+)?+", 0))
    return F.trim(F.regexp_replace(F.lower(near), r"\s+", " "))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    doubled = F.array(*(F.lit(d) for d in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)))
    back = F.reverse(digits)

    def value(at: Column) -> Column:
        digit = F.substring(back, at, F.lit(1)).cast("int")
        return F.when(at % 2 == 1, digit).otherwise(F.element_at(doubled, digit + 1))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, at: a + value(at)) % 10 == 0


_TOO_LARGE = r"(?:^|\.)0*+(?:25[6-9]|2[6-9][0-9]|[3-9][0-9]{2}|[1-9][0-9]{3,}+)(?:\.|$)"


def _digits(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", ""))


def _holds(kind: str, value: Column) -> Column:
    """Whether a match of a kind's expression counts."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return ~value.rlike(_TOO_LARGE)
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _counting(kind: str, spans: Column) -> Column:
    return F.filter(spans, lambda s: _holds(kind, s["value"]))


def _of_kind(number: int, spans: str, *fields: str) -> Column:
    """Spans as structs of the kind's number and some fields."""
    return F.transform(spans, lambda s: F.struct(F.lit(number).alias("kind"), *(s[f].alias(f) for f in fields)))


_SPAN = "array<struct<start:bigint,end:bigint,value:string,context:string>>"


def _found(text: Column, expression: str, needed: str) -> Column:
    """All matches; texts that can't have one aren't searched."""
    return F.when(text.rlike(needed), _matches(text, expression))


def base_spans(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, key, for each kind the spans that count, the words with digits, runs of them, and written-out e-mails."""
    rows = keyed_rows(docs)
    searched = {**EXPRESSIONS, "token": TOKEN, "run": RUN, "mail": MAIL}
    for kind, expression in searched.items():
        rows = rows.withColumn(f"{kind}_found", _found(F.col("text"), expression, _NEEDED[kind]))
    for kind, expression in searched.items():
        found = F.col(f"{kind}_found")
        pieces = F.split("text", expression, -1)
        rows = rows.withColumn(f"{kind}_pieces", F.when(F.size(found) > 0, pieces))
    spans = {}
    for kind in searched:
        all_spans = _spans(F.col(f"{kind}_pieces"), F.col(f"{kind}_found"))
        if kind in KINDS:
            all_spans = _counting(kind, all_spans)
        spans[kind] = F.when(F.size(f"{kind}_found") > 0, all_spans).otherwise(F.array().cast(_SPAN)).alias(kind)
    return rows.select("doc_id", "key", *spans.values())


def _trimmed(spans: str, number: int, before: str) -> Column:
    """Spans as structs of a number, without the punctuation at their ends."""
    return F.transform(spans, lambda s: F.struct(
        F.lit(number).alias("kind"),
        (s["start"] + F.length(s["value"]) - F.length(F.regexp_replace(s["value"], before, ""))).alias("start"),
        (s["end"] - F.length(s["value"]) + F.length(F.regexp_replace(s["value"], _AFTER, ""))).alias("end"),
        F.regexp_replace(F.regexp_replace(s["value"], before, ""), _AFTER, "").alias("value"),
        s["context"].alias("context"),
    ))


def _mentions(found: DataFrame) -> DataFrame:
    """Base spans, and candidates that overlap none of them, once per (doc_id, key).

    Candidates are runs, written-out e-mails, and the words with digits that are in neither; the
    words of a run that overlaps a base span stay candidates of their own.
    """
    parts = [_of_kind(n, kind, "start", "end", "value", "context") for n, kind in enumerate(KINDS)]
    run = OPEN_MAIL + 1
    more = [_trimmed("token", OPEN, _BEFORE), _trimmed("run", run, _BEFORE_RUN), _of_kind(OPEN_MAIL, "mail", "start", "end", "value", "context")]
    rows = found.select("doc_id", "key", F.explode(F.concat(*parts, *more)).alias("m")).select("doc_id", "key", "m.*").distinct()
    base = F.col("kind") < len(KINDS)
    # What follows is looked at in falling order: such a frame only grows, so a row is looked at once.
    places = [F.col(c) for c in ("start", "kind", "end")]
    rising, falling = (Window.partitionBy("doc_id", "key").orderBy(*order) for order in (places, [c.desc() for c in places]))
    so_far = (Window.unboundedPreceding, Window.currentRow)
    before = F.max(F.when(base, F.col("end"))).over(rising.rowsBetween(*so_far))
    after = F.min(F.when(base, F.col("start"))).over(falling.rowsBetween(*so_far))
    clear = (F.coalesce(before, F.lit(0)) <= F.col("start")) & (F.coalesce(after, F.col("end")) >= F.col("end"))
    rows = rows.withColumn("clear", base | clear).where("clear").drop("clear")
    up, down = (Window.partitionBy("doc_id", "key").orderBy(c) for c in (F.col("start"), F.col("start").desc()))
    until = F.max(F.when(F.col("kind") > OPEN, F.col("end"))).over(up.rangeBetween(*so_far))
    # A word may begin in an address's bracket, so its end counts too.
    since = F.min(F.when(F.col("kind") > OPEN, F.col("start"))).over(down.rangeBetween(*so_far))
    inside = (F.coalesce(until, F.lit(0)) > F.col("start")) | (F.coalesce(since, F.col("end")) < F.col("end"))
    rows = rows.withColumn("inside", (F.col("kind") == OPEN) & inside).where("not inside").drop("inside")
    return rows.withColumn("kind", F.when(F.col("kind") == run, OPEN).otherwise(F.col("kind")))


def _can_be(candidate: Column, kind: Column) -> Column:
    """Whether a candidate can be of a kind: a written-out e-mail is nothing else."""
    return (candidate != OPEN_MAIL) | (kind == KINDS.index("email"))


def _patterns(mentions: DataFrame) -> DataFrame:
    """Each mention with its contexts: the two words before it, and the last of them."""
    last = F.substring_index("context", " ", -1)
    both = F.array_distinct(F.array(F.concat(F.lit("2 "), "context"), F.concat(F.lit("1 "), last)))
    return mentions.where("context <> ''").withColumn("pattern", F.explode(both))


def _scored(edges: DataFrame) -> DataFrame:
    """pattern, kind, confidence: the graph of patterns and values, scored in turns.

    A pattern's confidence for a kind is the smoothed share of its values that are of the kind, a
    value not yet known counting by its score; a value's score is the chance that one of its
    patterns that speak for the kind is right. Only numbers per pattern and value are exchanged.
    """
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("size"))
    known = edges.where(F.col("kind") < len(KINDS)).select("pattern", "value", "kind", F.lit(1.0).alias("score"))
    open_edges = edges.where(F.col("kind") >= OPEN).select("pattern", "value", F.col("kind").alias("candidate"))
    votes = known
    for turn in range(ROUNDS):
        weight = votes.groupBy("pattern", "kind").agg(F.sum("score").alias("weight"), F.count("*").alias("values"))
        scores = (
            weight.where(F.col("values") >= SUPPORT).join(sizes, "pattern")
            .select("pattern", "kind", (F.col("weight") / (F.col("size") + SMOOTHING)).alias("confidence"))
        ).checkpoint()
        if turn == ROUNDS - 1:
            return scores
        speaking = scores.where(F.col("confidence") >= SPEAKS)
        heard = open_edges.join(speaking, "pattern").where(_can_be(F.col("candidate"), F.col("kind"))).groupBy("value", "kind").agg(
            (1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score")
        )
        votes = known.union(open_edges.join(heard, "value").select("pattern", "value", "kind", "score"))


def found_by_context(found: DataFrame) -> DataFrame:
    """Identifiers that no base expression matches: doc_id, key, and kind, start and end of each."""
    mentions = _patterns(_mentions(found)).checkpoint()
    edges = mentions.groupBy("pattern", "value").agg(F.min("kind").alias("kind"))
    sure = _scored(edges).where(F.col("confidence") >= FINDS).withColumnRenamed("kind", "of")
    best = F.max_by(F.col("of"), F.struct(F.col("confidence"), -F.col("of"))).alias("kind")
    return (
        mentions.where((F.col("kind") == OPEN_MAIL) | (F.col("kind") == OPEN) & (_digits(F.col("value")) >= LEAST_DIGITS))
        .join(sure, "pattern").where(_can_be(F.col("kind"), F.col("of"))).drop("kind")
        .groupBy("doc_id", "key", "start", "end").agg(best)
    )


def _written(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, key, all_spans, n_email, n_ip, n_card, n_phone, base_sha256 and spans.

    Offsets count code points of the whole text, ends are exclusive. The numbers and the digest are
    of the base spans alone; ``spans`` has those found by context too, of the kind of their pattern.
    A null or empty text has none; repeated rows have equal results, a row each; an empty table
    gives an empty one. A candidate is a run of words of digits, a word with a digit, or an e-mail address
    with "(at)" or the like; one that overlaps a base span isn't looked at again.
    """
    found = base_spans(docs).checkpoint()
    more = found_by_context(found).groupBy(F.col("doc_id").alias("more_id"), F.col("key").alias("more_key")).agg(
        F.collect_list(F.struct("kind", "start", "end")).alias("more")
    )
    parts = [_of_kind(n, kind, "start", "end") for n, kind in enumerate(KINDS)]
    base = found.select("doc_id", "key", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), F.concat(*parts).alias("base"))
    joined = base.join(more, base.doc_id.eqNullSafe(more.more_id) & (base.key == more.more_key), "left")
    every = F.when(F.col("more").isNotNull(), F.array_sort(F.concat("base", "more"))).otherwise(F.col("base"))
    return joined.select(
        "doc_id", "key", every.alias("all_spans"), *(f"n_{k}" for k in KINDS), F.sha2(_written(F.col("base")), 256).alias("base_sha256")
    ).withColumn("spans", _written(F.col("all_spans")))


def masked(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with each span of personal data in ``text`` replaced by its kind.

    Spans that overlap are replaced together, under the first one's kind. A null text stays null.
    """
    key, number, spans, of, same = (fresh(docs.columns, n) for n in ("key", "number", "spans", "_of", "_with"))
    found = personal_data(docs).where(F.size("all_spans") > 0).select(
        F.col("doc_id").alias(of), F.col("key").alias(same), F.col("all_spans").alias(spans)
    ).dropDuplicates([of, same])
    named = docs.withColumns({key: F.xxhash64(F.coalesce("text", F.lit(""))), number: F.col("doc_id").cast("long")})
    joined = named.join(found, named[number].eqNullSafe(found[of]) & (named[key] == found[same]), "left")
    text, names = F.col("text"), F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def cut(acc: Column, s: Column) -> Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(gap, F.element_at(names, s["kind"] + 1)))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    rest = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.length(text)))
    clean = F.when(F.col(spans).isNull(), text).otherwise(F.aggregate(by_start, empty, cut, rest))
    return joined.withColumn("text", clean).select(*docs.columns)
