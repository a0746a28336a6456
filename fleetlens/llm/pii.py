"""Personal data: base patterns, and terms that reveal protected values by what the corpus says about them. DataFrame functions only."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, release, sent, spans_text, within, written

#: Kinds in the order in which they are listed; the last is the method's.
KINDS = ("email", "ip", "card", "phone", "term")
#: Java patterns that find what the stated ones find. A look-behind lets a run of characters be tried only at its start
#: (or where the last match ended), and quantifiers are possessive where nothing after could use what they give back,
#: so that no text takes quadratic time or a deep stack.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A term is a whole run of letters, marks and digits outside the base spans, in lower case.
TERM = r"[\p{L}\p{M}\p{N}]++"
#: Shares of a value's information that a term may give away: above the first it is generalised, above the second removed.
GENERALISE, REMOVE = 0.75, 0.9
#: Evidence for disclosure: different texts that hold both term and entity, at least, as one meeting proves nothing;
#: pairs of a word and an entity, of all there are, that chance may be expected to bring together as often; and the
#: normal deviate by which the share of a term's texts that hold the entity is bounded from below.
MEETINGS, BY_CHANCE, DEVIATE = 2, 0.05, 1.645
#: The share of a term's texts that hold the entity, by that lower bound, has to be at least this: words of texts of which few copies hold a value tell of the text and not of the value.
LIKELY = 0.4
#: Matches that are walked at once, and spans that are replaced at once.
FEW, PART = 16, 128
#: What a term or a row of spans takes in a task besides its characters and spans.
ROW_BYTES = 96
#: A longer term's ancestor is its stem, its first code points; the next one is its kind, a word or a number.
STEM = 4


def _walked(steps: Column, at: Column) -> Column:
    """(start, end, value) of matches that start at `at` with steps (gap, n, v) between them."""
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.aggregate(
        steps,
        F.struct(at.alias("at"), empty.alias("out")),
        lambda a, x: F.struct((a["at"] + x["gap"] + x["n"]).alias("at"), F.array_append(a["out"], F.struct((a["at"] + x["gap"]).alias("start"), (a["at"] + x["gap"] + x["n"]).alias("end"), x["v"].alias("value"))).alias("out")),
    )["out"]


def _bound(value: Column, use) -> Column:
    """use(value), where value is worked out once."""
    return F.transform(F.array(value), use)[0]


def matches(text: Column, pattern: str | Column) -> Column:
    """(start, end, value) of each match, in code points: the lengths of the pieces between matches and of the matches are summed up.

    An array that grows is copied at each step, so n matches are walked in about the root of n parts, each from where the sums of the parts before it end."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    steps = F.zip_with(values, F.slice(pieces, 1, F.size(values)), lambda v, p: F.struct(F.length(p).alias("gap"), F.length(v).alias("n"), v.alias("v")))

    def in_parts(parts: Column) -> Column:
        lengths = F.transform(parts, lambda x: F.aggregate(x, F.lit(0), lambda a, y: a + y["gap"] + y["n"]))
        starts = F.aggregate(lengths, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda a, n: F.struct((a["at"] + n).alias("at"), F.array_append(a["out"], a["at"]).alias("out")))
        return F.flatten(F.zip_with(parts, starts["out"], _walked))

    def all_of(s: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(s))).cast("int")
        parts = _bound(width, lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / w).cast("int")), lambda i: F.slice(s, i * w + 1, w)))
        return F.when(F.size(s) <= FEW, _walked(s, F.lit(0))).otherwise(_bound(parts, in_parts))

    return _bound(steps, all_of)


def luhn(digits: Column) -> Column:
    def add(a: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        two = d * 2
        return a + F.when(i % 2 == 1, d).when(two > 9, two - 9).otherwise(two)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        plain = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(plain(p)) <= 3) & (F.coalesce(plain(p).try_cast("int"), F.lit(0)) <= 255))
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(12, 19) & luhn(digits)
    return F.length(digits).between(9, 15) if kind == "phone" else F.lit(True)


def _asked(kind: str, text: Column) -> Column:
    """Whether a text can hold the kind at all."""
    return {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]"), "phone": text.rlike(r"\+[0-9]")}[kind]


_SPANS = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"


def base_spans(text: Column) -> Column:
    """Spans of the base kinds by start and then kind as listed."""
    parts = [F.when(_asked(kind, text), _spans_of(text, rank, kind).cast(_SPANS)).otherwise(F.array().cast(_SPANS)) for rank, kind in enumerate(PATTERNS)]
    return F.array_sort(F.concat(*parts))


def _spans_of(text: Column, rank: int, kind: str) -> Column:
    found = F.filter(matches(text, PATTERNS[kind]), lambda m: passes(kind, m["value"]))
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"), m["value"].alias("value")))


def _entity(span: Column) -> Column:
    digits = F.regexp_replace(span["value"], "[^0-9]", "")
    return F.concat(span["kind"], F.lit(":"), F.when(span["kind"] == "email", F.lower(span["value"])).when(span["kind"] == "ip", span["value"]).otherwise(digits))


def _rebuilt(text: Column, spans: Column, fill) -> Column:
    """The text with fill(span, at) in place of what each span (by start) covers; at is where the spans before it end.

    Spans are walked in parts of PART, each over a slice of the text of its own, and all pieces are joined at once, so
    that a text of very many spans takes little more than linear time."""
    ends = lambda own: F.transform(own, lambda s: s["end"])
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / PART).cast("int")), lambda i: F.slice(spans, i * PART + 1, PART))

    def of_part(part: Column, before: Column) -> Column:
        def pieces(own: Column) -> Column:
            def piece(s: Column, at: Column) -> Column:
                return F.concat(F.substr(own, at - before + 1, F.greatest(s["start"] - at, F.lit(0))), fill(s, at))

            return F.array_join(F.transform(part, lambda s, i: _bound(F.greatest(before, F.array_max(ends(F.slice(part, F.lit(1), i)))), lambda at: piece(s, at))), "")

        return _bound(F.substr(text, before + 1, F.greatest(F.array_max(ends(part)) - before, F.lit(0))), pieces)

    def all_of(own: Column) -> Column:
        last = lambda tops: F.transform(own, lambda part, i: of_part(part, F.greatest(F.lit(0), F.array_max(F.slice(tops, F.lit(1), i)))))
        return F.array_join(_bound(F.transform(own, lambda part: F.array_max(ends(part))), last), "")

    rest = F.substr(text, F.array_max(ends(spans)) + 1, F.length(text))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(_bound(parts, all_of), rest))


def _masked(text: Column, spans: Column) -> Column:
    """The text with blanks for what the spans (by start) cover, so that places stay."""
    return _rebuilt(text, spans, lambda s, at: F.repeat(F.lit(" "), F.greatest(s["end"] - F.greatest(s["start"], at), F.lit(0))))


def _forms(rows: DataFrame) -> Column:
    """The distinct terms of a row as they are written."""
    return F.array_distinct(F.regexp_extract_all(_masked(rows["text"], rows["base"]), F.lit(TERM), F.lit(0)))


def _stem(term: Column) -> Column:
    """The stem, which no term equals as it ends in an asterisk; null for a term that is no longer than it."""
    return F.when(F.length(term) > STEM, F.concat(F.substring(term, 1, STEM), F.lit("*")))


def _terms(rows: DataFrame) -> Column:
    """The distinct terms of a row, in lower case, and their stems."""
    return _bound(F.transform(_forms(rows), F.lower), lambda terms: F.array_distinct(F.concat(terms, F.filter(F.transform(terms, _stem), lambda t: t.isNotNull()))))


def _broader(entity: Column) -> Column:
    """What a value belongs to, and what a term may give away where the value itself is met too seldom: an address's domain, the first half of an IP, the first six digits of a card or of a phone."""
    kind, value = F.substring_index(entity, ":", 1), F.substring_index(entity, ":", -1)
    wide = F.when(kind == "email", F.concat(F.lit("@"), F.substring_index(value, "@", -1))).when(kind == "ip", F.substring_index(value, ".", 2)).otherwise(F.substring(value, 1, 6))
    return F.concat(kind, F.lit("*"), wide)


def _witnesses(rows: DataFrame) -> DataFrame:
    """(row, copies, entities), written: one row of each text that holds entities, how many rows have that text, and its entities."""
    own = F.array_distinct(F.transform("base", _entity))
    held = rows.where("size(base) > 0").select("row", "h", F.array_distinct(F.concat(own, F.transform(own, _broader))).alias("entities"))
    return written(held.groupBy("h").agg(F.min("row").alias("row"), F.count("*").alias("copies"), F.min("entities").alias("entities")).drop("h"), "pii-witnesses")


def _entities(witnesses: DataFrame) -> DataFrame:
    """(row, copies, entity, n_entity, entity_rows), written: entities that MEETINGS different texts hold, one for each set of texts, as others give the same counts with any term."""
    found = witnesses.select("row", "copies", F.explode("entities").alias("entity"))
    sums = found.groupBy("entity").agg(F.count("*").alias("n_entity"), F.sum("copies").alias("entity_rows"), F.bit_xor(F.xxhash64("row")).alias("s1"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("s2"))
    first = sums.where(F.col("n_entity") >= MEETINGS).groupBy("n_entity", "s1", "s2").agg(F.min_by(F.struct("entity", "entity_rows"), "entity").alias("e")).select("e.entity", "n_entity", "e.entity_rows")
    return written(found.join(first, "entity").select("row", "copies", "entity", "n_entity", "entity_rows"), "pii-entities")


def log_chance(both: Column, draws: Column, share: Column) -> Column:
    """The logarithm of a bound on the probability that of `draws` texts, each of which holds a thing by chance with `share`, at least `both` do (Chernoff's bound, by relative entropy)."""
    q = both / draws
    entropy = q * F.log(q / share) + F.when(q < 1, (1 - q) * F.log((1 - q) / (1 - share))).otherwise(F.lit(0.0))
    return F.when((q > share) & (share < 1), -draws * entropy).otherwise(F.lit(0.0))


def lower_share(both: Column, n: Column) -> Column:
    """Wilson's lower bound of a share of which `both` of n are seen."""
    q, z2 = both / n, DEVIATE**2
    return (q + z2 / (2 * n) - DEVIATE * F.sqrt(q * (1 - q) / n + z2 / (4 * n * n))) / (1 + z2 / n)


def disclosing(rows: DataFrame, n_texts: int, n_chars: int) -> DataFrame:
    """(term, disclosure), written, of terms and stems that give away at least GENERALISE of some entity's information.

    Disclosure is the pointwise mutual information of term and entity over the entity's own information,
    1 + log p(entity | term) / -log p(entity), from numbers of whole documents: those that hold the entity, the term,
    and both. It is judged by its lower bound, Wilson's for p(entity | term), and only where the meetings are evidence:
    at least MEETINGS, an entity that is LIKELY given the term, and so many that chance would bring together fewer than
    BY_CHANCE of all pairs of a word of the corpus and an entity as often. Shares are of rows; evidence counts different texts, so copies add none. A term's
    disclosure is its greatest over all entities.
    A term is at least as frequent in all rows as in those with entities, and both bounds fall with its frequency, so
    pairs that fail by the latter are dropped before the terms that are left are counted in all rows."""
    witnesses = _witnesses(rows)
    own = _entities(witnesses)
    n = float(max(n_texts, 1))
    n_entities, most = own.agg(F.count_distinct("entity"), F.max(F.col("entity_rows") / F.greatest(F.lit(LIKELY), F.pow(F.col("n_entity") / n, 1 - GENERALISE)))).first()
    pairs = math.log(max(1, n_entities) * max(1, n_chars) / 2)  # a word and what parts it take two characters
    met = own.groupBy("row").agg(F.max("copies").alias("copies"), F.collect_list(F.struct("entity", "n_entity")).alias("entities"))
    held = written(rows.where("size(base) > 0").join(sent(met.select("row", "copies")), "row").select("row", "copies", F.explode(_terms(rows)).alias("term")), "pii-held")
    near = held.groupBy("term").agg(F.count("*").alias("_n"), F.sum("copies").alias("near_rows")).where((F.col("_n") >= MEETINGS) & (F.col("near_rows") <= (most or 0.0))).drop("_n")
    both = held.join(near, "term").join(sent(met.select("row", F.explode("entities").alias("e"))), "row").groupBy("term", "e", "near_rows").agg(F.count("*").alias("n_both"), F.sum("copies").alias("both_rows"))
    both = both.select("term", "e.n_entity", "near_rows", "n_both", "both_rows").where((F.col("n_both") >= MEETINGS) & (F.col("n_entity") < n))

    def judged(term_rows: Column) -> tuple[Column, Column]:
        """Whether the entity is likely and chance ruled out, and disclosure, for a term of so many rows."""
        n_term = F.col("n_both") * term_rows / F.col("both_rows")  # its texts, by the share of its rows
        chance = F.least(log_chance(F.col("n_both"), n_term, F.col("n_entity") / n), log_chance(F.col("n_both"), F.col("n_entity"), n_term / n))
        share = lower_share(F.col("n_both"), n_term)
        return (share >= LIKELY) & (pairs + chance <= math.log(BY_CHANCE)), 1 + F.log(share) / -F.log(F.col("n_entity") / n)

    seldom, disclosure = judged(F.col("near_rows"))
    told = written(both.where(seldom & (disclosure >= GENERALISE)), "pii-pairs")
    release(witnesses, own, held)
    if told.isEmpty():
        out = written(told.select("term", F.lit(0.0).alias("disclosure")), "pii-disclosing")
        release(told)
        return out
    asked = sent(told.select("term").distinct())
    counts = rows.select(F.explode(_terms(rows)).alias("term")).join(asked, "term", "left_semi").groupBy("term").agg(F.count("*").alias("term_rows"))
    seldom, disclosure = judged(F.col("term_rows"))
    out = written(told.join(counts, "term").where(seldom & (disclosure >= GENERALISE)).groupBy("term").agg(F.max(disclosure).alias("disclosure")), "pii-disclosing")
    release(told)
    return out


def _flagged(rows: DataFrame, acts: DataFrame) -> DataFrame:
    """(row, terms), written: the spans of the terms of acts, by start.

    Rows meet the terms where they are, first by their distinct words, so that only words of rows with a term are
    given places; terms beyond BROADCAST_BYTES come in shards, with a pass for each."""
    span = F.struct("start", F.lit(4).alias("rank"), "end", F.lit("term").alias("kind"), F.col("to").alias("value"))
    if acts.isEmpty():
        return written(rows.where(F.lit(False)).select("row", F.array().cast(_SPANS).alias("terms")), "pii-flagged")
    shards = max(1, math.ceil(acts.agg(F.sum(F.octet_length("term") + F.octet_length("to") + ROW_BYTES)).first()[0] / BROADCAST_BYTES))
    mine = [F.broadcast(acts.where(F.pmod(F.xxhash64("term"), F.lit(shards)) == i)) for i in range(shards)]

    def met(words: DataFrame) -> DataFrame:
        return reduce(DataFrame.unionByName, [words.join(m, "term") for m in mine])

    hit = written(met(rows.select("row", F.explode(_forms(rows)).alias("form")).select("row", F.lower("form").alias("term"))).select("row").distinct(), "pii-hit")
    few = rows.join(F.broadcast(hit), "row", "left_semi") if within(hit) else rows
    words = few.select("row", F.explode(matches(_masked(F.col("text"), F.col("base")), TERM)).alias("w")).select("row", "w.start", "w.end", F.lower("w.value").alias("term"))
    out = written(met(words).groupBy("row").agg(F.sort_array(F.collect_list(span)).cast(_SPANS).alias("terms")), "pii-flagged")
    release(hit)
    return out


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms, n_generalised, n_removed, sanitised) of every row.

    Base spans are found by patterns and tests. The values they cover, and what those belong to (a domain, a network,
    the first digits of a number), are the protected entities; a term that the corpus tells to give one of them away is
    a span wherever it stands, in documents without the entity too. Counts run over whole and different texts, all of
    them, as a copy is no further evidence, and are combined before they move; texts are written once beside their
    spans, and move only where more rows have terms than a broadcast may hold. There is one plan for all sizes.
    A term above REMOVE is removed, one above GENERALISE only is generalised: to its stem where that gives away less
    than GENERALISE of every entity, else to its kind, which is as broad as the language. sanitised is the text after
    that, with base values replaced by their kinds.
    Defined results: a null or empty text has no spans and is sanitised to an empty one; rows are judged each, and rows
    of one text are one witness; other columns are ignored; an empty table gives none."""
    text = F.coalesce(docs[text_col], F.lit(""))
    base = F.when(F.length(text) > 0, base_spans(text)).otherwise(F.array().cast(_SPANS))
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].alias("doc_id"), text.alias("text"), base.alias("base"), F.xxhash64(text).alias("h")), "pii-spans")
    n_texts, n_chars = rows.agg(F.count_distinct("h"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    bad = disclosing(rows, n_texts, n_chars)
    stems = bad.where(F.endswith("term", F.lit("*"))).select(F.col("term").alias("stem"), F.lit(True).alias("told"))
    acts = bad.where(~F.endswith("term", F.lit("*"))).withColumn("stem", _stem(F.col("term"))).join(stems, "stem", "left")
    kind = F.when(F.col("term").rlike(r"\p{L}"), "[WORD]").otherwise("[NUMBER]")
    to = F.when(F.col("disclosure") >= REMOVE, "").when(F.col("stem").isNotNull() & F.col("told").isNull(), F.col("stem")).otherwise(kind)
    acts = written(acts.select("term", to.alias("to")), "pii-actions")
    mine = _flagged(rows, acts)
    release(bad, acts)
    both = rows.join(F.broadcast(mine) if mine.agg(F.coalesce(F.sum(ROW_BYTES + 48 * F.size("terms")), F.lit(0))).first()[0] <= BROADCAST_BYTES else mine, "row", "left")
    both = both.withColumn("terms", F.coalesce("terms", F.array().cast(_SPANS)))
    removed = F.size(F.filter("terms", lambda s: s["value"] == "")).cast("long")
    acted = F.array_sort(F.concat("base", "terms"))
    base_text = spans_text(F.col("base"))
    counts = [_count(F.col("base"), kind).alias(f"n_{kind}") for kind in PATTERNS]
    return both.select("doc_id", *counts, F.sha2(base_text.cast("binary"), 256).alias("base_sha256"), spans_text(acted).alias("spans"), F.size("terms").cast("long").alias("n_terms"), (F.size("terms") - removed).alias("n_generalised"), removed.alias("n_removed"), sanitised(F.col("text"), acted).alias("sanitised"))


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def sanitised(text: Column, spans: Column) -> Column:
    """The text with each span (start, end, kind, value by start) replaced: by its kind in brackets, a term by its value, which is its generalisation or empty. Of a span that starts in an earlier one, what reaches beyond it goes too."""

    def fill(s: Column, at: Column) -> Column:
        own = F.when(s["kind"] == "term", s["value"]).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.when(s["start"] < at, F.lit("")).otherwise(own)

    return _rebuilt(text, spans, fill)
