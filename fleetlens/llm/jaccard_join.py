"""N-gram Jaccard join with adaptive multi-match prefixes, and its components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_pass, column_bytes, components, keep_ids, mix, release, sent, shingle_sets, signed, text_of, written

#: Words of a shingle; the least similarity as a fraction.
WIDTH, SHARE = 5, (4, 5)
#: Prefixes are lengthened by up to so many tokens less one, each asking for one more shared token.
MOST_MATCHES = 4
#: Counters of the frequency sketch: 512 KB, whatever the input.
SKETCH_BITS = 16
#: Words of 64 bits that hold, for each set, whether an odd number of its shingles falls on a bit.
PARITY = 16
#: A token that more than one in HOT of all documents may hold is dealt to SALTS groups.
HOT, SALTS = 2048, 64
#: Documents of a list that the others are held against in a round, and rounds, each with others.
PIVOTS, ROUNDS = 8, 2
#: Cost of verifying a candidate against that of reading one entry of a token's list, in list entries for each of its shingles.
VERIFY_COST = 0.05
#: Entries of a list from which on sizes are paired before documents are.
LONG = 64


def parities(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """PARITY words a set: each shingle flips one bit, so two sets differ in as many shingles at least as in bits."""
    bit = (mix(s ^ np.uint64(0x7F4A7C15)) % np.uint64(64 * PARITY)).astype(np.int64)
    odd = np.bincount(text_of(at) * (64 * PARITY) + bit, minlength=(len(at) - 1) * 64 * PARITY) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8").reshape(-1, PARITY)


def _sketched(docs: DataFrame) -> tuple[DataFrame, np.ndarray, int]:
    """A written table (doc_id, n, s1, s2, p0, ...) with each row's number of shingles, a 128-bit sum over its set and its parities, and for the whole table the counts of shingles by the top bits of their hash, and the number of rows."""

    def make():
        counts, rows = np.zeros(1 << SKETCH_BITS, np.int64), [0]

        def step(batch: pa.RecordBatch):
            s, at = shingle_sets(*column_bytes(batch.column(1)), WIDTH)
            counts[:] += np.bincount((s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts))
            sums = []
            for k in (0x51ED270B, 0x2545F491):
                c = np.zeros(len(s) + 1, np.uint64)
                np.add.accumulate(mix(s ^ np.uint64(k)), out=c[1:])
                sums.append(signed(c[at[1:]] - c[at[:-1]]))
            rows[0] += batch.num_rows
            odd = parities(s, at)
            yield {"kind": pa.array(np.zeros(batch.num_rows, np.int32)), "doc_id": batch.column(0), "n": pa.array(np.diff(at)), "s1": pa.array(sums[0]), "s2": pa.array(sums[1])} | {f"p{i}": pa.array(np.ascontiguousarray(odd[:, i])) for i in range(PARITY)}

        def finish():
            full = np.flatnonzero(counts)
            yield {"kind": pa.array(np.full(len(full), 1, np.int32)), "doc_id": pa.array(full), "n": pa.array(counts[full])} | {c: pa.nulls(len(full), pa.int64()) for c in ("s1", "s2", *_parity())}

        step.finish = finish
        return step

    both = written(arrow_pass(docs, make, "kind int, doc_id bigint, n bigint, s1 bigint, s2 bigint" + "".join(f", {c} bigint" for c in _parity())), "jaccard-sets")
    sketch = np.zeros(1 << SKETCH_BITS, np.int64)
    for r in both.where("kind = 1").groupBy("doc_id").agg(F.sum("n").alias("n")).collect():  # one row a counter at most
        sketch[r.doc_id] = r.n
    sets = both.where("kind = 0").drop("kind")
    return sets, sketch, sets.count()


def _parity(side: str = "") -> list[str]:
    return [f"{side}p{i}" for i in range(PARITY)]


def least_overlap(n: np.ndarray) -> np.ndarray:
    """Shingles that a set of n shares at least with any set it links to."""
    return (n * SHARE[0] + SHARE[1] - 1) // SHARE[1]


def chosen_matches(cost: np.ndarray, doc: np.ndarray, pos: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each document, how many shared prefix tokens its candidates must have.

    cost has, for each token in prefix order, how many other lists entries it is expected to meet. A prefix for l
    matches reads the lists of n - least_overlap + l tokens, and a candidate takes l of their entries, so at most a
    l-th of them is verified; the l with the least sum is taken."""
    base = n - least_overlap(n)
    best, out = None, np.ones(len(n), np.int64)
    for matches in range(1, MOST_MATCHES + 1):
        inside = pos < (base + matches)[doc]
        read = np.bincount(doc[inside], cost[inside], len(n))
        total = read + read / matches * VERIFY_COST * n
        total = np.where(base + matches <= n, total, np.inf)
        if best is None:
            best = total
        else:
            better = total < best * 0.98
            out[better], best = matches, np.minimum(best, total)
    return out


def _entries(reps: DataFrame, sketch: np.ndarray, rows: int) -> DataFrame:
    """Entries of tokens that more than one document has in its prefix: (token, salt, doc_id, n, pos, need). Salted tokens keep all their entries, as their groups meet later.

    A document's tokens are in order of the sketch's count, then hash: one order for all, rare ones first."""
    known = reps.sparkSession.sparkContext.broadcast(sketch)
    noise = sketch.sum() / len(sketch)
    hot = noise + 6 * np.sqrt(noise) + max(8.0, rows / HOT)

    def make():
        counts = known.value

        def step(batch: pa.RecordBatch):
            s, at = shingle_sets(*column_bytes(batch.column(1)), WIDTH)
            doc = text_of(at)
            weight = counts[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
            order = np.lexsort((s, weight, doc))
            s, weight = s[order], weight[order]
            n = np.diff(at)
            pos = np.arange(len(s)) - at[doc]
            need = chosen_matches(np.maximum(weight - noise, 1.0), doc, pos, n)
            own = np.flatnonzero(pos < (n - least_overlap(n) + MOST_MATCHES)[doc])
            ids = batch.column(0).to_numpy()[doc[own]]
            salt = np.where(weight[own] > hot, 1 + (mix(ids.view(np.uint64)) % np.uint64(SALTS)).astype(np.int64), 0)
            yield {"token": pa.array(signed(s[own])), "salt": pa.array(salt.astype(np.int32)), "doc_id": pa.array(ids), "n": pa.array(n[doc[own]].astype(np.int32)), "pos": pa.array(pos[own].astype(np.int32)), "need": pa.array(need[doc[own]].astype(np.int32))}

        return step

    schema = "token bigint, salt int, doc_id bigint, n int, pos int, need int"
    entries = arrow_pass(reps, make, schema).repartition("token", "salt").sortWithinPartitions("token", "salt")
    cols = ("token", "salt", "doc_id", "n", "pos", "need")

    def make_groups():
        # pending: a last row of which it isn't known yet whether it has a neighbour; open: the group of the last row that has
        state: dict = {"pending": None, "open": None}

        def step(batch: pa.RecordBatch):
            x = [batch.column(c).to_numpy().astype(np.int64) for c in cols]
            if state["pending"] is not None:
                x = [np.concatenate(([v], c)) for v, c in zip(state["pending"], x, strict=True)]
            same = (x[0][1:] == x[0][:-1]) & (x[1][1:] == x[1][:-1])
            shared = np.concatenate((same, [False])) | np.concatenate(([False], same)) | (x[1] > 0)
            if state["pending"] is None and state["open"] == (x[0][0], x[1][0]):
                shared[0] = True
            state["pending"] = None if shared[-1] else [c[-1] for c in x]
            state["open"] = (x[0][-1], x[1][-1])
            yield {c: pa.array(v[shared] if c in ("token", "doc_id") else v[shared].astype(np.int32)) for c, v in zip(cols, x, strict=True)}

        return step

    return arrow_pass(entries, make_groups, schema)


def _candidates(met: DataFrame, several: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) that share enough prefix tokens. Ids of several texts are grouped by sizes too, and any that share a token within reach are asked whole.

    met has a row for each token that two documents share in their prefixes, with doc, n, pos and need of both as
    a_* and b_*. The larger document (then the larger id) asks: both prefixes are as long as its number of matches
    makes them, and that many tokens within them must be shared. A shared token leaves an overlap of at most what is
    ahead of it in either document and can be shared at all, and what follows in the shorter rest; rows of which that
    is too little aren't made; and all shared tokens up to the last one are counted, so the overlap is at most their number and the rest."""
    asks = F.struct("a_n", "a_doc") > F.struct("b_n", "b_doc")
    need = F.when(asks, F.col("a_need")).otherwise(F.col("b_need"))
    both, rest = F.col("a_n") + F.col("b_n"), F.least(F.col("a_n") - F.col("a_pos"), F.col("b_n") - F.col("b_pos"))

    def edge(n: str):
        return F.col(n) - F.ceil(F.col(n) * SHARE[0] / SHARE[1]).cast("int")

    fits = F.least("a_n", "b_n") * SHARE[1] >= F.greatest("a_n", "b_n") * SHARE[0]
    inside = (F.col("a_pos") < edge("a_n") + need) & (F.col("b_pos") < edge("b_n") + need)
    can = 9 * (F.least("a_ahead", "b_ahead") + rest) >= 4 * both
    rows = met.where(fits & inside & can).select(F.least("a_doc", "b_doc").alias("a"), F.greatest("a_doc", "b_doc").alias("b"), need.alias("need"), rest.alias("rest"), both.alias("both"))
    pairs = rows.groupBy("a", "b").agg(F.count("*").alias("shared"), F.max("need").alias("need"), F.min("rest").alias("rest"), F.max("both").alias("both"))
    enough = (F.col("shared") >= F.col("need")) & (9 * (F.col("shared") + F.col("rest") - 1) >= 4 * F.col("both"))
    if several is None:
        return pairs.where(enough).select("a", "b")
    many = sent(several.withColumn("many", F.lit(True)))
    for side in ("a", "b"):
        pairs = pairs.join(many.select(F.col("doc_id").alias(side), F.col("many").alias(f"{side}_many")), side, "left")
    return pairs.where(enough | F.col("a_many").isNotNull() | F.col("b_many").isNotNull()).select("a", "b")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose sets link, compared whole."""

    def make():
        def step(batch: pa.RecordBatch):
            sets = [shingle_sets(*column_bytes(batch.column(i)), WIDTH) for i in (2, 3)]
            n = [np.diff(at) for _, at in sets]
            keys = np.concatenate([s for s, _ in sets])
            doc = np.concatenate([text_of(at) for _, at in sets])
            order = np.lexsort((keys, doc))
            same = (keys[order][1:] == keys[order][:-1]) & (doc[order][1:] == doc[order][:-1])
            both = np.bincount(doc[order][1:][same], minlength=batch.num_rows)
            link = 100 * both >= 80 * (n[0] + n[1] - both)
            yield {"a": batch.column(0).filter(pa.array(link)), "b": batch.column(1).filter(pa.array(link))}

        return step

    ids = written(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "jaccard-ids")
    own = keep_ids(texts, ids, "doc_id")
    with_b = pairs.join(own.select(F.col("doc_id").alias("b"), F.col("text").alias("b_text")), "b")
    whole = with_b.join(own.select(F.col("doc_id").alias("a"), F.col("text").alias("a_text")), "a").select("a", "b", "a_text", "b_text")
    return arrow_pass(whole, make, "a bigint, b bigint")


def _side(rows: DataFrame, side: str, *more: str | Column) -> DataFrame:
    own = {"doc": "doc_id", "n": "n", "pos": "pos", "need": "need", "ahead": "ahead", "component": "component"}
    return rows.select("token", *more, *[F.col(c).alias(f"{side}_{k}") for k, c in own.items()])


def _star(entries: DataFrame, turn: int) -> DataFrame:
    """Each token's entries against those of its PIVOTS first documents where components differ: at first those with the fewest tokens ahead that no one shares, then any by a hash of this turn.

    The first ones of salted groups meet to find those of the token, and go back to every group."""
    h = F.xxhash64(F.lit(turn), "doc_id")
    hashed = entries.withColumn("h", F.struct((F.col("pos") - F.col("ahead")).alias("alone"), h.alias("x")) if turn == 0 else F.struct(F.lit(0).alias("alone"), h.alias("x")))
    heads = hashed.withColumn("r", F.row_number().over(Window.partitionBy("token", "salt").orderBy("h", "doc_id"))).where(F.col("r") <= PIVOTS)
    heads = heads.withColumn("r", F.row_number().over(Window.partitionBy("token").orderBy("h", "doc_id"))).where(F.col("r") <= PIVOTS)
    every = F.when(F.col("salt") > 0, F.sequence(F.lit(1), F.lit(SALTS))).otherwise(F.array("salt"))
    pivots = _side(heads.withColumn("salt", F.explode(every)), "b", "salt", F.col("h").alias("b_h"))
    return _side(hashed, "a", "salt", "h").join(pivots, ["token", "salt"]).where("struct(b_h, b_doc) < struct(h, a_doc) and a_component <> b_component").drop("salt", "h", "b_h")


def _least(n: Column) -> Column:
    """least_overlap of a column."""
    return F.ceil(n * SHARE[0] / SHARE[1]).cast("int")


def _apart(entries: DataFrame, joined: DataFrame | None = None) -> DataFrame:
    """Entries of tokens whose documents lie in several components, with those, and with the number of such tokens ahead in the document.

    Prefixes of sets that link share MOST_MATCHES tokens, or as many as the sets have to, so a set with fewer entries left has no more links to other components and goes."""
    if joined is None:
        placed = entries.withColumn("component", F.col("doc_id"))
    else:
        placed = entries.join(sent(joined).withColumnRenamed("component", "_c"), F.col("doc_id") == F.col("node"), "left").select("token", "salt", "doc_id", "n", "pos", "need", F.coalesce("_c", "doc_id").alias("component"))
        split = placed.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("token")
        placed = placed.join(split, "token")
    ahead = placed.withColumn("ahead", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", "token")) - 1)
    return ahead.withColumn("own", F.count("*").over(Window.partitionBy("doc_id", "n"))).where(F.col("own") >= F.least(_least(F.col("n")), F.lit(MOST_MATCHES))).drop("own")


def _reach(n: Column, other: Column) -> Column:
    """The last place in a prefix ordered anew at which the first token may stand that a set of n shares with one of `other` shingles, if they link.

    Prefixes hold n - least + MOST_MATCHES tokens, all but that many less of the shared ones lie within them, and those that follow the first one need places too."""
    return n - F.ceil(4 * (n + other) / 9).cast("int") + F.greatest(_least(n), _least(other)) - _least(n)


def _ordered(rest: DataFrame) -> DataFrame:
    """The entries in an order by the lengths that lists have now: pos and ahead are places in it, list is the length. Those behind any place of a first shared token go.

    The sketch can't tell tokens of tens of documents from those of one, and the less the more documents there are; the
    prefixes it has made are long enough for any other order inside them. Tokens that no one else holds come first."""
    lists = rest.groupBy("token").agg(F.count("*").alias("list"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("token", "list")
    whose, n = Window.partitionBy("doc_id", "n"), F.col("n")
    size = F.least(n, n - _least(n) + MOST_MATCHES)
    placed = rest.drop("pos", "ahead").join(lists, "token").withColumn("own", F.count("*").over(whose)).where(F.col("own") >= F.least(_least(n), F.lit(MOST_MATCHES)))
    placed = placed.withColumn("ahead", F.row_number().over(whose.orderBy("list", "token")) - 1)
    return placed.withColumn("pos", (size - F.col("own") + F.col("ahead")).cast("int")).where(F.col("pos") <= n - _least(n)).drop("own")


def _thinned(ordered: DataFrame) -> DataFrame:
    """Ordered entries without those of long lists that meet no set of a size that suits both places: sizes are paired for that, not documents."""
    long = ordered.where(F.col("list") > LONG)
    held = long.groupBy("token", "n").agg(F.min("pos").alias("pos"), F.min("component").alias("low"), F.max("component").alias("high"))
    two = [held.select("token", *[F.col(c).alias(f"{side}_{c}") for c in ("n", "pos", "low", "high")]) for side in "ab"]
    a, b = F.col("a_n"), F.col("b_n")
    fits = F.least(a, b) * SHARE[1] >= F.greatest(a, b) * SHARE[0]
    apart = ~((F.col("a_low") == F.col("a_high")) & (F.col("b_low") == F.col("b_high")) & (F.col("a_low") == F.col("b_low")))
    met = two[0].join(two[1], "token").where(fits & apart & (F.col("a_pos") <= _reach(a, b)) & (F.col("b_pos") <= _reach(b, a)))
    last = met.groupBy("token", a.alias("n")).agg(F.max(_reach(a, b)).alias("last"))
    return ordered.where(F.col("list") <= LONG).unionByName(long.join(last, ["token", "n"]).where("pos <= last").drop("last"))


def _across(rest: DataFrame, odd: DataFrame) -> DataFrame:
    """Pairs of entries of a token whose documents lie in different components, of ordered entries.

    Sets that link share 4/9 of the shingles of both at least. So many less the larger one's least overlap, and
    MOST_MATCHES more, lie in both prefixes, and the first of these no further back than _reach says in either. Only pairs
    of entries at such places are made, which hold that first one, and each pair's tokens are gathered. Linked sets differ
    in a ninth of the shingles of both at most, and in as many at least as their parities (odd, by id) differ in bits:
    other pairs go. Ids that odd lacks are met without that. For _candidates one match is asked for, and places in the
    smaller set are put forward by what its prefix ends before the larger one's."""
    sides = [_side(rest, side) for side in "ab"]
    a, b, both = F.col("a_n"), F.col("b_n"), F.col("a_n") + F.col("b_n")
    fits = F.least(a, b) * SHARE[1] >= F.greatest(a, b) * SHARE[0]
    most = F.greatest(_least(a), _least(b))
    place = {"a": F.col("a_pos") - most + _least(a), "b": F.col("b_pos") - most + _least(b)}
    can = 9 * (F.least("a_ahead", "b_ahead") + F.least(a - place["a"], b - place["b"])) >= 4 * both
    met = sides[0].join(sides[1], "token").where("a_doc < b_doc and a_component <> b_component").where(fits & (F.col("a_pos") <= _reach(a, b)) & (F.col("b_pos") <= _reach(b, a)) & can)
    pairs = met.groupBy("a_doc", "b_doc", "a_n", "b_n").agg(F.collect_list(F.struct(place["a"].alias("a_pos"), place["b"].alias("b_pos"), "a_ahead", "b_ahead")).alias("met"))
    for side in "ab":
        pairs = pairs.join(sent(odd.select(F.col("doc_id").alias(f"{side}_doc"), *[F.col(c).alias(f"{side}_{c}") for c in _parity()])), f"{side}_doc", "left")
    differ = sum((F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in _parity()), F.lit(0))
    near = F.coalesce(9 * differ <= both, F.lit(True))  # unknown where an id has no parities
    return pairs.where(near).select("a_doc", "b_doc", "a_n", "b_n", F.lit(1).alias("a_need"), F.lit(1).alias("b_need"), F.inline("met"))


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    Sets that are equal are one class at once, so copies never meet, and only ids of several texts tie classes. For the
    rest, a document's prefix in a global order of tokens is as long as its estimated candidate cost makes it; a longer
    one asks for more shared tokens. First each list's documents are held against a few of them, which is linear in
    the lists and joins what is alike, and again against others where components still differ; then only pairs that lie
    in different components and can link by their sizes are made, so a group of near copies is never paired out, and
    no link between components is lost. Candidates are verified on the whole sets. Tokens that very many documents hold
    are dealt to salted groups whose first documents meet in turn.

    Defined results: a null, empty or blank text has an empty set, links with nothing and is its own component; rows
    that share an id are one document for links, whatever their texts; a row without an id makes no links and takes
    the component of its equals, if any; texts are used whole; other columns are ignored; an empty table gives none."""
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    sets, sketch, rows = _sketched(own)
    key = ["n", "s1", "s2"]
    full = sets.where("n > 0")
    classes = written(full.groupBy(*key).agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies")).where("copies > 1 and class_id is not null"), "jaccard-classes")
    copied = full.join(sent(classes), key).where("doc_id <> class_id").select("doc_id", "class_id")
    again = written(sets.groupBy("doc_id").agg(F.min(F.struct(*key)).alias("x"), F.max(F.struct(*key)).alias("y"), F.count("*").alias("rows")).where("doc_id is not null and rows > 1").select("doc_id", (F.col("x") != F.col("y")).alias("differ")), "jaccard-again")
    several = again.where("differ").select("doc_id")
    more_texts = None if several.isEmpty() else several
    texts = own.where("doc_id is not null and text is not null")
    if not again.isEmpty():
        repeated = again.select("doc_id")
        texts = keep_ids(texts, repeated, "doc_id", "left_anti").unionByName(keep_ids(texts, repeated, "doc_id").distinct())
    alone = copied.select("doc_id").distinct()
    alone = written(alone if more_texts is None else alone.join(sent(several), "doc_id", "left_anti"), "jaccard-alone")
    rest = written(_apart(_entries(keep_ids(texts, alone, "doc_id", "left_anti"), sketch, rows)), "jaccard-entries")

    pairs = links = None
    asked: list[DataFrame] = []
    for turn in range(ROUNDS):
        new = _candidates(_star(rest, turn), more_texts)
        new = written(new.join(pairs, ["a", "b"], "left_anti") if pairs else new, "jaccard-pairs")
        pairs = pairs.unionByName(new) if pairs else new
        found = written(_verified(new, texts), "jaccard-links")
        links = links.unionByName(found) if links else found
        asked += [new, found]
        joined = components(links, "jaccard-joined")
        after = written(_apart(rest.drop("component", "ahead"), joined), "jaccard-apart")
        release(rest, joined)
        rest = after
        if rest.isEmpty():  # all documents that share a token are in one component
            break
    edges = links
    if not rest.isEmpty():
        ordered = written(_ordered(rest), "jaccard-ordered")
        odd = sets.where("doc_id is not null").join(sent(ordered.select("doc_id").distinct()), "doc_id", "left_semi")
        odd = written((odd if again.isEmpty() else keep_ids(odd, again.select("doc_id"), "doc_id", "left_anti")).select("doc_id", *_parity()), "jaccard-odd")
        asked.append(written(_candidates(_across(_thinned(ordered), odd), more_texts).join(pairs, ["a", "b"], "left_anti"), "jaccard-more"))
        release(ordered, odd)
        edges = links.unionByName(_verified(asked[-1], texts))
    if more_texts is not None:  # their classes are tied by them, the one each stands for as well
        ties = sets.where("n > 0").join(sent(several), "doc_id").join(sent(classes), key, "left")
        edges = edges.unionByName(ties.select(F.col("doc_id").alias("a"), F.coalesce("class_id", "doc_id").alias("b")))
    found = components(edges, "jaccard-components")
    release(rest, alone, *asked)
    named = sets.join(sent(classes.select(*key, "class_id")), key, "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"))
    return named.join(sent(found), F.col("class_id") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("component", "class_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of documents whose id is their component's, and all rows without an id.

    Rows that share such an id and their text stay once, with the least of the other columns in their order; rows that
    share an id and differ in their text all stay."""
    comp = written(jaccard_components(docs).where("doc_id <> component_id").select("doc_id").distinct(), "jaccard-dropped")
    named = keep_ids(docs.where("doc_id is not null"), comp, "doc_id", "left_anti")
    again = written(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id"), "jaccard-again")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    first = named.join(sent(again), "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(*others)).alias("_o")) if others else named.join(sent(again), "doc_id", "left_semi").select("doc_id", "text").distinct()
    kept = first.select(*[F.col("_o")[c].alias(c) if c in others else F.col(c) for c in docs.columns])
    return keep_ids(named, again, "doc_id", "left_anti").unionByName(kept).unionByName(docs.where("doc_id is null"))
