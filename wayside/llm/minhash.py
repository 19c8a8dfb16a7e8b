"""Near-duplicate documents from bottom-k sketches of one hash function.

A document's set holds its distinct five-word shingles; its sketch keeps the
smallest hashes.  Inverted lists of retained values give candidates, the sketch
of the union estimates their likeness, and exact Jaccard on the full sets of
both texts confirms a link.

Only connection is asked for, so candidates come in two turns.  First each
document meets one leader per list, which joins groups of copies at a cost that
is linear in their size.  Then documents of one list that are still apart meet
one another.  Values that many components share (passages, licences) are left
out of that second turn, and documents that hold such a value use their whole
sketch instead of its beginning.  Documents that consist mostly of such values
meet by a prefix of their full sets in order of rarity: a linked pair shares a
value of both prefixes, and a document with more than a quarter of text of its
own is in no common list.  There the first turn is repeated, with new leaders
and contracted components, and a row leaves its list when what follows in its
order cannot suffice for a link, until no list is open.

A linked pair is missed only if its sketches say so against the odds: two sets
with likeness 0.75 share no value among the first 16 with probability below
1e-9, and fall below the sketch limit with probability below 1e-7.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayside.llm.arrow import bounded, with_columns
from wayside.llm.components import SALTS, classes, components, join_class_results, replace_ids
from wayside.llm.rows import unwrapped, wrapped
from wayside.llm.words import mix, shingle_sets
from wayside.llm.storage import stored

SHINGLE = 5
#: A link needs 100 * intersection >= PERCENT * union.
PERCENT = 75
KEPT = 64
#: Smallest values by which documents meet.
FIRST = 16
#: Estimated likeness from which a pair is verified.
ESTIMATE = 0.45
#: A value in more documents than this is common.
COMMON = 64
#: A document is bulk if this part of its first values is common; its full set is then compared.
BULK = 0.4
#: Leaders of a list in one turn at most.
LEADERS = 256
#: Rows of a list that meet in one task, as long as SALTS parts suffice.
PER_PART = 1000

_FULL = np.iinfo(np.uint64).max


def sketches(docs: DataFrame) -> DataFrame:
    """``docs`` without ``text``, with ``n_shingles``, two sums that identify the set, and ``sketch``: the smallest hashes, sorted, as bytes."""

    def work(batch: pa.RecordBatch) -> dict:
        n, a, b, sketch = [], [], [], []
        for s in shingle_sets(batch.column("text").to_pylist(), SHINGLE):
            n.append(len(s))
            a.append(int(s.sum(dtype=np.uint64).view(np.int64)))
            b.append(int(mix(s + np.uint64(1)).sum(dtype=np.uint64).view(np.int64)))
            sketch.append(s[:KEPT].tobytes())
        return {"n_shingles": n, "_a": a, "_b": b, "sketch": sketch}

    return with_columns(docs, lambda: work, "n_shingles long, _a long, _b long, sketch binary", drop=("text",))


def _filled(values: list[bytes]) -> np.ndarray:
    """Sketches as rows, filled up with the largest number."""
    out = np.full((len(values), KEPT), _FULL, dtype=np.uint64)
    for i, v in enumerate(values):
        x = np.frombuffer(v, dtype=np.uint64)
        out[i, : len(x)] = x
    return out


def union_estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of the smallest values of each row pair's union that both hold."""
    both = np.sort(np.hstack([a, b]), axis=1)
    real = both != _FULL
    new = np.ones_like(real)
    new[:, 1:] = both[:, 1:] != both[:, :-1]
    rank = np.cumsum(new & real, axis=1)
    within = real & (rank <= KEPT)
    return (within & ~new).sum(axis=1) / np.maximum((within & new).sum(axis=1), 1)


def promising(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose union sketch estimates ESTIMATE or more."""
    side = reps.select("class_id", "sketch")
    both = pairs.select("a", "b").join(side.withColumnsRenamed({"class_id": "a", "sketch": "_sa"}), "a").join(side.withColumnsRenamed({"class_id": "b", "sketch": "_sb"}), "b")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            likely = union_estimate(_filled(batch.column("_sa").to_pylist()), _filled(batch.column("_sb").to_pylist())) >= ESTIMATE
            yield batch.select(["a", "b"]).filter(pa.array(likely))

    return bounded(both).mapInArrow(keep, "a long, b long")


def texts_of(docs: DataFrame, reps: DataFrame, ids: DataFrame) -> DataFrame:
    """``class_id, text`` of the classes in ``ids (class_id)``."""
    wanted = ids.distinct().join(reps.select("class_id", F.col("rep").alias("doc_id"), "_text"), "class_id")
    hashed = docs.withColumn("_text", F.xxhash64("text"))
    return hashed.join(wanted, ["doc_id", "_text"]).select("class_id", "text").dropDuplicates(["class_id"])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose full sets have the likeness of a link."""
    both = pairs.join(texts.withColumnsRenamed({"class_id": "b", "text": "_tb"}), "b").join(texts.withColumnsRenamed({"class_id": "a", "text": "_ta"}), "a")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for a, b in zip(shingle_sets(batch.column("_ta").to_pylist(), SHINGLE), shingle_sets(batch.column("_tb").to_pylist(), SHINGLE), strict=True):
                shared = len(np.intersect1d(a, b, assume_unique=True))
                linked.append(100 * shared >= PERCENT * (len(a) + len(b) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(linked, type=pa.bool_()))

    return bounded(both).select("a", "b", "_ta", "_tb").mapInArrow(keep, "a long, b long")


def postings(reps: DataFrame, first: int) -> DataFrame:
    """``value, class_id, n_shingles, begins`` of the first values of each sketch; ``begins`` is true of its first FIRST."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [np.frombuffer(v, dtype=np.int64)[:first] for v in batch.column("sketch").to_pylist()]
            index = pa.array(np.repeat(np.arange(len(values)), [len(v) for v in values]))
            flat = pa.array(np.concatenate(values) if values else np.empty(0, dtype=np.int64))
            begins = pa.array(np.concatenate([np.arange(len(v)) < FIRST for v in values]) if values else np.empty(0, dtype=bool))
            columns = [flat, batch.column("class_id").take(index), batch.column("n_shingles").take(index), begins]
            yield pa.RecordBatch.from_arrays(columns, names=["value", "class_id", "n_shingles", "begins"])

    return reps.select("class_id", "n_shingles", "sketch").mapInArrow(spread, "value long, class_id long, n_shingles long, begins boolean")


_SIZES_FIT = "100 * least(n_a, n_b) >= {0} * greatest(n_a, n_b)".format(PERCENT)


def led_lists(posted: DataFrame) -> DataFrame:
    """Postings of lists with several members, with the list's leader ``a`` (and ``n_a``) and its ``size``; a long list is dealt out."""
    salted = posted.withColumn("_salt", F.pmod(F.xxhash64("class_id"), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy("value", "_salt").agg(F.min(F.struct(F.xxhash64("class_id"), "class_id", "n_shingles")).alias("first"), F.count("*").alias("n"))
    lists = parts.groupBy("value").agg(F.min("first").alias("first"), F.sum("n").alias("size"), F.collect_list("_salt").alias("_salts")).where("size > 1")
    back = lists.select("value", F.col("first.class_id").alias("a"), F.col("first.n_shingles").alias("n_a"), "size", F.explode("_salts").alias("_salt"))
    return salted.join(back, ["value", "_salt"]).select("value", "a", "n_a", F.col("class_id").alias("b"), F.col("n_shingles").alias("n_b"), "size")


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("class_id")).unionByName(pairs.select(F.col("b").alias("class_id"))).distinct()


def crowded_classes(led: DataFrame) -> DataFrame:
    """``class_id, common``: the documents that hold a common value, and how many of their first values are."""
    return led.where(F.col("size") > COMMON).groupBy(F.col("b").alias("class_id")).agg(F.count("*").alias("common"))


def apart_pairs(reps: DataFrame, posted: DataFrame, crowded: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs of one list whose members are in different components after the first turn; ``known`` has ``class_id, component``."""
    inner = reps.join(crowded.select("class_id"), "class_id")
    # whole sketches of documents that hold a common value, beginnings of all others
    mixed = posted.join(crowded, "class_id", "left_anti").unionByName(postings(inner, KEPT))
    mixed = stored(mixed.join(known, "class_id", "left").withColumn("component", F.coalesce("component", "class_id")))
    lists = mixed.groupBy("value").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size"), F.count_if("begins").alias("first"))
    # a value is common if more than COMMON documents begin with it; in longer lists of other values every member meets those that begin with it
    open_lists = stored(lists.where("low <> high").select("value", "size", (F.col("first") <= COMMON).alias("few")))
    listed = mixed.join(open_lists, "value")
    rare = listed.where("few").select("value", "class_id", "n_shingles", "component", (F.col("begins") | (F.col("size") <= COMMON)).alias("meets"))
    left = rare.where("meets").select("value", F.col("class_id").alias("a"), F.col("n_shingles").alias("n_a"), F.col("component").alias("ca"))
    right = rare.select("value", F.col("class_id").alias("b"), F.col("n_shingles").alias("n_b"), F.col("component").alias("cb"), "meets")
    met = left.join(right, "value").where("ca <> cb AND (a < b OR (a <> b AND NOT meets))").where(_SIZES_FIT)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def full_sets(texts: DataFrame) -> DataFrame:
    """``class_id, values``: the full sets as arrays."""

    def work(batch: pa.RecordBatch) -> dict:
        return {"values": [x.view(np.int64) for x in shingle_sets(batch.column("text").to_pylist(), SHINGLE)]}

    return with_columns(texts, lambda: work, "values array<long>", drop=("text",))


def prefixes(sets: DataFrame, known: DataFrame) -> DataFrame:
    """``value, class_id, n, rest, held, component``: the rarest values of each full set, how many of its values are not before this one, and how many sets hold it.

    A prefix is as long as it takes for two sets of the likeness of a link to
    share a value of both; rare values come first in all of them.
    """
    sets = stored(sets)
    value = sets.select("class_id", F.size("values").alias("n"), F.explode("values").alias("value")).withColumn("_salt", F.pmod(F.xxhash64("class_id"), F.lit(SALTS)))
    salted = value.groupBy("value", "_salt").agg(F.count("*").alias("held"))
    held = salted.groupBy("value").agg(F.sum("held").alias("held"), F.collect_list("_salt").alias("_salts"))
    dealt = held.where("held > 1").select("value", "held", F.explode("_salts").alias("_salt"))
    # values that no other set holds come first and take their places in the prefix
    own = value.join(dealt, ["value", "_salt"]).groupBy("class_id", "n").agg(F.array_sort(F.collect_list(F.struct("held", "value"))).alias("v"))
    length = F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1
    places = F.greatest(F.lit(0), length - (F.col("n") - F.size("v"))).cast("int")
    placed = own.select("class_id", "n", F.size("v").alias("_shared"), F.posexplode(F.slice("v", 1, places)).alias("_at", "_v"))
    first = placed.select("_v.value", "class_id", "n", (F.col("_shared") - F.col("_at")).alias("rest"), "_v.held")
    return first.join(known, "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))


def _reach(n: str, other: str, rest: str) -> Column:
    """Whether two sets of these sizes can be linked if the first value that they share leaves ``rest`` values at most."""
    return PERCENT * (F.col(n) + F.col(other)) <= (100 + PERCENT) * F.col(rest)


def _partner(lead: Column) -> Column:
    """Whether a row of a list and this leader of it are in different components and can be linked by their sizes and by what both have left."""
    small, large = F.least("n", lead["n"]), F.greatest("n", lead["n"])
    reached = PERCENT * (F.col("n") + lead["n"]) <= (100 + PERCENT) * F.least("rest", lead["rest"])
    return (lead["component"] != F.col("component")) & (lead["class_id"] != F.col("class_id")) & (100 * small >= PERCENT * large) & reached


def led_turn(first: DataFrame, leaders: int) -> DataFrame:
    """Rows of ``first`` that may still have a partner in their list, with ``led``: those of the list's up to ``leaders`` leaders, the smallest
    sets of its parts, that can be partners of the row; ``leads`` says that the row is a leader itself.

    Of two linked sets the list of the first value that both hold decides, so a
    row is kept only if what it has from there on suffices for the smallest set
    of its list, and the smaller set of a pair must reach its own size.  Lists
    within one component are closed.  Leaders go to the parts of their list only,
    and a row keeps no leader that cannot be its partner.
    """
    salt = F.pmod(F.xxhash64("class_id"), F.least(F.lit(SALTS), F.ceil(F.col("held") / PER_PART))).cast("int")
    rows = first.withColumn("_salt", salt).withColumn("_part", F.pmod(F.xxhash64(F.lit(leaders), "class_id"), F.lit(leaders)).cast("int"))
    able = F.when(_reach("n", "n", "rest"), F.struct("n", "class_id", "rest", "component"))
    dealt = rows.groupBy("value", "_salt", "_part").agg(F.min(able).alias("lead"), F.min("component").alias("low"), F.max("component").alias("high"))
    # a part of a list has one leader, whatever the salt
    parts = dealt.groupBy("value", "_part").agg(F.min("lead").alias("lead"), F.min("low").alias("low"), F.max("high").alias("high"), F.collect_set("_salt").alias("_salts"))
    lists = parts.groupBy("value").agg(
        F.collect_list("lead").alias("led"), F.min("lead.n").alias("_least"), F.min("low").alias("low"), F.max("high").alias("high"), F.array_distinct(F.flatten(F.collect_list("_salts"))).alias("_salts")
    )
    open_lists = lists.where("low <> high AND _least IS NOT NULL").select("value", "led", "_least", F.explode("_salts").alias("_salt"))
    leads = F.exists("led", lambda x: x["class_id"] == F.col("class_id"))
    met = rows.join(open_lists, ["value", "_salt"]).where(_reach("n", "_least", "rest"))
    return met.select("value", "class_id", "n", "rest", "held", "component", leads.alias("leads"), F.filter("led", _partner).alias("led"))


def met_leaders(led: DataFrame) -> DataFrame:
    """``a, b`` and their components ``ca, cb`` for each row ``b`` of ``led_turn`` and each leader ``a`` of its list that can be its partner."""
    met = led.select("class_id", "n", "rest", "component", F.explode(F.filter("led", _partner)).alias("lead"))
    return met.select(F.col("lead.class_id").alias("a"), F.col("class_id").alias("b"), F.col("lead.component").alias("ca"), F.col("component").alias("cb"))


def bulk_links(sets: DataFrame, known: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """Links ``a, b`` that connect the bulk documents as all their links do; ``known`` has ``class_id, component``.

    In each turn every row of a list meets the list's leaders, whose own rows
    then leave the list, as all their pairs there are decided; components are
    contracted and rows without possible partners go.  A turn is linear in the
    rows.  Turns go on until no list is open; those that last have more leaders.
    """
    first = stored(prefixes(sets, known))
    links: DataFrame | None = None
    for turn in itertools.count():
        led = stored(led_turn(first, min(16**turn, LEADERS)))
        if led.isEmpty():
            break
        pairs = stored(met_leaders(led).groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min(F.struct("ca", "cb")).alias("c")))
        found = stored(verified(promising(pairs, reps), texts))
        links = found if links is None else links.unionByName(found)
        first = led.where("NOT leads").select("value", "class_id", "n", "rest", "held", "component")
        if not found.isEmpty():
            first = replace_ids(first, "component", components(pairs.join(found, ["a", "b"]).select(F.col("c.ca").alias("a"), F.col("c.cb").alias("b"))))
    return links if links is not None else known.select(F.col("class_id").alias("a"), F.col("class_id").alias("b")).limit(0)


def near_documents(docs: DataFrame, text_hash: bool = False) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs (doc_id, text)``; with ``text_hash`` also ``_text``.

    Null and blank texts have no shingles and link with nothing; a text with
    fewer words than a shingle has one, the whole.  Equal sets are one class,
    so copies cost one row.  Rows without an id link with nothing, have no
    component and are not kept; rows with one id are documents of their own.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = stored(sketches(docs.withColumn("_text", F.xxhash64("text"))))
    key = ["n_shingles", "_a", "_b"]
    members, whole = classes(rows.where("doc_id IS NOT NULL AND n_shingles > 0").select("doc_id", "_text", *key), key, "doc_id")
    own = rows.select(F.col("doc_id").alias("rep"), *key, "_text", "sketch")
    reps = stored(whole.join(own, ["rep", *key]).dropDuplicates(["class_id"]).select("class_id", "rep", "members", "n_shingles", "_text", "sketch"))

    posted = postings(reps, FIRST)
    led = stored(led_lists(posted))
    pairs = stored(promising(led.where("a <> b").where(_SIZES_FIT).select("a", "b").distinct(), reps))
    crowded = stored(crowded_classes(led))
    bulk = crowded.join(reps.select("class_id", "n_shingles"), "class_id").where(F.col("common") >= BULK * F.least("n_shingles", F.lit(FIRST))).select("class_id")
    texts = stored(texts_of(docs, reps, ends(pairs).unionByName(bulk)))
    links = stored(verified(pairs, texts))
    known = components(links).withColumnRenamed("id", "class_id")
    more = stored(promising(apart_pairs(reps, posted, crowded, known), reps))
    links = links.unionByName(verified(more, texts_of(docs, reps, ends(more)))).unionByName(bulk_links(full_sets(texts.join(bulk, "class_id", "left_semi")), known, reps, texts))

    connected = components(links).withColumnRenamed("id", "class_id")
    placed = stored(reps.select("class_id", "rep", "members").join(connected, "class_id", "left").withColumn("component", F.coalesce("component", "class_id")))
    least = placed.groupBy(F.col("component").alias("id")).agg(F.min("rep").alias("component"))
    results = replace_ids(placed, "component", least).select("class_id", "members", F.col("component").alias("component_id"))
    linked = join_class_results(members, results, "doc_id", "class_id").select("doc_id", "n_shingles", "component_id", "_text")
    alone = rows.where("doc_id IS NULL OR n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "_text")
    both = linked.unionByName(alone)
    both = both if text_hash else both.drop("_text")
    return both.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def op7_near_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents."""
    return near_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each component of ``docs``: that with the smallest id; texts without shingles and rows without an id stay.

    Of rows that repeat one stays; different texts under the smallest id of a component all stay.
    Further columns are kept, whatever their names; an empty table gives an empty one.
    """
    names = ("doc_id", "text")
    keyed = wrapped(docs, *names).withColumn("_text", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    found = near_documents(docs.select(*names), text_hash=True)
    kept = found.where("kept").select("doc_id", "_text").distinct()
    one = keyed.join(kept, ["doc_id", "_text"]).dropDuplicates(["doc_id", "_text"])
    return unwrapped(one.unionByName(keyed.where("doc_id IS NULL")), docs.columns, names)
