"""MinHash near-duplicates by a signature-coordinate inverted join.

A document is its set of distinct word shingles; two documents are linked if the Jaccard
similarity of the sets reaches the threshold, which is confirmed on the full sets.

1. Documents with equal sets form a class; only one representative of each goes on, so
   thousands of copies cost as much as one.
2. Each representative is posted under its signature coordinates (coordinate, value).  Two
   that agree on at least ``MATCHES`` of ``COORDINATES`` must share one among the rarest
   ``COORDINATES - MATCHES + 1`` of either (prefix), so the most frequent lists are skipped.
3. In each list every member is paired with the least one (its pivot), which is linear in
   the list.  Merging the lists by pair counts the collisions in the prefixes; the skipped
   lists are not read but probed by the two signatures.  Pairs with ``MATCHES`` collisions
   are confirmed, and the links give first components.  Where all of a list is in one
   component, nothing is left to do.
4. In the other lists, members outside the pivot's component are compared with all members
   of other components.  A list is dealt into cells of bounded size; a cell counts the
   collisions of its signatures, confirms those at the threshold and returns at most one
   link for each member and component, so no table of pairs is ever made.

No link between two components is lost by skipping pairs inside one, because the result is
the component.  A pair at the threshold is missed by the signature with probability below
1e-4; closer pairs less.  A task never holds a whole list, and what skew there is falls on
joins that Spark splits.

Edge cases: documents without words have an empty set and are linked with nothing; with
fewer words than a shingle the whole sequence is the one shingle; rows with the same id
count as one document; a null id takes part but names no component; an empty table gives
an empty result; other columns are ignored by :func:`classes` and kept by :func:`drop`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm.common import checkpointed, ids_and_texts, map_batches
from tidewire.llm.components import components
from tidewire.llm.textbatch import SPACED, Words, mix, window_hashes, word_chunks

COORDINATES, MATCHES = 32, 16
#: Shingles on either side of a cell, and in all cells that one task takes at once.
CELL, BUCKET = 400_000, 2_000_000
#: Parts that a posting list is dealt into wherever it is joined by its key.
SALTS = 64
#: Bits of the filter that keeps texts nobody asks for out of a shuffle; as a table it has a 64th as many rows.
FILTER_BITS = 1 << 25
_U = np.uint64


@dataclass(frozen=True)
class Rule:
    """Words in a shingle, and the least similarity in percent."""

    shingle: int = 4
    percent: int = 80


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, text after text, and len+1 offsets into them."""
    counts, n = words.counts, len(words.counts)
    hashes, owners = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
    own = words.owners()
    for k, found in window_hashes(words.hashes(), set(range(1, size + 1))):
        at = np.flatnonzero(own[: len(found)] == own[k - 1 :])
        if k < size:
            at = at[counts[own[at]] == k]
        hashes.append(found[at])
        owners.append(own[at])
    h, o = np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((h, o))
    h, o = h[order], o[order]
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    h, o = h[fresh], o[fresh]
    return h, np.searchsorted(o, np.arange(n + 1))


def _multipliers() -> np.ndarray:
    return np.random.default_rng(32).integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * _U(2) + _U(1)


_SIGNED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("k1", T.LongType()),
        T.StructField("k2", T.LongType()),
        T.StructField("_row1", T.LongType()),
        T.StructField("_row2", T.LongType()),
        *[T.StructField(f"s{i}", T.LongType()) for i in range(4)],
        T.StructField("posts", T.ArrayType(T.LongType())),
    ]
)


def _keyed(docs: DataFrame) -> DataFrame:
    """With _row1 and _row2, hashes of id and text, by which rows are known; neither is ever null."""
    row = [F.col("doc_id").cast("long"), F.col("text").cast("string")]
    return docs.select("*", F.xxhash64(*row, F.isnull(row[0])).alias("_row1"), F.xxhash64(F.lit(1), *row, F.isnull(row[0])).alias("_row2"))


def _signed(docs: DataFrame, rule: Rule) -> DataFrame:
    """Set size, two hashes of the whole set, the row's key, one byte per coordinate, and the posting keys."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = batch.num_rows
        ints = np.zeros((rows, 3), np.int64)
        sketch = np.zeros((rows, COORDINATES), np.uint8)
        posts = np.zeros((rows, COORDINATES), np.int64)
        factors = _multipliers()
        for lo, hi, words in word_chunks(batch.column("text"), SPACED):
            sets, first = shingle_sets(words, rule.shingle)
            full = np.flatnonzero(np.diff(first))
            if not len(full):
                continue
            heads, at = first[full], lo + full
            ints[at, 0] = np.diff(first)[full]
            ints[at, 1] = np.add.reduceat(mix(sets), heads).view(np.int64)
            ints[at, 2] = np.add.reduceat(mix(sets ^ _U(0x5DEECE66D)), heads).view(np.int64)
            for i, factor in enumerate(factors):
                least = np.minimum.reduceat((sets * factor) >> _U(32), heads)
                posts[at, i] = (least | _U(i << 32)).view(np.int64)
                sketch[at, i] = mix(least) & _U(255)
        longs = sketch.view("<i8")
        lists = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * COORDINATES), pa.array(posts.ravel()))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(np.ascontiguousarray(c)) for c in ints.T], batch.column("_row1"), batch.column("_row2"), *[pa.array(np.ascontiguousarray(c)) for c in longs.T], lists], [f.name for f in _SIGNED])

    return map_batches(_keyed(ids_and_texts(docs)), run, _SIGNED)


def _agreements(left: str, right: str) -> Column:
    """Equal bytes of two sketches of four longs."""
    differ = None
    for i in range(4):
        x = F.col(f"{left}.s{i}").bitwiseXOR(F.col(f"{right}.s{i}"))
        for shift, keep in ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x0303030303030303), (1, 0x0101010101010101)):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift)).bitwiseAND(F.lit(keep))
        n = F.bit_count(x)
        differ = n if differ is None else differ + n
    return F.lit(COORDINATES) - differ


def _among(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose doc_id is in ``wanted``.

    A bitmap of id hashes, of at most ``FILTER_BITS`` whatever the input, first keeps out most
    others where the texts are read; those that slip through go in the exact join.  That is
    an inner join on distinct ids, since a semi-join would be moved below the bitmap.
    """
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).alias("spot")
    bit = F.expr("shiftleft(1L, cast(spot & 63 as int))")
    words = wanted.select(spot).groupBy(F.shiftright("spot", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    maybe = texts.select("*", spot).join(F.broadcast(words), F.shiftright("spot", 6) == F.col("word")).where(F.col("bits").bitwiseAND(bit) != 0)
    return maybe.select(*texts.columns).join(wanted, "doc_id")


def _sets(docs: DataFrame, wanted: DataFrame, rule: Rule) -> DataFrame:
    """(doc_id, shingles) of the documents in ``wanted``; only their texts are read again."""
    texts = _among(ids_and_texts(docs), wanted)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values, ends, total = [], [0], 0
        for lo, hi, words in word_chunks(batch.column("text"), SPACED):
            sets, first = shingle_sets(words, rule.shingle)
            values.append(sets.view(np.int64))
            ends += (total + first[1:]).tolist()
            total += len(sets)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values)))], ["doc_id", "shingles"])

    return map_batches(texts, run, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))]))


def _confirmed(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) of representatives whose full sets are similar enough."""
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * shared >= rule.percent * (F.size("sa") + F.size("sb") - shared)).select("a", "b").distinct()


def cell_links(outside: list[tuple[int, int, np.ndarray, np.ndarray]], members: list[tuple[int, int, np.ndarray, np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """Links between (id, component, set, sketch) of one side and the other, one for each id and other component.

    Collisions of the signatures are counted first; those of another component at or above
    the match threshold have their sets merged term at a time.
    """
    components_of = np.array([c for _, c, _, _ in members])
    sketches = np.stack([k for _, _, _, k in members])
    out = []
    for i, component, unsorted, sketch in outside:
        alike = np.flatnonzero(((sketches == sketch).sum(1) >= MATCHES) & (components_of != component))
        if not len(alike):
            continue
        mine, sizes = np.sort(unsorted), np.array([len(members[k][2]) for k in alike])
        likely = np.flatnonzero((100 * np.minimum(sizes, len(mine)) >= percent * np.maximum(sizes, len(mine))))
        alike, sizes = alike[likely], sizes[likely]
        if not len(alike):
            continue
        theirs = np.concatenate([members[k][2] for k in alike])
        at = np.searchsorted(mine, theirs)
        at[at == len(mine)] = 0
        shared = np.bincount(np.repeat(np.arange(len(alike)), sizes)[mine[at] == theirs], minlength=len(alike))
        close = alike[100 * shared >= percent * (len(mine) + sizes - shared)]
        _, one = np.unique(components_of[close], return_index=True)
        out += [(i, members[k][0]) for k in close[one].tolist()]
    return out


def _cell_links(named: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Links (a, b) from members outside the main component of a list to all others of it."""
    outside = F.col("component") != F.col("main")
    cells_of = lambda n: F.ceil(F.sum(n) / CELL).cast("long")
    spread = _by_list(named, [F.sum("n").alias("all_n"), F.sum(F.when(outside, F.col("n"))).alias("out_n")], [cells_of("all_n").alias("columns"), cells_of("out_n").alias("rows")], "columns > 0")
    spread = checkpointed(spread)
    total = spread.agg(F.sum(F.col("n") * (F.col("rows") + F.when(outside, F.col("columns")).otherwise(0)))).first()[0] or 0
    buckets = 1 + int(total // BUCKET)
    filled = spread.join(sets.select(F.col("doc_id").alias("id"), "shingles"), "id")
    kept = ("post", "id", "component", "shingles", "s0", "s1", "s2", "s3")
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    own = lambda n: F.array(F.pmod(F.xxhash64("id"), F.col(n)))
    member = filled.select(*kept, F.lit(False).alias("out"), F.explode(F.arrays_zip(every("rows").alias("row"), F.array_repeat(own("columns")[0], F.col("rows").cast("int")).alias("column"))).alias("cell"))
    strange = filled.where(outside).select(*kept, F.lit(True).alias("out"), F.explode(F.arrays_zip(F.array_repeat(own("rows")[0], F.col("columns").cast("int")).alias("row"), every("columns").alias("column"))).alias("cell"))
    cells = member.unionByName(strange).select(*kept, "out", F.col("cell.row").alias("row"), F.col("cell.column").alias("column"))
    cells = cells.withColumn("bucket", F.pmod(F.xxhash64("post", "row", "column"), F.lit(buckets)))
    percent = rule.percent

    def compare(table: pa.Table) -> pa.Table:
        sides: dict[tuple, tuple[list, list]] = {}
        sketch = np.stack([table.column(f"s{i}").to_numpy() for i in range(4)], 1).astype("<i8").view(np.uint8)
        values = table.column("shingles").combine_chunks()
        offsets, flat = np.asarray(values.offsets), np.asarray(values.values)
        for k, (post, row, column, i, component, out) in enumerate(zip(*(table.column(c).to_pylist() for c in ("post", "row", "column", "id", "component", "out")))):
            sides.setdefault((post, row, column), ([], []))[0 if out else 1].append((i, component, flat[offsets[k] : offsets[k + 1]], sketch[k]))
        links = [link for left, right in sides.values() if left and right for link in cell_links(left, right, percent)]
        return pa.table([pa.array([min(x) for x in links], pa.int64()), pa.array([max(x) for x in links], pa.int64())], names=["a", "b"])

    return cells.groupBy("bucket").applyInArrow(compare, "a long, b long").distinct()


def _by_list(rows: DataFrame, partial: list[Column], total: list[Column], where: str) -> DataFrame:
    """Rows (post, id, ...) with totals of their posting list, where those meet the condition.

    Lists are aggregated in parts that :data:`SALTS` deals them into, and every part gets the
    totals back under its own key, so a frequent post is no hot key of the join.
    """
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    totals = dealt.groupBy("post", "part").agg(*partial).groupBy("post").agg(*total, F.collect_list("part").alias("parts")).where(where)
    return dealt.join(totals.withColumn("part", F.explode("parts")).drop("parts"), ["post", "part"]).drop("part")


def _with_totals(posted: DataFrame) -> DataFrame:
    """Postings whose list has others too, with its least id and its length."""
    return _by_list(posted, [F.min("id").alias("pivot"), F.count(F.lit(1)).alias("many")], [F.min("pivot").alias("pivot"), F.sum("many").alias("many")], "many > 1")


def linked(docs: DataFrame, rule: Rule = Rule()) -> tuple[DataFrame, DataFrame]:
    """Members (doc_id, n, k1, k2, _row1, _row2, representative) and components (id, component) of representatives."""
    signed = checkpointed(_signed(docs, rule))
    words = signed.where("n > 0")
    reps = words.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("id"), *[F.first(f"s{i}").alias(f"s{i}") for i in range(4)], F.first("posts").alias("posts"))
    reps = checkpointed(reps)
    posted = reps.where("id is not null").select("id", F.explode("posts").alias("post"))
    own = _with_totals(posted).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("many", "post"))).alias("posts"))
    # coordinates that nobody shares are the rarest and take their places in the prefix
    prefix = F.size("posts") - F.lit(COORDINATES) + F.lit(COORDINATES - MATCHES + 1)
    kept = own.where(prefix > 0).select("id", F.explode(F.slice("posts", F.lit(1), F.greatest(prefix, F.lit(1)))).alias("p")).select("id", F.col("p.post").alias("post"))
    lists = checkpointed(_with_totals(kept))
    sketches = reps.select("id", "s0", "s1", "s2", "s3")

    def alike(pairs: DataFrame) -> DataFrame:
        near = pairs.join(sketches.alias("x"), F.col("a") == F.col("x.id")).join(sketches.alias("y"), F.col("b") == F.col("y.id"))
        # collisions in the lists that were merged, and those that probing finds in the skipped ones
        return near.where(F.greatest("met", _agreements("x", "y")) >= MATCHES).select("a", "b")

    sets = checkpointed(_sets(docs, lists.select(F.col("id").alias("doc_id")).distinct(), rule))
    met = lists.where("id != pivot").groupBy(F.col("pivot").alias("a"), F.col("id").alias("b")).agg(F.count(F.lit(1)).alias("met"))
    stars = alike(met)
    links = checkpointed(_confirmed(stars, sets, rule))
    found = components(links)

    label = found.select("id", "component")
    named = lists.where("many > 2").join(label, "id", "left").join(label.select(F.col("id").alias("pivot"), F.col("component").alias("main")), "pivot", "left")
    named = named.select("post", "id", F.coalesce("component", "id").alias("component"), F.coalesce("main", "pivot").alias("main"))
    named = _by_list(named, [F.bool_or(F.col("component") != F.col("main")).alias("open")], [F.bool_or("open").alias("open")], "open").drop("open")
    named = checkpointed(named.join(reps.select("id", "n", "s0", "s1", "s2", "s3"), "id"))
    if named.limit(1).count():
        found = components(links.unionByName(_cell_links(named, sets, rule)))

    classes_of = reps.select("k1", "k2", F.col("n").alias("size"), F.col("id").alias("representative"))
    members = signed.join(classes_of, (signed["k1"] == classes_of["k1"]) & (signed["k2"] == classes_of["k2"]) & (signed["n"] == classes_of["size"]) & (signed["n"] > 0), "left")
    return members.select("doc_id", "n", signed["k1"], signed["k2"], "_row1", "_row2", "representative"), found


def _named(docs: DataFrame, rule: Rule) -> DataFrame:
    """Members with their component and whether its name is their id."""
    members, found = linked(docs, rule)
    named = members.join(found.select(F.col("id").alias("representative"), "component"), "representative", "left")
    component = F.coalesce("component", "representative", "doc_id")
    return named.select("doc_id", "n", "k1", "k2", "_row1", "_row2", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def classes(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    return _named(docs, rule).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "kept")


def drop(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """One row of each component, all columns as they were.

    Of several texts with the id that names the component, the one whose row key is least
    stays; of equal rows, one.  Rows with a null id go if another row has their set, else one
    of each set stays.  Rows without words are one document for each id, and all stay where
    the id is null.
    """
    if not docs.columns:
        return docs
    nameless = F.col("component_id").isNull()
    rows = _named(docs, rule).where(~nameless | (F.col("n") > 0))
    group = ["group", "wordless", "g1", "g2"]
    rows = rows.select("_row1", "_row2", "kept", F.coalesce("component_id", F.lit(0).cast("long")).alias("group"), (F.col("n") == 0).alias("wordless"), *[F.when(nameless, F.col(f"k{i}")).otherwise(F.lit(0)).alias(f"g{i}") for i in (1, 2)])
    keys = checkpointed(rows.groupBy("_row1", "_row2", "kept", *group).agg(F.count(F.lit(1)).alias("many")))
    own = keys.where("kept")
    torn = own.groupBy(*group).agg(F.min(F.struct("_row1", "_row2")).alias("first"), F.count(F.lit(1)).alias("texts")).where("texts > 1")
    later = own.join(torn, group).where(F.struct("_row1", "_row2") != F.col("first")).select("_row1", "_row2")
    gone = keys.where("not kept").select("_row1", "_row2").unionByName(later)
    repeated = own.where("many > 1").select("_row1", "_row2")
    keyed = _keyed(docs)
    stay = keyed.join(gone.unionByName(repeated), ["_row1", "_row2"], "left_anti").select(*docs.columns)
    if not repeated.limit(1).count():
        return stay
    one = keyed.join(repeated.join(later, ["_row1", "_row2"], "left_anti"), ["_row1", "_row2"]).dropDuplicates(["_row1", "_row2"])
    return stay.unionByName(one.select(*docs.columns))
