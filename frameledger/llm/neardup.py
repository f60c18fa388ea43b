"""MinHash near-duplicate detection with a multi-index Hamming join.

Every distinct shingle set gets a signature of ``SLOTS`` b-bit MinHash values. The signature is
split into chunks; by the pigeonhole principle two signatures that differ in fewer than
``CHUNKS * (ERRORS + 1)`` slots agree on some chunk up to ``ERRORS`` slots, so each chunk is indexed
once for every slot that may be wrong. All pairs under that signature distance meet in a bucket;
a pair at similarity 0.8 misses every bucket with a probability of about 1e-6.

Buckets are not expanded into pairs. A first round links each set to the closest of its earlier
bucket neighbours. In the buckets that then hold more than one component, the shingles of the sets are
ranked: first those that only the set's own component has, then the rarer ones. Each set is compared with
the bucket's member that has the fewest of the former, the likeliest original. Members that are still in
different components after that are compared where they meet in the starts of their rankings, with
enough shingles to come; a heavily edited copy in a large group of copies has too many rare ones for
that. Links are confirmed on the full sets, and no pair that could be one is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, store, table
from .components import connected_components
from .shingles import batches, constants, shingle_hashes, shingle_sets, splitmix, word_hashes

WIDTH = 4
PERCENT = 80
CHUNKS = 13
CHUNK_SLOTS = 6
ERRORS = 1
SLOTS = CHUNKS * CHUNK_SLOTS
#: Two 64-bit sketches of one bit per MinHash value; at similarity 0.8 a bit differs with probability
#: 0.1, so 34 of 128 lies over six deviations from the mean.
SKETCH_BITS = 128
SKETCH_DISTANCE = 34

_MULTIPLIERS = constants(5, SLOTS + SKETCH_BITS)
_OFFSETS = constants(6, SLOTS + SKETCH_BITS)
_LIMIT_SHINGLES = 1 << 18
#: Texts that a worker takes at once. Spark's batches have 10,000 rows, whose texts, values and draws would all be held.
_TEXTS_AT_ONCE = 256
#: The logarithm of the most 64-bit words of a filter that keeps texts out of an exchange: 8 MB.
_FILTER_LOG = 20


def _minima(shingles: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """(sets, slots) smallest permuted hash; every set must be non-empty."""
    out = np.empty((len(cuts), SLOTS + SKETCH_BITS), dtype=np.uint64)
    for j in range(SLOTS + SKETCH_BITS):
        out[:, j] = np.minimum.reduceat(shingles * _MULTIPLIERS[j] + _OFFSETS[j], cuts)
    return out


def _few(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, in batches of at most ``_TEXTS_AT_ONCE``."""
    for batch in rows:
        for at in range(0, batch.num_rows, _TEXTS_AT_ONCE):
            yield batch.slice(at, _TEXTS_AT_ONCE)


def _describe(rows: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in _few(rows):
        ids, texts = batch.column(0), batch.column(1).cast(pa.binary()).to_pylist()
        counts = np.zeros(len(texts), dtype=np.int64)
        prints = np.zeros((len(texts), 2), dtype=np.uint64)
        minima = np.zeros((len(texts), SLOTS + SKETCH_BITS), dtype=np.uint64)
        waiting: list[np.ndarray] = []
        at: list[int] = []

        def flush() -> None:
            if at:
                lengths = np.array([len(s) for s in waiting])
                minima[at] = _minima(np.concatenate(waiting), np.cumsum(lengths) - lengths)
                waiting.clear()
                at.clear()

        for i, found in enumerate(shingle_sets(texts, width)):
            counts[i] = len(found)
            if len(found):
                prints[i] = splitmix(found ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64), splitmix(found ^ np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64)
                waiting.append(found)
                at.append(i)
                if sum(map(len, waiting)) > _LIMIT_SHINGLES:
                    flush()
        flush()
        slots = (minima[:, :SLOTS] >> np.uint64(48)).astype("<u2")
        bits = np.packbits(((minima[:, SLOTS:] >> np.uint64(40)) & np.uint64(1)).astype(np.uint8), axis=1).view("<i8")
        yield pa.RecordBatch.from_arrays(
            [
                ids,
                pa.array(counts),
                pa.array(prints[:, 0].view(np.int64)),
                pa.array(prints[:, 1].view(np.int64)),
                pa.array(bits[:, 0].copy()),
                pa.array(bits[:, 1].copy()),
                pa.array([r.tobytes() for r in slots], pa.binary()),
            ],
            names=["id", "n_shingles", "print1", "print2", "sketch1", "sketch2", "slots"],
        )


def describe_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per document: set size, a 128-bit print of the set, its b-bit signature and sketch.

    Null and word-less texts get size 0 and zero prints.
    """
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        lambda rows: _describe(rows, width),
        "id long, n_shingles long, print1 long, print2 long, sketch1 long, sketch2 long, slots binary",
    )


def _key_matrix() -> np.ndarray:
    """(chunk, omitted slot, slot) multipliers; the omitted slot's is zero."""
    m = constants(8, CHUNKS * CHUNK_SLOTS * CHUNK_SLOTS).reshape(CHUNKS, CHUNK_SLOTS, CHUNK_SLOTS).copy()
    m[:, np.arange(CHUNK_SLOTS), np.arange(CHUNK_SLOTS)] = 0
    return m


def _index(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    matrix = _key_matrix()
    marks = constants(9, CHUNKS * CHUNK_SLOTS).reshape(CHUNKS, CHUNK_SLOTS)
    for batch in rows:
        for start in range(0, batch.num_rows, 1000):
            part = batch.slice(start, 1000)
            n = part.num_rows
            slots = np.frombuffer(b"".join(part.column(2).to_pylist()), dtype="<u2").reshape(n, CHUNKS, 1, CHUNK_SLOTS).astype(np.uint64)
            keys = splitmix(((slots + np.uint64(1)) * matrix[None]).sum(axis=3, dtype=np.uint64) ^ marks[None])
            each = CHUNKS * CHUNK_SLOTS
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys.reshape(-1).view(np.int64)),
                    pa.array(np.repeat(part.column(0).to_numpy(), each)),
                    pa.array(np.repeat(part.column(1).to_numpy(), each)),
                ],
                names=["key", "id", "n"],
            )


def _overlaps(rows: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in _few(rows):
        left, right = (batch.column(k).cast(pa.binary()).to_pylist() for k in (2, 3))
        both = np.empty(len(left), dtype=np.int64)
        either = np.empty(len(left), dtype=np.int64)
        for i, (x, y) in enumerate(zip(shingle_sets(left, width), shingle_sets(right, width), strict=True)):
            both[i] = len(np.intersect1d(x, y, assume_unique=True))
            either[i] = len(x) + len(y) - both[i]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(both), pa.array(either)], names=["a", "b", "n_both", "n_either"])


def _among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id may be one of ``ids`` (their only column), by a bit in a filter of 16 bits an id up to 8 MB.

    Others pass by chance, so a join by the ids has to follow; the filter keeps most other texts out of its exchange.
    """
    words = 1 << min(_FILTER_LOG, max(10, (ids.count() // 4).bit_length()))

    def place(key: Column) -> Column:
        return F.shiftrightunsigned(key, 6).bitwiseAND(F.lit(words - 1))

    bits = ids.select(F.xxhash64(*ids.columns).alias("t")).select(place(F.col("t")).alias("at"), F.expr("shiftleft(1L, cast(t & 63 as int))").alias("bit"))
    every = ids.sparkSession.range(words).select(F.col("id").alias("at"), F.lit(0).cast("long").alias("bit"))
    held = bits.union(every).groupBy("at").agg(F.bit_or("bit").alias("bits"))
    whole = held.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "bits"))), lambda x: x["bits"]).alias("bits"))
    key = F.xxhash64("id")
    return docs.where(F.call_function("getbit", F.get(whole.scalar(), place(key).cast("int")), key.bitwiseAND(F.lit(63)).cast("int")) == 1)


def confirm_links(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b), a stored table, whose full sets have 100 * intersection >= percent * union."""
    docs = _among(docs, pairs.select("a").union(pairs.select("b")))
    at_b = pairs.join(docs.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    at_a = at_b.join(docs.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    counted = at_a.select("a", "b", "text_a", "text_b").mapInArrow(lambda rows: _overlaps(rows, width), "a long, b long, n_both long, n_either long")
    return counted.where((F.col("n_either") > 0) & (F.col("n_both") * 100 >= F.col("n_either") * percent)).select("a", "b")


def _near(x: str, y: str, percent: int) -> Column:
    """Neither sizes nor sketches rule the pair out."""
    apart = F.bit_count(F.col(f"{x}.sketch1").bitwiseXOR(F.col(f"{y}.sketch1"))) + F.bit_count(F.col(f"{x}.sketch2").bitwiseXOR(F.col(f"{y}.sketch2")))
    sizes = F.least(f"{x}.n_shingles", f"{y}.n_shingles") * 100 >= F.greatest(f"{x}.n_shingles", f"{y}.n_shingles") * percent
    return sizes & (apart <= SKETCH_DISTANCE)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def _mixed(members: DataFrame, components: DataFrame) -> DataFrame:
    """(key, id, component) of the buckets that hold more than one component."""
    placed = members.join(components, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    return placed.join(mixed.select("key"), "key", "left_semi")


def _spelled(rows: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in _few(rows):
        found = list(shingle_sets(batch.column(2).cast(pa.binary()).to_pylist(), width))
        counts = [len(f) for f in found]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(found).view(np.int64)), *[pa.array(np.repeat(batch.column(k).to_numpy(), counts)) for k in (0, 1)]],
            names=["shingle", "id", "component"],
        )


def _ranked(placed: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(id, n, n_own, shingle, at): the start of each given set's shingles in one order for all sets; ``placed`` is a stored table.

    First come those that no other component has, of which there are ``n_own``, then the rarer ones. A
    set that shares too little with another to be linked shares nothing with it in these starts, or
    only at places after which too few shingles follow; the row keeps the place for that. Shingles that
    are a component's own are counted but have no row, unless a set has no other: then ``shingle`` is null.
    """
    rows = _among(docs, placed.select("id")).join(placed, "id").select("id", "component", "text").mapInArrow(lambda r: _spelled(r, width), "shingle long, id long, component long").distinct()
    spread = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"), (F.min("component") != F.max("component")).alias("mixed"))
    every = Window.partitionBy("id")
    found = rows.join(spread, "shingle").select(
        "id",
        F.count(F.lit(1)).over(every).alias("n"),
        F.count_if(~F.col("mixed")).over(every).alias("n_own"),
        "shingle",
        "mixed",
        (F.row_number().over(every.orderBy("mixed", "df", "shingle")) - 1).alias("at"),
    )
    start = found.where((F.col("at") * 100 <= F.col("n") * (100 - percent)) & (F.col("mixed") | (F.col("at") == 0)))
    return start.select("id", "n", "n_own", F.when(F.col("mixed"), F.col("shingle")).alias("shingle"), "at")


def _reach(n_x: str, own_x: str, n_y: str, own_y: str, percent: int) -> Column:
    """Sets of these sizes in different components could be linked: what either has for itself is in no intersection."""
    most = F.least(F.col(n_x) - F.col(own_x), F.col(n_y) - F.col(own_y))
    return most * 100 >= (F.col(n_x) + F.col(n_y) - most) * percent


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Per document its set size, the smallest id of its near-duplicate component and whether it stays.

    Returns (``id_col``, n_shingles, component_id, kept). Null, empty and word-less texts have size 0
    and are linked with nothing. Rows that share an id count as one document: a link of one is a link
    of all, while each keeps its own size. A row with a null id takes no part: its component is null
    and it is kept. Exact copies of a set are one class before any pair is formed. Other columns of
    ``docs`` are ignored. An empty table gives an empty result.

    Sketches of 128 bits only rule out pairs whose estimated similarity is far below the threshold;
    ``percent`` below 80 needs a larger ``SKETCH_DISTANCE`` and more chunks.
    """
    spark = docs.sparkSession
    sets = store(describe_sets(docs, id_col, text_col, width), fresh_path(spark, "sets"))
    classes = (
        sets.where("n_shingles > 0 AND id IS NOT NULL")
        .groupBy("n_shingles", "print1", "print2")
        .agg(F.min("id").alias("rep"), F.min_by(F.struct("sketch1", "sketch2", "slots"), "id").alias("signature"))
    )
    reps = store(classes.select("rep", "n_shingles", "print1", "print2", "signature.*"), fresh_path(spark, "reps"))
    small = reps.select(F.col("rep").alias("id"), "n_shingles", "sketch1", "sketch2")

    keys = reps.select("rep", "n_shingles", "slots").mapInArrow(_index, "key long, id long, n long")
    order = Window.partitionBy("key").orderBy("n", "id")
    near = keys.select("key", "id", F.first("id").over(order).alias("first"), F.lag("id").over(order).alias("prev"))
    near = store(near.where("prev IS NOT NULL AND id <> first").select("key", "id", "first", "prev"), fresh_path(spark, "buckets"))

    candidates = near.select("id", F.explode(F.array("first", "prev")).alias("other")).where("id <> other").distinct()
    scored = (
        candidates.join(small.alias("x").select(F.col("id"), F.struct("n_shingles", "sketch1", "sketch2").alias("x")), "id")
        .join(small.select(F.col("id").alias("other"), F.struct("n_shingles", "sketch1", "sketch2").alias("y")), "other")
        .where(_near("x", "y", percent))
    )
    apart = F.bit_count(F.col("x.sketch1").bitwiseXOR(F.col("y.sketch1"))) + F.bit_count(F.col("x.sketch2").bitwiseXOR(F.col("y.sketch2")))
    closest = scored.groupBy("id").agg(F.min(F.struct(apart.alias("apart"), "other")).alias("best"))
    tried = store(closest.select(F.least("id", "best.other").alias("a"), F.greatest("id", "best.other").alias("b")).distinct(), fresh_path(spark, "tried"))

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    links = store(confirm_links(tried, texts, width, percent), fresh_path(spark, "links"))
    first_round = store(connected_components(links), fresh_path(spark, "round"))

    members = near.select("key", "id").union(near.select("key", F.col("first").alias("id")).distinct())
    placed = _mixed(members, first_round)
    open_sets = store(placed.select("id", "component").distinct(), fresh_path(spark, "placed"))
    starts = store(_ranked(open_sets, texts, width, percent), fresh_path(spark, "starts"))
    own = starts.groupBy("id").agg(F.max("n_own").alias("n_own"))
    able = small.join(own, "id").where((F.col("n_shingles") - F.col("n_own")) * 100 >= F.col("n_shingles") * percent)
    able = store(able.select("id", "n_shingles", "n_own", "sketch1", "sketch2"), fresh_path(spark, "able"))
    members = store(_mixed(placed.select("key", "id").join(able.select("id"), "id", "left_semi"), first_round).select("key", "id"), fresh_path(spark, "members"))

    # the likeliest original of each bucket against its other members
    open_ = _mixed(members, first_round).join(able, "id")
    member = F.struct("n_own", "id", "component", "n_shingles", "sketch1", "sketch2")
    hubs = open_.groupBy("key").agg(F.min(member).alias("y"))
    toward = open_.select("key", member.alias("x")).join(hubs, "key").where((F.col("x.component") != F.col("y.component")) & _near("x", "y", percent) & _reach("x.n_shingles", "x.n_own", "y.n_shingles", "y.n_own", percent))
    untried = store(_ordered(toward).join(tried, ["a", "b"], "left_anti"), fresh_path(spark, "untried"))
    tried = tried.union(untried)
    links = links.union(store(confirm_links(untried, texts, width, percent), fresh_path(spark, "links")))
    second_round = store(connected_components(links), fresh_path(spark, "round"))

    # whatever is left between components, by the starts of the ranked sets
    seen = starts.where("shingle IS NOT NULL").join(second_round, "id", "left").select("shingle", "id", "n", "at", F.coalesce("component", "id").alias("component"))
    mixed = seen.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("shingle")
    side = F.struct("id", "component", "n", "at", "n_shingles", "sketch1", "sketch2")
    open_ = store(seen.join(mixed, "shingle", "left_semi").join(able.drop("n_own"), "id").select("shingle", side.alias("x")), fresh_path(spark, "open"))
    apart = (F.col("x.component") != F.col("y.component")) & ((F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.id") < F.col("y.id"))))
    enough = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at")) * (100 + percent) >= (F.col("x.n") + F.col("y.n")) * percent
    crossing = open_.join(open_.select("shingle", F.col("x").alias("y")), "shingle").where(apart & enough & _near("x", "y", percent))
    untried = store(_ordered(crossing).join(tried, ["a", "b"], "left_anti"), fresh_path(spark, "untried"))
    more = store(confirm_links(untried, texts, width, percent), fresh_path(spark, "links"))

    components = connected_components(links.union(more)) if not more.isEmpty() else second_round
    placed_reps = reps.join(components.withColumnRenamed("id", "rep"), "rep", "left").select("n_shingles", "print1", "print2", F.coalesce("component", "rep").alias("component"))
    found = sets.select("id", "n_shingles", "print1", "print2").join(placed_reps, ["n_shingles", "print1", "print2"], "left")
    component = F.coalesce("component", "id")
    return found.select(
        F.col("id").alias(id_col),
        "n_shingles",
        F.when(F.col("id").isNotNull(), component).alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: Exact: the pairs that share a shingle, their similarity on full sets, and the closure of the links.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, hash(sh) AS sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] || ' ' || ws[i+3]) END) AS sh FROM w)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_n FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_n >= 80 * (x.n + y.n - both_n)
), arcs AS (SELECT a, b FROM e UNION SELECT b, a FROM e
), r(id, c) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT arcs.b, r.c FROM r JOIN arcs ON arcs.a = r.id WHERE r.c < arcs.b
), m AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN m ON m.id = d.doc_id
"""
