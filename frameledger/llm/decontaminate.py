"""Benchmark passages in training documents, by a positional inverted index. Native expressions only.

The index holds a posting (term, document, place) for every word of the training texts that some test item has. A
phrase is looked up from its rarest terms: the list of the rarest gives the places where it may begin, the list of the next
rarest, taken at its offset from there, leaves few of them, and the lists of all its terms settle those. With ``slop`` a
word may stand so many places off, which gives proximity matches.

Documents are cut up once, where they lie: postings are written without a shuffle, and only lists that a lookup needs are
ever exchanged, dealt by document and place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a window; shorter items are one window.
WIDTH = 10
#: Places by which words of a proximity match may be off.
SLOP = 1
#: 64-bit words of a filter that keeps postings out of a lookup: 512 KB whatever it stands for.
FILTER_WORDS = 1 << 16
#: Parts of a term's list in a lookup, as one term may hold a large share of all postings.
LIST_PARTS = 16
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lowered(text: Column) -> Column:
    """``text`` with A-Z as a-z and nothing else changed; null as empty."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def _terms(low: Column) -> Column:
    return F.array_remove(F.split(low, SEPARATORS), "")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, a, b, low): ``a`` and ``b`` are 128 bits that stand for the id and the text, the same whenever they are worked out."""
    low = docs.select(F.col(id_col).alias("id"), lowered(F.col(text_col)).alias("low"))
    return low.select("id", F.xxhash64("id", "low").alias("a"), F.xxhash64(F.lit("text"), "low").alias("b"), "low")


def read_items(items: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(item, name, need, terms): items that have words. ``name`` is the id as a string, empty for null; ``need`` words are a window."""
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"), lowered(F.col(text_col)).alias("low")).distinct()
    rows = rows.select(F.xxhash64("name", "low").alias("item"), "name", F.transform(_terms(F.col("low")), lambda w: F.xxhash64(w)).alias("terms"))
    return rows.where(F.size("terms") > 0).select("item", "name", F.least(F.lit(width), F.size("terms")).alias("need"), "terms")


def _among(key: Column, keys: DataFrame) -> Column:
    """Whether the 64-bit ``key`` may be one of ``keys`` (their only column): a bit in a filter of fixed size.

    Others pass by chance, the more the more keys there are, so a join by the keys has to follow; the filter keeps what can't match out of
    its exchange, whatever the sizes.
    """
    bits = keys.toDF("t").select(F.shiftrightunsigned("t", 6).bitwiseAND(F.lit(FILTER_WORDS - 1)).alias("at"), F.expr("shiftleft(1L, cast(t & 63 as int))").alias("bit"))
    words = bits.groupBy("at").agg(F.bit_or("bit").alias("bits"))
    every = keys.sparkSession.range(FILTER_WORDS).select(F.col("id").alias("at"), F.lit(0).cast("long").alias("bits"))
    words = words.unionByName(every).groupBy("at").agg(F.bit_or("bits").alias("bits"))
    whole = words.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "bits"))), lambda x: x["bits"]).alias("bits"))
    held = F.get(whole.scalar(), F.shiftrightunsigned(key, 6).bitwiseAND(F.lit(FILTER_WORDS - 1)).cast("int"))
    return F.call_function("getbit", held, key.bitwiseAND(F.lit(63)).cast("int")) == 1


def build_index(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored postings (term, a, b, place) of ``docs`` for terms of ``items`` (as :func:`read_items` gives them).

    Places count from 0. A null text has no postings. Rows of equal id and text have the same key and the same postings.
    """
    known = items.select(F.explode("terms"))
    words = _keyed(docs, id_col, text_col).select("a", "b", F.posexplode(_terms(F.col("low"))).alias("place", "word"))
    postings = words.select(F.xxhash64("word").alias("term"), "a", "b", "place").where(_among(F.col("term"), known))
    return materialize(postings, "postings")


def rarest(items: DataFrame, postings: DataFrame) -> DataFrame:
    """(item, first, j1, t1, j2, t2): each window by its first place, with its two rarest terms and theirs; of equal ones the earlier.

    A window with a term that no document has is left out, and a window of one word has it twice.
    """
    counts = postings.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    places = items.select("item", F.posexplode("terms").alias("j", "term"))
    known = places.join(counts, "term", "left").groupBy("item").agg(F.array_sort(F.collect_list(F.struct("j", F.coalesce("n", F.lit(0)).alias("n"), "term"))).alias("ws"))
    both = items.select("item", "need").join(known, "item").select("item", "need", "ws", F.explode(F.sequence(F.lit(0), F.size("ws") - F.col("need"))).alias("first"))
    ranked = both.select("item", "first", F.array_sort(F.transform(F.slice("ws", F.col("first") + 1, F.col("need")), lambda x: F.struct(x["n"].alias("n"), x["j"].alias("j"), x["term"].alias("term")))).alias("r"))
    r1, r2 = F.col("r")[0], F.coalesce(F.get("r", F.lit(1)), F.col("r")[0])
    return ranked.where(r1["n"] > 0).select("item", "first", r1["j"].alias("j1"), r1["term"].alias("t1"), r2["j"].alias("j2"), r2["term"].alias("t2"))


def find(postings: DataFrame, items: DataFrame, width: int = WIDTH, slop: int = SLOP) -> DataFrame:
    """(a, b, name, exact, begin, end): where windows of items occur, as places [begin, end) of documents.

    Exact rows are maximal runs of an item's words that hold a window. The others are windows by proximity: the rarest
    word stands in its place and each other one at most ``slop`` places off; ``slop`` 0 gives exact rows only. No postings or
    no items give no rows.
    """
    windows = materialize(rarest(items, postings), "windows")
    offs = F.explode(F.sequence(F.lit(-slop), F.lit(slop)))
    # the list of the rarest term, in parts, gives alignments: the place of the item's word 0
    parts = F.explode(F.sequence(F.lit(0), F.lit(LIST_PARTS - 1)))
    pairs = windows.select("item", "j1", "t1", "j2", "t2").distinct().withColumn("part", parts)
    lists = postings.where(_among(F.col("term"), windows.select("t1"))).select(F.col("term").alias("t1"), "a", "b", "place", F.pmod("b", F.lit(LIST_PARTS)).cast("int").alias("part"))
    aligned = lists.join(pairs, ["t1", "part"]).select("a", "b", "item", (F.col("place") - F.col("j1")).alias("at"), "j1", "j2", "t2", offs.alias("off"))
    # the list of the next rarest, at its offset
    seconds = postings.where(_among(F.col("term"), windows.select("t2")))
    aligned = aligned.select("a", "b", "item", "at", "j1", (F.col("at") + F.col("j2") + F.col("off")).alias("place"), F.col("t2").alias("term"))
    aligned = materialize(aligned.join(seconds, ["a", "b", "place", "term"]).select("a", "b", "item", "at", "j1").distinct(), "alignments")
    # all lists, for the documents that are left
    near = F.explode(F.sequence(F.col("j1") - (width - 1), F.col("j1") + (width - 1)))
    words = aligned.select("a", "b", "item", "at", near.alias("j")).distinct()
    words = words.join(items.select("item", "need", F.posexplode("terms").alias("j", "term")), ["item", "j"]).withColumn("off", offs)
    words = words.withColumn("place", F.col("at") + F.col("j") + F.col("off"))
    left = postings.where(_among(F.col("a"), aligned.select("a")))
    met = words.join(left, ["a", "b", "place", "term"]).groupBy("a", "b", "item", "need", "at", "j").agg(F.min(F.abs("off")).alias("off"))
    met = materialize(met, "met")

    def runs(rows: DataFrame) -> DataFrame:
        order = Window.partitionBy("a", "b", "item", "at").orderBy("j")
        islands = rows.withColumn("run", F.col("j") - F.row_number().over(order)).groupBy("a", "b", "item", "need", "at", "run").agg(F.min("j").alias("lo"), F.max("j").alias("hi"))
        return islands.where(F.col("hi") - F.col("lo") + 1 >= F.col("need"))

    names = items.select("item", "name")
    place = F.col("at").cast("long")
    exact = runs(met.where("off = 0")).join(names, "item").select("a", "b", "name", F.lit(True).alias("exact"), (place + F.col("lo")).alias("begin"), (place + F.col("hi") + 1).alias("end"))
    if not slop:
        return exact
    loose = runs(met).select("a", "b", "item", "need", "at", F.explode(F.sequence("lo", F.col("hi") - F.col("need") + 1)).alias("first"))
    loose = loose.join(windows.select("item", "first", "j1"), ["item", "first"])
    still = met.where("off = 0").select("a", "b", "item", "at", F.col("j").alias("j1"))
    loose = loose.join(still, ["a", "b", "item", "at", "j1"]).join(names, "item")
    return exact.unionByName(loose.select("a", "b", "name", F.lit(False).alias("exact"), (place + F.col("first")).alias("begin"), (place + F.col("first") + F.col("need")).alias("end")))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, slop: int = SLOP) -> DataFrame:
    """Per document (id, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items).

    ``n_hit`` counts words inside of exact occurrences, each once; ``n_near_items`` items that occur exactly or by
    proximity. Null texts have no words; rows of one item id count as one item, which occurs if a window of any of them
    does, and a null item id is the empty one. Repeated rows and null ids are kept and judged alike; further columns are
    ignored. Without items no document is hit; no documents give no rows. Words are compared by 64-bit hashes, all ten of a window.
    """
    read = materialize(read_items(items, text_col="text", width=width), "items")
    spans = materialize(find(build_index(docs, read, id_col, text_col), read, width, slop), "spans")
    # a document's spans by their begin, of which it has at most one for each word
    ends = spans.where("exact").groupBy("a", "b", "begin").agg(F.max("end").alias("end"))
    before = F.max("end").over(Window.partitionBy("a", "b").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0).cast("long"), F.col("end") - F.greatest("begin", F.coalesce(before, F.lit(0).cast("long"))))
    hits = ends.select("a", "b", fresh.alias("hit")).groupBy("a", "b").agg(F.sum("hit").alias("n_hit"))
    names = spans.groupBy("a", "b").agg(F.collect_set(F.when(F.col("exact"), F.col("name"))).alias("names"), F.count_distinct("name").alias("n_near_items"))
    found = materialize(names.join(hits, ["a", "b"], "left"), "contaminated")
    rows = _keyed(docs, id_col, text_col).select("id", "a", "b", F.regexp_count("low", F.lit(WORD)).cast("long").alias("n_words"))
    zero = F.lit(0).cast("long")
    joined = rows.join(found, ["a", "b"], "left")
    names_or_none = F.coalesce("names", F.array().cast("array<string>"))
    return joined.select(
        F.col("id").alias(id_col),
        "n_words",
        F.coalesce("n_hit", zero).alias("n_hit"),
        F.size(names_or_none).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(names_or_none), ","), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
        F.coalesce("n_near_items", zero).alias("n_near_items"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT row_number() OVER () AS b, coalesce(item_id::VARCHAR, '') AS name, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), n AS (SELECT *, least(10, len(w)) AS need FROM b WHERE len(w) > 0
), win AS (SELECT b, name, need, s, w[s:s + need - 1] AS v, w FROM (SELECT *, unnest(range(1, len(w) - need + 2)) AS s FROM n)
), g AS (
  SELECT r, i, need, array_to_string(w[i:i + need - 1], ' ') AS v FROM (SELECT r, w, need, unnest(range(1, greatest(len(w) - need + 2, 1))) AS i FROM d CROSS JOIN (SELECT DISTINCT need FROM win))
), hit AS (SELECT DISTINCT r, i, g.need, name FROM g JOIN win ON win.need = g.need AND array_to_string(win.v, ' ') = g.v
), hits AS (SELECT r, count(*)::BIGINT AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + need)) FROM hit) GROUP BY r
), names AS (SELECT r, count(DISTINCT name)::BIGINT AS n_items, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM hit GROUP BY r
), tok AS (SELECT r, generate_subscripts(w, 1) AS p, unnest(w) AS t FROM d
), df AS (SELECT t, count(*) AS n FROM tok GROUP BY t
), wp AS (SELECT b, name, need, s, unnest(range(s, s + need)) AS j, unnest(v) AS t FROM win
), wr AS (SELECT wp.*, row_number() OVER (PARTITION BY b, s ORDER BY coalesce(n, 0), j) AS k FROM wp LEFT JOIN df USING (t)
), al AS (SELECT b, name, need, s, r, p - j AS at FROM wr JOIN tok USING (t) WHERE k = 1
), near AS (
  SELECT r, count(DISTINCT name)::BIGINT AS n_near_items FROM (
    SELECT al.r, al.name, al.b, al.s, al.at FROM al JOIN wr ON wr.b = al.b AND wr.s = al.s JOIN tok ON tok.r = al.r AND tok.t = wr.t AND tok.p BETWEEN al.at + wr.j - 1 AND al.at + wr.j + 1
    GROUP BY al.r, al.name, al.b, al.s, al.at, al.need HAVING count(DISTINCT wr.j) = al.need
  ) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near_items, 0)::BIGINT AS n_near_items
FROM d LEFT JOIN hits USING (r) LEFT JOIN names USING (r) LEFT JOIN near USING (r)
"""
