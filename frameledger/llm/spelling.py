"""Spelling variants of a corpus's words: which words are one edit apart, and which form each goes back to.

Near words are found by dense tiles: words as padded matrices of code points, blocks of them compared with each other, a pair
being one edit apart if its common prefix and common suffix together reach the longer length less one. Which words meet in a
tile follows from that: the edit lies in one window of the longer word, and what is before and behind the window
is equal. A word goes to one tile for each window, so no word is compared with the whole vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

LETTERS = "[A-Za-zÀ-ÿ]+"
#: One in so many occurrences loses a letter.
MISSPELT = 199
LEAST_POINTS, LEAST_COUNT = 6, 5
#: A form is so many times as frequent as the word.
FORM_FACTOR = 5
#: Code points of a window, and the windows of a word of any length; longer words get wider windows.
WINDOW, WINDOWS = 2, 24
#: Words of a block, and compared code points held at once.
BLOCK, TILE_POINTS = 64, 1 << 22
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def misspelt(doc_id: Column, run: Column, one_in: int = MISSPELT) -> Column:
    """``run`` without one of its letters, if the CRC of ``<doc_id>:<run>`` is a multiple of ``one_in``; a null id is empty."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.char_length(run)).cast("int")
    shorter = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    return F.when(h % one_in == 0, shorter).otherwise(run)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_points: int = LEAST_POINTS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): words of whole texts by their occurrences, counted before they are shuffled. A null text has none."""
    runs = docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"({LETTERS})"), F.lit(1))).alias("run"))
    words = runs.select(misspelt(F.col("id"), F.translate("run", _UPPER, _UPPER.lower())).alias("word")).where(F.char_length("word") >= least_points)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def tile_keys(words: DataFrame) -> DataFrame:
    """(key, m, first, end, word, n): a row for each tile that a word belongs to.

    A tile holds words of ``m`` code points and of one less that are equal outside of the places [first, end) of the longer. With windows
    of two places it has at most one word for each pair of letters and for each letter, whatever the corpus.
    """
    length = F.char_length("word")
    sized = words.select("word", "n", length.alias("points"), F.explode(F.array(length, length + 1)).alias("m"))
    sized = sized.withColumn("width", F.greatest(F.lit(WINDOW), F.ceil(F.col("m") / WINDOWS).cast("int")))
    tiles = sized.select("word", "n", "points", "m", "width", F.explode(F.sequence(F.lit(0), F.ceil(F.col("m") / F.col("width")).cast("int") - 1)).alias("k"))
    tiles = tiles.select("word", "n", "points", "m", (F.col("k") * F.col("width")).alias("first"), F.least(F.col("k") * F.col("width") + F.col("width"), "m").alias("end"))
    behind = F.col("m") - F.col("end")
    before, after = F.substring(F.col("word"), F.lit(1), F.col("first")), F.substring(F.col("word"), F.col("points") - behind + 1, behind)
    return tiles.select(F.xxhash64("m", "first", before, after).alias("key"), "m", "first", "end", "word", "n")


def _padded(words: list[str], lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, flush left and flush right, zero elsewhere."""
    left = np.array(words, dtype=f"<U{width}").view(np.uint32).reshape(len(words), width)
    places = np.arange(width)[None, :] - (width - lengths)[:, None]
    right = np.where(places >= 0, np.take_along_axis(left, np.maximum(places, 0), axis=1), 0).astype(np.uint32)
    return left, right


def _blocks(starts: np.ndarray, sizes: np.ndarray) -> dict[int, list[np.ndarray]]:
    """Pairs of blocks of each tile, by the power of two that holds their larger side: rows (a, n of a, b, n of b)."""
    pairs: dict[int, list[np.ndarray]] = {}
    side = np.where(sizes <= BLOCK, 1 << np.ceil(np.log2(np.maximum(sizes, 2))).astype(int), BLOCK)
    for s in np.unique(side):
        one = (side == s) & (sizes <= BLOCK)
        if one.any():
            pairs.setdefault(int(s), []).append(np.stack([starts[one], sizes[one], starts[one], sizes[one]], axis=1))
    for start, size in zip(starts[sizes > BLOCK].tolist(), sizes[sizes > BLOCK].tolist()):
        at = np.arange(0, size, BLOCK)
        i, j = np.triu_indices(len(at))
        n = np.minimum(BLOCK, size - at)
        pairs.setdefault(BLOCK, []).append(np.stack([start + at[i], n[i], start + at[j], n[j]], axis=1))
    return pairs


def single_edits(words: list[str], lengths: np.ndarray, tile: np.ndarray, m: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of words of one tile that are one edit apart, each once.

    ``tile`` numbers the rows' tiles, equal ones being neighbours. A pair may meet in several tiles, as may a
    deletion in a run of equal letters; it counts where the end of the common prefix lies in the tile's window.
    """
    found_i, found_j = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    starts = np.flatnonzero(np.concatenate(([True], tile[1:] != tile[:-1]))) if len(tile) else np.empty(0, np.int64)
    sizes = np.diff(np.append(starts, len(tile)))
    starts, sizes = starts[sizes > 1], sizes[sizes > 1]
    widths = 1 << np.ceil(np.log2(np.maximum(m[starts], 8))).astype(int)
    for width in np.unique(widths):
        here = widths == width
        of_width = np.repeat(starts[here], sizes[here]) + (np.arange(sizes[here].sum()) - np.repeat(np.cumsum(sizes[here]) - sizes[here], sizes[here]))
        left, right = _padded([words[r] for r in of_width.tolist()], lengths[of_width], int(width))
        local = np.cumsum(sizes[here]) - sizes[here]
        for side, groups in _blocks(local, sizes[here]).items():
            pairs = np.concatenate(groups)
            step = max(1, TILE_POINTS // (side * side * int(width)))
            for at in range(0, len(pairs), step):
                a, na, b, nb = (pairs[at : at + step, c][:, None] for c in range(4))
                places = np.arange(side)[None, :]
                ra, rb = np.minimum(a + places, len(left) - 1), np.minimum(b + places, len(left) - 1)
                real = (places < na)[:, :, None] & (places < nb)[:, None, :] & (ra[:, :, None] < rb[:, None, :])
                equal = left[ra][:, :, None, :] == left[rb][:, None, :, :]
                prefix = np.where(equal.all(-1), width, equal.argmin(-1))
                equal = (right[ra][:, :, None, :] == right[rb][:, None, :, :])[..., ::-1]
                suffix = np.where(equal.all(-1), width, equal.argmin(-1))
                gi, gj = of_width[ra], of_width[rb]
                longer = np.maximum(lengths[gi][:, :, None], lengths[gj][:, None, :])
                near = real & (longer == m[gi][:, :, None]) & (prefix + suffix >= longer - 1) & (prefix >= first[gi][:, :, None]) & (prefix < end[gi][:, :, None])
                t, x, y = np.nonzero(near)
                found_i.append(gi[t, x])
                found_j.append(gj[t, y])
    return np.concatenate(found_i), np.concatenate(found_j)


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n): every ordered pair of distinct words that are one inserted, deleted or replaced code point apart.

    ``words`` has (word, n), each word once, none empty or null. No words give no pairs.
    """
    schema = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])

    def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key, m, first, end = (rows.column(c).to_numpy() for c in ("key", "m", "first", "end"))
        change = np.concatenate(([True], (key[1:] != key[:-1]) | (m[1:] != m[:-1]) | (first[1:] != first[:-1])))
        tile = np.cumsum(change)
        together = np.bincount(tile)[tile] > 1
        if not together.any():
            return
        rows = rows.filter(pa.array(together))
        words, n = rows.column("word").to_pylist(), rows.column("n").to_numpy()
        lengths = np.fromiter((len(w) for w in words), np.int64, len(words))
        i, j = single_edits(words, lengths, tile[together], m[together].astype(np.int64), first[together], end[together])
        if len(i):
            w = rows.column("word").combine_chunks()
            a, b = np.concatenate([i, j]), np.concatenate([j, i])
            yield pa.RecordBatch.from_arrays([w.take(pa.array(a)), w.take(pa.array(b)), pa.array(n[b], pa.int64())], schema=schema)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            key = batch.column(0).to_numpy()
            if size < 1 << 15 or key[0] == key[-1]:
                continue
            cut = int(np.searchsorted(key, key[-1]))  # the last tile may go on in the next batch
            yield from pairs(pa.Table.from_batches([*held[:-1], batch.slice(0, cut)]))
            held, size = [batch.slice(cut)], batch.num_rows - cut
        if held:
            yield from pairs(pa.Table.from_batches(held))

    return tile_keys(words).repartition("key").sortWithinPartitions("key", "m", "first").mapInArrow(compare, "word string, near string, near_n long")


def forms(words: DataFrame, near: DataFrame, factor: int = FORM_FACTOR) -> DataFrame:
    """(word, form, n, n_near, form_n): the form is the near word of largest n, the smallest of equals, if it is ``factor`` times as frequent."""
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    joined = words.join(best, "word", "left")
    goes = -F.col("best.less") >= factor * F.col("n")
    return joined.select("word", F.when(goes, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(goes, -F.col("best.less")).alias("form_n"))


def with_roots(found: DataFrame) -> DataFrame:
    """Adds ``root``: the last of the forms that follow each other from a word, itself if it has none.

    Every round doubles how far each word has gone. A form is ``factor`` times as frequent, so chains have at most 27 words
    and there are at most five rounds.
    """
    steps = materialize(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "forms")
    while True:
        beyond = steps.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        joined = materialize(steps.join(beyond, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "forms")
        steps = joined.select("word", "root")
        if not joined.where("moved").limit(1).count():
            break
    return found.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame) -> DataFrame:
    """Every word of the corpus with its form and root.

    A null text has no words and a null id is empty in the CRC; repeated rows count each; further columns are ignored; texts and
    words of any length are taken whole. No words give no rows.
    """
    words = materialize(vocabulary(docs), "vocabulary")
    return with_roots(materialize(forms(words, near_words(words)), "variants"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE t AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384))) AS crc
), runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), r AS (SELECT id, run, count(*) AS k FROM runs GROUP BY id, run
), b AS (
  SELECT *, flatten(list_transform(string_split(id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [(192 + (unicode(c) >> 6))::BIGINT, (128 + (unicode(c) & 63))::BIGINT] END)) AS bytes FROM r
), h AS (
  SELECT run, k, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, crc[1 + (xor(c, x) & 255)])), 4294967295) AS h FROM b CROSS JOIN t
), o AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM h
), v AS (SELECT word, sum(k)::BIGINT AS n FROM o WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5
), e AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v
), p AS (SELECT word, n, i, substr(word, 1, i - 1) AS pre, substr(word, i + 1) AS post FROM e
), near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM p a JOIN p b ON a.i = b.i AND a.pre = b.pre AND a.post = b.post AND a.word <> b.word
  UNION SELECT p.word, v.word, v.n FROM p JOIN v ON v.word = pre || post
  UNION SELECT v.word, p.word, p.n FROM p JOIN v ON v.word = pre || post
), best AS (SELECT word, count(*) AS n_near, max(near_n) AS form_n, min(near ORDER BY near) FILTER (top) AS form FROM (SELECT *, near_n = max(near_n) OVER (PARTITION BY word) AS top FROM near) GROUP BY word
), f AS (
  SELECT v.word, CASE WHEN form_n >= 5 * n THEN form END AS form, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN form_n >= 5 * n THEN form_n END AS form_n FROM v LEFT JOIN best USING (word)
), walk AS (
  SELECT word, word AS root, 0 AS d FROM f UNION ALL SELECT walk.word, f.form, d + 1 FROM walk JOIN f ON f.word = walk.root WHERE f.form IS NOT NULL
), roots AS (SELECT word, arg_max(root, d) AS root FROM walk GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM f JOIN roots USING (word)
"""
