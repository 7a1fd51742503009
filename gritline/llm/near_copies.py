"""Keep one document of each group of near copies, by SimHash fingerprints and the similarity of sets of shingles."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gritline.llm.batches import list_array, map_text, offsets_of
from gritline.llm.components import components
from gritline.llm.simhash import Ring, linked, majority, shingle_hashes
from gritline.operators.skew import apart, counted, keyed_join, salted_join, scratch, stage

WORDS = 5
SIMILARITY = 0.8
DENSE_BUCKET = 32
BLOCK = 512  # rows of a large bucket that a row is compared with at a time
BANDS = 24
BAND_ROWS = 5
SAMPLE = 64
MIDDLE_ROWS = 24
SLICE = 4096  # shingles that are hashed at a time
ROUNDING = 1e-6  # of sums of fractions, far below one shingle


def shingle_set(text: str, words: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order."""
    return np.unique(shingle_hashes(text, words).view(">u8").astype(np.uint64))


@functools.cache
def _factors() -> np.ndarray:
    """Odd numbers; the product of a shingle's hash with each of them orders shingles anew."""
    return np.random.default_rng(5).integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64) << np.uint64(1) | np.uint64(1)


def band_keys(found: np.ndarray) -> np.ndarray:
    """A key for each band: a hash of the least shingles of a set in ``BAND_ROWS`` orders.

    Two sets of similarity s agree in an order with chance s, so they share one of the keys with chance
    1 - (1 - s ** BAND_ROWS) ** BANDS: 0.99993 at 0.8, more above. Equal sets share them all.
    """
    if not len(found):
        return np.zeros(0, np.int64)
    factors = _factors()
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(found), SLICE):
        np.minimum(least, (found[start : start + SLICE, None] * factors).min(axis=0), out=least)
    mixed = np.zeros(BANDS, np.uint64)
    for column in least.reshape(BANDS, BAND_ROWS).T:
        mixed = (mixed ^ column) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return (mixed + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def fingerprint(found: np.ndarray) -> int:
    """The SimHash of a set of shingles, each counted once."""
    return majority(found.astype(">u8").view(np.uint8).reshape(-1, 8))


def _digest(text: str) -> bytes:
    return hashlib.sha256(text.encode()).digest()


def _shingled(df: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``digest``, ``n`` (shingles), ``fp`` (their SimHash) and ``keys`` of every row.

    The last key is the fingerprint's own, so that texts of one fingerprint meet like those of one band.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        sets = [shingle_set(text, words) for text in texts]
        prints = np.array([fingerprint(found) for found in sets], np.int64)
        keys = [np.append(band_keys(found), fp) if len(found) else np.zeros(0, np.int64) for found, fp in zip(sets, prints)]
        ends = offsets_of(np.array([len(k) for k in keys], np.int64))
        columns = [
            batch.column(0), pa.array(map(_digest, texts), pa.binary()), pa.array([len(x) for x in sets], pa.int32()),
            pa.array(prints), list_array(ends, np.concatenate([*keys, np.zeros(0, np.int64)])),
        ]
        return pa.record_batch(columns, names=["id", "digest", "n", "fp", "keys"])

    return map_text(df, work, "id bigint, digest binary, n int, fp bigint, keys array<bigint>", id_col, text_col)


def fingerprint_pairs(rows: DataFrame, ring: Ring = Ring()) -> DataFrame:
    """Pairs (a, b) of rows, one for each link between fingerprints that differ in at most ``ring.radius`` bits.

    The links are those of chains of segments on a ring (see ``simhash.linked``). A fingerprint is stood for by its
    least row; rows of one fingerprint meet by its key.
    """
    codes = stage(rows.where("n > 0").groupBy("fp").agg(F.min("row").alias("least")))
    links = stage(linked(codes.select("fp"), ring))
    of_a = codes.select(F.col("fp").alias("a"), F.col("least").alias("row_a"))
    of_b = codes.select(F.col("fp").alias("b"), F.col("least").alias("row_b"))
    named = links.join(apart(of_a), "a").join(apart(of_b), "b")
    return named.select(F.least("row_a", "row_b").alias("a"), F.greatest("row_a", "row_b").alias("b"))


def _own_digest(text_col: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))


def _sets_of(df: DataFrame, rows: DataFrame, asked: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """``row`` and ``hashes``, the whole shingle set, of the rows in ``asked``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found = shingle_set(batch.column(1)[k].as_py(), words)
                listed = list_array(np.array([0, len(found)]), found.view(np.int64))
                yield pa.record_batch([batch.column(0).slice(k, 1), batch.column(2).slice(k, 1), listed], names=names)

    names = ["id", "digest", "hashes"]
    keys = rows.join(apart(asked), "row", "left_semi").select("row", "id", "digest")
    some = keys.select(F.col("id").alias("_id"), F.col("digest").alias("_digest")).distinct()
    texts = df.select(
        F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        _own_digest(text_col).alias("digest"),
    )
    texts = texts.join(apart(some), (F.col("id") == F.col("_id")) & (F.col("digest") == F.col("_digest")), "left_semi")
    sets = texts.dropDuplicates(["id", "digest"]).mapInArrow(run, "id bigint, digest binary, hashes array<bigint>")
    return keys.join(apart(sets), ["id", "digest"]).select("row", "hashes")


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose sets have at least this Jaccard similarity."""
    left = sets.select(F.col("row").alias("a"), F.col("hashes").alias("left"))
    right = sets.select(F.col("row").alias("b"), F.col("hashes").alias("right"))
    both = F.size("left") + F.size("right")
    common = F.size(F.array_intersect("left", "right"))
    sized = F.least(F.size("left"), F.size("right")) >= similarity * F.greatest(F.size("left"), F.size("right")) - ROUNDING
    joined = pairs.join(apart(right), "b").join(apart(left), "a")
    return joined.where(sized & (common * (1 + similarity) >= similarity * both - ROUNDING)).select("a", "b")


def between(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose nodes are not in one component."""
    a = roots.select(F.col("node").alias("a"), F.col("root").alias("root_a"))
    b = roots.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
    named = pairs.join(apart(a), "a", "left").join(apart(b), "b", "left")
    return named.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def _meetings(rows: DataFrame, similarity: float, dense_bucket: int) -> DataFrame:
    """``token``, ``a``, ``b``: rows that share a key; where over ``dense_bucket`` do, one by one (``b`` null).

    Rows whose sizes differ too much don't meet. Buckets are read in order, so a task holds one of at
    most ``dense_bucket`` rows. Keys that come more often than that among one row of ``SAMPLE`` are dense for sure; their
    rows aren't brought together at all, so what a task reads of one key is bounded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        crowded: int | None = None  # the last token, if its rows went out one by one already

        def settle(token: np.ndarray, row: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
            sizes = np.diff(np.append(starts, len(token)))
            dense = np.repeat((sizes > dense_bucket) | (token[starts] == crowded if crowded is not None else False), sizes)
            tokens, first, second = [token[dense]], [row[dense]], [np.full(int(dense.sum()), -1)]
            for step in range(1, min(dense_bucket, len(token))):
                same = np.flatnonzero((token[step:] == token[:-step]) & ~dense[step:])
                if not len(same):
                    break
                x, y = same, same + step
                small, large = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
                may = small >= similarity * large - ROUNDING
                x, y = x[may], y[may]
                tokens.append(token[x])
                first.append(np.minimum(row[x], row[y]))
                second.append(np.maximum(row[x], row[y]))
            b = np.concatenate(second)
            columns = [pa.array(np.concatenate(tokens)), pa.array(np.concatenate(first)), pa.array(b, mask=b < 0)]
            return pa.record_batch(columns, names=["token", "a", "b"])

        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
            now = [np.concatenate(pair) for pair in zip(held, new)]
            last = now[0][-1] if len(now[0]) else None
            goes_on = int(np.searchsorted(now[0] == last, True)) if last is not None else 0
            if len(now[0]) - goes_on > dense_bucket or last == crowded:
                yield settle(*now)
                crowded, held = last, [c[:0] for c in now]
            else:
                yield settle(*(c[:goes_on] for c in now))
                held = [c[goes_on:] for c in now]
        yield settle(*held)

    postings = rows.select(F.explode("keys").alias("token"), "row", "n")
    some = rows.where(F.pmod(F.xxhash64("row"), F.lit(SAMPLE)) == 0).select(F.explode("keys").alias("token"))
    hot = counted(stage(some.groupBy("token").count().where(F.col("count") > dense_bucket).select("token")))
    met = postings.join(hot, "token", "left_anti").repartition("token").sortWithinPartitions("token", "row")
    alone = postings.join(hot, "token", "left_semi").select("token", F.col("row").alias("a"), F.lit(None).cast("bigint").alias("b"))
    return met.mapInArrow(run, "token bigint, a bigint, b bigint").union(alone)


def _families(members: DataFrame) -> DataFrame:
    """``family``, ``row`` and ``typical`` (its dense keys there) for the rows of dense buckets.

    Rows that share a dense key are in one family at least. Keys that come together mostly
    are one family, so that a group of near copies is one and not as many as its keys.
    """
    counts = stage(members.groupBy("token").agg(F.count("*").alias("size")))
    sized = stage(keyed_join(members, counts, ["token"], ["row"]))
    top = sized.groupBy("row").agg(F.max(F.struct("size", "token")).alias("top"))
    beside = sized.join(apart(top), "row").groupBy("token", "size", F.col("top.token").alias("other")).count()
    links = beside.where("token <> other AND 2 * count >= size").select(F.col("token").alias("a"), F.col("other").alias("b"))
    names = stage(components(stage(links))).select(F.col("node").alias("token"), F.col("root").alias("name"))
    families = counts.join(apart(names), "token", "left").select("token", F.coalesce("name", "token").alias("family"))
    return keyed_join(members, families, ["token"], ["row"]).groupBy("family", "row").agg(F.count("*").alias("typical"))


def _middles(members: DataFrame, sets: DataFrame) -> DataFrame:
    """``family`` and ``middle``: the shingles that most of a family's ``MIDDLE_ROWS`` most typical rows have.

    Any set may stand in the middle; the nearer it is to the rows, the fewer of their pairs are looked at.
    """
    typical = Window.partitionBy("family").orderBy(F.desc("typical"), "row")
    few = members.withColumn("place", F.row_number().over(typical)).where(F.col("place") <= MIDDLE_ROWS)
    few = few.withColumn("few", F.count("*").over(Window.partitionBy("family")))
    tokens = few.join(apart(sets), "row").select("family", "few", F.explode("hashes").alias("token"))
    most = tokens.groupBy("family", "few", "token").count().where("2 * count > few")
    return most.groupBy("family").agg(F.collect_list("token").alias("middle"))


def _differences(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Each row of a family by what its set has more and less than the family's middle.

    ``size`` is the length of ``delta``, which lists shingles that the middle lacks before shingles that the row
    lacks; ``excess`` is ``size`` less c n, where c = (1 - similarity) / (1 + similarity): two sets of n and m shingles are
    alike if at most c (n + m) shingles are in one of them alone. So two rows are, if their excesses add up to no more
    than zero. The family's ``pivot`` has the least excess, ``reach`` is how far that is below zero, and ``near`` rows are
    alike to it for that reason.
    """
    c = (1 - similarity) / (1 + similarity)
    joined = salted_join(members.join(apart(sets), "row"), apart(stage(_middles(members, sets))), ["family"], ["row"], "left")
    middle = F.coalesce("middle", F.array().cast("array<bigint>"))
    delta = F.concat(F.array_except("hashes", middle), F.array_except(middle, "hashes"))
    sized = joined.select("family", "row", F.size("hashes").alias("n"), delta.alias("delta")).withColumn("size", F.size("delta"))
    sized = stage(sized.withColumn("excess", F.col("size") - c * F.col("n")))
    least = sized.groupBy("family").agg(
        F.min_by("row", F.struct("excess", "row")).alias("pivot"), (-F.min("excess")).alias("reach")
    )
    deltas = keyed_join(sized, least, ["family"], ["row"])
    return deltas.withColumn("near", F.col("excess") <= F.col("reach") + ROUNDING)


def _beyond(deltas: DataFrame) -> DataFrame:
    """Pairs (a, b) of a family that may be alike, one of them at least not alike to the pivot.

    Two rows differ by the sum of their deltas' sizes less twice what the deltas share. So they are alike
    if the deltas share half the sum of their excesses, which is over zero for such pairs: they meet at
    one of the first tokens of both deltas, with so many behind it in each. A row of the family has
    an excess of at least minus the reach, one that is not near of more than the reach.
    """
    least = F.when(F.col("near"), F.col("excess") + F.col("reach")).otherwise(F.col("excess") - F.col("reach"))
    must = F.greatest(F.lit(1), F.ceil(least / 2 - ROUNDING))
    length = F.greatest(F.lit(0), F.col("size") - must + 1).cast("int")
    families = counted(stage(deltas.where("NOT near").select("family").distinct()))
    posted = deltas.join(families, "family", "left_semi").select(
        "family", "row", "near", "size", "excess", F.posexplode(F.slice("delta", F.lit(1), length)).alias("at", "token")
    )
    posted = stage(posted.select("family", "token", "row", "near", "excess", (F.col("size") - F.col("at")).alias("rest")))
    counts = posted.groupBy("family", "token").agg(F.count("*").alias("all"), F.count_if(~F.col("near")).alias("far"))
    blocks = counts.where("far > 0 AND all > 1").select("family", "token", F.ceil(F.col("all") / BLOCK).alias("blocks"))
    open_rows = stage(keyed_join(posted, blocks, ["family", "token"], ["row"]))
    x = open_rows.where("NOT near").withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    y = open_rows.withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")))
    x, y = x.alias("x"), apart(y).alias("y")
    need = (F.col("x.excess") + F.col("y.excess")) / 2
    met = x.join(
        y,
        (F.col("x.family") == F.col("y.family"))
        & (F.col("x.token") == F.col("y.token"))
        & (F.col("x.block") == F.col("y.block"))
        & (F.col("y.near") | (F.col("x.row") < F.col("y.row")))
        & (F.least("x.rest", "y.rest") >= need - ROUNDING),
    )
    return met.select(F.least("x.row", "y.row").alias("a"), F.greatest("x.row", "y.row").alias("b")).where("a <> b").distinct()


def _links(
    df: DataFrame, rows: DataFrame, words: int, similarity: float, dense_bucket: int, id_col: str, text_col: str
) -> DataFrame:
    """``node`` and ``root`` of all rows that are linked to another one."""
    printed = fingerprint_pairs(rows)
    found = stage(_meetings(rows, similarity, dense_bucket))
    pairs = stage(printed.union(found.where("b IS NOT NULL").select("a", "b")).distinct())
    crowd = found.where("b IS NULL").select("token", F.col("a").alias("row"))
    members = stage(_families(stage(crowd)))
    asked = pairs.select(F.col("a").alias("row")).union(pairs.select("b")).union(members.select("row")).distinct()
    sets = stage(_sets_of(df, rows, asked, words, id_col, text_col))
    deltas = stage(_differences(members, sets, similarity))
    bare = rows.where("n = 0").select(F.col("row").alias("b"))
    least = bare.agg(F.min("b")).first()[0]
    none = bare.select(F.lit(least).cast("bigint").alias("a"), "b").where("a <> b")
    stars = deltas.where("near AND row <> pivot").select(F.col("pivot").alias("a"), F.col("row").alias("b"))
    # Each row is compared with the least one it met first. Pairs that are then in one component need
    # no comparison, so a group of near copies costs a comparison for each row.
    first = stage(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    links = stage(none.union(stars).union(_alike(first, sets, similarity)))
    roots = stage(components(links))
    rest = pairs.join(apart(first), ["a", "b"], "left_anti").union(_beyond(deltas)).distinct()
    more = _alike(stage(between(rest, roots)), sets, similarity)
    return components(stage(links.union(more)))


def near_groups(
    df: DataFrame,
    words: int = WORDS,
    similarity: float = SIMILARITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    dense_bucket: int = DENSE_BUCKET,
) -> DataFrame:
    """``id``, ``digest`` (SHA-256 of the text), ``keep_id`` and ``keep_digest`` of rows whose group keeps another one.

    Two texts are linked if their sets of shingles of ``words`` words have a Jaccard similarity of
    at least ``similarity``; texts without words are alike. Of a component, the row with the smallest id, then the
    smallest digest stays. Texts meet where chains of their SimHash fingerprints do (see ``fingerprint_pairs``) or
    where they share a key of least shingles (see ``band_keys``), and whole sets are compared then. Buckets of
    over ``dense_bucket`` rows aren't compared pair by pair: each family of them goes by the differences
    to a set in its middle, which leaves few pairs and loses none.

    Rows with a null id take no part. A null text is empty. Rows that repeat an id and a text stay or go together,
    other rows that repeat an id are rows of their own. Very long texts go through as they are, in slices of a batch.
    Other columns are not read, whatever their names; an empty table has no groups. The result is written to the
    shared folder; all other intermediate tables are deleted.
    """
    some = df.select(id_col, text_col).where(F.col(id_col).isNotNull())
    with scratch(df.sparkSession) as result:
        shingled = _shingled(some, words, id_col, text_col)
        rows = stage(shingled.withColumn("row", F.monotonically_increasing_id()))
        roots = stage(_links(some, rows, words, similarity, dense_bucket, id_col, text_col))
        named = stage(roots.join(apart(rows.select(F.col("row").alias("node"), "id", "digest")), "node"))
        kept = named.groupBy("root").agg(F.min(F.struct("id", "digest")).alias("keep"))
        both = salted_join(named, apart(kept), ["root"], ["node"])
        gone = both.where(F.struct("id", "digest") != F.col("keep"))
        return result(
            gone.select("id", "digest", F.col("keep.id").alias("keep_id"), F.col("keep.digest").alias("keep_digest")).distinct()
        )


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows that stay, with all their columns; rows with a null id stay. See ``near_groups``.

    Rows go by id and text, so a row that shares its id with a near copy stays.
    """
    gone = near_groups(df, id_col=id_col, text_col=text_col, **options).select(F.struct("id", "digest").alias("gone"))
    own = F.struct(df[id_col].cast("bigint").alias("id"), F.unhex(F.sha2(F.coalesce(df[text_col], F.lit("")), 256)).alias("digest"))
    return df.join(gone, own == gone["gone"], "left_anti")
