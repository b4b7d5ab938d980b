"""Near duplicates by HyperMinHash: compressed registers, banding, corrected estimates, verification.

A document's set is its distinct 5-word shingles as 64-bit hashes. Documents of equal sets form a
class and only its first document goes on. A class has ``REGISTERS`` registers: shingles are dealt
to them by their first bits and the least of each is kept as the count of its leading zeros and the bits
after them. An empty register borrows that of another by an order of its own, so that also sets of a few
shingles agree in each register with a probability of their similarity. ``BANDS`` keys of
``REGISTERS / BANDS`` registers find candidates; at a similarity of 0.85 the chance to share none is under 1e-9.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.graph import components, written
from tallyforge.llm.textbatch import NOT_SPACE, lower_ascii, mix, prefix_sums, slices, span_hash, words

SHINGLE = 5
REGISTERS, REGISTER_BITS = 128, 7
MANTISSA_BITS = 10
BANDS = 32
#: Standard errors of the estimate below the threshold at which a candidate is given up.
SLACK = 4.5
#: Loose members of a bucket that one task compares with the bucket's members.
TILE = 256

_REST = np.uint64((1 << (64 - REGISTER_BITS)) - 1)
_STEP = np.uint64(0xD1B54A32D192ED03)
_ORDER = np.array([np.random.default_rng(i).permutation(REGISTERS) for i in range(REGISTERS)])


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each row, in this order."""
    data = lower_ascii(data)
    starts, ends, rows = words(data, offsets, NOT_SPACE)
    hashes = span_hash(prefix_sums(data), starts, ends)
    total = len(rows)
    found, at = [], []
    if total >= SHINGLE:
        whole = rows[: total - SHINGLE + 1] == rows[SHINGLE - 1 :]
        joined = np.zeros(total - SHINGLE + 1, np.uint64)
        for k in range(SHINGLE):
            joined = joined * _STEP + hashes[k : total - SHINGLE + 1 + k]
        found.append(mix(joined[whole]))
        at.append(rows[: total - SHINGLE + 1][whole])
    counts = np.bincount(rows, minlength=len(offsets) - 1)
    ends_at = np.cumsum(counts)
    for row in np.flatnonzero((counts > 0) & (counts < SHINGLE)).tolist():
        joined = np.zeros(1, np.uint64)
        for value in hashes[ends_at[row] - counts[row] : ends_at[row]]:
            joined = joined * _STEP + value
        found.append(mix(joined + np.uint64(counts[row])))
        at.append(np.array([row]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    row, value = np.concatenate(at), np.concatenate(found)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[first], value[first]


def registers(row: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    """uint16 registers of each row: six bits of leading zeros, ten of mantissa."""
    out = np.zeros((rows, REGISTERS), np.uint16)
    held = np.zeros((rows, REGISTERS), bool)
    bucket = (value >> np.uint64(64 - REGISTER_BITS)).astype(np.int64)
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (bucket[1:] != bucket[:-1])
    least = (value[first] & _REST).astype(np.float64)
    mantissa, exponent = np.frexp(least)
    zeros = (64 - REGISTER_BITS - exponent).clip(0, 62).astype(np.uint16)
    bits = ((mantissa * 2 - 1).clip(0, 1) * (1 << MANTISSA_BITS)).clip(0, (1 << MANTISSA_BITS) - 1).astype(np.uint16)
    out[row[first], bucket[first]] = (zeros << np.uint16(MANTISSA_BITS)) | bits
    held[row[first], bucket[first]] = True
    for r in np.flatnonzero(held.any(axis=1) & ~held.all(axis=1)).tolist():
        empty = np.flatnonzero(~held[r])
        lender = _ORDER[empty, held[r][_ORDER[empty]].argmax(axis=1)]
        out[r, empty] = out[r, lender]
    return out


def band_keys(table: np.ndarray) -> np.ndarray:
    packed = np.ascontiguousarray(table).view(np.uint64).reshape(len(table), BANDS, -1)
    keys = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[None, :], len(table), axis=0)
    for part in range(packed.shape[2]):
        keys = mix(keys * _STEP + packed[:, :, part])
    return keys.view(np.int64)


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))


def _digest(value: np.ndarray, counts: np.ndarray, salt: int) -> np.ndarray:
    sums = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(mix(value ^ np.uint64(salt)), dtype=np.uint64, out=sums[1:])
    ends = np.cumsum(counts)
    return (sums[ends] - sums[ends - counts]).view(np.int64)


def _scan(sketches: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in slices(batch.column("text")):
                row, value = shingle_sets(data, offsets)
                counts = np.bincount(row, minlength=end - first).astype(np.int64)
                columns = [
                    batch.column("id").slice(first, end - first),
                    pa.array(counts),
                    pa.array(_digest(value, counts, 0x5851F42D4C957F2D)),
                    pa.array(_digest(value, counts, 0x14057B7EF767814F)),
                ]
                if sketches:
                    table = registers(row, value, end - first)
                    some = counts > 0
                    columns.append(_lists(table.view(np.int16)[some].ravel(), some * REGISTERS, pa.int16()))
                    columns.append(_lists(band_keys(table)[some].ravel(), some * BANDS, pa.int64()))
                    names = ["id", "n", "d1", "d2", "sketch", "bands"]
                else:
                    columns.append(_lists(value.view(np.int64), counts, pa.int64()))
                    names = ["id", "n", "d1", "d2", "shingles"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return scan


def estimated(a: Column, b: Column, n: Column, m: Column) -> Column:
    """Similarity by equal registers, less those that two different sets of these sizes share by chance."""
    equal = F.aggregate(
        F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda total, one: total + one
    )
    ratio = F.greatest(n, m) / F.least(n, m)
    # expected collisions of registers with MANTISSA_BITS bits (from the HyperMinHash paper)
    chance = F.lit(0.169919487159739 * REGISTERS / 2**MANTISSA_BITS) * 4 * ratio / F.pow(1 + ratio, 2)
    return (equal - chance) / F.lit(float(REGISTERS))


def _close(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and estimate leave the threshold open."""
    share = percent / 100
    least = share - SLACK * float(np.sqrt(share * (1 - share) / REGISTERS))
    left = sketches.select(F.col("class").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = sketches.select(F.col("class").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
        .filter(estimated(F.col("sa"), F.col("sb"), F.col("na"), F.col("nb")) >= least)
        .select("a", "b")
    )


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    shared = F.size(F.array_intersect("xa", "xb"))
    return (
        pairs.join(sets.select(F.col("class").alias("a"), F.col("shingles").alias("xa")), "a")
        .join(sets.select(F.col("class").alias("b"), F.col("shingles").alias("xb")), "b")
        .filter(shared * 100 >= (F.size("xa") + F.size("xb") - shared) * percent)
        .select("a", "b")
    )


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row an id: n_shingles, component_id (smallest id reachable over links), kept (it is that id).

    Sets with 100 * intersection >= percent * union are linked. A null or empty text has the empty
    set, which is linked with nothing. Of an id that is repeated, the row with the
    smallest set digest counts; rows without an id are left out.
    """
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sketched = written(
        rows.mapInArrow(_scan(True), "id long, n long, d1 long, d2 long, sketch array<smallint>, bands array<long>"), "sketches"
    )
    slim = sketched.groupBy("id").agg(F.min(F.struct("n", "d1", "d2")).alias("s")).select("id", "s.*")
    classes = slim.filter("n > 0").groupBy("n", "d1", "d2").agg(F.min("id").alias("class"))
    classes = written(classes, "classes")
    ours = sketched.join(classes.withColumnRenamed("class", "id"), ["id", "n", "d1", "d2"], "left_semi")

    keys = ours.select(F.posexplode("bands").alias("band", "bucket"), F.col("id").alias("class"))
    shared = keys.groupBy("bucket").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count("*").alias("held"))
    buckets = written(keys.join(shared.filter("low < high").select("bucket", "held"), "bucket").distinct(), "buckets")

    inside = written(buckets.groupBy("class").agg(F.sum("held").alias("weight")), "candidates")
    sketches = written(
        ours.join(inside.select(F.col("class").alias("id")), "id", "left_semi")
        .select(F.col("id").alias("class"), "n", "d1", "d2", "sketch")
        .dropDuplicates(["class"]),
        "candidate-sketches",
    )
    wanted = rows.join(sketches.select(F.col("class").alias("id")), "id", "left_semi")
    sets = written(
        wanted.mapInArrow(_scan(False), "id long, n long, d1 long, d2 long, shingles array<long>")
        .join(sketches.select(F.col("class").alias("id"), "n", "d1", "d2"), ["id", "n", "d1", "d2"], "left_semi")
        .select(F.col("id").alias("class"), "shingles")
        .dropDuplicates(["class"]),
        "candidate-sets",
    )

    # the member that shares most with others leads a bucket: one link to it joins what a list of all pairs would
    leaders = (
        buckets.join(inside, "class")
        .groupBy("bucket")
        .agg(F.max(F.struct("weight", (-F.col("class")).alias("minus"))).alias("best"))
        .select("bucket", (-F.col("best.minus")).alias("leader"))
    )
    led = written(buckets.join(leaders, "bucket").select("bucket", "band", "class", "leader"), "led")
    first = _ordered(led.filter("class <> leader").select(F.col("class").alias("a"), F.col("leader").alias("b")))
    links = written(_verified(_close(first, sketches, percent), sets, percent), "links")

    # what is still apart within a bucket is compared with the bucket's others: first each with the
    # nearest alone, which joins most of what belongs together, then all pairs that remain open
    found, parts = links.count(), components(links)
    for nearest in (True, False):
        placed = led.join(parts.withColumnRenamed("node", "class"), "class", "left").select(
            "bucket", "band", "class", "leader", F.coalesce("component", "class").alias("part")
        )
        rest = written(_apart(placed, sketches, sets, percent, nearest).join(first, ["a", "b"], "left_anti"), "open-pairs")
        links = written(links.union(_verified(rest, sets, percent)), "links")
        first = first.union(rest)
        if links.count() > found:
            found, parts = links.count(), components(links)

    members = slim.join(classes, ["n", "d1", "d2"], "left").select("id", "n", F.coalesce("class", "id").alias("class"))
    return members.join(parts.withColumnRenamed("node", "class"), "class", "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "class").alias("component_id"),
        (F.col("id") == F.coalesce("component", "class")).alias("kept"),
    )


def _apart(placed: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """Pairs (a, b) of one bucket in different parts that may still reach the threshold.

    A bucket's loose members, those outside its leader's part, are compared with all its members in
    tasks of about ``TILE`` loose members each, and only pairs that no bound rules out come out. A
    pair that shares several buckets comes out of the first of their bands alone, and once if both are loose. With ``nearest`` each loose member only comes out with the nearest
    of each task's pieces.
    """
    torn = placed.groupBy("bucket").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low < high")
    placed = written(placed.join(torn.select("bucket"), "bucket"), "placed")
    main = placed.filter("class = leader").select("bucket", F.col("part").alias("main"))
    placed = written(placed.join(main, "bucket").withColumn("loose", F.col("part") != F.col("main")), "torn")
    loose = placed.filter("loose")

    # shingles that no other member of a torn bucket has cannot be shared
    members = placed.select("class").distinct()
    shingles = sets.join(members, "class", "left_semi").select("class", F.explode("shingles").alias("shingle"))
    common = shingles.groupBy("shingle").agg(F.count("*").alias("held")).filter("held > 1").select("shingle")
    asked = shingles.join(loose.select("class").distinct(), "class", "left_semi")
    shared = asked.join(common, "shingle").groupBy("class").agg(F.count("*").alias("shared"))

    about = sketches.select("class", "n", "sketch")
    tiles = loose.groupBy("bucket").agg((F.floor(F.count("*") / TILE) + 1).cast("int").alias("tiles"))
    tile = F.pmod(F.xxhash64("class"), F.col("tiles")).cast("int")
    queries = (
        loose.join(tiles, "bucket")
        .join(about, "class")
        .join(shared, "class", "left")
        .select("bucket", tile.alias("tile"), F.lit(0).alias("side"), "band", "loose", "class", "part", "n", F.coalesce("shared", F.lit(0)).alias("shared"), "sketch")
    )
    others = (
        placed.join(tiles, "bucket")
        .join(about, "class")
        .select("bucket", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), F.lit(1).alias("side"), "band", "loose", "class", "part", "n", F.col("n").alias("shared"), "sketch")
    )
    dealt = queries.union(others).repartition("bucket", "tile").sortWithinPartitions("bucket", "tile", "side")
    return dealt.mapInArrow(_compare(percent, nearest), "a long, b long").distinct()


def _compare(percent: int, nearest: bool):
    share = percent / 100
    least = (share - SLACK * float(np.sqrt(share * (1 - share) / REGISTERS))) * REGISTERS

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, asked = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            column = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in ("bucket", "tile", "side", "band", "loose", "class", "part", "n", "shared")}
            sketch = batch.column("sketch").flatten().to_numpy().reshape(batch.num_rows, REGISTERS)
            change = (np.diff(column["bucket"]) != 0) | (np.diff(column["tile"]) != 0) | (np.diff(column["side"]) != 0)
            bounds = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            out = []
            for low, high in zip(bounds, bounds[1:]):
                key = (column["bucket"][low], column["tile"][low])
                if key != group:
                    group, asked = key, []
                rows = {name: values[low:high] for name, values in column.items()} | {"sketch": sketch[low:high]}
                if rows["side"][0] == 0:
                    asked.append(rows)
                    continue
                for mine in asked:
                    for at in range(0, high - low, 256):
                        out.append(_possible(mine, {name: values[at : at + 256] for name, values in rows.items()}, percent, least, nearest))
            pairs = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return compare


def _possible(x: dict[str, np.ndarray], y: dict[str, np.ndarray], percent: int, least: float, nearest: bool) -> np.ndarray:
    """Pairs of different parts that sizes, shareable shingles and the estimate leave open."""
    n, m = x["n"][:, None], y["n"][None, :]
    most = np.minimum(np.minimum(x["shared"][:, None], y["shared"][None, :]), np.minimum(n, m))
    once = ~y["loose"][None, :] | (x["class"][:, None] < y["class"][None, :])
    may = once & (x["part"][:, None] != y["part"][None, :]) & (100 * most >= percent * (n + m - most))
    i, j = np.nonzero(may)
    equal = x["sketch"][i] == y["sketch"][j]
    score = equal.sum(axis=1)
    if nearest:
        order = np.lexsort((-score, i))
        first = np.ones(len(order), bool)
        first[1:] = i[order[1:]] != i[order[:-1]]
        pick = order[first & (score[order] >= least)]
        a, b = x["class"][i[pick]], y["class"][j[pick]]
        return np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)
    shared_bands = equal.reshape(len(i), BANDS, REGISTERS // BANDS).all(axis=2)
    near = (score >= least) & (shared_bands.argmax(axis=1) == x["band"][i])
    a, b = x["class"][i[near]], y["class"][j[near]]
    return np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def drop_near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near duplicates, that of the smallest id.

    Documents without words and rows without an id are in no group and stay; of a repeated id one row stays.
    """
    found = near_duplicates(docs, percent, id_col, text_col)
    gone = written(found.filter("NOT kept").select(id_col), "dropped")
    rest = docs.join(gone, id_col, "left_anti").select(docs.columns)
    apart = F.when(F.col(id_col).isNull(), F.xxhash64(text_col))
    nth = F.row_number().over(Window.partitionBy(id_col, apart).orderBy(F.xxhash64(text_col)))
    return rest.withColumn("_nth", nth).filter(F.col("_nth") == 1).drop("_nth")
