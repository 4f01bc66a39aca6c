"""Locality-sensitive hash families as joins and ranked windows, and sums inside rows.

Vectors are rows (id, f, v). A layout is a table of (perm, f, bin, pos); signatures are rows (id, bin, h). Permutations come
from an integer formula, so every engine makes the same ones."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SEED, SLOTS, PROBES, TOP = 33111, 8, 100, 30
CELLS = 1 << 20  # numbers that a task works on at once


def order(f: Column, perm: Column, seed: int = SEED) -> Column:
    """The sort key of feature f in permutation perm."""
    return (f * F.lit(2654435761) + perm * F.lit(40503) + F.lit(seed)) % F.lit(2147483647)


def permutations(dim: int, hashes: int) -> int:
    return math.ceil(hashes * SLOTS / dim)


def layout(spark: SparkSession, dim: int, hashes: int, seed: int = SEED) -> DataFrame:
    """(perm, f, bin, pos): place q of the concatenated permutations of 0..dim-1 is slot q % 8 of bin q / 8; bins from `hashes` on are unused.

    One window a permutation, of dim rows: the size of the model's input, not of the data."""
    perms = permutations(dim, hashes)
    grid = spark.range(perms * dim).select(F.floor(F.col("id") / dim).alias("perm"), (F.col("id") % dim).alias("f"))
    lin = F.row_number().over(Window.partitionBy("perm").orderBy(order(F.col("f"), F.col("perm"), seed), "f")) - 1
    q = (F.col("perm") * dim + lin).cast("long")
    return grid.select("perm", "f", F.floor(q / SLOTS).alias("bin"), (q % SLOTS).alias("pos")).filter(F.col("bin") < hashes)


def winners(vectors: DataFrame, bins: DataFrame) -> DataFrame:
    """Of each id and bin, the place of the largest value: of equal ones the first by permutation, then by feature. (id, bin, pos, f)

    max_by over a struct keeps a row per group and combines on the map side, where a window would sort all values."""
    met = vectors.join(bins, "f")
    key = F.struct(F.col("v"), (-F.col("perm")).alias("p"), (-F.col("f")).alias("q"))
    return met.groupBy("id", "bin").agg(F.max_by(F.struct("pos", "f"), key).alias("x")).select("id", "bin", "x.pos", "x.f")


def dwta(vectors: DataFrame, bins: DataFrame) -> DataFrame:
    """Densified winner-take-all before densification: slot of the winner in each bin that has a feature."""
    return winners(vectors, bins).select("id", "bin", F.col("pos").alias("h"))


def wta(vectors: DataFrame, bins: DataFrame) -> DataFrame:
    """Winner-take-all: the winning feature itself."""
    return winners(vectors, bins).select("id", "bin", F.col("f").alias("h"))


def probes(spark: SparkSession, hashes: int, attempts: int = PROBES, factor: int = 1) -> DataFrame:
    """(bin, attempt, target): where an empty bin looks for a filled one. 32-bit arithmetic, targets clamped to the last bin."""
    bits = max(1, math.ceil(math.log2(hashes)))
    word = F.lit(1 << 32)
    grid = spark.range(hashes * attempts).select(F.floor(F.col("id") / attempts).alias("bin"), (F.col("id") % attempts + 1).alias("attempt"))
    mixed = ((F.col("attempt") * ((F.col("bin") + 1) * 64 + F.lit(factor))) % word * 8) % word
    return grid.select("bin", "attempt", F.least(F.floor(mixed / F.lit(1 << (32 - bits))), F.lit(hashes - 1)).cast("long").alias("target"))


def first_attempts(hashes: int, attempts: int = PROBES, factor: int = 1) -> np.ndarray:
    """[target, bin]: the attempt at which a bin looks into a target first, by the numbers of probes(); 0 at itself, attempts + 1 where it never does."""
    bits = max(1, math.ceil(math.log2(hashes)))
    out = np.full((hashes, hashes), attempts + 1, np.int64)
    of = np.arange(hashes, dtype=np.int64)
    for attempt in range(attempts, 0, -1):
        mixed = attempt * ((of + 1) * 64 + factor) % (1 << 32) * 8 % (1 << 32)
        out[np.minimum(mixed >> (32 - bits), hashes - 1), of] = attempt
    out[of, of] = 0
    return out


def densified(signature: DataFrame, hashes: int, ids: DataFrame | None = None) -> DataFrame:
    """(id, bin, h) for all bins: an empty one takes the hash of the first filled bin of its probe sequence, 0 if there is none.

    An id's filled bins are gathered once (`hashes` at most, a setting); each bin takes the one it meets first, itself before all: a minimum
    over the filled bins' columns of first_attempts(), for all ids of an Arrow batch together."""
    first, never = first_attempts(hashes), PROBES + 1

    @F.arrow_udf("array<long>")
    def filled(own: pa.Array) -> pa.Array:
        n, step, parts = len(own), max(1, CELLS // hashes), []
        sizes = np.diff(own.offsets.to_numpy()) if not own.null_count else own.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = own.flatten()
        bins, values = flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        out, some, at = np.zeros((n, hashes), np.int64), np.flatnonzero(sizes), 0
        while at < len(some):  # as many ids as `step` filled bins hold, one at least
            start = ends[some[at]] - sizes[some[at]]
            to = max(at + 1, int(np.searchsorted(ends[some], start + step, "right")))
            mine, stop = some[at:to], ends[some[to - 1]]
            met = first[bins[start:stop]] * (stop - start) + np.arange(stop - start)[:, None]
            low = np.minimum.reduceat(met, ends[mine] - sizes[mine] - start, axis=0)
            out[mine] = np.where(low < never * (stop - start), values[start:stop][low % (stop - start)], 0)
            at = to
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * hashes, pa.int32()), pa.array(out.ravel()))

    own = signature.groupBy("id").agg(F.collect_list(F.struct(F.col("bin").cast("long").alias("bin"), F.col("h").cast("long").alias("h"))).alias("own"))
    own = own if ids is None else ids.select("id").join(own, "id", "left")
    return own.select("id", F.posexplode(filled("own")).alias("bin", "h")).select("id", F.col("bin").cast("long").alias("bin"), "h")


def minhash_bins(f: Column, hashes: int, range_pow: int) -> Column:
    """The bin of a feature: its Murmur3 (of 8 bytes, seed 42) in 2**range_pow, cut into `hashes` equal runs."""
    size = 1 << range_pow
    return F.floor(F.hash(f.cast("long")).cast("long").bitwiseAND(F.lit(size - 1)) / math.ceil(size / hashes))


def minhash(vectors: DataFrame, hashes: int, range_pow: int, top: int | None = TOP) -> DataFrame:
    """(id, bin, h): the largest feature of each bin, among the `top` largest values of each id (all if None)."""
    if top is not None:
        rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("v"), "f"))
        vectors = vectors.withColumn("__rank", rank).filter(F.col("__rank") <= top)
    return vectors.select("id", minhash_bins(F.col("f"), hashes, range_pow).alias("bin"), "f").groupBy("id", "bin").agg(F.max("f").alias("h"))


def srp_layout(spark: SparkSession, dim: int, hashes: int, ratio: int = 3) -> DataFrame:
    """(bin, f, sign): for each hash the ceil(dim / ratio) first features of a permutation, with signs from the same formula."""
    keep = math.ceil(dim / ratio)
    grid = spark.range(hashes * dim).select(F.floor(F.col("id") / dim).alias("bin"), (F.col("id") % dim).alias("f"))
    rank = F.row_number().over(Window.partitionBy("bin").orderBy(order(F.col("f"), F.col("bin")), "f"))
    return grid.withColumn("rank", rank).filter(F.col("rank") <= keep).select("bin", "f", F.when((order(F.col("f"), F.col("bin")) / 7).cast("long") % 2 == 0, 1).otherwise(-1).cast("long").alias("sign"))


def srp(vectors: DataFrame, signs: DataFrame, ids: DataFrame, hashes: int) -> DataFrame:
    """(id, bin, h): 0 where the signed sum is at least 0, which no common feature gives too; else 1.

    A feature's signs in all hashes are one row, and an id's sums are columns of one row, made where its features meet: what is shuffled is
    the vectors, never their products, nor a row for each id and hash."""
    whole = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(hashes - 1).cast("long")), lambda b: F.coalesce(F.try_element_at(F.col("m"), b), F.lit(0)).cast("double"))
    wide = signs.groupBy("f").agg(F.map_from_entries(F.collect_list(F.struct("bin", "sign"))).alias("m")).select("f", whole.alias("signs"))
    met = vectors.select("id", "f", "v").repartition("id").join(wide, "f")
    sums = met.groupBy("id").agg(*[F.sum(F.col("signs")[b] * F.col("v")).alias(f"s{b}") for b in range(hashes)])
    bits = F.array(*[F.when(F.round(F.coalesce(F.col(f"s{b}"), F.lit(0.0)), 12) >= 0, 0).otherwise(1).cast("long") for b in range(hashes)])
    return ids.select("id").join(sums, "id", "left").select("id", F.posexplode(bits).alias("bin", "h")).select("id", F.col("bin").cast("long").alias("bin"), "h")


def srp_merged(vectors: DataFrame, signs: DataFrame, ids: DataFrame, hashes: int) -> DataFrame:
    """What srp() gives, by a merge of sorted lists inside each row, with neither rows nor a shuffle for products.

    An id's features are one sorted list; the layout is another, of features with their signs in all hashes (0 where a hash leaves one
    out). A feature finds its place in the layout by bisection, so a row's work follows its own features, not the layout's. Signs times
    values are added up for all ids of an Arrow batch together. The layout goes out as one broadcast of at most features x hashes bytes, a setting."""
    rows = signs.select("f", "bin", "sign").collect()
    features, place = np.unique(np.array([r.f for r in rows], np.int64), return_inverse=True)
    table = np.zeros((len(features) + 1, hashes), np.int8)  # the last row is for features that no hash has
    table[place, [r.bin for r in rows]] = [r.sign for r in rows]
    shared = vectors.sparkSession.sparkContext.broadcast((features, table))

    @F.arrow_udf("array<long>")
    def bits(own: pa.Array) -> pa.Array:
        features, table = shared.value
        n, step = len(own), max(1, CELLS // hashes)
        sizes = own.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = own.flatten()
        f, v = flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)
        at = np.searchsorted(features, f)
        at[at < len(features)] = np.where(features[at[at < len(features)]] == f[at < len(features)], at[at < len(features)], len(features))
        of, sums = np.repeat(np.arange(n), sizes), np.zeros((n, hashes))
        for s in range(0, len(f), step):
            terms, mine = table[at[s : s + step]] * v[s : s + step, None], of[s : s + step]
            begins = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
            sums[mine[begins]] += np.add.reduceat(terms, begins, axis=0)
        low = (np.round(sums, 12) < 0).astype(np.int64)
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * hashes, pa.int32()), pa.array(low.ravel()))

    own = vectors.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("f", F.col("v").cast("double").alias("v")))).alias("own"))
    full = ids.select("id").join(own, "id", "left")
    return full.select("id", F.posexplode(bits("own")).alias("bin", "h")).select("id", F.col("bin").cast("long").alias("bin"), "h")


def collision(a: DataFrame, b: DataFrame, k: int, l: int) -> DataFrame:  # noqa: E741
    """(id, rate): the share of k-blocks of two signatures that are equal, over the first k * l entries."""
    both = a.join(b.select("id", "bin", F.col("h").alias("h2")), ["id", "bin"]).filter(F.col("bin") < k * l)
    block = both.groupBy("id", F.floor(F.col("bin") / k).alias("tbl")).agg(F.min((F.col("h") == F.col("h2")).cast("int")).alias("same"))
    return block.groupBy("id").agg(F.avg("same").alias("rate"))


def address_wta(signature: DataFrame, k: int, l: int, bits: int = 2) -> DataFrame:  # noqa: E741
    """(id, tbl, bucket): the digits of a table's k hashes, `bits` apart; the default of 2 lets some codes share a bucket."""
    digit = F.col("h") * F.pow(F.lit(2.0 ** bits), F.lit(k - 1) - F.col("bin") % k).cast("long")
    return signature.filter(F.col("bin") < k * l).groupBy("id", F.floor(F.col("bin") / k).alias("tbl")).agg(F.sum(digit).alias("bucket"))


def address_srp(signature: DataFrame, k: int, l: int) -> DataFrame:  # noqa: E741
    return address_wta(signature, k, l, bits=1)


def multiplier(slot: Column) -> Column:
    """The odd 31-bit multiplier of a signature slot."""
    return ((slot * F.lit(2654435761) + F.lit(SEED)) % F.lit(1073741823)) * 2 + 1


def address_minhash(signature: DataFrame, k: int, l: int, range_pow: int) -> DataFrame:  # noqa: E741
    """(id, tbl, bucket): 32-bit products of hashes and odd multipliers, added and cut to range_pow bits."""
    word = F.lit(1 << 32)
    term = (multiplier(F.col("bin")) * (F.col("h") + 1)) % word
    return signature.filter(F.col("bin") < k * l).groupBy("id", F.floor(F.col("bin") / k).alias("tbl")).agg((F.sum(term) % word % F.lit(1 << range_pow)).alias("bucket"))


def murmur3(data: bytes, seed: int) -> int:
    """MurmurHash3 x86 of 32 bits, unsigned."""
    mask = 0xFFFFFFFF

    def turn(x: int, by: int) -> int:
        return ((x << by) | (x >> (32 - by))) & mask

    def scramble(k: int) -> int:
        return turn(k * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask

    h, whole = seed & mask, len(data) & ~3
    for i in range(0, whole, 4):
        h = (turn(h ^ scramble(int.from_bytes(data[i : i + 4], "little")), 13) * 5 + 0xE6546B64) & mask
    if whole < len(data):
        h ^= scramble(int.from_bytes(data[whole:], "little"))
    h ^= len(data)
    for by, times in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> by)) * times & mask
    return h ^ (h >> 16)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that it uses more than once."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def murmur3_column(value: Column, seed: int) -> Column:
    """Murmur3 of a binary column with any seed, as a bigint: column arithmetic over groups of four bytes, products taken in halves so
    that none leaves 64 bits. Null stays null."""
    mask = F.lit(0xFFFFFFFF)

    def times(a: Column, b: int) -> Column:
        low, high = a.bitwiseAND(F.lit(0xFFFF)) * F.lit(b), F.shiftright(a, 16) * F.lit(b)
        return (low + F.shiftleft(high.bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(mask)

    def turned(a: Column, by: int) -> Column:
        return F.shiftleft(a, by).bitwiseOR(F.shiftright(a, 32 - by)).bitwiseAND(mask)

    def scrambled(w: Column) -> Column:
        return _let(times(w, 0xCC9E2D51), lambda k: times(turned(k, 15), 0x1B873593))

    def step(h: Column, w: Column) -> Column:
        return _let(h.bitwiseXOR(scrambled(w)), lambda x: (turned(x, 13) * F.lit(5) + F.lit(0xE6546B64)).bitwiseAND(mask))

    n = F.octet_length(value).cast("int")
    whole, groups = F.floor(n / 4).cast("int"), F.ceil(n / 4).cast("int")
    padded = F.rpad(F.hex(value), F.greatest(groups * 8, F.lit(1)), F.lit("0"))

    def word(i: Column) -> Column:
        return F.conv(F.concat(*[padded.substr(i * 8 + F.lit(1 + 2 * b), F.lit(2)) for b in (3, 2, 1, 0)]), 16, 10).cast("long")

    words = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(groups, F.lit(1)) - 1), word)).otherwise(F.array().cast("array<bigint>"))
    body = F.aggregate(F.slice(words, F.lit(1), whole), F.lit(seed & 0xFFFFFFFF).cast("long"), step)
    tailed = _let(body, lambda h: F.when(groups > whole, h.bitwiseXOR(scrambled(F.get(words, whole)))).otherwise(h).bitwiseXOR(n.cast("long")))
    for by, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        tailed = _let(_let(tailed, lambda h, by=by: h.bitwiseXOR(F.shiftright(h, by))), lambda h, factor=factor: times(h, factor))
    return F.when(value.isNotNull(), _let(tailed, lambda h: h.bitwiseXOR(F.shiftright(h, 16))))


def addresses(family: str, rows: DataFrame, ids: DataFrame, dim: int, k: int, l: int, range_pow: int, bits: int = 2) -> DataFrame:  # noqa: E741
    """(id, tbl, bucket) of vectors (id, f, v) of a layer with `dim` inputs, by the family's name; ids lists all of them, those without a feature too."""
    spark, hashes = rows.sparkSession, k * l
    if family == "srp":
        return address_srp(srp(rows, srp_layout(spark, dim, hashes), ids, hashes), k, l)
    if family == "minhash":
        return address_minhash(densified(minhash(rows, hashes, range_pow), hashes, ids), k, l, range_pow)
    # of WTA the digit is the winner within its bin: a feature's number would not fit one
    found = dwta(rows, layout(spark, dim, hashes)) if family == "dwta" else wta(rows, layout(spark, dim, hashes)).withColumn("h", F.col("h") % SLOTS)
    return address_wta(densified(found, hashes, ids), k, l, bits)
