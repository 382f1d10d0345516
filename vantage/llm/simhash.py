"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments; two fingerprints within ``max_bits``
agree in some segment up to a small number of bits, so every fingerprint
enumerates the small Hamming ball of each of its segments, fetches the
fingerprints stored under those keys and verifies the complete distance.
Fingerprints are compared once each, however many documents carry them.  A
key with more than ``BUCKET`` fingerprints is not joined: fingerprints that
ask for such a key enumerate their whole ball of full-width fingerprints and
fetch those exactly, so a crowded key costs its members a fixed number of
probes and loses no link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantage.llm.common import ball, bound_batches, col, components, fresh, materialise, never_sent

SHINGLE, SEED, MAX_BITS, SEGMENTS, BUCKET = 3, 42, 2, 2, 64
_SLICE = 1 << 16


def simhash_text(text: str, k: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of the word shingles of ``text``, as a signed integer."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    flat, n = b" ".join(words), max(1, len(words) - k + 1)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    begins, stops = (ends - sizes)[:n].tolist(), (ends[min(k, len(words)) - 1:][:n] - 1).tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, _SLICE):
        h = np.array([digest(flat[b:e], seed) for b, e in zip(begins[at:at + _SLICE], stops[at:at + _SLICE])], np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprint(text: Column, k: int = SHINGLE, seed: int = SEED) -> Column:
    """SimHash of a text column as bigint (null: as empty, 0)."""

    @F.pandas_udf("bigint")
    def hashed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([simhash_text(t, k, seed) for t in part], dtype="int64")

    return hashed(F.coalesce(text, F.lit("")))


def near_links(fps: DataFrame, max_bits: int = MAX_BITS, segments: int = SEGMENTS, bucket: int = BUCKET) -> DataFrame:
    """Links ``(a, b)``, a < b, of the distinct fingerprints ``fps(fp)`` at ``max_bits`` differing bits or fewer (links may repeat).

    With ``max_bits = segments * r + rest`` one of the first ``rest + 1``
    segments differs in r bits at most, or one of the others in r - 1 at
    most; those are the balls enumerated.
    """
    if 64 % segments:
        raise ValueError("segments must divide 64")
    width, (r, rest) = 64 // segments, divmod(max_bits, segments)
    radius = [r if s <= rest else r - 1 for s in range(segments)]
    used = [s for s in range(segments) if radius[s] >= 0]
    part = lambda s: F.shiftrightunsigned("fp", width * (segments - 1 - s)).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))
    stored = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(s).alias("seg"), part(s).alias("key")) for s in used])).alias("x")).select("fp", "x.*")
    stored = materialise(stored, "simhash-index")
    probes = stored
    if any(radius[s] > 0 for s in used):
        masks = F.when(F.lit(False), F.array(F.lit(0).cast("bigint")))
        for s in used:
            masks = masks.when(F.col("seg") == s, F.array(*[F.lit(m).cast("bigint") for m in ball(width, radius[s])]))
        probes = stored.select("fp", "seg", "key", F.explode(masks).alias("m")).select("fp", "seg", F.col("key").bitwiseXOR(F.col("m")).alias("key"))
    sizes = stored.groupBy("seg", "key").count()
    crowded = materialise(sizes.where(F.col("count") > bucket).select("seg", "key"), "simhash-crowded")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= max_bits
    if crowded.isEmpty():
        open_ = stored
        links = None
    else:
        open_ = stored.join(never_sent(crowded), ["seg", "key"], "left_anti")
        asking = probes.join(never_sent(crowded), ["seg", "key"], "left_semi").select("fp").distinct()
        every = asking.select("fp", F.explode(F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in ball(64, max_bits) if m])).alias("m"))
        every = every.select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("fp2"))
        links = every.join(never_sent(fps.select(F.col("fp").alias("fp2"))), "fp2").select("fp", "fp2")
    found = probes.join(never_sent(open_.withColumnRenamed("fp", "fp2")), ["seg", "key"]).where((F.col("fp") != F.col("fp2")) & near).select("fp", "fp2")
    both = found if links is None else found.union(links)
    return both.select(F.least("fp", "fp2").alias("a"), F.greatest("fp", "fp2").alias("b"))


def grouped(ids: DataFrame, max_bits: int = MAX_BITS, segments: int = SEGMENTS, bucket: int = BUCKET) -> DataFrame:
    """``ids(id, fp)`` -> ``(fp, component)``: the smallest id of the fingerprints that links reach from ``fp``."""
    classes = materialise(ids.groupBy("fp").agg(F.min("id").alias("id")), "simhash-classes")
    comp = components(near_links(classes.select("fp"), max_bits, segments, bucket)).toDF("fp", "comp")
    named = classes.join(never_sent(comp), "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    least = named.groupBy("comp").agg(F.min("id").alias("component"))
    return materialise(named.join(never_sent(least), "comp").select("fp", "component"), "simhash-groups")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, max_bits: int = MAX_BITS,
                       segments: int = SEGMENTS) -> DataFrame:
    """One row per input row: ``id_col, fingerprint, component_id``.

    A null text is empty, and an empty text has fingerprint zero, which links
    like any other.  Rows with a null id get the component of their
    fingerprint (null if no row of it has an id).  Repeated rows stay
    repeated; an empty table gives no rows; other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    ids = materialise(docs.select(col(id_col).alias("id"), fingerprint(col(text_col), k).alias("fp")), "simhash")
    got = ids.join(never_sent(grouped(ids, max_bits, segments)), "fp", "left")
    return got.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, max_bits: int = MAX_BITS,
                         segments: int = SEGMENTS) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that of the smallest id (null last), ties by all columns."""
    bound_batches(docs.sparkSession)
    cols = docs.columns
    fp, row, kid, krow = fresh(docs, "fp", "row", "keep_id", "keep_row")
    tagged = docs.select(*map(col, cols), fingerprint(col(text_col), k).alias(fp), F.xxhash64(*map(col, cols)).alias(row))
    keys = materialise(tagged.select(col(id_col).alias("id"), F.col(fp).alias("fp"), F.col(row).alias("row")), "simhash-keys")
    group = grouped(keys.select("id", "fp"), max_bits, segments)
    rank = F.struct(F.col("id").isNull().alias("late"), F.col("id"), F.col("row"))
    by = keys.join(never_sent(group), "fp").groupBy(F.coalesce("component", "fp").alias("g"), F.col("component").isNull().alias("none"))
    keep = by.agg(F.min(rank).alias("r")).select(F.col("r.id").alias("id"), F.col("r.row").alias("row")).distinct()
    keep = materialise(keep, "simhash-kept")
    same = col(id_col).eqNullSafe(F.col(kid)) & (F.col(row) == F.col(krow))
    got = tagged.join(never_sent(keep.toDF(kid, krow)), same, "left_semi")
    if not keys.groupBy("id", "row").count().where("count > 1").isEmpty():  # rows repeated in every column
        got = got.dropDuplicates([id_col, row])
    return got.select(*map(col, cols))
