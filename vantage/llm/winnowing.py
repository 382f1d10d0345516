"""Document fingerprints by winnowing, in DataFrame functions only.

A lower-case text is cut into units: a word of up to 16 letters, marks and
digits is one, everything else but white space is one unit a code point, and
so are words of scripts that put no blanks between them and longer runs
(minified code, encoded data).  Units are hashed, ``k`` neighbouring unit
hashes are combined by a rolling cyclic-polynomial hash (built by doubling),
and in every window of ``w`` k-grams the least hash is kept, the rightmost on
ties.  Hash and position travel in one long (hash above, 2^31 - 1 - position
below), so a plain minimum picks the rightmost of equal hashes, and windows
that keep the same k-gram fall together as equal values.  Guarantee: any
passage of ``w + k - 1`` units that two texts share gives a common hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantage.llm.common import col, materialise

K, W = 5, 4
#: Rows of a run of neighbouring ids that are sorted together to find each document's next one.
RUN_ROWS = 1024
_POS = (1 << 31) - 1


def _shift(a: Column, by: int) -> Column:
    """``a`` without its first ``by`` elements."""
    return F.slice(a, by + 1, F.greatest(F.size(a) - by, F.lit(0)))


def _first(a: Column, n: Column) -> Column:
    return F.slice(a, 1, F.greatest(n, F.lit(0)))


def _roll(by: int):
    """Joins two rolling hashes: the left one rotated by the length of the right one."""
    return lambda x, y: F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by)).bitwiseXOR(y)


def _steps(n: int) -> list[tuple[int, int]]:
    """Combining spans (a, b) that lead from 1 to n: each joins the span a at i with the span b at i + a (b <= a, spans may overlap only for minima)."""
    out, have = [], 1
    while have < n:
        add = min(have, n - have)
        out.append((have, add))
        have += add
    return out


#: Scripts written without blanks between words.
_UNSPACED = ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar", "Tibetan")
_LETTER = "[\\p{L}\\p{M}\\p{N}&&[^" + "".join(f"\\p{{Is{s}}}" for s in _UNSPACED) + "]]"
#: A whole run of up to 16 letters, marks and digits, else one code point that is no white space.
UNIT = f"(?<!{_LETTER}){_LETTER}{{1,16}}+(?!{_LETTER})|[^\\s\\p{{Z}}]"


def unit_hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(UNIT), F.lit(0)), lambda x: F.xxhash64(x))


def with_winnowed(df: DataFrame, text: Column, out: str, k: int = K, w: int = W) -> DataFrame:
    """``df`` with ``out`` array<bigint>: the kept k-grams of ``text`` as packed (hash, position), by position of their window.

    A text of fewer than ``k`` units has one gram of all its units (none:
    an empty list); one of fewer than ``w`` grams has one window of all.
    """
    t = lambda s: f"__{out}_{s}"
    drop = [t("h"), t("g"), t("m")]
    df = df.withColumn(t("h"), unit_hashes(text))
    h = F.col(t("h"))
    # rolling hash: the span of length n at i is rotl(span a at i, b) ^ (span b at i + a)
    spans, g = {1: h}, h
    for a, b in _steps(k):
        left, right = spans[a], spans.get(b)
        if right is None:
            raise ValueError("k: a power of two, or one plus a power of two")
        name = t(f"s{a + b}")
        drop.append(name)
        right = _shift(right, a)
        df = df.withColumn(name, F.zip_with(_first(left, F.size(right)), right, _roll(b)))
        spans[a + b] = g = F.col(name)
    short = F.when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))
    pack = F.transform(F.when(F.size(h) >= k, g).otherwise(short),
                       lambda x, i: F.shiftleft(F.shiftrightunsigned(F.xxhash64(x), 32), 31).bitwiseOR(F.lit(_POS).cast("bigint") - i.cast("bigint")))
    df = df.withColumn(t("g"), pack)
    m = F.col(t("g"))
    for a, b in _steps(w):
        name = t(f"m{a + b}")
        drop.append(name)
        df = df.withColumn(name, F.zip_with(_first(m, F.size(m) - b), _shift(m, b), lambda x, y: F.least(x, y)))
        m = F.col(name)
    g = F.col(t("g"))
    few = F.when(F.size(g) > 0, F.array(F.array_min(g))).otherwise(g)
    return df.withColumn(out, F.when(F.size(g) >= w, F.array_distinct(m)).otherwise(few)).drop(*drop)


def hashes(packed: Column) -> Column:
    """The distinct hashes of a packed fingerprint, as ints."""
    return F.array_distinct(F.transform(packed, lambda x: F.shiftright(F.shiftleft(x, 1), 32).cast("int")))


def positions(packed: Column) -> Column:
    """The k-gram positions (0 for the first unit) of a packed fingerprint."""
    return F.transform(packed, lambda x: (F.lit(_POS).cast("bigint") - x.bitwiseAND(F.lit(_POS).cast("bigint"))).cast("int"))


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes over the mean number of distinct hashes of the two (a half for two texts of which half is the same); 1 for two empty fingerprints."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(F.lit(2.0) * F.size(F.array_intersect(a, b)) / both)


def digest(packed: Column) -> Column:
    """Hash of the kept hashes and positions, 16 hex digits."""
    return F.lower(F.lpad(F.hex(F.xxhash64(packed)), 16, "0"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, w: int = W) -> DataFrame:
    """One row per input row: ``id_col, fingerprint, kept`` (array of ``(hash, position)``); null text as empty; nulls and repeats of ids stay."""
    src = docs.select(col(id_col).alias("id"), F.coalesce(col(text_col), F.lit("")).alias("t"))
    got = with_winnowed(src, F.col("t"), "p", k, w)
    kept = F.transform("p", lambda x: F.struct(F.shiftright(F.shiftleft(x, 1), 32).cast("int").alias("hash"),
                                               (F.lit(_POS).cast("bigint") - x.bitwiseAND(F.lit(_POS).cast("bigint"))).cast("int").alias("position")))
    return got.select(F.col("id").alias(id_col), digest(F.col("p")).alias("fingerprint"), kept.alias("kept"))


def with_previous(runs: DataFrame, span: int) -> DataFrame:
    """``runs(run)`` distinct -> ``(run, to)``: the run before each one, for the first one the last; sorted in pieces ``span`` wide."""
    runs = runs.withColumn("piece", F.col("run") - F.col("run") % span)
    whole = Window.partitionBy(F.lit(1))  # one row per piece
    ends = runs.groupBy("piece").agg(F.max("run").alias("end"))
    ends = ends.select("piece", F.coalesce(F.lag("end").over(whole.orderBy("piece")), F.max("end").over(whole)).alias("before"))
    inner = F.lag("run").over(Window.partitionBy("piece").orderBy("run"))
    return runs.withColumn("inner", inner).join(ends, "piece").select("run", F.coalesce("inner", "before").alias("to"))


def with_runs(src: DataFrame, run_rows: int = RUN_ROWS) -> tuple[DataFrame, int]:
    """``src`` (with ``id``) and a ``run`` for each row, numbered against the order of the ids, null last; the width runs began with.

    Ids are cut into runs of equal width, about ``run_rows`` rows each when
    ids are dense; a run of more than four times as many rows is cut again
    until none is left or it holds a single id.
    """
    spread = materialise(src.agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n")), "runs")
    lo, hi, n = spread.first()
    lo, hi = (0, 0) if lo is None else (lo, hi)
    drop = 0 if hi - lo < 1 << 61 else 3  # low bits that runs ignore, so that differences of any ids fit a long
    top, size = hi >> drop, (hi >> drop) - (lo >> drop) + 2  # the last place is for null ids
    width = min(size, max(1, -(-size * run_rows // max(n, 1))))
    at = F.coalesce(F.lit(top).cast("bigint") - F.shiftright(F.col("id").cast("bigint"), drop), F.lit(size - 1).cast("bigint"))
    keyed = src.withColumn("at", at).withColumn("run", F.col("at") - F.col("at") % width).withColumn("width", F.lit(width).cast("bigint"))
    while True:
        crowded = keyed.groupBy("run", "width").count().where((F.col("count") > 4 * run_rows) & (F.col("width") > 1))
        step = F.greatest(F.lit(1), F.floor(F.col("width").cast("double") * run_rows / F.col("count"))).cast("bigint")
        crowded = materialise(crowded.select("run", step.alias("step")), "crowded-runs")
        if crowded.isEmpty():
            return keyed.drop("at", "width"), width
        step, past = F.coalesce("step", "width"), F.col("at") - F.col("run")
        keyed = keyed.join(crowded, "run", "left").withColumns({"run": F.col("run") + past - past % step, "width": step}).drop("step")


def in_order(src: DataFrame, run_rows: int = RUN_ROWS) -> DataFrame:
    """``src(id, t)`` as ``run, pos, guest, id, t, nxt``: each run's rows in the order id descending (null last), then text.

    Every run of ids is sorted alone.  The first row of each run also goes to
    the end of the run before it (``guest``), so one shuffle moves each text
    once; ``nxt`` is the text of the next row, after the last the first.
    """
    keyed, width = with_runs(src.select("id", "t"), run_rows)
    heads = materialise(keyed.groupBy("run").agg(F.max("id").alias("head")), "run-heads")
    to = materialise(heads.join(with_previous(heads.select("run"), min(width * run_rows, 1 << 62)), "run").select("head", "to"), "run-guests")
    first = keyed.select("id", "t").join(to, F.col("id").eqNullSafe(F.col("head"))).groupBy("id", "to").agg(F.min("t").alias("t"))
    guests = first.select(F.lit(None).cast("bigint").alias("id"), "t", F.col("to").alias("run"), F.lit(1).alias("guest"))
    both = keyed.select("id", "t", "run", F.lit(0).alias("guest")).union(guests)
    inside = Window.partitionBy("run").orderBy("guest", F.col("id").desc_nulls_last(), "t")
    return both.select("run", "guest", "id", "t", F.row_number().over(inside).alias("pos"), F.lead("t").over(inside).alias("nxt"))


def with_next_text(src: DataFrame, run_rows: int = RUN_ROWS) -> DataFrame:
    """``src(id, t)`` with ``nxt``: the text of the next row in the order id descending (null last), then text; after the last the first."""
    return in_order(src, run_rows).where("guest = 0").select("id", "t", "nxt")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, w: int = W, run_rows: int = RUN_ROWS) -> DataFrame:
    """Fingerprints of each text and of its edited text (its last half replaced by the start of the next document).

    One row per input row: ``id_col, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, n_kept``.  A null text is
    empty; rows with a null id come last, rows with equal ids by text; a
    single row is its own next; other columns are ignored.  Each text is
    fingerprinted once: the row before it in its run gets the kept grams, not
    the text, a second time.
    """
    src = docs.select(col(id_col).cast("bigint").alias("id"), F.coalesce(col(text_col), F.lit("")).alias("t"))
    both = in_order(src, run_rows).withColumn("n", F.length("t").cast("bigint"))
    half = F.floor(F.col("n") / 2).cast("int")
    edited = F.concat(F.substring("t", F.lit(1), F.col("n").cast("int") - half), F.substring("nxt", F.lit(1), half))
    both = both.withColumn("e", F.when(F.col("guest") == 0, edited).otherwise(""))
    for name in ("t", "e"):
        both = with_winnowed(both, F.col(name), f"p{name}", k, w)
    slim = both.select("run", "pos", "guest", "id", "n", F.sha2(F.col("e").cast("binary"), 256).alias("sha"), "pt", "pe")
    slim = slim.withColumn("pnxt", F.lead("pt").over(Window.partitionBy("run").orderBy("pos"))).where("guest = 0")
    own = hashes(F.col("pt"))
    return slim.select(F.col("id").alias(id_col), F.col("n").alias("n_chars"), F.col("sha").alias("edited_sha256"),
                       digest(F.col("pt")).alias("fingerprint"), digest(F.col("pe")).alias("edited_fingerprint"),
                       likeness(own, hashes(F.col("pe"))).alias("near_edited"), likeness(own, hashes(F.col("pnxt"))).alias("near_next"), F.size("pt").cast("bigint").alias("n_kept"))
