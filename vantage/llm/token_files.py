"""Token ids as flat binary files with 64-bit document offsets.

Format, per shard (a run of documents in ascending id order, shards numbered
in that order):

* ``ids-*.bin``: the token ids of the shard's documents, one after the other,
  little-endian unsigned integers (2 bytes where the vocabulary fits, else 4),
  each document closed by the end id;
* ``docs-*.bin``: the document ids, little-endian signed 64-bit; the last
  ``n_null`` of a shard stand for null ids;
* ``lengths-*.bin``: ids per document, little-endian unsigned 64-bit;
* ``offsets-*.bin``: where each document starts among the ids of *all* shards,
  little-endian unsigned 64-bit, with one more entry for the end;

and one manifest row per shard naming them.  Writing takes two passes: the
first writes ids and lengths of every shard and reports their totals; prefix
sums of these totals give each shard its base, and the second adds the base to
the running lengths.  No task needs another's rows, files carry a name of
their own per attempt, and only files of committed tasks are in the manifest,
so a task that is run again or twice leaves nothing wrong behind.

Documents are dealt to shards by bounds on the id (approximate quantiles, so
shards hold about equally many documents); rows that share one id are dealt by
the hash of their text in hash order, so one id with a third of the rows fills
many shards.  The order is id (null as the greatest), then that hash.

A tokenizer whose configuration never lets a token or a normalisation reach
across a blank is applied word by word: a bounded cache holds the packed ids of
words seen before, the library encodes the others.  Texts in Latin letters
alone, which that configuration's normalisation only makes lower case, are cut
by its word pattern, other texts at blanks.  Any other configuration encodes
whole texts.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vantage.llm.common import bound_batches, col, materialise
from vantage.session import checkpoint_dir

END_ID = 1
#: Bytes of text a shard holds on average, and the most shards (beyond, shards grow).
SHARD_BYTES, MAX_SHARDS = 32 << 20, 50_000
#: Words a worker remembers in each of two generations, and the longest of them in characters; longer ones are encoded each time.
CACHE_WORDS, CACHE_CHARS = 300_000, 64
#: Characters encoded in one library call.
CALL_CHARS = 1 << 20
#: Stands between words in a call: a control character, so a word of its own, whose last byte ends no other word.
_MARK = "\x01"
_TOP = (1 << 63) - 1


# ---- files ---------------------------------------------------------------------------------------------

def _local(path: str) -> str | None:
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return path if "://" not in path else None


def _sink(path: str):
    local = _local(path)
    if local is not None:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        return open(local, "wb")
    fs, inner = pafs.FileSystem.from_uri(path)
    return fs.open_output_stream(inner)


def _mapped(path: str, dtype: np.dtype, n: int) -> np.ndarray:
    """The file's numbers: memory-mapped where the folder is mounted, else read as one buffer."""
    if n == 0:
        return np.zeros(0, dtype)
    local = _local(path)
    if local is not None:
        return np.memmap(local, dtype=dtype, mode="r", shape=(n,))
    fs, inner = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(inner) as f:
        return np.frombuffer(f.read(), dtype, n)


# ---- encoding ------------------------------------------------------------------------------------------

#: Fixed value: the word pattern of the public tokenizers that drop white space; no match holds white space.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


_LATIN = [c for c in map(chr, range(0x180)) if c != "\u0130"]  # composed, and one small letter for each capital
_L, _N = ("".join(c for c in _LATIN if unicodedata.category(c)[0] == k) for k in "LN")
_OTHER = re.compile(f"[^{_LATIN[0]}-\u012f\u0131-{_LATIN[-1]}]")
#: The word pattern with its classes spelled out for Latin letters.
_LATIN_WORDS = re.compile(_WORDS.replace(r"[^\s\p{L}\p{N}]", f"[^\t\n\x0b\x0c\r \x85\xa0{_L}{_N}]").replace(r"[\p{L}]", f"[{_L}]").replace(r"[\p{N}]", f"[{_N}]"))


def by_word(config: dict) -> bool:
    """Whether encoding a text equals joining the encodings of its blank-separated parts, read off the configuration.

    True where normalisation is canonical composition, blanks to one blank and
    lower case (character by character), words are the matches of a pattern
    that holds no white space, and nothing is added around the sequence.
    """
    norm, pre, model = config.get("normalizer") or {}, config.get("pre_tokenizer") or {}, config["model"]
    steps = norm.get("normalizers", [norm] if norm else [])
    plain = all(s["type"] in ("NFC", "Lowercase") or s == {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "} for s in steps)
    cuts = pre.get("pretokenizers", [pre] if pre else [])
    words = bool(cuts) and cuts[0] == {"type": "Split", "pattern": {"Regex": _WORDS}, "behavior": "Removed", "invert": True}
    bytelevel = all(c["type"] == "ByteLevel" and not c["add_prefix_space"] and not c["use_regex"] for c in cuts[1:])
    added = all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] and not any(c.isspace() for c in t["content"]) for t in config["added_tokens"])
    return plain and words and bytelevel and added and model["type"] == "BPE" and not model.get("dropout")


class Packer:
    """Texts to packed ids, each closed by the end id."""

    def __init__(self, path: str, end_id: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        config = json.loads(self.lib.to_str())
        self.words = by_word(config)
        self.special = [t["content"] for t in config["added_tokens"]]
        self.dtype = id_type(max(self.lib.get_vocab(with_added_tokens=True).values()), end_id)
        self.end = np.array([end_id], self.dtype).tobytes()
        # two generations of words: what the older one is not asked for again is forgotten with it
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        mark = self.lib.encode(_MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None

    def library(self, texts: list[str]) -> list[bytes]:
        out, at = [], 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (stop == at or size + len(texts[stop]) <= CALL_CHARS):
                size += len(texts[stop])
                stop += 1
            out += [np.array(e.ids, self.dtype).tobytes() for e in self.lib.encode_batch_fast(texts[at:stop], add_special_tokens=False)]
            at = stop
        return out

    def encoded(self, words: list[str]) -> list[bytes]:
        """Ids of each word.  One call a few thousand words, with a mark between them that has an id no other text gives."""
        if self.mark is None or any(_MARK in w for w in words):
            return self.library(words)
        out = []
        for at in range(0, len(words), 4000):
            (got,) = self.lib.encode_batch_fast([f" {_MARK} ".join(words[at:at + 4000])], add_special_tokens=False)
            ids = np.array(got.ids, self.dtype)
            cuts = np.flatnonzero(ids == self.mark)
            size, data = ids.itemsize, ids.tobytes()
            ends = [*(cuts * size).tolist(), len(data)]
            starts = [0, *((cuts + 1) * size).tolist()]
            out += [data[a:b] for a, b in zip(starts, ends)]
        return out

    def cut(self, text: str) -> list[str]:
        """Parts of a text whose ids make up the text's: words by the pattern, or else what blanks divide."""
        if _OTHER.search(text) or any(t in text for t in self.special):
            return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        return _LATIN_WORDS.findall(text.lower())

    def pack(self, texts: list[str]) -> Iterator[bytes]:
        if not self.words:
            for t in texts:
                yield self.library([t])[0] + self.end
            return
        for group in grouped(texts):
            split = [self.cut(t) for t in group]
            if len(self.cache) > CACHE_WORDS:
                self.cache, self.older = {}, self.cache
            new = []
            for w in set().union(*split).difference(self.cache):
                if w in self.older:
                    self.cache[w] = self.older[w]
                else:
                    new.append(w)
            long = [w for w in new if len(w) > CACHE_CHARS]
            short = [w for w in new if len(w) <= CACHE_CHARS]
            self.cache.update(zip(long, self.library(long)))
            self.cache.update(zip(short, self.encoded(short)))
            for words in split:
                yield b"".join(map(self.cache.__getitem__, words)) + self.end
            for w in long:
                del self.cache[w]


def grouped(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of up to about ``CALL_CHARS`` characters."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > CALL_CHARS:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def id_type(top: int, end_id: int) -> np.dtype:
    return np.dtype("<u2") if max(top, end_id) < 1 << 16 else np.dtype("<u4")


@lru_cache(maxsize=4)
def packer(path: str, end_id: int) -> Packer:
    return Packer(path, end_id)


# ---- sharding ------------------------------------------------------------------------------------------

def shard_of(keys: np.ndarray, hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Shard of each row: by its key among the bounds; keys that equal several bounds by hash among their shards, in hash order."""
    lo, hi = np.searchsorted(bounds, keys, "left"), np.searchsorted(bounds, keys, "right")
    part = ((hashes.astype(np.float64) + 2.0**63) / 2.0**64 * (hi - lo + 1)).astype(np.int64)
    return lo + np.minimum(part, hi - lo)


def id_bounds(src: DataFrame, shard_bytes: int) -> list[int]:
    """Upper bounds of all shards but the last, from the total text size and approximate quantiles of the ids."""
    size = src.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("n")).first()
    n = min(MAX_SHARDS, -(-(size["bytes"] or 0) // shard_bytes), size["n"])
    if n < 2:
        return []
    at = F.percentile_approx("key", [i / n for i in range(1, n)], max(10_000, 20 * n))
    return list(src.agg(at.alias("at")).first()["at"])


# ---- write and read ------------------------------------------------------------------------------------

def write_token_files(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID,
                      shard_bytes: int = SHARD_BYTES, folder: str | None = None) -> DataFrame:
    """Encode ``docs`` and write the files described above under ``folder`` (default: the shared checkpoint folder).

    Returns the manifest: ``shard, folder, name, width, n_docs, n_null, n_ids, base_docs, base_ids``.
    Null texts are empty (the end id alone); rows with a null id come last;
    repeated rows stay; other columns are ignored; an empty table gives an
    empty manifest.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    folder = (folder or f"{checkpoint_dir(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}").rstrip("/")
    src = docs.select(col(id_col).cast("bigint").alias("id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    src = src.select("id", F.coalesce("id", F.lit(_TOP)).alias("key"), "text")
    bounds = id_bounds(src, shard_bytes)
    n_shards, at = len(bounds) + 1, np.array(bounds, np.int64)

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = packer(tokenizer, end_id)
        for part in parts:
            keys, h = (part.column(c).to_numpy(zero_copy_only=False) for c in ("key", "h"))
            shard = pa.array(shard_of(keys, h, at).astype(np.int32))
            ids = pa.array(own.pack(part.column("text").to_pylist()), pa.binary())
            yield pa.RecordBatch.from_arrays([shard, part.column("id"), part.column("key"), part.column("h"), ids], names=["shard", "id", "key", "h", "ids"])

    packed = src.withColumn("h", F.xxhash64("text")).mapInArrow(encode, "shard int, id bigint, key bigint, h bigint, ids binary")
    packed = packed.repartitionById(n_shards, F.col("shard")).sortWithinPartitions("key", "h", "ids").select("shard", "id", "ids")

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = packer(tokenizer, end_id).dtype.itemsize
        shard, name, out, n_docs, n_null, n_ids = 0, "", [], 0, 0, 0
        for part in parts:
            if part.num_rows == 0:
                continue
            if not out:
                shard = part.column("shard")[0].as_py()
                name = f"{shard:06d}-{uuid.uuid4().hex}.bin"
                out = [_sink(f"{folder}/{kind}-{name}") for kind in ("ids", "docs", "lengths")]
            ids = part.column("ids")
            lengths = np.diff(np.frombuffer(ids.buffers()[1], np.int32, len(ids) + 1, ids.offset * 4)).astype("<u8") // width
            for x in ids:
                out[0].write(x.as_buffer())
            out[1].write(part.column("id").fill_null(_TOP).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            out[2].write(lengths.tobytes())
            n_docs, n_null, n_ids = n_docs + part.num_rows, n_null + part.column("id").null_count, n_ids + int(lengths.sum())
        for f in out:
            f.close()
        if out:
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "name": [name], "width": pa.array([width], pa.int32()),
                                              "n_docs": [n_docs], "n_null": [n_null], "n_ids": [n_ids]})

    shards = materialise(packed.mapInArrow(write, "shard int, name string, width int, n_docs bigint, n_null bigint, n_ids bigint"), "token-shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    based = shards.select("shard", F.lit(folder).alias("folder"), "name", "width", "n_docs", "n_null", "n_ids",
                          F.coalesce(F.sum("n_docs").over(before), F.lit(0)).alias("base_docs"), F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base_ids"))
    based = materialise(based, "token-bases")

    def offsets(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for r in part.to_pylist():
                lengths = _mapped(f"{r['folder']}/lengths-{r['name']}", np.dtype("<u8"), r["n_docs"])
                starts = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8") + np.uint64(r["base_ids"])
                with _sink(f"{r['folder']}/offsets-{r['name']}") as f:
                    f.write(starts.tobytes())
            yield part

    done = based.repartitionById(n_shards, F.col("shard")).mapInArrow(offsets, based.schema)
    return materialise(done, "token-manifest")


def read_token_files(manifest: DataFrame, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """The documents of the files a manifest names: ``id_col, start, n_tokens, ids_crc32`` and, ``with_ids``, their ids.

    Each task maps one shard's files; a document's ids are a slice of them.
    ``ids_crc32`` is the checksum of the ids as little-endian 32-bit integers.
    """
    bound_batches(manifest.sparkSession)
    top = manifest.agg(F.max("shard")).first()[0]

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for r in part.to_pylist():
                at = f"{r['folder']}/{{}}-{r['name']}"
                ids = _mapped(at.format("ids"), np.dtype(f"<u{r['width']}"), r["n_ids"])
                docs = _mapped(at.format("docs"), np.dtype("<i8"), r["n_docs"])
                starts = _mapped(at.format("offsets"), np.dtype("<u8"), r["n_docs"] + 1).astype(np.int64)
                inner, known = starts - r["base_ids"], r["n_docs"] - r["n_null"]
                a = 0
                while a < r["n_docs"]:  # a slice of at most 2,000 documents and, but for a single longer one, 4 million ids
                    b = max(a + 1, min(a + 2000, int(np.searchsorted(inner, inner[a] + (4 << 20), "right")) - 1))
                    got = [ids[inner[i]:inner[i + 1]].astype("<u4") for i in range(a, b)]
                    cols = {id_col: pa.array(docs[a:b], pa.int64(), mask=np.arange(a, b) >= known), "start": pa.array(starts[a:b]),
                            "n_tokens": pa.array(np.diff(starts[a:b + 1])), "ids_crc32": pa.array([zlib.crc32(g.tobytes()) for g in got], pa.int64())}
                    if with_ids:
                        cols["ids"] = pa.array([g.astype(np.int64) for g in got], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(cols)
                    a = b

    rows = manifest if top is None else manifest.repartitionById(top + 1, F.col("shard"))
    return rows.mapInArrow(read, f"`{id_col}` bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<bigint>" if with_ids else ""))
