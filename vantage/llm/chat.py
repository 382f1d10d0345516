"""Transcript parsing: a hidden Markov model recovers speaker roles.

A transcript is a sequence of lines.  Each line gives one symbol: the speaker
marker it begins with (none, user, assistant, system, tool, or a marker of
unknown meaning) and its shape.  States are (role, first line of a turn or
not); transition and emission probabilities are counted on labelled lines
with add-one smoothing; Viterbi decoding gives each line its role and the
lines that begin turns.  Turns are then rendered canonically.

A transcript is decoded in chunks of ``chunk_size`` neighbouring ``ord`` values.  A chunk is a max-plus
matrix (best score from each state before it to each state at its end), and
max-plus products are associative: the matrices of a long transcript, a few
numbers for thousands of lines, fix the states at the chunk borders, and the
chunks are then decoded apart.  The result is the path of the undivided
transcript, and no task holds more than a chunk's symbols or a transcript's
matrices.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantage.llm.common import bound_batches, col, materialise

ROLES = ("system", "user", "assistant", "tool")
CHUNK_SIZE = 1024
#: The model is fitted on this many turns at most, whole conversations first, chosen by the hash of their id.
MAX_TRAIN_TURNS = 20_000
#: Words that name a speaker, by role.
MARKERS = {
    "system": ("system", "sys", "instructions", "context"),
    "user": ("user", "human", "question", "customer", "q", "me"),
    "assistant": ("assistant", "ai", "bot", "answer", "agent", "a", "model"),
    "tool": ("tool", "function", "observation"),
}
_MARK = r"^\s*(?:#{1,4}\s*|\*\*|<\|?|\[|>{1,2}\s*|-\s+)?([A-Za-z]{1,12})(?:\*\*:|:\*\*|\|?>:?|\]:?|:)[ \t]*"
SHAPES = ("blank", "question", "item", "long", "short")


def marker(line: Column) -> Column:
    """0: no marker, 1 to 4: a role's marker, 5: a marker of unknown meaning (a single capitalised word before a colon)."""
    word = F.lower(F.regexp_extract(line, _MARK, 1))
    out = F.when(word == "", 0)
    for k, role in enumerate(ROLES, 1):
        out = out.when(word.isin(*MARKERS[role]), k)
    return out.otherwise(5)


def symbol(line: Column) -> Column:
    bare = F.trim(line)
    shape = (F.when(bare == "", 0).when(bare.endswith("?"), 1).when(bare.rlike(r"^(?:[-*+]|\d+[.)])\s|^```|^    "), 2)
             .when(F.length(bare) >= 200, 3).otherwise(4))
    return (marker(line) * len(SHAPES) + shape).cast("int")


def body(line: Column) -> Column:
    """A line without its speaker marker (markers of unknown meaning stay)."""
    return F.when(marker(line).between(1, len(ROLES)), F.regexp_replace(line, _MARK, "")).otherwise(line)


N_STATES, N_SYMBOLS = 2 * len(ROLES), 6 * len(SHAPES)  # state 2r: role r begins a turn, 2r + 1: goes on


@dataclass(frozen=True)
class Model:
    """Log probabilities: first state, transition, emission."""

    first: list[float]
    move: list[list[float]]
    emit: list[list[float]]


def fit(lines: DataFrame, role: str = "role", begins: str = "begins", previous: str = "previous", sym: str = "sym") -> Model:
    """Counts over labelled lines: ``role`` index, ``begins`` boolean, ``previous`` state (null for a first line) and symbol.

    Only counts of (previous state, state, symbol) reach the driver, at most
    9 x 8 x 30 rows for any input.
    """
    state = (F.col(role) * 2 + F.when(F.col(begins), 0).otherwise(1)).cast("int")
    rows = lines.groupBy(F.col(previous).alias("p"), state.alias("s"), F.col(sym).alias("y")).count().collect()
    first, move, emit = np.ones(N_STATES), np.ones((N_STATES, N_STATES)), np.ones((N_STATES, N_SYMBOLS))
    for p, s, y, n in rows:
        emit[s, y] += n
        if p is None:
            first[s] += n
        else:
            move[p, s] += n
    first[1::2] = 1e-9  # a transcript begins with a turn
    for a in range(N_STATES):  # going on keeps the role
        for b in range(1, N_STATES, 2):
            if a // 2 != b // 2:
                move[a, b] = 1e-9
    log = lambda x: np.log(x / x.sum(axis=-1, keepdims=True)).tolist()
    return Model(log(first), log(move), log(emit))


def chunk_matrix(m: Model, syms: np.ndarray, is_first: bool) -> np.ndarray:
    """Best log score from each state before the chunk to each state at its end (a first chunk: every row alike)."""
    move, emit, first = np.array(m.move), np.array(m.emit), np.array(m.first)
    out = np.broadcast_to(first, (N_STATES, N_STATES)) if is_first else move
    out = out + emit[:, syms[0]]
    for y in syms[1:]:
        out = (out[:, :, None] + move[None, :, :]).max(axis=1) + emit[:, y]
    return out


def borders(mats: list[np.ndarray]) -> list[int]:
    """Best state at the end of each chunk."""
    score, back = mats[0][0], []
    for x in mats[1:]:
        both = score[:, None] + x
        back.append(both.argmax(axis=0))
        score = both.max(axis=0)
    out = [int(score.argmax())]
    for b in reversed(back):
        out.append(int(b[out[-1]]))
    return out[::-1]


def decode(m: Model, syms: np.ndarray, before: int = -1, after: int = -1) -> np.ndarray:
    """Best states of a chunk that starts after state ``before`` (-1: a first chunk) and ends in ``after`` (-1: free)."""
    move, emit, first = np.array(m.move), np.array(m.emit), np.array(m.first)
    score = (first if before < 0 else move[before]) + emit[:, syms[0]]
    back = np.zeros((len(syms), N_STATES), np.int8)
    for k, y in enumerate(syms[1:], 1):
        both = score[:, None] + move
        back[k] = both.argmax(axis=0)
        score = both.max(axis=0) + emit[:, y]
    out = np.zeros(len(syms), np.int8)
    out[-1] = after if after >= 0 else score.argmax()
    for k in range(len(syms) - 1, 0, -1):
        out[k - 1] = back[k, out[k]]
    return out


def recover(lines: DataFrame, model: Model, chunk_size: int = CHUNK_SIZE) -> DataFrame:
    """``lines(conv, ord, sub, line)`` -> ``(conv, pos, line, role, turn)``: the line's role and the position that its turn begins at.

    ``ord``, then ``sub`` (bigint) order a transcript's lines; chunks are cut
    by ``ord``; lines that tie are in the order of their hash.  ``pos`` and
    ``turn`` are structs (ord, sub).  Null lines are blank, a null sub is 0;
    rows without conv or ord have no place in a transcript and give none.
    """
    bound_batches(lines.sparkSession)
    pos = F.struct(F.col("ord").cast("bigint").alias("ord"), F.coalesce(F.col("sub"), F.lit(0)).cast("bigint").alias("sub"))
    src = lines.where("conv is not null and ord is not null").select("conv", pos.alias("pos"), F.coalesce("line", F.lit("")).alias("line"))
    src = src.withColumns({"chunk": F.floor(F.col("pos.ord") / chunk_size).cast("bigint"), "sym": symbol(F.col("line")), "key": F.xxhash64("line")})
    packed = src.groupBy("conv", "chunk").agg(F.sort_array(F.collect_list(F.struct("pos", "key", "sym"))).alias("rows"))
    packed = materialise(packed.withColumn("rows", F.struct(F.col("rows.pos").alias("pos"), F.col("rows.key").alias("key"), F.col("rows.sym").alias("sym")))
                         .select("conv", "chunk", "rows.*"), "chat-chunks")
    many = packed.groupBy("conv").agg(F.count("*").alias("chunks"), F.min("chunk").alias("lead"))
    packed = packed.join(many, "conv")

    @F.pandas_udf("array<double>")
    def matrix(sym: pd.Series, is_first: pd.Series) -> pd.Series:
        return pd.Series([chunk_matrix(model, np.asarray(s), f).ravel() for s, f in zip(sym, is_first)])

    @F.pandas_udf("array<int>")
    def border(mats: pd.Series) -> pd.Series:
        return pd.Series([borders([np.asarray(x).reshape(N_STATES, N_STATES) for x in m]) for m in mats])

    @F.pandas_udf("array<int>")
    def states(sym: pd.Series, before: pd.Series, after: pd.Series) -> pd.Series:
        return pd.Series([decode(model, np.asarray(s), int(b), int(a)).astype(np.int32) for s, b, a in zip(sym, before, after)])

    long = packed.where("chunks > 1").withColumn("m", matrix("sym", F.col("chunk") == F.col("lead")))
    ends = long.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("chunk", "m"))).alias("c"))
    ends = ends.select("conv", F.col("c.chunk").alias("chunks"), border(F.col("c.m")).alias("ends"))
    ends = ends.select("conv", F.posexplode(F.arrays_zip("chunks", "ends")).alias("k", "x"), "ends")
    ends = ends.select("conv", F.col("x.chunks").alias("chunk"), F.col("x.ends").alias("after"),
                       F.when(F.col("k") > 0, F.get("ends", F.col("k") - 1)).otherwise(-1).alias("before"))
    fixed = packed.join(ends, ["conv", "chunk"], "left")
    fixed = fixed.withColumn("state", states("sym", F.coalesce("before", F.lit(-1)), F.coalesce("after", F.lit(-1))))
    # the turn that a chunk's first lines go on with began in an earlier chunk
    starts = F.filter(F.transform(F.arrays_zip("pos", "state"), lambda x: F.when(x["state"] % 2 == 0, x["pos"])), lambda p: p.isNotNull())
    fixed = materialise(fixed.select("conv", "chunk", "pos", "key", "state", F.array_max(starts).alias("last_start")), "chat-states")
    run = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = fixed.select("conv", "chunk", F.last("last_start", ignorenulls=True).over(run).alias("carried"))
    at = fixed.join(carried, ["conv", "chunk"]).select("conv", "chunk", "carried", F.posexplode(F.arrays_zip("pos", "key", "state")).alias("nr", "x"))
    inside = Window.partitionBy("conv", "chunk").orderBy("nr").rowsBetween(Window.unboundedPreceding, 0)
    at = at.select("conv", "chunk", "nr", "x.*", "carried")
    at = at.withColumn("turn", F.coalesce(F.last(F.when(F.col("state") % 2 == 0, F.col("pos")), ignorenulls=True).over(inside), "carried", F.col("pos")))
    nr = Window.partitionBy("conv", "chunk", "pos", "key").orderBy("nr")
    at = at.withColumn("twin", F.row_number().over(nr)).select("conv", "chunk", "pos", "key", "twin", "turn", F.floor(F.col("state") / 2).cast("int").alias("r"))
    src = src.withColumn("twin", F.row_number().over(Window.partitionBy("conv", "chunk", "pos", "key").orderBy("sym")))
    named = F.element_at(F.array(*[F.lit(r) for r in ROLES]), F.col("r") + 1)
    return src.join(at, ["conv", "chunk", "pos", "key", "twin"]).select("conv", "pos", "line", named.alias("role"), "turn")


def render(lines: DataFrame) -> DataFrame:
    """``(conv, pos, line, role, turn)`` -> one row per recovered turn: ``conv, turn, role, n_lines, content, rendered``.

    Rendering: ``<|role|>``, a line break, the turn's lines without speaker
    markers and outer blanks, and ``<|end|>``.
    """
    text = F.sort_array(F.collect_list(F.struct("pos", body(F.col("line")).alias("line"))))
    got = lines.groupBy("conv", "turn").agg(F.min("role").alias("role"), F.count("*").alias("n_lines"), text.alias("rows"))
    got = got.withColumn("content", F.regexp_replace(F.array_join("rows.line", "\n"), r"^\s+|\s+$", ""))
    return got.select("conv", "turn", "role", "n_lines", "content", F.concat(F.lit("<|"), "role", F.lit("|>\n"), "content", F.lit("<|end|>\n")).alias("rendered"))


# --- transcripts made from the conversations table ---------------------------------------------------

#: How one conversation marks its speakers (system, user, assistant, tool); the conversation's hash picks the style.
STYLES = (
    ("System: ", "User: ", "Assistant: ", "Tool: "),
    ("### Instructions: ", "### Human: ", "### Assistant: ", "### Function: "),
    ("[system] ", "[user] ", "[assistant] ", "[tool] "),
    ("**Context:** ", "**Q:** ", "**A:** ", "**Observation:** "),
    ("<|system|> ", "<|user|> ", "<|assistant|> ", "<|tool|> "),
)


def role_index(role: Column) -> Column:
    """Index in ROLES; unknown and null roles count as user."""
    out = F.when(F.lit(False), 0)
    for k, r in enumerate(ROLES):
        out = out.when(role == r, k)
    return out.otherwise(1)


def transcripts(conv: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", drop_every: int = 10) -> DataFrame:
    """Raw transcript lines ``(conv, ord, sub, line, r)`` from a table of turns; ``r`` is the true role.

    Every conversation marks speakers in one of STYLES; about one marker in
    ``drop_every`` is missing (by hash).  ``ord`` is the turn, ``sub`` the
    line in it.
    """
    src = conv.select(col(id_col).alias("conv"), col(turn_col).cast("bigint").alias("ord"), role_index(col(role_col)).alias("r"),
                      F.coalesce(col(text_col), F.lit("")).alias("text"))
    style = F.pmod(F.xxhash64("conv"), F.lit(len(STYLES)))
    mark = F.lit("")
    for k, s in enumerate(STYLES):
        mark = F.when(style == k, F.element_at(F.array(*map(F.lit, s)), F.col("r") + 1)).otherwise(mark)
    shown = F.pmod(F.xxhash64("conv", "ord", "text"), F.lit(drop_every)) != 0
    text = F.concat(F.when(shown, mark).otherwise(""), "text")
    return src.select("conv", "ord", "r", F.posexplode(F.split(text, "\n")).alias("sub", "line"))


def train(conv: DataFrame, max_turns: int = MAX_TRAIN_TURNS, id_col: str = "conv_id", **columns) -> Model:
    """Fit on the transcripts of a bounded sample of labelled turns: the first by conversation hash, turn, role and text, so that the
    order of the rows does not matter."""
    rest = [col(columns.get(f"{c}_col", c)) for c in ("turn", "role", "text")]
    sample = conv.where(col(id_col).isNotNull()).orderBy(F.xxhash64(col(id_col)), col(id_col), *rest).limit(max_turns)
    lines = transcripts(sample, id_col, **columns).where("ord is not null")
    lines = materialise(lines.withColumn("sym", symbol(F.col("line"))).select("conv", "ord", "sub", "r", "sym"), "chat-train")
    state = F.col("r") * 2 + F.when(F.col("sub") == 0, 0).otherwise(1)
    order = Window.partitionBy("conv").orderBy("ord", "r", "sub", "sym")  # max_turns turns in all
    return fit(lines.withColumns({"previous": F.lag(state).over(order), "begins": F.col("sub") == 0}), role="r")


def parse_conversations(conv: DataFrame, model: Model | None = None, id_col: str = "conv_id", chunk_size: int = CHUNK_SIZE, **columns) -> DataFrame:
    """Recovered turns of every transcript made from ``conv``: ``id_col, turn, line, role, n_lines, content_sha256, rendered``.

    ``turn`` and ``line`` say where the recovered turn begins.  Rows without
    a conversation or turn have no place and give none; repeated rows are
    further lines at the same place; an empty table gives no rows.
    """
    lines = transcripts(conv, id_col, **columns)
    got = render(recover(lines, model or train(conv, id_col=id_col, **columns), chunk_size))
    return got.select(F.col("conv").alias(id_col), F.col("turn.ord").alias("turn"), F.col("turn.sub").alias("line"), "role", "n_lines",
                      F.sha2(F.col("content").cast("binary"), 256).alias("content_sha256"), "rendered")
