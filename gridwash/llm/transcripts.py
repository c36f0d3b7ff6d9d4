"""Chat formatting: speaker roles of raw transcripts by a hidden Markov model.

A transcript is a text of lines, some of which start with a speaker marker. The hidden
state of a line is its speaker's role and whether the line begins a turn or goes on with
it. Markers and simple features of the line are observed; the Viterbi path gives the
roles, and turns are rendered in one canonical form.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gridwash.functions.cells import column

ROLES = ("system", "user", "assistant")
#: Fixed: words that mark a speaker, by role; compared in lower case.
MARKERS = {
    "system": ("system", "sys", "instructions", "context"),
    "user": ("user", "human", "you", "customer", "question", "q", "me", "instruction"),
    "assistant": ("assistant", "ai", "bot", "agent", "answer", "a", "model", "response"),
}
_ROLE_OF = {w: r for r, names in enumerate(MARKERS.values()) for w in names}
_MARK = re.compile(
    r"^[ \t]*(?:<\|(?P<tag>[a-z]+)\|>|#{1,4}[ \t]*(?P<head>[a-z]+)[ \t]*:?(?=[ \t]|$)|\**(?P<name>[a-z]+)\**[ \t]*[:>](?!//)\**|\[(?P<box>[a-z]+)\]:?)[ \t]*",
    re.IGNORECASE,
)
#: Observed symbols of a line: marker (none, or one of the roles), then a blank line
#: before it, a question mark at its end, and its length in four steps.
MARKS, BLANKS, ASKS, SIZES = 4, 2, 2, 4
STATES = 2 * len(ROLES)


def marker(line: str) -> tuple[int | None, str]:
    """(role number or None, the line without the marker)."""
    found = _MARK.match(line)
    word = (found["tag"] or found["head"] or found["name"] or found["box"]).lower() if found else None
    if word in _ROLE_OF:
        return _ROLE_OF[word], line[found.end() :]
    return None, line


def observe(line: str, blank_before: bool, role: int | None, rest: str) -> tuple[int, int]:
    """(marker symbol, symbol of the other features)."""
    size = min(SIZES - 1, len(rest).bit_length() // 3)
    asks = rest.rstrip().endswith("?")
    return (0 if role is None else role + 1), (int(blank_before) * ASKS + int(asks)) * SIZES + size


def lines_of(text: str):
    """(line without marker, observations) of the lines that are not blank."""
    blank = False
    for line in (text or "").split("\n"):
        if not line.strip():
            blank = True
            continue
        role, rest = marker(line)
        yield rest, observe(line, blank, role, rest)
        blank = False


class Model:
    """Log probabilities: start, move (state to state), marks and features by state.

    State 2 * role begins a turn, 2 * role + 1 goes on with it.
    """

    def __init__(self, start: np.ndarray, move: np.ndarray, marks: np.ndarray, features: np.ndarray):
        norm = lambda x: np.log(x / x.sum(-1, keepdims=True))
        self.start, self.move, self.marks, self.features = map(norm, (start, move, marks, features))

    @classmethod
    def prior(cls) -> Model:
        """Counts that stand for what transcripts look like before any is seen."""
        return cls(*prior_counts())

    def path(self, seen: list[tuple[int, int]]) -> np.ndarray:
        """The most likely states (Viterbi), ties to the smaller state."""
        n = len(seen)
        mark, other = np.array(seen, np.int64).reshape(-1, 2).T
        emit = self.marks[:, mark].T + self.features[:, other].T
        back = np.zeros((n, STATES), np.int64)
        score = self.start + emit[0]
        for i in range(1, n):
            options = score[:, None] + self.move
            back[i] = options.argmax(0)
            score = options[back[i], np.arange(STATES)] + emit[i]
        out = np.empty(n, np.int64)
        out[-1] = score.argmax()
        for i in range(n - 1, 0, -1):
            out[i - 1] = back[i, out[i]]
        return out


def prior_counts():
    roles = len(ROLES)
    start = np.full(STATES, 0.01)
    start[[0, 2, 4]] = (2, 5, 1)
    move = np.full((STATES, STATES), 0.02)
    for r in range(roles):
        for s in (2 * r, 2 * r + 1):
            move[s, 2 * r + 1] += 4
            move[s, 2] += 3 if r != 1 else 0.2
            move[s, 4] += 3 if r == 1 else 0.2
    marks = np.full((STATES, MARKS), 0.02)
    for r in range(roles):
        marks[2 * r, r + 1] += 8
        marks[2 * r, 0] += 2
        marks[2 * r + 1, 0] += 10
    features = np.full((STATES, BLANKS * ASKS * SIZES), 1.0)
    return start, move, marks, features


def fit(labelled: DataFrame, text: str = "text", roles: str = "roles", weight: float = 0.05) -> Model:
    """Model from all transcripts whose turns are known: ``roles`` has the role of every
    line that is not blank, and whether it begins a turn (array of struct role, first).

    Tasks count starts, moves and observations; only these tables reach the driver. The
    prior counts stand for ``weight`` of the data, and alone if there is none.
    """
    sizes = [STATES, STATES * STATES, STATES * MARKS, STATES * BLANKS * ASKS * SIZES]
    begin = np.cumsum([0, *sizes])

    def count(batches):
        total = np.zeros(begin[-1], np.int64)
        for batch in batches:
            for raw, known in zip(batch.column(0), batch.column(1)):
                seen, known = [o for _, o in lines_of(raw.as_py())], known.as_py() or []
                before, start = None, True
                for (m, f), k in zip(seen, known):
                    if k["role"] not in ROLES:
                        before, start = None, False
                        continue
                    s = 2 * ROLES.index(k["role"]) + (0 if k["first"] else 1)
                    # What follows a line of no known role is neither a start nor a known move.
                    if start or before is not None:
                        total[s if start else begin[1] + before * STATES + s] += 1
                    total[begin[2] + s * MARKS + m] += 1
                    total[begin[3] + s * (BLANKS * ASKS * SIZES) + f] += 1
                    before, start = s, False
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], ["cell", "n"])

    rows = labelled.select(column(text), column(roles)).mapInArrow(count, "cell long, n long")
    total = np.zeros(begin[-1])
    for r in rows.groupBy("cell").agg(F.sum("n").alias("n")).collect():
        total[r.cell] = r.n
    shapes = [(STATES,), (STATES, STATES), (STATES, MARKS), (STATES, BLANKS * ASKS * SIZES)]
    learned = [total[begin[i] : begin[i + 1]].reshape(s) for i, s in enumerate(shapes)]
    return Model(*[t + p * max(1.0, weight * t.sum() / p.sum()) for t, p in zip(learned, prior_counts())])


def parse(transcripts: DataFrame, model: Model, id_col: str = "conv_id", text_col: str = "text") -> DataFrame:
    """Per transcript: id, turns (array of role, text), rendered.

    Lines go to the turn that the path puts them in; markers are cut off; blank lines
    end up as single line breaks. Rendered: <|role|> on a line of its own, the text, and
    <|end|>, for every turn.

    Null, empty and blank transcripts have no turns and render as the empty string;
    repeated rows are each parsed; an empty table gives no rows; other columns are
    ignored.
    """
    shared = transcripts.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def read(batches):
        model = shared.value
        for batch in batches:
            turns, shown = [], []
            for raw in batch.column(1):
                lines = list(lines_of(raw.as_py()))
                own: list[dict] = []
                before = None
                for (rest, _), s in zip(lines, model.path([o for _, o in lines]) if lines else ()):
                    if before is None or s % 2 == 0 or s // 2 != before:
                        own.append({"role": ROLES[s // 2], "text": rest})
                    else:
                        own[-1]["text"] += "\n" + rest
                    before = s // 2
                turns.append(own)
                shown.append("".join(f"<|{t['role']}|>\n{t['text'].strip()}\n<|end|>\n" for t in own))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(turns, kind), pa.array(shown, pa.string())], ["id", "turns", "rendered"]
            )

    chosen = transcripts.select(column(id_col).cast("long"), column(text_col))
    out = chosen.mapInArrow(read, "id long, turns array<struct<role:string,text:string>>, rendered string")
    return out.withColumnRenamed("id", id_col)


def raw_transcripts(turns: DataFrame, conv="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """(id, text, roles): conversations written as raw transcripts in several styles.

    The style of markers goes by a hash of the conversation, and about one turn in four
    after the first has none. A turn of no role or another one than the three (tool,
    function) is written without a marker and its lines have no known role, so that the
    model places it. Repeated rows of a turn (all four columns equal) are written once,
    turns without an order behind the others; rows without an id belong to no
    conversation and are left out. A conversation is one text, as it is in a transcript
    file, so it has to fit a row.
    """
    known = turns.select(*[column(c).alias(n) for c, n in ((conv, "conv"), (turn, "turn"), (role, "role"), (text, "text"))])
    known = known.where(F.col("conv").isNotNull()).distinct()
    known = known.withColumn("role", F.when(F.col("role").isin(*ROLES), F.col("role")))
    style = F.pmod(F.xxhash64("conv"), F.lit(4))
    bare = (F.pmod(F.xxhash64("conv", "turn", F.lit(1)), F.lit(4)) == 0) & (F.col("turn") > 0)
    pick = lambda *names: F.when(F.col("role") == "system", names[0]).when(F.col("role") == "user", names[1]).otherwise(names[2])
    mark: Column = (
        F.when(bare | F.col("role").isNull(), F.lit(""))
        .when(style == 0, pick("System: ", "User: ", "Assistant: "))
        .when(style == 1, pick("### Context\n", "### Instruction\n", "### Response\n"))
        .when(style == 2, pick("[SYSTEM] ", "[HUMAN] ", "[BOT] "))
        .otherwise(pick("**System:** ", "**Q:** ", "**A:** "))
    )
    body = F.concat(mark, F.coalesce("text", F.lit("")), F.lit("\n"))
    lines = F.filter(F.split(body, "\n"), lambda x: F.trim(x) != "")
    roles = F.transform(lines, lambda x, i: F.struct(F.col("role").alias("role"), (i == 0).alias("first")))
    rows = known.select("conv", F.struct(F.col("turn").isNull().alias("late"), "turn", body.alias("body"), roles.alias("roles")).alias("t"))
    grouped = rows.groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    return grouped.select(
        F.col("conv").alias(conv),
        F.array_join(F.transform("ts", lambda t: t["body"]), "\n").alias("text"),
        F.flatten(F.transform("ts", lambda t: t["roles"])).alias("roles"),
    )
