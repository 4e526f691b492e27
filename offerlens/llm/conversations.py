"""Repair of the structure of conversations by a dynamic programme over grammar-compressed sequences.

A row of a conversation is a symbol: the class of its role (system, user, assistant, other) and its fault (none, blank, duplicate,
truncated). What a row may become is a min-plus transfer matrix over the states of a legal conversation (nothing yet, system,
user, assistant): entry (i, j) holds the least cost of going from i to j over the row, with insertions before it, and the edits that do so.

Grammar. Re-Pair over the sequences of all conversations: the most frequent neighbours become a symbol of their own, in rounds;
of a round's pairs none share a symbol, so they are replaced together. Every rule has one matrix, the product of its two parts',
computed bottom-up once, on the driver, and shared by all conversations (RULES rules of 16 entries at most). The edits of
an entry are a rope: just the state in the middle, at which its two parts meet; it is written out only where ties are compared or a
conversation's answer is. Of equal costs the ASCII-least edits win. Two entries that tie start at one state and pass the same rows, so
neither's edits begin with all of the other's, and the lesser one stays the lesser whatever follows.

Long conversations. Rows are sorted by ranges of conversation, turn, role and text, so a conversation with a third of all rows spans many
tasks; duplicates are found by the least place of each content; places are cut into blocks of BLOCK rows, whose symbols
are the sequences of the grammar. Blocks of a conversation are then passed in order, with the costs of four states and what the edits
towards them don't have in common yet. The repaired text's digest needs one pass over the conversation's rows, in order, as SHA-256 does:
the rows stream by, and a task holds the edits of one conversation (a byte a row) and one batch.

Damage. crc32("conv_id:turn") % 20: 0 drops a row, 1 empties its text, 2 removes its full stops, question and exclamation marks, 3
repeats it, 4 makes its role user.

Cases. Nulls count as one space in the damage's key, in roles and in texts; a null turn comes first and has no part in gaps; a null conv_id is
a conversation of its own. Rows of one turn go by role, then text (the first HEAD characters of both, then a hash). A role's initial is its first character, as it is written; an empty role
has none, which is legal nowhere. Repeated rows are duplicates. A conversation without rows has no row; one whose rows are all
dropped has zeros, no edits and the digest of nothing. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.llm.common import only, stored

#: Rows of one block of symbols.
BLOCK = 4_096
#: Rules of the grammar at most, and rounds in which they are found.
RULES, ROUNDS = 512, 12
#: Characters of roles and texts that the order of one turn's rows looks at; a sample of them comes to the driver.
HEAD = 100
SPACES = " \t\n\x0b\x0c\r"
INF = 1 << 40

#: What the edits cost, the states and what may follow each of them.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
CLASSES, FAULTS = "suao", ("fine", "blank", "duplicate", "truncated")
AFTER = {NOTHING: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
LEGAL = {"su", "ua", "au"}
ENDS = (NOTHING, ASSISTANT)

#: The symbol of class c and fault f is chr(FIRST + 4 c + f); a rule's follow them.
FIRST = 0x4E00


def symbol(role: str, fault: str) -> str:
    return chr(FIRST + 4 * CLASSES.index(role) + FAULTS.index(fault))


def _inserted(state: int, times: int) -> int:
    for _ in range(times):
        state = AFTER[state]["u" if "u" in AFTER[state] else "a"]
    return state


def _row(number: int) -> tuple[list[list[int]], list[list[str]]]:
    """Costs and edits of one row's symbol, from each state to each."""
    role, fault = CLASSES[number // 4], FAULTS[number % 4]
    cost, edits = [[INF] * 4 for _ in range(4)], [[""] * 4 for _ in range(4)]
    for i in range(4):
        for n in range(3):
            at = _inserted(i, n)
            ways = [(DELETE, "D", at)]
            if fault in ("fine", "truncated"):
                extra = TRUNCATED if fault == "truncated" else 0
                if role in AFTER[at]:
                    ways.append((KEEP + extra, "K", AFTER[at][role]))
                ways.append((REROLE + extra, "R", _inserted(at, 1)))
            for c, e, j in ways:
                c, e = c + INSERT * n, "I" * n + e
                if (c, e) < (cost[i][j], edits[i][j]):
                    cost[i][j], edits[i][j] = c, e
    return cost, edits


@dataclass
class Grammar:
    """Rules and their matrices. Symbol number n below 16 is a row's; 16 + r is rule r's, which stands for the two of pairs[r]."""

    pairs: list[tuple[int, int]] = field(default_factory=list)
    cost: list[list[list[int]]] = field(default_factory=list)
    #: Of a rule: the state in the middle. Of a row's symbol: its edits.
    rope: list[list[list]] = field(default_factory=list)

    def __post_init__(self) -> None:
        for n in range(16):
            cost, edits = _row(n)
            self.cost.append(cost), self.rope.append(edits)
        pairs, self.pairs = self.pairs, []
        for pair in pairs:
            self.add(*pair)

    def add(self, left: int, right: int) -> None:
        cost, rope = [[INF] * 4 for _ in range(4)], [[0] * 4 for _ in range(4)]
        a, b = self.cost[left], self.cost[right]
        for i in range(4):
            for j in range(4):
                least = min(a[i][m] + b[m][j] for m in range(4))
                if least >= INF:
                    continue
                ways = [m for m in range(4) if a[i][m] + b[m][j] == least]
                best = ways[0] if len(ways) == 1 else min(ways, key=lambda m: self.edits(left, i, m) + self.edits(right, m, j))
                cost[i][j], rope[i][j] = least, best
        self.pairs.append((left, right)), self.cost.append(cost), self.rope.append(rope)

    def edits(self, number: int, i: int, j: int) -> str:
        """An entry's rope, written out."""
        out, todo = [], [(number, i, j)]
        while todo:
            n, i, j = todo.pop()
            if n < 16:
                out.append(self.rope[n][i][j])
            else:
                m = self.rope[n][i][j]
                left, right = self.pairs[n - 16]
                todo += [(right, m, j), (left, i, m)]
        return "".join(out)

    def compressed(self, sequence: str) -> str:
        for r, (left, right) in enumerate(self.pairs):
            sequence = sequence.replace(chr(FIRST + left) + chr(FIRST + right), chr(FIRST + 16 + r))
        return sequence

    def passed(self, state: list[tuple[int, str]], sequence: str) -> tuple[str, list[tuple[int, str]]]:
        """Cost and edits to each state after a sequence, from those before it. What all edits begin with is given apart."""
        done = []
        for c in self.compressed(sequence):
            n = ord(c) - FIRST
            cost, after = self.cost[n], []
            for j in range(4):
                least = min(state[i][0] + cost[i][j] for i in range(4))
                if least >= INF:
                    after.append((INF, ""))
                    continue
                after.append((least, min(state[i][1] + self.edits(n, i, j) for i in range(4) if state[i][0] + cost[i][j] == least)))
            live = [e for c, e in after if c < INF]
            same = _common(live)
            if same:
                done.append(live[0][:same])
                after = [(c, e[same:]) for c, e in after]
            state = after
        return "".join(done), state


def _common(texts: list[str]) -> int:
    """How many characters all begin with."""
    low, high = min(texts), max(texts)
    n = min(len(low), len(high))
    return next((i for i in range(n) if low[i] != high[i]), n)


#: The state before a conversation's first row.
START = [(0, ""), (INF, ""), (INF, ""), (INF, "")]


def closed(state: list[tuple[int, str]]) -> tuple[int, str]:
    """The cheapest edits after which a conversation may end."""
    ways = []
    for i, (cost, edits) in enumerate(state):
        n = next(n for n in range(3) if _inserted(i, n) in ENDS)
        if cost < INF:
            ways.append((cost + INSERT * n, edits + "I" * n))
    return min(ways)


# The grammar of all sequences.


def _pairs_of(grammar: Grammar):
    """The task: neighbours of the compressed sequences and how often they are met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, int] = {}
        for batch in batches:
            for sequence, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = grammar.compressed(sequence)
                i = 0
                while i < len(s) - 1:
                    pair = s[i : i + 2]
                    found[pair] = found.get(pair, 0) + n
                    # Three equal symbols in a row have their pair once.
                    i += 2 if pair[0] == pair[1] and s[i + 2 : i + 3] == pair[0] else 1
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["pair", "n"])

    return run


def grammar_of(sequences: DataFrame, rules: int = RULES, rounds: int = ROUNDS) -> Grammar:
    """Re-Pair over sequences(symbols, n). Only counts of pairs come to the driver, of (16 + rules) squared pairs at most; the best ones of each round do."""
    grammar = Grammar()
    for _ in range(rounds):
        if len(grammar.pairs) >= rules:
            break
        counted = sequences.select("symbols", "n").mapInArrow(_pairs_of(grammar), "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).where("n > 1")
        taken: set[str] = set()
        before = len(grammar.pairs)
        for pair, _n in counted.orderBy(F.desc("n"), "pair").limit(rules).collect():
            if not taken & set(pair) and len(grammar.pairs) < rules:
                taken |= set(pair)
                grammar.add(ord(pair[0]) - FIRST, ord(pair[1]) - FIRST)
        if len(grammar.pairs) == before:
            break
    return grammar


# Rows: damage, places, blocks.


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and live of rows after damage; dropped rows stay as not live, so that their conversation is known."""
    rows = only(rows, "conv_id", "turn", "role", "text")
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn"))) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate(filled("text"), ".!?", "")).otherwise(filled("text"))
    times = F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))
    # A kind of null can't be: its key has no null.
    return rows.withColumn("kind", kind).select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(filled("role")).alias("role"), text.alias("text"), (F.col("kind") != 0).alias("live"), F.explode(times).alias("copy")).drop("copy").select("conv_id", "turn", F.when(F.col("live"), F.col("role")).alias("role"), F.when(F.col("live"), F.col("text")).alias("text"), "live")


def _class(role: Column) -> Column:
    initial = F.left(role, F.lit(1))
    return F.when(initial.isin("s", "u", "a"), initial).otherwise("o")


def placed(rows: DataFrame) -> DataFrame:
    """Rows in order, with their place: sorted by ranges, so that no conversation, turn or repeated row has to be in one task."""
    spread = rows.withColumns({"__role": F.left("role", F.lit(HEAD)), "__text": F.left("text", F.lit(HEAD)), "__hash": F.xxhash64("role", "text"), "__at": F.monotonically_increasing_id()})
    keys = ["conv_id", "turn", "__role", "__text", "__hash", "__at"]
    return spread.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*keys[2:]).withColumn("place", F.monotonically_increasing_id())


def blocks_of(rows: DataFrame) -> DataFrame:
    """Blocks of placed rows: conv_id, block, symbols, and the first, last and number of distinct turns."""
    bare = F.rtrim("text", F.lit(SPACES))
    narrow = rows.where("live").select("conv_id", "place", "turn", _class(F.col("role")).alias("class"), (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"), F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("content"))
    first = narrow.groupBy("conv_id", "content").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    marked = narrow.drop("content").join(first, "place", "left")
    fault = F.when(F.col("blank"), 1).when(F.col("first").isNull(), 2).when(F.col("cut"), 3).otherwise(0)
    number = 4 * F.array_position(F.array(*map(F.lit, CLASSES)), F.col("class")) - 4 + fault
    own = marked.select("conv_id", "place", "turn", F.expr(f"place div {BLOCK}").alias("block"), number.cast("int").alias("number"))
    grouped = own.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(F.struct("place", "number"))).alias("rows"), F.min("turn").alias("low"), F.max("turn").alias("high"), F.size(F.collect_set("turn")).alias("turns"))
    letters = F.array(*[F.lit(chr(FIRST + n)) for n in range(16)])
    return grouped.select("conv_id", "block", F.array_join(F.transform("rows", lambda r: F.get(letters, r["number"])), "").alias("symbols"), "low", "high", F.col("turns").cast("long").alias("turns"))


REPAIRED = pa.schema([("conv_id", pa.int64()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])
_NAMES = {USER: b"user:", ASSISTANT: b"assistant:"}


class _Conversation:
    """One conversation as it streams by: first its blocks, then its rows."""

    def __init__(self, conv_id: int | None, grammar: Grammar):
        self.conv_id, self.grammar, self.state, self.done = conv_id, grammar, START, []
        self.counts, self.illegal, self.before = [0] * 16, 0, ""
        self.low = self.high = None
        self.turns = 0
        self.audit: str | None = None
        self.cost = self.at = 0
        self.legal, self.hash, self.empty = NOTHING, hashlib.sha256(), True

    def block(self, symbols: str, low, high, turns: int) -> None:
        done, self.state = self.grammar.passed(self.state, symbols)
        self.done.append(done)
        numbers = np.frombuffer(symbols.encode("utf-32-le"), np.uint32) - FIRST
        for n, count in zip(*np.unique(numbers, return_counts=True), strict=True):
            self.counts[n] += int(count)
        classes = self.before + "".join(CLASSES[n // 4] for n in numbers)
        self.illegal += sum(classes[i : i + 2] not in LEGAL for i in range(len(classes) - 1))
        self.before = classes[-1]
        if turns:
            self.turns += turns - (self.high == low)
            self.low, self.high = low if self.low is None else self.low, high

    def _close(self) -> None:
        if self.audit is None:
            self.cost, rest = closed(self.state)
            self.audit = "".join([*self.done, rest])

    def _put(self, line: bytes) -> None:
        self.hash.update(line if self.empty else b"\n" + line)
        self.empty = False

    def _inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.legal = _inserted(self.legal, 1)
            self._put(_NAMES[self.legal])
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._close()
        self._inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "D":
            return
        self.legal = AFTER[self.legal][role[0]] if edit == "K" else _inserted(self.legal, 1)
        self._put((role.encode() + b":" if edit == "K" else _NAMES[self.legal]) + text.encode())

    def answer(self) -> tuple:
        self._close()
        self._inserts()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        of = lambda fault: sum(self.counts[FAULTS.index(fault) :: 4])
        return self.conv_id, gaps, of("blank"), of("duplicate"), of("truncated"), self.illegal, self.cost, self.audit, self.hash.hexdigest()


def _repair(grammar: Grammar):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Conversation | None = None
        answers: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = list(zip(*answers, strict=True)) or [[]] * len(REPAIRED)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, REPAIRED, strict=True)], schema=REPAIRED)

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for conv_id, kind, symbols, low, high, turns, role, text in zip(*columns, strict=True):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        answers.append(now.answer())
                    now = _Conversation(conv_id, grammar)
                if kind == 0:
                    now.block(symbols, low, high, turns)
                elif kind == 1:
                    now.row(role, text)
            if answers:
                yield out()
                answers = []
        if now is not None:
            answers.append(now.answer())
            yield out()

    return run


def repaired(rows: DataFrame, *, rules: int = RULES, rounds: int = ROUNDS) -> DataFrame:
    """What ails each conversation of rows(conv_id, turn, role, text) after damage, and its cheapest repair."""
    kept = stored(placed(damaged(rows)), "turns")
    blocks = stored(blocks_of(kept), "blocks")
    grammar = grammar_of(blocks.groupBy("symbols").agg(F.count("*").alias("n")), rules, rounds)
    none = lambda kind: F.lit(None).cast(kind)
    heads = blocks.select("conv_id", F.lit(0).alias("kind"), F.col("block").alias("place"), "symbols", "low", "high", "turns", none("string").alias("role"), none("string").alias("text"))
    bodies = kept.select("conv_id", F.when(F.col("live"), 1).otherwise(2).alias("kind"), "place", none("string").alias("symbols"), none("long").alias("low"), none("long").alias("high"), none("long").alias("turns"), "role", "text")
    streamed = heads.unionByName(bodies).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "place").drop("place")
    return streamed.mapInArrow(_repair(grammar), "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
