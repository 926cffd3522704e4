"""Runs of repeated words (maximal periodic stretches) by a suffix automaton with link-cut access.

The automaton of a word sequence grows by one word at a time; its suffix links are a tree, and the suffixes of what was
read so far are the path from the newest state to the root. Each state has a colour: the last place where its words end.
A link-cut tree keeps stretches of a path with one colour together, so after word i ``access`` walks over these stretches
and recolours them to i. A stretch of colour e whose longest state has length L says that the last L words also ended
at e and nowhere later. With ``p = i - e <= L`` they overlap or touch: the last L + p words have smallest period p.
The same start and period at the next word is the same run, one word longer; what stays is maximal.

A run of 12 words and two periods repeats at least six words one period on, so it lies where every word belongs to a
six-word window that the document holds twice. Only these stretches are read by the automaton; what they leave out
can't be in a run. Window codes are 64-bit sums; a collision only adds words to read.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import slices
from creditloom.llm.words import PLACES

LEAST = 12  # words in a run
WINDOW = LEAST // 2
OUT_BYTES = 4 << 20

Edit = Callable[[int | None, list[bytes]], list[bytes]]


class Automaton:
    """Suffix automaton over word numbers, with its suffix links as a link-cut tree. State 0 stands for the root.

    Splay nodes are states: ``up`` is the splay parent or, at the top of a splay, the path's parent; nodes left of a
    node are nearer to the root. ``colour`` is lazy: it holds for a whole splay tree below a node where ``lazy`` is set.
    """

    def __init__(self, n: int):
        size = 2 * n + 2
        zero = array("i", bytes(4 * size))
        self.length, self.link = array("i", zero), array("i", zero)
        self.word, self.to = array("i", zero), array("i", zero)  # a state's first transition; to = 0: none
        self.more: dict[tuple[int, int], int] = {}  # its other transitions
        self.others: dict[int, list[int]] = {}
        # link-cut tree, nodes are states + 1 so that 0 means none
        self.left, self.right, self.up = array("i", zero), array("i", zero), array("i", zero)
        self.colour, self.lazy = array("i", zero), bytearray(size)
        self.states, self.last = 1, 0
        self.link[0] = -1

    def step(self, state: int, word: int) -> int:
        """The state after ``word``, 0 if there is none."""
        if self.to[state] and self.word[state] == word:
            return self.to[state]
        return self.more.get((state, word), 0)

    def extend(self, word: int) -> int:
        length, link, first, to, more = self.length, self.link, self.word, self.to, self.more
        new = self.states
        self.states += 1
        length[new] = length[self.last] + 1
        state = self.last
        self.last = new
        while state >= 0:
            if not to[state]:
                first[state], to[state] = word, new
            elif first[state] == word or (state, word) in more:
                break
            else:
                more[state, word] = new
                self.others.setdefault(state, []).append(word)
            state = link[state]
        if state < 0:
            link[new] = 0
            self.up[new + 1] = 1
            return new
        after = to[state] if first[state] == word else more[state, word]
        if length[after] == length[state] + 1:
            link[new] = after
            self.up[new + 1] = after + 1
            return new
        clone = self.states
        self.states += 1
        length[clone] = length[state] + 1
        first[clone], to[clone] = first[after], to[after]
        if after in self.others:
            words = self.others[clone] = list(self.others[after])
            for w in words:
                more[clone, w] = more[after, w]
        while state >= 0:
            if to[state] and first[state] == word:
                if to[state] != after:
                    break
                to[state] = clone
            elif more.get((state, word)) == after:
                more[state, word] = clone
            else:
                break
            state = link[state]
        self.insert(clone, after)
        link[clone] = link[after]
        link[after] = link[new] = clone
        self.up[new + 1] = clone + 1
        return new

    def insert(self, clone: int, below: int) -> None:
        """``clone`` between ``below`` and its parent; it ended last where ``below`` did."""
        node, new = below + 1, clone + 1
        left, up = self.left, self.up
        self.splay(node)
        self.colour[new] = self.colour[node]
        left[new] = left[node]  # the part of the stretch above, if it doesn't begin here
        if left[new]:
            up[left[new]] = new
        left[node], up[new] = new, node

    def splay(self, node: int) -> None:
        left, right, up, colour, lazy = self.left, self.right, self.up, self.colour, self.lazy
        # push colours down from the top of this splay tree
        path = [node]
        at = node
        while True:
            above = up[at]
            if not above or (left[above] != at and right[above] != at):
                break
            path.append(above)
            at = above
        for at in reversed(path):
            if lazy[at]:
                c = colour[at]
                if (child := left[at]):
                    colour[child], lazy[child] = c, 1
                if (child := right[at]):
                    colour[child], lazy[child] = c, 1
                lazy[at] = 0
        steps = len(path) - 1
        while steps > 0:
            parent = up[node]
            if steps > 1:
                grand = up[parent]
                if (left[grand] == parent) == (left[parent] == node):
                    self.rotate(parent)
                else:
                    self.rotate(node)
                self.rotate(node)
                steps -= 2
            else:
                self.rotate(node)
                steps -= 1

    def rotate(self, node: int) -> None:
        left, right, up = self.left, self.right, self.up
        parent = up[node]
        grand = up[parent]
        if left[parent] == node:
            inner = right[node]
            left[parent] = inner
            right[node] = parent
        else:
            inner = left[node]
            right[parent] = inner
            left[node] = parent
        if inner:
            up[inner] = parent
        up[parent] = node
        up[node] = grand
        if grand:
            if left[grand] == parent:
                left[grand] = node
            elif right[grand] == parent:
                right[grand] = node

    def access(self, state: int, place: int) -> list[tuple[int, int]]:
        """(colour, length of the longest state) of the stretches above ``state``; all become ``place``.

        Places count from 1; a state without a colour has 0. ``state`` is new and has no children.
        """
        left, right, up, colour, lazy = self.left, self.right, self.up, self.colour, self.lazy
        met: list[tuple[int, int]] = []
        below, node = 0, state + 1
        length = self.length
        while node:
            self.splay(node)
            if below and colour[node]:
                met.append((colour[node], length[node - 1]))
            right[node] = below
            if below:
                up[below] = node
            below, node = node, up[node]
        # below is now the top of the one splay tree of the whole path
        colour[below], lazy[below] = place, 1
        return met


def periodic(words: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of all runs of at least ``LEAST`` words and two periods, by start and period."""
    tree = Automaton(len(words))
    extend, access = tree.extend, tree.access
    now: dict[int, list[int]] = {}  # period: start, end of its newest run
    found: list[tuple[int, int, int]] = []
    for place, word in enumerate(words, 1):
        for end, length in access(extend(word), place):
            period = place - end
            if period <= length:
                start = end - length
                held = now.get(period)
                if held is not None and held[0] == start:
                    held[1] = place
                else:
                    if held is not None:
                        found.append((held[0], held[1] - held[0], period))
                    now[period] = [start, place]
    found += [(start, end - start, period) for period, (start, end) in now.items()]
    return sorted((r for r in found if r[1] >= LEAST), key=lambda r: (r[0], r[2]))


def repetitive(numbers: np.ndarray) -> list[tuple[int, int]]:
    """Stretches [begin, end) of at least ``LEAST`` words that are covered by windows occurring more than once."""
    n = len(numbers) - WINDOW + 1
    code = np.zeros(n, dtype=np.uint64)
    for place in range(WINDOW):
        code += (numbers[place : place + n] + np.uint64(1)) * PLACES[place]
    order = np.argsort(code, kind="stable")
    same = code[order][1:] == code[order][:-1]
    if not same.any():
        return []
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(numbers) + 2, dtype=np.int8)
    change = np.zeros(len(numbers) + 1, dtype=np.int32)
    at = np.flatnonzero(twice)
    change[at] += 1
    change[at + WINDOW] -= 1
    covered[1:-1] = np.cumsum(change[:-1]) > 0
    edges = np.diff(covered)
    pairs = zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True)
    return [(a, b) for a, b in pairs if b - a >= LEAST]


def runs_of(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a word sequence."""
    if len(words) < LEAST:
        return []
    known: dict[bytes, int] = {}
    numbers = [known.setdefault(w, len(known)) for w in words]
    found: list[tuple[int, int, int]] = []
    if len(known) < len(words) - WINDOW + 1:  # at least six words stand again
        for begin, end in repetitive(np.array(numbers, dtype=np.uint64)):
            found += [(begin + start, length, period) for start, length, period in periodic(numbers[begin:end])]
    return found


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """``words`` without those that any run contains after its first period."""
    if not found:
        return words
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    keep = np.cumsum(change[:-1]) == 0
    return [words[i] for i in np.flatnonzero(keep)]


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RESULT = "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed binary"


def periodic_runs(docs: DataFrame, edit: Edit | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed text of every row.

    Words are runs of bytes other than ASCII white space; ``edit`` may change a document's words first. ``collapsed`` is
    the words outside of runs and those of each run's first period, joined by one space. A null or empty text has no words
    and no runs; every row counts, also repeated ones and those without an id. Other columns are ignored. Each text is
    read by one task, which needs some 200 bytes for each word that is covered by repeated windows.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            sizes, found, kept = [], [], []
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = (raw or b"").split()
                if edit:
                    words = edit(doc, words)
                runs = runs_of(words)
                sizes.append(len(words))
                found.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                kept.append(b" ".join(collapsed(words, runs)))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(RUN)), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    plain = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return plain.mapInArrow(rows, RESULT)


def digests(found: DataFrame) -> DataFrame:
    """The longest run (ties: smallest start, then period) and digests of what ``periodic_runs`` returns."""
    longest = F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS start, -r.period AS period)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return found.withColumn("_best", longest).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.expr("-_best.start").alias("start"),
        F.expr("_best.length").alias("length"),
        F.expr("-_best.period").alias("period"),
        F.expr("1000 * _best.length div -_best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
