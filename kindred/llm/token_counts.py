"""Token counts by a finite-state transducer compiled from a sentencepiece BPE model.

The transducer reads characters and each transition carries the number of tokens it adds. It rests
on one property of BPE: the last token of the encoding of every prefix is determined by the prefix,
and it is the only vocabulary token ``t`` at the prefix's end that stays apart from the last token
before it (encoding the two together gives the two). So a state is

* the longest suffix of what was read that begins some piece, and
* for each position inside that suffix: the last token up to there and the count relative to now.

Suffixes are at most one piece long, so the states are finite; they are made when first reached.
Where no piece spans two neighbouring characters the transducer is back in a state that depends on
the second one only (it is synchronised), which is the case at every word start.

A text is cut in chunks. A chunk's state map is (head, count, end): ``head`` is what stands before
its first synchronising place (its effect depends on the state before), ``count`` the tokens after
it, ``end`` the state at the chunk's end whatever came before (None: no such place, all is head).
Maps compose associatively and a parallel prefix scan gives the counts up to each chunk's end.

Null text counts as empty; empty text has no tokens; repeated rows give repeated result rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.sources.storage import ship

SPACE = "▁"
#: Word maps, states and pairs of tokens kept in a worker. Words met later are read character by character; states and pairs are made anew.
CACHE, STATES, PAIRS = 500_000, 150_000, 500_000
#: Characters in a chunk.
CHUNK = 1 << 16


class Transducer:
    START = 0

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.score = {
            sp.id_to_piece(i): sp.get_score(i)
            for i in range(sp.get_piece_size())
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))
        }
        self.begins = {p[:n] for p in self.score for n in range(1, len(p) + 1)}
        if any(a != SPACE and b == SPACE for p in self.score for a, b in zip(p, p[1:], strict=False)):
            raise ValueError("a piece spans a word start")
        if any("\n" in p for p in self.score):
            raise ValueError("a piece holds a line end")
        self.apart: dict[tuple[str, str], bool] = {}
        self.words = _Words(self)
        self._forget()

    def _forget(self) -> None:
        self.keys: dict[tuple, int] = {}
        self.states: list[tuple[str, tuple]] = []
        self.moves: list[dict[str, tuple[int, int]]] = []
        self._state("", ((None, 0),))

    def _state(self, suffix: str, ends: tuple) -> int:
        key = (suffix, ends)
        if key not in self.keys:
            self.keys[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
        return self.keys[key]

    def merge(self, text: str) -> list[str]:
        """The encoding of a short string by its definition: best-scored neighbours merge first, the left ones of equals."""
        parts = list(text)
        while True:
            best = max(
                ((self.score[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.score),
                default=None,
            )
            if best is None:
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def _apart(self, left: str | None, right: str) -> bool:
        if left is None:
            return True
        key = (left, right)
        if key not in self.apart:
            if len(self.apart) >= PAIRS:
                self.apart.clear()
            self.apart[key] = self.merge(left + right) == [left, right]
        return self.apart[key]

    def _move(self, state: int, char: str) -> tuple[int, int]:
        suffix, ends = self.states[state]
        longest = suffix + char
        while longest and longest not in self.begins:
            longest = longest[1:]
        if not longest:  # in no piece: its bytes are tokens
            return self.START, len(char.encode())
        if len(longest) == 1 and state != self.START:  # nothing spans the place before it
            return self.step(self.START, char)
        for n in range(len(longest), 0, -1):
            token = longest[-n:]
            if (n == 1 or token in self.score) and self._apart(ends[n - 1][0], token) and self.merge(token) == [token]:
                added = ends[n - 1][1] + (1 if token in self.score else len(token.encode()))
                kept = ((token, 0), *((t, c - added) for t, c in ends[: len(longest)]))
                return self._state(longest, kept), added
        raise AssertionError("no token fits")

    def step(self, state: int, char: str) -> tuple[int, int]:
        moves = self.moves[state]
        if char not in moves:
            moves[char] = self._move(state, char)
        return moves[char]

    def run(self, state: int, text: str) -> tuple[int, int]:
        """(state after the text, tokens added)."""
        total, moves = 0, self.moves
        for char in text:
            got = moves[state].get(char) or self.step(state, char)
            state = got[0]
            total += got[1]
        return state, total

    def chunk(self, text: str) -> tuple[str, int, int | None]:
        """The state map of an escaped chunk."""
        first = _BREAK.search(text)
        if not first:
            return text, 0, None
        last = text.rfind(SPACE) if text[-1] != SPACE else re.search(f"{SPACE}+$", text).start()
        last = max(last, text.rfind("\n") + 1)
        while 0 < last < len(text) and text[last] == SPACE == text[last - 1]:
            last -= 1
        at = first.end() if first[0] == "\n" else first.start() + 1
        head = text[: first.start()] + ("\n" if first[0] == "\n" else first[0][0])
        if last < at:
            last = at
        end, tail = self.run(self.START, text[last:])
        return head, self._whole(text[at:last]) + tail, end

    def _whole(self, text: str) -> int:
        """Tokens of an escaped stretch that begins and ends at synchronising places."""
        if SPACE * 2 in text:
            return sum(self.run(self.START, x)[1] for x in _SEGMENT.findall(text))
        if text[:1] == SPACE:
            return self._plain(text[1:].replace(SPACE, " "))
        return self._plain("\n" + text.replace(SPACE, " ")) - 2

    def _plain(self, text: str) -> int:
        """Tokens of a text without runs of spaces: its words, each with the space or line end before it."""
        return sum(map(self.words.__getitem__, text.replace("\n", " \n").split(" ")))

    def compose(self, a: tuple, b: tuple) -> tuple:
        if a[2] is None:
            return a[0] + b[0], b[1], b[2]
        end, n = self.run(a[2], b[0])
        return (a[0], a[1] + n, end) if b[2] is None else (a[0], a[1] + n + b[1], b[2])

    def scan(self, maps: list[tuple]) -> list[tuple]:
        """Inclusive prefix scan: pairs are composed, their scan spread back; log2 levels, each one parallel."""
        if len(maps) < 2:
            return maps
        pairs = self.scan([self.compose(maps[i], maps[i + 1]) for i in range(0, len(maps) - 1, 2)])
        out = [maps[0]]
        for i in range(1, len(maps)):
            out.append(pairs[i // 2] if i % 2 else self.compose(pairs[i // 2 - 1], maps[i]))
        return out

    def count(self, text: str | None, chunk: int = CHUNK) -> int:
        if not text:
            return 0
        if len(self.states) > STATES:
            self._forget()
        if len(text) <= chunk and "  " not in text and text[0] != " " and SPACE not in text:
            return self._plain(text)
        escaped = SPACE + text.replace(" ", SPACE)
        head, n, _ = self.scan([self.chunk(escaped[i : i + chunk]) for i in range(0, len(escaped), chunk)])[-1]
        return n + self.run(self.START, head)[1]


#: Places before which the transducer is synchronised: a word start, or after a character that no piece holds.
_BREAK = re.compile(f"[^{SPACE}]{SPACE}|\n")
_SEGMENT = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")


class _Words(dict):
    """Transitions over whole words from the start state: the counts of a word after a space, or after a line end."""

    def __init__(self, machine: Transducer):
        super().__init__()
        self.machine = machine

    def __missing__(self, word: str) -> int:
        n = self.machine.run(Transducer.START, word if word[:1] == "\n" else SPACE + word)[1]
        if len(word) <= 64 and len(self) < CACHE:
            self[word] = n
        return n


_machines: dict[str, Transducer] = {}


def machine(model_file: str) -> Transducer:
    """One transducer for each Python worker and model."""
    if model_file not in _machines:
        _machines[model_file] = Transducer(model_file)
    return _machines[model_file]


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of ``docs``; a narrow pass, nothing is shuffled."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(model_file)
        for b in it:
            n = pa.array([m.count(t.as_py()) for t in b.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), n], ["doc_id", "n_bytes", "n_tokens"])

    ship(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return rows.mapInArrow(batches, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
