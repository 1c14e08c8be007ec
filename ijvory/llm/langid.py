"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text per language yields the longest match that
starts anywhere in a text. The text is parsed into such matches, phrase by
phrase; a letter that the language's text lacks is a phrase of its own. Phrases
cost the same in every language, so the one that needs fewest wins, and one with
little labelled text cannot win by naming its few places cheaply.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ijvory.llm.common import slices

#: Default bound of the labelled sample of a language, in rows of PASSAGE characters, and that length.
SAMPLE_ROWS, PASSAGE = 300, 200
#: Texts are parsed in segments of so many symbols side by side; phrases go on across their borders.
SEGMENT, LANES = 2048, 1 << 22
#: The bit that marks a break at a letter that the language lacks; states lie below it.
LACKS = 30
#: Phrases that a text may need beyond what its letters would cost one by one.
SLACK = 3
UNKNOWN = "und"


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the root."""
    move, link, length, last = [{}], [-1], [0], 0
    for c in symbols:
        new = len(move)
        move.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in move[p]:
            move[p][c] = new
            p = link[p]
        if p >= 0:
            q = move[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(move)
                move.append(dict(move[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and move[p].get(c) == q:
                    move[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return move


def packed(move: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The place of each state and one table of all transitions, for symbols below ``width``.

    The transition of a state at place p with symbol c is in ``table[p + c]``: p in the upper 32 bits, the
    place it leads to in the lower ones. Other words are -1 or have another place. States of many
    transitions are placed first; where those of one degree no longer fit between the others, the table grows.
    """
    degree = np.array([len(m) for m in move])
    source = np.repeat(np.arange(len(move)), degree)
    symbol = np.array([c for m in move for c in m], np.int64)
    target = np.array([t for m in move for t in m.values()], np.int64)
    starts = np.cumsum(degree) - degree
    rng = np.random.default_rng(0)
    low, high = 0, 2 * (len(move) + len(symbol)) + 1
    owner, holder, place = np.full(high + width, -1), np.full(high, -1), np.full(len(move), -1)
    for d in np.unique(degree)[::-1]:
        left, low, rounds = np.flatnonzero(degree == d), 0, 0
        while len(left):
            if rounds and not rounds % 20:
                low, high = high, high + 4 * len(left) * (int(d) + 1)
                owner = np.concatenate([owner, np.full(high + width - len(owner), -1)])
                holder = np.concatenate([holder, np.full(high - len(holder), -1)])
            rounds += 1
            at = rng.integers(low, high, len(left))
            slots = at[:, None] + symbol[starts[left, None] + np.arange(d)]
            free = (owner[slots] < 0).all(axis=1) & (holder[at] < 0)
            state, at, slots = left[free], at[free], slots[free]
            owner[slots], holder[at] = state[:, None], state  # of several that want a slot the last one has it
            won = (owner[slots] == state[:, None]).all(axis=1) & (holder[at] == state)
            for held, wanted, by in ((owner, slots[~won].ravel(), np.repeat(state[~won], d)), (holder, at[~won], state[~won])):
                held[wanted[held[wanted] == by]] = -1
            place[state[won]] = at[won]
            left = left[place[left] < 0]
    table = np.full(high + width, -1, np.int64)
    table[place[source] + symbol] = place[source] << 32 | place[target]
    return place, table


class Model:
    """Symbols by code point and, for each language, the transitions of its automaton.

    All are in one ``table``, see ``packed``; where it has no transition for a
    symbol, a new phrase begins, in the state ``begin[language, symbol]``.
    """

    def __init__(self, samples: dict[str, list[str]]):
        self.langs = sorted(samples)
        own = {x: {c for t in samples[x] for c in t.lower() if c.isalpha()} for x in self.langs}
        known = {c: k + 1 for k, c in enumerate(sorted(set().union(*own.values())))}
        # 0 parts words; the last symbol stands for letters that no sample has
        other = len(known) + 1
        self.symbols = np.zeros(0x110000, np.int32)
        for code in range(0x110000):
            c = chr(code)
            if c.isalpha():
                self.symbols[code] = known.get(c.lower()[0], other)
        self.begin = np.empty((len(self.langs), other + 1), np.int64)
        tables, self.roots, self.sizes, self.plain, first = [], [], [], [], 0
        for k, lang in enumerate(self.langs):
            text = np.concatenate([self.read(t) for t in samples[lang]] or [np.zeros(0, int)])
            move = automaton(text.tolist())
            place, table = packed(move, other + 1)
            if first + len(table) >= 1 << LACKS:
                raise ValueError("the labelled sample is too large; take fewer rows")
            table[table >= 0] += first << 32 | first
            self.begin[k] = first + place[0] | 1 << LACKS
            for c, t in move[0].items():
                self.begin[k, c] = first + place[t]
            tables.append(table)
            self.roots.append(first + place[0])
            self.sizes.append(len(text))
            self.plain.append(np.log2(len(own[lang]) + 1))
            first += len(table)
        self.table = np.concatenate(tables or [np.full(1, -1)])
        self.roots = np.array(self.roots, np.int64)

    def read(self, text: str) -> np.ndarray:
        """Symbols of a text, one zero between words and one after the last."""
        s = self.symbols[np.frombuffer((text + " ").encode("utf-32-le"), np.uint32)]
        return s[(s > 0) | (np.concatenate([[0], s[:-1]]) > 0)]

    def _step(self, state: np.ndarray, symbol: np.ndarray, begin: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The states after one more symbol, where a phrase ended before it, and how many did (two where the symbol is one of its own)."""
        word = self.table.take(state + symbol)
        broke = word >> 32 != state
        to = np.where(broke, begin, word & 0xFFFFFFFF)
        more = (to >> LACKS & (state != root)) + broke
        return to & (1 << LACKS) - 1, broke, more

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of every text (rows) in every language (columns)."""
        out, group, held = np.zeros((len(texts), len(self.langs)), np.int64), [], 0
        most = max(1, LANES // (SEGMENT * max(1, len(self.langs))))
        for k, t in enumerate(texts):
            group.append(k)
            held += -(-len(t) // SEGMENT)
            if held >= most or k == len(texts) - 1:
                self._parse(texts, group, out)
                group, held = [], 0
        return out

    def _parse(self, texts: list[np.ndarray], group: list[int], out: np.ndarray) -> None:
        parts = [(k, at) for k in group for at in range(0, len(texts[k]), SEGMENT)]
        if not parts or not self.langs:
            return
        size = lambda p: min(SEGMENT, len(texts[p[0]]) - p[1])
        parts.sort(key=lambda p: -size(p))
        lengths = np.array([size(p) for p in parts])
        grid = np.zeros((lengths[0], len(parts)), np.int32)
        for lane, (k, at) in enumerate(parts):
            grid[: lengths[lane], lane] = texts[k][at : at + SEGMENT]
        live = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
        # every segment on its own first, as if a phrase began with it
        root = self.roots[:, None]
        state = np.repeat(root, len(parts), axis=1)
        count = np.zeros(state.shape, np.int32)
        ends = np.zeros((lengths[0], *state.shape), bool)
        for t, n in enumerate(live):
            state[:, :n], ends[t, :, :n], more = self._step(state[:, :n], grid[t, :n], self.begin.take(grid[t, :n], axis=1), root)
            count[:, :n] += more
        # then the phrase that is open at each border goes on until it ends where one of the next segment's does; from there both agree
        lane_of = {p: lane for lane, p in enumerate(parts)}
        after = np.array([lane_of.get((k, at + SEGMENT), -1) for k, at in parts])
        last = state.copy()
        redo = [(lang, lane) for lane in np.flatnonzero(after >= 0) for lang in range(len(self.langs))]
        fixed = np.zeros(state.shape, np.int64)
        while redo:
            lang, before = np.array(redo).T
            lane, now = after[before], last[lang, before]
            counts, own = np.zeros(len(lane), np.int64), np.zeros(len(lane), np.int64)
            open_, t = np.arange(len(lane)), 0
            alone = self.roots[lang]
            while len(open_):
                done = lengths[lane[open_]] <= t
                if done.any():
                    open_ = open_[~done]
                    continue
                x, y = lang[open_], lane[open_]
                symbol = grid[t, y]
                begin = self.begin[x, symbol]
                now[open_], broke, more = self._step(now[open_], symbol, begin, self.roots[x])
                alone[open_], _, less = self._step(alone[open_], symbol, begin, self.roots[x])
                counts[open_] += more
                own[open_] += less
                met = broke & (ends[t, x, y] | (t == 0))
                open_ = open_[~met]
                t += 1
            fixed[lang, lane] = counts - own
            # a phrase that spans a whole segment changes the state in which the next one begins
            end = np.where(now != alone, now, state[lang, lane])
            moved = last[lang, lane] != end
            last[lang, lane] = end
            redo = [(a, b) for a, b, m in zip(lang, lane, moved) if m and after[b] >= 0]
        count = count + fixed
        closing = np.array([after[lane] < 0 for lane in range(len(parts))])
        count += (last != root) & closing
        np.add.at(out, [k for k, _ in parts], count.T)

    def parsed(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """For each text the language of fewest phrases, its score, and whether it parses better than letter by letter."""
        read = [self.read(t or "") for t in texts]
        counts = self.phrases(read)
        langs, scores, fits = [], np.zeros(len(texts)), np.zeros(len(texts), bool)
        for k, (c, t) in enumerate(zip(counts, read)):
            if not len(t) or not self.langs:
                langs.append(UNKNOWN)
                continue
            first, *others = np.argsort(c, kind="stable")
            langs.append(self.langs[first])
            # how far the runner-up is behind
            scores[k] = 1 - c[first] / c[others[0]] if others else 1.0
            fits[k] = (c[first] - SLACK) * np.log2(max(2, self.sizes[first])) <= len(t) * self.plain[first]
        return langs, scores, fits


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from about ``sample_rows`` labelled rows of each language, chosen by their hash.

    A row is a text, or of a longer one PASSAGE characters: texts are cut into such
    rows from beginning to end, and every row has the same chance; equal ones count
    once. What is chosen is learnt whole, with all its letters. Rows without id, text or
    language are not used. A language's automaton has at most 2 states and 3
    transitions for each learnt character, a packed transition some 20 to 100 bytes.
    """
    rows = labelled.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).dropna()
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PASSAGE}}}"), F.lit(0))
    rows = rows.select("lang", F.explode_outer(pieces).alias("text")).select("lang", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    place, keep = F.pmod("h", F.lit(1 << 30)), F.lit(False)
    for lang, n in sizes.items():
        keep = keep | ((F.col("lang") == lang) & (place < int(min(1.0, sample_rows / max(1, n)) * (1 << 30))))
    sample = rows.where(keep).distinct()
    samples: dict[str, list[str]] = {lang: [] for lang in sizes}
    for r in sorted(sample.collect(), key=lambda r: (r["lang"], r["h"], r["text"])):
        samples[r["lang"]].append(r["text"])
    return Model(samples)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score)`` for every row: the language of its whole text; ids are cast to long.

    ``und``, with score 0, if the text is null, has no letter, or the model has no language.
    Else the score is the share by which the runner-up needs more phrases, from 0
    to 1, and 1 if there is none; of equals the first by name wins. Repeated rows
    and null ids come out as they are, an empty table gives an empty one, other
    columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in slices(batch, limit=1 << 21)):
            langs, scores, _ = shared.value.parsed(b.column(1).to_pylist())
            yield pa.record_batch([b.column(0), pa.array(langs, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    both = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return both.mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose text a language of the model explains, with that language as ``lang`` where it is null.

    Texts without letters go, and those for which even the best language needs
    more bits, log2 of its labelled text for each phrase, than the letters do one
    by one, all alike: strings of chance letters or of a script that no labelled text has.
    SLACK phrases are free, so that a text of a few words stays. Without any
    labelled text nothing is explained and no row stays. Columns are those of ``docs``; it
    needs no ``lang``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    lang = docs.columns.index("lang") if "lang" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in slices(batch, at, 1 << 21)):
            langs, _, fits = shared.value.parsed(b.column(at).to_pylist())
            if lang is not None:
                b = b.set_column(lang, b.schema.field(lang), pc.coalesce(b.column(lang), pa.array(langs, pa.string()).cast(b.schema.field(lang).type)))
            yield b.filter(pa.array(fits, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
