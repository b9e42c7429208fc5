"""Language-model scoring with a Brown class-based bigram model.

log10 P(text) = sum over tokens of log10 P(class | class before) + log10 P(word | class); a
text's last token is its end, and its first follows an end.

*Classes* come from exchange clustering: a word moves to the class that raises the likelihood
of the class bigrams most, until none moves. It is done in two steps.

1. *Seeds.* The SEEDS most frequent words, and ENDINGS that stand for all other words (three bytes if the
   ending is one of the most frequent, else the last byte), are clustered one by one on their bigram matrix, which has
   a fixed size and is counted over the whole training corpus.
2. *All frequent words.* Every word that makes up SHARE of the training tokens or more (at most
   1 / SHARE words, whatever the corpus) starts in the class of its seed or ending. Its neighbours' classes on both
   sides are counted over the corpus into a table, a row per word. Then words move in batches against the
   class-by-class matrices: tasks move their words one by one, the driver keeps the matrices and one class per word. A batch
   that would lower the likelihood is halved.

Rare and unknown words keep the class of their ending.

*Emission* is P(symbol | class) P(word | symbol). Within an ending, known words share
by their counts plus one and all unknown words together count as one more: (c + 1) / (N + V + 1).

Counts of all words stay a Spark table. The HEAD most frequent words at most are looked up inside the tasks,
the rest by a join on the word's 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietlog.llm import tokens
from quietlog.session import cut

CLASSES = 64
SEEDS = 768
ENDINGS = 256
# Words of this share of all training tokens, and seen LEAST_SEEN times, are clustered.
SHARE = 1e-6
LEAST_SEEN = 20
HEAD = 200_000
# Far above what was ever seen to be needed; both loops end when no word moves.
MOST_SWEEPS = 1_000
BATCHES = 1
# Words that one task exchanges; at most 1 / SHARE / TASK_WORDS tasks.
TASK_WORDS = 30_000
FOLDS, HELD_FOLD = 7, 2
_BETA, _GAMMA = 0.5, 0.5
_END_WORD = -1  # hash under which text ends are counted
# Distinct keys that a task counts before it hands them on.
TALLY = 1 << 20


def held_out(doc_id: Column) -> Column:
    """True if crc32 of the id's text mod 7 is 2. A null id counts as the empty text: False."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_FOLD


def _endings(piece: tokens.Texts, at: np.ndarray | slice = slice(None)) -> np.ndarray:
    """The last three bytes of the words at these places as a number."""
    data, ends = piece.data, piece.ends[at]
    size = ends - piece.starts[at]
    out = data[ends - 1].astype(np.int64)
    out = out + np.where(size > 1, data[ends - 2].astype(np.int64) << 8, 0)
    return out + np.where(size > 2, data[ends - 3].astype(np.int64) << 16, 0)


def _distinct(piece: tokens.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the distinct words, the place of one of each, the distinct word at every place)."""
    words, found = pd.factorize(piece.hashes().view(np.int64))
    at = np.empty(len(found), np.int64)
    at[words] = np.arange(len(words))
    return found, at, words


def _merged(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """(keys, counts, anything that goes with the key) with every key once."""
    keys, counts, *more = (np.concatenate(x) for x in zip(*held))
    codes, found = pd.factorize(keys)
    at = np.empty(len(found), np.int64)
    at[codes] = np.arange(len(codes))
    return found, np.bincount(codes, counts, len(found)).astype(np.int64), *(x[at] for x in more)


def _tallied(parts: Iterator[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
    """Parts (keys, counts, ...) added up before they leave the task, about TALLY keys at a time."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size > TALLY:
            held = [_merged(held)]
            size = len(held[0][0])
            if size > TALLY // 2:
                yield held[0]
                held, size = [], 0
    if size:
        yield _merged(held)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(words, endings, n):
        return pa.RecordBatch.from_arrays(
            [pa.array(words, pa.int64()), pa.array(endings, pa.int32()), pa.array(n, pa.int64())], names=["word", "ending", "n"]
        )

    def parts():
        for batch in batches:
            yield np.array([_END_WORD]), np.array([batch.num_rows]), np.array([-1])
            for piece in tokens.words(batch.column("text"), lower=True):
                found, at, words = _distinct(piece)
                yield found, np.bincount(words, minlength=len(found)), _endings(piece, at)

    for words, n, endings in _tallied(parts()):
        yield rows(words, endings, n)


@dataclass
class Symbols:
    """Word to symbol: 0 text end, then last bytes, endings, and words of their own."""

    words: np.ndarray    # sorted hashes of the vocabulary
    endings: np.ndarray  # frequent endings, sorted

    @property
    def size(self) -> int:
        return 257 + len(self.endings) + len(self.words)

    def of(self, hashes: np.ndarray, endings: np.ndarray) -> np.ndarray:
        out = 1 + (endings & 0xFF)
        for table, values, base in ((self.endings, endings, 257), (self.words, hashes, 257 + len(self.endings))):
            if len(table):
                at = np.minimum(np.searchsorted(table, values), len(table) - 1)
                out = np.where(table[at] == values, base + at, out)
        return out

    def of_words(self, piece: tokens.Texts) -> np.ndarray:
        """Symbol of every word; each distinct word is looked up once."""
        found, at, words = _distinct(piece)
        return self.of(found, _endings(piece, at))[words]


def _with_ends(piece: tokens.Texts, values: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(values with one more for every text's end, places of the ends)."""
    ends = piece.first[1:] + np.arange(len(piece.first) - 1)
    out = np.full(len(values) + len(ends), end, values.dtype)
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner] = values
    return out, ends


def _before(symbols: np.ndarray) -> np.ndarray:
    """The symbol before each one; texts follow one another, so an end stands before each."""
    return np.concatenate([[0], symbols[:-1]]).astype(symbols.dtype)


def _count_pairs(symbols: Symbols):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = symbols.size
        counts = np.zeros(size * size, np.int64)
        for batch in batches:
            for piece in tokens.words(batch.column("text"), lower=True):
                ids, _ = _with_ends(piece, symbols.of_words(piece), 0)
                codes, pairs = pd.factorize(_before(ids) * size + ids)
                counts[pairs] += np.bincount(codes, minlength=len(pairs))
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], names=["pair", "n"])

    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = MOST_SWEEPS) -> np.ndarray:
    """Class of every symbol. Symbol 0 has class 0 to itself.

    Starts with symbols dealt to classes by falling frequency; every sweep takes each symbol out
    and puts it where the class bigrams' log-likelihood is highest (ties: the lowest class).
    """
    size = len(pairs)
    pairs = pairs.astype(float)
    weight = pairs.sum(axis=0) + pairs.sum(axis=1)
    order = [s for s in np.lexsort((np.arange(size), -weight)).tolist() if s]
    own = np.zeros(size, np.int64)
    for rank, s in enumerate(order):
        own[s] = 1 + rank % (classes - 1)
    table = np.zeros((classes, classes))
    np.add.at(table, (own[:, None], own[None, :]), pairs)
    for _ in range(sweeps):
        moved = 0
        for s in order:
            if not weight[s]:
                continue
            old, loop = own[s], pairs[s, s]
            right = np.bincount(own, pairs[s], classes)
            left = np.bincount(own, pairs[:, s], classes)
            right[old] -= loop
            left[old] -= loop
            table[old] -= right
            table[:, old] -= left
            table[old, old] -= loop
            # what row k, column k and the two marginals gain if s joins class k
            gain = (_xlogx(table + right[None, :]) - _xlogx(table)).sum(axis=1)
            gain += (_xlogx(table + left[:, None]) - _xlogx(table)).sum(axis=0)
            diagonal = np.diag(table)
            gain += (_xlogx(diagonal + right + left + loop) - _xlogx(diagonal + right) - _xlogx(diagonal + left) + _xlogx(diagonal))
            rows, columns = table.sum(axis=1), table.sum(axis=0)
            gain -= _xlogx(rows + left + right.sum() + loop) - _xlogx(rows + left)
            gain -= _xlogx(columns + right + left.sum() + loop) - _xlogx(columns + right)
            # the marginals of the classes beside s change as well, but alike for every k
            gain[0] = -np.inf
            new = int(np.argmax(gain))
            if gain[new] <= gain[old] + 1e-9:
                new = old
            table[new] += right
            table[:, new] += left
            table[new, new] += loop
            own[s] = new
            moved += new != old
        if not moved:
            break
    return own


# ---- all frequent words --------------------------------------------------------------


def _count_neighbours(symbols: Symbols, classes: np.ndarray, k: int):
    """(word, cell, n) for words of the vocabulary: cell c after a word, cell k + c before it, c the neighbour's class."""

    base = symbols.size - len(symbols.words)

    def parts(batches):
        for batch in batches:
            for piece in tokens.words(batch.column("text"), lower=True):
                ids, _ = _with_ends(piece, symbols.of_words(piece), 0)
                own, before = classes[ids], _before(ids)
                here, behind = ids >= base, before >= base
                codes, found = pd.factorize(np.concatenate([
                    (ids[here] - base) * (2 * k) + k + classes[before[here]], (before[behind] - base) * (2 * k) + own[behind]
                ]))
                yield found, np.bincount(codes, minlength=len(found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, n in _tallied(parts(batches)):
            yield pa.RecordBatch.from_arrays(
                [pa.array(found // (2 * k)), pa.array((found % (2 * k)).astype(np.int32)), pa.array(n)], names=["word", "cell", "n"]
            )

    return run


class ClassTables:
    """Counts of (class of a word, class of its neighbour) on both sides, one matrix of classes x 2 classes."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts.astype(float)
        k = self.counts.shape[0]
        self.sums = np.stack([self.counts[:, :k].sum(axis=1), self.counts[:, k:].sum(axis=1)])
        self.logs, self.log_sums = _xlogx(self.counts), _xlogx(self.sums)

    def likelihood(self) -> float:
        return float(self.logs.sum() - self.log_sums.sum())

    def best(self, row: np.ndarray, old: int) -> int:
        """The class that a word with these counts should have; class 0, the text ends', takes no word."""
        k = self.counts.shape[0]
        size = np.array([row[:k].sum(), row[k:].sum()])
        cells = np.flatnonzero(row)  # no other cell changes
        count = row[cells]
        lost = _xlogx(self.counts[old, cells] - count).sum() - self.logs[old, cells].sum()
        lost -= (_xlogx(self.sums[:, old] - size) - self.log_sums[:, old]).sum()
        joined = (_xlogx(self.counts[:, cells] + count) - self.logs[:, cells]).sum(axis=1)
        joined -= (_xlogx(self.sums + size[:, None]) - self.log_sums).sum(axis=0)
        joined[[0, old]] = -np.inf
        new = int(np.argmax(joined))
        return new if joined[new] + lost > 1e-6 else old

    def move(self, row: np.ndarray, old: int, new: int) -> None:
        k = self.counts.shape[0]
        for c, sign in ((old, -1), (new, 1)):
            self.counts[c] += sign * row
            self.sums[:, c] += sign * row[:k].sum(), sign * row[k:].sum()
            self.logs[c], self.log_sums[:, c] = _xlogx(self.counts[c]), _xlogx(self.sums[:, c])


def _vectors(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(words, a row of 2k counts per word)."""
    cells = batch.column("cells")
    rows = np.zeros((batch.num_rows, 2 * k))
    row = np.repeat(np.arange(batch.num_rows), np.diff(cells.offsets.to_numpy()))
    flat = cells.flatten()
    rows[row, flat.field("cell").to_numpy()] = flat.field("n").to_numpy()
    return batch.column("word").to_numpy(), rows


def _moves(classes: np.ndarray, counts: np.ndarray | None, batch_of: tuple[int, int], k: int, sweeps: int):
    """Rows (word, class, cell, n): moves of the words of a batch, and what they add to the matrix.

    A task moves its words one after another, `sweeps` times or until none of them gains. Without counts, what
    all words add in the classes they have.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = np.zeros((k, 2 * k))
        parts = [_vectors(batch, k) for batch in batches if batch.num_rows]  # about TASK_WORDS words
        if parts and counts is None:
            for words, rows in parts:
                np.add.at(change, classes[words], rows)
        elif parts:
            words, rows = (np.concatenate(x) for x in zip(*parts))
            mine = tokens.mix(words.astype(np.uint64)) % np.uint64(batch_of[1]) == batch_of[0]
            words, rows = words[mine], rows[mine]
            tables, own = ClassTables(counts), classes[words]
            for _ in range(sweeps):
                moved = False
                for i, row in enumerate(rows):
                    new = tables.best(row, own[i])
                    if new != own[i]:
                        tables.move(row, own[i], new)
                        own[i], moved = new, True
                if not moved:
                    break
            moved = own != classes[words]
            np.add.at(change, own[moved], rows[moved])
            np.add.at(change, classes[words[moved]], -rows[moved])
            if moved.any():
                yield _move_rows(words[moved], own[moved], None, None)
        cells = np.flatnonzero(change)
        yield _move_rows(None, None, cells, change.ravel()[cells])

    return run


def _move_rows(words, classes, cells, numbers) -> pa.RecordBatch:
    n = len(words) if words is not None else len(cells)
    columns = [pa.nulls(n, t) if x is None else pa.array(x, t) for x, t in (
        (words, pa.int64()), (classes, pa.int32()), (cells, pa.int32()), (numbers, pa.float64()))]
    return pa.RecordBatch.from_arrays(columns, names=["word", "class", "cell", "n"])


def exchange_words(vectors: DataFrame, classes: np.ndarray, k: int = CLASSES, batches: int = BATCHES) -> np.ndarray:
    """Class of every word of the vocabulary, from its neighbours' classes (word, cells).

    One task goes on until no word gains. Several tasks move their words once each as if those of the others
    stayed; if all together they would lower the likelihood, the words are cut into smaller batches by hash.
    Ends when no word moves.
    """
    classes = classes.copy()
    tasks = -(-len(classes) // TASK_WORDS)

    def ask(counts: np.ndarray | None, batch_of: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        # moves of a batch (at most 1 / SHARE words) and at most 2 * k * k cells
        # at most 1 / SHARE moves, and 2 * k * k cells from each of a few tasks
        found = vectors.mapInArrow(_moves(classes, counts, batch_of, k, MOST_SWEEPS if tasks == 1 else 1), "word long, class int, cell int, n double").toArrow()
        is_move = found["word"].is_valid()
        moves, cells = found.filter(is_move), found.filter(pc.invert(is_move))
        change = np.bincount(cells["cell"].to_numpy(), cells["n"].to_numpy(), 2 * k * k)
        return moves["word"].to_numpy(), moves["class"].to_numpy(), change.reshape(k, 2 * k)

    vectors = vectors.coalesce(tasks)
    tables = ClassTables(ask(None, (0, 1))[2])
    for _ in range(MOST_SWEEPS):
        moved, queue = 0, [(i, batches) for i in range(batches)]
        while queue:
            number, of = queue.pop(0)
            words, new, change = ask(tables.counts, (number, of))
            after = ClassTables(tables.counts + change)
            if len(words) > 1 and after.likelihood() <= tables.likelihood() + 1e-6:
                queue[:0] = [(number, 2 * of), (number + of, 2 * of)]
            elif len(words) and after.likelihood() > tables.likelihood():
                classes[words], tables, moved = new, after, moved + len(words)
        if not moved:
            break
    return classes


def _count_classes(symbols: Symbols, classes: np.ndarray, k: int):
    """(pair, n): class bigrams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(k * k, np.int64)
        for batch in batches:
            for piece in tokens.words(batch.column("text"), lower=True):
                ids, _ = _with_ends(piece, symbols.of_words(piece), 0)
                own = classes[ids]
                counts += np.bincount(_before(own) * k + own, minlength=k * k)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(counts)], names=["pair", "n"])

    return run


@dataclass
class Model:
    symbols: Symbols
    classes: np.ndarray      # by symbol
    transition: np.ndarray   # log10 P(class | class before)
    emission: np.ndarray     # log10 P(symbol | class of symbol), by symbol
    share: np.ndarray        # log10 1 / (N + V + 1) within an ending, 0 for words of their own
    head_words: np.ndarray   # sorted hashes
    head_counts: np.ndarray
    n_tokens: int
    n_types: int
    n_texts: int

    @property
    def base_unit(self) -> float:
        return float(np.log10(self.n_tokens + self.n_types + 1))


def _columns(df: DataFrame) -> tuple[np.ndarray, ...]:
    """Columns of a bounded table as arrays, without a Python object per row."""
    return tuple(c.to_numpy().astype(np.int64) for c in df.toArrow().columns)


def _least_count(words: DataFrame, head: int) -> int:
    """A count that at most `head` words reach, from a histogram with eight bins per octave.

    Sorting for the first `head` words would take that many rows of every partition to one task.
    """
    bins = words.groupBy(F.floor(8 * F.log2("n")).alias("bin")).agg(F.count(F.lit(1)).alias("types"), F.min("n").alias("n"))
    least, total = 1 << 62, 0
    for row in sorted(bins.collect(), key=lambda r: -r["bin"]):
        total += row["types"]
        if total > head:
            break
        least = row["n"]
    return least


def _masses(by_ending: DataFrame, symbols: Symbols, listed: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, tokens and types) of every symbol that stands for words without one of their own."""
    count, mass = np.zeros(symbols.size), np.zeros(symbols.size)
    frequent = by_ending.where(F.col("ending").isin(listed)).collect()
    rest = by_ending.where(~F.col("ending").isin(listed)).groupBy(F.col("ending").bitwiseAND(0xFF).alias("last")).agg(
        F.sum("n").alias("n"), F.sum("types").alias("types")
    ).collect()
    places = [257 + int(np.searchsorted(symbols.endings, r["ending"])) for r in frequent] + [1 + r["last"] for r in rest]
    for place, r in zip(places, [*frequent, *rest]):
        count[place], mass[place] = r["n"], r["n"] + r["types"]
    return count, mass


def fit(training: DataFrame, classes: int = CLASSES, seeds: int = SEEDS, endings: int = ENDINGS, head: int = HEAD,
        share: float = SHARE, least_seen: int = LEAST_SEEN, cluster: bool = True) -> tuple[Model, DataFrame]:
    """(model, counts): counts is the table (word, n) of all training words by hash.

    Without `cluster` the frequent words stay in the classes they start in, for comparison.
    """
    counts = cut(
        training.select("text").mapInArrow(_count_words, "word long, ending int, n long")
        .groupBy("word").agg(F.first("ending").alias("ending"), F.sum("n").alias("n")),
        "words",
    )
    totals = counts.where("n > 0").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("types"),
        F.coalesce(F.sum(F.when(F.col("word") == _END_WORD, F.col("n"))), F.lit(0)).alias("texts"),
    ).first()
    words = counts.where(F.col("word") != _END_WORD)
    top_words, top_counts = _columns(words.where(F.col("n") >= _least_count(words, head)).select("word", "n"))
    least = max(least_seen, int(np.ceil(share * int(totals["tokens"]))))
    # at most 1 / share words, as each is that share of all tokens
    own_words, own_counts, own_endings = _columns(words.where(F.col("n") >= least).select("word", "n", "ending"))
    order = np.argsort(own_words)
    own_words, own_counts, own_endings = own_words[order], own_counts[order], own_endings[order]

    def by_ending(rows: DataFrame) -> DataFrame:
        return cut(rows.groupBy("ending").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types")), "endings")

    seed_places = np.lexsort((own_words, -own_counts))[:seeds]
    seed_words = np.sort(own_words[seed_places])
    # at most `seeds` rows
    listed = F.broadcast(training.sparkSession.createDataFrame([(int(w),) for w in seed_words], "word long"))
    other = by_ending(words.join(listed, "word", "left_anti"))
    frequent = [r["ending"] for r in other.orderBy(F.col("n").desc(), "ending").limit(endings).collect()]
    seeded = Symbols(seed_words, np.sort(np.array(frequent, np.int64)))
    text = training.select("text")
    # at most seeded.size ** 2 rows
    places, numbers = _columns(text.mapInArrow(_count_pairs(seeded), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    pairs = np.zeros(seeded.size ** 2)
    pairs[places] = numbers
    of_seeds = exchange(pairs.reshape(seeded.size, seeded.size), classes)

    symbols = Symbols(own_words, seeded.endings)
    own_class = np.concatenate([of_seeds[:257 + len(frequent)], of_seeds[seeded.of(own_words, own_endings)]])
    if cluster and len(own_words):
        neighbours = text.mapInArrow(_count_neighbours(symbols, own_class, classes), "word long, cell int, n long")
        table = cut(neighbours.groupBy("word", "cell").agg(F.sum("n").alias("n")).groupBy("word").agg(
            F.collect_list(F.struct("cell", "n")).alias("cells")  # at most two cells per class
        ), "neighbours")
        base = symbols.size - len(own_words)
        own_class[base:] = exchange_words(table, own_class[base:], classes)

    count, mass = _masses(by_ending(words.where(F.col("n") < least)), symbols, frequent)
    word_share = -np.log10(mass + 1)
    word_share[0] = 0
    word_share[257 + len(symbols.endings):] = 0
    count[0] = totals["texts"]
    count[257 + len(symbols.endings):] = own_counts
    # classes ** 2 rows
    places, numbers = _columns(
        text.mapInArrow(_count_classes(symbols, own_class, classes), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    )
    bigrams = np.zeros(classes ** 2)
    bigrams[places] = numbers
    bigrams = bigrams.reshape(classes, classes)
    transition = np.log10((bigrams + _BETA) / (bigrams.sum(axis=1, keepdims=True) + _BETA * classes))
    seen = count + _GAMMA
    emission = np.log10(seen / np.bincount(own_class, seen, classes)[own_class])
    order = np.argsort(top_words)
    return Model(
        symbols, own_class, transition, emission, word_share, top_words[order], top_counts[order], int(totals["tokens"]), int(totals["types"]), int(totals["texts"]),
    ), counts.select("word", "n")


def _score(model: Model):
    """Rows of two kinds: one per text with what its frequent words give (`text` set), and
    one per word that must be looked up in the table of counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_head = np.log10(model.head_counts + 1.0)
        log_end = float(np.log10(model.n_texts + 1.0))
        kind = pa.struct([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            doc_ids = batch.column("doc_id")
            for piece in tokens.words(batch.column("text"), lower=True):
                n = len(piece.first) - 1
                hashes, at, words = _distinct(piece)
                ids, ends = _with_ends(piece, model.symbols.of(hashes, _endings(piece, at))[words], 0)
                text = np.repeat(np.arange(n), np.diff(piece.first) + 1)
                classes = model.classes[ids]
                gain = model.transition[model.classes[_before(ids)], classes] + model.emission[ids] + model.share[ids]
                if len(model.head_words):
                    at = np.minimum(np.searchsorted(model.head_words, hashes), len(model.head_words) - 1)
                    in_head = model.head_words[at] == hashes
                    logs = np.where(in_head, log_head[at], 0.0)
                else:
                    in_head, logs = np.zeros(len(hashes), bool), np.zeros(len(hashes))
                hashes, in_head, logs = hashes[words], in_head[words], logs[words]
                owner = piece.owner()
                shared = ids[np.delete(np.arange(len(ids)), ends)] < 257 + len(model.symbols.endings)
                score = np.bincount(text, gain, n) + np.bincount(owner, logs * shared, n)
                base = np.bincount(owner, logs, n) + log_end
                known = np.bincount(owner, in_head, n).astype(np.int64) + (model.n_texts > 0)
                rows = keys[piece.rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tokens.mix(rows.astype(np.uint64)).view(np.int64)), pa.array(rows),
                     pa.StructArray.from_arrays(
                         [doc_ids[piece.rows], pa.array(np.diff(piece.first) + 1), pa.array(known), pa.array(base), pa.array(score)], fields=list(kind))],
                    names=["word", "key", "text"],
                )
                rare = np.flatnonzero(~in_head)
                if len(rare):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(hashes[rare]), pa.array(rows[owner[rare]]), pa.nulls(len(rare), kind)], names=["word", "key", "text"]
                    )

    return run


def score(documents: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Null and empty texts are one token, the end. Repeated rows: one result each. Without any training
    text all words are unknown. Empty table: no rows.
    """
    keyed = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("key"))
    rows = keyed.mapInArrow(
        _score(model), "word long, key long, text struct<doc_id: bigint, n_tokens: bigint, n_known: bigint, base: double, score: double>"
    )
    rare = F.when(F.col("text").isNull(), F.log10(F.col("n") + 1.0))
    per_text = rows.join(counts, "word", "left").groupBy("key").agg(
        F.max("text.doc_id").alias("doc_id"), F.sum("text.n_tokens").alias("n_tokens"),
        (F.sum("text.n_known") + F.count(rare)).alias("n_known"),
        F.sum(F.coalesce("text.base", rare)).alias("base"), F.sum(F.coalesce("text.score", rare)).alias("score"),
    )
    return per_text.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.n_tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(model.base_unit)).alias("base_score"), "score",
    )


def score_documents(documents: DataFrame) -> DataFrame:
    """All of `documents`, scored by the model of those that are not held out."""
    model, counts = fit(documents.where(~held_out(F.col("doc_id"))))
    return score(documents, model, counts)
