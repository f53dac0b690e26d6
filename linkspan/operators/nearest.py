"""Scores of sparse vectors in numpy, for one part of a block's left rows and one of its right rows.

`best` finds each left row's k best right rows without scoring all of them. A vector's
cells go from the rarest term to the most frequent one; what a pair scores is at most
the product of both vectors' lengths from their first common term on. So the postings
of a term are sorted by that length of the right rows, and only those that can still
beat the k-th best score found so far are read and scored exactly: those of rare terms
pair by pair, then those of a term with many pairs as one product of the left rows that
have it with its postings. A left row whose postings are too many is scored against all
right rows instead. The result is that of scoring all pairs.

In a product, terms that many right rows have are a dense matrix that is multiplied with
the left rows', the postings of the others are added. `totals` scores by products every pair
that can reach the threshold: see `_All`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Steps of a vector's length in the postings' order.
LEVELS = 1 << 20
#: Numbers in the matrix of a batch of left rows, and pairs scored at a time.
CELLS, PAIRS = 1 << 21, 1 << 14
#: A left row meets all right rows where one in SHARE of them would have to be scored.
SHARE = 8
#: Left rows that share a term are scored together if they have more than GROUP pairs.
GROUP = 1 << 12
#: What rounding may take from a score or a bound.
SLACK = 2e-6
#: A term is dense if one in DENSE right rows has it; at most MOST_DENSE are.
DENSE, MOST_DENSE = 16, 64
#: Right rows and scores held at a time.
SLICE, SCORES = 1 << 14, 1 << 19
#: Left rows of a group; rows that are looked at to choose the common terms, of which there are
#: at most MOST_COMMON, each in one row in RARE; below what no score of a pair can be raised.
ROWS, SEEN, MOST_COMMON, RARE, FAR = 256, 1 << 14, 512, 64, 1e9
#: Classes of right rows by the weight of their most frequent term, in steps of 10 %.
SCALES = 12
#: Right rows and scores held at a time where all pairs of two groups are scored.
NARROW, NEAR = 1 << 12, 1 << 16
#: A term's pairs up to SMALL aren't looked through for those without a chance.
SMALL = 1 << 19
#: Pairs that could be scored in the time that one more product takes.
SETUP = 1 << 16


class Vectors:
    """The rows of a table (terms: numbers that rise with rarity, weights), cells from the
    rarest term on; terms are places in known, others are left out."""

    def __init__(self, table: pa.Table, known: np.ndarray | None = None):
        lists = table["terms"].combine_chunks()
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        term = lists.flatten().to_numpy(zero_copy_only=False)
        weight = table["weights"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        numbers = 1 + max(term.max(initial=0), 0 if known is None else known.max(initial=0))
        if known is None:
            there = np.zeros(numbers, dtype=bool)
            there[term] = True
            known = np.flatnonzero(there)
        self.known, places = known, np.full(numbers, -1, dtype=np.int32)
        places[known] = np.arange(len(known))
        place = places[term]
        if (place < 0).any():
            row, place, weight = row[place >= 0], place[place >= 0], weight[place >= 0]
        if ((place[1:] > place[:-1]) & (row[1:] == row[:-1])).any():
            order = np.argsort((row.astype(np.int64) << 32) - place)
            row, place, weight = row[order], place[order], weight[order]
        self.n, self.row, self.term, self.weight = len(sizes), row, place, weight
        self.sizes = np.bincount(self.row, minlength=self.n)
        self.starts = np.r_[0, np.cumsum(self.sizes)]

    def rest(self) -> np.ndarray:
        """For each cell the length of its vector from there on, or a little more."""
        squares = self.weight * self.weight
        sums = np.r_[0.0, np.cumsum(squares)]
        return np.sqrt(np.maximum(0.0, sums[self.starts[1:]][self.row] - sums[:-1]) + 1e-9)


def _order(key: np.ndarray) -> np.ndarray:
    """argsort of numbers from 0 on; where there is room, they are sorted with their places."""
    room = len(key).bit_length()
    if int(key.max(initial=0)).bit_length() + room > 63:
        return np.argsort(key)
    return np.sort(key << room | np.arange(len(key))) & ((1 << room) - 1)


class Index:
    """Right vectors and the postings of each term, longest rest first."""

    def __init__(self, vectors: Vectors):
        self.rows, rest = vectors, vectors.rest()
        self.top = float(rest.max(initial=1e-9))
        key = vectors.term.astype(np.int64) * (LEVELS + 1) + (LEVELS - np.minimum(np.ceil(rest / self.top * LEVELS), LEVELS).astype(np.int64))
        order = _order(key)
        self.keys, self.owner, self.weight = key[order], vectors.row[order], vectors.weight[order]
        self.starts = np.searchsorted(self.keys, np.arange(len(vectors.known) + 1) * (LEVELS + 1))

    def ends(self, term: np.ndarray, need: np.ndarray) -> np.ndarray:
        """The end of the postings whose rest is need or more."""
        level = np.clip(np.floor(need / self.top * LEVELS), 0, LEVELS + 1).astype(np.int64)
        return np.searchsorted(self.keys, term.astype(np.int64) * (LEVELS + 1) + (LEVELS - level), side="right")


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[k], starts[k] + 1, ... of all k, sizes[k] of each."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


class _Best:
    """The best right rows of each left row so far."""

    def __init__(self, n: int, places: np.ndarray, k: int, threshold: float):
        self.places, self.k, self.threshold = places, k, threshold
        self.least = np.full(n, threshold - SLACK)  # a pair below can't be among the best
        self.scores, self.totals = np.full((n, k), -np.inf), np.zeros((n, k))
        self.found = np.full((n, k), -1, dtype=np.int64)
        self.done = np.zeros(n, dtype=bool)  # those that met all right rows

    def add(self, row: np.ndarray, other: np.ndarray, total: np.ndarray, again: bool) -> None:
        """Pairs go in; again: some may be there already."""
        have = np.unique(row)
        old, rank = np.nonzero(self.found[have] >= 0)
        rows = np.r_[have[old], row]
        found, totals = np.r_[self.found[have[old], rank], other], np.r_[self.totals[have[old], rank], total]
        if again:
            once = np.unique(rows * len(self.places) + found, return_index=True)[1]
            rows, found, totals = rows[once], found[once], totals[once]
        scores = np.round(totals, 6)
        order = np.lexsort((self.places[found], -scores, rows))
        rows = rows[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep, order = rank < self.k, order[rank < self.k]
        rows, rank = rows[keep], rank[keep]
        self.found[rows, rank], self.totals[rows, rank], self.scores[rows, rank] = found[order], totals[order], scores[order]
        self.least[have] = np.maximum(self.threshold, self.scores[have, -1]) - SLACK

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, rank = np.nonzero(self.found >= 0)
        return row, self.found[row, rank], self.totals[row, rank]


class _Search:
    """The best right rows of a part's left rows."""

    def __init__(self, left: Vectors, index: Index, best: _Best, share: int, group: int):
        self.left, self.rest, self.index, self.best, self.share = left, left.rest(), index, best, share
        terms = len(index.rows.known)
        self.place = np.zeros(terms, dtype=np.int32)  # of a term among those of some left rows
        self.grouped = np.bincount(left.term, minlength=terms) * np.diff(index.starts) > group

    def run(self) -> None:
        left, first = self.left, 0
        while first < left.n:
            sizes = left.starts[first + 1 : first + 4097] - left.starts[first]
            last = first + max(1, int(np.searchsorted(np.arange(1, len(sizes) + 1) * (sizes + 1), CELLS)))
            _Batch(self, first, last).run()
            first = last
        cells = np.flatnonzero(self.grouped[left.term])
        cells = cells[np.argsort(-left.term[cells], kind="stable")]
        for own in np.split(cells, np.flatnonzero(np.diff(left.term[cells])) + 1):
            if len(own):
                self.together(own)

    def reached(self, rows: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first of the postings that rows have to read for their cells, and how many;
        rows with too many meet all right rows instead."""
        term = self.left.term[cells]
        start, end = self.index.starts[term], self.index.ends(term, self.best.least[rows] / self.rest[cells])
        many = np.maximum(end - start, 0)
        whole = many * self.share > self.index.rows.n
        for row in rows[whole]:
            self.all_of(int(row))
        return start, np.where(whole, 0, many)

    def together(self, cells: np.ndarray) -> None:
        """Score all left rows that have a term (cells: one of each row) against its postings."""
        left, right, best = self.left, self.index.rows, self.best
        rows = left.row[cells].astype(np.int64)
        rows, cells = rows[~best.done[rows]], cells[~best.done[rows]]
        start, many = self.reached(rows, cells)
        rows, many = rows[many > 0], many[many > 0]
        if not len(rows):
            return
        others = self.index.owner[start[0] : start[0] + many.max()].astype(np.int64)
        row, term, own = self.cells(left, rows)
        used = np.unique(term)
        self.place[used] = np.arange(1, len(used) + 1)
        column, theirs, weight = self.cells(right, others)
        theirs = self.place[theirs] - 1
        column, theirs, weight = column[theirs >= 0], theirs[theirs >= 0], weight[theirs >= 0]
        term = self.place[term] - 1
        self.place[used] = 0
        product = _Product(column, theirs, weight, len(others), len(used))
        step = max(1, SCORES // len(others))
        starts = np.searchsorted(row, np.arange(len(rows) + 1))
        for first in range(0, len(rows), step):
            last = min(len(rows), first + step)
            some = slice(starts[first], starts[last])
            scores = product.of(row[some] - first, term[some], own[some], last - first)
            least = best.least[rows[first:last]]
            hit = scores >= least[:, None]
            if best.k < len(others) and hit.sum() > 4 * best.k * len(least):
                hit = scores >= np.maximum(least, np.partition(scores, -best.k, axis=1)[:, -best.k] - SLACK)[:, None]
            line, at = np.nonzero(hit)
            if len(line):
                best.add(rows[first + line], others[at], scores[line, at], True)

    @staticmethod
    def cells(vectors: Vectors, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The cells of rows: the place of the row, term, weight."""
        sizes = vectors.sizes[rows]
        cell = _ranges(vectors.starts[rows], sizes)
        return np.repeat(np.arange(len(rows)), sizes), vectors.term[cell], vectors.weight[cell]

    def all_of(self, row: int) -> None:
        """Score a left row against all right rows."""
        left, index, best = self.left, self.index, self.best
        total = np.zeros(index.rows.n)
        for cell in range(left.starts[row], left.starts[row + 1]):
            postings = slice(index.starts[left.term[cell]], index.starts[left.term[cell] + 1])
            total[index.owner[postings]] += left.weight[cell] * index.weight[postings]
        near = np.flatnonzero(total >= best.least[row])
        rounded = np.round(total[near], 6)
        if len(near) > best.k:
            near = near[rounded >= np.partition(rounded, -best.k)[-best.k]]
        near = near[np.lexsort((best.places[near], -np.round(total[near], 6)))[: best.k]]
        best.found[row] = -1
        best.found[row, : len(near)], best.totals[row, : len(near)] = near, total[near]
        best.done[row] = True


class _Batch:
    """Some left rows, of which the postings of terms with few pairs are read pair by pair."""

    def __init__(self, search: _Search, first: int, last: int):
        self.search, self.first, self.last, left = search, first, last, search.left
        n, cells = last - first, slice(left.starts[first], left.starts[last])
        self.used, column = np.unique(left.term[cells], return_inverse=True)
        self.width = len(self.used) + 1
        at = (left.row[cells] - first).astype(np.int64) * self.width + column + 1
        self.weights, self.position = np.zeros(n * self.width), np.full(n * self.width, 1 << 30, dtype=np.int32)
        self.weights[at] = left.weight[cells]
        self.position[at] = np.arange(cells.start, cells.stop) - left.starts[left.row[cells]]

    def run(self) -> None:
        search, left, first = self.search, self.search.left, self.first
        search.place[self.used] = np.arange(1, self.width)
        sizes = left.sizes[first : self.last]
        for position in range(int(sizes.max(initial=0))):
            rows = first + np.flatnonzero((sizes > position) & ~search.best.done[first : self.last])
            rows = rows[~search.grouped[left.term[left.starts[rows] + position]]]
            start, many = search.reached(rows, left.starts[rows] + position)
            rows, start, many = rows[many > 0], start[many > 0], many[many > 0]
            cuts = np.searchsorted(np.cumsum(many), np.arange(PAIRS, int(many.sum()) + PAIRS, PAIRS)) + 1
            for a, b in zip(np.r_[0, cuts], np.minimum(cuts, len(many))):
                if a < b:
                    self.some_of(np.repeat(rows[a:b], many[a:b]), search.index.owner[_ranges(start[a:b], many[a:b])], position)
        search.place[self.used] = 0

    def some_of(self, row: np.ndarray, other: np.ndarray, position: int) -> None:
        """Score pairs that meet in the left rows' cells at position; those that met before go."""
        search, right = self.search, self.search.index.rows
        sizes = right.sizes[other]
        cell = _ranges(right.starts[other], sizes)
        at = np.repeat((row - self.first) * self.width, sizes) + search.place[right.term[cell]]
        starts = np.cumsum(sizes) - sizes
        total = np.add.reduceat(self.weights[at] * right.weight[cell], starts)
        good = total >= search.best.least[row]
        good[good] = np.minimum.reduceat(self.position[at], starts)[good] == position
        if good.any():
            search.best.add(row[good], other[good].astype(np.int64), total[good], False)


def best(k: int, threshold: float, share: int = SHARE, group: int = GROUP):
    """A function of a part of the left and one of the right vectors of a block: each left
    row's k best right rows of that part from the threshold on, ties by identifier."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row, other, total = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
        if len(left) and len(right):
            index = Index(Vectors(right))
            places = np.empty(len(right), dtype=np.int64)
            places[pc.sort_indices(right["id"].combine_chunks()).to_numpy()] = np.arange(len(right))
            found = _Best(len(left), places, k, threshold)
            _Search(Vectors(left, index.rows.known), index, found, share, group).run()
            row, other, total = found.pairs()
        names = [side["id"].combine_chunks().take(pa.array(at)) for side, at in ((left, row), (right, other))]
        return pa.table({"s1_id": names[0], "cand_id": names[1], "score": total})

    return run


class _Product:
    """Right vectors (columns, terms and weights of their cells) to be multiplied with left
    ones: terms that many of them have are a dense matrix, the others are added cell by cell."""

    def __init__(self, column: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, terms: int):
        self.n = n
        order = np.argsort(term.astype(np.uint16) if terms < 1 << 16 else term, kind="stable")  # short numbers are sorted faster
        term, self.column, self.weight = term[order], column[order], weight[order]
        counts = np.bincount(term, minlength=terms)
        self.starts = np.r_[0, np.cumsum(counts)]
        heavy = np.argsort(-counts, kind="stable")[:MOST_DENSE]
        heavy = heavy[counts[heavy] * DENSE > n]
        self.line = np.full(terms, -1)
        self.line[heavy] = np.arange(len(heavy))
        thick = self.line[term] >= 0
        self.matrix = np.zeros((len(heavy), n))
        self.matrix[self.line[term[thick]], self.column[thick]] = self.weight[thick]

    def of(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        """The scores of n left rows (their cells) with all right ones."""
        at = self.line[term]
        thick = at >= 0
        factors = np.zeros((n, len(self.matrix)))
        factors[row[thick], at[thick]] = weight[thick]
        scores = factors @ self.matrix
        row, term, weight = row[~thick].astype(np.int64), term[~thick], weight[~thick]
        many = self.starts[term + 1] - self.starts[term]
        posting = _ranges(self.starts[term], many)
        np.add.at(scores.reshape(-1), np.repeat(row * self.n, many) + self.column[posting], np.repeat(weight, many) * self.weight[posting])
        return scores

    def only(self, columns: np.ndarray) -> "_Product":
        """The product with some of the right vectors."""
        some = object.__new__(_Product)
        some.n, some.line, some.matrix = len(columns), self.line, self.matrix[:, columns]
        place = np.full(self.n, -1)
        place[columns] = np.arange(len(columns))
        column = place[self.column]
        kept = column >= 0
        some.column, some.weight = column[kept], self.weight[kept]
        some.starts = np.r_[0, np.cumsum(kept)][self.starts]
        return some


class _Sums:
    """Number, sum, least and most of each left row's scores, in millionths."""

    def __init__(self, n: int, threshold: float):
        self.lowest = round(threshold * 1e6)
        self.n, self.total, self.most = (np.zeros(n, dtype=np.int64) for _ in range(3))
        self.least = np.full(n, 1 << 62, dtype=np.int64)

    def block(self, first: int, scores: np.ndarray) -> None:
        """Scores, in millionths, of the left rows from first on, of which many count."""
        rows = slice(first, first + len(scores))
        micro = np.rint(scores, out=scores).astype(np.int32)
        above = (micro.view(np.uint32) - np.uint32(self.lowest)).min(axis=1)  # lower scores wrap around
        if self.lowest > 0:
            hits = np.array([np.count_nonzero(line) for line in micro >= self.lowest])
        else:
            hits, above = np.full(len(micro), micro.shape[1]), micro.min(axis=1) - self.lowest
        some = hits > 0
        self.n[rows] += hits
        self.least[rows] = np.where(some, np.minimum(self.least[rows], above.astype(np.int64) + self.lowest), self.least[rows])
        self.most[rows] = np.where(some, np.maximum(self.most[rows], micro.max(axis=1)), self.most[rows])
        np.maximum(micro, np.int32(self.lowest), out=micro)
        self.total[rows] += micro.sum(axis=1, dtype=np.int64) - self.lowest * (micro.shape[1] - hits)

    def pairs(self, row: np.ndarray, score: np.ndarray) -> None:
        """Scores of pairs, rows in order."""
        score = np.rint(score * 1e6)
        row, score = row[score >= self.lowest], score[score >= self.lowest].astype(np.int64)
        if not len(row):
            return
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        row = row[starts]
        self.n[row] += np.diff(np.r_[starts, len(score)])
        self.total[row] += np.add.reduceat(score, starts)
        self.least[row] = np.minimum(self.least[row], np.minimum.reduceat(score, starts))
        self.most[row] = np.maximum(self.most[row], np.maximum.reduceat(score, starts))


def _common(vectors: Vectors, most: int) -> np.ndarray:
    """For each term whether rows are grouped by it: the most frequent ones, as long as a few
    rows (they decide about speed alone) have no more than `most` different sets of them."""
    used = np.zeros(len(vectors.known), dtype=bool)
    n = min(vectors.n, SEEN)
    cells = slice(0, vectors.starts[n])
    row, term = vectors.row[cells], vectors.term[cells]
    counts = np.bincount(term, minlength=len(used))
    order = np.argsort(term, kind="stable")
    starts = np.r_[0, np.cumsum(counts)]
    code = np.zeros(n, dtype=np.int64)
    for one in np.argsort(-counts, kind="stable")[:MOST_COMMON]:
        if counts[one] * RARE < n:
            break
        finer = 2 * code
        finer[row[order[starts[one] : starts[one + 1]]]] += 1
        kinds, finer = np.unique(finer, return_inverse=True)
        if len(kinds) <= most:
            used[one], code = True, finer
    return used


class _Groups:
    """Rows in the order of their common terms, those with the same ones together (groups:
    at least `size` rows where it is above 1, alike in their three rarest common terms), and the
    highest weight of each common term in each group."""

    def __init__(self, vectors: Vectors, common: np.ndarray, size: int):
        cells = np.flatnonzero(common[vectors.term])
        row, term, weight = vectors.row[cells], vectors.term[cells], vectors.weight[cells]
        mixed = np.random.default_rng(7).integers(0, 1 << 63, len(common) + 1, dtype=np.uint64)
        sets = np.zeros(vectors.n, dtype=np.uint64)
        np.add.at(sets, row, mixed[term])
        scale = np.zeros(vectors.n, dtype=np.int64)  # rows of the same set differ in length
        if len(vectors.weight):
            last = np.maximum(vectors.weight[np.maximum(vectors.starts[1:] - 1, 0)], 1e-9)
            scale = np.minimum(np.log(last.max() / last) / 0.1, SCALES - 1).astype(np.int64)
        sets += scale.astype(np.uint64) * mixed[-1]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        head = np.zeros((3, vectors.n), dtype=np.int64)
        for k in range(3):
            head[k, row[rank == k]] = 1 + term[rank == k]
        self.order = np.lexsort((sets, head[2], head[1], head[0]))
        keys = head[:, self.order] if size > 1 else sets[self.order][None]
        cuts = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)]) if vectors.n else np.zeros(0, dtype=np.int64)
        starts = []
        for a, b in zip(cuts.tolist(), np.r_[cuts[1:], vectors.n].tolist()):
            if not starts or a - starts[-1] >= size // 4:
                starts.append(a)
            if size > 1:
                starts.extend(range(starts[-1] + 2 * size, b - size // 2, 2 * size))
        self.starts = np.array(starts + [vectors.n])
        sizes = np.diff(self.starts)
        self.of = np.empty(vectors.n, dtype=np.int64)  # in the new order
        self.of[:] = np.repeat(np.arange(len(sizes)), sizes)
        self.scale = scale[self.order[self.starts[:-1]]]  # one of a group whose rows have the same set
        place = np.empty(vectors.n, dtype=np.int64)
        place[self.order] = np.arange(vectors.n)
        column = np.cumsum(common) - 1
        self.top = np.zeros((len(sizes), int(common.sum())))
        np.maximum.at(self.top, (self.of[place[row]], column[term]), weight)


def _ordered(vectors: Vectors, order: np.ndarray) -> Vectors:
    new = object.__new__(Vectors)
    cells = _ranges(vectors.starts[order], vectors.sizes[order])
    new.known, new.n, new.sizes = vectors.known, vectors.n, vectors.sizes[order]
    new.row = np.repeat(np.arange(new.n, dtype=np.int32), new.sizes)
    new.term, new.weight = vectors.term[cells], vectors.weight[cells]
    new.starts = np.r_[0, np.cumsum(new.sizes)]
    return new


class _All:
    """The sums of all scores of a part from the threshold on.

    Rows are grouped by their common terms, and from the groups' highest weights follows what
    two rows of two groups get from common terms at most. If that can reach the threshold, all
    pairs of both groups are scored. Pairs of other groups have to share a rarer term: each is
    scored with the rarest term that both have, if that, what the groups give and the left row's
    later terms can reach the threshold. Where a term has many pairs, those that need a second
    such term are scored with it. In a product, terms that would be another's pairs count far
    below zero, so that no pair counts twice."""

    def __init__(self, left: Vectors, right: Vectors, threshold: float, group: int, most: int):
        self.threshold, self.group = threshold, group
        self.common = _common(right, most)
        mine, theirs = _Groups(left, self.common, ROWS), _Groups(right, self.common, 1)
        self.left, self.right, self.mine, self.theirs = _ordered(left, mine.order), _ordered(right, theirs.order), mine, theirs
        self.bound = mine.top @ theirs.top.T
        self.whole = self.bound >= threshold - SLACK
        self.sums = _Sums(left.n, threshold)
        self.place = np.zeros(len(right.known), dtype=np.int64)

    def run(self) -> None:
        for group in range(len(self.whole)):
            self.all_of(group)
        left, right = self.left, self.right
        self.other = ~self.common[left.term]
        scales, self.scale = np.unique(self.theirs.scale, return_inverse=True)
        scale = self.scale[self.theirs.of[right.row]]
        self.tail = np.empty((len(scales), len(left.term)))  # what other terms give from this one on, by the right row's scale
        chance = np.zeros(len(left.term), dtype=bool)
        for k in range(len(scales)):
            highest, own = np.zeros(len(right.known)), scale == k
            np.maximum.at(highest, right.term[own], right.weight[own])
            sums = np.r_[0.0, np.cumsum(np.where(self.other, left.weight * highest[left.term], 0.0))]
            self.tail[k] = sums[left.starts[1:]][left.row] - sums[:-1]
            reach = np.where(self.whole | (self.scale != k), -1.0, self.bound).max(axis=1, initial=-1.0)
            chance |= (highest[left.term] > 0) & (self.tail[k] + reach[self.mine.of[left.row]] >= self.threshold - SLACK)
        cells = np.flatnonzero(self.other & chance)
        cells = cells[np.argsort(left.term[cells], kind="stable")]  # by term, then row
        order = np.argsort(right.term, kind="stable")
        self.owner, self.starts = right.row[order].astype(np.int64), np.r_[0, np.cumsum(np.bincount(right.term, minlength=len(right.known)))]
        counts = np.bincount(left.term[cells], minlength=len(right.known))
        large = counts * np.diff(self.starts) > self.group
        for own in np.split(cells, np.cumsum(counts)[:-1]) if len(cells) else ():
            if len(own) and large[left.term[own[0]]]:
                self.together(own)
        few = np.sort(cells[~large[left.term[cells]]])  # by row
        sizes = np.diff(self.starts)[left.term[few]]
        cuts = np.searchsorted(np.cumsum(sizes), np.arange(4 * PAIRS, int(sizes.sum()) + 4 * PAIRS, 4 * PAIRS)) + 1
        for a, b in zip(np.r_[0, cuts], np.minimum(cuts, len(few))):
            if a < b:
                self.some_of(few[a:b])

    def product(self, rows: np.ndarray, others: np.ndarray) -> tuple[_Product, np.ndarray]:
        """Right rows to be multiplied with left ones, and the left rows' cells of their terms."""
        used = np.unique(self.left.term[_ranges(self.left.starts[rows], self.left.sizes[rows])])
        self.place[used] = np.arange(1, len(used) + 1)
        column, term, weight = _Search.cells(self.right, others)
        term = self.place[term] - 1
        there = term >= 0
        return _Product(column[there], term[there], weight[there], len(others), len(used)), used

    def all_of(self, group: int) -> None:
        """Score all pairs of a left group with the right groups that its common terms can reach."""
        theirs, left = self.theirs, self.left
        wide = np.flatnonzero(self.whole[group])
        others = _ranges(theirs.starts[wide], np.diff(theirs.starts)[wide])
        begin, end = int(self.mine.starts[group]), int(self.mine.starts[group + 1])
        for start in range(0, len(others), NARROW):
            product, used = self.product(np.arange(begin, end), others[start : start + NARROW])
            step = max(1, NEAR // product.n)
            for first in range(begin, end, step):
                last = min(end, first + step)
                cells = slice(left.starts[first], left.starts[last])
                self.sums.block(first, product.of(left.row[cells] - first, self.place[left.term[cells]] - 1, 1e6 * left.weight[cells], last - first))
            self.place[used] = 0

    def together(self, cells: np.ndarray) -> None:
        """Score left rows that have a term (cells: one of each row) against its postings."""
        term = self.left.term[cells[0]]
        everyone = self.owner[self.starts[term] : self.starts[term + 1]]
        groups, first = np.unique(self.mine.of[self.left.row[cells]], return_index=True)
        for start in range(0, len(everyone), SLICE):
            others = everyone[start : start + SLICE]
            kinds, kind = np.unique(self.theirs.of[others], return_inverse=True)
            free, further = ~self.whole[np.ix_(groups, kinds)], []
            product, used = self.product(self.left.row[cells], others)
            if len(cells) * len(others) <= SMALL:
                self.scored(product, cells, cells, others, groups, free[:, kind])
            else:
                further, rest = self.large(product, cells, others, groups, first, kinds, kind, free)
            self.place[used] = 0
            for own, later, those in further:
                product, used = self.product(self.left.row[own], those)
                self.scored(product, own, later, those, groups, rest[:, np.searchsorted(kinds, self.theirs.of[those])])
                self.place[used] = 0

    def large(self, product: _Product, cells: np.ndarray, others: np.ndarray, groups: np.ndarray, first: np.ndarray, kinds: np.ndarray, kind: np.ndarray, free: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
        """Pairs of groups that a term and the common ones can bring to the threshold are scored.
        Those of other groups have to share a second term too (they are returned, with the
        groups); where that takes longer, all are scored that later terms leave a chance."""
        bound, scale = self.bound[np.ix_(groups, kinds)], self.scale[kinds]
        parts = [slice(k, k + ROWS) for k in range(0, len(cells), ROWS)]
        of = np.searchsorted(groups, self.mine.of[self.left.row[cells]])
        plans = []
        for tail in (self.tail[:, cells], self.alone(cells)):
            open_ = free & (bound + np.maximum.reduceat(tail, first, axis=1).T[:, scale] >= self.threshold - SLACK)
            near = [np.flatnonzero(open_[of[part.start] : of[min(part.stop, len(cells)) - 1] + 1].any(axis=0)[kind]) for part in parts]
            plans.append((sum(len(n) for n in near) * ROWS, near, open_))
        second = self.seconds(cells, others) if plans[1][0] < plans[0][0] else []
        both = plans[1][0] + sum(len(a) * len(b) + SETUP for _, a, b in second) < plans[0][0]
        _, near, open_ = plans[both]
        for part, columns in zip(parts, near):
            if 4 * len(columns) >= 3 * len(others):
                self.scored(product, cells[part], cells[part], others, groups, open_[:, kind])
            elif len(columns):
                self.scored(product.only(columns), cells[part], cells[part], others[columns], groups, open_[:, kind[columns]])
        return second if both else [], free & ~open_

    def alone(self, cells: np.ndarray) -> np.ndarray:
        """What the cells' own terms give at most, by the right row's scale."""
        last = cells + 1 == self.left.starts[1:][self.left.row[cells]]
        return self.tail[:, cells] - np.where(last, 0.0, self.tail[:, np.minimum(cells + 1, len(self.left.term) - 1)])

    def seconds(self, cells: np.ndarray, others: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each term that rows share besides a rarer one: their cells of the rarer one and
        of this one, and the right rows that have both."""
        left, term = self.left, self.left.term[cells[0]]
        sizes = left.starts[1:][left.row[cells]] - cells - 1
        later, own = _ranges(cells + 1, sizes), np.repeat(cells, sizes)
        own, later = own[self.other[later]], later[self.other[later]]
        order = np.argsort(left.term[later], kind="stable")
        own, later = own[order], later[order]
        row, terms, _ = _Search.cells(self.right, others)
        rest = (terms < term) & ~self.common[terms]
        row, terms = row[rest], terms[rest]
        order = np.argsort(terms, kind="stable")
        row, terms = row[order], terms[order]
        found = []
        for one in np.intersect1d(left.term[later], terms):
            a, b = np.searchsorted(left.term[later], (one, one + 1))
            c, d = np.searchsorted(terms, (one, one + 1))
            found.append((own[a:b], later[a:b], others[row[c:d]]))
        return found

    def scored(self, product: _Product, cells: np.ndarray, later: np.ndarray, others: np.ndarray, groups: np.ndarray, open_: np.ndarray) -> None:
        """Score rows that share the terms of cells and of later (the same ones, or further ones)
        and none that is rarer or between, as far as their group is open to the other row."""
        left, step = self.left, max(1, SCORES // len(others))
        for k in range(0, len(cells), step):
            own, second = cells[k : k + step], later[k : k + step]
            rows = left.row[own].astype(np.int64)
            sizes = left.sizes[rows]
            cell, line = _ranges(left.starts[rows], sizes), np.repeat(np.arange(len(rows)), sizes)
            out = self.other[cell] & (cell < second[line]) & (cell != own[line])
            scores = product.of(line, self.place[left.term[cell]] - 1, np.where(out, -FAR, left.weight[cell]), len(rows))
            near = scores >= self.threshold - SLACK
            near &= open_[np.searchsorted(groups, self.mine.of[rows])]
            hit = np.flatnonzero(near)
            self.sums.pairs(rows[hit // len(others)], scores.reshape(-1)[hit])

    def some_of(self, cells: np.ndarray) -> None:
        """Score each cell's row against the postings of its term, pair by pair."""
        left, right = self.left, self.right
        many = np.diff(self.starts)[left.term[cells]]
        other = self.owner[_ranges(self.starts[left.term[cells]], many)]
        cell = np.repeat(cells, many)
        row = left.row[cell].astype(np.int64)
        group, theirs = self.mine.of[row], self.theirs.of[other]
        chance = ~self.whole[group, theirs] & (self.bound[group, theirs] + self.tail[self.scale[theirs], cell] >= self.threshold - SLACK)
        other, cell, row = other[chance], cell[chance], row[chance]
        if not len(row):
            return
        lines, line = np.unique(row, return_inverse=True)
        mine = _ranges(left.starts[lines], left.sizes[lines])
        used = np.unique(left.term[mine])
        step = max(1, (CELLS << 2) // (len(used) + 1))
        for first in range(0, len(lines), step):  # lines are in order
            a, b = np.searchsorted(line, (first, first + step))
            own = _ranges(left.starts[lines[first : first + step]], left.sizes[lines[first : first + step]])
            used = np.unique(left.term[own])
            self.place[used] = np.arange(1, len(used) + 1)
            n, width = min(step, len(lines) - first), len(used) + 1
            weights, position = np.zeros(n * width), np.full(n * width, np.iinfo(np.int64).max)
            at = np.repeat(np.arange(n), left.sizes[lines[first : first + step]]) * width + self.place[left.term[own]]
            weights[at] = left.weight[own]
            position[at[self.other[own]]] = own[self.other[own]]
            sizes = right.sizes[other[a:b]]
            theirs = _ranges(right.starts[other[a:b]], sizes)
            at = np.repeat((line[a:b] - first) * width, sizes) + self.place[right.term[theirs]]
            begin = np.cumsum(sizes) - sizes
            score = np.add.reduceat(weights[at] * right.weight[theirs], begin)
            new = np.minimum.reduceat(position[at], begin) == cell[a:b]
            self.sums.pairs(row[a:b][new], score[new])
            self.place[used] = 0


def totals(threshold: float, group: int = GROUP, most: int = 1 << 12):
    """A function of a part of the left and one of the right vectors of a block: for each
    left row the number, sum, least and most of its scores from the threshold on, in
    millionths, to which scores are rounded. A threshold of 0 or less counts pairs without a
    common term too, as all groups can reach it."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        sums, order = _Sums(0, threshold), np.zeros(0, dtype=np.int64)
        if len(left) and len(right):
            theirs = Vectors(right)
            scored = _All(Vectors(left, theirs.known), theirs, threshold, group, min(most, max(1, len(right) // 64)))
            scored.run()
            sums, order = scored.sums, scored.mine.order
        some = np.flatnonzero(sums.n)
        columns = {"s1_id": left["id"].combine_chunks().take(pa.array(order[some])), "n": sums.n[some], "total": sums.total[some], "least": sums.least[some], "most": sums.most[some]}
        return pa.table(columns)

    return run
