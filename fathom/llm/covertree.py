"""Cover trees over unit vectors and their dual traversal, in numpy.

A tree's levels are nested nets with halving radii 1/2, 1/4, 1/8 ...: every vector lies within the radius of
its node's centre, a node's centre is also the centre of one of its children, and rows are ordered so that
every node is a run of rows. Two trees (or one with itself) are walked together from the top: a pair of
nodes goes out where the distance of the centres, less both covering radii, is above the limit; where even
the distance plus both radii is within it, all their rows are linked at once and nobody looks at the single
pairs; else the children are paired. Pairs of single rows are decided by their cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

RADII = tuple(0.5**i for i in range(1, 7))
#: Rows of a block of cosines, and pairs that are looked at together further down.
BLOCK, PAIRS = 512, 100_000
#: What rounding may do to a distance. Pairs this close to a bound are looked at further.
SLACK = 1e-7


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, by their largest component first so that nothing overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _distance(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine))


def paths(x: np.ndarray) -> np.ndarray:
    """For each row its node on each level, as the row that is the node's centre. ``x``: unit vectors."""
    n = len(x)
    out = np.zeros((n, len(RADII)), np.int32)
    node = np.zeros(n, np.int32)
    order = [np.arange(n)]
    for level, radius in enumerate(RADII):
        new = np.empty(n, np.int32)
        least = 1.0 - radius * radius / 2.0
        following = []
        for members in order:
            # the node's own centre comes first, and so stays a centre
            own = int(node[members[0]]) if level else int(members[0])
            left = members[np.argsort(members != own, kind="stable")]
            while len(left):
                # a block of rows at a time: each becomes a centre unless an earlier one covers it
                head = left[:BLOCK]
                inside = x[head] @ x[left].T >= least
                taken = np.zeros(len(left), bool)
                for i in range(len(head)):
                    if not taken[i]:
                        mine = inside[i] & ~taken
                        mine[i] = True
                        taken |= mine
                        got = left[mine]
                        new[got] = head[i]
                        following.append(got)
                left = left[~taken]
        node = new
        out[:, level] = node
        order = following
    return out


class Tree:
    """Rows in tree order and, by level, the nodes as runs of rows."""

    def __init__(self, x: np.ndarray, path: np.ndarray):
        self.order = np.lexsort(tuple(path[:, k] for k in range(path.shape[1] - 1, -1, -1)))
        self.x = x[self.order]
        place = np.empty(len(x), np.int64)
        place[self.order] = np.arange(len(x))
        self.levels = []
        fresh = np.zeros(len(x), bool)
        for level in range(path.shape[1]):
            p = path[self.order, level]
            fresh |= np.diff(p, prepend=-1) != 0
            lo = np.flatnonzero(fresh)
            hi = np.append(lo[1:], len(x))
            centre = place[p[lo]]
            near = np.einsum("ij,ij->i", self.x, self.x[np.repeat(centre, hi - lo)])
            radius = np.maximum.reduceat(_distance(near), lo)
            radius[hi - lo == 1] = 0.0
            self.levels.append((lo, hi, centre, radius))
        rows = np.arange(len(x))
        self.levels.append((rows, rows + 1, rows, np.zeros(len(x))))
        # the children of node k of a level are the next level's nodes first[k] .. first[k+1]
        self.first = [np.searchsorted(b[0], np.append(a[0], len(x))) for a, b in zip(self.levels[:-1], self.levels[1:])]


def _expand(first_a: np.ndarray, first_b: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of children of the node pairs (a, b), a bounded number at a time."""
    na, nb = first_a[a + 1] - first_a[a], first_b[b + 1] - first_b[b]
    ends = np.cumsum(na * nb)
    total, at = int(ends[-1]) if len(ends) else 0, 0
    while at < total:
        k = np.arange(at, min(total, at + PAIRS))
        pair = np.searchsorted(ends, k, side="right")
        inside = k - (ends[pair] - na[pair] * nb[pair])
        yield first_a[a[pair]] + inside // nb[pair], first_b[b[pair]] + inside % nb[pair]
        at += PAIRS


def linked(left: Tree, right: Tree, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of rows (lo, hi) of ``left`` and (lo, hi) of ``right`` all of whose pairs have that cosine at least.

    For a tree with itself: each pair of different rows lies in one of the runs, or in one as (run, same run).
    """
    limit, same = float(np.sqrt(2.0 - 2.0 * cosine)), left is right
    last = len(left.levels) - 1

    def judge(level: int, a: np.ndarray, b: np.ndarray, cos: np.ndarray):
        (lo_a, hi_a, _, r_a), (lo_b, hi_b, _, r_b) = left.levels[level], right.levels[level]
        d, reach = _distance(cos), r_a[a] + r_b[b]
        single = (hi_a[a] - lo_a[a] == 1) & (hi_b[b] - lo_b[b] == 1)
        sure = np.where(single, cos >= cosine, d + reach <= limit - SLACK)
        open_ = ~single & ~sure & (d - reach <= limit + SLACK)
        if same:
            twin = a == b
            sure = np.where(twin, (2 * r_a[a] <= limit - SLACK) & ~single, sure)
            open_ = np.where(twin, ~single & ~sure, open_)
        return (lo_a[a[sure]], hi_a[a[sure]], lo_b[b[sure]], hi_b[b[sure]]), a[open_], b[open_]

    def descend(level: int, a: np.ndarray, b: np.ndarray):
        if not len(a):
            return
        for i, j in _expand(left.first[level], right.first[level], a, b):
            if same:
                keep = i <= j
                i, j = i[keep], j[keep]
            ca, cb = left.levels[level + 1][2][i], right.levels[level + 1][2][j]
            cos = np.einsum("ij,ij->i", left.x[ca], right.x[cb])
            found, a2, b2 = judge(level + 1, i, j, cos)
            if len(found[0]):
                yield found
            if level + 1 < last:
                yield from descend(level + 1, a2, b2)

    rough = max(1e-4, 2e-7 * left.x.shape[1])
    (_, _, ca, ra), (_, _, cb, rb) = left.levels[0], right.levels[0]
    for wide_a in (False, True):
        for wide_b in (False, True):
            # nodes that are one vector need one bound only
            rows_a, rows_b = np.flatnonzero((ra > 0) == wide_a), np.flatnonzero((rb > 0) == wide_b)
            side_b = np.ascontiguousarray(right.x[cb[rows_b]].T, np.float32)
            for at in range(0, len(rows_a), BLOCK):
                own = rows_a[at : at + BLOCK]
                reach = limit + SLACK + (ra[own][:, None] + rb[rows_b] if wide_a or wide_b else 0.0)
                # single precision sifts, with room for its rounding; what is left is decided in double precision
                near = left.x[ca[own]].astype(np.float32) @ side_b >= (1.0 - reach * reach / 2.0 - rough)
                some = np.flatnonzero(near.any(axis=1))
                a, b = np.nonzero(near[some])
                a = some[a]
                a, b = own[a], rows_b[b]
                if same:
                    keep = a <= b
                    a, b = a[keep], b[keep]
                # pairs are decided by a cosine that is computed in the same way on every level
                found, a, b = judge(0, a, b, np.einsum("ij,ij->i", left.x[ca[a]], right.x[cb[b]]))
                if len(found[0]):
                    yield found
                yield from descend(0, a, b)


def counts(left: Tree, right: Tree, cosine: float, weight_left: np.ndarray, weight_right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(links of each row of left, of each row of right, a root for each row of both). Weights and results in the
    order in which the rows came; ``root`` numbers the rows of left first, then those of right (none if the same)."""
    same = left is right
    n, m = len(left.x), len(right.x)
    wl, wr = weight_left[left.order], weight_right[right.order]
    sum_l, sum_r = np.append(0, np.cumsum(wl)), np.append(0, np.cumsum(wr))
    add_l, add_r = np.zeros(n + 1, np.int64), np.zeros(m + 1, np.int64)
    chain_l, chain_r = np.zeros(n + 1, np.int64), np.zeros(m + 1, np.int64)
    edges_a, edges_b = [], []
    for la, ha, lb, hb in linked(left, right, cosine):
        more_a, more_b = sum_r[hb] - sum_r[lb], sum_l[ha] - sum_l[la]
        twin = (la == lb) & same
        np.add.at(add_l, la, more_a)
        np.add.at(add_l, ha, -more_a)
        np.add.at(add_r, lb[~twin], more_b[~twin])
        np.add.at(add_r, hb[~twin], -more_b[~twin])
        for chain, lo, hi in ((chain_l, la, ha), (chain_l if same else chain_r, lb, hb)):
            long_ = hi - lo > 1
            np.add.at(chain, lo[long_] + 1, 1)
            np.add.at(chain, hi[long_], -1)
        edges_a.append(la)
        edges_b.append(lb + (0 if same else n))
    got_l = np.cumsum(add_l[:-1])
    got_r = np.cumsum(add_r[:-1])
    if same:
        got_l = got_l + got_r
        # within a run that is paired with itself, a row was counted as its own partner
        own = np.zeros(n, np.int64)
        own[_in_twins(left, cosine)] = 1
        got_l = got_l - own * wl
    root = np.arange(n if same else n + m)
    at = np.flatnonzero(np.cumsum(chain_l[:-1]) > 0)
    edges_a.append(at)
    edges_b.append(at - 1)
    if not same:
        at = np.flatnonzero(np.cumsum(chain_r[:-1]) > 0) + n
        edges_a.append(at)
        edges_b.append(at - 1)
    root = roots(len(root), np.concatenate(edges_a), np.concatenate(edges_b))
    back_l = np.empty(n, np.int64)
    back_l[left.order] = got_l
    if same:
        back_r, names = back_l, left.order
    else:
        back_r = np.empty(m, np.int64)
        back_r[right.order] = got_r
        names = np.concatenate([left.order, n + right.order])
    back = np.empty(len(root), np.int64)
    back[names] = names[root]
    return back_l, back_r, back


def _in_twins(tree: Tree, cosine: float) -> np.ndarray:
    """Rows whose run was linked with itself as a whole: those in a node of several rows that is narrow enough."""
    limit = float(np.sqrt(2.0 - 2.0 * cosine))
    out = np.zeros(len(tree.x) + 1, np.int64)
    for lo, hi, _, radius in tree.levels[:-1]:
        whole = (hi - lo > 1) & (2 * radius <= limit - SLACK)
        np.add.at(out, lo[whole], 1)
        np.add.at(out, hi[whole], -1)
    return np.cumsum(out[:-1]) > 0


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row of each row's component, for edges (a, b) among n rows."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        differ = x != y
        a, b = a[differ], b[differ]
        if not len(a):
            break
        x, y = x[differ], y[differ]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root
