"""Matrix and graph kernels on NumPy, for panels of a few thousand items in one task.

Each is deterministic for its seed. Grids of parameters run one cell per group.
"""

from __future__ import annotations

import math

import numpy as np


def pcoa(distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and positive eigenvalues, largest first; each axis' largest entry is positive."""
    n = len(distance)
    if n == 0:
        return np.zeros((0, 0)), np.zeros(0)
    d2 = np.asarray(distance, float) ** 2
    gram = -0.5 * (d2 - d2.mean(0) - d2.mean(1)[:, None] + d2.mean())
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    keep = np.argsort(values)[::-1]
    keep = keep[values[keep] > 1e-12]
    coords = vectors[:, keep] * np.sqrt(values[keep])
    sign = np.sign(coords[np.abs(coords).argmax(0), np.arange(coords.shape[1])])
    return coords * np.where(sign == 0, 1, sign), values[keep]


def variance_explained(values: np.ndarray) -> np.ndarray:
    """Percentages of the positive eigenvalues."""
    v = np.asarray(values, float)
    v = v[v > 1e-12]
    return 100 * v / v.sum() if len(v) else v


def complete_linkage(distance: np.ndarray) -> np.ndarray:
    """Merges ``(left, right, height)`` by the nearest-neighbour chain, heights ascending; new nodes count from n."""
    d = np.array(distance, float)
    n = len(d)
    np.fill_diagonal(d, np.inf)
    active, chain, merges = np.ones(n, bool), [], []
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.argmax(active))]
        while True:
            a = chain[-1]
            row = np.where(active, d[a], np.inf)
            row[a] = np.inf
            b = int(np.argmin(row))
            if len(chain) > 1 and row[chain[-2]] <= row[b]:
                b = chain[-2]
                break
            chain.append(b)
        chain = chain[:-2]
        merges.append((a, b, d[a, b]))
        keep, gone = min(a, b), max(a, b)
        d[keep] = np.maximum(d[keep], d[gone])
        d[:, keep] = d[keep]
        d[keep, keep] = np.inf
        active[gone] = False
    merges.sort(key=lambda m: m[2])
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    node, out = list(range(n)), []
    for k, (a, b, h) in enumerate(merges):
        a, b = root(a), root(b)
        out.append((node[a], node[b], h))
        low = min(a, b)
        up[max(a, b)] = low
        node[low] = n + k
    return np.array(out, float).reshape(-1, 3)


def cut_tree(merges: np.ndarray, n: int, threshold: float) -> np.ndarray:
    """Cluster numbers by first appearance; merges at ``threshold`` and above are not made."""
    up = list(range(n + len(merges)))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for k, (a, b, h) in enumerate(merges):
        if h < threshold:
            up[root(int(a))] = up[root(int(b))] = n + k
        else:
            break
    seen: dict[int, int] = {}
    return np.array([seen.setdefault(root(i), len(seen)) for i in range(n)], int)


#: Criteria of two pairs that differ by less than this share of the sums they are made of are tied.
TIED = 1e-11


def _closest(d: np.ndarray, total: np.ndarray, near: np.ndarray, node: np.ndarray, m: int) -> tuple[int, int]:
    """Slots of the pair with the smallest criterion, on ties (but for the rounding of sums) of the first nodes, the smaller node first.

    A row's criterion is at least what its smallest distance and the largest total give it, so only
    rows whose bound does not lie above the best of the most promising rows are gone through.
    """
    bound = (m - 2) * near - total - total.max()

    def across(rows: np.ndarray) -> np.ndarray:
        """The criterion without the rows' own totals."""
        q = d[rows]
        q *= m - 2
        q -= total
        return q

    some = np.argpartition(bound, 3)[:4] if len(bound) > 4 else np.flatnonzero(np.isfinite(bound))
    low = (across(some).min(1) - total[some]).min()
    slack = TIED * (1 + abs(low) + total.max())
    rows = np.flatnonzero(bound <= low + 2 * slack)
    q = across(rows)
    least = q.min(1) - total[rows]
    top = np.flatnonzero(least <= least.min() + slack)
    r, two = np.nonzero(q[top] <= least.min() + slack + total[rows[top]][:, None])
    one = rows[top][r]
    first, last = np.minimum(node[one], node[two]), np.maximum(node[one], node[two])
    k = np.lexsort((last, first))[0]
    return (one[k], two[k]) if node[one[k]] < node[two[k]] else (two[k], one[k])


def neighbor_joining(distance: np.ndarray) -> list[tuple[int, int, float]]:
    """Edges ``(parent, child, length)``; leaves are 0 to n - 1, inner nodes count on, the last parent is the root.

    Negative input distances count as 0; the first smallest criterion wins ties. The next pair is found by a
    bounded search over the rows, whose totals and smallest distances are carried along; a new node
    takes the slot of its first child, and the other's is infinitely far.
    """
    d = np.maximum(np.array(distance, float), 0)
    n = len(d)
    node, edges = np.arange(n), []
    np.fill_diagonal(d, 0)
    total = d.sum(1)
    np.fill_diagonal(d, np.inf)
    near = d.min(1, initial=np.inf)
    for new in range(n, 2 * n - 2):
        m = 2 * n - new
        if 2 * m < len(d):  # half of the slots are empty
            held = np.flatnonzero(np.isfinite(near))
            d, total, near, node = d[np.ix_(held, held)], total[held], near[held], node[held]
        i, j = _closest(d, total, near, node, m)
        apart = d[i, j]
        length = apart / 2 + (total[i] - total[j]) / (2 * (m - 2))
        edges += [(new, int(node[i]), float(length)), (new, int(node[j]), float(apart - length))]
        row = (d[i] + d[j] - apart) / 2
        row[[i, j]] = np.inf
        live = np.flatnonzero(np.isfinite(row))
        total[live] += row[live] - d[i, live] - d[j, live]
        again = live[(near[live] == d[i, live]) | (near[live] == d[j, live])]
        d[i] = d[:, i] = row
        d[j] = d[:, j] = np.inf
        near[live] = np.minimum(near[live], row[live])
        near[again] = d[again].min(1)
        total[i], near[i] = row[live].sum(), row[live].min()
        total[j], near[j] = -np.inf, np.inf
        node[i] = new
    if n == 2:
        edges += [(2, 0, float(d[0, 1] / 2)), (2, 1, float(d[0, 1] / 2))]
    elif n > 2:
        i, j = sorted(np.flatnonzero(np.isfinite(near)), key=lambda k: node[k])
        edges.append((int(node[j]), int(node[i]), float(d[i, j])))
    return edges


def tree_nodes(edges: list[tuple[int, int, float]], n: int) -> dict[int, dict]:
    """Per node parent, length, x (root path, negative lengths as 0), y (leaf order or mean of children)."""
    children: dict[int, list[tuple[int, float]]] = {}
    for p, c, length in edges:
        children.setdefault(p, []).append((c, length))
    below = {c for _, c, _ in edges}
    roots = [p for p in children if p not in below] or list(range(n))
    out: dict[int, dict] = {}
    order, leaf = [], 0
    stack = [(roots[0], None, 0.0, 0.0)] if roots else []
    while stack:
        node, parent, length, x = stack.pop()
        out[node] = {"parent": parent, "length": length, "x": x, "y": None, "leaf": node not in children}
        if node not in children:
            out[node]["y"] = float(leaf)
            leaf += 1
        order.append(node)
        stack.extend((c, node, l, x + max(0.0, l)) for c, l in reversed(children.get(node, [])))
    for node in reversed(order):
        if out[node]["y"] is None:
            out[node]["y"] = float(np.mean([out[c]["y"] for c, _ in children[node]]))
    return out


#: Columns of a drawn tree's lines.
SEGMENT = "kind string, parent int, child int, x1 double, y1 double, x2 double, y2 double, branch_length double, distance_from_root double"


def tree_segments(nodes: dict[int, dict]) -> list[tuple]:
    """The lines of a drawn tree, as ``SEGMENT`` tells: a branch to every node but the root, a connector across each one's children."""
    out, across = [], {}
    for child, v in nodes.items():
        up = v["parent"]
        if up is not None:
            x = nodes[up]["x"]
            out.append(("branch", up, child, x, v["y"], v["x"], v["y"], v["x"] - x, v["x"]))
            low, high = across.get(up, (v["y"], v["y"]))
            across[up] = min(low, v["y"]), max(high, v["y"])
    for node, (low, high) in across.items():
        x = nodes[node]["x"]
        out.append(("connector", node, None, x, low, x, high, 0.0, x))
    return out


def newick(edges: list[tuple[int, int, float]], names: list[str]) -> str:
    """The tree as text, with six decimals."""
    children: dict[int, list[tuple[int, float]]] = {}
    for p, c, length in edges:
        children.setdefault(p, []).append((c, length))
    below = {c for _, c, _ in edges}
    roots = [p for p in children if p not in below]
    if not roots:
        return f"{names[0]};" if names else ";"
    text: dict[int, str] = {}
    stack = [(roots[0], False)]
    while stack:
        node, done = stack.pop()
        if node not in children:
            text[node] = names[node]
        elif done:
            text[node] = "(" + ",".join(f"{text[c]}:{l:.6f}" for c, l in children[node]) + ")"
        else:
            stack.append((node, True))
            stack.extend((c, False) for c, _ in children[node])
    return text[roots[0]] + ";"


def patristic(edges: list[tuple[int, int, float]], n: int) -> np.ndarray:
    """Sums of raw branch lengths between leaves."""
    out = np.zeros((n, n))
    for _, child, length in edges:
        side = np.zeros(n, bool)
        stack = [child]
        below: dict[int, list[int]] = {}
        for p, c, _ in edges:
            below.setdefault(p, []).append(c)
        while stack:
            x = stack.pop()
            if x < n:
                side[x] = True
            stack.extend(below.get(x, []))
        cross = side[:, None] != side[None, :]
        out[cross] += length
    return out


def align_identity(a: str, b: str, match: float = 1.0, opening: float = -1.0, extend: float = -0.5) -> float:
    """100 * matches / ungapped columns of a global alignment; 0 if there are none.

    Affine gaps, ends scored like the inside. On ties a column comes before a gap
    in ``b``, and that before a gap in ``a``. Columns and matches are carried
    along with the scores, so memory grows with one sequence only.
    """
    if not a or not b:
        return 0.0
    x, y = np.frombuffer(a.encode(), np.uint8), np.frombuffer(b.encode(), np.uint8)
    m, n = len(x), len(y)
    low = -1e18
    k = np.arange(n + 1)
    pack = lambda s: [s, np.zeros(n + 1, int), np.zeros(n + 1, int)]
    gap = lambda j: np.where(j == 0, 0.0, opening + extend * (j - 1))
    d, up, left = pack(np.where(k == 0, 0.0, low)), pack(np.full(n + 1, low)), pack(np.where(k == 0, low, gap(k)))

    def best(*states: list) -> list:
        score = states[0][0].copy()
        cols, hits = states[0][1].copy(), states[0][2].copy()
        for s in states[1:]:
            better = s[0] > score + 1e-9
            score, cols, hits = (np.where(better, p, q) for p, q in ((s[0], score), (s[1], cols), (s[2], hits)))
        return [score, cols, hits]

    for i in range(1, m + 1):
        whole = best(d, up, left)
        same = (x[i - 1] == y).astype(int)
        nd = pack(np.full(n + 1, low))
        nd[0][1:], nd[1][1:], nd[2][1:] = whole[0][:-1] + match * same, whole[1][:-1] + 1, whole[2][:-1] + same
        opened = [whole[0] + opening, whole[1], whole[2]]
        nu = best(opened, [up[0] + extend, up[1], up[2]])
        base = best(nd, nu)
        # a gap in a that starts anywhere to the left: a running maximum
        shifted = base[0] - extend * k
        run = np.maximum.accumulate(shifted)
        at = np.maximum.accumulate(np.where(shifted >= run, k, 0))
        nl = pack(np.full(n + 1, low))
        src = at[:-1]
        nl[0][1:], nl[1][1:], nl[2][1:] = base[0][src] + opening + extend * (k[1:] - src - 1), base[1][src], base[2][src]
        d, up, left = nd, nu, nl
    end = best(*([s[0][-1:], s[1][-1:], s[2][-1:]] for s in (d, up, left)))
    return 100.0 * end[2][0] / end[1][0] if end[1][0] else 0.0


#: Pairs with a sequence above this length go one by one to :func:`align_identity`; below it a cell fits a 64-bit number.
BANDED = 16_000
#: Cells of all pairs of a batch that are worked on at a time.
CELLS = 16_384
# A cell's number: twice the score above bit 46, above 32 which of equals is taken, above 16 its columns, and its matches.
_SCORE, _TIE, _COLUMN = 1 << 46, 1 << 32, 1 << 16
_PLAIN = ~np.int64(0x3FFF * _TIE)
_LOW = -60_000 * _SCORE


def _banded(pairs: list[tuple[np.ndarray, np.ndarray]], wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Penalties and cell numbers of the best alignments that stay within ``wide`` diagonals of both corners.

    One pass over the rows of all pairs; column ``c`` of a pair's band is the diagonal ``lo + c``.
    """
    m, n = (np.array([len(p[k]) for p in pairs]) for k in (0, 1))
    lo = np.minimum(0, n - m) - wide
    width = int((np.maximum(0, n - m) + wide - lo).max()) + 1
    rows = int(m.max())
    x, y = np.zeros((rows, len(pairs)), np.uint8), np.zeros((len(pairs), rows + width + 1), np.uint8)
    for p, (a, b) in enumerate(pairs):
        x[: len(a), p] = a
        at = 1 - lo[p]  # y[p, i + c] is the letter that row i and column c compare
        y[p, max(at, 0) : at + len(b)] = b[max(-at, 0) :][: y.shape[1] - max(at, 0)]
    c = np.arange(width, dtype=np.int64)
    low = np.full((len(pairs), width), _LOW)
    place = c + lo[:, None]
    # of equal scores a column comes before a gap in b, and that before a gap in a; a gap that opens before one that goes on
    d, up = np.where(place == 0, 2 * _TIE, low), low + _TIE
    left = np.where(place > 0, (-1 - place) * _SCORE, low)
    ahead, back = c * (_SCORE + _TIE), (c[1:] + 1) * _SCORE
    end = np.zeros(len(pairs), np.int64)
    for i in range(1, rows + 1):
        whole = np.maximum(np.maximum(d, up), left) & _PLAIN
        same = y[:, i : i + width] == x[i - 1][:, None]
        d = whole + (_COLUMN + 2 * _TIE)
        d += same * np.int64(2 * _SCORE + 1)
        opened = whole[:, 1:] + (_TIE - 2 * _SCORE)
        up[:, :-1] = (np.maximum(opened, (up[:, 1:] & _PLAIN) - _SCORE) & _PLAIN) + _TIE
        up[:, -1] = _LOW
        base = np.maximum(d, up) & _PLAIN
        run = np.maximum.accumulate(base + ahead, axis=1)
        left = np.empty_like(run)
        left[:, 0] = _LOW
        left[:, 1:] = (run[:, :-1] - back) & _PLAIN
        if (done := np.flatnonzero(m == i)).size:
            at = (n - m - lo)[done]
            end[done] = np.maximum(np.maximum(d[done, at], up[done, at]), left[done, at]) & _PLAIN
    return m + n - (end >> 46), end


def align_identities(pairs: list[tuple[str, str]]) -> list[float]:
    """:func:`align_identity` of many pairs, by work that grows with their length times their distance.

    A score is turned into a penalty: two for a mismatch, and for a gap one and two for each
    of its letters. A path that leaves the band on either side pays for the way there and back, so
    once the best penalty inside is below that, all best paths are inside, with all their ties. A
    narrow band gives a penalty, and that the width which is enough.
    """
    out = [0.0] * len(pairs)
    held = []
    for at, (a, b) in enumerate(pairs):
        x, y = np.frombuffer(a.encode(), np.uint8), np.frombuffer(b.encode(), np.uint8)
        if len(x) and len(y):
            if max(len(x), len(y)) > BANDED or 0 in x or 0 in y:
                out[at] = align_identity(a, b)
            else:
                held.append((12, abs(len(x) - len(y)), len(x), at, (x, y)))
    while held:
        held.sort(key=lambda h: h[:4])
        wide, apart = held[0][0], held[0][1]
        # pairs of about one width, so that none is worked on much beyond its own
        near = [h for h in held if h[0] <= 1.25 * wide + 8 and h[1] <= 1.25 * apart + 32]
        wide = max(h[0] for h in near)
        many = max(1, CELLS // (max(h[1] for h in near) + 2 * wide + 1))
        batch = near[:many]
        penalty, end = _banded([h[4] for h in batch], wide)
        taken = {h[3] for h in batch}
        held = [h for h in held if h[3] not in taken]
        for h, p, e in zip(batch, penalty.tolist(), end.tolist(), strict=True):
            if p < 2 + 2 * h[1] + 4 * (wide + 1) or wide >= max(map(len, h[4])):
                columns = e >> 16 & 0xFFFF
                out[h[3]] = 100.0 * (e & 0xFFFF) / columns if columns else 0.0
            else:
                enough = min((p - 2 - 2 * h[1]) // 4 + 1, max(map(len, h[4])))
                held.append((enough, *h[1:]))
    return out


_BASES = np.full(256, 4, np.uint8)
_BASES[list(b"ACGT")] = range(4)
#: The longest k-mer that two bits a base hold in a signed 64-bit number.
PACKED = 31


def kmer_codes(seq: str, k: int) -> np.ndarray:
    """A 64-bit number for each k-mer in order: two bits a base where all are A, C, G or T and k allows, else a negative hash."""
    raw = np.frombuffer(seq.encode("utf-32-le"), np.uint32)
    n = len(raw) - k + 1
    if n < 1:
        return np.zeros(0, np.int64)
    base = np.where(raw < 128, _BASES[raw & 127], 4)
    codes = np.zeros(n, np.int64)
    if k <= PACKED:
        for j in range(k):
            codes = (codes << 2) | (base[j : j + n] & 3)
        other = np.concatenate([[0], np.cumsum(base == 4)])
        odd = np.nonzero(other[k:] != other[:-k])[0]
    else:
        odd = np.arange(n)
    if len(odd):
        h = np.zeros(len(odd), np.uint64)
        for j in range(k):
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + raw[odd + j]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        codes[odd] = ((h ^ (h >> np.uint64(32))) | np.uint64(1 << 63)).view(np.int64)
    return codes


def kmer_codes_without_n(seq: str, k: int) -> np.ndarray:
    """Sorted distinct codes of the k-mers that hold no N."""
    codes = kmer_codes(seq, k)
    if "N" in seq and len(codes):
        n = np.concatenate([[0], np.cumsum(np.frombuffer(seq.encode("utf-32-le"), np.uint32) == ord("N"))])
        codes = codes[n[k:] == n[:-k]]
    return np.unique(codes)


def kmer_set_size(seq: str, k: int) -> int:
    """How many distinct k-mers without N there are, over all letters: packed by the widest letter, or as strings where that is too wide."""
    raw = np.frombuffer(seq.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(raw) - k + 1
    if n < 1:
        return 0
    bits = int(raw.max()).bit_length()
    if k * bits > 64:
        return len({x for x in (seq[i : i + k] for i in range(n)) if "N" not in x})
    codes = np.zeros(n, np.uint64)
    for j in range(k):
        codes = (codes << np.uint64(bits)) | raw[j : j + n]
    ns = np.concatenate([[0], np.cumsum(raw == ord("N"))])
    return len(np.unique(codes[ns[k:] == ns[:-k]]))


def kmer_strings(codes: np.ndarray, k: int) -> np.ndarray:
    """The k-mers of packed codes."""
    letters = np.frombuffer(b"ACGT", np.uint8)
    out = np.empty((len(codes), k), np.uint8)
    for j in range(k):
        out[:, k - 1 - j] = letters[(codes >> (2 * j)) & 3]
    return out.view(f"S{k}").ravel().astype(str) if len(codes) else np.zeros(0, str)


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull by the monotone chain, collinear points left out; empty below three."""
    p = np.unique(np.asarray(points, float), axis=0)
    if len(p) < 3:
        return np.zeros((0, 2))

    def half(rows) -> list:
        out: list = []
        for r in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (r[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (r[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(r)
        return out

    found = np.array(half(p)[:-1] + half(p[::-1])[:-1])
    return found if len(found) >= 3 else np.zeros((0, 2))


def farthest_points(xy: np.ndarray, quota: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices in order of choice, and distances to the centroid.

    Starts nearest to the centroid; then the point farthest from all chosen, on
    ties the one farther from the centroid, then the first.
    """
    xy = np.asarray(xy, float).reshape(-1, 2)
    centre = np.hypot(*(xy - xy.mean(0)).T) if len(xy) else np.zeros(0)
    chosen: list[int] = []
    near = np.full(len(xy), np.inf)
    while len(chosen) < min(quota, len(xy)):
        if not chosen:
            i = int(np.argmin(centre))
        else:
            top = near == near.max()
            i = int(np.argmax(np.where(top, centre, -1)))
        chosen.append(i)
        near = np.minimum(near, np.hypot(*(xy - xy[i]).T))
        near[chosen] = -1
    return np.array(chosen, int), centre


def trustworthiness(high: np.ndarray, low: np.ndarray, k: int) -> float:
    """How far neighbours in the plane are neighbours in the data, 0 to 1; k is held below n / 2."""
    n = len(high)
    k = min(k, max(1, (n - 1) // 2))
    if n < 3:
        return 1.0

    def order(v: np.ndarray) -> np.ndarray:
        g = (v * v).sum(1)
        d = g[:, None] + g[None, :] - 2 * v @ v.T
        np.fill_diagonal(d, -np.inf)
        return np.argsort(d, axis=1, kind="stable")

    rank = np.empty((n, n), int)
    o = order(np.asarray(high, float))
    rank[np.arange(n)[:, None], o] = np.arange(n)
    near = order(np.asarray(low, float))[:, 1 : k + 1]
    r = rank[np.arange(n)[:, None], near]
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * np.maximum(r - k, 0).sum()


def leiden(n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray, resolution: float = 1.0, seed: int = 42, passes: int = 20, own: np.ndarray | None = None) -> np.ndarray:
    """Communities of a weighted graph for the configuration null model at ``resolution``; ``own`` is the weight inside each node.

    Moves nodes while the quality grows, splits communities into their connected
    parts, joins each into one node, and repeats until nothing moves.
    """
    rng = np.random.default_rng(seed)
    member = np.arange(n)
    own = np.zeros(n) if own is None else np.asarray(own, float)
    src, dst, w = np.asarray(src, int), np.asarray(dst, int), np.asarray(w, float)
    for _ in range(passes):
        m = len(own)
        near: list[dict[int, float]] = [{} for _ in range(m)]
        for a, b, x in zip(src.tolist(), dst.tolist(), w.tolist(), strict=True):
            near[a][b] = near[a].get(b, 0.0) + x
            near[b][a] = near[b].get(a, 0.0) + x
        degree = np.array([sum(d.values()) for d in near]) + 2 * own
        two_m = degree.sum()
        if two_m <= 0:
            break
        com, total = np.arange(m), degree.copy()
        queue, queued = list(rng.permutation(m)), np.ones(m, bool)
        while queue:
            i = int(queue.pop())
            queued[i] = False
            gain: dict[int, float] = {}
            for j, x in near[i].items():
                gain[com[j]] = gain.get(com[j], 0.0) + x
            here = com[i]
            total[here] -= degree[i]
            value = lambda c: gain.get(c, 0.0) - resolution * degree[i] * total[c] / two_m  # noqa: B023, E731
            to, best = here, value(here)
            for c in sorted(gain):
                if (v := value(c)) > best + 1e-12:
                    to, best = c, v
            com[i] = to
            total[to] += degree[i]
            if to != here:
                for j in near[i]:
                    if com[j] != to and not queued[j]:
                        queued[j] = True
                        queue.insert(0, j)
        # connected parts of the communities
        part = np.full(m, -1)
        for s in range(m):
            if part[s] < 0:
                part[s] = s
                stack = [s]
                while stack:
                    i = stack.pop()
                    for j in near[i]:
                        if part[j] < 0 and com[j] == com[s]:
                            part[j] = s
                            stack.append(j)
        _, part = np.unique(part, return_inverse=True)
        if part.max() + 1 == m:
            break
        member = part[member]
        own = np.bincount(part, own, minlength=part.max() + 1)
        a, b = part[src], part[dst]
        inside = a == b
        own += np.bincount(a[inside], w[inside], minlength=len(own))
        src, dst, w = a[~inside], b[~inside], w[~inside]
    return member


def _curve(spread: float, min_dist: float) -> tuple[float, float]:
    """a, b of 1 / (1 + a d^2b) closest to the exponential beyond ``min_dist``, by Gauss-Newton."""
    d = np.linspace(0, 3 * spread, 300)[1:]
    y = np.where(d < min_dist, 1.0, np.exp(-(d - min_dist) / spread))
    a, b = 1.0, 1.0
    for _ in range(200):
        p = d ** (2 * b)
        f = 1 / (1 + a * p)
        jac = np.column_stack([-p * f * f, -a * p * 2 * np.log(d) * f * f])
        move = np.linalg.lstsq(jac, y - f, rcond=None)[0]
        a, b = max(1e-3, a + 0.5 * move[0]), max(1e-2, b + 0.5 * move[1])
        if np.abs(move).max() < 1e-9:
            break
    return a, b


def umap(data: np.ndarray, neighbors: int, min_dist: float, spread: float = 1.0, seed: int = 42, precomputed: bool = False, epochs: int | None = None) -> np.ndarray:
    """A 2-D embedding: exact neighbours, smoothed memberships, fuzzy union, spectral start, sampled descent."""
    data = np.asarray(data, float)
    n = len(data)
    if n <= 2:
        return np.zeros((n, 2)) + np.arange(n)[:, None]
    if precomputed:
        d = data.copy()
    else:
        g = (data * data).sum(1)
        d = np.sqrt(np.maximum(g[:, None] + g[None, :] - 2 * data @ data.T, 0))
    np.fill_diagonal(d, 0)
    k = max(1, min(neighbors, n - 1))
    order = np.argsort(d, axis=1, kind="stable")
    order = np.array([[j for j in row if j != i][:k] for i, row in enumerate(order)])
    near = np.take_along_axis(d, order, 1)
    rho = np.array([r[r > 0].min() if (r > 0).any() else 0.0 for r in near])
    low, high = np.zeros(n), np.full(n, np.inf)
    sigma, target = np.ones(n), math.log2(k) if k > 1 else 0.5
    for _ in range(64):
        total = np.exp(-np.maximum(near - rho[:, None], 0) / sigma[:, None]).sum(1)
        big = total > target
        high, low = np.where(big, sigma, high), np.where(big, low, sigma)
        sigma = np.where(np.isinf(high), sigma * 2, (low + high) / 2)
    sigma = np.maximum(sigma, 1e-3 * max(near.mean(), 1e-12))
    p = np.zeros((n, n))
    np.put_along_axis(p, order, np.exp(-np.maximum(near - rho[:, None], 0) / sigma[:, None]), 1)
    p = p + p.T - p * p.T
    rng = np.random.default_rng(seed)
    degree = np.maximum(p.sum(1), 1e-12)
    lap = np.eye(n) - p / np.sqrt(degree[:, None] * degree[None, :])
    _, vectors = np.linalg.eigh(lap)
    start = vectors[:, 1:3]
    start = start * np.sign(start[np.abs(start).argmax(0), np.arange(start.shape[1])])
    y = 10 * start / max(np.abs(start).max(), 1e-12) + rng.normal(scale=1e-4, size=(n, 2))
    a, b = _curve(spread, min_dist)
    epochs = epochs or (500 if n <= 10_000 else 200)
    i, j = np.nonzero(p)
    w = p[i, j]
    every = w.max() / w
    due, rate = every.copy(), 1.0
    for e in range(epochs):
        on = due <= e + 1
        s, t = i[on], j[on]
        due[on] += every[on]
        delta = y[s] - y[t]
        q = (delta * delta).sum(1)
        pull = np.where(q > 0, -2 * a * b * q ** np.maximum(b - 1, -0.999) / (1 + a * q**b), 0.0)
        step = np.clip(pull[:, None] * delta, -4, 4)
        move = np.zeros_like(y)
        np.add.at(move, s, step)
        np.add.at(move, t, -step)
        for _ in range(5):
            o = rng.integers(0, n, len(s))
            delta = y[s] - y[o]
            q = (delta * delta).sum(1)
            push = np.where(o != s, 2 * b / ((0.001 + q) * (1 + a * q**b)), 0.0)
            np.add.at(move, s, np.clip(push[:, None] * delta, -4, 4))
        y = y + rate * np.clip(move, -4, 4)
        rate = 1 - (e + 1) / epochs
    return y
