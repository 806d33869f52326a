"""Similarities that need a table of their own for each pair: common subsequences, tables as trees, aligned words.

Each is a pandas UDF over Arrow batches; a row's table is in memory while it is computed.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs_length(a, b) -> int:
    """The length of the longest common subsequence of two sequences: a row of the table is the bits of one integer, and
    a step an addition whose carries run through it."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        hit = row & where.get(x, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the longest common subsequence over the sum of the lengths; 1 for two empty texts, null for a null."""

    def one(x: str | None, y: str | None) -> float | None:
        if x is None or y is None:
            return None
        return 2 * lcs_length(x, y) / (len(x) + len(y)) if x or y else 1.0

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")


# --- tables as trees ------------------------------------------------------------------------------------

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: An open element that the start of another ends.
_ENDS = {"td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "thead": ("td", "th", "tr"), "tbody": ("td", "th", "tr", "thead", "tbody"), "tfoot": ("td", "th", "tr", "tbody")}


class _Tables(HTMLParser):
    """The first table of a document, as nodes [tag, colspan, rowspan, content, children]."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.table, self.open, self.done = None, [], False

    def handle_starttag(self, tag, attrs):
        if self.done or (self.table is None and tag != "table"):
            return
        while self.open and self.open[-1][0] in _ENDS.get(tag, ()):
            self.open.pop()
        cell = self._cell()
        if cell is not None:  # markup within a cell is content
            cell[3].append(f"<{tag}>")
            cell[5] += 1
            if tag not in _VOID:
                self.open.append([tag, None, None, None, []])
            return
        given = dict(attrs)
        spans = [int(given[k]) if str(given.get(k) or "").isdigit() else 1 for k in ("colspan", "rowspan")] if tag == "td" else [None, None]
        node = [tag, *spans, [] if tag == "td" else None, [], 0]
        if self.table is None:
            self.table = node
        else:
            self.open[-1][4].append(node)
        if tag not in _VOID:
            self.open.append(node)

    def _cell(self):
        return next((n for n in self.open if n[0] == "td" and n[3] is not None), None)

    def handle_endtag(self, tag):
        if self.done or tag not in [n[0] for n in self.open]:
            return
        cell = self._cell()
        while self.open:
            node = self.open.pop()
            if node is cell:
                cell = None
            elif cell is not None:
                cell[3].append(f"</{node[0]}>")
            if node[0] == tag:
                break
        self.done = not self.open

    def handle_data(self, data):
        cell = None if self.done else self._cell()
        if cell is not None:
            cell[3].extend(data)


def table_tree(html: str | None) -> tuple[list[tuple], np.ndarray, int] | None:
    """(nodes in postorder, leftmost leaf of each, number of elements below the root, those within cells included) of the
    first table of a text; null without one. A node is (tag, colspan, rowspan, content of a td)."""
    parser = _Tables()
    parser.feed(html or "")
    parser.close()
    if parser.table is None:
        return None
    nodes, left, elements, stack = [], [], 0, [(parser.table, False, [])]
    first: list[int] = []
    while stack:
        node, seen, _ = stack.pop()
        if not seen:
            stack.append((node, True, None))
            stack += [(c, False, None) for c in reversed(node[4])]
            elements += 1 + node[5]
            first.append(len(nodes))
        else:
            left.append(first.pop())
            nodes.append((node[0], node[1], node[2], tuple(node[3]) if node[3] is not None else ()))
    return nodes, np.array(left), elements - 1


def _edit_share(a: tuple, b: tuple) -> float:
    """Levenshtein distance over the longer length of two contents."""
    if a == b:
        return 0.0
    if not a or not b:
        return 1.0
    codes: dict = {}
    x, y = (np.array([codes.setdefault(t, len(codes)) for t in s]) for s in (a, b))
    row, places = np.arange(len(y) + 1), np.arange(len(y) + 1)
    for i, t in enumerate(x):
        new = np.minimum(row[1:] + 1, row[:-1] + (y != t))
        new = np.concatenate([[i + 1], new])
        row = np.minimum.accumulate(new - places) + places
    return row[-1] / max(len(x), len(y))


def tree_distance(a: tuple, b: tuple, structure_only: bool = False) -> float:
    """The ordered tree edit distance (Zhang and Shasha) of two `table_tree`s.

    Deleting and inserting a node cost 1, renaming 1 between different tags or spans, and between two td of the same spans
    their contents' edit distance over the longer one. Time is at most the product of the sizes times those of the
    depths; two tables of that product are in memory.
    """
    (na, la, _), (nb, lb, _) = a, b
    roots = lambda left: sorted({int(v): i for i, v in enumerate(left)}.values())
    tree = np.zeros((len(na), len(nb)))
    known: dict = {}

    def rename(i: int, j: int) -> float:
        x, y = na[i], nb[j]
        if x[:3] != y[:3]:
            return 1.0
        if x[0] != "td" or structure_only:
            return 0.0
        key = x[3], y[3]
        if key not in known:
            known[key] = _edit_share(*key)
        return known[key]

    for p in roots(la):
        for q in roots(lb):
            u, v = int(la[p]), int(lb[q])
            forest = np.zeros((p - u + 2, q - v + 2))
            forest[:, 0], forest[0, :] = np.arange(p - u + 2), np.arange(q - v + 2)
            for i in range(u, p + 1):
                for j in range(v, q + 1):
                    r, c = i - u + 1, j - v + 1
                    best = min(forest[r - 1, c], forest[r, c - 1]) + 1
                    if la[i] == u and lb[j] == v:
                        forest[r, c] = tree[i, j] = min(best, forest[r - 1, c - 1] + rename(i, j))
                    else:
                        forest[r, c] = min(best, forest[la[i] - u, lb[j] - v] + tree[i, j])
    return float(tree[-1, -1])


#: Tables of rows and cells alone, which need no parser.
_PLAIN = re.compile("<table>(?:<tr>(?:<td>[^<&\\0]*</td>)*</tr>)*</table>")
#: Numbers that the batched tables of one group of pairs hold at a time.
_CELLS = 2_000_000


@lru_cache(maxsize=4096)
def _plain_shape(cells: tuple[int, ...]) -> tuple:
    """(leftmost leaves, labels) of a table with so many cells in its rows."""
    left, labels = [], []
    for n in cells:
        first = len(left)
        left += range(first, first + n)
        labels += [("td", 1, 1)] * n
        left.append(first)
        labels.append(("tr", None, None))
    return (*left, 0), (*labels, ("table", None, None))


def _flat(html: str | None) -> tuple[tuple, list, int] | None:
    """((leftmost leaves, labels), contents of the td, elements) of `table_tree`; contents are texts where they are
    characters alone, so equal ones are equal."""
    if html and _PLAIN.fullmatch(html):
        rows = [r[4:-5].split("</td><td>") if r else [] for r in html[11:-13].split("</tr><tr>")] if html != "<table></table>" else []
        shape = _plain_shape(tuple(map(len, rows)))
        return shape, [c for r in rows for c in r], len(shape[0]) - 1
    tree = table_tree(html)
    if tree is None:
        return None
    nodes, left, elements = tree
    contents = ["".join(n[3]) if all(len(t) == 1 for t in n[3]) else n[3] for n in nodes if n[0] == "td"]
    return (tuple(left.tolist()), tuple(n[:3] for n in nodes)), contents, elements


@lru_cache(maxsize=4096)
def _shape_distance(a: tuple, b: tuple) -> float:
    return tree_distance(*[([(*x, ()) for x in labels], np.array(left), 0) for left, labels in (a, b)], True)


@lru_cache(maxsize=65_536)
def _content_share(a, b) -> float:
    return float(_edit_share(tuple(a), tuple(b)))


def _distances(a: tuple, b: tuple, x: list[list], y: list[list]) -> np.ndarray:
    """`tree_distance` of pairs of tables that have the same two shapes, side by side: x and y are their contents."""
    (la, na), (lb, nb) = a, b
    tds_a, tds_b = ([i for i, t in enumerate(names) if t[0] == "td"] for names in (na, nb))
    codes: dict = {}
    u, v = (np.array([[codes.setdefault(c, len(codes)) for c in row] for row in side], np.int64).reshape(len(side), -1) for side in (x, y))
    names = list(codes)
    pairs, at = np.unique(u[:, :, None] * len(names) + v[:, None, :], return_inverse=True)
    shares = np.array([_content_share(names[p // len(names)], names[p % len(names)]) for p in pairs.tolist()])
    share = np.ascontiguousarray(shares[at.reshape(len(x), len(tds_a), len(tds_b))].transpose(1, 2, 0)) if len(pairs) else None
    cost = np.array([[float(p != q) for q in nb] for p in na])[:, :, None].repeat(len(x), 2)
    both = np.array([[na[i] == nb[j] for j in tds_b] for i in tds_a], bool).reshape(len(tds_a), len(tds_b))
    if both.any():
        rows, columns = np.array(tds_a)[np.nonzero(both)[0]], np.array(tds_b)[np.nonzero(both)[1]]
        cost[rows, columns] = share[both]
    tree = np.zeros((len(la), len(lb), len(x)))
    for shape, p in _roots(la):
        for other, q in _roots(lb):
            rel, width = np.array(other), len(other)
            spine, places = np.flatnonzero(rel == 0), np.arange(width + 1)[:, None]
            forest = np.zeros((len(shape) + 1, len(p), len(q), width + 1, len(x)))
            forest[0] = places
            columns = q[:, None] + np.arange(width)
            for r, first in enumerate(shape):
                rows = (p + r)[:, None, None]
                change = forest[first][:, :, rel] + tree[rows, columns]
                if first == 0:
                    change[:, :, spine] = forest[r][:, :, spine] + cost[rows, columns[:, spine]]
                row = forest[r + 1]
                row[:, :, 0] = r + 1
                row[:, :, 1:] = np.minimum(change, forest[r][:, :, 1:] + 1)
                row[:] = np.minimum.accumulate(row - places, axis=2) + places  # insertions, one after the other
                if first == 0:
                    tree[rows, columns[:, spine]] = row[:, :, spine + 1]
    return tree[-1, -1]


def _roots(left: tuple[int, ...]) -> list[tuple[tuple[int, ...], np.ndarray]]:
    """Subtrees that are not the first of their parents, by shape, smaller ones first: (leftmost leaves from the subtree's
    first node on, first nodes of those of this shape)."""
    found: dict = {}
    for first, root in {v: i for i, v in enumerate(left)}.items():
        found.setdefault(tuple(v - first for v in left[first : root + 1]), []).append(first)
    return [(shape, np.array(found[shape])) for shape in sorted(found, key=len)]


def _both_teds(prediction: pd.Series, truth: pd.Series, contents: bool = True, structures: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(TEDS, TEDS of structures) of a batch, 0 where not asked for; pairs of the same two shapes are compared together."""
    full, structure = np.zeros(len(prediction)), np.zeros(len(prediction))
    groups: dict = {}
    for k, (s, t) in enumerate(zip(prediction, truth)):
        a, b = _flat(s), _flat(t)
        if a is not None and b is not None:
            groups.setdefault((a[0], b[0]), []).append((k, a[1], b[1], max(a[2], b[2], 1)))
    for (a, b), found in groups.items():
        step = max(1, _CELLS // (len(a[0]) * len(b[0])))
        for i in range(0, len(found), step):
            at, x, y, size = zip(*found[i : i + step])
            at, size = np.array(at), np.array(size)
            if contents:
                full[at] = 1.0 - _distances(a, b, list(x), list(y)) / size
            if structures:
                structure[at] = 1.0 - _shape_distance(a, b) / size
    return full, structure


def teds(structure_only: bool = False):
    """A column function (prediction, truth): 1 less the tree edit distance of their first tables over the larger number of
    elements below the root; 0 if a text is null, empty or without a table."""

    @F.pandas_udf(T.DoubleType())
    def run(prediction: pd.Series, truth: pd.Series) -> pd.Series:
        return pd.Series(_both_teds(prediction, truth, not structure_only, structure_only)[int(structure_only)], dtype="float64")

    return run


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("teds", "teds_structure")]))
def both_teds(prediction: pd.Series, truth: pd.Series) -> pd.DataFrame:
    """`teds` of either kind, for which texts are read once."""
    return pd.DataFrame(dict(zip(("teds", "teds_structure"), _both_teds(prediction, truth))))


# --- METEOR -------------------------------------------------------------------------------------------


def aligned(hypothesis: list[str], reference: list[str]) -> tuple[int, int]:
    """(matches, chunks) of equal words, each used once: both are walked from their ends, and a word of the hypothesis takes
    the last free equal word of the reference. A chunk is a run that neighbours in both."""
    free: dict[str, list[int]] = {}
    for j, w in enumerate(reference):
        free.setdefault(w, []).append(j)
    pairs = []
    for i in range(len(hypothesis) - 1, -1, -1):
        if free.get(hypothesis[i]):
            pairs.append((i, free[hypothesis[i]].pop()))
    pairs.reverse()
    return len(pairs), sum(k == 0 or pairs[k][0] != pairs[k - 1][0] + 1 or pairs[k][1] != pairs[k - 1][1] + 1 for k in range(len(pairs)))


def meteor_of(matches: int, chunks: int, hypothesis: int, reference: int, alpha: float = 0.9, beta: float = 3.0, gamma: float = 0.5) -> float:
    if not matches:
        return 0.0
    p, r = matches / hypothesis, matches / reference
    return p * r / (alpha * p + (1 - alpha) * r) * (1 - gamma * (chunks / matches) ** beta)


@F.pandas_udf(T.DoubleType())
def meteor(hypothesis: pd.Series, reference: pd.Series) -> pd.Series:
    """METEOR of lower-case words split at white space, by equal words only: stems and synonyms need word lists that aren't
    here. 0 for null or empty texts."""

    def one(x: str | None, y: str | None) -> float:
        a, b = (x or "").lower().split(), (y or "").lower().split()
        return meteor_of(*aligned(a, b), len(a), len(b))

    return pd.Series([one(x, y) for x, y in zip(hypothesis, reference)], dtype="float64")
