"""HTML main-text extraction by a tree-structured graphical model.

1. A page becomes a tree of block elements and text runs (``html_tree.parse``).
2. Every node has a state: 0 no main text, 1 an element around main text, 2 main
   text or an element inside of it.  Under state 0 there is only 0, under 2 only 0
   and 2, and a run of text is never 1.  Node potentials are log-linear in
   features of tag, names, length, links, punctuation, neighbours and the text of
   the whole element and of its parent; parent-child potentials are tables over
   both states, one for inner nodes and one for leaves.
3. Sum-product messages go upward from the leaves and downward from the root,
   which gives exact marginals in two passes; runs whose marginal of being
   main text is at least ``THRESHOLD`` are the page's blocks.
4. Weights maximise the regularised likelihood of labelled pages: the
   gradient is observed less expected features under the same messages.

Each page is one row and one tree, whatever its size; nothing is shuffled.  Null
and empty pages give the empty text.  Ids and urls are carried along and may be
null or repeat.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_pages import embedding_pages, labelled_pages, layout_pages
from .html_tree import BLOCK, HINTS, Node, parse

THRESHOLD = 0.5
STEPS, RATE, RIDGE = 300, 0.15, 0.002

_TAGS = {tag: k for k, tag in enumerate(sorted(BLOCK | {"root"}))}
_KINDS = {kind: k for k, kind in enumerate([*HINTS, "hidden"])}
_AT_KIND = 2 * (len(_TAGS) + 1)


def _names(at: int, names: str) -> tuple[dict, int]:
    return {name: at + k for k, name in enumerate(names.split())}, at + len(names.split())


#: of a run of text: itself, its neighbours among its parent's children, its parent's text
_LEAF, _end = _names(_AT_KIND + len(_KINDS), """leaf log_words linked all_linked sentence few_words
    many_words single_word embedded plain_sentence plain_other only_child after_text before_text
    after_sentence before_sentence after_linked before_linked after_heading
    parent_sentence parent_linked parent_words""")
#: of an element: the text in it, what it is made of, its neighbours, its place in the page
_INNER, _end = _names(_end, """element empty log_words linked all_linked sentence all_sentence no_sentence
    share most heading paragraph item direct frame plain plain_sentence plain_linked
    first last like_before like_after after_sentence before_sentence after_linked before_linked
    sibling_share parent_sentence parent_linked heading_near""")
_FEATURES = _end
#: weights: features in state 1, in state 2, then the tables of the parent-child
#: potentials: (inner, leaf) x (parent, own) states (1, 1), (1, 2), (2, 2)
_AT_PAIR = 2 * _FEATURES
WIDTH = _AT_PAIR + 6

_HEADINGS = {"h1", "h2", "h3"}
_FRAME = {"form", "button", "nav", "footer", "aside"}
_SENTENCE_END = ".!?:\"”»…"


def tree_features(nodes: list[Node]) -> list[list[tuple[int, float]]]:
    """Sparse features of every node.  The text of a whole subtree is summed
    upward, so that all of them take time linear in the page."""
    n = len(nodes)
    words, linked, ended = [0] * n, [0.0] * n, [0] * n
    made_of = [set() for _ in range(n)]         # tags of children; "" for text
    before, after, latest = [-1] * n, [-1] * n, [-1] * n
    seen = [0] * n                              # words in front of a node
    total = 0
    for k, node in enumerate(nodes):
        seen[k] = total
        if node.text is not None:
            words[k] = node.words
            linked[k] = node.linked * node.words
            ended[k] = node.words if node.linked <= 0.9 and node.text[-1] in _SENTENCE_END else 0
            total += node.words
        if k:
            up = node.parent
            made_of[up].add("" if node.text is not None else node.tag)
            if latest[up] >= 0:
                before[k], after[latest[up]] = latest[up], k
            latest[up] = k
    for k in range(n - 1, 0, -1):
        up = nodes[k].parent
        words[up] += words[k]
        linked[up] += linked[k]
        ended[up] += ended[k]
    part = [(linked[k] / words[k], ended[k] / words[k]) if words[k] else (0.0, 0.0) for k in range(n)]

    def neighbours(k, names):
        for j, side in ((before[k], "before"), (after[k], "after")):
            if j >= 0 and words[j]:
                # the one before k is what k comes after
                where = "after" if side == "before" else "before"
                yield names[where + "_sentence"], part[j][1]
                yield names[where + "_linked"], part[j][0]

    out = []
    for k, node in enumerate(nodes):
        up = node.parent
        if node.text is not None:
            leaf, w, x = _LEAF, node.words, part[k][1]
            plain = not nodes[up].kinds and nodes[up].tag in ("div", "td", "section", "root", "body")
            f = [(_TAGS.get(node.tag, len(_TAGS)) + len(_TAGS) + 1, 1.0), (leaf["leaf"], 1.0),
                 (leaf["log_words"], math.log1p(w) / 3), (leaf["linked"], node.linked),
                 (leaf["few_words" if w <= 4 else "many_words" if w >= 20 else "single_word"],
                  1.0 if w != 1 else 1.5),
                 (leaf["parent_sentence"], part[up][1]), (leaf["parent_linked"], part[up][0]),
                 (leaf["parent_words"], math.log1p(words[up]) / 3)]
            if node.linked > 0.9:
                f.append((leaf["all_linked"], 1.0))
            if x or node.text[-1] in _SENTENCE_END:
                f.append((leaf["sentence"], 1.0))
            if plain:
                f.append((leaf["plain_sentence" if x else "plain_other"], 1.0))
            if node.embedded:
                f.append((leaf["embedded"], node.embedded))
            if before[k] < 0 and after[k] < 0:
                f.append((leaf["only_child"], 1.0))
            if before[k] >= 0:
                if nodes[before[k]].text is not None:
                    f.append((leaf["after_text"], 1.0))
                elif nodes[before[k]].tag in _HEADINGS:
                    f.append((leaf["after_heading"], 1.0))
            if after[k] >= 0 and nodes[after[k]].text is not None:
                f.append((leaf["before_text"], 1.0))
            f += neighbours(k, leaf)
        else:
            inner, w, (a, x) = _INNER, words[k], part[k]
            f = [(_TAGS.get(node.tag, len(_TAGS)), 1.0), (inner["element"], 1.0)]
            f += [(_AT_KIND + _KINDS[kind], 1.0) for kind in node.kinds]
            made = made_of[k]
            if not w:
                f.append((inner["empty"], 1.0))
            else:
                f += [(inner["log_words"], math.log1p(w) / 3), (inner["linked"], a),
                      (inner["sentence"], x), (inner["share"], w / total)]
                if a > 0.8:
                    f.append((inner["all_linked"], 1.0))
                if x > 0.9:
                    f.append((inner["all_sentence"], 1.0))
                if not x:
                    f.append((inner["no_sentence"], 1.0))
                if 2 * w > total:
                    f.append((inner["most"], 1.0))
                f.append((inner["first"], 1 - seen[k] / total))
                f.append((inner["last"], (seen[k] + w) / total))
            if made & _HEADINGS:
                f.append((inner["heading"], 1.0))
            if "p" in made:
                f.append((inner["paragraph"], 1.0))
            if "li" in made:
                f.append((inner["item"], 1.0))
            if "" in made:
                f.append((inner["direct"], 1.0))
            if made & _FRAME:
                f.append((inner["frame"], 1.0))
            if not node.kinds and node.tag in ("div", "section", "td", "center"):
                f += [(inner["plain"], 1.0), (inner["plain_sentence"], x), (inner["plain_linked"], a)]
            if k:
                if words[up]:
                    f.append((inner["sibling_share"], w / words[up]))
                    f += [(inner["parent_sentence"], part[up][1]), (inner["parent_linked"], part[up][0])]
                if made_of[up] & _HEADINGS:
                    f.append((inner["heading_near"], 1.0))
                for j, name in ((before[k], "like_before"), (after[k], "like_after")):
                    if j >= 0 and nodes[j].text is None and nodes[j].tag == node.tag \
                            and nodes[j].kinds == node.kinds:
                        f.append((inner[name], 1.0))
                f += neighbours(k, inner)
        out.append(f)
    return out


NEVER = -1e9


def _log_sum(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


def sum_product(unary: list[tuple], parent: list[int], pairs: list) -> tuple[list, list]:
    """Exact marginals of a tree: parents come before their children.

    unary: potentials of the states 1 and 2 (state 0: 0) per node; pairs: per
    node the potentials of (parent, own) = (1, 1), (1, 2), (2, 2), the other
    allowed ones being 0.  Returns per node P(1), P(2), and per node the joint
    P(1, 1), P(1, 2), P(2, 2) with its parent."""
    n = len(unary)
    up = [[0.0, a, b] for a, b in unary]        # own potential and children's messages
    to = [(0.0, 0.0, 0.0)] * n                  # message to the parent
    for k in range(n - 1, 0, -1):
        t11, t12, t22 = pairs[k]
        u0, u1, u2 = up[k]
        to[k] = m = (u0, _log_sum(u0, _log_sum(t11 + u1, t12 + u2)), _log_sum(u0, t22 + u2))
        over = up[parent[k]]
        over[0] += m[0]
        over[1] += m[1]
        over[2] += m[2]
    down = [(0.0, 0.0, 0.0)] * n                # message from the parent
    marginal, joint = [(0.0, 0.0)] * n, [(0.0, 0.0, 0.0)] * n
    exp = math.exp
    for k in range(n):
        u0, u1, u2 = up[k]
        if k:
            t11, t12, t22 = pairs[k]
            above, before, mine = up[parent[k]], down[parent[k]], to[k]
            r0 = above[0] + before[0] - mine[0]
            r1 = above[1] + before[1] - mine[1]
            r2 = above[2] + before[2] - mine[2]
            down[k] = d = (_log_sum(r0, _log_sum(r1, r2)), t11 + r1, _log_sum(t12 + r1, t22 + r2))
        else:
            d = down[0]
        b0, b1, b2 = u0 + d[0], u1 + d[1], u2 + d[2]
        total = _log_sum(b0, _log_sum(b1, b2))
        marginal[k] = (exp(b1 - total), exp(b2 - total))
        if k:
            joint[k] = (exp(r1 + t11 + u1 - total), exp(r1 + t12 + u2 - total),
                        exp(r2 + t22 + u2 - total))
    return marginal, joint


def _states(nodes: list[Node]) -> list[int]:
    """States of a training page: ``data-y`` of the nearest element says whether
    a node is in the main text; what holds main text without being in it is around."""
    state = [0] * len(nodes)
    for k, node in enumerate(nodes):
        inside = state[node.parent] == 2 if k else False
        state[k] = 2 * int(node.attributes.get("data-y", inside))
    for k in range(len(nodes) - 1, 0, -1):
        if state[k] and not state[nodes[k].parent]:
            state[nodes[k].parent] = 1
    return state


class TreeModel:
    def __init__(self, weights: np.ndarray):
        self.weights = weights.tolist()
        self.tables = [tuple(self.weights[_AT_PAIR + 3 * leaf:_AT_PAIR + 3 * leaf + 3]) for leaf in (0, 1)]

    def __getstate__(self):
        return self.weights

    def __setstate__(self, weights):
        self.__init__(np.array(weights))

    def marginals(self, nodes: list[Node], features=None) -> tuple[list, list]:
        w, unary = self.weights, []
        for node, f in zip(nodes, features or tree_features(nodes)):
            unary.append((NEVER if node.text is not None else sum([w[i] * v for i, v in f]),
                          sum([w[_FEATURES + i] * v for i, v in f])))
        return sum_product(unary, [x.parent for x in nodes],
                           [self.tables[x.text is not None] for x in nodes])

    def blocks(self, page: str | None) -> list[str]:
        """The main-text blocks of a page, in page order."""
        nodes = parse(page)
        marginal, _ = self.marginals(nodes)
        return [x.text for x, p in zip(nodes, marginal) if x.text is not None and p[1] >= THRESHOLD]


class Forest:
    """Trees side by side as arrays, for training: the messages of ``sum_product``
    for all nodes of a depth at once."""

    def __init__(self, trees: list[list[Node]]):
        parent, depth, leaf = [], [], []
        rows, cols, values = [], [], []
        for nodes in trees:
            at = len(parent)
            for k, f in enumerate(tree_features(nodes)):
                up = nodes[k].parent
                parent.append(at + up if k else -1)
                depth.append(depth[at + up] + 1 if k else 0)
                leaf.append(nodes[k].text is not None)
                for i, v in f:
                    rows.append(at + k), cols.append(i), values.append(v)
        self.n, self.trees = len(parent), len(trees)
        self.parent, self.leaf, depth = np.array(parent), np.array(leaf), np.array(depth)
        self.levels = [np.nonzero(depth == d)[0] for d in range(depth.max() + 1)]
        self.rows, self.cols, self.values = np.array(rows), np.array(cols), np.array(values)

    def score(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, self.values * w[self.cols], self.n)

    def totals(self, p1, p2, joint) -> np.ndarray:
        """Features and states of parents and children, weighted by probabilities."""
        out = np.zeros(WIDTH)
        for state, p in ((0, p1), (1, p2)):
            out[state * _FEATURES:(state + 1) * _FEATURES] = np.bincount(
                self.cols, self.values * p[self.rows], _FEATURES)
        child = self.parent >= 0
        for leaf in (0, 1):
            out[_AT_PAIR + 3 * leaf:_AT_PAIR + 3 * leaf + 3] = joint[child & (self.leaf == leaf)].sum(0)
        return out

    def marginals(self, w: np.ndarray):
        """P(1), P(2) and joint (1, 1), (1, 2), (2, 2) of every node."""
        tables = w[_AT_PAIR:].reshape(2, 3)[self.leaf.astype(int)]
        up = np.zeros((self.n, 3))
        up[:, 1] = np.where(self.leaf, NEVER, self.score(w[:_FEATURES]))
        up[:, 2] = self.score(w[_FEATURES:_AT_PAIR])
        to, down, joint = np.zeros((self.n, 3)), np.zeros((self.n, 3)), np.zeros((self.n, 3))
        add = np.logaddexp
        for at in self.levels[:0:-1]:
            (u0, u1, u2), (t11, t12, t22) = up[at].T, tables[at].T
            to[at] = np.stack([u0, add(u0, add(t11 + u1, t12 + u2)), add(u0, t22 + u2)], 1)
            np.add.at(up, self.parent[at], to[at])
        for at in self.levels[1:]:
            above = self.parent[at]
            (r0, r1, r2), (t11, t12, t22) = (up[above] + down[above] - to[at]).T, tables[at].T
            down[at] = np.stack([add(r0, add(r1, r2)), t11 + r1, add(t12 + r1, t22 + r2)], 1)
            joint[at] = np.stack([r1 + t11 + up[at, 1], r1 + t12 + up[at, 2], r2 + t22 + up[at, 2]], 1)
        belief = up + down
        total = add(belief[:, 0], add(belief[:, 1], belief[:, 2]))
        return (np.exp(belief[:, 1] - total), np.exp(belief[:, 2] - total),
                np.exp(joint - total[:, None]))


def train(pages: list[str], steps: int = STEPS) -> TreeModel:
    """Weights by gradient ascent (Adam) on the labelled pages' likelihood."""
    trees = [parse(page) for page in pages]
    forest = Forest(trees)
    state = np.concatenate([_states(nodes) for nodes in trees])
    above = state[forest.parent]
    observed = forest.totals(state == 1, state == 2, np.stack(
        [(above == a) & (state == b) for a, b in ((1, 1), (1, 2), (2, 2))], 1))
    w, m, s = np.zeros(WIDTH), np.zeros(WIDTH), np.zeros(WIDTH)
    for step in range(1, steps + 1):
        gradient = (observed - forest.totals(*forest.marginals(w))) / len(trees) - RIDGE * w
        m, s = 0.9 * m + 0.1 * gradient, 0.99 * s + 0.01 * gradient ** 2
        w = w + RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.99 ** step)) + 1e-6)
    return TreeModel(w)


@functools.cache
def default_model() -> TreeModel:
    """The model of the labelled pages, trained once per process."""
    return train(labelled_pages() + embedding_pages() + layout_pages())


def extract(pages: DataFrame, model: TreeModel | None = None, html_col: str = "html",
            text_col: str = "text") -> DataFrame:
    """``pages`` without the html, with the main text (a column of that name is
    replaced)."""
    model = model or default_model()
    others = [c for c in pages.drop(text_col).columns if c != html_col]
    schema = pages.select(*others, F.lit("").alias(text_col)).schema
    ordered = pages.select(*others, html_col)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                texts = ["\n\n".join(model.blocks(x.as_py())) for x in part.column(len(others))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())],
                                                 [*others, text_col])

    return ordered.mapInArrow(run, schema)


def op10_html_tree_model(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).withColumn("n_chars", F.length("text").cast("bigint"))
