"""Ranked lexical search: a frequency-ordered trie of documents, searched by branch and bound.

A document becomes its vector of terms that occur in an item, most frequent term first. In a block
of documents these vectors, sorted, form a trie: documents with a common beginning share its path.
Every subtree knows the largest count of each of its terms and its smallest length norm, so the score
of its documents for an item is bounded; subtrees that cannot reach the item's best ``k`` are left
out. What a task found so far bounds the search in its later blocks. Each task passes on at most
``k`` documents per item, and two rankings (by group of tasks, then all) give the best.

Terms are the maximal runs of ``[0-9A-Za-z]`` and characters beyond ASCII; only A-Z are lower-cased.
Scores are whole numbers: see :func:`gain`.

Items are searched in blocks of about ``ITEM_BYTES``, whose terms the tasks hold. All statistics are those
of all documents and of single terms, so the blocks do not change a score.

Defined cases: a null or empty text has no terms and is never found, a null or empty item finds nothing;
rows with a null or repeated doc_id are documents of their own, a null id ranks behind equal scores;
a repeated item is answered once per row; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from bisect import insort
from collections import Counter

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripflow.llm.common import land

TOP = 20
#: Text of the items searched at once; the tasks hold their terms.
ITEM_BYTES = 4 << 20
#: Documents and terms of one trie; a leaf holds at most so many documents.
BLOCK_DOCS, BLOCK_TERMS, LEAF_DOCS = 8192, 2_000_000, 16
#: Tasks whose results are ranked together first.
TASK_GROUPS = 64
NO_ID = np.iinfo(np.int64).max

SEPARATORS = bytes(range(0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x80))
TO_SPACE = bytes.maketrans(SEPARATORS, b" " * len(SEPARATORS))


def terms_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().translate(TO_SPACE).split()


def weight(n_docs: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * frequency + 1)))


def norm(length, n_docs: int, n_terms: int):
    """Length norm of documents with ``length`` terms."""
    return 75 + 25 * length * n_docs // n_terms


def gain(weights, counts, norms):
    """What a term adds to a score; grows with the count and falls with the norm."""
    return weights * (1_000_000_000 * counts // (1000 * counts + 12 * norms))


def restricted_vectors(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """Number of terms, and places and counts of those in ``vocabulary``, per document with a term."""
    known = {term: place for place, term in enumerate(vocabulary)}

    def scan(batches):
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                terms = terms_of(text)
                if terms:
                    found = Counter(map(known.get, terms))
                    found.pop(None, None)
                    places = np.fromiter(found.keys(), "<u4", len(found)).tobytes()
                    rows.append((doc_id, len(terms), places, np.fromiter(found.values(), "<u4", len(found)).tobytes()))
            frame = pd.DataFrame(rows, columns=["doc_id", "n", "terms", "counts"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInPandas(scan, "doc_id long, n long, terms binary, counts binary")


def document_frequencies(vectors: DataFrame, size: int) -> np.ndarray:
    """Documents per place of the vocabulary; every task sends its sums."""

    def count(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch["terms"]), "<u4"), minlength=size)
        place = np.flatnonzero(total)
        yield pd.DataFrame({"place": place, "n": total[place]})

    sums = vectors.select("terms").mapInPandas(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    frequencies = np.zeros(size, np.int64)
    for row in sums.collect():
        frequencies[row["place"]] = row["n"]
    return frequencies


class Trie:
    """A block of documents as a trie with bounds. Vectors are given as ranks (0: most frequent term)."""

    def __init__(self, ids, norms, ranks: list[np.ndarray], counts: list[np.ndarray], weights: np.ndarray):
        keys = [one.astype(">u4").tobytes() for one in ranks]
        order = sorted(range(len(keys)), key=lambda at: (keys[at], ids[at]))
        ranks, counts = [ranks[at] for at in order], [counts[at] for at in order]
        self.ids, self.norms = ids[order], norms[order]
        sizes = np.array([len(one) for one in ranks])
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.terms, self.counts = np.concatenate(ranks), np.concatenate(counts)
        self.gains = gain(weights[self.terms], self.counts, np.repeat(self.norms, sizes))
        self.weights = weights
        self._branch(self._common(ranks))
        self._bound()

    @staticmethod
    def _common(ranks: list[np.ndarray]) -> np.ndarray:
        """Length of the beginning that each vector shares with the one before."""
        common = np.zeros(len(ranks), np.int64)
        for at in range(1, len(ranks)):
            size = min(len(ranks[at - 1]), len(ranks[at]))
            differ = ranks[at - 1][:size] != ranks[at][:size]
            common[at] = differ.argmax() if differ.any() else size
        return common

    def _branch(self, common: np.ndarray) -> None:
        """Nodes as ranges of documents: a path is followed to its next branching, small neighbours share a leaf."""
        self.ranges, self.children, todo = [(0, len(common))], [[]], [0]
        while todo:
            node = todo.pop()
            a, b = self.ranges[node]
            if b - a <= LEAF_DOCS:
                continue
            inside = common[a + 1 : b]
            cuts = (np.flatnonzero(inside == inside.min()) + a + 1).tolist()
            first = a
            for left, right in zip([a, *cuts], [*cuts, b], strict=True):
                if right - first > LEAF_DOCS:
                    if left > first:
                        self._add(node, first, left)
                    first = left
                    if right - left > LEAF_DOCS:
                        todo.append(self._add(node, left, right))
                        first = right
            if first < b:
                self._add(node, first, b)

    def _add(self, node: int, a: int, b: int) -> int:
        self.ranges.append((a, b))
        self.children.append([])
        self.children[node].append(len(self.ranges) - 1)
        return len(self.ranges) - 1

    def _bound(self) -> None:
        """Per node the smallest norm and id and the largest count per term, as postings of gains by term."""
        largest = np.zeros(len(self.weights), np.int64)
        tops, lows, first_ids = {}, np.zeros(len(self.ranges), np.int64), np.zeros(len(self.ranges), np.int64)
        for node in range(len(self.ranges) - 1, -1, -1):
            a, b = self.ranges[node]
            if self.children[node]:
                for child in self.children[node]:
                    np.maximum.at(largest, *tops[child])
                lows[node], first_ids[node] = lows[self.children[node]].min(), first_ids[self.children[node]].min()
            else:
                part = slice(self.starts[a], self.starts[b])
                np.maximum.at(largest, self.terms[part], self.counts[part])
                lows[node], first_ids[node] = self.norms[a:b].min(), self.ids[a:b].min()
            held = np.flatnonzero(largest)
            tops[node] = held, largest[held]
            largest[held] = 0
        nodes = np.repeat(list(tops), [len(held) for held, _ in tops.values()])
        terms = np.concatenate([held for held, _ in tops.values()])
        counts = np.concatenate([top for _, top in tops.values()])
        order = np.argsort(terms, kind="stable")
        self.nodes, terms = nodes[order], terms[order]
        self.bounds = gain(self.weights[terms], counts[order], lows[self.nodes])
        self.places = np.searchsorted(terms, np.arange(len(self.weights) + 1))
        self.first_ids = first_ids.tolist()

    def search(self, item: list[tuple[int, int]], times: np.ndarray, best: list[tuple[int, int]], top: int) -> None:
        """Keep the best of ``best`` and of this block: (minus score, id), sorted. ``times``: item's count per term."""
        limit = np.zeros(len(self.ranges), np.int64)
        for term, count in item:
            part = slice(self.places[term], self.places[term + 1])
            limit[self.nodes[part]] += count * self.bounds[part]
        limit, todo = limit.tolist(), [0]
        while todo:
            node = todo.pop()
            if not limit[node] or (len(best) == top and (-limit[node], self.first_ids[node]) > best[-1]):
                continue
            if self.children[node]:
                todo += sorted(self.children[node], key=limit.__getitem__)
                continue
            a, b = self.ranges[node]
            part = slice(self.starts[a], self.starts[b])
            scores = np.add.reduceat(times[self.terms[part]] * self.gains[part], self.starts[a:b] - self.starts[a])
            for at in np.flatnonzero(scores >= (-best[-1][0] if len(best) == top else 1)).tolist():
                insort(best, (-int(scores[at]), int(self.ids[a + at])))
                del best[top:]


def blocks(batches):
    """Frames of at most ``BLOCK_DOCS`` documents and about ``BLOCK_TERMS`` terms."""
    held, docs, terms = [], 0, 0
    for batch in batches:
        for a in range(0, len(batch), 512):
            part = batch.iloc[a : a + 512]
            size = int(part["terms"].map(len).sum()) // 4
            if held and (docs + len(part) > BLOCK_DOCS or terms + size > BLOCK_TERMS):
                yield pd.concat(held)
                held, docs, terms = [], 0, 0
            held.append(part)
            docs, terms = docs + len(part), terms + size
    if held:
        yield pd.concat(held)


def search_block(vectors: DataFrame, items: list[tuple[int, Counter]], n_docs: int, n_terms: int, frequencies, top: int) -> DataFrame:
    """Best documents per item and task: item_no, score, doc_id, task group."""
    by_frequency = np.argsort(-frequencies, kind="stable")
    rank = np.empty_like(by_frequency)
    rank[by_frequency] = np.arange(len(rank))
    weights = np.array([weight(n_docs, int(frequencies[place])) for place in by_frequency], np.int64)
    asked = [(number, [(int(rank[place]), count) for place, count in counts.items()]) for number, counts in items]

    def run(batches):
        best: dict[int, list[tuple[int, int]]] = {number: [] for number, _ in asked}
        times = np.zeros(len(weights), np.int64)
        for frame in blocks(batches):
            ranks, counts = [], []
            for places, numbers in zip(frame["terms"], frame["counts"], strict=True):
                places = rank[np.frombuffer(places, "<u4")]
                order = np.argsort(places)
                ranks.append(places[order])
                counts.append(np.frombuffer(numbers, "<u4").astype(np.int64)[order])
            ids = frame["doc_id"].astype("Int64").fillna(NO_ID).to_numpy(np.int64)
            trie = Trie(ids, norm(frame["n"].to_numpy(np.int64), n_docs, n_terms), ranks, counts, weights)
            for number, item in asked:
                for term, count in item:
                    times[term] = count
                trie.search(item, times, best[number], top)
                for term, _ in item:
                    times[term] = 0
        group = TaskContext.get().partitionId() % TASK_GROUPS
        rows = [(number, -score, doc_id, group) for number, found in best.items() for score, doc_id in found]
        yield pd.DataFrame(rows, columns=["item_no", "score", "doc_id", "task_group"])

    schema = "item_no long, score long, doc_id long, task_group int"
    return vectors.where(F.length("terms") > 0).mapInPandas(run, schema)


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` documents with the highest scores above 0 for each item."""
    spark = docs.sparkSession
    numbered = items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("item_no", F.monotonically_increasing_id())
    numbered = land(numbered, "items")
    total = numbered.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = total // ITEM_BYTES + 1
    found = spark.createDataFrame([], "item_no long, score long, doc_id long, task_group int")
    for block in range(n_blocks):
        rows = numbered.where(F.pmod(F.xxhash64("item_no"), F.lit(n_blocks)) == block).select("item_no", "text").collect()
        counted = [(row["item_no"], Counter(terms_of(row["text"]))) for row in rows]
        vocabulary = sorted({term for _, counts in counted for term in counts})
        if not vocabulary:
            continue
        place = {term: at for at, term in enumerate(vocabulary)}
        asked = [(number, Counter({place[term]: n for term, n in counts.items()})) for number, counts in counted]
        vectors = land(restricted_vectors(docs, vocabulary), "vectors")
        n_docs, n_terms = vectors.agg(F.count("*"), F.sum("n")).first()
        if n_docs:
            frequencies = document_frequencies(vectors, len(vocabulary))
            found = found.unionByName(search_block(vectors, asked, n_docs, n_terms, frequencies, top))
    by_score = [F.desc("score"), F.col("doc_id")]
    first = F.row_number().over(Window.partitionBy("item_no", "task_group").orderBy(*by_score))
    rank = F.row_number().over(Window.partitionBy("item_no").orderBy(*by_score))
    best = found.withColumn("place", first).where(F.col("place") <= top).withColumn("rank", rank).where(F.col("rank") <= top)
    doc_id = F.when(F.col("doc_id") < NO_ID, F.col("doc_id"))
    return best.join(numbered.select("item_no", "item_id"), "item_no").select("item_id", "rank", doc_id.alias("doc_id"), "score")
