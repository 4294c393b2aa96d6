"""Benchmark passages in training documents: BM25 over an inverted index of the items.

Items are grouped by their length, rounded up to a power of two. For each group a document is cut into
overlapping passages, each long enough that an item of the group falls whole into one, so a long item does
not widen the passages of short ones. A passage is a query for all items whose score reaches the threshold.
Scores are relative to the score an item gets from its own text, so one threshold serves all items.

The search is a block-max WAND over many passages at a time. The terms of a passage are sorted by their upper
bounds; those below the pivot, whose bounds together stay under a share of the threshold, cannot bring an item alone, so
their postings are not walked. The block maxima of the others, and then of the skipped terms where needed, bound
every block of items reached, and only postings of blocks whose bound reaches the threshold are read.

A hit counts when the five-word shingles of the item's question (all but the last sentence) and of
its answer (the last one) both lie in the passage to at least ``OVERLAP`` per cent.

Term frequencies and the mean length are counted once over all items. More than ``INDEX_BYTES`` of items are
searched in parts, one after the other, with the same statistics and so with the same scores.

Defined cases: null or blank texts match nothing; repeated document rows give their own matches, repeated item
rows count once; an item of fewer than five words is one shingle; null ids are kept; other columns are ignored;
empty tables give no rows.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripflow.llm.common import SHINGLE_WORDS, TEXT_ROWS, few_files, land, shingle_hashes, word_hashes

WORD = re.compile(r"\w+")
OVERLAP = 80
THRESHOLD = 0.6
BLOCK_ITEMS = 16
#: BM25 constants.
K1, B = 1.2, 0.75
#: Item text that one index (and so one broadcast) may hold; more items make more indexes.
INDEX_BYTES = 8 << 20
#: Buckets that one index is filled from, so that it stays within its bytes.
BUCKETS = 16
#: Passages of the shortest items move on by this many words and are twice as long.
LEAST_STEP = 64
#: Words searched at a time.
GROUP_WORDS = 1 << 16
#: Share of the threshold that the bounds of the terms below the pivot may reach together.
PIVOT = 0.25
SLACK = 1e-9
MATCHES = "doc_id long, text_key binary, item_id long, passage long, score double, question double, answer double"


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def hashes_of(words: list[str]) -> np.ndarray:
    return word_hashes([word.encode("utf-8", "surrogatepass") for word in words])


def ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    sizes = ends - starts
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: the last sentence or line answers what comes before."""
    parts = [part for part in re.split(r"(?<=[.!?])\s+|\n+", text.strip()) if WORD.search(part)]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, text)


def totals(keys: np.ndarray, weights: np.ndarray, space: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and the sums of their weights."""
    if space <= 4 * len(keys):
        found = np.flatnonzero(np.bincount(keys, minlength=space))
        return found, np.bincount(keys, weights, space)[found]
    found, inverse = np.unique(keys, return_inverse=True)
    return found, np.bincount(inverse, weights, len(found))


class Postings:
    """Items of one length: postings by (term, item), and per term and block of items the largest weight.

    Terms are numbered anew by their upper bound, the smallest first; -1 stands for a term of no item here.
    """

    def __init__(self, step: int, items: list[tuple[int, str]], terms: dict[str, int], idf: np.ndarray, mean: float):
        self.step = step
        self.ids = [item_id for item_id, _ in items]
        rows = []
        lengths = np.zeros(len(items))
        for item, (_, text) in enumerate(items):
            found, counts = np.unique([terms[word] for word in words_of(text)], return_counts=True)
            lengths[item] = counts.sum()
            rows.append(np.column_stack([found, np.full(len(found), item), counts]))
        term, item, tf = np.concatenate(rows).T
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[item] / mean))
        weight /= np.bincount(item, weight, len(items))[item]
        bounds = np.zeros(len(terms))
        np.maximum.at(bounds, term, weight)
        here = np.argsort(bounds, kind="stable")[np.count_nonzero(bounds == 0) :]
        self.number = np.full(len(terms) + 1, -1)
        self.number[here] = np.arange(len(here))
        self.bounds = bounds[here]
        term = self.number[term]
        order = np.lexsort((item, term))
        term, self.items, self.weights = term[order], item[order], weight[order]
        self.blocks = -(-len(items) // BLOCK_ITEMS)
        # Block maxima, as postings of their own: block posting i holds the postings heads[i] to heads[i + 1].
        key = term * self.blocks + self.items // BLOCK_ITEMS
        first = np.flatnonzero(np.diff(key, prepend=-1))
        self.keys = key[first]
        self.heads = np.append(first, len(key))
        self.maxima = np.maximum.reduceat(self.weights, first)
        self.starts = np.searchsorted(self.keys // self.blocks, np.arange(len(here) + 1))
        parts = [[words_of(part) for part in split_item(text)] for _, text in items]
        self.lengths = [tuple(map(len, pair)) for pair in parts]
        self.shingles = [[np.unique(shingle_hashes(hashes_of(side))) for side in pair] for pair in parts]

    def search(self, passage: np.ndarray, term: np.ndarray, threshold: float) -> tuple[np.ndarray, ...]:
        """(passage, item, score) of all scores from ``threshold`` on, for distinct pairs sorted by (passage, number of the term)."""
        need = threshold - SLACK
        if not len(term):
            return passage, term, np.zeros(0)
        # The pivot: the smallest bounds of a passage that together stay below the threshold.
        bound = self.bounds[term]
        begins = np.flatnonzero(np.diff(passage, prepend=-1))
        sums = np.cumsum(bound)
        sums -= np.repeat(sums[begins] - bound[begins], np.diff(np.append(begins, len(term))))
        skipped = sums < PIVOT * need
        count = int(passage[-1]) + 1
        rest = np.bincount(passage[skipped], bound[skipped], count)
        # Blocks that the other terms reach.
        walked = term[~skipped]
        low, high = self.starts[walked], self.starts[walked + 1]
        at = ranges(low, high)
        key = np.repeat(passage[~skipped], high - low) * self.blocks + self.keys[at] % self.blocks
        places, bound = totals(key, self.maxima[at], count * self.blocks)
        places = places[bound + rest[places // self.blocks] >= need]
        # All terms of the passages of these blocks: the whole bounds, then the postings.
        low = np.searchsorted(passage, places // self.blocks)
        high = np.searchsorted(passage, places // self.blocks, "right")
        place = np.repeat(np.arange(len(places)), high - low)
        wanted = term[ranges(low, high)] * self.blocks + places[place] % self.blocks
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        held = self.keys[at] == wanted
        place, at = place[held], at[held]
        opened = (np.bincount(place, self.maxima[at], len(places)) >= need)[place]
        place, at = place[opened], at[opened]
        low, high = self.heads[at], self.heads[at + 1]
        at = ranges(low, high)
        key = places[np.repeat(place, high - low)] // self.blocks * len(self.ids) + self.items[at]
        found, score = totals(key, self.weights[at], count * len(self.ids))
        good = score >= need
        return found[good] // len(self.ids), found[good] % len(self.ids), score[good]


class Index:
    """The items of one part by their length, over one list of terms."""

    def __init__(self, items: list[tuple[int, str]], frequency: dict[str, int], number: int, mean: float):
        self.terms = {term: place for place, term in enumerate(sorted(frequency))}
        df = np.array([frequency[term] for term in self.terms], float)
        idf = np.log(1 + (number - df + 0.5) / (df + 0.5))
        groups: dict[int, list] = {}
        for item in sorted(items):
            length = len(words_of(item[1]))
            groups.setdefault(max(LEAST_STEP, 1 << (length - 1).bit_length()), []).append(item)
        self.groups = [Postings(step, group, self.terms, idf, mean) for step, group in sorted(groups.items())]

    def search(self, texts: list[list[str]], threshold: float):
        """(text, first word, item group, item, score) of every passage of the texts and every item above the threshold."""
        sizes = np.array([len(words) for words in texts])
        known = np.concatenate(
            [np.fromiter(map(self.terms.get, words, repeat(-1)), np.int64, len(words)) for words in texts]
        )
        offsets = np.cumsum(sizes) - sizes
        for group in self.groups:
            step = group.step
            numbers = np.maximum(1, -(-(sizes - step) // step))
            text = np.repeat(np.arange(len(texts)), numbers)
            first = ranges(np.zeros(len(texts), np.int64), numbers) * step
            length = np.minimum(2 * step, sizes[text] - first)
            each = max(1, GROUP_WORDS // step)
            for begin in range(0, len(text), each):
                part = slice(begin, begin + each)
                start = offsets[text[part]] + first[part]
                term = group.number[known[ranges(start, start + length[part])]]
                passage = np.repeat(np.arange(len(start)), length[part])
                key = np.sort((passage * len(group.bounds) + term)[term >= 0])
                key = key[np.diff(key, prepend=-1) > 0]
                found = group.search(key // len(group.bounds), key % len(group.bounds), threshold)
                for one, item, score in zip(*found, strict=True):
                    yield text[begin + one], int(first[begin + one]), group, int(item), float(score)


def contained(wanted: np.ndarray, hashes: np.ndarray, shingles: np.ndarray, length: int) -> float:
    """Share of the wanted shingles; a part of fewer than five words is looked up as a run of words."""
    if not len(wanted):
        return 1.0
    if length < SHINGLE_WORDS:
        runs = (shingle_hashes(hashes[at : at + length])[0] for at in range(len(hashes) - length + 1))
        return float(any(run == wanted[0] for run in runs))
    return len(np.intersect1d(wanted, shingles, assume_unique=True)) / len(wanted)


def grouped(texts) -> list[tuple[int, int]]:
    """Runs of texts of about ``GROUP_WORDS`` words, by their characters."""
    bounds = np.cumsum([len(text) for text in texts]) // (6 * GROUP_WORDS)
    cuts = [0, *(np.flatnonzero(np.diff(bounds)) + 1).tolist(), len(texts)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def scan(docs: DataFrame, index, threshold: float) -> DataFrame:
    """The matches of one broadcast index."""

    def matches(batches):
        lookup = index.value
        for batch in batches:
            ids, keys, out = batch["doc_id"].astype("Int64"), batch["text_key"], []
            for begin, end in grouped(batch["text"]) if len(batch) else ():
                texts = [words_of(text) for text in batch["text"][begin:end]]
                for text, first, group, item, score in lookup.search(texts, threshold):
                    hashes = hashes_of(texts[text][first : first + 2 * group.step])
                    shingles = np.unique(shingle_hashes(hashes))
                    shares = [
                        contained(wanted, hashes, shingles, length)
                        for wanted, length in zip(group.shingles[item], group.lengths[item], strict=True)
                    ]
                    row = begin + text
                    out.append((ids.iloc[row], keys.iloc[row], group.ids[item], first, round(score, 12), *shares))
            frame = pd.DataFrame(out, columns=[field.split()[0] for field in MATCHES.split(", ")])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            frame["item_id"] = frame["item_id"].astype("Int64")
            yield frame

    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text")
    return texts.mapInPandas(matches, MATCHES)


def text_key():
    return F.unhex(F.md5("text"))


def item_table(benchmark: DataFrame, buckets: int, number: int) -> DataFrame:
    """item_id, text, bucket, number of words and distinct terms of every different item with a word, of ``number`` rows."""

    def rows(batches):
        for batch in batches:
            words = [words_of(text) for text in batch["text"]]
            batch["n_words"] = [len(one) for one in words]
            batch["terms"] = [sorted(set(one)) for one in words]
            yield batch[batch["n_words"] > 0]

    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    placed = items.withColumn("bucket", F.pmod(F.xxhash64("item_id", "text"), F.lit(buckets)))
    counted = placed.mapInPandas(
        lambda batches: rows(batch.astype({"item_id": "Int64"}) for batch in batches),
        "item_id long, text string, bucket long, n_words long, terms array<string>",
    )
    return land(few_files(counted, number, TEXT_ROWS), "items")


def all_matches(docs: DataFrame, benchmark: DataFrame, threshold: float, index_bytes: int) -> DataFrame:
    """The matches of all items, each part of them searched and written before the next one's index is built."""
    context = docs.sparkSession.sparkContext
    size, rows = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    items = item_table(benchmark, BUCKETS * max(1, -(-size // index_bytes)), rows)
    number, mean = items.agg(F.count("*"), F.avg("n_words")).first()
    frequency = items.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    frequency = land(few_files(frequency, size // 2), "frequency")  # a term has a letter and a gap at least
    parts: list[list[int]] = []
    room = 0
    for bucket, held in sorted(items.groupBy("bucket").agg(F.sum(F.octet_length("text"))).collect()):
        if held > room:
            parts.append([])
            room = index_bytes
        parts[-1].append(bucket)
        room -= held
    found = docs.sparkSession.createDataFrame([], MATCHES)
    for part in parts:
        mine = items.where(F.col("bucket").isin(part))
        terms = mine.select(F.explode("terms").alias("term")).distinct()
        counts = {row["term"]: row["n"] for row in frequency.join(terms, "term", "left_semi").collect()}
        texts = [(row["item_id"], row["text"]) for row in mine.select("item_id", "text").collect()]
        index = context.broadcast(Index(texts, counts, number, mean))
        found = found.unionByName(land(scan(docs, index, threshold), "matches"))
        index.unpersist()
    return found


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    threshold: float = THRESHOLD,
    overlap: int = OVERLAP,
    index_bytes: int = INDEX_BYTES,
) -> DataFrame:
    """doc_id, item_id, best score and overlaps of every document that holds an item."""
    return (
        all_matches(docs, benchmark, threshold, index_bytes)
        .where((100 * F.col("question") >= overlap) & (100 * F.col("answer") >= overlap))
        .groupBy("doc_id", "item_id")
        .agg(
            F.max("score").alias("score"),
            F.max("question").alias("question_overlap"),
            F.max("answer").alias("answer_overlap"),
            F.count("*").alias("n_passages"),
        )
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: int = OVERLAP) -> DataFrame:
    """The rows whose text holds no benchmark item, unchanged; another text under the same id stays."""
    held = (100 * F.col("question") >= overlap) & (100 * F.col("answer") >= overlap)
    bad = all_matches(docs, benchmark, threshold, INDEX_BYTES).where(held).select("text_key").distinct()
    return docs.join(bad, text_key().eqNullSafe(bad["text_key"]), "left_anti")
