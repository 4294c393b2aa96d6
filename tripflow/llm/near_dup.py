"""Near-duplicate documents by an LSH forest of MinHash signatures.

Documents with equal shingle sets fall together first (a partial aggregate). The others
are sorted in ``TREES`` orders, each by its own ``DEPTH`` values of the signature. Rows
that share at least ``LEAST`` leading values form a region. Candidates are, in turn:
each document's most frequent neighbour over all orders, the central document of each
region against the region's other components (repeated while one of ``TRIES_PER_LINK`` tries is
a link, as this only saves the last two steps work), and what these left open, found links or not:
in regions of up to ``CROWD`` rows all pairs of different components, and for the documents of larger regions with several components an exact search (``crowd_pairs``).
So a link is missed only if its documents share no region in any order. Every candidate is
confirmed on the full shingle sets, so a reported link is always right.

The search knows different sets by a number of their own, so ids need not be unique: rows with a null id and
different texts under one id are compared like all others.

Defined cases: null or blank texts have no shingles and no links; repeated rows count as copies
(each gives a row); ties go to the smallest id; null ids come last, so a component of null ids alone has none;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripflow.llm.common import TEXT_ROWS, drop, few_files, land, seeded, shingle_hashes, word_hashes
from tripflow.llm.graph import components

TREES = 16
DEPTH = 8
LEAST = 3
#: Regions of more rows ask neighbours for one more common value per doubling, and are searched by shingles at last.
CROWD = 32
#: Heads of regions are tried for as long as one try in so many is a link.
TRIES_PER_LINK = 100
#: Documents whose shingles are counted, most shingles kept as frequent, and rows of a shingle in one group.
SAMPLE = 20_000
FREQUENT = 100_000
GROUP_ROWS = 4_000
#: Sampled documents of a counting task, and shingles it holds at once.
TASK_DOCUMENTS = 1_000
HELD = 2_000_000
MULTIPLIERS = seeded(TREES * DEPTH, 7)[:, None]
FEATURES = "doc_id long, row_key binary, n_shingles long, set_key binary, signature binary"


def words_of(text: str) -> list[bytes]:
    """Words end at ASCII white space, A-Z are lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def set_of(words: list[bytes]) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    return np.unique(shingle_hashes(word_hashes(words)))


def shingle_set(text: str) -> np.ndarray:
    return set_of(words_of(text))


def signature(shingles: np.ndarray) -> bytes:
    lowest = np.full(TREES * DEPTH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        lowest = np.minimum(lowest, (MULTIPLIERS * shingles[None, at : at + 2048]).min(axis=1))
    return (lowest >> np.uint64(32)).astype(">u4").tobytes()


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (a null text is empty) and a hash of both as the key of equal rows."""
    text = F.coalesce("text", F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    row_key = F.unhex(F.md5(F.concat_ws(" ", F.coalesce(doc_id.cast("string"), F.lit("none")), F.md5(text))))
    return docs.select(doc_id.alias("doc_id"), text.alias("text"), row_key.alias("row_key"))


def features(docs: DataFrame) -> DataFrame:
    def rows(batches):
        for batch in batches:
            out = []
            for text in batch["text"]:
                found = shingle_set(text)
                key = xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None
                out.append((len(found), key, signature(found) if len(found) else None))
            frame = pd.DataFrame(out, columns=["n_shingles", "set_key", "signature"])
            frame.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
            frame.insert(1, "row_key", batch["row_key"].to_numpy())
            yield frame

    return keyed(docs).mapInPandas(rows, FEATURES)


def region_rows(distinct: DataFrame) -> DataFrame:
    """Rows (tree, region, doc_id, next, common) of every sorted order that share a region with a neighbour.

    ``common`` counts the leading values shared with the next row. The first and last rows of a task always
    stay, as their regions may go on in other tasks. A task holds one batch at a time.
    """

    def found(rows: pd.DataFrame, first: bool, last: bool) -> pd.DataFrame:
        """The rows but the first, which the batch before gave, and but the last, which the next batch gives."""
        bands = np.frombuffer(b"".join(rows["band"]), ">u4").reshape(len(rows), DEPTH)
        trees, ids = rows["tree"].to_numpy(), rows["doc_id"].to_numpy()
        same = np.concatenate([trees[1:, None] == trees[:-1, None], bands[1:] == bands[:-1]], axis=1)
        common = np.append(np.cumprod(same, axis=1).sum(axis=1) - 1, -1)  # -1: another order
        joined = common >= LEAST
        keep = joined | np.append([first], joined[:-1])
        keep[-1] |= last
        place = np.flatnonzero(keep[0 if first else 1 : None if last else -1]) + (0 if first else 1)
        return pd.DataFrame(
            {
                "tree": trees[place],
                "region": [xxhash.xxh3_64_intdigest(band[: 4 * LEAST]) - (1 << 63) for band in rows["band"].iloc[place]],
                "doc_id": ids[place],
                "next": np.append(ids[1:], 0)[place],
                "common": common[place],
            }
        )

    def neighbours(batches):
        held, first = None, True
        for batch in batches:
            if not len(batch):
                continue
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if len(rows) > 2:
                yield found(rows, first, False)
                rows, first = rows.iloc[-2:], False
            held = rows.reset_index(drop=True)
        if held is not None:
            yield found(held, first, True)

    bands = F.transform(
        F.sequence(F.lit(0), F.lit(TREES - 1)),
        lambda tree: F.struct(tree.alias("tree"), F.substring("signature", tree * (4 * DEPTH) + 1, F.lit(4 * DEPTH)).alias("band")),
    )
    ordered = (
        distinct.select("doc_id", F.explode(bands).alias("one"))
        .select("doc_id", "one.tree", "one.band")
        .repartitionByRange("tree", "band", "doc_id")
        .sortWithinPartitions("tree", "band", "doc_id")
    )
    return ordered.mapInPandas(neighbours, "tree int, region long, doc_id long, next long, common long")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the similarity.

    Compressed words travel, as they are much smaller than their sets of hashes.
    """

    def check(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            keep, held, two = [], None, None
            for a, b, left, right in zip(batch["a"], batch["b"], batch["left"], batch["right"], strict=True):
                if b != held:  # a merge join leaves the partners of one b together
                    held, two = b, set_of(unpack(right).split())
                one = set_of(unpack(left).split())
                common = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(100 * common >= percent * (len(one) + len(two) - common))
            yield batch.loc[keep, ["a", "b"]]

    left = sets.select(F.col("doc_id").alias("a"), F.col("words").alias("left"), F.col("n").alias("n_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("words").alias("right"), F.col("n").alias("n_b"))
    sizes = pairs.join(left.drop("left"), "a").join(right.drop("right"), "b")
    close = sizes.where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)").select("a", "b")
    return close.join(left.drop("n_a"), "a").join(right.drop("n_b"), "b").mapInPandas(check, "a long, b long")


def packed_words(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """For each of ``ids`` (doc_id, row_key): doc_id, size of the set, words compressed, of the row with that key."""

    def rows(batches):
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            words = [words_of(text) for text in batch["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "n": [len(set_of(one)) for one in words],
                    "words": [squeeze(b" ".join(one)) for one in words],
                }
            )

    texts = keyed(docs).select("row_key", "text").join(ids, "row_key").dropDuplicates(["row_key"])
    return texts.select("doc_id", "text").mapInPandas(rows, "doc_id long, n long, words binary")


def ordered_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def relabel(labels: DataFrame, links: DataFrame, rows: int) -> DataFrame:
    """Merge the components that new links join; neither table has many more than ``rows`` rows."""
    mapped = (
        links.join(labels.select(F.col("doc_id").alias("a"), F.col("component").alias("ca")), "a")
        .join(labels.select(F.col("doc_id").alias("b"), F.col("component").alias("cb")), "b")
        .select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    )
    roots = components(mapped, rows).withColumnRenamed("component", "root")
    joined = labels.join(roots, labels["component"] == roots["node"], "left")
    merged = joined.select("doc_id", F.coalesce("root", "component").alias("component"))
    merged = land(few_files(merged, rows), "labels")
    drop(labels)
    return merged


def open_regions(members: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The members with their components, and the regions (tree, region, size) with several components."""
    placed = members.join(labels, "doc_id")
    regions = (
        placed.groupBy("tree", "region")
        .agg(F.count("*").alias("size"), F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low <> high")
    )
    return placed, regions.select("tree", "region", "size")


def frequent_shingles(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that recur in a sample of the documents, sorted, with their estimated numbers of documents."""
    documents = sets.count()
    share = max(1, documents // SAMPLE)

    def counted(found):
        shingles, numbers = np.unique(np.concatenate(found), return_counts=True)
        return pd.DataFrame({"shingle": shingles, "n": numbers})

    def rows(batches):
        """One count per shingle and task, or per ``HELD`` shingles."""
        unpack, found, held = zstandard.ZstdDecompressor().decompress, [], 0
        for batch in batches:
            for words in batch["words"]:
                found.append(set_of(unpack(words).split()).view(np.int64))
                held += len(found[-1])
                if held > HELD:
                    yield counted(found)
                    found, held = [], 0
        if found:
            yield counted(found)

    # Tasks by the number of documents: what many small files hold in common is counted in few rows.
    tasks = -(-documents // (share * TASK_DOCUMENTS)) or 1
    sample = sets.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0).select("words").repartition(tasks)
    counts = sample.mapInPandas(rows, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where("n > 2")
    found = counts.orderBy(F.desc("n"), "shingle").limit(FREQUENT).collect()
    found = np.array([(row["shingle"], row["n"] * share) for row in found], np.int64).reshape(-1, 2)
    found = found[np.argsort(found[:, 0])]
    return found[:, 0], found[:, 1]


def crowd_pairs(crowd: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of different components in ``crowd`` (doc_id, component) that can reach the similarity.

    Shingles have one order, rare ones first. Two similar sets have a first common shingle in it, behind which each
    still holds as many as they must share; so each set gives only its first shingles, and partners for one are
    those whose size its rest allows. The order needs no exact counts. Rows of a frequent shingle are dealt to groups
    of which each pair of rows meets in one.
    """
    held = land(sets.join(crowd, "doc_id").select("doc_id", "component", "words"), "crowd-sets")
    frequent, counts = frequent_shingles(held)

    def rows(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            frames = []
            for doc_id, component, words in zip(batch["doc_id"], batch["component"], batch["words"], strict=True):
                found = set_of(unpack(words).split()).view(np.int64)
                size = len(found)
                at = np.minimum(np.searchsorted(frequent, found), max(0, len(frequent) - 1))
                known = frequent[at] == found if len(frequent) else np.zeros(size, bool)
                number = np.where(known, counts[at], 0) if len(frequent) else np.zeros(size, np.int64)
                order = np.lexsort((found, number))[: size - -(-percent * size // 100) + 1]
                found, number = found[order], number[order]
                rest = size - np.arange(len(order))
                chunks = -(-number // GROUP_ROWS)
                copies = np.maximum(chunks, 1)
                chunk = np.where(chunks > 1, xxhash.xxh3_64_intdigest(str(doc_id)) % (1 << 40) % copies, 0)
                each = np.repeat(np.arange(len(order)), copies)
                with_chunk = np.arange(len(each)) - np.repeat(np.cumsum(copies) - copies, copies)
                low, high = np.minimum(chunk[each], with_chunk), np.maximum(chunk[each], with_chunk)
                frames.append(
                    pd.DataFrame(
                        {
                            "shingle": found[each],
                            "slot": low * copies[each] + high,
                            "chunk": chunk[each],
                            "mixed": low != high,
                            "doc_id": doc_id,
                            "component": component,
                            "n": size,
                            "rest": rest[each],
                        }
                    )
                )
            if frames:
                yield pd.concat(frames, ignore_index=True)

    def pairs(batches):
        """Whole groups as they come sorted; the last one of a batch waits for the next batch."""
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            last = batch[["shingle", "slot"]].iloc[-1]
            open_rows = ((batch["shingle"] == last["shingle"]) & (batch["slot"] == last["slot"])).to_numpy()
            if not open_rows.all():
                yield from group_pairs(pd.concat([*held, batch[~open_rows]], ignore_index=True))
                held = []
            elif held:
                before = held[-1][["shingle", "slot"]].iloc[-1]
                if (before["shingle"], before["slot"]) != (last["shingle"], last["slot"]):
                    yield from group_pairs(pd.concat(held, ignore_index=True))
                    held = []
            held.append(batch[open_rows])
        if held:
            yield from group_pairs(pd.concat(held, ignore_index=True))

    def group_pairs(table):
        table = table[table.duplicated(["shingle", "slot"], keep=False)]
        if not len(table):
            return
        group = table.groupby(["shingle", "slot"], sort=False).ngroup().to_numpy()
        n = table["n"].to_numpy()
        order = np.lexsort((n, group))
        table, group, n = table.iloc[order], group[order], n[order]
        largest = (100 + percent) * table["rest"].to_numpy() // percent - n
        step = int(n.max()) + 1
        reach = np.clip(np.minimum(largest, 100 * n // percent), 0, step - 1)
        ends = np.searchsorted(group * step + n, group * step + reach, "right")
        numbers = np.maximum(ends - np.arange(len(n)) - 1, 0)
        ids, component = table["doc_id"].to_numpy(), table["component"].to_numpy()
        chunk, mixed = table["chunk"].to_numpy(), table["mixed"].to_numpy()
        total = np.cumsum(numbers)
        start = 0
        while start < len(n):  # some million pairs at a time
            before = total[start] - numbers[start]
            stop = max(start + 1, int(np.searchsorted(total, before + 2_000_000, "right")))
            left = np.repeat(np.arange(start, stop), numbers[start:stop])
            nth = np.arange(len(left)) - np.repeat(total[start:stop] - numbers[start:stop] - before, numbers[start:stop])
            right = left + 1 + nth
            fits = (largest[right] >= n[left]) & (component[left] != component[right])
            fits &= ~mixed[left] | (chunk[left] != chunk[right])
            a, b = ids[left[fits]], ids[right[fits]]
            found = pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()
            if len(found):
                yield found
            start = stop

    schema = "shingle long, slot long, chunk long, mixed boolean, doc_id long, component long, n long, rest long"
    dealt = held.mapInPandas(rows, schema).repartition("shingle", "slot").sortWithinPartitions("shingle", "slot")
    return ordered_pairs(dealt.mapInPandas(pairs, "a long, b long"))


def link_regions(docs: DataFrame, distinct: DataFrame, percent: int) -> DataFrame:
    """Component of every set with a region: doc_id, component, from ``distinct`` (doc_id, row_key, signature)."""
    number = distinct.count()
    most = TREES * number  # a row per order and set
    rows = land(few_files(region_rows(distinct.select("doc_id", "signature")), most), "regions")
    size = rows.groupBy("tree", "region").agg(F.count("*").alias("size")).where("size > 1")
    # A region asks for one more common value per doubling beyond CROWD.
    depth = F.least(F.lit(DEPTH), LEAST + F.floor(F.log2(F.greatest("size", F.lit(CROWD)) / CROWD)))
    members = rows.join(size, ["tree", "region"]).withColumn("linked", F.col("common") >= depth).drop("common")
    members = land(few_files(members, most), "members")
    drop(rows)
    central = members.groupBy("doc_id").agg(F.sum("size").alias("central"))
    ids = distinct.select("doc_id", "row_key").join(central, "doc_id", "left_semi")
    sets = land(few_files(packed_words(docs, ids), number, TEXT_ROWS), "sets")
    labels = central.select("doc_id", F.col("doc_id").alias("component"))
    near = members.where("linked").select(F.least("doc_id", "next").alias("a"), F.greatest("doc_id", "next").alias("b"))
    near = land(few_files(near.groupBy("a", "b").agg(F.count("*").alias("orders")), most), "neighbours")
    sides = near.select("a", "b", "orders", F.col("a").alias("doc_id")).unionByName(
        near.select("a", "b", "orders", F.col("b").alias("doc_id"))
    )
    best = sides.groupBy("doc_id").agg(F.max(F.struct("orders", -F.col("a"), -F.col("b"), "a", "b")).alias("best"))
    first = best.select("best.a", "best.b").distinct()
    labels = relabel(labels, confirm(first, sets, percent), most)
    placed = members.join(central, "doc_id").select("tree", "region", "doc_id", "central")
    placed = land(few_files(placed, most), "central")
    drop(members, near)
    members = placed
    used = None
    while True:
        placed = members.join(labels, "doc_id")
        if used is not None:
            placed = placed.join(used.withColumn("used", F.lit(True)), "doc_id", "left")
        else:
            placed = placed.withColumn("used", F.lit(None).cast("boolean"))
        fresh = F.when(F.col("used").isNull(), F.struct("central", -F.col("doc_id"), "doc_id", "component"))
        heads = (
            placed.groupBy("tree", "region")
            .agg(F.max(fresh).alias("head"), F.min("component").alias("low"), F.max("component").alias("high"))
            .where("low <> high and head is not null")
            .select("tree", "region", F.col("head.doc_id").alias("head"), F.col("head.component").alias("its"))
        )
        tries = placed.join(heads, ["tree", "region"]).where("component <> its")
        tries = ordered_pairs(tries.select(F.col("head").alias("a"), F.col("doc_id").alias("b")))
        tries = land(few_files(tries, most), "tries")
        tested = tries.count()
        links = land(few_files(confirm(tries, sets, percent), tested, TEXT_ROWS), "confirmed")
        found = links.count()
        again = found * TRIES_PER_LINK > tested
        if again:
            heads = heads.select(F.col("head").alias("doc_id")).distinct()
            heads = land(few_files(heads if used is None else heads.unionByName(used).distinct(), number), "heads")
        if found:
            labels = relabel(labels, links, most)
        drop(used, tries, links)
        if not again:
            break
        used = heads
    placed, regions = open_regions(members, labels)
    few = placed.join(regions.where(f"size <= {CROWD}"), ["tree", "region"]).drop("size", "central")
    few = land(few_files(few, most), "few")
    other = few.select("tree", "region", F.col("doc_id").alias("b"), F.col("component").alias("its"))
    rest = few.join(other, ["tree", "region"]).where("doc_id < b and component <> its")
    labels = relabel(labels, confirm(rest.select(F.col("doc_id").alias("a"), "b").distinct(), sets, percent), most)
    placed, regions = open_regions(members, labels)
    crowd = placed.join(regions.where(f"size > {CROWD}"), ["tree", "region"]).select("doc_id", "component").distinct()
    crowd = land(few_files(crowd, number), "crowd")
    return relabel(labels, confirm(crowd_pairs(crowd, sets, percent), sets, percent), most)


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    found = land(features(docs), "features")
    groups = found.where("set_key is not null").groupBy("set_key")
    groups = groups.agg(F.min("doc_id").alias("least"), F.min("row_key").alias("row_key"), F.first("signature").alias("signature"))
    groups = few_files(groups, found.count(), TEXT_ROWS)
    groups = land(groups.withColumn("doc_id", F.monotonically_increasing_id()), "distinct")
    labels = link_regions(docs, groups.select("doc_id", "row_key", "signature"), percent)
    classes = groups.select("set_key", "doc_id", "least").join(labels, "doc_id", "left")
    classes = classes.select("set_key", "least", F.coalesce("component", "doc_id").alias("class"))
    smallest = classes.groupBy("class").agg(F.min("least").alias("component_id"))
    classes = classes.select("set_key", "class").join(smallest, "class").drop("class")
    whole = found.select("doc_id", "n_shingles", "set_key").join(classes, "set_key", "left")
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    whole = whole.select("doc_id", "n_shingles", component.alias("component_id"))
    return whole.withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))
