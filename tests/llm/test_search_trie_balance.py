"""Cost-balanced packing, ranked lexical search and the prefix trie against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tripflow.llm import balanced_packing, common, lexical_search, prefix_trie
from tripflow.llm.queries import QUERIES, tokenizer_file

LONG = " ".join(f"word{i}" for i in range(3000))


# ---- balanced packing ---------------------------------------------------------


def check_places(rows, texts, capacity=2048):
    """Every id of each row in exactly one piece, no gap in a sequence; the number of sequences and their costs."""
    ids_of = common.TokenIds(tokenizer_file("word_bpe_49k.json"))
    whole = [ids_of(text or "") + (1).to_bytes(4, "little") for _, text in texts]
    expected = Counter((doc_id, len(ids) // 4) for (doc_id, _), ids in zip(texts, whole, strict=True))
    tokens, ends = Counter(), defaultdict(list)
    for r in rows:
        tokens[r.doc_id, r.doc_tokens] += r.length
        ends[r.sequence_id].append((r.offset, r.length))
        assert any(
            i == r.doc_id and len(ids) // 4 == r.doc_tokens and zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32
            for (i, _), ids in zip(texts, whole, strict=True)
        )
    assert tokens == Counter({key: key[1] * n for key, n in expected.items()})
    for places in ends.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    by_piece = defaultdict(list)
    for r in rows:
        by_piece[r.doc_id, r.doc_tokens].append((r.start, r.length))
    for (doc_id, total), parts in by_piece.items():
        covered = Counter(at for start, length in parts for at in range(start, start + length))
        assert set(covered) == set(range(total)) and set(covered.values()) == {expected[doc_id, total]}
    return ends


def test_every_token_has_one_place(spark):
    draw = np.random.default_rng(5)
    texts = [(i, " ".join(f"t{k}" for k in range(int(size)))) for i, size in enumerate(draw.lognormal(5, 1, 80))]
    texts += [(100, None), (101, ""), (102, " \n"), (None, "no id"), (None, "no id"), (7, "again"), (7, "again"), (103, LONG)]
    table = spark.createDataFrame([(i, t, 1, "x") for i, t in texts], "doc_id long, text string, length int, task string").repartition(5)
    rows = balanced_packing.pack_documents(table, tokenizer_file("word_bpe_49k.json")).collect()
    ends = check_places(rows, texts)
    total = sum(r.length for r in rows)
    assert len(ends) <= total // 2048 + 2


def test_empty_table_packs_nothing(spark):
    table = spark.createDataFrame([], "doc_id long, text string")
    assert balanced_packing.pack_documents(table, tokenizer_file("word_bpe_49k.json")).collect() == []


def test_plan_is_the_greedy_assignment():
    """Without cuts, runs give each sequence the load that placing piece by piece gives it."""
    compared = 0
    for seed in range(60):
        draw = np.random.default_rng(seed)
        histogram = {int(size): int(draw.integers(1, 20)) for size in draw.integers(1, 60 if seed % 2 else 12, 8)}
        slots = balanced_packing.plan_slots(histogram, 100, 4)
        loads = defaultdict(lambda: [0, 0])
        placed = Counter()
        for slot in slots:
            placed[slot.run.source] += slot.length * slot.run.count
            for sequence in range(slot.sequence, slot.sequence + slot.run.count):
                loads[sequence][0] += balanced_packing.cost(slot.length)
                loads[sequence][1] += slot.length
        assert placed == Counter({size: size * n for size, n in histogram.items()})
        assert all(used <= 100 for _, used in loads.values())
        count = -(-sum(size * n for size, n in histogram.items()) // 100)
        if len(loads) > count or any(slot.run.cuts or slot.length < slot.run.source for slot in slots):
            continue
        compared += 1
        single = [[0, 0] for _ in range(count)]
        for size in sorted(histogram, reverse=True):
            for _ in range(histogram[size]):
                one = min(load for load in single if load[1] + size <= 100)
                one[0] += balanced_packing.cost(size)
                one[1] += size
        assert sorted(map(tuple, loads.values())) == sorted(tuple(load) for load in single if load[1])
    assert compared >= 10


def test_costs_are_balanced_without_padding():
    draw = np.random.default_rng(3)
    histogram = Counter(np.clip(draw.lognormal(5, 0.7, 20_000).astype(int), 1, 2047).tolist())
    costs, used = defaultdict(int), defaultdict(int)
    for slot in balanced_packing.plan_slots(histogram):
        for sequence in range(slot.sequence, slot.sequence + slot.run.count):
            costs[sequence] += balanced_packing.cost(slot.length)
            used[sequence] += slot.length
    assert sum(used.values()) > 0.998 * 2048 * len(used)
    full = np.array([costs[sequence] for sequence in used if used[sequence] > 2000])
    assert full.std() < 0.03 * full.mean()


def test_checksums_of_parts():
    draw = np.random.default_rng(2)
    for _ in range(50):
        a, b = draw.bytes(int(draw.integers(0, 90))), draw.bytes(int(draw.integers(1, 900)))
        got = balanced_packing.after_zeros(np.array([zlib.crc32(a)]), np.array([len(b)]))[0] ^ np.uint32(zlib.crc32(b))
        assert got == zlib.crc32(a + b)


# ---- lexical search -------------------------------------------------------------

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_search(docs, items, top=20):
    vectors = [(i, Counter(TERM.findall((t or "").translate(SMALL)))) for i, t in docs]
    vectors = [(i, v) for i, v in vectors if v]
    n, total = len(vectors), sum(sum(v.values()) for _, v in vectors)
    df = Counter(term for _, v in vectors for term in v)
    out = []
    for item_id, text in items:
        found = []
        for i, v in vectors:
            m, score = 100 - 25 + 25 * sum(v.values()) * n // total, 0
            for term in TERM.findall((text or "").translate(SMALL)):
                if v[term]:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[term] + 1)))
                    score += w * (1_000_000_000 * v[term] // (1000 * v[term] + 12 * m))
            if score:
                found.append((-score, i is None, i))
        out += [(item_id, k + 1, i, -score) for k, (score, _, i) in enumerate(sorted(found, key=lambda f: (f[0], f[1], f[2] or 0))[:top])]
    return sorted(out, key=str)


def search_rows(spark, docs, items):
    docs = spark.createDataFrame([(i, t, 1.0, "x") for i, t in docs], "doc_id long, text string, score double, rank string")
    items = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, doc_id int")
    return sorted(map(tuple, lexical_search.search(docs.repartition(6), items).collect()), key=str)


@pytest.mark.parametrize("block", [8192, 40])
def test_search_is_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", block)
    draw = np.random.default_rng(1)
    words = [f"W{i}" for i in range(40)] + ["É", "é", "a-b", "Straße", "x\x00y", "日本", "²"]
    odds = 1 / np.arange(1, len(words) + 1)
    odds /= odds.sum()

    def text(low, high):
        return " ".join(draw.choice(words, int(draw.integers(low, high)), p=odds))

    docs = [(i, text(1, 60)) for i in range(300)] + [(400 + i, "W1 W2 W30 é") for i in range(60)]
    docs += [(900, None), (901, ""), (902, " .,!"), (None, "W39 W38 W37"), (None, "W39 W38 W37"), (5, "W39 again"), (903, text(20_000, 20_001))]
    items = [(i, text(1, 40)) for i in range(15)] + [(50, None), (51, ""), (52, "nothing known"), (None, "W39"), (3, "w39 W38"), (3, "w39 W38")]
    assert search_rows(spark, docs, items) == brute_search(docs, items)


def test_item_blocks_do_not_change_scores(spark, monkeypatch):
    docs = [(i, " ".join(f"v{(i * k) % 17}" for k in range(1, 9))) for i in range(80)]
    items = [(i, f"v{i} v{i + 1} v{2 * i}") for i in range(9)]
    whole = search_rows(spark, docs, items)
    monkeypatch.setattr(lexical_search, "ITEM_BYTES", 20)
    assert search_rows(spark, docs, items) == whole == brute_search(docs, items)


def test_search_of_empty_tables(spark):
    assert search_rows(spark, [], [(1, "a")]) == [] == search_rows(spark, [(1, "a")], [])


def test_bounds_cover_every_document_below():
    draw = np.random.default_rng(8)
    ranks = [np.sort(draw.choice(30, int(draw.integers(1, 12)), replace=False)) for _ in range(400)]
    counts = [draw.integers(1, 9, len(one)) for one in ranks]
    weights = draw.integers(0, 5000, 30)
    trie = lexical_search.Trie(np.arange(400), draw.integers(75, 300, 400), ranks, counts, weights)
    leaves = [trie.ranges[node] for node in range(len(trie.ranges)) if not trie.children[node]]
    assert sorted(leaves) == [(a, b) for a, b in sorted(leaves)] and sum(b - a for a, b in leaves) == 400
    for node, (a, b) in enumerate(trie.ranges):
        for term in range(30):
            part = slice(trie.places[term], trie.places[term + 1])
            bound = trie.bounds[part][trie.nodes[part] == node].max(initial=0)
            inside = slice(trie.starts[a], trie.starts[b])
            assert bound >= trie.gains[inside][trie.terms[inside] == term].max(initial=0)


# ---- prefix trie ------------------------------------------------------------------


def brute_trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {conv: [t[2:] for t in sorted(found)] for conv, found in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for conv in own:
        h = zlib.crc32(str(conv).encode()) % 6
        path = tuple(own.get(conv - int(math.fmod(conv, 100)), [])[:h] + own[conv][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(conv)
        ends[path].append(conv)
    out = []
    for path, found in members.items():
        below = [other for other in members if other[: len(path)] == path]
        out.append((
            min(found), len(path), min(members[path[:-1]]) if path else None, len(found),
            sum(len(other) == len(path) + 1 for other in below),
            sum(not any(deep[: len(other)] == other and len(deep) > len(other) for deep in below) for other in below),
            sum((len(members[other]) - 1) * len(other[-1][1]) for other in below if other),
            hashlib.sha256(",".join(map(str, sorted(ends[path]))).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def trie_rows(spark, rows):
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, ref string")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, prefix_trie.rebuilt_trie(table).select(columns).collect()), key=str)


def conversations():
    draw = np.random.default_rng(4)
    rows = []
    for conv in [*range(0, 40), *range(100, 130), *range(230, 245), -7, 10**12]:
        for turn in range(int(draw.integers(0, 9))):
            rows.append((conv, turn, ("user", "assistant")[turn % 2], f"t{draw.integers(0, 3)}" * int(draw.integers(1, 3))))
    for conv in range(500, 560):  # copies
        rows += [(conv, turn, "user", "same é") for turn in range(7)]
    rows += [(900, None, "user", "first"), (900, 0, None, None), (901, 0, "", ""), (None, 0, "user", "lost"), (902, 3, "user", "x"), (902, 3, "user", "x")]
    rows += [(700, turn, "user", f"long {turn % 5}" + "y" * (30_000 if turn == 4 else 0)) for turn in range(300)]
    return rows


@pytest.mark.parametrize("chunk", [4096, 2])
def test_trie_is_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(prefix_trie, "CHUNK", chunk)
    rows = conversations()
    assert trie_rows(spark, rows) == brute_trie(rows)


def test_trie_of_empty_table(spark):
    assert trie_rows(spark, []) == brute_trie([])


def test_collisions_are_found_out_and_all_is_done_anew(spark, monkeypatch):
    table = spark.createDataFrame([(1, 0, "u", "a"), (2, 0, "u", "b"), (3, 0, "u", "b")], "conv_id long, turn long, role string, text string")
    turns = prefix_trie.stored_turns(table)
    refs = {r.conv_id: r.ref for r in turns.collect()}
    schema = "depth long, x long, y long, ref long"
    assert not prefix_trie.equal_by_turns(spark.createDataFrame([(1, 5, 5, refs[1]), (1, 5, 5, refs[2])], schema), turns)
    assert prefix_trie.equal_by_turns(spark.createDataFrame([(1, 5, 5, refs[2]), (1, 5, 5, refs[3]), (1, 6, 5, refs[1])], schema), turns)
    verdicts, tried = iter([False, True]), []
    monkeypatch.setattr(prefix_trie, "equal_by_turns", lambda *_: tried.append(1) or next(verdicts))
    rows = conversations()[:60]
    assert trie_rows(spark, rows) == brute_trie(rows) and len(tried) == 2


def test_queries_are_registered():
    assert {"op11_balanced_packing", "op12_lexical_search", "op13_prefix_trie"} <= set(QUERIES)
