"""Operators against brute force on small rows, and their defined cases."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripflow.llm import chat, common, decontamination, graph, html_text, licenses, near_dup, packing, pii, quality, repeats, token_files
from tripflow.llm.queries import tokenizer_file

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, span string"
LONG = " ".join(f"w{i}" for i in range(400))
ROWS = [
    (1, LONG), (2, LONG + " tail"), (3, None), (4, ""), (5, "  \n\t "), (6, "one two"), (6, "one two"), (None, "no id here"),
    (7, "Mail a.b@c.org or +1 (555) 010-9999 now, card 4111 1111 1111 1111 ip 10.0.0.1 and 300.1.1.1\nok"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None, "s", 0, 9, "x") for i, t in ROWS], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def byte_ids(text):
    return common.TokenIds(tokenizer_file("byte_bpe_50k.json"))(text)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunked_ids_are_the_library_ids(name):
    from tokenizers import Tokenizer

    whole, ours = Tokenizer.from_file(tokenizer_file(name)), common.TokenIds(tokenizer_file(name))
    for text in ["", " ", "a b", " a", "a ", "a  b\n\nc", "a\n b", "it's ''s\t x", "\x1ca b", "x<|endoftext|>y", "Σας é ́z", LONG]:
        assert ours(text) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_plan_holds_every_piece_and_no_more_than_fits():
    for seed in range(60):
        draw = np.random.default_rng(seed)
        histogram = {int(size): int(draw.integers(1, 30)) for size in draw.integers(1, 50, 12)}
        plan, held = packing.plan_sequences(histogram, 50), Counter()
        for pattern in plan:
            assert sum(pattern.items) <= 50
            for size in pattern.items:
                held[size] += pattern.count
        assert held == histogram


def test_dominance_keeps_the_optimum():
    fixed, rest = packing.reduce_by_dominance({6: 2, 4: 2, 3: 3, 2: 1}, 10)
    assert (6, 4) in [pattern.items for pattern in fixed]
    assert sum(pattern.count for pattern in packing.plan_sequences({6: 2, 4: 2, 3: 3, 2: 1}, 10)) == 4


def test_packing_places_all_pieces(docs, empty):
    rows = packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.json")).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    by_doc = Counter()
    for r in rows:
        by_doc[r.doc_id] += r.length
    assert by_doc[1] == len(byte_ids(LONG)) // 4 + 1 and by_doc[3] == by_doc[4] == 1
    fill = Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill[r.sequence_id]
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 1024
    assert packing.pack_documents(empty, tokenizer_file("byte_bpe_50k.json")).count() == 0


def test_simple8b_round_trip():
    draw = np.random.default_rng(3)
    for count in (0, 1, 255, 256, 257, 3000):
        for high in (1, 50, 49_407, 2**40, 2**64 - 1):
            values = draw.integers(0, high, count, dtype=np.uint64, endpoint=True)
            words, firsts = token_files.encode(values)
            assert (token_files.decode(words, firsts, count) == values).all()


def test_token_files(spark, docs, empty, tmp_path):
    for number, table in enumerate((docs, empty)):
        path = str(tmp_path / f"ids{number}")
        token_files.write_token_files(table, path, tokenizer_file("word_bpe_49k.json"), 1)
        rows = token_files.read_token_files(spark, path).collect()
        assert len(rows) == table.count()
        starts = sorted((r.start, r.n_tokens) for r in rows)
        assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))
        for r in rows:
            if r.doc_id in (3, 4, 5):
                assert r.ids_crc32 == zlib.crc32(np.array([1], "<u4").tobytes())


def test_near_duplicates_link_a_star_and_copies(spark, empty):
    base = [f"w{i}" for i in range(300)]
    rows = [(100, " ".join(base)), (50, " ".join(base)), (3, None), (4, " "), (9, "A b"), (8, "a B")]
    for i in range(40):  # each differs from the centre alone by little, from each other by more
        words = list(base)
        for at in (i * 7 % 300, (i * 7 + 150) % 300, (i * 7 + 75) % 300):
            words[at] = f"x{i}"
        rows.append((200 + i, " ".join(words)))
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    component = {r.doc_id: r.component_id for r in got}
    sets = {doc: set(near_dup.shingle_set(text or "").tolist()) for doc, text in rows}
    for a in sets:
        for b in sets:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                assert component[a] == component[b]
    assert component[9] == component[8] == 8 and component[3] == 3 and component[4] == 4
    assert {r.doc_id: r.n_shingles for r in got}[9] == 1
    assert near_dup.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("split", [2000, 1])
def test_repeats_against_brute_force(spark, monkeypatch, split):
    monkeypatch.setattr(repeats, "GROUP_CELLS", split)
    draw = np.random.default_rng(5)
    words = [f"wort{i}" for i in range(3000)]
    passage = " ".join(draw.choice(words, 60))
    texts = [" ".join(draw.choice(words, 50)) + passage[: 150 + 40 * i] + " ".join(draw.choice(words, 40)) for i in range(6)]
    texts += ["ä" * 700, texts[0], None, "short", ""]
    rows = list(enumerate(texts))
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id")).collect()
    raw = {i: (text or "").encode() for i, text in rows}
    seen = Counter(text[at : at + 200] for text in raw.values() for at in range(len(text) - 199))
    assert len(got) == len(rows)
    for r in got:
        text, gone = raw[r.doc_id], bytearray(len(raw[r.doc_id]))
        for at in range(len(text) - 199):
            if seen[text[at : at + 200]] > 1:
                gone[at : at + 200] = b"\1" * 200
        kept = bytes(b for b, flag in zip(text, gone, strict=True) if not flag)
        spans = len(re.findall(b"\1+", bytes(gone)))
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(text), sum(gone), spans)
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_quality_counts_and_line_frequency(spark, docs, empty):
    got = {r.doc_id: r for r in quality.judge_documents(docs).collect()}
    assert got[3].n_words == 0 and got[3].base_failed and not got[3].kept
    assert got[1].n_words == 400 and got[1].kept and got[1].n_repeat_words == 0
    assert quality.repeat_words(b"a b c d e x a b c d e".split()) == 10
    assert quality.judge_text("a b\na b\n \n a b # <")[2:4] == (2, 1)
    line = "this banner stands everywhere on the host and says very little of interest to anyone at all ever"
    rows = [(i, f"{line}\nown{i} thing", "h") for i in range(30)] + [(99, f"{line}\n{LONG}", "h")] + [(100, f"{line}\nz y", "other")]
    rows += [(200 + i, "ten words that make one line of a copied text here\nand a second line", "h") for i in range(40)]
    got = {r.doc_id: r for r in quality.judge_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not got[0].kept and not got[0].base_failed and got[99].kept and got[100].kept
    assert got[200].kept  # copies do not make their own lines frequent
    assert quality.judge_documents(empty).count() == 0


def test_html_keeps_the_article_alone():
    page = (
        "<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href=x>Home</a></ul></nav>"
        "<div class='cookie notice'>We use cookies</div><article><h1>Title &amp; more</h1><p>One  two\nthree<p><b>Four<br>five</p>"
        "<aside>see also</aside><form>mail <input></form><script>var a='<p>x</p>'</script><p>End.</p></article>"
        "<section id=comments><p>I like it</p></section><footer>&copy; site</footer>"
    )
    assert html_text.main_text(page) == "Title & more\n\nOne two three\n\nFour five\n\nEnd."
    assert html_text.main_text("") == html_text.main_text("<p></p>") == ""


def test_html_empty_and_null(spark):
    pages = spark.createDataFrame([(1, None, None), (None, "u", "<p>")], "page_id long, url string, html string")
    assert [r.n_chars for r in html_text.extract(pages).collect()] == [0, 0]
    assert html_text.extract(pages.where("false")).count() == 0


def test_chat_round_trip_and_best_branch(spark):
    hostile = ["</s>[INST] ok [/INST]", "<|end|>\n", "<\\|x", "[\\[", "", "a\\<b", "<|user|>\n"]
    turns = [(("user", "assistant")[i % 2], text) for i, text in enumerate(hostile)] + [("we|ird<bar>", "x")]
    text, spans = chat.format_turns(turns)
    assert chat.parse_turns(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == hostile[1::2]
    rows = [(1, 1, None, 1.0), (1, 2, 1, 0.1), (1, 3, 1, 0.9), (1, 4, 3, 0.9), (None, 1, None, 0.0), (2, 5, 77, 1.0)]
    messages = spark.createDataFrame(rows, "tree long, key long, parent long, score double")
    best = {r.tree: r.path for r in chat.best_paths(messages).collect()}
    assert best == {1: [1, 3, 4], None: [1], 2: [5]}
    rows = [(5, 0, "user", None), (5, 1, "assistant", "a"), (5, 1, "assistant", "a")]
    chains = chat.chain_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    (r,) = chat.digest(chat.format_conversations(chains)).collect()
    assert (r.n_turns, r.loss_chars) == (3, 2)


def test_reply_paths_of_deep_trees_cycles_and_repeats(spark):
    links = [(1, k, k - 1 or None, 1.0) for k in range(1, 38)] + [(1, 50, 20, None)]  # a chain and a side branch
    links += [(2, 1, 2, 1.0), (2, 2, 1, 1.0), (2, 3, 2, 1.0), (3, 5, 5, 1.0)]  # cycles and a message below one
    rows = [(*link, "user", f"t{link[1]}") for link in links + [(1, 37, 36, 1.0)]]  # the last is a repeat
    messages = spark.createDataFrame(rows, "tree long, key long, parent long, score double, role string, text string")
    got = {r.branch: r.path for r in chat.best_paths(messages, 3).collect()}
    assert got == {1: list(range(1, 38)), 2: [*range(1, 21), 50]}
    (r,) = chat.digest(chat.format_conversations(messages)).collect()
    assert (r.conv_id, r.n_turns) == (1, 38)


def test_decontamination_against_brute_force(spark, docs, empty):
    draw = np.random.default_rng(2)
    words = [f"v{i}" for i in range(80)]
    items = [(i, " ".join(draw.choice(words, 25)) + ". " + " ".join(draw.choice(words, 6)) + ".") for i in range(40)]
    texts = [" ".join(draw.choice(words, 300)) for _ in range(30)]
    planted = {i: i % 40 for i in range(0, 30, 3)}
    rows = [(i, t[:900] + " " + items[planted[i]][1].upper() + " " + t[900:] if i in planted else t) for i, t in enumerate(texts)]
    benchmark = spark.createDataFrame(items + [(99, None), (98, "")], "item_id long, text string")
    got = decontamination.find_contamination(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in got} == set(planted.items())
    assert decontamination.find_contamination(empty, benchmark).count() == 0
    assert decontamination.find_contamination(docs, benchmark.where("false")).count() == 0


def index_of(items):
    bags = [set(decontamination.words_of(text)) for _, text in items]
    frequency = Counter(word for bag in bags for word in bag)
    mean = sum(len(decontamination.words_of(text)) for _, text in items) / len(items)
    return decontamination.Index(items, frequency, len(items), mean)


@pytest.mark.parametrize("pivot", [0, 0.25, 1])
def test_block_bounds_lose_no_item(monkeypatch, pivot):
    monkeypatch.setattr(decontamination, "PIVOT", pivot)
    monkeypatch.setattr(decontamination, "GROUP_WORDS", 128)
    draw = np.random.default_rng(4)
    items = [(i, " ".join(f"v{j}" for j in draw.integers(0, 60, 20 if i % 7 else 100))) for i in range(70)]
    index = index_of(items)
    assert [group.step for group in index.groups] == [64, 128]
    texts = [[f"v{j}" for j in draw.integers(0, 70, size)] for size in (0, 3, 60, 200, 900)]
    got = {
        (text, first, group.ids[item]): round(score, 9)
        for text, first, group, item, score in index.search(texts, 0.4)
    }
    n, bags = len(items), [Counter(text.split()) for _, text in items]
    mean = sum(bag.total() for bag in bags) / n
    want = {}
    for item, bag in enumerate(bags):
        weight = {}
        for word, tf in bag.items():
            df = sum(word in other for other in bags)
            weight[word] = np.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * bag.total() / mean))
        step = 64 if bag.total() <= 64 else 128
        for text, words in enumerate(texts):
            for first in range(0, max(1, len(words) - step), step):
                held = set(words[first : first + 2 * step])
                score = sum(value for word, value in weight.items() if word in held) / sum(weight.values())
                if score >= 0.4:
                    want[text, first, item] = round(score, 9)
    assert want and got == want


def test_scores_do_not_depend_on_the_parts_of_the_index(spark):
    draw = np.random.default_rng(6)
    words = [f"v{i}" for i in range(200)]
    items = [(i, " ".join(draw.choice(words, 30 + 10 * (i % 9))) + ". The end is near.") for i in range(60)]
    items += [items[0], (7, "another text under one id. Yes it is.")]
    texts = [(i, " ".join(draw.choice(words, 100)) + " " + items[i][1] + " " + " ".join(draw.choice(words, 300))) for i in range(20)]
    table = spark.createDataFrame(texts + [(None, items[3][1]), (5, "clean words under a used id")], "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    one = decontamination.find_contamination(table, benchmark).collect()
    some = decontamination.find_contamination(table, benchmark, index_bytes=4000).collect()
    assert sorted(map(str, one)) == sorted(map(str, some))
    assert {(r.doc_id, r.item_id) for r in one} == {(i, i) for i in range(20)} | {(None, 3)}
    rest = decontamination.remove_contaminated(table, benchmark).collect()
    assert [(r.doc_id, r.text) for r in rest] == [(5, "clean words under a used id")]


def test_pii_spans(docs, empty):
    got = {r.doc_id: r for r in pii.detect(docs).collect()}
    r, text = got[7], dict(ROWS)[7]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1)
    found = [span.split(":") for span in r.spans.split(",")]
    assert [text[int(a) : int(b)] for _, a, b in found] == ["a.b@c.org", "10.0.0.1", "4111 1111 1111 1111", "+1 (555) 010-9999"]
    assert got[3].spans == "" and got[3].base_sha256 == hashlib.sha256(b"").hexdigest()
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[7].startswith("Mail [EMAIL] or [PHONE] now, card [CARD] ip [IP] and 300") and clean[1] == LONG
    assert pii.detect(empty).count() == 0


def test_licenses(spark, docs, empty):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/x.txt", LONG), (3, "c/y.txt", "Licensed under CC BY-NC 4.0.\n" + LONG),
        (4, "c/z.txt", LONG), (5, None, None), (6, "a/b/c/d", "the license of the version"),
    ]
    table = spark.createDataFrame(rows, "doc_id long, p string, text string")
    got = {r.doc_id: r for r in licenses.scan(table, F.col("p")).collect()}
    assert (got[1].license, got[1].is_file) == ("MIT", True)
    assert (got[2].license, got[2].effective, got[2].from_doc, got[2].distance) == (None, "MIT", 1, 1)
    assert (got[6].effective, got[6].distance) == ("MIT", 2)
    assert (got[3].effective, got[3].is_file) == ("CC-BY-NC-4.0", False) and got[4].effective is None and got[5].effective is None
    assert licenses.scan(empty, F.col("source")).count() == 0
    vector = licenses.vectors({}, 10)[0][2]
    left = sum(w * w for t, w in vector.items() if t not in licenses.required_terms(vector))
    assert left < licenses.COSINE**2


def test_pipeline_stages(spark, sf, docs):
    import corpus_pipeline

    table = spark.read.parquet(f"{sf}/documents.parquet")
    kept = table
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = common.land(stage(spark, kept, sf), "stage")
        assert after.columns == table.columns and after.count() <= kept.count()
        kept = after
    packed = corpus_pipeline.run(spark, sf)
    assert packed.select("doc_id").distinct().count() == kept.select("doc_id").distinct().count()


def test_near_duplicates_of_a_crowded_template(spark):
    draw = np.random.default_rng(8)
    template = [f"t{i}" for i in range(804)]
    rows = [(i, template + [f"o{i}.{k}" for k in range(85)]) for i in range(600)]  # 0.82 to each other
    pairs = [(int(a), 1000 + i) for i, a in enumerate(draw.choice(600, 40, replace=False))]
    rows += [(b, rows[a][1][:-60] + [f"p{b}.{k}" for k in range(60)]) for a, b in pairs]  # 0.87 to a, 0.82 to all others
    sets = {doc: set(near_dup.shingle_set(" ".join(words)).tolist()) for doc, words in rows}
    assert all(100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) for a, b in pairs)
    assert 100 * len(sets[0] & sets[1]) < 85 * len(sets[0] | sets[1])
    table = spark.createDataFrame([(doc, " ".join(words)) for doc, words in rows], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(table).collect()}
    partner = {b: a for a, b in pairs}
    assert got == {doc: partner.get(doc, doc) for doc, _ in rows}


def test_rounds_of_heads_end_by_their_yield_and_lose_no_link(spark, monkeypatch):
    draw = np.random.default_rng(8)
    rows = [(i, [f"t{k}" for k in range(300)] + [f"o{i}.{k}" for k in range(33)]) for i in range(120)]  # 0.80 to each other
    partner = {1000 + i: int(a) for i, a in enumerate(draw.choice(120, 12, replace=False))}
    rows += [(b, rows[a][1][:-22] + [f"p{b}.{k}" for k in range(22)]) for b, a in partner.items()]  # 0.86 to one
    names, land = [], near_dup.land
    monkeypatch.setattr(near_dup, "land", lambda df, name: names.append(name) or land(df, name))
    monkeypatch.setattr(near_dup, "TRIES_PER_LINK", 1)
    table = spark.createDataFrame([(doc, " ".join(words)) for doc, words in rows], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(table).collect()}
    assert got == {doc: partner.get(doc, doc) for doc, _ in rows}
    assert names.count("tries") == 1


def test_pipeline_writes_few_files_of_many_partitions(spark, sf, monkeypatch):
    import corpus_pipeline

    files, land = Counter(), common.land

    def counted(df, name):
        table = land(df, name)
        files[name] = max(files[name], len(table.inputFiles()))
        return table

    for module in (decontamination, graph, near_dup, pii, quality, corpus_pipeline):
        monkeypatch.setattr(module, "land", counted)
    spark.conf.set("spark.sql.shuffle.partitions", "48")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        corpus_pipeline.run(spark, sf)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    most = 2 * spark.sparkContext.defaultParallelism
    assert {"labels", "links", "members", "sets", "stage-packing"} <= set(files)
    assert {name: n for name, n in files.items() if n > most} == {}


def test_near_duplicates_link_null_and_repeated_ids(spark):
    draw = np.random.default_rng(12)
    w, v = ([f"{name}{i}" for i in draw.permutation(300)] for name in "wv")
    rows = [(1, w), (1, v), (2, [*w, "x"]), (3, [*v, "y"]), (None, [*w, "z"]), (None, ["alone"] * 9), (None, ["alone"] * 9), (5, [])]
    table = spark.createDataFrame([(doc, " ".join(words)) for doc, words in rows], "doc_id long, text string")
    got = near_dup.near_duplicates(table, 80).select("doc_id", "component_id", "kept").collect()
    want = [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (None, 1, False), (None, None, True), (None, None, True), (5, 5, True)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_regions_do_not_depend_on_batches(spark):
    draw = np.random.default_rng(13)
    signatures = [draw.integers(0, 3, near_dup.TREES * near_dup.DEPTH).astype(">u4").tobytes() for _ in range(120)]
    table = spark.createDataFrame(list(enumerate(signatures)), "doc_id long, signature binary").coalesce(1)
    results = []
    for size in ("10000", "1", "3"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        try:
            results.append(sorted(map(tuple, near_dup.region_rows(table).collect())))
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
            spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1] == results[2] and len(results[0]) > 100


@pytest.mark.parametrize("group_rows", [4000, 3])
def test_crowd_pairs_lose_no_link(spark, monkeypatch, group_rows):
    monkeypatch.setattr(near_dup, "GROUP_ROWS", group_rows)
    draw = np.random.default_rng(9)
    texts = []
    for i in range(120):
        words = [f"t{k}" for k in range(int(draw.integers(60, 120)))]
        for at in draw.choice(len(words), int(draw.integers(0, 3)), replace=False):
            words[at] = f"x{int(draw.integers(0, 40))}"
        texts.append((i, " ".join(words)))
    table = spark.createDataFrame(texts, "doc_id long, text string")
    crowd = table.select("doc_id", F.col("doc_id").alias("component"))
    words = near_dup.packed_words(table, near_dup.keyed(table).select("doc_id", "row_key"))
    for percent in (80, 85):
        links = near_dup.confirm(near_dup.crowd_pairs(crowd, words, percent), words, percent).collect()
        sets = [set(near_dup.shingle_set(text).tolist()) for _, text in texts]
        true = {
            (a, b) for a in range(120) for b in range(a + 1, 120)
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
        }
        assert true and {(r.a, r.b) for r in links} == true


def test_pipeline_keeps_one_row_of_each_group(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(400)]
    near = words[:-40] + [f"n{i}" for i in range(40)]  # 0.82
    other = " ".join(f"z{i}" for i in range(50))
    rows = [
        (4, " ".join(words)), (4, " ".join(words)), (5, " ".join(near)), (None, "no id but text"), (None, "no id but text"),
        (7, " ".join(words)), (7, other), (9, None), (None, ""),
    ]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.keep_first_copies(spark, table, "").collect()
    expected = [(4, rows[0][1]), (None, "no id but text"), (7, other), (9, None), (None, "")]
    assert Counter(map(tuple, got)) == Counter(expected)


def test_redact_replaces_overlapping_spans_whole(spark):
    texts = [
        "Mail user@10.0.0.1 now", "call +49 30 123456 10.0.0.1 or é", "password=a.b@c.org a.b@c.org", "x 10.0.0.1, 10.0.0.2",
        "password=+49301234567 end",
    ]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: [(s.start, s.end, s.kind) for s in r.found] for r in pii.detect(table).collect()}
    clean = {r.doc_id: r.text for r in pii.redact(table).collect()}
    overlaps = 0
    for doc, text in enumerate(texts):
        expected, at = "", 0
        for start, end, kind in sorted(found[doc], key=lambda one: (one[0], -one[1])):
            if start >= at:
                expected += text[at:start] + f"[{kind.upper()}]"
            else:
                overlaps += 1
            at = max(at, end)
        assert clean[doc] == expected + text[at:]
    assert overlaps and clean[0] == "Mail [EMAIL] now" and clean[1] == "call [PHONE] or é" and clean[3] == "x [IP], [IP]"


def test_quality_counts_different_documents_with_much_boilerplate(spark):
    shared = "\n".join(f"shared line {i} that stands on each page of this host" for i in range(30))
    rows = [(i, f"{shared}\nown line {i}", "h") for i in range(60)] + [(100 + i, f"{shared}\nown line 0", "copies") for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality.judge_documents(table).collect()}
    assert all(not got[i].kept and got[i].n_removed_words == 330 for i in range(60))
    assert all(got[100 + i].n_removed_words == 0 for i in range(60))


def test_frequent_lines_leave_the_texts(spark):
    import corpus_pipeline

    banner = "Subscribe to\t our  NEWSLETTER today"
    rows = [(i, f"{banner}\n\nown{i} {LONG}\n subscribe to our newsletter TODAY", "h", 1) for i in range(30)]
    rows += [(5, "too short", "h", 9), (50, f"{banner}\n{LONG}", None, 7), (None, f"{banner}\nx {LONG}", "h", 1), (61, None, "h", 0)]
    rows += [rows[3]]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int")
    expected = [(i, f"\nown{i} {LONG}", "h", len(f"\nown{i} {LONG}")) for i in range(30)]
    expected += [expected[3], rows[31], (None, f"x {LONG}", "h", len(f"x {LONG}"))]
    got = corpus_pipeline.keep_good(spark, table, "")
    assert got.columns == table.columns and Counter(map(tuple, got.collect())) == Counter(expected)
    judged = quality.judge_documents(table)
    assert judged.count() == len(rows) and Counter(r.text for r in judged.collect())["too short"] == 1


def test_html_keeps_what_follows_unclosed_and_empty_elements():
    first, second = "The first paragraph tells a long story of some thirty words or so", "The second one goes on with the same story"
    whole = f"{first}\n\n{second}"
    article = f"<article><p>{first}</p>%s<p>{second}</p></article>"
    pages = [
        "<head><title>x</title><meta charset=utf-8><body>" + article % "", "<html><head><title>x</title>" + article % "",
        "<head><noscript><img src=x></noscript><style>p{}</style></head><body>" + article % "", article % "<svg/>",
        article % "<svg><title>t</title><path/></svg>", article % "<div><svg><path></div>", article % "<div><template><p>no</div>",
        article % "<noscript><p>no</p></noscript>", article % "<div><iframe src=x></div>",
    ]
    for page in pages:
        assert html_text.main_text(page) == whole, page
    assert html_text.main_text(article % "<figure><figcaption>What it shows</figcaption></figure>") == f"{first}\n\nWhat it shows\n\n{second}"
    assert html_text.main_text(f"<div class='page has-sidebar'>{article % ''}</div>") == whole
    assert html_text.main_text(article % "<div class=post-header>Its own header</div>") == f"{first}\n\nIts own header\n\n{second}"
    assert html_text.main_text(f"<article><p>a <svg><path/></svg> b {first}</p></article>") == f"a b {first}"


def test_license_terms_weigh_by_all_documents(spark):
    line = "released under the mit license today everywhere"
    for spread in (0, 60):
        others = [(10 + i, "s", "today everywhere" if i < spread else "other words") for i in range(60)]
        table = spark.createDataFrame([(1, "s", line), *others], "doc_id long, source string, text string")
        found = licenses.scan(table, F.col("source")).where("doc_id = 1").collect()[0]
        # Words that every document has weigh less, so the same line comes nearer to the template.
        n, df = 61, {"released": 1, "under": 1, "the": 1, "mit": 1, "license": 1, "today": 1 + spread, "everywhere": 1 + spread}
        weights = {term: licenses.idf(count, n) for term, count in df.items()}
        cosine = (sum(w * w for t, w in weights.items() if t not in ("today", "everywhere")) / sum(w * w for w in weights.values())) ** 0.5
        assert found.license == "MIT" and abs(found.cosine - cosine) < 1e-8


def test_license_terms_are_cut_as_in_the_templates(spark):
    texts = ["", ".", ".a", "a.", "a.b", "a..b", "-a-b-", "by-nc 4.0.", "é.a", "a.é", "a\n.b", "v. 2.0 (the \"l\");", "a.-b", "a-", "\n-\na.b.c--d", "x\U0001f600.y"]
    frame = spark.createDataFrame([(text,) for text in texts], "text string")
    for row in frame.select("text", licenses.terms_column(F.col("text")).alias("terms")).collect():
        assert row.terms == licenses.terms_of(row.text), row.text


def test_selectors_take_as_many_ids_as_fit():
    draw = np.random.default_rng(5)
    for top, count in ((3, 700), (49_000, 2_000), (1 << 62, 600)):
        values = (draw.random(count) ** 3 * top).astype(np.uint64)
        words, firsts = token_files.encode(values)
        expected, starts = [], []
        for block in range(0, count, token_files.BLOCK):
            starts.append(len(expected))
            at, end = block, min(count, block + token_files.BLOCK)
            while at < end:
                inside = [int(v) for v in values[at:end]]
                fit = [c for c in range(1, 15) if all(v.bit_length() <= token_files.WIDTHS[c] for v in inside[: token_files.COUNTS[c]])]
                if not fit:
                    expected += [token_files.ESCAPE, inside[0]]
                    at += 1
                    continue
                size, width = int(token_files.COUNTS[fit[0]]), int(token_files.WIDTHS[fit[0]])
                expected.append(fit[0] + sum(v << (4 + width * k) for k, v in enumerate(inside[:size])))
                at += size
        assert words.tolist() == expected and firsts.tolist() == starts


def test_only_rows_that_may_lose_lines_are_flagged(spark):
    schema = "doc_id long, source string, text string"
    rows = [(i, "h" if i % 3 else None, f"text {i}") for i in range(400)] + [(None, None, None), (None, "h", "x")]
    table = spark.createDataFrame(rows, schema)
    some = table.where("doc_id % 40 = 7 or doc_id is null")
    place = F.struct("doc_id", "source", "text")
    got = Counter(map(tuple, quality.with_flag(table, place, some, place).collect()))
    wanted = Counter((*row, row[0] is None or row[0] % 40 == 7) for row in rows)
    assert got.keys() >= {row for row in wanted if row[3]} and sum(got.values()) == len(rows) and len(got.keys() - wanted.keys()) < 5
    assert not quality.with_flag(table, place, some.limit(0), place).where("flag").count()


def test_shingle_counts_do_not_hang_on_partitions(spark):
    texts = [(i, " ".join(f"w{k}" for k in range(40)) + f" own{i}") for i in range(60)]
    table = spark.createDataFrame(texts, "doc_id long, text string")
    words = near_dup.packed_words(table, near_dup.keyed(table).select("doc_id", "row_key"))
    many = common.land(words.repartition(20), "many")
    shingles, numbers = near_dup.frequent_shingles(many)
    assert len(shingles) == 36 and set(numbers.tolist()) == {60} and (np.diff(shingles) > 0).all()


def test_links_that_are_stars_need_no_round(spark):
    def stars(rows):
        return graph.are_stars(spark.createDataFrame(rows, "u long, v long"))

    assert stars([(2, 1), (3, 1), (9, 4)]) and stars([])
    assert not stars([(2, 1), (3, 2)]) and not stars([(3, 1), (3, 2)])
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 40), (50, 41), (60, 60)], "a long, b long")
    got = {(r.node, r.component) for r in graph.components(links).collect()}
    assert got == {(i, 0) for i in range(21)} | {(i, 40) for i in (40, 41, 50)}
