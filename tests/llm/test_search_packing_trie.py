"""Search, packing and the prefix tree against brute force and the public library; nulls, empty and odd inputs."""

import bisect
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from trigpoint.llm import lexical, packing, trie

DOC = "doc_id long, text string, lang string, id long, score string, length long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", 7, "extra", 3) for i, t in rows], DOC)


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute_search(docs, items, k=10):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    n, total = sum(1 for _, c in counts if c), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    wanted = defaultdict(set)
    for item, t in items:
        wanted[item] |= set(terms(t))
    out = []
    for item, own in wanted.items():
        found = []
        for doc, c in counts:
            m = 10 + 90 * sum(c.values()) * n // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in own if c[t])
            if s > 0:
                found.append((-s, doc is None, doc or 0, doc))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return Counter(out)


def test_search_is_brute_force(spark):
    r = random.Random(5)
    word = lambda: r.choice("abcdefgh") + str(int(r.paretovariate(0.6)) % 300)
    docs = [(i, " ".join(word() for _ in range(int(r.paretovariate(0.7)) % 900))) for i in range(150)]
    docs += [(200 + i, "the same copy of words a1 b1") for i in range(30)] + [(5, docs[5][1]), (None, "the same copy"), (None, None), (900, ""), (901, "…!? -"), (902, "É日本 x_y É"), (903, "a1 " * 40_000)]
    items = [(i, " ".join(word() for _ in range(12))) for i in range(25)] + [(50, "SAME Copy"), (50, "words"), (51, None), (52, "--"), (None, "É x"), (53, "a1"), (54, "absent9x")]
    found = lexical.LexicalIndex.build(docs_of(spark, docs).repartition(3)).search(spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int"))
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, found.collect())) == brute_search(docs, items)


def test_search_in_blocks_and_of_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 3)
    docs, items = [(i, f"w{i % 4} w{i % 3} all") for i in range(20)], [(i, f"w{i} all") for i in range(5)]
    asked = spark.createDataFrame(items, "item_id long, text string")
    index = lexical.LexicalIndex.build(docs_of(spark, docs))
    assert len(list(index.blocks(asked))) > 1
    assert Counter(map(tuple, index.search(asked, 4).collect())) == brute_search(docs, items, 4)
    assert index.search(asked.limit(0)).collect() == []
    assert lexical.LexicalIndex.build(docs_of(spark, docs).limit(0)).search(asked).collect() == []
    assert lexical.LexicalIndex.build(docs_of(spark, [(1, None), (2, "...")])).search(asked).collect() == []


def test_index_has_small_row_groups(spark, monkeypatch):
    """A task's shards aren't held together by the writer, nor by a reader."""
    monkeypatch.setattr(lexical, "SHARD_BYTES", 20_000)
    monkeypatch.setattr(lexical, "GROUP_BYTES", 60_000)
    docs = [(i, " ".join(f"w{i}x{j}" for j in range(300))) for i in range(120)]
    index = lexical.LexicalIndex.build(docs_of(spark, docs).coalesce(1))
    sizes = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in index.shards.inputFiles()]
    groups = [m.row_group(i) for m in sizes for i in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) > 10
    assert max(g.total_byte_size for g in groups) < 120_000
    asked = spark.createDataFrame([(1, "w7x5 w9x2")], "item_id long, text string")
    assert Counter(map(tuple, index.search(asked).collect())) == brute_search(docs, [(1, "w7x5 w9x2")])


def test_bounds_enclose_impacts():
    tf, m = np.arange(1, 500).repeat(50), np.tile(np.arange(10, 5010, 100), 499)
    exact = lexical.impacts(tf, m)
    upper = -((-exact * lexical.STEPS) // lexical.SCALE)
    assert upper.max() <= 255 and (exact * lexical.STEPS <= upper * lexical.SCALE).all() and (exact * lexical.STEPS > (upper - 1) * lexical.SCALE).all()


def vocabulary():
    return public_tokenizers.path("word_bpe_49k.json")


ODD = [None, "", " \n", "Hello, World! it's 2024's don't 'S", "Éléphant STRAßE ÿ Ÿ İstanbul ΣΑΣ ς", "é å K T̈ ́x", "a b c\x1cd\x85e", "x²½ ª º µ × ÷ ŉ", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|> <|x",
       "日本語 テスト 🙂👩‍👩‍👧", "tab\tnew\nline\x0bv\x0cf\rr", "\x00\x7f\x80 \xad x", "word " * 5000, "x" * 20_000, "many words of every kind " * 9_000]


def test_pieces_are_the_public_library(spark):
    known = Tokenizer.from_file(vocabulary())
    rows = packing.pieces(docs_of(spark, enumerate(ODD)), vocabulary(), with_ids=True).orderBy("doc_id", "piece").collect()
    for i, text in enumerate(ODD):
        ids = known.encode(text or "", add_special_tokens=False).ids + [1]
        cut = [ids[k : k + 4096] for k in range(0, len(ids), 4096)]
        own = [r for r in rows if r.doc_id == i]
        assert [r.ids for r in own] == cut, text and text[:40]
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in own] == [(k, 4096 * k, len(c), zlib.crc32(np.array(c, "<u4").tobytes())) for k, c in enumerate(cut)]


def plain_best_fit(lengths, capacity):
    rooms, full = [], 0
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, n)
        room = rooms.pop(at) if at < len(rooms) else capacity
        if room > n:
            bisect.insort(rooms, room - n)
        else:
            full += 1
    return sorted([0] * full + rooms)


@pytest.mark.parametrize(("seed", "capacity"), [(1, 10), (2, 64), (3, 100), (4, 4096), (5, 1)])
def test_runs_are_plain_best_fit(seed, capacity):
    r = random.Random(seed)
    lengths = [min(capacity, 1 + int(r.paretovariate(0.5)) % capacity if r.random() < 0.7 else r.randint(1, capacity)) for _ in range(5000)]
    held = defaultdict(list)
    taken = Counter()
    for length, first, n, bin_, each, offset in packing.best_fit_decreasing(Counter(lengths), capacity):
        assert first == taken[length]
        taken[length] += n
        for j in range(n):
            held[bin_ + j // each].append((offset + j % each * length, length))
    assert taken == Counter(lengths)
    for own in held.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= capacity
    assert sorted(capacity - sum(n for _, n in own) for own in held.values()) == plain_best_fit(lengths, capacity)


def test_pack(spark):
    rows = [(i, f"w{i} " * (i * 37 % 900 + 1)) for i in range(300)] + [(7, "again"), (7, "again"), (None, "no id")]
    cut = packing.pieces(docs_of(spark, rows).repartition(4), vocabulary(), 500, with_ids=True)
    found = packing.pack(cut.selectExpr("*", "1 AS part", "2 AS nth", "3 AS offset"), 500).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length) for r in found) == Counter(tuple(r)[:4] for r in cut.collect())
    held = defaultdict(list)
    for r in found:
        held[r.sequence_id].append((r.offset, r.ids))
    whole = {r.sequence_id: r for r in packing.sequences(packing.pack(cut, 500)).collect()}
    assert sorted(500 - sum(len(x) for _, x in own) for own in held.values()) == plain_best_fit([r.length for r in found], 500)
    assert sum(len(r.ids) for r in whole.values()) == sum(r.length for r in found) and max(len(r.ids) for r in whole.values()) <= 500
    assert all(r.starts[0] == 0 and r.starts == sorted(set(r.starts)) for r in whole.values())
    assert packing.pack(cut.limit(0), 500).collect() == []
    for bad in (0, 501, None):
        with pytest.raises(ValueError, match="lengths"):
            packing.pack(spark.createDataFrame([(1, 3), (2, bad)], "doc_id long, length long"), 500)


TURN = "conv_id long, turn long, role string, text string, a string, depth int"


def brute_trie(turns, convs=None):
    """turns: (conv_id, turn, role, text), no two of a conversation alike in turn."""
    by = defaultdict(list)
    for conv, turn, role, text in turns:
        if conv is not None:
            by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    seqs = {c: tuple(x[2:] for x in sorted(by[c])) for c in (convs if convs is not None else by)}
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += children[k] == 0
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
    ends = lambda k: ",".join(map(str, sorted(c for c in members[k] if len(seqs[c]) == len(k))))
    return {(min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], hashlib.sha256(ends(k).encode()).hexdigest()) for k, m in members.items()}


def some_turns(seed, n=60):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(r.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c * 3, t if t else r.choice([None, 0]), r.choice(["user", "user", "assistant", None]), r.choice(["yes", "no", "yes", None, "日本 ok"])))
    rows += [(1000 + i, t, "user", "copy") for i in range(20) for t in range(4)] + [(None, 1, "user", "nobody")]
    return rows


def test_trie_is_brute_force(spark):
    turns = some_turns(3)
    keys = trie.turn_keys(spark.createDataFrame([(*t, "x", 1) for t in turns], TURN).repartition(5))
    found = trie.prefix_trie(keys)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute_trie(turns)


def test_trie_of_turnless_conversations_and_of_nothing(spark):
    turns = [(2, 0, "user", "a"), (4, 0, "user", "a")]
    keys, convs = trie.turn_keys(spark.createDataFrame([(*t, "x", 1) for t in turns], TURN)), [1, 2, 4, 9]
    found = trie.prefix_trie(keys, spark.createDataFrame([(c,) for c in convs], "conv_id long"))
    assert {tuple(r) for r in found.collect()} == brute_trie(turns, convs)
    assert trie.prefix_trie(keys.limit(0)).collect() == []


def test_trie_of_long_conversations_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 100)  # what the driver puts into the plan
    turns = [(c, t, "user", f"{t}" if t < fork else f"{c}/{t}") for c, size, fork in ((1, 1500, 1500), (2, 900, 450), (3, 1500, 1500), (5, 700, 120), (8, 40, 40), (9, 1, 1)) for t in range(size)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        keys = trie.turn_keys(spark.createDataFrame([(*t, "x", 1) for t in turns], TURN))
        assert {tuple(r) for r in trie.prefix_trie(keys).collect()} == brute_trie(turns)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repeated_turns_have_an_order(spark):
    turns = [(c, t, "user", x) for c in (1, 2) for t, x in ((0, "b"), (0, "a"), (0, "a"), (1, "z"))]
    found = trie.prefix_trie(trie.turn_keys(spark.createDataFrame([(*t, "x", 1) for t in turns], TURN).repartition(4))).collect()
    assert sorted((r.depth, r.n_convs) for r in found) == [(d, 2) for d in range(5)]
